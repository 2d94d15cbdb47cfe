"""Exact n-gram Jaccard join with signature trees.

1. Every text becomes a set of 64-bit hashes of its word n-grams. Texts of one
   set are one class; only classes go on.
2. Two sets of similarity t share a token among the first n - ceil(t n) + 1 of
   each in any common order (prefix filter), so tokens are blocks. The order
   puts tokens of many documents last: counts of all prefix tokens mark them in
   bitmaps of fixed size, which broadcast at any scale. Tokens of one class
   fall away.
3. In each block every class is compared with the block's leader (linear, no
   pairs within the group). Links give first components; a block whose members
   have one label is done, which ends groups of copies of any size.
4. Blocks that still hold several labels get signature trees: nodes hold the OR
   of their members' token bitmaps, ranges of sizes and a label if they share
   one. A dual traversal prunes node pairs by the largest possible overlap and
   those of one label. Blocks beyond a limit are dealt in pairs of chunks.
5. Pairs that survive are compared exactly. No link between different
   components is lost; pairs within one need no comparison.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import Scratch, map_text, pick, texts
from plumbline.llm.graph import components
from plumbline.llm.quality import windows, word_hashes

#: Documents beyond which a token moves a class back in the order.
FREQUENT = (8, 64, 512)
#: log2 of the bits of each broadcast bitmap: 4 MB.
BITMAP = 25
#: log2 of the bits of a signature.
SIGNATURE = 11
#: Members of a block that one task compares with those of another chunk.
CHUNK = 512
FANOUT = 16
#: Pairs of classes that a task holds before it hands them on.
PAIRS = 50_000
#: Distinct sets whose copies a task recognises at once.
SEEN = 200_000


def shingles(t: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words (A-Z in lower case); fewer words make one run."""
    words = t.encode("utf-8", "surrogatepass").lower().split()  # of ASCII, as bytes do
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(words)
    if len(words) < width:
        return windows(h, len(words)) ^ np.uint64(len(words))
    u = np.sort(windows(h, width))
    first = np.ones(len(u), dtype=bool)
    np.not_equal(u[1:], u[:-1], out=first[1:])
    return u[first]


def signature(u: np.ndarray) -> tuple[np.ndarray, int]:
    """A bitmap of the tokens, and how many tokens share a bit with another."""
    bits = np.zeros(1 << SIGNATURE, dtype=np.uint8)
    bits[(u >> np.uint64(64 - SIGNATURE)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64), len(u) - int(bits.sum())


def class_of(u: np.ndarray) -> int:
    """A 64-bit hash of a set and its size."""
    import xxhash

    return int(np.array(xxhash.xxh3_64_intdigest(u.tobytes()), dtype=np.uint64).astype(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _mark(tokens: DataFrame, value: str) -> np.ndarray | None:
    """A bitmap of 2**BITMAP bits of the low bits of ``value``; None if no row."""
    slot = F.col(value).bitwiseAND((1 << BITMAP) - 1)
    words = tokens.where(F.col(value).isNotNull()).groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({value} & 63 as int))")).alias("b"))
    got = words.toArrow()  # at most 2**(BITMAP - 6) rows of 12 bytes; as Row objects they take the driver 300 MB
    if not len(got):
        return None
    out = np.zeros(1 << (BITMAP - 6), dtype=np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def _marked(bitmap: np.ndarray, u: np.ndarray) -> np.ndarray:
    slot = u & np.uint64((1 << BITMAP) - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _prefixes(docs: DataFrame, width: int, percent: int, frequent: list[np.ndarray], once: bool) -> DataFrame:
    """doc_id, cls, n, prefix and signature of every document; ``once``: of each set once in a task."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def make():
        bitmaps, seen = shared.value, set()

        def work(part):
            out = {"doc_id": [], "cls": [], "n": [], "prefix": [], "bits": [], "excess": []}
            for doc, t in zip(part.column(0).to_pylist(), texts(part), strict=True):
                u = shingles(t, width)
                cls = class_of(u) if len(u) else None
                if once:
                    if cls is None or cls in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(cls)
                n = len(u)
                p = prefix_length(n, percent) if n else 0
                bits, excess = signature(u)
                if bitmaps and n:
                    rank = sum(_marked(b, u).astype(np.int8) for b in bitmaps)
                    u = u[np.argsort(rank, kind="stable")[:p]]
                out["doc_id"].append(doc)
                out["cls"].append(cls)
                out["n"].append(n)
                out["prefix"].append(u[:p].view(np.int64))
                out["bits"].append(bits)
                out["excess"].append(excess)
            return out

        return work

    return map_text(docs, "text", "doc_id long, cls long, n long, prefix array<long>, bits array<long>, excess long", make)


def _needed(docs: DataFrame, width: int, wanted: np.ndarray) -> DataFrame:
    """cls, n and set of documents whose doc_id is marked in ``wanted``."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def make():
        bitmap, seen = shared.value, set()

        def work(part):
            out = {"cls": [], "n": [], "tokens": []}
            near = _marked(bitmap, part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            for i in np.flatnonzero(near).tolist():
                u = shingles(part.column(1)[i].as_py() or "", width)
                if not len(u) or (cls := class_of(u)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(cls)
                out["cls"].append(cls)
                out["n"].append(len(u))
                out["tokens"].append(u.view(np.int64))
            return out

        return work

    return map_text(docs, "text", "cls long, n long, tokens array<long>", make)


class SignatureTree:
    """Levels of nodes over members sorted by size; level 0 holds the members."""

    def __init__(self, n: np.ndarray, label: np.ndarray, bits: np.ndarray):
        order = np.argsort(n, kind="stable")
        excess = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)  # tokens that share a bit
        self.order = order
        self.levels = [(bits[order], n[order], n[order], excess[order], label[order], np.ones(len(n), dtype=bool))]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, e, lab, one = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            one = np.logical_and.reduceat(one, at) & (np.minimum.reduceat(lab, at) == np.maximum.reduceat(lab, at))
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(e, at), np.minimum.reduceat(lab, at), one))


def dual_traversal(a: SignatureTree, b: SignatureTree, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Member pairs of two trees (or of one with itself) that may link and have different labels, and their largest possible overlap."""
    top = np.zeros(0, dtype=np.int64)
    same = a is b
    i, j = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    start = max(len(a.levels), len(b.levels)) - 1
    if start == 1:  # roots over leaves only: the leaves are as cheap
        i, j = np.divmod(np.arange(len(a.order) * len(b.order)), len(b.order))
        start = 0
    for level in range(start, -1, -1):
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        ab, alo, ahi, ae, al, ao = a.levels[la]
        bb, blo, bhi, be, bl, bo = b.levels[lb]
        stay = (100 * ahi[i] >= percent * blo[j]) & (100 * bhi[j] >= percent * alo[i]) & ~(ao[i] & bo[j] & (al[i] == bl[j]))
        if same and level == 0:
            stay &= i < j
        i, j = i[stay], j[stay]
        keep, bound = [], []
        for s in range(0, len(i), 1 << 14):
            x, y = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
            most = np.bitwise_count(ab[x] & bb[y]).sum(axis=1).astype(np.int64) + np.minimum(ae[x], be[y])
            # similarity >= t needs an overlap of t / (1 + t) of both sizes
            keep.append((100 + percent) * most >= percent * (alo[x] + blo[y]))
            bound.append(most)
        if keep:
            k = np.concatenate(keep)
            i, j, top = i[k], j[k], np.concatenate(bound)[k]
        if level:
            i, j = _expand(a, i, b, j, level)
            if same:
                up = i <= j
                i, j = i[up], j[up]
    return a.order[i], b.order[j], top[: len(i)]


def _children(t: SignatureTree, i: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First child and number of children of each node (itself, if its tree is lower)."""
    if level > len(t.levels) - 1:
        return i, np.ones(len(i), dtype=np.int64)
    first = i * FANOUT
    return first, np.minimum(len(t.levels[level - 1][1]), first + FANOUT) - first


def _expand(a: SignatureTree, i: np.ndarray, b: SignatureTree, j: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of node pairs."""
    (fa, na), (fb, nb) = _children(a, i, level), _children(b, j, level)
    n = na * nb
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(nb, n)
    return np.repeat(fa, n) + k // wide, np.repeat(fb, n) + k % wide


def _best(i: np.ndarray, j: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Of each member the pair of the largest bound: linear in the members."""
    order = np.argsort(-top, kind="stable")
    return np.unique(np.r_[order[np.unique(i[order], return_index=True)[1]], order[np.unique(j[order], return_index=True)[1]]])


def _tree_pairs(blocks: DataFrame, percent: int, full: bool) -> DataFrame:
    """h, u, v: pairs that may link, from rows (h, left: members, right: members or none).

    Unless ``full``, a block with many more pairs than members gives the best
    pair of each member only, and a row (h, null, null) that says so.
    """
    schema = pa.schema([("h", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for batch in batches:
            sides = []
            for column in batch.columns[1:]:
                members = column.flatten()
                n, label, cls = (members.field(k).to_numpy(zero_copy_only=False) for k in ("n", "label", "cls"))
                bits = members.field("bits").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(n), -1) if len(n) else np.zeros((0, 1), dtype=np.uint64)
                sides.append((np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))], n, label, cls, bits))
            (at, n, label, cls, bits), (at2, n2, label2, cls2, bits2) = sides
            held, waiting = [], 0
            for k, h in enumerate(batch.column(0).to_pylist()):
                x, y = slice(at[k], at[k + 1]), slice(at2[k], at2[k + 1])
                a = SignatureTree(n[x], label[x], bits[x])
                b, other = (SignatureTree(n2[y], label2[y], bits2[y]), cls2[y]) if y.stop > y.start else (a, cls[x])
                i, j, top = dual_traversal(a, b, percent)
                if not full and len(i) > 4 * (len(n[x]) + len(other)):
                    best = _best(i, j, top)
                    i, j = i[best], j[best]
                    held.append(pa.RecordBatch.from_arrays([pa.array([v], type=pa.int64()) for v in (h, None, None)], schema=schema))
                if len(i):
                    u, v = cls[x][i], other[j]
                    held.append(pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(i), h, dtype=np.int64), np.minimum(u, v), np.maximum(u, v))], schema=schema))
                    waiting += len(i)
                if waiting > PAIRS:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=PAIRS)
                    held, waiting = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=PAIRS)
            pa.default_memory_pool().release_unused()

    return blocks.mapInArrow(run, "h long, u long, v long")


def _possible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose signatures and sizes admit a link."""
    left = marks.select(F.col("cls").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("bu"), F.col("excess").alias("eu"))
    right = marks.select(F.col("cls").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv"), F.col("excess").alias("ev"))
    common = F.aggregate(F.zip_with("bu", "bv", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda a, x: a + x)
    sizes = (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    fits = (100 + percent) * (common + F.least("eu", "ev")) >= percent * (F.col("nu") + F.col("nv"))
    return pairs.join(right, "v").join(left, "u").where(sizes).where(fits).select("u", "v")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose sets link; only texts of these pairs are read as sets."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct().join(classes, "cls").select("rep")
    wanted = _mark(ids, "rep")
    if wanted is None:
        return pairs
    sets = scratch.write(_needed(docs, width, wanted), "sets")
    left = sets.select(F.col("cls").alias("u"), F.col("n").alias("nu"), F.col("tokens").alias("tu"))
    right = sets.select(F.col("cls").alias("v"), F.col("n").alias("nv"), F.col("tokens").alias("tv"))
    shared = F.size(F.array_intersect("tu", "tv")).cast("long")
    both = pairs.join(right, "v").join(left, "u").select("u", "v", "nu", "nv", shared.alias("o"))
    links = scratch.write(both.where(100 * F.col("o") >= percent * (F.col("nu") + F.col("nv") - F.col("o"))).select("u", "v").distinct(), "links")
    scratch.drop(sets)
    return links


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Components of the link "100 * intersection >= percent * union" of word n-gram sets.

    Returns doc_id, n_shingles and component_id (the smallest doc_id that links
    reach). Null and empty texts, and texts of white space, have an empty set
    and link with nothing. Texts of one set (copies, repeated rows) are one
    class and link. Rows of null doc_id get the component of a copy with an id,
    else null, and link nothing else. Other columns are ignored; an empty
    table gives an empty table.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    docs = pick(df, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))

    first = scratch.write(_prefixes(docs, width, percent, [], False), "prefixes")
    slim = scratch.write(first.select("doc_id", "cls", "n"), "documents")
    classes = scratch.write(slim.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep")), "classes")
    # Counts by 40 bits of the token: an order of tokens may be any, as long as it is one for all.
    low = F.explode("prefix").alias("h")
    counts = scratch.write(first.select(low).groupBy(F.col("h").bitwiseAND((1 << 40) - 1).alias("h")).agg(F.count("*").alias("k")).where(F.col("k") > FREQUENT[0]), "frequent")
    frequent = [b for k in FREQUENT if (b := _mark(counts.where(F.col("k") > k), "h")) is not None]
    if frequent:
        scratch.drop(first)
        first = scratch.write(_prefixes(docs, width, percent, frequent, True), "prefixes")

    # Tokens of two classes or more, first through a bitmap, then exactly.
    tokens = first.where("cls is not null").select("cls", "n", F.explode("prefix").alias("h"))
    active = scratch.write(tokens.groupBy("h").agg(F.min("cls").alias("leader"), F.max("cls").alias("last")).where("leader <> last").select("h", "leader"), "active")
    bitmap = _mark(active, "h")
    del counts, tokens
    scratch.release()
    if bitmap is None:
        return slim.join(classes, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("component_id"))
    likely = _filtered(first.where("cls is not null").select("cls", "n", "prefix"), bitmap)
    postings = likely.select("cls", "n", F.explode("prefix").alias("h")).join(active, "h").groupBy("h", "cls").agg(F.first("n").alias("n"), F.first("leader").alias("leader"))
    postings = scratch.write(postings, "postings")
    marks = first.select("cls", "n", "bits", "excess").join(postings.select("cls").distinct(), "cls").dropDuplicates(["cls"])
    marks = scratch.write(marks, "signatures")
    scratch.drop(first, active)

    star = postings.where("cls <> leader").select(F.col("leader").alias("u"), F.col("cls").alias("v")).distinct()
    links = _verified(scratch.write(_possible(star, marks, percent), "possible"), classes, docs, width, percent, scratch)
    labels = components(links, scratch)

    # A block whose pairs are all compared is done. One with very many gives the best pair of each
    # member first; when these merge no more labels, all pairs that still cross labels follow.
    known, rest, full = star, postings, False
    while True:
        named = rest.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").select("h", "cls", "n", F.coalesce("label", "cls").alias("label"))
        blocks = _mixed_blocks(scratch.write(named, "named"), marks, scratch)
        if blocks is None:
            break
        found = scratch.write(_tree_pairs(blocks, percent, full), "found", rows=8)  # a block may hold two chunks of signatures
        pairs = scratch.write(found.where("u is not null").select("u", "v").distinct().join(known, ["u", "v"], "left_anti"), "pairs")
        new = _verified(pairs, classes, docs, width, percent, scratch)
        merged = not new.isEmpty()
        if merged:
            links = links.unionByName(new)
            labels = components(links, scratch)
        cut = found.where("u is null").select("h").distinct()
        if cut.isEmpty():
            break
        rest = scratch.write(rest.join(cut, "h", "left_semi"), "rest")
        full = not merged
        known = known.unionByName(pairs)

    joined = labels.join(classes, labels.node == classes.cls)
    named = joined.groupBy("label").agg(F.min("rep").alias("component")).join(joined, "label").select("cls", "component")
    roots = scratch.write(classes.join(named, "cls", "left").select("cls", F.coalesce("component", "rep").alias("component")), "roots")
    return slim.join(roots, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _mixed_blocks(named: DataFrame, marks: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Rows (h, left, right) of members of blocks with several labels, in chunks or pairs of chunks; None if there is none."""
    mixed = named.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.min("cls").alias("least"), F.max("cls").alias("most")).where("a <> b")
    # Blocks of the same members are one.
    mixed = mixed.groupBy("size", "x", "least", "most").agg(F.min("h").alias("h")).select("h", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    mixed = scratch.write(mixed, "mixed")
    if mixed.isEmpty():
        return None
    inside = named.join(mixed, "h").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")).join(marks.select("cls", "bits"), "cls")
    member = F.struct("cls", "n", "label", "bits")
    # A chunk goes to each pair of chunks that it is part of.
    dealt = inside.select("h", "chunk", member.alias("m"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("other"))
    dealt = dealt.select("h", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), F.when(F.col("chunk") <= F.col("other"), F.col("m")).alias("l"), F.when(F.col("chunk") > F.col("other"), F.col("m")).alias("r"))
    blocks = dealt.groupBy("h", "i", "j").agg(F.collect_list("l").alias("left"), F.collect_list("r").alias("right"))
    return blocks.where("size(left) > 0 and (i = j or size(right) > 0)").select("h", "left", "right")


def _filtered(df: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Prefix tokens that are marked; rows without one go."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            flat, parent = lists.flatten(), pc.list_parent_indices(lists)
            hit = _marked(shared.value, flat.to_numpy(zero_copy_only=False).view(np.uint64))
            count = np.bincount(parent.to_numpy()[hit], minlength=batch.num_rows)
            rows = np.flatnonzero(count)
            offsets = np.r_[0, np.cumsum(count[rows])].astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), flat.filter(pa.array(hit)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), tokens], schema=schema)

    return df.mapInArrow(run, "cls long, n long, prefix array<long>")
