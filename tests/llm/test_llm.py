"""Corpus operators against brute force, round trips and odd rows."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import html_text, jaccard_join, langid, media, packing, pii, piece_bpe, quality, sharding, url_filter

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `key` string, label string"
ODD = [(1, None, None, None, None), (2, "", "", "", 0), (3, "   \n", "en", "s", 4), (4, "x" * 50_000, "en", "s", 50_000), (5, "word " * 3000, "en", "s", 15_000), (6, "the same", "en", "s", 8), (6, "the same", "en", "s", 8), (7, "1234 5678 9012 3456 ! @ . +1 2", "fr", None, 30)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, "k", "l") for r in ODD], COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_language(docs, odd, empty):
    model = langid.fit(docs)
    got = langid.identify(docs, model, "doc_id", F.col("text"), None, F.col("source")).toPandas()
    truth = docs.select("doc_id", "lang").toPandas().set_index("doc_id").lang
    assert (got.language == got.doc_id.map(truth)).mean() > 0.98  # text, host and prior only
    rest = langid.identify(odd, model, "doc_id", F.col("text"), F.col("lang"), F.col("source")).toPandas().set_index("doc_id")
    assert set(rest.language[[1, 2, 3]]) == {"und"} and not rest.kept[[1, 2, 3]].any()
    assert langid.identify(empty, model, "doc_id", F.col("text")).count() == 0
    assert langid.identify(odd, langid.fit(empty), "doc_id", F.col("text")).count() == len(ODD)


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("<p>one<p>two", "one\n\ntwo"),
        ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"),
        ("<table><tr><td>Name<td>Age<tr><td>Bo<td>3</table>", "Name  Age\nBo    3"),
        ("a<script>x</script><!-- y --><b hidden>z</b> b", "a b"),
        ("<div>a</div></p>b &amp; c<br>d", "a\nb & c\nd"),
        ("<pre>x\n  y</pre>", "x\n  y"),
        ("<div " * 2000, ""),
        ("<head><title>t</title><p>text", "text"),
        ("<html><head><meta charset=x>\n<style>s</style> words<head><b> more</b>", "words more"),
        ("<head><template><p>x</p></template><script>y</script></head>z", "z"),
        ("a <textarea>b &amp; c</textarea> <svg><title>t</title><defs>u</defs><text>d</text><text>e</text></svg>", "a b & c d e"),
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math> <select><option>one<option>two</select>", "x=2 one two"),
        ("", ""),
    ],
)
def test_render(markup, text):
    assert html_text.render(markup) == text


def test_render_deep():
    assert html_text.render("<div>" * 20_000 + "x") == "x"


def test_urls(spark):
    rules = (url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"))
    urls = [(1, "http://A.example.net/en/x?q"), (2, "http://a.net/"), (3, "http://anet/"), (4, None), (5, "no scheme"), (6, "http://x.org/casino/"), (7, "http://x.org/cheap-bets"), (8, "http://x.org/casinos"), (9, "http://b.net")]
    got = {r.page_id: tuple(r)[1:5] for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), url_filter.UrlPolicy(rules)).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == (None, "allow")
    assert got[4] == ("", "", None, "allow") and got[5][0] == ""
    assert got[6][3] == "block" and got[7][3] == "block" and got[8][3] == "allow" and got[9][2] is None


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in v) % 10 == 0


def base_spans(t):
    out = []
    for i, (k, p) in enumerate(KINDS.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"ip": lambda m=m: all(int(x) < 256 for x in m[0].split(".")), "card": lambda d=d: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}.get(k, lambda: True)
            if ok():
                out.append((m.start(), i, f"{k}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_personal_data(spark, odd, empty):
    rng = random.Random(5)
    made = ["".join(rng.choice(["a@b.c", "_d@e.f", ".", "1.2.3.4", ".5", "300", "+1 (234) 567-8901", "4111 1111 1111 1111", "-", " ", "é", "12", "𝄞", "\n"]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in pii.find_personal_data(df).collect():
        assert r.base_sha256 == hashlib.sha256(base_spans(made[r.doc_id]).encode()).hexdigest(), made[r.doc_id]
    assert pii.find_personal_data(odd).count() == len(ODD)
    assert pii.find_personal_data(empty).count() == 0


def test_patterns_find_identifiers(spark):
    seeds = [(i, f"please call support at +1 555 {1000000 + i * 7919} today") for i in range(30)]
    other = [(100, "please call support at EXT-55512-77 today"), (101, "there were 12345 apples in it")]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(seeds + other, "doc_id long, text string")).collect()}
    assert got[100] == "id:23:35" and got[101] == ""
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(seeds + other, "doc_id long, text string")).collect()}
    assert clean[100] == "please call support at <id> today" and clean[3] == "please call support at <phone> today" and clean[101] == other[1][1]


def test_pieces(docs, odd, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.PieceBpe(path)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  \n\t▁éßＡ🎉한.,(){}=<>/012Theand") for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["a" * 999, " " * 99, "<s>", "ab" * 400]
    for t in texts:
        ids = library.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids)
    source = {r.doc_id: r.text for r in docs.collect()}
    for r in piece_bpe.encode_documents(docs, path).collect():
        assert list(r.ids) == library.encode(source[r.doc_id]) and r.decoded == source[r.doc_id]
    assert piece_bpe.encode_documents(odd, path).count() == len(ODD) and piece_bpe.encode_documents(empty, path).count() == 0


def brute_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard(spark, odd, empty):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 12)):
            copy = [rng.choice(words) if rng.random() < 0.02 else x for x in text]
            rows.append((len(rows), " ".join(copy[: rng.randint(len(copy) // 2, len(copy))])))
    rows += [(900 + i, x) for i, x in enumerate([None, "", " \t", "One", "one", "One two", "a b c d e f", "A b c d e f"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert jaccard_join.jaccard_components(odd).count() == len(ODD) and jaccard_join.jaccard_components(empty).count() == 0


def test_bitmaps_reach_the_driver_as_arrays(spark):
    """Every word of a bitmap is set: 524,288 rows, which as Row objects take over 100 MB."""
    words = 1 << (jaccard_join.BITMAP - 6)
    tokens = spark.range(-words // 2, words // 2).selectExpr("case when id % 3 = 0 then null else id * 64 + pmod(id, 64) end as h")
    tracemalloc.start()
    try:
        got = jaccard_join._mark(tokens, "h")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    ids = np.arange(-words // 2, words // 2)
    true = np.where(ids % 3 == 0, np.uint64(0), np.uint64(1) << (ids % 64).astype(np.uint64))
    assert (got == np.roll(true, words // 2)).all()  # negative numbers end in the upper half
    assert peak < 50_000_000
    assert jaccard_join._mark(tokens.where("h is null"), "h") is None


def test_trees_prune_nothing_that_links():
    rng = np.random.RandomState(0)
    sets = [np.unique(rng.randint(0, 1 << 62, 200).astype(np.uint64)) for _ in range(40)]
    sets += [np.unique(np.r_[s[:190], rng.randint(0, 1 << 62, 10).astype(np.uint64)]) for s in sets]
    bits, excess = zip(*map(jaccard_join.signature, sets), strict=True)
    n = np.array([len(s) for s in sets])
    tree = jaccard_join.SignatureTree(n, np.arange(80), np.array(bits).view(np.uint64))
    i, j, _ = jaccard_join.dual_traversal(tree, tree, 75)
    found = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert {(k, k + 40) for k in range(40)} <= found and len(found) < 200


def test_copies(spark):
    rng = np.random.RandomState(1)
    pictures = [media.resize(rng.rand(12, 12) * 255, 96, 96) for _ in range(4)]
    rows = [(100 * k, media.encode_pgm(p)) for k, p in enumerate(pictures)]
    rows += [(1, media.encode_pgm(np.clip(pictures[1] * 0.8 + 30, 0, 255))), (2, media.encode_pgm(np.rot90(pictures[2]))), (3, rows[3][1]), (4, None), (5, b"no image"), (6, media.encode_pgm(np.zeros((40, 40))))]
    df = spark.createDataFrame([(i, bytearray(p) if p is not None else None) for i, p in rows], "id long, image binary")
    got = media.find_copies(df, F.col("image"), "id", F.col("id") % 100 == 0).collect()
    assert {(r.class_id, r.match_class) for r in got if r.kind == "match"} == {(100, 1), (200, 2)}
    members = {r.image_id: r.class_id for r in got if r.kind == "member"}
    assert members[300] == members[3] == 3 and len(members) == len(rows)
    assert media.find_copies(df.limit(0), F.col("image"), "id", F.col("id") % 100 == 0).count() == 0


def test_bands_meet_within_the_radius():
    rng = np.random.RandomState(6)
    a = rng.randint(0, 256, (300, 32)).astype(np.uint8)
    flips = np.array([np.packbits(np.isin(np.arange(256), rng.permutation(256)[:15])) for _ in a])
    i, j = media.HammingTables(a).within(a ^ flips)
    assert media.RADIUS == 15 and {(k, k) for k in range(300)} <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_long_words_equal_the_library():
    import random
    import string

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.PieceBpe(path), random.Random(3)
    blob = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=100_000))
    words = "".join(rng.choices(["the", "re", "information", "é", "数", "🙂", "\n", "==", "a"], k=20_000))
    for text in (blob, words, " " * 30_000, "ab " + " " * 5_000 + blob[:3_000], "a" * 50_001, "=" * 4_001 + " end", blob[: piece_bpe.LONG - 1], blob[: piece_bpe.LONG]):
        assert own.encode(text) == library.encode(text)


def test_pictures_show_every_number():
    long = list(range(100))
    assert media.picture_of(long) != media.picture_of([*long[:-1], 5]) and media.decode_image(media.picture_of(long)).shape == (80, 80)
    assert media.picture_of([]) is None and media.picture_of(None) is None


def test_likely_pairs_are_those_of_consensus():
    rng = np.random.RandomState(4)
    sides = [media.describe(media.decode_image(media.picture_of(rng.normal(size=64).tolist()))) for _ in range(60)]
    ours, theirs = sides[:30], sides[30:] + [(p + np.float32([2, 1, 0, 0]), b) for p, b in sides[:5]]
    bits = np.concatenate([b for _, b in ours])
    query, image = (np.repeat(np.arange(len(s)), [len(b) for _, b in s]) for s in (ours, theirs))
    i, j = media.HammingTables(bits).within(np.concatenate([b for _, b in theirs]))
    all_bits = np.concatenate([b for _, b in theirs])
    far = np.stack([np.bitwise_count(bits ^ x).sum(axis=1) for x in all_bits])
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*[x.tolist() for x in np.nonzero(far <= media.RADIUS)], strict=True))
    got = set(media.likely(image[i] * 30 + query[j], j, i, np.concatenate([p for p, _ in ours]), np.concatenate([p for p, _ in theirs]), 4, 30))
    want = {(c, q) for c in range(35) for q in range(30) if media.consensus(*ours[q], *theirs[c], media.RADIUS)[0] >= 4}
    assert {(30 + k, k) for k in range(5)} <= want <= got
    assert all(media.consensus(*ours[q], *theirs[c], media.RADIUS, least=4) == media.consensus(*ours[q], *theirs[c], media.RADIUS) for c, q in want)


def test_noisy_copies_and_small_crops(spark):
    rng = np.random.RandomState(2)
    vectors = [rng.normal(size=64).tolist() for _ in range(6)]
    grey = [media.decode_image(media.picture_of(v)) for v in vectors]
    assert grey[0].shape == (64, 64) and len(set(media.describe(grey[0])[0][:, 2].tolist())) == 3
    rows = [(100 * k, g) for k, g in enumerate(grey)]
    rows += [(1 + k, g + rng.normal(0, 4, g.shape)) for k, g in enumerate(grey[:3])] + [(4 + k, g[6:58, 8:60]) for k, g in enumerate(grey[3:])]
    df = spark.createDataFrame([(i, bytearray(media.encode_pgm(p))) for i, p in rows], "id long, image binary")
    got = media.find_copies(df, F.col("image"), "id", F.col("id") % 100 == 0).where("kind = 'match'").collect()
    assert {(r.class_id, r.match_class) for r in got} == {(100 * k, 1 + k) for k in range(6)}


def test_shards(docs, odd, empty):
    got = sharding.extendible_shards(docs, 50_000).toPandas()
    assert len(got) == docs.count()
    sums = got.groupby("shard_id").n_bytes.sum()
    assert (sums == got.groupby("shard_id").shard_bytes.first()).all()
    assert (sums[~got.groupby("shard_id").oversized.first()] <= 50_000).all() and len(sums) > 4
    small = sharding.extendible_shards(odd, 20_000, step=3).toPandas()
    assert len(small) == len(ODD) and small.oversized.sum() == 1
    assert sharding.extendible_shards(empty, 10).count() == 0


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer

    path, ranks = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    library = Tokenizer.from_file(path)
    for df in (docs, odd.limit(6)):
        source = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in df.collect()}
        got = packing.pack_documents(df, path, ranks_path=ranks).toPandas().sort_values(["sequence_id", "offset"])
        for _, s in got.groupby("sequence_id"):
            assert s.length.sum() <= 2048 and (s.offset == s.length.cumsum() - s.length).all()
        for doc, p in got.sort_values("start").groupby("doc_id"):
            assert (p.start == p.length.cumsum() - p.length).all() and p.length.sum() == len(source[doc])
            for r in p.itertuples():
                assert r.ids_crc32 == zlib.crc32(np.array(source[doc][r.start : r.start + r.length], dtype="<u4").tobytes())
        full = got.groupby("sequence_id").length.sum()
        assert (full < 2048).sum() <= df.rdd.getNumPartitions()
    assert packing.pack_documents(empty, path).count() == 0
    own = packing.ByteBpe(path, ranks)
    for t in ["<|endoftext|> a", "x  y \n z", "a\x1c\x85b", "é한🎉"]:
        assert own.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_quality(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r.doc_id: r for r in quality.quality_verdicts(spark, docs, labels).collect()}
    for d in docs.collect():
        w, r = re.findall(r"[^\x20\x09-\x0D]+", d.text), got[d.doc_id]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in d.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in d.text), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality_verdicts(spark, odd, labels.limit(0)).count() == len(ODD)
    assert quality.quality_verdicts(spark, empty, labels).count() == 0


def test_cutoffs_hold_their_risk():
    rng = np.random.RandomState(4)
    grid = len(quality.GRID["symbol_share"])
    wrong = 0
    for _ in range(200):  # every clean row exceeds each cutoff with exactly the forbidden share
        over = rng.binomial(2000, 0.02, size=grid).tolist()
        over = sorted(over, reverse=True)
        chosen = quality.certified_cutoffs({("en", "symbol_share"): (2000, over, [2000] * grid)}, 0.01, 0.05)
        wrong += chosen[("en", "symbol_share")] is not None
    assert wrong <= 10
    assert quality.binomial_cdf(2, 10, 0.3) == pytest.approx(0.3827827864)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    kept = spark.read.parquet(f"{DATA}/documents.parquet")
    n = kept.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, DATA).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert tuple(kept.columns) == corpus_pipeline.COLUMNS and 0.5 * n < kept.count() <= n
    rest = [(r.doc_id, r.text) for r in kept.collect()]
    assert all(base_spans(t) == "" for _, t in rest)
    pieces = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in pieces.collect()} == {i for i, _ in rest}
    assert pa.__version__


def test_pipeline_keeps_rows_of_null_and_repeated_ids(spark):
    import corpus_pipeline as cp

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select(*cp.COLUMNS).limit(80).collect()
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    odd = [(None if k % 2 else 7, *r[1:]) for k, r in enumerate(rows)]
    empty = [(i, "", "en", "s", 0) for i in (None, 7)]
    texts = lambda df: sorted(r.text for r in df.select("text").collect())
    assert texts(cp.language(spark, frame(odd + empty), DATA)) == texts(cp.language(spark, frame(rows), DATA))
    assert len(texts(cp.quality_rules(spark, frame(odd + empty), DATA))) > 40
    groups = {root for _, root in brute_components([(r.doc_id, r.text) for r in rows]).values()}
    assert len(texts(cp.near_duplicates(spark, frame(odd + odd), DATA))) == len(groups)
