"""Personal data by fixed grammars and bootstrapped contexts, in DataFrame operations only.

Fixed grammars find e-mail and IP addresses, card and phone numbers; they are
the seeds. The two words before a seed make a lexical pattern. Patterns and
the tokens that follow them form a graph: a pattern is as credible as the
share of its tokens that are credible, a token as its best pattern. Tokens
behind credible patterns count as support of other patterns, in rounds, until
no pattern is added. Tokens with digits that follow a credible pattern are
identifiers that no grammar knows.

Positions come from one regular expression that captures the gap before each
match: starts are running sums of gap and match lengths (code points), taken
in chunks of the square root of their number, so that long lists of matches
are not copied at every step. The anchor to the last match's end and
possessive quantifiers keep matching linear and free of recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm._common import Scratch, pick

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
#: What each kind's matches look like; starts within an earlier run are excluded by looking behind.
GRAMMAR = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that may be identifiers, or in which an address begins; equals signs and colons end them.
TOKEN = r"(?<![^\s=:])[^\s=:]*[0-9@][^\s=:]*+"
_WORD, _APART = r"[\p{L}\p{N}]++", r"[^\p{L}\p{N}]"
#: The last two words of a text and what follows them.
LAST_WORDS = rf"(?<![\p{{L}}\p{{N}}]){_WORD}{_APART}++{_WORD}{_APART}*+$"


def _pairs(text: Column, grammar: str, ask: Column) -> Column:
    """array<struct<gap, hit>> of all matches and the text before each, where ``ask`` holds."""
    parts = [F.regexp_extract_all(text, F.lit(rf"(?s)\G(.*?)({grammar})"), F.lit(i)).alias(name) for i, name in ((1, "gap"), (2, "hit"))]
    return F.when(ask, F.arrays_zip(*parts)).otherwise(F.array().cast("array<struct<gap:string,hit:string>>"))


def _with_left(pairs: Column) -> Column:
    """The pairs and ``left``: the last two words before each match, in lower case, each with a space behind it.

    Where the gap holds fewer, the words of the two matches before it (which have some) and of what is between count.
    """

    def before(i: Column, field: str, back: int) -> Column:
        return F.coalesce(F.when(i >= back, F.get(pairs, i - back)[field]), F.lit(""))

    def words(text: Column) -> Column:
        return F.regexp_extract(text, LAST_WORDS, 0)

    def one(x: Column, i: Column) -> Column:
        near = F.concat(before(i, "hit", 1), x["gap"])
        far = F.concat(before(i, "hit", 2), before(i, "gap", 1), near)
        left = F.coalesce(F.nullif(words(x["gap"]), F.lit("")), words(far))
        return F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), F.regexp_replace(F.lower(left), rf"{_APART}+", " ").alias("left"))

    return F.transform(pairs, one)


def _placed(pairs: Column, *carried: str) -> Column:
    """array<struct<s, e, hit, ...>>: pairs with the places of their matches, gaps left out."""
    more = "".join(f",{c}:string" for c in carried)
    empty = F.array().cast(f"array<struct<s:int,e:int,hit:string{more}>>")
    size = F.size(pairs)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(size)).cast("int"))
    firsts = F.when(size > 0, F.sequence(F.lit(1), size, width)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), *[x[c].alias(c) for c in ("hit", *carried)]))).alias("out"))

    def chunk(done: Column, first: Column) -> Column:
        start = F.struct(F.element_at(done, -1)["at"].alias("at"), empty.alias("out"))
        return F.concat(done, F.array(F.aggregate(F.slice(pairs, first, width), start, step)))

    start = F.array(F.struct(F.lit(0).alias("at"), empty.alias("out")))
    return F.aggregate(firsts, start, chunk, lambda done: F.flatten(F.transform(done, lambda c: c["out"])))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.split(F.reverse(digits), "(?!^)(?!$)")
    value = F.transform(backwards, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    d = _digits(x["hit"])
    if kind == "ip":
        return x["hit"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(d).between(12, 19) & _luhn(d)
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


def _base(kind: str) -> Column:
    """Valid matches of a kind; those that fail are dropped, without another try."""
    i = KINDS.index(kind)
    return F.transform(F.filter(kind, lambda x: _valid(kind, x)), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), F.lit(kind).alias("kind"), x["e"].alias("e"), F.xxhash64(x["hit"]).alias("v")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    """kind:start:end of spans by start and kind, joined by commas."""
    text = F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"]))
    return F.array_join(text, ",")


def redact(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The frame with every span of its texts replaced by ``<kind>``; overlapping spans go together.

    n_chars, where the frame has it, is counted anew. Texts without a span and
    null texts stay; all columns stay, whatever their names. Rows are matched by
    id and text, so that rows of one id keep their own texts and repeated rows
    all stay; an empty table gives an empty table.
    """
    own = "_span"
    while any(c.lower().startswith(own) for c in df.columns):
        own = f"_{own}"
    id_, key, here, found = f"{own}_id", f"{own}_key", f"{own}_here", f"{own}_found"
    spans = _spans(df, doc_id, text, **options).select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.array_sort("all").alias(found))
    spans = spans.where(F.size(found) > 0).dropDuplicates([id_, key])
    t = F.col(f"`{text}`")
    at = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(t, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        mark = F.when(x["s"] >= acc["at"], F.concat(gap, F.lit("<"), x["kind"], F.lit(">"))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], mark).alias("out"))

    clean = F.aggregate(found, at, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    # Only rows with a span meet the other side; the join moves ids, the text stays on its side.
    out = df.withColumn(here, F.xxhash64(t)).join(spans, F.col(f"`{doc_id}`").eqNullSafe(F.col(id_)) & (F.col(here) == F.col(key)), "left")
    out = out.withColumn(text, F.when(F.col(found).isNotNull(), clean).otherwise(t))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(F.col(found).isNotNull(), F.length(t).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def find_personal_data(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_seeds: int = 5, min_score: float = 0.75, min_digits: int = 4) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base
    spans), spans (base and discovered ones, the latter of kind 'id') and
    n_found (discovered). Offsets are code points, ends are exclusive. A pattern
    is believed with ``min_seeds`` distinct seeds or credible tokens and a score
    of ``min_score``; a token with fewer than ``min_digits`` digits is no
    identifier, and marks at its ends are no part of it. Null text counts as
    empty; repeated rows are all answered; other columns are ignored; an empty
    table gives an empty table.
    """
    out = _spans(df, doc_id, text, min_seeds, min_score, min_digits)
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_found"))


def _occurrences(docs: DataFrame, min_digits: int) -> DataFrame:
    """rid, s, e, token, seed, pattern: base spans and tokens outside them, each behind two words."""
    base = F.transform("base", lambda b: F.struct(b["s"].alias("s"), F.lit(1).alias("order"), b["e"].alias("e"), b["v"].alias("v"), F.lit(None).cast("string").alias("hit"), F.lit(None).cast("string").alias("left")))
    tokens = F.transform("tokens", lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("order"), x["e"].alias("e"), F.lit(None).cast("long").alias("v"), x["hit"].alias("hit"), x["left"].alias("left")))
    rows = docs.select("rid", F.explode(F.concat(base, tokens)).alias("x")).select("rid", "x.*")
    is_base = F.col("order") == 1
    so_far = W.partitionBy("rid").orderBy("s", "order").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("reach", F.coalesce(F.max(F.when(is_base, F.col("e"))).over(so_far), F.lit(0)))
    rows = rows.withColumn("in", F.last(F.when(~is_base, F.struct("s", "e", "hit", "left")), True).over(so_far))
    within = is_base & (F.col("s") < F.col("in.e"))
    rows = rows.withColumn("seeded", F.max(within).over(W.partitionBy("rid", "in.s")))
    # A base span may begin inside its token: what stands before it there belongs to its context.
    prefix = F.when(is_base, F.expr("substring(in.hit, 1, s - in.s)")).otherwise("")
    words = F.filter(F.split(F.lower(F.concat("in.left", prefix)), rf"{_APART}+"), lambda w: w != "")
    pattern = F.when(F.size(words) >= 2, F.array_join(F.slice(words, -2, 2), " "))
    lead = F.length(F.regexp_extract("hit", rf"^{_APART}++", 0))
    trail = F.length(F.regexp_extract("hit", rf"(?<!{_APART}){_APART}++$", 0))
    value = F.expr("substring(hit, lead + 1, length(hit) - lead - trail)")
    rows = rows.where(within | (~is_base & ~F.col("seeded") & (F.col("reach") <= F.col("s")) & (F.length(_digits(F.col("hit"))) >= min_digits)))
    rows = rows.select("*", pattern.alias("pattern"), F.when(is_base, 0).otherwise(lead).alias("lead"), F.when(is_base, 0).otherwise(trail).alias("trail")).where("pattern is not null")
    return rows.select("rid", (F.col("s") + F.col("lead")).alias("s"), (F.col("e") - F.col("trail")).alias("e"), F.when(is_base, F.col("v")).otherwise(F.xxhash64(F.lower(value))).alias("token"), is_base.alias("seed"), "pattern")


def _believed(scratch: Scratch, seen: DataFrame, min_seeds: int, min_score: float) -> DataFrame | None:
    """The credible patterns, or None if there are none. Rounds end when none is added: scores only rise."""
    edges = seen.groupBy("pattern", "token").agg(F.max("seed").cast("double").alias("seed"))
    # Patterns with fewer tokens than any credible one needs can be left out.
    large = edges.groupBy("pattern").count().where(F.col("count") >= min_seeds).select("pattern")
    edges = scratch.write(edges.join(large, "pattern"), "edges")
    scores, known = edges.groupBy("token").agg(F.max("seed").alias("score")), 0
    while True:
        rated = edges.join(scores, "token").groupBy("pattern")
        rated = rated.agg((F.sum("score") / (F.count("*") + 1)).alias("belief"), F.count_if(F.col("score") >= min_score).alias("support"))
        patterns = scratch.write(rated.where((F.col("support") >= min_seeds) & (F.col("belief") >= min_score)).select("pattern", "belief"), "patterns")
        now = patterns.count()
        if now == known:
            return patterns.select("pattern") if now else None
        known = now
        scores = edges.join(patterns, "pattern", "left").groupBy("token").agg(F.max(F.greatest("seed", F.coalesce("belief", F.lit(0.0)))).alias("score"))


def _spans(df: DataFrame, doc_id: str, text: str, min_seeds: int = 5, min_score: float = 0.75, min_digits: int = 4) -> DataFrame:
    """doc_id, key (a hash of the text), base and all spans of every row."""
    scratch = Scratch(df.sparkSession)
    t = F.coalesce(F.col("text"), F.lit(""))
    number = t.rlike("[0-9]")
    ask = {"email": t.contains("@") & t.contains("."), "ip": number & t.rlike(r"[0-9]\.[0-9]"), "card": number & t.rlike(r"(?:[0-9][\x20-]?){12}"), "phone": t.contains("+") & number}
    docs = pick(df, doc_id=doc_id, text=text)
    docs = docs.select("doc_id", F.xxhash64("text").alias("key"), *[_pairs(t, GRAMMAR[k], ask[k]).alias(k) for k in KINDS], _pairs(t, TOKEN, number | t.contains("@")).alias("tokens"))
    docs = docs.select("doc_id", "key", *KINDS, _with_left(F.col("tokens")).alias("tokens"))
    docs = docs.select("doc_id", "key", *[_placed(F.col(k)).alias(k) for k in KINDS], _placed(F.col("tokens"), "left").alias("tokens"))
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "key", F.concat(*map(_base, KINDS)).alias("base"), "tokens")
    docs = scratch.write(docs, "spans")
    seen = scratch.write(_occurrences(docs, min_digits), "tokens")
    docs = docs.drop("tokens")
    believed = _believed(scratch, seen, min_seeds, min_score)
    if believed is None:
        return docs.select("doc_id", "key", "base", F.col("base").alias("all"))
    found = seen.where(~F.col("seed")).join(believed, "pattern").groupBy("rid")
    found = found.agg(F.collect_set(F.struct("s", F.lit(len(KINDS)).alias("i"), F.lit("id").alias("kind"), "e", F.lit(0).cast("long").alias("v"))).alias("more"))
    more = F.coalesce("more", F.array().cast("array<struct<s:int,i:int,kind:string,e:int,v:bigint>>"))
    return docs.join(found, "rid", "left").select("doc_id", "key", "base", F.concat("base", more).alias("all"))
