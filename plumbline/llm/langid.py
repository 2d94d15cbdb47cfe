"""Language identification by Bayesian evidence fusion.

Text likelihoods (character trigrams of whole texts), the declared markup
language, the address suffix and a host prior add up in logarithms. Host
priors are hierarchically smoothed: counts of text-only decisions by host
shrink towards those of the suffix, and these towards all documents; the
counts come from one grouped aggregation over all rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import Scratch, map_text, texts

UNKNOWN = "und"
BUCKETS = 1 << 17
#: Languages that an address suffix makes likelier.
SUFFIX_LANGUAGES = {
    "at": "de", "de": "de", "ch": "de", "li": "de",
    "fr": "fr", "mc": "fr", "re": "fr",
    "ar": "es", "cl": "es", "co": "es", "es": "es", "mx": "es", "pe": "es", "uy": "es",
    "au": "en", "ca": "en", "ie": "en", "nz": "en", "uk": "en", "us": "en",
}
#: Trigrams whose likelihoods are looked up at once.
LOOKED_UP = 1 << 17
#: A host with more than this share of all rows is hot; there are fewer such hosts than its inverse.
HOT_SHARE = 1 / 1000
_NO_LETTER = re.compile(r"[\W\d_]+")


def trigrams(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of letters (lower case, words apart by a space) and counts by row."""
    clean = [f" {w} " if (w := _NO_LETTER.sub(" ", t.lower()).strip()) else "" for t in rows]
    n = np.array([max(0, len(c) - 2) for c in clean], dtype=np.int64)
    points = np.frombuffer("".join(c for c in clean if c).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return np.zeros(0, dtype=np.int64), n
    h = (points[:-2] * np.uint32(0x9E3779B1)) ^ (points[1:-1] * np.uint32(0x85EBCA6B)) ^ (points[2:] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h = ((h * np.uint32(0x27D4EB2F)) >> np.uint32(15)).astype(np.int64)
    stay = np.ones(len(h), dtype=bool)  # trigrams across two rows
    ends = np.cumsum([len(c) for c in clean if c])[:-1]
    stay[ends - 1] = stay[ends - 2] = False
    return h[stay], n


class TrigramModel:
    """Smoothed trigram log-likelihoods of languages, and how far below them text is no language."""

    def __init__(self, languages: list[str], rows: list[tuple[str, str]], margin: float = 1.0):
        self.languages = languages
        counts = np.full((len(languages), BUCKETS), 0.05)
        for k, lang in enumerate(languages):
            h, _ = trigrams([t for t, x in rows if x == lang])
            counts[k] += np.bincount(h, minlength=BUCKETS)
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)
        means, n = self.score([t for t, _ in rows])
        best = means.max(axis=1)[n > 0] if len(rows) and languages else np.zeros(0)
        self.floor = float(best.min() - margin) if len(best) else 0.0

    @classmethod
    def of(cls, languages: list[str], log: np.ndarray) -> TrigramModel:
        """A model of known likelihoods, to score with."""
        self = cls.__new__(cls)
        self.languages, self.log = languages, log
        return self

    def score(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood by row and language, and trigrams by row."""
        h, n = trigrams(rows)
        out = np.zeros((len(rows), len(self.languages)))
        if len(h):
            full = np.flatnonzero(n)
            first = np.r_[0, np.cumsum(n[full])[:-1]]
            for at in range(0, len(h), LOOKED_UP):  # long texts in parts of bounded memory
                part = h[at : at + LOOKED_UP]
                lo, hi = np.searchsorted(first, at, "right") - 1, np.searchsorted(first, at + len(part), "left")
                out[full[lo:hi]] += np.add.reduceat(self.log[part], np.maximum(first[lo:hi] - at, 0), axis=0, dtype=np.float64)
            out[full] /= n[full, None]
        return out, n


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 300, most_languages: int = 64, chars: int = 4000) -> TrigramModel:
    """Fit on a bounded sample: ``per_language`` labelled rows (in the order of a hash of text)
    of the ``most_languages`` commonest languages, ``chars`` characters of each.

    Languages beyond these are never answered: their texts are 'und' or get the
    nearest known language. Null texts and null or empty languages are left out;
    repeated texts count once; other columns are ignored; an empty table gives a
    model without languages.
    """
    rows = labelled.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).where("t is not null and l is not null and l <> ''").withColumn("h", F.xxhash64("t"))
    scratch = Scratch(labelled.sparkSession)
    hashes = scratch.write(rows.groupBy("l", "h").count(), "hashes")
    counted = hashes.groupBy("l").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "l").limit(most_languages).collect()
    # The least hashes of each language, then the texts behind them: no task sends texts that lose.
    chosen = {r[0]: [x[0] for x in hashes.where(F.col("l") == r[0]).orderBy("h").limit(per_language).select("h").collect()] for r in counted}
    if not chosen:
        return TrigramModel([], [])
    low = F.lit(False)
    for x, h in chosen.items():
        low = low | ((F.col("l") == x) & (F.col("h") <= h[-1]))
    sample = rows.where(low).groupBy("l", "h").agg(F.min(F.substring("t", 1, chars)).alias("t")).collect()
    scratch.drop(hashes)
    return TrigramModel(sorted(chosen), sorted((r["t"], r["l"]) for r in sample))


def identify(
    df: DataFrame,
    model: TrigramModel,
    row_id: str,
    text: F.Column,
    declared: F.Column | None = None,
    host: F.Column | None = None,
    suffix: F.Column | None = None,
    read=None,
    declared_trust: float = 0.9,
    suffix_trust: float = 0.6,
    strength: float = 20.0,
    evidence: int = 60,
) -> DataFrame:
    """Language of every row, from its whole text and what surrounds it.

    Returns row_id, language ('und' if none), confidence (posterior), kept
    (a language is found), text_language, declared, host and n_trigrams.
    ``declared`` may be a tag like 'en-GB'; null or unknown evidence says
    nothing. ``evidence`` bounds the weight of a text, whose trigrams depend on
    each other. A row without a letter (null and empty text too) is 'und'.
    ``read`` turns a text (such as markup) into plain text first. Equal
    posteriors resolve to the first language in order of name; rows repeat as
    they come; an empty table, or a model without languages, is no error.
    """
    spark, languages = df.sparkSession, model.languages
    none = F.lit(None).cast("string")
    tag = F.lower(F.regexp_extract(F.coalesce(declared if declared is not None else none, F.lit("")).cast("string"), r"^\s*([A-Za-z]{2,3})", 1))
    base = df.select(
        F.col(f"`{row_id}`").cast("long").alias("row_id"),
        text.alias("text"),
        tag.alias("declared"),
        F.coalesce(host if host is not None else none, F.lit("")).alias("host"),
        F.coalesce(suffix if suffix is not None else none, F.lit("")).alias("suffix"),
    )
    # Plain arrays, as classes in a broadcast would have to be installed there: BUCKETS x languages floats, at most 64.
    shared = spark.sparkContext.broadcast((languages, model.log))

    def make():
        m = TrigramModel.of(*shared.value)

        def work(part):
            rows = texts(part)
            means, n = m.score([read(t) for t in rows] if read else rows)
            return {"row_id": part.column(0), "declared": part.column(2), "host": part.column(3), "suffix": part.column(4), "n_trigrams": n, "means": list(means)}

        return work

    if not languages:
        return base.select(F.col("row_id").alias(row_id), F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"), F.lit(UNKNOWN).alias("text_language"), "declared", "host", F.lit(0).cast("long").alias("n_trigrams"))
    scores = map_text(base, "text", "row_id long, declared string, host string, suffix string, n_trigrams long, means array<double>", make)
    names = F.array(*[F.lit(x) for x in languages])
    best = F.element_at(names, F.array_position("means", F.array_max("means")).cast("int"))
    text_language = F.when((F.col("n_trigrams") > 0) & (F.array_max("means") >= model.floor), best).otherwise(UNKNOWN)
    scratch = Scratch(spark)
    scores = scratch.write(scores.withColumn("text_language", text_language), "scores")

    # Text-only decisions by host, by suffix and over all: one pass, a row for each host.
    each = [F.count(F.when(F.col("text_language") == x, 1)).alias(f"n{k}") for k, x in enumerate(languages)]
    hosts = scratch.write(scores.groupBy("suffix", "host").agg(F.count("*").alias("rows"), *each), "hosts")
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"n{k}").alias(f"s{k}") for k in range(len(languages))])
    totals = [int(v or 0) for v in suffixes.agg(*[F.sum(f"s{k}") for k in range(len(languages))]).first()]
    rows = int(hosts.agg(F.sum("rows")).first()[0] or 0)
    share = [(v + 1) / (sum(totals) + len(languages)) for v in totals]
    up = sum((F.col(f"s{k}") for k in range(len(languages))), F.lit(0))
    own = sum((F.col(f"n{k}") for k in range(len(languages))), F.lit(0))
    by_suffix = [(F.col(f"s{k}") + strength * share[k]) / (up + strength) for k in range(len(languages))]
    priors = hosts.join(suffixes, "suffix").select("suffix", "host", (F.col("rows") > rows * HOT_SHARE).alias("hot"), F.array(*[F.log((F.col(f"n{k}") + strength * by_suffix[k]) / (own + strength)) for k in range(len(languages))]).alias("prior"))

    # One number for each language; the last is that of no language at all.
    weight = F.least(F.col("n_trigrams"), F.lit(evidence))
    odd = (1 - declared_trust) / max(1, len(languages) - 1)
    posts = []
    for k, x in enumerate(languages):
        said = F.when(~F.col("declared").isin(languages), 0.0).when(F.col("declared") == x, float(np.log(declared_trust))).otherwise(float(np.log(odd or 1e-9)))
        near = [s for s, v in SUFFIX_LANGUAGES.items() if v == x]
        known = [s for s, v in SUFFIX_LANGUAGES.items() if v in languages]
        hint = F.when(~F.col("suffix").isin(known), 0.0).when(F.col("suffix").isin(near), float(np.log(suffix_trust))).otherwise(float(np.log((1 - suffix_trust) / max(1, len(languages) - 1) or 1e-9)))
        posts.append(F.col("means")[k] * weight + F.col("prior")[k] + said + hint)
    posts.append(F.lit(model.floor) * weight + float(np.log(0.001)))
    # Priors of hot hosts, fewer than 1 / HOT_SHARE, go to the rows; only rows of other hosts meet theirs by shuffle.
    priors = scratch.write(priors, "priors")
    hot, cold = (priors.where(F.col("hot") == x).drop("hot") for x in (True, False))
    near = scores.join(F.broadcast(hot), ["suffix", "host"], "left")
    mixed = near.where("prior is not null").unionByName(near.where("prior is null").drop("prior").join(cold, ["suffix", "host"]))
    out = mixed.withColumn("post", F.array(*posts))
    out = out.withColumn("top", F.array_max("post"))
    total = F.aggregate("post", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    names = F.array(*[F.lit(x) for x in [*languages, UNKNOWN]])
    language = F.when(F.col("n_trigrams") > 0, F.element_at(names, F.array_position("post", F.col("top")).cast("int"))).otherwise(UNKNOWN)
    out = out.withColumn("language", language)
    return out.select(F.col("row_id").alias(row_id), "language", F.when(F.col("n_trigrams") > 0, 1 / total).otherwise(0.0).alias("confidence"), (F.col("language") != UNKNOWN).alias("kept"), "text_language", "declared", "host", "n_trigrams")
