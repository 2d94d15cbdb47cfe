"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose feature exceeds a cutoff. Cutoffs are
chosen on labelled rows, for each stratum: a cutoff is certified if an exact
binomial test rejects "more than alpha of the clean documents exceed it".
Cutoffs of one stratum and rule are tested in a fixed sequence, the highest
first, until one fails; the level is divided by the number of sequences
(Bonferroni), so that all certificates together err with probability delta
at most. Of the certified cutoffs the one with the largest surplus of bad
over clean labelled rows above it is used, the highest on ties; without a
surplus, or without a certificate, the rule rejects nothing in that stratum.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import Scratch, map_text, pick, texts

SYMBOLS = "#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SPACES = " \t\n\x0b\x0c\r"

#: Features that rules bound from above, as SQL over the base columns.
FEATURES = {
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bang_share": "n_bang / greatest(n_words, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "echo_share": "n_echo / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}
#: Cutoffs that are tested, for each feature.
GRID = {
    "symbol_share": [round(0.02 * i, 2) for i in range(1, 51)],
    "upper_share": [round(0.02 * i, 2) for i in range(1, 51)],
    "bang_share": [round(0.02 * i, 2) for i in range(1, 51)],
    "duplicate_line_share": [round(0.02 * i, 2) for i in range(1, 50)],
    "repeat_word_share": [round(0.02 * i, 2) for i in range(1, 50)],
    "echo_share": [round(0.02 * i, 2) for i in range(1, 50)],
    "word_length": [5.0 + 0.25 * i for i in range(100)],
}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype="<u8")


#: Odd multipliers, one for each place of a window.
_PLACES = [(0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) for i in range(1, 65)]


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words; len(h) >= width, width at most 64."""
    n = len(h) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        part = h[i : i + n] ^ (h[i : i + n] >> np.uint64(32))
        out += part * np.uint64(_PLACES[i])
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def repeated_words(h: np.ndarray, width: int = 5) -> int:
    """Words that lie in some run of ``width`` words found twice or more."""
    if len(h) <= width:
        return 0
    w = windows(h, width)
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(w), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edges = np.zeros(len(h) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(t: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_bang, n_echo.

    n_echo counts words equal to the word before them.
    """
    raw = t.encode("utf-8", "surrogatepass")
    words = raw.split()  # on the six ASCII white-space characters, as bytes do
    lines = [x for x in t.split("\n") if x.strip(_SPACES)]
    upper = sum(raw.count(bytes([c])) for c in range(65, 91))
    return (
        len(words),
        len(t) - sum(map(t.count, _SPACES)),
        sum(map(t.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(word_hashes(words)) if len(words) > 5 else 0,
        len(lines),
        upper,
        t.count("!"),
        sum(map(eq, words, words[1:])),
    )


def text_features(df: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Base counts of every whole text (null: none), with the row's stratum (null: '')."""

    def make():
        def work(part):
            rows = [measure(t) for t in texts(part)]
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bang", "n_echo")
            return {"doc_id": part.column(0), "stratum": part.column(2)} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return work

    picked = pick(df, doc_id=doc_id, text=text, stratum=stratum).withColumn("stratum", F.coalesce(F.col("stratum").cast("string"), F.lit("")))
    return map_text(picked, "text", f"doc_id long, stratum string, {BASE}, n_lines long, n_upper long, n_bang long, n_echo long", make)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed in logarithms."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    i = np.arange(k + 1)
    lg = np.array([math.lgamma(x + 1) for x in range(k + 1)])
    rest = np.array([math.lgamma(n - x + 1) for x in range(k + 1)])
    logs = math.lgamma(n + 1) - lg - rest + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def certified_cutoffs(counts: dict[tuple[str, str], tuple[int, list[int], list[int]]], alpha: float, delta: float) -> dict[tuple[str, str], float | None]:
    """For each (stratum, feature): clean rows, and clean and bad rows above each cutoff of the grid.

    The family-wise error of all certificates together is at most ``delta``.
    """
    chosen: dict[tuple[str, str], float | None] = {}
    for key, (n, clean, bad) in counts.items():
        best, chosen[key] = 0, None
        for cutoff, k, won in reversed(list(zip(GRID[key[1]], clean, bad, strict=True))):
            if not n or k > alpha * n or binomial_cdf(k, n, alpha) > delta / len(counts):
                break
            if won - k > best:
                best, chosen[key] = won - k, cutoff
    return chosen


def quality_verdicts(
    spark: SparkSession,
    df: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    good: str = "quality",
    alpha: float = 0.05,
    delta: float = 0.05,
    min_words: int = 10,
    repeat_percent: int = 20,
) -> DataFrame:
    """Judge every document by base rules and certified cutoffs.

    Returns doc_id, the base counts, base_failed, kept and cutoff_failed (the
    first rule whose cutoff is exceeded, else null). The clean rows of a stratum
    are all labelled ones (``good`` = 1) that pass the base rules; those of null
    label don't count; a row labelled twice counts as bad if any label is 0.
    ``alpha`` bounds the share of clean documents that one
    stratum's cutoffs reject, shared equally by the rules; with probability
    1 - ``delta`` all bounds hold. Null or empty texts have no word and fail.
    Repeated rows are judged each and count each; without labels only the base
    rules reject. The text is read once; labels meet counts, not texts.
    """
    scratch = Scratch(spark)
    feats = text_features(df, doc_id, text, stratum)
    feats = scratch.write(feats, "features")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    feats = feats.withColumn("base_failed", failed)
    for name, sql in FEATURES.items():
        feats = feats.withColumn(name, F.expr(sql))

    marks = labels.where(F.col(f"`{good}`").isin(0, 1)).groupBy(F.col("`doc_id`").cast("long").alias("doc_id")).agg(F.min(f"`{good}`").alias("good"))
    held = feats.where(~F.col("base_failed")).join(marks, "doc_id")
    # Features fall into bins between cutoffs; a few counts for each stratum reach the driver.
    bins = [F.struct(F.lit(name).alias("feature"), _bin(F.col(name), GRID[name]).alias("bin")) for name in FEATURES]
    table = held.select("stratum", "good", F.explode(F.array(*bins)).alias("x")).groupBy("stratum", "x.feature", "x.bin", "good").agg(F.count("*").alias("n"))
    strata: dict[tuple[str, str], np.ndarray] = {}
    for s, name, b, g, n in table.collect():
        strata.setdefault((s, name), np.zeros((2, len(GRID[name]) + 1), dtype=np.int64))[int(g), b] += n
    above = {key: np.cumsum(x[:, ::-1], axis=1)[:, ::-1] for key, x in strata.items()}
    cutoffs = certified_cutoffs({key: (int(x[1, 0]), x[1, 1:].tolist(), x[0, 1:].tolist()) for key, x in above.items()}, alpha / len(FEATURES), delta)

    reason = F.lit(None).cast("string")
    for (s, name), c in sorted(cutoffs.items()):
        if c is not None:
            reason = F.coalesce(reason, F.when((F.col("stratum") == s) & (F.col(name) > c), F.lit(name)))
    out = feats.withColumn("cutoff_failed", reason)
    base = [x.split()[0] for x in BASE.split(", ")]
    return out.select("doc_id", *base, "base_failed", (~F.col("base_failed") & F.col("cutoff_failed").isNull()).alias("kept"), "cutoff_failed")


def _bin(value: F.Column, cutoffs: list[float]) -> F.Column:
    """How many cutoffs the value exceeds (they ascend)."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cutoffs]), lambda c: value > c))
