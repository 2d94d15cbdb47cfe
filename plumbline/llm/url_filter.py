"""URL verdicts from host and path rules and a weighted vocabulary.

The vocabulary is matched by one Aho-Corasick automaton over the lower-cased
url. A hit counts only between characters that are no letters or digits. One
strict term rejects a url, as do several distinct soft terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import map_text, pick

#: Terms of which one rejects a url.
STRICT = ("casino", "cheap-pills", "free-bets", "porn", "spam-farm", "viagra", "xxx")
#: Terms of which several distinct ones reject a url.
SOFT = ("ads", "adult", "bet", "bets", "bonus", "cheap", "click", "deal", "free", "jackpot", "loan", "pills", "poker", "prize", "promo", "spam", "track", "win")


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with its subdomains below a path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlPolicy:
    rules: tuple[Rule, ...] = ()
    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    soft_hits: int = 2  # distinct soft terms that reject


class Vocabulary:
    """Distinct strict and soft terms of a url, by one pass of an automaton."""

    def __init__(self, strict: tuple[str, ...], soft: tuple[str, ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for terms, kind in ((soft, "soft"), (strict, "strict")):
            for t in terms:
                self.automaton.add_word(t.lower(), (kind, t.lower()))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        found: dict[str, set[str]] = {"strict": set(), "soft": set()}
        if len(self.automaton):
            low = url.lower()
            for end, (kind, term) in self.automaton.iter(low):
                start = end - len(term) + 1
                if (start == 0 or not low[start - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
                    found[kind].add(term)
        return found["strict"], found["soft"]


def judge_urls(df: DataFrame, policy: UrlPolicy, row_id: str = "page_id", url: str = "url") -> DataFrame:
    """Judge every url, without a shuffle.

    Returns page_id, host, path, rule (null if none fits), verdict ('allow' or
    'block'), strict_hits and soft_hits (distinct terms). Host and path are
    empty for a null url or one without '://'; the vocabulary still reads it
    (null: no hit, allowed). Repeated rows are judged each, other columns are
    ignored, an empty table gives an empty table.
    """

    u = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(u, "://")
    after = F.when(at > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)

    def make():
        vocabulary = Vocabulary(policy.strict, policy.soft)

        def work(part):
            strict, soft = [], []
            for t in part.column(1).to_pylist():
                a, b = vocabulary.hits(t or "")
                strict.append(len(a))
                soft.append(len(b))
            return {"page_id": part.column(0), "url": part.column(1), "strict_hits": strict, "soft_hits": soft}

        return work

    counted = map_text(pick(df, page_id=row_id, url=url).withColumn("page_id", F.col("page_id").cast("long")), "url", "page_id long, url string, strict_hits int, soft_hits int", make)
    out = counted.select("page_id", host.alias("host"), path.alias("path"), "strict_hits", "soft_hits")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(policy.rules, key=lambda r: len(r.name)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, F.lit(r.name)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    bad = (F.col("strict_hits") > 0) | (F.col("soft_hits") >= policy.soft_hits)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"), "strict_hits", "soft_hits")
