"""Fusion of evidence against a brute-force posterior; long texts, hot hosts, executors without the package."""

import math
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from plumbline.llm import langid

ROOT = Path(__file__).parents[2]


def test_posterior_by_loops(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    suffixes, declared = ["de", "fr", "uk", "", "zz", None], ["de-AT", "fr", "xx", None, "", "EN"]
    rows = [(i, (t or "")[: 20 + i % 90], declared[i % 6], f"h{i % 40}" if i % 3 else "hot", suffixes[i % 5]) for i, t in enumerate(texts)]
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(["", None, "12 34", "ab", "word " * 60_000])]
    df = spark.createDataFrame(rows, "k long, t string, d string, h string, s string")
    got = {r.k: r for r in langid.identify(df, model, "k", F.col("t"), F.col("d"), F.col("h"), F.col("s")).collect()}
    names, n_lang = model.languages, len(model.languages)
    means, n = model.score([r[1] or "" for r in rows])
    first = [names[int(m.argmax())] if c and m.max() >= model.floor else "und" for m, c in zip(means, n, strict=True)]
    place = [(r[4] or "", r[3] or "") for r in rows]
    by_host, by_suffix, total = Counter(), Counter(), Counter()
    for p, x in zip(place, first, strict=True):
        by_host[p, x] += 1
        by_suffix[p[0], x] += 1
        total[x] += 1
    known = [s for s, v in langid.SUFFIX_LANGUAGES.items() if v in names]
    everything = sum(total[x] for x in names)
    for r, p, m, c in zip(rows, place, means, n, strict=True):
        tag, post = (r[2] or "").split("-")[0].lower(), []
        for k, x in enumerate(names):
            share = (total[x] + 1) / (everything + n_lang)
            suffix = (by_suffix[p[0], x] + 20 * share) / (sum(by_suffix[p[0], y] for y in names) + 20)
            prior = (by_host[p, x] + 20 * suffix) / (sum(by_host[p, y] for y in names) + 20)
            value = m[k] * min(c, 60) + math.log(prior)
            if tag in names:
                value += math.log(0.9 if tag == x else 0.1 / (n_lang - 1))
            if p[0] in known:
                value += math.log(0.6 if langid.SUFFIX_LANGUAGES[p[0]] == x else 0.4 / (n_lang - 1))
            post.append(value)
        post.append(model.floor * min(c, 60) + math.log(0.001))
        top = max(post)
        want = [*names, "und"][post.index(top)] if c else "und"
        assert got[r[0]].language == want and got[r[0]].n_trigrams == c
        assert abs(got[r[0]].confidence - (1 / sum(math.exp(v - top) for v in post) if c else 0)) < 1e-6


def test_scores_in_parts(monkeypatch):
    model = langid.TrigramModel(["a", "b"], [("one two three", "a"), ("uno dos tres", "b")])
    rows = ["", "one", "two three " * 50, "", "x", "dos tres uno", "abc " * 30, ""]
    whole = model.score(rows)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "LOOKED_UP", size)
        part = model.score(rows)
        assert np.allclose(part[0], whole[0]) and (part[1] == whole[1]).all()


def test_workers_without_the_package(tmp_path):
    """Started elsewhere: only the driver can import the package."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from plumbline.llm.queries import queries
print("rows", queries()["op1_language_id"](spark, {DATA!r}).count(), queries()["pages_language_id"](spark, {DATA!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" or str(ROOT) not in v}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240, check=False)
    assert done.stdout.strip() == "rows 200 50", done.stderr[-2000:]
