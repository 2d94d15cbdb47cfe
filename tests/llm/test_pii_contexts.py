"""Bootstrapped contexts of personal data, against a brute-force version and in odd frames."""

import random
import re
import time

from test_llm import base_spans

from plumbline.llm import pii

WORDS = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"[^\s=:]*[0-9@][^\s=:]*")


def brute(rows, min_seeds=5, min_score=0.75, min_digits=4):
    """Spans of every row, by loops over whole texts."""
    seen, out = [], {}
    for i, t in rows:
        out[i] = [(s, k, e) for k, s, e in ((x.split(":")[0], *map(int, x.split(":")[1:])) for x in base_spans(t).split(",") if x)]
        for k, s, e in {(k, s, e) for s, k, e in out[i]}:
            seen.append((i, s, e, t[s:e], True, " ".join(w.lower() for w in WORDS.findall(t[:s])[-2:])))
        for m in TOKEN.finditer(t):
            if any(s < m.end() and e > m.start() for s, _, e in out[i]) or sum(c.isdigit() for c in m[0]) < min_digits:
                continue
            inner = re.search(r"[^\W_](?:.*[^\W_])?", m[0])
            s, e = m.start() + inner.start(), m.start() + inner.end()
            seen.append((i, s, e, t[s:e].lower(), False, " ".join(w.lower() for w in WORDS.findall(t[: m.start()])[-2:])))
    seen = [x for x in seen if " " in x[5]]
    edges = {(x[5], x[3]): max(y[4] for y in seen if (y[5], y[3]) == (x[5], x[3])) for x in seen}
    scores, patterns = {}, {}
    for (_, token), seed in edges.items():
        scores[token] = max(scores.get(token, 0.0), float(seed))
    while True:
        new = {}
        for p in {p for p, _ in edges}:
            got = [scores[t] for q, t in edges if q == p]
            if sum(g >= min_score for g in got) >= min_seeds and sum(got) / (len(got) + 1) >= min_score:
                new[p] = sum(got) / (len(got) + 1)
        if len(new) == len(patterns):
            break
        patterns = new
        for (p, token), seed in edges.items():
            scores[token] = max(scores[token], float(seed), patterns.get(p, 0.0))
    for i, s, e, _, seed, p in seen:
        if not seed and p in patterns:
            out[i].append((s, "id", e))
    order = [*pii.KINDS, "id"]
    return {i: ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(set(v), key=lambda x: (x[0], order.index(x[1])))) for i, v in out.items()}


def spans(spark, rows):
    return {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_against_brute_force(spark):
    rng = random.Random(11)
    word = ["room", "4", "badge", "number", "of", "the", "Ünder", "x-y", "(see)", "mail:", "id=", "call"]

    def mark():
        n = rng.randint(0, 30)
        some = [f"john.{chr(97 + n % 26)}@example.com", f"+1 555 {1000000 + n}", f"10.0.0.{n}", f"({7000 + n % 3})", f"AB-{90000 + n % 4},", f"{n}"]
        return rng.choices(some, (8, 8, 8, 1, 1, 1))[0]

    rows = []
    for i in range(400):
        lead = rng.choice(["badge number", "room 4", "write to", "mail:", "id="])
        words = [rng.choice(word) for _ in range(rng.randint(0, 6))] + lead.split() + [mark()] + [rng.choice(word), mark()]
        rows.append((i, " ".join(words)))
    want = brute(rows)
    assert spans(spark, rows) == want
    assert sum("id:" in v for v in want.values()) > 5


def test_seeds_without_digits_and_counted_contexts(spark):
    mails = [(i, f"please write to {chr(97 + i)}.doe@example.com soon") for i in range(20)]
    rooms = [(50 + i, f"room 4 badge +1 555 {1000000 + i * 7919}") for i in range(20)]
    got = spans(spark, [*mails, *rooms, (100, "please write to user-99812, soon"), (101, "room 4 badge 889922"), (102, "we counted 889921 birds")])
    assert got[100] == "id:16:26" and got[101] == "id:13:19" and got[102] == ""


def test_patterns_found_in_later_rounds(spark):
    ids = [f"K{4000 + i}" for i in range(20)]
    phones = [(i, f"reach him at +1 555 {1000000 + i * 7919}") for i in range(200)]
    linked = [(1000 + i, f"reach him at {x}") for i, x in enumerate(ids)] + [(2000 + i, f"the member code {x}") for i, x in enumerate(ids * 2)]
    got = spans(spark, [*phones, *linked, (3000, "his member code K9999"), (3001, "some other thing K9999")])
    assert got[2000] == "id:16:21" and got[3000] == "id:16:21" and got[3001] == ""


def test_long_lists_of_numbers(spark):
    began = time.monotonic()
    assert spans(spark, [(1, " ".join(str(1000 + i) + "." for i in range(60_000)))]) == {1: ""}
    assert time.monotonic() - began < 60  # a fold over all matches at once took 127 s


def test_redact_odd_frames(spark):
    schema = "doc_id long, text string, _id string, _key long, _key2 long, _spans string, _span_id string, n_chars long"
    rows = [(None, "mail a@b.com", "i", 1, 2, "s", "x", 12), (None, "nothing", "i", 1, 2, "s", "x", 7), (7, "mail a@b.com", None, None, None, None, None, None), (7, "mail a@b.com", None, None, None, None, None, None), (7, None, "i", 1, 2, "s", "x", 0), (8, "", "i", 1, 2, "s", "x", 0)]
    out = pii.redact(spark.createDataFrame(rows, schema))
    assert out.columns == [c.split()[0] for c in schema.split(", ")]
    got = sorted((str(r.doc_id), str(r.text), str(r._id)) for r in out.collect())
    assert got == sorted([("None", "mail <email>", "i"), ("None", "nothing", "i"), ("7", "mail <email>", "None"), ("7", "mail <email>", "None"), ("7", "None", "i"), ("8", "", "i")])
    assert pii.redact(spark.createDataFrame([], schema)).count() == 0
