"""Base spans against the plain rules, and the graph's scores against a plain version, on odd and real texts."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tillwater.llm import pii, queries

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BITS = [
    "a@b.c", "x@y.z%q@w.e", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "0.0.00.255", " ", "  ", "4111 1111 1111 1111",
    "4111-1111 1111 1112", "+1 (743) 555-3824", "+", "-", ".", "(", ")", "é😀", "中", "7", "12", "\n", 'token = "', "ab", "%", "@",
    "+12345678901234567", "..", "a.b", "0255.1.1.1", "\x01",
]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, match):
    number = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 14 <= len(number) <= 19 and luhn(number), "phone": lambda: 10 <= len(number) <= 15,
    }[kind]()


def plain(text):
    found = [(m.start(), list(RULES).index(k), k, m.end()) for k, r in RULES.items() for m in re.finditer(r, text) if passes(k, m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def spans(column):
    return [(s["kind"], s["start"], s["end"]) for s in column]


def test_base_spans(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 40)))) for i in range(1500)]
    rows += [(None, None), (-1, ""), (-2, "1.2.3.4 " * 700 + "a" * 20000 + "@" + "." * 9000 + "1" * 9000), (7, rows[7][1])]
    found = pii.find(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, seeds string, `key` int")).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["doc_id"], spans(r["base"])) for r in found), key=key) == sorted(((d, plain(t or "")) for d, t in rows), key=key)
    for r in found:
        base = spans(r["base"])
        assert not any(a < f and c < b for _, a, b in spans(r["added"]) for _, c, f in base)
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r for r in queries.op11_personal_data(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        want, r = plain(text or ""), rows[doc_id]
        counts = collections.Counter(k for k, _, _ in want)
        assert [r[f"n_{k}"] for k in pii.BASE] == [counts[k] for k in pii.BASE]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(r["spans"].split(","))


def test_contexts_find_new_identifiers(spark):
    """Words around seeds find strings of other forms; the same forms in other contexts stay."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(40):
        rows.append(f"{word()} {word()} please call me at +1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} {word()}")
        rows.append(f"{word()} {word()} {word()} {rng.randint(10**9, 10**10 - 1)} {word()}")  # digits in no common context
        rows.append(f"{word()} chapter {i} of {rng.randint(1, 99)}.{rng.randint(1, 99)} {word()}")
        rows.append(f'{word()} key = "{rng.randbytes(20).hex()}" {word()}')
    hidden = [f"{word()} please call me at ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}." for _ in range(4)]
    secrets = [f'{word()} key = "pass_{word()}_{rng.randint(10**6, 10**7)}xyz" {word()}' for _ in range(3)]
    lone = [f"{word()} commit {rng.randbytes(20).hex()[:39]}0f went in {word()}"]
    texts = rows + hidden + secrets + lone
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    added = {r["doc_id"]: spans(r["added"]) for r in pii.find(df).collect()}
    strings = lambda i: [(k, texts[i][a:b]) for k, a, b in added[i]]
    at = len(rows)
    for i in range(at, at + 4):
        assert [k for k, _ in strings(i)] == ["phone"] and strings(i)[0][1].startswith("(")
    for i in range(at + 4, at + 7):
        assert [k for k, _ in strings(i)] == ["secret"] and strings(i)[0][1].startswith("pass_")
    for i in range(at):
        assert [k for k, _ in strings(i)] == (["secret"] if i % 4 == 3 else [])
    # Copies of a text are no further evidence.
    again = pii.find(df.union(df.filter("doc_id = 1").crossJoin(spark.range(50)).select("doc_id", "text"))).collect()
    assert all(spans(r["added"]) == added[r["doc_id"]] for r in again)


def plain_scores(finds, rounds):
    pats, first = collections.defaultdict(set), collections.defaultdict(float)
    for string, seed, forms, prior, own in finds:
        for p in own:
            pats[p].add(string)
        if seed:
            first[string, seed] = 1.0
        else:
            for k in forms:
                first[string, k] = max(first[string, k], prior if k == "secret" else 0.0)
    score = dict(first)
    begun = {(p, k) for p in pats for k in pii.KINDS if sum(first.get((s, k), 0) > 0 for s in pats[p]) >= pii.LEAST}
    for _ in range(rounds):
        trust = {(p, k): round(sum(score.get((s, k), 0) for s in pats[p]) / (len(pats[p]) + 1), 9) for p, k in begun}
        doubt = collections.defaultdict(lambda: 1.0)
        for (p, k), t in trust.items():
            if t >= pii.GATE:
                for s in pats[p]:
                    doubt[s, k] *= 1 - t
        score = {(s, k): round(1 - (1 - f) * doubt[s, k], 9) for (s, k), f in first.items()}
    best = {}
    for (s, k), x in score.items():
        if first[s, k] < 1 and x >= pii.ACCEPT:
            best[s] = max(best.get(s, (0, 0, "")), (x, -pii.KINDS.index(k), k))
    return {s: (k, x) for s, (x, _, k) in best.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scores(spark, seed):
    rng = random.Random(seed)
    finds = []
    for _ in range(400):
        string, kind = f"s{rng.randint(0, 150)}", rng.choice([None, None, *pii.BASE])
        forms = None if kind else sorted(rng.sample(pii.KINDS, rng.randint(0, 3)))
        finds.append((string, kind, forms, rng.choice([0.0, 0.6]), [f"p{int(rng.triangular(0, 30, 0))}" for _ in range(rng.randint(1, 4))]))
    df = spark.createDataFrame(finds, "string string, seed string, forms array<string>, prior double, patterns array<string>")
    got = {r["string"]: (r["kind"], r["score"]) for r in pii.scored_strings(df).collect()}
    want = plain_scores([(s, k, f or [], p, o) for s, k, f, p, o in finds], pii.ROUNDS)
    assert {s: k for s, (k, _) in got.items()} == {s: k for s, (k, _) in want.items()} and want
    assert all(abs(got[s][1] - want[s][1]) < 1e-5 for s in want)


def test_positions_of_many_matches(spark):
    text = "x 9.9.9.9" * 1000
    row = spark.createDataFrame([(text,)], "text string").select(pii.base_spans(F.col("text")).alias("s")).first()
    assert [(s["start"], s["end"]) for s in row["s"]] == [(9 * i + 2, 9 * i + 9) for i in range(1000)]
