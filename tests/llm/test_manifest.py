"""Merkle proofs and prefix tries against plain versions, on odd rows, with small partitions and shards."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tillwater.llm import manifest_sql, merkle, tries


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(digests, fanout):
    """The root, and each leaf's list of (left, right)."""
    paths, places = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for path, i in zip(paths, places):
            first = i - i % fanout
            path.append(("".join(digests[first:i]), "".join(digests[i + 1 : first + fanout])))
        digests = [sha(*digests[i : i + fanout]) for i in range(0, len(digests), fanout)]
        places = [i // fanout for i in places]
    return digests[0], paths


def plain_manifest(rows, fanout):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in by[s]], fanout)
    root, tops = climb([trees[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(by[s], trees[s][1]):
            path = [*path, *top]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            folded = leaf((*r[:4], r[4].replace("\n", "")) if changed else r)
            for a, b in path:
                folded = sha(a, folded, b)
            out.append((r[0], leaf(r), trees[s][0], root, sha(*[a + b for a, b in path]), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height,fanout,n", [(7, 3, 300), (1, 3, 300), (0, 3, 61), (2, 2, 150), (1, 4, 90)])
def test_manifest(spark, height, fanout, n):
    rng = random.Random(n + height)
    rows = [
        (rng.choice([None, *range(2 * n)]), rng.choice([None, "", "a", "a", "a", "a", "é", "Z"] + [f"s{i}" for i in range(11)]),
         rng.choice([None, "en"]), rng.choice([None, 5]), rng.choice([None, "", "x\ny", "é\n", "😀" * 3]))
        for _ in range(n)
    ]
    rows += [(2**60 + 1, "a", "en", 1, "big\nid"), (7, "lone source", None, None, "t" * 50_000 + "\n"), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int").repartition(7)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.manifest(docs, F.when(changed, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")), fanout, height).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows, fanout)


def test_manifest_of_little(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0
    row = (4, "s", "en", 2, "a\n")
    (one,) = merkle.manifest(spark.createDataFrame([row], schema)).collect()
    assert one["root"] == one["subroot"] == one["leaf"] == leaf(row) and one["verified"] and one["proof_sha256"] == sha("")


def plain_prefixes(sequences):
    """``sequences``: conv_id to a tuple of (role, text)."""
    nodes = collections.defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, who in nodes.items():
        own = (len(who) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += own
    return sorted((
        min(who), len(p), min(nodes[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p],
        sha(",".join(str(c) for c in sorted(who) if len(sequences[c]) == len(p))),
    ) for p, who in nodes.items())


def conversations(rng, n, hot=0.4):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 12)):
            text = "hello" if t == 0 and rng.random() < hot else rng.choice(["", None, "yes", "no", "é", "ok " * 3])
            rows.append((c * rng.choice([1, 1, 3]) if t else c, rng.choice([None, t, t]), rng.choice([None, "user", "bot"]), text))
    return rows + [(None, 1, "user", "lost"), (3, 5, "x" * 10, "long " * 20_000), rows[0], rows[0]]


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    return out


@pytest.mark.parametrize("lead,shard", [(2, 32_768), (1, 20), (0, 9), (3, 40)])
def test_prefixes(spark, lead, shard):
    rng = random.Random(shard)
    rows = conversations(rng, 150)
    want = plain_prefixes(rebuilt(rows))
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int").repartition(6)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    got = tries.prefixes(tries.rebuilt(tries.turns(table), F.col("conv_id") - F.col("conv_id") % 5, head, 8), lead, shard)
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=lambda r: r[:2]) == want


def test_prefixes_of_many_copies(spark):
    """A group of equal conversations larger than a batch, and one that goes on from it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        sequences = {c: (("u", "hi"), ("b", "ho")) for c in range(1000)} | {5000: (("u", "hi"), ("b", "ho"), ("u", "more")), 5001: ()}
        rows = [(c, i, *t) for c, s in sequences.items() for i, t in enumerate(s)]
        table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
        held = tries.rebuilt(tries.turns(table), F.col("conv_id"), F.lit(0), 0)
        nothing = held.limit(1).select(F.lit(5001).cast("long").alias("conv_id"), F.slice("keys", 1, 0).alias("keys"), F.slice("sizes", 1, 0).alias("sizes"))
        got = tries.prefixes(held.union(nothing)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r[c] for c in order) for r in got), key=lambda r: r[:2]) == plain_prefixes(sequences)
    assert tries.prefixes(tries.rebuilt(tries.turns(table.limit(0)), F.col("conv_id"), F.lit(0), 0)).count() == 0


def test_double_array():
    rng = random.Random(5)
    for _ in range(60):
        made = sorted({tuple(rng.choice([0, 1, 2, rng.randint(0, 300)]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 200))})
        base, check = tries.pack(made)
        states = {}
        for s in made:
            state = 0
            for d, c in enumerate(s):
                state = tries.step(base, check, state, c)
                assert state > 0 and states.setdefault(s[: d + 1], state) == state
        assert len(set(states.values())) == len(states) == sum(x >= 0 for x in check) - 1
        for s in list(states)[:50]:
            going = {t[-1] for t in states if len(t) == len(s) + 1 and t[:-1] == s}
            assert {c for c in range(301) if tries.step(base, check, states[s], c) >= 0} == going


def test_checksum_sql():
    for number in ("0", "7", "12345678901", "-3"):
        assert duckdb.sql(f"SELECT {manifest_sql.crc32(repr(number))}").fetchall()[0][0] == zlib.crc32(number.encode())
