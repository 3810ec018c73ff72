"""Near duplicates weighed by the document frequencies of all shingles."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillwater.llm import minhash


def shingles(text):
    w = text.split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else collections.Counter([tuple(w)] if w else [])


def classes_by_pairs(rows):
    sets = {d: shingles(t) for d, t in rows}
    documents = collections.Counter(s for v in sets.values() for s in v)
    weight = lambda v: sum(n * (1 + math.log(len(rows) / documents[s])) for s, n in v.items())
    above = {d: d for d in sets}
    for a in sets:
        for b in sets:
            both = weight(sets[a] & sets[b])
            if a < b and sets[a] and both >= 0.8 * (weight(sets[a]) + weight(sets[b]) - both):
                old, new = max(above[a], above[b]), min(above[a], above[b])
                above = {d: new if x == old else x for d, x in above.items()}
    return above


def corpus():
    """A passage in a tenth of the documents: pairs that share it, and little else, and pairs that have rare words in common."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    passage = words(90)
    rows = [(i, " ".join(words(60))) for i in range(180)]
    rows += [(200 + i, " ".join([*passage, *words(9)])) for i in range(20)]
    for i in range(10):
        rare = words(70)
        rows += [(300 + 2 * i, " ".join([*passage[:30], *rare])), (301 + 2 * i, " ".join([*rare, *words(4)]))]
    rows += [(400 + i, rows[0][1]) for i in range(5)] + [(410, "few words"), (411, "few words"), (412, "few others")]
    return rows


@pytest.mark.parametrize("tile", [1 << 14, 40])
def test_frequencies_below_a_fifth_count(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE_BYTES", tile, raising=False)
    rows = corpus()
    df = spark.createDataFrame([*rows, (500, ""), (501, ""), (502, None)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(df, share=0).collect()}
    want = classes_by_pairs([*rows, (500, ""), (501, "")])
    assert got == want | {500: 500, 501: 500, 502: 502}
    # By term frequency alone, documents that share the passage would be alike.
    assert len({got[200 + i] for i in range(20)}) == 20
    assert len({r["class_id"] for r in minhash.classes(df).filter("doc_id between 200 and 219").collect()}) < 20
    assert sorted(r["doc_id"] for r in minhash.keep_one(df, share=0).collect()) == sorted({*got.values()})
    assert minhash.classes(df.limit(0), share=0).count() == 0


@pytest.mark.parametrize("tile", [1 << 14, 40])
def test_every_text_gets_the_counts_of_its_shingles(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE_BYTES", tile, raising=False)
    rows = corpus()
    texts = minhash.with_node(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("node", "text").agg(F.count(F.lit(1)).alias("copies"))
    found = minhash.frequency_sketches(texts, len(rows), sum(len(t) for _, t in rows)).join(texts, "node").collect()
    owner, ids, _ = minhash.shingle_sets(pa.array([t for _, t in rows]))
    want = collections.Counter(ids.tolist())
    assert len(found) == len({t for _, t in rows})
    for r in found:
        own = minhash.shingle_sets(pa.array([r["text"]]))[1].tolist()
        assert np.frombuffer(r["frequent"], "<u4").tolist() == [want[i] for i in own]


def test_packed_ids():
    for n in (0, 1, 1000):
        ids = np.unique(np.random.default_rng(n).integers(0, 1 << minhash.ID_BITS, n, dtype=np.uint64))
        assert minhash.unpacked(minhash.packed(ids)).tolist() == ids.tolist()
