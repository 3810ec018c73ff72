"""Operators for training data against brute force, round trips and held-out labels, on small tables with odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

from tillwater.llm import bpe, idstore, minhash, neighbours, packing, quality_model, quality_rules, sharding, substring, tokens, urls

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"passage{i}" for i in range(60))
ODD = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "a"),
    (2, None, "b"), (3, "", None), (4, " \n\t ", "b"), (None, "text without an id, which has a few words", "a"),
    (5, "same words again and again " * 30, "a"), (5, "same words again and again " * 30, "a"),
    (6, "x" * 3000, "a"), (7, f"Before it all. {PASSAGE} After it.", "a"), (8, f"Other start\nand {PASSAGE}\u00a0end 'tis", "a"),
    (9, f"Before it all. {PASSAGE} After it!", "a"), (10, "é 中文\u3000don't  stop\r\n\r\n" * 40, "a"), (None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    # ``node``, ``n_words`` and ``score`` clash with names that operators use.
    return spark.createDataFrame([(*r, i, "z", 0.5) for i, r in enumerate(ODD)], "doc_id long, text string, lang string, n_words int, node string, score double").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def order(x):
    return (x[0] is not None, x[0] or 0, *map(str, x[1:]))


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK, bpe.OVERLAP), (200, 30)])
def test_bpe(spark, odd, docs, chunk, overlap):
    ranks = public.path("byte_bpe_50k.tiktoken")
    both = odd.select("doc_id", "text").union(docs.select("doc_id", "text").limit(60))
    got = bpe.decode(bpe.encode(both, ranks, public.PATTERN, chunk, overlap), ranks).collect()
    enc = bpe.encoding(ranks, public.PATTERN)
    want = sorted(((d, bpe.packed_ids(enc.encode_ordinary(t or "")), (t or "").encode()) for d, t in texts_of(both)), key=order)
    assert sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got), key=order) == want
    assert bpe.encode(odd.limit(0), ranks, public.PATTERN).count() == 0


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "attached"), ("word_bpe_49k.json", "dropped")])
def test_word_memory(name, kind, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    encoder = tokens.TextIds(public.path(name), kind)
    odd = ["", " ", "a b", " a", "a ", "\n", "a\n", "a \n b", "a\tb\r\nc", "a\xa0b c", "\n\na b", "don't 's\x1cq", "<|endoftext|> x", "İstanbul e\u0301"]
    for text in odd + [t or "" for _, t, _ in ODD]:
        assert encoder.packed(text) == encoder.whole(text), text


def test_packing(odd, docs):
    both = odd.select("doc_id", "text").union(docs.select(F.col("doc_id") + 1000, "text").limit(80))
    path = public.path("word_bpe_49k.json")
    rows = packing.pack(both, path, length=256).collect()
    encoder = tokens.TextIds(path, "dropped")
    want = sum(len(encoder.packed(t or "")) // 2 + 1 for _, t in texts_of(both))
    assert sum(r["length"] for r in rows) == want
    by_sequence = collections.defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"], r["padded_length"]))
    assert sorted(by_sequence) == list(range(math.ceil(want / 256)))
    for at, pieces in by_sequence.items():
        end = 0
        for offset, length, padded in sorted(pieces):
            assert offset == end
            end += length
        assert end == 256 or at == max(by_sequence) and padded in (256, end)
    joined = collections.defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        joined[r["doc_id"]] += bytes(r["ids"])
    for d, t in texts_of(both):
        if d in (1, 2, 6, 10):
            assert joined[d] == encoder.unsigned32(encoder.packed(t or "")) + b"\1\0\0\0"
    assert packing.pack(odd.limit(0), path).count() == 0


def test_id_store(spark, odd):
    path = public.path("byte_bpe_50k.json")
    store = idstore.write(odd, path)
    rows = sorted(store.read(store.find(odd.select("doc_id"))).collect(), key=lambda r: r["start"])
    encoder = tokens.TextIds(path, "attached")
    want = [(d, encoder.unsigned32(encoder.packed(t or "") + b"\2\0")) for d, t in sorted(texts_of(odd), key=order)]
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in rows), key=order) == sorted(want, key=order)
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    start = 0
    for r in rows:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) // 4
        start += r["n_tokens"]
    assert store.find(spark.createDataFrame([(77,), (-3,)], "doc_id long")).count() == 0
    empty = idstore.write(odd.limit(0), path)
    assert empty.read(empty.find(odd.limit(0))).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    _, slots, _ = idstore.build_index(h1, h2)
    assert sorted(slots) == list(range(5000))


def test_sharding(odd, docs):
    tree = sharding.Tree.regular(40)
    both = odd.select("doc_id", "text").union(docs.select("doc_id", "text"))
    rows = sharding.place(both, tree).collect()
    assert len(rows) == both.count()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert sizes == collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts_of(both))
    assert sharding.place(odd.limit(0), tree).count() == 0


def test_reweighting_moves_only_its_subtrees(spark):
    tree = sharding.Tree.regular(16)
    keys = spark.range(4000)
    moved = keys.select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), tree.reweighted(5, 3.0)).alias("b")).filter("a <> b").collect()
    assert moved and all(0 <= r["b"] < 8 for r in moved)  # region of shards 0 to 7
    assert not keys.filter(sharding.shard_of(F.col("id"), tree.reweighted(5, 0.0)) == 5).count()


def test_quality_rules(odd, docs):
    both = odd.select("doc_id", "text").union(docs.select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = sorted(((r["doc_id"], *(r[n] for n in names)) for r in quality_rules.measures(both).collect()), key=order)

    def brute(t):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)

    assert got == sorted(((d, *brute(t)) for d, t in texts_of(both)), key=order)


def test_quality_rules_follow_labels(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = quality_rules.measures(docs).join(labels, "doc_id").collect()
    assert not [r for r in rows if r["quality"] == 0 and r["kept"]]
    assert not [r for r in rows if r["quality"] == 1 and not r["kept"] and not r["base_failed"]]
    kept = quality_rules.keep_good(docs.withColumn("kept", F.lit(1)))
    assert kept.columns == [*docs.columns, "kept"]


def test_line_rules(spark):
    good = "A plain sentence of several words stands here. " * 4
    text = f"{good}\nHome | About | News | Contact | Login\nWe use cookies on this site.\n{good}"
    row = quality_rules.measures(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row["cleaned"] == f"{good}\n{good}" and row["n_lines_removed"] == 2


def test_quality_model(spark, docs, odd):
    table = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{table}/documents.parquet")
    labels = spark.read.parquet(f"{table}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality_model.fit(docs, labels.filter(~held))
    rows = quality_model.scored(docs.join(labels.filter(held), "doc_id"), model).select("quality", "score").collect()
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in rows) >= 0.93 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in quality_model.scored(odd.drop("score"), model).collect())
    assert quality_model.keep_good(odd, model).columns == odd.columns
    assert quality_model.fit(docs, labels.filter("quality = 1")).probability(0.0) > 0.9
    assert quality_model.fit(docs, labels.limit(0)).probability(0.0) == 0.5


def test_urls(spark):
    rules = [urls.Rule("org/", True), urls.Rule("example.org/es/", False), urls.Rule("example.org/en/1", False)]
    cases = [
        (1, "http://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/"), (2, "https://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
        (3, "https://x.org", "x.org", "", None), (4, "https://notexample.org/es/", "notexample.org", "/es/", "org/"), (5, None, "", "", None),
        (6, "no scheme/org/", "", "", None), (7, "", "", "", None), (8, "a://b\n.org/p\nq", "b\n.org", "/p\nq", "org/"), (8, "a://b\n.org/p\nq", "b\n.org", "/p\nq", "org/"),
        (9, "x://y?z://w.org/", "y", "", None), (None, "ftp://É.com#/x", "É.com", "", None),
    ]
    pages = spark.createDataFrame([c[:2] for c in cases], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in urls.judge(pages, rules).collect()), key=order)
    assert got == sorted(((c[0], *c[2:]) for c in cases), key=order)
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_url_trees_learn(spark):
    rows = [(f"http://{'buy-cheap' if i % 2 else 'www'}{i}.site.{'biz' if i % 2 else 'edu'}/p/{i}", i % 2) for i in range(400)]
    model = urls.fit(spark.createDataFrame(rows, "url string, blocked int"))
    pages = spark.createDataFrame([(1, "http://buy-cheap9999.other.biz/p/1"), (2, "http://www9999.other.edu/p/1")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, [], model).collect()} == {1: "block", 2: "allow"}


def test_url_copies_do_not_fill_the_sample(spark):
    rows = [("http://one.site.edu/p", 0)] * 500
    rows += [(f"http://{'buy-cheap' if i % 2 else 'www'}{i}.site.{'biz' if i % 2 else 'edu'}/p/{i}", i % 2) for i in range(300)]
    model = urls.fit(spark.createDataFrame(rows, "url string, blocked int"), sample=200)
    pages = spark.createDataFrame([(1, "http://buy-cheap9999.other.biz/p/1"), (2, "http://www9999.other.edu/p/1")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, [], model).collect()} == {1: "block", 2: "allow"}


def test_neighbours(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    bad = spark.createDataFrame(
        [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [None] + [1.0] * 63), (9005, [1.0]), (None, [1.0] * 64)]
        + [(9010 + i, [1.0, 2.0] * 32) for i in range(12)], "vec_id long, embedding array<float>",
    )
    graph = neighbours.build(table.union(bad))
    rows = neighbours.search(graph, table.union(bad).filter("vec_id % 10 = 0")).collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()} | {9010 + i: np.array([1.0, 2.0] * 32) for i in range(12)}
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = hits = 0
    for q in ids[ids % 10 == 0]:
        sims = x @ x[np.flatnonzero(ids == q)[0]]
        sims[ids == q] = -9
        want = ids[np.lexsort((ids, -np.round(sims, 12)))[:5]]
        got = [r["vec_id"] for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])]
        hits, found = hits + len(set(want) & set(got)), found + len(got)
    assert found == 5 * sum(ids % 10 == 0) and hits >= 0.9 * found
    assert [r["vec_id"] for r in sorted((r for r in rows if r["query_id"] == 9020), key=lambda r: r["rank"])] == [9010, 9011, 9012, 9013, 9014]
    assert neighbours.search(neighbours.build(table.limit(0)), table.limit(0)).count() == 0


def near_classes(rows):
    sets, texts = {}, {}
    for d, t in rows:
        w = WORD.findall(t)
        sets[d] = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else collections.Counter([tuple(w)] if w else [])
        texts[d] = t
    df = collections.Counter(s for v in sets.values() for s in v)
    idf = lambda s: 1 + math.log(min(len(rows) / df[s], 5))
    above = {d: d for d in sets}

    def root(d):
        while above[d] != d:
            d = above[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and root(a) != root(b):
                both = sum(min(sets[a][s], sets[b][s]) * idf(s) for s in sets[a].keys() & sets[b].keys())
                all_ = sum(n * idf(s) for v in (sets[a], sets[b]) for s, n in v.items()) - both
                if texts[a] == texts[b] or all_ and both / all_ >= 0.8:
                    above[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in sets}


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 500, 90))) for i in range(40)]
    for i in range(40, 70):
        words = list(base)
        for at in rng.integers(0, 120, i % 4):
            words[at] = f"edit{i}"
        rows.append((i, " ".join(words)))
    rows += [(70, "few words"), (71, "few words"), (72, ""), (73, ""), (74, "few other words")]
    df = spark.createDataFrame([*rows, (80, None), (81, None)], "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(df).collect()}
    assert got == near_classes(rows) | {80: 80, 81: 81}
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))
    assert minhash.classes(df.limit(0)).count() == 0


def test_near_duplicates_far_from_the_centre(spark, monkeypatch):
    """Two near copies that share only bands of large groups, and are far from all the central members there, are found."""
    monkeypatch.setattr(minhash, "BLOCK", 7, raising=False)
    rng = np.random.default_rng(11)
    core, tail = ([f"{name}{x}" for x in range(n)] for name, n in (("core", 100), ("tail", 15)))
    central = [" ".join([*core, *tail, f"end{i}"]) for i in range(30)]
    far = [" ".join([*core, *(f"own{i}x{x}" for x in range(10))]) for i in range(60)]
    owner, ids, counts = minhash.shingle_sets(pa.array([*central, *far]))
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    keys = minhash.band_keys(minhash.samples(ids, counts * (1 + math.log(5)), starts))
    large = [{k for k, n in collections.Counter(keys[:30, band].tolist()).items() if n > 15} for band in range(minhash.BANDS)]

    def only_in_large_groups(i, j):
        shared = [k in large[band] for band, (k, other) in enumerate(zip(keys[30 + i].tolist(), keys[30 + j].tolist())) if k == other]
        return shared and all(shared)

    i, j = next((i, j) for i in range(60) for j in range(i) if only_in_large_groups(i, j))
    rows = list(enumerate([*central, far[j], far[i]]))
    rows += [(100 + n, " ".join(f"w{x}" for x in rng.integers(0, 5000, 60))) for n in range(200)]
    want = near_classes(rows)
    assert want[29] == 0 and want[31] == want[30] == 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["class_id"] for r in minhash.classes(df).collect()} == want


def test_common_shingles_are_not_lost(spark, monkeypatch):
    """A shingle that grows in a partition, and is let go at several merges, is counted all the same."""
    monkeypatch.setattr(minhash, "HELD", 50, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        rows = []
        for batch in range(1, 5):
            rows += [("one two three four five" if i < batch else " ".join(f"r{batch}x{i}y{n}" for n in range(30)),) for i in range(10)]
        ids, counts, total = minhash.common_shingles(spark.createDataFrame(rows, "text string").coalesce(1))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ids.tolist() == minhash.shingle_sets(pa.array(["one two three four five"]))[1].tolist()
    assert (counts.tolist(), total) == ([10], 40)


@pytest.mark.parametrize("spread", [1, 7, 40])
def test_common_shingles_over_small_partitions(spark, spread):
    common = [("a b c d e", 3), ("f g h i j", 5), ("k l m n o", 1)]
    rows = [(" ".join([s for s, n in common if i % 10 < n] + [f"r{i}w{n}" for n in range(12)]),) for i in range(40)]
    ids, counts, total = minhash.common_shingles(spark.createDataFrame(rows, "text string").repartition(spread))
    found = dict(zip(ids.tolist(), counts.tolist()))
    want = {minhash.shingle_sets(pa.array([s]))[1].tolist()[0]: 4 * n for s, n in common if n > 1}
    assert {k: v for k, v in found.items() if k in want} == want and all(v >= 8 for v in found.values()) and total == 40


def test_stitches_behind_white_space(spark):
    """Chunk borders, and so stitches, fall on every place of texts full of white space."""
    rng = np.random.default_rng(3)
    bits = ["a", "word", " ", "  ", "\n", "\n\n", "\t", "\r\n", "don't", "'", "'ll", "12", "345", "\u00a0", "\u3000", "é中", "...", "!?", "   \n "]
    rows = [(i, "".join(rng.choice(bits, int(rng.integers(1, 120))))) for i in range(1500)]
    rows += [(2000 + i, "p" * i + "\n\nq" * 60 + " " * i + "r s" * 40) for i in range(40)]
    ranks = public.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoding(ranks, public.PATTERN)
    for chunk, overlap in ((24, 8), (40, 20)):
        got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), ranks, public.PATTERN, chunk, overlap).collect()
        assert {r["doc_id"]: bytes(r["ids"]) for r in got} == {d: bpe.packed_ids(enc.encode_ordinary(t)) for d, t in rows}


def test_keep_one_of_rows_alike(spark):
    rows = [(1, "same text here", "a"), (1, "same text here", "a"), (1, "same text here", "b"), (None, "same text here", "a"), (2, None, "x"), (2, None, "x"), (3, "other words in this", "c")]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    assert len(kept) == 4 and sorted(r["doc_id"] for r in kept) == [1, 2, 2, 3]


def test_queries_of_other_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8 if i % 10 else 5).tolist()) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    graph = neighbours.build(table)
    assert neighbours.search(graph, table.filter("vec_id % 10 = 0 or vec_id = 7")).select("query_id").distinct().collect() == [(7,)]


def test_blocks_against_pairs():
    """The products over two blocks join what the pairwise similarities join, also with repeated words and at the threshold."""
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 40, 60)] + ["spam"] * 30
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, len(words), i % 6):
            words[at] = f"e{i}"
        texts.append(" ".join(words) if i % 9 else "" if i % 2 else "few words")
    blocks = [pa.StructArray.from_arrays([pa.array([str(i).encode() for i in at]), pa.array([str(i).encode() for i in at]), pa.array([texts[i] for i in at])],
                                         ["node", "label", "text"]) for at in (range(25), range(25, 60))]
    ids, counts = np.unique(minhash.shingle_sets(pa.array(texts))[1], return_counts=True)
    weights = minhash.Weights(ids[counts >= 12], counts[counts >= 12], 60)
    a, b = np.divmod(np.arange(25 * 35), 35)
    alike = minhash.similarities(pa.array([texts[i] for i in a]), pa.array([texts[25 + j] for j in b]), weights)
    for least in (0.8, float(np.sort(alike[alike > 0.5])[7])):
        above = list(range(60))
        for i, j in zip(a[alike >= least], b[alike >= least]):
            old, new = above[25 + j], above[i]
            above = [new if x == old else x for x in above]
        got = list(range(60))
        for i, j in zip(*minhash.joins(*blocks, weights, least)):
            assert alike[i * 35 + j] >= least
            old, new = got[25 + j], got[i]
            got = [new if x == old else x for x in got]
        filled = [i for i in range(60) if texts[i]]
        assert all((above[i] == above[j]) == (got[i] == got[j]) for i in filled for j in filled)


def test_near_duplicates_of_odd_rows(odd):
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[5] == 1 and ids[None] == 2 and ids[2] == 1


def test_similarity_estimate():
    """Agreement of samples estimates weighted Jaccard similarity."""
    rng = np.random.default_rng(7)
    ids = rng.integers(0, 1 << 47, 400).astype(np.uint64)
    a, b = np.sort(ids[:360]), np.sort(ids[40:])
    agree = []
    for shift in range(12):
        both = minhash.samples(np.concatenate([a, b]) + np.uint64(shift * 977), np.ones(720), np.array([0, 360]))
        agree.append((both[0] == both[1]).mean())
    assert abs(np.mean(agree) - 320 / 400) < 0.06


def test_repeats(odd, docs):
    both = odd.select("doc_id", "text").union(docs.select("doc_id", "text"))
    rows = texts_of(both)
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    want = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        if d is not None:
            gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicated(both, True).collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert substring.deduplicated(both.limit(0)).count() == 0


def test_source_cited_by_many(spark):
    licence = " ".join(f"l{i}" for i in range(60))
    rows = [(0, f"first {licence} end")] + [(i, f"own{i} words{i} {licence} more{i}") for i in range(1, 301)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = substring._keyed(docs)
    found = substring.spans(keyed, substring.whole_copies(keyed))
    told = substring.digested(keyed, found).collect()
    assert sorted(r["doc"] for r in told) == list(range(1, 301)) and len({bytes(r["digest"]) for r in told}) == 1
    got = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs).collect()}
    assert got == {0: rows[0][1]} | {i: f"own{i} words{i} more{i}" for i in range(1, 301)}


def test_near_copies_are_told_apart(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    rows = [(i, (base + 1e-4 * rng.standard_normal(16)).tolist()) for i in range(600)]
    rows += [(600 + i, rng.standard_normal(16).tolist()) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(neighbours.build(table), table.filter("vec_id % 20 = 0")).collect()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for r in got:
        sims = x @ x[r["query_id"]]
        sims[r["query_id"]] = -9
        hits += sims[r["vec_id"]] >= np.sort(sims)[-5] - 1e-15
    assert len(got) == 200 and hits >= 0.9 * 200


def test_repeats_keep_columns(odd):
    cut = substring.remove_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert substring.deduplicated(odd).columns == [*odd.columns, "n_words_", "n_removed"]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SMALL)
        if name != "packing":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(out.count())
        kept = out
    assert docs.count() > sizes[0] >= sizes[1] > sizes[2] == sizes[3] > 0 and sizes[4] > 0


def test_dedup_and_packing_stages_against_brute_force(spark):
    """What near dedup keeps, what passage dedup leaves of it, and how many ids are packed."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id is not null and text is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(150)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    texts = dict(texts_of(docs))
    kept = stages["near dedup"](spark, docs, SMALL)
    kept = spark.createDataFrame(kept.collect(), docs.schema)
    want = {d: texts[d] for d in set(near_classes(sorted(texts.items())).values())}
    assert dict(texts_of(kept)) == want and kept.count() == len(want) < len(texts)
    first = {}
    for d in sorted(want):
        w = WORD.findall(want[d])
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d in want:
        w = WORD.findall(want[d])
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        want[d] = [x for i, x in enumerate(w) if i not in gone]
    cut = stages["substring dedup"](spark, kept, SMALL)
    cut = spark.createDataFrame(cut.collect(), docs.schema)
    assert cut.count() == len(want) and {d: WORD.findall(t) for d, t in texts_of(cut)} == want
    encoder = tokens.TextIds(public.path("word_bpe_49k.json"), "dropped")
    rows = stages["packing"](spark, cut, SMALL).select("length").collect()
    assert sum(r["length"] for r in rows) == sum(len(encoder.packed(t)) // 2 + 1 for _, t in texts_of(cut))


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
