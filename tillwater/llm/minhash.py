"""Near-duplicate documents by improved consistent weighted sampling.

A document is its shingles of five words, each weighted by its count in the
document times an inverse document frequency. Improved consistent weighted
sampling draws ROWS * BANDS samples of the weighted set; two documents agree on
a sample with the probability of their weighted Jaccard similarity. Documents
that agree on all ROWS samples of a band are candidates; candidates are
verified by the weighted Jaccard similarity of their whole texts, and classes
are the connected components of pairs at SIMILARITY or more.

- Equal texts are one node from the start (keyed by 128-bit text hash), so a
  text with millions of copies is sketched into one row a band.
- Inverse document frequency: 1 + ln(N / df). Counts cover all documents. With a
  ``share`` of 0 (as the queries have it), every shingle has its own: chunks of texts
  ask buckets of shingles, which add up and answer, and a text carries the
  frequencies of its shingles from there on. Chunks and buckets are as many as each
  other, so that a chunk asks a bucket for the same amount, whatever the corpus.
- With a ``share``, a shingle in fewer than share * N documents counts as one in
  share * N. Common shingles are few whatever the corpus (a document's mean shingles /
  share at most), which bounds the table that is broadcast; they are found in two
  exact passes: upper bounds of the counts by partition leave few candidates, which are then counted.
- Two texts of a band's group are compared unless they are known to be in one
  component, in groups of any size. Every member meets the group's most central
  node (whose band groups are the largest). Where a group then still spans
  several components, members outside the largest one meet the most central
  members, up to EXACT_GROUP of them, which is all of a small group. What larger
  groups are still split after that is finished in blocks: blocks of members
  outside the largest component meet all blocks of the group, as one row a pair
  of blocks, and all their pairs are compared at once.

Nulls: a null text is no copy of any other, and its own class. An empty text
equals other empty texts. A text of one to four words is one shingle. A null
doc_id takes part; a class is named by its smallest doc_id that isn't null.
Repeated rows are copies of each other. Very long texts are compared whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tillwater.llm import wordhash
from tillwater.llm.common import make_room, text_or_empty, unused
from tillwater.session import stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 3
#: From this share of documents on, a shingle counts as common (0: frequencies of all shingles).
COMMON = 0.2
#: Text bytes, on average, of what a chunk of texts asks a bucket of shingles.
TILE_BYTES = 1 << 14
#: Band groups of at most this size meet whole in the first round; larger ones that stay split are finished in blocks.
EXACT_GROUP = 15
#: Members and text bytes of a block, on average at most.
BLOCK, BLOCK_BYTES = 256, 1 << 19
#: So many shingles of a partition wait to be counted.
HELD = 1 << 19
#: Text bytes that a worker looks at together; hashing and sorting takes some 30 times as much memory.
SLICE_BYTES = 1 << 20
#: Shingles are told apart by this many bits within a document.
ID_BITS = 48
_ID_MASK = np.uint64((1 << ID_BITS) - 1)


# Weighted shingle sets of a batch


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle id and count of each distinct shingle, ordered by text and id. At most 65,536 texts."""
    hashes, before, *_ = wordhash.words(texts)
    owner = wordhash.text_of_word(before)
    shingles = wordhash.windows(hashes, SHINGLE)
    good = owner[: len(shingles)] == owner[SHINGLE - 1 :] if len(shingles) else np.zeros(0, bool)
    keys = (owner[: len(shingles)][good].astype(np.uint64) << np.uint64(ID_BITS)) | (shingles[good] & _ID_MASK)
    sizes = np.diff(before)
    short = []
    for n in range(1, SHINGLE):
        at = np.flatnonzero(sizes == n)
        if len(at):
            whole = np.full(len(at), n, np.uint64)
            for i in range(n):
                whole = wordhash.mix(whole * np.uint64(0x9E3779B97F4A7C15) + hashes[before[at] + i])
            short.append((at.astype(np.uint64) << np.uint64(ID_BITS)) | (whole & _ID_MASK))
    keys = np.sort(np.concatenate([keys, *short]))
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    counts = np.diff(np.append(firsts, len(keys)))
    keys = keys[firsts]
    return (keys >> np.uint64(ID_BITS)).astype(np.int64), keys & _ID_MASK, counts


class Weights:
    """Inverse document frequencies: of the shingles given one by one, and of all others.

    With a ``share`` the others are in that share of the documents, and those given in no less. With 0, nothing is given for
    all texts: ``local`` has the frequencies that some texts bear.
    """

    def __init__(self, ids: np.ndarray, documents: np.ndarray, total: int, share: float = COMMON):
        order = np.argsort(ids)
        self.ids = np.append(ids[order], np.uint64(1 << 63))
        self.total, self.share = max(total, 1), share
        self.rare = 1.0 + np.log(1.0 / (share or 1.0 / self.total))
        self.values = np.append(self.by_count(documents[order]), self.rare)

    def by_count(self, documents: np.ndarray) -> np.ndarray:
        """Inverse frequency of shingles in so many documents."""
        return np.minimum(1.0 + np.log(self.total / np.maximum(documents, 1)), self.rare)

    def of(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if len(self.ids) == 1:
            return counts * self.rare
        at = np.searchsorted(self.ids, ids)
        return counts * np.where(self.ids[at] == ids, self.values[at], self.rare)

    def local(self, *sides: tuple[pa.Array, pa.Array]) -> Weights:
        """Weights for some texts, given as texts and the frequencies of their shingles (see ``frequency_sketches``)."""
        if self.share:
            return self
        ids = np.concatenate([shingle_sets(texts)[1] for texts, _ in sides])
        documents = np.frombuffer(b"".join(b for _, held in sides for b in held.to_pylist()), "<u4")
        ids, at = np.unique(ids, return_index=True)
        return Weights(ids, documents[at], self.total, 0)


def parts(batch: pa.RecordBatch, *columns: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most about ``size`` bytes over all the text columns named (or one row) and 4,096 rows."""
    make_room("minhash")
    at = sum(wordhash.buffer_of(batch.column(c))[1] for c in columns or ("text",))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(at, at[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + 4_096)
        yield batch.slice(lo, hi - lo)
        lo = hi


# Document frequencies


def common_shingles(texts: DataFrame, share: float = COMMON) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and document counts of shingles in at least ``share`` of all rows of ``texts``, and the number of rows."""

    def counted(batches, least):
        """Shingles of a partition that may be in ``least`` of its texts (lossy counting).

        ``n`` is what a shingle has at most: its count since it came, and before that the
        ``bound`` of the last merge, which no shingle that was let go had exceeded.
        """
        ids, n, rows = np.zeros(0, np.uint64), np.zeros(0), 0
        waiting, held, bound = [], 0, 0.0

        def merge():
            unique, count = np.unique(np.concatenate(waiting or [ids[:0]]), return_counts=True)
            every = np.union1d(ids, unique)
            most = np.full(len(every), bound)
            most[np.searchsorted(every, ids)] = n
            most[np.searchsorted(every, unique)] += count
            limit = least * rows / 2
            stay = most > limit
            return every[stay], most[stay], limit

        for batch in batches:
            for part in parts(batch):
                found = shingle_sets(part.column("text"))[1]
                waiting.append(found)
                held, rows = held + len(found), rows + part.num_rows
                if held > HELD:
                    ids, n, bound = merge()
                    waiting, held = [], 0
        ids, n, bound = merge()
        # A little below, for rounding.
        stay = n >= least * rows - 1e-6
        return ids[stay], n[stay], rows

    half = share / 2

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, rows = counted(batches, half)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids.view(np.int64).tolist() + [None], pa.int64()),
                pa.array(np.append(n - half * rows, 0.0)), pa.array([0] * len(ids) + [rows], pa.int64()),
            ],
            ["id", "above", "rows"],
        )

    # Where a partition doesn't name a shingle, fewer than half of ``share`` of its texts have it. So a shingle in ``share`` of
    # all texts is above that half by as much again in the partitions that name it, and no more than
    # 2 / share of a mean text's shingles can be: these are collected, whatever the partitions' sizes.
    first = stored(texts.select("text").mapInArrow(candidates, "id long, above double, rows long"))
    total = first.filter("id is null").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    above = first.filter("id is not null").groupBy("id").agg(F.sum("above").alias("above"))
    likely = above.filter(F.col("above") >= half * total - 1e-3).select("id").collect()
    wanted = np.array(sorted(r["id"] for r in likely), np.int64).view(np.uint64)
    if not len(wanted):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), total

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for part in parts(batch):
                found = shingle_sets(part.column("text"))[1]
                at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                n += np.bincount(at[wanted[at] == found], minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(wanted.view(np.int64)), pa.array(n)], ["id", "n"])

    exact = texts.select("text").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted((np.uint64(r["id"] % (1 << 64)), r["n"]) for r in exact.filter(F.col("n") >= share * total).collect())
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), total


def packed(ids: np.ndarray) -> bytes:
    """Ascending shingle ids as their differences, byte by byte of all of them, so that the high bytes compress."""
    return np.diff(ids, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : ID_BITS // 8].T.tobytes()


def unpacked(held: bytes) -> np.ndarray:
    planes = np.frombuffer(held, np.uint8).reshape(ID_BITS // 8, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : ID_BITS // 8] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def chunk_sets(chunk: pa.Table) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Parts of a chunk of texts with their shingle sets, the chunk's shingles, and the place there of each shingle of the sets."""
    found = [(part, *shingle_sets(part.column("text"))) for batch in chunk.to_batches() for part in parts(batch)]
    every, at = np.unique(np.concatenate([ids for _, _, ids, _ in found]), return_inverse=True)
    return found, every, at


def frequency_sketches(texts: DataFrame, total: int, size: int) -> DataFrame:
    """``node``, ``keys`` (one a band) and ``frequent`` of every text with a word, with the frequencies of all shingles.

    ``texts`` has ``node``, ``text`` and ``copies`` of distinct texts, of ``size`` bytes, ``total`` with all copies.
    ``frequent`` holds in how many of these each shingle of the text is (32 bits each, in the order of ``shingle_sets``).
    Chunk and bucket are held by a task; their size grows with the square root of ``size`` (4 MB of text at 1 GB).
    """
    n = int(min(max(np.ceil(np.sqrt(size / TILE_BYTES)), 1), 1 << 15))
    weights = Weights(np.zeros(0, np.uint64), np.zeros(0, np.int64), total, 0)
    schema = pa.schema([("node", pa.binary()), ("keys", pa.list_(pa.int64())), ("frequent", pa.binary())])

    def ask(chunk: pa.Table) -> pa.Table:
        found, every, at = chunk_sets(chunk)
        copies = np.concatenate([part.column("copies").to_numpy()[owner] for part, owner, _, _ in found])
        documents = np.bincount(at, copies, len(every)).astype("<u4")
        # Buckets are ranges of ids, which are hashes.
        cuts = np.searchsorted((every * np.uint64(n)) >> np.uint64(ID_BITS), np.arange(n + 1, dtype=np.uint64))
        asked = np.flatnonzero(np.diff(cuts))
        return pa.table({
            "chunk": pa.array(np.full(len(asked), chunk.column("chunk")[0].as_py(), np.int32)), "bucket": pa.array(asked.astype(np.int32)),
            "ids": pa.array([packed(every[cuts[b] : cuts[b + 1]]) for b in asked], pa.binary()),
            "n": pa.array([documents[cuts[b] : cuts[b + 1]].tobytes() for b in asked], pa.binary()),
        })

    def answer(bucket: pa.Table) -> pa.Table:
        ids = [unpacked(held) for held in bucket.column("ids").to_pylist()]
        asked = np.frombuffer(b"".join(bucket.column("n").to_pylist()), "<u4")
        every, at = np.unique(np.concatenate(ids), return_inverse=True)
        documents = np.bincount(at, asked, len(every)).astype("<u4")[at]
        cuts = np.cumsum([0, *map(len, ids)])
        held = [documents[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])]
        return pa.table({"chunk": bucket.column("chunk"), "bucket": bucket.column("bucket"), "n": pa.array(held, pa.binary())})

    def sketch(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        found, _, at = chunk_sets(chunk)
        heard = np.frombuffer(b"".join(answers.sort_by("bucket").column("n").to_pylist()), "<u4")
        out, lo = [], 0
        for part, owner, ids, counts in found:
            documents, lo = heard[at[lo : lo + len(ids)]], lo + len(ids)
            if not len(ids):
                continue
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            keys = band_keys(samples(ids, counts * weights.by_count(documents), starts))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
            ends = pa.py_buffer((np.append(starts, len(ids)) * 4).astype(np.int32))
            held = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(documents.astype("<u4"))])
            node = part.column("node").take(pa.array(owner[starts])).cast(pa.binary())
            out.append(pa.RecordBatch.from_arrays([node, lists, held], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    chunked = texts.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(n)).cast("int"))
    asked = chunked.groupBy("chunk").applyInArrow(ask, "chunk int, bucket int, ids binary, n binary")
    answers = stored(asked.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, n binary"))
    both = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInArrow(sketch, "node binary, keys array<long>, frequent binary")


# Sampling


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), their logarithms, and of the uniform distribution, at 65,536 midpoints."""
    p = (np.arange(65_536) + 0.5) / 65_536
    low, high = np.zeros_like(p), np.full_like(p, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    gamma = (low + high) / 2
    return gamma.astype(np.float32), np.log(gamma).astype(np.float32), p.astype(np.float32)


_GAMMA, _LOG_GAMMA, _UNIFORM = _tables()
_INVERSE_GAMMA = (1 / _GAMMA).astype(np.float32)
_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def samples(ids: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One column a sample, one row a set; sets are slices of ``ids`` from ``starts`` on.

    A sample is the least ln(a) of the set's elements. It depends on the
    element and its quantised weight alone, so equal values stand for equal
    (element, quantised weight).
    """
    out = np.empty((len(starts), len(_SEEDS)), np.float32)
    log_weight = np.log(weights).astype(np.float32)
    lo = 0
    ends = np.append(starts[1:], len(ids))
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 32_768, side="right")))
        own, lw = ids[starts[lo] : ends[hi - 1]], log_weight[starts[lo] : ends[hi - 1]]
        at = starts[lo:hi] - starts[lo]
        for k, seed in enumerate(_SEEDS):
            z = own ^ seed
            z *= np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(29)
            z *= np.uint64(0x94D049BB133111EB)
            z >>= np.uint64(16)
            i = (z & np.uint64(0xFFFF)).astype(np.int32)
            j = ((z >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int32)
            b = _UNIFORM[(z >> np.uint64(32)).astype(np.int32)]
            t = lw * _INVERSE_GAMMA[i]
            t += b
            np.floor(t, out=t)
            t -= b
            t += np.float32(1)
            t *= _GAMMA[i]
            out[lo:hi, k] = np.minimum.reduceat(_LOG_GAMMA[j] - t, at)
        lo = hi
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of samples."""
    bits = found.view(np.uint32).astype(np.uint64)
    keys = np.empty((len(found), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(found), band + 1, np.uint64)
        for row in range(ROWS):
            key = wordhash.mix(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, band * ROWS + row])
        keys[:, band] = key
    return keys


# Nodes, links, classes


def with_node(docs: DataFrame, name: str = "node") -> DataFrame:
    """Rows with their text's 128-bit hash (null for a null text)."""
    return docs.withColumn(name, F.unhex(F.md5(F.col("text").cast("binary"))))


def sketches(nodes: DataFrame, weights: Weights) -> DataFrame:
    """``node`` and ``keys`` (one a band) of every distinct text with a word, and no ``frequent``: the weights have it all."""
    schema = pa.schema([("node", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                owner, ids, counts = shingle_sets(part.column("text"))
                if not len(ids):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                keys = band_keys(samples(ids, weights.of(ids, counts), starts))
                node = part.column("node").take(pa.array(owner[starts]))
                flat = pa.array(keys.ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
                yield pa.RecordBatch.from_arrays([node.cast(pa.binary()), lists], schema=schema)

    made = nodes.select("node", "text").mapInArrow(sketch, "node binary, keys array<long>")
    return made.groupBy("node").agg(F.first("keys").alias("keys")).withColumn("frequent", F.lit(None).cast("binary"))


def similarities(left: pa.Array, right: pa.Array, weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    sides = []
    for texts in (left, right):
        owner, ids, counts = shingle_sets(texts)
        sides.append(((owner.astype(np.uint64) << np.uint64(ID_BITS)) | ids, owner, weights.of(ids, counts)))
    (ka, oa, wa), (kb, ob, wb) = sides
    n = len(left)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.bincount(oa[ia], np.minimum(wa[ia], wb[ib]), n)
    total = np.bincount(oa, wa, n) + np.bincount(ob, wb, n) - both
    return np.where(total > 0, both / np.where(total > 0, total, 1), 1.0)


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, least: float = SIMILARITY) -> DataFrame:
    """The pairs ``a``, ``b`` whose texts are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", "text_b"):
                a, b = part.column("text"), part.column("text_b")
                good = similarities(a, b, weights.local((a, part.column("frequent")), (b, part.column("frequent_b")))) >= least
                yield part.select(["a", "b"]).filter(pa.array(good))

    # Texts grow with the input: they are never broadcast, however small a corpus is.
    with_a = pairs.join(texts.withColumnRenamed("node", "a").hint("merge"), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"), F.col("frequent").alias("frequent_b")).hint("merge"), "b")
    return with_b.select("a", "b", "text", "text_b", "frequent", "frequent_b").mapInArrow(check, "a binary, b binary")


def overlaps(left: tuple, right: tuple, n: int, m: int, weights: Weights) -> np.ndarray:
    """Weight that each of ``n`` sets shares with each of ``m`` others, to a relative error under 3e-4."""
    columns = []
    common = np.intersect1d(left[1], right[1])
    for owner, ids, counts in (left, right):
        at = np.minimum(np.searchsorted(common, ids), max(len(common) - 1, 0))
        here = np.flatnonzero(common[at] == ids) if len(common) else np.zeros(0, np.int64)
        times = counts[here]
        # An element that occurs c times stands in c columns, so that a product of matrices adds up least counts.
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        columns.append((np.repeat(owner[here], times), (np.repeat(at[here], times).astype(np.int64) << 32) | nth))
    (oa, ca), (ob, cb) = columns
    both = np.intersect1d(ca, cb)
    shared = np.zeros((n, m))
    sides = []
    for o, c in ((oa, ca), (ob, cb)):
        at = np.minimum(np.searchsorted(both, c), max(len(both) - 1, 0))
        here = np.flatnonzero(both[at] == c) if len(both) else np.zeros(0, np.int64)
        order = np.argsort(at[here], kind="stable")
        sides.append((o[here][order], at[here][order]))
    value = weights.of(common[both >> 32], np.ones(len(both))).astype(np.float32)
    for lo in range(0, len(both), 4_096):
        hi = min(lo + 4_096, len(both))
        dense = []
        for (o, at), rows in zip(sides, (n, m)):
            part = slice(*np.searchsorted(at, [lo, hi]))
            matrix = np.zeros((rows, hi - lo), np.float32)
            matrix[o[part], at[part] - lo] = 1
            dense.append(matrix)
        shared += (dense[0] * value[lo:hi]) @ dense[1].T
    return shared


def joins(left: pa.StructArray, right: pa.StructArray, weights: Weights, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of similar pairs of two blocks: of all pairs across labels, enough to join all labels that any of them joins."""
    (_, la, ta), (_, lb, tb) = left.flatten(), right.flatten()
    n, m = len(left), len(right)
    labels = np.unique(np.array(la.to_pylist() + lb.to_pylist(), object), return_inverse=True)[1]
    sets = [shingle_sets(t) for t in (ta, tb)]
    wa, wb = (np.bincount(o, weights.of(i, c), k) for (o, i, c), k in zip(sets, (n, m)))
    shared = overlaps(*sets, n, m, weights)
    alike = shared / np.maximum(wa[:, None] + wb[None, :] - shared, 1e-9)
    maybe = (alike >= least - 1e-3) & (labels[:n, None] != labels[None, n:])
    above = list(range(n + m))

    def root(x):
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    out = []
    # Pairs nearer to the threshold than the error of the products are compared once more.
    sure, near = (np.argwhere(maybe & x) for x in (alike >= least + 1e-3, alike < least + 1e-3))
    for places, exact in ((sure, True), (near, False)):
        for lo in range(0, len(places), 256):
            todo = [(i, j) for i, j in places[lo : lo + 256].tolist() if root(labels[i]) != root(labels[n + j])]
            if not todo:
                continue
            if not exact:
                i, j = np.array(todo).T
                good = similarities(ta.take(pa.array(i)), tb.take(pa.array(j)), weights) >= least
                todo = [pair for pair, g in zip(todo, good) if g]
            for i, j in todo:
                x, y = root(labels[i]), root(labels[n + j])
                if x != y:
                    above[x] = y
                    out.append((i, j))
    i, j = np.array(out, np.int64).reshape(-1, 2).T
    return i, j


def block_links(split: DataFrame, texts: DataFrame, weights: Weights, least: float = SIMILARITY) -> DataFrame:
    """Links ``a``, ``b`` that join the components of each group as far as any of its pairs does.

    ``split`` has ``key``, ``node``, ``label`` and ``largest`` of whole groups. Members are
    dealt to blocks by hash, those of the largest component (0, 1, ...) apart from the others
    (-1, -2, ...). A block of the others meets all blocks of the largest, itself, and the
    others' blocks after it.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ours, theirs in zip(batch.column("members"), batch.column("others")):
                sides = [block.values.flatten() for block in (ours, theirs)]
                left, right = (pa.StructArray.from_arrays(side[:3], ["node", "label", "text"]) for side in sides)
                i, j = joins(left, right, weights.local(*((side[2], side[3]) for side in sides)), least)
                a = ours.values.field("node").take(pa.array(i)).cast(pa.binary())
                b = theirs.values.field("node").take(pa.array(j)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    outside = F.col("label") != F.col("largest")
    sized = split.join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
    count = lambda side: F.ceil(F.greatest(
        F.count(F.when(side, 1)) / BLOCK, F.coalesce(F.sum(F.when(side, F.col("bytes"))), F.lit(0)) / BLOCK_BYTES, F.lit(1.0)
    )).cast("int")
    numbers = sized.groupBy("key").agg(count(outside).alias("n_out"), count(~outside).alias("n_in"))
    dealt = F.pmod(F.xxhash64("node"), F.when(outside, F.col("n_out")).otherwise(F.col("n_in"))).cast("int")
    placed = split.join(numbers, "key").select("key", "node", "label", "n_out", "n_in", F.when(outside, -1 - dealt).otherwise(dealt).alias("block"))
    blocks = placed.join(texts.hint("merge"), "node").groupBy("key", "block", "n_out", "n_in")
    blocks = stored(blocks.agg(F.collect_list(F.struct("node", "label", "text", "frequent")).alias("members")))
    partners = F.expr("concat(sequence(0, n_in - 1), sequence(block, -n_out, -1))")
    asked = blocks.filter("block < 0").select("key", "members", F.explode(partners).alias("block"))
    others = blocks.select("key", "block", F.col("members").alias("others"))
    return asked.join(others.hint("merge"), ["key", "block"]).select("members", "others").mapInArrow(compare, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the component's least node) of all nodes with a link. Labels spread by joins, with shortcuts."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        heard = both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("of")).agg(F.min("label").alias("heard"))
        nearer = label.join(heard, label["node"] == heard["of"]).select("node", "label", F.least("label", "heard").alias("near"))
        jump = label.select(F.col("node").alias("near"), F.col("label").alias("far"))
        moved = stored(nearer.join(jump, "near", "left").select("node", "label", F.least("near", F.coalesce("far", "near")).alias("next")))
        changed = moved.filter(F.col("next") != F.col("label")).limit(1).count()
        label = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return label


def classes_of_nodes(docs: DataFrame, least: float = SIMILARITY, share: float = COMMON) -> DataFrame:
    """``node`` and ``label`` of the nodes that have a near-duplicate."""
    nodes = with_node(docs.select("text").filter(F.col("text").isNotNull()))
    whole = stored(nodes.groupBy("node").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")))
    if share:
        weights = Weights(*common_shingles(nodes.select(text_or_empty().alias("text")), share), share)
        sketched = stored(sketches(whole, weights))
    else:
        total, size = whole.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        weights = Weights(np.zeros(0, np.uint64), np.zeros(0, np.int64), total, 0)
        sketched = stored(frequency_sketches(whole, total, size))
    keyed = sketched.select("node", F.explode("keys").alias("key"))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = keyed.join(groups, "key")
    # The node with the largest groups is the likeliest centre of its copies.
    central = members.groupBy("node").agg(F.sum("size").alias("score"))
    members = stored(members.join(central, "node"))
    hubs = members.groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("other"))
    pairs = stored(members.join(hubs, "key").filter("node <> other").select(*_ends()).distinct())
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    needed = whole.select("node", "text").join(wanted.hint("merge"), "node", "left_semi")
    texts = stored(needed.join(sketched.select("node", "frequent").hint("merge"), "node"))
    links = stored(verified(pairs, texts, weights, least))
    labels = components(links)
    # Groups that span several components: members outside the largest meet further members, the central ones first.
    order = W.partitionBy("key").orderBy(F.desc("score"), F.desc("node"))
    left = members.select("key", "node", "score")
    for low, high in ((2, 3), (4, EXACT_GROUP)):
        # Small groups meet whole in the first round.
        last = F.when(F.col("size") <= EXACT_GROUP, F.lit(EXACT_GROUP if low == 2 else 0)).otherwise(F.lit(high))
        tagged = stored(_split(left, labels).withColumn("last", last))
        # A literal bound on the row number lets Spark keep so few rows a key and task.
        ranked = tagged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= EXACT_GROUP)
        # A node meets the same members in several groups: the lists, bounded by EXACT_GROUP a group, are united before they are expanded.
        chosen = ranked.filter(F.col("rank").between(F.lit(low), F.col("last"))).groupBy("key")
        chosen = chosen.agg(F.collect_list(F.struct(F.col("node").alias("other"), F.col("label").alias("far"))).alias("others"))
        met = tagged.filter("label <> largest").select("key", "node", "label").join(chosen, "key")
        met = met.groupBy("node", "label").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
        met = met.select("node", F.explode(F.expr("filter(others, x -> x.far <> label)")["other"]).alias("other"))
        new = stored(met.select(*_ends()).distinct().join(pairs, ["a", "b"], "left_anti"))
        wanted = new.select(F.col("a").alias("node")).union(new.select("b")).distinct()
        found = stored(verified(new, texts.join(wanted, "node", "left_semi"), weights, least))
        if found.limit(1).count():
            links = links.union(found)
            labels = components(links)
        left = tagged.filter(F.col("size") > EXACT_GROUP).select("key", "node", "score")
        if not left.limit(1).count():
            return labels
        pairs = pairs.union(new)
    # Large groups that are still split: all pairs that are left, in blocks.
    split = stored(_split(left, labels))
    if not split.limit(1).count():
        return labels
    found = stored(block_links(split, texts, weights, least))
    return components(links.union(found)) if found.limit(1).count() else labels


def _split(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their label, of groups that span several components, and the group's largest label and size."""
    tagged = members.join(labels, "node", "left").select("key", "node", "score", F.coalesce("label", "node").alias("label"))
    sizes = tagged.groupBy("key", "label").count()
    most = sizes.groupBy("key").agg(
        F.max_by("label", F.struct("count", "label")).alias("largest"), F.count(F.lit(1)).alias("n"), F.sum("count").alias("size")
    )
    return tagged.join(most.filter("n > 1").select("key", "largest", "size"), "key")


def _ends() -> tuple[Column, Column]:
    return F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")


def classes(docs: DataFrame, least: float = SIMILARITY, share: float = COMMON) -> DataFrame:
    """``doc_id``, ``class_id`` (least doc_id of the class) and ``class_size`` of every document."""
    labels = classes_of_nodes(docs, least, share)
    rows = with_node(docs.select("doc_id", "text")).select("doc_id", "node")
    tagged = rows.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    known = tagged.filter(F.col("label").isNotNull())
    named = known.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    out = tagged.join(named, "label", "left")
    return out.select(
        "doc_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )


def keep_one(docs: DataFrame, least: float = SIMILARITY, share: float = COMMON) -> DataFrame:
    """One row of each class, that with the least doc_id (nulls last), with the columns of ``docs``. Null texts all stay."""
    labels = classes_of_nodes(docs, least, share)
    node, row, nth = unused(docs, "_node", "_row", "_nth")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Rows are told apart by what they hold, so that a task that runs again chooses the same ones.
    held = [F.map_entries(c) if isinstance(f.dataType, MapType) else c for c, f in zip(columns, docs.schema, strict=True)]
    numbered = docs.filter(F.col("text").isNotNull())
    numbered = numbered.withColumn(node, F.unhex(F.md5(F.col("text").cast("binary")))).withColumn(row, F.xxhash64(*held))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(row).alias("row"))
    firsts = numbered.select(F.col(node).alias("node"), order.alias("o")).groupBy("node").agg(F.min("o").alias("o"))
    firsts = firsts.join(labels, "node", "left").select("node", "o", F.coalesce("label", "node").alias("l"))
    kept = firsts.groupBy("l").agg(F.min_by(F.struct("node", "o"), F.col("o")).alias("k"))
    kept = stored(kept.select(F.col("k.node").alias(node), F.col("k.o.row").alias(row)))
    # Of rows alike in all columns, one.
    one = F.row_number().over(W.partitionBy(node, row).orderBy(F.lit(1)))
    found = numbered.join(kept, [node, row]).withColumn(nth, one).filter(F.col(nth) == 1)
    return docs.filter(F.col("text").isNull()).unionByName(found.select(*columns))
