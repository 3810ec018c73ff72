"""Token ids in raw binary shards with a minimal perfect hash index.

A store is a folder:

- ``shard-NNNNN.ids``: ids of documents, one after the other, as little-endian
  unsigned integers of ``width`` bytes, in ascending order of the key (nulls
  first, equal keys by text) within and across shards;
- ``shard-NNNNN.ends``: int64, the count of ids up to the end of each record;
- ``index-NNNNN.mph``: for the keys whose hash falls to the bucket, a minimal
  perfect hash: displacements, then for each slot a stored 32-bit fingerprint,
  shard, record and number of records. A look-up costs one displacement, one
  slot and one fingerprint, whatever the store's size.

Tasks write their files under another name first and then rename them, so a
task that runs twice leaves one whole file. Files go through Arrow's file
systems, so the folder may be local, HDFS or an object store; it lies in the
shared folder. An index bucket is bounded by its number of distinct keys, and
a key with very many records is one entry (records with equal keys are
neighbours, also across shards). A very long text is one record of a shard. An empty
table makes a store without records, in which nothing is found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwater.llm.common import running_base, text_or_empty
from tillwater.llm.tokens import text_ids
from tillwater.session import ensure_checkpoint_dir, stored

#: Distinct keys of an index bucket, about.
BUCKET_KEYS = 8_192
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:/") :].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_file(folder: str, name: str, *parts: bytes) -> None:
    """Write ``parts`` to a new file of the folder, which appears whole or not at all."""
    system, path = _file_system(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    system.move(draft, f"{path}/{name}")


def read_file(folder: str, name: str) -> bytes:
    system, path = _file_system(folder)
    with system.open_input_stream(f"{path}/{name}") as data:
        return data.read()


# The index of one bucket


def build_index(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Displacements, slot of each key, and fingerprint of each key, for distinct pairs of 64-bit hashes.

    Hash and displace: keys fall into groups of about 4; the largest groups
    first, each takes the first displacement that puts its keys on free slots.
    A group of one key takes a free slot outright (displacement -1 - slot).
    """
    m = len(h1)
    groups = max(1, m // 4)
    displaced = np.zeros(groups, np.int64)
    slots = np.full(m, -1, np.int64)
    free = np.ones(m, bool)
    group = (_mix(h1) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=groups)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for g in np.argsort(-counts, kind="stable"):
        keys = order[firsts[g] : firsts[g] + counts[g]]
        if len(keys) < 2:
            break
        for low in range(0, 1 << 26, 512):
            tries = np.arange(low, low + 512, dtype=np.uint64)
            at = _slots(h2[keys][None, :], tries[:, None], m)
            good = free[at].all(axis=1)
            ordered = np.sort(at, axis=1)
            good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                which = int(np.argmax(good))
                displaced[g], slots[keys] = low + which, at[which]
                free[at[which]] = False
                break
        else:
            raise ValueError("two keys have equal hashes")
    left = iter(np.flatnonzero(free))
    for g in np.flatnonzero(counts == 1):
        at = next(left)
        displaced[g], slots[order[firsts[g]]] = -1 - at, at
    return displaced, slots, fingerprints(h1, h2)


def _slots(h2: np.ndarray, displacement: np.ndarray, m: int) -> np.ndarray:
    return (_mix(h2 ^ (displacement * _GOLDEN)) % np.uint64(m)).astype(np.int64)


def fingerprints(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (_mix(h1 * _GOLDEN + h2) >> np.uint64(32)).astype("<u4")


class Index:
    """An index file that has been read."""

    def __init__(self, data: bytes):
        self.m, groups = np.frombuffer(data, "<i8", 2)
        at = 16
        for name, kind, n in (
            ("displaced", "<i8", groups), ("shard", "<i8", self.m), ("record", "<i8", self.m), ("count", "<i8", self.m),
            ("prints", "<u4", self.m),
        ):
            setattr(self, name, np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key, and whether the stored fingerprint is the key's."""
        d = self.displaced[(_mix(h1) % np.uint64(len(self.displaced))).astype(np.int64)]
        slots = np.where(d < 0, -1 - d, _slots(h2, d.astype(np.uint64), int(self.m)))
        return slots, self.prints[slots] == fingerprints(h1, h2)


# Writing


def write(docs: DataFrame, path: str, kind: str = "attached", end_id: int = 2, folder: str | None = None) -> Store:
    """Encode every text (null: empty), append ``end_id``, and write shards and index.

    One shard for each shuffle partition of the session.
    """
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, shard = text_ids(path, kind), TaskContext.get().partitionId()
        system, place = _file_system(folder)
        system.create_dir(place, recursive=True)
        end = int(end_id).to_bytes(encoder.width, "little")
        draft, ends, total = f"{place}/_shard-{shard:05d}.{uuid.uuid4().hex}", [], 0
        with system.open_output_stream(draft) as out:
            for batch in batches:
                ids = [encoder.packed(t) + end for t in batch["text"]]
                n = np.array([len(x) // encoder.width for x in ids], np.int64)
                out.write(b"".join(ids))
                records = np.arange(len(ends), len(ends) + len(ids))
                ends.extend((total + np.cumsum(n)).tolist())
                total += int(n.sum())
                yield pd.DataFrame({"doc_id": batch["doc_id"], "shard": shard, "record": records, "n": n})
        write_file(folder, f"shard-{shard:05d}.ends", np.array(ends, "<i8").tobytes())
        system.move(draft, f"{place}/shard-{shard:05d}.ids")

    placed = rows.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    records = stored(placed.mapInPandas(encode, f"doc_id {id_type}, shard int, record long, n long"))
    made = records.groupBy("shard").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n").alias("n_ids"))
    made = stored(made.coalesce(1))
    bases = running_base(made, "shard", "n_records", "base")
    entries = (
        records.join(F.broadcast(bases), "shard")
        .groupBy("doc_id")
        .agg(
            F.min(F.struct(F.col("base") + F.col("record"), "shard", "record")).alias("first"),
            F.count(F.lit(1)).alias("n_records"),
        )
    )
    entries = stored(entries.select("doc_id", "first.shard", "first.record", "n_records"))
    buckets = max(1, -(-entries.count() // BUCKET_KEYS))

    def index(group: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (group[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        displaced, slots, prints = build_index(h1, h2)
        by_slot = np.argsort(slots)
        columns = [group[c].to_numpy("<i8")[by_slot].tobytes() for c in ("shard", "record", "n_records")]
        head = np.array([len(group), len(displaced)], "<i8").tobytes()
        bucket = int(group["bucket"].iloc[0])
        write_file(folder, f"index-{bucket:05d}.mph", head, displaced.astype("<i8").tobytes(), *columns, prints[by_slot].tobytes())
        return pd.DataFrame({"bucket": [bucket], "keys": [len(group)]})

    stored(_hashed(entries, buckets).groupBy("bucket").applyInPandas(index, "bucket int, keys long"))
    width = text_ids(path, kind).width
    return Store(folder, width, buckets, made)


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null key"))
    hashed = keys.withColumn("h1", F.xxhash64(F.lit(1), key)).withColumn("h2", F.xxhash64(F.lit(2), key))
    return hashed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(3), key), F.lit(buckets)).cast("int"))


# Reading


@lru_cache(maxsize=8)
def _index(folder: str, bucket: int) -> Index:
    return Index(read_file(folder, f"index-{bucket:05d}.mph"))


class Store:
    """A written store. ``made``: shard, n_records, n_ids of each shard."""

    def __init__(self, folder: str, width: int, buckets: int, made: DataFrame):
        self.folder, self.width, self.buckets, self.made = folder, width, buckets, made

    def find(self, keys: DataFrame) -> DataFrame:
        """Place of every record of the keys (column ``doc_id``): ``doc_id``, ``shard``, ``record``.

        A key that isn't in the store has no row (but for one in 2^32, whose fingerprint happens to fit).
        """
        folder = self.folder
        id_type = keys.schema["doc_id"].dataType.simpleString()
        sizes = dict(self.made.select("shard", "n_records").collect())  # a number for each shard

        def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for bucket, group in batch.groupby("bucket"):
                    found = _index(folder, int(bucket))
                    slots, there = found.find(*(group[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2")))
                    group, slots = group[there], slots[there]
                    one = found.count[slots] == 1
                    yield pd.DataFrame({
                        "doc_id": group["doc_id"][one], "shard": found.shard[slots[one]], "record": found.record[slots[one]],
                    })
                    for doc_id, slot in zip(group["doc_id"][~one], slots[~one], strict=True):
                        shard, record, left = int(found.shard[slot]), int(found.record[slot]), int(found.count[slot])
                        while left:
                            n = min(left, 10_000, sizes.get(shard, 0) - record)
                            if n > 0:
                                yield pd.DataFrame({
                                    "doc_id": pd.Series([doc_id] * n, dtype=batch["doc_id"].dtype), "shard": shard,
                                    "record": np.arange(record, record + n),
                                })
                                left, record = left - n, record + n
                            else:
                                shard, record = shard + 1, 0

        hashed = _hashed(keys.select("doc_id").distinct(), self.buckets)
        spread = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return hashed.repartition(spread, "bucket").mapInPandas(
            look_up, f"doc_id {id_type}, shard int, record long"
        )

    def read(self, places: DataFrame) -> DataFrame:
        """Ids of records: ``doc_id``, ``shard``, ``record``, ``start``, ``n_tokens``, ``ids`` (binary, 32-bit).

        ``start`` counts the ids of all records before it in the store.
        """
        folder, width = self.folder, self.width
        id_type = places.schema["doc_id"].dataType.simpleString()

        def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            system, path = _file_system(folder)
            ends, data, at = None, None, None
            for batch in batches:
                for shard, group in batch.groupby("shard"):
                    if shard != at:
                        if data is not None:
                            data.close()
                        ends = np.frombuffer(read_file(folder, f"shard-{shard:05d}.ends"), "<i8")
                        data, at = system.open_input_file(f"{path}/shard-{shard:05d}.ids"), shard
                    records = group["record"].to_numpy()
                    high = ends[records]
                    low = np.where(records > 0, ends[records - 1], 0)
                    ids = [
                        np.frombuffer(data.read_at(int(b - a) * width, int(a) * width), f"<u{width}").astype("<u4").tobytes()
                        for a, b in zip(low, high, strict=True)
                    ]
                    yield pd.DataFrame({
                        "doc_id": group["doc_id"], "shard": shard, "record": records, "start_in_shard": low,
                        "n_tokens": high - low, "ids": ids,
                    })

        spread = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = places.repartition(spread, "shard").sortWithinPartitions("shard", "record").mapInPandas(
            fetch, f"doc_id {id_type}, shard int, record long, start_in_shard long, n_tokens long, ids binary"
        )
        bases = running_base(self.made, "shard", "n_ids", "base")  # a row for each shard
        return rows.join(F.broadcast(bases), "shard").select(
            "doc_id", "shard", "record", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids"
        )

