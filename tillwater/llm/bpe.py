"""Byte-level BPE of whole texts: overlapping chunk encoding, and decoding.

A text of more than CHUNK characters is cut into chunks that overlap by
OVERLAP characters. Chunks are pre-tokenised independently, in parallel. A
chunk that starts inside a pre-token may begin with wrong boundaries, but from
the first boundary that both neighbours have in their overlap they agree for
good, since a pre-token depends only on what follows its start. The text is
stitched at the first such boundary that isn't behind white space (a pre-token
of white space looks at the character after it, which a piece that ends there
would lack), and the pieces between stitches are encoded, in parallel.
Where an overlap has no common boundary (an unbroken run longer than the
overlap), the text is encoded as one piece. Ids are those of the rank file's
library on the whole text. Shorter texts are one piece and need no shuffle.

Nulls count as empty texts; an empty text has no ids. Rows are independent:
repeated rows and repeated doc_ids each keep their result. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwater.llm.common import text_or_empty, unused

CHUNK = 32_768
OVERLAP = 1_024


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The encoder of a rank file, made once per worker process."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(ranks_path: str) -> list[bytes]:
    with open(ranks_path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, dtype="<u4").tobytes()


def boundaries(body: str, start: int, last: bool, low: int, high: int, pattern: str) -> list[int]:
    """Starts of pre-tokens in [low, high) of the text, as found from ``body``, which starts at ``start``.

    A pre-token that reaches the end of a chunk may go on in the next one, so
    its end is no boundary, unless the chunk is the text's last.
    """
    out = []
    for m in _pattern(pattern).finditer(body):
        at = start + m.start()
        if low <= at < high:
            out.append(at)
        if at >= high:
            break
    if last and low <= start + len(body) < high:
        out.append(start + len(body))
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` of every document."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    short = rows.filter(F.length("text") <= chunk + overlap)
    long = rows.filter(F.length("text") > chunk + overlap).withColumn("_row", F.monotonically_increasing_id())

    def encode_short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "ids": [packed_ids(enc.encode_ordinary(t)) for t in batch["text"]]
            })

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc_id, text in zip(batch["_row"], batch["doc_id"], batch["text"], strict=True):
                starts = range(0, len(text), chunk)
                for at in range(0, len(starts), 64):  # so many chunks at once in memory
                    part = starts[at : at + 64]
                    yield pd.DataFrame({
                        "_row": row, "doc_id": pd.Series([doc_id] * len(part), dtype=batch["doc_id"].dtype),
                        "k": range(at, at + len(part)), "last": [s + chunk >= len(text) for s in part],
                        "body": [text[s : s + chunk + overlap] for s in part],
                    })

    def pretokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            head, tail = [], []
            for k, last, body in zip(batch["k"], batch["last"], batch["body"], strict=True):
                start = k * chunk
                found = boundaries(body, start, last, start, start + len(body), pattern)
                # What comes before a stitch is encoded alone. A pre-token may look ahead over white space
                # behind it, never over anything else, so a text is only stitched behind other characters.
                found = [x for x in found if x > start and not body[x - start - 1].isspace()]
                head.append([x for x in found if x < start + overlap])
                tail.append([x for x in found if x > start + chunk] if not last else [])
            yield batch.assign(head=head, tail=tail)

    def encode_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            ids, body = [], []
            for k, a, b, whole, text in zip(
                batch["k"], batch["cut"], batch["next_cut"], batch["whole"], batch["body"], strict=True
            ):
                if whole:
                    ids.append(None), body.append(text[:chunk])
                else:
                    low = 0 if k == 0 else int(a) - k * chunk
                    piece = text[low:] if pd.isna(b) else text[low : int(b) - k * chunk]
                    ids.append(packed_ids(enc.encode_ordinary(piece))), body.append(None)
            yield pd.DataFrame({
                "_row": batch["_row"], "doc_id": batch["doc_id"], "k": batch["k"], "ids": ids, "body": body,
            })

    def gather(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("k")
        if batch["ids"].isna().any():
            ids = packed_ids(encoding(ranks_path, pattern).encode_ordinary("".join(batch["body"])))
        else:
            ids = b"".join(batch["ids"])
        return pd.DataFrame({"doc_id": batch["doc_id"].iloc[:1], "ids": [ids]})

    spread = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    chunks = long.mapInPandas(cut, f"_row long, doc_id {id_type}, k int, last boolean, body string")
    scanned = chunks.repartition(int(spread), "_row", "k").mapInPandas(
        pretokenise,
        f"_row long, doc_id {id_type}, k int, last boolean, body string, head array<long>, tail array<long>",
    )
    text_order, text_rows = W.partitionBy("_row").orderBy("k"), W.partitionBy("_row")
    stitched = (
        scanned.withColumn("cut", F.array_min(F.array_intersect("head", F.lag("tail").over(text_order))))
        .withColumn("next_cut", F.lead("cut").over(text_order))
        .withColumn("whole", F.max((F.col("k") > 0) & F.col("cut").isNull()).over(text_rows))
        .drop("head", "tail", "last")
    )
    pieces = stitched.repartition(int(spread), "_row", "k").mapInPandas(
        encode_pieces, f"_row long, doc_id {id_type}, k int, ids binary, body string"
    )
    joined = pieces.groupBy("_row").applyInPandas(gather, f"doc_id {id_type}, ids binary")
    out = short.mapInPandas(encode_short, f"doc_id {id_type}, ids binary").unionByName(joined)
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``: the raw bytes of their ids, one after the other. Null ids decode to null."""
    (name,) = unused(encoded.select(*[c for c in encoded.columns if c != "decoded"]), "decoded")

    @F.pandas_udf("binary")
    def raw(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = token_bytes(ranks_path)
        for column in columns:
            yield pd.Series([
                None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist()))
                for x in column
            ], dtype=object)

    return encoded.withColumn(name, raw(F.col(ids)))
