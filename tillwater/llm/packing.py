"""Concatenate and cut: documents packed into sequences without gaps.

First pass: every task tokenises its documents and writes their ids, with the
running count inside the task, to the shared folder. The tasks' totals are
summed in order (one number a task), which gives every document its global
offset. Second pass: fixed windows of ``length`` ids are laid over the
offsets; a document's part in a window is a piece, and pieces that end at a
window's border are the boundary records. Only the last sequence has room
left. No row is moved in either pass.

The order is that of the rows in the stored table: files and rows as Spark
reads them. A null text counts as empty; every document has its end id, so
each has at least one piece. Repeated rows and ids are packed one by one, so no tie needs settling. A very long
text is cut into as many pieces as it takes. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwater.llm.common import running_base, text_or_empty
from tillwater.llm.tokens import text_ids
from tillwater.session import ensure_checkpoint_dir

LENGTH = 2_048


def tokenised(docs: DataFrame, path: str, kind: str, end_id: int) -> DataFrame:
    """First pass, written down: ``doc_id``, ``part``, ``before`` (ids before it in its part), ``n``, ``ids`` (32-bit)."""
    import uuid

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, before = text_ids(path, kind), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [encoder.unsigned32(encoder.packed(t)) + end for t in batch["text"]]
            n = pd.Series([len(x) // 4 for x in ids], dtype="int64", index=batch.index)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "part": part, "before": before + n.cumsum() - n, "n": n, "ids": ids
            })
            before += int(n.sum())

    spark = docs.sparkSession
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    out = rows.mapInPandas(encode, f"doc_id {id_type}, part int, before long, n long, ids binary")
    out.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(out.schema).parquet(at)


def pieces(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Second pass: one row a piece.

    ``doc_id``, ``start``, ``length``, ``ids`` (binary), ``doc_tokens``,
    ``sequence_id``, ``offset``, ``padded_length`` (of the piece's sequence:
    ``length``, except that a last sequence filled to a power of two needs no
    padding) and ``boundary`` (whether the document goes on in the next sequence).
    """
    parts = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    base = running_base(parts, "part", "total", "base")
    # A row for each task of the first pass, and one row: both are bounded by the plan, not by the data.
    total = parts.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("all_ids"))
    placed = tokens.join(F.broadcast(base), "part").withColumn("at", F.col("base") + F.col("before"))
    windows = F.sequence(F.expr(f"`at` div {length}"), F.expr(f"(`at` + n - 1) div {length}"))
    cut = placed.withColumn("sequence_id", F.explode(windows))
    border = F.col("sequence_id") * length
    start = F.greatest(border - F.col("at"), F.lit(0))
    size = F.least(border + length - F.col("at"), F.col("n")) - start
    cut = cut.withColumn("start", start).withColumn("length", size)
    cut = cut.crossJoin(F.broadcast(total))  # a single row
    room = F.least(F.lit(length), F.col("all_ids") - border)
    return cut.select(
        "doc_id", "start", "length",
        F.expr("substring(ids, int(start * 4 + 1), int(length * 4))").alias("ids"),
        F.col("n").alias("doc_tokens"), "sequence_id",
        (F.col("at") + F.col("start") - border).alias("offset"),
        F.when(room.bitwiseAND(room - 1) == 0, room).otherwise(F.lit(length)).alias("padded_length"),
        (F.col("start") + F.col("length") < F.col("n")).alias("boundary"),
    )


def pack(docs: DataFrame, path: str, kind: str = "dropped", end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Both passes."""
    return pieces(tokenised(docs, path, kind, end_id), length)
