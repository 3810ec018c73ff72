"""Helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def text_or_empty(column: str | Column = "text") -> Column:
    """The text, where a null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs of characters outside SPACES, unchanged."""
    flat = F.translate(text, SPACES, " " * len(SPACES))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def without_spaces(text: Column) -> Column:
    """The text less its word separators."""
    return F.translate(text, SPACES, "")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` bears them in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def kept_rows(df: DataFrame, keep: Column, replace: dict[str, Column] | None = None) -> DataFrame:
    """Rows that pass ``keep``, with the columns of ``df`` in their order; ``replace`` gives new values."""
    replace = replace or {}
    (flag,) = unused(df, "_keep")
    marked = df.withColumn(flag, keep).filter(F.col(flag))
    return marked.select(*[(replace[c] if c in replace else F.col(f"`{c}`")).alias(c) for c in df.columns])


def running_base(totals: DataFrame, part: str, total: str, base: str) -> DataFrame:
    """Second pass of a prefix sum: one row a partition becomes (part, base), base the total of all earlier parts.

    ``totals`` has as many rows as the job has partitions, so one task may order them.
    """
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum(total).over(earlier), F.lit(0)).cast("long").alias(base))


#: What operators keep in this Python worker between tasks, and how to let go of it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(owner: str, let_go: Callable[[], None]) -> None:
    """Called in a worker by an operator that keeps much memory from one task to the next."""
    _kept[owner] = let_go


def make_room(owner: str) -> None:
    """Called in a worker by an operator that needs memory: what other operators keep there goes."""
    for name in [n for n in _kept if n != owner]:
        _kept.pop(name)()


#: Bytes of an Arrow batch between Spark and a Python worker; either side holds some of them at once.
BATCH_BYTES = 8 << 20


def tidy(spark) -> None:
    """Let Spark remove a finished job's shuffle files at once (these operators write down what they use again), and
    bound batches of long texts by their bytes."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
