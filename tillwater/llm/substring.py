"""Repeated passages of many words, removed everywhere but in the first document.

Windows of WINDOW words are the edges of a de Bruijn graph, whose nodes are the
runs of one word less. A word is removed if a window covers it whose word
sequence also starts in a document with a smaller doc_id.

1. Anchors. In every window the least hash of its ANCHOR-word runs is its anchor,
   so equal windows have equal anchors, and a fifth of all positions are anchors. Only
   windows with an anchor that occurs in two documents can be repeated.
2. Edges. The windows of those anchors are grouped by hash; an edge in two
   documents keeps its source: the smallest doc_id and a place there. A join brings the source to
   the later occurrences.
3. Compaction. Occurrences that follow each other in their document and in
   their source lie on one nonbranching path; they compact into one span with source coordinates
   (a join of each occurrence's predecessor, as a lag in document order).
4. Verification. A span's words are digested at the source and compared where they
   would be removed, so a clash of hashes removes nothing.

Copies of a whole text are settled before (by 128-bit hash): all of a copy but the first goes,
if it has WINDOW words; so a text with millions of copies enters the graph
once. Anchors and edges are counted per task before they are moved, and joins split hot anchors.

Nulls: a null text has no words. A document without doc_id is neither source
nor changed. Rows with one doc_id are no repeats of each other. Repeated rows
get the same result. Very long texts are searched whole. An empty table gives no rows. ``doc_id`` must be an integer column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwater.llm import wordhash
from tillwater.llm.common import text_or_empty, unused
from tillwater.session import stored

WINDOW = 13
ANCHOR = 5
#: Positions carry this many bits of the text's hash above them, which tells apart rows with one doc_id.
PRINT_BITS = 16
POSITION_BITS = 40
_LOW = (1 << POSITION_BITS) - 1


def anchors(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every ANCHOR-word run; the windows inside one text, by first word; and the anchor of each, by first word."""
    runs = wordhash.windows(hashes, ANCHOR)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return runs, np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = wordhash.text_of_word(before)
    good = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    width = WINDOW - ANCHOR + 1
    # The least of ``width`` neighbours by doubling; a tie goes to the left.
    best = np.arange(n + width - 1)
    span = 1
    while span < width:
        step = min(span, width - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(runs[b] < runs[a], b, a)
        span += step
    return runs, good, best[good]


def _parts(batch: pa.RecordBatch, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    _, at = wordhash.buffer_of(batch.column("text"))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(at, at[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch):
            hashes, before, *_ = wordhash.words(part.column("text"))
            runs, _, found = anchors(hashes, before)
            at = np.unique(found)
            owner = wordhash.text_of_word(before)[at]
            doc, mark = (part.column(c).to_numpy() for c in ("doc", "mark"))
            place = (mark[owner].astype(np.int64) << POSITION_BITS) | (at - before[owner])
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs[at].view(np.int64)), pa.array(doc[owner]), pa.array(place)], ["h", "doc", "place"]
            )


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose anchor is listed in ``places``."""
    for batch in batches:
        for part in _parts(batch):
            hashes, before, *_ = wordhash.words(part.column("text"))
            _, good, found = anchors(hashes, before)
            lists = part.column("places")
            sizes = np.diff(lists.offsets.to_numpy())
            listed = np.repeat(before[:-1], sizes) + (lists.flatten().to_numpy() & _LOW)
            chosen = np.zeros(len(hashes) + 1, bool)
            chosen[listed] = True
            at = good[chosen[found]]
            owner = wordhash.text_of_word(before)[at]
            doc, mark = (part.column(c).to_numpy() for c in ("doc", "mark"))
            place = (mark[owner].astype(np.int64) << POSITION_BITS) | (at - before[owner])
            edges = wordhash.windows(hashes, WINDOW)
            yield pa.RecordBatch.from_arrays(
                [pa.array(edges[at].view(np.int64)), pa.array(doc[owner]), pa.array(place)], ["h", "doc", "place"]
            )


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _split(text: str) -> tuple[bytes, list[bytes], np.ndarray, np.ndarray]:
    _, _, starts, ends, raw = wordhash.words(pa.array([text]))
    data = raw.tobytes()
    return data, [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], starts, ends


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc``, ``mark``, ``text`` of documents with a doc_id."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id"), text_or_empty().alias("text"))
    return rows.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"),
        F.pmod(F.xxhash64("text"), F.lit(1 << PRINT_BITS)).cast("long").alias("mark"), "text",
    )


def _mark(place: str):
    return F.shiftright(F.col(place), POSITION_BITS)


def whole_copies(rows: DataFrame) -> DataFrame:
    """``doc``, ``mark`` of documents whose text a smaller doc_id has too."""
    keyed = rows.select("doc", "mark", F.md5(F.col("text").cast("binary")).alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    return keyed.join(firsts, "key").filter("doc > first").select("doc", "mark").distinct()


def spans(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """Spans to remove: ``doc``, ``mark``, ``start``, ``length`` in words, and ``src``, ``src_mark``, ``src_start``.

    ``rows`` are documents with doc, mark and text.
    """
    found = rows.mapInArrow(_anchor_rows, "h long, doc long, place long")
    shared = found.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("h")
    hits = found.join(shared, "h").select("doc", _mark("place").alias("mark"), "place")
    hits = hits.join(copies, ["doc", "mark"], "left_anti")
    hits = stored(hits.groupBy("doc", "mark").agg(F.collect_set("place").alias("places")))
    edges = rows.join(hits, ["doc", "mark"]).mapInArrow(_window_rows, "h long, doc long, place long")
    source = edges.groupBy("h").agg(
        F.min("doc").alias("src"), F.min_by("place", "doc").alias("src_place"), F.max("doc").alias("last")
    )
    source = source.filter("src < last").select("h", "src", "src_place")
    later = edges.join(source, "h").filter("doc > src").select(
        "doc", _mark("place").alias("mark"), F.col("place").bitwiseAND(_LOW).alias("at"),
        "src", _mark("src_place").alias("src_mark"), F.col("src_place").bitwiseAND(_LOW).alias("src_at"),
    )
    order = W.partitionBy("doc", "mark").orderBy("at")
    follows = (
        (F.lag("at").over(order) == F.col("at") - 1) & (F.lag("src").over(order) == F.col("src"))
        & (F.lag("src_mark").over(order) == F.col("src_mark")) & (F.lag("src_at").over(order) == F.col("src_at") - 1)
    )
    steps = later.distinct().withColumn("new", F.when(follows, 0).otherwise(1))
    paths = steps.withColumn("path", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return paths.groupBy("doc", "mark", "path").agg(
        F.min("at").alias("start"), (F.count(F.lit(1)) + WINDOW - 1).alias("length"),
        F.min("src").alias("src"), F.min("src_mark").alias("src_mark"), F.min("src_at").alias("src_start"),
    ).drop("path")


def digested(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The spans with ``digest`` of their words at the source.

    A source is asked once for a span, however many documents cite it; its digest is joined back to them.
    """
    at_source = ["src", "src_mark", "src_start", "length"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                words = _split(text.as_py())[1]
                for x in wanted.as_py():
                    x["digest"] = _digest(words[x["src_start"] : x["src_start"] + x["length"]])
                    out.append(x)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x[k] for x in out], pa.int64()) for k in at_source), pa.array([x["digest"] for x in out], pa.binary())],
                [*at_source, "digest"],
            )

    asked = found.select(*at_source).distinct()
    asked = asked.groupBy(F.col("src").alias("doc"), F.col("src_mark").alias("mark"), F.pmod(F.xxhash64("src_start"), F.lit(64)).alias("slice"))
    asked = asked.agg(F.collect_list(F.struct(*at_source)).alias("wanted")).drop("slice")
    joined = rows.join(asked, ["doc", "mark"]).select("text", "wanted")
    digests = joined.mapInArrow(digest, "src long, src_mark long, src_start long, length long, digest binary").distinct()
    return found.join(digests, at_source).select("doc", "mark", "start", "length", "digest")


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verifiable spans of each document (``doc``, ``mark``, ``spans``), and the whole copies (``doc``, ``mark``)."""
    rows = _keyed(docs)
    copies = stored(whole_copies(rows))
    found = stored(spans(rows, copies))
    told = digested(rows, found)
    return told.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "length", "digest")).alias("spans")), copies


def deduplicated(docs: DataFrame, digests: bool = False) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of ``text``, and ``n_words``, ``n_removed`` after its columns.

    White space before a word goes with it. With ``digests``, ``kept_sha256`` follows: of the
    kept words joined by one space.
    """
    n_words, n_removed, sha, doc, mark, marked, copy, found = unused(
        docs, "n_words", "n_removed", "kept_sha256", "_doc", "_mark", "_marked", "_copy", "_spans"
    )
    by_doc, copies = removals(docs)
    rows = docs.withColumn(doc, F.col("doc_id").cast("long"))
    rows = rows.withColumn(mark, F.pmod(F.xxhash64(text_or_empty()), F.lit(1 << PRINT_BITS)).cast("long"))
    by_doc = by_doc.select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("spans").alias(found))
    copies = copies.select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.lit(True).alias(copy))
    rows = rows.join(by_doc, [doc, mark], "left").join(copies, [doc, mark], "left")
    kinds = "text string, n_words long, n_removed long, kept_sha256 string"

    @F.pandas_udf(kinds)
    def cut(texts, spans, whole):  # noqa: ANN001
        import pandas as pd

        out = []
        for text, listed, is_copy in zip(texts, spans, whole, strict=True):
            data, words, starts, ends = _split(text if text is not None else "")
            gone = np.zeros(len(words), bool)
            if is_copy is True and len(words) >= WINDOW:
                gone[:] = True
            elif listed is not None:
                for x in listed:
                    at, n = int(x["start"]), int(x["length"])
                    if _digest(words[at : at + n]) == bytes(x["digest"]):
                        gone[at : at + n] = True
            if gone.any():
                froms = np.concatenate([[0], ends[:-1]])[~gone].tolist()
                kept = b"".join(data[a:b] for a, b in zip(froms, ends[~gone].tolist(), strict=True))
                kept += data[ends[-1] :] if not gone[-1] else b""
                text = kept.decode("utf-8", "replace").lstrip(" \t\n\x0b\x0c\r") if gone[0] else kept.decode("utf-8", "replace")
            kept_words = b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if digests else b""
            out.append((text, len(words), int(gone.sum()), hashlib.sha256(kept_words).hexdigest() if digests else None))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed", "kept_sha256"])

    done = rows.withColumn(marked, cut(F.col("text"), F.col(found), F.coalesce(F.col(copy), F.lit(False))))
    columns = [F.col(marked)["text"].alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    extra = [F.col(marked)["n_words"].alias(n_words), F.col(marked)["n_removed"].alias(n_removed)]
    return done.select(*columns, *extra, *([F.col(marked)["kept_sha256"].alias(sha)] if digests else []))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of ``text``; ``n_chars``, where there is one, follows the text."""
    cut = deduplicated(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut
