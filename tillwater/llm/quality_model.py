"""Compression classifier for text quality.

Two zstandard dictionaries are made, one from blocks of texts labelled good and
one from blocks of texts labelled bad. A text is cut into blocks, and every
block of the whole text is compressed with either dictionary. The difference of
the two sizes over the text's size is the evidence; a logistic curve, fitted on
labelled texts that no dictionary has seen, turns it into a probability.

Training uses a bounded sample of labelled documents: those whose hash lies in
the first SAMPLE of their label's documents, SAMPLE on average (all, if there
are fewer). Half of them make dictionaries, of blocks of the whole texts; if
there are more than BLOCKS of a label, those with the smallest hashes count,
BLOCKS on average. The other half fits the curve to the evidence of whole texts,
weighted back to the labels' true shares. Evidence is taken by the executors, a
number a document. The model is two dictionaries and four numbers. Scoring is
one pass without a shuffle.

A null text scores as an empty one: evidence 0, so the curve's value there.
Rows whose label or doc_id is null don't train. Repeated rows score alike. A doc_id
trains once, with its largest label and the first of its texts.
Without two labels to learn from, every score is the share of label 1 (0.5 if
there are no labels).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwater.llm.common import text_or_empty, unused
from tillwater.session import stored

#: Labelled documents of one label used for training, on average.
SAMPLE = 4_000
#: Blocks of one label that a dictionary is made of, on average.
BLOCKS = 8_000
BLOCK_BYTES = 1_000
DICTIONARY_BYTES = 65_536
LEVEL = 3


def blocks_of(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes):
    import zstandard

    return [
        zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False,
            write_dict_id=False,
        )
        for d in (good, bad)
    ]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    centre: float = 0.0
    spread: float = 1.0

    def evidence(self, text: str) -> float:
        """Bytes that the dictionary of good texts saves over the other, per byte of text."""
        if not self.good:
            return 0.0
        good, bad = _compressors(self.good, self.bad)
        parts = blocks_of(text)
        size = sum(map(len, parts))
        return (sum(len(bad.compress(x)) for x in parts) - sum(len(good.compress(x)) for x in parts)) / (size + 1)

    def probability(self, evidence):
        return 1 / (1 + np.exp(-np.clip(self.slope * self.damped(evidence) + self.intercept, -500, 500)))

    def damped(self, evidence):
        """Evidence in spreads from the centre of good texts, with tails drawn in, so that blatant texts don't set the curve."""
        return np.arcsinh((evidence - self.centre) / self.spread)


def _dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples for training: their end is the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the weighted logistic fit, with a weak ridge that keeps separable data finite."""
    scale = x.std() or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (weight * p * (1 - p))) @ a + ridge, a.T @ (weight * (y - p)) - ridge @ w)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Model of ``labels`` (``doc_id`` and a 0/1 column) over the texts of ``docs``."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = dict(known.groupBy("label").count().collect())
    total = sum(counts.values())
    if len(counts) < 2:
        share = min(max(counts.get(1, 0) / total, 0.01), 0.99) if total else 0.5
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    place = lambda what: F.shiftrightunsigned(F.xxhash64(F.lit(what), "doc_id"), 11) / float(1 << 53)
    part = F.when(F.col("label") == 1, sample / counts[1]).otherwise(sample / counts[0])
    chosen = known.filter(place("sample") < part).withColumn("learns", place("half") < 0.5)
    # Some 2 * sample short rows, hence the broadcast; texts of a doc_id that occurs often are compared where they lie.
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = stored(texts.groupBy("doc_id", "label", "learns").agg(F.min("text").alias("text")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, label, text in zip(batch["doc_id"], batch["label"], batch["text"], strict=True):
                parts = blocks_of(text)
                at = [zlib.crc32(f"{doc_id}/{i}".encode()) / 2.0**32 for i in range(len(parts))]
                yield pd.DataFrame({"label": label, "at": at, "block": parts})

    blocks = texts.filter("learns").mapInPandas(cut, "label int, at double, block binary")
    sizes = dict(blocks.groupBy("label").count().collect())
    if len(sizes) < 2:
        return Model(b"", b"", 0.0, float(np.log(counts[1] / counts[0])))
    few = F.col("at") < F.when(F.col("label") == 1, BLOCKS / sizes[1]).otherwise(BLOCKS / sizes[0])
    rows = sorted((y, at, bytes(x)) for y, at, x in blocks.filter(few).collect())
    good, bad = (_dictionary([b for y, _, b in rows if y == want]) for want in (1, 0))
    if not good or not bad:
        return Model(b"", b"", 0.0, float(np.log(counts[1] / counts[0])))
    model = Model(good, bad, 0.0, 0.0)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "evidence": [model.evidence(t) for t in batch["text"]]})

    rest = texts.filter("not learns")
    seen = (rest if rest.limit(1).count() else texts).mapInPandas(weigh, "label int, evidence double").collect()
    seen = sorted((r["evidence"], r["label"]) for r in seen)
    raw, y = np.array([e for e, _ in seen]), np.array([float(v) for _, v in seen])
    fine = raw[y == 1] if (y == 1).any() else raw
    centre, spread = float(np.median(fine)), float(np.median(np.abs(fine - np.median(fine)))) or 1e-3
    model = Model(good, bad, 0.0, 0.0, centre, spread)
    x = model.damped(raw)
    met = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    weight = np.where(y == 1, counts[1] / met[1], counts[0] / met[0]) * len(y) / total
    return Model(good, bad, *_curve(x, y, weight), centre, spread)


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """The rows of ``docs`` with ``score``: the probability of label 1 for the whole text."""

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.probability(np.array([model.evidence(t or "") for t in batch], float)))

    return docs.withColumn(score, probability(text_or_empty()))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Documents that score ``least`` or more, with the columns of ``docs``."""
    (name,) = unused(docs, "_score")
    return scored(docs, model, name).filter(F.col(name) >= least).drop(name)
