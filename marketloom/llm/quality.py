"""Quality score from compression with zstandard dictionaries of good and bad text.

A text is compressed block by block with a dictionary of good and with one of bad text.
Its feature is the difference of the two sizes over the bytes of the text: what is like
the good examples is smaller with their dictionary.  A logistic curve, fitted on
labelled texts that are in neither dictionary, turns the feature into a score.

The model is fitted on a bounded sample, the labelled rows with the smallest hash of their
doc_id: ``SAMPLE`` documents of each label, of which at most ``BLOCKS`` blocks each, spread
over the whole text, make the dictionaries.  Scoring reads every block of every text.

Edge cases: a null text is the empty text and gets the score of a difference of zero;
rows that repeat are scored each; labels that are null or contradict each other are not
learned from; with no usable labels every score is one half; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.batches import encoded, split_batches

BLOCK = 2048
SAMPLE = 3000
BLOCKS = 4
DICTIONARY = 256 << 10
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Dictionaries of both kinds and the logistic curve over the size difference."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def scores(self, texts: list[bytes]) -> list[float]:
        diff = _Differ(self)
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, self.intercept + self.slope * diff(t))))) for t in texts]


def blocks(text: bytes) -> list[bytes]:
    """The text in blocks of even length, at most ``BLOCK`` bytes each."""
    n = -(-len(text) // BLOCK)
    return [text[len(text) * i // n:len(text) * (i + 1) // n] for i in range(n)]


class _Differ:
    def __init__(self, model: Model):
        self.sides = [self._compressor(d) for d in (model.bad, model.good)]

    @staticmethod
    def _compressor(content: bytes):
        if not content:
            return None
        return zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False)

    def __call__(self, text: bytes) -> float:
        if not text or None in self.sides:
            return 0.0
        bad, good = self.sides
        parts = blocks(text)
        return (sum(len(bad.compress(p)) for p in parts) - sum(len(good.compress(p)) for p in parts)) / len(text)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary of an eighth of the samples at most; too few to train on are one themselves."""
    parts = [b for s in samples for b in blocks(s) if len(b) >= 8]
    total = sum(map(len, parts))
    if len(parts) >= 64 and total >= 64 << 10:
        return zstandard.train_dictionary(min(DICTIONARY, total // 8), parts).as_bytes()
    return b"".join(parts)[:DICTIONARY]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept by Newton steps; a small ridge keeps separable data finite."""
    scale = float(np.std(x)) or 1.0
    z = np.c_[x / scale, np.ones(len(x))]
    b = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -35, 35)))
        grad = z.T @ (weight * (y - p)) - ridge * b
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b += step
        if np.abs(step).max() < 1e-10:
            break
    return float(b[0] / scale), float(b[1])


def _sample_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in split_batches(batches, "text"):
        kept = []
        for t in encoded(part.column(2)):
            parts = blocks(t)
            n = min(BLOCKS, len(parts))
            kept.append([parts[len(parts) * i // n] for i in range(n)])
        yield pa.record_batch([part.column(0), part.column(1), pa.array(kept, pa.list_(pa.binary()))], ["doc_id", "quality", "parts"])


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> list[tuple[int, list[bytes]]]:
    """Label and blocks of the labelled documents with the smallest hashes, ``size`` of each label."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    agreed = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_q")).filter("quality = _q").drop("_q")
    chosen = [r for q in (0, 1) for r in agreed.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).collect()]
    if not chosen:
        return []
    picked = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in chosen], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int")
    # a bounded table: 2 * size rows
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")
    rows = texts.mapInArrow(_sample_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, parts array<binary>")
    found = rows.groupBy("doc_id", "quality").agg(F.min("parts").alias("parts")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [(r["quality"], [bytes(p) for p in r["parts"]]) for r in found]


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Dictionaries from one half of the sample and the curve from the other."""
    rows = sample(docs, labels, size)
    sides = {q: [p for k, p in rows if k == q] for q in (0, 1)}
    if not sides[0] or not sides[1]:
        return Model(b"", b"", 0.0, 0.0)
    text = lambda docs_: [b"".join(p) for p in docs_]
    raw = Model(_dictionary(text(sides[1][::2])), _dictionary(text(sides[0][::2])), 0.0, 0.0)
    diff = _Differ(raw)
    rest = {q: text(sides[q][1::2]) or text(sides[q]) for q in sides}
    x = np.array([diff(t) for q in (0, 1) for t in rest[q]])
    y = np.array([q for q in (0, 1) for _ in rest[q]], float)
    # the sample has equal shares of both labels, or all that there are
    slope, intercept = _logistic(x, y, np.ones(len(x)))
    return Model(raw.good, raw.bad, slope, intercept)


def _score_batches(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for part in split_batches(batches, "text"):
        yield pa.record_batch([*part.columns, pa.array(model.scores(encoded(part.column(part.schema.get_field_index("text")))), pa.float64())], [*part.schema.names, "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and ``score`` of every row; near 1 where label 1 is likely."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = lambda it: (b.select([0, 2]) for b in _score_batches(it, model))
    return rows.mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows whose score reaches the threshold, with the columns they came with."""
    # under plain names: mapInArrow looks its columns up by name, and a name may hold a dot
    plain = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    return plain.mapInArrow(lambda it: _keep_batches(it, model, threshold), plain.schema).toDF(*docs.columns)


def _keep_batches(batches: Iterable[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for part in split_batches(batches, "text"):
        scores = model.scores(encoded(part.column(part.schema.get_field_index("text"))))
        yield part.filter(pa.array([s >= threshold for s in scores]))
