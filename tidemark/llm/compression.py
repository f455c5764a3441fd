"""A quality classifier from compressed sizes: one zstandard dictionary of good texts, one of bad ones, a calibrated difference."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import batched, hashed_share, table

#: Labelled rows of either class that a fit reads, about, and the pieces of PIECE characters that it takes from a longer text,
#: evenly spread over it: the fit's bound.
FIT_ROWS, FIT_PIECES = 3000, 8
#: A dictionary's bytes, and the pieces that a text is compressed in: in a long text without pieces, its own words would do the dictionary's work.
DICTIONARY_BYTES, PIECE, LEVEL = 524_288, 2048, 12
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def held_out() -> Column:
    """Rows whose labels no fit may see."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def dictionaries(good: list[bytes], bad: list[bytes], size: int = DICTIONARY_BYTES) -> tuple[bytes, bytes]:
    """Content of both dictionaries: an equal share of each text, spread over it, until ``size`` bytes are full.

    Lines of more than one text tell nothing about a class: both dictionaries get them, in an eighth of their size.
    """
    seen = Counter(line for x in good + bad for line in {*x.split(b"\n")})
    common = b"\n".join(line for line, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n > 1)[: size // 8]
    found = []
    for texts in (good, bad):
        texts = [y for x in texts if (y := b"\n".join(line for line in x.split(b"\n") if seen[line] == 1))]
        share, parts = max(256, size // max(1, len(texts))), []
        for i, x in enumerate(texts):
            at = (i * 7919) % max(1, len(x) - share + 1)
            parts.append(x[at : at + share])
        found.append(common + b"\n" + b" ".join(parts)[: size - len(common)])
    return found[0], found[1]


@lru_cache(4)
def _compressor(content: bytes):
    import zstandard

    found = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
    if found:
        found.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=found, write_content_size=False, write_dict_id=False) if found else zstandard.ZstdCompressor(level=LEVEL)


def difference(text: bytes, good: bytes, bad: bytes) -> float:
    """(size with bad - size with good) / (their sum) over all pieces of ``text``, -1 to 1; 0 for an empty text."""
    with_good, with_bad = _compressor(good).compress, _compressor(bad).compress
    g = b = 0
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        g += len(with_good(piece))
        b += len(with_bad(piece))
    return (b - g) / (b + g) if b + g else 0.0


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through weighted (x, y), by Newton's method with a slight pull to a flat curve."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve((a.T * (weight * p * (1 - p))) @ a + 1e-3 * np.diag([1e-3, 1.0]), a.T @ (weight * (y - p)) - 1e-3 * w * [1e-3, 1.0])
    return float(w[0]), float(w[1])


def excerpt(text: Column) -> Column:
    """Texts of up to FIT_PIECES * PIECE characters whole, of longer ones so many pieces of PIECE, from the start to the end."""
    step = (F.length(text) - PIECE) / (FIT_PIECES - 1)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(FIT_PIECES - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(PIECE)))
    return F.when(F.length(text) <= FIT_PIECES * PIECE, text).otherwise(F.array_join(pieces, "\n"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on ``rows`` labelled documents of either class or so, none held out: half make the dictionaries, half the curve.

    Rows are taken by a hash of doc_id, of long texts excerpts that executors cut, and the curve weighs either class as often as it is labelled. Without labels of both classes every score is the share of label 1, or a half.
    """
    labelled = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    often = {r["quality"]: r["n"] for r in labelled.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = [hashed_share(labelled.where(F.col("quality") == q), "doc_id", rows, often.get(q, 0)) for q in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # about 2 * rows ids
    found = docs.join(chosen, "doc_id").where(F.length("text") > 0).select("doc_id", "quality", excerpt(F.col("text")).alias("text")).collect()
    found = sorted({(r["doc_id"], r["quality"]): r["text"].encode() for r in found}.items(), key=lambda r: r[0])
    classes = [[x for (_, q), x in found if q == c] for c in (0, 1)]
    share = often.get(1, 0) / max(1, sum(often.values())) if often else 0.5
    if not all(len(c) >= 4 for c in classes):
        return Model(b"", b"", 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    good, bad = dictionaries(classes[1][::2], classes[0][::2])
    rest = [(difference(x, good, bad), q) for q, c in enumerate(classes) for x in c[1::2]]
    y = np.array([q for _, q in rest])
    slope, offset = calibrate(np.array([d for d, _ in rest]), y.astype(float), np.array([often[q] / (y == q).sum() for q in y]) * len(y) / sum(often.values()))
    return Model(good, bad, slope, offset)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1, higher: rather label 1) and predicted. Null and empty texts get the curve's value at 0."""
    at = {f.name: i for i, f in enumerate(docs.schema)}["text"]
    out = docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            d = np.array([difference(x.as_buffer().to_pybytes() if x.is_valid else b"", m.good, m.bad) for x in batch.column(at).cast(pa.binary())])
            score = 1 / (1 + np.exp(-np.clip(m.slope * d + m.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype("i4"))], names=[*batch.schema.names, "score", "predicted"])

    return batched(docs).mapInArrow(run, out)


def op8_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for each document. Null and empty texts get the curve's value at 0; texts of any length are
    compressed whole, piece by piece. A null doc_id stays null, and its held_out is null; repeated rows are scored each, and equal
    texts alike. Without labels of both classes all scores are the share of label 1, or a half. An empty table gives no rows; other
    columns are ignored, whatever their names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out().alias("held_out"), "score", "predicted")
