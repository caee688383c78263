"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms of a text are the shapes of its character runs, its words and how soon
words come again. A bounded, balanced sample of labelled rows gives term weights
and a truncated singular value decomposition; its vectors and labels are
broadcast. Every document is mapped into the same space, its exact cosine with
every labelled vector is computed in blocks, and the labels of its nearest
neighbours vote, weighted by similarity.

Defined results: a null or empty text has no terms and gets the sample's mean
label; without labelled rows every score is 0.5; labelled rows that tie for the
sample are chosen by a hash of their id; an id whose label is null, or that has
two different labels or two different texts, is not learnt from; repeated rows
are scored each and learnt from once; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.buffers import blocks, mix, row_of, string_buffer, word_hashes, words
from provena.runtime import integer_id, ship

#: Labelled rows of each class that are learnt from, at most.
PER_CLASS = 1500
#: Latent dimensions, neighbours that vote, and the power of the similarity in a vote.
LATENT, NEIGHBOURS, POWER = 48, 15, 8
THRESHOLD = 0.7
SHAPES, WORDS, GAPS = 1024, 512, 32
TERMS = SHAPES + WORDS + GAPS

#: Character classes: capital, small, digit, space, line feed, beyond ASCII, and each mark on its own.
_CLASS = np.zeros(256, np.uint64)
_CLASS[33:127] = np.arange(33, 127)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 1, 2, 3
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[128:] = 4, 5, 3


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, TERMS) square roots of the terms' shares within each of the three families."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(data):
        return out
    row = row_of(offsets)
    c = _CLASS[data]
    if len(c) >= 4:
        gram = ((c[:-3] * np.uint64(128) + c[1:-2]) * np.uint64(128) + c[2:-1]) * np.uint64(128) + c[3:]
        whole = row[:-3] == row[3:]
        key = row[:-3][whole] * SHAPES + (mix(gram[whole], 1) >> np.uint64(54)).astype(np.int64)
        out[:, :SHAPES] = np.bincount(key, minlength=n * SHAPES).reshape(n, SHAPES)
    starts, ends, woffsets = words(data, offsets)
    h, wrow = word_hashes(data, starts, ends), row_of(woffsets)
    key = wrow * WORDS + (mix(h, 2) >> np.uint64(55)).astype(np.int64)
    out[:, SHAPES : SHAPES + WORDS] = np.bincount(key, minlength=n * WORDS).reshape(n, WORDS)
    for gap in range(1, GAPS):  # the word came so many words ago; the last slot counts all words
        if len(h) > gap:
            again = (h[gap:] == h[:-gap]) & (wrow[gap:] == wrow[:-gap])
            out[:, SHAPES + WORDS + gap - 1] = np.bincount(wrow[gap:][again], minlength=n)
    out[:, TERMS - 1] = np.diff(woffsets)
    for a, b in ((0, SHAPES), (SHAPES, SHAPES + WORDS), (SHAPES + WORDS, TERMS)):
        part = out[:, a:b]
        np.sqrt(part / np.maximum(part.sum(axis=1, keepdims=True), 1), out=part)
    return out


#: Weights of the families: shapes tell most, words least.
_FAMILY = np.concatenate([np.full(SHAPES, 1.0), np.full(WORDS, 0.2), np.full(GAPS, 1.0)]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Term weights, the projection, and the labelled vectors with their labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.weights) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), 0.5)
        out = np.empty(len(x))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(x), 512):
            block = x[at : at + 512]
            near = self.embed(block) @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(near, top, 1), 0.0).astype(float) ** POWER
            total = votes.sum(axis=1)
            score = (votes * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-300)
            out[at : at + 512] = np.where((total > 0) & (block.any(axis=1)), score, self.labels.mean())
        return np.clip(out, 0.0, 1.0)


def fit(x: np.ndarray, labels: np.ndarray, seed: int = 5) -> Model:
    """Weigh terms by rarity, decompose by randomised subspace iteration, place the rows."""
    if not len(x):
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    seen = (x > 0).sum(axis=0)
    weights = (_FAMILY * np.log((1 + len(x)) / (1 + seen)).clip(0.3)).astype(np.float32)
    weighted = x * weights
    width = min(LATENT, *x.shape)
    q = np.random.default_rng(seed).standard_normal((TERMS, width)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(weighted.T @ (weighted @ q))
    model = Model(weights, q.astype(np.float32), np.zeros((0, width), np.float32), np.zeros(0))
    return Model(weights, model.axes, model.embed(x).astype(np.float32), labels.astype(float))


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2


def _terms(batches):
    for batch in batches:
        data, offsets = string_buffer(batch.column(1))
        labels = batch.column(0).to_pylist()
        for first, last, d, o in blocks(data, offsets):
            x = terms(d, o).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(labels[first:last], pa.int32())], names=["terms", "label"])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class, none of them held out."""
    ship(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
    known = known.where(F.col("label") == F.col("other")).select(F.col("doc_id").alias("__id"), "label")
    # bounded by 2 * per_class rows
    sample = [known.where(F.col("label") == c).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for c in (0, 1)]
    sample = F.broadcast(sample[0].unionAll(sample[1]))
    texts = docs.select(docs["doc_id"].alias("__doc"), F.coalesce(docs["text"], F.lit("")).alias("text"))  # no other column can clash
    rows = texts.join(sample, F.col("__doc") == F.col("__id")).groupBy("__id", "label").agg(F.min("text").alias("text"), F.max("text").alias("other"))
    rows = rows.where("text = other").select("label", "text").mapInArrow(_terms, "terms binary, label int").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["terms"])))
    x = np.array([np.frombuffer(r["terms"], np.float16) for r in rows], np.float32).reshape(-1, TERMS)
    return fit(x, np.array([r["label"] for r in rows]))


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    data, offsets = string_buffer(column)
    return np.concatenate([np.zeros(0), *(model.score(terms(d, o)) for _, _, d, o in blocks(data, offsets))])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared.value, batch.column(1)))], names=["doc_id", "score"])

    return docs.select(integer_id(docs, id_col).alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with the columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
