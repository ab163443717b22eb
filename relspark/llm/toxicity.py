"""Toxicity scoring by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text: its distinct words, adjacent pairs and pairs with one word skipped, each
hashed to ``2**bits`` coordinates. Words are runs of bytes that are neither ASCII punctuation
nor white space, after A-Z became a-z. Each coordinate has its own learning rate
(``alpha / (beta + sqrt(sum of squared gradients))``) and ``l1`` keeps the weights sparse, so
the model that is broadcast has a few thousand entries and never more than ``2**bits``.

Defined results: a null or empty text has no feature and gets the score of the bias alone;
rows of ``labels`` whose id or label is null, or whose label is neither 0 nor 1, are not used;
of several labels for one id the largest counts, of several texts that with the smallest hash;
without any label the score is 0.0. Input rows come back one for one, repeated rows included. The stage
judges every row by its own text and keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches
from ._text import LOWER, WordHashes, chunks, free_name, mix, word_hashes

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TABLE = LOWER.translate(bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION)))
SAMPLE_ROWS = 8_000


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    epochs: int = 4
    bits: int = 22


@dataclass(frozen=True)
class ToxicityModel:
    bits: int
    bias: float
    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.index] = self.weight
        return out


def features(words: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all features of all texts, and the text each belongs to; not yet distinct."""
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts))
    index, text = [mix(words + np.uint64(1))], [owner]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        same = owner[:-gap] == owner[gap:]
        index.append(mix(words[:-gap] * np.uint64(0xD6E8FEB86659FD93) + words[gap:] + np.uint64(salt))[same])
        text.append(owner[:-gap][same])
    return (np.concatenate(index) >> np.uint64(64 - bits)).astype(np.int32), np.concatenate(text)


def train(rows: list[tuple[np.ndarray, int]], how: Ftrl) -> ToxicityModel:
    """One pass per epoch over (distinct coordinates, label) in a fixed shuffled order."""
    if not rows:
        return ToxicityModel(how.bits, float("-inf"))
    z, n = np.zeros((1 << how.bits) + 1, np.float32), np.zeros((1 << how.bits) + 1, np.float32)
    bias = 1 << how.bits

    def weights(i: np.ndarray) -> np.ndarray:
        zi, ni = z[i].astype(np.float64), n[i].astype(np.float64)
        w = (np.sign(zi) * how.l1 - zi) / ((how.beta + np.sqrt(ni)) / how.alpha + how.l2)
        return np.where((np.abs(zi) <= how.l1) & (i != bias), 0.0, w)

    order = np.random.default_rng(17)
    for _ in range(how.epochs):
        for k in order.permutation(len(rows)):
            i, y = rows[k]
            i = np.append(i, bias)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            ni = n[i].astype(np.float64)
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / how.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    kept = np.flatnonzero(np.abs(z[:-1]) > how.l1).astype(np.int32)  # all others have the weight 0
    return ToxicityModel(how.bits, float(weights(np.array([bias]))[0]), kept, weights(kept).astype(np.float32))


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, how: Ftrl = Ftrl()) -> ToxicityModel:
    """Train on at most ``sample_rows`` labelled documents, taken in the order of a hash of their ids.

    The bound is on the classifier's training rows only; scoring covers everything. One task trains on
    the coordinates of the sample.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = how.bits
    small_batches(documents.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch, texts in chunks(batches):
            words, starts = word_hashes(texts, memo, TABLE)
            index, text = features(words, starts, bits)
            key = np.unique((text << bits) | index)
            ends = np.searchsorted(key, np.arange(1, len(texts) + 1, dtype=np.int64) << bits)
            packed = [(x & ((1 << bits) - 1)).astype("<i4").tobytes() for x in np.split(key, ends[:-1])]
            yield pa.record_batch([batch.column("id"), batch.column("y"), batch.column("h"), pa.array(packed, pa.binary())], ["id", "y", "h", "x"])

    # the sample has at most sample_rows small rows, which is the proven bound of this broadcast
    rows = texts.join(F.broadcast(known), "id").select("id", "y", "text", F.xxhash64("text").alias("h"))
    encoded = rows.mapInArrow(encode, f"id {documents.schema[id_col].dataType.simpleString()}, y int, h long, x binary")
    one = encoded.groupBy("id").agg(F.min(F.struct("h", "x", "y")).alias("r")).select("id", "r.x", "r.y")  # of several texts that with the smallest hash

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("id", "x", "y")), strict=True)), key=lambda r: r[0])
        m = train([(np.frombuffer(x, "<i4"), y) for _, x, y in got], how)
        yield pa.record_batch([pa.array([m.bias]), pa.array([m.index.tobytes()]), pa.array([m.weight.tobytes()])], ["bias", "index", "weight"])

    # at most sample_rows rows meet in one task, and the sparse weights alone come to the driver
    found = one.repartition(1).mapInArrow(learn, "bias double, index binary, weight binary").collect()
    return ToxicityModel(bits, found[0]["bias"], np.frombuffer(found[0]["index"], np.int32), np.frombuffer(found[0]["weight"], np.float32)) if found else train([], how)


def score(documents: DataFrame, model: ToxicityModel, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """Every row of ``documents`` with its probability of being toxic in ``out`` (replacing a column of that name)."""
    spark = documents.sparkSession
    base = documents.drop(out)
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    schema = base.select("*", F.lit(0.0).alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        weight, memo = model.dense(), WordHashes()
        for batch, texts in chunks(batches, text_col):
            words, starts = word_hashes(texts, memo, TABLE)
            index, text = features(words, starts, model.bits)
            live = np.flatnonzero(weight[index])
            key = np.unique((text[live] << model.bits) | index[live])
            total = np.bincount(key >> model.bits, weight[key & ((1 << model.bits) - 1)], len(texts)) + model.bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(np.isneginf(total), 0.0, 1 / (1 + np.exp(-np.clip(total, -700, 700)))))], [*batch.schema.names, out])

    return base.mapInArrow(run, schema)


def remainder(id_col: str, by: int):
    """crc32 of the id as text, modulo ``by``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % by


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels of ids with remainder 0 of 5 are held out."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score under 0.5; the model learns from the labels of the corpus."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = free_name(docs, "_toxicity")
    scored = score(docs, fit(documents, labels.where(remainder("doc_id", 5) != 0)), out=out)
    return scored.where(F.col(out) < 0.5).drop(out)
