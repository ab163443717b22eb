"""Language identification by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector of hashed byte n-grams (1 to 4 bytes inside words,
with word ends marked): ``1 + log(tf)`` times the n-gram's inverse document frequency in the
fitted sample. Spherical k-means gives every language several centroids; a text gets the
language of the centroid with the largest cosine, and that cosine as its score. If the score is
under that language's floor (a low quantile of the scores of its own training texts, less a
margin) the text is rejected: the pipeline's stage drops it, the query still names the language.

Only letters count: A-Z become a-z, and digits, ASCII punctuation and white space become word
ends. Defined results: a null text, an empty text and a text without a letter get ``und`` and
score 0.0; without any training row every text is ``und``. Input rows come back one for one; of
centroids that are equally near (to 1e-6) the first by language counts. Every language that has a text with a letter
is learned, be there more of them than ``sample_rows``; each then has one text. Many centroids are held
sparsely. The stage drops what is rejected, texts without a letter among it, and keeps all columns.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import small_batches
from ._text import LOWER, chunks, free_name
from .toxicity import remainder

SAMPLE_ROWS = 4_000
SAMPLE_BYTES = 128 << 20
BROADCAST_LANGUAGES = 100_000  # rows of a label and a number; beyond that the texts are shuffled to their language's row
DENSE = 64  # centroids
_ORDERS = (1, 2, 3, 4)
_MARKS = bytes(range(0x41)) + b"[\\]^_`{|}~\x7f"
TABLE = LOWER.translate(bytes.maketrans(_MARKS, b" " * len(_MARKS)))
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Sparse:
    """A coordinate x centroid matrix of mostly zeros, row after row."""

    starts: np.ndarray  # of each coordinate, one more at the end
    columns: np.ndarray
    values: np.ndarray
    width: int

    @staticmethod
    def of(columns: list[tuple[np.ndarray, np.ndarray]], height: int) -> Sparse:
        rows = np.concatenate([c[0] for c in columns])
        order = np.argsort(rows, kind="stable")
        number = np.repeat(np.arange(len(columns), dtype=np.int32), [len(c[0]) for c in columns])
        return Sparse(np.searchsorted(rows[order], np.arange(height + 1)), number[order], np.concatenate([c[1] for c in columns])[order], len(columns))

    def dot(self, index: np.ndarray, w: np.ndarray) -> np.ndarray:
        reach = self.starts[index + 1] - self.starts[index]
        at = np.arange(reach.sum()) + np.repeat(self.starts[index] - (np.cumsum(reach) - reach), reach)
        return np.bincount(self.columns[at], self.values[at] * np.repeat(w, reach), self.width)


@dataclass(frozen=True)
class LanguageModel:
    bits: int
    idf: np.ndarray  # of every coordinate
    centroids: np.ndarray | Sparse  # coordinate x centroid, unit columns
    language: list[str]  # of each centroid
    floor: dict[str, float]

    def cosines(self, index: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self.centroids.dot(index, w) if isinstance(self.centroids, Sparse) else w @ self.centroids[index]


def vector(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and counts of one text's n-grams."""
    words = b" ".join(text.translate(TABLE).split())
    raw = np.frombuffer(b" " + words + b" ", np.uint8).astype(np.uint64)
    total = np.zeros(1 << bits, np.int64)
    code = np.zeros(len(raw), np.uint64)
    for n in _ORDERS:
        code = code[: len(raw) - n + 1] * np.uint64(257) + raw[n - 1 :] + np.uint64(1)
        if n > 2:  # an n-gram may begin or end at a mark, not span it
            inner = np.ones(len(code), bool)
            for k in range(1, n - 1):
                inner &= raw[k : k + len(code)] != 32
            slots = code[inner]
        else:
            slots = code
        slots = (slots * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        total += np.bincount(slots.astype(np.int64), minlength=1 << bits)
    index = np.flatnonzero(total).astype(np.int32)
    return index, total[index].astype(np.int32)


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (any(97 <= c <= 122 for c in text[:256].translate(LOWER)) or _LETTER.search(text.decode("utf-8", "replace")) is not None)


def train(vectors: list[tuple[np.ndarray, np.ndarray, str]], *, bits: int = 16, per_language: int = 4, rounds: int = 8, quantile: float = 0.005, margin: float = 0.15, most_dense: int = DENSE) -> LanguageModel:
    """The model of (coordinates, counts, language) of the sample's texts, in a fixed order."""
    seen = np.zeros(1 << bits)
    for index, _, _ in vectors:
        seen[index] += 1
    idf = np.log((1 + len(vectors)) / (1 + seen)) + 1
    draw = np.random.default_rng(11)
    columns, names, floor = [], [], {}
    by_language: dict[str, list] = {}
    for i, n, lang in vectors:
        by_language.setdefault(lang, []).append((i, n))
    dense = sum(min(per_language, len(x)) for x in by_language.values()) <= most_dense
    for lang in sorted(by_language):
        own = [(i, _unit(i, n, idf)) for i, n in by_language[lang]]
        k = min(per_language, len(own))
        centres = np.zeros((1 << bits, k), np.float32)
        for j, at in enumerate(draw.permutation(len(own))[:k]):
            centres[own[at][0], j] = own[at][1]
        for _ in range(rounds):
            sums = np.zeros_like(centres)
            for index, w in own:
                sums[index, int(np.argmax(w @ centres[index]))] += w
            norm = np.linalg.norm(sums, axis=0)
            centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres).astype(np.float32)
        columns += [centres] if dense else [(at := np.flatnonzero(c), c[at]) for c in centres.T]
        names += [lang] * k
        floor[lang] = float(np.quantile([(w @ centres[i]).max() for i, w in own], quantile)) - margin
    none = np.zeros((1 << bits, 0), np.float32)
    return LanguageModel(bits, idf.astype(np.float32), np.concatenate([none, *columns], axis=1) if dense else Sparse.of(columns, 1 << bits), names, floor)


def _unit(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[index]
    return (w / np.linalg.norm(w)).astype(np.float32)


def fit(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, bits: int = 16, **how) -> LanguageModel:
    """Train on at most ``sample_rows`` texts, the same number of each language as far as there are any, and one at least.

    The rows are those with the smallest hash of their id and text within each language, as long as their vectors
    take up no more than the language's share of ``sample_bytes``. A threshold on that hash, not a sort of the corpus,
    picks them; equal rows count once. One task trains on the vectors, and the model alone comes to the driver.
    """
    known = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    small_batches(documents.sparkSession)
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return train([])
    share = max(1, sample_rows // languages)
    # a threshold on a uniform hash passes about twice the rows wanted
    bound = F.least(F.lit(1.0), (2.0 * share + 50) / F.col("n")) * (1 << 30)
    bounds = counts.select("lang", bound.cast("long").alias("bound"))
    chosen = known.join(F.broadcast(bounds) if languages <= BROADCAST_LANGUAGES else bounds, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("bound"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            lettered = [i for i, t in enumerate(texts) if has_letter(t)]
            vectors = [vector(texts[i], bits) for i in lettered]
            at = pa.array(lettered, pa.int64())
            yield pa.record_batch([batch.column("lang").take(at), batch.column("h").take(at), *(pa.array([v[k].tobytes() for v in vectors], pa.binary()) for k in (0, 1))], ["lang", "h", "index", "counts"])

    chosen = chosen.select("lang", "h", "text").mapInArrow(encode, "lang string, h long, index binary, counts binary").dropDuplicates(["lang", "h"])
    first = W.partitionBy("lang").orderBy("h")  # about 2 * share rows of a language
    size = F.sum(F.octet_length("index") * 2).over(first.rowsBetween(W.unboundedPreceding, 0))
    chosen = chosen.withColumn("k", F.row_number().over(first)).withColumn("size", size).where((F.col("k") == 1) | (F.col("k") <= share) & (F.col("size") <= sample_bytes // languages))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("lang", "h", "index", "counts")), strict=True)), key=lambda r: r[:2])
        yield pa.record_batch([pa.array([pickle.dumps(train([(np.frombuffer(i, np.int32), np.frombuffer(n, np.int32), lang) for lang, _, i, n in got], bits=bits, **how))])], ["model"])

    found = chosen.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([])


def predict(documents: DataFrame, model: LanguageModel, *, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_rejected")) -> DataFrame:
    """Every row with the language, its score and whether it is rejected (replacing columns of those ``names``)."""
    base = documents.drop(*names)
    small_batches(documents.sparkSession)
    shipped = documents.sparkSession.sparkContext.broadcast(model)
    schema = base.select("*", *[F.lit(x).alias(n) for x, n in zip(("", 0.0, False), names, strict=True)]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch, texts in chunks(batches, text_col):
            lang, score, rejected = [], [], []
            for text in texts:
                if not m.language or not has_letter(text):
                    lang.append("und"), score.append(0.0), rejected.append(True)
                    continue
                index, counts = vector(text, m.bits)
                cosine = m.cosines(index, _unit(index, counts, m.idf))
                best = int(np.argmax(cosine > cosine.max() - 1e-6))
                lang.append(m.language[best]), score.append(min(1.0, max(0.0, float(cosine[best]))))
                rejected.append(score[-1] < m.floor[lang[-1]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*batch.schema.names, *names])

    return base.mapInArrow(run, schema)


def langid_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; ids with remainder 1 of 3 are held out."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents.where(remainder("doc_id", 3) != 1))
    found = predict(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def langid_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that lie near enough to a learned language; the model learns from the corpus."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents.where(remainder("doc_id", 3) != 1))
    names = [free_name(docs, n) for n in ("_lang", "_lang_score", "_lang_rejected")]
    return predict(docs, model, names=tuple(names)).where(~F.col(names[2])).drop(*names)
