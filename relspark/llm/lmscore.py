"""Language-model scores by subword lattice likelihood.

A text is a sequence of words (runs outside space and 0x09-0x0D, A-Z lower-cased) and one end. The
pieces of an existing vocabulary form a lattice over each word, which begins with the vocabulary's
word mark; every path is a segmentation, its probability is the product of its pieces', and the
word's probability is the sum over all paths, by a forward recursion in log space. Any byte is an
edge of its own, so no text is impossible.

Learning: the vocabulary's scores, read as a Zipf law over ranks, are the prior of the pieces. Rounds
of expectation and maximisation over all distinct training words, weighted by their counts, fit the
pieces; expected counts come from forward and backward sums over all segmentations. A word that
training holds is one more edge over the whole lattice, with its count less ``discount``; what the
discounts free goes to the segmentations (so the sum over all texts stays at most one). The base score
is the add-0.1 unigram model over the same words.

Scale: rows that follow one another form buckets of bounded text, which are written. A bucket names each of
its distinct words once, with its training count; those rows, which grow with the text and not with the
number of buckets squared, are summed by word, the words' table is fitted and scored where it lies, and a
join by word takes the values back to the buckets. No table of words is broadcast or collected, and a
frequent word costs a bucket no more than a rare one, so no word has more rows than there are buckets (and tasks that share one).
Only expected counts of the pieces, as many as the vocabulary has, come to the driver.

Defined results: a null text is empty and has the end alone. Repeated rows are scored and, if in
training, learned from as often as they occur. Without training rows the base score is 0.0 and the
pieces keep their prior.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import keep, shared_dir, small_batches
from ._text import LOWER
from .toxicity import remainder

_BASE = 0x100000001B3
_LONG = 64
_CHUNK = 8192
_END = 0x656E64
_U = np.uint64


class Lattice:
    """The pieces of a vocabulary as edges over words of bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks, self.ids, self.byte = [], {}, np.zeros(256, np.int64)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                ranks.append(model.get_piece_size())
            elif model.is_control(i) or model.is_unknown(i):
                ranks.append(math.inf)
            else:
                self.ids[piece.replace("▁", " ").encode()] = i
                ranks.append(max(0.0, -model.get_score(i)))
        self.size = len(ranks) + 1  # the last is the end of a text
        weight = 1 / (2.7 + np.array([*ranks, 20.0]))
        self.prior = weight / weight.sum()
        self.continues = np.ones(self.size, bool)
        self.continues[[i for piece, i in self.ids.items() if piece[:1] == b" "]] = False
        self.continues[-1] = False
        self.longest = max(map(len, self.ids))
        self.single = np.full(256, -1, np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.single[piece[0]] = i
        self.power = np.array([pow(_BASE, n, 1 << 64) for n in range(_LONG + 2)], _U)
        self._table([(self._hash(p), i) for p, i in self.ids.items() if 1 < len(p) <= _LONG + 1])

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * _BASE + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _table(self, rows: list[tuple[int, int]], bits: int = 19) -> None:
        """Two open tables; what collides in the first goes to the second, by another multiplier."""
        self.shift = _U(64 - bits)
        for seed in range(1, 200):
            self.spread = [_U((0x9E3779B97F4A7C15 * (2 * seed + k) | 1) & 0xFFFFFFFFFFFFFFFF) for k in (1, 2)]
            self.keys = [np.zeros(1 << bits, _U) for _ in range(2)]
            self.values = [np.full(1 << bits, -1, np.int32) for _ in range(2)]
            if all(self._place(h, i) for h, i in rows):
                return
        raise ValueError("no table without collisions was found")

    def _place(self, h: int, i: int) -> bool:
        for k in range(2):
            at = ((h * int(self.spread[k])) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
            if self.values[k][at] < 0:
                self.keys[k][at], self.values[k][at] = h, i
                return True
        return False

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 where there is none."""
        at = ((h * self.spread[0]) >> self.shift).astype(np.int64)
        out = np.where(self.keys[0][at] == h, self.values[0][at], -1)
        at = ((h * self.spread[1]) >> self.shift).astype(np.int64)
        return np.where(self.keys[1][at] == h, self.values[1][at], out)

    def _groups(self, words: list[bytes]):
        """Short words by length: (rows, bytes with the word mark, piece numbers by length and start)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes[sizes < _LONG]).tolist():
            rows = np.flatnonzero(sizes == n)
            for k in range(0, len(rows), _CHUNK):
                part = rows[k : k + _CHUNK]
                raw = np.frombuffer(b"".join(b" " + words[r] for r in part), np.uint8).reshape(len(part), n + 1)
                prefix = np.zeros((n + 2, len(part)), _U)
                for i in range(n + 1):
                    prefix[i + 1] = prefix[i] * _U(_BASE) + raw[:, i] + _U(1)
                found = {m: self._find(prefix[m:] - prefix[:-m] * self.power[m]) for m in range(2, min(n + 1, self.longest) + 1)}
                yield part, np.ascontiguousarray(raw.T), found

    def log_probability(self, words: list[bytes], p: np.ndarray) -> np.ndarray:
        """Natural logs of the words' probabilities under piece probabilities ``p``."""
        with np.errstate(divide="ignore"):
            log = np.append(np.log(p), -np.inf)  # -1 finds the last
            one = np.log(p[self.byte] + np.where(self.single >= 0, p[self.single], 0.0))
        out = np.empty(len(words))
        for rows, raw, found in self._groups(words):
            a = np.full((len(raw) + 1, len(rows)), -np.inf)
            a[0] = 0.0
            for end in range(1, len(raw) + 1):
                a[end] = a[end - 1] + one[raw[end - 1]]
                for m in range(2, min(end, self.longest) + 1):
                    ids = found[m][end - m]
                    live = np.flatnonzero(ids >= 0)
                    if len(live):
                        a[end, live] = np.logaddexp(a[end, live], a[end - m, live] + log[ids[live]])
            out[rows] = a[-1]
        for r, word in enumerate(words):
            if len(word) >= _LONG:
                out[r] = self._long(b" " + word, log, one)
        return out

    def _edges(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and numbers of the pieces of two bytes and more in one word, by start and end."""
        prefix, h = np.zeros(len(word) + 1, _U), 0
        for i, b in enumerate(word):
            h = (h * _BASE + b + 1) & 0xFFFFFFFFFFFFFFFF
            prefix[i + 1] = h
        starts, ends, found = [], [], []
        for m in range(2, min(len(word), self.longest) + 1):
            if m <= _LONG + 1:
                ids = self._find(prefix[m:] - prefix[:-m] * self.power[m])
            else:
                ids = np.array([self.ids.get(word[i : i + m], -1) for i in range(len(word) - m + 1)])
            at = np.flatnonzero(ids >= 0)
            starts.append(at), ends.append(at + m), found.append(ids[at])
        starts, ends, found = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, ends, found))
        order = np.lexsort((ends, starts))
        return starts[order], ends[order], found[order]

    @staticmethod
    def _sums(single: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> list[float]:
        """Logs of the sums over all paths from 0 to each position, of single bytes and of edges sorted by end."""
        a, k = [0.0], 0
        starts, ends, weights = starts.tolist(), ends.tolist(), weights.tolist()
        for end, x in enumerate(single.tolist(), 1):
            terms = [a[-1] + x]
            while k < len(ends) and ends[k] == end:
                terms.append(a[starts[k]] + weights[k])
                k += 1
            top = max(terms)
            a.append(top + math.log(sum(math.exp(t - top) for t in terms)) if len(terms) > 1 else top)
        return a

    def _long(self, word: bytes, log: np.ndarray, one: np.ndarray) -> float:
        starts, ends, ids = self._edges(word)
        order = np.argsort(ends, kind="stable")
        return self._sums(one[np.frombuffer(word, np.uint8)], starts[order], ends[order], log[ids[order]])[-1]

    def _long_expected(self, word: bytes, log: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one word, in log space: each byte value's expected number as a single; pieces and their expected numbers."""
        starts, ends, ids = self._edges(word)
        raw, n = np.frombuffer(word, np.uint8), len(word)
        order = np.argsort(ends, kind="stable")
        a = np.array(self._sums(one[raw], starts[order], ends[order], log[ids[order]]))
        back = np.lexsort((-ends, -starts))  # the same sums over the word read backwards
        b = np.array(self._sums(one[raw[::-1]], n - ends[back], n - starts[back], log[ids[back]]))[::-1]
        used = np.bincount(raw, np.exp(a[:-1] + one[raw] + b[1:] - a[-1]), 256)
        return used, ids, np.exp(a[starts] + log[ids] + b[ends] - a[-1])

    def expected(self, words: list[bytes], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of each piece in all segmentations of the words, each taken ``counts`` times.

        Sums are scaled by a power of two for each byte. The few words of 64 bytes and more, and any
        that underflow, are summed in log space.
        """
        out = np.zeros(self.size)
        scale = 8.0
        padded = np.append(p, 0.0)
        whole = np.where(self.single >= 0, p[self.single], 0.0)
        one = (p[self.byte] + whole) * scale
        share = whole / (p[self.byte] + whole)
        used = np.zeros(256)
        apart = [r for r, w in enumerate(words) if len(w) >= _LONG]
        for rows, raw, found in self._groups(words):
            n = len(raw)
            step = {m: padded[ids] * scale**m for m, ids in found.items()}
            a, b = np.zeros((n + 1, len(rows))), np.zeros((n + 1, len(rows)))
            a[0], b[n] = 1.0, 1.0
            for end in range(1, n + 1):
                a[end] = a[end - 1] * one[raw[end - 1]]
                for m in range(2, min(end, self.longest) + 1):
                    a[end] += a[end - m] * step[m][end - m]
            for start in range(n - 1, -1, -1):
                b[start] = one[raw[start]] * b[start + 1]
                for m in range(2, min(n - start, self.longest) + 1):
                    b[start] += step[m][start] * b[start + m]
            good = np.isfinite(a[n]) & (a[n] > 1e-280)
            times = np.where(good, counts[rows] / np.where(good, a[n], 1.0), 0.0)
            apart += rows[~good].tolist()
            used += np.bincount(raw.reshape(-1), (a[:-1] * one[raw] * b[1:] * times).reshape(-1), 256)
            for m, ids in found.items():
                live = ids >= 0
                out += np.bincount(ids[live], (a[:-m] * step[m] * b[m:] * times)[live], self.size)
        if apart:
            with np.errstate(divide="ignore"):
                log, log_one = np.log(p), np.log(p[self.byte] + whole)
        for r in apart:
            singles, ids, n = self._long_expected(b" " + words[r], log, log_one)
            used += singles * counts[r]
            out += np.bincount(ids, n * counts[r], self.size)
        np.add.at(out, self.byte, used * (1 - share))
        has = self.single >= 0
        np.add.at(out, self.single[has], (used * share)[has])
        return out


class _Numbers(dict):
    """word -> its number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _numbered(texts: list[bytes | None], numbers: _Numbers) -> list[np.ndarray]:
    """The numbers of each text's words; new words are added to ``numbers``."""
    own = []
    for t in texts:
        words = t.translate(LOWER).split() if t else []
        own.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    return own


_lattices: dict[str, Lattice] = {}  # lives as long as a Python worker


def _lattice(path: str) -> Lattice:
    return _lattices.get(path) or _lattices.setdefault(path, Lattice(path))


def lm_score(docs: DataFrame, vocabulary_path: str, in_training: Column, *, id_col: str = "doc_id", text_col: str = "text", discount: float = 0.75, prior_weight: float = 100.0, rounds: int = 3, bucket_chars: int = 12_000_000) -> DataFrame:
    """id, in_training, n_tokens, n_known, train_tokens, base_score, score; one row per input row."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(in_training, F.lit(False)).alias("train"))
    kind = source.schema["id"].dataType.simpleString()
    ends = source.agg(F.sum(F.col("train").cast("long"))).first()[0] or 0
    small_batches(spark)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that follow one another are a bucket, until their text reaches ``bucket_chars`` bytes."""
        bucket, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1).cast(pa.binary())), 0).to_pylist()
            own = np.empty(len(sizes), np.int64)
            for i, size in enumerate(sizes):
                if held and held + size > bucket_chars:
                    bucket, held = bucket + 1, 0
                own[i], held = bucket, held + size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], ["id", "text", "train", "bucket"])

    dealt = keep(source.mapInArrow(deal, f"id {kind}, text string, train boolean, bucket long"), "dealt", folder)  # written, so that both passes find a row in the same bucket

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of each bucket's rows in this task, each with its number in training texts."""
        numbers, counts, now = _Numbers(), np.zeros(0, np.int64), None

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            for k in range(0, len(words), 65_536):
                part = words[k : k + 65_536]
                yield pa.record_batch([pa.array(np.full(len(part), now, np.int64)), pa.array(part, pa.binary()), pa.array(counts[k : k + 65_536])], ["bucket", "word", "n"])

        for batch in batches:
            buckets = batch.column(0).to_numpy()
            for rows in np.split(np.arange(len(buckets)), np.flatnonzero(np.diff(buckets)) + 1) if len(buckets) else []:
                if buckets[rows[0]] != now:
                    yield from flush()
                    numbers, counts, now = _Numbers(), np.zeros(0, np.int64), buckets[rows[0]]
                part = batch.slice(rows[0], len(rows))
                own = _numbered(part.column(1).cast(pa.binary()).to_pylist(), numbers)
                mine = [o for o, t in zip(own, part.column(2).to_pylist(), strict=True) if t]
                counts = np.pad(counts, (0, len(numbers) - len(counts)))
                if mine:
                    counts += np.bincount(np.concatenate(mine), minlength=len(numbers))
        yield from flush()

    # a bucket that two tasks read names a word twice, which changes neither sums nor answers
    asked = keep(dealt.select("bucket", "text", "train").mapInArrow(gather, "bucket long, word binary, n long"), "asked", folder)
    known = keep(asked.groupBy("word").agg(F.sum("n").alias("n")), "known", folder)
    tokens, types = (int(x or 0) for x in known.agg(F.sum("n"), F.sum((F.col("n") > 0).cast("long"))).first())
    tokens, types = tokens + ends, types + (ends > 0)

    lattice = _lattice(vocabulary_path)
    size, p = lattice.size, lattice.prior
    for _ in range(rounds if tokens else 0):
        p = _maximised(known.where("n > 0"), vocabulary_path, spark.sparkContext.broadcast(p), size, ends, prior_weight * lattice.prior)
    end_probability = p[-1] / (1 - p[lattice.continues].sum())  # an end stands where a word could begin
    shipped = spark.sparkContext.broadcast(p)

    def both(count: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 of the discounted count's share plus the freed mass times the lattice's probability."""
        if not tokens:
            return spelled / math.log(10)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(count - discount, 0) / tokens), math.log(discount * types / tokens) + spelled) / math.log(10)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts in _runs(batches):
            value = both(counts, _lattice(vocabulary_path).log_probability(words, shipped.value))
            yield pa.record_batch([pa.array(words, pa.binary()), pa.array(counts), pa.array(value)], ["word", "n", "value"])

    valued = known.mapInArrow(answer, "word binary, n long, value double")
    back = asked.drop("n").join(valued.hint("merge"), "word")

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        numbers = _Numbers()
        own = _numbered(texts.column("text").cast(pa.binary()).to_pylist(), numbers)
        count, value = np.zeros(len(numbers) + 1), np.zeros(len(numbers) + 1)
        if numbers:
            at = np.fromiter(map(numbers.__getitem__, answers.column("word").to_pylist()), np.int64, answers.num_rows)
            count[at], value[at] = answers.column("n").to_numpy(), answers.column("value").to_numpy()
        count[-1] = ends
        value[-1] = both(np.array([ends]), np.array([math.log(end_probability)]))[0]
        base = np.log10((count + 0.1) / (tokens + 0.1 * (types + 1)))
        rows = [np.append(o, len(numbers)) for o in own]
        columns = [[len(r) for r in rows], [int((count[r] > 0).sum()) for r in rows], [tokens] * len(rows)], [[math.fsum(base[r]) for r in rows], [math.fsum(value[r]) for r in rows]]
        return pa.table([texts.column("id"), texts.column("train"), *[pa.array(c, pa.int64()) for c in columns[0]], *[pa.array(c, pa.float64()) for c in columns[1]]], ["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = dealt.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(score, f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnsRenamed({"id": id_col, "train": "in_training"})


def _runs(batches: Iterable[pa.RecordBatch], most: int = 65_536) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and counts of the batches, about ``most`` at a time."""
    words, counts = [], []
    for batch in batches:
        words += batch.column(0).to_pylist()
        counts.append(batch.column(1).to_numpy())
        if len(words) >= most:
            yield words, np.concatenate(counts)
            words, counts = [], []
    if words:
        yield words, np.concatenate(counts)


def _maximised(known: DataFrame, vocabulary_path: str, shipped, size: int, ends: int, prior: np.ndarray) -> np.ndarray:
    """The next piece probabilities: expected counts over all training words, with the prior's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for words, counts in _runs(batches):
            total += _lattice(vocabulary_path).expected(words, counts, shipped.value)
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(total)], ["piece", "n"])

    sums = known.mapInArrow(run, "piece long, n double").where("n > 0").groupBy("piece").agg(F.sum("n").alias("n"))
    expected = np.zeros(size)
    for r in sums.collect():  # one row for each piece of the vocabulary at most
        expected[r["piece"]] = r["n"]
    expected[-1] = ends
    return (expected + prior) / (expected.sum() + prior.sum())


def vocabulary_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def lm_query(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; ids with remainder 0 of 10 are held out of training."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = lm_score(documents, vocabulary_file(), remainder("doc_id", 10) != 0)
    return found.select("doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
