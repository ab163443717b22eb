"""Packing tokenized documents into fixed-length sequences by minimum bin slack.

1. *Tokens.* Ids of each text, then ``end_id``; only documents longer than ``capacity`` are cut, into
   pieces of that length and a rest. No token of the vocabulary spans white space, so the ids of a
   text are those of its parts (letters, single digits, other signs) one after the other, and a memo of
   parts that is bounded in bytes saves most of the tokenizer's work.
2. *Plan.* All that packing needs is how many pieces of each length there are: at most ``capacity``
   numbers. Bin by bin, the largest length left is taken and a bitset subset-sum over the other
   lengths finds the fullest feasible rest; that combination is repeated as often as the counts
   allow and removed. The driver's work depends on the number of distinct lengths, not of pieces.
3. *Places.* A piece's rank among those of its length, counted per (length, salt) and offset by the
   counts of the salts before, names its sequence and its offset there. Salts come from numbers that are
   written with the pieces, so neither a frequent length nor a row repeated without end is one task's.

Defined results: a null or empty text is one piece with ``end_id`` alone; repeated rows and rows with
null ids are packed one by one like any other; an empty table gives no piece. Other columns of the
input are not returned.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import keep, shared_dir
from ._text import chunks

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_EASY = re.compile(f"[\\t-\\r !-~{_LATIN}]*")
# Fixed value: the vocabulary's own word pattern, for the characters of _EASY.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\\t-\\r {_LATIN}0-9]+")
_SPECIAL = b"<|"
# The letters that byte-level vocabularies write bytes with: printable Latin-1 as it is, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip(_PRINTABLE, _PRINTABLE)) | dict(zip(sorted(set(range(256)) - set(_PRINTABLE)), range(256, 512)))


class PartIds:
    """Parts of texts -> their ids as little-endian unsigned 32-bit bytes, by the tokenizer in ``path``.

    A text of easy characters is cut into its parts here, and each part goes to the tokenizer's model; any
    other word goes to the tokenizer as it is. What is known is kept in two generations of
    ``most_bytes / 2`` each: when the younger is full it replaces the older, so a part that is met again in time stays.
    """

    def __init__(self, path: str, most_bytes: int = 48 << 20):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model.tokenize
        self.known, self.older, self.held, self.most = {}, {}, 0, most_bytes // 2

    @staticmethod
    def parts(text: bytes | None) -> list[str | bytes]:
        """The parts of a text: lower-cased strings of easy words, other words as they are."""
        if not text:
            return []
        if _SPECIAL not in text and _EASY.fullmatch(easy := text.decode("utf-8", "replace")):
            return _PARTS.findall(easy.lower())
        out = []
        for w in text.split():
            if _SPECIAL not in w and _EASY.fullmatch(easy := w.decode("utf-8", "replace")):
                out += _PARTS.findall(easy.lower())
            else:
                out.append(w)
        return out

    def learn(self, texts: list[list[str | bytes]]) -> None:
        """Add all parts of the texts that are missing; without the cycle collector, which would scan them again and again."""
        gc.disable()
        try:
            if self.held > self.most:
                self.known, self.older, self.held = {}, self.known, 0
            missing = set().union(*texts).difference(self.known)
            again = missing.intersection(self.older)
            for x in again:
                self._add(x, self.older[x])
            hard = []
            for x in missing.difference(again):
                if type(x) is bytes:
                    hard.append(x)
                else:
                    spelled = x if x.isascii() else x.encode().decode("latin-1").translate(_BYTES)
                    self._add(x, array("I", [t.id for t in self.model(spelled)]).tobytes())
            for i in range(0, len(hard), 512):
                run = hard[i : i + 512]
                for x, e in zip(run, self.whole.encode_batch_fast([x.decode("utf-8", "replace") for x in run], add_special_tokens=False), strict=True):
                    self._add(x, array("I", e.ids).tobytes())
        finally:
            gc.enable()

    def forget(self) -> None:
        self.known, self.older, self.held = {}, {}, 0

    def _add(self, part: str | bytes, ids: bytes) -> None:
        self.known[part] = ids
        self.held += 190 + len(part) + len(ids)


_tokenizers: dict[str, PartIds] = {}  # live as long as a Python worker; what they know is forgotten after each task


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if asked for, ids of every piece."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _tokenizers.get(tokenizer_path) or _tokenizers.setdefault(tokenizer_path, PartIds(tokenizer_path))
        for batch, texts in chunks(batches):
            parts = list(map(memo.parts, texts))
            memo.learn(parts)
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, own in enumerate(parts):
                raw = b"".join(map(memo.known.__getitem__, own)) + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    owner.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(batch.schema.get_field_index("id")).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.record_batch(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
        memo.forget()

    return source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) of the bins that use up ``counts``: each the fullest around its largest length."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left, reverse=True)
    bins = []
    while lengths:
        top = lengths[0]
        chosen = {top: 1}
        for n in _fullest(lengths, left, capacity - top, top):
            chosen[n] = chosen.get(n, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        bins.append((times, chosen))
        for n, k in chosen.items():
            left[n] -= times * k
        lengths = [n for n in lengths if left[n]]
    return bins


def _fullest(lengths: list[int], left: dict[int, int], room: int, taken: int) -> list[int]:
    """The lengths, each at most as often as it is left, whose sum comes closest to ``room`` from below."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        if n > room:
            continue
        for _ in range(min(left[n] - (n == taken), room // n)):
            wider = (reach | reach << n) & mask
            if wider == reach:
                break
            steps.append((n, reach))
            reach = wider
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> at & 1:
            out.append(n)
            at -= n
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = True, salt_rows: int = 200_000) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    folder = shared_dir(docs.sparkSession)
    cut = pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, with_ids=with_ids)
    cut = keep(cut.withColumn("row", F.monotonically_increasing_id()), "pieces", folder)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    salts = max(64, sum(counts.values()) // salt_rows)

    seats, number, used = [], 0, dict.fromkeys(counts, 0)
    for times, chosen in plan_bins(counts, capacity):
        offset = 0
        for n, k in chosen.items():
            seats.append((n, used[n], number, k, offset))
            used[n] += times * k
            offset += n * k
        number += times
    seats = np.array(sorted(seats), np.int64).reshape(-1, 5)

    salted = cut.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("row")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")

    @F.pandas_udf("sequence_id long, offset long")
    def seat(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(seats[:, 0] * (1 << 42) + seats[:, 1], length * (1 << 42) + rank, side="right") - 1
        _, first, number, copies, offset = seats[at].T
        turn, copy = np.divmod(rank - first, copies)
        return pd.DataFrame({"sequence_id": number + turn, "offset": offset + copy * length})

    out = ranked.withColumn("seat", seat("length", "rank")).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "seat.sequence_id", "seat.offset")
    return out


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def packing_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file(), with_ids=False)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents."""
    return pack(docs, tokenizer_file(), with_ids=False)
