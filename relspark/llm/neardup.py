"""Near-duplicate grouping with SuperMinHash signatures, banding, exact verification and union-find.

A document's set is its distinct ``width``-word shingles (the whole word sequence if it has fewer
words). Two documents are linked when ``100 * |A & B| >= 75 * |A | B|``; components of the link
graph are the groups.

1. *Signatures.* Each shingle walks a Fisher-Yates permutation of the ``slots`` slots that its own
   hash drives; its j-th visit offers ``j + u`` with u uniform. All shingles of a document make
   visit j together, so the walk stops as soon as every slot holds a value below ``j + 1``: one
   visit for long documents, a few for short ones.
2. *Classes.* Documents with equal sets (128-bit digest of the sorted hashes) become one node.
3. *Banding.* ``bands`` bands of ``rows`` slots; with 40 bands of 5 a link at similarity exactly 0.75
   is missed with probability 2e-5, at 0.8 with 1e-7.
4. *Candidates without all pairs.* Every node of a bucket is held against the bucket's most popular node:
   the one that meets the most others in all its buckets. In a group of near copies that is the text
   they were made of, or the one nearest to it, and it is the same in all the group's buckets, so one pair for
   each member joins most of the group. Nodes that still share a bucket with another component meet
   through a prefix filter, which is exact, skips what only a frequent passage has in common, and never
   pairs members of one component.
5. *Verification* on the full sets, 6. *union-find* over the verified links: each task contracts
   its share of the links to stars, until the rest fits one bounded task.

Defined results: a null or empty text, or one without words, has an empty set, is linked with
nothing and stays. Rows with a null id are grouped like others by their text but never name a
component; a component without any id has a null component id, and rows without an id are kept. Repeated
rows come back one for one, and an id with several texts has a row and a component for each. Further columns
of the input are not touched or returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import keep, remove, shared_dir
from ._text import WordHashes, chunks, free_name, mix, shingles, word_hashes

#: Shingles whose sets a round of `verified_in_rounds` shuffles, about 0.2 GB a side, and the most rounds, each of which reads all sets.
ROUND, MOST_ROUNDS = 25_000_000, 8

#: Bits a wanted id of the filter that texts pass before they are shuffled, and its most bits, 32 MB: with more ids, more texts pass it in vain.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28
_PAGE = 15  # bitmap_construct_agg makes bitmaps of 2 ** 15 bits

_STEP = 0x9E3779B97F4A7C15
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class NearDup:
    width: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 5
    union_find_links: int = 500_000

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def superminhash(sets: list[np.ndarray], slots: int, elements: int = 1 << 14) -> np.ndarray:
    """Signatures (texts x slots) of sets of 64-bit hashes, visit number above 32 random bits; empty sets keep the top value."""
    out = np.full((len(sets), slots), _EMPTY, np.uint64)
    start, total = 0, 0
    for i, s in enumerate(sets):
        if i > start and total + len(s) > elements:
            _sign(sets[start:i], out[start:i], slots)
            start, total = i, 0
        total += len(s)
    _sign(sets[start:], out[start:], slots)
    return out


def _sign(sets: list[np.ndarray], sig: np.ndarray, slots: int) -> None:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(owner):
        return
    element = np.concatenate(sets)
    flat = sig.reshape(-1)
    walk = None
    for j in range(slots):
        z = mix(element + np.uint64(_STEP * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        value = (z & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32)
        k = (((z >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64) + j
        if walk is None:
            slot = k
        else:
            rows = np.arange(len(element))
            slot = walk[rows, k].astype(np.int64)
            walk[rows, k] = walk[rows, j]
        np.minimum.at(flat, owner * slots + slot, value)
        open_ = (sig == _EMPTY).any(axis=1)[owner]
        if not open_.any():
            return
        if walk is None:
            element, owner = element[open_], owner[open_]
            walk = np.tile(np.arange(slots, dtype=np.uint16), (len(element), 1))
            rows = np.arange(len(element))
            walk[rows, k[open_]] = 0
            # visit 0 took slot k, so slot 0 takes k's place in the rest of the walk
        elif open_.mean() < 0.7:
            element, owner, walk = element[open_], owner[open_], walk[open_]


def _version(text: Column) -> Column:
    return F.xxhash64(text)


def _signed(docs: DataFrame, id_col: str, text_col: str, how: NearDup) -> DataFrame:
    """id, version, n_shingles, digest and more (128 bits that name the set), bands (a key for each band)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _version(F.col(text_col)).alias("version"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch, texts in chunks(batches):
            sets = shingles(*word_hashes(texts, memo), how.width)
            sig = superminhash(sets, how.slots).reshape(len(sets), how.bands, how.rows)
            key = np.arange(1, how.bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
            for r in range(how.rows):
                key = mix(key + sig[:, :, r])
            digest, more = _digests(sets)
            offsets = pa.array(np.arange(0, (len(sets) + 1) * how.bands, how.bands, dtype=np.int32))
            yield pa.record_batch(
                [batch.column("id"), batch.column("version"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest), pa.array(more), pa.ListArray.from_arrays(offsets, pa.array(key.reshape(-1).view(np.int64)))],
                ["id", "version", "n_shingles", "digest", "more", "bands"],
            )

    return source.mapInArrow(run, f"id {kind}, version long, n_shingles long, digest long, more long, bands array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, how: NearDup, folder: str | None = None) -> DataFrame:
    """node, hashes (the full sorted set) and, if ``nodes`` has it, central of the given nodes, each from one text: that of its smallest id, or one without an id."""
    folder = folder or shared_dir(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("low"), F.col(text_col).alias("text"))
    role = [c for c in nodes.columns if c == "central"]
    known = ["node", "digest", "more", *role]  # they pass through Python with the text, so that only texts are shuffled, not sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch, texts in chunks(batches):
            sets = shingles(*word_hashes(texts, memo), how.width)
            digest, more = _digests(sets)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            hashes = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.record_batch([*map(batch.column, known), pa.array(digest), pa.array(more), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes))], [*known, "d", "m", "hashes"])

    made = f"node long, digest long, more long,{' central boolean,' * len(role)} d long, m long, hashes array<long>"
    own = (F.col("d") == F.col("digest")) & (F.col("m") == F.col("more"))  # a repeated id may have other texts
    wanted = nodes.where("low IS NOT NULL").select("low", *known)
    named = _likely(texts, wanted).join(wanted, "low").select(*known, "text").mapInArrow(run, made).where(own)
    found = named.select("node", *role, "hashes")
    nameless = nodes.where("low IS NULL").select(F.col("node").alias("n"), "digest", "more", *role)
    if not nameless.isEmpty():
        blank = [F.lit(None).cast("boolean" if c == "central" else "long").alias(c) for c in known]
        unnamed = texts.where("low IS NULL").select(*blank, "text").mapInArrow(run, made).select(F.col("d").alias("digest"), F.col("m").alias("more"), "hashes")
        found = found.union(unnamed.join(nameless, ["digest", "more"]).select(F.col("n").alias("node"), *role, "hashes"))
    found = keep(found, "texts-sets", folder)
    # only rows that repeat an id or have none give a node several sets, all equal; without such rows no set is shuffled
    if not found.groupBy("node").count().where("count > 1").isEmpty():
        found = keep(found.dropDuplicates(["node"]), "sets", folder)
        remove(docs.sparkSession, f"{folder}/texts-sets")
    return found


def _likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts whose id (low) is a wanted one, and about one in FILTER_BITS of the others: a bitmap of hashes, broadcast, decides without a shuffle."""
    bits = min(MOST_FILTER_BITS, max(1 << _PAGE, FILTER_BITS * wanted.count()))
    at = F.pmod(F.xxhash64("low"), F.lit(bits))
    page, bit = F.shiftright(at, _PAGE).alias("page"), at.bitwiseAND(F.lit((1 << _PAGE) - 1))
    pages = wanted.select(page, bit.alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("marks"))
    byte = F.conv(F.hex(F.substring("marks", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    marked = F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    return texts.withColumn("page", page).join(F.broadcast(pages), "page").where(marked).select(*texts.columns)


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    halves = np.frombuffer(b"".join(map(_digest, sets)), "<i8").reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def verified(pairs: DataFrame, firsts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``firsts``: the sets of every a, of which one copy goes to each pair."""
    left = firsts.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    shared = F.size(F.array_intersect("ha", "hb"))
    linked = shared * 100 >= (F.size("ha") + F.size("hb") - shared) * percent
    return pairs.join(left, "a").join(right, "b").where(linked).select("a", "b")


def verified_in_rounds(pairs: DataFrame, firsts: DataFrame, sets: DataFrame, percent: int, folder: str, name: str, volume: int) -> DataFrame:
    """``verified``, a share of the nodes b after the other: the disk holds the shuffled sets of one share of at most about ROUND shingles; ``volume``: those of all sets."""
    rounds = max(1, min(MOST_ROUNDS, -(-volume // ROUND)))
    share = lambda df, node, i: df.where(F.pmod(F.xxhash64(node), F.lit(rounds)) == i) if rounds > 1 else df
    links = [keep(verified(share(pairs, "b", i), firsts, share(sets, "node", i), percent), f"{name}{i}", folder) for i in range(rounds)]
    return reduce(DataFrame.union, links)


def components(links: DataFrame, folder: str, name: str, bound: int) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the kept links (a, b).

    Tasks contract their share of the links to stars by union-find, then every node passes its
    smallest neighbour to its larger ones (large star) and joins its smaller ones to it (small
    star), until nothing changes. As soon as at most ``bound`` links are left, one task of that
    proven size finishes them.
    """
    smaller = F.when(F.col("a") < F.col("b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).otherwise(F.struct("a", "b"))
    stars = links.select(smaller.alias("s")).select("s.*").where("a <> b")
    turn = 0
    while stars.count() > bound:
        turn += 1
        local = keep(stars.mapInArrow(_contract, "a long, b long").where("a <> b").distinct(), f"{name}-local{turn}", folder)
        ends = local.select("a", "b").union(local.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("low")).withColumnRenamed("a", "k")
        large = keep(local.join(least, F.col("b") == F.col("k")).select("a", F.col("low").alias("b")).where("a <> b").distinct(), f"{name}-large{turn}", folder)
        low = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "k")
        met = large.join(low, F.col("a") == F.col("k"))
        after = met.select("a", F.col("low").alias("b")).union(met.select(F.col("b").alias("a"), F.col("low").alias("b")))
        after = keep(after.where("a <> b").distinct(), f"{name}-stars{turn}", folder)
        roots = after.select(F.col("b").alias("a"))
        settled = after.groupBy("a").count().where("count > 1").isEmpty() and after.join(roots, "a", "left_semi").isEmpty()
        stars = after
        if settled:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    done = stars.repartition(1).mapInArrow(_contract, "a long, b long")
    return keep(done.select(F.col("a").alias("node"), F.col("b").alias("root")), f"{name}-roots", folder)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the links read, with the smallest node that they join it to."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", how: NearDup = NearDup()) -> DataFrame:
    """One row per input row: the id, n_shingles, component_id (smallest id of its group), kept."""
    rows = grouped(docs, id_col=id_col, text_col=text_col, how=how)
    out = rows.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull() | F.col(id_col).isNull()))


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", how: NearDup = NearDup()) -> DataFrame:
    """One row per input row: id, version (a hash of the text), n_shingles, group (null without words), component (its smallest id)."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    signed = keep(_signed(docs, id_col, text_col, how), "signed", folder)
    nodes = signed.where("n_shingles > 0").groupBy("digest", "more").agg(F.min("id").alias("low"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", folder)
    signed = keep(signed.drop("bands"), "counted", folder)
    remove(spark, f"{folder}/signed")

    # buckets of at least two nodes, and the most popular node of each: the one with the most company in all its buckets
    entries = nodes.select("node", "n", F.explode("bands").alias("key"))
    crowds = entries.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
    shared = keep(entries.join(crowds, "key"), "buckets", folder)
    nodes = keep(nodes.drop("bands"), "named", folder)
    remove(spark, f"{folder}/nodes")
    popular = shared.groupBy("node").agg(F.sum("crowd").alias("pop"))
    centres = shared.join(popular, "node").groupBy("key").agg(F.max(F.struct("pop", "node", "n")).alias("c"))
    shared = keep(shared.join(centres, "key").select("key", "node", "n", F.col("c.node").alias("centre"), F.col("c.n").alias("size")).where("node <> centre"), "stars", folder)
    remove(spark, f"{folder}/buckets")

    # popularity orders all nodes, so two of them have the same centre in all their buckets; the sets of mere members are shuffled once
    busy = shared.select("node", F.lit(False).alias("central")).union(shared.select("centre", F.lit(True))).groupBy("node").agg(F.max("central").alias("central"))
    wanted = keep(nodes.join(busy, "node"), "wanted", folder)
    sets = _sets(docs, id_col, text_col, wanted, how, folder)
    volume = wanted.agg(F.sum("n")).first()[0] or 0
    pairs = shared.where(_sizes_fit("n", "size", how.percent)).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    pairs = keep(pairs, "pairs", folder)
    links = verified_in_rounds(pairs, sets.where("central"), sets, how.percent, folder, "links", volume)
    roots = components(links, folder, "c", how.union_find_links)

    # pairs with a bucket's centre are decided; what is open are the other members that still are in different components
    rooted = shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    parted = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    open_ = keep(rooted.join(parted, "key").select("node", "root").distinct(), "open", folder)
    if not open_.isEmpty():
        pairs = keep(_prefix_pairs(open_, sets, folder, how), "prefix-pairs", folder)
        links = links.union(verified_in_rounds(pairs, sets, sets, how.percent, folder, "more-links", volume))
        roots = components(links, folder, "d", how.union_find_links)

    named = nodes.join(roots, "node", "left").select("digest", "more", "low", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("low").alias("component"))
    named = named.join(names, "root").select("digest", "more", F.col("root").alias("group"), "component")
    wordless = signed.where("n_shingles = 0").select("id", "version", "n_shingles", F.lit(None).cast("long").alias("group"), F.col("id").alias("component"))
    out = signed.where("n_shingles > 0").join(named, ["digest", "more"]).select(*wordless.columns).unionByName(wordless)
    out = keep(out, "out", folder)
    for name in ("counted", "named", "stars", "wanted", "texts-sets", "sets", "pairs", "open", "prefix", "prefix-pairs", *(f"{x}{i}" for x in ("links", "more-links") for i in range(MOST_ROUNDS))):
        remove(spark, f"{folder}/{name}")
    return out


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _prefix_pairs(open_: DataFrame, sets: DataFrame, folder: str, how: NearDup) -> DataFrame:
    """All pairs (a, b) of the open nodes (node, root) that could be linked, but for those of one component.

    Under any one order of all shingles, two sets that are similar enough share a shingle among the first
    ``n - ceil(n * percent / 100) + 1`` of each. The rarest come first, so what a frequent passage adds to
    documents that are otherwise different pairs nothing. The places of the first shared shingle also bound
    what can be shared behind it, which leaves out most pairs before they become rows. In the list
    of a shingle, members of its largest component are held against the others, never against each other.
    """
    members = sets.join(open_, "node").select("node", "root", F.size("hashes").cast("long").alias("n"), "hashes")
    members = keep(members, "members", folder)
    every = members.select("node", F.explode("hashes").alias("h"))
    often = every.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    met = every.join(often, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("met"))  # one document's shingles at most
    met = members.select("node", "root", "n").join(met, "node")
    alone, reach = F.col("n") - F.size("met"), F.col("n") - F.ceil(F.col("n") * how.percent / 100) + 1
    first = met.withColumn("alone", alone).withColumn("reach", reach.cast("long")).where("reach > alone")
    first = first.select("node", "root", "n", "alone", F.posexplode(F.slice("met", F.lit(1), (F.col("reach") - F.col("alone")).cast("int"))).alias("p", "x"))
    first = keep(first.select("node", "root", "n", (F.col("n") - F.col("alone") - F.col("p")).alias("rest"), F.col("x.h").alias("h")), "prefix", folder)  # rest: this shingle and all behind it
    remove(first.sparkSession, f"{folder}/members")

    largest = first.groupBy("h", "root").agg(F.count("*").alias("k")).groupBy("h").agg(F.max(F.struct("k", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1")
    others = first.join(largest.select("h", F.col("m.root").alias("main")), "h").where("root <> main")
    others = others.select("h", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("rest").alias("rest_a"))
    possible = F.least("rest", "rest_a") * (100 + how.percent) >= (F.col("n") + F.col("na")) * how.percent
    pairs = others.join(first, "h").where("root <> ra").where(_sizes_fit("n", "na", how.percent)).where(possible)
    return pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def near_dup_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def near_dup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: of those with the smallest id the one whose text has the smallest hash.

    Rows that repeat an id with texts of different groups are judged each by its own text. Rows without an
    id, without a text or without words all stay; so do further columns, whatever their names.
    """
    found = grouped(docs.select("doc_id", "text")).where("id IS NOT NULL AND group IS NOT NULL")
    stays = found.groupBy("group").agg(F.min(F.struct("id", "version")).alias("s"))
    key = free_name(docs, "_text_of_id")
    pair = F.struct("id", "version").alias(key)
    goes = found.join(stays, "group").where(F.struct("id", "version") != F.col("s")).select(pair).distinct()
    twice = found.groupBy("id", "version").count().where("count > 1").select(pair)
    own = F.struct(F.col("doc_id").alias("id"), _version(F.col("text")).alias("version"))
    named = docs.where("doc_id IS NOT NULL").withColumn(key, own).join(goes, key, "left_anti")
    if not twice.isEmpty():
        named = named.join(twice, key, "left_anti").unionByName(named.join(twice, key, "left_semi").dropDuplicates([key]))
    return named.drop(key).unionByName(docs.where("doc_id IS NULL")).select([F.col(f"`{c}`") for c in docs.columns])
