"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only.

Which documents contain at least ``percent`` of a test item's 5-word shingles?

* Documents are partitioned by set size into powers of two. The sketch of a document is a
  one-permutation MinHash whose number of bins is the upper size of its partition times
  ``2 ** density``: of its sorted shingle hashes the smallest in each bin stays. A bin count that
  follows the size keeps the share of shingles that survive, and so the recall, equal for short and
  very long documents.
* The density comes from the items: with t shingles that a contaminated document must share, a
  survival chance s misses an item with probability (1 - s) ** t, and the coarsest density that keeps
  this under ``miss`` for the smallest item is taken. Items too small for any sketch are a class of
  their own, which looks up every shingle, so that they make no other item dearer.
* An item's shingles look up the sketches; any hit makes a candidate pair.
* Candidates are verified on the full sets: exact shared shingles against the item's number.

Words are runs of characters other than space and 0x09-0x0D of the lower-cased text. A text with
fewer than five words has its whole sequence as its one shingle.

Defined results: null, empty and wordless texts have no shingle and match nothing, on either side;
rows without an id are not reported; rows that repeat an id count as one document or item that has
the shingles of all of them. An empty table gives no row.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._store import keep, remove, shared_dir
from ._text import free_name

BROADCAST_SHINGLES = 1_000_000  # at most 24 bytes each
BROADCAST_IDS = 1_000_000
_SPACE = " \t\n\x0b\f\r"
# Share of shingles that survive, at least, for bins = 2 ** density x upper size of the partition.
_SURVIVE = {-3: 0.122, -2: 0.245, -1: 0.432, 0: 0.632, 1: 0.786, 2: 0.884, 3: 0.940}


def with_shingles(df: DataFrame, text_col: str, out: str, width: int = 5) -> DataFrame:
    """``df`` with the sorted distinct shingle hashes of ``text_col`` instead of it, without wordless rows.

    The word array gets a projection of its own: inside a lambda it would be split again for every word.
    For the same reason the arrays are unnested by ``explode_outer``: ``explode`` makes the optimizer put a
    filter on the array's size below that projection.
    """
    text = F.btrim(F.lower(F.col(text_col)), F.lit(_SPACE))
    rest = [c for c in df.columns if c != text_col]
    words = df.where(F.btrim(F.col(text_col), F.lit(_SPACE)) != "").select(*rest, F.split(text, r"[\x20\x09-\x0D]+").alias(out))
    rolled = F.transform(out, lambda x, i: F.xxhash64(x, *[F.get(out, i + k) for k in range(1, width)]))
    whole = F.slice(rolled, F.lit(1), F.greatest(F.size(out) - (width - 1), F.lit(1)))
    return words.select(*rest, F.sort_array(F.array_distinct(whole)).alias(out))


def density_for(needed: int, miss: float) -> int | None:
    """The coarsest density for items with ``needed`` shared shingles; None: use all shingles."""
    return next((d for d, s in _SURVIVE.items() if needed * math.log(1 - s) <= math.log(miss)), None)


def sketch(hashes: Column, density: int | None) -> Column:
    """The smallest hash of each bin of a sorted array of distinct hashes."""
    if density is None:
        return hashes
    bits = F.greatest(F.lit(0), F.least(F.lit(62), F.ceil(F.log2(F.size(hashes).cast("double"))).cast("int") + density))
    bin_of = lambda h: F.call_function("shiftright", h, F.lit(63) - bits)  # noqa: E731  one bit of it is the sign
    return F.filter(hashes, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(hashes, i - 1))))


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", percent: int = 75, miss: float = 1e-6) -> DataFrame:
    """id, item id, n_shared, n_item, containment for every pair at or above ``percent``."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    item = items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("h")).where("item IS NOT NULL")
    item = with_shingles(item, "h", "h").select("item", F.explode_outer("h").alias("h")).distinct()
    sized = item.groupBy("item").agg(F.count("*").alias("n_item"))
    item = keep(item.join(sized, "item"), "items", folder)
    smallest = next(n for n in range(1, 1000) if density_for(-(-n * percent // 100), miss) is not None)
    sketched = F.col("n_item") >= smallest
    count, tiny, least = item.agg(F.count("*"), F.count_if(~sketched), F.min(F.when(sketched, F.col("n_item")))).first()
    sent = (lambda df: F.broadcast(df)) if count <= BROADCAST_SHINGLES else (lambda df: df)
    looks = [(sketched, density_for(-(-least * percent // 100), miss))] if least else []
    looks += [(~sketched, None)] if tiny else []

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = with_shingles(texts, "text", "s")
    found = [sets.select("id", F.explode_outer(sketch(F.col("s"), d)).alias("h")).join(sent(item.where(which)), "h").select("id", "item") for which, d in looks]
    if not found:
        found = [spark.createDataFrame([], StructType([texts.schema["id"], item.schema["item"]]))]
    pairs = keep(reduce(DataFrame.union, found).distinct(), "pairs", folder)

    ids = pairs.select("id").distinct()
    few = pairs.count() <= BROADCAST_IDS
    again = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    again = with_shingles(again, "text", "s").select("id", F.explode_outer("s").alias("h"))
    shared = again.join(sent(item), "h").select("id", "item", "n_item", "h").distinct()
    shared = shared.groupBy("id", "item", "n_item").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    shared = shared.join(pairs, ["id", "item"], "left_semi")
    out = keep(shared.select(F.col("id").alias(id_col), F.col("item").alias(item_id_col), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")), "out", folder)
    for name in ("items", "pairs"):
        remove(spark, f"{folder}/{name}")
    return out


def decontam_query(spark, sf_dir: str) -> DataFrame:
    """All (doc_id, item_id) with at least 75 % of the item's shingles in the document."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontam_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item, with all their columns, whatever their names.

    Rows without an id are searched under a digest of their text. Rows that repeat an id count as one
    document: if any of them holds an item, or they do together, all go. Empty texts stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated(docs.select("doc_id", "text"), items)
    names = [F.col(f"`{c}`") for c in docs.columns]
    clean = docs.where("doc_id IS NOT NULL").join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(names)
    key = free_name(docs, "_digest")
    unnamed = docs.where("doc_id IS NULL").withColumn(key, F.sha2(F.col("text").cast("binary"), 256))
    if unnamed.isEmpty():
        return clean
    leaks = contaminated(unnamed.select(key, "text").dropDuplicates([key]), items, id_col=key).select(key).distinct()
    return clean.unionByName(unnamed.join(leaks, key, "left_anti").select(names))


DECONTAM_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k : k + 4], ' '))) AS h FROM d WHERE len(w) > 0),
js AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k : k + 4], ' '))) AS h FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM js GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM ds JOIN js USING (h) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 75
"""
