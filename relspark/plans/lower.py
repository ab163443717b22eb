"""Terms to DataFrames of (src, tgt).

Invariant: a lowered frame has no nulls; ``is_set`` says that it has no repeated pairs either. DISTINCT
runs once, at the end, unless the properties of the term show that there is nothing to remove.
Catalyst picks the join strategy; nothing here is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..operators.closure import transitive_closure
from ..properties import has, is_empty
from ..terms import ONE, Atom, Compare, Compl, Compose, Converse, Diamond, Diff, Equiv, Full, Id, Incl, Inter, LeftResidual, Plus, Product, Reduce, Rel, RelAdd, RightResidual, Star, Term, Union
from ..typing import Typer
from .normalize import Universe, normalize

_OPS = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}

#: Rows of the two sides that a task of `_blockwise` pairs. A block fills two of Parquet's packed runs of 504 dictionary indexes,
#: and dictionaries stay under its 1 MB, beyond which it writes plain values.
BLOCK, CHUNK = 1008, 65_536

#: Rows of a block where the caller has set other files than FILES. Snappy and short pages hold the block's sequence anew time and
#: again, so a shorter one takes less room; still shorter ones make more files, each with a dictionary of the whole chunk.
SHORT = 504

#: What the session writes its files with from a `_blockwise` on, unless the caller has set it. Snappy's copies end after 64 bytes, and
#: each of the usual pages of 20,000 rows holds its block's sequence anew. A row group ends with its first page: Parquet, where what it
#: holds is less than a byte a row, as all but the last page then is, looks at its size after every row.
FILES = {"spark.sql.parquet.compression.codec": "zstd", "parquet.page.row.count.limit": str(1 << 21), "parquet.page.size": str(16 << 20), "parquet.block.row.count.limit": str(1 << 21)}


class ProductTooLarge(ValueError):
    pass


@dataclass(frozen=True)
class Pairs:
    frame: DataFrame
    is_set: bool
    #: the same pairs in an order that takes less room, for a frame that is a result; filters don't reach its sides
    packed: Callable[[], DataFrame] | None = None

    def distinct(self) -> DataFrame:
        return self.frame if self.is_set else self.frame.distinct()


class Lowering:
    """``most_product`` bounds |A| * |B| where a term needs all pairs of two concepts; None asks nothing."""

    def __init__(self, catalog: Catalog, most_product: int | None = 1_000_000_000):
        self.catalog, self.most_product = catalog, most_product
        self.typer = Typer(catalog)

    def frame(self, term: Term) -> DataFrame:
        """The term's pairs as a set."""
        p = self.lower(self.normal(self.typer.resolve(term)))
        return p.packed() if p.packed else p.distinct()

    def frame_of(self, term: Term, concept: str) -> DataFrame:
        """The pairs of a term whose source is the given concept, as a set."""
        return self.lower(self.normal(self.typer.resolve(term, concept))).distinct()

    def normal(self, typed: Term) -> Term:
        """The typed term, rewritten where its concepts allow."""
        return normalize(typed, universe=Universe(self.ends, self.catalog.lattice.leq))

    # concepts of a typed term's ends
    def ends(self, term: Term) -> tuple[str, str]:
        return self.typer.signature(term)

    def lower(self, t: Term) -> Pairs:
        c = self.catalog
        match t:
            case Rel(name, src, tgt):
                return Pairs(*c.rows(c.get(name, src, tgt)))
            case Id(concept):
                return Pairs(c.population(concept).select(F.col("atom").alias("src"), F.col("atom").alias("tgt")), True)
            case Atom(value, concept):
                atoms = c.population(concept).where(F.col("atom") == F.lit(value))
                return Pairs(atoms.select(F.col("atom").alias("src"), F.col("atom").alias("tgt")), True)
            case Full(src, tgt):
                return Pairs(self._product(src, tgt), True)
            case Compare(op, concept):
                return Pairs(self._product(concept, concept, _OPS[op]), True)
            case Union(a, b):
                return Pairs(self.lower(a).frame.unionByName(self.lower(b).frame), False)
            case Inter(a, b):
                return self._inter(a, b)
            case Diff(a, b):
                return self._diff(a, b)
            case Converse(of):
                p = self.lower(of)
                return Pairs(_flip(p.frame), p.is_set)
            case Compose():
                return self._compose(t)
            case Compl(of):
                if isinstance(of, Full):
                    return Pairs(c.empty(*self.ends(of)), True)
                if isinstance(of, Id):
                    return Pairs(self._product(of.concept, of.concept, lambda a, b: a != b), True)
                return Pairs(self._product(*self.ends(of)).join(self.lower(of).frame, ["src", "tgt"], "left_anti"), True)
            case Product(a, b):
                dom = self.lower(a).frame.select("src").distinct()
                cod = self.lower(b).frame.select("tgt").distinct()
                return Pairs(self._all(dom, cod), True)
            case RightResidual(a, b):
                return Pairs(self._residual(a, b), True)
            case LeftResidual(a, b):
                return Pairs(_flip(self._residual(Converse(b), Converse(a))), True)
            case Diamond(a, b):
                return Pairs(self._diamond(a, b), True)
            case RelAdd(a, b):
                # some z outside both refutes a pair
                refuted = self._compose(Compose(Compl(a), Compl(b))).frame
                return Pairs(self._product(self.ends(a)[0], self.ends(b)[1]).join(refuted, ["src", "tgt"], "left_anti"), True)
            case Plus(of):
                return Pairs(transitive_closure(self.lower(of).frame), True)
            case Star(of):
                src, tgt = self.ends(of)
                whole = self.lower(Id(c.lattice.join(src, tgt))).frame
                return Pairs(whole.unionByName(transitive_closure(self.lower(of).frame)), False)
            case Reduce(of):
                r = self.lower(of)
                closed = transitive_closure(r.frame)
                longer = _joined(r.frame, closed)
                return Pairs(r.distinct().join(longer, ["src", "tgt"], "left_anti"), True)
            case Equiv(a, b):
                return self.lower(Diff(Full(*self.ends(t)), Union(Diff(a, b), Diff(b, a))))
            case Incl(a, b):
                return self.lower(Diff(Full(*self.ends(t)), Diff(a, b)))
        raise TypeError(f"no lowering for {type(t).__name__}")

    def _product(self, src: str, tgt: str, keep=None) -> DataFrame:
        """All pairs of atoms of two concepts, or those that ``keep`` accepts."""
        a = self.catalog.population(src).select(F.col("atom").alias("src"))
        b = self.catalog.population(tgt).select(F.col("atom").alias("tgt"))
        if src == ONE:
            return b.select(F.lit(1).alias("src"), "tgt")
        if tgt == ONE:
            return a.select("src", F.lit(1).alias("tgt"))
        if self.most_product is not None and (size := a.count() * b.count()) > self.most_product:
            raise ProductTooLarge(f"V[{src}*{tgt}] has {size} pairs, over the bound of {self.most_product}")
        return a.crossJoin(b) if keep is None else a.join(b, keep(a.src, b.tgt))

    def _inter(self, a: Term, b: Term) -> Pairs:
        for x, y in ((a, b), (b, a)):
            if isinstance(x, Compl) and self._within(y, x.of):
                return self._diff(y, x.of)
        for x, y in ((a, b), (b, a)):
            if isinstance(x, Id):
                p = self.lower(y)
                same = Pairs(p.frame.where("src = tgt"), p.is_set)
                if self.ends(y)[0] == x.concept or self.ends(y)[1] == x.concept:
                    return same
            if isinstance(x, Atom):
                p = self.lower(y)
                held = self.lower(x).frame
                return Pairs(p.frame.where((F.col("src") == F.lit(x.value)) & (F.col("tgt") == F.lit(x.value))).join(held, ["src", "tgt"], "left_semi"), p.is_set)
            if isinstance(x, Full):
                return self._restricted(self.lower(y), self.ends(y), (x.src, x.tgt))
        p = self.lower(a)
        return Pairs(p.frame.join(self.lower(b).frame, ["src", "tgt"], "left_semi"), p.is_set)

    def _within(self, a: Term, b: Term) -> bool:
        return all(self.catalog.lattice.leq(x, y) for x, y in zip(self.ends(a), self.ends(b), strict=True))

    def _restricted(self, p: Pairs, own: tuple[str, str], to: tuple[str, str]) -> Pairs:
        """The pairs whose ends lie in the concepts ``to``: a semi join for each end that isn't there anyway."""
        frame = p.frame
        for end, have, want in zip(("src", "tgt"), own, to, strict=True):
            if not self.catalog.lattice.leq(have, want):
                frame = frame.join(self.catalog.population(want).select(F.col("atom").alias(end)), end, "left_semi")
        return Pairs(frame.select("src", "tgt"), p.is_set)

    def _diff(self, a: Term, b: Term) -> Pairs:
        match a, b:
            case Id(concept), Compose(r, Converse(q)) if r == q:
                # a total relation leaves nothing: look for atoms outside its domain, without the product
                missing = self.catalog.population(concept).join(self.lower(r).frame.select(F.col("src").alias("atom")), "atom", "left_anti")
                return Pairs(missing.select(F.col("atom").alias("src"), F.col("atom").alias("tgt")), True)
            case Full(), Compl(of) if self.ends(a) == self.ends(of):
                return self.lower(of)
            case _, Atom(value, _):
                p = self.lower(a)
                held = self.lower(b).frame
                return Pairs(p.frame.join(held, ["src", "tgt"], "left_anti"), p.is_set)
            case _, Id(concept) if self.ends(a) == (concept, concept):
                p = self.lower(a)
                return Pairs(p.frame.where("src <> tgt"), p.is_set)
        p = self.lower(a)
        return Pairs(p.frame.join(self.lower(b).frame, ["src", "tgt"], "left_anti"), p.is_set)

    def _compose(self, t: Compose) -> Pairs:
        chain = _flat(t)
        if len(chain) == 1:
            return self.lower(chain[0])
        i = next((k for k in range(1, len(chain) - 1) if isinstance(chain[k], (Compare, Full)) or chain[k] == Compl(Id(getattr(getattr(chain[k], "of", None), "concept", None)))), None)
        if i is not None:
            left, right = self._chain(chain[:i]), self._chain(chain[i + 1 :])
            return self._fence(left, chain[i], right)
        return self._chain(chain)

    def _chain(self, chain: list[Term]) -> Pairs:
        """Joins from left to right; a join of sets repeats no pair if the left is UNI or the right INJ."""
        if any(is_empty(t) for t in chain):
            return Pairs(self.catalog.empty(self.ends(chain[0])[0], self.ends(chain[-1])[1]), True)
        if len(chain) > 1 and any(isinstance(t, (Compare, Full)) for t in chain[1:-1]):
            return self._compose(_nested(chain))
        chain = [t for k, t in enumerate(chain) if not (isinstance(t, Id) and len(chain) > 1 and self._covered(chain, k))] or chain[:1]
        out, so_far = self.lower(chain[0]), chain[0]
        for t in chain[1:]:
            right = self.lower(t)
            unique = out.is_set and right.is_set and (has(so_far, "UNI", self.catalog, proven=True) or has(t, "INJ", self.catalog, proven=True))
            out = Pairs(_joined(out.frame, right.frame), unique)
            so_far = Compose(so_far, t)
        return out

    def _covered(self, chain: list[Term], k: int) -> bool:
        """An identity adds nothing beside a neighbour whose own end lies in its concept."""
        own, up = chain[k].concept, self.catalog.lattice
        left = k > 0 and up.leq(self.ends(chain[k - 1])[1], own)
        return left or k + 1 < len(chain) and not isinstance(chain[k + 1], Id) and up.leq(self.ends(chain[k + 1])[0], own)

    def _fence(self, left: Pairs, middle: Term, right: Pairs) -> Pairs:
        """``left ; middle ; right`` where middle is a comparison, V or -I, without its pairs."""
        if isinstance(middle, Full):
            dom, cod = left.frame.select("src").distinct(), right.frame.select("tgt").distinct()
            return Pairs(self._all(dom, cod), True)
        # whether a fitting pair exists depends only on the extremes on each side
        a = left.frame.groupBy("src").agg(F.min("tgt").alias("lo_a"), F.max("tgt").alias("hi_a"))
        b = right.frame.groupBy("tgt").agg(F.min("src").alias("lo_b"), F.max("src").alias("hi_b"))
        if isinstance(middle, Compare):
            near, far = ("lo_a", "hi_b") if middle.op[0] == "<" else ("hi_a", "lo_b")
            a, b = a.select("src", near), b.select("tgt", far)
            fits = lambda at: _OPS[middle.op](at(near), at(far))
        else:
            fits = lambda at: ~((at("lo_a") == at("hi_a")) & (at("lo_a") == at("lo_b")) & (at("lo_b") == at("hi_b")))
        return Pairs(a.join(b, fits(F.col)).select("src", "tgt"), True, lambda: _blockwise(a, b, fits))

    def _residual(self, a: Term, b: Term) -> DataFrame:
        """``a \\ b`` by division: x, y with as many z in both as z under x; x without any z goes with every y."""
        left, right = self.lower(a).distinct(), self.lower(b).distinct()
        need = left.groupBy("tgt").agg(F.count("*").alias("need")).withColumnRenamed("tgt", "x")
        met = left.select("src", F.col("tgt").alias("x")).join(right.select("src", F.col("tgt").alias("y")), "src")
        met = met.groupBy("x", "y").agg(F.count("*").alias("have")).join(need, "x").where("have = need").select(F.col("x").alias("src"), F.col("y").alias("tgt"))
        free = self.catalog.population(self.ends(a)[1]).join(need.select(F.col("x").alias("atom")), "atom", "left_anti")
        every = self.catalog.population(self.ends(b)[1])
        return met.unionByName(self._all(free.select(F.col("atom").alias("src")), every.select(F.col("atom").alias("tgt"))))

    def _diamond(self, a: Term, b: Term) -> DataFrame:
        """Pairs whose sets of z are equal: compared by size and two hashes, never gathered into arrays."""
        left, right = self.lower(a).distinct(), self.lower(b).distinct()
        prints = [F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(s), "z")).alias(f"h{s}") for s in (1, 2)]]
        x = left.select(F.col("src").alias("x"), F.col("tgt").alias("z")).groupBy("x").agg(*prints)
        y = right.select(F.col("tgt").alias("y"), F.col("src").alias("z")).groupBy("y").agg(*prints)
        same = x.join(y, ["n", "h1", "h2"]).select(F.col("x").alias("src"), F.col("y").alias("tgt"))
        no_x = self.catalog.population(self.ends(a)[0]).join(x.select(F.col("x").alias("atom")), "atom", "left_anti").select(F.col("atom").alias("src"))
        no_y = self.catalog.population(self.ends(b)[1]).join(y.select(F.col("y").alias("atom")), "atom", "left_anti").select(F.col("atom").alias("tgt"))
        return same.unionByName(self._all(no_x, no_y))

    def _all(self, src: DataFrame, tgt: DataFrame) -> DataFrame:
        """All pairs of two sides, once their number is known to lie within the bound."""
        if self.most_product is not None and (size := src.count() * tgt.count()) > self.most_product:
            raise ProductTooLarge(f"{size} pairs, over the bound of {self.most_product}")
        return src.crossJoin(tgt)


def _blockwise(a: DataFrame, b: DataFrame, fits: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """The pairs of rows of two sides whose extremes fit, in an order that Parquet packs well.

    The smaller side is broadcast in chunks. A task pairs one chunk with one block of the larger side: each row
    of the chunk with the whole block in turn. In the file one column is then long runs, and the other one is one sequence
    of few values over and over.
    """
    block = BLOCK if _set_files(a.sparkSession) else min(BLOCK, SHORT)
    few, many = sorted(((a.count(), a), (b.count(), b)), key=lambda side: side[0])
    n_chunks, n_blocks = max(1, -(-few[0] // CHUNK)), max(1, -(-many[0] // block))
    chunks = _cut(few[1], CHUNK).select(F.col("part").alias("chunk"), F.col("rows").alias("chunk_rows"))
    cells = _cut(many[1], block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    cells = cells.repartitionById(n_blocks * n_chunks, F.col("part") * n_chunks + F.col("chunk")).join(F.broadcast(chunks), "chunk")
    # A block whose own extremes don't fit has no row that does. The inner filter is a higher-order function, which keeps the first
    # inline out of the generated code of the second one: fused, they would buffer all pairs of a task.
    met = F.filter("chunk_rows", lambda row: fits(lambda end: row[end] if end in few[1].columns else F.col(end)))
    lines = cells.select("rows", F.inline(met))
    return lines.select(*few[1].columns, F.inline("rows")).where(fits(F.col)).select("src", "tgt")


def _set_files(spark: SparkSession) -> bool:
    """Give the session the settings of FILES that neither it nor Hadoop's configuration has; whether it then has them all."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    own = {key: spark.conf.get(key, None) or hadoop.get(key) for key in FILES}
    for key, value in FILES.items():
        if own[key] is None:
            spark.conf.set(key, value)
    return all(own[key] in (None, value) for key, value in FILES.items())


def _cut(side: DataFrame, size: int) -> DataFrame:
    """A side's rows in the order of their extremes, as arrays of ``size`` rows, with the extremes of each array."""
    key, *ends = side.columns
    part = F.floor((F.row_number().over(Window.orderBy(*ends, key)) - 1) / size).cast("int").alias("part")
    rows = F.sort_array(F.collect_list(F.struct(*ends, key))).alias("rows")
    return side.select("*", part).groupBy("part").agg(rows, *[(F.min if e.startswith("lo") else F.max)(e).alias(e) for e in ends])


def _flip(df: DataFrame) -> DataFrame:
    return df.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = left.select("src", F.col("tgt").alias("_z")), right.select(F.col("src").alias("_z"), "tgt")
    return a.join(b, "_z").select("src", "tgt")


def _flat(t: Term) -> list[Term]:
    return _flat(t.left) + _flat(t.right) if isinstance(t, Compose) else [t]


def _nested(chain: list[Term]) -> Term:
    out = chain[-1]
    for t in reversed(chain[:-1]):
        out = Compose(t, out)
    return out
