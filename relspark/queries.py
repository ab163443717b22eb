"""The registered queries of the algebra engine, with their DuckDB texts.

Concepts are key domains of the tables; every result has the columns src and tgt unless it says more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .functions import conversions
from .interfaces import Box, Field, flat_query, nested_query
from .plans.lower import Lowering
from .rules import Checker, Enforcement, Rule, key_violations, property_violations, violation_term
from .storage import link_table, wide_table
from .terms import Atom, Compare, Compl, Compose, Diamond, Equiv, Full, Id, Incl, LeftResidual, Plus, Product, Reduce, Rel, RelAdd, RightResidual, Star, Term


def trade(spark: SparkSession, sf_dir: str) -> Catalog:
    """The driver's tables as concepts and relations."""
    table = cache(lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet"))
    c = Catalog(spark)
    for concept, name, column in (("Order", "orders", "o_orderkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Nation", "nation", "n_nationkey"), ("Region", "region", "r_regionkey"), ("Doc", "documents", "doc_id")):
        c.concept(concept, table(name), column, key=True, closed=True)
    add = lambda n, s, t, name, cols, props="", key=False: c.relation(n, s, t, table(name), cols, props.split(), key=key, proven=["UNI"] * key)
    add("custOf", "Order", "Customer", "orders", ("o_orderkey", "o_custkey"), "UNI TOT", True)
    add("custNation", "Customer", "Nation", "customer", ("c_custkey", "c_nationkey"), "UNI TOT", True)
    add("suppNation", "Supplier", "Nation", "supplier", ("s_suppkey", "s_nationkey"), "UNI TOT", True)
    add("nationRegion", "Nation", "Region", "nation", ("n_nationkey", "n_regionkey"), "UNI TOT", True)
    add("lineSupp", "Order", "Supplier", "lineitem", ("l_orderkey", "l_suppkey"))
    add("linePart", "Order", "Part", "lineitem", ("l_orderkey", "l_partkey"))
    add("custSegment", "Customer", "Segment", "customer", ("c_custkey", "c_mktsegment"), "UNI", True)
    add("orderPrio", "Order", "Priority", "orders", ("o_orderkey", "o_orderpriority"), "UNI", True)
    add("partBrand", "Part", "Brand", "part", ("p_partkey", "p_brand"), "UNI", True)
    add("partSize", "Part", "Size", "part", ("p_partkey", "p_size"), "UNI", True)
    add("suppBal", "Supplier", "Amount", "supplier", ("s_suppkey", "s_acctbal"), "UNI", True)
    add("custBal", "Customer", "Amount", "customer", ("c_custkey", "c_acctbal"), "UNI", True)
    add("nationName", "Nation", "NationName", "nation", ("n_nationkey", "n_name"), "UNI TOT INJ", True)
    add("suppName", "Supplier", "SupplierName", "supplier", ("s_suppkey", "s_name"), "UNI", True)
    add("labelled", "Doc", "Bit", "labels", ("doc_id", "quality"), "UNI")
    turns = table("conversations").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("at"))
    nexts = turns.join(turns.select((F.col("at") - 1).alias("at"), F.col("at").alias("to")), "at")
    c.relation("nextTurn", "Turn", "Turn", nexts, ("at", "to"), ["UNI", "INJ", "IRF"])
    c.concept("Turn", turns, "at")
    nation = table("nation")
    c.relation("ring", "Nation", "Nation", nation.select("n_nationkey", ((F.col("n_nationkey") * 7 + 3) % 25).alias("to")), ("n_nationkey", "to"), ["UNI", "INJ"], key=True)
    near = nation.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("r"))
    c.relation("sameRegion", "Nation", "Nation", near.join(near.select(F.col("a").alias("b"), "r"), "r"), ("a", "b"), ["SYM", "TRN", "RFX"])
    c.relation("succ", "Nation", "Nation", nation.where("n_nationkey < 24").select("n_nationkey", (F.col("n_nationkey") + 1).alias("to")), ("n_nationkey", "to"), ["UNI", "INJ", "ASY", "IRF"], key=True)
    return c


R = {n: Rel(n) for n in "custOf custNation suppNation nationRegion lineSupp linePart custSegment orderPrio partBrand partSize suppBal custBal nationName suppName labelled nextTurn ring sameRegion succ".split()}
_LINE = "(SELECT DISTINCT l_orderkey AS o, s_nationkey AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
_CUST = "(SELECT o_orderkey AS o, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey)"
_RING = "(SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation)"
_SUCC = "(SELECT n_nationkey AS a, n_nationkey + 1 AS b FROM nation WHERE n_nationkey < 24)"
_SAME = "(SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey)"
_NEXT = "(SELECT DISTINCT x.conv_id * 1000000 + x.turn AS a, x.conv_id * 1000000 + x.turn + 1 AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"


def _closed(edges: str) -> str:
    return f"(WITH RECURSIVE p(a, b) AS (SELECT a, b FROM {edges} e0 UNION SELECT p.a, e.b FROM p JOIN {edges} e ON p.b = e.a) SELECT a, b FROM p)"


def _pairs(sql: str, a: str = "a", b: str = "b") -> str:
    return f"SELECT DISTINCT {a} AS src, {b} AS tgt FROM {sql}"


# name -> (term, DuckDB text)
TERMS: dict[str, tuple[Term, str]] = {
    "scan_relation": (R["custOf"], _pairs("orders", "o_orderkey", "o_custkey")),
    "scan_identity": (Id("Nation"), _pairs("nation", "n_nationkey", "n_nationkey")),
    "full_V": (Full("Nation", "Region"), _pairs("nation, region", "n_nationkey", "r_regionkey")),
    "one_V": (Full("ONE", "Nation"), _pairs("nation", "1", "n_nationkey")),
    "singleton": (Atom(7, "Nation"), _pairs("nation WHERE n_nationkey = 7", "n_nationkey", "n_nationkey")),
    "converse": (~R["custOf"], _pairs("orders", "o_custkey", "o_orderkey")),
    "compose": (R["custOf"] >> R["custNation"], _pairs(_CUST, "o", "n")),
    "compose3": (R["custOf"] >> R["custNation"] >> R["nationRegion"], _pairs(f"{_CUST} JOIN nation ON n = n_nationkey", "o", "n_regionkey")),
    "compose_neq": (Compose(R["suppNation"], Compose(Compl(Id()), ~R["custNation"])), _pairs("supplier JOIN customer ON s_nationkey <> c_nationkey", "s_suppkey", "c_custkey")),
    "compose_V": (Compose(R["suppNation"], Compose(Full(), R["nationRegion"])), _pairs("supplier, nation", "s_suppkey", "n_regionkey")),
    "cmp_lt": (Compose(R["suppBal"], Compose(Compare("<"), ~R["custBal"])), _pairs("supplier JOIN customer ON s_acctbal < c_acctbal", "s_suppkey", "c_custkey")),
    "cmp_ge": (Compose(R["suppBal"], Compose(Compare(">="), ~R["custBal"])), _pairs("supplier JOIN customer ON s_acctbal >= c_acctbal", "s_suppkey", "c_custkey")),
    "cmp_rel": (Compare("<", "Nation"), _pairs("nation x JOIN nation y ON x.n_nationkey < y.n_nationkey", "x.n_nationkey", "y.n_nationkey")),
    "union": ((R["lineSupp"] >> R["suppNation"]) | (R["custOf"] >> R["custNation"]), f"SELECT o AS src, n AS tgt FROM {_LINE} UNION SELECT o, n FROM {_CUST}"),
    "intersect": ((R["lineSupp"] >> R["suppNation"]) & (R["custOf"] >> R["custNation"]), f"SELECT o AS src, n AS tgt FROM {_LINE} INTERSECT SELECT o, n FROM {_CUST}"),
    "difference": ((R["lineSupp"] >> R["suppNation"]) - (R["custOf"] >> R["custNation"]), f"SELECT o AS src, n AS tgt FROM {_LINE} EXCEPT SELECT o, n FROM {_CUST}"),
    "anti_flip": (Compl(~R["ring"]) & R["sameRegion"], f"SELECT a AS src, b AS tgt FROM {_SAME} EXCEPT SELECT b, a FROM {_RING}"),
    "inter_singleton": (R["sameRegion"] & Atom(7, "Nation"), _pairs(f"{_SAME} WHERE a = 7 AND b = 7")),
    "inter_identity": (R["ring"] & Id("Nation"), _pairs(f"{_RING} WHERE a = b")),
    "tot_special": (Id("Doc") - (R["labelled"] >> ~R["labelled"]), _pairs("documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL)", "doc_id", "doc_id")),
    "complement": (-R["suppNation"], "SELECT s_suppkey AS src, n_nationkey AS tgt FROM supplier, nation EXCEPT SELECT s_suppkey, s_nationkey FROM supplier"),
    "complement_I": (-Id("Nation"), _pairs("nation x JOIN nation y ON x.n_nationkey <> y.n_nationkey", "x.n_nationkey", "y.n_nationkey")),
    "V_minus": (Full("Supplier", "Nation") - R["suppNation"], "SELECT s_suppkey AS src, n_nationkey AS tgt FROM supplier, nation EXCEPT SELECT s_suppkey, s_nationkey FROM supplier"),
    "product": (Product(R["suppNation"], R["nationRegion"]), _pairs("supplier, nation", "s_suppkey", "n_regionkey")),
    "rres": (RightResidual(R["nationRegion"], R["sameRegion"]), f"SELECT r_regionkey AS src, n_nationkey AS tgt FROM region, nation y WHERE NOT EXISTS (SELECT 1 FROM nation z WHERE z.n_regionkey = r_regionkey AND NOT EXISTS (SELECT 1 FROM {_SAME} s WHERE s.a = z.n_nationkey AND s.b = y.n_nationkey))"),
    "lres": (LeftResidual(R["suppNation"] >> R["nationRegion"], R["nationRegion"]), "SELECT s_suppkey AS src, y.n_nationkey AS tgt FROM supplier JOIN nation x ON s_nationkey = x.n_nationkey JOIN nation y ON x.n_regionkey = y.n_regionkey"),
    "diamond": (Diamond(R["sameRegion"], ~R["sameRegion"]), _pairs(_SAME)),
    "radd": (RelAdd(-R["ring"], R["succ"]), f"SELECT x.n_nationkey AS src, y.n_nationkey AS tgt FROM nation x, nation y WHERE NOT EXISTS (SELECT 1 FROM nation z WHERE EXISTS (SELECT 1 FROM {_RING} r WHERE r.a = x.n_nationkey AND r.b = z.n_nationkey) AND NOT EXISTS (SELECT 1 FROM {_SUCC} s WHERE s.a = z.n_nationkey AND s.b = y.n_nationkey))"),
    "radd_full": (RelAdd(R["sameRegion"], R["succ"]), f"SELECT x.n_nationkey AS src, y.n_nationkey AS tgt FROM nation x, nation y WHERE NOT EXISTS (SELECT 1 FROM nation z WHERE NOT EXISTS (SELECT 1 FROM {_SAME} r WHERE r.a = x.n_nationkey AND r.b = z.n_nationkey) AND NOT EXISTS (SELECT 1 FROM {_SUCC} s WHERE s.a = z.n_nationkey AND s.b = y.n_nationkey))"),
    "kplus_acyclic": (Plus(R["nextTurn"]), _pairs(_closed(_NEXT))),
    "kplus_cyclic": (Plus(R["ring"]), _pairs(_closed(_RING))),
    "kstar": (Star(R["ring"]), f"{_pairs(_closed(_RING))} UNION SELECT n_nationkey, n_nationkey FROM nation"),
    "kreduce": (Reduce(R["nextTurn"]), f"SELECT a AS src, b AS tgt FROM {_NEXT} EXCEPT SELECT n.a, p.b FROM {_NEXT} n JOIN {_closed(_NEXT)} p ON n.b = p.a"),
    "equiv_term": (Equiv(R["ring"], R["succ"]), f"SELECT x.n_nationkey AS src, y.n_nationkey AS tgt FROM nation x, nation y EXCEPT ((SELECT a, b FROM {_RING} EXCEPT SELECT a, b FROM {_SUCC}) UNION (SELECT a, b FROM {_SUCC} EXCEPT SELECT a, b FROM {_RING}))"),
    "incl_term": (Incl(R["ring"], R["sameRegion"]), f"SELECT x.n_nationkey AS src, y.n_nationkey AS tgt FROM nation x, nation y EXCEPT (SELECT a, b FROM {_RING} EXCEPT SELECT a, b FROM {_SAME})"),
    "rule_incl": (violation_term(Incl(R["custOf"] >> R["custNation"], R["lineSupp"] >> R["suppNation"])), f"SELECT o AS src, n AS tgt FROM {_CUST} EXCEPT SELECT o, n FROM {_LINE}"),
    "rule_eq": (violation_term(Equiv(R["ring"], ~R["ring"])), f"(SELECT a AS src, b AS tgt FROM {_RING} EXCEPT SELECT b, a FROM {_RING}) UNION (SELECT b, a FROM {_RING} EXCEPT SELECT a, b FROM {_RING})"),
    "rule_bare": (violation_term(R["sameRegion"]), f"SELECT x.n_nationkey AS src, y.n_nationkey AS tgt FROM nation x, nation y EXCEPT SELECT a, b FROM {_SAME}"),
}

_LINES = "(SELECT DISTINCT l_orderkey AS a, l_suppkey AS b FROM lineitem)"
_PROPERTIES = {
    "prop_uni": ("lineSupp", "UNI", f"SELECT a AS src, a AS tgt FROM {_LINES} GROUP BY a HAVING count(*) > 1"),
    "prop_tot": ("labelled", "TOT", "SELECT doc_id AS src, doc_id AS tgt FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "prop_inj": ("custOf", "INJ", "SELECT o_custkey AS src, o_custkey AS tgt FROM orders GROUP BY 1 HAVING count(*) > 1"),
    "prop_sur": ("succ", "SUR", f"SELECT n_nationkey AS src, n_nationkey AS tgt FROM nation WHERE n_nationkey NOT IN (SELECT b FROM {_SUCC})"),
    "prop_sym": ("ring", "SYM", f"(SELECT a AS src, b AS tgt FROM {_RING} EXCEPT SELECT b, a FROM {_RING}) UNION (SELECT b, a FROM {_RING} EXCEPT SELECT a, b FROM {_RING})"),
    "prop_asy": ("sameRegion", "ASY", f"SELECT a AS src, b AS tgt FROM {_SAME} WHERE a <> b"),
    "prop_trn": ("succ", "TRN", f"SELECT x.a AS src, y.b AS tgt FROM {_SUCC} x JOIN {_SUCC} y ON x.b = y.a EXCEPT SELECT a, b FROM {_SUCC}"),
    "prop_rfx": ("ring", "RFX", f"SELECT n_nationkey AS src, n_nationkey AS tgt FROM nation EXCEPT SELECT a, b FROM {_RING}"),
    "prop_irf": ("ring", "IRF", f"SELECT a AS src, b AS tgt FROM {_RING} WHERE a = b"),
}


def _term(name: str) -> Callable:
    return lambda spark, sf_dir: Lowering(trade(spark, sf_dir)).frame(TERMS[name][0])


def _property(name: str) -> Callable:
    def run(spark, sf_dir):
        c = trade(spark, sf_dir)
        relation, prop, _ = _PROPERTIES[name]
        return property_violations(Lowering(c), c.get(relation), prop)

    return run


def ident_key(spark, sf_dir) -> DataFrame:
    return key_violations(Lowering(trade(spark, sf_dir)), "Part", [R["partBrand"], R["partSize"]])


def _enforce(op: str, what: str) -> Callable:
    def run(spark, sf_dir):
        c = trade(spark, sf_dir)
        e = Enforcement(R["succ"], op, R["ring"] | R["sameRegion"] if op == ">:" else R["ring"] >> R["ring"], Lowering(c))
        return getattr(e, what)()

    return run


def isa_population(spark, sf_dir) -> DataFrame:
    """Parties are customers and suppliers; suppliers' keys are negated so that they stay apart."""
    return _parties(spark, sf_dir).population("Party")


def _parties(spark, sf_dir) -> Catalog:
    c = Catalog(spark, [("Client", "Party"), ("Vendor", "Party")])
    c.concept("Client", spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", key=True)
    c.concept("Vendor", spark.read.parquet(f"{sf_dir}/supplier.parquet").select((-1 - F.col("s_suppkey")).alias("k")), "k", key=True)
    return c


def inter_v_special(spark, sf_dir) -> DataFrame:
    """V of a specialisation: of all parties' nations those of clients."""
    c = _parties(spark, sf_dir)
    c.relation("lives", "Party", "Nation", spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey"))
    c.relation("lives", "Party", "Nation", spark.read.parquet(f"{sf_dir}/supplier.parquet").select((-1 - F.col("s_suppkey")).alias("k"), "s_nationkey"))
    return Lowering(c).frame(Full("Client", "Nation") & Rel("lives"))


def compose_violated_uni(spark, sf_dir) -> DataFrame:
    """A relation that declares UNI and breaks it still gives a set."""
    c = trade(spark, sf_dir)
    c.get("lineSupp").properties |= {"UNI"}
    return Lowering(c).frame(R["lineSupp"] >> R["suppNation"])


def smallest_concept(spark, sf_dir) -> DataFrame:
    return _parties(spark, sf_dir).smallest_concepts("Party")


def wide(spark, sf_dir) -> DataFrame:
    return wide_table(trade(spark, sf_dir), "Supplier")


def link(spark, sf_dir) -> DataFrame:
    return link_table(trade(spark, sf_dir).get("lineSupp"), trade(spark, sf_dir))


def pairview_text(spark, sf_dir) -> DataFrame:
    c = trade(spark, sf_dir)
    rule = Rule("neighbours", Incl(R["ring"], R["sameRegion"]), view=(("TXT", "from "), ("SRC", R["nationName"]), ("TXT", " of "), ("SRC", R["nationRegion"] >> ~R["nationRegion"]), ("TXT", " to "), ("TGT", R["nationName"])))
    return Checker(c, [rule]).texts(rule)


_SUPPLIER = Box("Supplier", Id("Supplier"), (Field("name", R["suppName"]), Field("balance", R["suppBal"]), Field("nation", R["suppNation"], (Field("name", R["nationName"]), Field("region", R["nationRegion"])))))


def interface_nested(spark, sf_dir) -> DataFrame:
    return nested_query(Lowering(trade(spark, sf_dir)), _SUPPLIER)


def broad_query(spark, sf_dir) -> DataFrame:
    return flat_query(Lowering(trade(spark, sf_dir)), _SUPPLIER)


def conv_bool(spark, sf_dir) -> DataFrame:
    words = F.element_at(F.array(*[F.lit(x) for x in (" yes", "No", "WAAR", "onwaar", "maybe", "0")]), (F.col("event_id") % 6 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", conversions.to_boolean(words).alias("flag"))


def conv_split(spark, sf_dir) -> DataFrame:
    cells = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.col("p_brand"), F.lit("; ;"), F.col("p_type")).alias("cell"))
    return conversions.split_cells(cells, "p_partkey", "cell", ";")


def conv_sha(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", conversions.short_id(F.col("text")).alias("short"))


def conv_date(spark, sf_dir) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", conversions.serial_to_date((F.col("o_orderkey") % 50_000).cast("double")).alias("day"), conversions.number_to_text(F.col("o_orderkey").cast("double")).alias("text"))


_OTHERS: dict[str, tuple[Callable, str | None]] = {
    "ident_key": (ident_key, "SELECT x.p_partkey AS src, y.p_partkey AS tgt FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey <> y.p_partkey"),
    "enforce_ins": (_enforce(">:", "inserts"), f"(SELECT a AS src, b AS tgt FROM {_RING} UNION SELECT a, b FROM {_SAME}) EXCEPT SELECT a, b FROM {_SUCC}"),
    "enforce_del": (_enforce(":<", "deletes"), f"SELECT a AS src, b AS tgt FROM {_SUCC} EXCEPT SELECT x.a, y.b FROM {_RING} x JOIN {_RING} y ON x.b = y.a"),
    "enforce_assign": (_enforce(":=", "applied"), f"SELECT DISTINCT x.a AS src, y.b AS tgt FROM {_RING} x JOIN {_RING} y ON x.b = y.a"),
    "isa_population": (isa_population, "SELECT c_custkey AS atom FROM customer UNION SELECT -1 - s_suppkey FROM supplier"),
    "inter_V_special": (inter_v_special, "SELECT DISTINCT c_custkey AS src, c_nationkey AS tgt FROM customer"),
    "compose_violated_uni": (compose_violated_uni, f"SELECT o AS src, n AS tgt FROM {_LINE}"),
    "smallest_concept": (smallest_concept, "SELECT c_custkey AS atom, 'Client' AS concept FROM customer UNION SELECT -1 - s_suppkey, 'Vendor' FROM supplier"),
    "wide_table": (wide, 'SELECT s_suppkey AS "Supplier", s_acctbal AS "suppBal", s_name AS "suppName", s_nationkey AS "suppNation" FROM supplier'),
    "link_table": (link, "SELECT DISTINCT l_orderkey AS src, l_suppkey AS tgt FROM lineitem"),
    "pairview_text": (pairview_text, f"SELECT r.a AS src, r.b AS tgt, 'from ' || x.n_name || ' of ' || (SELECT '{{' || string_agg(CAST(s.b AS VARCHAR), ', ' ORDER BY s.b) || '}}' FROM {_SAME} s WHERE s.a = r.a) || ' to ' || y.n_name AS text FROM {_RING} r JOIN nation x ON r.a = x.n_nationkey JOIN nation y ON r.b = y.n_nationkey WHERE x.n_regionkey <> y.n_regionkey"),
    "interface_nested": (interface_nested, None),
    "broad_query": (broad_query, "SELECT s_suppkey AS src, s_name AS name, s_acctbal AS balance, s_nationkey AS nation, n_name AS nation_name, n_regionkey AS nation_region FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "conv_bool": (conv_bool, "SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE NULL END AS flag FROM events"),
    "conv_split": (conv_split, "SELECT DISTINCT p_partkey AS src, p_brand AS tgt FROM part UNION SELECT p_partkey, p_type FROM part"),
    "conv_sha": (conv_sha, "SELECT doc_id, CASE WHEN length(text) > 254 THEN substring(text, 1, 243) || '_' || substring(sha1(text), 1, 10) ELSE text END AS short FROM documents"),
    "conv_date": (conv_date, "SELECT o_orderkey, DATE '1899-12-30' + CAST(o_orderkey % 50000 AS INTEGER) AS day, CAST(o_orderkey AS VARCHAR) AS text FROM orders"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _term(n) for n in TERMS} | {n: _property(n) for n in _PROPERTIES} | {n: f for n, (f, _) in _OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in TERMS.items()} | {n: sql for n, (*_, sql) in _PROPERTIES.items()} | {n: sql for n, (_, sql) in _OTHERS.items() if sql}
