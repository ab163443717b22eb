"""Known answers on small populations: closures, properties, products, specialisation, comparisons."""

import random

import pytest
from pyspark.sql import functions as F

from relspark.plans.lower import Lowering
from relspark.rules import Checker, property_rules
from relspark.script import ScriptError, parse_script, parse_term
from relspark.storage import wide_table
from relspark.interfaces import nested_query

ATOMS = range(10, 15)


def holds(prop, r):
    """Whether a set of pairs over ATOMS has a property, by its definition."""
    return {
        "UNI": all(b == d for a, b in r for c, d in r if a == c),
        "INJ": all(a == c for a, b in r for c, d in r if b == d),
        "TOT": all(any(a == x for a, _ in r) for x in ATOMS),
        "SUR": all(any(b == x for _, b in r) for x in ATOMS),
        "SYM": all((b, a) in r for a, b in r),
        "ASY": all(a == b or (b, a) not in r for a, b in r),
        "TRN": all((a, d) in r for a, b in r for c, d in r if b == c),
        "RFX": all((x, x) in r for x in ATOMS),
        "IRF": all(a != b for a, b in r),
    }[prop]


def drawn(rng, prop, wanted):
    """A random relation of at least three pairs that has the property, or has it not."""
    while True:
        r = {(a, b) for a in ATOMS for b in ATOMS if rng.random() < 0.3} | ({(x, x) for x in ATOMS} if prop == "RFX" and wanted else set())
        if prop in ("UNI", "INJ", "SYM", "TRN", "ASY", "IRF") and wanted:
            r = set(rng.sample(sorted(r), min(len(r), 4)))
            r |= {(b, a) for a, b in r} if prop == "SYM" else set()
        if len(r) >= 3 and holds(prop, r) == wanted:
            return r


def listed(pairs):
    return " ; ".join(f"({a},{b})" for a, b in sorted(pairs))


def rows(df):
    return {tuple(r) for r in df.select("src", "tgt").collect()}


def test_properties_hold_and_break(spark):
    rng = random.Random(21)
    properties = "UNI INJ TOT SUR SYM ASY TRN RFX IRF".split()
    text = "".join(f"RELATION {k}{n}[A*A] [{k}] = [ {listed(drawn(rng, k, n == 0))} ]\n" for n in (0, 1) for k in properties)
    s = parse_script(f"CONTEXT X REPRESENT A TYPE INTEGER POPULATION A CONTAINS [ {', '.join(map(str, ATOMS))} ]\n{text}ENDCONTEXT")
    c = s.catalog(spark)
    failing = set(Checker(c, property_rules(c)).failing_invariants())
    assert {f.split()[1][3] for f in failing} == {"1"} and len(failing) == 9


def test_product_with_an_integer_concept(spark):
    s = parse_script('CONTEXT X REPRESENT Shelf TYPE INTEGER RELATION holds[Shelf*Tool] = [ (40,"saw") ; (41,"file") ; (41,"saw") ; (57,"awl") ] ENDCONTEXT')
    low = Lowering(s.catalog(spark))
    assert rows(low.frame(parse_term('I[Shelf] # {"awl"}[Tool]'))) == {(k, "awl") for k in (40, 41, 57)}
    assert rows(low.frame(parse_term('holds - (I[Shelf] # {"saw"}[Tool])'))) == {(41, "file"), (57, "awl")}
    with pytest.raises(ScriptError):
        parse_script('CONTEXT X REPRESENT Shelf TYPE INTEGER RELATION holds[Shelf*Tool] = [ ("top","saw") ] ENDCONTEXT').catalog(spark)


def test_reduction_and_star(spark):
    stairs = {(a, b) for a in range(6) for b in range(a + 1, 6) if b - a < 4}
    s = parse_script(f"CONTEXT X REPRESENT N TYPE INTEGER RELATION r[N*N] = [ {listed(stairs)} ] RELATION e[N*N] POPULATION N CONTAINS [ 77 ] ENDCONTEXT")
    low = Lowering(s.catalog(spark))
    assert rows(low.frame(parse_term("r%"))) == {(a, a + 1) for a in range(5)}
    assert rows(low.frame(parse_term("e*"))) == {(x, x) for x in (*range(6), 77)} and rows(low.frame(parse_term("e%"))) == set()


def test_comparisons_and_specialisation(spark):
    s = parse_script("""CONTEXT X CLASSIFY Female ISA Person CLASSIFY Male ISA Person REPRESENT Age TYPE INTEGER
    RELATION age[Person*Age] [UNI,TOT] = [ ("eva",40) ; ("kai",12) ]
    RELATION parent[Person*Person] = [ ("eva","kai") ; ("kai","eva") ]
    RELATION husband[Female*Male] [UNI,INJ] = [ ("eva","adam") ]
    RULE parent |- age;(>);age~ ENDCONTEXT""")
    c = s.catalog(spark)
    assert rows(Checker(c, s.rules).check()["rule 1"]) == {("kai", "eva")}
    assert {r["atom"] for r in c.population("Person").collect()} == {"eva", "kai", "adam"} and {r["atom"] for r in c.population("Male").collect()} == {"adam"}


def test_typed_literals(spark):
    s = parse_script("CONTEXT X REPRESENT D TYPE DATE REPRESENT T TYPE DATETIME REPRESENT B TYPE BOOLEAN REPRESENT F TYPE FLOAT RELATION a[D*T] = [ (2015-10-10, 2015-10-10T23:59:59.123+05:30) ] RELATION b[B*F] = [ (TRUE, 1) ; (FALSE, 5.5) ] ENDCONTEXT")
    c = s.catalog(spark)
    row = c.pairs(c.get("a")).selectExpr("cast(src as string)", "cast(tgt as string)").first()
    assert tuple(row) == ("2015-10-10", "2015-10-10 18:29:59")
    assert rows(c.pairs(c.get("b"))) == {(True, 1.0), (False, 5.5)}


def test_v_of_a_specialisation_restricts(spark):
    s = parse_script("""CONTEXT X CLASSIFY Kid ISA Person RELATION likes[Person*Person] = [ ("a","b") ; ("b","a") ; ("c","b") ]
    RELATION naps[Kid*Kid] = [ ("a","a") ] ENDCONTEXT""")
    low = Lowering(s.catalog(spark))
    assert rows(low.frame(parse_term("V[Kid*Person] /\\ likes"))) == {("a", "b")}
    assert rows(low.frame(parse_term("likes /\\ V[Kid*Kid]"))) == set()
    assert rows(low.frame(parse_term("V[Kid*Person] - (V[Kid*Person] - likes)"))) == {("a", "b")}
    assert rows(low.frame(parse_term("likes - V[Kid*Person]"))) == {("b", "a"), ("c", "b")}
    assert rows(low.frame(parse_term("likes \\/ (likes - V[Kid*Kid])"))) == {("a", "b"), ("b", "a"), ("c", "b")}


def test_violated_declarations_keep_sets_and_stop_wide_tables(spark):
    s = parse_script("""CONTEXT X RELATION f[A*B] [UNI] = [ ("a","x") ; ("a","y") ] RELATION g[B*C] [UNI] = [ ("x","u") ; ("y","u") ] ENDCONTEXT""")
    c = s.catalog(spark)
    assert [tuple(r) for r in Lowering(c).frame(parse_term("f;g")).collect()] == [("a", "u")]
    assert wide_table(c, "B").count() == 2
    with pytest.raises(Exception, match="more than one value"):
        wide_table(c, "A").collect()


def test_texts_defaults_and_interface_references(spark):
    s = parse_script("""CONTEXT Shop IN ENGLISH
    PURPOSE CONTEXT Shop IN ENGLISH MARKDOWN REF "a note" {+ To sell <things> "well". +}
    PURPOSE RELATION price[Thing*Cent] {+ What it costs. +}
    REPRESENT Cent TYPE INTEGER
    RELATION price[Thing*Cent] [UNI] DEFAULT TGT VALUE 100 MEANING IN ENGLISH "The price." MEANING {+ In cents. +} = [ ("pen",120) ]
    RELATION part[Thing*Thing] PRAGMA "" "has" "" = [ ("pen","cap") ; ("cap","pen") ]
    RULE priced: I[Thing] |- price;price~ MEANING "All things have a price."
    INTERFACE Thing : I[Thing] BOX [ cost : price, parts : part INTERFACE Thing, near : part LINKTO INTERFACE Thing ]
    INTERFACE All : I[Thing] BOX [ item : part INTERFACE Thing ]
    ENDCONTEXT""")
    assert [p[:2] for p in s.purposes] == [("CONTEXT", "Shop"), ("RELATION", "price[Thing*Cent]")] and s.purposes[0][2] == 'To sell <things> "well".'
    assert s.meanings["price", "Thing", "Cent"] == ["The price.", "In cents."]
    c = s.catalog(spark)
    assert [x.label for x in s.interfaces[1].fields[0].fields] == ["cost", "parts", "near"] and not s.interfaces[0].fields[1].fields
    got = {r["src"]: r for r in nested_query(Lowering(c), s.interfaces[1]).collect()}
    assert [(x["id"], x["cost"], x["parts"], x["near"]) for x in got["cap"]["item"]] == [("pen", 120, ["cap"], ["cap"])]
    c.insert(c.get("price"), spark.createDataFrame([("cap", None), (None, 5)], "src string, tgt long").withColumn("tgt", F.col("tgt")))
    assert rows(c.pairs(c.get("price"))) == {("pen", 120), ("cap", 100)}
    with pytest.raises(ScriptError):
        parse_script("CONTEXT X RELATION r[A*A] INTERFACE I1 : I[A] BOX [ x : r INTERFACE Missing ] ENDCONTEXT")
