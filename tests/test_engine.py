"""Lowered terms against the set evaluator, rules, enforcement, storage, importers and streaming on small data."""

import operator
import random
import zipfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from relspark.catalog import Catalog
from relspark.diagnostics import isa_report, oscillation_risk, rule_table, unused_relations, violation_counts
from relspark.functions import conversions as C
from relspark.interfaces import nested_query
from relspark.metamodel import meta_catalog
from relspark.operators.closure import transitive_closure
from relspark.operators.repair import Unstable, repair
from relspark.oracle import SetEvaluator
from relspark.plans import lower
from relspark.plans.lower import Lowering, ProductTooLarge
from relspark.rules import Checker, Enforcement, Rule, cartesian_warnings, key_groups, property_rules, property_violations
from relspark.script import parse_script, parse_term
from relspark.sources.spreadsheet import Sheet, blocks, read_xlsx
from relspark.storage import layout, model_json, wide_table, write_populations, write_tables
from relspark.streaming.recheck import stream_pairs
from relspark.terms import Incl, Rel, show

from .test_terms import random_term


def pairs(df):
    return {(r["src"], r["tgt"]) for r in df.collect()}


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(9)
    data = {n: {(x, y) for x in range(5) for y in range(5) if rng.random() < 0.35} for n in "rst"}
    c = Catalog(spark)
    c.concept("A", spark.range(5), "id", key=True, closed=True)
    for n, p in data.items():
        c.relation(n, "A", "A", spark.createDataFrame(sorted(p) * 2 + [(None, 1), (2, None)], "src long, tgt long"))
    low = Lowering(c)
    return c, low, SetEvaluator({(n, "A", "A"): p for n, p in data.items()}, {"A": range(5)}, low.typer.signature)


@pytest.mark.parametrize("text", ["r;(<);s", "r;(>=);s~", "r;-I;s", "r;V;s", "r;V[A];V[A];s", "r;(<);(<);s", "r;-I;-I;s", "r\\s", "r/s", "r<>s", "r!s", "r!-s", "-r!s", "r#s", "r+", "r*", "r%", "-r", "V-r", "r=s", "r|-s", "I-r;r~", "r/\\I", "r/\\{2}", "r-{2}", "r/\\-s", "-r/\\-s", "I;r;I", "r;s;t", "(r\\/s)/\\t"])
def test_each_operator(small, text):
    _, low, ev = small
    typed = low.typer.resolve(parse_term(text))
    assert pairs(low.lower(typed).distinct()) == set(ev(typed))
    df = low.frame(parse_term(text))
    assert pairs(df) == set(ev(typed)) and df.count() == len(ev(typed))


def test_random_terms(small):
    _, low, ev = small
    rng = random.Random(12)
    done = 0
    while done < 12:
        t = random_term(rng, 2)
        if not any(type(x).__name__ in ("Plus", "Star", "Reduce") for x in t.walk()):
            assert pairs(low.frame(t)) == set(ev(t)), show(t)
            done += 1


@pytest.mark.parametrize("flip", [False, True])
@pytest.mark.parametrize("middle", ["(<)", "(<=)", "(>)", "(>=)", "-I"])
def test_pairs_across_blocks_and_chunks(spark, monkeypatch, middle, flip):
    monkeypatch.setattr(lower, "BLOCK", 3)
    monkeypatch.setattr(lower, "CHUNK", 4)
    rng = random.Random(5)
    many, few = ([(k, rng.choice([-2.5, 0.0, 1.0, 7.0])) for k in range(n) for _ in range(2)] for n in (17, 9))
    if flip:
        many, few = few, many
    c = Catalog(spark)
    c.relation("m", "M", "V", spark.createDataFrame(many, "src long, tgt double"))
    c.relation("f", "F", "V", spark.createDataFrame([(f"f{k}", v) for k, v in few], "src string, tgt double"))
    fits = {"(<)": operator.lt, "(<=)": operator.le, "(>)": operator.gt, "(>=)": operator.ge, "-I": operator.ne}[middle]
    got = Lowering(c).frame(parse_term(f"m;{middle};f~"))
    assert sorted(map(tuple, got.collect())) == sorted({(x, f"f{y}") for x, v in many for y, w in few if fits(v, w)})


def test_pairs_on_the_diagonal_are_an_equi_join(spark):
    c = Catalog(spark)
    c.relation("m", "M", "V", spark.range(4).select("id", (F.col("id") % 2).alias("v")).union(spark.range(2).select("id", F.lit(9))), ("id", "v"))
    got = Lowering(c).frame(parse_term("(m;-I;m~) /\\ I"))
    assert pairs(got) == {(0, 0), (1, 1)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "inline" not in plan


def test_pairs_with_an_empty_side(spark):
    c = Catalog(spark)
    c.relation("m", "M", "V", spark.createDataFrame([(1, 2.0)], "src long, tgt double"))
    c.relation("f", "F", "V", spark.createDataFrame([], "src long, tgt double"))
    assert not pairs(Lowering(c).frame(parse_term("m;(<);f~"))) and not pairs(Lowering(c).frame(parse_term("f;-I;m~")))


@pytest.mark.parametrize("middle", ["-I", "(<)", "(>=)"])
def test_pairs_take_few_bytes(spark, tmp_path, middle):
    c = Catalog(spark)
    for name, n in (("m", 5000), ("f", 1500)):
        values = ((F.col("id") * 7919 % 9973) if middle != "-I" else F.col("id") % 25).cast("double")
        c.relation(name, name.upper(), "V", spark.range(n).select("id", values.alias("v")), ("id", "v"), ["UNI"], key=True, proven=["UNI"])
    Lowering(c).frame(parse_term(f"m;{middle};f~")).write.parquet(str(tmp_path / "out"))
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert size < 0.2 * spark.read.parquet(str(tmp_path / "out")).count()


@pytest.mark.parametrize("middle", ["(<)", "(>=)"])
def test_pairs_are_written_in_long_pages(spark, tmp_path, middle):
    own = spark.newSession()
    c = Catalog(own)
    for name, n in (("m", 5000), ("f", 1500)):
        c.relation(name, name.upper(), "V", own.range(n).select("id", (F.col("id") * 7919 % 9973).cast("double").alias("v")), ("id", "v"), ["UNI"], key=True, proven=["UNI"])
    Lowering(c).frame(parse_term(f"m;{middle};f~")).write.parquet(str(tmp_path / "out"))
    many, few = ([k * 7919 % 9973 for k in range(n)] for n in (5000, 1500))
    rows = sum(({"(<)": operator.lt, "(>=)": operator.ge}[middle])(x, y) for x in many for y in few)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.04 * rows


def test_pairs_end_a_row_group_with_its_first_page(spark, tmp_path):
    own = spark.newSession()
    c = Catalog(own)
    for name, n in (("m", 3000), ("f", 2500)):
        c.relation(name, name.upper(), "V", own.range(n).select("id", (F.col("id") % 25).alias("v")), ("id", "v"), ["UNI"], key=True, proven=["UNI"])
    Lowering(c).frame(parse_term("m;-I;f~")).write.parquet(str(tmp_path / "out"))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "out").glob("*.parquet")]
    most = int(own.conf.get("parquet.page.row.count.limit"))
    assert sum(f.num_rows for f in files) == sum(x % 25 != y % 25 for x in range(3000) for y in range(2500))
    assert max(f.num_rows for f in files) > most == max(f.row_group(k).num_rows for f in files for k in range(f.num_row_groups))


def test_pairs_keep_settings_of_files(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.parquet.compression.codec", "gzip")
    c = Catalog(own)
    for name in "mf":
        c.relation(name, name.upper(), "V", own.range(3).select("id", F.col("id").alias("v")), ("id", "v"))
    assert Lowering(c).frame(parse_term("m;(<);f~")).count() == 3
    assert own.conf.get("spark.sql.parquet.compression.codec") == "gzip"


@pytest.mark.parametrize("middle", ["(<)", "(>=)"])
def test_pairs_take_few_bytes_in_the_callers_files(spark, tmp_path, middle):
    own = spark.newSession()
    own.conf.set("spark.sql.parquet.compression.codec", "snappy")
    c = Catalog(own)
    for name, n in (("m", 5000), ("f", 1500)):
        c.relation(name, name.upper(), "V", own.range(n).select("id", (F.col("id") * 7919 % 9973).cast("double").alias("v")), ("id", "v"), ["UNI"], key=True, proven=["UNI"])
    Lowering(c).frame(parse_term(f"m;{middle};f~")).write.parquet(str(tmp_path / "out"))
    many, few = ([k * 7919 % 9973 for k in range(n)] for n in (5000, 1500))
    rows = sum(({"(<)": operator.lt, "(>=)": operator.ge}[middle])(x, y) for x in many for y in few)
    assert own.conf.get("spark.sql.parquet.compression.codec") == "snappy" and own.read.parquet(str(tmp_path / "out")).count() == rows
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.115 * rows


@pytest.mark.parametrize("doubling", [False, True])
def test_closure_families(spark, doubling):
    close = lambda p: pairs(transitive_closure(spark.createDataFrame(p, "src string, tgt string"), doubling=doubling))
    rng = random.Random(31)
    for n, edges in ((7, 6), (9, 14)):
        graph = [(f"k{rng.randrange(n)}", f"k{rng.randrange(n)}") for _ in range(edges)]
        want = set(graph)
        while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
            want |= more
        assert close(graph) == want
    assert len(close([(f"s{k:02}", f"s{k + 1:02}") for k in range(11)])) == 66
    assert close([]) == set()


def test_products_are_bounded(small):
    c, *_ = small
    with pytest.raises(ProductTooLarge):
        Lowering(c, most_product=10).frame(parse_term("-r"))
    assert cartesian_warnings(parse_term("-r")) and not cartesian_warnings(parse_term("r /\\ -s"))


def test_properties_two_ways(small):
    c, low, ev = small
    for prop in ("UNI", "INJ", "TOT", "SUR", "SYM", "ASY", "TRN", "RFX", "IRF"):
        one = Catalog(c.spark)
        one.concept("A", c.spark.range(5), "id", key=True, closed=True)
        one.relation("r", "A", "A", c.get("r").frame, ("src", "tgt"), [prop])
        rule = property_rules(one)[0]
        assert pairs(Checker(one, [rule]).violations(rule)) == pairs(property_violations(Lowering(one), one.get("r"), prop)), prop


SHOP = """CONTEXT Shop
CLASSIFY Kid ISA Person
REPRESENT Age TYPE INTEGER
RELATION age[Person*Age] [UNI] = [ ("ann", 3) ; ("bob", 4) ; ("cas", 3) ]
RELATION likes[Person*Person] = [ ("ann", "bob") ; ("bob", "ann") ]
RELATION friend[Person*Person] = [ ("ann", "cas") ]
POPULATION Kid CONTAINS [ "cas" ]
PATTERN P
RELATION knows[Person*Person]
RULE older : likes |- age;(<=);age~ VIOLATION (TXT "no: ", SRC I, TXT " is ", SRC age, TXT ", likes ", TGT likes)
ENDPATTERN
ROLE Clerk MAINTAINS older
IDENT byAge : Person(age)
ENFORCE knows >: likes \\/ friend
INTERFACE People : I[Person] BOX [ "age" : age, "likes" : likes BOX [ "id" : I, "kind" : TXT "person" ] ]
ENDCONTEXT"""


def test_script_end_to_end(spark, tmp_path):
    s = parse_script(SHOP)
    c = s.catalog(spark)
    check = Checker(c, s.rules)
    assert pairs(check.check()["older"]) == {("bob", "ann")} and check.failing_invariants() == []
    assert [r["text"] for r in check.texts(s.rules[0]).collect()] == ["no: bob is 4, likes bob"]
    assert {r["atom"] for r in c.population("Person").collect()} == {"ann", "bob", "cas"} and c.population("Kid").count() == 1
    assert {(r["atom"], r["concept"]) for r in c.smallest_concepts("Person").collect()} == {("ann", "Person"), ("bob", "Person"), ("cas", "Kid")}
    low = check.lowering
    assert {(r["atom"], r["representative"]) for r in key_groups(low, "Person", s.keys[0][2]).collect()} == {("ann", "ann"), ("cas", "ann")}
    assert repair(c, s.enforced(low)) == 1 and pairs(low.frame(Rel("knows"))) == {("ann", "bob"), ("bob", "ann"), ("ann", "cas")}
    rows = {r["src"]: r for r in nested_query(low, s.interfaces[0]).collect()}
    assert rows["ann"]["age"] == 3 and rows["ann"]["likes"][0]["kind"] == "person" and rows["cas"]["likes"] is None
    assert layout(c.get("age")) == ("wide", False) and layout(c.get("likes")) == ("link", False)
    assert {r["Person"]: (r["Kid"], r["age"]) for r in wide_table(c, "Person").collect()}["cas"] == ("cas", 3)
    assert len(write_tables(c, str(tmp_path))) == 5 and '"older"' in model_json(c, s.rules)
    write_populations(c, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/links/age_Person_Age")).count() == 3
    meta = Lowering(meta_catalog(c, s.rules, s.patterns))
    assert ("older", "likes") in pairs(meta.frame(Rel("uses"))) and ("Kid", "Person") in pairs(meta.frame(parse_term("isa+")))
    assert violation_counts(check).first()["violations"] == 1 and "friend[Person*Person]" in unused_relations(c, s.rules)
    assert rule_table(s.rules, s.patterns)[0]["most_complex"] == 4 and isa_report(c.lattice)["depth"] == 1


def test_conjuncts_are_shared_and_affected(small):
    c, *_ = small
    check = Checker(c, [Rule("one", parse_term("r = s")), Rule("two", parse_term("r |- s /\\ t"))])
    table = check.conjunct_table()
    assert sorted(map(tuple, table.values())) == [("one",), ("one", "two"), ("two",)]
    assert len(check.affected()["t", "A", "A"]) == 1 and len(check.affected()["r", "A", "A"]) == 3


def test_oscillation():
    e = lambda r, op, t: Enforcement(Rel(r), op, parse_term(t))
    assert oscillation_risk([e("basedIn", ":=", "worksFor;locatedIn")]) == []
    assert oscillation_risk([e("light", ">:", "trigger - light"), e("light", ":<", "-light /\\ trigger")])
    with pytest.raises(Unstable):
        repair(None, [e("a", ">:", "-b"), e("b", ":<", "-a"), e("b", ">:", "a"), e("a", ":<", "-b")])


def test_spreadsheet_blocks(spark, tmp_path):
    sheet = Sheet("S", [["[people]", "age", "likes~", "tags"], ["Person", "Age", "Person", "Tag;"], ["ann", 3.0, "bob", "x; y;;"], ["_NEW", None, "ann", None], [None, 1.0]])
    s = blocks(sheet, "f")
    c = s.catalog(spark)
    assert pairs(c.pairs(c.get("tags"))) == {("ann", "x"), ("ann", "y")} and pairs(c.pairs(c.get("age"))) == {("ann", "3")}
    assert pairs(c.pairs(c.get("likes"))) == {("bob", "ann"), ("ann", "_NEW_f_S_4")}
    path = tmp_path / "b.xlsx"
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="T" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/s.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>hey</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2"><v>2.5</v></c><c r="D2" t="b"><v>1</v></c></row></sheetData></worksheet>')
    assert read_xlsx(str(path)) == [Sheet("T", [[], [None, "hey", 2.5, True]])]


def test_conversions(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(C.short_id(F.lit("a" * 300))) == "a" * 243 + "_003ef1ba9e" and one(C.short_id(F.lit("a" * 254))) == "a" * 254
    assert str(one(C.serial_to_date(F.lit(45000.0)))) == "2023-03-15" and str(one(C.serial_to_timestamp(F.lit(45000.5)))) == "2023-03-15 12:00:00"
    assert one(C.number_to_text(F.lit(3.0))) == "3" and one(C.number_to_text(F.lit(3.5))) == "3.5"
    assert one(C.to_boolean(F.lit(" ja "))) is True and one(C.to_boolean(F.lit("x"))) is None and one(C.to_integer(F.lit("x"))) is None and one(C.to_float(F.lit(" 2.5"))) == 2.5


def test_stream_recheck(spark, tmp_path):
    c = Catalog(spark)
    c.relation("wants", "A", "B")
    c.relation("sells", "A", "B", spark.createDataFrame([(1, 1)], "src long, tgt long"))
    c.types = {"A": "bigint", "B": "bigint"}
    check = Checker(c, [Rule("met", Incl(Rel("wants"), Rel("sells")))])
    spark.createDataFrame([(1, 1), (2, 5)], "src long, tgt long").write.parquet(str(tmp_path / "in"))
    found = []
    stream = spark.readStream.schema("src long, tgt long").parquet(str(tmp_path / "in"))
    stream_pairs(stream, check, ("wants", "A", "B"), str(tmp_path / "state"), lambda n, name, df: found.extend(pairs(df))).awaitTermination(60)
    assert found == [(2, 5)]
