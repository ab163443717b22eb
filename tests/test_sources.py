"""Model importers on little files."""

from relspark.sources.archimate import read_archimate
from relspark.sources.step import all_attributes, parse_arguments, read_schema, step_catalog
from relspark.sources.turtle import read_turtle, triples, write_turtle

SCHEMA = """SCHEMA S; ENTITY Root ABSTRACT SUPERTYPE; Name : OPTIONAL Label; INVERSE used : SET OF Wall FOR of; END_ENTITY;
ENTITY Wall SUBTYPE OF (Root); Points : LIST [0:?] OF Point; WHERE x : TRUE; END_ENTITY; ENTITY Point; X, Y : Real; END_ENTITY; END_SCHEMA;"""


def test_step(spark, tmp_path):
    schema = read_schema(SCHEMA)
    assert all_attributes(schema, "WALL") == [("Root", "Name", "Label"), ("Wall", "Points", "Point")]
    assert parse_arguments("('it''s;',(#1,(#2)),$,.T.,LABEL('x'),-1.5E3,())") == [["it's;"], ["#1", "#2"], [], ["T"], ["x"], ["-1.5E3"], []]
    path = tmp_path / "a.ifc"
    path.write_text("ISO-10303-21;\nDATA;\n#1=POINT(0.,1.);\n#2= WALL('w',(#1,#1));\n#3=NOPE(1);\n#4=WALL($,());\nENDSEC;\n")
    c = step_catalog(spark, str(path), schema)
    pairs = lambda name: {tuple(r) for r in c.pairs(c.get(name)).collect()}
    assert pairs("points") == {("#2", "#1")} and pairs("name") == {("#2", "w")} and pairs("x") == {("#1", "0.")}
    assert {r["atom"] for r in c.population("Root").collect()} == {"#2", "#4"}


def test_turtle(spark):
    text = """@prefix : <http://x#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
    :Dog a owl:Class ; rdfs:subClassOf :Animal , [ a owl:Restriction ] ; rdfs:label "Dog."@en . :Animal a owl:Class . # end
    :owner a owl:ObjectProperty , owl:FunctionalProperty ; rdfs:domain :Dog ; rdfs:range :Person ."""
    s = read_turtle(text)
    assert s.concepts == {"Dog", "Animal"} and s.isa == [("Dog", "Animal")] and s.relations == {("owner", "Dog", "Person"): ["UNI"]}
    assert ("http://x#Dog", "http://www.w3.org/2000/01/rdf-schema#label", "Dog.") in triples(text)
    again = read_turtle(write_turtle(s.catalog(spark), "http://x#"))
    assert again.relations == s.relations and ("Dog", "Animal") in again.isa


def test_archimate():
    s = read_archimate("""<m name="M" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><folder id="f" name="F"><element xsi:type="archimate:Actor" id="a" name="Ann"><property key="k" value="v"/></element>
    <element xsi:type="archimate:Role" id="r"/><element xsi:type="archimate:AssignmentRelationship" id="x" source="a" target="r"/></folder>
    <folder id="v"><element xsi:type="archimate:View" id="w" name="W"><child archimateElement="a"><child archimateElement="r"/></child></element></folder></m>""")
    pairs = {(k[0], p) for k, ps in s.pairs for p in ps}
    assert {("assignment", ("a", "r")), ("source", ("x", "a")), ("inside", ("r", "a")), ("inView", ("r", "w")), ("value", ("a_property_0", "v")), ("folder", ("a", "f"))} <= pairs
