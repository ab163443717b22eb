"""Typing, printing, parsing and rewriting, on random terms in plain Python."""

import random

import pytest

from relspark.catalog import Catalog
from relspark.lattice import Lattice, LatticeError
from relspark.oracle import SetEvaluator
from relspark.plans.normalize import Universe, conjuncts, normalize
from relspark.script import ScriptError, parse_script, parse_term, preprocess
from relspark.terms import Atom, Compl, Compose, Converse, Diamond, Diff, Equiv, Full, Id, Incl, Inter, LeftResidual, Plus, Product, Reduce, Rel, RelAdd, RightResidual, Star, Union, show
from relspark.typing import Typer, TypeMismatch


def catalog():
    c = Catalog(None)
    for name in "rst":
        c.relation(name, "A", "A")
    c.relation("f", "A", "B", properties=["UNI"])
    c.relation("g", "B", "C")
    c.types = {"A": "bigint", "B": "bigint", "C": "bigint"}
    return c


def random_term(rng, depth=3):
    if depth == 0 or rng.random() < 0.15:
        return rng.choice([Rel("r", "A", "A"), Rel("s", "A", "A"), Rel("t", "A", "A"), Id("A"), Full("A", "A"), Atom(2, "A")])
    if rng.random() < 0.3:
        return rng.choice([Converse, Compl, Plus, Star, Reduce])(random_term(rng, depth - 1))
    kind = rng.choice([Union, Inter, Diff, Compose, Product, RightResidual, LeftResidual, Diamond, RelAdd, Equiv, Incl])
    return kind(random_term(rng, depth - 1), random_term(rng, depth - 1))


def test_normalize_keeps_meaning():
    rng, typer = random.Random(5), Typer(catalog())
    for _ in range(1500):
        atoms = range(rng.randint(0, 4))
        data = {(n, "A", "A"): [(x, y) for x in atoms for y in atoms if rng.random() < 0.4] for n in "rst"}
        ev = SetEvaluator(data, {"A": atoms}, typer.signature)
        t = random_term(rng)
        assert ev(normalize(t)) == ev(t), show(t)


def special_term(rng, depth=3):
    """Terms over A and its specialisation K."""
    ends = lambda: rng.choice(("A", "K"))
    if depth == 0 or rng.random() < 0.15:
        return rng.choice([Rel("r", "A", "A"), Rel("s", "K", "A"), Rel("t", "K", "K"), Id(ends()), Full(ends(), ends())])
    if rng.random() < 0.3:
        return rng.choice([Converse, Compl, Plus])(special_term(rng, depth - 1))
    kind = rng.choice([Union, Inter, Diff, Compose, Equiv, Incl, RelAdd])
    return kind(special_term(rng, depth - 1), special_term(rng, depth - 1))


def test_normalize_keeps_meaning_with_specialisations():
    c = Catalog(None, [("K", "A")])
    for n, a, b in (("r", "A", "A"), ("s", "K", "A"), ("t", "K", "K")):
        c.relation(n, a, b)
    rng, typer = random.Random(15), Typer(c)
    universe = Universe(typer.signature, c.lattice.leq)
    for _ in range(3000):
        atoms = {"A": range(4), "K": range(rng.randint(0, 3))}
        data = {(n, a, b): [(x, y) for x in atoms[a] for y in atoms[b] if rng.random() < 0.4] for n, a, b in (("r", "A", "A"), ("s", "K", "A"), ("t", "K", "K"))}
        ev = SetEvaluator(data, atoms, typer.signature)
        t = special_term(rng)
        assert ev(normalize(t, universe=universe)) == ev(t), (show(t), show(normalize(t, universe=universe)))


def test_conjuncts_hold_together_iff_the_rule_does():
    rng, typer = random.Random(6), Typer(catalog())
    for _ in range(500):
        atoms = range(3)
        data = {(n, "A", "A"): [(x, y) for x in atoms for y in atoms if rng.random() < 0.5] for n in "rst"}
        ev = SetEvaluator(data, {"A": atoms}, typer.signature)
        t = rng.choice([Incl, Equiv])(random_term(rng, 2), random_term(rng, 2))
        holds = ev(t) == ev(Full("A", "A"))
        assert all(ev(p) == ev.full(p) for p in conjuncts(t)) == holds, show(t)


def test_printed_terms_parse_back():
    rng = random.Random(7)
    for _ in range(1500):
        t = random_term(rng, 4)
        text = show(t)
        once = parse_term(text)
        assert show(once) == show(parse_term(show(once)))
        typer = Typer(catalog())
        atoms = range(3)
        data = {(n, "A", "A"): [(x, y) for x in atoms for y in atoms if (x * 7 + y * 3 + ord(n)) % 3] for n in "rst"}
        ev = SetEvaluator(data, {"A": atoms}, typer.signature)
        assert ev(once) == ev(t), text


def test_precedence():
    r, s, t = Rel("r"), Rel("s"), Rel("t")
    assert parse_term("r;s~ \\/ -t |- r") == Incl(Union(Compose(r, Converse(s)), Compl(t)), r)
    assert parse_term("r - s - t") == Diff(Diff(r, s), t)
    assert parse_term("r ; s ; t") == Compose(r, Compose(s, t))
    for bad in ("r \\/ s /\\ t", "r ; s ! t", "r ;", "r s"):
        with pytest.raises(ScriptError):
            parse_term(bad)


@pytest.mark.parametrize("text", ["f;f", "f \\/ g", "f /\\ g", "f - g", "f~;g~", "g/f", "f<>f", "f!f", "f+", "nope", "f;I[C]", '"x";f', "f\\g~"])
def test_wrong_types_are_rejected(text):
    with pytest.raises(TypeMismatch):
        Typer(catalog()).resolve(parse_term(text))


@pytest.mark.parametrize("text, ends", [("f;g", ("A", "C")), ("r;f", ("A", "B")), ("f#g", ("A", "C")), ("f~\\g~ # g", None), ("I;f", ("A", "B")), ("V;f", None), ("r/r", ("A", "A")), ("f~;f", ("B", "B")), ("f /\\ V", ("A", "B"))])
def test_types_are_inferred(text, ends):
    typer = Typer(catalog())
    if ends is None:
        with pytest.raises(TypeMismatch):
            typer.resolve(parse_term(text))
    else:
        assert typer.signature(typer.resolve(parse_term(text))) == ends


def test_lattice():
    up = Lattice(isa=[("Cat", "Animal"), ("Dog", "Animal"), ("Puppy", "Dog"), ("Pup", "Puppy"), ("Puppy", "Pup")])
    assert up.join("Cat", "Puppy") == "Animal" and up.meet("Animal", "Dog") == "Dog" and up.meet("Cat", "Dog") is None
    assert up.alias("Pup", "Puppy") and up.smaller("Dog") == {"Dog", "Pup", "Puppy"}
    assert [r for r, _ in up.typologies()] == ["Animal"]
    with pytest.raises(LatticeError):
        Lattice(isa=[("X", "P"), ("X", "Q")]).typologies()


def test_preprocessor_and_script():
    assert preprocess("a\n--#IF x\nb\n--#ELSE\nc\n--#ENDIF", frozenset("x")).split() == ["a", "b"]
    with pytest.raises(ScriptError):
        preprocess("--#IF x\nb")
    s = parse_script("""CONTEXT T
    CLASSIFY Kid ISA Person
    REPRESENT Age TYPE INTEGER
    RELATION age[Person*Age] [UNI,TOT] = [ ("ann", 3) ; ("bob", 4) ]
    RELATION likes[Person*Person] [PROP]
    POPULATION likes CONTAINS [ ("ann", "ann") ]
    POPULATION Kid CONTAINS [ "cas" ]
    RULE older : likes |- age;(<=);age~ MESSAGE "no" VIOLATION (TXT "x ", SRC I, TGT age)
    ROLE Clerk MAINTAINS older
    IDENT byAge : Person(age)
    ENFORCE likes >: I[Person]
    VIEW P : Person { age : age, TXT "!" }
    INTERFACE People : I[Person] BOX [ "age" : age CRud, "likes" : likes BOX [ "id" : I ] ]
    ENDCONTEXT""")
    assert s.rules[0].roles == ("Clerk",) and s.keys[0][1] == "Person" and len(s.interfaces[0].fields) == 2 and s.enforcements[0][1] == ">:"
