"""A model as data: its concepts, relations, rules and terms as relations that the same algebra can query."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .catalog import Catalog
from .plans.normalize import normalize
from .rules import Rule, violation_term
from .terms import Rel, Term, show

SCHEMA = "relation string, src string, tgt string"


def triples(catalog: Catalog, rules: list[Rule] = (), patterns: dict[str, list[str]] | None = None) -> list[tuple[str, str, str]]:
    """(relation, src, tgt) facts about the model; a term is named by its text."""
    out = [("concept", c, c) for c in catalog.lattice.up]
    out += [("isa", s, g) for s, ups in catalog.lattice.up.items() for g in ups]
    for r in catalog.relations.values():
        out += [("source", str(r), r.src), ("target", str(r), r.tgt), ("name", str(r), r.name)]
        out += [("property", str(r), p) for p in r.properties]
    for rule in rules:
        out += [("formal", rule.name, show(rule.term)), ("kind", rule.name, "signal" if rule.is_signal else "invariant")]
        out += [("maintains", role, rule.name) for role in rule.roles]
        out += [("uses", rule.name, show(t)) for t in rule.term.walk() if isinstance(t, Rel)]
        out += [("violated", rule.name, show(normalize(violation_term(rule.term))))]
        out += _parts(rule.term)
    for pattern, items in (patterns or {}).items():
        out += [("contains", pattern, item.removeprefix("rule ")) for item in items]
    return sorted(set(out))


def _parts(term: Term) -> list[tuple[str, str, str]]:
    out = [("operator", show(term), type(term).__name__)]
    for part in term.parts():
        out += [("part", show(term), show(part)), *_parts(part)]
    return out


def triple_frame(catalog: Catalog, rules: list[Rule] = (), patterns=None) -> DataFrame:
    return catalog.spark.createDataFrame(triples(catalog, rules, patterns), SCHEMA)


def meta_catalog(catalog: Catalog, rules: list[Rule] = (), patterns=None) -> Catalog:
    """A catalog with one relation for each kind of fact, all between things."""
    facts = triple_frame(catalog, rules, patterns)
    meta = Catalog(catalog.spark)
    for name in sorted({t[0] for t in triples(catalog, rules, patterns)}):
        meta.relation(name, "Thing", "Thing", facts.where(facts.relation == name), ("src", "tgt"), key=True)
    return meta
