"""RDF models in Turtle: classes to concepts, subclasses to ISA, properties to relations; and back.

Instances are not read. The parser knows prefixes, ``a``, lists of predicates and objects, literals and blank nodes.
"""

from __future__ import annotations

import re

from ..catalog import Catalog
from ..script import Script, ScriptError

_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^>]*>)|(?P<text>\"\"\".*?\"\"\"|"(?:[^"\\]|\\.)*")(?:@[\w-]+|\^\^[^\s;,.]+)?|(?P<key>@prefix|@base|PREFIX|BASE)\b|(?P<sign>[.;,\[\]()])|(?P<name>[\w:-]+(?:\.[\w-]+)*)""", re.S | re.X)
_OWL, _RDF, _RDFS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
# Kinds of properties and what they say of a relation.
_KINDS = {"FunctionalProperty": "UNI", "InverseFunctionalProperty": "INJ", "SymmetricProperty": "SYM", "AsymmetricProperty": "ASY", "TransitiveProperty": "TRN", "ReflexiveProperty": "RFX", "IrreflexiveProperty": "IRF"}


def triples(text: str) -> list[tuple[str, str, str]]:
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ScriptError(f"no Turtle at {text[at : at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    prefixes, out, blanks, place = {"": ""}, [], 0, 0

    def node() -> str:
        nonlocal place, blanks
        kind, value = tokens[place]
        place += 1
        if kind == "iri":
            return value[1:-1]
        if kind == "text":
            return value.strip('"')
        if value == "[":
            blanks += 1
            own = f"_:b{blanks}"
            if tokens[place][1] != "]":
                predicates(own)
            place += 1
            return own
        if value == "(":
            items = []
            while tokens[place][1] != ")":
                items.append(node())
            place += 1
            return " ".join(items)
        if value == "a":
            return _RDF + "type"
        prefix, colon, local = value.partition(":")
        return prefixes.get(prefix, prefix + ":") + local if colon else value

    def predicates(subject: str) -> None:
        nonlocal place
        while tokens[place][1] not in (".", "]"):
            predicate = node()
            while True:
                out.append((subject, predicate, node()))
                if tokens[place][1] != ",":
                    break
                place += 1
            while tokens[place][1] == ";":
                place += 1

    while place < len(tokens):
        kind, value = tokens[place]
        if kind == "key":
            place += 1
            if "prefix" in value.lower():
                name = tokens[place][1].rstrip(":")
                prefixes[name] = tokens[place + 1][1][1:-1]
                place += 2
            else:
                prefixes[""] = tokens[place][1][1:-1]
                place += 1
        else:
            predicates(node())
        if place < len(tokens) and tokens[place][1] == ".":
            place += 1
    return out


def _local(iri: str) -> str:
    return re.sub(r"\W", "_", re.split(r"[#/]", iri.rstrip("#/"))[-1]) or "Thing"


def read_turtle(text: str) -> Script:
    script, facts = Script(), triples(text)
    kinds: dict[str, set[str]] = {}
    for s, p, o in facts:
        if p == _RDF + "type":
            kinds.setdefault(s, set()).add(_local(o))
    one = lambda s, p: next((o for a, b, o in facts if a == s and b == p), None)
    for s, own in kinds.items():
        if "Class" in own and not s.startswith("_:"):
            script.concepts.add(_local(s))
        if own & {"ObjectProperty", "DatatypeProperty", "Property", *_KINDS}:
            domain, range_ = (one(s, _RDFS + end) for end in ("domain", "range"))
            key = (_local(s), _local(domain or "Thing"), _local(range_ or "Thing"))
            props = sorted(_KINDS[k] for k in own if k in _KINDS and (key[1] == key[2] or _KINDS[k] in ("UNI", "INJ")))
            script.relations.setdefault(key, []).extend(props)
    script.isa += [(_local(s), _local(o)) for s, p, o in facts if p == _RDFS + "subClassOf" and not s.startswith("_:") and not o.startswith("_:")]
    return script


def write_turtle(catalog: Catalog, base: str) -> str:
    lines = [f"@prefix owl: <{_OWL}> .", f"@prefix rdfs: <{_RDFS}> .", f"@prefix : <{base}> .", ""]
    for c in sorted(catalog.lattice.up):
        lines.append(f":{c} a owl:Class" + "".join(f" ;\n  rdfs:subClassOf :{g}" for g in sorted(catalog.lattice.up[c])) + " .")
    back = {v: k for k, v in _KINDS.items()}
    for r in catalog.relations.values():
        kinds = ", ".join(["owl:ObjectProperty", *(f"owl:{back[p]}" for p in sorted(r.properties) if p in back)])
        lines.append(f":{r.name} a {kinds} ;\n  rdfs:domain :{r.src} ;\n  rdfs:range :{r.tgt} .")
    return "\n".join(lines) + "\n"
