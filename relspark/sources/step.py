"""STEP Part-21 files: instances bound by position to the attributes of an EXPRESS schema.

The file is split into statements and parsed where it lies; each attribute of a used type is a relation from the
type that declares it. Nested lists are flattened, wrapped values unwrapped, absent ones dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog

MAGIC = "ISO-10303-21"
_VALUE = re.compile(r"\s*(?:(?P<str>'(?:[^']|'')*')|(?P<ref>#\d+)|(?P<num>[-+]?\d+(?:\.\d*)?(?:E[-+]?\d+)?)|\.(?P<enum>\w+)\.|\"(?P<bin>[0-9A-Fa-f]*)\"|(?P<none>[$*])|(?P<type>[A-Za-z_]\w*)?\s*(?P<open>\()|(?P<close>\))|(?P<comma>,))")
_STATEMENT = re.compile(r"\s*(#\d+)\s*=\s*([A-Za-z_]\w*)\s*(\(.*\))\s*", re.S)


@dataclass
class Entity:
    name: str
    above: str | None = None
    attributes: list[tuple[str, str]] = field(default_factory=list)  # (name, target)


def read_schema(text: str) -> dict[str, Entity]:
    """The entities of an EXPRESS schema by upper-case name; derived and inverse attributes have no place in a file."""
    out = {}
    text = re.sub(r"\(\*.*?\*\)", " ", text, flags=re.S)
    for name, body in re.findall(r"\bENTITY\s+(\w+)(.*?)\bEND_ENTITY\s*;", text, re.S):
        above = re.search(r"SUBTYPE\s+OF\s*\(\s*(\w+)", body)
        stated = re.split(r"\b(?:DERIVE|INVERSE|UNIQUE|WHERE)\b", body.partition(";")[2])[0]
        entity = Entity(name, above[1] if above else None)
        for names, kind in re.findall(r"(\w+(?:\s*,\s*\w+)*)\s*:\s*([^;]+);", stated):
            target = re.findall(r"\w+", kind)[-1]
            entity.attributes += [(n.strip(), target) for n in names.split(",")]
        out[name.upper()] = entity
    return out


def all_attributes(schema: dict[str, Entity], kind: str) -> list[tuple[str, str, str]]:
    """(owner, attribute, target) in file order: those of the supertypes first."""
    chain, at = [], kind.upper()
    while at in schema and at not in chain:
        chain.append(at)
        at = (schema[at].above or "").upper()
    return [(schema[k].name, n, t) for k in reversed(chain) for n, t in schema[k].attributes]


def parse_arguments(text: str) -> list[list[str]]:
    """The flat values of each argument of ``(...)``."""
    out, depth, at = [], 0, 0
    while at < len(text):
        m = _VALUE.match(text, at)
        if not m:
            raise ValueError(f"no value at {text[at : at + 20]!r}")
        at = m.end()
        if m["open"]:
            depth += 1
            if depth == 1:
                out.append([])
        elif m["close"]:
            depth -= 1
            if depth == 0:
                break
        elif m["comma"]:
            if depth == 1:
                out.append([])
        elif not m["none"]:
            raw = m["str"]
            out[-1].append(raw[1:-1].replace("''", "'") if raw is not None else m["ref"] or m["num"] or m["enum"] or m["bin"] or "")
    return [] if out == [[]] and re.fullmatch(r"\(\s*\)", text) else out


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """id, type, place, value of every flat value; a place of -1 stands for the instance itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if m := _STATEMENT.fullmatch(text or ""):
                    rows.append((m[1], m[2].upper(), -1, ""))
                    rows += [(m[1], m[2].upper(), k, v) for k, values in enumerate(parse_arguments(m[3])) for v in values]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], ["id", "type", "place", "value"])

    # a statement ends with ";" and a line end; one inside a string is no line end
    return spark.read.text(path, lineSep=";\n").mapInArrow(run, "id string, type string, place int, value string")


def step_catalog(spark: SparkSession, path: str, schema: dict[str, Entity]) -> Catalog:
    """Concepts, ISA and relations of the types that the file uses."""
    rows = read_instances(spark, path)
    used = sorted(r["type"] for r in rows.select("type").distinct().collect())  # as many as the schema has types
    c = Catalog(spark)
    places = []
    for kind in used:
        if kind in schema:
            c.concept(schema[kind].name, rows.where((F.col("type") == kind) & (F.col("place") == -1)), "id", key=False)
            places += [(kind, k, owner, name, target) for k, (owner, name, target) in enumerate(all_attributes(schema, kind))]
            at = kind
            while schema[at].above and schema[at].above.upper() in schema:
                c.isa(schema[at].name, schema[schema[at].above.upper()].name)
                at = schema[at].above.upper()
    bound = rows.join(F.broadcast(spark.createDataFrame(places, "type string, place int, owner string, name string, target string")), ["type", "place"])
    for owner, name, target in sorted({p[2:] for p in places}):
        own = bound.where((F.col("owner") == owner) & (F.col("name") == name))
        c.relation(name[0].lower() + name[1:], owner, target, own, ("id", "value"))
    return c
