"""Interfaces: nested queries that start at the atoms of a term."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.lower import Lowering
from .properties import has
from .terms import Term


@dataclass(frozen=True)
class Field:
    label: str
    term: Term | None = None
    fields: tuple[Field, ...] = ()
    text: str | None = None  # a constant instead of a term
    crud: str = "CRUD"
    ref: str | None = None  # the interface whose fields these are, or to which the values only link
    link: bool = False


@dataclass(frozen=True)
class Box:
    label: str
    term: Term
    fields: tuple[Field, ...]
    roles: tuple[str, ...] = ()


def _children(lowering: Lowering, concept: str, fields: tuple[Field, ...]) -> list[tuple[Field, DataFrame | None, Term | None]]:
    out = []
    for f in fields:
        typed = None if f.text is not None else lowering.normal(lowering.typer.resolve(f.term, concept))
        out.append((f, None if typed is None else lowering.lower(typed).distinct(), typed))
    return out


def _atoms_with(lowering: Lowering, atoms: DataFrame, concept: str, fields: tuple[Field, ...]) -> DataFrame:
    """src and one column for each field: a value where the field is univalent, else a sorted array of what is there."""
    out = atoms
    for f, pairs, typed in _children(lowering, concept, fields):
        if pairs is None:
            out = out.withColumn(f.label, F.lit(f.text))
            continue
        if f.fields:
            below = _atoms_with(lowering, pairs.select(F.col("tgt").alias("src")).distinct(), lowering.ends(typed)[1], f.fields)
            inner = below.select(F.col("src").alias("_t"), F.struct(F.col("src").alias("id"), *[F.col(x.label) for x in f.fields]).alias("_v"))
            pairs = pairs.join(inner, F.col("tgt") == F.col("_t")).select("src", F.col("_v").alias("tgt"))
        if has(typed, "UNI", lowering.catalog):
            own = pairs.select(F.col("src").alias("_k"), F.col("tgt").alias(f.label))
        else:
            own = pairs.groupBy(F.col("src").alias("_k")).agg(F.sort_array(F.collect_list("tgt")).alias(f.label))
        out = out.join(own, F.col("src") == F.col("_k"), "left").drop("_k")
    return out


def nested_query(lowering: Lowering, box: Box, atom=None) -> DataFrame:
    """One row for each atom that the box's term reaches (from ``atom`` only, if given), nested as the box is."""
    typed = lowering.normal(lowering.typer.resolve(box.term))
    pairs = lowering.lower(typed).distinct()
    if atom is not None:
        pairs = pairs.where(F.col("src") == F.lit(atom))
    return _atoms_with(lowering, pairs.select(F.col("tgt").alias("src")).distinct(), lowering.ends(typed)[1], box.fields)


def flat_query(lowering: Lowering, box: Box) -> DataFrame:
    """The univalent fields of the box and of its univalent inner boxes, side by side."""
    typed = lowering.normal(lowering.typer.resolve(box.term))
    out = lowering.lower(typed).frame.select(F.col("tgt").alias("src")).distinct()
    return _flat(lowering, out, "src", lowering.ends(typed)[1], box.fields, "")


def _flat(lowering: Lowering, out: DataFrame, at: str, concept: str, fields: tuple[Field, ...], prefix: str) -> DataFrame:
    for f, pairs, typed in _children(lowering, concept, fields):
        label = prefix + f.label
        if pairs is None:
            out = out.withColumn(label, F.lit(f.text))
        elif has(typed, "UNI", lowering.catalog):
            own = pairs.select(F.col("src").alias("_k"), F.col("tgt").alias(label))
            out = out.join(own, F.col(at) == F.col("_k"), "left").drop("_k")
            out = _flat(lowering, out, label, lowering.ends(typed)[1], f.fields, f"{label}_")
    return out


def visible(boxes: list[Box], role: str) -> list[Box]:
    """The boxes that a role may use; a box without roles is open to all."""
    return [b for b in boxes if not b.roles or role in b.roles]
