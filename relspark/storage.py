"""Physical layout: wide tables of univalent relations, link tables for the rest, and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog, Relation


def layout(relation: Relation, *, link_only: bool = False) -> tuple[str, bool]:
    """Where a relation lives, and whether flipped: the wide table of its source if UNI, of its target if INJ, else a link table."""
    if not link_only and "UNI" in relation.properties:
        return "wide", False
    if not link_only and "INJ" in relation.properties:
        return "wide", True
    return "link", "SUR" in relation.properties and "TOT" not in relation.properties


def wide_table(catalog: Catalog, concept: str) -> DataFrame:
    """One row for each atom: the atom, a membership column for each specialisation, a column for each relation stored here.

    A declared property that the data breaks, so that an atom has more than one value, is an error.
    """
    out = catalog.population(concept).select(F.col("atom").alias(concept))
    for special in sorted(catalog.lattice.smaller(concept) - {concept}):
        own = catalog.population(special).select(F.col("atom").alias("_k"), F.col("atom").alias(special))
        out = out.join(own, F.col(concept) == F.col("_k"), "left").drop("_k")
    family = catalog.lattice.smaller(concept)
    for r in sorted(catalog.relations.values(), key=lambda r: r.name):
        kind, flip = layout(r)
        if r.frame is not None and kind == "wide" and (r.tgt if flip else r.src) in family:
            key, value = ("tgt", "src") if flip else ("src", "tgt")
            own = catalog.pairs(r).select(F.col(key).alias("_k"), F.col(value).alias(r.name))
            if ("INJ" if flip else "UNI") not in r.proven or not catalog.alone(r):
                broken = F.raise_error(F.concat(F.lit(f"{r} has more than one value for "), F.col("_k").cast("string")))
                own = own.groupBy("_k").agg(F.count("*").alias("_n"), F.first(r.name).alias(r.name))
                own = own.select("_k", F.when(F.col("_n") > 1, broken).otherwise(F.col(r.name)).alias(r.name))
            out = out.join(own, F.col(concept) == F.col("_k"), "left").drop("_k")
    return out


def link_table(relation: Relation, catalog: Catalog) -> DataFrame:
    return catalog.pairs(relation)


def write_tables(catalog: Catalog, folder: str) -> list[str]:
    """All wide and link tables as Parquet; returns their paths."""
    paths = []
    for root, _ in catalog.lattice.typologies():
        if root != "ONE":
            wide_table(catalog, root).write.mode("overwrite").parquet(f"{folder}/wide_{root}")
            paths.append(f"{folder}/wide_{root}")
    for r in catalog.relations.values():
        if r.frame is not None and layout(r)[0] == "link":
            path = f"{folder}/link_{r.name}_{r.src}_{r.tgt}"
            link_table(r, catalog).write.mode("overwrite").parquet(path)
            paths.append(path)
    return paths


def write_populations(catalog: Catalog, folder: str) -> None:
    """Links and atoms (under their smallest concepts) as JSON lines."""
    for r in catalog.relations.values():
        if r.frame is not None:
            catalog.pairs(r).write.mode("overwrite").json(f"{folder}/links/{r.name}_{r.src}_{r.tgt}")
    for root, _ in catalog.lattice.typologies():
        if root != "ONE":
            catalog.smallest_concepts(root).write.mode("overwrite").json(f"{folder}/atoms/{root}")


def model_json(catalog: Catalog, rules=()) -> str:
    """Concepts, relations and rules as JSON text."""
    from .terms import show

    return json.dumps(
        {
            "concepts": sorted(catalog.lattice.up),
            "isa": sorted([s, g] for s, ups in catalog.lattice.up.items() for g in ups),
            "relations": [{"name": r.name, "src": r.src, "tgt": r.tgt, "properties": sorted(r.properties), "layout": layout(r)[0]} for r in catalog.relations.values()],
            "rules": [{"name": r.name, "term": show(r.term), "signal": r.is_signal} for r in rules],
        },
        indent=1,
        sort_keys=True,
    )
