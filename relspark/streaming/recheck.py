"""Checking again what a batch of new pairs can affect, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..catalog import Catalog
from ..rules import Checker


def recheck_batch(checker: Checker, relation: tuple[str, str, str]) -> dict[str, DataFrame]:
    """Violations of just the conjuncts that mention the relation."""
    return {str(i): checker.lowering.frame(term) for i, term in enumerate(checker.affected().get(relation, []))}


def stream_pairs(stream: DataFrame, checker: Checker, relation: tuple[str, str, str], folder: str, on_violations: Callable[[int, str, DataFrame], None], **trigger):
    """Append each micro-batch of (src, tgt) to the relation and report the violations of the affected conjuncts.

    A batch goes to a folder of its own number, so that a batch that is run again replaces itself; the relation
    is what these folders hold. ``folder`` has to be shared by the cluster.
    """
    catalog: Catalog = checker.catalog
    target = catalog.get(*relation)
    first = target.frame

    def each(batch: DataFrame, number: int) -> None:
        batch.select("src", "tgt").dropna().write.mode("overwrite").parquet(f"{folder}/pairs/batch={number}")
        seen = batch.sparkSession.read.parquet(f"{folder}/pairs").select("src", "tgt")
        target.frame, target.is_set = (seen if first is None else first.unionByName(seen)), False
        for name, frame in recheck_batch(checker, target.key).items():
            on_violations(number, name, frame)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()
