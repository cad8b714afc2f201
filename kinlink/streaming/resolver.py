"""Linking of arriving records against a fixed table, batch by batch. An extension: the engine itself is batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import records
from ..plans import resolve


def resolve_stream(arriving: DataFrame, candidates: DataFrame, path: str, checkpoint: str, strategies: list[str] | None = None, sure: int = 3, least: int = 2) -> StreamingQuery:
    """Starts a query that writes s1_id, cand_id, votes of each batch of ``arriving`` records below ``path``.

    ``candidates`` has derived fields already. A batch is written to a folder of its number, so a batch that is run
    again after a failure replaces its rows. Links of a record depend on itself and the fixed table alone, so no
    state or watermark is needed.
    """

    def link(batch: DataFrame, number: int) -> None:
        found = resolve.resolve_by_votes(records.records(batch), candidates, strategies, sure=sure, least=least)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).start()
