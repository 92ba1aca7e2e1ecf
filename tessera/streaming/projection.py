"""The incremental projection as a stream: each micro-batch of changed rows is applied once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.cohorts import CohortTable, ConflictError

#: How often a batch is applied again because another writer was first.
RETRIES = 5


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key's last row of a batch; combines before the shuffle."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("__row")).select(*keys, "__row.*")


def apply_changes(current: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Current rows with a batch of newer ones put over them; a row whose ``deleted`` is true goes."""
    newest = latest(batch, keys, order)
    kept = current.join(newest.select(*keys), keys, "left_anti")
    return kept.unionByName(newest.where("NOT deleted").select(current.columns))


def project_stream(changes: DataFrame, target: CohortTable, keys: list[str], order: str, project: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Keep ``target`` equal to the projection of all changes so far.

    A version's manifest holds the number of the last batch in it, so a repeated batch changes nothing, and
    versions of another making (a compaction, say) may come between.  A batch that meets one while it commits is applied again on top.
    """

    def apply(batch: DataFrame, number: int) -> None:
        changed = project(batch)
        for left in range(RETRIES, -1, -1):
            version = target.version()
            if target.batch(version) >= number:
                return
            rows = apply_changes(target.read(version), changed, keys, order)
            try:
                target.append(rows.select(target.schema.names), version, target.manifest(version), number)
                return
            except ConflictError:
                if not left:
                    raise

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
