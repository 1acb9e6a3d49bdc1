"""Keeping a workspace's records current from a stream of inspected files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from provena.operators.tables import Workspace, changed, upsert


def keep_current(records: DataFrame, workspace: Workspace, checkpoint: str, table: str = "images", key: str = "real_path") -> StreamingQuery:
    """Upserts a stream of records (with real_path, size_bytes, modified_at) into a workspace table.

    Unchanged files are dropped by the same anti-join as in an audit; of several
    versions in one batch the last modified stays.  A batch that runs again
    after a failure changes nothing, because its files are then unchanged.
    """

    def merge(batch: DataFrame, _: int) -> None:
        known = workspace.read(table)
        fresh = batch if known is None else changed(known, batch)
        newest = fresh.groupBy(key).agg({"modified_at": "max"}).withColumnRenamed("max(modified_at)", "modified_at")
        rows = fresh.join(newest, [key, "modified_at"], "left_semi").dropDuplicates([key])
        if not rows.isEmpty():
            workspace.replace(table, upsert(known, rows.select(*batch.columns), key))

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
