"""Keep an index current: the change stream of a source tree applied by micro-batch."""
from __future__ import annotations

import logging
from collections import Counter

from pyspark.sql import functions as F

from quillon.sources.tree import TreeSource

LOG = logging.getLogger("quillon.watch")
REPORT_EVERY = 100


def start(workspace, checkpoint: str, trigger: dict | None = None):
    """A StreamingQuery; batches upsert by path, so a repeated batch changes nothing. Its `counts` (by kind) are logged every
    REPORT_EVERY events; a root that is gone ends the query."""
    spark = workspace.spark
    spark.dataSource.register(TreeSource)
    changes = spark.readStream.format("source_tree").option("path", workspace.root).option("mode", "changes").load()
    counts: Counter = Counter()

    def apply(batch, _id):
        batch = batch.groupBy("kind", "path", "error").agg(F.max("seq").alias("seq")).persist()
        try:
            seen = {r["kind"]: r["n"] for r in batch.groupBy("kind").agg(F.count("*").alias("n")).collect()}
            if "Error" in seen:
                raise RuntimeError(batch.filter("kind = 'Error'").first()["error"])
            before = sum(counts.values())
            counts.update(seen)
            if sum(counts.values()) // REPORT_EVERY > before // REPORT_EVERY:
                LOG.info("watched %s", dict(counts))
            if seen.keys() & {"Changed", "Deleted", "DirDeleted"}:
                workspace.apply_changes(batch)
        finally:
            batch.unpersist()

    query = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()
    query.counts = counts
    return query
