"""Scanning source files as they arrive, and reporting only findings not seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftgauge.plans.scan import scan_frame
from driftgauge.sources.config import Config
from driftgauge.sources.registry import Registry


def rescan(spark: SparkSession, files: DataFrame, target: str, checkpoint: str, registry: Registry | None = None, config: Config | None = None):
    """A query over a stream of (path, source): each micro-batch is scanned and its new findings are appended to
    the Parquet table at target, with the batch as partition, so that a batch that runs again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        done = scan_frame(batch.sparkSession, batch, registry, config)
        found = done.findings.select("fingerprint", "rule_id", "path", "subject", "impact", "action_version")
        s = batch.sparkSession
        fs = s._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(s._jsc.hadoopConfiguration())
        if fs.exists(s._jvm.org.apache.hadoop.fs.Path(target)):
            seen = s.read.parquet(target).where(f"batch <> {number}").select("fingerprint")
            found = found.join(seen, "fingerprint", "left_anti")
        found.write.mode("overwrite").parquet(f"{target}/batch={number}")
        done.parsed.unpersist()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
