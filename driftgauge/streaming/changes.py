"""What scans of arriving files change: findings that are new, and findings that are gone, by keyed state.

Files arrive as a stream of (path, source); a null source is a file that was deleted. Two streams follow one another. The first scans
each micro-batch and appends, for every path in it, the findings that the file has now. The second keeps the last findings of each
path in a state store and appends the differences. Neither reads what was written before, so the time of a batch follows from the files
that changed and not from how many there are.

target/scans and target/changes are Parquet. A batch that runs again replaces its own folder, and the same findings again are no
change. A file that appears twice in a batch counts as its last row by source. A file that cannot be parsed changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftgauge.plans.scan import scan_frame
from driftgauge.session import ship
from driftgauge.sources.config import Config
from driftgauge.sources.registry import Registry

ONE = "struct<fingerprint:string,rule_id:string,subject:string,impact:string,action_version:int>"
SCANS = f"path string, step long, found array<{ONE}>"
CHANGES = "path string, step long, change string, fingerprint string, rule_id string, subject string, impact string, action_version int"
STATE = "fingerprint array<string>, rule_id array<string>, subject array<string>, impact array<string>, action_version array<int>"
FIELDS = ("fingerprint", "rule_id", "subject", "impact", "action_version")


def difference(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes of one path, scan after scan; the state is what the last one found."""
    known = {x[0]: x for x in zip(*(list(c) for c in state.get), strict=True)} if state.exists else {}
    out = []
    for _, r in pd.concat(list(frames)).sort_values("step", kind="stable").iterrows():
        now = {x["fingerprint"]: tuple(x[f] for f in FIELDS) for x in (r["found"] if r["found"] is not None else [])}
        out += [(key[0], r["step"], "new", *now[f]) for f in sorted(now.keys() - known.keys())]
        out += [(key[0], r["step"], "resolved", *known[f]) for f in sorted(known.keys() - now.keys())]
        known = now
    if known:
        state.update(tuple(map(list, zip(*(known[f] for f in sorted(known)), strict=True))))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])


def follow(spark: SparkSession, files: DataFrame, target: str, checkpoint: str, registry: Registry | None = None, config: Config | None = None) -> None:
    """Work off all files that have arrived since the last call."""
    ship(spark)

    def each(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("path").agg(F.max("source").alias("source")).persist()
        done = scan_frame(batch.sparkSession, latest.where("source is not null"), registry, config)
        found = done.findings.where("suppression is null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("found"))
        parsed = latest.select("path").join(done.parsed.where("status <> 'parsed'").select("path"), "path", "left_anti")
        rows = parsed.join(found, "path", "left").withColumn("step", F.lit(number).cast("long"))
        rows.select("path", "step", F.coalesce("found", F.array().cast(f"array<{ONE}>")).alias("found")).write.mode("overwrite").parquet(f"{target}/scans/batch={number}")
        done.release()
        latest.unpersist()

    files.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/scans").trigger(availableNow=True).start().awaitTermination()
    scans = spark.readStream.schema(SCANS).parquet(f"{target}/scans/*")
    changed = scans.groupBy("path").applyInPandasWithState(difference, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)
    changed.writeStream.format("parquet").option("path", f"{target}/changes").option("checkpointLocation", f"{checkpoint}/changes").trigger(availableNow=True).start().awaitTermination()
