"""Matches to findings: strongest match, ordinal, fingerprint, states, filters, suppression, baseline.

One exchange by path serves the strongest-match aggregation and the ordinal window; states are folded
within the row; rules, baseline flags and per-file ignores are joined on their keys.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.functions import exprs as E

KIND = "case kind when 'call-shape' then 3 when 'module-import' then 0 when 'qualified-reference' then 1 else 2 end"
CONF = "case confidence when 'high' then 2 when 'medium' then 1 else 0 end"


#: Contexts by their bit.
CONTEXTS = ("runtime", "typing")


def strongest(matches: DataFrame) -> DataFrame:
    """One row for each (path, rule, region, subject): the strongest match, with reach, contexts and evidence merged.

    Strength is confidence, then kind; of equals the one first in (kind, seq) order stays. Matches of a place that have the same kinds of
    evidence are folded first, as the strongest of them has it all: what is then put in order for a place is as many as there are
    such sets, however often it was matched. Versions (reach) are bits, and so are contexts meanwhile.
    """
    one = F.struct((-F.expr(CONF)).alias("c"), (-F.expr(KIND)).alias("p"), "kind", "seq", "confidence", "scope", F.map_entries("evidence").alias("evidence"))
    keys = ["path", "rule_id", "subject", "sl", "sc", "el", "ec"]
    context = sum((F.when(F.array_contains("ctx", c), 1 << n).otherwise(0) for n, c in enumerate(CONTEXTS)), F.lit(0))
    held = F.array_join(F.array_sort(F.map_keys("evidence")), ",")
    got = matches.withColumns({"held": held, "places": context}).groupBy(*keys, "held").agg(F.min(one).alias("one"), F.min(F.struct("kind", "seq")).alias("first"), F.bit_or("reach").alias("reach"), F.bit_or("places").alias("places"))
    got = got.groupBy(*keys).agg(F.array_sort(F.collect_list("one")).alias("all"), F.min("first").alias("first"), F.bit_or("reach").alias("reach"), F.bit_or("places").alias("places"))
    merged = F.expr("aggregate(all, cast(map() as map<string,array<string>>), (acc, x) -> map_concat(acc, map_filter(map_from_entries(x.evidence), (k, v) -> not map_contains_key(acc, k))))")
    top = F.col("all")[0]
    evidence = F.when(F.size("all") == 1, F.map_from_entries(top["evidence"])).otherwise(merged)
    contexts = F.array_compact(F.array(*[F.when(F.col("places").bitwiseAND(1 << n) != 0, c) for n, c in enumerate(CONTEXTS)]))
    return got.select(*keys, "reach", contexts.alias("ctx"), top["kind"].alias("kind"), top["confidence"].alias("confidence"), top["scope"].alias("scope"), evidence.alias("evidence"), "first")


def with_ordinal(matches: DataFrame, namespace: str = E.NAMESPACE) -> DataFrame:
    """ordinal of each match among those of its rule, scope and subject in the file, and its fingerprint."""
    w = Window.partitionBy("path", "rule_id", "scope", "subject").orderBy("sl", "sc", "first", "el", "ec")
    out = matches.withColumn("ordinal", F.row_number().over(w) - 1)
    return out.withColumn("fingerprint", E.fingerprint("rule_id", "path", "scope", "subject", "ordinal", namespace=namespace))


def findings(matches: DataFrame, rules: DataFrame, versions: list[int], minimum: str = "high", show_unscheduled: bool = True, namespace: str = E.NAMESPACE) -> DataFrame:
    """Findings before suppression. Filters come after the ordinal, so they don't move fingerprints."""
    low = {"low": 0, "medium": 1, "high": 2}[minimum]
    policy = E.held(versions)
    # one exchange: the merge and the ordinals both group by path and more
    out = with_ordinal(strongest(matches.repartition("path")), namespace).where(f"{CONF} >= {low}")
    # what each rule's state is at each version is settled on the rules' side; a finding only cuts it to what it can reach
    side = rules.select("rule_id", "title", "events", E.phases("events", versions).alias("phases"), "remediation", "deprecated_only", "has_removal", F.col("contexts").alias("rule_contexts"))
    out = out.join(F.broadcast(side), "rule_id").withColumn("usage_contexts", F.array_sort(F.array_intersect("rule_contexts", "ctx"))).where("size(usage_contexts) > 0")
    out = out.withColumn("held", E.within("phases", "reach")).where("size(held) > 0")
    out = out.withColumns({"reachable": F.expr(E.members(f"reach & {policy}L")), "states": E.spans("held")})
    out = out.withColumn("removal_unscheduled", F.expr("exists(events, e -> e.event = 'deprecated') and not has_removal"))
    if not show_unscheduled:
        out = out.where("not (removal_unscheduled and deprecated_only)")
    out = out.withColumns({"impact": F.expr("held[0].state"), "action_version": F.expr(E.lowest("held[0].bits"))})
    out = out.withColumn("timeline", F.expr(f"filter(events, e -> e.py <= {max(versions)})"))
    return out.drop("events", "deprecated_only", "has_removal", "rule_contexts", "reach", "ctx", "first", "phases", "held")


def directive_rules(parsed: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, rule_id, statement, reason) of the first directive of each statement and rule; diagnostics of unknown names.

    names: (name, rule_id) of ids and aliases; bounded like the registry.
    """
    d = parsed.select("path", F.explode("directives").alias("d")).select("path", "d.*").select("path", "seq", F.explode("ids").alias("name"), "reason", "line", "col", "statement")
    d = d.join(F.broadcast(names), "name", "left")
    unknown = d.where("rule_id is null").select("path", F.lit("PYA3001").alias("code"), F.expr("concat('unknown suppression rule ', name)").alias("message"), F.col("line").alias("sl"), F.col("col").alias("sc"), F.col("line").alias("el"), F.col("col").alias("ec"))
    good = d.where("rule_id is not null and statement is not null")
    first = good.groupBy("path", "rule_id", "statement").agg(F.min_by("reason", "seq").alias("reason"))
    return first, unknown


PLACE = ["path", "rule_id", "sl", "sc", "el", "ec"]


def owners(places: DataFrame, intervals: DataFrame) -> DataFrame:
    """(path, rule_id, sl, sc, el, ec, owner) of the places that lie within intervals of their path and rule: owner is the interval, with
    its reason, that starts last of those around the place, and of such the one that ends last.

    One streaming sweep over intervals and places sorted by start. Its state is the intervals that may still own something: a later one
    that ends no earlier drops those before it, so ends fall towards the top, and the owner is found by bisection."""
    import pyarrow as pa

    def sweep(frames):
        key, ends, held = None, [], []
        for batch in frames:
            cols = [batch.column(c).to_pylist() for c in (*PLACE, "kind", "reason")]
            hit, own = [], []
            for n, (path, rule, sl, sc, el, ec, kind, reason) in enumerate(zip(*cols, strict=True)):
                if (path, rule) != key:
                    key, ends, held = (path, rule), [], []
                end = (-el, -ec)
                if kind == 0:
                    while ends and ends[-1] >= end:
                        ends.pop()
                        held.pop()
                    ends.append(end)
                    held.append({"sl": sl, "sc": sc, "el": el, "ec": ec, "reason": reason})
                elif at := bisect.bisect_right(ends, end):
                    hit.append(n)
                    own.append(held[at - 1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(hit, pa.int32())) for c in PLACE), pa.array(own, pa.struct([*((c, pa.int32()) for c in PLACE[2:]), ("reason", pa.string())]))], [*PLACE, "owner"])

    near = places.select(*PLACE).distinct().join(intervals.select("path", "rule_id").distinct(), ["path", "rule_id"], "left_semi")
    both = intervals.select(*PLACE, F.lit(0).alias("kind"), "reason").union(near.select(*PLACE, F.lit(1), F.lit(None).cast("string")))
    order = both.repartition("path", "rule_id").sortWithinPartitions("path", "rule_id", "sl", "sc", "kind", "el", "ec", "reason")
    return order.mapInArrow(sweep, "path string, rule_id string, sl int, sc int, el int, ec int, owner struct<sl:int,sc:int,el:int,ec:int,reason:string>")


def suppress(found: DataFrame, directives: DataFrame, ignores: DataFrame) -> DataFrame:
    """suppression struct(kind, reason, pattern): the rightmost directive statement around the finding, else the first per-file pattern."""
    own = owners(found, directives.select("path", "rule_id", "statement.*", "reason"))
    i = ignores.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("place", "regex", "pattern"))).alias("ignored"))
    out = found.join(own, PLACE, "left").join(F.broadcast(i), "rule_id", "left")  # as many as the configuration holds
    out = out.withColumn("pattern", F.expr("try_element_at(filter(ignored, x -> path rlike x.regex), 1).pattern"))
    kind = F.when(F.col("owner").isNotNull(), "inline").when(F.col("pattern").isNotNull(), "per-file")
    return out.withColumn("suppression", F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.col("owner.reason").alias("reason"), F.when(F.col("owner").isNull(), F.col("pattern")).alias("pattern")))).drop("ignored", "owner", "pattern")


def with_baseline(found: DataFrame, baseline: DataFrame | None) -> DataFrame:
    if baseline is None:
        return found.withColumn("baseline_status", F.lit("new"))
    known = baseline.select("fingerprint").distinct().withColumn("known", F.lit(True))
    return found.join(known, "fingerprint", "left").withColumn("baseline_status", F.when(F.col("known"), "existing").otherwise("new")).drop("known")


def ordered(found: DataFrame) -> DataFrame:
    """By action version, impact as text, rule, and location with the path compared part by part."""
    return found.orderBy("action_version", "impact", "rule_id", F.split("path", "/"), "sl", "sc", "el", "ec")


def summary(found: DataFrame, fail_on: str = "breaking", new_only: bool = False, incomplete: bool = False, allow_incomplete: bool = False) -> DataFrame:
    """One row: counts over unsuppressed findings, whether the gate fails, and the exit code."""
    least = {"never": 99, "any": 0, "deprecated": 1, "risk": 2, "breaking": 3}[fail_on]
    active = "suppression is null"
    counts = [F.count_if(F.expr(f"{active} and impact = '{i}'")).alias(i) for i in ("breaking", "risk", "deprecated", "informational")]
    hit = f"{active} and {E.rank('impact')} >= {least}" + (" and baseline_status = 'new'" if new_only else "")
    out = found.agg(*counts, F.count_if(F.expr(f"not ({active})")).alias("suppressed"), F.count_if(F.expr(f"{active} and baseline_status = 'new'")).alias("new"), F.coalesce(F.bool_or(F.expr(hit)), F.lit(False)).alias("gate_failed"))
    return out.withColumn("exit_code", F.when(F.lit(incomplete and not allow_incomplete), 3).when(F.col("gate_failed"), 1).otherwise(0))
