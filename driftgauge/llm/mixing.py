"""Mixing sources to target weights by iterative proportional fitting. DataFrame and SQL functions only.

The corpus is reduced to cells (source, language, topic) with their token weights. Raking scales
the cells in turn until their source, language and topic sums are within TOLERANCE of the targets. Targets
are given as weights by value for any of the three; values that are not named share what is left. A
margin without given targets takes the corpus's own shares raised to a power below one, so that dominant
values shrink. Values without tokens can have no share, and the others' targets are scaled up for them.
Targets that no weights can meet (a source of one language only, say) end after ROUNDS rounds, with the
residual that rake() returns. A cell's factor is its fitted share over its own. A document is drawn with
probability min(1, lambda * factor), lambda set so that the expected tokens are the asked share of the
corpus; the draw is the document id's md5, so it is the same on every run and cluster, and rows of equal
id are drawn alike.

topic is any expression; the documents have none of their own, so the query takes the text's length
class. A token is a run of characters other than space and TAB..CR. Null sources, languages and ids
are values of their own; null and empty texts have no tokens, and get their cell's probability. A
cell without tokens has factor 1. Cells, and the targets of a margin, are joined by broadcast only while
their counted number is at most SMALL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.llm.text import checkpoint, documents

ROUNDS, TOLERANCE, RATE, SMALL = 200, 1e-4, 0.5, 50_000
#: Rounds between two looks at the residual, the largest distance of a margin's share from its target.
EVERY = 4
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.5}
BANDS = (("short", 128), ("medium", 512), ("long", 2048))


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def length_class(n: str = "n_tokens") -> Column:
    out = F.lit("book")
    for name, below in reversed(BANDS):
        out = F.when(F.col(n) < below, name).otherwise(out)
    return out


def number(df: DataFrame, value: Column) -> float:
    return float(df.agg(F.coalesce(value, F.lit(0.0))).first()[0])


def targets_of(cells: DataFrame, name: str, power: float, given: dict[str, float] | None) -> DataFrame:
    """The target share of each value of a margin; they sum to 1 over values that have tokens."""
    own = cells.groupBy(F.col(name).alias(f"{name}_")).agg(F.sum("share").alias("own"))
    named = cells.sparkSession.createDataFrame([(str(k or ""), float(v)) for k, v in (given or {}).items()], "value string, weight double")
    own = checkpoint(own.join(named, F.col(f"{name}_") == F.col("value"), "left").withColumn("free", F.when((F.col("own") > 0) & F.col("weight").isNull(), F.pow("own", F.lit(power))).otherwise(0.0)))
    weight = F.when(F.col("own") > 0, F.col("weight")).otherwise(0.0)
    said, free_ = number(own, F.sum(weight)), number(own, F.sum("free"))
    left = max(0.0, 1.0 - said) if free_ else 0.0
    raw = F.coalesce(weight, F.lit(0.0)) + F.col("free") * F.lit(left / free_ if free_ else 0.0)
    return own.select(f"{name}_", (raw / F.lit((said + left) or 1.0)).alias(f"target_{name}"))


def rake(cells: DataFrame, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """cells with share, fitted: the shares raked to the targets of each named column; and the largest distance of a sum from its target."""
    total = number(cells, F.sum("tokens").cast("double"))
    out = checkpoint(cells.withColumn("share", F.col("tokens") / F.lit(total) if total else F.lit(0.0)))
    for name, power in powers.items():
        side = targets_of(out, name, power, (targets or {}).get(name))
        out = out.join(F.broadcast(side) if side.count() <= SMALL else side, F.col(name) == F.col(f"{name}_"), "left").drop(f"{name}_")
    out, residual = checkpoint(out.withColumn("fitted", F.col("share"))), 1.0
    few = out.count() <= SMALL  # then one task holds them, and no round needs an exchange
    turns = "{cells}"
    for name in [*powers] * EVERY:
        own = f"SUM(fitted) OVER (PARTITION BY {name})"
        turns = f"(SELECT * EXCEPT (fitted, own), CASE WHEN own > 0 THEN fitted * target_{name} / own ELSE 0 END AS fitted FROM (SELECT *, {own} AS own FROM {turns}))"
    done = 0
    while done < rounds and residual > tolerance:
        out = checkpoint(cells.sparkSession.sql("SELECT * FROM " + turns, cells=out.coalesce(1) if few else out))
        far = [F.abs(F.sum("fitted").over(Window.partitionBy(name)) - F.col(f"target_{name}")) for name in powers]
        residual = number(out.select(F.greatest(*far).alias("far")), F.max("far"))
        done += EVERY
    return out, residual


def probabilities(fitted: DataFrame, rate: float = RATE) -> DataFrame:
    """fitted with factor and prob. Cells that lambda pushes over one are capped, and lambda is raised for the others, until none is left."""
    f = F.when(F.col("share") > 0, F.col("fitted") / F.col("share")).otherwise(1.0)
    out = checkpoint(fitted.withColumn("factor", f))
    lam = 0.0
    while True:
        capped = F.lit(lam) * F.col("factor") > 1
        whole, part = out.agg(F.coalesce(F.sum(F.when(capped, F.col("share"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("share") * F.col("factor"))), F.lit(0.0))).first()
        new = (rate - whole) / part if part else lam or 1.0
        if new <= lam:
            break
        lam = new
    return out.withColumn("prob", F.least(F.lit(1.0), F.lit(lam) * F.col("factor")))


def free(taken: list[str], name: str) -> str:
    """A column name that is not taken."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def draw(id_col: str = "doc_id") -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def weigh(df: DataFrame, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", rate: float = RATE, targets: dict[str, dict[str, float]] | None = None, name: str = "mix") -> DataFrame:
    """df with a struct column, mix or the given name: n_tokens, topic, factor, prob, kept.

    targets: {"source": {value: share, ...}, "lang": ..., "topic": ...}, each as far as wanted; null is the value ""."""
    cols = df.columns
    docs = df.withColumn(name, F.struct(tokens(text_col).alias("n_tokens")))
    docs = docs.withColumn(name, F.struct(f"{name}.n_tokens", (topic if topic is not None else length_class(f"{name}.n_tokens")).alias("topic"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang")))
    keys = list(POWERS)
    cells = docs.groupBy(*[F.col(f"{name}.{k}").alias(k) for k in keys]).agg(F.sum(f"{name}.n_tokens").cast("long").alias("tokens"))
    fitted = checkpoint(probabilities(rake(checkpoint(cells), targets=targets)[0], rate))
    cell = free(cols, "mix_cell")
    side = fitted.select(F.struct(*keys, "factor", "prob").alias(cell))
    if fitted.count() <= SMALL:
        side = F.broadcast(side)
    out = docs.join(side, [F.col(f"{name}.{k}") == F.col(f"{cell}.{k}") for k in keys], "left")
    kept = draw(id_col) < F.col(f"{cell}.prob")
    return out.select(*[F.col(f"`{c}`") for c in cols], F.struct(f"{name}.n_tokens", f"{name}.topic", f"{cell}.factor", f"{cell}.prob", kept.alias("kept")).alias(name))


def sample(df: DataFrame, **how) -> DataFrame:
    """The rows of df that are drawn, with its columns."""
    name = free(df.columns, "mix")
    return weigh(df, name=name, **how).where(f"{name}.kept").select(*[F.col(f"`{c}`") for c in df.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    return weigh(docs).select("doc_id", "source", "lang", F.col("mix.topic").alias("topic"), F.col("mix.n_tokens").alias("n_tokens"), F.round("mix.factor", 6).alias("factor"), F.round("mix.prob", 6).alias("prob"), F.col("mix.kept").alias("kept"))


def _sql() -> str:
    bands = " ".join(f"WHEN n_tokens < {below} THEN '{name}'" for name, below in BANDS)
    keys = ", ".join(POWERS)
    steps = [
        r"d AS (SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents)",
        f"e AS (SELECT *, CASE {bands} ELSE 'book' END AS topic FROM d)",
        "cells AS (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM e GROUP BY ALL)",
        "shares AS (SELECT *, tokens / sum(tokens) OVER () AS share FROM cells)",
    ]
    last = "shares"
    for name, power in POWERS.items():
        steps.append(f"t_{name} AS (SELECT {name}, p / sum(p) OVER () AS target_{name} FROM (SELECT {name}, pow(sum(share), {power}) AS p FROM shares GROUP BY {name} HAVING sum(share) > 0))")
    steps.append(f"f0 AS MATERIALIZED (SELECT *, share AS fitted FROM {last} " + " ".join(f"LEFT JOIN t_{n} USING ({n})" for n in POWERS) + ")")
    inner = f"loop WHERE round < {ROUNDS} AND (round % {EVERY} <> 0 OR far > {TOLERANCE})"
    for name in POWERS:
        scaled = f"CASE WHEN own > 0 THEN fitted * target_{name} / own ELSE 0 END AS fitted"
        inner = f"(SELECT * EXCLUDE (fitted, own), {scaled} FROM (SELECT *, sum(fitted) OVER (PARTITION BY {name}) AS own FROM {inner}))"
    far = ", ".join(f"abs(sum(fitted) OVER (PARTITION BY {name}) - target_{name})" for name in POWERS)
    steps.append(f"loop AS (SELECT *, 1.0::DOUBLE AS far, 0 AS round FROM f0 UNION ALL SELECT * EXCLUDE (fitted, far, round), fitted, max(off) OVER () AS far, round + 1 FROM (SELECT *, greatest({far}) AS off FROM {inner}))".replace("EXCLUDE (fitted, far, round), fitted", "EXCLUDE (fitted, far, round, off), fitted"))
    last = "loop WHERE round = (SELECT max(round) FROM loop)"
    down = f"ORDER BY factor DESC, {keys}"
    steps += [
        f"g AS (SELECT *, CASE WHEN share > 0 THEN fitted / share ELSE 1 END AS factor FROM {last})",
        f"h AS (SELECT *, ({RATE} - coalesce(sum(share) OVER ({down} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(share * factor) OVER ({down} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM g)",
        f"l AS (SELECT arg_min(scale, (-factor, {keys})) AS lam FROM h WHERE scale * factor <= 1 AND share > 0)",
        "p AS (SELECT source, lang, topic, factor, least(1.0, coalesce(lam, 1) * factor) AS prob FROM g, l)",
    ]
    return (
        "WITH RECURSIVE " + ",\n".join(steps) + "\nSELECT e.doc_id, e.source, e.lang, e.topic, e.n_tokens, round(p.factor, 6) AS factor, round(p.prob, 6) AS prob, "
        f"('0x' || substr(md5(coalesce(e.doc_id::VARCHAR, '')), 1, 12))::BIGINT / {float(16**12)!r} < p.prob AS kept "
        "FROM e JOIN p ON coalesce(e.source, '') = p.source AND coalesce(e.lang, '') = p.lang AND e.topic = p.topic"
    )


ORACLE_SQL = _sql()
