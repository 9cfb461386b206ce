"""Nested ignore rules as data: listings of any size are filtered by equi-joins on the directories above each path.

Rules belong to a directory and hold for what lies below it; of the rules that match a path, the last line of the deepest directory
decides, and what lies in an ignored directory is ignored, whatever is said of it. A directory is matched with a slash at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chain(path: Column | str) -> Column:
    """A path's directories from the top down, and the path: a/b/c -> a, a/b, a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def last_match(path: Column, rules: str = "rules") -> Column:
    """Whether the last of the rules that match takes the path back; null where none matches."""
    hits = F.filter(rules, lambda r: F.rlike(path, F.concat(F.lit("^(?:"), r["regex"], F.lit(")$"))))
    return F.try_element_at(hits, F.lit(-1))["again"]


def ignored(listing: DataFrame, rules: DataFrame, path_col: str = "path") -> DataFrame:
    """(path) of the listing's distinct paths that are ignored. rules: (base, rules array<struct<again, regex>>), one row for each directory
    that has some; the root's base is empty."""
    paths = listing.select(F.col(path_col).alias("path")).distinct()
    steps = paths.select("path", F.explode(chain("path")).alias("node")).withColumn("is_dir", F.col("node") != F.col("path"))
    nodes = steps.select("node", "is_dir").distinct()
    over = F.concat(F.array(F.lit("")), F.slice(chain("node"), F.lit(1), F.size(F.split("node", "/")) - 1))
    asked = nodes.select("node", "is_dir", F.posexplode(over).alias("depth", "base")).join(rules, "base")
    shown = F.concat(F.when(F.col("base") == "", F.col("node")).otherwise(F.substr("node", F.length("base") + 2)), F.when(F.col("is_dir"), "/").otherwise(""))
    told = asked.withColumn("again", last_match(shown)).where("again is not null")
    shut = told.groupBy("node", "is_dir").agg(F.max_by("again", "depth").alias("again")).where("not again").select("node", "is_dir")
    return steps.join(shut, ["node", "is_dir"], "left_semi").select("path").distinct()


def matches(path: Column, specs: list[tuple[bool, str]]) -> Column:
    """Whether the last of a configuration's patterns that match takes a path in; false where none matches."""
    out = F.lit(False)
    for again, regex in specs:
        out = F.when(path.rlike(f"^(?:{regex})$"), F.lit(not again)).otherwise(out)
    return out


def selected(path: Column | str, include: list[tuple[bool, str]], exclude: list[tuple[bool, str]]) -> Column:
    """Whether a configuration's include patterns take a path, and its exclude patterns neither it nor a directory above it."""
    path = F.col(path) if isinstance(path, str) else path
    out = matches(path, include) if include else F.lit(True)
    if exclude:
        every = chain(path)
        out &= ~F.exists(every, lambda p: matches(F.when(p == path, p).otherwise(F.concat(p, F.lit("/"))), exclude))
    return out
