"""Registered queries of the scan's own operators, each with the SQL that gives the same rows.

The first family scans source files made from a table's keys; its SQL says what each template must
give, without parsing. The second applies single operators to the tables' own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgauge.functions import exprs as E
from driftgauge.operators import findings as G
from driftgauge.operators import ignores as I
from driftgauge.operators import integrity as N
from driftgauge.operators import match as M
from driftgauge.plans.corpus import TEMPLATES, corpus
from driftgauge.plans.scan import scan_frame
from driftgauge.sources import config as C
from driftgauge.sources import discovery as D
from driftgauge.sources import registry as R
from driftgauge.sources import tree as T

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scans of made files ---------------------------------------------------------------------

BOTH = "3.11-3.12:deprecated;3.13-3.13:breaking"
#: template, rule, kind, confidence, line, scope, subject, ordinal, impact, action, states, reachable, suppressed
EXPECTED = [
    (0, "CPY0001", "module-import", "high", 1, "<module>", "cgi", 0, "breaking", 13, BOTH, "11,12,13", False),
    (1, "CPY0020", "module-import", "high", 1, "<module>", "telnetlib", 0, "breaking", 13, BOTH, "11,12,13", False),
    (2, "CPY0021", "module-import", "high", 1, "<module>", "uu", 0, "breaking", 13, BOTH, "11,12,13", False),
    (3, "CPY0008", "module-import", "high", 3, "<module>", "crypt", 0, "deprecated", 11, "3.11-3.12:deprecated", "11,12", False),
    (3, "CPY0015", "module-import", "high", 5, "<module>", "pipes", 0, "breaking", 13, "3.13-3.13:breaking", "13", False),
    (5, "CPY0009", "literal-dynamic-import", "medium", 2, "<module>", "imghdr", 0, "breaking", 13, BOTH, "11,12,13", False),
    (6, "CPY0061", "builtin-pattern", "high", 1, "<module>", "bool-bitwise-inversion", 0, "deprecated", 12, "3.12-3.13:deprecated", "11,12,13", False),
    (7, "CPY0023", "module-import", "high", 2, "<module>", "distutils", 0, "breaking", 12, "3.12-3.13:breaking", "11,12,13", False),
    (7, "CPY0023", "module-import", "high", 3, "<module>", "distutils", 1, "breaking", 12, "3.12-3.13:breaking", "11,12,13", False),
    (8, "CPY0012", "module-import", "high", 1, "<module>", "nis", 0, "breaking", 13, BOTH, "11,12,13", True),
    (10, "CPY0066", "qualified-reference", "high", 3, "f", "locale.format", 0, "breaking", 12, "3.12-3.13:breaking", "11,12,13", False),
    (10, "CPY0066", "qualified-reference", "high", 3, "f", "locale.format", 1, "breaking", 12, "3.12-3.13:breaking", "11,12,13", False),
    (11, "CPY0094", "call-shape", "high", 2, "<module>", "shutil.rmtree", 0, "deprecated", 12, "3.12-3.13:deprecated", "11,12,13", False),
    (14, "CPY0024", "module-import", "high", 2, "<module>", "imp", 0, "breaking", 12, "3.12-3.13:breaking", "11,12,13", False),
    (15, "CPY0026", "qualified-reference", "high", 2, "<module>", "ssl.wrap_socket", 0, "breaking", 12, "3.12-3.13:breaking", "11,12,13", False),
]
_VALUES = ", ".join("(" + ", ".join(("true" if x else "false") if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'" for x in row) + ")" for row in EXPECTED)
_FILES = f"SELECT {{key}} AS k, 'pkg' || ({{key}} % 16) || '/m' || {{key}} || '.py' AS path, {{key}} % {len(TEMPLATES)} AS t FROM {{table}}"
_FOUND = f"""WITH files AS ({_FILES}), expected(t, rule_id, kind, confidence, line, scope, subject, ordinal, impact, action_version, states, reachable, suppressed) AS (VALUES {_VALUES}),
found AS (SELECT path, rule_id, kind, confidence, line, scope, subject, ordinal::BIGINT AS ordinal, sha256(concat_ws(chr(0), '{E.NAMESPACE}', rule_id, path, scope, subject, ordinal::VARCHAR)) AS fingerprint, impact, action_version, states, reachable, suppressed FROM files JOIN expected USING (t))
"""


def found_sql(name: str, key: str, rest: str) -> str:
    return _FOUND.format(table=name, key=key) + rest


def scanned(spark: SparkSession, df: DataFrame, key: str, **more):
    return scan_frame(spark, corpus(df, key), R.load(), C.Config(baseline=11, horizon=13, minimum_confidence="medium"), **more)


def flat(found: DataFrame) -> DataFrame:
    states = F.expr("array_join(transform(states, s -> concat('3.', s.from, '-3.', s.through, ':', s.state)), ';')")
    return found.select("path", "rule_id", "kind", "confidence", F.col("sl").alias("line"), "scope", "subject", F.col("ordinal").cast("long").alias("ordinal"), "fingerprint", "impact", "action_version", states.alias("states"), F.array_join(F.col("reachable").cast("array<string>"), ",").alias("reachable"), F.col("suppression").isNotNull().alias("suppressed"))


@query(found_sql("part", "p_partkey", "SELECT * FROM found"))
def scan_findings(spark, sf_dir):
    """Every finding of one made file for each part, under 3.11 through 3.13."""
    return flat(scanned(spark, table(spark, sf_dir, "part"), "p_partkey").findings)


@query(found_sql("documents", "doc_id", "SELECT rule_id, kind, impact, count(*) AS n_findings, count(DISTINCT path) AS n_files, count(*) FILTER (WHERE suppressed) AS n_suppressed FROM found GROUP BY ALL"))
def scan_by_rule(spark, sf_dir):
    f = flat(scanned(spark, table(spark, sf_dir, "documents"), "doc_id").findings)
    return f.groupBy("rule_id", "kind", "impact").agg(F.count("*").alias("n_findings"), F.countDistinct("path").alias("n_files"), F.count_if("suppressed").alias("n_suppressed"))


@query(found_sql("part", "p_partkey", "SELECT count(*) FILTER (WHERE NOT suppressed AND impact = 'breaking') AS breaking, count(*) FILTER (WHERE NOT suppressed AND impact = 'risk') AS risk, count(*) FILTER (WHERE NOT suppressed AND impact = 'deprecated') AS deprecated, count(*) FILTER (WHERE NOT suppressed AND impact = 'informational') AS informational, count(*) FILTER (WHERE suppressed) AS suppressed, count(*) FILTER (WHERE NOT suppressed) AS new, true AS gate_failed, 3 AS exit_code FROM found"))
def scan_summary(spark, sf_dir):
    return scanned(spark, table(spark, sf_dir, "part"), "p_partkey").summary()


@query(f"WITH files AS ({_FILES.format(table='part', key='p_partkey')}) SELECT path, 'PYA1003' AS code, 1 AS line FROM files WHERE t = 12")
def scan_diagnostics(spark, sf_dir):
    return scanned(spark, table(spark, sf_dir, "part"), "p_partkey").diagnostics.select("path", "code", F.col("sl").alias("line"))


@query(f"WITH files AS ({_FILES.format(table='part', key='p_partkey')}) SELECT path, 'PYA2001' AS code, 1 AS line, 'lib/cgi.py' AS candidates FROM files WHERE t = 0")
def scan_competing(spark, sf_dir):
    """A local cgi module withholds its imports, visibly."""
    s = scanned(spark, table(spark, sf_dir, "part"), "p_partkey", modules={"cgi": ["lib/cgi.py"]})
    return s.inferences.select("path", "code", F.col("sl").alias("line"), F.array_join(F.col("evidence")["candidate_paths"], ",").alias("candidates"))


@query(found_sql("part", "p_partkey", "SELECT baseline_status, count(*) AS n FROM (SELECT CASE WHEN p.p_partkey % 2 = 0 THEN 'existing' ELSE 'new' END AS baseline_status FROM found JOIN part p ON found.path = 'pkg' || (p.p_partkey % 16) || '/m' || p.p_partkey || '.py') GROUP BY ALL"))
def scan_baseline(spark, sf_dir):
    """Findings of files with an even key are in the baseline."""
    found = scanned(spark, table(spark, sf_dir, "part"), "p_partkey").findings.drop("baseline_status")
    known = found.where("cast(regexp_extract(path, 'm([0-9]+)', 1) as long) % 2 = 0").select("fingerprint")
    return G.with_baseline(found, known).groupBy("baseline_status").agg(F.count("*").alias("n"))


@query(found_sql("part", "p_partkey", "SELECT action_version, impact, rule_id, path, line, row_number() OVER (PARTITION BY rule_id ORDER BY action_version, impact, string_split(path, '/'), line, ordinal) AS place FROM found"))
def scan_order(spark, sf_dir):
    """The report's order within each rule: versions as numbers, impact as text, paths part by part."""
    f = flat(scanned(spark, table(spark, sf_dir, "part"), "p_partkey").findings)
    w = Window.partitionBy("rule_id").orderBy("action_version", "impact", F.split("path", "/"), "line", "ordinal")
    return f.select("action_version", "impact", "rule_id", "path", "line", F.row_number().over(w).cast("long").alias("place"))


@query(found_sql("documents", "doc_id", "SELECT path, rule_id, line, ordinal FROM found ORDER BY action_version, impact, rule_id, string_split(path, '/'), line, ordinal LIMIT 200"))
def scan_first(spark, sf_dir):
    """A report's first 200 findings: by version, impact as text, rule, path part by part, and place."""
    found = G.ordered(scanned(spark, table(spark, sf_dir, "documents"), "doc_id").findings).limit(200)
    return flat(found).select("path", "rule_id", "line", "ordinal")


@query(found_sql("documents", "doc_id", "SELECT rule_id, count(*) AS n FROM found WHERE rule_id <> 'CPY0001' GROUP BY ALL"))
def scan_withheld(spark, sf_dir):
    """Without the findings of a library module that a local one competes with."""
    f = scanned(spark, table(spark, sf_dir, "documents"), "doc_id", modules={"cgi": ["lib/cgi.py"]}).findings
    return f.groupBy("rule_id").agg(F.count("*").alias("n"))


@query(found_sql("documents", "doc_id", "SELECT path, rule_id, line FROM found WHERE confidence = 'high'"))
def scan_high_confidence(spark, sf_dir):
    """Findings of high confidence alone; ordinals and fingerprints are as if all were shown."""
    s = scan_frame(spark, corpus(table(spark, sf_dir, "documents"), "doc_id"), R.load(), C.Config(baseline=11, horizon=13, minimum_confidence="high"))
    return flat(s.findings).select("path", "rule_id", "line")


# --- single operators on the tables' columns ---------------------------------------------------


@query("""SELECT c.c_custkey, c.m, o.o_orderstatus AS state FROM (SELECT c_custkey, unnest(generate_series(12, 120, 12)) AS m FROM customer) c
ASOF JOIN (SELECT o_custkey, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS om, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY ALL) o ON c.c_custkey = o.o_custkey AND c.m >= o.om""")
def asof_state(spark, sf_dir):
    """The last event at or before each target month, looked up within the row; targets without one are left out."""
    o = table(spark, sf_dir, "orders").withColumn("om", (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate"))
    o = o.groupBy("o_custkey", "om").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("s"))
    o = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("om").alias("py"), F.col("s").alias("impact")))).alias("events"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    return c.select("c_custkey", "events", F.explode(F.sequence(F.lit(12), F.lit(120), F.lit(12))).alias("m")).select("c_custkey", F.col("m").cast("long").alias("m"), E.as_of("events", "m").alias("state")).where("state is not null")


@query("""WITH d AS (SELECT user_id, dayofmonth(ts)::INT AS v, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY ALL),
i AS (SELECT *, v - row_number() OVER (PARTITION BY user_id, state ORDER BY v) AS island FROM d)
SELECT user_id, min(v) AS from_day, max(v) AS through_day, state FROM i GROUP BY user_id, state, island""")
def state_ranges(spark, sf_dir):
    """Runs of consecutive days of one state. Days are the bits of a number, so tasks combine them before they are sent, and runs are
    found by bit operations."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").alias("v")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    e = e.groupBy("user_id", "state").agg(F.bit_or(F.expr(E.bit("v"))).alias("days"))
    return e.select("user_id", "state", F.expr(f"inline({E.runs('days')})").alias("from_day", "through_day"))


_LINES = """SELECT l_orderkey::VARCHAR AS path, (l_suppkey % 3)::VARCHAR AS rule_id, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS confidence,
CASE l_linestatus WHEN 'O' THEN 'module-import' ELSE 'call-shape' END AS kind, 11 + l_linenumber % 3 AS v, l_partkey::VARCHAR AS scope, l_quantity::INT::VARCHAR AS quantity FROM lineitem"""


@query(f"""WITH l AS ({_LINES}), s AS (SELECT *, (CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE kind WHEN 'call-shape' THEN 0 ELSE 3 END, kind, l_linenumber, confidence, scope, quantity) AS place FROM l)
SELECT path, rule_id, arg_min(kind, place) AS kind, arg_min(confidence, place) AS confidence, arg_min(scope, place) AS scope, array_to_string(list_sort(list(DISTINCT v)), ',') AS reach, arg_min(l_linenumber, (kind, l_linenumber)) AS first_seq, arg_min(quantity, place) AS quantity FROM s GROUP BY path, rule_id""")
def dedupe_strongest(spark, sf_dir):
    """Lines of an order and rule as matches of one place: the strongest stays, with reach and evidence merged."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey as string) as path", "cast(l_suppkey % 3 as string) as rule_id", "cast(l_linenumber as int) as seq",
        "case l_returnflag when 'R' then 'high' when 'A' then 'medium' else 'low' end as confidence", "case l_linestatus when 'O' then 'module-import' else 'call-shape' end as kind",
        E.bit("11 + l_linenumber % 3") + " as reach", "cast(l_partkey as string) as scope", "array('runtime') as ctx", "map('quantity', array(cast(cast(l_quantity as int) as string))) as evidence", "'x' as subject", "1 as sl", "1 as sc", "1 as el", "2 as ec")
    out = G.strongest(lines)
    return out.select("path", "rule_id", "kind", "confidence", "scope", F.array_join(F.expr(E.members("reach")).cast("array<string>"), ",").alias("reach"), F.col("first.seq").cast("long").alias("first_seq"), F.col("evidence")["quantity"][0].alias("quantity"))


@query(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch(ts)::BIGINT, event_id) - 1 AS ordinal FROM events)
SELECT event_id, user_id, event_type, ordinal, sha256(concat_ws(chr(0), '{E.NAMESPACE}', event_type, user_id::VARCHAR, 'scope', 'subject', ordinal::VARCHAR)) AS fingerprint FROM o""")
def occurrence_ordinal(spark, sf_dir):
    """Events as matches of a user's file: the ordinal among those of a rule, and the fingerprint with it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("rule_id"), F.lit("scope").alias("scope"), F.lit("subject").alias("subject"), F.unix_timestamp("ts").alias("sl"), F.col("event_id").alias("sc"), F.lit(0).alias("first"), F.lit(0).alias("el"), F.lit(0).alias("ec"))
    return G.with_ordinal(e).select("event_id", "user_id", "event_type", F.col("ordinal").cast("long").alias("ordinal"), "fingerprint")


@query(f"SELECT event_id, sha256(concat_ws(chr(0), '{E.NAMESPACE}', user_id::VARCHAR, event_type, event_id::VARCHAR)) AS fingerprint FROM events")
def fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", E.fingerprint("user_id", "event_type", "event_id").alias("fingerprint"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages), n(name) AS (VALUES ('www'), ('example'), ('site1'), ('site2'), ('a'), ('news'))
SELECT page_id, host, name FROM h JOIN n ON host = name OR starts_with(host, name || '.')""")
def prefix_match(spark, sf_dir):
    """Dotted names matched by prefix as an equi-join on their exploded prefixes."""
    h = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    n = spark.createDataFrame([(x,) for x in ("www", "example", "site1", "site2", "a", "news")], "name string")
    return h.withColumn("name", F.explode(E.prefixes("host"))).join(F.broadcast(n), "name").select("page_id", "host", "name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def competing_anti(spark, sf_dir):
    """Customers without an urgent order."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def competing_semi(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


_WINDOWS = [(w, u, 1 + (w * 3) % 20, 4 + (w * 3) % 20) for w, u in enumerate([1, 2, 3, 5, 8, 13, 21, 34, 55, 89])]


@query("WITH w(win, u, a, b) AS (VALUES " + ", ".join(map(str, _WINDOWS)) + ") SELECT event_id, arg_max(win, (a, win)) AS win FROM events JOIN w ON user_id = u AND dayofmonth(ts) BETWEEN a AND b GROUP BY event_id")
def interval_suppress(spark, sf_dir):
    """Events as findings, windows as the statements that directives stand for: the rightmost around a finding suppresses it."""
    w = spark.createDataFrame(_WINDOWS, "win int, u long, a int, b int")
    w = w.select(F.col("u").cast("string").alias("path"), F.lit("r").alias("rule_id"), F.expr("struct(a as sl, win as sc, b as el, 99 as ec)").alias("statement"), F.col("win").cast("string").alias("reason"))
    found = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("path"), F.lit("r").alias("rule_id"), F.dayofmonth("ts").alias("sl"), F.lit(50).alias("sc"), F.dayofmonth("ts").alias("el"), F.lit(60).alias("ec"))
    out = G.suppress(found, w, spark.createDataFrame([], "rule_id string, place int, regex string, pattern string"))
    return out.where("suppression.kind = 'inline'").select("event_id", F.col("suppression.reason").cast("int").alias("win"))


_BANDS = [(0, 5000), (900, 1100), (1000, 1500), (950, 1000), (1200, 1300), (0, 1000), (1400, 2200)]


@query("WITH b(lo, hi) AS (VALUES " + ", ".join(map(str, _BANDS)) + ") SELECT p_partkey, arg_min(lo, (hi - lo, lo)) AS lo, arg_min(hi, (hi - lo, lo)) AS hi FROM part JOIN b ON p_retailprice >= lo AND p_retailprice < hi GROUP BY p_partkey")
def narrowest_interval(spark, sf_dir):
    """The narrowest band around a value; the bands are a literal, so their join is within the row."""
    bands = F.array(*[F.struct(F.lit(h - lo).alias("w"), F.lit(lo).alias("lo"), F.lit(h).alias("hi")) for lo, h in _BANDS])
    best = F.array_min(F.filter(bands, lambda b: (F.col("p_retailprice") >= b["lo"]) & (F.col("p_retailprice") < b["hi"])))
    return table(spark, sf_dir, "part").select("p_partkey", best.alias("b")).where("b is not null").select("p_partkey", "b.lo", "b.hi")


_IGNORES = [("r0", 0, "1$", "*1"), ("r0", 1, "^Brand#2", "Brand#2*"), ("r0", 2, "[135]", "*odd*"), ("r1", 0, "^Brand#1", "Brand#1*")]


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN regexp_matches(p_brand, '1$') THEN '*1' WHEN regexp_matches(p_brand, '^Brand#2') THEN 'Brand#2*' WHEN regexp_matches(p_brand, '[135]') THEN '*odd*' END
WHEN p_partkey % 3 = 1 AND regexp_matches(p_brand, '^Brand#1') THEN 'Brand#1*' END AS pattern FROM part""")
def pattern_ignore_first(spark, sf_dir):
    """Parts as findings of three rules: of a rule's per-file patterns the first that matches suppresses."""
    found = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("path"), F.concat(F.lit("r"), (F.col("p_partkey") % 3).cast("string")).alias("rule_id"), F.lit(1).alias("sl"), F.lit(1).alias("sc"), F.lit(1).alias("el"), F.lit(2).alias("ec"))
    none = spark.createDataFrame([], "path string, rule_id string, statement struct<sl:int,sc:int,el:int,ec:int>, reason string")
    return G.suppress(found, none, spark.createDataFrame(_IGNORES, "rule_id string, place int, regex string, pattern string")).select("p_partkey", F.col("suppression.pattern").alias("pattern"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'existing' ELSE 'new' END AS baseline_status FROM orders")
def baseline_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", E.fingerprint("o_orderkey").alias("fingerprint"))
    return G.with_baseline(o, o.where("o_orderkey % 2 = 0")).select("o_orderkey", "baseline_status")


#: where the rules lie (root, hosts of .net, m. hosts' en), their lines, and what each line matches, with all below it
_RULES = [("''", "true", ["*.html", "blog.*/", "!*1.html", "de"], ["(.*/)?[^/]*[.]html(/.*)?", "(.*/)?blog[.][^/]*/.*", "(.*/)?[^/]*1[.]html(/.*)?", "(.*/)?de(/.*)?"]), ("host", "host LIKE '%.net'", ["/fr/", "*5"], ["fr/.*", "(.*/)?[^/]*5(/.*)?"]), ("host || '/en'", "host LIKE 'm.%'", ["!*5", "7*"], ["(.*/)?[^/]*5(/.*)?", "(.*/)?7[^/]*(/.*)?"])]
_PATH = "rtrim(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/')"


@query(f"""WITH u AS (SELECT DISTINCT {_PATH} AS path, string_split({_PATH}, '/')[1] AS host FROM pages),
n AS (SELECT DISTINCT path, array_to_string(string_split(path, '/')[1:k], '/') AS node, k < len(string_split(path, '/')) AS is_dir FROM u, unnest(generate_series(1, len(string_split(path, '/')))) AS t(k)),
r AS ({" UNION ALL ".join(f"SELECT DISTINCT {base} AS base, {k} AS depth, {i} AS place, {str(line.startswith('!')).lower()} AS again, '{rx}' AS rx FROM u WHERE {which}" for k, (base, which, lines, regexes) in enumerate(_RULES) for i, (line, rx) in enumerate(zip(lines, regexes, strict=True)))}),
v AS (SELECT node, is_dir, arg_max(again, depth * 10 + place) AS again FROM n JOIN r ON (base = '' OR starts_with(node, base || '/')) AND regexp_full_match(CASE WHEN base = '' THEN node ELSE substr(node, length(base) + 2) END || CASE WHEN is_dir THEN '/' ELSE '' END, rx) GROUP BY node, is_dir)
SELECT DISTINCT path FROM n JOIN v USING (node, is_dir) WHERE NOT again""")
def ignored_paths(spark, sf_dir):
    """Paths of pages as a listing, with ignore rules at its root, for some hosts, and for a directory of others: those that are ignored."""
    u = table(spark, sf_dir, "pages").selectExpr("rtrim('/', regexp_extract(url, '^[a-z]+://([^?#]*)', 1)) AS path").withColumn("host", F.split("path", "/")[0])
    rules = None
    for base, which, lines, _ in _RULES:
        kind = F.array(*[F.struct(F.lit(again).alias("again"), F.lit(r).alias("regex")) for again, r in D.glob_rules(lines)])
        one = u.where(which).selectExpr(f"{base} AS base").distinct().withColumn("rules", kind)
        rules = one if rules is None else rules.union(one)
    return I.ignored(u, rules)


_IMPACT = "CASE o_orderpriority WHEN '1-URGENT' THEN 'breaking' WHEN '2-HIGH' THEN 'risk' WHEN '3-MEDIUM' THEN 'deprecated' ELSE 'informational' END"


#: what fails, only new, slice of the orders, incomplete, allowed
_GATES = [("never", False, 5, False, False), ("any", True, 5, False, False), ("breaking", False, 3, False, False), ("risk", True, 3, True, False), ("deprecated", False, 4, True, True), ("breaking", True, 4, True, True), ("risk", False, 2, False, True), ("any", False, 9, False, False), ("breaking", False, 1, False, False), ("breaking", True, 1, False, False), ("never", False, 1, False, False), ("breaking", True, 1, True, False)]
_LEAST = {"never": 99, "any": 0, "deprecated": 1, "risk": 2, "breaking": 3}


def _gate_sql() -> str:
    rank = "CASE impact WHEN 'breaking' THEN 3 WHEN 'risk' THEN 2 WHEN 'deprecated' THEN 1 ELSE 0 END"
    parts = []
    for k, (fail, new, part, incomplete, allowed) in enumerate(_GATES):
        hit = f"coalesce(bool_or(NOT off AND {rank} >= {_LEAST[fail]}" + (" AND b = 'new'" if new else "") + "), false)"
        code = "3" if incomplete and not allowed else f"CASE WHEN {hit} THEN 1 ELSE 0 END"
        parts.append(f"SELECT {k} AS gate, count(*) FILTER (WHERE NOT off AND impact = 'breaking') AS breaking, count(*) FILTER (WHERE off) AS suppressed, count(*) FILTER (WHERE NOT off AND b = 'new') AS new, {hit} AS gate_failed, {code} AS exit_code FROM f WHERE p = {part}")
    return f"WITH f AS (SELECT {_IMPACT} AS impact, o_orderstatus = 'F' AS off, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'existing' END AS b, substr(o_orderpriority, 1, 1)::INT AS p FROM orders) " + " UNION ALL ".join(parts)


@query(_gate_sql())
def gate_eval(spark, sf_dir):
    """Gates of every kind, on the orders of one priority each, urgent ones as breaking: counts, whether it fails, and the exit code."""
    f = table(spark, sf_dir, "orders").select(F.expr(_IMPACT).alias("impact"), F.when(F.col("o_orderstatus") == "F", "x").alias("suppression"), F.expr("if(o_orderkey % 2 = 0, 'new', 'existing')").alias("baseline_status"), F.expr("cast(substr(o_orderpriority, 1, 1) as int)").alias("p"))
    out = None
    for k, (fail, new, part, incomplete, allowed) in enumerate(_GATES):
        one = G.summary(f.where(F.col("p") == part), fail, new, incomplete, allowed).select(F.lit(k).alias("gate"), "breaking", "suppressed", "new", "gate_failed", "exit_code")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH f AS (SELECT {_IMPACT} AS impact, o_orderstatus = 'F' AS off FROM orders) SELECT count(*) FILTER (WHERE NOT off AND impact = 'breaking') AS breaking, count(*) FILTER (WHERE NOT off AND impact = 'risk') AS risk, count(*) FILTER (WHERE NOT off AND impact = 'deprecated') AS deprecated, count(*) FILTER (WHERE NOT off AND impact = 'informational') AS informational, count(*) FILTER (WHERE off) AS suppressed, count(*) FILTER (WHERE NOT off) AS new, true AS gate_failed, 1 AS exit_code FROM f")
def impact_summary(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.expr(_IMPACT).alias("impact"), F.when(F.col("o_orderstatus") == "F", "x").alias("suppression"), F.lit("new").alias("baseline_status"))
    return G.summary(f)


@query("WITH k(disposition) AS (VALUES ('F'), ('O'), ('P'), ('never')) SELECT k.disposition, count(o_orderkey) AS n FROM k LEFT JOIN orders ON o_orderstatus = k.disposition GROUP BY ALL")
def disposition_counts(spark, sf_dir):
    """Counts for every value of an enumeration, zero included."""
    k = spark.createDataFrame([(x,) for x in ("F", "O", "P", "never")], "disposition string")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("disposition")).agg(F.count("*").alias("n"))
    return k.join(n, "disposition", "left").select("disposition", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


_GUARD = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 1 END AS b"


@query(f"WITH g AS (SELECT event_id, {_GUARD} FROM events) SELECT event_id, coalesce((NOT a)::VARCHAR, 'unknown') AS not_a, coalesce((a AND b)::VARCHAR, 'unknown') AS a_and_b, coalesce((a OR b)::VARCHAR, 'unknown') AS a_or_b FROM g")
def three_valued_guard(spark, sf_dir):
    """Unknown is SQL's null: a guard's three-valued logic is Kleene's."""
    g = table(spark, sf_dir, "events").selectExpr("event_id", *[x.strip() + " END AS " + n for x, n in zip(_GUARD.replace("END AS a, ", "|").replace(" END AS b", "").split("|"), ("a", "b"), strict=True)])
    return g.selectExpr("event_id", "coalesce(cast(not a as string), 'unknown') as not_a", "coalesce(cast(a and b as string), 'unknown') as a_and_b", "coalesce(cast(a or b as string), 'unknown') as a_or_b")


@query("SELECT event_id, (event_id % 4 >= 1 AND event_id % 4 <= 2 AND event_id % 3 = 0 AND NOT (event_id % 7 = 0)) AS shape FROM events")
def call_shape(spark, sf_dir):
    """The call-shape predicate on calls made from event ids: 1 to 2 positional, keyword k required, no unpacking."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_id % 7 = 0 as star", "false as star_star", "false as repeated",
        "if(event_id % 4 = 0, cast(array() as array<struct<resolved:boolean,type:string,value:string>>), transform(sequence(1, cast(event_id % 4 as int)), i -> named_struct('resolved', true, 'type', 'int', 'value', cast(i as string)))) as positional",
        "if(event_id % 3 = 0, array(named_struct('name', 'k', 'resolved', true, 'type', 'int', 'value', '1')), cast(array() as array<struct<name:string,resolved:boolean,type:string,value:string>>)) as keywords",
        "1 as min_pos", "2 as max_pos", "cast(null as int) as min_kw", "cast(null as int) as max_kw", "array('k') as required", "cast(array() as array<string>) as forbidden", "cast(array() as array<struct<position:int,keyword:string,type:string,value:string>>) as literals")
    return e.select("event_id", E.call_shape().alias("shape"))


def _rule_values() -> str:
    return ", ".join(f"('{r.id}', '{r.subject_kind}', '{r.subject}', {r.events[0][1]}, {r.events[-1][1]}, {len(r.events)}, {str(any(e[0] == 'removed' for e in r.events)).lower()})" for r in R.load().rules)


#: the rules, and how often a scan of the parts' files meets each
_REG = found_sql("part", "p_partkey", f", r(rule_id, kind, subject, first_py, last_py, n_events, removed) AS (VALUES {_rule_values()}), m AS (SELECT rule_id, count(*) AS n_findings, count(DISTINCT path) AS n_files FROM found GROUP BY rule_id), q AS (SELECT r.*, coalesce(n_findings, 0) AS n_findings, coalesce(n_files, 0) AS n_files FROM r LEFT JOIN m USING (rule_id)) ")


def _met(spark, sf_dir) -> DataFrame:
    """The bundled registry's rules with n_findings and n_files of one made file for each part; rules that nothing meets have zeros."""
    n = scanned(spark, table(spark, sf_dir, "part"), "p_partkey").findings.groupBy("rule_id").agg(F.count("*").alias("n_findings"), F.countDistinct("path").alias("n_files"))
    return R.rules_frame(spark, R.load()).join(n, "rule_id", "left").fillna(0, ["n_findings", "n_files"])


@query(_REG + "SELECT * FROM q")
def registry_rules(spark, sf_dir):
    """Every rule with its timeline's ends and what a scan finds of it."""
    first, last = F.col("events")[0]["py"], F.element_at("events", -1)["py"]
    return _met(spark, sf_dir).select("rule_id", F.col("subject_kind").alias("kind"), "subject", first.alias("first_py"), last.alias("last_py"), F.size("events").alias("n_events"), F.col("has_removal").alias("removed"), "n_findings", "n_files")


@query(_REG + "SELECT kind, count(*) AS n, count(*) FILTER (WHERE removed) AS n_removed, min(first_py) AS first_py, max(last_py) AS last_py, count(*) FILTER (WHERE n_findings > 0) AS n_met, sum(n_findings)::BIGINT AS n_findings FROM q GROUP BY kind")
def registry_coverage(spark, sf_dir):
    """Rules by kind of subject, and how many of them a scan meets."""
    r = _met(spark, sf_dir)
    return r.groupBy(F.col("subject_kind").alias("kind")).agg(F.count("*").alias("n"), F.count_if("has_removal").alias("n_removed"), F.min(F.col("events")[0]["py"]).alias("first_py"), F.max(F.element_at("events", -1)["py"]).alias("last_py"), F.count_if(F.expr("n_findings > 0")).alias("n_met"), F.sum("n_findings").alias("n_findings"))


@query(_REG + ", v(v) AS (VALUES " + ", ".join(f"({v})" for v in range(11, 17)) + "), s AS (SELECT v, n_findings, CASE WHEN removed AND v >= last_py THEN 'removed' WHEN v >= first_py THEN 'deprecated' END AS state FROM q, v WHERE n_events = 2 AND removed) SELECT v, state, count(*) AS n, sum(n_findings)::BIGINT AS n_findings FROM s WHERE state IS NOT NULL GROUP BY ALL")
def registry_forecast(spark, sf_dir):
    """How many deprecate-then-remove rules are in each state at each version of the window, and how many findings are theirs."""
    r = _met(spark, sf_dir).where("size(events) = 2 and has_removal")
    s = r.withColumn("v", F.explode(F.sequence(F.lit(11), F.lit(16)))).select("v", "n_findings", E.as_of("events", "v", "event").alias("state")).where("state is not null")
    return s.groupBy("v", "state").agg(F.count("*").alias("n"), F.sum("n_findings").alias("n_findings"))


@query("SELECT 'both' AS side, k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'customer', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_ops(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return o.intersect(c).select(F.lit("both").alias("side"), "k").unionByName(c.exceptAll(o.distinct()).distinct().select(F.lit("customer").alias("side"), "k"))


@query("SELECT p_partkey, '3.' || (p_size % 17) AS version, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 17, p_partkey) AS place FROM part")
def version_sort(spark, sf_dir):
    """Versions in numeric order, 3.9 before 3.10."""
    w = Window.partitionBy("p_brand").orderBy(F.regexp_extract("version", r"3\.(\d+)", 1).cast("int"), "p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(F.lit("3."), (F.col("p_size") % 17).cast("string")).alias("version"))
    return p.select("p_partkey", "version", F.row_number().over(w).cast("long").alias("place"))


@query("""WITH l AS (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT o_custkey, count(*) FILTER (WHERE before IS NOT NULL AND before >= o_orderdate) AS violations FROM l GROUP BY o_custkey""")
def strict_order(spark, sf_dir):
    """Neighbours that do not strictly increase."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("before", F.lag("o_orderdate").over(w))
    return o.groupBy("o_custkey").agg(F.count_if(F.expr("before is not null and before >= o_orderdate")).alias("violations"))


@query("SELECT k AS name, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages), unnest(list_transform(generate_series(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[1:i], '.'))) AS u(k) GROUP BY k")
def module_map(spark, sf_dir):
    """Every dotted prefix with the sorted distinct names under it."""
    h = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).distinct()
    return h.select("host", F.explode(E.prefixes("host")).alias("name")).groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("host")), ",").alias("hosts"))


@query("SELECT c_custkey, list_filter(list_transform(string_split(c_name || ', ' || c_mktsegment || ',,' || c_mktsegment, ','), lambda x: trim(x)), lambda x: x <> '')[2] AS second FROM customer")
def list_split(spark, sf_dir):
    """Comma lists trimmed, blanks dropped, first occurrences kept in order."""
    text = F.concat_ws(",", F.col("c_name"), F.concat(F.lit(" "), F.col("c_mktsegment")), F.lit(""), F.col("c_mktsegment"))
    parts = F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(parts, F.lit(1)).alias("second"))


_ENTRY = """SELECT (o_custkey % 13)::VARCHAR AS source, (o_orderkey - o_orderkey % 29 // 28)::VARCHAR AS source_key,
CASE o_orderpriority WHEN '1-URGENT' THEN 'implemented' WHEN '2-HIGH' THEN 'partial' WHEN '3-MEDIUM' THEN 'duplicate' WHEN '5-LOW' THEN 'c-api-roadmap' ELSE 'not-applicable' END AS kind,
o_orderkey % 5 <> 0 AS named, 'R' || o_orderkey % 7 AS rule, o_orderkey % 11 = 0 AS twice, o_orderkey % 3 = 0 AS bare FROM orders"""


@query(f"""WITH e AS ({_ENTRY}), k AS (SELECT DISTINCT source, source_key FROM e WHERE source_key::BIGINT % 17 <> 0 UNION ALL SELECT (c_custkey % 13)::VARCHAR, 'c' || c_custkey FROM customer WHERE c_custkey % 4 = 0),
r AS (SELECT unnest(['R0', 'R1', 'R2', 'R3', 'R4', 'R5', 'R9']) AS rule)
SELECT source, source_key, NULL AS rule_id, 'is not classified' AS problem FROM k WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.source = k.source AND e.source_key = k.source_key)
UNION ALL SELECT DISTINCT source, source_key, NULL, 'is not among the source keys' FROM e WHERE source_key::BIGINT % 17 = 0
UNION ALL SELECT source, source_key, NULL, 'is classified more than once' FROM e GROUP BY source, source_key HAVING count(*) > 1
UNION ALL SELECT DISTINCT source, source_key, rule, 'names an unknown rule' FROM e WHERE named AND rule = 'R6'
UNION ALL SELECT source, source_key, rule, 'names a rule more than once' FROM e WHERE named GROUP BY source, source_key, rule HAVING sum(CASE WHEN twice THEN 2 ELSE 1 END) > 1
UNION ALL SELECT source, source_key, NULL, 'names no rule' FROM e WHERE NOT named AND kind IN ('implemented', 'partial', 'duplicate')
UNION ALL SELECT source, source_key, NULL, 'may not name rules' FROM e WHERE named AND kind NOT IN ('implemented', 'partial', 'duplicate')
UNION ALL SELECT source, source_key, NULL, 'needs a note' FROM e WHERE bare AND kind <> 'implemented'
UNION ALL SELECT NULL, NULL, rule, 'no source covers it' FROM r WHERE rule NOT IN (SELECT rule FROM e WHERE named AND kind IN ('implemented', 'partial'))""")
def coverage_integrity(spark, sf_dir):
    """Orders as entries of coverage manifests, some of them at fault: every violation."""
    e = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_custkey % 13 as string) as source", "cast(o_orderkey - (o_orderkey % 29) div 28 as string) as source_key",
        "case o_orderpriority when '1-URGENT' then 'implemented' when '2-HIGH' then 'partial' when '3-MEDIUM' then 'duplicate' when '5-LOW' then 'c-api-roadmap' else 'not-applicable' end as disposition",
        "if(o_orderkey % 5 = 0, if(o_orderkey % 2 = 0, null, cast(array() as array<string>)), if(o_orderkey % 11 = 0, array_repeat(concat('R', o_orderkey % 7), 2), array(concat('R', o_orderkey % 7)))) as rules", "if(o_orderkey % 3 = 0, if(o_orderkey % 2 = 0, null, ' '), 'why') as note")
    k = e.select("source", "source_key").where("cast(source_key as long) % 17 <> 0").union(table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").selectExpr("cast(c_custkey % 13 as string)", "concat('c', c_custkey)"))
    return N.violations(e, k, spark.createDataFrame([(f"R{i}",) for i in (0, 1, 2, 3, 4, 5, 9)], "rule_id string"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages),
f AS (SELECT CASE WHEN page_id % 3 = 0 THEN 'src/' ELSE '' END || CASE WHEN page_id % 10 = 7 THEN 'no-name/' ELSE '' END || replace(host, '.', '/') || CASE WHEN page_id % 4 = 1 THEN '/__init__.py' WHEN page_id % 8 = 2 THEN '/m.pyi' ELSE '/m' || page_id || '.py' END AS path, string_split(host, '.')[1] AS top, page_id FROM p)
SELECT top AS key, count(DISTINCT path) AS n FROM f WHERE page_id % 10 <> 7 AND page_id % 8 <> 2 AND regexp_full_match(replace(path, '/', '.'), '([A-Za-z_][A-Za-z0-9_]*[.])*py') GROUP BY top UNION ALL SELECT '*', 1 UNION ALL SELECT 'vendored', 1""")
def project_modules(spark, sf_dir):
    """Hosts of pages as packages of a tree: the top-level names that it provides itself, and from how many files; links stand for what they hide."""
    host = "replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.', '/')"
    path = f"concat(if(page_id % 3 = 0, 'src/', ''), if(page_id % 10 = 7, 'no-name/', ''), {host}, if(page_id % 4 = 1, '/__init__.py', if(page_id % 8 = 2, '/m.pyi', concat('/m', page_id, '.py'))))"
    files = table(spark, sf_dir, "pages").selectExpr(f"{path} as path", "'file' as kind")
    links = spark.createDataFrame([("src", "link"), ("vendored", "link"), ("not-a-name", "link")], "path string, kind string")
    return T.modules(files.union(links), [".", "src"]).groupBy("key").agg(F.count("*").alias("n"))


def _made(spark, sf_dir, sources: list[str]) -> DataFrame:
    """One file for each customer, of these sources by its key."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.cast("string").alias("path"), F.element_at(F.array(*map(F.lit, sources)), (c % len(sources) + 1).cast("int")).alias("source"))


_CALLS = ["import a.b\na.b.c(1)\n", "from a.b import c\nx = c\n", "import a\ndef f(a):\n    return a.b.c()\n", "from a.b import c as d\nd()\nd(1)\n", "if x:\n    from a.b import c\nelse:\n    from e import c\nc()\n"]


@query("SELECT c_custkey, line, confidence, ordinal FROM customer JOIN (VALUES (0, 2, 'high', 0), (3, 2, 'high', 0), (3, 3, 'high', 1), (4, 5, 'medium', 0)) AS e(t, line, confidence, ordinal) ON c_custkey % 5 = t")
def scan_calls(spark, sf_dir):
    """Calls of a function by its qualified name, under a registry of that rule: references are no calls, parameters shadow, other bindings make it uncertain."""
    rule = R.Rule("CPY9001", "c goes", "function", "a.b.c", ("runtime",), (("deprecated", 11, "released", "s", "deprecated"), ("removed", 13, "released", "s", "breaking")), (R.Matcher("qualified-call", "a.b.c"),), "use d")
    registry = R.Registry((rule,), tuple((v, "stable", None) for v in (11, 12, 13)), "1", "0" * 64)
    found = scan_frame(spark, _made(spark, sf_dir, _CALLS), registry, C.Config(baseline=11, horizon=13, minimum_confidence="medium"), cached=False).findings
    return found.select(F.col("path").cast("long").alias("c_custkey"), F.col("sl").alias("line"), "confidence", F.col("ordinal").cast("int").alias("ordinal"))


_LISTS = ["CPY0001", " CPY0001 , ,CPY0021,CPY0001", ",,", "NOPE,CPY0012"]


@query("SELECT c_custkey, subject, CASE c_custkey % 4 WHEN 0 THEN subject = 'cgi' WHEN 1 THEN subject IN ('cgi', 'uu') WHEN 2 THEN false ELSE subject = 'nis' END AS suppressed FROM customer, (VALUES ('cgi'), ('uu'), ('nis')) AS s(subject)")
def directive_lists(spark, sf_dir):
    """Lists of rules in suppression comments: blanks and repeats go, a list of blanks suppresses nothing, unknown names leave the others."""
    files = _made(spark, sf_dir, [f"import cgi, uu, nis  # driftgauge: ignore[{x}] -- why\n" for x in _LISTS])
    found = scan_frame(spark, files, config=C.Config(baseline=11, horizon=13), cached=False).findings
    return found.select(F.col("path").cast("long").alias("c_custkey"), "subject", F.col("suppression").isNotNull().alias("suppressed"))


_TRUTH = ["sys.version_info >= (3, 0)", "sys.version_info < (3, 0)", "unknown"]
_KLEENE = {"not_a": "NOT a", "a_and_b": "a AND b", "a_or_b": "a OR b"}


@query("WITH g AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS a, CASE event_id // 3 % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b FROM events) " + " UNION ALL ".join(f"SELECT event_id, '{n}' AS guard, coalesce(({x})::VARCHAR, 'unknown') AS truth FROM g" for n, x in _KLEENE.items()))
def guard_truth(spark, sf_dir):
    """Guards of made files, of which parts are true, false or unknown: what their branches can be reached by tells what the guard is."""
    guards = F.array(*map(F.lit, _TRUTH))
    a, b = F.element_at(guards, (F.col("event_id") % 3 + 1).cast("int")), F.element_at(guards, (F.expr("event_id div 3") % 3 + 1).cast("int"))
    text = {"not_a": F.concat(F.lit("not ("), a, F.lit(")")), "a_and_b": F.concat(a, F.lit(" and "), b), "a_or_b": F.concat(a, F.lit(" or "), b)}
    source = F.concat(F.lit("import sys\n"), *[x for n, t in text.items() for x in (F.lit("if "), t, F.lit(f":\n    import yes_{n}\nelse:\n    import no_{n}\n"))])
    events = M.spread(table(spark, sf_dir, "events").select("event_id"), key="event_id")
    files = events.select(F.col("event_id").cast("string").alias("path"), source.alias("source"))
    # a file's facts are one row, so what its branches are reached by is told within it
    met = M.parse(files, (11, 12)).select("path", F.expr("filter(facts, f -> f.use = 'i' and f.module <> 'sys')").alias("met"))
    may = met.select("path", "met", F.explode(F.array(*map(F.lit, text))).alias("guard")).where("exists(met, f -> f.module in (concat('yes_', guard), concat('no_', guard)))")
    yes, no = (F.expr(f"exists(met, f -> f.module = concat('{x}_', guard) and f.reach != 0)") for x in ("yes", "no"))
    return may.select(F.col("path").cast("long").alias("event_id"), "guard", F.when(yes & no, "unknown").when(yes, "true").otherwise("false").alias("truth"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
