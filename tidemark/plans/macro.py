"""Queries over vintages, panels and editions: events are releases of their type's daily figure; an order's lines are a filing's facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import macro as M
from tidemark.session import instants, table

TYPES = ["click", "error", "purchase", "signup", "view"]


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events as versions of their type's three-day period; some expire after two days."""
    e = instants(table(spark, sf_dir, "events"), "ts").where("event_id % 3 = 0")
    period = F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 3) * 3).cast("int"))
    return e.select(F.col("event_type").alias("indicator"), period.alias("period"), F.col("ts").alias("available"), F.when(F.col("event_id") % 7 == 0, F.col("ts") + F.expr("interval 2 days")).alias("expires"), "value")


VINTAGES = """v AS (SELECT event_type AS indicator, DATE '2024-01-01' + CAST((CAST(ts AS DATE) - DATE '2024-01-01') // 3 * 3 AS INTEGER) AS period, ts AS available,
  CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 2 DAY END AS expires, value FROM events WHERE event_id % 3 = 0)"""
SNAP = f"""{VINTAGES}, d AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 18 HOUR AS decision FROM events UNION SELECT CAST(CAST(ts AS DATE) + 6 AS TIMESTAMP) + INTERVAL 18 HOUR FROM events),
n AS (SELECT decision, indicator, period, max(available) AS available FROM d JOIN v ON available <= decision GROUP BY ALL),
a AS (SELECT n.decision, v.* FROM n JOIN v USING (indicator, period, available) WHERE (expires IS NULL OR expires > decision) AND available + INTERVAL 5 DAY > decision),
s AS (SELECT decision, indicator, period, available, value FROM a QUALIFY row_number() OVER (PARTITION BY decision, indicator ORDER BY period DESC) = 1)"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.snapshots(vintages(spark, sf_dir), ["indicator"], "period", "available", "expires", "value", 5, 18)


def vintage_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases of the same minute: equal repeats are one, unequal ones are quarantined."""
    v = vintages(spark, sf_dir).withColumn("minute", F.date_trunc("minute", "available")).withColumn("level", F.floor(F.col("value") / 40))
    good, bad = M.split_conflicts(v, ["indicator", "minute"], "level")
    return good.groupBy("indicator", F.lit("kept").alias("state")).agg(F.count(F.lit(1)).alias("keys")).unionByName(bad.groupBy("indicator", F.lit("conflict").alias("state")).agg(F.count(F.lit(1)).alias("keys")))


def vintage_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each indicator at six in the evening of each day, only where it changed."""
    known = M.changed_only(_known(spark, sf_dir), ["indicator"], "decision", ["period", "value"])
    return known.select("indicator", "decision", "period", "value", "available")


RULES = {"ratio": "purchase / click", "spread": "(ratio - signup) * 0.5", "share": "view / (view + click + purchase)", "total": "share + spread"}


def snapshot_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived indicators of each decision in dependency order, with reasons, availability and sources."""
    s = M.snapshot_values(_known(spark, sf_dir), "indicator", TYPES, RULES, "value", "available")
    return s.select("decision", F.round("ratio", 7).alias("ratio"), F.round("total", 7).alias("total"), "total_reason", "total_at", "total_sources", "share_sources")


def macro_recalculation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the indicators that a wanted one rests on, from the start of a history: how many versions that leaves, and the result."""
    v = M.required(vintages(spark, sf_dir), "indicator", RULES, ["share"], "period", F.lit("2024-01-10").cast("date"))
    known = M.snapshots(v, ["indicator"], "period", "available", "expires", "value", 5, 18)
    s = M.snapshot_values(known, "indicator", ["view", "click", "purchase"], {"share": RULES["share"]}, "value", "available")
    return s.agg(F.count(F.lit(1)).alias("decisions"), F.count("share").alias("defined"), F.round(F.avg("share"), 7).alias("mean")).crossJoin(v.agg(F.count(F.lit(1)).alias("versions"), F.countDistinct("indicator").alias("indicators")))


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel by decision of every catalogued indicator, absences included, with the value's age in days."""
    known = _known(spark, sf_dir)
    every = known.select("decision").distinct().crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in [*TYPES, "absent"]], "indicator string")))
    p = every.join(known, ["decision", "indicator"], "left")
    return p.select("decision", "indicator", "value", F.datediff(F.col("decision").cast("date"), "period").alias("age"), F.when(F.col("value").isNull(), "missing").otherwise("available").alias("state"))


def macro_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by the state of each catalogued indicator's row: one valid row, none, several, or an invalid one."""
    e = table(spark, sf_dir, "events").where("event_id % 29 = 0").select(F.col("ts").cast("date").alias("session"), F.col("event_type").alias("indicator"), "value")
    sessions = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("session")).distinct()
    catalog = spark.createDataFrame([(t,) for t in [*TYPES, "absent"]], "indicator string")
    found = M.completeness(e, catalog, sessions, "indicator", "session", F.col("value") > 15)
    return found.groupBy("indicator", "state").agg(F.count(F.lit(1)).alias("sessions"))


def panel_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole statuses of a month replaced by another edition that has them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("indicator"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", F.col("o_totalprice").alias("value"))
    other = o.where("month(day) in (3, 9) and indicator <> 'P' and o_orderkey % 2 = 0").withColumn("value", F.col("value") * 2)
    r = M.replaced(o, other, "indicator", F.trunc("day", "MM"))
    return r.groupBy("indicator", F.month("day").alias("month")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total"))


def version_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composite history of three versions by their boundaries."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("value"))
    h = M.spliced([(None, "1997-01-01", o), ("1997-01-01", "1999-07-01", o.withColumn("value", F.col("value") / 2)), ("1999-07-01", None, o.withColumn("value", F.lit(1.0)))], "day")
    return h.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total"))


def edition_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edition of daily totals with a reviewed one: days by where they come from, and whether shared days agree."""
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("orders"))
    reviewed = d.where("day >= '1999-01-01'").withColumn("total", F.when(F.dayofmonth("day") == 13, F.col("total") + 1).otherwise(F.col("total")))
    e = M.extended(d.where("day < '2000-01-01'"), reviewed, "day", ["total", "orders"])
    return e.groupBy("state", F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("days"), F.sum("orders").alias("orders"))


def metadata_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the metadata that was valid on their day; those outside all ranges have none."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("date").alias("day"), "value")
    m = spark.createDataFrame([("click", "2024-01-01", "2024-01-09", "a"), ("click", "2024-01-10", "2024-01-20", "b"), ("view", "2024-01-05", "2024-01-30", "c")], "event_type string, first string, last string, unit string").withColumns({"first": F.col("first").cast("date"), "last": F.col("last").cast("date")})
    j = M.with_metadata(e, m, "event_type", "day", "first", "last")
    return j.groupBy("event_type", "unit").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))


def release_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against a declared contract of unit, bounds and publication: rows by the reasons that they break it for."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    r = M.contract_reasons(F.col("l_linestatus"), F.lit("F"), F.col("l_shipdate").cast("date"), F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"), F.date_add(F.col("o_orderdate").cast("date"), 200))
    return li.groupBy(F.array_join(r, "+").alias("reasons")).agg(F.count(F.lit(1)).alias("rows"))


def first_admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per indicator the first decision from which it was known without a gap of over one day, and why one is excluded."""
    k = _known(spark, sf_dir).select("indicator", F.col("decision").cast("date").alias("day"))
    k = k.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy("indicator").orderBy("day"))))
    s = k.groupBy("indicator").agg(F.coalesce(F.max(F.when(F.col("gap") > 1, F.col("day"))), F.min("day")).alias("first"), F.max("day").alias("last"))
    every = spark.createDataFrame([(t,) for t in [*TYPES, "absent"]], "indicator string")
    return every.join(s, "indicator", "left").select("indicator", "first", F.when(F.col("first").isNull(), "never_known").when(F.col("last") < F.lit("2024-01-30").cast("date"), "ended").otherwise("admitted").alias("state"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 = 0")
    place = F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(7)).cast("int")
    tags = F.array(*[F.lit(t) for t in M.TAGS])
    value = F.when(F.col("l_suppkey") % 23 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return li.select("l_orderkey", F.get(tags, place).alias("tag"), value.alias("value"), F.when(F.col("l_returnflag") == "R", "CAD").otherwise("USD").alias("unit"), F.col("l_shipdate").cast("date").alias("available"), (F.col("l_linenumber") != 5).alias("stock"))


def company_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven ratios of each filing whenever one changes: changes by ratio and status, and their sums."""
    f = M.company_factors(_facts(spark, sf_dir), ["l_orderkey"], "tag", "value", "unit", "available", F.col("stock"), "USD")
    return f.groupBy("ratio", "status").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("l_orderkey").alias("filings"), F.round(F.sum("value"), 5).alias("total"), F.round(F.sum("numerator"), 5).alias("numerators"), F.sum(F.size("problems")).alias("problems"), F.sum(F.size("components")).alias("components"), F.sum(F.datediff("observed", "available_at")).alias("lag_days"))


def component_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each component of a filing: compatible facts that agree, with the earliest availability, or why there is none."""
    good = (F.col("unit") == "USD") & F.col("stock")
    g = _facts(spark, sf_dir).groupBy("l_orderkey", "tag").agg(F.min(F.when(good, F.col("value"))).alias("low"), F.max(F.when(good, F.col("value"))).alias("high"), F.min(F.when(good, F.col("available"))).alias("first"))
    state = F.when(F.col("low").isNull(), "incompatible_component").when(F.col("low") != F.col("high"), "ambiguous_component").otherwise("selected")
    return g.groupBy("tag", state.alias("state")).agg(F.count(F.lit(1)).alias("components"), F.round(F.sum(F.when(F.col("low") == F.col("high"), F.col("low"))), 4).alias("total"), F.min("first").alias("first"))


_FACTS_SQL = "f AS (SELECT l_orderkey AS k, ['" + "', '".join(M.TAGS) + """'][(l_partkey + l_linenumber) % 7 + 1] AS tag, CASE WHEN l_suppkey % 23 = 0 THEN -l_quantity ELSE l_quantity END AS value,
  l_returnflag <> 'R' AND l_linenumber <> 5 AS good, CAST(l_shipdate AS DATE) AS av FROM lineitem WHERE l_orderkey % 4 = 0)"""


def _factors_sql() -> str:
    rules = []
    for name, terms, below in M.RATIOS:
        for tag, sign in [*terms, (below, 0)]:
            rules.append(f"('{name}', '{tag}', {sign}, {str(tag == below).lower()})")
    return f"""
WITH {_FACTS_SQL}, t(ratio, tag, sign, below) AS (VALUES {', '.join(rules)}),
o AS (SELECT DISTINCT k, av AS observed FROM f),
c AS (SELECT o.k, observed, ratio, t.tag, sign, below, count(f.k) AS n, min(CASE WHEN good THEN value END) AS low, max(CASE WHEN good THEN value END) AS high, min(CASE WHEN good THEN f.av END) AS first
  FROM o CROSS JOIN t LEFT JOIN f ON f.k = o.k AND f.tag = t.tag AND f.av <= observed GROUP BY ALL),
p AS (SELECT *, CASE WHEN n = 0 THEN 'missing_component' WHEN low IS NULL THEN 'incompatible_component' WHEN low <> high THEN 'ambiguous_component' END AS problem FROM c),
r AS (SELECT k, observed, ratio, arg_min(problem, tag) FILTER (problem IS NOT NULL) AS problem, count(problem) AS problems, count(*) FILTER (problem IS NULL) AS components, max(first) FILTER (problem IS NULL) AS last,
  CASE WHEN count(*) FILTER (sign <> 0 AND problem IS NOT NULL) = 0 THEN sum(sign * low) END AS numerator, max(low) FILTER (below AND problem IS NULL) AS denominator,
  string_agg(tag || ':' || coalesce(problem, low || '@' || first), '|' ORDER BY tag) AS trace FROM p GROUP BY ALL),
s AS (SELECT *, CASE WHEN problem IS NOT NULL THEN problem WHEN denominator <= 0 THEN 'nonpositive_denominator' ELSE 'accepted' END AS status FROM r),
v AS (SELECT *, CASE WHEN status = 'accepted' THEN numerator / denominator END AS value, CASE WHEN status = 'accepted' THEN last ELSE observed END AS available FROM s),
h AS (SELECT *, lag(trace) OVER w AS before, lag(available) OVER w AS before_at, row_number() OVER w AS i FROM v WINDOW w AS (PARTITION BY k, ratio ORDER BY observed))
SELECT ratio, status, count(*) AS changes, count(DISTINCT k) AS filings, round(sum(value), 5) AS total, round(sum(numerator), 5) AS numerators, CAST(sum(problems) AS BIGINT) AS problems, CAST(sum(components) AS BIGINT) AS components,
  CAST(sum(observed - available) AS BIGINT) AS lag_days FROM h WHERE i = 1 OR trace <> before OR available <> before_at GROUP BY ALL"""


REGISTERED = {
    "vintage_conflicts": (
        vintage_conflicts,
        f"""
WITH {VINTAGES}, g AS (SELECT indicator, date_trunc('minute', available) AS m, count(DISTINCT floor(value / 40)) AS kinds FROM v GROUP BY ALL)
SELECT indicator, CASE WHEN kinds > 1 THEN 'conflict' ELSE 'kept' END AS state, count(*) AS keys FROM g GROUP BY ALL""",
    ),
    "vintage_replay": (
        vintage_replay,
        f"""
WITH {SNAP}, l AS (SELECT *, lag(period) OVER w AS p, lag(value) OVER w AS q, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY indicator ORDER BY decision))
SELECT indicator, decision, period, value, available FROM l WHERE i = 1 OR period <> p OR value <> q""",
    ),
    "snapshot_derivation": (
        snapshot_derivation,
        f"""
WITH {SNAP}, w AS (SELECT decision, {', '.join(f"max(value) FILTER (indicator = '{t}') AS {t}, max(available) FILTER (indicator = '{t}') AS {t}_at" for t in TYPES)} FROM s GROUP BY ALL),
r AS (SELECT *, CASE WHEN click <> 0 THEN purchase / click END AS ratio, CASE WHEN view + click + purchase <> 0 THEN view / (view + click + purchase) END AS share FROM w),
t AS (SELECT *, share + (ratio - signup) * 0.5 AS total FROM r)
SELECT decision, round(ratio, 7) AS ratio, round(total, 7) AS total, CASE WHEN total IS NULL THEN 'source_missing' END AS total_reason, CASE WHEN total IS NOT NULL THEN greatest(click_at, purchase_at, signup_at, view_at) END AS total_at,
  'click+purchase+signup+view' AS total_sources, 'click+purchase+view' AS share_sources FROM t""",
    ),
    "macro_recalculation": (
        macro_recalculation,
        f"""
WITH {SNAP.replace('event_id % 3 = 0)', "event_id % 3 = 0 AND event_type IN ('view', 'click', 'purchase') AND CAST(ts AS DATE) >= DATE '2024-01-10')")}, w AS (SELECT decision, {', '.join(f"max(value) FILTER (indicator = '{t}') AS {t}" for t in ('view', 'click', 'purchase'))} FROM s GROUP BY ALL),
r AS (SELECT count(*) AS decisions, count(view + click + purchase) AS defined, round(avg(view / (view + click + purchase)), 7) AS mean FROM w)
SELECT *, (SELECT count(*) FROM v) AS versions, (SELECT count(DISTINCT indicator) FROM v) AS indicators FROM r""",
    ),
    "daily_panel": (
        daily_panel,
        f"""
WITH {SNAP}, c AS (SELECT unnest({[*TYPES, 'absent']}) AS indicator), e AS (SELECT DISTINCT decision FROM s)
SELECT e.decision, c.indicator, s.value, CAST(CAST(e.decision AS DATE) - s.period AS INTEGER) AS age, CASE WHEN s.value IS NULL THEN 'missing' ELSE 'available' END AS state
FROM e CROSS JOIN c LEFT JOIN s ON s.decision = e.decision AND s.indicator = c.indicator""",
    ),
    "macro_completeness": (
        macro_completeness,
        f"""
WITH c AS (SELECT unnest({[*TYPES, 'absent']}) AS indicator), d AS (SELECT DISTINCT CAST(ts AS DATE) AS session FROM events),
n AS (SELECT CAST(ts AS DATE) AS session, event_type AS indicator, count(*) AS n, count(*) FILTER (value > 15) AS k FROM events WHERE event_id % 29 = 0 GROUP BY ALL)
SELECT c.indicator, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN k = 0 THEN 'invalid' ELSE 'complete' END AS state, count(*) AS sessions
FROM d CROSS JOIN c LEFT JOIN n ON n.session = d.session AND n.indicator = c.indicator GROUP BY ALL""",
    ),
    "panel_replacement": (
        panel_replacement,
        """
WITH o AS (SELECT o_orderstatus AS indicator, CAST(o_orderdate AS DATE) AS day, o_orderkey AS k, o_totalprice AS value FROM orders),
x AS (SELECT indicator, day, k, value * 2 AS value FROM o WHERE month(day) IN (3, 9) AND indicator <> 'P' AND k % 2 = 0), m AS (SELECT DISTINCT indicator, date_trunc('month', day) AS m FROM x),
r AS (SELECT o.* FROM o LEFT JOIN m ON m.indicator = o.indicator AND m.m = date_trunc('month', day) WHERE m.m IS NULL UNION ALL SELECT * FROM x)
SELECT indicator, CAST(month(day) AS INTEGER) AS month, count(*) AS rows, round(sum(value), 2) AS total FROM r GROUP BY ALL""",
    ),
    "version_splice": (
        version_splice,
        """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS rows, round(sum(CASE WHEN o_orderdate < DATE '1997-01-01' THEN o_totalprice WHEN o_orderdate < DATE '1999-07-01' THEN o_totalprice / 2 ELSE 1 END), 2) AS total FROM orders GROUP BY ALL""",
    ),
    "edition_extension": (
        edition_extension,
        """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY ALL)
SELECT CASE WHEN day < DATE '1999-01-01' THEN 'base' WHEN day >= DATE '2000-01-01' THEN 'reviewed' WHEN dayofmonth(day) = 13 THEN 'conflict' ELSE 'shared' END AS state, CAST(year(day) AS INTEGER) AS year, count(*) AS days, CAST(sum(orders) AS BIGINT) AS orders FROM d GROUP BY ALL""",
    ),
    "metadata_ranges": (
        metadata_ranges,
        """
WITH m(t, first, last, unit) AS (VALUES ('click', DATE '2024-01-01', DATE '2024-01-09', 'a'), ('click', DATE '2024-01-10', DATE '2024-01-20', 'b'), ('view', DATE '2024-01-05', DATE '2024-01-30', 'c'))
SELECT event_type, unit, count(*) AS events, round(sum(value), 4) AS total FROM events LEFT JOIN m ON t = event_type AND CAST(ts AS DATE) BETWEEN first AND last GROUP BY ALL""",
    ),
    "release_contracts": (
        release_contracts,
        """
WITH r AS (SELECT concat_ws('+', CASE WHEN l_linestatus <> 'F' THEN 'wrong_unit' END, CASE WHEN CAST(l_shipdate AS DATE) < DATE '1996-01-01' THEN 'before_start' END, CASE WHEN CAST(l_shipdate AS DATE) > DATE '2000-12-31' THEN 'after_end' END,
  CASE WHEN CAST(o_orderdate AS DATE) + 200 < CAST(l_shipdate AS DATE) THEN 'period_not_over' END) AS reasons FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT reasons, count(*) AS rows FROM r GROUP BY ALL""",
    ),
    "first_admissible": (
        first_admissible,
        f"""
WITH {SNAP}, k AS (SELECT indicator, CAST(decision AS DATE) AS day FROM s), g AS (SELECT *, day - lag(day) OVER (PARTITION BY indicator ORDER BY day) AS gap FROM k),
f AS (SELECT indicator, coalesce(max(CASE WHEN gap > 1 THEN day END), min(day)) AS first, max(day) AS last FROM g GROUP BY ALL), c AS (SELECT unnest({[*TYPES, 'absent']}) AS indicator)
SELECT c.indicator, first, CASE WHEN first IS NULL THEN 'never_known' WHEN last < DATE '2024-01-30' THEN 'ended' ELSE 'admitted' END AS state FROM c LEFT JOIN f ON f.indicator = c.indicator""",
    ),
    "company_factors": (company_factors, _factors_sql()),
    "component_selection": (
        component_selection,
        f"""
WITH {_FACTS_SQL}, g AS (SELECT k, tag, min(CASE WHEN good THEN value END) AS low, max(CASE WHEN good THEN value END) AS high, min(CASE WHEN good THEN f.av END) AS first FROM f GROUP BY ALL)
SELECT tag, CASE WHEN low IS NULL THEN 'incompatible_component' WHEN low <> high THEN 'ambiguous_component' ELSE 'selected' END AS state, count(*) AS components, round(sum(CASE WHEN low = high THEN low END), 4) AS total, min(first) AS first FROM g GROUP BY ALL""",
    ),
}
