"""Queries about which rows a result stands for: admission, alignment, digests, set relations, folds, selections."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import populations as P
from tidemark.plans.panel import KEYS, PANEL_SQL, panel
from tidemark.session import table


def prediction_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, keys and bounds of a prediction table (events), as its admission check wants them."""
    return P.admission(table(spark, sf_dir, "events"), "event_id", "ts")


def ordered_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 rows of the table in (type, instant, id) order, which a reader by batches would meet first."""
    e = P.ordered(table(spark, sf_dir, "events"), ["event_type", "ts", "event_id"], ["event_type", "ts", "event_id", "value"])
    return e.limit(100)


def prediction_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent's predictions (labels) aligned to documents by key: rows missing, and rows whose repeated columns disagree."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") % 3).alias("fold"))
    p = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 17 == 0, "xx").otherwise("en").alias("lang"), (F.col("doc_id") % 3 + (F.col("quality") * F.col("toxic"))).alias("fold"), F.col("quality").alias("prediction"))
    j = P.alignment(d, p, "doc_id", ["lang", "fold"])
    return j.groupBy("aligned", "same_lang", "same_fold").agg(F.count(F.lit(1)).alias("rows"), F.sum("prediction").cast("long").alias("positive"))


def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free digests of each nation's customers."""
    return P.digest(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_custkey", "c_mktsegment"])


def population_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms that predict for the same rows have the same digest without their predictions, one that lost a row hasn't."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).cast("decimal(18,2)").alias("prediction"))
    arms = [("base", o), ("moved", o.withColumn("prediction", F.col("prediction") + 1)), ("lost", o.where("o_orderkey <> 7"))]
    out = None
    for name, df in arms:
        d = P.digest(df.withColumn("arm", F.lit(name)), ["arm"], ["o_orderkey", "o_orderstatus"], "population")
        out = d if out is None else out.unionByName(d)
    first = out.where("arm = 'base'").select(F.col("population").alias("base"))
    return out.crossJoin(F.broadcast(first)).select("arm", (F.col("population") == F.col("base")).alias("same"))


def prediction_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of (instant, asset, score) per event type, whatever the rows' order."""
    e = table(spark, sf_dir, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "user_id", F.round(F.col("value") * 100).cast("long").alias("score"))
    return P.digest(e, ["event_type"], ["at", "user_id", "score"], "fingerprint")


def population_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the customers with orders of each priority relate to those with the first one."""
    o = table(spark, sf_dir, "orders")
    first = o.where("o_orderpriority = '1-URGENT' and o_orderkey % 2 = 0").select("o_custkey")
    out = None
    for name, rule in (("same", "o_orderpriority = '1-URGENT' and o_orderkey % 2 = 0"), ("wider", "o_orderpriority = '1-URGENT'"), ("other", "o_orderpriority = '5-LOW' and o_orderkey % 7 = 0"), ("narrower", "o_orderpriority = '1-URGENT' and o_orderkey % 4 = 0")):
        r = P.relation(first, o.where(rule).select("o_custkey"), ["o_custkey"]).withColumn("other", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


def set_disjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common rows of every pair of four row sets that a protocol declares disjoint."""
    o = table(spark, sf_dir, "orders")
    sets = {"train": o.where("o_orderkey % 10 < 5"), "validation": o.where("o_orderkey % 10 between 5 and 6"), "calibration": o.where("o_orderkey % 10 between 6 and 7"), "evaluation": o.where("o_orderkey % 10 > 7")}
    return P.disjoint({k: v.select("o_orderkey") for k, v in sets.items()}, ["o_orderkey"])


def declared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (part and supplier) that a declaration asks for against those that lines show."""
    li = table(spark, sf_dir, "lineitem").where("l_suppkey <= 3")
    produced = li.select(F.concat_ws("/", F.col("l_suppkey"), F.col("l_partkey") % 40).alias("run"))
    declared = table(spark, sf_dir, "supplier").where("s_suppkey < 3").select("s_suppkey").crossJoin(spark.range(44)).select(F.concat_ws("/", "s_suppkey", "id").alias("run"))
    return P.declared_and_produced(declared, produced, "run").groupBy("state").agg(F.count(F.lit(1)).alias("runs"), F.min("run").alias("first"))


def edition_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of three editions: those agreed on by how many have them, and conflicts."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("value"))
    editions = [o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 5 = 0").withColumn("value", F.when(F.col("o_orderkey") % 7 == 0, F.lit("?")).otherwise(F.col("value")))]
    good, bad = P.union_of_editions(editions, ["o_orderkey"], "value")
    return good.groupBy(F.lit("agreed").alias("state"), "editions").agg(F.count(F.lit(1)).alias("facts")).unionByName(bad.groupBy(F.lit("conflict").alias("state"), "editions").agg(F.count(F.lit(1)).alias("facts")))


FOLDS = [(date(1995, 1, 1), date(2002, 1, 1), (18, 6, 6, 6), 12), (date(1995, 1, 1), date(2001, 1, 1), (18, 6, 6, 6), 6)]


def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds by month arithmetic, with the rows and sessions that each segment holds."""
    folds = P.fold_table(spark, P.build_folds(*FOLDS[0]))
    rows = P.in_folds(panel(spark, sf_dir).select("session", "market"), "session", folds)
    return rows.groupBy("fold", "segment", "first", "stop").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("session").alias("sessions"))


def eligible_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of a protocol that a reference has with the very same segments."""
    a, b = (P.fold_table(spark, P.build_folds(*f)) for f in FOLDS)
    return P.eligible_folds(a, b.withColumn("fold", (F.col("fold") / 2).cast("int")).where("first <> '1999-01-01'").dropDuplicates(["fold", "segment"]))


def split_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each segment's calendar days with admitted rows of a market, and whether it suffices."""
    folds = P.fold_table(spark, P.build_folds(*FOLDS[0]))
    admitted = panel(spark, sf_dir).where("l_linenumber <= 2").select("market", "session").distinct()
    got = P.in_folds(admitted, "session", folds).groupBy("fold", "segment", "market", F.datediff("stop", "first").alias("days")).agg(F.count(F.lit(1)).alias("sessions"))
    return got.select("fold", "segment", "market", "days", "sessions", F.round(F.col("sessions") / F.col("days"), 7).alias("coverage"), (F.col("sessions") * 2 >= F.col("days")).alias("ready"))


def label_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest maturity of the labels each segment accepts, and those that mature after the segment's end."""
    folds = P.fold_table(spark, P.build_folds(*FOLDS[0]))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("session"), F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber") * 5).alias("matures"))
    rows = P.in_folds(li, "session", folds)
    return rows.groupBy("fold", "segment").agg(F.max(F.when(F.col("matures") < F.col("stop"), F.col("matures"))).alias("latest"), F.count_if(F.col("matures") >= F.col("stop")).alias("purged"))


def selection_causality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose chosen state was fitted on something later than the start of their evaluation: must be none for a sound campaign, here those that a late fit made."""
    folds = P.fold_table(spark, P.build_folds(*FOLDS[0]))
    ends = folds.where("segment = 'evaluation'").select("fold", F.col("first").alias("starts"))
    jobs = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("fold")).join(F.broadcast(ends), "fold")
    fit_end = F.date_add("starts", (F.pmod(F.col("s_suppkey") * 13, F.lit(50)) - 45).cast("int"))
    return jobs.withColumn("fit_end", fit_end).groupBy("fold").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("fit_end") >= F.col("starts")).alias("late"))


def selection_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of patience over each supplier's history of monthly mean discounts, replayed."""
    li = table(spark, sf_dir, "lineitem").where("l_suppkey < 40").withColumn("epoch", (F.year("l_shipdate") * 12 + F.month("l_shipdate")) - 1995 * 12)
    h = li.groupBy("l_suppkey", "epoch").agg(F.round(F.avg("l_discount"), 6).alias("score"))
    h = h.withColumn("epoch", F.row_number().over(P.Window.partitionBy("l_suppkey").orderBy("epoch")))
    return P.replayed_selection(h, ["l_suppkey"], "epoch", "score", 4)


def table_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table against itself with some zeros negative, some values one step off, and some rows gone."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("v"))
    other = c.where("c_custkey % 101 <> 0").withColumn("v", F.when(F.col("c_custkey") % 20 == 0, -F.col("v")).when(F.col("c_custkey") % 7 == 0, F.col("v") + 0.01).otherwise(F.col("v")))
    return P.bit_equal(c, other, ["c_custkey"])


def run_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' predictions by decision: the largest difference of each day, and whether it keeps the bound."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("day"), "value")
    other = e.select("event_id", (F.col("value") + F.when(F.col("event_id") % 997 == 0, 0.5).otherwise(1e-9)).alias("other"))
    return e.join(other, "event_id").groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.round(F.max(F.abs(F.col("value") - F.col("other"))), 6).alias("largest"), (F.max(F.abs(F.col("value") - F.col("other"))) <= 1e-6).alias("within"))


def market_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets dropped by window: the rows kept and removed."""
    p = panel(spark, sf_dir).withColumn("window", F.year("session"))
    dropped = spark.createDataFrame([(1996, "A"), (1997, "A"), (1997, "R")], "window int, market string")
    j = p.join(F.broadcast(dropped.withColumn("_gone", F.lit(True))), ["window", "market"], "left")
    return j.groupBy("window").agg(F.count_if(F.col("_gone").isNull()).alias("kept"), F.count("_gone").alias("removed"), F.countDistinct(F.when(F.col("_gone").isNull(), F.col("market"))).alias("markets"))


def budget_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against consumed budgets by model (supplier), null-safe, in both directions."""
    declared = table(spark, sf_dir, "supplier").where("s_suppkey % 9 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 5 + 590).alias("declared"))
    used = table(spark, sf_dir, "lineitem").where("l_suppkey % 11 <> 0").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("used"))
    j = declared.withColumn("_a", F.lit(1)).join(used.withColumn("_b", F.lit(1)), "s_suppkey", "full")
    state = F.when(F.col("_b").isNull(), "unused").when(F.col("_a").isNull(), "undeclared").when(F.col("declared").isNull(), "unbounded").when(F.col("used") > F.col("declared"), "over").otherwise("within")
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("models"))


_DIGEST = lambda body, keys, name: f"""
WITH h AS (SELECT {keys}, sha256(j) AS h FROM ({body})),
s AS (SELECT {keys}, count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)::HUGEINT) AS a, sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)::HUGEINT) AS b, sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)::HUGEINT) AS c FROM h GROUP BY ALL)
SELECT {keys}, sha256(n || ':' || a || ':' || b || ':' || c) AS {name} FROM s"""  # noqa: E731


def _folds_sql(index: int) -> str:
    rows = [f"({f['fold']}, '{s}', DATE '{f[s][0]}', DATE '{f[s][1]}')" for f in P.build_folds(*FOLDS[index]) for s in P.SEGMENTS]
    return f"folds(fold, segment, first, stop) AS (VALUES {', '.join(rows)})"


REGISTERED = {
    "prediction_admission": (prediction_admission, "SELECT count(*) AS rows, count(DISTINCT event_id) AS keys, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events"),
    "ordered_predictions": (ordered_predictions, "SELECT event_type, ts, event_id, value FROM events ORDER BY event_type, ts, event_id LIMIT 100"),
    "prediction_alignment": (
        prediction_alignment,
        """
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'xx' ELSE 'en' END AS lang, doc_id % 3 + quality * toxic AS fold, quality FROM labels),
j AS (SELECT p.doc_id IS NOT NULL AS aligned, d.lang IS NOT DISTINCT FROM p.lang AS same_lang, d.doc_id % 3 IS NOT DISTINCT FROM p.fold AS same_fold, quality FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id)
SELECT aligned, same_lang, same_fold, count(*) AS rows, CAST(sum(quality) AS BIGINT) AS positive FROM j GROUP BY ALL""",
    ),
    "row_digests": (row_digests, _DIGEST("""SELECT c_nationkey, '{"c_custkey":"' || c_custkey || '","c_mktsegment":"' || c_mktsegment || '"}' AS j FROM customer""", "c_nationkey", "digest")),
    "population_digest": (population_digest, "SELECT * FROM (VALUES ('base', true), ('moved', true), ('lost', false)) v(arm, same)"),
    "prediction_fingerprint": (
        prediction_fingerprint,
        _DIGEST("""SELECT event_type, '{"at":"' || epoch_us(ts) || '","user_id":"' || user_id || '","score":"' || CAST(round(value * 100) AS BIGINT) || '"}' AS j FROM events""", "event_type", "fingerprint"),
    ),
    "population_relation": (
        population_relation,
        """
WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0),
o AS (SELECT DISTINCT 'same' AS other, o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 UNION SELECT 'wider', o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION SELECT 'other', o_custkey FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderkey % 7 = 0 UNION SELECT 'narrower', o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 0),
n AS (SELECT DISTINCT other FROM o),
s AS (SELECT other, (SELECT count(*) FROM o WHERE o.other = n.other AND k IN (SELECT k FROM f)) AS common, (SELECT count(*) FROM f WHERE k NOT IN (SELECT k FROM o WHERE o.other = n.other)) AS left_only,
  (SELECT count(*) FROM o WHERE o.other = n.other AND k NOT IN (SELECT k FROM f)) AS right_only FROM n)
SELECT other, common, left_only, right_only, CASE WHEN left_only = 0 AND right_only = 0 THEN 'same' WHEN common = 0 THEN 'disjoint' WHEN left_only = 0 THEN 'within' WHEN right_only = 0 THEN 'contains' ELSE 'overlaps' END AS relation FROM s""",
    ),
    "set_disjunction": (
        set_disjunction,
        """
WITH s AS (SELECT 0 AS i, 'train' AS n, o_orderkey AS k FROM orders WHERE o_orderkey % 10 < 5 UNION SELECT 1, 'validation', o_orderkey FROM orders WHERE o_orderkey % 10 BETWEEN 5 AND 6
  UNION SELECT 2, 'calibration', o_orderkey FROM orders WHERE o_orderkey % 10 BETWEEN 6 AND 7 UNION SELECT 3, 'evaluation', o_orderkey FROM orders WHERE o_orderkey % 10 > 7),
p AS (SELECT DISTINCT a.i, a.n AS first, b.i AS j, b.n AS second FROM (SELECT DISTINCT i, n FROM s) a, (SELECT DISTINCT i, n FROM s) b WHERE a.i < b.i)
SELECT first, second, (SELECT count(*) FROM s x JOIN s y ON x.k = y.k WHERE x.i = p.i AND y.i = p.j) AS common FROM p""",
    ),
    "declared_runs": (
        declared_runs,
        """
WITH p AS (SELECT l_suppkey || '/' || l_partkey % 40 AS run, count(*) AS n FROM lineitem WHERE l_suppkey <= 3 GROUP BY ALL),
d AS (SELECT s_suppkey || '/' || k AS run FROM supplier, range(44) t(k) WHERE s_suppkey < 3),
j AS (SELECT coalesce(d.run, p.run) AS run, CASE WHEN p.run IS NULL THEN 'missing' WHEN d.run IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' END AS state FROM d FULL JOIN p ON d.run = p.run)
SELECT state, count(*) AS runs, min(run) AS first FROM j WHERE state IS NOT NULL GROUP BY ALL""",
    ),
    "edition_union": (
        edition_union,
        """
WITH e AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '?' ELSE o_orderstatus END FROM orders WHERE o_orderkey % 5 = 0),
g AS (SELECT k, count(*) AS editions, count(DISTINCT v) AS kinds FROM e GROUP BY ALL)
SELECT CASE WHEN kinds > 1 THEN 'conflict' ELSE 'agreed' END AS state, editions, count(*) AS facts FROM g GROUP BY ALL""",
    ),
    "walk_forward_folds": (
        walk_forward_folds,
        f"""
WITH RECURSIVE {PANEL_SQL}, f AS (SELECT 0 AS fold, DATE '1995-01-01' AS s UNION ALL SELECT fold + 1, CAST(s + INTERVAL 12 MONTH AS DATE) FROM f WHERE s + INTERVAL 48 MONTH <= DATE '2002-01-01'),
g AS (SELECT fold, segment, CAST(s + a * INTERVAL 1 MONTH AS DATE) AS first, CAST(s + b * INTERVAL 1 MONTH AS DATE) AS stop FROM f, (VALUES ('train', 0, 18), ('validation', 18, 24), ('calibration', 24, 30), ('evaluation', 30, 36)) v(segment, a, b))
SELECT fold, segment, first, stop, count(*) AS rows, count(DISTINCT session) AS sessions FROM g JOIN panel ON session >= first AND session < stop GROUP BY ALL""",
    ),
    "eligible_folds": (
        eligible_folds,
        f"""
WITH {_folds_sql(0)}, r AS (SELECT fold // 2 AS fold, segment, first, stop FROM (SELECT * FROM (VALUES {', '.join(f"({f['fold']}, '{s}', DATE '{f[s][0]}', DATE '{f[s][1]}')" for f in P.build_folds(*FOLDS[1]) if f['fold'] % 2 == 0 for s in P.SEGMENTS)}) v(fold, segment, first, stop)) WHERE first <> DATE '1999-01-01'),
m AS (SELECT f.fold, count(*) AS n FROM folds f JOIN r ON f.fold = r.fold AND f.segment = r.segment AND f.first = r.first AND f.stop = r.stop GROUP BY ALL)
SELECT CAST(fold AS INTEGER) AS fold FROM m WHERE n = 4""",
    ),
    "split_readiness": (
        split_readiness,
        f"""
WITH {_folds_sql(0)}, a AS (SELECT DISTINCT l_returnflag AS market, CAST(l_shipdate AS DATE) AS session FROM lineitem WHERE l_linenumber <= 2),
g AS (SELECT fold, segment, market, CAST(stop - first AS INTEGER) AS days, count(*) AS sessions FROM folds JOIN a ON session >= first AND session < stop GROUP BY ALL)
SELECT fold, segment, market, days, sessions, round(sessions / days, 7) AS coverage, sessions * 2 >= days AS ready FROM g""",
    ),
    "label_maturity": (
        label_maturity,
        f"""
WITH {_folds_sql(0)}, li AS (SELECT CAST(l_shipdate AS DATE) AS session, CAST(l_shipdate AS DATE) + l_linenumber * 5 AS matures FROM lineitem)
SELECT fold, segment, max(CASE WHEN matures < stop THEN matures END) AS latest, count(*) FILTER (matures >= stop) AS purged FROM folds JOIN li ON session >= first AND session < stop GROUP BY ALL""",
    ),
    "selection_causality": (
        selection_causality,
        f"""
WITH {_folds_sql(0)}, j AS (SELECT fold, first AS starts, first + CAST((s_suppkey * 13) % 50 - 45 AS INTEGER) AS fit_end FROM folds, supplier WHERE segment = 'evaluation' AND fold <= 3)
SELECT fold, count(*) AS jobs, count(*) FILTER (fit_end >= starts) AS late FROM j GROUP BY ALL""",
    ),
    "selection_replay": (
        selection_replay,
        """
WITH h AS (SELECT l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) AS m, round(avg(l_discount), 6) AS score FROM lineitem WHERE l_suppkey < 40 GROUP BY ALL),
e AS (SELECT l_suppkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY m) AS INTEGER) AS epoch, score FROM h),
b AS (SELECT *, score < coalesce(min(score) OVER (PARTITION BY l_suppkey ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e9) AS better FROM e),
l AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY l_suppkey ORDER BY epoch) AS last FROM b),
s AS (SELECT *, min(CASE WHEN epoch - last >= 4 THEN epoch END) OVER (PARTITION BY l_suppkey) AS stop FROM l)
SELECT l_suppkey, max(last) AS chosen, max(epoch) AS stopped, count(*) AS epochs FROM s WHERE stop IS NULL OR epoch <= stop GROUP BY ALL""",
    ),
    "table_equality": (
        table_equality,
        """
WITH c AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer)
SELECT count(*) FILTER (k % 101 <> 0 AND k % 20 <> 0 AND (k % 7 <> 0)) AS equal, count(*) FILTER (k % 101 <> 0 AND (k % 20 = 0 OR k % 7 = 0)) AS different, count(*) FILTER (k % 101 = 0) AS one_sided FROM c""",
    ),
    "run_difference": (
        run_difference,
        """
SELECT CAST(ts AS DATE) AS day, count(*) AS rows, round(max(CASE WHEN event_id % 997 = 0 THEN 0.5 ELSE 0.0 END)::DOUBLE, 6) AS largest, max(CASE WHEN event_id % 997 = 0 THEN 1 ELSE 0 END) = 0 AS within FROM events GROUP BY ALL""",
    ),
    "market_filter": (
        market_filter,
        f"""
WITH {PANEL_SQL}, r AS (SELECT CAST(year(session) AS INTEGER) AS "window", market, (year(session), market) IN ((1996, 'A'), (1997, 'A'), (1997, 'R')) AS gone FROM panel)
SELECT "window", count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS removed, count(DISTINCT market) FILTER (NOT gone) AS markets FROM r GROUP BY ALL""",
    ),
    "budget_differences": (
        budget_differences,
        """
WITH d AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 5 + 590 END AS declared FROM supplier WHERE s_suppkey % 9 <> 0),
u AS (SELECT l_suppkey AS k, count(*) AS used FROM lineitem WHERE l_suppkey % 11 <> 0 GROUP BY ALL)
SELECT CASE WHEN u.k IS NULL THEN 'unused' WHEN d.k IS NULL THEN 'undeclared' WHEN declared IS NULL THEN 'unbounded' WHEN used > declared THEN 'over' ELSE 'within' END AS state, count(*) AS models FROM d FULL JOIN u ON d.k = u.k GROUP BY ALL""",
    ),
}
