"""Queries that replay decisions: events' types are markets, days decisions; values mature some days later."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import replay as Y
from tidemark.operators import sequential as S
from tidemark.plans.panel import PANEL_SQL, panel
from tidemark.session import table


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id % 2 = 0").select("event_type", F.col("ts").cast("date").alias("day"), F.round(F.abs(F.col("value") - 50)).alias("score"), F.pmod("user_id", F.lit(7)).cast("double").alias("context"))
    return e.withColumn("matures", F.date_add("day", 2))


def regime_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radii of ninety percent from matured scores of the last nine days, weighted by how like their context is, and unweighted."""
    args = (_scores(spark, sf_dir), ["event_type"], "day", "matures", "score", "context", 9, 30, 0.9)
    a = Y.context_weighted(*args, 1.5)
    b = Y.context_weighted(*args, None)
    return a.join(b.select("event_type", "day", F.col("radius").alias("plain")), ["event_type", "day"])


def matured_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes published with the first decision of their market from their maturity on: by market how many, when late, and how many are pending."""
    e = table(spark, sf_dir, "events").where("event_id % 3 = 0").select("event_type", "event_id", (F.col("ts") + F.expr("interval 30 hours")).alias("matures"), "value")
    d = table(spark, sf_dir, "events").where("event_id % 17 = 0").select("event_type", F.col("ts").alias("at"))
    r = Y.published_rewards(d, e, "event_type", "at", "matures", ["event_id"])
    wait = F.unix_micros(F.col("published_at").cast("timestamp")) - F.unix_micros(F.col("matures").cast("timestamp"))
    return r.groupBy("event_type").agg(F.count("published_at").alias("published"), F.count_if(F.col("published_at").isNull()).alias("pending"), F.max(wait).alias("longest_us"), F.max("place").cast("long").alias("most_at_once"), F.round(F.sum(F.when(F.col("place") == 1, F.col("value"))), 4).alias("first_values"))


def feedback_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts of orders with lines as outcomes, repeats and unknown ones among them: cohorts by state."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("cohort"), F.col("o_orderkey").alias("row"))
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_linenumber <= 2")
    outcomes = li.select(F.col("o_orderdate").cast("date").alias("cohort"), (F.col("l_orderkey") + F.when(F.col("l_suppkey") == 5, 10_000_000).otherwise(0)).alias("row"), F.struct("l_shipdate", "l_linenumber", "l_partkey").alias("at"))
    s = Y.feedback_ledger(o, outcomes, "cohort", "row", "at", 11)
    return s.groupBy("state").agg(F.count(F.lit(1)).alias("cohorts"), F.sum("rows").alias("rows"), F.sum("taken").alias("taken"), F.sum("repeated").alias("repeated"), F.sum("unknown").alias("unknown"))


def reset_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of four warm-up and six decision sessions from drawn starts: how often each session is decided on."""
    e = table(spark, sf_dir, "events").where("event_id % 3 = 0").select("event_type", F.col("ts").cast("date").alias("day"))
    draws = spark.range(0, 40).select(F.col("id").alias("draw"), F.explode(F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))).alias("event_type")).withColumn("start", F.pmod(F.col("draw") * 7919 + F.length("event_type"), F.lit(30)))
    p = Y.episodes(e, "event_type", "day", draws, 4, 6)
    return p.groupBy("event_type", "day").agg(F.count_if("warm").alias("warm"), F.count_if(~F.col("warm")).alias("decided"))


def _trailing(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-4, 0)
    return df.select("event_type", "day", F.round(F.avg("value").over(w), 6).alias("mean"))


def _leaking(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-4, 1)
    return df.select("event_type", "day", F.round(F.avg("value").over(w), 6).alias("mean"))


def ledger_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trailing mean and one that looks a day ahead, each audited at two cut-offs with later values zeroed and made extreme."""
    d = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.round(F.avg("value"), 6).alias("value"))
    out = None
    for name, emit in (("trailing", _trailing), ("leaking", _leaking)):
        r = Y.ledger_audit(emit, d, "day", ["value"], ["event_type", "day"], ["2024-01-10", "2024-01-20"], {"zero": lambda c: F.lit(0.0), "extreme": lambda c: c * 1e6}).withColumn("plan", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


def prefix_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors after three hundred mentions of each type, resumed on a table that lost a row of one type and gained later ones."""
    e = table(spark, sf_dir, "events")
    stored = Y.prefix_digest(e.where("event_id < 6000"), ["event_type"], ["ts", "event_id"], ["event_id", "user_id"], 60)
    found = Y.prefix_digest(e.where("not (event_type = 'view' and event_id < 40)"), ["event_type"], ["ts", "event_id"], ["event_id", "user_id"], 60)
    return Y.resumable(stored, found, ["event_type"])


PIPES = ["identity", "scale 0.5", "scale 0.5 | clip 0.01", "silence 0.015", "shift 0.005 | silence 0.02"]


def output_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared programs over the prediction, each scored per market."""
    p = panel(spark, sf_dir)
    rows = p.select("market", "target", F.explode(F.array(*[F.struct(F.lit(t).alias("program"), Y.program(t, F.col("prediction")).alias("p")) for t in PIPES])).alias("x")).select("market", "target", "x.*")
    return rows.groupBy("program", "market").agg(F.round(F.avg(F.abs(F.col("target") - F.col("p"))), 9).alias("mae"), F.count_if(F.round("p", 9) == 0).alias("silent"))


def permuted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments dealt anew: as many of each, elsewhere."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    p = Y.permuted_labels(c, "c_custkey", "c_mktsegment", "31").withColumnRenamed("c_mktsegment", "dealt")
    return c.join(p, "c_custkey").groupBy("c_mktsegment", "dealt").agg(F.count(F.lit(1)).alias("customers"), F.min("c_custkey").alias("first"))


def episodic_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store of ten episodes a user holds in the end."""
    e = Y.bounded_write(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 10)
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("held"), F.min("ts").alias("oldest"), F.round(F.sum("value"), 6).alias("total"))


MATRIX = [[(i * 7 + j * 13 + i * j) % 3 - 1 for j in range(64)] for i in range(4)]


def projection_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of unit length times a fixed matrix of four rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", Y.projected(F.col("embedding"), MATRIX).alias("p"))
    return e.select("vec_id", *[F.round(F.get("p", F.lit(i)), 5).alias(f"p{i}") for i in range(4)])


def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked vectors of customers' figures, some broken by rule: rows by their problems."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    values = F.array(F.col("c_acctbal"), F.when(k % 5 == 0, F.lit(float("inf"))).otherwise(0.0), F.when(k % 7 == 0, 1.0).otherwise(0.0))
    mask = F.when(k % 11 == 0, F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.when(k % 13 == 0, 0.5).otherwise(1.0), F.lit(0.0)))
    return c.groupBy(F.array_join(Y.vector_problems(values, mask), "+").alias("problems")).agg(F.count(F.lit(1)).alias("rows"))


def modality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three modalities of which one or two go where a rule says so: presence and reasons."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("news"), F.col("o_orderpriority").alias("facts")).alias("m"), F.array().cast("array<string>").alias("reasons"))
    a = Y.without_modality(o, "m", ["news"], F.col("o_orderkey") % 2 == 0, "burst")
    a = Y.without_modality(a, "m", ["price", "facts"], F.col("o_orderkey") % 5 == 0, "lesion")
    return a.groupBy("present", F.array_join("reasons", "+").alias("reasons")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("m.price"), 2).alias("price"), F.count("m.news").alias("news"))


def signed_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each further refinement of the prediction gains over the first, by market."""
    p = panel(spark, sf_dir)
    steps = F.array(F.col("prediction"), F.col("prediction") * 0.7, F.col("prediction") * 0.3, F.lit(0.0))
    gains = F.transform(steps, lambda x: F.abs(F.col("target") - F.get(steps, F.lit(0))) - F.abs(F.col("target") - x))
    return p.select("market", F.posexplode(gains).alias("step", "gain")).groupBy("market", "step").agg(F.round(F.avg("gain"), 9).alias("gain"), F.count_if(F.round("gain", 9) > 0).alias("better"))


def prefix_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored proofs of why a user-day is eligible (past pairs, a next session), some falsified, recomputed and compared."""
    d = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy("day")
    proof = d.select("user_id", "day", (F.count(F.lit(1)).over(w.rowsBetween(-10, -1))).alias("pairs"), F.lead("day").over(w).alias("next"))
    proof = proof.withColumn("eligible", (F.col("pairs") >= 5) & F.col("next").isNotNull())
    stored = proof.withColumn("stored", F.when(F.col("user_id") % 10 == 3, F.col("pairs") + 1).otherwise(F.col("pairs")))
    return stored.groupBy("eligible", (F.col("stored").eqNullSafe(F.col("pairs"))).alias("proved")).agg(F.count(F.lit(1)).alias("decisions"), F.sum("pairs").alias("pairs"))


def conformal_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections per type where some days' cohorts are cancelled: they retire without an update."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        machine, out, before = S.OnlineConformal(0.5, 0.9), [], None
        for r in rows.itertuples(index=False):
            if before is not None:
                if before[0]:
                    machine.cancel()
                else:
                    machine.mature([before[1]])
            out.append((r.event_type, r.day, round(machine.emit(30.0), 6)))
            before = (r.cancelled, r.error)
        return pd.DataFrame(out, columns=["event_type", "day", "radius"])

    e = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.round(F.abs(F.avg("value") - 20), 6).alias("error"))
    e = e.withColumn("cancelled", F.dayofmonth("day") % 3 == 0)
    return S.per_key(e, ["event_type"], ["day"], run, "event_type string, day date, radius double")


def window_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed radius and one refitted on the five days before, by type: sessions, coverage and width."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("date").alias("day"), F.round(F.abs(F.col("value") - 50)).alias("error"))
    fitted = Y.context_weighted(e.withColumn("matures", F.date_add("day", 1)).withColumn("c", F.lit(0.0)), ["event_type"], "day", "matures", "error", "c", 5, 50, 0.9, None)
    j = e.join(fitted.select("event_type", "day", "radius"), ["event_type", "day"])
    v = j.select("event_type", "day", "error", F.explode(F.array(F.struct(F.lit("static").alias("variant"), F.lit(100.0).alias("r")), F.struct(F.lit("refitted").alias("variant"), F.col("radius").alias("r")))).alias("v")).select("event_type", "day", "error", "v.*")
    s = v.groupBy("variant", "event_type", "day").agg(F.avg((F.col("error") <= F.col("r")).cast("double")).alias("c"), F.avg(2 * F.col("r")).alias("w"))
    return s.groupBy("variant", "event_type").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg("c"), 9).alias("coverage"), F.round(F.avg("w"), 6).alias("width"))


_SCORES = """s AS (SELECT event_type, CAST(ts AS DATE) AS day, round(abs(value - 50)) AS score, CAST(user_id % 7 AS DOUBLE) AS context FROM events WHERE event_id % 2 = 0),
a AS (SELECT event_type, day, avg(context) AS own FROM s GROUP BY ALL),
j AS (SELECT a.event_type, a.day, s.score, exp(-0.5 * ((s.context - own) / 1.5) * ((s.context - own) / 1.5)) AS w FROM a JOIN s ON s.event_type = a.event_type AND s.day + 2 <= a.day AND s.day + 9 >= a.day)"""


def _quantile_sql(weight: str, name: str) -> str:
    return f"""{name} AS (SELECT event_type, day, CAST(max(n) AS BIGINT) AS n, min(score) AS radius FROM (SELECT event_type, day, score, sum({weight}) OVER (PARTITION BY event_type, day ORDER BY score) AS c, sum({weight}) OVER (PARTITION BY event_type, day) AS t,
  count(*) OVER (PARTITION BY event_type, day) AS n FROM j) WHERE n >= 30 AND c >= 0.9 * t - 1e-9 GROUP BY ALL)"""


_DOT = lambda row: " + ".join(f"{m} * embedding[{j + 1}]::DOUBLE" for j, m in enumerate(row) if m)


REGISTERED = {
    "regime_weighted": (
        regime_weighted,
        f"WITH {_SCORES}, {_quantile_sql('w', 'x')}, {_quantile_sql('1.0', 'y')} SELECT x.event_type, x.day, x.n, x.radius, y.radius AS plain FROM x JOIN y ON y.event_type = x.event_type AND y.day = x.day",
    ),
    "matured_rewards": (
        matured_rewards,
        """
WITH e AS (SELECT event_type, event_id, ts + INTERVAL 30 HOUR AS m, value FROM events WHERE event_id % 3 = 0), d AS (SELECT DISTINCT event_type, ts AS t FROM events WHERE event_id % 17 = 0),
p AS (SELECT e.*, (SELECT min(t) FROM d WHERE d.event_type = e.event_type AND t >= m) AS published FROM e),
r AS (SELECT *, CASE WHEN published IS NOT NULL THEN row_number() OVER (PARTITION BY event_type, published ORDER BY m, event_id) END AS place FROM p)
SELECT event_type, count(published) AS published, count(*) FILTER (published IS NULL) AS pending, max(epoch_us(published) - epoch_us(m)) AS longest_us, max(place) AS most_at_once, round(sum(value) FILTER (place = 1), 4) AS first_values FROM r GROUP BY ALL""",
    ),
    "feedback_ledger": (
        feedback_ledger,
        """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS c, o_orderkey AS k FROM orders), l AS (SELECT CAST(o_orderdate AS DATE) AS c, l_orderkey + CASE WHEN l_suppkey = 5 THEN 10000000 ELSE 0 END AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 2),
g AS (SELECT c, k, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT c, count(*) AS rows FROM o GROUP BY ALL),
s AS (SELECT c, count(*) FILTER (o.k IS NOT NULL) AS taken, sum(CASE WHEN o.k IS NOT NULL THEN n - 1 ELSE 0 END) AS repeated, sum(CASE WHEN o.k IS NULL THEN n ELSE 0 END) AS unknown FROM g LEFT JOIN o USING (c, k) GROUP BY ALL),
t AS (SELECT r.c, rows, coalesce(taken, 0) AS taken, coalesce(repeated, 0) AS repeated, coalesce(unknown, 0) AS unknown FROM r LEFT JOIN s ON s.c = r.c)
SELECT CASE WHEN rows > 11 THEN 'over_limit' WHEN taken = 0 THEN 'empty' WHEN taken < rows THEN 'partial' ELSE 'complete' END AS state, count(*) AS cohorts, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(taken) AS BIGINT) AS taken, CAST(sum(repeated) AS BIGINT) AS repeated, CAST(sum(unknown) AS BIGINT) AS unknown FROM t GROUP BY ALL""",
    ),
    "reset_windows": (
        reset_windows,
        """
WITH p AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events WHERE event_id % 3 = 0)),
d AS (SELECT DISTINCT i, event_type, (i * 7919 + length(event_type)) % 30 AS start FROM range(40) t(i), (SELECT DISTINCT event_type FROM events)),
s AS (SELECT d.event_type, start + k AS place, k < 4 AS warm FROM d, range(10) u(k) WHERE start + 10 <= (SELECT max(n) FROM p WHERE p.event_type = d.event_type))
SELECT p.event_type, day, count(*) FILTER (warm) AS warm, count(*) FILTER (NOT warm) AS decided FROM s JOIN p ON p.event_type = s.event_type AND p.place = s.place GROUP BY ALL""",
    ),
    "ledger_audit": (
        ledger_audit,
        """
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day FROM events GROUP BY ALL), c(cutoff) AS (VALUES ('2024-01-10'), ('2024-01-20')), a(alteration) AS (VALUES ('again'), ('zero'), ('extreme')), p(plan) AS (VALUES ('trailing'), ('leaking')),
n AS (SELECT cutoff, count(*) AS emitted, count(DISTINCT event_type) FILTER (EXISTS (SELECT 1 FROM d x WHERE x.event_type = d.event_type AND x.day > CAST(cutoff AS DATE))) AS last FROM d, c WHERE day <= CAST(cutoff AS DATE) GROUP BY ALL)
SELECT plan, n.cutoff, alteration, emitted, CASE WHEN plan = 'leaking' AND alteration <> 'again' THEN last ELSE 0 END AS changed FROM n, a, p""",
    ),
    "prefix_cursors": (prefix_cursors, "SELECT DISTINCT event_type, CASE WHEN event_type = 'view' AND EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'view' AND x.event_id < 40) THEN 'refused' ELSE 'resumes' END AS state FROM events"),
    "output_programs": (
        output_programs,
        f"""
WITH {PANEL_SQL}, x AS (SELECT market, target AS y, 'identity' AS program, prediction AS p FROM panel UNION ALL SELECT market, target, 'scale 0.5', prediction * 0.5 FROM panel
  UNION ALL SELECT market, target, 'scale 0.5 | clip 0.01', greatest(least(prediction * 0.5, 0.01), -0.01) FROM panel UNION ALL SELECT market, target, 'silence 0.015', CASE WHEN round(abs(prediction), 9) <= 0.015 THEN 0 ELSE prediction END FROM panel
  UNION ALL SELECT market, target, 'shift 0.005 | silence 0.02', CASE WHEN round(abs(prediction + 0.005), 9) <= 0.02 THEN 0 ELSE prediction + 0.005 END FROM panel)
SELECT program, market, round(avg(abs(y - p)), 9) AS mae, count(*) FILTER (round(p, 9) = 0) AS silent FROM x GROUP BY ALL""",
    ),
    "permuted_regions": (
        permuted_regions,
        """
WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY sha256('31:' || c_custkey)) AS i FROM customer), l AS (SELECT c_mktsegment AS dealt, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS i FROM customer)
SELECT c_mktsegment, dealt, count(*) AS customers, min(c_custkey) AS first FROM r JOIN l USING (i) GROUP BY ALL""",
    ),
    "episodic_write": (
        episodic_write,
        """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, count(*) AS held, min(ts) AS oldest, round(sum(value), 6) AS total FROM r WHERE r <= 10 GROUP BY ALL""",
    ),
    "projection_codec": (
        projection_codec,
        f"""
WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n, {', '.join(f'({_DOT(row)}) AS d{i}' for i, row in enumerate(MATRIX))} FROM embeddings)
SELECT vec_id, {', '.join(f'round(d{i} / n, 5) AS p{i}' for i in range(4))} FROM n""",
    ),
    "vector_validation": (
        vector_validation,
        """
WITH p AS (SELECT concat_ws('+', CASE WHEN c_custkey % 11 = 0 THEN 'length' END, CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 13 = 0 THEN 'mask' END, CASE WHEN c_custkey % 5 = 0 THEN 'not_finite' END,
  CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 7 = 0 THEN 'filled' END) AS problems FROM customer)
SELECT problems, count(*) AS rows FROM p GROUP BY ALL""",
    ),
    "modality_ablation": (
        modality_ablation,
        """
WITH m AS (SELECT o_orderkey % 2 = 0 AS b, o_orderkey % 5 = 0 AS l, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 2 <> 0 THEN o_orderstatus END AS news FROM orders)
SELECT CAST(CASE WHEN l THEN 0 ELSE 2 END + CASE WHEN news IS NULL THEN 0 ELSE 1 END AS INTEGER) AS present, concat_ws('+', CASE WHEN b THEN 'burst' END, CASE WHEN l THEN 'lesion' END) AS reasons, count(*) AS rows, round(sum(price), 2) AS price, count(news) AS news FROM m GROUP BY ALL""",
    ),
    "signed_gains": (
        signed_gains,
        f"""
WITH {PANEL_SQL}, g AS (SELECT market, step, abs(target - prediction) - abs(target - prediction * f) AS gain FROM panel, (VALUES (0, 1.0::DOUBLE), (1, 0.7), (2, 0.3), (3, 0.0)) v(step, f))
SELECT market, step, round(avg(gain), 9) AS gain, count(*) FILTER (round(gain, 9) > 0) AS better FROM g GROUP BY ALL""",
    ),
    "prefix_eligibility": (
        prefix_eligibility,
        """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
p AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS pairs, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS next FROM d)
SELECT pairs >= 5 AND next IS NOT NULL AS eligible, user_id % 10 <> 3 AS proved, count(*) AS decisions, CAST(sum(pairs) AS BIGINT) AS pairs FROM p GROUP BY ALL""",
    ),
    "conformal_cancel": (
        conformal_cancel,
        """
WITH RECURSIVE d AS (SELECT event_type, day, error, dayofmonth(day) % 3 = 0 AS x, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM (SELECT event_type, CAST(ts AS DATE) AS day, round(abs(avg(value) - 20), 6) AS error FROM events GROUP BY ALL)),
r AS (SELECT event_type, i, day, 0.0::DOUBLE AS c, error, x FROM d WHERE i = 1 UNION ALL
  SELECT d.event_type, d.i, d.day, r.c + CASE WHEN r.x THEN 0 ELSE 0.5 * (CASE WHEN r.error > 30 + r.c THEN 1 ELSE 0 END - 0.1::DOUBLE) END, d.error, d.x FROM r JOIN d ON d.event_type = r.event_type AND d.i = r.i + 1)
SELECT event_type, day, round(30 + c, 6) AS radius FROM r""",
    ),
    "window_calibration": (
        window_calibration,
        """
WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, round(abs(value - 50)) AS error FROM events), a AS (SELECT DISTINCT event_type, day FROM e),
j AS (SELECT a.event_type, a.day, e.error, row_number() OVER (PARTITION BY a.event_type, a.day ORDER BY error) AS i, count(*) OVER (PARTITION BY a.event_type, a.day) AS n FROM a JOIN e ON e.event_type = a.event_type AND e.day + 1 <= a.day AND e.day + 5 >= a.day),
f AS (SELECT event_type, day, min(error) AS r FROM j WHERE n >= 50 AND i >= 0.9 * n - 1e-9 GROUP BY ALL),
v AS (SELECT 'static' AS variant, e.*, 100.0::DOUBLE AS r FROM e JOIN f USING (event_type, day) UNION ALL SELECT 'refitted', e.*, r FROM e JOIN f USING (event_type, day)),
s AS (SELECT variant, event_type, day, avg(CASE WHEN error <= r THEN 1.0 ELSE 0.0 END) AS c, avg(2 * r) AS w FROM v GROUP BY ALL)
SELECT variant, event_type, count(*) AS sessions, round(avg(c), 9) AS coverage, round(avg(w), 6) AS width FROM s GROUP BY ALL""",
    ),
}
