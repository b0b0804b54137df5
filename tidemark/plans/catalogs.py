"""Queries over registries: documents are records of files (sources), customers entries of a registry, pages articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators import catalogs as K
from tidemark.session import instants, table


def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the assets that they belong to: files, records and characters by asset; files without an asset are named."""
    files = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("n_chars").alias("chars"))
    assets = spark.createDataFrame([(f"src{i}", f"asset{i % 4}") for i in range(15)], "source string, asset string")
    return files.join(F.broadcast(assets), "source", "left").groupBy(F.coalesce("asset", F.lit("unknown")).alias("asset")).agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"), F.sum("chars").alias("chars"))


def registry_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their file and its asset (lines, orders, customers) in one plan, by segment and state."""
    li, o, c = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("o_orderkey").alias("files"), F.countDistinct("c_custkey").alias("assets"))


def record_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by (file, ordinal), asked for by a table of keys; keys without a record come back empty."""
    asked = spark.range(0, 200).select((F.col("id") * 37 % 1500).alias("l_orderkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber")).distinct()
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return asked.join(li, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", F.coalesce("records", F.lit(0)).alias("records"), "quantity")


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with changes taken in, the latest of a key's: entries by state."""
    base = table(spark, sf_dir, "customer").select("c_custkey", F.lit("pending").alias("state"), F.lit(0).cast("long").alias("version"))
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 100 == 0, 1_000_000).otherwise(0)).alias("c_custkey"), F.col("o_orderstatus").alias("state"), F.col("o_orderkey").alias("version"))
    return K.upserted(base, o, ["c_custkey"], "version").groupBy("state").agg(F.count(F.lit(1)).alias("entries"), F.max("version").alias("latest"))


def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each priority's least recently used orders that go until the rest fits its budget."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey", F.round("o_totalprice").cast("long").alias("size"))
    e = K.evicted(o, ["o_orderpriority"], "o_orderdate", "size", "o_orderkey", 40_000_000)
    return e.groupBy("o_orderpriority", "kept").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("size"), F.min("o_orderdate").alias("oldest"))


def worker_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in order, every fourth to the same worker."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    n = K.numbered(c, F.substring("c_name", 1, 16), ["c_name"], "place")
    return n.groupBy(F.pmod("place", F.lit(4)).alias("worker")).agg(F.count(F.lit(1)).alias("paths"), F.min("c_name").alias("first"), F.sum("c_custkey").alias("keys"))


def bounded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty lines of each market by the smallest hash: a reservoir that doesn't depend on the order of reading, with its median."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))
    h = F.sha2(F.concat_ws(":", F.lit("9"), F.col("l_orderkey").cast("string")).cast("binary"), 256)
    s = K.bottom_k(li, ["l_returnflag"], h, 40)
    return s.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("keys"), F.percentile("quantity", 0.5).alias("median"))


def candidate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that a publisher may have for pages, theirs and a syndicator's, made from the pages' numbers."""
    p = table(spark, sf_dir, "pages").select("page_id")
    k = F.col("page_id")
    url = F.when(k % 5 == 0, F.concat(F.lit("https://www.publisher.example/a/"), k)).when(k % 5 == 1, F.concat(F.lit("http://www.publisher.example/a/"), k)).when(k % 5 == 2, F.concat(F.lit("https://feed.example/articles/some-title-"), k, F.lit("-2019-05-0"), k % 9 + 1)).when(k % 5 == 3, F.concat(F.lit("https://feed.example/Articles/x"), k)).otherwise(F.concat(F.lit("https://feed.example/articles/T-"), k))
    day = F.concat((2018 + k % 4).cast("string"), F.lit("-05-0"), k % 9 + 1)
    body = F.when(k % 3 == 0, "text").otherwise("by The Publisher, text")
    return p.select("page_id", F.array_join(K.candidate_urls(url, body, day, "www.publisher.example", "feed.example", "The Publisher", "investing"), " ").alias("urls"))


def reviewed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to the spans of a review of their record, found by the record's hash."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", C.record_hash(F.col("text")).alias("hash"))
    spans = F.array(F.struct(F.lit(0).alias("first"), F.lit(10).alias("stop")), F.struct(F.lit(20).alias("first"), F.lit(35).alias("stop")))
    reviews = d.where("doc_id % 6 = 0").select("hash", spans.alias("spans")).dropDuplicates(["hash"])
    j = d.join(reviews, "hash", "left").withColumn("body", F.when(F.col("spans").isNotNull(), K.kept_text(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return j.groupBy(F.col("spans").isNotNull().alias("reviewed")).agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("body")).alias("chars"), F.min("body").alias("least"))


def editorial_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' titles with a planted promotion and notice, which go."""
    p = table(spark, sf_dir, "pages").select("page_id")
    text = F.concat(F.lit("Body "), F.col("page_id"), F.when(F.col("page_id") % 3 == 0, " *Offer starts* buy now *Offer ends* more").otherwise(""), F.when(F.col("page_id") % 4 == 0, " The writer owns shares. ").otherwise(" end"), F.when(F.col("page_id") % 8 == 0, "The writer owns shares.").otherwise(""))
    e = K.editorial(text, r"\*Offer starts\*[^*]*\*Offer ends\*", r"The writer owns shares\.")
    return p.select("page_id", e.alias("e")).select("page_id", "e.body", F.col("e.promotions").cast("int").alias("promotions"), "e.notice")


def article_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records against evidence of the same documents, altered by rule, by the state that decides."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text"), F.substring("text", 1, 12).alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 20).cast("int")).alias("day"))
    k = F.col("doc_id")
    t = C.tokens(F.col("text"))
    other = F.when(k % 5 == 1, F.slice(t, 1, 3)).when(k % 5 == 2, F.concat(F.array(F.lit("x")), t)).when(k % 5 == 3, F.concat(t, F.array(F.lit("y")))).otherwise(t)
    state = K.article_state(k % 11 != 0, F.col("title"), F.when(k % 13 == 0, None).when(k % 7 == 0, "Another").otherwise(F.col("title")), F.col("day"), F.when(k % 17 != 0, F.col("day")), t, other)
    return d.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("records"))


def _reasons():
    return F.filter(F.array(F.when(F.col("text").isNull() | (F.col("text") == ""), "missing_content"), F.when(F.col("lang").isNull() | (F.col("lang") == "fr"), "reserved_language"), F.when(F.col("n_chars") < 40, "too_short")), lambda x: x.isNotNull())


def news_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents accepted into a cohort, the first of equal texts, and those excluded, by reason."""
    good, bad = K.cohort(table(spark, sf_dir, "documents"), _reasons(), ["text"], ["doc_id"])
    a = good.groupBy(F.lit("accepted").alias("reason")).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("source").alias("sources"))
    return a.unionByName(bad.groupBy(F.array_join("reasons", "+").alias("reason")).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("source").alias("sources")))


def news_panel_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and excluded records by language, by state and in all, which reconcile."""
    d = table(spark, sf_dir, "documents").withColumn("state", F.when(F.size(_reasons()) == 0, "accepted").otherwise(F.get(_reasons(), F.lit(0))))
    g = d.groupingSets([["lang"], ["state"], []], "lang", "state").agg(F.count(F.lit(1)).alias("records"), F.grouping_id("lang", "state").alias("level"))
    return g.select("lang", "state", "records", F.col("level").cast("int").alias("level"))


def cohort_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next thirty customers whose preparation isn't confirmed by an order of a late year."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    done = table(spark, sf_dir, "orders").where("year(o_orderdate) >= 2000").select(F.col("o_custkey").alias("c_custkey"))
    return K.pending(c, done, "c_custkey", 30)


def edition_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations replaced by a new edition where it agrees with its records, by state, with what the edition then holds."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.lit("old").alias("edition"))
    new = c.where("c_nationkey < 15").withColumn("edition", F.lit("new"))
    records = c.where("c_nationkey between 3 and 20").groupBy("c_nationkey").agg((F.count(F.lit(1)) + F.when(F.col("c_nationkey") % 4 == 0, 1).otherwise(0)).alias("rows"))
    edition, states = K.substituted(c, new, records, ["c_nationkey"])
    rows = edition.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("edition") == "new").alias("new_rows"))
    return rows.join(states, "c_nationkey", "left").select("c_nationkey", "rows", "new_rows", F.coalesce("state", F.lit("untouched")).alias("state"))


def observed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with any accepted or excluded row by market, and those with excluded ones only."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("market"), F.col("l_shipdate").cast("date").alias("session"), (F.col("l_quantity") <= 5).alias("excluded"))
    s = li.groupBy("market", "session").agg(F.count_if(~F.col("excluded")).alias("accepted"))
    return s.groupBy("market", F.year("session").alias("year")).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("accepted") == 0).alias("excluded_only"))


def fact_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' totals against reviewed figures in other units, by what the review says."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("raw"), F.col("o_orderdate").cast("date").alias("period"))
    k = F.col("o_orderkey")
    multiplier = F.when(k % 6 == 0, 1).when(k % 6 == 5, 500).otherwise(1000).cast("decimal(12,0)")
    reported = F.when(k % 6 == 0, F.col("raw").cast("decimal(24,6)")).when(k % 6 == 4, F.col("raw") / 1000 + 7).otherwise(F.round(F.col("raw") / 1000, 0)).cast("decimal(24,6)")
    state = K.reconciliation(F.col("raw"), reported, multiplier, F.col("period"), F.when(k % 10 != 9, F.col("period")).otherwise(F.date_add("period", 1)), F.when(k % 14 != 0, F.date_add("period", 30)), k % 3 != 1)
    return o.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("facts"))


def balance_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by customer's nation and order year, with an order-free fingerprint of each cell's records."""
    from tidemark.operators.populations import digest

    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_nationkey < 6")
    j = j.select("c_nationkey", F.year("o_orderdate").alias("year"), "l_orderkey", "l_linenumber")
    return digest(j, ["c_nationkey", "year"], ["l_orderkey", "l_linenumber"], "fingerprint").join(j.groupBy("c_nationkey", "year").agg(F.count(F.lit(1)).alias("records")), ["c_nationkey", "year"])


def accounting_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census of customers with reviewed figures added where there are any; nobody is dropped."""
    r = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderpriority = '2-HIGH'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("facts"), F.max("o_orderdate").alias("latest"))
    j = table(spark, sf_dir, "customer").join(r, "c_custkey", "left")
    return j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("assets"), F.count("facts").alias("enriched"), F.sum("facts").alias("facts"), F.max("latest").alias("latest"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one day: the equality reaches the scan and prunes row groups by their statistics."""
    return table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") == F.lit("1997-03-05").cast("timestamp_ntz")).select("l_orderkey", "l_linenumber", "l_quantity")


def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an inclusive range in (instant, id) order."""
    e = table(spark, sf_dir, "events").where(F.col("ts").between(F.lit("2024-01-05 06:00:00").cast("timestamp_ntz"), F.lit("2024-01-05 18:00:00").cast("timestamp_ntz")))
    return e.orderBy("ts", "event_id").select("event_id", "ts", "value")


def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before a cut, per type: only the columns asked for are read."""
    return table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("last"))


def cohort_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the rows: per market and session rows, assets, and bounds of availability and maturity."""
    e = table(spark, sf_dir, "events").withColumn("matures", F.col("ts") + F.expr("interval 3 days"))
    return e.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("assets"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("matures").alias("mature"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 31 == 0, F.lit(float("inf"))).when(F.col("event_id") % 37 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return e.select(F.col("event_type").alias("metric"), F.pmod("user_id", F.lit(4)).alias("group"), F.floor(F.col("event_id") / 50).alias("step"), F.col("event_id").alias("part"), value.alias("value"))


def trace_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces as ordered series: lengths, first and last steps, values that aren't finite, and the sum of the others."""
    s = K.trace_series(_steps(spark, sf_dir), ["metric", "group"], "step", "part", "value")
    v = F.transform("series", lambda x: x["value"])
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.when(F.isnan(x), 0.0).otherwise(x))
    return s.select("metric", "group", F.size("series").alias("steps"), F.get("series", F.lit(0))["step"].alias("first"), F.element_at("series", -1)["step"].alias("last"), F.size(F.filter(v, lambda x: F.isnan(x))).alias("odd"), F.round(total, 4).alias("total"))


def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last, best and median of each trace, and its share of finite values."""
    return K.trace_summary(_steps(spark, sf_dir), ["metric", "group"], "part", "value")


def vendor_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vendor's nested arrays of (date digits, close), read by a declared schema: days and closes by year; rows that break it are counted."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.concat(F.lit("["), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(","), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"), F.lit("]")))).alias("k"))
    body = F.when(F.col("o_custkey") % 9 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"kline":['), F.array_join("k", ","), F.lit("]}")))
    p = o.select("o_custkey", F.from_json(body, "kline array<array<string>>").alias("p"))
    r = p.select("o_custkey", F.explode_outer("p.kline").alias("r")).select(F.try_to_date(F.get("r", F.lit(0)), "yyyyMMdd").alias("day"), F.get("r", F.lit(1)).cast("double").alias("close"))
    return r.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("close"), 2).alias("total"))


_REASONS = "concat_ws('+', CASE WHEN text IS NULL OR text = '' THEN 'missing_content' END, CASE WHEN lang IS NULL OR lang = 'fr' THEN 'reserved_language' END, CASE WHEN n_chars < 40 THEN 'too_short' END)"
_STEPS = """s AS (SELECT event_type AS metric, user_id % 4 AS "group", event_id // 50 AS step, event_id AS part, CASE WHEN event_id % 31 = 0 THEN 'inf'::DOUBLE WHEN event_id % 37 = 0 THEN 'nan'::DOUBLE ELSE value END AS value FROM events)"""


REGISTERED = {
    "catalog_join": (
        catalog_join,
        """
WITH f AS (SELECT source, count(*) AS records, sum(n_chars) AS chars FROM documents GROUP BY ALL), a AS (SELECT 'src' || i AS source, 'asset' || i % 4 AS asset FROM range(15) t(i))
SELECT coalesce(asset, 'unknown') AS asset, count(*) AS files, CAST(sum(records) AS BIGINT) AS records, CAST(sum(chars) AS BIGINT) AS chars FROM f LEFT JOIN a ON a.source = f.source GROUP BY ALL""",
    ),
    "registry_join": (
        registry_join,
        "SELECT c_mktsegment, o_orderstatus, count(*) AS records, count(DISTINCT o_orderkey) AS files, count(DISTINCT c_custkey) AS assets FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    ),
    "record_lookup": (
        record_lookup,
        """
WITH a AS (SELECT DISTINCT i * 37 % 1500 AS k, CAST(i % 7 + 1 AS INTEGER) AS n FROM range(200) t(i)), l AS (SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS records, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL)
SELECT a.k AS l_orderkey, a.n AS l_linenumber, coalesce(records, 0) AS records, quantity FROM a LEFT JOIN l ON l.k = a.k AND l.n = a.n""",
    ),
    "registry_upsert": (
        registry_upsert,
        """
WITH o AS (SELECT o_custkey + CASE WHEN o_orderkey % 100 = 0 THEN 1000000 ELSE 0 END AS k, arg_max(o_orderstatus, o_orderkey) AS state, max(o_orderkey) AS version FROM orders GROUP BY ALL),
u AS (SELECT state, version FROM o UNION ALL SELECT 'pending', 0 FROM customer WHERE c_custkey NOT IN (SELECT k FROM o))
SELECT state, count(*) AS entries, max(version) AS latest FROM u GROUP BY ALL""",
    ),
    "cache_eviction": (
        cache_eviction,
        """
WITH o AS (SELECT o_orderpriority, o_orderdate, CAST(round(o_totalprice) AS BIGINT) AS size, sum(CAST(round(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) <= 40000000 AS kept FROM orders)
SELECT o_orderpriority, kept, count(*) AS entries, CAST(sum(size) AS BIGINT) AS size, min(o_orderdate) AS oldest FROM o GROUP BY ALL""",
    ),
    "worker_stripes": (
        worker_stripes,
        """
WITH n AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name) - 1 AS place FROM customer)
SELECT place % 4 AS worker, count(*) AS paths, min(c_name) AS first, CAST(sum(c_custkey) AS BIGINT) AS keys FROM n GROUP BY ALL""",
    ),
    "bounded_sample": (
        bounded_sample,
        """
WITH l AS (SELECT l_returnflag, l_orderkey, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY sha256('9:' || l_orderkey)) AS r FROM l)
SELECT l_returnflag, count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS keys, median(quantity) AS median FROM r WHERE r <= 40 GROUP BY ALL""",
    ),
    "candidate_urls": (
        candidate_urls,
        """
WITH p AS (SELECT page_id, page_id % 5 AS m, (2018 + page_id % 4) || '-05-0' || (page_id % 9 + 1) AS day FROM pages),
b AS (SELECT *, 'https://www.publisher.example/investing/' || replace(day, '-', '/') || '/some-title-' || page_id AS base FROM p)
SELECT page_id, CASE WHEN m = 0 THEN 'https://www.publisher.example/a/' || page_id WHEN m = 2 AND page_id % 3 <> 0 THEN CASE WHEN day < '2020' THEN base || '.aspx ' || base || '/' ELSE base || '/ ' || base || '.aspx' END ELSE '' END AS urls FROM b""",
    ),
    "reviewed_bodies": (
        reviewed_bodies,
        """
WITH d AS (SELECT doc_id, text, sha256(regexp_replace(text, '[\\r\\n]+$', '')) AS h FROM documents WHERE text IS NOT NULL), r AS (SELECT DISTINCT h FROM d WHERE doc_id % 6 = 0),
j AS (SELECT d.h IN (SELECT h FROM r) AS reviewed, text FROM d), b AS (SELECT reviewed, CASE WHEN reviewed THEN substr(text, 1, 10) || chr(10) || substr(text, 21, 15) ELSE text END AS body FROM j)
SELECT reviewed, count(*) AS records, CAST(sum(length(body)) AS BIGINT) AS chars, min(body) AS least FROM b GROUP BY ALL""",
    ),
    "editorial_spans": (
        editorial_spans,
        """
SELECT page_id, trim('Body ' || page_id || CASE WHEN page_id % 3 = 0 THEN '   more' ELSE '' END || CASE WHEN page_id % 4 = 0 THEN '' ELSE ' end' END) AS body,
  CAST(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS promotions, page_id % 4 = 0 AS notice FROM pages""",
    ),
    "article_comparison": (
        article_comparison,
        r"""
WITH d AS (SELECT doc_id AS k, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}]+|[^\s\p{L}\p{M}\p{N}\p{Pc}]')) AS n FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN k % 11 = 0 THEN 'wrong_symbol' WHEN k % 13 = 0 OR (n = 0 AND k % 5 NOT IN (2, 3)) THEN 'missing_evidence' WHEN k % 7 = 0 THEN 'title_differs' WHEN k % 17 = 0 THEN 'date_differs'
  WHEN k % 5 IN (0, 4) OR (k % 5 = 1 AND n <= 3) THEN 'same_body' WHEN k % 5 IN (2, 3) THEN 'contained_body' ELSE 'body_differs' END AS state, count(*) AS records FROM d GROUP BY ALL""",
    ),
    "news_cohort": (
        news_cohort,
        f"""
WITH d AS (SELECT *, {_REASONS} AS r FROM documents), p AS (SELECT *, CASE WHEN r = '' THEN row_number() OVER (PARTITION BY r, text ORDER BY doc_id) END AS i FROM d)
SELECT CASE WHEN r <> '' THEN r WHEN i = 1 THEN 'accepted' ELSE 'duplicate' END AS reason, count(*) AS records, count(DISTINCT source) AS sources FROM p GROUP BY ALL""",
    ),
    "news_panel_audit": (
        news_panel_audit,
        f"""
WITH d AS (SELECT lang, CASE WHEN {_REASONS} = '' THEN 'accepted' ELSE split_part({_REASONS}, '+', 1) END AS state FROM documents)
SELECT lang, state, count(*) AS records, CAST(grouping(lang) * 2 + grouping(state) AS INTEGER) AS level FROM d GROUP BY GROUPING SETS ((lang), (state), ())""",
    ),
    "cohort_resume": (cohort_resume, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) >= 2000) ORDER BY c_custkey LIMIT 30"),
    "edition_substitution": (
        edition_substitution,
        """
WITH n AS (SELECT c_nationkey AS k, count(*) AS rows FROM customer GROUP BY ALL),
s AS (SELECT k, rows, CASE WHEN k BETWEEN 3 AND 14 THEN CASE WHEN k % 4 = 0 THEN 'disagrees' ELSE 'substituted' END WHEN k < 3 THEN 'unrecorded' WHEN k <= 20 THEN 'absent' ELSE 'untouched' END AS state FROM n)
SELECT k AS c_nationkey, rows, CASE WHEN state = 'substituted' THEN rows ELSE 0 END AS new_rows, state FROM s""",
    ),
    "observed_sessions": (
        observed_sessions,
        """
WITH s AS (SELECT l_returnflag AS market, CAST(l_shipdate AS DATE) AS session, count(*) FILTER (l_quantity > 5) AS accepted FROM lineitem GROUP BY ALL)
SELECT market, CAST(year(session) AS INTEGER) AS year, count(*) AS sessions, count(*) FILTER (accepted = 0) AS excluded_only FROM s GROUP BY ALL""",
    ),
    "fact_reconciliation": (
        fact_reconciliation,
        """
WITH o AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18, 2)) AS raw FROM orders),
s AS (SELECT CASE WHEN k % 14 = 0 THEN 'missing_publication' WHEN k % 10 = 9 THEN 'period_mismatch' WHEN k % 6 = 5 THEN 'unsupported_unit' WHEN k % 6 = 0 THEN 'exact' WHEN k % 6 = 4 THEN 'value_mismatch'
  WHEN raw = round(raw / 1000, 0) * 1000 THEN 'exact' WHEN k % 3 <> 1 THEN 'rounded' ELSE 'value_mismatch' END AS state FROM o)
SELECT state, count(*) AS facts FROM s GROUP BY ALL""",
    ),
    "balance_census": (
        balance_census,
        """
WITH j AS (SELECT c_nationkey, CAST(year(o_orderdate) AS INTEGER) AS year, sha256('{"l_orderkey":"' || l_orderkey || '","l_linenumber":"' || l_linenumber || '"}') AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 6),
s AS (SELECT c_nationkey, year, count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)::HUGEINT) AS a, sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)::HUGEINT) AS b, sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)::HUGEINT) AS c FROM j GROUP BY ALL)
SELECT c_nationkey, year, sha256(n || ':' || a || ':' || b || ':' || c) AS fingerprint, n AS records FROM s""",
    ),
    "accounting_enrichment": (
        accounting_enrichment,
        """
WITH r AS (SELECT o_custkey, count(*) AS facts, max(o_orderdate) AS latest FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' GROUP BY ALL)
SELECT c_mktsegment, count(*) AS assets, count(facts) AS enriched, CAST(sum(facts) AS BIGINT) AS facts, max(latest) AS latest FROM customer LEFT JOIN r ON o_custkey = c_custkey GROUP BY ALL""",
    ),
    "point_lookup": (point_lookup, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate = TIMESTAMP '1997-03-05'"),
    "range_scan": (range_scan, "SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-05 18:00:00'"),
    "prefix_scan": (prefix_scan, "SELECT event_type, count(*) AS rows, max(ts) AS last FROM events WHERE ts < TIMESTAMP '2024-01-08' GROUP BY ALL"),
    "cohort_index": (
        cohort_index,
        "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS rows, count(DISTINCT user_id) AS assets, min(ts) AS first, max(ts) AS last, max(ts) + INTERVAL 3 DAY AS mature FROM events GROUP BY ALL",
    ),
    "trace_series": (
        trace_series,
        f"""
WITH {_STEPS}, l AS (SELECT metric, "group", step, arg_max(value, part) AS v FROM s GROUP BY ALL)
SELECT metric, "group", CAST(count(*) AS INTEGER) AS steps, min(step) AS first, max(step) AS last, CAST(count(*) FILTER (NOT isfinite(v)) AS INTEGER) AS odd, round(coalesce(sum(v) FILTER (isfinite(v)), 0), 4) AS total FROM l GROUP BY ALL""",
    ),
    "trace_summary": (
        trace_summary,
        f"""
WITH {_STEPS}, f AS (SELECT metric, "group", part, CASE WHEN isfinite(value) THEN value END AS v FROM s)
SELECT metric, "group", count(*) AS steps, arg_min(v, part) FILTER (v IS NOT NULL) AS first, arg_max(v, part) FILTER (v IS NOT NULL) AS last, min(v) AS best, median(v) AS median, round(count(v) / count(*), 7) AS finite FROM f GROUP BY ALL""",
    ),
    "vendor_payloads": (
        vendor_payloads,
        """
WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_totalprice AS DOUBLE) AS v FROM orders WHERE o_custkey % 9 <> 0), b AS (SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_custkey % 9 = 0)
SELECT year, count(*) AS rows, round(sum(v), 2) AS total FROM o GROUP BY ALL UNION ALL SELECT NULL, n, NULL FROM b WHERE n > 0""",
    ),
}
