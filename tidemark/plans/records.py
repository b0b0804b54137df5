"""Queries over documents, pages, benchmark passages, labels and conversations: identities, ladders, comparisons and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators import relational as R
from tidemark.session import table


def document_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by content hash: the first of each identity is accepted, later ones are rejected as duplicates."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"))
    first = d.groupBy("content_sha256").agg(F.min("doc_id").alias("first"))  # copies are counted where they are read
    return d.join(first, "content_sha256").select("doc_id", "content_sha256", F.when(F.col("doc_id") == F.col("first"), "accepted").otherwise("duplicate").alias("state"))


def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source record hash of a whole text without its line end, and the identity of (id, language, source)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", C.record_hash(F.concat(F.col("text"), F.lit("\r\n"))).alias("record_sha256"), C.identity(F.col("doc_id"), F.col("lang"), F.col("source")).alias("identity_sha256"))


def token_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unicode words and single marks of the documents, by language."""
    d = table(spark, sf_dir, "documents").select(F.size(C.tokens(F.col("text"))).alias("n"), "lang")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.max("n").alias("most"))


def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages in chunks of at most 16 tokens: chunks, and the last chunk's tokens."""
    t = table(spark, sf_dir, "benchmark").select("item_id", C.tokens(F.col("text")).alias("t"))
    chunks = t.select("item_id", F.transform(F.sequence(F.lit(1), F.greatest(F.size("t"), F.lit(1)), F.lit(16)), lambda i: F.slice("t", i, 16)).alias("c"))
    return chunks.select("item_id", F.size("c").alias("chunks"), F.size(F.element_at("c", -1)).alias("last"))


def contamination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages contained in documents: a stated set of passages, checked for its size, against all rows."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    if b.count() > 10_000:
        raise R.Refused("more passages than one broadcast holds; take them in blocks")
    words = F.split("passage", r"\s+")
    # inside a passage words stand between blanks, in a document that holds it too: its longest inner word finds the candidates
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    b = b.withColumn("anchor", F.when(F.size(words) > 2, F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]))
    anchors = b.where("anchor is not null").agg(F.collect_set("anchor").alias("anchors"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    some = d.crossJoin(F.broadcast(anchors)).select("doc_id", "text", F.explode(F.array_intersect(F.split("text", r"\s+"), "anchors")).alias("anchor"))
    hits = some.join(F.broadcast(b), "anchor").where(F.contains("text", "passage")).select("item_id", "doc_id")
    short = b.where("anchor is null").select("item_id", "passage")
    hits = hits.unionByName(d.join(F.broadcast(short), F.contains("text", "passage")).select("item_id", "doc_id"))
    return b.select("item_id").join(hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.min("doc_id").alias("first")), "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), "first")


def record_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each document by an ordered ladder of rules, counted by source."""
    d = table(spark, sf_dir, "documents")
    state = (
        F.when(F.col("text").isNull() | (F.trim("text") == ""), "missing_content")
        .when(F.length("text") > 20_000, "oversize")
        .when(~F.col("lang").isin("en", "de", "fr", "es"), "invalid_language")
        .when(F.col("n_chars") != F.length("text"), "length_mismatch")
        .when(F.length("text") < 40, "needs_review")
        .otherwise("pending_verification")
    )
    return d.groupBy("source", state.alias("state")).agg(F.count(F.lit(1)).alias("documents"))


def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the page URLs, without scheme, query and fragment, as an identity."""
    p = table(spark, sf_dir, "pages")
    host, path = F.parse_url(F.col("url"), F.lit("HOST")), F.parse_url(F.col("url"), F.lit("PATH"))
    bare = F.regexp_replace(F.lower(host), r"^(www|m)\.", "")
    return p.select("page_id", bare.alias("host"), path.alias("path"), F.sha2(F.concat(bare, path).cast("binary"), 256).alias("identity"), F.regexp_extract("url", r"[?&]page=(\d+)", 1).alias("page"))


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, title and links of the pages' HTML."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id",
        F.regexp_extract("html", r'<html[^>]*\blang="([^"]*)"', 1).alias("lang"),
        F.length(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title_chars"),
        F.size(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("links"),
        F.sha2(F.col("html").cast("binary"), 256).alias("html_sha256"),
    )


def path_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by top-level domain and first path segment, with repeated contents."""
    p = table(spark, sf_dir, "pages")
    host = F.parse_url(F.col("url"), F.lit("HOST"))
    p = p.select(F.element_at(F.split(host, r"\."), -1).alias("domain"), F.split(F.parse_url(F.col("url"), F.lit("PATH")), "/")[1].alias("section"), F.sha2(F.col("html").cast("binary"), 256).alias("h"), F.octet_length("html").alias("bytes"))
    return p.groupBy("domain", "section").agg(F.count(F.lit(1)).alias("pages"), F.sum("bytes").alias("bytes"), (F.count("h") - F.countDistinct("h")).alias("repeated"))


def conversation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in the turns of each conversation, roles that repeat, and its length."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("gap", F.col("turn") - F.lag("turn").over(w)).withColumn("again", F.col("role") == F.lag("role").over(w))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("gap") != 1).alias("gaps"), F.count_if("again").alias("repeated_roles"), F.sum(F.length("text")).alias("chars"))


def label_join_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against documents, every exclusion accounted for."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = d.select("doc_id", "lang", F.lit(True).alias("has_doc")).join(lab.withColumn("has_label", F.lit(True)), "doc_id", "full")
    reason = F.when(F.col("has_doc").isNull(), "label_without_document").when(F.col("has_label").isNull(), "unlabelled").when(F.col("toxic").isNull() | F.col("quality").isNull(), "missing_value").otherwise("labelled")
    return j.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"), F.sum("toxic").alias("toxic"), F.sum("quality").alias("quality"))


def edition_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two editions of the documents' facts, full outer: what is new, gone, equal and changed."""
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 10 <> 3").select("doc_id", "lang", F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"))
    new = d.where("doc_id % 10 <> 4").select("doc_id", "lang", "n_chars")
    return R.reconcile(old, new, ["doc_id"], ["lang", "n_chars"]).groupBy("state").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first"))


def score_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against recomputed text lengths within a tolerance, by language."""
    d = table(spark, sf_dir, "documents").select("lang", "n_chars", F.length("text").cast("long").alias("again"))
    close = F.abs(F.col("n_chars") - F.col("again")) <= 1 + 1e-6 * F.col("again")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("n_chars").eqNullSafe(F.col("again"))).alias("exact_mismatches"), F.count_if(~F.coalesce(close, F.lit(False))).alias("tolerance_mismatches"))


def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of entries, each with its predecessor's hash: links recomputed and compared, per source."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2(F.concat_ws("|", "source", F.col("doc_id").cast("string"), F.col("n_chars").cast("string")).cast("binary"), 256).alias("entry"))
    w = Window.partitionBy("source").orderBy("doc_id")
    d = d.withColumn("previous", F.lag("entry").over(w)).withColumn("declared", F.when(F.col("doc_id") % 97 == 5, F.lit("0")).otherwise(F.lag("entry").over(w)))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.count_if(~F.col("previous").eqNullSafe(F.col("declared"))).alias("broken"), F.min(F.when(~F.col("previous").eqNullSafe(F.col("declared")), F.col("doc_id"))).alias("first_broken"))


def symbol_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers normalised (upper case, suffix) and checked against the grammar."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), F.lower(F.col("c_mktsegment")), F.lit(".sh ")).alias("raw"))
    name = C.symbol(F.col("raw"))
    return c.groupBy(name.alias("symbol")).agg(F.count(F.lit(1)).alias("rows"), F.first(name.rlike(r"^[A-Z0-9]{1,12}\.(SS|SZ|US)$")).alias("valid"))


REGISTERED = {
    "document_identity": (document_identity, "SELECT doc_id, sha256(text) AS content_sha256, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 THEN 'accepted' ELSE 'duplicate' END AS state FROM documents"),
    "record_hashes": (
        record_hashes,
        r"""SELECT doc_id, sha256(regexp_replace(text, '[\r\n]+$', '')) AS record_sha256, sha256('["' || doc_id || '","' || lang || '","' || source || '"]') AS identity_sha256 FROM documents""",
    ),
    "token_compare": (
        token_compare,
        r"""WITH t AS (SELECT lang, len(regexp_extract_all(text, '([\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s])')) AS n FROM documents)
SELECT lang, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, max(n) AS most FROM t GROUP BY ALL""",
    ),
    "token_chunks": (
        token_chunks,
        r"""WITH t AS (SELECT item_id, len(regexp_extract_all(text, '([\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s])')) AS n FROM benchmark)
SELECT item_id, greatest((n + 15) // 16, 1) AS chunks, CASE WHEN n = 0 THEN 0 ELSE (n - 1) % 16 + 1 END AS last FROM t""",
    ),
    "contamination_join": (
        contamination_join,
        "SELECT item_id, count(DISTINCT doc_id) AS documents, min(doc_id) AS first FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY ALL",
    ),
    "record_ladder": (
        record_ladder,
        """
SELECT source, CASE WHEN text IS NULL OR trim(text) = '' THEN 'missing_content' WHEN length(text) > 20000 THEN 'oversize' WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'invalid_language'
  WHEN n_chars <> length(text) THEN 'length_mismatch' WHEN length(text) < 40 THEN 'needs_review' ELSE 'pending_verification' END AS state, count(*) AS documents FROM documents GROUP BY ALL""",
    ),
    "url_identity": (
        url_identity,
        r"""
WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^(www|m)\.', '') AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, sha256(host || path) AS identity, regexp_extract(url, '[?&]page=(\d+)', 1) AS page FROM p""",
    ),
    "page_metadata": (
        page_metadata,
        r"""
SELECT page_id, regexp_extract(html, '<html[^>]*\blang="([^"]*)"', 1) AS lang, length(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title_chars,
  len(regexp_extract_all(html, '<a href="([^"]*)"')) AS links, sha256(html) AS html_sha256 FROM pages""",
    ),
    "path_census": (
        path_census,
        r"""
WITH p AS (SELECT string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.')[-1] AS domain, string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/')[2] AS section, sha256(html) AS h, strlen(html) AS bytes FROM pages)
SELECT domain, section, count(*) AS pages, CAST(sum(bytes) AS BIGINT) AS bytes, count(h) - count(DISTINCT h) AS repeated FROM p GROUP BY ALL""",
    ),
    "conversation_order": (
        conversation_order,
        """
WITH c AS (SELECT *, turn - lag(turn) OVER w AS gap, role = lag(role) OVER w AS again FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS turns, count(*) FILTER (gap <> 1) AS gaps, count(*) FILTER (again) AS repeated_roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM c GROUP BY ALL""",
    ),
    "label_join_audit": (
        label_join_audit,
        """
WITH j AS (SELECT CASE WHEN d.doc_id IS NULL THEN 'label_without_document' WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN toxic IS NULL OR quality IS NULL THEN 'missing_value' ELSE 'labelled' END AS reason, toxic, quality
  FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id)
SELECT reason, count(*) AS rows, CAST(sum(toxic) AS BIGINT) AS toxic, CAST(sum(quality) AS BIGINT) AS quality FROM j GROUP BY ALL""",
    ),
    "edition_diff": (
        edition_diff,
        """
WITH a AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n FROM documents WHERE doc_id % 10 <> 3),
b AS (SELECT doc_id, lang, n_chars AS n FROM documents WHERE doc_id % 10 <> 4),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left_only' WHEN a.doc_id IS NULL THEN 'right_only' WHEN a.lang IS NOT DISTINCT FROM b.lang AND a.n IS NOT DISTINCT FROM b.n THEN 'equal' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT state, count(*) AS documents, min(doc_id) AS first FROM j GROUP BY ALL""",
    ),
    "score_recheck": (
        score_recheck,
        "SELECT lang, count(*) AS rows, count(*) FILTER (n_chars IS DISTINCT FROM length(text)) AS exact_mismatches, count(*) FILTER (NOT coalesce(abs(n_chars - length(text)) <= 1 + 1e-6 * length(text), false)) AS tolerance_mismatches FROM documents GROUP BY ALL",
    ),
    "hash_chain": (
        hash_chain,
        """
WITH e AS (SELECT source, doc_id, sha256(source || '|' || doc_id || '|' || n_chars) AS entry FROM documents),
p AS (SELECT *, lag(entry) OVER (PARTITION BY source ORDER BY doc_id) AS previous FROM e),
q AS (SELECT *, CASE WHEN doc_id % 97 = 5 THEN '0' ELSE previous END AS declared FROM p)
SELECT source, count(*) AS entries, count(*) FILTER (previous IS DISTINCT FROM declared) AS broken, min(doc_id) FILTER (previous IS DISTINCT FROM declared) AS first_broken FROM q GROUP BY ALL""",
    ),
    "symbol_grammar": (
        symbol_grammar,
        """
WITH s AS (SELECT regexp_replace(upper(trim(' ' || lower(c_mktsegment) || '.sh ')), '\\.SH$', '.SS') AS symbol FROM customer)
SELECT symbol, count(*) AS rows, bool_and(regexp_full_match(symbol, '[A-Z0-9]{1,12}\\.(SS|SZ|US)')) AS valid FROM s GROUP BY ALL""",
    ),
}
