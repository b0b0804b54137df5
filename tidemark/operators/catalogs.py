"""Registries of files and records as tables: upserts, budgets, stripes, samples, reviews, cohorts and the reconciliation of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upserted(base: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """base with the changes' rows in place of those with their keys, as a whole new snapshot; of several changes of a key the latest by `order` counts."""
    if order is not None:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        changes = changes.withColumn("_r", place).where("_r = 1").drop("_r")
    changes = changes.select(*base.columns)
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def evicted(entries: DataFrame, owner: list[str], accessed: str, size: str, key: str, budget: int) -> DataFrame:
    """entries with `kept`: each owner's most recently accessed ones up to the budget, the oldest go first."""
    w = Window.partitionBy(*owner).orderBy(F.desc(accessed), key).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("kept", F.sum(size).over(w) <= budget)


def numbered(df: DataFrame, bucket: Column, order: list[str], name: str) -> DataFrame:
    """df with its place from 0 in the order of (bucket, order), without a task that sorts everything: buckets are counted, rows numbered within theirs.

    `bucket` has to rise with the order, as a prefix of its first column does.
    """
    b = df.withColumn("_b", bucket)
    sizes = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.alias("x").join(F.broadcast(sizes.alias("y")), F.col("y._b") < F.col("x._b"), "left").groupBy(F.col("x._b").alias("_b")).agg(F.coalesce(F.sum("y._n"), F.lit(0)).alias("_before"))  # a row for each bucket
    placed = b.withColumn("_in", F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1).join(F.broadcast(before), "_b")
    return placed.withColumn(name, F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")


def bottom_k(df: DataFrame, keys: list[str], priority: Column, k: int, parts: int = 64) -> DataFrame:
    """Each key's k rows of the smallest priority, exactly: first within parts of the key, then among what they leave."""
    part = df.withColumn("_p", priority).withColumn("_part", F.pmod(F.xxhash64("_p"), F.lit(parts)))
    first = part.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_p"))).where(F.col("_r") <= k)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_p"))).where(F.col("_r") <= k).drop("_p", "_part", "_r")


def candidate_urls(url: Column, body: Column, day: Column, publisher: str, syndicator: str, credit: str, section: str) -> Column:
    """Addresses at which a publisher may have an article: its own as it is; a syndicator's by slug and date, in an order that depends on the year; else none."""
    host = F.try_parse_url(url, F.lit("HOST"))
    secure = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("USERINFO")).isNull()
    path = F.try_parse_url(url, F.lit("PATH"))
    slug = F.regexp_replace(F.regexp_replace(path, "^/articles/", ""), r"-\d{4}-\d{2}-\d{2}$", "")
    base = F.concat(F.lit(f"https://{publisher}/{section}/"), F.replace(day, F.lit("-"), F.lit("/")), F.lit("/"), slug)
    plain, page = F.concat(base, F.lit("/")), F.concat(base, F.lit(".aspx"))
    good = (host == syndicator) & path.startswith("/articles/") & F.contains(body, F.lit(credit)) & day.rlike(r"^\d{4}-\d{2}-\d{2}$") & slug.rlike("^[a-z0-9-]+$")
    none = F.array().cast("array<string>")
    return F.when(~F.coalesce(secure, F.lit(False)), none).when(host == publisher, F.array(url)).when(F.coalesce(good, F.lit(False)), F.when(day < "2020", F.array(page, plain)).otherwise(F.array(plain, page))).otherwise(none)


def kept_text(text: Column, spans: Column, joiner: str = "\n") -> Column:
    """The spans (first and end character, end exclusive) of a text, joined; spans are reviewed, so that they aren't repaired."""
    return F.array_join(F.transform(spans, lambda s: F.substring(text, s["first"] + 1, s["stop"] - s["first"])), joiner)


def editorial(text: Column, promotion: str, notice: str) -> Column:
    """(body, promotions, notices): the text without delimited promotional blocks and without its trailing notices, white space trimmed."""
    tail = rf"(?s)(?:\s*{notice})+\s*$"
    bare = F.regexp_replace(text, tail, "")
    body = F.trim(F.regexp_replace(bare, promotion, " "))
    return F.struct(body.alias("body"), F.regexp_count(bare, F.lit(promotion)).alias("promotions"), (F.octet_length(text) != F.octet_length(bare)).alias("notice"))


def article_state(symbol_ok: Column, title: Column, other_title: Column, day: Column, other_day: Column, tokens: Column, other_tokens: Column) -> Column:
    """The first rule that decides a comparison: wrong_symbol, missing_evidence, title_differs, date_differs, same_body, contained_body, body_differs."""
    a, b = F.array_join(tokens, " "), F.array_join(other_tokens, " ")
    return (
        F.when(~symbol_ok, "wrong_symbol")
        .when(title.isNull() | other_title.isNull() | (F.size(other_tokens) == 0), "missing_evidence")
        .when(title != other_title, "title_differs")
        .when(~day.eqNullSafe(other_day), "date_differs")
        .when(a == b, "same_body")
        .when(F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" "))), "contained_body")
        .otherwise("body_differs")
    )


def cohort(records: DataFrame, reasons: Column, identity: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, excluded): records without a reason, the first of equal identities; the others with their reasons, repeats as `duplicate`."""
    r = records.withColumn("reasons", reasons)
    good = r.where(F.size("reasons") == 0)
    place = F.row_number().over(Window.partitionBy(*identity).orderBy(*order))
    good = good.withColumn("_r", place)
    excluded = r.where(F.size("reasons") > 0).unionByName(good.where("_r > 1").withColumn("reasons", F.array(F.lit("duplicate"))).drop("_r"))
    return good.where("_r = 1").drop("_r", "reasons"), excluded


def pending(units: DataFrame, confirmed: DataFrame, key: str, size: int) -> DataFrame:
    """The next `size` units that aren't confirmed, in key order: what a resumed run does next."""
    return units.join(confirmed.select(key).distinct(), key, "left_anti").orderBy(key).limit(size)


def substituted(previous: DataFrame, current: DataFrame, records: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(edition, states): assets taken from the current edition where its rows agree with the record of them, else from the previous one. records: keys, rows."""
    found = current.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    states = records.join(found, keys, "full").select(*keys, F.when(F.col("_n").isNull(), "absent").when(F.col("rows").isNull(), "unrecorded").when(F.col("rows") != F.col("_n"), "disagrees").otherwise("substituted").alias("state"))
    taken = states.where("state = 'substituted'").select(*keys)
    return previous.join(taken, keys, "left_anti").unionByName(current.join(taken, keys, "left_semi")), states


#: Multipliers that a reported unit may have.
MULTIPLIERS = (1, 1_000, 10_000, 1_000_000, 100_000_000)


def reconciliation(raw: Column, reported: Column, multiplier: Column, period: Column, other_period: Column, published: Column, rounds: Column) -> Column:
    """What a reviewed figure says of a raw one: missing_publication, period_mismatch, unsupported_unit, exact, rounded (equal at the reported unit's precision, where the policy allows it) or value_mismatch. Values are decimals."""
    exact = (reported * multiplier).cast("decimal(30,2)")
    at_unit = F.round((raw / multiplier).cast("decimal(30,6)"), 0) == F.round(reported.cast("decimal(30,6)"), 0)
    return (
        F.when(published.isNull(), "missing_publication")
        .when(~period.eqNullSafe(other_period) | (period > published), "period_mismatch")
        .when(~multiplier.isin(*MULTIPLIERS), "unsupported_unit")
        .when(raw.cast("decimal(30,2)") == exact, "exact")
        .when(rounds & at_unit, "rounded")
        .otherwise("value_mismatch")
    )


def trace_series(steps: DataFrame, keys: list[str], step: str, part: str, value: str) -> DataFrame:
    """Per key the ordered values of a trace; a repeated step keeps its last part, infinite values become NaN."""
    last = steps.groupBy(*keys, step).agg(F.max_by(value, part).alias("_v"))
    clean = F.when(F.abs("_v") == float("inf"), F.lit(float("nan"))).otherwise(F.col("_v"))
    return last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("step"), clean.alias("value")))).alias("series"))


def trace_summary(steps: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Per key: first, last, best (least) and median finite value, and the share of finite ones."""
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    v = F.when(ok, F.col(value))
    at = F.when(ok, F.col(step))
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("steps"), F.min_by(v, at).alias("first"), F.max_by(v, at).alias("last"), F.min(v).alias("best"), F.percentile(v, 0.5).alias("median"), F.round(F.avg(ok.cast("double")), 7).alias("finite"))
