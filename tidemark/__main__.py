"""The command line: `python -m tidemark <command> ...`. Every command is a query program over files; results are printed as JSON lines or published."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators import catalogs, macro
from tidemark.operators import relational as R
from tidemark.session import build_session
from tidemark.sinks import publish
from tidemark.sources import files

Args = argparse.Namespace


def show(df: DataFrame, most: int = 1000) -> None:
    """Rows of a small result, one JSON text each."""
    for row in df.limit(most).collect():
        print(json.dumps(row.asDict(recursive=True), default=str, sort_keys=True))


def inventory(spark: SparkSession, a: Args) -> None:
    """Files below a folder with kind, size, hash and header facts; against a previous inventory, what changed."""
    now = files.inventory(spark, a.source)
    digest = publish.publish(now, a.output)
    found = spark.read.parquet(a.output)
    show(found.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), (F.count("sha256") - F.countDistinct("sha256")).alias("repeated")))
    if a.previous:
        show(files.changed_files(spark.read.parquet(a.previous), found).groupBy("state").agg(F.count(F.lit(1)).alias("files")))
    print(json.dumps({"published": a.output, "digest": digest}))


def corpus_index(spark: SparkSession, a: Args) -> None:
    """Records of JSON line files with their place, hashes, state and the asset that the file's name gives."""
    r = files.read_records(spark, a.source, a.max_bytes)
    symbol = C.symbol(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    publish.publish(r.withColumn("asset", symbol), a.output)
    show(spark.read.parquet(a.output).groupBy("state").agg(F.count(F.lit(1)).alias("records")))


def corpus_status(spark: SparkSession, a: Args) -> None:
    """Records by asset and state, with subtotals."""
    show(spark.read.parquet(a.index).rollup("asset", "state").agg(F.count(F.lit(1)).alias("records"), F.sum("byte_length").alias("bytes")).orderBy("asset", "state"))


def _queue(spark: SparkSession, a: Args) -> DataFrame:
    index = spark.read.parquet(a.index).where("state = 'accepted'").select("path", "ordinal", "record_sha256", "payload", "asset")
    if not a.verdicts:
        return index
    return index.join(spark.read.parquet(a.verdicts).select("path", "ordinal"), ["path", "ordinal"], "left_anti")


def news_queue(spark: SparkSession, a: Args) -> None:
    """The next records without a verdict, in (path, ordinal) order after a given one."""
    page = R.keyset_page(_queue(spark, a).select("path", "ordinal", "record_sha256", "asset"), ["path", "ordinal"], [a.after_path, a.after_ordinal], a.size)
    show(page)


def news_status(spark: SparkSession, a: Args) -> None:
    """Verdicts by state and asset, and in all."""
    show(spark.read.parquet(a.verdicts).groupingSets([["state"], ["asset"], []], "state", "asset").agg(F.count(F.lit(1)).alias("records")).orderBy("state", "asset"))


def news_verify(spark: SparkSession, a: Args) -> None:
    """Compares waiting records with evidence (JSON lines with Asset, Title, Date, Body) by the comparison's ladder and publishes the verdicts."""
    schema = "Asset string, Title string, Date string, Body string"
    parsed = lambda df, text: df.withColumn("_r", F.from_json(text, schema))
    q = parsed(_queue(spark, a), "payload")
    e = spark.read.schema(schema).json(a.evidence).select(C.symbol(F.col("Asset")).alias("asset"), F.col("Title").alias("_title"), F.col("Date").alias("_date"), F.col("Body").alias("_body"))
    one = Window.partitionBy("path", "ordinal").orderBy(F.desc(F.col("_r.Title") == F.col("_title")), "_title")
    j = q.join(e, "asset", "left").withColumn("_n", F.row_number().over(one)).where("_n = 1")
    body = lambda c: C.tokens(F.coalesce(c, F.lit("")))
    state = catalogs.article_state(F.col("asset").eqNullSafe(C.symbol(F.col("_r.Asset"))), F.col("_r.Title"), F.col("_title"), F.col("_r.Date"), F.col("_date"), body(F.col("_r.Body")), body(F.col("_body")))
    publish.publish(j.select("path", "ordinal", "asset", "record_sha256", state.alias("state")), a.output)
    show(spark.read.parquet(a.output).groupBy("state").agg(F.count(F.lit(1)).alias("records")))


def select(spark: SparkSession, a: Args) -> None:
    """A panel of assets: of each sector the median size, the 90th percentile, then a fixed pseudo-random order."""
    c = spark.read.parquet(a.census)
    w = Window.partitionBy("sector")
    c = c.withColumns({"_n": F.count(F.lit(1)).over(w), "_p": F.row_number().over(w.orderBy("size", "asset")) - 1})
    first = F.when(F.col("_p") == F.floor((F.col("_n") - 1) / 2), 0).when(F.col("_p") == F.floor((F.col("_n") - 1) * 9 / 10), 1).otherwise(2)
    c = c.withColumn("_first", first).withColumn("place", F.row_number().over(w.orderBy("_first", R.hash_order(c, a.seed, "asset"))))
    show(c.where(F.col("place") <= a.per_sector).select("sector", "asset", "place").orderBy("sector", "place"))


def _prices(spark: SparkSession, a: Args) -> DataFrame:
    calendar = spark.read.parquet(a.calendar).select(F.col("session").cast("date").alias("session"), F.col("decision").cast("timestamp").alias("decision"))
    return files.read_prices(spark.read.csv(a.prices, header=True), calendar, a.tolerance)


def prepare(spark: SparkSession, a: Args) -> None:
    """An asset's prices: accepted and excluded rows, each published once, with a receipt."""
    p = _prices(spark, a)
    receipt = publish.write_cohort(p.where(F.size("reasons") == 0).drop("reasons"), p.where(F.size("reasons") > 0), a.output, {"prices": a.prices})
    print(json.dumps(receipt, sort_keys=True))


def audit_prices(spark: SparkSession, a: Args) -> None:
    """Rows accepted and excluded, and rows of each reason."""
    show(files.exclusion_counters(_prices(spark, a)).orderBy("counter"))


def verify_number_parsing(spark: SparkSession, a: Args) -> None:
    """Values that a lenient parser takes for numbers and the exact one doesn't, by column."""
    show(files.compare_number_parsers(spark, a.source, a.columns.split(",")).orderBy("column"))


def macro_panel(spark: SparkSession, a: Args) -> None:
    """What is known of each indicator at each day's decision, only where it changed; conflicting versions are refused."""
    v = spark.read.parquet(a.vintages).withColumn("available", F.col("available").cast("timestamp"))
    if "expires" not in v.columns:
        v = v.withColumn("expires", F.lit(None).cast("timestamp"))
    good, bad = macro.split_conflicts(v, ["indicator", "period", "available", "expires"], "value")
    if bad.limit(1).count():
        raise R.Refused("versions of the same instant disagree")
    known = macro.snapshots(good, ["indicator"], "period", "available", "expires", "value", a.horizon, a.hour)
    publish.publish(macro.changed_only(known, ["indicator"], "decision", ["period", "value"]), a.output)
    show(spark.read.parquet(a.output).groupBy("indicator").agg(F.count(F.lit(1)).alias("changes"), F.max("decision").alias("last")).orderBy("indicator"))


def encode(spark: SparkSession, a: Args) -> None:
    """Samples with all modalities from the tables of a folder, published."""
    from tidemark.plans.materialised import sample_rows

    rows = sample_rows(spark, a.tables)
    publish.publish(rows.where(F.size("absent") == 0).drop("absent"), a.output)
    show(rows.groupBy(F.array_join("absent", "+").alias("absent")).agg(F.count(F.lit(1)).alias("decisions")).orderBy("absent"))


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    from tidemark.plans import registry

    if name not in registry.QUERIES:
        raise SystemExit(f"no query {name!r}; there are {', '.join(sorted(registry.QUERIES))}")
    return registry.QUERIES[name]


def profile(spark: SparkSession, a: Args) -> None:
    """Seconds of a query's runs, and its plan."""
    query = _query(a.query)
    took = []
    for _ in range(a.runs):
        began = time.perf_counter()
        query(spark, a.tables).write.format("noop").mode("overwrite").save()
        took.append(round(time.perf_counter() - began, 3))
    print(json.dumps({"query": a.query, "seconds": took}))
    if a.explain:
        query(spark, a.tables).explain("formatted")


def run(spark: SparkSession, a: Args) -> None:
    """A registered query over the tables of a folder."""
    show(_query(a.query)(spark, a.tables), a.most)


#: command: (program, its arguments as (name, options))
COMMANDS: dict[str, tuple[Callable[[SparkSession, Args], None], list[tuple[str, dict]]]] = {
    "inventory": (inventory, [("source", {}), ("output", {}), ("--previous", {})]),
    "corpus-index": (corpus_index, [("source", {}), ("output", {}), ("--max-bytes", {"type": int, "default": 1 << 20})]),
    "corpus-status": (corpus_status, [("index", {})]),
    "news-queue": (news_queue, [("index", {}), ("--verdicts", {}), ("--after-path", {"default": ""}), ("--after-ordinal", {"type": int, "default": -1}), ("--size", {"type": int, "default": 100})]),
    "news-status": (news_status, [("verdicts", {})]),
    "news-verify": (news_verify, [("index", {}), ("evidence", {}), ("output", {}), ("--verdicts", {})]),
    "select": (select, [("census", {}), ("--per-sector", {"type": int, "default": 6}), ("--seed", {"default": "17"})]),
    "prepare": (prepare, [("prices", {}), ("calendar", {}), ("output", {}), ("--tolerance", {"type": float, "default": 0.0})]),
    "audit-prices": (audit_prices, [("prices", {}), ("calendar", {}), ("--tolerance", {"type": float, "default": 0.0})]),
    "verify-number-parsing": (verify_number_parsing, [("source", {}), ("columns", {})]),
    "macro": (macro_panel, [("vintages", {}), ("output", {}), ("--horizon", {"type": int, "default": 400}), ("--hour", {"type": int, "default": 21})]),
    "encode": (encode, [("tables", {}), ("output", {})]),
    "profile": (profile, [("query", {}), ("tables", {}), ("--runs", {"type": int, "default": 3}), ("--explain", {"action": "store_true"})]),
    "run": (run, [("query", {}), ("tables", {}), ("--most", {"type": int, "default": 20})]),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name, (program, arguments) in COMMANDS.items():
        c = commands.add_parser(name, help=(program.__doc__ or "").split("\n")[0])
        for argument, options in arguments:
            c.add_argument(argument, **options)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command][0](spark or build_session(f"tidemark {a.command}"), a)


if __name__ == "__main__":
    main()
