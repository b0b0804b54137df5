"""Which rows a result stands for: admission of prediction tables, alignment, digests, set relations, folds and their windows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidemark.operators.relational import Refused


def admission(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row: rows, distinct keys, first and last instant in microseconds."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys"), F.min(micros).alias("first_us"), F.max(micros).alias("last_us"))


def admitted_schema(df: DataFrame, declared: StructType) -> DataFrame:
    """df, or Refused: a repeated name, a missing or further column, or another type."""
    names = [f.name for f in df.schema]
    if len(set(names)) != len(names):
        raise Refused("repeated column name")
    found, wanted = ({f.name: f.dataType for f in s} for s in (df.schema, declared))
    wrong = sorted(n for n in found.keys() | wanted.keys() if found.get(n) != wanted.get(n))
    if wrong:
        raise Refused(f"columns differ from the declared: {wrong}")
    return df


def ordered(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The columns in key order; Spark's sort spills, so that no page quota is needed."""
    return df.select(*columns).orderBy(*keys)


def alignment(left: DataFrame, right: DataFrame, key: str, same: list[str]) -> DataFrame:
    """left joined to right by key with one boolean for each column that has to agree, and whether right has the row."""
    other = right.select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in same], *[c for c in right.columns if c != key and c not in same])
    j = left.join(other, key, "left")
    return j.select(*left.columns, *[c for c in right.columns if c not in left.columns], F.coalesce("_there", F.lit(False)).alias("aligned"), *[F.col(c).eqNullSafe(F.col(f"_{c}")).alias(f"same_{c}") for c in same])


def aligned(left: DataFrame, right: DataFrame, key: str, same: list[str]) -> DataFrame:
    """The alignment, or Refused if a row is missing or disagrees."""
    found = alignment(left, right, key, same)
    good = F.col("aligned")
    for c in same:
        good = good & F.col(f"same_{c}")
    if found.where(~good).limit(1).count():
        raise Refused("the tables stand for different rows")
    return found.drop("aligned", *[f"same_{c}" for c in same])


def digest(df: DataFrame, keys: list[str], columns: list[str], name: str = "digest") -> DataFrame:
    """Per key an order-free digest of the columns' values over its rows: counts and two hash sums, as a SHA-256 text.

    Sums are associative, so that partial aggregation does it at any size; repeated rows count as often.
    """
    text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})
    h = F.sha2(text.cast("binary"), 256)
    part = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(part(at)).alias(f"_s{at}") for at in (1, 16, 31)])
    return sums.select(*keys, F.sha2(F.concat_ws(":", "_n", "_s1", "_s16", "_s31").cast("binary"), 256).alias(name))


def relation(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """One row: distinct rows in common and on either side only, and the populations' relation."""
    a = left.select(*columns).distinct().withColumn("_a", F.lit(1))
    b = right.select(*columns).distinct().withColumn("_b", F.lit(1))
    keys = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in columns]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    j = a.alias("x").join(b.alias("y"), on, "full")
    s = j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"), F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"))
    kind = F.when((F.col("left_only") == 0) & (F.col("right_only") == 0), "same").when(F.col("common") == 0, "disjoint").when(F.col("left_only") == 0, "within").when(F.col("right_only") == 0, "contains").otherwise("overlaps")
    return s.withColumn("relation", kind)


def disjoint(named: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """(first, second, common) of every pair of the declared row sets; all are disjoint if every common is 0. One aggregation for all pairs."""
    parts = None
    for i, (name, df) in enumerate(named.items()):
        part = df.select(*columns, F.lit(i).alias("_set")).distinct()
        parts = part if parts is None else parts.unionByName(part)
    names = F.array(*[F.lit(n) for n in named])
    sets = parts.groupBy(*columns).agg(F.array_sort(F.collect_set("_set")).alias("_in")).where(F.size("_in") > 1)
    pairs = sets.select(F.explode("_in").alias("i"), "_in").select("i", F.explode("_in").alias("j")).where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("common"))
    spark = parts.sparkSession
    every = spark.createDataFrame([(i, j) for i in range(len(named)) for j in range(i + 1, len(named))], "i int, j int")
    return every.join(pairs, ["i", "j"], "left").select(F.get(names, F.col("i")).alias("first"), F.get(names, F.col("j")).alias("second"), F.coalesce("common", F.lit(0)).cast("long").alias("common"))


def declared_and_produced(declared: DataFrame, produced: DataFrame, key: str) -> DataFrame:
    """(key, state) of runs that are missing, unexpected or produced more than once."""
    a = declared.select(key).distinct().withColumn("_a", F.lit(True))
    b = produced.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    return a.join(b, key, "full").select(key, state.alias("state")).where("state is not null")


def union_of_editions(editions: list[DataFrame], keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(facts that all editions which have them agree on, facts in conflict): the caller decides whether a conflict is an error."""
    rows = None
    for df in editions:
        part = df.select(*keys, value)
        rows = part if rows is None else rows.unionByName(part)
    groups = rows.groupBy(*keys).agg(F.countDistinct(value).alias("_kinds"), F.count_if(F.col(value).isNull()).alias("_nulls"), F.min(value).alias(value), F.count(F.lit(1)).alias("editions"))
    conflict = (F.col("_kinds") + (F.col("_nulls") > 0).cast("int")) > 1
    return groups.where(~conflict).select(*keys, value, "editions"), groups.where(conflict).select(*keys, "editions")


def months_after(day: date, months: int) -> date:
    """The day `months` later, at the month's last day if it has fewer."""
    from calendar import monthrange

    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    return date(year, month + 1, min(day.day, monthrange(year, month + 1)[1]))


SEGMENTS = ("train", "validation", "calibration", "evaluation")


def build_folds(first: date, last: date, months: tuple[int, int, int, int], step: int) -> list[dict]:
    """Folds of four adjoining segments, each `step` months after the one before, as long as the evaluation ends by `last` (exclusive)."""
    out, start = [], first
    while True:
        edges = [start]
        for m in months:
            edges.append(months_after(edges[-1], m))
        if edges[-1] > last:
            return out
        out.append({"fold": len(out), **{s: (edges[i], edges[i + 1]) for i, s in enumerate(SEGMENTS)}})
        start = months_after(start, step)


def fold_table(spark: SparkSession, folds: list[dict]) -> DataFrame:
    """(fold, segment, first, stop), a row for each segment; checked as receipts are: adjoining, none empty."""
    rows = []
    for f in folds:
        edges = [f[s] for s in SEGMENTS]
        if any(a >= b for a, b in edges) or any(x[1] != y[0] for x, y in zip(edges, edges[1:], strict=False)):
            raise Refused(f"fold {f['fold']} has empty or separated segments")
        rows += [(f["fold"], s, *f[s]) for s in SEGMENTS]
    return spark.createDataFrame(rows, "fold int, segment string, first date, stop date")


def in_folds(df: DataFrame, day: str, folds: DataFrame) -> DataFrame:
    """df's rows in every fold and segment that holds their day. Days are expanded by month, so that the join stays an equi join."""
    months = folds.select("*", F.explode(F.sequence(F.trunc("first", "MM"), F.trunc(F.date_sub("stop", 1), "MM"), F.expr("interval 1 month"))).alias("_month"))
    return df.withColumn("_month", F.trunc(day, "MM")).join(F.broadcast(months), "_month").where((F.col(day) >= F.col("first")) & (F.col(day) < F.col("stop"))).drop("_month")


def eligible_folds(protocol: DataFrame, reference: DataFrame) -> DataFrame:
    """The folds whose segments are the same in both tables."""
    segments = lambda df, name: df.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("segment", "first", "stop"))).alias(name))
    return segments(protocol, "_a").join(segments(reference, "_b"), "fold").where(F.col("_a") == F.col("_b")).select("fold")


def bit_equal(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows that are equal bit for bit, that differ, and that stand on one side only.

    Doubles are compared by their bytes: -0.0 differs from 0.0, and NaN is equal to NaN.
    """
    from pyspark.sql.types import DoubleType, FloatType

    if [(f.name, f.dataType) for f in left.schema] != [(f.name, f.dataType) for f in right.schema]:
        raise Refused("the schemas differ")

    def bits(f) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)):
            # the text tells the sign of zero, and two finite doubles with the same shortest text are the same
            return F.coalesce(c.cast("string"), F.lit("null")).alias(f.name)
        return c

    a = left.select(*keys, F.struct(*[bits(f) for f in left.schema]).alias("_a"))
    b = right.select(*keys, F.struct(*[bits(f) for f in right.schema]).alias("_b"))
    j = a.join(b, keys, "full")
    return j.agg(
        F.count_if(F.col("_a").eqNullSafe(F.col("_b"))).alias("equal"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("different"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("one_sided")
    )


def replayed_selection(history: DataFrame, keys: list[str], epoch: str, score: str, patience: int, joint: int | None = None) -> DataFrame:
    """Per job the epoch an early-stopping rule chooses and the one it stops at: stop after `patience` epochs without a lower score.

    With `joint` the choice is that epoch for all jobs that reach it. Epochs are read in order; a NULL score never is the best.
    """
    w = Window.partitionBy(*keys).orderBy(epoch)
    best = F.min(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = history.withColumn("_better", F.col(score).isNotNull() & (best.isNull() | (F.col(score) < best)))
    h = h.withColumn("_last", F.last(F.when(F.col("_better"), F.col(epoch)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("_since", F.col(epoch) - F.coalesce("_last", F.min(epoch).over(Window.partitionBy(*keys)) - 1))
    stop = F.min(F.when(F.col("_since") >= patience, F.col(epoch))).over(Window.partitionBy(*keys))
    h = h.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(epoch) <= F.col("_stop")))
    chosen = F.max("_last") if joint is None else F.when(F.max(epoch) >= joint, F.lit(joint)).otherwise(F.max("_last"))
    return h.groupBy(*keys).agg(chosen.alias("chosen"), F.max(epoch).alias("stopped"), F.count(F.lit(1)).alias("epochs"))
