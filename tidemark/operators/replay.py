"""What was known when: matured feedback, calibrations that weigh the past by its context, episodes, audits by altering the future, programs over predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.relational import Refused


def context_weighted(rows: DataFrame, keys: list[str], at: str, matures: str, score: str, context: str, lookback_days: int, minimum: int, level: float, width: float | None) -> DataFrame:
    """(keys, at, n, radius): per decision the weighted quantile of the key's past scores that had matured and aren't older than the lookback.

    Weights fall with the distance of the contexts as a Gaussian of `width` (None: all alike). A past score is
    sent to the decision days that may ask for it, a bounded number, so that the join is one on days.
    """
    days = F.explode(F.sequence(F.col(matures), F.date_add(at, lookback_days)))
    past = rows.select(*keys, days.alias("_day"), F.col(score).alias("_s"), F.col(context).alias("_c"))
    ask = rows.groupBy(*keys, F.col(at).alias("_day")).agg(F.avg(context).alias("_own"))
    j = ask.join(past, [*keys, "_day"])
    gap = (F.col("_c") - F.col("_own")) / (width or 1.0)
    j = j.withColumn("_w", F.lit(1.0) if width is None else F.exp(-0.5 * gap * gap))
    sums = j.groupBy(*keys, "_day", "_s").agg(F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*keys, "_day")
    sums = sums.withColumns({"_sum": F.sum("_w").over(w.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_w").over(w), "n": F.sum("_k").over(w)})
    hit = sums.where((F.col("n") >= minimum) & (F.col("_sum") >= F.col("_all") * level - 1e-12))
    return hit.groupBy(*keys, "_day", "n").agg(F.min("_s").alias("radius")).withColumnRenamed("_day", at)


def hours(time: Column) -> Column:
    """The number of the hour that a date or timestamp lies in."""
    return F.unix_date(time.cast("date")) * 24 + F.hour(time)


def published_rewards(decisions: DataFrame, outcomes: DataFrame, key: str, at: str, matures: str, order: list[str], span: Callable[[Column], Column] = hours) -> DataFrame:
    """outcomes with the key's first decision at or after their maturity, at which they are published (NULL: pending), and their place among those published then.

    Times are dealt into spans, whose number must not fall with time: an outcome finds its decision in its own span, or is
    given the first one of the next span that has any. Outcomes without key or maturity stay pending.
    """
    both = outcomes.select(key, F.col(matures).alias("_t"), F.lit(0).alias("_side"), F.struct(*outcomes.columns).alias("_row"))
    d = decisions.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(outcomes.select(F.struct(*outcomes.columns).alias("r")).schema["r"].dataType).alias("_row"))
    both = both.unionByName(d).withColumn("_span", span(F.col("_t")))
    decided = F.when(F.col("_side") == 1, F.col("_t"))
    # from the latest back, as Spark computes a frame that ends with the partition anew for each row
    back = Window.partitionBy(key, "_span").orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(key).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    following = both.groupBy(key, "_span").agg(F.min(decided).alias("_first")).select(key, "_span", F.last("_first", ignorenulls=True).over(later).alias("_next"))
    j = both.withColumn("_own", F.last(decided, ignorenulls=True).over(back)).where("_side = 0").join(following, [key, "_span"], "left")
    j = j.select("_row.*", F.coalesce("_own", F.when(F.col("_span").isNotNull(), F.col("_next"))).alias("published_at"), F.col("_span"))
    pending = F.when(F.col("published_at").isNull(), F.col("_span"))
    place = F.row_number().over(Window.partitionBy(key, "published_at", pending).orderBy(matures, *order))
    return j.withColumn("place", F.when(F.col("published_at").isNotNull(), place)).drop("_span")


def feedback_ledger(cohorts: DataFrame, outcomes: DataFrame, cohort: str, row: str, at: str, limit: int) -> DataFrame:
    """Per cohort: its rows, the outcomes taken (each row's first counts once), repeats and unknown rows refused, and its state: complete, partial, empty or over_limit."""
    first = F.row_number().over(Window.partitionBy(cohort, row).orderBy(at))
    o = outcomes.withColumn("_r", first)
    j = cohorts.select(cohort, row, F.lit(1).alias("_known")).join(o.select(cohort, row, "_r"), [cohort, row], "full")
    s = j.groupBy(cohort).agg(
        F.countDistinct(F.when(F.col("_known") == 1, F.col(row))).alias("rows"), F.count_if((F.col("_known") == 1) & (F.col("_r") == 1)).alias("taken"), F.count_if((F.col("_known") == 1) & (F.col("_r") > 1)).alias("repeated"), F.count_if(F.col("_known").isNull()).alias("unknown")
    )
    state = F.when(F.col("rows") > limit, "over_limit").when(F.col("taken") == 0, "empty").when(F.col("taken") < F.col("rows"), "partial").otherwise("complete")
    return s.withColumn("state", state)


def episodes(cohorts: DataFrame, key: str, order: str, draws: DataFrame, warmup: int, decisions: int) -> DataFrame:
    """(draw, key, order, step, warm): consecutive cohorts from each drawn start, the first `warmup` of them without decisions; draws that would pass the end are left out. draws: draw, key, start."""
    placed = cohorts.select(key, order).distinct().withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    n = placed.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    length = warmup + decisions
    d = draws.join(F.broadcast(n), key).where(F.col("start") + length <= F.col("_n"))  # a row for each key
    d = d.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("_place", (F.col("start") + F.col("step")).cast("int"))
    return d.join(placed, [key, "_place"]).select("draw", key, order, "step", (F.col("step") < warmup).alias("warm"))


def ledger_audit(emit: Callable[[DataFrame], DataFrame], ledger: DataFrame, at: str, columns: list[str], keys: list[str], cutoffs: list, alterations: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(cutoff, alteration, emitted, changed): emissions up to each cut-off, and how many of them change if all later values are altered. A plan that sees only the past has none.

    `emit` is run twice on the same rows as well (alteration `again`): it has to repeat itself.
    """
    base = emit(ledger)
    values = [c for c in base.columns if c not in keys]
    out = None
    for cut in cutoffs:
        cases = {"again": ledger} | {name: ledger.withColumns({c: F.when(F.col(at) > F.lit(cut), change(F.col(c))).otherwise(F.col(c)) for c in columns}) for name, change in alterations.items()}
        for name, altered in cases.items():
            a = base.where(F.col(at) <= F.lit(cut)).select(*keys, F.struct(*values).alias("_a"))
            b = emit(altered).where(F.col(at) <= F.lit(cut)).select(*keys, F.struct(*values).alias("_b"))
            part = a.join(b, keys, "full").agg(F.lit(str(cut)).alias("cutoff"), F.lit(name).alias("alteration"), F.count("_a").alias("emitted"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"))
            out = part if out is None else out.unionByName(part)
    return out


def past_only(found: DataFrame) -> DataFrame:
    """The audit's rows, or Refused if an emission depends on what came later."""
    if found.where("changed > 0").limit(1).count():
        raise Refused("an emission changes with later values")
    return found


def prefix_digest(df: DataFrame, key: list[str], order: list[str], columns: list[str], consumed: int) -> DataFrame:
    """Per key the digest of its first `consumed` rows: what a cursor stores and a resumed reader has to find again."""
    from tidemark.operators.populations import digest

    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return digest(df.withColumn("_p", place).where(F.col("_p") <= consumed), key, ["_p", *columns], "prefix")


def resumable(cursors: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """(key, state): a cursor resumes where its digest is found again, and is refused elsewhere."""
    j = cursors.withColumnRenamed("prefix", "_a").join(found.withColumnRenamed("prefix", "_b"), key, "left")
    return j.select(*key, F.when(F.col("_a").eqNullSafe(F.col("_b")), "resumes").otherwise("refused").alias("state"))


#: Programs over a prediction: name, arguments, and the column that they give.
PROGRAMS: dict[str, Callable[..., Column]] = {
    "identity": lambda p: p,
    "scale": lambda p, factor: p * float(factor),
    "shift": lambda p, amount: p + float(amount),
    "clip": lambda p, most: F.greatest(F.least(p, F.lit(float(most))), F.lit(-float(most))),
    "silence": lambda p, band: F.when(F.round(F.abs(p), 9) <= float(band), 0.0).otherwise(p),
}


def program(text: str, prediction: Column) -> Column:
    """A pipeline of programs, `scale 0.5 | clip 0.02`, as a column; anything undeclared is Refused."""
    out = prediction
    for step in text.split("|"):
        name, *arguments = step.split()
        try:
            out = PROGRAMS[name](out, *arguments)
        except (KeyError, TypeError, ValueError) as e:
            raise Refused(f"no such program: {step.strip()!r}") from e
    return out


def permuted_labels(df: DataFrame, id_col: str, label: str, seed: str) -> DataFrame:
    """The same labels in the same numbers, dealt to the rows by a hash order; labels and rows meet by their places."""
    from tidemark.operators.catalogs import numbered

    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary"), 256)
    rows = numbered(df.select(id_col).withColumn("_h", h), F.substring("_h", 1, 2), ["_h"], "_place").select(id_col, "_place")
    labels = numbered(df.select(label, F.col(id_col).alias("_i")), F.col(label), ["_i"], "_place").select(F.col(label), "_place")
    return rows.join(labels, "_place").select(id_col, label)


def bounded_write(df: DataFrame, key: str, order: list[str], capacity: int) -> DataFrame:
    """What a store of that capacity holds after all rows were written in order: each key's last ones."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_r", place).where(F.col("_r") <= capacity).drop("_r")


def projected(vector: Column, matrix: list[list[float]]) -> Column:
    """The vector's unit length form times a fixed matrix (one row for each output)."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    dot = lambda row: F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in row]), lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x)
    return F.when(norm > 0, F.array(*[dot(row) / F.when(norm > 0, norm) for row in matrix]))


def vector_problems(values: Column, mask: Column) -> Column:
    """Why a masked vector is invalid: length, mask, not_finite, filled (a value where the mask is 0)."""
    pairs = F.arrays_zip(values.alias("v"), mask.alias("m"))
    rules = [
        ("length", F.size(values) != F.size(mask)),
        ("mask", F.exists(mask, lambda m: m.isNull() | ~m.isin(0.0, 1.0))),
        ("not_finite", F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))),
        ("filled", F.exists(pairs, lambda p: (p["m"] == 0.0) & (p["v"] != 0.0))),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules]), lambda x: x.isNotNull())


def without_modality(df: DataFrame, struct: str, names: list[str], rows: Column, reason: str) -> DataFrame:
    """df with the named fields of a struct NULL on the chosen rows, `present` counted again and the reason added to `reasons`."""
    fields = [f.name for f in df.schema[struct].dataType.fields]
    new = F.struct(*[(F.when(~rows, F.col(struct)[f]) if f in names else F.col(struct)[f]).alias(f) for f in fields])
    df = df.withColumn(struct, new)
    present = sum((F.col(struct)[f].isNotNull().cast("int") for f in fields), F.lit(0))
    return df.withColumn("present", present).withColumn("reasons", F.when(rows, F.array_append("reasons", F.lit(reason))).otherwise(F.col("reasons")))
