"""Published indicators as they were known: vintages, snapshots, derived values with their sources, panels and editions; balance-sheet ratios.

A vintage is (indicator, period, available, expires, value). What is known at a decision is decided by
intervals: a version holds from its availability to the next version's, its expiry or the horizon, which
bounds how many decisions a version is expanded to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import formulas as formula
from tidemark.operators.relational import Refused


def split_conflicts(rows: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(one row a key, conflicting keys): equal repeats are one, unequal ones go to quarantine and are never updates."""
    g = rows.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.count(F.lit(1)).alias("rows"), F.count(value).alias("_k"))
    conflict = ~F.col("_a").eqNullSafe(F.col("_b")) | ((F.col("_k") > 0) & (F.col("_k") < F.col("rows")))
    return g.where(~conflict).select(*keys, F.col("_a").alias(value)), g.where(conflict).select(*keys, "rows")


def intervals(versions: DataFrame, keys: list[str], available: str, expires: str, horizon_days: int) -> DataFrame:
    """versions with `until`: no longer known, whichever comes first of the key's next version, its own expiry and the horizon."""
    after = F.lead(available).over(Window.partitionBy(*keys).orderBy(available))
    return versions.withColumn("until", F.least(after, F.col(expires), F.col(available) + F.make_dt_interval(F.lit(horizon_days))))


def snapshots(versions: DataFrame, by: list[str], period: str, available: str, expires: str, value: str, horizon_days: int, hour: int) -> DataFrame:
    """(by, decision, period, value, available): at each day's decision hour the value of the latest period that is known."""
    known = intervals(versions, [*by, period], available, expires, horizon_days)
    days = F.explode(F.sequence(F.col(available).cast("date"), F.col("until").cast("date")))
    known = known.select(*by, period, available, "until", value, days.alias("_day")).withColumn("decision", F.col("_day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hour)))
    known = known.where((F.col(available) <= F.col("decision")) & (F.col("until") > F.col("decision")))
    top = known.groupBy(*by, "decision").agg(F.max_by(F.struct(period, value, available), period).alias("_top"))
    return top.select(*by, "decision", "_top.*")


def changed_only(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The rows that differ from their key's row before."""
    now = F.struct(*values)
    return df.withColumn("_same", now.eqNullSafe(F.lag(now).over(Window.partitionBy(*keys).orderBy(order)))).where(~F.col("_same")).drop("_same")


def snapshot_values(known: DataFrame, by: str, names: list[str], rules: dict[str, str], value: str, available: str) -> DataFrame:
    """One row a decision: values of the declared indicators and the derived ones, each derived one with its reason, latest availability and the sources it rests on."""
    wide = known.groupBy("decision").agg(F.map_from_entries(F.collect_list(F.struct(by, F.struct(value, available)))).alias("_m"))
    wide = wide.select("decision", *[F.try_element_at("_m", F.lit(n))[value].alias(n) for n in names], *[F.try_element_at("_m", F.lit(n))[available].alias(f"{n}_at") for n in names])
    wide = formula.derive(wide, rules, ["decision"], "decision")
    for name in formula.ordered(rules):
        sources = sorted(formula.closure(rules, [name]) - rules.keys())
        latest = F.greatest(*[F.col(f"{s}_at") for s in sources]) if len(sources) > 1 else F.col(f"{sources[0]}_at")
        wide = wide.withColumns({f"{name}_at": F.when(F.col(name).isNotNull(), latest), f"{name}_sources": F.lit("+".join(sources))})
    return wide


def required(versions: DataFrame, by: str, rules: dict[str, str], wanted: list[str], period: str, history_start: Column) -> DataFrame:
    """The versions that the wanted indicators need: the closure of their dependencies, periods from the start of the history on."""
    names = sorted(formula.closure(rules, wanted) - rules.keys())
    return versions.where(F.col(by).isin(names) & (F.col(period) >= history_start))


def completeness(panel: DataFrame, catalog: DataFrame, sessions: DataFrame, by: str, session: str, valid: Column) -> DataFrame:
    """(session, by, state): complete if a session has exactly one row of a catalogued indicator and it is valid; else missing, repeated or invalid."""
    counts = panel.groupBy(session, by).agg(F.count(F.lit(1)).alias("_n"), F.count_if(valid).alias("_v"))
    every = sessions.crossJoin(F.broadcast(catalog))  # the catalog is a declared list of indicators
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated").when(F.col("_v") == 0, "invalid").otherwise("complete")
    return every.join(counts, [session, by], "left").select(session, by, state.alias("state"))


def replaced(base: DataFrame, editions: DataFrame, by: str, month: Column) -> DataFrame:
    """base with whole indicators of a month taken from the editions where they have that month."""
    there = editions.select(by, month.alias("_month")).distinct()
    kept = base.withColumn("_month", month).join(there, [by, "_month"], "left_anti").drop("_month")
    return kept.unionByName(editions.select(*base.columns))


def spliced(histories: list[tuple[str | None, str | None, DataFrame]], day: str) -> DataFrame:
    """One history from several, each within its bounds (first inclusive, last exclusive, None open); bounds have to adjoin."""
    for (_, stop, _), (start, _, _) in zip(histories, histories[1:], strict=False):
        if stop is None or stop != start:
            raise Refused(f"the histories' bounds {stop} and {start} don't adjoin")
    out = None
    for start, stop, df in histories:
        part = df.where((F.lit(start is None) | (F.col(day) >= F.lit(start))) & (F.lit(stop is None) | (F.col(day) < F.lit(stop))))
        out = part if out is None else out.unionByName(part)
    return out


def extended(base: DataFrame, reviewed: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Both tables by key with `state`: base, reviewed, or shared; a shared key with unequal values is Refused by `checked`."""
    a = base.select(key, F.struct(*values).alias("_a"))
    b = reviewed.select(key, F.struct(*values).alias("_b"))
    state = F.when(F.col("_b").isNull(), "base").when(F.col("_a").isNull(), "reviewed").when(F.col("_a").eqNullSafe(F.col("_b")), "shared").otherwise("conflict")
    return a.join(b, key, "full").select(key, state.alias("state"), F.coalesce("_a", "_b").alias("_v")).select(key, "state", "_v.*")


def checked(edition: DataFrame) -> DataFrame:
    if edition.where("state = 'conflict'").limit(1).count():
        raise Refused("an overlapping session disagrees")
    return edition


def with_metadata(events: DataFrame, metadata: DataFrame, by: str, day: str, first: str, last: str) -> DataFrame:
    """events with the metadata whose range holds their day (NULL where none does); overlapping ranges of a series are Refused.

    Ranges are few for each series: a broadcast equi join with the range as its residual condition.
    """
    w = Window.partitionBy(by).orderBy(first)
    if metadata.withColumn("_next", F.lead(first).over(w)).where(F.col("_next") <= F.col(last)).limit(1).count():
        raise Refused("ranges of a series overlap")
    m = metadata.withColumnRenamed(by, "_by")
    return events.join(F.broadcast(m), (F.col(by) == F.col("_by")) & (F.col(day) >= F.col(first)) & (F.col(day) <= F.col(last)), "left").drop("_by")


def contract_reasons(unit: Column, declared_unit: Column, period: Column, first: Column, last: Column, published: Column) -> Column:
    """Why an observation breaks its declared contract: wrong_unit, before_start, after_end, period_not_over."""
    rules = [("wrong_unit", ~unit.eqNullSafe(declared_unit)), ("before_start", period < first), ("after_end", period > last), ("period_not_over", published < period)]
    return F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules]), lambda x: x.isNotNull())


# The seven balance-sheet ratios, each a sum of signed components over a denominator.
RATIOS = (
    ("current_ratio", (("AssetsCurrent", 1),), "LiabilitiesCurrent"),
    ("working_capital_to_assets", (("AssetsCurrent", 1), ("LiabilitiesCurrent", -1)), "Assets"),
    ("liabilities_to_assets", (("Liabilities", 1),), "Assets"),
    ("equity_to_assets", (("StockholdersEquity", 1),), "Assets"),
    ("receivables_to_assets", (("AccountsReceivableNetCurrent", 1),), "Assets"),
    ("payables_to_assets", (("AccountsPayableCurrent", 1),), "Assets"),
    ("liabilities_to_positive_equity", (("Liabilities", 1),), "StockholdersEquity"),
)
TAGS = ("AccountsPayableCurrent", "AccountsReceivableNetCurrent", "Assets", "AssetsCurrent", "Liabilities", "LiabilitiesCurrent", "StockholdersEquity")


def company_factors(facts: DataFrame, group: list[str], tag: str, value: str, unit: str, available: str, instant: Column, source_unit: str) -> DataFrame:
    """The ratios of each group of facts whenever one of them changes: value, status, numerator, denominator, availability, problems, components.

    A component counts if it is in the source's unit and a stock (`instant`), and if all such facts
    known by then agree; its availability is the earliest. All seven tags' states come from one
    window over the group's arrivals, and the ratios of an arrival are one array.
    """
    good = (F.col(unit) == source_unit) & instant
    by_tag = facts.groupBy(*group, F.col(available).alias("observed"), tag).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(good, F.col(value))).alias("_low"), F.max(F.when(good, F.col(value))).alias("_high"), F.min(F.when(good, F.col(available))).alias("_first")
    )
    pick = lambda agg, c, t: agg(F.when(F.col(tag) == t, F.col(c)))
    arrivals = by_tag.groupBy(*group, "observed").agg(*[x for t in TAGS for x in (pick(F.sum, "_n", t).alias(f"n_{t}"), pick(F.min, "_low", t).alias(f"l_{t}"), pick(F.max, "_high", t).alias(f"h_{t}"), pick(F.min, "_first", t).alias(f"f_{t}"))])
    so_far = Window.partitionBy(*group).orderBy("observed").rowsBetween(Window.unboundedPreceding, 0)
    known = arrivals.select(*group, "observed", *[x for t in TAGS for x in (F.sum(f"n_{t}").over(so_far).alias(f"n_{t}"), F.min(f"l_{t}").over(so_far).alias(f"l_{t}"), F.max(f"h_{t}").over(so_far).alias(f"h_{t}"), F.min(f"f_{t}").over(so_far).alias(f"f_{t}"))])
    problem = {t: F.when(F.col(f"n_{t}").isNull(), "missing_component").when(F.col(f"l_{t}").isNull(), "incompatible_component").when(F.col(f"l_{t}") != F.col(f"h_{t}"), "ambiguous_component") for t in TAGS}
    chosen = {t: F.when(problem[t].isNull(), F.col(f"l_{t}")) for t in TAGS}
    out = []
    for name, terms, below in RATIOS:
        tags = sorted({t for t, _ in terms} | {below})
        numerator, denominator = sum((chosen[t] * sign for t, sign in terms), F.lit(0.0)), chosen[below]
        first_problem = F.coalesce(*[problem[t] for t in tags])
        ratio = numerator / F.when(denominator > 0, denominator)
        odd = F.isnan(ratio) | (F.abs(ratio) == float("inf"))
        status = F.coalesce(first_problem, F.when(denominator <= 0, "nonpositive_denominator"), F.when(odd, "nonfinite_result"), F.lit("accepted"))
        last = F.greatest(*[F.col(f"f_{t}") for t in tags])
        problems = F.filter(F.array(*[F.when(problem[t].isNotNull(), F.concat(F.lit(f"{t}:"), problem[t])) for t in tags]), lambda x: x.isNotNull())
        components = F.filter(F.array(*[F.when(problem[t].isNull(), F.struct(F.lit(t).alias("tag"), chosen[t].alias("value"), F.col(f"f_{t}").alias("available_at"))) for t in tags]), lambda x: x.isNotNull())
        out.append(
            F.struct(
                F.lit(name).alias("ratio"), status.alias("status"), F.when(status == "accepted", ratio).alias("value"), numerator.alias("numerator"), denominator.alias("denominator"),
                F.when(status == "accepted", last).otherwise(F.col("observed")).alias("available_at"), problems.alias("problems"), components.alias("components"),
            )
        )
    rows = known.select(*group, "observed", F.explode(F.array(*out)).alias("r")).select(*group, "observed", "r.*")
    return changed_only(rows, [*group, "ratio"], "observed", ["status", "value", "numerator", "denominator", "available_at", "problems", "components"])
