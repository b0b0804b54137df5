"""Inputs of a decision: admission, usability, views with variables removed, numeric contexts, price windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.relational import Refused


def violations(cutoff: Column, available: dict[str, Column]) -> Column:
    """The modalities that are absent or not available by the cutoff, in the order given."""
    return F.filter(F.array(*[F.when(at.isNull() | (at > cutoff), name) for name, at in available.items()]), lambda x: x.isNotNull())


def admitted(df: DataFrame, cutoff: str, available: list[str]) -> DataFrame:
    """df, or Refused if a row uses something that was not known at its cutoff: a leak is never repaired."""
    bad = violations(F.col(cutoff), {a: F.col(a) for a in available})
    if df.where(F.size(bad) > 0).limit(1).count():
        raise Refused("an input is available only after its decision")
    return df


def usability(value: Column, available_at: Column, cutoff: Column) -> Column:
    """(value, age_days, reason): a value with its age, or none with a coded reason."""
    reason = F.when(value.isNull() | F.isnan(value), "missing_value").when(available_at.isNull(), "unknown_publication").when(available_at > cutoff, "not_yet_available")
    age = (F.unix_micros(cutoff) - F.unix_micros(available_at)) / 86_400e6
    return F.struct(F.when(reason.isNull(), value).alias("value"), F.when(reason.isNull(), age).alias("age_days"), reason.alias("reason"))


def closed_under(dependencies: dict[str, set[str]], dropped: set[str]) -> set[str]:
    """The variables to drop with `dropped`: all that depend on one of them."""
    out = set(dropped)
    while True:
        more = {name for name, uses in dependencies.items() if uses & out} - out
        if not more:
            return out
        out |= more


def without(vector: Column, places: list[int]) -> Column:
    """The vector with the places zero; its width stays."""
    drop = F.array(*[F.lit(p) for p in places]) if places else F.array().cast("array<int>")
    return F.transform(vector, lambda x, i: F.when(F.array_contains(drop, i), F.lit(0.0)).otherwise(x))


def projected(names: Column, values: Column, target: list[str]) -> Column:
    """Values by name in the target's order; absent names are zero."""
    m = F.map_from_arrays(names, values)
    return F.array(*[F.coalesce(F.try_element_at(m, F.lit(t)), F.lit(0.0)) for t in target])


def numeric_context(values: Column, ages: Column) -> Column:
    """Signed log levels, presence masks and log ages, one after the other."""
    level = F.transform(values, lambda x: F.coalesce(F.signum(x) * F.log1p(F.abs(x)), F.lit(0.0)))
    mask = F.transform(values, lambda x: x.isNotNull().cast("double"))
    age = F.transform(ages, lambda a: F.coalesce(F.log1p(a), F.lit(0.0)))
    return F.concat(level, mask, age)


def long_to_vector(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One row a key: the values of the declared names in order (NULL where absent)."""
    m = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias("_m"))
    return m.select(*keys, F.array(*[F.try_element_at("_m", F.lit(n)) for n in names]).alias("vector"))


def price_window(df: DataFrame, keys: list[str], order: str, place: str, columns: list[str], length: int, name: str) -> DataFrame:
    """The rows of the last `length` places of a dense axis as an array of structs, absent places left out and `present` counted."""
    w = Window.partitionBy(*keys).orderBy(place).rangeBetween(-(length - 1), 0)
    return df.withColumn(name, F.collect_list(F.struct(F.col(place), *columns)).over(w)).withColumn("present", F.size(name))


def window_features(window: Column, price: str, volume: str) -> Column:
    """Per slot: log of price over the window's first, log1p of volume over its mean."""
    anchor = F.element_at(window, 1)[price]
    mean = F.aggregate(window, F.lit(0.0), lambda a, x: a + x[volume]) / F.size(window)
    return F.transform(window, lambda x: F.struct(F.log(x[price] / anchor).alias("level"), F.log1p(x[volume] / mean).alias("turnover")))


def gated(prediction: Column, *factors: Column) -> Column:
    """prediction times the first factor that is defined; zero if none is."""
    return F.coalesce(*factors, F.lit(0.0)) * prediction


def neutral(median: Column, low: Column, high: Column) -> Column:
    """The median where the interval excludes zero, else zero."""
    return F.when((low > 0) | (high < 0), median).otherwise(0.0)
