"""Column builders: exact parsing, guards, ranks and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Full-match ASCII decimal; anything else is no number.
DECIMAL_PATTERN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
#: Unicode words and single marks.
TOKEN_PATTERN = r"(?U)(\w+|[^\w\s])"


def exact_double(text: Column) -> Column:
    """The text's number, NULL unless all of it is a decimal."""
    return F.when(text.rlike(DECIMAL_PATTERN), text.cast("double"))


def number_state(text: Column) -> Column:
    return F.when(text.isNull(), "absent").when(text.rlike(DECIMAL_PATTERN), "number").otherwise("invalid")


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.when(b != 0, a / b)


def float_ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE 754 has it: infinite or NaN where b is zero, where Spark raises an error."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def float_log(a: Column) -> Column:
    """The natural logarithm as IEEE 754 has it: minus infinity of zero and NaN of less, where Spark gives NULL."""
    return F.when(a == 0, float("-inf")).when(a < 0, float("nan")).otherwise(F.log(a))


def ceil_percent(n: Column, percent: int) -> Column:
    """ceil(n * percent / 100) without doubles."""
    total = n.cast("long") * F.lit(percent) + F.lit(99)
    return ((total - F.pmod(total, F.lit(100))) / F.lit(100)).cast("long")


def midrank(partition: list, value: str) -> Column:
    """Mean rank of ties, from 1, within the partition."""
    ordered = Window.partitionBy(*partition).orderBy(value)
    peers = Window.partitionBy(*partition, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / 2.0


def scaled_midrank(partition: list, value: str) -> Column:
    """Midrank scaled to [-1, 1]; 0 in a partition of one row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    return F.when(n > 1, 2.0 * (midrank(partition, value) - 1) / (n - 1) - 1).otherwise(0.0)


def guarded(value: Column, count: Column, minimum: int) -> Column:
    """value where at least `minimum` observations stand behind it."""
    return F.when(count >= minimum, value)


def trailing(window: WindowSpec, length: int) -> WindowSpec:
    return window.rowsBetween(-(length - 1), 0)


def ols_residual_std(y: str, x: str, window: WindowSpec) -> Column:
    """Residual standard deviation of the regression of y on x with intercept, n - 2; NULL without spread of x."""
    pair = F.col(y).isNotNull() & F.col(x).isNotNull()
    a, b = F.when(pair, F.col(x)), F.when(pair, F.col(y))
    n, sx, sy = F.count(a).over(window), F.sum(a).over(window), F.sum(b).over(window)
    sxx, syy, sxy = F.sum(a * a).over(window) - sx * sx / n, F.sum(b * b).over(window) - sy * sy / n, F.sum(a * b).over(window) - sx * sy / n
    return F.when((n > 2) & (sxx > 1e-9), F.sqrt(F.greatest(syy - sxy * sxy / sxx, F.lit(0.0)) / (n - 2)))


def exclusion_reasons(*rules: tuple[str, Column]) -> Column:
    """The names of all rules that hold, in the order given; overlapping reasons are all kept."""
    return F.filter(F.array(*[F.when(rule, name) for name, rule in rules]), lambda x: x.isNotNull())


def symbol(text: Column) -> Column:
    """Upper case, trimmed, the .SH suffix as .SS."""
    return F.regexp_replace(F.upper(F.trim(text)), r"\.SH$", ".SS")


def record_hash(line: Column) -> Column:
    """SHA-256 of a record's text without its line end."""
    return F.sha2(F.regexp_replace(line, r"[\r\n]+$", "").cast("binary"), 256)


def identity(*parts: Column) -> Column:
    """SHA-256 over the parts as compact JSON text."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])).cast("binary"), 256)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(1))


def next_instant_day(ts: Column, zone: str) -> Column:
    """The day of an instant in a zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def half_up(value: Column, digits: int = 2) -> Column:
    """Decimal rounding, halves away from zero."""
    return F.round(value.cast("decimal(38,10)"), digits)


def half_even_multiple(value: Column, step: float) -> Column:
    """The nearest multiple of a step, halves to the even one."""
    return F.bround(value / F.lit(step)) * F.lit(step)


def narrow_widen(centre: Column, corrections: list[Column]) -> list[tuple[Column, Column]]:
    """Intervals around the centre, from narrow to wide, each at least as wide as those before it."""
    out, low, high = [], centre, centre
    for c in corrections:
        low, high = F.least(low, centre - c), F.greatest(high, centre + c)
        out.append((low, high))
    return out


def implied_up_probability(levels: list[float], quantiles: list[Column]) -> Column:
    """1 - F(0) of the distribution that is linear between the quantiles and flat beyond them."""
    out = F.when(quantiles[0] >= 0, 1 - levels[0])
    for (p, a), (q, b) in zip(zip(levels, quantiles, strict=True), list(zip(levels, quantiles, strict=True))[1:], strict=False):
        out = out.when(b >= 0, 1 - (p + (q - p) * F.coalesce(safe_ratio(-a, b - a), F.lit(0.0))))
    return out.otherwise(1 - levels[-1])


def fuzzy_buckets(value: Column, count: int) -> Column:
    """Triangular weights of a value in [0, 1] over `count` neighbouring buckets; they sum to 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.greatest(F.lit(0.0), 1 - F.abs(value * (count - 1) - k)))
