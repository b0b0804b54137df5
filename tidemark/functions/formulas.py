"""A compiler from formula text to columns over a panel of indicators.

Grammar, by rising strength: `+ -`, `* /`, a leading `-`, `^` with an exponent from 1 to 4; operands are
numbers from 0 to MOST, indicators, `x[p-3]`, `mean(x[p-4:p-1])`, `growth(x, 4)` and parentheses. `p` is the
row's period; windows are counted in rows of the key's ordered panel. Texts, operands and offsets are
limited, and whatever isn't in the grammar is a FormulaError. Every step carries a coded reason for a
missing result: source_missing, zero_denominator, nonpositive_growth_input, nonfinite_calculation.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Limits of a formula: characters, operands, the largest number and the farthest period back.
LENGTH, OPERANDS, MOST, BACK = 500, 60, 100.0, 52
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<mark>[-+*/^()\[\]:,]))")


class FormulaError(ValueError):
    pass


@dataclass
class _Value:
    value: Column
    reason: Column


#: An operand or operation waits for the window that the panel's keys give.
_Node = Callable[[WindowSpec], _Value]


class _Parser:
    """Precedence climbing over the tokens; every rule returns a node and notes the indicators it meets."""

    def __init__(self, text: str) -> None:
        if not isinstance(text, str):
            raise FormulaError("a formula is a text")
        if len(text) > LENGTH:
            raise FormulaError("the formula is too long")
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise FormulaError(f"unreadable at {text[at : at + 10]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at, self.operands = 0, 0
        self.names: set[str] = set()
        self.node = self.sum()
        if self.at < len(self.tokens):
            raise FormulaError(f"nothing may follow: {self.tokens[self.at][1]!r}")

    def next_is(self, *marks: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "mark" and self.tokens[self.at][1] in marks:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, mark: str) -> None:
        if not self.next_is(mark):
            raise FormulaError(f"{mark!r} is missing")

    def take(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise FormulaError(f"a {kind} is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self, most: int) -> int:
        text = self.take("number")
        if "." in text or int(text) > most:
            raise FormulaError(f"{text} isn't a whole number up to {most}")
        return int(text)

    def sum(self) -> _Node:
        left = self.product()
        while mark := self.next_is("+", "-"):
            left = _both(left, self.product(), (lambda a, b: a + b) if mark == "+" else (lambda a, b: a - b))
        return left

    def product(self) -> _Node:
        left = self.signed()
        while mark := self.next_is("*", "/"):
            right = self.signed()
            left = _both(left, right, lambda a, b: a * b) if mark == "*" else _ratio(left, right)
        return left

    def signed(self) -> _Node:
        if not self.next_is("-"):
            return self.power()
        inner = self.signed()
        return lambda w: _Value(-(v := inner(w)).value, v.reason)

    def power(self) -> _Node:
        base = self.operand()
        if not self.next_is("^"):
            return base
        exponent = self.whole(4)
        if not exponent:
            raise FormulaError("exponents are 1 to 4")
        return lambda w: _Value(F.pow((v := base(w)).value, float(exponent)), v.reason)

    def operand(self) -> _Node:
        self.operands += 1
        if self.operands > OPERANDS:
            raise FormulaError("the formula has too many operands")
        if self.next_is("("):
            inner = self.sum()
            self.need(")")
            return inner
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "number":
            number = float(self.take("number"))
            if number > MOST:
                raise FormulaError(f"numbers are 0 to {MOST:g}")
            return lambda w: _Value(F.lit(number), F.lit(None).cast("string"))
        name = self.take("name")
        if name in ("mean", "growth") and self.next_is("("):
            node = self.mean() if name == "mean" else self.growth()
            self.need(")")
            return node
        self.indicator(name)
        if not self.next_is("["):
            return lambda w: _Value(F.col(name), F.when(F.col(name).isNull(), "source_missing"))
        back = self.period()
        self.need("]")
        return _back(name, back)

    def indicator(self, name: str) -> str:
        if name == "p":
            raise FormulaError(f"{name} is no indicator")
        self.names.add(name)
        return name

    def period(self) -> int:
        if self.take("name") != "p":
            raise FormulaError("periods are p or p-k")
        return self.whole(BACK) if self.next_is("-") else 0

    def mean(self) -> _Node:
        name = self.indicator(self.take("name"))
        self.need("[")
        first = self.period()
        self.need(":")
        last = self.period()
        self.need("]")
        if first < last:
            raise FormulaError("a range begins before it ends")

        def node(w: WindowSpec) -> _Value:
            span, size = w.rowsBetween(-first, -last), first - last + 1
            n = F.count(name).over(span)
            return _Value(F.when(n == size, F.avg(name).over(span)), F.when(n < size, "source_missing"))

        return node

    def growth(self) -> _Node:
        name = self.indicator(self.take("name"))
        self.need(",")
        before = _back(name, self.whole(BACK))

        def node(w: WindowSpec) -> _Value:
            now, old = F.col(name), before(w)
            missing = F.when(now.isNull(), "source_missing")
            low = F.when((now <= 0) | (old.value <= 0), "nonpositive_growth_input")
            return _Value(F.when((now > 0) & (old.value > 0), F.log(F.when(now > 0, now) / F.when(old.value > 0, old.value))), F.coalesce(missing, old.reason, low))

        return node


def _back(name: str, periods: int) -> _Node:
    def node(w: WindowSpec) -> _Value:
        value = F.lag(name, periods).over(w) if periods else F.col(name)
        return _Value(value, F.when(value.isNull(), "source_missing"))

    return node


def _both(left: _Node, right: _Node, join: Callable[[Column, Column], Column]) -> _Node:
    def node(w: WindowSpec) -> _Value:
        a, b = left(w), right(w)
        return _Value(join(a.value, b.value), F.coalesce(a.reason, b.reason))

    return node


def _ratio(left: _Node, right: _Node) -> _Node:
    def node(w: WindowSpec) -> _Value:
        a, b = left(w), right(w)
        return _Value(F.when(b.value != 0, a.value / F.when(b.value != 0, b.value)), F.coalesce(a.reason, b.reason, F.when(b.value == 0, "zero_denominator")))

    return node


def names_of(text: str) -> set[str]:
    """The indicators that a formula uses."""
    return _Parser(text).names


def closure(formulas: dict[str, str], wanted: list[str]) -> set[str]:
    """The wanted indicators and all that they are derived from."""
    out, todo = set(), list(wanted)
    while todo:
        name = todo.pop()
        if name not in out:
            out.add(name)
            todo += names_of(formulas[name]) if name in formulas else ()
    return out


def ordered(formulas: dict[str, str]) -> list[str]:
    """Derived names so that each follows what it uses; a cycle is an error."""
    uses = {name: names_of(text) & formulas.keys() for name, text in formulas.items()}
    out: list[str] = []
    while len(out) < len(uses):
        ready = [n for n in uses if n not in out and uses[n] <= set(out)]
        if not ready:
            raise FormulaError(f"{sorted(set(uses) - set(out))} depend on themselves")
        out += ready
    return out


def derive(panel: DataFrame, formulas: dict[str, str], keys: list[str], order: str) -> DataFrame:
    """panel with each formula's value and `<name>_reason`, in dependency order."""
    window = Window.partitionBy(*keys).orderBy(order)
    for name in ordered(formulas):
        parsed = _Parser(formulas[name])
        missing = parsed.names - set(panel.columns)
        if missing:
            raise FormulaError(f"{name} uses unknown {sorted(missing)}")
        found = parsed.node(window)
        odd = found.value.isNotNull() & (F.isnan(found.value) | (F.abs(found.value) == float("inf")))
        panel = panel.withColumns({name: F.when(found.reason.isNull() & ~odd, found.value), f"{name}_reason": F.coalesce(found.reason, F.when(odd, "nonfinite_calculation"))})
    return panel
