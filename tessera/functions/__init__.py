"""Expressions, as Spark SQL text, whose results follow the usual analytic-SQL conventions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from tessera.plans import double, ident, lit

UNITS = ("day", "hour", "month", "year", "minute", "second", "week")


def ln(x: str) -> str:
    """Natural logarithm: -inf at 0 and NaN below, where Spark's ln gives NULL."""
    return f"(CASE WHEN {x} > 0 THEN ln({x}) WHEN {x} = 0 THEN double('-Infinity') WHEN {x} < 0 THEN double('NaN') END)"


def divided(top: str, bottom) -> str:
    """A quotient by a learned number: NULL where it is 0 or unknown."""
    if bottom is None or bottom == 0:
        return "CAST(NULL AS DOUBLE)"
    return f"({top} / {double(bottom)})"


def clip(x: str, low=None, high=None) -> str:
    """Bounded; NULL stays NULL."""
    y = x
    if high is not None:
        y = f"least({y}, {lit(high)})"
    if low is not None:
        y = f"greatest({y}, {lit(low)})"
    return f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"


def date_diff(unit: str, start: str, end: str) -> str:
    """Boundaries of ``unit`` crossed from start to end (weeks: whole runs of seven day boundaries)."""
    if unit == "year":
        out = f"year({end}) - year({start})"
    elif unit == "month":
        out = f"12 * (year({end}) - year({start})) + month({end}) - month({start})"
    elif unit == "day":
        out = f"datediff(to_date({end}), to_date({start}))"
    elif unit == "week":
        out = f"CAST(datediff(to_date({end}), to_date({start})) / 7 AS BIGINT)"
    else:
        a, b = (f"CAST(date_trunc('{unit}', {x}) AS TIMESTAMP)" for x in (start, end))
        out = f"timestampdiff({unit.upper()}, {a}, {b})"
    return f"CAST({out} AS BIGINT)"


def safe_corr(a: str, b: str) -> str:
    """Pearson correlation over rows where both are known; NULL if either is constant."""
    x, y = (f"CAST(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {c} END AS DOUBLE)" for c in (a, b))
    return f"try_divide(covar_pop({x}, {y}), stddev_pop({x}) * stddev_pop({y}))"


@dataclass(frozen=True)
class Quantile:
    """An exact quantile of an expression, which the pipeline finds by ranks: a value of it, or between the two middle ones."""

    x: str
    q: float
    middle: bool = False

    @property
    def sql(self) -> str:
        """The same as one aggregate, whose state holds all distinct values."""
        return f"median({self.x})" if self.middle else f"percentile_disc({self.q!r}) WITHIN GROUP (ORDER BY {self.x})"

    def ranks(self, n: int) -> tuple[int, int]:
        """The ranks, from 0, that decide it among n values."""
        if self.middle:
            return (n - 1) // 2, n // 2
        r = max(1, min(n, math.ceil(n * self.q))) - 1
        return r, r


def quantile(c: str, q: float) -> Quantile:
    """Discrete quantile: a value of the column."""
    return Quantile(c, q)


def median(c: str) -> Quantile:
    return Quantile(c, 0.5, middle=True)


def norm(columns: list[str], kind: str) -> str:
    xs = [f"CAST({ident(c)} AS DOUBLE)" for c in columns]
    if kind == "l2":
        return f"sqrt({' + '.join(f'{x} * {x}' for x in xs)})"
    if kind == "l1":
        return f"({' + '.join(f'abs({x})' for x in xs)})"
    each = [f"abs({x})" for x in xs]
    return each[0] if len(each) == 1 else f"greatest({', '.join(each)})"


def upper(x: str) -> str:
    """Upper case that keeps the length: a sharp s becomes its capital."""
    return f"upper(replace({x}, 'ß', 'ẞ'))"


def cast(x: str, to: str, from_kind: str) -> str:
    """CAST; doubles round half to even and decimals half away from zero where the target is whole."""
    whole = to.strip().lower().split("(")[0] in {"tinyint", "smallint", "int", "integer", "bigint", "long"}
    if whole and from_kind in ("double", "float"):
        x = f"rint({x})"
    elif whole and from_kind == "decimal":
        x = f"round({x}, 0)"
    elif whole and from_kind == "string":
        x = f"rint(CAST({x} AS DOUBLE))"
    return f"CAST({x} AS {to})"
