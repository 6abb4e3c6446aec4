"""Column-wise arithmetic, string and date steps."""

from __future__ import annotations

import math

from tessera import functions as fn
from tessera.plans import ident, lit
from tessera.step import Transformer


class _Numeric(Transformer):
    default_columns = "numeric"

    def _map(self, c: str) -> str:
        raise NotImplementedError

    def expressions(self, columns, schema):
        return {c: self._map(ident(c)) for c in columns}


class _Text(_Numeric):
    default_columns = "categorical"


class Log(_Numeric):
    def __init__(self, *, base=None, offset=1, columns=None):
        if base is not None and (base <= 0 or base == 1):
            raise ValueError("base is positive and not 1")
        if offset < 0:
            raise ValueError("offset is 0 or more")
        self.base, self.offset, self.columns = base, offset, columns

    def _map(self, c):
        x = f"CAST({c} AS DOUBLE)"
        e = fn.ln(f"({x} + {lit(float(self.offset))})" if self.offset else x)
        return e if self.base is None else f"({e} / {lit(math.log(self.base))})"


class Sqrt(_Numeric):
    def _map(self, c):
        return f"sqrt({c})"


class Power(_Numeric):
    def __init__(self, *, exponent, columns=None):
        if isinstance(exponent, bool) or not isinstance(exponent, (int, float)):
            raise TypeError("exponent is a number")
        self.exponent, self.columns = exponent, columns

    def _map(self, c):
        return f"pow({c}, {lit(float(self.exponent))})"


class Clip(_Numeric):
    def __init__(self, *, lower=None, upper=None, columns=None):
        if lower is None and upper is None:
            raise ValueError("give lower, upper or both")
        if lower is not None and upper is not None and lower > upper:
            raise ValueError("lower is at most upper")
        self.lower, self.upper, self.columns = lower, upper, columns

    def _map(self, c):
        return fn.clip(c, self.lower, self.upper)


class Abs(_Numeric):
    def _map(self, c):
        return f"abs({c})"


class Round(_Numeric):
    def __init__(self, *, decimals: int = 0, columns=None):
        self.decimals, self.columns = decimals, columns

    def _map(self, c):
        return f"round({c}, {self.decimals})"


class Reciprocal(_Numeric):
    def _map(self, c):
        return f"(1D / nullif(CAST({c} AS DOUBLE), 0D))"


class StringLength(_Text):
    def _map(self, c):
        return f"CAST(length({c}) AS BIGINT)"


class Lower(_Text):
    def _map(self, c):
        return f"lower({c})"


class Upper(_Text):
    def _map(self, c):
        return fn.upper(c)


class Trim(_Text):
    def __init__(self, *, columns=None, characters=None):
        self.columns, self.characters = columns, characters

    def _map(self, c):
        return f"trim({c})" if self.characters is None else f"btrim({c}, {lit(self.characters)})"


class Replace(_Text):
    def __init__(self, *, old: str, new: str, columns=None):
        if not isinstance(old, str) or not isinstance(new, str):
            raise TypeError("old and new are strings")
        if not old:
            raise ValueError("old is not empty")
        self.old, self.new, self.columns = old, new, columns

    def _map(self, c):
        return f"replace({c}, {lit(self.old)}, {lit(self.new)})"


class Substring(_Text):
    def __init__(self, *, start: int, length: int | None = None, columns=None):
        if start < 1 or (length is not None and length < 0):
            raise ValueError("start is 1 or more, length 0 or more")
        self.start, self.length, self.columns = start, length, columns

    def _map(self, c):
        return f"substring({c}, {self.start})" if self.length is None else f"substring({c}, {self.start}, {self.length})"


_PARTS = {"year": "year", "month": "month", "day": "dayofmonth", "hour": "hour", "minute": "minute", "second": "second", "quarter": "quarter", "week": "weekofyear", "dayofyear": "dayofyear"}


def _part(name: str, c: str) -> str:
    e = f"dayofweek({c}) - 1" if name == "dayofweek" else f"{_PARTS[name]}({c})"
    return f"CAST({e} AS BIGINT)"


class DateParts(Transformer):
    """A column for each part; Sunday is day 0 of the week."""

    default_columns = "temporal"

    def __init__(self, *, parts=("year", "month", "day", "dayofweek", "hour"), columns=None):
        parts = list(parts)
        if not parts or (bad := [p for p in parts if p not in _PARTS and p != "dayofweek"]):
            raise ValueError(f"parts are some of {[*_PARTS, 'dayofweek']}" + (f", not {bad}" if parts else ""))
        self.parts, self.columns = parts, columns

    def expressions(self, columns, schema):
        return {f"{c}_{p}": _part(p, ident(c)) for c in columns for p in self.parts}


class DateDiff(Transformer):
    """Boundaries crossed since a date (ISO text) or another column."""

    default_columns = "temporal"

    def __init__(self, *, reference: str, unit: str = "day", columns=None):
        if unit not in fn.UNITS:
            raise ValueError(f"unit is one of {fn.UNITS}")
        self.reference, self.unit, self.columns = reference, unit, columns

    def expressions(self, columns, schema):
        r = self.reference
        start = f"CAST({lit(r)} AS TIMESTAMP_NTZ)" if len(r) >= 8 and r[4] == "-" else ident(r)
        return {c: fn.date_diff(self.unit, start, ident(c)) for c in columns if c != r}


class IsWeekend(_Numeric):
    default_columns = "temporal"

    def _map(self, c):
        return f"(CASE WHEN dayofweek({c}) IN (1, 7) THEN 1 ELSE 0 END)"


class Quarter(_Numeric):
    default_columns = "temporal"

    def _map(self, c):
        return _part("quarter", c)
