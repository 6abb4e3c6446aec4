"""Relational operations a fitted step consists of: each applies to a frame and renders as SQL text."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: How names of views begin that ``to_sql`` makes for learned tables and looked-up frames.
TEMP = "__tessera_"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def lit(value) -> str:
    """SQL text of a literal; numbers become doubles unless they are whole."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"({value})" if -(2**31) <= value < 2**31 else f"({value}L)"
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return f"double('{'NaN' if math.isnan(value) else 'Infinity' if value > 0 else '-Infinity'}')"
        return f"({value!r}D)"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST({lit(str(value))} AS {_sql_type(value)})"


def _sql_type(value) -> str:
    import datetime
    import decimal

    if isinstance(value, decimal.Decimal):
        return f"DECIMAL(38, {max(0, -value.as_tuple().exponent)})"
    if isinstance(value, datetime.datetime):
        return "TIMESTAMP_NTZ" if value.tzinfo is None else "TIMESTAMP"
    if isinstance(value, datetime.date):
        return "DATE"
    return "STRING"


def double(value) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else lit(float(value))


class Op:
    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def sql(self, source: str) -> str:
        raise NotImplementedError

    #: Whether it runs on an unbounded stream.
    streams = True


@dataclass
class Select(Op):
    """(name, SQL text) in output order."""

    items: list[tuple[str, str]]
    windowed: bool = False

    def __post_init__(self):
        self.streams = not self.windowed

    def apply(self, df):
        return df.select(*[F.expr(e).alias(n) for n, e in self.items])

    def sql(self, source):
        return f"SELECT {', '.join(e if e == ident(n) else f'{e} AS {ident(n)}' for n, e in self.items)} FROM {source}"


@dataclass
class Where(Op):
    condition: str

    def apply(self, df):
        return df.where(F.expr(self.condition))

    def sql(self, source):
        return f"SELECT * FROM {source} WHERE {self.condition}"


@dataclass
class Distinct(Op):
    def apply(self, df):
        return df.distinct()

    def sql(self, source):
        return f"SELECT DISTINCT * FROM {source}"


@dataclass
class Top(Op):
    """The first n rows by an expression; each task keeps n at most."""

    by: str
    n: int
    streams = False

    def apply(self, df):
        return df.orderBy(F.expr(self.by)).limit(self.n)

    def sql(self, source):
        return f"SELECT * FROM {source} ORDER BY {self.by} LIMIT {self.n}"


@dataclass
class Join(Op):
    """Equi-join with a second source by same-named keys; ``items`` of l and r give the output."""

    other: DataFrame
    name: str
    keys: list[str]
    how: str
    items: list[tuple[str, str, str]] = field(default_factory=list)

    def apply(self, df):
        left, right = df.alias("l"), self.other.alias("r")
        on = [F.col(f"l.{ident(k)}") == F.col(f"r.{ident(k)}") for k in self.keys]
        return left.join(right, on, self.how).select(*[F.col(f"{side}.{ident(c)}").alias(n) for side, c, n in self.items])

    def __deepcopy__(self, memo) -> Join:
        return Join(self.other, self.name, list(self.keys), self.how, list(self.items))

    def sql(self, source):
        cols = ", ".join(f"{side}.{ident(c)} AS {ident(n)}" for side, c, n in self.items)
        on = " AND ".join(f"l.{ident(k)} = r.{ident(k)}" for k in self.keys)
        return f"SELECT {cols} FROM {source} AS l {self.how.upper()} JOIN {self.name} AS r ON {on}"


def render(ops: list[Op], table: str) -> str:
    """One SELECT with a CTE for each operation but the last."""
    if not ops:
        return f"SELECT * FROM {table}"
    ctes, source = [], table
    for i, op in enumerate(ops[:-1]):
        ctes.append(f"step_{i:02d} AS (\n  {op.sql(source)}\n)")
        source = f"step_{i:02d}"
    last = ops[-1].sql(source)
    return f"WITH {', '.join(ctes)}\n{last}" if ctes else last
