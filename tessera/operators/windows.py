"""Window steps: ascending order, NULLs last.

Without ``partition_by`` a window spans the whole frame, which a plain plan would sort in one task.
Such steps learn, at fit time, approximate quantiles of the order column; at transform time these cut
the frame into ranges that are numbered side by side, and shifts and rolling frames then work
on blocks of consecutive numbers, each with the few rows beyond its edge that it needs. The quantiles
decide balance, not results. Orders by several columns, or by text, take the plain plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import MissingColumnError
from tessera.plans import Op, Select, ident, lit
from tessera.schema import RESERVED
from tessera.step import Transformer

#: Ranges a global window is cut into, and rows of a block.
RANGES = 256
BLOCK_ROWS = 1 << 20


@dataclass
class GlobalWindow(Op):
    """New columns over the whole frame in the order of one column, without gathering it in one task.

    ``new``: name -> SQL with ``{over}`` for the window. ``before``, ``after``: rows on either side that
    a row's value may need; None for numbering functions.
    """

    plain: Select
    new: dict[str, str]
    order: str
    key: str
    bounds: list[float]
    reach: tuple[int, int] | None = None
    frame: str = ""
    block_rows: int = field(default=BLOCK_ROWS)
    streams = False

    def sql(self, source: str) -> str:
        return self.plain.sql(source)

    def apply(self, df: DataFrame) -> DataFrame:
        bucket, first, place, block = (RESERVED + n for n in ("bucket", "first", "place", "block"))
        # a search in two steps, over the last bound of each run and then within the run
        step = max(1, math.isqrt(len(self.bounds)))
        runs = [self.bounds[i : i + step] for i in range(0, len(self.bounds), step)]
        array = lambda xs: f"array({', '.join(map(lit, xs))})"
        run = RESERVED + "run"
        below = f"CASE WHEN {self.key} IS NULL THEN -1 ELSE size(filter({array([r[-1] for r in runs])}, b -> b < {self.key})) END"
        within = f"size(filter(get(array({', '.join(map(array, runs))}), {ident(run)}), b -> b < {self.key}))"
        cut = f"CASE WHEN {ident(run)} < 0 THEN {len(self.bounds) + 1} WHEN {ident(run)} = {len(runs)} THEN {len(self.bounds)} ELSE {step} * {ident(run)} + {within} END"
        if not runs:  # the order column has no value
            below, cut = f"CASE WHEN {self.key} IS NULL THEN -1 ELSE 0 END", f"CASE WHEN {ident(run)} < 0 THEN 1 ELSE 0 END"
        cut_df = df.withColumn(run, F.expr(below)).withColumn(bucket, F.expr(cut)).drop(run)
        dense = any("dense_rank" in e for e in self.new.values())
        size = F.count_distinct(F.struct(ident(self.order))) if dense else F.count(F.lit(1))
        sizes = cut_df.groupBy(bucket).agg(size.alias(first))
        # a row for each range: at most RANGES + 1, so this window and the broadcast have a fixed bound
        sizes = sizes.withColumn(first, F.coalesce(F.sum(first).over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        numbered = cut_df.join(F.broadcast(sizes), bucket)
        over = f"OVER (PARTITION BY {ident(bucket)} ORDER BY {ident(self.order)} ASC NULLS LAST)"
        if self.reach is None:
            return numbered.select(*[F.col(ident(c)) for c in df.columns], *[F.expr(f"{ident(first)} + CAST({e.format(over=over)} AS BIGINT)").alias(n) for n, e in self.new.items()])
        before, after = self.reach
        numbered = numbered.withColumn(place, F.expr(f"{ident(first)} + row_number() {over} - 1")).drop(bucket, first)
        size = max(self.block_rows, before + after + 1)
        at = lambda shift: F.expr(f"({ident(place)} + {shift}) div {size}")
        copied = numbered.withColumn(block, F.explode(F.array_distinct(F.array(at(0), at(before), F.greatest(at(-after), F.lit(0))))))
        new = [F.expr(e.format(over=f"OVER (PARTITION BY {ident(block)} ORDER BY {ident(place)}{self.frame})")).alias(n) for n, e in self.new.items()]
        out = copied.select(*[F.col(ident(c)) for c in [*df.columns, place, block]], *new)
        return out.where(F.col(block) == at(0)).drop(place, block)


def _list(x) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


class _Windowed(Transformer):
    default_columns = "numeric"

    reach: tuple[int, int] | None = None

    def _check(self, order_by, partition_by):
        self.order_by, self.partition_by = order_by, partition_by
        if not _list(order_by):
            raise ValueError("order_by names a column")
        self.learns = self.reshapes = not _list(partition_by) and len(_list(order_by)) == 1

    def _key(self, schema) -> str | None:
        """The order column as a number, if it has an order of numbers."""
        c = _list(self.order_by)[0]
        if c not in schema:
            raise MissingColumnError(c, schema.columns)
        kind = schema.column_category(c)
        if kind == "numeric":
            return f"CAST({ident(c)} AS DOUBLE)"
        return f"CAST(CAST({ident(c)} AS TIMESTAMP) AS DOUBLE)" if schema[c].typeName() in ("date", "timestamp", "timestamp_ntz") else None

    def discover(self, columns, schema, y):
        if not self.learns or (key := self._key(schema)) is None:
            return {}
        qs = ", ".join(f"{i / RANGES!r}D" for i in range(1, RANGES))
        return {"bounds": f"approx_percentile({key}, array({qs}), 2000)"}

    def _over(self, schema, order=None, frame: str = "") -> str:
        keys, order = _list(self.partition_by), _list(self.order_by) if order is None else order
        for c in [*keys, *order]:
            if c not in schema:
                raise MissingColumnError(c, schema.columns)
        part = f"PARTITION BY {', '.join(map(ident, keys))} " if keys else ""
        return f"OVER ({part}ORDER BY {', '.join(f'{ident(c)} ASC NULLS LAST' for c in order)}{frame})"

    def _new(self, columns, schema) -> dict[str, str]:
        raise NotImplementedError

    def query(self, columns, schema):
        new = self._new(columns, schema)
        key = self._key(schema) if self.learns else None
        plain = Select([(c, ident(c)) for c in schema if c not in new] + list(new.items()), windowed=True)
        if key is not None and self._global() and not set(new) & set(schema) and new:
            bounds = sorted(set(self.params_.get("bounds") or []))
            return [GlobalWindow(plain, {n: self._template(e, schema) for n, e in new.items()}, _list(self.order_by)[0], key, bounds, self.reach, self._frame())]
        return [plain]

    def _global(self) -> bool:
        return True

    def _template(self, e: str, schema) -> str:
        """The expression with its window left open."""
        return e.replace("CAST(" + self._numbering() + "() " + self._over(schema) + " AS BIGINT)", self._numbering() + "() {over}") if self._numbering() else e.replace(self._over(schema), "{over}")

    def _numbering(self) -> str:
        return ""

    def _frame(self) -> str:
        return ""


class _Shift(_Windowed):
    def __init__(self, *, periods: int = 1, order_by, partition_by=None, columns=None):
        if isinstance(periods, bool) or not isinstance(periods, int) or periods < 1:
            raise ValueError("periods is 1 or more")
        self._check(order_by, partition_by)
        self.periods, self.columns = periods, columns
        self.reach = (periods, 0) if type(self).__name__ == "Lag" else (0, periods)

    def _new(self, columns, schema):
        f = type(self).__name__.lower()
        return {f"{c}_{f}{self.periods}": f"{f}({ident(c)}, {self.periods}) {self._over(schema)}" for c in columns}


class Lag(_Shift):
    """Values of earlier rows."""


class Lead(_Shift):
    """Values of later rows."""


class _Rolling(_Windowed):
    function, short = "", ""

    def __init__(self, *, window: int, order_by, partition_by=None, columns=None):
        if isinstance(window, bool) or not isinstance(window, int) or window < 2:
            raise ValueError("window is 2 or more")
        self._check(order_by, partition_by)
        self.window, self.columns = window, columns
        self.reach = (window - 1, 0)

    def _template(self, e, schema):
        return e.replace(self._over(schema, frame=self._frame()), "{over}")

    def _frame(self):
        return f" ROWS BETWEEN {self.window - 1} PRECEDING AND CURRENT ROW"

    def _new(self, columns, schema):
        over = self._over(schema, frame=self._frame())
        return {f"{c}_{self.short}{self.window}": f"{self.function}(CAST({ident(c)} AS DOUBLE)) {over}" for c in columns}


class RollingMean(_Rolling):
    function, short = "avg", "rmean"


class RollingStd(_Rolling):
    function, short = "stddev_pop", "rstd"


class Rank(_Windowed):
    """``columns`` given: a rank by each of them; else one by ``order_by``."""

    def __init__(self, *, order_by, partition_by=None, method: str = "rank", columns=None):
        if method not in ("rank", "dense_rank", "row_number"):
            raise ValueError("method is rank, dense_rank or row_number")
        self._check(order_by, partition_by)
        self.method, self.columns = method, columns
        self.learns = self.reshapes = self.learns and columns is None

    def _global(self):
        return self.columns is None

    def _numbering(self):
        return self.method

    def _new(self, columns, schema):
        if self.columns is None:
            return {"rank": f"CAST({self.method}() {self._over(schema)} AS BIGINT)"}
        return {f"{c}_rank": f"CAST({self.method}() {self._over(schema, [c])} AS BIGINT)" for c in columns}


class RowNumber(_Windowed):
    def __init__(self, *, order_by, partition_by=None):
        self._check(order_by, partition_by)

    def _numbering(self):
        return "row_number"

    def _new(self, columns, schema):
        return {"row_number": f"CAST(row_number() {self._over(schema)} AS BIGINT)"}
