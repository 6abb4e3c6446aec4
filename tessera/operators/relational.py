"""Joining and stacking sources, before or within a pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import MissingColumnError, NotFittedError, SchemaError
from tessera.plans import TEMP, Join, ident
from tessera.sources import resolve_input, session
from tessera.step import Transformer

HOW = ("inner", "left", "right", "outer", "cross")


def _keys(x) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def merge(left, right, *, on=None, left_on=None, right_on=None, how: str = "inner", suffix: tuple[str, str] = ("_left", "_right"), backend: SparkSession | None = None) -> DataFrame:
    """Equi-join (or cross join) of two sources.

    By ``on`` a key comes out once, from the left side, so it is NULL on rows only the right
    has. By ``left_on``/``right_on`` both sides' keys come out. Other names that both sides have
    get the suffixes. NULL keys never match.
    """
    if how not in HOW:
        raise ValueError(f"how is one of {HOW}")
    both, lk, rk = _keys(on), _keys(left_on), _keys(right_on)
    if how == "cross":
        if both or lk or rk:
            raise ValueError("a cross join has no keys")
    elif both and (lk or rk):
        raise ValueError("give on, or left_on and right_on")
    elif not both and (not lk or len(lk) != len(rk)):
        raise ValueError("give on, or left_on and right_on of one length")
    ldf, rdf = resolve_input(left, backend), resolve_input(right, backend)
    lk, rk = (both, both) if both else (lk, rk)
    for df, keys in ((ldf, lk), (rdf, rk)):
        for k in keys:
            if k not in df.columns:
                raise MissingColumnError(k, df.columns)
    once = set(both)
    shared = (set(ldf.columns) & set(rdf.columns)) - once
    items = [("l", c, c + suffix[0] if c in shared else c) for c in ldf.columns]
    items += [("r", c, c + suffix[1] if c in shared else c) for c in rdf.columns if c not in once]
    if len({n for _, _, n in items}) < len(items):
        raise SchemaError(f"two output columns have one name: {[n for _, _, n in items]}")
    a, b = ldf.alias("l"), rdf.alias("r")
    if how == "cross":
        out = a.crossJoin(b)
    else:
        out = a.join(b, [F.col(f"l.{ident(x)}") == F.col(f"r.{ident(y)}") for x, y in zip(lk, rk, strict=True)], how)
    return out.select(*[F.col(f"{side}.{ident(c)}").alias(n) for side, c, n in items])


merge_query = merge  # a frame is its plan: explain() shows it


def concat(*sources, align: bool = False, backend: SparkSession | None = None) -> DataFrame:
    """Rows of all sources, columns by name; ``align`` fills columns that a source lacks with NULL."""
    if len(sources) < 2:
        raise ValueError("concat takes two sources or more")
    frames = [resolve_input(s, backend) for s in sources]
    for df in frames[1:]:
        if not align and set(df.columns) != set(frames[0].columns):
            raise SchemaError(f"columns differ: {frames[0].columns} and {df.columns}")
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=align)
    return out


concat_query = concat


class Lookup(Transformer):
    """Columns of a second source by same-named keys. Repeated keys there repeat rows here.

    How the sides meet is left to Catalyst, which broadcasts a side only under the session's
    size limit.
    """

    def __init__(self, source, *, on, select=None, how: str = "left", suffix: str = "_lookup"):
        if how not in ("left", "inner"):
            raise ValueError("how is left or inner")
        if not _keys(on):
            raise ValueError("on names a key")
        self.source, self.on, self.select, self.how, self.suffix = source, on, select, how, suffix

    def prepare(self, spark):
        self._df = resolve_input(self.source, session(spark))
        for k in [*_keys(self.on), *(self.select or [])]:
            if k not in self._df.columns:
                raise MissingColumnError(k, self._df.columns)

    def query(self, columns, schema):
        if self._df is None:
            if not isinstance(self.source, str):
                raise NotFittedError("a looked-up frame doesn't travel with a pickle; name a table or a path")
            self._df = resolve_input(self.source, session())
        keys = _keys(self.on)
        for k in keys:
            if k not in schema:
                raise MissingColumnError(k, schema.columns)
        wanted = [c for c in (self.select or self._df.columns) if c not in keys]
        items = [("l", c, c) for c in schema] + [("r", c, c + self.suffix if c in schema else c) for c in wanted]
        name = f"{TEMP}lookup"
        other = self._df.select(*[F.col(ident(c)) for c in dict.fromkeys([*keys, *wanted])])
        return [Join(other, name, keys, self.how, items)]
