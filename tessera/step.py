"""The base of all pipeline steps."""

from __future__ import annotations

import copy as _copy
import inspect
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import NotFittedError
from tessera.plans import Op, Select, ident
from tessera.schema import Schema, resolve_columns


@dataclass(frozen=True)
class ValueCounts:
    """A column's values as strings, with their counts: the first ``most`` by name, or all of them.

    For ``whole`` ones with more than ``most`` values, the step gets a table (value, count, place) in
    ``tables_``, place being the number in the order of values, and the driver none of its rows.
    """

    column: str
    most: int
    whole: bool = False


class Transformer:
    """A step. Subclasses override some of:

    ``discover``      scalar aggregates to learn: name -> Column, SQL text or Quantile
    ``discover_sets`` row sets to learn: name -> ValueCounts, or a function of the frame (small results)
    ``expressions``   SQL text by output column; other columns pass through
    ``removes``       input columns that don't pass through
    ``outputs``       the names ``expressions`` may add, if declared; others are left out with a warning
    ``query``         a list of operations instead of ``expressions``
    """

    default_columns: str | None = None
    #: Learns at fit time.
    learns = False
    #: The columns or types after the step are known only when it is fitted, so the next learner waits for it.
    reshapes = False

    def __init__(self, *, columns=None):
        self.columns = columns

    # hooks
    def discover(self, columns: list[str], schema: Schema, y: str | None) -> dict[str, Column | str]:
        return {}

    def discover_sets(self, columns: list[str], schema: Schema, y: str | None) -> dict[str, ValueCounts | Callable[[DataFrame], DataFrame]]:
        return {}

    def expressions(self, columns: list[str], schema: Schema) -> dict[str, str]:
        return {}

    def removes(self, columns: list[str], schema: Schema) -> list[str]:
        return []

    def outputs(self, columns: list[str], schema: Schema) -> list[str] | None:
        return None

    def query(self, columns: list[str], schema: Schema) -> list[Op] | None:
        return None

    def prepare(self, spark) -> None:
        """Called before anything else at fit time."""

    # what the pipeline calls
    def route(self, schema: Schema) -> list[str]:
        spec = getattr(self, "columns", None)
        if spec is None:
            spec = self.default_columns
        return schema.columns if spec is None else resolve_columns(schema, spec)

    def reset(self) -> None:
        self.params_: dict = {}
        self.sets_: dict[str, list[dict]] = {}
        self.tables_: dict[str, DataFrame] = {}
        for name in ("columns_", "input_schema_", "output_schema_", "ops_"):
            self.__dict__.pop(name, None)

    def ops(self, schema: Schema) -> list[Op]:
        """The fitted step's operations over a frame of this schema."""
        cols = [c for c in self.columns_ if c in schema]
        own = self.query(cols, schema)
        if own is not None:
            return own
        new, gone, declared = self.expressions(cols, schema), set(self.removes(cols, schema)), self.outputs(cols, schema)
        if declared is not None and (odd := [c for c in new if c not in declared and c not in schema]):
            warnings.warn(f"{type(self).__name__}.expressions adds {odd}, which its outputs don't declare; they are left out", UserWarning, stacklevel=2)
            new = {c: e for c, e in new.items() if c not in odd}
        items = [(c, new.get(c, ident(c))) for c in schema if c not in gone]
        items += [(c, e) for c, e in new.items() if c not in schema or c in gone]
        return [Select(items)]

    # introspection
    @classmethod
    def _names(cls) -> list[str]:
        return [p.name for p in inspect.signature(cls.__init__).parameters.values() if p.name != "self" and p.kind not in (p.VAR_POSITIONAL, p.VAR_KEYWORD)]

    def get_params(self, deep: bool = True) -> dict:
        return {n: getattr(self, n) for n in self._names() if hasattr(self, n)}

    def set_params(self, **params) -> Transformer:
        for n, v in params.items():
            if n not in self._names():
                raise ValueError(f"{type(self).__name__} has no parameter {n!r}")
            setattr(self, n, v)
        return self

    def clone(self) -> Transformer:
        """A copy that has learned nothing."""
        new = _copy.copy(self)
        new.__dict__ = {k: v for k, v in self.__dict__.items() if not k.endswith("_") or k.startswith("_") or k in self._names()}
        return new

    def copy(self) -> Transformer:
        return _copy.deepcopy(self)

    def __deepcopy__(self, memo) -> Transformer:
        new = memo[id(self)] = _copy.copy(self)
        new.__dict__ = {k: v if isinstance(v, DataFrame) else dict(v) if k == "tables_" else _copy.deepcopy(v, memo) for k, v in self.__dict__.items() if k != "_pipeline"}
        return new

    def __getstate__(self) -> dict:
        """What was learned, without plans and frames, which belong to a session."""
        return {k: None if isinstance(v, DataFrame) else {} if k == "tables_" else v for k, v in self.__dict__.items() if k not in ("ops_", "_pipeline")}

    def __sklearn_is_fitted__(self) -> bool:
        return hasattr(self, "columns_")

    def get_feature_names_out(self) -> list[str]:
        if not self.__sklearn_is_fitted__():
            raise NotFittedError(f"{type(self).__name__} is not fitted")
        return self.output_schema_.columns

    def __add__(self, other):
        from tessera.pipeline import Pipeline

        return Pipeline([self]) + other

    def __repr__(self) -> str:
        defaults = {p.name: p.default for p in inspect.signature(type(self).__init__).parameters.values()}
        shown = [f"{n}={v!r}" for n, v in self.get_params().items() if v is not defaults.get(n) and v != defaults.get(n)]
        return f"{type(self).__name__}({', '.join(shown)})"

    # a step alone is a pipeline of one
    def _alone(self):
        from tessera.pipeline import Pipeline

        self._pipeline = getattr(self, "_pipeline", None) or Pipeline([self])
        if hasattr(self, "output_schema_") and not self._pipeline.__sklearn_is_fitted__():
            self._pipeline.restore()
        return self._pipeline

    def fit(self, data, y: str | None = None, *, spark=None) -> Transformer:
        self._alone().fit(data, y, spark=spark)
        return self

    def transform(self, data, *, spark=None) -> DataFrame:
        return self._alone().transform(data, spark=spark)

    def fit_transform(self, data, y: str | None = None, *, spark=None) -> DataFrame:
        return self.fit(data, y, spark=spark).transform(data, spark=spark)

    def to_sql(self, table: str = "__input__") -> str:
        return self._alone().to_sql(table)


def as_column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x
