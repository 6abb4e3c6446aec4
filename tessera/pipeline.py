"""Pipelines: fit learns in few aggregate jobs, transform is one lazy plan."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.errors import ClassificationError, CompilationError, FitError, FrozenError, InvalidStepError, NotFittedError, StaticViolationError
from tessera.functions import Quantile
from tessera.plans import TEMP, Join, Op, Select, ident, render
from tessera.quantiles import QuantileSearch
from tessera.schema import Schema
from tessera.sources import resolve_input
from tessera.step import Transformer, ValueCounts, as_column

FIT_MODES = ("layered", "sequential")
#: Aggregates per job; more are learned by further jobs over the same frame.
AGGREGATES_PER_JOB = 400


def _named(steps) -> list[tuple[str, Transformer]]:
    pairs = list(steps.items()) if isinstance(steps, dict) else list(steps)
    if not pairs:
        raise InvalidStepError("a pipeline needs a step")
    out = []
    for i, s in enumerate(pairs):
        name, step = s if isinstance(s, tuple) and len(s) == 2 else (f"step_{i:02d}", s)
        if not isinstance(name, str) or not isinstance(step, (Transformer, Pipeline)):
            raise InvalidStepError(f"not a step: {s!r}")
        out += [(f"{name}_{n}", x) for n, x in step.steps] if isinstance(step, Pipeline) else [(name, step)]
    if len({n for n, _ in out}) < len(out):
        raise InvalidStepError(f"two steps have one name: {[n for n, _ in out]}")
    return out


def _renumbered(pairs) -> list[tuple[str, Transformer]]:
    """Unique names: automatic ones count on, others that clash get a suffix."""
    out, taken = [], set()
    for i, (name, step) in enumerate(pairs):
        new = f"step_{i:02d}" if name.startswith("step_") and name[5:].isdigit() else name
        k = 2
        base = new
        while new in taken:
            new, k = f"{base}_{k}", k + 1
        taken.add(new)
        out.append((new, step))
    return out


def _unique(op: Op) -> Op:
    """Joins of frames without a name get one that no other has."""
    if isinstance(op, Join) and op.name.startswith(TEMP) and op.name.count("_") == TEMP.count("_"):
        op.name += f"_{uuid.uuid4().hex}"
    return op


class _value_counts:  # noqa: N801
    """Values of columns, as strings, with their counts: one aggregation over all columns, kept while sets are taken from it."""

    def __init__(self, df: DataFrame, columns: list[str]):
        self.columns = columns
        each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(ident(c)).cast("string").alias("value")) for i, c in enumerate(columns)]) if columns else F.array(F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("value")))
        self.frame = df.select(F.explode(each).alias("e")).select("e.*").where("value IS NOT NULL").groupBy("i", "value").count()
        if columns:
            self.frame = self.frame.persist(StorageLevel.MEMORY_AND_DISK)

    def _own(self, column: str) -> DataFrame:
        return self.frame.where(F.col("i") == self.columns.index(column)).select("value", "count")

    def of(self, what: ValueCounts) -> DataFrame:
        return self._own(what.column) if what.whole else self._own(what.column).orderBy("value").limit(what.most)

    def size(self, column: str) -> int:
        return self._own(column).count()

    def numbered(self, column: str) -> DataFrame:
        """(value, count, place), kept by the executors: ranges of values are numbered side by side, after what is before them."""
        ranged = self._own(column).repartitionByRange("value").sortWithinPartitions("value")
        ranged = ranged.select("value", "count", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")).persist(StorageLevel.MEMORY_AND_DISK)
        # a row for each partition, so this window and the broadcast have a fixed bound
        parts = ranged.groupBy(F.col("part").alias("of")).agg(F.min("id").alias("low"), F.count("*").alias("n"))
        parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        out = ranged.join(F.broadcast(parts), F.col("part") == F.col("of")).select("value", "count", (F.col("before") + F.col("id") - F.col("low")).alias("place")).persist(StorageLevel.MEMORY_AND_DISK)
        out.count()
        ranged.unpersist()
        return out


class Pipeline:
    """Steps in order.

    ``fit_mode="layered"``: learners that stand together learn from the same frame, in one
    aggregate job; static steps before them apply, other learners' effects don't until a
    step that reshapes the columns closes the layer. ``"sequential"``: every learner sees the
    output of all steps before it, at one job a learner.
    """

    def __init__(self, steps, *, spark: SparkSession | None = None, fit_mode: str = "layered"):
        if fit_mode not in FIT_MODES:
            raise ValueError(f"fit_mode is one of {FIT_MODES}")
        self.steps = _named(steps)
        self.spark, self.fit_mode = spark, fit_mode
        self._frozen = False

    @property
    def named_steps(self) -> dict[str, Transformer]:
        return dict(self.steps)

    def fit(self, data, y: str | None = None, *, spark: SparkSession | None = None) -> Pipeline:
        if self._frozen:
            raise FrozenError("this pipeline is frozen")
        df = resolve_input(data, spark or self.spark)
        self._ops: list[Op] | None = None
        self.input_schema_ = Schema.of(df)
        if y is not None and y not in self.input_schema_:
            raise FitError(f"no target column {y!r}")
        seen = df  # what learners see: the layer's input with the static steps since
        now = df  # with all steps
        waiting: list[tuple[Transformer, list[str], Schema, str | None]] = []
        late: list[Transformer] = []  # to be applied to ``now`` once ``waiting`` has learned
        ops: list[Op] = []

        def settle() -> None:
            nonlocal now
            if waiting:
                self._learn(seen, waiting)
                waiting.clear()
            for step in late:
                now = self._finish(step, now, ops)
            late.clear()

        for _, step in self.steps:
            step.reset()
            step.prepare(df.sparkSession)
            if step.learns:
                schema = Schema.of(seen)
                step.columns_, step.input_schema_ = step.route(schema), schema
                waiting.append((step, step.columns_, schema, y))
                late.append(step)
                if step.reshapes or self.fit_mode == "sequential":
                    settle()
                    seen = now
            else:
                if waiting:
                    self._learn(seen, waiting)
                    waiting.clear()
                schema = Schema.of(seen)
                step.columns_, step.input_schema_ = step.route(schema), schema
                if step.discover(step.columns_, schema, y) or step.discover_sets(step.columns_, schema, y):
                    raise StaticViolationError(f"{type(step).__name__} has something to learn, but doesn't say that it learns")
                seen = self._finish(step, seen, [])
                late.append(step)
        settle()
        self._ops, self.output_schema_ = ops, Schema.of(now)
        return self

    @staticmethod
    def _finish(step: Transformer, df: DataFrame, ops: list[Op]) -> DataFrame:
        schema = Schema.of(df)
        step.input_schema_ = schema
        step.ops_ = [_unique(op) for op in step.ops(schema)]
        try:
            for op in step.ops_:
                df = op.apply(df)
        except AnalysisException as e:
            raise CompilationError(f"{type(step).__name__} can't be put into a plan: {e.getMessage().splitlines()[0]}") from e
        ops += step.ops_
        step.output_schema_ = Schema.of(df)
        return df

    @staticmethod
    def _learn(df: DataFrame, waiting) -> None:
        """All scalar aggregates in one job, exact quantiles by one more, and all value counts by one."""
        aggs, quantiles = [], []
        for i, (step, cols, schema, y) in enumerate(waiting):
            wanted = step.discover(cols, schema, y)
            if not isinstance(wanted, dict):
                raise ClassificationError(f"{type(step).__name__}.discover gives {type(wanted).__name__}, not what to learn by name")
            for name, agg in wanted.items():
                if isinstance(agg, Quantile):
                    quantiles.append((i, name, agg))
                else:
                    aggs.append((i, name, as_column(agg)))
        search = QuantileSearch([a for *_, a in quantiles])
        columns = [a for _, _, a in aggs] + search.first()
        values: list = []
        for at in range(0, len(columns), AGGREGATES_PER_JOB):
            part = columns[at : at + AGGREGATES_PER_JOB]
            values += df.agg(*[a.alias(f"a{k}") for k, a in enumerate(part)]).first()
        for (i, name, _), value in zip(aggs, values, strict=False):
            waiting[i][0].params_[name] = value
        for (i, name, _), value in zip(quantiles, search.run(df, values[len(aggs) :]), strict=True):
            waiting[i][0].params_[name] = value
        sets = [(step, name, what) for step, cols, schema, y in waiting for name, what in step.discover_sets(cols, schema, y).items()]
        counts = _value_counts(df, list(dict.fromkeys(w.column for *_, w in sets if isinstance(w, ValueCounts))))
        for step, name, what in sets:
            if isinstance(what, ValueCounts) and what.whole and counts.size(what.column) > what.most:
                step.tables_[name] = counts.numbered(what.column)
            else:
                step.sets_[name] = [r.asDict() for r in (counts.of(what) if isinstance(what, ValueCounts) else what(df)).collect()]
        counts.frame.unpersist()

    def restore(self) -> Pipeline:
        """The operations of fitted steps anew, as after a pickle, which doesn't hold them."""
        ops = [op for _, step in self.steps for op in step.ops(step.input_schema_)]
        self._ops = [_unique(op) for op in ops]
        self.input_schema_, self.output_schema_ = self.steps[0][1].input_schema_, self.steps[-1][1].output_schema_
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_ops"} | {"spark": None, "_was_fitted": self.__sklearn_is_fitted__()}

    def _fitted(self) -> list[Op]:
        if getattr(self, "_ops", None) is None:
            if not self.__dict__.pop("_was_fitted", False):
                raise NotFittedError("the pipeline is not fitted")
            schemas = self.input_schema_, self.output_schema_
            self.restore()
            self.input_schema_, self.output_schema_ = schemas
        return self._ops

    def _first(self) -> Select:
        return Select([(c, ident(c)) for c in self.input_schema_])

    def transform(self, data, *, spark: SparkSession | None = None) -> DataFrame:
        """Lazy. Columns beyond those of the training frame are left out."""
        ops = self._fitted()
        df = self._first().apply(resolve_input(data, spark or self.spark))
        if df.isStreaming and (bad := [type(o).__name__ for o in ops if not o.streams]):
            raise ValueError(f"these operations need all rows and can't run on a stream: {bad}")
        for op in ops:
            df = op.apply(df)
        return df

    def fit_transform(self, data, y: str | None = None, *, spark: SparkSession | None = None) -> DataFrame:
        return self.fit(data, y, spark=spark).transform(data, spark=spark)

    def to_numpy(self, data, *, spark: SparkSession | None = None):
        """The result as a dense array in the driver: floats if every column is a number, else objects."""
        import numpy as np

        pdf = self.transform(data, spark=spark).toPandas()
        try:
            return pdf.to_numpy(dtype="float64") if len(pdf) else np.empty((0, len(pdf.columns)))
        except (TypeError, ValueError):
            return pdf.to_numpy(dtype=object)

    def to_sql(self, table: str = "__input__") -> str:
        """Spark SQL text of the fitted pipeline: a CTE for each step.

        Learned tables and looked-up frames that it joins become temporary views of the session, under names of their own.
        """
        ops = self._fitted()
        for op in ops:
            if isinstance(op, Join) and op.name.startswith(TEMP):
                op.other.createOrReplaceTempView(op.name)
        return render([self._first(), *ops], table)

    def freeze(self) -> Pipeline:
        self._fitted()
        new = self.copy()
        new._frozen = True
        return new

    def get_feature_names_out(self) -> list[str]:
        self._fitted()
        return self.output_schema_.columns

    def get_params(self, deep: bool = True) -> dict:
        out = {"steps": self.steps, "fit_mode": self.fit_mode}
        if deep:
            out |= {f"{n}__{k}": v for n, s in self.steps for k, v in s.get_params().items()}
        return out

    def set_params(self, **params) -> Pipeline:
        for key, value in params.items():
            name, _, rest = key.partition("__")
            if not rest:
                setattr(self, name, value)
            elif name in self.named_steps:
                self.named_steps[name].set_params(**{rest: value})
            else:
                raise ValueError(f"no step {name!r}")
        return self

    def clone(self) -> Pipeline:
        return Pipeline([(n, s.clone()) for n, s in self.steps], spark=self.spark, fit_mode=self.fit_mode)

    def copy(self) -> Pipeline:
        new = type(self).__new__(type(self))
        new.__dict__ = self.__dict__ | {"steps": [(n, s.copy()) for n, s in self.steps]}
        return new

    def __sklearn_is_fitted__(self) -> bool:
        return getattr(self, "_ops", None) is not None or self.__dict__.get("_was_fitted", False)

    def __add__(self, other) -> Pipeline:
        theirs = other.steps if isinstance(other, Pipeline) else [("step_00", other)]
        if not isinstance(other, (Pipeline, Transformer)):
            return NotImplemented
        return Pipeline(_renumbered([(n, s.clone()) for n, s in [*self.steps, *theirs]]), spark=self.spark, fit_mode=self.fit_mode)

    def __len__(self) -> int:
        return len(self.steps)

    def __getitem__(self, key):
        return self.named_steps[key] if isinstance(key, str) else self.steps[key][1]

    def __repr__(self) -> str:
        return "Pipeline([" + ", ".join(f"({n!r}, {s!r})" for n, s in self.steps) + "])"


def compose_transform(steps: list[Transformer], source, *, spark: SparkSession | None = None) -> DataFrame:
    """Apply fitted steps in order."""
    df = resolve_input(source, spark)
    for step in steps:
        if not step.__sklearn_is_fitted__():
            raise NotFittedError(f"{type(step).__name__} is not fitted")
        for op in step.ops(Schema.of(df)):
            df = op.apply(df)
    return df
