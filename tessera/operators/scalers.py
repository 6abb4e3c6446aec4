"""Scalers. A column that doesn't vary scales to NULL."""

from __future__ import annotations

from tessera.functions import divided, median, norm, quantile
from tessera.plans import double, ident, lit
from tessera.step import Transformer


def _x(c: str) -> str:
    return f"CAST({ident(c)} AS DOUBLE)"


class _Scaler(Transformer):
    default_columns = "numeric"
    learns = True


class StandardScaler(_Scaler):
    """Less the mean, over the population standard deviation."""

    def __init__(self, *, with_mean: bool = True, with_std: bool = True, columns=None):
        self.with_mean, self.with_std, self.columns = with_mean, with_std, columns

    def discover(self, columns, schema, y):
        out = {f"{c}__mean": f"avg({_x(c)})" for c in columns if self.with_mean}
        return out | {f"{c}__std": f"stddev_pop({_x(c)})" for c in columns if self.with_std}

    def expressions(self, columns, schema):
        out = {}
        for c in columns if self.with_mean or self.with_std else []:
            e = f"({_x(c)} - {double(self.params_[f'{c}__mean'])})" if self.with_mean else _x(c)
            out[c] = divided(e, self.params_[f"{c}__std"]) if self.with_std else e
        return out


class MinMaxScaler(_Scaler):
    def __init__(self, *, feature_range: tuple = (0, 1), columns=None):
        if feature_range[0] >= feature_range[1]:
            raise ValueError("feature_range rises")
        self.feature_range, self.columns = feature_range, columns

    def discover(self, columns, schema, y):
        return {f"{c}__{f}": f"{f}({_x(c)})" for c in columns for f in ("min", "max")}

    def expressions(self, columns, schema):
        low, high = map(float, self.feature_range)
        out = {}
        for c in columns:
            a, z = self.params_[f"{c}__min"], self.params_[f"{c}__max"]
            e = divided(f"({_x(c)} - {double(a)})", None if a is None else z - a)
            out[c] = e if (low, high) == (0, 1) else f"({e} * {lit(high - low)} + {lit(low)})"
        return out


class MaxAbsScaler(_Scaler):
    def discover(self, columns, schema, y):
        return {f"{c}__max_abs": f"max(abs({_x(c)}))" for c in columns}

    def expressions(self, columns, schema):
        return {c: divided(_x(c), self.params_[f"{c}__max_abs"]) for c in columns}


class RobustScaler(_Scaler):
    """Less the median, over a range of discrete quantiles.

    The quantiles are exact; ``accuracy`` swaps them for mergeable sketches of that accuracy, which saves a scan.
    """

    def __init__(self, *, with_centering: bool = True, with_scaling: bool = True, quantile_range: tuple = (25.0, 75.0), columns=None, accuracy: int | None = None):
        self.with_centering, self.with_scaling, self.quantile_range = with_centering, with_scaling, quantile_range
        self.columns, self.accuracy = columns, accuracy

    def discover(self, columns, schema, y):
        at = (lambda x, q: f"approx_percentile({x}, {q!r}D, {self.accuracy})") if self.accuracy else quantile
        out = {}
        for c in columns:
            if self.with_centering:
                out[f"{c}__median"] = at(_x(c), 0.5) if self.accuracy else median(_x(c))
            if self.with_scaling:
                out |= {f"{c}__q{k}": at(_x(c), q / 100) for k, q in enumerate(self.quantile_range)}
        return out

    def expressions(self, columns, schema):
        out = {}
        for c in columns if self.with_centering or self.with_scaling else []:
            e = f"({_x(c)} - {double(self.params_[f'{c}__median'])})" if self.with_centering else _x(c)
            if self.with_scaling:
                a, z = self.params_[f"{c}__q0"], self.params_[f"{c}__q1"]
                e = divided(e, None if a is None else z - a)
            out[c] = e
        return out


class Normalizer(Transformer):
    """Each row over its norm. A NULL in l1 or l2 makes the row NULL; max skips NULLs."""

    default_columns = "numeric"

    def __init__(self, *, norm: str = "l2", columns=None):
        if norm not in ("l1", "l2", "max"):
            raise ValueError("norm is l1, l2 or max")
        self.norm, self.columns = norm, columns

    def expressions(self, columns, schema):
        return {c: f"({_x(c)} / nullif({norm(columns, self.norm)}, 0D))" for c in columns}


class Imputer(Transformer):
    """NULLs become a learned or given value."""

    learns = True
    STRATEGIES = ("auto", "mean", "median", "most_frequent", "zero")

    def __init__(self, strategy="auto", *, columns=None):
        self.strategy, self.columns = strategy, columns

    def route(self, schema):
        if isinstance(self.strategy, dict):
            return [c for c in self.strategy if c in schema]
        return super().route(schema)

    def _how(self, c, schema):
        s = self.strategy[c] if isinstance(self.strategy, dict) else self.strategy
        if s == "auto":
            kind = schema.column_category(c)
            s = "median" if kind == "numeric" else "most_frequent"
        return s

    def discover(self, columns, schema, y):
        out = {}
        for c in columns:
            how = self._how(c, schema)
            if how in ("mean", "median"):
                out[f"{c}__value"] = f"avg({_x(c)})" if how == "mean" else median(_x(c))
            elif how == "most_frequent":
                out[f"{c}__value"] = f"mode({ident(c)}, true)"
        return out

    def expressions(self, columns, schema):
        out = {}
        for c in columns:
            how = self._how(c, schema)
            value = 0 if how == "zero" else self.params_.get(f"{c}__value") if how in ("mean", "median", "most_frequent") else how
            if value is None:
                continue
            kind = schema[c].simpleString()
            fractional = isinstance(value, float) and schema.column_category(c) == "numeric"
            out[c] = f"coalesce({_x(c)}, {lit(value)})" if fractional else f"coalesce({ident(c)}, CAST({lit(value)} AS {kind}))"
        return out
