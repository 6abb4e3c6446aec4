"""Row and column steps: filter, sample, dedup, outliers, targets, cast, rename, drop."""

from __future__ import annotations

from tessera import functions as fn
from tessera.plans import Distinct, Select, Top, Where, ident, lit
from tessera.schema import RESERVED, parse_type
from tessera.step import Transformer


def _all(schema) -> list[tuple[str, str]]:
    return [(c, ident(c)) for c in schema]


class Filter(Transformer):
    def __init__(self, *, condition: str):
        if not isinstance(condition, str):
            raise TypeError("condition is SQL text")
        if not condition.strip():
            raise ValueError("condition is not empty")
        self.condition = condition

    def query(self, columns, schema):
        return [Where(f"({self.condition})")]


class Sample(Transformer):
    """n rows (each task keeps n at most), or each row with a probability; the seed makes it repeatable."""

    def __init__(self, *, n: int | None = None, fraction: float | None = None, seed: int | None = None, columns=None):
        if (n is None) == (fraction is None):
            raise ValueError("give n or fraction")
        if n is not None and n < 1:
            raise ValueError("n is 1 or more")
        if fraction is not None and not 0 < fraction < 1:
            raise ValueError("fraction lies between 0 and 1")
        self.n, self.fraction, self.seed, self.columns = n, fraction, seed, columns

    def query(self, columns, schema):
        r = "rand()" if self.seed is None else f"rand({int(self.seed)})"
        return [Top(r, self.n)] if self.n is not None else [Where(f"({r} < {lit(float(self.fraction))})")]


class Deduplicate(Transformer):
    """One row (or, by ``keep="none"``, only single rows) for each value of ``subset``.

    The survivor of a group is the first or last by ``order_by``, then by all columns in order,
    so that it doesn't depend on the partitioning.
    """

    def __init__(self, *, subset=None, keep: str = "first", order_by=None):
        if keep not in ("first", "last", "none"):
            raise ValueError("keep is first, last or none")
        if subset is not None and not list(subset):
            raise ValueError("subset is not empty")
        self.subset, self.keep, self.order_by = subset, keep, order_by

    def query(self, columns, schema):
        from tessera.schema import resolve_columns

        if self.keep != "none" and self.subset is None:
            return [Distinct()]
        keys = resolve_columns(schema, self.subset) if self.subset is not None else schema.columns
        part = f"PARTITION BY {', '.join(map(ident, keys))}"
        mark = RESERVED + "n"
        if self.keep == "none":
            how = f"count(*) OVER ({part})"
        else:
            first = [self.order_by] if isinstance(self.order_by, str) else list(self.order_by or [])
            order = list(dict.fromkeys([*first, *(c for c in schema if c not in keys)])) or keys[:1]
            to = "ASC NULLS LAST" if self.keep == "first" else "DESC NULLS FIRST"
            how = f"row_number() OVER ({part} ORDER BY {', '.join(f'{ident(c)} {to}' for c in order)})"
        return [Select([*_all(schema), (mark, how)], windowed=True), Where(f"{ident(mark)} = 1"), Select(_all(schema))]


class OutlierHandler(Transformer):
    """Clip to, or remove rows outside, fences of the interquartile range or the z-score."""

    default_columns = "numeric"
    learns = True

    def __init__(self, *, method: str = "iqr", action: str = "clip", threshold: float | None = None, columns=None):
        if method not in ("iqr", "zscore"):
            raise ValueError("method is iqr or zscore")
        if action not in ("clip", "remove"):
            raise ValueError("action is clip or remove")
        if threshold is not None and threshold <= 0:
            raise ValueError("threshold is positive")
        self.method, self.action, self.threshold, self.columns = method, action, threshold, columns

    def discover(self, columns, schema, y):
        out = {}
        for c in columns:
            x = f"CAST({ident(c)} AS DOUBLE)"
            if self.method == "iqr":
                out |= {f"{c}__a": fn.quantile(x, 0.25), f"{c}__b": fn.quantile(x, 0.75)}
            else:
                out |= {f"{c}__a": f"avg({x})", f"{c}__b": f"stddev_pop({x})"}
        return out

    def fences(self, c) -> tuple[float, float] | None:
        a, b = self.params_[f"{c}__a"], self.params_[f"{c}__b"]
        if a is None or b is None:
            return None
        if self.method == "iqr":
            t = 1.5 if self.threshold is None else self.threshold
            return a - t * (b - a), b + t * (b - a)
        t = 3.0 if self.threshold is None else self.threshold
        return a - t * b, a + t * b

    def query(self, columns, schema):
        known = {c: f for c in columns if (f := self.fences(c))}
        if self.action == "remove":
            test = [f"({ident(c)} BETWEEN {lit(lo)} AND {lit(hi)})" for c, (lo, hi) in known.items()]
            return [Where(" AND ".join(test))] if test else []
        return [Select([(c, fn.clip(f"CAST({ident(c)} AS DOUBLE)", *known[c]) if c in known else ident(c)) for c in schema])]


class TargetTransform(Transformer):
    """log(y + 1), square root, or Box-Cox with a given lambda or a simple estimate."""

    def __init__(self, *, method: str = "log", lambda_="auto", columns=None):
        if method not in ("log", "sqrt", "boxcox"):
            raise ValueError("method is log, sqrt or boxcox")
        if lambda_ != "auto" and (isinstance(lambda_, bool) or not isinstance(lambda_, (int, float))):
            raise TypeError("lambda_ is auto or a number")
        self.method, self.lambda_, self.columns = method, lambda_, columns
        self.learns = method == "boxcox" and lambda_ == "auto"

    def discover(self, columns, schema, y):
        return {f"{c}__mean_log": f"avg({fn.ln(f'CAST({ident(c)} AS DOUBLE)')})" for c in columns} if self.learns else {}

    def power(self, c: str) -> float:
        if self.lambda_ != "auto":
            return float(self.lambda_)
        m = abs(self.params_[f"{c}__mean_log"] or 0.0)
        # fixed values of the estimate, which results have to match: 0.1, and 1 / (1 + m) to four places
        return 0.0 if m < 0.1 else round(1 / (1 + m), 4)

    def expressions(self, columns, schema):
        out = {}
        for c in columns:
            x = f"CAST({ident(c)} AS DOUBLE)"
            if self.method == "log":
                out[c] = fn.ln(f"({x} + 1D)")
            elif self.method == "sqrt":
                out[c] = f"sqrt({x})"
            else:
                p = self.power(c)
                out[c] = fn.ln(x) if p == 0 else f"((pow({x}, {lit(p)}) - 1D) / {lit(p)})"
        return out


class Cast(Transformer):
    def __init__(self, mapping: dict[str, str]):
        if not mapping:
            raise ValueError("mapping is not empty")
        if not all(isinstance(k, str) and isinstance(v, str) for k, v in mapping.items()):
            raise TypeError("mapping is of names to type names")
        self.mapping = mapping

    ALIASES = {"varchar": "string", "text": "string", "integer": "int", "real": "float"}

    def route(self, schema):
        return [c for c in self.mapping if c in schema]

    def expressions(self, columns, schema):
        to = {c: self.ALIASES.get(self.mapping[c].lower(), self.mapping[c]) for c in columns}
        return {c: fn.cast(ident(c), to[c], schema[c].typeName()) for c in columns if parse_type(to[c]) is not None}


class Rename(Transformer):
    def __init__(self, *, mapping: dict[str, str]):
        if not mapping:
            raise ValueError("mapping is not empty")
        if len(set(mapping.values())) < len(mapping):
            raise ValueError("two columns would get one name")
        self.mapping = mapping

    def query(self, columns, schema):
        names = schema.rename({k: v for k, v in self.mapping.items() if k in schema}).columns
        return [Select([(new, ident(old)) for old, new in zip(schema, names, strict=True)])]


class Drop(Transformer):
    def __init__(self, *, columns: list[str]):
        if not isinstance(columns, list) or not columns or not all(isinstance(c, str) for c in columns):
            raise ValueError("columns is a list of names")
        self.columns = columns

    def route(self, schema):
        return schema.columns

    def query(self, columns, schema):
        return [Select([(c, e) for c, e in _all(schema) if c not in self.columns])]
