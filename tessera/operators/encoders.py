"""Encoders of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import NotFittedError, UnseenCategoryError
from tessera.plans import TEMP, Join, Op, Select, double, ident, lit
from tessera.schema import RESERVED
from tessera.sources import session
from tessera.step import Transformer, ValueCounts

#: Categories of a column that become a literal in the plan; more are joined as a table.
LITERALS = 1000
#: Categories of a column that the driver holds at most; more stay a table of the cluster.
DRIVER_CATEGORIES = 100_000


def _lookup(c: str, table: dict, to: str, otherwise: str) -> str:
    """A value's number from a map literal, built once per plan."""
    if not table:
        return f"CAST({otherwise} AS {to})"
    pairs = ", ".join(f"{lit(k)}, CAST({lit(v)} AS {to})" for k, v in table.items())
    return f"coalesce(element_at(map({pairs}), CAST({ident(c)} AS STRING)), CAST({otherwise} AS {to}))"


class _Encoder(Transformer):
    default_columns = "categorical"
    learns = True
    reshapes = True

    def check_unseen(self, df: DataFrame) -> None:
        """Raise if a column has values that fit hasn't seen; runs a job."""
        for c in self.columns_:
            values = df.select(F.col(ident(c)).cast("string").alias("v")).where("v IS NOT NULL").distinct()
            if c in self.tables_:
                unseen = values.join(self.tables_[c], F.col("v") == F.col("value"), "left_anti")
            else:
                unseen = values.where(~F.col("v").isin([r["value"] for r in self.sets_[c]]))
            found = unseen.limit(20).collect()
            if found:
                raise UnseenCategoryError(c, [r["v"] for r in found])


class _Mapped(_Encoder):
    """A number for each category: by a map literal, or by a join where there are many."""

    kind = "DOUBLE"

    def table(self, c: str) -> dict:
        raise NotImplementedError

    def otherwise(self) -> str:
        raise NotImplementedError

    def code(self) -> str:
        """The number in a table (value, count, place), as SQL text."""
        raise NotImplementedError

    def expressions(self, columns, schema):
        return {c: _lookup(c, self.table(c), self.kind, self.otherwise()) for c in columns}

    def _codes(self, c: str, key: str, code: str) -> DataFrame:
        if c in self.tables_:
            return self.tables_[c].select(F.col("value").alias(key), F.expr(self.code()).alias(code))
        return session().createDataFrame(list(self.table(c).items()), f"{ident(key)} string, {ident(code)} {self.kind.lower()}")

    def joined(self, columns, schema, have: list[str], tag: str = "") -> tuple[list[Op], dict[str, str]]:
        """The joins that columns of many categories need, each of which adds to ``have``; and the expressions over these."""
        for c in columns:
            if c not in self.tables_ and c not in self.sets_:
                raise NotFittedError(f"the table of the categories of {c!r} doesn't travel with a pickle")
        many = [c for c in columns if c in self.tables_ or len(self.table(c)) > LITERALS]
        new, ops = self.expressions([c for c in columns if c not in many], schema), []
        for c in many:
            key, code = f"{RESERVED}key_{tag}_{c}", f"{RESERVED}code_{tag}_{c}"
            ops.append(Select([(x, ident(x)) for x in have] + [(key, f"CAST({ident(c)} AS STRING)")]))
            ops.append(Join(self._codes(c, key, code), f"{TEMP}learned", [key], "left", [("l", x, x) for x in have] + [("r", code, code)]))
            have.append(code)
            new[c] = f"coalesce({ident(code)}, CAST({self.otherwise()} AS {self.kind}))"
        return ops, new

    def query(self, columns, schema):
        ops, new = self.joined(columns, schema, list(schema))
        return [*ops, Select([(c, new.get(c, ident(c))) for c in schema])] if ops else None


class OneHotEncoder(_Encoder):
    """A 0/1 column for each of the first ``max_categories`` categories by name."""

    def __init__(self, *, max_categories: int = 30, columns=None):
        self.max_categories, self.columns = max_categories, columns

    def discover_sets(self, columns, schema, y):
        return {c: ValueCounts(c, self.max_categories) for c in columns}

    def categories(self, c: str) -> list[str]:
        return sorted(r["value"] for r in self.sets_[c])[: self.max_categories]

    def expressions(self, columns, schema):
        return {f"{c}_{v.lower().replace(' ', '_')}": f"(CASE WHEN CAST({ident(c)} AS STRING) = {lit(v)} THEN 1 ELSE 0 END)" for c in columns for v in self.categories(c)}

    def removes(self, columns, schema):
        return columns


class OrdinalEncoder(_Mapped):
    """Sorted categories to 0..k-1. ``categories`` gives orders of one's own by column."""

    kind = "INT"

    def __init__(self, *, categories="auto", handle_unknown: str = "error", unknown_value=None, columns=None):
        if handle_unknown not in ("error", "use_encoded_value"):
            raise ValueError("handle_unknown is error or use_encoded_value")
        self.categories, self.handle_unknown, self.unknown_value, self.columns = categories, handle_unknown, unknown_value, columns

    def discover_sets(self, columns, schema, y):
        return {c: ValueCounts(c, DRIVER_CATEGORIES, whole=True) for c in columns}

    def table(self, c):
        own = self.categories.get(c) if isinstance(self.categories, dict) else None
        return {v: i for i, v in enumerate(own or sorted(r["value"] for r in self.sets_[c]))}

    def code(self):
        return "CAST(place AS INT)"

    def otherwise(self):
        return lit(self.unknown_value) if self.handle_unknown == "use_encoded_value" else "NULL"


class FrequencyEncoder(_Mapped):
    """A category's share of all rows, or its count."""

    def __init__(self, *, normalize: bool = True, handle_unknown: str = "value", fill_value: float = 0.0, columns=None):
        if handle_unknown not in ("value", "error"):
            raise ValueError("handle_unknown is value or error")
        self.normalize, self.handle_unknown, self.fill_value, self.columns = normalize, handle_unknown, fill_value, columns

    def discover(self, columns, schema, y):
        return {"total": F.count(F.lit(1))} if columns else {}

    def discover_sets(self, columns, schema, y):
        return {c: ValueCounts(c, DRIVER_CATEGORIES, whole=True) for c in columns}

    def table(self, c):
        total = self.params_.get("total") or 1
        return {r["value"]: float(r["count"]) / (total if self.normalize else 1) for r in self.sets_[c]}

    def code(self):
        return f"CAST(count AS DOUBLE) / {double((self.params_.get('total') or 1) if self.normalize else 1)}"

    def otherwise(self):
        return lit(float(self.fill_value))


class HashEncoder(Transformer):
    """Hash buckets as 0/1 columns. Buckets are those of xxhash64."""

    default_columns = "categorical"

    def __init__(self, *, n_features: int = 8, columns=None):
        if n_features < 1:
            raise ValueError("n_features is 1 or more")
        self.n_features, self.columns = n_features, columns

    def expressions(self, columns, schema):
        return {f"{c}_hash_{i}": f"(CASE WHEN pmod(xxhash64({ident(c)}), {self.n_features}) = {i} THEN 1 ELSE 0 END)" for c in columns for i in range(self.n_features)}

    def removes(self, columns, schema):
        return columns
