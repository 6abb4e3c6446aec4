"""Column categories over Spark types, an immutable schema view, and lazy column selectors."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.errors import MissingColumnError, SchemaError

CATEGORIES = ("numeric", "categorical", "temporal", "boolean")
RESERVED = "__ts_"


def category(kind: T.DataType) -> str:
    """numeric, categorical, temporal, boolean or other."""
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "categorical"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)) or kind.typeName().startswith("time"):
        return "temporal"
    return "other"


def parse_type(kind: str | T.DataType) -> T.DataType:
    return kind if isinstance(kind, T.DataType) else T._parse_datatype_string(kind)


class Schema(Mapping):
    """Ordered column names and types; every change gives a new schema."""

    def __init__(self, columns: Mapping[str, str | T.DataType] | T.StructType):
        items = [(f.name, f.dataType) for f in columns] if isinstance(columns, T.StructType) else columns.items()
        self._types = {n: parse_type(k) for n, k in items}
        for name in self._types:
            if name.startswith(RESERVED):
                raise SchemaError(f"names that begin with {RESERVED} are reserved: {name!r}")

    @classmethod
    def of(cls, df: DataFrame) -> Schema:
        return cls(df.schema)

    @property
    def columns(self) -> list[str]:
        return list(self._types)

    def __getitem__(self, name: str) -> T.DataType:
        self._need([name])
        return self._types[name]

    def __contains__(self, name) -> bool:
        return name in self._types

    def __iter__(self) -> Iterator[str]:
        return iter(self._types)

    def __len__(self) -> int:
        return len(self._types)

    def __eq__(self, other) -> bool:
        return isinstance(other, Schema) and self._types == other._types

    def __hash__(self) -> int:
        return hash(frozenset((n, k.simpleString()) for n, k in self._types.items()))

    def __repr__(self) -> str:
        return f"Schema({', '.join(f'{n}: {k.simpleString()}' for n, k in self._types.items())})"

    def _need(self, names) -> None:
        for n in names:
            if n not in self._types:
                raise MissingColumnError(n, self.columns)

    def add(self, name: str | Mapping, kind: str | T.DataType | None = None) -> Schema:
        new = dict(name) if isinstance(name, Mapping) else {name: kind}
        if taken := [n for n in new if n in self._types]:
            raise SchemaError(f"already there: {taken}")
        return Schema(self._types | new)

    def drop(self, *names: str) -> Schema:
        self._need(names)
        return Schema({n: k for n, k in self._types.items() if n not in names})

    def rename(self, mapping: Mapping[str, str]) -> Schema:
        self._need(mapping)
        new = [mapping.get(n, n) for n in self._types]
        if len(set(new)) < len(new):
            raise SchemaError(f"two columns would get one name: {new}")
        return Schema(dict(zip(new, self._types.values(), strict=True)))

    def cast(self, name: str | Mapping, kind: str | T.DataType | None = None) -> Schema:
        new = dict(name) if isinstance(name, Mapping) else {name: kind}
        self._need(new)
        return Schema({n: new.get(n, k) for n, k in self._types.items()})

    def select(self, names: list[str]) -> Schema:
        self._need(names)
        return Schema({n: self._types[n] for n in names})

    def column_category(self, name: str) -> str:
        return category(self[name])

    def _of(self, kind: str) -> list[str]:
        return [n for n, k in self._types.items() if category(k) == kind]

    def numeric(self) -> list[str]:
        return self._of("numeric")

    def categorical(self) -> list[str]:
        return self._of("categorical")

    def temporal(self) -> list[str]:
        return self._of("temporal")

    def boolean(self) -> list[str]:
        return self._of("boolean")


class ColumnSelector:
    """A choice of columns, made when a schema is known. Combine with ``| & ~ -``."""

    def __init__(self, choose: Callable[[Schema], list[str]], label: str):
        self._choose, self._label = choose, label

    def resolve(self, schema: Schema) -> list[str]:
        return self._choose(schema)

    def __repr__(self) -> str:
        return self._label

    def __or__(self, other: ColumnSelector) -> ColumnSelector:
        return ColumnSelector(lambda s: list(dict.fromkeys(self.resolve(s) + other.resolve(s))), f"({self} | {other})")

    def __and__(self, other: ColumnSelector) -> ColumnSelector:
        def both(s):
            mine = set(self.resolve(s))
            return [c for c in other.resolve(s) if c in mine]

        return ColumnSelector(both, f"({self} & {other})")

    def __sub__(self, other: ColumnSelector) -> ColumnSelector:
        def less(s):
            out = set(other.resolve(s))
            return [c for c in self.resolve(s) if c not in out]

        return ColumnSelector(less, f"({self} - {other})")

    def __invert__(self) -> ColumnSelector:
        return ColumnSelector(lambda s: (all_columns() - self).resolve(s), f"~{self}")


def all_columns() -> ColumnSelector:
    return ColumnSelector(lambda s: s.columns, "all_columns()")


def _by_category(kind: str) -> Callable[[], ColumnSelector]:
    def selector() -> ColumnSelector:
        return ColumnSelector(lambda s: s._of(kind), f"{kind}()")

    selector.__name__ = kind
    return selector


numeric, categorical, temporal, boolean = map(_by_category, CATEGORIES)


def matching(glob: str) -> ColumnSelector:
    return ColumnSelector(lambda s: [c for c in s if fnmatch.fnmatch(c, glob)], f"matching({glob!r})")


def dtype(kind: str | T.DataType) -> ColumnSelector:
    """Columns of a type; parameters such as a decimal's precision don't matter."""
    want = parse_type(kind).typeName()
    return ColumnSelector(lambda s: [c for c, k in s.items() if k.typeName() == want], f"dtype({want!r})")


def columns(*names: str) -> ColumnSelector:
    """Named columns; those the schema lacks are left out."""
    return ColumnSelector(lambda s: [n for n in names if n in s], f"columns{names!r}")


def resolve_columns(schema: Schema, spec) -> list[str]:
    if spec is None:
        raise ValueError("no columns were asked for")
    if isinstance(spec, ColumnSelector):
        return spec.resolve(schema)
    if isinstance(spec, str):
        if spec == "all":
            return schema.columns
        if spec in CATEGORIES:
            return schema._of(spec)
        raise ValueError(f"not a category: {spec!r}; give a list to name columns")
    for name in spec:
        if name not in schema:
            raise MissingColumnError(name, schema.columns)
    return list(spec)
