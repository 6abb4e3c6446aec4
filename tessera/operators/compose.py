"""Column groups, each with its own step; and branches side by side. One projection either way."""

from __future__ import annotations

from tessera.errors import InvalidStepError, SchemaError
from tessera.operators.encoders import _Mapped
from tessera.plans import Op, Select, ident
from tessera.schema import Schema, resolve_columns
from tessera.step import Transformer


def _check(step: Transformer) -> None:
    if not isinstance(step, Transformer):
        raise InvalidStepError(f"not a step: {step!r}")
    if type(step).query not in (Transformer.query, _Mapped.query):
        raise InvalidStepError(f"{type(step).__name__} changes rows or whole frames and can't stand in a group or branch")


class _Composite(Transformer):
    def _parts(self) -> list[tuple[str, Transformer]]:
        raise NotImplementedError

    def _begin(self):
        for _, t in self._parts():
            _check(t)
        self.learns = any(t.learns for _, t in self._parts())
        self.reshapes = True

    def reset(self):
        super().reset()
        for _, t in self._parts():
            t.reset()

    def _route_part(self, name, t, schema) -> list[str]:
        return t.route(schema)

    def _bind(self, schema: Schema) -> None:
        for name, t in self._parts():
            t.columns_, t.input_schema_ = self._route_part(name, t, schema), schema

    def discover(self, columns, schema, y):
        self._bind(schema)
        return {f"{n}|{k}": v for n, t in self._parts() for k, v in t.discover(t.columns_, schema, y).items()}

    def discover_sets(self, columns, schema, y):
        return {f"{n}|{k}": v for n, t in self._parts() for k, v in t.discover_sets(t.columns_, schema, y).items()}

    def _hand_out(self, schema) -> None:
        if not all(hasattr(t, "columns_") for _, t in self._parts()):
            self._bind(schema)
        for n, t in self._parts():
            t.params_ = {k.split("|", 1)[1]: v for k, v in self.params_.items() if k.split("|", 1)[0] == n}
            t.sets_ = {k.split("|", 1)[1]: v for k, v in self.sets_.items() if k.split("|", 1)[0] == n}
            t.tables_ = {k.split("|", 1)[1]: v for k, v in self.tables_.items() if k.split("|", 1)[0] == n}

    @staticmethod
    def _new(name: str, t: Transformer, schema: Schema, ops: list[Op], have: list[str]) -> dict[str, str]:
        """A part's expressions; joins that it needs go before them."""
        if not isinstance(t, _Mapped):
            return t.expressions(t.columns_, schema)
        joins, new = t.joined(t.columns_, schema, have, name)
        ops += joins
        return new

    def clone(self):
        new = super().clone()
        new.transformers = [(x[0], x[1].clone(), *x[2:]) for x in self.transformers]
        return new


class Columns(_Composite):
    """[(name, step, columns)]: disjoint groups; the rest is dropped or passes through."""

    def __init__(self, transformers, *, remainder: str = "drop"):
        if remainder not in ("drop", "passthrough"):
            raise ValueError("remainder is drop or passthrough")
        if not transformers:
            raise InvalidStepError("no groups")
        self.transformers, self.remainder = list(transformers), remainder
        self._begin()

    def _parts(self):
        return [(n, t) for n, t, _ in self.transformers]

    def route(self, schema):
        taken: dict[str, str] = {}
        for name, _, spec in self.transformers:
            for c in resolve_columns(schema, spec):
                if c in taken:
                    raise SchemaError(f"column {c!r} is in the groups {taken[c]!r} and {name!r}")
                taken[c] = name
        return list(taken)

    def _route_part(self, name, t, schema):
        return resolve_columns(schema, next(s for n, _, s in self.transformers if n == name))

    def query(self, columns, schema):
        self._hand_out(schema)
        items: dict[str, str] = {}
        ops, have = [], list(schema)
        for name, t in self._parts():
            new, gone = self._new(name, t, schema, ops, have), set(t.removes(t.columns_, schema))
            items |= {c: new.get(c, ident(c)) for c in t.columns_ if c not in gone}
            items |= {c: e for c, e in new.items() if c not in items}
        if self.remainder == "passthrough":
            items |= {c: ident(c) for c in schema if c not in columns and c not in items}
        return [*ops, Select(list(items.items()))]


class Union(_Composite):
    """[(name, step)]: every branch sees the whole input; its outputs are named {branch}_{column}."""

    def __init__(self, transformers):
        if not transformers:
            raise InvalidStepError("no branches")
        self.transformers = list(transformers)
        if len({n for n, _ in self.transformers}) < len(self.transformers):
            raise InvalidStepError("two branches have one name")
        self._begin()

    def _parts(self):
        return self.transformers

    def query(self, columns, schema):
        self._hand_out(schema)
        items = []
        ops, have = [], list(schema)
        for name, t in self._parts():
            new, gone = self._new(name, t, schema, ops, have), set(t.removes(t.columns_, schema))
            items += [(f"{name}_{c}", new.get(c, ident(c))) for c in schema if c not in gone]
            items += [(f"{name}_{c}", e) for c, e in new.items() if c not in schema or c in gone]
        return [*ops, Select(items)]
