"""Steps from SQL text."""

from __future__ import annotations

import re

from tessera.plans import ident, lit
from tessera.step import Transformer

_ALIAS = re.compile(r"^(.*\S)\s+AS\s+(`[^`]+`|\"[^\"]+\"|\w+|\{col\}\w*|\w*\{col\}\w*)\s*$", re.IGNORECASE | re.DOTALL)


def _split(sql: str) -> tuple[str, str | None]:
    """Expression and alias."""
    m = _ALIAS.match(sql)
    return (m[1], m[2].strip('`"')) if m and m[1].count("(") == m[1].count(")") else (sql, None)


class Expression(Transformer):
    """One new column: ``Expression("price * qty AS revenue")``."""

    def __init__(self, sql: str):
        self.sql = sql
        body, alias = _split(sql)
        if alias is None:
            raise ValueError("the expression needs an alias: ... AS name")
        self._body, self._alias = body, alias

    def expressions(self, columns, schema):
        return {self._alias: f"({self._body})"}


class _Custom(Transformer):
    def __init__(self, sql: str, *, columns=None, learn: dict[str, str] | None = None, mode: str = "per_column"):
        if mode not in ("per_column", "combine"):
            raise ValueError("mode is per_column or combine")
        if not isinstance(sql, str) or not sql.strip():
            raise ValueError("sql is not empty")
        if mode == "combine" and "{col}" in sql:
            raise ValueError("{col} has no meaning in combine mode")
        self.sql, self.columns, self.learn, self.mode = sql, columns, learn, mode
        self.learns = bool(learn)
        named = set(re.findall(r"\{(\w+)\}", sql)) - {"col"}
        known = set(learn or {})
        if mode == "per_column" and named - known:
            raise ValueError(f"not learned: {sorted(named - known)}")

    def discover(self, columns, schema, y):
        return {f"{c}__{n}": t.replace("{col}", ident(c)) for c in columns for n, t in (self.learn or {}).items()}

    def _fill(self, text: str, values: dict) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: lit(values[m[1]]) if m[1] in values else m[0], text)

    def expressions(self, columns, schema):
        body, alias = _split(self.sql)
        if self.mode == "combine":
            return {alias: f"({self._fill(body, self.params_)})"} if alias else {}
        out = {}
        for c in columns:
            own = {n: self.params_[f"{c}__{n}"] for n in self.learn or {}}
            e = self._fill(body.replace("{col}", ident(c)), own)
            out[(alias or "{col}").replace("{col}", c)] = f"({e})"
        return out


def custom(sql: str, *, columns=None, learn: dict[str, str] | None = None, mode: str = "per_column") -> Transformer:
    """A step from a template: ``{col}`` is each column, ``{name}`` a value learned by ``learn[name]``.

    With an alias the results are new columns, else they replace the column. In combine mode one
    expression spans columns, and learned values go by ``{column__name}``.
    """
    return _Custom(sql, columns=columns, learn=learn, mode=mode)
