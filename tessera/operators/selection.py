"""Feature selection."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from tessera.functions import safe_corr
from tessera.plans import Select, ident
from tessera.step import Transformer


class _Selector(Transformer):
    default_columns = "numeric"
    learns = True
    reshapes = True

    def dropped(self) -> set[str]:
        raise NotImplementedError

    def query(self, columns, schema):
        gone = self.dropped()
        return [Select([(c, ident(c)) for c in schema if c not in gone])]


class VarianceThreshold(_Selector):
    """Columns whose variance is at most the threshold go; an unknown variance stays."""

    def __init__(self, *, threshold: float = 0.0, columns=None):
        if threshold < 0:
            raise ValueError("threshold is 0 or more")
        self.threshold, self.columns = threshold, columns

    def discover(self, columns, schema, y):
        return {c: f"var_pop(CAST({ident(c)} AS DOUBLE))" for c in columns}

    def dropped(self):
        return {c for c, v in self.params_.items() if v is not None and v <= self.threshold}


class DropCorrelated(_Selector):
    """Of pairs correlated beyond the threshold, the column in most pairs goes, again and again."""

    def __init__(self, *, threshold: float = 0.95, columns=None):
        if not 0 < threshold < 1:
            raise ValueError("threshold lies between 0 and 1")
        self.threshold, self.columns = threshold, columns

    def discover(self, columns, schema, y):
        self._pairs = list(combinations(columns, 2))
        return {str(i): safe_corr(ident(a), ident(b)) for i, (a, b) in enumerate(self._pairs)}

    def dropped(self):
        # a fixed rule that results have to match: the column in most pairs goes first, of equals the last by name
        left = [p for i, p in enumerate(self._pairs) if (r := self.params_[str(i)]) is not None and abs(r) > self.threshold]
        gone: set[str] = set()
        while left:
            n = Counter(c for p in left for c in p)
            worst = max(n, key=lambda c: (n[c], c))
            gone.add(worst)
            left = [p for p in left if worst not in p]
        return gone


class SelectKBest(_Selector):
    """The k columns of largest absolute correlation with the target; other numeric columns in scope go."""

    def __init__(self, *, k: int, score_func: str = "f_regression", columns=None):
        if isinstance(k, bool) or not isinstance(k, int) or k < 1:
            raise ValueError("k is 1 or more")
        if score_func not in ("f_regression", "mutual_info", "f_classif"):
            raise ValueError("score_func is f_regression, mutual_info or f_classif")
        self.k, self.score_func, self.columns = k, score_func, columns

    def discover(self, columns, schema, y):
        if y is None:
            raise ValueError("SelectKBest needs a target: fit(data, y=...)")
        return {c: safe_corr(ident(c), ident(y)) for c in columns if c != y}

    def scores(self) -> dict[str, float]:
        return {c: abs(v) if v is not None else 0.0 for c, v in self.params_.items()}

    def dropped(self):
        s = self.scores()
        best = sorted(s, key=lambda c: (-s[c], c))[: self.k]
        return set(self.columns_) - set(best)
