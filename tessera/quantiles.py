"""Exact quantiles of many columns in few scans, without sorting a frame or holding its values.

A first scan takes approximate quantiles a little to either side, which bracket each exact one
for certain, as the sketch's error in ranks is bounded. A second scan counts what lies below each
bracket, and the values within it by an aggregation; the rank then picks the value. A bracket
holds a share of some ten-thousandths of the rows: where those are many, further scans narrow it first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import Quantile
from tessera.plans import double

#: Of the sketches; their error in ranks is at most rows / ACCURACY.
ACCURACY = 10_000
#: How far in ranks, as a share, a bracket reaches to either side.
REACH = 3 / ACCURACY
#: Rows in a bracket at most whose values are counted; of each value the driver gets one row.
MOST_ROWS = 200_000


class QuantileSearch:
    def __init__(self, wanted: list[Quantile]):
        self.wanted = wanted
        self.each = list(dict.fromkeys(wanted))

    def first(self) -> list[Column]:
        """Aggregates of the first scan."""
        return [F.expr(e) for w in self.each for e in (f"count({w.x})", _sketch(w.x, w.q))]

    def run(self, df: DataFrame, values: list) -> list[float | None]:
        """The quantiles; ``values``: what the first scan gave."""
        sizes, brackets = {}, {}
        for w, n, bounds in zip(self.each, values[::2], values[1::2], strict=True):
            sizes[w] = n
            if n:
                brackets[w] = [bounds[0], bounds[1], 0, n, n + 1]  # low, high; rows below and within, by the last count; rows within before
        wide = {w: b for w, b in brackets.items() if 2 * REACH * sizes[w] > MOST_ROWS}
        while wide:
            wide = self._narrow(df, wide, sizes)
        found = self._pick(df, brackets, sizes) if brackets else {}
        return [found.get(w) for w in self.wanted]

    @staticmethod
    def _narrow(df: DataFrame, brackets: dict, sizes: dict) -> dict:
        """One scan counts, one takes quantiles within the brackets; those that may still be too wide come back."""
        low_high = [(w, b) for w, b in brackets.items()]
        counts = df.agg(*[F.expr(e).alias(f"a{i}") for i, e in enumerate(x for w, b in low_high for x in (f"count_if({w.x} < {double(b[0])})", f"count_if({_within(w.x, b)})"))]).first()
        for i, (_, b) in enumerate(low_high):
            b[2], b[3] = counts[2 * i], counts[2 * i + 1]
        # a bracket of two values, or one that doesn't shrink, is as narrow as it gets
        open_ = [(w, b) for w, b in low_high if MOST_ROWS < b[3] < b[4] and b[0] != b[1]]
        if not open_:
            return {}
        middle = [(sum(w.ranks(sizes[w])) / 2 + 0.5 - b[2]) / b[3] for w, b in open_]
        bounds = df.agg(*[F.expr(f"{_sketch(w.x, q)} FILTER (WHERE {_within(w.x, b)})").alias(f"a{i}") for i, ((w, b), q) in enumerate(zip(open_, middle, strict=True))]).first()
        for (_, b), (lo, hi) in zip(open_, bounds, strict=True):
            b[0], b[1], b[4] = lo, hi, b[3]
        return dict(open_)

    @staticmethod
    def _pick(df: DataFrame, brackets: dict, sizes: dict) -> dict[Quantile, float]:
        keys = list(brackets)
        part = lambda i, w, b: F.expr(f"CASE WHEN {w.x} <= {double(b[1])} THEN named_struct('i', {i}, 'v', CASE WHEN {w.x} >= {double(b[0])} THEN {w.x} END) END")
        each = F.explode(F.array(*[part(i, w, brackets[w]) for i, w in enumerate(keys)])).alias("e")
        rows = df.select(each).where("e IS NOT NULL").groupBy("e.i", "e.v").count().collect()
        held: dict[int, list] = {i: [] for i in range(len(keys))}
        below = dict.fromkeys(held, 0)
        for i, v, n in rows:
            if v is None:
                below[i] = n
            else:
                held[i].append((v != v, v, n))
        out = {}
        for i, w in enumerate(keys):
            ends = []
            for rank in w.ranks(sizes[w]):
                upto = below[i]
                for _, v, n in sorted(held[i]):
                    upto += n
                    if upto > rank:
                        ends.append(v)
                        break
            if len(ends) < 2 or w.ranks(sizes[w])[0] < below[i]:  # the sketch broke its promise
                out[w] = df.agg(F.expr(w.sql)).first()[0]
            else:
                out[w] = ends[0] if ends[0] == ends[1] else 0.5 * ends[0] + 0.5 * ends[1]
        return out


def _sketch(x: str, q: float) -> str:
    return f"approx_percentile({x}, array({max(0.0, q - REACH)!r}D, {min(1.0, q + REACH)!r}D), {ACCURACY})"


def _within(x: str, bracket: list) -> str:
    return f"{x} BETWEEN {double(bracket[0])} AND {double(bracket[1])}"
