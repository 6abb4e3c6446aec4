"""Quality rules (operator 3): adaptive thresholds from mergeable quantile sketches.

Each document gets a few counts in one pass over its text. Ratios of these are sketched per
(language, source): logarithmic buckets of relative width ``GAMMA - 1`` with exact counts, so
sketches merge by adding counts, whatever the order, and a quantile is within 1 % of its value.
A group of fewer than ``min_docs`` documents uses the merged sketch of its language, and a small
language that of all documents. A ratio that is over q75, or for ratios of two tails under q25, by more
than ``spread`` * (q75 - q25) rejects a document: the cutoff follows each group's own
distribution. ``least`` is the distance from the quartile under which nothing counts as an
outlier; it only decides where a group's values hardly vary at all. The verdict joins documents with the
thresholds of their group, a table of groups x ratios that Catalyst broadcasts only if its size
on disk is under the session's limit.

Defined results: a null or empty text has no words and fails the base rule; null languages and
sources are groups of their own; repeated rows and ids are judged row by row; an empty table
gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import materialize, release

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
MIN_WORDS = 20
REPEAT_PERCENT = 30
GAMMA = 1.02
ZERO_BUCKET = -1_000_000
MIN_DOCS = 200
SPREAD = 6.0
#: ratio -> (numerator, denominator, least distance, whether low values are judged too)
RATIOS = {
    "symbol": ("n_symbols", "n_words", 0.15, False),
    "upper": ("n_upper", "word_chars", 0.15, False),
    "mark": ("n_marks", "n_words", 0.15, False),
    "dup_line": ("n_dup_lines", "n_lines", 0.45, False),
    "stutter": ("n_stutters", "n_words", 0.2, False),
    "word_len": ("word_chars", "n_words", 1.5, True),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines", "n_stutters"]
#: Texts are measured in runs of about so many bytes, which bounds a worker's memory.
CHUNK_BYTES = 6_000_000

_MIX = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) ^ (j << 17)) & 0xFFFFFFFFFFFFFFFF | 1) for j in range(WINDOW)]


def _repeat_words(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words in windows found twice or more, by text. ``words``: a hash each; ``ends``: by text."""
    n = len(ends)
    firsts = np.append(0, ends[:-1])
    out = np.zeros(n, np.int64)
    if len(words) <= WINDOW:
        return out
    m = len(words) - WINDOW + 1
    h = np.zeros(m, np.uint64)
    for j, mix in enumerate(_MIX):
        h += (words[j : j + m] ^ (words[j : j + m] >> np.uint64(31))) * mix
    text = np.repeat(np.arange(n), ends - firsts)[:m]
    starts = np.flatnonzero(np.arange(m) + WINDOW <= ends[text])
    h = h[starts] + text[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = starts[twice]
    if len(at):
        cover = np.zeros(len(words) + 1, np.int32)
        cover[at] += 1
        cover[at + WINDOW] -= 1
        covered = np.cumsum(cover[:-1]) > 0
        total = np.append(0, np.cumsum(covered))
        out = total[ends] - total[firsts]
    return out


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text (UTF-8)."""
    n = len(texts)
    out = {c: np.zeros(n, np.int64) for c in COUNTS}
    hashes = []
    for i, t in enumerate(texts):
        words = t.split()
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
        out["n_stutters"][i] = int((hashes[-1][1:] == hashes[-1][:-1]).sum())
        out["n_words"][i] = len(words)
        solid = t.translate(None, SPACE)
        out["word_chars"][i] = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
        out["n_symbols"][i] = len(t) - len(t.translate(None, SYMBOLS))
        out["n_upper"][i] = len(t) - len(t.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        out["n_marks"][i] = t.count(b"!") + t.count(b"?")
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    if n:
        out["n_repeat_words"] = _repeat_words(np.concatenate(hashes).view(np.uint64), np.cumsum(out["n_words"]))
    return out


def _measure(batches):
    for b in batches:
        column = b.column(b.schema.names.index("__text")).cast(pa.binary()).fill_null(b"")
        texts = column.to_numpy(zero_copy_only=False).tolist()
        runs = np.cumsum([len(x) for x in texts]) // CHUNK_BYTES if texts else []
        parts = [measure([texts[i] for i in p]) for p in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(runs)) + 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.concatenate([p[c] for p in parts])) for c in COUNTS)], names=["doc", *COUNTS])


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as a struct ``doc`` with the counts beside it."""
    kind = docs.schema.simpleString()
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text).alias("__text"))
    return src.mapInArrow(_measure, f"doc {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _ratio(name: str) -> F.Column:
    top, bottom, *_ = RATIOS[name]
    return F.col(top).cast("double") / F.greatest(F.col(bottom), F.lit(1)).cast("double")


def sketch(counted: DataFrame) -> DataFrame:
    """Bucket counts by (lang, source, ratio) of documents that pass the base rule."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), _ratio(r).alias("x")) for r in RATIOS])).alias("m")
    x = F.col("m.x")
    bucket = F.when(x <= 0, ZERO_BUCKET).otherwise(F.ceil(F.log(x) / math.log(GAMMA)).cast("int"))
    return counted.where(~base_failed()).select("lang", "source", each).groupBy("lang", "source", F.col("m.ratio").alias("ratio"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(sketches: DataFrame, min_docs: int = MIN_DOCS, spread: float = SPREAD) -> DataFrame:
    """A row per (lang, source) with a cutoff for each ratio, from the group's sketch or a merged one."""
    levels = {"own": ["lang", "source"], "language": ["lang"], "all": []}
    tables = {}
    for level, keys in levels.items():
        merged = sketches.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "ratio")
        ranked = merged.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bucket")))
        value = F.when(F.col("bucket") == ZERO_BUCKET, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (GAMMA + 1)))
        at = lambda q, value=value: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
        q = ranked.groupBy(*keys, "ratio").agg(at(0.25).alias("q25"), at(0.75).alias("q75"), F.first("total").alias("total"))
        by = lambda r: F.greatest(spread * (F.col("q75") - F.col("q25")), F.lit(RATIOS[r][2]))
        of = lambda r, x: F.max(F.when(F.col("ratio") == r, x))
        cuts = [of(r, F.col("q75") + by(r)).alias(f"{level}_{r}_high") for r in RATIOS] + [of(r, F.col("q25") - by(r)).alias(f"{level}_{r}_low") for r, x in RATIOS.items() if x[3]]
        tables[level] = q.groupBy(*keys).agg(*cuts, F.max("total").alias(f"{level}_n"))
    groups = tables["own"].alias("o").join(tables["language"].alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")))
    whole = tables["all"].first()  # one row of a number for each ratio
    pick = lambda r: F.when(F.col("own_n") >= min_docs, F.col(f"own_{r}")).when(F.col("language_n") >= min_docs, F.col(f"language_{r}")).otherwise(F.lit(whole[f"all_{r}"] if whole else None).cast("double"))
    cuts = [f"{r}_high" for r in RATIOS] + [f"{r}_low" for r, x in RATIOS.items() if x[3]]
    return groups.select(F.col("o.lang").alias("t_lang"), F.col("o.source").alias("t_source"), *[pick(c).alias(f"cut_{c}") for c in cuts])


def judge(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """``counted`` (with lang and source) with base_failed and kept."""
    joined = counted.join(cuts, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    out = F.lit(False)
    for r, (*_, low) in RATIOS.items():
        out = out | F.coalesce(_ratio(r) > F.col(f"cut_{r}_high"), F.lit(False))
        if low:
            out = out | F.coalesce(_ratio(r) < F.col(f"cut_{r}_low"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~out)


def _with_groups(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.col("doc.lang").alias("lang"), F.col("doc.source").alias("source"))


def _cuts(counted: DataFrame) -> DataFrame:
    sketches = materialize(sketch(counted), "sketches")
    cuts = materialize(thresholds(sketches), "cuts")
    release(sketches)
    return cuts


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, kept. The counts are written once and read twice."""
    slim = docs.select(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text"))
    counted = materialize(_with_groups(with_counts(slim).withColumn("doc", F.col("doc").dropFields("text"))).select(F.col("doc.doc_id").alias("doc_id"), "lang", "source", *COUNTS), "counts")
    cuts = _cuts(counted)
    out = materialize(judge(counted, cuts), "verdicts")
    release(counted, cuts)
    return out


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``. Texts are measured again rather than shuffled."""
    slim = docs.select("lang", "source", "text")
    counted = materialize(_with_groups(with_counts(slim).withColumn("doc", F.col("doc").dropFields("text"))).select("lang", "source", *COUNTS), "counts")
    cuts = _cuts(counted)
    release(counted)
    return judge(_with_groups(with_counts(docs)), cuts).where("kept").select([F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def brute_force(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by the letter of the contract; for tests."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - WINDOW + 1):
        windows.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(WINDOW)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)
