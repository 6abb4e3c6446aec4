"""Secret scans (operator 5): an incremental ledger of content-addressed blobs. DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds, per blob,
which rule versions have scanned it and what each of them found; a scan first writes down the
unseen (blob, rule version) pairs, then reads only texts that have one, one copy of each, and
appends one row per scanned blob in a single committed write, so a lost executor or driver leaves
the ledger as it was. Findings then join back to all paths that hold the blob; only those of the
rule versions asked for count, in the order these are named, so a rule that was replaced or
retired leaves nothing behind.

Text is shuffled only for that one copy, and not at all where the unseen pairs are few enough
for Catalyst to broadcast them. Hot blobs: copies are reduced to a smallest path per blob by a partial aggregate; the join back
is a plain equi-join of small rows, which adaptive execution splits where a blob is hot.

Defined results: a null text is the empty text; rows with a null path are scanned and reported
like others; repeated rows give a row each; an empty table gives an empty result; very many
matches in a text cost linear time (positions are running sums over rows, not arrays); other
columns pass through unread.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._common import hadoop_path, materialize, own_shuffles, release, remove, scratch


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; a match counts if its group ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base patterns of the contract.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(map(_either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (Rule("assign", 1, ASSIGN, 2, 8), Rule("access", 1, "AKIA[A-Z0-9]+", 0, 16), Rule("hex", 1, "[0-9a-f]{32,}", 0, 32))
EXTRA = (
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("platform", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})"),
)
RULES = BASE + EXTRA

_SPAN = "struct<start:int,rule:string,kind:string,end:int>"
_FOUND = "struct<start:int,rank:int,kind:string,end:int>"
_LEDGER = f"blob binary, rules array<string>, spans array<{_SPAN}>"


def spans_of(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, todo) to (blob, spans): matches of the rules in ``todo``."""
    found = []
    for r in rules:
        p, text = F.lit(r.pattern), F.col("text")
        counted = F.transform(F.regexp_extract_all(text, p, F.lit(r.group)), lambda x: F.length(x))
        lengths = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.length(x))
        gaps = F.transform(F.split(text, r.pattern, -1), lambda x: F.length(x))
        hit = F.array_contains("todo", r.name) & text.rlike(r.pattern)
        found.append(F.when(hit, F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), F.arrays_zip(gaps.alias("gap"), lengths.alias("len"), counted.alias("counted")).alias("m"))))
    per_rule = texts.select("blob", F.explode(F.array_compact(F.array(*found))).alias("r"))
    each = per_rule.select("blob", "r.rule", "r.kind", "r.least", F.posexplode("r.m").alias("pos", "m")).where("m.len IS NOT NULL")
    each = each.dropDuplicates(["blob", "rule", "pos"])
    upto = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(upto).cast("int"))
    kept = placed.where("m.counted >= least").select("blob", F.struct((F.col("end") - F.col("m.len")).alias("start"), "rule", "kind", "end").alias("span"))
    return kept.groupBy("blob").agg(F.sort_array(F.collect_list("span")).cast(f"array<{_SPAN}>").alias("spans"))


class BlobLedger:
    """A ledger at a path of the shared store."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules

    def read(self) -> DataFrame:
        fs, p = hadoop_path(self.spark, self.path)
        return self.spark.read.schema(_LEDGER).parquet(self.path) if fs.exists(p) else self.spark.createDataFrame([], _LEDGER)

    @staticmethod
    def addressed(versions: DataFrame, path: str, text: str) -> DataFrame:
        t = F.coalesce(F.col(text), F.lit(""))
        return versions.select(F.col(path).alias("path"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("blob"), t.alias("text"))

    def scan(self, versions: DataFrame, path: str, text: str) -> None:
        """Scan what is unseen and append it to the ledger."""
        v = self.addressed(versions, path, text)
        names = F.array(*[F.lit(r.name) for r in self.rules])
        heads = v.groupBy("blob").agg(F.min("path").alias("rep"))
        done = self.read().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        todo = F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
        unseen = materialize(heads.join(done, "blob", "left").select("blob", "rep", todo.alias("todo")).where(F.size("todo") > 0), "unseen")
        new = v.alias("v").join(unseen.alias("u"), F.col("v.path").eqNullSafe(F.col("u.rep")) & (F.col("v.blob") == F.col("u.blob"))).select("u.blob", "v.text", "u.todo")
        spans = spans_of(new, self.rules)
        out = unseen.select("blob", F.col("todo").alias("rules")).join(spans, "blob", "left").select("blob", "rules", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans"))
        with own_shuffles(self.spark):
            out.write.mode("append").parquet(self.path)
        release(unseen)

    def findings(self, versions: DataFrame, path: str, text: str) -> DataFrame:
        """(path, spans) for every row of ``versions``, from the ledger alone: spans of this ledger's rule versions, by start and then in the rules' order."""
        rank = F.array(*[F.lit(r.name) for r in self.rules])
        known = self.read().where(F.size("spans") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
        own = F.filter("spans", lambda s: F.array_contains(rank, s["rule"]))
        ranked = F.transform(own, lambda s: F.struct(s["start"].alias("start"), (F.array_position(rank, s["rule"]) - 1).cast("int").alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
        known = known.select(F.col("blob").alias("known"), F.sort_array(ranked).cast(f"array<{_FOUND}>").alias("spans"))
        heads = self.addressed(versions, path, text).select("path", "blob")
        return heads.join(known, heads.blob == known.known, "left").select("path", F.coalesce("spans", F.array().cast(f"array<{_FOUND}>")).alias("spans"))


def scan_secrets(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan all versions against the ledger (a new one if none is named); one row per row of ``versions``."""
    spark = versions.sparkSession
    book = BlobLedger(spark, ledger or scratch(spark, "ledger"), rules)
    book.scan(versions, path, text)
    if ledger:
        return book.findings(versions, path, text)
    out = materialize(book.findings(versions, path, text), "findings")
    remove(spark, book.path)
    return out


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{r.kind}')) AS BIGINT)").alias(f"n_{r.kind}") for r in BASE]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def brute_force(text: str | None) -> tuple:
    """n_assign, n_access, n_hex, base_sha256 by the letter of the contract; for tests."""
    text = text or ""
    out = []
    word = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password|passwd|secret|token|api_?key)", "((?ia:password|passwd|secret|token|api_?key))"))
    out += [(m.start(), 0, "assign", m.end()) for m in word.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    joined = ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(out))
    n = [sum(x[2] == k for x in out) for k in ("assign", "access", "hex")]
    return (*n, hashlib.sha256(joined.encode()).hexdigest())
