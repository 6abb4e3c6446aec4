"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All but the
last return the columns of documents; the last returns a row per piece of the packed sequences.

Defined results: nulls in any column, empty texts, ties, repeated rows, empty tables and extra
columns are handled as each operator states; extra columns travel with their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, minhash, packing, quality
from tessera.llm._common import materialize, reach_workers, release, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep (operator 3)."""
    reach_workers(spark)
    return quality.filter_quality(docs)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their smallest document only (operator 10); n_chars follows the text."""
    reach_workers(spark)
    out = line_dedup.dedup_lines(docs)
    kinds = dict(docs.dtypes)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("doc.n_chars") if "n_chars" in kinds else F.lit(None)).cast(kinds.get("n_chars", "long"))}
    return out.select([new[c].alias(c) if c in new else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (operator 7)."""
    reach_workers(spark)
    return minhash.keep_first(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark (operator 9)."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences (operator 4)."""
    reach_workers(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_repeats),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]

#: The quality sketches could be put in SQL, but signatures, fingerprints and token ids can't: tests
#: hold the stages against brute-force versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written before the next stage reads it."""
    docs, kept = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if kept is not None:
            release(kept)
        kept = docs
    return STAGES[-1][1](spark, docs, sf_dir)
