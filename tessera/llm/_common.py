"""Shared plumbing of the training-data operators: scratch tables, sizes, word splitting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Folders of local sessions that name none, by application; they go with the process.
_LOCAL: dict[str, str] = {}
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark removes a query's shuffle files when the query ends.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session without the setting gets a folder of its own; a cluster session
    without it is refused, as a machine-local folder would lose data there.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by the driver and all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def own_shuffles(spark: SparkSession, batch_bytes: str | None = None) -> Iterator[None]:
    """Shuffle files of the queries within go as each ends, by Spark's own setting.

    ``batch_bytes`` bounds what Python workers get at a time. Both settings are put back afterwards.
    """
    own = {CLEANUP_KEY: "true"} | ({BATCH_KEY: batch_bytes} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, batch_bytes: str | None = None) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back: cuts the lineage durably."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with own_shuffles(spark, batch_bytes):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing needs any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def unused(taken: list[str], name: str) -> str:
    """A column name that none of ``taken`` equals in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def anti_join(docs: DataFrame, lost: DataFrame, on: dict[str, F.Column]) -> DataFrame:
    """The rows of ``docs`` whose values of ``on`` are no row of ``lost``; ``on``: a column of ``lost`` and its value in ``docs``."""
    names = {c: unused(docs.columns, f"lost_{c}") for c in on}
    right = lost.select(*[F.col(c).alias(names[c]) for c in on])
    same = F.lit(True)
    for c, value in on.items():
        same = same & (value == F.col(names[c]))
    return docs.join(right, same, "left_anti")


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of Hadoop for a path of any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def shards_for(docs: DataFrame, text: str, per_shard: int) -> int:
    """How many shards hold ``per_shard`` bytes of text each: the count follows the input."""
    total = docs.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-int(total) // per_shard))


def hash_under(share: float, *of: F.Column) -> F.Column:
    """Whether a row's hash is in this share of all hashes."""
    return F.xxhash64(*of) <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))


def hash_sample(df: DataFrame, key: F.Column, value: F.Column, rows: int, total: int) -> list:
    """``value`` of about the ``rows`` rows of least hash, out of ``total``; only a few times as many leave their tasks."""
    share = min(1.0, 4 * rows / max(1, total))
    few = df.where(hash_under(share, key, value)).select(F.xxhash64(key, value).alias("h"), value.alias("v"))
    return [r["v"] for r in few.orderBy("h").limit(rows).collect()]


def reach_workers(spark: SparkSession) -> None:
    """Python workers find this package where the driver does, if it isn't installed for them."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in (known := [x for x in env.get("PYTHONPATH", "").split(":") if x]):
        env["PYTHONPATH"] = ":".join([*known, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
