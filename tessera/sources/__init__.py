"""Where data come from: frames, tables, files by suffix, pandas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession

from tessera.errors import FitError
from tessera.schema import Schema

FILE_SUFFIXES = (".parquet", ".csv", ".tsv", ".json")


def session(spark: SparkSession | None = None) -> SparkSession:
    """The given session, else the active one, else a new one."""
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def read_file(path: str, spark: SparkSession) -> DataFrame:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "json":
        return spark.read.json(path)
    return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if suffix == "tsv" else ",")


def resolve_input(data, spark: SparkSession | None = None, *, table_name: str | None = None) -> DataFrame:
    """A DataFrame for a frame, a table or view name, a file path, or a pandas frame."""
    if isinstance(data, DataFrame):
        df = data
    elif isinstance(data, str):
        s = session(spark)
        df = read_file(data, s) if data.lower().endswith(FILE_SUFFIXES) else s.table(data)
    elif type(data).__module__.startswith("pandas") and hasattr(data, "columns"):
        df = session(spark).createDataFrame(data)
    else:
        raise TypeError(f"can't read a {type(data).__name__}; give a DataFrame, a table name, a path or a pandas frame")
    if table_name:
        df.createOrReplaceTempView(table_name)
    return df


class Backend:
    """A Spark session by the calls that feature code needs."""

    dialect = "spark"

    def __init__(self, spark: SparkSession | None = None):
        self.spark = session(spark)

    def execute(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)

    def fetch_one(self, query: str | DataFrame) -> Row:
        row = (self.spark.sql(query) if isinstance(query, str) else query).first()
        if row is None:
            raise FitError("the query gave no row")
        return row

    def describe(self, source) -> Schema:
        return Schema.of(resolve_input(source, self.spark))

    def register(self, data, name: str) -> str:
        resolve_input(data, self.spark, table_name=name)
        return name

    def supports(self, feature: str) -> bool:
        return feature in {"windows", "ctes", "lateral_aliases", "streaming"}

    def close(self) -> None:
        """Sessions are shared, so nothing is closed."""

    def __enter__(self) -> Backend:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


SparkBackend = Backend
