"""Feature pipelines on Spark: steps learn by aggregates and apply as lazy plans."""

from tessera.errors import *  # noqa: F403
from tessera.operators import *  # noqa: F403
from tessera.pipeline import Pipeline, compose_transform
from tessera.schema import ColumnSelector, Schema, all_columns, boolean, categorical, columns, dtype, matching, numeric, resolve_columns, temporal
from tessera.sources import Backend, SparkBackend, resolve_input
from tessera.step import Transformer

__version__ = "0.1.0"
