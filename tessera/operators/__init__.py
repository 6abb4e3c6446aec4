"""All steps."""

from tessera.operators.compose import Columns, Union
from tessera.operators.custom import Expression, custom
from tessera.operators.encoders import FrequencyEncoder, HashEncoder, OneHotEncoder, OrdinalEncoder
from tessera.operators.relational import Lookup, concat, concat_query, merge, merge_query
from tessera.operators.rows import Cast, Deduplicate, Drop, Filter, OutlierHandler, Rename, Sample, TargetTransform
from tessera.operators.scalars import Abs, Clip, DateDiff, DateParts, IsWeekend, Log, Lower, Power, Quarter, Reciprocal, Replace, Round, Sqrt, StringLength, Substring, Trim, Upper
from tessera.operators.scalers import Imputer, MaxAbsScaler, MinMaxScaler, Normalizer, RobustScaler, StandardScaler
from tessera.operators.selection import DropCorrelated, SelectKBest, VarianceThreshold
from tessera.operators.windows import Lag, Lead, Rank, RollingMean, RollingStd, RowNumber

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("compose", "encoders", "relational", "rows", "scalars", "scalers", "selection", "windows")]
