"""Registered queries over the test tables, one per operator, with the same in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tessera as ts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = " ".join(sql.split())
        return f

    return put


def load(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def register(name: str, table: str, cols: list[str], steps, sql: str, *, round_: list[str] = (), digits: int = 6, y: str | None = None) -> None:
    """A pipeline fitted on a table and applied to it."""

    def run(spark, sf_dir):
        df = load(spark, sf_dir, table).selectExpr(*cols)
        out = ts.Pipeline([s.clone() for s in steps]).fit_transform(df, y)
        return rounded(out, *round_, digits=digits)

    query(name, sql)(run)


LI = ["l_orderkey", "l_quantity", "l_extendedprice"]
NUM = ["l_quantity", "l_extendedprice"]
OWN = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"
EV = ["event_id", "user_id", "ts", "value"]


def _li(expr: str, stats: str, select: str = "l_orderkey") -> str:
    """SQL over lineitem: ``expr`` for q(uantity) and p(rice), with statistics in a CTE."""
    out = ", ".join(f"round({expr.format(c=c, k=k)}, 6) AS {c}" for c, k in (("l_quantity", "q"), ("l_extendedprice", "p")))
    agg = ", ".join(stats.format(c=c, k=k) for c, k in (("l_quantity", "q"), ("l_extendedprice", "p")))
    return f"WITH s AS (SELECT {agg} FROM lineitem) SELECT {select}, {out} FROM lineitem, s"


# scalers and imputer
register("standard_scaler", "lineitem", LI, [ts.StandardScaler(columns=NUM)], _li("({c} - m_{k}) / nullif(d_{k}, 0)", "avg({c}) m_{k}, stddev_pop({c}) d_{k}"), round_=NUM)
register("minmax_scaler", "lineitem", LI, [ts.MinMaxScaler(feature_range=(-1, 1), columns=NUM)], _li("({c} - a_{k}) / nullif(z_{k} - a_{k}, 0) * 2 - 1", "min({c}) a_{k}, max({c}) z_{k}"), round_=NUM)
register("maxabs_scaler", "lineitem", LI, [ts.MaxAbsScaler(columns=NUM)], _li("{c} / nullif(z_{k}, 0)", "max(abs({c})) z_{k}"), round_=NUM)
register("robust_scaler", "lineitem", LI, [ts.RobustScaler(columns=NUM)], _li("({c} - m_{k}) / nullif(z_{k} - a_{k}, 0)", "median({c}) m_{k}, quantile_disc({c}, 0.25) a_{k}, quantile_disc({c}, 0.75) z_{k}"), round_=NUM)
for _n, _e in {"l2": "sqrt(l_discount * l_discount + l_tax * l_tax)", "l1": "(abs(l_discount) + abs(l_tax))", "max": "greatest(abs(l_discount), abs(l_tax))"}.items():
    register(f"normalizer_{_n}", "lineitem", ["l_orderkey", "l_discount", "l_tax"], [ts.Normalizer(norm=_n, columns=["l_discount", "l_tax"])], f"SELECT l_orderkey, round(l_discount / nullif({_e}, 0), 6) AS l_discount, round(l_tax / nullif({_e}, 0), 6) AS l_tax FROM lineitem", round_=["l_discount", "l_tax"])
_NULLED = ["event_id", f"{OWN} AS value", "nullif(event_type, 'view') AS event_type"]
for _s, _v in {"mean": "avg", "median": "median"}.items():
    register(f"imputer_{_s}", "events", _NULLED[:2], [ts.Imputer(_s, columns=["value"])], f"WITH e AS (SELECT event_id, {OWN} AS value FROM events) SELECT event_id, round(coalesce(value, (SELECT {_v}(value) FROM e)), 6) AS value FROM e", round_=["value"])
register("imputer_most_frequent", "events", [_NULLED[0], _NULLED[2]], [ts.Imputer("most_frequent", columns=["event_type"])], "WITH e AS (SELECT event_id, nullif(event_type, 'view') AS event_type FROM events), m AS (SELECT event_type AS v FROM e WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT event_id, coalesce(event_type, v) AS event_type FROM e, m")
register("imputer_auto", "events", _NULLED, [ts.Imputer(columns=["value", "event_type"])], f"WITH e AS (SELECT event_id, {OWN} AS value, nullif(event_type, 'view') AS event_type FROM events), m AS (SELECT event_type AS v FROM e WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT event_id, round(coalesce(value, (SELECT median(value) FROM e)), 6) AS value, coalesce(event_type, v) AS event_type FROM e, m", round_=["value"])
register("imputer_zero_constant", "events", _NULLED, [ts.Imputer({"value": "zero", "event_type": "none"})], f"SELECT event_id, coalesce({OWN}, 0) AS value, coalesce(nullif(event_type, 'view'), 'none') AS event_type FROM events")

# encoders
register("onehot_encoder", "customer", ["c_custkey", "c_mktsegment"], [ts.OneHotEncoder(columns=["c_mktsegment"])], "SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{v}' THEN 1 ELSE 0 END AS c_mktsegment_{v.lower()}" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
register("ordinal_encoder", "orders", ["o_orderkey", "o_orderpriority"], [ts.OrdinalEncoder(columns=["o_orderpriority"])], "WITH v AS (SELECT o_orderpriority AS k, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS n FROM (SELECT DISTINCT o_orderpriority FROM orders)) SELECT o_orderkey, n AS o_orderpriority FROM orders JOIN v ON o_orderpriority = k")
register("frequency_encoder", "part", ["p_partkey", "p_brand"], [ts.FrequencyEncoder(columns=["p_brand"])], "SELECT p_partkey, round(count(*) OVER (PARTITION BY p_brand) / CAST(count(*) OVER () AS DOUBLE), 9) AS p_brand FROM part", round_=["p_brand"], digits=9)


@query("hash_encoder", "SELECT p_type, 1 AS ones, count(*) AS parts, 1 AS buckets FROM part GROUP BY p_type")
def _hash(spark, sf_dir):
    """Every row has one bucket, and every value has one bucket over all its rows."""
    parts = load(spark, sf_dir, "part", "p_partkey", "p_type").withColumn("kind", F.col("p_type"))
    out = ts.Pipeline([ts.HashEncoder(n_features=8, columns=["p_type"])]).fit_transform(parts)
    flags = [F.col(f"p_type_hash_{i}") for i in range(8)]
    own = out.select("kind", sum(flags).alias("ones"), sum(f * i for i, f in enumerate(flags)).alias("bucket"))
    return own.groupBy(F.col("kind").alias("p_type")).agg(F.max("ones").alias("ones"), F.count("*").alias("parts"), F.countDistinct("bucket").cast("int").alias("buckets"))


# arithmetic
register("log", "lineitem", LI, [ts.Log(base=10, columns=NUM)], "SELECT l_orderkey, round(ln(l_quantity + 1) / ln(10), 6) AS l_quantity, round(ln(l_extendedprice + 1) / ln(10), 6) AS l_extendedprice FROM lineitem", round_=NUM)
_CU = ["c_custkey", "c_acctbal"]
for _name, _step, _sql in (
    ("sqrt", ts.Sqrt(columns=["c_acctbal"]), "sqrt(c_acctbal)"),
    ("power", ts.Power(exponent=2, columns=["c_acctbal"]), "pow(c_acctbal, 2)"),
    ("clip", ts.Clip(lower=0.0, upper=5000.0, columns=["c_acctbal"]), "CASE WHEN c_acctbal IS NOT NULL THEN greatest(least(c_acctbal, 5000.0), 0.0) END"),
    ("abs", ts.Abs(columns=["c_acctbal"]), "abs(c_acctbal)"),
    ("round", ts.Round(decimals=-1, columns=["c_acctbal"]), "round(c_acctbal, -1)"),
    ("reciprocal", ts.Reciprocal(columns=["c_acctbal"]), "1.0 / nullif(c_acctbal, 0)"),
):
    _from = "abs(c_acctbal)" if _name == "sqrt" else "c_acctbal"
    register(_name, "customer", ["c_custkey", f"{_from} AS c_acctbal"], [_step], f"WITH c AS (SELECT c_custkey, {_from} AS c_acctbal FROM customer) SELECT c_custkey, CAST(round({_sql}, 6) AS DOUBLE) AS c_acctbal FROM c", round_=["c_acctbal"])

# strings
_DOC = ["doc_id", "text"]
for _name, _step, _sql in (
    ("string_length", ts.StringLength(columns=["text"]), "length(text)"),
    ("lower", ts.Lower(columns=["lang"]), "lower(lang)"),
    ("upper", ts.Upper(columns=["text"]), "upper(text)"),
    ("trim", ts.Trim(characters=".,Tt ", columns=["text"]), "trim(text, '.,Tt ')"),
    ("replace", ts.Replace(old="the", new="[T]", columns=["text"]), "replace(text, 'the', '[T]')"),
    ("substring", ts.Substring(start=3, length=20, columns=["text"]), "substring(text, 3, 20)"),
):
    _col = _step.columns[0]
    register(_name, "documents", ["doc_id", _col], [_step], f"SELECT doc_id, {_sql} AS {_col} FROM documents")

# dates
_OR = ["o_orderkey", "o_orderdate"]
_DP = {"year": "year", "month": "month", "day": "day", "dayofweek": "dow", "hour": "hour", "minute": "minute", "second": "second", "quarter": "quarter", "week": "week", "dayofyear": "doy"}
register("date_parts", "orders", _OR, [ts.DateParts(parts=list(_DP), columns=["o_orderdate"])], "SELECT o_orderkey, o_orderdate, " + ", ".join(f"extract({v} FROM o_orderdate) AS o_orderdate_{k}" for k, v in _DP.items()) + " FROM orders")
register("is_weekend", "orders", _OR, [ts.IsWeekend(columns=["o_orderdate"])], "SELECT o_orderkey, CASE WHEN extract(dow FROM o_orderdate) IN (0, 6) THEN 1 ELSE 0 END AS o_orderdate FROM orders")
register("quarter", "orders", _OR, [ts.Quarter(columns=["o_orderdate"])], "SELECT o_orderkey, extract(quarter FROM o_orderdate) AS o_orderdate FROM orders")
for _u in ("day", "hour", "month", "year", "minute", "second", "week"):
    register(f"date_diff_{_u}", "orders", _OR, [ts.DateDiff(reference="1999-05-17 13:45:10", unit=_u, columns=["o_orderdate"])], f"SELECT o_orderkey, date_diff('{_u}', TIMESTAMP '1999-05-17 13:45:10', o_orderdate) AS o_orderdate FROM orders")

# windows
_W = {"order_by": "ts", "partition_by": "user_id"}
_OVER = "OVER (PARTITION BY user_id ORDER BY ts)"
register("lag", "events", EV, [ts.Lag(periods=2, columns=["value"], **_W)], f"SELECT event_id, user_id, ts, value, lag(value, 2) {_OVER} AS value_lag2 FROM events")
register("lead", "events", EV, [ts.Lead(columns=["value"], **_W)], f"SELECT event_id, user_id, ts, value, lead(value, 1) {_OVER} AS value_lead1 FROM events")
for _s, _f, _c in (("mean", "avg", "rmean"), ("std", "stddev_pop", "rstd")):
    register(f"rolling_{_s}", "events", EV, [(ts.RollingMean if _s == "mean" else ts.RollingStd)(window=5, columns=["value"], **_W)], f"SELECT event_id, user_id, ts, value, round({_f}(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS value_{_c}5 FROM events", round_=[f"value_{_c}5"], digits=4)
for _m in ("rank", "dense_rank", "row_number"):
    _o = "o_orderkey" if _m == "row_number" else "o_orderdate"
    register(f"rank_{_m}", "orders", ["o_orderkey", "o_custkey", "o_orderdate"], [ts.Rank(order_by=_o, partition_by="o_custkey", method=_m)], f'SELECT o_orderkey, o_custkey, o_orderdate, {_m}() OVER (PARTITION BY o_custkey ORDER BY {_o}) AS "rank" FROM orders')
register("rank_by_column", "orders", ["o_orderkey", "o_custkey", "o_totalprice"], [ts.Rank(order_by="o_orderkey", partition_by="o_custkey", columns=["o_totalprice"])], "SELECT o_orderkey, o_custkey, o_totalprice, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS o_totalprice_rank FROM orders")
register("row_number", "events", ["event_id", "user_id", "ts"], [ts.RowNumber(**_W)], f"SELECT event_id, user_id, ts, row_number() {_OVER} AS row_number FROM events")
register("row_number_global", "events", ["event_id", "ts"], [ts.RowNumber(order_by="ts")], "SELECT event_id, ts, row_number() OVER (ORDER BY ts) AS row_number FROM events")
register("lag_global", "events", ["event_id", "ts", "value"], [ts.Lag(periods=3, order_by="ts", columns=["value"])], "SELECT event_id, ts, value, lag(value, 3) OVER (ORDER BY ts) AS value_lag3 FROM events")
register("rolling_mean_global", "events", ["event_id", "ts", "value"], [ts.RollingMean(window=4, order_by="ts", columns=["value"])], "SELECT event_id, ts, value, round(avg(value) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS value_rmean4 FROM events", round_=["value_rmean4"], digits=4)

# outliers and targets
_FENCE = "WITH s AS (SELECT quantile_disc(l_extendedprice, 0.25) a, quantile_disc(l_extendedprice, 0.75) z FROM lineitem) SELECT {} FROM lineitem, s"
register("outlier_iqr_clip", "lineitem", ["l_orderkey", "l_extendedprice"], [ts.OutlierHandler(threshold=0.5, columns=["l_extendedprice"])], _FENCE.format("l_orderkey, round(greatest(least(l_extendedprice, z + 0.5 * (z - a)), a - 0.5 * (z - a)), 6) AS l_extendedprice"), round_=["l_extendedprice"])
register("outlier_iqr_remove", "lineitem", ["l_orderkey", "l_extendedprice"], [ts.OutlierHandler(threshold=0.2, action="remove", columns=["l_extendedprice"])], _FENCE.format("l_orderkey, l_extendedprice") + " WHERE l_extendedprice BETWEEN a - 0.2 * (z - a) AND z + 0.2 * (z - a)")
_Z = "WITH s AS (SELECT avg(c_acctbal) m, stddev_pop(c_acctbal) d FROM customer) SELECT {} FROM customer, s"
register("outlier_zscore_clip", "customer", _CU, [ts.OutlierHandler(method="zscore", threshold=1, columns=["c_acctbal"])], _Z.format("c_custkey, round(greatest(least(c_acctbal, m + d), m - d), 6) AS c_acctbal"), round_=["c_acctbal"])
register("outlier_zscore_remove", "customer", _CU, [ts.OutlierHandler(method="zscore", action="remove", threshold=1.5, columns=["c_acctbal"])], _Z.format("c_custkey, c_acctbal") + " WHERE c_acctbal BETWEEN m - 1.5 * d AND m + 1.5 * d")
_P = ["o_orderkey", "o_totalprice"]
register("target_log", "orders", _P, [ts.TargetTransform(columns=["o_totalprice"])], "SELECT o_orderkey, round(ln(o_totalprice + 1), 6) AS o_totalprice FROM orders", round_=["o_totalprice"])
register("target_sqrt", "orders", _P, [ts.TargetTransform(method="sqrt", columns=["o_totalprice"])], "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS o_totalprice FROM orders", round_=["o_totalprice"])
register("target_boxcox_auto", "orders", _P, [ts.TargetTransform(method="boxcox", columns=["o_totalprice"])], "WITH s AS (SELECT round(1 / (1 + abs(avg(ln(o_totalprice)))), 4) AS p FROM orders) SELECT o_orderkey, round((pow(o_totalprice, p) - 1) / p, 5) AS o_totalprice FROM orders, s", round_=["o_totalprice"], digits=5)

# rows and columns
register("filter", "events", EV, [ts.Filter(condition="value > 50 AND event_type <> 'view'")], "SELECT event_id, user_id, ts, value FROM events WHERE value > 50 AND event_type <> 'view'")
QUERIES["filter"] = lambda spark, sf_dir: ts.Pipeline([ts.Filter(condition="value > 50 AND event_type <> 'view'")]).fit_transform(load(spark, sf_dir, "events")).select(*EV)
register("cast", "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice"], [ts.Cast({"l_orderkey": "string", "l_extendedprice": "bigint"})], "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, l_quantity, CAST(l_extendedprice AS BIGINT) AS l_extendedprice FROM lineitem")
register("rename", "customer", _CU, [ts.Rename(mapping={"c_acctbal": "balance"})], "SELECT c_custkey, c_acctbal AS balance FROM customer")
register("drop", "region", ["*"], [ts.Drop(columns=["r_name"])], "SELECT r_regionkey FROM region")
register("deduplicate_all", "orders", ["o_orderstatus", "o_orderpriority"], [ts.Deduplicate()], "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
register("deduplicate_first", "orders", ["o_orderkey", "o_custkey", "o_totalprice"], [ts.Deduplicate(subset=["o_custkey"], order_by="o_orderkey")], "SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) n FROM orders) WHERE n = 1")
register("deduplicate_last", "orders", ["o_orderkey", "o_custkey", "o_totalprice"], [ts.Deduplicate(subset=["o_custkey"], keep="last", order_by="o_orderkey")], "SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) n FROM orders) WHERE n = 1")
register("deduplicate_none", "documents", ["doc_id", "text"], [ts.Deduplicate(subset=["text"], keep="none")], "SELECT doc_id, text FROM (SELECT *, count(*) OVER (PARTITION BY text) n FROM documents) WHERE n = 1")


@query("sample_n", "SELECT least(500, count(*)) AS n, least(500, count(*)) AS keys FROM customer")
def _sample_n(spark, sf_dir):
    out = ts.Pipeline([ts.Sample(n=500, seed=7)]).fit_transform(load(spark, sf_dir, "customer", "c_custkey"))
    return out.agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("keys"))


@query("sample_fraction", "SELECT true AS near, 0 AS strangers, 0 AS repeats FROM (SELECT count(*) FROM orders)")
def _sample_fraction(spark, sf_dir):
    """Its size lies within six standard deviations of what it should be, and all its rows are rows of the table, once."""
    df = load(spark, sf_dir, "orders", "o_orderkey")
    out = ts.Pipeline([ts.Sample(fraction=0.1, seed=7)]).fit_transform(df).groupBy(F.col("o_orderkey").alias("key")).agg(F.count("*").alias("n"))
    both = df.join(out, F.col("o_orderkey") == F.col("key"), "full").agg(F.count("o_orderkey").alias("all"), F.sum("n").alias("taken"), F.count_if(F.col("o_orderkey").isNull()).cast("int").alias("strangers"), F.count_if(F.col("n") > 1).cast("int").alias("repeats"))
    return both.select((F.abs(F.col("taken") - 0.1 * F.col("all")) <= 6 * F.sqrt(0.09 * F.col("all"))).alias("near"), "strangers", "repeats")


# joins and stacking
# a third of the customers' keys and half of the orders' move out of the other side's range, so that both have rows without a match
_KEYED = "SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS k, c_name AS name, c_acctbal AS v FROM customer"
_ORDERED = "SELECT CASE WHEN o_custkey % 2 = 1 THEN -1000000000 - o_custkey ELSE o_custkey END AS k, o_orderkey AS name, o_totalprice AS v FROM orders"
for _how in ("inner", "left", "right", "outer"):

    @query(f"merge_{_how}", f"SELECT l.k, l.name AS name_left, l.v AS v_left, r.name AS name_right, r.v AS v_right FROM ({_KEYED}) l {'FULL OUTER' if _how == 'outer' else _how.upper()} JOIN ({_ORDERED}) r ON l.k = r.k")
    def _merge(spark, sf_dir, how=_how):
        a = load(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS k", "c_name AS name", "c_acctbal AS v")
        b = load(spark, sf_dir, "orders").selectExpr("CASE WHEN o_custkey % 2 = 1 THEN -1000000000 - o_custkey ELSE o_custkey END AS k", "o_orderkey AS name", "o_totalprice AS v")
        return ts.merge(a, b, on="k", how=how)


@query("merge_different_keys", "SELECT c_custkey, c_nationkey, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _merge_keys(spark, sf_dir):
    return ts.merge(load(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), load(spark, sf_dir, "nation", "n_nationkey", "n_name"), left_on="c_nationkey", right_on="n_nationkey")


@query("merge_cross", "SELECT * FROM region CROSS JOIN nation")
def _cross(spark, sf_dir):
    return ts.merge(load(spark, sf_dir, "region"), load(spark, sf_dir, "nation"), how="cross")


@query("lookup", "SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _lookup(spark, sf_dir):
    other = load(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return ts.Pipeline([ts.Lookup(other, on="o_custkey", select=["c_mktsegment", "c_nationkey"])]).fit_transform(load(spark, sf_dir, "orders", "o_orderkey", "o_custkey"))


@query("concat_strict", "SELECT s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def _concat(spark, sf_dir):
    return ts.concat(load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_acctbal AS v"), load(spark, sf_dir, "customer").selectExpr("c_acctbal AS v", "c_custkey AS k"))


@query("concat_align", "SELECT s_suppkey AS k, s_acctbal AS v, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def _align(spark, sf_dir):
    return ts.concat(load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_acctbal AS v"), load(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_mktsegment AS seg"), align=True)


# selection
register("variance_threshold", "part", ["p_partkey", "p_size", "p_retailprice", "1 AS same"], [ts.VarianceThreshold(columns=["p_size", "p_retailprice", "same"])], "SELECT p_partkey, p_size, p_retailprice FROM part")
register("drop_correlated", "lineitem", ["l_orderkey", "l_quantity", "l_discount", "2 * l_quantity + 1 AS twice"], [ts.DropCorrelated(columns=["l_quantity", "l_discount", "twice"])], "SELECT l_orderkey, l_quantity, l_discount FROM lineitem")
register("select_k_best", "lineitem", ["l_orderkey", "l_quantity", "l_discount", "l_quantity * 3 + l_tax AS goal", "l_tax"], [ts.SelectKBest(k=1, columns=["l_quantity", "l_discount", "l_tax"])], "SELECT l_orderkey, l_quantity, l_quantity * 3 + l_tax AS goal FROM lineitem", y="goal")

# composition and extension
register("expression", "lineitem", LI, [ts.Expression("l_quantity * l_extendedprice AS amount")], "SELECT l_orderkey, l_quantity, l_extendedprice, l_quantity * l_extendedprice AS amount FROM lineitem")
register("custom_per_column", "lineitem", LI, [ts.custom("{col} - {m}", columns=NUM, learn={"m": "avg({col})"})], _li("{c} - m_{k}", "avg({c}) m_{k}"), round_=NUM)
register("custom_combine", "lineitem", LI, [ts.custom("l_quantity / l_extendedprice AS ratio", mode="combine")], "SELECT l_orderkey, l_quantity, l_extendedprice, round(l_quantity / l_extendedprice, 9) AS ratio FROM lineitem", round_=["ratio"], digits=9)
register("column_groups", "lineitem", LI, [ts.Columns([("scaled", ts.StandardScaler(), ["l_quantity"]), ("bounded", ts.MinMaxScaler(), ["l_extendedprice"])], remainder="passthrough")], "WITH s AS (SELECT avg(l_quantity) m, stddev_pop(l_quantity) d, min(l_extendedprice) a, max(l_extendedprice) z FROM lineitem) SELECT l_orderkey, round((l_quantity - m) / d, 6) AS l_quantity, round((l_extendedprice - a) / (z - a), 6) AS l_extendedprice FROM lineitem, s", round_=NUM)
register("branch_union", "customer", _CU, [ts.Union([("raw", ts.Abs(columns=["c_acctbal"])), ("scaled", ts.MaxAbsScaler(columns=["c_acctbal"]))])], "SELECT c_custkey AS raw_c_custkey, abs(c_acctbal) AS raw_c_acctbal, c_custkey AS scaled_c_custkey, round(c_acctbal / (SELECT max(abs(c_acctbal)) FROM customer), 6) AS scaled_c_acctbal FROM customer", round_=["scaled_c_acctbal"])
register(
    "pipeline_layered", "events", _NULLED, [ts.Imputer("median", columns=["value"]), ts.StandardScaler(columns=["value"]), ts.OneHotEncoder(columns=["event_type"])],
    f"WITH e AS (SELECT event_id, {OWN} AS value, nullif(event_type, 'view') AS t FROM events), s AS (SELECT median(value) f, avg(value) m, stddev_pop(value) d FROM e) SELECT event_id, round((coalesce(value, f) - m) / d, 6) AS value, " + ", ".join(f"CASE WHEN t = '{v}' THEN 1 ELSE 0 END AS event_type_{v}" for v in ("click", "error", "purchase", "signup")) + " FROM e, s", round_=["value"],
)


@query("pipeline_sequential", f"WITH e AS (SELECT event_id, {OWN} AS value FROM events), i AS (SELECT event_id, coalesce(value, (SELECT avg(value) FROM e)) AS value FROM e), s AS (SELECT avg(value) m, stddev_pop(value) d FROM i) SELECT event_id, round((value - m) / d, 6) AS value FROM i, s")
def _sequential(spark, sf_dir):
    df = load(spark, sf_dir, "events").selectExpr(*_NULLED[:2])
    return rounded(ts.Pipeline([ts.Imputer("mean", columns=["value"]), ts.StandardScaler(columns=["value"])], fit_mode="sequential").fit_transform(df), "value")


@query("pipeline_sql_text", SQL["pipeline_layered"])
def _sql_text(spark, sf_dir):
    df = load(spark, sf_dir, "events").selectExpr(*_NULLED)
    p = ts.Pipeline([ts.Imputer("median", columns=["value"]), ts.StandardScaler(columns=["value"]), ts.OneHotEncoder(columns=["event_type"])]).fit(df)
    df.createOrReplaceTempView("ts_sql_text")
    return rounded(spark.sql(p.to_sql("ts_sql_text")), "value")


# sources, sinks and ways to compose
_SCALED = _li("({c} - m_{k}) / nullif(d_{k}, 0)", "avg({c}) m_{k}, stddev_pop({c}) d_{k}")


@query("scan_path", "SELECT * FROM nation")
def _scan_path(spark, sf_dir):
    return ts.resolve_input(f"{sf_dir}/nation.parquet", spark)


@query("scan_table", "SELECT * FROM supplier")
def _scan_table(spark, sf_dir):
    load(spark, sf_dir, "supplier").createOrReplaceTempView("ts_supplier")
    return ts.resolve_input("ts_supplier", spark)


@query("scan_pandas", "SELECT * FROM region")
def _scan_pandas(spark, sf_dir):
    return ts.resolve_input(load(spark, sf_dir, "region").toPandas(), spark)


@query("describe", "SELECT * FROM (VALUES ('o_orderkey', 'numeric'), ('o_custkey', 'numeric'), ('o_orderstatus', 'categorical'), ('o_totalprice', 'numeric'), ('o_orderdate', 'temporal'), ('o_orderpriority', 'categorical')) AS t(column_name, category)")
def _describe(spark, sf_dir):
    schema = ts.SparkBackend(spark).describe(f"{sf_dir}/orders.parquet")
    return spark.createDataFrame([(c, schema.column_category(c)) for c in schema], "column_name string, category string")


@query("backend_register_fetch", "SELECT count(*) AS n, sum(o_totalprice) > 0 AS positive FROM orders")
def _backend(spark, sf_dir):
    with ts.SparkBackend(spark) as backend:
        name = backend.register(load(spark, sf_dir, "orders"), "ts_orders")
        row = backend.fetch_one(f"SELECT count(*) AS n, sum(o_totalprice) > 0 AS positive FROM {name}")
    return spark.createDataFrame([tuple(row)], "n long, positive boolean")


@query("sink_numpy", "SELECT count(*) AS n, round(sum(v), 4) AS total FROM (SELECT abs(c_acctbal) AS v FROM customer)")
def _numpy(spark, sf_dir):
    out = ts.Pipeline([ts.Abs(columns=["c_acctbal"])]).fit(load(spark, sf_dir, "customer", "c_acctbal"))
    got = out.to_numpy(load(spark, sf_dir, "customer", "c_acctbal"))
    return spark.createDataFrame([(len(got), round(float(got.sum()), 4))], "n long, total double")


@query("sink_sql_text_joins", "SELECT o_orderkey, n AS o_clerk, c_mktsegment FROM orders JOIN (SELECT o_clerk AS k, CAST(row_number() OVER (ORDER BY o_clerk) - 1 AS INTEGER) AS n FROM (SELECT DISTINCT o_clerk FROM (SELECT concat('c', o_custkey) AS o_clerk FROM orders))) v ON concat('c', o_custkey) = k LEFT JOIN customer ON o_custkey = c_custkey")
def _sql_joins(spark, sf_dir):
    """Text that joins a learned table of many categories and a looked-up frame, run as SQL."""
    df = load(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "concat('c', o_custkey) AS o_clerk")
    other = load(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_mktsegment")
    p = ts.Pipeline([ts.OrdinalEncoder(columns=["o_clerk"]), ts.Lookup(other, on="o_custkey"), ts.Drop(columns=["o_custkey"])]).fit(df)
    df.createOrReplaceTempView("ts_sql_joins")
    return spark.sql(p.to_sql("ts_sql_joins"))


@query("merge_query", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _merge_query(spark, sf_dir):
    return ts.merge_query(load(spark, sf_dir, "nation"), load(spark, sf_dir, "region"), left_on="n_regionkey", right_on="r_regionkey").select("n_name", "r_name")


@query("concat_query", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
def _concat_query(spark, sf_dir):
    return ts.concat_query(load(spark, sf_dir, "region").selectExpr("r_name AS name"), load(spark, sf_dir, "nation").selectExpr("n_name AS name"))


@query("deduplicate_last_whole_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _dedup_last(spark, sf_dir):
    return ts.Pipeline([ts.Deduplicate(keep="last")]).fit_transform(load(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority"))


class Halved(ts.Transformer):
    """A step of one's own."""

    default_columns = "numeric"
    learns = True

    def discover(self, columns, schema, y):
        return {f"{c}__max": f"max(`{c}`)" for c in columns}

    def expressions(self, columns, schema):
        return {f"{c}_half": f"(`{c}` / {self.params_[f'{c}__max']} / 2)" for c in columns}

    def outputs(self, columns, schema):
        return [f"{c}_half" for c in columns]


@query("user_step", "SELECT p_partkey, p_size, round(p_size / (SELECT max(p_size) FROM part) / 2, 6) AS p_size_half FROM part")
def _user_step(spark, sf_dir):
    return rounded(ts.Pipeline([Halved(columns=["p_size"])]).fit_transform(load(spark, sf_dir, "part", "p_partkey", "p_size")), "p_size_half")


@query("added_pipelines", f"WITH e AS (SELECT event_id, {OWN} AS value FROM events), s AS (SELECT avg(value) f, avg(abs(value)) m, stddev_pop(abs(value)) d FROM e) SELECT event_id, round((abs(coalesce(value, f)) - m) / d, 5) AS value FROM e, s")
def _added(spark, sf_dir):
    """Steps and pipelines added up; learners of one layer share its input."""
    df = load(spark, sf_dir, "events").selectExpr(*_NULLED[:2])
    p = ts.Imputer("mean", columns=["value"]) + ts.Abs(columns=["value"])
    p += ts.StandardScaler(columns=["value"])
    return rounded(p.fit_transform(df), "value", digits=5)


@query("direct_fit", _SCALED)
def _direct(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem", *LI)
    return rounded(ts.StandardScaler(columns=NUM).fit(df).transform(df), *NUM)


@query("copied_and_pickled", SQL["ordinal_encoder"])
def _pickled(spark, sf_dir):
    import pickle

    df = load(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    p = ts.Pipeline([ts.OrdinalEncoder(columns=["o_orderpriority"])]).fit(df)
    return pickle.loads(pickle.dumps(p.copy())).transform(df)


@query("flagship", "WITH s AS (SELECT avg(l_quantity) mq, stddev_pop(l_quantity) dq, min(l_extendedprice) a, max(l_extendedprice) z FROM lineitem) SELECT l_orderkey, round((l_quantity - mq) / dq, 6) AS l_quantity, round((ln(l_extendedprice + 1) - lm) / ld, 6) AS l_extendedprice, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS l_returnflag_a, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS l_returnflag_n, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS l_returnflag_r FROM lineitem, s, (SELECT avg(ln(l_extendedprice + 1)) lm, stddev_pop(ln(l_extendedprice + 1)) ld FROM lineitem) t")
def flagship(spark, sf_dir):
    """Log a price, standardise, one-hot: two jobs to learn, one scan to apply."""
    df = load(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")
    p = ts.Pipeline([ts.Log(columns=["l_extendedprice"]), ts.StandardScaler(columns=NUM), ts.OneHotEncoder(columns=["l_returnflag"])])
    return rounded(p.fit_transform(df), *NUM)
