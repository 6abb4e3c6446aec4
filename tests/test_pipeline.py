"""Values that the steps must give, on small inline tables."""

import math

import pytest
from pyspark.sql import functions as F

import tessera as ts


def rows(df):
    return [tuple(r) for r in df.collect()]


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


NULLS = [(1.0, 10.0), (2.0, None), (None, 30.0), (4.0, 40.0), (5.0, 50.0)]
MIXED = [(1.0, 10.0, "London"), (2.0, None, "Paris"), (None, 30.0, "London"), (4.0, 40.0, "Tokyo"), (5.0, 50.0, "Paris")]


def test_standard_scaler_values(spark):
    p = ts.Pipeline([ts.StandardScaler()]).fit(frame(spark, [(float(i), 10.0 * i) for i in range(1, 6)], "a double, b double"))
    s = p[0].params_
    assert s["a__mean"] == 3 and s["b__mean"] == 30
    assert s["a__std"] == pytest.approx(1.4142135623730951) and s["b__std"] == pytest.approx(14.142135623730951)


def test_layered_learners_share_the_input(spark):
    df = frame(spark, NULLS, "a double, b double")
    p = ts.Pipeline([ts.Imputer("mean"), ts.StandardScaler()]).fit(df)
    assert p[0].params_ == {"a__value": 3.0, "b__value": 32.5}
    assert p[1].params_["a__std"] == pytest.approx(1.5811388300841898) and p[1].params_["b__std"] == pytest.approx(14.79019945774904)
    q = ts.Pipeline([ts.Imputer("mean"), ts.StandardScaler()], fit_mode="sequential").fit(df)
    assert q[1].params_["a__std"] == pytest.approx(math.sqrt(2.0))


def test_full_pipeline(spark):
    df = frame(spark, MIXED, "price double, quantity double, city string")
    p = ts.Pipeline([ts.Imputer(), ts.StandardScaler(), ts.OneHotEncoder()]).fit(df)
    assert p[0].params_ == {"price__value": 3.0, "quantity__value": 35.0, "city__value": "London"}
    out = p.transform(df)
    assert out.columns == ["price", "quantity", "city_london", "city_paris", "city_tokyo"]
    df.createOrReplaceTempView("full_t")
    assert sorted(rows(spark.sql(p.to_sql("full_t")))) == sorted(rows(out))
    assert rows(out.select("quantity"))[1][0] == pytest.approx((35.0 - 32.5) / 14.79019945774904)


def test_one_aggregate_job_per_layer(spark):
    calls = []
    from tessera.pipeline import Pipeline

    class Counting(Pipeline):
        @staticmethod
        def _learn(df, waiting):
            calls.append(len(waiting))
            Pipeline._learn(df, waiting)

    Counting([ts.Imputer("mean"), ts.StandardScaler(), ts.MinMaxScaler()]).fit(frame(spark, NULLS, "a double, b double"))
    assert calls == [3]


def test_constant_and_null_columns(spark):
    df = frame(spark, [(1.0, 5.0, None), (2.0, 5.0, None)], "a double, b double, c double")
    out = rows(ts.Pipeline([ts.StandardScaler()]).fit_transform(df))
    assert [r[1:] for r in out] == [(None, None)] * 2
    assert [r[2] for r in rows(ts.Pipeline([ts.Imputer("mean")]).fit_transform(df))] == [None, None]


def test_later_steps_keep_new_columns(spark):
    df = frame(spark, [(1.0, "x"), (2.0, "y"), (3.0, "x")], "a double, c string")
    out = ts.Pipeline([ts.OneHotEncoder(), ts.StandardScaler(columns=["a"])]).fit_transform(df)
    assert out.columns == ["a", "c_x", "c_y"]


def test_static_steps_come_before_learning(spark):
    df = frame(spark, [(1.0,), (2.0,), (-1.0,), (3.0,), (0.0,)], "a double")
    p = ts.Pipeline([ts.Filter(condition="a > 0"), ts.StandardScaler()]).fit(df)
    assert p[1].params_["a__mean"] == 2.0
    assert p.transform(df).count() == 3


def test_encoders(spark):
    df = frame(spark, [("b",), ("a",), (None,), ("b",)], "c string")
    assert [r[0] for r in rows(ts.Pipeline([ts.OrdinalEncoder()]).fit_transform(df))] == [1, 0, None, 1]
    assert [r[0] for r in rows(ts.Pipeline([ts.OrdinalEncoder(handle_unknown="use_encoded_value", unknown_value=-1)]).fit_transform(df))] == [1, 0, -1, 1]
    assert [r[0] for r in rows(ts.Pipeline([ts.FrequencyEncoder()]).fit_transform(df))] == [0.5, 0.25, 0.0, 0.5]
    out = ts.Pipeline([ts.HashEncoder(n_features=4)]).fit_transform(df)
    assert out.columns == [f"c_hash_{i}" for i in range(4)] and all(sum(r) == 1 for r in rows(out))
    p = ts.Pipeline([ts.OrdinalEncoder()]).fit(df)
    with pytest.raises(ts.UnseenCategoryError):
        p[0].check_unseen(frame(spark, [("z",)], "c string"))


def test_many_categories_join(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 10 = 3 THEN NULL ELSE concat('v', id % 1500) END AS c", "id")
    p = ts.Pipeline([ts.OrdinalEncoder(handle_unknown="use_encoded_value", unknown_value=-1)]).fit(df)
    out = p.transform(df)
    assert out.columns == ["c", "id"] and out.schema["c"].dataType.simpleString() == "int"
    order = {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(1500) if i % 10 != 3))}
    assert {r["id"]: r["c"] for r in out.collect()} == {i: order.get(f"v{i % 1500}", -1) if i % 10 != 3 else -1 for i in range(3000)}


def test_scalar_edges(spark):
    df = frame(spark, [(0.0,), (-2.0,), (None,), (4.0,)], "a double")
    out = [r[0] for r in rows(ts.Pipeline([ts.Log(offset=0)]).fit_transform(df))]
    assert out[0] == -math.inf and math.isnan(out[1]) and out[2] is None
    assert [r[0] for r in rows(ts.Pipeline([ts.Reciprocal()]).fit_transform(df))] == [None, -0.5, None, 0.25]
    assert [r[0] for r in rows(ts.Pipeline([ts.Clip(lower=-1.0, upper=1.0)]).fit_transform(df))] == [0.0, -1.0, None, 1.0]
    text = frame(spark, [("straße  ",), (None,)], "s string")
    assert rows(ts.Pipeline([ts.Upper()]).fit_transform(text))[0][0] == "STRAẞE  "
    assert rows(ts.Pipeline([ts.Trim()]).fit_transform(text))[0][0] == "straße"


def test_windows_put_nulls_last(spark):
    df = frame(spark, [(1, None), (2, 5.0), (3, 1.0)], "id int, v double")
    out = {r["id"]: r["rank"] for r in ts.Pipeline([ts.Rank(order_by="v")]).fit_transform(df).collect()}
    assert out == {3: 1, 2: 2, 1: 3}
    with pytest.raises(ts.MissingColumnError):
        ts.Pipeline([ts.Lag(order_by="zz")]).fit(df)


def test_global_windows_in_blocks(spark):
    from tessera.operators import windows

    df = spark.range(500).selectExpr("id", "CASE WHEN id % 50 = 7 THEN NULL ELSE pmod(id * 7919, 101) END AS k", "pmod(id * 31, 17) * 1.0D AS v").repartition(5)
    df.createOrReplaceTempView("gw")
    for step, sql in ((ts.Rank(order_by="k"), "rank() OVER (ORDER BY k ASC NULLS LAST)"), (ts.Rank(order_by="k", method="dense_rank"), "dense_rank() OVER (ORDER BY k ASC NULLS LAST)"), (ts.RowNumber(order_by="id"), "row_number() OVER (ORDER BY id)"), (ts.Lead(periods=3, order_by="id", columns=["v"]), "lead(v, 3) OVER (ORDER BY id)"), (ts.Lag(periods=2, order_by="id", columns=["v"]), "lag(v, 2) OVER (ORDER BY id)"), (ts.RollingMean(window=5, order_by="id", columns=["v"]), "avg(v) OVER (ORDER BY id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")):
        p = ts.Pipeline([step]).fit(df)
        op = p._ops[0]
        assert isinstance(op, windows.GlobalWindow)
        op.block_rows = 16
        new = [c for c in p.output_schema_ if c not in ("id", "k", "v")][0]
        got = {r["id"]: r[new] for r in p.transform(df).collect()}
        assert got == {r["id"]: r["x"] for r in spark.sql(f"SELECT id, {sql} AS x FROM gw").collect()}, sql


def test_global_window_over_nulls(spark):
    df = spark.range(5).selectExpr("CAST(NULL AS DOUBLE) AS a", "id")
    out = ts.Pipeline([ts.RowNumber(order_by="a")]).fit_transform(df)
    assert sorted(r["row_number"] for r in out.collect()) == [1, 2, 3, 4, 5]
    p = ts.Pipeline([ts.RowNumber(order_by="a")]).fit(df)
    assert sorted((r["a"], r["row_number"]) for r in p.transform(frame(spark, [(3.0, 1), (1.0, 2)], "a double, id long")).collect()) == [(1.0, 1), (3.0, 2)]


def test_selection(spark):
    df = frame(spark, [(float(i), 2.0 * i, float(i * i % 7), 3.0 * i) for i in range(1, 6)], "a double, b double, c double, y double")
    assert ts.Pipeline([ts.DropCorrelated(columns=["a", "b", "c"])]).fit_transform(df).columns == ["a", "c", "y"]
    assert ts.Pipeline([ts.SelectKBest(k=1)]).fit_transform(df, "y").columns == ["a"]
    with pytest.raises(ValueError):
        ts.Pipeline([ts.SelectKBest(k=1)]).fit(df)
    const = df.withColumn("k", F.lit(5.0))
    assert "k" not in ts.Pipeline([ts.VarianceThreshold()]).fit_transform(const).columns
    assert "k" in ts.Pipeline([ts.DropCorrelated()]).fit(const).output_schema_


def test_deduplicate(spark):
    df = frame(spark, [(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, "e")], "k int, v string")
    assert sorted(r[1] for r in rows(ts.Pipeline([ts.Deduplicate(subset=["k"])]).fit_transform(df))) == ["a", "c", "e"]
    assert sorted(r[1] for r in rows(ts.Pipeline([ts.Deduplicate(subset=["k"], keep="last")]).fit_transform(df))) == ["b", "d", "e"]
    assert rows(ts.Pipeline([ts.Deduplicate(subset=["k"], keep="none")]).fit_transform(df)) == [(2, "e")]


def test_merge_keys_and_suffixes(spark):
    a = frame(spark, [(1, "x"), (2, "y"), (None, "n")], "k int, v string")
    b = frame(spark, [(1, "p"), (3, "q"), (None, "m")], "k int, v string")
    assert sorted(rows(ts.merge(a, b, on="k", how="outer")), key=str) == sorted([(1, "x", "p"), (2, "y", None), (None, "n", None), (None, None, "q"), (None, None, "m")], key=str)
    assert ts.merge(a, b, left_on="k", right_on="k").columns == ["k_left", "v_left", "k_right", "v_right"]
    for bad in ({"how": "semi", "on": "k"}, {}, {"how": "cross", "on": "k"}):
        with pytest.raises(ValueError):
            ts.merge(a, b, **bad)


def test_lookup_and_concat(spark):
    a = frame(spark, [(1, 5), (2, 6)], "k int, v int")
    other = frame(spark, [(1, 50, "z")], "k int, v int, w string")
    out = ts.Pipeline([ts.Lookup(other, on="k")]).fit_transform(a)
    assert out.columns == ["k", "v", "v_lookup", "w"] and sorted(rows(out)) == [(1, 5, 50, "z"), (2, 6, None, None)]
    assert ts.concat(a, other, align=True).columns == ["k", "v", "w"]
    with pytest.raises(ts.SchemaError):
        ts.concat(a, other)


def test_composition(spark):
    df = frame(spark, [(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    with pytest.raises(ts.SchemaError):
        ts.Pipeline([ts.Columns([("x", ts.Abs(), ["a"]), ("y", ts.Abs(), ["a"])])]).fit(df)
    with pytest.raises(ts.InvalidStepError):
        ts.Union([("x", ts.Filter(condition="a > 1"))])
    assert ts.Pipeline([ts.Union([("m", ts.MaxAbsScaler()), ("o", ts.Abs())])]).fit_transform(df).columns == ["m_a", "m_b", "o_a", "o_b"]


def test_custom_and_expression(spark):
    df = frame(spark, [(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    assert ts.Pipeline([ts.Expression("CAST(a AS INT) AS n")]).fit_transform(df).columns == ["a", "b", "n"]
    with pytest.raises(ValueError):
        ts.Expression("a + b")
    out = ts.Pipeline([ts.custom("{col} - {m} AS {col}_c", columns=["a"], learn={"m": "avg({col})"})]).fit_transform(df)
    assert [r["a_c"] for r in out.collect()] == [-1.0, 1.0]
    with pytest.raises(ValueError):
        ts.custom("{col} - {nope}")


def test_pipeline_surface(spark):
    df = frame(spark, [(1.0,), (2.0,)], "a double")
    with pytest.raises(ts.InvalidStepError):
        ts.Pipeline([])
    with pytest.raises(ts.InvalidStepError):
        ts.Pipeline([("x", ts.Abs()), ("x", ts.Abs())])
    with pytest.raises(ts.NotFittedError):
        ts.Pipeline([ts.Abs()]).transform(df)
    p = ts.Abs() + ts.Sqrt() + ts.Pipeline([ts.StandardScaler(with_mean=False)])
    assert [n for n, _ in p.steps] == ["step_00", "step_01", "step_02"]
    p.fit(df)
    assert p.to_numpy(df).shape == (2, 1) and not p.clone().__sklearn_is_fitted__()
    with pytest.raises(ts.FrozenError):
        p.freeze().fit(df)
    assert repr(ts.StandardScaler(with_mean=False)) == "StandardScaler(with_mean=False)"
    assert ts.StandardScaler().fit(df).transform(df).count() == 2
    extra = df.withColumn("z", F.lit(1))
    assert p.transform(extra).columns == ["a"]


def test_user_step(spark):
    class Centre(ts.Transformer):
        default_columns, learns = "numeric", True

        def discover(self, columns, schema, y):
            return {c: F.min(c) for c in columns}

        def expressions(self, columns, schema):
            return {c: f"`{c}` - {self.params_[c]}D" for c in columns}

    assert rows(ts.Pipeline([Centre()]).fit_transform(frame(spark, [(1.0,), (4.0,)], "a double"))) == [(0.0,), (3.0,)]


def test_schema_and_selectors():
    s = ts.Schema({"a": "int", "b": "string", "c": "date", "d": "boolean", "e": "array<int>", "f": "decimal(9,2)"})
    assert [s.column_category(c) for c in s] == ["numeric", "categorical", "temporal", "boolean", "other", "numeric"]
    assert (ts.numeric() | ts.boolean()).resolve(s) == ["a", "f", "d"]
    assert (~ts.numeric()).resolve(s) == ["b", "c", "d", "e"]
    assert (ts.all_columns() - ts.matching("[a-c]")).resolve(s) == ["d", "e", "f"]
    assert (ts.numeric() & ts.columns("f", "a", "zz")).resolve(s) == ["f", "a"]
    assert ts.dtype("decimal(3,1)").resolve(s) == ["f"]
    with pytest.raises(ts.MissingColumnError):
        s.drop("zz")
    with pytest.raises(ts.SchemaError):
        s.add("a", "int")


def test_sources(spark, tmp_path):
    df = frame(spark, [(1, "x,y"), (2, "z")], "id int, v string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "t.tsv").write_text("id\tv\n1\tx\n")
    assert ts.resolve_input(str(tmp_path / "t.parquet"), spark).count() == 2
    assert ts.resolve_input(str(tmp_path / "t.tsv"), spark).columns == ["id", "v"]
    with ts.Backend(spark) as b:
        b.register(df, "src_t")
        assert b.describe("src_t").columns == ["id", "v"] and b.fetch_one("SELECT count(*) AS n FROM src_t")["n"] == 2
        with pytest.raises(ts.FitError):
            b.fetch_one("SELECT * FROM src_t WHERE id > 9")
    with pytest.raises(TypeError):
        ts.resolve_input(3, spark)


def test_quantiles_are_exact(spark, monkeypatch):
    import random

    from tessera import quantiles
    from tessera.functions import Quantile

    r = random.Random(3)
    cols = {"even": [float(i % 977) for i in range(4000)], "odd": [r.gauss(0, 1) for _ in range(3999)] + [None], "same": [5.0] * 4000, "few": [r.choice([1.0, 2.0, 3.0, None]) for _ in range(4000)], "none": [None] * 4000, "nan": [r.choice([float("nan"), 1.5, -2.0]) for _ in range(4000)], "skew": [r.random() ** 20 for _ in range(4000)]}
    df = spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"{c} double" for c in cols)).repartition(3)
    wanted = [Quantile(c, q) for c in cols for q in (0.0, 0.01, 0.25, 0.5, 0.75, 1.0)] + [Quantile(c, 0.5, middle=True) for c in cols]
    want = [repr(x) for x in df.selectExpr(*[w.sql for w in wanted]).first()]

    def got():
        search = quantiles.QuantileSearch(wanted)
        return [repr(x) for x in search.run(df, list(df.agg(*search.first()).first()))]

    assert got() == want
    monkeypatch.setattr(quantiles, "MOST_ROWS", 1)
    monkeypatch.setattr(quantiles, "REACH", 0.05)
    assert got() == want  # by narrowing


def test_fitted_steps_travel(spark):
    import copy
    import pickle

    df = spark.range(2500).selectExpr("concat('v', id) AS c", "id", "CAST(id % 7 AS DOUBLE) AS x")
    other = spark.range(5).selectExpr("CAST(id AS DOUBLE) AS x", "id * 2 AS twice")
    other.createOrReplaceTempView("ts_other")
    for source in (other, "ts_other"):
        p = ts.Pipeline([ts.FrequencyEncoder(columns=["c"]), ts.RobustScaler(columns=["id"]), ts.Lookup(source, on="x")]).fit(df)
        want = sorted(map(tuple, p.transform(df).collect()))
        assert sorted(map(tuple, copy.deepcopy(p).transform(df).collect())) == want == sorted(map(tuple, p.copy().transform(df).collect()))
        df.createOrReplaceTempView("ts_in")
        assert sorted(map(tuple, spark.sql(p.to_sql("ts_in")).collect())) == want
        if source is not other:
            assert sorted(map(tuple, pickle.loads(pickle.dumps(p)).transform(df).collect())) == want
        else:
            with pytest.raises(ts.errors.NotFittedError):
                pickle.loads(pickle.dumps(p)).transform(df)
    step = ts.StandardScaler(columns=["x"]).fit(df)
    again = pickle.loads(pickle.dumps(step))
    assert again.transform(df).agg({"x": "avg"}).first() == step.transform(df).agg({"x": "avg"}).first()


def test_many_categories_in_groups_and_branches(spark):
    df = spark.range(2500).selectExpr("concat('v', lpad(id, 5, '0')) AS c", "id")
    for step, name in ((ts.Columns([("k", ts.OrdinalEncoder(), ["c"])], remainder="passthrough"), "c"), (ts.Union([("a", ts.OrdinalEncoder(columns=["c"])), ("b", ts.FrequencyEncoder(columns=["c"]))]), "a_c")):
        p = ts.Pipeline([step]).fit(df)
        assert len(p.to_sql("t")) < 5000
        out = p.transform(df)
        assert out.where(f"{name} <> {'id' if name == 'c' else 'a_id'}").isEmpty() and out.count() == 2500


def test_categories_beyond_the_driver(spark, monkeypatch):
    """With the driver's share set low, categories stay a table; numbers are the same, whatever the column's type."""
    from tessera.operators import encoders

    df = spark.range(3000).selectExpr("CASE WHEN id % 10 = 3 THEN NULL ELSE concat('v', id % 1500) END AS c", "id % 700 AS n", "id")
    steps = lambda: [ts.FrequencyEncoder(columns=["n"]), ts.OrdinalEncoder(columns=["c"])]
    want = sorted(map(tuple, ts.Pipeline(steps()).fit_transform(df).collect()), key=str)
    monkeypatch.setattr(encoders, "DRIVER_CATEGORIES", 50)
    p = ts.Pipeline(steps()).fit(df)
    assert not p[0].sets_ and not p[1].sets_
    assert sorted(map(tuple, p.transform(df).collect()), key=str) == want == sorted(map(tuple, p.copy().transform(df).collect()), key=str)
    df.createOrReplaceTempView("ts_many")
    assert sorted(map(tuple, spark.sql(p.to_sql("ts_many")).collect()), key=str) == want
    p[1].check_unseen(df)
    with pytest.raises(ts.errors.UnseenCategoryError):
        p[1].check_unseen(frame(spark, [("strange",)], "c string"))
    both = ts.Pipeline([ts.Columns([("k", ts.OrdinalEncoder(), ["c"])], remainder="passthrough")]).fit(df)
    plain = {r["id"]: r["c"] for r in p.transform(df).collect()}
    assert {r["id"]: r["c"] for r in both.transform(df).collect()} == plain


def test_steps_that_break_their_word(spark):
    df = frame(spark, [(1.0,)], "a double")

    class Sly(ts.Transformer):
        def discover(self, columns, schema, y):
            return {"m": "max(a)"}

    class Odd(ts.Transformer):
        def expressions(self, columns, schema):
            return {"b": "a + 1", "c": "a + 2"}

        def outputs(self, columns, schema):
            return ["b"]

    with pytest.raises(ts.errors.StaticViolationError):
        ts.Pipeline([Sly()]).fit(df)
    with pytest.warns(UserWarning, match="declare"):
        assert ts.Pipeline([Odd()]).fit_transform(df).columns == ["a", "b"]
    with pytest.raises(ts.errors.CompilationError):
        ts.Pipeline([ts.Expression("nowhere + 1 AS b")]).fit(df)


def test_stream(spark, tmp_path):
    from tessera.streaming import transform_stream, unstreamable

    df = frame(spark, [(1.0, "x"), (3.0, "y")], "a double, c string")
    df.write.parquet(str(tmp_path / "in"))
    p = ts.Pipeline([ts.Filter(condition="a > 0"), ts.StandardScaler(), ts.OneHotEncoder()]).fit(df)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = transform_stream(p, stream).writeStream.format("memory").queryName("ts_out").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(rows(spark.table("ts_out"))) == sorted(rows(p.transform(df)))
    w = ts.Pipeline([ts.RowNumber(order_by="a")]).fit(df)
    assert unstreamable(w) == ["GlobalWindow"]
    with pytest.raises(ValueError):
        w.transform(stream)
