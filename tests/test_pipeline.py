"""Pipelines over Python items and over DataFrames."""

import math
import warnings

import pytest
from pyspark.sql import functions as F

from weir.errors import PipelineBuildError
from weir.operators import specs as S
from weir.plans.pipeline import Pipeline


def run(spark, p, items):
    return p.collect(items, spark)


def test_identity_and_repr(spark):
    assert run(spark, Pipeline(), [1, 2, 3.5]) == [1.0, 2.0, 3.5]
    assert run(spark, Pipeline.identity(), [{"a": 1}, {"a": 2}]) == [{"a": 1.0}, {"a": 2.0}]
    assert repr(Pipeline()) == "Pipeline(empty)" and repr(Pipeline().select("a").batch(2)) == "Pipeline(2 stages)"
    assert run(spark, Pipeline().filter_expr("x > 0"), []) == []


def test_filter_and_map(spark):
    sensor = [{"temp": 25, "humidity": 60}, {"temp": 35, "humidity": 90}, {"temp": 22, "humidity": 50}]
    assert run(spark, Pipeline().filter_expr("temp > 20 and humidity < 80"), sensor) == [{"temp": 25.0, "humidity": 60.0}, {"temp": 22.0, "humidity": 50.0}]
    assert run(spark, Pipeline().map_expr("price * quantity"), [{"price": 10, "quantity": 2}, {"price": 5, "quantity": 3}]) == [20.0, 15.0]
    flagship = Pipeline().filter_expr("temperature > 25 and humidity < 80").map_expr("temperature * 1.8 + 32")
    assert run(spark, flagship, [{"temperature": 25, "humidity": 60}, {"temperature": 30, "humidity": 90}, {"temperature": 35, "humidity": 50}]) == [95.0]


def test_missing_values(spark):
    assert run(spark, Pipeline().filter_expr("nope > 1"), [{"a": 1}]) == []
    out = run(spark, Pipeline().map_expr("a / b"), [{"a": 1, "b": 0}, {"a": 1, "b": 2}, {"a": 1}])
    assert math.isnan(out[0]) and out[1] == 0.5 and math.isnan(out[2])


def test_only_numbers_are_kept(spark):
    assert run(spark, Pipeline(), [{"name": "alice", "score": 90, "ok": True}]) == [{"score": 90.0, "ok": 1.0}]
    assert run(spark, Pipeline(), [{"key": "text"}]) == [{}]
    with pytest.raises(ValueError):
        run(spark, Pipeline(), ["hello"])
    with pytest.raises(ValueError):
        run(spark, Pipeline(), [1, {"a": 1}])


def test_select(spark):
    assert run(spark, Pipeline().select("a", "c", "zzz"), [{"a": 1, "b": 2, "c": 3}]) == [{"a": 1.0, "c": 3.0}]
    assert run(spark, Pipeline().select(["a"]), [{"a": 1, "b": 2}]) == [{"a": 1.0}]
    assert run(spark, Pipeline().select("a"), [1, 2]) == [1.0, 2.0]
    with pytest.raises(PipelineBuildError):
        Pipeline().select(1)


def test_batch(spark):
    assert run(spark, Pipeline().batch(2), [1, 2, 3, 4, 5]) == [[1.0, 2.0], [3.0, 4.0], [5.0]]
    assert run(spark, Pipeline().filter_expr("x > 1").batch(3), [1, 2, 3]) == [[2.0, 3.0]]
    assert run(spark, Pipeline().batch(2).select("a"), [{"a": 1, "b": 2}]) == [[{"a": 1.0, "b": 2.0}]]
    assert run(spark, Pipeline().batch(2).filter_expr("a > 0"), [{"a": 1}]) == []
    assert run(spark, Pipeline().batch(2).map_expr("1 + 1"), [1, 2, 3]) == [2.0, 2.0]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert run(spark, Pipeline().batch(2).batch(5), [1, 2, 3]) == [[1.0, 2.0], [3.0]]
        assert seen
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            Pipeline().batch(bad)


def test_functions(spark):
    assert run(spark, Pipeline().filter_py(lambda r: r["score"] >= 80), [{"score": 75}, {"score": 80}, {"score": 95}]) == [{"score": 80.0}, {"score": 95.0}]
    assert run(spark, Pipeline().map_py(lambda v: v * 10), [1, 2]) == [10.0, 20.0]
    assert run(spark, Pipeline().map_py(lambda r: {"b": r["a"] + 1}, columns=["b"]), [{"a": 1}]) == [{"b": 2.0}]
    assert run(spark, Pipeline().batch(2).map_py(sum), [1, 2, 3]) == [3.0, 3.0]
    assert run(spark, Pipeline().batch(3).map_py_batch(lambda v: v * 2).filter_py_batch(lambda v: v > 3), [1, 2, 3, 1]) == [[4.0, 6.0], []]
    assert run(spark, Pipeline().map_py_batch(lambda v: v + 1).filter_py_batch(lambda v: v > 2), [1, 2]) == [3.0]
    assert run(spark, Pipeline().filter_py(lambda r: "b" in r), [{"a": 1}, {"a": 1, "b": 2}]) == [{"a": 1.0, "b": 2.0}]


def test_function_errors_reach_the_caller(spark, tmp_path):
    class Odd(Exception):  # the workers can't import this module
        pass

    def odd(v):
        raise Odd("seen", v)

    with pytest.raises(ZeroDivisionError):
        run(spark, Pipeline().map_py(lambda v: 1 / (v - v)), [1])
    with pytest.raises(ValueError, match="text"):
        run(spark, Pipeline().map_py(lambda v: "text"), [1])
    with pytest.raises(KeyError):
        run(spark, Pipeline().filter_py(lambda r: r["none"] > 1), [{"a": 1}])
    for p in (Pipeline().map_py(odd), Pipeline().flat_map_py(odd), Pipeline().batch(2).filter_py_batch(odd), Pipeline().batch(2).map_py_batch(odd)):
        with pytest.raises(Odd) as e:
            run(spark, p, [1])
        assert e.value.args == ("seen", 1.0)
    with pytest.raises(Odd):
        Pipeline().map_py(odd).sink(f"file://{tmp_path}/out").run([1, 2], spark)


def test_flat_map(spark):
    assert run(spark, Pipeline().flat_map(lambda c: F.sequence(F.lit(1), c["x"].cast("int"))), [2]) == [1.0, 2.0]
    assert run(spark, Pipeline().flat_map_py(lambda v: range(int(v))), [2, 0, 3]) == [0.0, 1.0, 0.0, 1.0, 2.0]
    assert run(spark, Pipeline().flat_map_py(lambda r: r.values()).map_expr("x * 2"), [{"a": 1, "b": 2}, {"a": 3}]) == [2.0, 4.0, 6.0]


def test_declarative(spark):
    p = Pipeline().pipe(S.filter_expr("a > 1"), S.select("a"), S.map_expr("a * 2"))
    assert run(spark, p, [{"a": 1, "b": 1}, {"a": 2, "b": 1}]) == [4.0]
    with pytest.raises(TypeError):
        Pipeline().pipe("filter")
    with pytest.raises(PipelineBuildError):
        Pipeline().filter_expr("a >")
    assert S.batch(3) == S.Batch(3) and "3" in repr(S.batch(3))


def test_apply_keeps_and_orders(spark):
    df = spark.createDataFrame([(3, "c", 1.0), (1, "a", 2.0), (2, "b", 3.0)], "ts long, name string, v double")
    out = Pipeline().filter_expr("v > 1").map_expr("v * 2").apply(df, "ts", keep=("name",))
    assert sorted(out.collect()) == [("a", 4.0), ("b", 6.0)] and out.columns == ["name", "x"]
    assert Pipeline().map_expr("v").batch(2).apply(df, "ts").select("items").collect() == [([2.0, 3.0],), ([1.0],)]
    with pytest.raises(PipelineBuildError):
        Pipeline().batch(2).apply(df)


def test_native_plans_have_no_python(spark):
    df = spark.range(10).selectExpr("cast(id as double) v", "id")
    plan = Pipeline().filter_expr("v > 3 or not v").map_expr("v / 2").apply(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
