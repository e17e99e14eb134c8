"""The expression language: parsing, and its meaning against a plain evaluator."""

import ast
import math
import random
import sys

import pytest
from pyspark.sql import functions as F

from weir.errors import ExpressionError, PipelineBuildError
from weir.functions.expressions import Expression

EPS = sys.float_info.epsilon
NAN, INF = math.nan, math.inf


def evaluate(tree, row):
    """What the language means, on Python floats and None."""
    if isinstance(tree, ast.Constant):
        return float(tree.value)
    if isinstance(tree, ast.Name):
        name = tree.id[2:]
        return {"nan": NAN, "inf": INF, "infinity": INF}[name] if tree.id[0] == "n" else row.get(name)
    if isinstance(tree, ast.UnaryOp):
        v = evaluate(tree.operand, row)
        return v if v is None else -v if isinstance(tree.op, ast.USub) else float(v == 0)
    if isinstance(tree, ast.BoolOp):
        values = [evaluate(v, row) for v in tree.values]
        return None if None in values else float((all if isinstance(tree.op, ast.And) else any)(v != 0 for v in values))
    a, b = (tree.left, tree.comparators[0]) if isinstance(tree, ast.Compare) else (tree.left, tree.right)
    a, b = evaluate(a, row), evaluate(b, row)
    if a is None or b is None:
        return None
    op = type(tree.ops[0] if isinstance(tree, ast.Compare) else tree.op)
    if op is ast.Div:
        try:
            return None if b == 0 else a / b
        except OverflowError:
            return math.copysign(INF, a) * math.copysign(1, b)
    return float({ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Eq: lambda: abs(a - b) < EPS, ast.NotEq: lambda: abs(a - b) >= EPS, ast.Lt: lambda: a < b, ast.LtE: lambda: a <= b, ast.Gt: lambda: a > b, ast.GtE: lambda: a >= b}[op]())


ROWS = [{"a": a, "b": b} for a in (0.0, -0.0, 1.0, 2.5, 0.1 + 0.2, NAN, INF, -INF, None) for b in (0.0, 1.0, 0.3, -3.0, NAN, INF, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(n, r["a"], r["b"]) for n, r in enumerate(ROWS)], "n int, a double, b double").coalesce(1).cache()


def check(rows, texts):
    """Values and conditions of many expressions over ROWS, in one job."""
    exprs = [Expression(t) for t in texts]
    values = [e.value(["a", "b"]).alias(f"v{n}") for n, e in enumerate(exprs)]
    keeps = [F.coalesce(e.condition(["a", "b"]), F.lit(False)).alias(f"k{n}") for n, e in enumerate(exprs)]
    for r in rows.select("n", *values, *keeps).collect():
        for n, e in enumerate(exprs):
            want, got = evaluate(e.tree, {k: v for k, v in ROWS[r["n"]].items() if v is not None}), r[f"v{n}"]
            assert want is None and got is None or want is not None and got is not None and (want == got or want != want and got != got), (e.text, ROWS[r["n"]], want, got)
            assert r[f"k{n}"] == (want is not None and want != 0), (e.text, ROWS[r["n"]])


def test_semantics(rows):
    check(
        rows,
        ["a + b", "a - b", "a * b", "a / b", "-a", "--a", "a == b", "a != b", "a < b", "a <= b", "a > b", "a >= b", "a and b", "a or b", "not a", "not not a", "1 or a / 0"]
        + ["not a > b", "not (a > b)", "not (0 and missing)", "a == 0.3", "a != 0.3", "a > nan", "nan < a", "inf == inf", "a and b and 1", "a or missing", "true", "A + B", "2.5", "(a)", "a < inf", "a - -b", "AND", "or"],
    )


def test_random_expressions(rows):
    rng = random.Random(7)

    def make(depth):
        if depth == 0 or rng.random() < 0.15:
            return rng.choice(["a", "b", "0", "1", "2.5", "0.3", "missing", "nan", "inf"])
        k = rng.randrange(9)
        if k == 0:
            return f"-({make(depth - 1)})"
        if k == 1:
            return f"not ({make(depth - 1)})"
        op = rng.choice(["+", "-", "*", "/", "==", "!=", "<", "<=", ">", ">=", "and", "or"])
        return f"({make(depth - 1)}) {op} ({make(depth - 1)})"

    for _ in range(3):
        check(rows, [make(3) for _ in range(25)])


@pytest.mark.parametrize("text", ["", "  ", "a <", "a < b < c", "(a", "a)", "a b", "1 2", "a % b", "a = b", "!a", "'x'", "f(a)", "1..2", "a,b", "+a", "a not b", "not", "a + * b", "a ** b", "a // b", "()", "1.2.3", "a & b"])
def test_errors(text):
    with pytest.raises(ExpressionError):
        Expression(text)
    with pytest.raises(PipelineBuildError):
        Expression(text)


@pytest.mark.parametrize("text", ["a + b * 2", "not a > b", "-(a - 3.25) / b", "a and b or not c", "a == 1 and (b != 2 or c <= 0.1)", "1000000000000000000000", "inf", "a - (b - c)"])
def test_text_parses_to_the_same(text):
    e = Expression(text)
    assert Expression(str(e)) == e and hash(Expression(str(e))) == hash(e)
    assert ast.dump(Expression(str(e)).tree) == ast.dump(e.tree)


def test_names():
    assert Expression("Temp > 1 and humidity < inf").names >= {"temp", "humidity"}


def test_upper_case_columns_are_missing(spark):
    df = spark.createDataFrame([(1.0,)], "Temp double")
    assert df.where(Expression("Temp > 0").condition(df.columns)).count() == 0


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("cast(id as double) a", "cast(id as double) b", "id c").write.parquet(path)
    df = spark.read.parquet(path)
    plan = df.where(Expression("a > 3 and b < 7").condition(df.columns)).select("a")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,3.0)" in plan and "LessThan(b,7.0)" in plan and "Python" not in plan
    assert "c" not in plan.split("ReadSchema")[1].split("\n")[0].replace("struct", "").replace("double", "")
