"""The fluent pipeline: a list of operator specifications that lowers to one DataFrame plan."""

from __future__ import annotations

import base64
import pickle
import re
import warnings
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.errors import PipelineBuildError
from weir.functions.expressions import Expression
from weir.operators import specs as S
from weir.operators.ingest import SCALAR, from_items, numeric
from weir.operators.ordering import with_position

NAN = float("nan")
ITEMS = "items"
_KEY = "_key_"


class Pipeline:
    """Chain operators, then lower them onto a DataFrame with apply(), or run them over Python items with collect().

    Rows are records of doubles, or scalars (one column `x`); after batch() they are arrays in the column `items`.
    """

    def __init__(self, specs: Iterable[S.Spec] = ()):
        self._specs = tuple(specs)
        self._source: str | None = None
        self._sink: str | None = None

    def __repr__(self) -> str:
        return f"Pipeline({len(self._specs)} stages)" if self._specs else "Pipeline(empty)"

    @classmethod
    def identity(cls) -> Pipeline:
        return cls()

    def pipe(self, *specs: S.Spec) -> Pipeline:
        for s in specs:
            if not isinstance(s, S.Spec):
                raise TypeError(f"{s!r} is no operator specification")
        self._specs += specs
        return self

    def filter_expr(self, expr: str) -> Pipeline:
        return self.pipe(S.filter_expr(expr))

    def map_expr(self, expr: str) -> Pipeline:
        return self.pipe(S.map_expr(expr))

    def filter_py(self, fn) -> Pipeline:
        return self.pipe(S.filter_py(fn))

    def map_py(self, fn, columns=()) -> Pipeline:
        return self.pipe(S.map_py(fn, columns))

    def filter_py_batch(self, fn) -> Pipeline:
        return self.pipe(S.filter_py_batch(fn))

    def map_py_batch(self, fn, columns=()) -> Pipeline:
        return self.pipe(S.map_py_batch(fn, columns))

    def batch(self, size: int) -> Pipeline:
        return self.pipe(S.batch(size))

    def select(self, *columns) -> Pipeline:
        return self.pipe(S.select(*columns))

    def flat_map(self, array) -> Pipeline:
        return self.pipe(S.flat_map(array))

    def flat_map_py(self, fn) -> Pipeline:
        return self.pipe(S.flat_map_py(fn))

    # --- lowering ---

    def apply(self, df: DataFrame, order_by: str | None = None, keep: tuple[str, ...] = (), scalar: bool | None = None) -> DataFrame:
        """The pipeline over df: numeric columns are the record, `keep` columns pass by untouched (not through batch()).

        order_by names the column that orders rows; batch() needs it. It stays out of the record unless it is numeric
        (as any other column). A frame whose record is the one column `x` is a stream of scalars.
        """
        keys = tuple(dict.fromkeys([*keep, *([order_by] if order_by else [])]))
        rows = numeric(df, keys)
        if scalar is None:
            scalar = [c for c in rows.columns if not c.startswith(_KEY)] == [SCALAR]
        return self._lower(rows, scalar, f"{_KEY}{order_by}" if order_by else None, [f"{_KEY}{c}" for c in keep])

    def _lower(self, rows: DataFrame, scalar: bool, order: str | None, keep: list[str]) -> DataFrame:
        state = _State(rows, scalar, order)
        for spec in self._specs:
            state = state.step(spec)
        out = [F.col(f"`{c}`").alias(c.removeprefix(_KEY)) for c in state.rows.columns if c in keep]
        out += [F.col(f"`{c}`") for c in state.fields]
        return state.rows.select(*out) if out or not state.order else state.rows.select(F.col(f"`{state.order}`").alias("_seq"))

    def collect(self, source: Iterable, spark: SparkSession | None = None) -> list:
        """Run over Python numbers or dicts; the results in order. For tests and small inputs."""
        spark = spark or SparkSession.active()
        rows, scalar = from_items(spark, source)
        state = _State(rows, scalar, f"{_KEY}seq")
        for spec in self._specs:
            state = state.step(spec)
        with original_errors():
            return [state.item(r) for r in state.rows.orderBy(f"`{state.order}`").collect()]

    # --- sources and sinks ---

    @staticmethod
    def parse_transport_url(url: str) -> tuple[str, str, dict[str, str]]:
        """(scheme, target, parameters) of a URL."""
        from weir.sources.urls import parse_transport_url

        return parse_transport_url(url)

    def from_transport(self, url: str) -> Pipeline:
        """Read the messages of a channel. Checks the URL now and reads later; operators chained before are dropped."""
        from weir.sources.urls import TransportUrl

        parsed = TransportUrl.parse(url)
        if parsed.scheme not in ("shm", "file"):
            raise PipelineBuildError(f"no source for {parsed.scheme}")
        parsed.number("capacity", 64), parsed.number("slot_size", 4096)
        self._specs, self._source = (), url
        return self

    def sink(self, url: str) -> Pipeline:
        from weir.sources.urls import TransportUrl

        if TransportUrl.parse(url).scheme not in ("shm", "file"):
            raise ValueError(f"no sink for {url!r}")
        self._sink = url
        return self

    def messages(self, spark: SparkSession, source: Iterable | None = None) -> DataFrame:
        """(seq, payload): results as text, from the transport source or from Python items."""
        from weir.sources.channel import MessageChannel, decode_numbers

        if source is None:
            if not self._source:
                raise PipelineBuildError("no source")
            items = decode_numbers(MessageChannel.open_url(spark, self._source).read())
            rows, scalar = items.select(F.col("seq").alias(f"{_KEY}seq"), F.col("x")), True
        else:
            rows, scalar = from_items(spark, source)
        state = _State(rows, scalar, f"{_KEY}seq")
        for spec in self._specs:
            state = state.step(spec)
        return state.rows.select(F.col(f"`{state.order}`").alias("seq"), F.encode(state.text(), "UTF-8").alias("payload"))

    def run(self, source: Iterable | None = None, spark: SparkSession | None = None) -> int:
        """Write the results to the sink's channel; how many."""
        from weir.sources.channel import MessageChannel

        if not self._sink:
            raise RuntimeError("no sink")
        spark = spark or SparkSession.active()
        return self._sent(MessageChannel.open_url(spark, self._sink), source)

    def send_to(self, source: Iterable, channel) -> int:
        return self._sent(channel, source)

    def _sent(self, channel, source: Iterable | None) -> int:
        with original_errors():
            return channel.send_frame(self.messages(channel.spark, source))

    def receive_from(self, channel) -> list:
        """Drain a channel through the pipeline; the results in order."""
        from weir.sources.channel import decode_numbers

        rows = decode_numbers(channel.take()).select(F.col("seq").alias(f"{_KEY}seq"), "x")
        state = _State(rows, True, f"{_KEY}seq")
        for spec in self._specs:
            state = state.step(spec)
        with original_errors():
            return [state.item(r) for r in state.rows.orderBy(f"`{state.order}`").collect()]


_CARRIED = "weir-error:"


def _carrying(fn):
    """fn, whose exceptions travel in the message of another one, so that original_errors() can raise them on the driver."""

    def call(*v):
        try:
            return fn(*v)
        except Exception as e:
            raise RuntimeError(f"{_CARRIED}{base64.b64encode(cloudpickle.dumps(e)).decode()};") from e

    return call


@contextmanager
def original_errors():
    """Raises what a Python function of a pipeline raised in place of Spark's PythonException, which becomes its cause."""
    try:
        yield
    except PySparkException as e:
        found = re.search(_CARRIED + r"([A-Za-z0-9+/=]+);", str(e))
        if not found:
            raise
        raise pickle.loads(base64.b64decode(found[1])) from e


def _plain(x):
    """A row as what user functions get: dicts without missing keys, numbers, lists."""
    if isinstance(x, T.Row):
        return {k: v for k, v in x.asDict().items() if v is not None}
    if isinstance(x, list):
        return [_plain(y) for y in x]
    return x


def _number(v) -> float:
    if isinstance(v, str | bytes) or not hasattr(v, "__float__"):
        raise ValueError(f"{v!r} is neither a number nor a dict")
    return float(v)


def _result(v, columns: tuple[str, ...]):
    if not columns:
        return _number(v)
    if not isinstance(v, dict):
        raise ValueError(f"{v!r} is no dict")
    return tuple(float(v[c]) if c in v and hasattr(v[c], "__float__") and not isinstance(v[c], str) else None for c in columns)


def _record(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.DoubleType()) for c in columns])


class _State:
    """The rows so far, and what an item is: a scalar or a record, or an array of them."""

    def __init__(self, rows: DataFrame, scalar: bool, order: str | None, batched: bool = False):
        self.rows, self.scalar, self.order, self.batched = rows, scalar, order, batched

    @property
    def keys(self) -> list[str]:
        return [c for c in self.rows.columns if c.startswith(_KEY)]

    @property
    def fields(self) -> list[str]:
        return [c for c in self.rows.columns if not c.startswith(_KEY)]

    def value(self) -> Column:
        """The item as one column, for functions."""
        if self.batched:
            return F.col(ITEMS)
        return F.col(SCALAR) if self.scalar else F.struct(*[F.col(f"`{c}`") for c in self.fields])

    def with_items(self, *columns: Column, scalar: bool | None = None, batched: bool | None = None) -> _State:
        rows = self.rows.select(*[F.col(f"`{c}`") for c in self.keys], *columns)
        return _State(rows, self.scalar if scalar is None else scalar, self.order, self.batched if batched is None else batched)

    def where(self, condition: Column) -> _State:
        return _State(self.rows.where(condition), self.scalar, self.order, self.batched)

    def step(self, spec: S.Spec) -> _State:
        return getattr(self, "_" + type(spec).__name__)(spec)

    def _visible(self) -> list[str]:
        return [] if self.batched else self.fields

    def _FilterExpr(self, spec: S.FilterExpr) -> _State:
        return self.where(Expression(spec.expr).condition(self._visible()))

    def _MapExpr(self, spec: S.MapExpr) -> _State:
        x = F.coalesce(Expression(spec.expr).value(self._visible()), F.lit(NAN)).alias(SCALAR)
        return self.with_items(x, scalar=True, batched=False)

    def _called(self, fn, kind: T.DataType) -> Column:
        """fn of the item: batches of the columns reach Python by Arrow, and dicts are built there."""
        fn = _carrying(fn)
        if self.batched or self.scalar:
            return F.udf(lambda v: fn(_plain(v)), kind, useArrow=True)(self.value())
        names = self.fields
        if not names:
            return F.udf(lambda _: fn({}), kind, useArrow=True)(F.lit(True))
        record = F.udf(lambda *v: fn({k: x for k, x in zip(names, v, strict=True) if x is not None}), kind, useArrow=True)
        return record(*[F.col(f"`{c}`") for c in names])

    def _FilterPy(self, spec: S.FilterPy) -> _State:
        fn = spec.fn
        return self.where(self._called(lambda v: bool(fn(v)), T.BooleanType()))

    def _MapPy(self, spec: S.MapPy) -> _State:
        fn, columns = spec.fn, spec.columns
        v = self._called(lambda v: _result(fn(v), columns), _record(columns) if columns else T.DoubleType())
        if not columns:
            return self.with_items(v.alias(SCALAR), scalar=True, batched=False)
        out = self.with_items(v.alias("_v"), scalar=False, batched=False)
        return out.with_items(*[F.col("_v")[c].alias(c) for c in columns])

    def _element(self) -> T.DataType:
        return self.rows.schema[ITEMS].dataType.elementType

    def _FilterPyBatch(self, spec: S.FilterPyBatch) -> _State:
        if not self.batched:
            return self._FilterPy(S.FilterPy(spec.fn))
        fn = _carrying(spec.fn)
        kept = F.udf(lambda v: [x for x in v if fn(_plain(x))], T.ArrayType(self._element()), useArrow=True)(F.col(ITEMS))
        return self.with_items(kept.alias(ITEMS))

    def _MapPyBatch(self, spec: S.MapPyBatch) -> _State:
        if not self.batched:
            return self._MapPy(S.MapPy(spec.fn, spec.columns))
        fn, columns = spec.fn, spec.columns
        kind = T.ArrayType(_record(columns) if columns else T.DoubleType())
        each = _carrying(lambda x: _result(fn(_plain(x)), columns))
        v = F.udf(lambda v: [each(x) for x in v], kind, useArrow=True)(F.col(ITEMS))
        return self.with_items(v.alias(ITEMS), scalar=not columns)

    def _Batch(self, spec: S.Batch) -> _State:
        if self.batched:
            warnings.warn("only the first batch has an effect", stacklevel=4)
            return self
        if not self.order:
            raise PipelineBuildError("batch needs order_by: rows of a DataFrame have no order of their own")
        rows = with_position(self.rows.withColumn("_item", self.value()), self.order)
        rows = rows.groupBy(F.expr(f"_pos div {spec.size}").alias("_batch")).agg(F.array_sort(F.collect_list(F.struct("_pos", "_item"))).alias("_in"))
        items = F.transform("_in", lambda s: s["_item"]).alias(ITEMS)
        return _State(rows.select(F.col("_batch").alias(f"{_KEY}batch"), items), self.scalar, f"{_KEY}batch", True)

    def _Select(self, spec: S.Select) -> _State:
        if self.batched or self.scalar:
            return self
        return self.with_items(*[F.col(f"`{c}`") for c in spec.columns if c in self.fields])

    def _FlatMap(self, spec: S.FlatMap) -> _State:
        columns = {c: F.col(f"`{c}`") for c in self.fields}
        return self.with_items(F.explode(spec.array(columns).cast("array<double>")).alias(SCALAR), scalar=True, batched=False)

    def _FlatMapPy(self, spec: S.FlatMapPy) -> _State:
        fn = spec.fn
        items = self._called(lambda v: [_number(x) for x in fn(v)], T.ArrayType(T.DoubleType()))
        return self.with_items(F.explode(items).alias(SCALAR), scalar=True, batched=False)

    def item(self, row) -> object:
        if self.batched:
            return _plain(row[ITEMS])
        return row[SCALAR] if self.scalar else {c: row[c] for c in self.fields if row[c] is not None}

    def text(self) -> Column:
        """Items as Python writes them; only the sink's text needs Python."""
        if self.scalar and not self.batched:
            return F.udf(repr, T.StringType(), useArrow=True)(F.col(SCALAR))
        return F.udf(lambda v: repr(_plain(v)), T.StringType(), useArrow=True)(self.value())
