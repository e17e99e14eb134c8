"""Operator specifications: plain data that a pipeline lowers to DataFrame transformations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from weir.errors import PipelineBuildError
from weir.functions.expressions import Expression


@dataclass(frozen=True)
class FilterExpr:
    expr: str

    def __post_init__(self):
        Expression(self.expr)


@dataclass(frozen=True)
class MapExpr:
    expr: str

    def __post_init__(self):
        Expression(self.expr)


@dataclass(frozen=True)
class FilterPy:
    fn: Callable


@dataclass(frozen=True)
class MapPy:
    """columns: the keys of the dicts that fn returns; without them fn returns numbers."""

    fn: Callable
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class FilterPyBatch:
    fn: Callable


@dataclass(frozen=True)
class MapPyBatch:
    fn: Callable
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Batch:
    size: int

    def __post_init__(self):
        if isinstance(self.size, bool) or not isinstance(self.size, int) or self.size < 1:
            raise ValueError("a batch's size is a whole number above 0")


@dataclass(frozen=True)
class Select:
    columns: tuple[str, ...]


@dataclass(frozen=True)
class FlatMap:
    """array: a Column function of the frame's columns that gives an array of numbers; each becomes an item."""

    array: Callable


@dataclass(frozen=True)
class FlatMapPy:
    """fn: gives any number of numbers for an item; each becomes an item."""

    fn: Callable


Spec = FilterExpr | MapExpr | FilterPy | MapPy | FilterPyBatch | MapPyBatch | Batch | Select | FlatMap | FlatMapPy


def filter_expr(expr: str) -> FilterExpr:
    return FilterExpr(expr)


def map_expr(expr: str) -> MapExpr:
    return MapExpr(expr)


def filter_py(fn: Callable) -> FilterPy:
    return FilterPy(fn)


def map_py(fn: Callable, columns=()) -> MapPy:
    return MapPy(fn, tuple(columns))


def filter_py_batch(fn: Callable) -> FilterPyBatch:
    return FilterPyBatch(fn)


def map_py_batch(fn: Callable, columns=()) -> MapPyBatch:
    return MapPyBatch(fn, tuple(columns))


def batch(size: int) -> Batch:
    return Batch(size)


def select(*columns) -> Select:
    names = columns[0] if len(columns) == 1 and isinstance(columns[0], list | tuple) else columns
    if not all(isinstance(c, str) for c in names):
        raise PipelineBuildError("select takes column names")
    return Select(tuple(names))


def flat_map(array: Callable) -> FlatMap:
    return FlatMap(array)


def flat_map_py(fn: Callable) -> FlatMapPy:
    return FlatMapPy(fn)
