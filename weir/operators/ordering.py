"""Positions in a total order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows numbered in one task at most, about.
ROWS_PER_TASK = 1_000_000
#: Quantiles that one aggregation takes; each of them can start a piece.
_QUANTILES = 10_000


def order_piece(df: DataFrame, order_by: str, per_task: int = ROWS_PER_TASK) -> tuple[Column, int]:
    """(the piece of the order that a row is in, number of pieces). Pieces are cut at quantiles of the key, which come
    with the number of rows from a single aggregation. Nulls are piece -1, before all others."""
    key = F.col(order_by).cast("double")
    shares = F.array(*[F.lit(i / 1000) for i in range(1, 1000)])
    rows, cuts = df.agg(F.count(F.lit(1)), F.percentile_approx(key, shares, _QUANTILES)).first()
    wanted = max(1, -(-rows // per_task))
    if wanted == 1 or not cuts:
        return F.lit(0), 1
    if wanted > 1000:  # more pieces than the quantiles at hand: ask for as many as needed
        shares = F.array(*[F.lit(i / wanted) for i in range(1, wanted)])
        cuts = df.agg(F.percentile_approx(key, shares, max(_QUANTILES, 10 * wanted))).first()[0]
    else:
        cuts = [cuts[i * 1000 // wanted - 1] for i in range(1, wanted)]
    cuts = sorted(set(cuts))
    # halves: a row is compared with as many cuts as the number of pieces has binary digits

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key <= F.lit(float(cuts[mid])), among(low, mid)).otherwise(among(mid + 1, high))

    return F.when(key.isNull(), F.lit(-1)).otherwise(among(0, len(cuts))), len(cuts) + 1


def with_position(df: DataFrame, order_by: str, name: str = "_pos", by: list[str] | None = None, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """df with a gapless position from 0 in the order of a numeric or timestamp column, within the `by` columns.

    Rows are numbered within pieces of the order, and pieces are shifted by the counts before them; rows that a task can
    number are one piece and need no counts. Equal keys are numbered in any order; nulls come first.
    """
    by = list(by or [])
    piece, pieces = order_piece(df, order_by, per_task)
    if pieces == 1:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(order_by)) - 1).cast("long"))
    df = df.withColumn("_weir_piece", piece)
    counts = df.groupBy(*by, "_weir_piece").agg(F.count(F.lit(1)).alias("_weir_n"))
    before = Window.partitionBy(*by).orderBy("_weir_piece").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_weir_of_{n}" for n, c in enumerate([*by, "_weir_piece"])}  # rows with a null in `by` are a group as well
    counts = counts.select(*[F.col(c).alias(n) for c, n in names.items()], F.coalesce(F.sum("_weir_n").over(before), F.lit(0)).alias("_weir_before"))
    inside = Window.partitionBy(*by, "_weir_piece").orderBy(order_by)
    df = df.withColumn("_weir_at", F.row_number().over(inside) - 1)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    joined = df.join(counts, same).withColumn(name, F.col("_weir_before") + F.col("_weir_at"))
    return joined.drop("_weir_piece", "_weir_at", "_weir_before", *names.values())
