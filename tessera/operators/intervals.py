"""Interval join: which windows hold which spans, without meeting all spans of a key with all its windows.

A window is put into cells as long as the power of two that its length fits
into, two of them at most; a span looks into the one cell of each length where it
starts. Rows meet by key, length and cell, so a key with very many spans and
windows is dealt out by place, and each pair is found once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained(spans: DataFrame, windows: DataFrame, by: list[str], span: tuple[str, str] = ("a", "z"), window: tuple[str, str] = ("start", "end")) -> DataFrame:
    """spans joined to the windows of the same key that hold them whole: start <= a and z <= end, in whole numbers.

    Both keep all their columns; names other than by must differ. Rows with a
    null key or end, and windows that end before they start, meet nothing. An
    empty span is held like any other.
    """
    a, z = span
    start, end = window
    length = F.col(end) - F.col(start)
    # cells of 2**level places, the smallest that are as long as the window
    level = F.when(length <= 1, 0).otherwise(F.ceil(F.log2(length.cast("double"))).cast("int"))
    sized = windows.where(F.col(start) <= F.col(end)).withColumn("__level", level)
    # a logarithm may be off by one at powers of two
    sized = sized.withColumn("__level", F.expr(f"__level + CASE WHEN shiftleft(1L, __level) < `{end}` - `{start}` THEN 1 ELSE 0 END"))
    cell = lambda at: F.expr(f"CAST(floor(`{at}` / CAST(shiftleft(1L, __level) AS DOUBLE)) AS BIGINT)")
    celled = sized.withColumn("__cell", F.explode(F.array_distinct(F.array(cell(start), cell(end)))))
    # lengths come in 63 levels at most
    levels = sized.select("__level").distinct()
    looking = spans.crossJoin(F.broadcast(levels)).withColumn("__cell", cell(a))
    met = looking.join(celled, [*by, "__level", "__cell"])
    return met.where((F.col(start) <= F.col(a)) & (F.col(z) <= F.col(end))).drop("__level", "__cell")
