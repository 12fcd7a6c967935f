"""Orders over groups that may hold most of a table: spans of a sorted table, and what each span carries to the next.

A table is range-partitioned by group and order, once, into a written stage; a
group that fills many partitions is as many spans.  Rows are numbered or summed
within their span, spans are summed up group by group, of which there are no more
than partitions and groups together, and both are put together.  So no task
holds more than a partition, whatever the group sizes, and as cuts follow the
values, dense stretches of an order are cut as well as sparse ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.stages import stage

SPAN = "_span"


def spans(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` range-partitioned by ``by`` and ``order``, with its partition as ``_span``, which never decreases along the order."""
    return stage(df.repartitionByRange(*by, *order).withColumn(SPAN, F.spark_partition_id()), "spans")


def same(left: str, right: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def carried(placed: DataFrame, by: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """(by, _span, names): for each span the sums of all spans of its group before it; 0 before the first."""
    totals = placed.groupBy(*by, SPAN).agg(*(c.alias(f"_{name}") for name, c in sums.items()))
    before = Window.partitionBy(*by).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, SPAN, *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(name) for name in sums))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], inclusive: bool = True) -> DataFrame:
    """``df`` with running sums of its expressions along ``order`` within ``by``, of the rows up to and including each, or only before it.

    Rows equal in ``order`` are taken one after another in no fixed order, so ``order`` should end in a unique column.  Null groups are a group.
    """
    by, order = list(by), list(order)
    placed = spans(df.withColumns({f"_x_{name}": c for name, c in sums.items()}), by, order)
    inside = Window.partitionBy(*by, SPAN).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = placed.withColumns({f"_in_{name}": F.coalesce(F.sum(f"_x_{name}").over(inside), F.lit(0)) for name in sums})
    before = carried(placed, by, {name: F.sum(f"_x_{name}") for name in sums})
    joined = own.alias("o").join(before.alias("b"), same("o", "b", [*by, SPAN]))
    return joined.select(*(F.col(f"o.{c}") for c in df.columns), *((F.col(f"o._in_{name}") + F.col(f"b.{name}")).alias(name) for name in sums))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the place of each row in its group, from 1."""
    return running(df, by, order, {name: F.lit(1).cast("long")})
