"""Order-dependent algorithms per group, streamed: no group is ever held as a whole by Spark or pandas."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.session import materialize


def per_group(df: DataFrame, keys: list[str], order: list[str], algorithm: Callable[[tuple, Iterator[tuple]], Iterable[tuple]], schema: str, rows_out: int = 4096) -> DataFrame:
    """Run ``algorithm(key, rows)`` over the rows of each group in ``order``; it yields output rows.

    One shuffle on ``keys`` and one sort; rows arrive as tuples of ``df``'s columns, in batches that may cut groups anywhere. The order
    should name enough columns to be total, so that results do not depend on partitioning.
    """
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        out: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: tuple(r[k] for k in at)):
            for row in algorithm(key, group):
                out.append(row)
                if len(out) >= rows_out:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            for _ in group:  # what the algorithm left unread
                pass
        if out:
            yield pd.DataFrame(out, columns=names)

    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


#: The task that a row of a spread table lies in; tasks follow each other in the order of the rows.
CHUNK = "_chunk"
#: Rows of one key that a single task may go through in order.
ROWS_IN_ORDER = 500_000


def spread(df: DataFrame, keys: list[str], order: list[str], counted: DataFrame | None = None, rows: int = ROWS_IN_ORDER) -> DataFrame:
    """``df`` as it is if no key has more than ``rows`` rows; else ranged over tasks by ``keys`` and ``order`` and written once, with ``CHUNK``: a key is then cut into as many chunks as it needs.

    ``with_previous`` and ``running`` give the same over both: chunk by chunk, they carry over what one chunk hands to the next, a row for each key and chunk. Null keys are a key of their own.
    ``counted`` is a cheaper table with the ``keys`` of at least as many rows, to be counted instead of ``df``.
    """
    most = (df if counted is None else counted).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return df if most <= rows else materialize(df.repartitionByRange(*keys, *order).withColumn(CHUNK, F.spark_partition_id()))


def _carried(chunks: DataFrame, handed: DataFrame, keys: list[str]) -> DataFrame:
    """``chunks`` with the columns of ``handed`` (one row per key and chunk), null where a key begins."""
    renamed = handed.withColumnsRenamed({k: f"__{k}" for k in [*keys, CHUNK]})
    same = reduce(lambda a, b: a & b, [chunks[k].eqNullSafe(renamed[f"__{k}"]) for k in [*keys, CHUNK]])
    return chunks.join(renamed, same, "left").drop(*[f"__{k}" for k in [*keys, CHUNK]])


def with_previous(chunks: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """``chunks`` (of ``spread``) with ``name``: ``column`` of the row before in the order of its key; null for the first."""
    if CHUNK not in chunks.columns:
        return chunks.withColumn(name, F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))
    by = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    ends = chunks.groupBy(*keys, CHUNK).agg(F.max(F.struct(*order, column))[column].alias("_end"))
    handed = ends.select(*keys, CHUNK, F.lag("_end").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("_handed"))
    placed = chunks.withColumns({"_first": F.row_number().over(by) == 1, name: F.lag(column).over(by)})
    return _carried(placed, handed, keys).withColumn(name, F.when(F.col("_first"), F.col("_handed")).otherwise(F.col(name))).drop("_first", "_handed")


def running(chunks: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], highest: dict[str, Column] | None = None) -> DataFrame:
    """``chunks`` (of ``spread``) with running sums, and running maxima (nulls don't count), of each key's rows in their order."""
    highest = highest or {}
    names = [*sums, *highest]
    total = lambda n, c: F.sum(c) if n in sums else F.max(c)
    if CHUNK not in chunks.columns:
        by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return chunks.withColumns({n: F.coalesce(total(n, c).over(by), F.lit(0)) if n in sums else total(n, c).over(by) for n, c in {**sums, **highest}.items()})
    own = chunks.withColumns({f"_v_{n}": c for n, c in {**sums, **highest}.items()})
    inner = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = own.groupBy(*keys, CHUNK).agg(*[total(n, f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    handed = totals.select(*keys, CHUNK, *[total(n, f"_t_{n}").over(before).alias(f"_c_{n}") for n in names])
    placed = own.withColumns({n: total(n, f"_v_{n}").over(inner) for n in names})
    whole = {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) if n in sums else F.greatest(n, f"_c_{n}") for n in names}
    return _carried(placed, handed, keys).withColumns(whole).drop(*[f"_{x}_{n}" for n in names for x in "vc"])


def numbered(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with ``name``: each row's place (from 1) in the order of all rows, without bringing them together.

    Rows are ranged over tasks and numbered within them; a task's offset is the sum of the sizes of those before, one row per task.
    """
    low = (1 << 33) - 1
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = materialize(ranged.withColumns({"__part": F.shiftright("__id", 33), "__row": F.col("__id").bitwiseAND(F.lit(low))}).drop("__id"))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__row") + 1).drop("__part", "__row", "__before")
