"""Operations over the whole row order without a one-partition window.

The table is range-partitioned by its order and written once, so that partition numbers are fixed; work runs inside
partitions, and what crosses them (counts, sums, edge rows) is one row for each partition, broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepframe.frame import ORD
from stepframe.shared import materialise

PART, ROW = "__part", "__row"


def ordered(df: DataFrame, in_place: bool = False) -> DataFrame:
    """df in order, with PART: the number of each row's partition, ascending in order, and ROW: its place there, from 0.

    A table that has PART already is taken as it is; one whose rows lie in order (in_place) is written without a sort.
    """
    if PART in df.columns:
        return df
    # monotonically_increasing_id counts the rows of a partition in its lower 33 bits
    place = {PART: F.spark_partition_id(), ROW: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    if in_place:
        return materialise(df.withColumns(place))
    return materialise(df.repartitionByRange(F.col(ORD)).sortWithinPartitions(ORD).withColumns(place))


def _within(*bounds: int) -> object:
    w = Window.partitionBy(PART).orderBy(ORD)
    return w.rowsBetween(*bounds) if bounds else w


def _spread(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), PART)


def number(parts: DataFrame, name: str = "__n") -> DataFrame:
    """Adds the dense row number from 1, without another shuffle."""
    counts = sorted((r[PART], r["count"]) for r in parts.groupBy(PART).count().collect())
    rows, total = [], 0
    for part, n in counts:
        rows.append((part, total))
        total += n
    return _spread(parts, rows, f"{PART} int, __before long").withColumn(name, (F.col("__before") + F.col(ROW) + 1).cast("double")).drop("__before")


def running(parts: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Adds running sums, the own row included."""
    totals = parts.groupBy(PART).agg(*(F.sum(c).alias(n) for n, c in sums.items())).collect()
    acc, rows = dict.fromkeys(sums, 0.0), []
    for r in sorted(totals, key=lambda r: r[PART]):
        rows.append((r[PART], *(float(acc[n]) for n in sums)))
        for n in sums:
            acc[n] += r[n] or 0
    out = _spread(parts, rows, f"{PART} int, " + ", ".join(f"`__b_{n}` double" for n in sums))
    own = {n: F.col(f"__b_{n}") + F.sum(c).over(_within(Window.unboundedPreceding, 0)) for n, c in sums.items()}
    return out.withColumns(own).drop(*(f"__b_{n}" for n in sums))


def neighbours(parts: DataFrame, value: Column, before: str, after: str) -> DataFrame:
    """Adds the struct `value` of the previous and of the next row, null at the ends. value must be a struct."""
    d = parts.withColumn("__v", value)
    edges = sorted(d.groupBy(PART).agg(F.min_by("__v", ORD).alias("first"), F.max_by("__v", ORD).alias("last")).collect(), key=lambda r: r[PART])
    kind = d.schema["__v"].dataType.simpleString()
    rows = [(r[PART], edges[k - 1]["last"] if k else None, edges[k + 1]["first"] if k + 1 < len(edges) else None) for k, r in enumerate(edges)]
    d = _spread(d, rows, f"{PART} int, __pl {kind}, __nf {kind}")
    w = _within()
    return d.withColumns({before: F.coalesce(F.lag("__v").over(w), "__pl"), after: F.coalesce(F.lead("__v").over(w), "__nf")}).drop("__v", "__pl", "__nf")


def flags(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `first.k` and `last.k` (booleans) for each key: a key's flag also rises when an earlier key changes."""
    value = F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)))
    d = neighbours(parts, value, "__prev", "__next")
    out = {}
    for side, other in (("first", "__prev"), ("last", "__next")):
        changed = F.col(other).isNull()
        for i, k in enumerate(keys):
            changed = changed | ~F.col(f"`{k}`").eqNullSafe(F.col(f"{other}.k{i}"))
            out[f"{side}.{k.lower()}"] = changed
    return d.withColumns(out).drop("__prev", "__next")


def ends(keys: list[str]) -> tuple[Column, Column]:
    """Whether a row is the first, and the last, of its keys' group, in one sort."""
    w = Window.partitionBy(*(F.col(f"`{k}`") for k in keys)).orderBy(ORD)
    return F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()


def sorted_flags(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same for a table sorted by its keys: groups are whole, so each key prefix is a window partition."""
    out = {}
    for i, k in enumerate(keys):
        out[f"first.{k.lower()}"], out[f"last.{k.lower()}"] = ends(keys[: i + 1])
    return df.withColumns(out)


def carried(parts: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds the last non-null `value` up to the own row."""
    d = parts.withColumn("__v", value)
    ends = sorted(d.groupBy(PART).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(ORD))).alias("v")).collect(), key=lambda r: r[PART])
    rows, held = [], None
    for r in ends:
        rows.append((r[PART], held))
        held = r["v"] if r["v"] is not None else held
    kind = d.schema["__v"].dataType.simpleString()
    d = _spread(d, rows, f"{PART} int, __h {kind}")
    return d.withColumn(name, F.coalesce(F.last("__v", ignorenulls=True).over(_within(Window.unboundedPreceding, 0)), "__h")).drop("__v", "__h")
