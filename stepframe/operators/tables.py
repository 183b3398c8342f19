"""Sort, dataset options, concatenation, append and match-merge on tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.frame import ORD, Table, Var, renamed
from stepframe.plans import ordered


#: Rows of a source that a merge looks up, where they repeat no key.
LOOKED_UP = 10_000


def by_columns(table: Table, keys: list[tuple[str, bool]]) -> list[Column]:
    """Sort expressions: missing first ascending, last descending; rows that tie stay in order."""
    out = []
    for k, down in keys:
        v = table.var(k)
        if v is None:
            raise KeyError(f"variable {k} does not exist")
        c = F.col(f"`{v.name}`")
        out.append(c.desc_nulls_last() if down else c.asc_nulls_first())
    return [*out, F.col(ORD).asc()]


def sort(table: Table, keys: list[tuple[str, bool]], nodupkey: bool = False) -> Table:
    """Stable sort; nodupkey keeps the first row of every key, in one shuffle by key before the sort."""
    order = by_columns(table, keys)
    df = table.df
    if nodupkey:
        names = [F.col(f"`{table.var(k).name}`") for k, _ in keys]
        df = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*names).orderBy(ORD))).where("__rn = 1").drop("__rn")
    df = df.orderBy(*order).withColumn(ORD, F.monotonically_increasing_id())
    ascending = tuple(table.var(k).name.lower() for k, down in keys)
    return Table(df, table.vars, ascending, True)


def numbered(table: Table) -> Table:
    """The table with `__n`, the dense row number."""
    return replace(table, df=ordered.number(ordered.ordered(table.df, table.in_place)), in_place=False)


def slice_rows(table: Table, firstobs: int | None, obs: int | None) -> Table:
    """Rows firstobs to obs by number, ends included."""
    if (firstobs or 1) <= 1 and obs is None:
        return table
    if (firstobs or 1) <= 1:
        return replace(table, df=table.df.orderBy(ORD).limit(obs))
    n = F.col("__n")
    keep = n >= firstobs
    return replace(table, df=numbered(table).df.where(keep & (n <= obs) if obs is not None else keep).select(*(f"`{x}`" for x in table.names), ORD))


def select(table: Table, keep: list[str] = (), drop: list[str] = (), rename: list[tuple[str, str]] = ()) -> Table:
    """keep (in source order, wins over drop), then rename."""
    keep, drop = {k.lower() for k in keep}, {k.lower() for k in drop}
    vars_ = [v for v in table.vars if (v.name.lower() in keep if keep else v.name.lower() not in drop)]
    new = {a.lower(): b for a, b in rename}
    out = [renamed(v, new.get(v.name.lower(), v.name)) for v in vars_]
    df = table.df.select(*(F.col(f"`{a.name}`").alias(b.name) for a, b in zip(vars_, out, strict=True)), ORD)
    left = {v.name.lower() for v in vars_}
    order = [k in left for k in table.sorted_by]
    kept_order = table.sorted_by[: order.index(False) if False in order else len(order)]
    return Table(df, out, tuple(new.get(k, k).lower() for k in kept_order), table.in_place)


def merged_vars(tables: list[Table]) -> list[Var]:
    """Variables in order of first appearance; the first source gives kind, format and label."""
    seen: dict[str, Var] = {}
    for t in tables:
        for v in t.vars:
            seen.setdefault(v.name.lower(), v)
    return list(seen.values())


def conform(table: Table, vars_: list[Var]) -> list[Column]:
    """The variables of another table as columns; absent or differently typed ones are missing."""
    out = []
    for v in vars_:
        own = table.var(v.name)
        if own is None or own.kind != v.kind:
            out.append((F.lit(None).cast("double") if v.kind == "num" else F.lit("")).alias(v.name))
        else:
            out.append(F.col(f"`{own.name}`").alias(v.name))
    return out


def concatenate(tables: list[Table], extra: list[list[Column]] | None = None) -> Table:
    """Rows of the tables one after the other, in the order (source, old order)."""
    vars_ = merged_vars(tables)
    if len(tables) == 1 and not extra:
        return tables[0]
    parts = []
    for k, t in enumerate(tables):
        place = F.struct(F.lit(k).alias("s"), F.col(ORD).alias("o")).alias("__place")
        parts.append(t.df.select(*conform(t, vars_), *(extra[k] if extra else []), place))
    df = reduce(lambda a, b: a.unionByName(b), parts)
    # a union keeps its inputs' partitions one after the other, so rows that lie in order need no sort
    if not all(t.in_place for t in tables):
        df = df.orderBy("__place")
    return Table(df.drop("__place").withColumn(ORD, F.monotonically_increasing_id()), vars_, (), True)


def append(base: Table, data: Table, force: bool = False) -> Table:
    """data under base, with base's variables; extra or mistyped ones need force."""
    odd = [v.name for v in data.vars if base.var(v.name) is None or base.var(v.name).kind != v.kind]
    if odd and not force:
        raise ValueError(f"variables {', '.join(odd)} do not fit the base; use FORCE")
    fitted = Table(data.df.select(*conform(data, base.vars), ORD), base.vars)
    return concatenate([base, fitted])


def merge(tables: list[Table], keys: list[str], flags: list[str | None]) -> Table:
    """Match-merge by keys: for each key as many rows as its largest group, shorter groups hold their last row.

    The result is sorted by key and carries, per source, `__in_<k>` (double): 1 on rows that the source contributes
    afresh. Without keys rows pair by number.

    The sources' rows meet under their key in one shuffle; there they are numbered, paired by number, and each
    source's last row is carried on.
    """
    vars_ = merged_vars(tables)
    by = [next(v for v in vars_ if v.name.lower() == k.lower()) for k in keys]
    low_keys = {b.name.lower() for b in by}
    owners: dict[str, list[int]] = {}
    for k, t in enumerate(tables):
        for v in t.vars:
            if v.name.lower() not in low_keys:
                owners.setdefault(v.name.lower(), []).append(k)
    on = [f"__k{i}" for i in range(len(by))]
    own = [F.struct(F.lit(True).alias("__here"), *(F.col(f"`{v.name}`").alias(v.name.lower()) for v in t.vars if v.name.lower() in owners)) for t in tables]
    if not by:
        return _merged(_side_by_side(tables, own), vars_, by, owners)
    if len(tables) == 2 and all(t.var(b.name).kind == b.kind for t in tables for b in by):
        for small in (1, 0):
            if (rows := _looked_up(tables, by, own, small)) is not None:
                return _merged(rows, vars_, by, owners)
    sides = []
    for k, t in enumerate(tables):
        cols = [F.col(f"`{t.var(b.name).name}`").alias(x) for x, b in zip(on, by, strict=True)]
        sides.append(t.df.select(*cols, F.lit(k).alias("__src"), F.col(ORD).alias("__at"), own[k].alias(f"__s{k}")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("__at", F.struct(*(F.when(F.col("__src") == k, F.col("__at")).alias(f"o{k}") if k == j else F.lit(None).cast(sides[k].schema["__at"].dataType).alias(f"o{k}") for k in range(len(sides))))) for j, s in enumerate(sides)])
    number = F.row_number().over(Window.partitionBy(*on, "__src").orderBy("__at")).cast("long")
    held = Window.partitionBy(*on).orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0)
    paired = rows.repartition(*on).withColumn("__rn", number).groupBy(*on, "__rn").agg(*(F.first(f"__s{k}", ignorenulls=True).alias(f"__s{k}") for k in range(len(sides))))
    paired = paired.withColumns({f"__in_{k}": F.col(f"__s{k}").isNotNull().cast("double") for k in range(len(sides))} | {f"__s{k}": F.last(f"__s{k}", ignorenulls=True).over(held) for k in range(len(sides))})
    return _merged(paired, vars_, by, owners)


def _looked_up(tables: list[Table], by: list[Var], own: list[Column], small: int) -> DataFrame | None:
    """The paired rows of two sources of which one is small and repeats no key, else None: the other's rows stay where they are, so a key with many of them is not one task's."""
    on, large = [f"__k{i}" for i in range(len(by))], 1 - small
    keyed = [t.df.select(*(F.col(f"`{t.var(b.name).name}`").alias(x) for x, b in zip(on, by, strict=True)), own[k].alias(f"__s{k}"), F.col(ORD).alias("__rn")) for k, t in enumerate(tables)]
    spark = tables[0].df.sparkSession
    held = keyed[small].drop("__rn").limit(LOOKED_UP + 1).collect()
    if len(held) > LOOKED_UP or len({tuple(r)[: len(on)] for r in held}) < len(held) or any(x != x for r in held for x in r[: len(on)]):
        return None
    few = F.broadcast(spark.createDataFrame(held, keyed[small].drop("__rn").schema))
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in on))
    rows = keyed[large]
    # the first row of each key that the small source has: there it contributes afresh
    heads = rows.join(few.select(*on), same(rows, few), "left_semi").groupBy(*on).agg(F.min("__rn").alias("__head")).collect()
    starts = F.broadcast(spark.createDataFrame(heads, T.StructType([*(rows.schema[c] for c in on), T.StructField("__head", rows.schema["__rn"].dataType)])))
    met = few.join(starts, same(few, starts), "left").select(*(few[c] for c in on), f"__s{small}", "__head")
    met = F.broadcast(met)
    both = rows.join(met, same(rows, met), "left").select(*(rows[c] for c in on), "__rn", f"__s{large}", f"__s{small}", F.lit(1.0).alias(f"__in_{large}"), F.coalesce((F.col("__rn") == F.col("__head")).cast("double"), F.lit(0.0)).alias(f"__in_{small}"))
    nothing = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    alone = met.where("__head is null").select(*on, nothing("__rn"), nothing(f"__s{large}"), f"__s{small}", F.lit(0.0).alias(f"__in_{large}"), F.lit(1.0).alias(f"__in_{small}"))
    return both.unionByName(alone)


def _side_by_side(tables: list[Table], own: list[Column]) -> DataFrame:
    """Rows paired by number: `__rn`, and for each source `__s<k>` (its row, or its last) and `__in_<k>`."""
    out = None
    for k, t in enumerate(tables):
        n = numbered(t).df.select(F.col("__n").cast("long").alias("__rn"), own[k].alias(f"__s{k}"))
        out = n if out is None else out.join(n, "__rn", "full")
    for k, t in enumerate(tables):
        last = t.df.select(ORD, own[k].alias("row")).agg(F.max_by("row", ORD).alias("row"))  # one row
        out = out.withColumn(f"__in_{k}", F.col(f"__s{k}").isNotNull().cast("double")).join(F.broadcast(last), how="left").withColumn(f"__s{k}", F.coalesce(f"__s{k}", "row")).drop("row")
    return out


def _merged(rows: DataFrame, vars_: list[Var], by: list[Var], owners: dict[str, list[int]]) -> Table:
    """Variables, IN flags and order of paired rows."""
    out = [F.col(f"__k{i}").alias(b.name) for i, b in enumerate(by)]
    for v in vars_:
        low = v.name.lower()
        if low in owners:
            # a later source that has the key overwrites an earlier one's variable of the same name
            value = None
            for k in reversed(owners[low]):
                here, c = F.col(f"__s{k}").isNotNull(), F.col(f"__s{k}.`{low}`")
                value = F.when(here, c) if value is None else value.when(here, c)
            out.append((value.otherwise(F.lit("")) if v.kind == "char" else value).alias(v.name))
    ins = [c for c in rows.columns if c.startswith("__in_")]
    place = [F.col(f"__k{i}").asc_nulls_first() for i in range(len(by))] + [F.col("__rn").asc()]
    df = rows.orderBy(*place).select(*out, *ins, F.monotonically_increasing_id().alias(ORD))
    final = [v for v in vars_ if v.name.lower() in owners or v in by]
    return Table(df.select(*(f"`{v.name}`" for v in final), *sorted(ins), ORD), final, tuple(b.name.lower() for b in by))
