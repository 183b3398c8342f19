"""Summary statistics, frequency tables, chi-square and least squares on tables."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepframe.frame import ORD, Table, Var, from_dataframe
from stepframe.plans import ordered
from stepframe.shared import materialise

STATS: dict[str, Callable[[Column], Column]] = {
    "n": lambda c: F.count(c).cast("double"),
    "mean": F.avg,
    "std": F.stddev_samp,
    "stddev": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
}
DEFAULT = ("n", "mean", "std", "min", "max")
LABELS = {"n": "N", "mean": "Mean", "std": "StdDev", "stddev": "StdDev", "min": "Min", "max": "Max", "sum": "Sum"}

Shown = Callable[[Var], Column]


def plain(v: Var) -> Column:
    return F.col(f"`{v.name}`")


def means_groups(table: Table, vars_: list[str], classes: list[str], stats: tuple[str, ...] = DEFAULT, shown: Shown = plain) -> DataFrame:
    """One row for each combination of class values (a missing value is one): classes, _freq, and {stat}_{k} of variable k.

    Groups are formed by the shown (formatted) value; the class column holds the raw value of the group's first row.
    """
    cls = [table.var(c) for c in classes]
    keyed = table.df.select(*(shown(v).alias(f"__g{k}") for k, v in enumerate(cls)), *(F.col(f"`{v.name}`").alias(f"__r{k}") for k, v in enumerate(cls)), *(F.col(f"`{table.var(x).name}`").alias(f"__x{k}") for k, x in enumerate(vars_)), ORD)
    aggs = [F.min_by(F.struct(F.col(f"__r{k}").alias("v")), ORD)["v"].alias(f"c{k}") for k in range(len(cls))]
    aggs += [F.count(F.lit(1)).cast("double").alias("_freq")]
    aggs += [STATS[s](F.col(f"__x{k}")).alias(f"{s}_{k}") for k in range(len(vars_)) for s in dict.fromkeys(stats)]
    g = keyed.groupBy(*(f"__g{k}" for k in range(len(cls)))).agg(*aggs)
    return g.orderBy(*(F.col(f"c{k}").asc_nulls_first() for k in range(len(cls)))) if cls else g


def means_listing(table: Table, vars_: list[str], classes: list[str], stats: tuple[str, ...] = DEFAULT, shown: Shown = plain) -> Table:
    """Classes, Variable and the statistics: one row for each group and variable."""
    g = means_groups(table, vars_, classes, stats, shown)
    cls = [table.var(c) for c in classes]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(table.var(x).name).alias("Variable"), *(F.col(f"{s}_{k}").alias(LABELS[s]) for s in stats)) for k, x in enumerate(vars_))))
    d = g.select(*(F.col(f"c{k}").alias(v.name) for k, v in enumerate(cls)), rows.alias("r")).select(*(f"`{v.name}`" for v in cls), "r.*").drop("k").withColumn(ORD, F.monotonically_increasing_id())
    return Table(d, [*cls, Var("Variable", "char"), *(Var(LABELS[s], "num") for s in stats)], (), True)


def means_out(table: Table, vars_: list[str], classes: list[str], named: list[tuple[str, list[str]]], shown: Shown = plain) -> Table:
    """Classes, _TYPE_, _FREQ_ and named statistics, each list of names positional to the variables."""
    g = means_groups(table, vars_, classes, tuple(s for s, _ in named) or ("n",), shown)
    cls = [table.var(c) for c in classes]
    out = [F.col(f"c{k}").alias(v.name) for k, v in enumerate(cls)]
    out += [F.lit(float(2 ** len(cls) - 1)).alias("_TYPE_"), F.col("_freq").alias("_FREQ_")]
    more = [(name, f"{s}_{k}") for s, names in named for k, name in enumerate(names) if k < len(vars_)]
    d = g.select(*out, *(F.col(c).alias(n) for n, c in more), F.monotonically_increasing_id().alias(ORD))
    return Table(d, [*cls, Var("_TYPE_", "num"), Var("_FREQ_", "num"), *(Var(n, "num") for n, _ in more)], (), True)


def _present(v: Var) -> Column:
    c = F.col(f"`{v.name}`")
    return c != "" if v.kind == "char" else c.isNotNull()


def cells(table: Table, names: list[str], shown: Shown = plain) -> DataFrame:
    """Counts of the combinations without missing values: c0.. (least raw value), g0.. (shown), n."""
    vs = [table.var(n) for n in names]
    if any(v is None for v in vs):
        raise KeyError(f"unknown variable in {'*'.join(names)}")
    d = table.df
    for v in vs:
        d = d.where(_present(v))
    d = d.select(*(shown(v).alias(f"g{k}") for k, v in enumerate(vs)), *(F.col(f"`{v.name}`").alias(f"r{k}") for k, v in enumerate(vs)))
    return d.groupBy(*(f"g{k}" for k in range(len(vs)))).agg(*(F.min(f"r{k}").alias(f"c{k}") for k in range(len(vs))), F.count(F.lit(1)).cast("double").alias("n"))


#: Up to so many counted cells are numbered and summed in one task.
FEW_CELLS = 100_000


def _ranked(c: DataFrame, k: int) -> DataFrame:
    """Cells in the order of their raw values."""
    return c.orderBy(*(F.col(f"c{i}").asc_nulls_first() for i in range(k))).withColumn(ORD, F.monotonically_increasing_id())


def freq_list(table: Table, names: list[str], shown: Shown = plain) -> Table:
    """Values, Frequency, Percent, CumFreq, CumPercent; ordered by raw value."""
    vs = [table.var(n) for n in names]
    c = materialise(cells(table, names, shown))
    size = c.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    if size[0] <= FEW_CELLS:
        order = [F.col(f"c{k}").asc_nulls_first() for k in range(len(vs))]
        c = c.withColumn("cum", F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn(ORD, F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        c = ordered.running(ordered.ordered(_ranked(c, len(vs)), in_place=True), {"cum": F.col("n")}).drop(ordered.PART)
    d = c.select(*(F.col(f"c{k}").alias(v.name) for k, v in enumerate(vs)), F.col("n").alias("Frequency"), (100 * F.col("n") / size[1]).alias("Percent"), F.col("cum").alias("CumFreq"), (100 * F.col("cum") / size[1]).alias("CumPercent"), ORD)
    return Table(d, [*vs, *(Var(x, "num") for x in ("Frequency", "Percent", "CumFreq", "CumPercent"))])


def crosstab(table: Table, row: str, col: str, shown: Shown = plain) -> Table:
    """Row and column value, count, cell, row and column percent."""
    vs = [table.var(row), table.var(col)]
    c = cells(table, [row, col], shown)
    c = materialise(c)
    total = F.lit(c.agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0])
    by_row, by_col = (F.sum("n").over(Window.partitionBy(p)) for p in ("g0", "g1"))
    d = c.withColumns({"by_row": by_row, "by_col": by_col})
    by_row, by_col = F.col("by_row"), F.col("by_col")
    d = _ranked(d, 2).select(F.col("c0").alias(vs[0].name), F.col("c1").alias(vs[1].name), F.col("n").alias("Frequency"), (100 * F.col("n") / total).alias("Percent"), (100 * F.col("n") / by_row).alias("RowPercent"), (100 * F.col("n") / by_col).alias("ColPercent"), ORD)
    return Table(d, [*vs, *(Var(x, "num") for x in ("Frequency", "Percent", "RowPercent", "ColPercent"))])


def freq_out(table: Table, names: list[str], shown: Shown = plain) -> Table:
    """Values, COUNT and PERCENT."""
    vs = [table.var(n) for n in names]
    c = materialise(cells(table, names, shown))
    total = c.agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0]
    d = _ranked(c, len(vs)).select(*(F.col(f"c{k}").alias(v.name) for k, v in enumerate(vs)), F.col("n").alias("COUNT"), (100 * F.col("n") / total).alias("PERCENT"), ORD)
    return Table(d, [*vs, Var("COUNT", "num"), Var("PERCENT", "num")])


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def beta_part(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        f *= c * d
        if i and abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return beta_part(df / 2, 0.5, df / (df + t * t))


def chi_square(table: Table, row: str, col: str, shown: Shown = plain) -> tuple[float, int, float]:
    """(statistic, degrees of freedom, p). The sums are made in Spark; fewer than two levels give (0, 0, 1)."""
    c = cells(table, [row, col], shown)
    w = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    # sum of n^2 / (r * c) over the cells that occur: stat = N * (that - 1)
    r = c.select((F.col("n") * F.col("n") / (w("g0") * w("g1"))).alias("q"), "n", "g0", "g1").agg(F.sum("q").alias("q"), F.sum("n").alias("n"), F.count_distinct("g0").alias("r"), F.count_distinct("g1").alias("c")).first()
    if not r["n"] or r["r"] < 2 or r["c"] < 2:
        return 0.0, 0, 1.0
    stat, df = max(0.0, r["n"] * (r["q"] - 1)), (r["r"] - 1) * (r["c"] - 1)
    return stat, df, gamma_tail(df / 2, stat / 2)


def least_squares(table: Table, y: str, xs: list[str], classes: list[str] = ()) -> tuple[Table, dict[str, float]]:
    """Estimates and fit over complete cases, from one aggregation of cross-products.

    A class variable becomes indicators of its levels (sorted as text); the last level is the reference with DF 0.
    """
    classes = {c.lower() for c in classes}
    target = table.var(y)
    complete = _present(target)
    for x in xs:
        complete = complete & _present(table.var(x))
    d = table.df.where(complete)
    columns, names, reference = [F.lit(1.0)], ["Intercept"], []
    for x in xs:
        v = table.var(x)
        c = F.col(f"`{v.name}`")
        if x.lower() in classes:
            from stepframe.functions.columns import to_text

            text = c if v.kind == "char" else to_text(c)
            levels = sorted(r[0] for r in d.select(text).distinct().collect())
            columns += [F.when(text == lv, 1.0).otherwise(0.0) for lv in levels[:-1]]
            names += [f"{v.name} {lv}" for lv in levels[:-1]]
            if levels:
                reference.append((len(names), f"{v.name} {levels[-1]}"))
        else:
            columns.append(c)
            names.append(v.name)
    p, target_c = len(columns), F.col(f"`{target.name}`")
    products = [F.sum(columns[i] * columns[j]).alias(f"p{i}_{j}") for i in range(p) for j in range(i, p)]
    products += [F.sum(columns[i] * target_c).alias(f"q{i}") for i in range(p)] + [F.sum(target_c * target_c).alias("yy"), F.count(F.lit(1)).alias("n")]
    r = d.agg(*products).first()
    n = r["n"]
    if n <= p:
        raise ValueError(f"{n} complete rows for {p} parameters")
    a, b = np.zeros((p, p)), np.array([r[f"q{i}"] for i in range(p)])
    for i in range(p):
        for j in range(i, p):
            a[i, j] = a[j, i] = r[f"p{i}_{j}"]
    scale = np.sqrt(np.diag(a))
    if (scale == 0).any() or np.linalg.cond(a / np.outer(scale, scale)) > 1e13:
        raise ValueError("the model is singular")
    inverse = np.linalg.inv(a / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inverse @ b
    sse = max(0.0, r["yy"] - float(beta @ b))
    sst = r["yy"] - r["q0"] ** 2 / n
    mse = sse / (n - p)
    se = np.sqrt(np.maximum(np.diag(inverse) * mse, 0))
    rows = []
    for k in range(p):
        t = beta[k] / se[k] if se[k] > 0 else None
        rows.append((names[k], 1.0, float(beta[k]), float(se[k]), None if t is None else float(t), 0.0 if t is None else t_two_sided(float(t), n - p)))
    for at, name in reversed(reference):
        rows.insert(at, (name, 0.0, 0.0, None, None, None))
    spark = table.df.sparkSession
    out = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], f"Parameter string, DF double, Estimate double, StdErr double, tValue double, Probt double, {ORD} long")
    fit = {"n": float(n), "sse": sse, "mse": mse, "rmse": math.sqrt(mse), "rsquare": 1 - sse / sst if sst > 0 else 0.0}
    return from_dataframe(out, F.col(ORD)), fit
