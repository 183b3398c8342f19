"""Declarative checks of a table: counts of violations, and the violating rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from stepframe.frame import ORD, Library, Table, Var
from stepframe.functions import columns as C
from stepframe.lang.parser import Stmt
from stepframe.plans import ordered
from stepframe.plans.step import evaluate


@dataclass
class Verdict:
    description: str
    state: str  # PASS, FAIL or N/RUN
    violations: int
    checked: int
    severity: str
    sample: list[int]
    message: str = ""


def _missing(v: Var) -> Column:
    c = F.col(f"`{v.name}`")
    return c == "" if v.kind == "char" else c.isNull()


def _shown(x: Any) -> str:
    return f"{x:g}" if isinstance(x, float) else "low" if x is None else str(x)


def describe(s: Stmt) -> str:
    p: dict[str, Any] = s.parts
    body, check = " ".join(p["names"]), p["check"]
    if check == "range":
        return f"range {body} " + (f"{_shown(p['low'])} - {'high' if p['high'] is None else _shown(p['high'])}" if "low" in p else f"{p['op']} {p['bound']:g}")
    if check == "values":
        return f"values {body} in ({' '.join(map(_shown, p['set']))})"
    if check == "type":
        return "type " + " ".join(f"{n}={k}" for n, k in zip(p["names"], p["types"], strict=True))
    if check == "key":
        return f"key {body} references {p['parent']}({' '.join(p['keys'])})"
    return f'rule "{p["label"]}"' if check == "rule" else f"{check} {body}"


def violates(s: Stmt, table: Table, lib: Library) -> Column | None:
    """Whether a row violates a row-level check; None if a column is unknown."""
    p = s.parts
    vs = [table.var(n) for n in p["names"]]
    if any(v is None for v in vs):
        return None
    check = p["check"]
    if check == "notnull":
        return reduce(lambda a, b: a | b, map(_missing, vs))
    v = vs[0] if vs else None
    c = F.col(f"`{v.name}`") if v else None
    if check == "values":
        kept = [x for x in p["set"] if isinstance(x, str) == (v.kind == "char")]
        return _missing(v) | ~(c.isin(kept) if kept else F.lit(False))
    if check == "range":
        x = C.num(C.Typed(c, v.kind))
        if "low" in p:
            ok = F.lit(True)
            if p["low"] is not None:
                ok = ok & (x >= p["low"])
            if p["high"] is not None:
                ok = ok & (x <= p["high"])
            return x.isNull() | ~ok
        return x.isNull() | ~C.compare(p["op"], C.Typed(x, "num"), C.lit(p["bound"]))
    if check == "unique":
        # every row of a repeated key; a missing value is a value of the key
        return F.count(F.lit(1)).over(Window.partitionBy(*(F.col(f"`{x.name}`") for x in vs))) > 1
    if check == "rule":
        env = {x.name.lower(): C.Typed(F.col(f"`{x.name}`"), x.kind) for x in table.vars}
        got = evaluate(p["cond"], env, {}, lib)
        return F.lit(True) if got.kind == "char" else F.coalesce(got.col == 0, F.lit(True))
    return None


def prove(table: Table, checks: list[Stmt], lib: Library, severity: str = "error", maxsample: int = 20) -> tuple[list[Verdict], Table]:
    """A verdict for each check, and the violations: source columns, _rule_, _obs_, by row and rule.

    All row-level checks are booleans of one projection, written once; keys are checked by a join with the parent's
    distinct keys. Counts are one aggregation, samples of all rules another.
    """
    parts = table.df
    tests: dict[int, str] = {}
    dataset: dict[int, tuple[bool, int]] = {}
    for k, s in enumerate(checks):
        p = s.parts
        if p["check"] == "require":
            absent = [n for n in p["names"] if table.var(n) is None]
            dataset[k] = (True, len(absent))
        elif p["check"] == "type":
            vs = [table.var(n) for n in p["names"]]
            if all(vs):
                dataset[k] = (True, sum(v.kind != ("char" if kind.startswith(("c", "$")) else "num") for v, kind in zip(vs, p["types"], strict=True)))
        elif p["check"] == "key":
            lib_name, _, name = p["parent"].rpartition(".")
            vs = [table.var(n) for n in p["names"]]
            if any(v is None for v in vs) or not lib.has(lib_name, name):
                continue
            parent = lib.get(lib_name, name)
            keys = [parent.var(n) for n in p["keys"]]
            if any(v is None for v in keys):
                continue
            known = parent.df.where(reduce(lambda a, b: a & b, (~_missing(v) for v in keys))).select(*(F.col(f"`{v.name}`").alias(f"__p{i}") for i, v in enumerate(keys))).distinct().withColumn(f"__hit{k}", F.lit(True))
            on = reduce(lambda a, b: a & b, (F.col(f"`{v.name}`") == F.col(f"__p{i}") for i, v in enumerate(vs)))
            parts = parts.join(known, on, "left").drop(*(f"__p{i}" for i in range(len(keys))))
            none_missing = reduce(lambda a, b: a & b, (~_missing(v) for v in vs))
            parts = parts.withColumn(f"__t{k}", none_missing & F.col(f"__hit{k}").isNull()).drop(f"__hit{k}")
            tests[k] = f"__t{k}"
        else:
            c = violates(s, table, lib)
            if c is not None:
                parts = parts.withColumn(f"__t{k}", F.coalesce(c, F.lit(False)))
                tests[k] = f"__t{k}"
    moved = any(s.parts["check"] in ("unique", "key") for s in checks)
    parts = ordered.ordered(parts, table.in_place and not moved)
    sums = [F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c)).alias(f"v{k}") for k, c in tests.items())]
    counted = parts.agg(*sums).first()
    failing = [k for k in tests if counted[f"v{k}"]]
    rule = lambda ks, value: F.filter(F.array(*(F.when(F.col(tests[k]), value(k)) for k in ks)), lambda x: x.isNotNull())
    if failing:
        parts = ordered.number(parts, "__obs")
        each = parts.select(F.explode(rule(failing, F.lit)).alias("k"), "__obs")
        first = F.row_number().over(Window.partitionBy("k").orderBy("__obs"))
        rows = each.withColumn("at", first).where(F.col("at") <= maxsample).select("k", "__obs").collect()
    else:
        parts, rows = parts.withColumn("__obs", F.lit(0.0)), []
    samples = {k: sorted(int(r["__obs"]) for r in rows if r["k"] == k) for k in failing}
    verdicts = []
    for k, s in enumerate(checks):
        level = s.parts["severity"] or severity
        if k in dataset:
            verdicts.append(Verdict(describe(s), "FAIL" if dataset[k][1] else "PASS", dataset[k][1], len(s.parts["names"]), level, [], s.parts["message"]))
        elif k in tests:
            n = counted[f"v{k}"]
            verdicts.append(Verdict(describe(s), "FAIL" if n else "PASS", n, counted["n"], level, samples.get(k, []), s.parts["message"]))
        else:
            verdicts.append(Verdict(describe(s), "N/RUN", 0, 0, level, []))
    found = rule(failing, lambda k: F.lit(rule_key(checks[k]))) if failing else F.array().cast("array<string>")
    cols = [F.col(f"`{v.name}`") for v in table.vars]
    d = parts.select(*cols, F.explode(found).alias("_rule_"), F.col("__obs").alias("_obs_")).orderBy("_obs_", "_rule_").withColumn(ORD, F.monotonically_increasing_id())
    return verdicts, Table(d, [*table.vars, Var("_rule_", "char"), Var("_obs_", "num")], (), True)


def rule_key(s: Stmt) -> str:
    """What _rule_ holds: the label of a rule, else the description."""
    return s.parts.get("label") or describe(s)


def report(verdicts: list[Verdict]) -> str:
    width = max([len(v.description) for v in verdicts], default=10)
    lines = [f"{v.description:<{width}}  {v.state:<5}  {v.violations}/{v.checked}" + (f"  obs {', '.join(map(str, v.sample))}" if v.sample else "") for v in verdicts]
    return "\n".join(lines)
