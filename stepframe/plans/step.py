"""DATA steps to plans.

A step is first executed symbolically: variables are Columns, IF merges them with CASE, loops with constant bounds
unroll, OUTPUT collects guarded snapshots. Running totals, carried values, _N_ and first./last. become windows (see
plans.ordered). What is left (WHILE loops over state, held lines, PUT) goes to the interpreter: over partitions side by
side if rows do not depend on each other, per BY group if state starts afresh there, else over one ordered partition.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepframe.frame import ORD, Library, Table, Var
from stepframe.functions import columns as C
from stepframe.functions.columns import Typed
from stepframe.functions.scalar import CHAR_FUNCTIONS
from stepframe.functions.texts import UserFormat, spec
from stepframe.lang.parser import DataStep, Expr, Ref, Stmt
from stepframe.operators import tables as ops
from stepframe.plans import ordered
from stepframe.plans.interp import Interpreter, walk
from stepframe.shared import materialise
from stepframe.sources import lines as L

log = logging.getLogger("stepframe")
UNROLL = 100


class Fallback(Exception):
    """The step has no symbolic form."""


def expression_vars(e) -> Iterator[str]:
    if isinstance(e, tuple):
        if e and e[0] == "var":
            yield e[1].lower()
            return
        for x in e[1:]:
            yield from expression_vars(x)
    elif isinstance(e, list):
        for x in e:
            yield from expression_vars(x)


def statement_expressions(s: Stmt) -> Iterator[Expr]:
    for name in ("cond", "value", "first", "last", "step", "target"):
        if s.parts.get(name) is not None:
            yield s.parts[name]


def kind_of(e: Expr, kinds: dict[str, str], arrays: dict[str, list[str]], informats: dict[str, UserFormat] | None = None) -> str:
    tag = e[0]
    if tag == "str" or tag == "put":
        return "char"
    if tag == "var":
        return kinds.get(e[1].lower(), "num")
    if tag == "idx":
        return kinds.get((arrays.get(e[1]) or [""])[0], "num")
    if tag == "bin":
        return "char" if e[1] == "||" else "num"
    if tag == "call":
        return "char" if e[1] in CHAR_FUNCTIONS and e[1] not in arrays else kinds.get(arrays[e[1]][0], "num") if e[1] in arrays else "num"
    if tag == "input":
        return "char" if e[2].strip().startswith("$") else "num"
    return "num"


@dataclass
class Plan:
    """What the statements of a step say before anything runs."""

    step: DataStep
    lib: Library
    source: Table | None = None
    lines: DataFrame | None = None
    flags: dict[str, str] = field(default_factory=dict)  # automatic variable -> column
    kinds: dict[str, str] = field(default_factory=dict)
    pdv: dict[str, str] = field(default_factory=dict)  # lower name -> display name, in order
    auto: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.body = self.step.body
        self.all = list(walk(self.body))
        self.arrays = {s.name: [x.lower() for x in s.elements] for s in self.all if s.kind == "array"}
        self.keys = next((s.keys for s in self.body if s.kind == "by"), [])
        self.infile = next((s.parts for s in self.body if s.kind == "infile"), {})
        self.explicit = any(s.kind == "output" for s in self.all)
        self.used = {v for s in self.all for e in statement_expressions(s) for v in expression_vars(e)}
        self.retained = {n.lower() for s in self.body if s.kind == "retain" for n, _ in s.items} | {s.name.lower() for s in self.all if s.kind == "sum"}

    def declare(self, name: str, kind: str) -> None:
        low = name.lower()
        self.pdv.setdefault(low, name)
        self.kinds.setdefault(low, kind)


def read_ref(ref: Ref, lib: Library) -> Table:
    """A dataset with its options: firstobs/obs, then where, keep, drop, rename."""
    t = lib.get(ref.lib, ref.name)
    if ref.firstobs or ref.obs is not None:
        t = ops.slice_rows(t, ref.firstobs, ref.obs)
    if ref.where is not None:
        t = where(t, ref.where, lib)
    if ref.keep or ref.drop or ref.rename:
        t = ops.select(t, ref.keep, ref.drop, ref.rename)
    return t


def where(table: Table, cond: Expr, lib: Library) -> Table:
    env = {v.name.lower(): Typed(F.col(f"`{v.name}`"), v.kind) for v in table.vars}
    return replace(table, df=table.df.where(C.truth(evaluate(cond, env, {}, lib))))


def evaluate(e: Expr, env: dict[str, Typed], arrays: dict[str, list[str]], lib: Library | None) -> Typed:
    """An expression as a Column."""
    tag = e[0]
    if tag in ("num", "str"):
        return C.lit(e[1])
    if tag == "var":
        got = env.get(e[1].lower())
        if got is None:
            return C.lit(None)
        return got
    if tag == "idx" or (tag == "call" and e[1] in arrays):
        members = arrays.get(e[1])
        at = e[2] if tag == "idx" else e[2][0]
        if members is None:
            raise Fallback(f"array {e[1]}")
        k = evaluate(at, env, arrays, lib)
        if isinstance(k.value, float):
            return env[members[_subscript(e[1], k.value, members) - 1]]
        values = [env[m] for m in members]
        n = C.num(k).cast("int")
        inside = n.isNotNull() & n.between(1, len(members))
        picked = F.element_at(F.array(*(v.col for v in values)), F.when(inside, n).otherwise(F.raise_error(F.lit(f"array {e[1]}: subscript out of range"))))
        return Typed(picked, values[0].kind)
    if tag == "un":
        x = evaluate(e[2], env, arrays, lib)
        if e[1] == "not":
            return C.flag(~C.truth(x))
        if isinstance(x.value, float):
            return C.lit(-x.value if e[1] == "-" else x.value)
        return Typed(-C.num(x) if e[1] == "-" else C.num(x), "num")
    if tag == "bin":
        op = e[1]
        a, b = evaluate(e[2], env, arrays, lib), evaluate(e[3], env, arrays, lib)
        if op in ("and", "or"):
            x, y = C.truth(a), C.truth(b)
            return C.flag(x & y if op == "and" else x | y)
        if op == "||":
            return Typed(F.concat(C.char(a), C.char(b)), "char")
        if op in ("=", "^=", "<", "<=", ">", ">="):
            return C.flag(C.compare(op, a, b))
        if isinstance(a.value, float) and isinstance(b.value, float):
            from stepframe.functions.scalar import arithmetic

            return C.lit(arithmetic(op, a.value, b.value))
        return C.arithmetic(op, a, b)
    if tag == "call":
        if e[1] not in C.FUNCTIONS:
            raise KeyError(f"function {e[1].upper()} is unknown")
        try:
            return C.FUNCTIONS[e[1]](*(evaluate(x, env, arrays, lib) for x in e[2]))
        except NotImplementedError as x:
            raise Fallback(str(x)) from None
    x = evaluate(e[1], env, arrays, lib)
    if tag == "put":
        return Typed(C.put(x, e[2], lib.user_format(e[2]) if lib else None), "char")
    return informat_column(C.char(x), e[2], lib)


def informat_column(s: Column, informat: str, lib: Library | None) -> Typed:
    """A text read by an informat."""
    user = lib.user_informat(informat) if lib else None
    f = spec(informat)
    if user is None and f.char:
        t = F.trim(s)
        return Typed(F.substring(t, 1, f.width) if f.width else t, "char")
    if user is None and f.name in ("comma", "dollar", "comman", "dollarn"):
        return Typed(C.to_number(F.call_function("translate", s, F.lit(",$ "), F.lit(""))), "num")
    if user is not None:
        return Typed(C.read_user(s, user), "num")
    if f.name in ("mmddyy", "ddmmyy", "yymmdd"):
        return Typed(C.read_numeric_date(s, {"mm": "mdy", "dd": "dmy", "yy": "ymd"}[f.name[:2]]), "num")
    read = {"date": C.read_date, "time": C.read_time, "hhmmss": C.read_time, "datetime": C.read_datetime}.get(f.name, C.to_number)
    return Typed(read(s).cast("double"), "num")


def _subscript(name: str, k: float, members: list[str]) -> int:
    if not 1 <= int(k) <= len(members):
        raise IndexError(f"array {name}: subscript {k:g} out of range")
    return int(k)


class Symbolic:
    """Symbolic execution over one row of the source."""

    def __init__(self, plan: Plan, df: DataFrame, env: dict[str, Typed], in_place: bool = False):
        self.plan, self.df, self.env, self.in_place = plan, df, env, in_place
        self.alive: Column | None = None
        self.path: Column | None = None
        self.emitted: list[tuple[Column | None, list[str], dict[str, Typed]]] = []
        self.fresh: set[str] = set()
        self.resets: dict[str, tuple[Column, Typed]] = {}
        self.settled: set[str] = set()
        self.depth = 0

    def guard(self) -> Column | None:
        return self.path if self.alive is None else self.alive if self.path is None else self.alive & self.path

    def eval(self, e: Expr) -> Typed:
        for name in expression_vars(e):
            if name in self.plan.retained and name not in self.settled:
                raise Fallback(f"{name} is read before its new value is known")
            if name in self.fresh:
                raise Fallback(f"{name} is carried over by a loop")
        return evaluate(e, self.env, self.plan.arrays, self.plan.lib)

    def assign(self, name: str, v: Typed) -> None:
        low = name.lower()
        kind = self.plan.kinds.get(low, v.kind)
        col = (C.char(v) if kind == "char" else C.num(v)) if v.kind != kind else v.col
        self.fresh.discard(low)
        self.env[low] = Typed(col, kind, v.value if v.kind == kind else None)

    def run(self, stmts: list[Stmt]) -> None:
        for s in stmts:
            getattr(self, f"_{s.kind}", self._skip)(s)

    def _skip(self, s: Stmt) -> None:
        if s.kind in ("while", "until", "put", "input"):
            raise Fallback(s.kind)

    def _assign(self, s: Stmt) -> None:
        if s.target[0] == "var":
            low = s.target[1].lower()
            if low in self.plan.retained:
                self._retained_assign(low, s.value)
            else:
                self.assign(s.target[1], self.eval(s.value))
            return
        members = self.plan.arrays.get(s.target[1])
        if members is None:
            raise Fallback("array")
        k, v = self.eval(s.target[2]), self.eval(s.value)
        if isinstance(k.value, float):
            self.assign(members[_subscript(s.target[1], k.value, members) - 1], v)
            return
        n = C.num(k).cast("int")
        for i, m in enumerate(members):
            old = self.env[m]
            col = C.char(v) if old.kind == "char" else C.num(v)
            self.env[m] = Typed(F.when(n == i + 1, col).otherwise(old.col), old.kind)

    def _retained_assign(self, low: str, value: Expr) -> None:
        """A reset to a constant before the sum statement, or a value carried to later rows."""
        sums = any(s.kind == "sum" and s.name.lower() == low for s in self.plan.all)
        assigns = [s for s in self.plan.all if s.kind == "assign" and s.target == ("var", s.target[1]) and s.target[1].lower() == low]
        if low in self.settled or len(assigns) > 1:
            raise Fallback(f"{low} changes more than once")
        v = self.eval(value)
        g = self.guard()
        if sums:
            if not isinstance(v.value, float):
                raise Fallback(f"{low} is reset to something that is no constant")
            self.resets[low] = (F.lit(True) if g is None else g, v)
            return
        kind = self.plan.kinds.get(low, v.kind)
        col = C.char(v) if kind == "char" else C.num(v)
        init = next((i for s in self.plan.body if s.kind == "retain" for n, i in s.items if n.lower() == low), None)
        # PART stays, so that the step orders its rows once
        parts = ordered.ordered(self.df.withColumn(f"__c_{low}", F.when(F.lit(True) if g is None else g, F.struct(col.alias("v")))), self.in_place)
        self.df, self.in_place = ordered.carried(parts, f"__s_{low}", F.col(f"__c_{low}")).drop(f"__c_{low}"), False
        start = C.lit(init if init is not None else "" if kind == "char" else None)
        self.settled.add(low)
        self.env[low] = Typed(F.when(F.col(f"__s_{low}").isNotNull(), F.col(f"__s_{low}.v")).otherwise(start.col), kind)

    def _sum(self, s: Stmt) -> None:
        low = s.name.lower()
        if low in self.settled or self.depth:
            raise Fallback(f"{low} is summed more than once")
        x = F.coalesce(C.num(self.eval(s.value)), F.lit(0.0))
        g = self.guard()
        if g is not None:
            x = F.when(F.coalesce(g, F.lit(False)), x).otherwise(0.0)
        init = next((i for r in self.plan.body if r.kind == "retain" for n, i in r.items if n.lower() == low), None) or 0.0
        col = f"__s_{low}"
        if low in self.resets:
            reset, value = self.resets.pop(low)
            keys = [k for k, _ in self.plan.keys]
            first = f"first.{keys[-1].lower()}" if keys else None
            whole = self.plan.source is not None and tuple(k.lower() for k in keys) == self.plan.source.sorted_by[: len(keys)] and first in self.plan.flags and str(reset) == str(C.truth(self.env[first]))
            if whole:
                # sorted, reset at each group's first row: the group is the window partition
                w = Window.partitionBy(*(F.col(f"`{self.plan.source.var(k).name}`") for k in keys)).orderBy(ORD)
                self.df, self.in_place = self.df.withColumn(col, F.lit(value.value) + F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))), False
            else:
                parts = ordered.ordered(self.df.withColumns({"__r": F.coalesce(reset, F.lit(False)).cast("int"), "__x": x}), self.in_place)
                d, self.in_place = ordered.running(parts, {"__seg": F.col("__r").cast("double")}), False
                w = Window.partitionBy("__seg").orderBy(ORD).rowsBetween(Window.unboundedPreceding, 0)
                self.df = d.withColumn(col, F.when(F.col("__seg") == 0, init).otherwise(value.value) + F.sum("__x").over(w)).drop("__r", "__x", "__seg")
        else:
            parts = ordered.ordered(self.df.withColumn("__x", x), self.in_place)
            self.df, self.in_place = ordered.running(parts, {col: F.col("__x")}).withColumn(col, F.col(col) + float(init)).drop("__x"), False
        self.settled.add(low)
        self.env[low] = Typed(F.col(col), "num")

    def _subset(self, s: Stmt) -> None:
        c = C.truth(self.eval(s.cond))
        if self.path is not None:
            c = ~self.path | c
        self.alive = c if self.alive is None else self.alive & c

    def _if(self, s: Stmt) -> None:
        c = C.truth(self.eval(s.cond))
        before, path, settled = dict(self.env), self.path, set(self.settled)
        self.path = c if path is None else path & c
        self.run(s.then)
        then, self.env = self.env, dict(before)
        self.path = ~c if path is None else path & ~c
        self.run(s.other)
        other, self.path = self.env, path
        out = {}
        for name in dict.fromkeys([*then, *other]):
            a, b = then.get(name), other.get(name)
            if name in self.settled - settled:
                # its column holds for every row, whichever branch set it
                out[name] = a if a is not before.get(name) else b
            elif a is b:
                out[name] = a
            else:
                kind = (a or b).kind
                blank = C.lit("" if kind == "char" else None)
                out[name] = Typed(F.when(c, (a or blank).col).otherwise((b or blank).col), kind)
        self.env = out

    def _block(self, s: Stmt) -> None:
        self.run(s.body)

    def _loop(self, s: Stmt) -> None:
        first, last = self.eval(s.first), self.eval(s.last)
        step = self.eval(s.step) if s.step else C.lit(1.0)
        values = [x.value for x in (first, last, step)]
        if not all(isinstance(v, float) for v in values):
            raise Fallback("loop bounds are not constant")
        a, b, by = values
        count = int((b - a) / by) + 1 if by and (b - a) / by >= 0 else 0
        if count > UNROLL:
            raise Fallback(f"{count} iterations")
        self.depth += 1
        k = a
        for _ in range(count):
            self.assign(s.name, C.lit(k))
            self.run(s.body)
            k += by
        self.assign(s.name, C.lit(k if by else a))
        self.depth -= 1

    def _output(self, s: Stmt) -> None:
        self.emitted.append((self.guard(), s.names, dict(self.env)))

    def finish(self) -> None:
        if not self.plan.explicit:
            self.emitted.append((self.alive, [], dict(self.env)))


def prepare(step: DataStep, lib: Library) -> Plan:
    plan = Plan(step, lib)
    sets = [s for s in plan.body if s.kind == "set"]
    merge = next((s for s in plan.body if s.kind == "merge"), None)
    for s in plan.all:
        if s.kind == "array":
            for x in s.elements:
                plan.pdv.setdefault(x.lower(), x)
                if s.char:
                    plan.kinds[x.lower()] = "char"
    for s in plan.all:
        if s.kind == "retain":
            for n, init in s.items:
                plan.pdv.setdefault(n.lower(), n)
                if isinstance(init, str):
                    plan.kinds[n.lower()] = "char"
        elif s.kind == "sum":
            plan.declare(s.name, "num")
    if merge:
        tables = [read_ref(r, lib) for r in merge.refs]
        plan.source = ops.merge(tables, [k for k, _ in plan.keys], [r.flag for r in merge.refs])
        for k, r in enumerate(merge.refs):
            if r.flag:
                plan.flags[r.flag.lower()] = f"__in_{k}"
    elif sets:
        plan.source = ops.concatenate([read_ref(r, lib) for s in sets for r in s.refs])
    elif any(s.kind == "input" for s in plan.all):
        path = plan.infile.get("path")
        if path and str(path).lower() not in ("datalines", "cards"):
            plan.lines = L.read_lines(lib.spark, path, plan.infile.get("firstobs"), plan.infile.get("obs"))
        else:
            plan.lines = L.inline_lines(lib.spark, step.lines or [])
    if plan.source is not None:
        for v in plan.source.vars:
            plan.kinds[v.name.lower()] = v.kind
            plan.pdv.setdefault(v.name.lower(), v.name)
        conds = [s.cond for s in plan.body if s.kind == "where"]
        for c in conds:
            plan.source = where(plan.source, c, lib)
    for s in plan.all:
        if s.kind == "input":
            for i in s.items:
                if i[0] == "var":
                    o = i[2]
                    char = o.get("char") or (o.get("informat") or "").startswith("$")
                    plan.declare(i[1], "char" if char else "num")
        elif s.kind == "assign":
            name = s.target[1] if s.target[0] == "var" else None
            if name:
                plan.declare(name, kind_of(s.value, plan.kinds, plan.arrays))
        elif s.kind == "loop":
            plan.declare(s.name, "num")
    for name in plan.pdv:
        plan.kinds.setdefault(name, "num")
    end = plan.infile.get("end")
    plan.auto = {"_n_", "_error_"} | ({str(end).lower()} if end else set()) | set(plan.flags)
    return plan


def by_flags(plan: Plan) -> None:
    """first. and last. as columns of the source, if the step reads them."""
    wanted = [v for v in plan.used if v.startswith(("first.", "last."))]
    if not wanted or plan.source is None:
        return
    t, keys = plan.source, [plan.source.var(k).name for k, _ in plan.keys]
    if any(s.kind == "merge" for s in plan.body):
        # one flag for the whole key
        t.df = t.df.withColumns(dict(zip(("__first", "__last"), ordered.ends(keys), strict=True)))
        t.in_place = False
        for k in keys:
            plan.flags |= {f"first.{k.lower()}": "__first", f"last.{k.lower()}": "__last"}
        return
    whole = tuple(k.lower() for k in keys) == t.sorted_by[: len(keys)]
    t.df = ordered.sorted_flags(t.df, keys) if whole else ordered.flags(ordered.ordered(t.df, t.in_place), keys)
    t.in_place = False
    for k in keys:
        plan.flags |= {f"{side}.{k.lower()}": f"{side}.{k.lower()}" for side in ("first", "last")}


def flag_env(plan: Plan) -> dict[str, Typed]:
    return {name: Typed(F.col(f"`{col}`").cast("double"), "num") for name, col in plan.flags.items()}


def symbolic_input(plan: Plan) -> tuple[DataFrame, dict[str, Typed], list[Stmt]]:
    """A single plain INPUT of fields, columns or informats as Columns of the line."""
    inputs = [s for s in plan.all if s.kind == "input"]
    if len(inputs) != 1 or inputs[0] not in plan.body or inputs[0].hold or plan.infile.get("lrecl") or plan.infile.get("end"):
        raise Fallback("input")
    s = inputs[0]
    if any(i[0] != "var" for i in s.items) or plan.body.index(s) > min([plan.body.index(x) for x in plan.body if x.kind in ("assign", "if", "subset", "output", "loop", "sum")], default=1 << 30):
        raise Fallback("input")
    line, env, k = F.col("value"), {}, 0
    listed = L.line_fields(line, plan.infile.get("dlm"), bool(plan.infile.get("dsd")), sum("columns" not in i[2] for i in s.items))
    for _, name, o in s.items:
        if "columns" in o:
            a, b = o["columns"]
            raw = F.substring(line, a, b - a + 1)
        else:
            raw = F.coalesce(F.get(listed, F.lit(k)), F.lit(""))
            k += 1
        kind = plan.kinds[name.lower()]
        if o.get("informat"):
            v = informat_column(raw, o["informat"], plan.lib)
        elif kind == "char":
            v = Typed(F.rtrim(raw) if "columns" in o else F.trim(raw), "char")
        else:
            v = Typed(C.to_number(raw), "num")
        if v.kind != kind:
            raise Fallback("informat")
        env[name.lower()] = v
    return plan.lines, env, [x for x in plan.body if x is not s]


def generator(plan: Plan) -> tuple[DataFrame, dict[str, Typed], list[Stmt]]:
    """A step without source: one row, or, if it is one long loop with OUTPUT, a range."""
    spark = plan.lib.spark
    real = [s for s in plan.body if s.kind not in ("keep", "drop", "format", "label", "rename", "array", "nothing")]
    if len(real) == 1 and real[0].kind == "loop" and plan.explicit:
        s = real[0]
        bounds = [evaluate(e, {}, {}, plan.lib).value if e else 1.0 for e in (s.first, s.last, s.step)]
        if all(isinstance(b, float) for b in bounds) and bounds[2]:
            a, b, by = bounds
            count = max(0, int((b - a) / by) + 1)
            if count > UNROLL:
                plan.ranged = s
                df = spark.range(count).select((F.lit(a) + F.col("id") * by).alias("__i"), F.col("id").alias(ORD))
                return df, {s.name.lower(): Typed(F.col("__i"), "num")}, s.body
    return spark.range(1).select(F.col("id").alias(ORD)), {}, plan.body


def compile_symbolic(plan: Plan) -> dict[str, Table]:
    in_place = True
    if plan.source is not None:
        by_flags(plan)
        df, body, in_place = plan.source.df, plan.body, plan.source.in_place
        env = {v.name.lower(): Typed(F.col(f"`{v.name}`"), v.kind) for v in plan.source.vars} | flag_env(plan)
    elif plan.lines is not None:
        df, env, body = symbolic_input(plan)
    else:
        df, env, body = generator(plan)
    if "_n_" in plan.used:
        df, in_place = ordered.number(ordered.ordered(df, in_place), "__n"), False
        env["_n_"] = Typed(F.col("__n"), "num")
    env["_error_"] = C.lit(0.0)
    for name in plan.pdv:
        env.setdefault(name, C.lit("" if plan.kinds[name] == "char" else None))
    run = Symbolic(plan, df, env, in_place)
    if getattr(plan, "ranged", None) is not None:
        run.fresh = {s.target[1].lower() for s in walk(body) if s.kind == "assign" and s.target[0] == "var"}
    source_names = {v.name.lower() for v in plan.source.vars} if plan.source else set()
    for name in plan.retained & source_names:
        raise Fallback(f"{name} is retained and read")
    run.run(body)
    run.finish()
    for name in plan.retained - run.settled:
        # retained but never summed or carried: its initial value
        init = next((i for s in plan.body if s.kind == "retain" for n, i in s.items if n.lower() == name), None)
        if any(s.kind in ("sum",) and s.name.lower() == name for s in plan.all) or name in run.resets:
            raise Fallback(name)
        v = C.lit(init if init is not None else "" if plan.kinds.get(name) == "char" else None)
        for _, _, snap in run.emitted:
            snap[name] = v
    return build(plan, run.df, run.emitted, in_place and run.df is df)


def out_vars(plan: Plan) -> list[Var]:
    formats = {n.lower(): f for s in plan.all if s.kind == "format" for n, f in s.pairs}
    labels = {n.lower(): x for s in plan.all if s.kind == "label" for n, x in s.pairs}
    inherited = {v.name.lower(): v for v in plan.source.vars} if plan.source else {}
    out = []
    for low, name in plan.pdv.items():
        if low in plan.auto or low.startswith(("first.", "last.")):
            continue
        old = inherited.get(low)
        out.append(Var(name, plan.kinds[low], formats.get(low, old.format if old else None), labels.get(low, old.label if old else None)))
    return out


def shaped(plan: Plan, table: Table, ref: Ref) -> Table:
    """KEEP, DROP and RENAME statements, then the options of the output."""
    keep = [n for s in plan.all if s.kind == "keep" for n in s.names]
    drop = [n for s in plan.all if s.kind == "drop" for n in s.names]
    rename = [p for s in plan.all if s.kind == "rename" for p in s.pairs]
    t = ops.select(table, keep, drop, rename)
    if ref.where is not None:
        t = where(t, ref.where, plan.lib)
    return ops.select(t, ref.keep, ref.drop, ref.rename) if ref.keep or ref.drop or ref.rename else t


def build(plan: Plan, df: DataFrame, emitted: list, in_place: bool) -> dict[str, Table]:
    vars_, out = out_vars(plan), {}
    for ref in plan.step.outputs:
        if ref.name.lower() == "_null_":
            continue
        own = [(g, snap) for g, names, snap in emitted if not names or ref.full in names or ref.name.lower() in names]
        sorted_by = plan.source.sorted_by if plan.source else ()
        if not own:
            t = Table(df.where(F.lit(False)).select(*(snap_col(v, None).alias(v.name) for v in vars_), ORD), vars_)
        elif len(own) == 1:
            g, snap = own[0]
            d = df if g is None else df.where(F.coalesce(g, F.lit(False)))
            changed = {v.name.lower() for v in vars_ if str(snap[v.name.lower()].col) != f"Column<'{v.name}'>"}
            keep = () if changed & set(sorted_by) else sorted_by
            t = Table(d.select(*(snap_col(v, snap).alias(v.name) for v in vars_), ORD), vars_, keep, in_place)
        else:
            each = [F.struct(F.coalesce(g, F.lit(False)).alias("__g") if g is not None else F.lit(True).alias("__g"), *(snap_col(v, snap).alias(v.name) for v in vars_)) for g, snap in own]
            d = df if in_place else df.orderBy(ORD)
            d = d.select(F.explode(F.filter(F.array(*each), lambda x: x["__g"])).alias("__e"))
            t = Table(d.select(*(F.col(f"__e.`{v.name}`").alias(v.name) for v in vars_), F.monotonically_increasing_id().alias(ORD)), vars_, (), True)
        out[ref.full] = shaped(plan, t, ref)
    return out


def snap_col(v: Var, snap: dict[str, Typed] | None) -> Column:
    t = (snap or {}).get(v.name.lower())
    if t is None:
        return F.lit("") if v.kind == "char" else F.lit(None).cast("double")
    return t.col if t.kind == v.kind else C.char(t) if v.kind == "char" else C.num(t)


# --- the interpreter


def stateful(plan: Plan) -> bool:
    """Whether a row depends on rows before it."""
    holds = any(s.kind in ("input", "put") and s.hold for s in plan.all) or any(i[0] == "line" for s in plan.all if s.kind == "input" for i in s.items)
    return bool(plan.retained or holds or "_n_" in plan.used or plan.infile.get("end"))


def resets_by_group(plan: Plan) -> bool:
    """Whether every retained variable is set under an IF first.<key> before anything else reads or changes it."""
    if plan.source is None or not plan.keys:
        return False
    keys = [k.lower() for k, _ in plan.keys]
    if tuple(keys) != plan.source.sorted_by[: len(keys)] or any(s.kind in ("put", "file") for s in plan.all) or "_n_" in plan.used:
        return False
    seen: set[str] = set()
    for s in plan.body:
        if s.kind == "if" and s.cond[0] == "var" and s.cond[1].lower().startswith("first.") and not s.other:
            seen |= {x.target[1].lower() for x in walk(s.then) if x.kind == "assign" and x.target[0] == "var"}
        elif s.kind in ("assign", "sum", "if", "block", "loop", "while", "until", "output", "subset"):
            break
    return plan.retained <= seen


def interpret(plan: Plan) -> tuple[dict[str, Table], DataFrame | None]:
    """The step by the interpreter; also the lines that PUT wrote, in order."""
    by_flags(plan)
    vars_ = out_vars(plan)
    names = [r.full for r in plan.step.outputs if r.name.lower() != "_null_"]
    formats = {n: f for n, f in plan.lib.formats.items()}
    informats = {n: f for n, f in plan.lib.informats.items()}
    body, kinds, explicit = plan.body, dict(plan.kinds), plan.explicit
    puts = any(s.kind == "put" for s in plan.all)

    def fresh() -> Interpreter:
        return Interpreter(body, dict(kinds), formats, informats, names, explicit)

    def frame(it: Interpreter) -> pd.DataFrame:
        rows = [("", x, *([None] * len(vars_))) for x in it.put_lines]
        for target, row in it.rows:
            full = next((n for n in names if n in (target, f"work.{target}")), target)
            rows.append((full, None, *(row.get(v.name.lower(), "" if v.kind == "char" else None) for v in vars_)))
        it.rows, it.put_lines = [], []
        out = pd.DataFrame(rows, columns=["__out", "__line", *(f"v{k}" for k in range(len(vars_)))])
        for k, v in enumerate(vars_):
            if v.kind == "num":
                out[f"v{k}"] = out[f"v{k}"].astype("float64")
        return out

    schema = "__out string, __line string" + "".join(f", v{k} {'double' if v.kind == 'num' else 'string'}" for k, v in enumerate(vars_))
    many = stateful(plan)
    if plan.lines is not None:

        def over_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            it = fresh()
            for _ in it.over_lines(x for b in batches for x in b["value"]):
                yield frame(it)
            yield frame(it)

        d = plan.lines.orderBy(ORD)
        d = d.coalesce(1) if many else d
        d = d.select("value").mapInPandas(over_lines, schema)
    else:
        source = plan.source or Table(plan.lib.spark.range(1).select(F.col("id").alias(ORD)), [], (), True)
        inner = [(v.name.lower(), v.kind) for v in source.vars]
        autos = list(plan.flags.items())
        cols = [F.col(f"`{v.name}`").alias(f"c{k}") for k, v in enumerate(source.vars)] + [F.col(f"`{c}`").cast("double").alias(f"a{k}") for k, (_, c) in enumerate(autos)]

        def rows_of(pdf: pd.DataFrame) -> tuple[list[dict], list[dict]]:
            values = []
            for k, (name, kind) in enumerate(inner):
                c = pdf[f"c{k}"]
                values.append((name, c.tolist() if kind == "char" else [None if x != x or x is None else float(x) for x in c]))
            flags = [(name, pdf[f"a{k}"].tolist()) for k, (name, _) in enumerate(autos)]
            n = len(pdf)
            return [{name: v[i] for name, v in values} for i in range(n)], [{name: v[i] for name, v in flags} for i in range(n)]

        def over_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            it = fresh()
            for b in batches:
                rows, flags = rows_of(b)
                for row, auto in zip(rows, flags, strict=True):
                    it.auto.update(auto)
                    it.iterate(lambda row=row: it.state.update(row))
                yield frame(it)
            it.flush_put(end=True)
            yield frame(it)

        if many and resets_by_group(plan):
            keys = [f"`{source.var(k).name}`" for k, _ in plan.keys]

            def over_group(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values(ORD, kind="stable")
                out = next(over_rows(iter([pdf])))
                out["__src"], out["__k"] = pdf[ORD].iloc[0], range(len(out))
                return out

            d = source.df.select(*(F.col(k).alias(f"g{i}") for i, k in enumerate(keys)), *cols, ORD).groupBy(*(f"g{i}" for i in range(len(keys)))).applyInPandas(over_group, schema + ", __src long, __k long").orderBy("__src", "__k")
        else:
            d = source.df if source.in_place and not many else source.df.orderBy(ORD)
            if many:
                log.warning("NOTE: rows depend on all rows before them; the step runs in one ordered partition")
                d = d.coalesce(1)
            d = (d.select(*cols) if cols else d.select(F.lit(0).alias("x"))).mapInPandas(over_rows, schema)
    d = d.withColumn(ORD, F.monotonically_increasing_id())
    if len(names) + puts > 1:
        d = materialise(d)
    out = {}
    for ref in plan.step.outputs:
        if ref.name.lower() != "_null_":
            own = d.where(F.col("__out") == ref.full)
            cols = [(F.coalesce(f"v{k}", F.lit("")) if v.kind == "char" else F.when(~F.isnan(f"v{k}"), F.col(f"v{k}"))).alias(v.name) for k, v in enumerate(vars_)]
            out[ref.full] = shaped(plan, Table(own.select(*cols, ORD), vars_, (), True), ref)
    return out, d.where(F.col("__line").isNotNull()).select(F.col("__line").alias("value"), ORD) if puts else None


def run_step(step: DataStep, lib: Library, force_interpreter: bool = False) -> dict[str, Table]:
    """Plans the step, stores its outputs in the library and writes its file, if it has one."""
    plan = prepare(step, lib)
    lines = None
    try:
        if force_interpreter:
            raise Fallback("asked for")
        out = compile_symbolic(plan)
    except Fallback as why:
        log.info("step by interpreter: %s", why)
        plan = prepare(step, lib)
        out, lines = interpret(plan)
    file = next((s.parts for s in plan.body if s.kind == "file"), None)
    if file and str(file["path"]).lower() not in ("print", "log"):
        L.write_lines(lines if lines is not None else lib.spark.createDataFrame([], f"value string, {ORD} long"), file["path"], bool(file.get("mod")))
    for ref in step.outputs:
        if ref.full in out:
            if any(getattr(lib.librefs.get(r.lib.lower()), "changing", False) for s in plan.all if s.kind in ("set", "merge") for r in s.refs):
                out[ref.full] = replace(out[ref.full], df=materialise(out[ref.full].df), in_place=False)
            lib.put(ref.lib, ref.name, out[ref.full])
    return out
