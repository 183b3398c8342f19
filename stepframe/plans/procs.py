"""PROC steps on the library."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stepframe.frame import ORD, Library, Table, Var, from_dataframe
from stepframe.functions import columns as C
from stepframe.functions.texts import Range, UserFormat, general, show, spec
from stepframe.lang.parser import ProcStep, Ref, Stmt
from stepframe.lang.sqltext import to_spark_sql, with_tables
from stepframe.operators import proof, stats
from stepframe.operators import tables as ops
from stepframe.plans.step import read_ref
from stepframe.shared import materialise
from stepframe.sources import files

log = logging.getLogger("stepframe")


class Listing(list):
    """Printed lines of a session; html: its printed tables, if they are kept."""

    html: list[str] | None = None


Proc = Callable[[ProcStep, Library, Listing], None]
PROCS: dict[str, Proc] = {}


def register_proc(*names: str) -> Callable[[Proc], Proc]:
    """Adds a PROC of one's own: f(step, library, listing)."""

    def add(f: Proc) -> Proc:
        for n in names:
            PROCS[n] = f
        return f

    return add


def parts(step: ProcStep, kind: str) -> list[Stmt]:
    return [s for s in step.body if s.kind == kind]


def names_of(step: ProcStep, kind: str) -> list[str]:
    return [n for s in parts(step, kind) for n in s.names]


def data_of(step: ProcStep, lib: Library, key: str = "data") -> Table:
    ref = step.options.get(key)
    t = read_ref(ref, lib) if ref is not None else lib.tables[next(reversed(lib.tables))]
    for s in parts(step, "where"):
        from stepframe.plans.step import where

        t = where(t, s.cond, lib)
    return t


def shown_by(step: ProcStep, table: Table, lib: Library) -> Callable[[Var], object]:
    """How grouping variables are shown: by the step's FORMAT, else the variable's user format, else as they are."""
    own = {n.lower(): f for s in parts(step, "format") for n, f in s.pairs}

    def shown(v: Var):
        fmt = own.get(v.name.lower(), v.format)
        c = F.col(f"`{v.name}`")
        if not fmt:
            return c
        user = lib.user_format(fmt)
        if user is None and v.name.lower() not in own:
            return c
        return C.put(C.Typed(c, v.kind), fmt, user)

    return shown


def labelled(table: Table, groups: list[Var], step: ProcStep, lib: Library) -> Table:
    """The table with formatted group values as text, for output datasets of formatted groups."""
    own = {n.lower(): f for s in parts(step, "format") for n, f in s.pairs}
    cols, vars_ = [], []
    for v in table.vars:
        fmt = own.get(v.name.lower(), v.format)
        user = lib.user_format(fmt) if fmt else None
        if v.name.lower() in {g.name.lower() for g in groups} and user is not None:
            cols.append(C.put(C.Typed(F.col(f"`{v.name}`"), v.kind), fmt, user).alias(v.name))
            vars_.append(Var(v.name, "char"))
        else:
            cols.append(F.col(f"`{v.name}`"))
            vars_.append(v)
    return Table(table.df.select(*cols, ORD), vars_, (), table.in_place)


@register_proc("sort")
def proc_sort(step: ProcStep, lib: Library, out: Listing) -> None:
    keys = [k for s in parts(step, "by") for k in s.keys]
    t = ops.sort(data_of(step, lib), keys, "nodupkey" in step.options)
    target: Ref = step.options.get("out") or step.options["data"]
    lib.put(target.lib, target.name, t)


@register_proc("append")
def proc_append(step: ProcStep, lib: Library, out: Listing) -> None:
    base: Ref = step.options.get("base") or step.options.get("out")
    data = data_of(step, lib)
    if base.lib and base.lib.lower() != "work":
        backend = lib.librefs[base.lib.lower()]
        if backend.has(base.name.lower()):
            old = backend.read(base.name.lower())
            backend.append(base.name.lower(), Table(data.df.select(*ops.conform(data, old.vars), ORD), old.vars))
        else:
            backend.write(base.name.lower(), data)
    elif not lib.has("", base.name):
        lib.put("", base.name, data)
    else:
        lib.put("", base.name, ops.append(lib.get("", base.name), data, "force" in step.options))


@register_proc("means", "summary")
def proc_means(step: ProcStep, lib: Library, out: Listing) -> None:
    t = data_of(step, lib)
    classes = names_of(step, "class") + [k for s in parts(step, "by") for k, _ in s.keys]
    vars_ = names_of(step, "var") or [v.name for v in t.vars if v.kind == "num" and v.name.lower() not in {c.lower() for c in classes}]
    shown = shown_by(step, t, lib)
    for s in parts(step, "output"):
        if s.out:
            lib_name, _, name = s.out.rpartition(".")
            lib.put(lib_name, name, stats.means_out(t, vars_, classes, s.stats, shown))
    if "noprint" not in step.options and step.name == "means":
        chosen = tuple(k for k in step.options if k in stats.STATS) or stats.DEFAULT
        digits = step.options.get("maxdec")
        listing = stats.means_listing(t, vars_, classes, chosen, shown)
        print_table(listing, lib, out, obs=False, fmt={v.name: f"12.{digits}" for v in listing.vars if v.kind == "num" and v.name != "N"} if digits else {})


@register_proc("freq")
def proc_freq(step: ProcStep, lib: Library, out: Listing) -> None:
    t = data_of(step, lib)
    shown = shown_by(step, t, lib)
    for s in parts(step, "tables"):
        for names in s.requests:
            if s.out:
                lib_name, _, name = s.out.rpartition(".")
                got = stats.freq_out(t, names, shown)
                lib.put(lib_name, name, labelled(got, got.vars[: len(names)], step, lib))
            two = len(names) >= 2 and "list" not in s.options
            listing = stats.crosstab(t, *names[:2], shown) if two else stats.freq_list(t, names, shown)
            hide = {"nofreq": "Frequency", "nopercent": "Percent", "norow": "RowPercent", "nocol": "ColPercent"}
            gone = {v for k, v in hide.items() if k in s.options} | ({"CumFreq", "CumPercent"} if "nocum" in s.options else set())
            if "noprint" not in s.options and "noprint" not in step.options:
                print_table(ops.select(listing, drop=list(gone)), lib, out, obs=False)
            if "chisq" in s.options and len(names) >= 2:
                stat, df, p = stats.chi_square(t, *names[:2], shown)
                out.append(f"Chi-Square  DF {df}  Value {stat:.4f}  Prob {p:.4f}")


@register_proc("reg", "glm")
def proc_reg(step: ProcStep, lib: Library, out: Listing) -> None:
    t = data_of(step, lib)
    for s in parts(step, "model"):
        table, fit = stats.least_squares(t, s.y, s.xs, names_of(step, "class"))
        target: Ref | None = step.options.get("out") or step.options.get("outest")
        if isinstance(target, str):
            target = Ref(target)
        if target is not None:
            lib.put(target.lib, target.name, table)
        print_table(table, lib, out, obs=False)
        out.append(f"R-Square {fit['rsquare']:.4f}  Root MSE {fit['rmse']:.4f}  N {fit['n']:.0f}")


@register_proc("format")
def proc_format(step: ProcStep, lib: Library, out: Listing) -> None:
    if isinstance(step.options.get("cntlin"), Ref):
        read_control(read_ref(step.options["cntlin"], lib), lib)
    for s in step.body:
        if s.kind in ("value", "picture"):
            lib.formats[s.name] = UserFormat(s.name, s.ranges, s.kind)
        elif s.kind == "invalue":
            lib.informats[s.name] = UserFormat(s.name, s.ranges, "invalue")
    target = step.options.get("cntlout")
    if isinstance(target, Ref):
        lib.put(target.lib, target.name, control_table(lib))


CONTROL = ("FMTNAME", "START", "END", "LABEL", "TYPE", "HLO", "SEXCL", "EEXCL")


def control_table(lib: Library) -> Table:
    """All VALUE formats as rows, by name."""
    rows = []
    for name in sorted(lib.formats):
        f = lib.formats[name]
        if f.kind != "value":
            continue
        for r in f.ranges:
            text = lambda x: "" if x is None else x if isinstance(x, str) else general(x)
            hlo = "O" if r.other else ("L" if r.low is None else "") + ("H" if r.high is None else "")
            rows.append((name.lstrip("$").upper(), text(r.low), text(r.high), str(r.label), "C" if name.startswith("$") else "N", hlo, "Y" if r.low_open else "N", "Y" if r.high_open else "N"))
    df = lib.spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], ", ".join(f"{c} string" for c in CONTROL) + f", {ORD} long")
    return Table(df, [Var(c, "char") for c in CONTROL], (), True)


def read_control(table: Table, lib: Library) -> None:
    """Formats from a control dataset; a format catalogue is small, so its rows are collected."""
    at = {v.name.upper(): k for k, v in enumerate(table.vars)}
    found: dict[str, list[Range]] = {}
    for row in table.rows():
        get = lambda c: (row[at[c]] if c in at and row[at[c]] is not None else "")  # noqa: B023, E731
        char = str(get("TYPE")).upper() == "C"
        name = ("$" if char else "") + str(get("FMTNAME")).lower().lstrip("$")
        hlo = str(get("HLO")).upper()
        point = lambda x: x if char else None if x in ("", ".") else float(x)  # noqa: B023, E731
        start, end = get("START"), get("END")
        end = start if end == "" and "H" not in hlo else end
        low, high = (None if "L" in hlo else point(start)), (None if "H" in hlo else point(end))
        found.setdefault(name, []).append(Range(low, high, str(get("LABEL")), get("SEXCL") == "Y", get("EEXCL") == "Y", "O" in hlo))
    for name, ranges in found.items():
        lib.formats[name] = UserFormat(name, ranges)


def print_table(table: Table, lib: Library, out: Listing, names: list[str] | None = None, obs: bool = True, labels: dict[str, str] | None = None, fmt: dict[str, str] | None = None, limit: int | None = None) -> None:
    """A listing; values in their formats, titles above, footnotes below."""
    vars_ = [table.var(n) for n in names] if names else table.vars
    fmt = {k.lower(): v for k, v in (fmt or {}).items()}
    rows = Table(table.df, vars_).rows(limit)

    def text(v: Var, x) -> str:
        f = fmt.get(v.name.lower(), v.format)
        user = lib.user_format(f) if f else None
        got = user.show(x) if user else None
        return got if got is not None else show(x, spec(f) if f and not user else None)

    head = [(labels or {}).get(v.name.lower(), v.name) for v in vars_]
    body = [[text(v, x) for v, x in zip(vars_, r, strict=True)] for r in rows]
    if obs:
        head, body = ["Obs", *head], [[str(k), *r] for k, r in enumerate(body, 1)]
    width = [max([len(h), *(len(r[k]) for r in body)]) for k, h in enumerate(head)]
    kinds = (["num"] if obs else []) + [v.kind for v in vars_]
    line = lambda cells: "  ".join(c.rjust(w) if k == "num" else c.ljust(w) for c, w, k in zip(cells, width, kinds, strict=True)).rstrip()
    out += [lib.titles["title"][k] for k in sorted(lib.titles["title"])]
    out += [line(head), *map(line, body)]
    out += [lib.titles["footnote"][k] for k in sorted(lib.titles["footnote"])]


def html_table(table: Table, lib: Library, limit: int | None = None) -> str:
    """The same listing as an HTML table."""
    from html import escape

    rows = table.rows(limit)
    head = "".join(f"<th>{escape(v.label or v.name)}</th>" for v in table.vars)
    body = "".join("<tr>" + "".join(f'<td{" class=num" if v.kind == "num" else ""}>{escape(show(x, spec(v.format) if v.format and not lib.user_format(v.format) else None))}</td>' for v, x in zip(table.vars, r, strict=True)) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


@register_proc("print")
def proc_print(step: ProcStep, lib: Library, out: Listing) -> None:
    t = data_of(step, lib)
    labels = {n.lower(): x for s in parts(step, "label") for n, x in s.pairs} | ({v.name.lower(): v.label for v in t.vars if v.label} if "label" in step.options else {})
    own = {n: f for s in parts(step, "format") for n, f in s.pairs}
    if out.html is not None:
        shown = [t.var(n) for n in names_of(step, "var")] or t.vars
        out.html.append(html_table(Table(t.df, shown), lib))
    print_table(t, lib, out, names_of(step, "var") or None, "noobs" not in step.options, labels if "label" in step.options or labels else None, own)


def _dbms(step: ProcStep, path: str) -> str:
    return str(step.options.get("dbms") or path.rsplit(".", 1)[-1]).lower()


def _delimiter(step: ProcStep, dbms: str) -> str:
    given = next((s.value for s in parts(step, "delimiter")), None)
    return "\t" if dbms == "tab" or given in ("09x", "tab") else given or ("," if dbms == "csv" else " ")


@register_proc("import")
def proc_import(step: ProcStep, lib: Library, out: Listing) -> None:
    path = step.options.get("datafile") or step.options.get("file")
    dbms = _dbms(step, path)
    names = next((s.value for s in parts(step, "getnames")), "yes").lower() != "no"
    row = next((int(s.value) for s in parts(step, "datarow")), None)
    t = files.import_sheet(lib.spark, path, names, row) if dbms == "xlsx" else files.import_delimited(lib.spark, path, _delimiter(step, dbms), names, row)
    lib.put("", step.options["out"].name, t)


@register_proc("export")
def proc_export(step: ProcStep, lib: Library, out: Listing) -> None:
    path = step.options.get("outfile") or step.options.get("file")
    dbms = _dbms(step, path)
    names = next((s.value for s in parts(step, "putnames")), "yes").lower() != "no"
    t = data_of(step, lib)
    if dbms == "xlsx":
        files.export_sheet(t, path, names)
    else:
        files.export_delimited(t, path, _delimiter(step, dbms), names)


@register_proc("proof")
def proc_proof(step: ProcStep, lib: Library, out: Listing) -> None:
    t = data_of(step, lib)
    severity = str(step.options.get("severity") or "error").lower()
    verdicts, bad = proof.prove(t, parts(step, "check"), lib, severity, int(step.options.get("maxsample") or 20))
    out += proof.report(verdicts).split("\n")
    for v in verdicts:
        if v.state == "FAIL":
            (log.error if v.severity.startswith("error") else log.warning)("%s: %s violations", v.message or v.description, v.violations)
    target = step.options.get("out")
    if isinstance(target, Ref):
        lib.put(target.lib, target.name, bad)


# --- SQL


def statements(text: str) -> list[str]:
    """Cut at semicolons outside quotes."""
    return [m.strip() for m in re.findall(r"""(?:'(?:[^']|'')*'|"(?:[^"]|"")*"|[^;'"])+""", text) if m.strip()]


def run_sql(query: str, lib: Library, connections: dict[str, str]) -> Table:
    """A SELECT over WORK tables, librefs and pass-through queries; each becomes a temporary view."""
    made: list[str] = []

    def view(table: Table) -> str:
        name = f"__sf_{len(made)}_{id(table):x}"
        table.data().createOrReplaceTempView(name)
        made.append(name)
        return name

    known: dict[str, str] = {}
    changing: list[bool] = []

    def table(full: str) -> str | None:
        lib_name, _, name = full.rpartition(".")
        if not lib.has(lib_name, name):
            return None
        if full not in known:
            known[full] = view(lib.get(lib_name, name))
            changing.append(getattr(lib.librefs.get(lib_name), "changing", False))
        return known[full]

    def passed(connection: str, text: str) -> str:
        source = backend(connection, lib, connections)
        changing.append(getattr(source, "changing", False))
        return view(source.query(text))

    query = with_tables(query, table, passed)
    try:
        t = from_dataframe(_select(to_spark_sql(query), lib))
        return replace(t, df=materialise(t.df), in_place=False) if any(changing) else t
    finally:
        for name in made:
            lib.spark.catalog.dropTempView(name)


def _select(sql: str, lib: Library):
    """The query; bare columns beside GROUP BY, which are any value of the group, are wrapped where Spark names them."""
    for _ in range(20):
        try:
            return lib.spark.sql(sql)
        except AnalysisException as x:
            m = re.search(r'MISSING_AGGREGATION.*?"([\w.]+)"', str(x), re.S)
            head = re.match(r"\s*select\s+(?:distinct\s+)?", sql, re.I)
            stop = re.search(r"\bfrom\b", sql, re.I)
            if not m or not head or not stop:
                raise
            name = m[1].rsplit(".", 1)[-1]
            item = re.compile(rf"(?<=[\s,])((?:\w+\.)?{name})(\s+(?:as\s+)?\w+)?(?=\s*(?:,|$))", re.I)
            items = item.sub(lambda g: f"any_value({g[1]})" + (g[2] or f" as {name}"), f" {sql[head.end() : stop.start()].strip()}", count=1)  # noqa: B023
            if "any_value" not in items or sql[: head.end()] + items.strip() + " " + sql[stop.start() :] == sql:
                raise
            sql = sql[: head.end()] + items.strip() + " " + sql[stop.start() :]
    return lib.spark.sql(sql)


def backend(name: str, lib: Library, connections: dict[str, str]):
    return lib.librefs[connections.get(name.lower(), name.lower())]


@register_proc("sql")
def proc_sql(step: ProcStep, lib: Library, out: Listing) -> None:
    connections: dict[str, str] = {}
    for text in statements(step.text):
        low = text.lower()
        m = re.match(r"create\s+table\s+(?:(\w+)\.)?(\w+)\s+as\s+(.*)$", text, re.I | re.S)
        if m:
            if not m[1] and lib.has("", m[2]):
                raise ValueError(f"table {m[2]} exists already")
            lib.put(m[1] or "", m[2], run_sql(m[3], lib, connections))
        elif low.startswith(("select", "with", "(")):
            print_table(run_sql(text, lib, connections), lib, out, obs=False)
        elif m := re.match(r"connect\s+to\s+(\w+)(?:\s+as\s+(\w+))?", text, re.I):
            connections[(m[2] or m[1]).lower()] = m[1].lower()
        elif m := re.match(r"disconnect\s+from\s+(\w+)", text, re.I):
            connections.pop(m[1].lower(), None)
        elif m := re.match(r"execute\s*\((.*)\)\s*by\s+(\w+)$", text, re.I | re.S):
            backend(m[2], lib, connections).execute(m[1])
        elif m := re.match(r"drop\s+table\s+(?:(\w+)\.)?(\w+)$", text, re.I):
            if m[1] and m[1].lower() != "work":
                lib.librefs[m[1].lower()].drop(m[2])
            else:
                lib.tables.pop(m[2].lower(), None)
        else:
            log.warning("NOTE: SQL statement is not kept: %s", text.split(None, 1)[0])


def run_proc(step: ProcStep, lib: Library, out: Listing) -> None:
    if step.name not in PROCS:
        log.warning("NOTE: PROC %s is not supported", step.name.upper())
        return
    PROCS[step.name](step, lib, out)
