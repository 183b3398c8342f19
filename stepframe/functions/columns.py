"""The same operators and functions as Spark Columns, so that Catalyst sees them: pushdown, codegen, no Python."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stepframe.functions import dates
from stepframe.functions.texts import Spec, UserFormat, general, show, spec


@dataclass
class Typed:
    """A Column with its kind: 'num' (double, null when missing) or 'char' (string, '' when missing)."""

    col: Column
    kind: str
    value: float | str | None = None  # of a literal
    test: Column | None = None  # of a comparison: the predicate behind the 1 or 0


def lit(v: float | str | None) -> Typed:
    if isinstance(v, str):
        return Typed(F.lit(v), "char", v)
    return Typed(F.lit(v).cast("double"), "num", v)


def to_number(s: Column) -> Column:
    """A text as a number, or null; Java's suffixes (1d) are no numbers here."""
    t = F.trim(s)
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def to_text(x: Column) -> Column:
    """A number as its shortest text, '.' when missing (exponent below 1e-4 and from 1e6 on)."""
    short = (x == F.floor(x)) & (F.abs(x) < 1e6)
    return F.when(short, x.cast("long").cast("string")).otherwise(_shortest(x))


def _shortest(x: Column) -> Column:
    s = F.abs(x).cast("string")
    pattern = r"^([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$"
    whole, part = F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2)
    e = F.coalesce(F.regexp_extract(s, pattern, 3).try_cast("int"), F.lit(0))
    digits = F.concat(whole, part)
    bare = F.ltrim(digits, F.lit("0"))
    point = F.length(whole) + e - (F.length(digits) - F.length(bare))
    d = F.rtrim(bare, F.lit("0"))
    n, exp = F.length(d), point - 1
    science = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise(""), F.when(exp < 0, "e-").otherwise("e+"), F.lpad(F.abs(exp).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exp).cast("string"))), F.lit("0")))
    plain = F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), d)).when(n <= point, F.rpad(d, point, F.lit("0"))).otherwise(F.concat(F.substr(d, F.lit(1), point), F.lit("."), F.substr(d, point + 1)))
    body = F.when((exp < -4) | (exp >= 6), science).otherwise(plain)
    return F.when(x.isNull(), ".").when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "+Inf").otherwise("-Inf")).when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), body))


def num(t: Typed) -> Column:
    return t.col if t.kind == "num" else to_number(t.col)


def char(t: Typed) -> Column:
    return t.col if t.kind == "char" else to_text(t.col)


def truth(t: Typed) -> Column:
    if t.test is not None:
        return t.test
    return t.col != "" if t.kind == "char" else F.coalesce(t.col != 0, F.lit(False))


def flag(predicate: Column) -> Typed:
    return Typed(predicate.cast("double"), "num", None, predicate)


def compare(op: str, a: Typed, b: Typed) -> Column:
    """Two-valued comparison; a missing number is below every number. OR forms still push down to Parquet and JDBC."""
    if a.kind == b.kind == "char":
        x, y = a.col, b.col
        return {"=": x == y, "^=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    x, y = num(a), num(b)
    if op == "=":
        return x.eqNullSafe(y)
    if op == "^=":
        return ~x.eqNullSafe(y)
    no, fixed = F.lit(False), isinstance(b.value, float | int)
    if op == "<":
        return F.coalesce(x < y, no) | (x.isNull() & y.isNotNull()) if not fixed else (x < y) | x.isNull()
    if op == "<=":
        return F.coalesce(x <= y, no) | x.isNull() if not fixed else (x <= y) | x.isNull()
    if op == ">":
        return F.coalesce(x > y, no) | (y.isNull() & x.isNotNull()) if not fixed else F.coalesce(x > y, no)
    return F.coalesce(x >= y, no) | y.isNull() if not fixed else F.coalesce(x >= y, no)


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    x, y = num(a), num(b)
    out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.when(y != 0, F.try_divide(x, y)), "**": lambda: F.pow(x, y)}[op]()
    if op == "**":
        out = F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)
    return Typed(out, "num")


# --- dates


def as_date(d: Column) -> Column:
    return F.date_add(F.lit("1960-01-01").cast("date"), F.floor(d).cast("int"))


def from_date(d: Column) -> Column:
    return F.datediff(d, F.lit("1960-01-01").cast("date")).cast("double")


def from_timestamp(t: Column) -> Column:
    return from_date(t.cast("date")) * dates.DAY_S + (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("double")


def first_of_month(k: Column) -> Column:
    """Day number of the first of month k = year * 12 + month - 1."""
    y, m = F.floor(k / 12), F.pmod(k, F.lit(12)) + 1
    return from_date(F.try_to_date(F.format_string("%04d-%02d-01", y.cast("int"), m.cast("int"))))


class OnColumns:
    """Arithmetic of the calendars on Columns."""

    @staticmethod
    def floor(c: Column) -> Column:
        return F.floor(c).cast("double")

    @staticmethod
    def month(day: Column) -> Column:
        d = as_date(day)
        return (F.year(d) * 12 + F.month(d) - 1).cast("double")

    month_start = staticmethod(first_of_month)


def intck(name: str, a: Column, b: Column) -> Column:
    by = dates.calendar(name)
    return (by.number(b, OnColumns) - by.number(a, OnColumns)).cast("double")


def intnx(name: str, start: Column, n: Column, align: str = "b") -> Column:
    return dates.moved(dates.calendar(name), start, n.cast("long"), align, OnColumns).cast("double")


# --- functions


def _n(t: Typed) -> Column:
    """A numeric argument: text counts as 0."""
    return t.col if t.kind == "num" else F.lit(0.0)


def _s(t: Typed) -> Column:
    """A text argument: numbers count as ''."""
    return t.col if t.kind == "char" else F.lit("")


def _present(args: list[Typed]) -> Column:
    cols = [a.col for a in args if a.kind == "num"]
    return F.filter(F.array(*cols), lambda x: x.isNotNull()) if cols else F.array().cast("array<double>")


def _missing(t: Typed) -> Column:
    return t.col.isNull() if t.kind == "num" else t.col == ""


def _total(args: list[Typed]) -> Column:
    return F.aggregate(_present(args), F.lit(0.0), lambda a, x: a + x)


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _one(f: Callable[[Column], Column]) -> Callable[..., Typed]:
    return lambda x, *_: Typed(_finite(f(_n(x)).cast("double")), "num")


def _round(x: Typed, u: Typed | None = None) -> Typed:
    a = _n(x)
    unit = _n(u) if u else F.lit(1.0)
    q = a / F.when(unit != 0, unit)
    r = F.floor(F.abs(q) + 0.5) * F.signum(q) * unit
    return Typed(F.when(F.coalesce(unit != 0, F.lit(False)), r).otherwise(a), "num")


def _int_arg(t: Typed, default: int = 0) -> Column:
    return F.coalesce(_n(t).cast("int"), F.lit(default))


def _substr(s: Typed, p: Typed, n: Typed | None = None) -> Typed:
    start = F.greatest(F.lit(1), _int_arg(p, 1))
    size = F.greatest(F.lit(0), _int_arg(n)) if n else F.lit(1 << 30)
    return Typed(F.substr(_s(s), start, size), "char")


def _find(s: Typed, sub: Typed, start: Typed | None = None) -> Typed:
    at = F.greatest(F.lit(1), _int_arg(start, 1)) if start else F.lit(1)
    return Typed(F.when(_s(sub) == "", 0.0).otherwise(F.call_function("locate", _s(sub), _s(s), at).cast("double")), "num")


def _text(t: Typed | None, default: str = "") -> str:
    """The value of a text literal; names of intervals, delimiters and separators must be literals."""
    if t is None:
        return default
    if not isinstance(t.value, str):
        raise NotImplementedError("this argument must be a text literal")
    return t.value


def _scan(s: Typed, n: Typed, delims: str = " ") -> Typed:
    cls = "[" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in (delims or " ")) + "]"
    parts = F.filter(F.split(_s(s), cls), lambda x: x != "")
    k = _int_arg(n)
    return Typed(F.when(k == 0, "").otherwise(F.coalesce(F.try_element_at(parts, F.when(k != 0, k).otherwise(1)), F.lit(""))), "char")


def _stripped(t: Typed) -> Column:
    """A text without blanks around it; a whole number plainly, without an exponent."""
    if t.kind == "char":
        return F.trim(t.col)
    whole = (t.col == F.floor(t.col)) & (F.abs(t.col) < 1e15)
    return F.when(whole, t.col.cast("long").cast("string")).otherwise(to_text(t.col))


def _of_date(f: Callable[[Column], Column]) -> Callable[..., Typed]:
    return lambda d: Typed(f(as_date(_n(d))).cast("double"), "num")


def _mdy(m: Typed, d: Typed, y: Typed) -> Typed:
    return Typed(from_date(F.try_to_date(F.format_string("%04d-%02d-%02d", *(F.when(x.between(-9999, 9999), x).cast("int") for x in map(_n, (y, m, d)))), "yyyy-MM-dd")), "num")


FUNCTIONS: dict[str, Callable[..., Typed]] = {
    "sum": lambda *a: Typed(F.when(F.size(_present(a)) > 0, _total(a)), "num"),
    "mean": lambda *a: Typed(F.when(F.size(_present(a)) > 0, F.try_divide(_total(a), F.size(_present(a)))), "num"),
    "min": lambda *a: Typed(F.array_min(_present(a)), "num"),
    "max": lambda *a: Typed(F.array_max(_present(a)), "num"),
    "n": lambda *a: Typed(sum((1 - _missing(t).cast("int") for t in a), F.lit(0)).cast("double"), "num"),
    "nmiss": lambda *a: Typed(sum((_missing(t).cast("int") for t in a), F.lit(0)).cast("double"), "num"),
    "abs": _one(F.abs),
    "int": _one(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))),
    "ceil": _one(F.ceil),
    "floor": _one(F.floor),
    "sqrt": _one(F.sqrt),
    "exp": _one(F.exp),
    "log": _one(F.ln),
    "round": _round,
    "upcase": lambda s: Typed(F.upper(_s(s)), "char"),
    "lowcase": lambda s: Typed(F.lower(_s(s)), "char"),
    "propcase": lambda s: Typed(F.initcap(_s(s)), "char"),
    "trim": lambda s: Typed(F.rtrim(_s(s)), "char"),
    "strip": lambda s: Typed(F.trim(_s(s)), "char"),
    "left": lambda s: Typed(F.ltrim(_s(s)), "char"),
    "length": lambda s: Typed(F.greatest(F.octet_length(F.rtrim(_s(s))), F.lit(1)).cast("double"), "num"),
    "substr": _substr,
    "cats": lambda *a: Typed(F.concat(*map(_stripped, a)) if a else F.lit(""), "char"),
    "catx": lambda sep, *a: Typed(F.array_join(F.filter(F.array(*map(_stripped, a)), lambda x: x != ""), _text(sep)) if a else F.lit(""), "char"),
    "index": _find,
    "find": _find,
    "scan": lambda s, n, d=None: _scan(s, n, _text(d, " ")),
    "compress": lambda s, c=None: Typed(F.call_function("translate", _s(s), _s(c) if c else F.lit(" "), F.lit("")), "char"),
    "tranwrd": lambda s, a, b: Typed(F.when(_s(a) == "", _s(s)).otherwise(F.replace(_s(s), _s(a), _s(b))), "char"),
    "reverse": lambda s: Typed(F.reverse(_s(s)), "char"),
    "missing": lambda v: flag(_missing(v)),
    "today": lambda: Typed(from_date(F.current_date()), "num"),
    "date": lambda: Typed(from_date(F.current_date()), "num"),
    "datetime": lambda: Typed(from_timestamp(F.localtimestamp()), "num"),
    "time": lambda: Typed(F.pmod(from_timestamp(F.localtimestamp()), F.lit(86400.0)), "num"),
    "mdy": _mdy,
    "year": _of_date(F.year),
    "month": _of_date(F.month),
    "day": _of_date(F.dayofmonth),
    "qtr": _of_date(F.quarter),
    "weekday": _of_date(F.dayofweek),
    "datepart": lambda v: Typed(F.floor(_n(v) / dates.DAY_S).cast("double"), "num"),
    "timepart": lambda v: Typed(_n(v) - F.floor(_n(v) / dates.DAY_S) * dates.DAY_S, "num"),
    "hms": lambda h, m, s: Typed(_n(h) * 3600 + _n(m) * 60 + _n(s), "num"),
    "dhms": lambda d, h, m, s: Typed(_n(d) * 86400 + _n(h) * 3600 + _n(m) * 60 + _n(s), "num"),
    "intck": lambda iv, a, b: Typed(intck(_text(iv), _n(a), _n(b)), "num"),
    "intnx": lambda iv, s, n, al=None: Typed(intnx(_text(iv), _n(s), _n(n), _text(al, "b") or "b"), "num"),
}
FUNCTIONS["avg"] = FUNCTIONS["mean"]


# --- formats


#: Ranges of a format that one CASE may have.
LARGE_FORMAT = 200


def looked_up(fmt: UserFormat, kind: str):
    """The first range that holds a value: single values by hash, and only wider ranges one by one."""
    points: dict = {}
    wide = []
    for k, r in enumerate(fmt.ranges):
        if r.other:
            continue
        if isinstance(r.low, str) or (r.low is not None and r.low == r.high and not r.low_open and not r.high_open):
            if isinstance(r.low, str) == (kind == "char"):
                points.setdefault(r.low, k)
        elif kind == "num":
            wide.append((k, r))
    rest = next((str(r.label) for r in fmt.ranges if r.other), None)

    def one(v):
        k = points.get(v, len(fmt.ranges)) if v is not None and v == v else len(fmt.ranges)
        k = min([k, *(i for i, r in wide if i < k and v is not None and v == v and r.holds(v))])
        return str(fmt.ranges[k].label) if k < len(fmt.ranges) else rest

    @F.pandas_udf("string")
    def labels(x: pd.Series) -> pd.Series:
        codes, values = pd.factorize(x, use_na_sentinel=False)
        return pd.Series([one(None if pd.isna(v) else v) for v in values], dtype="object").take(codes).reset_index(drop=True)

    return labels


def user_label(t: Typed, fmt: UserFormat, otherwise: Column | None) -> Column:
    """The label of a value by a VALUE format, as one CASE; a large catalogue is looked up by hash in Arrow batches."""
    if len(fmt.ranges) > LARGE_FORMAT:
        found = looked_up(fmt, t.kind)(t.col)
        return F.coalesce(found, otherwise if otherwise is not None else F.lit(""))
    out, other = None, otherwise
    for r in fmt.ranges:
        label = F.lit(str(r.label))
        if r.other:
            other = label
            break
    for r in fmt.ranges:
        if r.other:
            continue
        if isinstance(r.low, str):
            cond = t.col == r.low if t.kind == "char" else F.lit(False)
        elif t.kind == "char":
            cond = F.lit(False)
        else:
            cond = t.col.isNotNull()
            if r.low is not None:
                cond = cond & (t.col > r.low if r.low_open else t.col >= r.low)
            if r.high is not None:
                cond = cond & (t.col < r.high if r.high_open else t.col <= r.high)
        out = F.when(cond, str(r.label)) if out is None else out.when(cond, str(r.label))
    other = F.lit("") if other is None else other
    return other if out is None else out.otherwise(other)


# --- informats


def _year(y: Column) -> Column:
    return F.when(y >= 100, y).otherwise(y + F.when(y < 20, 2000).otherwise(1900))


def _day(y: Column, m: Column, d: Column) -> Column:
    """Day number; months and days out of range roll over."""
    return first_of_month(_year(y) * 12 + m - 1) + d - 1


def read_date(s: Column) -> Column:
    """ddMMMyy or ddMMMyyyy as a day number."""
    part = lambda k: F.regexp_extract(s, r"^\s*(\d{1,2})[ -]?([A-Za-z]{3})[ -]?(\d{4}|\d{2})\s*$", k)
    at = F.instr(F.lit("".join(f"{m}." for m in dates.MONTHS)), F.concat(F.upper(part(2)), F.lit(".")))
    month = F.when((part(2) != "") & (at > 0), (at + 3) / 4)
    return _day(part(3).try_cast("double"), month, part(1).try_cast("double"))


def read_numeric_date(s: Column, order: str) -> Column:
    """order: 'mdy', 'dmy' or 'ymd'; parts apart by / - . or packed in 6 or 8 digits."""
    t = F.trim(s)
    apart = F.split(t, r"[/\-.]")
    year = F.length(t) - 4
    begin = {"mdy": {"m": 1, "d": 3, "y": 5}, "dmy": {"d": 1, "m": 3, "y": 5}, "ymd": {"y": 1, "m": year + 1, "d": year + 3}}[order]
    packed = t.rlike(r"^(\d{6}|\d{8})$")
    whole = t.rlike(r"^\d+[/\-.]\d+[/\-.]\d+$")

    def part(c: str) -> Column:
        own = t.substr(F.lit(begin[c]) if isinstance(begin[c], int) else begin[c], year if c == "y" else F.lit(2))
        return F.when(packed, own).when(whole, F.get(apart, F.lit(order.index(c)))).try_cast("double")

    return _day(part("y"), part("m"), part("d"))


def read_time(s: Column) -> Column:
    part = lambda k: F.regexp_extract(s, r"^\s*(\d+):(\d+)(?::(\d+(?:\.\d*)?))?\s*$", k).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + F.coalesce(part(3), F.lit(0.0))


def read_datetime(s: Column) -> Column:
    t = F.trim(s)
    clock = F.regexp_extract(t, r"^[^:]*:(.*)$", 1)
    return read_date(F.substring_index(t, ":", 1)) * dates.DAY_S + F.when(clock == "", 0.0).otherwise(read_time(clock))


def read_user(s: Column, user: UserFormat) -> Column:
    """A user informat: equal texts first, then ranges of numbers, then OTHER; a label that is no number is missing."""
    t, x = F.trim(s), to_number(s)
    value = lambda r: F.lit(float(r.label) if isinstance(r.label, int | float) else None).cast("double")
    tests = [(t == r.low, value(r)) for r in user.ranges if not r.other and isinstance(r.low, str)]
    for r in user.ranges:
        if not r.other and not isinstance(r.low, str) and not isinstance(r.high, str):
            ok = x.isNotNull()
            if r.low is not None:
                ok = ok & (x > r.low if r.low_open else x >= r.low)
            if r.high is not None:
                ok = ok & (x < r.high if r.high_open else x <= r.high)
            tests.append((ok, value(r)))
    tests += [(F.lit(True), value(r)) for r in user.ranges if r.other][:1]
    out = None
    for ok, v in tests:
        out = F.when(ok, v) if out is None else out.when(ok, v)
    return out if out is not None else F.lit(None).cast("double")


def put(t: Typed, fmt: str, user: UserFormat | None = None) -> Column:
    """A value as text in a format. Exact decimal text needs Python: only then an Arrow UDF runs."""
    f = spec(fmt)
    if user is not None and user.kind == "value":
        return user_label(t, user, put(t, f"{'$' if t.kind == 'char' else 'best'}."))
    if t.kind == "char":
        return F.substring(t.col, 1, f.width) if f.width else t.col
    x, w = t.col, f.width
    if user is None and f.name in ("date", "mmddyy", "worddate", "datetime", "time", "hhmmss"):
        d = as_date(F.floor(x / dates.DAY_S) if f.name == "datetime" else x)
        second = F.floor(F.pmod(x, F.lit(86400.0)) if f.name == "datetime" else F.abs(x)).cast("long")
        hm = F.format_string("%02d:%02d", F.floor(second / 3600), F.floor(second / 60) % 60)
        hms = F.concat(hm, F.format_string(":%02d", second % 60))
        body = {
            "date": F.upper(F.date_format(d, "ddMMMyyyy" if (w or 9) >= 9 else "ddMMMyy")),
            "mmddyy": F.date_format(d, "MM/dd/yyyy" if (w or 10) >= 10 else "MM/dd/yy"),
            "worddate": F.date_format(d, "MMMM d, yyyy"),
            "datetime": F.concat(F.upper(F.date_format(d, "ddMMMyyyy:")), hms),
        }.get(f.name)
        if body is None:
            body = F.concat(F.when(x < 0, "-").otherwise(""), hm if w is not None and 5 <= w < 8 else hms)
        return F.when(x.isNull(), ".").otherwise(body)
    return exact_text(f, user)(x)


def exact_text(f: Spec, user: UserFormat | None):
    def one(v) -> str:
        v = None if v is None or v != v else float(v)
        got = user.show(v) if user is not None else None
        return got if got is not None else show(v, f if user is None else None)

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(one, na_action=None).astype("object")

    return text


def best_text(x: Column) -> Column:
    """Default text of a number: integers in the JVM, the rest exactly."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e11)
    return F.when(x.isNull(), ".").when(whole, F.format_string("%d", x.cast("long"))).otherwise(exact_text(spec("best12."), None)(x))


__all__ = ["FUNCTIONS", "Typed", "arithmetic", "char", "compare", "general", "intck", "intnx", "lit", "num", "put", "to_number", "to_text", "truth", "user_label"]
