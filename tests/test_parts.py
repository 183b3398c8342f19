"""Functions, ordered operations, files and plans."""

import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepframe.frame import ORD, from_dataframe
from stepframe.functions import columns as C
from stepframe.functions import dates, scalar, texts
from stepframe.lang.parser import cut, names, whole_expression
from stepframe.operators import stats
from stepframe.operators import tables as ops
from stepframe.plans import ordered
from stepframe.lang.sqltext import to_spark_sql, with_tables
from stepframe.sources import files
from stepframe.sources.lines import dsd_line, fields


def test_number_texts(spark):
    pairs = [(25.0, "25"), (1000000.0, "1e+06"), (123456.0, "123456"), (0.1, "0.1"), (1e-5, "1e-05"), (-2.5, "-2.5"), (1234567.5, "1.2345675e+06"), (0.0001, "0.0001"), (100000.0, "100000"), (None, "."), (0.0, "0")]
    assert [texts.general(x) for x, _ in pairs] == [t for _, t in pairs]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(pairs)], "k int, x double")
    assert [r[0] for r in df.orderBy("k").select(C.to_text(F.col("x"))).collect()] == [t for _, t in pairs]


def test_best_and_fixed():
    for x, t in ((3.0, "3"), (1 / 3, "0.3333333333"), (123456789.123456, "123456789.12"), (None, "."), (-1.5, "-1.5"), (1e20, "1e+20"), (2.675, "2.675")):
        assert texts.best(x) == t
    assert texts.show(2.675, texts.spec("8.2")) == "2.67" and texts.show(0.125, texts.spec("8.2")) == "0.12"
    assert texts.show(-1234.5, texts.spec("dollar10.2")) == "-$1,234.50" and texts.show(0.256, texts.spec("percent8.1")) == "25.6%"
    assert texts.show(21929.0, texts.spec("worddate.")) == "January 15, 2020" and texts.show(52200.0, texts.spec("time5.")) == "14:30"


def test_dates_roll_over_and_cut():
    assert dates.parse_date("31FEB2020") == dates.day_number(2020, 3, 2) and dates.parse_date("01JAN19") == dates.day_number(2019, 1, 1) and dates.parse_date("01JAN20") == dates.day_number(1920, 1, 1)
    assert dates.parse_numeric_date("01/15/2020", "mdy") == dates.parse_numeric_date("20200115", "ymd") == 21929
    assert dates.calendar("qtr3.2").months == 9 and dates.intck("month", 0.0, 1e9) is None
    with pytest.raises(ValueError):
        dates.calendar("nothing")


NUMBERS = st.one_of(st.none(), st.integers(-1000, 1000).map(float), st.floats(-1e6, 1e6).map(lambda x: round(x, 3)))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(NUMBERS, NUMBERS), min_size=1, max_size=15))
def test_columns_equal_python(spark, rows):
    """Both evaluators agree on operators and numeric functions."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a double, b double")
    a, b = C.Typed(F.col("a"), "num"), C.Typed(F.col("b"), "num")
    for op in ("+", "-", "*", "/"):
        got = [r[0] for r in df.orderBy("k").select(C.arithmetic(op, a, b).col).collect()]
        want = [scalar.arithmetic(op, x, y) for x, y in rows]
        assert all((g is None) == (w is None) and (g is None or math.isclose(g, w, rel_tol=1e-12, abs_tol=1e-12)) for g, w in zip(got, want, strict=True))
    ops_ = list(scalar.COMPARE)
    got = df.orderBy("k").select(*(C.compare(op, a, b).alias(f"c{k}") for k, op in enumerate(ops_)), *(C.compare(op, a, C.lit(5.0)).alias(f"l{k}") for k, op in enumerate(ops_))).collect()
    for r, (x, y) in zip(got, rows, strict=True):
        for k, op in enumerate(ops_):
            assert r[f"c{k}"] == scalar.COMPARE[op](scalar.order(x, y))
            assert bool(r[f"l{k}"]) == scalar.COMPARE[op](scalar.order(x, 5.0))
    names_ = ["sum", "mean", "min", "max", "n", "nmiss", "int", "floor", "abs", "round"]
    got = df.orderBy("k").select(*(C.FUNCTIONS[f](*([a, b] if f in names_[:6] else [a])).col.alias(f) for f in names_)).collect()
    for r, (x, y) in zip(got, rows, strict=True):
        for f in names_:
            w = scalar.FUNCTIONS[f](*([x, y] if f in names_[:6] else [x]))
            assert (r[f] is None) == (w is None) and (w is None or math.isclose(r[f], w, rel_tol=1e-9, abs_tol=1e-9)), (f, x, y)


@settings(max_examples=100, deadline=None)
@given(st.floats(-40_000, 60_000), st.integers(-30, 30), st.sampled_from(["day", "week", "week.2", "month", "month2", "qtr", "semiyear", "year", "year.4"]), st.sampled_from("bmes"))
def test_interval_algebra(d, n, name, align):
    d = float(math.floor(d))
    moved = dates.intnx(name, d, float(n), align)
    if align in "be":
        assert dates.intck(name, d, moved) == n
    start, end = dates.intnx(name, d, 0.0, "b"), dates.intnx(name, d, 0.0, "e")
    assert start <= d <= end and start <= dates.intnx(name, d, 0.0, "m") <= end


def test_interval_columns(spark):
    rng = random.Random(3)
    days = [float(rng.randint(-20_000, 40_000)) for _ in range(200)]
    df = spark.createDataFrame([(k, d, d * 86400 + 3723) for k, d in enumerate(days)], "k int, d double, s double")
    for name in ("week", "month2", "qtr", "year.4", "day3"):
        for align in "bmes":
            got = [r[0] for r in df.orderBy("k").select(C.intnx(name, F.col("d"), F.lit(2.0), align)).collect()]
            assert got == [dates.intnx(name, d, 2.0, align) for d in days], (name, align)
        got = [r[0] for r in df.orderBy("k").select(C.intck(name, F.lit(0.0), F.col("d"))).collect()]
        assert got == [dates.intck(name, 0.0, d) for d in days]
    got = [r[0] for r in df.orderBy("k").select(C.intnx("dtmonth", F.col("s"), F.lit(1.0))).collect()]
    assert got == [dates.intnx("dtmonth", d * 86400 + 3723, 1.0) for d in days]


def test_ordered_operations(spark):
    rng = random.Random(8)
    n = 500
    rows = [(k * 7 + rng.randint(0, 6), rng.choice("aab"), rng.choice([1.0, 2.0, None])) for k in range(n)]
    df = spark.createDataFrame(rows, f"{ORD} long, g string, x double").repartition(7)
    p = ordered.ordered(df)
    d = ordered.number(p)
    d = ordered.running(d, {"s": F.coalesce("x", F.lit(0.0))})
    d = ordered.carried(d, "c", F.when(F.col("g") == "b", F.col(ORD)))
    d = ordered.flags(d, ["g"])
    got = d.orderBy(ORD).collect()
    total, carried = 0.0, None
    for k, r in enumerate(got):
        total += r.x or 0.0
        carried = r[ORD] if r.g == "b" else carried
        assert (r["__n"], r.s, r.c) == (k + 1, total, carried)
        assert r["first.g"] == (k == 0 or got[k - 1].g != r.g) and r["last.g"] == (k == n - 1 or got[k + 1].g != r.g)


def test_sort_is_stable_and_idempotent(spark):
    t = from_dataframe(spark.createDataFrame([(k % 3 if k % 5 else None, k) for k in range(60)], "a int, b int").coalesce(1))
    once = ops.sort(t, [("a", False)])
    assert once.rows() == sorted(t.rows(), key=lambda r: (r[0] is not None, r[0] or 0)) == ops.sort(once, [("a", False)]).rows()


def test_cutting_and_names():
    assert [c.text for c in cut("a = 'x;y'; * note; b = 1; /* ; */ c = 2;")] == ["a = 'x;y'", "b = 1", "c = 2"]
    assert names("id x1-x3 y01 - y03") == ["id", "x1", "x2", "x3", "y01", "y02", "y03"]
    assert whole_expression("-2 ** 2 + 1") == ("bin", "+", ("un", "-", ("bin", "**", ("num", 2.0), ("num", 2.0))), ("num", 1.0))


@given(st.lists(st.text(st.characters(blacklist_categories=("Cs", "Cc")), max_size=8), min_size=1, max_size=5))
def test_dsd_round_trip(values):
    values = [v.strip() for v in values]
    assert fields(dsd_line(values), ",", True) == values


def test_sql_shim():
    assert to_spark_sql("select a / b, 7/2 from t where x like 'a/b%'") == "select try_divide(a, b), (7 div nullif(2, 0)) from t where x ilike 'a/b%'"
    assert to_spark_sql('select 3 * 7 / 2 / 4, x / (a + 1) / -2, count(*), sum(q)/total(r) from t -- a/b\nwhere a = "x like 6/2; it\'s" and t.b eq 1') == "select ((3 * 7 div nullif(2, 0)) div nullif(4, 0)), try_divide(try_divide(x, (a + 1)), (-2)), count(*), try_divide(sum(q), coalesce(sum(r), 0)) from t where a = 'x like 6/2; it\\'s' and t.b = 1"
    seen = []
    out = with_tables("with c as (select * from a) select extract(year from d) from c, lib.b join (select 1 from a z, connection to db (select (1) from a) q) s on a is distinct from b where 'from a' = x", lambda n: seen.append(n) or f"V{len(seen)}", lambda c, q: f"P[{c}:{q}]")
    assert seen == ["a", "lib.b", "a"]
    assert out == "with c as (select * from V1 as a) select extract(year from d) from c, V2 as b join (select 1 from V3 z, P[db:select (1) from a] q) s on a is distinct from b where 'from a' = x"
    assert "listagg(" in to_spark_sql("select group_concat(x) from t") and "coalesce(sum(x), 0)" in to_spark_sql("select total(x) from t")


def test_tails():
    assert abs(stats.gamma_tail(0.5, 3.841458820694124 / 2) - 0.05) < 1e-9
    assert abs(stats.t_two_sided(2.228138851986273, 10) - 0.05) < 1e-9 and stats.t_two_sided(0.0, 5) == 1


def binary_dataset(rows, wide):
    """A small uncompressed little-endian dataset: one metadata page, one data page."""
    w = 8 if wide else 4
    length = 16
    text = b"\0\0\0\0" + b"id  name" + b"\0" * 20
    sub = {}
    number = lambda v, n=w: v.to_bytes(n, "little")
    pad = b"\0" * 4 if wide else b""
    size = bytearray(w * 60)
    size[:w] = b"\xf7\xf7\xf7\xf7" + pad
    size[5 * w : 6 * w], size[6 * w : 7 * w] = number(length), number(len(rows))
    sub["size"] = bytes(size)
    sub["columns"] = b"\xf6\xf6\xf6\xf6" + pad + number(2)
    sub["text"] = b"\xfd\xff\xff\xff" + (b"\xff" * 4 if wide else b"") + text
    ref = lambda at, n: number(0, 2) + number(at, 2) + number(n, 2) + b"\0\0"
    sub["names"] = b"\xff\xff\xff\xff" + (b"\xff" * 4 if wide else b"") + b"\0" * 8 + ref(4, 2) + ref(8, 4) + b"\0" * (w + 4)
    attribute = lambda at, n, k: number(at) + number(n, 4) + b"\0\0" + bytes([k, 0])
    sub["attributes"] = b"\xfc\xff\xff\xff" + (b"\xff" * 4 if wide else b"") + b"\0" * 8 + attribute(0, 8, 1) + attribute(8, 8, 2) + b"\0" * (w + 4)
    page, base = 4096, 32 if wide else 16
    meta, data, entries, at = bytearray(page), bytearray(page), b"", 4096
    for body in sub.values():
        at -= len(body)
        meta[at : at + len(body)] = body
        entries += number(at) + number(len(body)) + b"\0\0" + b"\0" * (w - 2)
    meta[base : base + 8] = number(0, 2) + number(len(sub), 2) + number(len(sub), 2) + b"\0\0"
    meta[base + 8 : base + 8 + len(entries)] = entries
    body = b"".join(struct.pack("<d", float("nan") if x is None else x) + s.encode().ljust(8) for x, s in rows)
    data[base : base + 8] = number(0x100, 2) + number(len(rows), 2) + b"\0" * 4
    data[base + 8 : base + 8 + len(body)] = body
    head = bytearray(1024)
    head[:32] = files.MAGIC
    head[32], head[35], head[37] = (0x33 if wide else 0x22), 0x32, 1
    head[196:200], head[200:204], head[204 : 204 + w] = number(1024, 4), number(page, 4), number(2)
    return bytes(head) + bytes(meta) + bytes(data)


@pytest.mark.parametrize("wide", [False, True])
def test_binary_dataset(spark, tmp_path, wide):
    rows = [(1.0, "Ann"), (None, "Bob"), (2.5, "")]
    (tmp_path / "m.sas7bdat").write_bytes(binary_dataset(rows, wide))
    t = files.open_binary(spark, str(tmp_path / "m.sas7bdat"))
    assert t.rows() == rows and t.names == ["id", "name"]


def test_compressed_rows():
    runs = bytes([0x80 + 2]) + b"abc" + bytes([0xC0 + 1]) + b"z" + bytes([0xE0 + 3]) + bytes([0xD0]) + bytes([0x60, 0]) + bytes([0xF0])
    assert files.expand_row(runs, 60, files.ROW_RUNS) == b"abc" + b"zzzz" + b"     " + b"@@" + b" " * 17 + b"\0\0"
    control = 0b0001110000000000
    pairs = struct.pack(">H", control) + b"abc" + bytes([0x01, ord("q")]) + bytes([0x10, 1]) + b"r" + bytes([0x31, 0]) + b"yz"
    out = files.expand_row(pairs, 100, files.ROW_PAIRS)
    assert out.startswith(b"abc" + b"q" * 4 + b"r" * 35)


def test_transform_is_one_stage_of_codegen(spark):
    from stepframe.session import Session

    s = Session(spark)
    s.add("li", spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    s.submit("data out; set li; where l_quantity < 10; r = l_extendedprice * (1 - l_discount); if l_quantity > 5 then t = 2; else t = 1; keep l_orderkey r t; run;")
    plan = s.dataframe("out")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double,l_discount:double>" in plan
    assert "PushedFilters: [Or(LessThan(l_quantity,10.0),IsNull(l_quantity))]" in plan


def test_informat_columns_equal_python(spark):
    texts_ = ["15JAN2020", " 1feb99 ", "31FEB2020", "00JAN2020", "5-MAR-2001", "5 XYZ 2001", "15JANU2020", "", "01/15/2020", "13/45/1999", "2020-1-5", "20200115", "011520", "1.2.03", "1/2", "14:30", "1:2:3.5", "x:1", "02JAN1960:03:00:10", "02JAN1960", "02JAN1960:", "99JAN1960:1:1", "12", "7.5", "gold", "Zed", "-3", "1e3"]
    from stepframe.functions.texts import Range, UserFormat
    from stepframe.plans.step import informat_column

    class Lib:
        own = UserFormat("m", [Range("gold", "gold", 3.0), Range(None, 5.0, 1.0, high_open=True), Range(7.0, 12.0, 2.0), Range(100.0, None, "x"), Range(label=9.0, other=True)], "invalue")

        def user_informat(self, name):
            return self.own if name == "m." else None

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts_)], "k int, s string")
    names_ = ["date9.", "mmddyy10.", "ddmmyy10.", "yymmdd10.", "time8.", "datetime20.", "m.", "8.", "comma8."]
    rows = df.select("k", *(informat_column(F.col("s"), n, Lib()).col.alias(f"c{i}") for i, n in enumerate(names_))).orderBy("k").collect()
    plan = df.select(*(informat_column(F.col("s"), n, Lib()).col.alias(n) for n in names_))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r, t in zip(rows, texts_, strict=True):
        for i, n in enumerate(names_):
            want = Lib.own.read(t) if n == "m." else texts.read(t, texts.spec(n))
            want = None if isinstance(want, str) else want
            assert r[i + 1] == want, (n, t, r[i + 1], want)


def test_lines_stream_through_the_interpreter(check, tmp_path):
    """More rows than go out at once, and no more lines in memory than a record needs."""
    from stepframe.plans.interp import Lines

    lines = Lines(map(str, range(10)))
    assert lines.has(3) and not lines.has(10) and lines[4] == "4"
    lines.forget(4)
    assert len(lines.held) == 6 and lines[4] == "4"
    (tmp_path / "v.txt").write_text("".join(f"{k} {k * 2}\n" for k in range(25_000)))
    s = check(f'data t; infile "{tmp_path}/v.txt" end=last; input a @@; total + a; if last then mark = 1; run; proc sql; create table o as select count(*) as n, max(total) as total, sum(mark) as marks from t; quit;')
    assert s.table("o").rows() == [(50_000, 3.0 * sum(range(25_000)), 2)]


def test_large_formats_equal_small_ones(spark):
    from stepframe.functions.texts import Range, UserFormat

    points = [Range(float(k), float(k), f"p{k}") for k in range(0, 900, 3)] + [Range(10.0, 20.0, "wide"), Range(500.0, None, "high", low_open=True), Range(label="rest", other=True)]
    words = [Range(f"w{k}", f"w{k}", f"l{k}") for k in range(300)]
    nums = [None, 0.0, 1.0, 12.0, 13.0, 20.0, 501.0, 502.0, -4.0, 898.0, 899.5]
    texts_ = ["w0", "w299", "w300", ""]
    for ranges, values, kind in ((points, nums, "num"), (words, texts_, "char")):
        fmt = UserFormat("f", ranges)
        df = spark.createDataFrame([(v,) for v in values], "v double" if kind == "num" else "v string").coalesce(1)
        got = [r[0] for r in df.select(C.user_label(C.Typed(F.col("v"), kind), fmt, F.lit("none"))).collect()]
        assert got == [fmt.show(v) if fmt.show(v) is not None else "none" for v in values]


def test_merge_with_a_small_source_pairs_as_in_one_shuffle(spark, monkeypatch):
    from stepframe.operators import tables as ops

    a = spark.createDataFrame([(float(k % 4) if k % 4 != 3 else None, "x", float(k), k) for k in range(40)], "k double, v string, n double, o long")
    b = spark.createDataFrame([(0.0, "zero", 5.0), (None, "none", 6.0), (9.0, "nine", 7.0)], "k double, v string, w double")
    a, b = from_dataframe(a, F.col("o")), from_dataframe(b)
    for pair in ((a, b), (b, a)):
        found = []
        for limit in (10_000, -1):
            monkeypatch.setattr(ops, "LOOKED_UP", limit)
            t = ops.merge(list(pair), ["k"], [None, None])
            found.append(t.df.orderBy("__ord").drop("__ord", "o").collect())
            plan = t.df._jdf.queryExecution().executedPlan().toString()
            assert ("Window" in plan) == (limit < 0)
        assert found[0] == found[1] and len(found[0]) == 41


def test_a_sheet_is_read_and_written_in_parts(session, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SHEET_ROWS", 3)
    rows = [(float(k), "" if k % 4 == 1 else f"a<{k}>", None if k % 3 == 0 else k / 2) for k in range(11)]
    t = from_dataframe(session.spark.createDataFrame(rows, "k double, s string, x double"))
    files.export_sheet(t, f"{tmp_path}/a.xlsx")
    assert not isinstance(files.read_sheet(f"{tmp_path}/a.xlsx"), list)
    back = files.import_sheet(session.spark, f"{tmp_path}/a.xlsx")
    assert back.names == ["k", "s", "x"] and back.rows() == rows
    assert files.import_sheet(session.spark, f"{tmp_path}/a.xlsx", datarow=9).rows() == rows[7:]


def test_files_are_written_by_tasks_in_order(session, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    rows = [(float(k), ["plain", 'a "b"', "c\td", "two\nlines", ""][k % 5], None if k % 7 == 0 else k * 1e5) for k in range(50)]
    t = from_dataframe(session.spark.createDataFrame(rows, "k double, s string, x double").repartitionByRange(5, "k").sortWithinPartitions("k"))
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    files.export_delimited(t, f"{tmp_path}/a.txt", "\t")
    want = [files.dsd_line(t.names, "\t")] + [files.dsd_line([texts.general(k), s, "" if x is None else texts.general(x)], "\t") for k, s, x in rows]
    assert open(f"{tmp_path}/a.txt", encoding="utf-8").read() == "\n".join(want) + "\n"
