"""The command line, notes, HTML listings, damaged rows and the shared folder."""

import logging

import pytest

from stepframe.__main__ import main, run_cases
from stepframe.session import Session
from stepframe.shared import kept, materialise, shared_dir
from stepframe.sources.databases import Jdbc
from stepframe.sources.files import ROW_RUNS, expand_row


def test_cases_in_folders(spark, tmp_path, capsys):
    for name, rows in (("good", "a,b\n1,x\n.,y\n"), ("bad", "a,b\n1,x\n2,y\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "program.sas").write_text("data t; input a b $; datalines;\n1 x\n. y\n;\nrun;")
        (tmp_path / name / "t.csv").write_text(rows)
    assert run_cases([str(tmp_path)], spark) == 1
    out = capsys.readouterr().out
    assert "1 passed, 1 failed" in out and "t, row 2" in out
    assert run_cases(["--parse-only", "--json", str(tmp_path)]) == 0
    assert main(["tokens", str(tmp_path / "good" / "program.sas")]) == 0 and main([]) == 2
    assert "input" in capsys.readouterr().out


def test_notes_and_counted_errors(spark, caplog):
    s, other = Session(spark), Session(spark)
    with caplog.at_level(logging.DEBUG, "stepframe"):
        s.submit("data t; do k = 1 to 3; output; end; run; proc proof data=t; range k 0 - 2; run;")
    assert any("WORK.T has 3 observations and 1 variables" in m for m in caplog.messages)
    assert s.errors > 0 and other.errors == 0
    assert not [h for h in logging.getLogger("stepframe").handlers if h in (s._errors, other._errors)]


def test_html_listing(spark):
    s = Session(spark, html=True)
    s.submit("data t; a = 1.5; b = '<x>'; run; proc print data=t; var b; run;")
    assert s.listing.html == ["<table><thead><tr><th>b</th></tr></thead><tbody><tr><td>&lt;x&gt;</td></tr></tbody></table>"]


def test_damaged_rows():
    for bad in (b"\x15abc", b"\x80", b"\xc0"):
        with pytest.raises(ValueError):
            expand_row(bad, 20, ROW_RUNS)
    with pytest.raises(ValueError):
        expand_row(b"\xc0\x00\x20\x01", 40, b"other")
    assert expand_row(b"\xc0a", 3, ROW_RUNS) == b"aaa"


def test_scratch_tables_go(spark):
    import os

    where = shared_dir(spark).removeprefix("file://")
    os.makedirs(where, exist_ok=True)
    before = set(os.listdir(where))
    rows = kept(lambda: materialise(materialise(spark.range(5)).where("id > 1")), spark)
    assert rows.count() == 3 and len(set(os.listdir(where)) - before) == 1


def test_jdbc_library(spark):
    """Against the in-memory database that Spark's jars hold."""
    s = Session(spark)
    s.library.librefs["db"] = Jdbc(spark, "derby", "jdbc:derby:memory:stepframe;create=true")
    s.submit(
        """data db.boats; input boat $ crew; datalines;
Heron 4
Tern 2
;
run;
data more; boat = 'Skua'; crew = 7; run;
proc append base=db.boats data=more; run;
data big; set db.boats; where crew > 3; run;
proc sql; create table out as select * from connection to db (select sum("crew") as total, count(*) as n from boats); execute (delete from boats where "crew" = 2) by db; quit;
data db.boats; set db.boats; crew = crew + 1; run;"""
    )
    assert sorted(s.table("big").rows()) == [("Heron", 4), ("Skua", 7)] and s.table("out").rows() == [(13, 3)]
    assert sorted(s.library.get("db", "boats").rows()) == [("Heron", 5), ("Skua", 8)]
    s.submit("proc sql; drop table db.boats; quit;")
    assert not s.library.has("db", "boats")


def test_folder_table_in_its_own_place(spark, tmp_path):
    s = Session(spark)
    s.submit(f'libname f "{tmp_path}"; data f.t; do k = 1 to 3; output; end; run; data f.t; set f.t; k = k * 10; run;')
    assert s.library.get("f", "t").rows() == [(10,), (20,), (30,)]
