import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.coalescePartitions.enabled", "true").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def session(spark):
    from stepframe.session import Session

    return Session(spark)


def close(got, want):
    assert len(got) == len(want), (got, want)
    for g, w in zip(got, want, strict=True):
        assert len(g) == len(w), (g, w)
        for a, b in zip(g, w, strict=True):
            if isinstance(b, float | int) and not isinstance(b, bool) and a is not None and not isinstance(a, str):
                assert abs(a - b) <= max(1e-6, 1e-9 * abs(b)), (got, want)
            else:
                assert a == b, (got, want)


@pytest.fixture
def check(session):
    """Runs a program and compares tables: check(program, name=(columns, rows))."""

    def run(program, **tables):
        session.submit(program)
        for name, (columns, rows) in tables.items():
            t = session.table(name.replace("__", "."))
            assert [n.lower() for n in t.names] == [c.lower() for c in columns.split()], t.names
            close(t.rows(), rows)
        return session

    return run
