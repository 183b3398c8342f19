"""Librefs: folders of binary datasets, folders of Parquet, SQLite files, and JDBC databases."""

from __future__ import annotations

import os
import sqlite3
from dataclasses import dataclass
from glob import glob

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stepframe.frame import ORD, Table, from_dataframe, to_dataframe
from stepframe.sources.files import open_binary

#: How a table is renamed, by the subprotocol of the URL.
RENAME = {"postgresql": "alter table {0} rename to {1}", "oracle": "alter table {0} rename to {1}", "sqlserver": "exec sp_rename '{0}', '{1}'"}
JDBC = {"postgres": "postgresql", "postgresql": "postgresql", "sqlserver": "sqlserver", "mssql": "sqlserver", "oracle": "oracle:thin", "db2": "db2", "mysql": "mysql"}


@dataclass
class Folder:
    """name.sas7bdat or name.parquet in a folder; only Parquet is written."""

    spark: SparkSession
    path: str

    def _find(self, name: str) -> str | None:
        return next((p for p in sorted(glob(os.path.join(self.path, "*"))) if os.path.basename(p).lower() in (f"{name}.sas7bdat", f"{name}.parquet")), None)

    def has(self, name: str) -> bool:
        return self._find(name) is not None

    def read(self, name: str) -> Table:
        p = self._find(name)
        if p is None:
            raise KeyError(f"dataset {name} does not exist in {self.path}")
        return open_binary(self.spark, p) if p.endswith("bdat") else from_dataframe(self.spark.read.parquet(p), F.col(ORD) if ORD in self.spark.read.parquet(p).columns else None)

    def write(self, name: str, table: Table) -> None:
        d = table.data()
        target = os.path.join(self.path, f"{name}.parquet")
        # beside the old table, which the step may be reading
        table.df.select(*(table.df[f"`{n}`"].alias(n, metadata=d.schema[n].metadata) for n in table.names), ORD).write.mode("overwrite").parquet(target + ".new")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(target).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(path(target), True)
        fs.rename(path(target + ".new"), path(target))

    def append(self, name: str, table: Table) -> None:
        raise PermissionError("a folder libref is not appended to")

    drop = append


@dataclass
class Sqlite:
    """A local SQLite file, through the standard library."""

    spark: SparkSession
    path: str

    def connect(self) -> sqlite3.Connection:
        return sqlite3.connect(self.path)

    def has(self, name: str) -> bool:
        with self.connect() as c:
            return c.execute("select 1 from sqlite_master where lower(name) = ? and type in ('table', 'view')", (name.lower(),)).fetchone() is not None

    def read(self, name: str) -> Table:
        return self.query(f'select * from "{name}"')

    def query(self, sql: str) -> Table:
        with self.connect() as c:
            cur = c.execute(sql)
            names = [d[0] for d in cur.description]
            rows = cur.fetchall()
        char = [any(isinstance(r[k], str) for r in rows) for k in range(len(names))]
        schema = "".join(f"`{n}` {'string' if ch else 'double'}, " for n, ch in zip(names, char, strict=True)) + f"{ORD} long"
        data = [(*(("" if v is None else str(v)) if ch else None if v is None else float(v) for v, ch in zip(r, char, strict=True)), k) for k, r in enumerate(rows)]
        return from_dataframe(self.spark.createDataFrame(data, schema), F.col(ORD))

    def execute(self, sql: str) -> None:
        with self.connect() as c:
            c.executescript(sql)

    def _insert(self, name: str, table: Table, create: bool) -> None:
        """In one transaction; rows are streamed in order."""
        cols = ", ".join(f'"{n}"' for n in table.names)
        with self.connect() as c:
            if create:
                c.execute(f'drop table if exists "{name}"')
                c.execute(f'create table "{name}" (' + ", ".join(f'"{v.name}" {"REAL" if v.kind == "num" else "TEXT"}' for v in table.vars) + ")")
            rows = (tuple(r) for r in table.df.orderBy(ORD).select(*(f"`{n}`" for n in table.names)).toLocalIterator())
            c.executemany(f'insert into "{name}" ({cols}) values ({", ".join("?" * len(table.names))})', rows)

    def write(self, name: str, table: Table) -> None:
        self._insert(name, table, True)

    def append(self, name: str, table: Table) -> None:
        self._insert(name, table, False)

    def drop(self, name: str) -> None:
        self.execute(f'drop table if exists "{name}"')


@dataclass
class Jdbc:
    """A database through Spark's JDBC source: filters and columns are pushed down; the driver jar must be on the class path.

    What a step takes from it is written once (`changing`), so that later statements do not change it.
    """

    changing = True

    spark: SparkSession
    engine: str
    url: str

    def _reader(self):
        url = self.url if self.url.startswith("jdbc:") else f"jdbc:{JDBC[self.engine]}://{self.url.split('://')[-1]}"
        return self.spark.read.format("jdbc").option("url", url), url

    def has(self, name: str) -> bool:
        try:
            self.read(name).df.schema  # noqa: B018
        except Exception:
            return False
        return True

    def read(self, name: str) -> Table:
        return from_dataframe(self._reader()[0].option("dbtable", name).load())

    def query(self, sql: str) -> Table:
        return from_dataframe(self._reader()[0].option("query", sql).load())

    def _write(self, name: str, table: Table, mode: str) -> None:
        to_dataframe(table).write.format("jdbc").option("url", self._reader()[1]).option("dbtable", name).mode(mode).save()

    def write(self, name: str, table: Table) -> None:
        """Into a table of another name, which takes the place of the old one only when it is whole."""
        new = f"{name}_new"
        self._write(new, table, "overwrite")
        rename = RENAME.get(self._reader()[1].split(":")[1], "rename table {0} to {1}")
        self.execute(*([f"drop table {name}"] if self.has(name) else []), rename.format(new, name))

    def append(self, name: str, table: Table) -> None:
        self._write(name, table, "append")

    def execute(self, *sql: str) -> None:
        """Statements over one connection."""
        jvm, url = self.spark.sparkContext._jvm, self._reader()[1]
        connection = jvm.java.sql.DriverManager.getConnection(url)
        try:
            for one in sql:
                connection.createStatement().execute(one)
        finally:
            connection.close()

    def drop(self, name: str) -> None:
        self.execute(f"drop table {name}")


def assign(spark: SparkSession, engine: str, path: str):
    engine = engine.lower()
    if engine in ("", "base", "v8", "v9", "sas7bdat"):
        return Folder(spark, path)
    if engine in ("sqlite", "sqlite3"):
        return Sqlite(spark, path)
    if engine in JDBC:
        return Jdbc(spark, engine, path)
    raise ValueError(f"engine {engine} is unknown")


__all__ = ["Folder", "Jdbc", "Sqlite", "assign"]
