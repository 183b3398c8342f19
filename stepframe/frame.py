"""Tables with an explicit row order, variable metadata, and the library that holds them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.functions.columns import as_date, from_date, from_timestamp
from stepframe.functions.texts import UserFormat, trimmed_name

ORD = "__ord"


@dataclass(frozen=True)
class Var:
    """A variable: its kind is 'num' (double, null when missing) or 'char' (string, '' when missing)."""

    name: str
    kind: str
    format: str | None = None
    label: str | None = None
    length: int | None = None


@dataclass
class Table:
    """df holds one column for each variable, and ORD: unique, increasing in row order, not dense.

    in_place: the rows also lie in this order in the partitions, one partition after the other, as after a scan or a
    sort and whatever works row by row on it.
    """

    df: DataFrame
    vars: list[Var]
    sorted_by: tuple[str, ...] = ()
    in_place: bool = False

    @property
    def names(self) -> list[str]:
        return [v.name for v in self.vars]

    def var(self, name: str) -> Var | None:
        low = name.lower()
        return next((v for v in self.vars if v.name.lower() == low), None)

    def data(self) -> DataFrame:
        """The variables, without the order; formats and labels as field metadata."""
        return self.df.select([F.col(f"`{v.name}`").alias(v.name, metadata={k: x for k, x in (("format", v.format), ("label", v.label)) if x}) for v in self.vars])

    def rows(self, limit: int | None = None) -> list[tuple]:
        """Rows in order, on the driver: for listings and small results."""
        df = self.df.orderBy(ORD)
        df = df.limit(limit) if limit is not None else df
        return [tuple(r) for r in df.select([f"`{n}`" for n in self.names]).collect()]


def _ingest(df: DataFrame, f: T.StructField, nan_missing: bool) -> tuple[Column, Var] | None:
    c, t = F.col(f"`{f.name}`"), f.dataType
    fmt, label = f.metadata.get("format"), f.metadata.get("label")
    if isinstance(t, T.StringType | T.CharType | T.VarcharType):
        return F.coalesce(c.cast("string"), F.lit("")), Var(f.name, "char", fmt, label)
    if isinstance(t, T.DateType):
        return from_date(c), Var(f.name, "num", fmt or "date9.", label)
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return from_timestamp(c), Var(f.name, "num", fmt or "datetime19.", label)
    if isinstance(t, T.NumericType | T.BooleanType):
        x = c.cast("double")
        return (F.when(~F.isnan(x), x) if nan_missing and isinstance(t, T.DoubleType | T.FloatType) else x), Var(f.name, "num", fmt, label)
    return None


def from_dataframe(df: DataFrame, order: Column | None = None, nan_missing: bool = False) -> Table:
    """Any DataFrame as a table: numbers become double, dates and timestamps day numbers and seconds with a format.

    nan_missing turns NaN into missing; without it filters on numbers still reach the scan. Columns of other types have no counterpart in the two kinds and are left out. Row order is `order` if given, else
    the order of the scan.
    """
    got = [x for f in df.schema.fields if f.name != ORD and (x := _ingest(df, f, nan_missing))]
    place = order if order is not None else F.col(ORD) if ORD in df.columns else F.monotonically_increasing_id()
    return Table(df.select(*(c.alias(v.name) for c, v in got), place.alias(ORD)), [v for _, v in got], (), order is None and ORD not in df.columns)


def to_dataframe(table: Table) -> DataFrame:
    """Variables with date and datetime formats as dates and timestamps, for writing to typed sinks."""
    out = []
    for v in table.vars:
        c, fmt = F.col(f"`{v.name}`"), (v.format or "").lower()
        if v.kind == "num" and fmt.startswith("datetime"):
            c = F.timestamp_micros((c * 1e6 - 315619200 * 1e6).cast("long")).cast("timestamp_ntz")
        elif v.kind == "num" and fmt.startswith(("date", "mmddyy", "worddate")):
            c = as_date(c)
        out.append(c.alias(v.name))
    return table.df.select(out)


@dataclass
class Library:
    """WORK tables, librefs, user formats, titles."""

    spark: SparkSession
    tables: dict[str, Table] = field(default_factory=dict)
    librefs: dict[str, Any] = field(default_factory=dict)
    formats: dict[str, UserFormat] = field(default_factory=dict)
    informats: dict[str, UserFormat] = field(default_factory=dict)
    titles: dict[str, dict[int, str]] = field(default_factory=lambda: {"title": {}, "footnote": {}})

    def get(self, lib: str, name: str) -> Table:
        lib = lib.lower()
        if lib and lib != "work":
            if lib not in self.librefs:
                raise KeyError(f"libref {lib} is not assigned")
            return self.librefs[lib].read(name.lower())
        if name.lower() not in self.tables:
            raise KeyError(f"dataset {name} does not exist")
        return self.tables[name.lower()]

    def has(self, lib: str, name: str) -> bool:
        if lib and lib.lower() != "work":
            return lib.lower() in self.librefs and self.librefs[lib.lower()].has(name.lower())
        return name.lower() in self.tables

    def put(self, lib: str, name: str, table: Table) -> None:
        lib = lib.lower()
        if lib and lib != "work":
            self.librefs[lib].write(name.lower(), table)
        else:
            self.tables[name.lower()] = table

    def title(self, kind: str, level: int, text: str) -> None:
        """Sets a line; an empty one clears its level and all above."""
        lines = self.titles[kind]
        if text:
            lines[level] = text
        else:
            self.titles[kind] = {k: v for k, v in lines.items() if k < level}

    def user_format(self, name: str) -> UserFormat | None:
        key = name.lower().rstrip(".")
        return self.formats.get(key) or self.formats.get(trimmed_name(key))

    def user_informat(self, name: str) -> UserFormat | None:
        key = name.lower().rstrip(".")
        return self.informats.get(key) or self.informats.get(trimmed_name(key))


def renamed(v: Var, name: str) -> Var:
    return replace(v, name=name)
