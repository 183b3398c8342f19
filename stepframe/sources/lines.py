"""Text lines: reading files with an order, cutting lines to fields, writing ordered lines to one file."""

from __future__ import annotations

import os
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepframe.frame import ORD
from stepframe.shared import materialise, scratch, shared_dir


def fields(line: str, dlm: Any = None, dsd: bool = False) -> list[str]:
    """The fields of a line: DSD with quotes and empty fields, else runs of the delimiter (or blanks) count as one."""
    if not dsd:
        return [x for x in (line.split(str(dlm)[0]) if dlm else line.split()) if x]
    sep, out, buf, k, quoted = str(dlm or ",")[0], [], [], 0, False
    while k < len(line):
        c = line[k]
        if quoted:
            if c == '"' and line[k + 1 : k + 2] == '"':
                buf.append('"')
                k += 1
            elif c == '"':
                quoted = False
            else:
                buf.append(c)
        elif c == '"' and not "".join(buf).strip():
            quoted, buf = True, []
        elif c == sep:
            out.append("".join(buf))
            buf = []
        else:
            buf.append(c)
        k += 1
    return [*out, "".join(buf)]


def dsd_text(values: list[Column], dlm: str = ",") -> Column:
    """dsd_line() as a Column."""
    cell = lambda v: F.when(v.contains(dlm) | v.contains('"') | v.contains("\n"), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    return F.concat_ws(dlm, *map(cell, values))


def dsd_line(values: list[str], dlm: str = ",") -> str:
    return dlm.join('"' + v.replace('"', '""') + '"' if dlm in v or '"' in v or "\n" in v else v for v in values)


def pad_line(line: str, options: dict[str, Any]) -> str:
    n = options.get("lrecl")
    if not n:
        return line
    return line[: int(n)].ljust(int(n)) if options.get("pad") else line[: int(n)]


def dsd_fields(line: Column, dlm: str, n: int) -> Column:
    """The first n fields of a DSD line, '' where absent, as an array."""
    row = F.from_csv(line, ", ".join(f"c{k} string" for k in range(n)), {"sep": dlm, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return F.array(*(F.coalesce(row[f"c{k}"], F.lit("")) for k in range(n)))


def line_fields(line: Column, dlm: Any, dsd: bool, n: int) -> Column:
    if dsd:
        return dsd_fields(line, str(dlm or ",")[0], n)
    if dlm:
        c = str(dlm)[0]
        return F.filter(F.split(line, "[" + ("\\" + c if not c.isalnum() else c) + "]"), lambda x: x != "")
    return F.filter(F.split(line, r"\s+"), lambda x: x != "")


def read_lines(spark: SparkSession, path: str, firstobs: int | None = None, obs: int | None = None) -> DataFrame:
    """(value, ORD) of a text file; records firstobs to obs, ends included."""
    df = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias(ORD))
    if (firstobs or 1) > 1 or obs is not None:
        from stepframe.plans.ordered import number, ordered

        df = number(ordered(df)).where(F.col("__n").between(firstobs or 1, obs if obs is not None else 1 << 62)).select("value", ORD)
    return df


def inline_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(x, k) for k, x in enumerate(lines)], f"value string, {ORD} long")


def write_lines(lines: DataFrame, path: str, mod: bool = False) -> None:
    """The `value` column in order into one local file. mod appends."""
    with scratch(lines.sparkSession):
        # written first: the sort by range reads its input twice
        write_ordered(materialise(lines).orderBy(ORD).select("value"), path, mod=mod)


def write_ordered(lines: DataFrame, path: str, header: str | None = None, mod: bool = False) -> None:
    """The one text column of rows that lie in order: tasks write parts side by side in the shared folder, which are joined to one local file as bytes."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    spark = lines.sparkSession
    parts = f"{shared_dir(spark)}/stepframe-{uuid.uuid4().hex}"
    java, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = java.org.apache.hadoop.fs.Path(parts)
    files = folder.getFileSystem(conf)
    try:
        lines.write.option("compression", "none").text(parts)
        names = sorted(str(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
        with open(path, "a" if mod else "w", encoding="utf-8") as f:
            f.write(header + "\n" if header is not None else "")
        out = java.java.io.FileOutputStream(os.path.abspath(path), True)
        try:
            for name in names:
                part = files.open(java.org.apache.hadoop.fs.Path(folder, name))
                try:
                    java.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                finally:
                    part.close()
        finally:
            out.close()
    finally:
        files.delete(folder, True)
