"""Delimited files, spreadsheets and native binary datasets."""

from __future__ import annotations

import os
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stepframe.frame import ORD, Table, Var
from stepframe.functions.columns import to_number, to_text
from stepframe.functions.texts import general
from stepframe.shared import materialise
from stepframe.sources.lines import dsd_line, dsd_text, write_ordered


def sniffed(df: DataFrame, names: list[str]) -> Table:
    """Text columns to kinds in one aggregation: numeric if every non-empty value is a number and there is one."""
    cols = [F.col(f"`{c}`") for c in df.columns if c != ORD]
    checks = df.agg(*(F.count_if((F.trim(c) != "") & (F.trim(c) != ".") & to_number(c).isNull()).alias(f"b{k}") for k, c in enumerate(cols)), *(F.count_if(F.trim(c) != "").alias(f"n{k}") for k, c in enumerate(cols))).first()
    vars_ = [Var(n, "num" if not checks[f"b{k}"] and checks[f"n{k}"] else "char") for k, n in enumerate(names)]
    out = [(to_number(c) if v.kind == "num" else c).alias(v.name) for c, v in zip(cols, vars_, strict=True)]
    return Table(df.select(*out, ORD), vars_, (), True)


def variable_names(header: list[str]) -> list[str]:
    """Valid, distinct variable names of header cells; VARn where there is none."""
    out: list[str] = []
    for k, h in enumerate(header):
        name = re.sub(r"\W", "_", h.strip()) or f"VAR{k + 1}"
        name = f"_{name}" if name[0].isdigit() else name
        base, n = name, 1
        while name.lower() in {x.lower() for x in out}:
            n += 1
            name = f"{base}{n}"
        out.append(name)
    return out


def import_delimited(spark: SparkSession, path: str, delimiter: str = ",", getnames: bool = True, datarow: int | None = None) -> Table:
    """A delimited file with quotes; the header gives names, values give kinds."""
    raw = spark.read.option("sep", delimiter).option("quote", '"').option("escape", '"').option("header", "false").option("inferSchema", "false").option("nullValue", "\x00").csv(path)
    raw = raw.select(*(F.coalesce(c, F.lit("")).alias(c) for c in raw.columns), F.monotonically_increasing_id().alias(ORD))
    width = len(raw.columns) - 1
    first = raw.orderBy(ORD).limit(1).collect()
    names = variable_names([first[0][k] for k in range(width)]) if getnames and first else [f"VAR{k + 1}" for k in range(width)]
    start = datarow if datarow is not None else 2 if getnames else 1
    if start == 2:
        raw = raw.where(F.col(ORD) != first[0][ORD]) if first else raw
    elif start > 2:
        from stepframe.plans.ordered import PART, number, ordered

        raw = number(ordered(raw)).where(F.col("__n") >= start).drop("__n", PART)
    return sniffed(raw, names)


def export_delimited(table: Table, path: str, delimiter: str = ",", putnames: bool = True) -> None:
    """Rows in order into one local file; missing is empty, numbers have their shortest text."""
    cols = [F.when(F.col(f"`{v.name}`").isNull(), "").otherwise(to_text(F.col(f"`{v.name}`"))) if v.kind == "num" else F.col(f"`{v.name}`") for v in table.vars]
    rows = table.df if table.in_place else table.df.orderBy(ORD)
    rows = rows.select(*(c.alias(f"c{k}") for k, c in enumerate(cols)))
    write_ordered(rows.select(dsd_text([F.col(c) for c in rows.columns], delimiter).alias("value")), path, dsd_line(table.names, delimiter) if putnames else None)


# --- spreadsheets

#: Rows of a sheet that the driver holds at a time.
SHEET_ROWS = 50_000
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(k: int) -> str:
    out, k = "", k + 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def read_sheet(path: str) -> Iterator[list[str]]:
    """The rows of the first worksheet as texts, as they are read."""
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        sheet = "xl/worksheets/sheet1.xml" if "xl/worksheets/sheet1.xml" in names else min(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml"))
        data = None
        for event, row in ElementTree.iterparse(z.open(sheet), ("start", "end")):
            if event == "start":
                data = row if row.tag == f"{MAIN}sheetData" else data
                continue
            if row.tag != f"{MAIN}row":
                continue
            cells: list[str] = []
            for c in row.iter(f"{MAIN}c"):
                at = column_number(c.get("r")) if c.get("r") else len(cells)
                v = c.find(f"{MAIN}v")
                kind = c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if kind == "inlineStr" else "" if v is None else shared[int(v.text)] if kind == "s" else v.text or ""
                cells += [""] * (at + 1 - len(cells))
                cells[at] = text
            yield cells
            if data is not None:
                data.clear()


def import_sheet(spark: SparkSession, path: str, getnames: bool = True, datarow: int | None = None) -> Table:
    """A worksheet as a table: the driver reads it and holds SHEET_ROWS rows at a time, which are written to the shared folder."""
    start = datarow - 1 if datarow else 1 if getnames else 0
    schema = f"cells array<string>, {ORD} long"
    first, width, parts, held = [], 0, [], []

    def flush() -> None:
        parts.append(materialise(spark.createDataFrame(held, schema).coalesce(1)))
        held.clear()

    for k, cells in enumerate(read_sheet(path)):
        width = max(width, len(cells))
        if k == 0:
            first = cells
        if k >= start:
            held.append((cells, k - start))
            if len(held) == SHEET_ROWS:
                flush()
    if held or not parts:
        flush()
    first = first + [""] * (width - len(first))
    names = variable_names(first) if getnames and first else [f"VAR{k + 1}" for k in range(width)]
    cells = [F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(f"c{k}") for k in range(width)]
    return sniffed(reduce(DataFrame.unionAll, parts).select(*cells, ORD), names)


def export_sheet(table: Table, path: str, putnames: bool = True) -> None:
    def cell(k: int, n: int, v) -> str:
        ref = f"{column_letters(k)}{n}"
        if v is None or v == "":
            return ""
        if isinstance(v, float):
            return f'<c r="{ref}"><v>{general(v)}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'

    rows = chain([table.names] * putnames, table.df.orderBy(ORD).select(*(f"`{n}`" for n in table.names)).toLocalIterator())
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(f"{head}<worksheet {ns}><sheetData>".encode())
            for n, r in enumerate(rows, 1):
                f.write(f'<row r="{n}">{"".join(cell(k, n, v) for k, v in enumerate(r))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")


# --- native binary datasets

# fixed values of the format: the magic number and the signatures of subheaders
MAGIC = bytes.fromhex("000000000000000000000000c2ea8160b31411cfbd92080009c7318c181f1011")
SUBHEADERS = {
    b"\xf7\xf7\xf7\xf7": "rowsize", b"\xf6\xf6\xf6\xf6": "colsize", b"\xfc\xfb\xff\xff": "counts",
    b"\xfd\xff\xff\xff": "text", b"\xff\xff\xff\xff": "names", b"\xfc\xff\xff\xff": "attributes",
    b"\xfe\xfb\xff\xff": "formats", b"\xfe\xff\xff\xff": "lists",
}
ROW_RUNS, ROW_PAIRS = b"SASYZCRL", b"SASYZCR2"


class BinaryDataset:
    """A little-endian binary dataset, 32 or 64 bit: page headers, subheaders, row data.

    Opening it reads pages until all columns are known; rows are read page range by page range.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            self.raw = f.read(1024)
        if self.raw[:32] != MAGIC:
            raise ValueError(f"{path} is not a binary dataset")
        wide = self.raw[32] == 0x33
        shift = 4 if self.raw[35] == 0x33 else 0
        if self.raw[37] != 1:
            raise ValueError(f"{path}: big-endian datasets are not supported")
        self.word = 8 if wide else 4
        self.head, self.page_size = self._int(196 + shift, 4), self._int(200 + shift, 4)
        self.pages = self._int(204 + shift, self.word)
        self.page_bits = 32 if wide else 16
        self.texts: list[bytes] = []
        self.names: list[tuple[int, int, int]] = []
        self.attributes: list[tuple[int, int, int]] = []
        self.formats: list[tuple[tuple[int, int, int], tuple[int, int, int]]] = []
        self.row_length = self.row_count = self.mix_rows = self.columns = 0
        self.compression = b""
        known = 0
        for page in range(self.pages):
            self._page(page, None)
            # formats come last; a dataset without them is known once a page adds nothing
            got = len(self.attributes) + len(self.formats)
            if self.columns and len(self.attributes) >= self.columns and (len(self.formats) >= self.columns or got == known):
                break
            known = got

    def _int(self, at: int, n: int) -> int:
        return int.from_bytes(self.raw[at : at + n], "little")

    def rows_of(self, first: int, last: int) -> Iterator[tuple[int, int, bytes]]:
        """(page, number in the page, bytes) of the rows of pages first to last - 1."""
        for page in range(first, last):
            rows: list[bytes] = []
            self._page(page, rows)
            yield from ((page, k, r) for k, r in enumerate(rows))

    def _page(self, page: int, rows: list[bytes] | None) -> None:
        """One page: its columns (rows is None) or its rows."""
        with open(self.path, "rb") as f:
            f.seek(self.head + page * self.page_size)
            self.raw = f.read(self.page_size)
        b, w = self.page_bits, self.word
        kind, blocks, subs = (self._int(b + k, 2) for k in (0, 2, 4))
        size = 24 if w == 8 else 12
        if kind & 0x0F00 == 0x0100:
            self._data(b + 8, blocks, rows)
            return
        if kind & 0xF000 == 0x9000 or kind == 0x4000 and not subs:
            return
        for k in range(subs):
            at = b + 8 + k * size
            offset, length = self._int(at, w), self._int(at + w, w)
            packed, more = self.raw[at + 2 * w], self.raw[at + 2 * w + 1]
            if not length or packed == 1:
                continue
            body = self.raw[offset : offset + length]
            name = SUBHEADERS.get(body[:4]) if packed != 4 and not (w == 8 and body[4:8] not in (b"\0" * 4, b"\xff" * 4)) else None
            if name:
                if rows is None:
                    self._subheader(name, body)
            elif rows is not None and (self.compression or packed == 4 or more == 1):
                row = expand_row(body, self.row_length, self.compression) if packed == 4 and length < self.row_length else body[: self.row_length]
                if len(row) != self.row_length:
                    raise ValueError(f"{self.path}: a row has {len(row)} of {self.row_length} bytes")
                rows.append(row)
        if kind & 0x0F00 == 0x0200:
            start = b + 8 + subs * size
            self._data(start + (start % 8 and 4), min(self.row_count, self.mix_rows), rows)

    def _data(self, at: int, n: int, rows: list[bytes] | None) -> None:
        if rows is not None:
            rows += [self.raw[at + k * self.row_length : at + (k + 1) * self.row_length] for k in range(n)]

    def _subheader(self, name: str, body: bytes) -> None:
        w = self.word
        num = lambda at, n: int.from_bytes(body[at : at + n], "little")
        if name == "rowsize":
            self.row_length, self.row_count, self.mix_rows = num(5 * w, w), num(6 * w, w), num(15 * w, w)
        elif name == "colsize":
            self.columns = num(w, w)
        elif name == "text":
            text = body[w:]
            if not self.texts:
                for mark in (ROW_RUNS, ROW_PAIRS):
                    if mark in text:
                        self.compression = mark
            self.texts.append(text)
        elif name == "names":
            for k in range((len(body) - 2 * w - 12) // 8):
                self.names.append(tuple(num(w + 8 + 8 * k + i, 2) for i in (0, 2, 4)))
        elif name == "attributes":
            for k in range((len(body) - 2 * w - 12) // (w + 8)):
                at = w + 8 + k * (w + 8)
                self.attributes.append((num(at, w), num(at + w, 4), body[at + w + 6]))
        elif name == "formats":
            at = 3 * w + 22
            self.formats.append((tuple(num(at + k, 2) for k in (0, 2, 4)), tuple(num(at + k, 2) for k in (6, 8, 10))))

    def _text(self, ref: tuple[int, int, int]) -> str:
        block, at, n = ref
        return self.texts[block][at : at + n].decode("latin-1").rstrip("\0 ") if block < len(self.texts) else ""

    def variables(self) -> list[Var]:
        out = []
        for k, (_, n, kind) in enumerate(self.attributes):
            fmt, label = (self._text(self.formats[k][0]), self._text(self.formats[k][1])) if k < len(self.formats) else ("", "")
            out.append(Var(self._text(self.names[k]), "num" if kind == 1 else "char", f"{fmt}." if fmt else None, label or None, n))
        return out

    def values(self, row: bytes) -> tuple:
        out: list = []
        for at, n, kind in self.attributes:
            raw = row[at : at + n]
            if kind == 1:
                v = struct.unpack("<d", b"\0" * (8 - n) + raw)[0]
                out.append(None if v != v else v)
            else:
                out.append(raw.decode("utf-8", "replace").rstrip("\0 "))
        return tuple(out)


@dataclass
class Pages(InputPartition):
    first: int
    last: int


class BinaryReader(DataSourceReader):
    """Page ranges side by side. The file must lie in a folder that the executors see too."""

    PAGES = 256

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Pages]:
        n = BinaryDataset(self.path).pages
        return [Pages(k, min(k + self.PAGES, n)) for k in range(0, n, self.PAGES)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        data = BinaryDataset(self.path)
        for page, k, row in data.rows_of(partition.first, partition.last):
            yield (*data.values(row), (page << 32) + k)


class BinarySource(DataSource):
    """spark.read.format("stepframe-binary").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "stepframe-binary"

    def schema(self) -> str:
        vars_ = BinaryDataset(self.options["path"]).variables()
        return "".join(f"`{v.name}` {'double' if v.kind == 'num' else 'string'}, " for v in vars_) + f"{ORD} long"

    def reader(self, schema) -> BinaryReader:
        return BinaryReader(self.options["path"])


#: Fixed values of the format.
#: Run-length control bytes by their high nibble: what is written, the least count, and whether a count byte follows.
RUNS = {
    0x0: ("literal", 64, True), 0x4: ("repeat", 18, True), 0x6: (b" ", 17, True), 0x7: (b"\0", 17, True),
    0x8: ("literal", 1, False), 0x9: ("literal", 17, False), 0xA: ("literal", 33, False), 0xB: ("literal", 49, False),
    0xC: ("repeat", 3, False), 0xD: (b"@", 2, False), 0xE: (b" ", 2, False), 0xF: (b"\0", 2, False),
}


def expand_row(data: bytes, size: int, kind: bytes) -> bytes:
    """A compressed row of at most `size` bytes. ValueError where it is damaged: an unknown control byte, or data that end within a run."""
    try:
        return _expanded(data, size, kind)
    except (IndexError, KeyError) as x:
        raise ValueError("a compressed row is damaged") from x


def _expanded(data: bytes, size: int, kind: bytes) -> bytes:
    """Run lengths, or control words that mix literals, runs and back-references."""
    out, at = bytearray(), 0
    if kind == ROW_RUNS:
        while at < len(data) and len(out) < size:
            what, least, counted = RUNS[data[at] >> 4]
            n = (data[at] & 15) + least
            at += 1
            if counted:
                n = (n - least) * 256 + data[at] + least
                at += 1
            if what in ("literal", "repeat") and at + (n if what == "literal" else 1) > len(data):
                raise IndexError("the data end within a run")
            if what == "literal":
                out += data[at : at + n]
                at += n
            elif what == "repeat":
                out += data[at : at + 1] * n
                at += 1
            else:
                out += what * n
        return bytes(out[:size])
    word, left = 0, 0
    while at < len(data) and len(out) < size:
        if not left:
            word, left = data[at] << 8 | data[at + 1], 16
            at += 2
            continue
        left -= 1
        if not word >> left & 1:
            out.append(data[at])
            at += 1
            continue
        what, n = data[at] >> 4, data[at] & 15
        following = data[at + 1]
        at += 2
        if what == 0:
            out += bytes([following]) * (n + 3)
        elif what == 1:
            out += data[at : at + 1] * (n + 16 * following + 19)
            at += 1
        else:
            back = n + 3 + 16 * following
            if what == 2:
                what = data[at] + 16
                at += 1
            if back > len(out):
                raise IndexError("a reference before the row")
            for _ in range(what):
                out.append(out[-back])
    return bytes(out[:size])


def open_binary(spark: SparkSession, path: str) -> Table:
    spark.dataSource.register(BinarySource)
    return Table(spark.read.format(BinarySource.name()).load(path), BinaryDataset(path).variables(), (), True)
