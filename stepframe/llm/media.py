"""Media columns: payload bytes stored as lossless WebP images, read back to pixel arrays, with features of the samples.

A payload's bytes are the 8-bit samples of ARGB pixels (blue first), 16 pixels to a row, in tiles of at most 1024 rows;
a medium is its tiles' files one after the other. Tiles keep every image small, however long the payload. The codec
is java/WebpLossless.java, a JVM function from binary to binary. Its encoder chooses for each tile by counted bits:
a palette where there are few colours; else predictor modes for each block, cross-colour factors for bands of rows or
subtract-green, each where it saves; back-references from hash chains; and the size of the colour cache. Its decoder
reads any lossless WebP file: prefix codes with meta groups, back-references, colour cache and all four transforms.

Defined results: a null or empty text is one row of 64 zero bytes; equal payloads get equal media and features; rows
that repeat a doc_id, and rows without one, keep media of their own; a medium that is not a sequence of lossless WebP
files raises ValueError (and fails the job that reads it). decode_media reads media without Spark.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.llm.jvm import webp
from stepframe.llm.webp_lossless import Broken, decode_many
from stepframe.shared import arrow_rows, materialise

ROW = 64
#: Rows of an Arrow batch that bring a payload each.
ARROW_ROWS = 256


def padded(text: Column) -> Column:
    """UTF-8 bytes with zeros up to a positive multiple of ROW."""
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    size = F.length(raw)
    more = F.when(size == 0, ROW).otherwise(F.pmod(-size, F.lit(ROW)))
    return F.concat(raw, F.substring(F.lit(bytes(ROW)), F.lit(1), more))


def split_files(medium: bytes) -> list[bytes]:
    """The RIFF files of a medium."""
    out, at = [], 0
    while at < len(medium):
        if medium[at : at + 4] != b"RIFF" or at + 8 > len(medium):
            raise Broken("not a sequence of WebP files")
        size = 8 + int.from_bytes(medium[at + 4 : at + 8], "little")
        out.append(medium[at : at + size])
        at += size
    if not out:
        raise Broken("an empty medium")
    return out


def decode_media(media: list[bytes]) -> list[list[np.ndarray]]:
    """The ARGB pixel arrays of every medium; all their images are decoded side by side."""
    files = [split_files(m) for m in media]
    flat = iter(decode_many([f for fs in files for f in fs]))
    return [[next(flat) for _ in fs] for fs in files]


def samples(images: list[np.ndarray]) -> np.ndarray:
    """The stored bytes: the samples of the pixels."""
    return np.concatenate([i.astype("<u4").view(np.uint8).ravel() for i in images])


def pixel_arrays(raw: bytes) -> list[np.ndarray]:
    """The pixel arrays (height, width) that the JVM decoder wrote."""
    words, out, at = np.frombuffer(raw, "<u4"), [], 0
    while at < len(words):
        width, height = int(words[at]), int(words[at + 1])
        out.append(words[at + 2 : at + 2 + width * height].reshape(height, width))
        at += 2 + width * height
    return out


def feature(images: list[np.ndarray]) -> str:
    """Rows, sum of samples, counts of samples by their upper three bits, and sum of steps between rows."""
    planes = [i.astype("<u4").view(np.uint8).reshape(i.shape[0], -1) for i in images]
    counts = sum(np.bincount((p >> 5).ravel(), minlength=8) for p in planes)
    steps = sum(int(np.abs(np.diff(p.astype(np.int16), axis=0)).sum(dtype=np.int64)) for p in planes)
    return f"{sum(p.shape[0] for p in planes)}|{sum(int(p.sum(dtype=np.int64)) for p in planes)}|{','.join(map(str, counts.tolist()))}|{steps}"


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary), written in the shared folder."""
    text = docs["text"].cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), padded(text).alias("payload"))
    return materialise(rows.select("doc_id", "n_bytes", webp(docs.sparkSession, decode=False)("payload").alias("media")))


def _read(stored: DataFrame, schema: str, row) -> DataFrame:
    """doc_id, n_bytes and what row(pixel arrays, medium) gives, of stored media."""
    kinds = [pa.int64() if k == "long" else pa.binary() if k == "binary" else pa.string() for _, k in (c.split() for c in schema.split(", "))]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(pixel_arrays(p), m) for m, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", *names])

    pixels = stored.select("doc_id", "n_bytes", "media", webp(stored.sparkSession, decode=True)("media").alias("pixels"))
    return pixels.mapInArrow(run, f"doc_id long, n_bytes long, {schema}")


def read_media(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload binary, feature string, media binary) of stored media."""
    return _read(stored, "payload binary, feature string, media binary", lambda images, medium: (samples(images).tobytes(), feature(images), medium))


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: from the media stored and read back."""

    def row(images: list[np.ndarray], medium: bytes) -> tuple:
        raw = samples(images).tobytes()
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-ROW:]), len(medium), hashlib.sha256(medium).hexdigest(), feature(images)

    stored = store_media(docs)
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        return materialise(_read(stored, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", row))
