"""Payloads of fetched pages: decompression, character sets, archives and delimited rows."""

from __future__ import annotations

import csv
import gzip
import io
import itertools
import json
import os
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from ..plans.storage import bound_batches, written


class PayloadError(ValueError):
    """A payload that cannot be read safely."""


def decoded(content: bytes, encoding: str | None = None) -> bytes:
    """Content without gzip, whether a header or its first bytes say so."""
    return gzip.decompress(content) if (encoding or "").lower() == "gzip" or content[:2] == b"\x1f\x8b" else content


def text(content: bytes) -> str:
    """UTF-8 without a byte order mark, else windows-1252."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


#: Bytes that an archive's files may have in all when unpacked.
UNZIPPED_BYTES = 1 << 30


def unzipped(content: bytes) -> Iterator[tuple[str, bytes]]:
    """The files of an archive, one after another; one that points outside of it, or an archive that unpacks to more than ``UNZIPPED_BYTES``, is an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(info.file_size for info in z.infolist()) > UNZIPPED_BYTES:
            raise PayloadError("the archive unpacks to too many bytes")
        for info in z.infolist():
            name = posixpath.normpath(info.filename.replace("\\", "/"))
            if name.startswith(("/", "..")) or ":" in name:
                raise PayloadError(f"unsafe archive entry: {info.filename}")
            if not info.is_dir():
                yield name, z.read(info)


def csv_rows(body: str) -> Iterator[dict[str, str]]:
    """Rows by the header's names, trimmed; short rows are filled with blanks, blank rows left out."""
    rows = csv.reader(io.StringIO(body, newline=""))
    header = [h.strip() for h in next(rows, [])]
    for r in rows:
        cells = [c.strip() for c in r]
        if any(cells):
            yield dict(zip(header, cells + [""] * (len(header) - len(cells))))


# Fixed value: the header of location files that come without one.
LOCATION_HEADER = "Change,Country,Location,Name,NameWoDiacritics,Subdivision,Function,Status,Date,IATA,Coordinates,Remarks"


def location_files(content: bytes) -> Iterator[str]:
    for name, body in unzipped(content):
        if name.lower().endswith(".csv"):
            t = text(body)
            first = t.split("\n", 1)[0].lower()
            yield t if "change" in first or "country" in first else f"{LOCATION_HEADER}\n{t}"


def raw_rows(pages: DataFrame, kind: str) -> DataFrame:
    """Rows of delimited pages: the page's columns but its content, and ``raw``, the row as a map. ``kind``: csv, or zip for location files.

    Pages: ``content`` binary, ``content_encoding``, ``source_version``, ``page_number``. Rows leave the worker as they are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b.itertuples(index=False):
                bodies = location_files(p.content) if kind == "zip" else [text(decoded(p.content, p.content_encoding))]
                part = []
                for body in bodies:
                    for r in csv_rows(body):
                        part.append((p.page_number, p.source_version, json.dumps(r, ensure_ascii=False)))
                        if len(part) >= 5000:
                            yield pd.DataFrame(part, columns=["page_number", "source_version", "row"])
                            part = []
                if part:
                    yield pd.DataFrame(part, columns=["page_number", "source_version", "row"])

    bound_batches(pages.sparkSession)
    rows = pages.select("content", "content_encoding", "source_version", "page_number").mapInPandas(run, "page_number int, source_version string, row string")
    return rows.withColumn("raw", F.from_json("row", "map<string,string>"))


def json_pages(pages: DataFrame) -> DataFrame:
    """Pages with their ``body`` as text, gzip undone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_number": b["page_number"], "source_version": b["source_version"], "body": [text(decoded(c, e)) for c, e in zip(b["content"], b["content_encoding"])]})

    bound_batches(pages.sparkSession)
    return pages.select("content", "content_encoding", "source_version", "page_number").mapInPandas(run, "page_number int, source_version string, body string")


# What Spark's writers put in place of a null in a file's name, and the characters that they escape there.
NO_NAME, ESCAPED = "__HIVE_DEFAULT_PARTITION__", re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def page_name(column: str, value: str) -> str:
    return f"{column}={ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', value)}"


def write_page_files(lines: DataFrame, folder: str) -> None:
    """Pages as files of ``folder``, which is new: one each, named by the first column. The second column has their lines; those of a page stand together in a partition.

    In a store of local paths (a disk, or one that all machines mount) tasks write the files themselves: there Hadoop starts two processes for each file and one for each folder that it
    makes. A file is named once it is whole, so a task that runs again puts the same in its place. In other stores Spark writes them, each in a folder named alike, so the order of names is the same.
    """
    spark, (column, line) = lines.sparkSession, lines.columns
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file":
        lines.write.partitionBy(column).text(folder)
        return
    store.mkdirs(where)
    path = where.toUri().getPath()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, n = (r for b in batches for r in zip(b["name"], b["line"])), 0
        for name, page in itertools.groupby(rows, lambda r: r[0]):
            part = f"{path}/.{uuid.uuid4().hex}"  # readers pass over names with a dot
            try:
                with open(part, "wb") as out:
                    out.writelines(x + b"\n" for _, x in page)
                os.replace(part, f"{path}/{page_name(column, name)}")
            except BaseException:
                if os.path.exists(part):
                    os.remove(part)
                raise
            n += 1
        yield pd.DataFrame({"pages": [n]})

    bound_batches(spark)
    named = lines.select(F.coalesce(F.col(column).cast("string"), F.lit(NO_NAME)).alias("name"), F.coalesce(line, F.lit("")).cast("binary").alias("line"))
    named.mapInPandas(run, "pages long").agg(F.sum("pages")).collect()


def page_files(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """Fetched pages kept as files, in ``folder`` or folders in it: one page each, numbered in the order of their names.

    Files are met twice: for their names, which are numbered by ranges, and for their contents, which then get their numbers in a join.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    numbers = numbered(written(f.select("path").repartition("path"), "names"), ["path"], "page_number").withColumn("page_number", F.col("page_number").cast("int"))
    return f.join(numbers.hint("shuffle_hash"), "path").select("content", F.lit(None).cast("string").alias("content_encoding"), F.lit(version).alias("source_version"), "page_number")
