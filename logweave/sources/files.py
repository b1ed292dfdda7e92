"""Lines of files: plain text by Spark's reader, in splits; other encodings, xz and spreadsheets as whole files."""

import functools
import itertools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Unicode line boundaries besides line feed and carriage return.
OTHER_BREAKS = r"[\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
LINES = "path string, line_no long, raw string"


def text_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines of UTF-8 files, plain, .gz or .bz2.

    A file's splits are numbered apart; only one count for each split is summed up, so one huge file is many tasks.
    """
    rows = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.posexplode(F.split("value", OTHER_BREAKS)).alias("part", "raw"))
    sizes = rows.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("path", "block").orderBy("id", "part")) - 1
    out = rows.withColumn("place", place).join(starts, ["path", "block"])
    return out.select("path", (F.col("start") + F.col("place")).alias("line_no"), "raw")


def decode_lines(data: bytes):
    from .catalog import encoding

    name, skip = encoding(data[:4])
    return data[skip:].decode(name, "replace").splitlines()


def unpack(kind: str, data: bytes, limit: int):
    """Up to `limit` bytes of a compressed file, what came before damage included; and whether all went well."""
    import bz2
    import lzma
    import zlib

    part = {"gzip": lambda: zlib.decompressobj(31), "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind]
    out, size = [], 0
    while data and size < limit:
        reader = part()
        try:
            piece = reader.decompress(data, limit - size)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return b"".join(out), False
        out.append(piece)
        size += len(piece)
        if not reader.eof:
            return b"".join(out), size >= limit
        data = reader.unused_data
    return b"".join(out), True


def intact(path: str, kind: str, step: int = 1 << 20) -> bool:
    """Whether a compressed file can be read to its end, `step` bytes at a time."""
    import bz2
    import gzip
    import lzma
    import zlib

    try:
        with {"gzip": gzip, "bzip2": bz2, "xz": lzma}[kind].open(path, "rb") as f:
            while f.read(step):
                pass
    except (OSError, EOFError, zlib.error, lzma.LZMAError, ValueError):
        return False
    return True


def damaged(spark: SparkSession, files) -> list:
    """Paths of the compressed files that cannot be read to their end; one file in a task, no file is held whole."""
    packed = [(f.path, f.kind) for f in files if f.kind in ("gzip", "bzip2", "xz")]
    if not packed:
        return []

    def run(frames):
        for frame in frames:
            yield frame.loc[[not intact(p, k) for p, k in zip(frame["path"], frame["kind"])], ["path"]]

    rows = spark.createDataFrame(packed, "path string, kind string").repartition(min(len(packed), 1000), "path")
    return sorted(r.path for r in rows.mapInPandas(run, "path string").collect())  # at most one row for each file of the catalog


def sheet_lines(data: bytes, most_repeats: int = 4096):
    """Rows of an .ods file, cells joined by tabs; a banner before each sheet; trailing blanks dropped."""
    import io
    import zipfile
    import xml.etree.ElementTree as ET

    table, text = ("{urn:oasis:names:tc:opendocument:xmlns:%s:1.0}" % x for x in ("table", "text"))
    times = lambda e, what: min(most_repeats, max(1, int(e.get(f"{table}number-{what}-repeated", "1"))))
    root = ET.parse(zipfile.ZipFile(io.BytesIO(data)).open("content.xml"))
    for sheet in root.iter(f"{table}table"):
        out = []
        for row in sheet.iter(f"{table}table-row"):
            cells = []
            for cell in row:
                if cell.tag in (f"{table}table-cell", f"{table}covered-table-cell"):
                    cells += [" ".join("".join(p.itertext()) for p in cell.iter(f"{text}p"))] * times(cell, "columns")
            while cells and not cells[-1]:
                cells.pop()
            out += ["\t".join(cells)] * times(row, "rows")
        while out and not out[-1]:
            out.pop()
        if out:
            yield f"--- {sheet.get(f'{table}name') or ''} ---"
            yield from out


def whole_file(kinds: dict, limit: int, most, frames):
    for frame in frames:
        for path, data in zip(frame["path"], frame["content"]):
            kind = kinds.get(path.split("/")[-1], "text")
            if kind == "ods":
                lines = list(itertools.islice(sheet_lines(bytes(data)), most))
            else:
                lines = decode_lines(bytes(data) if kind == "text" else unpack(kind, bytes(data), limit)[0])
            yield pd.DataFrame({"path": path, "line_no": range(len(lines)), "raw": lines})


def whole_files(spark: SparkSession, files, limit: int = 64 << 20, first=None) -> DataFrame:
    """Lines of files that Spark's text reader cannot decode, one file in a task; at most `limit` unpacked bytes each,
    and the first `first` lines of spreadsheets (None: all)."""
    kinds = {f.path.split("/")[-1]: f.kind for f in files}
    read = spark.read.format("binaryFile").load([f.path for f in files]).select("path", "content")
    return read.mapInPandas(functools.partial(whole_file, kinds, limit, first), LINES)


def read_files(spark: SparkSession, files, first=None) -> DataFrame:
    """(source, source_idx, member, member_rank, set_base, line_no, raw) of catalog files, sources in the given order."""
    plain = [f for f in files if f.encoding == "utf-8" and f.kind in ("text", "gzip", "bzip2")]
    other = [f for f in files if f not in plain]
    parts = ([text_lines(spark, [f.path for f in plain])] if plain else []) + ([whole_files(spark, other, first=first)] if other else [])
    lines = strip_bom(functools.reduce(DataFrame.unionByName, parts)).withColumn("member", F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/"))
    bases = list(dict.fromkeys(f.set_base or f.path for f in files))
    facts = [(f.path, f.set_base or f.path, bases.index(f.set_base or f.path), f.set_base, sorted(g.member_rank for g in files if g.set_base == f.set_base).index(f.member_rank)) for f in files]
    facts = spark.createDataFrame(facts, "member string, source string, source_idx int, set_base string, member_rank int")
    return lines.drop("path").join(F.broadcast(facts), "member")  # one row for each file of the catalog


def strip_bom(lines: DataFrame) -> DataFrame:
    return lines.withColumn("raw", F.when(F.col("line_no") == 0, F.regexp_replace("raw", r"^\ufeff", "")).otherwise(F.col("raw")))


def as_one_log(lines: DataFrame, budget) -> DataFrame:
    """Lines of rotated sets as one log each: `budget` lines (a number or a column), newest members first, numbered oldest first."""
    from ..operators.views import rotated_tail

    return rotated_tail(lines, budget).withColumn("line_no", F.col("pos").cast("long")).drop("pos")
