"""Delivery folders as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as TY

from claimgrid.functions import text as T
from claimgrid.functions.keyed import first_k
from claimgrid.functions.numbers import number
from claimgrid.rules import values as V

K = "project_id"
EOL = r"\r\n|\r|\n"


def relative(path: str, root: str) -> Column:
    """Project id (the first folder below the root) and path inside the project from a file URI."""
    tail = F.regexp_replace(F.regexp_replace(path, r"^[a-z0-9]+:/+", "/"), "^" + root.rstrip("/").replace(".", r"\."), "")
    parts = F.filter(F.split(F.url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))), "/"), lambda p: p != "")
    below = F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))
    return F.struct(F.get(parts, F.lit(0)).alias(K), F.concat_ws("/", below).alias("path"), below.alias("parts"))


def scan_files(spark: SparkSession, root: str, ignored: list[str] = V.IGNORED_DIRS) -> DataFrame:
    """File inventory of every project below ``root``. Only metadata columns are selected, so contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    d = raw.select(relative("path", root).alias("r"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("path").alias("uri"))
    d = d.where(~F.arrays_overlap("r.parts", F.array(*map(F.lit, ignored))) & (F.col("r.path") != ""))
    module = F.when(F.size("r.parts") > 1, F.get("r.parts", F.lit(0)))
    return d.select(f"r.{K}", "r.path", module.alias("module"), T.path_suffix("r.path").alias("ext"), "size", "modified", "uri")


def scan_dirs(files: DataFrame) -> DataFrame:
    """Every folder on the way to a file, with its own name."""
    parts = T.path_parts("path")
    n = F.size(parts) - 1
    ups = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat_ws("/", F.slice(parts, F.lit(1), i)).alias("p"), F.get(parts, i - 1).alias("n"))))
    return files.select(K, F.explode(ups).alias("d")).select(K, F.col("d.p").alias("dir_path"), F.col("d.n").alias("dir")).distinct()


def scan_contents(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """Contents of the files with the given suffixes. The name filter runs before contents are opened."""
    glob = "*{" + ",".join(sorted({s for x in suffixes for s in (x, x.upper())})) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return raw.select(relative("path", root).alias("r"), "content").select(f"r.{K}", "r.path", "content")


def decode_text(content="content") -> Column:
    """UTF-8 (a byte-order mark is dropped), else GBK where the session can decode it, else Latin-1.

    GBK needs ``spark.sql.legacy.javaCharsets``; without it Spark refuses the name and Latin-1 is used.
    """
    c = T.col(content)
    utf8 = F.regexp_replace(F.decode(c, "UTF-8"), "^﻿", "")
    gbk = SparkSession.getActiveSession().conf.get("spark.sql.legacy.javaCharsets", "false") == "true"
    if not gbk:
        return F.when(F.is_valid_utf8(c), utf8).otherwise(F.decode(c, "ISO-8859-1"))
    as_gbk = F.decode(c, "GBK")
    return F.when(F.is_valid_utf8(c), utf8).when(~as_gbk.contains("�"), as_gbk).otherwise(F.decode(c, "ISO-8859-1"))


def to_lines(texts: DataFrame, keys: list[str], text: str = "text", limit: int = -1) -> DataFrame:
    """Whole texts to numbered lines, from 1; all line ends are folded."""
    return texts.select(*keys, F.posexplode(F.split(text, EOL, limit)).alias("_p", "text")).select(*keys, (F.col("_p") + 1).cast("long").alias("line"), "text")


def scan_lines(contents: DataFrame, keys: list[str]) -> DataFrame:
    return to_lines(contents.withColumn("text", decode_text()), keys)


def scan_code(spark: SparkSession, root: str) -> DataFrame:
    d = scan_contents(spark, root, V.CODE_EXTS).withColumn("text", decode_text())
    lang = F.when(T.path_suffix("path").isin(".r", ".rmd", ".qmd"), "R").otherwise("Python")
    return d.select(K, "path", lang.alias("lang"), "text")


FIELD, RECORD = "\x1f", "\x1e"
SEPARATORS = [",", "\t", ";"]


def scan_tables(spark: SparkSession, root: str, suffixes: list[str] = [".csv", ".tsv", ".txt"], sep: str | None = None) -> DataFrame:
    """Rows of all delimited files below ``root``: project_id, path, row_no, header, cells (name to text).

    Headers differ from file to file, so files are read whole, one row per file. Without ``sep`` the separator is the
    most frequent of comma, tab and semicolon outside quotes in the first line (ties: in this order)."""
    return parse_tables(scan_contents(spark, root, suffixes).withColumn("text", decode_text()), sep)


def _records(texts: DataFrame, sep: str | None) -> DataFrame:
    """project_id, path, records: each record a string with its fields cut by FIELD, quotes resolved.

    The text is cut at its quotes: every second piece stands inside quotes and keeps its separators and line ends,
    and an empty piece between two of these is a doubled quote. All steps are linear in the text."""
    first = F.regexp_replace(F.regexp_extract("text", "^[\r\n]*([^\r\n]*)", 1), '"[^"]*"', "")
    counts = [F.struct((F.length(first) - F.length(F.replace(first, F.lit(x), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(x).alias("sep")) for i, x in enumerate(SEPARATORS)]
    d = texts.select(K, "path", F.split(F.col("text"), '"', -1).alias("_p"), (F.array_max(F.array(*counts))["sep"] if sep is None else F.lit(sep)).alias("_s"))
    n = F.size("_p")

    def piece(p: Column, i: Column) -> Column:
        bare = F.when(i > 0, F.regexp_replace(p, "^ +", "")).otherwise(p)
        bare = F.when(i < n - 1, F.regexp_replace(bare, " +$", "")).otherwise(bare)
        outside = F.replace(F.regexp_replace(bare, EOL, RECORD), F.col("_s"), F.lit(FIELD))
        return F.when(i % 2 == 1, p).when((p == "") & (i > 0) & (i < n - 1), '"').otherwise(outside)

    whole = F.array_join(F.transform("_p", piece), "")
    return d.select(K, "path", F.filter(F.split(whole, RECORD, -1), lambda r: F.length(F.trim(r)) > 0).alias("_r"))


def parse_tables(texts: DataFrame, sep: str | None = None) -> DataFrame:
    d = _records(texts, sep).withColumn("header", F.split(F.get("_r", F.lit(0)), FIELD, -1))
    body = d.select(K, "path", "header", F.posexplode(F.when(F.size("_r") > 1, F.slice("_r", F.lit(2), F.size("_r")))).alias("row_no", "_line"))
    vals = body.withColumn("_v", F.split("_line", FIELD, -1))
    pad = F.transform("header", lambda h, i: F.struct(F.concat(h, F.when((F.array_position("header", h) - 1) < i, F.concat(F.lit("."), i.cast("string"))).otherwise("")).alias("key"), F.get("_v", i).alias("value")))
    return vals.select(K, "path", (F.col("row_no") + 1).cast("long").alias("row_no"), "header", F.map_from_entries(pad).alias("cells"))


def table_meta(texts: DataFrame, sep: str | None = None) -> DataFrame:
    """Header, number of columns and number of data rows; a file with only a header has none."""
    d = _records(texts, sep).withColumn("header", F.split(F.get("_r", F.lit(0)), FIELD, -1))
    return d.select(K, "path", "header", F.size("header").alias("cols"), F.greatest(F.size("_r") - 1, F.lit(0)).cast("long").alias("rows"))


def probe_png(contents: DataFrame, smallest: int = V.MIN_PNG_SIDE) -> DataFrame:
    """Width and height from the first 24 bytes of a PNG; flagged when a side is below the limit."""
    head = F.substring("content", 1, 8) == F.unhex(F.lit("89504E470D0A1A0A"))

    def side(at: int) -> Column:
        return F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")

    d = contents.where(head).select(K, "path", side(17).alias("width"), side(21).alias("height"))
    return d.withColumn("too_small", (F.col("width") < smallest) | (F.col("height") < smallest))


def fingerprint(contents: DataFrame) -> DataFrame:
    return contents.select(K, "path", F.sha2("content", 256).alias("hash"))
