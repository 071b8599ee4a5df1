"""Text sources: JSON lines, lists, tables, and what file names say."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import NO_TEXT, collapse, strip, word_count
from tallyloom.operators.records import numbered
from tallyloom.schema import POST
from tallyloom.sources.paths import below, matching


def discover(inputs: list[str] | str, patterns: tuple[str, ...] = ("*",), recursive: bool = False, spark: SparkSession | None = None) -> list[str]:
    """Files named by paths, folders or globs on any file system, each once, in order; of folders those whose name fits one of the
    patterns, with recursive at any depth."""
    spark = spark or SparkSession.active()
    found = set()
    fits = lambda f: any(fnmatch.fnmatch(f.rsplit("/", 1)[-1], p) for p in patterns)
    for given in [inputs] if isinstance(inputs, str) else inputs:
        for path, folder in matching(spark, given):
            if not folder:
                found.add(path)
            elif recursive:
                found.update(f for f in below(spark, path) if fits(f))
            else:
                found.update(f for f, inner in matching(spark, f"{path.rstrip('/')}/*") if not inner and fits(f))
    return sorted(found)


def period_of(name: str) -> tuple[int | None, int | None]:
    """(year, month) in a file name; None where it has none."""
    m = re.search(r"(?<!\d)((?:19|20)\d{2})(?:[-_]?(0[1-9]|1[0-2]))?(?!\d)", os.path.basename(name))
    return (int(m[1]), int(m[2]) if m[2] else None) if m else (None, None)


def within_years(paths: list[str], first: int, last: int) -> list[str]:
    """Only these files are opened at all; one without a year in its name is left out."""
    return [p for p in paths if (y := period_of(p)[0]) is not None and first <= y <= last]


def kind_of(path: Column) -> Column:
    """comments, submissions or unknown, by the path."""
    low = F.lower(path)
    return F.when(low.contains("comment") | low.rlike(r"(^|/)rc[_-]"), "comments").when(low.contains("submission") | low.rlike(r"(^|/)rs[_-]"), "submissions").otherwise("unknown")


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line_no, value): lines with their numbers from 1. A file may be read in any number of splits: lines are counted per
    split, and a line's number is those before its split and its place in it."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("u"), "value")
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))
    return rows.join(before.select("file", "block", "before"), ["file", "block"]).select("file", (F.col("before") + F.row_number().over(W.partitionBy("file", "block").orderBy("u"))).alias("line_no"), "value")


def parse_lines(lines: DataFrame, schema: T.StructType = POST, mode: str = "PERMISSIVE") -> DataFrame:
    """lines (value, ...) with the fields of schema and raw, the line itself. Blank lines are skipped; malformed ones too, or with
    mode FAILFAST they end the job."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", full if mode == "PERMISSIVE" else schema, {"mode": mode, "columnNameOfCorruptRecord": "_corrupt"}))
    if mode == "PERMISSIVE":
        rows = rows.where("r IS NOT NULL AND r._corrupt IS NULL")
    return rows.select(*[c for c in lines.columns if c != "value"], F.col("value").alias("raw"), *[F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields])


def read_jsonl(spark: SparkSession, paths: list[str] | str, schema: T.StructType = POST, mode: str = "PERMISSIVE", numbers: bool = False) -> DataFrame:
    """JSON lines, plain or gzip. With numbers come file, line_no and post_id: the record's id, else its name, else row_<line>."""
    paths = [paths] if isinstance(paths, str) else paths
    if not numbers:
        return parse_lines(spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value"), schema, mode)
    rows = parse_lines(numbered_lines(spark, paths), schema, mode)
    given = [F.when(F.col(c) != "", F.col(c)) for c in ("id", "name") if c in schema.names]
    return rows.withColumn("post_id", F.coalesce(*given, F.concat(F.lit("row_"), F.col("line_no").cast("string"))))


def malformed_count(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One row: lines, blank ones, and those that aren't whole JSON."""
    v = F.col("value")
    return spark.read.text(paths).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.trim(v) == "").alias("blank"), F.count_if((F.trim(v) != "") & F.try_parse_json(v).isNull()).alias("malformed"))


def posts(records: DataFrame, min_words: int = 10, no_author: tuple[str, ...] = ("[deleted]", "AutoModerator"), no_text: tuple[str, ...] = NO_TEXT) -> DataFrame:
    """The unified view: records with post_type (comment if the body isn't blank, else submission) and text (the body, or title and
    selftext), white space collapsed, without placeholders and texts of fewer than min_words words."""
    has_body = F.coalesce(F.trim("body") != "", F.lit(False))
    some = lambda c: F.when(F.trim(c) != "", F.col(c))
    text = collapse(F.when(has_body, F.col("body")).otherwise(F.concat_ws(" ", some("title"), some("selftext"))))
    rows = records.withColumn("post_type", F.when(has_body, "comment").otherwise("submission")).withColumn("text", text)
    return rows.where(F.col("author").isNotNull() & (F.col("author") != "") & ~F.col("author").isin(*no_author) & (F.col("text") != "") & ~F.col("text").isin(*no_text)).where(word_count("text") >= min_words)


def nested(spark: SparkSession, paths: list[str] | str, field: str, schema: T.StructType) -> DataFrame:
    """Per-author JSON lines {"author": ..., field: [...]}, flat: author and the record's fields, one row per record. The record's
    own author, if any, is record_author."""
    outer = T.StructType([T.StructField("author", T.StringType()), T.StructField(field, T.ArrayType(schema))])
    rows = spark.read.schema(outer).json(paths).select("author", F.explode(field).alias("r"))
    return rows.select("author", *[F.col(f"r.`{f.name}`").alias("record_author" if f.name == "author" else f.name) for f in schema.fields])


def prefix_author(line: Column, n: int = 100) -> Column:
    """The author named in the first n characters of a JSON line, without parsing it."""
    text = F.regexp_extract(F.substring(line, 1, n), r'^\s*\{\s*"author"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    return F.get_json_object(F.concat(F.lit('{"a":"'), text, F.lit('"}')), "$.a")


def read_list(spark: SparkSession, path: str, name: str = "author") -> DataFrame:
    """One id per line, trimmed, blanks dropped, each once."""
    return spark.read.text(path).select(strip("value").alias(name)).where(F.col(name) != "").distinct()


def read_table(spark: SparkSession, path: str, required: tuple[str, ...], schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header; missing required columns are an error that names them."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    head = spark.read.text(path).limit(1).collect()
    names = {c.strip().strip('"') for c in (head[0][0].split(",") if head else [])}
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return df


def check_pairs(pairs: DataFrame) -> DataFrame:
    """Labeled pairs whose label is 0 or 1 and whose texts aren't blank; any other row is an error."""
    bad = pairs.where(F.col("label").isNull() | ~F.col("label").isin(0, 1) | F.col("text_a").isNull() | F.col("text_b").isNull() | (F.trim("text_a") == "") | (F.trim("text_b") == "")).count()
    if bad:
        raise ValueError(f"{bad} labeled pairs are invalid")
    return pairs


def head_in_order(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n data lines of a CSV file in the file's order, as (line_no, value)."""
    return numbered_lines(spark, [path]).where((F.col("line_no") > 1) & (F.col("line_no") <= n + 1))


def tail_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): the whole number at the end of each line of a ragged CSV file, the header aside."""
    rows = numbered_lines(spark, [path]).where("line_no > 1")
    return rows.select("line_no", F.regexp_extract("value", r",\s*(-?\d+)\s*,*\s*$", 1).alias("x")).where("x <> ''").select("line_no", F.col("x").cast("long").alias("value"))


def zip_by_place(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Rows of both tables with the same place in their order, as far as the shorter goes."""
    return numbered(left, [F.col(order)]).join(numbered(right, [F.col(order)]).drop(order), "place")


def community_of_file(path: Column) -> Column:
    """The stem before its last underscore: <community>_<suffix>. A community whose own name has one and no suffix is cut, too."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1), r"_[^_]*$", "")
