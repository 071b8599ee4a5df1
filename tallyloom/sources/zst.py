"""Zstandard archives with windows of up to 2 GB, which the built-in reader refuses, and their integrity."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyloom.sources.paths import matching

MAGIC = bytes.fromhex("28b52ffd")
WINDOW = 1 << 31


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _opened(path: str):
    """A stream of the bytes of a local file, or of one at an address that Arrow's file systems know."""
    if "://" not in path:
        return open(path.removeprefix("file:"), "rb")
    from pyarrow.fs import FileSystem

    system, inner = FileSystem.from_uri(path)
    return system.open_input_stream(inner, compression=None)


def lines_of(path: str, window: int = WINDOW) -> Iterator[tuple[int, str | None, str | None]]:
    """(line number, line, error): all lines that can be read; a broken archive ends with a row that holds the error."""
    import zstandard

    n = 0
    with _opened(path) as f:
        try:
            reader = zstandard.ZstdDecompressor(max_window_size=window).stream_reader(f, read_across_frames=True)
            for line in io.TextIOWrapper(reader, encoding="utf-8", errors="replace", newline="\n"):
                n += 1
                yield n, line.rstrip("\r\n"), None
        except (zstandard.ZstdError, EOFError, OSError) as e:
            yield n + 1, None, f"Corrupted: {e}"


class ZstLines(DataSource):
    """format("zst_lines").load(paths, one a line): file, line_no, value, error. One archive is one task, as it can't be split;
    repartition after reading. A task holds the archive's window, up to 2 GB."""

    @classmethod
    def name(cls) -> str:
        return "zst_lines"

    def schema(self) -> str:
        return "file string, line_no long, value string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths = options["path"].split("\n")
        self.window = int(options.get("maxWindow", WINDOW))

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        for n, line, error in lines_of(partition.path, self.window):
            yield partition.path, n, line, error


def read_zst(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, line_no, value, error) of the archives; rows with an error say which archives are broken after how many lines."""
    spark.dataSource.register(ZstLines)
    found = [q for p in ([paths] if isinstance(paths, str) else paths) for q in [f for f, folder in matching(spark, p) if not folder] or [p]]
    return spark.read.format("zst_lines").load("\n".join(found))


def check_whole(path: str) -> tuple[str, int, str]:
    """(status, lines, message): OK, or CORRUPTED with the error, from reading the whole archive."""
    n, error = 0, None
    for n, _, error in lines_of(path):
        pass
    if error is None:
        with _opened(path) as f:
            if f.read(4) != MAGIC:
                return "CORRUPTED", n, "no zstandard frame"
        return ("OK", n, "") if _ends_whole(path) else ("CORRUPTED", n, "the last frame is cut off")
    return "CORRUPTED", n - 1, error


def _ends_whole(path: str) -> bool:
    """Whether the last frame is complete: reading up to the end leaves no frame open."""
    import zstandard

    d = None
    with _opened(path) as f:
        while chunk := f.read(1 << 20):
            while chunk:
                if d is None:
                    d = zstandard.ZstdDecompressor(max_window_size=WINDOW).decompressobj()
                try:
                    d.decompress(chunk)
                except zstandard.ZstdError:
                    return False
                if d.eof:
                    chunk, d = d.unused_data, None
                else:
                    chunk = b""
    return d is None


def check_head(path: str) -> tuple[str, int, str]:
    """(status, lines, message) from the first bytes only: BAD_HEADER without the magic number, VALID with two readable lines,
    SHORT_OK with fewer, CORRUPTED if they can't be read."""
    try:
        with _opened(path) as f:
            if f.read(4) != MAGIC:
                return "BAD_HEADER", 0, "no zstandard frame"
    except OSError as e:
        return "CORRUPTED", 0, str(e)
    n = 0
    for n, _, error in lines_of(path):
        if error:
            return "CORRUPTED", n - 1, error
        if n == 2:
            return "VALID", 2, ""
    return "SHORT_OK", n, ""


def check_archives(spark: SparkSession, paths: list[str], whole: bool = False) -> DataFrame:
    """(file, status, lines, message) of each archive, one task per archive."""
    test = check_whole if whole else check_head

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *test(p)) for p in b["file"]], columns=["file", "status", "lines", "message"])

    files = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, len(paths)))
    return files.mapInPandas(run, "file string, status string, lines long, message string")
