"""Opening tables: DataFrames, files, folders and glob patterns.

Files are listed through Hadoop's file system, so paths may lie in any store that
Spark reaches. Formats: parquet, CSV and SAS (sas7bdat, xpt).
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..settings import SourceOptions

#: The extensions of each format, in the order folders are searched.
EXTENSIONS = {"parquet": (".parquet", ".pq"), "csv": (".csv",), "sas": (".sas7bdat", ".xpt")}


def _format_of(name: str) -> str | None:
    return next((f for f, ends in EXTENSIONS.items() if name.lower().endswith(ends)), None)


class _Store:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def is_folder(self) -> bool:
        return self.fs.getFileStatus(self.path).isDirectory()

    def is_file(self) -> bool:
        return self.exists() and not self.is_folder()

    def glob(self) -> list[str]:
        found = self.fs.globStatus(self.path) or []
        return sorted(s.getPath().toString() for s in found if s.isFile())

    def files(self, recursive: bool) -> list[str]:
        """Files below the folder; no part of their path may start with . or _."""
        out, todo = [], [self.path]
        while todo:
            for s in self.fs.listStatus(todo.pop()):
                name = s.getPath().getName()
                if name.startswith((".", "_")):
                    continue
                if s.isDirectory():
                    if recursive:
                        todo.append(s.getPath())
                else:
                    out.append(s.getPath().toString())
        return sorted(out)


def open_source(source, options: SourceOptions | None = None, spark: SparkSession | None = None, warnings: list[str] | None = None) -> DataFrame:
    """A DataFrame of a DataFrame or a path. Notes go to ``warnings``."""
    if isinstance(source, DataFrame) or hasattr(source, "sparkSession") and hasattr(source, "schema"):
        return source
    if not isinstance(source, (str, Path)):
        raise TypeError(f"Unsupported source type: {type(source).__name__} (a path or a DataFrame is needed)")
    options, raw = options or SourceOptions(), str(source)
    spark = spark or SparkSession.active()
    store = _Store(spark, raw) if not re.search(r"[*?\[]", raw) else None
    if store is None:
        try:  # a file may have such a name
            literal = _Store(spark, raw)
            store = literal if literal.is_file() else None
        except Exception:  # noqa: BLE001  not a path by itself
            store = None
    if store is None:
        fmt = options.format or _format_of(raw)
        if fmt is None:
            raise ValueError(f"The pattern '{raw}' doesn't tell a file format; set SourceOptions.format")
        files = _Store(spark, raw.replace("**/", "*/")).glob() if "**" not in raw else _deep_glob(spark, raw)
        if not files:
            raise FileNotFoundError(f"No files match the pattern {raw}")
        return _read(spark, fmt, files, options)
    if not store.exists():
        raise FileNotFoundError(f"Source not found: {raw}")
    if store.is_folder():
        files = store.files(options.recursive)
        for fmt in [options.format] if options.format else EXTENSIONS:
            own = [f for f in files if f.lower().endswith(EXTENSIONS[fmt])]
            if own:
                others = {_format_of(f) for f in files} - {fmt, None}
                if others and not options.format and warnings is not None:
                    warnings.append(f"'{raw}' holds several formats; only its {fmt} files are read")
                return _read(spark, fmt, own, options)
        raise FileNotFoundError(f"No {'/'.join([options.format] if options.format else EXTENSIONS)} files in '{raw}'")
    fmt = options.format or _format_of(raw)
    if fmt is None:
        raise ValueError(f"Unsupported file format: '{raw}'. Set SourceOptions.format.")
    return _read(spark, fmt, [raw], options)


def _deep_glob(spark: SparkSession, pattern: str) -> list[str]:
    """``**`` stands for any number of folders, none included."""
    top = pattern.split("**")[0]
    base = _Store(spark, top or ".")
    if not base.exists():
        return []
    parts = re.split(r"(\*\*/|\*\*|\*|\?|\[[^\]]*\])", pattern)
    to = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    wanted = "".join(to.get(p, p if p.startswith("[") else re.escape(p)) for p in parts)
    return [f for f in base.files(True) if re.search(f"(?:^|[:/]){wanted.lstrip('/')}$", f)]


def _read(spark: SparkSession, fmt: str, files: list[str], options: SourceOptions) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(*files)
    if fmt == "csv":
        return _read_csv(spark, files, options)
    from .sas import read_sas

    frames = [read_sas(spark, f) for f in files]
    names = frames[0].columns
    for f, frame in zip(files, frames):
        if frame.columns != names:
            raise ValueError(f"'{f}' has other columns than '{files[0]}'")
    return reduce(DataFrame.union, frames)


def _first_lines(spark: SparkSession, files: list[str], n: int) -> list[str]:
    """A header and the ``n`` first lines below headers, from as many files as hold
    them: the first may have no line but its header."""
    out: list[str] = []
    for f in files:
        wanted = n + 1 - max(len(out) - 1, 0)  # its header and what lacks
        lines = [r[0] for r in spark.read.text(f).limit(wanted).collect()]
        out += lines[1:] if out else lines
        if len(out) > n:
            break
    return out


def _read_csv(spark: SparkSession, files: list[str], options: SourceOptions) -> DataFrame:
    """Types come from the first lines; whole numbers are longs, and dates and times
    stay text. Values that don't fit fail."""
    read = spark.read.option("header", True).option("sep", options.csv_separator)
    n = options.csv_infer_schema_length
    if n is None:
        told = read.option("inferSchema", True).csv(files).schema
    elif n == 0:
        told = T.StructType([T.StructField(f.name, T.StringType()) for f in read.csv(files[0]).schema])
    else:
        told = read.option("inferSchema", True).csv(spark.sparkContext.parallelize(_first_lines(spark, files, n), 1)).schema

    def wider(t: T.DataType) -> T.DataType:
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            return T.LongType()
        return T.StringType() if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else t

    schema = T.StructType([T.StructField(f.name, wider(f.dataType)) for f in told])
    return read.schema(schema).option("mode", "FAILFAST").option("enforceSchema", False).csv(files)
