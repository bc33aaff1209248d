"""SAS files (sas7bdat, xpt) as a Python data source: one task for each file, read
in chunks. The file must be at a path that executors can open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

CHUNK = 10_000


def _local(path: str) -> str:
    return path.removeprefix("file://").replace("file:", "", 1) if path.startswith("file:") else path


def _chunks(path: str, rows: int = CHUNK):
    try:
        import pandas as pd
    except ImportError as e:  # pragma: no cover
        raise ImportError("SAS files need pandas: pip install pandas") from e
    kind = "xport" if path.lower().endswith(".xpt") else "sas7bdat"
    with pd.read_sas(_local(path), format=kind, encoding="latin-1" if kind == "sas7bdat" else None, chunksize=rows) as reader:
        yield from reader


class SasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tablewise_sas"

    def schema(self) -> T.StructType:
        first = next(iter(_chunks(self.options["path"], 200)))
        kinds = {"f": T.DoubleType(), "i": T.LongType(), "M": T.TimestampNTZType()}
        return T.StructType([T.StructField(str(c), kinds.get(first[c].dtype.kind, T.StringType())) for c in first.columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SasReader(self.options["path"], schema)


class SasReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.own = path, schema

    def read(self, partition):
        import pandas as pd

        for chunk in _chunks(self.path):
            for row in chunk.itertuples(index=False, name=None):
                yield tuple(self._plain(v, pd) for v in row)

    @staticmethod
    def _plain(value, pd):
        if isinstance(value, bytes):
            return value.decode("latin-1").rstrip() or None
        if pd.isna(value):
            return None
        return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value


def read_sas(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(SasSource)
    return spark.read.format("tablewise_sas").option("path", path).load()
