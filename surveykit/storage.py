"""Tables that a job writes on its way, in a folder that driver and executors share."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_FILE = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint folder, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


def files(size: int) -> int:
    """How many files, or tasks, so many bytes fill."""
    return max(1, -(-size // _FILE))


class Scratch:
    """Columnar copies that cut lineage and outlive lost executors.

    ``keep`` writes a table and returns a reader of it, ``drop`` removes one that is read no more, ``close`` (or
    the end of a ``with`` block) removes all. What a lazy result still reads must stay: call ``leave`` on it, and
    it goes when the session ends. If the caller knows how many bytes the rows (and the work on them) come to at most, as
    ``size``, a small table goes to few files, one for every 2 MB, however many partitions the session has.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
        self._count = itertools.count()
        self._paths: set[str] = set()
        self._left = False

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def _remove(self, path: str, later: bool = False) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if later:
            system.deleteOnExit(where)
        elif system.exists(where):
            system.delete(where, True)

    def keep(self, df: DataFrame, name: str = "table", by: Sequence[str] = (), size: int | None = None) -> DataFrame:
        path = f"{self.root}/{name}-{next(self._count)}"
        self._paths.add(path)
        dealt = df.repartition(*by) if by else df
        (dealt if size is None else dealt.coalesce(files(size))).write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._paths.discard(table._scratch_path)
            self._remove(table._scratch_path)

    def leave(self, table: DataFrame) -> DataFrame:
        """Keeps the table beyond ``close``, to the end of the session."""
        self._paths.discard(table._scratch_path)
        self._left = True
        self._remove(self.root, later=True)
        return table

    def close(self) -> None:
        for path in self._paths:
            self._remove(path)
        self._paths = set()
        if not self._left:
            self._remove(self.root)
