"""Scratch tables and small helpers that the operators of this subpackage share.

Every intermediate result that is read twice is written as Parquet below the
folder that ``spark.checkpoint.dir`` names, which driver and executors share.
Reading such a table back cuts the lineage: a lost executor costs the tasks it
held, never the stages that made the table.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a session in one process
    (tests) gets a local one, and a cluster, whose machines share no such folder, an error."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"{_SETTING} must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="versant-shared-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


class Scratch:
    """A private folder below the shared one, for the tables of one call of an operator.  Operators
    drop the tables that no result reads; the folder goes when the driver's process ends, but for
    one that holds a product (``keep``)."""

    def __init__(self, spark: SparkSession, label: str, keep: bool = False):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/versant/{label}-{uuid.uuid4().hex}"
        if not keep:
            atexit.register(self.remove)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the DataFrame that reads it back."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads; ``name*`` stands for all that begin so."""
        for name in names:
            path = self._path_of(self.path(name))
            store = self._store_of(path)
            for found in store.globStatus(path) or []:
                store.delete(found.getPath(), True)

    def remove(self) -> None:
        """Deletes the folder; a session that is gone already leaves it."""
        atexit.unregister(self.remove)
        with contextlib.suppress(Exception):
            path = self._path_of(self.folder)
            self._store_of(path).delete(path, True)

    def _path_of(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _store_of(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def hot_join(rows: DataFrame, table: DataFrame, key: str, table_key: str, weight: str) -> DataFrame:
    """Left join of ``rows`` with ``table``, in which ``table_key`` is unique and ``weight`` says how many of
    ``rows`` have that key.  Keys of a thousandth of the rows or more, a thousand of them at most, go
    to every task, so no task gets a hot key's rows; the others are joined by a shuffle."""
    total = rows.count()
    heavy = F.broadcast(table.filter(F.col(weight) * 1000 >= total))
    on = F.col(key) == F.col(table_key)
    rest = rows.join(heavy.select(F.col(table_key)), on, "left_anti").join(table.filter(F.col(weight) * 1000 < total), on, "left")
    return rows.join(heavy, on).union(rest)
