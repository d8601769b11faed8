"""Tables between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (a local session, as in tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _own_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="noticelake-"))
    return _own_dir[0]


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet, with the writer's options, in the shared folder and read it back: lineage ends here, and a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df in as many partitions as shuffles have, which stay as many however few bytes the rows have: for rows that take long for their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


class Rounds:
    """Rows that come in rounds: each round is a folder of its own, all are read as one table, and nothing is written twice."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def add(self, df: DataFrame) -> DataFrame:
        """The rows of a further round, written and read back."""
        path = f"{self.path}/{self.count:06d}"
        df.write.parquet(path)
        self.count, self.schema = self.count + 1, df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)
