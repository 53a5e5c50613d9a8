"""What operators that go in rounds share: a folder of driver and executors, and cut lineages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, local mode (tests) alone gets a temporary folder."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not where:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="waymark-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    return where or sc.getCheckpointDir()


def bulky(df: DataFrame) -> DataFrame:
    """``df``, whose next join sorts both sides. The planner takes exploded rows and packed columns for about as small as the file
    they come from, and would send them whole through the driver; a hint holds up to the first join, a join's own size is a product."""
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder: a round doesn't compute the rounds before it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return bulky(spark.read.schema(df.schema).parquet(path))
