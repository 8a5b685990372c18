"""Written tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """A folder that all machines share: under spark.checkpoint.dir, or of our own where that is unset and there is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    folder = folder or _OWN.get("dir") or _OWN.setdefault("dir", tempfile.mkdtemp(prefix="loomgraph-"))
    return f"{folder}/loomgraph"


def written(df: DataFrame) -> DataFrame:
    """``df`` written under spark.checkpoint.dir (a folder of our own where that is unset) and read back."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
