"""Written tables that cut lineage, and stage tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("sections", "concepts", "prerequisites", "edges")
#: Arrow batches of written tables hold about so many bytes, or one row: 10,000 rows of long texts don't stand in a worker at once.
BATCH_BYTES = "4m"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a folder of our own serves in local mode, as in tests; on
    a cluster that is an error, as each machine would have a folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="folium-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """The same rows, read back from a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/folium-{label}-{uuid.uuid4().hex}"
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(limit, None)
    conf.set(limit, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        conf.unset(limit) if before is None else conf.set(limit, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_path(root: str, stage: str, book_slug: str) -> str:
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    return f"{root.rstrip('/')}/{stage}/{book_slug}"


def save_stage(df: DataFrame, root: str, stage: str, book_slug: str) -> str:
    path = stage_path(root, stage, book_slug)
    df.write.mode("overwrite").parquet(path)
    return path


def load_stage(spark: SparkSession, root: str, stage: str, book_slug: str, schema, defaults: dict[str, object] | None = None) -> DataFrame:
    """A stage's table, held to a schema: missing columns and unlike types raise ValueError.

    ``defaults``: values for columns that the table lacks, or that are null in it.
    """
    from folium.schemas import as_struct

    df = spark.read.parquet(stage_path(root, stage, book_slug))
    for f in as_struct(schema):
        if f.name in (defaults or {}):
            value = F.lit(defaults[f.name]).cast(f.dataType)
            df = df.withColumn(f.name, F.coalesce(f.name, value) if f.name in df.columns else value)
    have = {f.name: f.dataType for f in df.schema}
    for f in as_struct(schema):
        if have.get(f.name) != f.dataType:
            raise ValueError(f"{stage}: column {f.name} should be {f.dataType.simpleString()}")
    return df.select(*as_struct(schema).names)
