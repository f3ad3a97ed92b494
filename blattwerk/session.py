"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import importlib
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from blattwerk.sources import stores

# Runtime SQL settings the operators rely on.
SETTINGS = {
    # A repeated key in a JSON reply keeps its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Split hot join keys even where that costs one more shuffle.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows sent to Python may carry page images, megabytes each.
    "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
    "spark.sql.session.timeZone": "UTC",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session.

    The package's own functions travel to the workers inside the plan, so it
    need not be installed there.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship("blattwerk")
    return spark


def ship(package: str) -> None:
    """Send functions of a package to the workers by value."""
    cloudpickle.register_pickle_by_value(importlib.import_module(package))


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors can read, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; intermediate tables need a shared folder")
    folder = tempfile.mkdtemp(prefix="blattwerk-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    return f"{shared_folder(spark)}/blattwerk/{spark.sparkContext.applicationId}"


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application, once its results are written elsewhere.

    Nothing is removed on the way, as a lost executor may ask for any of them. Folders
    in a store that Arrow does not open are left to its own rules.
    """
    folder = own_folder(spark)
    if stores.reachable(folder):
        store, key = stores.located(stores.full(folder))
        if store.get_file_info([key])[0].type == stores.fs.FileType.Directory:
            store.delete_dir(key)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a second model
    call or a second, differently split shuffle. Later steps still prune
    columns and push filters into the written table.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores, where they come in fewer input splits than that.

    For work that is heavy per row. A table that spans more splits than there
    are cores, as every large one does, is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
