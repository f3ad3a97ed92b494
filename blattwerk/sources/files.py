"""File listings and page images."""

from __future__ import annotations

from functools import reduce

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from blattwerk import fixed
from blattwerk.functions import paths
from blattwerk.session import stage
from blattwerk.sources import stores


# Entries of a listing that one task reads or opens, once all cores have some.
FILES_PER_TASK = 1000


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Files of a folder as ``(path, length, modificationTime)``; no file is opened.

    The folders of each level are dealt over tasks and their entries written as a
    table, so the driver sees counts only. A store that tasks cannot open is
    listed by Spark, which holds all names on the driver and leaves out names that
    start with ``_`` or ``.``.
    """
    if not stores.reachable(folder):
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", str(recursive).lower())
            .load(folder)
            .select("path", "length", "modificationTime")
        )
    store, key = stores.located(folder)
    if store.get_file_info([key])[0].type != fs.FileType.Directory:
        raise FileNotFoundError(f"Ordner nicht gefunden: {folder}")
    found, level = [], spark.createDataFrame([(stores.full(folder),)], "path string")
    schema = "path string, folder boolean, length long, modificationTime timestamp"
    while True:
        below = stage(level.mapInArrow(stores.listed, schema), "listing")
        found.append(below.where("NOT folder"))
        folders = below.where("folder").select("path")
        count = folders.count() if recursive else 0
        if not count:
            return reduce(DataFrame.unionByName, found).drop("folder")
        # A folder is one task's: there are as many tasks as cores, or more for many folders.
        level = folders.repartition(tasks(spark, count))


def tasks(spark: SparkSession, count: int, per_task: int = FILES_PER_TASK) -> int:
    """Tasks for so many entries: one a core while there are few."""
    return max(1, min(count, max(spark.sparkContext.defaultParallelism, count // per_task)))


def read_files(spark: SparkSession, folder: str, suffixes: list[str], recursive: bool = False) -> DataFrame:
    """Content of the files with one of the given suffixes, any case."""
    if not stores.reachable(folder):
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", str(recursive).lower())
            .load(folder)
            .where(paths.suffix(F.col("path")).isin(suffixes))
            .select("path", "content")
        )
    wanted = list_files(spark, folder, recursive).where(paths.suffix(F.col("path")).isin(suffixes)).select("path")
    return wanted.repartition(tasks(spark, wanted.count())).mapInArrow(stores.contents, "path string, content binary")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df`` itself, or an error where it has no row; looks at one row only."""
    if df.isEmpty():
        raise FileNotFoundError(message)
    return df


def with_kind(listing: DataFrame) -> DataFrame:
    """Adds the lower-case suffix and the file kind."""
    return listing.withColumn("suffix", paths.suffix(F.col("path"))).withColumn(
        "kind", paths.file_kind(F.col("path"))
    )


def supported_documents(listing: DataFrame) -> DataFrame:
    """Listing rows of a supported kind. Sort with ``sort_documents`` where order counts."""
    return with_kind(listing).where(F.col("kind") != "unsupported")


def sort_documents(listing: DataFrame) -> DataFrame:
    """Rows in folder-by-folder path order; a range-partitioned sort."""
    return listing.orderBy(paths.path_order(F.col("path")))


def invoice_files(listing: DataFrame) -> DataFrame:
    return listing.where(paths.suffix(F.col("path")).isin(fixed.PDF_SUFFIXES))


def handwriting_files(listing: DataFrame) -> DataFrame:
    """Images that count as handwriting; not every image kind does."""
    return listing.where(paths.suffix(F.col("path")).isin(fixed.HANDWRITING_SUFFIXES))


def file_counts(listing: DataFrame) -> DataFrame:
    """Handwriting images and PDFs per folder."""
    ending = paths.suffix(F.col("path"))
    return listing.groupBy(paths.folder(F.col("path")).alias("folder")).agg(
        F.count_if(ending.isin(fixed.HANDWRITING_SUFFIXES)).alias("images"),
        F.count_if(ending.isin(fixed.PDF_SUFFIXES)).alias("pdfs"),
    )


def supported_suffixes(listing: DataFrame) -> DataFrame:
    """The supported suffixes that occur in a listing, with their kind."""
    return supported_documents(listing).select("suffix", "kind").distinct()


def page_images(files: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Rendered page images ``<name>_page_<n>.<suffix>`` as ``(document, page, content)``.

    An image without a page number in its name is a document of one page.
    ``documents``, a listing with ``path``, gives pages the path of the file that
    they were rendered from: the one in their folder called ``<name>``, or else the
    only one with that stem. An image that is listed itself is no page of another.
    """
    name = paths.stem(F.col("path"))
    number = F.regexp_extract(name, r"_page_([0-9]+)$", 1)
    rows = files.select(
        "path",
        F.when(
            number != "",
            F.concat_ws(
                "/",
                F.nullif(paths.folder(F.col("path")), F.lit("")),
                F.regexp_replace(name, r"_page_[0-9]+$", ""),
            ),
        ).otherwise(F.col("path")).alias("document"),
        F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(1)).alias("page"),
        "content",
    )
    if documents is None:
        return rows.drop("path")
    listed = documents.select("path").distinct()
    stem = F.concat_ws("/", F.nullif(paths.folder(F.col("path")), F.lit("")), paths.stem(F.col("path")))
    by_stem = listed.groupBy(stem.alias("key")).agg(F.min("path").alias("source"), F.count("*").alias("n")).where("n = 1")
    named = listed.select(F.col("path").alias("key"), F.col("path").alias("source"), F.lit(0).alias("rank")).unionByName(
        by_stem.select("key", "source", F.lit(1).alias("rank"))
    ).groupBy("key").agg(F.min_by("source", "rank").alias("source"))
    own = listed.select(F.col("path").alias("own"))
    return (
        rows.join(own, F.col("path") == F.col("own"), "left")
        .join(named, F.col("document") == F.col("key"), "left")
        .select(
            F.coalesce("own", "source", "document").alias("document"),
            F.when(F.col("own").isNotNull(), 1).otherwise(F.col("page")).alias("page"),
            "content",
        )
    )
