"""A clustered layout for items: reads of one owner or stream touch only where it lies.

Items are written in a fixed number of folders, by a hash of their owner (or stream), and inside
each file in the order of owner and sort columns. So a reader that knows the owner opens one
folder, and of its files the row groups whose statistics admit the owner and the asked range.
A folder per owner would do the first as well, but makes millions of small files where there are
millions of owners, and one huge folder without order where one owner holds a third of all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: the folder column; readers of the layout don't see it
FOLDER = "__folder__"
FOLDERS = 256
#: bytes of a row group, within which statistics can't skip anything
ROW_GROUP = 16 << 20


def folder_of(owner: Column, folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(folders)).cast("int")


def write_clustered(
    items: DataFrame, path: str, by: str = "owner", sort: Sequence[str] = (), folders: int = FOLDERS, row_group: int = ROW_GROUP
) -> None:
    """Write ``items`` by ``by`` and sorted by it and ``sort``. A folder with much is written by
    several tasks, each a range of its order, so one hot owner is many files of disjoint ranges."""
    dealt = items.withColumn(FOLDER, folder_of(F.col(by), folders))
    order = [FOLDER, by, *sort]
    (
        dealt.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.partitionBy(FOLDER)
        .option("parquet.block.size", row_group)
        .parquet(path)
    )


def read_clustered(
    spark: SparkSession, path: str, owners: Sequence[str] | None = None, by: str = "owner", folders: int = FOLDERS
) -> DataFrame:
    """Items of the given owners, or all. Further filters on the sort columns reach the files."""
    items = spark.read.parquet(path)
    if owners is not None:
        wanted = [F.lit(o) for o in owners]
        in_folder = F.lit(False)
        for owner in wanted:
            in_folder = in_folder | (F.col(FOLDER) == folder_of(owner, folders))
        items = items.filter(in_folder).filter(F.col(by).isin(list(owners)))
    return items.drop(FOLDER)


def of_jobs(items: DataFrame, jobs: DataFrame, owner: str, by: str = "owner", folders: int = FOLDERS) -> DataFrame:
    """Items (read with their folder, by ``spark.read.parquet``) whose owner some job asks for.
    The folders are pruned while the query runs, once the jobs are known."""
    asked = jobs.filter(F.col(owner) != "").select(F.col(owner).alias(by), folder_of(F.col(owner), folders).alias(FOLDER))
    return items.join(asked, [FOLDER, by], "left_semi").drop(FOLDER)
