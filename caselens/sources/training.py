"""Training tables: nested wide feature tables, labels and metadata, published as one set."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import write_partitioned

CONFIGS = ("E0", "E1", "E2", "E3")


def ordered_manifest(manifest: DataFrame) -> DataFrame:
    """The manifest of features that may be used, with their place: by configuration, modality and name. It is as long as a table's header."""
    used = manifest.where("audit_status <> 'rejected'")
    return used.withColumn("position", F.row_number().over(Window.orderBy("config", "modality", "feature_name")))


def wide(long: DataFrame, manifest: DataFrame, config: str, key: str = "case_no") -> DataFrame:
    """One row a case, a column for each feature that the configuration shows, in the manifest's order, and cases in theirs."""
    names = [r[0] for r in ordered_manifest(manifest).where(F.col("config") <= config).orderBy("position").select("feature_name").collect()]
    table = long.groupBy(key).pivot("feature_name", names).agg(F.first("value"))
    return table.select(key, *(f"`{n}`" for n in names)).orderBy(key)


def write_training(long: DataFrame, manifest: DataFrame, labels: DataFrame, metadata: DataFrame, folder: str) -> str:
    """Writes E0 to E3, the labels, the metadata and the manifest as a new set, and returns its name.

    A set is read only once its line stands in the folder's list of sets, which is written last, in one file: who reads meanwhile
    finds the set before it, and a writer that fails leaves that as it was.
    """
    spark = long.sparkSession
    name = uuid.uuid4().hex
    for config in CONFIGS:
        wide(long, manifest, config).write.parquet(f"{folder}/{name}/features_{config}")
    for what, table in (("labels", labels), ("metadata", metadata), ("manifest", ordered_manifest(manifest))):
        table.write.parquet(f"{folder}/{name}/{what}")
    number = published(spark, folder).count() + 1
    spark.createDataFrame([(number, name)], "number long, name string").coalesce(1).write.mode("append").parquet(f"{folder}/sets")
    return name


def published(spark: SparkSession, folder: str) -> DataFrame:
    """(number, name) of the sets that are complete, none before the first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/sets")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "number long, name string")
    return spark.read.schema("number long, name string").parquet(f"{folder}/sets")


def read_training(spark: SparkSession, folder: str, what: str) -> DataFrame:
    """A table of the last complete set: features_E0 to features_E3, labels, metadata or manifest."""
    last = published(spark, folder).orderBy(F.col("number").desc(), "name").first()
    if last is None:
        raise FileNotFoundError(f"no complete set of training tables in {folder}")
    return spark.read.parquet(f"{folder}/{last['name']}/{what}")


def aligned_manifest(dense: DataFrame, runs: DataFrame) -> DataFrame:
    """What the aligned output of each run holds: rows (bins), features, bins before and from the injection on, empty cells, and a status;
    a run without output has an alignment_error."""
    per = dense.groupBy("case_no").agg(
        F.countDistinct("bin_index").alias("row_count"), F.countDistinct("column_name").alias("feature_column_count"),
        F.countDistinct(F.when(F.col("bin_index") < 0, F.col("bin_index"))).alias("baseline_bin_count"), F.countDistinct(F.when(F.col("bin_index") >= 0, F.col("bin_index"))).alias("incident_bin_count"),
        F.count_if(F.col("value").isNull()).alias("missing_feature_cell_count"),
    )
    out = runs.select("case_no", "case_id", "scenario", "run_number").join(per, "case_no", "left")
    return out.withColumn("status", F.when(F.col("row_count").isNull(), "alignment_error").otherwise("valid")).fillna(0)


def write_aligned(dense: DataFrame, runs: DataFrame, folder: str) -> DataFrame:
    """Writes aligned cells in folders by scenario and run, then the manifest of what stands there, read back from the files."""
    write_partitioned(dense.join(runs.select("case_no", "scenario", "run_number"), "case_no"), f"{folder}/aligned")
    spark = dense.sparkSession
    aligned_manifest(spark.read.parquet(f"{folder}/aligned"), runs).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")
