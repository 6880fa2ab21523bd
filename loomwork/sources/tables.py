"""Tables in and out: scans, labelled CSV files, JSON lines, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_cell


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_csv_files(spark: SparkSession, glob: str, schema: str, labels: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """All CSV files of a pattern with a header, quotes and line feeds in cells; labels adds columns by file name."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(glob).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    if labels:
        rows = [(name, *values.values()) for name, values in labels.items()]
        columns = list(next(iter(labels.values())))
        df = df.join(F.broadcast(spark.createDataFrame(rows, ["file", *columns])), "file", "left")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose text cells no spreadsheet takes for formulas."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    df.withColumns({c: safe_cell(F.col(c)) for c in text}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a missing path has no rows."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def replace_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def get_or_create(old: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """old, and the wanted rows whose keys it lacks (once each)."""
    return old.unionByName(wanted.dropDuplicates(key).join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def fill_missing(old: DataFrame, new: DataFrame, key: list[str], fill: list[str]) -> DataFrame:
    """Rows of either side; columns to fill keep the old value where there is one."""
    renamed = new.select(*key, *(F.col(c).alias(f"_new_{c}") for c in fill))
    return old.join(renamed, key, "full").select(*key, *(F.coalesce(c, f"_new_{c}").alias(c) for c in fill))


def when_changed(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """df with the columns of changes replaced where condition holds."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in changes.items()})
