"""Sources: CSV, JSON lines, optional files, batches of files, tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header, quotes, line breaks in values; all columns as the schema says."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Lines that do not parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def optional(spark: SparkSession, read, path: str, schema: StructType | str) -> DataFrame:
    """S3: an empty table of the schema where the file is missing. The path is resolved by Spark's own file systems."""
    try:
        return read(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def batches(spark: SparkSession, pattern: str, schema: StructType | str, number: str = r"batch_(\d+)") -> DataFrame:
    """Files by pattern, with the number in their names as source_version."""
    rows = spark.read.schema(schema).csv(pattern, header=True, quote='"', escape='"')
    return rows.withColumn("source_version", F.regexp_extract(F.input_file_name(), number, 1))


def table(spark: SparkSession, name: str) -> DataFrame:
    """A catalogue table; databases come in by spark.read.jdbc."""
    return spark.table(name)


#: Column that holds a line that did not parse.
CORRUPT = "_corrupt_record"


def json_lines_with_bad(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All lines; one that does not parse has its text in CORRUPT and null elsewhere."""
    typed = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    with_bad = StructType([*typed.fields, StructField(CORRUPT, StringType())])
    return spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def file_order() -> Column:
    """Where a row stands in files ordered by path: comparable, and the same however the files are dealt to tasks.

    Rows of one block of a file are read by one task, in order, so the growing id orders them; blocks go by their start.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start")
    return F.struct(place.alias("block"), F.monotonically_increasing_id().alias("row"))


def external_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores of pairs from CSV files; of repeated rows the greatest row_no is the last one, in order of files and of their lines."""
    rows = csv(spark, path, "target_id long, indication_id long, predicted_p_approval double")
    return rows.select("target_id", "indication_id", F.col("predicted_p_approval").alias("p"), file_order().alias("row_no"))


def last_scores(scores: DataFrame) -> DataFrame:
    """The last score of each pair; repeated rows are met on the map side first."""
    return scores.groupBy("target_id", "indication_id").agg(F.max_by("p", "row_no").alias("p"))
