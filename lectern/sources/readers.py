"""Readers: JSON and XML documents, delimited files with bad rows set aside, first file of a key, sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def json_documents(spark: SparkSession, path: str, schema: str | StructType, pattern: str = "*.json") -> DataFrame:
    """One row a file, with `path`; the schema is given, so files are read once, and none is opened to guess it."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def first_by_key(df: DataFrame, keys: list[str], order: str = "path") -> DataFrame:
    """Of rows with equal keys the one with the smallest path: a partial aggregate, so duplicates never leave their task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): rows that fit the schema, and those that don't: what could be read of them, and the line as `raw`.

    Spark refuses to read `raw` alone; take it with another column.
    """
    full = StructType.fromDDL(schema).add("__bad", StringType())
    read = spark.read.schema(full).option("sep", sep).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").csv(path)
    return read.where("__bad is null").drop("__bad"), read.where("__bad is not null").withColumnRenamed("__bad", "raw")


def xml_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml): one row a file; `xml_items` takes it apart."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def xml_items(df: DataFrame, xpath: str, value: str = "item") -> DataFrame:
    """Other columns with (pos, item) for each text that an XPath finds in well-formed `xml`, in document order from 1."""
    return df.select(*[c for c in df.columns if c != "xml"], F.posexplode(F.xpath("xml", F.lit(xpath))).alias("pos", value)).withColumn("pos", F.col("pos") + 1)


def with_sidecar(df: DataFrame, files: DataFrame, expected: Column, flag: str = "has_sidecar") -> DataFrame:
    """Adds whether `files` (path) lists the path that `expected` gives."""
    listed = files.select(F.col("path").alias("__path")).distinct().withColumn("__there", F.lit(True))
    return df.join(listed, expected == F.col("__path"), "left").withColumn(flag, F.coalesce("__there", F.lit(False))).drop("__path", "__there")


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
