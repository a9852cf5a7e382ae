"""Writers that replace whole tables or parts of them. Data goes to a new version folder; readers follow a pointer row."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def current_version(spark: SparkSession, root: str) -> str | None:
    """Name of the newest version, None before the first write. Pointers are only ever added, so readers never meet half a switch."""
    try:
        rows = spark.read.schema("version string, nth long").parquet(f"{root}/_current").orderBy(F.desc("nth"), F.desc("version")).limit(1).collect()
    except AnalysisException:
        return None
    return rows[0]["version"] if rows else None


def read_table(spark: SparkSession, root: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no version under {root}")
    return spark.read.parquet(f"{root}/{version}")


def replace_table(df: DataFrame, root: str) -> str:
    """Full replace: all rows are written first, then one pointer row makes them current. A failed write changes nothing."""
    return _switched(df.sparkSession, root, df.write.parquet)


def _switched(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Writes a new version and then the pointer to it."""
    version = f"v-{uuid.uuid4().hex}"
    write(f"{root}/{version}")
    nth = 1
    if current_version(spark, root) is not None:
        nth += spark.read.schema("version string, nth long").parquet(f"{root}/_current").agg(F.max("nth")).first()[0]
    spark.createDataFrame([(version, nth)], "version string, nth long").coalesce(1).write.mode("append").parquet(f"{root}/_current")
    return version


def replace_keys(df: DataFrame, root: str, keys: list[str]) -> str:
    """Partial replace: rows of the keys in df go, df's rows come, all others stay."""
    old = read_table(df.sparkSession, root)
    return replace_table(old.join(df.select(*keys).distinct(), keys, "left_anti").unionByName(df), root)


def replace_json(df: DataFrame, root: str) -> str:
    """As replace_table, with one JSON object a row, nulls included: readers that follow the pointer see the old rows or the new ones."""
    return _switched(df.sparkSession, root, lambda folder: df.write.option("ignoreNullFields", False).json(folder))


def read_json(spark: SparkSession, root: str, schema: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no version under {root}")
    return spark.read.schema(schema).json(f"{root}/{version}")


def write_csv(df: DataFrame, path: str, rows_a_file: int = 0) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.option("maxRecordsPerFile", rows_a_file) if rows_a_file else writer).csv(path)


def _few(counts: DataFrame, most: int) -> list:
    rows = counts.orderBy(*counts.columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def report_json(counts: DataFrame, title: str, most: int = 1_000) -> str:
    """JSON object with the title and the rows of an aggregated frame, in their order; more than `most` rows are refused."""
    return json.dumps({"title": title, "rows": [r.asDict(recursive=True) for r in _few(counts, most)]}, ensure_ascii=False, default=str)


def report(counts: DataFrame, title: str, most: int = 1_000) -> str:
    """Markdown table of an aggregated frame; more than `most` rows are refused, as a report isn't a table of data."""
    rows = _few(counts, most)
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(counts.columns), line("---" for _ in counts.columns), *(line(r) for r in rows), ""])
