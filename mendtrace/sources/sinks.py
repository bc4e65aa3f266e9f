"""Sinks and checks: CSV tables, JSON summaries, LaTeX tables, digests of files."""

from __future__ import annotations

import json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One small document, through Hadoop's file system, so path may be in any store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
    out.close()


def latex(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A tabular of a small result table; floats with so many digits. Longer tables are refused, not cut."""
    kinds = dict(df.dtypes)
    rows = df.select(*(F.format_number(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("string").alias(c) for c in df.columns)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no table for print")
    line = lambda cells: " & ".join("NaN" if c is None else str(c).replace(",", "").replace("_", r"\_").replace("%", r"\%") for c in cells) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", line(df.columns), r"\midrule", *(line(r) for r in rows), r"\bottomrule", r"\end{tabular}"])


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, sha256) of whole files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))


def csv_counts(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Number of CSV files in each dataset's folder."""
    out = None
    for name, folder in folders.items():
        got = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).agg(F.count("*").alias("files")).select(F.lit(name).alias("dataset"), "files")
        out = got if out is None else out.union(got)
    return out
