"""The canonical matrix is long: cell_id, gene_id, cnt, one row for each non-zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_READERS = {"parquet": {}, "csv": {"header": True}, "orc": {}, "json": {}}


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return spark.read.options(**_READERS[fmt]).format(fmt).load(path)


def whole(value: Column) -> Column:
    """A count as a long; a missing, negative or fractional one fails the query."""
    bad = value.isNull() | (value < 0) | (value != F.floor(value))
    return F.when(bad, F.raise_error(F.concat(F.lit("counts must be whole and not negative: "), F.coalesce(value.cast("string"), F.lit("null"))))).otherwise(value).cast("long")


def _number(table: DataFrame, column: str) -> Column:
    """Text formats give strings; those are read as doubles."""
    return F.col(f"`{column}`").cast("double") if dict(table.dtypes)[column] == "string" else F.col(f"`{column}`")


def read_long(spark: SparkSession, path: str, cell: str, gene: str, value: str, fmt: str = "parquet") -> DataFrame:
    """A long table with other column names; zeros are dropped, repeated entries kept (see :func:`canonicalize`).

    Every count is checked (see :func:`whole`).
    """
    table = _read(spark, path, fmt)
    return table.select(F.col(f"`{cell}`").cast("long").alias("cell_id"), F.col(f"`{gene}`").cast("long").alias("gene_id"), whole(_number(table, value)).alias("cnt")).where("cnt <> 0")


def read_wide(spark: SparkSession, path: str, id_col: str, columns: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """A dense table, a row per cell and a column per gene, as (cell_id, gene_name, cnt) without zeros; every count is checked."""
    table = _read(spark, path, fmt)
    genes = columns or [c for c in table.columns if c != id_col]
    dense = table.select(F.col(f"`{id_col}`").cast("long").alias("cell_id"), *(whole(_number(table, c)).alias(c) for c in genes))
    return dense.unpivot(["cell_id"], [F.col(f"`{c}`") for c in genes], "gene_name", "cnt").where("cnt <> 0")


def canonicalize(counts: DataFrame) -> DataFrame:
    """Sum repeated entries and drop zeros; every count is checked."""
    return counts.groupBy("cell_id", "gene_id").agg(F.sum(whole(F.col("cnt"))).alias("cnt")).where("cnt > 0")


def matrix_from_events(events: DataFrame, cell: str, gene: str, value: str) -> DataFrame:
    """Cross-tabulate a fact table: the sum of ``value`` for each (cell, gene), null values left out; a sum that is negative or not whole fails the query."""
    sums = events.where(F.col(value).isNotNull()).groupBy(F.col(cell).cast("long").alias("cell_id"), F.col(gene).cast("long").alias("gene_id")).agg(F.sum(value).alias("sum"))
    return sums.select("cell_id", "gene_id", whole(F.col("sum")).alias("cnt")).where("cnt > 0")


def matrix_from_text(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Token counts: documents as cells, lower-case ASCII words as genes (gene_name)."""
    tokens = docs.select(F.col(id_col).alias("cell_id"), F.explode(F.split(F.lower(text), "[^a-z]+")).alias("gene_name"))
    return tokens.where("gene_name <> ''").groupBy("cell_id", "gene_name").agg(F.count(F.lit(1)).alias("cnt"))
