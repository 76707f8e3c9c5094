"""Readers and writers. Every reader is lazy: nothing but a schema is looked at before an action."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ",",
    schema: T.StructType | str | None = None,
    dates: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    drop_first: bool = False,
    encoding: str = "UTF-8",
    header: bool | None = None,
) -> DataFrame:
    """Delimited text. Types are inferred by an extra pass over the file unless ``schema`` is given.

    A file read with a schema has no header line unless ``header`` says so.
    The date columns are parsed to timestamps, ``columns`` keeps a subset (pruned at the scan)
    and ``drop_first`` discards a stored row index.
    """
    reader = spark.read.option("sep", sep).option("encoding", encoding)
    if schema is None:
        df = reader.csv(path, header=True, inferSchema=True)
    else:
        df = reader.schema(schema).csv(path, header=bool(header))
    if drop_first:
        df = df.drop(df.columns[0])
    if columns is not None:
        df = df.select(*columns)
    return df.withColumns({c: F.to_timestamp(F.col(c)) for c in dates}) if dates else df


def read_columnar(spark: SparkSession, path: str) -> DataFrame:
    """Columnar file. Spark has no Arrow file source, so the columnar format is parquet."""
    return spark.read.parquet(path)


def read_many(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Many parquet files as one table; a column missing from some files reads as NULL."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def sql_on_file(spark: SparkSession, sql: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Run SQL text in which ``{file}`` stands for the file itself."""
    return spark.sql(sql.replace("{file}", f"{fmt}.`{path}`"))


def sql_on(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run SQL text over results held in variables, named in braces."""
    return spark.sql(sql, **tables)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A small table typed in by hand."""
    return spark.createDataFrame(list(rows), schema)


def write_table(df: DataFrame, path: str, mode: str = "error", partition_by: Sequence[str] = ()) -> str:
    """Write parquet, every task its own file. Also the sink for what was kept as an Arrow file."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> str:
    df.write.option("sep", sep).option("encoding", encoding).csv(path, header=header)
    return path


