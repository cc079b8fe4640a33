"""What a database's columns hold, by their names and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def column_class(name: Column) -> Column:
    """email, phone, date, or null."""
    low = F.lower(name)
    return F.when(low.rlike("email"), "email").when(low.rlike("phone|tel|mobile|contact"), "phone").when(low.rlike("date|created|updated|modified|timestamp"), "date")


def is_name(name: Column) -> Column:
    return F.lower(name).rlike("name")


def catalog(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(table_name, column_name, ordinal, data_type) from schemas alone; no data is read."""
    rows = [(t, f.name, i, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, data_type string")


def date_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, min_value, max_value, non_null) of each column, in one pass over df."""
    one = df.agg(*(F.struct(F.lit(c).alias("column_name"), F.min(c).cast("string").alias("min_value"), F.max(c).cast("string").alias("max_value"), F.count(c).alias("non_null")).alias(f"c{i}") for i, c in enumerate(columns)))
    return one.select(F.inline(F.array(*(f"c{i}" for i in range(len(columns))))))


def sample_names(df: DataFrame, columns: list[str], each: int = 50, most: int = 20) -> DataFrame:
    """The first distinct values (in order) of each column, then of all columns in their order."""
    parts = [df.select(F.col(c).alias("name")).where(F.col(c).isNotNull()).distinct().orderBy("name").limit(each).withColumn("pos", F.lit(i)) for i, c in enumerate(columns)]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("name").agg(F.min("pos").alias("pos")).orderBy("pos", "name").limit(most).select("name")


def email_domains(df: DataFrame, column: str) -> DataFrame:
    domain = F.get(F.split(column, "@"), F.lit(1))
    return df.select(domain.alias("domain")).where("domain <> ''").distinct()


def tables_by_db(catalog: DataFrame) -> DataFrame:
    """(db, tables): the names of each database's tables, sorted, with commas."""
    return catalog.select("db", "table_name").distinct().groupBy("db").agg(F.array_join(F.sort_array(F.collect_list("table_name")), ", ").alias("tables"))


def schema_text(catalog: DataFrame) -> DataFrame:
    """(table_name, text): a table's columns in their order, as a prompt shows them."""
    cols = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column_name", "data_type"))), lambda c: F.concat(F.lit("  - "), c["column_name"], F.lit(" ("), c["data_type"], F.lit(")")))
    body = catalog.groupBy("table_name").agg(F.array_join(cols, "\n").alias("body"))
    return body.select("table_name", F.concat(F.lit("Table: "), "table_name", F.lit("\n"), "body").alias("text"))
