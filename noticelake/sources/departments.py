"""The departments that notices come from, in the order to read them (fixed values)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions.citation import CODES, EARLY_CODES, LAST_EARLY_YEAR

DEPARTMENTS = ("acd", "bpd", "bsrvd", "bsd", "mfd", "bprd")


def departments(spark: SparkSession, base: str = "https://host.example") -> DataFrame:
    return spark.createDataFrame([(k, d, f"{base}/{d}/index.htm") for k, d in enumerate(DEPARTMENTS)], "pos int, dept string, url string")


def codes(spark: SparkSession) -> DataFrame:
    """The dimension of codes: department, code, and the years from and to (null: open) in which it holds.  Tables of the same columns may take its place."""
    early = [(name, code, None, LAST_EARLY_YEAR) for name, code in EARLY_CODES.items()]
    late = [(name, code, LAST_EARLY_YEAR + 1 if name in EARLY_CODES else None, None) for name, code in CODES.items()]
    return spark.createDataFrame([*early, *late], "department string, code string, from_year int, to_year int")


def with_code(rows: DataFrame, department: Column, year: Column, dimension: DataFrame, name: str = "code") -> DataFrame:
    """rows with the code of their department (any case) in their year (text), from a dimension of codes; null where there is none.

    An equi-join on the name, with the years as a further condition: the dimension is broadcast or sorted by Spark as its size has it, and never
    compared row by row.  A null or unreadable year is taken as later than all.  Periods of one department must not overlap.
    """
    columns = rows.columns
    when = F.coalesce(F.nullif(year, F.lit("")).try_cast("int"), F.lit(2**31 - 1))
    asked = rows.withColumns({"__name": F.upper(department), "__year": when})
    known = dimension.select(F.upper("department").alias("__of"), F.coalesce("from_year", F.lit(-(2**31))).alias("__from"), F.coalesce("to_year", F.lit(2**31 - 1)).alias("__to"), F.col("code").alias("__code"))
    return asked.join(known, (F.col("__name") == F.col("__of")) & F.col("__year").between(F.col("__from"), F.col("__to")), "left").select(*columns, F.col("__code").alias(name))
