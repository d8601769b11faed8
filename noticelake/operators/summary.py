"""Roll-ups of notices by department and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_years(notices: DataFrame, most: int) -> DataFrame:
    """notices of each department's newest years."""
    newest = Window.partitionBy("dept").orderBy(F.desc("year"))
    years = notices.select("dept", "year").distinct().withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= most).drop("nth")
    return notices.join(years, ["dept", "year"])


def by_department(notices: DataFrame, max_years: int | None = None) -> DataFrame:
    """dept, year (null: all years), circulars, circular_letters, total and years_processed of notices (dept, year, kind).

    One rollup; counts of absent kinds are 0.  With max_years only a department's newest years count.
    """
    if max_years is not None:
        notices = newest_years(notices, max_years)
    rolled = notices.rollup("dept", "year").agg(
        F.count_if(F.col("kind") == "circular").alias("circulars"), F.count_if(F.col("kind") == "circular_letter").alias("circular_letters"),
        F.count(F.lit(1)).alias("total"), F.count_distinct("year").alias("years_processed"), F.grouping("dept").alias("everything"),
    )
    return rolled.filter("everything = 0").drop("everything")

