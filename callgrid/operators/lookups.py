"""Reference lookups: country prefixes, number series, handset models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import digits, national_number


def isd_country(df: DataFrame, number: str, prefixes: DataFrame) -> DataFrame:
    """Adds ``country`` by the longest of a number's first four digits that is a known prefix (prefix, country).

    Only distinct numbers are looked up; the prefix table is a dimension of a few hundred rows.
    """
    d = F.regexp_replace(digits(F.col("__n")), "^00", "")
    each = df.select(F.col(number).alias("__n")).distinct().withColumn("__p", F.explode(F.array(*[F.struct(F.substring(d, 1, n).alias("prefix"), F.lit(n).alias("n")) for n in (1, 2, 3, 4)])))
    hit = each.select("__n", "__p.*").join(prefixes, "prefix").groupBy("__n").agg(F.max_by("country", "n").alias("country"))
    return df.join(hit, df[number].eqNullSafe(hit["__n"]), "left").drop("__n")


def series_lookup(df: DataFrame, number: str, series: DataFrame, name: str) -> DataFrame:
    """Adds ``<name>_operator`` and ``<name>_circle`` by the first five, else four digits of the national number (series, operator, circle)."""
    nat = national_number(F.col("__n"))
    each = df.select(F.col(number).alias("__n")).distinct().select("__n", F.substring(nat, 1, 5).alias("s5"), F.substring(nat, 1, 4).alias("s4"))
    five, four = (series.select(F.col("series").alias(k), F.struct("operator", "circle").alias(f"r{k}")) for k in ("s5", "s4"))
    hit = each.join(five, "s5", "left").join(four, "s4", "left").withColumn("r", F.coalesce("rs5", "rs4")).select("__n", F.col("r.operator").alias(f"{name}_operator"), F.col("r.circle").alias(f"{name}_circle"))
    return df.join(hit, df[number].eqNullSafe(hit["__n"]), "left").drop("__n")


def handset(df: DataFrame, imei: str, tac: DataFrame) -> DataFrame:
    """Adds make and model by the first eight digits of the IMEI (tac, make, model)."""
    return df.join(tac, F.substring(imei, 1, 8) == tac["tac"], "left").drop("tac")
