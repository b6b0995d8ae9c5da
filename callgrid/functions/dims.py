"""Small dimensions for examples and tests. The whole tables (country prefixes, number series, handset models, cities) are the user's files, read by ``sources.readers.dimension``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Country prefixes of the examples and tests.
ISD = [("1", "United States"), ("44", "United Kingdom"), ("91", "India"), ("92", "Pakistan"), ("971", "United Arab Emirates"), ("98", "Iran"), ("880", "Bangladesh"), ("977", "Nepal"), ("86", "China")]
# Number series (first four or five digits) with operator and circle, made up.
SERIES = [("9800", "OpA", "North"), ("98000", "OpB", "South"), ("9801", "OpC", "East")]
# Type allocation codes with make and model, made up.
TAC = [("35000000", "Acme", "One"), ("35000001", "Acme", "Two")]
# Some cities with their positions, in table order.
CITIES = [
    ("Chennai", "Tamil Nadu", 13.0827, 80.2707), ("Delhi", "Delhi", 28.6139, 77.209), ("Mumbai", "Maharashtra", 19.076, 72.8777), ("Kolkata", "West Bengal", 22.5726, 88.3639),
    ("Bengaluru", "Karnataka", 12.9716, 77.5946), ("Hyderabad", "Telangana", 17.385, 78.4867), ("Jaipur", "Rajasthan", 26.9124, 75.7873), ("Guwahati", "Assam", 26.1445, 91.7362),
]


def isd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ISD, "prefix string, country string")


def series(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SERIES, "series string, operator string, circle string")


def tac(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAC, "tac string, make string, model string")


def cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CITIES)], "ord int, city string, state string, latitude double, longitude double")
