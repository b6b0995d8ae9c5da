"""Published lists of provider networks: files become CIDRs, CIDRs become merged ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.addresses import with_network
from .scratch import saved

# Where each provider's published JSON keeps its networks; a dot leads into the objects of a list. Null: one network a line.
FEEDS = {
    "Amazon": ["prefixes.ip_prefix", "ipv6_prefixes.ipv6_prefix"],
    "Google": ["prefixes.ipv4Prefix", "prefixes.ipv6Prefix"],
    "Cloudflare": None,
    "Fastly": ["addresses", "ipv6_addresses"],
    "GitHub": ["hooks", "web", "api", "git", "pages", "importer", "packages"],
}


def _schema(places: list[str]) -> str:
    lists: dict[str, list[str]] = {}
    for key, _, field in (p.partition(".") for p in places):
        lists.setdefault(key, []).append(field)
    return "struct<" + ", ".join(f"{k}: array<{'struct<' + ', '.join(f'{f}: string' for f in fields) + '>' if fields[0] else 'string'}>" for k, fields in lists.items()) + ">"


def networks_of(text: Column, provider: str) -> Column:
    """The networks of one feed's text, as an array of strings; other keys of the file are left out, and a text that is no JSON has none."""
    places = FEEDS[provider]
    if places is None:
        return F.split(text, r"\R")
    read = F.from_json(text, _schema(places))
    none = F.expr("cast(array() as array<string>)")
    return F.array_compact(F.concat(*[F.coalesce(read[p.partition(".")[0]][p.partition(".")[2]] if "." in p else read[p], none) for p in places]))


def feed(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """provider and cidr of a feed file. A JSON document has no lines, so a file is one row; published lists are a few MB."""
    text = spark.read.text(path, wholetext=FEEDS[provider] is not None)
    return text.select(F.lit(provider).alias("provider"), F.explode(networks_of(F.col("value"), provider)).alias("cidr")).where("trim(cidr) <> ''")


def merged(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and touching ranges (start, end behind the last; of any type that sorts) of each key as one each.

    Ranges are sorted over partitions, and each partition takes over the greatest end of those before it, so a key
    with most of all ranges is many tasks. What is known of a partition as a whole is one row for each key in it.
    """
    sort = ranges.select(*keys, "start", "end").repartitionByRange(*keys, "start")
    rows = saved(sort.withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*keys, "part").agg(F.max("end").alias("top"))
    rows = rows.join(tops.select(*keys, "part", F.max("top").over(before).alias("carry")), [*keys, "part"])
    w = Window.partitionBy(*keys, "part").orderBy("start", "end")
    top = F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("carry"))
    rows = rows.withColumn("new", F.when(F.col("start") <= top, 0).otherwise(1))
    rows = rows.withColumn("number", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    news = rows.groupBy(*keys, "part").agg(F.sum("new").alias("n"))
    rows = rows.join(news.select(*keys, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), [*keys, "part"])
    islands = rows.groupBy(*keys, (F.col("number") + F.col("offset")).alias("island")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return islands.drop("island")


def merged_networks(networks: DataFrame) -> DataFrame:
    """provider, family, start and end (behind the last) of the address ranges that a provider's networks (provider, cidr) cover, of both families; what is no network goes."""
    return merged(with_network(networks, "cidr"), ["provider", "family"])
