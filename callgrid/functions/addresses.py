"""Addresses and networks of both families as numbers: a family, and an address in two halves of 64 bits.

Halves are decimal(20, 0), as Spark's long has a sign; an IPv4 address lies in the lower half. A struct of both
halves sorts as the address does.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import ip_number

HALF = "decimal(20,0)"


def _power(k: Column) -> Column:
    """2 to the k, for k from 0 to 64."""
    return F.element_at(F.array(*[F.lit(Decimal(2**i)).cast(HALF) for i in range(65)]), (k + 1).cast("int"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _plain(text: Column, tail: Column) -> Column:
    """The text with a dotted tail as two groups."""
    as_groups = _let(ip_number(tail), lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(65535)))))
    return F.when(tail == "", text).otherwise(F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), as_groups))


def _filled(sides: Column) -> Column:
    """The groups of a text that is split at ``::``, zeros between its sides; null if it cannot have eight."""
    part = lambda i: F.when(sides[i] == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(sides[i], ":"))
    short = _let(F.array(part(0), part(1)), lambda p: F.when(F.size(p[0]) + F.size(p[1]) < 8, F.concat(p[0], F.array_repeat(F.lit("0"), 8 - F.size(p[0]) - F.size(p[1])), p[1])))
    return F.when(F.size(sides) == 1, F.split(sides[0], ":")).when(F.size(sides) == 2, short)


def _six(text: Column) -> Column:
    """family, high and low of an IPv6 text; null if it is none."""
    plain = _let(F.regexp_extract(text, r":([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1), lambda tail: _plain(text, tail))
    groups = _let(F.split(plain, "::"), _filled)
    good = lambda g: (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
    digits = _let(groups, lambda g: F.when(good(g), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")))
    half = lambda d, start: F.conv(F.substring(d, start, 16), 16, 10).cast(HALF)
    return _let(digits, lambda d: F.when(d.isNotNull(), F.struct(F.lit(6).alias("family"), half(d, 1).alias("high"), half(d, 17).alias("low"))))


def address(ip: Column) -> Column:
    """family (4 or 6), high and low of an address in text; null for anything else, scopes (``%``) among them."""
    four = lambda text: _let(ip_number(text), lambda n: F.when(n.isNotNull(), F.struct(F.lit(4).alias("family"), F.lit(0).cast(HALF).alias("high"), n.cast(HALF).alias("low"))))
    return _let(F.lower(F.trim(ip)), lambda text: F.when(text.contains(":"), _six(text)).otherwise(four(text)))


def _free(family: Column, plen: Column) -> Column:
    """The bits that a network of that length leaves open."""
    return F.when(family == 4, 32 - plen).otherwise(128 - plen)


def masked(family: Column, high: Column, low: Column, plen: Column) -> Column:
    """The first address of the network of that prefix length that holds the address."""
    cut = lambda half, k: _let(_power(k), lambda p: (half - half % p).cast(HALF))
    free = _free(family, plen)
    return F.struct(cut(high, F.greatest(free - 64, F.lit(0))).alias("high"), cut(low, F.least(free, F.lit(64))).alias("low"))


def after(family: Column, start: Column, plen: Column) -> Column:
    """The address behind the network that begins at ``start`` (that of the whole space is 2 to the 64 in the upper half, or to the 32)."""
    free = _free(family, plen)

    def narrow(low: Column) -> Column:
        over = (family == 6) & (low >= Decimal(2**64))
        return F.struct((start["high"] + F.when(over, 1).otherwise(0)).cast(HALF).alias("high"), F.when(over, low - Decimal(2**64)).otherwise(low).cast(HALF).alias("low"))

    wide = F.struct((start["high"] + _power(F.greatest(free - 64, F.lit(0)))).cast(HALF).alias("high"), start["low"].cast(HALF).alias("low"))
    return F.when((family == 6) & (free > 64), wide).otherwise(_let(start["low"] + _power(F.least(free, F.lit(64))), narrow))


def with_network(rows: DataFrame, cidr: str) -> DataFrame:
    """Adds family, plen, start and end (behind the last) of a network in text; host bits are cut, no length means one address, rows that are no network go."""
    text = F.trim(F.col(cidr))
    sides = F.split(text, "/")
    rows = rows.withColumn("__a", address(sides[0])).withColumn("family", F.col("__a.family"))
    longest = F.when(F.col("family") == 4, 32).otherwise(128)
    plen = F.when(F.size(sides) == 1, longest).when((F.size(sides) == 2) & sides[1].rlike("^[0-9]{1,3}$"), sides[1].try_cast("int"))
    rows = rows.withColumn("plen", plen).where(F.col("family").isNotNull() & (F.col("plen") <= longest))
    rows = rows.withColumn("start", masked(F.col("family"), F.col("__a.high"), F.col("__a.low"), F.col("plen"))).drop("__a")
    return rows.withColumn("end", after(F.col("family"), F.col("start"), F.col("plen")))


def providers(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """ip, provider, is_isp, cidr and plen of the longest network (ord, provider, is_isp, cidr) of either family that holds each distinct ``ip``; of equal ones the first by ord.

    As for IPv4 alone, an address is looked up by its first bits, once for each family and length that networks
    have (at most 33 and 129 numbers reach the driver): a join on equal keys, whatever the number of networks.
    """
    nets = with_network(networks, "cidr").select("family", "plen", "start", "ord", "provider", "is_isp", "cidr")
    lengths = [(r["family"], r["plen"]) for r in nets.select("family", "plen").distinct().collect()]
    each = addresses.select("ip").distinct().withColumn("a", address(F.col("ip"))).where("a IS NOT NULL").select("ip", "a.*")
    wanted = lambda family: F.array(*[F.lit(p) for f, p in lengths if f == family]).cast("array<int>")
    keys = each.withColumn("plen", F.explode(F.when(F.col("family") == 4, wanted(4)).otherwise(wanted(6))))
    keys = keys.select("ip", "family", "plen", masked(F.col("family"), F.col("high"), F.col("low"), F.col("plen")).alias("start"))
    best = keys.join(nets, ["family", "plen", "start"]).groupBy("ip").agg(F.max_by(F.struct("provider", "is_isp", "cidr", "plen"), F.struct("plen", -F.col("ord"))).alias("p"))
    return best.select("ip", "p.*")
