"""Service attribution of sessions: longest prefix of the address, port tables, merge, summary; and sessions over attributed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import addresses as ad
from ..functions import services as s
from ..functions.exprs import epoch, ip_number


def address_kind(ip: Column) -> Column:
    """cgnat, loopback, link-local or private; null for public and odd addresses."""
    n, out = ip_number(ip), None
    for name, cidr in s.SPECIAL:
        base, plen = cidr.split("/")
        a, b, c, d = map(int, base.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        inside = n.between(low, low + 2 ** (32 - int(plen)) - 1)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def providers(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """provider, is_isp, hosting, cidr and plen of the longest network that holds each distinct address (ip); of equal ones the first by ord.

    An address is looked up by its first bits, once for each length that networks have (at most 33 numbers reach
    the driver), so the join is on equal keys whatever the number of networks.
    """
    lengths = [r[0] for r in networks.select("plen").distinct().collect()]
    each = addresses.select("ip").distinct().withColumn("n", ip_number(F.col("ip"))).where("n IS NOT NULL")
    base = lambda plen: F.shiftleft(F.shiftright("n", 32 - plen), 32 - plen)
    keys = F.array(*[F.struct(F.lit(x).alias("plen"), base(x).alias("lo")) for x in lengths]) if lengths else F.expr("cast(array() as array<struct<plen: int, lo: bigint>>)")
    hit = each.select("ip", F.explode(keys).alias("k")).select("ip", "k.*").join(networks, ["plen", "lo"])
    best = hit.groupBy("ip").agg(F.max_by(F.struct("provider", "is_isp", "hosting", "cidr", "plen"), F.struct("plen", -F.col("ord"))).alias("p"))
    return best.select("ip", "p.*")


def total_bytes() -> Column:
    return (F.coalesce("bytes_uploaded", F.lit(0)) + F.coalesce("bytes_downloaded", F.lit(0))).cast("long")


def _first(tests: list[Column]) -> Column:
    """The number (from 1) of the first test that holds, or null."""
    out = F.when(tests[0], 1)
    for i, t in enumerate(tests[1:], 2):
        out = out.when(t, i)
    return out


def _at(values: list, index: Column | str) -> Column:
    """The value of that number."""
    return F.try_element_at(F.array(*map(F.lit, values)), F.col(index) if isinstance(index, str) else index)


def _rule(family: Column, port: Column, protocol: Column, size: Column) -> Column:
    """The number of the rule that a service family, its port, protocol and bytes meet; null for families without rules."""
    every = []
    for name, proto, ports, over, under, *_ in s.RULES:
        tests = [c for c in (protocol == proto if proto else None, port.isin(ports) if ports else None) if c is not None]
        if len(tests) == 2:
            tests = [tests[0] & tests[1] if name == "WhatsApp" else tests[0] | tests[1]]
        tests += [c for c in (size > over if over is not None else None, size < under if under is not None else None) if c is not None]
        every.append(reduce(Column.__and__, [family == name, *tests]))
    return _first(every)


def _candidate(rows: DataFrame, side: str, ports: DataFrame) -> DataFrame:
    """Adds what a port (destination or source) speaks for: ``side``_service, _family, _rule, _aligned and _confidence, null if it says nothing."""
    port, proto = F.col(f"{side}_port").cast("int"), F.col("__protocol")
    known = ports.select(F.col("port").alias("__port"), F.col("service").alias("__s"), F.col("family").alias("__f"))
    rows = rows.join(F.broadcast(known), port == known["__port"], "left").withColumn("__range", s.in_range(port))
    rows = rows.withColumns({f"{side}_service": F.coalesce("__s", _at([f"Likely {r[2]}" for r in s.RANGES], "__range")), f"{side}_family": F.coalesce("__f", _at([r[3] for r in s.RANGES], "__range"))})
    rows = rows.withColumn(f"{side}_rule", _rule(F.col(f"{side}_family"), port, proto, F.col("__bytes")))
    bonus = F.lit(0)
    for name, every, n in s.ALIGNED:
        bonus = F.when((proto == name) & port.isin(every), n).otherwise(bonus)
    rows = rows.withColumn(f"{side}_aligned", bonus)
    base = F.when(F.col(f"{side}_family").isNotNull(), F.coalesce(_at([r[6] for r in s.RULES], f"{side}_rule"), F.lit(60)))
    sure = F.when(F.col(f"{side}_aligned") > 0, F.least(F.lit(s.MOST_SURE), base + F.col(f"{side}_aligned"))).otherwise(base)
    return rows.withColumn(f"{side}_confidence", sure).drop("__port", "__s", "__f", "__range")


def ranged(rows: DataFrame) -> DataFrame:
    """destination_port, service and family of the ports that lie in a range."""
    found = rows.withColumn("__range", s.in_range(F.col("destination_port"))).where("__range IS NOT NULL")
    return found.select("destination_port", _at([f"Likely {r[2]}" for r in s.RANGES], "__range").alias("service"), _at([r[3] for r in s.RANGES], "__range").alias("family"))


def by_port(ipdr: DataFrame, ports: DataFrame) -> DataFrame:
    """Adds port_service, port_family, port_subtype, port_confidence, port, port_category and port_evidence by the ports, or by protocol and bytes where they say nothing.

    The destination port comes first; the source port speaks if its family is another one. An ephemeral source
    port counts only where nothing else does, and then little. The best is the surest, then the lower port.
    """
    rows = ipdr.withColumn("__protocol", F.upper(F.coalesce("protocol", F.lit("")))).withColumn("__bytes", total_bytes())
    rows = _candidate(_candidate(rows, "destination", ports), "source", ports)
    to, since = F.col("destination_family").isNotNull(), F.col("source_family").isNotNull()
    late = F.col("source_port") >= s.EPHEMERAL
    sure = (F.col("source_confidence") > F.col("destination_confidence")) | ((F.col("source_confidence") == F.col("destination_confidence")) & (F.col("source_port") < F.col("destination_port")))
    side = F.when(to & (~since | late | (F.col("source_family") == F.col("destination_family")) | ~sure), 1).when(since, 2).otherwise(0)
    proto, size = F.col("__protocol"), F.col("__bytes")
    other = _first([reduce(Column.__and__, [proto == name if name else F.lit(True), *([size > over] if over is not None else [])]) for name, over, *_ in s.FALLBACK])
    probe = (size == 0) & (F.coalesce(F.nullif("destination_port", F.lit(0)), F.nullif("source_port", F.lit(0)), F.lit(0)) != 0)
    rows = rows.withColumns({"__side": side, "__other": other, "__probe": probe, "__late": late})
    rows = rows.withColumn("__probe", F.col("__probe") & (_at([r[4] for r in s.FALLBACK], "__other") < s.PROBE[2]))
    pick = lambda c, none: F.when(F.col("__side") == 1, F.col(f"destination_{c}")).when(F.col("__side") == 2, F.col(f"source_{c}")).otherwise(none)
    weak = (F.col("__side") == 2) & F.col("__late")
    name = F.when(F.col("__probe"), s.PROBE[0]).otherwise(_at([r[2] for r in s.FALLBACK], "__other"))
    rest = F.when(F.col("__probe"), s.PROBE[1]).otherwise(F.coalesce(_at([r[3] for r in s.FALLBACK], "__other"), F.concat(F.lit("Protocol "), proto, F.lit(" session"))))
    little = F.when(F.col("__probe"), s.PROBE[2]).otherwise(_at([r[4] for r in s.FALLBACK], "__other"))
    rows = rows.withColumns(
        {
            "port_service": pick("service", name), "port_family": pick("family", name), "port": pick("port", F.lit(None)).cast("int"),
            "__rule": pick("rule", F.lit(None)), "__aligned": pick("aligned", F.lit(0)), "__sure": pick("confidence", little),
        }
    )
    rows = rows.withColumns(
        {
            "port_subtype": F.when(F.col("__side") == 0, rest).otherwise(F.coalesce(_at([r[5] for r in s.RULES], "__rule"), F.lit("Session"))),
            "port_confidence": F.when(weak, F.greatest(F.lit(10), F.col("__sure") - 25)).otherwise(F.col("__sure")).cast("long"),
            "port_category": F.when(F.col("__side") == 0, "unknown").when(F.col("port_family") == "VPN / Tunnel", "vpn").when(F.col("port_family") == "Proxy / Tor", "anonymization").otherwise("service"),
            "port_evidence": F.when(F.col("__side") == 0, F.array(F.concat(F.lit("Protocol "), proto))).otherwise(
                F.array_compact(
                    F.array(
                        F.concat(F.lit("Port "), F.col("port").cast("string")), F.coalesce(_at([r[7] for r in s.RULES], "__rule"), F.lit("Generic service family")),
                        F.when(F.col("__aligned") > 0, F.concat(proto, F.lit(" aligned"))), F.when(weak, F.lit("Ephemeral source-port match (low confidence)")),
                    )
                )
            ),
        }
    )
    return rows.select(*ipdr.columns, *(f"port_{c}" for c in ("service", "family", "subtype", "confidence", "category", "evidence")), "port")


def attribute(ipdr: DataFrame, networks: DataFrame, ports: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """Adds provider, service, subtype, family, category, confidence and evidence to each session.

    A special destination is internal, though a port that says something keeps its service. A content provider
    names the service, its surety growing with the length of the network. Where the destination has no provider,
    the access network of the source counts; an access network leaves a port that says something its service and
    else is all there is. Otherwise the ports decide. Addresses are looked up once each. ``wide`` (ord, provider,
    is_isp, cidr) gives the IPv6 networks, if there are any.
    """
    ips = ipdr.select(F.col("destination_ip").alias("ip")).union(ipdr.select("source_ip"))
    found = providers(ips, networks)
    if wide is not None:
        six = ad.providers(ips.where("contains(ip, ':')"), wide).withColumn("hosting", F.col("provider").isin(s.HOSTING))
        found = found.unionByName(six)
    side = lambda df, key, n: df.select(F.col("ip").alias(key), *[F.col(c).alias(f"{n}_{c}") for c in ("provider", "is_isp", "hosting", "cidr", "plen")])
    rows = by_port(ipdr, ports).join(side(found, "destination_ip", "__d"), "destination_ip", "left").join(side(found.where("is_isp"), "source_ip", "__s"), "source_ip", "left")
    net = lambda c: F.coalesce(f"__d_{c}", f"__s_{c}")
    rows = rows.withColumns({"provider": net("provider"), "__isp": net("is_isp"), "__hosting": net("hosting"), "__cidr": net("cidr"), "__plen": net("plen"), "__kind": address_kind(F.col("destination_ip"))})
    telling = F.col("port").isNotNull() & ~F.col("port_family").isin(s.GENERIC)
    way = (
        F.when(F.col("__kind").isNotNull(), F.when(telling, "named").otherwise("internal")).when(F.col("provider").isNull(), "port")
        .when(~F.col("__isp"), "content").when(telling, "carried").otherwise("access")
    )
    rows = rows.withColumn("__way", way)
    w, provider = F.col("__way"), F.col("provider")
    label = F.create_map(*[F.lit(x) for kv in s.SPECIAL_NAMES.items() for x in kv])[F.col("__kind")]
    proto = F.when(F.coalesce("protocol", F.lit("")) == "", "Protocol unknown").otherwise(F.concat(F.lit("Protocol "), F.upper("protocol")))
    carrier = F.concat(provider, F.lit(" access network ("), F.col("__cidr"), F.lit(")"))
    host = F.when(F.col("__hosting"), F.lit("Cloud/VPS host — possible VPN, proxy, or self-hosted endpoint"))
    seen = F.array_compact(F.array(F.concat(provider, F.lit(" IP range ("), F.col("__cidr"), F.lit(")")), host))
    sure = F.when(F.col("__plen") >= 20, 90).when(F.col("__plen") >= 16, 85).otherwise(78)
    evidence = (
        F.when(w == "named", F.array_append("port_evidence", F.concat(label, F.lit(" destination")))).when(w == "internal", F.array(F.concat(label, F.lit(" destination IP")), proto))
        .when(w == "content", F.slice(F.array_distinct(F.concat(seen, "port_evidence")), 1, 5)).when(w == "carried", F.array_append("port_evidence", carrier)).when(w == "access", F.array(carrier, proto)).otherwise(F.col("port_evidence"))
    )
    return rows.select(
        *ipdr.columns, "provider",
        F.when(w == "internal", label).when(w == "content", F.concat(F.lit("Likely "), provider)).when(w == "access", F.concat(provider, F.lit(" (Access Network)"))).otherwise(F.col("port_service")).alias("service"),
        F.when(w == "internal", "Internal / non-routable").when(w == "access", "Carrier / ISP traffic").otherwise(F.col("port_subtype")).alias("subtype"),
        F.when(w == "internal", "Private").when(w == "content", provider).when(w == "access", "Access Network").otherwise(F.col("port_family")).alias("family"),
        F.when(w.isin("named", "internal"), "internal").when(w == "content", F.when(F.col("__hosting"), "hosting").otherwise("content")).when(w == "access", "access_network").otherwise(F.col("port_category")).alias("category"),
        F.when(w == "internal", 70).when(w == "content", sure).when(w == "access", 30).otherwise(F.col("port_confidence")).cast("long").alias("confidence"), evidence.alias("evidence"),
    )


def service_summary(rows: DataFrame) -> DataFrame:
    """Sessions and bytes of each service, with the surest of its sessions (the first of equal ones) as example."""
    example = F.min_by(F.struct("id", "subtype", "family"), F.struct(-F.col("confidence"), F.col("start_time"), F.col("id"))).alias("e")
    return rows.groupBy("service").agg(F.count("*").alias("n"), F.sum(total_bytes()).alias("bytes"), F.max("confidence").alias("confidence"), example).select(
        "service", "n", "bytes", "confidence", F.col("e.id").alias("example"), F.col("e.subtype").alias("subtype"), F.col("e.family").alias("family")
    )


def port_family(ipdr: DataFrame, families: DataFrame) -> DataFrame:
    """Adds ``family`` of activity: that of the destination port, else of the source port, else Other."""
    to = families.select(F.col("port").alias("destination_port"), F.col("family").alias("__to"))
    since = families.select(F.col("port").alias("source_port"), F.col("family").alias("__from"))
    rows = ipdr.join(F.broadcast(to), "destination_port", "left").join(F.broadcast(since), "source_port", "left")
    return rows.withColumn("family", F.coalesce("__to", "__from", F.lit("Other"))).select(*ipdr.columns, "family")


def port_names(ipdr: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``port_name`` of the destination port; null where it has none."""
    return ipdr.join(F.broadcast(names.select(F.col("port").alias("destination_port"), F.col("name").alias("port_name"))), "destination_port", "left").select(*ipdr.columns, "port_name")


def in_sessions(ipdr: DataFrame, families: DataFrame) -> DataFrame:
    """Adds family and session, a number within source, destination and family.

    Rows of one source, destination and port family without a gap longer than the family's are one session. The
    source is part of the key, so subjects do not mix. Rows without a time never split.
    """
    rows = port_family(ipdr, families).withColumn("destination_ip", F.coalesce("destination_ip", F.lit("?")))
    gap = F.create_map(*[F.lit(x) for kv in s.GAPS.items() for x in kv])[F.col("family")]
    w = Window.partitionBy("source_ip", "destination_ip", "family").orderBy("start_time", "id")
    new = F.when(epoch("start_time") - epoch(F.lag("start_time").over(w)) > gap, 1).otherwise(0)
    return rows.withColumn("new", new).withColumn("session", F.sum("new").over(w)).drop("new")


def ipdr_sessions(ipdr: DataFrame, families: DataFrame) -> DataFrame:
    """One row for each session: rows, seconds, bytes, first tower, start and end."""
    end = F.coalesce("end_time", "start_time") if "end_time" in ipdr.columns else F.col("start_time")
    at = F.struct("start_time", "id")
    return in_sessions(ipdr, families).groupBy("source_ip", "destination_ip", "family", "session").agg(
        F.count("*").alias("rows"), F.floor(epoch(F.max(end)) - epoch(F.min("start_time"))).cast("long").alias("seconds"),
        F.sum(F.coalesce("bytes_uploaded", F.lit(0))).alias("up"), F.sum(F.coalesce("bytes_downloaded", F.lit(0))).alias("down"), F.min_by("tower_id", at).alias("tower"),
        F.min("start_time").alias("start"), F.max(end).alias("end"),
    )


def session_services(attributed: DataFrame, families: DataFrame) -> DataFrame:
    """Each session of attributed rows with the service, subtype, confidence and service family of its surest row, the earliest of equal ones."""
    best = F.min_by(F.struct("service", "subtype", "confidence", F.col("service_family").alias("service_family")), F.struct(-F.col("confidence"), F.col("start_time"), F.col("id")))
    rows = in_sessions(attributed.withColumnRenamed("family", "service_family"), families)
    return rows.groupBy("source_ip", "destination_ip", "family", "session").agg(F.count("*").alias("rows"), best.alias("b")).select("source_ip", "destination_ip", "family", "session", "rows", "b.*")


def talk_sessions(rows: DataFrame, minutes: int = 30) -> DataFrame:
    """Sessions of a subject, split at gaps over half an hour, each with the gap before it."""
    w = Window.partitionBy("subject").orderBy("start_time", "id")
    gap = epoch("start_time") - epoch(F.lag("start_time").over(w))
    r = rows.withColumn("gap", gap).withColumn("session", F.sum(F.when(F.col("gap") > minutes * 60, 1).otherwise(0)).over(w))
    return r.groupBy("subject", "session").agg(F.count("*").alias("calls"), F.sum(F.coalesce("duration_seconds", F.lit(0))).alias("seconds"), F.countDistinct("b_party_number").alias("others"), F.round(F.min_by("gap", F.struct("start_time", "id")) / 60, 2).alias("gap_before_min"), F.min("start_time").alias("start"))


def session_gaps(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("subject").orderBy("start_time", "id")
    g = rows.select("subject", (epoch("start_time") - epoch(F.lag("start_time").over(w))).alias("gap"))
    return g.groupBy("subject").agg(F.round(F.avg("gap") / 60, 2).alias("avg_min"), F.round(F.max("gap") / 60, 2).alias("max_min"), F.round(F.min("gap") / 60, 2).alias("min_min"), *[F.count_if(F.col("gap") > h * 3600).alias(f"over_{h}h") for h in (1, 6, 24)])


def entities(cdr: DataFrame) -> DataFrame:
    """Everyone in a call: events, types, contacts, first and last time."""
    side = lambda a, b: cdr.select(F.col(a).alias("entity"), F.col(b).alias("contact"), "call_type", "start_time")
    e = side("a_party_number", "b_party_number").union(side("b_party_number", "a_party_number")).where("entity IS NOT NULL")
    return e.groupBy("entity").agg(F.count("*").alias("events"), F.countDistinct("call_type").alias("types"), F.countDistinct("contact").alias("contacts"), F.date_format(F.min("start_time"), "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format(F.max("start_time"), "yyyy-MM-dd HH:mm:ss").alias("last"))


def compressed(rows: DataFrame) -> DataFrame:
    """Consecutive events of one type in a day as one block with their number."""
    w = Window.partitionBy("subject", "day").orderBy("start_time", "id")
    r = rows.withColumn("day", F.date_format("start_time", "yyyy-MM-dd"))
    change = F.when(F.lag("call_type").over(w) == F.col("call_type"), 0).otherwise(1)
    r = r.withColumn("c", change).withColumn("block", F.sum("c").over(w))
    return r.groupBy("subject", "day", "block", "call_type").agg(F.count("*").alias("times"))


def app_by_port(ipdr: DataFrame, apps: DataFrame) -> DataFrame:
    """id, app and confidence: the first app (by ord) that lists a session's destination or source port, surer on its usual protocol. apps: port, ord, app, protocols, confidence."""
    side = lambda name: apps.select(F.col("port").alias(f"{name}_port"), F.struct("ord", "app", "protocols", "confidence").alias(f"__{name}"))
    rows = ipdr.join(F.broadcast(side("destination")), "destination_port", "left").join(F.broadcast(side("source")), "source_port", "left")
    rows = rows.withColumn("a", F.least("__destination", "__source")).where("a IS NOT NULL")
    usual = F.array_contains("a.protocols", F.upper(F.coalesce("protocol", F.lit(""))))
    sure = F.when(usual, F.least(F.lit(s.APP_SURE), F.col("a.confidence") + s.APP_BONUS)).otherwise(F.col("a.confidence"))
    return rows.select("id", F.col("a.app").alias("app"), sure.cast("long").alias("confidence"))


def app_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("app").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))
