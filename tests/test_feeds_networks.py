"""Addresses of both families and provider feeds, against the standard library's ipaddress."""

import ipaddress
import json
import random

from pyspark.sql import functions as F

from callgrid.functions import addresses as ad
from callgrid.sources import feeds

ODD = ["", None, "1.2.3", "1.2.3.256", "::1::", ":::", "1:2:3", "g::", "12345::", "::1%eth0", "1:2:3:4:5:6:7:8:9", "::1.2.3.300", "1:2:3:4:5:6:7::8", "1.2.3.4:5", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:"]


def number(x):
    return int(x["high"]) * 2**64 + int(x["low"])


def texts(rng, n):
    out = []
    for _ in range(n):
        bits = rng.choice([8, 40, 64, 100, 128])
        six = ipaddress.IPv6Address(rng.getrandbits(bits) << rng.choice([0, 128 - bits]))
        four = ipaddress.IPv4Address(rng.getrandbits(32))
        out += [str(four), str(six), six.exploded, str(six).upper(), f"::ffff:{four}", f" {six} "]
    return out


def parsed(text):
    try:
        return ipaddress.ip_address((text or "").strip().partition("%")[0] if "%" not in (text or "") else "x")
    except ValueError:
        return None


def test_addresses(spark):
    every = texts(random.Random(1), 100) + ODD + ["::", "::1", "1::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "255.255.255.255", "0.0.0.0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(every)], "i int, ip string")
    for r in df.select("ip", ad.address(F.col("ip")).alias("a")).collect():
        want = parsed(r["ip"])
        if want is None:
            assert r["a"] is None, r
        else:
            assert (r["a"]["family"], number(r["a"])) == (want.version, int(want)), r


def nets(rng, n):
    """Networks that nest, touch and lie apart."""
    out = []
    for _ in range(n):
        plen = rng.randint(20, 32)
        out.append(f"{ipaddress.IPv4Address((10 << 24) + rng.getrandbits(14))}/{plen}")
        out.append(f"{ipaddress.IPv6Address((0x2001 << 112) + (rng.getrandbits(6) << 62) + rng.getrandbits(3))}/{rng.choice([60, 63, 64, 66, 126, 128])}")
    return out


def ranges_of(cidrs):
    out = set()
    for version in (4, 6):
        every = []
        for c in cidrs:
            try:
                every.append(ipaddress.ip_network(c.strip(), strict=False))
            except ValueError:
                continue
        spans = sorted((int(n.network_address), int(n.broadcast_address) + 1) for n in every if n.version == version)
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(version, a, b) for a, b in merged}
    return out


def test_merged_networks_of_both_families(spark):
    rng = random.Random(2)
    lists = {"A": nets(rng, 300), "B": nets(rng, 20) + ["0.0.0.0/0", "::/0"], "C": ["x", "1.2.3.4", "1.2.3.5/32", "1.2.3.4/33", "::1/129", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "255.255.255.255", "1::/64", "1:0:0:1::/64", "0:0:0:2::/64", "0:0:0:1:8000::/65", "0:0:0:1::/65"]}
    df = spark.createDataFrame([(p, c) for p, every in lists.items() for c in every], "provider string, cidr string").repartition(7)
    got = {p: set() for p in lists}
    for r in feeds.merged_networks(df).collect():
        got[r["provider"]].add((r["family"], number(r["start"]), number(r["end"])))
    assert got == {p: ranges_of(every) for p, every in lists.items()}
    assert feeds.merged_networks(df.limit(0)).count() == 0


def test_merge_goes_on_over_partitions(spark):
    """One range over all others, and a chain that touches from end to end, in many partitions."""
    rows = [("chain", i, i + 1) for i in range(500)] + [("cover", 0, 10_000)] + [("cover", 10 * i, 10 * i + 3) for i in range(900)] + [("apart", 10 * i, 10 * i + 3) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, start long, end long").repartition(9)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in feeds.merged(df, ["k"]).select("k", "start", "end").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == {("chain", 0, 500), ("cover", 0, 10_000)} | {("apart", 10 * i, 10 * i + 3) for i in range(300)}


def test_feed_files(spark, tmp_path):
    docs = {
        "Amazon": {"syncToken": "1", "prefixes": [{"ip_prefix": "3.5.0.0/19", "region": "x"}, {"region": "none"}], "ipv6_prefixes": [{"ipv6_prefix": "2600:1f00::/24"}]},
        "Google": {"prefixes": [{"ipv4Prefix": "8.8.4.0/24"}, {"ipv6Prefix": "2001:4860::/32"}]},
        "Fastly": {"addresses": ["23.235.32.0/20"], "ipv6_addresses": ["2a04:4e40::/32"]},
        "GitHub": {"hooks": ["192.30.252.0/22"], "web": ["192.30.252.0/22", "185.199.108.0/22"], "actions": ["4.148.0.0/16"], "domains": {"website": ["*.x"]}, "packages": ["140.82.121.33/32"]},
    }
    want = {"Amazon": {"3.5.0.0/19", "2600:1f00::/24"}, "Google": {"8.8.4.0/24", "2001:4860::/32"}, "Fastly": {"23.235.32.0/20", "2a04:4e40::/32"}, "GitHub": {"192.30.252.0/22", "185.199.108.0/22", "140.82.121.33/32"}, "Cloudflare": {"173.245.48.0/20", "2400:cb00::/32"}}
    for provider, doc in docs.items():
        (tmp_path / f"{provider}.txt").write_text(json.dumps(doc, indent=1))
    (tmp_path / "Cloudflare.txt").write_text("173.245.48.0/20\n\n2400:cb00::/32\n")
    for provider, every in want.items():
        rows = feeds.feed(spark, str(tmp_path / f"{provider}.txt"), provider).collect()
        assert {r["cidr"].strip() for r in rows} == every and {r["provider"] for r in rows} == {provider}
    (tmp_path / "odd.txt").write_text("not json")
    assert feeds.feed(spark, str(tmp_path / "odd.txt"), "Google").count() == 0


def test_longest_network_of_both_families(spark):
    rng = random.Random(3)
    every = [(i, f"P{i}", i % 3 == 0, c) for i, c in enumerate(nets(rng, 60) + ["10.0.0.0/8", "2001::/16", "10.0.0.0/8", "bad/x"])]
    ips = [str(ipaddress.IPv4Address((10 << 24) + rng.getrandbits(14))) for _ in range(200)] + [str(ipaddress.IPv6Address((0x2001 << 112) + (rng.getrandbits(6) << 62) + rng.getrandbits(3))) for _ in range(200)] + ["11.0.0.1", "::5", "bad", None]
    found = ad.providers(spark.createDataFrame([(x,) for x in ips], "ip string"), spark.createDataFrame(every, "ord long, provider string, is_isp boolean, cidr string"))
    want = {}
    for ip in {x for x in ips if x and x != "bad"}:
        a = ipaddress.ip_address(ip)
        best = None
        for _, p, isp, c in every:
            if c == "bad/x":
                continue
            net = ipaddress.ip_network(c, strict=False)
            if a.version == net.version and a in net and (best is None or net.prefixlen > best[3]):
                best = (p, isp, c, net.prefixlen)
        if best:
            want[ip] = best
    assert {r["ip"]: tuple(r)[1:] for r in found.collect()} == want
