"""Attribution of single sessions: expected values as literals, longest prefixes against plain loops."""

import ipaddress
from datetime import datetime

import pytest

from callgrid.functions import services as s
from callgrid.operators import attribution as a

SCHEMA = "id long, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, bytes_uploaded long, bytes_downloaded long, start_time timestamp_ntz, tower_id string"
#: name: (source_ip, destination_ip, source_port, destination_port, protocol, up, down), what the result has
CASES = {
    "meta": ((None, "157.240.1.1", None, 443, "TCP", None, None), {"family": "Meta", "service": "Likely Meta", "confidence": 85, "category": "content"}),
    "google dns": ((None, "8.8.8.8", None, 53, "UDP", None, None), {"family": "Google", "confidence": 90, "subtype": "Lookup / resolution"}),
    "yandex": ((None, "77.88.5.5", None, 443, "TCP", None, None), {"family": "Yandex"}),
    "hosting": ((None, "108.61.1.1", None, 443, "TCP", None, None), {"category": "hosting", "family": "Vultr"}),
    "carrier": ((None, "49.40.1.2", None, 443, "TCP", None, None), {"category": "access_network", "service": "Reliance Jio (Access Network)", "confidence": 30}),
    "content beats carrier": (("49.40.1.2", "157.240.1.1", None, 443, "TCP", None, None), {"family": "Meta"}),
    "carrier keeps dns": (("117.200.1.1", "9.9.9.9", None, 53, "UDP", None, None), {"family": "DNS", "category": "service", "confidence": 95}),
    "carrier nat": ((None, "100.70.1.1", None, 443, "TCP", None, None), {"category": "internal", "service": "Carrier NAT (CGNAT)", "confidence": 70}),
    "private": ((None, "192.168.1.5", None, 445, "TCP", None, None), {"category": "internal", "service": "Likely SMB"}),
    "dns": ((None, None, None, 53, "UDP", None, None), {"family": "DNS", "confidence": 95, "evidence": ["Port 53", "DNS family port", "UDP aligned"]}),
    "stun": ((None, None, None, 3478, "UDP", None, None), {"family": "WhatsApp", "subtype": "Call initialization", "confidence": 96}),
    "whatsapp by bytes": ((None, None, None, 3479, "TCP", 200_000, 100_000), {"subtype": "Call duration / active session", "confidence": 88}),
    "vpn": ((None, "45.10.20.30", None, 51820, "UDP", None, None), {"category": "vpn", "subtype": "Keepalive / handshake", "confidence": 81}),
    "tor": ((None, "45.10.20.30", None, 9050, "TCP", None, None), {"category": "anonymization", "confidence": 72}),
    "mail": ((None, None, None, 587, "TCP", None, None), {"family": "Mail", "subtype": "Submission", "confidence": 84}),
    "database": ((None, None, None, 27017, "TCP", None, None), {"family": "Database"}),
    "later entry of a port": ((None, None, None, 27018, "TCP", None, None), {"family": "Gaming"}),
    "git": ((None, None, None, 9418, "TCP", None, None), {"family": "Development"}),
    "ephemeral source port": ((None, "45.10.20.30", 50005, 443, "TCP", None, None), {"service": "Likely Encrypted Web/App", "subtype": "Encrypted session", "confidence": 84}),
    "only an ephemeral source port": ((None, "45.10.20.30", 50005, 1, "TCP", None, None), {"service": "Likely MS Teams", "confidence": 47, "evidence": ["Port 50005", "Minimal media keepalive", "Ephemeral source-port match (low confidence)"]}),
    "source port is surer": ((None, "45.10.20.30", 5060, 80, "TCP", None, None), {"service": "Likely VoIP / SIP", "confidence": 92}),
    "first range counts": ((None, "45.10.20.30", None, 50030, "UDP", 600_000, 0), {"service": "Likely MS Teams", "subtype": "Active video call", "confidence": 86}),
    "traceroute": ((None, "45.10.20.30", None, 33440, "UDP", None, None), {"service": "Likely Traceroute", "family": "Infrastructure"}),
    "udp media": ((None, "45.10.20.30", None, 40000, "UDP", 6_000_000, None), {"service": "Likely Streaming / Media", "confidence": 60, "category": "unknown"}),
    "udp": ((None, "45.10.20.30", None, 40000, "UDP", 0, 0), {"service": "Likely Messaging / VoIP", "confidence": 42}),
    "tcp probe": ((None, "45.10.20.30", None, 40000, "TCP", 0, 0), {"service": "Likely Keepalive / Probe", "confidence": 36}),
    "tcp": ((None, "45.10.20.30", None, 40000, "TCP", 10, 0), {"service": "Likely Encrypted Web/App", "confidence": 26, "subtype": "Generic TCP session"}),
    "another protocol": ((None, "45.10.20.30", None, 40000, "GRE", 10, 0), {"service": "Likely Custom Protocol", "subtype": "Protocol GRE session", "confidence": 18}),
}


@pytest.fixture(scope="module")
def attributed(spark):
    at = datetime(2024, 1, 1)
    rows = [(i, *c[0], at, "T1") for i, c in enumerate(CASES.values())]
    df = a.attribute(spark.createDataFrame(rows, SCHEMA), s.networks(spark), s.ports(spark))
    return {name: r.asDict() for name, r in zip(CASES, sorted(df.collect(), key=lambda r: r["id"]), strict=True)}


@pytest.mark.parametrize("name", CASES)
def test_case(attributed, name):
    got = attributed[name]
    assert {k: got[k] for k in CASES[name][1]} == CASES[name][1]


def test_longest_prefix(spark):
    """Against a scan of all networks, an external list of two with an equal and a longer one among them."""
    more = [("8.8.8.0/24", "Mine", "yes"), ("157.240.1.0/28", "Deep", "0"), ("nonsense", "Bad", None), ("1.2.3.0/24", "", None), (None, "Bad", None)]
    external = spark.createDataFrame(more, "network string, org string, is_isp string")
    every = [("8.8.8.0/24", "Mine", True), ("157.240.1.0/28", "Deep", False)] + [(c, p, isp) for p, isp, cs in s.NETWORKS for c in cs.split()]
    ips = ["1.1.1.1", "8.8.8.8", "142.250.1.1", "3.5.140.1", "140.82.112.3", "151.101.1.1", "17.0.5.5", "49.32.5.5", "157.240.1.1", "157.240.1.99", "104.16.9.9", "203.0.113.7", "100.64.1.1", "10.0.0.1", "52.1.2.3", "x", None]
    want = {}
    for ip in ips:
        try:
            inside = [(ipaddress.ip_network(c), p, isp) for c, p, isp in every if ipaddress.ip_address(ip) in ipaddress.ip_network(c)]
        except ValueError:
            continue
        if inside:
            best = max(inside, key=lambda x: x[0].prefixlen)  # the first of equal ones
            want[ip] = (best[1], best[2], best[0].prefixlen)
    got = a.providers(spark.createDataFrame([(x,) for x in ips], "ip string"), s.networks(spark, external))
    assert {r["ip"]: (r["provider"], r["is_isp"], r["plen"]) for r in got.collect()} == want
    assert want["8.8.8.8"][0] == "Mine" and want["157.240.1.1"][0] == "Deep" and want["52.1.2.3"][0] == "Microsoft"


def test_apps(spark):
    rows = [(1, None, "9.9.9.9", 5000, 3478, "UDP"), (2, None, "9.9.9.9", 443, 9, "GRE"), (3, None, "9.9.9.9", 51820, 27015, "TCP"), (4, None, "9.9.9.9", 7, 8, "TCP")]
    df = spark.createDataFrame(rows, "id long, source_ip string, destination_ip string, source_port int, destination_port int, protocol string")
    got = {r["id"]: (r["app"], r["confidence"]) for r in a.app_by_port(df, s.apps(spark)).collect()}
    assert got == {1: ("WhatsApp", 95), 2: ("Telegram", 85), 3: ("Steam", 91)}
