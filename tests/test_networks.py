"""Networks and ranges of both families against a loop over all of them."""

import ipaddress
import random

from decoyscope.operators import networks


def holds(network, address):
    try:
        at = ipaddress.ip_address(address.strip())
        at = getattr(at, "ipv4_mapped", None) or at
        if "-" in network:
            first, last = (ipaddress.ip_address(x) for x in network.split("-"))
            size = int(last) - int(first) + 1
        else:
            net = ipaddress.ip_network(network, strict=False)
            first, last, size = net[0], net[-1], net.num_addresses
        return size if first.version == at.version and first <= at <= last else None
    except (ValueError, AttributeError):
        return None


def test_the_smallest_network_wins(spark):
    rng = random.Random(6)
    v4 = lambda: str(ipaddress.IPv4Address(rng.randrange(2**32 - 2**20, 2**32)))
    v6 = lambda: str(ipaddress.IPv6Address((0x20010DB8 << 96) + rng.getrandbits(70)))
    nets = ["0.0.0.0/0", "::/0", "255.255.0.0/16", "255.255.255.255/32", "bad/8", "1.2.3.4-", "9.9.9.9-1.1.1.1", None]
    nets += [f"{v4()}/{rng.randrange(12, 33)}" for _ in range(40)] + [f"{v6()}/{rng.randrange(50, 129)}" for _ in range(40)]
    nets += ["-".join(map(str, sorted(ipaddress.ip_address(a()) for _ in range(2)))) for a in (v4, v6) for _ in range(20)]
    addresses = [v4() for _ in range(150)] + [v6() for _ in range(150)] + ["255.255.255.255", "::1", "::ffff:255.255.3.4", " 255.255.9.9 ", "300.1.1.1", "x", "", None, "1:2", "2001:db8::1"]
    rows = [(i, a, "c") for i, a in enumerate(addresses + addresses[:5])]
    df = spark.createDataFrame(rows, "id long, address string, network string")
    got = {r.id: r.net.network if r.net else None for r in networks.with_network(df, spark.createDataFrame([(n, "o") for n in nets], "network string, owner string"), "address").collect()}
    for i, a, _ in rows:
        sizes = [(holds(n, a), n) for n in nets if n and a and holds(n, a)]
        assert got[i] == (min(sizes)[1] if sizes else None), a
    assert len(got) == len(rows) and len({v for v in got.values()}) > 20


def test_no_networks(spark):
    none = spark.createDataFrame([], "network string")
    got = networks.with_network(spark.createDataFrame([("1.1.1.1",)], "address string"), none, "address").collect()
    assert [(r.address, r.net) for r in got] == [("1.1.1.1", None)]


def test_a_range_is_few_networks(spark):
    wide = spark.createDataFrame([("::1-ffff:ffff:ffff:ffff:ffff:ffff:ffff:fffe",)], "network string")
    assert networks.prefixes(wide).count() == 254
