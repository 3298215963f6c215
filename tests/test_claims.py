import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from logveil.operators import claims, kernel, network
from logveil.operators.kernel import MaskConfig
from logveil.plans import rendered
from logveil.rules import values as V


@pytest.mark.parametrize("regex", [*(r[4] for r in V.RULES), *V.KEEP_PATTERNS])
def test_patterns_taken_apart_find_the_same(regex):
    apart, group = claims.taken_apart(regex)
    text = "\n".join(line.replace("{u}", "jdoe7").replace("{h}", "SRV-9").replace("{ip}", "10.1.2.3").replace("{n}", "17").replace("{x}", "0a" * 16) for line in rendered.LINES.values())
    want = [m.span(m.lastindex or 0) for m in re.finditer(regex, text)]
    got = [(m.start() + len(m[1]), m.start() + len(m[1]) + len(m[group])) for m in re.finditer(apart, text)]
    assert got == want


def plain_spans(text, config=MaskConfig(), rules=None):
    """Claims over patterns one after the other, character by character."""
    taken, out = set(), []
    for s in claims.steps(config, rules):
        for m in re.finditer(s.regex, text):
            a, b = m.span(m.lastindex or 0)
            if (s.label is None or kernel.accepted(s.label, text[a:b])) and taken.isdisjoint(range(a, b)):
                taken.update(range(a, b))
                if s.label is not None:
                    out.append((a, b, text[a:b], s.label, s.tier, s.rule_id))
    return sorted(out)


TEXTS = [
    None, "", "nothing here", "user=jdoe at 10.2.3.4 and 10.2.3.5, mail j@corp.io, SHA256=" + "ab" * 32 + " x " + "cd" * 16,
    "card 4111 1111 1111 1111 and token: abcd1234 😀 é user=ann host=ws-01.corp.lan", "C:\\Users\\pkim\\x CORP\\svc_sql fe80::1:2 127.0.0.1", "cs1Label=Policy cs1=pol7 end zeta ZETA boss@corp.io " * 3,
]


@pytest.mark.parametrize("config", [MaskConfig(), MaskConfig(enabled=("network",), custom_terms=("zeta", "zet"), custom_patterns=({"label": "code x", "regex": r"ws-(\d+)"},), keep_terms=("boss@corp.io",))])
def test_spans_are_those_of_plain_claims(spark, config):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("row", F.lit("clash"))
    got = [(r.doc_id, r.start, r.end, r.value, r.label, r.tier, r.rule_id) for r in claims.spans(frame, config).collect()]
    assert sorted(got) == sorted((k, *s) for k, t in enumerate(TEXTS) for s in plain_spans(t or "", config))


def test_masked_lines_are_the_kernels(spark, small):
    lines = rendered.lines(spark, small).where("event_id < 300").select("event_id", "line")
    got = {r.event_id: r.masked for r in claims.mask(lines, id_col="event_id", text_col="line").collect()}
    assert got == {r.event_id: kernel.mask(r.line)[0] for r in lines.collect()}


def test_lines_of_large_numbers(spark):
    """Numbers of five digits and more: some lines are no longer values of their rule, whatever the shape was made for."""
    lines = [line.replace("{n}", n).replace("{u}", f"user{n}").replace("{h}", "SRV-9").replace("{ip}", "10.1.2.3").replace("{x}", "0a" * 16) for n in ("12130", "43812", "871116439") for line in rendered.LINES.values()]
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, line string")
    assert {r.doc_id: r.masked for r in claims.mask(frame, text_col="line").collect()} == {k: kernel.mask(t)[0] for k, t in enumerate(lines)}
    with pytest.raises(ValueError):
        ipaddress.ip_address("fe80::1:12130")  # five digits in a group
    assert kernel.mask("addr fe80::1:12130 up")[0] == "addr fe80::1:12130 up" and kernel.mask("addr fe80::1:2130 up")[0] == "addr [IPV6_1] up"
    # thirteen digits whose last one checks are a card, and cards come before telephones
    assert kernel.mask("call +49 30 124381256 now")[0] == "call +[CC_1]now" and kernel.mask("call +49 30 124381356 now")[0] == "call [PHONE_1] now"


def test_claims_of_touching_intervals(spark):
    rng = random.Random(7)
    rows = [(k % 5, rng.randrange(4), a, a + rng.randrange(1, 12), "v") for k in range(400) for a in [rng.randrange(300)]]
    rows = list({r[:3]: r for r in rows}.values())
    want = []
    for row in range(5):
        taken = set()
        for _, rank, a, b, v in sorted(r for r in rows if r[0] == row):
            if taken.isdisjoint(range(a, b)):
                taken.update(range(a, b))
                want.append((row, rank, a, b, v))
    got = claims.claimed(spark.createDataFrame(rows, "row int, rank int, start int, end int, value string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_trial_is_an_except_of_values(spark):
    texts = [(1, "user=jdoe QX1234 a@corp.io"), (2, "QX1234 QX9 10.1.2.3"), (3, "nothing"), (4, None)]
    proposals = [("codes", "CODE", r"\bQX\d+\b"), ("domains", "HOST", r"@([a-z.]+)"), ("known", "IP", r"10\.1\.2\.3"), ("more", "CODE", r"\bQX\d{4}\b|nothing")]
    found = claims.trial(spark.createDataFrame(texts, "doc_id long, text string"), proposals)
    want = set()
    for name, label, regex in proposals:
        config = MaskConfig(custom_patterns=({"label": label, "regex": regex},))
        want |= {(name, k, s[2]) for k, t in texts for s in plain_spans(t or "", config)} - {(name, k, s[2]) for k, t in texts for s in plain_spans(t or "")}
    assert {tuple(r) for r in found.collect()} == want and {n for n, _, _ in want} == {"codes", "domains", "more"}
    assert [(r.place, r.proposal, r.n_values) for r in claims.side_effects(found).orderBy("place").collect()] == [(1, "domains", 1), (2, "codes", 2), (3, "more", 2)]


ADDRESSES = ["10.1.2.3", "10.1.2.256", "1.2.3", "::", "::1", "fe80::1%eth0", "[2001:db8::ff00:42:8329]", "2001:0db8:0000:0000:0000:ff00:0042:8329", "::ffff:10.1.2.3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", "12345::", ":1", "1:", "g::", "", None, "64:ff9b::192.0.2.33", "1:2:3:4:5:6:7", "2001:DB8::A"]


def as_key(text):
    try:
        ip = ipaddress.ip_address((text or "").strip("[]").split("%")[0])
    except ValueError:
        return None
    return network.V4 + format(int(ip), "08x") if ip.version == 4 else format(int(ip), "032x")


def test_keys_of_addresses(spark):
    got = {r.a: r.k for r in spark.createDataFrame([(a,) for a in ADDRESSES], "a string").select("a", network.key(F.col("a")).alias("k")).collect()}
    assert got == {a: as_key(a) for a in ADDRESSES}


def test_longest_prefix(spark):
    rng = random.Random(2)
    nets = [f"{ipaddress.ip_network((rng.getrandbits(32), n), strict=False)}" for n in (1, 2, 5, 7, 8, 12, 17, 23) for _ in range(6)] + [f"{ipaddress.ip_network((rng.getrandbits(128), n), strict=False)}" for n in (3, 7, 9) for _ in range(8)]
    nets += ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.3", "10.1.2.3/33", "x/8", "fe80::/10", "::/0"]
    texts = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(150)] + [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(100)] + ADDRESSES + ["10.1.2.4", "10.1.2.3"]
    known = []
    for n in nets:
        try:
            known.append(ipaddress.ip_network(n))
        except ValueError:
            pass

    def narrowest(text):
        k = as_key(text)
        if k is None:
            return None
        ip = ipaddress.ip_address(text.strip("[]").split("%")[0])
        ip = getattr(ip, "ipv4_mapped", None) or ip
        in_ = [(n.prefixlen, str(n)) for n in known if n.version == ip.version and ip in n]
        if ip.version == 4 and not in_:
            return "::/0"  # the widest of all holds mapped addresses too
        return nets[[str(ipaddress.ip_network(x)) if x in map(str, known) or x == "10.1.2.3" else x for x in nets].index(max(in_)[1])]

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, address string")
    networks = spark.createDataFrame([(n, f"owner of {n}") for n in nets], "network string, owner string")
    got = {r.k: (r.network, r.owner) for r in network.longest_prefix(rows, networks).collect()}
    want = {k: narrowest(t) for k, t in enumerate(texts)}
    assert got == {k: (n, n and f"owner of {n}") for k, n in want.items()}
    assert network.longest_prefix(rows, networks.limit(0)).where("network is not null").count() == 0
