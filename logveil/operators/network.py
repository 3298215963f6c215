"""Addresses of both families as keys, and the join with networks by the longest prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NIBBLES = [format(k, "04b") for k in range(16)]
V4 = "0" * 20 + "f" * 4  # what stands before an IPv4 address in a key


def _v4(text: Column) -> Column:
    """Eight hexadecimal digits; null where it is no dotted quad."""
    octets = F.split(text, r"\.", -1)
    fits = text.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") & F.forall(octets, lambda o: o.try_cast("int") < 256)
    digits = F.concat(*[F.lpad(F.lower(F.hex(F.get(octets, F.lit(k)).try_cast("int"))), 2, "0") for k in range(4)])
    return F.when(fits, digits)


def key(address: Column) -> Column:
    """32 hexadecimal digits of an IPv4 (as mapped) or IPv6 address, also in brackets and with a zone; null where it is neither."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.trim(address), r"^\[(.*)\]$", "$1"), "%.*$", ""))
    # a dotted quad at the end stands for two groups
    quad = _v4(F.regexp_extract(plain, r"(?:^|:)(\d+\.\d+\.\d+\.\d+)$", 1))
    groups = F.when(quad.isNotNull() & plain.contains(":"), F.concat(F.regexp_replace(plain, r"[^:]*$", ""), F.substring(quad, 1, 4), F.lit(":"), F.substring(quad, 5, 4))).otherwise(plain)
    halves = F.split(groups, "::", -1)

    def four(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(part, ":", -1), lambda g: F.lpad(g, 4, "0")))

    left, right = four(F.get(halves, F.lit(0))), four(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    size, short = F.size(left) + F.size(right), F.size(halves) == 2
    fits = groups.rlike("^[0-9a-f:]+$") & plain.contains(":") & (F.size(halves) <= 2) & F.when(short, size <= 7).otherwise(size == 8)
    whole = F.forall(F.split(F.regexp_replace(groups, "::", ":"), ":", -1), lambda g: F.length(g) <= 4) & ~F.regexp_replace(groups, "::", "").rlike("^:|:$")
    v6 = F.concat(F.array_join(left, ""), F.repeat(F.lit("0"), 4 * (8 - size)), F.array_join(right, ""))
    return F.when(~plain.contains(":"), F.concat(F.lit(V4), _v4(plain))).otherwise(F.when(fits & whole, v6))


def prefix(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits of a key: whole digits, then the rest as bits."""
    full = F.floor(bits / 4).cast("int")
    nibble = F.conv(F.substr(digits, full + 1, F.lit(1)), 16, 10).cast("int")
    rest = F.substr(F.get(F.array(*map(F.lit, _NIBBLES)), nibble), F.lit(1), (bits % 4).cast("int"))
    return F.concat(F.substr(digits, F.lit(1), full), F.lit("/"), F.when(bits % 4 == 0, "").otherwise(rest))


def parsed(cidr: Column) -> Column:
    """``struct<digits, bits>`` of ``address/length``, a bare address is its own network; null where it is none. ``bits`` counts from the front of the key."""
    address, length = F.substring_index(F.trim(cidr), "/", 1), F.regexp_extract(F.trim(cidr), r"/(\d{1,3})$", 1)
    v4 = ~address.contains(":")
    digits, most = key(address), F.when(v4, 32).otherwise(128)
    given = F.when(~cidr.contains("/"), most).otherwise(length.try_cast("int"))
    bits = given + F.when(v4, 96).otherwise(0)
    return F.when(digits.isNotNull() & given.between(0, most), F.struct(digits.alias("digits"), bits.cast("int").alias("bits")))


def longest_prefix(rows: DataFrame, networks: DataFrame, address_col: str = "address", network_col: str = "network") -> DataFrame:
    """``rows`` with the columns of the narrowest of ``networks`` that its address is in, null where none is.

    An equi-join: the lengths that the networks have are at most 129, so each
    distinct address becomes a row for each of these with so many of its bits,
    and joins the networks that have just these. Of equal networks the least
    name stays. Addresses that are none, and networks that are none, join
    nothing; columns of ``networks`` must not be in ``rows``.
    """
    nets = networks.select("*", parsed(F.col(network_col)).alias("p")).where("p is not null")
    first = F.struct(*[F.col(c) for c in [network_col, *[c for c in networks.columns if c != network_col]]])
    nets = nets.groupBy(F.col("p.bits").alias("bits"), prefix(F.col("p.digits"), F.col("p.bits")).alias("bits_of")).agg(F.min(first).alias("net"))
    lengths = [r[0] for r in nets.select("bits").distinct().collect()]  # at most 129
    if not lengths:
        return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in networks.schema])
    each = rows.select(F.col(address_col).alias("address")).distinct().select("address", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)])).alias("bits"), key(F.col("address")).alias("digits"))
    met = each.where("digits is not null").select("address", "bits", prefix(F.col("digits"), F.col("bits")).alias("bits_of")).join(nets, ["bits", "bits_of"])
    best = met.groupBy("address").agg(F.max_by("net", "bits").alias("net")).select(F.col("address").alias("the address"), "net")
    return rows.join(best, rows[address_col] == F.col("the address"), "left").select(*[rows[c] for c in rows.columns], *[F.col(f"net.{c}").alias(c) for c in networks.columns])
