"""Column functions on IPv4 addresses. Ids are BIGINT with the first octet in the high byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
BYTE_ORDERS = {"big": True, "big-endian": True, "BE": True, "little": False, "little-endian": False, "LE": False}
#: Cosmetic mask that dashboards put over ids.
DISPLAY_MASK = 0xAAAAAAAA


def ip_to_int(ip: Column, order: str = "big", strict: bool = False) -> Column:
    """Dotted text to id; ``little`` puts the first octet in the low byte.

    Anything but four octets of 0 to 255 without leading zeros gives null, or
    an error if ``strict``.
    """
    octets = [F.regexp_extract(ip, DOTTED, i).cast("long") for i in range(1, 5)]
    if not BYTE_ORDERS[order]:
        octets.reverse()
    value = sum((o * 256 ** (3 - i) for i, o in enumerate(octets)), F.lit(0).cast("long"))
    bad = F.raise_error(F.concat(F.lit("not an IPv4 address: "), ip)).cast("long") if strict else F.lit(None).cast("long")
    return F.when(ip.rlike(DOTTED), value).otherwise(F.when(ip.isNotNull(), bad))


def lenient_ip_to_int(ip: Column) -> Column:
    """An id from any form that C libraries take: one to four parts, decimal, octal or hexadecimal, the last filling the rest."""
    parts = F.split(ip, r"\.")
    read = F.transform(
        parts,
        lambda p: F.when(p.rlike("^0[xX][0-9a-fA-F]{1,8}$"), F.conv(F.substring(p, 3, 8), 16, 10))
        .when(p.rlike("^0[0-7]{0,11}$"), F.conv(p, 8, 10))
        .when(p.rlike("^[1-9][0-9]{0,9}$"), p)
        .cast("long"),
    )
    n = F.size(parts)
    out = F.lit(None).cast("long")
    for k in range(1, 5):
        heads = [F.get(read, i) for i in range(k - 1)]
        tail, room = F.get(read, k - 1), 256 ** (5 - k)
        good = (tail < room) & F.forall(F.slice(read, 1, k - 1), lambda p: p < 256) if k > 1 else tail < room
        value = sum((h * 256 ** (3 - i) for i, h in enumerate(heads)), tail)
        out = F.when((n == k) & good, value).otherwise(out)
    return out


def octets(ip: Column) -> list[Column]:
    """The four octets of an id, high byte first."""
    return [F.shiftright(ip, s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0)]


def int_to_ip(ip: Column, order: str = "big") -> Column:
    parts = octets(ip)
    return F.concat_ws(".", *(parts if BYTE_ORDERS[order] else reversed(parts)))


def byteswap32(ip: Column) -> Column:
    """The id with its four bytes in the opposite order."""
    a, b, c, d = octets(ip)
    return d * 16777216 + c * 65536 + b * 256 + a


def pad_ip(text: Column) -> Column:
    """Each octet with three digits, so that text order is numeric order."""
    return F.array_join(F.transform(F.split(text, r"\."), lambda o: F.lpad(o, 3, "0")), ".")


def unpad_ip(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\."), lambda o: o.cast("int").cast("string")), ".")


def xor_mask(ip: Column, mask: int = DISPLAY_MASK) -> Column:
    return ip.bitwiseXOR(F.lit(mask).cast("long"))


def bounds(line: Column) -> tuple[Column, Column]:
    """First and last id of ``a.b.c.d/n`` or ``first:last``; null where malformed or reversed."""
    ip = ip_to_int(F.split(line, "/")[0])
    bits = F.regexp_extract(line, r"^[0-9.]+/(3[0-2]|[12]?[0-9])$", 1)
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - F.when(bits != "", bits).cast("int"))
    cidr = line.contains("/")
    ends = F.split(line, ":")
    first, last = ip_to_int(F.get(ends, 0)), ip_to_int(F.get(ends, 1))
    lo = F.when(cidr, ip - F.pmod(ip, size)).otherwise(first)
    hi = F.when(cidr, ip - F.pmod(ip, size) + size - 1).otherwise(last)
    good = lo.isNotNull() & hi.isNotNull() & (lo <= hi)
    return F.when(good, lo), F.when(good, hi)
