"""Capture filters: the usual primitives for hosts, nets, ports and protocols, as predicates on packets.

``[tcp|udp|icmp|ip|ip6|vlan] [src|dst|src or dst|src and dst] [host|net|port|portrange] value``,
``proto N``, ``less N`` and ``greater N``, joined by ``and``, ``or``, ``not``
(``&&``, ``||``, ``!``) and parentheses; ``and`` and ``or`` bind alike, from left
to right, and a value alone takes over what was asked before it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(\(|\)|&&|\|\||!|[^\s()!&|]+)")
_ADDRESS = re.compile(r"(\d+)\.(\d+)\.(\d+)\.(\d+)(?:/(\d+))?")
_SAME = {"&&": "and", "||": "or", "!": "not"}
# Protocol numbers and ethertypes.
_PROTOCOLS = {"icmp": 1, "tcp": 6, "udp": 17, "sctp": 132}
_KINDS = {"ip": 0x0800, "ip6": 0x86DD, "arp": 0x0806}
_TYPES = ("host", "net", "port", "portrange")


def _bounds(text: str, net: bool) -> tuple[int, int]:
    """First and last address of ``a.b.c.d`` or, for a net, ``a.b.c.d/n``."""
    m = _ADDRESS.fullmatch(text)
    if not m or any(int(o) > 255 for o in m.groups()[:4]) or int(m[5] or 32) > 32 or m[5] and not net:
        raise ValueError(f"not an address: {text}")
    ip = sum(int(o) << s for o, s in zip(m.groups()[:4], (24, 16, 8, 0), strict=True))
    size = 1 << 32 - int(m[5] or 32)
    return ip - ip % size, ip - ip % size + size - 1


def _number(text: str, most: int = 65_535) -> int:
    if not text.isdigit() or int(text) > most:
        raise ValueError(f"not a number up to {most}: {text}")
    return int(text)


class _Reader:
    def __init__(self, text: str):
        if _TOKEN.sub("", text).strip():
            raise ValueError(f"odd characters in the filter: {text}")
        self.tokens = [_SAME.get(t, t) for t in _TOKEN.findall(text)]
        self.at = 0
        self.before: tuple[str | None, str | None, str] = (None, None, "host")

    def peek(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else None

    def take(self) -> str:
        if (t := self.peek()) is None:
            raise ValueError("the filter ends too soon")
        self.at += 1
        return t

    def all(self) -> Column:
        out = self.term()
        while self.peek() in ("and", "or"):
            out = out & self.term() if self.take() == "and" else out | self.term()
        return out

    def term(self) -> Column:
        t = self.peek()
        if t == "not":
            self.take()
            return ~F.coalesce(self.term(), F.lit(False))
        if t == "(":
            self.take()
            out = self.all()
            if self.take() != ")":
                raise ValueError("a parenthesis is left open")
            return out
        return self.primitive()

    def primitive(self) -> Column:
        t = self.peek()
        if t in ("less", "greater"):
            self.take()
            n = _number(self.take(), 1 << 32)
            return F.col("length") <= n if t == "less" else F.col("length") >= n
        kind = self.take() if t in _PROTOCOLS or t in _KINDS or t == "vlan" else None
        own = None if kind is None else F.col("vlan") if kind == "vlan" else F.col("protocol") == _PROTOCOLS[kind] if kind in _PROTOCOLS else F.col("ethertype") == _KINDS[kind]
        if self.peek() == "proto":
            self.take()
            name = self.take().lstrip("\\")
            asked = F.col("protocol") == (_PROTOCOLS[name] if name in _PROTOCOLS else _number(name, 255))
            return asked if own is None else own & asked
        side = None
        if self.peek() in ("src", "dst"):
            side = self.take()
            if self.peek() in ("and", "or") and self.peek(1) in ("src", "dst") and self.peek(1) != side:
                side = self.take()
                self.take()
        what = self.take() if self.peek() in _TYPES else None
        t = self.peek()
        if side is None and what is None and (t is None or t in ("and", "or", ")")) and own is not None:
            return own
        if side is None and what is None and kind is None:
            kind, side, what = self.before  # a value alone
            own = F.col("protocol") == _PROTOCOLS[kind] if kind in _PROTOCOLS else F.col("ethertype") == _KINDS[kind] if kind in _KINDS else None
        what = what or "host"
        self.before = (kind, side, what)
        found = self.value(side, what, self.take())
        return found if own is None else own & found

    def value(self, side: str | None, what: str, text: str) -> Column:
        if what in ("host", "net"):
            lo, hi = _bounds(text, what == "net")
            names = ("src", "dst")
        else:
            ends = text.split("-") if what == "portrange" else [text, text]
            if len(ends) != 2:
                raise ValueError(f"not a range of ports: {text}")
            lo, hi = map(_number, ends)
            names = ("src_port", "dst_port")
        test = lambda c: F.col(c) == lo if lo == hi else (F.col(c) >= lo) & (F.col(c) <= hi)
        if side in ("src", "dst"):
            return test(names[side == "dst"])
        return test(names[0]) & test(names[1]) if side == "and" else test(names[0]) | test(names[1])


def capture_filter(text: str) -> Column:
    """The predicate on ``PACKETS`` that a filter asks for; an empty filter takes all, a bad one is an error."""
    reader = _Reader(text)
    if not reader.tokens:
        return F.lit(True)
    out = reader.all()
    if reader.peek() is not None:
        raise ValueError(f"can't read the filter from {reader.peek()!r} on")
    return out
