"""Hashed visitor keys: small Arrow helpers around the standard address rules."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _address(text: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def _material(text: str) -> bytes:
    """What is hashed: an IPv4 address whole, IPv6 by its /64, anything else as text."""
    addr = _address(text)
    if addr is None:
        return b"x:" + text.encode("utf-8", "replace")
    plain = getattr(addr, "ipv4_mapped", None) or addr
    return b"4:" + plain.packed if plain.version == 4 else b"6:" + plain.packed[:8]


@F.arrow_udf(T.StringType())
def _canonical(addresses: pa.Array) -> pa.Array:
    found = [_address(a) if a is not None else None for a in addresses.to_pylist()]
    return pa.array([None if a is None else str(a) for a in found], pa.string())


def client_address(forwarded: Column, peer: Column, mode: str = "xff_last") -> Column:
    """The rightmost forwarded entry if it is an address, else the connecting peer."""
    fallback = F.when(F.coalesce(peer, F.lit("")) == "", F.lit("unknown")).otherwise(peer)
    if mode == "peer":
        return fallback
    last = F.trim(F.element_at(F.split(forwarded, ","), -1))
    return F.coalesce(_canonical(last), fallback)


def visitor_key(salt: bytes) -> Callable[[Column], Column]:
    """Full hex HMAC-SHA256 of the address. Equal addresses of a batch are hashed once."""

    @F.arrow_udf(T.StringType())
    def key(addresses: pa.Array) -> pa.Array:
        coded = addresses.dictionary_encode()
        keys = [
            hmac.new(salt, _material(a), hashlib.sha256).hexdigest()
            for a in coded.dictionary.to_pylist()
        ]
        return pa.array(keys, pa.string()).take(coded.indices)

    return key
