"""Tokens between services: an HMAC over purpose, node and time, good for a while around it. Driver-side."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

SKEW_SECONDS = 30


@dataclass(frozen=True)
class Token:
    purpose: int
    node: int
    at: int
    tag: bytes


def _tag(key: bytes, purpose: int, node: int, at: int) -> bytes:
    return hmac.new(key, bytes([purpose]) + node.to_bytes(8, "little") + at.to_bytes(8, "little"), hashlib.sha256).digest()


def mint(key: bytes, purpose: int, node: int, at: int) -> Token:
    return Token(purpose, node, at, _tag(key, purpose, node, at))


def verify(key: bytes, token: Token, purpose: int, now: int) -> bool:
    fresh = abs(now - token.at) <= SKEW_SECONDS
    return token.purpose == purpose and fresh and hmac.compare_digest(token.tag, _tag(key, purpose, token.node, token.at))
