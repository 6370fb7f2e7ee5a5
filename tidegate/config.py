"""Settings of the engine from the environment, with defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from tidegate.functions.crypto import secret
from tidegate.schema import Leases, Rule


@dataclass(frozen=True)
class Config:
    """What a gate needs to know: the key of its fingerprints, leases, rules, and how many shards its log has."""

    secret: bytes
    leases: Leases = field(default_factory=Leases)
    rules: tuple[Rule, ...] = ()
    shards: int = 32

    @classmethod
    def from_env(cls, prefix: str = "TIDEGATE_", env: Mapping[str, str] | None = None, fallback: str = "not a secret") -> Config:
        """Reads KEY (64 hex digits), LEASE_MS, TTL_MS, SHARDS and RULES behind ``prefix``. A rule is
        name:window_ms:limit:action, and rules are parted by commas. What is malformed raises ValueError."""
        env = os.environ if env is None else env

        def number(name: str, default: int) -> int:
            text = env.get(prefix + name)
            if text is None:
                return default
            if not text.isdecimal() or int(text) < 1:
                raise ValueError(f"{prefix}{name} must be a whole number of 1 or more")
            return int(text)

        rules = []
        for text in filter(None, env.get(prefix + "RULES", "").split(",")):
            parts = text.split(":")
            if len(parts) != 4 or not (parts[1].isdecimal() and parts[2].isdecimal()):
                raise ValueError(f"{prefix}RULES: {text!r} is not name:window_ms:limit:action")
            rules.append(Rule(parts[0], int(parts[1]), int(parts[2]), parts[3]))
        leases = Leases(number("LEASE_MS", Leases.lease_ms), number("TTL_MS", Leases.ttl_ms))
        return cls(secret(prefix + "KEY", fallback, env), leases, tuple(rules), number("SHARDS", cls.shards))
