"""Row types and closed vocabularies of requests, state records and rules."""

from __future__ import annotations

from dataclasses import dataclass

REQUEST = (
    "seq bigint, now_ms bigint, method string, target string, "
    "headers array<struct<name:string,value:string>>, body binary"
)
OPERATION = "seq bigint, key string, op string, fp string, now_ms bigint, fence bigint, status int"
RECORD = (
    "shard int, seq bigint, key string, tag int, fence bigint, fp binary, lease_expires_at_ms bigint, "
    "completed_at_ms bigint, status int, headers map<string,string>, body binary"
)

IN_PROGRESS, COMPLETED = 0, 1
ACTIONS = ("challenge", "throttle", "block")


@dataclass(frozen=True)
class Rule:
    """At most ``limit`` hits in a sliding window of ``window_ms``, else ``action``."""

    name: str
    window_ms: int
    limit: int
    action: str = "throttle"

    def __post_init__(self):
        if self.window_ms <= 0 or self.action not in ACTIONS:
            raise ValueError(f"bad rule {self}")


@dataclass(frozen=True)
class Leases:
    """How long an operation in progress and a stored outcome hold, in milliseconds."""

    lease_ms: int = 30_000
    ttl_ms: int = 86_400_000
