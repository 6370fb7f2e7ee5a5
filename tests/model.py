"""A small sequential model of the engine's rules, written from their tables, for comparison with both paths."""

from __future__ import annotations

import random


class Model:
    def __init__(self, lease, ttl):
        self.lease, self.ttl, self.keys = lease, ttl, {}

    def begin(self, key, fp, now):
        s = self.keys.get(key)
        if s and s["done"] is not None and now < s["done"] + self.ttl:
            return ("replay", s["outcome"]) if s["fp"] == fp else ("mismatch", s["outcome"])
        if s and s["done"] is None:
            if s["fp"] != fp:
                return "mismatch", None
            if now < s["lease"]:
                return "in_progress", None
        fence = s["fence"] + 1 if s else 1
        self.keys[key] = {"fp": fp, "fence": fence, "lease": now + self.lease, "done": None, "outcome": None}
        return "run", None

    def complete(self, key, fence, outcome, now):
        s = self.keys.get(key)
        if s is None:
            return "unknown"
        if s["done"] is not None:
            return "already_completed"
        if s["fence"] != fence:
            return "stale_fence"
        s["done"], s["outcome"] = now, outcome
        return "ok"


def operations(seed, n, keys=8, lease=1000):
    """Seeded begins, completions and jumps of the clock: (seq, key, op, fp, now_ms, fence, status)."""
    rnd, now, out, tokens = random.Random(seed), 1000, [], {}
    for seq in range(n):
        key = f"k{rnd.randrange(keys)}"
        p = rnd.random()
        now += rnd.choice([0, 1, lease // 3, lease, 6 * lease]) if p > 0.8 else 1
        if rnd.random() < 0.6:
            out.append((seq, key, "begin", f"f{rnd.randrange(2)}", now, None, None))
            tokens[key] = tokens.get(key, 0) + 1
        else:
            out.append((seq, key, "complete", None, now, rnd.randint(1, 1 + tokens.get(key, 0) // 2), 201))
    return out
