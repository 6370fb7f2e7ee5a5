"""Proof-of-work challenges bound to an identity, a request and a time window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.crypto import hmac_sha256, le64, leading_zero_bits, sha256
from tidegate.stash import Stash

#: Bits added for each unit of overage, and at most.
STEP, MOST = 4, 20
#: Nonces that are laid out at once.
CHUNK = 4096


def window_index(now_ms: Column, window_ms: int) -> Column:
    return ((now_ms - F.pmod(now_ms, F.lit(window_ms))) / F.lit(window_ms)).cast("long")


def challenge(secret: bytes, identity: Column, request_hash: Column, window: Column) -> Column:
    """32 bytes for a window index."""
    return hmac_sha256(secret, F.concat(identity.cast("binary"), le64(window), request_hash.cast("binary")))


def solves(value: Column, nonce: Column, difficulty: Column) -> Column:
    return leading_zero_bits(sha256(F.concat(value, le64(nonce)))) >= difficulty


def verify(secret: bytes, identity: Column, request_hash: Column, difficulty: Column, nonce: Column, window_ms: int, now_ms: Column) -> Column:
    """Whether the nonce solves the challenge of the present window or of the one before."""
    window = window_index(now_ms, window_ms)
    return solves(challenge(secret, identity, request_hash, window), nonce, difficulty) | solves(
        challenge(secret, identity, request_hash, F.greatest(window - 1, F.lit(0))), nonce, difficulty
    )


def difficulty_for(base: Column, overage: Column) -> Column:
    """More bits the further an actor is over its limit; a byte at most."""
    more = F.least(F.lit(MOST), F.floor(STEP * F.greatest(overage, F.lit(0.0))).cast("long"))
    return F.least(F.lit(255), base + more).cast("int")


def smallest_nonce(tasks: DataFrame, keys: list[str], value: str, difficulty: Column, tries: int) -> DataFrame:
    """``keys`` with the least nonce that solves each row's ``value``, for all rows that have a value and a difficulty.

    The first round tries the nonces under ``tries``, each next round as many again as all before, for those still
    unsolved, until none is left. A difficulty over 256 bits has no solution and raises ValueError.
    """
    stash = Stash(tasks.sparkSession)
    left = stash.keep(tasks.withColumn("__bits", difficulty).where(F.col(value).isNotNull() & F.col("__bits").isNotNull()), "tasks")
    count, most = left.agg(F.count(F.lit(1)), F.max("__bits")).first()
    if count and most > 256:
        raise ValueError(f"no nonce solves {most} bits of SHA-256")
    found, start, end = [], 0, tries
    while True:
        nonces = left.withColumn("__from", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end - 1).cast("long"), F.lit(CHUNK).cast("long"))))
        nonces = nonces.repartition(tasks.sparkSession.sparkContext.defaultParallelism).withColumn("nonce", F.explode(F.sequence("__from", F.least(F.col("__from") + CHUNK, F.lit(end).cast("long")) - 1)))
        solved = stash.keep(nonces.where(solves(F.col(value), F.col("nonce"), F.col("__bits"))).groupBy(*keys).agg(F.min("nonce").alias("nonce")), "solved")
        found.append(solved)
        same = reduce(lambda x, y: x & y, [left[k].eqNullSafe(solved[k]) for k in keys])
        rest = stash.keep(left.join(solved, same, "left_anti"), "unsolved")
        stash.drop(left)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        left, start, end = rest, end, 2 * end
