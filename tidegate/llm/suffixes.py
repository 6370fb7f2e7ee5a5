"""Repeated passages by sparse suffix arrays.

Only suffixes at minimiser positions are retained: where the hash of the next ANCHOR words is the least among some
``passage - ANCHOR + 1`` neighbouring positions. These positions follow from content alone, so that two copies of a
passage of ``passage`` words or more retain the same suffixes, at least one of which leaves ANCHOR words inside it.

Suffixes whose first ANCHOR words occur nowhere else are dropped. Suffixes that are alike over their whole context to
both sides need no comparison. The others are sorted by their following words over all partitions, compared with their
neighbours, and extended to the left and right, as far as the longest match with a neighbour leaves room for a passage;
a stretch of ``passage`` words around an anchor counts if it is found in another document. Stretches that overlap are
joined, so that spans are as long as the matches are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegate.llm.shared import Stash, bounded_batches
from tidegate.llm.words import Words, mix, returned, scan, slices, windows

PASSAGE = 50
ANCHOR = 25
_FLIP = np.uint64(1 << 63)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _slide(h: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every w consecutive values, by doubling."""
    size, out = 1, h
    while size * 2 <= w:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(out) - (w - size)], out[w - size :]) if w > size else out


def _minimisers(words: Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions (in the slice) of retained suffixes, and the hashes of their first k words."""
    n = len(words.hash)
    if n < k + w - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = windows(words.hash, k)
    least = _slide(h, w, np.minimum)
    least = np.where(words.row[: len(least)] == words.row[w + k - 2 :], least, np.uint64(0))
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), w, np.maximum) == h)
    return at, h[at]


@returned
def _anchors(batches: Iterator[pa.RecordBatch], k: int, w: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, at, key, whole): retained suffixes; whole is the hash of the context of w - 1 words to both sides."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = scan(part.column(1), lower=False)
            at, key = _minimisers(words, k, w)
            row = words.row[at]
            lo, hi = words.first[row], words.first[row + 1]
            total = windows(words.hash, k + 2 * (w - 1))
            inside = (at - (w - 1) >= lo) & (at + k + w - 1 <= hi)
            whole = np.zeros(len(at), np.uint64)
            if inside.any():
                whole[inside] = total[at[inside] - (w - 1)]
            # near an end of its text a suffix has less context, and is compared word by word
            whole[~inside] = mix(key[~inside] + np.uint64(1) + (part.column(0).fill_null(0).to_numpy()[row[~inside]].astype(np.uint64) * _LEFT) + at[~inside].astype(np.uint64))
            ids = part.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array((at - lo).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(whole.view(np.int64))], ["doc_id", "at", "key", "whole"])


@returned
def _contexts(batches: Iterator[pa.RecordBatch], k: int, w: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, at, key, after, before): 4 bytes for each of up to w - 1 words behind the anchor and before it, the
    latter from right to left; big-endian, so that bytes sort as words do."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = scan(part.column(1), lower=False)
            short = (words.hash >> np.uint64(32)).astype(">u4")
            keys = windows(words.hash, k)
            ids, out = part.column(0).to_pylist(), []
            for r, places in enumerate(part.column(2).to_pylist()):
                lo, hi = int(words.first[r]), int(words.first[r + 1])
                for at in places:
                    p = lo + at
                    if p + k <= hi:
                        after = short[p + k : min(hi, p + k + w - 1)].tobytes()
                        before = short[max(lo, p - w + 1) : p][::-1].tobytes()
                        out.append((ids[r], at, int(keys[p].view(np.int64)), after, before))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "at", "key", "after", "before"])


def _padded(column: pa.Array, w: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of w - 1 words a row, and how many of them are real."""
    sizes = np.array([len(x) // 4 for x in column.to_pylist()], dtype=np.int64)
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=">u4").astype(np.int64)
    out = np.full((len(sizes), w - 1), -1, dtype=np.int64)
    out[np.arange(w - 1)[None, :] < sizes[:, None]] = flat
    return out, sizes


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows; padding matches nothing."""
    return np.cumprod((a == b) & (a >= 0), axis=1).sum(axis=1)


FOUND = "doc_id long, start int, end int, key long, hi long"


@returned
def _extended(batches: Iterator[pa.RecordBatch], k: int, w: int) -> Iterator[pa.RecordBatch]:
    """Neighbours of the sorted suffixes compared: FOUND, either a stretch that could be repeated, by the hash of its
    words, or a span that surely is.

    The first and last suffix of a partition may match one of another partition; these are extended all the way.
    """
    waiting: tuple | None = None  # the last suffix, whose next neighbour is not known yet
    begun = False
    for batch in batches:
        if not batch.num_rows:
            continue
        after, n_after = _padded(batch.column(3), w)
        before, n_before = _padded(batch.column(4), w)
        ids, at, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if waiting is not None:
            ids, at, key = np.append(waiting[0], ids), np.append(waiting[1], at), np.append(waiting[2], key)
            after, n_after = np.vstack([waiting[3], after]), np.append(waiting[4], n_after)
            before, n_before = np.vstack([waiting[5], before]), np.append(waiting[6], n_before)
        match = np.where(key[1:] == key[:-1], _common(after[1:], after[:-1]), -1)
        reach = np.full(len(key), -1, dtype=np.int64)
        reach[:-1] = match
        reach[1:] = np.maximum(reach[1:], match)
        if waiting is not None:
            reach[0] = max(reach[0], waiting[7])
        elif not begun:
            reach[0] = w - 1
        begun = True
        yield _stretches(ids[:-1], at[:-1], key[:-1], after[:-1], n_after[:-1], before[:-1], n_before[:-1], reach[:-1], k, w)
        waiting = (ids[-1:], at[-1:], key[-1:], after[-1:], n_after[-1:], before[-1:], n_before[-1:], int(reach[-1]))
    if waiting is not None:
        yield _stretches(*waiting[:7], np.array([w - 1]), k, w)


def _stretches(ids, at, key, after, n_after, before, n_before, reach, k: int, w: int) -> pa.RecordBatch:
    """For each suffix and each number a of words to its left with room for the rest to its right: the stretch's hash.

    Suffixes alike in all of their context stand together. If they are of several documents, the first one stands for
    all (``hi`` being the last document), and the others are repeated over all of their context.
    """
    n = len(ids)
    new = np.ones(n, dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (after[1:] != after[:-1]).any(axis=1) | (before[1:] != before[:-1]).any(axis=1)
    head = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    hi = ids[np.append(head[1:], n) - 1][run] if n else ids
    several = ids[head][run] < hi if n else new
    lead = new | ~several
    step = lambda x, salt: np.cumsum(mix(x.astype(np.uint64) + salt * (np.arange(1, w, dtype=np.uint64)[None, :])), axis=1)
    zero = np.zeros((n, 1), np.uint64)
    left, right = np.hstack([zero, step(before, _LEFT)]), np.hstack([zero, step(after, _RIGHT)])
    a = np.arange(w)[None, :]
    reach = np.minimum(reach, n_after)
    i, a = np.nonzero((a <= n_before[:, None]) & (w - 1 - a <= reach[:, None]) & (reach >= 0)[:, None] & lead[:, None])
    hashed = mix(key[i].view(np.uint64) + mix(left[i, a] + np.uint64(1)) + mix(right[i, w - 1 - a] ^ _FLIP) + a.astype(np.uint64))
    j = np.flatnonzero(~lead & (n_before + n_after >= w - 1))
    start = np.concatenate([at[i] - a, at[j] - n_before[j]]).astype(np.int32)
    end = np.concatenate([at[i] - a + k + w - 1, at[j] + k + n_after[j]]).astype(np.int32)
    keys = pa.array(np.concatenate([hashed.view(np.int64), np.zeros(len(j), np.int64)]), mask=np.arange(len(i) + len(j)) >= len(i))
    return pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate([i, j])]), pa.array(start), pa.array(end), keys, pa.array(np.concatenate([hi[i], ids[j]]))], ["doc_id", "start", "end", "key", "hi"])


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, first): the longest spans of words made of stretches of ``passage`` words that
    also occur in another document. ``first`` spans hold what may occur there for the first time, by doc_id and position;
    the others may be cut without loss.

    Words are split at space and \\t..\\r and compared as they are. Rows that share an id are one document, and rows with
    a null id are left out; null, empty and short texts have no spans. Other columns are ignored.
    """
    if not 1 <= anchor < passage:
        raise ValueError("anchor must be shorter than passage")
    k, w = anchor, passage - anchor + 1
    bounded_batches(docs.sparkSession)
    stash = Stash(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    anchors = stash.keep(texts.mapInArrow(partial(_anchors, k=k, w=w), "doc_id long, at int, key long, whole long"), "anchors")
    groups = stash.keep(
        anchors.groupBy("key").agg(
            F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("whole").alias("a"), F.max("whole").alias("b"), F.min(F.struct("doc_id", "at")).alias("origin")
        ).where("lo < hi").select("key", (F.col("a") == F.col("b")).alias("alike"), "origin"),
        "groups",
    )
    own = stash.keep(anchors.join(groups, "key"), "own")
    same = own.where("alike").select(
        "doc_id", (F.col("at") - (w - 1)).alias("start"), (F.col("at") + k + w - 1).alias("end"), (F.struct("doc_id", "at") == F.col("origin")).alias("first")
    )
    places = own.where("not alike").groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("places"))
    suffixes = (
        texts.join(places, "doc_id").select("doc_id", "text", "places")
        .mapInArrow(partial(_contexts, k=k, w=w), "doc_id long, at int, key long, after binary, before binary")
    )
    suffixes = stash.keep(suffixes, "suffixes")
    stash.drop(anchors, groups)
    order = ("key", "after", "before", "doc_id", "at")
    found = stash.keep(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_extended, k=k, w=w), FOUND), "found")
    stash.drop(suffixes)
    stretches = found.where("key is not null")
    shared = stash.keep(
        stretches.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("hi").alias("hi"), F.min(F.struct("doc_id", "start")).alias("origin"))
        .where("lo < hi").select("key", "origin"),
        "shared",
    )
    extended = stretches.join(shared, "key").select("doc_id", "start", "end", (F.struct("doc_id", "start") == F.col("origin")).alias("first"))
    copies = found.where("key is null").select("doc_id", "start", "end", F.lit(False).alias("first"))
    return _joined(same.unionByName(extended).unionByName(copies))


def _joined(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a document become one, apart for first and later occurrences."""
    spans = spans.groupBy("doc_id", "start", "end").agg(F.max("first").alias("first"))
    own = W.partitionBy("doc_id", "first").orderBy("start", "end")
    reached = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    begins = F.when(F.col("start") <= reached, 0).otherwise(1)
    return (
        spans.withColumn("begins", begins).withColumn("island", F.sum("begins").over(own))
        .groupBy("doc_id", "first", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
        .select("doc_id", "start_word", "end_word", "first")
    )
