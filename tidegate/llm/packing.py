"""Hierarchical multi-length packing of token sequences.

Documents are routed to context-size tiers by their length, each tier is packed, gaps of long windows are filled from
shorter tiers (pieces are cut where nothing fits), and the sequences of a tier are dealt into step groups of like cost.
Packing is local to a partition: no shuffle, no global state; what remains at a partition's end, less than one window,
becomes sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.shared import bounded_batches
from tidegate.llm.tokens import tokenizer_at
from tidegate.llm.words import returned, slices

TIERS = (256, 512, 1024, 2048)
STEP = 8
#: Tokens that wait in a task until they are packed together.
HELD = 1 << 20

Piece = tuple[int, int, int]

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"


class _Pool:
    """Pieces ordered by length."""

    def __init__(self):
        self.pieces: list[Piece] = []

    def add(self, piece: Piece) -> None:
        insort(self.pieces, piece)

    def best(self, gap: int) -> Piece | None:
        """Removes and returns the longest piece that fits."""
        i = bisect_right(self.pieces, (gap, 1 << 62, 0))
        return self.pieces.pop(i - 1) if i else None


def _tier(length: int, tiers: tuple[int, ...]) -> int:
    return next(t for t in tiers if t >= length)


def pack(pieces: list[Piece], tiers: tuple[int, ...], last: bool) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full sequences (length, [(row, start, length)]) of pieces (length, row, start), and the pieces left over.

    With ``last`` nothing is left over: the rest is dealt into sequences whose lengths are powers of two.
    """
    top, done, pool = tiers[-1], [], _Pool()
    rest = []
    for n, row, start in pieces:
        while n >= top:
            done.append((top, [(row, start, top)]))
            n, start = n - top, start + top
        if n:
            rest.append((n, row, start))
    pool.pieces = sorted(rest)
    left: list[Piece] = []
    while pool.pieces:
        head = pool.pieces.pop()  # the longest
        tier = _tier(head[0], tiers)
        own, gap = [head], tier - head[0]
        while gap and pool.pieces:
            if piece := pool.best(gap):
                own.append(piece)
                gap -= piece[0]
            else:
                n, row, start = pool.pieces.pop(0)  # the shortest that is too long
                own.append((gap, row, start))
                pool.add((n - gap, row, start + gap))
                gap = 0
        if gap:
            left = own
        else:
            done.append((tier, [(row, start, n) for n, row, start in own]))
    if last and left:
        size, own, room = sum(p[0] for p in left), [], 0
        for n, row, start in left:
            while n:
                if not room:
                    room = 1 << (size.bit_length() - 1)
                    own = []
                    done.append((room, own))
                    size -= room
                take = min(n, room)
                own.append((row, start, take))
                n, start, room = n - take, start + take, room - take
        left = []
    return done, left


class _Packer:
    """One partition's packing: documents come in, rows of SCHEMA go out."""

    def __init__(self, tiers: tuple[int, ...], step: int, base: int):
        self.tiers, self.step, self.next_sequence, self.next_group = tiers, step, base, base
        self.docs: list[tuple[object, np.ndarray]] = []  # (doc_id, ids)
        self.todo: list[Piece] = []
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.todo.append((len(ids), len(self.docs), 0))
        self.docs.append((doc_id, ids))
        self.held += len(ids)

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        done, left = pack(self.todo, self.tiers, last)
        by_tier: dict[int, list[list[Piece]]] = {}
        for tier, own in done:
            by_tier.setdefault(tier, []).append(own)
        out: list[tuple] = []
        for tier in sorted(by_tier):
            # attention's cost grows with the square of a piece; dealing back and forth evens the groups out
            dealt = sorted(by_tier[tier], key=lambda own: -sum(n * n for _, _, n in own))
            groups = -(-len(dealt) // self.step)
            for i, own in enumerate(dealt):
                turn, place = divmod(i, groups)
                group = self.next_group + (place if turn % 2 == 0 else groups - 1 - place)
                offset = 0
                for row, start, n in own:
                    doc_id, ids = self.docs[row]
                    out.append((doc_id, start, n, len(ids), self.next_sequence, offset, tier, group, ids[start : start + n].astype("<u4").tobytes()))
                    offset += n
                self.next_sequence += 1
            self.next_group += groups
        kept = {row: i for i, row in enumerate(dict.fromkeys(row for _, row, _ in left))}
        self.docs = [self.docs[row] for row in kept]
        self.todo = [(n, kept[row], start) for n, row, start in left]
        self.held = sum(n for n, _, _ in left)
        for i in range(0, len(out), 4096):
            columns = list(zip(*out[i : i + 4096], strict=True))
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])


@returned
def _packed(batches: Iterator[pa.RecordBatch], path: str, end_id: int, tiers: tuple[int, ...], step: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    packer = _Packer(tiers, step, (context.partitionId() if context else 0) << 32)
    tokenizer = tokenizer_at(path)
    for batch in batches:
        for part in slices(batch, "text"):
            ids, first = tokenizer.encode(part.column(1))
            for i, doc_id in enumerate(part.column(0).to_pylist()):
                packer.add(doc_id, np.append(ids[first[i] : first[i + 1]], np.int32(end_id)))
            if packer.held >= HELD:
                yield from packer.flush(last=False)
    yield from packer.flush(last=True)


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of ``docs`` in sequences: SCHEMA, ``ids`` being little-endian unsigned 32-bit token ids.

    Every document, a null text being empty, ends with ``end_id``, so an empty one has one token. A sequence has exactly
    its tier's length, except for a few at the end of a partition, whose lengths are smaller powers of two; nothing is
    padded. Rows are packed one by one: repeated rows and repeated or null ids give pieces of their own. Other columns
    are ignored. sequence_id and step_group are unique over all partitions; an empty table has no sequences.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be rising powers of two")
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        partial(_packed, path=tokenizer_path, end_id=end_id, tiers=tuple(tiers), step=step), SCHEMA
    )


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )
