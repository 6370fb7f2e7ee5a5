"""N-gram Jaccard join: which documents share enough of their word shingles.

The document-by-shingle incidence matrix is multiplied with its transpose in blocks of one shingle each, restricted to
every document's rarest-first prefix: two sets with Jaccard similarity of at least t meet in the first
n - ceil(t * n) + 1 shingles of both, whatever the common order is. Overlap counts accumulated over the prefixes
discard every pair below a bound that follows from both sizes; what is left is decided on the whole sets.

Large groups of copies would make the product quadratic, so that before the product is taken pairs inside known groups
are removed from it: documents with equal sets become one class, and a few rounds connect each class to that
centre of its blocks with which it shares most. Only pairs of classes that are still in different groups are multiplied out, so no link is lost and no
group is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegate.llm.graph import components
from tidegate.llm.shared import Stash, bounded_batches
from tidegate.llm.words import mix, returned, scan, shingles, slices

#: The most frequent shingles, whose counts order them last; a bound on what is broadcast, without influence on results.
FREQUENT = 1 << 20
FREQUENT_FROM = 8
#: Bytes of text to each bucket in which shingles are counted.
BUCKET_BYTES = 1 << 23
BROADCAST_IDS = 1_000_000
#: Shingles that are counted together before a task hands out what repeats.
HELD = 1 << 20
_FLIP = np.uint64(1 << 63)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each slice with the distinct shingles of its rows: hashes sorted within rows, and where each row's begin."""
    for batch in batches:
        for part in slices(batch, "text"):
            h, row = shingles(scan(part.column(1), lower=True), k, short=True)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[new], row[new]
            yield part, h, np.searchsorted(row, np.arange(part.num_rows + 1), side="left")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and where each one's run begins."""
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[at], at


@returned
def _hashes(batches: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """All shingles of HELD at a time, each once with its count, dealt by the first ``bits`` of their hashes: per bucket the
    next 32 bits of those found once, those of the others, and the counts of these. What is cut off could at worst make two
    shingles share a count, which only their order follows."""

    def dealt() -> pa.RecordBatch:
        found, at = _runs(np.sort(np.concatenate(held) >> np.uint64(32 - bits)))
        count = np.diff(np.append(at, n))
        bucket = (found >> np.uint64(32)).astype(np.int64)
        key = (found & np.uint64(0xFFFFFFFF)).astype("<u4")
        buckets, first = _runs(bucket)
        columns: list[list[bytes]] = [[], [], []]
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
            one = count[lo:hi] == 1
            for out, x in zip(columns, (key[lo:hi][one], key[lo:hi][~one], count[lo:hi][~one].astype("<i8")), strict=True):
                out.append(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(buckets), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "ones", "more", "counts"])

    held: list[np.ndarray] = []
    n = 0
    for _, h, _ in _sets(batches, k):
        held.append(h)
        n += len(h)
        if n >= HELD:
            yield dealt()
            held, n = [], 0
    if n:
        yield dealt()


@returned
def _counts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(key, c) of the shingles with counts of ``least`` and more, from rows that stand together by bucket."""

    def summed() -> pa.RecordBatch:
        ones = np.frombuffer(b"".join(own[0]), "<u4")
        key = np.concatenate([ones, np.frombuffer(b"".join(own[1]), "<u4")])
        count = np.concatenate([np.ones(len(ones), np.int64), np.frombuffer(b"".join(own[2]), "<i8")])
        order = np.argsort(key, kind="stable")
        keys, at = _runs(key[order])
        total = np.add.reduceat(count[order], at)
        many = total >= least
        return pa.RecordBatch.from_arrays([pa.array((bucket << 32) | keys[many].astype(np.int64)), pa.array(total[many])], ["key", "c"])

    bucket, own = None, ([], [], [])
    for batch in batches:
        for b, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket is not None and b != bucket:
                yield summed()
                own = ([], [], [])
            bucket = b
            for to, x in zip(own, parts, strict=True):
                to.append(x)
    if bucket is not None:
        yield summed()


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


@returned
def _described(batches: Iterator[pa.RecordBatch], k: int, percent: int, bits: int, hot: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per row: set size, set fingerprint, and its prefix: infrequent shingles first by hash, then frequent ones by count."""
    for part, h, first in _sets(batches, k):
        size = np.diff(first)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h))])
        other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _FLIP))])
        level = np.zeros(len(h), dtype=np.int64)
        if len(hot):
            key = (h >> np.uint64(32 - bits)).view(np.int64)
            at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            level = np.where(hot[at] == key, rank[at].astype(np.int64), 0)
        length = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
        cold, warm = [], []
        for r in range(len(size)):
            own, lev = h[first[r] : first[r + 1]], level[first[r] : first[r + 1]]
            usual = own[lev == 0] if lev.any() else own
            if len(usual) >= length[r]:
                cold.append(usual[: length[r]])
                warm.append(own[:0])
            else:
                late = lev > 0
                cold.append(usual)
                warm.append(own[late][np.argsort(lev[late], kind="stable")][: length[r] - len(usual)])
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(size.astype(np.int64)),
                pa.array((total[first[1:]] - total[first[:-1]]).view(np.int64)),
                pa.array((other[first[1:]] - other[first[:-1]]).view(np.int64)),
                _lists(np.concatenate([np.zeros(0, np.uint64), *cold]), np.array([len(x) for x in cold], dtype=np.int64)),
                _lists(np.concatenate([np.zeros(0, np.uint64), *warm]), np.array([len(x) for x in warm], dtype=np.int64)),
            ],
            ["doc_id", "n", "fp", "fq", "cold", "warm"],
        )


@returned
def _whole(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for part, h, first in _sets(batches, k):
        yield pa.RecordBatch.from_arrays([part.column(0), _lists(h, np.diff(first))], ["node", "items"])


class JaccardJoin:
    """Links documents whose sets of ``k``-word shingles have a Jaccard similarity of ``percent`` / 100 at least.

    Texts are lower-cased in A-Z and split at space and \\t..\\r. A text of fewer than ``k`` words is one shingle; a text
    without words, or a null, has an empty set and links with nothing. Rows that share an id count as one document
    (the links of any of its texts are its own); rows with a null id are linked with nothing and keep a null component.
    Other columns of the input are ignored, whatever their names.
    """

    def __init__(self, k: int = 5, percent: int = 80, star_rounds: int = 2):
        if not 0 < percent <= 100:
            raise ValueError("percent must be in 1..100")
        self.k, self.percent, self.star_rounds = k, percent, star_rounds

    def components(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_shingles, component_id), a row per input row; component_id is the smallest id in reach of links."""
        spark = docs.sparkSession
        bounded_batches(spark)
        stash = Stash(spark)
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        bits, hot, rank = self._frequent(docs, stash)
        described = stash.keep(
            docs.mapInArrow(
                partial(_described, k=self.k, percent=self.percent, bits=bits, hot=hot, rank=rank),
                "doc_id long, n long, fp long, fq long, cold array<long>, warm array<long>",
            ),
            "described",
        )
        classes = stash.keep(
            described.where("n > 0 and doc_id is not null").groupBy("n", "fp", "fq").agg(F.min("doc_id").alias("node")), "classes"
        )
        # one row per class: two rows of a class may share the smallest id, and then they are equal
        nodes = stash.keep(
            described.where("n > 0").join(classes.select("n", "fp", "fq", F.col("node").alias("doc_id")), ["n", "fp", "fq", "doc_id"], "left_semi")
            .dropDuplicates(["doc_id", "n", "fp", "fq"])
            .select(F.col("doc_id").alias("node"), "n", "cold", "warm"),
            "nodes",
        )
        blocks = self._blocks(nodes, stash)
        links = self._links(docs, blocks, nodes, stash).unionByName(self._of_one_id(described, classes, stash))
        named = components(links, stash)
        stash.drop_but(described, classes, named)
        rows = described.select("doc_id", F.col("n").alias("n_shingles"), "n", "fp", "fq")
        some = F.expr("n > 0 and doc_id is not null")
        linked = (
            rows.where(some).join(classes, ["n", "fp", "fq"]).join(named, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("comp", "node").alias("component_id"))
        )
        return linked.unionByName(rows.where(~some).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))

    def _of_one_id(self, described: DataFrame, classes: DataFrame, stash: Stash) -> DataFrame:
        """(a, b): links between the classes that the texts of one id are in."""
        some = described.where("n > 0 and doc_id is not null")
        several = some.groupBy("doc_id").agg(F.min(F.struct("n", "fp", "fq")).alias("lo"), F.max(F.struct("n", "fp", "fq")).alias("hi")).where("lo <> hi").select("doc_id")
        own = stash.keep(some.join(several, "doc_id").join(classes, ["n", "fp", "fq"]).select("doc_id", "node").distinct(), "several")
        return own.groupBy("doc_id").agg(F.min("node").alias("a")).join(own, "doc_id").select("a", F.col("node").alias("b"))

    def _frequent(self, docs: DataFrame, stash: Stash) -> tuple[int, np.ndarray, np.ndarray]:
        """Bits that name a bucket, and the keys of the most frequent shingles with their places in the order of counts."""
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(24, max(0, (size // BUCKET_BYTES).bit_length()))
        dealt = docs.mapInArrow(partial(_hashes, k=self.k, bits=bits), "bucket long, ones binary, more binary, counts binary")
        counts = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_counts, least=FREQUENT_FROM), "key long, c long")
        counts = stash.keep(counts.withColumn("level", F.floor(8 * F.log2("c")).cast("int")), "counts")
        room, cut, part = FREQUENT, 0, 0
        for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r.level):  # some hundreds of levels at most
            if r["count"] > room:  # of this level those that a part of the keys' space holds
                cut, part = r.level, room * 1024 // r["count"]
                break
            room, cut, part = room - r["count"], r.level, 1024
        rows = counts.where((F.col("level") > cut) | ((F.col("level") == cut) & (F.pmod("key", F.lit(1024)) < part))).select("key", "c").toArrow()
        found, count = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        stash.drop(counts)
        rank = np.empty(len(found), dtype=np.int32)
        rank[np.lexsort((found, count))] = np.arange(1, len(found) + 1)  # the most frequent comes last
        order = np.argsort(found)
        return bits, found[order], rank[order]

    def _blocks(self, nodes: DataFrame, stash: Stash) -> DataFrame:
        """(h, node, n, pos, centre): the incidence in prefixes, shingles of one class left out. Frequent shingles, whose
        blocks may be huge, are summed before they are joined; the others meet in one exchange."""
        own = W.partitionBy("h")
        cold = (
            nodes.select("node", "n", F.posexplode("cold").alias("pos", "h"))
            .select("*", F.count(F.lit(1)).over(own).alias("rows"), F.min("node").over(own).alias("centre"))
            .where("rows > 1").drop("rows")
        )
        warm = nodes.where(F.size("warm") > 0).select("node", "n", F.posexplode("warm").alias("pos", "h"), F.size("cold").alias("ahead"))
        warm = warm.withColumn("pos", F.col("pos") + F.col("ahead")).drop("ahead")
        sums = stash.keep(warm.groupBy("h").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "warm")
        return stash.keep(cold.unionByName(warm.join(sums.drop("rows"), "h")), "blocks")

    def _need(self, n: str, m: str) -> str:
        """SQL for the least overlap with which sets of n and m shingles are similar enough."""
        p = self.percent
        return f"((({p} * ({n} + {m})) + {99 + p}) div {100 + p})"

    def _bound(self) -> F.Column:
        """The least count of common prefix shingles with which sets of n and m shingles can be similar enough."""
        p, need = self.percent, self._need("n", "m")
        length = lambda x: f"({x} - (({p} * {x} + 99) div 100) + 1)"
        return F.expr(f"greatest(1L, least({length('n')} - (n - {need}), {length('m')} - (m - {need})))")

    def _sized(self, pairs: DataFrame, sizes: DataFrame) -> DataFrame:
        return (
            pairs.join(sizes.select(F.col("node").alias("a"), "n"), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("m")), "b")
            .where(F.expr(f"100 * least(n, m) >= {self.percent} * greatest(n, m)"))
            .withColumn("bound", self._bound())
        )

    def _verified(self, docs: DataFrame, pairs: DataFrame, stash: Stash) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar enough; sets are made again from the texts of these pairs."""
        ids = stash.keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
        few = ids.count() <= BROADCAST_IDS
        texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        sets = stash.keep(
            texts.mapInArrow(partial(_whole, k=self.k), "node long, items array<long>").groupBy("node", "items").count().drop("count"), "sets"
        )
        both = (
            pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
            .select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("common"))
            .where(F.expr(f"100 * common >= {self.percent} * (n + m - common)")).select("a", "b")
        )
        out = stash.keep(both, "verified")
        stash.drop(sets, ids)
        return out

    def _links(self, docs: DataFrame, blocks: DataFrame, nodes: DataFrame, stash: Stash) -> DataFrame:
        links, rest, sizes = None, blocks, nodes.select("node", "n")
        for turn in range(self.star_rounds):
            star = (
                rest.where("node <> centre" if turn == 0 else "comp <> centre_comp").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("c"))
                .groupBy("node").agg(F.max(F.struct("c", "centre")).alias("most")).select(F.col("node").alias("a"), F.col("most.centre").alias("b"), "most.c")
            )
            likely = stash.keep(self._sized(star, sizes).where("4 * c >= bound").select("a", "b"), "likely")
            found = self._verified(docs, likely, stash)
            links = found if links is None else stash.keep(links.unionByName(found), "links")
            rest = self._apart(blocks, components(links, stash), turn, stash)
        left = self._bounded(self._product(rest), nodes, stash)
        return links.unionByName(self._verified(docs, left, stash))

    def _product(self, rest: DataFrame) -> DataFrame:
        """(a, b): pairs of different groups that meet where both of them still have room for the overlap they need. A
        pair with an overlap of o has its first common shingle among the first n - o + 1 of the one and the first
        m - o + 1 of the other, which leaves out most of the frequent shingles, as these come last."""
        one = rest.select("h", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
        two = rest.select("h", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"))
        need = self._need("na", "nb")
        meet = f"ca < cb and 100 * least(na, nb) >= {self.percent} * greatest(na, nb) and pa <= na - {need} and pb <= nb - {need}"
        return one.join(two, "h").where(F.expr(meet)).select("a", "b").distinct()

    def _bounded(self, pairs: DataFrame, nodes: DataFrame, stash: Stash) -> DataFrame:
        """The pairs whose prefixes have as many shingles in common as their sizes ask for."""
        prefixes = nodes.select("node", "n", F.concat("cold", "warm").alias("prefix"))
        both = pairs.join(prefixes.select(F.col("node").alias("a"), "n", F.col("prefix").alias("x")), "a").join(
            prefixes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("prefix").alias("y")), "b"
        )
        return stash.keep(both.where(F.size(F.array_intersect("x", "y")) >= self._bound()).select("a", "b"), "left")

    def _apart(self, blocks: DataFrame, named: DataFrame, turn: int, stash: Stash) -> DataFrame:
        """The rows of blocks that hold more than one group, each with its group and a new centre."""
        rows = blocks.drop("centre").join(named, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        rows = stash.keep(rows, "rows")
        pick = F.xxhash64("node", F.lit(turn))
        mixed = stash.keep(
            rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(pick.alias("p"), "node", "comp")).alias("pick"))
            .where("lo <> hi").select("h", F.col("pick.node").alias("centre"), F.col("pick.comp").alias("centre_comp")),
            "mixed",
        )
        out = stash.keep(rows.join(mixed, "h"), "apart")
        stash.drop(rows, mixed)
        return out


def keep_one(docs: DataFrame, join: JaccardJoin | None = None) -> DataFrame:
    """One document of each group: rows whose id is the smallest of its component, and of rows that share such an id one.
    Rows with a null id all stay, as nothing names their group. Columns are those of ``docs``."""
    stash = Stash(docs.sparkSession)
    gone = stash.keep((join or JaccardJoin()).components(docs).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    # with few enough ids no text is shuffled
    small = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    kept = docs.join(small(gone), "doc_id", "left_anti")
    again = stash.keep(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    again = small(again)
    row = F.struct(*docs.columns)
    one = kept.join(again, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(row, F.struct(F.xxhash64("text"), F.col("text"))).alias("__row"))
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("__row.*"))
