"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources a document belongs to). A flow network leads from
patterns to the quotas of their sources; a pattern's capacity comes in layers, one for each repetition, at convex costs,
so that nothing is repeated while a fresh document could be had. What flows out of a pattern is then taken from its
documents in a seeded order.

Sources, their quotas and patterns are tables of any size. A pattern whose source is in no pattern of several sources has
one path, whose flow is the smaller of its capacity and the quota; only the patterns that meet in sources of several go
to the solver on the driver, a row for each distinct set.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegate.llm.shared import Stash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BIN_BITS = 14
#: Rows of a plan up to which it is broadcast; a larger one is joined by its key.
BROADCAST_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Number of maximal runs outside space and \\t..\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class _Flow:
    """Flow from patterns to sources through layers of equal cost.

    A path costs what its layer does: on its way through other patterns it takes as much from an edge as it gives to
    another, at no cost. So the cheapest paths are those from patterns with room left in the present layer, and all of
    these are filled at once by blocking flows over shortest paths before the next layer opens.
    """

    def __init__(self, members: Sequence[Sequence[int]], quotas: Sequence[int]):
        self.members, self.left = members, list(quotas)
        self.sent = [[0] * len(own) for own in members]
        self.room = [0] * len(members)
        self.back: list[list[tuple[int, int]]] = [[] for _ in quotas]
        for p, own in enumerate(members):
            for j, s in enumerate(own):
                self.back[s].append((p, j))

    def layer(self, sizes: Sequence[int]) -> None:
        self.room = [a + b for a, b in zip(self.room, sizes, strict=True)]
        while levels := self._levels():
            self._fill(*levels)

    def _levels(self) -> tuple[list[int], list[int]] | None:
        """How far each pattern and source is from a pattern with room, up to the first source with some quota left."""
        of_pattern, of_source = [-1] * len(self.members), [-1] * len(self.left)
        edge = [p for p, room in enumerate(self.room) if room]
        for p in edge:
            of_pattern[p] = 0
        depth = 0
        while edge:
            depth += 1
            reached = []
            for p in edge:
                for s in self.members[p]:
                    if of_source[s] < 0:
                        of_source[s] = depth
                        reached.append(s)
            if any(self.left[s] for s in reached):
                return of_pattern, of_source
            depth += 1
            edge = []
            for s in reached:
                for p, j in self.back[s]:
                    if of_pattern[p] < 0 and self.sent[p][j]:
                        of_pattern[p] = depth
                        edge.append(p)
        return None

    def _fill(self, of_pattern: list[int], of_source: list[int]) -> None:
        next_of_pattern, next_of_source = [0] * len(self.members), [0] * len(self.left)
        for start in range(len(self.members)):
            # path: a pattern and the place of the source it goes on to, then how that source goes back to a pattern
            path: list[list[int]] = [[start, -1, -1]]
            while self.room[start] and path:
                p = path[-1][0]
                own, j = self.members[p], next_of_pattern[p]
                while j < len(own) and of_source[own[j]] != of_pattern[p] + 1:
                    j += 1
                next_of_pattern[p] = j
                if j == len(own):
                    path.pop()
                    if path:
                        next_of_source[self.members[path[-1][0]][path[-1][1]]] += 1
                    continue
                s = own[j]
                path[-1][1] = j
                if self.left[s]:
                    self._push(path, s)
                    path = [[start, -1, -1]]
                    continue
                back, i = self.back[s], next_of_source[s]
                while i < len(back) and (of_pattern[back[i][0]] != of_source[s] + 1 or not self.sent[back[i][0]][back[i][1]]):
                    i += 1
                next_of_source[s] = i
                if i == len(back):
                    next_of_pattern[p] += 1
                else:
                    path[-1][2] = back[i][1]
                    path.append([back[i][0], -1, -1])

    def _push(self, path: list[list[int]], last: int) -> None:
        amount = min(self.room[path[0][0]], self.left[last], *(self.sent[b[0]][a[2]] for a, b in zip(path, path[1:], strict=False)))
        self.room[path[0][0]] -= amount
        self.left[last] -= amount
        for a, b in zip(path, [*path[1:], None], strict=True):
            self.sent[a[0]][a[1]] += amount
            if b:
                self.sent[b[0]][a[2]] -= amount


def flow(members: Sequence[Sequence[int]], sizes: Sequence[int], quotas: Sequence[int], repeats: int = REPEATS) -> list[int]:
    """Tokens to take from each pattern, given the numbers of its sources and its size. The k-th repetition costs 2k - 1
    a token: of all largest flows, one that costs the least."""
    net = _Flow([list(dict.fromkeys(own)) for own in members], quotas)
    for _ in range(repeats):
        net.layer(sizes)
    return [sum(own) for own in net.sent]


class Mixer:
    """Takes ``share`` of all words from ``docs``, divided over sources by repeating ``weights``.

    ``sources`` is a column of one source or an array of sources per document. Null is a source of its own, the last;
    an empty array counts as null. The size of a null or empty text is 0 and nothing is taken of it. Rows that are
    repeated count each; the order of documents is that of a seeded hash of id and text, and rows alike in both share
    what falls to them. An empty table gives an empty mix.
    """

    def __init__(self, sources: str = "source", text: str = "text", doc_id: str = "doc_id", seed: int = 17, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS):
        self.sources, self.text, self.doc_id, self.seed = sources, text, doc_id, seed
        self.weights, self.share, self.repeats = tuple(weights), share, repeats

    def _described(self, docs: DataFrame, *columns: str | Column) -> DataFrame:
        """``columns`` of ``docs`` and __m_*: the pattern and its name, size, place in the seeded order and its bin."""
        if docs.schema[self.sources].dataType.typeName() == "array":
            own = F.array_sort(F.array_distinct(F.transform(F.col(self.sources), lambda s: s.cast("string"))))
            own = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(None).cast("string")))
        else:
            own = F.array(F.col(self.sources).cast("string"))
        text = F.col(self.text).cast("string")
        place = F.xxhash64(F.col(self.doc_id), text, F.lit(self.seed))
        return docs.select(
            *columns, own.alias("__m_pattern"), F.to_json(own).alias("__m_key"), word_count(text).alias("__m_size"), place.alias("__m_place"),
            F.shiftright(place, 64 - BIN_BITS).cast("int").alias("__m_bin"),
        )

    def targets(self, patterns: DataFrame, stash: Stash) -> DataFrame:
        """(source, source_size, target, shared) of all sources of ``patterns(pattern, size)``.

        Weights repeat over the sources by code point, null last. No target exceeds ``repeats`` times its source's size;
        the excess goes to the others by weight until none is above. ``shared``: whether a pattern has others beside it.
        """
        spark = patterns.sparkSession
        each = patterns.select(F.explode("pattern").alias("source"), "size", (F.size("pattern") > 1).alias("shared"))
        each = each.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("shared").alias("shared"))
        # numbers within partitions of the sorted table, and how many rows the partitions before have
        ranked = stash.keep(each.orderBy(F.asc_nulls_last("source")).withColumn("id", F.monotonically_increasing_id()), "sources")
        counts = ranked.groupBy(F.shiftright("id", 33).alias("part")).count().orderBy("part").collect()
        before, n = [], 0
        for r in counts:
            before.append(n)
            n += r["count"]
        offsets = spark.createDataFrame(pa.table({"part": pa.array([r.part for r in counts], pa.int64()), "before": pa.array(before, pa.int64())}))
        rank = F.col("before") + F.expr("id & 8589934591L")
        weight = F.get(F.array(*[F.lit(float(w)) for w in self.weights]), F.pmod(rank, F.lit(len(self.weights))).cast("int"))
        ranked = ranked.withColumn("part", F.shiftright("id", 33)).join(F.broadcast(offsets), "part")
        ranked = ranked.select("source", "source_size", "shared", weight.alias("weight"), (self.repeats * F.col("source_size")).cast("double").alias("most"))
        words = self.share * (patterns.agg(F.sum("size")).first()[0] or 0)
        level = 0.0
        while True:
            above = F.col("most") < level * F.col("weight")
            sums = ranked.agg(F.sum(F.when(~above, F.col("weight"))).alias("open"), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)).alias("full")).first()
            found = (words - sums.full) / sums.open if sums.open else level
            if found <= level * (1 + 1e-12):
                break
            level = found
        return ranked.select("source", "source_size", F.least("most", level * F.col("weight")).alias("target"), "shared")

    def _flows(self, joined: DataFrame, patterns: DataFrame) -> DataFrame:
        """(__m_key, flow) of the patterns that meet in sources with others, from ``joined``, a row per pattern and source."""
        sources = joined.where("shared").groupBy("source").agg(F.first("target").alias("target")).toArrow().to_pydict()
        number = {s: i for i, s in enumerate(sources["source"])}
        # patterns in such a source; a pattern of several sources has no others
        rows = joined.where("shared").select("__m_key").distinct().join(patterns, "__m_key").orderBy("__m_key").toArrow()
        members = [[number[s] for s in own] for own in rows["pattern"].to_pylist()]
        found = flow(members, rows["size"].to_pylist(), [round(t) for t in sources["target"]], self.repeats)
        return patterns.sparkSession.createDataFrame(pa.table({"__m_key": rows["__m_key"].cast(pa.string()), "flow": pa.array(found, pa.int64())}))

    def plan(self, rows: DataFrame, stash: Stash) -> DataFrame:
        """A row per pattern of ``rows(__m_*)``: whole repetitions, and the place up to which words are taken beyond them."""
        bins = stash.keep(rows.groupBy("__m_key", "__m_bin").agg(F.first("__m_pattern").alias("pattern"), F.sum("__m_size").alias("size")), "bins")
        patterns = stash.keep(bins.groupBy("__m_key").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("size")), "patterns")
        targets = stash.keep(self.targets(patterns, stash), "targets")
        joined = patterns.select("__m_key", "size", F.explode("pattern").alias("s")).join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
        alone = joined.groupBy("__m_key").agg(
            F.first("size").alias("size"), F.sum("target").alias("target"), F.sum("source_size").alias("source_size"), F.max("shared").alias("shared")
        )
        one = F.least(F.round("target").cast("long"), self.repeats * F.col("size"))
        if targets.where("shared").limit(1).count():
            alone = alone.join(self._flows(joined, patterns), "__m_key", "left").withColumn("flow", F.when(F.col("shared"), F.col("flow")).otherwise(one))
        else:
            alone = alone.withColumn("flow", one)
        some = F.col("size") > 0
        whole = F.when(some, F.expr("flow div size")).otherwise(0).cast("long")
        rest = F.when(some, F.col("flow") % F.col("size")).otherwise(0).cast("long")
        plan = stash.keep(alone.select("__m_key", "target", "source_size", whole.alias("__m_times"), rest.alias("__m_rest")), "plan")
        # the words beyond whole repetitions end inside one bin of each pattern, so only its rows are put in order
        upto = lambda own: F.sum("size").over(own) - F.col("size")
        inside = "before <= __m_rest and __m_rest < before + size"
        wanted = self._small(plan.where("__m_rest > 0").select("__m_key", "__m_rest"))
        cut = bins.join(wanted, "__m_key").withColumn("before", upto(W.partitionBy("__m_key").orderBy("__m_bin"))).where(inside)
        cut = self._small(stash.keep(cut.select("__m_key", "__m_bin", (F.col("__m_rest") - F.col("before")).alias("__m_rest")), "cut"))
        ends = rows.join(cut, ["__m_key", "__m_bin"]).groupBy("__m_key", "__m_place").agg(F.sum("__m_size").alias("size"), F.first("__m_rest").alias("__m_rest"))
        ends = ends.withColumn("before", upto(W.partitionBy("__m_key").orderBy("__m_place"))).where(inside)
        ends = ends.select("__m_key", F.col("__m_place").alias("__m_last"), (F.col("__m_rest") - F.col("before")).alias("__m_part"), F.col("size").alias("__m_of"))
        return stash.keep(plan.drop("__m_rest").join(ends, "__m_key", "left"), "ends")

    @staticmethod
    def _small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table

    def _decided(self, rows: DataFrame, plan: DataFrame, *columns: str) -> DataFrame:
        size, place, last = F.col("__m_size"), F.col("__m_place"), F.col("__m_last")
        # rows of one place share its part
        part = F.when(size == F.col("__m_of"), F.col("__m_part")).otherwise(F.floor(size * (F.col("__m_part") / F.col("__m_of"))))
        more = F.when(place < last, size).when(place == last, part).otherwise(0).cast("long")
        return rows.join(self._small(plan), "__m_key").select(*columns, size.alias("size"), "source_size", "target", (F.col("__m_times") * size + more).alias("taken"))

    def decisions(self, docs: DataFrame) -> DataFrame:
        """(doc_id, size, source_size, target, taken) for each row of ``docs``, whose texts are read once."""
        stash = Stash(docs.sparkSession)
        rows = stash.keep(self._described(docs, F.col(self.doc_id).alias("doc_id")), "rows")
        return self._decided(rows, self.plan(rows, stash), "doc_id")

    def taken(self, docs: DataFrame) -> DataFrame:
        """``docs`` with size, source_size, target (those of its source; sums for several) and taken: the words of the
        document in the mix, repetitions counted. Columns of these names in ``docs`` are replaced."""
        stash = Stash(docs.sparkSession)
        plan = self.plan(stash.keep(self._described(docs), "rows"), stash)
        kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken") and not c.startswith("__m_")]
        return self._decided(self._described(docs, *kept), plan, *kept)


def mixed(docs: DataFrame, mixer: Mixer | None = None) -> DataFrame:
    """The mix as documents: each as often as it is taken, a part of one counting as whole from half of it on."""
    columns = docs.columns
    out = (mixer or Mixer()).taken(docs.withColumns({f"__keep_{i}": F.col(c) for i, c in enumerate(columns) if c in ("size", "source_size", "target", "taken")}))
    times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int")
    kept = [F.col(f"__keep_{i}").alias(c) if c in ("size", "source_size", "target", "taken") else F.col(c) for i, c in enumerate(columns)]
    return out.where(times > 0).withColumn("__times", F.explode(F.sequence(F.lit(1), times))).select(*kept)
