"""URL filtering: listed rules decide what they fit; the rest is decided by two character language models.

Variable-order Markov models of the whole URLs (scheme, query and fragment too) that rules accept and reject are counted
over all pages, but for a fifth of them, and smoothed by Witten-Bell interpolation of all orders. A URL's log-likelihood
difference, divided by its length, is held against a threshold calibrated on that fifth. The models are tables of all n-grams counted, as large
as the input makes them: blocks of rows are joined with the steps of their own n-grams.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import partial
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.shared import Stash, bounded_batches
from tidegate.llm.words import returned

ORDER = 5
ALPHABET = 256
#: Rows of a block are 2**BLOCK_BITS at most; each distinct n-gram of a block is joined once.
BLOCK_BITS = 11
_START = "\x02"

#: (action, host and path)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for what has no ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(url, parts, 1), upper, lower)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, action) of the longest rule that fits, else null. A rule fits its host and all subdomains, where
    the path starts with the rule's."""
    cases = []
    for action, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        cases.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule:string,action:string>")


def held_out(url: Column) -> Column:
    """Whether a URL is kept from the models, for the threshold."""
    return F.crc32(url.cast("binary")) % 5 == 0


def _texts(url: str, order: int) -> list[str]:
    """The n-grams of ``order`` characters that end at each character of a URL."""
    text = _START * (order - 1) + url
    return [text[i : i + order] for i in range(len(url))]


@returned
def _grams(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of each block, with their counts in accepted and rejected URLs; both are 0 for what others hold."""
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        for block, own in groupby(rows, key=itemgetter(0)):
            counts: dict[str | None, Counter[str]] = {"allow": Counter(), "block": Counter(), None: Counter()}
            for _, kind, url in own:
                counts[kind].update(_texts(url, order))
            grams = list(dict.fromkeys(g for c in counts.values() for g in c))
            by_kind = [pa.array([counts[kind][g] for g in grams], pa.int64()) for kind in ("allow", "block")]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(grams), pa.int64()), pa.array(grams, pa.string()), *by_kind], ["block_id", "gram", "allow", "block"])


class CharModel:
    """P(next | context): Witten-Bell interpolation from the order given down to a uniform alphabet."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total: Counter[str] = Counter()
        self.kinds: Counter[str] = Counter()
        for gram, c in counts.items():
            self.total[gram[:-1]] += c
            self.kinds[gram[:-1]] += 1

    def probability(self, context: str, char: str) -> float:
        p = 1.0 / ALPHABET
        for n in range(len(context) + 1):
            own = context[len(context) - n :]
            if total := self.total.get(own, 0):
                kinds = self.kinds[own]
                p = (self.counts.get(own + char, 0) + kinds * p) / (total + kinds)
        return p


def _steps(grams: DataFrame, order: int) -> DataFrame:
    """(gram, step): log P(last character | those before) of accepted less that of rejected URLs, for all ``grams``.

    Shorter n-grams are the ends of longer ones, so each order's counts are sums of the next one's.
    """
    sums = [F.sum(kind).alias(kind) for kind in ("allow", "block")]
    levels = [grams.groupBy("gram").agg(*sums)]
    for n in range(order - 1, 0, -1):
        levels.append(levels[-1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(*sums))
    levels.reverse()
    every = [f(kind) for kind in ("allow", "block") for f in (lambda k: F.coalesce(F.sum(k), F.lit(0)).alias(f"{k}_total"), lambda k: F.count_if(F.col(k) > 0).alias(f"{k}_kinds"))]
    whole = levels[0].agg(*every).first().asDict()

    def smoothed(kind: str, total: Column, kinds: Column, lower: Column) -> Column:
        return F.when(total > 0, (F.col(kind) + kinds * lower) / (total + kinds)).otherwise(lower).alias(f"{kind}_p")

    lower = levels[0].select("gram", *[smoothed(k, F.lit(whole[f"{k}_total"]), F.lit(whole[f"{k}_kinds"]), F.lit(1.0 / ALPHABET)) for k in ("allow", "block")])
    for n, level in enumerate(levels[1:], 2):
        context = Window.partitionBy("context")
        counted = level.withColumn("context", F.substring("gram", 1, n - 1)).withColumn("rest", F.substring("gram", 2, n - 1))
        for kind in ("allow", "block"):
            counted = counted.withColumn(f"{kind}_total", F.sum(kind).over(context)).withColumn(f"{kind}_kinds", F.count_if(F.col(kind) > 0).over(context))
        both = counted.join(lower.withColumnRenamed("gram", "rest"), "rest")
        lower = both.select("gram", *[smoothed(k, F.col(f"{k}_total"), F.col(f"{k}_kinds"), F.col(f"{k}_p")) for k in ("allow", "block")])
    return lower.select("gram", (F.log("allow_p") - F.log("block_p")).alias("step"))


def _ratio(rows: pa.Table, steps: pa.Table, order: int) -> pa.Table:
    """Ratios of one block's URLs; ``steps`` has all of its n-grams."""
    step = dict(zip(steps["gram"].to_pylist(), steps["step"].to_pylist(), strict=True))
    scores = [sum(map(step.__getitem__, _texts(u, order))) / len(u) if u else 0.0 for u in rows["url"].to_pylist()]
    return rows.drop_columns("block_id").append_column("ratio", pa.array(scores, pa.float64()))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio) for every row of ``pages``.

    ``verdict`` is the rule's where one fits, else "block" where the ratio is under the threshold and "allow" where it
    is not. The threshold lies as many spreads from the mean ratio of accepted as from that of rejected URLs, both of those
    that the models have not seen (of all, where none of a kind was held out). Rules see host and path, the models the whole URL. Where the rules accept or reject nothing, and for null and
    empty URLs, there is nothing to compare: such rows are allowed. Repeated rows are judged each; other columns are
    ignored.
    """
    bounded_batches(pages.sparkSession)
    stash = Stash(pages.sparkSession)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path = host_and_path(url)
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path")).withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    named = named.select("page_id", "url", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.action").alias("action"), held_out(F.col("url")).alias("held"), F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block_id"))
    named = stash.keep(named, "urls")
    grams = named.select("block_id", F.when(~F.col("held"), F.col("action")), "url").mapInArrow(partial(_grams, order=order), "block_id long, gram string, allow long, block long")
    grams = stash.keep(grams, "grams")
    steps = grams.select("block_id", "gram").join(_steps(grams, order), "gram")
    scored = named.groupBy("block_id").cogroup(steps.groupBy("block_id")).applyInArrow(partial(_ratio, order=order), "page_id long, url string, host string, path string, rule string, action string, held boolean, ratio double")
    scored = stash.keep(scored, "scored")
    stash.drop(named, grams)
    spread = [F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("spread")]
    known = {r.action: r for r in scored.where("action is not null and held").groupBy("action").agg(*spread).collect()}
    if len(known) < 2:  # too few to hold some out
        known = {r.action: r for r in scored.where("action is not null").groupBy("action").agg(*spread).collect()}
    if len(known) < 2:
        other = F.lit("allow")
    else:
        a, b = known["allow"], known["block"]
        width = a.spread + b.spread
        # as many spreads away from the one mean as from the other
        threshold = (a["mean"] * b.spread + b["mean"] * a.spread) / width if width else (a["mean"] + b["mean"]) / 2
        other = F.when((F.col("ratio") < threshold) & (F.col("url") != ""), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("action", other).alias("verdict"), "ratio")
