"""Mixing of overlapping sources to target shares of the total size in tokens.

1. Every document's tokens are counted once by a public tokenizer. Copies of one text are one item, whose *membership
   pattern* is the set of listed sources that hold it; items are aggregated by pattern (at most 2^sources rows, however
   many documents there are).
2. A min-cost flow routes token capacity from patterns to source quotas. Each further use of a pattern's items is an
   arc of its own at a higher price (convex repetition costs), so repeats come only where they must. The total is the
   largest at which every quota can be met, or the one asked for, in which case quotas fill as far as they can.
3. Items are selected by seeded order: they lie on their pattern's tape in the order of a seeded hash, lap after lap; each
   source owns an interval of the laps, as long as its flow, and gets the items that begin in it. An interval of at most
   r laps uses an item at most r times. Places on the tape are distributed prefix sums over hash ranges, so no task holds
   a whole pattern.

Documents without tokens, without source or of unlisted sources take no part. Shares really reached are reported; they
differ from the flow's by less than one item for each pattern and source.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from marginalia.llm.tokens import VOCABULARIES, with_token_count
from marginalia.session import BROADCAST_ROWS, cut

#: Sources that may be listed at most; patterns and quotas are solved on the driver, so their number is bounded.
MOST_SOURCES = 64
MOST_PATTERNS = 20_000


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


class Network:
    """Token capacity from patterns to source quotas as a flow in whole numbers.

    Only a pattern's uses have a price, k * k for the k-th, so a cheapest path is one whose first arc is the cheapest use that
    still reaches a quota. The flow is therefore grown use by use: the arcs of the k-th use are opened for all patterns and
    filled by blocking flows over shortest paths (which may reroute what flows already) before the next use is opened.
    That gives a flow of the least cost among the largest ones.
    """

    def __init__(self, capacity: dict[tuple[str, ...], int], targets: list[Target]) -> None:
        self.patterns, self.targets = list(capacity), targets
        self.sizes = [capacity[p] for p in self.patterns]
        by, first = {t.source: i for i, t in enumerate(targets)}, len(self.patterns)
        self.uses = [max(targets[by[x]].repeats for x in p) for p in self.patterns]
        self.sources = [[first + by[x] for x in p] for p in self.patterns]
        self.holders: list[list[int]] = [[] for _ in targets]
        for i, nodes in enumerate(self.sources):
            for n in nodes:
                self.holders[n - first].append(i)

    def solve(self, total: float) -> bool:
        """Routes the quotas of a total; whether all are met. ``flow`` and ``open`` keep what flows and what the quotas lack."""
        first = len(self.patterns)
        self.quota = [int(t.share * total) for t in self.targets]
        self.open = list(self.quota)
        self.left = [0] * first
        self.flow: list[dict[int, int]] = [{} for _ in self.patterns]
        for use in range(max(self.uses, default=0)):
            for i, n in enumerate(self.sizes):
                if use < self.uses[i]:
                    self.left[i] += n
            while self._blocking():
                pass
            if not any(self.open):
                return True
        return not any(self.open)

    def _room(self, i: int, n: int) -> int:
        return self.sizes[i] * self.targets[n - len(self.patterns)].repeats - self.flow[i].get(n, 0)

    def _levels(self) -> dict[int, int]:
        first, level = len(self.patterns), {i: 0 for i, n in enumerate(self.left) if n > 0}
        queue, met = deque(level), None
        while queue:
            a = queue.popleft()
            if met is not None and level[a] >= met:
                continue
            if a < first:
                near = (n for n in self.sources[a] if n not in level and self._room(a, n) > 0)
            elif self.open[a - first] > 0:
                met = level[a] if met is None else met
                continue
            else:
                near = (i for i in self.holders[a - first] if i not in level and self.flow[i].get(a, 0) > 0)
            for b in near:
                level[b] = level[a] + 1
                queue.append(b)
        return level if met is not None else {}

    def _blocking(self) -> bool:
        """Fills all shortest paths; whether there were any."""
        first, level, moved = len(self.patterns), self._levels(), False
        if not level:
            return False
        tried: dict[int, int] = {}
        for start in [i for i, n in enumerate(self.left) if n > 0]:
            path = [start]
            while self.left[start] > 0 and path:
                a = path[-1]
                if a >= first and self.open[a - first] > 0:
                    push = min(self.left[start], self.open[a - first])
                    for x, y in zip(path, path[1:]):
                        push = min(push, self._room(x, y) if x < first else self.flow[y][x])
                    self.left[start] -= push
                    self.open[a - first] -= push
                    for x, y in zip(path, path[1:]):
                        if x < first:
                            self.flow[x][y] = self.flow[x].get(y, 0) + push
                        else:
                            self.flow[y][x] -= push
                    moved, path = True, [start]
                    continue
                near = self.sources[a] if a < first else self.holders[a - first]
                k = tried.get(a, 0)
                while k < len(near) and not (level.get(near[k]) == level[a] + 1 and (self._room(a, near[k]) > 0 if a < first else self.flow[near[k]].get(a, 0) > 0)):
                    k += 1
                tried[a] = k
                if k < len(near):
                    path.append(near[k])
                else:
                    path.pop()
                    if path:
                        tried[path[-1]] = tried.get(path[-1], 0) + 1
        return moved

    def cut_bound(self) -> float:
        """The largest total that the least cut of the last flow lets through: a bound from above on what can be met."""
        first = len(self.patterns)
        reached, queue = set(i for i, n in enumerate(self.left) if n > 0), [i for i, n in enumerate(self.left) if n > 0]
        while queue:
            a = queue.pop()
            for b in (self.sources[a] if a < first else self.holders[a - first]):
                if b not in reached and (self._room(a, b) > 0 if a < first else self.flow[b].get(a, 0) > 0):
                    reached.add(b)
                    queue.append(b)
        beyond = [k for k in range(len(self.targets)) if first + k not in reached]
        through = sum(self.sizes[i] * self.targets[k].repeats if i in reached else 0 for k in beyond for i in self.holders[k])
        through += sum(self.sizes[i] * self.uses[i] for i in range(first) if i not in reached)
        return through / sum(self.targets[k].share for k in beyond)


def route(capacity: dict[tuple[str, ...], int], targets: list[Target], total: int) -> tuple[dict[tuple[tuple[str, ...], str], int], bool]:
    """Tokens of each (pattern, source) at the least repetition cost, and whether every quota of this total is met."""
    net = Network(capacity, targets)
    met, first = net.solve(total), len(capacity)
    return {(p, targets[n - first].source): f for p, flow in zip(net.patterns, net.flow) for n, f in flow.items() if f > 0}, met


def largest_total(capacity: dict[tuple[str, ...], int], targets: list[Target]) -> int:
    """The largest total whose quotas can all be met, but for the rounding of quotas.

    Each flow that falls short gives a cut, and the cut a smaller total, so a few flows (no more than sources, as each
    cut has fewer of them to bound) lead to the largest one.
    """
    if not capacity or not targets:
        return 0
    net = Network(capacity, targets)
    total = sum(n * u for n, u in zip(net.sizes, net.uses)) / sum(t.share for t in targets)
    while not net.solve(total):
        bound = net.cut_bound()
        # Quotas are rounded down, so a cut may bound no more than the total itself: one token less then.
        total = bound if bound < total * (1 - 1e-12) else total - 1
    return int(total)


def select_mix(docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, total: int | None = None, seed: int = 7, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, source, uses, tokens): the items of the mix by their least id, the source they stand for, how often they are
    used, and the tokens of one use. Deterministic for a seed. Listed targets with a null source, no share or no
    repeats are left out; of a source listed twice the first in order of share counts."""
    listed = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError("too many target sources")
    goals = sorted((Target(r["source"], float(r["t"]["target_share"]), int(r["t"]["max_repeats"])) for r in listed), key=lambda t: t.source)
    schema = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("source", T.StringType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("lap", T.LongType())])
    spark = docs.sparkSession

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("_x"))
    rows = rows.where(F.col("source").isin([g.source for g in goals]) & (F.length("_x") > 0)).withColumn("_h", F.md5("_x"))
    # Copies of a text meet before it is tokenized, so each text is tokenized once.
    texts = rows.groupBy("_h").agg(F.min("doc_id").alias("doc_id"), F.first("_x").alias("_x"), F.array_sort(F.collect_set("source")).alias("_p"))
    items = with_token_count(texts, "_x", "n", name, folder).where("n > 0")
    items = cut(items.select("doc_id", "n", F.to_json("_p").alias("pattern"), F.xxhash64(F.lit(seed), "_h").alias("_r")))

    sums = items.groupBy("pattern").agg(F.sum("n").alias("n"), F.from_json(F.first("pattern"), "array<string>").alias("p")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError("too many membership patterns")
    names = {tuple(r["p"]): r["pattern"] for r in sums}
    capacity = {tuple(r["p"]): int(r["n"]) for r in sums}
    present = {x for p in capacity for x in p}
    goals = [g for g in goals if g.source in present]
    flows = route(capacity, goals, largest_total(capacity, goals) if total is None else total)[0] if goals else {}
    spans, at = [], {}
    for (p, x), f in sorted(flows.items()):
        lo = at.get(p, 0)
        at[p] = lo + f
        spans.append((names[p], x, lo, lo + f, capacity[p]))

    # Places on the tape: sums over hash ranges of each pattern, then within each range.
    items = items.withColumn("_b", F.shiftright("_r", 52))
    sums = items.groupBy("pattern", "_b").agg(F.sum("n").alias("_s"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(W.partitionBy("pattern").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("n").over(W.partitionBy("pattern", "_b").orderBy("_r", "doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    placed = items.withColumn("_in", inside).join(sums.select("pattern", "_b", "_before"), ["pattern", "_b"]).withColumn("_at", F.col("_before") + F.col("_in"))
    owners = spark.createDataFrame(spans, schema)
    owned = placed.join(F.broadcast(owners) if len(spans) <= BROADCAST_ROWS else owners.hint("merge"), "pattern")
    # Laps k with lo <= at + k * lap < hi.
    upto = lambda x: F.greatest(F.lit(0), F.ceil((F.col(x) - F.col("_at")) / F.col("lap"))).cast("bigint")
    return owned.withColumn("uses", upto("hi") - upto("lo")).where("uses > 0").select("doc_id", "source", "uses", F.col("n").alias("tokens"))


def mix_report(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, docs, tokens, repeats, target_share, actual_share) of every listed source: the documents it gives, its tokens
    with repeats, the most uses of one document, and its target and real share of the total."""
    got = selection.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("repeats"))
    zero = F.lit(0).cast("bigint")
    out = targets.where("source is not null").groupBy("source").agg(F.min("target_share").alias("target_share")).join(got, "source", "left")
    out = out.select("source", *[F.coalesce(x, zero).alias(x) for x in ("docs", "tokens", "repeats")], "target_share")
    return out.withColumn("actual_share", F.try_divide("tokens", F.sum("tokens").over(W.partitionBy(F.lit(1)))))
