"""Groups of records that say nearly the same, without comparing every record with every other.

1. A text becomes its sequence of lower-cased words. Records with the same sequence form one class, which goes on as one
   set of distinct runs of k words (64-bit hashes), so any number of copies costs no comparison.
2. Exact blocking: with a similarity of t or more two sets of n and m runs share a run among the n - ceil(t n) + 1 and
   m - ceil(t m) + 1 rarest of each (any fixed order gives no false dismissal; the rarest first gives small blocks). Runs
   that only one set holds are left out.
3. Tiled comparison inside a block: each set has a parity bitmap (a run flips one bit), so the bits in which two bitmaps
   differ are at most the runs in which the sets differ. Blocks are sorted by population count and cut into tiles; tile
   pairs whose population counts differ beyond the radius are skipped, the others go through numpy's exclusive-or and
   bit count. Blocks are counted with map-side sums first; those beyond a size are cut over tasks by pairs of
   sub-blocks before they are shuffled, so a hot block is never one task's work.
4. What stays is compared exactly, set against set; only the sets that a pair needs are moved.
5. Members of two similar classes, or of one, are paired by sub-blocks of bounded size, so neither is a large class one
   task's work.

Joins that move sets are sorted merges by hint, never broadcasts. Nothing is sampled or capped. A 64-bit hash may in
principle collide (some 1e-4 expected over 1e8 distinct runs).

Null, empty and short texts (fewer than k words) take no part, nor do records without id. A record that arrives again counts
once; an id that arrives with different contents counts with one of them, always the same. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.session import bounded, cut

BITS = 512
TILE = 128
HOT_BLOCK = 4096
#: Members of a class that are paired by one row.
CLASS_BLOCK = 256


def word_texts(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """id, cid, words of the records whose text has at least k words: the words in one string, cid its hash, the class."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    rows = df.select(F.col(key).cast("bigint").alias("id"), words.alias("_w")).where(F.col("id").isNotNull() & (F.size("_w") >= k))
    rows = rows.select("id", F.array_join("_w", " ").alias("words"))
    return rows.select("id", F.xxhash64("words").alias("cid"), "words")


def run_sets(classes: DataFrame, k: int) -> DataFrame:
    """cid, runs, n, pop, bits of each class (cid, words), once: its distinct runs, their number, bitmap and its bit count."""
    one = classes.groupBy("cid").agg(F.first("words").alias("words")).withColumn("_w", F.split("words", " "))
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (k - 1)), lambda i: F.xxhash64(*[F.element_at("_w", i + j) for j in range(k)]))
    return one.select("cid", F.array_sort(F.array_distinct(runs)).alias("runs")).mapInArrow(_bitmaps, "cid bigint, runs array<bigint>, n int, pop int, bits binary")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each set's parity bitmap and its population count."""
    for whole in batches:
        for batch in (whole.slice(i, 4000) for i in range(0, whole.num_rows, 4000)):
            runs = batch.column(1)
            sizes = np.diff(runs.offsets.to_numpy())
            bits = (runs.flatten().to_numpy() & (BITS - 1)) + np.repeat(np.arange(len(sizes)), sizes) * BITS
            parity = (np.bincount(bits, minlength=len(sizes) * BITS) & 1).astype(np.uint8).reshape(len(sizes), BITS)
            packed = np.packbits(parity, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), pa.array(parity.sum(axis=1).astype(np.int32)), pa.array([x.tobytes() for x in packed], pa.binary())],
                ["cid", "runs", "n", "pop", "bits"],
            )


def _compare(num: int, den: int):
    """The comparison of sorted blocks: yields the pairs that the bitmaps can't tell apart beyond the radius."""

    def radius(total: np.ndarray) -> np.ndarray:
        # similarity >= t = num/den  <=>  runs that differ <= (1 - t)/(1 + t) (n + m)
        return (den - num) * total // (den + num)

    def near(ids, n, pop, words, blk, a, b):  # noqa: ANN001, ANN202
        total = n[a] + n[b]
        ok = (den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])) & (np.abs(pop[a] - pop[b]) <= radius(total)) & (ids[a] != ids[b])
        a, b, total = a[ok], b[ok], total[ok]
        if len(a):
            apart = np.bitwise_count(words[a] ^ words[b]).sum(axis=1)
            ok = apart <= radius(total)
            a, b = a[ok], b[ok]
        return np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])

    def block(ids, n, pop, words, blk, lo, hi, mixed):  # noqa: ANN001, ANN202
        """All tile pairs of the rows lo..hi of one block, sorted by population count."""
        most = np.maximum.reduceat(n[lo:hi], np.arange(0, hi - lo, TILE))
        rest = np.maximum.accumulate(most[::-1])[::-1]
        for i in range(lo, hi, TILE):
            i_end = min(i + TILE, hi)
            for j in range(i, hi, TILE):
                j_end = min(j + TILE, hi)
                gap, x, y = pop[j] - pop[i_end - 1], (i - lo) // TILE, (j - lo) // TILE
                if gap > radius(most[x] + rest[y]):
                    break  # sorted: later tiles are farther still, and none of them has larger sets
                if gap > radius(most[x] + most[y]):
                    continue
                a, b = (x.ravel() for x in np.meshgrid(np.arange(i, i_end), np.arange(j, j_end), indexing="ij"))
                keep = a < b
                if mixed:
                    keep &= blk[a] != blk[b]
                yield near(ids, n, pop, words, blk, a[keep], b[keep])

    def flush(rows):  # noqa: ANN001, ANN202
        key, ids, n, pop, blk, mixed, words = rows
        edges = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        starts, ends = np.r_[0, edges], np.r_[edges, len(ids)]
        size = ends - starts
        small = size <= TILE
        # Small blocks of one batch go together: row r meets row r + d as long as that lies in its block.
        last = np.repeat(np.where(small, ends, 0), size)
        rows_at, d = np.arange(len(ids)), 1
        alive = rows_at[rows_at + 1 < last]
        while len(alive):
            a, b = alive, alive + d
            use = ~mixed[a] | (blk[a] != blk[b])
            yield near(ids, n, pop, words, blk, a[use], b[use])
            d += 1
            alive = alive[alive + d < last[alive]]
        for lo, hi in zip(starts[~small], ends[~small]):
            yield from block(ids, n, pop, words, blk, lo, hi, bool(mixed[lo]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(parts):  # noqa: ANN001, ANN202
            got = [p for p in parts if len(p[0])]
            if got:
                pairs = np.unique(np.stack([np.concatenate([p[0] for p in got]), np.concatenate([p[1] for p in got])], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        def stacked(parts):  # noqa: ANN001, ANN202
            return tuple(np.concatenate(x) for x in zip(*parts))

        for batch in batches:
            if not batch.num_rows:
                continue
            c = {x: batch.column(i) for i, x in enumerate(batch.schema.names)}
            key = np.stack([c["run"].to_numpy(), c["bi"].to_numpy().astype(np.int64), c["bj"].to_numpy().astype(np.int64)], axis=1)
            words = np.frombuffer(b"".join(c["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
            rows = (key, c["cid"].to_numpy(), c["n"].to_numpy().astype(np.int64), c["pop"].to_numpy().astype(np.int64), c["blk"].to_numpy(), key[:, 1] != key[:, 2], words)
            # The last block may go on in the next batch: hold it back.
            same = np.all(key == key[-1], axis=1)
            begin = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if begin:
                whole = stacked([*held, tuple(x[:begin] for x in rows)])
                held = [tuple(x[begin:] for x in rows)]
                yield from out(flush(whole))
            elif held and np.any(held[-1][0][-1] != key[0]):
                whole, held = stacked(held), [rows]
                yield from out(flush(whole))
            else:
                held.append(rows)
        if held:
            yield from out(flush(stacked(held)))

    return run


def similar_classes(df: DataFrame, key: str, text: str, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The class of every record that takes part, as (id, cid), and the pairs (a, b) of classes with similarity of at least
    num/den, a < b, exactly compared. Both are written."""
    texts = cut(word_texts(df, key, text, k))
    members = cut(texts.groupBy("id").agg(F.min("cid").alias("cid")))
    sets = cut(run_sets(texts.select("cid", "words"), k))

    postings = sets.select("cid", F.explode("runs").alias("run"))
    held = postings.groupBy("run").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = postings.join(held.hint("merge"), "run").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "run"))).alias("ranked"))
    headed = ranked.join(sets.select("cid", "n", "pop", "bits").hint("merge"), "cid")
    length = F.col("n") - F.floor((F.lit(num) * F.col("n") + (den - 1)) / F.lit(den)).cast("int") + 1 - (F.col("n") - F.size("ranked"))
    headed = cut(headed.where(length > 0).select("cid", "n", "pop", "bits", F.transform(F.slice("ranked", F.lit(1), length), lambda r: r["run"]).alias("heads")))

    counts = headed.select(F.explode("heads").alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("_c"))
    hot = bounded(counts.where(F.col("_c") > HOT_BLOCK).select("run", F.ceil(F.col("_c") / F.lit(HOT_BLOCK)).cast("int").alias("_p")))
    blocks = headed.select("cid", "n", "pop", "bits", F.explode("heads").alias("run")).join(hot, "run", "left")
    blocks = blocks.withColumn("blk", F.coalesce(F.pmod(F.xxhash64("cid"), F.col("_p")), F.lit(0)).cast("int"))
    blocks = blocks.withColumn("_o", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_p") - 1, F.lit(0)))))
    blocks = blocks.select("run", F.least("blk", "_o").alias("bi"), F.greatest("blk", "_o").alias("bj"), "cid", "n", "pop", "blk", "bits")
    blocks = blocks.repartition("run", "bi", "bj").sortWithinPartitions("run", "bi", "bj", "pop")
    pairs = cut(blocks.mapInArrow(_compare(num, den), "a bigint, b bigint").distinct())

    # Each pair asks for its two sets; one shuffle brings them together.
    asks = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("cid"), F.lit(0).alias("side")), F.struct(F.col("b").alias("cid"), F.lit(1).alias("side")))).alias("_s")).select("a", "b", "_s.cid", "_s.side")
    both = sets.select("cid", "runs").join(asks, "cid").groupBy("a", "b")
    both = both.agg(*[F.first(F.when(F.col("side") == i, F.col("runs")), ignorenulls=True).alias(x) for i, x in ((0, "_ra"), (1, "_rb"))])
    same = F.size(F.array_intersect("_ra", "_rb"))
    return members, cut(both.where(same * (num + den) >= F.lit(num) * (F.size("_ra") + F.size("_rb"))).select("a", "b"))


def _sub_blocks(members: DataFrame) -> DataFrame:
    """cid, blk, p, ids: the members of each class in p sub-blocks of some CLASS_BLOCK ids."""
    counts = members.groupBy("cid").agg(F.count(F.lit(1)).alias("_c"))
    large = bounded(counts.where(F.col("_c") > CLASS_BLOCK).select("cid", F.ceil(F.col("_c") / F.lit(CLASS_BLOCK)).cast("int").alias("_p")))
    rows = members.join(large, "cid", "left").withColumn("p", F.coalesce("_p", F.lit(1)))
    return rows.groupBy("cid", F.pmod(F.xxhash64("id"), F.col("p")).cast("int").alias("blk"), "p").agg(F.collect_list("id").alias("ids"))


def found_pairs(df: DataFrame, key: str, text: str, k: int = 3, num: int = 7, den: int = 10) -> DataFrame:
    """(note_id_a, note_id_b): all pairs of different records with similarity of at least num/den, smaller id first.

    Similarity: intersection over union of the sets of distinct runs of k words. Only key and text are read.
    """
    members, exact = similar_classes(df, key, text, k, num, den)
    blocks = cut(_sub_blocks(members))
    one = blocks.select(F.col("cid").alias("a"), F.col("ids").alias("_xs"))
    two = blocks.select(F.col("cid").alias("b"), F.col("ids").alias("_ys"))
    across = exact.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("_xs", "_ys", F.lit(False).alias("_same"))
    inner = blocks.where((F.size("ids") > 1) | (F.col("p") > 1)).select("cid", F.col("ids").alias("_xs"), F.col("blk").alias("_bi"), F.explode(F.sequence("blk", F.col("p") - 1)).alias("blk"))
    inner = inner.join(blocks.select("cid", "blk", F.col("ids").alias("_ys")).hint("merge"), ["cid", "blk"]).select("_xs", "_ys", (F.col("_bi") == F.col("blk")).alias("_same"))
    pairs = across.unionByName(inner).select(F.explode("_xs").alias("_x"), "_ys", "_same").select("_x", F.explode("_ys").alias("_y"), "_same")
    return pairs.where(~F.col("_same") | (F.col("_x") < F.col("_y"))).select(F.least("_x", "_y").alias("note_id_a"), F.greatest("_x", "_y").alias("note_id_b"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least vertex of each vertex's component, of edges (a, b).

    Two steps in turn until no edge changes: every vertex links its larger neighbours to the least vertex it knows, then
    its smaller ones and itself. Components shrink to stars in logarithmically many rounds, whatever the shape of
    the graph, so there is no limit on rounds; the number of edges never grows. Each round's edges are written.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges, before = cut(edges), None
    digest = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
    while before != (now := digest(edges)):
        before = now
        both = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("_e")).select("_e.u", "_e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = cut(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct())
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())


def near_groups(df: DataFrame, key: str, text: str, k: int = 3, num: int = 7, den: int = 10) -> DataFrame:
    """(id, group_id, links): one row per record with a run of k words; group_id is the least id that it is linked to over
    any number of steps, links the number of other classes that its own class is directly linked to."""
    members, exact = similar_classes(df, key, text, k, num, den)
    roots = components(exact).withColumnRenamed("id", "cid")
    degree = exact.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("links"))
    out = cut(members.join(roots, "cid", "left").join(degree, "cid", "left").select("id", F.coalesce("root", "cid").alias("root"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links")))
    named = out.groupBy("root").agg(F.min("id").alias("group_id"))
    return out.join(named, "root").select("id", "group_id", "links")
