"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.  DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, scratch

WEIGHTS = (5.0, 2.0, 1.0)
#: Blocks of one source at most: what a window over a source's blocks holds, and how finely its rest is cut before documents are ordered.
BLOCKS = 65_536
#: Blocks of a shard, about.
SHARD_BLOCKS = 256


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on `parts` only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """Each source's target: `share` of all sizes dealt by weight, none above `most` times its source's size.

    `sized` has (source, size).  Sources in code-point order, null last, weigh `weights`, repeating.  What a source cannot
    take is dealt again among the others by weight, until none is above its limit; that fixed point is the level at which
    sum(min(limit, level * weight)) meets the total, found with one sorted pass over the sources.
    Returns (source, source_size, target); an empty input gives an empty result.  One row for each source.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w)
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.lit(most) * F.col("source_size")
    ranked = (
        sources.withColumn("limit", limit)
        .withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
        .withColumn("meets", F.col("level") <= F.col("limit") / F.col("weight"))
        .withColumn("level", F.min(F.when(F.col("meets"), F.struct((F.col("source_size") / F.col("weight")).alias("at"), "level"))).over(everything)["level"])
    )
    target = F.least(F.col("limit"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def hypergeometric(good: Column, bad: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` draws without replacement from good + bad items are good: the law's inverse at u in [0, 1).

    The law's weights follow from each other by ratios, from the mode on: first upwards, then downwards, as far as 12 standard
    deviations and 20 more to either side (beyond lies less than 1e-30), so a draw of n items takes about 24 sqrt(n) / 2 steps.
    """
    total = good + bad
    low, high = F.greatest(F.lit(0).cast("long"), drawn - bad), F.least(good, drawn)
    mode = F.greatest(low, F.least(high, F.floor((drawn + 1.0) * (good + 1.0) / (total + 2.0)).cast("long")))
    share = good / F.greatest(total, F.lit(1).cast("long"))
    spread = F.sqrt(drawn * share * (1.0 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1).cast("long")))
    reach = (F.ceil(12 * spread) + 20).cast("long")
    up = F.sequence(mode, F.least(high, mode + reach))
    down = F.when(F.greatest(low, mode - reach) < mode, F.sequence(mode - 1, F.greatest(low, mode - reach), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))

    def rise(k: Column) -> Column:  # weight of k + 1 over that of k
        return (good - k) * 1.0 * (drawn - k) / ((k + 1.0) * (bad - drawn + k + 1))

    def fall(k: Column) -> Column:  # weight of k - 1 over that of k
        return k * 1.0 * (bad - drawn + k) / ((good - k + 1.0) * (drawn - k + 1))

    one, none = F.lit(1.0), F.lit(None).cast("long")
    first = F.when(mode > low, fall(mode)).otherwise(0.0)

    def weigh(ratio):
        return lambda s, k: F.struct((s["w"] * F.coalesce(ratio(k), F.lit(0.0))).alias("w"), (s["sum"] + s["w"]).alias("sum"))

    def pick(ratio):
        hit = lambda s: s["k"].isNull() & (s["left"] < s["w"])
        return lambda s, k: F.struct((s["w"] * F.coalesce(ratio(k), F.lit(0.0))).alias("w"), (s["left"] - F.when(s["k"].isNull() & ~hit(s), s["w"]).otherwise(0.0)).alias("left"), F.when(hit(s), k).otherwise(s["k"]).alias("k"))

    above = F.aggregate(up, F.struct(one.alias("w"), F.lit(0.0).alias("sum")), weigh(rise))["sum"]
    below = F.aggregate(down, F.struct(first.alias("w"), F.lit(0.0).alias("sum")), weigh(fall))["sum"]
    upper = F.aggregate(up, F.struct(one.alias("w"), (u * (above + below)).alias("left"), none.alias("k")), pick(rise))
    lower = F.aggregate(down, F.struct(first.alias("w"), upper["left"].alias("left"), upper["k"].alias("k")), pick(fall))
    return F.coalesce(lower["k"], mode)


def split_tree(quotas: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """Deal exact numbers of blocks among 2**levels shards by recursive multivariate-hypergeometric splits.

    `quotas` has (source, blocks), one row a source.  At each node of the tree half of the node's blocks (rounded down) go
    left; how many of each source do is a draw without replacement: source after source, hypergeometric in the source's
    blocks, those of the sources still to come, and the places left.  Every shard thus gets an exact number of blocks, and
    what it holds of each source is distributed as in a full random permutation, although only counts are moved.
    A node is one row with a count for each source; nodes are split in parallel.
    Returns (source, shard, n, start): n blocks of the source's permuted sequence from `start` on, disjoint over shards.
    """
    state = quotas.where("blocks > 0").groupBy().agg(F.array_sort(F.collect_list(F.struct("source", F.col("blocks").cast("long").alias("n")))).alias("left_over"))
    state = state.select(F.lit(0).cast("long").alias("node"), "left_over")

    def drawing(level: int):
        def draw(acc: Column, x: Column) -> Column:
            took = hypergeometric(x["n"], acc["blocks"] - x["n"], acc["places"], _uniform(F.lit(seed), F.lit(level), F.col("node"), x["source"]))
            # The draw stands in an array of one, so that it is made once.
            return F.transform(F.array(took), lambda t: F.struct((acc["places"] - t).alias("places"), (acc["blocks"] - x["n"]).alias("blocks"), F.concat(acc["taken"], F.array(t)).alias("taken")))[0]

        return draw

    for level in range(levels):
        total = F.aggregate("left_over", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
        state = state.withColumn("total", total)
        dealt = F.aggregate("left_over", F.struct(F.floor(F.col("total") / 2).cast("long").alias("places"), F.col("total").alias("blocks"), F.array().cast("array<long>").alias("taken")), drawing(level))
        state = state.withColumn("taken", dealt["taken"])
        left = F.zip_with("left_over", "taken", lambda x, t: F.struct(x["source"].alias("source"), t.alias("n")))
        right = F.zip_with("left_over", "taken", lambda x, t: F.struct(x["source"].alias("source"), (x["n"] - t).alias("n")))
        state = state.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("left_over")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("left_over")))).alias("x")).select("x.*")
        if level % 4 == 3:
            state = scratch(state.repartition("node"), "nodes")
    leaves = state.select(F.col("node").alias("shard"), F.explode("left_over").alias("x")).select("x.source", "shard", "x.n").where("n > 0")
    start = F.sum("n").over(Window.partitionBy("source").orderBy("shard")) - F.col("n")
    return leaves.withColumn("start", start)


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, levels: int | None = None, block_docs: int = 256, seed: int = 0, partial: bool = True) -> DataFrame:
    """Take words of every source near its target, and deal what is taken among 2**levels output shards.

    docs: (doc_id, text, source, ...); other columns are ignored.  A source's quota is whole passes over its blocks and then,
    for the rest of its target, permuted blocks until the rest is used up.  Blocks have about `block_docs` documents, more where
    a source would have over BLOCKS of them.  The splitting tree deals each source's quota of blocks among shards (`levels`: as many as
    give a shard about SHARD_BLOCKS blocks, 4 at least), and a document is taken as often as the tree has dealt its block.  Inside the one
    block that the rest ends in, documents are taken in permuted order, and the document at the end in part (`partial`) or
    whole if that is nearer.  All draws are hashes of doc_id and `seed`, so reruns agree.

    Returns a row for each input row: doc_id, size, source_size, target, taken, copies (array of (copy, shard, place): one for
    each copy taken, whole or in part; shards hold what the splitting tree gives them, in an order shuffled within the
    shard by `place`).
    Null texts and texts of white space have size 0 and are never taken.  A very long text is one document of its size.  A null source is a source.  A source of size 0 has
    target 0.  Rows with equal doc_id are separate documents drawn together.  An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    # Texts are read and counted once; all that follows works on the sizes.
    rows = scratch(rows.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size")), "sizes")
    goals = source_targets(rows, share, most, weights)
    held = rows.groupBy(F.col("source").alias("held_source")).agg(F.count("*").alias("n_docs"))
    goals = (
        goals.join(held, F.col("source").eqNullSafe(F.col("held_source"))).drop("held_source")
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
        .withColumn("n_blocks", F.least(F.ceil(F.col("n_docs") / block_docs).cast("long"), F.lit(BLOCKS)))
    )
    goals = goals.withColumnRenamed("source", "goal_source")
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), "n_blocks"))

    # Blocks of a source in permuted order: the rest of the target takes whole blocks, and ends inside one.
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block"), "block")
    blocks = blocks.withColumn("rank", F.row_number().over(permuted) - 1).withColumn("before", F.sum("words").over(permuted) - F.col("words"))
    blocks = blocks.withColumn("room", F.col("rest") - F.col("before"))

    # Shards: copy 1..passes take every block, the last copy those that the rest reaches; each (block, copy) is one unit.
    units = blocks.withColumn("n_units", F.col("passes") + F.when((F.col("room") > 0) & (F.col("words") > 0), 1).otherwise(0))
    numbered = Window.partitionBy("source").orderBy("rank")
    units = units.withColumn("first_unit", F.sum("n_units").over(numbered) - F.col("n_units"))
    units = scratch(units, "units")
    quotas = units.groupBy("source").agg(F.sum("n_units").alias("blocks"))
    if levels is None:
        # One number for the whole mix.
        levels = max(4, math.ceil(math.log2(max(1, quotas.agg(F.sum("blocks")).first()[0] or 0) / SHARD_BLOCKS)))
    runs = split_tree(quotas, levels, seed + 3).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("start", "n", "shard"))).alias("runs")).withColumnRenamed("source", "run_source")
    units = units.join(runs, F.col("source").eqNullSafe(F.col("run_source")), "left").withColumn(
        "shards",
        F.when(
            F.col("n_units") > 0,
            F.transform(
                F.sequence(F.lit(0).cast("long"), F.col("n_units") - 1),
                lambda k: F.element_at(F.filter("runs", lambda r: (r["start"] <= F.col("first_unit") + k) & (F.col("first_unit") + k < r["start"] + r["n"])), 1)["shard"],
            ),
        ).otherwise(F.array().cast("array<long>")),
    )
    # Whole passes that the tree has dealt of the block; the rest's copy, where there is one, is the last.
    whole = F.size(F.filter("shards", lambda x: x.isNotNull())) - (F.col("n_units") - F.col("passes"))
    placed = units.select(F.col("source").alias("block_source"), F.col("block").alias("block_no"), "room", "words", "shards", whole.cast("long").alias("whole"))

    rows = rows.join(placed, F.col("source").eqNullSafe(F.col("block_source")) & (F.col("block") == F.col("block_no")))
    # Only the block in which the rest ends needs an order of its documents; it has about block_docs of them.
    cut = (F.col("room") > 0) & (F.col("room") < F.col("words"))
    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size")
    ended = rows.where(cut).withColumn("free", F.col("room") - (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("free")))
    if not partial:
        extra = F.when(F.col("free") * 2 >= F.col("size"), F.col("size")).otherwise(0)
    ended = ended.withColumn("extra", extra).drop("free")
    others = rows.where(~cut).withColumn("extra", F.when(F.col("room") > 0, F.col("size")).otherwise(0))
    rows = ended.unionByName(others)
    n_copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).otherwise(0)
    rows = rows.withColumn("n_copies", n_copies)
    copies = F.when(
        F.col("n_copies") > 0,
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_copies").cast("long") - 1), lambda k: F.struct(k.alias("copy"), F.element_at("shards", (k + 1).cast("int")).alias("shard"), F.xxhash64(F.lit(seed + 4), "key", k).alias("place"))),
    ).otherwise(F.array().cast("array<struct<copy:bigint,shard:bigint,place:bigint>>"))
    taken = F.when(F.col("size") > 0, F.col("whole") * F.col("size") + F.col("extra")).otherwise(0).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"))


def lay_out(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """All columns of docs and `shard`: a row for each copy that `mixed` (of mix) takes, dealt by shard and shuffled inside it by place.

    docs have one row for each doc_id.  Columns of docs called shard are replaced.
    """
    taken = mixed.where(F.size("copies") > 0).select(F.col("doc_id").alias("_taken_id"), F.explode("copies").alias("_copy")).select("_taken_id", F.col("_copy.shard").alias("_shard"), F.col("_copy.place").alias("_place"))
    plain = docs.drop("shard")
    ends = plain.select(F.struct(*[F.col(c) for c in plain.columns]).alias("_row"))
    joined = ends.join(taken, F.col("_row.doc_id").eqNullSafe(F.col("_taken_id")))
    dealt = joined.repartition("_shard").sortWithinPartitions("_shard", "_place")
    return dealt.select("_row.*", F.col("_shard").alias("shard"))
