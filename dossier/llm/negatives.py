"""Hard negatives by a distributed nearest-neighbour join: norm-augmented vectors, pivots, bounds of anchor groups, local exact joins.

With M the largest norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and an anchor a becomes (a, 0).  Then |a - x|^2 = |a|^2 + M^2 - 2 a.x:
the largest inner products are the least distances, for which the triangle inequality holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, shuffle_partitions

#: Squared norms from which an inner product might not be exact in doubles.
LARGEST = float(1 << 53)
#: Groups of anchors whose bounds travel with the tasks that deal out rows.
MOST_GROUPS = 4_096


@dataclass
class Join:
    """What is looked for, and sizes: `own` searches rows of an anchor's label, else rows of other labels between two scores."""

    own: bool = True
    keep: int = 5
    least: int = 30
    most: int = 90
    group_rows: int = 128
    slice_rows: int = 1 << 18
    block: int = 8_192
    #: Bins of labels by which anchors are grouped where rows go to their own label only.
    bins: int = 16


@dataclass
class Space:
    """Vectors as packed bytes, the largest squared norm, and rows known to every task (a bounded sample)."""

    dim: int
    longest: float
    known: pa.Table | None

    @property
    def packed(self) -> str:
        return "<i2" if self.longest < 2.0**30 else "<i4"

    def vectors(self, column) -> np.ndarray:
        """Whole numbers as floats in which every inner product is exact."""
        raw = np.frombuffer(b"".join(column.to_pylist()), self.packed).reshape(-1, self.dim)
        return raw.astype(np.float32 if self.longest < 2.0**24 else np.float64)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))[:, None]], axis=1)

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], axis=1)

    def distance(self, scores: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """From anchors of these squared norms to rows of these scores; -inf is infinitely far, inf is here."""
        return np.sqrt(np.maximum(squares + self.longest - 2 * scores, 0))


def _numbers(column) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)


def usable(vectors: DataFrame, scale: int, relabel: int, classes: int) -> tuple[DataFrame, int]:
    """(vec_id, label, q, norm) of the rows that take part, and the number of components."""
    v = F.col("embedding").cast("array<double>")
    size = vectors.where("size(embedding) > 0 and label is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = size["n"] if size else 0
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % relabel == 0, (label + 1) % classes).otherwise(label)
    usual = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) == dim) & F.coalesce(whole, F.lit(False)))
    rows = usual.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(v, lambda x: F.floor(x * float(scale)).cast("double")).alias("q"))
    return rows.withColumn("norm", F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)).where(F.col("norm") < LARGEST), dim


def _packed(rows: DataFrame, space: Space) -> DataFrame:
    """The rows with a number of their own and their vectors as bytes, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, space.dim).astype(space.packed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in q], pa.binary())], ["vec_id", "label", "q"])

    return scratch(rows.select("vec_id", "label", "q").mapInArrow(run, "vec_id long, label long, q binary").withColumn("row", F.monotonically_increasing_id()), "vectors")


def farthest(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the farthest from those before it."""
    gap, chosen = (x * x).sum(axis=1), []
    while len(chosen) < min(n, len(x)):
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0))


class Anchors:
    """Anchors and the first `keep` rows, by larger score and then smaller id, of each of their searches."""

    def __init__(self, table: pa.Table, space: Space, join: Join) -> None:
        self.join, self.x = join, space.vectors(table.column("q"))
        self.row, self.label = _numbers(table.column("row")), _numbers(table.column("label"))
        found = [[None]] * len(self.row) if join.own else table.column("found").to_pylist()
        self.searches = [(a, n, hit) for a, hits in enumerate(found) for n, hit in enumerate(hits or ())]
        # least * p <= 100 * n <= most * p in whole numbers.
        self.low = np.array([-np.inf if join.own else -(-join.least * h["score"] // 100) for *_, h in self.searches])
        self.high = np.array([np.inf if join.own else join.most * h["score"] // 100 for *_, h in self.searches])
        self.floor = self.low.copy()
        self.held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.searches)

    def look(self, x: np.ndarray, ids: np.ndarray, label: np.ndarray, rows: np.ndarray) -> None:
        """Take what counts of a block of rows."""
        score, same = self.x @ x.T, self.label[:, None] == label[None, :]
        score[(~same | (self.row[:, None] == rows[None, :])) if self.join.own else same] = np.nan
        for k, (a, *_) in enumerate(self.searches):
            hit = np.flatnonzero((score[a] >= self.floor[k]) & (score[a] <= self.high[k]))
            if len(hit):
                s, i, r = (np.concatenate(both) for both in zip(self.held[k], (score[a][hit], ids[hit], rows[hit])))
                order = np.lexsort((r, i, -s))[: self.join.keep]
                self.held[k] = s[order], i[order], r[order]
                if len(order) == self.join.keep:
                    self.floor[k] = s[order[-1]]

    def reach(self, space: Space) -> tuple[np.ndarray, np.ndarray]:
        """(inner, outer) for each anchor: the distances between which a row can still be among the first of a search."""
        inner, outer = np.full(len(self.row), np.inf), np.full(len(self.row), -np.inf)
        which = np.array([a for a, *_ in self.searches], np.int64)
        squares = (self.x.astype(np.float64) ** 2).sum(axis=1)[which]
        some = self.floor <= self.high
        np.minimum.at(inner, which[some], space.distance(self.high[some], squares[some]))
        np.maximum.at(outer, which[some], space.distance(self.floor[some], squares[some]))
        return inner, outer


def _grouped(anchors: DataFrame, space: Space, join: Join, pivots: np.ndarray) -> DataFrame:
    """The anchors with their Voronoi cell, distance from its pivot, and the distances between which rows can serve them.

    The rows known to every task give each anchor a first bound: what can't displace those need not come.
    """
    known, fields = space.known, "row long, vec_id long, label long, q binary" + ("" if join.own else ", found array<struct<score: long, vec_id: long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, label, number = space.vectors(known.column("q")), *(_numbers(known.column(c)) for c in ("vec_id", "label", "row"))
        for batch in batches:
            for at in range(0, batch.num_rows, join.group_rows):
                part = pa.Table.from_batches([batch.slice(at, join.group_rows)])
                held = Anchors(part, space, join)
                held.look(rows, ids, label, number)
                inner, outer = held.reach(space)
                gap = distances(space.of_anchors(held.x), pivots)
                cell = gap.argmin(axis=1)
                more = [held.label % join.bins if join.own else held.label * 0, cell, gap[np.arange(len(cell)), cell], inner, outer]
                for found in part.to_batches():
                    yield pa.RecordBatch.from_arrays([*found.columns, *map(pa.array, more)], [*part.column_names, "bin", "cell", "gap", "inner", "outer"])

    return scratch(anchors.mapInArrow(run, f"{fields}, bin long, cell long, gap double, inner double, outer double"), "anchors")


@dataclass
class Groups:
    """Groups of anchors: bin, cell, and bounds; `slices` parts of the rows that serve each, dealt to tasks of their own."""

    bin: np.ndarray
    cell: np.ndarray
    bounds: np.ndarray
    slices: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.slices) - self.slices

    def served(self, d: np.ndarray, bins: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(group, the rows at these distances from the pivots that it might need), by the triangle inequality."""
        for g, (inner, outer, near, far) in enumerate(self.bounds):
            gap = d[:, self.cell[g]]
            slack = 1e-6 * (1 + gap + far)
            yield g, np.flatnonzero((np.maximum(gap - far, near - gap) <= outer + slack) & (gap + far >= inner - slack) & (bins == self.bin[g]))


def _groups(grouped: DataFrame, space: Space, join: Join, pivots: np.ndarray, total: int) -> tuple[DataFrame, Groups]:
    """Anchors with `group`, and the groups: a cell's anchors, in several groups where they are many, each with its bounds."""
    spark = grouped.sparkSession
    sizes = sorted((r["bin"], r["cell"], r["n"]) for r in grouped.groupBy("bin", "cell").agg(F.count("*").alias("n")).collect())
    rows = max(join.group_rows, -(-sum(n for *_, n in sizes) // (MOST_GROUPS // 2)))
    parts = [-(-n // rows) for *_, n in sizes]
    starts = np.cumsum([0, *parts]).tolist()
    dealt = spark.createDataFrame([(b, c, p, s) for (b, c, _), p, s in zip(sizes, parts, starts)], "bin long, cell long, parts long, start long")
    group = F.col("start") + F.pmod(F.xxhash64("row"), F.col("parts"))
    anchors = grouped.join(F.broadcast(dealt), ["bin", "cell"]).withColumn("group", group)
    bounds = {r["group"]: r for r in anchors.groupBy("group").agg(F.first("bin").alias("bin"), F.first("cell").alias("cell"), F.min("inner"), F.max("outer"), F.min("gap"), F.max("gap")).collect()}
    # A part that a hash left empty serves nobody.
    found = [bounds.get(g, (g, 0, 0, np.inf, -np.inf, 0.0, 0.0)) for g in range(starts[-1])]
    groups = Groups(*(np.array([f[k] for f in found], np.int64) for k in (1, 2)), np.array([list(f)[3:] for f in found], float).reshape(-1, 4), np.ones(len(found), np.int64))
    known = space.vectors(space.known.column("q"))
    bins = _numbers(space.known.column("label")) % join.bins if join.own else np.zeros(len(known), np.int64)
    share = np.array([len(r) / max(1, len(known)) for _, r in groups.served(distances(space.of_rows(known), pivots), bins)])
    groups.slices = np.maximum(1, np.maximum(np.ceil(share * total / join.slice_rows), -(-shuffle_partitions(spark) // max(1, len(found))))).astype(np.int64)
    return anchors, groups


def _searched(rows: DataFrame, anchors: DataFrame, space: Space, join: Join, total: int, due: int) -> DataFrame:
    """The first rows of every search: row and anchor_id of the anchor, positive_id and positive_score of the search, rank, vec_id, score."""
    spark = rows.sparkSession
    most = max(1, min(256, due // (join.group_rows * (10 if join.own else 1))))
    # Pivots lie where anchors do, so that a group's anchors are near theirs.
    pivots = farthest(space.of_anchors(space.vectors(space.known.column("q"))), most)
    anchors, groups = _groups(_grouped(anchors, space, join, pivots), space, join, pivots, total)
    found = "cast(null as array<struct<score: long, vec_id: long>>)" if join.own else "found"
    fields = "task long, kind int, row long, vec_id long, label long, q binary, found array<struct<score: long, vec_id: long>>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = _numbers(batch.column(2))
            d = distances(space.of_rows(space.vectors(batch.column(3))), pivots)
            bins = label % join.bins if join.own else label * 0
            slot = _numbers(batch.column(4))
            for g, wanted in groups.served(d, bins):
                if len(wanted):
                    part = batch.take(pa.array(wanted))
                    task = groups.first[g] + slot[wanted] % groups.slices[g]
                    yield pa.RecordBatch.from_arrays([pa.array(task), *part.columns[:4]], ["task", "row", "vec_id", "label", "q"])

    slot = F.pmod(F.xxhash64("row"), F.lit(1 << 31))
    candidates = rows.select("row", "vec_id", "label", "q", slot.alias("slot")).mapInArrow(deal, "task long, row long, vec_id long, label long, q binary")
    table = spark.createDataFrame([(g, int(f), int(s)) for g, (f, s) in enumerate(zip(groups.first, groups.slices))], "group long, first long, slices long")
    everywhere = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slices") - 1))
    asking = anchors.join(F.broadcast(table), "group").select(everywhere.alias("task"), F.lit(0).alias("kind"), "row", "vec_id", "label", "q", F.expr(found).alias("found"))
    offered = candidates.select("task", F.lit(1).alias("kind"), "row", "vec_id", "label", "q", F.expr("cast(null as array<struct<score: long, vec_id: long>>)").alias("found"))
    n = int(groups.slices.sum())
    dealt = asking.unionByName(offered).repartitionById(max(1, min(n, 8 * shuffle_partitions(spark))), F.col("task").cast("int")).sortWithinPartitions("task", "kind")

    def answer(held: Anchors, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        hits = [(int(held.row[a]), int(ids[a]), n, *((h["vec_id"], h["score"]) if h else (None, None)), int(s), int(i), int(r)) for k, (a, n, h) in enumerate(held.searches) for s, i, r in zip(*held.held[k])]
        if hits:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits)], ["row", "anchor_id", "search", "positive_id", "positive_score", "score", "vec_id", "hit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors of a task come before its rows, which are looked at block by block."""
        now, asked, held, ids = None, [], None, np.zeros(0, np.int64)
        for batch in batches:
            task, kind = _numbers(batch.column(0)), _numbers(batch.column(1))
            edges = np.flatnonzero((np.diff(task) != 0) | (np.diff(kind) != 0)) + 1
            for at, stop in zip([0, *edges], [*edges, len(task)]):
                if stop > at and task[at] != now:
                    if held is not None:
                        yield from answer(held, ids)
                    now, asked, held = task[at], [], None
                part = batch.slice(at, stop - at)
                if stop > at and kind[at] == 0:
                    asked.append(part)
                    continue
                if held is None and asked:
                    table = pa.Table.from_batches(asked)
                    held, ids = Anchors(table, space, join), _numbers(table.column("vec_id"))
                for k in range(0, part.num_rows if held is not None else 0, join.block):
                    block = part.slice(k, join.block)
                    held.look(space.vectors(block.column(5)), *(_numbers(block.column(c)) for c in (3, 4, 2)))
        if held is not None:
            yield from answer(held, ids)

    hits = dealt.mapInArrow(run, ", ".join(f"{c} long" for c in ("row", "anchor_id", "search", "positive_id", "positive_score", "score", "vec_id", "hit")))
    rank = F.row_number().over(Window.partitionBy("row", "search").orderBy(F.desc("score"), "vec_id", "hit"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= join.keep)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, relabel: int = 7, classes: int = 10, sample: int = 4_096, group_rows: int = 128, slice_rows: int = 1 << 18) -> DataFrame:
    """For each anchor (vec_id divisible by `every`) and each of its `positives` best rows of its label, the first `negatives` rows of
    other labels that score between `least` and `most` percent of the positive.

    vectors: (vec_id, embedding, label, ...); other columns are ignored.  Components become floor(scale * x); a row's score is its inner
    product with the anchor, in whole numbers; higher scores come first, ties by smaller vec_id.  Where vec_id is divisible by `relabel`,
    label first becomes (label + 1) % classes.  Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Two searches, each a join: anchors are put in groups by their nearest pivot (and label bin), rows known to every task (`sample`, a
    bound on what travels, not on what is searched) bound how far a group must look, and a row goes to the groups that it might serve.  Every
    answer is exact.  A group has about `group_rows` anchors, and more only beyond 262,144 anchors; its rows are dealt in slices, so that no
    group is one task's, and are looked at block by block.

    Rows with a null label, vector or vec_id, a null or non-finite component, another number of components than most have, or integer
    vectors of squared length 2^53 or more (whose scores might not be exact) take no part.  Rows that repeat a vec_id count each on its own,
    as anchors too; an anchor's own row is never its positive.  Positives with scores of 0 or less admit scores of 0 alone, or none.
    Equal vectors of any number are ties.  Without anchors, positives or negatives the result is empty.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows, dim = usable(vectors, scale, relabel, classes)
    longest = rows.agg(F.max("norm")).first()[0] if dim else None
    if longest is None:
        return empty
    space = Space(dim, float(longest), None)
    rows = _packed(rows, space)
    total = rows.count()
    drawn = min(1.0, min(sample, max(256, (1 << 22) // dim)) / total)
    space.known = rows.where(F.pmod(F.xxhash64(F.lit(5), "row"), 1_000_003) <= int(drawn * 1_000_003)).select("row", "vec_id", "label", "q").toArrow()
    asking = rows.where(F.col("vec_id") % every == 0)
    due = asking.count()
    if not due:
        return empty
    own = Join(True, positives, least, most, group_rows, slice_rows)
    first = _searched(rows, asking.select("row", "vec_id", "label", "q"), space, own, total, due)
    found = first.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))), lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"))).alias("found"))
    asking = scratch(asking.join(found, "row").select("row", "vec_id", "label", "q", "found"), "positives")
    second = _searched(rows, asking, space, Join(False, negatives, least, most, group_rows, slice_rows), total, due)
    return second.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
