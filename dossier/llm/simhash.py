"""SimHash near-duplicates by a segment-popcount embedding, a grid join under Manhattan distance, and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .components import connected_components

#: Half a fingerprint is 16 segments of 2 bits; a segment's popcount is 0, 1 or 2.
SEGMENTS = 16
CELLS = 2 * 3**SEGMENTS
POWERS = 3 ** np.arange(SEGMENTS, dtype=np.int64)
#: Groups of up to so many fingerprints are compared pairwise, larger ones by a search that skips what it has linked.
SMALL_GROUP = 16


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, repeats included; of the whole sequence if it is shorter."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist())], dtype="<u8")


def _majority(h: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        counts += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def simhash(text: str | None, shingle: int = 4, view: int = 0) -> int:
    """The 64-bit SimHash of one text. Views other than 0 mix the hashes anew, which makes independent fingerprints."""
    return _majority(_view(_shingle_hashes(text, shingle), view))


def _view(h: np.ndarray, view: int) -> np.ndarray:
    if not view:
        return h
    h = (h ^ np.uint64(view)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def fingerprints(docs: DataFrame, shingle: int = 4, views: int = 1) -> DataFrame:
    """(doc_id, fps): SimHashes of every whole text, one a view, as signed longs. Null and empty texts have fingerprints 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = (_shingle_hashes(t, shingle) for t in batch.column(1).to_pylist())
            fps = np.array([[_majority(_view(h, k)) for k in range(views)] for h in hashes], np.uint64).reshape(-1, views).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(fps), pa.list_(pa.int64()))], ["doc_id", "fps"])

    plain = docs.select("doc_id", "text")
    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, fps array<long>")


def grid_cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, cell) for every grid cell within Manhattan distance 1 of each half's popcount vector.

    Fingerprints at 4 differing bits or fewer differ by 2 at most in one half, and the Manhattan distance of popcount vectors
    is at most the number of differing bits; two integer vectors at distance 2 or less share a cell within 1 of both.
    """
    where, cells = [], []
    fps = fps.view(np.uint64)
    index = np.arange(len(fps))
    for half in range(2):
        part = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        digits = np.stack([np.bitwise_count((part >> np.uint64(2 * j)) & np.uint64(3)).astype(np.int64) for j in range(SEGMENTS)])
        code = (digits * POWERS[:, None]).sum(axis=0) + half * 3**SEGMENTS
        where.append(index)
        cells.append(code)
        for step, edge in ((1, 2), (-1, 0)):
            for j in range(SEGMENTS):
                can = np.flatnonzero(digits[j] != edge)
                where.append(can)
                cells.append(code[can] + step * POWERS[j])
    return np.concatenate(where), np.concatenate(cells)


def _links_of_group(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within `most` bits in one cell: each fingerprint to the one that reached it."""
    left, a, b = fps.copy(), [], []
    queue: list[np.ndarray] = []
    while len(left) or queue:
        if not queue:
            queue.append(left[0])
            left = left[1:]
        seed = queue.pop()
        near = np.bitwise_count(left ^ seed) <= most
        if near.any():
            found = left[near]
            left = left[~near]
            a.append(np.full(len(found), seed))
            b.append(found)
            queue.extend(found)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(cells: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified links of whole groups, sorted by cell."""
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sizes = np.diff(np.append(starts, len(cells)))
    a, b, views = [], [], []
    small = np.repeat((sizes > 1) & (sizes <= SMALL_GROUP), sizes)
    own, keys = fps[small], cells[small]
    for d in range(1, SMALL_GROUP):
        if len(own) <= d:
            break
        hit = np.flatnonzero((keys[d:] == keys[:-d]) & (np.bitwise_count(own[d:] ^ own[:-d]) <= most))
        a.append(own[hit])
        b.append(own[hit + d])
        views.append(keys[hit] // CELLS)
    for g in np.flatnonzero(sizes > SMALL_GROUP):
        x, y = _links_of_group(fps[starts[g] : starts[g] + sizes[g]], most)
        a.append(x)
        b.append(y)
        views.append(np.full(len(x), cells[starts[g]] // CELLS))
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(views), np.concatenate(a), np.concatenate(b)


def near_links(distinct: DataFrame, most: int = 4) -> DataFrame:
    """Links (view, a, b) between distinct fingerprints, enough to connect all pairs of a view within `most` (4 or fewer) differing bits.

    distinct: (view, fp), no row twice.  Every fingerprint goes to about 50 grid cells; each cell's fingerprints meet in one
    task, which streams over cells sorted by Spark and holds one cell at a time, 8 bytes a fingerprint.  Each cell gives a
    spanning set of verified links, so their number is linear in the cells' sizes.
    """
    if not 0 <= most <= 4:
        raise ValueError("the grid holds for 4 differing bits or fewer")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k in range(0, len(fps), 4096):
                part = fps[k : k + 4096]
                where, cell = grid_cells(part)
                # Each view has cells of its own.
                cell = cell + views[k : k + 4096][where].astype(np.int64) * CELLS
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part[where])], ["cell", "fp"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def emit(c: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            views, a, b = _links(c, f, most)
            rows = np.unique(np.stack([views.astype(np.uint64), np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k]).view(np.int64)) for k in range(3)], ["view", "a", "b"])

        for batch in batches:
            c = np.concatenate([held_c, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = int(np.searchsorted(c, c[-1])) if len(c) else 0
            if whole > 50_000:
                yield emit(c[:whole], f[:whole])
                c, f = c[whole:], f[whole:]
            held_c, held_f = c, f
        if len(held_c):
            yield emit(held_c, held_f)

    dealt = distinct.select(F.col("view").cast("long"), "fp").mapInArrow(cells, "cell long, fp long").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(links, "view long, a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4, views: int = 1) -> DataFrame:
    """Group documents whose SimHash fingerprints are linked by chains of `most` or fewer differing bits.

    docs: (doc_id, text, ...); other columns are ignored.  Texts are lower-cased (A-Z), split at ASCII white space and cut
    into shingles of `shingle` words, repeats included; a shorter text is one shingle, a text without words (or null) has
    fingerprint 0 and is linked like any other.  Equal fingerprints are one node, so groups of copies cost one entry.
    With several `views`, documents linked in any view are one group: each view finds again what noise parts in another.
    Returns (doc_id, fp, component_id), a row for each input row; fp is that of the first view, component_id the least doc_id
    of the group (nulls are ignored unless all are null).  An empty table gives an empty result.
    """
    found = scratch(fingerprints(docs, shingle, views), "fingerprints")
    rows = found.select("doc_id", F.posexplode("fps").alias("view", "fp"))
    least = scratch(rows.groupBy("view", "fp").agg(F.min("doc_id").alias("least")), "least")
    end = lambda c: least.select(F.col("view").cast("long").alias("view"), F.col("fp").alias(c), F.col("least").alias(f"least_{c}"))
    # Documents stand for their fingerprints: links between different ones, and each document with the first of its own.
    linked = near_links(least.select("view", "fp"), most).join(end("a"), ["view", "a"]).join(end("b"), ["view", "b"]).select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    equal = rows.join(least, ["view", "fp"]).where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    components = connected_components(linked.union(equal))
    first = found.select("doc_id", F.col("fps")[0].alias("fp")).join(least.where("view = 0").select("fp", "least"), "fp")
    return first.join(components, F.col("least") == F.col("node"), "left").select("doc_id", "fp", F.coalesce("component", "least").alias("component_id"))


# ---- documents of a given similarity: sketches find candidates, shingle sets decide

#: A sketch is 12 segments of 2 bits, taken from the views' fingerprints one after the other.
SKETCH_SEGMENTS = 12
SKETCH_CELLS = 3**SKETCH_SEGMENTS
#: Candidates differ in so many of the first two views' 128 bits at most: at similarity .8 19 or 20 do on average, of unlike texts 64.
LOOSE = 36
#: Cells of up to so many sketches are compared pairwise.
MANY = 256
#: Links that a task joins before it hands them on.
HELD_LINKS = 1_000_000


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(_shingle_hashes(text, shingle))


def sketch_cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of fps, cell) for every cell within Manhattan distance 1 of each sketch's popcount vector. fps: (rows, views)."""
    where, cells = [], []
    index = np.arange(len(fps))
    for k in range(fps.shape[1] * 32 // SKETCH_SEGMENTS):
        at = range(k * SKETCH_SEGMENTS, (k + 1) * SKETCH_SEGMENTS)
        digits = np.stack([np.bitwise_count((fps[:, g // 32] >> np.uint64(2 * (g % 32))) & np.uint64(3)).astype(np.int64) for g in at])
        code = (digits * POWERS[:SKETCH_SEGMENTS, None]).sum(axis=0) + k * SKETCH_CELLS
        where.append(index)
        cells.append(code)
        for step, edge in ((1, 2), (-1, 0)):
            for j in range(SKETCH_SEGMENTS):
                can = np.flatnonzero(digits[j] != edge)
                where.append(can)
                cells.append(code[can] + step * POWERS[j])
    return np.concatenate(where), np.concatenate(cells)


def _join_labels(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give x[k] and y[k] and all they lead to one label, the least; label[k] is k before."""
    while len(x):
        # Labels are roots here: the later root goes below the earlier one.
        np.minimum.at(label, np.maximum(label[x], label[y]), np.minimum(label[x], label[y]))
        while not np.array_equal(label, label[label]):
            label[:] = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what the links (a, b) connect: each node to the least of its component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    _join_labels(label, place[: len(a)], place[len(a) :])
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def _loosely_linked(cells: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices) of each sketch in whole cells, sorted by cell, to the first one that pairs within LOOSE bits lead to; (a, b) are the 128 bits."""
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sizes = np.diff(np.append(starts, len(cells)))
    label = np.arange(len(cells))
    own = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= MANY), sizes))
    left, right = [], []
    last = np.repeat(starts + sizes, sizes)
    for d in range(1, MANY):
        own = own[own + d < last[own]]
        if not len(own):
            break
        hit = own[np.bitwise_count(a[own] ^ a[own + d]).astype(np.int16) + np.bitwise_count(b[own] ^ b[own + d]) <= LOOSE]
        left.append(hit)
        right.append(hit + d)
    if left:
        _join_labels(label, np.concatenate(left), np.concatenate(right))
    for g in np.flatnonzero(sizes > MANY):
        rest = np.arange(starts[g], starts[g] + sizes[g])
        queue: list[int] = []
        while len(rest) or queue:
            if not queue:
                root = int(rest[0])
                queue.append(root)
                rest = rest[1:]
            seed = queue.pop()
            near = np.bitwise_count(a[rest] ^ a[seed]).astype(np.int16) + np.bitwise_count(b[rest] ^ b[seed]) <= LOOSE
            found, rest = rest[near], rest[~near]
            label[found] = root
            queue.extend(found.tolist())
    linked = np.flatnonzero(label != np.arange(len(label)))
    return linked, label[linked]


def alike_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect all pairs of sets whose Jaccard similarity is `least` or more; exact.

    Two such sets share one of their first n - ceil(least n) + 1 elements in any common order, here the rarest first.  What a
    set has reached is not searched for again, so a group of copies costs a comparison each.
    """
    sizes = np.array([len(s) for s in sets])
    _, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((code, counts[code], owner))
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    first = np.where(sizes > 0, sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1, 0)
    place = np.arange(len(owner)) - begin[owner]
    ahead = order[place < first[owner]]  # `order` keeps the owners' runs in place
    by_code = ahead[np.argsort(code[ahead], kind="stable")]
    keys, owners = code[by_code], owner[by_code]
    todo = np.ones(len(sets), bool)
    links = []
    for start in range(len(sets)):
        if not todo[start]:
            continue
        todo[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            mine = code[order[begin[i] : begin[i] + first[i]]]
            lo, hi = np.searchsorted(keys, mine), np.searchsorted(keys, mine, side="right")
            met = np.unique(np.concatenate([owners[x:y] for x, y in zip(lo, hi)])) if len(mine) else np.zeros(0, np.int64)
            met = met[todo[met]]
            met = met[np.minimum(sizes[met], sizes[i]) >= least * np.maximum(sizes[met], sizes[i]) - 1e-9]
            for j in met.tolist():
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= least * (sizes[i] + sizes[j] - both) - 1e-9:
                    todo[j] = False
                    links.append((i, j))
                    queue.append(j)
    return links


def similar_documents(docs: DataFrame, shingle: int = 5, least: float = 0.8, views: int = 6) -> DataFrame:
    """Group documents by chains of pairs whose sets of word shingles have a Jaccard similarity of `least` or more.

    docs: (doc_id, text, ...).  Candidates: SimHashes of the shingle sets, `views` times 64 bits, cut into sketches of 24 bits;
    pairs that share a grid cell of any sketch and differ in LOOSE or fewer of 128 bits.  Their components meet by group, where
    the shingle sets themselves decide each pair, so nothing below `least` is linked; a pair that no sketch brings together is
    missed.  Equal sets are one node; texts without words have equal sets.  A task holds one component's shingle sets.
    Returns (doc_id, component_id), a row for each input row; component_id is the least doc_id of the group.
    """
    plain = docs.select("doc_id", "text")
    kind = dict(plain.dtypes)["doc_id"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, fps = [], []
            for t in batch.column(1).to_pylist():
                h = shingle_set(t, shingle)
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                fps.append([_majority(_view(h, k)) for k in range(views)])
            found = np.array(fps, np.uint64).reshape(-1, views).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(list(found), pa.list_(pa.int64()))], ["doc_id", "key", "fps"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array(batch.column(0).to_pylist(), np.int64).reshape(-1, views).view(np.uint64)
            for k in range(0, len(fps), 2048):
                part = fps[k : k + 2048]
                where, cell = sketch_cells(part)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(part[where, 0].view(np.int64)), pa.array(part[where, 1].view(np.int64))], ["cell", "a", "b"])

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]

        kept: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]

        def add(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Links of many cells are joined before they go out, so that a group of near copies costs a link each, not one a cell."""
            x, y = _loosely_linked(c, a, b)
            kept[:] = [np.concatenate([kept[0], a[x]]), np.concatenate([kept[1], a[y]])]
            if len(kept[0]) > HELD_LINKS:
                kept[:] = spanning_links(*kept)
                if len(kept[0]) > HELD_LINKS // 2:
                    yield out()

        def out() -> pa.RecordBatch:
            columns = [pa.array(x.view(np.int64)) for x in spanning_links(*kept)]
            kept[:] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
            return pa.RecordBatch.from_arrays(columns, ["a", "b"])

        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            new = [np.concatenate([h, n if k == 0 else n.view(np.uint64)]) for k, (h, n) in enumerate(zip(held, new))]
            whole = int(np.searchsorted(new[0], new[0][-1])) if len(new[0]) else 0
            if whole > 50_000:
                yield from add(*[n[:whole] for n in new])
                new = [n[whole:] for n in new]
            held = new
        if len(held[0]):
            yield from add(*held)
        if len(kept[0]):
            yield out()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []

        def emit(id_type: pa.DataType) -> pa.RecordBatch:
            links = alike_links(sets, least) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in links], id_type), pa.array([ids[j] for _, j in links], id_type)], ["a", "b"])

        id_type = None
        for batch in batches:
            id_type = batch.column(1).type
            for g, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group and sets:
                    yield emit(id_type)
                    ids, sets = [], []
                group = g
                ids.append(i)
                sets.append(shingle_set(t, shingle))
        if sets:
            yield emit(id_type)

    found = scratch(plain.mapInArrow(sketch, f"doc_id {kind}, key binary, fps array<long>"), "sketches")
    sets = scratch(found.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("fps").alias("fps")), "sets")
    dealt = sets.select("fps").mapInArrow(cells, "cell int, a long, b long").repartition("cell").sortWithinPartitions("cell")
    near = connected_components(dealt.mapInArrow(loose, "a long, b long").distinct())
    fp = sets.select("least", F.col("fps")[0].alias("fp"))
    grouped = scratch(fp.join(near, F.col("fp") == F.col("node"), "left").select("least", F.coalesce("component", "fp").alias("group")), "groups")
    several = grouped.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    members = grouped.join(several, "group").join(plain, F.col("least") == F.col("doc_id")).select("group", "doc_id", "text")
    alike = members.repartition("group").sortWithinPartitions("group").mapInArrow(decide, f"a {kind}, b {kind}")
    equal = found.join(sets.select("key", "least"), "key").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    components = connected_components(alike.union(equal))
    return plain.select("doc_id").join(components, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
