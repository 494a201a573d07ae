"""From banded sketches to groups: candidates, verification, connected components.

A key is the number of a text. In a bucket every member is first linked with one key only, its pivot: the smallest key of the bucket in the same
run of rows, and these with the smallest of all. So a bucket that many rows share is thinned before anything is shuffled, and
n copies cost n links, not n squared. Of each key the pivot that shares most buckets with it is verified first. Members
that prove alike are joined through it, so their other pairs are settled. Where a bucket
then still holds keys of several components, further rounds compare the sketches of all its pairs
across components and verify the most promising ones of each key, more in each round, until no pair above the floor
that joins two components is left unverified. Components are joined by verified pairs only. So no candidate is dropped unseen.
A bucket of many such members is cut into blocks, and each pair of blocks is a group of its own: no task holds more than two blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, mix, small, stored, sweep

#: Up to so many edges, one task's union-find takes them all; beyond, star contraction does the same in rounds.
LOCAL_EDGES = 2_000_000
#: Members of a block of a bucket, about.
BLOCK = 2_000
#: The links of buckets are found in so many passes, each over its share of the buckets: what a pass shuffles is deleted before the next.
PASSES = 4
#: Pairs of sketches that are estimated at once, about; a key's pairs in a group are.
ESTIMATED = 8_192
#: A pivot with more pairs than that is verified in several tasks, about so many pairs in each.
SHARE = 500
#: How many of a key's pairs in a group are verified in the rounds after the first; None: all.
WIDTHS = (1, 8, 64, None)


def bands(sketch: np.ndarray, rows: int | np.ndarray) -> np.ndarray:
    """A hash of each run of so many columns, or of the columns in each of these rows (and of the run's place)."""
    if isinstance(rows, np.ndarray):
        sketch, rows = sketch[:, rows.ravel()], rows.shape[1]
    n = sketch.shape[1] // rows
    acc = np.broadcast_to(mix(np.arange(1, n + 1, dtype=np.uint64)), (len(sketch), n)).copy()
    for k in range(rows):
        acc = mix(acc * np.uint64(0x100000001B3) + sketch[:, k : n * rows : rows].astype(np.uint64))
    return acc


def _sketches_of(column: pa.Array, dtype, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, size)


def _passing(pairs: DataFrame, sketches: DataFrame, dtype, size: int, estimate: Callable, floor: float) -> DataFrame:
    """The pairs (a, b), a stored table, whose sketches are alike enough; a stored table."""
    s, left = sketches.select("key", "sketch"), stored(pairs.select("a").distinct())
    # The first join leaves the sketches where they are while the pairs are few.
    both = s.withColumnsRenamed({"key": "b", "sketch": "sb"}).join(small(pairs), "b").join(s.withColumnsRenamed({"key": "a", "sketch": "sa"}).join(small(left), "a", "left_semi").hint("merge"), "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_sketches_of(batch.column(i), dtype, size) for i in (2, 3))
            keep = pa.array(estimate(x, y) >= floor)
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    out = stored(map_batches(both, run, _PAIR))
    discard(left)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    """key of all that are in pairs (a, b); a stored table."""
    return stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())


def _unrefused(pairs: DataFrame, contents: DataFrame, profile: int, possible: Callable) -> DataFrame:
    """Of pairs (a, b), a stored table, those whose profiles (key and profile in contents, a stored table) don't rule out that they are alike; a stored table."""
    # A key may have its profile several times.
    passing = _passing(pairs, contents.select("key", F.col("profile").alias("sketch")), np.uint8, profile, possible, 1)
    out = stored(passing.distinct())
    discard(passing)
    return out


def _verified(pairs: DataFrame, content: Callable[[DataFrame], DataFrame], exact: Callable, many: bool = False) -> DataFrame:
    """pairs (a, b), a stored table, with score, by their contents; a stored table."""
    keys = _ends(pairs)
    n = F.count("*").over(Window.partitionBy("a"))
    shares = stored(pairs.select("a", "b", n.alias("n")).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / SHARE)).cast("int").alias("share")))
    # Contents are wide: each is sent once to where its pair is verified, or a pivot's once for all of its pairs there (b is null).
    places = shares.select(F.col("b").alias("key"), "a", "share", "b").unionByName(shares.select(F.col("a").alias("key"), "a", "share", F.lit(None).cast("bigint").alias("b")).distinct())
    places = stored(places)
    # While the places are few, contents go there straight from where they are made. Contents are never broadcast.
    sent = content(keys).join(small(places), "key").select("a", "share", "b", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, last = (None, None), None
        for batch in batches:
            pairs, x, y = [], [], []
            for *place, b, c in zip(*(column.to_pylist() for column in batch.columns)):
                if b is None:
                    pivot = place, c
                elif pivot[0] == place and last != (place, b):
                    # A content may come several times.
                    last = place, b
                    pairs.append((place[0], b))
                    x.append(pivot[1])
                    y.append(c)
            score = exact(x, y) if many else [exact(*p) for p in zip(x, y)]
            yield pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array(score, pa.float64())], names=["a", "b", "score"])

    out = stored(map_batches(sent.repartition("a", "share").sortWithinPartitions("a", "share", "b"), run, f"{_PAIR}, score double"))
    discard(keys, shares, places)
    return out


def _joining(sketch: np.ndarray, root: np.ndarray, estimate: Callable, floor: float, width: int | None, block: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group, of different components and blocks (where both are -1, of any): each key's best (width of them) from the floor on; the groups where some key has more.

    A group's rows follow one another, groups are numbered from 0.
    """
    size = np.bincount(group)
    start = np.cumsum(size) - size
    # Each pair across components has a member outside of the largest one.
    order = np.lexsort((root, group))
    begins = np.flatnonzero(np.append(True, (np.diff(group[order]) != 0) | (np.diff(root[order]) != 0)))
    largest = np.lexsort((-np.diff(np.append(begins, len(order))), group[order[begins]]))
    largest = largest[np.flatnonzero(np.append(True, np.diff(group[order[begins[largest]]]) != 0))]
    outside = np.flatnonzero(root != root[order[begins[largest]]][group])
    out, cut, done = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], np.cumsum(size[group[outside]])
    for at in np.split(outside, np.flatnonzero(np.diff(done // ESTIMATED)) + 1):
        n = size[group[at]]
        i, other = np.repeat(at, n), np.arange(n.sum()) + np.repeat(start[group[at]] - np.cumsum(n) + n, n)
        apart = np.flatnonzero((root[i] != root[other]) & ((block[i] != block[other]) | (block[i] < 0)))
        if not len(apart):
            continue
        i, other = i[apart], other[apart]
        score = estimate(sketch[i], sketch[other])
        some = np.flatnonzero(score >= floor)
        i, other, score = i[some], other[some], score[some]
        if width is not None and len(i):
            best = np.lexsort((-score, i))
            i, other = i[best], other[best]
            begins = np.append(True, np.diff(i) != 0)
            take = np.arange(len(i)) - np.flatnonzero(begins)[np.cumsum(begins) - 1] < width
            cut.append(group[i[~take]])
            i, other = i[take], other[take]
        out.append(np.stack((i, other), axis=1))
    return np.concatenate(out), np.unique(np.concatenate(cut))


def _next_round(star: DataFrame, roots: DataFrame, sketches: DataFrame, dtype, size: int, estimate: Callable, floor: float, width: int | None, most: int) -> DataFrame:
    """Pairs (a, b), a < b, that are promising in a bucket, of members that roots (key, root) doesn't join; a row with band only for each bucket that has more. roots and the result are stored tables."""
    r = roots.select("key", "root")
    links = star.join(small(r), "key", "left").join(small(r.withColumnsRenamed({"key": "pivot", "root": "top"})), "pivot", "left").select("band", "key", "pivot", F.coalesce("root", "key").alias("root"), F.coalesce("top", "pivot").alias("top"))
    links = stored(links)
    open_buckets = stored(links.where("root <> top").select("band").distinct())
    ends = F.explode(F.array(F.struct("key", "root"), F.struct(F.col("pivot").alias("key"), F.col("top").alias("root")))).alias("m")
    members = stored(links.join(small(open_buckets), "band", "left_semi").select("band", ends).select("band", "m.*").distinct())
    discard(links, open_buckets)
    # Of a bucket with n members the blocks; a member goes to each pair of blocks that has its own.
    blocks = stored(members.groupBy("band").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = members.join(small(blocks), "band").select("*", own).select("*", other).select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "root")
    spread = stored(spread)
    discard(members, blocks)
    # The sketches stay where they are while those that are asked for are few.
    shown = sketches.select("key", "sketch").join(small(spread), "key").select("band", "low", "high", "block", "key", "root", "sketch")

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of whole groups."""
        band, low, high, block, key, root = (np.concatenate([t.column(i).to_numpy(zero_copy_only=False) for t in held]) for i in range(6))
        group = np.cumsum(np.append(False, (np.diff(band) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)))
        pairs, cut = _joining(np.concatenate([_sketches_of(t.column(6), dtype, size) for t in held]), root, estimate, floor, width, np.where(low != high, block, -1), group)
        ends, cut = np.sort(key[pairs], axis=1), band[np.searchsorted(group, cut)]
        yield pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.nulls(len(ends), pa.int64())], names=["a", "b", "band"])
        yield pa.record_batch([pa.nulls(len(cut), pa.int64()), pa.nulls(len(cut), pa.int64()), pa.array(cut)], names=["a", "b", "band"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            # What a group's end in the batch, or its begin, closes goes; the batch's last group may go on in the next one.
            cuts = np.flatnonzero(np.append(last is not None and (where[0] != last).any(), (where[1:] != where[:-1]).any(axis=1)))
            at = int(cuts[-1]) if len(cuts) else 0
            if len(cuts):
                yield from flush([*held, *([batch.slice(0, at)] if at else [])])
                held = []
            last = where[-1]
            held.append(batch.slice(at))
        if held:
            yield from flush(held)

    place = ["band", "low", "high"]
    out = stored(map_batches(shown.repartition(*place).sortWithinPartitions(*place, "key"), run, f"{_PAIR}, band bigint").distinct())
    discard(spread)
    return out


_PAIR = "a bigint, b bigint"


def _links(sketches: DataFrame, dtype, size: int, rows: int | np.ndarray | Callable, near: bool, own: int) -> DataFrame:
    """Of the buckets of pass `own`: band, key, pivot of members of buckets within a run of rows. near: those that have a smaller key in the run, which is their pivot; else those that have none.

    The sketch, or the bands or what is banded where these are stored, are in the second column.
    """
    banded = "bands" in sketches.columns
    source = next(c for c in ("bands", "whole", "sketch") if c in sketches.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            if banded:
                band = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                keys = np.repeat(key, batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            elif callable(rows):
                band, row = rows(batch.column(1))
                keys = key[row]
            else:
                found = bands(_sketches_of(batch.column(1), dtype, size), rows).astype(np.int64)
                band, keys = found.ravel(), np.repeat(key, found.shape[1])
            mine = band % PASSES == own
            band, keys = band[mine], keys[mine]
            if not len(band):
                continue
            order = np.lexsort((keys, band))
            band, keys = band[order], keys[order]
            begins = np.append(True, band[1:] != band[:-1])
            first = keys[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
            # A key may have a band twice.
            take = np.flatnonzero(first != keys if near else begins)
            yield pa.record_batch([pa.array(band[take]), pa.array(keys[take]), pa.array(first[take])], names=["band", "key", "pivot"])

    return map_batches(sketches.select("key", source), run, "band bigint, key bigint, pivot bigint")


def _star(sketches: DataFrame, dtype, size: int, rows: int | np.ndarray | Callable) -> DataFrame:
    """band, key, pivot: the links of every bucket with two members or more, which they connect; a stored table."""
    parts = []
    for own in range(PASSES):
        far = _links(sketches, dtype, size, rows, False, own).select("band", "key")
        far = far.withColumn("pivot", F.min("key").over(Window.partitionBy("band"))).where("key <> pivot")
        parts.append(_links(sketches, dtype, size, rows, True, own).unionByName(far))
    return stored(*parts)


def verified_edges(sketches: DataFrame, content: Callable[[DataFrame], DataFrame], dtype, size: int, estimate: Callable, floor: float, exact: Callable, accept: Callable, rows: int | np.ndarray | Callable = 1, many: bool = False, fine: int = 0, block: int = BLOCK, profile: int = 0, possible: Callable | None = None) -> DataFrame:
    """a, b, score: pairs that join all keys whose contents are alike, directly or through others.

    sketches: key (a number), sketch and perhaps bands or whole, a stored table, one row a key; without bands runs of so many numbers of the sketch, or the numbers at these places (rows), are banded;
    or rows(column) gives the bands of the column whole, and the place in it of each. content(keys): key, content of these keys, all of them, equal ones of a key perhaps several times. estimate(rows, rows) of
    sketches and exact(content, content), or exact(contents, contents) where many is set, measure; accept(score column) says which scores will do.
    Where sketches have a column fine, of so many numbers, pairs are estimated by it once more before their contents move. Where content has a column profile, of so many bytes,
    possible(profiles, profiles) is False for pairs that can't be alike, whose contents needn't move in the rounds after the first. An empty table gives an empty one.
    """
    sweep(sketches.sparkSession)
    star = _star(sketches, dtype, size, rows)
    shared = star.groupBy("pivot", "key").agg(F.count("*").alias("n"))
    first = stored(shared.groupBy("key").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("pivot")).select(F.col("pivot").alias("a"), F.col("key").alias("b")))
    passing = _passing(first, sketches, dtype, size, estimate, floor)
    closer = (lambda pairs: _passing(pairs, sketches.select("key", F.col("fine").alias("sketch")), dtype, fine, estimate, floor)) if fine else lambda pairs: pairs

    def settled(pairs: DataFrame) -> DataFrame:
        if not profile:
            return _verified(pairs, content, exact, many)
        # The rounds ask for many pairs of few keys.
        keys = _ends(pairs)
        made = stored(content(keys))
        left = _unrefused(pairs, made, profile, possible)
        out = _verified(left, lambda _: made.select("key", "content"), exact, many)
        discard(keys, made, left)
        return out

    verified = [_verified(closer(passing), content, exact, many)]
    discard(first)
    tried = [passing]
    found = lambda: functools.reduce(DataFrame.unionByName, verified)
    for width in WIDTHS:
        roots = stored(components(found().where(accept(F.col("score"))).select("a", "b")))
        more = _next_round(star, roots, sketches, dtype, size, estimate, floor, width, block)
        new = stored(more.where("a IS NOT NULL").select("a", "b").join(functools.reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti"))
        tried.append(new)
        if not new.isEmpty():
            verified.append(settled(closer(new)))
        left = stored(more.where("band IS NOT NULL").select("band").distinct())
        discard(roots, more)
        if left.isEmpty():
            break
        # Elsewhere all pairs above the floor across components are verified.
        before, star = star, stored(star.join(small(left), "band", "left_semi"))
        discard(before)
    discard(star, *tried)
    return found().where(accept(F.col("score")))


def group_keys(sketches: DataFrame, content: Callable[[DataFrame], DataFrame], dtype, size: int, estimate: Callable, floor: float, exact: Callable, accept: Callable, rows: int | np.ndarray | Callable = 1, many: bool = False, fine: int = 0, profile: int = 0, possible: Callable | None = None) -> DataFrame:
    """key, root (the group's smallest key) of the keys that are in a group; see verified_edges()."""
    return components(verified_edges(sketches, content, dtype, size, estimate, floor, exact, accept, rows, many, fine, profile=profile, possible=possible).select("a", "b"))


class UnionFind:
    """Disjoint sets of whatever sorts; each is known by its smallest member."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        path = []
        while (up := self.parent.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            self.parent[y] = x
        return x

    def union(self, x, y) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, root) of the partition's own edges, roots left out."""
    sets = UnionFind()
    for batch in batches:
        for x, y in zip(*(c.to_pylist() for c in batch.columns)):
            sets.union(x, y)
    rows = [(x, sets.find(x)) for x in list(sets.parent)]
    rows = [r for r in rows if r[0] != r[1]]
    for i in range(0, len(rows), 50_000):
        yield pa.record_batch([pa.array([r[k] for r in rows[i : i + 50_000]], pa.int64()) for k in (0, 1)], names=["a", "b"])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """key, root (smallest key of its connected component), for edges (a, b) of numbers in any order; loops and repeats do no harm."""
    edges = stored(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b"))
    tree = stored(map_batches(edges.coalesce(1), _forest, _PAIR)) if edges.count() <= local_edges else _contract(edges)
    return tree.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(tree.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct())


def _contract(edges: DataFrame) -> DataFrame:
    """Alternating large-star and small-star rounds until nothing changes: (a, b) with b the root of a."""
    while True:
        # Large star: larger neighbours of a node go to the least of its neighbourhood.
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = stored(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # Small star: a node and its smaller neighbours go to the least of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = stored(down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        if edges.select("a", "b").exceptAll(small).isEmpty() and small.exceptAll(edges.select("a", "b")).isEmpty():
            return small
        edges = small
