"""SimHash near-duplicate detection with a sharded vantage-point tree.

Fingerprints of equal value collapse first, so a group of exact copies is one
point however large it is.  A vantage-point tree over a bounded sample of the
distinct fingerprints deals all of them into shards: each fingerprint has one
home shard, and it visits the further shards that the triangle inequality
cannot exclude.  A shard that is still too large gets a tree of its own and is
dealt anew, so the size of a shard does not grow with the corpus.  A shard
searches itself with a local vantage-point recursion, against its visitors in
parts of bounded size, and reports a spanning forest, not its pairs; stars of
that forest are merged into components by alternating large-star and small-star
steps.

Defined cases: a null text is an empty one; a text without words has
fingerprint zero and links like any other; repeated rows keep one row each; a
row without an id joins no component by itself and reports the component of its
fingerprint, or null if only rows without ids have a fingerprint within reach;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm.common import discard, keyed_text, materialise, prepare

#: Shingle hashes whose bits are counted at once.
_CHUNK = 1 << 15
#: Fingerprints of the sample that the shard tree is built from.
TREE_SAMPLE = 8192
#: Distinct fingerprints aimed at in a shard, and the most shards that one tree makes.
SHARD_ROWS = 16384
MAX_SHARDS = 512
#: Shards at home to more are dealt anew, so many times at most; after that they are searched as they are.
SPLIT_ROWS = 4 * SHARD_ROWS
DEALS = 12
#: Rows in one task when a shard is dealt anew, and visitors in one task when it is searched.
TASK_ROWS = 1 << 20
#: Pairs compared in one block of the local search.
_BLOCK = 1 << 20


def fingerprint_of(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one UTF-8 text."""
    words = raw.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint_of(x or b"", shingle) for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    prepare(docs.sparkSession)
    kept = keyed_text(docs, id_col, text_col)
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, fp long")


# --- the tree ---------------------------------------------------------------


class Bits:
    """64-bit fingerprints, held as signed longs, in Hamming distance."""

    def points(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return np.asarray(column.to_numpy(), dtype=np.int64).view(np.uint64)

    def vantages(self, points: np.ndarray) -> np.ndarray:
        return points[:: max(1, len(points) // 8)][:8]

    def distance(self, points: np.ndarray, vantage: np.uint64) -> np.ndarray:
        return np.bitwise_count(points ^ vantage).astype(np.int16)

    def near(self, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of all pairs of ``a`` and ``b`` within ``radius``."""
        return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)


BITS = Bits()


def _split(points: np.ndarray, space=BITS, radius: int = 2) -> tuple | None:
    """The vantage point, among a few, whose distances spread most, and the median distance; none if it parts nothing."""
    best = None
    for v in space.vantages(points):
        d = space.distance(points, v)
        mu = np.sort(d)[len(d) // 2]
        if (d <= mu).all():
            mu = d[d < mu].max(initial=0)
        left = int((d <= mu).sum())
        # few points near the boundary and even halves make a good split
        score = abs(2 * left - len(d)) + int((np.abs(d - mu) <= radius).sum())
        if 0 < left < len(d) and (best is None or score < best[0]):
            best = (score, v, mu)
    return best and best[1:]


def build_tree(sample: np.ndarray, shards: int, space=BITS, radius: int = 2):
    """Nested (vantage, radius, inner, outer) nodes over ``sample``; a leaf is its shard's number."""
    count = iter(range(1 << 30))

    def grow(points: np.ndarray, leaves: int):
        cut = _split(points, space, radius) if leaves > 1 and len(points) > 1 else None
        if cut is None:
            return next(count)
        v, mu = cut
        inner = space.distance(points, v) <= mu
        return v, mu, grow(points[inner], leaves // 2), grow(points[~inner], leaves - leaves // 2)

    return grow(sample, shards)


def route(tree, points: np.ndarray, radius: int, home: np.ndarray | None = None, space=BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, homes, visitors): indexes of the points whose home the shard is, and of those that may have neighbours in it.

    A pair parted at a node is met once: the inner point visits the outer side.
    ``home`` tells which of ``points`` are at home in the tree already, by default all.
    """

    def walk(node, home, visit):
        if not len(home) and not len(visit):
            return
        if isinstance(node, int):
            yield node, home, visit
            return
        v, mu, inner, outer = node
        dh, dv = space.distance(points[home], v), space.distance(points[visit], v)
        yield from walk(inner, home[dh <= mu], visit[dv <= mu + radius])
        yield from walk(outer, home[dh > mu], np.concatenate([visit[dv > mu - radius], home[(dh <= mu) & (dh > mu - radius)]]))

    home = np.ones(len(points), dtype=bool) if home is None else home
    yield from walk(tree, np.flatnonzero(home), np.flatnonzero(~home))


def near_pairs(points: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int, space=BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``radius``, in blocks: within ``left``, or between ``left`` and ``right``."""
    stack = [(left, right)]
    while stack:
        a, b = stack.pop()
        size = len(a) * len(a if b is None else b)
        if not size or b is None and len(a) < 2:
            continue
        cut = None
        if size > _BLOCK:
            both = a if b is None else np.concatenate([a, b])
            cut = _split(points[both[:: max(1, len(both) // 2048)]], space, radius)
        if cut is not None:
            v, mu = cut
            da = space.distance(points[a], v)
            ai, ao = a[da <= mu], a[da > mu]
            if b is None:
                parts = [(ai, None), (ao, None), (a[(da <= mu) & (da > mu - radius)], a[(da > mu) & (da <= mu + radius)])]
            else:
                db = space.distance(points[b], v)
                parts = [(ai, b[db <= mu + radius]), (ao, b[db > mu - radius])]
            if all(len(x) * len(x if y is None else y) < 0.95 * size for x, y in parts):
                stack += parts
                continue
        other = a if b is None else b
        step = max(1, _BLOCK // len(other))
        for at in range(0, len(a), step):
            i, j = space.near(points[a[at : at + step]], points[other], radius)
            yield a[at + i], other[j]


def forest(points: np.ndarray, homes: np.ndarray, visitors: np.ndarray, rank: np.ndarray, radius: int, within: bool = True, space=BITS) -> np.ndarray:
    """For each point the linked point of least ``rank`` found here; pairs of ``homes`` are looked for only if ``within``."""
    order = np.argsort(rank, kind="stable")
    place = np.empty(len(points), dtype=np.int64)
    place[order] = np.arange(len(points))
    label = np.arange(len(points))
    for a, b in (x for pairs in (near_pairs(points, homes if within else homes[:0], None, radius, space), near_pairs(points, homes, visitors, radius, space)) for x in pairs):
        while True:
            la, lb = label[place[a]], label[place[b]]
            differ = la != lb
            if not differ.any():
                break
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            low = np.minimum(la, lb)
            np.minimum.at(label, np.maximum(la, lb), low)
            while True:  # labels are places too: follow them to their roots
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return order[label[place]]


# --- components -------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(u, v): each node of ``edges`` (u, v) that is not least in its component, with that least node.

    Alternates large-star and small-star until the stars stay as they are; it is
    an error if they do not in ``rounds``, which is beyond what 2^64 nodes need.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        return small.unionByName(down.select("u", F.col("m").alias("v"))).distinct()

    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = mark(now)
    for _ in range(rounds if seen[0] else 0):
        before, now = now, materialise(star(now))
        discard(before)
        if (got := mark(now)) == seen:
            return now
        seen = got
    if seen[0]:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now


def _placed(tree, prefix: str, fps: pa.Array, reps: pa.Array, radius: int, home: np.ndarray | None = None, space=BITS) -> Iterator[pa.RecordBatch]:
    """(shard, fp, rep, home) rows of the points that ``tree`` deals, below the shard ``prefix``."""
    for leaf, homes, visitors in route(tree, space.points(fps), radius, home, space):
        for rows, at_home in ((homes, True), (visitors, False)):
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([f"{prefix}{leaf}"] * len(rows), pa.string()), fps.take(pa.array(rows)), reps.take(pa.array(rows)), pa.array(np.full(len(rows), at_home))], names=["shard", "fp", "rep", "home"])


def _deal_anew(large: DataFrame, radius: int, space=BITS) -> DataFrame:
    """``large`` (shard, fp, rep, home, homes, rows), each shard dealt by a tree over a sample of its own homes.

    A shard's rows go to as many tasks as its size asks for, and each gets the shard's tree.
    """
    kinds = large.schema
    draw = F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    parts = F.ceil(F.col("rows") / TASK_ROWS).cast("int")

    def grow(t: pa.Table) -> pa.Table:
        leaves = max(2, min(MAX_SHARDS, -(-t.column("homes")[0].as_py() // SHARD_ROWS)))
        tree = build_tree(np.sort(space.points(t.column("fp"))), leaves, space, radius)
        return pa.table({"shard": [t.column("shard")[0].as_py()], "rows": [t.column("rows")[0].as_py()], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    def deal(t: pa.Table, trees: pa.Table) -> pa.Table:
        if not trees.num_rows or not t.num_rows:  # a sample without rows: the shard stays
            return t.select(["shard", "fp", "rep", "home"])
        t = t.combine_chunks()
        fps, reps, home = (t.column(c).chunk(0) for c in ("fp", "rep", "home"))
        return pa.Table.from_batches(list(_placed(pickle.loads(trees.column("tree")[0].as_py()), f"{t.column('shard')[0].as_py()}.", fps, reps, radius, home.to_numpy(zero_copy_only=False), space)))

    drawn = large.where(F.col("home") & (draw < TREE_SAMPLE / F.col("homes"))).select("shard", "fp", "homes", "rows")
    trees = drawn.groupBy("shard").applyInArrow(grow, "shard string, rows long, tree binary")
    trees = trees.select("shard", "tree", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = large.select("shard", "fp", "rep", "home", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"))
    return rows.groupBy("shard", "part").cogroup(trees.groupBy("shard", "part")).applyInArrow(deal, f"shard string, fp {kinds['fp'].dataType.simpleString()}, rep {kinds['rep'].dataType.simpleString()}, home boolean")


def link(found: DataFrame, radius: int = 2, space=BITS) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of ``found`` (doc_id, fp), linked within ``radius`` of ``space``."""
    spark = found.sparkSession
    distinct = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    points = distinct.where("rep IS NOT NULL")
    n = points.count()
    sample = space.points(points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).toArrow().column("fp"))
    shards = max(1, min(MAX_SHARDS, -(-n // SHARD_ROWS)))
    tree = spark.sparkContext.broadcast(build_tree(sample, shards, space, radius) if len(sample) else 0)
    fp_type, id_type = (points.schema[c].dataType.simpleString() for c in ("fp", "rep"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _placed(tree.value, "", b.column(0), b.column(1), radius, space=space)

    def search(key: tuple, t: pa.Table) -> pa.Table:
        fps = space.points(t.column("fp"))
        rep = t.column("rep").to_numpy()
        home = t.column("home").to_numpy()
        root = forest(fps, np.flatnonzero(home), np.flatnonzero(~home), rep, radius, within=key[1].as_py() == 0, space=space)
        u, v = rep, rep[root]
        return pa.table({"u": u[u != v], "v": v[u != v]})

    dealt = materialise(points.select("fp", "rep").mapInArrow(deal, f"shard string, fp {fp_type}, rep {id_type}, home boolean"))
    ready = []
    for at in range(DEALS + 1):
        # One row for each shard: joined, not broadcast, for their number grows with the corpus.
        sizes = materialise(dealt.groupBy("shard").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("rows")))
        large = F.col("homes") > SPLIT_ROWS
        more = at < DEALS and bool(sizes.where(large).head(1))
        ready.append(dealt.join(sizes.where(~large) if more else sizes, "shard"))
        if not more:
            break
        dealt = materialise(_deal_anew(dealt.join(sizes.where(large), "shard"), radius, space))
    parts = F.greatest(F.ceil((F.col("rows") - F.col("homes")) / TASK_ROWS), F.lit(1)).cast("int")
    part = F.when(F.col("home"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), parts).cast("int")))
    placed = reduce(DataFrame.unionByName, ready).select("shard", "fp", "rep", "home", F.explode(part).alias("part"))
    edges = placed.groupBy("shard", "part").applyInArrow(search, f"u {id_type}, v {id_type}")
    stars = components(edges)
    return distinct.join(stars.select(F.col("u").alias("rep"), F.col("v").alias("least")), "rep", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    ``doc_id`` must be integral.  ``fingerprint`` has 16 lower-case hex digits;
    ``component_id`` is the smallest doc_id reachable over links of at most
    ``radius`` differing bits, the document's own included.
    """
    found = materialise(fingerprints(docs, id_col, text_col, shingle))
    labels = link(found, radius)
    return found.join(labels, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
