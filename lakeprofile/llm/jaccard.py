"""Near duplicates by SimHash, a vantage-point tree and exact Jaccard similarity.

Texts of equal words collapse first, so a group of exact copies is one point
however large it is.  A text's point is the SimHash of its distinct shingles, of
256 bits, and the logarithm of their number: similar sets have similar sizes.
``Prints`` measures both together, and the sharded vantage-point tree of
``simhash`` finds all pairs within its radius 1 and joins them into components.
Every pair of similarity 0.8 differs in each bit with probability 0.1515, of few
shingles 0.1915 at most; it is beyond the radius with probability 2e-8 and 4e-5, by calculation.

The texts of a component meet in a bucket; a bucket of many bytes is cut into
blocks, and every two blocks meet in a task.  There the sets' common shingles are
counted through an inverted index, their exact similarity decides, and a spanning
forest of the links leaves the task.

Defined cases: a null text is an empty one; texts without words are copies of
each other and of nothing else; a text shorter than a shingle is one shingle;
rows of one id and unlike texts are judged as rows of their own; of rows equal in
id and text one stays; of a group the row of smallest id stays, then of smallest
hash; rows without an id stay; an empty table gives an empty result; other
columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm import simhash
from lakeprofile.llm.common import materialise, prepare
from lakeprofile.llm.simhash import components

#: Words in a shingle, and the least similarity of near duplicates in hundredths.
SHINGLE, LEAST = 5, 80
#: Differing bits of near duplicates at most: among the first 128 of a fingerprint, and among all 256.
FIRST, WHOLE = 44, 76
#: Bytes of texts in one block of a bucket.
BLOCK_BYTES = 16 << 20
#: The most that the logarithms of two sets' sizes differ by, with room for rounding.
SIZES = np.log(100 / LEAST) + 1e-9
#: Shingle hashes whose bits are counted at once, a multiple of the 250 that a byte counts; pairs compared at once.
_CHUNK, _PAIRS = 4000, 1 << 17
_POINT = np.dtype([("bits", "<u8", 4), ("ln", "<f8")])
_EMPTY = np.zeros(1, dtype=_POINT)
_XOR, _ODD = np.random.default_rng(42).integers(0, 2**64, (2, 4), dtype=np.uint64)
_ODD = _ODD | np.uint64(1)


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of a text, in order; none if it has no words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    found = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(42)), dtype=np.uint64))


def point(hashes: np.ndarray) -> bytes:
    """The SimHash of a set of shingles, of 256 bits, and the logarithm of the set's size.

    A bit is that of most shingles; of halves, that of the least shingle.
    """
    ones, first = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        x = (hashes[at : at + _CHUNK, None] ^ _XOR) * _ODD
        x = (x ^ (x >> np.uint64(32))) * _ODD
        bits = np.unpackbits((x ^ (x >> np.uint64(29))).view(np.uint8), axis=1, bitorder="little")
        even = len(bits) // 250 * 250
        ones += bits[:even].reshape(-1, 250, 256).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[even:].sum(axis=0, dtype=np.uint8)
        first = first if at else bits[0]
    made = np.zeros(1, dtype=_POINT)
    made["bits"][0] = np.packbits(2 * ones + first > len(hashes), bitorder="little").view("<u8")
    made["ln"] = np.log(max(len(hashes), 1))
    return made.tobytes()


class Prints:
    """Points in the greatest of three distances, each in units of the most that near duplicates have; the radius is 1."""

    def points(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=_POINT)

    def vantages(self, points: np.ndarray) -> np.ndarray:
        """Some points, and the empty set's, which only sizes are far from: there the bound prunes by size alone."""
        return np.concatenate([_EMPTY, points[:: max(1, len(points) // 2)][:2]])

    def distance(self, points: np.ndarray, vantage: np.void) -> np.ndarray:
        if vantage == _EMPTY[0]:
            return np.abs(points["ln"] - vantage["ln"]) / SIZES
        differ = np.bitwise_count(points["bits"] ^ vantage["bits"])
        first = differ[:, 0].astype(np.int16) + differ[:, 1]
        whole = first + differ[:, 2] + differ[:, 3]
        return np.maximum(np.maximum(first / FIRST, whole / WHOLE), np.abs(points["ln"] - vantage["ln"]) / SIZES)

    def near(self, a: np.ndarray, b: np.ndarray, radius: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The places of all pairs of ``a`` and ``b`` within ``radius``."""
        a0, a1, b0, b1 = (np.ascontiguousarray(x["bits"][:, k]) for x in (a, b) for k in (0, 1))
        found, step = [(np.zeros(0, dtype=np.int64),) * 2], max(1, _PAIRS // max(1, len(b)))
        # New arrays of this size cost more than what is counted in them.
        differ, (first, more) = np.empty((step, len(b)), dtype=np.uint64), np.empty((2, step, len(b)), dtype=np.uint8)
        for at in range(0, len(a), step):
            n = min(step, len(a) - at)
            np.bitwise_count(np.bitwise_xor(a0[at : at + n, None], b0, out=differ[:n]), out=first[:n])
            np.bitwise_count(np.bitwise_xor(a1[at : at + n, None], b1, out=differ[:n]), out=more[:n])
            np.add(first[:n], more[:n], out=first[:n])
            i, j = np.divmod(np.flatnonzero(first[:n] <= radius * FIRST), max(1, len(b)))
            i += at
            whole = np.bitwise_count(a["bits"][i] ^ b["bits"][j]).sum(axis=1, dtype=np.int64)
            keep = (whole <= radius * WHOLE) & (np.abs(a["ln"][i] - b["ln"][j]) <= radius * SIZES)
            found.append((i[keep], j[keep]))
        return tuple(map(np.concatenate, zip(*found)))


PRINTS = Prints()


def _words(b: pa.RecordBatch) -> Iterator[list[bytes]]:
    return ((x or b"").lower().split() for x in b.column(1).cast(pa.binary()).to_pylist())


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh128_digest(b" ".join(words))


def sketches(texts: DataFrame) -> DataFrame:
    """(id, h, digest, size, bytes, fp) of each row of ``texts`` (id, text, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, size, length, keys = [], [], [], []
            for words in _words(b):
                hashes = shingles(words)
                digest.append(_digest(words))
                size.append(len(hashes))
                length.append(sum(map(len, words)) + len(words))
                keys.append(point(hashes))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(length, pa.int64()), pa.array(keys, pa.binary())], names=["id", "h", "digest", "size", "bytes", "fp"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, h long, digest binary, size long, bytes long, fp binary")


def linked(sets: list[np.ndarray], side: np.ndarray | None = None) -> np.ndarray:
    """For each of ``sets`` the first one of its component, by links of similarity ``LEAST`` / 100.

    With ``side`` only pairs whose sides differ are compared.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(where, kind="stable")  # owners ascend within a value
    holders, ends = owner[order], np.cumsum(np.bincount(where, minlength=len(values)))
    starts = np.concatenate([[0], ends[:-1]])
    label, at = np.arange(n), 0
    for i in range(n):
        mine = where[at : at + sizes[i]]
        at += sizes[i]
        first, many = starts[mine], ends[mine] - starts[mine]
        # the places of all holders of all values of this set
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        common = np.bincount(holders[np.repeat(first, many) + inside], minlength=n)
        common[: i + 1] = 0
        if side is not None:
            common[side == side[i]] = 0
        near = np.flatnonzero(100 * common >= LEAST * (sizes + sizes[i] - common))
        near = near[common[near] > 0]
        if len(near):
            roots = np.unique(np.concatenate([label[near], label[i : i + 1]]))
            label[np.isin(label, roots)] = roots[0]
    return label


def link(texts: DataFrame, points: DataFrame) -> DataFrame:
    """(u, v): each point of ``points`` (id, h, size, bytes, fp) that is not least in its component, with that least one.

    ``u`` and ``v`` are structs of id and h; ``texts`` has id, text, h.
    """
    some = points.where("size > 0")
    # Hashes stand for points here; should two points share one, their components would meet in one bucket.
    wide = simhash.link(some.select(F.col("h").alias("doc_id"), "fp"), 1, PRINTS)
    keys = some.join(wide, "fp").select("id", "h", "bytes", F.col("component_id").alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("all")).where("n > 1")
    blocks = F.ceil(F.col("all") / BLOCK_BYTES).cast("int")
    members = keys.join(buckets.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("id", "h"), F.col("blocks")).cast("int"))
    # A block meets itself and every other block, each in a task of its own.
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("low"), F.greatest(x, "block").alias("high")))
    placed = members.select("id", "h", "key", "block", F.explode(others).alias("pair"))
    sent = materialise(placed.groupBy("id", "h").agg(F.collect_list(F.struct("key", "pair", "block")).alias("to")))
    words = texts.where("id IS NOT NULL").dropDuplicates(["id", "h"]).join(sent, ["id", "h"])
    ready = words.select("id", "text", "h", F.explode("to").alias("to")).select("id", "text", "h", "to.key", "to.pair.low", "to.pair.high", "to.block")
    ready = ready.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def flush() -> pa.RecordBatch:
            side = np.array([r[3] for r in rows])
            label = linked([r[2] for r in rows], side if now[1] != now[2] else None)
            moved = [(rows[i], rows[j]) for i, j in enumerate(label.tolist()) if i != j]
            return pa.RecordBatch.from_arrays([pa.array([x[k][c] for x in moved], t) for k in (0, 1) for c, t in ((0, kind), (1, pa.int64()))], names=["ui", "uh", "vi", "vh"])

        for b in batches:
            kind = b.column(0).type
            for words, *row in zip(_words(b), *(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6))):
                i, h, key, low, high, block = row
                if now != (key, low, high):
                    if len(rows) > 1:
                        yield flush()
                    now, rows = (key, low, high), []
                rows.append((i, h, shingles(words), block))
        if len(rows) > 1:
            yield flush()

    id_type = texts.schema["id"].dataType.simpleString()
    found = ready.mapInArrow(run, f"ui {id_type}, uh long, vi {id_type}, vh long")
    node = lambda side: F.struct(F.col(f"{side}i").alias("id"), F.col(f"{side}h").alias("h")).alias(side)
    return components(found.select(node("u"), node("v")))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group that links of similarity ``LEAST`` / 100 join: that with the smallest id.

    ``id_col`` may be of any type that has an order.
    """
    prepare(docs.sparkSession)
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(ident.alias("id"), text.alias("text"), F.xxhash64(ident, text).alias("h"))
    found = materialise(sketches(texts))
    least = F.min(F.struct("id", "h", "size", "bytes", "fp")).alias("p")
    points = materialise(found.where("id IS NOT NULL").groupBy("digest").agg(least).select("p.*"))
    gone = link(texts, points).select("u.id", "u.h")
    stay = points.select("id", "h").join(gone, ["id", "h"], "left_anti").select(F.col("id").alias("_kept_id"), F.col("h").alias("_kept_h"))
    whole = docs.select(F.struct("*").alias("row"), ident.alias("id"), F.xxhash64(ident, text).alias("h"))
    # The join deals rows by id and hash, so that dropping equal ones moves nothing again.
    kept = whole.where("id IS NOT NULL").join(stay, (F.col("id") == F.col("_kept_id")) & (F.col("h") == F.col("_kept_h")), "left_semi").dropDuplicates(["id", "h"])
    return kept.select("row.*").unionByName(docs.where(ident.isNull()))
