"""Best-fit sequence packing by a configuration linear program.

All documents are tokenised, each gets an end mark, and only those longer than
a sequence are cut.  The histogram of piece lengths, at most ``CAPACITY``
numbers whatever the corpus, goes to the driver.  There a configuration linear
program (least number of sequences whose patterns cover the histogram) is
solved by multiplicative weights: the weights price the lengths, a knapsack
dynamic program over them finds a pattern of much worth, until every length is
covered.  The copies so found, rounded down, to one at least, as far as pieces
are left, are the plan; what rounding leaves is solved anew, and the last
hundredth, or what no longer fills a sequence, is packed best fit.  The plan is a table of rank intervals per length, bounded by the
number of patterns and not by the corpus.  A piece finds its place by its rank
among the pieces of its length; ranks are dealt in hash buckets, as many as a
length's count asks for, so a length that a third of all rows share is no hot spot.

Defined cases: a null or empty text is one piece that holds only the end mark;
repeated rows are packed each; rows without an id are packed too; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeprofile.llm.common import keyed_text, materialise, prepare

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are ranked in one hash bucket, about.
BUCKET_ROWS = 1 << 20
#: Lengths that one pattern is priced over, the share of pieces that is left to best fit, and the least fill of a pattern.
_PRICED, REST, FULL = 160, 0.01, 0.999
#: Words and parts of words whose ids a worker remembers, before it starts afresh.
_REMEMBERED = 400_000

_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The tokenizer reads these otherwise than a split at white space does.
_ODD = regex.compile(r"[\x1c-\x1f]|<\|(?:startoftext|endoftext)\|>")


class WordIds:
    """Ids of whole texts by ``tokenizers``, as little-endian bytes, word by word.

    The vocabulary's pieces end within words, so a text's ids are those of its
    words; words and their parts are remembered, within a bound.  Texts for
    which that does not hold go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in set(printable))
        self.as_letters = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}
        outer = self

        class Parts(dict):
            def __missing__(self, part: str) -> bytes:
                letters = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(outer.as_letters)
                self[part] = found = array("I", [t.id for t in outer.model.tokenize(letters)]).tobytes()
                return found

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if word.isascii() and word.isalpha():
                    found = outer.parts[word]
                else:
                    found = b"".join(map(outer.parts.__getitem__, _PARTS.findall(word)))
                self[word] = found
                return found

        self.parts, self.words = Parts(), Words()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if len(self.words) > _REMEMBERED:
            self.words.clear()
        if len(self.parts) > _REMEMBERED:
            self.parts.clear()
        if not text.isascii():
            try:  # beyond Latin-1 composition and case may depend on neighbours
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.whole(text)
        if _ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.lower().split()))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the tokenised documents, cut only where longer than ``capacity``."""
    end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    prepare(docs.sparkSession)
    kept = keyed_text(docs, id_col, text_col)
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


# --- the plan, on the driver, from the histogram alone ----------------------


def _best_pattern(lengths: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """The pattern of most worth by the bounded knapsack dynamic program; copies of a length enter in powers of two."""
    best = np.zeros(capacity + 1)
    took: list[tuple[int, int, np.ndarray]] = []
    for n in np.argsort(-worth / lengths):
        size, left, k = int(lengths[n]), int(min(most[n], capacity // lengths[n])), 1
        while left > 0:
            k = min(k, left)
            left -= k
            w = k * size
            with_it = best[: capacity + 1 - w] + k * worth[n]
            better = with_it > best[w:] + 1e-12
            if better.any():
                best[w:][better] = with_it[better]
                took.append((int(n), k, better))
            else:
                break
            k *= 2
    at, pattern = int(best.argmax()), Counter()
    for n, k, better in reversed(took):
        w = k * int(lengths[n])
        if at >= w and better[at - w]:
            pattern[int(lengths[n])] += k
            at -= w
    return dict(pattern)


def _cover(left: dict[int, int], capacity: int, step: float, rounds: int) -> dict[tuple, float]:
    """{pattern: copies}, fractional: patterns that together cover every count of ``left``.

    A round adds the pattern of most worth, with as many copies as cover the
    scarcest of its lengths by one ``1 / rounds``-th, and lowers the prices of
    its lengths; covered lengths leave the program, which ends when none is left.
    """
    lengths = np.array(sorted(left, reverse=True))
    count = np.array([left[int(n)] for n in lengths], dtype=float)
    place = {int(n): i for i, n in enumerate(lengths)}
    covered = np.zeros(len(lengths))
    found: dict[tuple, float] = defaultdict(float)
    while (open_ := np.flatnonzero(covered < 1 - 1e-9)).size:
        price = lengths[open_] ** 1.02 * np.exp(-step * covered[open_])
        # the densest lengths, and short ones that fill what they leave
        some = np.unique(np.concatenate([np.argsort(-price / lengths[open_], kind="stable")[:_PRICED], np.arange(max(0, len(open_) - _PRICED // 4), len(open_))]))
        pattern = _best_pattern(lengths[open_[some]], price[some], count[open_[some]], capacity)
        at = np.array([place[n] for n in pattern])
        used = np.array(list(pattern.values()), dtype=float)
        share = float(max((count[at] / used).min() / rounds, min(1.0, (count[at] / used).min())))
        found[tuple(sorted(pattern.items()))] += share
        covered[at] += used * share / count[at]
    return found


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 1, step: float = 0.35) -> list[tuple[dict[int, int], int]]:
    """(pattern, copies): patterns that hold every piece of ``histogram`` (length: count) exactly once."""
    return _solve(histogram, capacity, rounds, step)[0]


def _solve(histogram: dict[int, int], capacity: int, rounds: int, step: float) -> tuple[list[tuple[dict[int, int], int]], int]:
    """The plan, and the number of pieces that best fit placed in it.

    The covering program min sum x_p, sum_p p_l x_p >= count_l is solved by
    multiplicative weights over the lengths until it covers all, and its copies
    are rounded down, to one at least, as far as pieces are left.  The rest is
    solved anew until it is too small for a pattern to repay; best fit packs that.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    total = sum(left.values())
    plan: Counter = Counter()
    for n in [n for n in left if 2 * n > capacity and n + min(left) > capacity]:
        plan[((n, 1),)] += left.pop(n)  # nothing fits beside these
    while left and sum(left.values()) > REST * total:
        found = _cover(left, capacity, step, rounds)
        full = lambda p: sum(size * k for size, k in p)
        placed = 0
        for pattern in sorted(found, key=lambda p: (-full(p), -found[p], p)):
            if full(pattern) < FULL * capacity:
                break  # what wastes room is left to later rounds and to best fit
            n = min(max(1, int(found[pattern])), *(left[size] // k for size, k in pattern))
            if n > 0:
                plan[pattern] += n
                for size, k in pattern:
                    left[size] -= n * k
                    placed += n * k
        left = {n: c for n, c in left.items() if c > 0}
        if not placed:
            break
    rest = sum(left.values())
    for pattern, copies in _best_fit(left, capacity).items():
        plan[pattern] += copies
    return [(dict(p), n) for p, n in plan.items()], rest


def _best_fit(left: dict[int, int], capacity: int) -> Counter:
    """Best fit, longest first, for counts: equal pieces go into equally full sequences at once."""
    opened: dict[int, Counter] = defaultdict(Counter)  # room: {pattern: copies}
    rooms: list[int] = []

    def put(room: int, pattern: tuple, copies: int) -> None:
        if room not in opened:
            insort(rooms, room)
        opened[room][pattern] += copies

    def grown(pattern: tuple, size: int, k: int) -> tuple:
        return (*pattern[:-1], (size, pattern[-1][1] + k)) if pattern and pattern[-1][0] == size else (*pattern, (size, k))

    for size in sorted(left, reverse=True):
        todo = left[size]
        while todo:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                k = capacity // size
                if todo >= k:
                    put(capacity - k * size, ((size, k),), todo // k)
                if todo % k:
                    put(capacity - todo % k * size, ((size, todo % k),), 1)
                break
            room = rooms[at]
            pattern, copies = next(iter(opened[room].items()))
            n = min(todo, copies)
            opened[room][pattern] -= n
            if not opened[room][pattern]:
                del opened[room][pattern]
                if not opened[room]:
                    del opened[room], rooms[at]
            put(room - size, grown(pattern, size, 1), n)
            todo -= n
    done: Counter = Counter()
    for patterns in opened.values():
        for pattern, copies in patterns.items():
            merged: Counter = Counter()
            for size, k in pattern:
                merged[size] += k
            done[tuple(sorted(merged.items()))] += copies
    return done


def intervals(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, slots, first sequence, first offset) for each length of each pattern."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for pattern, copies in plan:
        offset = 0
        for size, k in sorted(pattern.items(), reverse=True):
            rows.append((size, rank[size], rank[size] + k * copies, k, sequence, offset))
            rank[size] += k * copies
            offset += k * size
        sequence += copies
    return rows


# --- places -----------------------------------------------------------------


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of ``docs``."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, id_col, text_col, capacity, end_id))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    # These two tables are bounded by the capacity, so they are broadcast.
    dealers = spark.createDataFrame([(n, -(-c // BUCKET_ROWS)) for n, c in histogram.items()], "length long, parts long")
    places = spark.createDataFrame(intervals(solve(histogram, capacity)), "length long, low long, high long, slots long, first long, base long")
    dealt = cut.join(F.broadcast(dealers), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    # A row for a bucket: the pieces are shuffled by length and bucket for their ranks, so this join moves them no further.
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    on = (ranked["length"] == places["length"]) & (ranked["rank"] >= places["low"]) & (ranked["rank"] < places["high"])
    nth = F.col("rank") - F.col("low")
    return ranked.join(F.broadcast(places), on).select(
        "doc_id",
        "piece",
        "start",
        ranked["length"].alias("length"),
        "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("slots"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("slots") * ranked["length"]).cast("long").alias("offset"),
    )
