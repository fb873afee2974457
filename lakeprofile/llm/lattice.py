"""SentencePiece encoding and decoding by lattices, in one pass over the texts.

Texts are cut into units no piece crosses: a word with the spaces before it, or
a line's end.  For the distinct units of a batch a lattice is made: a node for
each character, and an edge for each substring that is a piece.  Substrings grow
to the left, a character at a time, all nodes at once, by an equi-join with the
table of the pieces' suffixes; those that no piece ends with are never made.
A fold takes the path of the greatest sum of scores (Viterbi): it walks the
nodes once, in order of their place, all units at once, so units of any length
go the same way and cost in proportion to their length.

A task keeps the ids of the first ``FREQUENT`` units that it meets and makes
those of the others in each batch anew.  No row is moved and nothing is written:
only the suffix table, whose size is the vocabulary's, is broadcast.

``merged`` is another fold over the same lattice: neighbours join in order of
score, as the encoder of a byte-pair vocabulary does; its ids equal the
library's, those of the greatest sum need not.

Defined cases: a null or empty text has no ids and decodes to an empty text; a
character without a piece becomes its bytes' pieces; of equal sums the path whose
last piece is longest is taken; repeated rows are encoded each; an empty table
gives an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from lakeprofile.llm.common import prepare

SPACE = "▁"
#: Units whose ids a task keeps, at most, and the code points in them; about 150 bytes a unit.
FREQUENT = 1 << 18
KEPT_CHARS = 16 * FREQUENT
#: Characters in one lattice, at most, unless one unit has more.
_CHARS = 1 << 18
#: Nodes of a lattice whose edges are held at once, at most, unless one place of all units has more.
_BLOCK = 1 << 14
#: A character that has no piece scores so much less than the least of all pieces.
UNKNOWN = 10.0
_UNITS = re.compile(" +[^ \\n]*|[^ \\n]+|\\n")
#: Stands before a unit's first character; no code point is as large, and ``_BITS`` hold either.
_BEFORE, _BITS = 0x1FFFFF, 21


def vocabulary(model_file: str) -> tuple[list[tuple[str, int, float]], list[bytes], int]:
    """(piece, id, score) of the ordinary pieces, the bytes of every id in order, and the id of byte zero."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = sp.vocab_size()
    byte = [i for i in range(size) if sp.is_byte(i)]
    special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i)}
    plain = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(size) if i not in special and not sp.is_byte(i)]
    said = [b"" if i in special else bytes([i - byte[0]]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
    return plain, said, byte[0]


def units_of(text: str) -> list[str]:
    """The units of a text, in order, with spaces as they are."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " ":
        return _UNITS.findall(" " + text)
    out: list[str] = []
    for n, line in enumerate(text.split("\n")):
        words = line.split(" ")  # no two spaces meet, so each word but a later line's first has one before it
        out += ["\n"] * (n > 0)
        if n and words[0]:
            out.append(words[0])
        elif not n:
            out.append(" " + words[0])
        out += [" " + w for w in words[1:]]
    return out


@dataclass
class Suffixes:
    """The pieces' distinct suffixes as a sorted table.

    ``keys`` are the number of the suffix without its first character and that
    character; a suffix's number is one more than its place, 0 is the empty one.
    ``ids`` and ``scores`` by place: -1 and minus infinity where the suffix is no
    piece itself.  Behind the last place stands a character without a piece.
    """

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    first: int


def suffixes(model_file: str) -> Suffixes:
    plain, _, first = vocabulary(model_file)
    plain = [(p.replace(SPACE, " "), i, x) for p, i, x in plain]
    number, keys = {"": 0}, []
    for size in range(1, 1 + max(len(p) for p, _, _ in plain)):
        level = {p[-size:] for p, _, _ in plain if len(p) >= size}  # longer ones have larger keys than all before
        for key, s in sorted((number[s[1:]] << _BITS | ord(s[0]), s) for s in level):
            keys.append(key)
            number[s] = len(keys)
    ids, scores = np.full(len(keys) + 1, -1, dtype="<i4"), np.full(len(keys) + 1, -np.inf)
    for p, i, x in plain:
        ids[number[p] - 1], scores[number[p] - 1] = i, x
    scores[-1] = min(x for _, _, x in plain) - UNKNOWN
    return Suffixes(np.array(keys, dtype="i8"), ids, scores, first)


class Lattice:
    """The nodes of ``units``, which come longest first: one before each unit and one after each character.

    Nodes are ordered by their place in the unit, then by the unit, so the nodes
    of one place, ``offsets[k]`` to ``offsets[k + 1]``, have the first units in order.
    """

    def __init__(self, units: list[str], table: Suffixes) -> None:
        n, self.table = len(units), table
        self.sizes = np.fromiter(map(len, units), dtype="i8", count=n)
        having = n - np.searchsorted(self.sizes[::-1], np.arange(1 + self.sizes[0]))  # units of that length or more
        self.offsets = np.concatenate([[0], np.cumsum(having)])
        flat = np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4")
        unit = np.repeat(np.arange(n), self.sizes)
        place = np.arange(1, 1 + len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        at = self.offsets[place] + unit
        self.unit, self.char, self.before = np.arange(self.offsets[-1]), np.full(self.offsets[-1], _BEFORE), np.zeros(self.offsets[-1], dtype="i8")
        self.unit[at], self.char[at], self.before[at] = unit, flat, self.offsets[place - 1] + unit

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """The edges by the places where they end, in order: from, to, and a suffix's place by length (longest first) and node; -1: no edge.

        A node where no edge of length one ends has that of a character without a piece.
        """
        t, low, last = self.table, 1, len(self.offsets) - 1
        while low < last:
            high = max(low + 1, int(np.searchsorted(self.offsets, self.offsets[low] + _BLOCK, "right")) - 1)
            ends = np.arange(self.offsets[low], self.offsets[high])
            rows, at, node, found = [], ends, ends - self.offsets[low], np.zeros(len(ends), dtype="i8")
            while len(at):
                key = found << _BITS | self.char[at]
                place = np.searchsorted(t.keys, key)
                hit = np.flatnonzero(t.keys[np.minimum(place, len(t.keys) - 1)] == key)
                at, node, place = self.before[at[hit]], node[hit], place[hit]
                found = place + 1
                row = np.full(len(ends), -1)
                whole = t.ids[place] >= 0
                row[node[whole]] = place[whole]
                rows.append(row)
            rows[0][rows[0] < 0] = len(t.keys)
            yield low, high, np.stack(rows[::-1])
            low = high


def viterbi(lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """The nodes where the pieces of the greatest sum end, in no order, and the pieces' places in the suffix table, by node."""
    offsets, scores = lattice.offsets, np.append(lattice.table.scores, -np.inf)  # the last for no edge, at -1
    best, start, piece = np.zeros(offsets[-1]), np.zeros(offsets[-1], dtype="i8"), np.zeros(offsets[-1], dtype="i8")
    for low, high, edges in lattice.blocks():
        lengths, gain = np.arange(len(edges), 0, -1), scores[edges]
        for k in range(low, high):
            a, b = offsets[k], offsets[k + 1]
            of = slice(a - offsets[low], b - offsets[low])
            some = slice(max(0, len(edges) - k), None)  # no edge is longer than what is before it
            starts = offsets[k - lengths[some]][:, None] + np.arange(b - a)
            sums = best[starts] + gain[some, of]
            chosen = (sums.argmax(axis=0), np.arange(b - a))  # the first of equal ones, which is the longest
            best[a:b], start[a:b], piece[a:b] = sums[chosen], starts[chosen], edges[some, of][chosen]
    n, path = len(lattice.sizes), []
    at = offsets[lattice.sizes] + np.arange(n)
    while len(at := at[at >= n]):  # the first n nodes stand before the units
        path.append(at)
        at = start[at]
    return np.concatenate([*path, at]), piece


def merged(lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """As ``viterbi``, for the path that joining neighbours by best score leaves, of equal ones the first."""
    offsets, n = lattice.offsets, len(lattice.sizes)
    edges: list[dict[tuple[int, int], int]] = [{} for _ in range(n)]
    for low, high, found in lattice.blocks():
        ending = np.repeat(np.arange(low, high), np.diff(offsets[low : high + 1]))
        rows, nodes = np.nonzero(found >= 0)
        for u, stop, row, place in zip(lattice.unit[nodes + offsets[low]].tolist(), ending[nodes].tolist(), rows.tolist(), found[rows, nodes].tolist()):
            edges[u][stop - len(found) + row, stop] = place
    path, piece = [], np.zeros(offsets[-1], dtype="i8")
    for u, (size, known) in enumerate(zip(lattice.sizes.tolist(), edges)):
        after, before = {k: k + 1 for k in range(size)}, {k: k - 1 for k in range(1, size + 1)}
        join = lambda a, m, b: (-lattice.table.scores[known[a, b]], a, m, b)  # noqa: B023, E731
        heap = [join(k, k + 1, k + 2) for k in range(size - 1) if (k, k + 2) in known]
        heapify(heap)
        while heap:
            _, a, m, b = heappop(heap)
            if after.get(a) != m or after.get(m) != b:
                continue
            after[a], before[b] = b, a
            del after[m], before[m]
            for three in ((before.get(a), a, b), (a, b, after.get(b))):
                if (three[0], three[2]) in known:
                    heappush(heap, join(*three))
        for stop, begin in before.items():
            path.append(offsets[stop] + u)
            piece[path[-1]] = known[begin, stop]
    return np.array(path, dtype="i8"), piece


def encode_units(units: list[str], table: Suffixes, fold=viterbi) -> dict[str, bytes]:
    """The 32-bit ids of each of ``units``, which are distinct and not empty, with spaces as they are."""
    out, units, done = {}, sorted(units, key=len, reverse=True), 0
    ends = np.cumsum([0, *map(len, units)])  # of the units so far, in characters
    while done < len(units):
        upto = max(done + 1, int(np.searchsorted(ends, ends[done] + _CHARS, "right")) - 1)
        some, done = units[done:upto], upto
        lattice = Lattice(some, table)
        path, piece = fold(lattice)
        path = np.sort(path)
        path = path[np.argsort(lattice.unit[path], kind="stable")]
        ids, chars = table.ids[piece[path]], lattice.char[path]
        unknown = ids < 0
        width = np.where(unknown, 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF), 1)
        ids = np.repeat(ids, width)
        if unknown.any():
            ids[np.repeat(unknown, width)] = table.first + np.frombuffer(chars[unknown].astype("<u4").tobytes().decode("utf-32-le").encode(), dtype="u1")
        raw = ids.tobytes()
        stops = (4 * np.cumsum(width))[np.cumsum(np.bincount(lattice.unit[path])) - 1].tolist()  # each unit has a piece
        out.update(zip(some, (raw[a:b] for a, b in zip([0, *stops], stops))))
    return out


def _encoded(rows: DataFrame, kept: Column, model_file: str, text_col: str, fold, kinds: str, finish: Callable[[str, bytes], tuple]) -> DataFrame:
    """The fields of the struct ``kept`` of ``rows`` and those of ``kinds``: ``finish`` of each text and the bytes of its ids."""
    spark = rows.sparkSession
    prepare(spark)
    table = spark.sparkContext.broadcast(suffixes(model_file))
    most, most_chars = FREQUENT, KEPT_CHARS
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    whole = rows.select(kept.alias("row"), text.alias("text"))
    added = StructType.fromDDL(kinds)
    into = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, bytes] = {}
        chars = 0
        for b in batches:
            texts = b.column(1).to_pylist()
            cut = [units_of(t) for t in texts]
            fresh = encode_units([u for u in set().union(*cut) if u not in held], table.value, fold)
            if len(held) + len(fresh) <= most and (more := chars + sum(map(len, fresh))) <= most_chars:
                held.update(fresh)
                chars = more
            done = [finish(t, b"".join([held[u] if u in held else fresh[u] for u in units])) for t, units in zip(texts, cut)]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*done), into)] if done else [pa.array([], f.type) for f in into]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["row", *added.names])

    found = whole.mapInArrow(run, StructType([whole.schema["row"], *added.fields]))
    return found.select("row.*", *added.names)


def encode(rows: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "piece_ids", fold=viterbi) -> DataFrame:
    """``rows`` with an array of piece ids as a new last column ``ids_col``, whose name ``rows`` must not have."""
    if ids_col in rows.columns:
        raise ValueError(f"there is a column {ids_col}; give ids_col another name")
    return _encoded(rows, F.struct("*"), model_file, text_col, fold, f"`{ids_col}` array<int>", lambda _, ids: (np.frombuffer(ids, dtype="<i4"),))


def decoded(ids: bytes, said: list[bytes]) -> str:
    """The text of 32-bit ``ids``: their pieces' bytes together, without the space that encoding puts first."""
    return b"".join(map(said.__getitem__, np.frombuffer(ids, dtype="<i4").tolist())).decode("utf-8", "replace").removeprefix(" ")


def decode(rows: DataFrame, model_file: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids as a new last column ``text_col``; null ids have an empty text."""
    said = rows.sparkSession.sparkContext.broadcast(vocabulary(model_file)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decoded(np.array(i or (), dtype="<i4").tobytes(), said.value) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "said"])

    prepare(rows.sparkSession)
    whole = rows.select(F.struct("*").alias("row"), F.col(f"`{ids_col}`"))
    return whole.mapInArrow(run, StructType([whole.schema["row"], StructField("said", StringType())])).select("row.*", F.col("said").alias(text_col))


def round_trip(rows: DataFrame, model_file: str, keys: list[str], text_col: str = "text", fold=viterbi) -> DataFrame:
    """``keys``, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids) and whether decoding gives the text back, for each row."""
    said = rows.sparkSession.sparkContext.broadcast(vocabulary(model_file)[1])

    def finish(text: str, ids: bytes) -> tuple:
        return len(ids) // 4, crc32(ids), decoded(ids, said.value) == text.replace(SPACE, " ")

    return _encoded(rows, F.struct(*[F.col(f"`{k}`") for k in keys]), model_file, text_col, fold, "n_ids long, ids_crc32 long, round_trip boolean", finish)
