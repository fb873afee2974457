"""Chroma audio fingerprints and their alignment.

A recording is cut into overlapping frames; the power of each frame is folded
into twelve pitch classes, smoothed over neighbouring frames and normalised.
Sixteen filters, differences of rectangle sums that an integral image gives at
once, are quantised to two Gray-coded bits each: one packed 32-bit integer a
frame.  Recordings with equal sequences form a class, represented by its
smallest id.  To align, two bytes of a code and the same two of a later one make
a key; the keys of query classes are joined to those of all classes, a histogram
of the offsets proposes alignments, and for each offset of enough votes the share
of differing bits over the whole overlap decides.

Defined cases: null, undecodable, silent or short recordings have an empty
sequence: they form one class and align with nothing; repeated rows keep one row
each; rows without an id belong to a class but never represent it unless it has
no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm.common import materialise, prepare

RATE, FRAME = 5512, 2048
HOP = FRAME // 3
LOW_HZ, HIGH_HZ = 60.0, 2600.0
_SMOOTH = (0.25, 0.75, 1.0, 0.75, 0.25)
#: (kind, first pitch class, pitch classes, frames): 1 halves in pitch, 2 halves in time, 3 quarters, 4 middle third in time, 5 middle third in pitch.
FILTERS = (
    (1, 0, 12, 3), (1, 2, 8, 6), (1, 4, 6, 9), (1, 6, 6, 12),
    (2, 0, 3, 8), (2, 3, 3, 12), (2, 6, 3, 16), (2, 8, 4, 10),
    (3, 0, 6, 6), (3, 4, 8, 10), (3, 6, 6, 14),
    (4, 0, 4, 9), (4, 5, 5, 15), (4, 9, 3, 12),
    (5, 0, 9, 5), (5, 3, 9, 10),
)
_WIDEST = max(f[3] for f in FILTERS)
_CUTS = (-0.25, 0.0, 0.25)
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
#: Places between the two codes of a key.
APART = 4
#: Keys equal at one offset that propose an alignment, frames that it must cover, and the most differing bits of all.
LEAST_VOTES, LEAST_FRAMES, MOST_ERROR = 1, 16, 0.15


def wav(data: bytes | None) -> np.ndarray | None:
    """Samples of 16-bit WAV bytes, channels averaged; None for anything else.  The rate must be ``RATE``."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            if w.getsampwidth() != 2 or w.getframerate() != RATE:
                return None
            return np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels()).mean(axis=1).astype(np.float32)
    except (wave.Error, EOFError):
        return None


def melody(vector: list[float] | None) -> np.ndarray | None:
    """A vector as a recording: one tone for each number, its pitch by the number's size."""
    if not vector:
        return None
    v = np.nan_to_num(np.array([x if x is not None else 0.0 for x in vector], dtype=np.float64))
    notes = np.clip(np.round(24 + 80 * v), 0, 47).astype(int)
    return _tones()[notes].ravel()


_KNOWN: dict[str, np.ndarray] = {}


def _tones() -> np.ndarray:
    if "tones" not in _KNOWN:
        t = np.arange(HOP) / RATE
        hz = 82.4 * 2 ** (np.arange(48) / 12)
        _KNOWN["tones"] = (np.sin(2 * np.pi * hz[:, None] * t) + 0.4 * np.sin(4 * np.pi * hz[:, None] * t)).astype(np.float32)
    return _KNOWN["tones"]


def _folding() -> tuple[np.ndarray, np.ndarray]:
    if "window" not in _KNOWN:
        hz = np.fft.rfftfreq(FRAME, 1 / RATE)
        used = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
        fold = np.zeros((len(hz), 12), dtype=np.float32)
        fold[np.flatnonzero(used), np.round(12 * np.log2(hz[used] / 440)).astype(int) % 12] = 1
        _KNOWN["window"], _KNOWN["fold"] = np.hamming(FRAME).astype(np.float32), fold
    return _KNOWN["window"], _KNOWN["fold"]


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames of twelve smoothed, normalised pitch-class strengths."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    window, fold = _folding()
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    found = []
    for at in range(0, len(frames), 512):  # long recordings, a slice at a time
        spectrum = np.fft.rfft(frames[at : at + 512] * window)
        found.append((spectrum.real**2 + spectrum.imag**2) @ fold)
    power = np.concatenate(found).astype(np.float64)
    if len(power) < len(_SMOOTH):
        return np.zeros((0, 12))
    n = len(power) - len(_SMOOTH) + 1
    smooth = sum(w * power[k : k + n] for k, w in enumerate(_SMOOTH))
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(norm > 1e-6, smooth / np.maximum(norm, 1e-12), 0.0)


def codes(samples: np.ndarray | None) -> np.ndarray:
    """The packed integers of a recording, one for each place of the widest filter; none if it is silent throughout."""
    image = chroma(samples) if samples is not None else np.zeros((0, 12))
    n = len(image) - _WIDEST + 1
    if n < 1 or not image.any():
        return np.zeros(0, dtype=np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[t1 : t1 + n, p1] - total[t0 : t0 + n, p1] - total[t1 : t1 + n, p0] + total[t0 : t0 + n, p0]

    out = np.zeros(n, dtype=np.uint32)
    for kind, p, height, width in FILTERS:
        whole = area(0, width, p, p + height)
        # the rectangles on one side, as (from frame, to frame, from class, to class)
        side = {
            1: [(0, width, p, p + height // 2)],
            2: [(0, width // 2, p, p + height)],
            3: [(0, width // 2, p, p + height // 2), (width // 2, width, p + height // 2, p + height)],
            4: [(width // 3, width - width // 3, p, p + height)],
            5: [(0, width, p + height // 3, p + height - height // 3)],
        }[kind]
        share = sum((t1 - t0) * (p1 - p0) for t0, t1, p0, p1 in side) / (width * height)
        part = sum(area(*r) for r in side)
        level = np.searchsorted(_CUTS, 2 * (part - share * whole) / np.maximum(whole, 1e-9), side="right")
        out = (out << np.uint32(2)) | _GRAY[level]
    return out


def fingerprints(media: DataFrame, id_col: str, media_col: str, decoder: Callable = wav) -> DataFrame:
    """(media_id, codes): the packed integers, as signed 32-bit ones, of each row of ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [codes(decoder(x)).view(np.int32) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["media_id", "codes"])

    prepare(media.sparkSession)
    kept = media.select(F.col(f"`{id_col}`").alias("media_id"), F.col(f"`{media_col}`"))
    return kept.mapInArrow(run, f"media_id {kept.schema['media_id'].dataType.simpleString()}, codes array<int>")


def _places(classes: DataFrame) -> DataFrame:
    """(class_id, pos, key): two bytes of a code with the same two of the code ``APART`` places on, for each pair of bytes, where the key differs from the one before."""
    code = lambda at: F.get("codes", at).cast("long").bitwiseAND(0xFFFFFFFF)
    two = lambda c, i, j: F.shiftleft(F.shiftright(c, 8 * i).bitwiseAND(0xFF), 8).bitwiseOR(F.shiftright(c, 8 * j).bitwiseAND(0xFF))
    key = lambda at, n, i, j: F.shiftleft(two(code(at), i, j), 16).bitwiseOR(two(code(at + APART), i, j)).bitwiseOR(F.lit(n << 32).cast("long"))
    at = classes.where(F.size("codes") > APART).select("class_id", "codes", F.explode(F.sequence(F.lit(0), F.size("codes") - 1 - APART)).alias("pos"))
    keys = F.array(*[F.when((F.col("pos") == 0) | (key(F.col("pos"), n, i, j) != key(F.col("pos") - 1, n, i, j)), key(F.col("pos"), n, i, j)) for n, (i, j) in enumerate(combinations(range(4), 2))])
    return at.select("class_id", "pos", F.explode(F.array_compact(keys)).alias("key"))


def align(classes: DataFrame) -> DataFrame:
    """(query, found, offset, votes, bit_error) of the pairs of different classes that align; ``classes`` has class_id, codes, is_query.

    Offset is found's place less query's; of several offsets the one of least errors, then of least size, is kept.
    """
    places = materialise(_places(classes))
    asked = places.join(classes.where("is_query").select("class_id"), "class_id", "left_semi").select(F.col("class_id").alias("query"), F.col("pos").alias("at"), "key")
    votes = asked.join(places, "key").where("query <> class_id").groupBy("query", F.col("class_id").alias("found"), (F.col("pos") - F.col("at")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.where(F.col("votes") >= LEAST_VOTES)
    of = lambda name: classes.select(F.col("class_id").alias(name), F.col("codes").alias(f"{name}_codes"))
    both = best.join(of("query"), "query").join(of("found"), "found")
    start = F.greatest(F.lit(0), -F.col("offset"))
    stop = F.least(F.size("query_codes"), F.size("found_codes") - F.col("offset"))
    differ = lambda i: F.get("query_codes", i).bitwiseXOR(F.get("found_codes", i + F.col("offset"))).cast("long").bitwiseAND(0xFFFFFFFF)  # noqa: E731  a negative int counts its sign's bits too
    error = F.aggregate(F.sequence(start, stop - 1), F.lit(0), lambda a, i: a + F.bit_count(differ(i)))
    judged = both.where(stop - start >= LEAST_FRAMES).withColumn("bit_error", F.round(error / (32 * (stop - start)), 6))
    kept = judged.where(F.col("bit_error") <= MOST_ERROR).groupBy("query", "found").agg(F.min(F.struct("bit_error", F.abs("offset").alias("size"), "offset", "votes")).alias("b"))
    return kept.select("query", "found", "b.offset", "b.votes", "b.bit_error")


def search(media: DataFrame, id_col: str, media_col: str, decoder: Callable = wav, every: int = 50) -> DataFrame:
    """(media_id, class_id, n_codes, n_links, best_query, best_offset, best_bit_error), one row per row of ``media``.

    Queries are the recordings whose id is divisible by ``every``; a class is a
    query if one of its members is.  ``n_links`` counts the other query classes
    that a row's class aligns with, and the best of them has least bit errors.
    """
    found = materialise(fingerprints(media, id_col, media_col, decoder))
    classes = materialise(found.groupBy("codes").agg(F.min("media_id").alias("class_id"), F.coalesce(F.max(F.col("media_id") % every == 0), F.lit(False)).alias("is_query")))
    links = align(classes.where("class_id IS NOT NULL AND size(codes) > 0"))
    top = links.groupBy(F.col("found").alias("class_id")).agg(F.count(F.lit(1)).alias("n_links"), F.min(F.struct("bit_error", "query", "offset")).alias("b"))
    # A class of any size is one row here, and the rows of a hot one are split by the engine.
    known = classes.select("codes", "class_id").join(top, "class_id", "left")
    digest = lambda c: F.sha1(F.to_json(c))
    labels = known.select(digest(F.col("codes")).alias("digest"), "class_id", F.size("codes").cast("long").alias("n_codes"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("b.query").alias("best_query"), F.col("b.offset").alias("best_offset"), F.col("b.bit_error").alias("best_bit_error"))
    return found.select("media_id", digest(F.col("codes")).alias("digest")).join(labels, "digest").drop("digest")
