"""Quality classifier: what compresses better after good text than after bad text is good.

Two zstandard dictionaries are built from labelled text, one good and one bad.
Every text is compressed in blocks under both, whole, and the difference of the
compressed sizes over their sum is the feature; a logistic curve, fitted on
labelled text that no dictionary has seen, turns it into a probability.  The
labelled rows are a bounded sample, ``PER_CLASS`` of each class for the
dictionaries and as many for the curve; rows are drawn by the hash of their ids.

Defined cases: a null or empty text has difference 0; a document with both
labels counts as bad; without labels of both classes every score is the share of
good labels, or one half where there are none; repeated rows and rows without an
id are scored like others; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm.common import held_out, keyed_text, prepare

#: Labelled rows of each class for the dictionaries, and again for the curve, about; twice as many at most.
PER_CLASS = 1200
#: Texts of more bytes are not learned from, so that the sample is bounded in bytes too; they are scored whole.
LONGEST_LEARNED = 100_000
DICTIONARY_BYTES = 112_640
#: Texts are compressed in blocks of so many bytes, so that the dictionary, not the text itself, is the context.
BLOCK = 2048
LEVEL = 3


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    intercept: float = 0.0
    _compressors: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"} | {"_compressors": []}

    def difference(self, raw: bytes) -> float:
        """(bad - good) / (bad + good) of the compressed sizes, less what an empty frame takes."""
        if not raw or not self.good:
            return 0.0
        if not self._compressors:
            for d in (self.good, self.bad):
                known = zstandard.ZstdCompressionDict(d)
                known.precompute_compress(level=LEVEL)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))
        good, bad = (c.compress for c in self._compressors)
        blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
        g, b = sum([len(good(x)) for x in blocks]), sum([len(bad(x)) for x in blocks])
        return (b - g) / (b + g)

    def score(self, raw: bytes) -> float:
        x = self.slope * self.difference(raw) + self.intercept
        return round(float(1 / (1 + np.exp(-np.clip(x, -30, 30)))), 6)


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts' own end where there is too little to train on."""
    blocks = [t[at : at + BLOCK] for t in texts for at in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton's method, on Platt's smoothed targets."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + (ridge + 1e-9) * np.eye(2)
        step = np.linalg.solve(h, a.T @ (p - target) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(learned: list[tuple[bytes, int]], curve: list[tuple[bytes, int]]) -> Model:
    """``learned`` (text, label) makes the dictionaries, ``curve`` the calibration."""
    by = {k: [t for t, y in learned if y == k and t] for k in (0, 1)}
    y = np.array([y for _, y in curve], dtype=float)
    if not by[0] or not by[1] or not len(y) or y.min() == y.max():
        every = [y for _, y in learned + curve]
        p = np.clip(sum(every) / len(every) if every else 0.5, 1e-6, 1 - 1e-6)
        return Model(intercept=float(np.log(p / (1 - p))))
    model = Model(_dictionary(by[1]), _dictionary(by[0]))
    model.slope, model.intercept = _logistic(np.array([model.difference(t) for t, _ in curve]), y)
    return model


def sample(docs: DataFrame, labels: DataFrame, learn: Column, part: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> dict[bool, list[tuple[bytes, int]]]:
    """About ``per_class`` labelled rows of each class for either value of ``part``, of the ids that ``learn`` admits."""
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("part", part)
    counts = {(r["label"], r["part"]): r["n"] for r in known.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {True: [], False: []}
    share = F.coalesce(*[F.when((F.col("label") == y) & (F.col("part") == p), F.lit(min(1.0, per_class / n))) for (y, p), n in counts.items()])
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) / (1 << 24) < share).limit(8 * per_class)
    # ``drawn`` is bounded by its limit, so it may be broadcast.
    rows = keyed_text(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST_LEARNED).limit(8 * per_class).collect()
    rows.sort(key=lambda r: (str(r["doc_id"]), r["text"] or ""))
    return {p: [((r["text"] or "").encode(), r["label"]) for r in rows if r["part"] == p] for p in (True, False)}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability that a text is good, for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.score(x or b"") for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    prepare(docs.sparkSession)
    kept = keyed_text(docs, id_col, text_col)
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted); learns from labels of ids whose crc32 mod 3 is not 1 only.

    Remainder 0 makes the dictionaries, remainder 2 the curve.
    """
    aside = held_out(F.col("doc_id"), 3, 1)
    found = sample(docs, labels, ~aside, held_out(F.col("doc_id"), 3, 0), id_col, text_col)
    return score(docs, fit(found[True], found[False]), id_col, text_col).select("doc_id", aside.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
