"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The model is fitted on the driver from a bounded sample, ``PER_LANG`` rows of
each language by the hash of their ids, with follow-the-regularised-leader and
elastic-net penalties; every fifth row of each language sets the softmax
temperature, which is 1 if no language has five.
Scoring reads whole texts: every n-gram is hashed, its row of weights gathered,
and the rows of a text are averaged, in slices of bounded size.

Defined cases: a null text or one without a letter is ``und`` with score 0; so
is every text if no labelled row is left to learn from; a language seen in the
sample only is learned from as few rows as there are; repeated rows and rows
without an id are scored like others; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm.common import held_out, keyed_text, prepare

#: Rows of each language that the model is fitted on, about; twice as many at most.
PER_LANG = 1000
#: Texts of more bytes are not learned from, so that the sample is bounded in bytes too; they are scored whole.
LONGEST_LEARNED = 100_000
BITS = 16
#: Share of a text's n-grams that the sample has too, below which its language is none of the learned ones.
LEAST_KNOWN = 0.8
ORDERS = (1, 2, 3)
_SCALE = 32.0
_SLICE = 1 << 20
_LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters tells nothing of a language.
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def _codes(text: str) -> np.ndarray:
    """Folded code points between two spaces on either side."""
    codes = np.frombuffer(("  " + text.lower() + "  ").encode("utf-32-le", "replace"), dtype="<u4")
    plain = codes < 128
    return np.where(plain, _FOLD[np.where(plain, codes, 0)], codes).astype(np.uint32)


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that starts at each place; ``codes`` has two places more."""
    n, found, h = len(codes) - 2, [], np.zeros(len(codes) - 2, dtype=np.uint32)
    for k in range(max(ORDERS)):
        h = h * np.uint32(0x01000193) + codes[k : k + n] + np.uint32(1)
        if k + 1 in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)
            found.append((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))
    return found


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # weights with idf and scale, float32 [buckets, languages]
    bias: np.ndarray
    seen: np.ndarray  # whether an n-gram of the bucket was learned from, bool [buckets]
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, from all its n-grams, and the share of these that were learned from."""
        parts = [_codes(t) for t in texts]
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        codes = np.concatenate([*parts, np.full(2, 32, dtype=np.uint32)])
        out, known = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        step = max(4096, _SLICE * 4 // max(4, len(self.langs)))
        for at in range(0, int(ends[-1]), step):
            stop = min(at + step, int(ends[-1]))
            grams = _grams(codes[at : stop + 2])
            first, last = np.searchsorted(ends, at, "right"), np.searchsorted(starts, stop, "left")
            cuts = np.maximum(starts[first:last], at) - at
            for g in grams:
                out[first:last] += np.add.reduceat(self.table[g], cuts, axis=0, dtype=np.float64)
                known[first:last] += np.add.reduceat(self.seen[g], cuts, dtype=np.int64)
        return (out / (len(ORDERS) * sizes)[:, None] + self.bias) / self.temperature, known / (len(ORDERS) * sizes)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of each text's language in ``langs``, its score, and the share of the n-grams that are known."""
        logits, known = self.logits(texts)
        p = _softmax(logits)
        best = p.argmax(axis=1)
        return best, np.round(p[np.arange(len(best)), best], 6), known


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> Model | None:
    """Fit on ``texts``; every fifth of each language sets the temperature only."""
    langs = sorted(set(labels))
    if not langs:
        return None
    k, buckets = len(langs), 1 << BITS
    y = np.array([langs.index(x) for x in labels])
    order = np.random.default_rng(7).permutation(len(texts))
    tune = {i for c in range(k) for i in order[y[order] == c][4::5].tolist()}
    train = [i for i in order if i not in tune]
    rows = {}
    df = np.zeros(buckets)
    for i in train:
        ids, n = np.unique(np.concatenate(_grams(np.concatenate([_codes(texts[i]), np.full(2, 32, dtype=np.uint32)]))), return_counts=True)
        df[ids] += 1
        rows[i] = ids, n / n.sum()
    idf = np.log((1 + len(train)) / (1 + df)) + 1
    z, n2 = np.zeros((buckets, k)), np.zeros((buckets, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weights(z: np.ndarray, n2: np.ndarray, l1: float = l1, l2: float = l2) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n2)) / alpha + l2))

    for _ in range(epochs):
        for i in train:
            ids, tf = rows[i]
            x = tf * idf[ids] * _SCALE
            zi, ni = z[ids], n2[ids]
            w, b = weights(zi, ni), weights(zb, nb, 0.0, 0.0)
            g = _softmax(x @ w + b)
            g[y[i]] -= 1
            gx = x[:, None] * g
            z[ids] = zi + gx - (np.sqrt(ni + gx * gx) - np.sqrt(ni)) / alpha * w
            n2[ids] = ni + gx * gx
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
    model = Model(langs, (weights(z, n2) * (idf * _SCALE)[:, None]).astype(np.float32), weights(zb, nb, 0.0, 0.0), df > 0)
    if tune:
        held = sorted(tune)
        logits = np.concatenate([model.logits([texts[i] for i in held[at : at + 64]])[0] for at in range(0, len(held), 64)])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        # Targets as Platt smooths them: a sample without an error does not make the model certain.
        doubt = 1 / (len(held) + 2)
        target = np.full((len(held), k), doubt / max(1, k - 1))
        target[np.arange(len(held)), y[held]] = 1 - doubt
        loss = [-(target * np.log(_softmax(logits / t) + 1e-300)).sum(axis=1).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def sample(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> tuple[list[str], list[str]]:
    """Texts and labels of about ``per_lang`` rows of each language among those that ``learn`` admits; equal texts once."""
    labelled = docs.where(learn & F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    share = docs.sparkSession.createDataFrame([(k, min(1.0, per_lang / n)) for k, n in counts.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 24)) / (1 << 24)
    drawn = labelled.join(F.broadcast(share), "lang").where((draw < F.col("share")) & (F.octet_length("text") <= LONGEST_LEARNED)).select("lang", "text", "id")
    rows = drawn.limit(2 * per_lang * len(counts)).collect()
    once = {r["text"]: r["lang"] for r in sorted(rows, key=lambda r: (str(r["id"]), r["text"] or "")) if r["text"] and _LETTER.search(r["text"])}
    return list(once), list(once.values())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2^16 rows of one weight per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = np.full(b.num_rows, "und", dtype=object), np.zeros(b.num_rows)
            texts = b.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if shared.value else []
            if known:
                best, p, _ = shared.value.predict([texts[i] for i in known])
                lang[known], score[known] = np.array(shared.value.langs, dtype=object)[best], p
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    prepare(spark)
    kept = keyed_text(docs, id_col, text_col)
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fitted on the rows whose crc32(id) mod 4 is not 2, applied to all."""
    aside = held_out(F.col(f"`{id_col}`"), 4, 2)
    model = fit(*sample(docs, ~aside, id_col, text_col, lang_col))
    return predict(docs, model, id_col, text_col).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.3, least_known: float = LEAST_KNOWN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows of no determined language.

    These are texts without a letter, of a score below ``least``, or with less
    than ``least_known`` of their n-grams known from the sample: other scripts,
    random letters.
    """
    aside = held_out(F.col(f"`{id_col}`"), 4, 2)
    model = fit(*sample(docs, ~aside, id_col, text_col, lang_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if shared.value else []
            if known:
                _, p, share = shared.value.predict([texts[i] for i in known])
                yield b.take(pa.array([i for i, x, s in zip(known, p, share) if x >= least and s >= least_known], pa.int32()))

    prepare(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
