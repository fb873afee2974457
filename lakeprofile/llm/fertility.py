"""Quality rules: counts of words, symbols and repeats, and tokeniser fertility in bands per script.

Two public vocabularies measure a text's words: characters per token of each,
the share of byte-fallback tokens, and the entropy of the token distribution
against what a text of that many tokens can have; characters per token are
measured without the words that hold digits, too.  Each script has a band for
each measure; a text outside one is rejected.  The bands are parameters, not
statistics of the corpus: a row is judged alike in any corpus and at any length,
and no shuffle is needed.  Their lower ends lie between what prose measures and
what random letters do, so that gibberish falls outside.

Defined cases: a null or empty text has no words and fails the base rule; characters of
no script count as ``Other``, whose band admits most, but not bare numbers; repeated rows and rows
without an id are judged like others; an empty table gives an empty result;
other columns are ignored by ``measure`` and kept by ``well_formed``.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lakeprofile.llm.common import keyed_text, prepare

LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Characters per token that a text without letters has at least, unless it is in a script the pieces do not know.
LEAST_PLAIN = 1.0
_SYMBOLS = b"#*$%&|<>"
_DELETE = bytes(c for c in range(256) if c not in _SYMBOLS)
_NO_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
#: Words that a worker remembers before it starts afresh.
_REMEMBERED = 600_000
_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai")
_SCRIPT = {s: regex.compile(rf"\p{{{s}}}") for s in _SCRIPTS}

#: script: (least and most characters per token by the piece vocabulary, the same by the byte vocabulary,
#: most share of byte-fallback tokens, least entropy as a share of the most possible)
BANDS: dict[str, tuple[float, float, float, float, float, float]] = {
    "Latin": (1.4, 8.0, 1.2, 8.0, 0.10, 0.35),
    "Cyrillic": (1.2, 8.0, 0.6, 8.0, 0.10, 0.45),
    "Greek": (0.6, 6.0, 0.5, 6.0, 0.30, 0.40),
    "Arabic": (0.5, 6.0, 0.4, 6.0, 0.50, 0.35),
    "Hebrew": (0.5, 6.0, 0.4, 6.0, 0.50, 0.35),
    "Devanagari": (0.3, 5.0, 0.2, 5.0, 0.90, 0.25),
    "Han": (0.3, 3.0, 0.25, 3.0, 0.90, 0.30),
    "Hiragana": (0.3, 4.0, 0.25, 4.0, 0.90, 0.30),
    "Katakana": (0.3, 4.0, 0.25, 4.0, 0.90, 0.30),
    "Hangul": (0.3, 4.0, 0.25, 4.0, 0.95, 0.30),
    "Thai": (0.3, 5.0, 0.2, 5.0, 0.95, 0.25),
    "Other": (0.25, 16.0, 0.2, 16.0, 1.0, 0.20),
}

#: script: least characters per token, by the piece vocabulary, of the words without digits; keys and numbers are no prose.
LEAST_PROSE = {"Latin": 1.69, "Cyrillic": 1.2}

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens long, chars_per_piece double, chars_per_byte_token double, byte_share double, entropy_share double, chars_per_prose_token double"


class Vocabularies:
    """For a word, its piece ids as bytes and the number of its byte-level tokens; remembered within a bound."""

    def __init__(self, pieces: str, ranks: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.bytes = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.ids: dict[bytes, bytes] = {}
        self.counts: dict[bytes, int] = {}
        self.digits: set[bytes] = set()

    def learn(self, words: set[bytes]) -> None:
        """Tokenise those of ``words`` that are not remembered, all at once."""
        if len(self.ids) > _REMEMBERED:
            self.ids.clear()
            self.counts.clear()
            self.digits.clear()
        new = [w for w in words if w not in self.ids]
        texts = [w.decode("utf-8", "replace") for w in new]
        pack, width = struct.pack, [f"<{n}H" for n in range(256)]
        self.ids.update(zip(new, (pack(width[len(x)] if len(x) < 256 else f"<{len(x)}H", *x) for x in self.pieces.encode(texts, num_threads=1))))
        self.digits.update(w for w in new if w.translate(None, _NO_DIGITS))
        encode = self.bytes.encode_ordinary
        self.counts.update(zip(new, [len(encode(" " + t)) for t in texts]))

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, int]:
        """The piece ids of learned ``words``, and the number of their byte-level tokens."""
        return np.frombuffer(b"".join(map(self.ids.__getitem__, words)), dtype="<u2"), sum(map(self.counts.__getitem__, words))


_LOADED: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(pieces: str, ranks: str) -> Vocabularies:
    if (pieces, ranks) not in _LOADED:
        _LOADED[pieces, ranks] = Vocabularies(pieces, ranks)
    return _LOADED[pieces, ranks]


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line.split():
            n += line in seen
            seen.add(line)
    return n


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that the text has twice or more.

    Windows compare as 128-bit hashes of their words' numbers.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers = dict(zip(words, range(len(words))))
    if len(numbers) == len(words):
        return 0
    ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.uint64, count=len(words))

    def mixed(salt: int, factor: int) -> np.ndarray:
        x = (ids + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(window):
            h = h * np.uint64(factor) + x[k : k + n]
        return h

    pairs = np.empty(n, dtype=[("a", np.uint64), ("b", np.uint64)])
    pairs["a"], pairs["b"] = mixed(1, 0xD6E8FEB86659FD93), mixed(0x5851F42D, 0xA0761D6478BD642F)
    order = np.argsort(pairs["a"], kind="stable")
    by = pairs["a"][order]
    if not (by[1:] == by[:-1]).any():
        return 0
    _, inverse, count = np.unique(pairs, return_inverse=True, return_counts=True)
    twice = np.concatenate([(count[inverse] > 1).astype(np.int64), np.zeros(window, dtype=np.int64)])
    starts = np.cumsum(twice)
    starts[window:] -= starts[:-window].copy()
    return int((starts[: len(words)] > 0).sum())


def script_of(text: str) -> str:
    """The script of most letters, by sampling none: every letter counts."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else "Other"
    found = [s for s, r in _SCRIPT.items() if r.search(text)]
    if len(found) < 2:
        return found[0] if found else "Other"
    counts = {s: len(_SCRIPT[s].findall(text)) for s in found}
    return max(counts, key=counts.get)


def measures_of(text: str, raw: bytes, words: list[bytes], vocabulary: Vocabularies) -> tuple:
    """The measures of one text, given as characters, as bytes and as words that ``vocabulary`` has learned."""
    chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\v\f\r")))
    symbols = len(raw.translate(None, _DELETE))
    ids, byte_tokens = vocabulary(words)
    n = len(ids)
    entropy = 0.0
    if n > 1:
        p = np.bincount(ids)
        p = p[p > 0] / n
        entropy = float(-(p * np.log2(p)).sum() / np.log2(n))
    mixed = [w for w in words if w in vocabulary.digits]
    prose = n - sum(len(vocabulary.ids[w]) for w in mixed) // 2
    prose_chars = chars - sum(len(w.decode("utf-8", "replace")) for w in mixed)
    fallback = float(vocabulary.fallback[ids].mean()) if n else 0.0
    return len(words), chars, symbols, duplicate_lines(raw), repeated_words(words), script_of(text), n, chars / n if n else 0.0, chars / byte_tokens if byte_tokens else 0.0, fallback, entropy, prose_chars / prose if prose else 0.0


def measured(column: pa.Array, vocabulary: Vocabularies) -> Iterator[tuple]:
    """``measures_of`` each text of a column."""
    raws = [r or b"" for r in column.cast(pa.binary()).to_pylist()]
    split = [r.split() for r in raws]
    vocabulary.learn(set().union(*split))
    for text, raw, words in zip(column.to_pylist(), raws, split):
        yield measures_of(text or "", raw, words, vocabulary)


def verdict(m: tuple, bands: dict[str, tuple] = BANDS) -> tuple[bool, bool]:
    """(base_failed, kept) of ``measures_of``."""
    n_words, _, _, _, repeats, script, n, by_piece, by_byte, fallback, entropy, by_prose = m
    failed = n_words < LEAST_WORDS or 100 * repeats > REPEAT_PERCENT * n_words
    if failed:
        return True, False
    low, high, low_b, high_b, most_bytes, least_entropy = bands.get(script, BANDS["Other"])
    if script == "Other" and fallback < 0.5:  # not an unknown script but digits or marks
        low = max(low, LEAST_PLAIN)
    if 0 < by_prose < LEAST_PROSE.get(script, 0.0):
        return False, False
    return False, low <= by_piece <= high and low_b <= by_byte <= high_b and fallback <= most_bytes and entropy >= least_entropy


def measure(docs: DataFrame, pieces: str, ranks: str, id_col: str = "doc_id", text_col: str = "text", bands: dict[str, tuple] = BANDS) -> DataFrame:
    """The measures, base_failed and kept of each row of ``docs``."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[t]) for n, t in (x.split() for x in MEASURES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabularies(pieces, ranks)
        for b in batches:
            found = list(measured(b.column(1), vocabulary))
            judged = [verdict(m, bands) for m in found]
            columns = [pa.array(c, schema.field(k).type) for k, c in enumerate(zip(*found))] if found else [pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array([x[0] for x in judged], pa.bool_()), pa.array([x[1] for x in judged], pa.bool_())], names=["doc_id", *names, "base_failed", "kept"])

    prepare(docs.sparkSession)
    kept = keyed_text(docs, id_col, text_col)
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, {MEASURES}, base_failed boolean, kept boolean")


def well_formed(docs: DataFrame, pieces: str, ranks: str, text_col: str = "text", bands: dict[str, tuple] = BANDS) -> DataFrame:
    """``docs`` without the rows that the rules reject."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabularies(pieces, ranks)
        for b in batches:
            judged = (verdict(m, bands)[1] for m in measured(b.column(text_col), vocabulary))
            yield b.take(pa.array([i for i, k in enumerate(judged) if k], pa.int32()))

    prepare(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
