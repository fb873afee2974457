"""Secret scanning with DataFrame functions only.

Three base rules find assignments, access keys and hex strings.  To them the
entropy rule adds spans: over each candidate string a window slides whose
Shannon entropy follows from counts that each step changes by one character in
and one out; windows at or over the threshold of the candidate's character
class merge into spans, unless an allow list knows the candidate or what stands
before it.  Base spans are never suppressed.

Positions come from splitting a text at the matches of a pattern: the lengths
of pieces and matches, summed, are the starts.  Everything is local to a row:
no shuffle, no Python.

Defined cases: a null text is an empty one; an empty text has no spans; all
offsets count code points, ends are exclusive; rows are independent, so repeated
rows repeat their result; other columns are ignored by ``find`` and kept by
``redact``.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # what follows AKIA is one run, so the length may stand in the pattern
HEX = r"[0-9a-f]{16,}"  # likewise
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: A candidate is a maximal run of these.
_RUN = "[A-Za-z0-9+/_-]{%d,}"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Least bits a character in a window: (class, pattern of the whole candidate, threshold); the first that fits counts.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$|^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", 3.5),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+$", 3.8),
    ("letters", r"^(?=.*[a-z].*[A-Z])[A-Za-z+/_-]+$", 3.85),
    ("joined", r"^(?=.*[0-9])(?=.*[A-Za-z])[a-z0-9+/_-]+$|^(?=.*[0-9])(?=.*[A-Za-z])[A-Z0-9+/_-]+$", 3.9),
)
#: What every candidate that fits a class has.
_ANY_CLASS = r"[0-9]|[a-z].*[A-Z]"
#: Candidates that are no secrets: UUIDs, placeholders, one piece over and over, the alphabet in order.
ALLOWED = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$|(?i:example|sample|dummy|placeholder|changeme|redacted|xxxxx|lorem)|^(.{1,8})\2+$|(?i:abcdefghij|0123456789)"
#: Public digests and revisions say so before the value; the run between is possessive, so a long one costs its length once.
ALLOWED_BEFORE = r"""(?i:sha-?\d{1,3}|md5|checksum|digest|integrity|etag|commit|revision|uuid|guid)["']?[\s:=-]*+["']?$"""


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.transform(F.array(value), body)[0]


def _starts(pieces: Column, matches: Column) -> Column:
    """array<int>: where each match starts."""
    sizes = F.transform(matches, lambda m, i: F.struct(F.length(pieces[i]).alias("gap"), F.length(m).alias("len")))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(sizes, state, lambda a, s: F.struct((a["at"] + s["gap"] + s["len"]).alias("at"), F.array_append(a["starts"], a["at"] + s["gap"]).alias("starts")), lambda a: a["starts"])


_SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _base(text: Column, pattern: str, kind: int, least: int | None = None) -> Column:
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(m: Column) -> Column:
        pieces, long_enough = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else m
        found = _let(_starts(pieces, m), lambda s: F.transform(m, lambda x, i: F.struct(s[i].alias("start"), F.lit(kind).alias("kind"), (s[i] + F.length(x)).alias("stop"), F.length(long_enough[i]).alias("size"))))
        found = F.filter(found, lambda x: x["size"] >= (least or 0))
        return F.transform(found, lambda x: F.struct(x["start"], x["kind"], x["stop"])).cast(_SPANS)

    return _let(matches, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(F.array().cast(_SPANS)))


def _nlogn(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k * log2(k) if k else 0.0) for k in range(WINDOW + 2)]), n + 1)


def windows(candidate: Column, threshold: Column) -> Column:
    """array<struct<a,b>>: merged windows of ``candidate`` whose entropy is at least ``threshold``.

    The state holds the count of each character and the sum of n log2 n over
    them; a step adds one character and drops one, and the entropy is
    log2(WINDOW) - sum / WINDOW.
    """
    codes = F.transform(F.split(candidate, "(?<=.)(?=.)", -1), lambda c: F.instr(F.lit(_ALPHABET), c) - 1)
    pair = "struct<a:int,b:int>"
    state = F.struct(
        F.array_repeat(F.lit(0), len(_ALPHABET)).alias("counts"),
        F.lit(0.0).alias("total"),
        F.lit(-1).alias("a"),  # of the open span; -1: none is open
        F.lit(-1).alias("b"),
        F.array().cast(f"array<{pair}>").alias("done"),
    )

    def shut(acc: Column) -> Column:
        return F.when(acc["a"] < 0, acc["done"]).otherwise(F.array_append(acc["done"], F.struct(acc["a"].alias("a"), acc["b"].alias("b")).cast(pair)))

    def fold(chars: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            into = chars[i]
            out = F.when(i >= WINDOW, chars[F.greatest(i - WINDOW, F.lit(0))]).otherwise(F.lit(-1))

            def moved(io: Column) -> Column:
                k, d = io["into"], io["out"]
                more, less = acc["counts"][k], acc["counts"][F.greatest(d, F.lit(0))]
                total = F.when(k == d, acc["total"]).otherwise(acc["total"] + _nlogn(more + 1) - _nlogn(more) + F.when(d >= 0, _nlogn(less - 1) - _nlogn(less)).otherwise(0.0))
                counts = F.when(k == d, acc["counts"]).otherwise(F.transform(acc["counts"], lambda n, at: n + (at == k).cast("int") - (at == d).cast("int")))

                def settle(t: Column) -> Column:
                    high = (i >= WINDOW - 1) & (F.lit(log2(WINDOW)) - t / WINDOW >= threshold)
                    first, joins = i - WINDOW + 1, acc["b"] >= i - WINDOW + 1
                    return F.struct(
                        counts.alias("counts"),
                        t.alias("total"),
                        F.when(high & ~joins, first).otherwise(acc["a"]).alias("a"),
                        F.when(high, i + 1).otherwise(acc["b"]).alias("b"),
                        F.when(high & ~joins, shut(acc)).otherwise(acc["done"]).alias("done"),
                    )

                return _let(total, settle)

            return _let(F.struct(into.alias("into"), out.alias("out")), moved)

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), state, step, shut)

    return _let(codes, fold)


def _entropy(text: Column) -> Column:
    pattern = _RUN % WINDOW
    none = F.array().cast(_SPANS)

    def spans(m: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        threshold = lambda c: F.coalesce(*[F.when(c.rlike(p), F.lit(t)) for _, p, t in CLASSES])
        found = _let(
            F.struct(_starts(pieces, m).alias("starts"), pieces.alias("pieces")),
            lambda s: F.transform(m, lambda c, i: F.struct(s["starts"][i].alias("at"), c.alias("run"), s["pieces"][i].alias("before"), threshold(c).alias("bits"))),
        )
        found = F.filter(found, lambda x: x["bits"].isNotNull() & ~x["run"].rlike(ALLOWED) & ~x["before"].rlike(ALLOWED_BEFORE))
        return F.flatten(F.transform(found, lambda x: F.transform(windows(x["run"], x["bits"]), lambda w: F.struct((x["at"] + w["a"]).alias("start"), F.lit(3).alias("kind"), (x["at"] + w["b"]).alias("stop"))))).cast(_SPANS)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.exists(m, lambda c: c.rlike(_ANY_CLASS)), spans(m)).otherwise(none))


def spans_of(text: Column) -> Column:
    """array<struct<start,kind,stop>> of all spans of ``text``, in order; kind is the place in ``KINDS``."""
    base = F.array_sort(F.concat(_base(text, ASSIGN, 0, 12), _base(text, ACCESS, 1), _base(text, HEX, 2)))
    return _let(
        F.struct(base.alias("base"), _entropy(text).alias("more")),
        lambda s: F.array_sort(F.concat(s["base"], F.filter(s["more"], lambda x: ~F.exists(s["base"], lambda b: (b["start"] <= x["start"]) & (b["stop"] >= x["stop"]))))),
    )


def _spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy), one row per row of ``docs``.

    ``spans`` lists kind:start:stop by start, then kind, comma-joined;
    ``base_sha256`` is the digest of that list without the entropy spans.
    """
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), spans_of(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("found"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_spelled(F.filter("found", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        _spelled(F.col("found")).alias("spans"),
        count(3).alias("n_entropy"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by ``mark``; texts without spans, null ones included, stay as they are."""
    text = F.col(f"`{text_col}`")
    pair = "struct<start:int,stop:int>"

    def widened(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        apart = F.array_append(acc, F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
        return F.when(F.size(acc) == 0, apart).when(last["stop"] >= x["start"], F.array_append(F.slice(acc, 1, F.size(acc) - 1), joined)).otherwise(apart).cast(f"array<{pair}>")

    def rewritten(found: Column) -> Column:
        merged = F.aggregate(found, F.array().cast(f"array<{pair}>"), widened)

        def pieces(m: Column) -> Column:
            before = lambda i: F.when(i > 0, m[F.greatest(i - 1, F.lit(0))]["stop"]).otherwise(F.lit(0))
            parts = F.transform(m, lambda x, i: F.concat(text.substr(before(i) + 1, x["start"] - before(i)), F.lit(mark)))
            tail = text.substr(F.element_at(m, -1)["stop"] + 1, F.length(text))
            return F.concat(F.array_join(parts, ""), tail)

        return _let(merged, pieces)

    return docs.withColumn(text_col, _let(spans_of(F.coalesce(text, F.lit(""))), lambda s: F.when(F.size(s) > 0, rewritten(s)).otherwise(text)))
