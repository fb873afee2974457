"""Packing, audio, chat, WARC and SentencePiece: round trips, the libraries themselves, brute force."""

import collections
import hashlib
import io
import os
import wave
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeprofile.llm import chat, chroma, lattice, packing, queries, warc

SF = "/root/testdata/sf0.01"
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")

# --- packing ----------------------------------------------------------------


def contents(plan):
    got = collections.Counter()
    for pattern, copies in plan:
        for size, k in pattern.items():
            got[size] += k * copies
    return got


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=30))
@settings(deadline=None, max_examples=60)
def test_plan_holds_every_piece_once(histogram):
    plan = packing.solve(histogram, 64, rounds=20)
    assert contents(plan) == histogram and all(sum(s * k for s, k in p.items()) <= 64 and n > 0 for p, n in plan)


def test_plan_is_near_the_bound():
    lengths = np.clip(np.random.default_rng(1).lognormal(6.6, 1.1, 60_000).astype(int), 1, 4096)
    plan = packing.solve({int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))})
    assert sum(n for _, n in plan) <= 1.002 * -(-lengths.sum() // 4096)


def test_the_program_places_nearly_all_pieces(monkeypatch):
    rest, best_fit = [], packing._best_fit
    monkeypatch.setattr(packing, "_best_fit", lambda left, capacity: rest.append(sum(left.values())) or best_fit(left, capacity))
    lengths = np.clip(np.random.default_rng(4).lognormal(5.0, 1.1, 5_000).astype(int), 1, 1024)  # counts of few each, as of real tables
    for many in (1, 30):
        histogram = {int(k): int(v) * many for k, v in zip(*np.unique(lengths, return_counts=True))}
        plan = packing.solve(histogram, 1024)
        assert contents(plan) == histogram and sum(n for _, n in plan) <= 1.002 * -(-lengths.sum() * many // 1024) + 1
        assert rest.pop() <= 0.05 * sum(histogram.values())


def test_knapsack_is_exact():
    r = np.random.default_rng(2)
    for _ in range(20):
        sizes, worth, most = np.sort(r.choice(np.arange(2, 20), 5, False)), r.random(5), r.integers(1, 5, 5).astype(float)
        p = packing._best_pattern(sizes, worth, most, 40)
        value = lambda p: sum(worth[list(sizes).index(s)] * k for s, k in p.items())
        best = np.zeros(41)
        for s, w, m in zip(sizes, worth, most):
            for _ in range(int(m)):
                best[s:] = np.maximum(best[s:], best[:-s] + w)
        assert sum(s * k for s, k in p.items()) <= 40 and value(p) == pytest.approx(best[40])


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    own, library = packing.WordIds(WORDS), Tokenizer.from_file(WORDS)
    for text in ("", "Hello, World's END...", "it's 42nd café ÉCOLE", "a<|endoftext|>b", "x\x1cy\x85z\xa0w", "ǅ ẞ İ Σίσυφος 你好 é H̱", "Ω K"):
        assert own(text) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


ODD = [(1, None, 7), (2, "", 7), (2, "", 7), (3, "a b " * 3000, 7), (None, "x", 7), (4, "y" * 50_000, None)]


def test_packing_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, sequence_id int")
    rows = packing.pack(df, WORDS).collect()
    assert {(r["doc_id"], r["length"]) for r in rows} >= {(1, 1), (2, 1), (3, 4096), (3, 6001 - 4096)}
    assert collections.Counter(r["doc_id"] for r in rows)[2] == 2
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in map(sorted, by.values()):
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
    assert packing.pack(df.where("false"), WORDS).count() == 0


@needs_tables
def test_packing_of_documents(spark):
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(WORDS), collections.Counter()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in docs.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 4096):
            part = np.array(ids[at : at + 4096], dtype="<u4").tobytes()
            want[r["doc_id"], at // 4096, at, len(part) // 4, zlib.crc32(part)] += 1
    rows = packing.pack(docs, WORDS).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * sum(r["length"] for r in rows) / 4096 + 1


# --- audio ------------------------------------------------------------------


def recording(seed, n=64):
    return chroma.melody(list(np.random.default_rng(seed).normal(0, 0.125, n)))


def as_wav(samples):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(chroma.RATE)
        w.writeframes((samples / np.abs(samples).max() * 20_000).astype("<i2").tobytes())
    return out.getvalue()


def test_integral_image_equals_sums():
    image = chroma.chroma(recording(1))
    code = 0
    for kind, p, height, width in chroma.FILTERS:
        block = image[:width, p : p + height]
        mask = np.zeros((width, height))
        if kind == 1:
            mask[:, : height // 2] = 1
        elif kind == 2:
            mask[: width // 2] = 1
        elif kind == 3:
            mask[: width // 2, : height // 2] = mask[width // 2 :, height // 2 :] = 1
        elif kind == 4:
            mask[width // 3 : width - width // 3] = 1
        else:
            mask[:, height // 3 : height - height // 3] = 1
        x = 2 * ((block * mask).sum() - mask.mean() * block.sum()) / block.sum()
        code = code << 2 | int(chroma._GRAY[np.searchsorted(chroma._CUTS, x, side="right")])
    assert code == chroma.codes(recording(1))[0]


def test_alignment_finds_noisy_shifted_copies(spark):
    r = np.random.default_rng(9)
    media, planted = [(i, as_wav(recording(i))) for i in range(0, 300)], {}
    for n in range(40):
        source, shift = 50 * (n % 6), int(r.integers(0, 12))
        clean = recording(source)
        media.append((1001 + n, as_wav((clean + r.normal(0, 0.1, len(clean)))[shift * chroma.HOP :])))
        planted[1001 + n] = (source, -shift)
    rows = {x["media_id"]: x for x in chroma.search(spark.createDataFrame(media, "id long, sound binary"), "id", "sound").collect()}
    hits = sum((rows[i]["best_query"], rows[i]["best_offset"]) == want for i, want in planted.items())
    assert hits >= 0.9 * len(planted) and len(rows) == len(media)
    # brute force over all query recordings and offsets
    codes = {i: chroma.codes(chroma.wav(s)) for i, s in media}
    want, got = 0, 0
    for q in range(0, 300, 50):
        for i in codes:
            if i != q and not i % 50 == 0:
                best = min((np.bitwise_count(codes[q][max(0, -o) : len(codes[i]) - o] ^ codes[i][max(0, o) :][: len(codes[q][max(0, -o) : len(codes[i]) - o])]).mean() / 32, o) for o in range(-12, 13))
                if best[0] <= chroma.MOST_ERROR:
                    want += 1
                    got += rows[i]["n_links"] > 0
    assert want >= 30 and got >= 0.9 * want


def test_audio_of_odd_rows(spark):
    df = spark.createDataFrame([(50, None), (51, b"noise"), (51, b"noise"), (None, as_wav(recording(1))), (52, as_wav(recording(1))), (53, as_wav(np.ones(9000)))], "id long, sound binary").withColumn("class_id", F.lit("x"))
    rows = chroma.search(df, "id", "sound").collect()
    assert len(rows) == 6 and {r["n_links"] for r in rows} == {0}
    assert {r["media_id"]: r["class_id"] for r in rows if r["n_codes"]} == {None: 52, 52: 52} | ({53: 53} if len({r["class_id"] for r in rows}) > 2 else {})
    assert chroma.search(df.where("false"), "id", "sound").count() == 0


# --- chat -------------------------------------------------------------------


def digests(rows):
    turns = "".join(f"{role}\n{text}\n" for role, text in rows)
    loss = "".join(t for role, t in rows if role == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>", "\\<|im_start|>\\\\", "<\\|im_sep|>", "[\\INST] \\", "<<SYS>>\n<</SYS>>", "", "é𝄞" * 40, "\\\\\\", "<|<|[INST][/INST]<s>"]


def test_chat_round_trip(spark):
    talks = {c: [("system", NASTY[c % 10])] * (c % 2) + [(("user", "assistant")[n % 2], NASTY[(c + n) % 10] + " word" * ((c * n) % 900)) for n in range(c)] for c in range(1, 25)}
    rows = [(c, n, role, text) for c, t in talks.items() for n, (role, text) in enumerate(t)]
    got = chat.read_back(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == {c: digests(t) for c, t in talks.items()}


def test_windows_keep_the_budget_and_repeat_history(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, n, ("assistant", "user")[n % 2], f"turn {n} " + "x" * 300) for n in range(1, 120)]
    w = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("window").collect()
    assert len(w) > 3
    for r in w:
        turns = r["formatted"].split(chat.END)[:-1]
        assert turns[0].endswith("be brief") and sum(-(-len(t.split(chat.SEP)[1]) // 4) + chat.OVERHEAD for t in turns) <= chat.BUDGET
        assert all(r["formatted"][a:b].startswith("turn") for a, b in r["loss"])
    assert {r["repeated"] for r in w[1:]} == {1 + chat.HISTORY_TURNS} and w[0]["repeated"] == 0
    assert sum(len(r["loss"]) for r in w) == sum(x[2] == "assistant" for x in rows)


def test_a_long_turn_shortens_no_other_window(spark):
    short = [(1, n, ("user", "assistant")[n % 2], "word " * 10) for n in range(40)]
    long = [(*r[:3], "x" * 12_000) if r[1] == 20 else r for r in short]
    count = lambda rows: chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count()
    assert count(short) == 1 and count(long) == 3


def test_chat_of_odd_rows(spark):
    rows = [(None, 0, "user", None), (1, None, None, "x"), (1, 0, "assistant", None), (1, 0, "assistant", None), (2, 0, "system", "only"), (3, 5, "assistant", "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("w")).withColumn("n", F.lit(0))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(chat.windows(df)).collect()}
    assert got == {None: digests([("user", "")]), 1: digests([("", "x"), ("assistant", ""), ("assistant", "")]), 2: digests([("system", "only")]), 3: digests([("assistant", "y" * 100_000)])}
    assert chat.windows(df.where("false")).count() == 0
    assert "Python" not in chat.windows(df)._jdf.queryExecution().executedPlan().toString()


# --- WARC -------------------------------------------------------------------


def test_warc_of_odd_rows(spark):
    long, late = "é" * 600, "z" * 999
    rows = [(1, "http://a/", long), (2, "http://b/\r\nX: y", long), (3, None, long), (4, "u", late), (5, "u", late), (6, "u", None), (7, "u", ""), (8, "u", "x" * 9_000_000), (3, None, long), (9, "u", "a\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    want = sorted([(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if i in (1, 2) else "response", 3 if i in (1, 2) else None) for i, _, h in rows], key=str)
    assert got == want and warc.round_trip(df.where("false")).count() == 0


def test_record_ids_are_unique_and_page_ids_of_any_type(spark):
    import gzip
    import re

    long = "p" * 2000
    df = spark.createDataFrame([("a", "u", long), ("b é\n", "u", long), (None, "u", "x"), (None, "u", "x"), ("a", "u", "y"), ("a", "u", "y")], "page_id string, url string, html string")
    index = warc.write(warc.decide(df))
    rows = warc.read(index).collect()
    assert sorted((r["page_id"] or "", r["record_type"], r["refers_to"] or "") for r in rows) == sorted([("a", "revisit", "b é\n"), ("b é\n", "response", ""), ("", "response", ""), ("", "response", ""), ("a", "response", ""), ("a", "response", "")])
    names = [m for r in index.select("archive").distinct().collect() for m in re.findall(rb"WARC-Record-ID: (\S+)", gzip.open(r[0].removeprefix("file:")).read())]
    assert len(names) == len(set(names)) == 6


def test_selected_records_and_payloads(spark):
    df = spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.concat(F.lit("p"), F.repeat(F.col("id").cast("string"), 50)).alias("html"))
    index = warc.write(warc.decide(df))
    rows = warc.read(index.where("page_id % 17 = 3")).collect()
    assert {r["page_id"]: (r["url"], bytes(r["payload"]).decode()) for r in rows} == {r["page_id"]: (r["url"], r["html"]) for r in df.where("page_id % 17 = 3").collect()}


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 90)), max_size=30), st.integers(0, 40), st.integers(50, 300))
def test_ranges_cover_each_record_once(steps, gap, most):
    rows, at = [], 0
    for skip, n in steps:
        rows.append((at + skip, n))
        at += skip + n
    groups = list(warc.coalesce_ranges(rows, gap, most))
    assert [r for g in groups for r in g] == rows
    for g in groups:
        assert len(g) == 1 or g[-1][0] + g[-1][1] - g[0][0] <= most
        assert all(b[0] - a[0] - a[1] <= gap for a, b in zip(g, g[1:]))


# --- SentencePiece ----------------------------------------------------------

TEXTS = [None, "", " ", "Hello  world\nagain ", "c▁d 你好 𝄞 " + "x" * 80 + " " * 60 + "z", "abcabc" * 60, "<s> <0x0A> </s>", "naïve Straße 1234567", "\n\n\ta"]


def best_sum(text):
    """Ids of the path of the greatest sum, unit by unit, straight from the library's piece table."""
    plain, _, first = lattice.vocabulary(PIECES)
    known, out = {p: (i, s) for p, i, s in plain}, []
    unknown = min(s for _, s in known.values()) - lattice.UNKNOWN
    for u in (x.replace(" ", lattice.SPACE) for x in lattice.units_of(text or "")):
        best = [(0.0, [])]
        for stop in range(1, len(u) + 1):
            into = [(best[a][0] + known[u[a:stop]][1], stop - a, best[a][1] + [known[u[a:stop]][0]]) for a in range(max(0, stop - 16), stop) if u[a:stop] in known]
            into.append((best[stop - 1][0] + unknown, 1, best[stop - 1][1] + [first + x for x in u[stop - 1].encode()]))
            score, _, ids = max(into)
            best.append((score, ids))
        out += best[-1][1]
    return out


def test_encoding_takes_the_best_sum_and_decodes(spark, monkeypatch):
    words = " ".join("".join(np.random.default_rng(i).choice(list("aeéintr's."), 1 + i % 30)) for i in range(800))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, *TEXTS[3:5], words])], "k int, text string").withColumn("ids", F.lit("x")).withColumn("row", F.lit(1))
    for frequent in (lattice.FREQUENT, 3):
        monkeypatch.setattr(lattice, "FREQUENT", frequent)
        rows = lattice.encode(df, PIECES).collect()
        assert len(rows) == len(TEXTS) + 3 and all(r["piece_ids"] == best_sum(r["text"]) and r["ids"] == "x" for r in rows)
    said = lattice.decode(lattice.encode(df, PIECES), PIECES).collect()
    assert all(r["decoded"] == (r["text"] or "").replace(lattice.SPACE, " ") for r in said)
    back = lattice.round_trip(df, PIECES, ["k"]).collect()
    assert all(r["round_trip"] for r in back) and {r["k"]: r["ids_crc32"] for r in back} == {r["k"]: zlib.crc32(np.array(r["piece_ids"], dtype="<u4").tobytes()) for r in rows}
    assert lattice.encode(df.where("false"), PIECES).count() == 0


def test_encoding_moves_no_text_and_writes_nothing(spark, monkeypatch):
    from pathlib import Path

    from lakeprofile.llm.common import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = sorted(shared.rglob("*"))
    words = [" ".join(f"w{i * j % 997}é{'x' * (i % 7)}" for j in range(40)) for i in range(8)]
    said = {t: np.array(best_sum(t), dtype="<u4").tobytes() for t in [*TEXTS, *words, "ab" * 2000]}
    texts = [*said] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3).localCheckpoint()
    for frequent in (lattice.FREQUENT, 100):  # all units kept, and some batches' units made anew
        monkeypatch.setattr(lattice, "FREQUENT", frequent)
        found = lattice.round_trip(df, PIECES, ["k"])
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r["k"]: (r["n_ids"], r["ids_crc32"]) for r in found.collect()} == {k: (len(said[t]) // 4, zlib.crc32(said[t])) for k, t in enumerate(texts)}
    assert sorted(shared.rglob("*")) == before


def test_lattices_of_any_cut_have_the_same_paths(monkeypatch):
    table = lattice.suffixes(PIECES)
    texts = [*TEXTS, "▁▁".join("aé你𝄞b" * i for i in range(40))]
    want = {t: np.array(best_sum(t), dtype="<i4").tobytes() for t in texts}
    for chars, block in ((lattice._CHARS, lattice._BLOCK), (1, 1), (50, 7), (lattice._CHARS, 1), (300, 64)):
        monkeypatch.setattr(lattice, "_CHARS", chars)
        monkeypatch.setattr(lattice, "_BLOCK", block)
        ids = lattice.encode_units(list({u for t in texts for u in lattice.units_of(t)}), table)
        assert all(b"".join(ids[u] for u in lattice.units_of(t)) == want[t] for t in texts)
    assert lattice.encode_units([], table) == {}


@given(st.text(alphabet="ab \n▁", max_size=30))
def test_units_are_those_of_the_pattern(text):
    want = lattice._UNITS.findall(" " + text.replace(lattice.SPACE, " ")) if text else []
    assert lattice.units_of(text) == want and "".join(want) == (" " + text.replace(lattice.SPACE, " ") if text else "")


def test_merged_lattice_equals_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = lattice.encode(spark.createDataFrame([(t,) for t in TEXTS], "text string"), PIECES, fold=lattice.merged).collect()
    assert all(r["piece_ids"] == sp.encode(r["text"] or "") for r in rows)


def test_every_operator_has_a_query():
    assert len(queries.QUERIES) == 10
