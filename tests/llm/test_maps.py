"""Packing, media columns and chat formatting on small tables with every odd case, against brute force."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, media, packing

TEXTS = [None, "", "a", "Hello, world! " * 3000, "tabs\tand\nnewlines \x1c odd\x85 spaces", "é́ combining ́x", "<|endoftext|> kept", "x" * 20000, "same", "same", "日本 語 9 8 it's", " lead", "naïve Straße."]
DOCS = "doc_id long, text string, id string, content int, ids int, wav int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1, 2, 3) for i, t in enumerate(TEXTS)], DOCS).repartition(3, "doc_id").cache()


def brute_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_packing_is_whole_and_without_padding(docs):
    rows = packing.packed_documents(docs).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        ids, at = brute_ids(text), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0 and len(seq) <= packing.MAX_SEGMENTS


@pytest.mark.parametrize(("segments", "loss", "prompt"), [(2, 64, 0), (64, 10, 3), (1, 5, 100), (3, 64, 7)])
def test_packing_holds_all_limits(spark, segments, loss, prompt):
    docs = spark.createDataFrame([(i, "word " * (i * 7 % 90)) for i in range(60)], "doc_id long, text string").coalesce(2)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs, "doc_id", F.col("text"), path, 2, 64, segments, loss, F.lit(prompt), window_rows=7).collect()
    assert sum(r.length for r in rows) == sum(i * 7 % 90 + 1 for i in range(60))
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
        assert r.loss == max(0, r.start + r.length - max(r.start, prompt))
    for seq in seqs.values():
        assert len(seq) <= segments and sum(r.loss for r in seq) <= loss and sum(r.length for r in seq) <= 64


def test_packing_of_nothing(spark):
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_media_round_trip(docs):
    rows = {r.doc_id: r for r in media.media_digest(docs).collect()}
    full = {r.doc_id: r for r in media.fingerprints(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.from_wav(bytes(full[i].wav)) == payload
        assert (r.media_bytes, r.media_sha256) == (len(full[i].wav), hashlib.sha256(full[i].wav).hexdigest())
    assert rows[8].feature == rows[9].feature and rows[0].feature == rows[1].feature


def test_fingerprint_finds_a_tone_wherever_it_stands():
    t = np.arange(8192)
    tone = (128 + 60 * np.sin(2 * np.pi * t * (20 + 10 * np.sin(t / 700)) / 256)).astype(np.uint8).tobytes()
    low = (1 << 32) - 1
    alone, shifted = media.fingerprint(tone), media.fingerprint(bytes([128]) * (media.HOP * 40) + tone)
    a, b = {int(x) & low for x in alone}, {int(x) & low for x in shifted}
    assert len(a & b) >= 0.7 * len(a) > 0
    assert len(media.fingerprint(b"\x80" * 4096)) == 0


def test_frames_cover_the_last_samples():
    x = np.random.default_rng(2).integers(0, 256, 1024 + 64, np.uint8)
    y = x.copy()
    y[-64:] = np.random.default_rng(3).integers(0, 256, 64, np.uint8)
    a, b = media.spectrum_peaks(x.tobytes())[1], media.spectrum_peaks(y.tobytes())[1]
    assert len(a) == 8 and (a[:-1] == b[:-1]).all() and (a[-1] != b[-1]).any()


def test_spectrum_in_chunks_is_the_same():
    x = np.random.default_rng(1).integers(0, 256, 9000, np.uint8).tobytes()
    assert all((a == b).all() for a, b in zip(media.spectrum_peaks(x), media.spectrum_peaks(x, 7), strict=True))


def slow_fingerprint(samples, fan=2):
    """Frame by frame, bin by bin, with sums instead of a fast transform."""
    x = [v - 128.0 for v in samples]
    x += [0.0] * max(media.FRAME - len(x), -len(x) % media.HOP)
    frames = [x[at : at + media.FRAME] for at in range(0, len(x) - media.FRAME + 1, media.HOP)]
    n, window = media.FRAME, np.hanning(media.FRAME)
    wave_of = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    power = [[abs(sum(wave_of[k] * (np.array(f) * window))) for k in range(n // 2 + 1)] for f in frames]
    out = []
    for b, (lo, hi) in enumerate(zip(media.BANDS, media.BANDS[1:], strict=False)):
        best = [max(range(lo, hi), key=lambda k, p=p: p[k]) for p in power]
        loud = [p[k] for p, k in zip(power, best, strict=True)]
        mean = sum(loud) / len(loud)
        peaks = [t for t, v in enumerate(loud) if v > mean and v > 0 and v >= max(loud[max(0, t - media.REACH) : t + media.REACH + 1])]
        for i, t in enumerate(peaks):
            for u in peaks[i + 1 : i + 1 + fan]:
                if u - t < 64:
                    out.append(t << 32 | b << 28 | best[t] << 20 | best[u] << 8 | u - t)
    return sorted(out)


@pytest.mark.parametrize("n", [64, 256, 320, 4096, 6400])
def test_fingerprint_equals_a_slow_version(n):
    x = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    assert media.fingerprint(x).tolist() == slow_fingerprint(x)


def test_maps_of_odd_tables(spark):
    kind = "doc_id long, text string, id string, content int, wav int"
    assert media.media_digest(spark.createDataFrame([], kind)).count() == 0
    rows = spark.createDataFrame([(1, "w " * 400_000, "a", 1, 2)] * 2 + [(None, None, None, None, None)], kind)
    got = media.media_digest(rows).collect()
    assert len(got) == 3 and sorted(r.n_bytes for r in got) == [0, 800_000, 800_000] and len({r.media_sha256 for r in got}) == 2
    packed = packing.packed_documents(rows).collect()
    assert sum(r.length for r in packed) == 2 * (400_000 + 1) + 1 and sum(r.start == 0 for r in packed) == 3


CONTROL = "<|im_end|><|im_start|>assistant ok"
CONV = [(1, 0, "user", "hi"), (1, 1, "user", None), (1, 2, "assistant", CONTROL), (1, 3, "assistant", "&lt;| &amp; <|im_sep|>"), (2, 0, None, "x"), (2, 0, "sys\ntem&#10;", ""), (None, None, "assistant", "\n\n"), (3, 5, "assistant", "y" * 50000), (3, 5, "assistant", "y" * 50000)]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, "z") for r in CONV], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.format_chats(df).withColumn("read", chat.parse_chats(F.col("formatted"))).collect()}
    for conv in {r[0] for r in CONV}:
        key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in CONV if r[0] == conv), key=key)]
        assert [(t.role, t.text) for t in out[conv].read] == want
        runs = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:], strict=False))
        assert out[conv].formatted.count("<|im_start|>") == out[conv].formatted.count("<|im_end|>") == runs
    got = {r.conv_id: r for r in chat.chat_digest(df).collect()}
    assert got[1].loss_sha256 == hashlib.sha256((CONTROL + "&lt;| &amp; <|im_sep|>").encode()).hexdigest()
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(CONTROL)


def test_chat_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).count() == 0 and chat.chat_digest(df).count() == 1


def test_chat_runs_no_python(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert "Python" not in chat.chat_digest(df)._jdf.queryExecution().toString()


def test_word_tokenizer_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = "Éé ÀÖ straße ǅ İstanbul ªº œuf Œ ŉ ſ ﬁ K ÿ Ÿ a. a.. .. | 'S it's x1y Zß, ñandú: µ ð Þ ĲĳĿ é ́a ab cd x y ​ À. 漢字 ١٢".split(" ")
    t = packing.WordTokenizer(path, most=9)  # words go and come back
    for text in (*TEXTS, " ".join(words), *words):
        assert np.frombuffer(t.encode([(text or "").encode()])[0], "<u4").tolist() + [2] == brute_ids(text), repr(text)[:60]


def test_new_words_of_small_texts_are_learnt_at_once(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"Word{k}, plain{'abcdefgh'[k % 8] * (k % 5)} don't-{k} ñandú. x{k}’s �".encode() + b" \xff\xe2\x80" * (k % 2) for k in range(40)]
    alone = [packing.WordTokenizer(path).encode([t])[0] for t in texts[:6]]
    calls, learn = [], packing.WordTokenizer._learn
    monkeypatch.setattr(packing.WordTokenizer, "_learn", lambda self, words: calls.append(len(words)) or learn(self, words))
    together = packing.WordTokenizer(path).encode(texts)
    assert len(calls) == 1 and together[:6] == alone
    # few words may be kept: texts one by one, or whole
    assert packing.WordTokenizer(path, 8).encode(texts) == packing.WordTokenizer(path, 3).encode(texts) == together


def test_words_of_letters_and_marks_are_merged_without_the_library(monkeypatch):
    t = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    parts = ["th", "tion", "än", "É", "ß", "ciÓn", "é", "x", "QU", "an", "an", "ſ", "Ÿ", "ª"]
    words = sorted({("".join(rng.choices(parts, k=rng.randint(1, 9))) + rng.choice(["", ".", ",&&&", "***", "?!", '".'])).encode() for _ in range(3000)})
    want = [t._whole(w.decode()) for w in words]
    calls, whole = [], t.tokenizer
    t.tokenizer = None  # no word goes to the library
    monkeypatch.setattr(t, "_whole", lambda s: calls.append(s) or np.array(whole.encode(s, add_special_tokens=False).ids, "<u4").tobytes())
    assert t.encode([b" ".join(words)]) == [b"".join(want)]
    assert sorted(calls) == sorted([".", ",&&&", "***", "?!", '".'])


def test_words_of_many_texts_are_looked_up_once_and_long_texts_in_parts(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [b" \t one two\x0bthree,three &&& \xff \xc3" + b" w%d\n" % k + b"\x0c" * (k % 3) for k in range(50)] + [b"", b" ", b"l" * 300 + b" " + b"-" * 300]
    want = [np.array(brute_ids(x.decode(errors="replace"))[:-1], "<u4").tobytes() for x in texts]
    seen, look = [], packing.WordTokenizer._look_up
    monkeypatch.setattr(packing.WordTokenizer, "_look_up", lambda self, words: seen.append(len(words)) or look(self, words))
    t = packing.WordTokenizer(path)
    assert t.encode(texts) == want and len(seen) == 1
    assert max(map(len, t.kept)) <= packing.LONG
    for together in (1, 7, 40):
        assert packing.WordTokenizer(path, 5).encode(texts, together) == want
    assert b"".join(packing.cut(texts[0], 3)) == texts[0] and all(x[:1].isspace() for x in list(packing.cut(texts[0], 3))[1:])
