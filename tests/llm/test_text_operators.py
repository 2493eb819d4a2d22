"""BPE, token counts, Ogg and chat against their libraries, round trips and every odd row."""

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeforge.llm import bpe, chat, counts, entry, ogg

ALPHABET = list("ab'stmdrevlLL  \n\t1٣é!?-  　漢字🙂\x1c\x85▁")
ODD = [None, "", " ", "  a", "a  b ", "\n\n x", "it's 'll don't''s", "x" * 700, "ab " * 3000, "<s>▁a</s>", "ñ\x00b"]


def texts(n=150, seed=1):
    r = random.Random(seed)
    return ODD + ["".join(r.choice(ALPHABET) for _ in range(r.randrange(60))) for _ in range(n)] + ["twice", "twice"]


def frame(spark, values):
    return spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(values)], "doc_id long, text string, n_tokens string, ids int").repartition(3)


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    vocab = bpe.vocabulary(bpe.default_path())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    values = texts()
    got = {r.doc_id: r for r in bpe.digest(frame(spark, values)).collect()}
    for i, t in enumerate(values):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    long = "".join(random.Random(2).choice("abcdefgh") for _ in range(500)).encode()
    assert vocab.merge(long) == enc.encode_ordinary(long.decode()) and vocab.merge(b"thonention") == enc.encode_ordinary("thonention")


def test_bpe_offsets_and_decoding(spark):
    values = texts(40)
    both = bpe.decode(bpe.encode(frame(spark, values), keep=("doc_id", "text")), keep=("doc_id", "text", "piece_offsets"))
    for r in both.collect():
        raw = (r.text or "").encode()
        assert bytes(r.decoded) == raw
        assert r.piece_offsets == sorted(set(r.piece_offsets)) and (not raw or r.piece_offsets[0] == 0)
    assert bpe.digest(frame(spark, values).limit(0)).count() == 0


def test_scan_is_associative():
    scan = bpe.scanner()
    r = np.random.default_rng(1)
    e = scan.generator[r.integers(0, 16, 5000)].astype(np.int32)
    state, want = bpe.FRESH, []
    for x in e.tolist():
        state = int(scan.act[x, state])
        want.append(state)
    for block in (2, 7, 256):
        assert scan.states(e, block).tolist() == want


def test_counts_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=counts.default_path())
    values = texts()
    got = {r.doc_id: r for r in counts.count_tokens(frame(spark, values), limit=20).collect()}
    for i, t in enumerate(values):
        n = len(model.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 20)


def test_ogg_round_trip_and_damage(spark):
    values = [t for t in texts(30)] + ["y" * 300_000]
    stored = ogg.attach(frame(spark, values), keep=("doc_id", "text"))
    got = ogg.describe(stored, keep=("doc_id", "text")).collect()
    for r in got:
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.error) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), None)
        assert r.packet_ms[-1] == len(payload) * 1000 // ogg.SAMPLE_RATE and r.packet_ms == sorted(r.packet_ms)
    assert ogg.describe(ogg.attach(frame(spark, values).limit(0))).count() == 0
    media = ogg.write(ogg.pad(b"abc" * 5000), 15000)
    assert len(ogg.read(media)) == 2
    for at in (4, 30, 200, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            ogg.features(bytes(broken))
    with pytest.raises(ValueError):
        ogg.features(media[:-5])
    bad = ogg.describe(spark.createDataFrame([(1, None), (2, bytearray(b"x"))], "doc_id long, media binary")).collect()
    assert all(r.payload_sha256 is None and r.error for r in bad)


def pages(media):
    """(serial, flags, granule, lacing values) of each page, read plainly."""
    at, out = 0, []
    while at < len(media):
        n = media[at + 26]
        values = list(media[at + 27 : at + 27 + n])
        out.append((*struct.unpack_from("<I", media, at + 14), media[at + 5], *struct.unpack_from("<q", media, at + 6), values))
        at += 27 + n + sum(values)
    return out


def test_ogg_pages_share_and_span():
    payload = bytes(range(256)) * 1000
    found = pages(ogg.write(payload, len(payload)))
    ended = [sum(v < 255 for v in values) for _, _, _, values in found]
    assert max(ended) > 2 and any(f & ogg.CONTINUED for _, f, _, _ in found)
    assert any(not n and g == -1 and len(v) == 255 for n, (_, _, g, v) in zip(ended, found))
    serials = [s for s, *_ in found]
    assert any(a == b for a, b in zip(serials, serials[1:])) and serials != sorted(serials)
    own, _, feature, times = ogg.features(ogg.write(payload, len(payload)))
    assert own == payload and f"ms={len(payload) // 8};" in feature
    sizes, at, want = [800, 1600, 2400, 80_000], 0, []
    while at < len(payload):
        at = min(len(payload), at + sizes[len(want) % 4])
        want.append(at // 8)
    assert times == want
    assert ogg.ends([None, 5, None, 12], [2, 3, 3, 4]) == [2, 5, 8, 12]
    with pytest.raises(ogg.Damaged):
        ogg.ends([None, 6], [2, 3])


def test_ogg_checksum_is_the_formats():
    def plain(data):
        c = 0
        for b in data:
            c ^= b << 24
            for _ in range(8):
                c = (c << 1 ^ (0x04C11DB7 if c >> 31 else 0)) & 0xFFFFFFFF
        return c

    for data in (b"", b"OggS", bytes(range(256))):
        assert ogg.checksum(data) == plain(data)
    assert ogg.lacing(255) == b"\xff\x00" and ogg.lacing(0) == b"\x00"


def test_chat_round_trip(spark):
    odd = [entry.MARKS, "", None, "<|", "<\\|", "<\\\\| x", "a\\", "é🙂"]
    rows = [(k, i, ("user", "assistant", "a\nb<|", None)[i % 4], t) for k in range(2) for i, t in enumerate(odd)] + [(None, 0, "user", "n"), (3, None, "user", "first"), (3, 1, "assistant", "x"), (3, 1, "assistant", "x")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, layout string")
    made = chat.format_records(chat.records(df))
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    for k in (0, 1, 3, None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (got[k].n_turns, got[k].loss_chars, got[k].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.format_records(chat.records(df.limit(0)))).count() == 0


def test_counts_of_odd_tables(spark):
    """An empty table, and texts without a space to split at."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=counts.default_path())
    values = ["x" * 50_000, "漢" * 9000, "▁" * 300, None]
    got = {r.doc_id: r.n_tokens for r in counts.count_tokens(frame(spark, values)).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in enumerate(values)}
    assert counts.count_tokens(frame(spark, values).limit(0)).count() == 0


def test_chat_layouts(spark):
    records = [
        ('{"prompt": "q", "response": "a"}', "prompt", [("user", "q"), ("assistant", "a")]),
        ('{"instruction": "i", "input": "x", "output": "o"}', "instruction_input", [("user", "i\nx"), ("assistant", "o")]),
        ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', "share", [("user", "q"), ("assistant", "a")]),
        ('{"messages": []}', "messages", []),
        ('{"messages": [], "id": 3}', "messages", []),
        ('{"id": 3, "messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": null, "weight": 0}]}', "messages", [("user", "q"), ("assistant", "")]),
        ('{"turns": [{"role": "user", "text": ["a", 1]}], "meta": {"k": 1}}', "turns", [("user", '["a", 1]')]),
        ('{"prompt": "q", "response": "a", "system": "s", "score": 1}', "system_prompt", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ('{"question": "q", "answer": 7}', "question", [("user", "q"), ("assistant", "7")]),
        ('{"prompt": "q", "completion": "c", "n": 1}', "completion", [("user", "q"), ("assistant", "c")]),
        ('{"instruction": "i", "output": "o"}', "instruction", [("user", "i"), ("assistant", "o")]),
        ('{"messages": [{"speaker": "x"}]}', "unknown", [("unknown", '{"messages": [{"speaker": "x"}]}')]),
        ('{"messages": ["x"]}', "unknown", [("unknown", '{"messages": ["x"]}')]),
        ('{"other": 1}', "unknown", [("unknown", '{"other": 1}')]),
        ("[1]", "unknown", [("unknown", "[1]")]),
        ("{bad<|im_end|>", "unknown", [("unknown", "{bad<|im_end|>")]),
        (None, "unknown", []),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(records)], "conv_id long, record string")
    got = {r.conv_id: r for r in chat.format_records(df).collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i].layout == layout and chat.parse(got[i].formatted) == turns


def test_queries_cover_their_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    out = entry.op7_chat_formatting(spark, sf)
    assert out.count() == n + 1
    marks = out.where("conv_id = -1").first()
    assert marks.n_turns == 2 and marks.loss_chars == len(entry.MARKS) and marks.loss_sha256 == hashlib.sha256(entry.MARKS.encode()).hexdigest()
    assert out.where(F.col("conv_id").isNull()).count() == 0
