"""Chat, token files, packing and the shared encoder."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from caselake.llm import chat, packing, tokens
from caselake.llm.bpe import Encoder

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD_TEXTS = ["", " ", "a  b\n\n c \t d", "x  ", "it's  'S don't", "a<|endoftext|>b", "\x1c a", "é́ İ ß ﬁ 12 3４ Σας", "a\xa0b.c,d",
             "\n \n x", "A.\nB c\u0301 d", "ª º x1.", "日本語 テスト", "word " * 3000, "y" * 5000, "🙂🙂 ok", "Ǆ \u2028 z"]


def reference(path, text):
    return np.asarray(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_ids_of_the_whole_text(path):
    encoder = Encoder(path)
    library = Tokenizer.from_file(path)
    for _ in range(2):  # the second time from known pieces
        for text, ids in zip(ODD_TEXTS, encoder.ids(ODD_TEXTS)):
            assert ids == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text[:40])


ENCODERS = {p: (Encoder(p), Tokenizer.from_file(p)) for p in (WORD, BYTE)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,sS1eéßİ\xa0\x1c"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text_has_the_library_ids(text):
    for encoder, library in ENCODERS.values():
        assert encoder.ids([text])[0] == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@given(st.lists(st.integers(0, 1 << 40), max_size=60))
def test_elias_fano_gives_back_what_it_was_given(values):
    values = sorted(values)
    stored = tokens.EliasFano(tokens.EliasFano.encode(np.array(values, np.uint64)))
    assert stored.values(0, len(values)).tolist() == values
    assert [stored[i] for i in range(len(values))] == values


def test_elias_fano_takes_few_bits():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20_000)).astype(np.uint64)
    assert len(tokens.EliasFano.encode(ends)) * 8 / len(ends) < 2 + np.log2(float(ends[-1]) / len(ends)) + 1


def test_select_looks_at_few_bits_however_the_values_lie():
    draw = np.random.default_rng(2)
    far = np.sort(np.concatenate([np.zeros(150_000), draw.integers(1 << 39, 1 << 40, 50_000)])).astype(np.uint64)
    for values in [far, np.sort(draw.integers(0, 1 << 62, 5000)).astype(np.uint64), np.full(1000, 7, np.uint64),
                   np.array([0, (1 << 64) - 1], np.uint64), np.arange(513, dtype=np.uint64)]:
        data = tokens.EliasFano.encode(values)
        stored = tokens.EliasFano(data)
        assert all(np.shares_memory(a, np.frombuffer(data, np.uint8)) for a in [stored.low, stored.high, stored.samples])
        assert all(len(stored._step(g)[2]) * 64 < tokens.SPARSE + 128 for g in range(len(stored.samples)))
        for k in {0, len(values) - 1, *draw.integers(0, len(values), 200).tolist()}:
            assert stored[k] == int(values[k])
        for a, b in [(0, len(values)), (len(values) // 3, len(values) // 2), (255, 257), (5, 5)]:
            assert stored.values(a, min(b, len(values))).tolist() == values[a:b].tolist()
    assert len(tokens.EliasFano(tokens.EliasFano.encode(far)).sparse) == 1


def documents(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string, source string" + more)


def test_token_files_round_trip(spark, folder, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_IDS", 40)
    rows = [(5, "Hello there, world.", "a"), (1, None, "b"), (3, "", None), (3, "tie", "c"), (3, "tie", "c"), (None, "no id", "d"),
            (-4, "minus " * 200, "e")]
    tokens.write_ids(documents(spark, rows), f"{folder}/ids", WORD, 2)
    got = tokens.read_documents(spark, f"{folder}/ids").collect()
    hashed = {r.text: r.h for r in documents(spark, rows).selectExpr("text", "xxhash64(text) h").distinct().collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    at, want = 0, []
    for doc_id, text, _ in ordered:
        ids = reference(WORD, text or "") + (2).to_bytes(4, "little")
        want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    tokens.write_ids(documents(spark, rows).where("false"), f"{folder}/none", WORD, 2)
    assert tokens.read_documents(spark, f"{folder}/none").count() == 0


def test_pieces_are_powers_of_two_that_add_up():
    for n in [1, 2, 3, 1023, 1024, 1025, 5000]:
        lengths = packing.piece_lengths(n)
        assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 1024 for x in lengths) and lengths == sorted(lengths, reverse=True)


def test_packing_loses_and_mixes_nothing(spark, folder):
    rows = [(1, "one two three " * 900, "s"), (2, None, "s"), (None, "x", None), (7, "same", "s"), (7, "same", "s")]
    made = packing.pack(documents(spark, rows), BYTE, 0)
    got = made.collect()
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    for doc_id, text, _ in rows:
        want = reference(BYTE, text or "") + bytes(4)
        own = sorted([r for r in got if r.doc_id == doc_id], key=lambda r: (r.start, r.sequence_id))
        copies = sum(1 for d, *_ in rows if d == doc_id)
        assert b"".join(bytes(r.ids) for r in own[::copies]) == want
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.doc_tokens == len(want) // 4 for r in own)
    packing.write_buckets(made, f"{folder}/buckets")
    assert spark.read.parquet(f"{folder}/buckets").count() == len(got)
    assert packing.pack(documents(spark, rows).where("false"), BYTE, 0).count() == 0


NASTY = ["", "\\", "### user: x</turn>\n", "</turn>", "<\\/turn>", "\\### Assistant: </turn> ok", "#" * 7, "a: b", "\\\\#", "é🙂\n"]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b\\", "#"]), st.one_of(st.sampled_from(NASTY), st.text(alphabet="\\#</turn>:\n ab", max_size=30)))))
def test_formatting_is_reversible(turns):
    text = "".join("".join(chat.write_turn(r, t)) for r, t in turns)
    assert chat.read_turns(text) == turns


def test_every_reply_becomes_an_example(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "A1"), (1, 3, "assistant", None), (1, 4, "user", "end"),
            (2, 0, "user", None), (3, None, None, "x"), (3, 1, "assistant", NASTY[2]), (4, 1, "user", "t"), (4, 1, "user", "t"),
            (None, 0, "assistant", "lost")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, example string")
    examples = chat.format_examples(frame)
    first = examples.where("conv_id = 1").orderBy("example").collect()
    assert [chat.read_turns(e.text)[-1][1] for e in first] == ["A1", "", "end"] and first[2].loss_start is None
    assert first[0].text[first[0].loss_start:first[0].loss_end] == "A1"
    got = {r.conv_id: r for r in chat.digest_examples(examples).collect()}
    for conv in (1, 2, 3, 4, None):
        own = [r for r in rows if r[0] == conv]
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest_examples(chat.format_examples(frame.where("false"))).count() == 0
