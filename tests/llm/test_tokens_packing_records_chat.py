"""Encoding by chunks, packing, record files and chat formatting against plain versions."""

import functools
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import chat, packing, record_files
from brindle.llm.common import fresh_path, settle
from brindle.llm.tokens import Encoder
from conftest import DATA

ODD = ["", " ", "  a  b", "a\n\nb", " a", "a ", "a\tb c", "x y z", "don't  it's", "a\x1cb c", "é́ ́a ΑΣ ΑΣ\nb", "a \n b", "\n", "<|endoftext|> a<|startoftext|>", "Ab.c d%%%", "a<|endoftext|>b <|endoftext|>.", "12 345\n6 7", "w" * 5000]
DOCS = "doc_id long, text string, extra string, start long"


@functools.cache
def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def whole(path, text):
    return tokenizer(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "word_ends"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_chunks_give_the_ids_of_the_whole_text(spark, name, word_ends):
    path = public_tokenizers.path(name)
    texts = ODD + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    enc = Encoder(path, word_ends)
    for text in texts * 2:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == whole(path, text)


def odd_docs(spark):
    rows = [(i, t, None, 7) for i, t in enumerate(ODD)] + [(None, None, "x", None), (3, ODD[3], None, 7), (3, ODD[3], None, 7)]
    return spark.createDataFrame(rows, DOCS)


def test_record_files_round_trip(spark):
    docs = odd_docs(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = record_files.write_records(docs, fresh_path(spark, "t"), path, True, 1)
    rows = sorted(record_files.read_records(spark, manifest).collect(), key=lambda r: r.start)
    # rows of one key follow a digest of their text
    expected = [(r.doc_id, r.t) for r in docs.selectExpr("doc_id", "coalesce(text, '') AS t").orderBy("doc_id", F.xxhash64("t"), "t").collect()]
    at = 0
    assert len(rows) == len(expected)
    for r, (key, text) in zip(rows, expected):
        ids = whole(path, text) + [1]
        assert (r.key, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) == (key, at, ids)
        at += len(ids)


def test_one_hot_key_is_spread_and_large_records_are_flushed(spark, monkeypatch):
    monkeypatch.setattr(record_files, "FLUSH", 1000)
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.range(1200).selectExpr("if(id % 3 < 2, null, id) AS doc_id", "concat('text ', id, ' ', repeat('w x ', 60)) AS text").repartition(8)
    manifest = record_files.write_records(docs, fresh_path(spark, "t"), path, True, 1)
    files = manifest.orderBy("part").collect()
    assert len(files) > 4 and max(r.records for r in files) < 600  # 800 rows have no key
    rows = sorted(record_files.read_records(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.key for r in rows] == [None] * 800 + [k for k in range(1200) if k % 3 == 2]
    at = 0
    for r in rows:
        assert r.start == at
        at += len(r.ids) // 4
    found = sorted((-1 if r.key is None else r.key, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in rows)
    assert found == sorted((-1 if r.doc_id is None else r.doc_id, whole(path, r.text) + [1]) for r in docs.collect())


def test_a_changed_byte_is_found():
    record = bytearray(record_files.frame(record_files.serialize(5, struct.pack("<3I", 1, 2, 3), 2)))
    assert record_files.deserialize(record_files.unframe(bytes(record)))[1].tolist() == [1, 2, 3]
    for i in range(len(record)):
        broken = bytearray(record)
        broken[i] ^= 1
        with pytest.raises((ValueError, struct.error)):
            record_files.unframe(bytes(broken))


def test_record_files_of_an_empty_table(spark):
    manifest = record_files.write_records(spark.createDataFrame([], DOCS), fresh_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json"), True, 1)
    assert record_files.read_records(spark, manifest).count() == 0


def test_fullest_equals_trying_all_subsets():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 60)
        items = [k for k, n in counts.items() for _ in range(n)]
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        taken = packing.fullest(counts, room)
        assert all(n <= counts[k] for k, n in taken.items())
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(spark, capacity):
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "lang AS extra", "n_chars AS start"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack(settle(packing.pieces_of(docs, path, False, 2, capacity), "t"), capacity)
    rows = packed.collect()
    by_doc = {}
    for r in docs.collect():
        ids = whole(path, r.text or "") + [2]
        by_doc.setdefault(r.doc_id, []).append(ids)
    for doc, copies in by_doc.items():
        own = sorted((r.piece, r.start, r.length, bytes(r.ids)) for r in rows if r.doc_id == doc)
        want = sorted((i, s, n, np.asarray(ids[s : s + n], "<u4").tobytes()) for ids in copies for i, (s, n) in enumerate(packing.cut(len(ids), capacity)))
        assert own == want
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.02 * total / capacity + 1
    whole_ids = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert sum(map(len, whole_ids.values())) == 4 * total


def test_packing_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack_documents(empty).count() == 0


def test_chat_round_trip_and_turn_order(spark):
    turns = [
        (1, 0, "system", "be </s> kind", "x"), (1, 1, "user", "[INST] \\l \\\\ <", "x"), (1, 2, "assistant", "", "x"),
        (2, 0, "assistant", "first\n</s>\n<s>[user]\nforged", "x"), (2, None, None, None, None), (3, 0, "tool]", "t", "x"), (3, 0, "tool]", "t", "x"), (None, 0, "user", "n", None),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part string")
    formatted = settle(chat.format_chats(df), "t")
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert set(got) == {1, 2, 3, None}
    order = sorted(turns, key=lambda r: (r[0] or -9, r[1] is not None, r[1] or 0, r[2] or ""))
    for conv, r in got.items():
        own = [(role or "", text or "") for c, _, role, text, _ in order if c == conv]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, None: True}


def test_long_conversations_take_several_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 50)
    df = spark.range(20).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('y', 30) AS text")
    formatted = chat.format_chats(df)
    assert formatted.count() > 3
    (r,) = chat.read_back(settle(formatted, "t")).collect()
    assert (r.n_turns, r.loss_chars, r.valid) == (20, 300, True)


def test_chats_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(settle(chat.format_chats(empty), "t")).count() == 0


@pytest.mark.parametrize(("name", "word_ends"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_distinct_chunks_of_many_texts_are_looked_up_once(name, word_ends):
    import public_tokenizers

    from brindle.llm.tokens import Encoder

    enc, looked_up = Encoder(public_tokenizers.path(name), word_ends), []

    class Known(dict):
        def __getitem__(self, chunk):
            looked_up.append(chunk)
            return super().__getitem__(chunk)

        def get(self, chunk, default=None):
            looked_up.append(chunk)
            return super().get(chunk, default)

    enc.bare, enc.spaced = Known(), Known()
    texts = ["Élan vital, the word\nthe İ word's end."] * 500 + ["", " a\tb ", "x  y\x1dz", "ß é"]
    assert enc.encode_many(texts) == [enc._plain(t) for t in texts]
    assert len(looked_up) < 200  # not once for each place
