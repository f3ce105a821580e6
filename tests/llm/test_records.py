"""Token records: the encoder against the library on odd texts, and files read in chunks."""

import io
import random

import numpy as np
import pytest

from siftworks.llm import records

PARTS = [*"abcXYZ stm'.,|-_<>=!\\\"09 5\t\n\x0b\x0c\r\x1c\x1f\x85\xa0 \u0338\u0327\u0301éÉßΣςİıKÅ×÷ÿÑ😀ｆ漢かが\u3099١½Ⅷ²ǆ\ufeff\x00\x7f’", "'s", "'re", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "The, ", "a" * 40, "|||", "|x|", "x'S", "..'s"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(records.TOKENIZER)), records.Encoder(public_tokenizers.path(records.TOKENIZER))


def ids(raw):
    return np.frombuffer(raw, "<u2").tolist()


def test_encoder_equals_the_library_on_odd_texts(library, monkeypatch):
    tokenizer, encoder = library
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(60))) for _ in range(4000)] + [None, "", " "]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(map(ids, encoder.encode(texts))) == want
    monkeypatch.setattr(records, "TOGETHER", 16)  # texts in pieces
    monkeypatch.setattr(records, "KEPT_UNITS", 10)
    assert list(map(ids, encoder.encode(texts))) == want


def test_texts_that_leave_nothing_to_encode_at_the_end(spark, library, monkeypatch, tmp_path):
    tokenizer, encoder = library
    full = "a b " * (records.TOGETHER // 4)  # units are found as soon as there are so many bytes, and none wait when the texts end there
    for texts in ([], ["<|endoftext|> x"] * 2, [full], ["ab", full], [full + "and more"], [full, "<|endoftext|>", None]):
        assert list(map(ids, encoder.encode(texts))) == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame([(1, full), (2, "<|endoftext|>")], "doc_id long, text string").repartition(2, "doc_id")
    got = {r.doc_id: r.n_tokens for r in records.token_records(docs, f"file://{tmp_path}/out").collect()}
    assert got == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in ((1, full), (2, "<|endoftext|>"))}
    r = random.Random(6)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(12))) for _ in range(60)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for together in (1, 8, 16):
        monkeypatch.setattr(records, "TOGETHER", together)
        for n in range(len(texts) + 1):
            assert list(map(ids, encoder.encode(texts[:n]))) == want[:n]


def test_units_that_share_a_mixed_key_are_told_apart(library, monkeypatch):
    tokenizer, encoder = library
    monkeypatch.setattr(records, "MIX", np.zeros(4, dtype=np.uint64))
    texts = ["the quick brown fox, the slow one", "a quick fox 17 " + "long" * 30]
    assert list(map(ids, encoder.encode(texts))) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_frames_are_read_in_chunks(monkeypatch):
    payloads = [records.pack(i, bytes(range(i % 250)) * 2, 2) for i in range(100)]
    data = b"".join(map(records.frame, payloads))
    for chunk in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(records, "CHUNK", chunk)
        got = list(records.frames_of(io.BytesIO(data)))
        assert [bytes(p) for _, _, p in got] == payloads
        assert [a for a, _, _ in got] == np.cumsum([0, *(n for _, n, _ in got)])[:-1].tolist()
        for cut in (len(data) - 1, len(data) - 6):
            with pytest.raises(records.CorruptRecord):
                list(records.frames_of(io.BytesIO(data[:cut])))


def test_files_that_pyarrow_cannot_open_are_read_by_spark(spark, tmp_path, monkeypatch):
    import pyarrow.fs

    docs = spark.createDataFrame([(i, f"text {i} " * i) for i in range(30)], "doc_id long, text string")
    path = f"file://{tmp_path}/out"
    want = sorted(map(tuple, records.token_records(docs, path).drop("file").collect()))

    class Closed:
        @staticmethod
        def from_uri(uri):
            raise OSError(uri)

    monkeypatch.setattr(pyarrow.fs, "FileSystem", Closed)
    got = records.scan_records(spark, f"{path}/records")
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got.collect()) == sorted((w[0], w[2], w[3]) for w in want)
