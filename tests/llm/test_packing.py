import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factledger.llm import packing
from factledger.llm.packing import CLASSES, cuts, pack, pack_documents, pieces, slices, tokens_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_word_lookup_gives_the_tokenizers_ids(tokenizer):
    texts = [
        "",
        " ",
        "plain words, it's 12 o'clock 'really'",
        "two  spaces   here ",
        " leading and trailing ",
        "line\n break\n\n two \n\tthree\r\n",
        "é ß nbsp  em 　wide x  y",
        "<|endoftext|> is one token <|endoftext|>",
        "a<|endoftext|>b <|endoftext|>, <|endoftext |>",
        "a \x1c b \x85 c",
        "日本語 テキスト 🙂🙂 end",
        "x" * 3000,
    ] * 2
    got = [np.frombuffer(b, "<u4").tolist() for b in tokens_of(PATH)(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_follow_the_file(make_docs):
    got = pieces(make_docs([(1, "a <|endoftext|> b")]), PATH).collect()
    ids = np.frombuffer(bytes(got[0]["ids"]), "<u4").tolist()
    assert len(ids) == 5 and 50256 in ids and ids[-1] == 0


def test_a_worker_keeps_words_of_letters_only_and_at_most_the_bound(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 40)
    encode = packing.WordTokens(PATH)
    letters = "abcdefghijkl"
    texts = [f"often {a}{b}{c}. often, {c}{b}x{a}\n12 {a}{c}" for a in letters for b in letters for c in letters[:3]]
    for at in range(0, len(texts), 5):
        got = [np.frombuffer(b, "<u4").tolist() for b in encode(texts[at : at + 5])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[at : at + 5]]
        assert len(encode.known) < 40 and all(w.strip().isalpha() for w in encode.known)
    assert " often" in encode.known


def test_a_batch_is_worked_off_in_slices(monkeypatch):
    monkeypatch.setattr(packing, "SLICE_CHARS", 10)
    texts = ["abc", None, "defghijkl", "", "x" * 30, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None, 4, 5, 6]), pa.array(texts)], ["doc_id", "text"])
    got = [(ids.to_pylist(), held) for ids, held in slices(batch)]
    assert got == [([1, 2, None], ["abc", "", "defghijkl"]), ([4, 5], ["", "x" * 30]), ([6], ["y"])]


def test_cuts_cover_and_fit():
    for n in range(1, 5000):
        lengths = cuts(n)
        assert sum(lengths) == n and all(1 <= x <= 1024 for x in lengths)
        rest = [x for x in lengths if x < 1024]
        assert len(rest) <= 4


def check_places(rows, capacity=1024):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in sequences.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_round_trip(make_docs, odd_rows, tokenizer):
    got = pack_documents(make_docs(odd_rows), PATH).collect()
    check_places(got)
    wanted = []
    for i, text, *_ in odd_rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for n in cuts(len(ids)):
            wanted.append((i, at, n, zlib.crc32(np.asarray(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(wanted, key=repr)


def test_little_padding_and_fixed_counts(spark):
    rng = np.random.default_rng(4)
    rows, total = [], 0
    for i, n in enumerate(rng.integers(1, 2500, 6000).tolist()):
        at = 0
        total += n
        for length in cuts(n):
            rows.append((i, at, length))
            at += length
    frame = spark.createDataFrame(rows, "doc_id long, start long, length long").repartition(4)
    packed = pack(frame, workers=16).collect()
    assert sorted(tuple(r)[:3] for r in packed) == sorted(rows)
    used = check_places(packed)
    assert used * 1024 <= total * 1.01
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append(r["length"])
    full = [v for s, v in by_sequence.items() if s < 1 << 61]
    assert full and all(len(v) == min(1024 // max(v), CLASSES) for v in full)
    again = pack(frame.repartition(7), workers=16).collect()
    assert sorted(map(tuple, packed)) == sorted(map(tuple, again))


def test_pieces_carry_their_ids(make_docs, tokenizer):
    text = "some words to encode " * 400
    got = pieces(make_docs([(1, text)]), PATH).orderBy("start").collect()
    ids = b"".join(bytes(r["ids"]) for r in got)
    assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_empty_and_clashing_names(make_docs):
    assert pack_documents(make_docs([]), PATH).count() == 0
    clash = make_docs([(1, "a b")]).withColumns({c: F.lit(1) for c in ("start", "length", "sequence_id", "_class", "ids")})
    assert pack_documents(clash, PATH).count() == 1


def test_short_pieces_fill_their_sequences(spark):
    """Pieces under 16 tokens do not stop at 64 a sequence."""
    for length in (1, 3, 7, 13, 15):
        frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(length).cast("long").alias("length"))
        packed = pack(frame, workers=2).collect()
        assert len(packed) == 20_000
        assert check_places(packed) <= 20_000 * length / 1024 * 9 / 8 * 1.05 + 2
