"""Operators 1, 7 and 9 against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from skypairs.llm import bpe, queries, records, viterbi

ODD = [None, "", " ", "  ", "\n", "a  b", "a   b", "a \n b", "a\n \nb", " a ", "it's  DON'T", "a" * 3000, "ab" * 400 + " c",
       "😀 😀  😀\n", "é" * 600, "1234 56\t78  9", "a\x0b b", "a\x1c \x1cb", "a \x85 b", "É́ ét ë.", "ΣΑΣ ΟΔΟΣ",
       "<|endoftext|> a", "a\xa0b　c", "日本語 テキスト", "\x00a\x1cb", '"word",(x)y--z', "can't-won't 'll", "▁a ▁▁ b"]


@pytest.fixture(scope="module")
def texts():
    g = random.Random(1)
    letters = [" ", "\n", "\t", "a", "b", "é", "1", "!", "'s", "😀", "the", "É", "\r", "'", ",", "ß", "日", "²"]
    return ODD + ["".join(g.choices(letters, k=g.randint(1, 25), weights=[6] + [1] * 17)) for _ in range(800)]


@pytest.fixture(scope="module")
def folder(documents, texts):
    return documents(list(enumerate(texts)))


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.ranks_of(queries.RANKS)
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_byte_bpe(spark, folder, texts, tokenizer):
    rows = queries.op1_byte_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = tokenizer.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes())), text
        assert r.decoded_sha256 == sha(text.encode())


def test_round_trip_equals_encode_and_decode(spark, folder, texts):
    docs = queries.table(spark, folder, "documents")
    ids = bpe.encode(docs, queries.RANKS, public.PATTERN)
    want = {r.doc_id: bytes(r.ids) for r in ids.collect()}
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(ids, queries.RANKS).collect()}
    rows = bpe.round_trip(docs, queries.RANKS, public.PATTERN).collect()
    assert len(rows) == len(want) == len(texts)
    for r in rows:
        assert bytes(r.ids) == want[r.doc_id] and bytes(r.bytes) == back[r.doc_id] == (texts[r.doc_id] or "").encode() and r.same


def test_one_python_worker_a_task(spark, folder):
    import corpus_pipeline

    docs = queries.table(spark, folder, "documents")
    for rows in (queries.op1_byte_bpe(spark, folder), corpus_pipeline.token_ids(spark, docs, folder)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_remembered_pieces_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 2000, raising=False)
    encoder = bpe._Encoder(queries.RANKS, public.PATTERN)
    g = random.Random(5)
    for _ in range(8):
        texts = [" ".join("".join(g.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(40)) for _ in range(20)]
        values, sizes = encoder(pa.array(texts, pa.large_string()))
        assert len(getattr(encoder.pieces, "known", encoder.pieces)) <= 2000 and len(encoder.inner.known) <= 2000
        assert [v.tolist() for v in np.split(values, np.cumsum(sizes)[:-1])] == [tokenizer.encode_ordinary(t) for t in texts]


def test_fold_of_columns_equals_the_batched_fold(spark, tokenizer):
    words = ["", "a", "worldwide", "überraschung", "日本語", "zzzzzzzz", " indivisible", "antidisestablishmentarianism"]
    ranks = bpe.rank_map(bpe.ranks_of(queries.RANKS))
    got = spark.createDataFrame([(w.encode(),) for w in words], "w binary").select("w", bpe.folded(F.col("w"), ranks).alias("ids"))
    for r in got.collect():
        assert r.ids == tokenizer.encode_single_piece(bytes(r.w)) if hasattr(tokenizer, "encode_single_piece") else (
            r.ids == (tokenizer._encode_single_piece(bytes(r.w)) if r.w else []))


def test_long_pieces(tokenizer):
    g = random.Random(2)
    merges = bpe.Merges(bpe.ranks_of(queries.RANKS))
    for n in (257, 3000):
        piece = "".join(g.choices("abcdefgh", k=n)).encode()
        assert merges.fold([piece])[0].tolist() == tokenizer._encode_single_piece(piece)


def test_records(spark, folder, texts):
    own = Tokenizer.from_file(queries.WORD_TOKENIZER)
    start = 0
    for r in queries.op7_token_records(spark, folder).orderBy("doc_id").collect():
        ids = own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [queries.END]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), texts[r.doc_id]
        start += len(ids)


def test_shuffled_reads_and_shards(spark, folder, texts, tmp_path):
    docs = queries.table(spark, folder, "documents")
    records.write(docs, str(tmp_path), queries.WORD_TOKENIZER, queries.END, shard_bytes=2000)
    index = records.read_index(spark, str(tmp_path))
    assert index.select("shard").distinct().count() > 2 and index.count() == len(texts)
    some = index.where("key % 7 = 3").orderBy(F.rand(1))
    got = {r.key: r.ids for r in records.read(spark, str(tmp_path), some, queries.WORD_TOKENIZER).collect()}
    assert sorted(got) == list(range(3, len(texts), 7))
    own = Tokenizer.from_file(queries.WORD_TOKENIZER)
    assert all(ids == own.encode(texts[k] or "", add_special_tokens=False).ids + [queries.END] for k, ids in got.items())


def test_damaged_records_are_noticed():
    good = records.frame(b"payload") + b"\n"
    assert [p for *_, p in records.frames(good * 2)] == [b"payload"] * 2
    for at in (0, 9, 14, 20):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(Exception):
            list(records.frames(bytes(bad)))


def test_token_counts(spark, folder, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    pieces = [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]
    unigram = Tokenizer(models.Unigram(pieces, 0, True))
    for r in queries.op9_token_counts(spark, folder).collect():
        text = texts[r.doc_id]
        want = len(unigram.encode("▁" + text.replace(" ", "▁")).ids) if text else 0
        if "<" not in (text or ""):
            assert r.n_tokens == want, text


def test_ties_go_to_the_piece_that_starts_first():
    scores = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -4.0, "c": -2.0, "bc": -4.0, "abc": -6.0}
    assert viterbi.Counter(scores)("▁abc") == (2, -7.0)
    with pytest.raises(ValueError):
        viterbi.Counter({"▁": -1.0, "a▁": -2.0})


def test_empty_table_and_repeated_rows(spark, documents):
    none, twice = documents([]), documents([(None, "a b"), (1, "a b"), (1, "a b"), (None, None)])
    for query in (queries.op1_byte_bpe, queries.op7_token_records, queries.op9_token_counts):
        assert query(spark, none).count() == 0
        assert query(spark, twice).count() == 4


def test_more_words_than_one_call_takes():
    path = public.path("word_bpe_49k.json")
    g = random.Random(11)
    words = list({"".join(g.choices("abcdefghijklmnoé", k=g.randint(1, 9))) for _ in range(3000)}) + ["don't", "x1", "", "--"]
    words = g.sample(words, len(words))
    values, lengths = records._Words(path)(words)
    plain = Tokenizer.from_file(path)
    want = [plain.encode(w, add_special_tokens=False).ids for w in words]
    assert lengths.tolist() == [len(w) for w in want] and values.tolist() == [i for w in want for i in w]
