"""Operators 11 to 13: phrases and manifest against plain Python, pieces against the library."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from skypairs.llm import collocations, merkle, oracles, pieces, queries

WORDS = ["the", "The", "of", "a", "cat", "é", "ÉA", "New", "York", "city", "x\x00y", "日本"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Phrases


def some_texts(n, seed):
    g = random.Random(seed)
    out = [None, "", " ", ".", "..,", "\t the\x0bcat ", "New York", "the " * 500]
    for _ in range(n):
        out.append("".join(g.choice(WORDS) + g.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(g.randint(1, 40))))
    return out


def brute_phrases(rows, least, share, top, width):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, width + 1):
                counts[lang].update(tuple(words[a:a + k]) for a in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            inside = [q for q in f if len(q) > len(p) and f[q] >= least and 100 * f[q] >= share * a
                      and any(q[i:i + len(p)] == p for i in range(len(q)))]
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"listed": 3}, {"width": 3, "least": 4, "top": 20, "share": 50}])
def test_phrases(spark, settings):
    texts = some_texts(150, 3)
    rows = [(("en", "fr", None, "und", "")[k % 5], t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 7, "f") for r in rows], "lang string, text string, f int, w1 string").repartition(3)
    got = collocations.collocations(docs, **{"least": 10, **settings}).collect()
    have = {"least": 10, "share": 80, "top": 2000, "width": 4} | {k: v for k, v in settings.items() if k != "listed"}
    want = brute_phrases(rows, **have)
    assert sorted(map(tuple, got)) == want and want


def test_phrases_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).collect() == []


def test_chunks_hold_whole_rows_in_order(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 10)
    texts = ["abc", None, "d" * 25, "", "ef", "ghi", "jklmnop", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 8), pa.array(texts)], ["lang", "text"])
    parts = list(collocations._chunks(iter([batch.slice(0, 5), batch.slice(5, 0), batch.slice(5)])))
    back = [data[a:b].tobytes().decode() for data, offsets, _ in parts for a, b in zip(offsets[:-1], offsets[1:])]
    assert back == [t or "" for t in texts]
    assert all(len(data) <= 10 or len(offsets) == 2 for data, offsets, _ in parts)


# Manifest


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k:k + 16])) for k in range(0, len(last), 16)])
    return levels


def way(levels, at):
    for nodes in levels[:-1]:
        begin = at // 16 * 16
        yield nodes[begin:at], nodes[at + 1:begin + 16]
        at //= 16


def brute_manifest(rows):
    def leaf(row):
        fields = (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))

    def shown(row):
        key = row["doc_id"]
        if key is None or zlib.crc32(str(key).encode()) % 5:
            return leaf(row)
        low = None if row["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])
        return leaf({**row, "text": low})

    trees = collections.defaultdict(list)
    for row in rows:
        trees[row["source"]].append(((row["doc_id"] is not None, row["doc_id"] or 0), leaf(row), shown(row), row["doc_id"]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: up([x[1] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    top = up([levels[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (_, node, other, key) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            path = [*way(levels[s], at), *way(top, k)]
            proof = sha("".join("".join(a + b) for a, b in path))
            for a, b in path:
                other = sha("".join([*a, other, *b]))
            out.append((key, node, levels[s][-1][0], top[-1][0], proof, other, other == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(n, seed, sources):
    g = random.Random(seed)
    rows = [{"doc_id": g.choice([None, g.randint(-5, 9999), 2**63 - 1, -2**63]) if g.random() < 0.05 else k, "text": g.choice([None, "", "Ab É", f"text {k}"]),
             "lang": g.choice([None, "en"]), "source": g.choice(sources), "n_chars": g.choice([None, k])} for k in range(n)]
    return rows + rows[:3] * 2


@pytest.mark.parametrize("n, sources, block", [(700, [None, "", "é", "z", "s1"], 4096), (700, [None, "a", *("a" * 6), "b"], 4096), (40, [f"s{k}" for k in range(30)], 4096), (1, ["s"], 4096)])
def test_manifest(spark, documents, n, sources, block, monkeypatch):
    rows = manifest_rows(n, n, sources)
    schema = "doc_id long, text string, lang string, source string, n_chars long, pos int, total int, tree_no int, digest string"
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, 1, 1, "x") for r in rows], schema).repartition(5)
    columns = [F.col(c) for c in ["doc_id", "source", "lang", "n_chars", "text"]]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf([*columns[:-1], low]))
    got = merkle.manifest(docs, "doc_id", "source", merkle.leaf(columns), shown).collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest(rows)


def test_manifest_of_several_layers(spark):
    """One tree of more than a superblock, against the SQL."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"),
                                    F.when(F.col("id") % 100 > 0, F.lit("big")).alias("source"), F.lit(5).cast("long").alias("n_chars"))
    columns = [F.col(c) for c in ["doc_id", "source", "lang", "n_chars", "text"]]
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf([*columns[:-1], F.lower("text")]))
    got = merkle.manifest(docs, "doc_id", "source", merkle.leaf(columns), shown)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(oracles.MANIFEST)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_manifest_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(docs, "doc_id", "source", merkle.leaf([F.col("doc_id"), F.col("text")]))
    assert got.collect() == [] and got.columns[0] == "doc_id"


# Pieces


@pytest.fixture(scope="module")
def odd_texts():
    g = random.Random(5)
    letters = [" ", "\n", "\t", "a", "b", "é", "1", "!", "'s", "😀", "the", "É", "\r", "▁", "ing", "ß", "日", "²", "\x00", "ꙮ"]
    out = [None, "", " ", "  ", "a ", " a", "▁", "▁▁ a", "<s>", "<0x41>", "a" * 3000, "the" * 40 + " a" * 90, "日本語" * 50]
    return out + ["".join(g.choices(letters, k=g.randint(0, 90), weights=[6] + [1] * 19)) for _ in range(600)]


def test_pieces(spark, documents, odd_texts):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    rows = queries.op13_pieces(spark, documents(list(enumerate(odd_texts)))).collect()
    assert len(rows) == len(odd_texts) and all(r.agrees for r in rows)
    for r in rows:
        ids = library.encode(odd_texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), odd_texts[r.doc_id]
        assert r.decoded_sha256 == sha(library.decode(ids))


def test_both_forms_of_the_agenda(odd_texts):
    agenda = pieces.Agenda(pieces.Vocabulary(queries.PIECES))
    runs = [r for t in odd_texts for r in re.findall("▁+[^▁]*", "▁" + (t or "").replace(" ", "▁")) if len(r) <= pieces.SHORT]
    symbols = [agenda.of_char[[ord(c) for c in r]] for r in runs]
    ids, lengths = agenda.short(np.concatenate(sorted(symbols, key=len)), np.array(sorted(map(len, symbols))))
    for s, part in zip(sorted(symbols, key=len), np.split(ids, np.cumsum(lengths)[:-1])):
        assert agenda.long(s).tolist() == part.tolist()


def test_decoding_of_ids_that_no_text_has():
    library, g = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES), random.Random(6)
    rows = [[g.choice([0, 1, 2, 3, 100, 130, 200, 226, 255, 259, 287, 500, 28705, 28708, 29871]) for _ in range(g.randint(0, 9))] for _ in range(3000)]
    out, ends = pieces.Decoder(queries.PIECES)(np.array([k for r in rows for k in r], np.int64), np.concatenate([[0], np.cumsum([*map(len, rows)])]))
    for row, a, b in zip(rows, ends[:-1], ends[1:]):
        assert out[a:b].tobytes().decode() == library.decode(row), row


def test_a_run_that_the_library_encodes_otherwise_is_told():
    encoder = pieces.Encoder(queries.PIECES)
    work = encoder.agenda.encode
    encoder.agenda.encode = lambda runs: work(["▁no" if r == "▁wrong" else r for r in runs])
    _, sizes, agrees = encoder(pa.array(["right", "is wrong", ""], pa.large_string()))
    assert agrees.tolist() == [True, False, True] and sizes[2] == 0


def test_pieces_of_null_keys_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (None, None), (5, "a")], "doc_id long, text string")
    ids = pieces.encode(docs, queries.PIECES)
    assert sorted((str(r.doc_id), len(r.ids) // 4) for r in ids.collect()) == [("5", 3), ("None", 2), ("None", 3)]
    assert sorted(r.decoded for r in pieces.decode(ids, queries.PIECES).collect()) == ["", "a", "a"]
    assert pieces.encode(docs.limit(0), queries.PIECES).collect() == []
