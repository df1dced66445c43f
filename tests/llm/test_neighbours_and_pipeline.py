"""Operator 4 against brute force, and the stages of the pipeline together."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skypairs.llm import queries

DATA = "/root/testdata/sf0.01"


def write(path, rows):
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()),
                      "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())),
                      "vid": pa.array([1] * len(rows), pa.int32())})
    pq.write_table(table, path / "embeddings.parquet")
    return str(path)


def compare(spark, folder):
    rows = queries.table(spark, folder, "embeddings").select("vec_id", "embedding").collect()
    good = {r.vec_id: np.array(r.embedding, float) for r in rows if r.vec_id is not None and r.embedding
            and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)}
    got = {}
    for r in queries.op4_neighbours(spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q in sorted(k for k in good if k % 100 == 0):
        far = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), k) for k, v in good.items() if k != q and len(v) == len(good[q]))[:10]
        mine = got.pop(q, [])
        assert [r.rank for r in mine] == list(range(1, len(far) + 1))
        for r in mine:
            assert r.score == pytest.approx(np.sqrt(((good[r.vec_id] - good[q]) ** 2).sum()), abs=1e-12)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits, total = hits + len({k for _, k in far} & {r.vec_id for r in mine}), total + len(far)
    assert not got and hits >= 0.9 * total


def test_neighbours(spark):
    compare(spark, DATA)


def test_neighbours_of_odd_vectors(spark, tmp_path):
    g = np.random.default_rng(0)
    rows = [(k, (g.normal(size=8) * g.lognormal()).tolist()) for k in range(300)] + [(k, [1.0] * 8) for k in range(300, 450)]
    rows += [(500, None), (600, [0.0] * 8), (700, [float("nan")] * 8), (800, [None] * 8), (900, [1.0, 2.0]), (901, [1.0, 2.5]),
             (None, [1.0] * 8), (0, rows[0][1])]
    compare(spark, write(tmp_path, rows))


def test_ids_with_several_vectors(spark, tmp_path):
    rows = [(0, [0.0, 0.125]), (0, [5.0, 5.125]), *((k % 7 + 1, [k / 8, 1.0 + k % 3]) for k in range(60)), (100, [5.0, 5.0])]
    got = {}
    for r in queries.op4_neighbours(spark, write(tmp_path, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    for q, found in got.items():
        assert [r.rank for r in found] == list(range(1, len(found) + 1)) and len({r.vec_id for r in found}) == len(found)
        for r in found:
            assert r.score == pytest.approx(min(np.hypot(*np.subtract(a, b)) for i, a in rows if i == q for j, b in rows if j == r.vec_id), abs=1e-12)
    assert sorted(got) == [0, 100]


def test_no_vectors(spark, tmp_path):
    assert queries.op4_neighbours(spark, write(tmp_path, [])).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    from skypairs.llm.columns import written

    docs = queries.table(spark, DATA, "documents")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    predicted = {r.doc_id: r.predicted for r in queries.op6_quality(spark, DATA).collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, DATA))
        left = docs.collect()
        if name == "quality":
            assert {r.doc_id for r in left} == {k for k, p in predicted.items() if p}
        if name == "near_copies":
            classes = __import__("skypairs.llm.neardup", fromlist=["x"]).near_copies(before).collect()
            assert {r.doc_id for r in left} == {r.class_id for r in classes}
        if name == "decontamination":
            overlap = __import__("skypairs.llm.decontaminate", fromlist=["x"]).overlaps(before, queries.table(spark, DATA, "benchmark"))
            assert {r.doc_id for r in left} == {r.doc_id for r in overlap.collect() if not r.hits}
        if name == "personal_data":
            assert {r.doc_id for r in left} == {r.doc_id for r in before.collect()}
            assert not any("@mail" in r.text for r in left) and any("[EMAIL]" in r.text for r in left)
        if name == "token_ids":
            assert all(r.round_trip for r in left)
        else:
            assert docs.columns == columns
            assert name == "personal_data" or all(r == rows[r.doc_id] for r in left)


def test_pipeline_on_odd_rows(spark, documents):
    import corpus_pipeline

    items = pa.table({"item_id": pa.array([1], pa.int64()), "text": pa.array(["one two three four five six seven eight nine ten"])})
    labels = pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32())})
    rows = [(1, None), (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "A b, c"), (None, "x one two three four five six seven eight nine ten"),
            (5, "mail a.b@c.example.com")]
    out = corpus_pipeline.run(spark, documents(rows, benchmark=items, labels=labels)).collect()
    assert sorted(r.doc_id for r in out) == [1, 2, 3, 5] and all(r.round_trip for r in out)
    assert corpus_pipeline.run(spark, documents([], benchmark=items, labels=labels)).count() == 0
