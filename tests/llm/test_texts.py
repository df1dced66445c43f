"""Operators 2, 3, 5, 6, 8 and 10 against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from skypairs.llm import decontaminate, licenses, neardup, pii, quality, queries, repeats
from skypairs.llm.columns import written
from skypairs.llm.components import components
from skypairs.llm.dart import signatures
from skypairs.llm.license_texts import NOTICES

CAPITALS = {k: k + 32 for k in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(CAPITALS))


@pytest.fixture(scope="module")
def corpus():
    """Random texts, copies, edited copies, long and short ones, shared passages, empties, and repeated keys."""
    g = random.Random(4)
    vocabulary = ["".join(g.choices("abcdeé", k=g.randint(1, 6))) for _ in range(400)]

    def text(n):
        return " ".join(g.choices(vocabulary, k=n))

    rows = [(k, text(g.choice([1, 3, 12, 13, 40, 200]))) for k in range(60)]
    base = text(250).split()
    for k in range(100, 140):
        copy = base[:]
        for _ in range(g.randint(0, 14)):
            copy[g.randrange(len(copy))] = g.choice(vocabulary)
        rows.append((k, " ".join(copy)))
    passage = text(60)
    rows += [(k, f"{text(30)}\n{passage}.  {text(20)}") for k in range(200, 215)]
    rows += [(g.randrange(60), rows[k][1].upper()) for k in range(5)] + [(300, rows[3][1]), (300, rows[3][1])]
    return rows + [(None, rows[70][1]), (None, None), (400, None), (401, ""), (402, " \n "), (403, "x " * 3000), (404, "x " * 2000)]


@pytest.fixture(scope="module")
def items(corpus):
    g = random.Random(5)
    texts = [" ".join(low_words(g.choice([t for _, t in corpus if t and len(t) > 60]))[:n]) for n in (9, 10, 11, 25, 40, 3, 0)]
    texts += ["not in any text at all, for sure, I should think so", None, texts[0]]
    return pa.table({"item_id": pa.array([*range(len(texts))], pa.int64()), "text": pa.array(texts, pa.string())})


@pytest.fixture(scope="module")
def folder(documents, corpus, items):
    labels = pa.table({"doc_id": pa.array([r[0] for r in corpus], pa.int64()),
                       "quality": pa.array([None if k % 9 == 0 else k % 2 for k in range(len(corpus))], pa.int32())})
    return documents(corpus, benchmark=items, labels=labels)


def plain_spans(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
             ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for kind, pattern in kinds:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(digits[::-1]))
            good = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m.group().split(".")),
                    "card": 16 <= len(digits) <= 19 and total % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    g = random.Random(3)
    for _ in range(4000):
        text = "".join(g.choices("0123456789..- +()@ab\n", k=g.randint(1, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("a" * 50_000 + "@" + "1" * 50_000) == [] and pii.base_spans("1" * 9000 + ".1.1.1") == []


@pytest.fixture(scope="module")
def private(documents):
    g = random.Random(6)
    rows = []
    for k in range(120):
        n = "".join(g.choices("0123456789", k=10))
        card = "4" + "".join(g.choices("0123456789", k=14))
        card += next(d for d in "0123456789" if pii.luhn(card + d))
        rows.append((k, g.choice([f"write to ab.{n[:2]}@mail{n[0]}.example.com now", f"call +1 ({n[:3]}) {n[3:6]}-{n[6:]} or",
                                  f"from 10.{n[0]}.{n[1]}.25 on", f"paid by {card} then"])))
    return documents(rows + [(500, None), (501, ""), (None, "a@b.cd"), (502, "nothing private here")])


def test_personal_data(spark, private):
    texts = dict(queries.table(spark, private, "documents").select("doc_id", "text").collect())
    for r in queries.op2_pii(spark, private).collect():
        base = plain_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == sha(pii.joined(base))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(",")) or not base


def test_the_field_finds_other_forms_and_leaves_numbers_alone(spark, private):
    field = pii.train(queries.table(spark, private, "documents"))
    found = lambda t: [t[a:b] for _, a, b in pii.spans(t, field)[1]]
    assert found("call (456) 555-2186 now") == ["(456) 555-2186"]
    assert found("joe.b(at)example.com wrote") == ["joe.b(at)example.com"]
    assert found("on 2024-01-15 at 12:30, v1.2.3, 123456") == []
    masked = pii.masked(queries.table(spark, private, "documents"), field)
    assert masked.columns == queries.table(spark, private, "documents").columns
    left = dict(masked.select("doc_id", "text").collect())
    assert left[500] is None and left[502] == "nothing private here" and not any("@" in (t or "") for t in left.values())


@pytest.mark.parametrize("address", [
    "first.last [at] mail.example.co.uk", "anna.b.smith(at)dept.mail.example.ac.uk", "x_y-z.w+tag [at] a.b-c.example.co.uk",
    "joe [at] example.com", "anna." * 12 + "smith(at)" + "mail." * 12 + "example.com"])
def test_addresses_of_many_tokens_are_found_whole(spark, private, documents, address):
    examples = queries.table(spark, private, "documents")
    field = pii.train(examples)
    for text in (f"write to {address} now", f"ask {address}. Then", address):
        assert [text[a:b] for _, a, b in pii.spans(text, field)[1]] == [address], text
    masked = pii.masked(queries.table(spark, documents([(1, f"write to {address} now")]), "documents"), field)
    assert masked.first().text == "write to [EMAIL] now"


def test_without_examples_the_field_adds_nothing(spark, documents):
    docs = queries.table(spark, documents([(1, "no data"), (2, None)]), "documents")
    assert pii.spans("call (456) 555-2186 now", pii.train(docs)) == ([], [])


def test_the_gradient_is_that_of_the_likelihood():
    text = "x +12 345 6789 y"
    window = next(pii._windows(text))
    chosen = [("phone", 2, 14)]
    before, seen = np.random.default_rng(0).normal(size=(4, pii.SLOTS)) * 0.1, np.ones((4, pii.SLOTS))

    def likelihood(w):
        """Log probability of the segmentation, by listing all of them."""
        def total(j):
            if j == 0:
                return [0.0]
            out = total(j - 1)[:]
            for i, f in window.ends[j]:
                out += [s + v for s in total(i) for v in w[:, list(f)].sum(axis=1)]
            return out
        n = len(window.ends) - 1
        j = next(j for j in range(n + 1) if j and window.tokens[j - 1][1] == 14)
        f = next(f for i, f in window.ends[j] if window.tokens[i][0] == 2)
        return w[3, list(f)].sum() - np.log(np.exp(total(n)).sum())

    after = before.copy()
    pii.Field(after).step(window, chosen, seen)
    assert likelihood(after) > likelihood(before)


def test_licences(spark, documents):
    long = NOTICES[1][1]
    rows = [(1, "All rights reserved. ALL RIGHTS RESERVED."), (2, f"x\n{long}\ny"), (3, "Licensed under Apache License version 2.0"),
            (4, "nothing"), (5, None), (6, ""), (7, "word " * 5000 + "Released under the MIT License" + " word" * 5000), (None, "All rights reserved")]
    got = collections.defaultdict(list)
    for r in queries.op3_licenses(spark, documents(rows)).collect():
        got[r.doc_id].append((r.license, r.coverage))
    assert {k: len(v) for k, v in got.items()} == {1: 2, 2: 1, 3: 1, 7: 1, None: 1}
    assert got[2] == [("Apache-2.0", 1.0)] and got[3] == [("Apache-2.0", 7 / 8)] and got[7] == [("MIT", 1.0)]
    assert queries.op3_licenses(spark, documents([])).count() == 0


def test_each_licence_is_told_from_its_neighbours():
    fixed = tuple(map(tuple, NOTICES))
    for name, text, *_ in fixed:
        for t in (text, f"some words before. {text} And some of the words after."):
            assert [(f[0], f[4]) for f in licenses.found_in(t, fixed)] == [(name, 1.0)], text
    named = {"Licensed under the Mozilla Public License, Version 2.0.": "MPL-2.0", "Released under the BSD License.": "LicenseRef-BSD",
             "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
             "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
             "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
             "Licensed under the Apache License, v2.0": "Apache-2.0", "Released under the MIT Licence": "MIT"}
    for text, name in named.items():
        assert [f[0] for f in licenses.found_in(f"see there: {text} or elsewhere", fixed)] == [name], text
    for text in ("Released under the Foo License.", "Licensed under CC BY-NC 7.0.", "Licensed under the Foo License, Version 2.0."):
        assert licenses.found_in(text, fixed) == [], text


@pytest.mark.parametrize("share", [0.3, 0.6])
def test_a_notice_with_inserted_words_is_found_whole(share):
    fixed, g = tuple(map(tuple, NOTICES)), random.Random(2)
    for name, text, *_ in fixed:
        w = text.split()
        if len(w) < 20:
            continue
        more = [f"x{k}" for k in range(round(share * len(w)))]
        spread = w[:]
        for x in more:
            spread.insert(g.randint(1, len(spread) - 1), x)
        for v in (spread, *(w[:k] + more + w[k:] for k in (len(w) // 6, len(w) // 2, len(w) - 8))):
            whole, before = " ".join(v), "before " * 9
            (found,) = licenses.found_in(f"{before}{whole}" + " after" * 9, fixed)
            # a word that the template repeats is no anchor where inserted words surround it
            assert found[0] == name and found[4] > 0.9, v
            assert v == spread or (found[1] == len(before) and len(before) + len(whole) - found[2] < 6), v
    assert [f[0] for f in licenses.found_in("a b c d e f " + "All rights reserved. " * 2 + "g h", fixed)] == ["NOASSERTION"] * 2


def test_alignment_ascends_in_both():
    g = random.Random(1)
    for _ in range(200):
        a, b = (g.choices("abcdefgh", k=g.randint(0, 12)) for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert licenses.ascending([3, 1, 2, 5, 4]) == [1, 2, 4]


def brute_windows(items):
    found = collections.defaultdict(set)
    for k, t in zip(items["item_id"].to_pylist(), items["text"].to_pylist()):
        w = low_words(t)
        for a in range(max(1, len(w) - 9)) if w else []:
            found[tuple(w[a:a + 10])].add(str(k))
    return found


def test_decontamination(spark, folder, corpus, items):
    found = brute_windows(items)
    want = []
    for key, text in corpus:
        w, hit, got = low_words(text), set(), set()
        for window, names in found.items():
            for a in range(len(w) - len(window) + 1):
                if tuple(w[a:a + len(window)]) == window:
                    hit |= set(range(a, a + len(window)))
                    got |= names
        want.append((key, len(w), len(hit), len(got), sha(",".join(sorted(got))), bool(hit)))
    assert sorted(map(tuple, queries.op5_decontamination(spark, folder).collect()), key=str) == sorted(want, key=str)
    clean = decontaminate.clean(queries.table(spark, folder, "documents"), queries.table(spark, folder, "benchmark"))
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((r[0] for r in want if not r[-1]), key=str)


def test_decontamination_without_broadcasts(spark, folder, monkeypatch):
    want = sorted(map(tuple, queries.op5_decontamination(spark, folder).collect()), key=str)
    monkeypatch.setattr(decontaminate, "SMALL", 1)
    assert sorted(map(tuple, queries.op5_decontamination(spark, folder).collect()), key=str) == want


def test_proximity(spark, documents):
    docs = queries.table(spark, documents([(1, "a x b x c"), (2, "c b a"), (3, "a b"), (4, "a x x x b c")]), "documents")
    terms = spark.createDataFrame([("a",), ("b",), ("c",)], "term string")
    asked = spark.createDataFrame([(1, ["a", "b", "c"])], "query int, terms array<string>")
    index = decontaminate.postings(docs, terms)
    near = decontaminate.proximity_matches(index, asked, 5)
    assert sorted((r.doc, r.pos) for r in near.collect()) == [(1, 0), (2, 0)]


def test_quality(spark, documents):
    g = random.Random(8)
    good = [" ".join("".join(g.choices("abcde", k=5)) for _ in range(40)) + "." for _ in range(150)]
    rows = [(k, t if k % 2 else t.upper().replace(" ", "!! ")) for k, t in enumerate(good)] + [(900, None), (901, ""), (None, "a")]
    labels = pa.table({"doc_id": pa.array([*range(150), 3, None], pa.int64()),
                       "quality": pa.array([*(k % 2 for k in range(150)), None, 1], pa.int32())})
    folder = documents(rows, labels=labels)
    got = {r.doc_id: r for r in queries.op6_quality(spark, folder).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [r for k, r in got.items() if r.held_out and k is not None and k < 900]
    assert len(held) > 20 and np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    kept = quality.kept(queries.table(spark, folder, "documents"), quality.train(
        queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels")))
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.predicted}


def test_trees_without_labels_of_both_kinds():
    x = np.zeros((5, quality.N_FEATURES))
    assert quality.grow(x[:0], np.empty(0)).score(x)[0] == pytest.approx(0.5)
    assert quality.grow(x, np.ones(5)).score(x)[0] > 0.9


def test_trees_by_plain_rules():
    """Flattened trees score as a walk down each does; in the first, every split is the best of all, every leaf a Newton step."""
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 5)).round(1)
    y = (((x[:, 0] > 0) != (x[:, 2] > 0.4)) != (r.random(400) < 0.1)).astype(float)
    trees = quality.grow(x, y)
    inner = 2**quality.DEPTH - 1

    def walk(row, k, node=0):
        if node >= inner:
            return trees.leaves[k][node - inner]
        return walk(row, k, 2 * node + (2 if row[trees.features[k][node]] > trees.cuts[k][node] else 1))

    total = [trees.start + sum(walk(row, k) for k in range(quality.TREES)) for row in x[:60]]
    assert np.allclose(trees.score(x[:60]), 1 / (1 + np.exp(-np.array(total))))

    first, second = y - y.mean(), np.full(len(y), y.mean() * (1 - y.mean()))
    edges = [np.unique(np.quantile(c, [k / quality.BINS for k in range(1, quality.BINS)])) for c in x.T]

    def worth(rows):
        return first[rows].sum() ** 2 / (second[rows].sum() + quality.RIDGE)

    def gain(rows, left):
        return worth(rows & left) + worth(rows & ~left) - worth(rows)

    def look(node, rows):
        if node >= inner:
            step = quality.RATE * first[rows].sum() / (second[rows].sum() + quality.RIDGE)
            assert trees.leaves[0][node - inner] == pytest.approx(step, abs=1e-9)
            return
        sides = [x[:, f] <= e for f in range(5) for e in edges[f]]
        best = max((gain(rows, s) for s in sides if min((rows & s).sum(), (rows & ~s).sum()) >= quality.LEAST), default=0)
        feature, cut = trees.features[0][node], trees.cuts[0][node]
        left = x[:, feature] <= cut
        assert gain(rows, left) == pytest.approx(best, abs=1e-6) if np.isfinite(cut) else best < 1e-6
        look(2 * node + 1, rows & left)
        look(2 * node + 2, rows & ~left)

    look(0, np.ones(len(y), bool))
    assert np.isfinite(trees.cuts[0][0])


def brute_repeats(rows):
    key = lambda k: 2**63 - 1 if k is None else k
    first, words = {}, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (k, _), w in zip(rows, words):
        for a in range(len(w) - 12):
            first[tuple(w[a:a + 13])] = min(first.get(tuple(w[a:a + 13]), key(k)), key(k))
    out = []
    for (k, _), w in zip(rows, words):
        stays = [True] * len(w)
        for a in range(len(w) - 12):
            if first[tuple(w[a:a + 13])] < key(k):
                stays[a:a + 13] = [False] * 13
        left = [x for x, s in zip(w, stays) if s]
        out.append((k, len(w), len(w) - len(left), sha(" ".join(left))))
    return sorted(out, key=str)


def test_repeats(spark, folder, corpus):
    want = brute_repeats(corpus)
    assert sorted(map(tuple, queries.op8_repeats(spark, folder).collect()), key=str) == want
    small = repeats.without_repeats(queries.table(spark, folder, "documents"), gather=500).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, sha(bytes(r.kept).decode())) for r in small), key=str) == want


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = low_words(t)
        sets.append(collections.Counter(tuple(w[a:a + 5]) for a in range(max(1, len(w) - 4))) if w else None)
    of = list(range(len(rows)))

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i + 1, len(rows)):
            if a and sets[j] and root(i) != root(j):
                both = sum((a & sets[j]).values())
                if both >= 0.8 * (sum(a.values()) + sum(sets[j].values()) - both):
                    of[root(j)] = root(i)
    classes = collections.defaultdict(list)
    for k in range(len(rows)):
        classes[root(k)].append(rows[k][0])
    return sorted(((k, min((x for x in c if x is not None), default=None)) for c in classes.values() for k in c), key=str), len(classes)


def test_near_copies(spark, folder, corpus):
    want, n = brute_classes(corpus)
    assert sorted(map(tuple, queries.op10_near_copies(spark, folder).collect()), key=str) == want
    docs = queries.table(spark, folder, "documents")
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == n


def test_signatures_agree_as_often_as_sets_are_similar():
    g = np.random.default_rng(1)
    a = g.integers(0, 2**62, 300).astype(np.uint64)
    b = np.concatenate([a[:240], g.integers(0, 2**62, 60).astype(np.uint64)])
    weights = np.concatenate([np.full(300, 2.0), np.full(300, 1.0)])
    first, second = signatures(np.concatenate([a, b]), weights, np.array([300, 300]), 2000)
    assert (first == second).mean() == pytest.approx(240 / (600 + 60), abs=0.04)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_empty_tables(spark, documents):
    items = pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    labels = pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32())})
    none = documents([], benchmark=items, labels=labels)
    for name in ("op2_pii", "op5_decontamination", "op6_quality", "op8_repeats", "op10_near_copies"):
        assert queries.QUERIES[name](spark, none).count() == 0, name
    some = documents([(1, "a b c")], benchmark=items, labels=labels)
    assert queries.op5_decontamination(spark, some).first().contaminated is False
    assert written(queries.op6_quality(spark, some)).first().score == pytest.approx(0.5)


def test_secrets_are_found_as_wholes(spark):
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'foo token = "{token[k:]}{token[:k]}"### 478538 bar{k}' for k in range(20)] + [f"no name {token} here", "token = short1", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find(docs, pii.train(docs)).collect()}
    for k in range(20):
        at = texts[k].index('"') + 1
        assert [(s.kind, s.start, s.end) for s in found[k] if s.kind == "secret"] == [("secret", at, at + 40)]
    assert not any(s.kind == "secret" for k in (20, 21, 22) for s in found[k])
    assert '"[SECRET]"' in pii.masked(docs, pii.train(docs)).orderBy("doc_id").first().text


@pytest.mark.parametrize("names", [["__key", "__mark", "__found", "__row", "_c0", "_C1"]])
def test_stages_keep_columns_of_any_name(spark, names):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, passage), (2, passage), (3, "one two three four five six"), (2**63 - 1, None), (-2**63, "")]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    items = spark.createDataFrame([("i", passage)], "item_id string, text string")
    for out, keys in ((decontaminate.clean(docs, items), {3, 2**63 - 1, -2**63}), (neardup.one_of_each(docs), {1, 3, 2**63 - 1, -2**63})):
        assert out.columns == docs.columns
        got = out.collect()
        assert {r.doc_id for r in got} == keys and all(r[n] == k for r in got for k, n in enumerate(names))
