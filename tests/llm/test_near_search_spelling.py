"""Embedding near-dedup, ranked search and spelling variants against plain code over the whole of small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quayside.llm import max_sketch, pivot_index, spelling
from quayside.llm.common import ship

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def plain_links(rows, threshold=0.93):
    """vec_id -> (links, component) by comparing all pairs of rows (vec_id, label, vector)."""
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fine = [r[1] is not None and r[2] is not None and all(e is not None and math.isfinite(e) for e in r[2]) and any(r[2]) for r in rows]
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][1] == rows[j][1]:
                x, y = np.array(rows[i][2], float), np.array(rows[j][2], float)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], links[i], min(groups[find(i)])) for i in range(n))


def linked(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    out = pivot_index.near_vectors(df, **options).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in out)


def clustered(seed, n=600, width=24):
    """Vectors around centres at all distances, so that cosines lie on both sides of the threshold; many chains; copies; two labels."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    spread = rng.uniform(0.1, 0.6, size=n)
    x = centres[rng.integers(0, 12, n)] + spread[:, None] * rng.normal(size=(n, width))
    x[n // 2 : n // 2 + 20] = x[0]
    return [(int(i), int(rng.integers(0, 2)), v.tolist()) for i, v in enumerate(x)]


def test_links_are_those_of_all_pairs(spark):
    rows = clustered(1)
    want, got = plain_links(rows), linked(spark, rows)
    assert all(g[1] <= w[1] for w, g in zip(want, got, strict=True)), "no link below the threshold"
    assert sum(g[1] for g in got) >= 0.995 * sum(w[1] for w in want)
    assert pivot_index.recall(rows, {r[0]: r[1] for r in got}) == sum(g[1] for g in got) / sum(w[1] for w in want)
    # where all pivots that are shared count, every pair is verified
    assert linked(spark, rows, kept=128, shared=1) == want


def test_blocks_of_long_lists_change_nothing(spark):
    rows = clustered(2)
    assert linked(spark, rows, block=7) == linked(spark, rows)


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is just above 0.93, the hardest to retrieve, among vectors without structure; more pivots than at least."""
    rng = np.random.default_rng(3)
    x = pivot_index.directions(rng.normal(size=(1500, 64)))
    z = rng.normal(size=x.shape)
    z = pivot_index.directions(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = 0.9305 * x + math.sqrt(1 - 0.9305**2) * z
    rows = [(i, 0, v.tolist()) for i, v in enumerate(np.vstack([x, y]))]
    got = linked(spark, rows, pivots=512)
    assert pivot_index.recall(rows, {r[0]: r[1] for r in got}) >= 0.995


def test_large_group_of_near_copies(spark):
    """A third of all rows in one group: every member is linked with every other, and few pairs leave a task."""
    rng = np.random.default_rng(4)
    group = rng.normal(size=32) + 0.1 * rng.normal(size=(700, 32))
    rest = rng.normal(size=(1400, 32))
    rows = [(i, 5, v.tolist()) for i, v in enumerate(np.vstack([rest, group]))]
    x = pivot_index.directions(group)
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    got = linked(spark, rows, block=128)
    assert sum(g[1] for g in got[1400:]) >= 0.999 * want.sum()
    assert {g[2] for g in got[1400:]} == {1400}


def test_vectors_at_the_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (3, 0, [1.0]), (4, 1, [1.0, 0.0]), (5, None, [1.0, 0.0]), (6, 0, None), (7, 0, []), (8, 0, [0.0, 0.0]),
        (9, 0, [1.0, None]), (10, 0, [nan, 1.0]), (11, 0, [inf, 1.0]), (12, 0, [1e300, 1e290]), (13, 0, [1e-310, 0.0]), (14, 0, [-1.0, 0.0]), (1, 0, [1.0, 0.0]),
        (15, 2, [0.93, math.sqrt(1 - 0.93**2)]), (16, 2, [1.0, 0.0]), (17, 2, [0.9299, math.sqrt(1 - 0.9299**2)]),
    ]
    got = linked(spark, rows)
    assert [g for g in got if g[0] <= 3] == [(1, 5, 1), (1, 5, 1), (2, 5, 1), (3, 5, 1)]
    assert dict((g[0], g[1:]) for g in got if g[0] > 3) == {4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8), 9: (0, 9), 10: (0, 10), 11: (0, 11), 12: (5, 1), 13: (5, 1), 14: (0, 14), 15: (2, 15), 16: (1, 15), 17: (1, 15)}
    nameless = pivot_index.near_vectors(spark.createDataFrame([(None, "a", [1.0]), (None, "b", [1.0]), (7, "a", [2.0])], "vec_id int, label string, embedding array<float>").withColumnRenamed("label", "LABEL")).collect()
    assert sorted(map(tuple, nameless), key=str) == [(7, 1, 7, True), (None, 0, None, True), (None, 1, 7, False)]
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<double>, kept int, n_links string, h1 int")
    assert pivot_index.near_vectors(empty).collect() == []
    clash = spark.createDataFrame([(1, 0, [1.0], 3, "x", 4), (2, 0, [1.0], 3, "x", 4)], empty.schema)
    assert sorted(map(tuple, pivot_index.near_vectors(clash).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def plain_search(docs, items, top=50):
    held = [(i, Counter(TERM.findall("" if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)))) for i, t in docs]
    n, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = set(TERM.findall("" if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))
        scored = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    return sorted(map(tuple, max_sketch.lexical_search(d, spark.createDataFrame(items, "item_id long, text string"), **options).collect()), key=str)


def test_search_finds_what_scoring_all_documents_does(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    zipf = 1 / np.arange(1, 3001)
    text = lambda n: " ".join(rng.choice(words, n, p=zipf / zipf.sum()))
    docs = [(i, text(int(rng.integers(1, 400)))) for i in range(500)] + [(500 + i, "ties here w7") for i in range(120)] + [(700, text(30000))]
    items = [(i, text(25)) for i in range(20)] + [(20, "ties"), (20, "here ties"), (21, docs[3][1])]
    want = plain_search(docs, items)
    assert searched(spark, docs, items) == want
    monkeypatch.setattr(max_sketch, "BLOCK", 4)  # several blocks of queries
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, top=3) == plain_search(docs, items, 3)


def test_bounds_are_never_below_scores():
    """A sketch's bound of a document is its score at least, also where terms share a coordinate."""
    rng = np.random.default_rng(6)
    vocabulary = {b"t%d" % i: i for i in range(5000)}
    df = rng.integers(1, 50, 5000)
    block = max_sketch.Block([list(rng.integers(0, 5000, 40)) for _ in range(8)], vocabulary, df, 60, 90000)
    loads = block.loads()
    for _ in range(20):
        tf = np.where(rng.random(5000) < 0.3, rng.integers(1, 9, 5000), 0)
        m = block.norm(np.array([tf.sum()]))
        sketch = np.zeros(max_sketch.WIDTH)
        np.maximum.at(sketch, block.where, block.impact(tf, m))
        for q, held in enumerate(block.queries):
            assert sketch @ loads[:, q] >= block.impact(tf, m)[np.unique(held)] @ block.weight[np.unique(held)]


def test_search_at_the_edges(spark):
    docs = [(1, None), (2, ""), (3, " -- \n"), (4, "Über Éa x9"), (4, "über Éa x9"), (None, "Éa"), (5, "éa x9 X9"), (6, "a b c")]
    items = [(1, "ÉA x9 x9 X9"), (2, None), (3, "--"), (None, "Éa"), (4, "a b c"), (5, "nowhere")]
    assert searched(spark, docs, items) == plain_search(docs, items)
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == []
    clash = spark.createDataFrame([(1, "word", 5, "q")], "doc_id int, text string, rank int, score string")
    item = spark.createDataFrame([("i", "word", 9, "d")], "item_id string, text string, doc_id int, q string")
    assert [(r.item_id, r.rank, r.doc_id) for r in max_sketch.lexical_search(clash, item).collect()] == [("i", 1, 1)]


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def plain_variants(docs, every=31, least=2, times=10):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= least}
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(close[w], key=lambda v: (-n[v], v)) for w in n if close[w] and max(n[v] for v in close[w]) >= times * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(close[w]), n[form[w]] if w in form else None))
    return sorted(out)


def variants(spark, docs, **options):
    return sorted(map(tuple, spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), **options).collect()))


def test_variants_are_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    stems = ["".join(rng.choice(list("abÀé"), int(rng.integers(7, 13)))) for _ in range(150)] + ["documentation", "Documentaton", "docments"]
    docs = [(i, " ".join(s for s in rng.choice(stems, 120, p=None))) for i in range(40)] + [(100 + i, "documentation DOCUMENTATION " * 30) for i in range(9)]
    want = plain_variants(docs, every=3)
    assert any(w[1] for w in want) and sum(w[4] for w in want) > 200
    assert variants(spark, docs, every=3) == want
    monkeypatch.setattr(spelling, "PART", 16)  # many parts, split into blocks
    assert variants(spark, docs, every=3) == want


def test_chains_of_forms_end_at_their_root(spark):
    chain = ["abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    docs = [(i, " ".join([w] * 10**k)) for i, (k, w) in enumerate(enumerate(chain)) if k] + [(9, chain[0])]
    want = plain_variants(docs, every=10**12, least=1)
    assert [w[2] for w in want] == [chain[-1]] * 4
    assert variants(spark, docs, every=10**12, least=1) == want


def test_words_at_the_edges(spark):
    long = "x" * 3000
    docs = [(1, None), (2, ""), (3, "× ÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷÷"), (None, "nameless nameless Àgreeable Àgreeable àgreeable àgreeable"), (4, f"{long} {long} {long}y {long}y {long[:-1]} {long[:-1]}"), (4, "ĀĀĀĀĀĀĀ repeated, repeated"), (4, "repeated")]
    assert variants(spark, docs, every=10**12) == plain_variants(docs, every=10**12)
    assert variants(spark, docs, every=2) == plain_variants(docs, every=2)
    assert variants(spark, []) == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), times=1)
    clash = spark.createDataFrame([(1, "clashing clashing", 5, "q")], "doc_id int, text string, word int, n string")
    assert [tuple(r) for r in spelling.spelling_variants(clash, every=10**12).collect()] == [("clashing", None, "clashing", 2, 0, None)]
