"""Top-k search against all pairs, the pipeline against plain code, and what the driver reads."""

import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quayside.llm import mtree, packing
from quayside.llm.common import cut, finished, work_folder


def brute(rows, every=50, top=5):
    usable = sorted({(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        mine = next(v for i, v in usable if i == q)
        score = lambda v: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(mine, v, strict=False))))  # noqa: B023, E731
        ranked = sorted((-score(v), i) for i, v in usable if i != q)[:top]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(ranked, 1)]
    return out


@pytest.mark.parametrize("case", ["usual", "odd", "few", "huge"])
def test_top_products(spark, case):
    rng = np.random.default_rng(4)
    if case == "usual":
        rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(900)]
    elif case == "few":
        rows = [(50, [1.0, 2.0]), (7, [0.5, 0.25])]
    elif case == "huge":  # one component past what sums of long hold, some past long itself
        rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(200)]
        rows += [(250, [2e7, 0.0, 1.0]), (251, [2e7, 1.0, 0.0]), (300, [3e38, 0.0, 0.0]), (301, [-3e38, 1.0, 0.0]), (302, [3e38, 3e38, -1.0]), (350, [-0.0, 0.0, 0.0])]
    else:  # ties, copies, a common vector, nulls, lengths that differ
        rows = [(i, [float(x) for x in rng.integers(-2, 3, size=4)]) for i in range(300)]
        rows += [(i, [1.0, 0.5, 0.0, -1.0]) for i in range(300, 600)] + [rows[50], rows[50], (None, [1.0] * 4), (601, None), (650, [1.0, None, 2.0, 0.0]), (602, [float("nan"), 1.0, 1.0, 1.0]), (603, [float("inf"), 1.0, 1.0, 1.0]), (604, []), (605, [3.0])]
    df = cut(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(4))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.top_products(df, routers=16).collect())
    assert got == brute(rows)


def test_top_products_of_long_vectors_in_blocks(spark, monkeypatch):
    """768 dimensions, many queries in several blocks, and batches smaller than these; a slab goes only to blocks that reach it."""
    monkeypatch.setattr(mtree, "QUERIES", 7)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=768)]) for i in range(120)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.top_products(df, every=4, routers=6, block_size=5).collect())
    assert got == brute(rows, every=4)


def test_work_folders_go_alone(spark):
    """What is written within goes at the end; what stands beside it, or was written by another thread meanwhile, stays."""
    import threading

    outside, other = cut(spark.range(3)), []
    with work_folder(spark):
        inside = cut(spark.range(4))
        t = threading.Thread(target=lambda: other.append(cut(spark.range(5))))
        t.start()
        t.join()
        result = finished(spark, "r", lambda: cut(spark.range(6)).where("id > 0"))
        assert result.count() == 5 and inside.count() == 4
    assert outside.count() == 3 and other[0].count() == 5
    kept = finished(spark, "r", lambda: cut(spark.range(6)).where("id > 0"))
    assert kept.count() == 5
    with pytest.raises(Exception, match="not exist|NOT_EXIST|NotFound"):
        inside.count()


def test_top_products_of_nothing(spark):
    assert mtree.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert mtree.top_products(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_pages_hold_every_vector(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [i], [float(x) for x in rng.integers(-200, 200, size=6)]) for i in range(1500)]
    df = cut(spark.createDataFrame(rows, "cls long, ids array<long>, v array<double>").repartition(3))
    x = np.array([r[2] for r in rows], float)
    tree = mtree.pages(df, x[:9], float((x**2).sum(axis=1).max()), 6).collect()
    assert sorted(c for p in tree for c in p["cls"]) == list(range(1500))
    assert all(max(p["parent"]) <= p["plain"] + 1e-9 and len(p["cls"]) <= mtree.PAGE for p in tree)


def test_rounds_pass_over_most_of_clustered_vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=16) / 20]) for i in range(4000)]
    df = cut(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4))
    made = mtree.search_rounds(df)
    slabs, queries = made["nodes"].count(), made["asked"].count()
    assert made["first"].count() + made["second"].count() < slabs * queries / 5
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.top_products(df).collect()) == brute(rows)


def test_pipeline_against_plain_code(spark, tmp_path):
    """Every stage has something to do: short, loud, shared, copied and personal text."""
    from tokenizers import Tokenizer
    import public_tokenizers

    from tests.llm.test_text_operators import grouped, plain_counts, plain_fingerprint, plain_spans

    rng = random.Random(8)
    words = ["".join(rng.choices("aeioubcdlmnrst", k=rng.randint(2, 8))) for _ in range(500)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    shared = "this very line is found in many of the documents here"
    texts = {i: say(120) + "\n" + say(60) for i in range(25)}
    for i in range(4, 12):
        texts[i] += "\n" + shared.upper() * (i % 2) + shared * (1 - i % 2)
    texts[25], texts[26], texts[27], texts[28] = texts[3], "too short", None, "spam and eggs " * 60
    texts[29] = texts[3] + "."
    texts[30] = say(80) + " write to a.b@c.example.org or call +1 (499) 555-6503, from 10.1.2.3 with 4111 1111 1111 1111"
    texts[31] = say(6000)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {i: t for i, t in texts.items() if (c := plain_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    holders = [i for i, t in kept.items() if shared in t.lower()]
    kept = {i: "\n".join(x for x in t.split("\n") if x.strip().lower() != shared or i == max(holders)) for i, t in kept.items()}
    roots = grouped([(i, plain_fingerprint(t)) for i, t in kept.items()])
    kept = {i: kept[i] for i, _, root in roots if i == root}
    assert 3 in kept and 25 not in kept and 30 in kept and len(kept) <= len(texts) - 4
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in kept.items():
        for s, _, kind, e in reversed(plain_spans(t)):
            t = f"{t[:s]}<{kind}>{t[e:]}"
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in out)
    assert len({r["sequence_id"] for r in out}) == -(-sum(w[2] for w in want) // 4096) and packing.CAPACITY == 4096


def test_entry_lists_all_operators():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash", "personal data", "packing"]
