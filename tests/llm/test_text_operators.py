"""The operators that work within and across texts, against plain versions and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quayside.llm import language_id, license_scan, line_dedup, packing, pii, quality_classifier, quality_rules, sentencepiece, simhash
from quayside.llm.common import cut
from quayside.llm.lattice import Remembered, vocabulary

LONG = "the shared line that many documents hold, word for word"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (6, "ÀÉ été 漢字 🙂 ½ \x1c x"), (7, "a b c a b c a b c"), (8, "same\nsame\n\nsame"),
    (9, f"{LONG}\nx"), (10, f"  {LONG.upper()}\t\nx\n{LONG}"), (11, LONG), (12, f"{LONG}\r"), (13, f"y\n{LONG}"), (14, f"{LONG}\nz"),
    (15, "mail a.b+c@x-y.example.com, ip 10.0.0.256 192.168.001.1 card 4111 1111 1111 1111 phone +1 (499) 555-6503."),
    (16, "1.2.3.4.5.6.7.8 a@b.c.d%x@e.f @@ 4111-1111-1111-1112 +123 +1234567890123456 12--34"),
    (17, "x" * 50_000), (18, "1 " * 20_000), (19, "a@b." * 9_000 + "c"), (20, "7" * 30_000), (21, "+1 (" * 5_000), (22, "a.b " * 9_000), (11, LONG), (None, "no id at all"), (None, None),
    (23, "<|endoftext|> it's we'll 1234 <<>> naïve"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i is None or i % 2 else None, None, 7) for i, t in ODD]
    # extra columns with names that operators use
    return cut(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long").repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_words long")


def prose(n, seed, vocabulary_size=400):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeioubcdlmnrst", k=rng.randint(2, 9))) for _ in range(vocabulary_size)]
    return [" ".join(rng.choices(words, k=rng.randint(60, 200))) + "." for _ in range(n)]


def test_line_dedup(docs, empty):
    holders = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t in ODD:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    want = []
    for i, t in ODD:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and i != max(h for h in holders[key(x)] if h is not None))]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.line_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[2] for r in want)
    assert line_dedup.line_dedup(empty).count() == 0
    cleaned = line_dedup.without_shared_lines(docs)
    assert cleaned.columns == docs.columns and cleaned.where("text IS NULL").count() == 2


def plain_fingerprint(text):
    words = WORDS.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(pairs):
    """Smallest id reachable: prints (id, fp) linked at two bits or fewer."""
    prints = sorted({fp for _, fp in pairs})
    root = {fp: fp for fp in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, fp in pairs:
        if d is not None:
            least[find(fp)] = min(d, least.get(find(fp), d))
    return sorted(((d, fp, least.get(find(fp))) for d, fp in pairs), key=str)


def test_simhash(docs, empty):
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_groups(docs).collect()]
    assert sorted(got, key=str) == grouped([(i, plain_fingerprint(t)) for i, t in ODD])
    assert simhash.simhash_groups(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({c for d, _, c in got if d == c and d is not None})


def test_simhash_links_large_groups(spark):
    """Chains, a large group around one fingerprint (more than SMALL share two segments), and bits in every segment."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)]
    prints += [rng.getrandbits(64) for _ in range(200)]
    for k in range(40):
        a = rng.getrandbits(64)
        prints += [a, a ^ (1 << (k % 64)), a ^ (3 << (k % 62)), a ^ (7 << (k % 60))]
    rows = list(enumerate(prints))
    df = cut(spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in rows], "doc_id long, fp long"))
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash._grouped(df).collect()), key=str)
    assert got == grouped(rows)
    assert [r[0] for r in spark.range(1).select(simhash.hex_digits(F.lit(-1)), ).collect()] == ["f" * 16]


def test_packing(docs, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in ODD:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    out = packing.best_fit_packing(docs).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=str) == sorted(want, key=str)
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == -(-sum(w[3] for w in want) // 4096)
    assert packing.best_fit_packing(empty).count() == 0
    made = packing.sequences(docs).collect()
    assert sum(r["n_tokens"] for r in made) == sum(w[3] for w in want) and all(len(r["ids"]) == r["n_tokens"] for r in made)


def test_packing_spreads_equal_rows(spark):
    """30,000 rows with no id and equal texts are dealt to groups like any others."""
    df = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1500).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"))
    sizes = []
    packer = packing._packer

    def watched(capacity, last):
        pack = packer(capacity, last)
        return lambda key, part: pack(key, part).assign(offset=len(part))

    packing._packer = watched
    try:
        sizes = [r["offset"] for r in packing.pack(df, group=2000, rounds=1).select("offset").distinct().collect()]
    finally:
        packing._packer = packer
    assert max(sizes) <= 2100
    out = packing.pack(df, group=2000).toPandas()
    fill = out.groupby("sequence_id")["length"].agg(["sum", "size"])
    assert len(out) == 30_000 and fill["sum"].max() <= 4096 and len(fill) == 15_000


def test_remembered_words_are_bounded_in_bytes():
    known = Remembered(1000, most_chars=10_000)
    for k in range(50):
        known.turn()
        words = {f"{k}-{i}-" + "x" * 400 for i in range(20)}
        known.add({w: 1 for w in known.missing(words)})
        assert words <= set(known.young) and sum(map(len, [*known.young, *known.old])) < 40_000
    encode = packing.encoder()
    for k in range(30):
        encode(" ".join(f"{k}{i}" + "y" * 2000 for i in range(600)))
        assert sum(map(len, encode.young)) + sum(map(len, encode.old)) < 3 * packing.CHARS


def test_packing_rounds_and_bounds(spark):
    rng = random.Random(5)
    lengths = [rng.choice([rng.randint(1, 4096), rng.randint(1500, 2600), rng.randint(1, 300)]) for _ in range(3000)]
    df = spark.createDataFrame([(i, 0, 0, x, 0) for i, x in enumerate(lengths)], packing.PIECES)
    out = packing.pack(df, group=200).toPandas()
    fill = out.groupby("sequence_id")["length"].sum()
    bound = packing.lower_bound(np.array(lengths))
    assert len(out) == 3000 and fill.max() <= 4096 and bound <= len(fill) <= 1.02 * bound
    for case in ([2049] * 5, [1366] * 7, [4096, 1], [3000, 1097, 1000, 2000], [1]):
        _, _, bins = packing.best_fit(np.array(sorted(case, reverse=True)))
        assert packing.lower_bound(np.array(case)) <= bins
    assert packing.lower_bound(np.array([2049] * 5)) == 5 and packing.lower_bound(np.array([], int)) == 0


def plain_counts(text):
    t = text or ""
    words = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeat = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat)


def test_quality_rules(docs, empty, spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (None, 1)], "doc_id long, quality int")
    out = quality_rules.quality_rules(docs, labels).collect()
    want = [(i, *plain_counts(t)) for i, t in ODD]
    assert sorted([tuple(r[c] for c in ("doc_id", *quality_rules.COUNTS)) for r in out], key=str) == sorted(want, key=str)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    assert quality_rules.quality_rules(empty, labels).count() == 0
    assert quality_rules.kept_documents(docs, labels).columns == docs.columns


def test_quality_cutoffs_are_certified(spark):
    """Bad texts are loud; the cutoffs reject them and hold the false rejections of good ones within the bound."""
    from math import comb

    good, bad = prose(2500, 1), [" ".join(w + "##$" for w in t.split()) for t in prose(300, 2)]
    texts = good + bad
    docs = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(len(texts))], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs, labels, alpha=0.02).where("kept").collect()}
    assert not kept & set(range(len(good), len(texts))) and len(kept) >= 0.98 * len(good)
    for n, k in ((100, 0), (400, 3), (5000, 60), (20, 5)):
        exact = sum(comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1)) if k <= n * 0.02 else 1.0
        got = spark.range(1).select(quality_rules.binomial_at_most(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.02)).first()[0]
        assert got == pytest.approx(exact, rel=1e-9)


def test_quality_strata_share_evidence(spark):
    """A stratum with too few labels is merged with its neighbour, and the cutoff is certified on both together."""
    good, bad = prose(500, 1), [" ".join(w + "##$" for w in t.split()) for t in prose(100, 2)]
    texts = good + bad
    sizes = Counter(len(t.split()) < 100 for t in good)
    assert min(sizes.values()) < quality_rules.least_labels() == 286 <= len(good)
    docs = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(len(texts))], "doc_id long, quality int")
    assert {r["doc_id"] for r in quality_rules.kept_documents(docs, labels).select("doc_id").collect()} == set(range(len(good)))
    assert {r["doc_id"] for r in quality_rules.kept_documents(docs, labels.limit(0)).select("doc_id").collect()} == set(range(len(texts)))


def test_quality_strata_merge_neighbours(spark):
    def groups(*n):
        return list(spark.range(1).select(*quality_rules.merged_strata([F.lit(x).cast("long") for x in n], 10)).first())

    assert groups(10, 10, 10, 10) == [0, 1, 2, 3] and groups(3, 7, 20, 4) == [0, 0, 1, 1] and groups(0, 0, 0, 9) == [None] * 4
    assert groups(10, 1, 1, 1) == [0, 0, 0, 0] and groups(1, 1, 1, 7) == [0, 0, 0, 0] and groups(9, 9, 0, 30) == [0, 0, 1, 1]


def test_quality_cutoffs_hold_in_each_stratum(spark):
    """Short good texts are loud, long ones are not: a cutoff that all texts together would certify isn't applied to the short ones, whose own bound fails."""
    short = [" ".join(w + "#" for w in t.split()[:60]) for t in prose(1200, 4) if len(t.split()) >= 60][:400]
    long = [t for k in range(8) for t in (" ".join(prose(40, 10 + k * 7 + j)) for j in range(60))]
    bad = [" ".join(w + "##$" for w in t.split()) for t in long[:80]]
    texts = short + long + bad
    docs = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    labels = spark.createDataFrame([(i, int(i < len(short) + len(long))) for i in range(len(texts))], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}
    assert len(kept & set(range(len(short)))) >= 0.98 * len(short) and not kept & set(range(len(short) + len(long), len(texts)))


SPOILT = {
    "symbols": lambda t: " ".join(w + "##$" for w in t.split()),
    "capitals": str.upper,
    "repeats": lambda t: t + " " + " ".join(t.split()[:30]) + " " + t.split()[-1] + " " + " ".join(t.split()[:30]),
    "lines": lambda t: "\n".join([*(" ".join(t.split()[i : i + 4]) for i in range(0, len(t.split()), 4)), *["odd bit"] * 12]),
}


@pytest.mark.parametrize("rule", list(SPOILT))
def test_quality_rule_has_a_cutoff_as_in_sql(spark, rule, tmp_path):
    """Each rule alone finds the texts that it is for, with cutoffs that are certified, and SQL gives the same rows."""
    duckdb = pytest.importorskip("duckdb")
    good, bad = prose(420, 1), [SPOILT[rule](t) for t in prose(90, 2)]
    texts = good + bad
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < len(good))) for i in range(len(texts))], "doc_id long, quality int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    docs, labels = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    counts = cut(quality_rules.counted(docs).drop("text"))
    assert any(r[f"cut_{rule}"] is not None for r in quality_rules.cutoffs(counts, labels).collect())
    columns = ["doc_id", *quality_rules.COUNTS, "base_failed", "kept"]
    got = sorted(tuple(r) for r in quality_rules.quality_rules(docs, labels).select(*columns).collect())
    con = duckdb.connect()
    for n in ("documents", "labels"):
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet/*.parquet'")
    assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({quality_rules.sql()})").fetchall())
    assert all(r[-1] for r in got if r[0] < len(good)) and not any(r[-1] for r in got if r[0] >= len(good))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_pii(docs, empty):
    safe = [(i, t) for i, t in ODD if i not in (17, 19, 22)]  # Python's own search is quadratic there
    out = pii.pii_spans(docs).collect()
    got = {(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in out}
    for i, t in safe:
        spans = plain_spans(t)
        text = ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in spans)
        assert (i, *(sum(x[2] == k for x in spans) for k in BASE), hashlib.sha256(text.encode()).hexdigest()) in got, (i, text)
    assert len(out) == len(ODD) and pii.pii_spans(empty).count() == 0
    by_id = {r["doc_id"]: r for r in out}
    assert (by_id[17]["n_email"], by_id[19]["n_email"]) == (0, 4500)
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert clean[15].startswith("mail <email>, ip 10.0.0.256 <ip> card <card> phone <phone>") and clean[1] is None and clean[4] == "one"


def test_pii_trees(spark):
    """A phone without a plus isn't of a format; the trees learn it from those that are, and bad cards stay out."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        n = lambda k: "".join(rng.choices("0123456789", k=k))
        rows.append((i, f"call +1 ({n(3)}) {n(3)}-{n(4)} today, order {n(5)} of {rng.randint(1990, 2030)}, ref {n(6)}"))
    rows.append((1000, "call 1 (499) 555-6503 today, order 12345"))
    df = cut(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["spans"] for r in pii.pii_spans(df).collect()}
    assert "number" in got[1000] and got[1000].count(":") == 2
    assert all(s.count("phone") == 1 and s.count(":") == 2 for i, s in got.items() if i < 400)
    assert pii.boost([]) == ([], {})


def test_pii_secrets_need_no_hex(spark):
    """Keys of letters or in base64, no hexadecimal run in any text; long words in prose stay."""
    rng = random.Random(9)
    key = lambda letters: "".join(rng.choices(letters, k=28))
    plain, base64 = "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ", "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ23456789+/"
    rows = [(i, f"set api_key = {key(plain if i % 2 else base64)} in the file, an internationalisation {key(plain).lower()} of things") for i in range(400)]
    df = cut(spark.createDataFrame(rows, "doc_id long, text string"))
    at = {i: (t.index("= ") + 2, t.index("= ") + 30) for i, t in rows}
    got = {r["doc_id"]: r["spans"] for r in pii.pii_spans(df).collect()}
    assert all(got[i] == f"secret:{at[i][0]}:{at[i][1]}" for i, _ in rows)


def test_pii_mentions(spark):
    """E-mails teach what a mention is; words beside an (at) without a domain stay."""
    rng = random.Random(10)
    name = lambda: "".join(rng.choices("abcdefghijk", k=6))
    rows = [(i, f"mail {name()}.{name()}@{name()}.example.org or meet (at) noon, {name()} [at] home. Order {rng.randint(10000, 99999)} of {rng.randint(1990, 2030)}") for i in range(400)]
    rows += [(1000, "write to jane.roe [at] mail.example.com today"), (1001, "ask joe(at)example.org."), (1002, "dinner (at) eight, then (at) home"), (1003, "mail ann (AT) uni.example.edu now")]
    df = cut(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert (got[1000], got[1002], got[1003]) == ("write to <mention> today", rows[-2][1], "mail <mention> now")
    assert got[1001].startswith("ask <mention>") and all(got[i].count("<") == 1 and "meet (at) noon" in got[i] for i in range(400))


def plain_features(x, before, kind):
    digits, low = re.sub("[^0-9]", "", x), before.lower()
    bucket = lambda n, *at: sum(n >= a for a in at)
    odd = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return {
        "generator": pii.KINDS.index(kind), "digits": bucket(len(digits), 4, 7, 9, 10, 12, 16, 20), "letters": bucket(len(re.sub("[^A-Za-z]", "", x)), 1, 5, 12), "marks": bucket(len(re.sub(r"[^.\x20()/-]", "", x)), 1, 3, 5),
        "hex": int(not re.sub("[0-9A-Fa-f]", "", x)), "luhn": int(12 <= len(digits) <= 19 and odd % 10 == 0), "brackets": int(bool(re.search("[()]", x))), "context": int(bool(re.search(pii.CONTEXT, low))), "phone_word": int(bool(re.search(pii.PHONE_WORD, low))),
        "assigned": int(bool(re.search("[=:]\\s?[\"']?$", before))), "runs": bucket(len(re.findall("[0-9]+", x)), 1, 2, 4, 8), "cases": int(bool(re.search("[a-z]", x) and re.search("[A-Z]", x))), "domain": int(kind == "mention" and bool(re.search(pii.DOMAIN, x))),
    }


def plain_all_spans(text, trees, thresholds):
    """All spans by hand: base matches are blotted out, and what the trees accept of the rest is merged where it touches."""
    base = plain_spans(text)
    left = list(text)
    for s, _, _, e in base:
        left[s:e] = "\0" * (e - s)
    left, good = "".join(left), []
    for kind, pattern in pii.MORE.items():
        at = 0
        for m in re.finditer(pattern, left):
            f = plain_features(m[0], left[max(at, m.start() - pii.BEFORE) : m.start()], kind)
            at = m.end()
            if re.search(pii.NEEDS[kind], left) and pii.score_of(trees, f) >= thresholds.get(kind, float("inf")):
                good.append((m.start(), pii.KINDS.index(kind), kind, m.end()))
    merged = []
    for s, k, kind, e in sorted(good):
        if merged and s < merged[-1][3]:
            merged[-1] = (*merged[-1][:3], max(e, merged[-1][3]))
        else:
            merged.append((s, k, kind, e))
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(base + merged))


def test_pii_spans_against_plain_code(spark):
    rng = random.Random(12)
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda k=7: "".join(rng.choices("abcdefghijk", k=k))
    rows = [f"call +1 ({n(3)}) {n(3)}-{n(4)} or mail {word()}.{word()}@{word()}.example.org, order {n(5)} of {rng.randint(1990, 2030)}, api_key = {word(20)}{n(9)} and {word(30)}" for _ in range(300)]
    odd = ["phone: 1 (499) 555-6503, 4111.1111.1111.1111 and 4111 1111 1111 1111", "tel 1 (499) 555-6503 jane [at] mail.example.com 2024-01-05 10:30", "token=aaaaaaaaaaaaaaaaaaaaaaaaaaaa1111222 (at) x.example.org.", "ann@example.org (at) b.example.org +1 499 555 650312345678", "\u00e9\U0001f642 call 1 (499) 555-6503\u00e9", "", "12 34", "key: " + "aB3/" * 300 + " end", "write to jane.roe [at] mail.example.com now"]
    texts = odd + rows
    df = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    trees, thresholds = pii.boost(sorted((r.asDict() for r in pii.tally(pii.spotted(df.select("text"))).collect()), key=lambda r: [r[f] for f in (*pii.FEATURES, "fold")]))
    assert set(thresholds) == {"number", "secret", "mention"}
    got = {r["doc_id"]: r["spans"] for r in pii.pii_spans(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_all_spans(t, trees, thresholds), t
    assert "number" in got[0] and "secret" in got[7] and "mention" in got[8]


def test_pii_many_matches_in_one_text(spark):
    """20,000 matches: nothing is compared with all others of its text."""
    import time

    one = "call +1 (499) 555-6503 or 1 (499) 555-6503, id 7; "
    df = cut(spark.createDataFrame([(1, one * 100), (2, "x")], "doc_id long, text string"))
    pii.redacted(df).collect()  # plans are compiled
    began = time.perf_counter()
    pii.redacted(df).collect()
    small = time.perf_counter() - began
    df = cut(spark.createDataFrame([(1, one * 10_000), (2, "x")], "doc_id long, text string"))
    began = time.perf_counter()
    text = pii.redacted(df).where("doc_id = 1").first()["text"]
    assert time.perf_counter() - began < small + 10
    assert text.count("<phone>") == 10_000 and "+1" not in text


def test_license_scan(docs, empty, spark):
    texts = [(1, "Released under the MIT License."), (2, "x\nReleased  UNDER the mit license\ny"), (3, "This work is licensed under the GNU Lesser General Public License, version 3."), (4, None), (5, "the MIT"), (6, "Released under the MIT License.\n" * 50), (7, "Released under the MIT License and much more than that in one line of it")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r["doc_id"], r["line"], r["license"], round(r["dice"], 3)) for r in license_scan.license_scan(df).collect())
    grams = lambda s: set(zip(*(lambda w: (w, w[1:]))(re.sub("[^a-z0-9]+", " ", s.lower()).split()), strict=False))
    want = []
    for i, t in texts:
        for line, unit in enumerate([t or "", *(t or "").split("\n")]):
            for name, template in license_scan.TEMPLATES.items():
                a, b = grams(unit), grams(template)
                if a and 2 * len(a & b) / (len(a) + len(b)) >= 0.8:
                    want.append((i, line, name, round(2 * len(a & b) / (len(a) + len(b)), 3)))
    assert got == sorted(want) and any(w[3] < 1 for w in want)
    assert license_scan.license_scan(empty).count() == 0 and license_scan.license_scan(docs).count() == 0


def test_license_passages(spark):
    """Notices over several lines, in lines of prose and in full; a line or text that has a row of its own gives no passage."""
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choices("aeioubcdlmnrst", k=rng.randint(2, 8))) for _ in range(n))
    wrapped = lambda t, n, mark: "\n".join(mark + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    apache, mit = license_scan.FULL["apache-2.0-notice"], license_scan.FULL["mit-notice"]
    texts = [
        (1, f"{say(40)}\n{wrapped(apache, 9, ' * ')}\n{say(300)}"),
        (2, f"{say(30)} {mit} {say(30)}\n{say(200)}"),
        (3, f"{say(200)}\n{say(9)} Released under the MIT License. {say(12)}"),
        (4, f"x\nReleased under the\nMIT License.\n{say(100)}\n{wrapped(license_scan.FULL['gpl-notice'], 8, '# ')}\n{say(5)}"),
        (5, f"{say(50)}\nReleased under the MIT License.\n{say(50)}"), (6, say(400)), (7, "the license of the MIT and the GNU general public license under this version of the software"),
        (8, wrapped(license_scan.FULL["bsd-conditions"], 7, "// ") + "\n" + say(2000)),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {}
    for r in license_scan.license_scan(df, inside=True).collect():
        got.setdefault(r["doc_id"], set()).add((r["license"], r["line"], round(r["dice"], 2)))
    assert ("apache-2.0-notice", 2, 1.0) in got[1] and ("mit-notice", 1, 1.0) in got[2] and got[3] == {("mit", 2, 1.0)}
    assert {("mit", 2, 1.0), ("gpl-notice", 5, 1.0)} <= got[4] and got[5] == {("mit", 2, 1.0)} and ("bsd-conditions", 1, 1.0) in got[8]
    assert not {6, 7} & set(got)
    units = {(r["doc_id"], r["line"], r["license"]) for r in license_scan.license_scan(df).collect()}
    assert units < {(i, line, name) for i, rows in got.items() for name, line, _ in rows}


def plain_runs(text, grams, least):
    """(start, bigrams, dice) of the best run from each start, over all lengths; of equals the shortest."""
    words = license_scan._words(text)
    g = [f"{a} {b}" for a, b in zip(words, words[1:])]
    out = []
    for s in range(len(g)):
        best = (0.0, 0)
        for n in range(1, len(g) - s + 1):
            run = set(g[s : s + n])
            dice = 2 * len(run & grams) / (len(run) + len(grams))
            if dice > best[0] + 1e-12:
                best = (dice, n)
        if best[0] >= least - 1e-12:
            out.append((s, best[1], best[0]))
    return out


def test_license_passages_of_every_length(spark):
    """Notices with 1 to 60 words put in, taken out or repeated somewhere: a passage is found just where a run of some length reaches the coefficient, and the best of the text is found as it is."""
    rng = random.Random(11)
    name, template = "mit-notice", license_scan.FULL["mit-notice"]
    grams, words = set(license_scan._bigrams(template)), template.split()
    texts = []
    for k in range(90):
        at, n = rng.randrange(1, len(words)), rng.randrange(1, 61)
        kind = k % 3
        mid = [f"odd{rng.randrange(999)}" for _ in range(n)] if kind == 0 else [] if kind == 1 else words[max(0, at - 3) : at] * (n // 3)
        texts.append(" ".join([*(f"before{i}" for i in range(60)), *words[: at if kind != 1 else max(1, at - n // 3)], *mid, *words[at:], *(f"after{i}" for i in range(60))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got: dict[int, list[float]] = {}
    for r in license_scan.license_scan(df, templates={name: template}, inside=True).where("line > 0").collect():
        got.setdefault(r["doc_id"], []).append(r["dice"])
    want = {i: plain_runs(t, grams, 0.8) for i, t in enumerate(texts)}
    assert {i for i, runs in want.items() if runs} == set(got) and 30 < len(got) < 90
    for i, dices in got.items():
        assert max(dices) == pytest.approx(max(r[2] for r in want[i]))


def test_language_id(spark, docs, empty):
    rng = random.Random(2)
    parts = {"aa": ["the", "ing", "wh", "tion", "and"], "bb": ["sch", "ung", "ein", "der", "keit"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(60)), lang) for i, lang in enumerate(["aa", "bb"] * 120)]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (1003, "ein" * 400, None), (None, "the whing", "aa")]
    df = cut(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    out = {r["doc_id"]: r for r in language_id.language_id(df).collect()}
    assert len(out) == len(rows)
    held = [(i, lang) for i, _, lang in rows if i is not None and i < 1000 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(out[i]["held_out"] and out[i]["lang_pred"] == lang for i, lang in held)
    assert [out[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"] and all(0 <= r["score"] <= 1 for r in out.values())
    assert language_id.language_id(empty).count() == 0
    rare = cut(df.where("doc_id < 240").unionByName(spark.createDataFrame([(2000 + i, "zzyx qqwv " * 20, "cc") for i in range(8)], df.schema)))
    got = {r["lang_pred"] for r in language_id.language_id(rare, max_docs=20).where("doc_id >= 2000").collect()}
    assert got == {"cc"}  # a language keeps documents of its own, however few they are
    assert {r["lang_pred"] for r in language_id.language_id(docs).collect()} == {"en", "und"}


def segmentations(vocab, word):
    if not word:
        return [[]]
    out = []
    for i, j, p in vocab.arcs(word):
        if i == 0:
            out += [[(p, j), *rest] for rest in segmentations(vocab, word[j:])]
    return out


def test_language_slices_and_scores(spark, monkeypatch):
    """Scores are those of plain sums over all segmentations, and any number of languages gives the same whether learned at once or in slices; ties go to the first by name."""
    rng = random.Random(12)
    stems = {f"l{k:02d}": ["".join(rng.choices("abcdefghijklmnop"[k : k + 6], k=rng.randrange(2, 6))) for _ in range(20)] for k in range(9)}
    stems["l99"] = stems["l00"]  # learns the same, so it ties
    rows = [(1000 * k + i, " ".join(rng.choices(words, k=12)), lang) for k, (lang, words) in enumerate(sorted(stems.items())) for i in range(30)]
    rows = [r for r in rows if r[2] != "l99"] + [(90000 + r[0], r[1], "l99") for r in rows if r[2] == "l00"]
    rows += [(80001, None, "l00"), (80002, "12 -- 3", None), (80003, stems["l03"][0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    whole = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(df).collect()}
    monkeypatch.setattr(language_id, "SLICE", 4)
    sliced = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(df).collect()}
    assert {i: x[0] for i, x in sliced.items()} == {i: x[0] for i, x in whole.items()}
    assert all(sliced[i][1] == pytest.approx(whole[i][1], abs=1e-9) for i in whole)
    assert whole[80001] == whole[80002] == ("und", 0.0)
    prior, vocab = language_id.priors(df), vocabulary()
    langs = list(prior)
    prob = np.hstack([language_id.train(df, langs[at : at + 4]) for at in range(0, len(langs), 4)])

    def plain(word):  # all segmentations, one by one
        ways = [np.ones(len(langs))] + [None] * len(word)
        for j in range(1, len(word) + 1):
            ways[j] = sum((ways[i] * prob[p] for i, e, p in vocab.arcs(word) if e == j), np.zeros(len(langs)))
        return np.log(ways[-1])

    for doc_id, text, _ in rng.sample([r for r in rows if r[0] < 80000], 40):
        logs = np.array([prior[n] for n in langs]) + sum(plain(w) for chunk in text.split() for w in language_id.letters(chunk))
        best = int(logs.argmax())
        assert whole[doc_id][1] == pytest.approx(float(1 / np.exp(logs - logs[best]).sum()), rel=1e-6)
        assert whole[doc_id][0] == langs[best] or logs[langs.index(whole[doc_id][0])] == pytest.approx(logs[best], abs=1e-9)


def test_language_probability_sums_all_segmentations():
    vocab = vocabulary()
    rng = np.random.default_rng(1)
    prob = rng.random((vocab.unknown + 1, 2)) / 1e3
    words = ["▁the", "▁thing", "▁été", "▁x\x01y", "tion", "a", "▁" + "station" * 6]
    got = language_id.forward(vocab, prob, words)
    for w, row in zip(words[:-1], got, strict=False):
        total = sum(np.prod([prob[p] for p, _ in s], axis=0) for s in segmentations(vocab, w))
        assert np.allclose(row, np.log(total))
    alpha = {0: np.ones(2)}
    for j in range(1, len(words[-1]) + 1):
        alpha[j] = sum(alpha[i] * prob[p] for i, k, p in vocab.arcs(words[-1]) if k == j)
    assert np.allclose(got[-1], np.log(alpha[len(words[-1])]))


def test_language_counts_of_long_words():
    """Expected pieces of a long word, in logarithms, against those of the batch method on a word of the same kind."""
    vocab = vocabulary()
    prob = np.random.default_rng(3).random(vocab.unknown + 1) / 1e3
    word = "▁internationalisation"
    want, got = language_id.expected(vocab, prob, [word], np.array([3.0])), np.zeros(len(prob) + 1)
    language_id._expected_long(vocab, np.append(prob, 0.0), word, 3.0, got)
    assert np.allclose(got[:-1], want)
    long = language_id.expected(vocab, prob, [word * 40], np.array([1.0]))
    lengths = np.array([len(p) for p in vocab.pieces] + [1])
    assert (long * lengths).sum() == pytest.approx(len(word) * 40)


def test_clashing_columns(spark):
    """Columns named as those that operators use on the way."""
    names = ("quality", "own_id", "kept_id", "lost", "g", "row", "w", "t", "hits", "all", "base", "whole", "nameless", "pos", "fp", "raw_email", "rest", "lines", "own", "q", "n")
    texts = prose(30, 4)
    df = spark.createDataFrame([(i, t, "en", len(t), *["x"] * len(names)) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    df = cut(df)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert quality_classifier.quality_classifier(df, labels).count() == 31 and language_id.language_id(df).count() == 31 and sentencepiece.sentencepiece_n_best(df).count() == 31
    assert simhash.one_of_each(df).columns == df.columns and simhash.one_of_each(df).count() == 30
    assert line_dedup.without_shared_lines(df).columns == df.columns and pii.redacted(df).columns == df.columns and quality_rules.kept_documents(df, labels).columns == df.columns
    assert packing.best_fit_packing(df, ids=True).count() == 31 and license_scan.license_scan(df, inside=True).count() == 0


def test_sentencepiece_n_best(spark, docs, empty):
    vocab = vocabulary()
    for text in ("the thing", "été", "a  b\nc", "▁x 漢y", "in in in", "oining"):
        marked = sentencepiece.marked(text)
        totals = sorted((sum(int(vocab.scores[p]) for p, _ in s) for s in segmentations(vocab, marked)), reverse=True)
        coder = sentencepiece.coder()
        words = sentencepiece.WORDS.findall(marked)
        coder.prepare([words])
        first, found = coder.best(words, 6)
        assert [s for s, _ in found] == totals[:6]
        every = [coder.ids_of(first, changed) for _, changed in found]
        assert every[0] == b"".join(first) and len(set(every)) == len(every) and all(coder.decode(e) == text.replace("▁", " ") for e in every)
    direct = sentencepiece.n_best(vocab, "▁internationalisation" * 30, 5)
    assert [s for s, _ in direct] == sorted((s for s, _ in direct), reverse=True) and len({tuple(p) for _, p in direct}) == 5
    out = sentencepiece.sentencepiece_n_best(docs, ids=True)
    rows = sorted(((r["doc_id"], r["text"]) for r in sentencepiece.sentencepiece_decode(out.select("doc_id", F.get("ids", 0).alias("ids"))).collect()), key=str)
    assert rows == sorted(((i, t or "") for i, t in ODD), key=str)
    assert out.where("NOT round_trip").count() == 0 and sentencepiece.sentencepiece_n_best(empty).count() == 0


def test_quality_classifier(spark, docs, empty):
    good, bad = prose(300, 5), [" ".join(w + "##$" for w in t.split()) for t in prose(120, 6)]
    texts = good + bad
    df = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(len(texts))], "doc_id long, quality int")
    out = quality_classifier.quality_classifier(df, labels).collect()
    held = [r for r in out if r["held_out"]]
    assert held and np.mean([r["predicted"] == (r["doc_id"] < len(good)) for r in held]) > 0.95
    odd = quality_classifier.quality_classifier(docs, labels).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_classifier.quality_classifier(empty, labels).count() == 0
    none = quality_classifier.quality_classifier(docs, labels.limit(0)).collect()
    assert all(r["score"] == 0.5 for r in none)
    machine, x = quality_classifier.Machine(), quality_classifier.features("one two three two", Remembered(100)).astype(float)
    pairs = sum((machine.factors[i] @ machine.factors[j]) * x[i] * x[j] for i in np.flatnonzero(x) for j in np.flatnonzero(x) if i < j)
    assert machine.margin(x[None])[0] == pytest.approx(machine.bias + x @ machine.weights + pairs, abs=1e-6)
    # the query's own scores against all pairs, one by one
    machine, score = quality_classifier.train(df, labels), {r["doc_id"]: r["score"] for r in out}
    for i in random.Random(3).sample(range(len(texts)), 25):
        x = quality_classifier.features(texts[i], Remembered(100)).astype(float)
        at = np.flatnonzero(x)
        margin = machine.bias + sum(x[j] * machine.weights[j] for j in at) + sum((machine.factors[j].astype(float) @ machine.factors[k]) * x[j] * x[k] for n, j in enumerate(at) for k in at[n + 1 :])
        assert score[i] == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-4)
