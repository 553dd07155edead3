"""Personal data: exact formats, and candidates that boosted trees accept; in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import keep_others, step

#: Java expressions that match just what the plain formats do, from left to right, in time linear in the text and without
#: recursion: a run is entered at its start or where the last match ended, and what can't be given back is possessive.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a format to be looked for.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]", "number": "[0-9][^0-9]?[0-9]", "secret": "[0-9A-Za-z_/+-]{16}", "mention": "[A-Za-z0-9]\\s?[(\\[]\\s?[Aa][Tt]\\s?[)\\]]"}
#: Generators of further candidates: they overlap each other and the formats, and most of what they find is no personal data.
MORE = {
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[0-9().\x20/-]*[0-9])?",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Za-z_/+-]{16,}+",
    "mention": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?[(\[]\s?[Aa][Tt]\s?[)\]]\s?[A-Za-z0-9.-]++",
}
KINDS = (*BASE, *MORE)
#: How a mention ends whose host is a dotted domain.
DOMAIN = r"[)\]]\s?(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\.?$"
#: Words before a span, in lower case, that speak of its kind, and those that speak of a phone.
CONTEXT = r"(card|visa|konto|iban|tel|phone|call|fax|mobil|mail|contact|ip|host|server|token|secret|key|passw|auth|ssn|account)[^a-z]{0,4}[^\s]{0,12}\s?\S{0,3}\s?$"
PHONE_WORD = r"(tel|phone|call|fax|mobil)[^a-z]{0,4}[^\s]{0,12}\s?\S{0,3}\s?$"
BEFORE = 24
#: Trees, their depth is two; the learning rate; least expected precision of what is added; candidates in a threshold's score bin at least.
TREES, RATE, PRECISION, LEAST = 24, 0.4, 0.95, 20
#: What a disguised copy of a valid match counts for where thresholds are set: for two that are written plainly one in disguise is expected.
DISGUISED = 0.5
#: Entries that are summed at a time, and code points of a text's parts; so many matches in a long text stay cheap.
CHUNK, PART = 64, 1000


def _int(text: Column) -> Column:
    return text.try_cast("int")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), "", -1), _int)
    doubled = F.transform(F.filter(each, lambda d: d.isNotNull()), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def _valid(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    if kind == "ip":
        return F.forall(F.split(s, "\\.", -1), lambda p: F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int") <= 255, F.ltrim(p, F.lit("0")) == ""))
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(s))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _bound(x: Column, f) -> Column:
    """f(x) with x computed once: a name for it within an expression."""
    return F.get(F.transform(F.array(x), f), 0)


def _running(values: Column, op) -> Column:
    """For each entry of an array of whole numbers op (a sum or a greatest) over all up to it, from 0; entries are taken in chunks, so a long array isn't gone through for each.

    A fold that carries an array would copy it at each step.
    """
    over = lambda a, first, n: F.aggregate(F.slice(a, first, n), F.lit(0), op)
    chunk = lambda i: F.floor(i / CHUNK).cast("int")

    def run(v: Column) -> Column:
        totals = F.transform(F.sequence(F.lit(0), chunk(F.size(v) - 1)), lambda c: over(v, c * CHUNK + 1, F.lit(CHUNK)))
        before = _bound(totals, lambda t: F.transform(t, lambda x, c: over(t, F.lit(1), c)))
        return _bound(before, lambda b: F.transform(v, lambda x, i: op(F.get(b, chunk(i)), over(v, chunk(i) * CHUNK + 1, i % CHUNK + 1))))

    return _bound(values, lambda v: F.when(F.size(v) > 0, run(v)).otherwise(F.array().cast("array<int>")))


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, x, b>>: start, end (code points, exclusive), text of each match, and up to BEFORE code points before it, back to the match before it.

    What split() leaves out is what regexp_extract_all() gives; lengths in turn give places.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda p: F.struct((F.length(p["g"]) + F.length(p["h"])).alias("n"), p["h"].alias("x"), F.right(p["g"], F.lit(BEFORE)).alias("b")))
    pairs = F.filter(pairs, lambda p: p["x"].isNotNull())
    ends = lambda ps: _running(F.transform(ps, lambda p: p["n"]), lambda a, n: a + n)
    told = lambda ps, es: F.transform(ps, lambda p, i: F.struct((F.get(es, i) - F.length(p["x"])).alias("s"), F.get(es, i).alias("e"), p["x"].alias("x"), p["b"].alias("b")))
    return _bound(pairs, lambda ps: _bound(ends(ps), lambda es: told(ps, es))).cast(NO_SPANS)


NO_SPANS = "array<struct<s:int,e:int,x:string,b:string>>"
LEAN = "struct<s:int,k:int,kind:string,e:int>"


def _merged(spans: Column) -> Column:
    """Spans (LEAN, sorted by start) with those that touch made one, of the first one's kind. A span starts anew where it begins at the running greatest end or past it."""

    def merge(x: Column, reach: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["s"] >= F.get(reach, i - 1)))
        one = lambda h, i, j: F.struct(F.get(x, i)["s"].alias("s"), F.get(x, i)["k"].alias("k"), F.get(x, i)["kind"].alias("kind"), F.get(reach, F.coalesce(F.get(h, j + 1), F.size(x)) - 1).alias("e"))
        return _bound(heads, lambda h: F.transform(h, lambda i, j: one(h, i, j)))

    made = lambda x: _bound(_running(F.transform(x, lambda y: y["e"]), lambda a, e: F.greatest(a, e)), lambda reach: merge(x, reach))
    return _bound(spans, lambda x: F.when(F.size(x) > 0, made(x)).otherwise(F.array())).cast(f"array<{LEAN}>")


def _parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))


def _piece(parts: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text in parts; the cost doesn't grow with a."""
    i, j = F.floor(a / PART).cast("int"), F.floor((b - 1) / PART).cast("int")
    one = F.substring(F.get(parts, i), a % PART + 1, b - a)
    more = F.concat(F.substring(F.get(parts, i), a % PART + 1, F.lit(PART)), F.array_join(F.slice(parts, i + 2, j - i - 1), ""), F.substring(F.get(parts, j), F.lit(1), (b - 1) % PART + 1))
    return F.when(b <= a, F.lit("")).when(i == j, one).otherwise(more)


def _replaced(spans: Column, parts: Column, length: Column, by) -> Column:
    """The text with spans, sorted and apart, replaced by by(span)."""
    before = lambda i: F.coalesce(F.get(spans, i - 1)["e"], F.lit(0))
    put = F.transform(spans, lambda x, i: F.concat(_piece(parts, before(i), x["s"]), by(x)))
    return F.concat(F.array_join(put, ""), _piece(parts, F.element_at(spans, -1)["e"], length))


def _sure(kind: str) -> Column:
    return F.filter(f"raw_{kind}", lambda x: _valid(kind, x["x"]))


def spotted(docs: DataFrame) -> DataFrame:
    """row (struct of docs), t (its text, null: empty), base (valid matches of the formats, LEAN, by start and kind), sure (the same matches with text and
    context) and an array of raw matches for each further generator, which look at the text without base: so none of theirs touches one of base."""
    row = docs.select(F.struct(*keep_others(docs)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    found = lambda text, k, pattern: F.when(text.rlike(NEEDS[k]), _spans(text, pattern)).otherwise(F.array().cast(NO_SPANS))
    row = step(row, ["row", "t"], **{f"raw_{k}": found(F.col("t"), k, p) for k, p in BASE.items()})
    row = step(row, ["row", "t"], **{f"sure_{k}": _sure(k) for k in BASE})
    lean = lambda k: F.transform(f"sure_{k}", lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k) + 1).alias("k"), F.lit(k).alias("kind"), x["e"].alias("e")))
    keep = ["row", "t", *(f"sure_{k}" for k in BASE)]
    row = step(row, keep, base=F.sort_array(F.concat(*(lean(k) for k in BASE))))
    row = step(row, [*keep, "base"], hidden=F.when(F.size("base") > 0, _merged(F.col("base"))), parts=F.when(F.size("base") > 0, _parts(F.col("t"))))
    blank = lambda x: F.repeat(F.lit("\0"), x["e"] - x["s"])
    row = step(row, [*keep, "base"], rest=F.when(F.size("base") > 0, _replaced(F.col("hidden"), F.col("parts"), F.length("t"), blank)).otherwise(F.col("t")))
    return step(row, [*keep, "base"], **{f"raw_{k}": found(F.col("rest"), k, p) for k, p in MORE.items()})


def _features(s: Column, before: Column, kind: str) -> Column:
    """Format and context of a candidate, each a small integer, so the vectors that occur are few whatever the data."""
    digits, low = F.length(_digits(s)), F.lower(before)
    bucket = lambda x, *at: sum((x >= a).cast("int") for a in at)
    letters = F.length(F.regexp_replace(s, "[^A-Za-z]+", ""))
    runs = F.length(F.regexp_replace(F.regexp_replace(s, "[0-9]+", "9"), "[^9]+", ""))
    return F.struct(
        F.lit(KINDS.index(kind)).alias("generator"),
        bucket(digits, 4, 7, 9, 10, 12, 16, 20).alias("digits"),
        bucket(letters, 1, 5, 12).alias("letters"),
        bucket(F.length(F.regexp_replace(s, r"[^.\x20()/-]+", "")), 1, 3, 5).alias("marks"),
        (F.length(s) == F.length(F.regexp_replace(s, r"[^0-9A-Fa-f]+", ""))).cast("int").alias("hex"),
        F.when(digits.between(12, 19), luhn(_digits(s)).cast("int")).otherwise(0).alias("luhn"),
        s.rlike("[()]").cast("int").alias("brackets"),
        low.rlike(CONTEXT).cast("int").alias("context"),
        low.rlike(PHONE_WORD).cast("int").alias("phone_word"),
        before.rlike("[=:]\\s?[\"']?$").cast("int").alias("assigned"),
        bucket(runs, 1, 2, 4, 8).alias("runs"),
        (s.rlike("[a-z]") & s.rlike("[A-Z]")).cast("int").alias("cases"),
        (s.rlike(DOMAIN) if kind == "mention" else F.lit(False)).cast("int").alias("domain"),
    )


FEATURES = ("generator", "digits", "letters", "marks", "hex", "luhn", "brackets", "context", "phone_word", "assigned", "runs", "cases", "domain")


def candidates() -> Column:
    """The candidates of the further generators of a row of spotted(): struct<kind, k, s, e, f>."""

    def made(kind: str) -> Column:
        make = lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind) + 1).alias("k"), x["s"].alias("s"), x["e"].alias("e"), _features(x["x"], x["b"], kind).alias("f"))
        return F.when(F.size(f"raw_{kind}") > 0, F.transform(f"raw_{kind}", make))

    return F.flatten(F.filter(F.array(*(made(k) for k in MORE)), lambda a: a.isNotNull()))


#: How valid matches of the formats could have been written so that no format finds them: kind, generator that does, and the text in disguise.
DISGUISES = {
    "email": ("mention", lambda x: F.replace(x, F.lit("@"), F.lit(" [at] "))),
    "ip": ("number", lambda x: F.replace(x, F.lit("."), F.lit(" . "))),
    "card": ("number", lambda x: F.regexp_replace(_digits(x), "(.{4})(?=.)", "$1.")),
    "phone": ("number", lambda x: F.substring(x, F.lit(2), F.length(x))),
}


def likely(f: Column) -> Column:
    """Whether a candidate is personal data as far as can be told without a label: a secret that is assigned to a name that says so, a mention
    of a dotted domain, and a number that passes a card's check or has a phone's length after a word that speaks of one."""
    number = ((f["digits"] >= 5) & (f["luhn"] == 1)) | (f["digits"].between(3, 5) & (f["phone_word"] == 1))
    kind = lambda k: f["generator"] == KINDS.index(k)
    return (kind("secret") & (f["context"] == 1) & (f["assigned"] == 1)) | (kind("mention") & (f["domain"] == 1)) | (kind("number") & number)


def tally(found: DataFrame) -> DataFrame:
    """The feature vectors that occur among what can be added, with how often each was told to be personal data (pos), how often not (neg), and how often it was a disguised copy (copy): FEATURES, fold.

    No text has labelled spans, so labels come from the formats. Each valid match of a format counts once as it would look in disguise, where
    no format finds it: a phone without its plus, a card in groups with dots, an address with spaced dots, an e-mail
    as a mention; these copies are positives, with the words before them and once more without. So are candidates that likely() tells, secrets among them
    once more without the words before, so that their shape is learned too. All other candidates are negatives, even where some are data that nobody
    labelled, so that precision is rather told too low. fold 1, a fifth of the documents by hash, sets the thresholds; fold 0 grows the trees.
    """
    fold = (F.pmod(F.xxhash64("t"), F.lit(5)) == 0).cast("int")

    def copies(kind: str) -> Column:
        generator, disguise = DISGUISES[kind]
        return F.when(F.size(f"sure_{kind}") > 0, F.transform(f"sure_{kind}", lambda x: F.struct(_features(disguise(x["x"]), x["b"], generator).alias("f"))))

    rows = step(found, [], fold=fold, all=F.transform(candidates(), lambda c: F.struct(c["f"].alias("f"))), copies=F.flatten(F.filter(F.array(*map(copies, BASE)), lambda a: a.isNotNull())))
    rows = rows.where((F.size("all") > 0) | (F.size("copies") > 0))
    plain = lambda f: F.struct(*((F.lit(0) if name in ("context", "phone_word", "assigned") else f[name]).alias(name) for name in FEATURES))
    told = lambda f, kind: F.struct(f.alias("f"), *(F.lit(int(kind == k)).alias(k) for k in ("pos", "neg", "copy")))
    real = F.transform("all", lambda c: F.when(likely(c["f"]), told(c["f"], "pos")).otherwise(told(c["f"], "neg")))
    bare = F.transform(F.filter("all", lambda c: likely(c["f"]) & (c["f"]["generator"] == KINDS.index("secret"))), lambda c: told(plain(c["f"]), "copy"))
    copied = F.flatten(F.transform("copies", lambda c: F.array(told(c["f"], "copy"), told(plain(c["f"]), "copy"))))
    # labels are given within the row, so that an exploded row is small whatever the text
    rows = step(rows, ["fold"], told=F.concat(real, bare, copied)).select("fold", F.explode("told").alias("c")).select("fold", "c.f.*", "c.pos", "c.neg", "c.copy")
    return rows.groupBy(*FEATURES, "fold").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "copy")))


def boost(rows: list[dict], trees: int = TREES, rate: float = RATE) -> tuple[list[tuple], dict[str, float]]:
    """Boosted trees of depth two for logistic loss over counted feature vectors: [(feature, at, (feature, at, value, value), (...))] and a threshold for each generator that has one.

    A leaf's value is a Newton step with an L2 penalty of one. A generator's threshold is the least
    score from which its candidates of fold 1 are personal data in PRECISION of cases or more,
    counting copies as DISGUISED and only score bins with LEAST candidates or more.
    """
    fit = [r | {"pos": r["pos"] + r["copy"]} for r in rows if not r["fold"]]
    scores = [0.0] * len(fit)
    out: list[tuple] = []

    def leaf(part: list[int], grad: list[float], hess: list[float]) -> float:
        return rate * sum(grad[i] for i in part) / (sum(hess[i] for i in part) + 1)

    def gain(part: list[int], grad: list[float], hess: list[float]) -> float:
        return sum(grad[i] for i in part) ** 2 / (sum(hess[i] for i in part) + 1)

    def split(part: list[int], grad: list[float], hess: list[float]) -> tuple[str, int, list[int], list[int]]:
        best = (0.0, FEATURES[0], -1, [], part)
        for f in FEATURES:
            for at in sorted({fit[i][f] for i in part})[:-1]:
                low, high = [i for i in part if fit[i][f] <= at], [i for i in part if fit[i][f] > at]
                if (g := gain(low, grad, hess) + gain(high, grad, hess) - gain(part, grad, hess)) > best[0] + 1e-9:
                    best = (g, f, at, low, high)
        return best[1:]

    for _ in range(trees if any(r["pos"] for r in fit) and any(r["neg"] for r in fit) else 0):
        p = [1 / (1 + math.exp(-max(-30, min(30, s)))) for s in scores]
        grad = [r["pos"] * (1 - q) - r["neg"] * q for r, q in zip(fit, p, strict=True)]
        hess = [(r["pos"] + r["neg"]) * q * (1 - q) for r, q in zip(fit, p, strict=True)]
        f, at, *sides = split(list(range(len(fit))), grad, hess)
        tree: list = [f, at]
        for side in sides:
            g, cut_at, low, high = split(side, grad, hess)
            a, b = leaf(low, grad, hess), leaf(high, grad, hess)
            tree.append((g, cut_at, a, b))
            for i in side:
                scores[i] += a if fit[i][g] <= cut_at else b
        out.append(tuple(tree))
    thresholds: dict[str, float] = {}
    for kind in MORE if out else ():
        bins: dict[int, list[float]] = {}
        for r in rows:
            if r["fold"] and r["generator"] == KINDS.index(kind):
                b = bins.setdefault(math.floor(score_of(out, r) * 4), [0.0, 0.0])
                b[0] += r["pos"] + DISGUISED * r["copy"]
                b[1] += r["neg"]
        pos = neg = 0.0
        for b in sorted(bins, reverse=True):
            pos, neg = pos + bins[b][0], neg + bins[b][1]
            if pos < PRECISION * (pos + neg):
                break
            if pos + neg >= LEAST:
                thresholds[kind] = b / 4
    return out, thresholds


def score_of(trees: list[tuple], row: dict) -> float:
    total = 0.0
    for f, at, *sides in trees:
        g, cut_at, a, b = sides[row[f] > at]
        total += a if row[g] <= cut_at else b
    return total


def score_column(trees: list[tuple], f: Column) -> Column:
    total = F.lit(0.0)
    for name, at, *sides in trees:
        low, high = (F.when(f[g] <= cut_at, F.lit(a)).otherwise(F.lit(b)) for g, cut_at, a, b in sides)
        total = total + F.when(f[name] <= at, low).otherwise(high)
    return total


def with_spans(docs: DataFrame) -> DataFrame:
    """row (struct of docs), t, base_spans and spans, arrays of LEAN by start and then kind as in KINDS.

    base_spans are all valid matches of the formats. spans has them and what the
    trees accept of the other candidates, none of which touches a base span; accepted ones that touch each other are
    one span, of the first one's kind. The trees are grown and calibrated over all docs: only
    counts of feature vectors, whose number is bounded by the features' few values, reach the
    driver. No text, null or without any candidate, has empty arrays. Rows that repeat are judged and counted each. Matches of a text
    aren't compared with each other, so a text with many is about linear in them; the words before a match reach back to the one before it.
    """
    trees, thresholds = boost(sorted((r.asDict() for r in tally(spotted(docs.select("text"))).collect()), key=lambda r: [r[f] for f in (*FEATURES, "fold")]))
    row = spotted(docs)
    if thresholds:
        least = lambda kind: F.get(F.array(*(F.lit(thresholds.get(k, math.inf)) for k in KINDS)), F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1)
        row = step(row, ["row", "t", "base"], all=F.when(F.greatest(*(F.size(f"raw_{k}") for k in MORE)) > 0, candidates()))
        good = F.filter("all", lambda c: score_column(trees, c["f"]) >= least(c["kind"]))
        lean = lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["kind"].alias("kind"), c["e"].alias("e"))
        row = step(row, ["row", "t", "base"], good=F.sort_array(F.transform(good, lean)))
        added = F.when(F.size("good") > 0, _merged(F.col("good")))
        row = step(row, ["row", "t", "base"], spans=F.when(F.size("good") > 0, F.sort_array(F.concat("base", added))).otherwise(F.col("base")))
    else:
        row = row.select("row", "t", "base", F.col("base").alias("spans"))
    return row.select("row", "t", F.col("base").alias("base_spans"), "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base_spans", lambda x: x["kind"] == kind))


def pii_spans(docs: DataFrame) -> DataFrame:
    """The columns of docs, n_email, n_ip, n_card, n_phone (valid base spans), base_sha256 and spans; see with_spans(). Input columns of these names give way."""
    own = [f"n_{k}" for k in BASE]
    rows = with_spans(docs)
    counts = [_count(k).cast("long").alias(f"n_{k}") for k in BASE]
    out = rows.select("row", *counts, F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in {*own, "base_sha256", "spans"}]
    return out.select(*kept, *own, "base_sha256", "spans")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in angle brackets, as <email>, and n_chars, if there, counted anew. Null text stays null.

    Spans that overlap are replaced together under the first one's kind.
    """
    rows = with_spans(docs)
    rows = step(rows, ["row", "t"], apart=F.when(F.size("spans") > 0, _merged(F.col("spans"))), parts=F.when(F.size("spans") > 0, _parts(F.col("t"))))
    joined = _replaced(F.col("apart"), F.col("parts"), F.length("t"), lambda x: F.concat(F.lit("<"), x["kind"], F.lit(">")))
    rows = rows.select("row", F.when(F.col("apart").isNotNull(), joined).otherwise(F.col("t")).alias("clean"))
    text = F.when(F.col("row.text").isNotNull(), F.col("clean"))
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return rows.select(*(columns[c].alias(c) for c in docs.columns))


__all__ = ["pii_spans", "redacted", "with_spans"]
