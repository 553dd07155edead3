"""Quality rules whose cutoffs come with a guarantee, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import BLANK_CLASS, BLANKS, cut, keep_others, step

#: Rules: the share that a text must not reach. Cutoffs run from the mildest to the strictest and are fixed beforehand.
GRID = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03)
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "lines": "n_dup_lines / greatest(n_lines, 1)",
}
#: Strata: texts of fewer words than each of these, and the rest. A ratio of a short text is rougher than one of a long text.
BANDS = (100, 300, 1000)
#: At most this share of the good texts of a stratum may be rejected by a rule, all cutoffs together with the confidence 1 - DELTA.
ALPHA, DELTA = 0.02, 0.05
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OWN = (*COUNTS, "n_capitals", "n_lines")


def counted(docs: DataFrame, nested: bool = False) -> DataFrame:
    """docs (nested: as a struct row, so that no name is taken) with the counts of OWN (long) of its text; null text counts as one without words.

    n_repeat_words needs each 3-word window's other occurrences: windows are hashed
    to two 64-bit numbers and sorted within the row, and only in rows where some
    window repeats at all.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = docs.select(F.struct(*keep_others(docs, *(() if nested else OWN))).alias("row"), text.alias("t"))
    words, filled = F.filter(F.split("t", f"[{BLANK_CLASS}]+", -1), lambda w: w != ""), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0
    row = step(row, ["row", "t"], w=words, lines=F.filter(F.split("t", "\n", -1), filled))
    row = step(row, ["row", "t", "w", "lines"], hashed=F.transform("w", lambda x: F.xxhash64(x)))
    shingles = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("hashed", i), F.get("hashed", i + 1), F.get("hashed", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    row = step(row, ["row", "t", "w", "lines"], s=shingles)
    # seldom taken: exact text beside the hash, so that no collision counts
    window = lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    tagged = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.get("s", i).alias("h"), window(i).alias("x"), i.alias("i")))
    row = step(row, ["row", "t", "w", "lines"], z=F.when(F.size(F.array_distinct("s")) < F.size("s"), F.sort_array(tagged)))
    same = lambda a, b: F.coalesce((a["h"] == b["h"]) & (a["x"] == b["x"]), F.lit(False))
    twice = F.filter("z", lambda x, i: same(x, F.get("z", i - 1)) | same(x, F.get("z", i + 1)))
    row = step(row, ["row", "t", "w", "lines"], at=F.sort_array(F.transform(twice, lambda x: x["i"])))
    # a window covers three words, fewer if the next one starts among them
    covered = F.aggregate(F.sequence(F.lit(0), F.size("at") - 1), F.lit(0), lambda n, k: n + F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - F.get("at", k), F.lit(3))))
    less = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    counts = {
        "n_words": F.size("w"),
        "word_chars": F.length(F.array_join("w", "")),
        "n_symbols": less(r"[#*$%&|<>]+"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.size("at") > 0, covered).otherwise(0),
        "n_capitals": less(r"[A-Z]+"),
        "n_lines": F.size("lines"),
    }
    out = step(row, ["row"], **{name: c.cast("long") for name, c in counts.items()})
    return out if nested else out.select("row.*", *OWN)


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def stratum() -> Column:
    out = F.lit(len(BANDS))
    for k, words in reversed(list(enumerate(BANDS))):
        out = F.when(F.col("n_words") < words, F.lit(k)).otherwise(out)
    return out


def level(delta: float = DELTA) -> float:
    """The error probability of one rule's sequence of tests in a stratum."""
    return delta / len(RULES) / (len(BANDS) + 1)


def least_labels(alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Good labelled texts below which no cutoff can be certified, even if none of them is rejected."""
    return math.ceil(math.log(level(delta)) / math.log1p(-alpha))


def merged_strata(sizes: list[Column], least: int) -> list[Column]:
    """For the strata, by their numbers of good labels, the group of each: neighbours go together, from the shortest texts on, until they have least labels, and what is left at the end joins the last group. Null: no group has as many."""
    closed, held, groups = F.lit(0), F.lit(0).cast("long"), []
    for n in sizes:
        groups.append(closed)
        held = held + n
        enough = held >= least
        closed, held = closed + enough.cast("int"), F.when(enough, F.lit(0).cast("long")).otherwise(held)
    return [F.when(closed > 0, F.least(g, closed - 1)) for g in groups]


def cutoffs(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row for each stratum that is tested: stratum, and for each rule its cutoff (null: none).

    counts: doc_id and OWN; labels: doc_id and quality. The good texts (quality 1) that
    pass the base rules are the holdout. For each stratum and rule the cutoffs of GRID,
    which no data has shaped, are tested from the mildest on: k of n good texts rejected is
    enough if a binomial variable of n draws with chance alpha is at most k with
    probability level() or less, an exact bound; the first cutoff that
    fails ends the sequence. Testing in a fixed order needs no further correction, and the
    division by strata and rules (Bonferroni) makes all certified cutoffs hold together; so any of them may be chosen,
    and it is the one by which bad labelled texts (quality 0) outnumber good ones most among the rejected, the mildest of equals, and none
    if they never do. Documents whose label is null or disagrees among repeated rows are not in the holdout.

    Neighbouring strata with too few labels are one stratum: see merged_strata(). That depends on the number of labels alone, fixed before any test, so each stratum that is tested has the guarantee for its own texts.
    With fewer than least_labels() good texts in all nothing is certified.
    """
    sure = labels.groupBy(F.col("doc_id").alias("sure_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi AND lo IN (0, 1)").select("sure_id", (F.col("lo") == 1).alias("good"))
    holdout = counts.where(~base_failed()).join(sure, counts.doc_id == F.col("sure_id"))
    # how many cutoffs reject it: those of at most its share; so a count by this number tells all cutoffs' rejections
    passed = lambda share: F.size(F.filter(F.array(*(F.lit(g) for g in GRID)), lambda g: share >= g))
    long = holdout.select(stratum().alias("own"), "good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), passed(F.expr(f)).alias("hit")) for r, f in RULES.items()))).alias("x"))
    tally = long.groupBy("own", F.col("x.rule").alias("rule"), F.col("x.hit").alias("hit")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # bounded from here on: strata times rules times cutoffs; every text has each rule, so one rule tells a stratum's size
    one = tally.where(F.col("rule") == next(iter(RULES))).agg(*(F.coalesce(F.sum(F.when(F.col("own") == k, F.col("good"))), F.lit(0)).alias(f"n{k}") for k in range(len(BANDS) + 1)))
    groups = merged_strata([F.col(f"n{k}") for k in range(len(BANDS) + 1)], least_labels(alpha, delta))
    strata = one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("own"), g.alias("stratum")) for k, g in enumerate(groups))))).where(F.col("stratum").isNotNull())
    tally = tally.join(F.broadcast(strata), "own").groupBy("stratum", "rule", "hit").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    by_rule = tally.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.collect_list(F.struct("hit", "good", "bad")).alias("hits"))
    # cutoff number step is the step-th mildest and rejects what has hit >= len - step + 1
    steps = by_rule.select("stratum", "rule", "n", "hits", F.explode(F.sequence(F.lit(1), F.lit(len(GRID)))).alias("step"))
    rejected = lambda what: F.aggregate(F.filter("hits", lambda h: h["hit"] > len(GRID) - F.col("step")), F.lit(0).cast("long"), lambda n, h: n + h[what])
    tested = steps.select("stratum", "rule", "n", "step", rejected("good").alias("k"), rejected("bad").alias("b"))
    tested = tested.withColumn("ok", binomial_at_most(F.col("k"), F.col("n"), alpha) <= level(delta))
    every = tested.groupBy("stratum", "rule").agg(F.max("n").alias("n"), F.collect_list(F.struct("step", "ok", "k", "b")).alias("all"))
    certified = F.filter("all", lambda x: ~F.exists("all", lambda y: (y["step"] <= x["step"]) & ~y["ok"]))
    best = F.array_max(F.transform(F.filter(certified, lambda x: x["b"] > x["k"]), lambda x: F.struct((x["b"] - x["k"]).alias("gain"), (-x["step"]).alias("step"))))
    chosen = every.select("stratum", "rule", "n", F.get(F.array(*(F.lit(g) for g in GRID)), -best["step"] - 1).alias("cutoff"))
    cuts = chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))
    return strata.join(cuts, "stratum").select(F.col("own").alias("stratum"), *(f"cut_{r}" for r in RULES))


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """The probability of at most k hits in n draws of chance p; 1 where k exceeds n * p (it isn't needed there).

    Terms are summed in logarithms, the largest last, so that no n underflows.
    """
    odds = F.lit(p / (1 - p))
    start = F.struct((n * F.log1p(F.lit(-p))).alias("term"), (n * F.log1p(F.lit(-p))).alias("sum"))

    def more(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log(F.greatest(n - i + 1, F.lit(1)) / i * odds)
        top = F.greatest(term, acc["sum"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(acc["sum"] - top))).alias("sum"))

    total = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, more, lambda acc: F.exp(acc["sum"]))
    return F.when(k > n * p, F.lit(1.0)).otherwise(total)


def judged(counts: DataFrame, cuts: DataFrame) -> DataFrame:
    """counts with base_failed and kept. cuts has a row for each stratum at most, so it is broadcast whatever the data."""
    cuts = F.broadcast(cuts.withColumnRenamed("stratum", "cut_stratum"))
    own = counts.select(F.struct("*").alias("row"), *OWN, stratum().alias("own_stratum")).join(cuts, F.col("own_stratum") == F.col("cut_stratum"), "left")
    bad = F.lit(False)
    for r, f in RULES.items():
        bad = bad | F.coalesce(F.expr(f) >= F.col(f"cut_{r}"), F.lit(False))
    return own.select("row.*", base_failed().alias("base_failed"), (~base_failed() & ~bad).alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, OWN, base_failed and kept for each row of docs (doc_id, text); labels: doc_id, quality.

    Null and empty texts have no words and fail. With no labels no cutoff is
    certified, so the base rules alone decide. Rows that repeat a doc_id are
    judged each by its own text.
    """
    counts = cut(counted(docs.select("doc_id", "text")).drop("text"), "counts")
    return judged(counts, cut(cutoffs(counts, labels, alpha, delta), "cutoffs"))


def kept_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that the rules keep, by the verdict of quality_rules(). Each text is counted once and written beside its counts; nothing of it is shuffled."""
    whole = cut(counted(docs, nested=True), "counted")
    cuts = cut(cutoffs(whole.select(F.col("row.doc_id").alias("doc_id"), *OWN), labels, alpha, delta), "cutoffs")
    return judged(whole.withColumnRenamed("row", "whole"), cuts).where("kept").select("whole.*")


def sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """The same in DuckDB SQL."""
    grid = ", ".join(f"({i}, {g}::DOUBLE)" for i, g in enumerate(GRID, 1))
    shares = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {f.replace(' / ', ' / (1.0::DOUBLE * ')}) AS share FROM counts" for r, f in RULES.items())
    # step by step from the first stratum on: labels held so far, and how many groups are full
    merging = "m0 AS (SELECT *, 0::BIGINT AS held0, 0 AS closed0 FROM sizes),\n" + "\n".join(
        f"m{k + 1} AS (SELECT *, CASE WHEN held{k} + n{k} >= {least_labels(alpha, delta)} THEN 0 ELSE held{k} + n{k} END AS held{k + 1}, closed{k} + (held{k} + n{k} >= {least_labels(alpha, delta)})::INT AS closed{k + 1} FROM m{k})," for k in range(len(BANDS) + 1)
    )
    band = " ".join(f"WHEN n_words < {b} THEN {i}" for i, b in enumerate(BANDS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pos AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM (SELECT doc_id, list_filter(string_split_regex(t, '[{BLANK_CLASS}]+'), lambda x: x <> '') AS w FROM d)),
win AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p AS s FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM win WHERE s IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(0, 3) r(k) GROUP BY 1),
wrd AS (SELECT doc_id, count(*) AS n_words, sum(length(x))::BIGINT AS word_chars FROM pos GROUP BY 1),
lin AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^{BLANK_CLASS}]') GROUP BY 1),
counts AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS n_capitals, coalesce(n_lines, 0) AS n_lines, CASE {band.replace('n_words', 'coalesce(n_words, 0)')} ELSE {len(BANDS)} END AS stratum
           FROM d LEFT JOIN wrd USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lin USING (doc_id)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
shares AS ({shares}),
sure AS (SELECT doc_id, min(quality) = 1 AS good FROM labels GROUP BY 1 HAVING min(quality) = max(quality) AND min(quality) IN (0, 1)),
labelled AS (SELECT s.*, good FROM shares s JOIN sure USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM base WHERE NOT base_failed)),
sizes AS (SELECT {', '.join(f"count(*) FILTER (WHERE good AND stratum = {k} AND rule = '{next(iter(RULES))}') AS n{k}" for k in range(len(BANDS) + 1))} FROM labelled),
{merging}
groups AS (SELECT s AS own, least(g, closed - 1) AS stratum FROM (SELECT closed{len(BANDS) + 1} AS closed, unnest([{', '.join(f'closed{k}' for k in range(len(BANDS) + 1))}]) AS g, unnest(range(0, {len(BANDS) + 1})) AS s FROM m{len(BANDS) + 1}) WHERE closed > 0),
held AS (SELECT g.stratum, l.rule, l.share, l.good FROM labelled l JOIN groups g ON l.stratum = g.own),
grid(step, g) AS (VALUES {grid}),
tested AS (SELECT stratum, rule, step, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND share >= g) AS k, count(*) FILTER (WHERE NOT good AND share >= g) AS b FROM held, grid GROUP BY 1, 2, 3),
told AS (SELECT *, k <= n * {alpha} AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha})))) <= {level(delta)!r} AS ok FROM tested),
bad AS (SELECT stratum, rule, coalesce(min(step) FILTER (WHERE NOT ok), {len(GRID) + 1}) AS bad FROM told GROUP BY 1, 2),
picked AS (SELECT stratum, rule, arg_max(step, (b - k, -step)) AS step FROM told JOIN bad USING (stratum, rule) WHERE step < bad AND b > k GROUP BY 1, 2),
cuts AS (SELECT own AS stratum, rule, g FROM picked JOIN grid USING (step) JOIN groups USING (stratum)),
out AS (SELECT DISTINCT doc_id FROM shares JOIN cuts USING (stratum, rule) WHERE share >= g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM out) AS kept FROM base"""
