"""Licence notices in texts, by the Dice coefficient of word bigrams; in DataFrame functions only."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import LOWER, UPPER, ascii_lower, step

# The usual short notices of well-known public licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
LEAST = 0.8
#: Whole notices, met only as passages: what TEMPLATES has of them in short is too small a share of them.
FULL = {
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
}

def _words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def _bigrams(text: str) -> list[str]:
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _normal_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def bounds(size: int, least: float = LEAST) -> tuple[int, int]:
    """Least and most bigrams of a text that can reach the coefficient with a template of size bigrams: 2 min / (sum) >= least."""
    fits = [n for n in range(1, int(size * (2 - least) / least) + 2) if 2 * min(n, size) >= least * (n + size)]
    return fits[0], fits[-1]


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, inside: bool = False) -> DataFrame:
    """doc_id, line, license, dice: each line (from 1) and each whole text (line 0) that reaches the coefficient with a template; with inside also passages().

    Texts are lowered (A-Z) and all but a-z and 0-9 separates words. What has too
    few or too many words for every template is passed over before its
    words are even cut, and what has too few or too many bigrams for a template before
    they are compared. Ties give a row for each template. A text of one line is
    a whole text and a line, so both rows come. Null and empty texts give none;
    repeated rows give their rows again. Texts of any length are taken whole; with inside a text that could hold a notice costs a few passes for each of the template's bigrams. There is no shuffle: templates are part of the plan.
    SQL has the lines and whole texts only; passages are further rows, with the notices of FULL as templates too unless others are given.
    """
    short = TEMPLATES if templates is None else templates
    grams = {k: _bigrams(t) for k, t in short.items()}
    limits = {k: bounds(len(g), least) for k, g in grams.items() if g}
    most = max((hi for _, hi in limits.values()), default=0)
    # n distinct bigrams need n + 1 words, each at least a letter and a separator
    shortest = 2 * min((lo for lo, _ in limits.values()), default=0) + 1
    if not limits:
        return docs.select("doc_id", F.lit(0).alias("line"), F.lit("").alias("license"), F.lit(0.0).alias("dice")).limit(0)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # lines with their own words; the text's words are all of theirs, for no word goes over a line's end
    rows = step(docs.select("doc_id", text.alias("t")).where(F.length("t") >= shortest), ["doc_id"], lines=F.transform(F.split("t", "\n", -1), lambda x: _normal_words(x)))
    rows = step(rows, ["doc_id", "lines"], w=F.flatten("lines"))
    rows = step(rows, ["doc_id", "lines", "w"], own=F.array_distinct("w"))
    one = lambda w: F.when(F.size(w) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))))
    # a long unit may repeat few bigrams, so length alone rules nothing out; but k distinct words need k - 1 distinct bigrams
    fits = lambda w, n: (F.size(w) >= 2) & (n <= most + 1)
    units = F.concat(F.array(F.struct(F.lit(0).alias("line"), F.when(fits(F.col("w"), F.size("own")), one(F.col("w"))).alias("pairs"))), F.transform("lines", lambda w, i: F.struct((i + 1).alias("line"), F.when(fits(w, F.when(F.size(w) <= most + 1, 0).otherwise(F.size(F.array_distinct(w)))), one(w)).alias("pairs"))))
    rows = step(rows, ["doc_id", "lines", "w", "own"], units=F.filter(units, lambda u: F.size(u["pairs"]).between(1, most)))
    scored = lambda pairs: F.filter(
        F.array(*(F.when(F.size(pairs).between(lo, hi), F.struct(F.lit(k).alias("license"), (F.lit(2.0) * F.size(F.array_intersect(pairs, F.array(*map(F.lit, grams[k])))) / (F.size(pairs) + len(grams[k]))).alias("dice"))) for k, (lo, hi) in limits.items())),
        lambda s: s["dice"] >= least,
    )
    found = F.flatten(F.transform("units", lambda u: F.transform(scored(u["pairs"]), lambda s: F.struct(u["line"].alias("line"), s["license"].alias("license"), s["dice"].alias("dice")))))
    rows = step(rows, ["doc_id", "lines", "w", "own"], hits=found)
    if not inside:
        return rows.select("doc_id", F.inline("hits"))
    return passages(rows, short | (FULL if templates is None else {}), least)


def passages(rows: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """hits of rows (doc_id, lines, w, own, hits), and notices that go over lines or are part of one: runs of words, of any length, that reach the coefficient with a template.

    A run starts with two words of the template; of those from one start that reach the coefficient the best counts, of equals the shortest. A bigram that comes again within a run changes nothing, so
    a run that starts with one is never better than the run after it: from a start runs are followed only as far as its bigram's next place, and starts of one bigram together go
    once over the text, whatever its length. line is that of the first word. Of runs that overlap for one template the best
    stays (the first of equals). Runs within a line that has a row of its own, or that begin in one which is as near to
    the same template, or are in a text that has a row as a whole, are no passages.
    """
    grams = {k: _bigrams(t) for k, t in templates.items()}
    words = {k: sorted({w for g in gs for w in g.split()}) for k, gs in grams.items()}
    every = F.array(*(F.lit(w) for w in sorted({w for ws in words.values() for w in ws})))
    rows = step(rows, ["doc_id", "lines", "w", "hits"], shared=F.array_intersect("own", every))
    # a run has least / (2 - least) of the template's bigrams, so its words are some at least
    maybe = {}
    for k, gs in grams.items():
        if not gs:
            continue
        need = math.ceil(least * len(gs) / (2 - least) - 1e-9)
        maybe[k] = F.size(F.array_intersect("shared", F.array(*map(F.lit, words[k])))) >= max(2, _fewest_words(gs, need))
    whole = F.exists("hits", lambda h: h["line"] == 0)
    rows = step(rows, ["doc_id", "lines", "w", "hits"], names=F.when(whole, F.array().cast("array<string>")).otherwise(F.filter(F.array(*(F.when(m, F.lit(k)) for k, m in maybe.items())), lambda x: x.isNotNull())))
    rows = step(rows, ["doc_id", "w", "hits", "names"], at=F.when(F.size("names") > 0, F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i + 1, F.size(x))))))
    rows = step(rows, ["doc_id", "w", "hits", "names", "at"], g=F.when(F.size("names") > 0, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))))
    # for each place of a bigram the one before it and the next one that is the same
    sorted_places = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = step(rows, ["doc_id", "w", "hits", "names", "at", "g"], z=sorted_places)
    same = lambda e, j: F.get("z", j)["x"] == e["x"]
    linked = F.transform("z", lambda e, j: F.struct(e["i"].alias("i"), F.when(same(e, j - 1), F.get("z", j - 1)["i"]).otherwise(-1).alias("before"), F.when(same(e, j + 1), F.get("z", j + 1)["i"]).otherwise(F.size("z")).alias("after")))
    rows = step(rows, ["doc_id", "w", "hits", "names", "at", "g"], places=F.sort_array(linked))
    kind = "array<struct<s:int,n:int,dice:double>>"

    def runs(k: str) -> Column:
        size = len(grams[k])
        mine = F.array(*map(F.lit, grams[k]))
        flagged = F.transform("places", lambda e: F.struct(e["i"].alias("i"), e["before"].alias("before"), e["after"].alias("after"), F.array_contains(mine, F.get("g", e["i"])).alias("hit")))

        def longer(acc: Column, e: Column, s: Column) -> Column:
            new = e["before"] < s
            distinct, hits = acc["distinct"] + new.cast("int"), acc["hits"] + (new & e["hit"]).cast("int")
            dice = F.lit(2.0) * hits / (distinct + size)
            better = dice > acc["dice"]
            return F.struct(distinct.alias("distinct"), hits.alias("hits"), (acc["n"] + 1).alias("n"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, acc["n"] + 1).otherwise(acc["best"]).alias("best"))

        zero = F.struct(F.lit(0).alias("distinct"), F.lit(0).alias("hits"), F.lit(0).alias("n"), F.lit(0.0).alias("dice"), F.lit(0).alias("best"))
        run = lambda all, e: F.aggregate(F.slice(all, e["i"] + 1, e["after"] - e["i"]), zero, lambda acc, x: longer(acc, x, e["i"]), lambda acc: F.struct(e["i"].alias("s"), acc["best"].alias("n"), acc["dice"].alias("dice")))
        good = F.flatten(F.transform(F.array(flagged), lambda all: F.filter(F.transform(F.filter(all, lambda e: e["hit"]), lambda e: run(all, e)), lambda r: r["dice"] >= least)))
        return F.when(F.array_contains("names", k), good)

    made = {k: runs(k) for k, gs in grams.items() if gs}
    names = [f"r{i}" for i in range(len(made))]
    rows = step(rows, ["doc_id", "hits", "at"], **{n: m for n, m in zip(names, made.values(), strict=True)})

    def best(acc: Column, r: Column) -> Column:
        last = acc["last"]
        apart = last.isNull() | (r["s"] > last["s"] + last["n"])
        return F.struct(
            F.when(apart & last.isNotNull(), F.concat(acc["out"], F.array(last))).otherwise(acc["out"]).alias("out"),
            F.when(apart | (r["dice"] > last["dice"]), r).otherwise(last).alias("last"),
        )

    none = F.struct(F.array().cast(kind).alias("out"), F.lit(None).cast("struct<s:int,n:int,dice:double>").alias("last"))

    def told(r: Column, k: str) -> Column:
        first, last = F.get("at", r["s"]), F.get("at", r["s"] + r["n"])
        return F.exists("hits", lambda h: (h["line"] == first) & ((h["line"] == last) | ((h["license"] == k) & (h["dice"] >= r["dice"]))))

    def kept(n: str, k: str) -> Column:
        chosen = F.aggregate(n, none, best, lambda acc: F.concat(acc["out"], F.array(acc["last"])))
        chosen = F.filter(chosen, lambda r: ~told(r, k))
        return F.when(F.size(n) > 0, F.transform(chosen, lambda r: F.struct(F.get("at", r["s"]).alias("line"), F.lit(k).alias("license"), r["dice"].alias("dice"))))

    more = [kept(n, k) for n, k in zip(names, made, strict=True)]
    out = step(rows, ["doc_id"], hits=F.concat("hits", *(F.coalesce(m, F.array().cast("array<struct<line:int,license:string,dice:double>>")) for m in more)))
    return out.select("doc_id", F.inline("hits"))


def _fewest_words(grams: list[str], need: int) -> int:
    """Distinct words that need bigrams of the template have at least: the most frequent ones, each counted with all its bigrams, leave no fewer."""
    degrees = Counter(w for g in grams for w in set(g.split()))
    # the words of a set of bigrams have degrees that add up to twice the set's size at least
    total = n = 0
    for d in sorted(degrees.values(), reverse=True):
        if total >= 2 * need - sum(a == b for a, b in map(str.split, grams)):
            break
        total, n = total + d, n + 1
    return n


def sql(templates: dict[str, str] | None = None, least: float = LEAST) -> str:
    """The same in DuckDB SQL, without bounds."""
    rows = ", ".join("('{}', [{}])".format(k, ", ".join(f"'{g}'" for g in _bigrams(t))) for k, t in (templates or TEMPLATES).items())
    return rf"""
WITH templates(license, grams) AS (VALUES {rows}),
units AS (SELECT doc_id, 0 AS line, text AS unit FROM documents
          UNION ALL SELECT doc_id, generate_subscripts(a, 1) AS line, unnest(a) AS unit FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
cut AS (SELECT doc_id, line, list_filter(string_split(regexp_replace(translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM units),
pairs AS (SELECT doc_id, line, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS p FROM cut WHERE len(w) >= 2),
scored AS (SELECT doc_id, line, license, 2.0::DOUBLE * len(list_intersect(p, grams)) / (len(p) + len(grams)) AS dice FROM pairs, templates WHERE len(p) <= 3 * len(grams))
SELECT doc_id, line::INTEGER AS line, license, dice FROM scored WHERE dice >= {least}"""
