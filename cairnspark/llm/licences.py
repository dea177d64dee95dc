"""Licence scans by Dice coefficient over word bigrams (operator 4, native).

A text is normalised to lower-case letters, digits and single blanks, whatever its lines, and cut
into word bigrams.  Its units are windows as long as a template that begin where the template, laid
over the text so that a run of bigrams lines up, begins; so a notice is found within a line, wrapped
over several, or above other text.  The Dice coefficient of a window and its template is
2 * common / (window's + template's bigrams), repeated bigrams counted as often as both have them.

Bounds prune first: bags of a and b bigrams reach a coefficient t only if 2 * min(a, b) >= t * (a + b),
which rules out windows cut short by the text's ends and texts too short for any template.  Of a
match, t of the template's bigrams are common, and the words that differ part them into runs, so one
run has ``_run`` bigrams at least: only starts with so many in line are windows.  Each template has a
few probe words of which every match holds one; texts without any are passed over unparsed.  Only
bigrams of templates pass the join, so what is shuffled is a few rows per notice found.  All steps
are DataFrame functions.

Templates are broadcast if there are ``BROADCAST`` at most, and joined otherwise.

Defined cases: null or empty text matches nothing; a text of one word has no bigrams and matches
nothing; of equal scores the longer template, then the earlier window, then the lesser name is the best; repeated rows give
a row each; a very long text is searched whole, by parts of a template's length, so a notice that
stands in it many times costs in proportion; extra columns, whatever their names, are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.shared import ROW, numbered

LEAST = 0.8
BROADCAST = 1000
#: With more probe words than this, units are not probed.
PROBES = 64
#: Words of everyday prose, probed for only where no others serve.
COMMON = frozenset("a an and any are by for following in is may not of or subject that the this to under with you".split())
# Licence texts, headers and notices by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD": "This software is released under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


def _words(text: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def _bigrams(words: F.Column) -> F.Column:
    """In order; none of fewer than two words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def _run(own: F.Column, least: float) -> F.Column:
    """Bigrams that some run of a match holds: of own ones a part ``least`` is common, in at most (1 - least) * own + 1 runs."""
    return F.ceil(least * own / ((1 - least) * own + 1) - 1e-9)


def _templates(like: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """licence, own (number of bigrams), run, q (a bigram's place), bigram, often (how often it is there), first_q (its first place)."""
    listed = F.array(*(F.struct(F.lit(k).alias("licence"), F.lit(v).alias("text")) for k, v in sorted(templates.items())))
    rows = like.sparkSession.range(1).select(F.explode(listed).alias("t")).select("t.licence", F.explode(F.array(_bigrams(_words(F.col("t.text"))))).alias("b")).filter(F.size("b") > 0)
    each = rows.select("licence", "b", F.size("b").alias("own"), F.posexplode("b").alias("q", "bigram"))
    return each.select("licence", "own", _run(F.col("own"), least).alias("run"), "q", "bigram", F.size(F.filter("b", lambda x: x == F.col("bigram"))).alias("often"), (F.array_position("b", F.col("bigram")) - 1).alias("first_q"))


def probes(templates: dict[str, str], least: float) -> list[str]:
    """Words of which every window that matches any template holds one at least.

    A match of n bigrams shares least * (n + own) / 2 with the template, and n is own * least /
    (2 - least) at least.  Words are taken, the rare and long first, until the bigrams without any of
    them are too few for a match."""
    out: set[str] = set()
    for text in templates.values():
        words = _plain(text)
        left = list(zip(words, words[1:], strict=False))
        own = len(left)
        need = math.ceil(least * (math.ceil(own * least / (2 - least) - 1e-9) + own) / 2 - 1e-9)
        for w in sorted(set(words), key=lambda w: (w not in out, w in COMMON, -len(w), w)):
            if len(left) < need:
                break
            out.add(w)
            left = [b for b in left if w not in b]
    return sorted(out)


def _probe(words: list[str]) -> str:
    """A pattern for any of the words, whole and in any case; most letters fail at its first class."""
    firsts = "".join(sorted({c for w in words for c in (w[0].lower(), w[0].upper())}))
    return f"(?=[{firsts}])(?<![A-Za-z0-9])(?i:{'|'.join(words)})(?![A-Za-z0-9])"


def matches(rows: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """row, licence, own (its bigrams), start (the window's first word), score of all matches in rows (row, text)."""
    wanted = _templates(rows, templates, least)
    texts = rows.select("row", F.col("text").cast("string").alias("text"))
    wanted_words = probes(templates, least)
    if 0 < len(wanted_words) <= PROBES:  # a text without any of the words has no window with one
        texts = texts.filter(F.col("text").rlike(_probe(wanted_words)))
    # arrays of one are exploded so that the optimizer doesn't copy what is made here into each use
    cut = texts.select("row", F.explode(F.array(_words(F.col("text")))).alias("w")).select("row", F.explode(F.array(_bigrams(F.col("w")))).alias("b"))
    low = min((len(w) - 1 for t in templates.values() if len(w := _plain(t)) > 1), default=1) * least / (2 - least)
    cut = cut.filter(F.size("b") >= low - 1e-9)
    pairs = cut.select("row", F.size("b").alias("n"), F.posexplode("b").alias("pos", "bigram"))
    joined = pairs.join(F.broadcast(wanted) if len(templates) <= BROADCAST else wanted, "bigram")
    # windows, by where the template would begin
    at = joined.groupBy("row", "licence", "own", "run", "n", (F.col("pos") - F.col("q")).alias("start")).agg(F.count("*").alias("line")).filter(F.col("line") >= F.col("run"))
    held = F.least(F.col("start") + F.col("own"), F.col("n")) - F.greatest(F.col("start"), F.lit(0))
    at = at.select("row", "licence", "own", "start", held.alias("held")).filter(2 * F.least("held", "own") >= least * (F.col("held") + F.col("own")) - 1e-9)
    # a window lies in two parts of its length at most
    first = F.floor(F.col("start") / F.col("own"))
    last = F.floor((F.col("start") + F.col("own") - 1) / F.col("own"))
    at = at.select("row", "licence", "own", "start", "held", F.explode(F.array_distinct(F.array(first, last))).alias("part"))
    hits = joined.filter("q = first_q").select("row", "licence", "own", "pos", "bigram", "often")
    hits = hits.withColumn("part", F.floor(F.col("pos") / F.col("own"))).drop("own")
    inside = at.join(hits, ["row", "licence", "part"]).filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("own")))
    common = inside.groupBy("row", "licence", "start", "own", "held", "bigram", "often").agg(F.count("*").alias("k"))
    scored = common.groupBy("row", "licence", "start", "own", "held").agg(F.sum(F.least("k", "often")).alias("common"))
    return scored.select("row", "licence", "own", "start", (2.0 * F.col("common") / (F.col("held") + F.col("own"))).alias("score")).filter(F.col("score") >= least)


def _plain(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, licence, score, start (all null if none), n_matches (licences that match) of every row."""
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).withColumnRenamed(ROW, "row")
    best = F.min(F.struct((-F.col("score")).alias("s"), (-F.col("own")).alias("o"), "start", "licence")).alias("best")
    per_licence = matches(rows.select("row", "text"), templates, least).groupBy("row", "licence").agg(best)
    per = per_licence.groupBy("row").agg(F.min("best").alias("best"), F.count("*").alias("n_matches")).withColumnRenamed("row", "found")
    done = rows.select("row", "doc_id").join(per, F.col("row") == F.col("found"), "left")
    return done.select("doc_id", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("score"), F.col("best.start").cast("long").alias("start"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"))


def _sql(templates: dict[str, str], least: float) -> str:
    words = "list_filter(string_split(lower(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    bigrams = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH v AS (SELECT licence, {bigrams} AS b FROM (SELECT licence, {words.format("text")} AS w FROM (VALUES {values}) v(licence, text))),
t AS (SELECT licence, unnest(range(len(b))) AS q, unnest(b) AS bigram, len(b) AS own FROM v),
often AS (SELECT licence, bigram, count(*) AS often FROM t GROUP BY ALL),
d AS (SELECT row_number() OVER () AS row, doc_id, {words.format("text")} AS w FROM documents),
p AS (SELECT row, len(b) AS n, unnest(range(len(b))) AS pos, unnest(b) AS bigram FROM (SELECT row, {bigrams} AS b FROM d WHERE len(w) > 1)),
j AS (SELECT row, n, pos, licence, own, q, bigram FROM p JOIN t USING (bigram)),
s AS (SELECT row, licence, own, n, pos - q AS start FROM j GROUP BY ALL HAVING count(*) >= ceil({least} * own / ({1 - least!r} * own + 1) - 1e-9)),
h AS (SELECT DISTINCT row, licence, pos, bigram, often FROM j JOIN often USING (licence, bigram)),
c AS (SELECT s.row, s.licence, own, n, start, bigram, often, count(*) AS k FROM s JOIN h ON s.row = h.row AND s.licence = h.licence AND pos >= start AND pos < start + own GROUP BY ALL),
m AS (SELECT row, licence, own, start, 2.0::DOUBLE * sum(least(k, often)) / (least(start + own, n) - greatest(start, 0) + own) AS score FROM c GROUP BY row, licence, start, own, n),
k AS (SELECT row, licence, start, score, row_number() OVER (PARTITION BY row ORDER BY score DESC, own DESC, start, licence) AS r FROM m WHERE score >= {least}),
o AS (SELECT row, count(DISTINCT licence) AS n_matches FROM k GROUP BY row)
SELECT doc_id, licence, score, start::BIGINT AS "start", coalesce(n_matches, 0)::BIGINT AS n_matches FROM d LEFT JOIN (SELECT * FROM k JOIN o USING (row) WHERE r = 1) USING (row)"""


SQL = _sql(TEMPLATES, LEAST)
