"""License scans through a positional index of rare words.

A template is a notice (one phrase) or a licence text with mandatory key phrases at known places.  The index lists, for
the words of highest IDF among the templates, every phrase that holds the word and where.  A file looks up its own such
words with their positions; each posting proposes the place where its phrase would start, and only places proposed by all
the rare words of a phrase are compared word by word.  A licence text counts where its key phrases stand at the right
distances and enough of its rare words, weighed by IDF, lie where the template has them.

Everything happens inside a row: there is no shuffle, no join and no Python on executors, so hot sources, repeated rows and
rows without an id make no difference.  Work is linear in the words of a file plus its lookups.

Defined results: a null or empty text has no words, no places, empty labels and score 0; texts of any length are scanned
whole; equal rows give equal rows; a label found several times is listed once; columns of the input with the name of a new
one are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, whole_text

# fixed value: what stands between words
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

RARE_IN_PHRASE = 3    # words of a phrase that the index holds
RARE_IN_TEXT = 16     # words of a licence text whose presence is weighed
SLACK = 12            # words that may be added or left out between a key phrase and another part of a text
TEXT_SHARE = 0.5      # least weighed share of a text's rare words
# words that say nothing of a licence: never looked up, however rare among the templates
COMMON = frozenset("a all an and any are as at be by can do for from in into is it its may no not of on or other that the this to under use used with you your".split())


def words_of(text: str) -> tuple[str, ...]:
    return tuple(re.findall("[0-9a-z]+", text.lower()))


@dataclass(frozen=True)
class Template:
    """A label with a notice (``phrases`` alone: any of them) or a text (all ``phrases`` are mandatory parts of it)."""

    label: str
    phrases: tuple[str, ...]
    text: str = ""


# fixed values: the phrases of the licence query and their labels
BASE = (Template("mit", ("under the mit license",)), Template("apache-2", ("apache license version 2",)), Template("cc-by-nc", ("cc by nc",)))

NOTICES = (
    Template("mit", ("mit license", "spdx license identifier mit")),
    Template("apache-2", ("apache license 2 0", "apache software license version 2", "spdx license identifier apache 2 0")),
    Template("gpl-3", ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gpl 3 0")),
    Template("gpl-2", ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gpl 2 0")),
    Template("lgpl", ("gnu lesser general public license", "gnu library general public license")),
    Template("agpl", ("gnu affero general public license",)),
    Template("mpl-2", ("mozilla public license version 2 0", "mozilla public license v 2 0", "mpl 2 0")),
    Template("epl", ("eclipse public license",)),
    Template("bsl", ("boost software license",)),
    Template("cc-by-nc", ("creative commons attribution noncommercial", "creative commons attribution non commercial")),
    Template("cc-by-sa", ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike")),
    Template("cc-by-nd", ("cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs")),
    Template("cc-by", ("cc by 4 0", "cc by 3 0", "creative commons attribution 4 0", "creative commons attribution 3 0")),
    Template("cc0", ("cc0 1 0", "creative commons zero")),
    Template("unlicense", ("free and unencumbered software released into the public domain",)),
)

_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License "
        "as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
        "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.")
TEXTS = (
    Template("mit", ("permission is hereby granted free of charge to any person obtaining a copy", "the software is provided as is without warranty of any kind"),
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
             "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
             "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
             "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
             "in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."),
    Template("bsd", ("redistribution and use in source and binary forms", "must retain the above copyright notice"), _BSD),
    Template("bsd-3", ("redistributions in binary form must reproduce the above copyright notice", "to endorse or promote products derived from this software"),
             _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
             "derived from this software without specific prior written permission."),
    Template("isc", ("use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
             "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
             "that the above copyright notice and this permission notice appear in all copies."),
    Template("zlib", ("in no event will the authors be held liable", "altered source versions must be plainly marked as such"),
             "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
             "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
             "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this "
             "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
             "product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must "
             "be plainly marked as such, and must not be misrepresented as being the original software."),
    Template("apache-2", ("licensed under the apache license", "you may not use this file except in compliance with the license"),
             "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
             "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
             "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
             "KIND, either express or implied."),
    Template("gpl-2", ("gnu general public license as published by the free software foundation", "either version 2 of the license"), _GNU.format(kind="", n=2)),
    Template("gpl-3", ("gnu general public license as published by the free software foundation", "either version 3 of the license"), _GNU.format(kind="", n=3)),
)


@dataclass(frozen=True)
class Index:
    """Phrases and texts of a set of templates with their rare words."""

    phrases: list[tuple[str, ...]]                  # by phrase number
    notice: list[str | None]                        # label of a phrase that is a notice
    base: list[bool]                                # whether a phrase counts as a base place
    base_label: list[str | None]
    postings: dict[str, list[tuple[int, int, int, int]]] = field(default_factory=dict)   # word -> (phrase, offset, ordinal, ordinals)
    texts: list[tuple[str, int, list[tuple[int, int]], list[tuple[str, int, int]]]] = field(default_factory=list)
    # of a text: label, its first key phrase, the others with their distance, rare words with distance and weight


def build_index(base=BASE, notices=NOTICES, texts=TEXTS) -> Index:
    """The index of a fixed set of templates: a few hundred postings."""
    units = [words_of(p) for t in (*base, *notices) for p in t.phrases] + [words_of(t.text) for t in texts]
    df = Counter(w for unit in units for w in set(unit))
    idf = {w: 0 if w in COMMON else round(1000 * math.log((len(units) + 1) / n)) for w, n in df.items()}
    number: dict[tuple[str, ...], int] = {}
    index = Index([], [], [], [])

    def phrase(text: str) -> int:
        key = words_of(text)
        if key not in number:
            number[key] = len(number)
            for column, value in ((index.phrases, key), (index.notice, None), (index.base, False), (index.base_label, None)):
                column.append(value)
            rare = sorted(sorted((i for i in range(len(key)) if key[i] not in COMMON), key=lambda i: (-idf.get(key[i], 0), i))[:RARE_IN_PHRASE])
            for k, at in enumerate(rare):
                index.postings.setdefault(key[at], []).append((number[key], at, k, len(rare)))
        return number[key]

    for t in base:
        for p in t.phrases:
            n = phrase(p)
            index.base[n], index.base_label[n], index.notice[n] = True, t.label, t.label
    for t in notices:
        for p in t.phrases:
            n = phrase(p)
            index.notice[n] = index.notice[n] or t.label
    for t in texts:
        full = words_of(t.text)
        keys = [(phrase(p), next(i for i in range(len(full)) if full[i:i + len(words_of(p))] == words_of(p))) for p in t.phrases]
        first, start = keys[0]
        once = [i for i in range(len(full)) if full.index(full[i]) == i and full[i] not in COMMON]
        rare = sorted(once, key=lambda i: (-idf[full[i]], i))[:RARE_IN_TEXT]
        index.texts.append((t.label, first, [(n, at - start) for n, at in keys[1:]], [(full[i], i - start, idf[full[i]]) for i in sorted(rare)]))
    return index


def _array(items, of) -> Column:
    return F.array(*[of(x) for x in items])


def _is_phrase(number: int):
    return lambda place: place["phrase"] == number


def _share_at(others: list[tuple[int, int]], words: list[tuple[str, int, int]]):
    """Of a place of a text's first key phrase: the weighed share of its rare words there, null without the other keys."""
    total = sum(idf for _, _, idf in words)
    listed = _array(words, lambda x: F.struct(F.lit(x[0]).alias("w"), F.lit(x[1]).alias("far"), F.lit(x[2]).alias("idf")))

    def key_stands(phrase: int, far: int, place: Column) -> Column:
        return F.exists("places", lambda o: (o["phrase"] == phrase) & (F.abs(o["start"] - place["start"] - far) <= SLACK))

    def share(place: Column) -> Column:
        def near(far: Column) -> Column:
            return F.slice(F.col("__w"), (F.greatest(place["start"] + far - SLACK, F.lit(0)) + 1).cast("int"), F.lit(2 * SLACK + 1))

        met = F.aggregate(listed, F.lit(0), lambda a, x: a + F.when(F.array_contains(near(x["far"]), x["w"]), x["idf"]).otherwise(0))
        return F.when(reduce(Column.__and__, [key_stands(p, far, place) for p, far in others], F.lit(True)), met / F.lit(total))

    return share


def scan_licenses(docs: DataFrame, index: Index | None = None, col: str = "text") -> DataFrame:
    """Adds ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` and ``score`` to every row.

    ``places`` lists every verified phrase as (start, phrase number); ``score`` is the largest weighed share of a found
    template, 1 for a notice.
    """
    index = index or build_index()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")
    kept = [c for c in docs.columns if c not in names]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"),
                     F.filter(F.split(ascii_lower(whole_text(f"`{col}`")), GAP), lambda w: w != "").alias("__w"))
    rare = F.array_compact(F.transform("__w", lambda w, i: F.when(w.isin(*index.postings), F.struct(w.alias("w"), i.alias("i")))))
    df = df.select("__row", "__w", F.size("__w").cast("long").alias("n_words"), rare.alias("__rare"))

    # postings of the file's rare words as proposed places: (phrase, start, ordinal, ordinals)
    table = F.create_map(*[c for w, found in index.postings.items() for c in (F.lit(w), _array(
        found, lambda p: F.struct(F.lit(p[0]).alias("p"), F.lit(p[1]).alias("at"), F.lit(p[2]).alias("k"), F.lit(p[3]).alias("n"))))])
    proposed = F.flatten(F.transform("__rare", lambda r: F.transform(F.element_at(table, r["w"]), lambda p: F.struct(
        p["p"].alias("p"), (r["i"] - p["at"]).alias("s"), p["k"].alias("k"), p["n"].alias("n")))))
    df = df.withColumn("__v", F.when(F.size("__rare") > 0, F.sort_array(F.filter(proposed, lambda v: v["s"] >= 0))).otherwise(F.array()))

    # a phrase's ordinals follow each other in the sorted list exactly where all its rare words agree on the start
    agreed = F.filter(F.col("__v"), lambda v, i: (v["k"] == 0) & F.get(F.col("__v"), i + v["n"] - 1).eqNullSafe(
        F.struct(v["p"].alias("p"), v["s"].alias("s"), (v["n"] - 1).alias("k"), v["n"].alias("n"))))
    phrases = _array(index.phrases, lambda p: _array(p, F.lit))
    right = F.filter(agreed, lambda v: F.slice("__w", v["s"] + 1, F.size(F.get(phrases, v["p"]))) == F.get(phrases, v["p"]))
    places = F.sort_array(F.transform(right, lambda v: F.struct(v["s"].cast("long").alias("start"), v["p"].alias("phrase"))))
    df = df.withColumn("places", F.when(F.size("__v") > 0, places).otherwise(F.array())).drop("__v", "__rare")

    base = F.filter("places", lambda q: F.get(_array(index.base, F.lit), q["phrase"]))
    notices = F.array_compact(F.transform("places", lambda q: F.get(_array(index.notice, F.lit), q["phrase"])))
    texts = []
    for label, first, others, words in index.texts:
        best = F.array_max(F.transform(F.filter("places", _is_phrase(first)), _share_at(others, words)))
        texts.append(F.struct(F.lit(label).alias("label"), best.alias("share")))
    df = df.withColumn("__base", base).withColumn("__notice", notices)
    df = df.withColumn("__text", F.when(F.size("places") > 0, F.filter(F.array(*texts), lambda t: t["share"] >= TEXT_SHARE)).otherwise(F.array()))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base_labels = F.transform("__base", lambda q: F.get(_array(index.base_label, F.lit), q["phrase"]))
    score = F.when(F.size("__notice") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("__text", lambda t: t["share"])), F.lit(0.0)))
    return df.select(
        "__row.*", "n_words", F.size("__base").cast("long").alias("n_base"),
        F.array_min("__base")["start"].alias("first_word"), F.array_max("__base")["start"].alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.concat("__notice", F.transform("__text", lambda t: t["label"]))).alias("labels"),
        score.alias("score"), "places")


def scan_sql(index: Index | None = None) -> str:
    """The same rows by comparing every phrase at every word."""
    index = index or build_index()

    def text(x: str | None) -> str:
        return "NULL" if x is None else f"'{x}'"

    phrases = ", ".join(f"({n}, {text(p[0])}, [{', '.join(map(text, p))}], {text(index.notice[n])}, {text(index.base_label[n])})" for n, p in enumerate(index.phrases))
    texts = ", ".join(f"({k}, '{label}', {first}, {len(others)}, {sum(w for _, _, w in words)})" for k, (label, first, others, words) in enumerate(index.texts))
    keys = ", ".join(f"({k}, {n}, {far})" for k, t in enumerate(index.texts) for n, far in t[2])
    rares = ", ".join(f"({k}, '{w}', {far}, {idf})" for k, t in enumerate(index.texts) for w, far, idf in t[3])
    return f"""
WITH phrases(p, head, ws, notice, base) AS (VALUES {phrases}),
texts(k, label, p, n_keys, total) AS (VALUES {texts}),
keys(k, p, far) AS (VALUES {keys}),
rares(k, w, far, idf) AS (VALUES {rares}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
q AS (SELECT u.doc_id, u.i AS s, ph.p, ph.notice, ph.base FROM u JOIN phrases ph ON u.w = ph.head JOIN d USING (doc_id) WHERE d.ws[u.i + 1 : u.i + len(ph.ws)] = ph.ws),
c AS (SELECT q.doc_id, q.s, t.k, t.label, t.total FROM q JOIN texts t ON t.p = q.p
  WHERE (SELECT count(DISTINCT y.p) FROM keys y JOIN q o ON o.p = y.p WHERE y.k = t.k AND o.doc_id = q.doc_id AND abs(o.s - q.s - y.far) <= {SLACK}) = t.n_keys),
m AS (SELECT DISTINCT c.doc_id, c.s, c.k, c.label, c.total, r.w, r.idf FROM c JOIN rares r ON r.k = c.k
  JOIN u ON u.doc_id = c.doc_id AND u.w = r.w AND u.i BETWEEN c.s + r.far - {SLACK} AND greatest(c.s + r.far - {SLACK}, 0) + {2 * SLACK}),
f AS (SELECT doc_id, label, sum(idf) / total AS share FROM m GROUP BY doc_id, s, k, label, total HAVING sum(idf) / total >= {TEXT_SHARE}),
b AS (SELECT doc_id, count(*) AS n, min(s) AS lo, max(s) AS hi, string_agg(DISTINCT base, ',' ORDER BY base) AS labels FROM q WHERE base IS NOT NULL GROUP BY 1),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM (SELECT doc_id, notice AS label, 1.0::DOUBLE AS share FROM q WHERE notice IS NOT NULL UNION ALL SELECT doc_id, label, share::DOUBLE FROM f) GROUP BY 1)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(a.score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""
