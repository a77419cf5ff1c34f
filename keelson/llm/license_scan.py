"""License scans as an exact set-similarity join of text blocks with license notices.

A block is a run of as many words as a notice has, wherever it stands, over line ends too, one from every word of the
notice on. It meets the notice if it holds at least alpha = ceil(threshold * |T|) of its |T| distinct tokens, and all of
the few that tell the notice from its kin (a "must": CC BY-NC is no CC BY-SA).

Tokens are ranked by their counts over all documents, rarest first; a notice is a sorted set of ranks. A document can
hold a block only if it holds one of the notice's |T| - alpha + 1 rarest tokens (prefix filter, an inverted list from
rank to notices), alpha known tokens (length filter), and from the first shared rank on leaves enough of both sets
(positional filter). For the notices that are left, alpha hits must lie within the block's length, and only then is the
block intersected exactly.

The notices are configuration of a bounded size (INDEX_BYTES), so the join is a lookup within the row: documents are
read twice (token counts, then matching) and never shuffled, whatever repeats.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows are scanned each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_WORD, ascii_lower, code_words, read_table

INDEX_BYTES = 16 << 20
THRESHOLD = 0.8

#: Fixed phrases and labels of the query.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: The method's notices, in their published wording: a label, the words that must be there, and the text.
TEMPLATES = (
    ("apache", "apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl", "program", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "lesser", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "affero", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "noderivatives", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "cc by sa", "CC BY-SA 4.0"),
    ("cc-by-nc", "cc by nc", "CC BY-NC 4.0"),
    ("cc-by-nd", "cc by nd", "CC BY-ND 4.0"),
    ("cc0", "cc0", "CC0 1.0 Universal"),
    ("all-rights-reserved", "", "All rights reserved"),
)


def template_words(text: str) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def template_tokens(text: str) -> list[str]:
    """The distinct words of a template, in order of first use."""
    return list(dict.fromkeys(template_words(text)))


def _places(words: Column, joined: Column, phrase: str) -> Column:
    """Starts of the phrase among the words; texts that do not hold it are told by one search."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == part)
        return same

    return F.when(F.contains(joined, F.lit(f" {phrase} ")), F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def token_counts(docs: DataFrame, tokens: set[str], text: str = "text") -> dict[str, int]:
    """How often each template token stands in the documents; one row for each token reaches the driver."""
    words = docs.select(F.explode(F.split(ascii_lower(F.col(text).cast("string")), NON_WORD)).alias("w")).where(F.col("w").isin(sorted(tokens)))
    return {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


class TemplateIndex:
    """Notices as sorted ranks, the inverted lists of their prefixes, and the columns that look them up."""

    def __init__(self, templates, counts: dict[str, int], threshold: float):
        sets = [(label, template_tokens(must), template_tokens(text), len(template_words(text))) for label, must, text in templates]
        order = sorted({t for _, _, tokens, _ in sets for t in tokens}, key=lambda t: (counts.get(t, 0), t))
        rank = {t: i for i, t in enumerate(order)}
        self.order, self.rows, self.postings = order, [], [[] for _ in order]
        for k, (label, must, tokens, words) in enumerate(sets):
            ranks = sorted(rank[t] for t in tokens)
            alpha = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            self.rows.append({"label": label, "alpha": alpha, "words": words, "must": sorted(rank[t] for t in must), "ranks": ranks})
            for r in ranks[: len(ranks) - alpha + 1]:
                self.postings[r].append(k)
        self.buckets: list[list[dict]] = [[] for _ in range(2 * len(order) or 1)]
        for t, r in rank.items():
            self.buckets[zlib.crc32(t.encode()) % len(self.buckets)].append({"t": t, "r": r})
        if (n := len(json.dumps([self.rows, self.postings, self.buckets]))) > INDEX_BYTES:
            raise ValueError(f"the template index takes {n} bytes; at most {INDEX_BYTES} travel with a task")

    def _entries(self, word: Column) -> Column:
        """The entry {t, r} of a known word; empty for others."""
        table = F.from_json(F.lit(json.dumps(self.buckets)), "array<array<struct<t:string,r:int>>>")
        return F.filter(F.get(table, F.pmod(F.crc32(word.cast("binary")), F.lit(len(self.buckets))).cast("int")), lambda e: e["t"] == word)

    def candidates(self, words: Column) -> Column:
        """The notices of which a text of these words may hold a block."""
        rows = F.from_json(F.lit(json.dumps(self.rows)), "array<struct<label:string,alpha:int,words:int,must:array<int>,ranks:array<int>>>")
        lists = F.from_json(F.lit(json.dumps(self.postings)), "array<array<int>>")
        known = F.array_intersect(F.array(*map(F.lit, self.order)) if self.order else F.array().cast("array<string>"), words)
        ranks = F.array_sort(F.transform(F.flatten(F.transform(known, self._entries)), lambda e: e["r"]))

        def of(ranks: Column) -> Column:
            listed = F.transform(F.array_distinct(F.flatten(F.transform(ranks, lambda r: F.get(lists, r)))), lambda k: F.get(rows, k))
            long = F.filter(listed, lambda t: (F.size(ranks) >= t["alpha"]) & (F.size(F.array_except(t["must"], ranks)) == 0))

            def bound(t: Column) -> Column:
                first = F.array_min(F.array_intersect(t["ranks"], ranks))
                return 1 + F.least(F.size(t["ranks"]) - F.array_position(t["ranks"], first), F.size(ranks) - F.array_position(ranks, first))

            placed = F.filter(long, lambda t: bound(t) >= t["alpha"])
            return F.filter(placed, lambda t: F.size(F.array_intersect(ranks, t["ranks"])) >= t["alpha"])

        return F.flatten(F.transform(F.array(ranks), of))  # within a transform the ranks are worked out once

    def blocks(self, words: Column) -> Column:
        """(first, words, label, containment) of every block of the words that meets a notice."""
        hits = F.flatten(F.transform(words, lambda w, i: F.transform(self._entries(w), lambda e: F.struct(i.alias("i"), e["r"].alias("r")))))

        def of(t: Column, own: Column) -> Column:
            def block(h: Column, j: Column) -> Column:
                near = F.filter(F.slice(own, j + 1, t["words"]), lambda g: g["i"] < h["i"] + t["words"])
                return F.struct(h["i"].alias("first"), F.array_distinct(F.transform(near, lambda g: g["r"])).alias("held"))

            dense = F.filter(F.transform(own, lambda h, j: F.struct(h.alias("h"), j.alias("j"), F.get(own, j + t["alpha"] - 1)["i"].alias("to"))), lambda x: x["to"] < x["h"]["i"] + t["words"])
            met = F.filter(F.transform(dense, lambda x: block(x["h"], x["j"])), lambda b: (F.size(b["held"]) >= t["alpha"]) & (F.size(F.array_except(t["must"], b["held"])) == 0))
            return F.transform(met, lambda b: F.struct(b["first"].alias("first"), t["words"].alias("words"), t["label"].alias("label"), (F.size(b["held"]) / F.size(t["ranks"])).alias("containment")))

        def each(some: Column) -> Column:
            every = lambda placed: F.flatten(F.transform(some, lambda t: F.flatten(F.transform(F.array(F.filter(placed, lambda x: F.array_contains(t["ranks"], x["r"]))), lambda own: of(t, own)))))
            none = F.array().cast("array<struct<first:int,words:int,label:string,containment:double>>")
            return F.when(F.size(some) > 0, F.flatten(F.transform(F.array(hits), every))).otherwise(none)

        return F.flatten(F.transform(F.array(self.candidates(words)), each))


def _index(docs: DataFrame, templates, threshold: float) -> TemplateIndex:
    return TemplateIndex(templates, token_counts(docs, {t for _, _, text in templates for t in template_tokens(text)}), threshold)


def license_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, first word (from 0), label, containment and the words, joined by blanks, of every block that meets a notice.

    Blocks of one notice that start at different words of it are blocks of their own.
    """
    index = _index(docs, templates, threshold)
    words = docs.select("doc_id", code_words(F.col("text").cast("string")).alias("w"))
    found = words.select("doc_id", "w", F.explode(index.blocks(F.col("w"))).alias("m"))
    return found.select("doc_id", "m.first", "m.label", "m.containment", F.array_join(F.slice("w", F.col("m.first") + 1, F.col("m.words")), " ").alias("block"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row of docs."""
    index = _index(docs, templates, threshold)
    given = docs.select("doc_id", code_words(F.col("text").cast("string")).alias("w"))
    words = given.select("doc_id", "w", index.blocks(F.col("w")).alias("m"))
    joined = words.select("*", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("j"))
    places = joined.select("doc_id", F.size("w").cast("long").alias("n_words"), "m", *[_places(F.col("w"), F.col("j"), p).alias(f"p{k}") for k, (p, _) in enumerate(phrases)])
    starts = F.concat(*[f"p{k}" for k in range(len(phrases))])
    base = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]))
    out = places.select("doc_id", "n_words", "m", starts.alias("starts"), base.alias("base"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("m", lambda m: m["label"]))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("m", lambda m: m["containment"])), F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    low = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda c: f"regexp_extract_all({low(c)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    lists = ", ".join(f"('{label}', {template_tokens(must)!r}::VARCHAR[], {template_tokens(text)!r}, {len(template_words(text))})" for label, must, text in TEMPLATES)
    places = " UNION ALL ".join(f"SELECT doc_id, i, '{label}' AS label FROM w, LATERAL (SELECT unnest(range(len(w.ws))) AS i) WHERE list_slice(ws, i + 1, i + {len(p.split())}) = {p.split()!r}" for p, label in PHRASES)
    return f"""
WITH w AS (SELECT doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
base AS ({places}),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
t(label, must, ts, nw) AS (VALUES {lists}),
q AS (SELECT *, ceil({THRESHOLD} * len(ts) - 1e-9) AS alpha FROM t),
k AS (SELECT doc_id, ws, q.* FROM w, q WHERE len(list_intersect(ts, ws)) >= alpha),
g AS (SELECT doc_id, label, must, ts, alpha, list_slice(ws, i + 1, i + nw) AS g FROM (SELECT *, unnest(range(len(ws))) AS i FROM k) WHERE list_contains(ts, ws[i + 1])),
m AS (SELECT doc_id, label, CAST(len(list_intersect(ts, g)) AS DOUBLE) / len(ts) AS c FROM g WHERE len(list_intersect(ts, g)) >= alpha AND list_has_all(g, must)),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION ALL SELECT doc_id, label FROM base) GROUP BY doc_id),
s AS (SELECT doc_id, max(c) AS score FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)
"""


OP4_SQL = _sql()
