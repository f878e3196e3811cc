"""License scans by patience alignment.

1. *Passages.* Where a document uses words typical of the templates, the words around them form a passage; typical words more than ``GAP`` words
   apart start a new one. Passages are rows of their own: a long text with many notices spreads over tasks.
2. *Candidates.* Passages meet templates in an equi-join on typical words; a pair with at least half of a template's typical words goes on.
3. *Alignment.* Words that are unique both in the passage and in the template are anchors; the longest increasing subsequence of their
   places is kept; the gaps between kept anchors are aligned in the same way, down to gaps without anchors, of which equal ends are taken.
   Coverage is the share of the template's words that were aligned. A passage may hold a notice several times (``copies``): words that are unique
   in the template propose where it begins, a stretch of the template's length there is aligned, the best supported first, and what an
   accepted copy leaves of the passage is searched again, at last in stretches of twice that length, as far as a copy may be drawn out.

A document is reported with every template of coverage ``COVERAGE`` or more whose aligned words fill at least half of their span; a match lacks none
of its template's numbers (other than 0) and has exactly its words of ``TELLING``, so that another version or variant is no match; of templates
that align to overlapping words the one with the most aligned words stays (ties: higher coverage, smaller name, earlier place), and what overlaps
none that stayed stays too.

Null and empty texts have no passage. Rows are told apart by id and a hash of the text; repeated rows are reported alike. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from taxloom.llm.sizes import if_small
from taxloom.session import settle

COVERAGE = 0.75
#: Words between typical words of one passage at most.
GAP = 12

_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
             "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
             "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
             "documentation and/or other materials provided with the distribution.")
_BSD_TAIL = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
             "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")
# License notices, as their licenses publish them or as they are usually abbreviated.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                 "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                  "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSD-2-Clause", _BSD_HEAD + " " + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission. " + _BSD_TAIL),
)
#: Words that tell licenses of one family apart: a match holds all that its template has, and no other.
TELLING = frozenset("nc nd sa noncommercial noderivatives noderivs sharealike lesser affero".split())
# Words that say nothing about a license.
COMMON = frozenset("the of and to in a is be at by for with or as any this that not you may are it on an from all do so can use work person form file".split())
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def typical(words: list[str]) -> set[str]:
    return {w for w in words if w not in COMMON and (len(w) > 1 or w.isdigit())}


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of words aligned between two word lists, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        places: list[dict[str, int]] = [{}, {}]
        for side, (words, lo, hi) in enumerate(((a, i, j), (b, k, m))):
            for x in range(lo, hi):
                places[side][words[x]] = -1 if words[x] in places[side] else x
        both = sorted((places[0][w], y) for w, y in places[1].items() if y >= 0 and places[0].get(w, -1) >= 0)
        # longest increasing subsequence of the places in b: piles of last elements, with a link to the pile before
        tops: list[int] = []
        ends: list[int] = []
        back = [-1] * len(both)
        for n, (_, y) in enumerate(both):
            at = bisect_left(tops, y)
            tops[at:at + 1] = [y]
            ends[at:at + 1] = [n]
            back[n] = ends[at - 1] if at else -1
        chain = []
        n = ends[-1] if ends else -1
        while n >= 0:
            chain.append(both[n])
            n = back[n]
        if not chain:
            continue
        chain.reverse()
        out += chain
        lo_a, lo_b = i, k
        for x, y in [*chain, (j, m)]:
            todo.append((lo_a, x, lo_b, y))
            lo_a, lo_b = x + 1, y + 1
    return sorted(out)


def copies(words: list[str], wanted: list[str], coverage: float = COVERAGE) -> list[tuple[int, int, int]]:
    """``begin, end, aligned`` of the copies of a template in a passage; they do not overlap."""
    size = len(wanted)
    slack = max(2, int(size * (1 - coverage)))
    once = {w: i for i, w in enumerate(wanted) if wanted.count(w) == 1} or {w: wanted.index(w) for w in wanted}
    told = {w for w in wanted if w in TELLING or w.isdigit() and w != "0"}
    out: list[tuple[int, int, int]] = []
    free = [(0, len(words))]
    for reach in (slack, size):
        # offset of the template's first word as every seed would have it
        seeds = sorted((p - once[w], p) for lo, hi in free for p, w in enumerate(words[lo:hi], lo) if w in once)
        offsets = [d for d, _ in seeds]
        near = {d: bisect_left(offsets, d + reach + 1) - bisect_left(offsets, d - slack) for d in offsets}
        # A copy lacks at most the share 1 - coverage of all words, so it holds the other unique ones.
        least = max(1, len(once) - int(size * (1 - coverage)))
        tried: set[tuple[int, int]] = set()
        for d, p in sorted(seeds, key=lambda x: (-near[x[0]], x)):
            if near[d] < least:
                break
            room = next(((lo, hi) for lo, hi in free if lo <= p < hi), None)
            if room is None:
                continue
            lo, hi = max(room[0], d - slack), min(room[1], d + size + reach)
            if (lo, hi) in tried:
                continue
            tried.add((lo, hi))
            pairs = aligned(words[lo:hi], wanted)
            if not pairs:
                continue
            begin, end = lo + pairs[0][0], lo + pairs[-1][0] + 1
            if told - {wanted[y] for _, y in pairs} or TELLING.intersection(words[begin:end]) - told:
                continue
            if len(pairs) >= coverage * size and 2 * len(pairs) >= end - begin:
                out.append((begin, end, len(pairs)))
                free.remove(room)
                free += [x for x in ((room[0], begin), (end, room[1])) if x[0] < x[1]]
    return sorted(out)


def templates_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``template, license, size, words, typical``: as many rows as there are templates."""
    rows = [(i, name, len(words_of(t)), words_of(t), sorted(typical(words_of(t)))) for i, (name, t) in enumerate(templates)]
    return spark.createDataFrame(rows, "template int, license string, size int, words array<string>, typical array<string>")


def passages(documents: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, text_hash, start, words``: the passages of every document, ``start`` counted in words."""
    vocabulary = set().union(*(typical(words_of(t)) for _, t in templates))
    # A match misses at most a share of 1 - coverage of a template's words, so it holds one of the longest few; other texts are passed over.
    signs: set[str] = set()
    for _, t in templates:
        words = words_of(t)
        signs.update(sorted(typical(words), key=lambda w: (-len(w), w))[:int(len(words) * (1 - coverage) + 1e-9) + 1])
    signs = {w for w in signs if not any(v != w and v in w for v in signs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "start", "words"]
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for doc, own, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text").to_pylist(), strict=True):
                low = (text or "").lower()
                if not any(w in low for w in signs):
                    continue
                words = words_of(low)
                hits = [i for i, w in enumerate(words) if w in vocabulary]
                runs: list[list[int]] = []
                for i in hits:
                    if runs and i - runs[-1][-1] <= GAP:
                        runs[-1].append(i)
                    else:
                        runs.append([i])
                for n, r in enumerate(runs):
                    if len(r) < 2:
                        continue
                    lo = max(0, r[0] - GAP, runs[n - 1][-1] + 1 if n else 0)
                    hi = min(r[-1] + GAP + 1, runs[n + 1][0] if n + 1 < len(runs) else len(words))
                    for values, v in zip(rows, (doc, own, lo, words[lo:hi]), strict=True):
                        values.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInArrow(run, "doc_id long, text_hash long, start long, words array<string>").distinct()


def matches(found: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, text_hash, license, start, end, aligned, coverage`` for each passage that matches; word places, end exclusive."""
    table = templates_table(found.sparkSession, templates)
    key = ["doc_id", "text_hash", "start"]
    heads = found.select(*key, F.explode(F.array_distinct("words")).alias("word"))
    pairs = heads.join(table.select("template", F.size("typical").alias("wanted"), F.explode("typical").alias("word")), "word").groupBy(
        *key, "template").agg(F.count("*").alias("shared"), F.max("wanted").alias("wanted")).where("2 * shared >= wanted")
    pairs = pairs.select(*[F.col(k).alias(f"__{k}") for k in key], "template")
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_hash") == F.col("__text_hash")) & (F.col("start") == F.col("__start"))
    ready = found.join(pairs, same).join(table.select("template", "license", F.col("words").alias("wanted")), "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["doc_id", "text_hash", "license", "begin", "end", "aligned", "coverage"]
            rows: list[list] = [[] for _ in names]
            for doc, own, name, start, words, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "license", "start", "words", "wanted")), strict=True):
                for begin, end, count in copies(words, wanted, coverage):
                    for values, v in zip(rows, (doc, own, name, start + begin, start + end, count, count / len(wanted)), strict=True):
                        values.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names)

    done = ready.select(*key, "words", "license", "wanted").mapInArrow(
        run, "doc_id long, text_hash long, license string, begin long, end long, aligned long, coverage double")
    # Matches that overlap, directly or through others, are a run. Best first, a match stays if it overlaps none that stayed.
    order = Window.partitionBy("doc_id", "text_hash").orderBy("begin", "end", "license")
    last = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = done.withColumn("new", F.coalesce((F.col("begin") >= last).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("doc_id", "text_hash", "run")
    alone = settle(runs.withColumn("n", F.count("*").over(own)), "aligned")
    columns = ["doc_id", "text_hash", "license", "begin", "end", "aligned", "coverage"]
    picked = alone.where("n > 1").select(*columns, "run").groupBy("doc_id", "text_hash", "run").applyInPandas(
        best_apart, "doc_id long, text_hash long, license string, begin long, end long, aligned long, coverage double")
    return alone.where("n = 1").select(columns).unionByName(picked).withColumnRenamed("begin", "start")


def best_apart(run: pd.DataFrame) -> pd.DataFrame:
    """The matches of one run, best first, without those that overlap a better one that stayed: most aligned words, then coverage, name, place."""
    ranked = run.assign(minus=-run["aligned"], less=-run["coverage"]).sort_values(["minus", "less", "license", "begin", "end"])
    starts, ends, stay = [], [], []
    for k, begin, end in zip(ranked.index, ranked["begin"], ranked["end"]):
        at = bisect_left(starts, begin)  # taken matches are apart, so only the neighbours can overlap
        if (at and ends[at - 1] > begin) or (at < len(starts) and starts[at] < end):
            continue
        starts.insert(at, begin)
        ends.insert(at, end)
        stay.append(k)
    return run.loc[sorted(stay)].drop(columns="run")


def scan_licenses(documents: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """Per document row: ``doc_id, matches``, an array of (start, end, license, aligned, coverage) in text order."""
    found = settle(passages(documents, templates, coverage), "passages")
    each = matches(found, templates, coverage).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "license", "aligned", "coverage"))).alias("matches"))
    each = settle(each, "matches")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    joined = rows.join(if_small(each), rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__text")), "left")
    empty = F.array().cast("array<struct<start:bigint,end:bigint,license:string,aligned:bigint,coverage:double>>")
    return joined.select("doc_id", F.coalesce("matches", empty).alias("matches"))
