"""License scan with a positional index of rare words.

Templates are licence notices.  The index holds every word of every template with its places, and each word is
weighted by inverse document frequency over the corpus.  For each file and template the ``LOOKED_UP`` rarest words that
both have are looked up: an occurrence at word w of the file and place p of the template proposes the offset w - p.  The
posting lists are intersected by relative position: an offset stays if two of the words propose it (one, where the file
has only one).  There the template's mandatory key phrase must stand in full, and the share of the template's
weight that stands in place is the score.

Two conditions that any match fulfils spare most files the look-up: the file has all words of the key phrase, and the
words it has weigh ``MIN_SCORE`` of the template (or all of it, for the exact ``BASE`` phrases).  A base phrase is
a template that is nothing but its key phrase; all its places are found, because there each of its words proposes the offset.

One pass counts document frequencies of the template words (a bounded vocabulary);
a second one scans.  Both are row by row with built-in expressions, without a shuffle of
texts.  Nulls and empty texts have no words, labels or places and the score 0.  Other columns
are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

#: Label of a base phrase.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Fixed values, notices as licences give them: label, notice, mandatory phrase of the notice.
TEMPLATES = (
    ("mit", "Released under the MIT license", "under the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
     "Permission is hereby granted, free of charge"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software.",
     "without restriction, including without limitation the rights to use, copy, modify"),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "Apache License, Version 2"),
    ("apache-2", "Licensed under Apache 2.0", "Apache 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
     "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
     "you may not use this file except in compliance with the License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "CC BY-NC"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "CC BY-SA"),
    ("cc-by", "Licensed under the Creative Commons Attribution license", "Creative Commons Attribution"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication", "Public Domain Dedication"),
    ("gpl", "is licensed under the GNU General Public License version 3", "GNU General Public License"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
     "under the terms of the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License", "GNU Lesser General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
     "under the terms of the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License", "GNU Affero General Public License"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
     "under the terms of the GNU Affero General Public License"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, version 2.0", "Mozilla Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted",
     "Redistribution and use in source and binary forms"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
     "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
     "Redistributions of source code must retain the above copyright notice"),
    ("bsd", "licensed under the BSD license", "under the BSD license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose",
     "Permission to use, copy, modify, and/or distribute"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies.",
     "for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "free and unencumbered software"),
    ("all-rights-reserved", "All rights reserved", "All rights reserved"),
)
MIN_SCORE = 0.6
#: Words that a file and a template share and whose postings are intersected; a fixed value of the method.
LOOKED_UP = 4
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(notice: str) -> list[str]:
    return [w for w in re.split(BREAK, notice.lower()) if w]


def license_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and anything beyond ASCII."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, BREAK), "")


def vocabulary() -> list[str]:
    return sorted({w for text in (*(n for _, n, _ in TEMPLATES), *BASE) for w in _words(text)})


def inverse_frequencies(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the word)) of every template word, over all rows."""
    known = F.array(*[F.lit(w) for w in vocabulary()])
    found = docs.select(F.explode(F.concat(
        F.array(F.lit("")), F.array_intersect(license_words(F.col(f"`{text}`")), known))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = counts.get("", 0)
    return {w: math.log(1 + (1 + rows) / (1 + counts.get(w, 0))) for w in vocabulary()}  # positive for any table


def _literals(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(values: Column, word: Column) -> Column:
    """Where a word stands in an array of words."""
    return F.filter(F.transform(values, lambda x, i: F.when(x == word, i)), lambda i: i.isNotNull())


def _offsets(notice: list[str], phrase: list[str], idf: dict[str, float], least: float) -> Column:
    """Offsets of a template in `words` that its postings propose and where its key phrase stands.

    `known` are the file's licence words, the rarest first.
    """
    start = next(k for k in range(len(notice)) if notice[k:k + len(phrase)] == phrase)
    own = sorted(set(notice), key=lambda w: (-idf[w], w))
    weight = sum(idf[w] for w in notice)
    shares = _literals([idf[w] * notice.count(w) / weight for w in own])
    shared = F.array_intersect(F.col("known"), _literals(own))
    there = F.zip_with(_literals(own), shares, lambda w, share: F.when(F.array_contains(shared, w), share).otherwise(0.0))
    possible = (F.size(F.array_except(_literals(sorted(set(phrase))), F.col("known"))) == 0) & (
        F.aggregate(there, F.lit(0.0), lambda total, share: total + share) >= least - 1e-9)

    looked_up = F.slice(shared, 1, LOOKED_UP)

    def proposed(word: Column) -> Column:
        """Offsets by the places of a word in the file and in the template, each once."""
        return F.array_distinct(F.flatten(F.transform(
            _places(F.col("words"), word), lambda i: F.transform(_places(_literals(notice), word), lambda p: i - p))))

    lists = F.array_sort(F.flatten(F.transform(looked_up, proposed)))
    agreed = F.transform(
        F.array(F.struct(lists.alias("all"), F.least(F.size(looked_up), F.lit(2)).alias("need"))),
        lambda found: F.filter(found["all"], lambda o, i: (F.get(found["all"], i + found["need"] - 1) == o)
                               & ((i == 0) | (F.get(found["all"], i - 1) != o))))[0]
    stands = F.filter(agreed, lambda o: (o + start >= 0) & (
        F.slice("words", F.greatest(o + start, F.lit(0)) + 1, len(phrase)) == _literals(phrase)))
    return F.when(possible, stands).otherwise(F.array().cast("array<int>"))


def _best_score(offsets: Column, notice: list[str], idf: dict[str, float]) -> Column:
    """The largest share of a template's weight that stands in place at one of the offsets."""
    weight = sum(idf[w] for w in notice)
    template = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(idf[w] / weight).alias("share")) for w in notice])

    def score(offset: Column) -> Column:
        present = F.transform(template, lambda t, k: F.when(F.get("words", offset + k) == t["word"], t["share"]).otherwise(0.0))
        return F.least(F.aggregate(present, F.lit(0.0), lambda total, share: total + share), F.lit(1.0))
    return F.coalesce(F.array_max(F.transform(offsets, score)), F.lit(0.0))


def scan(docs: DataFrame, text: str = "text", own: list[str] | None = None) -> DataFrame:
    """The columns ``own`` of ``docs`` and n_words, n_base, first_word, last_word, base_labels, labels, score."""
    idf = inverse_frequencies(docs, text)
    kept = [c for c in docs.columns if c != text] if own is None else own
    by_rarity = sorted(vocabulary(), key=lambda w: (-idf[w], w))

    phrases = [(_words(p), label) for p, label in BASE.items()]
    notices = [(_words(n), _words(m), label) for label, n, m in TEMPLATES]

    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"),
                       license_words(F.col(f"`{text}`")).alias("words"))
    read = read.select("own", "words", F.size("words").cast("long").alias("n_words"),
                       F.array_intersect(_literals(by_rarity), F.col("words")).alias("known"))
    found = read.select(
        "own", "words", "n_words",
        *[_offsets(words, words, idf, 1.0).alias(f"base{k}") for k, (words, _) in enumerate(phrases)],
        *[_offsets(notice, phrase, idf, MIN_SCORE).alias(f"at{k}") for k, (notice, phrase, _) in enumerate(notices)])
    step = found.select(
        "own", "n_words", *[f"base{k}" for k in range(len(phrases))],
        *[_best_score(F.col(f"at{k}"), notice, idf).alias(f"score{k}") for k, (notice, _, _) in enumerate(notices)])

    places = F.concat(*[F.col(f"base{k}") for k in range(len(phrases))])
    base_labels = F.array(*[F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)])
    more = F.array(*[F.when(F.col(f"score{k}") >= MIN_SCORE, F.lit(label)) for k, (_, _, label) in enumerate(notices)])

    def joined(values: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull()))), ",")

    return step.select(
        "own", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, more)).alias("labels"),
        F.round(F.greatest(*[F.col(f"score{k}") for k in range(len(notices))]), 9).alias("score"))
