"""License scans with a positional rare-token index.

The index lists, for each licence word, at which places of which templates it stands. Of a file those of its licence words are
looked up that are rarest in all documents, for each template the rarest of its words that the file has. A place in the
file less a posting's place is where the template would start: the starts of several words are intersected, some words of
drift allowed, and where enough agree the template's mandatory phrases are verified word by word and the rest is measured.

A base phrase is a template of which each word must stand at its place. Templates of notices may differ in some words.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, plain_words, texts

#: Phrases and the labels they prove.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public licence notices, with their label and the phrases in them that must stand word by word.
NOTICES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ["the gnu general public license as published"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ["the gnu lesser general public license as published"]),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ["the gnu affero general public license as published"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["you may not use this file except in compliance with the license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", ["this source code form is subject to the terms of the"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission is hereby granted free of charge to any person obtaining a copy", "to deal in the software without restriction"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistribution and use in source and binary forms"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ["to alter it and redistribute it freely"]),
    ("bsl", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["free and unencumbered software released into the public domain"]),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is distributed without any warranty", ["dedicated all copyright and related and neighboring rights"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["licensed under the gnu general public license"]),
    ("lgpl", "released under the gnu lesser general public license", ["under the gnu lesser general public license"]),
    ("agpl", "released under the gnu affero general public license", ["under the gnu affero general public license"]),
    ("apache", "licensed under the apache license version 2 0", ["licensed under the apache license"]),
    ("mit", "released under the mit license", ["under the mit license"]),
    ("mpl", "licensed under the mozilla public license version 2 0", ["under the mozilla public license"]),
    ("cc-by-nc", "cc by nc", ["cc by nc"]),
    ("cc-by-sa", "cc by sa", ["cc by sa"]),
    ("cc0", "cc0 1 0 universal", ["cc0 1 0 universal"]),
]
#: How many words a notice's word may stand before or after its place, and the share of them that must stand so.
DRIFT, LEAST = 3, 0.6


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[tuple[int, list[bytes]]]  # place and words of each mandatory phrase
    drift: int
    base: bool
    needed: frozenset[bytes] = frozenset()  # the words of the mandatory phrases
    places: dict[bytes, list[int]] = field(default_factory=dict)
    by_rarity: list[bytes] = field(default_factory=list)  # its words, the rarest first


def _template(label: str, notice: str, phrases: list[str], drift: int, base: bool) -> Template:
    words, t = notice.encode().split(), Template(label, notice.encode().split(), [], drift, base)
    for phrase in phrases:
        own = phrase.encode().split()
        t.keys.append((next(i for i in range(len(words)) if words[i : i + len(own)] == own), own))
    t.needed = frozenset(w for _, own in t.keys for w in own)
    for place, w in enumerate(words):
        t.places.setdefault(w, []).append(place)
    return t


@dataclass
class Index:
    templates: list[Template]
    words: frozenset[bytes]  # all licence words
    idf: dict[bytes, float]


def build_index(docs: DataFrame, text_col: str = "text") -> Index:
    """Document frequencies of the licence words over all documents; the result has as many entries as there are licence words."""
    templates = [_template(label, phrase, [phrase], 0, True) for phrase, label in BASE.items()]
    templates += [_template(label, notice, phrases, DRIFT if len(notice.split()) > 12 else 0, False) for label, notice, phrases in NOTICES]
    vocabulary = frozenset(w for t in templates for w in t.words)

    def counts(batches):
        for b in batches:
            found: Counter = Counter()
            for t in b.column("t").to_pylist():
                found.update(vocabulary.intersection(plain_words(t)))
            found[b""] = b.num_rows  # how many documents
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    rows = texts(docs.withColumn("one", F.lit(0)), "one", text_col).select("t")
    summed = {bytes(r.word): r.n for r in rows.mapInArrow(counts, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = summed.pop(b"", 0)
    idf = {w: math.log((n + 1) / (summed.get(w, 0) + 0.5)) for w in vocabulary}
    for t in templates:
        t.by_rarity = sorted(t.places, key=lambda w: (-idf[w], w))
    return Index(templates, vocabulary, idf)


def looked_up(t: Template, here: set[bytes], rarest: int) -> list[bytes]:
    """The rarest licence words of a file that the template has; none if a mandatory word or too many others are missing."""
    if not t.needed <= here or sum(len(t.places[w]) for w in t.places.keys() & here) < LEAST * len(t.words):
        return []
    return [w for w in t.by_rarity if w in here][:rarest]


def enough(n: int) -> int:
    """How many of n looked-up words must agree on a start."""
    return min(n, max(2, -(-n // 2)))


def _starts(t: Template, own: list[bytes], at: dict[bytes, np.ndarray]) -> np.ndarray:
    """Where the template can start: enough of the looked-up words stand at their places after it, within its drift. Of starts
    in a row, the first of those with the most words at their very places."""
    near, exact = [], []
    for w in own:
        posts = np.unique(np.concatenate([at[w] - place for place in t.places[w]]))
        exact.append(posts)
        near.append(np.unique(np.concatenate([posts + d for d in range(-t.drift, t.drift + 1)])) if t.drift else posts)
    starts, n = np.unique(np.concatenate(near), return_counts=True)
    starts = starts[n >= (len(own) if t.base else enough(len(own)))]
    if not t.drift or not len(starts):
        return starts
    posts, n = np.unique(np.concatenate(exact), return_counts=True)
    votes = np.zeros(len(starts), np.int64)
    where = np.minimum(np.searchsorted(posts, starts), len(posts) - 1)
    votes[posts[where] == starts] = n[where][posts[where] == starts]
    row = np.cumsum(np.concatenate(([0], np.diff(starts) > 1)))
    best = np.lexsort((starts, -votes, row))
    return starts[best[np.unique(row[best], return_index=True)[1]]]


def verified(t: Template, words: list[bytes], start: int) -> float:
    """The share of the template's words that stand within its drift of their places; 0 if a mandatory phrase doesn't, or too few."""
    for place, own in t.keys:
        if not any(x >= 0 and words[x : x + len(own)] == own for x in range(start + place - t.drift, start + place + t.drift + 1)):
            return 0.0
    share = sum(w in words[max(0, start + i - t.drift) : max(0, start + i + t.drift + 1)] for i, w in enumerate(t.words)) / len(t.words)
    return share if share >= LEAST else 0.0


def find(words: list[bytes], index: Index, rarest: int = 8) -> list[tuple[int, int, float]]:
    """(template, start, agreement): every place of a base phrase, and the places where a notice is verified. A notice whose first words
    are cut off starts before the text, at a negative place."""
    here = index.words.intersection(words)
    if not here:
        return []
    asked = {k: own for k, t in enumerate(index.templates) if (own := looked_up(t, here, rarest))}
    if not asked:
        return []
    wanted = {w for own in asked.values() for w in own}
    places = defaultdict(list)
    for i, w in enumerate(words):
        if w in wanted:
            places[w].append(i)
    at = {w: np.array(x) for w, x in places.items()}
    found = ((k, int(start)) for k, own in asked.items() for start in _starts(index.templates[k], own, at))
    return [(k, start, share) for k, start in found if (share := verified(index.templates[k], words, start))]


def scan(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    n_base counts the places of all base phrases, first_word and last_word are the smallest and largest start among them,
    words counted from 0, else null. labels has the base labels and those of the notices that are verified: the mandatory
    phrases stand word by word and at least LEAST of the words stand, both within the drift. score: 1 where a base phrase
    stands, else the best agreement with a notice, 0 without any. places: (label, start, agreement) of each.
    Null texts count as empty: no words, no labels, score 0. Repeated rows give equal results, an empty table gives no
    rows, other columns are not read. Whole texts are scanned, however long.
    """
    rows = texts(docs, id_col, text_col)

    def scanned(batches):
        for b in batches:
            out = []
            for t in b.column("t").to_pylist():
                words = plain_words(t)
                found = [(index.templates[k], s, share) for k, s, share in find(words, index)]
                base = [s for t, s, _ in found if t.base]
                base_labels, labels = {t.label for t, _, _ in found if t.base}, {t.label for t, _, _ in found}
                score = 1.0 if base else max((share for _, _, share in found), default=0.0)
                places = [{"label": label, "start": s, "agreement": share} for s, label, share in sorted((s, t.label, share) for t, s, share in found)]
                out.append((len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, places))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("agreement", pa.float64())])))
            columns = zip(*out, strict=True) if out else ((),) * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"],
            )

    return rows.mapInArrow(
        scanned,
        f"doc_id {id_type(rows)}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "places array<struct<label: string, start: bigint, agreement: double>>",
    )
