"""License scan by a positional index of rare licence words.

Each template notice is a list of words. The index maps a licence word to its postings (template, position).
A first pass counts in how many documents each licence word occurs; the second looks up all of a file's licence
words, those of highest IDF first, and intersects their postings by relative position: an occurrence at p of a word
at q votes for a start at p - q, and a start goes on only if so many of the template's postings vote for it that
enough of its words can stand there. It is accepted if they do, and if the template's mandatory key phrases follow
one another inside the span.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import in_arrow, texts
from gapwise.llm.licence_texts import WHOLE

#: Base phrases and their labels (fixed by the contract of the query).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices: label, text, mandatory key phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files to deal in the software without restriction",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("gpl", "licensed under the gnu general public license version 3", ["general public license"]),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation",
        ["free software", "general public license"],
    ),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license version 3", ["affero general public license"]),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    ("bsd", "licensed under the bsd 3 clause license", ["bsd 3 clause"]),
    ("bsd", "licensed under the bsd 2 clause license", ["bsd 2 clause"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("epl", "made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("bsl", "distributed under the boost software license version 1 0", ["boost software license"]),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for "
        "any damages arising from the use of this software",
        ["without any express or implied warranty"],
    ),
]

#: Words too general to point at a licence; they are not in the index.
GENERAL = frozenset(
    "a above action all an and any anyone are as at author authors be being benefit but by can caused charge claim code commercial conditions copies copy data deal display do event files following for form free freely from future "
    "general goods has held hope how however in included including into is it its large law laws list loss made make may means met more must name names no not notice of on one or org original other our out part person persons "
    "portions present product products profits program provided public purpose reproduce required rights see sell services shall so software solely source special specific statement strict subject such terms that the theory third "
    "this to under unless use used useful versions way we which whole will with without work works would written www wrote http https you your 0 1 2 3 4".split()
)

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case."""
    return text.translate(_FOLD).split()


class LicenseIndex:
    """Postings of the templates' rare words."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [x[0] for x in templates]
        self.words = [words_of(x[1].encode()) for x in templates]
        self.keys = [[k.encode().split() for k in x[2]] for x in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            for q, w in enumerate(words):
                if w.decode() not in GENERAL:
                    self.postings[w].append((t, q))
        self.postings = dict(self.postings)
        self.vocabulary = frozenset(self.postings)
        #: Postings of each template.
        self.rare = [sum(w in self.vocabulary for w in words) for words in self.words]


def places(words: list[bytes], phrase: list[bytes], where: dict[bytes, list[int]], lo: int = 0, hi: int | None = None) -> list[int]:
    """Starts of a phrase in ``words[lo:hi]``. where: the places of its last word."""
    n, hi = len(phrase), len(words) if hi is None else hi
    return [p - n + 1 for p in where.get(phrase[-1], ()) if lo <= p - n + 1 and p < hi and words[p - n + 1 : p + 1] == phrase]


def agreeing(lists: list[np.ndarray], slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts that postings vote for, and how many postings vote for each within ``slack`` words. lists: sorted votes of each posting."""
    starts = np.unique(np.concatenate(lists))
    votes = np.zeros(len(starts), np.int64)
    for own in lists:
        votes += np.searchsorted(own, starts + slack, "right") > np.searchsorted(own, starts - slack, "left")
    return starts, votes


def match(words: list[bytes], index: LicenseIndex, idf: dict[bytes, float], slack: int, least: float) -> list[tuple[str, float, int]]:
    """(label, share of the template's words found in place, start) of every accepted template, the best start of each (of ties the first)."""
    where: dict[bytes, list[int]] = defaultdict(list)
    for p, w in enumerate(words):
        if w in index.vocabulary:
            where[w].append(p)
    votes: dict[int, list[np.ndarray]] = defaultdict(list)
    for w in sorted(where, key=lambda w: (-idf.get(w, 0.0), w)):
        at = np.array(where[w])
        for t, q in index.postings[w]:
            votes[t].append(at - q)
    out = []
    for t, lists in votes.items():
        body = index.words[t]
        # of all words (1 - least) may be missing, so no more of the rare ones
        need = max(1, index.rare[t] - math.floor((1 - least) * len(body) + 1e-9))
        if len(lists) < need:
            continue
        starts, n = agreeing(lists, slack)
        starts, n = starts[n >= need], n[n >= need]
        best, tails = (0.0, 0), {k[-1] for k in index.keys[t]}
        for start in starts[np.argsort(-n, kind="stable")].tolist():
            lo, hi = max(0, start - slack), min(len(words), start + len(body) + slack)
            span = {w: [p for p in range(lo, hi) if words[p] == w] for w in tails}
            if not all(places(words, k, span, lo, hi) for k in index.keys[t]):
                continue
            hit = sum(w in words[max(0, start + i - slack) : start + i + slack + 1] for i, w in enumerate(body) if start + i + slack >= 0)
            best = max(best, (hit / len(body), -start))
        if best[0] >= least:
            out.append((index.labels[t], best[0], -best[1]))
    return out


def document_frequency(docs: DataFrame, index: LicenseIndex) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those that hold each licence word. What reaches the driver is bounded by the templates' vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            df[b""] += batch.num_rows
            for text in texts(batch.column(0)):
                for w in index.vocabulary.intersection(words_of(text)):
                    df[w] += 1
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in df], "n": pa.array(df.values(), pa.int64())})

    rows = docs.select("text").transform(in_arrow, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"].encode(): r["n"] for r in rows}
    return df.pop(b"", 0), df


def license_scan(docs: DataFrame, templates=(*TEMPLATES, *WHOLE), slack: int = 2, least: float = 0.7) -> DataFrame:
    """One row per document: its licence labels, base phrases and best template score.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_templates. A null or empty text has
    no words, empty labels and score 0; texts of any length are scanned whole; repeated rows are scanned each; of a
    template's starts the best counts, of ties the first; an empty table gives an empty result; further columns are
    ignored. A base phrase that no template confirms scores 0.5. slack: words by which a template word may be out of
    place. least: share of the template's words needed.
    """
    index = LicenseIndex(templates)
    total, df = document_frequency(docs, index)
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) for w in index.vocabulary}
    base = [(p.encode().split(), label) for p, label in BASE.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts(batch.column(1)):
                words = words_of(text)
                found = set(index.vocabulary.intersection(words))
                starts, labels, hits = [], set(), []
                if found:
                    if b"license" in found:
                        where = {b"license": [p for p, w in enumerate(words) if w == b"license"]}
                        for phrase, label in base:
                            if at := places(words, phrase, where):
                                starts += at
                                labels.add(label)
                    hits = match(words, index, idf, slack, least)
                score = max([x[1] for x in hits] + [0.5 * bool(starts)])
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in hits})), score, len(hits)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_templates"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(in_arrow, scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long")
