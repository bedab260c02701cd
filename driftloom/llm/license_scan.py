"""License scans over a positional index of rare licence words.

The index holds each template's words with their positions. A word's rarity is its inverse document frequency over
all documents (a count for each licence word; as many rows as the templates have words). Each template's rarest
mandatory word is its anchor. Of a file, the licence words that are anchors are looked up, rarest first; an anchor at
position p of the file and q of the template proposes the alignment p - q. The postings of the other mandatory words are
intersected at that relative position; an alignment counts if its mandatory key phrase stands there and enough words agree. For the base phrases every word is mandatory, so that all places are found.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, documents, slices

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Sentences of licence texts and notices: label, template, mandatory key phrase. Words as the scan sees them.
SENTENCES = [
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "may be used to endorse or promote products"),
    ("cc0-1.0", "released under cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("creative-commons", "this work is licensed under a creative commons attribution license", "licensed under a creative commons"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("proprietary", "confidential and proprietary do not distribute", "confidential and proprietary"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim or modified copies of this license document"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors be held liable"),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "person or organization obtaining a copy of the software"),
]

#: Label, identifier and names of licences; notices that name them are made by the rule below.
NAMES = [
    ("agpl-3.0", "agpl 3 0", ("gnu affero general public license version 3", "gnu affero general public license v3")),
    ("apache-2.0", "apache 2 0", ("apache license version 2 0", "apache license 2 0", "apache 2 0 license")),
    ("artistic-2.0", "artistic 2 0", ("artistic license 2 0",)),
    ("boost-1.0", "bsl 1 0", ("boost software license", "boost software license version 1 0")),
    ("bsd-2-clause", "bsd 2 clause", ("2 clause bsd license", "simplified bsd license", "bsd 2 clause license")),
    ("bsd-3-clause", "bsd 3 clause", ("3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause license")),
    ("cc-by-4.0", "cc by 4 0", ("cc by 4 0", "creative commons attribution 4 0 international license")),
    ("cc-by-nc-4.0", "cc by nc 4 0", ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license")),
    ("cc-by-nd-4.0", "cc by nd 4 0", ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license")),
    ("cc-by-sa-4.0", "cc by sa 4 0", ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license")),
    ("cc0-1.0", "cc0 1 0", ("cc0 1 0 universal", "creative commons zero v1 0 universal")),
    ("cddl-1.0", "cddl 1 0", ("common development and distribution license",)),
    ("epl-1.0", "epl 1 0", ("eclipse public license v 1 0", "eclipse public license version 1 0")),
    ("epl-2.0", "epl 2 0", ("eclipse public license v 2 0", "eclipse public license version 2 0", "eclipse public license 2 0")),
    ("eupl-1.2", "eupl 1 2", ("european union public licence",)),
    ("gpl-2.0", "gpl 2 0", ("gnu general public license version 2", "gnu general public license v2", "gnu gpl v2", "gpl v2")),
    ("gpl-3.0", "gpl 3 0", ("gnu general public license version 3", "gnu general public license v3", "gnu gpl v3", "gpl v3")),
    ("isc", "isc", ("isc license",)),
    ("lgpl-2.1", "lgpl 2 1", ("gnu lesser general public license version 2 1",)),
    ("lgpl-3.0", "lgpl 3 0", ("gnu lesser general public license version 3",)),
    ("lgpl", "lgpl", ("gnu lesser general public license", "gnu library general public license")),
    ("mit", "mit", ("mit license",)),
    ("mpl-2.0", "mpl 2 0", ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0")),
    ("ms-pl", "ms pl", ("microsoft public license",)),
    ("ofl-1.1", "ofl 1 1", ("sil open font license",)),
    ("postgresql", "postgresql", ("postgresql license",)),
    ("psf-2.0", "psf 2 0", ("python software foundation license",)),
    ("unlicense", "unlicense", ("unlicense",)),
    ("upl-1.0", "upl 1 0", ("universal permissive license",)),
    ("wtfpl", "wtfpl", ("do what the fuck you want to public license",)),
    ("zlib", "zlib", ("zlib license",)),
]
GRANTS = ("licensed under", "released under", "distributed under", "available under", "under the terms of", "subject to the terms of", "covered by")
LONG = 4  # words from which on a licence's name alone says so


def templates() -> list[tuple[str, str, str]]:
    """Label, template, mandatory key phrase. A short name alone may stand in any prose, so it counts behind words that grant
    ("released under the mit license"), in an identifier's line or as a heading's "license mit"; long names count alone."""
    out = list(SENTENCES)
    for label, identifier, names in NAMES:
        out.append((label, f"spdx license identifier {identifier}", f"spdx license identifier {identifier}"))
        for name in names:
            for grant in GRANTS:
                for the in ("", "the "):
                    out.append((label, f"{grant} {the}{name}", f"{grant} {the}{name}"))
            if len(name.split()) >= LONG or name in ("boost software license",):
                out.append((label, name, name))
    return out


TEMPLATES = templates()


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class RareWordIndex:
    """Postings word -> (template, position) of each template's rarest mandatory word, its anchor."""

    def __init__(self, idf: dict[bytes, float], least_cover: float = 0.5):
        self.entries: list[tuple[str, list[bytes], list[int], bool]] = []
        for phrase, label in BASE.items():
            words = phrase.encode().split()
            self.entries.append((label, words, list(range(len(words))), True))
        for label, template, key in TEMPLATES:
            words, must = template.encode().split(), key.encode().split()
            at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
            self.entries.append((label, words, list(range(at, at + len(must))), False))
        self.least, self.idf = least_cover, idf
        self.highest = max(idf.values(), default=1.0) or 1.0
        rarity = lambda w: idf.get(w, math.inf)
        self.anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needs: list[frozenset[bytes]] = []
        for e, (_, words, must, _) in enumerate(self.entries):
            rarest = max(must, key=lambda i: rarity(words[i]))
            self.anchors[words[rarest]].append((e, rarest))
            self.needs.append(frozenset(words[i] for i in must))
        self.rarest_first = sorted(self.anchors, key=lambda w: (-rarity(w), w))
        self.vocabulary = frozenset(w for e in self.entries for w in e[1])
        self.weights = [[min(idf.get(w, self.highest), self.highest) + 0.01 for w in e[1]] for e in self.entries]
        self.sure = frozenset(self.anchors)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], set[str], float]:
        """All places of base phrases (start, label), labels of the templates, and the best cover by rarity."""
        present = self.vocabulary.intersection(words)
        if not self.sure & present:
            return [], set(), 0.0
        postings: dict[bytes, set[int]] = defaultdict(set)
        for p, w in enumerate(words):
            if w in present:
                postings[w].add(p)
        places, found, best = [], set(), 0.0
        for anchor in self.rarest_first:
            for e, q in self.anchors[anchor] if anchor in present else ():
                if not self.needs[e] <= present:
                    continue
                label, template, must, base = self.entries[e]
                starts = {p - q for p in postings[anchor]}
                for i in must:  # the postings of the key phrase's words, at their places relative to the anchor's
                    if i != q:
                        there = postings[template[i]]
                        starts = {s for s in starts if s + i in there}
                        if not starts:
                            break
                if base:
                    places += [(s, label) for s in starts]
                    best = max(best, 0.5) if starts else best
                    continue
                weights = self.weights[e]
                for s in starts:
                    cover = sum(x for i, x in enumerate(weights) if template[i] in present and s + i in postings[template[i]]) / sum(weights)
                    if cover >= self.least:
                        found.add(label)
                        best = max(best, cover)
        return places, found, min(1.0, best)


def licence_vocabulary() -> list[bytes]:
    return sorted({w for t in [*BASE, *(t for _, t, _ in TEMPLATES)] for w in t.encode().split()})


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and how many hold each licence word. The result has a row for each word of the
    fixed templates (some 200) whatever the input."""
    vocabulary = licence_vocabulary()
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(vocabulary)}
        every, n, rows = frozenset(vocabulary), [0] * len(vocabulary), 0
        for batch in slices(batches):
            for text in as_bytes(batch, "text"):
                for w in every.intersection(words_of(text)):
                    n[number[w]] += 1
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(n))], pa.int32()), pa.array([rows, *n], pa.int64())], schema=schema)

    got = {r.word: r.n for r in documents(docs).select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.pop(-1, 0), {vocabulary[i]: n for i, n in got.items()}


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_licenses(docs: DataFrame, least_cover: float = 0.5) -> DataFrame:
    """Returns one row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts are empty. A text without words or places has counts of 0, null positions, empty labels and score 0.
    Repeated rows each get their row; overlapping places all count, and so do ties. Very long texts are read whole. least_cover is the rarity-weighted part of a
    template that must agree beside its key phrase."""
    n, df = document_frequencies(docs)
    idf = {w: math.log((n + 1) / (k + 1)) for w, k in df.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RareWordIndex(idf, least_cover)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch, "text"), strict=True):
                words = words_of(text)
                places, found, score = index.scan(words)
                starts, base = [s for s, _ in places], {x for _, x in places}
                rows.append((doc, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RESULT.types, strict=True)], schema=RESULT)

    return documents(docs).mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
