"""Licence scan: a positional index of rare words finds template passages, and key phrases decide.

Words are runs of a-z, 0-9 and non-ASCII bytes of the text with A-Z lower-cased. Every template is a word sequence with
mandatory key phrases. The first pass counts, over all texts, how many hold each template word; from that every word
gets its inverse document frequency (one number per template word, whatever the corpus holds). Of each template only the
highest-IDF words are indexed, as (template, position in it): the fewest whose weight exceeds 1 - ``least`` of the whole,
so that any place with ``least`` of the weight holds one of them. In the second pass these words of a text name (template,
relative position) candidates, which are compared word by word there. A match counts once its key phrases stand in the
text. Base phrases are counted at every place where their words stand consecutively.

``score`` is the largest share of a template's IDF weight at a candidate's place (halved where the match does not count),
1 where a phrase of the base stands. Null and empty texts have no words, no labels and score 0. Equal rows get equal results; other
columns are not carried.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrain.llm.common import letters_and_digits, strings

# Phrases of the base with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Opening sentences of well-known licence notices: label, words, mandatory key phrases.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that", ("redistribution and use",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("copyright", "copyright c all rights reserved", ("copyright", "rights reserved")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license", "version 2")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@dataclass
class Index:
    """Templates and postings, ready for lookups inside tasks. Its size is that of the templates."""

    templates: list[tuple[str, list[bytes], list[list[bytes]]]]
    idf: dict[bytes, float]
    least: float
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    weight: list[float] = field(default_factory=list)

    def __post_init__(self):
        for t, (_, words, _keys) in enumerate(self.templates):
            self.weight.append(sum(self.idf[w] for w in words))
            rare, spare = set(), (1 - self.least) * self.weight[-1]
            for w in sorted(set(words), key=lambda w: (-self.idf[w], w)):
                if spare < 0:
                    break
                rare.add(w)
                spare -= self.idf[w] * words.count(w)
            for at, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((t, at))
        self.postings = dict(self.postings)


def parsed(templates=TEMPLATES):
    return [(label, words.encode().split(), [k.encode().split() for k in keys]) for label, words, keys in templates]


def document_counts(docs: DataFrame, words: set[bytes], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of texts, and of those that hold each of the given words."""

    def counts(batches):
        seen, n = Counter(), 0
        for b in batches:
            for s in strings(b.column(0)):
                n += 1
                seen.update(words.intersection(letters_and_digits(s.as_buffer().to_pybytes())))
        keys = [b""] + list(seen)
        yield pa.RecordBatch.from_pydict({"word": pa.array(keys, pa.binary()), "n": pa.array([n] + [seen[k] for k in keys[1:]], pa.int64())})

    rows = docs.select(text).mapInArrow(counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found.pop(b"", 0), found


def build_index(docs: DataFrame, templates=TEMPLATES, least: float = 0.75, text: str = "text") -> Index:
    t = parsed(templates)
    words = {w for _, ws, _ in t for w in ws}
    n, held = document_counts(docs, words, text)
    return Index(t, {w: math.log((1 + n) / (1 + held.get(w, 0))) + 1e-6 for w in words}, least)


def places(words: list[bytes], where: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
    """Starts of all places where the phrase's words stand consecutively, found through its least frequent word."""
    if any(w not in where for w in phrase):
        return []
    k = min(range(len(phrase)), key=lambda i: len(where[phrase[i]]))
    m = len(phrase)
    return [p - k for p in where[phrase[k]] if p >= k and words[p - k:p - k + m] == phrase]


def scan(words: list[bytes], index: Index, base, wanted: set[bytes]):
    """(base places, base labels, all labels, score) of one text."""
    if wanted.isdisjoint(words):
        return [], [], [], 0.0
    where: dict[bytes, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        if w in wanted:
            where[w].append(i)
    found, labels, score = [], set(), 0.0
    base_labels = set()
    for phrase, label in base:
        at = places(words, where, phrase)
        if at:
            found += at
            base_labels.add(label)
            score = 1.0
    candidates = {(t, p - at) for w in where if w in index.postings for t, at in index.postings[w] for p in where[w]}
    share: dict[int, float] = {}
    for t, offset in candidates:
        ws = index.templates[t][1]
        got = sum(index.idf[w] for i, w in enumerate(ws) if 0 <= offset + i < len(words) and words[offset + i] == w)
        share[t] = max(share.get(t, 0.0), got / index.weight[t])
    for t, part in share.items():
        label, _, keys = index.templates[t]
        if part >= index.least and all(places(words, where, k) for k in keys):
            labels.add(label)
            score = max(score, min(1.0, part))
        elif label not in labels:
            score = max(score, min(1.0, part) * 0.5)
    return found, sorted(base_labels), sorted(base_labels | labels), score


def license_scan(docs: DataFrame, base=BASE, templates=TEMPLATES, least: float = 0.75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text with counts of base places, labels and a score. A template matches at ``least`` of its IDF weight."""
    index = build_index(docs, templates, least, text)
    phrases = [(p.encode().split(), label) for p, label in base]
    wanted = set(index.idf) | {w for p, _ in phrases for w in p} | {w for _, _, ks in index.templates for k in ks for w in k}

    def run(batches):
        for b in batches:
            out = []
            for s in strings(b.column(1)):
                words = letters_and_digits(s.as_buffer().to_pybytes())
                at, base_labels, labels, score = scan(words, index, phrases, wanted)
                out.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(base_labels), ",".join(labels), score))
            cols = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, RESULT)
