"""License scans with a positional rare-token index."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import textbytes as tb

#: Words of these phrases standing consecutively are base places; (phrase, label).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (label, template, mandatory key phrases).  Templates are the customary notices by which a work names its licence, and the
#: telling paragraphs of licence bodies, each placed on its own, so that insertions between paragraphs don't matter.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "conditions are met")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "hereby granted")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice", "substantial portions")),
    ("mit", "spdx license identifier mit", ("identifier mit",)),
    ("apache-2.0", "spdx license identifier apache 2 0", ("identifier apache 2 0",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code", "list of conditions")),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", ("redistributions in binary form", "list of conditions")),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("names of its contributors", "endorse or promote")),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause", ("identifier bsd 3 clause",)),
    ("gpl-3.0", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    ("gpl-2.0", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    ("gpl-3.0", "spdx license identifier gpl 3 0", ("identifier gpl 3 0",)),
    ("gpl-2.0", "spdx license identifier gpl 2 0", ("identifier gpl 2 0",)),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl-3.0", "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("permission is granted to anyone", "redistribute it freely")),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization", "covered by this license")),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("commons attribution 4 0",)),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike 4 0",)),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial 4 0",)),
    ("cc-by-nd-4.0", "licensed under a creative commons attribution noderivatives 4 0 international license", ("attribution noderivatives 4 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)
#: Each template is indexed by so many of its rarest words.
RARE_WORDS = 4
#: A placed template is accepted if this part of its words stand where they should.
MIN_MATCH = 0.6
_CHUNK = 1 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Index:
    words: np.ndarray  # hash of each vocabulary word, sorted
    templates: list[np.ndarray]  # vocabulary numbers
    keys: list[list[np.ndarray]]
    postings: dict[int, list[tuple[int, int]]]  # index word -> (template, position)
    idf: np.ndarray


def _vocabulary() -> list[str]:
    return sorted({w for _, t, keys in TEMPLATES for x in (t, *keys) for w in x.split()}, key=tb.hash_one)


def build_index(frequency: dict[str, int], n_docs: int) -> Index:
    """Postings of each template's RARE_WORDS rarest words, by the documents' own counts."""
    vocabulary = _vocabulary()
    number = {w: i for i, w in enumerate(vocabulary)}
    idf = np.array([np.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for w in vocabulary])
    templates = [np.array([number[w] for w in t.split()]) for _, t, _ in TEMPLATES]
    keys = [[np.array([number[w] for w in k.split()]) for k in ks] for _, _, ks in TEMPLATES]
    postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for t, words in enumerate(templates):
        for w in sorted(set(words.tolist()), key=lambda w: (-idf[w], w))[:RARE_WORDS]:
            postings[w] += [(t, int(p)) for p in np.flatnonzero(words == w)]
    return Index(np.array([tb.hash_one(w) for w in vocabulary], np.uint64), templates, keys, dict(postings), idf)


def _runs(texts: pd.Series) -> Iterator[list[str]]:
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= _CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, concatenated; where each text's words begin, with the end as last element."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    raw = np.frombuffer(b"\n".join(parts), np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    starts, ends = tb.word_bounds(raw, tb.ALNUM)
    h = tb.word_hashes(tb.LOWER[raw], starts, ends)
    return h, np.append(np.searchsorted(starts, begins), starts.size)


def _number(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Number of each word in the sorted vocabulary, -1 if it isn't there."""
    gate = np.zeros(1 << 16, bool)
    gate[(words & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = np.full(h.size, -1, np.int32)
    maybe = np.flatnonzero(gate[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(words, h[maybe]), words.size - 1)
    hit = words[at] == h[maybe]
    out[maybe[hit]] = at[hit]
    return out


def _frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    vocabulary = _vocabulary()
    words = np.array([tb.hash_one(w) for w in vocabulary], np.uint64)
    counts, n = np.zeros(len(vocabulary), np.int64), 0
    for batch in batches:
        for run in _runs(batch["text"]):
            h, bounds = _words(run)
            v = _number(h, words)
            at = np.flatnonzero(v >= 0)
            owner = np.searchsorted(bounds, at, side="right") - 1
            counts += np.bincount(np.unique(owner * len(vocabulary) + v[at]) % len(vocabulary), minlength=len(vocabulary))
            n += len(run)
    yield pd.DataFrame({"word": [*vocabulary, ""], "n": [*counts.tolist(), n]})


def _follows(v: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Positions where the phrase's words stand consecutively."""
    n = v.size - phrase.size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(v[:n] == phrase[0])
    for i in range(1, phrase.size):
        at = at[v[at + i] == phrase[i]]
    return at


def _place(v: np.ndarray, index: Index) -> tuple[set[str], float]:
    """Labels of the templates placed in one document (vocabulary numbers by position), and the best match."""
    present = [w for w in np.unique(v).tolist() if w in index.postings]
    votes: dict[tuple[int, int], int] = defaultdict(int)
    for w in present:  # at most RARE_WORDS a template, and each may hold the only votes of one
        for at in np.flatnonzero(v == w).tolist():
            for t, p in index.postings[w]:
                votes[t, at - p] += 1
    labels: set[str] = set()
    best = 0.0
    for (t, start), n in votes.items():
        words = index.templates[t]
        if n < min(2, words.size):
            continue
        lo, hi = max(0, start), min(v.size, start + words.size)
        matched = float(np.count_nonzero(v[lo:hi] == words[lo - start : hi - start])) / words.size
        if matched >= MIN_MATCH and all(_follows(v[max(0, start - 2) : start + words.size + 2], k).size for k in index.keys[t]):
            labels.add(TEMPLATES[t][0])
            best = max(best, matched)
    return labels, best


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays), score.

    A first scan counts in how many documents each licence word occurs (one row per task and word of a fixed
    vocabulary), which gives the IDF.  The second looks up every index word of a text, lets their postings vote for
    (template, start) alignments, and verifies an alignment: at least 60 % of the template's words in place, and every
    mandatory key phrase there word for word.  Base places are the three fixed phrases, wherever their words stand
    consecutively.  The score is 1 with a base place, else the best verified match, else 0.

    Null text counts as empty and has no words; very long texts are scanned whole, about a MB at a time; repeated rows get equal
    results; alignments that tie all count; a null id is kept; an empty table gives an empty result; other columns are
    never read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))  # ids pass pandas as strings: exact, nulls too
    counted = texts.select("text").mapInPandas(_frequency, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = {r["word"]: r["n"] for r in counted}
    index = build_index(frequency, frequency.get("", 0))
    shared = docs.sparkSession.sparkContext.broadcast(index)  # a few KB: the templates are fixed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        phrases = [(np.array([tb.hash_one(w) for w in p.split()], np.uint64), label) for p, label in BASE]
        telling = np.zeros(index.words.size + 1, bool)
        telling[list(index.postings)] = True
        for batch in batches:
            rows = []
            for part in _runs(batch["text"]):
                h, bounds = _words(part)
                v = _number(h, index.words)
                places: dict[int, list[tuple[int, str]]] = defaultdict(list)
                for phrase, label in phrases:
                    at = _follows(h, phrase)
                    owner = np.searchsorted(bounds, at, side="right") - 1
                    inside = at + phrase.size <= bounds[owner + 1]
                    for a, o in zip(at[inside].tolist(), owner[inside].tolist()):
                        places[o].append((a - int(bounds[o]), label))
                at = np.flatnonzero(telling[v])
                hinted, hints = np.unique(np.searchsorted(bounds, at, side="right") - 1, return_counts=True)
                placed = {o: _place(v[bounds[o] : bounds[o + 1]], index) for o in hinted[hints >= 2].tolist()}
                for o in range(len(part)):
                    base = places.get(o, [])
                    own, best = placed.get(o, (set(), 0.0))
                    base_labels = sorted({label for _, label in base})
                    where = [a for a, _ in base]
                    rows.append(
                        (int(bounds[o + 1] - bounds[o]), len(base), min(where, default=None), max(where, default=None), base_labels, sorted({*base_labels, *own}), 1.0 if base else best)
                    )
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    schema = "doc_id string, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double"
    return texts.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
