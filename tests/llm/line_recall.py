"""Recall of line dedup: every 20th distinct line against all, with exact links by prefix filtering.

    python -m tests.llm.line_recall /root/testdata/sf0.1 [edits]

With `edits`, instead: copies of the table's lines with as many random edits of single characters as keep the similarity at
0.8 or more, the hardest links there are; the share of which a bucket is shared, by length.
"""

import collections
import math
import random
import sys

import pyarrow.parquet as pq

from lorekeep.llm.line_dedup import SHINGLE, line_bands


def grams(line):
    return frozenset(line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)) or frozenset([line])


def alike(a, b):
    common = len(a & b)
    return common >= 0.8 * (len(a) + len(b) - common)


def table_links(lines):
    sets = [grams(x) for x in lines]
    frequency = collections.Counter(g for s in sets for g in s)
    prefix = [sorted(s, key=lambda g: (frequency[g], g))[: len(s) - math.ceil(0.8 * len(s)) + 1] for s in sets]
    index = collections.defaultdict(list)
    for i, p in enumerate(prefix):
        for g in p:
            index[g].append(i)
    for i in range(0, len(lines), 20):
        for j in {j for g in prefix[i] for j in index[g] if j != i}:
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and alike(sets[i], sets[j]):
                yield lines[i], lines[j]


def edited_links(lines, seed=1):
    r = random.Random(seed)
    for line in lines:
        copy, whole = line, grams(line)
        for _ in range(60):
            at, cut = r.randrange(len(copy)), r.random()
            further = copy[:at] + ("" if cut < 0.3 else chr(97 + r.randrange(26))) + copy[at + (cut < 0.7) :]
            if not alike(whole, grams(further)):
                break
            copy = further
        if copy != line:
            yield line, copy


def main(folder, *more):
    texts = pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist()
    lines = sorted({x for t in texts for raw in (t or "").split("\n") if (x := raw.strip(" "))})
    pairs = list(edited_links(lines) if more else table_links(lines))
    found, missed = collections.Counter(), collections.Counter()
    for at in range(0, len(pairs), 1000):
        part = pairs[at : at + 1000]
        bands = line_bands([x for p in part for x in p])
        for i, (a, _) in enumerate(part):
            hit = set(bands[2 * i].tolist()) & set(bands[2 * i + 1].tolist())
            (found if hit else missed)[min(len(a) // 50 * 50, 200)] += 1
    print(f"{len(lines)} lines, {len(pairs)} links, {sum(found.values())} share a bucket")
    for k in sorted({*found, *missed}):
        print(f"from {k} characters: {found[k]} of {found[k] + missed[k]}")


if __name__ == "__main__":
    main(*sys.argv[1:])
