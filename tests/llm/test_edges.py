"""Nulls, long texts, ties, repeated rows, empty tables and clashing names; brute-force versions of what SQL can't express."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import licenses, mixing, pii, sharding, toxicity, warc
from lorekeep.llm.buckets import crossing_cells
from lorekeep.llm.common import counted_bytes, fresh
from lorekeep.llm.decontamination import contamination
from lorekeep.llm.exact_dedup import exact_dedup
from lorekeep.llm.line_dedup import drop_repeated_lines, line_components
from lorekeep.llm.near_dedup import keep_one, near_duplicates

from . import brute
from .conftest import SCHEMA, frame
from .test_operators import rows


def chain(*values):
    """Spark's xxhash64 of 32-bit ints, longs (given as ("long", x)) and texts."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else int(v[1]).to_bytes(8, "little", signed=True) if isinstance(v, tuple) else int(v).to_bytes(4, "little", signed=True)
        h = xxhash.xxh64(raw, seed=h % (1 << 64)).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


def test_mix_against_brute_force(spark, prose):
    """Weights in closed form, every document's place in every epoch of its source's permutation, ties and long texts included."""
    docs = [(i, prose(30 + i % 50, i), ("big", "mid", "small")[0 if i < 250 else 1 if i < 380 else 2]) for i in range(400)]
    docs += [(400, prose(30_000, 3), "mid"), (401, None, None), (402, "", None), (7, docs[7][1], "big"), (7, "another text of one id", "big")]
    tokens = [(i, s, len((t or "").split(" ")) + 1) for i, t, s in docs]
    total, per = sum(n for _, _, n in tokens), Counter()
    for _, s, n in tokens:
        per[s] += n
    share = {s: n / total for s, n in per.items()}
    a = max(0.0, 1 - math.log(2) / math.log(max(share.values()) / min(share.values())))
    z = sum(x**a for x in share.values())
    budget = total * z * max(x ** (1 - a) for x in share.values())
    expected = []
    for s, n in per.items():
        weight = share[s] ** a / z
        quota = max(round(weight * budget, 3), n)
        for epoch in range(max(1, math.ceil(quota / n))):
            at = 0
            for _, i, k in sorted((chain(mixing.SEED, epoch, ("long", i)), i, k) for i, of, k in tokens if of == s):
                if epoch * n + at < quota:
                    expected.append((i, s, epoch, k, epoch * n + at, (epoch * n + at) // 500))
                at += k
    got = mixing.mix(frame(spark, docs), 2.0, block_tokens=500)
    assert rows(got.select("doc_id", "source", "epoch", "tokens", "start", "block")) == sorted(expected, key=str)
    weights = {r["source"]: r["weight"] for r in got.select("source", "weight").distinct().collect()}
    assert all(abs(weights[s] - share[s] ** a / z) < 1e-6 for s in share)
    copies = Counter((r["doc_id"], r["text"]) for r in mixing.mix_rows(frame(spark, docs), 2.0).collect())
    reads = Counter(x[0] for x in expected)
    assert all(sum(n for (d, _), n in copies.items() if d == i) == reads[i] for i in reads) and sum(copies.values()) == len(expected)
    assert mixing.mix(frame(spark, docs).drop("source")).select("source").distinct().collect()[0][0] is None


def test_shard_against_brute_force(spark, prose):
    """The same tree over all points at once, with exact cuts."""
    docs = [(i, prose(20 + i * 7 % 300, i), f"s{i % 3 if i % 2 else 0}") for i in range(500)] + [(1000 + i, "copy of one text") for i in range(40)] + [(2000, None), (2001, ""), (2002, prose(4000, 1))]
    docs = [(i, t, *(s or ("s0",))) for i, t, *s in docs]
    bits = lambda x: chain(x) & sharding.CODE_MAX
    points, lo_id, hi_id = {}, min(d[0] for d in docs), max(d[0] for d in docs)
    for i, t, s in docs:
        size = len((t or "").encode()) + 8
        p = points.setdefault((chain(t or ""), size), {"w": 0, "ids": [], "cats": [[], []]})
        p["w"] += size
        p["ids"].append(i)
        p["cats"][0].append(bits(s))
        p["cats"][1].append(bits("en"))
    table = []
    for (h, size), p in points.items():
        tie = (h ^ chain(0)) & sharding.TIE_MASK
        codes = [math.floor(math.log2(size) * (sharding.CODE_MAX / 64)), math.floor((min(p["ids"]) - lo_id) / float(hi_id - lo_id) * sharding.CODE_MAX), min(p["cats"][0]), min(p["cats"][1])]
        table.append(([(c << sharding.TIE_BITS) + tie for c in codes], p["w"], p["ids"]))
    wide = [max(1, max(x[0][d] >> sharding.TIE_BITS for x in table) - min(x[0][d] >> sharding.TIE_BITS for x in table)) for d in range(4)]
    placed = {}

    def grow(part, leaves, first):
        if leaves == 1:
            placed.update({i: first for _, _, ids in part for i in ids})
            return
        spread = [(max(x[0][d] >> sharding.TIE_BITS for x in part) - min(x[0][d] >> sharding.TIE_BITS for x in part)) / wide[d] for d in range(4)]
        d = spread.index(max(spread))
        part = sorted(part, key=lambda x: x[0][d])
        goal = sum(x[1] for x in part) * (leaves // 2) / leaves
        below, k = 0, 0
        while below + part[k][1] < goal:
            below += part[k][1]
            k += 1
        if below + part[k][1] - goal < goal - below:
            k += 1
        grow(part[:k], leaves // 2, first)
        grow(part[k:], leaves - leaves // 2, first + leaves // 2)

    grow(table, 8, 0)
    out = sharding.shard(frame(spark, docs), 8, group_share=1.0).toPandas()
    assert dict(zip(out["doc_id"], out["shard"])) == placed


def test_shard_string_ids_and_texts(spark, prose):
    docs = frame(spark, [(i, prose(20 + i % 90, i)) for i in range(200)] + [(None, "x"), (300, "x" * 100_000)]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    placed = sharding.shard(docs, 4)
    assert placed.select("doc_id").distinct().count() == 202 and dict(placed.dtypes)["doc_id"] == "string"
    again = placed.withColumn("copy", F.lit(0)).unionByName(placed.where("doc_id = 'd3'").withColumn("copy", F.lit(1)))
    whole = sharding.shard_texts(docs.withColumn("shard", F.lit("mine")), again)
    assert whole.count() == 203 and {"shard", "shard_", "slot", "copy", "text"} <= set(whole.columns) and whole.where("doc_id is null").count() == 1


def test_toxicity_features_are_the_grams_within_words():
    text = "Zu viel Lärm, viel-zu viel"
    plain = "".join(c if c.isalnum() else " " for c in text.lower())
    padded, grams = f" {plain} ", set()
    for n in toxicity.ORDERS:
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if " " not in g[1:-1]:
                grams.add(g)
    (found,) = toxicity._features([text], np.zeros(1 << toxicity.BITS, np.int32))
    # a gram that ends in the pad beyond one blank holds a blank inside, and a gram of blanks at both ends counts like any other
    assert len(set(found.tolist()) - {0}) == len({g for g in grams if g.strip()})


def test_toxicity_repeated_null_and_long(spark, prose):
    docs = [(i, prose(40, i) + (" zorgling snarfle" if i % 4 == 0 else "")) for i in range(300)]
    docs += [(4, docs[4][1])] * 3 + [(None, "zorgling snarfle zorglings"), (900, prose(200_000, 5)), (901, prose(200_000, 6) + " zorgling snarfle zorgling")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x", "y") for i in range(300)] + [(4, 1, "x", "y")], "doc_id long, toxic int, text string, l_id string")
    out = toxicity.toxicity(frame(spark, docs), labels).toPandas()
    assert len(out) == len(docs) and out[out["doc_id"] == 4]["score"].nunique() == 1
    assert out[out["doc_id"].isna()]["predicted"].tolist() == [1] and not out[out["doc_id"].isna()]["held_out"].any()
    assert out.set_index("doc_id").loc[900, "score"] < out.set_index("doc_id").loc[901, "score"]
    none = toxicity.toxicity(frame(spark, docs), labels.limit(0)).toPandas()
    assert (none["predicted"] == 0).all() and len(none) == len(docs)


def test_pii_bootstrap_against_brute_force(spark, prose):
    r = random.Random(8)
    number = lambda: f"{r.randint(200, 999)} {r.randint(100, 999)} {r.randint(1000, 9999)}"
    docs = []
    for i in range(300):
        lead = r.choice(["call me on", "ring", "part", "invoice no", prose(1, i)])
        what = r.choice([f"+49 {number()}", number(), f"password={r.getrandbits(64):016x}", f"key: {r.getrandbits(64):016x}", "4111 1111 1111 1111", f"pin = {r.randint(1000, 9999)}"])
        docs.append((i, f"{prose(4, i)} {lead} {what}; {prose(3, i)}"))
    batch = next(pii._scan(iter([pd.DataFrame({"doc_id": [str(i) for i, _ in docs], "text": [t for _, t in docs]})])))
    links: dict = {}
    for spans in [*batch["base"], *batch["loose"]]:
        for x in spans:
            if x["pattern"] != "_" or x["score"] == 1:
                k = (x["kind"], x["pattern"], x["instance"])
                old = links.get(k, (0.0, False))
                links[k] = (max(old[0], x["score"]), old[1] or x["decided"])
    score: dict = {}
    for (kind, _, i), (s, d) in links.items():
        old = score.get((kind, i), (0.0, False))
        score[kind, i] = (max(old[0], s), old[1] or d)
    for _ in range(pii.ROUNDS):
        good, bad = Counter(), Counter()
        for kind, p, i in links:
            s, d = score[kind, i]
            good[kind, p] += s
            bad[kind, p] += 0 if s >= 1 else 1 if d else pii.DOUBT * (1 - s)
        conf = {k: g / (g + bad[k] + 1) for k, g in good.items() if g >= pii.MIN_SEEDS and g / (g + bad[k] + 1) >= pii.MIN_CONFIDENCE}
        miss = defaultdict(lambda: 1.0)
        for kind, p, i in links:
            if (kind, p) in conf:
                miss[kind, i] *= 1 - min(conf[kind, p], 0.999)
        score = {k: (s if d else 1 - miss[k] if k in miss else 0.0, d) for k, (s, d) in score.items()}
    expected = set()
    for (i, _), spans in zip(docs, batch["loose"]):
        for x in spans:
            s, d = score.get((x["kind"], x["instance"]), (0, False))
            if s >= pii.MIN_SCORE and (d or (x["kind"], x["pattern"]) in conf):
                expected.add((i, x["kind"], x["start"], x["end"]))
    got = {(r["doc_id"], x["kind"], x["start"], x["end"]) for r in pii.find_pii(frame(spark, docs)).collect() for x in r["more"]}
    assert got == expected and {k for _, k, _, _ in got} == {"phone", "secret"}


def test_licenses_against_brute_force(spark, prose):
    """Every alignment of every template tried, on texts with whole, edited and cut notices; repeated rows and null ids."""
    r, docs = random.Random(9), []
    for i in range(120):
        words = r.choice(licenses.TEMPLATES)[1].split()
        for _ in range(r.choice([0, 0, 1, 3])):
            at = r.randrange(len(words))
            words[at : at + 1] = r.choice([[], ["other"], ["a", "b"]])
        docs.append((i, prose(r.randint(0, 8), i) + " " + " ".join(words) + " " + prose(3, i)))
    docs += [(5, docs[5][1]), (None, docs[6][1]), (None, None)]
    frequency = Counter(w for _, t in docs for w in set(brute.words(t)))
    index = licenses.build_index(frequency, len(docs))
    vocabulary = {w: n for n, w in enumerate(licenses._vocabulary())}
    base = [(p.split(), label) for p, label in licenses.BASE]
    expected = []
    for i, t in docs:
        w = brute.words(t)
        labels = {label for p, label in base for k in range(len(w)) if w[k : k + len(p)] == p}
        for n, (label, template, keys) in enumerate(licenses.TEMPLATES):
            x = template.split()
            rare = {p for word, posts in index.postings.items() for of, p in posts if of == n}
            for start in range(-len(x), len(w)):
                inside = [p for p in range(len(x)) if 0 <= start + p < len(w) and w[start + p] == x[p]]
                window = w[max(0, start - 2) : start + len(x) + 2]
                found = all(any(window[k : k + len(q)] == q for k in range(len(window))) for q in (key.split() for key in keys))
                if len(inside) / len(x) >= licenses.MIN_MATCH and len(rare & set(inside)) >= min(2, len(x)) and found:
                    labels.add(label)
        expected.append((i, sorted(labels)))
    assert len(vocabulary) == index.words.size
    got = [(x["doc_id"], list(x["labels"])) for x in licenses.scan_licenses(frame(spark, docs)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and sum(bool(x[1]) for x in got) > 60


def test_near_duplicates_repeated_and_null_ids(spark, prose):
    text, other = prose(60, 1), prose(60, 2)
    docs = [(3, text), (3, text), (1, text), (None, text), (None, other), (7, prose(30_000, 4)), (8, prose(30_000, 4) + " end"), (9, other), (9, prose(50, 7))]
    out = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(frame(spark, docs)).collect()), key=str)
    assert out == sorted([(3, 1, False), (3, 1, False), (1, 1, True), (None, 1, False), (None, 9, False), (7, 7, True), (8, 7, False), (9, 9, True), (9, 9, True)], key=str)
    kept = keep_one(frame(spark, docs).withColumn("dropped", F.lit("mine")), 85)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 7, 9, 9, None, None] and "dropped" in kept.columns


def test_crossing_cells_stay_linear(spark):
    """One stranger in a bucket of 5,000, and a bucket of strangers: all pairs across components, without the pairs within."""
    labelled = spark.range(5000).selectExpr("1L AS band", "id AS node", "if(id = 77, 1L, 0L) AS component").unionByName(spark.range(600).selectExpr("2L AS band", "id AS node", "id AS component"))
    left, right = crossing_cells(labelled)
    assert left.where("band = 1").count() + right.where("band = 1").count() <= 5000 + 20
    met = left.withColumnsRenamed({"node": "p", "component": "cp"}).join(right.withColumnsRenamed({"node": "q", "component": "cq", "rest": "rq"}), ["band", "x", "y"]).where("cp <> cq AND (NOT rq OR p < q)")
    pairs = met.selectExpr("band", "least(p, q) AS a", "greatest(p, q) AS b")
    assert pairs.where("band = 1").count() == pairs.where("band = 1").distinct().count() == 4999
    assert pairs.where("band = 2").count() == pairs.where("band = 2").distinct().count() == 600 * 599 // 2
    assert crossing_cells(labelled.limit(0))[0].count() == 0


def test_line_dedup_repeated_null_and_text_ids(spark, prose):
    a, b = prose(20, 1), prose(20, 2)
    docs = [(5, a + "\n" + b), (5, a), (None, a + " x"), (6, b + "\n" + b), (7, None), (8, "\n\n")]
    got = {(r["doc_id"], r["line_no"], r["class_size"], r["kept"]) for r in line_components(frame(spark, docs)).collect()}
    assert got == {(5, 0, 3, False), (None, 0, 3, True), (5, 1, 3, True), (6, 0, 3, False), (6, 1, 3, False)}
    texts = frame(spark, docs).withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("cut", F.lit("mine")).withColumn("cut_id", F.lit("mine"))
    cut = drop_repeated_lines(texts)
    assert sorted(str(r["text"]) for r in cut.collect()) == sorted(["\n" + b if False else b, "", a + " x", "", "None", "\n\n"]) and "cut" in cut.columns


def test_line_dedup_very_long_lines(spark, prose):
    long = prose(20_000, 5)
    docs = [(1, long), (2, long + " end"), (3, prose(20_000, 6)), (4, "\n".join(prose(9, i) for i in range(3000)))]
    got = {(r["doc_id"], r["line_no"]): r["class_size"] for r in line_components(frame(spark, docs)).where("doc_id < 4").collect()}
    assert got == {(1, 0): 2, (2, 0): 2, (3, 0): 1}


def test_decontamination_clashing_columns_and_ties(spark, prose):
    bench = spark.createDataFrame([(i, prose(14, 500), "x", "y") for i in range(3)] + [(9, prose(12, 501), "x", "y")], "item_id long, text string, doc_id string, window string")
    docs = [(1, prose(14, 500)), (1, prose(14, 500)), (None, prose(12, 501)), (2, prose(100_000, 7) + " " + prose(12, 501))]
    got = sorted(((r["doc_id"], r["n_hit"], list(r["items"])) for r in contamination(frame(spark, docs), bench).collect()), key=str)
    assert got == sorted([(1, 14, ["0", "1", "2"]), (1, 14, ["0", "1", "2"]), (None, 12, ["9"]), (2, 12, ["9"])], key=str)


def test_warc_clashing_columns_and_null_ids(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "a" * 200, "x"), (1, None, "a" * 200, "y"), (2, "u", None, "z")], "page_id long, url string, html string, payload string").withColumn("digest", F.lit("mine"))
    out = rows(warc.warc_round_trip(pages, str(tmp_path / "w")).select("page_id", "record_type", "refers_to", "payload_bytes"))
    assert out == sorted([(None, "revisit", 1, 200), (1, "response", None, 200), (2, "response", None, 0)], key=str)


def test_exact_dedup_string_ids_and_long_texts(spark, prose):
    docs = frame(spark, [(1, prose(30_000, 1)), (2, prose(30_000, 1).upper()), (3, None)]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    for digest in (True, False):
        assert rows(exact_dedup(docs, digest=digest).select("doc_id", "keep_id", "group_size", "kept")) == [("d1", "d2", 2, False), ("d2", "d2", 2, True), ("d3", "d3", 1, True)]


def test_counted_bytes_follow_the_widths(spark):
    narrow = spark.range(100)
    wide = narrow.withColumn("t", F.repeat(F.lit("x"), 10_000)).withColumn("a", F.array(F.repeat(F.lit("y"), 500)))
    assert counted_bytes(narrow) < 5_000 and counted_bytes(wide) > 1_000_000 and counted_bytes(narrow.limit(0)) == 0
    assert fresh("ID", narrow) == "ID_" and fresh("x", narrow) == "x"


@pytest.mark.parametrize("case", ["odd", "empty"])
def test_pipeline_of_odd_rows(spark, prose, tmp_path, case):
    """Null and blank texts, null ids, repeated ids, a very long text and clashing columns, or no rows at all."""
    docs = [(i, prose(60, i), "en", "big" if i % 3 else None, 0) for i in range(120)] if case == "odd" else []
    if docs:
        docs += [(500, None, None, None, None), (501, "", "en", "s", 0), (None, prose(50, 900), "en", "s", 0), (None, None, None, "s", 0), (3, docs[3][1], "en", "big", 0), (502, prose(40_000, 8), "en", "s", 0)]
    df = spark.createDataFrame(docs, SCHEMA)
    for name in ("leaked", "dropped", "mix_source", "mix_copy", "last_key", "shard_id", "component", "fp"):
        df = df.withColumn(name, F.lit("mine"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, prose(20, 7777), "x")], "item_id long, text string, fp string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0, "x") for i in range(50)], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = Counter(r["doc_id"] for r in out.collect())
    if case == "empty":
        assert not got
        return
    assert set(got) == {*range(120), 500, 501, 502, None}
    assert out.groupBy("doc_id", "copy").count().where("count > 1").count() == 0 and set(out.select("shard").distinct().toPandas()["shard"]) <= set(range(24))
    assert zlib.crc32(docs[9][1].encode()) == out.where("doc_id = 9").first()["text_crc32"]
