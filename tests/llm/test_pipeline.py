import corpus_pipeline
from lorekeep.llm.common import materialise

from . import brute
from .test_operators import edited


def test_stages(spark, prose, tmp_path):
    bench = [(i, prose(20, 700 + i)) for i in range(5)]
    docs = [(i, prose(100, i), "en", "big" if i % 3 else f"s{i % 7}") for i in range(200)]
    docs += [(300 + i, edited(docs[i][1], 1, i), "en", "big") for i in range(20)]
    docs += [(400 + i, prose(30, i) + " " + bench[i][1], "en", "s1") for i in range(5)]
    docs += [(500 + i, prose(30, 50 + i) + " zorgling quibblewort", "en", "s2") for i in range(40)]
    full = [(*d, len(d[1])) for d in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d[0], 1, int(d[0] >= 500)) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = d.columns
        d = materialise(stage(spark, d, str(tmp_path)), f"test-{name}")
        seen[name] = [r["doc_id"] for r in d.select("doc_id").collect()]
        if name != "sharding":
            assert d.columns == before
    texts = {x[0]: x[1] for x in docs}
    assert set(seen["toxicity"]) == {i for i in texts if i < 500}
    kept = {r[0] for r in brute.near([(i, texts[i]) for i in sorted(seen["toxicity"])]) if r[3]}
    assert sorted(seen["near_dedup"]) == sorted(kept) and not kept & set(range(300, 320))
    assert sorted(seen["decontamination"]) == sorted(kept - set(range(400, 405)))
    assert set(seen["mixing"]) == set(seen["decontamination"]) and len(seen["mixing"]) > len(seen["decontamination"])
    assert sorted(seen["sharding"]) == sorted(seen["mixing"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"] and corpus_pipeline.ORACLE_SQL is None
