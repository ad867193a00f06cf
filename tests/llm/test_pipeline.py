from collections import Counter

import corpus_pipeline
from veilspark.llm.common import read_table
from veilspark.llm.queries import oracle_sql, queries
from veilspark.llm.secrets import redact, scan_text
from veilspark.llm.toxicity import Scorer, train, training_rows

from .conftest import ascii_lower
from .test_dedup import brute_near

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = read_table(spark, FOLDER, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "SimHash near-dedup", "secret scan", "best-fit packing"]
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append({r.doc_id: r for r in docs.collect()} if i < 4 else docs.collect())
    start = {r.doc_id: r for r in read_table(spark, FOLDER, "documents").collect()}
    model = Scorer(train(*training_rows(read_table(spark, FOLDER, "documents"), read_table(spark, FOLDER, "labels"))))
    assert set(kept[0]) == {i for i, r in start.items() if model.scores([r.text.encode()])[0] < 0.7}
    last = {}
    for i, r in kept[0].items():
        last[ascii_lower(r.text)] = max(i, last.get(ascii_lower(r.text), i))
    assert set(kept[1]) == set(last.values())
    unique = [(i, r.text) for i, r in kept[1].items()]
    assert set(kept[2]) == {unique[i][0] for i in brute_near(unique)}
    for i, r in kept[3].items():
        before = kept[2][i]
        spans = scan_text(before.text)
        assert r.text == (redact(before.text, spans) if spans else before.text) and (r.lang, r.source) == (before.lang, before.source) and r.n_chars == (len(r.text) if spans else before.n_chars)
    assert len(kept[3]) == len(kept[2]) and {r.doc_id for r in kept[4]} == set(kept[3])
    assert all(v <= 2048 for v in sum((Counter({r.sequence_id: r.length}) for r in kept[4]), Counter()).values())


def test_run_applies_all_stages(spark):
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, FOLDER).columns)


def test_queries_are_complete():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11)) and set(oracle_sql()) <= set(queries())
