"""The pipeline's stages against brute force, and its run on the smallest tables and on odd rows."""

from collections import Counter

import pytest

from tests.compare import agree, duck
from tests.llm.helpers import odd_docs
from tests.llm.test_ops import brute_secrets, components, shingle_sets


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    import corpus_pipeline

    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = {"input": docs}
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, small).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_stages_keep_the_columns(stages):
    for name in ("quality", "near_dedup", "secrets", "mixing"):
        assert stages[name].columns == stages["input"].columns and stages[name].dtypes == stages["input"].dtypes


def test_one_of_each_group_stays(stages):
    rows = stages["quality"].select("doc_id", "text").collect()
    groups = components([r.doc_id for r in rows], shingle_sets([r.text for r in rows]))
    assert {r.doc_id for r in stages["near_dedup"].collect()} == set(groups)


def test_secrets_are_gone_and_all_stay(stages):
    before, after = ({r.doc_id: r for r in stages[n].collect()} for n in ("near_dedup", "secrets"))
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not [s for s in brute_secrets(r.text) if not s.startswith("assign")] and r.n_chars == len(r.text)
        assert brute_secrets(before[i].text) or r.text == before[i].text


def test_mix_repeats_whole_documents(stages):
    before = {r.doc_id: r.text for r in stages["secrets"].collect()}
    n = Counter(r.doc_id for r in stages["mixing"].collect())
    assert max(n.values()) <= 2 and all(before[r.doc_id] == r.text for r in stages["mixing"].collect())
    words = lambda t: len(t.split())
    total = sum(words(t) for t in before.values())
    assert abs(sum(words(before[i]) * k for i, k in n.items()) - 1.5 * total) < 0.15 * total


def test_run_equals_the_stages(spark, small, stages):
    import __spark_entry__

    got = __spark_entry__.queries()["pipeline"](spark, small)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, stages["byte_bpe"].collect()))


def test_stages_take_odd_and_empty_tables(spark, small, tmp_path):
    import corpus_pipeline

    for k, df in enumerate((odd_docs(spark), odd_docs(spark).limit(0))):
        df.write.parquet(str(tmp_path / f"{k}"))
        for name, f in corpus_pipeline.STAGES:
            f(spark, spark.read.parquet(str(tmp_path / f"{k}")), small).write.parquet(str(tmp_path / f"{k}-{name}"))


def test_quality_sql(spark, small):
    import __spark_entry__

    agree(__spark_entry__.queries()["op5_quality"](spark, small), duck(small), __spark_entry__.oracle_sql()["op5_quality"])
