from __future__ import annotations

import pytest

import corpus_pipeline
from driftfield.llm import registry
from driftfield.llm.common import table
from tests.oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    check(spark, registry.QUERIES[name], registry.ORACLES[name], SF)


def test_pipeline_runs_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = table(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        ids = {r["doc_id"] for r in docs.collect()}
        assert ids <= kept and (len(ids) > 0.5 * len(kept)), name
        kept = ids
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in out} == kept
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, out))


def test_entry_has_all():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")} == set(range(1, 11))


@pytest.mark.parametrize("master, ok", [("local", True), ("local[4]", True), ("local-cluster[3,2,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_a_cluster_must_name_its_shared_folder(tmp_path, monkeypatch, master, ok):
    from types import SimpleNamespace

    from driftfield.llm import common

    set_dirs = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=set_dirs.append)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: None), sparkContext=context)
    monkeypatch.setattr(common.tempfile, "mkdtemp", lambda prefix: str(tmp_path))
    if ok:
        assert common.shared_root(session) == f"file://{tmp_path}" == set_dirs[0]
    else:
        with pytest.raises(RuntimeError):
            common.shared_root(session)


def test_no_session_setting_is_left_behind(spark, documents):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    registry.QUERIES["op1_warc"](spark, SF).count()
    registry.QUERIES["op9_simhash"](spark, SF).count()
    assert [spark.conf.get(k) for k in keys] == before
