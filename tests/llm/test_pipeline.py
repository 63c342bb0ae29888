import hashlib

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from quire.llm import decontam, pii, quality, queries, simhash
from quire.llm.common import held_out
from tokenizers import Tokenizer


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name == "quality":
            want = quality.classify(before, labels, ~held_out("doc_id", 3, 1)).where("predicted = 1")
        elif name == "near_duplicates":
            want = simhash.near_duplicates(before).where("component_id = doc_id")
        elif name == "decontamination":
            want = decontam.decontaminate(before, spark.read.parquet(f"{small}/benchmark.parquet")).where("n_hit = 0")
        else:
            want = before
        assert ids == sorted(r.doc_id for r in want.select("doc_id").collect()), name
        assert 0 < len(ids) <= before.count()
        assert name == "tokens" or docs.columns == columns
    texts = {r.doc_id: r.text for r in kept["pii"].collect()}
    assert texts == {r.doc_id: r.text for r in pii.pseudonymise(kept["decontamination"], queries.pii_key(spark)).collect()}
    public = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in kept["tokens"].collect():
        ids = public.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_rows(spark, small, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, small).columns == docs.columns
            assert stage(spark, docs, small).count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()
    assert corpus_pipeline.STAGES[3][1](spark, odd, small).where(F.col("n_chars") != F.length("text")).count() == 0


def test_decisions_hold_for_rows(spark, small):
    """Null ids, one id for several texts, repeated rows: of each group one row stays, and a passage takes out its own row only."""
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    other = " ".join(f"quite{i} other words" for i in range(40))
    rows = [(None, "copied text of some words", 1), (None, "copied text of some words", 2), (1, other, 3), (1, item, 4), (None, item + " and more", 5), (2, other, 6), (2, other, 7), (None, other, 8), (3, "copied text of some words!", 9), (3, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    left = corpus_pipeline.near_duplicate_stage(spark, docs, small)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in left.collect())
    assert got == sorted([(True, 0, "copied text of some words"), (False, 1, other), (False, 1, item), (True, 0, item + " and more"), (False, 3, "copied text of some words!"), (False, 3, "")])
    clean = corpus_pipeline.decontamination_stage(spark, docs, small)
    assert sorted(r.n for r in clean.collect()) == [1, 2, 3, 6, 7, 8, 9, 10] and clean.columns == docs.columns


def test_without_either_way(spark, odd, monkeypatch):
    from quire.llm import common

    ids = spark.createDataFrame([(6,), (8,), (None,)], "doc_id long")
    want = sorted(map(str, odd.where("doc_id is null or doc_id not in (6, 8)").collect()))
    for most in (0, 10):
        monkeypatch.setattr(common, "BROADCAST_IDS", most)
        assert sorted(map(str, common.without(odd, ids, "doc_id").collect())) == want


def test_a_task_takes_one_python_worker(spark, small, monkeypatch):
    """Two Python steps in a row keep two workers for each running task, as long as the executor lives."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plain, plans = type(docs).mapInArrow, []

    def noted(df, *args, **more):
        out = plain(df, *args, **more)
        plans.append(out._jdf.queryExecution().analyzed().toString())
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small)
    assert len(plans) > 3 and {p.count("MapInArrow") for p in plans} == {1}
