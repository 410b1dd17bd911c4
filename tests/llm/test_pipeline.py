import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_in_turn_and_as_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns, name
            assert docs.where("n_chars <> length(text)").count() == 0
            counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4] > 0
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    whole = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_every_stage_takes_odd_rows_and_clashing_names(spark, tmp_path):
    good = " ".join(f"word{i} stays here" for i in range(40))
    rows = [
        (None, good, "en", "s1", 1), (1, None, "en", None, 0), (2, "", None, "s2", 0), (2, "", None, "s2", 0), (3, good, "en", "s3", 5), (3, "another text " + good[::-1], "en", "s3", 5),
        (4, good + " token=abcdefghijklmnop0123456789", "de", "s4", 5), (5, "x " * 30_000, "fr", "s5", 5),
    ]
    extra = "id_ int, cut_ int, tie int, class_id int, component int, secrets string, quality_score double, score double, base_spans int, part int"
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "s", 0.5, 0.25, 6, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert all((r.id_, r.component, r.secrets, r.score) == (1, 5, "s", 0.25) for r in kept)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name == "ngram_jaccard_join":
            assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept if r.doc_id != 5)[:4] == [(0, len(good)), (1, 0), (2, 0), (2, 0)]
            assert {r.doc_id for r in kept} == {None, 1, 2, 3, 5} and sum(r.doc_id == 3 for r in kept) == 2
        elif name != "quality_classifier":
            assert len(kept) == len(rows)
    pieces = corpus_pipeline.packing(spark, docs, SF)
    assert pieces.where("piece = 0").count() == len(rows) and corpus_pipeline.packing(spark, docs.limit(0), SF).count() == 0


def test_shared_folder_is_needed_off_local_mode():
    from types import SimpleNamespace

    from cohortspark.llm import common

    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, *a: conf.get(k, *a)), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpoint_dir(cluster)
