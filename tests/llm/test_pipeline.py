"""The stages on a small folder: columns stay, decisions take effect, the last stage decodes to its input."""

import pyarrow as pa

import corpus_pipeline
from ledgerlark.llm import minhash
from tests.llm.test_fixtures import documents, fixture_rows


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows = [r for r in fixture_rows() if r[0] is not None]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
        if name == "near_duplicates":
            assert docs.select("doc_id").distinct().count() == sizes[-1]
        if name == "personal_data":
            assert "<EMAIL>" in docs.filter("doc_id = 210").first().text
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(r.decoded for r in last) == sorted(r.text for r in docs.collect())
    assert all(r.n_tokens == len(r.ids) for r in last)


def test_stages_on_odd_rows_and_on_none(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars", "key", "node"]  # the last two clash with names used inside
    for name, rows in (("odd", [*fixture_rows(), (None, "no id here", "en", None)]), ("none", [])):
        folder = str(tmp_path / name)
        docs = documents(spark, rows).select(*columns)
        for stage, function in corpus_pipeline.STAGES[:-1]:
            function(spark, docs, folder).write.parquet(f"{folder}/{stage}")
            docs = spark.read.parquet(f"{folder}/{stage}")
            assert docs.columns == columns
            if rows and stage != "source_mixing":
                assert docs.filter("doc_id is null").count() == 2
        last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
        assert len(last) == docs.count() and bool(last) == bool(rows)


def test_near_duplicates_stage_takes_five_words_at_80_percent(spark):
    base = [f"w{k}" for k in range(104)]  # 100 five-word shingles
    cut = base[:86]  # 82 of them: 0.82, of three words 84 of 102
    other = [f"v{k}" for k in range(300)]
    spread = [f"n{k}" if k % 38 == 19 else w for k, w in enumerate(other)]  # 3 words: 274 of 322 (0.851); 5 words: 256 of 336 (0.76)
    far = [f"u{k}" for k in range(100)]
    rows = [(1, " ".join(base), "en", "s"), (2, " ".join(cut), "en", "s"), (3, " ".join(other), "en", "s"), (4, " ".join(spread), "en", "s"), (5, " ".join(far), "en", "s")]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [1, 3, 4, 5]
    assert [minhash.bands_for(t, 5, minhash.MISS) for t in (85, 80)] == [30, 45]


def test_stages_hand_texts_to_python_a_few_megabytes_at_a_time(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    docs = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('some words ', 400) text")
    stage = corpus_pipeline.in_small_batches(lambda docs: docs.mapInArrow(sizes, "n long, size long"))
    got = stage(spark, docs, "").collect()
    assert sum(r.n for r in got) == 3000
    assert len(got) > 2 and max(r.size for r in got) < 5 << 20
