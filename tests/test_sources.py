import pytest
from pyspark.sql import functions as F

from siftwork.operators import embeddings, explore, labels, tfidf
from siftwork.operators.classifier import FittedModel
from siftwork.plans import triage as plan
from siftwork.sources import corpus, durable, session
from siftwork.specs import KeywordFeature, TfidfFeature
from siftwork.streaming.ledger import (
    append_batch,
    compact_ledger,
    read_ledger,
    remove_folded,
    write_label_stream,
)
from siftwork.streaming.scoring import score_stream
from tests.conftest import YARD, values

SPECS = (
    KeywordFeature("test", weight=2.0, keywords=("it's", "kettle")),
    TfidfFeature("like", references=("moved ladder", "jam")),
)
MODEL = FittedModel(("_test", "_like"), (0.5, -2.0), 0.125)


def test_default_label(spark, yard, tmp_path):
    path = str(tmp_path / "yard")
    yard.write.json(path)
    rows = corpus.load_corpus(spark, path, "json")
    assert set(values(rows, "_label")) == {-1}
    kept = corpus.with_default_label(rows.replace(-1, 1, ["_label"]))
    assert set(values(kept, "_label")) == {1}


def test_durable_tables_are_read_back(yard):
    kept = durable.durable(yard, "yard")
    assert kept.schema == yard.schema and values(kept, "text") == values(yard, "text")
    assert durable.shared_folder(yard.sparkSession) in kept.inputFiles()[0]


def test_session_round_trip(spark, yard, tmp_path):
    path = str(tmp_path / "session")
    idf = tfidf.fit_idf(yard)
    training = spark.createDataFrame([(1, "x", 1)], "doc_id bigint, text string, label int")
    saved = session.Session(
        specs=SPECS,
        model=MODEL,
        idf=idf,
        corpus=yard,
        training=training,
        sample=explore.id_list(spark, [3, 1]),
        sample_size=50,
    )
    session.save_session(spark, saved, path)
    loaded = session.load_session(spark, path)
    assert (loaded.specs, loaded.model, loaded.sample_size) == (SPECS, MODEL, 50)
    assert loaded.idf.n_docs == len(YARD)
    assert sorted(loaded.idf.terms.collect()) == sorted(idf.terms.collect())
    assert loaded.embeddings is None
    assert sorted(r.doc_id for r in loaded.sample.collect()) == [1, 3]
    before = plan.score_new(yard, SPECS, MODEL, idf=idf)
    after = plan.score_new(loaded.corpus, loaded.specs, loaded.model, idf=loaded.idf)
    assert values(after, "_pred") == pytest.approx(values(before, "_pred"))


def test_saving_over_a_loaded_session(spark, yard, tmp_path):
    path = str(tmp_path / "session")
    first = session.save_session(spark, session.Session(specs=SPECS, corpus=yard), path)
    loaded = session.load_session(spark, path)
    fewer = session.Session(specs=SPECS[:1], corpus=loaded.corpus.where("doc_id < 3"))
    session.save_session(spark, fewer, path)
    latest = session.load_session(spark, path)
    assert latest.corpus.count() == 3 and len(latest.specs) == 1
    assert latest.model is None and latest.training is None
    assert session.load_session(spark, path, first).corpus.count() == len(YARD)


def test_a_stored_corpus_is_named_not_copied(spark, yard, tmp_path):
    place, path = str(tmp_path / "yard"), str(tmp_path / "session")
    yard.write.parquet(place)
    session.save_session(spark, session.Session(specs=SPECS, corpus_path=place), path)
    loaded = session.load_session(spark, path)
    assert values(loaded.corpus, "text") == values(yard, "text") and loaded.corpus_path == place
    assert not list((tmp_path / "session").glob("*/corpus"))
    yard.limit(1).withColumn("doc_id", F.lit(77).cast("bigint")).write.mode("append").parquet(place)
    with pytest.raises(ValueError, match="not the corpus"):
        session.load_session(spark, path)


@pytest.mark.parametrize(("change", "ok"), [
    (lambda df: df.repartition(2), True),  # other files, the same rows
    (lambda df: df.withColumn("text", F.concat("text", F.lit("!"))), False),
    (lambda df: df.unionByName(df.limit(1)).unionByName(df.limit(1)), False),  # cancels in an exclusive or
    (lambda df: df.where("doc_id > 0"), False),
    (lambda df: df.withColumn("text", F.reverse("text")), False),  # the same lengths
    (lambda df: df.drop("text"), False),
])
def test_a_changed_corpus_is_refused(spark, yard, tmp_path, change, ok):
    place, path = str(tmp_path / "yard"), str(tmp_path / "session")
    yard.write.parquet(place)
    session.save_session(spark, session.Session(specs=SPECS, corpus_path=place), path)
    changed = durable.durable(change(yard), "changed")
    changed.write.mode("overwrite").parquet(place)
    if ok:
        assert session.load_session(spark, path).corpus.count() == len(YARD)
    else:
        with pytest.raises(ValueError, match="not the corpus"):
            session.load_session(spark, path)


def test_an_unchanged_corpus_is_not_read_again(spark, yard, tmp_path, monkeypatch):
    place, path = str(tmp_path / "yard"), str(tmp_path / "session")
    yard.write.parquet(place)
    session.save_session(spark, session.Session(specs=SPECS, corpus_path=place), path)
    monkeypatch.setattr(session, "rows_digest", None)
    assert session.load_session(spark, path).corpus_path == place


@pytest.mark.parametrize(
    "version,ok", [("0.8.0", True), ("0.7.2", True), ("0.6.9", False), ("1.0.0", False)]
)
def test_version_gate(spark, tmp_path, version, ok):
    path = str(tmp_path / "session")
    session.save_session(spark, session.Session(specs=(), version=version), path)
    if ok:
        assert session.load_session(spark, path).specs == ()
    else:
        with pytest.raises(ValueError):
            session.load_session(spark, path)


def loader(batches):
    """A loader of an embedder that writes down its batch sizes."""

    def load():
        def embed(texts):
            with open(batches, "a") as out:
                out.write(f"{len(texts)}\n")
            return [[float(len(t)), float(t.count("a"))] for t in texts]

        return embed

    return load


def test_embedding_in_batches_and_only_new_rows(spark, yard, tmp_path):
    log = str(tmp_path / "batches")
    cache = embeddings.embed_texts(yard.where("doc_id < 9"), loader(log), batch_size=4)
    cache = durable.durable(cache, "cache")
    with open(log) as sizes:
        assert sorted(int(s) for s in sizes) == [1, 4, 4]
    assert embeddings.missing_from_cache(yard, cache).count() == len(YARD) - 9
    log = str(tmp_path / "more")
    whole = durable.durable(embeddings.extend_cache(yard, cache, loader(log)), "cache")
    with open(log) as sizes:
        assert sum(int(s) for s in sizes) == len(YARD) - 9
    texts = values(yard, "text")
    assert values(whole, "embedding") == [[len(t), t.count("a")] for t in texts]


def test_mean_pool(spark):
    tokens = spark.createDataFrame(
        [(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "doc_id int, embedding array<float>"
    )
    assert values(embeddings.mean_pool(tokens, "doc_id"), "embedding") == [[2.0, 3.0], [5.0, 6.0]]


def test_stream_scores_equal_batch_scores(spark, yard, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    yard.repartition(3).write.parquet(source)
    model = FittedModel(("_test",), (1.0,), -0.5)
    stream = spark.readStream.schema(yard.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        score_stream(stream, SPECS[:1], model)
        .writeStream.option("path", out)
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    batch = plan.score_new(yard, SPECS[:1], model)
    assert values(spark.read.parquet(out), "_pred") == values(batch, "_pred")
    with pytest.raises(ValueError):
        score_stream(stream, SPECS, model)


def test_label_stream(spark, tmp_path):
    schema = "seq bigint, doc_id bigint, text string, label int"
    source, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    state = str(tmp_path / "state")

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        write_label_stream(stream, ledger, state).awaitTermination()
        kept = labels.training_set(read_ledger(spark, ledger))
        return {(r.doc_id, r.text): r.label for r in kept.collect()}

    assert arrive([(2, 1, "a", 0), (5, 2, "b", 1)]) == {(1, "a"): 0, (2, "b"): 1}
    assert arrive([(3, 1, "a", 1), (4, 2, "b", -1)]) == {(1, "a"): 1, (2, "b"): 1}
    assert arrive([(6, 2, "b", -1)]) == {(1, "a"): 1}
    before = read_ledger(spark, ledger).count()
    first = compact_ledger(spark, ledger)
    assert read_ledger(spark, ledger).count() < before
    assert arrive([(7, 9, "z", 1)]) == {(1, "a"): 1, (9, "z"): 1}
    assert compact_ledger(spark, ledger) != first
    assert arrive([(8, 9, "z", -1)]) == {(1, "a"): 1}
    spark.createDataFrame([(99, 1, "a", 0)], schema).write.parquet(f"{ledger}/events/compacted-x")
    kept = labels.training_set(read_ledger(spark, ledger)).collect()
    assert [(r.doc_id, r.label) for r in kept] == [(1, 1)]  # a version that isn't listed is not read


def test_a_reader_during_a_retry_sees_the_old_or_the_new_batch(spark, tmp_path):
    schema, ledger = "seq bigint, doc_id bigint, text string, label int", str(tmp_path / "ledger")

    def batch(label):
        return spark.createDataFrame([(i, i, "t", label) for i in range(50)], schema).repartition(3)

    def seen(df):
        return sorted({(r.label, r.n) for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()})

    with pytest.raises(ValueError, match="nothing"):
        read_ledger(spark, ledger)
    first = append_batch(batch(0), ledger, "r", 0)
    reader = read_ledger(spark, ledger)
    batch(1).limit(7).write.parquet(f"{ledger}/events/r-0-half")  # a retry that has not come to its end
    assert seen(read_ledger(spark, ledger)) == [(0, 50)]
    append_batch(batch(1), ledger, "r", 0)
    assert seen(read_ledger(spark, ledger)) == [(1, 50)]
    assert seen(reader) == [(0, 50)]  # who was reading goes on
    append_batch(batch(-1), ledger, "r", 1)
    assert seen(read_ledger(spark, ledger)) == [(-1, 50), (1, 50)]
    assert remove_folded(spark, ledger) == [first]
    version = compact_ledger(spark, ledger)
    append_batch(batch(1), ledger, "r", 1)  # a retry of what is folded in already
    append_batch(batch(0).limit(1), ledger, "r", 2)
    before = sorted(read_ledger(spark, ledger).collect())
    assert len(remove_folded(spark, ledger)) == 3 and sorted(read_ledger(spark, ledger).collect()) == before
    assert compact_ledger(spark, ledger) != version and version in remove_folded(spark, ledger)
    assert labels.training_set(read_ledger(spark, ledger)).collect() == labels.training_set(
        spark.createDataFrame(before, schema)
    ).collect()


def test_a_text_cache_knows_changed_texts_and_models(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bb"), (4, None), (5, "")], "doc_id int, text string")
    log = str(tmp_path / "first")
    cache = durable.durable(embeddings.extend_text_cache(rows, None, loader(log), "m"), "cache")
    with open(log) as sizes:
        assert sum(int(s) for s in sizes) == 3  # copies are embedded once
    changed = spark.createDataFrame([(1, "aa"), (2, "bb"), (9, "a")], "doc_id int, text string")
    log = str(tmp_path / "second")
    more = durable.durable(embeddings.extend_text_cache(changed, cache, loader(log), "m"), "cache")
    with open(log) as sizes:
        assert sum(int(s) for s in sizes) == 1
    found = embeddings.cached_embeddings(changed, more, "m")
    assert values(found, "embedding") == [[2.0, 2.0], [2.0, 0.0], [1.0, 1.0]]
    assert embeddings.cached_embeddings(rows, more, "m").count() == 4
    assert embeddings.missing_texts(changed, more, "other").count() == 3
