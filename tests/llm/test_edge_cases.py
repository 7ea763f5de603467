"""Every operator and stage on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import zlib

import pytest

import corpus_pipeline
from markwright.llm import decontamination, language, licenses, line_dedup, mixing, near_dedup, neighbours, personal_data, quality, sharding

PASSAGE = " ".join(f"word{i} and{i % 7}" for i in range(40))
LONG = " ".join(f"tok{i % 9973}" for i in range(60_000))
ROWS = [
    (1, PASSAGE, "en", "a", 10),
    (2, PASSAGE, "en", "a", 10),
    (2, PASSAGE, "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "x", "fr", "b", 1),
    (6, LONG, "de", None, None),
    (None, PASSAGE, "en", "c", 3),
    (None, None, None, "c", None),
    (7, "\n\n \t\n", "en", "b", 4),
    (8, "12345678901234567890" * 300 + "a" * 5000 + "@" + "b" * 5000, "en", "a", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["score", "predicted", "size", "target", "copies", "shard", "key", "label", "rank", "bucket"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (4, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(PASSAGE.split()[10:40])), (2, None), (3, ""), (4, "x")], "item_id long, text string")


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        assert 0 <= r["shard"] < 40 and r["law"] == "bytes" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = sorted(r["size"] for r in rows)
    assert sizes == sorted(16 + len((t or "").encode()) for _, t, *_ in ROWS)
    assert {r["text_crc32"] for r in rows} == {zlib.crc32((t or "").encode()) for _, t, *_ in ROWS}
    assert sharding.shard_documents(empty).count() == 0


def test_decontamination(docs, empty, benchmark, spark):
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, benchmark).collect()}
    assert found == {(1, 1), (2, 1), (None, 1), (5, 4)}
    kept = decontamination.decontaminated(docs, benchmark)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 4, 6, 7, 8]
    assert decontamination.find_leaks(empty, benchmark).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(docs, nothing).count() == 0
    assert decontamination.decontaminated(docs, nothing).count() == len(ROWS)


def test_licenses(docs, empty, spark):
    own = spark.createDataFrame([(1, "Foo. ALL rights\nReserved!"), (2, "all rights are reserved"), (3, None), (4, LONG + " Licensed under the Apache License, Version 2.0. " + LONG)], "doc_id long, text string")
    assert {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(own).collect()} == {(1, "all-rights-reserved"), (4, "apache-2.0")}
    assert licenses.scan_licenses(docs).count() == 0 and licenses.scan_licenses(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, {str(i): "a" for i in range(licenses.MAX_TEMPLATES + 1)})


def test_personal_data(docs, empty):
    rows = personal_data.find_personal_data(docs).collect()
    assert len(rows) == len(ROWS)
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == nothing and r["spans"] == "" for r in rows if r["doc_id"] in (1, 3, 4))
    assert personal_data.find_personal_data(empty).count() == 0


def test_quality(docs, empty, labels, spark):
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    unlabelled = quality.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in unlabelled.collect()} == {0.5}
    assert quality.quality_scores(empty, labels).count() == 0


def test_line_dedup(docs, empty):
    rows = line_dedup.line_dedup_digest(docs).collect()
    assert len(rows) == len(ROWS) and sum(r["n_dropped"] for r in rows) == 0
    assert line_dedup.line_dedup_digest(empty).count() == 0


def test_near_duplicates(docs, empty):
    rows = [(r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(docs).collect()]
    assert len(rows) == len(ROWS)
    assert {c for d, c in rows if d in (1, 2)} == {1}
    assert sorted(c or 0 for d, c in rows if d is None) == [0, 1]
    assert all(d == c for d, c in rows if d not in (1, 2, None))
    kept = sorted(r["doc_id"] or 0 for r in near_dedup.deduplicated(docs).collect())
    assert kept == [0, 1, 3, 4, 5, 6, 7, 8]
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.deduplicated(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mixture(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mixture(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_language(docs, empty):
    rows = language.identify(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (3, 4, 7))
    assert all(r["lang_pred"] in ("en", "fr", "de", "und") and 0 <= r["score"] <= 1 for r in rows)
    assert language.identify(empty).count() == 0


def test_neighbours(spark):
    bad = [(100, None), (120, [0.0, 0.0]), (140, [1.0, None]), (160, [float("nan"), 1.0]), (180, [1.0]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (3, [-0.0, 3.0])]
    table = spark.createDataFrame(bad + good, "vec_id long, embedding array<float>")
    rows = sorted(map(tuple, neighbours.nearest(table).collect()))
    assert [r[2] for r in rows if r[0] == 0] == [1, 2, 3, 20, 20] or [r[2] for r in rows if r[0] == 0][:2] == [1, 2]
    assert {r[0] for r in rows} == {0, 20}
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline_stages(docs, empty, labels, benchmark, tmp_path, spark):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    wide = docs.selectExpr("*", *[f"1 AS {c}" for c in CLASH])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert sorted(stage(spark, wide, folder).columns) == sorted(wide.columns), name
        assert stage(spark, empty, folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, folder).count() == len(ROWS)
    assert "shard" in corpus_pipeline.run(spark, folder).columns


def test_near_duplicates_without_broadcasts(docs, monkeypatch):
    """The joins of large inputs, which move rows, give what the broadcasts of small ones give."""
    twins = docs.sparkSession.createDataFrame([(20, PASSAGE + " at the end", "en", "a", 1), (21, PASSAGE[6:] + " at the end", "en", "a", 1)], SCHEMA)
    rows = docs.unionByName(twins)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", -1)
    classes = {(r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(rows).collect()}
    assert {c for d, c in classes if d in (1, 2, 20, 21)} == {1}
    assert sorted(r["doc_id"] or 0 for r in near_dedup.deduplicated(rows).collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
