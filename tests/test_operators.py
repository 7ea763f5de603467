import hashlib
import json
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from markwright.cli import build_model, demo, main
from markwright.functions import ed25519, prf, text
from markwright.operators import attacks, detect, evaluate, generate, ngrams, registry, retrieval, transport
from markwright.operators.config import EXAMPLE_KEY, MarkConfig
from markwright.operators.providers import ProvidedModel
from markwright.plans import catalog
from markwright.session import materialize
from markwright.sources import corpus
from markwright.streaming import detect as streaming

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def model(docs):
    return build_model(docs)


@pytest.fixture(scope="module")
def marked(spark, docs, model):
    """Six generated texts with their ids."""
    vocab, lm = model
    prompts = spark.createDataFrame([(i, lm.encode(["the", "of"])) for i in range(6)], "doc_id long, prompt array<int>").repartition(4)
    found = generate.generate(prompts, lm, 160, EXAMPLE_KEY).collect()
    rows = [(r["doc_id"], " ".join(lm.tokens[i] for i in r["ids"])) for r in found]
    return spark.createDataFrame(rows, "doc_id long, text string")


def slow_scores(ids, key=EXAMPLE_KEY, c=MarkConfig()):
    seen, out = set(), [None] * len(ids)
    for t in range(c.context_window, len(ids)):
        ctx = tuple(ids[t - c.context_window : t])
        if ctx in seen:
            continue
        seen.add(ctx)
        s = prf.np_seeds(key, ctx)
        block = int(prf.np_mix(np.array([ids[t]], np.uint64) ^ s["partition"])[0] % np.uint64(c.n_blocks))
        u = prf.np_uniform(prf.np_mix(np.array([block * c.n_columns + prf.np_column(s["column"], c.n_columns)], np.uint64) ^ s["cost"]))[0]
        out[t] = -math.log1p(-u)
    return out


def test_position_scores_match_numpy(spark):
    rows = [(d, p, i, int(i).to_bytes(4, "little")) for d, ids in enumerate(([5, 6, 7, 8, 5, 6, 7, 9, 1], [1, 2], [0] * 9)) for p, i in enumerate(ids)]
    df = spark.createDataFrame([(a, b, "t", c, bytearray(e)) for a, b, c, e in rows], "doc_id long, pos int, token string, tok_id int, le binary")
    got = {(r["doc_id"], r["pos"]): r["y"] for r in detect.position_scores(df, EXAMPLE_KEY).collect()}
    for d, ids in enumerate(([5, 6, 7, 8, 5, 6, 7, 9, 1], [1, 2], [0] * 9)):
        for p, y in enumerate(slow_scores(ids)):
            assert got[d, p] == (None if y is None else pytest.approx(y, rel=1e-12))


def test_documents_are_scored_where_they_lie(spark):
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 4, n).tolist() for n in (0, 2, 3, 119, 120, 121, 450, 700)] + [[2**31 - 1, 7] * 5]
    lists = spark.createDataFrame(list(enumerate(texts)), "doc_id long, ids array<int>").coalesce(1)
    slow = [slow_scores(ids) for ids in texts]
    totals, windows = detect.document_scores(lists, EXAMPLE_KEY), detect.document_windows(lists, EXAMPLE_KEY)
    for r in totals.collect():
        own = [y for y in slow[r["doc_id"]] if y is not None]
        assert (r["n_tokens"], r["n_scored"]) == (len(texts[r["doc_id"]]), len(own)) and r["statistic"] == pytest.approx(sum(own), rel=1e-12)
    found = windows.collect()
    for r in found:
        own = [y for y in slow[r["doc_id"]][r["start"] : r["end"]] if y is not None]
        assert r["n_scored"] == len(own) and r["statistic"] == pytest.approx(sum(own), rel=1e-12)
        assert r["_send"] - r["_sbefore"] == pytest.approx(sum(own), rel=1e-9) and r["_cend"] - r["_cbefore"] == len(own)
    key = lambda rows: sorted((r["doc_id"], r["start"], r["end"], r["n_windows"], r["n_scored"], round(r["statistic"], 9)) for r in rows)
    assert key(found) == key(detect.windows(detect.position_scores(lists, EXAMPLE_KEY)).collect())
    assert {(r["doc_id"], r["pos"]) for r in detect.scored_positions(lists, ["u"], EXAMPLE_KEY).collect()} == {(d, p) for d, ys in enumerate(slow) for p, y in enumerate(ys) if y is not None}
    assert list(detect._runs(np.array([3, 0, 9, 1, 1]), 4)) == [(0, 2, 0, 3), (2, 3, 3, 12), (3, 5, 12, 14)]


def test_positions_are_not_shuffled(spark):
    for name in ("prf_seeds", "prf_block_column", "prf_cost_uniform", "context_first_occurrence", "position_scores", "localize_windows", "bigram_counts"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("Exchange") == (name == "bigram_counts"), name


def test_records_are_hashed_once_after_they_are_numbered(spark):
    plan = catalog.QUERIES["sign_records"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("translate(") == 3 and plan.count("ArrowEvalPython [_nfkc") == 1  # the three of one canonical form


def test_trigrams_are_dealt_out_once_by_context(spark, docs):
    lists = ngrams.token_lists(docs.unionByName(spark.createDataFrame([(-1, None), (-2, "one two"), (-3, "")], "doc_id long, text string")), "text")
    vocab = ngrams.vocabulary(ngrams.token_table(lists, None), 50)
    counted = ngrams.trigram_counts_by_context(lists, vocab)
    key = lambda df: sorted((r["w1"], r["w2"], r["w"], r["cnt"]) for r in df.collect())
    assert key(counted) == key(ngrams.trigram_counts(ngrams.ngram_rows(ngrams.encode(ngrams.token_table(lists, None), vocab))))
    plan = ngrams._with_totals(counted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(w1" in plan


def test_documents_without_scores(spark, model):
    texts = spark.createDataFrame([(1, ""), (2, "one two"), (3, None)], "doc_id long, text string")
    found = evaluate.detect_table(texts, model[0], EXAMPLE_KEY).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 2, 3]
    assert all(r["p_value"] == 1 and r["z_score"] == 0 and not r["detected"] for r in found)
    scores = detect.position_scores(ngrams.encode(ngrams.token_table(ngrams.canonical_docs(texts)), model[0]), EXAMPLE_KEY)
    assert {r["threshold"] for r in detect.detections(scores, threshold=True).collect()} == {math.inf}


def test_marked_text_is_detected_and_plain_is_not(docs, model, marked):
    vocab, _ = model
    found = evaluate.detect_table(marked, vocab, EXAMPLE_KEY).where("n_scored > 50").collect()  # a text that loops has few contexts
    assert len(found) >= 4 and all(r["p_value"] < 1e-6 and r["z_score"] > 4 for r in found)
    wrong = evaluate.detect_table(marked, vocab, bytes(range(32, 64))).collect()
    assert sum(r["p_value"] < 1e-3 for r in wrong) == 0
    null = evaluate.detect_table(docs, vocab, EXAMPLE_KEY).where("n_scored > 30")
    assert null.where("detected").count() <= 0.06 * null.count()
    p = np.sort([r["p_value"] for r in null.collect()])
    assert np.abs(p - np.arange(1, len(p) + 1) / len(p)).max() < 0.2
    both = detect.detections(detect.position_scores(ngrams.encode(ngrams.token_table(ngrams.canonical_docs(marked)), vocab), EXAMPLE_KEY), threshold=True)
    assert both.where("detected <> (p_value < alpha)").count() == 0


def test_windows(spark):
    def starts(n, window=120, stride=30):
        df = spark.createDataFrame([(1, i, True, 1.0) for i in range(n)], "doc_id long, pos int, scored boolean, y double")
        return sorted((r["start"], r["end"], r["n_windows"], r["n_scored"], r["statistic"]) for r in detect.windows(df, window, stride).collect())

    assert starts(100) == [(0, 100, 1, 100, 100.0)]
    assert [s[0] for s in starts(200)] == [0, 30, 60, 80] and {s[2] for s in starts(200)} == {4}
    assert all(s[3] == 120 and s[4] == 120.0 for s in starts(200))
    assert starts(0) == []


def test_touching_windows_merge(spark):
    rows = [(1, a, a + 40, 9, 40, 400.0, 0.0, 400.0, 0, 40) for a in (0, 40)] + [(1, 90, 130, 9, 40, 400.0, 0.0, 400.0, 0, 40)]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, n_windows int, n_scored int, statistic double, _sbefore double, _send double, _cbefore int, _cend int")
    assert sorted((r["token_start"], r["token_end"]) for r in detect.segments(df).collect()) == [(0, 80), (90, 130)]


def test_marked_span_is_localised(spark, docs, model, marked):
    human = docs.where(F.length("text") > 3000).orderBy("doc_id").first()["text"][:1500]
    one = marked.where("doc_id = 0").first()["text"]
    texts = spark.createDataFrame([(7, f"{human} {one} {human}")], "doc_id long, text string")
    canon = ngrams.canonical_docs(texts)
    found = detect.with_text(evaluate.localized(texts, model[0], EXAMPLE_KEY, window=60, stride=15), canon).collect()
    assert found and max(f["n_scored"] for f in found) > 60
    body = canon.first()["canon"]
    assert all(body[f["char_start"] : f["char_end"]] == f["text"] for f in found)
    assert any(len(set(f["text"].split()) & set(one.split())) > 20 for f in found)


def test_canonical_text_undoes_hidden_characters(docs, model, marked):
    vocab, _ = model
    hidden = attacks.apply(marked, attacks.SWEEP[2]).select("doc_id", F.col("attacked_text").alias("text"))
    clean = {r["doc_id"]: r["z_score"] for r in evaluate.detect_table(marked, vocab, EXAMPLE_KEY).collect()}
    hard = {r["doc_id"]: r["z_score"] for r in evaluate.detect_table(hidden, vocab, EXAMPLE_KEY).collect()}
    naive = {r["doc_id"]: r["z_score"] for r in evaluate.detect_table(hidden, vocab, EXAMPLE_KEY, canonical=False).collect()}
    assert hard == clean and np.mean(list(naive.values())) < 0.6 * np.mean(list(clean.values()))


def test_attacks(spark, docs, model):
    some = docs.where(F.length("text") > 400).orderBy("doc_id").limit(8)
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    pool = spark.createDataFrame([(0, "One sentence stands here. Another follows it! And a third (short) one.")], "slot long, text string")
    out = attacks.sweep(some, attacks.catalog(), model[1], pool)
    assert out.select("attack").distinct().count() == 13
    again = attacks.sweep(some.repartition(5), attacks.catalog(), model[1], pool)
    key = lambda df: sorted((r["attack"], r["doc_id"], r["attacked_text"]) for r in df.collect())
    assert key(out) == key(again)
    rows = {(r["attack"], r["doc_id"]): r for r in out.collect()}
    for d, t in texts.items():
        assert rows["identity", d]["attacked_text"] == t
        assert len(rows["zero_width p=0.5", d]["attacked_text"]) > len(t)
        assert len(rows["homoglyph p=0.3", d]["attacked_text"]) == len(t) and rows["homoglyph p=0.3", d]["attacked_text"] != t
        span = rows["dilute 3x", d]
        assert t in span["attacked_text"] and span["span_end"] > span["span_start"] >= 0
    assert not attacks.catalog(llm=True)[-1].kind.startswith("dilute") and len(attacks.catalog(quick=True)) == 5
    with pytest.raises(NotImplementedError):
        attacks.apply(some, attacks.SWEEP[-1], model[1])
    assert generate.NGramModel is type(model[1])


def test_short_texts_are_left_alone(model):
    lm = model[1]
    assert attacks.rewrite_ids(lm, [1, 2, 3, 4], 0, 0) == ([1, 2, 3, 4], {"changed": 0})
    assert attacks.piggyback_ids(lm, [1, 2, 3, 4, 5, 6], 0, 0) == ([1, 2, 3, 4, 5, 6], {"k": 0})
    assert attacks.insert_ids(lm, [], 0, 0) == ([], {"inserted": 0})
    ids, meta = attacks.rewrite_ids(lm, list(range(1, 60)), 0, 0, 0.5)
    assert meta["changed"] == round(0.5 * 56) and ids[:3] == [1, 2, 3] and 20 < sum(a != b for a, b in zip(ids, range(1, 60), strict=True)) <= 28
    ids, meta = attacks.insert_ids(lm, list(range(1, 200)), 0, 0, 0.3)
    assert len(ids) == 199 + meta["inserted"] and 30 < meta["inserted"] < 90
    left = iter(ids)
    assert all(any(x == t for x in left) for t in range(1, 200))  # the old tokens stand in order


def test_places_are_drawn_after_those_they_depend_on():
    waves = attacks._waves(np.array([3, 4, 5, 9, 12, 13]))
    order = {int(p): w for w, places in enumerate(waves) for p in places}
    assert order == {3: 0, 4: 1, 5: 2, 9: 0, 12: 0, 13: 1}


def test_language_model_matches_its_definition(model):
    lm = model[1]
    texts = [[], [3], [3, 4], [0, 0], [11, 12, 13]]
    p = lm.distributions(texts)
    assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()
    count = lambda table, at: (table.token[table.start[at] : table.start[at + 1]], table.kept[table.start[at] : table.start[at + 1]], table.passed[at])
    for row, ids in zip(p, texts, strict=True):
        slow = lm.unigrams.copy()
        for table, key in ((lm.pairs, ids[-1] if ids else None), (lm.triples, ids[-2] * lm.vocab_size + ids[-1] if len(ids) > 1 else None)):
            at = np.flatnonzero(table.context == key) if key is not None else []
            if len(at):
                token, kept, passed = count(table, at[0])
                slow = slow * passed
                slow[token] += kept
        assert np.allclose(row, slow / slow.sum(), atol=1e-12)


def test_generation_does_not_depend_on_the_batch(model):
    lm = model[1]
    prompts, owners = [[5, 6], [7], [], [8, 9, 10]], [1, 2, 3, 4]
    ids, beta, share = generate.continued(lm, prompts, owners, 30, EXAMPLE_KEY)
    for i in range(4):
        own, b, s = generate.continued(lm, prompts[i : i + 1], owners[i : i + 1], 30, EXAMPLE_KEY)
        assert own[0] == ids[i] and b[0] == pytest.approx(beta[i]) and s[0] == share[i]
    assert share[2] >= 1 / 30  # the first step has no context
    other = generate.continued(lm, prompts, owners, 30, EXAMPLE_KEY, seed=1)[0]
    assert all(a != b for a, b in zip(ids, other, strict=True))


def test_a_provided_model_generates_and_edits(spark):
    def scores(texts):
        return np.array([[float(i % 7 == len(t) % 7) for i in range(50)] for t in texts])

    def chatter(instruction, limit, seed):
        return f" {seed} {limit} " + instruction.split("\n\n")[-1].upper()

    lm = ProvidedModel([f"t{i}" for i in range(50)], scores, chatter, eos_id=49)
    prompts = spark.createDataFrame([(i, [1, 2]) for i in range(3)], "doc_id long, prompt array<int>")
    made = generate.generate(prompts, lm, 20, EXAMPLE_KEY).collect()
    assert len(made) == 3 and all(len(r["ids"]) <= 20 and 49 not in r["ids"] and r["mean_beta"] > 0 for r in made)
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["attacked_text"] for r in attacks.apply(docs, attacks.SWEEP[-2], lm).collect()}
    assert found == {1: "1 70 SOME WORDS", 2: None}
    there = {r["doc_id"]: r["attacked_text"] for r in attacks.apply(docs, attacks.SWEEP[-1], lm).collect()}
    assert there[1].startswith("2 ") and there[1].endswith("SOME WORDS")
    assert attacks.apply(docs.where("doc_id = 1"), attacks.SWEEP[5], lm).count() == 1
    for broken in (ProvidedModel(["a"]),):
        with pytest.raises(NotImplementedError):
            broken.paraphrase("x")
        with pytest.raises(NotImplementedError):
            broken.distributions([[0]])


def test_ids_are_gapless_and_ordered_for_many_rows(spark):
    n = 1_500_000
    rows = spark.range(n, numPartitions=12).select(F.xxhash64("id").alias("k"), F.pmod("id", F.lit(3)).alias("hot"))
    found = materialize(registry.assign_ids(rows, ["hot", "k"], 10), "ids")
    assert found.agg(F.min("id"), F.max("id"), F.approx_count_distinct("id") > 0, F.sum("id")).first() == (11, n + 10, True, n * (n + 21) // 2)
    assert found.groupBy("id").count().where("count > 1").count() == 0
    assert found.groupBy("hot").agg(F.min("id"), F.max("id")).orderBy("hot").collect()[1][1:] == (n // 3 + 11, 2 * n // 3 + 10)
    assert [r["k"] for r in found.orderBy("id").limit(500).collect()] == [r["k"] for r in rows.where("hot = 0").orderBy("k").limit(500).collect()]
    few = registry.assign_ids(rows.where("k % 100 = 0"), ["hot"])
    assert few.agg(F.max("id"), F.countDistinct("id")).first() == (few.count(),) * 2
    assert registry.assign_ids(rows.limit(0), ["k"]).count() == 0


def test_training_documents_are_bounded(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat_ws(' ', 'a', 'b', 'c', id) AS canon")
    few = generate.training_documents(docs, 4000)
    assert 700 < few.count() < 1300 and few.exceptAll(docs).count() == 0
    assert generate.training_documents(docs, 10**6).count() == 4000


def test_registry_verdicts(spark):
    originals = [("a", "The quick brown fox jumps over the lazy dog. It was seen again on Monday! Nobody knew why."), ("b", "A second text stands here, longer than it needs to be. It has two sentences."), ("c", "A second text stands here, longer than it needs to be. It has two sentences.")]
    secret = ed25519.new_secret()
    records = materialize(registry.register(spark.createDataFrame(originals, "name string, text string"), secret, "2024-01-01T00:00:00Z", "m"), "records")
    assert [r["id"] for r in records.orderBy("id").collect()] == [1, 2, 3]
    index = retrieval.embedded(retrieval.sentences(records.select(F.col("id").alias("doc_id"), text.canonicalize(F.col("text")).alias("canon"))))
    fox = originals[0][1]
    suspects = [(1, fox), (2, fox[:5] + "​" + fox[5:]), (3, fox.replace("lazy", "sleepy")), (4, "Completely unrelated words about cooking pasta."), (5, originals[1][1])]
    found = {r["doc_id"]: r for r in registry.verify(spark.createDataFrame(suspects, "doc_id long, text string"), records, index, ed25519.public_key(secret)).collect()}
    assert [found[i]["status"] for i in range(1, 6)] == ["exact", "normalized", "tampered", "unknown", "exact"]
    assert found[5]["record_id"] == 2 and found[3]["record_id"] == 1 and found[3]["signature_valid"] and found[1]["signature_valid"]
    assert [(d["op"], d["original"], d["suspect"]) for d in found[3]["diff"]] == [("replace", "lazy", "sleepy")] and found[3]["changed_fraction"] == pytest.approx(1 / 18)
    forged = registry.verify(spark.createDataFrame(suspects[:1], "doc_id long, text string"), records.withColumn("model", F.lit("other")), None, ed25519.public_key(secret)).first()
    assert forged["status"] == "exact" and not forged["signature_valid"]
    plain = registry.verify(spark.createDataFrame(suspects[2:3], "doc_id long, text string"), records).first()
    assert plain["status"] == "unknown" and plain["similarity"] == 0
    with pytest.raises(RuntimeError):
        registry.register(spark.createDataFrame(originals, "name string, text string"), None, "x")


def test_hashed_features_match_their_definition(spark):
    sents = spark.createDataFrame([(1, 0, "Ein  Satz über Äpfel."), (1, 1, "ab"), (2, 0, "the the the the")], "doc_id long, sent_idx int, sentence string")
    vecs = {(r["doc_id"], r["sent_idx"]): r["vec"] for r in retrieval.embedded(sents).collect()}
    for r in sents.collect():
        signed = Counter()
        padded = f" {' '.join(r['sentence'].lower().split())} "
        for n, i in [(n, i) for n in (3, 4, 5) for i in range(len(padded) - n + 1)]:
            h = zlib.crc32(padded[i : i + n].encode())
            signed[(h >> 1) % retrieval.DIM] += 2 * (h & 1) - 1
        want = np.zeros(retrieval.DIM)
        for bucket, v in signed.items():
            want[bucket] = math.copysign(math.log1p(abs(v)), v) if v else 0
        assert np.allclose(vecs[r["doc_id"], r["sent_idx"]], want / np.linalg.norm(want), atol=1e-6)


def test_dense_search_over_several_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    monkeypatch.setattr(retrieval, "CHUNK", 32)
    x = np.random.default_rng(0).standard_normal((150, 6)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    found = {}
    for r in retrieval.dense_topk(rows.where("id < 70").withColumnRenamed("id", "qid"), rows, 5).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append(r["id"])
    s = x[:70].astype(float) @ x.astype(float).T
    assert found == {q: np.argsort(-s[q], kind="stable")[:5].tolist() for q in range(70)}
    assert retrieval.dense_topk(rows.limit(0).withColumnRenamed("id", "qid"), rows).count() == 0


def test_product_of_a_block_takes_little_memory():
    tracemalloc.start()
    rng = np.random.default_rng(3)
    x, q = rng.integers(-3, 4, (16_384, 64)).astype(np.float32), rng.integers(-3, 4, (700, 64)).astype(np.float32)
    x[5000:9000] = x[0]  # as many ties as one piece has rows
    vectors = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float32()))
    ids = rng.permutation(len(x))
    rows, ask = pa.table({"id": ids, "vec": vectors(x)}), pa.table({"qid": np.arange(len(q)), "vec": vectors(q)})
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    found = retrieval._product(ask, rows, 8)
    assert tracemalloc.get_traced_memory()[1] - before < 120e6
    tracemalloc.stop()
    exact = q.astype(float) @ x.astype(float).T
    for i in range(0, 700, 7):
        assert found.column("id").to_numpy()[8 * i : 8 * i + 8].tolist() == ids[np.lexsort((ids, -exact[i]))[:8]].tolist()
    assert retrieval._product(ask.slice(0, 0), rows, 8).num_rows == 0 == retrieval._product(ask, rows.slice(0, 0), 8).num_rows
    wide = pa.table({"id": np.arange(3_000), "vec": vectors(rng.standard_normal((3_000, 4_096), np.float32))})  # sentence vectors, 49 MB
    tracemalloc.start()
    assert retrieval._product(wide.slice(0, 600).rename_columns(["qid", "vec"]), wide, 8).num_rows == 4_800
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    with pytest.raises(ValueError, match="of one length"):
        retrieval._product(ask, pa.table({"id": [1, 2], "vec": pa.array([[1.0], [1.0, 2.0]])}), 8)


def test_another_embedder_plugs_in(spark):
    sents = spark.createDataFrame([(1, 0, "abc"), (2, 0, "z")], "doc_id long, sent_idx int, sentence string")
    vecs = {r["doc_id"]: r["vec"] for r in retrieval.embedded(sents, lambda texts: [[len(t), 1.0] for t in texts]).collect()}
    assert vecs == {1: [3.0, 1.0], 2: [1.0, 1.0]}


def test_sources_round_trip(spark, tmp_path):
    for name, body in (("b", "second"), ("a", "first")):
        (tmp_path / f"{name}.txt").write_text(body)
    assert [(r["doc_id"], r["text"]) for r in corpus.text_files(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(1, "first"), (2, "second")]
    rows = spark.createDataFrame([(1, "x")], "k long, text string")
    for _ in range(2):
        start = corpus.last_id(spark, f"{tmp_path}/records") if (tmp_path / "records").exists() else 0
        corpus.append_records(registry.register(rows, bytes(32), "t", start=start), f"{tmp_path}/records")
    assert sorted(r["id"] for r in corpus.records(spark, f"{tmp_path}/records").collect()) == [1, 2]
    corpus.save_index(retrieval.embedded(spark.createDataFrame([(1, 0, "a sentence")], "doc_id long, sent_idx int, sentence string")), f"{tmp_path}/index")
    assert corpus.load_index(spark, f"{tmp_path}/index").count() == 1
    with pytest.raises(ValueError):
        corpus.load_index(spark, f"{tmp_path}/index", "other")
    corpus.save_key(bytes(32), f"{tmp_path}/key.pem")
    assert corpus.load_key(f"{tmp_path}/key.pem") == bytes(32)
    assert corpus.insert_table("x<!-- results -->old<!-- /results -->y", "new") == "x<!-- results -->\nnew<!-- /results -->y"


def test_streams(spark, docs, model, tmp_path):
    docs.where("doc_id < 20").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    sink = lambda df, epoch: df.write.mode("append").parquet(f"{tmp_path}/out")
    query = stream.writeStream.foreachBatch(streaming.detect_batches(model[0], EXAMPLE_KEY, sink)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(60)
    batch = evaluate.detect_table(docs.where("doc_id < 20"), model[0], EXAMPLE_KEY)
    assert sorted((r["doc_id"], r["n_scored"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted((r["doc_id"], r["n_scored"]) for r in batch.collect())
    records = docs.where("doc_id < 5").select(F.col("doc_id").alias("id"), "text", F.sha2(F.encode(text.canonicalize(F.col("text")), "UTF-8"), 256).alias("canonical_hash"))
    query = streaming.lookup_stream(stream, records).writeStream.format("memory").queryName("verdicts").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("verdicts").where("status = 'exact'").count() >= 5


def test_demo_report(spark, docs, tmp_path):
    report, about = demo(spark, docs, MarkConfig(), 3, 120, str(tmp_path / "demo"), quick=True)
    assert about["generation"]["distinct_outputs"] == 1 and about["null"]["n"] == 6 and len(about["null"]["scores"]) == 6
    assert about["human_verdicts"] == {"unknown": 3} and len(about["samples"]) == 2 and about["config"]["alpha"] == 0.01
    rows = {r["attack"]: r for r in report.collect()}
    assert len(rows) == 5
    same = rows["identity"]
    assert same["registry_exact"] == 1 and same["tpr_analytic_hardened"] == 1 and same["retrieval_recall_at_1"] == 1 and same["auc_hardened"] > 0.9
    assert rows["homoglyph p=0.3"]["registry_normalized"] == 1
    assert rows["dilute 3x"]["localization_mean_iou"] is not None
    assert "identity" in corpus.report_markdown(report) and '"attacks"' in corpus.report_json(report)


def test_fingerprint_does_not_depend_on_order(docs):
    assert corpus.model_fingerprint(docs, 10) == corpus.model_fingerprint(docs.repartition(3), 10) != corpus.model_fingerprint(docs, 11)
    assert len(hashlib.sha256(b"").hexdigest()) == 64


def test_couplings_cover_every_position_of_whole_texts(spark, model):
    lm, c = model[1], MarkConfig()
    texts = {1: lm.tokens[1:12], 2: ["the", "of", "the", "of", "the", "of", "zzzz"], 3: ["the"], 4: [], 5: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, tokens array<string>")
    found = {(r["doc_id"], r["pos"]): r for r in generate.couplings(docs, lm, EXAMPLE_KEY).collect()}
    assert set(found) == {(d, t) for d, tokens in texts.items() for t in range(len(tokens or []))}
    for (d, t), r in found.items():
        ids = lm.encode(texts[d][: t + 1])
        p = lm.distributions([ids])
        _, mass, cost, _ = generate.problems(p, [tuple(ids[-3:])], EXAMPLE_KEY, c)
        direct = transport.couple(mass, cost, transport.entropies(p), c.beta)
        assert (r["status"], r["iterations"]) == (direct.status[0], direct.rounds[0])
        assert np.allclose(r["coupling"], direct.table[0], atol=1e-9) and r["beta_achieved"] == pytest.approx(direct.achieved[0])


def test_the_couplings_query_has_every_token_of_the_benchmark(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), F.posexplode(text.tokenize(F.col("text"))).alias("pos", "token"))
    found = [tuple(r) for r in catalog.QUERIES["transport_couplings"](spark, SF).select("doc_id", "pos").collect()]
    assert sorted(found) == sorted(tuple(r) for r in items.select("doc_id", "pos").collect())


def test_human_windows_are_spread_over_all_places(spark):
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(400))), (2, " ".join(f"b{i}" for i in range(100))), (3, "c0 c1"), (4, "")], "doc_id long, canon string")
    found = [r["text"].split() for r in evaluate.human_windows(docs, 600, 20).collect()]
    assert len(found) == 600
    held = Counter(w[0][0] for w in found)
    assert 0.74 < held["a"] / 600 < 0.88 and 0.1 < held["b"] / 600 < 0.24  # 381 and 81 places of 463
    assert all(len(w) == (2 if w[0][0] == "c" else 20) for w in found) and len({w[0] for w in found}) > 250
    assert [r["text"] for r in evaluate.human_windows(docs, 9, 20).orderBy("doc_id").collect()] == [" ".join(w) for w in (r["text"].split() for r in evaluate.human_windows(docs.repartition(3), 9, 20).orderBy("doc_id").collect())]


def test_command_line(spark, docs, tmp_path, capsys):
    few = docs.where("doc_id < 40")
    few.write.parquet(f"{tmp_path}/few.parquet")
    table, key = f"{tmp_path}/few.parquet", bytes(range(32)).hex()
    assert main(["keygen"]) == 0 and len(bytes.fromhex(capsys.readouterr().out.strip())) == 32
    args = ["--corpus", table, "--key-hex", key, "--model", f"{tmp_path}/tables"]
    assert main(["generate", *args, "--tokens", "160", "--prompt", "the of", "--temperature", "1.1", "--top-p", "0.98"]) == 0
    body = capsys.readouterr().out
    (tmp_path / "body.txt").write_text(body)
    assert main(["detect", *args, "--file", f"{tmp_path}/body.txt"]) == 0
    assert json.loads(capsys.readouterr().out)["detected"]
    assert main(["localize", *args, "--file", f"{tmp_path}/body.txt", "--window", "60", "--stride", "15"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["n_windows"] > 1 and found["segments"]
    for bad in (["detect", "--corpus", table], ["generate", "--corpus", table, "--key-hex", key, "--backend", "nothing"]):
        with pytest.raises((SystemExit, ValueError)):
            main(bad)
