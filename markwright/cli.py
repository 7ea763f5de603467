"""Command line: keygen, generate, detect, localize, verify, demo."""

from __future__ import annotations

import argparse
import importlib
import json
import secrets
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwright.functions import ed25519, prf, text
from markwright.operators import attacks, detect, evaluate, generate, ngrams, registry, retrieval
from markwright.operators.config import ALPHA, VOCAB_SIZE, MarkConfig
from markwright.session import get_session, materialize
from markwright.sources import corpus


# Options by name, and the commands that take them.
OPTIONS: dict[str, tuple[str, dict]] = {
    "--corpus": ("generate detect localize demo", {"required": True, "help": "Parquet table of documents (doc_id, text) or a folder of .txt files"}),
    "--key-hex": ("generate detect localize", {"required": True}),
    "--blocks": ("generate detect localize demo", {"type": int, "default": 32}),
    "--columns": ("generate detect localize demo", {"type": int, "default": 16}),
    "--beta": ("generate detect localize demo", {"type": float, "default": 0.5}),
    "--context-window": ("generate detect localize demo", {"type": int, "default": 3}),
    "--backend": ("generate detect localize demo", {"default": "ngram", "help": "ngram, or module:function that returns a model"}),
    "--model": ("generate detect localize demo", {"help": "passed to the function of --backend; with ngram a folder that keeps the tables"}),
    "--seed": ("generate demo", {"type": int, "default": 0}),
    "--tokens": ("generate demo", {"type": int, "default": 200}),
    "--temperature": ("generate demo", {"type": float, "default": 1.0}),
    "--top-p": ("generate demo", {"type": float, "default": 1.0}),
    "--prompt": ("generate", {"default": ""}),
    "--unmarked": ("generate", {"action": "store_true"}),
    "--file": ("detect localize verify", {"help": "the text; standard input without it"}),
    "--alpha": ("detect localize demo", {"type": float, "default": ALPHA}),
    "--no-canonicalize": ("detect localize", {"action": "store_true"}),
    "--window": ("localize", {"type": int, "default": 120}),
    "--stride": ("localize", {"type": int, "default": 30}),
    "--samples": ("demo", {"type": int, "default": 20}),
    "--quick": ("demo", {"action": "store_true"}),
    "--llm": ("demo", {"action": "store_true", "help": "also the edits that need a model that follows instructions"}),
    "--embedder": ("demo verify", {"default": "hashing"}),
    "--out": ("demo verify", {"required": True, "help": "folder of a demo run"}),
}
COMMANDS = {"keygen": "print a new key as hex", "generate": "a marked text", "detect": "test a text", "localize": "find marked spans", "verify": "look a text up among the records of a demo", "demo": "generate, register, attack, report"}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="markwright", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for command, told in COMMANDS.items():
        own = sub.add_parser(command, help=told)
        for name, (takers, more) in OPTIONS.items():
            if command in takers.split():
                own.add_argument(name, **more)
    return top


def _body(args: argparse.Namespace) -> str:
    return Path(args.file).read_text() if args.file else sys.stdin.read()


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("doc_id", "text") if ".parquet" in path else corpus.text_files(spark, path)


def _config(args: argparse.Namespace) -> MarkConfig:
    return MarkConfig(args.blocks, args.columns, args.beta, args.context_window)


TABLES = ("vocab", "unigrams", "bigrams", "trigrams")


def build_model(docs: DataFrame, backend: str = "ngram", model: str | None = None) -> tuple[DataFrame, generate.LanguageModel]:
    """The vocabulary and model of a backend.

    ``ngram`` is trained on the documents; with a folder as ``model``, its tables are kept there under a fingerprint of the
    documents and read back next time.  Any other backend is ``module:function``, called with ``model``.
    """
    spark = docs.sparkSession
    if backend != "ngram":
        module, _, function = backend.partition(":")
        if not function:
            raise ValueError(f"unknown backend {backend!r}")
        made = getattr(importlib.import_module(module), function)(model)
        vocab = spark.createDataFrame(list(enumerate(made.tokens)), "tok_id int, token string")
        return vocab.withColumns({"cnt": F.lit(0).cast("long"), "le": prf.le32(F.col("tok_id"))}), made
    folder = model and f"{model}/{corpus.model_fingerprint(docs, VOCAB_SIZE)}"
    if folder and corpus.has_tables(spark, folder, TABLES):
        kept = corpus.load_tables(spark, folder, list(TABLES))
        return kept["vocab"], generate.NGramModel.from_tables(*(kept[t] for t in TABLES))
    tokens = ngrams.token_table(generate.training_documents(ngrams.canonical_docs(docs)))
    vocab = materialize(ngrams.vocabulary(tokens), "vocab")
    encoded = materialize(ngrams.encode(tokens, vocab), "encoded")
    rows = ngrams.ngram_rows(encoded)
    made = dict(zip(TABLES, (vocab, ngrams.unigram_probs(encoded, vocab), ngrams.bigram_counts(rows), ngrams.trigram_counts(rows)), strict=True))
    if folder:
        corpus.save_tables(made, folder)
        made = corpus.load_tables(spark, folder, list(TABLES))
    return made["vocab"], generate.NGramModel.from_tables(*(made[t] for t in TABLES))


def demo(spark: SparkSession, docs: DataFrame, config: MarkConfig, samples: int, n: int, out: str, seed: int = 0, quick: bool = False, alpha: float = ALPHA, temperature: float = 1.0, top_p: float = 1.0, embedder: str = "hashing", llm: bool = False, backend: str = "ngram", model: str | None = None) -> tuple[DataFrame, dict]:
    """Generate marked and plain texts, register and index the marked ones, attack them and report; also what else a report tells."""
    begun = time.monotonic()
    vocab, lm = build_model(docs, backend, model)
    key, secret, embed = prf.demo_key(seed), ed25519.new_secret(), retrieval.embedder(embedder)
    humans = materialize(evaluate.human_windows(ngrams.canonical_docs(docs), 2 * samples, n, seed), "human-windows")
    null_human, pool = humans.where(F.col("doc_id") < samples), humans.where(F.col("doc_id") >= samples).withColumn("doc_id", F.col("doc_id") - samples)
    heads = pool.select((F.col("doc_id") + 1).alias("doc_id"), F.slice(text.tokenize(text.canonicalize(F.col("text"))), 1, 8).alias("t")).collect()  # one row for each sample
    prompts = spark.createDataFrame([(r["doc_id"], lm.encode(r["t"])) for r in heads], "doc_id long, prompt array<int>").repartition(max(samples // 8, 1))

    def ids(mark: bytes | None, run: int) -> DataFrame:
        return materialize(generate.generate(prompts, lm, n, mark, config, seed + run, temperature, top_p), "generated-ids")

    def made(rows: DataFrame) -> DataFrame:
        named = rows.select("doc_id", F.posexplode("ids").alias("pos", "tok_id")).join(F.broadcast(vocab), "tok_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
        return materialize(named.select("doc_id", text.detokenize(F.col("t.token")).alias("text")), "generated")

    first, second = ids(key, 0), ids(key, 1)
    marked, plain = made(first), made(ids(None, 0))
    nulls = plain.unionByName(null_human.select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    null = materialize(evaluate.detect_table(nulls, vocab, key, config, alpha), "null")
    records = registry.register(marked.select("doc_id", "text"), secret, "2024-01-01T00:00:00Z", backend)
    corpus.append_records(records, f"{out}/records")
    kept = corpus.records(spark, f"{out}/records")
    sents = retrieval.sentences(kept.select(F.col("id").alias("doc_id"), text.canonicalize(F.col("text")).alias("canon")))
    corpus.save_index(retrieval.embedded(sents, embed), f"{out}/index", embedder)
    index = corpus.load_index(spark, f"{out}/index", embedder)
    if "://" not in out:
        corpus.save_key(secret, f"{out}/signing_key.pem")
    public = ed25519.public_key(secret)
    originals = kept.select(F.col("id").alias("doc_id"), "text")
    slots = pool.select(F.col("doc_id").alias("slot"), "text")
    attacked = materialize(attacks.sweep(originals, attacks.catalog(quick, llm), lm, slots, seed), "attacked")
    report = materialize(evaluate.attack_report(attacked, originals, null, vocab, key, config, alpha, kept, index, public), "report")
    told = first.agg(F.avg("mean_beta").alias("mean_beta_achieved"), F.avg("masked_share").alias("masked_context_fraction")).first().asDict()
    about = {
        "config": config.as_dict() | {"samples": samples, "tokens": n, "alpha": alpha, "temperature": temperature, "top_p": top_p, "backend": backend, "embedder": embedder},
        "generation": told | {"distinct_outputs": evaluate.distinct_rate(first, second).first()["rate"]},
        "null": evaluate.null_summary(null, alpha).first().asDict() | {"scores": sorted(r[0] for r in null.select("neg_log10_p").collect())},
        "human_verdicts": {r["status"]: r["count"] for r in registry.verify(null_human, kept, index, public).groupBy("status").count().collect()},
        "samples": [r["text"] for r in marked.orderBy("doc_id").limit(2).collect()],
        "seconds": round(time.monotonic() - begun, 1),
    }
    return report, about


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "keygen":
        print(secrets.token_hex(32))
        return 0
    spark = get_session()
    if args.command == "verify":
        secret = corpus.load_key(f"{args.out}/signing_key.pem")
        index = corpus.load_index(spark, f"{args.out}/index", args.embedder)
        found = registry.verify(corpus.one_text(spark, _body(args)), corpus.records(spark, f"{args.out}/records"), index, ed25519.public_key(secret))
        print(found.toJSON().first())
        return 0
    docs = _documents(spark, args.corpus)
    if args.command == "demo":
        report, about = demo(spark, docs, _config(args), args.samples, args.tokens, args.out, args.seed, args.quick, args.alpha, args.temperature, args.top_p, args.embedder, args.llm, args.backend, args.model)
        Path(args.out).mkdir(parents=True, exist_ok=True)
        Path(args.out, "report.json").write_text(corpus.report_json(report, about))
        Path(args.out, "report.md").write_text(table := corpus.report_markdown(report))
        print(table)
        return 0
    key = prf.check_key(bytes.fromhex(args.key_hex))
    if args.command == "generate":
        _, model = build_model(docs, args.backend, args.model)
        tokens = corpus.one_text(spark, args.prompt).select(text.tokenize(text.canonicalize(F.col("text")))).first()[0]
        prompt = spark.createDataFrame([(0, model.encode(tokens))], "doc_id long, prompt array<int>")
        ids = generate.generate(prompt, model, args.tokens, None if args.unmarked else key, _config(args), args.seed, args.temperature, args.top_p).first()["ids"]
        print(spark.createDataFrame([([model.tokens[i] for i in ids],)], "t array<string>").select(text.detokenize(F.col("t"))).first()[0])
        return 0
    vocab = build_model(docs, args.backend, args.model)[0] if args.model or args.backend != "ngram" else ngrams.vocabulary(ngrams.token_table(ngrams.canonical_docs(docs)))
    one = corpus.one_text(spark, _body(args))
    if args.command == "detect":
        found = evaluate.detect_table(one, vocab, key, _config(args), args.alpha, not args.no_canonicalize)
        print(found.toJSON().first())
    else:
        canon = ngrams.canonical_docs(one) if not args.no_canonicalize else one.select("doc_id", F.col("text").alias("canon"))
        windows = materialize(detect.document_windows(ngrams.token_lists(canon), key, _config(args), args.window, args.stride, vocab), "windows")
        found = detect.with_text(detect.segments(windows, args.window, args.alpha), canon)
        print(json.dumps({"n_windows": windows.count(), "segments": [json.loads(r) for r in found.toJSON().collect()]}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
