"""Command line: ingest, index, generate, evaluate, ask, chat, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import asked, benchmark, chunks, evalset, factbase, features, metrics, models, reader, retrieval
from .operators.calibrate import Policy, _strict
from .operators.settle import release, scratch
from .plans import pipeline
from .sources import documents, figures, store

NEVER = float("inf")


def session(app: str = "tessera") -> SparkSession:
    return SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def ingest(args, spark: SparkSession) -> int:
    """Documents (Parquet with doc_id, text, or a folder of files) to a chunk table."""
    if args.format == "parquet":
        docs = spark.read.parquet(args.input)
        title = F.col(args.title) if args.title else F.col("doc_id").cast("string")
        rows = chunks.chunk_texts(docs.select("doc_id", title.alias("title"), "text"), args.chunk_size, args.chunk_overlap)
    else:
        scanned = documents.scan_files(spark, args.input, extract=documents.pdf_text if args.format == "pdf" else documents.plain_text, glob="*.pdf" if args.format == "pdf" else "*.txt")
        for r in scanned.where("problem IS NOT NULL").select("file", "problem").limit(20).collect():
            print(f"skipped {r['file']}: {r['problem']}", file=sys.stderr)
        number = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 38))
        rows = chunks.chunk_pages(scanned.where("problem IS NULL").select("doc_id", "title", "pages"), args.chunk_size, args.chunk_overlap)
        chunks_pos = rows.withColumn("pos", number * F.lit(1 << 24) + F.col("chunk_index"))
        chunks_pos.write.mode("overwrite").parquet(args.output)
        return 0
    chunks.with_pos(rows).write.mode("overwrite").parquet(args.output)
    return 0


def index(args, spark: SparkSession) -> int:
    config = store.save_retriever(spark.read.parquet(args.chunks), args.output)
    print(f"{config.num_chunks} chunks indexed in {args.output}")
    return 0


def generate(args, spark: SparkSession) -> int:
    """An evaluation set from the chunks; engine facts writes its own chunks there first."""
    quotas = {c: getattr(args, c) for c in evalset.CATEGORIES}
    if args.engine == "facts":
        table = factbase.fact_table(spark, args.reports, args.seed)
        docs = factbase.reports(table)
        rows = chunks.chunk_texts(docs)
        rows.withColumn("pos", F.substring("doc_id", 8, 20).cast("long") * F.lit(1 << 24) + F.col("chunk_index")).write.mode("overwrite").parquet(args.chunks)
        rows = spark.read.parquet(args.chunks)
        drafts = factbase.template_items(factbase.linked(table, docs, rows), rows, quotas, args.seed)
    elif args.engine == "written":
        rows = spark.read.parquet(args.chunks)
        find = models.search_with(rows.select("pos", "text"))
        search = lambda q, k: find(q, k).join(rows.select("pos", "chunk_id", "text"), "pos").select("query_id", "rank", "chunk_id", "text")
        drafts = asked.write_questions(rows, _client(args), quotas, args.seed, search, progress=_progress("questions") if args.progress else None).drafts
    else:
        rows = spark.read.parquet(args.chunks)
        drafts = evalset.extractive_items(rows, quotas, args.seed)
    found = store.fingerprint(rows, "pos", ["chunk_id", "text"]).first()
    made = evalset.assemble(drafts, {"path": args.chunks, "num_chunks": found["n"], "sha256": found["digest"]}, args.engine, args.seed)
    made.check(spark)
    store.write_text(spark, made.to_json(), args.output)
    print(made.summary())
    return 0


def _progress(label: str):
    """Tells standard error how much is done."""
    return lambda done, wanted: print(f"\r{label}: {done}/{wanted}", end="\n" if done == wanted else "", file=sys.stderr, flush=True)


def _client(args) -> reader.Client:
    if not args.reader_url or not args.reader_model:
        raise SystemExit("a language model needs --reader-url and --reader-model (or use --offline)")
    kind = models.BlocksClient if args.reader_style == "blocks" else models.ChatClient
    return kind(args.reader_model, args.reader_url, os.environ.get(args.reader_key_env) if args.reader_key_env else None)


def plugs(args) -> dict:
    """What stands in for the built-in parts, as keywords of pipeline.answer. --offline leaves all of them built in."""
    if args.offline:
        args.encoder = args.reranker = args.reader_url = None
    out: dict = {}
    if args.encoder:
        out["dense"] = models.Embedded(models.SentenceEncoder(args.encoder)).search
    try:
        if args.reranker:
            out["score"] = models.Reranker(args.reranker, args.allow_fallback).score
        if args.reader_url:
            out["read"], _, _ = models.reading(_client(args), args.allow_fallback)
    except RuntimeError as e:
        raise SystemExit(f"{e}; --allow-fallback or --offline do without") from e
    return out


def load_items(spark: SparkSession, path: str) -> tuple[evalset.EvalSet, DataFrame]:
    """The set, and its items as the pipeline takes them; item numbers follow the file."""
    found = evalset.EvalSet.from_json(store.read_text(spark, path))
    rows = [(i, x["question"], x["reference_answer"], x["is_answerable"], x["category"], x["ground_truth_chunk_ids"]) for i, x in enumerate(found.items)]
    return found, spark.createDataFrame(rows, "query_id long, text string, reference string, answerable boolean, category string, gold array<string>")


def _corpus_warning(spark, rows: DataFrame, found: evalset.EvalSet) -> None:
    if store.fingerprint(rows, "pos", ["chunk_id", "text"]).first()["digest"] != found.corpus.get("sha256"):
        print("warning: the evaluation set was made from another corpus", file=sys.stderr)


def evaluate(args, spark: SparkSession) -> int:
    """retrieval, abstention or end-to-end report, as JSON and Markdown."""
    rows = spark.read.parquet(args.chunks)
    found, items = load_items(spark, args.eval_set)
    _corpus_warning(spark, rows, found)
    records = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    corpus = rows.select("pos", "text")
    gold = items.select("query_id", F.explode("gold").alias("chunk_id")).join(rows.select("chunk_id", "pos"), "chunk_id").select("query_id", "pos")
    splits = benchmark.stratified_splits(items.select(F.col("query_id").alias("item"), "category"), args.splits, args.seed)
    if args.kind == "retrieval":
        report: dict = {}
        for mode in retrieval.MODES:
            per = metrics.ranking_scores(retrieval.hybrid_search(corpus, items.select("query_id", "text"), 10, mode), gold, [1, 3, 5, 10])
            report[mode] = records(benchmark.bootstrap_mean(per, ["metric"], order="query_id", seed=args.seed))
        report["candidate_recall"] = records(metrics.candidate_recall(retrieval.hybrid_search(corpus, items.select("query_id", "text"), 50), gold))
    elif args.kind == "abstention":
        feats, _, results = features.evidence(corpus, items.select("query_id", "text"))
        labels = features.safe_labels(items, results, gold)
        table = feats.join(labels, "query_id").withColumnsRenamed({"query_id": "item", "safe": "y"}).persist()
        made = benchmark.abstention_benchmark(table, splits, features.FEATURES)
        report = {k: records(v) for k, v in made.items()}
        if args.figures:
            figures.write_figures(spark, args.figures, made["pooled"], made["reliability"])
    else:
        scored = pipeline.score_items(rows, items, progress=_progress("items") if args.progress else None).persist()
        report = {k: records(v) for k, v in benchmark.e2e_benchmark(scored, splits, features.FEATURES).items()}
    store.write_report(spark, report, args.output, f"{args.kind} benchmark")
    print(f"written: {args.output}.json, {args.output}.md")
    return 0


def fit(spark: SparkSession, rows: DataFrame, eval_path: str, method: str = "erm", alpha: float = 0.2, delta: float = 0.1, seed: int = 0) -> Policy:
    """A gate calibrated on end-to-end correctness of the reader that may abstain."""
    found, items = load_items(spark, eval_path)
    scored = benchmark.labelled(pipeline.score_items(rows, items).where("reader = 'free'"))
    return benchmark.fit_policy(scored.select("item", "category", "y", "answered", *features.FEATURES), features.FEATURES, method, alpha, delta, seed)


def gate_text(policy: Policy | None) -> str:
    if policy is None:
        return "no gate"
    s = policy.summary()
    return f"{s['method']} at alpha {s['alpha']}: answer if confidence >= {s['tau']}" + (f" ({s['guarantee']})" if s["guarantee"] else "")


def signals(row: dict, policy: Policy, n: int = 3) -> list[tuple[str, float, float]]:
    """The features that moved this row's confidence most."""
    c = policy.calibrator
    each = [(f, row[f], w * (row[f] - m) / s) for f, m, s, w in zip(c.features, c.mean, c.std, c.coef, strict=True)]
    return sorted(each, key=lambda x: -abs(x[2]))[:n]


def render(row: dict, policy: Policy | None, scores: bool, colour: bool = False, show: int | None = None) -> str:
    """Answer, gate and evidence as three panels; at most `show` quotes, if given."""
    bold = (lambda s: f"\x1b[1m{s}\x1b[0m") if colour else (lambda s: s)
    out = [bold("Answer"), f"  {row['answer']}", bold("Gate"), f"  {gate_text(policy)}"]
    if row["confidence"] is not None:
        out.append(f"  confidence {row['confidence']:.3f}")
        out += [f"  {n} = {v:.3f} ({e:+.2f})" for n, v, e in signals(row, policy)] if policy else []
    if row["stage"]:
        out.append(f"  abstained at: {row['stage']}" + (f" ({row['reason']})" if row["reason"] else ""))
    out.append(bold("Evidence"))
    out += [f"  [{c}] {q}" for c, q in list(zip(row["citations"], row["evidence_quotes"], strict=False))[:show]] or ["  none"]
    if scores:
        out += [f"  {f} = {row[f]:.4f}" for f in features.FEATURES if f in row]
    return "\n".join(out)


def _policy(args, spark: SparkSession, rows: DataFrame) -> Policy | None:
    if args.no_gate:
        return None
    policy = store.load_policy(spark, args.policy) if args.policy else None
    if policy is None and args.calibrate:
        if not args.eval_set:
            raise SystemExit("--calibrate needs --eval-set")
        policy = fit(spark, rows, args.eval_set, args.calibrate, args.alpha, args.delta)
    if policy and args.save_policy:
        store.save_policy(spark, policy, args.save_policy)
    if policy and policy.tau == NEVER:
        print("warning: the threshold is infinite, every question will be held back", file=sys.stderr)
    return policy


def ask_one(spark, rows: DataFrame, question: str, policy: Policy | None, k: int = 3, forced: bool = False, cache: str | None = None, **plugged) -> dict:
    """One answer; with a cache, that of an equal question asked the same way of the same chunks."""
    asked_ = spark.createDataFrame([(0, question)], "query_id long, text string")
    say = lambda q: pipeline.answer(rows, q, policy, k, forced=forced, **plugged)
    if not cache:
        return say(asked_).first().asDict()
    corpus = store.fingerprint(rows, "pos", ["chunk_id", "text"]).first()["digest"]
    parts = [F.lit(str(x)) for x in (corpus, k, forced, policy.to_json() if policy else None, sorted(plugged))]
    keyed = asked_.withColumn("key", tx.cache_key(F.col("text"), *parts))
    read = lambda q: say(q.select("query_id", "text")).join(q.select("query_id", "key"), "query_id").drop("query_id")
    return reader.AnswerCache(spark, cache).answers(keyed, read).first().asDict()


def ask(args, spark: SparkSession) -> int:
    rows = spark.read.parquet(args.chunks)
    policy = _policy(args, spark, rows)
    row = ask_one(spark, rows, args.question, policy, args.k_ctx, args.forced_reader, args.cache, **plugs(args))
    print(json.dumps(_strict(row), ensure_ascii=False) if args.json else render(row, policy, args.scores, sys.stdout.isatty(), args.show))
    return 0


def chat(args, spark: SparkSession, lines=None) -> int:
    """Questions line by line; :k N, :gate on|off, :scores, :json, :help, :quit."""
    rows = spark.read.parquet(args.chunks).persist()
    policy = _policy(args, spark, rows)
    gate, k, scores, as_json = policy, args.k_ctx, args.scores, args.json
    plugged = plugs(args)
    index = retrieval.build_index(rows.select("pos", "text"))
    _ = index.bm25  # one question after the other: postings by token
    for line in lines or sys.stdin:
        line = line.strip()
        word, _, rest = line.partition(" ")
        if not line:
            continue
        if word == ":quit":
            break
        if word == ":k":
            if rest.isdigit() and 1 <= int(rest) <= 10:
                k = int(rest)
            else:
                print(":k takes 1 to 10")
        elif word == ":gate":
            gate = policy if rest == "on" else None
            print(gate_text(gate))
        elif word == ":scores":
            scores = not scores
        elif word == ":json":
            as_json = not as_json
        elif word.startswith(":"):
            print(":k N, :gate on|off, :scores, :json, :quit")
        else:
            row = ask_one(spark, rows, line, gate, k, args.forced_reader, args.cache, index=index, **plugged)
            print(json.dumps(_strict(row), ensure_ascii=False) if as_json else render(row, gate, scores, show=args.show))
    return 0


def serve(args, spark: SparkSession) -> int:
    from . import server

    rows = spark.read.parquet(args.chunks)
    calibrate = (lambda **kw: fit(spark, rows, args.eval_set, **kw)) if args.eval_set else None
    service = server.Service(rows, _policy(args, spark, rows), calibrate, server.Settings(args.max_concurrency, token=args.token))
    server.serve(service, args.host, args.port).serve_forever()
    return 0


def _model_flags(s: argparse.ArgumentParser) -> None:
    s.add_argument("--offline", action="store_true", help="built-in encoder, reranker and reader only")
    s.add_argument("--encoder", help="sentence-transformers model for dense retrieval")
    s.add_argument("--reranker", help="cross-encoder model")
    s.add_argument("--reader-url")
    s.add_argument("--reader-model")
    s.add_argument("--reader-style", choices=["chat", "blocks"], default="chat")
    s.add_argument("--reader-key-env", help="environment variable that holds the server's key")
    s.add_argument("--allow-fallback", action="store_true", help="do without a model that can't be used")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("ingest", help="documents to chunks")
    s.add_argument("input")
    s.add_argument("output")
    s.add_argument("--format", choices=["parquet", "pdf", "text"], default="parquet")
    s.add_argument("--title")
    s.add_argument("--chunk-size", type=int, default=512)
    s.add_argument("--chunk-overlap", type=int, default=64)
    s.set_defaults(run=ingest)
    s = sub.add_parser("index", help="store the retriever's tables")
    s.add_argument("chunks")
    s.add_argument("output")
    s.set_defaults(run=index)
    s = sub.add_parser("generate", help="make an evaluation set from chunks")
    s.add_argument("chunks")
    s.add_argument("output")
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--engine", choices=["extractive", "facts", "written"], default="extractive")
    s.add_argument("--reports", type=int, default=50, help="engine facts: reports to make up")
    s.add_argument("--progress", action="store_true")
    _model_flags(s)
    for c, n in evalset.QUOTAS.items():
        s.add_argument(f"--{c.replace('_', '-')}", type=int, default=n, dest=c)
    s.set_defaults(run=generate)
    s = sub.add_parser("evaluate", help="run a benchmark")
    s.add_argument("kind", choices=["retrieval", "abstention", "end-to-end"])
    s.add_argument("chunks")
    s.add_argument("eval_set")
    s.add_argument("output")
    s.add_argument("--figures", help="folder for the curves of an abstention benchmark")
    s.add_argument("--splits", type=int, default=200)
    s.add_argument("--seed", type=int, default=0)
    s.add_argument("--progress", action="store_true", help="end-to-end: tell how many items are scored")
    s.set_defaults(run=evaluate)
    for name, run in (("ask", ask), ("chat", chat), ("serve", serve)):
        s = sub.add_parser(name)
        s.add_argument("chunks")
        if name == "ask":
            s.add_argument("question")
        gate = s.add_mutually_exclusive_group()
        gate.add_argument("--policy")
        gate.add_argument("--no-gate", action="store_true")
        s.add_argument("--calibrate", choices=["erm", "ltt"])
        s.add_argument("--alpha", type=float, default=0.2)
        s.add_argument("--delta", type=float, default=0.1)
        s.add_argument("--eval-set")
        s.add_argument("--save-policy", help="where to keep the gate that --calibrate fits")
        s.add_argument("--cache", help="table of answers given before")
        s.add_argument("--forced-reader", action="store_true", help="an answer to every question that the gate lets through")
        s.add_argument("--show", type=int, help="quotes to print at most")
        _model_flags(s)
        s.add_argument("--k-ctx", type=int, default=3)
        s.add_argument("--scores", action="store_true")
        s.add_argument("--json", action="store_true")
        if name == "serve":
            s.add_argument("--host", default="127.0.0.1")
            s.add_argument("--port", type=int, default=8000)
            s.add_argument("--max-concurrency", type=int, default=4)
            s.add_argument("--token")
        s.set_defaults(run=run)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    with scratch() as held:
        try:
            return args.run(args, spark)
        finally:
            release(spark, held)


if __name__ == "__main__":
    sys.exit(main())
