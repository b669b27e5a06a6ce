"""Command line: ``python -m spanloom summarize | inspect | compare | validate | models``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ASPECTS, LENGTH_SENTENCES, SETTINGS, aspect_queries
from .operators import compare, report, retrieve, segment, validate
from .operators.backends import EchoGenerator, Generator, summarise
from .operators.summarise import select_chunks, summarise_extractive
from .operators.transport import ChatClient, GenerationError, HttpTransport, LocalModel, required_key
from .sources import files, tables

BACKENDS = ("extractive", "api", "local", "remote", "verified")


def _transport(args: argparse.Namespace) -> HttpTransport:
    if not args.endpoint:
        raise GenerationError("name the server with --endpoint and the variable that holds its key with --key-variable; the extractive backend needs neither")
    return HttpTransport(args.endpoint, required_key(args.key_variable) if args.key_variable else "")


def _generator(name: str, args: argparse.Namespace) -> Generator | None:
    """What answers a backend's prompts: a server, a model's folder, or the stand-in if it is asked for."""
    if name == "extractive":
        return None
    if args.stand_in:
        return EchoGenerator()
    if not args.model:
        raise GenerationError(f"the {name} backend needs --model; the extractive backend needs none, and --stand-in tries out the formats")
    return LocalModel(args.model) if name == "local" else ChatClient(_transport(args), args.model)


def models(spark: SparkSession, args: argparse.Namespace) -> int:
    print("\n".join(_transport(args).models()))
    return 0


def _documents(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.dataset:
        docs = tables.load_corpus(spark, args.dataset, args.path, args.split, args.lang, args.n)
        return docs.select("doc_id", "text", "reference")
    read = files.read_documents(spark, args.path)
    for row in read.where("error is not null").collect():
        print(f"{row['path']}: {row['error']}", file=sys.stderr)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return read.where("error is null").select(name.alias("doc_id"), "text", F.lit(None).cast("string").alias("reference"))


def summarize(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = _documents(spark, args)
    if args.backend == "extractive":
        out = summarise_extractive(docs, args.aspects, args.top_k, args.chunk_budget, args.max_sentences, args.length)
    else:
        out = summarise(docs, args.backend, _generator(args.backend, args), args.aspects, args.top_k, args.chunk_budget, args.length)
    if args.format == "html":
        report.write_pages(out, args.out or "summaries")
        print(f"pages are in {args.out or 'summaries'}")
        return 0
    column = {"text": "report", "json": "json"}[args.format]
    rendered = report.to_text(out) if args.format == "text" else report.to_json(out)
    if args.show_reference:
        rendered = rendered.join(docs.select("doc_id", "reference"), "doc_id")
    for row in rendered.select("doc_id", column, *(["reference"] if args.show_reference else [])).toLocalIterator():
        print(f"\n### {row['doc_id']}\n{row[column]}")
        if args.show_reference and row["reference"]:
            print(f"\nREFERENCE\n{row['reference']}")
    return 0


def inspect(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = _documents(spark, args).select("doc_id", "text").orderBy("doc_id").limit(1)
    chunks = segment.checked(segment.chunks(docs)).orderBy("chunk_ix").collect()
    for c in chunks:
        print(f"  [{c['chunk_ix']:>3}] {c['start']:>6}-{c['end']:<6} {len(c['text']):>5}ch  {' '.join(c['text'].split())[:72]}")
    print(f"{len(chunks)} chunks; each maps back to its place in the source")
    if args.query:
        hits = retrieve.search(segment.chunks(docs), [args.query], args.top_k).orderBy("rank").collect()
        for h in hits:
            print(f"  [{h['chunk_ix']:>3}] score={h['score']:.3f} (dense={h['dense_score']:.3f} bm25={h['sparse_score']:.2f})")
        return 0
    queries = aspect_queries(args.aspects)
    kept = select_chunks(docs, queries, args.top_k, args.chunk_budget).first()
    used = [c["ix"] for c in kept["chunks_used"]] if kept else []
    print(f"aspect sweep ({args.aspects}, {len(queries)} queries) selected {len(used)}/{len(chunks)} chunks: {used}")
    return 0


def compare_(spark: SparkSession, args: argparse.Namespace) -> int:
    names = args.backends.split(",")
    docs = _documents(spark, args)
    rows = compare.timed(docs, {n: _generator(n, args) for n in names}, aspects=args.aspects, reference="reference")
    columns = ["backend", "n_docs", "failed", "sec_per_doc", "rouge1_f1", "rougeL_f1", "attribution_coverage", "citation_integrity", "numeric_fidelity", "error"]
    print(report.format_table(rows, columns))
    return 0


def validate_(spark: SparkSession, args: argparse.Namespace) -> int:
    pairs = tables.positional_pairs(tables.read_csv(spark, args.summaries), tables.read_csv(spark, args.scores))
    if args.limit:
        pairs = pairs.where(F.col("pos") < args.limit)
    rows = validate.validation_rows(pairs).persist()
    found = validate.correlations(rows, validate.AUTOMATIC, validate.HUMAN, "pos")
    for r in found:
        r["rho"], r["p"] = (None if r[k] is None else round(r[k], 3 if k == "rho" else 4) for k in ("rho", "p"))
    print(report.format_table(found, ["metric", "human", "rho", "p"]))
    labels = [r.asDict() for r in validate.label_discrimination(rows, validate.HUMAN).collect()]
    print("\n" + report.format_table(labels, ["label", "mean", "sd", "min", "max", "zero_share"]))
    blocks = [r.asDict() for r in validate.block_means(rows, "pos", validate.HUMAN + validate.AUTOMATIC).orderBy("block").collect()]
    print("\n" + report.format_table(blocks, ["block", "n", *validate.HUMAN, *validate.AUTOMATIC]))
    if args.out:
        tables.write_csv(rows, args.out)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanloom", description="Summaries whose claims carry their source spans.")
    commands = top.add_subparsers(required=True)
    for name, run in (("summarize", summarize), ("inspect", inspect), ("compare", compare_)):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("path", help="files, a folder, or the corpus of --dataset")
        p.add_argument("--dataset", choices=("archive", "dialogues"))
        p.add_argument("-n", type=int, default=None if name == "summarize" else 20)
        p.add_argument("--split", default="auto")
        p.add_argument("--lang", default="en")
        p.add_argument("--aspects", default="generic", choices=sorted(ASPECTS))
        p.add_argument("--top-k", type=int, default=SETTINGS.top_k)
        p.add_argument("--chunk-budget", type=int)
        if name == "summarize":
            p.add_argument("--backend", default="extractive", choices=BACKENDS)
            p.add_argument("--max-sentences", type=int)
            p.add_argument("--length", choices=sorted(LENGTH_SENTENCES))
            p.add_argument("--format", default="text", choices=("text", "json", "html"))
            p.add_argument("--out")
            p.add_argument("--show-reference", action="store_true")
        if name in ("summarize", "compare"):
            p.add_argument("--endpoint", help="base address of a server of chat completions")
            p.add_argument("--key-variable", help="the environment variable that holds the server's key")
            p.add_argument("--model", help="the server's model, or the folder of a local one")
            p.add_argument("--stand-in", action="store_true", help="answer with a deterministic stand-in, to try out the formats")
        if name == "inspect":
            p.add_argument("--query")
        if name == "compare":
            p.add_argument("--backends", default="extractive")
    p = commands.add_parser("models")
    p.set_defaults(run=models)
    p.add_argument("--endpoint")
    p.add_argument("--key-variable")
    p = commands.add_parser("validate")
    p.set_defaults(run=validate_)
    p.add_argument("summaries")
    p.add_argument("scores")
    p.add_argument("--limit", type=int)
    p.add_argument("--out")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(SparkSession.builder.appName("spanloom").getOrCreate(), args)
    except GenerationError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
