"""python -m larkspur scan | prepare | embed-test | search | smoke"""

from __future__ import annotations

import argparse
import json
import sys

from . import env
from .config import Config


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("larkspur").getOrCreate()


def _scan(a) -> dict:
    from .operators import catalog, manifest

    rules = catalog.Policy(**json.loads(a.rules)) if a.rules else catalog.Policy()
    return manifest.scan(_spark(), manifest.ScanOptions(a.root, a.out, rules, a.profile, a.hash_mode, a.content_hash_max_mb))


def _prepare(a) -> dict:
    from .operators import prepare

    routes = tuple(a.routes.split(",")) if a.routes else None
    return prepare.prepare(_spark(), prepare.PrepareOptions(a.manifest, a.out, a.action, routes, a.max_record_chars, a.limit, a.pdf_chunk_mode))


def _embed(a) -> dict:
    from .factory import build_embedder

    config = Config.from_env()
    if a.provider:
        config = config.with_(embedding_provider=a.provider, embedding_model=a.model or config.embedding_model, embedding_endpoint=a.endpoint or config.embedding_endpoint)
    model = build_embedder(config)
    vector = model.embed([a.text])[0]
    return {"provider": config.embedding_provider, "model": model.model, "dimension": len(vector), "preview": vector[:8]}


def _search(a) -> list[dict]:
    from .factory import build_embedder, build_vectors
    from .search import dense_only

    spark, config = _spark(), Config.from_env()
    vectors = build_vectors(config, spark)
    chunks = spark.read.parquet(a.chunks) if a.chunks else vectors.store.read()
    asked = spark.createDataFrame([(0, a.query)], "query_id long, query string")
    found = dense_only(asked, build_embedder(config), vectors, chunks, a.top_k).orderBy("rank")
    return [{k: r[k] for k in ("rank", "score", "citation", "preview")} for r in found.collect()]


def _smoke(a) -> dict:
    from .providers import smoke

    env.load_env()
    return smoke(a.base, a.key, {"chat": a.chat, "embedding": a.embedding, "rerank": a.rerank})


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="larkspur")
    commands = out.add_subparsers(dest="command")

    def command(name: str, run, about: str, *options: tuple[str, dict]) -> None:
        c = commands.add_parser(name, help=about)
        for option, more in options:
            c.add_argument(option, **more)
        c.set_defaults(run=run)

    must = {"required": True}
    command("scan", _scan, "list a source library and write its manifest", ("--root", must), ("--out", must), ("--profile", {"default": "default"}), ("--rules", {"help": "names of folders as JSON"}),
            ("--hash-mode", {"choices": ["fingerprint", "content", "none"], "default": "fingerprint"}), ("--content-hash-max-mb", {"type": int, "default": 64}))
    command("prepare", _prepare, "make corpus records of a manifest's files", ("--manifest", must), ("--out", must), ("--action", {"default": "include"}), ("--routes", {"default": "markdown,jsonl_records,pdf_text_first"}),
            ("--max-record-chars", {"type": int, "default": 6000}), ("--limit", {"type": int}), ("--pdf-chunk-mode", {"choices": ["page", "clause"], "default": "page"}))
    command("embed-test", _embed, "embed a text and show the vector's size", ("--text", {"default": "What holds the panel in place?"}), ("--provider", {}), ("--model", {}), ("--endpoint", {}))
    command("search", _search, "vector search for one query", ("query", {}), ("--chunks", {}), ("--top-k", {"type": int, "default": 5}))
    command("smoke", _smoke, "call each service once", ("base", {}), ("--key", {}), ("--chat", {}), ("--embedding", {}), ("--rerank", {}))
    return out


def main(argv: list[str] | None = None) -> int:
    known = parser()
    a = known.parse_args(argv)
    if not a.command:
        known.print_help()
        return 2
    if hasattr(sys.stdout, "reconfigure"):
        sys.stdout.reconfigure(encoding="utf-8")
    print(json.dumps(a.run(a), ensure_ascii=False, indent=2, default=str))
    return 0
