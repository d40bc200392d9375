"""``spark-submit``-able command line: answer a table of questions over a table of documents."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .config import RetrievalConfig
from .models import EMBEDDERS, GENERATORS, RERANKERS, ModelError, Remote, create, model_name
from .plans.retrieval import run_pipeline
from .sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="askloom", description=__doc__)
    p.add_argument("websites", help="CSV or Parquet with web_id and text")
    p.add_argument("questions", help="CSV or Parquet with q_id and query")
    p.add_argument("output", help="folder for the answers, as CSV")
    p.add_argument("--references", help="CSV with reference answers")
    p.add_argument("--index-path", help="where the index is kept")
    p.add_argument("--build-index", action="store_true", help="build the index even if there is one")
    p.add_argument("--cache-path", help="where answers are cached")
    p.add_argument("--model", default="extractive", help="the generator's model, under which answers are cached")
    p.add_argument("--generator", choices=sorted(GENERATORS), default="extractive")
    p.add_argument("--embedder", choices=sorted(EMBEDDERS), default="hashing")
    p.add_argument("--reranker", choices=sorted(RERANKERS), default="overlap")
    p.add_argument("--url", help="where the generator is, if it is remote or local")
    p.add_argument("--key-env", default="ASKLOOM_KEY", help="environment variable that holds the services' key")
    p.add_argument("--batch-size", type=int, help="prompts that go to the generator together")
    p.add_argument("--batches-path", help="where answers are committed in batches, for a run to be taken up")
    p.add_argument("--batch-rows", type=int, default=2000, help="questions of a committed batch")
    p.add_argument("--done", help="CSV with a q_id column: questions that are answered already")
    p.add_argument("--no-validate", action="store_true")
    p.add_argument("--min-overlap", type=int, default=1)
    p.add_argument("--fast-quality", action="store_true", help="fewer candidates: 30, 15 and 8")
    p.add_argument("--limit", type=int)
    p.add_argument("--legacy-chunking", action="store_true", help="single-level chunks")
    return p


def _model(kinds: dict, kind: str, a: argparse.Namespace):
    """The model that the arguments ask for."""
    key = os.environ.get(a.key_env, "")
    if kind in ("hashing", "overlap", "extractive"):
        return create(kinds, kind)
    if kind == "local":
        return create(kinds, kind, url=a.url, model=model_name(a.model))
    if kind == "remote":
        return create(kinds, kind, remote=Remote(a.url, a.model, key, needs_key=bool(key)))
    if kind == "batch":
        raise ModelError("a batch engine is given in code")
    return create(kinds, kind, key=key)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("askloom").getOrCreate()
    generate = _model(GENERATORS, a.generator, a)
    if a.batch_size:
        generate.batch = a.batch_size
    answers, counters = run_pipeline(
        spark,
        tables.read_websites(spark, a.websites),
        tables.read_questions(spark, a.questions),
        references=tables.read_references(spark, a.references) if a.references else None,
        cache_path=a.cache_path,
        index_path=a.index_path,
        rebuild_index=a.build_index,
        limit=a.limit,
        parent_child=not a.legacy_chunking,
        min_overlap=None if a.no_validate else a.min_overlap,
        model=a.model,
        embed=_model(EMBEDDERS, a.embedder, a),
        rerank=_model(RERANKERS, a.reranker, a),
        generate=generate,
        done=tables.read_done(spark, a.done) if a.done else None,
        batches_path=a.batches_path,
        batch_rows=a.batch_rows,
        config=RetrievalConfig(k_dense=30, k_bm25=15, k_rerank=8) if a.fast_quality else RetrievalConfig(),
    )
    tables.write_submission(answers, a.output)
    print(counters.first().asDict())


if __name__ == "__main__":
    main()
