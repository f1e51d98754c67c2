"""Command line: ``python -m lumenfold.cli ingest-dump DUMP STORE``, ``ask QUESTION STORE``, ``query NAME SF_DIR``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lumenfold", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, words in (("ingest-dump", ("dump", "store")), ("ingest-files", ("files", "store")), ("ask", ("question", "store")), ("compare", ("question", "store")), ("stats", ("store",)), ("query", ("name", "sf_dir"))):
        command = sub.add_parser(name)
        for w in words:
            command.add_argument(w)
    a = parser.parse_args(args)
    spark = session()
    from lumenfold.operators.vectors import HashedEmbedder
    from lumenfold.plans.ingest import Store, ingest_documents, ingest_dump

    embed = HashedEmbedder()
    if a.command == "ingest-dump":
        print(json.dumps(vars(ingest_dump(Store(spark, a.store), a.dump, embed)), ensure_ascii=False))
    elif a.command == "ingest-files":
        from lumenfold.sources.files import load_files

        print(json.dumps(vars(ingest_documents(Store(spark, a.store), load_files(spark, a.files), embed)), ensure_ascii=False))
    elif a.command in ("ask", "compare"):
        from lumenfold.plans.answer import AnswerEngine
        from lumenfold.plans.retrieve import PostEngine

        store = Store(spark, a.store)
        engine = PostEngine(store.read("posts"), store.read("edges"), store.read("vertices"), store.read("post_chunks"), embed)
        for mode in ("hybrid",) if a.command == "ask" else ("vector", "graph", "hybrid"):
            found = AnswerEngine(lambda q, m=mode: engine.retrieve(q, m)).answer(a.question)
            print(json.dumps({"mode": mode, "answer": found.answer, "citations": found.citations, "grounded": found.grounded}, ensure_ascii=False))
    elif a.command == "stats":
        store = Store(spark, a.store)
        print(json.dumps({t: (store.read(t).count() if store.path(t) else 0) for t in ("chunks", "entities", "relations", "posts", "vertices", "edges")}))
    else:
        from lumenfold.registry import QUERIES

        QUERIES[a.name](spark, a.sf_dir).show(50, truncate=False)


if __name__ == "__main__":
    main()
