"""python -m tessera: ingest, index, sync, query, ask, eval, serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tessera import config, evaluation, server
from tessera.operators import build
from tessera.operators import index as I
from tessera.service import AdmissionGate, Engine
from tessera.shipping import ship
from tessera.sources import golden


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "index", "sync"):
        one = commands.add_parser(name)
        one.add_argument("raw")
        if name == "ingest":
            one.add_argument("--mirror", default="data/processed")
        else:
            one.add_argument("--index", default="data/index")
        one.add_argument("--force", action="store_true")
        one.add_argument("--under", default="", help="one folder (with a slash at its end) or one file below the raw folder")
    for name in ("query", "ask"):  # the hits, or an answer from them
        one = commands.add_parser(name)
        one.add_argument("question")
        one.add_argument("--index", default="data/index")
        one.add_argument("--project")
        one.add_argument("--build")
    web = commands.add_parser("serve")
    web.add_argument("--index", default="data/index")
    web.add_argument("--mirror", default="data/processed")
    web.add_argument("--host", default="127.0.0.1")
    web.add_argument("--port", type=int, default=8000)
    test = commands.add_parser("eval")
    test.add_argument("dataset", help="golden set in YAML or JSON lines")
    test.add_argument("--index", default="data/index")
    test.add_argument("--mode", choices=evaluation.MODES, default="retrieval")
    test.add_argument("--json", action="store_true")
    for one in commands.choices.values():
        one.add_argument("--config", help="settings in YAML; TESSERA_SECTION_NAME variables come on top")
    args = parser.parse_args(argv)
    settings = config.load(args.config)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    ship(spark)
    store = I.Store(spark, args.index) if hasattr(args, "index") else None

    def engine() -> Engine:
        api = settings.api
        return Engine(spark, store, settings.retrieval, generation=settings.generation, base_url=api.public_base_url, gate=AdmissionGate(api.concurrent, api.depth, api.retry_after), timeout=api.timeout_seconds)

    if args.command == "ingest":
        print(json.dumps(build.ingest_folder(spark, args.raw, args.mirror, settings.layout, force=args.force, under=args.under), ensure_ascii=False))
    elif args.command in ("index", "sync"):
        print(json.dumps(build.sync_index(spark, args.raw, store, settings.layout, settings.chunking, force=args.force or args.command == "index", under=args.under)))
    elif args.command == "query":
        asked = spark.createDataFrame([(0, args.question, args.project, args.build)], "qid long, query string, project string, build string")
        for row in engine().retrieve(asked).orderBy("rank").collect():
            print(json.dumps({k: row[k] for k in ("rank", "score", "project", "build", "document_type", "content")}, ensure_ascii=False))
    elif args.command == "ask":
        print(json.dumps(engine().query({"question": args.question, "project": args.project, "build": args.build}), ensure_ascii=False, indent=2))
    elif args.command == "serve":
        app = server.App(engine(), args.mirror)
        app.warm_up()
        with server.make_server(app, args.host, args.port) as running:
            running.serve_forever()
    else:
        row = evaluation.run(engine(), golden.load(spark, args.dataset), args.mode, settings.evaluation).first()
        print(json.dumps(row.asDict(), ensure_ascii=False, indent=2) if args.json else evaluation.text_report(row.asDict()))
        return 0 if row["accepted"] else 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
