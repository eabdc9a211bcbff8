"""Command line: python -m heliograph --store DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="heliograph")
    p.add_argument("--store", required=True, help="the store's folder")
    p.add_argument("--config", help="a TOML file")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("serve", help="HTTP server")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8722)
    c = sub.add_parser("capture", help="a hook's JSON on standard input")
    c.add_argument("hook")
    for name in ("recall", "context"):
        c = sub.add_parser(name)
        c.add_argument("query")
        c.add_argument("--limit", type=int, default=10)
        c.add_argument("--budget", type=int, default=1000)
    c = sub.add_parser("remember", help="stores a note")
    c.add_argument("text")
    c.add_argument("--session", default="manual")
    c = sub.add_parser("syn")
    c.add_argument("op", choices=["add", "remove", "list"])
    c.add_argument("term", nargs="?")
    c.add_argument("expansion", nargs="?")
    c = sub.add_parser("index", help="brings the code index up to date with the roots, or the given ones")
    c.add_argument("roots", nargs="*")
    c = sub.add_parser("reindex", help="wipes the code index and makes it anew, after a snapshot")
    c.add_argument("--confirm", action="store_true")
    c.add_argument("roots", nargs="*")
    sub.add_parser("status")
    sub.add_parser("mcp", help="JSON-RPC, a message a line")
    c = sub.add_parser("bench")
    c.add_argument("what", choices=["code-index", "tokens", "embed"])
    c.add_argument("roots", nargs="*")
    c.add_argument("--sizes", type=int, nargs="*", default=[16, 64, 256])
    c = sub.add_parser("eval", help="a question set (JSON) or a query bank (TOML)")
    c.add_argument("path")
    c.add_argument("--mode", default="hybrid", choices=["bm25", "vector", "hybrid"])
    c.add_argument("--limit", type=int, default=20)
    c.add_argument("--synthetic", type=int, default=0)
    c.add_argument("--report")
    return p


def run(args: argparse.Namespace, spark: SparkSession, stdin=sys.stdin, out=print) -> int:
    from heliograph import evaluate, sweeps
    from heliograph.api import Engine
    from heliograph.plans.recall import Mode, RecallConfig
    from heliograph.sources.readers import load_bank, load_config, read_questions, write_report
    from heliograph.streaming.capture import hook_rows

    engine = Engine(spark, args.store, config=load_config(args.config))
    name = args.command
    if name == "serve":
        from heliograph.server import serve

        server = serve(engine, args.host, args.port)
        engine.evict()
        out(f"http://{args.host}:{server.server_port}")
        server.serve_forever()
    elif name == "capture":
        rows = hook_rows(spark, args.hook, json.loads(stdin.read()), int(time.time()))
        out(f"stored {engine.capture(rows)}")
    elif name == "remember":
        row = spark.createDataFrame([(args.session, "note", args.text, int(time.time()))], "session string, kind string, body string, ts long")
        out("stored" if engine.capture(row) else "duplicate")
    elif name == "recall":
        out(engine.recall_lines(engine.recall(args.query, args.limit)))
    elif name == "context":
        out(engine.context(args.query, args.budget))
    elif name == "syn":
        if args.op == "list":
            for r in engine.store.read("synonyms").orderBy("term", "expansion").collect():
                out(f"{r['term']} → {r['expansion']}")
        else:
            out(json.dumps(engine.synonyms(args.op, args.term, args.expansion)))
    elif name in ("index", "reindex"):
        roots = args.roots or engine.roots()
        if name == "reindex":
            if not args.confirm:
                out("this wipes the code index; say --confirm")
                return 2
            out(f"snapshot {engine.store.snapshot(engine.provider.tag)}")
            engine.store.wipe_code_index()
        for root in roots:
            out(f"{root}: {engine.index(root)} files")
    elif name == "status":
        out(json.dumps(engine.status(), indent=2, default=str))
    elif name == "mcp":
        for line in stdin:
            if line.strip() and (answer := engine.rpc(line)):
                out(answer)
    elif name == "bench":
        roots = args.roots or engine.roots()
        made = {"code-index": lambda: sweeps.code_index(spark, engine.provider, roots, engine.config), "tokens": lambda: sweeps.tokens(spark, engine.provider, roots, engine.config), "embed": lambda: sweeps.embed_sweep(spark, engine.provider, args.sizes)}[args.what]()
        out(json.dumps(made, indent=2, default=str))
    elif name == "eval":
        if args.path.endswith(".toml"):
            stats, records = evaluate.run_bank(engine.store.read("code_chunks"), engine.store.read("vec_code"), load_bank(spark, args.path), engine.provider, engine.store.index("code"), limit=args.limit, synthetic=args.synthetic)
            out("\n".join(json.dumps(r.asDict()) for r in stats.orderBy("bucket", "mode").collect()))
            if args.report:
                evaluate.write_code_report(stats, args.report)
        else:
            done = evaluate.run_questions(read_questions(spark, args.path), engine.provider, RecallConfig(mode=Mode(args.mode)), args.limit, engine.store.read("synonyms"))
            out("\n".join(json.dumps(r.asDict()) for r in done.by_type.unionByName(done.summary.withColumn("question_type", F.lit("overall"))).orderBy("question_type").collect()))
            if args.report:
                write_report(done.records, args.report)
    return 0


def main() -> int:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("heliograph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(args, spark)
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
