"""Command line: index, search, window, status, chunks, savings, watch, hook."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from plumbline import config as settings
from plumbline.functions import render
from plumbline.operators import analytics
from plumbline.plans.bank import Bank, BankSet
from plumbline.service import LogWriter, passes_gate, run_hook


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline")
    for name, kind in (("--config", str), ("--dim", int), ("--model", str)):
        p.add_argument(name, type=kind)
    p.add_argument("--db", action="append")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("index")
    s.add_argument("path")
    for flag in ("--force", "--dry-run", "--no-recursive"):
        s.add_argument(flag, action="store_true")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-k", type=int, default=5)
    s.add_argument("--output", choices=("text", "json"), default="text")
    s.add_argument("-C", "--context", action="store_true")
    s.add_argument("-r", "--radius", type=int, default=1)
    s = sub.add_parser("window")
    s.add_argument("chunk_id", type=int)
    s.add_argument("-r", "--radius", type=int, default=1)
    s.add_argument("--max-chars", type=int, default=2000)
    s = sub.add_parser("status")
    s.add_argument("--output", choices=("text", "json"), default="text")
    sub.add_parser("chunks").add_argument("path")
    s = sub.add_parser("savings")
    s.add_argument("--history", type=int)
    s.add_argument("--output", choices=("text", "json"), default="text")
    sub.add_parser("hook").add_argument("kind", choices=("index", "search"))
    sub.add_parser("watch").add_argument("paths", nargs="+")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = settings.load(args.config).with_overrides(args.dim, args.model, args.db).validated()
    payload = ""
    if args.command == "hook":  # gates first: a session takes seconds to start
        payload = sys.stdin.read()
        if not os.path.isdir(config.db_path) or not passes_gate(args.kind, payload):
            return 0
    spark = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "hook":
        return run_hook(args.kind, payload, lambda: Bank(spark, config.db_path, config))
    if args.command != "index" and args.command != "watch" and not os.path.isdir(config.db_path):
        print(f"No index at {config.db_path}. Run 'index' first.")
        return 1
    bank = Bank(spark, config.db_path, config)
    if args.command == "index":
        report = bank.index_path(args.path, not args.no_recursive, args.force, args.dry_run)
        print(report.summary())
        return int(args.dry_run and bool(report.removed or report.counts.get("added") or report.counts.get("modified")))
    if args.command == "search":
        banks = BankSet()
        for path in (config.db_path, *config.extra_db_paths):
            banks.mount(os.path.basename(path.rstrip("/")), bank if path == config.db_path else Bank(spark, path, config))
        found = banks.search([args.query], args.k)
        hits = [r.asDict() for r in render.shown(found).orderBy("rank").collect()]
        if not hits and not bank.stats()["documents"]:
            print("The index is empty.")
            return 0
        if args.context and len(banks.banks) == 1:
            found = bank.contexts([h["id"] for h in hits], args.radius)
            windows = [found[h["id"]] for h in hits]
        else:
            windows = None
        log = LogWriter(bank)
        log.append("cli", args.query, args.k, hits)
        if args.output == "json":
            shown = [h | {"content": w} for h, w in zip(hits, windows, strict=True)] if windows else hits
            shown = [{k: v for k, v in h.items() if k != "bar"} for h in shown]
            print(json.dumps(shown, indent=2, ensure_ascii=False))
        else:
            print(render.results(hits, args.query, windows, args.radius))
        log.close()
    elif args.command == "window":
        print(bank.context(args.chunk_id, args.radius, args.max_chars))
    elif args.command == "status":
        print(json.dumps(bank.stats(), indent=2) if args.output == "json" else render.status(bank.stats(), config.db_path, config.model_id))
    elif args.command == "chunks":
        for r in bank.chunks_of(args.path).collect():
            head = "\n".join(r["content"].split("\n")[:3])
            print(f"[{r['chunk_index']}] {r['heading_context'] or '(no heading)'} ({r['start_byte']}–{r['end_byte']})\n{head}\n")
    elif args.command == "savings":
        if args.output == "json":
            rows = analytics.recent(bank.log(), args.history) if args.history else analytics.costs(analytics.savings(bank.log()))
            print(json.dumps([r.asDict() for r in rows.collect()], indent=2))
        else:
            print(render.history(bank.log(), args.history) if args.history else render.savings(bank.log()))
    else:
        from plumbline.streaming.watch import watch

        watch(bank, args.paths, on_report=lambda r: print(r.summary())).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
