"""python -m lectern.cli --config FILE COMMAND ..."""

from __future__ import annotations

import argparse
import json
import time

from .config import Config, load_config, save_config
from .engine import Engine


def number(p: argparse.ArgumentParser, flag: str, default: int) -> None:
    p.add_argument(flag, type=int, default=default)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("--config", default="lectern.yaml")
    sub = p.add_subparsers(dest="command", required=True)
    source = sub.add_parser("source").add_subparsers(dest="action", required=True)
    add = source.add_parser("add")
    add.add_argument("label")
    add.add_argument("path")
    source.add_parser("remove").add_argument("label")
    source.add_parser("list")
    sub.add_parser("symbol").add_argument("symbol_id")
    reindex = sub.add_parser("reindex")
    reindex.add_argument("labels", nargs="*")
    reindex.add_argument("--full", action="store_true")
    for name in ("query", "context"):
        q = sub.add_parser(name)
        q.add_argument("text")
        number(q, "--top-k", 10)
        q.add_argument("--source")
        q.add_argument("--module")
        q.add_argument("--rewrite", action="store_true")
        if name == "context":
            number(q, "--max-tokens", 6000)
    evaluation = sub.add_parser("eval")
    evaluation.add_argument("queries")
    evaluation.add_argument("--compare-rewrite", help="once without and once with rewriting", action="store_true")
    evaluation.add_argument("--latency", help="time each query by itself", action="store_true")
    sub.add_parser("status")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    import os

    from .session import local_session, share_code
    from .sources.queries import read_queries

    args = parser().parse_args(argv)
    if not os.path.exists(args.config):
        save_config(Config(), args.config)
    engine = Engine(share_code(spark or local_session()), load_config(args.config), args.config)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, indent=2, default=str))
    if args.command == "source":
        if args.action == "add":
            engine.add_doc_source(args.label, args.path)
        elif args.action == "remove":
            engine.remove_doc_source(args.label)
        show(engine.list_doc_sources())
    elif args.command == "symbol":
        show(engine.find_symbol(args.symbol_id))
    elif args.command == "reindex":
        start = time.perf_counter()
        totals = engine.reindex(args.labels or None, args.full)
        show(vars(totals) | {"seconds": round(time.perf_counter() - start, 1)})
        return int(bool(totals.errors))
    elif args.command == "query":
        show(engine.search_docs(args.text, args.top_k, source_label=args.source, module=args.module, enable_rewrite=args.rewrite))
    elif args.command == "context":
        print(engine.build_context(args.text, args.max_tokens, args.top_k, source_label=args.source, module=args.module, enable_rewrite=args.rewrite))
    elif args.command == "eval":
        annotated = read_queries(engine.spark, args.queries)
        modes = {"plain": False, "rewrite": True} if args.compare_rewrite else {"plain": False}
        asked = [r["query"] for r in annotated.select("query").collect()] if args.latency else []
        timed = lambda on: {"latency": engine.latencies(asked, enable_rewrite=on)} if args.latency else {}
        show({name: engine.evaluate(annotated, enable_rewrite=on) | timed(on) for name, on in modes.items()})
    else:
        show(engine.index_status())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
