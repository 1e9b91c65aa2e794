"""Command line of a pipeline: run it, list its checkpoints, or run up to one of them."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from typing import Any

from .monitor import JsonConsole, LiveConsole
from .plans.store import Dataset, ItemDataset, Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Run a pipeline of tasks.")
    p.add_argument("command", nargs="?", choices=["run", "list-tasks"], default="run")
    p.add_argument("--tasks", metavar="NAMES", help="stop at these checkpoints (names with commas between them)")
    p.add_argument("--store", metavar="PATH", help="folder of the checkpoints")
    p.add_argument("--dataset", metavar="PATH", help="folder of a dataset that keeps the checkpoints; goes before --store")
    p.add_argument("--files", action="store_true", help="the dataset has a file for each item")
    p.add_argument("-j", "--concurrency", type=int, help="most tasks at a time of row workers")
    p.add_argument("--no-live", action="store_true", help="append progress instead of rewriting it")
    p.add_argument("--json", action="store_true", help="progress as JSON lines")
    return p


def main(make: Callable[[], Any], argv: list[str] | None = None) -> int:
    """0: done, 1: tasks failed, 2: bad arguments. ``make`` returns the engine."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    engine = make()
    if args.store:
        engine.store = Store(engine.spark, args.store)
    if args.dataset:
        engine.dataset((Dataset if args.files else ItemDataset)(engine.spark, args.dataset))
    if args.concurrency:
        engine.concurrency = args.concurrency
    if args.command == "list-tasks":
        rows = engine.tasks().orderBy("name").collect()
        for r in rows:
            print(f"{r['name']}\tworker={'yes' if r['has_worker'] else 'no'}\tstored={r['n_stored']}\tdone={r['n_done']}")
        if not rows:
            print("no checkpoints are registered")
        return 0
    if args.tasks:
        try:
            engine.select_tasks(*[t.strip() for t in args.tasks.split(",") if t.strip()])
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
    engine.monitor = JsonConsole() if args.json else LiveConsole(live=False if args.no_live else None)
    report = engine.run()
    print(report, file=sys.stderr)
    return 1 if report.failed else 0
