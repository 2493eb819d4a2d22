"""Command line: run (the default), outbox, db, catalog. Exit codes: 0 done, 1 refused, 2 no sink, 3 a delivery is uncertain."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from noticeforge import reports
from noticeforge.engine import Engine

DONE, REFUSED, NO_SINK, UNCERTAIN = range(4)


def sink(config: dict, make: Callable[[], Callable | None]) -> Callable | None:
    """What sends messages; None where delivery is off or there are no credentials. At most once is the only policy."""
    if not config.get("deliver", True):
        return None
    if (policy := config.get("delivery_policy", "at_most_once")) != "at_most_once":
        raise ValueError(f"delivery policy {policy!r}")
    return make()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="noticeforge")
    out.add_argument("--state", required=True, help="folder of the state")
    commands = out.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("observations", help="Parquet with the engine's observation columns")
    run.add_argument("--reports", help="JSON file: by source, what its reader says of its coverage")
    only = run.add_mutually_exclusive_group()
    only.add_argument("--dry-run", action="store_true", help="collect without publishing, deliver nothing")
    only.add_argument("--collect-only", action="store_true")
    only.add_argument("--dispatch-only", action="store_true")
    run.add_argument("--source", action="append", help="take observations of this source only")
    run.add_argument("--today", help="the day to judge by")
    run.add_argument("--limit", type=int, default=20, help="events to send at most")
    run.add_argument("--metrics-file")
    box = commands.add_parser("outbox").add_subparsers(dest="action", required=True)
    box.add_parser("list").add_argument("--status", action="append")
    for name in ("claim", "dispatch"):
        own = box.add_parser(name)
        own.add_argument("--batch-file", required=True)
        own.add_argument("--limit", type=int, default=20)
        own.add_argument("--metrics-file")
    for name in ("retry", "suppress"):
        box.add_parser(name).add_argument("event_id")
    commands.add_parser("db").add_argument("action", choices=("check", "stats"))
    catalog = commands.add_parser("catalog").add_subparsers(dest="action", required=True)
    catalog.add_parser("export").add_argument("--output", required=True)
    for name in ("follow", "unfollow"):
        catalog.add_parser(name).add_argument("prefix")
    return out


def main(argv: Sequence[str], spark: SparkSession, make_sink: Callable[[], Callable | None] = lambda: None, config: dict | None = None, now: datetime | None = None) -> int:
    """Run a command; without one after the options, run."""
    values, config, now = list(argv), config or {}, now or datetime.now()
    if not {"run", "outbox", "db", "catalog"} & set(values):
        values.insert(2, "run")
    a = parser().parse_args(values)
    engine = Engine(spark, a.state, **{k: config[k] for k in ("only_enrollable_new", "show_review", "explicit_follow_only", "profile") if k in config})
    if a.command == "run":
        engine.recover(now)
        said = json.loads(Path(a.reports).read_text()) if a.reports else {}
        for r in said.values():
            r |= {k: datetime.fromisoformat(r[k]).date() for k in ("covered_through", "failed") if r.get(k)}
        today = date.fromisoformat(a.today) if a.today else now.date()
        if not a.dispatch_only:
            observed = spark.read.parquet(a.observations)
            if a.source:
                observed, said = observed.where(observed["source"].isin(a.source)), {s: r for s, r in said.items() if s in a.source}
            summary = engine.run(observed, today, now, a.dry_run, said)
            if a.metrics_file:
                reports.merge_metrics(a.metrics_file, {"collection": reports.collection(summary)})
        send = None if a.dry_run or a.collect_only else sink(config, make_sink)
        if send is None:
            return NO_SINK if a.dispatch_only else DONE
        return _send(a, engine, engine.claim(a.limit, now), send, config, now)
    if a.command == "db":
        found = {r["check"]: r["n"] for r in engine.check().collect()} if a.action == "check" else engine.stats()
        print(json.dumps(found, indent=2))
        return REFUSED if a.action == "check" and any(found.values()) else DONE
    if a.command == "catalog":
        if a.action == "export":
            Path(a.output).write_text(engine.export(now.date()), encoding="utf-8")
            return DONE
        try:
            print(engine.follow(a.prefix, now, a.action == "follow"))
        except ValueError as e:
            print(e)
            return REFUSED
        return DONE
    return _outbox(a, engine, make_sink, config, now)


def _outbox(a: argparse.Namespace, engine: Engine, make_sink: Callable, config: dict, now: datetime) -> int:
    if a.action == "list":
        for r in engine.events(a.status).collect():
            print(f"{r['event_id']} {r['status']:<10} {r['kind']:<10} attempts={r['attempts']}")
        return DONE
    if a.action in ("retry", "suppress"):
        known = engine.events().where("status <> 'SENT'")
        if known.where(known["event_id"] == a.event_id).isEmpty():
            return REFUSED
        getattr(engine, a.action)(a.event_id)
        return DONE
    if a.action == "claim":
        ids = engine.claim(a.limit, now)
        try:
            Path(a.batch_file).write_text(json.dumps(ids), encoding="utf-8")
        except OSError:
            engine.release(ids)  # a batch that nobody can read is never sent
            raise
        return DONE
    ids = json.loads(Path(a.batch_file).read_text(encoding="utf-8"))
    if not isinstance(ids, list) or not all(isinstance(x, str) for x in ids):
        raise ValueError("the batch isn't a list of ids")
    if (send := sink(config, make_sink)) is None:
        engine.release(ids)
        return NO_SINK
    return _send(a, engine, ids, send, config, now)


def _send(a: argparse.Namespace, engine: Engine, ids: list[str], send: Callable, config: dict, now: datetime) -> int:
    out = {k.lower(): v for k, v in engine.dispatch(ids, send, now, config.get("min_interval_seconds", 1.0)).items()}
    if a.metrics_file:
        reports.merge_metrics(a.metrics_file, {"delivery": out})
    return UNCERTAIN if out["uncertain"] else DONE
