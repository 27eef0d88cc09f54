"""The command line: python -m tidemark.cli run|check|status|config|accounts ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from dataclasses import asdict, replace
from pathlib import Path

from tidemark.control import accounts
from tidemark.control import config as conf
from tidemark.control.health import check_all
from tidemark.control.registry import SINKS, SOURCES
from tidemark.sources import frames


@SOURCES.register("frames")
def frame_stream(spark, endpoint: conf.Endpoint):
    """Change events of a folder of frames; the url holds the folder and the stream's options."""
    from tidemark.sources import pgoutput

    spark.dataSource.register(frames.FrameSource)
    folder, options = pgoutput.source_options(endpoint.url)
    return spark.readStream.format("change_frames").options(path=folder, **options, **endpoint.options).load()


@SOURCES.register("parquet")
def parquet_stream(spark, endpoint: conf.Endpoint):
    """Change events as files of a folder."""
    return spark.readStream.schema(spark.read.parquet(endpoint.url).schema).parquet(endpoint.url)


def probe_source(endpoint: conf.Endpoint) -> None:
    if endpoint.type not in SOURCES.names():
        raise ValueError(f"no source of type {endpoint.type!r}")
    frames.probe(endpoint.url.split("?")[0])


def make_sink(endpoint: conf.Endpoint):
    import tidemark.sinks.log  # noqa: F401  registers its types

    if endpoint.type == "log":
        return SINKS.make("log", endpoint.name, print)
    if endpoint.type == "append":
        return SINKS.make("append", endpoint.name, endpoint.url)
    raise ValueError(f"a sink of type {endpoint.type!r} is made in code, not from a file")


def check(path: str) -> int:
    """Report what keeps the configuration from running; 0 if nothing does."""
    c = conf.load(path)
    wrong = conf.problems(c)
    probes = {f"source {c.provider.name}": lambda: probe_source(c.provider)}
    probes |= {f"sink {e.name}": (lambda e=e: make_sink(e).probe()) for e in conf.runnable(c)}
    for line in wrong:
        print(f"config: {line}")
    health = check_all(probes)
    for h in health:
        print(f"{h.name}: {'ok' if h.ok else h.error}")
    return int(bool(wrong) or not all(h.ok for h in health))


def run(path: str, folder: str, once: bool) -> int:
    """Check, then run until stopped, or once over what is there."""
    if check(path):
        return 1
    from tidemark.control.monitor import Counters, ProgressListener, Ticker, configure_log, observed
    from tidemark.session import local_session
    from tidemark.streaming.pipeline import Engine

    configure_log()
    c = conf.load(path)
    spark = local_session()
    counters = Counters()
    spark.streams.addListener(ProgressListener(counters))
    engine = Engine(spark, c, folder)
    engine.bootstrap({e.name: make_sink(e) for e in conf.runnable(c)})
    ticker = Ticker(counters, c.monitor.interval_s, print)
    ticker.start()
    Path(folder).mkdir(parents=True, exist_ok=True)
    engine.start(observed(SOURCES.make(c.provider.type, spark, c.provider), "changes"), every_ms=None if once else c.performance.batch_timeout_ms)
    errors = {}
    try:
        errors = engine.wait()
    except KeyboardInterrupt:
        pass
    finally:
        reached = engine.stop()
        ticker.stop()
        status = {"at": int(time.time()), "ack": reached, "sinks": engine.progress.reached, "active": engine.progress.active, "errors": errors}
        part = Path(folder) / "status.json.tmp"
        part.write_text(json.dumps(status))
        os.replace(part, Path(folder) / "status.json")
        print(ticker.line())
    return int(bool(errors))


def status(folder: str) -> int:
    p = Path(folder) / "status.json"
    print(p.read_text() if p.exists() else "{}")
    return int(not p.exists())


def edit(path: str, settings: list[str], add: str | None, remove: str | None) -> int:
    """Change a configuration file: section.name=value settings, destinations as type:name:url."""
    c = conf.load(path)
    override: dict = {}
    for s in settings:
        key, _, value = s.partition("=")
        section, _, name = key.partition(".")
        override.setdefault(section, {})[name] = int(value) if value.isascii() and value.isdigit() else value
    c = conf.merged(c, override)
    if add:
        kind, name, url = (add.split(":", 2) + ["", ""])[:3]
        c = conf.added(c, conf.Endpoint(name=name, type=kind, url=url))
    if remove:
        c = conf.removed(c, remove)
    if wrong := [p for p in conf.problems(c) if "must be" in p or "named" in p]:
        print("\n".join(wrong))
        return 1
    conf.save(c, path)
    print(json.dumps(asdict(replace(c))))
    return 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "check", "config"):
        s = sub.add_parser(name)
        s.add_argument("--config", default="config.yaml")
        if name == "run":
            s.add_argument("--folder", default="./state")
            s.add_argument("--once", action="store_true")
        if name == "config":
            s.add_argument("settings", nargs="*")
            s.add_argument("--add-sink")
            s.add_argument("--remove-sink")
    s = sub.add_parser("status")
    s.add_argument("--folder", default="./state")
    s = sub.add_parser("accounts")
    s.add_argument("name")
    s.add_argument("--file", default="accounts.yaml")
    a = p.parse_args(args)
    if a.command == "run":
        return run(a.config, a.folder, a.once)
    if a.command == "check":
        return check(a.config)
    if a.command == "config":
        return edit(a.config, a.settings, a.add_sink, a.remove_sink)
    if a.command == "status":
        return status(a.folder)
    print(accounts.add(a.file, a.name))
    return 0


if __name__ == "__main__":
    sys.exit(main())
