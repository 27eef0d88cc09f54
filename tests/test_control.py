import http.client
import json
import sqlite3
import time

import pytest

from tidemark import cli
from tidemark.control import accounts, config, health, probe, registry, tuner
from tidemark.control.api import ConfigServer
from tidemark.control.monitor import Counters, Ticker
from tidemark.control.retry import GaveUp, retried, waits
from tidemark.sinks.base import FanOut, Progress


def test_waits_and_attempts():
    assert list(waits(3, 2, 30)) == [2, 4, 8] and list(waits(6, 2, 30)) == [2, 4, 8, 16, 30, 30]
    slept, tries = [], []

    def work():
        tries.append(1)
        raise OSError("no")

    with pytest.raises(GaveUp):
        retried(work, sleep=slept.append)
    assert slept == [2, 4, 8] and len(tries) == 4
    with pytest.raises(GaveUp, match="no time left"):
        retried(work, deadline_s=1, sleep=slept.append)
    assert retried(lambda: 5) == 5
    with pytest.raises(GaveUp, match="after 1 attempts"):
        retried(work, stopped=lambda: True, sleep=slept.append)


def test_underfilled_batches_shrink_after_five():
    p = probe.probe(5000)
    for i in range(4):
        p = probe.timeout_flush(p, float(i), 100)
    assert p.size == 5000 and p.underfilled == 4
    p = probe.timeout_flush(p, 4.0, 100)
    assert p.size == 4500 and p.underfilled == 0 and p.step == 100
    assert probe.timeout_flush(p, 5.0, 900).underfilled == 0  # 20 % full counts as noise
    assert probe.probe(1).size == 200 and probe.probe(10**9).size == 200_000


def test_growing_turning_and_trying_again():
    p = probe.probe(5000)
    p = probe.full_flush(p, 0.0, 5000)
    assert p.size == 5000  # no rate yet
    p = probe.full_flush(p, 1.0, 5000)
    assert p.size == 5500 and p.seen_eps == 5000
    p = probe.full_flush(p, 1.5, 5500)  # faster: larger steps the same way
    assert p.size == 6250 and p.step == 750
    down = probe.full_flush(p, 11.5, 6250)  # slower, too few points for a fit: back by half a step
    assert down.size == 6250 - 375 and down.direction == -1 and down.step == 375
    q, at = p, 1.5
    q = probe.replace(q, eps=1000.0, seen_eps=1000.0)
    for _ in range(10):
        at += 1
        q = probe.full_flush(q, at, 1000)
    assert q.size == 6350 and q.step == 100 and q.quiet == 0
    stay = probe.full_flush(probe.held(p, True), 2.0, 99)
    assert stay.size == p.size and stay.eps != p.eps
    assert probe.forced(p, 10).size == 200 and probe.probe(300).stable() is None


def test_peak_of_a_parabola():
    points = [(float(x), 1e6 - (x - 700) ** 2) for x in range(300, 1200, 100)]
    assert abs(probe.peak(points) - 700) < 1
    assert probe.peak(points[:4]) is None and probe.peak([(x, -y) for x, y in points]) is None
    assert probe.peak([(x, y) for x, y in points if x < 600]) is None  # the vertex lies outside
    assert probe.peak([(100.0 + i, 5.0) for i in range(6)]) is None  # spread too small


def test_tuning_rounds():
    auto = config.merged(config.Config(), {"tuning": {"mode": "automatic"}})
    p = probe.replace(probe.probe(5000), eps=40_000.0, best=(40_000.0, 5000))
    t = tuner.Tuning(p, 4, 200)
    assert tuner.timed(t, 0, 10).timeout_ms == 162
    assert tuner.timed(t, 21, 10).timeout_ms == 200
    assert tuner.staffed(t, 80_000, 8).workers == 5 and tuner.staffed(t, 80_000, 4).workers == 4
    assert tuner.staffed(t, 100, 8).workers == 3 and tuner.staffed(tuner.replace(t, workers=1), 100, 8).workers == 1
    hot = tuner.guarded(t, 96)
    assert hot.throttled and hot.probe.size == 2500 and hot.probe.held
    assert tuner.guarded(hot, 90).probe.size == 2500 and tuner.guarded(hot, 96).probe.size == 2000
    cool = tuner.guarded(hot, 84)
    assert not cool.throttled and not cool.probe.held
    assert tuner.tick(t, config.Config(), 99, 10**9, 0, 8) == t  # manual
    assert tuner.tick(t, auto, 50, 80_000, 0, 8).workers == 5
    assert tuner.tick_seconds(auto) == 10
    runner = tuner.Tuner(auto, lambda: 0, 8, memory=lambda: 50.0)
    runner.flushed(1.0, 5000, True)
    assert runner.tick(now=2.0).workers == 9


def test_configuration(tmp_path):
    c = config.merged(config.Config(), {"provider": {"type": "frames", "url": "x"}, "performance": {"workers": 3, "batch_size": None}})
    assert c.performance.workers == 3 and c.performance.batch_size == 5000 and config.problems(c) == ["no active destination with a type"]
    with pytest.raises(ValueError, match="unknown settings: wrokers"):
        config.merged(c, {"performance": {"wrokers": 1}})
    c = config.added(config.added(c, config.Endpoint(type="log")), config.Endpoint(type="log"))
    assert [e.name for e in c.consumers] == ["log-1", "log-2"] and not config.problems(c)
    c = config.added(config.removed(c, "log-1"), config.Endpoint(type="log"))
    assert len({e.name for e in c.consumers}) == 2
    with pytest.raises(ValueError):
        config.added(c, config.Endpoint(name="log-2", type="log"))
    config.save(c, tmp_path / "c.yaml")
    assert config.load(tmp_path / "c.yaml") == c and config.load(tmp_path / "none.yaml") == config.Config()
    assert not list(tmp_path.glob("*.tmp"))
    bad = config.merged(c, {"performance": {"workers": 0}})
    assert config.problems(bad) == ["workers must be a whole number above 0, not 0"]
    assert not config.Tune("anything").automatic


def test_accounts_and_server(tmp_path):
    key = accounts.add(tmp_path / "a.yaml", "mila")
    known = accounts.load(tmp_path / "a.yaml")
    assert accounts.allowed(known, "mila", key) and not accounts.allowed(known, "mila", key + "x") and key not in (tmp_path / "a.yaml").read_text()
    with pytest.raises(ValueError):
        accounts.add(tmp_path / "a.yaml", "mila")
    server = ConfigServer(config.Config(), known)
    server.start()

    def ask(method, headers, body=None, path="/config"):
        h = http.client.HTTPConnection("localhost", server.port, timeout=5)
        h.request(method, path, body, headers)
        r = h.getresponse()
        return r.status, json.loads(r.read())

    try:
        assert ask("GET", {})[0] == 401 and ask("GET", {"X-API-Key": key}, path="/")[0] == 404
        assert ask("GET", {"X-API-Key": key})[1]["performance"]["workers"] == 10
        assert ask("POST", {"X-API-Key": key}, '{"performance": {"workers": 2}}')[0] == 200 and server.config.performance.workers == 2
        assert ask("POST", {"X-API-Key": key}, '{"performance": {"workers": -2}}')[0] == 400
        assert ask("POST", {"X-API-Key": key}, "[]x")[0] == 400 and server.config.performance.workers == 2
    finally:
        server.stop()


def test_health_registry_and_monitor():
    assert health.check("a", lambda: None).ok
    assert "no answer" in health.check("a", lambda: time.sleep(0.5), 0.1).error
    bad = health.check_all({"b": lambda: 1 / 0, "a": lambda: None})
    assert [(h.name, h.ok) for h in bad] == [("a", True), ("b", False)] and "ZeroDivisionError" in bad[1].error
    r = registry.Registry("thing")
    r.register("z")(dict)
    r.register("b")(list)
    assert r.names() == ["b", "z"] and r.make("z", x=1) == {"x": 1}
    with pytest.raises(ValueError, match="there are: b, z"):
        r.make("q")
    now = [0.0]
    c = Counters(clock=lambda: now[0])
    c.add({"total": 50, "INSERT": 20, "UPDATE": None})
    now[0] = 2.0
    assert c.look()["eps"] == 25 and c.look()["eps"] == 0
    assert "total=50 insert=20" in Ticker(c, 1).line()


def test_fan_out_drops_only_the_sink_that_fails(spark):
    class Fake:
        def __init__(self, name, broken=False):
            self.name, self.broken, self.got = name, broken, []

        def apply(self, batch, batch_id):
            if self.broken:
                raise OSError("down")
            self.got.append((batch_id, batch.count()))

        def probe(self):
            pass

        def close(self):
            self.got.append("closed")

    good, bad, p = Fake("good"), Fake("bad", True), Progress()
    fan = FanOut([good, bad], p, lambda work: retried(work, 1, 0, 0, sleep=lambda s: None))
    assert p.ack() == 0 and p.any_active()
    df = spark.range(3)
    assert fan.apply(df, 0, 100) == ["good"] and not p.active["bad"] and p.ack() == 100
    assert fan.apply(df, 1, 90) == ["good"] and p.reached["good"] == 100  # never back
    p.fail("good")
    assert fan.apply(df, 2, 200) == [] and p.ack() == 0 and not p.any_active()
    fan.close()
    assert good.got == [(0, 3), (1, 3), "closed"]


def test_command_line(tmp_path, capsys):
    path = str(tmp_path / "c.yaml")
    (tmp_path / "in").mkdir()
    assert cli.main(["config", "--config", path, "performance.workers=2", "provider.type=frames", f"provider.url={tmp_path}/in", "--add-sink", "log:l:"]) == 0
    assert cli.main(["check", "--config", path]) == 0 and "sink l: ok" in capsys.readouterr().out
    assert cli.main(["config", "--config", path, "performance.workers=0"]) == 1
    assert cli.main(["check", "--config", str(tmp_path / "none.yaml")]) == 1
    assert cli.main(["status", "--folder", str(tmp_path)]) == 1
    assert cli.main(["accounts", "mila", "--file", str(tmp_path / "a.yaml")]) == 0
    assert sqlite3.sqlite_version  # the statement sink's tests need it
