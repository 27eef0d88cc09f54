"""Configuration: defaults, sparse overrides from YAML, validation, atomic saving."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Endpoint:
    """A source or a destination."""

    name: str = ""
    type: str = ""
    url: str = ""
    active: bool = True
    options: dict[str, str] = field(default_factory=dict)
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Performance:
    feedback_s: int = 10
    channel_bags: int = 1000
    bag_size: int = 10_000
    bag_multiple: int = 5
    workers: int = 10
    batch_size: int = 5000
    batch_timeout_ms: int = 200
    flush_timeout_ms: int = 120_000


@dataclass(frozen=True)
class Retry:
    retries: int = 3
    base_ms: int = 2000
    cap_ms: int = 30_000


@dataclass(frozen=True)
class State:
    folder: str = "./local_checkpoints"


@dataclass(frozen=True)
class Monitor:
    interval_s: int = 5
    address: str = "localhost"
    port: int = 8080


@dataclass(frozen=True)
class Tune:
    mode: str = "manual"

    @property
    def automatic(self) -> bool:
        """Any mode but automatic is manual."""
        return self.mode == "automatic"


@dataclass(frozen=True)
class Config:
    provider: Endpoint = Endpoint()
    consumers: tuple[Endpoint, ...] = ()
    performance: Performance = Performance()
    retry: Retry = Retry()
    state: State = State()
    monitor: Monitor = Monitor()
    tuning: Tune = Tune()


def merged(config: Any, override: dict | None) -> Any:
    """config with the values that override names; what it leaves out, or gives as null, keeps its value.

    An unknown name is an error, as it would be a misspelt setting.
    """
    if not override:
        return config
    known = {f.name: f for f in fields(config)}
    if unknown := sorted(set(override) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    new = {}
    for name, value in override.items():
        old = getattr(config, name)
        if value is None:
            continue
        if is_dataclass(old):
            new[name] = merged(old, value)
        elif name == "consumers":
            new[name] = tuple(merged(Endpoint(), v) for v in value)
        elif isinstance(old, tuple):
            new[name] = tuple(value)
        else:
            new[name] = value
    return replace(config, **new)


def problems(config: Config) -> list[str]:
    """What keeps a configuration from being run: numbers that are not above 0, endpoints without a type, names in double."""
    out = []
    for section in (config.performance, config.retry, config.monitor):
        for f in fields(section):
            value = getattr(section, f.name)
            if f.type == "int" and (isinstance(value, bool) or not isinstance(value, int) or value <= 0):
                out.append(f"{f.name} must be a whole number above 0, not {value!r}")
    if not config.provider.type:
        out.append("the source has no type")
    active = runnable(config)
    if not active:
        out.append("no active destination with a type")
    names = [c.name for c in config.consumers]
    out += [f"two destinations are named {n!r}" for n in sorted({n for n in names if names.count(n) > 1})]
    return out


def runnable(config: Config) -> list[Endpoint]:
    """The destinations to run: active ones with a type."""
    return [c for c in config.consumers if c.active and c.type]


def added(config: Config, endpoint: Endpoint) -> Config:
    """config with one more destination; without a name it gets one that none has had."""
    taken = {c.name for c in config.consumers}
    name = endpoint.name or next(n for i in range(1, len(taken) + 2) if (n := f"{endpoint.type or 'sink'}-{i}") not in taken)
    if name in taken:
        raise ValueError(f"there is a destination named {name!r}")
    return replace(config, consumers=(*config.consumers, replace(endpoint, name=name)))


def removed(config: Config, name: str) -> Config:
    return replace(config, consumers=tuple(c for c in config.consumers if c.name != name))


def _plain(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def load(path: str | Path, defaults: Config = Config()) -> Config:
    """The defaults with the file's overrides; a missing or empty file changes nothing."""
    import yaml

    p = Path(path)
    return merged(defaults, yaml.safe_load(p.read_text()) if p.exists() else None)


def save_yaml(data: Any, path: str | Path) -> None:
    """Write a file as a whole: under another name first, then renamed."""
    import yaml

    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    part = p.with_name(f"{p.name}.tmp")
    part.write_text(yaml.safe_dump(_plain(data), sort_keys=False, allow_unicode=True))
    os.replace(part, p)


def save(config: Config, path: str | Path, sparse: bool = True) -> None:
    """Save all settings or, sparse, those that differ from the defaults."""
    full, base = _plain(asdict(config)), _plain(asdict(Config()))
    if sparse:
        full = {s: diff for s, v in full.items() if (diff := ({k: x for k, x in v.items() if x != base[s][k]} if isinstance(v, dict) else v)) and v != base[s]}
    save_yaml(full, path)
