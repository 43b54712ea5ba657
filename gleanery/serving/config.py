"""Configuration: a JSON file over defaults, the environment over the file, and what is refused."""

from __future__ import annotations

import datetime
import ipaddress
import json
import re
from dataclasses import dataclass, field, fields, replace
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.collect import REGISTRY
from gleanery.session import read_text

#: Kinds of sources: those with a collector of fetched pages, and those that read a catalogue, a hit list or their own past.
KINDS = frozenset({*REGISTRY, "catalogue", "hn", "snapshot"})
SOURCES = (
    "name string, kind string, url string, disabled boolean, trust int, category string, max_items int, params map<string,string>, keywords array<string>, "
    "deny array<string>, sites array<string>"
)


class ConfigError(ValueError):
    """A configuration that must not be used."""


@dataclass(frozen=True)
class Source:
    """One source: its name is its identity."""

    name: str
    kind: str
    url: str
    disabled: bool = False
    trust: int = 0
    category: str = ""
    max_items: int = 0
    params: dict[str, str] = field(default_factory=dict)
    keywords: list[str] = field(default_factory=list)
    deny: list[str] = field(default_factory=list)
    sites: list[str] = field(default_factory=list)

    def param(self, key: str, default: str) -> str:
        """A parameter; one that is blank counts as absent."""
        return self.params.get(key, "").strip() or default


@dataclass(frozen=True)
class Config:
    """All settings; absent ones keep their defaults."""

    data_dir: str = "./data"
    interval_s: float = 1800.0
    timezone: str = "Asia/Shanghai"
    log_level: str = "info"
    bind: str = "127.0.0.1:8080"
    serve: bool = True
    allow_public: bool = False
    allow_private: bool = False
    urgent_score: int = 80
    urgent_per_day: int = 5
    event_lead_s: float = 86_400.0
    event_per_day: int = 5
    daily_at: str = "09:00"
    max_age_hours: int = 336
    require_offer: bool = True
    deny_keywords: list[str] = field(default_factory=list)
    require_keywords: list[str] = field(default_factory=list)
    allow_keywords: list[str] = field(default_factory=list)
    sources: list[Source] = field(default_factory=list)

    def enabled(self) -> list[Source]:
        return [s for s in self.sources if not s.disabled]


def seconds(value: float | str) -> float:
    """A duration as a number of seconds or written in hours, minutes and seconds, as ``1h30m``."""
    if isinstance(value, int | float) and not isinstance(value, bool):
        return float(value)
    unit = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", str(value))
    if not parts or "".join(n + u for n, u in parts) != str(value).lstrip("-"):
        raise ConfigError(f"not a duration: {value!r}")
    total = sum(float(n) * unit[u] for n, u in parts)
    return -total if str(value).startswith("-") else total


def env_file(text: str, known: dict[str, str]) -> dict[str, str]:
    """``KEY=VALUE`` lines; comments and blank lines are passed over, quotes are taken off, and what the environment already has wins."""
    out = dict(known)
    for i, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        key, found, value = line.partition("=")
        if not found:
            raise ConfigError(f"line {i}: expected KEY=VALUE")
        out.setdefault(key.strip(), value.strip().strip("\"'"))
    return out


_DURATIONS = {"interval_s", "event_lead_s"}


def load(spark: SparkSession, path: str | None, env: dict[str, str], prefix: str = "GLEANERY_") -> Config:
    """The configuration of a file (it may be absent or partial) with the environment's ``<prefix><NAME>`` over it, checked."""
    text = read_text(spark, path) if path else None
    data = json.loads(text) if text else {}
    extra = data.pop("extra_sources", [])
    unknown = set(data) - {f.name for f in fields(Config)}
    if unknown:
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    for f in fields(Config):
        value = env.get(prefix + f.name.upper(), "")
        if value and f.name != "sources":
            kind = type(getattr(Config(), f.name))
            data[f.name] = value.lower() in ("1", "true", "yes", "on") if kind is bool else value.split(";") if kind is list else kind(value) if kind is int else value
    for name in _DURATIONS & set(data):
        data[name] = seconds(data[name])
    data["sources"] = [Source(**s) for s in [*data.get("sources", []), *extra]]
    return check(Config(**data))


def check(config: Config) -> Config:
    """The configuration in one form, or an error that says what is wrong with it."""
    if not config.data_dir.strip():
        raise ConfigError("data_dir is required")
    if config.interval_s < 60:
        raise ConfigError("an interval below a minute is too short")
    if not 0 <= config.urgent_score <= 100:
        raise ConfigError("urgent_score lies between 0 and 100")
    if min(config.urgent_per_day, config.event_per_day, config.event_lead_s) < 0:
        raise ConfigError("budgets and leads are not negative")
    if config.timezone:
        try:
            ZoneInfo(config.timezone)
        except Exception as e:
            raise ConfigError(f"no such zone: {config.timezone}") from e
    if not re.fullmatch(r"(?:[01]?\d|2[0-3]):[0-5]\d", config.daily_at):
        raise ConfigError("daily_at is written HH:MM")
    if config.log_level not in ("", "debug", "info", "warn", "error"):
        raise ConfigError("log_level is debug, info, warn or error")
    if config.serve:
        check_bind(config.bind, config.allow_public, config.allow_private)
    return replace(config, sources=_checked(config.sources))


def _checked(sources: list[Source]) -> list[Source]:
    out: dict[str, Source] = {}
    for i, s in enumerate(sources):
        s = replace(s, name=s.name.strip(), kind=s.kind.strip().lower())
        if not s.name:
            raise ConfigError(f"source {i} has no name")
        if s.name in out:
            raise ConfigError(f"two sources are named {s.name}")
        if s.kind not in KINDS:
            raise ConfigError(f"source {s.name}: unknown kind {s.kind}")
        if not s.url.startswith(("https://", "http://")):
            raise ConfigError(f"source {s.name}: its url is not http")
        if not 0 <= s.trust <= 10:
            raise ConfigError(f"source {s.name}: trust lies between 0 and 10")
        out[s.name] = s
    return list(out.values())


_SHARED = ipaddress.ip_network("100.64.0.0/10")


def check_bind(bind: str, allow_public: bool, allow_private: bool) -> None:
    """Refuses addresses that would show the interface to the world: loopback, shared and private addresses may be bound."""
    host, colon, port = bind.rpartition(":")
    if not colon or not port.isdigit():
        raise ConfigError(f"{bind} names no port")
    host = host.strip("[]")
    if host in ("", "*", "0.0.0.0", "::"):
        if not allow_public:
            raise ConfigError(f"{bind} would listen everywhere")
        return
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        if host != "localhost" and not host.endswith(".ts.net") and not allow_private:
            raise ConfigError(f"{host} is no address") from None
        return
    if not (ip.is_loopback or ip.is_private or (ip.version == 4 and ip in _SHARED) or allow_private):
        raise ConfigError(f"{host} is a public address")


def source_table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The sources as a dimension, in their configured order."""
    rows = [(i, *(getattr(s, c.split()[0]) for c in SOURCES.split(", "))) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, f"place int, {SOURCES}")


def with_extras(sources: DataFrame, extras: DataFrame) -> DataFrame:
    """Sources and further ones, in order; names that occur twice are an error when the rows are read."""
    both = sources.unionByName(extras)
    twice = both.groupBy("name").agg(F.count("*").alias("_n"))
    checked = both.join(F.broadcast(twice), "name")  # a fixed dimension
    return checked.where(F.assert_true(F.col("_n") == 1, F.concat(F.lit("two sources are named "), "name")).isNull()).drop("_n")


def backup_age(spark: SparkSession, data_dir: str, now: datetime.datetime) -> tuple[float, str]:
    """Seconds since the last backup, and its archive. Three things can be wrong: no stamp, an empty one, one that begins with no UTC time."""
    text = read_text(spark, f"{data_dir}/backup.stamp")
    if text is None:
        raise FileNotFoundError("there is no backup.stamp")
    parts = text.split()
    if not parts:
        raise ValueError("backup.stamp is empty")
    try:
        at = datetime.datetime.strptime(parts[0], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=datetime.UTC)
    except ValueError:
        raise ValueError(f"backup.stamp begins with no UTC time: {parts[0][:24]}") from None
    return (now - at).total_seconds(), parts[1] if len(parts) > 1 else ""
