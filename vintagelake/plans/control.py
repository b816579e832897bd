"""The control plane: engines and their registry, settings, replay of cutoffs. All of it makes plans; none moves data through the driver."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagelake.operators.pit import PitView, Worlds


class Engine(ABC):
    """One asset's engine: which series it needs, and frames of what it has to say at a cutoff."""

    asset = ""
    experimental = False

    @classmethod
    def of(cls, inputs: dict[str, str], options: dict) -> Engine:
        """The engine from settings: series by role, and options by name."""
        return cls()

    @abstractmethod
    def required_series(self) -> list[str]: ...

    @abstractmethod
    def outputs(self, view: PitView) -> DataFrame:
        """(as_of, metric, value)."""

    def features(self, view: PitView) -> DataFrame | None:
        return None

    def forecasts(self, view: PitView) -> DataFrame | None:
        return None

    def regimes(self, view: PitView) -> DataFrame | None:
        return None


ENGINES: dict[str, type[Engine]] = {}


def register(cls: type[Engine]) -> type[Engine]:
    if not cls.asset or cls.asset in ENGINES:
        raise ValueError(f"an engine needs an asset of its own: {cls.asset!r}")
    ENGINES[cls.asset] = cls
    return cls


def enabled(settings: Settings, portfolio: bool = False) -> list[Engine]:
    """Engines that the settings switch on, with the series and options that the settings give them; for a portfolio without experimental ones."""
    import vintagelake.plans.assets  # noqa: F401  registers the assets' engines

    named = settings.engines.keys() | settings.inputs.keys() | settings.options.keys()
    if unknown := named - ENGINES.keys():
        raise KeyError(f"unknown engines: {sorted(unknown)}")
    chosen = [a for a, on in settings.engines.items() if on and not (portfolio and ENGINES[a].experimental)]
    return [ENGINES[a].of(settings.inputs.get(a, {}), settings.options.get(a, {})) for a in chosen]


FREQUENCIES = ("daily", "weekly", "monthly", "quarterly")


@dataclass(frozen=True)
class SeriesSpec:
    series_id: str
    provider: str
    frequency: str = "daily"
    lag_days: int = 0
    direction: int = 1

    def __post_init__(self):
        if not self.series_id or self.frequency not in FREQUENCIES or self.lag_days < 0 or self.direction not in (-1, 1):
            raise ValueError(f"not a series: {self}")


@dataclass(frozen=True)
class Settings:
    """Strict: an unknown key, provider, role or input is an error. inputs: an engine's series by role; options: what else it takes."""

    series: tuple[SeriesSpec, ...] = ()
    engines: dict[str, bool] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)
    inputs: dict[str, dict[str, str]] = field(default_factory=dict)
    options: dict[str, dict] = field(default_factory=dict)

    @staticmethod
    def of(raw: dict, providers: set[str]) -> Settings:
        if unknown := raw.keys() - {"series", "engines", "roles", "inputs", "options"}:
            raise KeyError(f"unknown settings: {sorted(unknown)}")
        series = tuple(SeriesSpec(**s) for s in raw.get("series", []))
        if unknown := {s.provider for s in series} - providers:
            raise KeyError(f"unknown providers: {sorted(unknown)}")
        ids = {s.series_id for s in series}
        if unknown := set(raw.get("roles", {}).values()) - ids:
            raise KeyError(f"roles of unknown series: {sorted(unknown)}")
        inputs = {a: dict(r) for a, r in raw.get("inputs", {}).items()}
        if unknown := {s for r in inputs.values() for s in r.values()} - ids:
            raise KeyError(f"inputs of unknown series: {sorted(unknown)}")
        return Settings(series, dict(raw.get("engines", {})), dict(raw.get("roles", {})), inputs, {a: dict(o) for a, o in raw.get("options", {}).items()})


def run(engines: list[Engine], obs: DataFrame, as_of: str) -> tuple[DataFrame | None, dict[str, str]]:
    """All engines' outputs as one frame (asset, metric, as_of, value), and the engines that could not plan theirs with the reason."""
    frames, failed = [], {}
    for e in engines:
        try:
            frames.append(e.outputs(PitView(obs, as_of)).select(F.lit(e.asset).alias("asset"), "metric", "as_of", "value"))
        except Exception as error:  # noqa: BLE001  one engine must not stop the others
            failed[e.asset] = str(error)
    return (reduce(DataFrame.unionByName, frames) if frames else None), failed


def replay(obs: DataFrame, cutoffs: list[str] | DataFrame, view: Callable[[Worlds], DataFrame]) -> DataFrame:
    """view's frame over what was known at each cutoff; the plan is the same for any number of cutoffs."""
    return view(Worlds(obs, cutoffs))


#: Keys that make an artifact differ from run to run.
CLOCK_KEYS = ("now", "run_at", "timestamp", "created_at", "wall_clock")


def artifact_faults(document: dict, model_version: str, fit_date: str) -> list[str]:
    """What is wrong with an artifact: another version or date than asked for, or a clock's reading inside."""
    faults = [k for k, want in (("model_version", model_version), ("fit_date", fit_date)) if document.get(k) != want]

    def keys(x):
        if isinstance(x, dict):
            for k, v in x.items():
                yield k
                yield from keys(v)
        elif isinstance(x, list):
            for v in x:
                yield from keys(v)

    return faults + sorted(set(CLOCK_KEYS) & set(keys(document)))
