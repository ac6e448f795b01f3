"""Layered configuration: defaults, then embedded, file and command values; later layers win."""

from __future__ import annotations

import os
import re
import shlex
from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class Features:
    """Default feature parameters."""

    sample_period_100ns: int = 625
    frame: int = 400
    shift: int = 160
    preemphasis: float = 0.97
    cepstra: int = 12
    lifter: int = 22
    channels: int = 24
    delta: int = 2
    accel: int = 2
    low_hz: float = -1.0
    high_hz: float = -1.0


@dataclass(frozen=True)
class Trigger:
    level: int = 2000
    zero_cross: int = 60
    head_ms: int = 300
    tail_ms: int = 400
    reject_short_ms: int = 0
    reject_long_ms: int = -1


@dataclass(frozen=True)
class Search:
    beam: int | None = None
    score_beam: float = -1.0
    sentences: int = 1
    stack: int = 500
    overflow: int = 2000
    envelope: int = 30
    scan_beam: float = 80.0
    lm_weight: float = 8.0
    lm_penalty: float = -2.0
    confidence_alpha: float = 0.05
    lookup_range: int = 5


#: Option names, the section and field each sets.
OPTIONS = {
    "-smpPeriod": ("features", "sample_period_100ns"), "-fsize": ("features", "frame"), "-fshift": ("features", "shift"),
    "-preemph": ("features", "preemphasis"), "-fbank": ("features", "channels"), "-ceplif": ("features", "lifter"),
    "-delwin": ("features", "delta"), "-accwin": ("features", "accel"), "-lofreq": ("features", "low_hz"), "-hifreq": ("features", "high_hz"),
    "-lv": ("trigger", "level"), "-zc": ("trigger", "zero_cross"), "-headmargin": ("trigger", "head_ms"), "-tailmargin": ("trigger", "tail_ms"),
    "-rejectshort": ("trigger", "reject_short_ms"), "-rejectlong": ("trigger", "reject_long_ms"),
    "-b": ("search", "beam"), "-bs": ("search", "score_beam"), "-n": ("search", "sentences"), "-s": ("search", "stack"), "-m": ("search", "overflow"),
    "-b2": ("search", "envelope"), "-sb": ("search", "scan_beam"), "-cmalpha": ("search", "confidence_alpha"), "-lookuprange": ("search", "lookup_range"),
}


@dataclass(frozen=True)
class Config:
    features: Features = field(default_factory=Features)
    trigger: Trigger = field(default_factory=Trigger)
    search: Search = field(default_factory=Search)
    other: dict = field(default_factory=dict)

    def merged(self, layer: dict) -> Config:
        """With the values of {section: {field: value}} that are not None."""
        out = {}
        for f in fields(self):
            now, new = getattr(self, f.name), {k: v for k, v in layer.get(f.name, {}).items() if v is not None}
            out[f.name] = now | new if isinstance(now, dict) else replace(now, **new)
        return Config(**out)

    def check(self) -> Config:
        problems = []
        if self.features.shift > self.features.frame:
            problems.append("the frame shift is longer than a frame")
        if self.features.cepstra > self.features.channels:
            problems.append("there are more cepstra than channels")
        if self.search.sentences > self.search.stack:
            problems.append("more sentences are asked for than the stack holds")
        if not 0 <= self.trigger.reject_short_ms or 0 <= self.trigger.reject_long_ms < self.trigger.reject_short_ms:
            problems.append("the lengths to reject contradict each other")
        if problems:
            raise ValueError("; ".join(problems))
        return self

    def describe(self) -> list[tuple[str, str, str]]:
        return [(s, k, str(v)) for s, d in asdict(self).items() for k, v in d.items()]


def expand(text: str, env: dict | None = None) -> str:
    """$NAME and ${NAME} by environment variables; unknown names are an error."""
    env = os.environ if env is None else env

    def one(m) -> str:
        name = m[1] or m[2]
        if name not in env:
            raise ValueError(f"${name} is not set")
        return env[name]

    return re.sub(r"\$(?:\{(\w+)\}|(\w+))", one, text)


def parse_options(args: list[str]) -> dict:
    """{section: {field: value}} of options; unknown ones, with what follows them, go to `other`."""
    kinds = {"features": Features, "trigger": Trigger, "search": Search}
    out: dict = {}
    i = 0
    while i < len(args):
        name = args[i]
        i += 1
        if name in OPTIONS:
            section, key = OPTIONS[name]
            default = getattr(kinds[section](), key)
            if i >= len(args):
                raise ValueError(f"{name} needs a value")
            out.setdefault(section, {})[key] = (type(default) if default is not None else int)(args[i])
            i += 1
        else:
            rest = []
            while i < len(args) and not re.match(r"-[A-Za-z]", args[i]):
                rest.append(args[i])
                i += 1
            out.setdefault("other", {})[name.lstrip("-")] = " ".join(rest) or True
    return out


def from_text(text: str, base: Config | None = None, env: dict | None = None, read=None) -> Config:
    """A configuration file's options on top of base: # begins a comment, `-C file` includes another through read(name)."""
    args = []
    for line in text.splitlines():
        args += shlex.split(expand(line, env) if not line.lstrip().startswith("#") else "", comments=True)
    config, i, own = base or Config(), 0, []
    while i < len(args):
        if args[i] == "-C":
            config = from_text(read(args[i + 1]), config.merged(parse_options(own)), env, read)
            own, i = [], i + 2
        else:
            own.append(args[i])
            i += 1
    return config.merged(parse_options(own)).check()


def shared_features(configs: dict[str, Config]) -> dict[Features, list[str]]:
    """Processes by feature settings: each distinct setting is computed once."""
    out: dict[Features, list[str]] = {}
    for name, c in configs.items():
        out.setdefault(c.features, []).append(name)
    return out
