"""Profiles of consoles: TOML files, the package's own and those of a folder, which replace them by name.

A file has a name, a stage and its rank, and lists of patterns. Patterns are of the kind that is matched in
linear time (no look-around, no back-references); those that aren't are refused, and so are fields that no profile has. Java matches them
here: named groups become plain ones, as Java's names are narrower.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

OWN = Path(__file__).resolve().parent.parent / "profiles.d"
#: Severities by name, worst first.
SEVERITIES = {"emerg": 0, "alert": 1, "crit": 2, "err": 3, "warning": 4, "warn": 4, "notice": 5, "info": 6, "debug": 7}
#: What every profile that doesn't say ``use_generic = false`` takes for registers, backtraces and restarts.
GENERIC = {
    "context": [r"(?i)\b(x[0-9]+|r[0-9]+|pc|lr|sp|elr|esr|far|spsr)\b\s*[:=]?\s*0x[0-9a-f]+.*\b(x[0-9]+|r[0-9]+|pc|lr|sp|elr|esr|far|spsr)\b\s*[:=]?\s*0x[0-9a-f]+"],
    "backtrace_headers": [r"(?i)\b(call (trace|stack)|backtrace):"],
    "backtrace_frames": [r"^\s*#[0-9]+\s+(pc|0x)", r"\b\w+\+0x[0-9a-f]+/0x[0-9a-f]+", r"^\s*0x[0-9a-f]+(:0x[0-9a-f]+)?\s*$"],
    "reset_markers": [r"(?i)\bsystem restart\b"],
}
_LISTS = ("overlay_match", "reset_markers", "context", "backtrace_headers", "backtrace_frames", "terminators", "continuations", "lookback", "mine_strip")
_FIELDS = {*_LISTS, "name", "stage", "stage_rank", "overlay", "banners", "triggers", "mine_resync", "record_timeout_s", "use_generic", "ansi_strip", "severity", "extract", "prompts", "version_banners", "structured_lines", "tokenizer"}


@dataclass(frozen=True)
class Banner:
    pattern: str
    stage: str
    rank: int


@dataclass(frozen=True)
class Trigger:
    pattern: str
    severity: int
    lookback: bool
    kind: str


@dataclass(frozen=True)
class Profile:
    """How one kind of console writes; patterns in Java's dialect."""

    name: str
    stage: str
    rank: int
    overlay: bool = False
    banners: tuple[Banner, ...] = ()
    triggers: tuple[Trigger, ...] = ()
    #: Patterns by the field's name.
    patterns: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)
    timeout_s: int = 5

    def all_of(self, *fields: str) -> list[str]:
        return [p for f in fields for p in self.patterns.get(f, ())]


class ProfileError(ValueError):
    """A profile that can't be used, and why."""


def java_pattern(pattern: str) -> str:
    """A linear-time pattern as Java has it."""
    bare = re.sub(r"\\\\|\\[^0-9]", "", pattern)
    if found := re.search(r"\(\?(?:[=!>]|<[=!])|\\[1-9]", bare):
        raise ProfileError(f"{found[0]} can't be matched in linear time: {pattern}")
    return re.sub(r"\(\?P?<\w+>", "(", pattern)


def parse_profile(text: str, source: str = "") -> Profile:
    try:
        said = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ProfileError(f"{source}: {e}") from e
    if "name" not in said:
        raise ProfileError(f"{source}: a profile has a name")
    if unknown := sorted(set(said) - _FIELDS):
        raise ProfileError(f"{source}: no profile has {', '.join(unknown)}")
    try:
        generic = GENERIC if said.get("use_generic", True) else {}
        patterns = {f: tuple(java_pattern(p) for p in [*said.get(f, []), *generic.get(f, [])]) for f in _LISTS}
        if "mine_resync" in said:
            patterns["mine_resync"] = (java_pattern(said["mine_resync"]),)
        stage, rank = said.get("stage", said["name"]), int(said.get("stage_rank", 0))
        banners = tuple(Banner(java_pattern(b["pattern"]), b.get("stage", stage), int(b.get("rank", rank))) for b in said.get("banners", []))
        triggers = tuple(Trigger(java_pattern(t["pattern"]), SEVERITIES[t.get("severity", "crit")], bool(t.get("lookback", False)), t.get("kind", "crash")) for t in said.get("triggers", []))
    except (ProfileError, KeyError, TypeError) as e:
        raise ProfileError(f"{source or said['name']}: {e}") from e
    return Profile(said["name"], stage, rank, bool(said.get("overlay", False)), banners, triggers, patterns, int(said.get("record_timeout_s", 5)))


def load_profiles(folder: str | None = None) -> tuple[list[Profile], list[str]]:
    """The package's profiles, those of a folder in their place by name (the last file wins), by rank and name; and what was refused, with the reason."""
    found, refused = {}, []
    for place in (OWN, *([Path(folder)] if folder else [])):
        for path in sorted(place.glob("*.toml")):
            try:
                profile = parse_profile(path.read_text(), path.name)
                found[profile.name] = profile
            except ProfileError as e:
                refused.append(str(e))
    return sorted(found.values(), key=lambda p: (p.rank, p.name)), refused


PROFILES = load_profiles()[0]
