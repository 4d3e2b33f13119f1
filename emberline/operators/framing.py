"""Framing: lines to records, stages and epochs, by the dialect that the console speaks at the time.

Lines are judged by column expressions: what each profile would take them for, as bits. What becomes of a line depends on the lines before it
(which dialect is active, whether a record is open), so an automaton goes over the bits in line order:

* garbage is put aside in runs, and ends what is open;
* in an open record, its profile's terminator ends it, a trigger opens the next one (or completes one that a preamble has opened), and
  continuations, registers and backtraces go on with it, up to ``RECORD_LINES``; any other line ends it;
* otherwise a banner makes its profile the active one; a restart is told by the active one; a trigger opens a record, with the held lines before it
  if it says so; lines that a trigger may take back are held, ``LOOK_BACK`` of them; any other line is a record by itself.

A line that an overlay claims goes by the overlay's rules, whatever is active. The active profile is that of the last banner.

A session is cut into segments of ``SEGMENT`` lines, which are folded in parallel. What a segment does is a function of the state that it is entered in,
and there are few states: the active profile, and whether nothing, held lines, garbage or a record of some profile is open. So each segment is folded from all
of them at once; folds that come to the same state go on as one, mostly after a few lines. These functions are then applied one after the other, a row a segment,
and with the state that it is entered in each segment gives its records. Sizes and numbers of held lines are added up at that point; only where a record
that comes from an earlier segment would grow too long within one, the session is gone through again with all of its bits.
Banners (a byte each) come along for the stages: an epoch begins where the rank falls, where the same banner comes again at or below the least rank
of the epoch, and at a restart.

Lines within a session are told apart and ordered by line_no. A null text is empty, a null session_id is no session; an empty table gives none.
"""

from __future__ import annotations

import pickle
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import UNPRINTABLE, printable_ratio, strip_escapes
from emberline.operators.index import required
from emberline.session import Scratch
from emberline.sources.profiles import Profile

#: Lines of a record, at most; lines that a trigger may take back.
RECORD_LINES, LOOK_BACK = 2000, 64
#: Lines of a segment, and of one that is rather folded when its state is known.
SEGMENT, SHORT = 1 << 16, 1 << 11

#: Different texts, each of which is judged once and sent to all tasks; of more, lines are judged where they stand.
TEXTS = 100_000

# What a line may be to a profile.
TRIGGER, TAKES_BACK, ENDS, GOES_ON, HEADER, FRAME, HELD, RESTARTS = (1 << k for k in range(8))
SEVERITY, CRASH = 8, 1 << 11
_OPENS = TRIGGER | HELD


@dataclass(frozen=True)
class Dialects:
    """Profiles by number: those that may be active first, by rank and name; overlays; and the one that is active at the start."""

    profiles: list[Profile]
    n_active: int
    start: int
    banners: list[tuple[int, str, int]]
    pinned: bool

    @staticmethod
    def of(profiles: list[Profile], pinned: str | None = None) -> Dialects:
        order = sorted(profiles, key=lambda p: (p.overlay, p.rank, p.name))
        if not any(p.name == "raw" for p in order):
            order.append(Profile("raw", "unknown", 100))
            order.sort(key=lambda p: (p.overlay, p.rank, p.name))
        banners = [(k, b.stage, b.rank) for k, p in enumerate(order) for b in p.banners if not p.overlay and p.name != "raw"]
        names = [p.name for p in order]
        return Dialects(order, sum(not p.overlay for p in order), names.index(pinned or "raw"), banners, pinned is not None)


#: What Java and the standard library's parser may read in different ways.
_APART = re.compile(r"&&|\[\[|\\\d|\(\?[a-zA-Z]*[uUx]")


def _words(pattern: str) -> list[str]:
    """Words in lower case, one of which at least is in what a pattern matches; none if it asks for none in particular."""
    groups = [] if _APART.search(pattern) else [[max(pieces, key=lambda x: len(x.text)).text for pieces in g] for g in required(pattern) if all(g)]
    return max(groups, key=lambda g: min(map(len, g)), default=[])


def _any(text: Column, patterns: list[str], lower: Column | None = None) -> Column:
    """Whether one of the patterns is in a text; with the text in lower case, patterns are only tried where it has one of their words."""
    if not patterns:
        return F.lit(False)
    told = [p for p in patterns if _words(p)] if lower is not None else []
    tried = lambda some: text.rlike("|".join(f"(?:{p})" for p in some))
    if not told:
        return tried(patterns)
    held = reduce(or_, [F.contains(lower, F.lit(w)) for w in sorted({w for p in told for w in _words(p)})])
    rest = [p for p in patterns if p not in told]
    return F.when(held, tried(patterns)).otherwise(tried(rest) if rest else F.lit(False))


def profile_key(text: Column, profile: Profile) -> Column:
    """What a profile's rules look at: the line from a message within it on, without the profile's prefixes, trimmed."""
    key = F.regexp_replace(text, "^\ufeff", "")
    for p in profile.all_of("mine_resync"):
        key = F.when(key.rlike(p), F.regexp_extract(key, f"(?s)(?:{p}).*$", 0)).otherwise(key)
    for p in profile.all_of("mine_strip"):
        key = F.regexp_replace(key, p, "")
    return F.trim(key) if profile.all_of("mine_strip", "mine_resync") else key


def _bits(text: Column, lower: Column, key: Column, low: Column, profile: Profile) -> Column:
    """What a line is to a profile; few lines are anything, and those are looked for with one pattern."""
    bit = lambda value, patterns: F.when(_any(key, patterns), value).otherwise(0)
    trigger = F.lit(0)
    for t in reversed(profile.triggers):
        trigger = F.when(key.rlike(t.pattern), TRIGGER | (TAKES_BACK if t.lookback else 0) | t.severity << SEVERITY | (CRASH if t.kind == "crash" else 0)).otherwise(trigger)
    of = profile.all_of
    known = trigger + bit(ENDS, of("terminators")) + bit(GOES_ON, of("continuations", "context", "backtrace_headers", "backtrace_frames"))
    known = known + bit(HEADER, of("backtrace_headers")) + bit(FRAME, of("backtrace_frames")) + bit(HELD, of("lookback"))
    some = [*(t.pattern for t in profile.triggers), *of("terminators", "continuations", "context", "backtrace_headers", "backtrace_frames", "lookback")]
    restarts = F.when(_any(text, of("reset_markers"), lower), RESTARTS).otherwise(0)
    return (F.when(_any(key, some, low), known).otherwise(0) + restarts).cast("smallint")


def judged(lines: DataFrame, dialects: Dialects, garbage: Column | None = None, *more: str) -> DataFrame:
    """session_id, line_no, further columns, garbage (0 or the kind of run), banner and claim (0 or a number from 1), m0, m1, ...: what each profile takes the line for."""
    text, lower, plain = F.col("text"), F.col("lower"), F.col("plain")
    bad = garbage if garbage is not None else F.when(plain.rlike(UNPRINTABLE), F.when(1 - printable_ratio(plain) >= 0.3, 1).otherwise(0)).otherwise(0)
    banner, k = F.lit(0), sum(len(p.banners) for p in dialects.profiles[: dialects.n_active] if p.name != "raw")
    for p in reversed(dialects.profiles[: dialects.n_active]):
        for b in reversed(p.banners if p.name != "raw" else ()):
            banner, k = F.when(_any(text, [b.pattern], lower), k).otherwise(banner), k - 1
    claim = F.lit(0)
    for number in range(len(dialects.profiles) - 1, dialects.n_active - 1, -1):
        p = dialects.profiles[number]
        claim = F.when(_any(text, p.all_of("overlay_match") or [b.pattern for b in p.banners], lower), number + 1).otherwise(claim)
    # What several expressions look at is a column of its own, so that it is made once a line.
    shown = lines.where("session_id is not null").withColumn("plain", strip_escapes(text)).withColumn("bad", bad).withColumn("text", F.coalesce("plain", F.lit("")))
    own = {p.name: f"key{n}" if p.all_of("mine_strip", "mine_resync") else "key" for n, p in enumerate(dialects.profiles)}
    shown = shown.withColumn("lower", F.lower("text")).withColumns({name: profile_key(text, p) for p in dialects.profiles for name in [own[p.name]]})
    shown = shown.withColumns({f"low_{name}": F.lower(name) for name in sorted(set(own.values()))})
    return shown.select(
        "session_id", F.col("line_no").cast("long").alias("line_no"), *more, F.coalesce("bad", F.lit(0)).cast("smallint").alias("garbage"),
        F.lit(0).cast("smallint").alias("banner") if dialects.pinned else banner.cast("smallint").alias("banner"), claim.cast("smallint").alias("claim"),
        *[_bits(text, lower, F.col(own[p.name]), F.col(f"low_{own[p.name]}"), p).alias(f"m{n}") for n, p in enumerate(dialects.profiles)],
    )


def judged_once(lines: DataFrame, dialects: Dialects, scratch: Scratch) -> DataFrame:
    """As ``judged``; where a log has few different texts, each of them is judged once and lines get that by a broadcast join."""
    if lines.agg(F.approx_count_distinct("text")).first()[0] > TEXTS:
        return judged(lines, dialects)
    texts = lines.select(F.lit(0).alias("session_id"), F.lit(0).alias("line_no"), "text").distinct().withColumn("raw", F.col("text"))
    known = scratch.write(judged(texts, dialects, None, "raw").drop("session_id", "line_no"), "texts")
    own = lines.where("session_id is not null").select("session_id", F.col("line_no").cast("long").alias("line_no"), "text")
    return own.join(F.broadcast(known), F.col("text").eqNullSafe(F.col("raw"))).drop("text", "raw")  # some more than TEXTS rows at most, as they were counted


class Segment:
    """The bits of consecutive lines."""

    def __init__(self, dialects: Dialects, line: np.ndarray, garbage: np.ndarray, banner: np.ndarray, claim: np.ndarray, marks: np.ndarray):
        self.dialects, self.line, self.garbage, self.banner, self.claim, self.marks = dialects, line, garbage, banner, claim, marks
        self.n = len(line)
        self._stops: dict[int, list[int]] = {}

    def packed(self) -> bytes:
        return zlib.compress(b"".join(x.tobytes() for x in (self.line, self.garbage, self.banner, self.claim, self.marks)), 1)

    @staticmethod
    def unpacked(dialects: Dialects, data: bytes) -> Segment:
        raw, width = zlib.decompress(data), len(dialects.profiles)
        n = len(raw) // (8 + 2 * (3 + width))
        short = np.frombuffer(raw, dtype=np.int16, offset=8 * n)
        return Segment(dialects, np.frombuffer(raw, dtype=np.int64, count=n), short[:n], short[n : 2 * n], short[2 * n : 3 * n], short[3 * n :].reshape(n, width))

    def stops(self, active: int) -> list[int]:
        """Where something happens while nothing is open."""
        if active not in self._stops:
            own = np.where(self.claim > 0, self.marks[np.arange(self.n), np.maximum(self.claim - 1, 0)], self.marks[:, active])
            self._stops[active] = np.flatnonzero((self.garbage > 0) | (self.banner > 0) | (self.marks[:, active] & RESTARTS > 0) | (own & _OPENS > 0)).tolist()
        return self._stops[active]


@dataclass
class State:
    """Between two lines. ``entry``: what is open comes from before the segment, whose own state isn't known."""

    active: int
    mode: str = "closed"
    owner: int = -1
    preamble: bool = False
    backtrace: bool = False
    first: int = -1
    last: int = -1
    size: int = 0
    severity: int = 9
    crash: bool = False
    taken: int = 0
    interleaved: bool = False
    kind: int = 0
    held: list[int] = field(default_factory=list)
    entry: bool = False

    def entered(self) -> tuple:
        """What the fold of a segment depends on."""
        return (self.active, self.mode) + ((self.owner, self.preamble, self.backtrace) if self.mode == "open" else (self.kind,) if self.mode == "garbage" else ())


class Sink:
    """Gets what a fold finds."""

    def __init__(self) -> None:
        self.events: list[tuple[int, int]] = []
        #: Lines of a record that was open at the start.
        self.grown = 0

    def event(self, at: int, banner: int) -> None:
        self.events.append((at, banner))

    def cover(self, at: int) -> None:
        pass

    def release(self, held: list[int], active: int) -> None:
        pass

    def opened(self, at: int, state: State) -> None:
        pass

    def closed(self, state: State, why: str, truncated: bool = False) -> None:
        if state.entry or state.first == _BEFORE:
            self.grown = state.size


def fold(seg: Segment, s: State, sink: Sink, memo: dict | None = None, at: int = 0) -> tuple | None:
    """Goes over the lines from ``at`` on and changes the state. With a memo, stops where another fold has been with nothing open, and gives that place."""
    i = at
    while i < seg.n:
        if s.mode == "closed":
            stops = seg.stops(s.active)
            k = bisect_left(stops, i)
            i = stops[k] if k < len(stops) else seg.n
            if memo is not None:
                key = (s.active, i)
                if key in memo:
                    return key
                memo[key] = (sink, len(sink.events))
            if i == seg.n:
                break
            _step_closed(seg, s, sink, i)
            i += 1
            continue
        if s.mode == "garbage":
            if seg.garbage[i] == s.kind:
                s.size, s.last = s.size + 1, int(seg.line[i])
                sink.cover(i)
                i += 1
                continue
            sink.closed(s, "run_ended")
            s.mode, s.entry = "closed", False
            continue  # the line is looked at again with nothing open
        if s.mode == "held":
            own = _own(seg, s, i)
            if not (seg.garbage[i] or seg.banner[i] or seg.marks[i, s.active] & RESTARTS) and own & _OPENS:
                _step_closed(seg, s, sink, i)
                i += 1
                continue
            sink.release(s.held, s.active)
            s.mode, s.held, s.entry = "closed", [], False
            continue
        # A record is open.
        mark = 0 if seg.garbage[i] else int(seg.marks[i, s.owner])
        if mark & ENDS:
            _append(seg, s, sink, i)
            sink.closed(s, "terminator")
            s.mode, s.entry = "closed", False
            if seg.banner[i] or seg.marks[i, s.active] & RESTARTS:
                _observe(seg, s, sink, i)
            i += 1
        elif mark & TRIGGER and mark & TAKES_BACK and s.preamble:
            _append(seg, s, sink, i)
            s.severity, s.crash, s.preamble = min(s.severity, mark >> SEVERITY & 7), bool(mark & CRASH), False
            i += 1
        elif mark & TRIGGER:
            sink.closed(s, "nested_trigger")
            _open(seg, s, sink, i, s.owner, mark)
            i += 1
        elif mark & GOES_ON:
            _append(seg, s, sink, i)
            s.backtrace = s.backtrace or bool(mark & HEADER)
            s.interleaved = s.interleaved or (s.backtrace and not mark & FRAME)
            if s.size >= RECORD_LINES and not s.entry:
                sink.closed(s, "max_record_lines", True)
                s.mode = "closed"
            i += 1
        else:
            sink.closed(s, "garbage" if seg.garbage[i] else "unrelated_line")
            s.mode, s.entry = "closed", False
    return None


def _own(seg: Segment, s: State, i: int) -> int:
    return int(seg.marks[i, seg.claim[i] - 1 if seg.claim[i] else s.active])


def _observe(seg: Segment, s: State, sink: Sink, i: int) -> None:
    banner = int(seg.banner[i])
    sink.event(i, banner)
    if banner:
        s.active = seg.dialects.banners[banner - 1][0]


def _append(seg: Segment, s: State, sink: Sink, i: int) -> None:
    s.size, s.last = s.size + 1, int(seg.line[i])
    sink.cover(i)


def _open(seg: Segment, s: State, sink: Sink, i: int, owner: int, mark: int) -> None:
    line, held = int(seg.line[i]), s.held if mark & TAKES_BACK else []
    if s.held and not held:
        sink.release(s.held, s.active)
    s.mode, s.owner, s.preamble, s.backtrace, s.interleaved, s.entry = "open", owner, bool(mark & HELD), False, False, False
    s.first, s.last, s.size, s.taken, s.held = held[0] if held else line, line, 1 + len(held), len(held), []
    s.severity, s.crash = mark >> SEVERITY & 7, bool(mark & CRASH)
    sink.cover(i)
    sink.opened(i, s)


def _step_closed(seg: Segment, s: State, sink: Sink, i: int) -> None:
    """A line at which something happens, with nothing open but lines that are held."""
    own = _own(seg, s, i)
    if seg.garbage[i]:
        s.mode, s.kind, s.first, s.last, s.size, s.entry = "garbage", int(seg.garbage[i]), int(seg.line[i]), int(seg.line[i]), 1, False
        sink.cover(i)
        sink.opened(i, s)
    elif seg.banner[i] or seg.marks[i, s.active] & RESTARTS:
        _observe(seg, s, sink, i)
    elif own & TRIGGER:
        _open(seg, s, sink, i, int(seg.claim[i]) - 1 if seg.claim[i] else s.active, own)
    elif own & HELD:
        s.mode = "held"
        s.held = [*s.held, int(seg.line[i])]
        if len(s.held) > LOOK_BACK:
            sink.release(s.held[:1], s.active)
            s.held = s.held[1:]


#: Stands for held lines of an earlier segment.
_BEFORE = -(2**62)


def entry_states(dialects: Dialects, kinds: range = range(1, 3)) -> list[State]:
    """All states that a segment may be entered in."""
    out = []
    for a in range(dialects.n_active):
        out += [State(a), State(a, "held", held=[_BEFORE], entry=True), *(State(a, "garbage", kind=k, entry=True) for k in kinds)]
        for owner in (a, *range(dialects.n_active, len(dialects.profiles))):
            out += [State(a, "open", owner, p, b, entry=True) for p in (False, True) for b in (False, True)]
    return out


def summarised(seg: Segment) -> bytes:
    """The segment's function: of each state that it may be entered in, the state in which it is left, banners and restarts, and how a record has grown."""
    memo: dict = {}
    ends: dict[int, tuple[State, tuple | None]] = {}  # by sink
    classes = {}
    for state in entry_states(seg.dialects):
        name, sink = state.entered(), Sink()
        goto = fold(seg, state, sink, memo)
        if state.mode == "open" and (state.entry or state.first == _BEFORE):
            sink.grown = state.size
        classes[name] = sink
        ends[id(sink)] = (state, goto)
    tails: dict = {}

    def tail(key: tuple) -> tuple[bytes, State]:
        """Banners from a place on, and the state at the end."""
        chain = []
        while key is not None and key not in tails:
            chain.append(key)
            key = ends[id(memo[key][0])][1]
        for k in reversed(chain):
            sink, seen = memo[k]
            state, goto = ends[id(sink)]
            own = bytes(b for _, b in sink.events[seen:])
            tails[k] = (own + tails[goto][0], tails[goto][1]) if goto is not None else (own, state)
        return tails[chain[0]] if chain else tails[key]

    out, shared = {}, {}
    for name, sink in classes.items():
        state, goto = ends[id(sink)]
        own = bytes(b for _, b in sink.events)
        banners, left = (own, state) if goto is None else (own + tail(goto)[0], tail(goto)[1])
        out[name] = (shared.setdefault(banners, banners), left, sink.grown)
    return pickle.dumps(out)


@dataclass(frozen=True)
class Boot:
    """Stage and epoch between two lines."""

    banner: int = 0
    stage: str = "unknown"
    rank: int | None = None
    least: int | None = None
    seen: frozenset = frozenset()
    epoch: int = 0

    def after(self, banner: int, dialects: Dialects, active: int) -> tuple[Boot, bool, bool]:
        """What a banner (or 0, a restart) makes of it, whether an epoch begins, and whether the stage changes."""
        if not banner:
            p = dialects.profiles[active]
            rank = self.rank if self.rank is not None else p.rank
            return Boot(self.banner, p.stage, rank, rank, frozenset(), self.epoch + 1), True, False
        _, stage, rank = dialects.banners[banner - 1]
        resets = self.rank is not None and (rank < self.rank or (rank <= self.least and banner in self.seen))
        if resets:
            return Boot(banner, stage, rank, rank, frozenset([banner]), self.epoch + 1), True, stage != self.stage
        least = rank if self.least is None else min(self.least, rank)
        return Boot(banner, stage, rank, least, self.seen | {banner}, self.epoch), False, stage != self.stage


def _started(dialects: Dialects) -> tuple[State, Boot]:
    p = dialects.profiles[dialects.start]
    return State(dialects.start), Boot(stage=p.stage, rank=p.rank, least=p.rank) if dialects.pinned else Boot()


def _applied(name_state: State, found: tuple[bytes, State, int]) -> State | None:
    """The state in which a segment is left that is entered in a known one; none if a record might have to be cut within."""
    _, left, grown = found
    most = name_state.size if name_state.mode == "open" else LOOK_BACK if name_state.mode == "held" else -RECORD_LINES
    if most + grown >= RECORD_LINES:
        return None
    left = replace(left, held=list(left.held))
    if left.held and left.held[0] == _BEFORE:
        left.held = [*name_state.held, *left.held[1:]][-LOOK_BACK:]
    if left.mode == "open" and left.first == _BEFORE:  # it has taken back lines from before
        taken = min(LOOK_BACK, len(name_state.held) + left.taken - 1)
        left = replace(left, first=name_state.held[max(0, len(name_state.held) + left.taken - 1 - LOOK_BACK)], size=left.size + taken - left.taken, taken=taken)
    if not left.entry:
        return left
    if left.mode == "held":
        return replace(left, entry=False)
    went_on = left.size > 0
    new = replace(name_state, active=left.active, size=name_state.size + left.size, last=left.last if went_on else name_state.last)
    if left.mode == "open":
        absorbed = name_state.preamble and not left.preamble
        new = replace(new, preamble=left.preamble, backtrace=left.backtrace, interleaved=name_state.interleaved or left.interleaved)
        if absorbed:
            new = replace(new, severity=min(name_state.severity, left.severity), crash=left.crash)
    return new


class _Records(Sink):
    """Collects records, and which lines they cover, of a segment whose state at the start is known."""

    def __init__(self, seg: Segment, state: State, boot: Boot, opened: Boot):
        super().__init__()
        self.seg, self.boot, self.open_boot = seg, boot, opened
        self.covered = np.zeros(seg.n, dtype=bool)
        self.released: list[int] = []
        self.rows: list[tuple] = []
        self.turns: list[tuple[int, int, Boot]] = [(0, state.active, boot)]
        self.changes: list[tuple] = []

    def event(self, at: int, banner: int) -> None:
        d = self.seg.dialects
        active = d.banners[banner - 1][0] if banner else self.turns[-1][1]
        self.boot, resets, changes = self.boot.after(banner, d, active)
        self.turns.append((at, active, self.boot))
        if resets or changes:
            self.changes.append((int(self.seg.line[at]), self.boot.stage, self.boot.rank, self.boot.epoch, resets))

    def cover(self, at: int) -> None:
        self.covered[at] = True

    def opened(self, at: int, state: State) -> None:
        self.open_boot = self.boot
        if state.mode == "open":
            self.covered[max(0, at - state.taken) : at] = True  # held lines stand right before

    def release(self, held: list[int], active: int) -> None:
        """Held lines go by the active profile, whoever claims them."""
        for line in held:
            k = int(np.searchsorted(self.seg.line, line))
            if k < self.seg.n and self.seg.line[k] == line:
                self.released.append(k)
            else:
                self.rows.append((line, line, 1, "line", self.seg.dialects.profiles[active].name, self.boot.stage, self.boot.epoch, None, "single", False, 0, False))

    def closed(self, state: State, why: str, truncated: bool = False) -> None:
        name = self.seg.dialects.profiles[state.owner if state.mode == "open" else state.active].name
        kind = "garbage" if state.mode == "garbage" else "crash" if state.crash else "line"
        severity = None if state.mode == "garbage" else state.severity
        self.rows.append((state.first, state.last, state.size, kind, name, self.open_boot.stage, self.open_boot.epoch, severity, why, truncated, state.taken if state.mode == "open" else 0, state.interleaved and state.mode == "open"))

    def singles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines that no record covers, each a record: line, profile and the number of the turn."""
        own = np.flatnonzero(~self.covered)
        turn = np.searchsorted([at for at, *_ in self.turns], own, "right") - 1
        claim = self.seg.claim.astype(np.int64)
        claim[self.released] = 0
        active = np.array([a for _, a, _ in self.turns])
        return self.seg.line[own], np.where(claim[own] > 0, claim[own] - 1, active[turn]), turn


def _folded(seg: Segment, state: State, boot: Boot, opened: Boot) -> _Records:
    sink = _Records(seg, state, boot, opened)
    fold(seg, state, sink)
    for line in state.held:  # they may belong to what comes
        k = int(np.searchsorted(seg.line, line))
        if k < seg.n and seg.line[k] == line:
            sink.covered[k] = True
    return sink


_RESULT = "first_line long, last_line long, n_lines long, kind string, profile string, stage string, epoch long, severity int, closed_by string, truncated boolean, retro_attached int, interleaved boolean"


class Framed:
    """Segments of sessions, and the state that each is entered in."""

    def __init__(self, lines: DataFrame, profiles: list[Profile], pinned: str | None = None, segment: int = SEGMENT, garbage: Column | None = None):
        self.dialects = Dialects.of(profiles, pinned)
        self.kind = lines.schema["session_id"].dataType.simpleString()
        scratch = Scratch(lines.sparkSession, "framing")
        marked = (judged_once(lines, self.dialects, scratch) if garbage is None else judged(lines, self.dialects, garbage)).withColumn("segment", F.floor(F.col("line_no") / segment))
        ordered = marked.repartition("session_id", "segment").sortWithinPartitions("session_id", "segment", "line_no")
        packed = ordered.mapInArrow(_packing(self.dialects), f"session_id {self.kind}, segment long, data binary, summary binary")
        self.packed = scratch.write(packed, "segments")
        entered = f"session_id {self.kind}, segment long, entry binary, last boolean, known boolean"
        # Long segments come as their functions, short ones with their bits.
        rows = self.packed.select("session_id", "segment", F.when(F.col("summary").isNull(), F.col("data")).alias("data"), "summary")
        scan = lambda df: df.repartition("session_id").sortWithinPartitions("session_id", "segment").mapInArrow(_scanning(self.dialects), entered)
        first = scratch.write(scan(rows), "entries")
        again = scratch.write(first.where("not known").select("session_id").distinct(), "again")
        if again.isEmpty():
            self.entries = first
        else:
            whole = self.packed.join(again, "session_id", "left_semi").select("session_id", "segment", "data", F.lit(None).cast("binary").alias("summary"))
            self.entries = scratch.write(first.join(again, "session_id", "left_anti").select(*first.columns).unionByName(scan(whole)), "entries-again")

    def _entered(self) -> DataFrame:
        return self.packed.select("session_id", "segment", "data").join(self.entries.drop("known"), ["session_id", "segment"])

    def records(self) -> DataFrame:
        return self._entered().mapInArrow(_recording(self.dialects), f"session_id {self.kind}, {_RESULT}")

    def stages(self) -> DataFrame:
        return self._entered().mapInArrow(_staging(self.dialects), f"session_id {self.kind}, line_no long, stage string, rank int, epoch long, resets boolean")


def _packing(dialects: Dialects):
    names = ["line_no", "garbage", "banner", "claim", *(f"m{k}" for k in range(len(dialects.profiles)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a segment. Its lines come together and in order, though not always in one batch."""
        pending: list[list[np.ndarray]] = []
        owner: tuple | None = None
        out: list[tuple] = []

        def finish() -> None:
            columns = [np.concatenate(c) for c in zip(*pending, strict=True)]
            seg = Segment(dialects, columns[0], *columns[1:4], np.ascontiguousarray(np.column_stack(columns[4:])))
            out.append((*owner, seg.packed(), summarised(seg) if seg.n >= SHORT else None))

        def taken(kinds: pa.Schema) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (kinds.field("session_id").type, pa.int64(), pa.binary(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["session_id", "segment", "data", "summary"])

        for batch in batches:
            if not batch.num_rows:
                continue
            values = [np.ascontiguousarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in names]
            session, segment = batch.column("session_id"), batch.column("segment").to_numpy()
            new = pc.not_equal(session.slice(1), session.slice(0, len(session) - 1)).fill_null(True).to_numpy(zero_copy_only=False) | (segment[1:] != segment[:-1])
            starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(starts, starts[1:], strict=False):
                own = (session[lo].as_py(), int(segment[lo]))
                if own != owner:
                    if pending:
                        finish()
                    pending, owner = [], own
                pending.append([v[lo:hi] for v in values])
            if out:
                yield taken(batch.schema)
                out.clear()
            kinds = batch.schema
        if pending:
            finish()
            yield taken(kinds)

    return run


def _scanning(dialects: Dialects):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state in which each segment is entered, in order, and whether it is the session's last."""
        session, state, boot, opened, known = object(), None, None, None, True
        held: tuple | None = None  # the row before, whose being the last isn't known yet
        kinds = None
        for batch in batches:
            out = []
            kinds = batch.schema
            for row in range(batch.num_rows):
                own, segment = batch.column("session_id")[row].as_py(), batch.column("segment")[row].as_py()
                data, summary = batch.column("data")[row].as_py(), batch.column("summary")[row].as_py()
                if own != session:
                    if held:
                        out.append((*held[:3], True, held[3]))
                    held = None
                    (state, boot), opened, session, known = _started(dialects), Boot(), own, True
                if held:
                    out.append((*held[:3], False, held[3]))
                held = (own, segment, pickle.dumps((state, boot, opened)) if known else b"", known)
                if not known:
                    continue
                state = replace(state, held=list(state.held))
                if data is not None:
                    sink = _folded(Segment.unpacked(dialects, data), state, boot, opened)
                    boot, opened = sink.boot, sink.open_boot
                    continue
                found = pickle.loads(summary)[state.entered()]
                left = _applied(state, found)
                if left is None:
                    known = False
                    continue
                active = state.active
                for banner in found[0]:
                    active = dialects.banners[banner - 1][0] if banner else active
                    boot, _, _ = boot.after(banner, dialects, active)
                    # What is open at the end was opened after the last banner, unless it comes from before.
                if left.mode in ("open", "garbage") and not found[1].entry:
                    opened = boot
                state = left
            if out:
                yield _entries(out, kinds)
        if held:
            yield _entries([(*held[:3], True, held[3])], kinds)

    return run


def _entries(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kinds.field("session_id").type, pa.int64(), pa.binary(), pa.bool_(), pa.bool_()), strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["session_id", "segment", "entry", "last", "known"])


def finish(sink: _Records, state: State, why: str, truncated: bool) -> None:
    """Closes what is open after the last line, and lets go of held lines."""
    for line in state.held:
        k = int(np.searchsorted(sink.seg.line, line))
        if k < sink.seg.n and sink.seg.line[k] == line:
            sink.covered[k] = False
    sink.release(state.held, state.active)
    if state.mode == "open":
        sink.closed(state, why, truncated)
    elif state.mode == "garbage":
        sink.closed(state, "run_ended")
    state.mode, state.held = "closed", []


def _each(dialects: Dialects, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, _Records, pa.DataType]]:
    """Each segment, folded from the state that it is entered in; at the session's end what is open is closed."""
    for batch in batches:
        for row in range(batch.num_rows):
            state, boot, opened = pickle.loads(batch.column("entry")[row].as_py())
            seg = Segment.unpacked(dialects, batch.column("data")[row].as_py())
            sink = _folded(seg, state, boot, opened)
            if batch.column("last")[row].as_py():
                finish(sink, state, "stream_end", True)
            yield batch.column("session_id")[row], sink, batch.schema.field("session_id").type


def _recording(dialects: Dialects):
    names = ["session_id", *(c.split()[0] for c in _RESULT.split(", "))]
    kinds = [pa.int64()] * 3 + [pa.string()] * 3 + [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.bool_()]
    profiles = pa.array([p.name for p in dialects.profiles])

    def batch_of(session: pa.Scalar, kind: pa.DataType, columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(session, len(columns[0])).cast(kind), *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []
        for session, sink, kind in _each(dialects, batches):
            if sink.rows:
                ready.append(batch_of(session, kind, [pa.array(c, t) for c, t in zip(zip(*sink.rows, strict=True), kinds, strict=True)]))
            line, profile, turn = sink.singles()
            if n := len(line):
                same = lambda value, k: pa.repeat(pa.scalar(value, kinds[k]), n)  # noqa: E731, B023
                own = [pa.array(line)] * 2 + [same(1, 2), same("line", 3), profiles.take(pa.array(profile))]
                own += [pa.array([boot.stage for *_, boot in sink.turns]).take(pa.array(turn)), pa.array([boot.epoch for *_, boot in sink.turns], pa.int64()).take(pa.array(turn))]
                ready.append(batch_of(session, kind, [*own, same(None, 7), same("single", 8), same(False, 9), same(0, 10), same(False, 11)]))
            if sum(b.num_rows for b in ready) >= 20_000 or len(ready) >= 500:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready.clear()
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return run


def _staging(dialects: Dialects):
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for session, sink, kind in _each(dialects, batches):
            if sink.changes:
                columns = [pa.array(c, t) for c, t in zip(zip(*sink.changes, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.repeat(session, len(sink.changes)).cast(kind), *columns], ["session_id", "line_no", "stage", "rank", "epoch", "resets"])

    return run


def frame(lines: DataFrame, profiles: list[Profile], **how) -> DataFrame:
    """Records that tile the lines: session_id, first_line, last_line, n_lines, kind (crash, line or garbage), profile, stage and epoch at its start, severity (of its
    trigger, the worst), closed_by, truncated, retro_attached (lines taken back), interleaved (a line within a backtrace that is no frame).

    closed_by: single, terminator, nested_trigger, unrelated_line, max_record_lines, garbage, stream_end; run_ended of garbage.
    """
    return Framed(lines, profiles, **how).records()


def stages(lines: DataFrame, profiles: list[Profile], **how) -> DataFrame:
    """session_id, line_no, stage, rank, epoch, resets: the lines at which the stage changes or an epoch begins.

    A second banner of a stage, such as a kernel's two lines, gives no row unless it begins an epoch. With a ``pinned`` profile banners say nothing, and its restarts begin epochs.
    """
    return Framed(lines, profiles, **how).stages()


def tiling_faults(records: DataFrame, lines: DataFrame) -> DataFrame:
    """Sessions whose records don't tile their lines: session_id, lines, in_records, spans."""
    own = lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"))
    framed = records.groupBy("session_id").agg(F.sum("n_lines").alias("in_records"), F.sum(F.col("last_line") - F.col("first_line") + 1).alias("spans"))
    return own.join(framed, "session_id", "full").where("not (lines <=> in_records) or not (lines <=> spans)")


def garbage_runs(lines: DataFrame, least: float = 0.3) -> DataFrame:
    """session_id, from_line, to_line: runs of lines of which so large a part doesn't print."""
    from pyspark.sql import Window

    from emberline.functions.text import printable_ratio

    bad = lines.where((1 - printable_ratio(F.col("text"))) >= least).select("session_id", "line_no")
    order = Window.partitionBy("session_id").orderBy("line_no")
    runs = bad.withColumn("run", F.col("line_no") - F.row_number().over(order))
    return runs.groupBy("session_id", "run").agg(F.min("line_no").alias("from_line"), F.max("line_no").alias("to_line")).drop("run")
