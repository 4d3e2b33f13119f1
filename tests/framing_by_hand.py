"""Framing one line after the other, over texts, as plainly as it can be said."""

import re

from emberline.operators.framing import LOOK_BACK

OVERFULL = "max_record_lines"


class ByHand:
    def __init__(self, profiles, record_lines=2000, garbage=lambda text: False):
        self.profiles = sorted((p for p in profiles if not p.overlay), key=lambda p: (p.rank, p.name))
        self.overlays = sorted((p for p in profiles if p.overlay), key=lambda p: (p.rank, p.name))
        self.raw = next(p for p in profiles if p.name == "raw")
        self.record_lines, self.garbage = record_lines, garbage

    def has(self, profile, fields, text):
        return any(re.search(p, text) for p in profile.all_of(*fields))

    def key(self, profile, text):
        for p in profile.all_of("mine_resync"):
            if m := re.search(p, text):
                text = text[m.start() :]
        for p in profile.all_of("mine_strip"):
            text = re.sub(p, "", text)
        return text.strip(" ") if profile.all_of("mine_strip", "mine_resync") else text

    def trigger(self, profile, key):
        return next((t for t in profile.triggers if re.search(t.pattern, key)), None)

    def run(self, texts):
        """Records (first, last, n, kind, profile, stage, epoch, severity, closed_by, truncated, retro_attached, interleaved) and stages (line, stage, rank, epoch, resets)."""
        out, stages = [], []
        active, stage, rank, least, seen, epoch = self.raw, "unknown", None, None, set(), 0
        record, run, held = None, None, []

        def close(why, truncated=False):
            nonlocal record
            if record:
                r = record
                out.append((r["lines"][0], r["lines"][-1], len(r["lines"]), r["kind"], r["owner"].name, r["stage"], r["epoch"], r["severity"], why, truncated, r["taken"], r["interleaved"]))
            record = None

        def close_run():
            nonlocal run
            if run:
                out.append((run["lines"][0], run["lines"][-1], len(run["lines"]), "garbage", run["owner"].name, run["stage"], run["epoch"], None, "run_ended", False, 0, False))
            run = None

        def single(line, owner):
            out.append((line, line, 1, "line", owner.name, stage, epoch, None, "single", False, 0, False))

        def release():
            for line in held:
                single(line, active)
            held.clear()

        def observe(line, text):
            """Whether the line is a banner or a restart."""
            nonlocal active, stage, rank, least, seen, epoch
            for p in self.profiles:
                for k, b in enumerate(p.banners):
                    if p.name != "raw" and re.search(b.pattern, text):
                        resets = rank is not None and (b.rank < rank or (b.rank <= least and (p.name, k) in seen))
                        changes = b.stage != stage
                        if resets:
                            epoch, least, seen = epoch + 1, b.rank, set()
                        least = b.rank if least is None else min(least, b.rank)
                        seen.add((p.name, k))
                        active, stage, rank = p, b.stage, b.rank
                        if resets or changes:
                            stages.append((line, stage, rank, epoch, resets))
                        return True
            if self.has(active, ["reset_markers"], text):
                rank = active.rank if rank is None else rank
                epoch, least, seen, stage = epoch + 1, rank, set(), active.stage
                stages.append((line, stage, rank, epoch, True))
                return True
            return False

        def open_(line, owner, trigger, key):
            nonlocal record
            taken = list(held) if trigger.lookback else []
            if not trigger.lookback:
                release()
            held.clear()
            record = {"lines": [*taken, line], "kind": trigger.kind, "owner": owner, "stage": stage, "epoch": epoch, "severity": trigger.severity, "taken": len(taken), "interleaved": False, "preamble": self.has(owner, ["lookback"], key), "back": False}

        for line, text in enumerate(texts):
            if self.garbage(text):
                close("garbage")
                release()
                if not run:
                    run = {"lines": [], "owner": active, "stage": stage, "epoch": epoch}
                run["lines"].append(line)
                continue
            close_run()
            if record:
                owner = record["owner"]
                key = self.key(owner, text)
                trigger = self.trigger(owner, key)
                if self.has(owner, ["terminators"], key):
                    record["lines"].append(line)
                    close("terminator")
                    observe(line, text)
                    continue
                if trigger and trigger.lookback and record["preamble"]:
                    record["lines"].append(line)
                    record.update(severity=min(record["severity"], trigger.severity), kind=trigger.kind, preamble=False)
                    continue
                if trigger:
                    close("nested_trigger")
                    open_(line, owner, trigger, key)
                    continue
                header, frame = self.has(owner, ["backtrace_headers"], key), self.has(owner, ["backtrace_frames"], key)
                if header or frame or self.has(owner, ["continuations", "context"], key):
                    record["back"] |= header
                    record["interleaved"] |= record["back"] and not frame
                    record["lines"].append(line)
                    if len(record["lines"]) >= self.record_lines:
                        close(OVERFULL, True)
                    continue
                close("unrelated_line")
            before = list(held)
            held_by = active
            if observe(line, text):
                held.clear()
                for k in before:  # they were lines of the dialect, stage and epoch before this one
                    out.append((k, k, 1, "line", held_by.name, *self.at_hold, None, "single", False, 0, False))
                single(line, active)
                continue
            owner = next((o for o in self.overlays if self.has(o, ["overlay_match"], text)), active)
            key = self.key(owner, text)
            trigger = self.trigger(owner, key)
            if trigger:
                open_(line, owner, trigger, key)
            elif self.has(owner, ["lookback"], key):
                held.append(line)
                self.at_hold = (stage, epoch)
                if len(held) > LOOK_BACK:
                    single(held.pop(0), active)
            else:
                release()
                single(line, owner)
        release()
        close("stream_end", True)
        close_run()
        return sorted(out), stages
