"""Records, stages and garbage: on small logs written for these tests, and against framing by hand."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberline.operators import framing
from emberline.sources.profiles import PROFILES
from tests.framing_by_hand import ByHand

LINUX = """[    0.000000] Linux version 6.1.0 (builder@host) #1 SMP
[    0.100000] usb 1-1: new device
[    5.000000] Unable to handle kernel NULL pointer dereference at 0
[    5.000001] Call trace:
[    5.000002]  do_thing+0x10/0x20
[    5.000003] ---[ end trace 0000 ]---
[    6.000000] systemd: started
U-Boot 2024.01
[    0.000000] Linux version 6.1.0 (builder@host) #1 SMP
Kernel panic - not syncing: fatal
login:""".split("\n")


def frame(spark, texts, session=1):
    return spark.createDataFrame([(session, k, t) for k, t in enumerate(texts)], "session_id long, line_no long, text string")


def long_ones(records):
    return [tuple(r)[1:] for r in sorted(records.collect(), key=lambda r: r["first_line"]) if r["n_lines"] > 1 or r["kind"] != "line"]


def test_crash_is_one_record_and_records_tile(spark):
    lines = frame(spark, LINUX)
    records = framing.frame(lines, PROFILES)
    crashes = {(r["first_line"], r["last_line"], r["closed_by"], r["stage"], r["epoch"], r["severity"]) for r in records.collect() if r["kind"] == "crash"}
    assert crashes == {(2, 5, "terminator", "kernel", 0, 0), (9, 9, "unrelated_line", "kernel", 1, 0)}
    assert framing.tiling_faults(records, lines).count() == 0


def test_the_active_dialect_alone_judges(spark):
    texts = ["Guru Meditation Error: Core 0", "U-Boot 2024.01", "Guru Meditation Error: Core 0", "rst:0x1 (POWERON)", "Guru Meditation Error: Core 0", "Core 0 register dump:", "Rebooting...", "x"]
    assert long_ones(framing.frame(frame(spark, texts), PROFILES)) == [(4, 6, 3, "crash", "freertos", "freertos", 0, 0, "terminator", False, 0, False)]


def test_preamble_is_taken_back_and_completed(spark):
    texts = ["*** Booting Zephyr OS", "ok", "*** fault registers", "=== r0 0", "ZEPHYR FATAL ERROR 0", "E: pc 0", "Halting system", "ok"]
    assert [r[:4] + r[8:] for r in long_ones(framing.frame(frame(spark, texts), PROFILES))] == [(2, 6, 5, "crash", "terminator", False, 2, False)]
    texts = ["*** Booting Zephyr OS", "E: ***** MPU FAULT *****", "E: pc 0", "ZEPHYR FATAL ERROR 0", "E: lr 0", "ok"]
    assert [r[:4] + r[8:9] for r in long_ones(framing.frame(frame(spark, texts), PROFILES))] == [(1, 4, 4, "crash", "unrelated_line")]


def test_overlays_own_their_lines(spark):
    texts = ["Linux version 6.1.0", "E/TC:0 0 Core data-abort at address 0x0", "E/TC:0 0  x0 0 x1 1", "E/TC:0 0 Call stack:", "E/TC:0 0  0x0e1020", "[ 1.0] usb 1-1: new", "E/TC:0 0 note"]
    got = framing.frame(frame(spark, texts), PROFILES).collect()
    assert [(r["first_line"], r["last_line"], r["profile"], r["stage"]) for r in sorted(got, key=lambda r: r["first_line"])] == [(0, 0, "linux", "kernel"), (1, 4, "optee", "kernel"), (5, 5, "linux", "kernel"), (6, 6, "optee", "kernel")]


def test_nested_interleaved_and_truncated(spark):
    texts = ["Linux version 6.1.0", "Oops: 0000", "Call Trace:", " f+0x1/0x2", " CPU: 1 PID: 2", "Kernel panic - not syncing: x", " g+0x1/0x2"]
    assert [r[:4] + r[8:] for r in long_ones(framing.frame(frame(spark, texts), PROFILES))] == [(1, 4, 4, "crash", "nested_trigger", False, 0, True), (5, 6, 2, "crash", "stream_end", True, 0, False)]
    texts = ["Linux version 6.1.0", "Oops: 0000", *["CPU: 1"] * 5000, "x"]
    for segment in (1 << 16, 700):
        assert [r[:3] + r[8:] for r in long_ones(framing.frame(frame(spark, texts), PROFILES, segment=segment))] == [(1, 2000, 2000, "max_record_lines", True, 0, False)]


def test_stages_and_epochs(spark):
    got = [(r["stage"], r["epoch"]) for r in framing.stages(frame(spark, LINUX), PROFILES).orderBy("line_no").collect()]
    assert got == [("kernel", 0), ("uboot", 1), ("kernel", 1)]


def epochs(spark, texts, **how):
    return [(r["line_no"], r["stage"], r["epoch"]) for r in framing.stages(frame(spark, texts), PROFILES, **how).orderBy("line_no").collect()]


def test_loaders_and_a_kernel_s_second_banner_are_one_epoch(spark):
    boot = ["NOTICE:  BL1: v2.9", "NOTICE:  BL2: v2.9", "U-Boot SPL 2024.01", "U-Boot 2024.01", "Linux version 6.1.0", "Booting Linux on physical CPU 0x0"]
    assert epochs(spark, boot * 2) == [(0, "firmware", 0), (2, "uboot", 0), (4, "kernel", 0), (6, "firmware", 1), (8, "uboot", 1), (10, "kernel", 1)]


def test_a_banner_is_known_by_its_pattern_not_its_text(spark):
    assert epochs(spark, ["U-Boot 2023.01", "U-Boot 2024.01", "U-Boot 2025.01"]) == [(0, "uboot", 0), (1, "uboot", 1), (2, "uboot", 2)]
    assert epochs(spark, ["Linux version 5.1", "Linux version 6.1"]) == [(0, "kernel", 0), (1, "kernel", 1)]
    assert epochs(spark, ["U-Boot SPL 2023.01", "U-Boot 2023.01"] * 2) == [(0, "uboot", 0), (2, "uboot", 1)]


def test_a_loader_that_loops_in_place(spark):
    assert epochs(spark, ["U-Boot SPL 2024.01", "U-Boot SPL 2024.01", "U-Boot 2024.01", "U-Boot SPL 2024.01"]) == [(0, "uboot", 0), (1, "uboot", 1), (3, "uboot", 2)]
    assert epochs(spark, ["Linux version 6.1.0"] * 3) == [(0, "kernel", 0), (1, "kernel", 1), (2, "kernel", 2)]


def test_restarts_count_in_the_dialect_of_the_last_banner_only(spark):
    texts = ["reboot: Restarting system", "U-Boot 2024.01", "reboot: Restarting system", "resetting ...", "U-Boot 2024.01", "Linux version 6.1.0", "resetting ...", "[ 1.0] reboot: Restarting system", "U-Boot 2024.01"]
    assert epochs(spark, texts) == [(1, "uboot", 0), (3, "uboot", 1), (5, "kernel", 1), (7, "kernel", 2), (8, "uboot", 3)]


def test_a_pinned_profile_takes_no_banners_but_restarts(spark):
    texts = ["U-Boot 2024.01", "reboot: Restarting system", "Oops: 0000"]
    assert epochs(spark, texts, pinned="linux") == [(1, "kernel", 1)]
    assert [r[:5] for r in long_ones(framing.frame(frame(spark, texts), PROFILES, pinned="linux"))] == [(2, 2, 1, "crash", "linux")]


POOL = """Linux version 6.1.0|[    0.1] Booting Linux on physical CPU 0x0|U-Boot SPL 2024.01|U-Boot 2024.01|NOTICE:  BL1: v2.9|rst:0x1 (POWERON)|*** Booting Zephyr OS|UEFI firmware
[ 5.0] Unable to handle kernel NULL pointer|Oops: 0000 [#1]|[ 5.1] ---[ cut here ]---|WARNING: CPU: 1 PID: 2 at f|Kernel panic - not syncing: x|[ 5.2] Call trace:|[ 5.3]  f+0x1/0x2|[ 5.4] ---[ end trace 0 ]---
 indented|  x0: 0|CPU: 1 PID: 2|plain line|another plain line|x|x|[ 6.0] reboot: Restarting system|resetting ...|Rebooting...|Resetting CPU ...|Rebooting in 5 seconds
"Synchronous Abort" handler|elr: 0|data abort|Guru Meditation Error: x|Core 0 dump|Backtrace: 0x1:0x2|ZEPHYR FATAL ERROR 1|E: ***** BUS FAULT *****|E: pc 0|*** held|=== held|--- held|Halting system
E/TC:0 0 Panic 'x' at a.c:1|E/TC:0 0  x0 1|E/TC:0 0 Call stack:|E/TC:0 0  0x1234|I/TC: fine|ASSERT [x] a.c(1)|ASSERT_EFI_ERROR (Status)|CpuDeadLoop|PANIC at PC : 0x1|x0 = 1|\x01\x02\x03\x04|\x05\x06a"""
POOL = [x for part in POOL.split("\n") for x in part.split("|")]
BAD = {"\x01\x02\x03\x04", "\x05\x06a"}


def logs(seed, sessions, most):
    rng = random.Random(seed)
    out = []
    for _ in range(sessions):
        own = rng.sample(POOL, rng.randint(3, 14)) + ["plain line"] * rng.randint(0, 12)
        weights = [rng.choice([1, 1, 1, 5]) for _ in own]
        texts = []
        while len(texts) < most:
            texts += [rng.choices(own, weights)[0]] * rng.choice([1, 1, 1, 1, 2, 3, rng.choice([1, 30, 90])])
        out.append(texts[: rng.randint(1, most)])
    return out


@pytest.mark.parametrize("segment, short, record_lines", [(1 << 16, 1 << 11, 2000), (7, 0, 2000), (50, 0, 25), (13, 5, 40), (40, 0, 130)])
def test_against_framing_by_hand_with_sessions_cut_anywhere(spark, monkeypatch, segment, short, record_lines):
    found = logs(segment + record_lines, 60, 400)
    rows = [(s, k, t) for s, texts in enumerate(found) for k, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "session_id int, line_no long, text string").repartition(6)
    monkeypatch.setattr(framing, "SHORT", short)
    monkeypatch.setattr(framing, "RECORD_LINES", record_lines)
    # Workers read these from the module, so what they do is checked here, in this process, and through Spark with the settings as they are.
    dialects = framing.Dialects.of(PROFILES)
    bits = framing.judged(lines, dialects, F.when(F.col("text").isin(list(BAD)), 1).otherwise(0)).toPandas().sort_values(["session_id", "line_no"])
    hand = ByHand(PROFILES, record_lines, BAD.__contains__)
    for session, own in bits.groupby("session_id"):
        marks = own[[f"m{k}" for k in range(len(dialects.profiles))]].to_numpy().astype("int16")
        state, boot = framing._started(dialects)
        opened, records, changes = framing.Boot(), [], []
        n = len(own)
        for lo in range(0, n, segment):
            part = own.iloc[lo : lo + segment]
            columns = [part[c].to_numpy().astype("int16") for c in ("garbage", "banner", "claim")]
            seg = framing.Segment.unpacked(dialects, framing.Segment(dialects, part["line_no"].to_numpy(), *columns, marks[lo : lo + segment].copy()).packed())
            before = framing.replace(state, held=list(state.held))
            sink = framing._folded(seg, state, boot, opened)
            # The segment's function leads to the same state.
            banners, *_ = summary = framing.pickle.loads(framing.summarised(seg))[before.entered()]
            left = framing._applied(before, summary)
            if left is None:
                assert before.size + summary[2] >= record_lines or before.mode == "held"
            else:
                after = boot
                active = before.active
                for b in banners:
                    active = dialects.banners[b - 1][0] if b else active
                    after = after.after(b, dialects, active)[0]
                assert after == sink.boot
                kept = {"open": ("owner", "preamble", "backtrace", "first", "last", "size", "severity", "crash", "taken", "interleaved"), "garbage": ("kind", "first", "last", "size"), "held": ("held",), "closed": ()}[state.mode]
                assert (left.active, left.mode) == (state.active, state.mode) and [getattr(left, f) for f in kept] == [getattr(state, f) for f in kept]
            if lo + segment >= n:
                entry = framing.pickle.dumps((before, boot, opened))
                batch = pa.RecordBatch.from_pydict({"session_id": [int(session)], "data": [seg.packed()], "entry": [entry], "last": [True]})
                ((_, sink, _),) = framing._each(dialects, [batch])
            boot, opened = sink.boot, sink.open_boot
            line, profile, turn = sink.singles()
            records += sink.rows + [(k, k, 1, "line", dialects.profiles[p].name, sink.turns[t][2].stage, sink.turns[t][2].epoch, None, "single", False, 0, False) for k, p, t in zip(line.tolist(), profile.tolist(), turn.tolist(), strict=True)]
            changes += sink.changes
        assert (sorted(records), changes) == hand.run(found[session])


def test_through_spark_with_a_session_over_several_tasks(spark):
    found = logs(5, 12, 300) + [logs(6, 1, 6000)[0]]
    rows = [(s, k, t) for s, texts in enumerate(found) for k, t in enumerate(texts)]
    lines = spark.createDataFrame([*rows, (None, 1, "x")], "session_id int, line_no long, text string").repartition(6)
    framed = framing.Framed(lines, PROFILES, segment=2500, garbage=F.when(F.col("text").isin(list(BAD)), 1).otherwise(0))
    assert framed.packed.where("summary is not null").count() >= 2
    records, stages = framed.records().collect(), framed.stages().collect()
    hand = ByHand(PROFILES, garbage=BAD.__contains__)
    for session, texts in enumerate(found):
        wanted = hand.run(texts)
        assert sorted(tuple(r)[1:] for r in records if r["session_id"] == session) == wanted[0]
        assert sorted(tuple(r)[1:] for r in stages if r["session_id"] == session) == wanted[1]
    assert framing.tiling_faults(framed.records(), lines.where("session_id is not null")).count() == 0


def test_garbage(spark):
    got = framing.garbage_runs(frame(spark, ["fine", "\x01\x02\x03", "\x04\x05a", "fine", "", "\x7f\x7f"])).collect()
    assert sorted((r["from_line"], r["to_line"]) for r in got) == [(1, 2), (5, 5)]
    assert [r[:4] for r in long_ones(framing.frame(frame(spark, ["fine", "\x01\x02\x03", "\x04\x05a", "fine"]), PROFILES))] == [(1, 2, 2, "garbage")]


def test_nothing(spark):
    assert framing.frame(frame(spark, LINUX).limit(0), PROFILES).count() == 0
    assert framing.stages(frame(spark, LINUX).limit(0), PROFILES).count() == 0


def test_texts_are_judged_once_with_the_same_result(spark, monkeypatch, tmp_path):
    lines = frame(spark, [*LINUX, None, "", "U-Boot SPL 2024.01", *LINUX, "\x01\x02\x03", "system restart", *LINUX])
    dialects, scratch = framing.Dialects.of(PROFILES), framing.Scratch(spark, "judged")
    once = framing.judged_once(lines, dialects, scratch)
    assert "rlike" not in once._jdf.queryExecution().optimizedPlan().toString().lower()
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert rows(once) == rows(framing.judged(lines, dialects))
    monkeypatch.setattr(framing, "TEXTS", 0)
    assert rows(framing.judged_once(lines, dialects, scratch)) == rows(once)


def test_patterns_without_words_are_tried_on_all_lines(spark):
    assert framing._words(r"(?iu)\bkelvin\b") == [] == framing._words(r"^\s+\S") == framing._words(r"[a-z&&[^b]]x")
    assert framing._words(r"\bOops: |Kernel panic - not") == ["oops", "kernel"] or set(framing._words(r"\bOops: |Kernel panic - not")) <= {"oops", "kernel", "panic"}
    texts = spark.createDataFrame([("Kernel PANIC",), ("  x",), ("none",)], "text string").withColumn("low", F.lower("text"))
    assert [r[0] for r in texts.select(framing._any(F.col("text"), [r"(?i)kernel panic", r"^\s+\S"], F.col("low"))).collect()] == [True, True, False]
