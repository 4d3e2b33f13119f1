"""DuckDB SQL for the query catalogue: the same rows and column names."""

from __future__ import annotations

import re

_LOG = """
log as (
    select event_id, epoch_us(ts) // 1000 as at, user_id as device, event_type as template,
        case event_type when 'error' then 3 when 'purchase' then 5 else 6 end as severity, value, props
    from events
)"""
_BOOTED = (
    _LOG
    + """, booted as (
    select *, sum(case when template = 'signup' then 1 else 0 end) over (partition by device order by at, event_id)::bigint as boot from log
)"""
)
_EPOCHS = (
    _BOOTED
    + """, epochs as (
    select device, boot as seq, min(at) as opened_at, max(at) as last_at,
        lead(min(at)) over (partition by device order by boot) as closed_at, count(*) as records,
        count(*) filter (where severity <= 3) as errors, sum(length(props))::bigint as bytes,
        substr(sha256(string_agg(template, chr(10) order by at, event_id)), 1, 32) as fingerprint
    from booted group by device, boot
)"""
)
_ROLLUP = _BOOTED + ", rollup as (select device, template, boot, count(*) as count, min(at) as first_ts, max(at) as last_ts, min(severity) as severity from booted group by all)"
_ROLLUP_EPOCHS = _EPOCHS + ", rollup as (select device, template, boot, count(*) as count, min(at) as first_ts, max(at) as last_ts, min(severity) as severity from booted group by all)"
_TOC = "select template, sum(count)::bigint as count, min(first_ts) as first_ts, max(last_ts) as last_ts, min(severity) as severity from rollup"
_VERDICTS = ", verdicts as (select * from (values ('view', 'benign'), ('click', 'benign'), ('error', 'known_bad')) v(template, verdict))"
_LINES = """
lines as (
    select device, session_id, stage, unnest(range(len(parts)))::int as line_no, unnest(parts) as text
    from (select source as device, doc_id as session_id, lang as stage, string_split(text, chr(10)) as parts from documents where text is not null)
)"""
_RECORDS = "records as (select conv_id as session_id, turn as record_no, role as kind, coalesce(text, '') as text from conversations)"
_NOW = 1_706_745_600_000
_DAY = 86_400_000

_TOKENS = r"""
tokenized as (
    select *, list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> '') as words from {0}
), tokens_of as (
    select * exclude (words), case when len(list_filter(words, lambda w: regexp_matches(w, '^[^=]+=[^=]'))) >= 3
        then flatten(list_transform(words, lambda w: case when regexp_matches(w, '^[^=]+=[^=]')
            then [split_part(w, '=', 1) || '=', regexp_replace(w, '^[^=]+=', '')] else [w] end)) else words end as tokens
    from tokenized
)"""

_NOISE = f"""
with {_LOG}, rollup as (
    select device, template, count(*) as count, min(at) as first_ts, max(at) as last_ts from log group by all having max(at) >= {_NOW - 16 * _DAY}
), rated as (
    select device, template, first_ts < {_NOW - 16 * _DAY} and last_ts > first_ts as approximate,
        case when first_ts < {_NOW - 16 * _DAY} and last_ts > first_ts
            then round(count * (last_ts - {_NOW - 16 * _DAY})::double / (last_ts - first_ts)::double)::bigint else count end as n,
        last_ts - first_ts as span
    from rollup
), rates as (
    select device, template, n, round(n::double / {16 * 1440}.0::double, 1) as per_min,
        case when n >= 5 and span >= 1 then round(n::double / (span::double / 60000.0::double), 1) end as burst_per_min,
        least(100.0::double, round(n * 100.0::double / greatest(sum(n) over (partition by device), 1)::double, 1)) as share, approximate
    from rated
)
select * from rates"""

_CONSOLE = (
    _LOG
    + """, console as (
    select device as session_id, event_id as line_no, case template when 'signup' then 'Linux version 6.' || event_id % 5 || '.0' when 'error' then 'Kernel panic - not syncing: fatal'
        when 'click' then 'Call trace: f+0x1' when 'purchase' then '---[ end trace 0 ]---'
        else 'U-Boot ' || case when event_id % 3 = 0 then 'SPL ' else '' end || '202' || event_id % 6 || '.01' end as text
    from log
)"""
)

#: Banners in order, with what each makes of stage, least rank, banners seen and epoch.
_BOOTS = (
    _CONSOLE
    + """, banners as (
    select session_id, line_no, row_number() over (partition by session_id order by line_no) as k,
        case when text like 'Linux%' then 'linux' when text like 'U-Boot SPL%' then 'spl' else 'uboot' end as banner,
        case when text like 'Linux%' then 'kernel' else 'uboot' end as stage, case when text like 'Linux%' then 30 else 20 end::int as rank
    from console where text like 'Linux%' or text like 'U-Boot%'
), boots as (
    select session_id, line_no, k, stage, rank, rank as least, [banner] as seen, 0::bigint as epoch, true as changes, false as resets from banners where k = 1
    union all
    select session_id, line_no, k, stage, rank, case when resets then rank else least(least, rank) end, case when resets then [banner] else list_append(seen, banner) end,
        epoch + resets::int, stage <> last_stage, resets
    from (
        select n.*, b.least, b.seen, b.epoch, b.stage as last_stage, n.rank < b.rank or (n.rank <= b.least and list_contains(b.seen, n.banner)) as resets
        from boots b join banners n on n.session_id = b.session_id and n.k = b.k + 1
    )
)"""
)

_RETENTION = (
    _LOG
    + """, summed as (
    select *, length(props) as bytes, sum(length(props)) over (partition by device order by at, event_id) as upto,
        sum(length(props)) over (partition by device) as total
    from log
), judged as (select *, upto - bytes >= total - 300 as kept from summed)"""
)

_DURATIONS = (
    _EPOCHS
    + """, first_in as (
    select device, boot as seq, template as stage, min(at) as entered_at from booted group by all
), nexts as (
    select *, lead(entered_at) over (partition by device, seq order by entered_at, stage) as next_at from first_in
), durations as (
    select device, seq, stage, entered_at,
        case when coalesce(next_at, closed_at) is not null then greatest(coalesce(next_at, closed_at) - entered_at, 0) end as duration_ms
    from nexts join epochs using (device, seq)
)"""
)

_EXPECTED = (
    _ROLLUP_EPOCHS
    + """, reference as (
    select device, seq as boot, opened_at from epochs where closed_at is not null
), total as (
    select device, count(*) as "of" from reference group by 1 having count(*) >= 3
), learned as (
    select device, template, count(*) as seen_in, list_sort(list(greatest(first_ts - opened_at, 0))) as o
    from rollup join reference using (device, boot) group by all
), expected as (
    select device, template, seen_in, "of", o[len(o) // 2 + 1] as median_ms from learned join total using (device)
)"""
)

_RUNS = (
    _EPOCHS
    + """, changed as (
    select *, case when lag(fingerprint) over w = fingerprint then 0 else 1 end as changed from epochs window w as (partition by device order by seq)
), islands as (
    select *, sum(changed) over (partition by device order by seq) as island from changed
), runs as (
    select device, min(seq) as first_seq, max(seq) as last_seq, count(*) as run, any_value(fingerprint) as fingerprint from islands group by device, island
)"""
)

_GARBAGE = """garbage as (
    select device, boot as seq, count(*) filter (where event_id % 13 = 0) as spans,
        coalesce(max((at, event_id)) filter (where template in ('signup', 'purchase')) > max((at, event_id)) filter (where event_id % 13 = 0), false) as resolved
    from booted group by all having count(*) filter (where event_id % 13 = 0) > 0
)"""

_OPENED = _BOOTED + ", opened as (select device, boot as seq, min(event_id) as opened_offset, sum(length(props)) as bytes from booted group by all)"

_SAMPLES = _BOOTED + ", samples as (select device, boot, template, 'k' as slot, at, event_id as id, json_extract_string(props, '$.k') as value from booted)"


def _diff(a: str, b: str, keys: str) -> str:
    return f"""
select {keys}, coalesce(a.count, 0)::bigint as count_a, coalesce(b.count, 0)::bigint as count_b,
    case when a.count is null then 'new' when b.count is null then 'gone' when a.count <> b.count then 'shifted' else 'same' end as change
from ({a}) a full join ({b}) b using ({keys})"""


_SELECTORS = " union all ".join(
    f"select '{s}' as selector, device, rule::int as rule from (select *, min(rule) over () as best from (select device, {rule} as rule from devices) where rule is not null) where rule = best"
    for s, rule in (
        (
            s,
            f"case when lower(nickname) = '{s.lower()}' then 1 when lower(device) = '{s.lower()}' then 2 "
            + (f"when lower(segment) = '{s.lower().split('=')[1]}' then 3 " if s.startswith("tag:") else "")
            + f"when contains(lower(device), '{s.lower()}') then 4 when contains(regexp_replace(lower(device), '[^a-z0-9]', '', 'g'), '{''.join(c for c in s.lower() if c.isalnum())}') then 5 end",
        )
        for s in ("NICK7", "customer#000000012", "tag:segment=building", "00000001", "customer00000002", "nothing")
    )
)

_DECODE_ERRNO = {
    1: "EPERM", 2: "ENOENT", 3: "ESRCH", 4: "EINTR", 5: "EIO", 6: "ENXIO", 9: "EBADF", 11: "EAGAIN", 12: "ENOMEM", 13: "EACCES", 14: "EFAULT", 16: "EBUSY",
    17: "EEXIST", 19: "ENODEV", 20: "ENOTDIR", 22: "EINVAL", 28: "ENOSPC", 32: "EPIPE", 34: "ERANGE", 38: "ENOSYS",
}


def _case(expression: str, names: dict[int, str]) -> str:
    return f"case {expression} " + " ".join(f"when {k} then '{v}'" for k, v in names.items()) + " end"


def _decode() -> str:
    from emberline.functions.decode import EXCEPTION_CLASS, FAULT, PSCI

    return f"""
with rows as (select l_orderkey, l_linenumber, l_quantity::bigint as v from lineitem)
select l_orderkey, l_linenumber, {_case("v", _DECODE_ERRNO)} as errno, {_case("-(v % 12)", PSCI)} as psci,
    case when v * 21 >= 1020 then null when v * 21 < 16 then 'SGI ' || (v * 21) when v * 21 < 32 then 'PPI ' || (v * 21 - 16) else 'SPI ' || (v * 21 - 32) end as interrupt,
    {_case("v", EXCEPTION_CLASS)} as exception,
    case when v + 4 in (32, 33, 36, 37) then {_case("v", FAULT)} end as fault
from rows"""


ORACLE_SQL = {
    "toc_by_count": f"with {_ROLLUP} {_TOC} group by 1 order by count desc, template limit 4",
    "toc_by_severity": f"with {_ROLLUP} {_TOC} group by 1 having min(severity) <= 5 order by severity, template limit 10",
    "toc_first_seen": f"with {_ROLLUP} {_TOC} group by 1 order by first_ts, template limit 3",
    "toc_last_seen": f"with {_ROLLUP} {_TOC} group by 1 order by last_ts desc, template limit 2 offset 1",
    "toc_scoped_boot": f"with {_ROLLUP} {_TOC} where boot = 3 group by 1 having sum(count) >= 2",
    "toc_new_only": f"with {_ROLLUP} {_TOC} where boot = 1 and (device, template) in (select (device, template) from rollup group by device, template having min(boot) = 1) group by 1",
    "toc_new_only_without_session": f"with {_ROLLUP} {_TOC} where false group by 1",
    "toc_vs_baseline": f"with {_ROLLUP} {_TOC} where device = 7 and template not in (select template from rollup where device = 7 and boot = 0) group by 1",
    "toc_hide_benign": f"with {_ROLLUP}{_VERDICTS}, toc as ({_TOC} group by 1) select toc.*, verdict from toc left join verdicts using (template) where verdict is null or verdict <> 'benign'",
    "toc_only_verdict": f"with {_ROLLUP}{_VERDICTS}, toc as ({_TOC} group by 1) select toc.*, verdict from toc left join verdicts using (template) where verdict = 'known_bad'",
    "occurrence_rollup": f"with {_ROLLUP} select * from rollup",
    "count_templates": f"with {_ROLLUP} select count(distinct template) as n from rollup",
    "template_detail_timeline": f"""with {_LOG}, own as (select at from log where template = 'error'), span as (select min(at) as lo, max(at) as hi from own),
        counted as (select least((at - lo) * 24 // greatest(hi - lo, 1), 23) as bucket, count(*) as n from own, span group by 1)
        select b.bucket, lo + (hi - lo) * b.bucket // 24 as label, coalesce(n, 0)::bigint as n from span, range(24) b(bucket) left join counted using (bucket)""",
    "distinct_templates_per_boot": f"with {_BOOTED} select distinct device, boot, template from booted",
    "noise_window": _NOISE,
    "noisiest_templates": _NOISE + " order by n desc, device, template limit 20",
    "session_stats": f"""with {_LINES}, {_TOKENS.format("lines")}
        select device, count(*) as lines, sum(strlen(text))::bigint as bytes, count(distinct case when len(tokens) > 0 then array_to_string(tokens, ' ') end) as templates,
            count(distinct session_id) as sessions, count(distinct case when len(tokens) > 0 then array_to_string(tokens[1:3], chr(1)) end) as families,
            round(count(*)::double / greatest(count(distinct case when len(tokens) > 0 then array_to_string(tokens, ' ') end), 1), 2) as compression,
            round(count(distinct case when len(tokens) > 0 then array_to_string(tokens, ' ') end)::double / greatest(count(distinct case when len(tokens) > 0 then array_to_string(tokens[1:3], chr(1)) end), 1), 2) as fragmentation
        from tokens_of group by 1""",
    "merge_suggestions": f"""with {_LINES}, {_TOKENS.format("lines")},
        own as (select distinct array_to_string(tokens, ' ') as id, tokens, len(tokens) as n, array_to_string(tokens[1:3], chr(1)) as family from tokens_of where len(tokens) > 0),
        pairs as (select least(a.id, b.id) as template_a, greatest(a.id, b.id) as template_b, a.n as short_n, b.n as long_n, a.tokens = b.tokens[1:a.n] as starts,
            case when a.n = b.n then len(list_filter(list_zip(a.tokens, b.tokens), lambda z: z[1] = z[2]))::double / a.n end as sim from own a join own b on a.family = b.family and (a.n < b.n or (a.n = b.n and a.id < b.id)))
        select template_a, template_b, case when short_n < long_n then 'prefix_extension' else 'near_threshold' end as reason, round(coalesce(sim, short_n::double / long_n), 4) as confidence
        from pairs where (short_n < long_n and starts) or (short_n = long_n and sim >= 0.24 and sim < 0.4)""",
    "key_value_tokenize": f"with {_LOG} select event_id, 'user=|' || device || '|kind=|' || template || '|sev=|' || severity || '|done' as tokens from log",
    "line_split": f"with {_LINES} select session_id, line_no, length(text)::int as n_chars, md5(text) as digest from lines",
    "severity_classify": f"""with {_LOG}, made as (select event_id, template, (case when event_id % 5 = 0 then '<2>' else '' end) || template || (case when event_id % 7 = 0 then ' warning: slow' else '' end) || (case when event_id % 11 = 0 then ' Debug' else '' end) as line from log),
        found as (select event_id, (case when line like '<2>%' then 2 when line like '%error%' then 3 when line like '%warning%' then 4 when line like '%Debug%' then 7 else 8 end)::int as severity from made)
        select *, case severity when 2 then 'crit' when 3 then 'err' when 4 then 'warn' when 7 then 'debug' else 'unknown' end as name from found""",
    "mine_key": f"with {_LOG} select event_id, template || ' ready' as key from log",
    "version_extract": """select event_id, case when event_id % 3 = 0 then 'Linux version' else 'U-Boot SPL' end as component,
        case when event_id % 3 = 0 then '6.' || (event_id % 9) || '.1-rc2' else '2024.01' end as version, case when event_id % 3 = 1 then 'Jan 08 2024' end as build_date
        from events where event_id % 3 < 2""",
    "build_tokens": """select event_id, array_to_string(list_sort([md5(user_id::varchar), 'abc' || (event_id % 4), sha1(event_type)]), ',') as ids from events""",
    "json_fields": "select event_id, json_extract(props, '$.k')::bigint as k from events",
    "line_context": f"""with {_LINES}, anchors as (select session_id, line_no as anchor_line from lines where contains(lower(text), 'license'))
        select session_id, anchor_line, line_no, line_no - anchor_line as distance, text from anchors join lines using (session_id) where line_no between anchor_line - 2 and anchor_line + 2""",
    "recent_lines": f"""with {_LINES} select device, session_id, line_no, text from (select *, row_number() over (partition by device order by session_id desc, line_no desc) as r from lines where trim(text) <> '') where r <= 5""",
    "recent_suppress_noise": f"""with {_LINES} select device, session_id, line_no, text from (select *, row_number() over (partition by device order by session_id desc, line_no desc) as r from lines where trim(text) <> '' and stage <> 'en') where r <= 5""",
    "records_for_template": f"with {_RECORDS} select session_id, record_no, len(string_split(text, chr(10)))::bigint as n_lines from records where kind = 'user'",
    "record_text": f"with {_LINES} select session_id || '-' || (line_no // 4) as record_id, count(*) as n_lines, string_agg(text, chr(10) order by line_no) as text from lines group by session_id, line_no // 4",
    "template_of_line_interval": f"""with {_LINES}, spans as (select session_id, line_no // 3 as part, min(line_no) as a, max(line_no) as b from lines group by all)
        select session_id, line_no, part from lines join spans using (session_id) where line_no between a and b""",
    "search_terms": f"with {_LINES} select device, session_id, line_no from lines where contains(lower(text), 'the') and contains(lower(text), 'and')",
    "search_tokens": f"with {_LINES} select device, session_id, line_no from lines where list_has_all(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), ['license', 'the'])",
    "search_index": f"with {_LINES} select device, session_id, line_no from lines where list_has_all(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), ['license', 'the'])",
    "search_phrase": f"with {_LINES} select device, session_id, line_no from lines where contains(lower(text), 'of the')",
    "search_regex": f"with {_LINES} select device, session_id, line_no from lines where regexp_matches(text, '\\b[A-Z][a-z]+ing\\b')",
    "search_resume": f"with {_LINES} select device, session_id, line_no from lines where contains(lower(text), 'the') and (session_id > 20 or (session_id = 20 and line_no > 3)) order by session_id, line_no limit 50",
    "search_record": f"with {_RECORDS} select session_id, record_no, kind from records where contains(lower(text), 'der')",
    "search_window": f"""with {_LINES}, w as (select device, session_id, line_no, lower(string_agg(text, chr(10)) over (partition by session_id order by line_no rows between current row and 4 following)) as text from lines),
        hits as (select *, (contains(text, 'license') and contains(text, 'idiot')) or (contains(text, 'stupid') and contains(text, 'the')) as hit from w),
        lagged as (select *, lag(hit) over (partition by session_id order by line_no) as last from hits)
        select device, session_id, line_no from lagged where hit and not coalesce(last, false)""",
    "search_cross_device": f"""with {_LINES} select turn::int as turn, device, session_id, line_no from (select device, session_id, line_no, row_number() over (partition by device order by session_id, line_no) as turn from lines where contains(lower(text), 'and')) order by turn, device limit 40""",
    "search_highlights": f"""with {_LINES}, parts as (select session_id, line_no, string_split(text, 'the') as p from lines), spans as (select session_id, line_no, p, unnest(range(len(p) - 1)) as k from parts)
        select session_id, line_no, k::int as k, (list_sum(list_transform(p[1:k + 1], lambda x: strlen(x))) + 3 * k)::int as start, (list_sum(list_transform(p[1:k + 1], lambda x: strlen(x))) + 3 * k + 3)::int as "end" from spans""",
    "boots_sessionized": f"with {_EPOCHS} select * exclude (fingerprint) from epochs",
    "boot_bytes": f"with {_EPOCHS} select device, sum(bytes)::bigint as bytes, count(*) as epochs from epochs group by 1",
    "boot_fingerprint": f"with {_EPOCHS} select device, seq, fingerprint from epochs",
    "fingerprint_runs": f"with {_RUNS} select * from runs",
    "fingerprint_histogram": f"with {_EPOCHS} select device, fingerprint, count(*) as n from (select *, row_number() over (partition by device order by seq desc) as r from epochs) where r <= 12 group by all",
    "loop_class": f"""with {_EPOCHS}, recent as (select *, row_number() over w as r, first_value(fingerprint) over w as newest from epochs window w as (partition by device order by seq desc)),
        cut as (select *, max(case when fingerprint <> newest then 1 else 0 end) over (partition by device order by seq desc) as broken from recent where r <= 12),
        g as (select device, count(*) filter (where broken = 0) as run, count(distinct fingerprint) as "distinct", count(*) filter (where broken = 0 and errors > 0) as crashed, count(*) as seen from cut group by 1)
        select device, run, "distinct", crashed, case when seen < 3 then 'none' when run < 3 then case when "distinct" > 2 then 'unstable' else 'none' end
            when crashed * 2 >= run then 'crash' when "distinct" > 2 then 'flapping' else 'stable' end as kind from g""",
    "boot_outcome": f"""with {_RUNS}, marks as (select device, boot as seq, max((severity <= 3)::int) as crash, max((template = 'purchase')::int) as reached from booted group by all)
        select device, seq, case when bytes = 0 then 'no_output' when crash = 1 then 'crashed' when reached = 1 then 'booted'
            when closed_at is null and {_NOW} - last_at < 15000 then 'booting'
            when exists (select 1 from runs where runs.device = epochs.device and run >= 3 and seq between first_seq and last_seq) then 'looping'
            when closed_at is null and {_NOW} - last_at >= 30000 then 'hung' when closed_at is not null then 'ended' else 'in_progress' end as outcome
        from epochs left join marks using (device, seq)""",
    "previous_boot": f"with {_EPOCHS} select device, seq, lag(seq) over w as previous_seq, lag(fingerprint) over w as previous_fingerprint from epochs window w as (partition by device order by seq)",
    "boot_at_asof": f"""with {_EPOCHS}, points as (select event_id as point_id, device, at + 1000 as at from log where template = 'error'),
        met as (select point_id, points.device, points.at, max(seq) as seq from points left join epochs on epochs.device = points.device and opened_at <= points.at group by all)
        select met.* from met""",
    "stage_reach": f"with {_EPOCHS} select device, boot as seq, template as stage, greatest(min(at) - any_value(opened_at), 0) as after_ms from booted join epochs on epochs.device = booted.device and epochs.seq = booted.boot group by all".replace("select device,", "select booted.device,"),
    "stage_durations": f"with {_DURATIONS} select * from durations",
    "stage_timings": f"""with {_DURATIONS} select device, stage, count(*) as samples, min(duration_ms) as min_ms, max(duration_ms) as max_ms, round(avg(duration_ms::double))::bigint as mean_ms,
        case when count(*) >= 3 and min(seq) <> max(seq) then round(regr_slope(duration_ms::double, seq::double), 2) end as trend from durations where duration_ms is not null group by all""",
    "diff_boots": f"with {_ROLLUP}, have as (select device from rollup where boot in (1, 2) group by 1 having count(distinct boot) = 2)"
    + _diff("select device, template, count from rollup where boot = 1 and device in (from have)", "select device, template, count from rollup where boot = 2 and device in (from have)", "device, template"),
    "diff_sessions": f"with {_LOG}" + _diff("select template, count(*) as count from log where device = 3 group by 1", "select template, count(*) as count from log where device = 5 group by 1", "template"),
    "diff_builds": f"with {_ROLLUP}" + _diff("select template, sum(count) as count from rollup where boot % 3 = 0 group by 1", "select template, sum(count) as count from rollup where boot % 3 = 1 group by 1", "template"),
    "diff_common_stages": """with docs as (select doc_id as id, case when doc_id % 9 <> 0 then lang end as stage from documents), a as (select * from docs where id % 2 = 0),
        b as (select * from docs where id % 2 = 1 and stage in ('de', 'en')), common as (select distinct stage from a where stage in (select stage from b))
        select * from a where (select count(*) from common) = 0 or stage is null or stage in (from common)""",
    "learn_expectations": f"with {_EXPECTED} select * from expected",
    "missing_in_boot": f"""with {_EXPECTED}, newest as (select device, max(seq) as boot, max_by(opened_at, seq) as opened_at from epochs group by 1),
        seen as (select device, template, first_ts - opened_at as actual_ms from rollup join newest using (device, boot)),
        states as (select device, template, case when actual_ms is null then case when seen_in::double / "of" >= 0.6 then 'missing' else 'flaky' end
            when median_ms > 0 and actual_ms > median_ms * 3.0 then 'late' end as state, round(seen_in::double / "of", 4) as reliability from expected left join seen using (device, template))
        select device, template, state, reliability from states where state is not null""",
    "template_values": f"""with {_SAMPLES}, counted as (select template, slot, value, count(*) as n from samples group by all), ranked as (select *, row_number() over (partition by template, slot order by n desc, value) as r from counted)
        select s.template, s.slot, count(*) as n, count(distinct value) as "distinct", min(value::double) as min, max(value::double) as max, round(avg(value::double), 2) as mean,
            min_by(value::double, (at, id)) as first, max_by(value::double, (at, id)) as last,
            (select string_agg(value || '=' || n, ',' order by r) from ranked where r <= 10 and ranked.template = s.template) as top from samples s group by all""",
    "number_parse": """select event_id, case event_id % 6 when 0 then event_id::double when 1 then event_id::double when 2 then -(event_id::double + 0.5) when 5 then event_id::double end as number from events""",
    "metric_series": f"with {_SAMPLES} select device, boot, max_by(value::double, (at, id)) as value from samples group by all",
    "metric_series_stats": f"with {_SAMPLES}, series as (select device, boot, max(value::double) as value from samples group by all) select device, count(*) as n, min(value) as min, max(value) as max, round(avg(value), 2) as mean, max_by(value, boot) as last from series group by 1",
    "evaluate_policy": f"with {_ROLLUP}, toc as ({_TOC} group by 1) select template, count, severity, case when template = 'purchase' then 'allowed' when template in ('view', 'click') then 'benign' end as waived from toc where severity <= 6",
    "timeline": f"""with {_EPOCHS} select device, at, 'crash' as kind, template as detail from log where severity <= 3
        union all select device, opened_at, 'epoch_open', seq::varchar from epochs
        union all select o_custkey, epoch_us(o_orderdate) // 1000, 'evidence', o_orderkey::varchar from orders where o_orderpriority = '1-URGENT'""",
    "target_interleave": f"""with {_LOG}, near as (select c_nationkey as target, device, at, event_id, template, row_number() over (partition by c_nationkey, device order by abs(at - {_NOW - 15 * _DAY}), event_id) as r
        from log join customer on c_custkey = device where at between {_NOW - 15 * _DAY - 21_600_000} and {_NOW - 15 * _DAY + 21_600_000}) select target, device, at, event_id, template from near where r <= 5""",
    "provenance": f"""with {_EPOCHS}, printed as (select device, boot, max_by('6.1-g' || substr(md5((event_id % 3)::varchar), 1, 12), (at, '6.1-g' || substr(md5((event_id % 3)::varchar), 1, 12))) as version from booted where template = 'view' and event_id % 4 = 0 group by all),
        running as (select device, epochs.seq as boot, max_by(version, p.boot) as version from epochs join printed p using (device) where p.boot between epochs.seq - 6 and epochs.seq group by all),
        intended as (select device, seq as boot, case when seq % 4 <> 0 then substr(md5('1'), 1, 10) end as build from epochs)
        select device, boot, case when build is null or version is null then 'unknown' when contains(version, build) then 'match' else 'mismatch' end as verdict from intended left join running using (device, boot)""",
    "latest_versions": f"with {_BOOTED} select device, boot, template as component, max_by(props, (at, props)) as version from booted group by all",
    "report_dedupe": f"""with {_RECORDS}, words as (select session_id || '/' || record_no as id, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-zà-ÿ]+', ' ', 'g'), ' '), lambda w: length(w) >= 4))) as words from records),
        filled as (select * from words where len(words) > 0),
        met as (select a.id as a, b.id as b, len(list_intersect(a.words, b.words)) as shared, len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)) as total from filled a, filled b where a.id < b.id and list_has_any(a.words, b.words))
        select a as report_a, b as report_b, shared::bigint as shared, round(shared::double / total, 4) as jaccard from met where shared >= 2 and shared::double / total >= 0.45""",
    "distinct_reporters": "select event_type as template, count(distinct user_id) as reporters from events group by 1",
    "bisect_next_step": f"""with {_LOG}, judged as (select device as case_id, (event_id % 10)::int as i, case template when 'error' then 'bad' when 'purchase' then 'skip' else 'good' end as v from log where event_id % 4 = 0),
        known as (select d.case_id, coalesce(max(i) filter (where v = 'good'), -1) as good, coalesce(min(i) filter (where v = 'bad'), 10) as bad, coalesce(bool_or(i = 0), false) as low, coalesce(bool_or(i = 9), false) as high
            from (select distinct device as case_id from log) d left join judged using (case_id) group by 1),
        open as (select case_id, min_by(k, (abs(k - trunc((good + bad) / 2.0)), k)) as k from known, range(0, 10) r(k) where k > good and k < bad and not exists (select 1 from judged t where t.case_id = known.case_id and i = k) group by 1)
        select known.case_id, case when not low or not high then 'test' when bad = 10 then 'inconclusive' when good >= bad then 'found' when k is not null then 'test' when bad - good > 1 then 'inconclusive' else 'found' end as step,
            (case when not low then 0 when not high then 9 when bad = 10 then null when good >= bad then bad when k is not null then k when bad - good > 1 then null else bad end)::int as candidate from known left join open using (case_id)""",
    "bisect_orders": """with tested as (select distinct o_custkey as case_id, (o_orderkey % 12)::int as i from orders),
        judged as (select *, case when (case_id + i) % 5 = 0 then 'skip' when i < case_id % 14 then 'good' else 'bad' end as v from tested),
        known as (select c_custkey as case_id, coalesce(max(i) filter (where v = 'good'), -1) as good, coalesce(min(i) filter (where v = 'bad'), 12) as bad, coalesce(bool_or(i = 0), false) as low, coalesce(bool_or(i = 11), false) as high
            from customer left join judged on case_id = c_custkey group by 1),
        open as (select case_id, min_by(k, (abs(k - trunc((good + bad) / 2.0)), k)) as k from known, range(0, 12) r(k) where k > good and k < bad and not exists (select 1 from tested t where t.case_id = known.case_id and i = k) group by 1)
        select known.case_id, case when not low or not high then 'test' when bad = 12 then 'inconclusive' when good >= bad then 'found' when k is not null then 'test' when bad - good > 1 then 'inconclusive' else 'found' end as step,
            (case when not low then 0 when not high then 11 when bad = 12 then null when good >= bad then bad when k is not null then k when bad - good > 1 then null else bad end)::int as candidate from known left join open using (case_id)""",
    "report_copies": f"""with {_RECORDS}, plain as (select session_id || '/' || record_no as id, trim(regexp_replace(lower(replace(text, chr(10), ' ')), '[^a-zà-ÿ]+', ' ', 'g')) as t from records),
        keyed as (select id, case when t = '' then '#' || id else t end as k from plain)
        select id, min(id) over (partition by k) as first_id, count(*) over (partition by k) as copies from keyed""",
    "boot_attempts": f"with {_EPOCHS} select device, seq, case seq % 4 when 1 then 'power' else 'reset' end as opened_by, bytes from epochs where seq % 2 = 1 and bytes > 0",
    "loop_kinds": f"""with {_EPOCHS}, marks as (select device, boot as seq, bool_or(event_id % 3 = 0) as watchdog, bool_or(template = 'purchase') as userspace from booted group by all),
        shaped as (select epochs.* replace (least(records, 3) || '/' || (device % 2 * (seq % 3)) as fingerprint), watchdog, userspace from epochs join marks using (device, seq)),
        recent as (select *, row_number() over w as r, first_value(fingerprint) over w as newest from shaped window w as (partition by device order by seq desc)),
        cut as (select *, max(case when fingerprint <> newest then 1 else 0 end) over (partition by device order by seq desc) as broken from recent where r <= 12),
        g as (select device, count(*) filter (where broken = 0) as run, count(distinct fingerprint) as "distinct", count(*) filter (where broken = 0 and errors > 0) as crashed,
            count(*) filter (where broken = 0 and watchdog) as barked, count(*) filter (where broken = 0 and userspace) as finished, count(*) as seen from cut group by 1)
        select device, run, "distinct", crashed, case when seen < 3 then 'none' when run < 3 then case when "distinct" > 2 then 'unstable' else 'none' end when barked * 2 >= run then 'watchdog'
            when crashed * 2 >= run then 'crash' when "distinct" > 2 then 'flapping' when finished = 0 then 'stage_capped' else 'stable' end as kind from g""",
    "garbage_resolved": f"with {_BOOTED}, {_GARBAGE} select * from garbage",
    "boot_outcome_ladder": f"""with {_RUNS}, {_GARBAGE}, marks as (select device, boot as seq, bool_or(severity <= 3) as crash, bool_or(template = 'purchase') as reached from booted group by all),
        newest as (select device, max_by(template, (at, event_id)) as last from log group by 1)
        select device, seq, case when seq % 7 = 3 or bytes = 0 then case when seq % 2 = 0 then 'no_output' else 'unknown_capture' end when not resolved then 'garbage' when crash then 'crashed' when reached then 'booted'
            when closed_at is null and {_NOW} - last_at < 15000 then 'booting'
            when exists (select 1 from runs where runs.device = epochs.device and run >= 3 and seq between first_seq and last_seq) then 'looping'
            when closed_at is null and last in ('view', 'click') then case last when 'view' then 'login_wait' else 'at_prompt' end
            when closed_at is null and {_NOW} - last_at >= 30000 then 'hung' when closed_at is not null then 'ended' else 'in_progress' end as outcome
        from epochs left join marks using (device, seq) left join garbage using (device, seq) left join newest using (device)""",
    "diff_stage_times": f"""with {_EPOCHS}, reach as (select device, boot, template as stage, greatest(min(b.at) - any_value(opened_at), 0) as ms from booted b join epochs using (device) where seq = boot and boot in (1, 2) group by all),
        have as (select device from reach group by 1 having count(distinct boot) = 2)
        select device, stage, max(ms) filter (where boot = 1) as reached_a, max(ms) filter (where boot = 2) as reached_b, max(ms) filter (where boot = 2) - max(ms) filter (where boot = 1) as delta_ms,
            case when count(*) = 1 then case min(boot) when 1 then 'a' else 'b' end end as only_in from reach where device in (from have) group by all""",
    "boot_covering_offset": f"""with {_OPENED}, points as (select o_orderkey as point_id, o_custkey as device, o_orderkey % 1000 as position from orders)
        select point_id, points.device, position, max_by(seq, (opened_offset, seq)) as seq from points left join opened on opened.device = points.device and opened_offset <= position and bytes > 0 group by all""",
    "sibling_boots": f"""with {_EPOCHS}, groups as (select device, seq, case when seq % 3 <> 0 then (device % 20) || '-' || seq end as group_id from epochs), newest as (select device, max(seq) as seq from epochs group by 1)
        select n.device, n.seq, o.device as sibling_device, o.seq as sibling_seq from newest n join groups g using (device, seq) join groups o on o.group_id = g.group_id and (o.device <> n.device or o.seq <> n.seq)""",
    "baseline_protection": f"with {_OPENED} select device, min(opened_offset) as protected from opened where device % 3 = 0 and seq in (1, 2) group by 1",
    "retention_with_baselines": f"""with {_EPOCHS}, protected as (select device, min(opened_at) as from_at from epochs where device % 3 = 0 and seq in (1, 2) group by 1),
        summed as (select *, length(props) as size, sum(length(props)) over (partition by device order by at, event_id) as upto, sum(length(props)) over (partition by device) as total from log),
        judged as (select summed.*, upto - size >= total - 100 or coalesce(at >= from_at, false) as kept from summed left join protected using (device))
        select device, min_by(event_id, (at, event_id)) filter (where kept) as cut_event, coalesce(sum(size) filter (where not kept), 0)::bigint as dropped_bytes, coalesce(sum(size) filter (where kept), 0)::bigint as kept_bytes from judged group by 1""",
    "follow_default_start": f"""with {_OPENED}, head as (select device, max(event_id) + 1 as head from log group by 1), newest as (select device, greatest(max_by(opened_offset, seq) - 10, 0) as wanted from opened where device % 4 <> 0 group by 1)
        select device, case when wanted is null then head else greatest(wanted, head - 300, 0) end as start, case when wanted is null then 'head' when wanted >= greatest(head - 300, 0) then 'epoch' else 'tail' end as why from head left join newest using (device)""",
    "boots_for_image": f"""with {_EPOCHS} select device, seq, device + seq as image_id from epochs where device + seq in (select p_partkey from part where sha1(p_partkey::varchar) like 'b%')""",
    "timeline_of_kind": f"with {_EPOCHS} select device, opened_at as at, 'epoch_open' as kind, seq::varchar as detail from epochs",
    "undelivered_hits": f"""with {_LOG} select case template when 'error' then 'errors' else 'buys' end as watch, event_id, at, template from log where (template = 'error' and event_id > 500) or template = 'purchase'""",
    "toc_compact_page": f"""with {_ROLLUP}, toc as ({_TOC} group by 1) select template, count, severity, last_ts, (select count(*) from toc) > 3 as capped, case when (select count(*) from toc) > 3 then 3 end::int as next_offset
        from toc order by count desc, template limit 2 offset 1""",
    "templates_omitted": f"""with {_LOG}, own as (select device, template, row_number() over (partition by device order by template) as place from (select distinct device, template from log))
        select device, string_agg(template, ',' order by place) filter (where place <= 2) as shown, count(*) filter (where place > 2) as omitted from own group by 1""",
    "decode_ints": _decode(),
    "cursors": """with c as (select event_id, substr(sha256(user_id::varchar), 1, 12) || ':' || lpad(lower(to_hex(event_id)), 16, '0') as cursor_text from events)
        select event_id, cursor_text, case when event_id % 5 = 0 then 'invalid' when event_id < 500 then 'expired' else 'ok' end as state, case when event_id % 5 <> 0 then event_id end as "offset" from c""",
    "selector_cascade": f"with devices as (select c_name as device, 'nick' || c_custkey as nickname, c_mktsegment as segment from customer) {_SELECTORS}",
    "symbolize_asof": """with addresses as (select event_id as id, event_id * 1237 + 17 as address from events)
        select id, address, case when p_partkey is not null and address - p_partkey * 5000 <= 65536 then 'fn_' || p_partkey end as symbol, case when address - p_partkey * 5000 <= 65536 then address - p_partkey * 5000 end as "offset"
        from addresses asof left join (select p_partkey, p_partkey * 5000 as base from part) p on address >= base""",
    "watch_pattern": f"with {_LOG} select 'errors' as watch, event_id, at, template from log where event_id > 1000 and template = 'error'",
    "watch_any": f"""with {_LOG}, hits as (select device, event_id, at, case when template = 'error' then 'error' when value > 90 then 'large' end as rule from log)
        select device, event_id, at, rule from (select *, row_number() over (partition by device order by at, event_id) as r from hits where rule is not null) where r = 1""",
    "quiet_spells": f"with {_LOG}, gaps as (select device, at as from_at, coalesce(lead(at) over (partition by device order by at, event_id), {_NOW}) - at as quiet_ms from log) select * from gaps where quiet_ms >= {_DAY}",
    "follow_increment": f"with {_LOG} select device, template, count(*) filter (where event_id > 9000) as delta, min(event_id) > 9000 as novel, max(at) as last_at from log group by all having count(*) filter (where event_id > 9000) > 0",
    "retention_cut": f"with {_RETENTION} select device, min_by(event_id, (at, event_id)) filter (where kept) as cut_event, coalesce(sum(bytes) filter (where not kept), 0)::bigint as dropped_bytes, coalesce(sum(bytes) filter (where kept), 0)::bigint as kept_bytes from judged group by 1",
    "retention_kept": f"with {_RETENTION} select device, count(*) as kept from judged where kept group by 1",
    "drain_counts_conserve": f"with {_LINES}, {_TOKENS.format('lines')} select device, count(*) as lines from tokens_of where len(tokens) > 0 group by 1",
    "mined_batches": f"with {_LINES}, {_TOKENS.format('lines')} select device, count(*) as lines from tokens_of where len(tokens) > 0 group by 1",
    "frame_tiles": f"with {_CONSOLE} select session_id, count(*) as in_records from console group by 1",
    "stage_machine": f"with recursive {_BOOTS} select session_id, line_no, stage, rank, epoch, resets from boots where changes or resets",
    "frame_records": f"""with recursive {_BOOTS}, told as (
            select c.session_id, c.line_no, c.text, coalesce(b.stage, 'unknown') as stage, coalesce(b.epoch, 0) as epoch, row_number() over (partition by c.session_id order by c.line_no) as k,
                case b.stage when 'kernel' then 'linux' when 'uboot' then 'uboot' else 'raw' end as profile
            from console c asof left join boots b on b.session_id = c.session_id and b.line_no <= c.line_no
        ), stops as (select session_id, k, line_no, text from told where text not like 'Call trace%'),
        opened as (
            select t.*, s.k as stop, s.text as stop_text, (select max(k) from told l where l.session_id = t.session_id) as n
            from told t asof left join stops s on s.session_id = t.session_id and s.k > t.k where t.profile = 'linux' and t.text like 'Kernel panic%'
        ), crashes as (
            select session_id, k as first_k, case when stop is null then n when stop_text like '---[%' then stop else stop - 1 end as last_k, stage, epoch,
                case when stop is null then 'stream_end' when stop_text like '---[%' then 'terminator' when stop_text like 'Kernel panic%' then 'nested_trigger' else 'unrelated_line' end as closed_by,
                coalesce(stop, n + 1) > k + 1 as traced
            from opened
        )
        select c.session_id, f.line_no as first_line, l.line_no as last_line, last_k - first_k + 1 as n_lines, 'crash' as kind, 'linux' as profile, c.stage, c.epoch, 0 as severity, closed_by,
            closed_by = 'stream_end' as truncated, 0 as retro_attached, traced as interleaved
        from crashes c join told f on f.session_id = c.session_id and f.k = first_k join told l on l.session_id = c.session_id and l.k = last_k
        union all
        select session_id, line_no, line_no, 1, 'line', profile, stage, epoch, null, 'single', false, 0, false
        from told t where not exists (select 1 from crashes c where c.session_id = t.session_id and t.k between first_k and last_k)""",
    "indexed_regex": f"with {_LINES} select device, session_id, line_no from lines where regexp_matches(text, '(with|that) [a-z]+ (was|for) ')",
    "indexed_phrase": f"with {_LINES} select device, session_id, line_no from lines where contains(lower(text), 'of the')",
    "indexed_words": f"with {_LINES} select device, session_id, line_no from lines where regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}])of[^\\p{{L}}\\p{{N}}]+the($|[^\\p{{L}}\\p{{N}}])')",
    "garbage_runs": f"""with {_CONSOLE}, bad as (select session_id, line_no, line_no - row_number() over (partition by session_id order by line_no) as run from console where line_no % 10 < 3)
        select session_id, min(line_no) as from_line, max(line_no) as to_line from bad group by session_id, run""",
    "device_target_rollup": """select r_name, n_name, year(o_orderdate)::int as year, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all""",
    "overwrite_render": f"""with {_LOG} select event_id, case when event_id % 2 = 0 then 'X' || t[2:] else t end as shown
        from (select event_id, case when length(template) >= 3 then template[:length(template) - 3] || '!' || template[length(template) - 1:] end as t from log)""",
    "glob_filter": "select c_name as device from customer where (c_name similar to 'Customer#.*1.' or c_name like '%7') and c_name not like '%17'",
    "idle_devices": f"with {_LOG} select device, greatest({_NOW} - max(at), 0) as idle_ms from log group by 1",
    "prompts_reached": f"""with {_LINES}, last as (select device, max_by(text, (session_id, line_no)) as text from lines where trim(text) <> '' group by 1)
        select device, case when regexp_matches(text, '\\?\\s*$') then 'question' when regexp_matches(text, '\\.\\s*$') then 'stop' when regexp_matches(text, '^[A-Z]') then 'capital' end as kind from last""",
    "epoch_claim": f"""with {_LOG} select device, event_id, template,
        last_value(case when template = 'purchase' and event_id % 3 = 0 then 'power-' || event_id end ignore nulls) over (partition by device order by event_id) as claimed from log""",
    "severity_names": f"with {_LOG} select event_id, case severity when 3 then 'err' when 5 then 'notice' else 'info' end as name, severity::int as value from log",
    "fields_map": f"with {_LOG} select event_id, device::varchar as a, 'x' as bc, 2 as n from log",
}

# AT is a keyword there.
ORACLE_SQL = {name: re.sub(r"\bat\b", '"at"', sql) for name, sql in ORACLE_SQL.items()}
