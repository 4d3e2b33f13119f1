"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_ESCAPED = "replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;')"

_CHAT = f"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
    select *, coalesce(lag(role) over w = role, false) as merged,
        row_number() over w as k
    from turns window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*)::bigint as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(length({_ESCAPED.format("text")})
        + case when merged then 8 else 17 + length({_ESCAPED.format("role")}) + 7 end)::bigint as formatted_chars
from marked group by conv_id
"""

_SUBSTRING = r"""
with docs as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), starts as (
    select doc_id, k, md5(array_to_string(list_slice(w, k, k + 34), ' ')) as h
    from (select doc_id, w, unnest(range(1, len(w) - 33)) as k from docs where len(w) >= 35)
), repeated as (
    select doc_id, k from (select doc_id, k, count(*) over (partition by h) as n from starts) where n > 1
), gone as (
    select distinct doc_id, unnest(range(k, k + 35)) as k from repeated
), words as (
    select doc_id, unnest(range(1, len(w) + 1)) as k, unnest(w) as word from docs
), kept as (
    select words.doc_id, string_agg(word, ' ' order by words.k) as text, count(*) as n
    from words left join gone on words.doc_id = gone.doc_id and words.k = gone.k where gone.k is null group by 1
)
select docs.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from docs left join kept on docs.doc_id = kept.doc_id
"""

_JACCARD = r"""
with recursive docs as (
    select doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
), shingles as (
    select distinct doc_id, md5(array_to_string(list_slice(w, k, k + 4), ' ')) as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as k from docs where len(w) > 0)
), sizes as (select doc_id, count(*) as n from shingles group by 1
), links as (
    select a, b from (
        select x.doc_id as a, y.doc_id as b, count(*) as shared from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2
    ) join sizes sa on sa.doc_id = a join sizes sb on sb.doc_id = b
    where 100 * shared >= 75 * (sa.n + sb.n - shared)
), reach as (
    select doc_id, doc_id as other from docs
    union select reach.doc_id, links.b from reach join links on links.a = reach.other
)
select docs.doc_id, coalesce(n, 0)::bigint as n_shingles, c.component_id
from docs left join sizes on sizes.doc_id = docs.doc_id
join (select doc_id, min(other) as component_id from reach group by 1) c on c.doc_id = docs.doc_id
"""

_LINES = r"""
with lines as (
    select row_id, doc_id, k, line, lower_ascii as key from (
        select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii
        from (
            select row_id, doc_id, unnest(range(1, len(l) + 1)) as k, unnest(l) as line
            from (select row_number() over () as row_id, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
        )
    )
), common as (
    select key, max(doc_id) as keeper from lines where length(key) >= 20 group by key having count(distinct doc_id) >= 3
)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines,
    count(*) filter (keeper is not null and doc_id is distinct from keeper)::bigint as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by k) filter (keeper is null or doc_id is not distinct from keeper), '')) as kept_sha256
from lines left join common using (key) group by row_id
"""

# Filters are applied one after the other, to every document, in every order.
_AUDIT = r"""
with recursive docs as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
), flags as (
    select docs.doc_id, part, [
        len(w) < 200,
        100 * len(list_distinct(w)) < 50 * len(w),
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
        regexp_matches(text, '[#$%&*|]'),
        coalesce(docs.doc_id > min(docs.doc_id) over (partition by text), false)
    ] as fails, coalesce(good, false) as good, coalesce(toxic, false) as toxic
    from docs left join (
        select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1
    ) l on l.doc_id = docs.doc_id
), orders as (
    select '' as o union all select o || x from orders, unnest(['A', 'B', 'C', 'D', 'E']) as t(x) where length(o) < 5 and not contains(o, x)
), steps as (
    select o as filter_order, step, substr(o, step, 1) as letter from orders, range(1, 6) as r(step) where length(o) = 5
), applied as (
    select part, filter_order, step, letter, good, toxic, fails[ascii(letter) - 64] as fail,
        list_bool_or([false] || list_transform(range(1, step), lambda j: fails[ascii(substr(filter_order, j::int, 1)) - 64])) as before,
        len(list_filter(fails, lambda x: x)) as n_fails
    from flags, steps
), counted as (
    select part, filter_order, step, letter,
        count(*) filter (not before and not fail)::bigint as kept,
        count(*) filter (not before and fail)::bigint as removed,
        count(*) filter (before and fail)::bigint as redundant,
        count(*) filter (fail and n_fails = 1)::bigint as unique_fails,
        count(*) filter (not before and fail and good)::bigint as good_lost,
        count(*) filter (not before and fail and toxic)::bigint as toxic_lost
    from applied group by all
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, letter))::bigint as shapley
from counted
"""

_NEGATIVES = r"""
with usable as (
    select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
    select a.id as anchor_id, b.id as other, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
    from usable a join usable b on a.id % 50 = 0 and a.id <> b.id
), positives as (
    select anchor_id, other as positive_id, score as positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, other) <= 5
)
select p.anchor_id, positive_id, (row_number() over hardest)::int as rank, other as negative_id, positive_score, score as negative_score
from positives p join scores s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window hardest as (partition by p.anchor_id, positive_id order by score desc, other)
qualify rank <= 3
"""

ORACLE_SQL = {
    "op2_chat_format": _CHAT,
    "op3_substring_dedup": _SUBSTRING,
    "op6_ngram_jaccard": _JACCARD,
    "op11_line_dedup": _LINES,
    "op12_filter_audit": _AUDIT,
    "op13_hard_negatives": _NEGATIVES,
}
