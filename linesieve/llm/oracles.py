"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

#: Lengths of the marks around a turn's text, by role, in the default chat template; no table has other roles.
_MARKS = "case role when 'system' then 15 when 'user' then 15 else 9 end"
#: A control string's escape adds one character, as does that of a backslash.
_ESCAPED = (
    r"len(regexp_replace(replace(body, '\', '\\'), '(<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<role>|</role>|</turn>)', 'x\1', 'g'))"
)

CHAT = rf"""
with said as (
    select conv_id, turn, role, coalesce(text, '') as body from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), ordered as (
    select *, lag(role, 1, 'start') over (partition by conv_id order by turn, role, body) as state from said
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn, role, body)) as turns_sha256,
    cast(coalesce(sum(len(body)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(body, '' order by turn, role, body) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum({_ESCAPED} + {_MARKS}) as bigint) as formatted_chars,
    bool_and(state || '>' || role in ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) as valid
from ordered group by conv_id
"""

EXACT = r"""
with normal as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents
)
select doc_id, min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
    doc_id = min(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
from normal
"""

NEAR = r"""
with recursive words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
    from documents
), shingles as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from words
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), coded as (
    select doc_id, n, hash(s) as h, row_number() over (partition by doc_id order by hash(s)) as place
    from shingles join sizes using (doc_id)
), lead as (
    select * from coded where place <= n - (n * 85 + 99) // 100 + 1
), candidates as (
    select distinct x.doc_id as a, y.doc_id as b from lead x join lead y on x.h = y.h and x.doc_id < y.doc_id
    where 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
), both_in as (
    select a, b, count(*) as both_n from candidates join shingles x on x.doc_id = a join shingles y on y.doc_id = b and x.s = y.s group by a, b
), links as (
    select a, b from both_in join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * both_n >= 85 * (x.n + y.n - both_n)
), ways as (
    select a, b from links union all select b, a from links
), reach as (
    select doc_id as a, doc_id as b from documents
    union
    select reach.a, ways.b from reach join ways on reach.b = ways.a
), parts as (
    select a as doc_id, min(b) as component_id from reach group by a
)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from documents left join sizes using (doc_id) join parts using (doc_id)
"""

EMBEDDING = """
with recursive usable as (
    select vec_id, cast(embedding as double[]) as v from embeddings
    where embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
    select x.vec_id as a, y.vec_id as b from usable x join usable y on x.vec_id < y.vec_id and len(x.v) = len(y.v)
    where list_cosine_similarity(x.v, y.v) >= 0.9
), ways as (
    select a, b from links union all select b, a from links
), reach as (
    select vec_id as a, vec_id as b from embeddings
    union
    select reach.a, ways.b from reach join ways on reach.b = ways.a
), parts as (
    select a as vec_id, min(b) as component_id from reach group by a
), degrees as (
    select a as vec_id, count(*) as n from ways group by a
)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from parts left join degrees using (vec_id)
"""

SUBSTRING = r"""
with texts as (
    select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), flat as (
    select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from texts
), windows as (
    select doc_id, i, array_to_string(w[i:i + 34], ' ') as body
    from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from texts where len(w) >= 35)
), repeats as (
    select doc_id, i from (select doc_id, i, count(*) over (partition by body) as n from windows) where n > 1
), judged as (
    select flat.doc_id, flat.i, word,
        coalesce(max(repeats.i) over (partition by flat.doc_id order by flat.i rows between 34 preceding and current row), 0) > 0 as gone
    from flat left join repeats on flat.doc_id = repeats.doc_id and flat.i = repeats.i
), sums as (
    select doc_id, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from judged group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from texts left join sums using (doc_id)
"""

_TERMS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

SEARCH = rf"""
with asked as (
    select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by item_id, term
), texts as (
    select doc_id, {_TERMS} as t from documents
), total as (
    select count(*) as docs, cast(sum(len(t)) as bigint) as terms from texts where len(t) > 0
), sizes as (
    select doc_id, 100 - 25 + ((25 * cast(len(t) as bigint) * docs) // terms) as m from texts, total where len(t) > 0
), posts as (
    select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from texts)
    where term in (select term from asked) group by doc_id, term
), weights as (
    select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * n + 1))) as bigint) as w
    from (select term, count(*) as n from posts group by term), total
), scores as (
    select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
    from asked join posts using (term) join weights using (term) join sizes using (doc_id) group by item_id, doc_id
)
select item_id, cast(place as int) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from scores where score > 0) where place <= 20
"""

AUDIT = r"""
with texts as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents
), words as (
    select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from texts
), masks as (
    select doc_id, part, (case when len(w) < 200 then 1 else 0 end) + (case when 100 * list_unique(w) < 50 * len(w) then 2 else 0 end)
        + (case when 100 * (len(t) - len(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * len(t) then 4 else 0 end)
        + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
        + (case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end) as fails
    from words
), marks as (
    select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id
), cells as (
    select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
    from masks left join marks using (doc_id) group by part, fails
), letters as (
    select unnest(range(5)) as k
), orders as (
    select a.k as a, b.k as b, c.k as c, d.k as d, 10 - a.k - b.k - c.k - d.k as e
    from letters a, letters b, letters c, letters d
    where a.k <> b.k and a.k <> c.k and a.k <> d.k and b.k <> c.k and b.k <> d.k and c.k <> d.k
), named as (
    select array_to_string(list_transform([a, b, c, d, e], lambda k: chr(cast(65 + k as int))), '') as filter_order,
        list_transform([a, b, c, d, e], lambda k: cast(pow(2, k) as bigint)) as bits
    from orders
), steps as (
    select filter_order, step, bits[step] as own, cast(coalesce(list_sum(bits[1:step - 1]), 0) as bigint) as before
    from (select *, unnest(range(1, 6)) as step from named)
), counts as (
    select part, filter_order, step, own,
        sum(n) filter (fails & (before | own) = 0) as kept,
        sum(n) filter (fails & before = 0 and fails & own <> 0) as removed,
        sum(n) filter (fails & before <> 0 and fails & own <> 0) as redundant,
        sum(n) filter (fails = own) as unique_fails,
        sum(good) filter (fails & before = 0 and fails & own <> 0) as good_lost,
        sum(toxic) filter (fails & before = 0 and fails & own <> 0) as toxic_lost
    from cells, steps group by part, filter_order, step, own
)
select part, filter_order, cast(step as int) as step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed,
    cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails,
    cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
    cast(coalesce(sum(removed) over (partition by part, own), 0) as bigint) as shapley
from counts
"""

ORACLES = {
    "op3_chat_format": CHAT,
    "op5_minhash_near_dedup": NEAR,
    "op9_embedding_near_dedup": EMBEDDING,
    "op10_exact_dedup": EXACT,
    "op11_substring_dedup": SUBSTRING,
    "op12_ranked_search": SEARCH,
    "op13_filter_audit": AUDIT,
}
