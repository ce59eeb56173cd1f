"""The queries' results in SQL for a second engine, as far as SQL can say them."""

from __future__ import annotations

from rosterlake.llm.linededup import LONG_WORDS, RUN
from rosterlake.llm.secrets import RULES as SECRETS
from rosterlake.llm.urls import RULES, SOFT, SOFT_HITS, STRICT

SQL: dict[str, str] = {}


def _alone(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op5_weighted_url_vocabulary"] = f"""
with placed as (
  select page_id, {_LOWER.format("coalesce(url, '')")} as u,
         case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as tail from pages
), parts as (
  select page_id, u, {_LOWER.format("regexp_extract(tail, '^[^/?#]*')")} as host,
         regexp_extract(tail, '^[^/?#]*(/[^?#]*)', 1) as path from placed
), rules(r_host, r_path, says) as (values {", ".join(str(r) for r in RULES)}),
fits as (
  select page_id, arg_max(r_host || r_path, length(r_host || r_path)) as rule, arg_max(says, length(r_host || r_path)) as says
  from parts join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path) group by page_id
)
select p.page_id, p.host, p.path, f.rule,
       coalesce(f.says, case when {" or ".join(map(_alone, STRICT))}
                             or {" + ".join(f"({_alone(t)})::int" for t in SOFT)} >= {SOFT_HITS} then 'block' else 'allow' end) as verdict
from parts p left join fits f using (page_id)
"""

_RUNS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op6_wu_manber_decontamination"] = f"""
with d as (select doc_id, text, row_number() over () as r from documents),
dw as (select r, doc_id, {_RUNS.format(_LOWER.format("coalesce(text, '')"))} as w from d),
bw as (select item_id, {_RUNS.format(_LOWER.format("coalesce(text, '')"))} as w from benchmark),
pat as (
  select distinct item_id, least(len(w), 10) as m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as s
  from (select *, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from bw where len(w) > 0)
),
win as (
  select r, i, m, array_to_string(w[i : i + m - 1], ' ') as s
  from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from dw, (select distinct m from pat) where len(w) >= m)
),
hit as (select r, i, win.m, item_id from win join pat using (m, s)),
covered as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + m)) as k from hit) group by r),
items as (
  select r, count(*) as n, string_agg(id, ',' order by id) as ids
  from (select distinct r, item_id::varchar as id from hit) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered using (r) left join items using (r)
"""

SQL["op4_count_min_substring_dedup"] = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (
  select r, doc_id, i, array_to_string(w[i : i + 19], ' ') as s
  from (select *, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)
),
least as (select s, min(struct_pack(doc_id := doc_id, i := i)) as l from win group by s having count(*) > 1),
late as (select r, i from win join least using (s) where struct_pack(doc_id := win.doc_id, i := win.i) > l),
gone as (select distinct r, unnest(range(i, i + 20)) as k from late),
kept as (
  select r, string_agg(word, ' ' order by k) as t, count(*) as n
  from (select r, unnest(range(1, len(w) + 1)) as k, unnest(w) as word from d) anti join gone using (r, k) group by r
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (r)
"""

SQL["op8_multi_index_hamming_near_dedup"] = r"""
with recursive d as (
  select doc_id, row_number() over () as r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
),
shingle as (
  select distinct r, doc_id, array_to_string(w[i : i + 3], ' ') as s
  from (select *, unnest(range(1, greatest(len(w) - 2, 2))) as i from d where len(w) > 0)
),
size as (select r, count(*) as n from shingle group by r),
link as (
  select a.doc_id as a, b.doc_id as b
  from shingle a join shingle b on a.s = b.s and a.r < b.r join size x on x.r = a.r join size y on y.r = b.r
  group by a.r, b.r, a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))
),
edge as (select a, b from link union select b, a from link),
reach(a, b) as (select a, b from edge union select reach.a, edge.b from reach join edge on reach.b = edge.a),
least as (select a, min(b) as m from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) as kept
from d left join size using (r) left join least on a = doc_id
"""

SQL["op9_one_bit_codes"] = """
with v as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pair as (
  select q.vec_id as query_id, c.vec_id as vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
)
select query_id, (row_number() over (partition by query_id order by score, vec_id))::int as rank, vec_id, score
from pair qualify rank <= 10
"""


def _secret_spans() -> str:
    """Every rule's matches with the lengths of what stands between them."""
    return " union all ".join(
        f"""select r, '{rule.kind}' as kind, {place} as place, {rule.part} as part, {rule.least} as least,
        regexp_extract_all(t, p) as hits, regexp_extract_all(t, p, {rule.part}) as parts, string_split_regex(t, p) as gaps
        from (select r, t, '{rule.pattern.replace("'", "''")}' as p from d)"""
        for place, rule in enumerate(SECRETS)
    )


SQL["op1_secret_ledger"] = f"""
with d as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
raw as ({_secret_spans()}),
each as (select r, kind, place, part, least, i, hits, parts, gaps from (select *, unnest(range(1, len(hits) + 1)) as i from raw)),
span as (
  select r, kind, place,
         length(array_to_string(gaps[1 : i], '')) + length(array_to_string(hits[1 : i - 1], '')) as s, length(hits[i]) as n
  from each where length(parts[i]) >= least
),
listed as (
  select r, count(*) filter (where kind = 'assign') as a, count(*) filter (where kind = 'access') as k, count(*) filter (where kind = 'hex') as h,
         string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, place) filter (where place < 3) as base,
         string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, place) as spans
  from span group by r
)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(k, 0)::bigint as n_access, coalesce(h, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join listed using (r)
"""

_SCRIPTS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"

SQL["op3_winnowed_line_dedup"] = f"""
with d as (
  select doc_id, row_number() over () as r, coalesce(text, '') as t,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: not regexp_full_match(x, '[\\x20\\x09-\\x0D]*')) as w
  from documents
),
win as (
  select r, doc_id, i, {RUN} as size, w[i : i + {RUN - 1}] as s
  from (select *, unnest(range(1, len(w) - {RUN - 2})) as i from d where len(w) >= {RUN})
  union all
  select r, doc_id, i, 1, [line] from (select r, doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as line from d)
  where len(regexp_extract_all(line, '[{_SCRIPTS}]{{1,2}}|[^\\x20\\x09-\\x0D{_SCRIPTS}]+')) >= {LONG_WORDS}
),
least as (select s, min(struct_pack(doc_id := doc_id, i := i)) as l from win group by s having count(*) > 1),
late as (select r, i, size from win join least using (s) where struct_pack(doc_id := win.doc_id, i := win.i) > l),
gone as (select distinct r, unnest(range(i, i + size)) as k from late),
kept as (
  select r, string_agg(line, chr(10) order by k) as t, count(*) as n
  from (select r, unnest(range(1, len(w) + 1)) as k, unnest(w) as line from d) anti join gone using (r, k) group by r
)
select doc_id, len(w)::bigint as n_lines, (len(w) - coalesce(n, 0))::bigint as n_removed,
       sha256(case when len(w) > coalesce(n, 0) then coalesce(kept.t, '') else d.t end) as kept_sha256
from d left join kept using (r)
"""

_PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(hit, '.'), lambda p: p::hugeint > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", """len(digits) between 16 and 19 and list_sum(list_transform(range(1, len(digits) + 1), lambda i:
        case when i % 2 = 1 then digits[len(digits) + 1 - i] when digits[len(digits) + 1 - i] > 4 then digits[len(digits) + 1 - i] * 2 - 9 else digits[len(digits) + 1 - i] * 2 end)) % 10 = 0"""),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "len(digits) between 8 and 15"),
)


def _personal_spans() -> str:
    return " union all ".join(
        f"""select r, '{kind}' as kind, {place} as place, start, start + length(hit) as stop from (
          select r, hit, list_transform(regexp_extract_all(hit, '[0-9]'), lambda x: x::int) as digits,
                 length(array_to_string(gaps[1 : i], '')) + length(array_to_string(hits[1 : i - 1], '')) as start
          from (select r, hits, gaps, unnest(range(1, len(hits) + 1)) as i, unnest(hits) as hit
                from (select r, regexp_extract_all(t, '{pattern}') as hits, string_split_regex(t, '{pattern}') as gaps from d)))
        where {good}"""
        for place, (kind, pattern, good) in enumerate(_PERSONAL)
    )


SQL["base_personal_data"] = f"""
with d as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
span as ({_personal_spans()}),
listed as (
  select r, {", ".join(f"count(*) filter (where kind = '{k}') as {k}" for k, _, _ in _PERSONAL)},
         string_agg(kind || ':' || start || ':' || stop, ',' order by place, start) as base
  from span group by r
)
select doc_id, {", ".join(f"coalesce({k}, 0)::bigint as n_{k}" for k, _, _ in _PERSONAL)}, sha256(coalesce(base, '')) as base_sha256
from d left join listed using (r)
"""

#: CRC-32 by its rule: eight halvings of each byte make the table, every byte of a text takes one step.
SQL["op11_radix_importance_resampling"] = f"""
with byte as (
  select list(v order by b) as t from (
    select b, list_reduce(range(8), lambda x, y: case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, b) as v from range(256) r(b))
),
dw as (select doc_id, row_number() over () as r, {_RUNS.format(_LOWER.format("coalesce(text, '')"))} as w from documents),
bw as (select {_RUNS.format(_LOWER.format("coalesce(text, '')"))} as w from benchmark),
df as (
  select r, array_to_string(w[i : i + n - 1], ' ') as f, count(*) as c
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, range(1, 4) g(n)) group by all
),
bf as (
  select array_to_string(w[i : i + n - 1], ' ') as f, count(*) as c
  from (select w, n, unnest(range(1, len(w) - n + 2)) as i from bw, range(1, 4) g(n)) group by all
),
bucket as (
  select f, xor(list_reduce(
    list_transform(range(1, strlen(f) + 1), lambda k: ('0x' || substr(h, 2 * k - 1, 2))::bigint),
    lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1]), 4294967295), 4294967295) % 10000 as b
  from (select f, hex(encode(f)) as h from (select f from df union select f from bf)), byte
),
s as (select b, sum(c) as n from df join bucket using (f) group by b),
t as (select b, sum(c) as n from bf join bucket using (f) group by b),
gain as (
  select b, floor(1000 * ln(
    (coalesce(t.n, 0) + 1)::double * (coalesce((select sum(n) from s), 0) + 10000)::double
    / ((coalesce(s.n, 0) + 1)::double * (coalesce((select sum(n) from t), 0) + 10000)::double)))::bigint as g
  from s full join t using (b)
),
weight as (select r, sum(c)::bigint as n, sum(c * g)::bigint as w from df join bucket using (f) join gain using (b) group by r),
scored as (
  select r, doc_id, len(dw.w) as n_words, coalesce(n, 0)::bigint as n_features, coalesce(weight.w, 0)::bigint as weight,
         coalesce(weight.w, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from dw left join weight using (r)
),
drawn as (
  select r, row_number() over (order by score desc, doc_id nulls first, n_features) as rank from scored where n_words >= 20
  qualify rank <= 5 * count(*) over () // 100
)
select doc_id, n_features, weight, score, rank from scored left join drawn using (r)
"""

SQL["op12_piece_table_fill_in_middle"] = r"""
with d as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
  from documents
),
drawn as (
  select doc_id, t, u, len(u) as n, ('0x' || substr(h, 1, 8))::bigint % (len(u) + 1) as c1, ('0x' || substr(h, 9, 8))::bigint % (len(u) + 1) as c2,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 50 then 'plain'
              when ('0x' || substr(h, 25, 8))::bigint % 100 < 80 then 'spm' else 'psm' end as form
  from d
),
cut as (
  select doc_id, t, n, form, array_to_string(u[1 : least(c1, c2)], '') as p, array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], '') as m,
         array_to_string(u[greatest(c1, c2) + 1 :], '') as s
  from drawn
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from cut
"""
