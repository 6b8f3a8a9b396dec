"""SQL for the corpus queries that SQL can express.

The others need zstandard (3), trained models (4, 6), tokenizers (5, 9, 13), Ogg bytes (7), XXH64 with
a seed (10) or CRC-32 (11); tests hold those against brute force, round trips and held-out rows."""

from __future__ import annotations

from .mixing import LEAST_BUCKETS, OFFSET_STEPS
from .secrets import ACCESS, ASSIGN, HEX, RUN, WIDE_MOST, WIDE_SHARE


def text_of(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def located(name: str, kind: str, pattern: str, value: str, keep: str) -> str:
    """(doc_id, owner, repository, start, finish, kind, value) of the matches of a pattern that pass keep."""
    return f"""{name} as (
  select doc_id, owner, repository, s as start, s + length(m) as finish, '{kind}' as kind, {value} as value from (
    select doc_id, owner, repository, unnest(ms) as m, unnest(list_transform(range(1, len(ms) + 1), lambda i: length(ps[1]) + coalesce(list_sum(list_transform(range(1, i), lambda j: length(ms[j]) + length(ps[j + 1]))), 0))) as s
    from (select doc_id, owner, repository, regexp_extract_all(t, {text_of(pattern)}) as ms, regexp_split_to_array(t, {text_of(pattern)}) as ps from texts) where len(ms) > 0) where {keep})"""


GROUP_2 = f"regexp_extract(m, {text_of(ASSIGN)}, 2)"
ENTROPY = "-list_sum(list_transform(list_distinct(string_split(m, '')), lambda c: ((length(m) - length(replace(m, c, '')))::double / length(m)) * log2((length(m) - length(replace(m, c, '')))::double / length(m))))"

SECRETS = f"""with texts as (select doc_id, coalesce('is ' || source, 'none') as owner, coalesce('is ' || source, 'none') || ' ' || coalesce('is ' || lang, 'none') as repository, coalesce(text, '') as t from documents),
{located("a", "assign", ASSIGN, GROUP_2, f"length({GROUP_2}) >= 6")},
{located("k", "access", ACCESS, "m", "length(m) >= 20")},
{located("h", "hex", HEX, "m", "length(m) >= 24")},
base as (select *, 0 as rank from a union all select *, 1 from k union all select *, 2 from h),
{located("r", "owned", RUN, "m", f"regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]') and {ENTROPY} >= 3.5")},
found as (select * from base union all select *, 3 from r where not exists (select 1 from base b where b.doc_id = r.doc_id and b.start < r.finish and r.start < b.finish)),
every as (select greatest(1, least(greatest({WIDE_MOST}, floor(sqrt(count(distinct owner)))), floor(count(distinct owner) * {WIDE_SHARE}))) as o, greatest(1, least(greatest({WIDE_MOST}, floor(sqrt(count(distinct repository)))), floor(count(distinct repository) * {WIDE_SHARE}))) as r from texts),
owned as (select value, count(distinct owner) as owners, count(distinct repository) as repositories from found group by value),
judged as (select h.*, owners > o and repositories > r as copied from owned h, every),
spans as (select f.*, j.owners, j.repositories, j.copied, kind || ':' || start || ':' || finish as written from found f join judged j using (value) where rank < 3 or not copied)
select d.doc_id, count(s.kind) filter (where kind = 'assign') as n_assign, count(s.kind) filter (where kind = 'access') as n_access, count(s.kind) filter (where kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(written, ',' order by start, rank) filter (where rank < 3), '')) as base_sha256, coalesce(string_agg(written, ',' order by start, rank), '') as spans,
  count(s.kind) filter (where not copied) as n_owner_specific, coalesce(string_agg(owners || ':' || repositories, ',' order by start, rank), '') as owners_repositories
from documents d left join spans s on s.doc_id = d.doc_id group by d.doc_id"""

CHAT = r"""with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped as (select *, length(replace(replace(replace(text, '\', '\b'), '</turn>', '\t'), '###', '\h')) as n_text,
  length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\t'), '###', '\h'), chr(10), '\n')) as n_role from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(4 + n_role + 1 + n_text + 8)::bigint as formatted_chars, case ((conv_id % 4) + 4) % 4 when 1 then 'turn_rows' when 2 then (case when bool_or(role in ('human', 'gpt')) then 'messages' else 'from_value' end) else 'messages' end as layout
from escaped group by conv_id"""

NUMBER = "cast('0x' || substr({}, 1, 8) as bigint)"

#: Up to LEAST_BUCKETS * CELL_ROWS documents, where the operator has as many hash buckets as here.
MIXING = rf"""with sized as (select doc_id, source is null as no_source, coalesce(source, '') as source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
  coalesce(md5(cast(doc_id as varchar)), md5(coalesce(text, ''))) || md5(coalesce(text, '')) as key from documents),
classed as (select *, case when size < 16 then size else length(bin(size)) * 32 + (size >> (length(bin(size)) - 5)) end as class, floor({NUMBER.format("key")} * {LEAST_BUCKETS} / 4294967296.0::double) as bucket from sized),
ranked as (select *, row_number() over (partition by no_source, source order by class, bucket, key, size) - 1 as rank from classed),
sources as (select no_source, source, sum(size)::bigint as source_size from sized group by 1, 2),
weighed as (select *, [3.0::double, 1.0::double, 2.0::double][(row_number() over (order by no_source, source) - 1) % 3 + 1] as w, 2.0::double * source_size as cap from sources),
levels as (select *, cap / w as turn, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, no_source, source rows between unbounded preceding and 1 preceding), 0))
  / (sum(w) over () - coalesce(sum(w) over (order by cap / w, no_source, source rows between unbounded preceding and 1 preceding), 0)) as level from weighed),
targets as (select no_source, source, source_size, least(cap, coalesce((select level from levels where turn >= level order by turn, no_source, source limit 1), 'inf'::double) * w) as target from levels),
due as (select r.doc_id, r.size, t.source_size, t.target, r.rank, case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as due,
  ({NUMBER.format("md5('7:' || r.no_source || ':' || r.source)")} % {OFFSET_STEPS}) / {OFFSET_STEPS}.0::double as u from ranked r join targets t using (no_source, source))
select doc_id, size, source_size, target, cast((floor((rank + 1) * due + u) - floor(rank * due + u)) * size as bigint) as taken from due"""

FAR = "list_sum(list_transform(range(1, 65), lambda k: (v.v[k] - c.v[k]) * (v.v[k] - c.v[k])))::bigint"


def clustering(k: int = 8, rounds: int = 10) -> str:
    """One assignment and one move of the centroids after the other, then the last assignment."""
    steps = [
        f"""v as materialized (select row_number() over (order by sha256('3:' || coalesce(vec_id::varchar, ''))) as row, vec_id, sha256('3:' || coalesce(vec_id::varchar, '')) as digest,
  list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"c0 as materialized (select row_number() over (order by digest, v) - 1 as i, v from v qualify row_number() over (order by digest, v) <= {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select row, vec_id, v, i, d from (select v.row, v.vec_id, v.v, c.i, {FAR} as d from v cross join c{r} c) qualify row_number() over (partition by row order by d, i) = 1)")
        if r < rounds:
            steps.append(f"""s{r} as materialized (select i, list(m order by k) as v from (select i, k, (s - ((s % n) + n) % n) // n as m from (
  select i, k, sum(v[k])::bigint as s, count(*) as n from a{r}, (select unnest(range(1, 65)) as k) group by i, k)) group by i)""")
            steps.append(f"c{r + 1} as materialized (select c.i, coalesce(s.v, c.v) as v from c{r} c left join s{r} s using (i))")
    return "with " + ",\n".join(steps) + f"""
select a.vec_id, a.i::int as cluster, a.d as distance, sum(a.d) over (partition by a.i)::bigint as cluster_inertia, sum(a.d) over ()::bigint as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256 from a{rounds} a join c{rounds} c using (i)"""


SQL = {"op1_secret_scan": SECRETS, "op2_chat_format": CHAT, "op8_mixing": MIXING, "op12_centroids": clustering()}
