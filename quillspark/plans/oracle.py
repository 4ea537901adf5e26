"""The catalogue's queries in SQL for DuckDB, written from the definitions and not from the plans."""

from __future__ import annotations

from ..functions import html as H
from ..functions import text as X


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(X.STRIP)}, '', 'g')"


def blank(x: str) -> str:
    return f"(coalesce(length({strip(x)}), 0) = 0)"


def video(x: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {lit(p)}, 1), '')" for p in X.VIDEO_IDS) + ")"


def slug(x: str) -> str:
    spelt = f"translate(lower({x}), '{X.ACCENTED + X.OTHERS + X.SILENT}', '{X.FOLDED + X.FOLDED_OTHERS}')"
    for letter, others in X.SPELT.items():
        spelt = f"replace({spelt}, '{letter}', '{others}')"
    return f"nullif(regexp_replace(regexp_replace({spelt}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), '')"


def ws_tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {lit(X.TOKEN_BREAK)}), lambda t: t <> '')"


LINE = "substring(string_split(text, chr(10))[1], 1, 60)"
PAGE = f"trim(regexp_replace(regexp_replace(regexp_replace(html, {lit(H.HIDDEN)}, ' ', 'g'), {lit(H.TAG)}, ' ', 'g'), {lit(H.GAP)}, ' ', 'g'))"
CRAWLED = f"""crawled as (select page_id, url, case when regexp_matches(html, {lit(H.TITLE)}) then regexp_extract(html, {lit(H.TITLE)}, 1) else url end as title, {PAGE} as whole from pages),
crawl as (select page_id, url, title, substring(whole, 1, 15000) as content from crawled where length({strip('whole')}) >= 100)"""
RANKED = f"""ranked as (select source as slug, doc_id, row_number() over (partition by source order by doc_id) as rank, 'doc://' || doc_id as url, {LINE} as title, text as content, n_chars from documents)"""
TOKENS = f"""tokens as (select source as slug, doc_id, {ws_tokens('text')} as tok from documents where not {blank('text')}),
cut as (select slug, doc_id, tok, unnest(range(0, greatest(1, ceil((len(tok) - 64) / 448.0)::bigint))) as chunk_id from tokens),
chunks as (select slug, doc_id, chunk_id::int as chunk_id, list_slice(tok, chunk_id * 448 + 1, chunk_id * 448 + 512) as own from cut)"""
IMPLICIT = """near as (select *, lag(chunk_id) over w as b, lead(chunk_id) over w as a, 'doc' || doc_id || '#' || chunk_id as src from chunks window w as (partition by doc_id order by chunk_id)),
implicit as (select slug, src, 'SOURCE' as rel, 'doc' || doc_id as dst from near
  union all select slug, src, 'PREVIOUS', 'doc' || doc_id || '#' || b from near where b is not null
  union all select slug, src, 'NEXT', 'doc' || doc_id || '#' || a from near where a is not null)"""
PAIRED = f"""lowered as (select slug, doc_id, chunk_id, {ws_tokens("lower(array_to_string(own, ' '))")} as w from chunks),
numbered as (select slug, doc_id, chunk_id, w, unnest(range(1, least(len(w), 16))) as i from lowered),
pairs as (select slug, doc_id, chunk_id, w[i] as src, 'NEXT_TO' as rel, w[i + 1] as dst from numbered)"""
PATHS = f"{TOKENS}, {IMPLICIT}, {PAIRED}, paths as (select slug, src, rel, dst from pairs union all select slug, src, rel, dst from implicit)"
MESSAGES = """messages as (select 'expert-' || (conv_id % 5) as slug, conv_id, turn, role, text, row_number() over (partition by conv_id % 5 order by conv_id, turn) as seq from conversations)"""
HISTORY = f"""{MESSAGES}, windowed as (select *, coalesce(list(role || ':' || text) over (partition by slug order by seq rows between 20 preceding and 1 preceding), []) as h from messages)"""
VERSIONS = """versions as (select 'u' || user_id as slug, event_id as version, case event_type when 'view' then 'pending' when 'signup' then 'building' when 'click' then 'building' when 'purchase' then 'ready' when 'error' then 'failed' end as status, ts as created_at, floor(value)::bigint as source_count from events),
latest as (select slug, max(version) as version, arg_max(status, version) as status, arg_max(created_at, version) as created_at, arg_max(source_count, version) as source_count, min(version) as first_version from versions group by slug),
experts as (select *, 'Topic ' || slug as topic, 'Topic ' || slug || ' Expert' as persona_name, 'About ' || slug as description, version % 100 as node_count, version % 1000 as relation_count from latest)"""
PLAN = f"""{VERSIONS}, asked as (select slug, unnest(['beginner', 'intermediate', 'advanced', 'custom']) as difficulty from experts),
plan as (select e.*, difficulty, case difficulty when 'beginner' then 4 when 'advanced' then 8 else 6 end as n_modules,
  'Plan a ' || difficulty || ' course about ' || topic || '.' || case when difficulty = 'custom' then chr(10) || 'Focus on: history' else '' end || chr(10) || 'Modules: ' || case difficulty when 'beginner' then 4 when 'advanced' then 8 else 6 end
  || chr(10) || 'Concepts known: ' || node_count || ', relations known: ' || relation_count || chr(10) || 'Summary: ' || substring(description, 1, 500) as prompt
  from asked join experts e using (slug))"""


def top5(by: str) -> str:
    same = f"and q.{by} = v.{by}" if by else ""
    return f"""hits as (select q.vec_id as query_id, v.vec_id as vec_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as similarity from embeddings q join embeddings v on q.vec_id % 20 = 0 {same}),
top as (select query_id, vec_id, similarity, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from hits qualify rank <= 5)"""


TEXTS = f"{TOKENS}, {top5('')}, found as (select query_id, rank, vec_id, slug, array_to_string(own, ' ') as text from top join chunks on doc_id = vec_id and chunk_id = 0)"
VIDEO = """asked as (select page_id, case page_id % 5 when 0 then 'https://video.example/watch?v=' || substring(md5(page_id::varchar), 1, 11) when 1 then 'https://youtu.be/' || substring(md5(page_id::varchar), 1, 11)
 when 2 then 'https://video.example/embed/' || substring(md5(page_id::varchar), 1, 11) || '?t=1' when 3 then 'https://a.bc/' || substring(md5(page_id::varchar), 1, 10) else url end as video_url from pages)"""
TRANSCRIPT = f"""joined as (select conv_id, string_agg(text, ' ' order by turn) as whole from conversations group by conv_id), spoken as (select conv_id, substring(whole, 1, 15000) as content from joined where length({strip('whole')}) >= 100)"""

REPLIES = """p as (select conv_id, turn, role, string_split(text, chr(10)) as lines from conversations), n as (select conv_id, turn, role, lines, case when role = 'system' and len(lines) > 1 then 1 else len(lines) end as stop from p),
sent as (select conv_id, turn, k, lines[k + 1] as data from (select *, unnest(range(0, stop)) as k from n) union all select conv_id, turn, stop, case when role = 'system' and len(lines) > 1 then '[ERROR] broke off' else '[DONE]' end from n)"""

SQL = {
    "src_min_length_truncate": f"select doc_id, length(substring(text, 1, 12000)) as n, md5(substring(text, 1, 12000)) as content_md5 from documents where length({strip('text')}) >= 100",
    "src_title_fallback": f"""with p as (select page_id, url, regexp_extract(html, {lit(H.TITLE)}, 1) as page_title from pages), h as (select doc_id, coalesce(url, 'doc://' || doc_id) as url, case when doc_id % 5 = 0 then '' when doc_id % 5 = 1 then null else page_title end as given from documents left join p on page_id = doc_id)
select doc_id, url, coalesce(nullif(given, ''), url) as title from h""",
    "src_topn_per_expert": f"select source as slug, doc_id, row_number() over (partition by source order by doc_id)::int as rank from documents where length({strip('text')}) >= 100 qualify rank <= 20",
    "src_crawl_extract": f"with {CRAWLED} select page_id, title, length(content) as n, md5(content) as content_md5 from crawl",
    "src_enrich_first5": f"""with {CRAWLED}, {RANKED} select slug, rank::int as rank, case when c.page_id is null then r.url else c.url end as url, case when c.page_id is null then r.title else c.title end as title,
case when c.page_id is null then 'web' else 'crawl' end as source_type, md5(case when c.page_id is null then r.content else c.content end) as content_md5, case when c.page_id is null then 1 else 0 end as n_metadata
from ranked r left join crawl c on page_id = doc_id and page_id % 3 <> 0 and rank <= 5 where rank <= 20""",
    "src_paper_render": f"""select source as slug, row_number() over (partition by source order by n_chars desc, doc_id)::int as rank, doc_id,
md5('## ' || {LINE} || chr(10) || chr(10) || 'By: ' || source || ', ' || lang || chr(10) || chr(10) || substring(text, 1, 200) || chr(10) || chr(10) || 'Date: ' || n_chars) as content_md5 from documents qualify rank <= 5""",
    "src_video_id": f"with {VIDEO} select page_id, video_url, {video('video_url')} as video_id from asked",
    "src_transcript_join": f"with {TRANSCRIPT} select conv_id, 'YouTube: ' || conv_id as title, length(content) as n, md5(content) as content_md5 from spoken",
    "src_elements_join": f"""with e as (select source, doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: not {blank('x')}), chr(10) || chr(10)) as whole from documents)
select doc_id, 'doc_' || doc_id || '.txt' as title, 'file:///in/' || source || '/doc_' || doc_id || '.txt' as url, length(substring(whole, 1, 20000)) as n, md5(substring(whole, 1, 20000)) as content_md5 from e where length({strip('whole')}) >= 50""",
    "src_union_by_type": f"""with {CRAWLED}, {TRANSCRIPT}, every as (select 'web' as source_type, substring(text, 1, 12000) as content from documents where length({strip('text')}) >= 100 union all select 'crawl', content from crawl union all select 'youtube', content from spoken)
select source_type, count(*) as n_sources, sum(length(content))::bigint as n_chars from every group by source_type""",
    "src_nonblank": "select source as slug, count(*) as source_count, count(*) filter (where doc_id % 10 <> 0 and trim(text) <> '') as indexed_count from documents group by source",
    "src_metadata_merge": f"select doc_id, 'doc://' || doc_id as url, case when doc_id % 2 = 0 then 'given' else {LINE} end as title, 'web' as source_type, n_chars::varchar as score, 4 as n_keys from documents",
    "idx_chunks": f"with {TOKENS} select doc_id, chunk_id, len(own)::int as n_tokens, md5(array_to_string(own, ' ')) as text_md5 from chunks",
    "idx_chunk_counts": f"with {TOKENS} select slug, count(distinct doc_id) as n_documents, count(*) as n_chunks, sum(len(own))::bigint as n_tokens, max(len(own))::int as most_tokens from chunks group by slug",
    "idx_implicit_paths": f"with {TOKENS}, {IMPLICIT} select src, rel, dst from implicit",
    "idx_paths_capped15": f"with {TOKENS}, {PAIRED} select doc_id, chunk_id, count(*) as n_paths, count(distinct (src, dst)) as n_pairs, min(src) as least_src, max(dst) as most_dst from pairs group by doc_id, chunk_id",
    "idx_nodes": f"with {PATHS} select slug, src as node_id from paths union select slug, dst from paths",
    "idx_relations": f"with {PATHS} select distinct slug, src, rel, dst from paths",
    "idx_graph_stats": f"""with {PATHS}, ends as (select slug, src as n from paths union select slug, dst from paths), n as (select slug, count(*) as c from ends group by slug), r as (select slug, count(*) as c from (select distinct slug, src, rel, dst from paths) group by slug),
every as (select source as slug from documents union select 'expert-' || (conv_id % 5) from conversations) select slug, coalesce(n.c, 0) as node_count, coalesce(r.c, 0) as relation_count from every left join n using (slug) left join r using (slug)""",
    "graph_star_stats": """with e as (select 'IN_REGION' as slug, 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation union all select 'IN_NATION', 'c' || c_custkey, 'n' || c_nationkey from customer union all select 'PLACED', 'c' || o_custkey, 'o' || o_orderkey from orders),
n as (select slug, count(*) as node_count from (select slug, src from e union select slug, dst from e) group by slug), r as (select slug, count(*) as relation_count from (select distinct * from e) group by slug) select slug, node_count, relation_count from n join r using (slug)""",
    "vec_cosine_topk5": f"with {top5('')} select query_id, rank::int as rank, vec_id, round(similarity, 6) as similarity from top",
    "vec_namespace_topk5": f"with {top5('label')} select query_id, rank::int as rank, vec_id, round(similarity, 6) as similarity from top",
    "vec_norm_dim_check": "with v as (select 'ns-' || label as namespace, len(embedding)::int as width, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings) select namespace, count(*) as n, min(width) as least_width, max(width) as most_width, round(min(norm), 4) as least_norm, round(max(norm), 4) as most_norm from v group by namespace",
    "vec_rebuild_append": "with v as (select 'ns-' || label as namespace, vec_id from embeddings where vec_id % 2 = 0 union all select 'ns-' || label, vec_id from embeddings where label < 5) select namespace, count(*) as n_rows, sum(vec_id)::bigint as sum_ids from v group by namespace",
    "vec_rebuild_replace": "select 'ns-' || label as namespace, count(*) as n_rows, sum(vec_id)::bigint as sum_ids from embeddings where label < 5 or vec_id % 2 = 0 group by label",
    "vec_hits_with_text": f"with {TEXTS} select query_id, rank::int as rank, vec_id, slug, md5(text) as text_md5 from found",
    "graph_expand_1hop": f"""with {TEXTS}, {IMPLICIT}, both_ways as (select slug, src as node, rel, dst as other from implicit union all select slug, dst, rel || '^-1', src from implicit)
select distinct query_id, f.slug, rel, other as node from found f join both_ways b on b.slug = f.slug and b.node = 'doc' || vec_id || '#0'""",
    "ctx_assemble_3000": f"""with {TEXTS}, j as (select query_id, string_agg(text, chr(10) order by rank) as joined from found group by query_id), c as (select query_id, case when {blank('joined')} then '' else chr(10) || chr(10) || '[knowledge]' || chr(10) || substring(joined, 1, 3000) || chr(10) || '[/knowledge]' end as context from j)
select query_id, length(context) as n, md5(context) as context_md5 from c""",
    "chat_answer": f"""with {TEXTS}, j as (select query_id, string_agg(text, chr(10) order by rank) as joined from found group by query_id), c as (select query_id, case when {blank('joined')} then '' else chr(10) || chr(10) || '[knowledge]' || chr(10) || substring(joined, 1, 3000) || chr(10) || '[/knowledge]' end as context from j),
a as (select vec_id as query_id, case when {blank("context")} then 'Nothing is known about: what is ' || vec_id else substring({strip('context')}, 1, 400) end as answer from embeddings left join c on query_id = vec_id where vec_id % 20 = 0) select query_id, length(answer) as n, md5(answer) as answer_md5 from a""",
    "chat_history20": f"with {HISTORY} select slug, seq, len(h)::int as n_history, md5(array_to_string(h, '|')) as history_md5 from windowed",
    "chat_payload": f"with {HISTORY} select slug, seq, (len(h) + 1)::int as n_messages, md5(array_to_string(list_append(h, 'user:' || text), '|')) as messages_md5 from windowed where role = 'user'",
    "chat_history_list": f"with {MESSAGES} select slug, seq, role, md5(text) as text_md5 from messages",
    "chat_orphans": f"with {MESSAGES}, n as (select *, lead(role) over (partition by slug order by seq) as after from messages) select slug, seq from n where role = 'user' and (after is null or after <> 'assistant')",
    "chat_reset": f"with {MESSAGES} select slug, count(*) as n_messages from messages where slug not in (select slug from messages where conv_id % 10 = 2) group by slug",
    "reg_latest": f"with {VERSIONS} select slug, version, status, source_count, first_version from latest",
    "reg_get": f"with {VERSIONS} select slug, version, status from latest where slug = 'u7'",
    "reg_list": f"with {VERSIONS} select slug, first_version, status from latest order by first_version, slug",
    "reg_summary": f"with {VERSIONS} select slug, topic, persona_name, description, status, source_count, node_count, relation_count, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at from experts",
    "reg_gate_codes": f"""with {VERSIONS}, a as (select conv_id, turn, case turn % 4 when 0 then 'chat' when 1 then 'course' when 2 then 'history' else 'create' end as kind, case when (conv_id + turn) % 3 = 0 then ' ' || chr(9) || chr(10) else text end as message, 'u' || (conv_id * 3) as slug from conversations)
select conv_id, turn, kind, case when kind <> 'create' and status is null then 404 when kind in ('chat', 'course') and status <> 'ready' then 409 when kind in ('chat', 'create') and {blank('message')} then 400 else 200 end as code from a left join latest using (slug)""",
    "reg_create_shortcircuit": f"with {VERSIONS}, a as (select slug from versions union select source from documents) select slug, case when status = 'ready' then 'skip' when status is null then 'build' else 'rebuild' end as action from a left join latest using (slug)",
    "reg_slugify": f"select doc_id, {slug('substring(text, 1, 80)')} as topic_slug from documents",
    "prompt_desc_titles8": f"with {RANKED} select slug, count(*)::int as n_titles, md5(string_agg('* ' || title, chr(10) order by rank)) as bullets_md5 from ranked where rank <= 8 group by slug",
    "course_plan": f"with {PLAN} select slug, difficulty, n_modules, md5(prompt) as prompt_md5 from plan",
    "course_modules_expand": f"with {PLAN}, m as (select slug, topic, difficulty, unnest(range(1, n_modules + 1))::int as module_no from plan) select slug, difficulty, module_no, 'Part ' || module_no || ' of ' || topic as module_title from m",
    "course_parse_markdown": f"""with {PLAN} select slug, difficulty, topic as title, n_modules, array_to_string(list_transform(range(1, n_modules + 1), lambda i: 'Part ' || i || ' of ' || topic), ';') as module_titles,
array_to_string(list_transform(range(1, n_modules + 1), lambda i: '2'), ';') as concept_counts, 'That was it.' as conclusion from plan""",
    "course_text": f"""with {PLAN}, whole as (select slug, difficulty, '# ' || topic || chr(10) || chr(10) || 'What is coming.' || chr(10) || chr(10) || array_to_string(list_transform(range(1, n_modules + 1), lambda i: '## Part ' || i || ' of ' || topic || chr(10) || 'Summary: what part ' || i || ' is about' || chr(10) || 'Concepts: ' || difficulty || ', ' || topic || chr(10) || chr(10) || 'Text of the part.'), chr(10) || chr(10)) || chr(10) || chr(10) || '# Conclusion' || chr(10) || chr(10) || 'That was it.' as md from plan),
sent as (select slug, difficulty, case when difficulty = 'custom' then array_to_string(string_split(md, chr(10) || chr(10))[1:2], chr(10) || chr(10)) || chr(10) || chr(10) || chr(10) || chr(10) || '**Error:** broke off' else md end as text from whole) select slug, difficulty, length(text) as n, md5(text) as text_md5 from sent""",
    "ui_preview160": "select doc_id, case when doc_id % 9 = 0 or length(text) = 0 then 'No description yet.' when length(text) > 160 then substring(text, 1, 160) || '...' else text end as preview from documents",
    "sse_frame": "with f as (select conv_id, turn, 'data: ' || replace(text, chr(10), chr(10) || 'data: ') || chr(10) || chr(10) as raw from conversations) select conv_id, turn, length(raw) as n, md5(raw) as raw_md5 from f",
    "sse_parse": """with p as (select conv_id, turn, string_split(text, chr(10)) as lines from conversations), spec as (select 'spec' as mode, conv_id, turn, unnest(range(0, len(lines))) as line_no, lines from p),
every as (select mode, conv_id, turn, line_no, lines[line_no + 1] as data from spec union all select 'legacy', conv_id, turn, i, case when i = 0 then lines[1] else substring(lines[i + 1], 7) end from (select conv_id, turn, lines, unnest(range(0, len(lines))) as i from p) where i = 0 or starts_with(lines[i + 1], 'data: '))
select mode, conv_id, turn, line_no::int as line_no, case when data = '[DONE]' then 'done' when starts_with(data, '[ERROR]') then 'error' else 'data' end as kind, md5(data) as data_md5 from every""",
    "ui_detail_rows": f"""with {VERSIONS} select slug, 'Status' as label, status as value from experts union all select slug, 'Sources', source_count::varchar from experts union all select slug, 'Concepts', node_count::varchar from experts
union all select slug, 'Relations', relation_count::varchar from experts union all select slug, 'Namespace', 'expert-' || slug from experts union all select slug, 'Path', 'storage/' || slug from experts""",
    "build_progress": f"""with {VERSIONS}, s as (select * from (values (1, 'sources'), (2, 'pages'), (3, 'papers'), (4, 'concepts'), (5, 'relations')) t(stage, what))
select slug, stage::int as stage, stage || '/5 ' || what || ': ' || case stage when 4 then node_count when 5 then relation_count else source_count end as payload from experts cross join s""",
    "sse_reply_frames": f"""with {REPLIES} select conv_id, turn, k::int as frame_no, md5('data: ' || data || chr(10) || chr(10)) as raw_md5 from sent""",
    "sse_client_join": f"""with {REPLIES} select conv_id, turn, md5(coalesce(string_agg(data, '' order by k) filter (where data <> '[DONE]' and not starts_with(data, '[ERROR]')), '')) as text_md5, bool_or(data = '[DONE]') as ended, max(data) filter (where starts_with(data, '[ERROR]')) as error from sent group by conv_id, turn""",
    "stream_progress": """with f as (select 'u' || user_id as slug, case event_type when 'view' then 1 when 'signup' then 2 when 'click' then 3 when 'purchase' then 4 when 'error' then 5 end as stage, event_type from events)
select slug, stage::int as stage, count(*) as n_frames, sum(length('data: ' || stage || '/5 ' || event_type) + 2)::bigint as n_chars from f where stage is not null group by slug, stage""",
    "stream_chat_state": """select conv_id, count(*) as n_messages, least(count(*), 20)::int as n_history, arg_max(role, turn) as last_role, md5(array_to_string(list_slice(list(role || ':' || text order by turn), -20, -1), '|')) as history_md5 from conversations group by conv_id""",
    "stream_chat_history": """with m as (select 'expert-' || (conv_id % 5) as slug, conv_id * 1000000 + turn as seq, role, text, conv_id % 8 = 0 and turn = 0 as reset from conversations),
parts as (select *, count(*) filter (where reset) over (partition by slug order by seq) as part from m),
windowed as (select *, coalesce(list(role || ':' || text) over (partition by slug, part order by seq rows between 20 preceding and 1 preceding), []) as h from parts)
select slug, seq, len(h)::int as n_history, md5(array_to_string(h, '|')) as history_md5 from windowed""",
    "build_restart": f"""with {PATHS}, ends as (select slug, src as n from paths union select slug, dst from paths), n as (select slug, count(*) as c from ends group by slug),
r as (select slug, count(*) as c from (select distinct slug, src, rel, dst from paths) group by slug), k as (select slug, count(*) as c from chunks group by slug), d as (select source as slug, count(*) as c from documents group by source)
select {slug('d.slug')} as slug, 'ready' as status, d.c as source_count, coalesce(n.c, 0) as node_count, coalesce(r.c, 0) as relation_count, d.c as n_sources, coalesce(k.c, 0) as n_chunks, coalesce(n.c, 0) as n_nodes, coalesce(k.c, 0) as n_vectors
from d left join n using (slug) left join r using (slug) left join k using (slug)""",
    "chat_synthesis": f"""with {TEXTS}, kept as (select query_id, rank, text from found where not {blank('text')}), packs as (select *, coalesce(sum(length(text)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) // 3000 as pack from kept),
one as (select query_id, pack, substring({strip("string_agg(text, chr(10) order by rank)")}, 1, 400) as answer from packs group by query_id, pack),
two as (select query_id, substring({strip("string_agg(answer, chr(10) order by pack)")}, 1, 400) as answer from one group by query_id)
select vec_id as query_id, length(answer) as n, md5(answer) as answer_md5 from embeddings left join two on query_id = vec_id where vec_id % 20 = 0""",
}
