"""DuckDB SQL for the queries, written from the operators' definitions and not from their Spark form."""

from __future__ import annotations

from ..config import Config
from ..functions.text import QUERY_STOP_WORDS, STOP_WORDS
from ..operators.context import CUT_SLACK, LEAST_PARTIAL, MESSAGE_OVERHEAD, PAST_HEADER, PAYLOAD_OVERHEAD, RECENT_HEADER, SEPARATOR, SYSTEM_NOTE

C = Config.small()


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


STOP, QSTOP = _list(STOP_WORDS), _list(QUERY_STOP_WORDS)


# -- Scalar expressions ----------------------------------------------------------------------------


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def pieces(x: str) -> str:
    return rf"string_split_regex({strip(x)}, '\s+')"


def tok(x: str) -> str:
    return f"(CASE WHEN {strip(x)} = '' THEN 0 ELSE greatest(1, round(len({pieces(x)}) / 0.75)) END)::BIGINT"


def cut(x: str, limit: str) -> str:
    return f"(CASE WHEN {tok(x)} <= {limit} THEN {x} ELSE array_to_string(list_slice({pieces(x)}, 1, greatest(1, round_even(({limit}) * 0.75::DOUBLE, 0))::BIGINT), ' ') || ' ...' END)"


def cwords(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))"


def telling(x: str, stop: str = STOP) -> str:
    return f"list_filter({cwords(x)}, lambda w: NOT list_contains({stop}, w))"


def sents(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def role(x: str) -> str:
    plain = f"lower({strip(f'coalesce({x}, {chr(39)}{chr(39)})')})"
    return f"(CASE WHEN {plain} IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant' WHEN {plain} = 'system' THEN 'system' WHEN {plain} = 'tool' THEN 'tool' ELSE 'user' END)"


# -- Tables that queries share ------------------------------------------------------------------------


def summary(p: str, source: str, budget: int, top: int = 20) -> str:
    """CTEs {p}_* over a table source(k, txt); {p}_out(k, summary) has the extractive summaries."""
    return f"""{p}_s AS (SELECT k, txt, {sents("txt")} AS ss FROM {source}),
{p}_x AS (SELECT k, unnest(ss) AS sentence, unnest(range(len(ss))) AS pos FROM {p}_s),
{p}_w AS (SELECT k, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT k, {telling("txt")} AS ws FROM {source})),
{p}_t AS (SELECT k, word, count(*) AS n, min(pos) AS f, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, min(pos)) AS rnk FROM {p}_w GROUP BY k, word),
{p}_top AS (SELECT k, list(word) AS top FROM {p}_t WHERE rnk <= {top} GROUP BY k),
{p}_c AS (SELECT x.k, x.pos, x.sentence, list_distinct({telling("x.sentence")}) AS cs, coalesce(t.top, []) AS top FROM {p}_x x LEFT JOIN {p}_top t ON x.k = t.k),
{p}_sc AS (SELECT *, {tok("sentence")} AS tk, CASE WHEN len(cs) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(cs, top)) / len(cs)::DOUBLE + least(len({pieces("sentence")}) / 20.0::DOUBLE, 1.0::DOUBLE) * 0.2::DOUBLE, 9) END AS score FROM {p}_c),
{p}_r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, pos) AS rank FROM {p}_sc),
{p}_cum AS (SELECT *, sum(tk) OVER (PARTITION BY k ORDER BY rank) <= {budget} AS picked, max(pos) OVER (PARTITION BY k, sentence) AS mp FROM {p}_r),
{p}_j AS (SELECT k, string_agg(sentence, ' ' ORDER BY mp, rank) AS joined FROM {p}_cum WHERE picked GROUP BY k),
{p}_best AS (SELECT k, sentence FROM {p}_r WHERE rank = 1),
{p}_out AS (SELECT s.k, CASE WHEN len(s.ss) = 0 THEN {cut("s.txt", str(budget))} WHEN len(s.ss) = 1 THEN {cut("s.ss[1]", str(budget))}
    WHEN j.joined IS NULL THEN {cut("b.sentence", str(budget))} ELSE j.joined END AS summary
    FROM {p}_s s LEFT JOIN {p}_j j ON s.k = j.k LEFT JOIN {p}_best b ON s.k = b.k)"""


T = f"""t0 AS (SELECT conv_id, turn, {role("role")} AS role, {strip("coalesce(text, '')")} AS content FROM conversations),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, content, {tok("content")} AS tok FROM t0 WHERE content <> '')"""


def vec_of(source: str, key: str, text: str, p: str) -> str:
    """{p}v({key}, dim, w): complete unit vectors in long form."""
    return f"""{p}w AS (SELECT {key}, unnest({cwords(text)}) AS word FROM {source}),
{p}n AS (SELECT {key}, ('0x' || substr(md5(word), 1, 8))::BIGINT % {C.dim} AS dim, count(*)::DOUBLE AS n FROM {p}w GROUP BY ALL),
{p}l AS (SELECT {key}, sqrt(sum(n * n)) AS l FROM {p}n GROUP BY ALL),
{p}v AS (SELECT {", ".join("s." + k.strip() for k in key.split(","))}, g.dim, coalesce(n.n / nullif(l.l, 0), 0.0::DOUBLE) AS w FROM {source} s CROSS JOIN (SELECT unnest(range({C.dim})) AS dim) g
    LEFT JOIN {p}n n ON {" AND ".join(f"s.{k.strip()} = n.{k.strip()}" for k in key.split(","))} AND g.dim = n.dim LEFT JOIN {p}l l ON {" AND ".join(f"s.{k.strip()} = l.{k.strip()}" for k in key.split(","))})"""


def chunked(source: str = "t", single: bool = False, p: str = "") -> str:
    """CTEs up to {p}a (turns with place and chunk_ord), {p}ch (rolled-up chunks), {p}cv (centroids in long form)."""
    fold = f"""{p}sim0 AS (SELECT conv_id, dim, place, avg(w) OVER (PARTITION BY conv_id, dim ORDER BY place ROWS BETWEEN {C.window - 1} PRECEDING AND CURRENT ROW) AS l,
    avg(w) OVER (PARTITION BY conv_id, dim ORDER BY place ROWS BETWEEN 1 FOLLOWING AND {C.window} FOLLOWING) AS r FROM {p}v JOIN {p}pl USING (conv_id, idx)),
{p}sim AS (SELECT conv_id, place AS gap, sum(l * r) / (sqrt(sum(l * l)) * sqrt(sum(r * r)) + 1e-8) AS sim FROM {p}sim0 WHERE r IS NOT NULL GROUP BY conv_id, place),
{p}nat AS (SELECT conv_id, list((gap + 1)::BIGINT) AS nat FROM {p}sim WHERE sim < {C.similarity_threshold} GROUP BY conv_id),
{p}cnt AS (SELECT conv_id, count(*) AS n FROM {source} GROUP BY conv_id),
{p}b0 AS (SELECT c.conv_id, c.n, coalesce(nat, []::BIGINT[]) AS nat FROM {p}cnt c LEFT JOIN {p}nat n ON c.conv_id = n.conv_id),
{p}b AS (SELECT conv_id, list_reduce(range(0, n), lambda s, i: CASE WHEN list_contains(s.nat, i) OR i - s.start >= {C.max_turns} THEN
    {{'start': i, 'kept': CASE WHEN i - s.kept >= {C.min_turns} THEN i ELSE s.kept END, 'nat': s.nat, 'cuts': CASE WHEN i - s.kept >= {C.min_turns} THEN list_append(s.cuts, i) ELSE s.cuts END}}
    ELSE s END, {{'start': 0::BIGINT, 'kept': 0::BIGINT, 'nat': nat, 'cuts': []::BIGINT[]}}).cuts AS cuts FROM {p}b0),
{p}a AS (SELECT s.*, pl.place, len(list_filter(b.cuts, lambda c: c <= pl.place)) AS chunk_ord FROM {source} s JOIN {p}pl pl USING (conv_id, idx) JOIN {p}b b USING (conv_id))"""
    alone = f"{p}a AS (SELECT s.*, pl.place, pl.place AS chunk_ord FROM {source} s JOIN {p}pl pl USING (conv_id, idx))"
    return f"""{p}pl AS (SELECT conv_id, idx, row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS place FROM {source}),
{vec_of(source, "conv_id, idx", "content", p)},
{alone if single else fold},
{p}lw AS (SELECT conv_id, chunk_ord, unnest(ws) AS word, unnest(range(len(ws))) + idx * 1000000 AS pos FROM (SELECT conv_id, chunk_ord, idx, {telling("content")} AS ws FROM {p}a)),
{p}lr AS (SELECT conv_id, chunk_ord, word, row_number() OVER (PARTITION BY conv_id, chunk_ord ORDER BY count(*) DESC, min(pos)) AS r FROM {p}lw GROUP BY conv_id, chunk_ord, word),
{p}lb AS (SELECT conv_id, chunk_ord, string_agg(word, ' · ' ORDER BY r) AS label FROM {p}lr WHERE r <= 3 GROUP BY ALL),
{p}ch0 AS (SELECT conv_id, chunk_ord, min(idx) AS turn_start, max(idx) AS turn_end, sum(tok)::BIGINT AS tok, string_agg(role || ': ' || content, chr(10) ORDER BY idx) AS text FROM {p}a GROUP BY ALL),
{p}ch AS (SELECT c.*, coalesce(l.label, 'turns ' || turn_start || '-' || turn_end) AS label FROM {p}ch0 c LEFT JOIN {p}lb l USING (conv_id, chunk_ord)),
{p}cm AS (SELECT conv_id, chunk_ord, dim, avg(w) AS m FROM {p}v JOIN {p}a USING (conv_id, idx) GROUP BY ALL),
{p}cl AS (SELECT conv_id, chunk_ord, sqrt(sum(m * m)) AS l FROM {p}cm GROUP BY ALL),
{p}cv AS (SELECT conv_id, chunk_ord, dim, CASE WHEN l > 1e-8 THEN m / l ELSE m END AS w FROM {p}cm JOIN {p}cl USING (conv_id, chunk_ord))"""


def noded(p: str = "") -> str:
    """CTEs up to {p}nd: nodes with label and meso."""
    return f"""{p}ms AS (SELECT conv_id || ':' || chunk_ord AS k, text AS txt FROM {p}ch WHERE tok > {C.meso_tokens}),
{summary(p + "me", p + "ms", C.meso_tokens)},
{p}nd0 AS (SELECT c.*, CASE WHEN c.tok <= {C.meso_tokens} THEN c.text ELSE o.summary END AS m FROM {p}ch c LEFT JOIN {p}me_out o ON o.k = c.conv_id || ':' || c.chunk_ord),
{p}nd AS (SELECT conv_id, chunk_ord, label, turn_start, turn_end, tok, CASE WHEN trim(m) = '' THEN 'Conversation about: ' || label ELSE m END AS meso FROM {p}nd0)"""


HOT = f"h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx DESC) AS back FROM t) WHERE back <= {C.hot_turns})"
OUT = f"e AS (SELECT conv_id, idx, role, content, tok FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx DESC) AS back FROM t) WHERE back > {C.hot_turns})"
HOT_TURNS = f"{HOT}, ht AS (SELECT conv_id, idx, role, content, tok FROM h)"
MACRO = f"""mj AS (SELECT conv_id AS k, string_agg(meso, chr(10) || chr(10) ORDER BY chunk_ord) AS txt, count(*) AS node_count, string_agg(label, ' | ' ORDER BY chunk_ord) AS topics, sum(tok)::BIGINT AS tok FROM nd WHERE meso <> '' GROUP BY conv_id),
ml AS (SELECT k, txt FROM mj WHERE {tok("txt")} > {C.macro_tokens}),
{summary("mc", "ml", C.macro_tokens)},
mac AS (SELECT j.k AS conv_id, j.node_count, j.topics, CASE WHEN {tok("j.txt")} <= {C.macro_tokens} THEN j.txt ELSE o.summary END AS macro FROM mj j LEFT JOIN mc_out o ON j.k = o.k)"""
COLD = f"""{MACRO},
tt AS (SELECT conv_id, count(*) AS turn_count, sum(tok)::BIGINT AS tok_orig FROM t GROUP BY conv_id),
cold AS (SELECT m.conv_id, node_count, turn_count, tok_orig, {tok("macro")} AS tok_comp, floor((tok_orig / greatest({tok("macro")}, 1)::DOUBLE) * 100 + 0.5::DOUBLE) / 100 AS ratio, topics FROM mac m JOIN tt USING (conv_id) WHERE macro <> '')"""
QUERY = f"""q AS (SELECT conv_id, arg_max(content, idx) AS query FROM t WHERE role = 'user' GROUP BY conv_id),
{vec_of("q", "conv_id", "query", "q")},
sem AS (SELECT cv.conv_id, cv.chunk_ord, round(sum(cv.w * qv.w), 9) AS sem FROM cv JOIN qv ON cv.conv_id = qv.conv_id AND cv.dim = qv.dim GROUP BY ALL),
cand AS (SELECT n.*, s.sem, q.query, row_number() OVER (PARTITION BY n.conv_id ORDER BY s.sem DESC, n.turn_start, n.chunk_ord) AS rank0
    FROM nd n JOIN sem s USING (conv_id, chunk_ord) JOIN q ON q.conv_id = n.conv_id)"""
KW0 = f"SELECT *, list_distinct({telling('query', QSTOP)}) AS qk, list_distinct({telling(chr(39) + chr(39) + ' || label || ' + chr(39) + ' ' + chr(39) + ' || meso', QSTOP)}) AS tk FROM cand"
KW = f"kws AS (SELECT *, CASE WHEN len(qk) = 0 OR len(tk) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(qk, tk)) / len(qk)::DOUBLE END AS kws FROM ({KW0}))"
HYBRID = f"""{KW},
hy0 AS (SELECT *, turn_end / greatest(max(turn_end) OVER (PARTITION BY conv_id), 1)::DOUBLE * {C.recency_boost}::DOUBLE AS rec, kws * {C.keyword_weight}::DOUBLE AS kw FROM kws WHERE rank0 <= {2 * C.top_k}),
hy1 AS (SELECT *, round(sem + rec + kw, 9) AS composite FROM hy0),
hy AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY composite DESC, sem DESC, turn_start, chunk_ord) AS rank FROM hy1 QUALIFY rank <= {C.top_k})"""
NOTE = SYSTEM_NOTE.replace("'", "''")
HEAD = "'[Topic: ' || label || '] (turns ' || turn_start || '-' || turn_end || ')'"
BLOCKS = f"""sl AS (SELECT *, rank0 AS rank, {HEAD} AS head FROM cand WHERE rank0 <= {C.top_k}),
bl0 AS (SELECT *, head || chr(10) || meso || chr(10) || '{SEPARATOR}' AS block FROM sl),
bl AS (SELECT *, {tok("block")} AS block_tok FROM bl0)"""
PACK = f"""{HOT},
rc AS (SELECT conv_id, sum(tok + {MESSAGE_OVERHEAD})::BIGINT AS recent_tok, count(*) AS recent_n FROM h GROUP BY conv_id),
bu AS (SELECT conv_id, {C.context_tokens} - {tok(f"'{NOTE}'")} - recent_tok - {PAYLOAD_OVERHEAD} AS budget FROM rc),
{BLOCKS},
pk0 AS (SELECT bl.*, bu.budget, sum(block_tok) OVER (PARTITION BY bl.conv_id ORDER BY rank)::BIGINT AS cum FROM bl JOIN bu ON bl.conv_id = bu.conv_id),
pk1 AS (SELECT *, cum <= budget AS included, cum > budget AND budget - (cum - block_tok) > {LEAST_PARTIAL} AS partial FROM pk0),
pk AS (SELECT *, CASE WHEN included THEN block WHEN partial THEN head || chr(10) || {cut("meso", f"(budget - (cum - block_tok) - {tok('head')} - {CUT_SLACK})")} || chr(10) || '{SEPARATOR}' END AS final FROM pk1),
ps AS (SELECT conv_id, string_agg(final, chr(10) ORDER BY rank) AS past, count(final) AS past_n, sum(CASE WHEN final IS NULL THEN 0 ELSE {tok("final")} END)::BIGINT AS past_tok, max(cum) > max(budget) AS was_truncated FROM pk GROUP BY conv_id),
pay AS (SELECT rc.conv_id, ps.past, coalesce(ps.past_n, 0) AS past_n, rc.recent_n,
    CASE WHEN ps.conv_id IS NULL THEN recent_tok ELSE {tok(f"'{NOTE}'")} + {PAYLOAD_OVERHEAD} + recent_tok + past_tok END AS token_count, coalesce(was_truncated, false) AS was_truncated
    FROM rc LEFT JOIN ps ON rc.conv_id = ps.conv_id)"""
STRING = f"""rt AS (SELECT conv_id, string_agg(upper(role) || ': ' || content, chr(10) ORDER BY idx) AS rt FROM h GROUP BY conv_id),
st AS (SELECT pay.*, '{NOTE}' || chr(10) || chr(10) || CASE WHEN past_n > 0 THEN '{PAST_HEADER}' || chr(10) || past || chr(10) || chr(10) ELSE '' END || '{RECENT_HEADER}' || chr(10) || rt AS text
    FROM pay JOIN rt ON pay.conv_id = rt.conv_id)"""

CH = f"{T}, {chunked()}"
ND = f"{CH}, {noded()}"
RT = f"{ND}, {QUERY}"
DOC2 = f"dsrc AS (SELECT doc_id AS k, text AS txt FROM documents), {summary('d', 'dsrc', C.meso_tokens)}"
DOC14 = f"dsrc AS (SELECT doc_id AS k, text AS txt FROM documents), {summary('d', 'dsrc', C.meso_tokens, 14)}"
_LINES = r"list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda s: " + strip("s") + "), lambda s: s <> '')"
_PREFIX = r"(?i)^(user|human|assistant|ai|system)\s*:\s*"
COLD_COLUMNS = "conv_id, node_count, turn_count, tok_orig, tok_comp, ratio, topics"
MANY = "k IN (SELECT k FROM d_s WHERE len(ss) >= 2)"

ORACLE_SQL: dict[str, str] = {
    "segment_turns": f"WITH {T} SELECT conv_id, idx, role, tok, content FROM t",
    "parse_plain_text": f"""WITH l AS (SELECT doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS line FROM (SELECT doc_id, {_LINES} AS ls FROM documents)),
p AS (SELECT doc_id, line, raw, regexp_extract(raw, '{_PREFIX}', 1) AS named FROM l),
r AS (SELECT doc_id, line, CASE WHEN named <> '' THEN {role("named")} WHEN line % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN named <> '' THEN {strip(f"regexp_replace(raw, '{_PREFIX}', '')")} ELSE raw END AS content FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS idx, role, content FROM r WHERE content <> ''""",
    "append_turns": f"WITH {T} SELECT conv_id, idx, role, tok FROM t",
    "normalize_roles": f"""WITH r AS (SELECT conv_id, turn AS idx, CASE turn % 5 WHEN 0 THEN role WHEN 1 THEN upper(role) WHEN 2 THEN '  ' || role || ' '
    WHEN 3 THEN CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'bot' ELSE 'tool ' END ELSE 'stranger' END AS raw FROM conversations) SELECT conv_id, idx, raw, {role("raw")} AS role FROM r""",
    "fits_in_budget": f"SELECT doc_id, {tok('text')} <= 60 AS fits FROM documents",
    "session_flags": f"WITH {T} SELECT conv_id, count(*) >= {C.hot_turns} AS is_full, count(*) > {C.hot_turns} AS has_evictions FROM t GROUP BY conv_id",
    "token_counts": f"SELECT doc_id, {tok('text')} AS tok FROM documents",
    "truncate_text": f"SELECT doc_id, {cut('text', '20')} AS truncated FROM documents",
    "count_messages": f"WITH {T} SELECT conv_id, sum(tok + {MESSAGE_OVERHEAD})::BIGINT AS total FROM t GROUP BY conv_id",
    "sentences": f"SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {sents('text')} AS s FROM documents)",
    "content_words": f"SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS word FROM (SELECT doc_id, {cwords('text')} AS s FROM documents)",
    "top_words": f"WITH {DOC2} SELECT k AS doc_id, rnk AS rank, word, n FROM d_t WHERE rnk <= 20",
    "sentence_scores": f"WITH {DOC2} SELECT k AS doc_id, pos, round(score, 6) AS score FROM d_r WHERE {MANY}",
    "summarizer_trace": f"WITH {DOC14} SELECT k AS doc_id, pos, floor(score * 1000 + 0.5::DOUBLE) / 1000 AS score, picked, len(list_intersect(cs, top))::BIGINT AS hits FROM d_cum WHERE {MANY}",
    "extractive_summary": f"WITH {DOC2} SELECT k AS doc_id, summary, {tok('summary')} AS tok FROM d_out",
    "hashed_embeddings": f"WITH {T}, {vec_of('t', 'conv_id, idx', 'content', '')} SELECT conv_id, idx, dim, round(w, 6) AS w FROM v WHERE w <> 0",
    "window_similarity": f"WITH {CH} SELECT conv_id, gap, round(sim, 6) AS sim FROM sim",
    "boundary_candidates": f"WITH {CH} SELECT conv_id, gap, sim < {C.similarity_threshold} AS is_boundary FROM sim",
    "chunk_boundaries": f"WITH {CH} SELECT conv_id, unnest(cuts) AS b FROM b",
    "chunk_assignments": f"WITH {CH} SELECT conv_id, idx, chunk_ord FROM a",
    "chunk_rollup": f"WITH {CH} SELECT conv_id, chunk_ord, turn_start, turn_end, tok, text FROM ch",
    "chunk_centroids": f"WITH {CH} SELECT conv_id, chunk_ord, dim, round(w, 6) AS w FROM cv WHERE w <> 0",
    "topic_labels": f"WITH {CH} SELECT conv_id, chunk_ord, label FROM ch",
    "micro_summaries": f"""WITH {T}, mi AS (SELECT conv_id || ':' || idx AS k, content AS txt FROM t WHERE tok > {C.micro_tokens}), {summary("mi_", "mi", C.micro_tokens)}
SELECT t.conv_id, t.idx, CASE WHEN t.tok <= {C.micro_tokens} THEN content ELSE o.summary END AS micro FROM t LEFT JOIN mi__out o ON o.k = t.conv_id || ':' || t.idx""",
    "meso_summaries": f"WITH {ND} SELECT conv_id, chunk_ord, m AS meso FROM nd0",
    "macro_summary": f"WITH {ND}, {MACRO} SELECT conv_id, macro, {tok('macro')} AS tok FROM mac",
    "build_nodes": f"WITH {ND} SELECT conv_id, chunk_ord, label, meso, turn_start, turn_end, tok FROM nd",
    "node_compressed_text": f"WITH {ND} SELECT conv_id, chunk_ord, '[Topic: ' || label || ']' || chr(10) || meso AS text FROM nd",
    "node_json_roundtrip": f"WITH {ND} SELECT conv_id, chunk_ord, label, meso, turn_start, turn_end, tok FROM nd",
    "hot_tier": f"WITH {T}, {HOT} SELECT conv_id, idx, content FROM h",
    "evicted_turns": f"WITH {T}, {OUT} SELECT conv_id, idx FROM e",
    "hot_peek": f"WITH {T}, {HOT} SELECT conv_id, arg_min(content, idx) AS oldest, arg_max(content, idx) AS newest FROM h GROUP BY conv_id",
    "evicted_nodes": f"WITH {T}, {OUT}, {chunked('e')} SELECT conv_id, chunk_ord, turn_start, turn_end, label FROM ch",
    "incremental_nodes": f"WITH {T}, {OUT}, {chunked('e', single=True)} SELECT conv_id, chunk_ord, turn_start, turn_end, label FROM ch",
    "flush_hot": f"WITH {T}, {HOT_TURNS}, {chunked('ht')} SELECT conv_id, chunk_ord, turn_start, turn_end, label FROM ch",
    "full_pipeline": f"WITH {CH}, {HOT} SELECT 'warm' AS tier, conv_id, chunk_ord, turn_start, turn_end, label FROM ch UNION ALL SELECT 'hot', conv_id, NULL, idx, idx, NULL FROM h",
    "ingest_nodes_totals": f"WITH {CH} SELECT conv_id, sum(turn_end - turn_start + 1)::BIGINT AS turns, sum(tok)::BIGINT AS tokens FROM ch GROUP BY conv_id",
    "warm_counts": f"WITH {CH} SELECT conv_id, count(*) AS n FROM ch GROUP BY conv_id",
    "warm_scan_all": f"WITH {CH} SELECT conv_id, chunk_ord, turn_start, turn_end FROM ch",
    "warm_by_session": f"WITH {CH} SELECT conv_id, chunk_ord, turn_start, turn_end FROM ch WHERE conv_id = 7",
    "warm_point_lookup": f"WITH {CH} SELECT conv_id, chunk_ord, turn_start, turn_end FROM ch WHERE conv_id = 7 AND chunk_ord = 0",
    "nodes_by_turn_range": f"WITH {CH} SELECT conv_id, chunk_ord, turn_start, turn_end FROM ch WHERE turn_start <= 3 AND turn_end >= 2",
    "retrieve_by_turn": f"WITH {CH}, lu AS (SELECT conv_id, max(idx) AS turn FROM t WHERE role = 'user' GROUP BY conv_id) SELECT ch.conv_id, chunk_ord, turn_start, turn_end, turn FROM ch JOIN lu ON ch.conv_id = lu.conv_id AND turn BETWEEN turn_start AND turn_end",
    "warm_upsert_latest": f"WITH {CH} SELECT conv_id, chunk_ord, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM ch",
    "warm_delete_session": f"WITH {CH} SELECT conv_id, count(*) AS n FROM ch WHERE conv_id % 5 <> 0 GROUP BY conv_id",
    "cold_from_nodes": f"WITH {ND}, {COLD} SELECT {COLD_COLUMNS} FROM cold",
    "cold_latest": f"WITH {ND}, {COLD} SELECT conv_id, node_count, turn_count + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS turn_count, tok_orig, tok_comp, ratio, topics FROM cold",
    "cold_get": f"WITH {ND}, {COLD} SELECT {COLD_COLUMNS} FROM cold WHERE conv_id = 7",
    "cold_index": f"WITH {ND}, {COLD} SELECT conv_id, node_count, turn_count, ratio, topics FROM cold",
    "cold_delete": f"WITH {ND}, {COLD} SELECT {COLD_COLUMNS} FROM cold WHERE conv_id % 5 <> 0",
    "tokens_saved": f"WITH {ND}, {COLD} SELECT coalesce(sum(trunc(node_count * 200 * (ratio - 1))), 0)::BIGINT AS total FROM cold",
    "cosine_topk": """WITH qs AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9) AS score FROM embeddings CROSS JOIN qs)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY rank <= 10""",
    "warm_search": f"""WITH qs AS (SELECT label, min(vec_id) AS query_id, arg_min(embedding, vec_id) AS q, count(*) AS n, max(vec_id) AS top FROM embeddings GROUP BY label),
s AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) + CASE WHEN n > 1 AND top > 0 THEN vec_id / top::DOUBLE * {C.recency_boost}::DOUBLE ELSE 0 END, 9) AS score
    FROM embeddings e JOIN qs ON e.label = qs.label)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY rank <= {C.top_k}""",
    "stateless_retrieve": f"WITH {RT} SELECT conv_id, rank0 AS rank, chunk_ord, floor(sem * 1000000 + 0.5::DOUBLE) / 1000000 AS sem, 0.0::DOUBLE AS rec, 0.0::DOUBLE AS kw, floor(sem * 1000000 + 0.5::DOUBLE) / 1000000 AS composite FROM cand WHERE rank0 <= {C.top_k}",
    "keyword_scores": f"WITH {RT}, {KW} SELECT conv_id, chunk_ord, round(kws, 6) AS kw FROM kws",
    "retrieve_hybrid": f"WITH {RT}, {HYBRID} SELECT conv_id, rank, chunk_ord, floor(sem * 1000000 + 0.5::DOUBLE) / 1000000 AS sem, floor(rec * 1000000 + 0.5::DOUBLE) / 1000000 AS rec, floor(kw * 1000000 + 0.5::DOUBLE) / 1000000 AS kw, floor(composite * 1000000 + 0.5::DOUBLE) / 1000000 AS composite FROM hy",
    "result_to_dict": f"WITH {RT}, {HYBRID} SELECT conv_id, rank, chunk_ord, floor(sem * 10000 + 0.5::DOUBLE) / 10000 AS sem, floor(rec * 10000 + 0.5::DOUBLE) / 10000 AS rec, floor(kw * 10000 + 0.5::DOUBLE) / 10000 AS kw, floor(composite * 10000 + 0.5::DOUBLE) / 10000 AS composite FROM hy",
    "retrieve_all": f"WITH {CH} SELECT conv_id, chunk_ord, round((row_number() OVER (PARTITION BY conv_id ORDER BY turn_start, chunk_ord) - 1) / greatest(count(*) OVER (PARTITION BY conv_id) - 1, 1)::DOUBLE, 6) AS rec FROM ch",
    "context_blocks": f"WITH {RT}, {BLOCKS} SELECT conv_id, rank, block FROM bl",
    "pack_context": f"WITH {RT}, {PACK} SELECT pk.conv_id, rank, included, partial AND NOT included AND (rank = 1 OR cum - block_tok <= budget) AS partial, pay.was_truncated, pay.token_count FROM pk JOIN pay ON pk.conv_id = pay.conv_id",
    "context_messages": f"""WITH {RT}, {PACK}, sy AS (SELECT conv_id, '{NOTE}' || CASE WHEN past_n > 0 THEN chr(10) || chr(10) || '{PAST_HEADER}' || chr(10) || past ELSE '' END AS content FROM pay)
SELECT conv_id, 0::BIGINT AS pos, 'system' AS role, content FROM sy UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY idx), role, content FROM h""",
    "context_string": f"WITH {RT}, {PACK}, {STRING} SELECT conv_id, text FROM st",
    "context_dict": f"WITH {RT}, {PACK} SELECT conv_id, past_n, recent_n, token_count, was_truncated FROM pay",
    "stateless_context": f"WITH {RT}, {PACK}, {STRING} SELECT conv_id, text AS context, token_count, past_n, recent_n, was_truncated FROM st",
    "compression_stats": f"""WITH {ND}, r AS (SELECT conv_id, count(*) AS turns, sum(tok)::BIGINT AS raw FROM t GROUP BY conv_id),
s AS (SELECT conv_id, count(*) AS chunks, sum(CASE WHEN {strip("meso")} = '' THEN 0 ELSE len({pieces("meso")}) END)::BIGINT AS compressed, sum({tok("meso")})::BIGINT AS ct FROM nd GROUP BY conv_id)
SELECT conv_id, turns, chunks, raw, compressed, floor((raw / greatest(compressed, 1)::DOUBLE) * 100 + 0.5::DOUBLE) / 100 AS ratio, floor((raw / greatest(ct, 1)::DOUBLE) * 100 + 0.5::DOUBLE) / 100 AS token_ratio FROM r JOIN s USING (conv_id)""",
    "session_stats": f"""WITH {T}, {HOT}, {OUT}, {chunked("e")}, a1 AS (SELECT conv_id, sum(tok)::BIGINT AS raw, count(*) >= 5 AS cold_exists FROM t GROUP BY conv_id),
h1 AS (SELECT conv_id, count(*) AS hot FROM h GROUP BY conv_id), w1 AS (SELECT conv_id, count(*) AS warm, sum(tok)::BIGINT AS wt FROM ch GROUP BY conv_id)
SELECT conv_id, coalesce(hot, 0) AS hot, coalesce(warm, 0) AS warm, cold_exists, floor((raw / greatest(coalesce(wt, 0) + coalesce(hot, 0) * 50, 1)::DOUBLE) * 100 + 0.5::DOUBLE) / 100 AS ratio FROM a1 LEFT JOIN h1 USING (conv_id) LEFT JOIN w1 USING (conv_id)""",
    "sessions_with_status": f"WITH {T}, r AS (SELECT conv_id, CASE WHEN count(*) % 2 = 0 THEN 'closed' ELSE 'active' END AS status FROM t GROUP BY conv_id) SELECT conv_id, status, status = 'active' AND conv_id % 4 <> 0 AS is_active FROM r",
}
