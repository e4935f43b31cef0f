"""The catalogue's rows in SQL for DuckDB, over the same tables."""

from __future__ import annotations

from ..functions.stem import stem_sql
from ..operators.tasks import _STYLE

_EVENTS = """
  SELECT event_type AS pid, 'X' AS slot, user_id::VARCHAR AS word, 1 AS cnt FROM events
  UNION ALL SELECT event_type, 'Y', regexp_extract(props, '"k": *([^,}]*)', 1), 1 FROM events"""
_LINES = """
  SELECT pid, s.slot AS slot, s.word AS word, cnt FROM (
    SELECT concat('X ', lower(p_type), ' s', p_size % 8, ' Y') AS pid, trunc(l_quantity)::BIGINT AS cnt,
           unnest([{slot: 'X', word: s_nationkey::VARCHAR}, {slot: 'Y', word: p_brand}]) AS s
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def _mi(source: str, paths: str = "TRUE") -> str:
    return f"""
t AS (SELECT pid, slot, word, sum(cnt) AS cnt FROM ({source}) GROUP BY ALL),
c AS (SELECT slot, word, sum(cnt) AS c FROM t GROUP BY ALL),
d AS (SELECT slot, sum(cnt) AS d FROM t GROUP BY ALL),
b AS (SELECT pid, slot, sum(cnt) AS b FROM t GROUP BY ALL),
mi AS (
  SELECT * FROM (
    SELECT t.pid, t.slot, t.word, ln((t.cnt::DOUBLE * d.d::DOUBLE) / (b.b::DOUBLE * c.c::DOUBLE)) AS mi, t.cnt::BIGINT AS cnt
    FROM t JOIN b USING (pid, slot) JOIN c USING (slot, word) JOIN d USING (slot) WHERE {paths}) WHERE mi > 0)"""


def _mi_query(source: str, paths: str = "TRUE") -> str:
    return f"WITH {_mi(source, paths)} SELECT pid, slot, word, round(mi, 6) AS mi, cnt FROM mi"


_PAIRS = """
paths AS (SELECT pid, row_number() OVER (ORDER BY pid) AS n FROM (SELECT DISTINCT pid FROM t)),
pairs AS (
  SELECT (a.n * 10 + b.n - a.n)::BIGINT AS ord, a.pid AS lhs,
         CASE WHEN b.n - a.n = 2 THEN 'Y ' || substr(b.pid, 3, length(b.pid) - 4) || ' X' ELSE b.pid END AS rhs,
         CASE WHEN (length(a.pid) + length(b.pid)) % 3 = 0 THEN 1 ELSE 0 END AS label
  FROM paths a JOIN paths b ON b.n - a.n BETWEEN 1 AND 3),
verbs AS (SELECT DISTINCT split_part(x, ' ', 2) AS word FROM (SELECT lhs AS x FROM pairs UNION ALL SELECT rhs FROM pairs)),
stems AS (""" + stem_sql("verbs") + """),
templates AS (SELECT DISTINCT x AS template FROM (SELECT lhs AS x FROM pairs UNION ALL SELECT rhs FROM pairs)),
norms AS (
  SELECT template, concat('X ', stem, ' ', split_part(template, ' ', 3), ' Y') AS pid, starts_with(template, 'Y ') AS swapped,
         CASE WHEN starts_with(template, 'Y ') THEN concat('Y ', stem, ' ', split_part(template, ' ', 3), ' X') ELSE concat('X ', stem, ' ', split_part(template, ' ', 3), ' Y') END AS logical
  FROM templates JOIN stems ON word = split_part(template, ' ', 2)),
np AS (
  SELECT p.*, a.pid AS p1, a.swapped AS sw1, a.logical AS norm_lhs, b.pid AS p2, b.swapped AS sw2, b.logical AS norm_rhs
  FROM pairs p JOIN norms a ON a.template = lhs JOIN norms b ON b.template = rhs),
sums AS (SELECT pid, slot, sum(mi) AS total, count(*) AS words FROM mi GROUP BY ALL)"""


def _sims(slots: str, name: str = "sims") -> str:
    """``slots``: rows ord, align, p1, s1, p2, s2."""
    return f"""
asked_{name} AS ({slots}),
over_{name} AS (
  SELECT ord, align, sum(m1.mi + m2.mi) AS common, count(*) AS shared FROM asked_{name} a
  JOIN mi m1 ON m1.pid = p1 AND m1.slot = s1 JOIN mi m2 ON m2.pid = p2 AND m2.slot = s2 AND m2.word = m1.word GROUP BY ALL),
{name} AS (
  SELECT a.*, coalesce(common / (x.total + y.total), 0) AS sim, coalesce(x.words, 0) AS words1, coalesce(y.words, 0) AS words2, coalesce(shared, 0) AS shared
  FROM asked_{name} a LEFT JOIN sums x ON x.pid = p1 AND x.slot = s1 LEFT JOIN sums y ON y.pid = p2 AND y.slot = s2 LEFT JOIN over_{name} o ON o.ord = a.ord AND o.align = a.align)"""


_ROLES = """SELECT ord, a || b AS align, p1, CASE WHEN sw1 THEN translate(a, 'XY', 'YX') ELSE a END AS s1, p2, CASE WHEN sw2 THEN translate(b, 'XY', 'YX') ELSE b END AS s2
  FROM np, (VALUES ('X', 'X'), ('Y', 'Y'), ('X', 'Y'), ('Y', 'X')) v(a, b)"""
_PLAIN = "SELECT ord, a || a AS align, p1, a AS s1, p2, a AS s2 FROM np, (VALUES ('X'), ('Y')) v(a)"
_SCORE = "sqrt(max(CASE WHEN align = '{}' THEN sim END) * max(CASE WHEN align = '{}' THEN sim END))"


def _scores(slots: str = _ROLES, best: bool = False, name: str = "scores") -> str:
    score = _SCORE.format("XX", "YY")
    if best:
        score = f"greatest({score}, {_SCORE.format('XY', 'YX')})"
    return f"""{_sims(slots, f"sims_{name}")},
{name} AS (SELECT np.ord, lhs, rhs, label, norm_lhs, norm_rhs, s.score FROM np JOIN (SELECT ord, round({score}, 6) AS score FROM sims_{name} GROUP BY ord) s ON s.ord = np.ord)"""


_BASE = f"WITH {_mi(_LINES)}, {_PAIRS}"
_SWEEP = """
runs AS (SELECT score, sum(label) AS pos, count(*) AS n FROM scores GROUP BY score),
upto AS (SELECT score AS threshold, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, (SELECT sum(label) FROM scores) AS p, (SELECT count(*) FROM scores) AS n FROM runs WINDOW w AS (ORDER BY score DESC)),
rates AS (SELECT *, seen - tp AS fp, p - tp AS fn, n - seen - p + tp AS tn, CASE WHEN seen = 0 THEN 0 ELSE tp / seen END AS precision, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS recall FROM upto),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rates),
best AS (SELECT * FROM f ORDER BY f1 DESC, threshold DESC LIMIT 1)"""
_ERRORS = """
marked AS (
  SELECT s.*, CASE WHEN score >= threshold AND label = 1 THEN 'TP' WHEN score >= threshold THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN' END AS category
  FROM scores s, best),
ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN category IN ('TP', 'FP') THEN -score ELSE score END, ord)::INTEGER AS rank FROM marked)"""

_WINDOWS = """
win AS (
  SELECT doc_id, w[k] AS w0, w[k + 1] AS w1, w[k + 2] AS w2, w[k + 3] AS w3, 1 + doc_id % 7 AS cnt
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS k FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') AS w FROM documents)))"""
_RAW = _WINDOWS + """,
raw AS (
  SELECT w1 AS verb, CASE doc_id % 4 WHEN 1 THEN w2 WHEN 2 THEN 'with' END AS prep, w0 AS x, CASE WHEN doc_id % 4 IN (1, 2) THEN w3 ELSE w2 END AS y, cnt
  FROM win WHERE w1 NOT IN ('is', 'are', 'was', 'were', 'am', 'been', 'being', 'do', 'does', 'did', 'have', 'has', 'had')),
vocab AS (SELECT DISTINCT unnest([verb, x, y]) AS word FROM raw),
stems AS (""" + stem_sql("vocab") + """),
own AS (
  SELECT concat('X ', v.stem, CASE WHEN prep IS NULL THEN '' ELSE ' ' || prep END, ' Y') AS pid, unnest([{slot: 'X', word: a.stem}, {slot: 'Y', word: b.stem}]) AS s, cnt
  FROM raw JOIN stems v ON v.word = verb JOIN stems a ON a.word = x JOIN stems b ON b.word = y)"""

_TASKS = """
lines AS (SELECT concat('job-', page_id % 5) AS task_id, page_id, ['POS', 'CONSTITUENCY', 'DEPENDENCY', 'SENTIMENT'][page_id % 4 + 1] AS analysis, url FROM pages WHERE page_id % 10 NOT IN (3, 7)),
tasks AS (SELECT task_id, concat(task_id, ':', row_number() OVER (PARTITION BY task_id ORDER BY page_id) - 1) AS sub_task_id, analysis, trim(url) AS url FROM lines)"""
_RESULTS = """
results AS (
  SELECT concat('job-', user_id % 20) AS task_id, concat('job-', user_id % 20, ':', event_id % 7) AS sub_task_id, ts, event_id,
         CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
         CASE WHEN event_type <> 'error' THEN concat('results/', event_id, '.txt') END AS result,
         CASE WHEN event_type = 'error' THEN concat('<bad> & ', event_id) END AS error
  FROM events),
firsts AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY task_id, sub_task_id ORDER BY ts, event_id) = 1),
known AS (SELECT concat('job-', j) AS task_id, concat('job-', j, ':', n) AS sub_task_id, 'POS' AS analysis, concat('https://example.com/', n, '.txt') AS url FROM range(20) a(j), range(6) b(n)),
summary AS (SELECT task_id, sub_task_id, analysis, url, CASE WHEN status = 'FAILED' THEN concat('ERROR: ', error) ELSE result END AS output FROM known JOIN firsts USING (task_id, sub_task_id))"""

_LEASES = """
events_of_subtasks AS (
  SELECT *, row_number() OVER (PARTITION BY task_id, sub_task_id ORDER BY moment, seq) AS n FROM (
    SELECT concat('job-', user_id % 50) AS task_id, concat('job-', user_id % 50, ':', event_id % 3) AS sub_task_id, event_id AS seq, epoch_us(ts)::DOUBLE AS moment,
           CASE WHEN event_id % 5 = 0 THEN 'create' ELSE ['claim', 'renew', 'dispatch', 'claim', 'complete', 'renew', 'claim', 'result'][event_id % 8 + 1] END AS kind,
           concat('worker-', user_id % 2) AS actor, 3.6e9::DOUBLE AS lease, event_type <> 'error' AS success
    FROM events)),
leases AS (
  SELECT task_id, sub_task_id, 0::BIGINT AS n, 0::BIGINT AS seq, 0::DOUBLE AS moment, '' AS kind, '' AS outcome, '' AS status, '' AS owner, 0::DOUBLE AS expires, 0::BIGINT AS attempts
  FROM (SELECT DISTINCT task_id, sub_task_id FROM events_of_subtasks)
  UNION ALL
  SELECT task_id, sub_task_id, n, seq, moment, kind, outcome,
         CASE outcome WHEN 'CREATED' THEN 'PENDING' WHEN 'DISPATCHED' THEN 'DISPATCHED' WHEN 'CLAIMED' THEN 'PROCESSING' WHEN 'COMPLETED' THEN ended WHEN 'ACCEPTED' THEN ended ELSE status END,
         CASE outcome WHEN 'DISPATCHED' THEN '' WHEN 'CLAIMED' THEN actor ELSE owner END,
         CASE WHEN outcome = 'DISPATCHED' THEN 0 WHEN outcome IN ('CLAIMED', 'ALREADY_OWNED', 'RENEWED') THEN moment + lease ELSE expires END,
         attempts + CASE WHEN outcome IN ('DISPATCHED', 'CLAIMED') THEN 1 ELSE 0 END
  FROM (
    SELECT e.*, s.status, s.owner, s.expires, s.attempts, CASE WHEN e.success THEN 'SUCCEEDED' ELSE 'FAILED' END AS ended,
           CASE WHEN e.kind = 'create' THEN CASE WHEN s.status = '' THEN 'CREATED' ELSE 'EXISTS' END
                WHEN s.status = '' THEN CASE WHEN e.kind = 'result' THEN 'UNKNOWN_JOB_OR_SUBTASK' ELSE 'NOT_FOUND' END
                WHEN s.status IN ('SUCCEEDED', 'FAILED') THEN CASE WHEN e.kind = 'result' THEN 'DUPLICATE_OR_CONFLICT' ELSE 'ALREADY_TERMINAL' END
                WHEN e.kind = 'dispatch' THEN CASE WHEN s.status = 'PROCESSING' AND s.expires >= e.moment THEN 'REFUSED' ELSE 'DISPATCHED' END
                WHEN e.kind = 'claim' THEN CASE WHEN s.status <> 'PROCESSING' OR s.expires < e.moment THEN 'CLAIMED' WHEN s.owner = e.actor THEN 'ALREADY_OWNED' ELSE 'OWNED_BY_ANOTHER_WORKER' END
                WHEN e.kind = 'renew' THEN CASE WHEN s.status = 'PROCESSING' AND s.expires >= e.moment AND s.owner = e.actor THEN 'RENEWED' ELSE 'LOST_OWNERSHIP' END
                WHEN e.kind = 'result' THEN 'ACCEPTED'
                WHEN s.status = 'PROCESSING' AND s.owner = e.actor THEN 'COMPLETED' ELSE 'STALE_OWNER' END AS outcome
    FROM leases s JOIN events_of_subtasks e ON e.task_id = s.task_id AND e.sub_task_id = s.sub_task_id AND e.n = s.n + 1))"""
_JOBS = _LEASES + """,
events_of_jobs AS (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY moment, seq) AS n FROM (
    SELECT task_id, seq, moment, CASE outcome WHEN 'DISPATCHED' THEN 'sent' ELSE 'done' END AS kind, '' AS actor, 0::DOUBLE AS lease, 0::BIGINT AS expects
    FROM leases WHERE outcome IN ('DISPATCHED', 'COMPLETED', 'ACCEPTED')
    UNION ALL
    SELECT concat('job-', user_id % 50), event_id + 1099511627776, epoch_us(ts)::DOUBLE,
           CASE WHEN event_id % 7 = 0 THEN 'create' WHEN event_id % 501 = 0 THEN 'fail'
                ELSE ['lease', 'save', 'parsed', 'finalize', 'complete', 'notify', 'finalize', 'lease', 'complete', 'create', 'finalize'][event_id % 11 + 1] END,
           concat('manager-', user_id % 2), 3.6e9::DOUBLE, 2 + event_id % 2 FROM events)),
folded AS (
  SELECT task_id, 0::BIGINT AS n, 0::BIGINT AS seq, 0::DOUBLE AS moment, '' AS kind, '' AS outcome, '' AS status, '' AS owner, 0::DOUBLE AS expires, 0::DOUBLE AS created, false AS parsed,
         0::BIGINT AS expected, 0::BIGINT AS completed, 'NONE' AS notification
  FROM (SELECT DISTINCT task_id FROM events_of_jobs)
  UNION ALL
  SELECT task_id, n, seq, moment, kind, outcome,
         CASE outcome WHEN 'CREATED' THEN 'RECEIVED' WHEN 'SAVED' THEN 'DISPATCHING' WHEN 'PARSED' THEN 'RUNNING' WHEN 'NOTIFIED' THEN status WHEN 'COUNTED' THEN status
              WHEN 'LEASED' THEN status WHEN 'REFUSED' THEN status WHEN 'EXISTS' THEN status WHEN 'NOT_FOUND' THEN status ELSE outcome END,
         CASE WHEN outcome IN ('LEASED', 'FINALIZING') THEN actor ELSE owner END,
         CASE WHEN outcome IN ('LEASED', 'FINALIZING') THEN moment + lease ELSE expires END,
         CASE outcome WHEN 'CREATED' THEN moment ELSE created END,
         parsed OR outcome = 'PARSED',
         CASE outcome WHEN 'PARSED' THEN expects ELSE expected END,
         completed + CASE outcome WHEN 'COUNTED' THEN 1 ELSE 0 END,
         CASE outcome WHEN 'COMPLETED' THEN 'PENDING' WHEN 'NOTIFIED' THEN 'SENT' ELSE notification END
  FROM (
    SELECT e.*, j.status, j.owner, j.expires, j.created, j.parsed, j.expected, j.completed, j.notification,
           CASE WHEN e.kind = 'create' THEN CASE WHEN j.status = '' THEN 'CREATED' ELSE 'EXISTS' END
                WHEN j.status = '' THEN 'NOT_FOUND'
                WHEN e.kind = 'save' THEN 'SAVED' WHEN e.kind = 'parsed' THEN 'PARSED' WHEN e.kind = 'sent' THEN 'RUNNING' WHEN e.kind = 'done' THEN 'COUNTED' WHEN e.kind = 'fail' THEN 'FAILED'
                WHEN e.kind = 'lease' AND (trim(j.owner) = '' OR j.owner = e.actor OR j.expires < e.moment) THEN 'LEASED'
                WHEN e.kind = 'finalize' AND j.parsed AND ((j.status = 'RUNNING' AND j.completed = j.expected) OR (j.status = 'FINALIZING' AND j.expires < e.moment)) THEN 'FINALIZING'
                WHEN e.kind = 'complete' AND j.status = 'FINALIZING' AND j.owner = e.actor THEN 'COMPLETED'
                WHEN e.kind = 'notify' AND j.status = 'COMPLETED' THEN 'NOTIFIED' ELSE 'REFUSED' END AS outcome
    FROM folded j JOIN events_of_jobs e ON e.task_id = j.task_id AND e.n = j.n + 1)),
jobs AS (SELECT task_id, status, owner, expires, created, parsed, expected, completed, notification FROM folded WHERE status <> '' QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC) = 1),
open_jobs AS (SELECT * FROM jobs WHERE status IN ('RECEIVED', 'DISPATCHING', 'RUNNING', 'FINALIZING') OR (status = 'COMPLETED' AND notification = 'PENDING'))"""


def _escape(x: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{entity}')"
    return x


_ROW = f"""concat('<tr><td>', sub_task_id, '</td><td>', analysis, '</td><td><a href=''', url, ''' target=''_blank''>', url, '</a></td>',
  CASE WHEN starts_with(output, 'ERROR:') THEN concat('<td class=''error''>', {_escape("output")}, '</td>')
  ELSE concat('<td><a href=''https://reports.s3.us-east-1.amazonaws.com/', replace(output, '/', '%2F'), ''' target=''_blank''>View Output</a></td>') END, '</tr>')"""
_TAG = "CASE WHEN regexp_matches(w, '^[0-9][0-9.,]*$') THEN 'CD' WHEN regexp_matches(w, '^[A-Z]') THEN 'NNP' WHEN regexp_matches(w, 'ing$') THEN 'VBG' WHEN regexp_matches(w, 'ed$') THEN 'VBD' WHEN regexp_matches(w, 'ly$') THEN 'RB' ELSE 'NN' END"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[ \\t]+'), lambda v: v <> '')"


def _first_sentence(x: str) -> str:
    """Words up to the first that ends in a stop."""
    stop = f"list_position(list_transform({_words(x)}, lambda v: regexp_matches(v, '[.!?]$')), true)"
    return f"list_slice({_words(x)}, 1, CASE WHEN coalesce({stop}, 0) = 0 THEN len({_words(x)}) ELSE {stop} END)"


def _constituency(x: str) -> str:
    return f"concat('(ROOT (FRAG ', array_to_string(list_transform({_first_sentence(x)}, lambda w: concat('(', {_TAG}, ' ', w, ')')), ' '), '))')"


def _dependency(x: str) -> str:
    words = _first_sentence(x)
    head = f"CASE WHEN coalesce(list_position(list_transform({words}, lambda w: {_TAG} IN ('VBD', 'VBG')), true), 0) = 0 THEN 1 ELSE list_position(list_transform({words}, lambda w: {_TAG} IN ('VBD', 'VBG')), true) END"
    return f"""array_to_string(list_transform({words}, lambda w, i: CASE WHEN i = {head} THEN concat('root(ROOT-0, ', w, '-', i, ')') ELSE concat('dep(', list_extract({words}, {head}), '-', {head}, ', ', w, '-', i, ')') END), chr(10))"""


ORACLE_SQL: dict[str, str] = {
    "mi_events": _mi_query(_EVENTS),
    "mi_lineitem": _mi_query(_LINES),
    "mi_stored": _mi_query(_LINES),
    "triples_agg": f"SELECT pid, slot, word, sum(cnt)::BIGINT AS cnt FROM ({_EVENTS}) GROUP BY ALL",
    "slot_word_counts": f"SELECT slot, word, sum(cnt)::BIGINT AS c FROM ({_LINES}) GROUP BY ALL",
    "slot_totals": f"SELECT slot, sum(cnt)::BIGINT AS d FROM ({_EVENTS}) GROUP BY ALL",
    "path_slot_totals": f"SELECT pid, slot, sum(cnt)::BIGINT AS b FROM ({_LINES}) GROUP BY ALL",
    "mi_filtered": _mi_query(_LINES, "t.pid LIKE '% s3 %'"),
    "slot_sums": f"{_BASE} SELECT pid, slot, round(total, 6) AS total, words::BIGINT AS words FROM sums",
    "slot_similarity": f"{_BASE}, {_sims(_PLAIN)} SELECT p1, s1, p2, s2, round(sim, 6) AS sim, words1::BIGINT AS words1, words2::BIGINT AS words2, shared::BIGINT AS shared FROM sims",
    "path_similarity": f"{_BASE}, {_scores(_PLAIN)} SELECT * FROM scores",
    "path_similarity_roles": f"{_BASE}, {_scores()} SELECT * FROM scores",
    "path_similarity_max": f"{_BASE}, {_scores(best=True)} SELECT * FROM scores",
    "score_diagnostics": f"{_BASE}, {_scores()} SELECT label, count(*) AS n, count(*) FILTER (score = 0) AS zeros, min(score) AS low, max(score) AS high FROM scores GROUP BY label",
    "zero_breakdown": f"""{_BASE}, {_sims(_ROLES)},
x AS (SELECT * FROM sims WHERE align = 'XX'), y AS (SELECT * FROM sims WHERE align = 'YY')
SELECT count(*) AS zero_positives, count(*) FILTER (x.words1 = 0 AND y.words1 = 0) AS missing_1, count(*) FILTER (x.words2 = 0 AND y.words2 = 0) AS missing_2,
  count(*) FILTER (x.words1 = 0 OR x.words2 = 0) AS empty_x, count(*) FILTER (y.words1 = 0 OR y.words2 = 0) AS empty_y,
  count(*) FILTER (x.words1 > 0 AND x.words2 > 0 AND x.shared = 0) AS apart_x, count(*) FILTER (y.words1 > 0 AND y.words2 > 0 AND y.shared = 0) AS apart_y
FROM pairs p JOIN x ON x.ord = p.ord JOIN y ON y.ord = p.ord WHERE label = 1 AND x.sim * y.sim = 0""",
    "pr_curve": f"{_BASE}, {_scores()}, {_SWEEP} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM f",
    "best_threshold": f"{_BASE}, {_scores()}, {_SWEEP} SELECT threshold, round(f1, 6) AS f1, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn FROM best",
    "error_analysis": f"{_BASE}, {_scores()}, {_SWEEP}, {_ERRORS} SELECT category, rank, lhs, rhs, label, printf('%.6f', score) AS score FROM ranked WHERE rank <= 5",
    "error_analysis_compare": f"""{_BASE}, {_scores()}, {_scores(_PLAIN, name="earlier")}, {_SWEEP}, {_ERRORS}
SELECT category, rank, r.lhs, r.rhs, r.label, printf('%.6f', r.score) AS score, CASE WHEN e.score IS NULL THEN 'NA' ELSE printf('%.6f', e.score) END AS compare_score
FROM ranked r LEFT JOIN earlier e ON e.ord = r.ord WHERE rank <= 5""",
    "template_norm": f"{_BASE} SELECT template, pid, swapped, logical FROM norms",
    "path_whitelist": f"{_BASE} SELECT DISTINCT pid FROM norms",
    "stem_vocab": "WITH vocab AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+')) AS word FROM documents) " + stem_sql("vocab"),
    "ngram_tokens": f"""WITH {_WINDOWS},
tok AS (
  SELECT cnt, unnest(CASE doc_id % 4
    WHEN 0 THEN [(w0, 'NN', 'nsubj', 2), (w1, 'VBD', 'ROOT', 0), (w2, 'NN', 'dobj', 2)]
    WHEN 1 THEN [(w0, 'NN', 'nsubj', 2), (w1, 'VBD', 'ROOT', 0), (w2, 'IN', 'prep', 2), (w3, 'NN', 'pobj', 3)]
    WHEN 2 THEN [(w0, 'NN', 'nsubj', 2), (w1, 'VBD', 'ROOT', 0), (w3, 'NN', 'prep_with', 2)]
    ELSE [(w2, 'NN', 'dobj', 2), (w1, 'VBD', 'ROOT', 0), (w0, 'NN', 'nsubj', 2)] END) AS t
  FROM win)
SELECT t[1] AS word, t[2] AS pos, t[3] AS dep, t[4]::INTEGER AS parent, count(*) AS n, sum(cnt)::BIGINT AS cnt FROM tok GROUP BY ALL""",
    "tree_parents": f"WITH {_WINDOWS} SELECT CASE WHEN doc_id % 4 = 1 THEN '1,-1,1,2' ELSE '1,-1,1' END AS parents, count(*) AS n FROM win GROUP BY ALL",
    "token_lca": f"WITH {_WINDOWS} SELECT 0 AS i, CASE WHEN doc_id % 4 = 1 THEN 3 ELSE 2 END AS j, 1 AS lca, count(*) AS n FROM win GROUP BY ALL",
    "path_instances": f"WITH {_RAW} SELECT pid, s.slot AS slot, count(*) AS n, sum(cnt)::BIGINT AS cnt FROM own GROUP BY ALL",
    "triples_ngrams": f"WITH {_RAW} SELECT pid, s.slot AS slot, s.word AS word, sum(cnt)::BIGINT AS cnt FROM own GROUP BY ALL",
    "mi_ngrams": f"WITH {_RAW}, {_mi('SELECT pid, s.slot AS slot, s.word AS word, cnt FROM own')} SELECT pid, slot, word, round(mi, 6) AS mi, cnt FROM mi",
    "task_parse": f"WITH {_TASKS} SELECT * FROM tasks",
    "result_keys": f"""WITH {_TASKS},
safe AS (SELECT *, regexp_replace(sub_task_id, '[^A-Za-z0-9._-]', '_', 'g') AS sub FROM tasks)
SELECT task_id, sub_task_id,
  concat('results/', task_id, '/', sub, '_', analysis, '_', printf('%x', list_reduce(list_prepend(0::BIGINT, list_transform(string_split(url, ''), lambda c: ord(c)::BIGINT)), lambda h, b: (h * 31 + b) & 4294967295)), '.txt') AS result_key,
  concat(sub, '_inputfile') AS input_file, concat(sub, '_output.txt') AS output_file FROM safe""",
    "html_escape": f"SELECT page_id, {_escape('coalesce(html, ' + chr(39) * 2 + ')')} AS escaped FROM pages",
    "link_check": """SELECT page_id, link, regexp_matches(link, '^(?i:https?):[^ ]*$') AS safe FROM (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('javascript:alert(', page_id, ')') WHEN 1 THEN concat('https://example .com/', page_id) ELSE url END AS link FROM pages)""",
    "first_terminal_result": f"WITH {_RESULTS} SELECT task_id, sub_task_id, event_id, status, result, error FROM firsts",
    "unknown_results": f"WITH {_RESULTS} SELECT task_id, sub_task_id, event_id FROM results WHERE sub_task_id NOT IN (SELECT sub_task_id FROM known)",
    "job_progress": f"""WITH {_RESULTS} SELECT task_id, count(*) AS expected, count(status) AS completed, count(*) FILTER (status = 'FAILED') AS failed, count(*) = count(status) AS complete
FROM known LEFT JOIN firsts USING (task_id, sub_task_id) GROUP BY task_id""",
    "summary_rows": f"WITH {_RESULTS} SELECT * FROM summary",
    "html_report": f"""WITH {_RESULTS} SELECT task_id, concat('reports/', task_id, '/summary.html') AS report_key,
  concat('<html><head><title>Task ', task_id, ' - Analysis Summary</title><style>{_STYLE}</style></head><body><h1>Results for Task: ', task_id,
    '</h1><table><tr><th>Subtask</th><th>Analysis Type</th><th>Input File</th><th>Output / Error</th></tr>', string_agg({_ROW}, '' ORDER BY sub_task_id), '</table></body></html>') AS html
FROM summary GROUP BY task_id""",
    "line_analysis": f"""SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: regexp_matches(x, '[^ \\t\\x0B\\f\\x1c-\\x1f]')),
  lambda x: concat('INPUT: ', x, chr(10), 'OUTPUT: ', CASE doc_id % 4 WHEN 0 THEN array_to_string(list_transform({_words("x")}, lambda w: concat(w, ' (', {_TAG}, ') ')), '')
    WHEN 1 THEN {_constituency("x")} WHEN 2 THEN {_dependency("x")} ELSE 'Unknown analysis type: SENTIMENT' END, chr(10), chr(10))), '') AS output
FROM documents""",
    "fetched_documents": f"""WITH {_TASKS}, held AS (SELECT url, max(html) AS text FROM pages WHERE url IS NOT NULL GROUP BY url)
SELECT task_id, sub_task_id, t.url AS url, text, CASE WHEN text IS NULL THEN concat('Failed to download file from URL: ', t.url) END AS error FROM tasks t LEFT JOIN held h ON h.url = t.url""",
    "triples_round_trip": f"SELECT pid, slot, word, sum(cnt)::BIGINT AS cnt FROM ({_LINES}) GROUP BY ALL",
    "mi_round_trip": f"WITH {_mi(_EVENTS)} SELECT pid, slot, word, round(mi, 6) AS mi, round(sum(2 * round(mi, 6)) OVER (PARTITION BY pid, slot), 6) AS total FROM mi",
    "pairs_round_trip": f"""{_BASE}
SELECT (row_number() OVER (PARTITION BY label ORDER BY p.ord) - 1 + CASE label WHEN 1 THEN 0 ELSE 1099511627776 END)::BIGINT AS ord, lhs, rhs, label, lhs IN (SELECT pid FROM norms) AS listed FROM pairs p""",
    "scores_round_trip": f"{_BASE}, {_scores()} SELECT lhs, rhs, label, score FROM scores",
    "tasks_round_trip": """SELECT 'all' AS task_id, concat('all:', row_number() OVER (ORDER BY page_id) - 1) AS sub_task_id, ['POS', 'CONSTITUENCY', 'DEPENDENCY', 'SENTIMENT'][page_id % 4 + 1] AS analysis, trim(url) AS url
FROM pages WHERE page_id % 10 NOT IN (3, 7)""",
    "worker_messages": """SELECT CASE WHEN k < 4 THEN concat('job-', user_id % 20) END AS task_id, CASE WHEN k < 3 THEN concat('s', event_id % 7) END AS sub_task_id, CASE WHEN k = 1 THEN 'FAILED' WHEN k < 3 THEN 'SUCCEEDED' END AS status,
  CASE WHEN k IN (0, 1, 3) THEN 'POS' ELSE '' END AS analysis, CASE WHEN k IN (0, 1, 3) THEN 'https://x.org/a' ELSE '' END AS url, CASE WHEN k IN (0, 2, 3) THEN concat('results/', event_id) ELSE '' END AS result,
  CASE WHEN k = 1 THEN concat('"bad" ', event_id) ELSE '' END AS error, k < 3 AS parsed FROM (SELECT *, event_id % 5 AS k FROM events)""",
    "job_requests": """WITH r AS (SELECT CASE WHEN event_id % 11 = 5 THEN '  ' ELSE concat('t', event_id) END AS id, event_id % 9 <> 4 AND event_id % 11 <> 5 AS good, event_id AS n FROM events)
SELECT id AS "taskId", concat('in/', n) AS key, (n % 4)::INTEGER AS workers, n % 3 = 0 AS terminate, good AND NOT s AS accepted, CASE WHEN good AND s THEN concat('Unable to receive task ', id, chr(10), 'Manager will be terminating soon...') END AS blocked, s AS shutdown
FROM r, (VALUES (true), (false)) v(s)""",
    "worker_actions": """WITH m AS (
  SELECT event_id % 13 <> 0 AS parsed, ['CLAIMED', 'ALREADY_OWNED', 'CLAIMED', 'OWNED_BY_ANOTHER_WORKER', 'ALREADY_TERMINAL', 'CLAIMED', 'NOT_FOUND', NULL][event_id % 8 + 1] AS claim, user_id % 6 = 0 AS lost,
         ['COMPLETED', 'COMPLETED', 'STALE_OWNER', 'ALREADY_TERMINAL', 'NOT_FOUND', NULL][event_id // 8 % 6 + 1] AS completion, event_type <> 'error' AS success FROM events)
SELECT CASE WHEN NOT parsed OR coalesce(claim, 'NOT_FOUND') = 'NOT_FOUND' THEN 'keep' WHEN claim = 'OWNED_BY_ANOTHER_WORKER' THEN 'delay' WHEN claim = 'ALREADY_TERMINAL' THEN 'delete'
  WHEN lost OR coalesce(completion, 'NOT_FOUND') IN ('NOT_FOUND', 'STALE_OWNER') THEN 'keep' WHEN completion = 'ALREADY_TERMINAL' THEN 'delete' WHEN success THEN 'report success, delete' ELSE 'report failure, delete' END AS action, count(*) AS n
FROM m GROUP BY 1""",
    "workers_needed": f"WITH {_TASKS} SELECT task_id, count(*) AS tasks, greatest(0, least(ceil(count(*) / 30), 7) - 1)::BIGINT AS workers FROM tasks GROUP BY task_id",
    "stream_first_results": f"WITH {_RESULTS} SELECT task_id, sub_task_id, event_id, status, result, error FROM firsts",
    "stream_lease_outcomes": f"WITH RECURSIVE {_LEASES} SELECT kind, outcome, count(*) AS n FROM leases WHERE n > 0 GROUP BY ALL",
    "dispatch_plan": """WITH s AS (
  SELECT concat('job-', user_id % 20) AS task_id, concat('job-', user_id % 20, ':', event_id) AS sub_task_id, event_id % 5 AS k, ts, (SELECT max(ts) - INTERVAL 6 HOUR FROM events) AS now FROM events)
SELECT task_id, sub_task_id, CASE k WHEN 0 THEN 'pending' WHEN 1 THEN 'stale' ELSE 'expired' END AS reason FROM s
WHERE k = 0 OR (k = 1 AND ts < now - INTERVAL 300 SECOND) OR (k = 2 AND ts + INTERVAL 1 HOUR < now)""",
    "lease_fold": f"WITH RECURSIVE {_LEASES} SELECT task_id, sub_task_id, seq, kind, outcome, status, owner, attempts FROM leases WHERE n > 0",
    "lease_outcomes": f"WITH RECURSIVE {_LEASES} SELECT kind, outcome, count(*) AS n FROM leases WHERE n > 0 GROUP BY ALL",
    "job_fold": f"WITH RECURSIVE {_JOBS} SELECT task_id, seq, kind, outcome, status, owner, expires, created, parsed, expected, completed, notification FROM folded WHERE n > 0",
    "recoverable_jobs": f"WITH RECURSIVE {_JOBS} SELECT * FROM open_jobs",
    "recovery_sweep": f"""WITH RECURSIVE {_JOBS}, now AS (SELECT max(epoch_us(ts))::DOUBLE AS now FROM events)
SELECT task_id, created, CASE WHEN status = 'FINALIZING' THEN 'finalize' WHEN status = 'COMPLETED' THEN 'notify' WHEN trim(owner) <> '' AND owner <> 'manager-0' AND expires >= now THEN 'skip' WHEN NOT parsed THEN 'parse, dispatch' ELSE 'dispatch' END AS action,
  parsed AND completed = expected AND (status = 'RUNNING' OR (status = 'FINALIZING' AND expires < now)) AS ready
FROM open_jobs, now""",
}
ORACLE_SQL["reports_round_trip"] = ORACLE_SQL["html_report"].replace("SELECT task_id, concat('reports/'", "SELECT concat('reports/'", 1)
ORACLE_SQL["stream_reports"] = ORACLE_SQL["html_report"].replace("FROM summary GROUP BY task_id", "FROM summary GROUP BY task_id HAVING count(*) = (SELECT count(*) FROM known k WHERE k.task_id = summary.task_id)")
