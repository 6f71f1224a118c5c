"""SQL counterparts of the registered queries, for the side-by-side check."""

from __future__ import annotations

import sparkmem as sm

from .oracle_inputs import ACCESSES, MEMORIES, NOTES, NOW, PROMPTS, REPLIES, ROUNDS, owner

GUIDE = sm.ContextOptions().guide.replace("'", "''")
BUDGET = sm.ContextOptions().budget
CUT = "'...(对话过长已截断)'"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def eff(base="base_importance", access="access_count", created="created_at") -> str:
    adj = f"least(1e0, greatest({base}, 0.01e0) * (1e0 + 0.05e0 * ln(1 + coalesce({access}, 0))))"
    days = f"greatest(0e0, coalesce(date_diff('second', {created}, {NOW}) / 86400e0, 0e0))"
    return f"round(least(1e0, {adj} * exp(-({days}) / greatest(30e0 * {adj}, 0.001e0))), 4)"


STORED = "coalesce(nullif(base_importance, 0), importance, 0.5e0)"


def stamp(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def joined(c):
    return f"coalesce(array_to_string({c}, '|'), '')"


def strip(c):
    return f"regexp_replace({c}, '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g')"


def fixed(x, n):
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(18,10)), {n}) AS DECIMAL(18,{n})) AS VARCHAR)"


def flat(rel, **over):
    cols = {
        "id": "id", "user_id": "user_id", "content": "content", "topics": joined("topics"),
        "key_facts": joined("key_facts"), "importance": "round(importance, 4)",
        "base_importance": "round(base_importance, 4)", "sentiment": "sentiment", "source": "source",
        "tier": "tier", "access_count": "access_count", "last_accessed": stamp("last_accessed"),
        "created_at": stamp("created_at"), "session_id": "session_id", "parent_ids": joined("parent_ids"),
        "merge_count": "merge_count",
    }
    cols.update(over)
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + f" FROM {rel}"


def line(created="created_at", imp="importance", base="base_importance"):
    return (
        f"'create=' || strftime({created}, '%Y-%m-%dT%H:%M:%S') || ', imp=' || {fixed(f'coalesce({imp}, 0.5)', 4)}"
        f" || ', access_count=' || coalesce(access_count, 0) || ', base=' || "
        f"{fixed(f'coalesce({base}, {imp}, 0.5)', 4)} || ' ' || coalesce(content, '')"
    )


def dot(a, b):
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def letters(c):
    """Counts of the letters a to h at unit length, in the precision of a float."""
    counts = "[" + ", ".join(f"CAST(length(s) - length(replace(s, '{x}', '')) AS DOUBLE)" for x in "abcdefgh") + "]"
    return f"""(SELECT CAST(list_transform(l, lambda x: x / CASE WHEN list_dot_product(l, l) > 0 THEN sqrt(list_dot_product(l, l)) ELSE 1 END) AS FLOAT[])
    FROM (SELECT {counts} AS l FROM (SELECT lower(coalesce({c}, '')) AS s)))"""


def nearest(k, where="TRUE", floor=None, name="near"):
    q, m = "q.q_embedding", "m.embedding"
    cos = f"round({dot(q, m)} / (sqrt({dot(q, q)}) * sqrt({dot(m, m)})), 10)"
    bar = "" if floor is None else f" WHERE cosine >= {floor}"
    return f"""pairs AS (
  SELECT q.query_id, m.*, {cos} AS cosine
  FROM prompts q JOIN memories m ON q.user_id = m.user_id WHERE m.embedding IS NOT NULL AND ({where})),
{name} AS (
  SELECT *, 1 - cosine AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM pairs{bar}) x
  WHERE rank <= {k})"""


HITS = "SELECT query_id, user_id, id, cosine, round(distance, 10) AS distance, rank FROM "


def recalled(min_score, min_cosine):
    return nearest(20, floor=min_cosine) + f""",
scored AS (SELECT *, 0.6e0 * cosine + 0.4e0 * effective AS score FROM (
  SELECT *, {eff("coalesce(base_importance, 0.5)")} AS effective FROM near) x),
hits AS (SELECT * EXCLUDE (rank, place), place AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cosine DESC, id) AS place
  FROM scored WHERE score >= {min_score} AND cosine >= {min_cosine}) x WHERE place <= 5)"""


LOW = recalled(0.2, 0.2)
RECALL_OUT = """SELECT query_id, user_id, id, content, rank, round(cosine, 6) AS cosine, effective,
  round(score, 6) AS score FROM hits"""

SUFFIX = {"month": "-01", "year": "-01-01"}
FORMAT = {"month": "%Y-%m", "year": "%Y"}


def sid(rule, rel, first):
    return f"'mem-' || substr(sha256('settle' || chr(31) || {rel}.user_id || chr(31) || '{rule.target_tier}' || chr(31) || {rel}.period || chr(31) || {first}), 1, 32)"


def settle(rule: sm.SettleRule, src: str, p: str, archive: str | None = None) -> str:
    """CTEs that settle relation src by rule: {p}_hot, {p}_archived, {p}_groups, …; with an archive, summaries are rebuilt from it where planned."""
    rebuilt = f"""{p}_rebuilt AS (
  SELECT t.user_id, t.period, t.id FROM {p}_target t JOIN {p}_groups g USING (user_id, period)
  WHERE ((SELECT count(*) FROM {archive} a WHERE a.merged_into = t.id) + g.n_low >= 10 OR coalesce(t.merge_count, 0) >= 3)
    AND EXISTS (SELECT 1 FROM {archive} a WHERE a.merged_into = t.id AND {sid(rule, "t", "a.id")} = t.id)),
""" if archive else f"{p}_rebuilt AS (SELECT user_id, period, id FROM {p}_target WHERE FALSE),\n"
    again = f"""
  UNION ALL
  SELECT a.user_id, r.period, 1, a.created_at, a.id, a.content, a.topics, a.key_facts, coalesce(nullif(a.base_importance, 0), a.importance, 0.5e0), a.sentiment
  FROM {archive} a JOIN {p}_rebuilt r ON a.merged_into = r.id""" if archive else ""
    adopted = (
        f"OR (tier IS NULL AND user_id NOT IN (SELECT user_id FROM {src} WHERE tier = '{rule.source_tier}'))"
        if rule.adopt_untiered else ""
    )
    cols = "id, user_id, content, topics, key_facts, importance, base_importance, sentiment, source, tier, access_count, last_accessed, created_at, session_id, parent_ids, merge_count"
    return f"""{p}_members AS (
  SELECT * REPLACE ({eff(STORED)} AS importance, '{rule.source_tier}' AS tier), {STORED} AS base,
    strftime(created_at, '{FORMAT[rule.period]}') AS period
  FROM {src} WHERE tier = '{rule.source_tier}' {adopted}),
{p}_groups AS (
  SELECT user_id, period, count(*) FILTER (WHERE importance < {rule.threshold}) AS n_low, count(*) AS n_members
  FROM {p}_members GROUP BY user_id, period HAVING count(*) FILTER (WHERE importance < {rule.threshold}) >= {rule.min_members}),
{p}_low AS (
  SELECT m.* FROM {p}_members m JOIN {p}_groups g USING (user_id, period) WHERE importance < {rule.threshold}),
{p}_target AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT t.*, g.period, row_number() OVER (PARTITION BY t.user_id, g.period ORDER BY t.created_at, t.id) AS rn
    FROM {src} t JOIN {p}_groups g ON t.user_id = g.user_id AND strftime(t.created_at, '{FORMAT[rule.period]}') = g.period
    WHERE t.tier = '{rule.target_tier}') x WHERE rn = 1),
{rebuilt}{p}_parts AS (
  SELECT user_id, period, 1 AS ord, created_at, id, content, topics, key_facts, base, sentiment FROM {p}_low
  UNION ALL
  SELECT user_id, period, 0, created_at, id, content, topics, key_facts, coalesce(base_importance, 0.5), sentiment FROM {p}_target
  WHERE id NOT IN (SELECT id FROM {p}_rebuilt){again}),
{merge_ctes(p)},
{p}_merged AS (
  SELECT coalesce(t.id, {sid(rule, "r", "l.ids[1]")}) AS id, r.user_id, r.summary AS content,
    r.topics, r.key_facts, r.importance, r.importance AS base_importance, r.sentiment, 'settlement' AS source,
    '{rule.target_tier}' AS tier, 0 AS access_count, {NOW} AS last_accessed,
    CAST(r.period || '{SUFFIX[rule.period]}' AS TIMESTAMP) AS created_at, 'settle-' || r.period AS session_id,
    t.parent_ids AS parent_ids,
    CASE WHEN t.id IN (SELECT id FROM {p}_rebuilt) THEN 1 ELSE coalesce(t.merge_count, 0) + 1 END AS merge_count
  FROM {p}_reduced r LEFT JOIN {p}_target t ON r.user_id = t.user_id AND r.period = t.period
  JOIN (SELECT user_id, period, list(id ORDER BY id) AS ids FROM {p}_low GROUP BY user_id, period) l
    ON r.user_id = l.user_id AND r.period = l.period),
{p}_hot AS (
  SELECT {cols} FROM {p}_members WHERE id NOT IN (SELECT id FROM {p}_low)
  UNION ALL
  SELECT {cols} FROM {src} WHERE id NOT IN (SELECT id FROM {p}_members) AND id NOT IN (SELECT id FROM {p}_target)
  UNION ALL SELECT {cols} FROM {p}_merged),
{p}_archived AS (
  SELECT l.*, coalesce(t.id, {sid(rule, "l", "min(l.id) OVER (PARTITION BY l.user_id, l.period)")}) AS merged_into, {NOW} AS archived_at
  FROM {p}_low l LEFT JOIN {p}_target t ON l.user_id = t.user_id AND l.period = t.period)"""


def merge_ctes(p):
    def listed(column):
        return f"""{p}_{column} AS (
  SELECT user_id, period, list(item ORDER BY ord, created_at, id, pos) AS {column} FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, period ORDER BY ord, created_at, id, pos) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, period, item ORDER BY ord, created_at, id, pos) AS rn FROM (
        SELECT user_id, period, ord, created_at, id, unnest({column}) AS item, generate_subscripts({column}, 1) AS pos
        FROM {p}_parts) a) b WHERE rn = 1) c WHERE n <= 5 GROUP BY user_id, period)"""

    numbered = f"(SELECT user_id, period, 0 AS message, content, row_number() OVER (PARTITION BY user_id, period ORDER BY ord, created_at, id) AS place FROM {p}_parts) b"
    return f"""{salient(numbered, "user_id, period", "place", p, 8000)},
{p}_text AS (
  SELECT user_id, period, string_agg(line, chr(10) ORDER BY place) AS summary FROM (
    SELECT user_id, period, place, string_agg(s, ' ' ORDER BY i) AS line FROM {p}_kept GROUP BY user_id, period, place) x GROUP BY user_id, period),
{p}_stats AS (
  SELECT user_id, period, CAST(round(CAST(CAST(sum(CAST(base AS DECIMAL(18,8))) AS DOUBLE) / count(*) AS DECIMAL(18,10)), 4) AS DOUBLE) AS importance
  FROM {p}_parts GROUP BY user_id, period),
{p}_feel AS (
  SELECT user_id, period, sentiment FROM (
    SELECT user_id, period, coalesce(sentiment, 'neutral') AS sentiment,
      row_number() OVER (PARTITION BY user_id, period ORDER BY count(*) DESC, coalesce(sentiment, 'neutral')) AS rn
    FROM {p}_parts GROUP BY user_id, period, coalesce(sentiment, 'neutral')) x WHERE rn = 1),
{listed("topics")},
{listed("key_facts")},
{p}_reduced AS (
  SELECT user_id, period, coalesce(summary, '') AS summary, topics, key_facts, sentiment, importance
  FROM {p}_stats LEFT JOIN {p}_text USING (user_id, period) JOIN {p}_feel USING (user_id, period)
  LEFT JOIN {p}_topics USING (user_id, period) LEFT JOIN {p}_key_facts USING (user_id, period))"""


def batches(every):
    size = f"least({every}, n - batch_no * {every})"
    return f"""batches AS (
  SELECT *, CAST({size} AS INTEGER) AS batch_size, {size} < {every} AS flush,
    'batch-' || substr(sha256(user_id || chr(31) || conv_id || chr(31) || batch_no || chr(31)
      || first_value(round_id) OVER b || chr(31) || last_value(round_id) OVER b), 1, 32) AS batch_id
  FROM (SELECT *, (round - 1) // {every} AS batch_no FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, conv_id ORDER BY ts, round_id) AS round,
      count(*) OVER (PARTITION BY user_id, conv_id) AS n FROM rounds) x) y
  WINDOW b AS (PARTITION BY user_id, conv_id, batch_no ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def conv_line(label, c):
    said = strip(f"replace({c}, chr(10), ' ')")
    return (
        f"CASE WHEN {said} <> '' THEN '[{label} | ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] - ' || {said} END"
    )


TEXTS = f"""texts AS (
  SELECT batch_id, user_id, conv_id, batch_no, batch_size, first_ts,
    CASE WHEN length(t) > 8000 THEN substr(t, 1, 8000) || chr(10) || {CUT} ELSE t END AS text FROM (
    SELECT batch_id, user_id, conv_id, batch_no, batch_size, min(ts) AS first_ts,
      coalesce(string_agg(nullif(concat_ws(chr(10), {conv_line("user", "user_text")}, {conv_line("assistant", "assistant_text")}), ''),
        chr(10) ORDER BY round), '') AS t
    FROM batches GROUP BY ALL) x)"""


SENTENCE = r"[^.!?\n]{1,200}(?:[.!?]{1,20}|[ \n]|\z)|[^.!?\n]{1,200}"
BLANK = "' ' || chr(9) || chr(13) || chr(10)"


def salient(src, keys, place, p, budget):
    """CTEs {p}_sentences(keys, place, i, s), {p}_counted (keys, word, n, key) and {p}_kept: the sentences that say most, from src(keys, place, message, content)."""
    return f"""{p}_found AS (
  SELECT {keys}, {place} AS place, message, unnest(f) AS s, generate_subscripts(f, 1) AS j FROM (
    SELECT *, regexp_extract_all(regexp_replace(content, '[。！？]+', '\\0' || chr(10), 'g'), '{SENTENCE}') AS f FROM {src}) c),
{p}_sentences AS (
  SELECT {keys}, place, trim(s, {BLANK}) AS s, row_number() OVER (PARTITION BY {keys} ORDER BY place, message, j) AS i
  FROM {p}_found WHERE trim(s, {BLANK}) <> ''),
{p}_spoken AS (
  SELECT {keys}, i, unnest(regexp_extract_all(lower(s), '\\p{{L}}{{2,}}')) AS word FROM {p}_sentences),
{p}_counted AS (SELECT {keys}, word, count(*) AS n, min(i) AS i FROM {p}_spoken GROUP BY {keys}, word),
{p}_worth AS (
  SELECT {keys}, i, sum(length(bin(n))) AS score FROM {p}_counted GROUP BY {keys}, i),
{p}_kept AS (
  SELECT * FROM (
    SELECT *, sum(length(s) + 1) OVER (PARTITION BY {keys} ORDER BY coalesce(score, 0) DESC, i) AS through
    FROM {p}_sentences LEFT JOIN {p}_worth USING ({keys}, i)) a WHERE through <= {budget} + 1)"""


def extractive(src, p="x"):
    """CTE {p}_reply(batch_id, summary, topics, key_facts) from src(batch_id, text)."""
    return f"""{p}_lines AS (
  SELECT batch_id, l, i, starts_with(l, '[user | ') AS spoken FROM (
    SELECT batch_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM {src}) a WHERE trim(l) <> ''),
{p}_said AS (
  SELECT batch_id, i, CASE WHEN spoken THEN substr(l, strpos(l, '] - ') + 4) ELSE l END AS m FROM (
    SELECT *, bool_or(spoken) OVER (PARTITION BY batch_id) AS talk FROM {p}_lines) a WHERE spoken OR NOT talk),
{p}_first AS (
  SELECT batch_id, i, regexp_extract(m, '^[^.!?。！？]*[.!?。！？]?') AS s,
    row_number() OVER (PARTITION BY batch_id ORDER BY i) AS n FROM {p}_said),
{salient(f"(SELECT batch_id, i AS message, m AS content FROM {p}_said) b", "batch_id", "0", p, 500)},
{p}_topics AS (
  SELECT batch_id, list(word ORDER BY n DESC, word) AS topics FROM (
    SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, word) AS rn FROM {p}_counted WHERE length(word) >= 4) a
  WHERE rn <= 5 GROUP BY batch_id),
{p}_shown AS (SELECT batch_id, string_agg(s, ' ' ORDER BY i) AS summary FROM {p}_kept GROUP BY batch_id),
{p}_reply AS (
  SELECT s.batch_id, coalesce(any_value(k.summary), '') AS summary,
    coalesce(any_value(t.topics), []) AS topics,
    coalesce(list(f.s ORDER BY f.n) FILTER (WHERE f.n <= 5), []) AS key_facts
  FROM {src} s LEFT JOIN {p}_first f USING (batch_id) LEFT JOIN {p}_shown k USING (batch_id) LEFT JOIN {p}_topics t USING (batch_id) GROUP BY s.batch_id)"""


def remembered(src, session, source, p="x", name="remembered"):
    return f"""{name} AS (
  SELECT 'mem-' || substr(sha256(batch_id), 1, 32) AS id, s.user_id, summary AS content, topics, key_facts,
    0.5e0 AS importance, 0.5e0 AS base_importance, 'neutral' AS sentiment, '{source}' AS source, 'daily' AS tier,
    0 AS access_count, {NOW} AS last_accessed, {NOW} AS created_at, {session} AS session_id,
    CAST(NULL AS VARCHAR[]) AS parent_ids, CAST(NULL AS INTEGER) AS merge_count
  FROM {p}_reply JOIN {src} s USING (batch_id))"""


SUMMARIES = ",\n".join([
    ROUNDS, batches(2), TEXTS,
    "ready AS (SELECT * FROM texts WHERE batch_size >= 2)",
    extractive("ready"),
    remembered("ready", "'session-' || strftime(first_ts, '%Y-%m-%d') || '-' || substr(sha256(batch_id), 1, 8)", "auto_summary"),
])

KEPT_NOTES = """kept AS (
  SELECT * FROM notes WHERE file_name NOT IN ('note3.md', 'note7.md')
    AND NOT contains(lower(content), lower('THE OF')) AND NOT contains(lower(content), lower('eaux la')))"""


def chunked(src):
    """CTE chunks(user_id, file_name, pos, chunk): greedy packing, one piece per step of the recursion."""
    return f"""paragraphs AS (
  SELECT user_id, file_name, unnest(string_split(content, chr(10) || chr(10))) AS par,
    generate_subscripts(string_split(content, chr(10) || chr(10)), 1) AS i FROM {src}),
pieces AS (
  SELECT user_id, file_name, piece, row_number() OVER (PARTITION BY file_name ORDER BY i, j) AS n FROM (
    SELECT user_id, file_name, i, par AS piece, 1 AS j FROM paragraphs WHERE length(par) <= 2000
    UNION ALL
    SELECT user_id, file_name, i, unnest(string_split(replace(par, '. ', '.' || chr(10)), chr(10))),
      generate_subscripts(string_split(replace(par, '. ', '.' || chr(10)), chr(10)), 1)
    FROM paragraphs WHERE length(par) > 2000) x),
walk AS (
  SELECT file_name, n, length(piece) AS size, 0 AS pos FROM pieces WHERE n = 1
  UNION ALL
  SELECT p.file_name, p.n, CASE WHEN w.size + length(p.piece) > 2000 THEN length(p.piece) ELSE w.size + length(p.piece) END,
    CASE WHEN w.size + length(p.piece) > 2000 THEN w.pos + 1 ELSE w.pos END
  FROM walk w JOIN pieces p ON p.file_name = w.file_name AND p.n = w.n + 1),
chunks AS (
  SELECT user_id, file_name, CAST(pos AS INTEGER) AS pos, string_agg(piece, chr(10) || chr(10) ORDER BY n) AS chunk
  FROM walk JOIN pieces USING (file_name, n) GROUP BY user_id, file_name, pos)"""


def with_recursive(*ctes):
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


IMPORTABLE = f"""importable AS (
  SELECT user_id, file_name, pos, chunk AS text,
    'note-' || substr(sha256(user_id || chr(31) || file_name || chr(31) || pos), 1, 32) AS batch_id
  FROM chunks WHERE length({strip("chunk")}) >= 50)"""

INGESTED = (NOTES, KEPT_NOTES, chunked("kept"), IMPORTABLE)
INGESTED_ROWS = (*INGESTED, extractive("importable"), remembered(
    "importable", f"'manual-2024-07-01-' || substr(sha256(batch_id), 1, 8)", "manual"))

PARSED = REPLIES + """,
parsed AS (
  SELECT doc_id, raw, t,
    CASE WHEN doc_id % 8 IN (0, 3, 4, 5, 6) OR (doc_id % 8 = 7 AND json_valid(raw)) THEN 'json'
         WHEN doc_id % 8 = 1 THEN 'fenced' ELSE 'loose' END AS route,
    CASE doc_id % 8 WHEN 3 THEN 'not an object' WHEN 4 THEN 'topics not a list'
      WHEN 5 THEN 'importance out of range' END AS problem,
    CASE WHEN doc_id % 8 IN (0, 1, 4, 5, 6) OR (doc_id % 8 = 2 AND t <> '') THEN t ELSE 'Conversation record' END AS summary,
    CASE doc_id % 8 WHEN 0 THEN 'a|b|c|d|e' WHEN 2 THEN 'x|y z' WHEN 7 THEN 'general' ELSE '' END AS topics,
    CASE doc_id % 8 WHEN 1 THEN 'k' ELSE '' END AS key_facts,
    CASE doc_id % 8 WHEN 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
    CASE doc_id % 8 WHEN 0 THEN 0.7e0 WHEN 2 THEN 0.3e0 WHEN 6 THEN 0.25e0 ELSE 0.5e0 END AS importance
  FROM replies)"""


def packed(src, n=None):
    rows = src if n is None else f"(SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) <= {n})"
    return f"""listing AS (
  SELECT user_id, id, created_at, {strip(line())} AS line FROM {rows} z),
summed AS (
  SELECT *, row_number() OVER w AS n, sum(length(line) + 2) OVER (w ROWS UNBOUNDED PRECEDING) AS through
  FROM listing WINDOW w AS (PARTITION BY user_id ORDER BY created_at DESC, id)),
fitted AS (
  SELECT user_id, n, CASE WHEN length(line) > {BUDGET} THEN regexp_replace(substr(line, 1, {BUDGET}), '\\s+$', '') ELSE line END AS line
  FROM summed WHERE through <= {BUDGET + 2} OR n = 1)"""


PACK_OUT = f"""SELECT user_id, count(*) AS memories,
  string_agg(line, chr(10) || chr(10) ORDER BY n DESC) || chr(10) || chr(10) || '{GUIDE}' AS context
FROM fitted GROUP BY user_id"""

DAY, MON = sm.DAILY_TO_MONTHLY, sm.MONTHLY_TO_YEARLY
ARCHIVE_OUT = "SELECT id, user_id, period, tier, merged_into, round(importance, 4) AS importance, " + stamp("archived_at") + " AS archived_at FROM "
ENDED = with_(
    MEMORIES, SUMMARIES,
    "started AS (SELECT * EXCLUDE (embedding, lang, source_tag, doc_id) FROM memories UNION ALL BY NAME SELECT * FROM remembered)",
    f"decayed AS (SELECT * REPLACE ({eff(STORED)} AS importance) FROM started)",
    settle(DAY, "decayed", "d"), settle(MON, "d_hot", "y"),
)
TALLY = "tally AS (SELECT id, count(*) AS hits, max(hit_at) AS last_hit FROM accesses GROUP BY id)"

ORACLES = {
    "memories_table": with_(MEMORIES) + flat("memories"),
    "rounds_log": with_(ROUNDS) + f"SELECT user_id, conv_id, round_id, user_text, {strip('assistant_text')} AS assistant_text, {stamp('ts')} AS ts FROM rounds",
    "archive_files": with_(MEMORIES, settle(DAY, "memories", "d")) + """SELECT id, content, merged_into, session_id,
  'tier=' || tier || '/period=' || period AS folder FROM d_archived""",
    "summarize_with_model": with_(ROUNDS, batches(2), TEXTS) + """SELECT 'mem-' || substr(sha256(batch_id), 1, 32) AS id,
  md5(text) || ' ' || length(text) AS content, 'm' AS topics, 0.75e0 AS importance,
  round(CAST('0x' || substr(md5(text), 1, 2) AS INTEGER) / sqrt(CAST('0x' || substr(md5(text), 1, 2) AS INTEGER) ^ 2 + 1e4), 5) AS x, 2 AS dim
FROM texts WHERE batch_size >= 2""",
    "stream_recall_increments": with_(MEMORIES, PROMPTS, LOW) + f"""SELECT m.id, CAST(m.access_count + coalesce(h.n, 0) AS INTEGER) AS access_count,
  {stamp(f"CASE WHEN h.n IS NULL THEN m.last_accessed ELSE greatest(m.last_accessed, {NOW}) END")} AS last_accessed
FROM memories m LEFT JOIN (SELECT id, count(*) AS n FROM hits GROUP BY id) h ON m.id = h.id""",
    "stream_recall": with_(MEMORIES, PROMPTS, LOW) + "SELECT query_id, id, rank, round(score, 6) AS score FROM hits",
    "stream_sessions": f"""WITH turns AS (
  SELECT {owner("conv_id")} AS user_id, CAST(conv_id AS VARCHAR) AS conv_id,
    TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 1 HOUR + turn * INTERVAL 1 MINUTE AS ts FROM conversations),
gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS opens FROM turns
  WINDOW w AS (PARTITION BY user_id, conv_id ORDER BY ts)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, conv_id ORDER BY ts) AS s FROM gaps)
SELECT user_id, conv_id, count(*) AS rounds, {stamp("min(ts)")} AS first_ts, {stamp("max(ts)")} AS last_ts
FROM numbered GROUP BY user_id, conv_id, s
HAVING max(ts) + INTERVAL 40 MINUTE <= (SELECT max(ts) FROM turns)""",
    "memories_scan": with_(MEMORIES) + flat("memories"),
    "effective_importance": with_(MEMORIES) + f"SELECT id, {eff()} AS effective FROM memories",
    "parse_created": f"""SELECT doc_id, {stamp("CASE doc_id % 6 WHEN 0 THEN day WHEN 1 THEN moment WHEN 2 THEN moment - INTERVAL 2 HOUR WHEN 3 THEN moment ELSE " + NOW + " END")} AS created_at
FROM (SELECT doc_id, TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 180) * INTERVAL 1 DAY AS day,
  TIMESTAMP '2024-01-01 10:20:30' + (doc_id % 180) * INTERVAL 1 DAY AS moment FROM documents) x""",
    "strip_tool_calls": f"SELECT conv_id, turn, {strip('text')} AS clean FROM conversations",
    "truncate_marked": "SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '...' ELSE text END AS cut FROM documents",
    "period_keys": with_(MEMORIES) + "SELECT id, strftime(created_at, '%Y-%m') AS month, strftime(created_at, '%Y') AS year FROM memories",
    "null_empty": with_(MEMORIES) + """SELECT id, CASE WHEN access_count % 2 = 0 THEN NULL ELSE sentiment END AS sentiment,
  CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS n_topics, TRUE AS none_is_null FROM memories""",
    "vector_functions": f"""SELECT vec_id, round({dot("embedding", "mirror")} / sqrt({dot("embedding", "embedding")} * {dot("mirror", "mirror")}), 8) AS cosine,
  round(sqrt({dot("mirror", "mirror")}) / (sqrt({dot("mirror", "mirror")}) + 1e-8), 6) AS length
FROM (SELECT vec_id, embedding, list_reverse(embedding) AS mirror FROM embeddings) x""",
    "memory_lines": with_(MEMORIES) + f"SELECT id, {line()} AS line FROM memories",
    "new_ids": with_(MEMORIES) + """SELECT id, 'mem-' || substr(sha256(user_id || chr(31) || id), 1, 32) AS made,
  'mem-' || substr(sha256(id), 1, 12) AS short FROM memories""",
    "input_caps": with_(MEMORIES) + "SELECT id, CAST(least(5, len(string_split(content, ' '))) AS INTEGER) AS words, lang AS topics FROM memories",
    "where_metadata": with_(MEMORIES) + """SELECT id, tier, importance FROM memories
WHERE tier IN ('daily', 'yearly') AND importance >= 0.3 AND (sentiment = 'positive' OR access_count > 6)""",
    "by_tier_and_period": with_(MEMORIES) + f"SELECT id, {stamp('created_at')} AS created_at FROM memories WHERE tier = 'daily' AND strftime(created_at, '%Y-%m') = '2024-05'",
    "min_importance": with_(MEMORIES) + "SELECT id, importance FROM memories WHERE importance >= 0.3",
    "exclude_notes": with_(NOTES, KEPT_NOTES) + "SELECT file_name, length(content) AS chars FROM kept",
    "long_enough": f"SELECT doc_id FROM documents WHERE length({strip('text')}) >= 50",
    "expire": with_(MEMORIES) + f"SELECT id FROM memories WHERE created_at >= {NOW} - INTERVAL 100 DAY",
    "forget": with_(MEMORIES) + f"SELECT id, importance FROM memories WHERE NOT (created_at < {NOW} - INTERVAL 30 DAY AND importance < 0.3)",
    "forget_count": with_(MEMORIES) + f"SELECT count(*) FILTER (WHERE created_at < {NOW} - INTERVAL 30 DAY AND importance < 0.3) AS dropped FROM memories",
    "knn": with_(MEMORIES, PROMPTS, nearest(10)) + HITS + "near",
    "knn_approx_all": with_(MEMORIES, PROMPTS, nearest(10)) + HITS + "near",
    "knn_where": with_(MEMORIES, PROMPTS, nearest(3, "m.tier = 'daily'")) + HITS + "near",
    "knn_min_importance": with_(MEMORIES, PROMPTS, nearest(10)) + HITS.replace(", rank FROM", ", place AS rank FROM")
    + """(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS place
  FROM near WHERE importance >= 0.3) x WHERE place <= 5""",
    "update_metadata": with_(MEMORIES, ACCESSES, TALLY, """changed AS (
  SELECT m.* REPLACE (CAST(coalesce(t.hits, m.access_count) AS INTEGER) AS access_count, coalesce(t.last_hit, m.last_accessed) AS last_accessed,
    CASE WHEN t.hits % 2 = 1 THEN 'seen' ELSE m.sentiment END AS sentiment)
  FROM memories m LEFT JOIN tally t ON m.id = t.id)""") + flat("changed"),
    "upsert": with_(MEMORIES, """new AS (
  SELECT 'mem-' || (conv_id * 10 + turn) AS id, text, CASE WHEN role <> 'user' THEN 'neutral' END AS feel FROM conversations)""", """merged AS (
  SELECT coalesce(n.id, m.id) AS id, user_id, coalesce(n.text, m.content) AS content, topics, key_facts, importance, base_importance,
    coalesce(n.feel, m.sentiment) AS sentiment, CASE WHEN n.id IS NOT NULL THEN 'manual' ELSE m.source END AS source, tier,
    access_count, last_accessed, created_at, session_id, parent_ids, merge_count
  FROM memories m FULL JOIN new n ON m.id = n.id)""") + flat("merged"),
    "delete_ids": with_(MEMORIES, ACCESSES) + "SELECT id, tier FROM memories WHERE id NOT IN (SELECT id FROM accesses)",
    "find_merge_target": with_(MEMORIES, settle(DAY, "memories", "d")) + "SELECT user_id, period, id AS target_id FROM d_target",
    "settlement_groups": with_(MEMORIES, settle(DAY, "memories", "d")) + "SELECT * FROM d_groups",
    "merge_members": with_(MEMORIES, f"""d_parts AS (
  SELECT user_id, strftime(created_at, '%Y-%m') AS period, 1 AS ord, created_at, id, content, topics, key_facts, {STORED} AS base, sentiment
  FROM memories WHERE (tier = 'daily' OR (tier IS NULL AND user_id NOT IN (SELECT user_id FROM memories WHERE tier = 'daily')))
    AND {eff(STORED)} < 0.35)""", merge_ctes("d")) + f"""SELECT user_id, period, summary, {joined("topics")} AS topics, {joined("key_facts")} AS key_facts,
  sentiment, importance FROM d_reduced""",
    "assemble_conversation": with_(ROUNDS, batches(2), TEXTS) + "SELECT user_id, conv_id, batch_no, batch_size, text FROM texts",
    "access_tally": with_(ACCESSES, TALLY) + f"SELECT id, hits, {stamp('last_hit')} AS last_hit FROM tally",
    "count_memories": with_(MEMORIES) + "SELECT user_id, tier, count(*) AS memories FROM memories GROUP BY user_id, tier",
    "decay_changes": with_(MEMORIES) + f"SELECT count(*) FILTER (WHERE importance IS NULL OR abs({eff(STORED)} - importance) > 1e-6) AS changed FROM memories",
    "round_batches": with_(ROUNDS, batches(2)) + "SELECT user_id, conv_id, round_id, round, batch_no, batch_size, flush FROM batches",
    "recent": with_(MEMORIES) + """SELECT user_id, id, age_rank FROM (
  SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS age_rank FROM memories) x WHERE age_rank <= 20""",
    "pack_context": with_(MEMORIES, packed("memories")) + PACK_OUT,
    "session_start": with_(MEMORIES, f"decayed AS (SELECT * REPLACE ({eff(STORED)} AS importance) FROM memories)", packed("decayed", 20)) + PACK_OUT,
    "rerank": with_(MEMORIES, ACCESSES, TALLY, f"""scored AS (
  SELECT user_id AS query_id, id, cosine, 0.6e0 * cosine + 0.4e0 * e AS score FROM (
    SELECT m.*, least(1e0, 0.3e0 + hits / 10e0) AS cosine, {eff()} AS e FROM memories m JOIN tally USING (id)) x)""") + """SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cosine DESC, id) AS rank
  FROM scored WHERE score >= 0.55 AND cosine >= 0.58) x WHERE rank <= 5""",
    "recall": with_(MEMORIES, PROMPTS, LOW) + RECALL_OUT,
    "recall_default": with_(MEMORIES, PROMPTS, recalled(0.55, 0.58)) + RECALL_OUT,
    "recall_updates": with_(MEMORIES, PROMPTS, LOW) + f"""SELECT id, CAST(any_value(access_count) + count(*) AS INTEGER) AS access_count,
  {stamp(NOW)} AS last_accessed, any_value(effective) AS importance FROM hits GROUP BY id""",
    "recall_context": with_(MEMORIES, PROMPTS, LOW) + f"""SELECT query_id, CASE WHEN length(t) > 2000 THEN substr(t, 1, 2000) || chr(10) || '...(记忆已截断)' ELSE t END AS context FROM (
  SELECT query_id, '[相关记忆]' || chr(10) || string_agg('- [' || strftime(created_at, '%Y-%m-%d') || '] ' || content || ' (主题：' || array_to_string(topics[1:3], ', ')
    || ') (0.6×' || {fixed("cosine", 2)} || '+0.4×' || {fixed("effective", 2)} || '=' || {fixed("score", 2)} || ')', chr(10) ORDER BY rank)
    || chr(10) || chr(10) || '---' || chr(10) AS t FROM hits GROUP BY query_id) x""",
    "tier_weighted_rank": with_(MEMORIES, PROMPTS, nearest(20)) + f"""SELECT query_id, id, round(tier_score, 5) AS tier_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier_score DESC, id) AS rank FROM (
    SELECT query_id, id, {eff()} * CASE tier WHEN 'monthly' THEN 0.85e0 WHEN 'yearly' THEN 0.5e0 ELSE 1e0 END
      / greatest(distance, 1e-6) AS tier_score FROM near) x) y WHERE rank <= 5""",
    "decay": with_(MEMORIES) + flat("memories", importance=eff(STORED)),
    "settle_daily": with_(MEMORIES, settle(DAY, "memories", "d")) + flat("d_hot"),
    "settle_daily_archive": with_(MEMORIES, settle(DAY, "memories", "d")) + ARCHIVE_OUT + "d_archived",
    "settle_monthly": with_(MEMORIES, settle(MON, "memories", "y")) + flat("y_hot"),
    "settle_monthly_archive": with_(MEMORIES, settle(MON, "memories", "y")) + ARCHIVE_OUT + "y_archived",
    "archive_lookup": with_(MEMORIES, ACCESSES, settle(DAY, "memories", "d")) + "SELECT id, content, merged_into FROM d_archived WHERE id IN (SELECT id FROM accesses)",
    "archive_found": with_(MEMORIES, ACCESSES, settle(DAY, "memories", "d")) + "SELECT id, content, merged_into FROM d_archived WHERE id IN (SELECT id FROM accesses)",
    "all_memories": with_(MEMORIES, settle(DAY, "memories", "d")) + """SELECT id, user_id, tier, FALSE AS archived, NULL AS merged_into FROM d_hot
UNION ALL SELECT id, user_id, tier, TRUE, merged_into FROM d_archived""",
    "summarize_batches": with_(SUMMARIES) + flat("remembered"),
    "leftover_rounds": with_(ROUNDS, batches(2)) + "SELECT user_id, conv_id, round_id, batch_no FROM batches WHERE batch_size < 2",
    "ingest_notes": with_recursive(*INGESTED_ROWS) + flat("remembered"),
    "ingest_note_counts": with_recursive(*INGESTED) + """SELECT (SELECT count(*) FROM notes) AS found,
  (SELECT count(*) FROM notes) - (SELECT count(*) FROM kept) AS excluded, (SELECT count(*) FROM importable) AS imported""",
    "chunks": with_recursive(NOTES, chunked("notes")) + "SELECT file_name, pos, chunk FROM chunks",
    "importable_chunks": with_recursive(*INGESTED) + "SELECT user_id, file_name, pos, text FROM importable",
    "ingest_responses": with_(PARSED) + "SELECT doc_id, route, summary, topics, key_facts, sentiment, importance FROM parsed WHERE problem IS NULL",
    "quarantined_responses": with_(PARSED) + "SELECT doc_id, route, problem, raw FROM parsed WHERE problem IS NOT NULL",
    "response_routes": with_(PARSED) + "SELECT route, count(*) AS replies FROM parsed WHERE problem IS NULL GROUP BY route",
    "session_end": ENDED + flat("y_hot"),
    "session_end_archive": ENDED + """SELECT id, user_id, tier, period, merged_into FROM d_archived
UNION ALL SELECT id, user_id, tier, period, merged_into FROM y_archived""",
    "session_end_twice": ENDED + "SELECT id, count(*) AS versions FROM (SELECT id FROM y_hot UNION ALL SELECT id FROM d_archived UNION ALL SELECT id FROM y_archived) a GROUP BY id",
    "find_merge_target_semantic": with_recursive(MEMORIES, settle(DAY, "memories", "d"), f"""asked AS (
  SELECT user_id, period, substr(string_agg(coalesce(content, ''), ' ' ORDER BY created_at, id), 1, 500) AS said FROM d_low
  WHERE (user_id, period) NOT IN (SELECT (user_id, period) FROM d_target) GROUP BY user_id, period),
q AS (SELECT user_id, period, {letters("said")} AS v FROM asked),
y AS (SELECT user_id, id, tier, {letters("content")} AS v FROM memories),
pairs AS (SELECT q.user_id, q.period, y.id, y.tier, 1 - round({dot("q.v", "y.v")} / (sqrt({dot("q.v", "q.v")}) * sqrt({dot("y.v", "y.v")})), 10) AS distance
  FROM q JOIN y ON q.user_id = y.user_id),
near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY user_id, period ORDER BY distance, id) <= 3),
queue AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY distance, period, id) AS n FROM near
  WHERE distance < 0.9 AND tier = 'monthly' AND id NOT IN (SELECT id FROM d_target)),
walk AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS periods, CAST([] AS VARCHAR[]) AS ids FROM (SELECT DISTINCT user_id FROM queue)
  UNION ALL
  SELECT w.user_id, w.n + 1, CASE WHEN list_contains(periods, period) OR list_contains(ids, id) THEN periods ELSE list_append(periods, period) END,
    CASE WHEN list_contains(periods, period) OR list_contains(ids, id) THEN ids ELSE list_append(ids, id) END
  FROM walk w JOIN queue k ON k.user_id = w.user_id AND k.n = w.n + 1)""") + """SELECT user_id, period, id AS target_id FROM d_target
UNION ALL SELECT user_id, unnest(periods), unnest(ids) FROM (
  SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1) x""",
    "settle_due": with_(MEMORIES, settle(DAY, "memories", "d")) + """SELECT id, merged_into, content FROM d_archived
UNION ALL SELECT id, NULL, content FROM d_merged""",
    "settle_rebuild": with_(MEMORIES, "early AS (SELECT * FROM memories WHERE access_count % 2 = 0)", settle(DAY, "early", "d"),
        "later AS (SELECT * FROM d_hot UNION ALL BY NAME SELECT * EXCLUDE (embedding, lang, source_tag, doc_id) FROM memories WHERE access_count % 2 = 1)",
        settle(DAY, "later", "e", "d_archived")) + flat("e_merged"),
    "reembed": with_(MEMORIES) + f"""SELECT id, {", ".join(f"round(CAST(v[{i + 1}] AS DOUBLE), 4) AS x{i}" for i in range(8))} FROM (
  SELECT id, CAST({letters("substr(lang || ' ' || source_tag || ' ' || key_facts[1], 1, 150)")} AS FLOAT[]) AS v FROM memories) x""",
    "stream_round_batches": with_(ROUNDS, batches(2)) + """SELECT user_id, conv_id, round_id, round, batch_no, batch_size, flush FROM (
  SELECT *, max(ts) OVER (PARTITION BY user_id, conv_id, batch_no) AS last_ts FROM batches) x
WHERE NOT flush OR last_ts + INTERVAL 2 HOUR <= (SELECT max(ts) FROM rounds)""",
    "yearly_originals": ENDED + """, edges AS (SELECT id, merged_into FROM d_archived UNION SELECT id, merged_into FROM y_archived)
SELECT coalesce(b.merged_into, a.merged_into) AS summary, a.id, CASE WHEN b.id IS NULL THEN 1 ELSE 2 END AS steps
FROM edges a LEFT JOIN edges b ON a.merged_into = b.id
WHERE a.id NOT IN (SELECT merged_into FROM edges) AND coalesce(b.merged_into, a.merged_into) IN (SELECT id FROM y_hot WHERE tier = 'yearly')""",
    "reset_base": with_(MEMORIES) + flat("memories", base_importance="CASE WHEN strftime(created_at, '%Y-%m') = '2024-04' THEN 0.75e0 ELSE base_importance END"),
    "embedding_text": with_(MEMORIES) + "SELECT id, substr(lang || ' ' || source_tag || ' ' || key_facts[1], 1, 150) AS embedding_text FROM memories",
    "merge_plan": with_(MEMORIES, settle(DAY, "memories", "d")) + """SELECT user_id, period, m.id AS target_id,
  2 * n_low AS raw, m.merge_count AS merges,
  CASE WHEN 2 * n_low < 10 AND m.merge_count < 3 THEN 'incremental' ELSE 'rebuild' END AS plan
FROM d_groups g JOIN (SELECT *, strftime(created_at, '%Y-%m') AS period FROM d_hot WHERE tier = 'monthly'
  QUALIFY row_number() OVER (PARTITION BY user_id, strftime(created_at, '%Y-%m') ORDER BY created_at, id) = 1) m USING (user_id, period)""",
    "last_user_message": f"""SELECT conv_id AS transcript, arg_max({strip("text")}, turn) AS last_user FROM conversations
WHERE role = 'user' AND turn % 7 <> 6 AND NOT (conv_id % 2 = 0 AND turn % 5 = 4) AND {strip("text")} <> '' GROUP BY conv_id""",
}
