"""SQL of the catalogue's queries over the same tables, built from common table expressions."""

from __future__ import annotations

from sparloom.functions.labels import Guardrails, Taxonomy
from sparloom.operators.reports import load_targets
from sparloom.sources.parsers import AGENT_SIGNS, CODING_SIGNS, TOOL_MARKER


def quoted(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def strings(xs) -> str:
    return "CAST([" + ", ".join(quoted(x) for x in xs) + "] AS VARCHAR[])"


def cue_rows() -> str:
    rows = []
    for axis in ("capabilities", "domains"):
        for label in Taxonomy.load(axis=axis).labels:
            for i, c in enumerate(label.cues):
                rows.append(f"({quoted(axis)}, {quoted(label.name)}, {i}, {quoted(c)}, {quoted('(^|[^a-z0-9_])' + c.replace(' ', chr(92) + 's+') + '([^a-z0-9_]|$)')})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(axis, label, ord, cue, pattern)"


def alias_rows() -> str:
    rows = [f"({quoted(axis)}, {quoted(a)}, {quoted(n)})" for axis in ("capabilities", "domains") for a, n in Taxonomy.load(axis=axis).aliases.items()]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(axis, alias, label)"


def name_rows() -> str:
    rows = [f"({quoted(axis)}, {i}, {quoted(n)})" for axis in ("capabilities", "domains") for i, n in enumerate(Taxonomy.load(axis=axis).names)]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(axis, ord, label)"


def target_rows() -> str:
    rows = [f"({quoted(t['id'])}, {i}, {strings(t['target_capabilities'])}, {strings(t['target_domains'])})" for i, t in enumerate(load_targets())]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(target, ord, caps, doms)"


BLANK = "E' \\n\\t\\r'"
CONV = f"""parts AS (
  SELECT conv_id, turn, 0 AS k, role, 'message' AS type, text AS content, false AS trainable FROM conversations WHERE role <> 'assistant'
  UNION ALL SELECT conv_id, turn, 0, role, 'tool_call', '{{"turn":' || turn || '}}', true FROM conversations WHERE role = 'assistant' AND turn % 4 = 3
  UNION ALL SELECT conv_id, turn, 1, role, 'final', trim(text, {BLANK}), true FROM conversations WHERE role = 'assistant' AND turn % 4 = 3
  UNION ALL SELECT conv_id, turn, 0, role, 'reasoning', trim(substr(text, 1, 60), {BLANK}), true FROM conversations WHERE role = 'assistant' AND turn % 4 = 1
  UNION ALL SELECT conv_id, turn, 1, role, 'final', trim(substr(text, 61), {BLANK}), true FROM conversations WHERE role = 'assistant' AND turn % 4 = 1
  UNION ALL SELECT conv_id, turn, 1, role, 'final', trim(text, {BLANK}), true FROM conversations WHERE role = 'assistant' AND turn % 2 = 0),
turns AS (
  SELECT p.conv_id, row_number() OVER (PARTITION BY p.conv_id ORDER BY turn, k) - 1 AS pos, role, type, content, trainable
  FROM parts p JOIN documents d ON p.conv_id = d.doc_id WHERE role <> 'assistant' OR content <> ''),
convs AS (
  SELECT conv_id, string_agg(content, E'\\n' ORDER BY pos) AS joined,
         string_agg(content, E'\\n\\n' ORDER BY pos) FILTER (WHERE role = 'user') AS asked,
         string_agg(role || ':' || type || E'\\n' || trim(content, {BLANK}), E'\\n\\n' ORDER BY pos) AS rendered,
         CAST(count(*) FILTER (WHERE trainable) AS BIGINT) AS n_train, bool_or(type = 'tool_call') AS has_call,
         bool_or(trim(content, {BLANK}) = '') OR NOT bool_or(role = 'user') OR NOT bool_or(trainable) AS malformed
  FROM turns GROUP BY conv_id),
samples AS (
  SELECT c.*, 'conv-' || c.conv_id AS id, d.source AS source_dataset, d.lang,
         CASE c.conv_id % 3 WHEN 0 THEN 'coding' WHEN 1 THEN 'agent' ELSE 'reasoning' END AS sample_type,
         CASE l.quality WHEN 1 THEN true WHEN 0 THEN false END AS success,
         CAST(greatest(1, length(joined) // 4) AS INTEGER) AS tokens,
         left(coalesce(asked, joined), 24000) AS task,
         [x FOR x IN regexp_split_to_array(lower(joined), '\\s+') IF x <> ''] AS w
  FROM convs c JOIN documents d ON c.conv_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
grams AS (SELECT conv_id, CASE WHEN len(w) < 10 THEN CAST([] AS VARCHAR[]) ELSE [array_to_string(w[i + 1:i + 5], chr(1)) FOR i IN range(len(w) - 5)] END AS g FROM samples),
reps AS (SELECT conv_id, CASE WHEN len(g) = 0 THEN 0.0::DOUBLE ELSE (len(g) - len(list_distinct(g)))::DOUBLE / len(g) END AS repetition FROM grams)"""
LABELS = f"""cues AS ({cue_rows()}), aliases AS ({alias_rows()}),
hay AS (SELECT conv_id, id, lang, lower(task || E'\\n' || lang) AS hay FROM samples),
kw AS (SELECT conv_id, axis, label, CAST(count(*) AS INTEGER) AS n_cues, arg_min(cue, ord) AS first_cue FROM hay, cues WHERE regexp_matches(hay, pattern) GROUP BY ALL),
al AS (SELECT conv_id, axis, label FROM hay JOIN aliases ON alias = lang),
ev AS (
  SELECT conv_id, axis, label, coalesce(n_cues, 0) AS n_cues, first_cue,
         greatest(CASE WHEN n_cues > 0 THEN round(least(0.9::DOUBLE, 0.35::DOUBLE + 0.1::DOUBLE * n_cues), 4) ELSE 0.0::DOUBLE END, CASE WHEN al.label IS NOT NULL THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END) AS score
  FROM kw FULL JOIN al USING (conv_id, axis, label)),
lab AS (
  SELECT s.*, repetition, coalesce(c.ls, CAST([] AS VARCHAR[])) AS capabilities, coalesce(d.ls, CAST([] AS VARCHAR[])) AS domains
  FROM samples s JOIN reps USING (conv_id)
  LEFT JOIN (SELECT conv_id, list(label ORDER BY label) AS ls FROM ev WHERE axis = 'capabilities' AND score >= 0.5 GROUP BY 1) c USING (conv_id)
  LEFT JOIN (SELECT conv_id, list(label ORDER BY label) AS ls FROM ev WHERE axis = 'domains' AND score >= 0.5 GROUP BY 1) d USING (conv_id)),
scored AS (
  SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.35::DOUBLE + CASE WHEN success THEN 0.25::DOUBLE WHEN NOT success THEN -0.25::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN n_train >= 2 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN has_call THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + 0.0::DOUBLE
    + CASE WHEN len(capabilities) > 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN tokens BETWEEN 256 AND 12000 THEN 0.1::DOUBLE WHEN tokens > 24000 THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END - least(0.25::DOUBLE, repetition))), 4) AS quality_score FROM lab),
long AS (SELECT conv_id, id, source_dataset, sample_type, 'capabilities' AS axis, unnest(capabilities) AS label FROM scored UNION ALL SELECT conv_id, id, source_dataset, sample_type, 'domains', unnest(domains) FROM scored),
eligible AS (SELECT * FROM scored WHERE quality_score >= 0.45 AND NOT malformed AND tokens BETWEEN 64 AND 32768 AND repetition <= 0.2),
targets AS ({target_rows()}),
met AS (SELECT t.target, t.ord, e.* FROM targets t JOIN eligible e ON list_has_all(e.capabilities, t.caps) AND (len(t.doms) = 0 OR list_has_any(e.domains, t.doms)))"""


def conv(tail: str) -> str:
    return f"WITH {CONV} {tail}"


def lab(tail: str) -> str:
    return f"WITH {CONV}, {LABELS} {tail}"


DOCS = """docs AS (
  SELECT doc_id, source, 'doc-' || doc_id AS id, text, left(text, 200) || E'\\n' || text AS joined, CAST(greatest(1, (length(left(text, 200)) + 1 + length(text)) // 4) AS INTEGER) AS tokens,
         source || '||' || CAST(doc_id // 4 AS VARCHAR) AS group_key,
         [x FOR x IN regexp_split_to_array(lower(text), '\\s+') IF x <> ''] AS w FROM documents)"""


def hashed(prefix: str) -> str:
    """A number from 0 to 1 of prefix and the group key."""
    return f"(('0x' || substr(sha256('{prefix}' || group_key), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"


def guardrail_sql(given: str = "SELECT id, sample_type, lower(task) AS low, ['CRITIQUE', 'SYNTHESIS', 'TOOL_USE'] AS caps, ['ENGLISH_PROSE'] AS doms FROM samples", most: int = 3, most_domains: int = 2, tail: str | None = None) -> str:
    """given: (id, sample_type, low, caps, doms)."""
    g = Guardrails.load()
    any_of = lambda cues: "(" + " OR ".join(f"contains(low, {quoted(c)})" for c in cues) + ")"
    listed = lambda table: "[x FOR x IN [" + ", ".join(f"CASE WHEN {any_of(c)} THEN {quoted(n)} END" for n, c in table.items()) + "] IF x IS NOT NULL]"
    lacking = "[x FOR x IN [" + ", ".join(f"CASE WHEN NOT {any_of(c)} THEN {quoted(n)} END" for n, c in g.required.items()) + "] IF x IS NOT NULL]"
    return lab(f""", t AS ({given}),
a AS (SELECT id, caps, doms, sample_type = 'coding' OR {any_of(g.frame)} AS framed, {listed(g.domains)} AS cued, {lacking} AS lacking, {listed(g.added)} AS due FROM t),
b AS (SELECT *, [c FOR c IN caps IF list_contains(lacking, c)] AS dropped0, [c FOR c IN caps IF NOT list_contains(lacking, c)] AS kept FROM a),
c AS (SELECT *, [x FOR x IN due IF NOT list_contains(kept, x)] AS added FROM b),
d AS (SELECT id, framed, list_concat(kept, added) AS every, added, dropped0, doms,
  CASE WHEN framed THEN [{quoted(g.frame_domain)}] WHEN len(cued) > 0 THEN cued[1:{most_domains}] ELSE doms END AS final_doms FROM c)
{tail or f"""SELECT id, array_to_string(every[1:{most}], ',') AS capabilities, array_to_string(final_doms, ',') AS domains, array_to_string(list_concat(dropped0, every[{most + 1}:]), ',') AS dropped, array_to_string(added, ',') AS added, framed AS coding_frame,
  (len(dropped0) > 0 OR len(every) > {most} OR len(added) > 0 OR final_doms <> doms) AS applied FROM d"""}""")


def all_conv(tail: str) -> str:
    """Turns of all conversations, as raw rows have them, and what a row of them is scored by; every seventh has a bad first role."""
    turns = CONV.split("samples AS (")[0].replace("FROM parts p JOIN documents d ON p.conv_id = d.doc_id WHERE", "FROM parts p WHERE")
    cued = " OR ".join(f"regexp_matches(lower(joined), {quoted('(^|[^a-z0-9_])' + c.replace(' ', chr(92) + 's+') + '([^a-z0-9_]|$)')})" for label in Taxonomy.load().labels for c in label.cues)
    marked = " OR ".join(f"contains(lower(joined), {quoted(m)})" for m in TOOL_MARKER[1])
    return f"""WITH {turns} rw AS (
  SELECT c.*, 'conv-' || conv_id AS id, conv_id % 2 = 1 AS success, CAST(greatest(1, length(joined) // 4) AS INTEGER) AS tokens,
         [x FOR x IN regexp_split_to_array(lower(joined), '\\s+') IF x <> ''] AS w, {cued} OR {marked} AS labelled,
         conv_id % 7 = 0 AND EXISTS (SELECT 1 FROM conversations v WHERE v.conv_id = c.conv_id AND v.turn = 0) AS bad
  FROM convs c),
rg AS (SELECT *, CASE WHEN len(w) < 10 THEN CAST([] AS VARCHAR[]) ELSE [array_to_string(w[i + 1:i + 5], chr(1)) FOR i IN range(len(w) - 5)] END AS g FROM rw),
rr AS (SELECT *, CASE WHEN len(g) = 0 THEN 0.0::DOUBLE ELSE (len(g) - len(list_distinct(g)))::DOUBLE / len(g) END AS repetition FROM rg),
rs AS (SELECT *, CASE WHEN regexp_matches(lower(left(joined, 2000)), '{"|".join(CODING_SIGNS)}') THEN 'coding' WHEN regexp_matches(lower(left(joined, 2000)), '{"|".join(AGENT_SIGNS)}') THEN 'agent' ELSE 'reasoning' END AS sample_type,
  round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.35::DOUBLE + CASE WHEN success THEN 0.25::DOUBLE ELSE -0.25::DOUBLE END + CASE WHEN n_train >= 2 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN has_call THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN labelled THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN tokens BETWEEN 256 AND 12000 THEN 0.1::DOUBLE WHEN tokens > 24000 THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END - least(0.25::DOUBLE, repetition))), 4) AS quality_score FROM rr),
ok AS (SELECT *, NOT bad AND NOT malformed AND tokens BETWEEN 64 AND 32768 AND repetition <= 0.2 AS fit FROM rs)
{tail}"""


def fold(name: str, pool: str, budget: str) -> str:
    """Recursive tables: <name> has the rows of `pool` (id, tokens, k) that a greedy budget takes in the order of k."""
    return f"""{name}_o AS (SELECT id, tokens, row_number() OVER (ORDER BY k) AS r FROM ({pool})),
{name}_f AS (SELECT r, CAST(tokens AS BIGINT) AS total, true AS taken, id, tokens FROM {name}_o WHERE r = 1
  UNION ALL SELECT o.r, CASE WHEN f.total + o.tokens <= {budget} THEN f.total + o.tokens ELSE f.total END, f.total + o.tokens <= {budget}, o.id, o.tokens FROM {name}_f f JOIN {name}_o o ON o.r = f.r + 1),
{name} AS (SELECT id, tokens FROM {name}_f WHERE taken)"""


def subset_sql(seed: str, domain: str, budget: int, least: float) -> str:
    """Specialist, general and evaluation sets of the labelled conversations."""
    aim = int(budget * 0.8)
    order = lambda s: f"sha256('{s}|' || group_key || '|' || id) || '|' || id AS k"
    head = lab("").replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{head}, base AS (SELECT id, tokens, source_dataset || '||doc-' || conv_id AS group_key, list_contains(domains, {quoted(domain)}) AS is_target FROM scored
  WHERE quality_score >= {least} AND NOT malformed AND tokens BETWEEN 64 AND 32768 AND repetition <= 0.2),
cand AS (SELECT *, {hashed(seed + '|eval|')} < 0.1 AS in_split FROM base WHERE is_target),
picked AS (SELECT id, k FROM (SELECT id, {order(seed + '|eval')} FROM cand WHERE in_split) ORDER BY k LIMIT 200),
lone AS (SELECT id, k FROM (SELECT id, {order(seed + '|eval-fallback')} FROM cand WHERE NOT EXISTS (SELECT 1 FROM picked)) ORDER BY k LIMIT 1),
held AS (SELECT * FROM base WHERE id IN (SELECT id FROM picked UNION ALL SELECT id FROM lone)),
train AS (SELECT * FROM base WHERE group_key NOT IN (SELECT group_key FROM held)),
{fold('a', f"SELECT id, tokens, {order(seed + '|specialist-target')} FROM train WHERE is_target", str(aim))},
{fold('b', f"SELECT id, tokens, {order(seed + '|specialist-anchor')} FROM train WHERE NOT is_target", str(budget - aim))},
{fold('g', f"SELECT id, tokens, {order(seed + '|general')} FROM train", "(SELECT coalesce(sum(tokens), 0) FROM (SELECT * FROM a UNION ALL SELECT * FROM b))")}
SELECT 'specialist' AS subset, id, tokens FROM a UNION ALL SELECT 'specialist', id, tokens FROM b UNION ALL SELECT 'general', id, tokens FROM g UNION ALL SELECT 'evaluation', id, tokens FROM held"""


def probe_rows() -> str:
    from sparloom.operators.reports import load_probes

    rows = [f"({i}, {quoted(p['id'])}, {quoted(p['text'].lower())}, {strings(p['capabilities'])}, {strings(p['domains'])})" for i, p in enumerate(load_probes())]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(row_idx, id, hay, caps, doms)"


def probe_sql(tail: str, least: float = 0.45) -> str:
    marked = " OR ".join(f"contains(hay, {quoted(m)})" for m in TOOL_MARKER[1])
    return f"""WITH probes AS ({probe_rows()}), cues AS ({cue_rows()}),
kw AS (SELECT id, axis, label, round(least(0.9::DOUBLE, 0.35::DOUBLE + 0.1::DOUBLE * count(*)), 4) AS score FROM probes, cues WHERE regexp_matches(hay, pattern) GROUP BY ALL),
ev AS (SELECT id, axis, label, score FROM kw UNION ALL SELECT id, 'capabilities', '{TOOL_MARKER[0]}', 0.55::DOUBLE FROM probes p WHERE ({marked}) AND NOT EXISTS (SELECT 1 FROM kw WHERE kw.id = p.id AND label = '{TOOL_MARKER[0]}')),
p AS (SELECT id, unnest(['capabilities', 'domains']) AS axis, unnest([caps, doms]) AS expected FROM probes),
m AS (SELECT p.*, coalesce((SELECT list(label) FROM ev WHERE ev.id = p.id AND ev.axis = p.axis AND score >= {least}), CAST([] AS VARCHAR[])) AS predicted FROM p),
d AS (SELECT id, axis, expected, list_sort([x FOR x IN expected IF list_contains(predicted, x)]) AS hit, list_sort([x FOR x IN expected IF NOT list_contains(predicted, x)]) AS missing, list_sort([x FOR x IN predicted IF NOT list_contains(expected, x)]) AS extra FROM m),
c AS (SELECT *, CASE WHEN len(expected) > 0 THEN round(len(hit)::DOUBLE / len(expected), 4) ELSE 1.0::DOUBLE END AS coverage, len(missing) = 0 AND len(extra) = 0 AS exact FROM d)
{tail}"""


def classifier_labels(tail: str, least: float = 0.5) -> str:
    """Weak labels from the classifier text instead of the task text."""
    labels = LABELS.replace("lower(task || E'\\n' || lang)", "lower(CASE WHEN length(rendered) <= 24000 THEN rendered ELSE left(rendered, 12000) || E'\\n\\n[...truncated...]\\n\\n' || right(rendered, 12000) END || E'\\n' || lang)").replace("score >= 0.5", f"score >= {least}")
    assert labels != LABELS
    return f"WITH {CONV}, {labels} {tail}"


def prompt_head(focused: bool, examples: list = ()) -> str:
    """The fixed part of a labelling prompt, as a literal."""
    from sparloom.operators.labeling import prompt_head as head

    return quoted(head(Taxonomy.load(), Taxonomy.load(axis="domains"), examples, focused))
