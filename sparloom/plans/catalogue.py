"""Catalogue of queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparloom.functions import turns as X
from sparloom.functions.labels import Guardrails, Taxonomy, apply_guardrails, normalize_label, one_hot, select_labels
from sparloom.functions.text import normalized_label, py_json_success, repetition_counts, token_estimate
from sparloom.operators import labeling, reports, subsets
from sparloom.operators.quality import filtered, matches_eval
from sparloom.plans import sql as S
from sparloom.plans.adapters import canon_conv, canon_docs, canon_events, labelled, raw_turns, table
from sparloom.schema import sample_errors
from sparloom.session import scratch
from sparloom.sources import io
from sparloom.sources.parsers import parse, sample_type
from sparloom.streaming.ingest import conversion_stats, converted
from sparloom.streaming.ingest import error_examples as ingest_errors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = "sparloom-1"


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def both() -> tuple[Taxonomy, Taxonomy]:
    return Taxonomy.load(), Taxonomy.load(axis="domains")


@query(S.conv("SELECT 'conv-' || conv_id AS id, CAST(pos AS INTEGER) AS pos, role, type, trainable, CAST(length(content) AS INTEGER) AS n_chars FROM turns"))
def canonical_turns(spark, sf_dir):
    rows = canon_conv(spark, sf_dir).select("id", F.posexplode("messages").alias("pos", "m"))
    return rows.select("id", "pos", "m.role", "m.type", "m.trainable", F.length("m.content").alias("n_chars"))


@query(
    S.conv(
        """, x AS (SELECT id, conv_id % 11 AS k, row_number() OVER () AS r FROM samples) SELECT 'conv-' || regexp_extract(id, '[0-9]+') AS sample, CASE k WHEN 0 THEN 'id' WHEN 1 THEN 'sample_type' WHEN 2 THEN 'quality_score' WHEN 3 THEN 'trainable_role'
WHEN 4 THEN 'turn_role' WHEN 5 THEN 'turn_type' WHEN 6 THEN 'turn_content' WHEN 7 THEN 'messages' WHEN 8 THEN 'tool_type' WHEN 9 THEN 'quality_score,sample_type' ELSE '' END AS error_codes FROM x"""
    )
)
def raw_schema_validate(spark, sf_dir):
    """Conversations with planted faults: each code alone, two together, none."""
    k = F.col("row_idx") % 11
    first = lambda field, value: F.transform("messages", lambda m, i: F.when(i == 0, m.withField(field, value)).otherwise(m))
    tool = F.transform("messages", lambda m: m.withField("role", F.lit("tool")).withField("type", F.lit("final")).withField("trainable", F.lit(False)))
    messages = F.when(k == 3, F.transform("messages", lambda m: m.withField("trainable", F.lit(True)))).when(k == 4, F.transform("messages", lambda m: m.withField("role", F.lit("king")).withField("trainable", F.lit(False)))).when(k == 5, first("type", F.lit("odd"))).when(k == 6, first("content", F.lit(None).cast("string")))
    rows = canon_conv(spark, sf_dir).withColumns(
        {
            "sample": F.col("id"),
            "id": F.when(k == 0, "").otherwise(F.col("id")),
            "sample_type": F.when(k.isin(1, 9), "other").otherwise(F.col("sample_type")),
            "quality_score": F.when(k.isin(2, 9), 1.5).otherwise(F.col("quality_score")),
            "messages": messages.when(k == 7, F.slice("messages", 1, 0)).when(k == 8, tool).otherwise(F.col("messages")),
        }
    )
    return rows.select("sample", F.array_join(sample_errors(), ",").alias("error_codes"))


@query(f"WITH {S.DOCS} SELECT id, tokens FROM docs")
def token_estimates(spark, sf_dir):
    return canon_docs(spark, sf_dir).select("id", token_estimate(X.joined_text(F.col("messages"))).alias("tokens"))


@query(
    f"WITH {S.DOCS}, g AS (SELECT id, CASE WHEN len(w) < 10 THEN CAST([] AS VARCHAR[]) ELSE [array_to_string(w[i + 1:i + 5], chr(1)) FOR i IN range(len(w) - 5)] END AS g FROM docs)"
    " SELECT id, CAST(len(g) AS INTEGER) AS n_ngrams, CAST(len(g) - len(list_distinct(g)) AS INTEGER) AS n_dup FROM g"
)
def repetition(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), repetition_counts(F.col("text")).alias("c"))
    return rows.select("id", "c.n_ngrams", "c.n_dup")


@query(S.conv("SELECT id, tokens FROM samples JOIN reps USING (conv_id) WHERE NOT malformed AND tokens BETWEEN 64 AND 32768 AND repetition <= 0.2"))
def basic_filter_conv(spark, sf_dir):
    return filtered(canon_conv(spark, sf_dir)).select("id", "tokens")


@query(S.lab("SELECT id, quality_score, success FROM scored"))
def quality_score(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", "quality_score", "success")


@query(
    """SELECT 'doc-' || doc_id AS id, CASE WHEN regexp_matches(h, 'repo|coding|code|python|javascript') THEN 'coding' WHEN regexp_matches(h, 'tool|terminal|shell|browser') THEN 'agent' ELSE 'reasoning' END AS sample_type
FROM (SELECT doc_id, lower(lang || '   ' || left(text, 2000)) AS h FROM documents)"""
)
def sample_types(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), sample_type(F.col("text"), F.col("lang"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("sample_type"))


@query(
    """SELECT doc_id, CASE WHEN v IN ('1', 'true', 'success', 'passed', 'pass') THEN true WHEN v IN ('0', 'false', 'failure', 'failed', 'fail') THEN false END AS success
FROM (SELECT doc_id, lower(trim(CASE doc_id % 4 WHEN 0 THEN ' ' || quality || ' ' WHEN 1 THEN CASE quality WHEN 1 THEN 'Passed' ELSE 'FAILED' END WHEN 2 THEN CASE quality WHEN 1 THEN 'True' ELSE 'false' END ELSE 'maybe' END)) AS v FROM labels)"""
)
def success_parse(spark, sf_dir):
    q, k = F.col("quality"), F.col("doc_id") % 4
    said = F.when(k == 0, F.concat(F.lit(" "), q, F.lit(" "))).when(k == 1, F.when(q == 1, "Passed").otherwise("FAILED")).when(k == 2, F.when(q == 1, "True").otherwise("false")).otherwise("maybe")
    return table(spark, sf_dir, "labels").select("doc_id", py_json_success(said).alias("success"))


@query(
    S.conv(
        """, t AS (SELECT id, CASE WHEN length(rendered) <= 24000 THEN rendered ELSE left(rendered, 12000) || E'\\n\\n[...truncated...]\\n\\n' || right(rendered, 12000) END AS ct, left(coalesce(asked, joined), 12000) AS tt FROM samples)
SELECT id, CAST(length(ct) AS INTEGER) AS n_classifier, sha256(ct) AS classifier_sha, CAST(length(tt) AS INTEGER) AS n_task, sha256(tt) AS task_sha FROM t"""
    )
)
def texts(spark, sf_dir):
    rows = canon_conv(spark, sf_dir).select("id", X.classifier_text(F.col("messages")).alias("ct"), X.task_text(F.col("messages")).alias("tt"))
    return rows.select("id", F.length("ct").alias("n_classifier"), F.sha2("ct", 256).alias("classifier_sha"), F.length("tt").alias("n_task"), F.sha2("tt", 256).alias("task_sha"))


@query(
    S.lab(
        """SELECT 'conv-' || ev.conv_id AS id, ev.axis, ev.label, score, array_to_string([x FOR x IN [CASE WHEN n_cues > 0 THEN 'heuristic_keyword' END, CASE WHEN al.label IS NOT NULL THEN 'source_category_alias' END] IF x IS NOT NULL], ',') AS sources,
 array_to_string(list_sort(list_distinct([x FOR x IN [first_cue, CASE WHEN al.label IS NOT NULL THEN lang END] IF x IS NOT NULL])), ',') AS cues,
 CAST(row_number() OVER (PARTITION BY ev.conv_id, ev.axis ORDER BY score DESC, ev.label) AS INTEGER) AS place FROM ev JOIN hay USING (conv_id) LEFT JOIN al ON al.conv_id = ev.conv_id AND al.axis = ev.axis AND al.label = ev.label"""
    )
)
def weak_evidence(spark, sf_dir):
    caps, doms = labeling.evidence_of(X.task_text(F.col("messages"), 24000), *both())
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), e.alias("e")) for a, e in (("capabilities", caps), ("domains", doms))]))
    rows = canon_conv(spark, sf_dir).select("id", each.alias("x")).select("id", "x.axis", F.posexplode("x.e").alias("at", "e"))
    return rows.select("id", "axis", "e.label", "e.score", F.array_join("e.sources", ",").alias("sources"), F.array_join("e.cues", ",").alias("cues"), (F.col("at") + 1).alias("place"))


@query(
    S.lab(
        """, n AS (SELECT conv_id, count(*) FILTER (WHERE axis = 'capabilities') AS c, count(*) FILTER (WHERE axis = 'domains') AS d FROM ev GROUP BY 1)
SELECT id, 'weak_heuristic_v1' AS method, 'example-capabilities-1' AS version, CAST(coalesce(c, 0) AS INTEGER) AS n_capabilities, CAST(coalesce(d, 0) AS INTEGER) AS n_domains, '[]' AS previous, lang AS category FROM scored LEFT JOIN n USING (conv_id)"""
    )
)
def label_provenance(spark, sf_dir):
    """What relabelling leaves in the metadata, beside what was there."""
    said = lambda path: F.get_json_object("metadata", path)
    n = lambda axis: F.coalesce(F.size(F.from_json(said(f"$.{axis}_labeling.evidence"), "array<string>")), F.lit(0))
    return labelled(spark, sf_dir).select("id", said("$.capability_labeling.method").alias("method"), said("$.capability_labeling.taxonomy_version").alias("version"), n("capability").alias("n_capabilities"), n("domain").alias("n_domains"), said("$.domain_labeling.previous_domains").alias("previous"), said("$.category").alias("category"))


@query(S.lab("SELECT axis, label, CAST(count(*) AS BIGINT) AS n FROM long GROUP BY 1, 2"))
def label_counts(spark, sf_dir):
    return labeling.label_counts(labelled(spark, sf_dir))


@query(S.lab("SELECT round(count(*) FILTER (WHERE len(capabilities) = 0 AND len(domains) = 0) / greatest(count(*), 1), 4) AS empty_rate FROM scored"))
def label_empty_rate(spark, sf_dir):
    return reports.empty_rate(reports.label_report(labelled(spark, sf_dir)))


@query(S.lab("SELECT id, axis, label FROM long"))
def relabel(spark, sf_dir):
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("ls")) for a in ("capabilities", "domains")]))
    return labelled(spark, sf_dir).select("id", axes.alias("x")).select("id", "x.axis", F.explode("x.ls").alias("label"))


@query(
    f"WITH a AS ({S.alias_rows()}), r AS (SELECT DISTINCT p_type AS raw FROM part UNION SELECT DISTINCT c_mktsegment FROM customer UNION SELECT DISTINCT lang FROM documents UNION SELECT unnest(['English ', 'The-Code', 'code']))"
    " , n AS (SELECT raw, trim(regexp_replace(lower(trim(raw)), '[^a-zA-Z0-9]+', '_', 'g'), '_') AS normalized FROM r) SELECT raw, normalized, label FROM n LEFT JOIN (SELECT alias, label FROM a WHERE axis = 'domains') ON alias = normalized"
)
def alias_normalize(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(F.col("p_type").alias("raw")).union(table(spark, sf_dir, "customer").select("c_mktsegment")).union(table(spark, sf_dir, "documents").select("lang")).distinct()
    raw = raw.union(spark.createDataFrame([("English ",), ("The-Code",), ("code",)], "raw string"))
    return raw.select("raw", normalized_label(F.col("raw")).alias("normalized"), normalize_label(F.col("raw"), both()[1]).alias("label"))


@query(S.lab(f", n AS ({S.name_rows()}) SELECT id, label, CAST(list_contains(CASE axis WHEN 'domains' THEN domains ELSE capabilities END, label) AS INTEGER) AS bit FROM scored, n"))
def one_hot_labels(spark, sf_dir):
    caps, doms = both()
    names = F.array(*[F.lit(n) for n in (*caps.names, *doms.names)])
    bits = F.concat(one_hot(F.col("capabilities"), caps), one_hot(F.col("domains"), doms))
    return labelled(spark, sf_dir).select("id", F.explode(F.arrays_zip(names.alias("label"), bits.alias("bit"))).alias("x")).select("id", "x.label", "x.bit")


@query(
    S.lab(
        """, l AS (SELECT * FROM long),
r AS (SELECT 'rows' AS section, NULL AS k1, NULL AS k2, count(*) AS n FROM scored UNION ALL SELECT 'empty', NULL, NULL, count(*) FILTER (WHERE len(capabilities) = 0 AND len(domains) = 0) FROM scored
 UNION ALL SELECT 'sources', source_dataset, NULL, count(*) FROM scored GROUP BY 2 UNION ALL SELECT 'sample_types', sample_type, NULL, count(*) FROM scored GROUP BY 2
 UNION ALL SELECT axis, label, NULL, count(*) FROM l GROUP BY 1, 2
 UNION ALL SELECT axis || '_by_source', source_dataset, label, count(*) FROM l GROUP BY 1, 2, 3 UNION ALL SELECT axis || '_by_sample_type', sample_type, label, count(*) FROM l GROUP BY 1, 2, 3
 UNION ALL SELECT a || '_by_source', source_dataset, NULL, 0 FROM (SELECT DISTINCT source_dataset, unnest(['capabilities', 'domains']) AS a FROM scored) x WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.axis = x.a AND l.source_dataset = x.source_dataset)
 UNION ALL SELECT a || '_by_sample_type', sample_type, NULL, 0 FROM (SELECT DISTINCT sample_type, unnest(['capabilities', 'domains']) AS a FROM scored) x WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.axis = x.a AND l.sample_type = x.sample_type))
SELECT section, CAST(k1 AS VARCHAR) AS k1, CAST(k2 AS VARCHAR) AS k2, CAST(n AS BIGINT) AS n FROM r"""
    )
)
def label_report(spark, sf_dir):
    return reports.label_report(labelled(spark, sf_dir)).select("section", "k1", "k2", "n")


@query(S.lab("SELECT axis, label, CAST(rank AS INTEGER) AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY axis, label ORDER BY conv_id) AS rank FROM long) WHERE rank <= 3"))
def label_examples_topk(spark, sf_dir):
    return reports.label_examples(labelled(spark, sf_dir), 3)


@query(
    S.lab(
        ", c AS (SELECT target, count(*) AS n, sum(tokens) AS tokens FROM met GROUP BY 1) SELECT t.target, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, CASE WHEN coalesce(n, 0) >= 25 THEN 'ready' WHEN n > 0 THEN 'thin' ELSE 'empty' END AS status FROM targets t LEFT JOIN c USING (target)"
    )
)
def target_report(spark, sf_dir):
    return reports.target_report(labelled(spark, sf_dir), reports.load_targets())


@query(S.lab("SELECT target, 'source' AS dim, source_dataset AS key, CAST(count(*) AS BIGINT) AS n FROM met GROUP BY 1, 3 UNION ALL SELECT target, 'sample_type', sample_type, CAST(count(*) AS BIGINT) FROM met GROUP BY 1, 3"))
def target_histograms(spark, sf_dir):
    return reports.target_histograms(labelled(spark, sf_dir), reports.load_targets())


def probed(spark):
    return reports.probe_compare(labeling.relabel(reports.probes(spark), *both(), min_score=0.45))


@query(S.probe_sql("SELECT id, axis, array_to_string(hit, ',') AS hit, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra, coverage, exact FROM c"))
def probe_compare(spark, sf_dir):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return probed(spark).select("id", "axis", joined("hit"), joined("missing"), joined("extra"), "coverage", "exact")


@query(
    S.probe_sql(
        """, r AS (SELECT id, bool_and(exact) AS exact FROM c GROUP BY 1), s AS (SELECT axis, CASE WHEN sum(len(expected)) > 0 THEN round(sum(len(hit))::DOUBLE / sum(len(expected)), 4) ELSE 1.0::DOUBLE END AS share FROM c GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE exact) AS BIGINT) AS strict_matches, round(count(*) FILTER (WHERE exact) / count(*), 4) AS strict_rate, (SELECT share FROM s WHERE axis = 'capabilities') AS capabilities_coverage, (SELECT share FROM s WHERE axis = 'domains') AS domains_coverage FROM r"""
    )
)
def probe_report(spark, sf_dir):
    return reports.probe_report(probed(spark))


@query(S.lab("SELECT id, source_dataset, lang AS category, sha256(left(coalesce(asked, joined), 4000)) AS text_sha, array_to_string(capabilities, ',') AS capabilities, quality_score FROM scored WHERE list_contains(domains, 'GERMAN_PROSE') ORDER BY conv_id LIMIT 5"))
def inspect_label(spark, sf_dir):
    rows = reports.inspect(labelled(spark, sf_dir).withColumn("metadata", F.to_json(F.struct(F.get_json_object("metadata", "$.category").alias("original_id")))), label="GERMAN_PROSE")
    return rows.select("id", "source_dataset", F.col("original_id").alias("category"), F.sha2("text", 256).alias("text_sha"), F.array_join("capabilities", ",").alias("capabilities"), "quality_score")


@query(f"WITH {S.DOCS}, c AS (SELECT source AS grp, count(*) AS seen FROM docs GROUP BY 1) SELECT grp, CAST(seen AS BIGINT) AS seen, CAST(least(seen, 10) AS BIGINT) AS selected FROM c")
def sample_summary(spark, sf_dir):
    rows = canon_docs(spark, sf_dir)
    return reports.sample_summary(rows, reports.stratified_sample(rows, seed=SEED))


@query(f"WITH {S.DOCS} SELECT id FROM docs WHERE contains(lower(joined), 'the ') AND NOT contains(lower(joined), 'and ') AND NOT contains(lower(joined), 'token')")
def eval_filter(spark, sf_dir):
    """Samples that may be evaluated on: by type, cues that must and that must not occur."""
    return measured_joined(canon_docs(spark, sf_dir)).where(matches_eval(["reasoning"], ["THE "], ["and ", "token"])).select("id")


@query(f"WITH {S.DOCS} SELECT id, CAST(doc_id AS BIGINT) AS row_idx FROM docs WHERE doc_id % 4 = 1 ORDER BY doc_id LIMIT 25")
def shard_and_limit(spark, sf_dir):
    return io.limit_rows(io.shard_rows(canon_docs(spark, sf_dir), 4, 1), 25).select("id", "row_idx")


@query(f"WITH {S.DOCS}, n AS (SELECT id, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS s FROM docs) SELECT lpad(CAST(s AS VARCHAR), 5, '0') AS shard, CAST(count(*) AS BIGINT) AS n, min(id) AS least, max(id) AS most FROM n GROUP BY 1")
def written_shards(spark, sf_dir):
    """Exact shards of 300 rows, read back."""
    path = scratch(spark, "shards")
    io.write_shards(canon_docs(spark, sf_dir), path, 300)
    back = spark.read.schema("value string, shard string").text(path)
    return back.groupBy("shard").agg(F.count("*").alias("n"), F.min(F.get_json_object("value", "$.id")).alias("least"), F.max(F.get_json_object("value", "$.id")).alias("most"))


@query(S.conv("SELECT id, source_dataset, sample_type, success, CAST((SELECT count(*) FROM turns t WHERE t.conv_id = s.conv_id) AS INTEGER) AS n_turns, sha256(joined) AS text_sha, lang AS category FROM samples s"))
def jsonl_round_trip(spark, sf_dir):
    """Samples as JSON lines, read back and validated."""
    path = scratch(spark, "lines")
    io.write_jsonl(canon_conv(spark, sf_dir), path)
    rows = io.read_jsonl(spark, path, validate=True)
    return rows.select("id", "source_dataset", "sample_type", "success", F.size("messages").alias("n_turns"), F.sha2(X.joined_text(F.col("messages")), 256).alias("text_sha"), F.get_json_object("metadata", "$.category").alias("category"))


@query(f"WITH {S.DOCS} SELECT id, grp FROM (SELECT id, source AS grp, row_number() OVER (PARTITION BY source ORDER BY sha256('{SEED}|' || id), id) AS r FROM docs) WHERE r <= 10")
def stratified_sample(spark, sf_dir):
    return reports.stratified_sample(canon_docs(spark, sf_dir), seed=SEED).select("id", "grp")


@query(f"WITH {S.DOCS} SELECT id, {S.hashed(SEED + '|eval|')} < 0.1 AS is_eval FROM docs")
def hash_split(spark, sf_dir):
    rows = canon_docs(spark, sf_dir).withColumn("group_key", subsets.group_key())
    return rows.select("id", (subsets.unit_score(F.concat(F.lit(f"{SEED}|eval|"), "group_key")) < 0.1).alias("is_eval"))


@query(f"WITH {S.DOCS} SELECT id FROM docs WHERE group_key NOT IN (SELECT group_key FROM docs WHERE {S.hashed(SEED + '|eval|')} < 0.1 ORDER BY sha256('{SEED}|eval|' || group_key || '|' || id) LIMIT 20)")
def leakage_anti_join(spark, sf_dir):
    rows = canon_docs(spark, sf_dir).withColumn("group_key", subsets.group_key())
    held = rows.where(subsets.unit_score(F.concat(F.lit(f"{SEED}|eval|"), "group_key")) < 0.1).orderBy(subsets.order_key(f"{SEED}|eval")).limit(20)
    return rows.join(F.broadcast(held.select("group_key").distinct()), "group_key", "left_anti").select("id")


BUDGET, TIGHT = 2_000_000, 50_000


def budget_sql(budget: int) -> str:
    return f"WITH RECURSIVE {S.DOCS}, {S.fold('s', f"SELECT id, tokens, sha256('{SEED}|' || group_key || '|' || id) AS k FROM docs", str(budget))} SELECT id, tokens FROM s"


def budgeted(spark, sf_dir, budget):
    rows = measured_tokens(canon_docs(spark, sf_dir)).withColumn("group_key", subsets.group_key()).withColumn("key", subsets.order_key(SEED)).select("id", "key", "tokens")
    return subsets.select_by_budget(rows.select("key", "tokens"), budget).of(rows).select("id", "tokens")


@query(budget_sql(BUDGET))
def token_budget_select(spark, sf_dir):
    return budgeted(spark, sf_dir, BUDGET)


@query(budget_sql(TIGHT))
def token_budget_tight(spark, sf_dir):
    """A budget for less than the table holds, so that rows are passed over."""
    return budgeted(spark, sf_dir, TIGHT)


def measured_joined(samples: DataFrame) -> DataFrame:
    return samples.withColumn("joined_text", X.joined_text(F.col("messages")))


def measured_tokens(samples: DataFrame) -> DataFrame:
    return samples.withColumn("tokens", token_estimate(X.joined_text(F.col("messages"))))


@query(S.subset_sql(SEED, "ENGLISH_PROSE", BUDGET, 0.3))
def build_subsets(spark, sf_dir):
    return subset_rows(spark, sf_dir, BUDGET)


@query(S.subset_sql(SEED, "ENGLISH_PROSE", 20_000, 0.3))
def build_subsets_tight(spark, sf_dir):
    """Budgets for less than the table holds."""
    return subset_rows(spark, sf_dir, 20_000)


def subset_rows(spark, sf_dir, budget):
    got = subsets.build_subsets(labelled(spark, sf_dir), domains=["ENGLISH_PROSE"], max_train_tokens=budget, min_quality=0.3, seed=SEED)
    named = [(n, d) for n, d in (("specialist", got.specialist), ("general", got.general), ("evaluation", got.evaluation))]
    out = None
    for n, d in named:
        part = d.select(F.lit(n).alias("subset"), "id", "tokens")
        out = part if out is None else out.union(part)
    return out


@query(
    """WITH s AS (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY user_id) AS score FROM events GROUP BY 1, 2),
r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS rank FROM s WHERE score >= 0.15) SELECT user_id, CAST(rank AS INTEGER) AS rank, event_type AS label FROM r WHERE rank <= 3"""
)
def select_labels_topk(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    rows = n.groupBy("user_id").agg(F.sum("n").alias("t"), F.collect_list(F.struct("event_type", "n")).alias("e"))
    scores = F.map_from_entries(F.transform("e", lambda e: F.struct(e["event_type"], e["n"] / F.col("t"))))
    return rows.select("user_id", F.posexplode(select_labels(scores, 0.15, 3)).alias("pos", "label")).select("user_id", (F.col("pos") + 1).alias("rank"), "label")


@query(S.guardrail_sql())
def guardrails(spark, sf_dir):
    given = lambda *xs: F.array(*[F.lit(x) for x in xs])
    g = apply_guardrails(Guardrails.load(), F.col("sample_type"), X.task_text(F.col("messages"), 24000), given("CRITIQUE", "SYNTHESIS", "TOOL_USE"), given("ENGLISH_PROSE"), 3, 2)
    rows = canon_conv(spark, sf_dir).select("id", g.alias("g"))
    joined = lambda c, n: F.array_join(f"g.{c}", ",").alias(n)
    return rows.select("id", joined("capabilities", "capabilities"), joined("domains", "domains"), joined("dropped_capabilities", "dropped"), joined("added_capabilities", "added"), "g.coding_frame", "g.applied")


ANSWERED = f"""asked AS (SELECT *, CAST('0x' || substr(sha256({S.prompt_head(True)} || 'Known about it: ' || '{{"category":"' || lang || '","original_id":"doc-' || conv_id || '"}}' || E'\\nConversation:\\n' || left(coalesce(asked, joined), 12000) || E'\\nAnswer:'), 1, 8) AS BIGINT) % 4 AS kind FROM samples)"""


@query(
    S.guardrail_sql(
        "SELECT id, sample_type, lower(task) AS low, ['RECALL', 'CRITIQUE'] AS caps, ['ENGLISH_PROSE'] AS doms FROM asked",
        4,
        2,
        "SELECT d.id, CASE WHEN kind = 3 THEN '' ELSE array_to_string(every[1:4], ',') END AS capabilities, CASE WHEN kind = 3 THEN '' ELSE array_to_string(final_doms, ',') END AS domains, kind <> 3 AS parsed_ok, kind = 2 AS recovered, kind = 3 AS noted_error, kind <> 3 AS noted_guardrails, kind = 2 AS noted_recovery FROM d JOIN asked USING (id)",
    ).replace(", t AS (", f", {ANSWERED}, t AS (", 1)
)
def llm_label_stub(spark, sf_dir):
    """Answers of every kind, and what of them stands in the metadata."""
    rows = labeling.llm_label(canon_conv(spark, sf_dir), labeling.stub_generator, *both(), concurrency=4, rules=Guardrails.load())
    keys = F.json_object_keys("metadata")
    noted = [F.array_contains(keys, k).alias(n) for k, n in (("llm_labeling_error", "noted_error"), ("label_guardrails", "noted_guardrails"), ("llm_labeling_recovery", "noted_recovery"))]
    return rows.select("id", F.array_join("capabilities", ",").alias("capabilities"), F.array_join("domains", ",").alias("domains"), F.col("payload.error").isNull().alias("parsed_ok"), F.col("payload.recovery").isNotNull().alias("recovered"), *noted)


@query(S.conv(f", {ANSWERED} SELECT id FROM asked WHERE kind = 3 ORDER BY conv_id LIMIT 5"))
def inspect_parse_errors(spark, sf_dir):
    rows = labeling.llm_label(canon_conv(spark, sf_dir), labeling.stub_generator, *both(), concurrency=4)
    return reports.inspect(rows, parse_errors=True).select("id")


@query(
    S.conv(
        f""", n AS ({S.name_rows()}), x AS (SELECT id, axis, label, ((length(left(coalesce(asked, joined), 12000)) + 7 * ord) % 10) / 10.0::DOUBLE AS score FROM samples, n),
k AS (SELECT *, row_number() OVER (PARTITION BY id, axis ORDER BY score DESC, label) AS r FROM x WHERE score >= 0.65),
l AS (SELECT id, axis, string_agg(label, ',' ORDER BY r) AS ls FROM k WHERE r <= CASE axis WHEN 'domains' THEN 2 ELSE 4 END GROUP BY 1, 2)
SELECT s.id, coalesce(c.ls, '') AS capabilities, coalesce(d.ls, '') AS domains, 'zero_shot_nli_v1' AS method FROM samples s LEFT JOIN l c ON c.id = s.id AND c.axis = 'capabilities' LEFT JOIN l d ON d.id = s.id AND d.axis = 'domains'"""
    )
)
def model_label_stub(spark, sf_dir):
    def scorer():
        return lambda texts, candidates, hypothesis: [[((len(t) + 7 * i) % 10) / 10 for i, _ in enumerate(candidates)] for t in texts]

    rows = labeling.model_label(canon_conv(spark, sf_dir), scorer, *both())
    return rows.select("id", F.array_join("capabilities", ",").alias("capabilities"), F.array_join("domains", ",").alias("domains"), F.get_json_object("metadata", "$.domain_labeling.method").alias("method"))


EVENT_TEXT = """CASE event_type WHEN 'click' THEN '<tool_call>{"a":1}</tool_call> saw event_' || (event_id - 1) WHEN 'purchase' THEN '<tool_call> {broken} </tool_call> patch' ELSE 'nothing to do' END"""


def generations(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'view'")
    text = F.when(F.col("event_type") == "click", F.concat(F.lit('<tool_call>{"a":1}</tool_call> saw event_'), F.col("event_id") - 1)).when(F.col("event_type") == "purchase", "<tool_call> {broken} </tool_call> patch").otherwise("nothing to do")
    from sparloom.sources.parsers import turn

    seen = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Event_"), F.col("event_id") - F.col("event_id") % 2, F.lit(" gone")))
    return e.select(F.concat(F.lit("m"), F.col("user_id") % 3).alias("model_name"), F.col("event_id").alias("sample_id"), F.array(turn("tool", "observation", seen, False)).alias("messages"), text.alias("generation"), F.lit(0.5).alias("latency_seconds"), (F.col("event_id") % 100).alias("generated_tokens"))


EVAL = f"""g AS (SELECT 'm' || (user_id % 3) AS model_name, event_id, {EVENT_TEXT} AS t, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Event_' || (event_id - event_id % 2) || ' gone' END AS o FROM events WHERE event_type <> 'view'),
w AS (SELECT *, list_distinct([lower(x) FOR x IN regexp_extract_all(o, '[A-Za-z_][A-Za-z0-9_]{{3,}}')]) AS ow, list_distinct([lower(x) FOR x IN regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_]{{3,}}')]) AS tw FROM g),
m AS (SELECT model_name, event_id AS sample_id, contains(t, '<tool_call>') AS valid_tool_call, CASE WHEN len(ow) > 0 THEN len(list_intersect(ow, tw))::DOUBLE / len(ow) END AS overlap, contains(t, 'patch') AS patch_intent, event_id FROM w)"""


@query(f"WITH {EVAL} SELECT model_name, sample_id, valid_tool_call, overlap AS observation_overlap, coalesce(overlap >= 0.1, false) AS observation_grounded, patch_intent FROM m")
def eval_score(spark, sf_dir):
    return reports.score_generations(generations(spark, sf_dir)).select("model_name", "sample_id", "valid_tool_call", "observation_overlap", "observation_grounded", "patch_intent")


@query(
    f"WITH {EVAL} SELECT model_name, CAST(count(*) AS BIGINT) AS count, round(avg(valid_tool_call::INT), 6) AS valid_tool_call_rate, round(avg(patch_intent::INT), 6) AS patch_intent_rate, round(avg((overlap >= 0.1)::INT), 6) AS observation_grounded_rate, 0.5::DOUBLE AS avg_latency_seconds, round(avg(event_id % 100), 6) AS avg_generated_tokens FROM m GROUP BY 1"
)
def eval_summary(spark, sf_dir):
    rows = reports.summarize(reports.score_generations(generations(spark, sf_dir)))
    return rows.select("model_name", "count", *[F.round(c, 6).alias(c) for c in ("valid_tool_call_rate", "patch_intent_rate", "observation_grounded_rate", "avg_latency_seconds", "avg_generated_tokens")])


NAMED = "CASE role || ' ' || type WHEN 'system message' THEN 'system' WHEN 'user message' THEN 'user' WHEN 'assistant reasoning' THEN 'assistant_reasoning' WHEN 'assistant tool_call' THEN 'assistant_tool_call' WHEN 'assistant final' THEN 'assistant_final' END"
SEGMENTS = f"segs AS (SELECT conv_id, 2 * pos AS seg, '<|' || {NAMED} || E'|>\\n' AS text, false AS trainable FROM turns UNION ALL SELECT conv_id, 2 * pos + 1, trim(content, {S.BLANK}) || E'\\n', trainable FROM turns)"


@query(S.conv(f", {SEGMENTS} SELECT 'conv-' || conv_id AS id, CAST(seg AS INTEGER) AS seg, trainable, sha256(text) AS text_sha FROM segs"))
def transcript_segments(spark, sf_dir):
    return canon_conv(spark, sf_dir).select("id", F.posexplode(X.segments(F.col("messages"))).alias("seg", "s")).select("id", "seg", "s.trainable", F.sha2("s.text", 256).alias("text_sha"))


PROMPTS = f"f AS (SELECT conv_id, min(pos) AS p FROM turns WHERE role = 'assistant' GROUP BY 1), s AS (SELECT t.conv_id, coalesce(string_agg('<|' || {NAMED} || E'|>\\n' || trim(content, {S.BLANK}) || E'\\n', '' ORDER BY pos) FILTER (WHERE f.p IS NULL OR pos < f.p), '') || E'<|assistant_final|>\\n' AS p FROM turns t LEFT JOIN f USING (conv_id) GROUP BY 1)"


@query(S.conv(f", {PROMPTS} SELECT 'conv-' || conv_id AS id, sha256(p) AS prompt_sha FROM s"))
def eval_prompt(spark, sf_dir):
    return canon_conv(spark, sf_dir).select("id", F.sha2(X.eval_prompt(F.col("messages")), 256).alias("prompt_sha"))


@query(S.conv(f", {PROMPTS} SELECT 'conv-' || conv_id AS sample_id, 'echo' AS model_name, sha256(left(p, 50)) AS generation_sha, CAST(length(p) AS BIGINT) AS generated_tokens FROM s"))
def eval_generations(spark, sf_dir):
    """The generation loop with a stand-in for a model."""
    prompts = canon_conv(spark, sf_dir).select(F.col("id").alias("sample_id"), X.eval_prompt(F.col("messages")).alias("prompt"))
    rows = reports.generations(prompts, "echo", lambda: lambda p: (p[:50], len(p)), 4)
    return rows.select("sample_id", "model_name", F.sha2("generation", 256).alias("generation_sha"), "generated_tokens")


@query(
    """WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type || ' event_' || event_id AS c, CASE WHEN event_type IN ('signup', 'view') THEN 'user' WHEN event_type IN ('click', 'purchase') THEN 'assistant' ELSE 'tool' END AS role FROM events),
o AS (SELECT user_id, min(pos) AS o FROM t WHERE role = 'tool' GROUP BY 1), a AS (SELECT t.user_id, min(pos) AS a FROM t JOIN o USING (user_id) WHERE role = 'assistant' AND pos > o GROUP BY 1)
SELECT 'user-' || t.user_id AS id, sha256(coalesce(string_agg('<|' || CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant_final' ELSE 'tool_observation' END || E'|>\\n' || c || E'\\n', '' ORDER BY pos) FILTER (WHERE a IS NULL OR pos < a), '') || E'<|assistant_final|>\\n') AS prompt_sha FROM t LEFT JOIN a USING (user_id) GROUP BY t.user_id"""
)
def eval_prompt_after_observation(spark, sf_dir):
    return canon_events(spark, sf_dir).select("id", F.sha2(X.eval_prompt(F.col("messages"), "after_first_observation"), 256).alias("prompt_sha"))


class CodePoints:
    """A tokenizer of one id per character."""

    eos_id = 0

    def __call__(self, text: str) -> list[int]:
        return [ord(c) for c in text]


@query(
    S.conv(
        f""", {SEGMENTS}, c AS (SELECT conv_id, seg, trainable, [unicode(x) FOR x IN string_split(text, '')] AS ids FROM segs),
n AS (SELECT conv_id, list_append(flatten(list(ids ORDER BY seg)), 0) AS ids, list_append(flatten(list(CASE WHEN trainable THEN ids ELSE [-100 FOR x IN ids] END ORDER BY seg)), CASE WHEN arg_max(trainable, seg) THEN 0 ELSE -100 END) AS labels FROM c GROUP BY 1)
SELECT 'conv-' || conv_id AS id, CAST(len(ids) AS INTEGER) AS n_ids, sha256(array_to_string(ids, ',')) AS ids_sha, sha256(array_to_string(labels, ',')) AS labels_sha FROM n"""
    )
)
def loss_mask(spark, sf_dir):
    rows = reports.loss_mask(canon_conv(spark, sf_dir), CodePoints, 1 << 30)
    digest = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)
    return rows.select("id", F.size("input_ids").alias("n_ids"), digest("input_ids").alias("ids_sha"), digest("labels").alias("labels_sha"))


@query(S.conv(f", {SEGMENTS}, n AS (SELECT conv_id, sum(length(text)) + 1 AS n FROM segs GROUP BY 1) SELECT 'conv-' || conv_id AS id, CAST(n AS INTEGER) AS n_ids, true AS fits FROM n"))
def padded_batches(spark, sf_dir):
    """Examples in padded batches: ids without their padding, and whether all rows of a batch are of one length and at most four."""
    rows = reports.padded(reports.loss_mask(canon_conv(spark, sf_dir), CodePoints, 1 << 30), 7, 4)
    rows = rows.select("id", "batch", F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("n_ids"), F.size("input_ids").alias("wide"), F.size("labels").alias("n_labels"))
    batch = Window.partitionBy("batch")
    fits = (F.min("wide").over(batch) == F.max("wide").over(batch)) & (F.count("*").over(batch) <= 4) & (F.col("n_labels") == F.col("wide"))
    return rows.select("id", "n_ids", fits.alias("fits"))


@query(
    """WITH n AS (SELECT 0 AS o, 'conversations' AS source, count(*) AS n FROM (SELECT DISTINCT conv_id FROM conversations JOIN documents ON conv_id = doc_id) UNION ALL SELECT 1, 'documents', count(*) FROM documents UNION ALL SELECT 2, 'events', count(DISTINCT user_id) FROM events)
SELECT source, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (ORDER BY o) - n AS BIGINT) AS first_idx, CAST(sum(n) OVER (ORDER BY o) - 1 AS BIGINT) AS last_idx FROM n"""
)
def union_sources(spark, sf_dir):
    """Files of JSON lines, one after the other."""
    base = scratch(spark, "union")
    for name, make in (("conversations", canon_conv), ("documents", canon_docs), ("events", canon_events)):
        io.write_jsonl(make(spark, sf_dir), f"{base}/{name}")
    rows = io.union_sources(spark, [f"{base}/{n}" for n in ("conversations", "documents", "events")])
    kind = F.when(F.col("id").startswith("conv-"), "conversations").when(F.col("id").startswith("doc-"), "documents").otherwise("events")
    return rows.groupBy(kind.alias("source")).agg(F.count("*").alias("n"), F.min("row_idx").alias("first_idx"), F.max("row_idx").alias("last_idx"))


def raw_lines(spark, sf_dir):
    """Conversations as raw JSON rows; every seventh has a role that no one knows."""
    t = raw_turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("t"))
    role = lambda x: F.when((F.col("conv_id") % 7 == 0) & (x["turn"] == 0), "narrator").otherwise(x["role"])
    msgs = F.transform("t", lambda x: F.struct(role(x).alias("role"), x["content"].alias("content")))
    return t.select(F.col("conv_id").alias("row_idx"), F.to_json(F.struct(F.concat(F.lit("conv-"), F.col("conv_id")).alias("id"), (F.col("conv_id") % 2).alias("reward"), msgs.alias("messages"))).alias("value"))


@query(
    S.all_conv(
        """SELECT metric, CAST(n AS BIGINT) AS n FROM (SELECT 'seen' AS metric, count(*) AS n FROM ok UNION ALL SELECT 'parsed', count(*) FROM ok WHERE NOT bad UNION ALL SELECT 'errors', count(*) FROM ok WHERE bad UNION ALL SELECT 'error:ValueError', count(*) FROM ok WHERE bad HAVING count(*) > 0
 UNION ALL SELECT 'written', count(*) FROM ok WHERE fit AND quality_score >= 0.45 UNION ALL SELECT 'skipped', count(*) FROM ok WHERE NOT (fit AND quality_score >= 0.45))"""
    )
)
def stream_convert_stats(spark, sf_dir):
    stats = conversion_stats(converted(raw_lines(spark, sf_dir), "agenttrove", "landing", 0.45, *both()))
    return stats.select("metric", F.col("value").alias("n"))


@query(S.all_conv("SELECT CAST(conv_id AS BIGINT) AS row_idx, 'ValueError' AS type, 'unknown role: narrator' AS message, 'id,messages,reward' AS keys FROM ok WHERE bad ORDER BY conv_id LIMIT 5"))
def error_examples(spark, sf_dir):
    rows = ingest_errors(converted(raw_lines(spark, sf_dir), "agenttrove", "landing"), 5)
    return rows.select("row_idx", "type", "message", F.array_join("keys", ",").alias("keys"))


@query(S.all_conv("SELECT id, 'agent' AS sample_type, CAST((SELECT count(*) FROM turns t WHERE t.conv_id = ok.conv_id) AS INTEGER) AS n_turns, CAST(n_train AS INTEGER) AS n_trainable, true AS tools_present, 'ENGLISH_PROSE' AS by_category FROM ok"))
def hermes_rows(spark, sf_dir):
    """The other raw layout, with tools and a category that names a domain."""
    t = raw_turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("t"))
    said = F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["content"].alias("value")))
    value = F.to_json(F.struct(F.concat(F.lit("conv-"), F.col("conv_id")).alias("id"), F.lit("english").alias("category"), F.lit("[search]").alias("tools"), said.alias("conversations")))
    rows = parse(t.select(F.col("conv_id").alias("row_idx"), value.alias("value")), "hermes", "landing").select("sample.*")
    trained = F.size(F.filter("messages", lambda m: m["trainable"]))
    present = F.get_json_object("metadata", "$.tools_present") == "true"
    return rows.select("id", "sample_type", F.size("messages").alias("n_turns"), trained.alias("n_trainable"), present.alias("tools_present"), F.when(F.array_contains("domains", "ENGLISH_PROSE"), "ENGLISH_PROSE").alias("by_category"))


@query(S.all_conv("SELECT id, sample_type, CAST((SELECT count(*) FROM turns t WHERE t.conv_id = ok.conv_id) AS INTEGER) AS n_turns, success, quality_score FROM ok WHERE fit"))
def stream_ingest(spark, sf_dir):
    """Landed JSON lines through the streaming converter, and what it wrote."""
    from sparloom.streaming.ingest import stream_convert

    base = scratch(spark, "stream")
    raw_lines(spark, sf_dir).select("value").write.text(f"{base}/in")
    stream_convert(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", "agenttrove", "landing").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id", "sample_type", F.size("messages").alias("n_turns"), "success", "quality_score")


@query(
    S.classifier_labels(
        f""", n AS ({S.name_rows()}) SELECT id, array_to_string(capabilities, ',') AS labels, array_to_string(domains, ',') AS domains, (SELECT string_agg(CAST(list_contains(s.capabilities, label) AS INTEGER)::VARCHAR, '' ORDER BY ord) FROM n WHERE axis = 'capabilities') AS bits,
 '{{"quality_score":0.0,"success":' || coalesce(success::VARCHAR, 'null') || ',"capabilities":[],"domains":[]}}' AS metadata FROM scored s WHERE len(capabilities) > 0 OR len(domains) > 0"""
    )
)
def classifier_export(spark, sf_dir):
    rows = labeling.classifier_rows(canon_conv(spark, sf_dir), *both(), min_score=0.5)
    return rows.select("id", F.array_join("labels", ",").alias("labels"), F.array_join("domains", ",").alias("domains"), F.array_join(F.transform("label_vector", lambda x: x.cast("string")), "").alias("bits"), "metadata")


CLASSIFIER = "CASE WHEN length(rendered) <= 12000 THEN rendered ELSE left(rendered, 6000) || E'\\n\\n[...truncated...]\\n\\n' || right(rendered, 6000) END"


@query(S.conv(f"SELECT id, sha256({S.prompt_head(False)} || E'Conversation:\\n' || {CLASSIFIER} || E'\\nAnswer:') AS prompt_sha, '{{{{\"quality_score\":0.0,\"success\":' || coalesce(success::VARCHAR, 'null') || ',\"existing_capabilities\":[],\"existing_domains\":[]}}}}' AS metadata FROM samples".replace("{{", "{").replace("}}", "}")))
def labeling_prompts(spark, sf_dir):
    return labeling.prompt_rows(canon_conv(spark, sf_dir), *both()).select("id", F.sha2("prompt", 256).alias("prompt_sha"), "metadata")


CAPS = list(Taxonomy.load().names)


@query(
    S.lab(
        f""", o AS (SELECT row_number() OVER (ORDER BY conv_id) AS r, id, capabilities AS c, domains AS d FROM scored WHERE len(capabilities) > 0 OR len(domains) > 0),
q AS (SELECT 0::BIGINT AS r, {[2] * len(CAPS)} AS left_, false AS taken, NULL::VARCHAR AS id, CAST([] AS VARCHAR[]) AS c, CAST([] AS VARCHAR[]) AS d
 UNION ALL SELECT o.r, CASE WHEN t THEN [q.left_[i] - CAST(list_contains(o.c, {S.strings(CAPS)}[i]) AS INTEGER) FOR i IN range(1, {len(CAPS) + 1})] ELSE q.left_ END, t, o.id, o.c, o.d
 FROM (SELECT q.*, o.r AS r2, list_max(q.left_) > 0 AND (len(o.c) = 0 OR list_max([q.left_[i] FOR i IN range(1, {len(CAPS) + 1}) IF list_contains(o.c, {S.strings(CAPS)}[i])]) > 0) AS t FROM q JOIN o ON o.r = q.r + 1) q JOIN o ON o.r = q.r2)
SELECT id, array_to_string(c, ',') AS capabilities, array_to_string(d, ',') AS domains FROM q WHERE taken"""
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def icl_examples(spark, sf_dir):
    """Examples for prompts, until each capability has two."""
    rows = labeling.icl_rows(labelled(spark, sf_dir), *both(), allow_weak=True)
    return rows.select("id", F.array_join("capabilities", ",").alias("capabilities"), F.array_join("domains", ",").alias("domains"))
