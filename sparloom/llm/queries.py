"""Queries opN_<name> over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm.common import table
from sparloom.llm.decontaminate import benchmark_matches
from sparloom.llm.kd_shards import kd_shards
from sparloom.llm.licenses import license_matches
from sparloom.llm.media import media_columns
from sparloom.llm.mixing import mixing_plan
from sparloom.llm.pii import KINDS as PII_KINDS
from sparloom.llm.pii import base_spans, pii_spans
from sparloom.llm.secrets import KINDS, secret_spans
from sparloom.llm.simhash import near_duplicates
from sparloom.llm.token_files import read_token_files, write_token_files
from sparloom.llm.toxicity import held_out, toxicity_scores, train_on


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity_scores(docs, train_on(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_columns(table(spark, sf_dir, "documents"))
    size = F.octet_length("payload")
    prints = F.concat(F.to_binary(F.concat(F.lit("t"), F.array_join("times", ",")), F.lit("utf-8")), F.to_binary(F.concat(F.lit("p"), F.array_join("prints", ",")), F.lit("utf-8")))
    return found.select(
        "doc_id",
        F.col("n_bytes"),
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("prints"), F.sha2(prints, 256)).alias("feature"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[counted(F.col("base"), k).alias(f"n_{k}") for k in PII_KINDS[:4]],
        F.sha2(spelled(F.col("base"), PII_KINDS), 256).alias("base_sha256"),
        spelled(F.concat("base", "terms"), PII_KINDS).alias("spans"),
        "sanitized",
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["start"], r["end"])), ",").alias("hit_runs"),
        "longest",
    )


def spelled(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of spans by start, then kind as listed, then end; each once; comma-joined."""
    rank = lambda k: F.array_position(F.array(*[F.lit(x) for x in kinds]), k)
    keyed = F.array_sort(F.array_distinct(F.transform(spans, lambda x: F.struct(x["start"].alias("a"), rank(x["kind"]).alias("k"), x["end"].alias("b"), x["kind"].alias("n")))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["n"], x["a"], x["b"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[counted(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(spelled(F.col("base"), KINDS), 256).alias("base_sha256"),
        spelled(F.concat("base", "inner"), KINDS).alias("spans"),
    )


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of operator 5 alone, which SQL can express."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = base_spans(rows, "text").select("doc_id", F.concat(*PII_KINDS[:4]).alias("base"))
    return found.select("doc_id", *[counted(F.col("base"), k).alias(f"n_{k}") for k in PII_KINDS[:4]], F.sha2(spelled(F.col("base"), PII_KINDS), 256).alias("base_sha256"))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of operator 7 alone, which SQL can express."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[counted(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(spelled(F.col("base"), KINDS), 256).alias("base_sha256"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads of operator 2 as they are read back, which SQL can express."""
    found = media_columns(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_matches(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses.name", ",").alias("licenses"), F.round(F.array_max("licenses.containment"), 4).alias("containment"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kd_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_media": op2_media,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_secrets": op7_secrets,
    "op8_token_files": op8_token_files,
    "op9_licenses": op9_licenses,
    "op10_kd_shards": op10_kd_shards,
    "base_pii": base_pii,
    "base_secrets": base_secrets,
    "media_payloads": media_payloads,
}

#: Sources of r = 3 * size / weight below the level are full; the level is that of the first source that is not.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS BIGINT) AS size,
         coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) AS name
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS r, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
         CAST(coalesce(sum(source_size) OVER w, 0) AS DOUBLE) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS free
  FROM s WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(arg_min((total - 3.0::DOUBLE * held) / free, r) FILTER (WHERE (total - 3.0::DOUBLE * held) / free < r), 0.0::DOUBLE) AS share FROM f),
t AS (
  SELECT source, source_size, CASE WHEN weight * share >= 3.0::DOUBLE * source_size THEN 3.0::DOUBLE * source_size ELSE weight * share END AS target,
         CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN weight * share >= 3.0::DOUBLE * source_size THEN 3.0::DOUBLE ELSE weight * share / source_size END AS rate
  FROM s, l),
c AS (
  SELECT d.doc_id, d.size, t.*, k, floor(rate) + CASE WHEN CAST('0x' || substr(md5('42:' || k || ':' || name), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, range(32) r(k)),
p AS (SELECT source, arg_min(k, (miss, k)) AS pick FROM (SELECT source, k, abs(sum(copies * size) - min(target)) AS miss FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(copies * c.size AS BIGINT) AS taken
FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source AND c.k = p.pick
"""

#: Windows as joined words; a hit is a word position that an occurrence of a window covers; hit_runs are start-end of hit
#: words, longest the words of the longest verbatim match (windows in a row at the same shift).
OP6_SQL = r"""
WITH low AS (SELECT 'd' AS side, doc_id AS id, 0 AS row, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, row_number() OVER (), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT side, id, row, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low),
items AS (SELECT id, row, i AS j, least(len(w), 10) AS n, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS g FROM (SELECT id, row, w, unnest(range(greatest(len(w) - 9, least(len(w), 1)))) AS i FROM w WHERE side = 'b')),
sizes AS (SELECT DISTINCT n FROM items),
grams AS (SELECT w.id AS doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM w, sizes WHERE side = 'd') w),
met AS (SELECT doc_id, grams.n, i, j, row, items.id AS item_id FROM grams JOIN items USING (n, g)),
chains AS (SELECT doc_id, count(*) + min(n) - 1 AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, row, i - j ORDER BY i) AS chain FROM met) GROUP BY doc_id, row, i - j, chain),
longest AS (SELECT doc_id, max(size) AS longest FROM chains GROUP BY 1),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM met),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 1 AS b FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM places) GROUP BY doc_id, run),
hit AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_hit, string_agg(a || '-' || b, ',' ORDER BY a) AS hit_runs FROM runs GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM met) GROUP BY 1)
SELECT w.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(hit_runs, '') AS hit_runs, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM w LEFT JOIN hit ON hit.doc_id = w.id LEFT JOIN named ON named.doc_id = w.id LEFT JOIN longest ON longest.doc_id = w.id WHERE side = 'd'
"""

def spans_sql(kinds: list[tuple[str, str, int, str]]) -> str:
    """Counts and digest of the matches of (kind, pattern, group, test of a match v and its group w) in each text."""
    found = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {i} AS ord, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {g}) AS w, string_split_regex(t, '{p}') AS g FROM t" for i, (k, p, g, _) in enumerate(kinds))
    sure = " OR ".join(f"kind = '{k}' AND {test}" for k, _, _, test in kinds)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
x AS (SELECT doc_id, kind, ord, m, g, unnest(range(len(m))) AS i FROM f),
y AS (SELECT doc_id, kind, ord, i, m[i + 1] AS v, coalesce(list_sum([length(g[j + 1]) FOR j IN range(i + 1)]), 0) + coalesce(list_sum([length(m[j + 1]) FOR j IN range(i)]), 0) AS a FROM x),
z AS (SELECT y.*, f.w[i + 1] AS w, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM y JOIN f USING (doc_id, kind)),
s AS (SELECT doc_id, kind, ord, CAST(a AS BIGINT) AS a, CAST(a + length(v) AS BIGINT) AS b FROM z WHERE {sure})
SELECT t.doc_id, {", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS n_{k}" for k, *_ in kinds)},
       sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord, b), '')) AS base_sha256
FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id"""


BYTES_SQL = "len([p FOR p IN string_split(v, '.') IF length(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 3) AS INTEGER) > 255]) = 0"
LUHN_SQL = "length(d) BETWEEN 12 AND 19 AND list_sum([CASE WHEN (CAST(d[length(d) - j] AS INTEGER) * (1 + j % 2)) > 9 THEN CAST(d[length(d) - j] AS INTEGER) * (1 + j % 2) - 9 ELSE CAST(d[length(d) - j] AS INTEGER) * (1 + j % 2) END FOR j IN range(length(d))]) % 10 = 0"
PII_SQL = spans_sql(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, BYTES_SQL),
        ("card", r"[0-9]([\x20-]?[0-9])+", 0, LUHN_SQL),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, "length(d) BETWEEN 9 AND 15"),
    ]
)
NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
QUOTE = "[\"'']"  # a quote or an apostrophe, inside a string of SQL
SECRETS_SQL = spans_sql(
    [
        ("assign", rf"({NAMES})" + QUOTE + r"?\x20*[:=]\x20*" + QUOTE + r"?([A-Za-z0-9+/_.=-]+)", 2, "length(w) >= 8"),
        ("access", r"AKIA[A-Z0-9]+", 0, "length(v) >= 16"),
        ("hex", r"[0-9a-f]{32,}", 0, "true"),
    ]
)
MEDIA_SQL = r"""WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS n, CASE WHEN octet_length(b) = 0 THEN 576 ELSE (576 - octet_length(b) % 576) % 576 END AS more FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n + more AS BIGINT) AS payload_bytes, sha256(b || unhex(repeat('FF', CAST(more AS INTEGER)))) AS payload_sha256 FROM n"""

SQL: dict[str, str] = {"op6_decontamination": OP6_SQL, "op4_mixing": OP4_SQL, "base_pii": PII_SQL, "base_secrets": SECRETS_SQL, "media_payloads": MEDIA_SQL}
