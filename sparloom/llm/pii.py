"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame functions only (operator 5).

Base spans: e-mail addresses, IP numbers, card numbers (Luhn) and phone numbers, leftmost and non-overlapping for each kind.
A match and the text before it give its place: lengths of both are summed in blocks, so a text with very many matches
takes time in proportion.

Sanitisation: a base span's value (of cards and phones the digits, else in lower case) is a protected entity e. A term t is a
run of letters and digits, in lower case, and may reveal e wherever the two stand in one text. Over all N rows: D(t) rows
hold t, D(e) rows hold e, D(t,e) rows hold both. Information content IC(e) = log2(N / D(e)); what t tells about e is
PMI(t,e) = log2(D(t,e) N / (D(t) D(e))), at most IC(e). Few meetings say little, and copies of a text say nothing new, so
the estimate is drawn in by m / (m + `prior`), where m is the number of different texts in which t and e meet; no pair is
left out. t discloses e if the estimate reaches `disclosure` IC(e). In every text that holds e, all places of such terms
outside base spans are spans of kind `term`. In the sanitised text a span is generalised to its kind, and a term with digits
to [NUMBER].

Size: entities that stand in the same texts tell the same, so they are counted as one class (a class is named by the 128-bit
sum of its texts' keys). PMI is at most log2(N / D(t)), so terms that are too frequent for the entities of a text go before
classes and terms are paired; what is left per text is its rare terms. Counts are summed in each task before they are shuffled.

Defined cases: a null text is empty and has no spans. Rows with the same doc_id, and equal rows, each get a row, and count
as rows. An entity in every row has no content, so nothing discloses it. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import free_name, hash128, materialize

KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns, with possessive repeats where giving back can't lead to a match, and starts only where a leftmost
#: match can start: both only save steps.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a match of the kind to stand; cheaper than the pattern.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BLOCK = 128  # matches whose places are summed together
WORDS = 256  # words and signs that are looked up together
#: Cuts a string at every sign that is not a letter or digit, on both of its sides.
BOUNDARY = r"(?<=[^\p{L}\p{N}])|(?=[^\p{L}\p{N}])"
NOT_TERM = r"[^\p{L}\p{N}]+"
SLACK = 1e-9  # of comparisons of logarithms
SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def let(values: dict[str, str], body: str) -> str:
    """body with v.<name> for each value, which is worked out once. A column of an inner projection may be put into a lambda and
    worked out for each of its elements instead."""
    return f"transform(array(named_struct({', '.join(f"'{k}', {x}" for k, x in values.items())})), v -> {body})[0]"


def base_spans(rows: DataFrame, text: str) -> DataFrame:
    """rows with a column for each base kind: array of (kind, start, end, value)."""
    others, t = rows.columns, F.col(text)
    none = F.array().cast("array<string>")
    found = rows.select(*others, *[c for k, p in PATTERNS.items() for c in (F.when(HINTS[k](t), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}"), F.when(HINTS[k](t), F.split(t, p, -1)).otherwise(none).alias(f"g_{k}"))])
    sized = found.select(*others, *[f"m_{k}" for k in PATTERNS], *[F.expr(f"transform(m_{k}, (m, i) -> named_struct('gap', cast(length(g_{k}[i]) as bigint), 'len', cast(length(m) as bigint)))").alias(f"l_{k}") for k in PATTERNS])
    blocks = "sequence(0, (size(l_{k}) - 1) div {b})"
    offsets = f"aggregate(transform({blocks}, b -> aggregate(slice(l_{{k}}, b * {{b}} + 1, {{b}}), 0L, (s, x) -> s + x.gap + x.len)), array(0L), (s, x) -> concat(s, array(element_at(s, -1) + x)))"
    places = f"""flatten(transform({blocks}, b -> aggregate(slice(l_{{k}}, b * {{b}} + 1, {{b}}),
        named_struct('at', v.o[b], 'out', cast(array() as array<struct<a:bigint,b:bigint>>)),
        (s, x) -> named_struct('at', s.at + x.gap + x.len, 'out', concat(s.out, array(named_struct('a', s.at + x.gap, 'b', s.at + x.gap + x.len)))), s -> s.out)))"""
    placed = sized.select("*", *[F.expr(let({"o": offsets.format(k=k, b=BLOCK)}, places.format(k=k, b=BLOCK))).alias(f"p_{k}") for k in PATTERNS])

    def spans(k: str) -> Column:
        whole = F.expr(f"transform(p_{k}, (p, i) -> named_struct('kind', '{k}', 'start', p.a, 'end', p.b, 'value', m_{k}[i]))")
        return F.filter(whole, lambda x: valid(k, x["value"]))

    return placed.select(*others, *[spans(k).alias(k) for k in PATTERNS])


def words_of(text: str | Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(text, NOT_TERM), lambda w: w != ""), F.lower))


def entity(x: Column) -> Column:
    """The protected value of a base span."""
    return F.concat_ws(":", x["kind"], F.when(x["kind"].isin("card", "phone"), F.regexp_replace(x["value"], "[^0-9]", "")).otherwise(F.lower(x["value"])))


def all_places(texts: DataFrame, text: str, terms: str) -> DataFrame:
    """texts with column `terms` (array of strings) replaced by the spans of these terms in the text, which is dropped.

    A block of words is first intersected with the terms, so words are compared with the few that stand in their block.
    """
    w, block = (free_name(texts, x) for x in ("_w", "_block"))
    others = [c for c in texts.columns if c not in (text, terms)]
    cut = texts.select(*others, terms, F.split(text, BOUNDARY, -1).alias(w))
    cut = cut.select("*", F.expr(f"transform(sequence(0, (size({w}) - 1) div {WORDS}), b -> slice({w}, b * {WORDS} + 1, {WORDS}))").alias(block))
    cut = cut.select(*others, terms, block)
    starts = f"aggregate(transform({block}, x -> aggregate(x, 0L, (s, y) -> s + length(y))), array(0L), (s, x) -> concat(s, array(element_at(s, -1) + x)))"
    met = f"filter(transform({block}, (x, b) -> named_struct('at', v.at[b], 'x', x, 'hit', array_intersect(transform(x, y -> lower(y)), v.terms))), k -> size(k.hit) > 0)"
    cut = cut.select(*others, F.expr(let({"at": starts, "terms": terms}, met)).alias(block))
    spans = f"""flatten(transform({block}, k -> aggregate(k.x,
        named_struct('at', k.at, 'out', cast(array() as {SPANS})),
        (s, x) -> named_struct('at', s.at + length(x), 'out', if(array_contains(k.hit, lower(x)), concat(s.out, array(named_struct('kind', 'term', 'start', s.at, 'end', s.at + length(x), 'value', lower(x)))), s.out)), s -> s.out)))"""
    return cut.select(*others, F.expr(spans).alias(terms))


def disclosing_terms(rows: DataFrame, text: str, held: DataFrame, n: int, disclosure: float, prior: float) -> DataFrame:
    """(key, terms): the terms of each text of `held` that disclose one of its entities; held has (key, rows, base, text)."""
    bits = lambda d: F.log2(F.lit(float(max(n, 1))) / d)
    mention = held.select("key", "rows", F.explode(F.array_distinct(F.transform("base", entity))).alias("entity"))
    entities = mention.groupBy("entity").agg(F.sum("rows").alias("d_e"), F.bit_xor("key.a").alias("a"), F.bit_xor("key.b").alias("b")).where(F.col("d_e") < n)
    entities = materialize(entities.select("entity", "d_e", F.struct("a", "b").alias("class")), "entities")
    most = entities.agg(F.max("d_e")).first()[0]
    if most is None:
        return held.select("key", F.array().cast("array<string>").alias("terms")).limit(0)
    classes = materialize(mention.join(entities, "entity").select("key", "rows", "class", "d_e").distinct(), "classes")
    # D(t) for terms that stand in a text with an entity and are not too frequent for any
    words = held.select("key", F.explode(words_of("text")).alias("term"))
    whole = rows.select(F.explode(words_of(text)).alias("term")).groupBy("term").agg(F.count("*").alias("d_t"))
    known = whole.join(words.groupBy("term").agg(F.count("*").alias("texts")), "term")
    known = materialize(known.where(bits(F.col("d_t")) >= disclosure * bits(F.lit(float(most))) - SLACK).select("term", "d_t"), "known")
    rare = words.join(known, "term").join(classes, "key").where(bits(F.col("d_t")) >= disclosure * bits(F.col("d_e")) - SLACK)
    rare = materialize(rare.select("key", "rows", "class", "term", "d_t", "d_e"), "rare")
    met = rare.groupBy("class", "term").agg(F.sum("rows").alias("d_te"), F.count("*").alias("m"), F.first("d_t").alias("d_t"), F.first("d_e").alias("d_e"))
    tells = bits(F.col("d_t") * F.col("d_e") / F.col("d_te")) * F.col("m") / (F.col("m") + F.lit(prior))
    telling = materialize(met.where(tells >= disclosure * bits(F.col("d_e")) - SLACK).select("class", "term"), "telling")
    return rare.join(telling, ["class", "term"]).groupBy("key").agg(F.collect_set("term").alias("terms"))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.7, prior: float = 0.25) -> DataFrame:
    """Per row of docs: doc_id, base and terms: arrays of (kind, start, end, value), sanitized string (null where the text has no span)."""
    ident, key, text = (free_name(docs, x) for x in ("_doc", "_key", "_text"))
    rows = docs.select(F.col(id_col).alias(ident), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text))
    rows = rows.withColumn(key, hash128(F.col(text)))
    found = base_spans(rows, text).select(F.col(ident).alias("doc_id"), F.col(key).alias("key"), F.concat(*PATTERNS).alias("base"), F.col(text).alias("text"))
    # only texts with a base span are kept and go on
    found = materialize(found.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "base", wide=True)
    held = found.where(F.size("base") > 0).groupBy("key").agg(F.count("*").alias("rows"), F.first("base").alias("base"), F.first("text").alias("text"))
    held = materialize(held, "held", wide=True)
    telling = disclosing_terms(rows, text, held, found.count(), disclosure, prior)
    none = F.array().cast(SPANS)
    placed = all_places(held.join(telling, "key", "left").select("key", "base", "text", F.col("text").alias("whole"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms")), "text", "terms")
    placed = placed.withColumn("terms", F.filter("terms", lambda t: ~F.exists("base", lambda x: (x["start"] <= t["start"]) & (t["end"] <= x["end"]))))
    marked = placed.withColumn("spans", united(F.concat("base", "terms")))
    marked = materialize(marked.select("key", "terms", sanitized("whole", "spans").alias("sanitized")), "marked", wide=True)
    out = found.where(F.size("base") > 0).select("doc_id", "key", "base").join(marked, "key").select("doc_id", "base", "terms", "sanitized")
    return out.union(found.where(F.size("base") == 0).select("doc_id", none.alias("base"), none.alias("terms"), F.lit(None).cast("string").alias("sanitized")))


def united(spans: Column) -> Column:
    """Ordered (start, end, name) of spans (kind, start, end, value); those that overlap become one, named by the first."""
    struct = "array<struct<start:bigint,end:bigint,name:string>>"
    named = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when((x["kind"] == "term") & F.rlike(x["value"], F.lit("[0-9]")), F.lit("NUMBER")).otherwise(F.upper(x["kind"])).alias("name"))))
    last = lambda s, f: F.try_element_at(s, F.lit(-1))[f]
    grown = lambda s, x: F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct(last(s, "start").alias("start"), F.greatest(last(s, "end"), x["end"]).alias("end"), last(s, "name").alias("name"))))
    return F.aggregate(named, F.array().cast(struct), lambda s, x: F.when(F.coalesce(last(s, "end"), F.lit(-1)) > x["start"], grown(s, x)).otherwise(F.concat(s, F.array(x))))


def sanitized(text: str, spans: str) -> Column:
    """The text with [NAME] for each span of united()."""
    cut = "transform(v.x, (x, i) -> concat(substring(v.t, cast(if(i = 0, 0, v.x[i - 1].end) + 1 as int), cast(x.start - if(i = 0, 0, v.x[i - 1].end) as int)), '[', x.name, ']'))"
    rest = "substring(v.t, cast(coalesce(try_element_at(v.x, -1).end, 0) + 1 as int), length(v.t))"
    return F.expr(let({"x": spans, "t": text}, f"concat(array_join({cut}, ''), {rest})"))
