"""Bindings of every operator to the driver tables.

Each entry is a Spark job over whole tables (``spark, root -> DataFrame``) plus,
where SQL can say the same thing, an independent DuckDB statement over the same
Parquet files.  The travel dictionaries almost never occur in the driver's text,
so the keyword operators are bound with dictionaries drawn from that text; the
travel defaults are covered by unit tests.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions import text as TX
from ..functions import vectors as V
from ..operators import chunks as CH
from ..operators import keywords as KW
from ..operators import metrics as M
from ..operators import relational as R
from ..operators import search as S
from ..operators import serving as SV
from ..operators import split as SP
from ..operators import validate as VA
from ..sources import tables as TB
from . import sqltext as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def t(spark: SparkSession, root: str, name: str) -> DataFrame:
    return TB.read_table(spark, root, name)


# ---------------------------------------------------------------------------
# Driver bindings: dictionaries and domains drawn from the driver's text.
# ---------------------------------------------------------------------------
DOC_DICT = {
    "Alpha": ["thing", "able", "tion", "ment", "ing"],
    "Beta": ["nicht", "und", "ein", "sch"],
    "Gamma": ["que", "eau", "pour", "avec"],
}
DOC_THRESHOLDS = {"Alpha": 3, "Beta": 2, "Gamma": 1}
TIER_LOW = ["the", "and", "of"]
TIER_HIGH = ["der", "die", "les", "la"]
LANGS = ["en", "fr", "de", "es", "it"]
ENTITY_LANGS = ["en", "fr", "de"]
QUALITY_LABELS = ["good", "poor"]


def doc_name(c="doc_id"):
    return F.concat(F.lit("doc"), F.col(c).cast("string"))


def doc_wikitext(docs: DataFrame) -> DataFrame:
    """Wiki markup composed from the whole document: its lines are dealt in turn
    to the sections Understand, Do and Sleep."""
    arr = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")

    def dealt(k):
        return F.array_join(F.filter(arr, lambda x, i: i % 3 == k), "\n")
    w = F.concat(F.lit("==Understand==\n"), dealt(0), F.lit("\n==Do==\n"), dealt(1), F.lit("\n== Sleep ==\n"), dealt(2))
    return docs.select(*[c for c in docs.columns if c != "text"], doc_name().alias("name"), w.alias("wikitext"))


def doc_articles(spark, root, docs: DataFrame | None = None) -> DataFrame:
    docs = docs if docs is not None else t(spark, root, "documents")
    return TB.wikitext_to_article(doc_wikitext(docs), "wikitext")


SQL_WIKI = f"""
d0 AS (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, lang, source, 'doc' || CAST(doc_id AS VARCHAR) AS name,
  '==Understand==' || chr(10) || array_to_string(list_filter(l, lambda x, i: (i - 1) % 3 = 0), chr(10))
  || chr(10) || '==Do==' || chr(10) || array_to_string(list_filter(l, lambda x, i: (i - 1) % 3 = 1), chr(10))
  || chr(10) || '== Sleep ==' || chr(10) || array_to_string(list_filter(l, lambda x, i: (i - 1) % 3 = 2), chr(10))
  AS wikitext FROM d0),
art AS (SELECT doc_id, lang, source, name,
  {Q.section('wikitext', 'Understand')} AS understand,
  {Q.section('wikitext', 'Do')} AS "do",
  {Q.section('wikitext', 'Sleep')} AS sleep,
  wikitext AS full_text FROM w)"""


def sql_keyword_cols(text_expr: str, dictionary=DOC_DICT, thresholds=DOC_THRESHOLDS) -> str:
    low = f"lower(coalesce({text_expr}, ''))"
    counts = {c: Q.hits(low, kws) for c, kws in dictionary.items()}
    total = "greatest(" + " + ".join(counts.values()) + ", 1)"
    cols = []
    for c, e in counts.items():
        k = c.lower()
        cols.append(f"CAST({e} AS BIGINT) AS {k}_keyword_count")
        cols.append(f"CAST(CASE WHEN {e} >= {thresholds[c]} THEN 1 ELSE 0 END AS BIGINT) AS {k}_keyword_binary")
    for c, e in counts.items():
        cols.append(f"round(CAST({e} AS DOUBLE) / {total}, 9) AS {c.lower()}_keyword_ratio")
    return ",\n  ".join(cols)


def sql_tier(text_expr: str, low_dict=None, high_dict=None) -> str:
    low = f"lower({text_expr})"
    lo, hi = Q.hits(low, low_dict or TIER_LOW), Q.hits(low, high_dict or TIER_HIGH)
    return (f"CAST(CASE WHEN {text_expr} IS NULL OR {text_expr} = '' THEN 2 "
            f"WHEN ({hi}) > ({lo}) AND ({hi}) >= 2 THEN 3 WHEN ({lo}) > ({hi}) AND ({lo}) >= 2 THEN 1 "
            f"ELSE 2 END AS BIGINT)")


def _keyword_out(df: DataFrame, keep) -> DataFrame:
    cols = list(keep)
    for c in DOC_DICT:
        k = c.lower()
        cols += [F.col(f"{k}_keyword_count").cast("long"), F.col(f"{k}_keyword_binary").cast("long")]
    cols += [F.round(F.col(f"{c.lower()}_keyword_ratio"), 9).alias(f"{c.lower()}_keyword_ratio") for c in DOC_DICT]
    return df.select(*cols)


# --- SCL-1/2/3, AGG-1: keyword counts, binaries, ratios over whole documents ---
@register("keyword_features", f"""
SELECT doc_id, {sql_keyword_cols('text')} FROM documents""")
def q_keyword_features(spark, root):
    docs = t(spark, root, "documents").select("doc_id", "text")
    f = KW.keyword_features(docs, "text", DOC_DICT, DOC_THRESHOLDS, keep_input=True)
    return _keyword_out(f, ["doc_id"])


# --- SCL-1 with one scan per text (large-dictionary form) ---
@register("keyword_features_scan", f"""
SELECT doc_id, {sql_keyword_cols('text')} FROM documents""")
def q_keyword_features_scan(spark, root):
    docs = t(spark, root, "documents").select("doc_id", "text")
    f = KW.keyword_features(docs, "text", DOC_DICT, DOC_THRESHOLDS, method="scan")
    return _keyword_out(f, ["doc_id"])


# --- SCL-1 with whole words only ---
WORD_DICT = {"Alpha": ["the", "of", "and the"], "Beta": ["der", "die", "und"], "Gamma": ["les", "la", "de la"]}


def _sql_whole_hits(kws) -> str:
    return " + ".join(f"CAST(regexp_matches(lower(coalesce(text, '')), '(^|[^\\pL\\pN_]){k}([^\\pL\\pN_]|$)') AS BIGINT)" for k in kws)


@register("keyword_features_words", "SELECT doc_id, " + ", ".join(
    f"{_sql_whole_hits(kws)} AS {c.lower()}_keyword_count" for c, kws in WORD_DICT.items()) + " FROM documents")
def q_keyword_features_words(spark, root):
    """Keywords and phrases that stand apart from other words."""
    docs = t(spark, root, "documents").select("doc_id", "text")
    f = KW.keyword_features(docs, "text", WORD_DICT, {}, method="scan", whole_words=True)
    return f.select("doc_id", *[F.col(f"{c.lower()}_keyword_count").cast("long") for c in WORD_DICT])


# --- SCL-1..4 with the original's own dictionaries, thresholds and tier lists ---
@register("travel_keyword_features", f"""
SELECT doc_id, {sql_keyword_cols('text', C.CLASS_KEYWORDS, C.CLASS_THRESHOLDS)},
  {sql_tier('text', C.BUDGET_KEYWORDS, C.LUXURY_KEYWORDS)} AS price_tier FROM documents""")
def q_travel_keyword_features(spark, root):
    # ~200 keywords over whole texts: one pass per text instead of one per keyword, the tier's lists included
    docs = t(spark, root, "documents").select("doc_id", "text")
    lists = {**C.CLASS_KEYWORDS, "_low_list": C.BUDGET_KEYWORDS, "_high_list": C.LUXURY_KEYWORDS}
    hits = docs.withColumn("_hits", KW.class_hits(F.lower(F.coalesce("text", F.lit(""))), lists))
    n = len(C.CLASS_KEYWORDS)
    f = KW.features_from_hits(hits, "_hits", list(C.CLASS_KEYWORDS), C.CLASS_THRESHOLDS, ["doc_id", "text", "_hits"])
    f = f.withColumn("price_tier", KW.tier_of(F.col("text"), F.get("_hits", n), F.get("_hits", n + 1)).cast("long"))
    cols = ["doc_id"]
    for c in C.CLASS_KEYWORDS:
        k = c.lower()
        cols += [F.col(f"{k}_keyword_count").cast("long"), F.col(f"{k}_keyword_binary").cast("long")]
    cols += [F.round(F.col(f"{c.lower()}_keyword_ratio"), 9).alias(f"{c.lower()}_keyword_ratio")
             for c in C.CLASS_KEYWORDS]
    return f.select(*cols, "price_tier")


# --- SCL-4: two-dictionary price tier over whole texts ---
@register("price_tier", f"""
SELECT doc_id, {sql_tier('text')} AS price_tier FROM documents""")
def q_price_tier(spark, root):
    d = t(spark, root, "documents").select("doc_id", "text")
    return d.select("doc_id", KW.price_tier_expr(F.col("text"), TIER_LOW, TIER_HIGH).cast("long").alias("price_tier"))


# --- SCL-5: one-hot over a fixed domain ---
@register("category_onehot", "SELECT doc_id, " + ", ".join(
    f"CAST(CASE WHEN lang = '{v}' THEN 1 ELSE 0 END AS BIGINT) AS region_{v}" for v in LANGS) + " FROM documents")
def q_category_onehot(spark, root):
    d = KW.one_hot(t(spark, root, "documents").select("doc_id", "lang"), "lang", LANGS)
    return d.select("doc_id", *[F.col(f"region_{v}").cast("long") for v in LANGS])


# --- ML-11 / WIN-5: rule class = argmax of ratios (first class wins ties) ---
def _sql_rule_class(text_expr="text"):
    """CASE expression: the class with the most hits, the earlier class on ties, NULL without hits."""
    low = f"lower(coalesce({text_expr}, ''))"
    counts = [(c, Q.hits(low, kws)) for c, kws in DOC_DICT.items()]
    cases = []
    for i, (c, e) in enumerate(counts):
        others_before = [o for _, o in counts[:i]]
        others_after = [o for _, o in counts[i + 1:]]
        cond = [f"{e} > 0"] + [f"{e} > {o}" for o in others_before] + [f"{e} >= {o}" for o in others_after]
        cases.append(f"WHEN {' AND '.join(cond)} THEN '{c}'")
    return "CASE " + " ".join(cases) + " ELSE NULL END"


@register("rule_class", f"""
SELECT doc_id, {_sql_rule_class()} AS rule_class FROM documents""")
def q_rule_class(spark, root):
    docs = t(spark, root, "documents").select("doc_id", "text")
    f = KW.keyword_features(docs, "text", DOC_DICT, DOC_THRESHOLDS, keep_input=True)
    return KW.rule_class(f, list(DOC_DICT)).select("doc_id", "rule_class")


# --- JOIN-8: contains-join of text and keyword table ---
SQL_KEYWORD_HITS = "WITH kw AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS cls, '{k}' AS kw" for c, kws in DOC_DICT.items() for k in kws) + """),
cls AS (SELECT DISTINCT cls FROM kw),
h AS (SELECT d.doc_id, kw.cls, count(*) AS hits FROM documents d JOIN kw ON contains(lower(coalesce(d.text, '')), kw.kw)
      GROUP BY d.doc_id, kw.cls)
SELECT d.doc_id, cls.cls, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits
FROM documents d CROSS JOIN cls LEFT JOIN h ON h.doc_id = d.doc_id AND h.cls = cls.cls"""


@register("keyword_join", SQL_KEYWORD_HITS)
def q_keyword_join(spark, root):
    """The dictionary known on the driver: counts per row, no shuffle."""
    docs = t(spark, root, "documents").select("doc_id", "text")
    return KW.keyword_counts(docs, "doc_id", "text", DOC_DICT)


@register("keyword_table_join", SQL_KEYWORD_HITS)
def q_keyword_table_join(spark, root):
    """The dictionary as a table: a pass over the texts for each part of it."""
    docs = t(spark, root, "documents").select("doc_id", "text")
    return KW.keyword_join(docs, "doc_id", "text", KW.keyword_table(spark, DOC_DICT), classes=list(DOC_DICT))


# --- SCL-6, SCL-9: section extraction from wiki markup ---
@register("section_extract", f"""
WITH {SQL_WIKI}
SELECT doc_id, name, understand, "do", sleep, full_text FROM art""")
def q_section_extract(spark, root):
    return doc_articles(spark, root).select("doc_id", "name", "understand", "do", "sleep", "full_text")


# --- SCL-6: sections with their sub-sections ---
@register("section_with_subsections", f"""
WITH d0 AS (SELECT doc_id, string_split(replace(coalesce(text, ''), '=', '&#61;'), chr(10)) AS l FROM documents)
SELECT doc_id, md5({Q.strip("""array_to_string(list_filter(l, lambda x, i: (i - 1) % 2 = 0), chr(10)) || chr(10) || '=' || '==More===' || chr(10)
  || array_to_string(list_filter(l, lambda x, i: (i - 1) % 2 = 1), chr(10)) || chr(10)""")}) AS body_md5
FROM d0""")
def q_section_with_subsections(spark, root):
    """A section that has a sub-heading, read to the end of its sub-section; equals
    signs of the text are escaped as markup does, so no line of it is a heading."""
    from ..functions.sections import extract_section
    docs = t(spark, root, "documents").select(
        "doc_id", F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("="), F.lit("&#61;")).alias("text"))
    arr = F.split("text", "\n")
    w = F.concat(F.lit("intro\n==Do==\n"), F.array_join(F.filter(arr, lambda x, i: i % 2 == 0), "\n"), F.lit("\n===More===\n"),
                 F.array_join(F.filter(arr, lambda x, i: i % 2 == 1), "\n"), F.lit("\n==Sleep==\nend"))
    return docs.select("doc_id", F.md5(extract_section(w, "Do", include_subsections=True)).alias("body_md5"))


# --- SRC-4: content-addressed cache key ---
@register("cache_key", """
SELECT doc_id, 'v1_' || md5(lower(source || '-' || CAST(doc_id AS VARCHAR))) || '.json' AS cache_key FROM documents""")
def q_cache_key(spark, root):
    d = t(spark, root, "documents").select("doc_id", "source")
    return d.select("doc_id", TB.cache_key(F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string")))
                    .alias("cache_key"))


# --- SRC-5: API envelope unpacking (missing page / no pages / content) ---
def _envelopes(spark, root) -> DataFrame:
    w = doc_wikitext(t(spark, root, "documents").select("doc_id", "lang", "source", "text"))
    page = F.struct(F.col("name").alias("title"), F.lit(None).cast("boolean").alias("missing"),
                    F.array(F.struct(F.struct(F.struct(F.col("wikitext").alias("content")).alias("main"))
                                     .alias("slots"))).alias("revisions"))
    missing = F.struct(F.col("name").alias("title"), F.lit(True).alias("missing"),
                       F.array().cast("array<struct<slots:struct<main:struct<content:string>>>>").alias("revisions"))
    pages = (F.when(F.col("lang") == "es", F.array(missing))
             .when(F.col("source") == "src0", F.array().cast(
                 "array<struct<title:string,missing:boolean,revisions:array<struct<slots:struct<main:struct<content:string>>>>>>"))
             .otherwise(F.array(page)))
    body = F.to_json(F.struct(F.struct(pages.alias("pages")).alias("query")))
    return w.select("doc_id", "name", body.alias("body"))


@register("envelope_unpack", f"""
WITH {SQL_WIKI}
SELECT doc_id, name,
  CASE WHEN lang = 'es' OR source = 'src0' THEN '' ELSE understand END AS understand,
  CASE WHEN lang = 'es' OR source = 'src0' THEN '' ELSE "do" END AS "do",
  CASE WHEN lang = 'es' OR source = 'src0' THEN '' ELSE sleep END AS sleep,
  CASE WHEN lang = 'es' OR source = 'src0' THEN '' ELSE full_text END AS full_text,
  (lang = 'es' OR source = 'src0') AS is_empty_article
FROM art""")
def q_envelope_unpack(spark, root):
    return TB.unpack_envelope(_envelopes(spark, root), "body")


# --- PIP-2, SET-1, SET-3, FLT-2, SCL-8/10/11: section chunks with fixed indexes ---
def _sql_windows(index, section, title, text, where):
    return f"""
  SELECT name, {index} AS chunk_index, CAST(p AS INTEGER) AS part, '{section}' AS section,
         {title} || substr({text}, CAST(p * 1500 + 1 AS BIGINT), 1500) AS chunk_text
    FROM (SELECT *, unnest(range(0, greatest((length({text}) + 1499) // 1500, 1))) AS p FROM art WHERE {where})"""


SQL_CHUNKS = "kept AS (" + " UNION ALL ".join(
    _sql_windows(i, sec, f"name || ' - {sec.capitalize()}: '", col, f"length({Q.strip(col)}) >= 50")
    for i, (sec, col) in enumerate([("understand", "understand"), ("do", '"do"'), ("sleep", "sleep")])) + """),
chunks AS (SELECT * FROM kept UNION ALL""" + _sql_windows(
    0, "full", "name || ': '", "full_text", "length(full_text) > 0 AND name NOT IN (SELECT name FROM kept)") + ")"


@register("chunk_articles", f"""
WITH {SQL_WIKI}, {SQL_CHUNKS}
SELECT 'wikivoyage:' || name AS source_document, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(part AS BIGINT) AS part,
       section, chunk_text
FROM chunks""")
def q_chunk_articles(spark, root):
    arts = doc_articles(spark, root).select(F.col("name").alias("destination"), "understand", "do", "sleep", "full_text")
    ch = CH.chunk_articles(arts, "destination")
    return ch.select("source_document", F.col("chunk_index").cast("long"), F.col("part").cast("long"), "section", "chunk_text")


# --- FLT-3: entity validation (valid / rejected with reasons) ---
@register("entity_validation", f"""
SELECT doc_id, {Q.strip('source')} AS destination_name,
  CASE WHEN lang IN ('en', 'fr', 'de') AND source IS NOT NULL AND length({Q.strip('source')}) > 0 THEN TRUE ELSE FALSE END AS is_valid,
  concat_ws(';',
    CASE WHEN source IS NULL OR length({Q.strip('source')}) = 0 THEN 'destination cannot be empty' END,
    CASE WHEN lang IS NULL OR lang NOT IN ('en', 'fr', 'de') THEN 'unknown region' END) AS reasons
FROM documents""")
def q_entity_validation(spark, root):
    d = t(spark, root, "documents").select("doc_id", F.col("source").alias("destination_name"), F.col("lang").alias("region"))
    tagged = VA.tag_entities(d, "destination_name", "region", ENTITY_LANGS)
    return tagged.select("doc_id", "destination_name", (F.size("reasons") == 0).alias("is_valid"),
                         F.array_join("reasons", ";").alias("reasons"))


# --- FLT-4: request message validation ---
@register("message_validation", f"""
SELECT conv_id, turn,
  CASE WHEN text IS NULL THEN 'missing'
       WHEN length({Q.strip('text')}) = 0 THEN 'Message cannot be empty'
       WHEN length(text) > 1000 THEN 'Message too long — max 1000 characters' END AS reason,
  CASE WHEN text IS NOT NULL AND length({Q.strip('text')}) > 0 AND length(text) <= 1000
       THEN {Q.strip('text')} END AS message
FROM conversations WHERE role = 'user'""")
def q_message_validation(spark, root):
    c = t(spark, root, "conversations").filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("message"))
    reason = VA.message_check(F.col("message"))
    return c.select("conv_id", "turn", reason.alias("reason"),
                    F.when(reason.isNull(), TX.py_strip(F.col("message"))).alias("message"))


# --- JOIN-1: entities not yet processed (left anti) ---
@register("pending_entities", """
SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_pending_entities(spark, root):
    return R.pending(t(spark, root, "documents").select("doc_id", "source"), t(spark, root, "labels"), "doc_id")


# --- JOIN-2, AGG-15: inner join + skip list, as one status table ---
@register("indexed_or_skipped", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'skipped' ELSE 'indexed' END AS status
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def q_indexed_or_skipped(spark, root):
    docs = t(spark, root, "documents").select("doc_id")
    matched, skipped = R.with_articles(docs, t(spark, root, "labels").select("doc_id").distinct(), "doc_id")
    return matched.select("doc_id", F.lit("indexed").alias("status")).unionByName(
        skipped.select("doc_id", F.lit("skipped").alias("status")))


@register("run_summary", """
WITH s AS (SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NULL THEN 'skipped' ELSE 'indexed' END AS status
           FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id)
SELECT status, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, count(DISTINCT source) AS n_sources
FROM s GROUP BY status""")
def q_run_summary(spark, root):
    docs = t(spark, root, "documents").select("doc_id", "source")
    matched, skipped = R.with_articles(docs, t(spark, root, "labels").select("doc_id").distinct(), "doc_id")
    s = matched.withColumn("status", F.lit("indexed")).unionByName(skipped.withColumn("status", F.lit("skipped")))
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"),
                                   F.max("doc_id").alias("last_id"),
                                   F.countDistinct("source").alias("n_sources"))


# --- JOIN-3: left lookup with default ---
@register("lookup_default", """
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def q_lookup_default(spark, root):
    return R.lookup_with_default(t(spark, root, "documents").select("doc_id"), t(spark, root, "labels"), "doc_id",
                                 {"quality": -1, "toxic": -1})


# --- JOIN-4, SCL-15/16: vector lookup by key ---
@register("vector_lookup", """
SELECT d.doc_id, d.lang, e.label, len(e.embedding) AS dims,
  round(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS norm
FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id""")
def q_vector_lookup(spark, root):
    e = t(spark, root, "embeddings").withColumnRenamed("vec_id", "doc_id")
    j = t(spark, root, "documents").select("doc_id", "lang").join(e, "doc_id")
    return j.select("doc_id", "lang", "label", F.size("embedding").cast("long").alias("dims"),
                    F.round(V.l2_norm("embedding"), 6).alias("norm"))


# --- JOIN-5: keyed column concatenation (unique keys asserted) ---
@register("keyed_concat", f"""
WITH f AS (SELECT doc_id, {sql_keyword_cols('text')} FROM documents)
SELECT coalesce(f.doc_id, e.vec_id) AS doc_id, f.alpha_keyword_count, f.beta_keyword_count, f.gamma_keyword_count,
  round(CAST(e.embedding[1] AS DOUBLE), 6) AS emb_0, round(CAST(e.embedding[2] AS DOUBLE), 6) AS emb_1
FROM f FULL JOIN embeddings e ON e.vec_id = f.doc_id""")
def q_keyed_concat(spark, root):
    docs = t(spark, root, "documents").select("doc_id", "text")
    f = _keyword_out(KW.keyword_features(docs, "text", DOC_DICT, DOC_THRESHOLDS), ["doc_id"]) \
        .select("doc_id", "alpha_keyword_count", "beta_keyword_count", "gamma_keyword_count")
    e = t(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"),
                                            F.round(F.get("embedding", 0).cast("double"), 6).alias("emb_0"),
                                            F.round(F.get("embedding", 1).cast("double"), 6).alias("emb_1"))
    return R.keyed_concat(f, e, "doc_id")


# --- JOIN-10: foreign-key relation with orphan flag ---
@register("fk_orders_customer", """
SELECT o.o_orderkey, c.c_name, (c.c_custkey IS NULL) AS orphan
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey""")
def q_fk_orders_customer(spark, root):
    o = t(spark, root, "orders").select("o_orderkey", "o_custkey")
    c = t(spark, root, "customer").select("c_custkey", "c_name", F.lit(True).alias("_hit"))
    j = R.with_parent(o, c, "o_custkey", "c_custkey", ["c_name", "_hit"])
    return j.select("o_orderkey", "c_name", F.col("_hit").isNull().alias("orphan"))


# --- AGG-16 / WIN-4: first row per key ---
@register("first_per_key", """
SELECT source, doc_id, lang, n_chars FROM (
  SELECT source, doc_id, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1""")
def q_first_per_key(spark, root):
    d = t(spark, root, "documents").select("source", "doc_id", "lang", "n_chars")
    return R.first_per_key(d, "source", "doc_id").select("source", "doc_id", "lang", "n_chars")


# ---------------------------------------------------------------------------
# Aggregates, split and metrics over labels (truth = quality) with two
# predictions: a keyword-count rule and the toxic flag.
# ---------------------------------------------------------------------------
def _quality(c):
    return F.when(c == 1, F.lit("good")).otherwise(F.lit("poor"))


def scored(spark, root) -> DataFrame:
    """labels ⋈ documents with truth, rule prediction and toxic prediction.
    The join comes first, so keyword counting runs on labelled documents only."""
    lab = t(spark, root, "labels")
    docs = lab.join(t(spark, root, "documents").select("doc_id", "text"), "doc_id", "inner")
    f = KW.keyword_features(docs, "text", DOC_DICT, DOC_THRESHOLDS)
    total = F.col("alpha_keyword_count") + F.col("beta_keyword_count") + F.col("gamma_keyword_count")
    return f.withColumn("hits", total).select(
        "doc_id", _quality(F.col("quality")).alias("truth"),
        F.when(F.col("hits") >= 40, "good").otherwise("poor").alias("pred_rule"),
        F.when(F.col("toxic") == 0, "good").otherwise("poor").alias("pred_toxic"))


SQL_SCORED = f"""
f AS (SELECT doc_id, {Q.hits("lower(coalesce(text, ''))", [k for v in DOC_DICT.values() for k in v])} AS hits FROM documents),
sc AS (SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS truth,
  CASE WHEN f.hits >= 40 THEN 'good' ELSE 'poor' END AS pred_rule,
  CASE WHEN l.toxic = 0 THEN 'good' ELSE 'poor' END AS pred_toxic
  FROM labels l JOIN f ON f.doc_id = l.doc_id)"""

SQL_RANKED = """
hsh AS (SELECT *, md5(CAST(doc_id AS VARCHAR) || ':42') AS h FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY h, doc_id) AS class_rank FROM hsh),
cnt AS (SELECT truth, count(*) AS n_c FROM sc GROUP BY truth),
tot AS (SELECT sum(n_c) AS n, ceil(0.2 * sum(n_c)) AS n_test FROM cnt),
cont AS (SELECT truth, n_c, n_test * n_c / n AS c, floor(n_test * n_c / n) AS fl, n_test FROM cnt, tot),
rem AS (SELECT *, round(c - fl, 9) AS r, n_test - sum(fl) OVER () AS lft FROM cont),
quota AS (SELECT truth, n_c, CAST(fl + CASE WHEN row_number() OVER (ORDER BY r DESC, truth) <= lft THEN 1 ELSE 0 END AS BIGINT) AS n_test FROM rem),
spl AS (SELECT rk.*, CASE WHEN class_rank <= quota.n_test THEN 'test' ELSE 'train' END AS split FROM rk JOIN quota USING (truth)),
trn AS (SELECT * FROM spl WHERE split = 'train'),
tr2 AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY h, doc_id) AS r2 FROM trn),
tcnt AS (SELECT truth, count(*) AS n FROM trn GROUP BY truth),
toff AS (SELECT truth, coalesce(sum(n) OVER (ORDER BY truth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM tcnt),
folds AS (SELECT tr2.*, CAST((r2 - 1 + off) % 5 AS INTEGER) AS fold FROM tr2 JOIN toff USING (truth))"""


def split_rows(spark, root) -> DataFrame:
    return SP.stratified_split(scored(spark, root), "truth", "doc_id")


def fold_rows(spark, root) -> DataFrame:
    return SP.split_and_folds(scored(spark, root), "truth", "doc_id").filter(F.col("split") == "train")


@register("label_distribution", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def q_label_distribution(spark, root):
    return t(spark, root, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register("index_count", """
SELECT count(*) AS n, min(len(embedding)) AS min_dims, max(len(embedding)) AS max_dims FROM embeddings""")
def q_index_count(spark, root):
    e = t(spark, root, "embeddings")
    return e.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).cast("long").alias("min_dims"),
                 F.max(F.size("embedding")).cast("long").alias("max_dims"))


@register("class_weights", """
SELECT quality, count(*) AS n_c, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight
FROM labels GROUP BY quality""")
def q_class_weights(spark, root):
    w = SP.class_weights(t(spark, root, "labels"), "quality")
    return w.select("quality", "n_c", F.round("weight", 9).alias("weight"))


@register("class_weight_lookup", """
WITH w AS (SELECT quality, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM labels GROUP BY quality)
SELECT l.doc_id, l.quality, round(w.weight, 9) AS weight FROM labels l JOIN w USING (quality)""")
def q_class_weight_lookup(spark, root):
    lab = SP.with_class_weights(t(spark, root, "labels").select("doc_id", "quality"), "quality")
    return lab.select("doc_id", "quality", F.round("weight", 9).alias("weight"))


@register("distinct_labels", "SELECT array_to_string(list_sort(list_distinct(list(lang))), ',') AS labels FROM documents")
def q_distinct_labels(spark, root):
    d = t(spark, root, "documents")
    return d.select("lang").distinct().agg(F.array_join(F.array_sort(F.collect_list("lang")), ",").alias("labels"))


@register("null_check", """
SELECT max(CASE WHEN doc_id IS NULL OR text IS NULL OR lang IS NULL OR source IS NULL OR n_chars IS NULL
                THEN 1 ELSE 0 END) > 0 AS has_nulls, count(*) AS n FROM documents""")
def q_null_check(spark, root):
    d = t(spark, root, "documents")
    anyn = F.greatest(*[F.col(c).isNull().cast("int") for c in d.columns])
    return d.agg((F.max(anyn) > 0).alias("has_nulls"), F.count(F.lit(1)).alias("n"))


@register("stratified_split", f"WITH {SQL_SCORED}, {SQL_RANKED} SELECT doc_id, truth, class_rank, split FROM spl")
def q_stratified_split(spark, root):
    return split_rows(spark, root).select("doc_id", "truth", "class_rank", "split")


@register("split_quotas", f"WITH {SQL_SCORED}, {SQL_RANKED} SELECT truth, n_c, n_test FROM quota")
def q_split_quotas(spark, root):
    return SP.class_quotas(scored(spark, root), "truth")


@register("stratified_folds", f"WITH {SQL_SCORED}, {SQL_RANKED} SELECT doc_id, truth, fold FROM folds")
def q_stratified_folds(spark, root):
    return fold_rows(spark, root).select("doc_id", "truth", "fold")


@register("accuracy", f"""
WITH {SQL_SCORED} SELECT round(avg(CASE WHEN truth = pred_rule THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM sc""")
def q_accuracy(spark, root):
    a = M.accuracy(scored(spark, root), "truth", "pred_rule")
    return a.select(F.round("accuracy", 9).alias("accuracy"), "n")


def _sql_per_class(src: str, pred: str, labels=None) -> str:
    lab = ("(SELECT truth AS label FROM " + src + " UNION SELECT " + pred + " FROM " + src + ")"
           if labels is None else "(SELECT unnest([" + ", ".join(Q.q(x) for x in labels) + "]) AS label)")
    return f"""(SELECT lab.label,
  coalesce(CASE WHEN np > 0 THEN tp / np END, 0.0) AS precision,
  coalesce(CASE WHEN sup > 0 THEN tp / sup END, 0.0) AS recall,
  coalesce(CASE WHEN sup + np > 0 THEN 2.0 * tp / (sup + np) END, 0.0) AS f1,
  CAST(coalesce(sup, 0) AS BIGINT) AS support, CAST(coalesce(np, 0) AS BIGINT) AS predicted
FROM {lab} lab
LEFT JOIN (SELECT truth AS label, count(*) AS sup, sum(CASE WHEN truth = {pred} THEN 1 ELSE 0 END) AS tp
           FROM {src} GROUP BY truth) t ON t.label = lab.label
LEFT JOIN (SELECT {pred} AS label, count(*) AS np FROM {src} GROUP BY {pred}) p ON p.label = lab.label)"""


def _rounded_report(df):
    return df.select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support", "predicted")


@register("per_class_report", f"""
WITH {SQL_SCORED}
SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support, predicted
FROM {_sql_per_class('sc', 'pred_rule')} x""")
def q_per_class_report(spark, root):
    return _rounded_report(M.per_class(scored(spark, root), "truth", "pred_rule"))


QUALITY_FIXED = QUALITY_LABELS + ["unknown"]


@register("macro_f1", f"""
WITH {SQL_SCORED}
SELECT round(avg(f1), 9) AS f1_macro FROM {_sql_per_class('sc', 'pred_rule', QUALITY_FIXED)} x""")
def q_macro_f1(spark, root):
    return M.macro_f1(scored(spark, root), "truth", "pred_rule", QUALITY_FIXED) \
        .select(F.round("f1_macro", 9).alias("f1_macro"))


@register("fold_metrics", f"""
WITH {SQL_SCORED}, {SQL_RANKED},
lab AS (SELECT unnest({'[' + ', '.join(Q.q(x) for x in QUALITY_FIXED) + ']'}) AS label),
fl AS (SELECT DISTINCT fold FROM folds),
sup AS (SELECT fold, truth AS label, count(*) AS sup, sum(CASE WHEN truth = pred_rule THEN 1 ELSE 0 END) AS tp
        FROM folds GROUP BY fold, truth),
prd AS (SELECT fold, pred_rule AS label, count(*) AS np FROM folds GROUP BY fold, pred_rule),
f1 AS (SELECT fl.fold, lab.label,
         coalesce(CASE WHEN coalesce(sup.sup, 0) + coalesce(prd.np, 0) > 0
                       THEN 2.0 * coalesce(sup.tp, 0) / (coalesce(sup.sup, 0) + coalesce(prd.np, 0)) END, 0.0) AS f1
       FROM fl CROSS JOIN lab LEFT JOIN sup ON sup.fold = fl.fold AND sup.label = lab.label
       LEFT JOIN prd ON prd.fold = fl.fold AND prd.label = lab.label),
per AS (SELECT f.fold, avg(f.f1) AS f1_macro, a.accuracy FROM f1 f JOIN
        (SELECT fold, avg(CASE WHEN truth = pred_rule THEN 1.0 ELSE 0.0 END) AS accuracy FROM folds GROUP BY fold) a
        ON a.fold = f.fold GROUP BY f.fold, a.accuracy)
SELECT round(avg(accuracy), 9) AS accuracy_mean, round(stddev_pop(accuracy), 9) AS accuracy_std,
       round(avg(f1_macro), 9) AS f1_macro_mean, round(stddev_pop(f1_macro), 9) AS f1_macro_std FROM per""")
def q_fold_metrics(spark, root):
    folds = fold_rows(spark, root)
    s = M.fold_summary(M.scores(folds, "truth", "pred_rule", QUALITY_FIXED, ["fold"]), ["accuracy", "f1_macro"])
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


CANDIDATES = [("rule", "pred_rule"), ("toxic", "pred_toxic")]


@register("best_of", f"""
WITH {SQL_SCORED},
m AS ({' UNION ALL '.join(f"SELECT '{n}' AS candidate, {i} AS ord, (SELECT avg(f1) FROM {_sql_per_class('sc', p, QUALITY_FIXED)} x) AS f1" for i, (n, p) in enumerate(CANDIDATES))})
SELECT candidate, round(f1, 9) AS f1 FROM m WHERE f1 > 0 ORDER BY f1 DESC, ord LIMIT 1""")
def q_best_of(spark, root):
    sc = scored(spark, root)
    parts = [M.macro_f1(sc, "truth", p, QUALITY_FIXED).select(F.lit(n).alias("candidate"), F.lit(i).alias("ord"),
                                                               F.col("f1_macro").alias("f1"))
             for i, (n, p) in enumerate(CANDIDATES)]
    allc = parts[0]
    for p in parts[1:]:
        allc = allc.unionByName(p)
    return M.best_of(allc, "f1", "ord").select("candidate", F.round("f1", 9).alias("f1"))


@register("report_compare", f"""
WITH {SQL_SCORED},
a AS (SELECT label, round(f1, 4) AS f1 FROM {_sql_per_class('sc', 'pred_rule')} x),
b AS (SELECT label, round(f1, 4) AS f1 FROM {_sql_per_class('sc', 'pred_toxic')} y)
SELECT coalesce(a.label, b.label) AS label, coalesce(a.f1, 0.0) AS f1_rule, coalesce(b.f1, 0.0) AS f1_toxic,
  round(coalesce(b.f1, 0.0) - coalesce(a.f1, 0.0), 9) AS delta,
  CASE WHEN coalesce(b.f1, 0.0) > coalesce(a.f1, 0.0) THEN '+' WHEN coalesce(b.f1, 0.0) < coalesce(a.f1, 0.0) THEN '-' ELSE '' END AS sign
FROM a FULL JOIN b ON a.label = b.label""")
def q_report_compare(spark, root):
    sc = scored(spark, root)
    a = _rounded_report(M.per_class(sc, "truth", "pred_rule"))
    b = _rounded_report(M.per_class(sc, "truth", "pred_toxic"))
    c = M.compare_reports(a, b, "label", "f1", ("rule", "toxic"))
    return c.select("label", "f1_rule", "f1_toxic", F.round("delta", 9).alias("delta"), "sign")


@register("label_set_equality", f"""
WITH obs AS (SELECT DISTINCT CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label FROM labels),
exp AS (SELECT unnest({'[' + ', '.join(Q.q(x) for x in QUALITY_FIXED) + ']'}) AS label)
SELECT label, 'missing' AS side FROM (SELECT label FROM exp EXCEPT SELECT label FROM obs)
UNION ALL
SELECT label, 'unexpected' AS side FROM (SELECT label FROM obs EXCEPT SELECT label FROM exp)""")
def q_label_set_equality(spark, root):
    obs = t(spark, root, "labels").select(_quality(F.col("quality")).alias("label")).distinct()
    exp = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in QUALITY_FIXED])).alias("label"))
    return exp.exceptAll(obs).withColumn("side", F.lit("missing")).unionByName(
        obs.exceptAll(exp).withColumn("side", F.lit("unexpected")))


@register("standardiser_fit", f"""
WITH {SQL_SCORED}, {SQL_RANKED},
tr AS (SELECT e.embedding FROM embeddings e JOIN spl ON spl.doc_id = e.vec_id WHERE spl.split = 'train'),
x AS (SELECT unnest(range(len(embedding))) AS dim, unnest(embedding) AS v FROM tr)
SELECT CAST(dim AS BIGINT) AS dim, round(avg(v), 6) AS mean,
       round(CASE WHEN stddev_pop(v) = 0 THEN 1.0 ELSE stddev_pop(v) END, 6) AS std FROM x GROUP BY dim""")
def q_standardiser_fit(spark, root):
    from ..operators.ml import fit_standardizer_long
    tr = split_rows(spark, root).filter(F.col("split") == "train").select("doc_id")
    e = t(spark, root, "embeddings").join(tr, F.col("vec_id") == F.col("doc_id"), "left_semi")
    st = fit_standardizer_long(e, "embedding")
    return st.select(F.col("dim").cast("long"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


# ---------------------------------------------------------------------------
# Retrieval: every vector of the table is a query against the whole table.
# ---------------------------------------------------------------------------
def _sql_search(k: int, min_sim: float) -> str:
    return f"""
qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings),
xv AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT qv.query_id, xv.vec_id, xv.label,
        list_dot_product(qv.v, xv.v) / (sqrt(list_dot_product(qv.v, qv.v)) * sqrt(list_dot_product(xv.v, xv.v))) AS sim
      FROM qv CROSS JOIN xv),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s),
hits AS (SELECT query_id, rank, vec_id, label, sim FROM r WHERE rank <= {k} AND sim >= {min_sim})"""


def vector_hits(spark, root, k=C.DEFAULT_TOP_K, min_similarity=C.AGENT_MIN_SIMILARITY) -> DataFrame:
    e = t(spark, root, "embeddings")
    return S.search(e.select(F.col("vec_id").alias("query_id"), "embedding"), e, k=k,
                    min_similarity=min_similarity, carry=["vec_id", "label"], tie=["vec_id"])


@register("vector_search", f"""
WITH {_sql_search(5, 0.2)}
SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, label, round(sim, 4) AS similarity FROM hits""")
def q_vector_search(spark, root):
    h = vector_hits(spark, root)
    return h.select("query_id", F.col("rank").cast("long"), "vec_id", "label", "similarity")


@register("retrieval_report", f"""
WITH {_sql_search(3, 0.3)}
SELECT query_id, CAST(rank AS BIGINT) AS rank, 'doc' || CAST(vec_id AS VARCHAR) AS destination,
       round(sim, 4) AS similarity FROM hits""")
def q_retrieval_report(spark, root):
    h = vector_hits(spark, root, k=C.SANITY_TOP_K, min_similarity=C.DEFAULT_MIN_SIMILARITY)
    return h.select("query_id", F.col("rank").cast("long"),
                    TX.strip_prefix_all(F.concat(F.lit(C.SOURCE_PREFIX + "doc"), F.col("vec_id").cast("string")),
                                        C.SOURCE_PREFIX).alias("destination"), "similarity")


def context_rows(spark, root, min_similarity=C.AGENT_MIN_SIMILARITY) -> DataFrame:
    h = vector_hits(spark, root, min_similarity=min_similarity)
    # only the characters that the context shows travel to the hits
    docs = t(spark, root, "documents").select(F.col("doc_id").alias("vec_id"),
                                              F.substring("text", 1, C.CONTEXT_CHUNK_CHARS).alias("chunk_text"))
    h = h.join(docs, "vec_id", "left").withColumn(
        "source_document", F.concat(F.lit(C.SOURCE_PREFIX + "doc"), F.col("vec_id").cast("string")))
    queries = t(spark, root, "embeddings").select(F.col("vec_id").alias("query_id"))
    return SV.assemble_context(queries, h, "query_id")


SQL_CONTEXT = f"""
top AS (SELECT h.query_id, h.rank, 'doc' || CAST(h.vec_id AS VARCHAR) AS dest, round(h.sim, 4) AS similarity,
               coalesce(d.text, '') AS chunk_text FROM hits h LEFT JOIN documents d ON d.doc_id = h.vec_id WHERE h.rank <= 4),
ctx AS (SELECT query_id, string_agg('[' || dest || ' - similarity: ' || CAST(round(CAST(similarity AS DECIMAL(10, 4)), 2) AS VARCHAR) || ']'
                 || chr(10) || substr(chunk_text, 1, 400), chr(10) || chr(10) ORDER BY rank) AS context FROM top GROUP BY query_id),
nh AS (SELECT query_id, count(*) AS n_hits FROM hits GROUP BY query_id),
qc AS (SELECT e.vec_id AS query_id, coalesce(ctx.context, {Q.q(C.NO_CONTEXT_TEXT)}) AS context,
              CAST(coalesce(nh.n_hits, 0) AS BIGINT) AS n_hits
       FROM embeddings e LEFT JOIN ctx ON ctx.query_id = e.vec_id LEFT JOIN nh ON nh.query_id = e.vec_id)"""


@register("prompt_context", f"WITH {_sql_search(5, 0.2)}, {SQL_CONTEXT} SELECT query_id, context, n_hits FROM qc")
def q_prompt_context(spark, root):
    return context_rows(spark, root).select("query_id", "context", "n_hits")


@register("no_hits_fallback", f"""
WITH {_sql_search(5, 0.5)}, nh AS (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id),
{SQL_WIKI},
rc AS (SELECT doc_id, {_sql_rule_class()} AS style FROM documents)
SELECT e.vec_id AS query_id, CAST(coalesce(nh.n, 0) AS BIGINT) AS n_hits, coalesce(nh.n, 0) = 0 AS no_hits,
  'I found some ' || coalesce(rc.style, 'Unknown') || ' destinations that might interest you, but I''m having trouble generating a detailed response right now. Please try again.' AS fallback
FROM embeddings e LEFT JOIN nh ON nh.query_id = e.vec_id LEFT JOIN rc ON rc.doc_id = e.vec_id""")
def q_no_hits_fallback(spark, root):
    h = vector_hits(spark, root, min_similarity=0.5)
    n = h.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    docs = t(spark, root, "documents").select("doc_id", "text")
    rc = KW.rule_class(KW.keyword_features(docs, "text", DOC_DICT, DOC_THRESHOLDS), list(DOC_DICT)) \
        .select(F.col("doc_id").alias("query_id"), F.col("rule_class").alias("style"))
    q = t(spark, root, "embeddings").select(F.col("vec_id").alias("query_id"))
    j = q.join(n, "query_id", "left").join(rc, "query_id", "left")
    nh = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return j.select("query_id", nh.alias("n_hits"), SV.no_hits_flag(F.col("n")).alias("no_hits"),
                    SV.fallback_answer(F.col("style")).alias("fallback"))


def _sql_prompt() -> str:
    tmpl = C.USER_PROMPT_TEMPLATE
    parts = []
    rest = tmpl
    vals = {"query": "pq.query", "style": "pq.style",
            "confidence": "CAST(CAST(round(CAST(pq.confidence * 100 AS DECIMAL(24, 12)), 0) AS BIGINT) AS VARCHAR) || '%'", "context": "qc.context"}
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [Q.q(pre).replace(chr(10), "' || chr(10) || '"), vals[name]]
    parts.append(Q.q(rest).replace(chr(10), "' || chr(10) || '"))
    return " || ".join(parts)


@register("prompt_text", f"""
WITH {_sql_search(5, 0.2)}, {SQL_CONTEXT},
kc AS (SELECT doc_id, {_sql_rule_class()} AS style,
         {' , '.join(f"{Q.hits("lower(coalesce(text, ''))", kws)} AS c_{c.lower()}" for c, kws in DOC_DICT.items())},
         coalesce(text, '') AS query FROM documents),
pq AS (SELECT doc_id, query, coalesce(style, 'Unknown') AS style,
         CASE WHEN style IS NULL THEN 0.0 ELSE greatest({', '.join(f'c_{c.lower()}' for c in DOC_DICT)})
              / greatest({' + '.join(f'c_{c.lower()}' for c in DOC_DICT)}, 1) END AS confidence FROM kc)
SELECT qc.query_id, md5({_sql_prompt()}) AS prompt_md5, length({_sql_prompt()}) AS prompt_chars
FROM qc JOIN pq ON pq.doc_id = qc.query_id""")
def q_prompt_text(spark, root):
    ctx = context_rows(spark, root)
    docs = t(spark, root, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    f = KW.rule_class(KW.keyword_features(docs, "text", DOC_DICT, DOC_THRESHOLDS), list(DOC_DICT))
    best = F.greatest(*[F.col(f"{c.lower()}_keyword_ratio") for c in DOC_DICT])
    pq = f.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"),
                  F.coalesce(F.col("rule_class"), F.lit("Unknown")).alias("style"),
                  F.when(F.col("rule_class").isNull(), F.lit(0.0)).otherwise(best).alias("confidence"))
    j = ctx.join(pq, "query_id")
    p = SV.prompt_text(F.col("query"), F.col("style"), F.col("confidence"), F.col("context"))
    return j.select("query_id", F.md5(p).alias("prompt_md5"), F.length(p).cast("long").alias("prompt_chars"))


# ---------------------------------------------------------------------------
# Run log and history: events as runs (ts = start, event_type = status) with a
# conversation turn as the stored response.
# ---------------------------------------------------------------------------
def runs_table(spark, root) -> DataFrame:
    """Run log: one row per event; the response is looked up for the shown runs."""
    ev = t(spark, root, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        F.col("event_id").cast("string").alias("run_id"), "user_id",
        F.concat(F.lit("event "), F.col("event_type"), F.lit(" "), F.col("value").cast("string")).alias("user_input"),
        F.col("event_type").alias("status"), F.col("ts").alias("started_at"))


@register("recent_runs", """
WITH c AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT CAST(e.event_id AS VARCHAR) AS run_id, 'event ' || e.event_type || ' ' || CAST(e.value AS VARCHAR) AS user_input,
        c.text AS agent_response, e.event_type AS status, e.ts AS started_at
      FROM events e LEFT JOIN c ON c.conv_id = e.user_id)
SELECT run_id, user_input,
  CASE WHEN length(agent_response) > 100 THEN substr(agent_response, 1, 100) || '...' ELSE agent_response END AS agent_response,
  status, CASE WHEN epoch_us(started_at) % 1000000 = 0 THEN strftime(started_at, '%Y-%m-%d %H:%M:%S')
               ELSE strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') END AS started_at
FROM r ORDER BY r.started_at DESC, run_id DESC LIMIT 10""")
def q_recent_runs(spark, root):
    # the ten runs first, then the last assistant turn of their conversations
    top = SV.recent(runs_table(spark, root), 10)
    conv = t(spark, root, "conversations").filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("user_id"), "turn", "text")
    last = conv.join(top.select("user_id").distinct(), "user_id", "left_semi").groupBy("user_id").agg(
        F.max_by("text", "turn").alias("agent_response"))
    return SV.history(top.join(last, "user_id", "left"), 10)


@register("conversation_summary", """
SELECT conv_id, count(*) AS n_messages, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS n_user,
  CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS n_assistant, max(turn) AS last_turn,
  arg_max(role, turn) AS last_role, CAST(sum(length(text)) AS BIGINT) AS total_chars
FROM conversations GROUP BY conv_id""")
def q_conversation_summary(spark, root):
    from ..operators.messages import conversation_summary
    return conversation_summary(t(spark, root, "conversations"))


@register("session_suffix", """
WITH u AS (SELECT conv_id, turn, text || ' [session:s' || CAST(conv_id AS VARCHAR) || ']' AS user_input
           FROM conversations WHERE role = 'user')
SELECT conv_id, turn, 's' || CAST(conv_id AS VARCHAR) AS session_id, md5(user_input) AS input_md5 FROM u""")
def q_session_suffix(spark, root):
    u = t(spark, root, "conversations").filter(F.col("role") == "user").select(
        "conv_id", "turn", TX.session_suffix(F.col("text"), F.concat(F.lit("s"), F.col("conv_id").cast("string")))
        .alias("user_input"))
    return u.select("conv_id", "turn", TX.parse_session_suffix(F.col("user_input")).alias("session_id"),
                    F.md5("user_input").alias("input_md5"))


# ---------------------------------------------------------------------------
# Scalars, one projection per operator
# ---------------------------------------------------------------------------
@register("combined_text", f"""
WITH {SQL_WIKI}
SELECT doc_id, md5(coalesce(understand, '') || ' ' || coalesce("do", '')) AS combined_md5,
       length(coalesce(understand, '') || ' ' || coalesce("do", '')) AS combined_chars FROM art""")
def q_combined_text(spark, root):
    a = doc_articles(spark, root)
    comb = F.concat(F.coalesce(F.col("understand"), F.lit("")), F.lit(" "), F.coalesce(F.col("do"), F.lit("")))
    return a.select("doc_id", F.md5(comb).alias("combined_md5"), F.length(comb).cast("long").alias("combined_chars"))


HEADS = [5000, 2000, 1500, 1000, 400, 100, 50]


@register("head_slices", "SELECT doc_id, " + ", ".join(
    f"md5(substr(text, 1, {n})) AS head_{n}_md5" for n in HEADS) + " FROM documents")
def q_head_slices(spark, root):
    d = t(spark, root, "documents")
    return d.select("doc_id", *[F.md5(TX.head(F.col("text"), n)).alias(f"head_{n}_md5") for n in HEADS])


@register("py_strip", f"""
SELECT doc_id, md5({Q.strip('text')}) AS stripped_md5, length({Q.strip('text')}) AS stripped_chars,
       length({Q.strip('text')}) = 0 AS is_blank FROM documents""")
def q_py_strip(spark, root):
    d = t(spark, root, "documents")
    s = TX.py_strip(F.col("text"))
    return d.select("doc_id", F.md5(s).alias("stripped_md5"), F.length(s).cast("long").alias("stripped_chars"),
                    TX.is_blank(F.col("text")).alias("is_blank"))


@register("ellipsis", """
SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS shown
FROM conversations""")
def q_ellipsis(spark, root):
    c = t(spark, root, "conversations")
    return c.select("conv_id", "turn", TX.ellipsis(F.col("text"), 100).alias("shown"))


@register("first_non_blank", f"""
WITH {SQL_WIKI}
SELECT doc_id, md5(CASE WHEN length({Q.strip('understand')}) > 0 THEN understand ELSE full_text END)
  AS embed_text_md5 FROM art""")
def q_first_non_blank(spark, root):
    a = doc_articles(spark, root)
    return a.select("doc_id", F.md5(TX.first_non_blank("understand", "full_text")).alias("embed_text_md5"))


def _sql_fixed(x: str, decimals: int, signed: bool = False) -> str:
    """Rounds the shortest decimal form of a double, half up."""
    text = f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), {decimals}) AS VARCHAR)"
    return f"(CASE WHEN {x} >= 0 THEN '+' ELSE '' END || {text})" if signed else text


@register("number_formats", f"""
SELECT event_id, {_sql_fixed('value', 2)} AS f2, {_sql_fixed('value / 100', 3)} AS f3,
  {_sql_fixed('value / 100', 3, True)} AS signed3,
  {_sql_fixed('value / 100 * 100', 0)} || '%' AS pct, round(value / 7, 4) AS r4, round(value / 7, 3) AS r3
FROM events""")
def q_number_formats(spark, root):
    e = t(spark, root, "events")
    v = F.col("value")
    return e.select("event_id", TX.format_fixed(v, 2).alias("f2"), TX.format_fixed(v / 100, 3).alias("f3"),
                    TX.format_signed(v / 100, 3).alias("signed3"), TX.format_percent(v / 100).alias("pct"),
                    F.round(v / 7, 4).alias("r4"), F.round(v / 7, 3).alias("r3"))


@register("json_codec", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"type":"' || event_type || '"}' AS encoded FROM events""")
def q_json_codec(spark, root):
    e = t(spark, root, "events")
    p = F.from_json(F.col("props"), "k bigint")
    return e.select("event_id", p["k"].alias("k"),
                    F.to_json(F.struct(p["k"].alias("k"), F.col("event_type").alias("type"))).alias("encoded"))


@register("vector_scalars", """
WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id, a.v, b.v AS w FROM a LEFT JOIN a b ON b.vec_id = a.vec_id + 1)
SELECT vec_id,
  round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 6) AS cos_next,
  round(sqrt(list_dot_product(v, v)), 6) AS norm,
  round(sqrt(list_dot_product(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))),
                              list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))))), 6) AS unit_norm,
  len(v) AS dims
FROM p""")
def q_vector_scalars(spark, root):
    e = t(spark, root, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_vec"))
    j = e.join(nxt, "vec_id", "left")
    return j.select("vec_id", F.round(V.cosine_similarity("embedding", "next_vec"), 6).alias("cos_next"),
                    F.round(V.l2_norm("embedding"), 6).alias("norm"),
                    F.round(V.l2_norm(V.l2_normalize("embedding", as_float=False)), 6).alias("unit_norm"),
                    V.dims("embedding").cast("long").alias("dims"))


@register("vector_codec", """
SELECT vec_id, len(embedding) AS dims,
  md5(array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',')) AS text_md5, TRUE AS same
FROM embeddings""")
def q_vector_codec(spark, root):
    """Vectors to their text form and back."""
    e = t(spark, root, "embeddings").select("vec_id", "embedding")
    text = V.vector_to_text("embedding")
    err = F.array_max(F.zip_with("embedding", V.text_to_vector(text), lambda a, b: F.abs(a.cast("double") - b)))
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    return e.select("vec_id", F.size("embedding").cast("long").alias("dims"), F.md5(inner).alias("text_md5"), (err <= 5e-9).alias("same"))


# ---------------------------------------------------------------------------
# Feature matrix end to end and its table rules
# ---------------------------------------------------------------------------
def feature_matrix(spark, root) -> DataFrame:
    """PIP-1 on the driver tables: labelled documents are the entities (name,
    language as region, quality as label), their composed articles are matched
    by cache key; section and keyword work runs on labelled documents only."""
    from .features import build_features
    lab = t(spark, root, "labels").select("doc_id", _quality(F.col("quality")).alias("label"))
    docs = t(spark, root, "documents").select("doc_id", "text", "lang")
    labelled = docs.join(lab.select("doc_id"), "doc_id", "left_semi")
    ents = lab.join(labelled.select("doc_id", "lang"), "doc_id", "inner").select(
        doc_name().alias("destination_name"), F.col("lang").alias("region"),
        F.col("label").alias("travel_style_label"), F.col("doc_id").alias("ord"))
    arts = doc_articles(spark, root, labelled).select(TB.cache_key("name").alias("cache_key"),
                                                      "understand", "do", "sleep")
    feats, _rejects = build_features(ents, arts, DOC_DICT, DOC_THRESHOLDS, LANGS, TIER_LOW, TIER_HIGH)
    return _keyword_out(feats, [F.col("price_tier").cast("long"),
                                *[F.col(f"region_{v}").cast("long").alias(f"region_{v}") for v in LANGS],
                                "destination_name", "label"])


SQL_FEATURES = f"""
ents AS (SELECT art.*, CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS label FROM labels l JOIN art ON art.doc_id = l.doc_id),
fm AS (SELECT {sql_keyword_cols("coalesce(understand, '') || ' ' || coalesce(\"do\", '')")},
  {sql_tier('sleep')} AS price_tier,
  {', '.join(f"CAST(CASE WHEN lang = '{v}' THEN 1 ELSE 0 END AS BIGINT) AS region_{v}" for v in LANGS)},
  name AS destination_name, label FROM ents)"""


@register("feature_matrix", f"WITH {SQL_WIKI}, {SQL_FEATURES} SELECT * FROM fm")
def q_feature_matrix(spark, root):
    return feature_matrix(spark, root)


@register("matrix_report", f"""
WITH {SQL_WIKI}, {SQL_FEATURES},
agg AS (SELECT count(*) AS n_rows, list_sort(list_distinct(list(label))) AS lc FROM fm)
SELECT n_rows, CAST(17 AS BIGINT) AS n_cols, FALSE AS has_nulls, array_to_string(lc, ',') AS label_classes,
  array_to_string(list_filter({'[' + ', '.join(Q.q(x) for x in sorted(QUALITY_FIXED)) + ']'}, lambda x: NOT list_contains(lc, x)), ',') AS missing_labels,
  array_to_string(list_filter(lc, lambda x: NOT list_contains({'[' + ', '.join(Q.q(x) for x in QUALITY_FIXED) + ']'}, x)), ',') AS unexpected_labels,
  n_rows >= 50 AND len(list_filter({'[' + ', '.join(Q.q(x) for x in QUALITY_FIXED) + ']'}, lambda x: NOT list_contains(lc, x))) = 0 AS ok
FROM agg""")
def q_matrix_report(spark, root):
    r = VA.matrix_report(feature_matrix(spark, root), "label", QUALITY_FIXED)
    return r.select("n_rows", F.col("n_cols").cast("long"), "has_nulls",
                    *[F.array_join(c, ",").alias(c) for c in ("label_classes", "missing_labels", "unexpected_labels")],
                    "ok")


@register("feature_alignment", f"""
SELECT conv_id, turn, {', '.join(f"CAST({Q.hits("lower(coalesce(text, ''))", DOC_DICT[c])} AS DOUBLE) AS {c.lower()}_keyword_count" for c in DOC_DICT)},
  CAST(2 AS DOUBLE) AS price_tier, {', '.join(f'CAST(0 AS DOUBLE) AS region_{v}' for v in LANGS)},
  CAST(0 AS DOUBLE) AS emb_pca_0, CAST(0 AS DOUBLE) AS emb_pca_1
FROM conversations WHERE role = 'user'""")
def q_feature_alignment(spark, root):
    from ..operators.align import align_columns
    u = t(spark, root, "conversations").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    f = KW.keyword_features(u, "text", DOC_DICT, DOC_THRESHOLDS)
    f = f.withColumn("price_tier", F.lit(2))
    for v in LANGS:
        f = f.withColumn(f"region_{v}", F.lit(0))
    expected = [f"{c.lower()}_keyword_count" for c in DOC_DICT] + ["price_tier"] + [f"region_{v}" for v in LANGS] \
        + ["emb_pca_0", "emb_pca_1"]
    return align_columns(f, expected, keep=["conv_id", "turn"])


@register("nonempty_encode", f"""
WITH {SQL_WIKI}
SELECT doc_id, length(understand) > 0 AS has_text, CAST(384 AS BIGINT) AS dims FROM art""")
def q_nonempty_encode(spark, root):
    from ..operators.encode import HashingEncoder, encode_nonempty
    a = doc_articles(spark, root).select("doc_id", "understand")
    enc = encode_nonempty(a, HashingEncoder(384), "understand")
    n = V.l2_norm("embedding")
    # zero vector exactly when there is no text; unit length otherwise (checked in tests)
    return enc.select("doc_id", F.when(F.col("has_text") | (n == 0), F.col("has_text")).alias("has_text"),
                      F.size("embedding").cast("long").alias("dims"))


# ---------------------------------------------------------------------------
# Models (rows-only checks): target documents.lang from keyword features.
# ---------------------------------------------------------------------------
LANG_DICT = {
    "en": ["the ", " and ", "ing", " of "],
    "fr": [" les ", " que ", "eau", " des "],
    "de": [" und ", "sch", " ein", " die "],
    "es": [" los ", " del ", " que ", " las "],
}
LANG_THRESHOLDS = {c: 2 for c in LANG_DICT}
LANG_LABELS = sorted(LANG_DICT)


def lang_features(spark, root) -> tuple[DataFrame, list]:
    from ..schemas import keyword_feature_columns
    docs = t(spark, root, "documents").select("doc_id", "text", "lang")
    f = KW.keyword_features(docs, "text", LANG_DICT, LANG_THRESHOLDS, keep_input=True).drop("text")
    return f, keyword_feature_columns(LANG_DICT)


SQL_LANG = f"""WITH sc AS (SELECT doc_id, lang AS truth FROM documents), {SQL_RANKED}"""
def _lang_model(spark, root):
    """A model of ``documents.lang`` on keyword features, fitted on the train rows."""
    from ..operators import ml as ML
    from .experiment import prepare
    f, cols = lang_features(spark, root)
    train = prepare(f, "lang", "doc_id", LANG_LABELS).filter(F.col("split") == "train")
    return ML.build_pipeline("LogisticRegression", cols, LANG_LABELS, train.count()).fit(train)


@register("train_experiment")
def q_train_experiment(spark, root):
    """Fold-by-fold comparison of the three families."""
    from .experiment import run_experiment
    f, cols = lang_features(spark, root)
    res = run_experiment(f, cols, "lang", "doc_id", LANG_LABELS)
    folds = res["folds"].groupBy("model_name").agg(F.count(F.lit(1)).alias("n_folds"))
    n = res["prepared"].filter(F.col("split") == "train").agg(F.count(F.lit(1)).alias("n_train"))
    return res["runs"].join(folds, "model_name").join(F.broadcast(n)).select(
        "model_name", "ord", "accuracy_mean", "accuracy_std", "f1_macro_mean", "f1_macro_std", "phase", "winner", "n_folds", "n_train")


@register("model_test_report")
def q_model_test_report(spark, root):
    """The best of the three families, refitted on the train rows and reported on the test rows."""
    from .experiment import run_experiment
    f, cols = lang_features(spark, root)
    res = run_experiment(f, cols, "lang", "doc_id", LANG_LABELS)
    return res["test_report"].withColumn("model_name", F.lit(res["best"]))


@register("tune_winner")
def q_tune_winner(spark, root):
    """The winner of the comparison, tuned on its own grid and reported on the test rows."""
    import json
    from .experiment import run_experiment
    f, cols = lang_features(spark, root)
    res = run_experiment(f, cols, "lang", "doc_id", LANG_LABELS, tune_grid={})
    return res["test_report"].withColumns({
        "model_name": F.lit(res["best"]), "best_params": F.lit(json.dumps(res["best_params"])),
        "cv_f1": F.lit(res["cv_f1"]).cast("double")})


@register("tune_boosting")
def q_tune_boosting(spark, root):
    """Boosting's own grid: all folds and rates in one fit, fewer rounds as prefixes."""
    from ..operators import ml as ML
    from .experiment import prepare
    f, cols = lang_features(spark, root)
    train = prepare(f, "lang", "doc_id", LANG_LABELS).filter(F.col("split") == "train")
    grid = C.PARAM_GRIDS["GradientBoosting"]
    found = ML.boosted_folds(train, cols, LANG_LABELS, C.N_FOLDS, grid["learning_rate"], grid["n_estimators"])
    return M.fold_summary(found, ["accuracy", "f1_macro"], ["rate", "rounds"])


@register("classify_queries")
def q_classify_queries(spark, root):
    """Predicted language and confidence of every user message."""
    from ..operators import ml as ML
    q = t(spark, root, "conversations").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    s = ML.score_texts(q, "text", _lang_model(spark, root), LANG_DICT, LANG_THRESHOLDS, regions=[])
    return s.select("conv_id", "turn", "predicted_style", F.round("style_confidence", 3).alias("style_confidence"))


@register("embedding_pca")
def q_embedding_pca(spark, root):
    """Components fitted on the train rows, for all rows."""
    from ..operators import ml as ML
    sp = SP.stratified_split(t(spark, root, "embeddings"), "label", "vec_id")
    names = [f"emb_pca_{i}" for i in range(C.PCA_COMPONENTS)]
    out, explained = ML.add_pca_features(sp, "embedding", F.col("split") == "train", k=C.PCA_COMPONENTS)
    return out.select("vec_id", "split", *names, F.lit(round(explained, 6)).alias("explained_variance"))


SQL_VEC_FOLDS = f"""WITH sc AS (SELECT vec_id AS doc_id, label AS truth FROM embeddings), {SQL_RANKED},
v AS (SELECT CASE WHEN spl.split = 'test' THEN -1 ELSE folds.fold END AS fold, e.embedding AS x
      FROM spl JOIN embeddings e ON e.vec_id = spl.doc_id LEFT JOIN folds ON folds.doc_id = spl.doc_id)"""


def _vector_folds(spark, root):
    return SP.split_and_folds(t(spark, root, "embeddings"), "label", "vec_id")


@register("fold_means", f"""{SQL_VEC_FOLDS},
d AS (SELECT fold, unnest(range(len(x))) AS dim, unnest(x) AS x FROM v)
SELECT fold, CAST(dim AS INTEGER) AS dim, count(*) AS n, round(avg(CAST(x AS DOUBLE)), 6) AS mean,
  round(avg(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) - avg(CAST(x AS DOUBLE)) * avg(CAST(x AS DOUBLE)), 6) AS variance FROM d GROUP BY ALL""")
def q_fold_means(spark, root):
    """Mean and variance of every dimension in every fold, from the additive moments."""
    from ..operators.moments import fold_moments
    m = fold_moments(_vector_folds(spark, root), "embedding", "fold")
    mean = F.col("total") / F.col("n")
    return m.select("fold", "dim", "n", F.round(mean, 6).alias("mean"),
                    F.round(F.element_at("products", F.col("dim") + 1) / F.col("n") - mean * mean, 6).alias("variance"))


@register("fold_covariances", f"""{SQL_VEC_FOLDS},
f AS (SELECT unnest(range(5)) AS held_out),
t AS (SELECT held_out, x FROM v JOIN f ON v.fold >= 0 AND v.fold <> f.held_out),
a AS (SELECT held_out, i, i + 1 AS j, CAST(x[i + 1] AS DOUBLE) AS p, CAST(x[i + 2] AS DOUBLE) AS q FROM t, (SELECT unnest(range(len(any_value(embedding)) - 1)) AS i FROM embeddings))
SELECT CAST(held_out AS INTEGER) AS held_out, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, count(*) AS n,
  round(avg(p * q) - avg(p) * avg(q), 6) AS covariance FROM a GROUP BY ALL""")
def q_fold_covariances(spark, root):
    """Covariance of neighbouring dimensions over each fold's training rows: all rows'
    moments less the fold's."""
    from ..operators.moments import fold_moments
    from ..session import cut_lineage
    m = cut_lineage(fold_moments(_vector_folds(spark, root), "embedding", "fold").filter(F.col("fold") >= 0))
    every = m.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"),
                                 F.sum(F.get("products", F.col("dim") + 1)).alias("product"))
    own = m.select("fold", "dim", F.col("n").alias("fold_n"), F.col("total").alias("fold_total"),
                   F.get("products", F.col("dim") + 1).alias("fold_product"))
    rest = own.join(every, "dim").select(
        F.col("fold").alias("held_out"), "dim", (F.col("n") - F.col("fold_n")).alias("n"),
        (F.col("total") - F.col("fold_total")).alias("total"), (F.col("product") - F.col("fold_product")).alias("product"))
    after = rest.select("held_out", (F.col("dim") - 1).alias("dim"), F.col("total").alias("next_total"))
    return rest.join(after, ["held_out", "dim"]).select(
        "held_out", F.col("dim").alias("i"), (F.col("dim") + 1).alias("j"), "n",
        F.round(F.col("product") / F.col("n") - F.col("total") / F.col("n") * F.col("next_total") / F.col("n"), 6).alias("covariance"))


@register("encode_texts", f"""
WITH {SQL_WIKI},
x AS (SELECT doc_id, CASE WHEN length({Q.strip('understand')}) > 0 THEN understand ELSE full_text END AS t FROM art)
SELECT doc_id, length(t) > 0 AS has_text, CAST(384 AS BIGINT) AS dims,
  CAST(CASE WHEN regexp_matches(t, '[\\pL\\pN\\p{{Mn}}\\p{{Mc}}\\p{{Me}}\\p{{Pc}}]') THEN 1 ELSE 0 END AS DOUBLE) AS norm
FROM x""")
def q_encode_texts(spark, root):
    from ..operators.encode import HashingEncoder, encode_nonempty
    a = doc_articles(spark, root)
    x = a.select("doc_id", TX.first_non_blank("understand", "full_text").alias("t"))
    enc = encode_nonempty(x, HashingEncoder(C.EMBEDDING_DIM), "t")
    return enc.select("doc_id", "has_text", F.size("embedding").cast("long").alias("dims"),
                      F.round(V.l2_norm("embedding"), 6).alias("norm"))


@register("build_index", f"""
WITH {SQL_WIKI}, {SQL_CHUNKS}
SELECT md5('wikivoyage:' || name || ':' || CAST(chunk_index AS VARCHAR) || CASE WHEN part > 0 THEN ':' || CAST(part AS VARCHAR) ELSE '' END) AS chunk_id,
  'wikivoyage:' || name AS source_document, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(part AS BIGINT) AS part,
  'hashing-tf-384-v1' AS encoder_id, CAST(384 AS BIGINT) AS dims, md5(chunk_text) AS text_md5 FROM chunks""")
def q_build_index(spark, root):
    from ..operators.encode import HashingEncoder
    from .index import build_index
    arts = doc_articles(spark, root).select(F.col("name").alias("destination"), "understand", "do", "sleep",
                                            "full_text", F.col("name").alias("cache_key"))
    ents = t(spark, root, "documents").select(doc_name().alias("cache_key"))
    idx = build_index(ents, arts, HashingEncoder(C.EMBEDDING_DIM), key="cache_key")["index"]
    return idx.select("chunk_id", "source_document", F.col("chunk_index").cast("long"), F.col("part").cast("long"),
                      "encoder_id", F.size("embedding").cast("long").alias("dims"), F.md5("chunk_text").alias("text_md5"))


def _requests(spark, root):
    return t(spark, root, "conversations").filter(F.col("role") == "user").select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("request_id"),
        F.col("text").alias("message"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"))


def _answer_index(spark, root):
    from ..operators.encode import HashingEncoder
    from .index import build_index
    enc = HashingEncoder(C.EMBEDDING_DIM)
    ents, arts = _index_inputs(spark, root)
    # encoded and written once; search, encoder check and text lookup read the table
    path = _scratch(spark, "answer-index")
    build_index(ents, arts, enc, key="cache_key")["index"].write.parquet(path)
    return spark.read.parquet(path), enc


def batch_answers(spark, root) -> tuple[DataFrame, DataFrame]:
    """(responses, rejected requests) of every user message."""
    from .answer import answer_requests
    index, enc = _answer_index(spark, root)
    return answer_requests(_requests(spark, root), index, enc, _lang_model(spark, root), dictionary=LANG_DICT,
                           thresholds=LANG_THRESHOLDS, regions=[], unique_chunks=False)


#: columns of an answer; a rejected request has none of them
ANSWER = ["predicted_style", "style_confidence", "chunks_retrieved", "no_hits", "prompt", "prompt_chars", "response"]


def _outcomes(responses: DataFrame, rejected: DataFrame) -> DataFrame:
    responses = responses.withColumn("prompt_chars", F.length("prompt").cast("long"))
    done = responses.select("request_id", "session_id", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("reason"),
                            *ANSWER)
    refused = rejected.select("request_id", "session_id", F.lit("rejected").alias("status"), "reason")
    return done.unionByName(refused, allowMissingColumns=True)


@register("request_outcomes", f"""
SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS request_id, 's' || CAST(conv_id AS VARCHAR) AS session_id,
  CASE WHEN text IS NULL THEN 'missing' WHEN length({Q.strip('text')}) = 0 THEN 'Message cannot be empty'
       WHEN length(text) > 1000 THEN 'Message too long — max 1000 characters' ELSE 'accepted' END AS outcome FROM conversations WHERE role = 'user'""")
def q_request_outcomes(spark, root):
    """Which requests are answered, and why others are not."""
    accepted, rejected = VA.validate_messages(_requests(spark, root), "message")
    return accepted.select("request_id", "session_id", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("request_id", "session_id", F.col("reason").alias("outcome")))


@register("answer_requests")
def q_answer_requests(spark, root):
    """Every user message with its answer or the reason of its rejection."""
    return _outcomes(*batch_answers(spark, root))


# ---------------------------------------------------------------------------
# Streaming (rows-only): documents arrive as files in two waves; the stream is
# restarted between them and must add every document exactly once.
# ---------------------------------------------------------------------------
def _scratch(spark, name):
    from ..session import scratch_path
    return scratch_path(spark, name)


@register("stream_features", f"""
SELECT doc_id, {sql_keyword_cols('text')} FROM documents""")
def q_stream_features(spark, root):
    import os
    from ..streaming.incremental import process_new, read_output
    base = _scratch(spark, "stream-features")
    src, out, ck = (os.path.join(base, x) for x in ("in", "out", "ckpt"))
    docs = t(spark, root, "documents").select("doc_id", "text", "lang")
    first_wave = docs.filter(F.col("lang") != "en")
    second_wave = docs  # everything again plus the rest: replays must not duplicate
    schema = docs.schema

    def feats(df):
        return _keyword_out(KW.keyword_features(df, "text", DOC_DICT, DOC_THRESHOLDS), ["doc_id"])

    first_wave.write.mode("overwrite").parquet(os.path.join(src, "wave=1"))
    process_new(spark, os.path.join(src, "*"), schema, out, ck, "doc_id", feats)
    second_wave.write.mode("overwrite").parquet(os.path.join(src, "wave=2"))
    process_new(spark, os.path.join(src, "*"), schema, out, ck, "doc_id", feats)
    return read_output(spark, out, "doc_id")


def stream_answers(spark, root):
    """Requests answered as a stream: (responses, rejected requests, run records)
    as stored."""
    import os
    from ..streaming.incremental import answer_stream, read_output
    base = _scratch(spark, "stream-answers")
    index, enc = _answer_index(spark, root)
    req = _requests(spark, root)
    src, responses, rejects, runs = (os.path.join(base, x) for x in ("requests", "responses", "rejects", "runs"))
    req.write.mode("overwrite").parquet(src)
    answer_stream(spark, src, req.schema, index, enc, _lang_model(spark, root), responses, runs,
                  os.path.join(base, "ckpt"), rejects_path=rejects,
                  dictionary=LANG_DICT, thresholds=LANG_THRESHOLDS, regions=[], unique_chunks=False)
    return read_output(spark, responses), read_output(spark, rejects), read_output(spark, runs)


@register("stream_answers")
def q_stream_answers(spark, root):
    """As `answer_requests`, answered as a stream, and whether each has a run record."""
    responses, rejected, runs = stream_answers(spark, root)
    have = runs.select(F.col("run_id").alias("request_id"), F.lit(True).alias("has_run")).distinct()
    return _outcomes(responses, rejected).join(have, "request_id", "left").withColumn(
        "has_run", F.coalesce("has_run", F.lit(False)))


# ---------------------------------------------------------------------------
# Sources and sinks on driver data: files written by Spark from the tables are
# read back through the readers (scratch folder under spark.checkpoint.dir).
# ---------------------------------------------------------------------------
@register("feature_csv_round_trip", f"WITH {SQL_WIKI}, {SQL_FEATURES} SELECT * FROM fm")
def q_feature_csv_round_trip(spark, root):
    import os
    from ..sources.sinks import write_csv
    path = os.path.join(_scratch(spark, "features-csv"), "features.csv")
    fm = feature_matrix(spark, root)
    write_csv(fm.select(*[f.name for f in _matrix_schema().fields]), path)
    # read back with the schema generated from the dictionary and domain (never inferred)
    back = TB.read_feature_matrix(spark, path, list(DOC_DICT), LANGS)
    return back.select(*[F.col(c).cast(fm.schema[c].dataType).alias(c) for c in fm.columns])


def _matrix_schema():
    from ..schemas import feature_schema
    return feature_schema(list(DOC_DICT), LANGS)


@register("article_json_round_trip", f"""
WITH {SQL_WIKI}
SELECT 'v1_' || md5(lower(name)) || '.json' AS cache_key, name AS title, understand, "do", sleep, full_text FROM art""")
def q_article_json_round_trip(spark, root):
    import os
    path = os.path.join(_scratch(spark, "articles-json"), "cache")
    arts = doc_articles(spark, root).select(TB.cache_key("name").alias("cache_key"), F.col("name").alias("title"),
                                            "understand", "do", "sleep", "full_text")
    arts.write.json(path)           # JSON lines: splittable, the key in the row
    return TB.read_articles(spark, path).select("cache_key", "title", "understand", "do", "sleep", "full_text")


@register("entity_csv_round_trip", f"""
SELECT 'doc' || CAST(doc_id AS VARCHAR) AS destination_name, lang AS region, source AS travel_style_label FROM documents""")
def q_entity_csv_round_trip(spark, root):
    """Labelled entities written as CSV twice over and read back: the first row of
    a repeated name wins."""
    import os
    from ..schemas import ENTITY_SCHEMA
    from ..sources.sinks import write_csv
    path = os.path.join(_scratch(spark, "entities-csv"), "entities.csv")
    docs = t(spark, root, "documents")
    given = {"destination_name": doc_name(), "region": F.col("lang"), "travel_style_label": F.col("source")}
    rows = docs.select(*[given.get(f.name, F.lit("x").cast(f.dataType)).alias(f.name) for f in ENTITY_SCHEMA.fields])
    write_csv(rows.unionByName(rows), path)
    ents = TB.read_entities(spark, path)
    return R.first_per_key(ents, "destination_name", "ord").select("destination_name", "region", "travel_style_label")


@register("embedding_store", f"""
WITH {SQL_WIKI}
SELECT doc_id, 'hashing-tf-64-v1' AS encoder_id, CAST(64 AS BIGINT) AS dims, lang = 'en' AS was_cached, TRUE AS same FROM art""")
def q_embedding_store(spark, root):
    """Text vectors with a stored cache: English texts are stored first, the rest
    are encoded on demand and appended; the store equals encoding everything."""
    import os
    from ..operators.encode import HashingEncoder, embed_with_cache, encode_nonempty
    from ..sources import sinks
    path = os.path.join(_scratch(spark, "embeddings"), "store")
    enc = HashingEncoder(64)
    texts = doc_articles(spark, root).select("doc_id", "lang", "understand")
    first = texts.filter(F.col("lang") == "en")
    sinks.save_embeddings(embed_with_cache(first, "doc_id", "understand", None, enc)[1], path, "doc_id")
    schema = "doc_id long, embedding array<float>, encoder_id string"
    stored = spark.read.schema(schema).parquet(path)
    hits = stored.select("doc_id", F.lit(True).alias("was_cached"))
    fresh = embed_with_cache(texts, "doc_id", "understand", stored, enc)[1]
    from ..session import cut_lineage
    hits, fresh = cut_lineage(hits), cut_lineage(fresh)
    sinks.save_embeddings(fresh, path, "doc_id")
    again = encode_nonempty(texts, enc, "understand", "expected").select("doc_id", "expected")
    out = spark.read.schema(schema).parquet(path).join(again, "doc_id").join(hits, "doc_id", "left")
    return out.select("doc_id", "encoder_id", F.size("embedding").cast("long").alias("dims"),
                      F.coalesce("was_cached", F.lit(False)).alias("was_cached"), (F.col("embedding") == F.col("expected")).alias("same"))


@register("key_label_split", f"WITH {SQL_WIKI}, {SQL_FEATURES} SELECT destination_name, label, alpha_keyword_count, price_tier, CAST(15 AS BIGINT) AS n_inputs FROM fm")
def q_key_label_split(spark, root):
    """Model inputs without key and label; the label comes back by key."""
    from ..operators.align import drop_key_label
    fm = feature_matrix(spark, root)
    x, y = drop_key_label(fm, "destination_name", "label")
    inputs = len(x.columns)
    return y.join(fm.drop("label"), "destination_name").select(
        "destination_name", "label", "alpha_keyword_count", "price_tier", F.lit(inputs).cast("long").alias("n_inputs"))


@register("message_append", """
WITH lst AS (SELECT conv_id, max(turn) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, role, text FROM conversations
UNION ALL
SELECT conv_id, l + 1, 'user', 'thank you' FROM lst
UNION ALL
SELECT conv_id, l + 2, 'assistant', 'you are welcome' FROM lst
UNION ALL SELECT -5, 0, 'user', 'hello'""")
def q_message_append(spark, root):
    """Two new messages per conversation, and the first one of a new conversation."""
    from ..operators.messages import append_messages
    log = t(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    two = F.array(F.struct(F.lit(1).cast("long").alias("_seq"), F.lit("user").alias("role"), F.lit("thank you").alias("text")),
                  F.struct(F.lit(2).cast("long").alias("_seq"), F.lit("assistant").alias("role"), F.lit("you are welcome").alias("text")))
    new = log.select("conv_id").distinct().select("conv_id", F.explode(two).alias("m")).select("conv_id", "m.*")
    first = spark.range(1).select(F.lit(-5).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("_seq"),
                                  F.lit("user").alias("role"), F.lit("hello").alias("text"))
    return append_messages(log, new.unionByName(first)).select("conv_id", "turn", "role", "text")


@register("skipped_names", """
SELECT 'skipped' AS status, 'doc' || CAST(d.doc_id AS VARCHAR) AS name FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL
SELECT 'failed', 'doc' || CAST(doc_id AS VARCHAR) FROM documents WHERE lang NOT IN ('en', 'fr', 'de') OR lang IS NULL""")
def q_skipped_names(spark, root):
    """AGG-15: the names behind the run summary's counts, as a table."""
    docs = t(spark, root, "documents").select("doc_id", F.col("lang").alias("region"), doc_name().alias("destination_name"))
    skipped = R.with_articles(docs, t(spark, root, "labels").select("doc_id").distinct(), "doc_id")[1]
    failed = VA.validate_entities(docs, "destination_name", "region", ENTITY_LANGS)[1]
    return skipped.select(F.lit("skipped").alias("status"), F.col("destination_name").alias("name")).unionByName(
        failed.select(F.lit("failed").alias("status"), F.col("destination_name").alias("name")))


def _index_inputs(spark, root):
    arts = doc_articles(spark, root).select(F.col("name").alias("destination"), "understand", "do", "sleep",
                                            "full_text", F.col("name").alias("cache_key"))
    return t(spark, root, "documents").select(doc_name().alias("cache_key")), arts


@register("index_write_verify", f"""
WITH {SQL_WIKI}, {SQL_CHUNKS}, total AS (SELECT count(*) AS n_all FROM chunks)
SELECT 'wikivoyage:' || name AS source_document, count(*) AS n_chunks, any_value(n_all) AS n_written
FROM chunks, total GROUP BY name""")
def q_index_write_verify(spark, root):
    """Build, count, clear and write again, then re-send every source."""
    import os
    from ..operators.encode import HashingEncoder
    from ..sources import sinks
    from .index import build_index
    path = os.path.join(_scratch(spark, "index"), "rag_chunks")
    ents, arts = _index_inputs(spark, root)
    res = build_index(ents, arts, HashingEncoder(C.EMBEDDING_DIM), key="cache_key", path=path, on_conflict="append")
    # a version's folders never change, so the new one can be written from the old one
    sinks.write_chunks(sinks.read_chunks(spark, path), path, "overwrite")
    # re-sending every source with replace_source must not duplicate any chunk
    sinks.write_chunks(sinks.read_chunks(spark, path), path, "replace_source")
    stored = sinks.read_chunks(spark, path)
    return stored.groupBy("source_document").agg(F.count(F.lit(1)).alias("n_chunks")).withColumn(
        "n_written", F.lit(res["count"]).cast("long"))


@register("index_incremental", f"""
WITH {SQL_WIKI}, {SQL_CHUNKS}
SELECT 'wikivoyage:' || chunks.name AS source_document, count(*) AS n_chunks, min(md5(chunk_text)) AS least_md5
FROM chunks JOIN art ON art.name = chunks.name WHERE art.lang <> 'fr' OR art.lang IS NULL GROUP BY chunks.name""")
def q_index_incremental(spark, root):
    """Incremental indexing: German and French articles first, then everything,
    the French ones empty now, so their chunks go."""
    import os
    from ..operators.encode import HashingEncoder
    from ..sources import sinks
    from ..streaming.incremental import index_new_articles
    base = _scratch(spark, "index-stream")
    src, path, ck = (os.path.join(base, x) for x in ("in", "index", "ckpt"))
    arts = doc_articles(spark, root).select(F.col("name").alias("destination"), "lang", "understand", "do", "sleep", "full_text")
    emptied = [F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.col(c)).alias(c) for c in ("understand", "do", "sleep", "full_text")]
    enc = HashingEncoder(64)
    arts.filter(F.col("lang").isin("de", "fr")).write.parquet(os.path.join(src, "wave=1"))
    index_new_articles(spark, os.path.join(src, "*"), arts.schema, path, ck, enc)
    arts.select("destination", "lang", *emptied).write.parquet(os.path.join(src, "wave=2"))
    index_new_articles(spark, os.path.join(src, "*"), arts.schema, path, ck, enc)
    stored = sinks.read_chunks(spark, path)
    return stored.groupBy("source_document").agg(F.count(F.lit(1)).alias("n_chunks"), F.min(F.md5("chunk_text")).alias("least_md5"))


@register("sanity_queries", "SELECT unnest([" + ", ".join(Q.q(x) for x in C.SANITY_QUERIES) + """]) AS query,
  least(3, (SELECT count(*) FROM embeddings)) AS n_hits, TRUE AS ordered""")
def q_sanity_queries(spark, root):
    """The fixed retrieval queries against an index of all documents: top 3 each,
    in descending similarity."""
    index, enc = _answer_index(spark, root)
    index = index.select("chunk_id", "embedding", "encoder_id")
    q = spark.createDataFrame([(i, x) for i, x in enumerate(C.SANITY_QUERIES)], "query_id int, query string")
    hits = S.search_text(q, index, enc, k=C.SANITY_TOP_K, min_similarity=None, carry=["chunk_id"], tie=["chunk_id"], round_to=None)
    by = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"),
                                      F.transform(F.sort_array(F.collect_list(F.struct("rank", "similarity"))),
                                                  lambda x: x["similarity"]).alias("s"))
    ordered = F.sort_array("s", asc=False) == F.col("s")
    return q.join(by, "query_id", "left").select("query", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), ordered.alias("ordered"))


@register("table_health", " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", 'ok' AS status, count(*) AS n FROM {n}" for n in TB.DRIVER_TABLES))
def q_table_health(spark, root):
    import os
    return SV.check_tables(spark, {n: os.path.join(root, f"{n}.parquet") for n in TB.DRIVER_TABLES})


@register("phase_comparison")
def q_phase_comparison(spark, root):
    """Keyword features alone (phase a) against keyword features plus 50 components of
    text vectors (phase b), which every fold fits without its held-out rows; per-class
    test F1 of each phase's winner, missing → 0, delta and sign."""
    from ..operators import ml as ML
    from ..operators.encode import HashingEncoder, encode_nonempty
    from ..session import cut_lineage
    from .experiment import compare_phases, run_experiment
    f, cols = lang_features(spark, root)
    a = run_experiment(f, cols, "lang", "doc_id", LANG_LABELS, phase="a")
    docs = t(spark, root, "documents").select("doc_id", "text")
    vec = encode_nonempty(docs, HashingEncoder(C.EMBEDDING_DIM), "text").select("doc_id", "embedding")
    with_vectors = cut_lineage(a["prepared"].join(vec, "doc_id"))
    # phase b reuses phase a's split, folds and weights; only the components are added
    pb, _, components = ML.add_fold_pca(with_vectors, "embedding", "fold", k=C.PCA_COMPONENTS)
    pb = cut_lineage(pb.drop("embedding"))
    b = run_experiment(None, cols + components(None), "lang", "doc_id", LANG_LABELS, phase="b", prepared=pb,
                       columns_of=lambda fold: cols + components(fold))
    return compare_phases(a["test_report"], b["test_report"]).select(
        "label", "f1_a", "f1_b", "delta", "sign", F.lit(a["best"]).alias("winner_a"), F.lit(b["best"]).alias("winner_b"))


@register("experiment_log")
def q_experiment_log(spark, root):
    """Compare, refit, report, save the winner and append the log; the log table
    is read back and the saved model found and loaded by its name."""
    import os
    from ..sources.sinks import load_first_model
    from .experiment import run_experiment
    base = _scratch(spark, "experiments")
    f, cols = lang_features(spark, root)
    run_experiment(f, cols, "lang", "doc_id", LANG_LABELS,
                   results_path=os.path.join(base, "results"), models_dir=os.path.join(base, "models"))
    name, model = load_first_model(spark, os.path.join(base, "models"), C.MODEL_CANDIDATES)
    log = spark.read.parquet(os.path.join(base, "results"))
    return log.withColumn("restored", F.col("saved_model_path").endswith(name or "-") & F.lit(model is not None))
