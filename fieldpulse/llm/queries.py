"""The registered queries of this folder, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, extract, fim, hilbert, imatch, langid, pii, raking, simhash, substrings, toxicity, url_filter, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# -- 1 URL filters ---------------------------------------------------------------------------------

URL_RULES: list[url_filter.Rule] = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
]
#: First labels of hosts (after ``www``, ``m`` or ``blog``) whose hosts are on the block list.
URL_LISTED = r"(^|\.)(adult-x|ads-track|casino-win|free-bets|spam-farm)\."


@register
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rules and listed hosts over every page."""
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES, F.col("host").rlike(URL_LISTED))


ORACLE["op1_url_filter"] = rf"""
WITH cut AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
                            '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES {', '.join(repr(r) for r in URL_RULES)}),
fits AS (
  SELECT page_id, host, path, r.h || r.p AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC) AS place
  FROM cut JOIN rules r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p))
SELECT c.page_id, c.host, c.path, f.rule,
       regexp_matches(c.host, '{URL_LISTED}') AS listed,
       CASE WHEN f.rule IS NOT NULL THEN f.verdict
            WHEN regexp_matches(c.host, '{URL_LISTED}') THEN 'block' ELSE 'allow' END AS verdict
FROM cut c LEFT JOIN fits f ON f.page_id = c.page_id AND f.place = 1"""


# -- 2 personal data -------------------------------------------------------------------------------

@register
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digests of the spans of every document."""
    found = pii.pii_spans(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        count("secret").alias("n_secret"), F.size("spans").cast("bigint").alias("n_spans"))


# -- 4 SimHash near-duplicates ---------------------------------------------------------------------

@register
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- 5 repeated passages ---------------------------------------------------------------------------

@register
def op5_substring(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without passages of 13 words that an earlier one has."""
    left = substrings.remove_repeats(table(spark, folder, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# -- 3 benchmark decontamination -------------------------------------------------------------------

@register
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in a passage of ten words of a benchmark item."""
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


# -- 6 I-Match fingerprints ------------------------------------------------------------------------

@register
def op6_imatch(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document, its edited text, and how like they and the next document are."""
    return imatch.compare_edits(table(spark, folder, "documents"))


# -- 7 toxicity ------------------------------------------------------------------------------------

@register
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document; a third of the ids is held out from training."""
    docs = table(spark, folder, "documents")
    fold = F.coalesce(toxicity.crc(F.col("doc_id")) % 3 == 1, F.lit(False))
    model = toxicity.train(docs, table(spark, folder, "labels"), use=~fold)
    return toxicity.score(docs, model).select(
        "doc_id", fold.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


# -- 10 language -----------------------------------------------------------------------------------

@register
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; a fifth of the ids is held out from training."""
    docs = table(spark, folder, "documents")
    fold = F.coalesce(toxicity.crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    model = langid.train(docs, use=~fold)
    return langid.predict(docs, model).select("doc_id", fold.alias("held_out"), "lang_pred", "score", "accepted")


# -- 8 sharding ------------------------------------------------------------------------------------

@register
def op8_hilbert(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document."""
    return hilbert.assign_shards(table(spark, folder, "documents"))


def _hilbert_sql() -> str:
    digit, after = hilbert.curve_table()
    side, last = 1 << hilbert.DIMS, hilbert.BITS - 1
    place = lambda c: f"('0x' || substr(md5(coalesce({c}, '')), 1, 4))::INT % {1 << hilbert.BITS}"
    steps, before = [], "points"
    for level in reversed(range(hilbert.BITS)):
        corner = " + ".join(f"((p{j} >> {level}) & 1) * {1 << j}" for j in range(hilbert.DIMS))
        h, s = ("0", "0") if level == last else ("h", "s")
        steps.append(f"c{level} AS (SELECT * EXCLUDE ({'h, s, ' if level != last else ''}p_last), {h}::BIGINT AS h0, "
                     f"{s}::INT * {side} + {corner} AS cell FROM (SELECT *, 0 AS p_last FROM {before})), "
                     f"l{level} AS (SELECT * EXCLUDE (h0, cell), h0 * {side} + ({digit})[cell + 1] AS h, "
                     f"({after})[cell + 1] AS s FROM c{level})")
        before = f"l{level}"
    crc = [0] * 256
    for i in range(256):
        for _ in range(8):
            i_ = crc[i] if _ else i
            crc[i] = i_ >> 1 ^ (0xEDB88320 if i_ & 1 else 0)
    return f"""
WITH points AS (
  SELECT doc_id, text, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         {place('lang')} AS p0, {place('source')} AS p1,
         least(length(bin((octet_length(encode(coalesce(text, ''))) + 1)::BIGINT)) - 1, 31) AS p2
  FROM documents),
{', '.join(steps)},
sums AS (
  SELECT doc_id, size::BIGINT AS size, h::BIGINT AS curve, hex(encode(coalesce(text, ''))) AS x FROM {before}),
checked AS (
  SELECT doc_id, size, curve, (xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT,
             [('0x' || substr(x, 2 * i + 1, 2))::BIGINT FOR i IN range(length(x) // 2)]),
           lambda c, b: xor(c >> 8, ({crc}::BIGINT[])[(xor(c, b) & 255) + 1]))))::BIGINT AS text_crc32
  FROM sums),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY curve, doc_id, size, text_crc32) - 1 AS r, count(*) OVER () AS n FROM checked)
SELECT doc_id, size, text_crc32, curve, 'rows' AS law, (r * 16 // n)::INT AS shard,
       (r - ((r * 16 // n) * n + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard
FROM ranked"""


ORACLE["op8_hilbert"] = _hilbert_sql()


# -- 9 mixing --------------------------------------------------------------------------------------

def _tidy(df: DataFrame) -> DataFrame:
    """Doubles to nine digits: sums depend on their order."""
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@register
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, probability and draw of every document, towards tempered source, language and topic shares."""
    docs = table(spark, folder, "documents")
    drawn = raking.mix(docs).withColumn("tokens", raking.tokens_of(F.col("text")))
    return _tidy(drawn.select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "sampled"))


def _raking_sql() -> str:
    form = " ".join(f"WHEN contains(text, '{mark}') THEN '{name}'" for name, mark in raking.FORMS)
    parts = [rf"""docs AS (SELECT doc_id, source, lang, CASE {form} ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '{raking.TOKEN}'))::BIGINT AS tokens FROM documents)""",
             """cells AS (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, topic, sum(tokens)::DOUBLE AS t
  FROM docs GROUP BY ALL)"""]
    for d in raking.DIMENSIONS:
        parts.append(f"raw_{d} AS (SELECT {d}, pow(sum(t), {raking.TEMPER[d]}) AS s FROM cells GROUP BY {d} HAVING sum(t) > 0)")
        parts.append(f"goal_{d} AS (SELECT {d}, s / (SELECT sum(s) FROM raw_{d}) AS share FROM raw_{d})")
        parts.append(f"{d}_0 AS (SELECT {d}, 1.0::DOUBLE AS f_{d} FROM raw_{d})")
    now = {d: 0 for d in raking.DIMENSIONS}
    for r in range(1, raking.ROUNDS + 1):
        for d in raking.DIMENSIONS:
            others = [x for x in raking.DIMENSIONS if x != d]
            joins = " ".join(f"JOIN {x}_{now[x]} USING ({x})" for x in others)
            parts.append(f"{d}_{r} AS MATERIALIZED (SELECT {d}, any_value(share) / sum(t * {' * '.join('f_' + x for x in others)}) "
                         f"AS f_{d} FROM cells {joins} JOIN goal_{d} USING ({d}) GROUP BY {d})")
            now[d] = r
    joins = " ".join(f"JOIN {d}_{raking.ROUNDS} USING ({d})" for d in raking.DIMENSIONS)
    parts.append(f"found AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN t > 0 THEN "
                 f"f_source * f_lang * f_topic ELSE 0.0 END AS weight FROM cells {joins})")
    return f"""WITH {', '.join(parts)}
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(coalesce(weight, 0.0), 9) AS weight,
       round(coalesce(weight, 0.0) / (SELECT max(weight) FROM found), 9) AS probability,
       ('0x' || substr(md5(doc_id::VARCHAR), 1, {raking.DRAW_DIGITS}))::BIGINT / pow(16.0, {raking.DRAW_DIGITS})
         < coalesce(weight, 0.0) / (SELECT max(weight) FROM found) AS sampled
FROM docs d LEFT JOIN found f ON f.source = coalesce(d.source, '') AND f.lang = coalesce(d.lang, '') AND f.topic = d.topic"""


ORACLE["op9_mixing"] = _raking_sql()


# -- 11 embedding whitening ------------------------------------------------------------------------

@register
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every valid embedding on the first principal components of the distinct ones, with unit variance."""
    model, vectors = whitening.fit(whitening.quantised(table(spark, folder, "embeddings")))
    rows = whitening.by_component(whitening.whiten(vectors, model), model)
    return rows.select(
        F.col("key").alias("vec_id"), "component", F.lit(model.n).cast("bigint").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained",
        F.lit(model.identity_error).cast("double").alias("identity_error"))


# -- 12 HTML extraction ----------------------------------------------------------------------------

@register
def op12_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = extract.extract(table(spark, folder, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


# -- 13 fill-in-the-middle -------------------------------------------------------------------------

@register
def op13_fim(spark: SparkSession, folder: str) -> DataFrame:
    """Cuts and digests of every document's sample, and of the text that its output gives back."""
    found = fim.transform(table(spark, folder, "documents"))
    back = fim.restore(F.col("output"), F.col("form"))
    return found.select(
        F.col("key").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def _fim_sql() -> str:
    draw = lambda i: f"('0x' || substr(sha256('1:' || key), {8 * i + 1}, 8))::BIGINT"
    marked = " OR ".join(f"contains(text, '{s}')" for s in fim.SENTINELS)
    p, s, m = fim.SENTINELS
    return f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         {draw(0)} AS h1, {draw(1)} AS h2, {draw(2)} AS h3, {draw(3)} AS h4
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS key, * FROM documents)),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR {marked} OR h3 % 100 >= {fim.CUT_OF_100} THEN 'plain'
              WHEN h4 % 100 < {fim.SPM_OF_100} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (SELECT *, left(text, a) AS head, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS tail FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || head || '{s}' || tail || '{m}' || mid
              ELSE '{s}' || tail || '{p}' || head || '{m}' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts"""


ORACLE["op13_fim"] = _fim_sql()
