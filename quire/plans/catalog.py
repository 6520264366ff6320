"""One query for each operator on the driver's tables, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import replies as R
from quire.functions import text as T
from quire.operators import inventory as I
from quire.operators import links as L
from quire.operators import nested as N
from quire.operators import packing as P
from quire.operators import selection as S
from quire.operators import state as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*/?([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), path.alias("path"), F.col("html").alias("markup"))


_WORDS = r"[\p{L}\p{N}_]+(?:[''-]+[\p{L}\p{N}_]+)*"
_VISIBLE = r"trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_TOKENS = "greatest(1, (length(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g')) + 2) // 3 + 2 * (length({x}) - length(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g'))))::BIGINT"
_FRONT = S.FRONT_PATH
_UNESCAPE = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
_HEADING = r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)"
_TITLE_TAG = r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)"
_STRIP = r"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1)"
_INVENTORY = f"""
    SELECT page_id AS id, {_PATH} AS path, {_UNESCAPE.format(x=_STRIP.format(x=_TITLE_TAG))} AS title,
      len(regexp_extract_all({_VISIBLE}, '{_WORDS}'))::BIGINT AS words, len(regexp_extract_all(html, '<img[\\s/>]'))::BIGINT AS images,
      {_TOKENS.format(x='html')} AS tokens, regexp_matches({_PATH}, '{_FRONT}') AS front_matter FROM pages"""
_PRICED = f"SELECT *, round(((tokens + 300) * 1.0::DOUBLE + tokens * 0.5::DOUBLE * 4.0::DOUBLE) / 1000000, 6) AS dollars FROM ({_INVENTORY})"


@query(f"WITH r AS ({_PRICED}) SELECT id, title, words, images, tokens, dollars FROM r UNION ALL SELECT NULL, 'TOTAL', sum(words)::BIGINT, sum(images)::BIGINT, sum(tokens)::BIGINT, round(sum(dollars), 4) FROM r")
def s17_inventory_total(spark, d):
    """The inventory of all pages and its total."""
    return I.with_total(I.inventory(pages(spark, d)))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS idx FROM documents WHERE lang IN ('en', 'fr')")
def s7_spine_index(spark, d):
    """Dense index after a filter."""
    return P.dense_index(table(spark, d, "documents").where(F.col("lang").isin("en", "fr")).select("source", "doc_id"), "source", "doc_id")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM events GROUP BY ALL")
def s10_upsert_latest(spark, d):
    """The latest write of each key."""
    return K.latest(table(spark, d, "events"), ["user_id", "event_type"], "event_id", "value", "props")


@query("""WITH w AS (SELECT user_id::VARCHAR AS key, props AS value, event_id, event_type IN ('error', 'purchase') AS second FROM events),
  r AS (SELECT key, arg_max(value, (second, event_id)) AS latest, arg_max(value, event_id) FILTER (NOT second) AS before FROM w GROUP BY key)
  SELECT c_custkey, latest, before FROM customer LEFT JOIN r ON key = c_custkey::VARCHAR""")
def s8_point_lookup(spark, d):
    """A state table of two versions, looked up by key as of the latest and of the first."""
    store = K.StateStore(spark, _state_folder(spark))
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), "event_id", F.col("event_type").isin("error", "purchase").alias("second"))
    for second in (False, True):
        store.write("responses", events.where(F.col("second") == second), F.col("event_id"), token=f"part {second}")
    store.write("responses", events, F.col("event_id"), token="part True")  # a retried write counts for nothing
    keys = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("key"))
    now, then = (store.read("responses", v).withColumnRenamed("value", n) for v, n in ((2, "latest"), (1, "before")))
    return K.hits(K.hits(keys, now, ["key"]), then, ["key"]).select("c_custkey", "latest", "before")


@query("SELECT user_id, event_type, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def a9_first_wins(spark, d):
    """The first write of each key."""
    return K.first(table(spark, d, "events"), ["user_id", "event_type"], "event_id", "value")


@query("SELECT event_type, arg_max(user_id, event_id) AS user_id FROM events GROUP BY ALL")
def a10_last_wins(spark, d):
    """A10: the last value of each key."""
    return K.latest(table(spark, d, "events"), ["event_type"], "event_id", "user_id")


@query("SELECT d.doc_id, coalesce(l.quality::VARCHAR, CASE WHEN d.lang <> 'en' THEN d.lang END, d.source) AS value FROM documents d LEFT JOIN labels l USING (doc_id)")
def s11_config_precedence(spark, d):
    """Of three places for a value the first that has one: labels over languages other than the default over sources."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.when(F.col("lang") != "en", F.col("lang")), "source").alias("value"))


@query(f"SELECT page_id, {_UNESCAPE.format(x=_STRIP.format(x=_TITLE_TAG))} AS title, {_UNESCAPE.format(x=_STRIP.format(x=_HEADING))} AS h1 FROM pages")
def f4_title(spark, d):
    """Title and first heading of every page."""
    h1 = T.unescape(T.visible_text(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)))
    return table(spark, d, "pages").select("page_id", I.heading(F.col("html")).alias("title"), h1.alias("h1"))


@query(f"SELECT page_id, list_has_any(regexp_split_to_array(CASE WHEN page_id % 9 = 0 THEN 'bodymatter toc' ELSE 'chapter' END, '\\s+'), ['cover','titlepage','title-page','copyright-page','copyright','dedication','toc','halftitlepage','frontmatter','acknowledgments','colophon']) OR regexp_matches(CASE WHEN page_id % 7 = 0 THEN 'Text/copyright.xhtml' ELSE {_PATH} END, '{_FRONT}') OR page_id % 11 = 0 AS front_matter FROM pages")
def f5_front_matter(spark, d):
    """Semantic types, path or navigation property."""
    i = F.col("id")
    types = F.when(i % 9 == 0, "bodymatter toc").otherwise("chapter")
    path = F.when(i % 7 == 0, "Text/copyright.xhtml").otherwise(F.col("path"))
    return pages(spark, d).select(i.alias("page_id"), S.front_matter(types, path, F.when(i % 11 == 0, "scripted nav").otherwise("")).alias("front_matter"))


@query("""SELECT page_id, pos::BIGINT AS pos, href, regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(href, '^//') AS is_external
  FROM (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))""")
def f6_external_links(spark, d):
    """Every link and whether it leaves the package."""
    rows = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", T.is_external(F.col("href")).alias("is_external"))


#: Of every page an endpoint, its models and prices: mobile hosts stand for the loopback, links and bold for prices.
_ENDPOINT_SQL = r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://m\.') THEN regexp_extract(url, '^https?') || '://localhost:11434/v1' || CASE WHEN contains(url, '#') THEN '?x' ELSE '/' END ELSE url END AS base_url,
  regexp_extract(url, '^[a-z]+://[^/]*/([a-z]*)', 1) || CASE WHEN contains(url, 'page=') THEN '-Cloud' ELSE '' END AS model, CASE WHEN contains(url, 'ref=') THEN 'v-cloud' END AS vision_model,
  len(regexp_extract_all(html, '<a ')) - 6 AS input_price, len(regexp_extract_all(html, '<b>')) - 1 AS output_price FROM pages"""
_LOCAL_SQL = "regexp_matches(base_url, '" + R.LOOPBACK + "') AND NOT contains(lower(model), 'cloud')"


def _endpoints(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    local = F.concat(F.regexp_extract("url", "^https?", 0), F.lit("://localhost:11434/v1"), F.when(url.contains("#"), "?x").otherwise("/"))
    model = F.concat(F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]*)", 1), F.when(url.contains("page="), "-Cloud").otherwise(""))
    many = lambda tag: F.regexp_count("html", F.lit(tag))
    return table(spark, d, "pages").select("page_id", F.when(url.rlike(r"^https?://m\."), local).otherwise(url).alias("base_url"), model.alias("model"), F.when(url.contains("ref="), "v-cloud").alias("vision_model"), (many("<a ") - 6).alias("input_price"), (many("<b>") - 1).alias("output_price"))


@query(f"SELECT page_id, base_url, model, {_LOCAL_SQL} AS is_local FROM ({_ENDPOINT_SQL})")
def f10_local_endpoint(spark, d):
    """loopback endpoints on the usual port, and no model in a cloud behind them."""
    return _endpoints(spark, d).select("page_id", "base_url", "model", R.local_endpoint(F.col("base_url"), F.col("model")).alias("is_local"))


@query(f"SELECT page_id, ({_LOCAL_SQL} AND vision_model IS NULL) OR (NOT ({_LOCAL_SQL}) AND (input_price <> 0 OR output_price <> 0)) AS priced FROM ({_ENDPOINT_SQL})")
def f11_priced(spark, d):
    """whether a price can be told, of endpoints, models for text and pictures, and prices."""
    c = F.col
    return _endpoints(spark, d).select("page_id", R.priced(c("base_url"), c("model"), c("vision_model"), c("input_price"), c("output_price")).alias("priced"))


@query(r"SELECT conv_id, turn FROM conversations WHERE length(text) % 4 <> 0 AND regexp_matches(text, '\S')")
def f12_usable_turns(spark, d):
    """replies that ended by themselves and have text; every fourth length stands for a limit that cut them."""
    finish = F.when(F.length("text") % 4 == 0, "length").when(F.length("text") % 4 == 1, "end_turn").when(F.length("text") % 4 == 2, "stop")
    return table(spark, d, "conversations").where(R.usable(finish, F.col("text"))).select("conv_id", "turn")


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_WORDS}'))::BIGINT AS words FROM documents")
def a2_words(spark, d):
    """A2: words of every document."""
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("SELECT page_id, len(regexp_extract_all(html, '<img[\\s/>]'))::BIGINT AS images, len(regexp_extract_all(html, '<p[\\s/>]'))::BIGINT AS paragraphs FROM pages")
def a3_images(spark, d):
    """A3: elements of a kind in every page."""
    return table(spark, d, "pages").select("page_id", T.image_count(F.col("html")).alias("images"), F.regexp_count("html", F.lit(r"<p[\s/>]")).cast("bigint").alias("paragraphs"))


@query(f"SELECT doc_id, {_TOKENS.format(x='text')} AS tokens FROM documents")
def a4_tokens(spark, d):
    """A4: token estimates."""
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, round(((tokens + 300) * 10.0::DOUBLE + tokens * 0.5::DOUBLE * 2 * 50.0::DOUBLE) / 1000000, 6) AS dollars FROM (SELECT doc_id, {_TOKENS.format(x='text')} AS tokens FROM documents)")
def a5_cost(spark, d):
    """A5: expected prices."""
    rows = table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))
    return rows.select("doc_id", F.round(I.cost(F.col("tokens"), 300, 10.0, 50.0, language="zh-Hant"), 6).alias("dollars"))


@query(f"SELECT role, sum({_TOKENS.format(x='text')})::BIGINT AS tokens, round(sum({_TOKENS.format(x='text')}) * 10.0::DOUBLE / 1000000, 6) AS dollars FROM conversations GROUP BY role")
def a6_usage(spark, d):
    """Usage is summed from columns, never from accumulators."""
    tokens = F.sum(T.estimate_tokens(F.col("text")))
    return table(spark, d, "conversations").groupBy("role").agg(tokens.alias("tokens")).select("role", "tokens", F.round(F.col("tokens") * 10.0 / 1_000_000, 6).alias("dollars"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def a7_duplicates(spark, d):
    """Texts that occur more than once."""
    return table(spark, d, "documents").groupBy(T.content_key(F.col("text")).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


#: What is expected and found of every document: its first six words, and the six from its third word on.
_ARRAY_SQL = r"(SELECT doc_id AS id, w[1:6] AS expected, w[3:8] AS found FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x20]+') AS w FROM documents)) t"


def _token_rows(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x00-\x20]+)"), F.lit(1))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), words.alias("w"))
    return rows.select("id", F.slice("w", 1, 6).alias("expected"), F.slice("w", 3, 6).alias("found"))


@query(f"""SELECT id, coalesce(array_to_string(list_sort(list_distinct(list_filter(expected, lambda x: NOT list_contains(found, x)))), ' '), '') AS missing,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(found, lambda x: NOT list_contains(expected, x)))), ' '), '') AS invented,
  len(found) <> len(list_distinct(found)) AS duplicates,
  len(list_filter(expected, lambda x: NOT list_contains(found, x))) = 0 AND len(list_filter(found, lambda x: NOT list_contains(expected, x))) = 0 AND expected <> found AS reordered FROM {_ARRAY_SQL}""")
def a8_token_diff(spark, d):
    """What is wrong with what was found, of every document's words."""
    missing, invented = F.array_except("expected", "found"), F.array_except("found", "expected")
    in_order = lambda x: F.array_join(F.array_sort(x), " ")
    return _token_rows(spark, d).select("id", in_order(missing).alias("missing"), in_order(invented).alias("invented"), (F.size("found") != F.size(F.array_distinct("found"))).alias("duplicates"), ((F.size(missing) == 0) & (F.size(invented) == 0) & (F.col("expected") != F.col("found"))).alias("reordered"))


@query(f"SELECT DISTINCT id, unnest(list_concat(list_filter(expected, lambda x: NOT list_contains(found, x)), list_filter(found, lambda x: NOT list_contains(expected, x)))) AS token FROM {_ARRAY_SQL}")
def u3_sym_diff(spark, d):
    """Symmetric difference."""
    return _token_rows(spark, d).select("id", F.explode(F.concat(F.array_except("expected", "found"), F.array_except("found", "expected"))).alias("token"))


@query(f"SELECT id, coalesce(array_to_string(list_concat(expected[:least(len(found), len(expected))], expected[least(len(found), len(expected)) + 1:]), ' '), '') AS tokens FROM {_ARRAY_SQL}")
def w9_relabel(spark, d):
    """The k-th found becomes the k-th expected."""
    return _token_rows(spark, d).select("id", F.array_join(P.relabel(F.col("found"), F.col("expected")), " ").alias("tokens"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS uses FROM documents GROUP BY text")
def a11_content_dedup(spark, d):
    """One call for each content."""
    return table(spark, d, "documents").groupBy(T.content_key(F.col("text")).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("uses"))


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ' ') AS anchors FROM pages""")
def a12_anchor_sets(spark, d):
    """The set of anchors of every page, in order."""
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))), " ").alias("anchors"))


@query("SELECT source, string_agg(doc_id::VARCHAR, '; ' ORDER BY doc_id) AS docs FROM documents GROUP BY source")
def a13_string_agg(spark, d):
    """Strings joined in order."""
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), "; ").alias("docs"))


@query("""SELECT lang, (SELECT count(*) FROM (SELECT source FROM documents b WHERE b.lang = a.lang AND doc_id % 2 = 0 EXCEPT ALL SELECT source FROM documents c WHERE c.lang = a.lang AND doc_id % 2 = 1)) AS surplus FROM (SELECT DISTINCT lang FROM documents) a""")
def a14_multiset_difference(spark, d):
    """What one multiset has beyond another."""
    docs = table(spark, d, "documents").select("lang", "source", (F.col("doc_id") % 2).alias("side"))
    over = docs.where("side = 0").select("lang", "source").exceptAll(docs.where("side = 1").select("lang", "source"))
    return docs.select("lang").distinct().join(over.groupBy("lang").agg(F.count("*").alias("n")), "lang", "left").select("lang", F.coalesce("n", F.lit(0).cast("bigint")).alias("surplus"))


@query("SELECT source, count(*) FILTER (quality = 0) AS failed, CASE WHEN count(*) FILTER (quality = 0) > 0 THEN 2 ELSE 0 END AS status FROM documents JOIN labels USING (doc_id) GROUP BY source")
def a15_status(spark, d):
    """Failures and the exit status they lead to."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("failed"))
    return rows.select("source", "failed", F.when(F.col("failed") > 0, 2).otherwise(0).alias("status"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def a16_keep_first(spark, d):
    """The first of each; a minimum by digest, so copies shrink before the shuffle."""
    return table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS classes FROM (SELECT doc_id, regexp_split_to_array(lower(source || ' ' || lang || ' ' || source || ' figure'), ' ') AS l FROM documents)")
def a17_class_tokens(spark, d):
    """Class tokens once each, in order."""
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "source", "lang", "source", F.lit("figure"))), " ")), " ").alias("classes"))


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id)")
def j1_strict_lookup(spark, d):
    """An inner lookup; a miss is an error row elsewhere, not a lost book."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT d.doc_id, coalesce('label ' || l.quality::VARCHAR, d.source) AS title FROM documents d LEFT JOIN labels l USING (doc_id)")
def j3_left_fallback(spark, d):
    """The label, else a name of one's own."""
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.concat(F.lit("label "), F.col("quality").cast("string")), "source").alias("title"))


@query("SELECT d.doc_id, coalesce(l.toxic, 0)::INTEGER AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j4_default(spark, d):
    """A default where the lookup misses."""
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("toxic", F.lit(0)).cast("int").alias("toxic"))


@query("SELECT doc_id, source FROM documents WHERE doc_id BETWEEN 10 AND 40")
def j5_selected(spark, d):
    """Chosen indices and their documents."""
    chosen = spark.range(10, 41).withColumnRenamed("id", "doc_id")
    return table(spark, d, "documents").select("doc_id", "source").join(chosen, "doc_id")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def j6_pending_chapters(spark, d):
    """Documents without a checkpoint."""
    return K.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT conv_id, turn FROM conversations WHERE NOT (turn % 3 = 0 AND role = 'assistant')")
def j7_pending_chunks(spark, d):
    """Parts without a checkpoint, by a key of two columns."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return K.pending(rows.select("conv_id", "turn"), rows.where("turn % 3 = 0 and role = 'assistant'"), ["conv_id", "turn"])


@query("""WITH s AS (SELECT sha256('m' || 'v1' || text) AS key, min(doc_id) AS answer FROM documents WHERE doc_id % 4 = 0 GROUP BY 1)
  SELECT d.doc_id, sha256('m' || 'v1' || d.text) AS key, s.answer FROM documents d LEFT JOIN s ON s.key = sha256('m' || 'v1' || d.text)""")
def j8_memo_join(spark, d):
    """Requests and what the response store has for their keys."""
    requests = table(spark, d, "documents").select("doc_id", T.content_key(F.lit("m"), F.lit("v1"), F.col("text")).alias("key"))
    store = requests.where("doc_id % 4 = 0").groupBy("key").agg(F.min("doc_id").alias("answer"))
    return K.hits(requests, store, ["key"]).select("doc_id", "key", "answer")


@query("SELECT d.doc_id, m.first_doc FROM documents d JOIN (SELECT text, min(doc_id) AS first_doc FROM documents GROUP BY text) m ON d.text = m.text")
def j11_digest_fanout(spark, d):
    """One description a digest, fanned out to every use."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("k"))
    return rows.join(rows.groupBy("k").agg(F.min("doc_id").alias("first_doc")), "k").select("doc_id", "first_doc")


@query("SELECT doc_id, CASE WHEN text IS NULL OR strlen(text) % 7 = 0 THEN NULL WHEN strlen(text) % 5 = 0 THEN '' ELSE lang || ' ' || strlen(text) END AS caption FROM documents")
def d09_captions(spark, d):
    """Texts as pictures: one call for each that differs, refusals kept, failures not; one fan-out."""
    from quire.plans import captions

    def ask(content: bytes, media: str) -> str | None:
        n = len(content)
        return None if n % 7 == 0 else "" if n % 5 == 0 else f"{media} {n}"

    pictures = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), F.col("lang").alias("media"))
    store = K.StateStore(spark, _state_folder(spark))
    captions.describe(pictures, store, ask)
    return captions.describe(pictures, store, lambda content, media: None).select("doc_id", "caption")  # the second time from the store alone


#: Links of every page with a fragment, as of documents in a folder; what they name is kept, removed, absent or an
#: asset by the length of its name, and every second kept name is an anchor of its output.
_LINKED = "regexp_replace(html, 'href=\"/([^\"]*)\"', 'href=\"../\\1#\\1\"', 'g')"
_LINK_SQL = f"SELECT page_id, unnest(regexp_extract_all({_LINKED}, 'href=\"[.][.]/([^\"#]*)#', 1)) AS target FROM pages"
_KIND_SQL = "CASE length(target) % 4 WHEN 2 THEN 'kept' WHEN 3 THEN 'asset' ELSE 'unwrap' END"


def _linked(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("page_id").cast("string")
    markup = F.regexp_replace("html", 'href="/([^"]*)"', 'href="../$1#$1"')
    return table(spark, d, "pages").select(F.lit(1).alias("book_id"), F.concat(F.lit("Text/"), number, F.lit(".xhtml")).alias("path"), F.concat(F.lit("Out/"), number, F.lit(".xhtml")).alias("output"), markup.alias("markup"), "page_id")


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Kept, removed, members and anchors, of the names that the links have, which are found once and stored."""
    names = L.internal(docs.select("book_id", "path", "markup")).select("book_id", "target").distinct()
    folder = _state_folder(docs.sparkSession)
    names.write.parquet(folder)
    names = docs.sparkSession.read.schema(names.schema).parquet(folder)
    n = F.length("target") % 4
    output = F.concat(F.lit("Out/"), F.length("target").cast("string"), F.lit(" "), F.col("target"))
    kept = names.where(n == 2).select("book_id", "target", output.alias("output"))
    anchors = kept.where(F.length("target") % 8 == 2).select("book_id", F.col("output").alias("path"), F.col("target").alias("id"))
    return kept, names.where(n == 1), names.where(n != 0), anchors


@query(f"SELECT page_id, target, count(*) AS n, {_KIND_SQL} AS kind FROM ({_LINK_SQL}) GROUP BY page_id, target")
def j12_link_classify(spark, d):
    """Links of all pages: kept, unwrapped or an asset."""
    docs = _linked(spark, d)
    kinds = L.classify(L.internal(docs.select("book_id", "path", "markup")), *_named(docs)[:3])
    page = F.regexp_extract("path", "([0-9]+)", 1).cast("bigint")
    return kinds.groupBy(page.alias("page_id"), "target", "kind").agg(F.count("*").alias("n")).select("page_id", "target", "n", "kind")


@query(f"SELECT page_id, target, CASE WHEN length(target) % 8 = 2 THEN target END AS fragment, count(*) AS n FROM ({_LINK_SQL}) WHERE length(target) % 4 = 2 GROUP BY page_id, target")
def j13_fragment(spark, d):
    """Fragments of links to kept documents that still exist."""
    docs = _linked(spark, d)
    kept, removed, members, anchors = _named(docs)
    live = L.live_fragments(L.classify(L.internal(docs.select("book_id", "path", "markup")), kept, removed, members).where("kind = 'kept'"), anchors)
    page = F.regexp_extract("path", "([0-9]+)", 1).cast("bigint")
    return live.groupBy(page.alias("page_id"), "target", "fragment").agg(F.count("*").alias("n"))


_HREF = "url_encode(length(target) || ' ' || target) || CASE WHEN length(target) % 8 = 2 THEN '#' || replace(url_encode(target), '%3A', ':') ELSE '' END"
_NEW_TAG = f"CASE {_KIND_SQL} WHEN 'kept' THEN '<a href=\"' || {_HREF} || '\">' WHEN 'asset' THEN '<a href=\"../' || url_encode(target) || '#' || target || '\">' ELSE '' END"


@query(f"""WITH c AS (SELECT page_id, string_split_regex(html, '<a href="/[^"]*">[^<]*</a>') AS t, regexp_extract_all(html, '<a href="/([^"]*)">[^<]*</a>', 1) AS targets, regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1) AS labels FROM pages),
  e AS (SELECT page_id, unnest(range(len(t))) AS n, unnest(t) AS text, unnest(list_concat(targets, [NULL])) AS target, unnest(list_concat(labels, [''])) AS label FROM c)
  SELECT page_id, string_agg(text || CASE WHEN target IS NULL THEN '' WHEN {_KIND_SQL} = 'unwrap' THEN label ELSE {_NEW_TAG} || label || '</a>' END, '' ORDER BY n) AS markup FROM e GROUP BY page_id""")
def d13_rewrite_links(spark, d):
    """All pages with their links rewritten."""
    docs = _linked(spark, d)
    return L.rewrite(docs, *_named(docs)).select("page_id", "markup")


@query("""WITH a AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS id FROM pages)
  SELECT page_id, id FROM a WHERE length(id) % 2 = 0""")
def j14_missing_anchor(spark, d):
    """Anchors that didn't survive."""
    every = table(spark, d, "pages").select(F.lit(1).alias("book_id"), F.col("page_id").cast("string").alias("path"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("id"))
    return L.missing_anchors(every, every.where(F.length("id") % 2 == 1)).select(F.col("path").cast("bigint").alias("page_id"), "id")


@query("SELECT page_id FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 3 = 0)")
def j15_manifest_anti(spark, d):
    """Manifest entries that are no documents."""
    rows = table(spark, d, "pages").select("page_id")
    return rows.join(rows.where("page_id % 3 = 0"), "page_id", "left_anti")


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 <> 0 AND page_id <> 1")
def j16_assets(spark, d):
    """Members less documents, generated files and the signature."""
    rows = table(spark, d, "pages").select("page_id")
    gone = rows.where("page_id % 3 = 0").union(rows.where("page_id % 5 = 0")).union(rows.where("page_id = 1"))
    return rows.join(gone.distinct(), "page_id", "left_anti")


@query("SELECT printf('chap_%03d.xhtml', doc_id) AS path FROM documents WHERE doc_id % 100 = 7")
def j18_conflict(spark, d):
    """Generated names that an asset has already."""
    generated = table(spark, d, "documents").select(T.chapter_name(F.col("doc_id")).alias("path"))
    taken = table(spark, d, "documents").where("doc_id % 100 = 7").select(T.chapter_name(F.col("doc_id")).alias("path"))
    return generated.join(taken, "path", "left_semi")


@query("""WITH t AS (SELECT doc_id, split_part(text, ' ', 1) AS term, split_part(text, ' ', 2) AS rendering FROM documents WHERE text IS NOT NULL),
  g AS (SELECT term, arg_min(rendering, doc_id) AS existing FROM t GROUP BY term)
  SELECT t.doc_id, t.term, t.rendering, g.existing FROM t JOIN g USING (term) WHERE t.rendering <> g.existing""")
def j20_term_conflict(spark, d):
    """Terms that exist with another rendering."""
    terms = table(spark, d, "documents").where("text is not null").select("doc_id", F.split_part(F.col("text"), F.lit(" "), F.lit(1)).alias("term"), F.split_part(F.col("text"), F.lit(" "), F.lit(2)).alias("rendering"))
    return K.conflicts(terms, K.first(terms, ["term"], "doc_id", "rendering")).select("doc_id", "term", "rendering", "existing")


@query("""SELECT page_id, 'nav target' AS problem FROM pages WHERE page_id % 10 = 3 UNION ALL SELECT page_id, 'unreachable spine' FROM pages WHERE page_id % 10 = 4
  UNION ALL SELECT page_id, 'manifest resource' FROM pages WHERE page_id % 10 = 3""")
def j21_integrity(spark, d):
    """Broken references of packages."""
    rows = table(spark, d, "pages").select(F.lit(1).alias("book_id"), F.col("page_id").cast("string").alias("path"), "page_id")
    members = rows.where("page_id % 10 <> 3").select("book_id", "path")
    nav = rows.where("page_id % 10 <> 4").select("book_id", "path", F.lit(None).cast("string").alias("fragment"))
    none = spark.createDataFrame([], "book_id int, path string, id string")
    return L.integrity(nav, rows.select("book_id", "path"), rows.select("book_id", "path"), members, none).select(F.col("path").cast("bigint").alias("page_id"), "problem")


@query("SELECT conv_id, unnest(generate_series(min(turn), max(turn))) AS idx FROM conversations GROUP BY conv_id")
def j23_range_select(spark, d):
    """Ranges and the indices inside them."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"))
    return rows.select("conv_id", F.explode(F.sequence("low", "high")).alias("idx"))


_PATTERN_SQL = "SELECT DISTINCT pattern FROM (SELECT '#' || p_partkey AS pattern FROM part WHERE p_size = 7 UNION ALL SELECT lower(p_name) || ' #' || p_partkey FROM part WHERE p_size = 8 UNION ALL SELECT upper(left(p_name, 2)) FROM part WHERE p_size = 9 UNION ALL SELECT p_type FROM part WHERE p_size = 10)"


@query(f"SELECT pattern, min(p_partkey) AS idx FROM part JOIN ({_PATTERN_SQL}) ON contains(lower(p_name || ' #' || p_partkey), lower(pattern)) GROUP BY pattern HAVING count(*) = 1")
def j24_title_match(spark, d):
    """Patterns that are in exactly one title, by an index of the titles; patterns are numbers, whole titles,
    beginnings and types of parts of some sizes."""
    parts = table(spark, d, "part")
    title = lambda name: F.concat(name, F.lit(" #"), "p_partkey")
    some = lambda size, pattern: parts.where(F.col("p_size") == size).select(pattern.alias("pattern"))
    patterns = some(7, F.concat(F.lit("#"), "p_partkey")).union(some(8, title(F.lower("p_name")))).union(some(9, F.upper(F.substring("p_name", 1, 2)))).union(some(10, F.col("p_type")))
    return S.title_matches(parts.select(F.lit(1).alias("book_id"), F.col("p_partkey").alias("idx"), title("p_name").alias("title")), patterns).select("pattern", "idx")


@query("SELECT source, idx FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS idx, lang FROM documents) WHERE (idx BETWEEN 2 AND 9 OR lang = 'fr') AND idx NOT IN (4, 5) AND doc_id % 6 <> 0")
def u1_selection_algebra(spark, d):
    """Ranges and titles together, less exclusions, less front matter."""
    chapters = P.dense_index(table(spark, d, "documents").select(F.col("source").alias("book_id"), "doc_id", "lang"), "book_id", "doc_id").withColumn("front_matter", F.col("doc_id") % 6 == 0)
    picked = chapters.where("idx between 2 and 9").union(chapters.where("lang = 'fr'"))
    return S.algebra(chapters, picked, chapters.where("idx in (4, 5)").select("book_id", "idx")).select(F.col("book_id").alias("source"), "idx")


_GRAMMAR = "CASE length(t) % 6 WHEN 0 THEN 'all' WHEN 1 THEN '1, ' || n || '-' WHEN 2 THEN n || '' WHEN 3 THEN ' 2 - ' || n || ' ,1' WHEN 4 THEN (n + 1) || '' ELSE '1,,2' END"
_GRAMMAR_OUT = "CASE length(t) % 6 WHEN 0 THEN range(1, n + 1) WHEN 1 THEN list_sort(list_distinct([1, n])) WHEN 2 THEN [n] WHEN 3 THEN CASE WHEN n >= 2 THEN range(1, n + 1) ELSE [] END ELSE [] END"


@query(f"SELECT conv_id, expr, unnest(l::BIGINT[]) AS idx FROM (SELECT conv_id, {_GRAMMAR} AS expr, {_GRAMMAR_OUT} AS l FROM (SELECT conv_id, count(*) AS n, arg_min(text, turn) AS t FROM conversations GROUP BY conv_id))")
def u2_grammar(spark, d):
    """The range grammar for conversations as books of turns; invalid expressions give no index."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("text", "turn").alias("t"))
    n, kind = F.col("n").cast("string"), F.length("t") % 6
    expr = F.when(kind == 0, "all").when(kind == 1, F.concat(F.lit("1, "), n, F.lit("-"))).when(kind == 2, n).when(kind == 3, F.concat(F.lit(" 2 - "), n, F.lit(" ,1"))).when(kind == 4, (F.col("n") + 1).cast("string")).otherwise("1,,2")
    return rows.select("conv_id", expr.alias("expr"), "n").select("conv_id", "expr", F.explode(S.expand(F.col("expr"), F.col("n"))).alias("idx"))


@query("SELECT DISTINCT lang, source FROM documents ORDER BY ALL")
def l1_sorted(spark, d):
    """Sorted and once each."""
    return table(spark, d, "documents").select("lang", "source").distinct().orderBy("lang", "source")


@query("""SELECT event_id, sha256('{"' || event_type || '":"' || user_id || '","props":' || to_json(props) || '}') AS key FROM events WHERE event_type < 'props'
  UNION ALL SELECT event_id, sha256('{"props":' || to_json(props) || ',"' || event_type || '":"' || user_id || '"}') FROM events WHERE event_type > 'props'""")
def l5_canonical_key(spark, d):
    """Keys of maps, whatever the order that their entries were put in."""
    entries = [(F.lit("props"), F.col("props")), (F.col("event_type"), F.col("user_id").cast("string"))]
    made = F.when(F.col("value") > 10, F.create_map(*entries[0], *entries[1])).otherwise(F.create_map(*entries[1], *entries[0]))
    return table(spark, d, "events").select("event_id", T.content_key(T.canonical_json(made)).alias("key"))


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def l2_preview(spark, d):
    """L2: the first selected document of every book."""
    return table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"))


@query("""SELECT d.doc_id, coalesce(substr(last_value(CASE WHEN d.lang <> 'de' THEN d.text END IGNORE NULLS) OVER (PARTITION BY d.source ORDER BY d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1, 12000), '') AS previous FROM documents d""")
def w2_carry_previous(spark, d):
    """What the last successful chapter gave."""
    rows = table(spark, d, "documents").select("doc_id", "source", "text", (F.col("lang") != "de").alias("ok"))
    return P.carry_previous(rows, "source", "doc_id", "text", "ok").select("doc_id", "previous")


@query("""SELECT conv_id, turn, coalesce(right(string_agg(text, '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6000), '') AS tail FROM conversations""")
def w3_prefix_tail(spark, d):
    """The end of all earlier parts."""
    return P.previous_parts(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "tail")


@query("SELECT user_id, event_id, min_by(value, event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events")
def w4_running_first(spark, d):
    """The glossary so far, where the first rendering stays."""
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return K.so_far(rows, ["user_id", "event_type"], "event_id", "value").select("user_id", "event_id", "value")


_PACK = """list_reduce(list_prepend({{'a': 0::BIGINT, 'm': 0::BIGINT, 'p': 0::BIGINT, 'l': []::BIGINT[]}}, list_transform({pieces}, lambda x: {{'a': length(regexp_replace(x, '[^\\x00-\\x7F]', '', 'g'))::BIGINT, 'm': (length(x) - length(regexp_replace(x, '[^\\x00-\\x7F]', '', 'g')))::BIGINT, 'p': 0::BIGINT, 'l': []::BIGINT[]}})),
  lambda s, x: CASE WHEN s.p = 0 OR (s.a + s.m > 0 AND greatest(1, (s.a + x.a + 2) // 3 + 2 * (s.m + x.m)) > 200) THEN {{'a': x.a, 'm': x.m, 'p': s.p + 1, 'l': list_append(s.l, s.p + 1)}} ELSE {{'a': s.a + x.a, 'm': s.m + x.m, 'p': s.p, 'l': list_append(s.l, s.p)}} END).l"""


@query(f"SELECT doc_id, array_to_string({_PACK.format(pieces='string_split(text, chr(10))')}, ',') AS parts FROM documents WHERE text IS NOT NULL")
def w6_greedy_pack(spark, d):
    """Greedy packing of lines within a limit."""
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.array_join(F.transform(P.pack(F.split("text", "\n", -1), 200), lambda x: x.cast("string")), ",").alias("parts"))


@query("""SELECT page_id, n::BIGINT AS n, 'c' || page_id || '-heading-' || n AS id FROM (SELECT page_id, unnest(generate_series(1, len(regexp_extract_all(html, '<h[12][ >]')))) AS n FROM pages)""")
def w7_heading_ids(spark, d):
    """Ids of headings by ordinal."""
    n = F.regexp_count("html", F.lit("<h[12][ >]"))
    rows = table(spark, d, "pages").where(n > 0).select("page_id", F.explode(F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))).alias("n"))
    return rows.select("page_id", "n", F.format_string("c%d-heading-%d", "page_id", "n").alias("id"))


@query("SELECT source AS book_id, doc_id AS entry, c AS child, row_number() OVER (PARTITION BY source ORDER BY doc_id, c) AS play_order FROM documents, generate_series(0, doc_id % 3) t(c)")
def w10_play_order(spark, d):
    """Reading order over entries and their children."""
    rows = table(spark, d, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("entry"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("doc_id") % 3)).alias("child"))
    return P.play_order(rows)


@query("SELECT conv_id, arg_min(text, turn) AS title FROM conversations GROUP BY conv_id")
def w11_part1_title(spark, d):
    """What the first part alone decides."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"))


_ESCAPE = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"SELECT page_id, {_ESCAPE.format(x='html')} AS escaped FROM pages")
def x8_escape(spark, d):
    """Markup-safe text."""
    return table(spark, d, "pages").select("page_id", T.escape(F.col("html")).alias("escaped"))


@query("""WITH t AS (SELECT split_part(text, ' ', 1) AS term, arg_min(split_part(text, ' ', 2), doc_id) AS rendering, source FROM documents WHERE text IS NOT NULL GROUP BY source, term)
  SELECT source, '<h1>Glossary</h1><dl>' || string_agg('<dt>' || """ + _ESCAPE.format(x="term") + " || '</dt><dd>' || " + _ESCAPE.format(x="rendering") + """ || '</dd>', '' ORDER BY term) || '</dl>' AS markup FROM t GROUP BY source""")
def d20_glossary_markup(spark, d):
    """A glossary as markup, in order of terms."""
    part = lambda n: F.split_part(F.col("text"), F.lit(" "), F.lit(n))
    terms = K.first(table(spark, d, "documents").where("text is not null").select("source", "doc_id", part(1).alias("term"), part(2).alias("rendering")), ["source", "term"], "doc_id", "rendering")
    rows = F.array_sort(F.collect_list(F.struct("term", F.concat(F.lit("<dt>"), T.escape(F.col("term")), F.lit("</dt><dd>"), T.escape(F.col("rendering")), F.lit("</dd>")).alias("m"))))
    return terms.groupBy("source").agg(F.concat(F.lit("<h1>Glossary</h1><dl>"), F.array_join(F.transform(rows, lambda r: r["m"]), ""), F.lit("</dl>")).alias("markup"))


@query("SELECT event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) AS value FROM events")
def x12_json(spark, d):
    """JSON decoding."""
    return table(spark, d, "events").select("event_id", F.get(F.map_values(F.from_json("props", "map<string,string>")), F.lit(0)).alias("value"))


@query("SELECT doc_id, printf('chap_%03d.xhtml', doc_id) AS name FROM documents")
def x13_format(spark, d):
    """Generated names."""
    return table(spark, d, "documents").select("doc_id", T.chapter_name(F.col("doc_id")).alias("name"))


@query("SELECT event_id, printf('$%.4f', value) AS price FROM events WHERE value IS NOT NULL")
def x17_money(spark, d):
    """Prices as text."""
    return table(spark, d, "events").where("value is not null").select("event_id", T.dollars(F.col("value")).alias("price"))


@query(f"SELECT d.doc_id, CASE WHEN l.quality = 0 THEN '<p class=\"kept-original\">The original is kept.</p>' ELSE '<h1 class=\"original-title\">' || {_ESCAPE.format(x='d.source')} || '</h1>' END AS prefix FROM documents d LEFT JOIN labels l USING (doc_id)")
def d15_prefix(spark, d):
    """The original title, or a warning."""
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    title = F.concat(F.lit('<h1 class="original-title">'), T.escape(F.col("source")), F.lit("</h1>"))
    return rows.select("doc_id", F.when(F.col("quality") == 0, '<p class="kept-original">The original is kept.</p>').otherwise(title).alias("prefix"))


@query("SELECT page_id, trim(CASE WHEN regexp_matches(html, '<svg[ />]') THEN 'svg ' ELSE '' END || CASE WHEN regexp_matches(html, '<math[ />]') THEN 'mathml ' ELSE '' END || CASE WHEN regexp_matches(html, '<script[ />]') THEN 'scripted' ELSE '' END) AS properties FROM pages")
def d16_live_props(spark, d):
    """Properties that the content itself has."""
    has = lambda tag, name: F.when(F.col("html").rlike(f"<{tag}[ />]"), F.lit(name))
    return table(spark, d, "pages").select("page_id", F.concat_ws(" ", has("svg", "svg"), has("math", "mathml"), has("script", "scripted")).alias("properties"))


_ESCAPE_TEXT = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_EACH = N.TAG.replace("'", "''")

#: Tags of pages as rows, elements of one name as pairs of rows; for the two queries below.
_NESTED = rf"""c AS (SELECT page_id, string_split_regex(html, '{_EACH}') AS t, regexp_extract_all(html, '{_EACH}') AS g FROM pages),
e AS (SELECT page_id, unnest(range(len(t))) AS n, unnest(t) AS text, unnest(list_concat(g, [''])) AS tag FROM c),
k AS (SELECT *, lower(regexp_extract(tag, '{N.NAME}', 1)) AS name FROM e),
f AS (SELECT *, CASE WHEN starts_with(tag, '</') THEN 'close' WHEN name IN ('', {", ".join(f"'{v}'" for v in N.VOID)}) OR regexp_matches(tag, '/\s*>$') THEN 'whole' ELSE 'open' END AS kind FROM k),
a AS (SELECT *, CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END AS step, coalesce(sum(length(text) + length(tag)) OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS begins FROM f),
s AS (SELECT *, sum(step) OVER w AS s FROM a WINDOW w AS (PARTITION BY page_id, name ORDER BY n)),
m AS (SELECT *, s - least(min(s) OVER w, 0) AS after FROM s WINDOW w AS (PARTITION BY page_id, name ORDER BY n)),
l AS (SELECT *, CASE kind WHEN 'open' THEN after WHEN 'close' THEN nullif(lag(after, 1, 0) OVER w, 0) END AS level FROM m WINDOW w AS (PARTITION BY page_id, name ORDER BY n)),
o AS (SELECT *, CASE WHEN level IS NOT NULL THEN CASE kind WHEN 'open' THEN lead(n) OVER p WHEN 'close' THEN lag(n) OVER p END END AS other, lead(begins + length(tag)) OVER p AS pair_end FROM l WINDOW p AS (PARTITION BY page_id, name, level ORDER BY n))"""


@query(f"WITH {_NESTED} SELECT page_id, n, name, coalesce(level, 0)::BIGINT AS level, begins::BIGINT AS begins, (CASE WHEN other IS NOT NULL THEN pair_end ELSE begins + length(tag) END)::BIGINT AS ends, other IS NOT NULL AS closed FROM o WHERE name <> '' AND kind IN ('open', 'whole')")
def x5_nested_sets(spark, d):
    """The elements of every page as intervals."""
    return N.elements(table(spark, d, "pages"), "html", ("page_id",))


def _fragment():
    """A figure, code and the whole markup of every page."""
    return F.concat(F.lit("<h1>"), T.escape(F.coalesce(I.heading(F.col("html")), F.lit(""))), F.lit('</h1><p>before</p><figure><img src="'), T.escape(F.col("url")), F.lit('"/></figure><p>text <code>x = 1</code> after</p>'), F.col("html"))


def _protected(spark, d):
    """Pages with their figure, notices, menus and footers held."""
    rows = table(spark, d, "pages").select("page_id", _fragment().alias("markup"))
    return N.protect(rows, "markup", ("page_id",), figures=("figure", "div"), media=("svg", "object", "nav", "footer"))


_H1 = "'<h1>' || " + _ESCAPE.format(x=_UNESCAPE.format(x=_STRIP.format(x=_TITLE_TAG))) + " || '</h1><p>before</p>'"
_WITHOUT = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<div.*?</div>', chr(10) || '[[MEDIA_2]]' || chr(10)), '(?s)<nav.*?</nav>', chr(10) || '[[MEDIA_4]]' || chr(10)), '(?s)<footer.*?</footer>', chr(10) || '[[MEDIA_5]]' || chr(10))"


@query(f"SELECT page_id, {_H1} || chr(10) || '[[IMG_1]]' || chr(10) || '<p>text ' || chr(10) || '[[CODE_3]]' || chr(10) || ' after</p>' || {_WITHOUT} AS xhtml, 5::BIGINT AS n_tokens, regexp_extract(html, '(?s)<nav.*?</nav>') AS menu FROM pages")
def d01_protect(spark, d):
    """Figures, code and media of whole pages give way to placeholders; all else stays as written."""
    menu = F.filter("held", lambda h: h["number"] == 4)
    return _protected(spark, d).select("page_id", "xhtml", F.size("held").cast("bigint").alias("n_tokens"), F.get(menu, F.lit(0))["markup"].alias("menu"))


@query(f"SELECT page_id, {_H1} || chr(10) || '[[IMG_1]]' || chr(10) || '<p>text ' || chr(10) || '[[CODE_3]]' || chr(10) || ' after</p>' || {_WITHOUT} || '<i></i>' || chr(10) || '[[MEDIA_9]]' || chr(10) AS xhtml FROM pages")
def d04_canonicalize(spark, d):
    """Placeholders of answers that were renamed, swapped and put into attributes take their names again."""
    said = F.replace(F.replace(F.replace("xhtml", F.lit("[[CODE_3]]"), F.lit("[[IMG_7]]")), F.lit("[[MEDIA_4]]"), F.lit("[[IMG_1]]")), F.lit("[[MEDIA_5]]"), F.lit("[[CODE_3]]"))
    rows = _protected(spark, d).select("page_id", F.concat(said, F.lit('<i title="[[IMG_2]] "></i>')).alias("said"), F.concat(F.regexp_extract_all("xhtml", F.lit(T.TOKEN), F.lit(0)), F.array(F.lit("[[MEDIA_9]]"))).alias("expected"))
    return N.canonicalized(rows, "said", "expected", ("page_id",))


@query(f"SELECT page_id, replace({_H1} || '<figure><img src=\"' || " + _ESCAPE.format(x="url") + " || '\"/></figure><p>text <code>x = 1</code> after</p>' || html, chr(10), '') AS restored, NULL::VARCHAR AS error FROM pages")
def d05_restore(spark, d):
    """Restored pages are what they were, but for the lines that placeholders stood on."""
    return N.restore(_protected(spark, d), "xhtml", "held", ("page_id",)).select("page_id", F.replace("restored", F.lit("\n"), F.lit("")).alias("restored"), "error")


_LIMIT = 400
_WEIGHT = "(6 * length({x}) - 5 * length(regexp_replace({x}, '[^\x00-\x7F]', '', 'g')))"
_SPLIT = rf"""WITH {_NESTED},
w AS (SELECT *, {_WEIGHT.format(x="text")} AS text_w, {_WEIGHT.format(x="tag")} AS tag_w, other IS NOT NULL AND name IN ({", ".join(f"'{v}'" for v in N.WRAPPERS)}) AS wrapper FROM o),
x AS (SELECT *, sum(text_w + tag_w) OVER d AS upto, sum(CASE WHEN other IS NOT NULL AND NOT wrapper THEN step ELSE 0 END) OVER d AS solid, sum(text_w + tag_w) OVER (PARTITION BY page_id) AS total FROM w WINDOW d AS (PARTITION BY page_id ORDER BY n)),
y AS (SELECT x.*, coalesce(x.wrapper AND greatest(x.solid, z.solid) = 0 AND (abs(z.upto - x.upto) + CASE x.kind WHEN 'open' THEN x.tag_w ELSE z.tag_w END + 2) // 3 > {_LIMIT} AND (x.total + 2) // 3 > {_LIMIT}, false) AS shell FROM x LEFT JOIN x z ON z.page_id = x.page_id AND z.n = x.other),
v AS (SELECT *, sum(CASE WHEN other IS NOT NULL AND NOT shell THEN step ELSE 0 END) OVER d AS cover FROM y WINDOW d AS (PARTITION BY page_id ORDER BY n)),
b AS (SELECT *, lag(cover, 1, 0) OVER d AS cover_before, (total + 2) // 3 <= {_LIMIT} AS whole_page FROM v WINDOW d AS (PARTITION BY page_id ORDER BY n)),
q AS (SELECT *, (CASE WHEN whole_page THEN n = 0 ELSE cover_before = 0 AND text <> '' END)::INT AS new_text, (CASE WHEN whole_page THEN false ELSE cover_before = 0 AND tag <> '' AND NOT shell END)::INT AS new_tag FROM b),
r AS (SELECT *, sum(new_text + new_tag) OVER (PARTITION BY page_id ORDER BY n) AS unit FROM q),
pieces AS (SELECT page_id, n, 0 AS k, unit - new_tag AS unit, text AS s, text_w AS w FROM r WHERE text <> '' UNION ALL SELECT page_id, n, 1, unit, tag, tag_w FROM r WHERE tag <> '' AND NOT shell),
units AS (SELECT page_id, unit, min(n) AS n, string_agg(s, '' ORDER BY n, k) AS body, sum(w) AS w FROM pieces GROUP BY page_id, unit),
shells AS (SELECT page_id, n, other, name, tag, unit + 1 AS first FROM r WHERE shell AND kind = 'open'),
around AS (SELECT u.page_id, u.unit, string_agg(CASE WHEN first = u.unit THEN tag ELSE regexp_replace(tag, '(?i)\s+id\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', '', 'g') END, '' ORDER BY h.n) AS opens, string_agg('</' || name || '>', '' ORDER BY h.n DESC) AS closes
  FROM units u JOIN shells h ON h.page_id = u.page_id AND h.n < u.n AND h.other >= u.n GROUP BY u.page_id, u.unit),
shelled AS (SELECT page_id, unit, (w + 2) // 3 > {_LIMIT} AS over, w + {_WEIGHT.format(x="coalesce(opens || closes, '')")} AS w, regexp_matches(coalesce(opens, '') || body, '(?i)^\s*<h[12][\s>]') AS heading, coalesce(opens, '') || body || coalesce(closes, '') AS s FROM units LEFT JOIN around USING (page_id, unit)),
docs AS (SELECT page_id, list(s ORDER BY unit) AS s, list(over ORDER BY unit) AS over, list({{'w': w::BIGINT, 'h': heading, 'p': 0::BIGINT, 'l': []::BIGINT[]}} ORDER BY unit) AS u FROM shelled GROUP BY page_id),
packed AS (SELECT page_id, s, over, list_reduce(list_prepend({{'w': 0::BIGINT, 'h': false, 'p': 0::BIGINT, 'l': []::BIGINT[]}}, u), lambda t, z: CASE WHEN t.p = 0 OR t.w > 0 AND (t.w + z.w > {3 * _LIMIT} OR z.h) THEN {{'w': z.w, 'h': false, 'p': t.p + 1, 'l': list_append(t.l, t.p + 1)}} ELSE {{'w': t.w + z.w, 'h': false, 'p': t.p, 'l': list_append(t.l, t.p)}} END).l AS parts FROM docs),
each_ AS (SELECT page_id, unnest(parts) AS part, unnest(s) AS s, unnest(over) AS over, unnest(range(len(s))) AS i FROM packed)
SELECT page_id, part, string_agg(s, '' ORDER BY i) AS xhtml, CASE WHEN bool_or(over) THEN 'a block that can''t be divided is over the limit' END AS error FROM each_ GROUP BY page_id, part"""


@query(_SPLIT)
def d06_split_chapter(spark, d):
    """Whole pages in parts of whole blocks, each with the wrappers around it."""
    return N.split(table(spark, d, "pages"), "html", ("page_id",), _LIMIT)


_BASE = "regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1)"
_REFERENCES = f"""SELECT page_id, i AS n, {_BASE} AS base, CASE i % 4 WHEN 0 THEN '/' || w WHEN 1 THEN '../' || w || '/./a%20b+' || i || '.png?q#f' WHEN 2 THEN w || '//../../../' || url_encode(w) ELSE './' || url_encode(w) || '/100%' END AS reference
  FROM (SELECT page_id, url, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS l FROM pages))"""
_FOLD = "list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({x}, '/'), lambda s: [s])), lambda st, p: CASE WHEN p[1] IN ('', '.') THEN st WHEN p[1] <> '..' THEN list_concat(st, p) WHEN len(st) > 0 AND st[-1] <> '..' THEN st[:-2] WHEN starts_with({x}, '/') THEN st ELSE list_append(st, '..') END)"
_DECODED = "url_decode(regexp_extract(reference, '^([^?#]*)', 1))"


def _references(spark: SparkSession, d: str) -> DataFrame:
    """References of four kinds from every page's path, made of the names that its links have."""
    from quire.functions.paths import percent_encoded

    base = F.regexp_extract("url", r"^[a-z]+://[^/?#]*/?([^?#]*)", 1)
    rows = table(spark, d, "pages").select("page_id", base.alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("i", "w"))
    n, w = (F.col("i") + 1).cast("bigint"), F.col("w")
    made = F.when(n % 4 == 0, F.concat(F.lit("/"), w)).when(n % 4 == 1, F.concat(F.lit("../"), w, F.lit("/./a%20b+"), n.cast("string"), F.lit(".png?q#f")))
    made = made.when(n % 4 == 2, F.concat(w, F.lit("//../../../"), percent_encoded(w))).otherwise(F.concat(F.lit("./"), percent_encoded(w), F.lit("/100%")))
    return rows.select("page_id", n.alias("n"), "base", made.alias("reference"))


@query(f"""WITH r AS ({_REFERENCES}), p AS (SELECT *, CASE WHEN starts_with({_DECODED}, '/') THEN {_DECODED} ELSE regexp_extract(base, '^(.*/)?') || {_DECODED} END AS joined FROM r), f AS (SELECT *, {_FOLD.format(x="joined")} AS st FROM p)
  SELECT page_id, n, reference, CASE WHEN starts_with(joined, '/') THEN '/' ELSE '' END || CASE WHEN len(st) = 0 AND NOT starts_with(joined, '/') THEN '.' ELSE array_to_string(st, '/') END AS path FROM f""")
def x1_resolve_path(spark, d):
    """References against the paths of all pages, folded inside the JVM."""
    from quire.functions.paths import resolve_path_column

    return _references(spark, d).select("page_id", "n", "reference", resolve_path_column(F.col("base"), F.col("reference")).alias("path"))


@query(f"""WITH r AS (SELECT page_id, n, base, base || CASE n % 3 WHEN 0 THEN '' ELSE '/../' || split_part(reference, '/', 2) || '/x y' END AS target FROM ({_REFERENCES})),
  f AS (SELECT *, {_FOLD.format(x="regexp_extract(base, '^(.*/)?')")} AS a, {_FOLD.format(x="target")} AS b FROM r),
  g AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[:i] = b[:i])) AS same FROM f)
  SELECT page_id, n, target, coalesce(nullif(array_to_string(list_concat(list_transform(range(len(a) - same), lambda i: '..'), list_transform(b[same + 1:], lambda s: url_encode(s))), '/'), ''), '.') AS reference FROM g""")
def x2_relative(spark, d):
    """References from the paths of all pages."""
    from quire.functions.paths import relative_column

    more = F.when(F.col("n") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/../"), F.split_part("reference", F.lit("/"), F.lit(2)), F.lit("/x y")))
    rows = _references(spark, d).select("page_id", "n", "base", F.concat("base", more).alias("target"))
    return rows.select("page_id", "n", "target", relative_column(F.col("base"), F.col("target")).alias("reference"))


@query("SELECT doc_id, sha256(lang || chr(0) || source || chr(0) || coalesce(text, '')) AS digest FROM documents")
def x4_digest(spark, d):
    """A digest of several fields, with separators."""
    return table(spark, d, "documents").select("doc_id", T.content_key(F.col("lang"), F.lit("\0"), F.col("source"), F.lit("\0"), F.col("text")).alias("digest"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all('[[IMG_' || doc_id || ']] x [[CODE_2]] [[NO_3]]', '\[\[(?:IMG|CODE|MEDIA)_[0-9]+\]\]'), ' ') AS tokens FROM documents")
def x7_placeholders(spark, d):
    """Placeholders of a text."""
    text = F.concat(F.lit("[[IMG_"), F.col("doc_id").cast("string"), F.lit("]] x [[CODE_2]] [[NO_3]]"))
    return table(spark, d, "documents").select("doc_id", F.array_join(T.placeholders(text), " ").alias("tokens"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def x10_url_parts(spark, d):
    """The parts of a URL."""
    part = lambda name: F.coalesce(F.try_parse_url("url", F.lit(name)), F.lit(""))
    return table(spark, d, "pages").select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"))


@query("SELECT doc_id, 'data:text/plain;base64,' || to_base64(encode(text)) AS uri FROM documents")
def x11_data_uri(spark, d):
    """X11: data URIs."""
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(F.base64(F.col("text").cast("binary")), "\\s", "")).alias("uri"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS modified FROM events")
def x14_timestamp(spark, d):
    """Times as package files have them."""
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN least(600.0, k * k) WHEN 'view' THEN 0.0 ELSE least(60.0, pow(2.0, k % 8)) END AS delay FROM (SELECT event_id, event_type, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)""")
def x15_retry_delay(spark, d):
    """Delays that a server asks for (of errors the square of k seconds, of views a time that has gone), or that
    grow by themselves; without the part of a second that is random."""
    k = F.get_json_object("props", "$.k").cast("double")
    asked = F.when(F.col("event_type") == "error", (k * k).cast("string")).when(F.col("event_type") == "view", F.date_format("ts", "E, dd MMM yyyy HH:mm:ss 'GMT'")).when(F.col("event_type") == "click", "soon")
    return table(spark, d, "events").select("event_id", R.retry_delay(asked, k % 8).alias("delay"))


_PHRASE_SQL = r"""SELECT DISTINCT unnest([array_to_string(w[1:1], ' '), array_to_string(w[1:2], ' '), array_to_string(w[1:3], ' ')]) AS p FROM (SELECT string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 1))"""


@query(f"""SELECT doc_id, md5(CASE WHEN pattern IS NULL THEN text ELSE regexp_replace(text, pattern, '<\\1>', 'g') END) AS converted FROM documents,
  (SELECT '(' || string_agg(regexp_escape(p), '|' ORDER BY length(p) DESC, p) || ')' AS pattern FROM ({_PHRASE_SQL}) WHERE p <> '')""")
def x16_phrases(spark, d):
    """The first words of some documents, wherever they are in all documents, leftmost and longest."""
    from quire.operators import phrases

    docs = table(spark, d, "documents").select("doc_id", "text")
    some = docs.where("text is not null").join(table(spark, d, "labels").where("quality = 0 and toxic = 1").select("doc_id"), "doc_id", "left_semi")
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1)
    made = some.select(F.explode(F.array(*(F.array_join(F.slice(words, 1, n), " ") for n in (1, 2, 3)))).alias("phrase")).distinct()
    converted = phrases.convert(docs, "text", made.select("phrase", F.concat(F.lit("<"), "phrase", F.lit(">")).alias("rendering")))
    return converted.select("doc_id", F.md5(F.col("text").cast("binary")).alias("converted"))


@query("""SELECT page_id, '[[IMG_1]] [[CODE_3]] [[MEDIA_4]]  [[MEDIA_5]] ' AS text, '[[MEDIA_2]]' AS missing FROM pages""")
def d03_repair_tokens(spark, d):
    """Placeholders of an answer that were not asked for or come again go; what lacks is named."""
    rows = _protected(spark, d).select("page_id", F.transform("held", lambda h: h["token"]).alias("expected"))
    said = F.concat(F.array_join(F.filter("expected", lambda t: t != "[[MEDIA_2]]"), " "), F.lit(" [[IMG_1]][[CODE_99]]"))
    said = F.replace(said, F.lit("[[MEDIA_5]]"), F.lit("[[IMG_9]] [[MEDIA_5]]"))
    fixed = N.repaired(said, F.col("expected"))
    return rows.select("page_id", fixed.alias("r")).select("page_id", "r.text", F.array_join("r.missing", " ").alias("missing"))


_PLAIN = r"regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"


@query(f"""SELECT doc_id, CASE lang WHEN 'de' THEN 'term conflict: ''term'' is ''fixed'' already' WHEN 'es' THEN 'the answer is no well-formed XHTML; give the two elements and nothing around them' WHEN 'fr' THEN 'generated event handlers' END AS error,
  CASE WHEN lang NOT IN ('de', 'es', 'fr') THEN source END AS title, CASE WHEN lang NOT IN ('de', 'es', 'fr') THEN md5('<p>' || {_ESCAPE.format(x=_PLAIN)} || '</p>') END AS body, CASE WHEN lang NOT IN ('de', 'es', 'fr') THEN 'term=fixed, ' || source || '=' || lang END AS terms FROM documents""")
def d07_parse_response(spark, d):
    """Answers that hold whole texts, read, or the rule that they break: by language a conflict, markup
    that isn't well-formed, an event handler."""
    from quire.operators import responses

    lang = F.col("lang")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")  # XML has no such characters
    opened = F.when(lang == "fr", '<p onclick="x()">').when(lang == "es", "<p><b>").otherwise("<p>")
    entry = lambda term, rendering: F.concat(F.lit("<dt>"), T.escape(term), F.lit("</dt><dd>"), T.escape(rendering), F.lit("</dd>"))
    terms = F.concat(entry(F.lit("term"), F.when(lang == "de", "other").otherwise("fixed")), entry(F.col("source"), lang))
    answer = F.concat(F.lit('<section data-role="summary" data-title="'), T.escape(F.col("source")), F.lit('">'), opened, T.escape(plain), F.lit('</p></section><dl data-role="glossary">'), terms, F.lit("</dl>"))
    rows = table(spark, d, "documents").select("doc_id", answer.alias("answer"), F.create_map(F.lit("term"), F.lit("fixed")).alias("known"))
    found = responses.read(rows, "answer", ("doc_id",), "known")
    shown = F.array_join(F.transform("terms", lambda t: F.concat(t["term"], F.lit("="), t["rendering"])), ", ")
    return found.select("doc_id", "error", "title", F.md5(F.col("body").cast("binary")).alias("body"), shown.alias("terms"))


def _books(spark: SparkSession, d: str) -> DataFrame:
    """Packages made of whole pages, ten a book: path and content."""
    import io
    import zipfile

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        files = [(f"c{r.id}.xhtml", r.markup or "<body/>") for r in rows.sort_values("id").itertuples()]
        items = "".join(f'<item id="i{n}" href="{f}" media-type="application/xhtml+xml"/>' for n, (f, _) in enumerate(files))
        refs = "".join(f'<itemref idref="i{n}"/>' for n in range(len(files)))
        out = io.BytesIO()
        whole = [("mimetype", "application/epub+zip"), ("META-INF/container.xml", '<container><rootfiles><rootfile full-path="book.opf"/></rootfiles></container>')]
        whole += [("book.opf", f'<package><metadata/><manifest>{items}</manifest><spine>{refs}</spine></package>'), *files]
        with zipfile.ZipFile(out, "w") as z:
            for f, markup in whole:  # times stay as they begin, so that a task that runs again makes the same bytes
                z.writestr(zipfile.ZipInfo(f), markup, zipfile.ZIP_DEFLATED)
        return pd.DataFrame([(f"book{rows['book'].iloc[0]}.epub", out.getvalue())], columns=["path", "content"])

    rows = pages(spark, d).select("id", "markup", F.floor(F.col("id") / 10).alias("book"))
    return rows.groupBy("book").applyInPandas(pack, "path string, content binary")


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Packages of whole pages, ten a book, as rows of members, with all that a package can name: an item twice under
    one id, navigation with labels for some pages and types for others, an older table of contents, a guide, and in
    books whose number ends in 7 a spine reference without an item."""
    i, book = F.col("page_id"), F.floor(F.col("page_id") / 10).cast("bigint")
    rows = table(spark, d, "pages").select(i, F.col("html"), book.alias("book"), F.coalesce(I.heading(F.regexp_extract("html", r"(?is)<title\b[^>]*>.*?</title>", 0)), F.lit("")).alias("title"))
    item = F.concat(F.when(i % 7 == 0, F.format_string('<item id="i%d" href="old%d.xhtml" media-type="text/plain"/>', i, i)).otherwise(""), F.format_string('<item id="i%d" href="Text/c%%20%d.xhtml" media-type="application/xhtml+xml"/>', i, i))
    ref = F.concat(F.format_string('<itemref idref="i%d"/>', i), F.when((F.col("book") % 10 == 7) & (i % 10 == 3), F.format_string('<itemref idref="gone%d"/>', i)).otherwise(""))
    types = F.when(i % 4 == 0, ' epub:type="bodymatter"').otherwise("")
    link = F.when(i % 3 != 0, F.concat(F.format_string('<li><a href="Text/c%%20%d.xhtml#top"%s> <b>', i, types), T.escape(F.col("title")), F.lit("</b> x</a></li>"))).otherwise("")
    point = F.concat(F.format_string('<navPoint id="n%d"><navLabel><text>ncx ', i), T.escape(F.col("title")), F.format_string('</text></navLabel><content src="Text/c%%20%d.xhtml"/></navPoint>', i))
    reference = F.when(i % 8 == 0, F.format_string('<reference type="toc" href="Text/c%%20%d.xhtml"/>', i)).otherwise("")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", c.alias("s")))), lambda x: x["s"]), "")
    head = '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf"><metadata/><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
    opf = F.concat(F.lit(head), joined(item), F.lit("</manifest><spine>"), joined(ref), F.lit("</spine><guide>"), joined(reference), F.lit("</guide></package>"))
    files = (("META-INF/container.xml", F.lit('<c:container xmlns:c="urn:x"><c:rootfiles><c:rootfile full-path="OEBPS/content.opf"/></c:rootfiles></c:container>')), ("OEBPS/content.opf", opf), ("OEBPS/nav.xhtml", F.concat(F.lit("<html><body><nav><ol>"), joined(link), F.lit("</ol></nav></body></html>"))), ("OEBPS/toc.ncx", F.concat(F.lit("<ncx><navMap>"), joined(point), F.lit("</navMap></ncx>"))))
    books = rows.groupBy("book").agg(F.array(*(F.struct(F.lit(p).alias("path"), c.alias("content")) for p, c in files)).alias("m")).select("book", F.inline("m"))
    texts = rows.select("book", F.format_string("OEBPS/Text/c %d.xhtml", i).alias("path"), F.col("html").alias("content"))
    return books.unionByName(texts).withColumnRenamed("book", "book_id")


def _package_of(spark: SparkSession, d: str):
    from quire.sources import relations

    return relations.read(_members(spark, d))


_ITEM_PATH = "'OEBPS/Text/c ' || page_id || '.xhtml'"
_PAGE_LABEL = _UNESCAPE.format(x=_STRIP.format(x=_TITLE_TAG))


@query(f"""SELECT page_id // 10 AS book_id, 'i' || page_id AS item_id, {_ITEM_PATH} AS path, 'application/xhtml+xml' AS media_type FROM pages
  UNION ALL SELECT DISTINCT page_id // 10, 'nav', 'OEBPS/nav.xhtml', 'application/xhtml+xml' FROM pages UNION ALL SELECT DISTINCT page_id // 10, 'ncx', 'OEBPS/toc.ncx', 'application/x-dtbncx+xml' FROM pages""")
def s3_manifest(spark, d):
    """S3: the manifests of packages of all pages; the last item of an id counts."""
    return _package_of(spark, d).manifest.select("book_id", "item_id", "path", "media_type")


@query(f"SELECT page_id // 10 AS book_id, {_ITEM_PATH} AS path, CASE WHEN page_id % 3 <> 0 THEN trim({_PAGE_LABEL} || ' x') ELSE trim('ncx ' || {_PAGE_LABEL}) END AS label FROM pages")
def s4_labels(spark, d):
    """Labels of navigation documents and older tables of contents; the first counts."""
    return _package_of(spark, d).labels


@query(f"SELECT page_id // 10 AS book_id, {_ITEM_PATH} AS path, CASE WHEN page_id % 8 = 0 THEN 'toc' ELSE 'bodymatter' END AS types FROM pages WHERE page_id % 8 = 0 OR page_id % 4 = 0 AND page_id % 3 <> 0")
def s6_landmarks(spark, d):
    """Landmarks, which guides override."""
    return _package_of(spark, d).landmarks


@query(f"""SELECT page_id // 10 AS book_id, 'i' || page_id AS idref, {_ITEM_PATH} AS path, NULL::VARCHAR AS problem FROM pages
  UNION ALL SELECT page_id // 10, 'gone' || page_id, NULL, 'the spine names an item that the manifest lacks' FROM pages WHERE page_id // 10 % 10 = 7 AND page_id % 10 = 3""")
def j1_spine_manifest(spark, d):
    """Spine references with their items; a miss is a row of errors."""
    package = _package_of(spark, d)
    found = package.spine.select("book_id", "idref", "path", F.lit(None).cast("string").alias("problem"))
    return found.unionByName(package.errors.select("book_id", F.col("detail").alias("idref"), F.lit(None).cast("string").alias("path"), "problem"))


_BODY = r"regexp_extract(html, '(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)', 1)"


@query(f"""SELECT page_id // 10 AS book_id, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id)::INTEGER AS idx, 'i' || page_id AS item_id, {_UNESCAPE.format(x=_STRIP.format(x=_HEADING))} AS title,
  len(regexp_extract_all({_UNESCAPE.format(x=_STRIP.format(x=_BODY))}, '{_WORDS}'))::BIGINT AS words, page_id % 8 = 0 AS front_matter, md5({_BODY}) AS body
  FROM pages WHERE page_id // 10 % 10 <> 7 OR page_id // 10 * 10 + 3 NOT IN (SELECT page_id FROM pages)""")
def j2_chapters(spark, d):
    """Chapters of packages without errors, from whole pages."""
    rows = _package_of(spark, d).chapters
    return rows.select("book_id", "idx", "item_id", "title", "words", "front_matter", F.md5(F.col("body").cast("binary")).alias("body"))


_HEAD_TEXT = f"trim(regexp_replace({_UNESCAPE.format(x=_STRIP.format(x=_HEADING))}, '\\s+', ' ', 'g'))"


@query(f"SELECT 'book' || page_id // 10 || '.epub' AS book, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id)::INTEGER AS idx, 'c' || page_id || '.xhtml' AS path, {_HEAD_TEXT} AS title, len(regexp_extract_all(html, '<img[\\s/>]'))::INTEGER AS images FROM pages")
def s1_package_scan(spark, d):
    """Packages of whole pages, written and read back as chapters."""
    from quire.sources import epub

    books = epub.read_archives(_books(spark, d))
    return books.select(F.col("path").alias("book"), F.inline("chapters")).select("book", "idx", "path", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), "images")


@query(f"SELECT 'book' || page_id // 10 || '.epub' AS name, 'chap_' || lpad((row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id))::VARCHAR, 3, '0') || '.xhtml' AS path, {_HEAD_TEXT} AS heading, false AS broken FROM pages")
def s13_package_sink(spark, d):
    """An archive a book from tables, nothing wrong with any; the chapters that are in them."""
    from quire.sources import epub, sink

    files = _books(spark, d)
    chapters = epub.chapters(epub.read_archives(files))
    results = chapters.select("book_id", "idx", "title", "body", F.lit(True).alias("translated"), F.lit("{}").alias("terms"))
    made = sink.archives(files, results, "en")
    again = epub.read_archives(made.select(F.col("name").alias("path"), F.col("archive").alias("content"), (F.size("problems") > 0).alias("broken")), keep=("broken",))
    shown = again.select(F.col("path").alias("name"), "broken", F.inline("chapters")).where("path like 'chap_%'")
    return shown.select("name", "path", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("heading"), "broken")


@query("SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS idx, source || ' ' || doc_id AS title, true AS translated FROM documents")
def d11_run_books(spark, d):
    """The ordered fold of every book, with a deterministic model."""
    return _folded(spark, d).select("book_id", "idx", "title", "translated")


_FIRST_WORDS = r"array_to_string(list_slice(regexp_extract_all(regexp_replace(coalesce(text, ''), '\[\[|\]\]', '', 'g'), '[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), 1, 40), ' ')"


@query(f"SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS idx, md5({_FIRST_WORDS}) AS first_words, NULL::VARCHAR AS error FROM documents")
def d10_chapter_bodies(spark, d):
    """What the fold makes of every chapter: the first forty words, by the deterministic model."""
    words = F.split(T.unescape(F.regexp_replace(F.regexp_extract("body", "(?s)^<p>(.*?)</p>", 1), "<[^>]*>", "")), " ")
    return _folded(spark, d).select("book_id", "idx", F.md5(F.array_join(F.slice(words, 1, 40), " ").cast("binary")).alias("first_words"), "error")


def _state_folder(spark: SparkSession) -> str:
    """A new folder where the session's checkpoints are; on one machine without such a setting, one of its own."""
    import atexit
    import shutil
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quire-state-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/state-{uuid.uuid4().hex}"


def _folded(spark: SparkSession, d: str) -> DataFrame:
    from quire.plans.completer import Stub
    from quire.plans.generation import generate
    from quire.plans.settings import Settings

    rows = P.dense_index(table(spark, d, "documents").select(F.col("source").alias("book_id"), "doc_id", "text"), "book_id", "doc_id")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"\[\[|\]\]", "")
    lines = F.regexp_replace(plain, r"([^\n]{4000,}?)\s", "$1\n")  # a paragraph can't be divided, so long lines are some
    body = F.concat(F.lit("<p>"), F.regexp_replace(T.escape(lines), "\n", "</p><p>"), F.lit("</p>"))
    chapters = rows.select("book_id", F.col("idx").cast("int").alias("idx"), F.lit("i").alias("item_id"), F.lit("a.xhtml").alias("path"), F.concat_ws(" ", "book_id", F.col("doc_id").cast("string")).alias("title"), body.alias("body"), F.lit("<head/>").alias("head"), F.lit(0).alias("words"), F.lit(0).alias("images"), F.lit(False).alias("front_matter"), F.lit("").alias("properties"), F.expr("cast(null as map<string,string>)").alias("body_attrs"))
    state = _state_folder(spark)
    return generate(chapters, Settings(language="en"), Stub(None), state, "s")
