"""Scalar functions and event windows on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import views
from .registry import query


@query("SELECT p_partkey AS id, trim(lower(regexp_replace(regexp_replace(regexp_replace(p_brand || '_' || replace(p_name, ' ', '') || 'Of' || p_type, '([\\p{Ll}\\p{N}])(\\p{Lu})', '\\1 \\2', 'g'), '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1 \\2', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS words FROM part")
def decompose(spark, d):
    """Identifiers made of a part's brand, name and type, as words."""
    p = views.table(spark, d, "part")
    name = F.concat("p_brand", F.lit("_"), F.regexp_replace("p_name", " ", ""), F.lit("Of"), "p_type")
    return p.select(F.col("p_partkey").alias("id"), tx.decompose(name).alias("words"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) WHEN event_id % 3 = 1 THEN CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) END AS grade, event_id % 3 = 1 AS recovered, event_id % 3 = 2 AS parse_error FROM events")
def safe_json(spark, d):
    """Events' properties read as judge answers: whole, cut off, or without any field."""
    k = F.regexp_extract("props", r"(\d+)", 1)
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('noise {"grade": '), k, F.lit("} more"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"grade": '), k, F.lit(', "reas'))).otherwise(F.col("props").substr(1, 3))
    got = views.table(spark, d, "events").select("event_id", tx.safe_json(raw).alias("j"))
    return got.select("event_id", "j.grade", "j.recovered", "j.parse_error")


@query("SELECT label, count(*) AS n, substr(sha256(concat_ws('|', 'model' || label, '64', 'query: ')), 1, 12) AS version FROM embeddings GROUP BY label")
def version_hash(spark, d):
    e = views.table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return e.select("label", "n", tx.version_hash(F.concat(F.lit("model"), F.col("label").cast("string")), F.lit(64), F.lit("query: ")).alias("version"))


@query("SELECT p_brand, substr(sha256(p_brand), 1, 16) AS repo FROM part GROUP BY p_brand")
def repo_hash(spark, d):
    return views.table(spark, d, "part").select("p_brand").distinct().select("p_brand", tx.repo_hash(F.col("p_brand")).alias("repo"))


@query(f"WITH {views.EDGES} SELECT CASE WHEN confidence >= 0.95 THEN 'high' WHEN confidence >= 0.7 THEN 'mid' WHEN confidence >= 0.5 THEN 'low' ELSE 'poor' END AS band, count(*) AS n FROM edges GROUP BY ALL")
def conf_band(spark, d):
    return views.edges(spark, d).groupBy(tx.confidence_band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


_WORDS = "w AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS ws FROM conversations WHERE text IS NOT NULL)"
_PICK = "list_reduce({}, lambda a, b: CASE WHEN strlen(b) >= strlen(a) THEN b ELSE a END, '')"


@query(f"""WITH {_WORDS}, f AS (SELECT *, list_filter(ws, lambda x: regexp_matches(x, '^\\p{{L}}') AND regexp_matches(x, '[\\p{{Lu}}_]')) AS marked, list_filter(ws, lambda x: strlen(x) >= 4 AND regexp_matches(x, '^\\p{{L}}+$')) AS plain FROM w)
SELECT conv_id, turn, CASE WHEN len(marked) > 0 THEN {_PICK.format('marked')} WHEN len(plain) > 0 THEN {_PICK.format('plain')} ELSE text END AS subject FROM f""")
def extract_subject(spark, d):
    """What each turn of a conversation is about."""
    c = views.table(spark, d, "conversations").where("text IS NOT NULL")
    return c.select("conv_id", "turn", tx.extract_subject(F.col("text")).alias("subject"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/+$', '') AS path FROM pages WHERE url IS NOT NULL")
def normalize_path(spark, d):
    """Page addresses as paths, with detours put in and taken out again."""
    host = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    return views.table(spark, d, "pages").where("url IS NOT NULL").select("page_id", tx.normalize_path(F.concat(F.lit("./"), host, F.lit("/x/../."))).alias("path"))


@query("SELECT c_custkey AS id, CASE WHEN strpos(p, ':') > 0 THEN regexp_extract(p, '^(.*):([^:]*)$', 1) ELSE '' END AS path, regexp_extract(p, '^(.*):([^:]*)$', 2) AS name FROM (SELECT c_custkey, 'src:' || c_mktsegment || ':' || c_name AS p FROM customer)")
def parse_hit(spark, d):
    c = views.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), tx.parse_hit(F.concat(F.lit("src:"), "c_mktsegment", F.lit(":"), "c_name")).alias("h")).select("id", "h.path", "h.name")


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) // 1000 RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n FROM events")
def restart_window(spark, d):
    """How many events each user had in the minute up to each of them; seconds are those of the time rounded to milliseconds, as `epoch_ms` has it."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ms = F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000))  # halves away from zero
    w = Window.partitionBy("user_id").orderBy(F.call_function("div", ms, F.lit(1000))).rangeBetween(-60, 0)
    return views.table(spark, d, "events").select("user_id", "event_id", F.count(F.lit(1)).over(w).alias("n"))


@query("SELECT time_bucket(INTERVAL '5 seconds', ts) AS start, count(*) FILTER (event_type <> 'error') AS ok, count(*) AS n FROM events GROUP BY ALL")
def bucket_5s(spark, d):
    """Successes in steps of five seconds."""
    e = views.table(spark, d, "events").groupBy(F.window("ts", "5 seconds").alias("w"))
    return e.agg(F.count_if(F.col("event_type") != "error").alias("ok"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "ok", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '10 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, s.s")
def user_sessions(spark, d):
    """Runs of a user's events with gaps of under ten minutes."""
    e = views.table(spark, d, "events").groupBy("user_id", F.session_window("ts", "10 minutes").alias("w"))
    return e.agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).select("user_id", "start", "last", "n")


@query("SELECT user_id, round(80::DOUBLE + 0.5::DOUBLE * ((epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE / 1000000::DOUBLE), 6) AS capacity FROM events GROUP BY user_id")
def bucket_capacity(spark, d):
    """Calls that a token bucket would have let through over each user's time."""
    e = views.table(spark, d, "events").groupBy("user_id").agg(((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1000000.0).alias("s"))
    return e.select("user_id", F.round(tx.bucket_capacity(F.col("s")), 6).alias("capacity"))


@query("SELECT kind, count(*) AS n FROM (SELECT p_type AS kind, p_name FROM part) WHERE (NULL IS NULL OR kind = NULL) GROUP BY kind")
def nullable_filter(spark, d):
    """A filter whose parameter may be null, bound by name: null lets everything through."""
    views.symbols(spark, d).createOrReplaceTempView("quillgraph_symbols")
    return spark.sql("SELECT kind, count(*) AS n FROM quillgraph_symbols WHERE :kind IS NULL OR kind = :kind GROUP BY kind", args={"kind": None})
