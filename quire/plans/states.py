"""State and incremental updates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import state
from quire.sources.tables import table

from .book import query


@query("""WITH o AS (SELECT doc_id AS key, sha256(text) AS f FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS f FROM documents WHERE doc_id % 11 <> 0)
    SELECT key, CASE WHEN o.f IS NULL THEN 'insert' WHEN n.f IS NULL THEN 'delete' WHEN o.f <> n.f THEN 'update' ELSE 'keep' END AS change FROM o FULL JOIN n USING (key)""")
def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01, FUN-42: what a refresh has to do; the two states of the index are made from documents by id."""
    docs = table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"))
    edited = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("key"), F.sha2(edited.cast("binary"), 256).alias("fingerprint"))
    return state.index_changes(old, new)


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_nationkey <> 3
    UNION ALL SELECT o_custkey, max(o_orderpriority), round(max(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey""")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02: rows replaced by key, vanished ones dropped."""
    customer = table(spark, sf_dir, "customer")
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_name"), F.round(F.max("o_totalprice"), 2).alias("c_acctbal"))
    return state.upsert(customer.select("c_custkey", "c_name", "c_acctbal"), rows, "c_custkey", customer.filter("c_nationkey = 3"))


@query("SELECT user_id, event_type, (event_id % 3)::bigint AS generation, min(event_id) AS first_id FROM events GROUP BY ALL")
def pending_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03, STR-20: each pending task once."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", (F.col("event_id") % 3).alias("generation")).agg(F.min("event_id").alias("first_id"))


@query("SELECT event_id, user_id, day(ts)::int AS generation FROM events QUALIFY day(ts) = max(day(ts)) OVER (PARTITION BY user_id)")
def stale_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04: results of the latest generation."""
    return state.current_only(table(spark, sf_dir, "events").select("event_id", "user_id", F.dayofmonth("ts").alias("generation")), "user_id", "generation")


@query("""WITH b AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN left(text, 10) ELSE text END AS text FROM conversations))
    SELECT conv_id, turn, CASE WHEN starts_with(text, p) THEN substr(text, length(p) + 1) ELSE text END AS delta FROM b""")
def delta_from_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08: increments of a text that is sent whole."""
    t = table(spark, sf_dir, "conversations")
    return state.deltas(t.withColumn("text", F.when(F.col("turn") % 2 == 0, F.substring("text", 1, 10)).otherwise(F.col("text"))), "conv_id", "turn", "text")


@query("SELECT user_id, count(*) AS reviews, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS last FROM events GROUP BY user_id")
def review_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-14: review counters."""
    return state.reviews(table(spark, sf_dir, "events"), "user_id", F.struct("ts", "event_id"), "event_type", "ts")


@query("""SELECT user_id, event_type, round(sum(s) / 1e6, 3) AS seconds FROM (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS s FROM events) GROUP BY ALL""")
def stage_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20: time by stage."""
    return state.stage_times(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type")


@query("SELECT l_partkey AS key, count(*) AS asked, l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) AS hit FROM lineitem GROUP BY l_partkey")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06, STR-07, SRC-15: one computation for equal keys, and none for those in the cache."""
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"))
    return state.with_cache(asked, table(spark, sf_dir, "part").filter("p_size < 20").select(F.col("p_partkey").alias("key")), "key")


@query("""WITH c AS (SELECT c_custkey AS key, sha256(c_name) AS rev FROM customer), w AS (SELECT o_custkey AS key, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE rev END AS expected, rev FROM orders LEFT JOIN c ON key = o_custkey),
    f AS (SELECT key, min(seq) AS winner FROM w WHERE expected = rev GROUP BY key) SELECT key, seq, CASE WHEN coalesce(expected = rev, false) AND seq = winner THEN 'updated' ELSE 'conflict' END AS outcome FROM w LEFT JOIN f USING (key)""")
def revision_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10: writes that expect the current revision; one wins."""
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    writes = table(spark, sf_dir, "orders").join(current.withColumnRenamed("key", "o_custkey"), "o_custkey", "left")
    writes = writes.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, "old").otherwise(F.sha2(F.col("value").cast("binary"), 256)).alias("expected"))
    return state.compare_and_set(current, writes, "key")


@query("SELECT user_id, max(event_id) AS revision, arg_max(props, event_id) AS props FROM events GROUP BY user_id")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11: the newest of an append-only history."""
    return state.latest_revision(table(spark, sf_dir, "events").withColumnRenamed("event_id", "revision"), "user_id", "revision", "props")


@query("""SELECT lang AS language, lower(trim(regexp_replace(string_split(text, chr(10))[1], '\\s+', ' ', 'g'))) AS term_key, arg_min(doc_id, (n_chars, doc_id)) AS id, list_sort(list_distinct(list(source))) AS sources, max(n_chars) AS updated FROM documents GROUP BY ALL""")
def vocabulary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15, FUN-05: entries by language and term key."""
    docs = table(spark, sf_dir, "documents")
    return state.vocabulary(docs.select(F.col("lang").alias("language"), F.element_at(F.split("text", "\n"), 1).alias("term"), F.col("doc_id").alias("id"), "source", F.col("n_chars").alias("at")))


@query("""WITH r AS (SELECT conv_id, turn, role AS action, CASE WHEN role = 'assistant' THEN 'ai' ELSE 'manual' END AS source, 'yellow' AS color FROM conversations)
    SELECT action, conv_id, turn, source, CASE WHEN source <> 'ai' AND action IN ('user', 'assistant') THEN 'blue' ELSE color END AS color FROM r""")
def style_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-19, SNK-07: a changed style reaches all annotations that aren't suggestions."""
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("action"), "conv_id", "turn", F.when(F.col("role") == "assistant", "ai").otherwise("manual").alias("source"), F.lit("yellow").alias("color"))
    return state.propagated(rows, spark.createDataFrame([("user", "blue"), ("assistant", "blue")], "action string, color string"), "action", "color")


@query("""WITH s AS (SELECT DISTINCT l_partkey AS block, l_returnflag AS quote FROM lineitem WHERE l_discount > 0.05), e AS (SELECT l_partkey AS block, l_returnflag AS quote, CASE WHEN min(l_linenumber) > 2 THEN 'ignored' ELSE 'shown' END AS state FROM lineitem WHERE l_discount <= 0.05 GROUP BY ALL)
    SELECT block, quote, CASE WHEN state = 'ignored' THEN 'ignored' WHEN state IS NULL THEN 'add' WHEN s.block IS NULL THEN 'drop' ELSE 'keep' END AS action FROM s FULL JOIN e USING (block, quote)""")
def suggestion_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-24, STR-18: suggestions against existing annotations."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("block"), F.col("l_returnflag").alias("quote"), "l_discount", "l_linenumber")
    existing = li.filter("l_discount <= 0.05").groupBy("block", "quote").agg(F.when(F.min("l_linenumber") > 2, "ignored").otherwise("shown").alias("state"))
    return state.reconciled(li.filter("l_discount > 0.05"), existing, ["block", "quote"])


_STEPS = ", ".join(f"('{a}', '{b}', '{c}')" for (a, b), c in state.TRANSITIONS.items())


@query(f"""WITH RECURSIVE t(a, e, b) AS (VALUES {_STEPS}), o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_type WHEN 'signup' THEN 'queue' WHEN 'click' THEN 'start' WHEN 'view' THEN 'finish' WHEN 'purchase' THEN 'cancel' WHEN 'error' THEN 'fail' END AS e FROM events),
    r AS (SELECT DISTINCT user_id, 0::bigint AS i, 'unparsed' AS status, 0 AS applied FROM events UNION ALL SELECT r.user_id, o.i, coalesce(t.b, status), applied + (t.b IS NOT NULL)::int FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1 LEFT JOIN t ON t.a = status AND t.e = o.e)
    SELECT user_id, arg_max(status, i) AS status, max(applied) AS applied FROM r GROUP BY user_id""")
def job_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05: the state machine over each user's events."""
    names = F.create_map(*[F.lit(x) for pair in (("signup", "queue"), ("click", "start"), ("view", "finish"), ("purchase", "cancel"), ("error", "fail")) for x in pair])
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", names[F.col("event_type")].alias("event"))
    return state.replay(events, "user_id", ["ts", "event_id"], "event")


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def decision_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18, AGG-19: events by kind and day."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
