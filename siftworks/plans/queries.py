"""Queries that apply the operators to the given tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftworks.functions import rules, text, url, vector
from siftworks.functions.dates import fresh, iso_timestamp, iso_week
from siftworks.operators import dedup, enrich, folds, history, routing, similarity
from siftworks.plans import render
from siftworks.sources import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TRACKING = "[" + ", ".join(f"'{t}'" for t in url.TRACKING) + "]"
_NORMAL = f"""
b AS (SELECT *, regexp_replace(lower(trim(url)), '#.*$', '') AS u FROM pages),
s AS (SELECT *, regexp_replace(split_part(u, '?', 1), '/+$', '') AS base, CASE WHEN strpos(u, '?') > 0 THEN substr(u, strpos(u, '?') + 1) ELSE '' END AS q FROM b),
p AS (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT list_contains({_TRACKING}, split_part(x, '=', 1)) AND NOT starts_with(x, 'utm_')) AS l FROM s),
n AS (SELECT *, base || CASE WHEN len(l) > 0 THEN '?' || array_to_string(list_sort(l), '&') ELSE '' END AS normal FROM p)"""


@query(f"WITH {_NORMAL} SELECT page_id, normal FROM n")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1"""
    return _t(spark, sf_dir, "pages").select("page_id", url.normalize_url(F.col("url")).alias("normal"))


def _page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("url", F.col("html").alias("text"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("fetched_at"), F.col("page_id").alias("pos"))


@query(
    f"WITH {_NORMAL}, h AS (SELECT *, regexp_extract(normal, '://([^/?]+)', 1) AS host, row_number() OVER (PARTITION BY regexp_extract(normal, '://([^/?]+)', 1) ORDER BY length(html) DESC, page_id) AS rn FROM n) "
    "SELECT host, max(CASE WHEN rn = 1 THEN url END) AS url, CAST(count(*) AS INTEGER) AS duplicate_count, min(page_id) AS pos FROM h GROUP BY host"
)
def url_cluster_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, W1, O1, over the pages of a host"""
    host = F.regexp_extract(url.normalize_url(F.col("url")), r"://([^/?]+)", 1)
    got = dedup.cluster(_page_items(spark, sf_dir).withColumn("host", host), F.col("host"))
    return got.select("host", "url", "duplicate_count", "pos")


@query(
    f"WITH {_NORMAL}, h AS (SELECT *, row_number() OVER (PARTITION BY normal ORDER BY length(html) DESC, page_id) AS rn FROM n WHERE page_id NOT IN (SELECT doc_id FROM labels)) "
    "SELECT max(CASE WHEN rn = 1 THEN url END) AS url, CAST(count(*) AS INTEGER) AS duplicate_count, min(page_id) AS pos FROM h GROUP BY normal"
)
def url_dedup_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stages of a run, pages against those marked as seen"""
    seen = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"))
    return dedup.cluster_by_url(dedup.unseen(_page_items(spark, sf_dir), seen, "pos")).select("url", "duplicate_count", "pos")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def seen_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1"""
    return dedup.unseen(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def seen_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, U4"""
    return dedup.seen_again(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 7 DAY GROUP BY user_id")
def seen_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15, T2s"""
    e = _t(spark, sf_dir, "events")
    now = F.lit("2024-01-25 00:00:00").cast(e.schema["ts"].dataType)
    return history.recent(e, "ts", now).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' OR CAST(o_orderdate AS TIMESTAMP) >= TIMESTAMP '1998-01-01' - INTERVAL 35 DAY")
def seen_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, T1s: rows without a time never expire"""
    o = _t(spark, sf_dir, "orders")
    at = F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.to_date("o_orderdate").cast("string"), F.lit("T00:00:00+00:00")))
    return dedup.alive(o.select("o_orderkey", at.alias("seen_at")), F.to_timestamp(F.lit("1998-01-01T00:00:00+00:00"))).select("o_orderkey")


@query("SELECT min(doc_id) AS doc_id, CAST(count(*) AS INTEGER) AS duplicate_count FROM documents GROUP BY text")
def exact_text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, U5"""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("fetched_at"), F.col("doc_id").alias("pos"))
    return dedup.cluster(d, F.sha2(F.col("text").cast("binary"), 256)).select("doc_id", "duplicate_count")


def _topics(e: DataFrame) -> DataFrame:
    each = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding_vector")).select(F.col("label").alias("tag"), "embedding_vector")


_CENTRE = """
x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
a AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i),
c AS (SELECT label AS tag, list(x ORDER BY i) AS v FROM a GROUP BY label),
s AS (SELECT vec_id, tag, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS sim FROM embeddings CROSS JOIN c),
t AS (SELECT vec_id, arg_min(tag, (-sim, tag)) AS best_tag, max(sim) AS sim FROM s GROUP BY vec_id)"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return similarity.nearest_topic(e.withColumnRenamed("embedding", "embedding_vector"), _topics(e), "vec_id")


@query(f"WITH {_CENTRE} SELECT vec_id, best_tag, round(sim, 6) AS similarity_score FROM t")
def topic_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, O4"""
    return _nearest(spark, sf_dir).withColumn("similarity_score", F.round("similarity_score", 6))


@query(f"WITH {_CENTRE} SELECT vec_id, best_tag, round(sim, 3) AS similarity_score FROM t WHERE sim < 0.30")
def uncategorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, T9"""
    return _nearest(spark, sf_dir).where("similarity_score < 0.30").withColumn("similarity_score", F.round("similarity_score", 3))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 10, "0").alias("url"), F.col("vec_id").alias("pos"), F.lpad(F.pmod(F.xxhash64("vec_id"), F.lit(1000)).cast("string"), 4, "0").alias("fetched_at"), (F.col("label") == 9).alias("is_roundup"), F.col("embedding").alias("embedding_vector"), "label")


def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return similarity.window_match(v.where("label < 5"), v.where("label >= 5"), 0.40, 0.25)


_MATCH = """
v AS (SELECT lpad(CAST(vec_id AS VARCHAR), 10, '0') AS url, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.url AS url, b.url AS matched, list_cosine_similarity(a.v, b.v) AS sim, b.label AS bl FROM v a CROSS JOIN v b WHERE a.label < 5 AND b.label >= 5),
k AS (SELECT *, CASE WHEN sim >= 0.40 THEN 'dedup' WHEN sim >= 0.25 AND bl <> 9 THEN 'content_overlap' END AS filter_type FROM p),
m AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY sim DESC, matched) AS rn FROM k WHERE filter_type IS NOT NULL)"""


@query(f"WITH {_MATCH} SELECT url, matched, round(sim, 6) AS sim, filter_type FROM m WHERE rn = 1")
def window_match_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one half of the labels against those of the other"""
    return _window(spark, sf_dir).withColumn("sim", F.round("sim", 6))


@query(f"WITH {_MATCH} SELECT 'r' AS run_id, filter_type, count(*) AS n FROM m WHERE rn = 1 GROUP BY filter_type")
def drop_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, K3"""
    return folds.drop_counts(_window(spark, sf_dir).withColumn("run_id", F.lit("r")))


@query()
def semantic_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequential pass, which SQL has not; tests replay it"""
    return similarity.greedy_dedup(_vectors(spark, sf_dir), 0.40, 0.30).select("url", "kept", "slot", "matched", F.round("sim", 6).alias("sim"), "filter_type")


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16"""
    e = _t(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("b")), 6).alias("sim"))


@query("SELECT coalesce(event_type, 'total') AS provider, round(sum(value), 4) AS cost_usd FROM events GROUP BY ROLLUP (event_type)")
def cost_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2"""
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.col("value").alias("cost_usd"))
    return folds.cost_by_provider(e).withColumn("cost_usd", F.round("cost_usd", 4))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def run_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9, U5, O4, T8s"""
    e = _t(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return enrich.last_by(e, "user_id", "o").select("user_id", "event_type", "ts")


@query("SELECT e.event_id, p.event_id AS prior_event_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11 by key: each event with its user's last sign-up"""
    e = _t(spark, sf_dir, "events")
    return history.as_of(e, e.where("event_type = 'signup'"), "user_id", "ts", ["event_id"]).select("event_id", "prior_event_id")


@query("SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, event_type AS current FROM events")
def previous_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6"""
    return history.previous(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "previous", F.col("event_type").alias("current"))


@query(
    "WITH f AS (SELECT o_custkey AS k, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS prev, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS cur, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st FROM orders GROUP BY o_custkey) "
    "SELECT c_custkey AS card_id, coalesce(prev, 'none') AS previous_list_name, CASE WHEN k IS NOT NULL THEN cur END AS current_list_name, "
    "CASE WHEN k IS NULL THEN 'not_found' WHEN st = 'F' THEN 'archived' WHEN cur = '1-URGENT' THEN 'completed' WHEN cur <> prev THEN 'moved' ELSE 'unchanged' END AS status FROM customer LEFT JOIN f ON k = c_custkey"
)
def movement_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's first order is the earlier plan, the last one the snapshot"""
    o = _t(spark, sf_dir, "orders")
    at = F.struct("o_orderdate", "o_orderkey")
    two = o.groupBy(F.col("o_custkey").alias("card_id")).agg(F.min_by("o_orderpriority", at).alias("prev"), F.max_by("o_orderpriority", at).alias("list_id"), (F.max_by("o_orderstatus", at) == "F").alias("closed"))
    prior = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("card_id")).join(two.select("card_id", "prev"), "card_id", "left").select("card_id", F.coalesce("prev", F.lit("none")).alias("list_name"))
    lists = o.select(F.col("o_orderpriority").alias("list_id"), F.col("o_orderpriority").alias("list_name")).distinct()
    return history.movement(prior, two, lists, "1-URGENT")


@query(
    "WITH r AS (SELECT max(source) AS run_id FROM documents) SELECT CAST(d.doc_id AS VARCHAR) AS url, lang AS title, 'plan_item' AS classification FROM documents d WHERE source = (SELECT run_id FROM r) AND lang IN ('en', 'fr') "
    "AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
)
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11-J13, P16, P17, T7s, L17: sources are runs, languages sections, labels what was done"""
    d, lab = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("url"), "quality", "toxic")
    runs = d.select(F.col("source").alias("run_id"), F.lit("weekly").alias("path"), F.lit("success").alias("status"), F.col("source").alias("finished_at")).distinct()
    section = F.when(F.col("lang") == "en", "reading").when(F.col("lang") == "fr", "courses").otherwise("uncategorized")
    items = d.select(F.col("source").alias("run_id"), F.col("doc_id").cast("string").alias("url"), F.col("lang").alias("title"), F.lit("").alias("text"), F.lit("").alias("reasoning"), F.array("lang").alias("tags"), section.alias("section"), F.col("doc_id").alias("item_number"))
    got = history.carry_forward(runs, items, lab.select("url", (F.col("quality") == 0).alias("checked")), lab.where("toxic = 1"), "none")
    return got.select("url", "title", "classification")


@query(
    "WITH d AS (SELECT strftime(ts, '%G-W%V') AS week_of, event_type AS tag, ts, event_id, CASE WHEN value < 15 THEN -0.2 WHEN value < 40 THEN 0.05 ELSE 0.1 END AS d FROM events), "
    "l AS (SELECT week_of, tag, list(CAST(d AS DOUBLE) ORDER BY ts, event_id) AS l FROM d GROUP BY week_of, tag) "
    "SELECT week_of, tag, list_reduce(list_prepend(CAST(0 AS DOUBLE), l), lambda a, x: round(greatest(-0.3, least(0.3, a + x)), 6)) AS total, CAST(len(l) AS INTEGER) AS n FROM l"
)
def nudge_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, T15"""
    d = F.when(F.col("value") < 15, -0.2).when(F.col("value") < 40, 0.05).otherwise(0.1)
    e = _t(spark, sf_dir, "events").select(iso_week(F.col("ts")).alias("week_of"), F.col("event_type").alias("tag"), "ts", "event_id", d.alias("d"))
    got = folds.saturating_fold(e, ["week_of", "tag"], ["ts", "event_id"], "d", "event_id")
    return got.select("week_of", "tag", F.col("cumulative_adjustment").alias("total"), F.size("item_ids_contributing").alias("n"))


@query("SELECT strftime(ts, '%G-W%V') AS week, count(*) AS n FROM events GROUP BY 1")
def iso_week_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18"""
    return _t(spark, sf_dir, "events").groupBy(iso_week(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))


@query(
    "WITH g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 3.6e9 AS g FROM events), m AS (SELECT user_id, count(*) AS n, median(g) AS m FROM g GROUP BY user_id) "
    "SELECT user_id, n, round(CASE WHEN n >= 3 THEN m END, 6) AS median_gap_hours, CASE WHEN n >= 3 THEN CASE WHEN m <= 48 THEN 'daily' ELSE 'sporadic' END END AS cadence FROM m"
)
def cadence_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, W2, O3, L21"""
    return folds.cadence(_t(spark, sf_dir, "events"), "user_id", "ts").withColumn("median_gap_hours", F.round("median_gap_hours", 6))


@query("SELECT doc_id, CAST(round_even(10000.0 * n_chars / greatest(sum(n_chars) OVER (PARTITION BY source), 1), 0) AS BIGINT) AS share FROM documents")
def token_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4"""
    return folds.allocate(_t(spark, sf_dir, "documents"), F.lit(10000), F.col("n_chars"), ["source"]).select("doc_id", "share")


@query('SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 50) AS INTEGER) AS batch, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 50 AS INTEGER) AS "index" FROM documents')
def batch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4"""
    return enrich.batched(_t(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id")


@query("WITH k AS (SELECT doc_id, text, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1 ORDER BY doc_id LIMIT 15) SELECT CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS item_number, CAST(doc_id AS VARCHAR) AS url, substr(text, 1, 80) AS title FROM k")
def digest_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen entries of a digest"""
    j = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    scored = j.select(F.col("doc_id").cast("string").alias("url"), F.lit("").alias("title"), "text", F.array("lang").alias("tags"), F.lit("").alias("reasoning"), (F.col("quality") == 1).alias("keep"), F.col("doc_id").alias("pos"))
    off = scored.limit(0).select("*", F.lit("").alias("best_tag"), F.lit(0.0).alias("similarity_score"))
    return render.digest_entries(scored, off).select("item_number", "url", "title")


@query(
    "WITH t AS (SELECT doc_id, [lang, CASE WHEN n_chars > 1000 THEN 'evals' ELSE 'noise' END, source] AS tags FROM documents) "
    "SELECT doc_id, array_to_string(list_filter(tags, lambda x: x IN ('evals', 'noise')), ',') AS kept, array_to_string(list_filter(tags, lambda x: x NOT IN ('evals', 'noise')), ',') AS rejected FROM t"
)
def tag_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10, U3"""
    tags = F.array("lang", F.when(F.col("n_chars") > 1000, "evals").otherwise("noise"), "source")
    v = rules.valid_tags(tags)
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(v["kept"], ",").alias("kept"), F.array_join(v["rejected"], ",").alias("rejected"))


@query(
    "SELECT d.doc_id, CASE WHEN quality = 0 THEN 'project_proposal' ELSE 'plan_item' END AS classification, CASE WHEN quality = 0 THEN CASE WHEN toxic = 1 THEN 'extend' ELSE 'new' END END AS proposal_type, "
    "CASE WHEN l.doc_id IS NULL THEN 'fallback: not classified' ELSE 'said' END AS classification_reasoning FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
)
def left_enrich_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6, J7, P11"""
    items = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"))
    said = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 0, "project_proposal").otherwise("plan_item").alias("classification"), F.when(F.col("toxic") == 1, "extend").otherwise("other").alias("proposal_type"), F.lit("said").alias("classification_reasoning"), F.col("doc_id").alias("pos"))
    return enrich.with_classes(items, said).withColumnRenamed("url", "doc_id")


@query(
    "WITH c AS (SELECT l.doc_id, CASE WHEN quality = 1 THEN 'new_item' ELSE 'stale_nudge' END AS source FROM labels l JOIN documents d USING (doc_id)), "
    "v AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM c WHERE source = 'stale_nudge' OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) "
    "SELECT CAST(rn AS INTEGER) AS rank, CAST(doc_id AS VARCHAR) AS matched_card_id, source, CASE WHEN source = 'new_item' THEN CAST(doc_id AS VARCHAR) END AS item_url FROM v WHERE rn <= 5"
)
def selection_validate_cap5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five entries are the feature"""
    lab = _t(spark, sf_dir, "labels")
    key = F.col("doc_id").cast("string")
    chosen = lab.select(key.alias("matched_card_id"), F.when(F.col("quality") == 1, "new_item").otherwise("odd").alias("source"), key.alias("item_url"), F.lit(None).cast("string").alias("priority_reasoning"), F.lit(None).cast("string").alias("movement_note"), F.col("doc_id").alias("pos"))
    cards = _t(spark, sf_dir, "documents").select(key.alias("card_id"))
    return enrich.valid_selection(chosen, cards, lab.where("toxic = 1").select(key.alias("url"))).select("rank", "matched_card_id", "source", "item_url")


@query(
    "WITH j AS (SELECT (n_chars >= 300) = (quality = 1) AS hit, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.5 END AS o FROM labels JOIN documents USING (doc_id)) "
    "SELECT count(*) AS n_items, round(avg(CAST(hit AS INTEGER)), 6) AS keep_accuracy, round(avg(o), 6) AS mean_tag_overlap FROM j"
)
def eval_keep_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, J17, L20"""
    d, lab = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    labels = lab.join(d.select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("correct_decision"), F.array_distinct(F.array(F.lit("en"), "lang")).alias("correct_tags"))
    said = d.select(F.col("doc_id").alias("url"), (F.col("n_chars") >= 300).alias("keep"), F.array("lang").alias("tags"))
    return folds.evaluate(labels, said, said).select("n_items", F.round("keep_accuracy", 6).alias("keep_accuracy"), F.round("mean_tag_overlap", 6).alias("mean_tag_overlap"))


@query("SELECT count(*) AS n, CAST(count(*) FILTER (WHERE quality = toxic) AS BIGINT) AS n_agree, round(avg(CAST(coalesce(quality = toxic, false) AS INTEGER)), 6) AS rate FROM documents LEFT JOIN labels USING (doc_id)")
def model_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18, A10, L22"""
    d, lab = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    old = d.join(lab, "doc_id", "left").select("doc_id", F.col("quality").alias("v"))
    return folds.agreement(old, lab.select("doc_id", F.col("toxic").alias("v")), "doc_id", "v").withColumn("rate", F.round("rate", 6))


_ARTICLE = "regexp_extract(html, '<article[^>]*>(.*?)</article>', 1, 's')"


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace({_ARTICLE}, '<!--.*?-->|<[^>]+>', ' ', 'gs'), '\\s+', ' ', 'g')) AS body, regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's') AS title FROM pages")
def html_extract_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4"""
    art = F.regexp_extract("html", r"(?s)<article[^>]*>(.*?)</article>", 1)
    return _t(spark, sf_dir, "pages").select("page_id", text.html_text(art).alias("body"), F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1).alias("title"))


@query("SELECT page_id, CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<style\\b.*?</style>', ' ', 'gis'), '<script\\b.*?</script>', ' ', 'gis'), '<!--.*?-->|<[^>]+>', ' ', 'gs'), '\\s+', ' ', 'g'))) AS INTEGER) AS n FROM pages")
def visible_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5"""
    return _t(spark, sf_dir, "pages").select("page_id", text.visible_length(F.col("html")).alias("n"))


@query("SELECT page_id, array_to_string(list_slice(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), 1, 15), ' ') AS links FROM pages")
def href_extract_first15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11, O5"""
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(url.hrefs(F.col("html")), " ").alias("links"))


@query(
    "SELECT doc_id, CASE WHEN text = '' THEN '(no text)' WHEN length(text) <= 80 THEN text WHEN strpos(substr(text, 1, 80), ' ') > 0 THEN regexp_extract(substr(text, 1, 80), '^(.*) ', 1, 's') || '…' ELSE substr(text, 1, 80) || '…' END AS title, "
    "CASE WHEN length(text) <= 150 THEN text ELSE regexp_replace(substr(text, 1, 150), '\\s+$', '') || '…' END AS cut FROM documents"
)
def truncate_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7, F8, P22"""
    return _t(spark, sf_dir, "documents").select("doc_id", text.make_title(F.col("text")).alias("title"), text.truncate(F.col("text"), 150).alias("cut"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2"""
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(text.escape_html(F.col("html")).cast("binary")).alias("escaped"))


@query("SELECT doc_id, md5(regexp_replace(text, '([_*\\[\\]()~`>#+\\-=|{}.!])', '\\\\\\1', 'g')) AS escaped FROM documents")
def markdown_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3"""
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.escape_markdown(F.col("text")).cast("binary")).alias("escaped"))


@query(
    "SELECT conv_id, turn, CASE WHEN p.doc_id IS NOT NULL THEN CASE WHEN lower(trim(text)) IN ('yes', 'no', 'ok', 'y', 'n', 'go', 'pass', 'skip') THEN 'approval' ELSE 'unclear' END "
    "WHEN role = 'assistant' THEN 'feedback' WHEN trim(text) <> '' THEN 'queue' ELSE 'ignore' END AS route FROM conversations LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) p ON role = 'assistant' AND p.doc_id = conv_id"
)
def reply_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20, P21, J14"""
    c = _t(spark, sf_dir, "conversations")
    u = c.select(F.col("conv_id"), F.col("turn"), F.col("turn").alias("update_id"), "text", F.when(F.col("role") == "assistant", F.col("conv_id").cast("string")).alias("reply_to"))
    p = _t(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("message_id"), F.lit("t").alias("thread_id"), F.lit("p").alias("proposal_id"), F.lit("r").alias("run_id"))
    return routing.route(u, p).select("conv_id", "turn", "route")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19, F20, F24"""
    return _t(spark, sf_dir, "events").select("event_id", text.fenced_json(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), "k bigint")["k"].alias("k"))


@query("SELECT page_id, 'proposal-' || substr(sha256(url), 1, 16) AS proposal_id FROM pages")
def proposal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17"""
    return _t(spark, sf_dir, "pages").select("page_id", text.proposal_id(F.col("url")).alias("proposal_id"))


@query("SELECT doc_id, md5(substr(source || chr(10) || chr(10) || text, 1, 8000)) AS embedded FROM documents")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15"""
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.embedding_text(F.col("source"), F.col("text")).cast("binary")).alias("embedded"))


@query("SELECT count(*) AS n_items, CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS n_kept, CAST(count(toxic) AS BIGINT) AS n_matched, CAST(count(*) FILTER (WHERE lang = 'de') AS BIGINT) AS n_proposals, CAST(count(*) FILTER (WHERE lang <> 'de') AS BIGINT) AS n_plan_items FROM documents LEFT JOIN labels USING (doc_id)")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3"""
    j = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return folds.run_counts(j.select((F.col("quality") == 1).alias("keep"), F.col("toxic").alias("matched_card_id"), F.when(F.col("lang") == "de", "project_proposal").otherwise("plan_item").alias("classification")))


@query(
    "WITH r AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY source), e AS (SELECT p_brand AS name, string_agg(m, '; ' ORDER BY m) AS error FROM (SELECT DISTINCT p_brand, p_type AS m FROM part) GROUP BY p_brand), "
    "a AS (SELECT name FROM r UNION SELECT name FROM e UNION SELECT r_name FROM region) SELECT a.name, coalesce(r.n, 0) AS n_rows, e.error FROM a LEFT JOIN r ON r.name = a.name LEFT JOIN e ON e.name = a.name"
)
def errors_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, S13, U2, O2"""
    rows = _t(spark, sf_dir, "documents").select(F.col("source").alias("author_name"))
    errors = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("message"), F.col("p_type").alias("pos")).distinct()
    return folds.collect_errors(rows, errors, _t(spark, sf_dir, "region").select(F.col("r_name").alias("name")))


@query('WITH b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) AS at FROM documents) SELECT b.doc_id, l.quality = 1 AS keep FROM b JOIN labels l ON l.doc_id = b.at')
def score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score that is missing loses its item"""
    items = enrich.batched(_t(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id")
    said = _t(spark, sf_dir, "labels").select(F.expr("cast(doc_id div 50 as int)").alias("batch"), F.pmod("doc_id", F.lit(50)).cast("int").alias("index"), (F.col("quality") == 1).alias("keep"), F.lit("").alias("reasoning"), F.array(F.lit("evals")).alias("tags"))
    return enrich.join_scores(items, said).select("doc_id", "keep")


@query("SELECT l_orderkey, l_linenumber, round(round((l_quantity * 0.00025 + l_linenumber * 0.00125) / 1000, 6), 6) AS a, printf('$%.4f', l_extendedprice) AS price FROM lineitem")
def model_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, F22"""
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.cost_a(F.col("l_quantity"), F.col("l_linenumber")).alias("a"), rules.dollars(F.col("l_extendedprice")).alias("price"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS card_id, list(o_orderpriority ORDER BY o_orderdate, o_orderkey)[1] AS list_name FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def plan_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each card once with its first list"""
    o = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("c_custkey").cast("string").alias("card_id"), F.col("o_orderpriority").alias("list_name"), F.struct("o_orderdate", "o_orderkey").alias("pos"))
    return enrich.first_by(rows, "card_id").select("card_id", "list_name")


@query("SELECT event_id FROM events WHERE event_type = 'error' OR ts >= TIMESTAMP '2024-01-25' - INTERVAL 48 HOUR")
def fresh_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a real date pass"""
    e = _t(spark, sf_dir, "events")
    now = F.lit("2024-01-25 00:00:00").cast(e.schema["ts"].dataType)
    return e.where(fresh(F.col("ts"), F.col("event_type") != "error", now, 48)).select("event_id")


_CASES = " OR ".join(f"strpos(lower(t || ' ' || text), '{m}') > 0" for m in rules.CASE_STUDY)


@query(f"WITH d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'A Customer Story' WHEN 'fr' THEN 'case by case study' ELSE source END AS t, text FROM documents) SELECT doc_id, {_CASES} AS is_case FROM d")
def case_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4"""
    title = F.when(F.col("lang") == "en", "A Customer Story").when(F.col("lang") == "fr", "case by case study").otherwise(F.col("source"))
    return _t(spark, sf_dir, "documents").select("doc_id", rules.is_case_study(title, F.col("text")).alias("is_case"))


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    tag = F.when(F.col("lang") == "fr", "course").otherwise("evals")
    return j.select("doc_id", F.when(F.col("lang") == "de", "project_proposal").otherwise("plan_item").alias("classification"), F.array(tag).alias("tags"), F.col("quality").alias("matched_card_id"), (F.col("toxic") == 1).alias("selected"))


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE lang NOT IN ('de', 'fr')")
def plan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8"""
    return enrich.matched_candidates(_classed(spark, sf_dir)).select("doc_id")


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 'courses' WHEN quality IS NULL THEN 'reading' WHEN toxic = 1 THEN 'existing_project_work' END AS section FROM documents LEFT JOIN labels USING (doc_id)")
def section_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9"""
    return _classed(spark, sf_dir).select("doc_id", rules.section(F.col("tags"), F.col("matched_card_id"), F.col("selected")).alias("section"))


@query(
    "SELECT event_id, CAST(o_orderkey AS VARCHAR) AS url, CASE event_type WHEN 'signup' THEN 'positive' ELSE 'negative' END AS sentiment FROM events JOIN orders ON o_custkey = user_id AND o_orderkey % 5 = event_id % 7 "
    "WHERE event_type IN ('signup', 'error') AND event_id % 7 <> 6"
)
def feedback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without a real sentiment or number go, the others meet their items"""
    e, o = _t(spark, sf_dir, "events"), _t(spark, sf_dir, "orders")
    number = F.pmod("event_id", F.lit(7))
    mood = F.when(F.col("event_type") == "signup", "positive").when(F.col("event_type") == "error", "negative").otherwise("mixed")
    parsed = e.select("event_id", F.col("user_id").cast("string").alias("message_id"), F.when(number != 6, number).cast("int").alias("item_number"), mood.alias("sentiment"))
    items = o.select(F.col("o_custkey").cast("string").alias("message_id"), F.pmod("o_orderkey", F.lit(5)).cast("int").alias("item_number"), F.col("o_orderkey").cast("string").alias("url"))
    return routing.feedback_entries(parsed, items).select("event_id", "url", "sentiment")


_SUBJECT = "CASE turn % 3 WHEN 0 THEN 'Welcome, ' || role WHEN 1 THEN 'THANKS for subscribing to it' ELSE 'Unwelcome ' || role END"


@query(f"SELECT conv_id, turn, regexp_matches({_SUBJECT}, '(?i)^welcome\\b|^thanks for subscribing\\b') AS welcome FROM conversations")
def welcome_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18"""
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", rules.is_welcome(F.expr(_SUBJECT)).alias("welcome"))


_INLINE = "'<b>' || source || '</b> &lt;' || lang || '&gt; &amp;amp; &#39;' || doc_id || '&#39; <i class=\"x\">end</i> '"


@query("SELECT doc_id, source || ' <' || lang || '> &amp; ' || chr(39) || doc_id || chr(39) || ' end' AS clean FROM documents")
def inline_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6"""
    return _t(spark, sf_dir, "documents").select("doc_id", text.clean_inline(F.expr(_INLINE)).alias("clean"))


@query(
    "SELECT page_id, md5(replace(replace(regexp_replace(regexp_replace(html, '[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '&(amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);', chr(1) || '\\1;', 'g'), '&', '&amp;'), chr(1), '&')) AS repaired FROM pages"
)
def ampersand_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9"""
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(text.repair_ampersands(text.strip_illegal_xml(F.col("html"))).cast("binary")).alias("repaired"))


@query("SELECT page_id, 'https://n.example/p/' || page_id AS target, CASE WHEN page_id % 2 = 0 THEN 'https://m.example/p/' || page_id ELSE 'https://n.example/p/' || page_id END AS article FROM pages")
def redirect_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a link as written goes before one that decodes"""
    told = F.to_json(F.struct(F.concat(F.lit("https://n.example/p/"), "page_id").alias("e")))
    far = F.concat(F.lit("https://substack.com/redirect/2/"), F.rtrim(F.translate(F.base64(told.cast("binary")), "+/", "-_"), F.lit("=")))
    near = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<a href="https://m.example/p/'), "page_id", F.lit('">b</a>'))).otherwise("")
    p = _t(spark, sf_dir, "pages").select("page_id", far.alias("far"), F.concat(F.lit('<a href="'), far, F.lit('">a</a>'), near).alias("body"))
    return p.select("page_id", url.redirect_target(F.col("far")).alias("target"), url.article_url(F.col("body")).alias("article"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) - CASE WHEN o_orderstatus = 'F' THEN 7200 ELSE 0 END END AS at FROM orders")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """with Z or an offset; what is none is null"""
    o = _t(spark, sf_dir, "orders")
    said = F.when(F.col("o_orderpriority") == "5-LOW", "soon").otherwise(F.concat(F.to_date("o_orderdate").cast("string"), F.lit("T00:00:00"), F.when(F.col("o_orderstatus") == "F", "+02:00").otherwise("Z")))
    return o.select("o_orderkey", F.unix_seconds(iso_timestamp(said)).alias("at"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS file FROM pages")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F25"""
    return _t(spark, sf_dir, "pages").select("page_id", text.file_name(F.col("url")).alias("file"))


@query(
    "WITH s AS (SELECT doc_id, CAST(doc_id % 3000 AS VARCHAR) AS card, CASE lang WHEN 'en' THEN 'new_item' ELSE 'stale_nudge' END AS source, CAST(doc_id AS VARCHAR) AS item, CASE lang WHEN 'de' THEN 'card moved' END AS note FROM documents), "
    "i AS (SELECT CAST(doc_id AS VARCHAR) AS u, CASE WHEN doc_id % 2 = 0 THEN '' ELSE source || ' title' END AS title, lang AS text FROM documents WHERE doc_id % 3 <> 0), "
    "j AS (SELECT s.*, i.u, i.title, i.text, c_name, c_mktsegment FROM s LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = card LEFT JOIN i ON i.u = s.item AND s.source = 'new_item') "
    "SELECT doc_id AS rank, CASE WHEN u IS NULL THEN coalesce(c_name, card) WHEN title = '' THEN text ELSE title END AS title, CASE WHEN u IS NULL THEN coalesce(c_mktsegment, '') ELSE u END AS url, CASE WHEN u IS NULL THEN '' ELSE text END AS text, "
    "CASE WHEN note IS NULL THEN 'why' ELSE 'why — ' || note END AS reasoning, coalesce(c_name, card) AS card_name, source FROM j"
)
def project_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8"""
    d, c = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "customer")
    key = F.col("doc_id").cast("string")
    chosen = d.select(F.col("doc_id").alias("rank"), F.pmod("doc_id", F.lit(3000)).cast("string").alias("matched_card_id"), F.when(F.col("lang") == "en", "new_item").otherwise("stale_nudge").alias("source"), key.alias("item_url"), F.lit("why").alias("priority_reasoning"), F.when(F.col("lang") == "de", "card moved").alias("movement_note"))
    cards = c.select(F.col("c_custkey").cast("string").alias("card_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("url"))
    items = d.where("doc_id % 3 <> 0").select(key.alias("url"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat("source", F.lit(" title"))).alias("title"), F.col("lang").alias("text"), F.array().cast("array<string>").alias("tags"))
    return enrich.project_entries(chosen, cards, items).select("rank", "title", "url", "text", "reasoning", "card_name", "source")


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS card_id, coalesce(c_mktsegment, 'Unknown') AS list_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0")
def surfaced_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that the board has not are Unknown"""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("matched_card_id"), F.col("o_orderkey").alias("rank"))
    cards = _t(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("card_id"), F.col("c_mktsegment").alias("list_name"))
    return enrich.surfaced_cards(o, cards)


@query("SELECT c_custkey, n_name AS name FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 40")
def sender_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16"""
    header = F.concat("c_name", F.lit(" <N."), F.pmod("c_custkey", F.lit(40)), F.lit("@Mail.Example>"))
    senders = _t(spark, sf_dir, "nation").select(F.concat(F.lit("n."), "n_nationkey", F.lit("@mail.example")).alias("address"), F.col("n_name").alias("name"))
    return _t(spark, sf_dir, "customer").withColumn("address", rules.sender_address(header)).join(F.broadcast(senders), "address", "left").select("c_custkey", "name")


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS card_id, CASE n_regionkey WHEN 0 THEN 'Dump' ELSE 'In Progress' END AS list_name, CAST(CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 0 END AS INTEGER) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (0, 1)"
)
def board_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the wanted lists, checklist items flattened"""
    n, c = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "customer")
    lists = n.select(F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_regionkey") == 0, "Dump").when(F.col("n_regionkey") == 1, "In Progress").otherwise("Done").alias("name"))
    each = F.expr("CASE WHEN c_custkey % 2 = 0 THEN array(named_struct('checkItems', array(named_struct('name', 'a'), named_struct('name', 'b'))), named_struct('checkItems', array(named_struct('name', 'c')))) END")
    cards = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit("").alias("desc"), F.col("c_nationkey").cast("string").alias("idList"), F.lit("u").alias("shortUrl"), each.alias("checklists"), F.lit(None).cast("string").alias("dateLastActivity"))
    return enrich.board_cards(lists, cards).select("card_id", "list_name", F.size("checklist_items").alias("n"))


@query("SELECT 'https://s.example/' || doc_id || '?a=1&amp;b=2' AS url, source || ' & ' || doc_id AS title, lang || ' more' AS text FROM documents WHERE lang <> 'de'")
def roundup_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roundup page for each document"""
    body = F.expr(
        "'<main><article class=\"m\"><a class=\"l\" href=\"https://s.example/' || doc_id || '?a=1&amp;b=2\"> <h3>' || source || ' &amp; <b>' || doc_id || '</b>' || CASE lang WHEN 'de' THEN ' (Sponsor)' WHEN 'fr' THEN ' (4 minute read)' ELSE '' END || '</h3></a>"
        "<div class=\"x newsletter-html\"><i>' || lang || '</i> more</div></article><article>no story</article></main>'"
    )
    return feeds.parse_roundups(_t(spark, sf_dir, "documents").select(F.lit("r").alias("name"), F.lit("t").alias("fetched_at"), body.alias("body"))).select("url", "title", "text")


@query("SELECT o_orderpriority AS node_name, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') / sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 6) AS cost_ratio FROM orders GROUP BY o_orderpriority HAVING count(*) FILTER (WHERE o_orderstatus = 'F') > 0 AND count(*) FILTER (WHERE o_orderstatus = 'O') > 0")
def model_cost_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, L22"""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("node_name"), F.col("o_totalprice").cast("double").alias("cost_usd"), F.lit(1.0).alias("latency_ms"), "o_orderstatus")
    return folds.cost_comparison(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")).select("node_name", F.round("cost_ratio", 6).alias("cost_ratio"))
