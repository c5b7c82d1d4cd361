"""Gates, overrides, fallbacks and set tests over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.operators import decisions, metrics
from lodestar.plans.registry import query, read


@query("SELECT scope, count(*) AS n FROM orders, (VALUES ('must'), ('other'), ('all')) s(scope) WHERE scope = 'all' OR (scope = 'must') = (o_orderpriority = '1-URGENT') GROUP BY scope")
def priority_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "must").otherwise("could")
    rows = read(spark, sf_dir, "orders").select(F.explode(F.array(*[F.when(decisions.in_scope(level, s), s) for s in ("must", "other", "all")])).alias("scope"))
    return rows.where("scope IS NOT NULL").groupBy("scope").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE value >= 20 AND coalesce(CASE event_id % 3 WHEN 0 THEN false WHEN 1 THEN true END, true)")
def announce_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    safe = F.when(n % 3 == 0, False).when(n % 3 == 1, True)
    return read(spark, sf_dir, "events").where(decisions.may_announce(F.col("value") >= 20, safe)).select("event_id")


@query("""SELECT source, CASE WHEN held <> 0 THEN 'excluded rows' WHEN status <> 'approved' THEN 'not approved' END AS reason FROM (SELECT source, count(*) FILTER (WHERE text IS NULL OR n_chars < 20) AS held, CASE WHEN min(doc_id) % 2 = 0 THEN 'approved' ELSE 'draft' END AS status FROM documents GROUP BY source)""")
def admission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("text").isNull() | (F.col("n_chars") < 20)).alias("held"), F.when(F.min("doc_id") % 2 == 0, "approved").otherwise("draft").alias("status"))
    return rows.select("source", decisions.admission(F.col("held"), F.col("status")).alias("reason"))


@query("""WITH a AS (SELECT 0 AS source_rank, c_nationkey AS k, c_custkey AS id FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 1, s_nationkey, s_suppkey FROM supplier UNION ALL SELECT 2, n_nationkey, n_regionkey FROM nation)
SELECT k, source_rank, id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source_rank, id) AS rn FROM a) WHERE rn = 1""")
def first_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, key, number: read(spark, sf_dir, name).select(F.col(key).alias("k"), F.col(number).cast("long").alias("id"))
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"))
    return decisions.first_of_sources([rich, of("supplier", "s_nationkey", "s_suppkey"), of("nation", "n_nationkey", "n_regionkey")], ["k"], [F.col("id")])


@query("SELECT p_brand, count(*) AS n, 9 AS needed FROM part WHERE p_size <= 5 GROUP BY p_brand HAVING count(*) < 9")
def group_shortages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.shortages(read(spark, sf_dir, "part").where("p_size <= 5"), "p_brand", 9)


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase')::INT DESC, value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def primary_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's event: stable ones first, then by confidence."""
    order = F.struct((F.col("event_type") == "purchase").cast("int"), "value", -F.col("event_id"))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", order).alias("event_id"))


_LEVEL = "CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END"


def _level() -> F.Column:
    kind = F.col("event_type")
    return F.when(kind == "error", 4).when(kind == "purchase", 3).when(kind == "signup", 2).otherwise(1)


@query(f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_LEVEL} DESC, value DESC, event_id) AS rn FROM events WHERE value >= 10) WHERE rn = 1")
def chosen_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the gate, a user's event of highest priority, then of highest confidence."""
    rows = read(spark, sf_dir, "events").where(decisions.may_announce(F.col("value") >= 10, F.lit(None).cast("boolean")))
    return rows.groupBy("user_id").agg(F.max_by("event_id", F.struct(_level(), "value", -F.col("event_id"))).alias("event_id"))


@query("SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING 2 * count(*) FILTER (WHERE p_size <= 25) < count(*))")
def open_gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    short = parts.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") <= 25).alias("small")).where("2 * small < n")
    return parts.join(short, "p_brand", "left_semi").select("p_partkey")


@query("SELECT d.doc_id, l.quality, CASE WHEN d.doc_id % 7 = 0 THEN 'test' ELSE 'train' END AS split FROM labels l JOIN documents d USING (doc_id)")
def split_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "test").otherwise("train").alias("split"))
    return read(spark, sf_dir, "labels").select("doc_id", "quality").join(splits, "doc_id")


@query("""SELECT 'labels' AS name, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) = 0 AS inside UNION ALL
SELECT 'documents', (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) = 0""")
def subset_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id")
    test = lambda name, a, b: a.join(b, "doc_id", "left_anti").agg((F.count("*") == 0).alias("inside")).select(F.lit(name).alias("name"), "inside")
    return test("labels", labels, docs).unionByName(test("documents", docs, labels))


@query("SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first)::INT AS place FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL)")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return firsts.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy("first"))).drop("first")


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5, md5(coalesce(text, '')) = md5(trim(coalesce(text, ''))) AS verified FROM documents")
def md5_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("md5"), (F.md5(text) == F.md5(F.trim(text))).alias("verified"))


@query("SELECT page_id, rtrim(replace(replace(base64(encode(coalesce(url, ''))), '+', '-'), '/', '_'), '=') AS token, coalesce(url, '') AS decoded FROM pages")
def base64url_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.rtrim(F.translate(F.base64(F.encode(F.coalesce("url", F.lit("")), "UTF-8")), "+/\r\n", "-_"), F.lit("="))
    padded = F.concat(F.translate("token", "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length("token"), F.lit(4))))
    return read(spark, sf_dir, "pages").select("page_id", token.alias("token")).withColumn("decoded", F.decode(F.unbase64(padded), "UTF-8"))


@query("""WITH s AS (SELECT l_returnflag, l_linenumber AS threshold, round(avg(l_discount), 6) AS f1, round(avg(l_tax), 6) AS recall FROM lineitem GROUP BY ALL)
SELECT l_returnflag, threshold, f1, recall FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY f1 DESC, recall DESC, threshold) AS rn FROM s) WHERE rn = 1""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of highest F1, then of highest recall, then the least."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("threshold")).agg(F.round(F.avg("l_discount"), 6).alias("f1"), F.round(F.avg("l_tax"), 6).alias("recall"))
    best = rows.groupBy("l_returnflag").agg(F.max_by(F.struct("threshold", "f1", "recall"), F.struct("f1", "recall", -F.col("threshold"))).alias("b"))
    return best.select("l_returnflag", "b.threshold", "b.f1", "b.recall")


@query("SELECT count(*) AS scenarios, sum(n)::BIGINT AS total, max(n) AS most, sum(errors)::BIGINT AS errors FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id)")
def scenario_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return reports.agg(F.count("*").alias("scenarios"), F.sum("n").alias("total"), F.max("n").alias("most"), F.sum("errors").alias("errors"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS n FROM events")
def trailing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type in the ten minutes up to each."""
    rows = read(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.select("event_id", F.count("*").over(W.partitionBy("event_type").orderBy("us").rangeBetween(-600_000_000, 0)).alias("n"))


_OVERRIDES = "(SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Brand#99' END AS new_label FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT -n_nationkey - 1, 'Brand#00' FROM nation)"


@query(f"""SELECT o.p_partkey, p.p_brand AS old_label, new_label, CASE WHEN p.p_partkey IS NULL THEN 'unmatched' WHEN p.p_brand = new_label THEN 'already_correct' ELSE 'approved' END AS status
FROM {_OVERRIDES} o LEFT JOIN part p USING (p_partkey)""")
def overrides_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    told = parts.where("p_partkey % 11 = 0").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("Brand#99").alias("new_label"))
    told = told.unionByName(read(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("p_partkey"), F.lit("Brand#00").alias("new_label")))
    log, unmatched = decisions.overridden(parts, told, "p_partkey", "p_brand")
    return log.unionByName(unmatched.select("p_partkey", F.lit(None).cast("string").alias("old_label"), "new_label", F.lit("unmatched").alias("status")))


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN 'remove' ELSE 'relabel' END AS action, CASE WHEN p_size = 1 THEN '' ELSE 'Brand#77' END AS new_label FROM part WHERE p_size = 1 OR (p_brand = 'Brand#11' AND p_size < 10)")
def seeded_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(F.col("p_size") == 1, "remove", ""), ((F.col("p_brand") == "Brand#11") & (F.col("p_size") < 10), "relabel", "Brand#77")]
    return decisions.seeded(read(spark, sf_dir, "part"), "p_partkey", rules)


@query("""SELECT n_nationkey AS k, n_regionkey AS place, CASE WHEN n_nationkey % 3 = 0 THEN 'old ' || n_name ELSE 'new ' || n_name END AS value, CASE WHEN n_nationkey % 3 = 0 THEN 'kept' ELSE 'fresh' END AS origin FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 2 = 0""")
def resume_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation")
    of = lambda word, step: rows.where(F.col("n_nationkey") % step == 0).select(F.col("n_nationkey").alias("k"), F.concat(F.lit(word), "n_name").alias("value"))
    return decisions.resumed(rows.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("place")), of("old ", 3), of("new ", 2), "k", "value")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'reject' WHEN o_orderstatus = 'F' THEN 'approve' ELSE '' END AS decision FROM orders")
def decision_back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "approved").otherwise("open").alias("status"))
    told = rows.where("o_orderkey % 5 = 0 OR o_orderkey % 7 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "reject").otherwise(" ").alias("decision"))
    return decisions.back_filled(rows, told, "o_orderkey").select("o_orderkey", "decision")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN event_id % 13 = 0 THEN 'confirmed_by_hand' WHEN event_id % 11 = 0 THEN 'confirmed_owner_review' WHEN event_id % 7 = 6 THEN 'confirmed_online_reference' WHEN event_id % 7 = 5 THEN 'accepted_with_reference_caution'
WHEN value / 50 >= 0.95 THEN 'confirmed_visual_high_confidence' WHEN value / 50 >= 0.9 THEN 'accepted_visual_medium_confidence' ELSE 'needs_second_review' END AS status FROM events) GROUP BY status""")
def evidence_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    reference = F.when(n % 7 == 6, "high").when(n % 7 == 5, "medium")
    status = decisions.evidence_status(F.when(n % 13 == 0, "confirmed_by_hand"), n % 11 == 0, reference, F.col("value") / 50)
    return read(spark, sf_dir, "events").select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


_MANIFEST = """m AS (SELECT page_id, 'l' || page_id % 9 AS label, CASE page_id % 5 WHEN 0 THEN 'controlled_from_MAN01-AB-' || lpad((page_id % 40)::VARCHAR, 4, '0') || '.v' || page_id || '.jpg' WHEN 1 THEN 'MAN01-CD-' || lpad((page_id % 30)::VARCHAR, 4, '0') || '.png' ELSE 'crop_' || page_id % 50 || '.jpg' END AS file_name,
CASE WHEN page_id % 5 = 2 THEN ' ' || regexp_extract(url, '://([^/?#]*)', 1) || ' ' ELSE ' ' END AS source_url, CASE WHEN page_id % 4 = 0 THEN 'k' || page_id % 20 ELSE '' END AS dedupe_key, CASE WHEN page_id % 3 = 0 THEN md5('c' || page_id % 60) END AS crop_sha256, CASE WHEN page_id % 7 > 0 THEN 'g' || page_id % 7 END AS source_group FROM pages)"""


def manifest(pages: DataFrame) -> DataFrame:
    """Pages as rows of a manifest of pictures: collected ones, ones made from them, and others, with some cells empty."""
    k = F.col("page_id")
    text = lambda x, n: F.concat(F.lit(x), (k % n).cast("string"))
    four = lambda n: F.lpad((k % n).cast("string"), 4, "0")
    name = F.when(k % 5 == 0, F.concat(F.lit("controlled_from_MAN01-AB-"), four(40), F.lit(".v"), k.cast("string"), F.lit(".jpg"))).when(k % 5 == 1, F.concat(F.lit("MAN01-CD-"), four(30), F.lit(".png"))).otherwise(F.concat(text("crop_", 50), F.lit(".jpg")))
    host = F.concat(F.lit(" "), F.coalesce(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("")), F.lit(" "))
    return pages.select("page_id", text("l", 9).alias("semantic_sign_id"), name.alias("file_name"), F.lit(None).cast("string").alias("source_label"), F.lit("").alias("source_file_url"), F.when(k % 5 == 2, host).otherwise(" ").alias("source_url"), F.when(k % 4 == 0, text("k", 20)).otherwise("").alias("dedupe_key"), F.when(k % 3 == 0, F.md5(text("c", 60))).alias("crop_sha256"), F.when(k % 7 > 0, text("g", 7)).alias("source_group"))


@query(f"""WITH {_MANIFEST} SELECT page_id, label || '::' || coalesce(nullif(regexp_extract(file_name, 'controlled_from_(MAN01-[A-Z]+-[0-9]{{4}})', 1), ''), nullif(regexp_extract(file_name, '(MAN01-[A-Z]+-[0-9]{{4}})', 1), ''), nullif(trim(coalesce(source_url, '')), ''), nullif(trim(dedupe_key), ''), regexp_replace(file_name, '[.][^.]+$', '')) AS base,
coalesce(source_group, 'unknown') || '::' || label || '::' || coalesce(nullif(trim(dedupe_key), ''), nullif(trim(coalesce(crop_sha256, '')), ''), regexp_replace(file_name, '[.][^.]+$', '')) AS leakage FROM m""")
def manifest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant group and the leakage group of each row of a manifest."""
    return manifest(read(spark, sf_dir, "pages")).select("page_id", decisions.base_variant().alias("base"), decisions.leakage_group().alias("leakage"))


@query("""WITH c AS (SELECT l_returnflag AS target, CASE WHEN l_linenumber % 4 = 0 THEN 'A' ELSE l_returnflag END AS predicted FROM lineitem), k AS (SELECT DISTINCT target AS x FROM c UNION SELECT DISTINCT predicted FROM c)
SELECT a.x AS target, b.x AS predicted, count(c.target) AS n FROM k a CROSS JOIN k b LEFT JOIN c ON c.target = a.x AND c.predicted = b.x GROUP BY ALL""")
def confusion_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of labels, those that do not occur with 0."""
    flag = F.col("l_returnflag")
    rows = read(spark, sf_dir, "lineitem").select(flag.alias("target"), F.when(F.col("l_linenumber") % 4 == 0, "A").otherwise(flag).alias("predicted"))
    return metrics.dense_confusion(metrics.confusion(rows))


@query("""SELECT vec_id, i - 1 AS index, k::INT AS place, round(p[i], 6) AS value FROM (SELECT vec_id, p, i, row_number() OVER (PARTITION BY vec_id ORDER BY p[i] DESC, i) AS k FROM (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p, unnest(range(1, 65)) AS i
FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: exp((x - list_max(embedding::DOUBLE[])) / 0.5)) AS e FROM embeddings))) WHERE k <= 5""")
def softmax_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", V.softmax(V.as_double(F.col("embedding")), 0.5).alias("p"))
    best = rows.select("vec_id", F.posexplode(V.top_elements(F.col("p"), 5)).alias("i", "e"))
    return best.select("vec_id", F.col("e.index").cast("long").alias("index"), (F.col("i") + 1).cast("int").alias("place"), F.round("e.value", 6).alias("value"))
