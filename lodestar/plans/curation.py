"""Dataset curation: dedup, splits, selection, keyed updates and gap reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions.hashing import fold
from lodestar.operators import gaps, merges, selection, splits
from lodestar.plans.registry import query, read

_FRACTION = "(('0x' || substr(sha256('42:' || {0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
_SPLIT = f"CASE WHEN {_FRACTION} < 0.70 THEN 'train' WHEN {_FRACTION} < 0.85 THEN 'validation' ELSE 'test' END"
_GROUP = "source || '::' || lang"


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    group = F.concat(F.col("source"), F.lit("::"), F.coalesce(T.blank_to_null(F.col("lang")), F.lit("none")))
    return docs.withColumns({"sha": F.sha2("text", 256), "leak_group": group})


@query(f"""WITH d AS (SELECT doc_id, lang, sha256(text) AS sha, {_GROUP} AS g, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents)
SELECT {_SPLIT.replace('{0}', 'g')} AS split, lang, count(*) AS n_docs FROM d WHERE rn = 1 GROUP BY ALL""")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup, first id wins; a split for each leakage group; rows by split and language."""
    rows = selection.first_wins(_grouped(spark, sf_dir).select("doc_id", "lang", "sha", "leak_group"), ["sha"], [F.col("doc_id")])
    return rows.withColumn("split", splits.split_of(F.col("leak_group"), 42)).groupBy("split", "lang").agg(F.count("*").alias("n_docs"))


@query("SELECT doc_id, sha256(text) AS sha256, length(text)::BIGINT AS n_characters FROM documents")
def checksum_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("n_characters"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def exact_dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return selection.first_wins(rows, ["sha"], [F.col("doc_id")]).select("doc_id", "source")


@query("SELECT doc_id, source, first_id FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE doc_id > first_id")
def duplicate_reject_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    firsts = rows.groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    return rows.join(firsts, "sha").where("doc_id > first_id").select("doc_id", "source", "first_id")


@query(f"""SELECT sha256(text) AS sha, array_to_string(list_sort(list_distinct(list({_SPLIT.replace('{0}', 'doc_id::VARCHAR')}))), ';') AS splits
FROM documents GROUP BY sha256(text) HAVING count(DISTINCT {_SPLIT.replace('{0}', 'doc_id::VARCHAR')}) > 1""")
def split_leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts that a split by id would put in several splits."""
    rows = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), splits.split_of(F.col("doc_id"), 42).alias("split"))
    return splits.leakage(rows, "sha").select("sha", F.array_join("splits", ";").alias("splits"))


@query(f"""WITH d AS (SELECT source, {_SPLIT.replace('{0}', _GROUP)} AS split FROM documents)
SELECT l.source, s.split FROM (SELECT DISTINCT source FROM d) l, (SELECT unnest(['train', 'validation', 'test']) AS split) s
WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.source = l.source AND d.split = s.split)""")
def missing_labels_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir).select("source", splits.split_of(F.col("leak_group"), 42).alias("split")).distinct()
    wanted = rows.select("source").distinct().select("source", F.explode(F.array(*map(F.lit, splits.SHARES))).alias("split"))
    return wanted.join(rows, ["source", "split"], "left_anti")


@query("""WITH c AS (SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT 'few' || floor((sqrt(8 * doc_id + 1) - 1) / 2)::BIGINT FROM documents WHERE doc_id < 45) GROUP BY source),
s AS (SELECT source, n, greatest(1, round_even(n * 0.15, 0)::BIGINT) AS k FROM c)
SELECT source, n AS total, (CASE WHEN n <= 1 THEN n WHEN n = 2 THEN 1 ELSE n - 2 * k END)::BIGINT AS train,
(CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE k END)::BIGINT AS validation, (CASE WHEN n <= 2 THEN 0 ELSE k END)::BIGINT AS test FROM s""")
def label_target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of each source, and of groups of 0 to 9 documents for the small counts."""
    docs = read(spark, sf_dir, "documents")
    few = docs.where("doc_id < 45").select(F.concat(F.lit("few"), (F.floor((F.sqrt(8 * F.col("doc_id") + 1) - 1) / 2)).cast("string")).alias("source"))
    counts = docs.select("source").unionByName(few).groupBy("source").agg(F.count("*").alias("total"))
    return counts.select("source", "total", *splits.target_counts(F.col("total")))


@query()
def stratified_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir).select(F.concat_ws("/", "source", F.substring("sha", 1, 1)).alias("leak_group"), "lang")
    return splits.stratified(rows, "leak_group", "lang", 42)


_LABEL_FRACTION = "(('0x' || substr(sha256('42:' || label || ':' || leak_group{0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
_TAKE = ", ".join(f"{{'over': ({a} >= g{a})::INT, 'filled': ({a} + o.n)::DOUBLE / g{a}, 'tie': f{a}, 'split': '{s}'}}" for a, s in (("a", "train"), ("b", "validation"), ("c", "test")))


@query(f"""WITH RECURSIVE g AS (SELECT label, vec_id % 97 AS leak_group, count(*) AS n FROM embeddings GROUP BY ALL),
t AS (SELECT label, sum(n)::BIGINT AS total, greatest(1, round_even(sum(n) * 0.15, 0)::BIGINT) AS k FROM g GROUP BY label),
o AS (SELECT label, leak_group, n, total - 2 * k AS ga, k AS gb, k AS gc, {_LABEL_FRACTION.format(" || ':train'")} AS fa, {_LABEL_FRACTION.format(" || ':validation'")} AS fb, {_LABEL_FRACTION.format(" || ':test'")} AS fc,
row_number() OVER (PARTITION BY label ORDER BY {_LABEL_FRACTION.format("")}, leak_group) AS i FROM (SELECT g.label, g.leak_group, g.n, t.total, t.k FROM g JOIN t ON g.label = t.label)),
r AS (SELECT label, leak_group, i, 'train' AS split, n AS a, 0::BIGINT AS b, 0::BIGINT AS c FROM o WHERE i = 1 UNION ALL
SELECT label, leak_group, i, split, a + CASE WHEN split = 'train' THEN n ELSE 0 END, b + CASE WHEN split = 'validation' THEN n ELSE 0 END, c + CASE WHEN split = 'test' THEN n ELSE 0 END
FROM (SELECT o.label, o.leak_group, o.i, o.n, a, b, c, CASE WHEN o.i = 2 THEN 'validation' WHEN o.i = 3 THEN 'test' ELSE list_sort([{_TAKE}])[1].split END AS split FROM r JOIN o ON o.label = r.label AND o.i = r.i + 1))
SELECT label, leak_group, split FROM r""")
def per_label_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = read(spark, sf_dir, "embeddings").groupBy("label", (F.col("vec_id") % 97).alias("leak_group")).agg(F.count("*").alias("n"))
    return splits.by_label(groups, "label", "leak_group", "n", 42)


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || lang || ':' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 20""")
def balanced_topk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_k_by_hash(read(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 20, 7)


@query("""WITH a AS (SELECT lang, source, doc_id, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS k FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY (k > 1)::INT, n_chars DESC, doc_id) AS rn FROM a)
SELECT lang, source, doc_id, n_chars FROM b WHERE rn <= 25""")
def diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    return selection.diverse_top_k(rows, "lang", "source", [F.desc("n_chars"), F.col("doc_id")], 25)


_PARTS = "WITH p AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) "


@query(_PARTS + "SELECT p_brand, p_partkey FROM p WHERE n <= 7 OR i IN (SELECT round_even(k * (n - 1) / 6.0, 0)::BIGINT FROM range(7) t(k))")
def even_spread_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.even_spread(read(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", [F.col("p_partkey")], 7)


@query(_PARTS + "SELECT p_brand, p_partkey FROM p WHERE n <= 7 OR i IN (SELECT (k * n) // 7 FROM range(7) t(k))")
def even_spread_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.floor_spread(read(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", [F.col("p_partkey")], 7)


@query("""WITH a AS (SELECT p_brand, p_size, p_partkey, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS k FROM part),
b AS (SELECT *, count(*) FILTER (WHERE k = 1) OVER (PARTITION BY p_brand) AS bases FROM a),
c AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM b WHERE k = 1 OR bases < 5)
SELECT p_brand, p_partkey FROM c WHERE n <= 5 OR i IN (SELECT (k * n) // 5 FROM range(5) t(k))""")
def spread_by_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.spread_by_base(read(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey"), "p_brand", "p_size", [F.col("p_partkey")], 5).select("p_brand", "p_partkey")


@query(_PARTS + """, m AS (SELECT *, NOT (n <= 7 OR i IN (SELECT (k * n) // 7 FROM range(7) t(k))) AS late FROM p)
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY late, i)::INT AS place FROM m""")
def spread_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.spread_order(read(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", [F.col("p_partkey")], 7)


@query(_PARTS + "SELECT p_brand, p_partkey, k::BIGINT AS turn FROM p, range(120) t(k) WHERE k % n = i")
def round_robin_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.round_robin(read(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", [F.col("p_partkey")], 120)


@query("""SELECT p_partkey, concat_ws('_', 'part', b, lpad(row_number() OVER (PARTITION BY b ORDER BY p_partkey)::VARCHAR, 5, '0'), substr(sha256(p_name), 1, 10)) AS id
FROM (SELECT p_partkey, p_name, regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS b FROM part)""")
def generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", T.slug(F.col("p_brand")).alias("b"))
    return selection.with_ids(rows, "part", "b", [F.col("p_partkey")], F.sha2("p_name", 256)).select("p_partkey", "id")


@query("""WITH c AS (SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS part, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, part, n, coalesce(sum(n) OVER (PARTITION BY l_returnflag ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM c""")
def file_row_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("part"))
    return selection.row_offsets(rows, "l_returnflag", "part")


_TARGETS = "SELECT p_brand, count(*) AS total, 40 + (hash_free % 3) * 10 AS minimum FROM (SELECT p_brand, length(p_brand) + ascii(right(p_brand, 1)) AS hash_free FROM part) GROUP BY p_brand, hash_free"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with a total and a minimum."""
    rows = read(spark, sf_dir, "part").withColumn("v", F.length("p_brand") + F.ascii(F.right("p_brand", F.lit(1))))
    return rows.groupBy("p_brand", "v").agg(F.count("*").alias("total")).select("p_brand", "total", (40 + F.col("v") % 3 * 10).cast("long").alias("minimum"))


@query(f"""SELECT p_brand, total, minimum::BIGINT AS minimum, greatest(0, minimum - total)::BIGINT AS gap,
CASE WHEN total >= minimum THEN 'complete' WHEN total > 0 THEN 'partial' ELSE 'missing' END AS status FROM ({_TARGETS})""")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.with_gap(_targets(spark, sf_dir))


_CLASSES = """c AS (SELECT p_size % 25 AS k, count(*) FILTER (WHERE p_partkey % 5 > 0 OR p_size % 25 < 20) AS total, count(*) FILTER (WHERE p_partkey % 5 IN (1, 2, 3)) AS train, count(*) FILTER (WHERE p_partkey % 5 = 4 AND p_size % 25 <> 7) AS validation, count(*) FILTER (WHERE p_partkey % 5 = 0) AS test,
count(*) FILTER (WHERE p_partkey % 5 > 0 AND p_partkey % 4 <= p_size % 25 % 2) AS tiny FROM part GROUP BY 1),
h AS (SELECT k, CASE WHEN k = 24 THEN 0 ELSE total END AS total, train, validation, test, tiny, k = 1 AS assignment, k IN (2, 7, 9) AS common_must, k = 3 AS demo, k IN (4, 5) AS common_should, k IN (4, 6, 24) AS value_class, k = 8 AS text_class, k = 9 AS known_risk FROM c)"""


@query(f"""WITH {_CLASSES},
g AS (SELECT *, list_filter([CASE WHEN assignment THEN 'assignment' END, CASE WHEN common_must THEN 'common_malaysia' END, CASE WHEN demo THEN 'demo_default' END, CASE WHEN common_should THEN 'secondary_malaysia' END, CASE WHEN value_class THEN 'ocr_value' END, CASE WHEN text_class THEN 'multilingual_text' END, CASE WHEN total > 0 THEN 'current_p5_dataset' END], lambda x: x IS NOT NULL) AS found,
  CASE WHEN assignment OR common_must OR demo THEN 'must' WHEN common_should OR total > 0 THEN 'should' ELSE 'optional' END AS priority FROM h),
t AS (SELECT *, CASE WHEN len(found) = 0 THEN 'future_catalogue' ELSE array_to_string(found, ';') END AS groups, CASE WHEN assignment OR demo THEN [50, 150, 300] WHEN common_must THEN [50, 100, 200] WHEN value_class AND priority <> 'optional' THEN [50, 100, 300] WHEN priority = 'should' THEN [30, 80, 150] ELSE [10, 30, 50] END AS aims,
  CASE WHEN known_risk AND total > 0 AND tiny / total >= 0.25 THEN 'known_noise_history;high_tiny_crop_rate' WHEN known_risk THEN 'known_noise_history' WHEN total > 0 AND tiny / total >= 0.25 THEN 'high_tiny_crop_rate' ELSE 'none' END AS risk,
  CASE WHEN total = 0 THEN 'no_samples' WHEN train > 0 AND validation > 0 AND test > 0 THEN 'ok' ELSE 'missing_' || array_to_string(list_filter([CASE WHEN train = 0 THEN 'train' END, CASE WHEN validation = 0 THEN 'validation' END, CASE WHEN test = 0 THEN 'test' END], lambda x: x IS NOT NULL), '_') END AS split_status FROM g),
s AS (SELECT *, CASE WHEN total = 0 AND priority = 'optional' THEN 'optional_no_data' WHEN total = 0 THEN 'missing_data' WHEN total < aims[1] THEN 'below_minimum' WHEN train = 0 OR validation = 0 THEN 'split_gap' WHEN risk <> 'none' THEN 'ready_count_qc_risk' WHEN total >= aims[3] THEN 'ready_strong' WHEN total >= aims[2] THEN 'ready_good' ELSE 'ready_minimum' END AS status FROM t)
SELECT k, groups, priority, aims[1] AS minimum, aims[2] AS good, aims[3] AS strong, risk, split_status, status,
CASE WHEN priority = 'must' AND status IN ('missing_data', 'below_minimum') THEN 'P0_collect_now' WHEN priority = 'must' AND status IN ('ready_count_qc_risk', 'split_gap') THEN 'P1_fix_before_training' WHEN priority = 'should' AND status IN ('missing_data', 'below_minimum') THEN 'P2_collect_after_P0' WHEN priority = 'should' AND status IN ('ready_count_qc_risk', 'split_gap') THEN 'P3_fix_if_claimed' WHEN priority = 'optional' THEN 'P4_optional' ELSE 'P5_ready_queue' END AS rank,
CASE WHEN status IN ('missing_data', 'below_minimum') THEN 'Collect and annotate at least ' || greatest(aims[1] - total, 0) || ' more clean crops; aim for ' || aims[2] || ' total.' || CASE WHEN assignment THEN ' Keep coursework images as external test unless explicitly moved into training.' ELSE '' END || CASE WHEN demo THEN ' Capture phone/laptop-camera examples from real or printed demo signs.' ELSE '' END || CASE WHEN value_class THEN ' Store OCR transcript/value/unit for each sample.' ELSE '' END
  WHEN status = 'optional_no_data' THEN 'Do not collect now; exclude from final claims unless later promoted.' WHEN status = 'ready_count_qc_risk' THEN 'Run targeted QC/final split audit before training claim; collect only if QC removes too many samples.' WHEN status = 'split_gap' THEN 'Rebuild leakage-safe train/validation/test split before training.' ELSE 'Can be included in next classifier training after dataset freeze.' END AS plan,
CASE WHEN status = 'optional_no_data' THEN 'No final limitation if excluded from claims.' WHEN status IN ('missing_data', 'below_minimum') THEN 'Likely unknown or wrong in the live app until data is collected and the classifier is retrained.' WHEN status = 'ready_count_qc_risk' THEN 'May train a noisy decision boundary unless QC confirms labels.' WHEN status = 'split_gap' THEN 'Metrics may be unreliable until split coverage is fixed.' ELSE 'No major data-count limitation for the next training pass.' END AS limitation FROM s""")
def gap_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each class lacks, by part sizes as classes and part keys as splits."""
    k, key = F.col("k"), F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 25).alias("k")).groupBy("k").agg(
        F.count_if((key % 5 > 0) | (k < 20)).alias("total"), F.count_if((key % 5).isin(1, 2, 3)).alias("train"), F.count_if((key % 5 == 4) & (k != 7)).alias("validation"), F.count_if(key % 5 == 0).alias("test"), F.count_if((key % 5 > 0) & (key % 4 <= k % 2)).alias("tiny"),
    )
    flags = {"assignment": k == 1, "common_must": k.isin(2, 7, 9), "demo": k == 3, "common_should": k.isin(4, 5), "value_class": k.isin(4, 6, 24), "text_class": k == 8, "known_risk": k == 9}
    done = gaps.classified(rows.withColumn("total", F.when(k == 24, 0).otherwise(F.col("total"))).withColumns(flags))
    return done.select("k", F.array_join("groups", ";").alias("groups"), "priority", "minimum", "good", "strong", "risk", "split_status", "status", "rank", "plan", "limitation")


@query(f"""SELECT priority, count(*) AS n, count(*) FILTER (WHERE gap = 0) AS n_complete, sum(gap)::BIGINT AS gap
FROM (SELECT greatest(0, minimum - total) AS gap, CASE WHEN minimum > 50 THEN 'high' ELSE 'normal' END AS priority FROM ({_TARGETS})) GROUP BY priority""")
def priority_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merges.with_gap(_targets(spark, sf_dir)).withColumn("priority", F.when(F.col("minimum") > 50, "high").otherwise("normal"))
    return rows.groupBy("priority").agg(F.count("*").alias("n"), F.count_if(F.col("gap") == 0).alias("n_complete"), F.sum("gap").alias("gap"))


_NEW = "SELECT p_brand, count(*) AS n FROM part WHERE p_size <= 5 GROUP BY p_brand"


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where("p_size <= 5").groupBy("p_brand").agg(F.count("*").alias("n"))


_STATUS = "greatest(0, minimum - total)::BIGINT AS gap, CASE WHEN total >= minimum THEN 'complete' WHEN total > 0 THEN 'partial' ELSE 'missing' END AS status"


@query(f"SELECT p_brand, total, minimum, {_STATUS} FROM (SELECT t.p_brand, (total + coalesce(n, 0))::BIGINT AS total, minimum::BIGINT AS minimum FROM ({_TARGETS}) t LEFT JOIN ({_NEW}) USING (p_brand))")
def tracker_update_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.add_counts(_targets(spark, sf_dir), _new(spark, sf_dir), "p_brand")


@query(f"SELECT p_brand, total, minimum, {_STATUS} FROM (SELECT t.p_brand, (total + least(coalesce(n, 0), greatest(0, minimum - total)))::BIGINT AS total, minimum::BIGINT AS minimum FROM ({_TARGETS}) t LEFT JOIN ({_NEW}) USING (p_brand))")
def tracker_update_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.add_counts(_targets(spark, sf_dir), _new(spark, sf_dir), "p_brand", capped=True)


@query(f"SELECT p_brand, total, minimum, {_STATUS} FROM (SELECT t.p_brand, (CASE WHEN n IS NOT NULL THEN greatest(total, minimum) ELSE total END)::BIGINT AS total, minimum::BIGINT AS minimum FROM ({_TARGETS}) t LEFT JOIN ({_NEW}) USING (p_brand))")
def tracker_update_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.raise_to_minimum(_targets(spark, sf_dir), _new(spark, sf_dir), "p_brand")


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'P') UNION ALL
SELECT o_orderkey, 'P', o_totalprice + 100 FROM orders WHERE o_orderstatus = 'P'""")
def replace_partition_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    fresh = rows.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.col("o_totalprice") + 100)
    return merges.replaced_partition(rows, fresh, F.col("o_orderstatus") == "P")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'checked' ELSE '' END AS decision FROM customer""")
def reviewed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey")
    before = rows.where("c_custkey % 3 = 0").withColumn("decision", F.lit("checked"))
    return merges.keep_reviews(rows, before, "c_custkey", ["decision"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN 'relabelled' ELSE p_brand END AS p_brand FROM part WHERE p_partkey % 10 <> 7""")
def corrections_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    told = rows.where("p_partkey % 10 IN (3, 7)").select("p_partkey", F.when(F.col("p_partkey") % 10 == 3, "relabel").otherwise("remove").alias("action"), F.lit("relabelled").alias("new_label"), F.lit(True).alias("approved"))
    return merges.corrected(rows, told, "p_partkey", "p_brand")[0]


@query("""SELECT p_partkey AS partkey, side FROM (SELECT DISTINCT p_partkey, 'left' AS side FROM part WHERE p_size <= 25 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity <= 10) UNION ALL
SELECT DISTINCT l_partkey, 'right' FROM lineitem WHERE l_quantity <= 10 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25))""")
def one_sided_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts that no small order names, and parts of small orders that are not small."""
    small = read(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("partkey"))
    return merges.one_sided(small, read(spark, sf_dir, "lineitem").where("l_quantity <= 10").select(F.col("l_partkey").alias("partkey")), "partkey")


@query("""SELECT n_nationkey::BIGINT AS nationkey, 'left' AS side FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL
SELECT DISTINCT s_nationkey::BIGINT, 'right' FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def coverage_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nationkey"))
    return merges.one_sided(nations, read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("nationkey")), "nationkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def anti_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(done, "l_orderkey", "left_anti")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'A' AND b.l_partkey = a.l_partkey
AND round_even(b.l_quantity / 7.0, 0) = round_even(a.l_quantity / 7.0, 0))""")
def rounded_marker_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.bround(F.col("l_quantity").cast("double") / 7.0).alias("q"))
    return rows.join(rows.where("l_returnflag = 'A'").select("l_partkey", "q").distinct(), ["l_partkey", "q"], "left_anti").select("l_orderkey", "l_linenumber")


@query("""SELECT l_partkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ';') AS flags FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 2""")
def fd_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merges.dependency_violations(read(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag").where(F.size("values") > 2)
    return rows.select("l_partkey", F.array_join("values", ";").alias("flags"))


@query(f"""SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY sha256(text) HAVING count(DISTINCT {_SPLIT.replace('{0}', _GROUP)}) > 1""")
def cross_split_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir).select("sha", "doc_id", splits.split_of(F.col("leak_group"), 42).alias("split"))
    return rows.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count_distinct("split").alias("k")).where("k > 1").drop("k")


@query("""SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN n_chars < 100 THEN 'short' WHEN n_chars > 20000 THEN 'long' WHEN lang NOT IN ('en', 'fr') THEN 'language' ELSE 'accepted' END AS reason,
count(*) AS n FROM documents GROUP BY 1""")
def reject_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("empty", F.coalesce(F.trim("text"), F.lit("")) == ""), ("short", F.col("n_chars") < 100), ("long", F.col("n_chars") > 20000), ("language", ~F.col("lang").isin("en", "fr"))]
    rows = read(spark, sf_dir, "documents").withColumn("reason", F.coalesce(merges.first_reason(rules), F.lit("accepted")))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase'),
c AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events WHERE event_type = 'click')
SELECT * FROM p UNION ALL SELECT user_id, event_id, value FROM c WHERE rn <= 3 AND user_id NOT IN (SELECT user_id FROM p)""")
def fallback_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    of = lambda kind: rows.where(F.col("event_type") == kind).drop("event_type")
    return selection.preferred_else(of("purchase"), of("click"), "user_id", [F.desc("value"), F.col("event_id")], 3)


@query("""SELECT source, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR) || chr(10)) AS digest FROM documents GROUP BY source""")
def path_list_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.functions.hashing import list_digest

    return read(spark, sf_dir, "documents").groupBy("source").agg(list_digest(F.sort_array(F.collect_list(F.col("doc_id").cast("string")))).alias("digest"))


@query("SELECT sha256(coalesce(o_orderstatus, '') || '|' || o_custkey) AS fingerprint, count(*) AS n FROM orders GROUP BY 1")
def folded_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    return rows.groupBy(F.sha2(fold([F.col("o_orderstatus"), F.col("o_custkey")]), 256).alias("fingerprint")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 0 WHEN event_type = 'signup' THEN 1 ELSE 2 END AS rank FROM events UNION ALL SELECT o_orderkey, 3 FROM orders""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of several schemas as one, with the rank of each."""
    kind = F.col("event_type")
    events = read(spark, sf_dir, "events").select("event_id", F.when(kind == "purchase", 0).when(kind == "signup", 1).otherwise(2).alias("rank"))
    return events.unionByName(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit(3).alias("rank")))
