"""Text, catalogue and rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import matching, rules, selection
from lodestar.plans.registry import query, read


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS sha FROM documents")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256).alias("sha"))


@query()
def text_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.length(T.plain(T.nfkc(F.col("text")))).alias("n_characters"))


@query("SELECT o_orderkey, (o_orderkey % 90)::DOUBLE + 0.5 AS value, CASE o_orderkey % 4 WHEN 0 THEN 'KM/H' WHEN 1 THEN 'T' WHEN 2 THEN 'M' ELSE 'CM' END AS unit FROM orders")
def numeric_unit_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and units read out of written measures."""
    written = F.concat(F.lit("Limit "), (F.col("o_orderkey") % 90).cast("string"), F.lit(",5 "), F.element_at(F.array(*map(F.lit, ("kph", "ton", "m", "cm"))), (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit(" ahead"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", T.measure(written).alias("m"))
    return rows.select("o_orderkey", "m.value", "m.unit")


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN CASE WHEN regexp_matches(text, '[\\x{3400}-\\x{9FFF}]') THEN 'mixed' ELSE 'latin' END
WHEN regexp_matches(text, '[\\x{3400}-\\x{9FFF}]') THEN 'cjk' WHEN regexp_matches(text, '[0-9]') THEN 'digit' ELSE 'unknown' END AS script FROM conversations""")
def script_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.script_of(F.col("text")).alias("script"))


@query("SELECT p_partkey, round(levenshtein(lower(replace(p_name, 'a', 'e')), lower(p_name)) / greatest(1, length(p_name))::DOUBLE, 6) AS cer FROM part")
def character_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    return rows.select("p_partkey", F.round(T.character_error_rate(F.replace(F.col("p_name"), F.lit("a"), F.lit("e")), F.col("p_name")), 6).alias("cer"))


@query("SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def alias_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by a written nation name against names and aliases, the first entry wins."""
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    aliases = nations.select("n_nationkey", F.explode(F.array(F.lower("n_name"), F.concat(F.lit("the "), F.lower("n_name")))).alias("alias"))
    catalogue = aliases.groupBy("alias").agg(F.min("n_nationkey").alias("n_nationkey"))
    written = read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower(F.concat(F.lit(" The  "), F.col("n_name"))).alias("said"))
    return written.select("c_custkey", T.plain(F.col("said")).alias("alias")).join(catalogue, "alias").select("c_custkey", "n_nationkey")


@query("""WITH s AS (SELECT n_nationkey AS said_key, lower(n_name) || 'x' AS said FROM nation),
r AS (SELECT said_key, n_nationkey, 1 - levenshtein(said, lower(n_name)) / greatest(length(said), length(n_name))::DOUBLE AS score FROM s, nation),
k AS (SELECT said_key, n_nationkey, score, row_number() OVER (PARTITION BY said_key ORDER BY score DESC, n_nationkey) AS rn, score - lead(score) OVER (PARTITION BY said_key ORDER BY score DESC, n_nationkey) AS margin FROM r)
SELECT said_key, n_nationkey, round(score, 6) AS score FROM k WHERE rn = 1 AND score >= 0.8 AND margin >= 0.08""")
def alias_fuzzy_lev(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    said = nations.select(F.col("n_nationkey").alias("said_key"), F.concat(F.lower("n_name"), F.lit("x")).alias("said"))
    return rules.best_alias(said, "said_key", "said", nations.select("n_nationkey", F.lower("n_name").alias("alias")), "n_nationkey", rules.EDITS, 0.8, 0.08).withColumn("score", F.round("score", 6))


def written_parts(parts: DataFrame) -> DataFrame:
    """(p_partkey, said): part names as somebody may write them: whole, a letter left out, doubled or exchanged."""
    n, name = F.col("p_partkey"), F.col("p_name")
    at = (n % F.greatest(F.length(name) - 1, F.lit(1)) + 1).cast("int")
    head, letter, rest = F.substring(name, F.lit(1), at), F.substring(name, at, F.lit(1)), F.substring(name, at + 1, F.lit(100))
    written = F.when(n % 4 == 0, name).when(n % 4 == 1, F.concat(F.substring(name, F.lit(1), at - 1), rest)).when(n % 4 == 2, F.concat(head, letter, rest)).otherwise(F.concat(F.substring(name, F.lit(1), at - 1), F.lit("q"), rest))
    return parts.select("p_partkey", rules.compact(F.upper(written)).alias("said"))


def part_aliases(parts: DataFrame, nations: DataFrame) -> DataFrame:
    """(entry, alias): the distinct part names and the nations' names."""
    return parts.select(F.col("p_name").alias("entry"), rules.compact(F.col("p_name")).alias("alias")).distinct().unionByName(nations.select(F.col("n_name").alias("entry"), rules.compact(F.col("n_name")).alias("alias")))


@query()
def alias_fuzzy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written part names against part and nation names, by Ratcliff-Obershelp ratio."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return rules.best_alias(written_parts(parts), "p_partkey", "said", part_aliases(parts, read(spark, sf_dir, "nation")), "entry", rules.RATIO, 0.88, 0.08, 4)


@query(r"""WITH a AS (SELECT DISTINCT p_name AS entry, regexp_replace(lower(p_name), '[^\p{L}\p{N}]', '', 'g') AS alias FROM part UNION ALL SELECT n_name, regexp_replace(lower(n_name), '[^\p{L}\p{N}]', '', 'g') FROM nation),
x AS (SELECT p_partkey, p_name, p_partkey % greatest(length(p_name) - 1, 1) + 1 AS i FROM part),
s AS (SELECT p_partkey, regexp_replace(lower(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN substring(p_name, 1, i - 1) || substring(p_name, i + 1) WHEN 2 THEN substring(p_name, 1, i) || substring(p_name, i, 1) || substring(p_name, i + 1) ELSE substring(p_name, 1, i - 1) || 'q' || substring(p_name, i + 1) END), '[^\p{L}\p{N}]', '', 'g') AS said FROM x),
r AS (SELECT said, entry, max(1 - levenshtein(said, alias) / greatest(length(said), length(alias))::DOUBLE) AS score FROM (SELECT DISTINCT said FROM s) t, a GROUP BY ALL),
k AS (SELECT *, row_number() OVER w AS rn, score - lead(score) OVER w AS margin FROM r WINDOW w AS (PARTITION BY said ORDER BY score DESC, entry))
SELECT p_partkey, entry, round(score, 6) AS score FROM s JOIN k USING (said) WHERE rn = 1 AND score >= 0.8 AND margin >= 0.08""")
def alias_fuzzy_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written part names against part and nation names, by edit distance."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return rules.best_alias(written_parts(parts), "p_partkey", "said", part_aliases(parts, read(spark, sf_dir, "nation")), "entry", rules.EDITS, 0.8, 0.08).withColumn("score", F.round("score", 6))


_TAGS = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _entity, _character in T.ENTITIES.items():
    _quoted = _character.replace("'", "''")
    _TAGS = f"replace({_TAGS}, '{_entity}', '{_quoted}')"


@query(f"SELECT page_id, sha256(trim(regexp_replace({_TAGS}, '\\s+', ' ', 'g'))) AS sha FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(T.strip_html(F.col("html")), 256).alias("sha"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, regexp_extract(url, '://([^/?#]*)', 1) AS host, nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", F.try_parse_url(url, F.lit("PROTOCOL")).alias("protocol"), F.try_parse_url(url, F.lit("HOST")).alias("host"), F.try_parse_url(url, F.lit("QUERY")).alias("query"))


_SIGNS = [("click", "SET_TARGET_SPEED", "warning", "speed", None), ("error", "STOP", "critical", "none", None), ("purchase", "HEIGHT_RESTRICTION", "warning", "height", None), ("signup", "INFORMATION_ONLY", "information", "distance", 400.0)]
_READ = """r AS (SELECT event_id, event_type, value / 50 AS confidence, (event_id % 200)::DOUBLE AS v, CASE event_id % 4 WHEN 0 THEN 'KM/H' WHEN 1 THEN 'CM' WHEN 2 THEN 'M' END AS u, event_id % 10 / 10.0 AS sure FROM events)"""


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    unit = F.when(n % 4 == 0, "KM/H").when(n % 4 == 1, "CM").when(n % 4 == 2, "M")
    return read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"), (F.col("value") / 50).alias("confidence"), (n % 200).cast("double").alias("read_value"), unit.alias("read_unit"), (n % 10 / 10.0).alias("read_confidence"))


@query(f"""WITH {_READ}, x AS (SELECT *, CASE event_type
WHEN 'click' THEN CASE WHEN confidence >= 0.75 AND sure >= 0.65 AND v >= 5 AND v <= 160 AND coalesce(u, 'KM/H') = 'KM/H' THEN 'SET_TARGET_SPEED' END
WHEN 'error' THEN CASE WHEN confidence >= 0.88 THEN 'STOP' END
WHEN 'purchase' THEN CASE WHEN confidence >= 0.75 AND sure >= 0.65 AND ((u = 'CM' AND v >= 50 AND v <= 1000) OR (u = 'M' AND v >= 0.5 AND v <= 10)) THEN 'HEIGHT_RESTRICTION' END
WHEN 'signup' THEN CASE WHEN confidence >= 0.75 THEN 'INFORMATION_ONLY' END END AS a FROM r)
SELECT event_id, coalesce(a, 'UNKNOWN_CAUTION') AS action, CASE a WHEN 'SET_TARGET_SPEED' THEN 'warning' WHEN 'STOP' THEN 'critical' WHEN 'HEIGHT_RESTRICTION' THEN 'warning' WHEN 'INFORMATION_ONLY' THEN 'information' ELSE 'caution' END AS severity,
CASE a WHEN 'SET_TARGET_SPEED' THEN v WHEN 'HEIGHT_RESTRICTION' THEN CASE WHEN u = 'CM' THEN v / 100 ELSE v END WHEN 'INFORMATION_ONLY' THEN CASE WHEN u = 'M' THEN 400.0 END END::DOUBLE AS value,
CASE a WHEN 'SET_TARGET_SPEED' THEN 'KM/H' WHEN 'HEIGHT_RESTRICTION' THEN 'M' WHEN 'INFORMATION_ONLY' THEN CASE WHEN u = 'M' THEN 'M' END END AS unit FROM x""")
def action_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions by catalogue, confidence threshold of the severity and required value."""
    signs = spark.createDataFrame(_SIGNS, "label string, base_action string, severity string, kind string, default_value double")
    return rules.decided(_read(spark, sf_dir), signs).select("event_id", "action", "severity", "value", "unit")


@query(f"""WITH {_READ}, k AS (SELECT unnest(['speed', 'height', 'width', 'weight', 'axle_weight', 'distance', 'time', 'none']) AS kind)
SELECT kind, count(*) AS n, round(sum(x), 6) AS total FROM (SELECT kind, CASE
WHEN kind = 'speed' AND coalesce(u, 'KM/H') = 'KM/H' AND v BETWEEN 5 AND 160 THEN v
WHEN kind IN ('height', 'width') AND u = 'CM' AND v BETWEEN 50 AND 1000 THEN v / 100
WHEN kind IN ('height', 'width') AND u = 'M' AND v BETWEEN 0.5 AND 10 THEN v
WHEN kind IN ('weight', 'axle_weight') AND u = 'T' AND v BETWEEN 0.5 AND 100 THEN v
WHEN kind = 'distance' AND u IN ('M', 'KM') AND v BETWEEN 1 AND 100000 THEN v
WHEN kind = 'time' THEN v END AS x FROM (SELECT event_id, v, CASE WHEN event_id % 5 = 0 THEN 'T' ELSE u END AS u FROM r), k) WHERE x IS NOT NULL GROUP BY kind""")
def parameter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array(*map(F.lit, [*rules.RANGES, "time", "none"])))
    rows = _read(spark, sf_dir).select(F.col("read_value").alias("v"), F.when(F.col("event_id") % 5 == 0, "T").otherwise(F.col("read_unit")).alias("u"), kinds.alias("kind"))
    return rows.select("kind", rules.valid_parameter(F.col("kind"), F.col("v"), F.col("u")).alias("p")).where("p IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("p.value"), 6).alias("total"))


@query("""WITH e AS (SELECT event_id, event_type AS seen, least(1.0, value / 50) AS a, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'click' END AS said, event_id % 10 / 10.0 AS b FROM events),
k AS (SELECT *, seen IN ('click', 'error', 'purchase', 'signup') AS known, coalesce(said IN ('click', 'error', 'purchase', 'signup') AND b >= 0.65, false) AS sure FROM e)
SELECT event_id, CASE WHEN known THEN seen WHEN sure THEN said ELSE 'unknown_sign' END AS label,
round(CASE WHEN known AND sure AND seen = said THEN least(1.0, 0.65 * a + 0.35 * b + 0.10) WHEN NOT known AND sure THEN b ELSE a END::DOUBLE, 6) AS confidence FROM k""")
def label_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier's label against a reader's: the reader confirms a known label and replaces only an unknown one."""
    n, kind, signs = F.col("event_id"), F.col("event_type"), [s[0] for s in _SIGNS]
    said = F.when(n % 3 == 0, kind).when(n % 3 == 1, "click")
    rows = read(spark, sf_dir, "events").select("event_id", kind.alias("seen"), F.least(F.lit(1.0), F.col("value") / 50).alias("a"), said.alias("said"), (n % 10 / 10.0).alias("b"))
    found = rules.resolved(F.col("seen"), F.col("a"), F.col("seen").isin(signs), F.col("said"), F.col("b"), F.col("said").isin(signs))
    return rows.select("event_id", found.alias("r")).select("event_id", "r.label", F.round("r.confidence", 6).alias("confidence"))


@query("""SELECT event_type, count(*) FILTER (WHERE cat = 'text' OR kind NOT IN ('none', 'direction')) AS n FROM (SELECT event_type, CASE WHEN event_id % 4 = 0 THEN 'text' ELSE 'warning' END AS cat,
CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'direction' ELSE 'speed' END AS kind FROM events) GROUP BY event_type""")
def reading_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    need = rules.needs_reading(F.when(n % 4 == 0, "text").otherwise("warning"), F.when(n % 3 == 0, "none").when(n % 3 == 1, "direction").otherwise("speed"))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(need).alias("n"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Limit ' || n || ' km/h ahead' WHEN 1 THEN 'Height limit ' || n || ' m' ELSE 'Weight limit ' || n || ' t' END AS advice, replace(n, '.', '_') AS phrase
FROM (SELECT p_partkey, p_size, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE p_size::VARCHAR || '.5' END AS n FROM part)""")
def advisory_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + F.when(F.col("p_size") % 2 == 0, 0.0).otherwise(0.5)).alias("value"), F.element_at(F.array(*map(F.lit, ("speed", "height", "weight"))), (F.col("p_size") % 3 + 1).cast("int")).alias("kind"))
    return rules.advised(rows).select("p_partkey", "advice", "phrase")


@query("""WITH v AS (SELECT unnest([5, 12, 20, 33, 41]) AS variant), d AS (SELECT p_partkey, p_size, variant, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_size - variant), variant) AS rn FROM part, v WHERE abs(p_size - variant) <= 3)
SELECT p_partkey, d.variant FROM part LEFT JOIN (SELECT * FROM d WHERE rn = 1) d USING (p_partkey)""")
def closest_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.col("p_size").alias("value"), F.lit(1).alias("k"))
    variants = spark.createDataFrame([(1, v) for v in (5, 12, 20, 33, 41)], "k int, variant int")
    return matching.closest_within(rows, F.broadcast(variants), "k", "value", "variant", 3, F.col("variant")).select(F.col("row").alias("p_partkey"), "variant")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size = 7 THEN 'size_7' END, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN p_brand END, CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' END, 'general') AS phrase FROM part""")
def phrase_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    sizes = spark.createDataFrame([(7, "size_7")], "p_size int, by_size string")
    brands = spark.createDataFrame([("Brand#11", "Brand#11"), ("Brand#12", "Brand#12")], "p_brand string, by_brand string")
    both = rows.withColumn("p_size", F.col("p_size").cast("int")).join(F.broadcast(sizes), "p_size", "left").join(F.broadcast(brands), "p_brand", "left")
    return both.select("p_partkey", F.coalesce("by_size", "by_brand", F.when(F.contains(F.col("p_type"), F.lit("STEEL")), "steel"), F.lit("general")).alias("phrase"))


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role, ';' ORDER BY turn) FILTER (WHERE turn < 5) AS first_roles FROM conversations GROUP BY conv_id")
def compact_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.when(F.col("turn") < 5, F.struct("turn", "role")))).alias("r"))
    return rows.select("conv_id", "n_turns", F.array_join(F.transform("r", lambda x: x["role"]), ";").alias("first_roles"))


@query("""SELECT o_orderpriority, label, count(*) AS n FROM (SELECT o_orderpriority, unnest(string_split(CASE WHEN o_orderkey % 5 = 0 THEN '__unlabelled__' WHEN o_orderkey % 2 = 0 THEN 'even ' || o_orderstatus ELSE o_orderstatus END, ' ')) AS label FROM orders) GROUP BY ALL""")
def multi_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    packed = F.when(key % 5 == 0, "  ").when(key % 2 == 0, F.concat(F.lit("even  "), F.col("o_orderstatus"))).otherwise(F.col("o_orderstatus"))
    labels = F.when(F.trim(packed) == "", F.array(F.lit("__unlabelled__"))).otherwise(F.split(F.trim(packed), r"\s+"))
    return read(spark, sf_dir, "orders").select("o_orderpriority", F.explode(labels).alias("label")).groupBy("o_orderpriority", "label").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3")
def topk_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_k(read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_partkey")
