"""URL filter by a character language-model ratio, in DataFrame functions only.

Rules decide the URLs that they fit. Those URLs train two variable-order Markov
models, of accepted and of rejected URLs: the probability of a character given
up to ``ORDER`` characters before it, by Witten-Bell smoothing from the longest
context seen down to the uniform distribution. Every other URL is judged by the
difference of its log-likelihoods per character, against a threshold
calibrated on the ruled URLs (halfway between the mean scores of both kinds).

Counts are grouped by n-gram with map-side pre-aggregation; a model row is one
n-gram, joined to the URLs' n-grams on the n-gram. Scores are sums of whole
millionths of nats, so they do not depend on the order of summation.

Defined cases: a null URL or one without ``://`` has an empty host and path,
fits no rule and is scored on its text (null: empty, score 0, allowed when the
threshold is not above 0); rows stay as they are, repeated ids included; an
input without rows gives no rows; without any ruled URL of one kind, that
kind's model is uniform.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import freed, written

#: Characters of the longest context.
ORDER = 4
#: Size of the alphabet that the lowest order falls back to.
ALPHABET = 256
#: Stands before a URL's first character.
_PAD = "\x02" * ORDER
MICRO = 1_000_000

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def with_parts(urls: DataFrame) -> DataFrame:
    """``urls`` with host and path of ``url``."""
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    cut = urls.withColumn("_rest", rest)
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    after = F.expr("substring(_rest, length(host) + 1)")
    return cut.withColumn("host", host).withColumn("path", F.regexp_extract(after, r"^[^?#]*", 0)).withColumn("host", _lower(F.col("host"))).drop("_rest")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (of equals the first by text), else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(text: Column) -> Column:
    """Each character with the ORDER before it; the text is cut into characters once and held as a variable, so that time grows with its length only."""
    letters = F.concat(F.lit([*_PAD]), F.filter(F.split(text, ""), lambda x: x != ""))

    def runs(held: Column) -> Column:
        n = F.size(held) - len(_PAD)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(*[F.get(held, i + j) for j in range(ORDER + 1)]))

    return F.flatten(F.transform(F.array(letters), runs))


def gram_model(grams: DataFrame) -> DataFrame:
    """(gram, ratio) from distinct rows (gram, good, bad): millionths of the log-likelihood difference of the gram's last character.

    The counts of every order are sums over the grams that end alike; an
    order's probabilities are joined to those of the order below.
    """
    below: DataFrame | None = None
    for order in range(ORDER + 1):
        ending = F.substring("gram", ORDER + 1 - order, order + 1)
        counts = grams.groupBy(ending.alias("ending")).agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad")).withColumn("context", F.substring("ending", 1, order))
        contexts = counts.groupBy("context").agg(
            F.sum("n_good").alias("all_good"), F.sum("n_bad").alias("all_bad"), F.count_if(F.col("n_good") > 0).alias("kinds_good"), F.count_if(F.col("n_bad") > 0).alias("kinds_bad")
        )
        table = counts.join(contexts, "context")
        if below is None:
            table = table.withColumns({f"below_{kind}": F.lit(1.0 / ALPHABET) for kind in ("good", "bad")})
        else:
            shorter = below.select(F.col("ending").alias("shorter"), *[F.col(f"p_{kind}").alias(f"below_{kind}") for kind in ("good", "bad")])
            table = table.withColumn("shorter", F.substring("ending", 2, order)).join(shorter, "shorter")
        chances = []
        for kind in ("good", "bad"):
            n, total, kinds, lower = (F.col(f"{x}_{kind}") for x in ("n", "all", "kinds", "below"))
            chances.append(F.when(total > 0, (n + kinds * lower) / (total + kinds)).otherwise(lower).alias(f"p_{kind}"))
        below = table.select("ending", *chances)
    return below.select(F.col("ending").alias("gram"), F.round((F.log("p_good") - F.log("p_bad")) * MICRO).cast("long").alias("ratio"))


def judged(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, score) for rows with ``url``; score: nats per character for acceptance."""
    parts = with_parts(urls.select(key, "url"))
    ruled = parts.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).select(
        F.col(key).alias("id"), "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("told"), F.coalesce("url", F.lit("")).alias("url")
    )
    # a number stands for each distinct url on the rows of its characters
    distinct = written(ruled.groupBy("url", "told").agg(F.count("*").alias("n")).withColumn("number", F.monotonically_increasing_id()), "urls")
    grams = distinct.select("number", "told", "n", F.explode(_grams(F.col("url"))).alias("gram"))
    counts = written(grams.groupBy("gram").agg(F.sum(F.when(F.col("told") == "allow", F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("told") == "block", F.col("n")).otherwise(0)).alias("bad")), "url-grams")
    model = gram_model(counts)
    sums = grams.join(model, "gram").groupBy("number").agg(F.sum("ratio").alias("sum"))
    scores = written(distinct.join(sums, "number").select("url", "told", "n", "sum"), "url-scores")
    freed(counts, distinct)
    per_character = F.col("sum") / F.greatest(F.length("url"), F.lit(1)) / MICRO
    told = scores.where("told IS NOT NULL")
    # two totals of whole numbers for each kind
    means = {r["told"]: r["mean"] for r in told.select("told", "n", F.round(per_character * MICRO).cast("long").alias("s")).groupBy("told").agg((F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("mean")).collect()}
    threshold = sum(means.get(kind, 0.0) for kind in ("allow", "block")) / 2 / MICRO
    joined = ruled.join(scores.select(F.col("url").alias("u"), "sum"), F.col("url") == F.col("u"), "left")
    score = F.coalesce(F.col("sum") / F.greatest(F.length("url"), F.lit(1)) / MICRO, F.lit(0.0))
    verdict = F.coalesce("told", F.when(score >= threshold, "allow").otherwise("block"))
    return joined.select(F.col("id").alias(key), "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
