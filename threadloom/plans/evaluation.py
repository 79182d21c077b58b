"""Metrics of classifiers and calibrators, narrative measures, dataset splits and stored tables.

Scores come from the tables themselves: in ``scored`` a status's length is its score and the
declared bot flag its label, so that every metric has a value that SQL can confirm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y (0 or 1) and score s in [0, 1]: repeated statuses once, null labels left out."""
    m = table(spark, sf_dir, "mastodon_statuses").where("account.bot is not null").groupBy("id").agg(F.max(F.col("account.bot").cast("int")).alias("y"), F.max(F.length("content")).alias("n"))
    return m.select("id", "y", F.least(F.lit(1.0), F.col("n") / F.lit(1000.0)).alias("s"))


_S = "WITH s AS (SELECT id, max(CAST(account.bot AS INTEGER)) AS y, least(1.0::DOUBLE, max(length(content)) / 1000.0) AS s FROM mastodon_statuses WHERE account.bot IS NOT NULL GROUP BY id)\n"


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


@query(
    _S
    + """, c AS (SELECT y, CAST(s >= 0.4 AS INTEGER) AS p, count(*) AS n FROM s GROUP BY ALL)
SELECT k.k AS label, coalesce(sum(n) FILTER (y = k AND p = k), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (y <> k AND p = k), 0)::BIGINT AS fp, coalesce(sum(n) FILTER (y = k AND p <> k), 0)::BIGINT AS fn,
  round(CASE WHEN coalesce(sum(n) FILTER (p = k), 0) = 0 THEN 0 ELSE coalesce(sum(n) FILTER (y = k AND p = k), 0) / sum(n) FILTER (p = k) END, 6) AS precision_,
  round(CASE WHEN coalesce(sum(n) FILTER (y = k), 0) = 0 THEN 0 ELSE coalesce(sum(n) FILTER (y = k AND p = k), 0) / sum(n) FILTER (y = k) END, 6) AS recall
FROM c, (VALUES (0), (1)) k(k) GROUP BY k.k"""
)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class: hits, errors, precision and recall at the threshold 0.4; an empty denominator gives 0."""
    c = scored(spark, sf_dir).select("y", (F.col("s") >= 0.4).cast("int").alias("p")).groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("label")
    each = c.select("y", "p", "n", k).groupBy("label")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    y, p, l = (F.col(x) for x in ("y", "p", "label"))  # noqa: E741
    sums = each.agg(total((y == l) & (p == l)).alias("tp"), total((y != l) & (p == l)).alias("fp"), total((y == l) & (p != l)).alias("fn"))
    tp = F.col("tp")
    return sums.select("label", "tp", "fp", "fn", F.round(ratio(tp, tp + F.col("fp")), 6).alias("precision_"), F.round(ratio(tp, tp + F.col("fn")), 6).alias("recall"))


_CUM = """, v AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY s),
t AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM v)
"""


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, pos, neg, tp, fp, p, n for every distinct score from high to low.

    The windows run over distinct score buckets, of which length-based scores have at most a thousand.
    """
    v = scored(spark, sf_dir).groupBy("s").agg(F.sum("y").alias("pos"), (F.count(F.lit(1)) - F.sum("y")).alias("neg"))
    down, whole = W.orderBy(F.desc("s")), W.partitionBy()
    return v.select("s", "pos", "neg", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))


@query(_S + _CUM + "SELECT round(sum(neg * (tp - pos + pos / 2.0)) / max(p * n), 6) AS roc_auc FROM t")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of pairs of a positive and a negative in which the positive scores higher, ties half."""
    t = thresholds(spark, sf_dir)
    return t.agg(F.round(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0)) / F.max(F.col("p") * F.col("n")), 6).alias("roc_auc"))


@query(_S + _CUM + "SELECT round(sum(pos / p * (tp / (tp + fp))), 6) AS average_precision FROM t")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step sum of precision over recall, not the trapezoid."""
    return thresholds(spark, sf_dir).agg(F.round(F.sum(F.col("pos") / F.col("p") * (F.col("tp") / (F.col("tp") + F.col("fp")))), 6).alias("average_precision"))


@query(
    _S + _CUM + """SELECT round(s, 6) AS threshold, round(tp / (tp + fp), 6) AS precision_, round(tp / p, 6) AS recall, CAST(tp / (tp + fp) >= 0.12 AS INTEGER) AS target_met
FROM t ORDER BY CAST(tp / (tp + fp) >= 0.12 AS INTEGER) DESC, CASE WHEN tp / (tp + fp) >= 0.12 THEN tp / p ELSE tp / (tp + fp) END DESC, s LIMIT 1"""
)
def threshold_at_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold with the best recall at precision 0.12, else with the best precision."""
    prec, rec = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("p")
    met = (prec >= 0.12).cast("int")
    best = thresholds(spark, sf_dir).orderBy(met.desc(), F.when(met == 1, rec).otherwise(prec).desc(), "s").limit(1)
    return best.select(F.round("s", 6).alias("threshold"), F.round(prec, 6).alias("precision_"), F.round(rec, 6).alias("recall"), met.alias("target_met"))


@query(_S + "SELECT least(CAST(floor(s * 10) AS INTEGER), 9) AS bin, count(*) AS n, round(avg(s), 6) AS predicted, round(avg(y), 6) AS observed FROM s GROUP BY 1")
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.least(F.floor(F.col("s") * 10).cast("int"), F.lit(9))
    return scored(spark, sf_dir).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("observed"))


@query(_S + """SELECT round(sum(n * abs(p - o)) / sum(n), 6) AS ece, round(max(brier), 6) AS brier, round(max(ll), 6) AS log_loss FROM (SELECT count(*) AS n, avg(s) AS p, avg(y) AS o FROM s GROUP BY least(floor(s * 10), 9)),
(SELECT avg((s - y) * (s - y)) AS brier, avg(-(y * ln(greatest(least(s, 0.999999), 0.000001)) + (1 - y) * ln(1 - greatest(least(s, 0.999999), 0.000001)))) AS ll FROM s)""")
def calibration_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error over ten bins, Brier score and clipped log loss."""
    s, y = F.col("s"), F.col("y")
    c = F.greatest(F.least(s, F.lit(0.999999)), F.lit(0.000001))
    bins = scored(spark, sf_dir).groupBy(F.least(F.floor(s * 10), F.lit(9))).agg(
        F.count(F.lit(1)).alias("n"), F.avg("s").alias("p"), F.avg("y").alias("o"), F.sum((s - y) * (s - y)).alias("b"), F.sum(-(y * F.log(c) + (1 - y) * F.log(1 - c))).alias("l")
    )
    n = F.sum("n")
    return bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("o"))) / n, 6).alias("ece"), F.round(F.sum("b") / n, 6).alias("brier"), F.round(F.sum("l") / n, 6).alias("log_loss"))


@query("SELECT count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, round(quantile_cont(n_chars, 0.05), 6) AS q05, round(quantile_cont(n_chars, 0.5), 6) AS q50, round(quantile_cont(n_chars, 0.95), 6) AS q95 FROM documents")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: F.round(F.percentile("n_chars", F.lit(p)), 6)
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_pop("n_chars"), 6).alias("std"), q(0.05).alias("q05"), q(0.5).alias("q50"), q(0.95).alias("q95"))


@query("SELECT coalesce(lang, 'none') AS slice, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(avg(n_chars), 6) END AS mean, CASE WHEN count(*) >= 20 THEN round(quantile_cont(n_chars, 0.9), 6) END AS p90 FROM documents GROUP BY 1")
def group_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of fewer than twenty rows have no figures."""
    big = F.count(F.lit(1)) >= 20
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.when(big, F.round(F.avg("n_chars"), 6)).alias("mean"), F.when(big, F.round(F.percentile("n_chars", F.lit(0.9)), 6)).alias("p90"))


@query("SELECT round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS worst FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("worst"))


@query(
    """
WITH g AS (SELECT CAST(claim_id AS VARCHAR) AS g, count(*) AS n FROM documents WHERE claim_id IS NOT NULL GROUP BY 1),
o AS (SELECT g, n, row_number() OVER (ORDER BY md5(g || ':17'), g) AS k, count(*) OVER () AS total FROM g)
SELECT g AS claim, n, CASE WHEN k <= ceil(total * 0.2) THEN 'test' WHEN k <= ceil(total * 0.2) + ceil(total * 0.1) THEN 'validation' ELSE 'train' END AS split FROM o
"""
)
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims in train, validation and test: groups in the order of their seeded hash, cut at 20 % and 30 %.

    The numbering over all groups is done in ranges, not in one window.
    """
    g = table(spark, sf_dir, "documents").where("claim_id is not null").groupBy(F.col("claim_id").cast("string").alias("claim")).agg(F.count(F.lit(1)).alias("n"))
    h = g.withColumn("h", F.md5(F.concat("claim", F.lit(":17")))).withColumn("b", F.substring("h", 1, 3))
    starts = h.groupBy("b").agg(F.count(F.lit(1)).alias("c")).withColumn("start", F.coalesce(F.sum("c").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    total = h.agg(F.count(F.lit(1)).alias("total"))
    k = F.row_number().over(W.partitionBy("b").orderBy("h", "claim")) + F.col("start")
    ranked = h.join(starts, "b").crossJoin(F.broadcast(total)).select("claim", "n", k.alias("k"), F.ceil(F.col("total") * 0.2).alias("t"), F.ceil(F.col("total") * 0.1).alias("v"))
    return ranked.select("claim", "n", F.when(F.col("k") <= F.col("t"), "test").when(F.col("k") <= F.col("t") + F.col("v"), "validation").otherwise("train").alias("split"))


@query(
    """WITH d AS (SELECT claim_id % 5 AS part, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents WHERE claim_id IS NOT NULL)
SELECT count(DISTINCT t) AS shared_texts FROM (SELECT t FROM d WHERE part = 0 INTERSECT SELECT t FROM d WHERE part <> 0)"""
)
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts that lie on both sides of a split."""
    d = table(spark, sf_dir, "documents").where("claim_id is not null").select((F.col("claim_id") % 5).alias("part"), F.trim(F.regexp_replace(F.lower("text"), "\\s+", " ")).alias("t"))
    both = d.where("part = 0").select("t").intersect(d.where("part <> 0").select("t"))
    return both.agg(F.count(F.lit(1)).alias("shared_texts"))


@query("SELECT stance, count(*) AS n, count(DISTINCT CAST(CAST(trim(body_id) AS DOUBLE) AS BIGINT)) AS bodies FROM (SELECT DISTINCT headline, body_id, lower(trim(stance)) AS stance FROM train_stances) WHERE length(headline) >= 5 GROUP BY stance")
def stance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stances after label normalisation, with the bodies they speak of."""
    t = table(spark, sf_dir, "train_stances").select("headline", "body_id", F.lower(F.trim("stance")).alias("stance")).distinct().where(F.length("headline") >= 5)
    return t.groupBy("stance").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.trim("body_id").try_cast("double").cast("bigint")).alias("bodies"))


@query(
    """SELECT headline, count(DISTINCT stance) AS labels FROM (SELECT trim(regexp_replace(lower(headline), '\\s+', ' ', 'g')) AS headline, lower(trim(stance)) AS stance FROM train_stances WHERE stance IS NOT NULL) GROUP BY headline HAVING count(DISTINCT stance) > 1"""
)
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that carry different labels and are dropped from training."""
    t = table(spark, sf_dir, "train_stances").where("stance is not null").select(F.trim(F.regexp_replace(F.lower("headline"), "\\s+", " ")).alias("headline"), F.lower(F.trim("stance")).alias("stance"))
    return t.groupBy("headline").agg(F.countDistinct("stance").alias("labels")).where("labels > 1")


@query(
    """SELECT label, count(*) AS n, round(avg(public_metrics.followers_count), 6) AS followers, round(avg(CASE WHEN public_metrics.following_count > 0 THEN public_metrics.followers_count / public_metrics.following_count END), 6) AS follow_ratio
FROM (SELECT DISTINCT id, label, public_metrics FROM users) WHERE label IS NOT NULL GROUP BY label"""
)
def bot_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("public_metrics")
    u = table(spark, sf_dir, "users").select("id", "label", "public_metrics").distinct().where("label is not null")
    return u.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(m.followers_count), 6).alias("followers"), F.round(F.avg(F.when(m.following_count > 0, m.followers_count / m.following_count)), 6).alias("follow_ratio"))


_E = "WITH v AS (SELECT vec_id, label, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings),\nd AS (SELECT vec_id, label, i, CAST(e[i] AS DOUBLE) / norm AS x FROM v, range(1, 65) t(i))\n"


def unit_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, pos, x: the unit vectors' components."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    unit = v.select("vec_id", "label", F.transform("e", lambda x: x / norm).alias("u"))
    return unit.select("vec_id", "label", F.posexplode("u").alias("pos", "x"))


@query(_E + "SELECT label, n, CASE WHEN n < 2 THEN 1.0::DOUBLE ELSE round(least(1, greatest(-1, (s - n) / (n * (n - 1)))), 6) END AS coherence FROM (SELECT label, max(n) AS n, sum(t * t) AS s FROM (SELECT label, i, sum(x) AS t, count(*) AS n FROM d GROUP BY label, i) GROUP BY label)")
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pairwise cosine of each label's vectors from the sum of unit vectors, without pairs; 1 for a single vector."""
    sums = unit_dims(spark, sf_dir).groupBy("label", "pos").agg(F.sum("x").alias("t"), F.count(F.lit(1)).alias("n"))
    by = sums.groupBy("label").agg(F.max("n").alias("n"), F.sum(F.col("t") * F.col("t")).alias("s"))
    mean = F.try_divide(F.col("s") - F.col("n"), F.col("n") * (F.col("n") - 1))
    return by.select("label", "n", F.round(F.when(F.col("n") < 2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), mean))), 6).alias("coherence"))


@query(
    _E
    + """, c AS (SELECT label, i, avg(x) AS m FROM d GROUP BY label, i), s AS (SELECT d.vec_id, d.label, sum(x * m) AS dot FROM d JOIN c ON d.label = c.label AND d.i = c.i GROUP BY d.vec_id, d.label)
SELECT label, vec_id, k AS rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(dot, 6) DESC, vec_id) AS k FROM s) WHERE k <= 5"""
)
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of each label nearest to its centroid."""
    d = unit_dims(spark, sf_dir)
    c = d.groupBy("label", "pos").agg(F.avg("x").alias("m"))
    dots = d.join(c, ["label", "pos"]).groupBy("vec_id", "label").agg(F.sum(F.col("x") * F.col("m")).alias("dot"))
    k = F.row_number().over(W.partitionBy("label").orderBy(F.round("dot", 6).desc(), "vec_id"))
    return dots.select("label", "vec_id", k.alias("rank")).where("rank <= 5")


@query(
    """WITH w AS (SELECT l_returnflag AS g, l_extendedprice AS v, l_quantity AS w FROM lineitem), a AS (SELECT g, v, sum(w) AS w FROM w GROUP BY g, v),
c AS (SELECT g, v, w, sum(w) OVER (PARTITION BY g ORDER BY v) - w / 2 AS mid, sum(w) OVER (PARTITION BY g) AS t FROM a), q AS (SELECT g, max(v) FILTER (mid <= 0.75 * t) AS p75 FROM c GROUP BY g)
SELECT a.g AS flag, round(max(p75), 6) AS p75, round(sum(a.v * a.w) / sum(a.w), 4) AS tail_mean FROM a JOIN q ON a.g = q.g WHERE a.v >= p75 GROUP BY a.g"""
)
def weighted_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean of the values from the weighted 75th percentile on (the value at or below the point)."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v")).agg(F.sum("l_quantity").alias("w"))
    by = W.partitionBy("flag")
    c = a.select("flag", "v", "w", (F.sum("w").over(by.orderBy("v")) - F.col("w") / 2).alias("mid"), F.sum("w").over(by).alias("t"))
    q = c.groupBy("flag").agg(F.max(F.when(F.col("mid") <= 0.75 * F.col("t"), F.col("v"))).alias("p75"))
    return a.join(q, "flag").where("v >= p75").groupBy("flag").agg(F.round(F.max("p75"), 6).alias("p75"), F.round(F.sum(F.col("v") * F.col("w")) / F.sum("w"), 4).alias("tail_mean"))


@query(
    """SELECT event_type, max(n) AS peak FROM (SELECT event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 1 HOUR FOLLOWING) AS n FROM events) GROUP BY event_type"""
)
def peak_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most events of a type in any hour, both ends included; counted per instant, then over instants."""
    each = table(spark, sf_dir, "events").groupBy("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(W.partitionBy("event_type").orderBy("us").rangeBetween(0, 3_600_000_000))
    return each.select("event_type", ahead.alias("n")).groupBy("event_type").agg(F.max("n").alias("peak"))


@query(
    """WITH old AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT CASE WHEN o.k IS NULL THEN 'written' WHEN n.k IS NULL THEN 'kept' WHEN CAST(o.v AS FLOAT) = CAST(n.v AS FLOAT) THEN 'unchanged' ELSE 'updated' END AS status, count(*) AS n FROM old o FULL JOIN new n ON o.k = n.k GROUP BY 1"""
)
def upsert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a keyed upsert of new rows would do: the statuses of ``sources.store.merge_status``."""
    from threadloom.sources.store import merge_status

    customer = table(spark, sf_dir, "customer")
    old = customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("float").alias("v"))
    changed = F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    new = customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), changed.cast("float").alias("v"))
    return merge_status(old, new, ["k"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
