"""Queries over token sequences, rewards and advantages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.functions import scoring as C
from sextant.operators import balance
from sextant.operators import sequences as S
from sextant.plans.data import K_SQL, R_SQL, records, sequences, table, tokens
from sextant.registry import register

_IDS = "ids AS (SELECT l_orderkey AS row_id, list(l_partkey % 5 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS a FROM lineitem GROUP BY 1)"


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short arrays of small integers; 0 is padding and 1 the end."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", (F.col("l_partkey") % 5).alias("v"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.array_sort(F.collect_list(order)).alias("x")).select("row_id", F.col("x.v").alias("a"))


def _joined(c) -> object:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _array_query(name: str, column, sql: str):
    @register(name, f"WITH {_IDS} SELECT row_id, {sql} AS x FROM ids")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ids(spark, sf_dir).select("row_id", _joined(column(F.col("a"))).alias("x"))


_array_query("pad_left", lambda a: S.pad_left(a, 6, F.lit(0).cast("bigint")), "array_to_string(list_concat(list_resize(CAST([] AS BIGINT[]), greatest(0, 6 - len(a)), 0), a[-6:]), ',')")
_array_query("pad_right", lambda a: S.pad_right(a, 6, F.lit(0).cast("bigint")), "array_to_string(list_resize(a[1:6], 6, 0), ',')")
_array_query("convert_pad", lambda a: S.convert_pad(a, F.lit(0).cast("bigint"), True), "array_to_string(list_concat(list_filter(a, lambda v: v = 0), list_filter(a, lambda v: v <> 0)), ',')")
_array_query("eos_mask", lambda a: S.eos_mask(a, 1), "array_to_string(list_transform(a, lambda v, i: CASE WHEN coalesce(list_position(a, 1), 0) = 0 OR i <= list_position(a, 1) THEN 1 ELSE 0 END), ',')")
_array_query("position_ids", lambda a: S.position_ids(F.transform(a, lambda v: F.when(v != 0, 1).otherwise(0))), "array_to_string(list_transform(a, lambda v, i: CASE WHEN v <> 0 THEN len(list_filter(a[1:i], lambda w: w <> 0)) - 1 ELSE 0 END), ',')")
_array_query("info_mask", lambda a: F.transform(S.info_mask(a, F.transform(a, lambda v, i: i % 2 == 0)), lambda b: b.cast("int")), "array_to_string(flatten(list_transform(a, lambda v, i: list_transform(range(v), lambda z: i % 2))), ',')")
_array_query("rolling_context", lambda a: S.rolling_context(a, F.reverse(a), 5), "array_to_string(list_concat(a, list_reverse(a))[-5:], ',')")
_array_query("policy_positions", lambda a: F.filter(F.transform(a, lambda v, i: F.when(v != 0, i)), lambda x: x.isNotNull()), "array_to_string(list_filter(list_transform(a, lambda v, i: CASE WHEN v <> 0 THEN i - 1 END), lambda z: z IS NOT NULL), ',')")


@register("presence_penalty", """SELECT vec_id, i, round(CASE WHEN i IN (vec_id % 64, (vec_id * 7) % 64) THEN CAST(x AS DOUBLE) - 0.5 ELSE CAST(x AS DOUBLE) END, 6) AS x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)""")
def presence_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.array((F.col("vec_id") % 64).cast("int"), (F.col("vec_id") * 7 % 64).cast("int"))
    logits = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(S.presence_penalty(logits, seen, 0.5)).alias("i", "x")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


_Z = "ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))))"


@register("entropy", f"SELECT vec_id, round({_Z} - list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)) * CAST(x AS DOUBLE))) / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))), 6) AS entropy FROM embeddings")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.entropy(F.transform("embedding", lambda x: x.cast("double"))), 6).alias("entropy"))


@register("logprob_gather", f"SELECT vec_id, round(CAST(embedding[label + 1] AS DOUBLE) - {_Z}, 6) AS logprob FROM embeddings")
def logprob_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.logprob(F.transform("embedding", lambda x: x.cast("double")), F.col("label")), 6).alias("logprob"))


_GAE = f"""WITH {K_SQL}, e AS (SELECT *, reward + 0.99 * coalesce(lead(value) OVER w, 0) - value AS delta FROM k WINDOW w AS (PARTITION BY row_id ORDER BY pos)),
g AS (SELECT row_id, pos, value, sum(delta * pow(0.99 * 0.95, pos)) OVER (PARTITION BY row_id ORDER BY pos DESC) / pow(0.99 * 0.95, pos) AS adv FROM e)"""


@register("gae", _GAE + " SELECT row_id, pos, round(adv + 1e-9, 6) AS advantage, round(adv + value + 1e-9, 6) AS returns FROM g")
def gae(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences(tokens(spark, sf_dir)).select("row_id", "value", S.gae(F.col("reward"), F.col("value"), 0.99, 0.95).alias("adv"))
    flat = s.select("row_id", F.posexplode(F.arrays_zip("adv", "value")).alias("i", "x"))
    return flat.select("row_id", (F.col("i") + 1).cast("bigint").alias("pos"), F.round(F.col("x.adv") + 1e-9, 6).alias("advantage"), F.round(F.col("x.adv") + F.col("x.value") + 1e-9, 6).alias("returns"))


@register("whiten", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / sqrt((SELECT var_samp(value) FROM events) + 1e-8), 6) AS whitened FROM events")
def whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.whiten(table(spark, sf_dir, "events").select("event_id", "value"), "value").select("event_id", F.round("whitened", 6).alias("whitened"))


@register("grpo_advantage", """WITH g AS (SELECT o_custkey, avg(CAST(o_totalprice AS DOUBLE)) AS m, stddev_samp(CAST(o_totalprice AS DOUBLE)) AS s, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, round((CAST(o_totalprice AS DOUBLE) - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE s END + 1e-6), 4) AS advantage FROM orders JOIN g USING (o_custkey)""")
def grpo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("score"))
    return S.group_advantage(scores, "score", "o_custkey").select("o_orderkey", F.round("advantage", 4).alias("advantage"))


_D = "(ref_logp - logp)"


@register("kl_penalty", f"WITH {K_SQL} SELECT row_id, pos, round(logp - ref_logp, 6) AS kl, round(abs(logp - ref_logp), 6) AS abs_kl, round(0.5 * (logp - ref_logp) * (logp - ref_logp), 6) AS mse, round(greatest(-10.0, least(10.0, exp({_D}) - {_D} - 1)), 6) AS low_var FROM k")
def kl_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("logp"), F.col("ref_logp")
    return tokens(spark, sf_dir).select("row_id", "pos", *(F.round(S.kl(a, b, k), 6).alias(n) for k, n in (("kl", "kl"), ("abs", "abs_kl"), ("mse", "mse"), ("low_var_kl", "low_var"))))


@register("kl_reward", f"WITH {K_SQL}, s AS (SELECT row_id, sum((logp - ref_logp) * mask) / nullif(sum(mask), 0) AS kl FROM k GROUP BY 1) SELECT k.row_id, pos, round(reward - 0.05 * (logp - ref_logp) * mask, 6) AS reward, (SELECT round(avg(kl), 6) FROM s) AS batch_kl FROM k")
def kl_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir).withColumn("kl", S.kl(F.col("logp"), F.col("ref_logp"), "kl"))
    mean = t.groupBy("row_id").agg(S.masked_mean(F.col("kl"), F.col("mask")).alias("m")).agg(F.round(F.avg("m"), 6).alias("batch_kl"))  # one row
    return t.crossJoin(F.broadcast(mean)).select("row_id", "pos", F.round(F.col("reward") - 0.05 * F.col("kl") * F.col("mask"), 6).alias("reward"), "batch_kl")


@register("adaptive_kl", """WITH s AS (SELECT row_number() OVER (ORDER BY o_orderdate) AS step, CAST(avg(o_totalprice) AS DOUBLE) / 150000 * 0.1 AS kl, count(*) AS n FROM orders GROUP BY o_orderdate),
b AS (SELECT step, 0.2 * exp(sum(ln(1 + greatest(-0.2, least(0.2, kl / 0.1 - 1)) * n / 10000.0)) OVER (ORDER BY step)) AS beta FROM s)
SELECT step, round(beta, 6) AS beta FROM b""")
def adaptive_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy("o_orderdate").agg((F.avg("o_totalprice").cast("double") / 150000 * 0.1).alias("kl"), F.count(F.lit(1)).alias("n"))
    steps = days.withColumn("run", F.lit(0)).withColumn("step", F.row_number().over(W.partitionBy("run").orderBy("o_orderdate")).cast("bigint"))
    return S.adaptive_kl(steps, 0.2, 0.1, 10000.0).select("step", F.round("beta", 6).alias("beta"))


_PL = f"""WITH {K_SQL}, x AS (SELECT *, exp(logp - old_logp) AS r, reward - value AS a FROM k), y AS (SELECT *, -a * r AS p, -a * greatest(0.8, least(1.2, r)) AS c FROM x)"""


@register("ppo_policy_loss", _PL + " SELECT round(sum(greatest(p, c) * mask) / sum(mask), 6) AS pg_loss, round(sum((c > p)::INT * mask) / sum(mask), 6) AS clip_fraction, round(sum((old_logp - logp) * mask) / sum(mask), 6) AS approx_kl FROM y")
def ppo_policy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.policy_loss(tokens(spark, sf_dir).withColumn("advantage", F.col("reward") - F.col("value")), 0.2)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@register("ppo_value_loss", f"WITH {K_SQL}, x AS (SELECT *, value + logp AS vpred, reward AS ret FROM k), y AS (SELECT *, pow(vpred - ret, 2) AS a, pow(greatest(value - 0.2, least(value + 0.2, vpred)) - ret, 2) AS b FROM x) SELECT round(0.5 * sum(greatest(a, b) * mask) / sum(mask), 6) AS vf_loss, round(sum((b > a)::INT * mask) / sum(mask), 6) AS clip_fraction FROM y")
def ppo_value_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.value_loss(tokens(spark, sf_dir).withColumn("vpred", F.col("value") + F.col("logp")).withColumn("ret", F.col("reward")), 0.2)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@register("masked_stats", f"WITH {K_SQL} SELECT row_id, CAST(sum(mask) AS BIGINT) AS n, round(sum(reward * mask), 6) AS total, round(sum(reward * mask) / nullif(sum(mask), 0), 6) AS mean, round(var_samp(CASE WHEN mask = 1 THEN reward END), 6) AS var FROM k GROUP BY row_id")
def masked_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, m = F.col("reward"), F.col("mask")
    return tokens(spark, sf_dir).groupBy("row_id").agg(F.sum(m).alias("n"), F.round(F.sum(r * m), 6).alias("total"), F.round(S.masked_mean(r, m), 6).alias("mean"), F.round(S.masked_variance(r, m), 6).alias("var"))


@register("mask_coverage", f"WITH {K_SQL} SELECT row_id, CAST(sum(mask) AS BIGINT) AS kept, count(*) AS n, round(sum(mask) / count(*), 6) AS coverage FROM k GROUP BY row_id")
def mask_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).groupBy("row_id").agg(F.sum("mask").alias("kept"), F.count(F.lit(1)).alias("n"), F.round(F.avg("mask"), 6).alias("coverage"))


@register("batch_contract", f"""WITH {K_SQL}, s AS (SELECT row_id, CAST(sum(mask) AS BIGINT) AS m, max(abs(reward - value)) AS a, bool_and(isfinite(exp(logp - old_logp))) AS f FROM k GROUP BY 1)
SELECT row_id, 'empty mask' AS rule FROM s WHERE m = 0 UNION ALL SELECT row_id, 'zero advantage' FROM s WHERE a = 0 UNION ALL SELECT row_id, 'ratio not finite' FROM s WHERE NOT f""")
def batch_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of what a training batch must fulfil."""
    ratio = F.exp(F.col("logp") - F.col("old_logp"))
    s = tokens(spark, sf_dir).groupBy("row_id").agg(F.sum("mask").alias("m"), F.max(F.abs(F.col("reward") - F.col("value"))).alias("a"), F.bool_and(~F.isnan(ratio) & (ratio < float("inf"))).alias("f"))
    broken = F.filter(F.array(F.when(F.col("m") == 0, "empty mask"), F.when(F.col("a") == 0, "zero advantage"), F.when(~F.col("f"), "ratio not finite")), lambda x: x.isNotNull())
    return s.select("row_id", F.explode(broken).alias("rule"))


@register("cost_aware_reward", f"WITH {R_SQL} SELECT sample_id, round(em - 0.1 * searches / 4.0, 6) AS linear, round(em * (1 - 0.1 * searches / 4.0), 6) AS correct_only, round(em - 0.1 * searches / 4.0, 6) AS utility FROM r")
def cost_aware_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    em, s = F.col("em").cast("double"), F.col("searches")
    return records(spark, sf_dir).select("sample_id", F.round(C.cost_aware_reward(em, s, 0.1, 4), 6).alias("linear"), F.round(C.cost_aware_reward(em, s, 0.1, 4, "correct_only"), 6).alias("correct_only"), F.round(C.utility(em, s, 0.1, 4), 6).alias("utility"))


@register("reward_to_token", f"WITH {K_SQL}, n AS (SELECT row_id, count(*) AS n, sum(reward) AS total FROM k GROUP BY 1) SELECT k.row_id, pos, round(CASE WHEN pos = n THEN total ELSE 0 END, 6) AS reward FROM k JOIN n USING (row_id)")
def reward_to_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tokens(spark, sf_dir).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.sum("reward").alias("total"))
    return n.select("row_id", F.posexplode(C.reward_to_token(F.col("total"), F.col("n"))).alias("i", "r")).select("row_id", (F.col("i") + 1).cast("bigint").alias("pos"), F.round("r", 6).alias("reward"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 40 documents by id, with their lengths."""
    return table(spark, sf_dir, "documents").select(F.expr("doc_id div 40").alias("batch"), (F.col("doc_id") % 40).alias("idx"), F.col("n_chars").alias("seqlen"))


@register("seqlen_partition")
def seqlen_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest differencing is an algorithm on a heap: tested for its properties."""
    return balance.partition(lengths(spark, sf_dir), 4)


@register("seqlen_deal", "WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents) SELECT doc_id, CAST(CASE WHEN r // 7 % 2 = 1 THEN 6 - r % 7 ELSE r % 7 END AS INTEGER) AS part FROM r")
def seqlen_deal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to seven workers of about equal total length."""
    return balance.deal(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 7).select("doc_id", "part")


@register("seqlen_greedy", """WITH RECURSIVE d AS (SELECT doc_id // 40 AS batch, doc_id % 40 AS idx, n_chars AS seqlen FROM documents),
g AS (SELECT DISTINCT batch, CAST(-1 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS seqlen, -1 AS part, CAST([0, 0, 0, 0] AS BIGINT[]) AS t FROM d UNION ALL
 SELECT batch, idx, seqlen, p - 1, list_transform(t, lambda x, i: CASE WHEN i = p THEN x + seqlen ELSE x END) FROM (SELECT g.batch, d.idx, d.seqlen, CAST(list_position(t, list_min(t)) AS INTEGER) AS p, t FROM g JOIN d ON d.batch = g.batch AND d.idx = g.idx + 1))
SELECT batch, idx, CAST(seqlen AS BIGINT) AS seqlen, part FROM g WHERE idx >= 0""")
def seqlen_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.partition(lengths(spark, sf_dir), 4, False, "greedy")


@register("imbalance_stats", "WITH p AS (SELECT doc_id // 40 AS batch, doc_id % 4 AS part, sum(n_chars) AS total FROM documents GROUP BY ALL) SELECT batch, CAST(min(total) AS BIGINT) AS least, CAST(max(total) AS BIGINT) AS most, round(avg(total), 6) AS mean FROM p GROUP BY batch")
def imbalance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lengths(spark, sf_dir).withColumn("part", F.col("idx") % 4)
    return balance.imbalance(rows).withColumn("mean", F.round("mean", 6))


@register("microbatch_count", "SELECT doc_id // 40 AS batch, CAST(ceil(sum(n_chars) / 16384.0) AS BIGINT) AS n FROM documents GROUP BY 1")
def microbatch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.microbatches(lengths(spark, sf_dir), 16384)


@register("flops_estimate", "SELECT doc_id // 40 AS batch, round((6.0 * 2e9 * sum(n_chars) + 12.0 * sum(CAST(n_chars AS DOUBLE) * n_chars) * 128 * 16 * 28) / 1e12, 4) AS tflops FROM documents GROUP BY 1")
def flops_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """6 N tokens + 12 length^2 head heads layers."""
    n = F.col("seqlen").cast("double")
    return lengths(spark, sf_dir).groupBy("batch").agg(F.round((6.0 * 2e9 * F.sum(n) + 12.0 * F.sum(n * n) * 128 * 16 * 28) / 1e12, 4).alias("tflops"))


@register("lr_schedule", "SELECT s AS step, round(CASE WHEN s < 10 THEN s / 10.0 ELSE greatest(0.1, 0.5 * (1 + cos(pi() * (s - 10) / 90.0))) END, 6) AS factor FROM (SELECT unnest(range(101)) AS s)")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warm-up, then a cosine down to a tenth."""
    s = F.col("id")
    return spark.range(101).select(s.alias("step"), F.round(F.when(s < 10, s / 10.0).otherwise(F.greatest(F.lit(0.1), 0.5 * (1 + F.cos(F.pi() * (s - 10) / 90.0)))), 6).alias("factor"))
