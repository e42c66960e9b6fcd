"""Queries over evaluation records, pairs, gates and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.operators import evaluation as E
from sextant.plans.data import R2_SQL, R_SQL, records, second_policy, table
from sextant.registry import register
from sextant.sources import runlog


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@register("validation_metrics", f"WITH {R_SQL} SELECT dataset, round(avg(em), 6) AS em, round(avg(utility), 6) AS utility, round(avg(searches), 6) AS searches, round(avg((searches = 0)::INT), 6) AS no_search FROM r GROUP BY dataset")
def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(records(spark, sf_dir).groupBy("dataset").agg(F.avg("em").alias("em"), F.avg("utility").alias("utility"), F.avg("searches").alias("searches"), E.share(F.col("searches") == 0).alias("no_search")))


@register("batch_metrics", f"WITH {R_SQL} SELECT round(avg(em), 6) AS score_mean, max(em) AS score_max, min(em) AS score_min, round(1 - var_samp(em - utility) / (var_samp(em) + 1e-5), 6) AS explained_variance, round(avg(n_tokens), 6) AS length_mean, max(n_tokens) AS length_max, round(avg(clipped), 6) AS clip_ratio FROM r")
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    explained = 1 - F.var_samp(F.col("em") - F.col("utility")) / (F.var_samp("em") + 1e-5)
    return rounded(records(spark, sf_dir).agg(F.avg("em").alias("score_mean"), F.max("em").alias("score_max"), F.min("em").alias("score_min"), explained.alias("explained_variance"), F.avg("n_tokens").alias("length_mean"), F.max("n_tokens").alias("length_max"), F.avg("clipped").alias("clip_ratio")))


@register("valid_action_ratio", f"WITH {R_SQL} SELECT round(avg((searches + em) / (searches + 1.0)), 6) AS mean_of_ratios, round(sum(searches + em) / sum(searches + 1.0), 6) AS ratio_of_sums FROM r")
def valid_action_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the rows' ratios; the ratio of sums beside it, to compare."""
    valid, turns = F.col("searches") + F.col("em"), F.col("searches") + 1.0
    return rounded(records(spark, sf_dir).agg(F.avg(valid / turns).alias("mean_of_ratios"), (F.sum(valid) / F.sum(turns)).alias("ratio_of_sums")))


@register("group_metrics", f"WITH {R_SQL}, g AS (SELECT grp, sum(em) AS c, stddev_samp(em) AS s, count(*) AS n, avg(searches) AS m FROM r GROUP BY grp) SELECT CAST(c AS BIGINT) AS correct, count(*) AS groups, round(count(*) / (SELECT count(*) FROM g), 6) AS ratio, round(avg(s), 6) AS mean_std, round(avg(m), 6) AS mean_searches FROM g GROUP BY c")
def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of correct answers in a group."""
    g = records(spark, sf_dir).groupBy("grp").agg(F.sum("em").alias("correct"), F.stddev_samp("em").alias("s"), F.avg("searches").alias("m"))
    h = g.groupBy("correct").agg(F.count(F.lit(1)).alias("groups"), F.avg("s").alias("mean_std"), F.avg("m").alias("mean_searches"))
    return rounded(h.crossJoin(F.broadcast(h.agg(F.sum("groups").alias("all")))).withColumn("ratio", F.col("groups") / F.col("all")).select("correct", "groups", "ratio", "mean_std", "mean_searches"))


@register("timing_per_token", "SELECT event_type AS section, round(sum(value), 4) AS seconds, round(1000 * sum(value) / sum(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id % 7 + 1 ELSE event_id % 13 + 2 END), 6) AS ms_per_token FROM events GROUP BY event_type")
def timing_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation by response tokens, other sections by all tokens."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("event_type").alias("gen"))
    n = F.when(F.col("event_type") == F.col("gen"), F.col("event_id") % 7 + 1).otherwise(F.col("event_id") % 13 + 2)
    out = events.crossJoin(F.broadcast(first)).groupBy(F.col("event_type").alias("section")).agg(F.sum("value").alias("s"), F.sum(n).alias("n"))
    return out.select("section", F.round("s", 4).alias("seconds"), F.round(1000 * F.col("s") / F.col("n"), 6).alias("ms_per_token"))


@register("metric_means", "SELECT event_type AS key, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.avg("value").alias("mean")))


@register("pass_at_n", f"WITH {R_SQL} SELECT count(*) AS prompts, round(avg((best = 1)::INT), 6) AS pass_rate FROM (SELECT grp, max(em) AS best FROM r GROUP BY grp)")
def pass_at_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = records(spark, sf_dir).groupBy("grp").agg(F.max("em").alias("best"))
    return rounded(best.agg(F.count(F.lit(1)).alias("prompts"), E.share(F.col("best") == 1).alias("pass_rate")))


_METRICS = """count(*) AS n, CAST(sum(em) AS BIGINT) AS correct, round(avg(em), 6) AS em, round(avg(searches), 6) AS mean_searches, round(avg(searches) FILTER (em = 1), 6) AS mean_searches_correct, round(avg(searches) FILTER (em <> 1), 6) AS mean_searches_wrong,
round(avg((searches >= 2)::INT), 6) AS p_two, round(avg((searches >= 3)::INT), 6) AS p_three, round(avg((clipped = 1)::INT), 6) AS clipped, round(avg((em = 1)::INT) FILTER (searches >= 2), 6) AS em_of_two"""


@register("search_metrics", f"WITH {R_SQL} SELECT dataset, {_METRICS} FROM r GROUP BY dataset")
def search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.search_metrics(records(spark, sf_dir), "dataset"))


@register("search_distribution", f"WITH {R_SQL} SELECT s AS searches, count(sample_id) AS n, round(avg(em), 6) AS em FROM (SELECT unnest(range(8)) AS s) LEFT JOIN r ON searches = s GROUP BY s")
def search_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and matches for 0 to 7 searches, empty buckets too."""
    have = records(spark, sf_dir).groupBy("searches").agg(F.count(F.lit(1)).alias("n"), F.avg("em").alias("em"))
    return rounded(spark.range(8).withColumnRenamed("id", "searches").join(have, "searches", "left").select("searches", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "em"))


_STRATUM = "count(*) AS n, round(avg(em), 6) AS em, round(avg(searches), 6) AS mean_searches, round(avg((searches >= 2)::INT), 6) AS p_two FROM r"


@register("strata_metrics", f"WITH {R_SQL} SELECT 'overall' AS dimension, 'all' AS value, {_STRATUM} UNION ALL SELECT 'dataset', dataset, {_STRATUM} GROUP BY dataset UNION ALL SELECT 'level', level, {_STRATUM} GROUP BY level UNION ALL SELECT 'searches', CAST(searches AS VARCHAR), {_STRATUM} GROUP BY searches")
def strata_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.strata(records(spark, sf_dir), ["dataset", "level", "searches"]))


@register("stage_summary", f"WITH {R_SQL} SELECT level AS stage, count(*) AS n, CAST(sum(em) AS BIGINT) AS correct, CAST(sum(searches) AS BIGINT) AS searches, CAST(count(*) FILTER (searches = 0) AS BIGINT) AS no_search, round(sum(utility), 4) AS utility FROM r GROUP BY level")
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(records(spark, sf_dir).groupBy(F.col("level").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum("em").alias("correct"), F.sum("searches").alias("searches"), F.count_if(F.col("searches") == 0).alias("no_search"), F.sum("utility").alias("utility")), 4)


_PAIRS = f"{R_SQL}, {R2_SQL}, pairs AS (SELECT r.sample_id, r.em, r.searches, r2.em AS em_b, r2.searches AS searches_b, CASE WHEN r.em = 1 AND r2.em = 1 THEN 'both_correct' WHEN r.em = 1 THEN 'baseline_only' WHEN r2.em = 1 THEN 'candidate_only' ELSE 'both_wrong' END AS category FROM r JOIN r2 USING (sample_id))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return E.paired(r, second_policy(r))


@register("paired_join", f"WITH {_PAIRS} SELECT * FROM pairs")
def paired_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@register("paired_categories", f"WITH {_PAIRS} SELECT c AS category, count(sample_id) AS n, CAST(coalesce(sum(searches), 0) AS BIGINT) AS searches, CAST(coalesce(sum(searches_b - searches), 0) AS BIGINT) AS delta FROM (SELECT unnest(['both_correct', 'baseline_only', 'candidate_only', 'both_wrong']) AS c) LEFT JOIN pairs ON category = c GROUP BY c")
def paired_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = pairs(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("searches").alias("searches"), F.sum(F.col("searches_b") - F.col("searches")).alias("delta"))
    labels = spark.range(1).select(F.explode(F.array(*map(F.lit, E.OUTCOMES))).alias("category"))
    zero = F.lit(0).cast("bigint")
    return labels.join(have, "category", "left").select("category", *(F.coalesce(c, zero).alias(c) for c in ("n", "searches", "delta")))


@register("search_transitions", f"WITH {_PAIRS} SELECT category, searches, searches_b, count(*) AS n FROM pairs GROUP BY ALL")
def search_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy("category", "searches", "searches_b").agg(F.count(F.lit(1)).alias("n"))


@register("paired_bootstrap")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the difference; the draw is a hash, tested for its moments."""
    p = pairs(spark, sf_dir)
    return rounded(E.bootstrap(p, 10_000, 42, F.col("em_b") - F.col("em")))


@register("gate_decision", f"WITH {R_SQL}, m AS (SELECT avg(em) AS em, avg((searches >= 2)::INT) AS p_two, avg(clipped) AS clipped, NULL AS absent FROM r), c AS (SELECT 'em' AS name, em AS observed, em >= 0.5 AS passed FROM m UNION ALL SELECT 'p_two', p_two, p_two >= 0.5 FROM m UNION ALL SELECT 'clipped', clipped, clipped <= 0.05 FROM m UNION ALL SELECT 'absent', NULL, false FROM m) SELECT CASE WHEN bool_and(passed) THEN 'GO' ELSE 'NO-GO' END AS decision, CAST(count(*) FILTER (NOT passed) AS BIGINT) AS failed FROM c")
def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records(spark, sf_dir).agg(F.avg("em").alias("em"), E.share(F.col("searches") >= 2).alias("p_two"), F.avg("clipped").alias("clipped"), F.lit(None).cast("double").alias("absent"))
    return E.decision(E.criteria(m, [("em", ">=", 0.5), ("p_two", ">=", 0.5), ("clipped", "<=", 0.05), ("absent", ">=", 0)]))


@register("probe_groups", f"WITH {R_SQL} SELECT grp, count(*) AS slots, CAST(sum(em) AS BIGINT) AS correct, CAST(count(*) FILTER (clipped = 0) AS BIGINT) AS clean, bool_or(em = 1 AND searches >= 2) AS covered, min(em) <> max(em) AS learnable, count(DISTINCT searches) AS search_diversity FROM r GROUP BY grp")
def probe_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    em, s = F.col("em"), F.col("searches")
    return records(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("slots"), F.sum(em).alias("correct"), F.count_if(F.col("clipped") == 0).alias("clean"), F.bool_or((em == 1) & (s >= 2)).alias("covered"), (F.min(em) != F.max(em)).alias("learnable"), F.count_distinct(s).alias("search_diversity"))


_FAIL = "list_filter([CASE WHEN em <> 1 THEN 'incorrect' END, CASE WHEN searches < 2 THEN 'fewer_than_two_searches' END, CASE WHEN clipped = 1 THEN 'response_clipped' END], lambda x: x IS NOT NULL)"


def _qualifies() -> dict:
    return {"incorrect": F.col("em") == 1, "fewer_than_two_searches": F.col("searches") >= 2, "response_clipped": F.col("clipped") == 0}


def _failures(r: DataFrame) -> DataFrame:
    return E.violations(r, "sample_id", _qualifies())


@register("trajectory_report", f"WITH {R_SQL} SELECT grp AS group_uid, slot AS group_slot, sample_id, dataset AS category, em, searches AS executed_search_count, clipped = 1 AS response_clipped, clipped = 0 AS clean, len({_FAIL}) = 0 AS valid_correct_multi_search, array_to_string({_FAIL}, ',') AS qualification_failures FROM r")
def trajectory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each trajectory with why it does not qualify, if so."""
    failures, clipped = E.broken(_qualifies()), F.col("clipped")
    return records(spark, sf_dir).select(
        F.col("grp").alias("group_uid"), F.col("slot").alias("group_slot"), "sample_id", F.col("dataset").alias("category"), "em", F.col("searches").alias("executed_search_count"),
        (clipped == 1).alias("response_clipped"), (clipped == 0).alias("clean"), (F.size(failures) == 0).alias("valid_correct_multi_search"), F.array_join(failures, ",").alias("qualification_failures"),
    )


@register("probe_qualification", f"WITH {R_SQL} SELECT sample_id, unnest({_FAIL}) AS rule FROM r")
def probe_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failures(records(spark, sf_dir))


@register("probe_totals", f"WITH {R_SQL} SELECT rule, count(*) AS n FROM (SELECT unnest({_FAIL}) AS rule FROM r) GROUP BY rule")
def probe_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failures(records(spark, sf_dir)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@register("near_miss_examples", f"WITH {R_SQL} SELECT sample_id, len({_FAIL}) AS failures FROM r WHERE len({_FAIL}) = 1 ORDER BY sample_id LIMIT 5")
def near_miss_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's first five rows with a single failure."""
    n = _failures(records(spark, sf_dir)).groupBy("sample_id").agg(F.count(F.lit(1)).alias("failures"))
    return n.where("failures = 1").orderBy("sample_id").limit(5)


@register("terminal_counts", f"WITH {R_SQL} SELECT CAST(count(*) FILTER (searches = 4) AS BIGINT) AS terminal, CAST(count(*) FILTER (searches = 4 AND em = 1) AS BIGINT) AS terminal_correct, CAST(count(*) FILTER (searches = 4 AND clipped = 1) AS BIGINT) AS terminal_clipped FROM r")
def terminal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.col("searches") == 4
    return records(spark, sf_dir).agg(F.count_if(end).alias("terminal"), F.count_if(end & (F.col("em") == 1)).alias("terminal_correct"), F.count_if(end & (F.col("clipped") == 1)).alias("terminal_clipped"))


@register("gate_totals", "SELECT role, count(*) AS n, CAST(count(*) FILTER (lower(split_part(text, ' ', 1)) IN ('', 'query', 'and')) AS BIGINT) AS degenerate, CAST(count(*) - count(DISTINCT split_part(text, ' ', 1)) AS BIGINT) AS repeated FROM conversations GROUP BY role")
def gate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split_part("text", F.lit(" "), F.lit(1))
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower(first).isin("", "query", "and")).alias("degenerate"), (F.count(F.lit(1)) - F.count_distinct(first)).alias("repeated"))


@register("utility_consistency", f"WITH {R_SQL} SELECT sample_id, 'utility' AS rule FROM r WHERE abs(CASE WHEN sample_id % 50 = 7 THEN utility + 0.01 ELSE utility END - (em - 0.1 * searches / 4.0)) > 2e-6")
def utility_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record in fifty has a utility that does not follow from its parts."""
    seen = F.when(F.col("sample_id") % 50 == 7, F.col("utility") + 0.01).otherwise(F.col("utility"))
    return E.violations(records(spark, sf_dir), "sample_id", {"utility": F.abs(seen - (F.col("em") - 0.1 * F.col("searches") / 4.0)) <= 2e-6})


@register("group_completeness", f"WITH {R_SQL} SELECT grp, count(*) AS slots FROM r GROUP BY grp HAVING count(*) <> 5 OR count(DISTINCT slot) <> 5 OR min(slot) <> 0 OR max(slot) <> 4")
def group_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = records(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("slots"), F.count_distinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    return g.where("slots <> 5 OR d <> 5 OR lo <> 0 OR hi <> 4").select("grp", "slots")


@register("trace_catalog_join", f"WITH {R_SQL}, c AS (SELECT doc_id AS sample_id, source FROM documents WHERE doc_id % 3 <> 0) SELECT coalesce(r.sample_id, c.sample_id) AS sample_id, CASE WHEN c.sample_id IS NULL THEN 'extra' WHEN r.sample_id IS NULL THEN 'missing' ELSE 'both' END AS state FROM r FULL JOIN c USING (sample_id)")
def trace_catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that the trace or the catalog lacks, or both have."""
    r = records(spark, sf_dir).select("sample_id", F.lit(1).alias("t"))
    c = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("sample_id"), F.lit(1).alias("c"))
    return r.join(c, "sample_id", "full_outer").select("sample_id", F.when(F.col("c").isNull(), "extra").when(F.col("t").isNull(), "missing").otherwise("both").alias("state"))


@register("catalog_antijoin", f"WITH {R_SQL} SELECT sample_id FROM r WHERE sample_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def catalog_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("sample_id"))
    return records(spark, sf_dir).select("sample_id").join(c, "sample_id", "left_anti")


@register("id_set_diff", "SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def id_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return a.exceptAll(b).distinct().withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).distinct().withColumn("side", F.lit("extra")))


_LOG = "'step:' || CAST(event_id // 5 AS VARCHAR) || ' - metric/' || event_type || ':' || CAST(event_id % 97 AS VARCHAR) || '.5 - text:none - n:' || CAST(event_id AS VARCHAR)"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS line_no", _LOG.replace("event_id // 5", "event_id div 5").replace("VARCHAR", "STRING") + " AS line")


@register("runlog_metrics", "SELECT event_id AS line_no, event_id // 5 AS step, 'metric/' || event_type AS key, event_id % 97 + 0.5::DOUBLE AS value FROM events UNION ALL SELECT event_id, event_id // 5, 'n', CAST(event_id AS DOUBLE) FROM events")
def runlog_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.metrics(log_lines(spark, sf_dir))


@register("metric_prefix_mean", "SELECT round(avg(event_id % 97 + 0.5), 6) AS mean, count(*) AS n FROM events")
def metric_prefix_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runlog.prefix_mean(runlog.metrics(log_lines(spark, sf_dir)), "metric"))


@register("summary_last_write", "SELECT event_type AS key, CAST(arg_max(event_id % 97, event_id) AS DOUBLE) + 0.5 AS value FROM events GROUP BY 1")
def summary_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = runlog.metrics(log_lines(spark, sf_dir)).where(F.startswith("key", F.lit("metric/")))
    return runlog.last_write(m).select(F.regexp_replace("key", "^metric/", "").alias("key"), "value")


@register("training_curve", "WITH s AS (SELECT event_id // 5 AS step, avg(event_id % 97 + 0.5) AS m, max(event_id) AS n FROM events GROUP BY 1) SELECT step, round(m, 6) AS metric, CAST(n AS DOUBLE) AS n, round(m - 0.1 * n / 4.0, 6) AS utility FROM s")
def training_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = runlog.metrics(log_lines(spark, sf_dir))
    steps = m.groupBy("step").agg(F.avg(F.when(F.startswith("key", F.lit("metric/")), F.col("value"))).alias("metric"), F.max(F.when(F.col("key") == "n", F.col("value"))).alias("n"))
    return rounded(steps.withColumn("utility", F.col("metric") - 0.1 * F.col("n") / 4.0))


@register("metric_reconcile", "SELECT event_id // 5 AS step, CAST(count(*) AS BIGINT) AS compared, CAST(count(*) FILTER (event_id % 11 = 0 AND abs(0.01) > 1e-6 * greatest(abs(event_id % 97 + 0.5), abs(event_id % 97 + 0.51)) + 1e-6) AS BIGINT) AS different FROM events GROUP BY 1")
def metric_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log against a history in which one value in eleven is off."""
    log = runlog.metrics(log_lines(spark, sf_dir)).where(F.startswith("key", F.lit("metric/")))
    history = table(spark, sf_dir, "events").selectExpr("event_id AS line_no", "event_id div 5 AS step", "'metric/' || event_type AS key", "event_id % 97 + 0.5D + CASE WHEN event_id % 11 = 0 THEN 0.01D ELSE 0D END AS value")
    return runlog.reconcile(log, history)


@register("step_gaps", "SELECT step, gap FROM (SELECT user_id AS step, user_id - lag(user_id) OVER (ORDER BY user_id) AS gap FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 7 <> 3)) WHERE gap <> 1")
def step_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that do not follow the one before: a step whose predecessor is
    missing, found by an anti-join instead of one ordered pass over all."""
    steps = table(spark, sf_dir, "events").where("user_id % 7 <> 3").select(F.col("user_id").alias("step")).distinct()
    return runlog.gaps(steps)


@register("best_checkpoint", "WITH c AS (SELECT o_custkey AS run, o_orderkey AS step, round(CAST(o_totalprice AS DOUBLE) / 100000, 0) AS score, o_orderkey % 5 AS searches FROM orders) SELECT run, step, score FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, searches, step) AS n FROM c) WHERE n = 1")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("step"), F.round(F.col("o_totalprice").cast("double") / 100000, 0).alias("score"), (F.col("o_orderkey") % 5).alias("searches"))
    best = F.struct(F.col("score"), -F.col("searches"), -F.col("step"))
    return c.groupBy("run").agg(F.max_by(F.struct("step", "score"), best).alias("x")).select("run", "x.step", "x.score")


@register("run_results", "WITH s AS (SELECT lang AS run, count(*) AS n, avg(quality) AS em, avg(l.doc_id % 5) AS searches FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY lang) SELECT run, n, round(em, 6) AS em, round(searches, 6) AS searches, round(em - 0.1 * searches / 4, 6) AS utility, round(n * 2 / 3600.0, 6) AS gpu_hours FROM s")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = records(spark, sf_dir).groupBy(F.col("level").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.avg("em").alias("em"), F.avg("searches").alias("searches"))
    return rounded(s.withColumn("utility", F.col("em") - 0.1 * F.col("searches") / 4).withColumn("gpu_hours", F.col("n") * 2 / 3600.0))


@register("metric_checks", "SELECT event_type AS key, bool_and(value >= 0) AS non_negative, bool_and(isfinite(value)) AS finite, count(*) AS n FROM events GROUP BY 1")
def metric_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.bool_and(v >= 0).alias("non_negative"), F.bool_and(~F.isnan(v) & (F.abs(v) < float("inf"))).alias("finite"), F.count(F.lit(1)).alias("n"))


@register("enriched_questions", f"WITH {R_SQL} SELECT sample_id, coalesce(nullif(dataset, 'src1'), 'unknown') AS type, coalesce(level, 'unknown') AS level, em FROM r")
def enriched_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("sample_id", F.coalesce(F.nullif("dataset", F.lit("src1")), F.lit("unknown")).alias("type"), F.coalesce("level", F.lit("unknown")).alias("level"), "em")


@register("json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.a.b') AS missing FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.a.b").alias("missing"))


@register("turn_counters", "SELECT conv_id, turn, CAST(sum((role = 'user')::INT) OVER w AS BIGINT) AS searches, CAST(count(*) OVER w AS BIGINT) AS actions FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def turn_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum((F.col("role") == "user").cast("bigint")).over(w).alias("searches"), F.count(F.lit(1)).over(w).alias("actions"))
