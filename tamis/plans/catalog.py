"""The queries over the driver tables, and their DuckDB counterparts.

Strata are language as domain and language with source as source, so that a source is in one domain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import answers
from tamis.operators import allocate, cluster, convert, losses, sample, score, tensors
from tamis.operators.common import written
from tamis.plans import oracle as sql
from tamis.plans.config import SelectionConfig
from tamis.plans.select import select

FLAGSHIP = "select_learnability_softmax"
CKPTS, ENDS, BUDGET, NITER, WINDOWS = [1, 4, 8], [1, 8], 300, 20, [100, 200, 300, 500, 1000, -1]
#: The windows of main losses, which rows are clustered and ranked by, and of difficulty losses, which budgets and high-loss clusters come from.
MAIN_WINDOW, DIFFICULTY_WINDOW = 1000, 100
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLE_SQL[function.__name__] = oracle
        return function

    return add


#: Earlier names of queries that were run at shorter settings under their own.
ALIASES = {f"{name}_full": name for name in ("kmeans_lloyd_losses", "cluster_size_stats", "select_high_loss_clusters", "select_learnability_softmax", "pipeline_difficulty_then_diversity", "embedding_medoids")}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tamis.plans import round_trips  # noqa: F401  registers its queries here

    QUERIES.update({alias: QUERIES[name] for alias, name in ALIASES.items()})
    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    ORACLE_SQL.update({alias: ORACLE_SQL[name] for alias, name in ALIASES.items()})
    return ORACLE_SQL


# -- inputs ------------------------------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr("doc_id AS sample_id", "text", "lang AS domain", "concat(lang, ':', source) AS source")


def trajs(spark: SparkSession, sf_dir: str, checkpoints: list[int], series: str = "perturbation", keep: bool = False, window: int = DIFFICULTY_WINDOW) -> DataFrame:
    made = losses.surrogate_trajectories(samples(spark, sf_dir), checkpoints, window, series)
    return written(made) if keep else made


def subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").where("quality = 1").selectExpr("doc_id AS sample_id")


# -- scans and subsets -------------------------------------------------------------------------------------


@query("SELECT doc_id AS sample_id, lang AS domain, lang || ':' || source AS source FROM documents")
def samples_scan_projection(spark, sf_dir):
    return samples(spark, sf_dir).drop("text")


@query("SELECT doc_id AS sample_id, lang || ':' || source AS source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def subset_semi(spark, sf_dir):
    return sample.apply_subset(samples(spark, sf_dir), subset(spark, sf_dir)).select("sample_id", "source")


@query("SELECT doc_id AS sample_id, lang || ':' || source AS source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def subset_anti_complement(spark, sf_dir):
    return sample.complement(samples(spark, sf_dir), subset(spark, sf_dir)).select("sample_id", "source")


# -- losses ------------------------------------------------------------------------------------------------


def _window_sql() -> str:
    means = ", ".join(f"coalesce(CAST(sum({sql.token_loss(1)}){'' if n < 0 else f' FILTER (t <= {n})'} AS DOUBLE) / count(*){'' if n < 0 else f' FILTER (t <= {n})'}, 0.0) AS mean_{'full' if n < 0 else n}" for n in WINDOWS)
    columns = ", ".join(f"coalesce(mean_{'full' if n < 0 else n}, 0.0) AS mean_{'full' if n < 0 else n}" for n in WINDOWS)
    return f"WITH {sql.tokens()}, m AS (SELECT doc_id, {means} FROM tok GROUP BY doc_id) SELECT d.doc_id AS sample_id, {columns} FROM documents d LEFT JOIN m USING (doc_id)"


@query(_window_sql())
def token_loss_prefix_means(spark, sf_dir):
    rows = losses.surrogate_token_losses(samples(spark, sf_dir), 1)
    return losses.prefix_means(rows, WINDOWS).drop("losses")


@query(f"WITH {sql.trajectories(CKPTS)}, l AS (SELECT unnest([1, 4, 8]) AS ckpt, unnest([f0, f1, f2]) AS loss FROM traj), m AS (SELECT ckpt, CAST(sum(loss) AS DOUBLE) / count(*) AS mean_loss FROM l GROUP BY ckpt), b AS (SELECT mean_loss AS base FROM m WHERE ckpt = 1) SELECT CAST(ckpt AS INTEGER) AS ckpt, mean_loss, mean_loss / base AS ratio, mean_loss / base BETWEEN 2 AND 3 AS in_range FROM m, b")
def ckpt_mean_and_ratio(spark, sf_dir):
    return losses.checkpoint_means(losses.long_losses(trajs(spark, sf_dir, CKPTS), CKPTS))


@query(f"WITH {sql.trajectories(CKPTS)} SELECT sample_id, CAST(f0 AS DOUBLE) AS ckpt_1, CAST(f1 AS DOUBLE) AS ckpt_4, CAST(f2 AS DOUBLE) AS ckpt_8 FROM traj")
def loss_trajectory_pivot(spark, sf_dir):
    return losses.loss_matrix(losses.long_losses(trajs(spark, sf_dir, CKPTS), CKPTS), CKPTS)


@query(f"WITH {sql.trajectories([1, 2, 3, 5, 8])}, l AS (SELECT unnest([1, 2, 3, 5, 8]) AS ckpt, unnest([f0, f1, f2, f3, f4]) AS loss FROM traj) SELECT CAST(ckpt AS INTEGER) AS ckpt, count(*) AS n, CAST(sum(loss) AS BIGINT) AS total FROM l WHERE ckpt IN (1, 2, 3, 8) GROUP BY ckpt")
def ckpt_spec_pruned(spark, sf_dir):
    there = [1, 2, 3, 5, 8]
    rows = losses.prune_checkpoints(losses.long_losses(trajs(spark, sf_dir, there), there), "1-3,8")
    return rows.groupBy("ckpt").agg(F.count("*").alias("n"), F.sum("loss").alias("total"))


@query(f"WITH {sql.trajectories([8])} SELECT CAST(min(f0) AS BIGINT) AS min_loss, CAST(max(f0) AS BIGINT) AS max_loss, (SELECT f0 FROM (SELECT f0, row_number() OVER (ORDER BY f0) AS i, count(*) OVER () AS n FROM traj) WHERE i = (n + 1) // 2) AS median_loss FROM traj")
def loss_summary(spark, sf_dir):
    return losses.loss_summary(losses.long_losses(trajs(spark, sf_dir, [8]), [8])).select("min_loss", "max_loss", F.col("median_loss").cast("long").alias("median_loss"))


@query(f"WITH {sql.tokens()}, n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) SELECT d.doc_id AS sample_id, CAST(least(coalesce(n, 0), 100) AS BIGINT) AS n_response, CAST(least(coalesce(n, 0), 20) AS BIGINT) AS n_prompt FROM documents d LEFT JOIN n USING (doc_id)")
def response_window_lengths(spark, sf_dir):
    rows = losses.surrogate_token_losses(samples(spark, sf_dir), 1)
    size = lambda c: F.size(c).cast("long")
    return rows.select("sample_id", size(losses.response_window(F.col("losses"), F.lit(0), 100)).alias("n_response"), size(losses.response_window(F.col("losses"), F.size("losses"), 20, prompt_only=True)).alias("n_prompt"))


# -- strata and budgets ------------------------------------------------------------------------------------


@query(f"WITH {sql.trajectories(ENDS)}, {sql.strata('traj', 'domain', 'f1', 's')} SELECT domain, size, round({sql.DIFFICULTY}, 6) AS difficulty FROM s")
def domain_difficulty(spark, sf_dir):
    sums = allocate.stratum_sums(trajs(spark, sf_dir, ENDS), "domain")
    return sums.select("domain", "size", F.round(allocate.geometric_difficulty(), 6).alias("difficulty"))


@query(f"WITH {sql.trajectories(ENDS)}, s AS (SELECT domain, source, count(*) AS size, CAST(sum(f0) AS BIGINT) AS fs, CAST(sum(f1) AS BIGINT) AS ls FROM traj GROUP BY GROUPING SETS ((domain), (domain, source))) SELECT domain, coalesce(source, '(all)') AS source, size, round({sql.DIFFICULTY}, 6) AS difficulty FROM s")
def domain_source_difficulty_grouping_sets(spark, sf_dir):
    rows = trajs(spark, sf_dir, ENDS).select("domain", "source", F.element_at("traj", 1).alias("f"), F.element_at("traj", -1).alias("l"))
    sums = rows.groupingSets([["domain"], ["domain", "source"]], "domain", "source").agg(F.count("*").alias("size"), F.sum("f").alias("first_sum"), F.sum("l").alias("last_sum"))
    return sums.select("domain", F.coalesce("source", F.lit("(all)")).alias("source"), "size", F.round(allocate.geometric_difficulty(), 6).alias("difficulty"))


@query(f"WITH RECURSIVE {sql.trajectories(ENDS)}, {sql.strata('traj', 'domain', 'f1', 's')}, i AS (SELECT 'all' AS grp, domain AS name, size, {sql.DIFFICULTY} AS d, {BUDGET} AS budget FROM s),{sql.softmax('a', 'i')} SELECT name AS domain, take AS n_samples FROM a")
def softmax_alloc_domain(spark, sf_dir):
    sums = allocate.stratum_sums(trajs(spark, sf_dir, ENDS), "domain").withColumn("difficulty", allocate.geometric_difficulty())
    return allocate.softmax_allocation(sums, BUDGET, name="domain").withColumnRenamed("take", "n_samples")


@query(f"WITH RECURSIVE {sql.trajectories(ENDS)},{sql.hierarchical('b', 'traj', 'f1', BUDGET)} SELECT domain, source, n_clusters, n_samples FROM b")
def softmax_alloc_hierarchical(spark, sf_dir):
    return allocate.hierarchical_allocation(allocate.stratum_sums(trajs(spark, sf_dir, ENDS), "domain", "source"), BUDGET)


@query(f"""WITH RECURSIVE s AS (SELECT lang AS source, count(*) AS size, row_number() OVER (ORDER BY count(*), lang) AS i FROM documents GROUP BY lang), c AS (SELECT count(*) AS c FROM s),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST({BUDGET} AS BIGINT) AS rest, '' AS source, CAST(0 AS BIGINT) AS take UNION ALL SELECT s.i, r.rest - least(s.size, r.rest // (c - s.i + 1)), s.source, CAST(least(s.size, r.rest // (c - s.i + 1)) AS BIGINT) FROM r JOIN s ON s.i = r.i + 1, c)
SELECT source, take AS n_samples FROM r WHERE i > 0""")
def waterfill_source_budget(spark, sf_dir):
    sizes = read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("source")).agg(F.count("*").alias("size"))
    return allocate.waterfill(sizes, BUDGET).select("source", F.col("take").alias("n_samples"))


@query(f"WITH RECURSIVE z AS (SELECT lang AS domain, lang AS source, CAST(substr(source, 4) AS BIGINT) AS cluster, count(*) AS size, 60 AS n_samples FROM documents GROUP BY lang, source),{sql.quota_fold('q', 'z')} SELECT domain, CAST(cluster AS INTEGER) AS cluster_id, quota FROM q")
def cluster_quota_fold(spark, sf_dir):
    sizes = read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("domain"), F.expr("cast(substr(source, 4) AS int)").alias("cluster_id")).agg(F.count("*").alias("size"))
    return allocate.cluster_quotas(sizes.withColumn("n_samples", F.lit(60)), ("domain",))


# -- baselines ---------------------------------------------------------------------------------------------


@query(f"WITH {sql.trajectories([4], MAIN_WINDOW)}, r AS (SELECT sample_id, f0 AS loss, row_number() OVER (ORDER BY f0, sample_id) - 1 AS i, count(*) OVER () AS n FROM traj) SELECT sample_id, loss FROM r WHERE i >= (n - least({BUDGET}, n)) // 2 AND i < (n - least({BUDGET}, n)) // 2 + least({BUDGET}, n)")
def select_middle_perplexity(spark, sf_dir):
    rows = trajs(spark, sf_dir, [4], window=MAIN_WINDOW).select("sample_id", F.element_at("traj", 1).alias("loss"))
    return sample.middle_slice(rows, BUDGET)


@query(f"WITH {sql.trajectories(ENDS, MAIN_WINDOW, 'training')} SELECT sample_id, f1 - f0 AS gap FROM traj ORDER BY gap DESC, sample_id LIMIT {BUDGET}")
def select_learnability_baseline(spark, sf_dir):
    return sample.learnability_baseline(trajs(spark, sf_dir, ENDS, "training", keep=True, window=MAIN_WINDOW), BUDGET).select("sample_id", "gap")


@query(f"WITH {sql.trajectories(ENDS, MAIN_WINDOW, 'training')} SELECT sample_id, f1 - f0 AS gap FROM traj ORDER BY gap, sample_id LIMIT {BUDGET}")
def select_learnability_improvement(spark, sf_dir):
    return sample.learnability_baseline(trajs(spark, sf_dir, ENDS, "training", keep=True, window=MAIN_WINDOW), BUDGET, order="improvement").select("sample_id", "gap")


@query(f"SELECT doc_id AS sample_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT {BUDGET}")
def select_random(spark, sf_dir):
    return sample.random_subset(samples(spark, sf_dir).select("sample_id"), BUDGET)


# -- clusters ----------------------------------------------------------------------------------------------


@query(f"WITH {sql.trajectories(CKPTS, MAIN_WINDOW)}, t AS (SELECT * REPLACE (domain AS source), 5 AS k FROM traj), {sql.kmeans('a', 't', ['f0', 'f1', 'f2'], 0)} SELECT sample_id, CAST(cluster AS INTEGER) AS cluster_id, CAST(dist AS BIGINT) AS dist FROM a")
def kmeans_assign_losses(spark, sf_dir):
    rows = trajs(spark, sf_dir, CKPTS, keep=True, window=MAIN_WINDOW).withColumn("k", F.lit(5))
    return cluster.lloyd(rows, ("domain",), "k", niter=0).select("sample_id", "cluster_id", "dist")


@query(f"WITH {sql.trajectories(CKPTS, MAIN_WINDOW)}, t AS (SELECT * REPLACE (domain AS source), 5 AS k FROM traj), {sql.kmeans('a', 't', ['f0', 'f1', 'f2'], NITER)} SELECT sample_id, CAST(cluster AS INTEGER) AS cluster_id, CAST(dist AS BIGINT) AS dist FROM a")
def kmeans_lloyd_losses(spark, sf_dir):
    rows = trajs(spark, sf_dir, CKPTS, keep=True, window=MAIN_WINDOW).withColumn("k", F.lit(5))
    return cluster.lloyd(rows, ("domain",), "k", niter=NITER).select("sample_id", "cluster_id", "dist")


@query(f"WITH {sql.trajectories(CKPTS)}, t AS (SELECT *, least(2, count(*) OVER (PARTITION BY domain, source)) AS k FROM traj), {sql.kmeans('a', 't', ['f0', 'f1', 'f2'], NITER)}, s AS (SELECT domain, source, cluster, count(*) AS n FROM a GROUP BY ALL) SELECT domain, source, count(*) AS n_clusters, CAST(min(n) AS BIGINT) AS smallest, CAST(max(n) AS BIGINT) AS largest, CAST(sum(n) AS DOUBLE) / count(*) AS mean_size FROM s GROUP BY ALL")
def cluster_size_stats(spark, sf_dir):
    config = SelectionConfig(method="high_loss_clusters", all_samples=True, n_clusters=2, niter=NITER).merged({})
    sizes = select(trajs(spark, sf_dir, CKPTS, keep=True), config).clusters.groupBy("domain", "source", "cluster_id").agg(F.count("*").alias("n"))
    return sizes.groupBy("domain", "source").agg(F.count("*").alias("n_clusters"), F.min("n").alias("smallest"), F.max("n").alias("largest"), (F.sum("n") / F.count("*")).alias("mean_size"))


_HIGH = f"{sql.trajectories(CKPTS)}, t AS (SELECT *, least(2, count(*) OVER (PARTITION BY domain, source)) AS k FROM traj), {sql.kmeans('a', 't', ['f0', 'f1', 'f2'], NITER)},{sql.high_loss('h', 'a', ['f0', 'f1', 'f2'])}"


@query(f"WITH {_HIGH} SELECT domain, source, sample_id FROM h")
def select_high_loss_clusters(spark, sf_dir):
    config = SelectionConfig(method="high_loss_clusters", all_samples=True, n_clusters=2, niter=NITER).merged({})
    return select(trajs(spark, sf_dir, CKPTS, keep=True), config).selected


@query(f"WITH RECURSIVE {sql.trajectories(CKPTS, MAIN_WINDOW)},{sql.softmax_selection('x', 'traj', ['f0', 'f1', 'f2'], BUDGET, NITER)} SELECT domain, source, sample_id FROM x")
def select_learnability_softmax(spark, sf_dir):
    """The flagship: hierarchical budgets by difficulty, clusters of loss trajectories, the strongest trends of each."""
    config = SelectionConfig(method="learnability", softmax=True, size=BUDGET, niter=NITER).merged({})
    return select(trajs(spark, sf_dir, CKPTS, keep=True, window=MAIN_WINDOW), config).selected


_MAIN_MEANS = ", ".join(f"CAST(coalesce(sum({sql.token_loss(j)}) // count(*), 0) AS BIGINT) AS f{i}" for i, j in enumerate(CKPTS))


@query(f"WITH RECURSIVE {_HIGH}, mains AS (SELECT doc_id, {_MAIN_MEANS} FROM tok WHERE t <= {MAIN_WINDOW} GROUP BY doc_id), sub AS (SELECT h.sample_id, h.domain, h.source, coalesce(m.f0, 0) AS f0, coalesce(m.f1, 0) AS f1, coalesce(m.f2, 0) AS f2 FROM h LEFT JOIN mains m ON m.doc_id = h.sample_id),{sql.softmax_selection('x', 'sub', ['f0', 'f1', 'f2'], 100, NITER)} SELECT domain, source, sample_id FROM x")
def pipeline_difficulty_then_diversity(spark, sf_dir):
    """The difficult half of each source by difficulty losses, and a diverse choice from it by main losses."""
    pool = written(sample.apply_subset(trajs(spark, sf_dir, CKPTS, window=MAIN_WINDOW), select_high_loss_clusters(spark, sf_dir)))
    return select(pool, SelectionConfig(method="learnability", softmax=True, size=100, niter=NITER).merged({})).selected


_SMALL_SOURCES = 500


@query(f"WITH RECURSIVE {sql.trajectories(CKPTS)},{sql.high_loss_budget('x', 'traj', ['f0', 'f1', 'f2'], 4, BUDGET, NITER)} SELECT domain, source, sample_id FROM x")
def select_high_loss_budget(spark, sf_dir):
    """A budget's worth of each source's clusters of highest loss, quotas in the order of loss; what a source can't use goes to larger ones."""
    config = SelectionConfig(method="high_loss_clusters", size=BUDGET, n_clusters=4, niter=NITER).merged({})
    return select(trajs(spark, sf_dir, CKPTS, keep=True), config).selected


_ALL = f"{sql.trajectories(CKPTS)}, lt AS (SELECT * REPLACE (domain AS source) FROM traj), {sql.shares('g', 'lt', _SMALL_SOURCES)}, t AS (SELECT lt.*, 2 AS k, whole FROM lt JOIN g USING (domain, source)), {sql.kmeans('a', 't', ['f0', 'f1', 'f2'], NITER)},{sql.high_loss('h', 'a', ['f0', 'f1', 'f2'])}"


@query(f"WITH RECURSIVE {_ALL} SELECT domain, sample_id FROM h WHERE NOT whole UNION ALL SELECT domain, sample_id FROM t WHERE whole")
def select_all_samples_small_sources_whole(spark, sf_dir):
    """All samples of the clusters of highest loss, but of sources that fit an equal share of the size all rows."""
    config = SelectionConfig(method="high_loss_clusters", all_samples=True, size=_SMALL_SOURCES, n_clusters=2, niter=NITER).merged({})
    return select(trajs(spark, sf_dir, CKPTS, keep=True).withColumn("source", F.col("domain")), config).selected.select("domain", "sample_id")


@query(f"WITH {sql.trajectories(ENDS, MAIN_WINDOW)}, z AS (SELECT sample_id, f0, f1, avg(f0) OVER w AS a0, avg(f1) OVER w AS a1, stddev_samp(f0) OVER w AS d0, stddev_samp(f1) OVER w AS d1 FROM traj WINDOW w AS (PARTITION BY source)) SELECT sample_id, round(CASE WHEN d0 > 0 THEN (f0 - a0) / d0 ELSE f0 END, 6) AS first_z, round(CASE WHEN d1 > 0 THEN (f1 - a1) / d1 ELSE f1 END, 6) AS last_z FROM z")
def standardized_features(spark, sf_dir):
    made = cluster.standardize_ends(trajs(spark, sf_dir, ENDS, window=MAIN_WINDOW), ("source",))
    return made.select("sample_id", F.round("first_z", 6).alias("first_z"), F.round("last_z", 6).alias("last_z"))


# -- embeddings --------------------------------------------------------------------------------------------

_MEDOID_K, _MEDOID_ITER = 10, NITER


def _medoid_sql() -> str:
    parts = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)) AS e FROM embeddings)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS cluster, e FROM v QUALIFY cluster < {_MEDOID_K})",
    ]
    for i in range(_MEDOID_ITER + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, e, cluster, dist FROM (SELECT v.vec_id, v.e, c.cluster, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS BIGINT) AS dist FROM v, c{i} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster) = 1)")
        if i < _MEDOID_ITER:
            parts.append(f"m{i} AS (SELECT cluster, i, CAST(sum(x) // count(*) AS BIGINT) AS x FROM (SELECT cluster, unnest(e) AS x, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY cluster, i)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS e FROM m{i} GROUP BY cluster) m USING (cluster))")
    return f"WITH {', '.join(parts)} SELECT CAST(cluster AS INTEGER) AS cluster_id, arg_min(vec_id, (dist, vec_id)) AS sample_id FROM a{_MEDOID_ITER} GROUP BY cluster"


@query(_medoid_sql())
def embedding_medoids(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), cluster.quantize(F.col("embedding")).alias("traj"), F.lit(0).alias("all"), F.lit(_MEDOID_K).alias("k"))
    groups = cluster.lloyd(written(rows), ("all",), "k", niter=_MEDOID_ITER)
    return cluster.medoids(groups, ("all",)).select("cluster_id", "sample_id")


@query("WITH t AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings), k AS (SELECT vec_id, i % 4 AS d, CAST(x AS DOUBLE) AS x FROM t WHERE (vec_id + i // 4) % 3 <> 0) SELECT vec_id AS sample_id, round(avg(x) FILTER (d = 0), 6) AS p0, round(avg(x) FILTER (d = 1), 6) AS p1, round(avg(x) FILTER (d = 2), 6) AS p2, round(avg(x) FILTER (d = 3), 6) AS p3 FROM k GROUP BY vec_id")
def embedding_mean_pool(spark, sf_dir):
    """Each embedding read as 16 token vectors of width 4, a third of them masked."""
    places = F.sequence(F.lit(0), F.lit(15))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform(places, lambda i: F.slice("embedding", i * 4 + 1, 4)).alias("v"), F.transform(places, lambda i: F.when((F.col("vec_id") + i) % 3 != 0, 1).otherwise(0)).alias("m"))
    pooled = rows.select("vec_id", cluster.masked_mean(F.col("v"), F.col("m"), 4).alias("p"))
    return pooled.select(F.col("vec_id").alias("sample_id"), *(F.round(F.get("p", F.lit(i)), 6).alias(f"p{i}") for i in range(4)))


# -- conversations -----------------------------------------------------------------------------------------


def raw_records(spark, sf_dir) -> DataFrame:
    """conv_id, prompt, reasoning, answer: the first user turn, the first and the last assistant turn; only complete ones."""
    turns = read(spark, sf_dir, "conversations")
    said = lambda role, pick: pick(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    rows = turns.groupBy("conv_id").agg(said("user", F.min_by).alias("prompt"), said("assistant", F.min_by).alias("reasoning"), said("assistant", F.max_by).alias("answer"))
    return rows.where("length(trim(reasoning)) > 0 AND length(trim(answer)) > 0 AND prompt IS NOT NULL")


_RAW = "raw AS (SELECT * FROM (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS prompt, arg_min(text, turn) FILTER (role = 'assistant') AS reasoning, arg_max(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY conv_id) WHERE length(trim(reasoning)) > 0 AND length(trim(answer)) > 0 AND prompt IS NOT NULL)"
_STRIP = r"trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_CONTENT = f"'{convert.THINK}' || chr(10) || {_STRIP.format('reasoning')} || chr(10) || '{convert.ANSWER}' || chr(10) || {_STRIP.format('answer')} || chr(10) || '{convert.END}' || chr(10)"
_LENGTH = f"CAST(length({_STRIP.format('reasoning')}) + length({_STRIP.format('answer')}) + 4 AS INTEGER)"


@query(f"WITH {_RAW} SELECT conv_id, prompt, {_CONTENT} AS content, 'medical' AS domain FROM raw")
def convert_sharegpt(spark, sf_dir):
    made = convert.reasoning_sample(raw_records(spark, sf_dir), "medical")
    return made.select("conv_id", "prompt", F.expr("conversations[1].content").alias("content"), "domain")


@query("SELECT conv_id, string_agg(role || '=' || text, '|' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def normalize_turns(spark, sf_dir):
    """Turns written as from and value with human and gpt, and read back."""
    whole = convert.conversations_of(read(spark, sf_dir, "conversations"))
    legacy = F.transform("conversations", lambda m: F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"), F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise(m["role"]).alias("from"), m["content"].alias("value")))
    return whole.select("conv_id", F.array_join(F.transform(convert.normalize_turns(legacy), lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("turns"))


@query("SELECT conv_id, 2 AS n_turns FROM conversations GROUP BY conv_id HAVING count(*) = 2")
def two_turn_guard(spark, sf_dir):
    return convert.two_turns(convert.conversations_of(read(spark, sf_dir, "conversations"))).select("conv_id", F.size("conversations").alias("n_turns"))


@query(f"WITH {_RAW} SELECT conv_id, {_LENGTH} AS reasoning_length FROM raw")
def reasoning_length(spark, sf_dir):
    made = convert.reasoning_sample(raw_records(spark, sf_dir), "medical")
    return made.select("conv_id", convert.reasoning_length(F.expr("conversations[1].content"), F.col("conv_id")).alias("reasoning_length"))


@query(f"WITH {_RAW} SELECT conv_id AS sample_id, {_LENGTH} AS reasoning_length FROM raw ORDER BY reasoning_length DESC, conv_id LIMIT 20")
def select_longest_reasoning(spark, sf_dir):
    return sample.longest(reasoning_length(spark, sf_dir).withColumnRenamed("conv_id", "sample_id"), 20)


# -- answers -----------------------------------------------------------------------------------------------


def eval_items(spark, sf_dir) -> DataFrame:
    """Questions with four options from the first words of benchmark items, and templated responses."""
    word = lambda i: F.get(F.split("text", " "), F.lit(i))
    rows = read(spark, sf_dir, "benchmark").where(F.size(F.split("text", " ")) >= 4)
    options = F.array(*(F.struct(F.lit("ABCD"[i]).alias("letter"), word(i).alias("text")) for i in range(4)))
    rows = rows.select("item_id", F.col("text").alias("question"), options.alias("options"), F.substring(F.lit("ABCD"), F.col("item_id").cast("int") % 4 + 1, F.lit(1)).alias("answer_idx"), F.get(F.split("text", " "), F.col("item_id").cast("int") % 4).alias("answer"), F.concat(F.lit("src"), F.col("item_id") % 3).alias("source"), F.concat(F.lit("run"), F.col("item_id") % 2).alias("run"))
    kind = F.col("item_id") % 5
    said = F.when(kind == 0, F.upper("answer")).when(kind == 1, F.concat("answer_idx", F.lit(". "), "answer")).when(kind == 2, F.lower("answer_idx")).when(kind == 3, F.lit("zzz")).otherwise(F.concat(F.lit("So the answer is "), "answer_idx"))
    return rows.select("*", convert.option_string(F.col("options")).alias("option_str"), said.alias("extracted_answer"))


_ITEMS = """w AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark), b AS (SELECT * FROM w WHERE len(w) >= 4),
items AS (SELECT item_id, substr('ABCD', item_id % 4 + 1, 1) AS answer_idx, w[item_id % 4 + 1] AS answer, 'src' || item_id % 3 AS source, 'run' || item_id % 2 AS run,
  'A. ' || w[1] || chr(10) || 'B. ' || w[2] || chr(10) || 'C. ' || w[3] || chr(10) || 'D. ' || w[4] AS option_str FROM b),
said AS (SELECT *, CASE item_id % 5 WHEN 0 THEN upper(answer) WHEN 1 THEN answer_idx || '. ' || answer WHEN 2 THEN lower(answer_idx) WHEN 3 THEN 'zzz' ELSE 'So the answer is ' || answer_idx END AS extracted FROM items),
judged AS (SELECT *, lower(extracted) = lower(answer) OR lower(extracted) = lower(answer_idx || '. ' || answer) OR (length(extracted) = 1 AND lower(extracted) = lower(answer_idx)) AS correct FROM said)"""
_BY_SOURCE = "acc AS (SELECT run, source, count(*) FILTER (correct) AS correct_count, count(*) AS total_count, CAST(count(*) FILTER (correct) AS DOUBLE) / count(*) AS accuracy FROM judged GROUP BY run, source)"


def judged(spark, sf_dir) -> DataFrame:
    exact = score.exact_match(F.col("extracted_answer"), F.col("answer_idx"), F.col("answer"))
    return eval_items(spark, sf_dir).withColumn("correct", exact)


@query(f"WITH {_ITEMS} SELECT item_id, option_str FROM items")
def option_string(spark, sf_dir):
    return eval_items(spark, sf_dir).select("item_id", "option_str")


@query(f"WITH {_ITEMS} SELECT item_id, chr(10) || array_to_string(list_filter(list_transform(string_split({_STRIP.format('option_str')}, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: contains(x, '. ')), chr(10)) AS rebuilt FROM items")
def option_parse_round_trip(spark, sf_dir):
    """The options read from their lines and written again; lines that are no option go, as where a text has a new line."""
    return eval_items(spark, sf_dir).select("item_id", F.concat(F.lit("\n"), convert.option_string(convert.parse_options(F.col("option_str")))).alias("rebuilt"))


@query(f"WITH {_ITEMS} SELECT item_id, correct FROM judged")
def exact_match_cascade(spark, sf_dir):
    return judged(spark, sf_dir).select("item_id", "correct")


@query(f"WITH {_ITEMS} SELECT source, count(*) FILTER (correct) AS correct_count, count(*) AS total_count, CAST(count(*) FILTER (correct) AS DOUBLE) / count(*) AS accuracy FROM judged GROUP BY source")
def accuracy_by_source(spark, sf_dir):
    return score.accuracy(judged(spark, sf_dir))


@query(f"WITH {_ITEMS}, {_BY_SOURCE} SELECT run, max(accuracy) FILTER (source = 'src0') AS src0, max(accuracy) FILTER (source = 'src1') AS src1, max(accuracy) FILTER (source = 'src2') AS src2 FROM acc GROUP BY run")
def accuracy_pivot(spark, sf_dir):
    return score.pivoted(score.accuracy(judged(spark, sf_dir), ("run", "source")))


@query(f"WITH {_ITEMS}, {_BY_SOURCE} SELECT run, round(avg(accuracy), 9) AS macro_accuracy FROM acc GROUP BY run")
def macro_average(spark, sf_dir):
    made = score.macro_average(score.accuracy(judged(spark, sf_dir), ("run", "source")))
    return made.select("run", F.round("macro_accuracy", 9).alias("macro_accuracy"))


@query(f"WITH {_ITEMS} SELECT item_id, CASE item_id % 3 WHEN 0 THEN answer WHEN 1 THEN answer_idx || '. ' || answer ELSE 'x' || answer END AS boxed FROM items")
def extract_boxed(spark, sf_dir):
    """Boxed answers plain, in \\text, and after an equals sign."""
    items, kind = eval_items(spark, sf_dir), F.col("item_id") % 3
    text = F.when(kind == 0, F.concat(F.lit("first \\boxed{no}, then \\boxed{"), "answer", F.lit("} done"))).when(kind == 1, F.concat(F.lit("so \\boxed{\\text{"), "answer_idx", F.lit(". "), "answer", F.lit("}}"))).otherwise(F.concat(F.lit("\\boxed{y = z = x"), "answer", F.lit("}")))
    return items.select("item_id", answers.boxed(text).alias("boxed"))


@query()
def match_choice_udf(spark, sf_dir):
    scored = score.scored(eval_items(spark, sf_dir))
    return scored.select("source", "extracted_answer", "matched_letter", "correct")


@query()
def fuzzy_choice_udf(spark, sf_dir):
    items = eval_items(spark, sf_dir)
    return items.select("item_id", answers.closest_option(F.concat("answer", F.lit("s")), F.col("option_str")).alias("letter"))


# -- tensors -----------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE s(j, radius, total, step) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
SELECT j + 1, r, total + lam, lam FROM (SELECT j, r, total, (sqrt(total * total + 2 * (r * r - radius * radius)) - total) / 2 AS lam FROM (SELECT *, 1.0 + j * 9.0 / 7 AS r FROM s WHERE j < 8)))
SELECT CAST(j AS BIGINT) AS ckpt, round(radius, 6) AS radius, round(step, 6) AS lam FROM s WHERE j > 0""")
def lambda_schedule(spark, sf_dir):
    rows = tensors.schedule_table(spark, tensors.lambda_schedule(8, 10.0, 1.0), "ckpt long, radius double, lam double")
    return rows.select("ckpt", F.round("radius", 6).alias("radius"), F.round("lam", 6).alias("lam"))


@query("SELECT CAST(i + 1 AS BIGINT) AS ckpt, round(sqrt(0.002::DOUBLE * 0.002 + i * (0.008::DOUBLE * 0.008 - 0.002::DOUBLE * 0.002) / 7), 9) AS l2 FROM range(8) t(i)")
def gaussian_l2_schedule(spark, sf_dir):
    return tensors.schedule_table(spark, tensors.gaussian_schedule(8, 2e-3, 8e-3), "ckpt long, l2 double").select("ckpt", F.round("l2", 9).alias("l2"))


def params(spark, sf_dir) -> DataFrame:
    """Embeddings as the parameters of a base model and a copy moved by multiples of a thousandth; those of label 0 are named as embeddings."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x"))
    base = rows.select(F.when(F.col("label") == 0, "embed_tokens").otherwise(F.concat(F.lit("layer"), "label")).alias("name"), (F.col("vec_id") * 64 + F.col("pos")).alias("idx"), F.col("x").cast("double").alias("value"))
    moved = base.select("name", "idx", (F.col("value") + F.col("idx") % 7 * F.lit(0.001)).alias("value"))
    return base.select(F.lit("base").alias("model"), "*").unionByName(moved.select(F.lit("moved").alias("model"), "*"))


_PARAMS = "e AS (SELECT CASE label WHEN 0 THEN 'embed_tokens' ELSE 'layer' || label END AS name, vec_id, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings), d AS (SELECT name, vec_id * 64 + pos AS idx, (CAST(x AS DOUBLE) + (vec_id * 64 + pos) % 7 * 0.001::DOUBLE) - CAST(x AS DOUBLE) AS d FROM e WHERE NOT contains(lower(name), 'embed'))"


@query(f"WITH {_PARAMS} SELECT round(sqrt(sum(d * d)), 6) AS actual_distance, count(*) AS num_params, round(sqrt(sum(d * d)) / sqrt(count(*)), 6) AS l2_per_sqrt_d, round(sqrt(sum(d * d)) / 2.0, 6) AS actual_over_target FROM d")
def tensor_distance(spark, sf_dir):
    made = tensors.distance(params(spark, sf_dir), "base", "moved", 2.0)
    return made.select(F.round("actual_distance", 6).alias("actual_distance"), "num_params", F.round("l2_per_sqrt_d", 6).alias("l2_per_sqrt_d"), F.round("actual_over_target", 6).alias("actual_over_target"))


@query(f"WITH {_PARAMS}, n AS (SELECT sqrt(sum(d * d)) AS norm FROM d) SELECT name, count(*) AS n, round(sum(d / norm), 6) AS total, round(max(norm), 6) AS norm FROM d, n GROUP BY name")
def unit_direction(spark, sf_dir):
    made = tensors.direction(params(spark, sf_dir), "base", "moved")
    return made.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.max("norm"), 6).alias("norm"))


@query("SELECT 'layer' || label AS name, 64 * count(*) AS n FROM embeddings WHERE label <> 0 GROUP BY label")
def param_filter(spark, sf_dir):
    own = params(spark, sf_dir).where(F.col("model") == "base").where(tensors.perturbed(F.col("name")))
    return own.groupBy("name").agg(F.count("*").alias("n"))


@query()
def gaussian_perturb(spark, sf_dir):
    base = params(spark, sf_dir).where(F.col("model") == "base")
    return tensors.gaussian_perturb(base, 0.002, 42)


@query(f"WITH {sql.tokens()}, l AS (SELECT unnest([1, 8]) AS ckpt, unnest([{sql.token_loss(1)}, {sql.token_loss(8)}]) AS x FROM tok), m AS (SELECT ckpt, CAST(sum(x) AS DOUBLE) / greatest(count(*), 1) AS loss, count(*) AS tokens FROM l GROUP BY ckpt), b AS (SELECT loss AS base FROM m WHERE ckpt = 1) SELECT CAST(ckpt AS INTEGER) AS ckpt, round(loss, 3) AS loss, tokens, round(loss - base, 3) AS delta, round(loss / base, 9) AS ratio FROM m, b")
def token_weighted_loss(spark, sf_dir):
    made = tensors.against_base(tensors.weighted_loss(losses.surrogate_losses(samples(spark, sf_dir), ENDS)), 1)
    return made.select("ckpt", F.round("loss", 3).alias("loss"), "tokens", F.round("delta", 3).alias("delta"), F.round("ratio", 9).alias("ratio"))
