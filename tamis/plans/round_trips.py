"""Queries that go through the readers and writers, and through operators of a single expression, with their SQL.

What they write is in the shared folder of spark.checkpoint.dir, under a new name each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions import answers
from tamis.operators import allocate, convert, losses, providers, sample, score, tensors
from tamis.operators.common import scratch_path, written
from tamis.plans import oracle as sql
from tamis.plans.catalog import _ITEMS, _RAW, BUDGET, CKPTS, ENDS, MAIN_WINDOW, eval_items, params, query, raw_records, read, samples, trajs
from tamis.plans.config import SelectionConfig
from tamis.plans.select import select
from tamis.schema import SAMPLES
from tamis.sources import io

# -- readers and writers -----------------------------------------------------------------------------------

_TURNS = "SELECT conv_id AS sample_id, count(*) AS n_turns, string_agg(role || '=' || text, '|' ORDER BY turn) AS said FROM conversations GROUP BY conv_id"


def chat_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = convert.conversations_of(read(spark, sf_dir, "conversations"))
    return chats.select(F.col("conv_id").alias("sample_id"), "conversations", F.col("conversations")[0]["content"].alias("prompt"), F.lit("chat").alias("domain"), F.lit("own").alias("source"))


def _said(df: DataFrame) -> DataFrame:
    return df.select("sample_id", F.size("conversations").cast("long").alias("n_turns"), F.array_join(F.transform("conversations", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("said"))


@query(_TURNS)
def samples_json_lines(spark, sf_dir):
    """Samples written as JSON lines, with blank lines between them, and read back by schema."""
    path = scratch_path(spark, "samples")
    lines = chat_samples(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    lines.unionByName(spark.range(5).select(F.lit("  ").alias("value"))).write.text(path)
    return _said(io.read_json_lines(spark, path, SAMPLES))


@query(_TURNS)
def samples_json_array(spark, sf_dir):
    """The same as one JSON array in one file."""
    path = scratch_path(spark, "samples") + ".json"
    rows = F.sort_array(F.collect_list(F.to_json(F.struct("*"))))
    whole = chat_samples(spark, sf_dir).agg(F.concat(F.lit("[\n"), F.array_join(rows, ",\n"), F.lit("\n]")).alias("value"))
    whole.coalesce(1).write.text(path)
    return _said(io.read_samples(spark, path, SAMPLES))


@query("SELECT doc_id AS sample_id, lang || ':' || source AS source FROM documents WHERE doc_id % 2 = 0")
def samples_of_split(spark, sf_dir):
    """A folder of two splits, of which one is read."""
    path = scratch_path(spark, "splits")
    rows = samples(spark, sf_dir).drop("text")
    for name, rest in (("train", 0), ("test", 1)):
        rows.where(F.col("sample_id") % 2 == rest).write.parquet(f"{path}/{name}.parquet")
    return io.read_samples(spark, f"{path}/train.parquet", split="part").select("sample_id", "source")


_PATH_SQL = f"WITH {sql.trajectories(CKPTS)}, l AS (SELECT sample_id, unnest([1, 4, 8]) AS ckpt, unnest([f0, f1, f2]) AS loss FROM traj) SELECT CAST(ckpt AS INTEGER) AS ckpt, count(*) AS n, CAST(sum(loss) AS BIGINT) AS total FROM l"


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ckpt").agg(F.count("*").alias("n"), F.sum("loss").cast("long").alias("total"))


@query(f"{_PATH_SQL} WHERE ckpt <> 4 GROUP BY ckpt")
def loss_table_files(spark, sf_dir):
    """Losses by window and checkpoint, written as folders, of which only those asked for are read."""
    path = scratch_path(spark, "losses")
    rows = losses.long_losses(trajs(spark, sf_dir, CKPTS), CKPTS)
    io.write_losses(rows.withColumn("window", F.lit("100")).unionByName(rows.withColumn("window", F.lit("full"))), path)
    return _totals(losses.require_checkpoints(io.read_losses(spark, path, "100"), "1,8"))


@query(f"{_PATH_SQL} WHERE ckpt <> 1 GROUP BY ckpt")
def checkpoint_folders(spark, sf_dir):
    """Losses in folders checkpoint-N, found by a pattern of their names."""
    path = scratch_path(spark, "checkpoints")
    rows = written(losses.long_losses(trajs(spark, sf_dir, CKPTS), CKPTS))
    for j in CKPTS:
        rows.where(F.col("ckpt") == j).drop("ckpt").write.parquet(f"{path}/checkpoint-{j}")
    found = io.matching_checkpoints(io.folder_names(spark, path), "checkpoint-[48]")
    return _totals(io.read_checkpoints(spark, path, "{" + ",".join(found) + "}"))


@query(f"WITH {sql.trajectories(CKPTS)} SELECT sample_id, f0, f1, f2 FROM traj")
def loss_matrix_dump(spark, sf_dir):
    """The losses of a selection, dumped and read again."""
    path = scratch_path(spark, "loss")
    io.write_loss_matrix(trajs(spark, sf_dir, CKPTS).select("sample_id", "traj"), path)
    return spark.read.parquet(path).select("sample_id", *(F.get("traj", F.lit(i)).alias(f"f{i}") for i in range(3)))


@query("SELECT doc_id AS sample_id, source, CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS place FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def selection_files(spark, sf_dir):
    """A subset's ids and its samples, written beside each other; the ids are in ascending order."""
    path = scratch_path(spark, "selection")
    pool = read(spark, sf_dir, "documents").selectExpr("doc_id AS sample_id", "source")
    chosen = read(spark, sf_dir, "labels").where("quality = 1").selectExpr("doc_id AS sample_id")
    io.write_subset(chosen, f"{path}/labeled_idx")
    io.write_selected(pool, chosen, f"{path}/labeled")
    ids = io.with_line_ids(spark.read.parquet(f"{path}/labeled_idx"), order="sample_id", name="place").withColumn("place", F.col("place") + 1)
    return spark.read.schema("sample_id long, source string").json(f"{path}/labeled").join(ids, "sample_id")


@query("SELECT source, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY source")
def cluster_files(spark, sf_dir):
    """Clusters by source, as folders."""
    path = scratch_path(spark, "clusters")
    io.write_clusters(read(spark, sf_dir, "documents").selectExpr("source", "doc_id AS sample_id", "cast(doc_id % 3 AS int) AS cluster_id"), path)
    return spark.read.schema("sample_id long, cluster_id int, source string").parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.sum("sample_id").alias("ids"))


@query("WITH n AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM n WHERE i % 7 = 0")
def raw_lines_of_subset(spark, sf_dir):
    """The lines of a file that a subset of places names, as they are."""
    path = scratch_path(spark, "raw")
    read(spark, sf_dir, "documents").orderBy("doc_id").select("doc_id", "text").write.json(f"{path}/all")
    places = spark.range(read(spark, sf_dir, "documents").count()).where("id % 7 = 0").withColumnRenamed("id", "sample_id")
    io.write_raw_subset(spark, f"{path}/all", places, f"{path}/some")
    return spark.read.schema("doc_id long, text string").json(f"{path}/some").select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query("WITH n AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id % 5, doc_id) - 1 AS i FROM documents WHERE doc_id % 5 < 1 + doc_id % 3) SELECT CAST(i AS BIGINT) AS place, CAST(doc_id AS BIGINT) AS doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM n WHERE i % 3 = 0")
def raw_lines_of_folder(spark, sf_dir):
    """The same for a folder of files of several sizes: lines are counted through the files in the order of their names."""
    path = scratch_path(spark, "folder")
    rows = read(spark, sf_dir, "documents").where("doc_id % 5 < 1 + doc_id % 3").select("doc_id", "text")
    for n in range(5):
        rows.where(F.col("doc_id") % 5 == n).orderBy("doc_id").write.json(f"{path}/file-{n}")
    numbered = io.read_numbered(spark, f"{path}/*", T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]), "place")
    places = spark.range(rows.count()).where("id % 3 = 0").withColumnRenamed("id", "place")
    return sample.apply_subset(numbered, places, "place").select("place", "doc_id", F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {_ITEMS}, w4 AS (SELECT *, string_split(text, ' ') AS x FROM benchmark WHERE len(string_split(text, ' ')) >= 4) SELECT 'src' || item_id % 3 AS source, text AS question, 'A=' || x[1] || '|B=' || x[2] AS options, substr('ABCD', item_id % 4 + 1, 1) AS answer_idx FROM w4 WHERE item_id % 3 <> 2")
def eval_suite_file(spark, sf_dir):
    """A suite by source in one JSON file, one of whose sources is skipped."""
    path = scratch_path(spark, "suite")
    items = eval_items(spark, sf_dir)
    options = F.map_from_entries(F.array(*(F.struct(F.lit("BA"[i]), F.col("options")[1 - i]["text"]) for i in range(2))))
    rows = items.select("source", F.struct("question", options.alias("options"), "answer_idx", "answer").alias("item"))
    suite = rows.groupBy("source").agg(F.collect_list("item").alias("items")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "items")))).alias("value"))
    suite.coalesce(1).write.text(path)
    found = io.read_eval_suite(spark, path, skipped=("src2",))
    return found.select("source", "question", F.array_join(F.transform("options", lambda o: F.concat(o["letter"], F.lit("="), o["text"])), "|").alias("options"), "answer_idx")


@query("SELECT 'run' || r AS run, max(CASE WHEN lang = 'de' THEN CAST(r AS DOUBLE) / 10 END) AS de, max(CASE WHEN lang = 'en' THEN CAST(r AS DOUBLE) / 10 END) AS en FROM (SELECT DISTINCT lang, doc_id % 4 AS r FROM documents WHERE lang IN ('de', 'en')) WHERE r <> 3 GROUP BY r")
def metrics_below_a_folder(spark, sf_dir):
    """Metrics files of several runs found below a folder, without the run that is finished, as a table with a column a source."""
    path = scratch_path(spark, "runs")
    rows = read(spark, sf_dir, "documents").where("lang IN ('de', 'en')").selectExpr("lang", "doc_id % 4 AS r").distinct()
    files = rows.groupBy("r").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("lang", F.struct((F.col("r") / 10).alias("accuracy")))))).alias("value"))
    for r in files.collect():  # four runs
        io.write_file(spark, f"{path}/run{r['r']}/metrics.json", r["value"])
    io.write_file(spark, f"{path}/run3/metrics.txt", "done")
    found = io.find_metrics(spark, path, finished=".txt")
    table = found.select("run", F.explode(score.accuracy_of_json(F.col("content"))).alias("source", "accuracy"))
    return score.pivoted(table).select("run", "de", "en")


@query("SELECT item_id, text FROM benchmark WHERE item_id % 2 = 0")
def files_with_another_digest(spark, sf_dir):
    """Files whose MD5 isn't the expected one: those of every other item are expected wrongly."""
    path = scratch_path(spark, "digests")
    rows = read(spark, sf_dir, "benchmark").select("item_id", "text")
    rows.where("item_id % 2 = 0").coalesce(1).write.json(path)
    faults = io.md5_faults(spark, path, "0" * 32).select("path").collect()  # the files of one small folder
    return spark.read.schema("item_id long, text string").json([f["path"] for f in faults if "part-" in f["path"]])


@query("SELECT vec_id AS sample_id, CAST(len(embedding) AS BIGINT) AS width, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings")
def embeddings_of_checkpoint(spark, sf_dir):
    """Embeddings in the folder of the one checkpoint named."""
    path = scratch_path(spark, "embeddings")
    read(spark, sf_dir, "embeddings").selectExpr("vec_id AS sample_id", "embedding").write.parquet(f"{path}/checkpoint-3")
    rows = io.read_embeddings(spark, path, "3")
    return rows.select("sample_id", F.size("embedding").cast("long").alias("width"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


_SETTINGS = {"base": "m", "start": "checkpoint-1", "seed": 42, "exclude_embeddings": True}


@query("""WITH RECURSIVE s(j, radius, total, step) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
SELECT j + 1, r, total + lam, lam FROM (SELECT j, r, total, (sqrt(total * total + 2 * (r * r - radius * radius)) - total) / 2 AS lam FROM (SELECT *, 1.0 + j * 9.0 / 7 AS r FROM s WHERE j < 8)))
SELECT 'm' AS base, 'checkpoint-1' AS start, CAST(42 AS BIGINT) AS seed, TRUE AS exclude_embeddings, CAST(8 AS BIGINT) AS num_checkpoints, round(sum(step), 6) AS steps, round(sum(radius), 6) AS radii FROM s WHERE j > 0""")
def perturbation_sidecar(spark, sf_dir):
    """A run's settings written beside its checkpoints, in the next version's folder."""
    root = scratch_path(spark, "run")
    schedule = tensors.lambda_schedule(8, 10.0, 1.0)
    for _ in range(2):
        path = io.version_folder(spark, root)
        io.write_sidecar(tensors.run_metadata(spark, [x[2] for x in schedule], [x[1] for x in schedule], **_SETTINGS), f"{path}/metadata")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    row = spark.read.json(f"{root}/version_1/metadata")
    return row.select("base", "start", "seed", "exclude_embeddings", "num_checkpoints", total("lambdas").alias("steps"), total("target_radii").alias("radii"))


@query("SELECT doc_id AS sample_id, CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS place, CAST(2 AS BIGINT) AS n_outputs FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def outputs_of_one_commit(spark, sf_dir):
    """A subset and its samples, which become visible together, beside their manifest; in a version of their own."""
    path = f"{io.claim_version(spark, scratch_path(spark, 'run'))}/selection"
    pool = read(spark, sf_dir, "documents").selectExpr("doc_id AS sample_id", "source")
    chosen = read(spark, sf_dir, "labels").where("quality = 1").selectExpr("doc_id AS sample_id")
    with io.staged(spark, path) as folder:
        io.write_subset(chosen, f"{folder}/ids")
        io.write_selected(pool, chosen, f"{folder}/samples")
    ids = io.with_line_ids(spark.read.parquet(f"{path}/ids"), name="place").withColumn("place", F.col("place") + 1)
    listed = spark.read.text(f"{path}/{io.MANIFEST}", wholetext=True).select(F.size(F.map_keys(F.from_json(F.get_json_object("value", "$.outputs"), "map<string,int>"))).cast("long").alias("n_outputs"))
    return spark.read.schema("sample_id long, source string").json(f"{path}/samples").select("sample_id").join(ids, "sample_id").crossJoin(F.broadcast(listed))


class WordLengths:
    """A stand-in for a model: a word's loss is its length times the checkpoint."""

    def __init__(self, checkpoint: int):
        self.checkpoint = checkpoint

    def losses(self, prompts: list[str], responses: list[str], most: int) -> list[list[float]]:
        return [[float(len(w) * self.checkpoint) for w in [w for w in r.split(" ") if w][: most if most >= 0 else None]] for r in responses]


@query("SELECT c AS ckpt, count(*) AS n_samples, CAST(sum(len(w)) AS BIGINT) AS n_tokens, CAST(sum(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) * c) AS BIGINT) AS total, CASE WHEN c = 4 THEN count(*) ELSE 0 END AS scored_again FROM (SELECT list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')[1:50] AS w FROM documents), (VALUES (1), (2), (4)) v(c) GROUP BY c")
def provider_losses_resumed(spark, sf_dir):
    """A loss table filled by a provider in two runs: the second adds a checkpoint and scores nothing else."""
    path = scratch_path(spark, "token-losses")
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("prompt"), F.col("text").alias("response"))
    providers.store_token_losses(rows, WordLengths, [1, 2], path, 50)
    again = providers.store_token_losses(rows, WordLengths, [1, 2, 4], path, 50)
    scored = F.coalesce(*(F.when(F.col("ckpt") == c, F.lit(n)) for c, n in again.items()), F.lit(0)).cast("long")
    total = F.aggregate("losses", F.lit(0.0), lambda t, x: t + x.cast("double"))
    sums = providers.stored_losses(spark, path).groupBy("ckpt").agg(F.count("*").alias("n_samples"), F.sum(F.size("losses")).alias("n_tokens"), F.sum(total).cast("long").alias("total"))
    return sums.select("*", scored.alias("scored_again"))


# -- strata, budgets and losses ----------------------------------------------------------------------------


@query("SELECT lang AS domain, string_agg(DISTINCT lang || ':' || source, ',' ORDER BY lang || ':' || source) AS sources FROM documents GROUP BY lang")
def domain_sources(spark, sf_dir):
    return allocate.sources_of_domains(samples(spark, sf_dir)).select("domain", F.array_join("sources", ",").alias("sources"))


@query("SELECT lang AS domain, lang AS source, CAST(CASE lang WHEN 'en' THEN 7 WHEN 'de' THEN 2 ELSE 1 END AS BIGINT) AS n_clusters, CAST(least(count(*), CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 1000000 ELSE 3 END) AS BIGINT) AS n_samples FROM documents GROUP BY lang")
def custom_source_budget(spark, sf_dir):
    """Budgets by named source, more than there is being all, and `other` for the rest."""
    sums = read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("domain"), F.col("lang").alias("source")).agg(F.count("*").alias("size"))
    made = allocate.custom_budget(sums, {"en": (7, 40), "de": (2, 1_000_000), "other": (1, 3)})
    return made.select("domain", "source", "n_clusters", "n_samples")


@query("WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT doc_id AS sample_id, lang AS source FROM documents JOIN s USING (lang) ORDER BY n, lang, doc_id LIMIT 150")
def hard_cap(spark, sf_dir):
    """The first rows of a pool, small sources first."""
    return sample.capped(read(spark, sf_dir, "documents").selectExpr("doc_id AS sample_id", "lang AS source"), 150)


_OPPOSITE = f"WITH {sql.trajectories([1, 8], MAIN_WINDOW)}, o AS (SELECT sample_id, f0 * 8 - f1 + (sample_id * 7919) % 1000003 AS a, f1 AS b FROM traj), r AS (SELECT sample_id, row_number() OVER (ORDER BY CAST(a + b AS DOUBLE) / 2, sample_id) - 1 AS i, count(*) OVER () AS n FROM o) SELECT sample_id FROM r WHERE i >= (n - {BUDGET}) // 2 AND i < (n - {BUDGET}) // 2 + {BUDGET}"


@query(_OPPOSITE.replace(f"(n - {BUDGET})", f"(n - least({BUDGET}, n))").replace(f"+ {BUDGET}", f"+ least({BUDGET}, n)"))
def select_middle_perplexity_of_mean(spark, sf_dir):
    """The middle by the mean over two checkpoints, whose orders differ."""
    rows = trajs(spark, sf_dir, [1, 8], window=MAIN_WINDOW)
    a, b = F.col("traj")[0], F.col("traj")[1]
    mixed = rows.withColumn("traj", F.array(a * 8 - b + (F.col("sample_id") * 7919) % 1000003, b))
    return select(mixed, SelectionConfig(method="middle_perplexity", size=BUDGET).merged({})).selected.select("sample_id")


@query()
def select_standardized_features(spark, sf_dir):
    """The standard selection by z-scores of the first and the last loss; tested against brute force."""
    config = SelectionConfig(method="learnability", size=BUDGET, n_clusters=5, cluster_features="standardized").merged({})
    return select(trajs(spark, sf_dir, CKPTS, keep=True, window=MAIN_WINDOW), config).clusters


@query()
def select_embedding_medoids(spark, sf_dir):
    """As many medoids of the embeddings as asked for, without any losses; tested against brute force."""
    pool = read(spark, sf_dir, "embeddings").selectExpr("vec_id AS sample_id", "'all' AS domain", "cast(label AS string) AS source", "embedding")
    return select(pool, SelectionConfig(method="embedding", size=20).merged({})).selected


@query(f"WITH RECURSIVE {sql.trajectories([1, 4, 8], MAIN_WINDOW)}, hard AS (SELECT doc_id, {', '.join(f'CAST(coalesce(sum({sql.token_loss(j)}) // count(*), 0) AS BIGINT) AS d{i}' for i, j in enumerate([1, 8]))} FROM tok WHERE t <= 100 GROUP BY doc_id), diff AS (SELECT d.doc_id AS sample_id, lang AS domain, lang || ':' || source AS source, coalesce(d0, 0) AS f0, coalesce(d1, 0) AS f1 FROM documents d LEFT JOIN hard USING (doc_id)),{sql.hierarchical('b', 'diff', 'f1', BUDGET)} SELECT domain, source, n_clusters, n_samples, n_rows FROM b")
def budgets_by_difficulty_losses(spark, sf_dir):
    """Main losses of 1,000 tokens to cluster by, difficulty losses of 100 for the budgets."""
    config = SelectionConfig(method="learnability", softmax=True, size=BUDGET).merged({})
    made = select(trajs(spark, sf_dir, CKPTS, keep=True, window=MAIN_WINDOW), config, trajs(spark, sf_dir, ENDS))
    return made.budget.select("domain", "source", "n_clusters", "n_samples", "n_rows")


@query("SELECT vec_id AS sample_id, CAST(len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0)) AS BIGINT) AS n_valid, round(coalesce(list_sum(list_transform(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0), lambda x: CAST(x AS DOUBLE))), 0.0), 5) AS total FROM embeddings")
def valid_token_losses(spark, sf_dir):
    """Embeddings read as token losses, those not above 0 having the label to be ignored."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("l"))
    valid = losses.valid_losses(F.col("l"), F.transform("l", lambda x: F.when(x > 0, 1).otherwise(-100)))
    return rows.select(F.col("vec_id").alias("sample_id"), F.size(valid).cast("long").alias("n_valid"), F.round(F.aggregate(valid, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT doc_id AS sample_id, array_to_string(list_filter([1, 4, 8], lambda c: (doc_id + c) % 5 = 0), ',') AS missing, CASE WHEN doc_id % 7 = 0 AND (doc_id + 4) % 5 <> 0 THEN '4' ELSE '' END AS repeated FROM documents WHERE (doc_id + 1) % 5 = 0 OR (doc_id + 4) % 5 = 0 OR (doc_id + 8) % 5 = 0 OR doc_id % 7 = 0")
def incomplete_trajectories(spark, sf_dir):
    """Samples that don't have each checkpoint's loss once; trajectories of them would be an error."""
    cells = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.explode(F.array(*(F.lit(c) for c in CKPTS))).alias("ckpt")).withColumn("loss", F.col("ckpt").cast("double"))
    there = cells.where((F.col("sample_id") + F.col("ckpt")) % 5 != 0)
    twice = there.unionByName(there.where("ckpt = 4 AND sample_id % 7 = 0"))
    found = losses.incomplete(twice, CKPTS)
    return found.select("sample_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("missing", "repeated"))).where("missing <> '' OR repeated <> ''")


@query("SELECT vec_id AS sample_id, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS loss FROM embeddings")
def nan_losses(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, float("nan")).otherwise(F.col("embedding")[0].cast("double")).alias("x"))
    return rows.select(F.col("vec_id").alias("sample_id"), F.round(losses.nan_to_zero(F.col("x")), 6).alias("loss"))


@query("SELECT doc_id AS sample_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL AND length(text) % 5 <> doc_id % 5")
def loss_length_faults(spark, sf_dir):
    """Samples whose number of losses isn't the expected one."""
    rows = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.length("text").cast("long").alias("n"), F.array_repeat(F.lit(1.0), (F.length("text") % 5).cast("int")).alias("losses"), (F.col("doc_id") % 5).cast("int").alias("expected"))
    return losses.length_faults(rows, "expected").select(F.col("doc_id").alias("sample_id"), "n")


@query("SELECT CAST(i AS BIGINT) AS worker, CAST(i * (n // 8) + least(i, n % 8) AS BIGINT) AS first, CAST((i + 1) * (n // 8) + least(i + 1, n % 8) AS BIGINT) AS stop FROM range(8) t(i), (SELECT count(*) AS n FROM documents)")
def work_split(spark, sf_dir):
    runs = allocate.contiguous_split(read(spark, sf_dir, "documents").count(), 8)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(runs)], "worker long, first long, stop long")


# -- conversations and answers -----------------------------------------------------------------------------


@query(f"WITH {_RAW} SELECT conv_id, coalesce(prompt, reasoning) AS prompt, 'user=' || prompt || '|assistant=' || answer AS turns FROM raw WHERE conv_id % 3 <> 0")
def math_records(spark, sf_dir):
    """Records with turns of from and value, of which those marked correct stay."""
    turn = lambda who, c: F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"), F.lit(who).alias("from"), F.col(c).alias("value"))
    raw = raw_records(spark, sf_dir).select("conv_id", F.lit(None).cast("string").alias("prompt"), F.col("prompt").alias("problem"), F.array(turn("human", "prompt"), turn("gpt", "answer")).alias("conversations"), (F.col("conv_id") % 3 != 0).alias("correct"))
    return convert.math_sample(raw).select("conv_id", "prompt", F.array_join(F.transform("conversations", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("turns"))


_CHAT = "'<|im_start|>system' || chr(10) || 'be brief<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"


@query(f"WITH {_RAW} SELECT conv_id, kind, CASE kind WHEN 'text' THEN '' ELSE {_CHAT} END AS prompt_text, CASE kind WHEN 'text' THEN answer ELSE {_CHAT} || answer || '<|im_end|>' END AS full_text FROM raw, (VALUES ('turns'), ('text'), ('completion'), ('reasoning')) k(kind)")
def training_texts(spark, sf_dir):
    """The four shapes of records that texts to train on are made from."""
    raw = raw_records(spark, sf_dir)
    turn = lambda who, c: convert.turn(who, F.col(c))
    shapes = {
        "turns": raw.select("conv_id", F.array(turn("user", "prompt"), turn("assistant", "answer")).alias("conversations")),
        "text": raw.select("conv_id", F.col("answer").alias("text")),
        "completion": raw.select("conv_id", F.array(convert.turn("system", F.lit("be brief")), turn("user", "prompt")).alias("prompt"), F.array(turn("assistant", "answer")).alias("completion")),
        "reasoning": raw.select("conv_id", "prompt", F.col("answer").alias("reasoning")),
    }
    made = [convert.training_texts(df, "be brief").select("conv_id", F.lit(kind).alias("kind"), "prompt_text", "full_text") for kind, df in shapes.items()]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


@query(f"WITH {_ITEMS} SELECT item_id, 'Choose.' || chr(10) || b.text || chr(10) || option_str || chr(10) || 'Answer:' AS prompt FROM items JOIN b USING (item_id)")
def question_prompts(spark, sf_dir):
    items = eval_items(spark, sf_dir)
    return items.select("item_id", convert.question_prompt(F.col("question"), F.col("options"), "Choose.", "Answer:").alias("prompt"))


@query(f"WITH {_ITEMS} SELECT item_id, answer AS stated, answer_idx AS boxed FROM items")
def strict_choices(spark, sf_dir):
    """Answers whose letter is stated outright, and boxed ones: the strict parts of matching, which SQL can express."""
    items = eval_items(spark, sf_dir)
    stated = answers.strict_choice(F.concat(F.lit("One thinks A, but the answer is "), "answer_idx"), F.col("option_str"))
    texts = F.aggregate("options", F.lit(""), lambda a, o: F.when(o["letter"] == F.col("__l"), o["text"]).otherwise(a))
    return items.withColumn("__l", stated).select("item_id", texts.alias("stated"), answers.boxed(F.concat(F.lit("so \\boxed{"), "answer_idx", F.lit("}"))).alias("boxed"))


_SHAPES = """CASE item_id % 6 WHEN 0 THEN '我选' || answer_idx || '项' WHEN 1 THEN 'Not A or B; (' || answer_idx || ').' WHEN 2 THEN 'A patient had it: "' || answer_idx || '"' WHEN 3 THEN 'answer is A, no: the answer is  ' || answer_idx
  WHEN 4 THEN 'it is A' || chr(10) || '## Final Response' || chr(10) || chr(10) || 'it is ' || answer_idx ELSE '*' || answer_idx || '*' END"""


@query(f"WITH {_ITEMS} SELECT item_id, {_SHAPES} AS said, answer_idx AS letter, '\\frac{{' || answer || '}}{{{{' || item_id || '}}}}' AS nested FROM items")
def delimited_choices(spark, sf_dir):
    """Letters between delimiters of several kinds, after the final mark, and boxes in boxes; no Python."""
    items = eval_items(spark, sf_dir).withColumn("said", F.expr(_SHAPES.replace("chr(10)", "char(10)")))
    box = F.concat(F.lit("\\boxed{no} so \\boxed{\\text{\\frac{"), "answer", F.lit("}{{"), F.col("item_id").cast("string"), F.lit("}}}} and } {"))
    return items.select("item_id", "said", answers.strict_choice(F.col("said"), F.col("option_str")).alias("letter"), answers.boxed(box).alias("nested"))


# -- tensors -----------------------------------------------------------------------------------------------


@query("SELECT CASE label WHEN 0 THEN 'embed_tokens' ELSE 'layer' || label END AS name, CAST(64 * count(*) AS BIGINT) AS n, label <> 0 AS moved, TRUE AS centred, label <> 0 AS of_unit_deviation FROM embeddings GROUP BY label")
def gaussian_noise_statistics(spark, sf_dir):
    """Noise by tensor in units of its deviation: mean 0 and deviation 1 within four standard errors, none on embeddings."""
    base = params(spark, sf_dir).where(F.col("model") == "base")
    noisy = tensors.gaussian_perturb(base, 0.5, 42).select("name", "idx", F.col("value").alias("after"))
    step = ((F.col("after") - F.col("value")) / 0.5).alias("x")
    sums = base.join(noisy, ["name", "idx"]).select("name", step).groupBy("name").agg(F.count("*").alias("n"), F.stddev_pop("x").alias("d"), F.avg("x").alias("m"))
    return sums.select("name", "n", (F.col("d") > 0).alias("moved"), (F.abs("m") <= 4 / F.sqrt("n")).alias("centred"), (F.abs(F.col("d") - 1) <= 4 / F.sqrt(2 * F.col("n"))).alias("of_unit_deviation"))


@query("WITH d AS (SELECT CASE label WHEN 0 THEN 'embed_tokens' ELSE 'layer' || label END AS name, 64 * count(*) AS n FROM embeddings GROUP BY label) SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN name <> 'embed_tokens' THEN n END) AS BIGINT) - (SELECT count(*) FROM (SELECT vec_id, unnest(range(64)) AS pos FROM embeddings WHERE label <> 0) WHERE (vec_id * 64 + pos) % 7 = 0) AS moved, 1.4::DOUBLE AS step FROM d")
def directional_steps(spark, sf_dir):
    """A step along the unit direction between two models: its size with noise of deviation 1 is sqrt(2) times the radius.

    An element counts as moved however little: in a large model noise near -1 takes the step of some below any bound.
    """
    both = params(spark, sf_dir)
    base = both.where(F.col("model") == "base")
    unit = tensors.direction(both, "base", "moved")
    after = tensors.directional_step(base, unit, 1.0, 42).select("name", "idx", F.col("value").alias("after"))
    moved = base.join(after, ["name", "idx"]).select((F.col("after") - F.col("value")).alias("x"))
    return moved.agg(F.count("*").alias("n"), F.count(F.when(F.col("x") != 0, 1)).alias("moved"), F.round(F.sqrt(F.sum(F.col("x") ** 2)), 1).alias("step"))


#: Elements of a block of the embeddings that are read as tensors.
_WIDTH = 64


@query("WITH e AS (SELECT CASE label WHEN 0 THEN 'embed_tokens' ELSE 'layer' || label END AS name, vec_id, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings), d AS (SELECT c, (CAST(x AS DOUBLE) + (vec_id * 64 + pos) % 7 * 0.001::DOUBLE * c) - CAST(x AS DOUBLE) AS d FROM e, range(1, 4) t(c) WHERE NOT contains(lower(name), 'embed')) SELECT 'checkpoint-' || c AS model, round(sqrt(sum(d * d)), 6) AS actual_distance, count(*) AS num_params, round(sqrt(sum(d * d)) / sqrt(count(*)), 6) AS l2_per_sqrt_d, round(sqrt(sum(d * d)) / c, 6) AS actual_over_target FROM d GROUP BY c")
def tensor_distances_of_checkpoints(spark, sf_dir):
    """The distances of three checkpoints from their base, in one pass over blocks."""
    base = params(spark, sf_dir).where(F.col("model") == "base")
    moved = base.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(F.concat(F.lit("checkpoint-"), "c").alias("model"), "name", "idx", (F.col("value") + F.col("idx") % 7 * F.lit(0.001) * F.col("c")).alias("value"))
    blocks = tensors.blocked(base.unionByName(moved), _WIDTH)
    made = tensors.distances(blocks, "base", {f"checkpoint-{c}": float(c) for c in (1, 2, 3)})
    return made.select("model", "num_params", *(F.round(c, 6).alias(c) for c in ("actual_distance", "l2_per_sqrt_d", "actual_over_target")))


@query("SELECT 'checkpoint-' || c AS model, (SELECT 64 * count(*) FROM embeddings WHERE label <> 0) AS num_params, TRUE AS at_radius FROM range(1, 5) t(c)")
def directional_checkpoints_in_blocks(spark, sf_dir):
    """Four checkpoints along a direction, each from the base: their distances are within a tenth of the schedule's radii."""
    blocks = written(tensors.blocked(params(spark, sf_dir), _WIDTH))
    base, schedule = blocks.where(F.col("model") == "base"), tensors.lambda_schedule(4, 8.0, 2.0)
    made = tensors.directional_checkpoints(base, tensors.direction_blocks(blocks, "base", "moved"), schedule, 42, _WIDTH)
    found = tensors.distances(base.unionByName(made), "base", {f"checkpoint-{j}": radius for j, radius, _ in schedule})
    return found.select("model", "num_params", F.col("actual_over_target").between(0.9, 1.1).alias("at_radius"))


@query()
def tensor_seeds(spark, sf_dir):
    """The seed of each tensor's noise; BLAKE2b has no SQL, tests compare it with hashlib."""
    return tensors.with_tensor_seeds(params(spark, sf_dir).where(F.col("model") == "base"), 42, 3).select("name", "tensor_seed").distinct()

