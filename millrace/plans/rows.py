"""Queries: batch verbs, samples, groups, metrics, sources."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import advantage, balance, batch, dispatch, groups, sampling
from millrace.plans import config
from millrace.plans.fixtures import RESP, SEQ, TOK, TRAJ, query, responses, sequences, tokens, trajectories
from millrace.sources import files, json_array
from millrace.sources.tables import shared_folder, table
from millrace.streaming import carry

N = "(SELECT count(*) FROM traj)"


@query(f"WITH {TRAJ} SELECT row_id, uid FROM traj")
def proto_select(spark: SparkSession, sf: str) -> DataFrame:
    return batch.select(trajectories(spark, sf), ["row_id", "uid"])


@query(f"WITH {TRAJ} SELECT row_id, reward, score FROM traj")
def proto_pop(spark, sf):
    return batch.pop(trajectories(spark, sf), ["uid", "source"])[1]


@query(f"WITH {TRAJ} SELECT row_id AS k, uid AS prompt_id, reward, score, source FROM traj")
def proto_rename(spark, sf):
    return batch.rename(trajectories(spark, sf), ["row_id", "uid"], ["k", "prompt_id"])


@query(f"WITH {TRAJ} SELECT row_id, reward FROM traj WHERE row_id >= {N} - 100 AND (row_id - ({N} - 100)) % 7 = 0")
def proto_slice_step(spark, sf):
    return batch.slice_rows(trajectories(spark, sf), -100, None, 7).select("row_id", "reward")


@query(f"WITH {TRAJ}, w AS (SELECT CAST(n_nationkey AS BIGINT) AS position, CAST(n_nationkey * 37 % 13 AS BIGINT) AS k FROM nation) SELECT position AS row_id, uid, reward FROM w JOIN traj ON row_id = k")
def proto_index_list(spark, sf):
    wanted = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("position"), (F.col("n_nationkey") * 37 % 13).cast("long").alias("row_id"))
    return batch.take(trajectories(spark, sf).select("row_id", "uid", "reward"), wanted)


@query(f"WITH {TRAJ} SELECT row_id, score FROM traj WHERE reward = 1")
def proto_bool_mask(spark, sf):
    return batch.mask(trajectories(spark, sf), F.col("reward") == 1).select("row_id", "score")


@query(f"WITH {TRAJ} SELECT * FROM traj WHERE row_id = 17")
def proto_item(spark, sf):
    return batch.item(trajectories(spark, sf), 17)


def permutation(spark, sf):
    n = table(spark, sf, "orders").count()
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), ((F.col("o_orderkey") * 7 + 3) % n).alias("row_id"))


@query(f"WITH {TRAJ} SELECT p.row_id AS row_id, t.uid AS uid FROM traj p JOIN traj t ON t.row_id = (p.row_id * 7 + 3) % {N}")
def proto_reorder(spark, sf):
    return batch.reorder(trajectories(spark, sf).select("row_id", "uid"), permutation(spark, sf))


@query(f"WITH {TRAJ} SELECT (row_id * 7 + 3) % {N} AS position, row_id AS value FROM traj")
def inverse_permutation(spark, sf):
    return batch.inverse_permutation(permutation(spark, sf).withColumnRenamed("row_id", "value"))


@query(f"WITH {TRAJ} SELECT row_id, reward FROM traj UNION ALL SELECT row_id, reward FROM traj")
def proto_concat(spark, sf):
    t = trajectories(spark, sf).select("row_id", "reward")
    return batch.concat(t, t)


@query(f"WITH {TRAJ} SELECT row_id, uid, reward, score FROM traj")
def proto_union_checked(spark, sf):
    t = trajectories(spark, sf)
    return batch.union_columns(t.select("row_id", "uid", "reward"), t.select("row_id", "reward", "score"))


@query("WITH x AS (SELECT l_orderkey AS p, count(*) AS k, (SELECT count(*) FROM lineitem) AS n FROM lineitem GROUP BY 1) SELECT max(n) AS n, CAST(sum(k - 1) AS BIGINT) AS repeated, CAST(sum(CASE WHEN p < 0 OR p >= n THEN k ELSE 0 END) AS BIGINT) AS outside FROM x UNION ALL SELECT count(*), 0, 0 FROM orders")
def consistency_check(spark, sf):
    """Faults of order numbers taken as positions of line items, and of positions that are made (none, and the check passes)."""
    made = batch.numbered(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", row="place")
    batch.check_consistent(made, "place")
    return batch.position_faults(table(spark, sf, "lineitem"), "l_orderkey").unionByName(batch.position_faults(made, "place"))


@query(f"WITH {TRAJ} SELECT 'reward' AS \"column\", 8 * count(*) AS bytes FROM traj UNION ALL SELECT 'source', CAST(sum(octet_length(encode(source))) AS BIGINT) FROM traj UNION ALL SELECT 'uid', 8 * count(*) FROM traj")
def size_report(spark, sf):
    return batch.column_bytes(trajectories(spark, sf).select("reward", "source", "uid"))


def parts(sql: str) -> str:
    return f"WITH {TRAJ} SELECT row_id, CAST({sql} AS BIGINT) AS part FROM traj"


@query(parts(f"floor(row_id / ceil({N} / 7.0))"))
def proto_chunk_ceil(spark, sf):
    return batch.chunk(trajectories(spark, sf), 7).select("row_id", "part")


@query(f"WITH {TRAJ} SELECT row_id, ntile(7) OVER (ORDER BY row_id) - 1 AS part FROM traj")
def sequential_split(spark, sf):
    return batch.chunk(trajectories(spark, sf), 7, "even").select("row_id", "part")


@query(parts("row_id // 64"))
def fixed_split(spark, sf):
    return batch.fixed_chunks(trajectories(spark, sf), 64).select("row_id", "part")


@query(f"WITH {TRAJ} SELECT row_id, uid FROM traj WHERE floor(row_id / ceil({N} / 11.0)) = 3")
def ceil_chunk(spark, sf):
    return batch.kth_chunk(trajectories(spark, sf).select("row_id", "uid"), 3, 11)


@query(f"WITH {TRAJ} SELECT row_id * 3 + i AS row_id, uid FROM traj, range(3) r(i)")
def repeat_interleave(spark, sf):
    return batch.repeat(trajectories(spark, sf).select("row_id", "uid"), 3)


@query(f"WITH {TRAJ} SELECT i * {N} + row_id AS row_id, uid FROM traj, range(3) r(i)")
def repeat_tile(spark, sf):
    return batch.repeat(trajectories(spark, sf).select("row_id", "uid"), 3, interleave=False)


@query(f"WITH {TRAJ} SELECT row_id // 4 AS row_id, list(uid ORDER BY row_id) AS uid, list(reward ORDER BY row_id) AS reward FROM traj GROUP BY 1")
def fold_rows(spark, sf):
    return batch.fold(trajectories(spark, sf).select("row_id", "uid", "reward"), 4)


@query(f"WITH {TRAJ} SELECT row_id, uid, reward FROM traj")
def unfold_rows(spark, sf):
    return batch.unfold(batch.fold(trajectories(spark, sf).select("row_id", "uid", "reward"), 4), 4)


@query(f"WITH {TRAJ} SELECT row_id, uid FROM traj UNION ALL SELECT row_id + {N}, uid FROM traj WHERE row_id < (64 - {N} % 64) % 64")
def pad_to_divisor(spark, sf):
    return batch.pad_to_divisor(trajectories(spark, sf).select("row_id", "uid"), 64)[0]


@query(f"WITH {TRAJ} SELECT row_id, uid FROM traj WHERE row_id < {N} - 2 * 3")
def unpad(spark, sf):
    return batch.unpad(trajectories(spark, sf).select("row_id", "uid"), 2, 3)


@query(f"WITH {TRAJ} SELECT row_id, i AS epoch, row_id // 100 AS batch FROM traj, range(2) r(i)")
def minibatch_epochs(spark, sf):
    return batch.minibatches(trajectories(spark, sf), 100, 2).select("row_id", F.col("epoch").cast("long").alias("epoch"), "batch")


@query(f"WITH {TRAJ} SELECT row_id, i AS epoch, (row_number() OVER (PARTITION BY i ORDER BY md5(concat('9:', i, ':', row_id))) - 1) // 100 AS batch FROM traj, range(2) r(i)")
def minibatch_shuffled(spark, sf):
    return batch.minibatches(trajectories(spark, sf), 100, 2, seed=9).select("row_id", F.col("epoch").cast("long").alias("epoch"), "batch")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id FROM orders")
def row_numbers(spark, sf):
    return batch.numbered(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "row_id")


@query("SELECT count(*) AS n FROM orders")
def proto_length(spark, sf):
    return spark.createDataFrame([(batch.length(table(spark, sf, "orders")),)], "n long")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclude_done(spark, sf):
    return batch.exclude(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


@query(f"WITH {SEQ} SELECT row_id, list_sort(list_distinct(list_filter(list_transform(ids, lambda x: concat('', x % 4)), lambda x: x <> '0'))) AS answers FROM seq")
def distinct_answers(spark, sf):
    words = F.transform("ids", lambda x: F.when(x % 4 == 0, "").otherwise((x % 4).cast("string")))
    return sequences(spark, sf).select("row_id", F.array_sort(batch.distinct_answers(words)).alias("answers"))


@query(f"WITH {SEQ} SELECT row_id, list_transform(range(0, len(vs)), lambda i: struct_pack(v := vs[i + 1], r := rs[i + 1])) AS pairs FROM seq")
def zip_lists(spark, sf):
    return sequences(spark, sf).select("row_id", batch.zip_lists(F.col("vs").alias("v"), F.col("rs").alias("r")).alias("pairs"))


# ---- samples --------------------------------------------------------------------------------------------------------

DICE = "md5(concat(row_id, ':42'))"


@query(f"WITH {TRAJ}, k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY {DICE}, row_id) AS k FROM traj) SELECT uid, row_id, reward FROM k WHERE k = 1")
def pick_one_per_query(spark, sf):
    return sampling.one_per_group(trajectories(spark, sf).select("uid", "row_id", "reward"), "uid", "row_id")


@query(f"WITH {TRAJ}, k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY 1 - reward, {DICE}, row_id) AS k FROM traj) SELECT uid, row_id, reward FROM k WHERE k = 1")
def pick_kept_else_any(spark, sf):
    return sampling.kept_else_any(trajectories(spark, sf).select("uid", "row_id", "reward"), "uid", "reward", "row_id")


@query(f"WITH {TRAJ}, k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY CASE WHEN score > 400000 THEN 0 WHEN reward = 1 THEN 1 ELSE 2 END, {DICE}, row_id) AS k FROM traj) SELECT uid, row_id, score FROM k WHERE k = 1")
def pick_first_available(spark, sf):
    t = trajectories(spark, sf).select("uid", "row_id", "score", "reward")
    return sampling.first_available(t, "uid", "row_id", F.col("score") > 400000, F.col("reward") == 1).select("uid", "row_id", "score")


@query(f"WITH {TRAJ}, s AS (SELECT *, row_id % 9 AS s FROM traj), k AS (SELECT *, row_number() OVER (PARTITION BY least(s, 7) ORDER BY {DICE}, row_id) AS k, count(*) OVER (PARTITION BY least(s, 7)) AS n FROM s) SELECT row_id, s FROM k WHERE least(s, 7) <> 1 OR k <= floor(n * 0.5)")
def stratified_downsample(spark, sf):
    t = trajectories(spark, sf).select("row_id", (F.col("row_id") % 9).alias("s"))
    return sampling.stratified(t, F.least(F.col("s"), F.lit(7)), {1: 0.5}, "row_id")


@query(f"WITH {TRAJ} SELECT row_id, uid FROM traj ORDER BY {DICE}, row_id LIMIT 100")
def cap_rows(spark, sf):
    return sampling.at_most(trajectories(spark, sf).select("row_id", "uid"), 100, "row_id")


@query("SELECT doc_id AS row_id, source FROM documents ORDER BY md5(concat(doc_id, ':42')), doc_id LIMIT 20")
def val_table_sample(spark, sf):
    return sampling.sorted_sample(table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "source"), "source", "row_id", 20)


@query(f"WITH {TRAJ}, k AS (SELECT row_id, row_number() OVER (ORDER BY md5(concat(row_id, ':1')), row_id) - 1 AS position FROM traj) SELECT row_id, position, position // 64 AS batch FROM k WHERE position < {N} // 64 * 64")
def shuffled_epoch(spark, sf):
    return sampling.shuffled_epoch(trajectories(spark, sf).select("row_id"), "row_id", 64)


@query(f"WITH {TRAJ}, k AS (SELECT row_id, row_number() OVER (ORDER BY md5(concat(row_id, ':1')), row_id) - 1 AS position FROM traj) SELECT row_id, CAST(position % 7 AS INT) AS shard FROM k WHERE position < {N} // 7 * 7")
def distributed_sampler(spark, sf):
    return sampling.sharded(trajectories(spark, sf).select("row_id"), "row_id", 7).select("row_id", "shard")


@query("SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= list_reverse_sort(embedding)[5] THEN CAST(x AS DOUBLE) END) AS kept FROM embeddings")
def topk_mask(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", sampling.top_k_mask(F.col("embedding").cast("array<double>"), 5).alias("kept"))


# ---- groups and metrics ---------------------------------------------------------------------------------------------


@query(f"WITH {TRAJ}, g AS (SELECT uid FROM traj GROUP BY uid HAVING stddev_pop(reward) > 0 OR count(*) = 1) SELECT row_id, uid, reward FROM traj WHERE uid IN (SELECT uid FROM g)")
def group_variance_filter(spark, sf):
    return groups.group_variance(trajectories(spark, sf).select("row_id", "uid", "reward"), "uid", "reward")


@query(f"WITH {TRAJ} SELECT row_id, uid, CASE WHEN sum(reward) OVER w >= ceil(count(*) OVER w * 0.5) THEN reward ELSE 0 END AS kept FROM traj WINDOW w AS (PARTITION BY uid)")
def keep_flag_groups(spark, sf):
    return groups.keep_flags(trajectories(spark, sf), "uid", "reward", 0.5).select("row_id", "uid", "kept")


@query(f"WITH {TRAJ} SELECT row_id, uid FROM traj WHERE reward = 1")
def code_filter(spark, sf):
    return batch.mask(trajectories(spark, sf), F.col("reward") == 1).select("row_id", "uid")


@query(f"WITH {TRAJ}, g AS (SELECT uid, stddev_pop(reward) AS sd, sum(reward) AS s FROM traj GROUP BY uid) SELECT round(avg(CASE WHEN sd = 0 AND s > 0 THEN 1.0 ELSE 0 END), 9) AS all_true, round(avg(CASE WHEN sd = 0 AND s = 0 THEN 1.0 ELSE 0 END), 9) AS all_false, round(avg(CASE WHEN sd > 0 THEN 1.0 ELSE 0 END), 9) AS mixed FROM g")
def group_outcome_ratio(spark, sf):
    d = groups.outcome_ratios(trajectories(spark, sf), "uid", "reward")
    return d.select(*[F.round(c, 9).alias(c) for c in d.columns])


PREFIXES = ["1-URG", "2-HI", "MEDIUM", "absent", "5-"]


@query(f"""WITH {TRAJ}, p(prefix, k) AS (VALUES ('1-URG', 0), ('2-HI', 1), ('MEDIUM', 2), ('absent', 3), ('5-', 4)),
h AS (SELECT traj.*, (SELECT min(k) FROM p WHERE contains(source, prefix)) AS k FROM traj)
SELECT prefix, coalesce(sum(reward), 0.0::DOUBLE) AS true_num, count(reward) AS total_num, coalesce(sum(reward), 0.0::DOUBLE) / greatest(count(reward), 1) AS accuracy FROM p LEFT JOIN h USING (k) GROUP BY prefix""")
def prefix_accuracy(spark, sf):
    return groups.prefix_accuracy(trajectories(spark, sf), "source", "reward", PREFIXES)


@query(f"WITH {TRAJ}, g AS (SELECT source, avg(reward) AS mean FROM traj GROUP BY source) SELECT source, round(mean, 9) AS mean FROM g UNION ALL SELECT 'all', round(avg(mean), 9) FROM g")
def macro_accuracy(spark, sf):
    return groups.macro_mean(trajectories(spark, sf), "source", "reward").select("source", F.round("mean", 9).alias("mean"))


@query("SELECT source, avg(n_chars) AS mean_length, sum(CASE WHEN quality = 1 THEN n_chars ELSE 0 END) / nullif(CAST(sum(quality) AS DOUBLE), 0) AS right_length FROM documents JOIN labels USING (doc_id) GROUP BY source")
def correct_length(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id")
    return groups.source_lengths(d, "source", "n_chars", "quality")


@query(f"WITH {TRAJ}, g AS (SELECT uid, max(reward) AS best FROM traj GROUP BY uid) SELECT round(avg(CASE WHEN best = 1 THEN 1.0 ELSE 0 END), 9) AS pass_at_k FROM g")
def pass_at_k(spark, sf):
    lists = groups.group_lists(trajectories(spark, sf), "uid", "reward")
    return groups.pass_at_k(lists, "values").select(F.round("pass_at_k", 9).alias("pass_at_k"))


@query("SELECT least(c, 7) AS calls, count(*) AS n FROM (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) GROUP BY 1")
def call_histogram(spark, sf):
    return groups.call_histogram(table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c")), "c")


@query("""WITH b(bucket, lo, hi) AS (VALUES ('<2000', 0, 2000), ('2000~5000', 2000, 5000), ('5000~8000', 5000, 8000), ('8000~11000', 8000, 11000), ('11000~14000', 11000, 14000), ('>14000', 14000, 1000000000))
SELECT bucket, count(doc_id) AS n FROM b LEFT JOIN documents ON n_chars >= lo AND n_chars < hi GROUP BY bucket""")
def length_histogram(spark, sf):
    return groups.length_histogram(table(spark, sf, "documents"), "n_chars")


@query("SELECT count(DISTINCT o_custkey) AS groups FROM orders")
def distinct_groups(spark, sf):
    return groups.distinct_groups(table(spark, sf, "orders"), "o_custkey")


@query(f"WITH {TRAJ} SELECT uid, list(reward ORDER BY reward) AS \"values\" FROM traj GROUP BY uid")
def group_collect(spark, sf):
    return groups.group_lists(trajectories(spark, sf), "uid", "reward")


@query("SELECT event_type AS metric, round(avg(value), 9) AS mean FROM events GROUP BY 1")
def reduce_metrics(spark, sf):
    return groups.metric_means(table(spark, sf, "events"), "event_type", "value").select("metric", F.round("mean", 9).alias("mean"))


@query("SELECT event_type AS metric, list(value ORDER BY event_id) AS \"values\" FROM events GROUP BY 1")
def append_metrics(spark, sf):
    return groups.metric_lists(table(spark, sf, "events"), "event_type", "value", "event_id")


@query("WITH x AS (SELECT event_type AS metric, event_id, value, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS segment FROM events) SELECT metric, segment, list(value ORDER BY event_id) AS \"values\" FROM x GROUP BY 1, 2")
def metric_segments(spark, sf):
    return groups.metric_segments(table(spark, sf, "events"), "event_type", "value", "event_id", 100)


def _stats(c: str, src: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}/{name}' AS metric, CAST(round({f}, 7) AS DOUBLE) AS value FROM {src}" for name, f in (("mean", f"avg({c})"), ("max", f"max({c})"), ("min", f"min({c})")))


@query(f"""WITH {TOK}, rows_ AS (SELECT row_id, sum(r) AS score, count(*) AS length FROM tok GROUP BY 1), toks AS (SELECT r AS advantage, v AS ret, r AS value FROM tok)
{_stats('score', 'rows_')} UNION ALL {_stats('length', 'rows_')} UNION ALL SELECT 'length/clip_ratio', round(avg(CASE WHEN length >= 7 THEN 1.0 ELSE 0 END), 7) FROM rows_
UNION ALL {_stats('advantage', 'toks')} UNION ALL {_stats('ret', 'toks')} UNION ALL {_stats('value', 'toks')} UNION ALL SELECT 'value/explained_var', round(1 - var_samp(ret - value) / (var_samp(ret) + 1e-5), 7) FROM toks""")
def data_metrics(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_tax").alias("v"), F.col("l_discount").alias("r"))
    rows = t.groupBy("row_id").agg(F.sum("r").alias("score"), F.count(F.lit(1)).alias("length"))
    return groups.data_metrics(rows, t.select(F.col("r").alias("advantage"), F.col("v").alias("ret"), F.col("r").alias("value")), 7).select("metric", F.round("value", 7).alias("value"))


@query("WITH s AS (SELECT event_type AS name, sum(value) AS seconds FROM events GROUP BY 1), n AS (SELECT sum(n_chars) AS total, sum(CASE WHEN lang = 'en' THEN n_chars ELSE 0 END) AS response FROM documents) SELECT name, round(seconds * 1000 / CASE WHEN name = 'gen' THEN response ELSE total END, 9) AS ms_per_token FROM s, n")
def timing_per_token(spark, sf):
    s = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.sum("value").alias("seconds"))
    n = table(spark, sf, "documents").agg(F.sum("n_chars").alias("total"), F.sum(F.when(F.col("lang") == "en", F.col("n_chars")).otherwise(0)).alias("response"))
    return groups.timing_per_token(s, n).select("name", F.round("ms_per_token", 9).alias("ms_per_token"))


@query("WITH d AS (SELECT doc_id AS row_id, n_chars AS n, doc_id % 4 AS part, doc_id // ((SELECT count(*) FROM documents) // 4) AS w FROM documents), b AS (SELECT w, sum(n) AS s FROM d GROUP BY 1), a AS (SELECT part, sum(n) AS s FROM d GROUP BY 1) SELECT 'before' AS \"when\", CAST(min(s) AS BIGINT) AS least, CAST(max(s) AS BIGINT) AS most, CAST(max(s) - min(s) AS BIGINT) AS spread, sum(s) / 4 AS mean FROM b UNION ALL SELECT 'after', CAST(min(s) AS BIGINT), CAST(max(s) AS BIGINT), CAST(max(s) - min(s) AS BIGINT), sum(s) / 4 FROM a")
def balance_stats(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "n_chars", (F.col("doc_id") % 4).alias("part"))
    return groups.balance_statistics(d, "n_chars", 4, "part", "row_id")


@query("SELECT (6.0 * 7000000000 * CAST(sum(n_chars) AS DOUBLE) + 12.0 * sum(CAST(n_chars AS DOUBLE) * n_chars) * 128 * 28 * 28) / 10 / 1e12 AS tflops FROM documents")
def flops(spark, sf):
    return groups.dense_flops(table(spark, sf, "documents"), "n_chars", 7_000_000_000, 28, 28, 128, 10.0)


@query(f"WITH {TOK} SELECT round(sum(v * m) / sum(m) * 2, 9) AS loss FROM tok")
def masked_loss(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_tax").alias("v"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("m"))
    return groups.masked_loss(t, "v", "m", 2).select(F.round("loss", 9).alias("loss"))


@query(f"WITH {TOK} SELECT round(sum(v * m) / sum(m), 9) AS mean, round(var_samp(CASE WHEN m = 1 THEN v END), 9) AS var FROM tok")
def masked_mean_var(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_tax").alias("v"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("m"))
    return t.agg(F.round(groups.masked_mean(F.col("v"), F.col("m")), 9).alias("mean"), F.round(groups.masked_var(F.col("v"), F.col("m")), 9).alias("var"))


@query(f"WITH {TOK}, s AS (SELECT sum(v * m) / sum(m) AS mu, var_samp(CASE WHEN m = 1 THEN v END) AS var FROM tok) SELECT row_id, t, round((v - mu) / sqrt(var + 1e-8), 6) AS whitened FROM tok, s")
def masked_whiten(spark, sf):
    return groups.whitened(tokens(spark, sf), "v", "m").select("row_id", F.col("t").cast("long").alias("t"), F.round("whitened", 6).alias("whitened"))


@query(f"WITH RECURSIVE {TRAJ}, b AS (SELECT uid // 50 AS step, count(DISTINCT uid) AS n FROM traj GROUP BY 1), o AS (SELECT step, n, row_number() OVER (ORDER BY step) AS k FROM b), f(k, step, carried) AS (SELECT k, step, n FROM o WHERE k = 1 UNION ALL SELECT o.k, o.step, CASE WHEN f.carried >= 120 THEN 0 ELSE f.carried END + o.n FROM f JOIN o ON o.k = f.k + 1) SELECT step, carried, carried >= 120 AS emitted FROM f")
def carry_over(spark, sf):
    b = trajectories(spark, sf).groupBy(F.floor(F.col("uid") / 50).cast("long").alias("step")).agg(F.countDistinct("uid").alias("n"))
    return carry.carried(b, "step", "n", 120)


@query(f"WITH {TRAJ}, d AS (SELECT row_id, source, CAST(round(score) AS BIGINT) AS n FROM traj) SELECT row_id, CAST(floor((sum(n) OVER (PARTITION BY source ORDER BY row_id ROWS UNBOUNDED PRECEDING) - 1) / 1000000) AS BIGINT) AS micro FROM d")
def token_budget_batches(spark, sf):
    d = trajectories(spark, sf).select("row_id", "source", F.round("score").cast("long").alias("n"))
    return balance.token_budget(d, "source", "n", "row_id", 1_000_000).select("row_id", "micro")


@query()
def kk_partition(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).alias("batch"), "n_chars")
    return balance.balanced(d, "batch", "n_chars", "doc_id", 8)


@query()
def greedy_partition(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).alias("batch"), "n_chars")
    return balance.balanced(d, "batch", "n_chars", "doc_id", 8, method="greedy")


@query(f"WITH {TRAJ} SELECT part, count(*) AS n, round(sum(reward), 9) AS reward FROM (SELECT *, uid % 5 AS part FROM traj) GROUP BY part")
def shard_function(spark, sf):
    def sums(batches):
        for b in batches:
            yield b.groupby("part", as_index=False).agg(n=("reward", "size"), reward=("reward", "sum"))

    t = trajectories(spark, sf).select((F.col("uid") % 5).alias("part"), "reward")
    return dispatch.on_shards(t, sums, "part long, n long, reward double", 4, "part").groupBy("part").agg(F.sum("n").alias("n"), F.round(F.sum("reward"), 9).alias("reward"))


@query("WITH k AS (SELECT doc_id, source, row_number() OVER (ORDER BY md5(concat(doc_id, ':42')), doc_id) AS k FROM documents) SELECT CAST(7 AS BIGINT) AS step, " + ", ".join(f"max(CASE WHEN k = {i} THEN doc_id END) AS row_id_{i}, max(CASE WHEN k = {i} THEN source END) AS source_{i}" for i in (1, 2, 3)) + " FROM k")
def val_table_wide(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "source")
    return sampling.wide_sample(d, 7, ["row_id", "source"], "row_id", 3)


@query()
def micro_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).alias("batch"), "n_chars")
    return balance.micro_batches(d, "batch", "n_chars", "doc_id", 50_000)


@query(f"WITH {TRAJ} SELECT row_id, round((reward - CASE WHEN n = 1 THEN 0 ELSE mu END) / (CASE WHEN n = 1 THEN 1 ELSE sd END + 1e-6), 6) AS advantage FROM (SELECT *, count(*) OVER w AS n, avg(reward) OVER w AS mu, stddev_samp(reward) OVER w AS sd FROM traj WINDOW w AS (PARTITION BY uid))")
def grpo(spark, sf):
    return advantage.group_relative(trajectories(spark, sf), "uid", "reward").select("row_id", F.round("advantage", 6).alias("advantage"))


@query(f"WITH {TRAJ} SELECT row_id, round(CASE WHEN n > 1 THEN (reward - mu) * n / (n - 1) ELSE reward END, 6) AS advantage FROM (SELECT *, count(*) OVER w AS n, avg(reward) OVER w AS mu FROM traj WINDOW w AS (PARTITION BY uid))")
def rloo(spark, sf):
    return advantage.leave_one_out(trajectories(spark, sf), "uid", "reward").select("row_id", F.round("advantage", 6).alias("advantage"))


# ---- sources and sinks ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, concat('run/global_step_', doc_id % 7, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS path, CAST(doc_id % 7 AS INT) AS step FROM documents WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id, 'none', NULL FROM documents WHERE doc_id % 5 = 0")
def checkpoint_step(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "none").otherwise(F.concat(F.lit("run/global_step_"), F.col("doc_id") % 7, F.when(F.col("doc_id") % 3 == 0, "x").otherwise(""))).alias("path"))
    return d.withColumn("step", files.checkpoint_step(F.col("path")))


@query("SELECT concat('run/global_step_', max(doc_id)) AS path, CAST(max(doc_id) AS INT) AS step FROM documents")
def latest_checkpoint(spark, sf):
    return files.latest_checkpoint(table(spark, sf, "documents").select(F.concat(F.lit("run/global_step_"), "doc_id").alias("path")))


@query("SELECT event_id // 1000 AS step, concat('step:', event_id // 1000, ' - ', string_agg(line, ' - ' ORDER BY line)) AS line FROM (SELECT event_id // 1000 * 1000 AS event_id, concat(event_type, ':', count(*), '.000') AS line FROM events GROUP BY 1, event_type) GROUP BY event_id")
def console_lines(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 1000).cast("long").alias("step"), F.col("event_type").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return files.console_lines(rows)


@query(f"WITH {SEQ} SELECT row_id, coalesce(list_filter(rs, lambda x: x <> 0)[-1], 0.0::DOUBLE) AS reward FROM seq")
def last_nonzero_reward(spark, sf):
    return sequences(spark, sf).select("row_id", files.last_nonzero(F.col("rs")).alias("reward"))


@query(f"WITH {RESP} SELECT uid, list(truth ORDER BY row_id) AS responses FROM resp GROUP BY uid")
def response_lists(spark, sf):
    r = responses(spark, sf).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("row_id", "truth"))).alias("x"))
    return r.select("uid", F.col("x.truth").alias("responses"))


def fresh(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_array_roundtrip(spark, sf):
    path = fresh(spark, "array")
    files.write_json_array(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return files.read_json_array(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query(r"""SELECT c_custkey, concat(c_name, ' "}], {[ ', chr(92)) AS name, [c_nationkey, c_custkey % 3] AS xs, row_number() OVER (ORDER BY c_custkey) - 1 AS row_id FROM customer""")
def json_array_split(spark, sf):
    """One array in one file (customers in order), read by tasks of a few kilobytes each: braces, brackets and quotes in strings."""
    path = fresh(spark, "one-array")
    c = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(' "}], {[ \\')).alias("name"), F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 3).alias("xs"))
    files.write_json_array(c.coalesce(1).sortWithinPartitions("c_custkey"), path)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        return json_array.read_array(spark, path, "c_custkey long, name string, xs array<bigint>").drop("file")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer")
def json_lines_append(spark, sf):
    path, c = fresh(spark, "lines"), table(spark, sf, "customer").select("c_custkey", "c_name")
    files.append_json_lines(c, path)
    files.append_json_lines(c, path)
    return files.read_json_lines(spark, path, "c_custkey long, c_name string")


@query(f"WITH {SEQ} SELECT CASE WHEN row_id % 2 = 0 THEN 'train' ELSE 'val' END AS split, row_id % 3 AS step, concat('p', row_id) AS prompt, coalesce(list_filter(rs, lambda x: x <> 0)[-1], 0.0::DOUBLE) AS reward FROM seq")
def sample_dump(spark, sf):
    path, k = fresh(spark, "samples"), F.col("row_id")
    s = sequences(spark, sf).select(F.when(k % 2 == 0, "train").otherwise("val").alias("split"), (k % 3).alias("step"), F.concat(F.lit("p"), k).alias("prompt"), F.lit("r").alias("response"), F.col("rs").alias("token_level_scores"), F.lit("x").alias("source"))
    files.write_samples(s, path)
    return spark.read.schema("prompt string, reward double, split string, step long").json(path).select("split", "step", "prompt", "reward")


@query(f"WITH {RESP}, s AS (SELECT uid, max(CASE WHEN truth = '7' THEN 1 ELSE 0 END) AS best FROM resp GROUP BY uid) SELECT round(avg(CAST(best AS DOUBLE)), 9) AS pass_at_k, count(*) AS prompts FROM s")
def offline_evaluation(spark, sf):
    """Responses in lists, written as Parquet, read again and scored."""
    path = fresh(spark, "responses")
    files.write_responses(responses(spark, sf), path, "uid", "truth", "row_id")
    scored = files.read_prompts(spark, [path]).select(F.transform("responses", lambda x: F.when(x == "7", 1.0).otherwise(0.0)).alias("scores"))
    return groups.pass_at_k(scored, "scores").select(F.round("pass_at_k", 9).alias("pass_at_k"), F.lit(scored.count()).cast("long").alias("prompts"))


@query("SELECT event_id AS step, event_type AS key, value, CAST(i AS INT) AS sink FROM events, range(3) r(i)")
def metric_log(spark, sf):
    paths = [fresh(spark, "metrics") for _ in range(3)]
    files.log_metrics(table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("key"), "value"), *paths[:2], ("json", paths[2]))
    kinds = [spark.read.parquet(paths[0]), spark.read.parquet(paths[1]), spark.read.schema("step long, key string, value double").json(paths[2])]
    return functools.reduce(DataFrame.unionByName, [d.withColumn("sink", F.lit(i)) for i, d in enumerate(kinds)])


@query("SELECT event_type, strftime(ts, '%Y-%m-%d %H') AS hour, round(avg(value), 9) AS mean, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_means(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    w = carry.windowed_means(e, "ts", "event_type", "value")
    return w.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), F.round("mean", 9).alias("mean"), "n")


@query("SELECT conv_id, string_agg(concat('<|', role, '|>', text), chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY conv_id")
def chat_render(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return c.select("conv_id", text.rendered_chat(F.col("m")).alias("chat"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'x' END AS truth, o_orderstatus AS style FROM orders")
def nested_fields(spark, sf):
    """A prompt table written as Parquet with a nested reward model, whose fields are read by successive keys."""
    path, o = fresh(spark, "prompts"), table(spark, sf, "orders")
    truth = F.array(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("x"))
    o.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("style"), truth.alias("truth")).alias("reward_model")).write.parquet(path)
    got = files.nested(files.read_prompts(spark, [path]), "reward_model", "truth", name="truth")
    return files.nested(got, "reward_model", "style", name="style").select("o_orderkey", "truth", "style")


@query("SELECT p_name AS prompt, p_brand AS chosen, p_type AS rejected FROM part")
def preference_rows(spark, sf):
    path = fresh(spark, "preferences")
    table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("prompt"), F.col("p_brand").alias("chosen"), F.col("p_type").alias("rejected")).write.parquet(path)
    return files.read_preferences(spark, [path])


@query("SELECT concat(r_name, CASE WHEN r_regionkey % 2 = 0 THEN ' é' ELSE ' ñ' END) AS text FROM region")
def text_files(spark, sf):
    """Whole text files, some in UTF-8 and some in another charset, read as text."""
    path = fresh(spark, "texts")
    t = table(spark, sf, "region").select(F.concat("r_name", F.when(F.col("r_regionkey") % 2 == 0, " é").otherwise(" ñ")).alias("value"), (F.col("r_regionkey") % 2).alias("k"))
    for k, charset in ((0, "utf-8"), (1, "iso-8859-1")):
        part = t.where(F.col("k") == k).select("value")
        part.repartition(part.count(), "value").write.option("encoding", charset).option("lineSep", "\u0001").text(f"{path}/{k}")
    whole = files.read_text(spark, f"{path}/*/*.txt").select(F.explode(F.split("text", "\u0001")).alias("text"))
    return whole.where("text <> ''")


@query("WITH x AS (SELECT concat('run', o_custkey % 7) AS base FROM orders) SELECT base, count(*) AS n, concat(base, '_', count(*) + 1) AS next FROM x GROUP BY 1")
def versioned_names(spark, sf):
    """Folders named by order: the bare name or one with a number."""
    o = table(spark, sf, "orders")
    name = F.concat(F.lit("run"), F.col("o_custkey") % 7, F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("_"), "o_orderkey")))
    return files.next_versions(o.select(name.alias("name")))


@query("""WITH x AS (SELECT c_custkey, unnest([{'key': 'a/b', 'value': CAST(c_nationkey AS VARCHAR)}, {'key': 'a/xs/list_len', 'value': CAST(c_custkey % 3 AS VARCHAR)}, {'key': 'name', 'value': c_name}]) AS e FROM customer
UNION ALL SELECT c_custkey, {'key': concat('a/xs/', i, '/z'), 'value': CASE WHEN i = 0 THEN c_mktsegment END} FROM customer, range(3) r(i) WHERE i < c_custkey % 3) SELECT c_custkey, e.key AS key, e.value AS value FROM x""")
def flat_config(spark, sf):
    """A nested configuration of each customer, flat."""
    c = table(spark, sf, "customer").selectExpr("c_custkey", "struct(struct(c_nationkey AS b, transform(slice(array(0, 1, 2), 1, cast(c_custkey % 3 AS int)), i -> struct(CASE WHEN i = 0 THEN c_mktsegment END AS z)) AS xs) AS a, c_name AS name) AS config")
    return c.select("c_custkey", F.inline(files.flat_entries(F.col("config"), c.schema["config"].dataType)))


CONFIG = "p_size % 9 AS train_batch, p_partkey % 4 AS samples, p_partkey % 5 + 1 AS ranks, CASE WHEN p_partkey % 6 > 0 THEN p_size % 12 END AS mini, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 7 END AS micro, CASE WHEN p_size % 4 = 0 THEN 2 END AS micro_per_rank, p_size % 5 = 0 AS dynamic, CASE WHEN p_partkey % 2 = 0 THEN 'gae' ELSE 'grpo' END AS estimator, p_size % 3 = 0 AS critic"


@query(f"""WITH c AS (SELECT p_partkey, {CONFIG} FROM part), x AS (SELECT *, train_batch * coalesce(nullif(samples, 0), 1) AS total FROM c), y AS (SELECT *, coalesce(nullif(mini, 0), total) AS m FROM x)
SELECT p_partkey, CAST((total <= 0 OR total % ranks <> 0) AS INT) + CAST(m > total AS INT) + CAST((NOT dynamic AND micro IS NULL AND micro_per_rank IS NULL) AS INT) + CAST((NOT dynamic AND micro IS NOT NULL AND micro_per_rank IS NOT NULL) AS INT)
 + CAST((NOT dynamic AND coalesce(micro, 0) <> 0 AND m % nullif(micro, 0) <> 0) AS INT) + CAST((NOT dynamic AND coalesce(micro, 0) <> 0 AND micro % ranks <> 0) AS INT) + CAST((estimator = 'gae' AND NOT critic) AS INT) AS problems FROM y""")
def config_problems(spark, sf):
    """A configuration made of each part's numbers."""
    c = table(spark, sf, "part").selectExpr("p_partkey", *CONFIG.split(", "))
    return config.checked(c).select("p_partkey", F.size("problems").alias("problems"))


@query("SELECT c_custkey, CAST(c_custkey % 4 AS INT) AS part_id, 1 AS places FROM customer")
def placed_parts(spark, sf):
    """Rows on partitions by their part: each part is on one partition only."""
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 4).cast("int").alias("part_id"))
    at = balance.placed(c, 4).withColumn("place", F.spark_partition_id())
    places = at.groupBy("part_id").agg(F.countDistinct("place").cast("int").alias("places"))
    return at.join(places, "part_id").select("c_custkey", "part_id", "places")


@query("SELECT n_nationkey, length(n_name) AS n FROM nation")
def registered_tool(spark, sf):
    r = dispatch.Registry()
    r.register("length")(F.length)
    return table(spark, sf, "nation").select("n_nationkey", r["length"]("n_name").cast("long").alias("n"))


@query("SELECT n_nationkey, r_name, 25 AS rows FROM nation, region")
def sent_to_all(spark, sf):
    n, r = table(spark, sf, "nation").select("n_nationkey"), table(spark, sf, "region").select("r_name")
    return dispatch.to_all(n, r).withColumn("rows", F.lit(dispatch.on_driver(n, lambda d: d.count())).cast("int"))


@query(f"WITH {TRAJ} SELECT row_id, reward FROM traj WHERE row_id <= {N} - 10 AND ({N} - 10 - row_id) % 7 = 0")
def proto_slice_back(spark, sf):
    return batch.slice_rows(trajectories(spark, sf), -10, None, -7).select("row_id", "reward")


@query(f"WITH {TRAJ}, x AS (SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(round(score)) AS BIGINT) AS total FROM traj GROUP BY 1) SELECT n, total, 8 AS parts, true AS balanced FROM x")
def balanced_parts(spark, sf):
    """What balanced parts keep: all rows and lengths, and no part longer than the mean and the longest row together."""
    d = trajectories(spark, sf).select("row_id", "source", F.round("score").cast("long").alias("len"))
    parts = balance.balanced(d, "source", "len", "row_id", 8).groupBy("source", "part_id").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("s"), F.max("len").alias("longest"))
    g = parts.groupBy("source").agg(F.sum("n").alias("n"), F.sum("s").alias("total"), F.count(F.lit(1)).cast("int").alias("parts"), (F.max("s") <= F.sum("s") / 8 + F.max("longest")).alias("balanced"))
    return g.drop("source")
