"""Queries: token recursions, losses and token-array functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import sequence
from millrace.operators import advantage, losses, scores
from millrace.plans.fixtures import SEQ, TOK, query, rounded, sequences, tokens
from millrace.sources.tables import table


def scanned(first: str, step: str, what: str = "s") -> str:
    """SQL of a scan from the last token: `first` and `step` give the carried columns of a token x; p is the one after it."""
    return f"""WITH RECURSIVE {TOK}, n AS (SELECT row_id, max(t) AS last FROM tok GROUP BY 1),
f AS (SELECT x.row_id AS row_id, x.t AS t, {first} FROM tok x JOIN n ON n.row_id = x.row_id AND n.last = x.t UNION ALL SELECT x.row_id, x.t, {step} FROM f p JOIN tok x ON x.row_id = p.row_id AND x.t = p.t - 1)"""


@query(f"WITH {TOK} SELECT row_id, list(round(s, 9) ORDER BY t) AS returns FROM (SELECT row_id, t, sum(r * m) OVER (PARTITION BY row_id ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS s FROM tok) GROUP BY row_id")
def suffix_returns(spark: SparkSession, sf: str) -> DataFrame:
    s = sequences(spark, sf)
    return s.select("row_id", F.transform(advantage.suffix_sums(F.col("rs"), F.col("ms")), lambda x: F.round(x, 9)).alias("returns"))


@query(scanned("x.r * x.m AS s, x.m AS m, x.r * x.m - 0.1::DOUBLE * x.m AS a", "p.s + x.r * x.m, x.m, p.s + x.r * x.m - 0.1::DOUBLE * x.m") + " SELECT row_id, list(round(a, 9) ORDER BY t) AS advantages FROM f GROUP BY row_id")
def remax(spark, sf):
    s = sequences(spark, sf)
    g = advantage.greedy_baseline(F.col("rs"), F.col("ms"), F.lit(0.1))
    return s.select("row_id", F.transform(g["advantages"], lambda x: rounded(x, 9)).alias("advantages"))


@query(scanned("x.r + 0.9::DOUBLE * 0 AS s, (x.r + 0.9::DOUBLE * 0) * x.m AS c", "x.r + 0.9::DOUBLE * p.c, (x.r + 0.9::DOUBLE * p.c) * x.m") + " SELECT row_id, list(round(s, 9) ORDER BY t) AS returns FROM f GROUP BY row_id")
def reinforce_pp(spark, sf):
    s = sequences(spark, sf)
    return s.select("row_id", F.transform(advantage.discounted(F.col("rs"), F.col("ms"), 0.9), lambda x: rounded(x, 9)).alias("returns"))


WHITE = ", w AS (SELECT sum(a * m) / sum(m) AS mu, var_samp(CASE WHEN m = 1 THEN a END) AS var FROM f)"


@query(scanned("x.r - x.v AS a, x.v AS v, x.m AS m", "x.r + 0.99::DOUBLE * p.v - x.v + 0.99::DOUBLE * 0.95::DOUBLE * p.a, x.v, x.m") + " SELECT row_id, list(round(a, 9) ORDER BY t) AS advantages FROM f GROUP BY row_id")
def gae(spark, sf):
    s = sequences(spark, sf)
    return s.select("row_id", F.transform(advantage.gae(F.col("rs"), F.col("vs"), 0.99, 0.95), lambda x: rounded(x, 9)).alias("advantages"))


@query(scanned("x.r - x.v AS a, x.v AS v, x.m AS m", "x.r + 0.99::DOUBLE * p.v - x.v + 0.99::DOUBLE * 0.95::DOUBLE * p.a, x.v, x.m") + WHITE + " SELECT row_id, list(round((a - mu) / sqrt(var + 1e-8) * m, 6) ORDER BY t) AS advantages FROM f, w GROUP BY row_id")
def gae_whitened(spark, sf):
    s = sequences(spark, sf).select("row_id", F.col("rs").alias("rewards"), F.col("vs").alias("values"), F.col("ms").alias("mask"))
    out = advantage.advantages(s, "gae", 0.99, 0.95)
    return out.select("row_id", F.transform("advantages", lambda x: rounded(x, 6)).alias("advantages"))


POLICY = "greatest(1 - 1 / greatest(0.05::DOUBLE * {0}, 1.0::DOUBLE), 0.9::DOUBLE)"


@query(
    scanned(
        f"CASE WHEN x.tool = 0 THEN 0.0::DOUBLE ELSE x.v END AS v, CASE WHEN x.tool = 0 THEN 0.0::DOUBLE ELSE x.r - x.v END AS a, CASE WHEN x.tool = 0 THEN 0.0::DOUBLE ELSE x.r - x.v END AS b, {POLICY.format('(n.last + 1)')} AS lam",
        "CASE WHEN x.tool = 0 THEN p.v ELSE x.v END, CASE WHEN x.tool = 0 THEN p.a ELSE x.r + p.v - x.v + 0.95::DOUBLE * p.a END, CASE WHEN x.tool = 0 THEN p.b ELSE x.r + p.v - x.v + p.lam * p.b END, p.lam",
    )
    + " SELECT row_id, list(round(a + v, 9) ORDER BY t) AS returns, list(round(b, 9) ORDER BY t) AS advantages FROM f GROUP BY row_id"
)
def decouple_gae(spark, sf):
    s = sequences(spark, sf)
    out = advantage.decoupled_gae(s, "rs", "vs", "tools", 1.0, 0.95, 0.05)
    return out.select("row_id", *[F.transform(c, lambda x: rounded(x, 9)).alias(c) for c in ("returns", "advantages")])


@query(scanned("CASE WHEN x.tool = 0 THEN 0.0::DOUBLE ELSE x.v END AS v", "CASE WHEN x.tool = 0 THEN p.v ELSE x.v END") + " SELECT row_id, list(v ORDER BY t) AS vs FROM f GROUP BY row_id")
def settled_values(spark, sf):
    return sequences(spark, sf).select("row_id", advantage.settled_values(F.col("vs"), F.col("tools")).alias("vs"))


# ---- losses ---------------------------------------------------------------------------------------------------------


def toks(spark, sf):
    """Token rows without their positions, for operators that need none: no shuffle."""
    x = table(spark, sf, "lineitem")
    return x.select(F.col("l_orderkey").alias("row_id"), F.col("l_tax").alias("v"), F.col("l_discount").alias("r"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("m"))


def loss_query(name, mode, sql):
    def run(spark, sf):
        return losses.aggregated(toks(spark, sf), "v", "m", "row_id", mode, 7).select(F.round("loss", 9).alias("loss"))

    run.__name__ = name
    query(f"WITH {TOK}, g AS (SELECT row_id, sum(v * m) AS s, sum(m) AS n FROM tok GROUP BY 1) SELECT round({sql}, 9) AS loss FROM g")(run)


loss_query("loss_agg_token_mean", "token-mean", "sum(s) / sum(n)")
loss_query("loss_agg_seq_sum", "seq-mean-token-sum", "avg(s)")
loss_query("loss_agg_seq_mean", "seq-mean-token-mean", "avg(CASE WHEN n > 0 THEN s / n END)")
loss_query("loss_agg_sum_norm", "seq-mean-token-sum-norm", "sum(s) / 7")

RATIO = "exp(v - r)"


@query(f"""WITH {TOK}, x AS (SELECT m, r - 0.05::DOUBLE AS a, v - r AS d FROM tok), y AS (SELECT *, -a * exp(d) AS p, -a * greatest(0.99::DOUBLE, least(1.01::DOUBLE, exp(d))) AS c FROM x), z AS (SELECT *, greatest(p, c) AS f, -a * 3 AS k FROM y)
SELECT round(sum(m * CASE WHEN a < 0 THEN least(k, f) ELSE f END) / sum(m), 9) AS policy_loss, round(sum(m * CASE WHEN c > p THEN 1.0::DOUBLE ELSE 0 END) / sum(m), 9) AS clip_fraction, round(sum(-d * m) / sum(m), 9) AS kl, round(sum(m * CASE WHEN f > k AND a < 0 THEN 1.0::DOUBLE ELSE 0 END) / sum(m), 9) AS clip_fraction_lower FROM z""")
def policy_loss(spark, sf):
    t = toks(spark, sf).withColumn("a", F.col("r") - 0.05)
    out = losses.clipped_policy(t, "r", "v", "a", "m", 0.01, 0.01)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(f"WITH {TOK}, x AS (SELECT m, pow(v - 0.04::DOUBLE, 2) AS a, pow(greatest(r - 0.02::DOUBLE, least(r + 0.02::DOUBLE, v)) - 0.04::DOUBLE, 2) AS b FROM tok) SELECT round(0.5 * sum(m * greatest(a, b)) / sum(m), 9) AS value_loss, round(sum(m * CASE WHEN b > a THEN 1.0::DOUBLE ELSE 0 END) / sum(m), 9) AS clip_fraction FROM x")
def value_loss(spark, sf):
    out = losses.clipped_value(toks(spark, sf).withColumn("ret", F.lit(0.04)), "v", "r", "ret", "m", 0.02)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("SELECT l_orderkey, l_linenumber, round(d, 9) AS kl, round(abs(d), 9) AS abs_, round(0.5 * d * d, 9) AS mse, round(greatest(-10, least(10, exp(-d) + d - 1)), 9) AS low FROM (SELECT *, (l_tax - l_discount) * 100 AS d FROM lineitem)")
def kl_variants(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_tax") - F.col("l_discount")) * 100).alias("d"))
    each = {k: F.round(losses.divergence(F.col("d"), F.lit(0.0), n), 9) for k, n in (("kl", "kl"), ("abs_", "abs"), ("mse", "mse"), ("low", "low_var_kl"))}
    return d.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in each.items()])


E8 = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(f"WITH e AS (SELECT vec_id, {E8} AS x FROM embeddings), z AS (SELECT vec_id, x, list_max(x) AS top FROM e), y AS (SELECT vec_id, x, top + ln(list_sum(list_transform(x, lambda a: exp(a - top)))) AS z FROM z) SELECT vec_id, round(z - list_sum(list_transform(x, lambda a: exp(a - z) * a)), 9) AS entropy FROM y")
def entropy(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(losses.entropy(F.col("embedding").cast("array<double>")), 9).alias("entropy"))


@query(f"WITH e AS (SELECT vec_id, label, {E8} AS x FROM embeddings), z AS (SELECT vec_id, label, x, list_max(x) AS top FROM e) SELECT vec_id, round(x[label + 1] - top - ln(list_sum(list_transform(x, lambda a: exp(a - top)))), 9) AS logp FROM z")
def label_logprob(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(losses.label_log_prob(F.col("embedding").cast("array<double>"), F.col("label")), 9).alias("logp"))


@query(f"WITH {TOK} SELECT round(-sum(CASE WHEN r - 0.05::DOUBLE > 1e-7 AND m = 1 THEN v ELSE 0 END) / greatest(count(*) FILTER (r - 0.05::DOUBLE > 1e-7 AND m = 1), 1), 9) AS loss FROM tok")
def positive_loss(spark, sf):
    t = toks(spark, sf).withColumn("a", F.col("r") - 0.05)
    return losses.selected_log_loss(t, "v", "a", "m").select(F.round("loss", 9).alias("loss"))


@query(f"WITH {TOK} SELECT row_id, t, m * tool * CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS mask FROM tok")
def composite_mask(spark, sf):
    return tokens(spark, sf).select("row_id", F.col("t").cast("long").alias("t"), losses.all_masks(F.col("m"), F.col("tool"), F.when(F.col("id") % 2 == 0, 1).otherwise(0)).alias("mask"))


@query("WITH RECURSIVE s AS (SELECT event_id // 500 AS step, avg(value) / 100 AS kl, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY step) AS k FROM s), f AS (SELECT 0 AS k, CAST(-1 AS BIGINT) AS step, 0.2::DOUBLE AS v UNION ALL SELECT CAST(o.k AS INT), o.step, f.v * (1 + greatest(-0.2::DOUBLE, least(0.2::DOUBLE, o.kl / 0.3::DOUBLE - 1)) * o.n / 10000.0::DOUBLE) FROM f JOIN o ON o.k = f.k + 1) SELECT step, round(v, 9) AS coefficient FROM f WHERE k > 0")
def adaptive_kl(spark, sf):
    s = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 500).cast("long").alias("step")).agg((F.avg("value") / 100).alias("kl"), F.count(F.lit(1)).alias("n"))
    return losses.adaptive_coefficient(s, "step", "kl", "n", 0.2, 0.3, 10000.0).select("step", F.round("coefficient", 9).alias("coefficient"))


@query("SELECT event_id AS step, round(CASE WHEN event_id < 100 THEN event_id / 100.0::DOUBLE ELSE greatest(0, 0.45::DOUBLE * cos(pi() * (event_id - 100) / 999900.0::DOUBLE) + 0.55::DOUBLE) END, 9) AS factor FROM events")
def lr_cosine(spark, sf):
    """The factor at each event's step, of a million steps."""
    return table(spark, sf, "events").select(F.col("event_id").alias("step"), F.round(losses.cosine_factor(F.col("event_id"), 1_000_000, 100, 0.1), 9).alias("factor"))


@query("SELECT event_id AS step, least(1.0::DOUBLE, event_id / 100.0::DOUBLE) AS factor FROM events")
def lr_constant(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("step"), losses.constant_factor(F.col("event_id"), 100).alias("factor"))


@query(f"WITH {TOK}, n AS (SELECT row_id, count(*) AS n FROM tok GROUP BY 1) SELECT row_id, list_transform(range(0, n), lambda i: CASE WHEN i = n - 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS rewards FROM n")
def sparse_token_reward(spark, sf):
    s = sequences(spark, sf)
    return s.select("row_id", scores.sparse_reward(F.lit(0.5), F.size("vs"), F.size("vs")).alias("rewards"))


@query(f"WITH {TOK} SELECT row_id, t, round(id - 0.1::DOUBLE * (v * m - r * m), 9) AS reward FROM tok")
def kl_reward(spark, sf):
    return scores.kl_rewards(tokens(spark, sf), "id", "v", "r", "m", 0.1).select("row_id", F.col("t").cast("long").alias("t"), F.round("reward", 9).alias("reward"))


@query(f"WITH {SEQ}, p AS (SELECT row_id, ids, ms, list_transform(range(0, len(ms)), lambda i: i * ms[i + 1]) AS k FROM seq), q AS (SELECT *, list_position(k, list_max(k)) - 1 AS spot FROM p) SELECT row_id, list_transform(range(0, len(ms)), lambda i: CASE WHEN i = spot THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END)[-2:] AS scores FROM q WHERE len(ms) >= 2")
def model_score_tokens(spark, sf):
    s = sequences(spark, sf).where(F.size("ms") >= 2)
    return s.select("row_id", scores.at_last_position(F.lit(2.5), F.sequence(F.lit(0), F.size("ms") - 1), F.col("ms"), F.lit(2)).alias("scores"))


@query(f"WITH {SEQ} SELECT row_id, CAST(floor(CAST(list_sum(ms) AS DOUBLE) / len(ms)) AS BIGINT) AS passes FROM seq")
def pass_fraction_long(spark, sf):
    return sequences(spark, sf).select("row_id", scores.pass_fraction(F.col("ms")).alias("passes"))


# ---- token arrays ---------------------------------------------------------------------------------------------------


def listed(expression: str) -> str:
    return f"WITH {SEQ} SELECT row_id, {expression} AS out FROM seq"


@query(listed("list_transform(range(0, len(tools)), lambda i: CASE WHEN i < coalesce(nullif(list_position(list_transform(ids, lambda x: x % 5 IN (0, 3)), true), 0), len(tools)) THEN 1 ELSE 0 END)"))
def eos_mask(spark, sf):
    s = sequences(spark, sf).withColumn("k", F.transform("ids", lambda x: x % 5))
    return s.select("row_id", sequence.end_mask(F.col("k"), 0, 3).alias("out"))


@query(listed("list_transform(range(0, len(ms)), lambda i: greatest(0, CAST(list_sum(ms[: i + 1]) AS BIGINT) - 1))"))
def position_ids(spark, sf):
    return sequences(spark, sf).select("row_id", sequence.position_ids(F.col("ms")).alias("out"))


@query(listed("list_concat(list_transform(range(0, greatest(0, 6 - len(ids))), lambda i: CAST(-1 AS BIGINT)), ids)"))
def left_pad(spark, sf):
    return sequences(spark, sf).select("row_id", sequence.padded(F.col("ids"), 6, -1, left=True).alias("out"))


@query(f"WITH {SEQ}, l AS (SELECT greatest(max(len(ids)), 5) AS n FROM seq) SELECT row_id, list_concat(ids, list_transform(range(0, n - len(ids)), lambda i: CAST(0 AS BIGINT))) AS out FROM seq, l")
def rectangular(spark, sf):
    return sequence.rectangular(sequences(spark, sf).select("row_id", F.col("ids").alias("out")), "out", 5, 0)


@query(listed("CASE WHEN len(ids) > 3 THEN ids[-3:] ELSE list_concat(list_transform(range(0, 3 - len(ids)), lambda i: CAST(0 AS BIGINT)), ids) END"))
def fit_left(spark, sf):
    return sequences(spark, sf).select("row_id", sequence.fitted(F.col("ids"), 3, 0, truncation="left").alias("out"))


@query(listed("CASE WHEN len(ids) > 3 THEN ids[:3] ELSE list_concat(ids, list_transform(range(0, 3 - len(ids)), lambda i: CAST(0 AS BIGINT))) END"))
def sft_fit_right(spark, sf):
    s = sequences(spark, sf)
    return s.select("row_id", sequence.joined(F.slice("ids", F.lit(1), F.lit(2)), F.slice("ids", F.lit(3), F.size("ids")), 3, 0, "right").alias("out"))


@query(listed("CASE WHEN list_sum(ms) = 0 THEN [] ELSE ids[-CAST(list_sum(ms) AS BIGINT):] END"))
def strip_padding(spark, sf):
    return sequences(spark, sf).select("row_id", sequence.unpadded(F.col("ids"), F.col("ms")).alias("out"))


@query(listed("coalesce(ids[nullif(list_position(list_transform(ids, lambda x: x % 3 <> 0), true), 0):], [])"))
def strip_leading(spark, sf):
    s = sequences(spark, sf).withColumn("k", F.transform("ids", lambda x: F.when(x % 3 == 0, 0).otherwise(x)))
    first = sequence.from_first_token(F.col("k"), 0)
    return s.select("row_id", F.slice("ids", F.size("ids") - F.size(first) + 1, F.size(first)).alias("out"))


@query("WITH l AS (SELECT o_orderkey AS row_id, o_custkey % 9 AS n FROM orders) SELECT row_id, CAST(sum(n) OVER (ORDER BY row_id) - n AS BIGINT) AS cu_seqlen FROM l UNION ALL SELECT count(*), CAST(sum(n) AS BIGINT) FROM l")
def cu_seqlens(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 9).alias("n"))
    return sequence.packed_offsets(d, "n", "row_id", 1000)


@query(listed("list_transform(range(0, len(ms)), lambda i: CASE WHEN i < 1 OR i = list_sum(ms) - 1 THEN 0 ELSE ms[i + 1] END)"))
def sft_loss_mask(spark, sf):
    return sequences(spark, sf).select("row_id", sequence.answer_loss_mask(F.col("ms"), F.lit(2)).alias("out"))


@query(listed("[list_concat(ids, [CAST(7 AS BIGINT), 0, 0, 0, 0, 0, 0])[:6], list_concat(ids, [CAST(8 AS BIGINT), 9, 0, 0, 0, 0, 0])[:6]]"))
def preference_pair(spark, sf):
    ids = F.col("ids")
    p = sequence.preference_pair(ids, F.array(F.lit(7).cast("long")), F.array(F.lit(8).cast("long"), F.lit(9).cast("long")), 6, 0)
    return sequences(spark, sf).select("row_id", p["input_ids"].alias("out"))


@query(listed("list_transform([1, 2], lambda k: list_transform(range(0, 6), lambda i: CASE WHEN i < len(ids) + k THEN 1 ELSE 0 END))"))
def preference_masks(spark, sf):
    ids = F.col("ids")
    p = sequence.preference_pair(ids, F.array(F.lit(7).cast("long")), F.array(F.lit(8).cast("long"), F.lit(9).cast("long")), 6, 0)
    return sequences(spark, sf).select("row_id", p["attention_mask"].alias("out"))


@query(scanned("x.r + 0.9::DOUBLE * 0 AS a, (x.r + 0.9::DOUBLE * 0) * x.m AS c, x.m AS m", "x.r + 0.9::DOUBLE * p.c, (x.r + 0.9::DOUBLE * p.c) * x.m, x.m") + WHITE + " SELECT row_id, list(round((a - mu) / sqrt(var + 1e-8) * m, 6) ORDER BY t) AS advantages FROM f, w GROUP BY row_id")
def reinforce_whitened(spark, sf):
    s = sequences(spark, sf).select("row_id", F.col("rs").alias("rewards"), F.col("ms").alias("mask"))
    return advantage.advantages(s, "discounted", 0.9).select("row_id", F.transform("advantages", lambda x: rounded(x, 6)).alias("advantages"))


@query(listed("list_transform(range(0, len(ids)), lambda i: CASE WHEN i * 3 >= 4 AND i * 3 < 10 THEN 0 ELSE 1 END)"))
def tool_token_mask(spark, sf):
    s = sequences(spark, sf)
    starts = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: i * 3)
    return s.select("row_id", sequence.range_mask(starts, F.transform(starts, lambda x: x + 3), F.array(F.struct(F.lit(4).alias("s"), F.lit(10).alias("e")))).alias("out"))


@query(listed("list_transform(range(0, len(ms)), lambda i: CASE WHEN row_id % 2 = 1 AND row_id % 4 > 0 AND i < row_id % 4 THEN 0 ELSE ms[i + 1] END)"))
def proposal_mask(spark, sf):
    return sequences(spark, sf).select("row_id", sequence.without_proposal(F.col("ms"), (F.col("row_id") % 2).cast("int"), F.col("row_id") % 4).alias("out"))


@query(listed("list_transform(range(1, 5), lambda i: CAST(list_sum(ms) AS BIGINT) - 1 + i)"))
def response_positions(spark, sf):
    last = F.aggregate("ms", F.lit(0).cast("long"), lambda a, m: a + m) - 1
    return sequences(spark, sf).select("row_id", sequence.response_positions(last, 4).alias("out"))


@query(listed("list_concat([CAST(1 AS BIGINT), 2], ids[: greatest(0, len(ids) - 2)])"))
def backtrack(spark, sf):
    prompt = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))
    return sequences(spark, sf).select("row_id", sequence.backtracked(prompt, F.col("ids"), 2).alias("out"))


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents) SELECT doc_id, CAST(len(list_filter(range(0, len(t), 100), lambda s: least(256, len(t) - s) >= 64)) AS INT) AS windows FROM w")
def token_windows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("t"))
    return d.select("doc_id", F.size(sequence.windows(F.col("t"), 256, 100, 64)).alias("windows"))


@query(f"""WITH {TOK}, b AS (SELECT *, CASE WHEN tool = 0 AND coalesce(lag(tool) OVER (PARTITION BY row_id ORDER BY t), 1) = 1 THEN 1 ELSE 0 END AS starts, CASE WHEN tool = 0 AND coalesce(lead(tool) OVER (PARTITION BY row_id ORDER BY t), 1) = 1 THEN 1 ELSE 0 END AS ends FROM tok),
s AS (SELECT row_id, t AS s, row_number() OVER (PARTITION BY row_id ORDER BY t) AS k FROM b WHERE starts = 1), e AS (SELECT row_id, t AS e, row_number() OVER (PARTITION BY row_id ORDER BY t) AS k FROM b WHERE ends = 1),
j AS (SELECT row_id, (SELECT avg(v) FROM tok x WHERE x.row_id = s.row_id AND x.t > e AND x.t <= e + 30) - (SELECT avg(v) FROM tok x WHERE x.row_id = s.row_id AND x.t < s AND x.t >= s.s - 30) AS jump FROM s JOIN e USING (row_id, k)) SELECT row_id, round(avg(jump), 9) AS jump FROM j WHERE jump IS NOT NULL GROUP BY row_id""")
def value_jump(spark, sf):
    return sequence.value_jump(sequences(spark, sf), "row_id", "vs", "tools", 30).select("row_id", F.round("jump", 9).alias("jump"))


@query()
def random_mask(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", sequence.random_mask(F.lit(16), F.col("o_orderkey")).alias("mask"))
