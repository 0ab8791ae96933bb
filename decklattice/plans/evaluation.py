"""Co-occurrence, neighbours, evaluation, losses, splits and training views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, scalars
from ..operators import decks, losses, sampling, views
from ..operators import similarity as sim
from .games import PICK, picks
from .registry import Tables, query

PAIRS = "WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), x AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*)::DOUBLE AS weight FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2)"


@query("cooccurrence", f"{PAIRS} SELECT * FROM x")
def cooccurrence(t: Tables):
    return sim.cooccurrence(t.lineitem, "l_orderkey", "l_partkey")


@query("ppmi", f"""{PAIRS}, r AS (SELECT a, sum(weight) AS na FROM x GROUP BY 1), k AS (SELECT sum(na) AS n, sum(pow(na, 0.75)) AS z FROM r)
SELECT x.a, x.b, round(ln(weight / n) - ln(ra.na / n) - ln(pow(rb.na, 0.75) / z), 6) AS ppmi FROM x JOIN r ra ON x.a = ra.a JOIN r rb ON x.b = rb.a, k WHERE ln(weight / n) - ln(ra.na / n) - ln(pow(rb.na, 0.75) / z) > 0""")
def ppmi(t: Tables):
    return sim.ppmi(sim.cooccurrence(t.lineitem, "l_orderkey", "l_partkey")).withColumn("ppmi", F.round("ppmi", 6))


@query("nearest_neighbours")
def nearest_neighbours(t: Tables):
    return sim.neighbours(t.embeddings, "vec_id", "embedding", 5, F.col("vec_id") % 50 == 0)


@query("retrieval_auc", """WITH v AS (SELECT event_type, value, count(*) AS n, count(*) FILTER (user_id % 2 = 0) AS pos FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY value) - (n - 1) / 2 AS place FROM v)
SELECT event_type, round((sum(pos * place)::DOUBLE - sum(pos)::DOUBLE * (sum(pos)::DOUBLE + 1) / 2) / (sum(pos)::DOUBLE * sum(n - pos)::DOUBLE), 9) AS auc FROM r GROUP BY 1""")
def retrieval_auc(t: Tables):
    return sim.auc(t.events, ["event_type"], "value", F.col("user_id") % 2 == 0).select("event_type", F.round("auc", 9).alias("auc"))


@query("cluster_agreement")
def cluster_agreement(t: Tables):
    return sim.agreement(sim.cluster(t.embeddings, "embedding", 8), "label", "cluster")


@query("label_agreement", """WITH t AS (SELECT p_type a, p_brand b, count(*)::DOUBLE n FROM part GROUP BY 1,2), tt AS (SELECT sum(n) t, sum(n*(n-1)/2) cells FROM t), ra AS (SELECT a, sum(n) na FROM t GROUP BY 1), rb AS (SELECT b, sum(n) nb FROM t GROUP BY 1),
sa AS (SELECT sum(na*(na-1)/2) pa, -sum(na/t*ln(na/t)) ha FROM ra, tt), sb AS (SELECT sum(nb*(nb-1)/2) pb, -sum(nb/t*ln(nb/t)) hb FROM rb, tt), mi AS (SELECT sum(n/tt.t*ln(n*tt.t/(na*nb))) mi FROM t JOIN ra USING (a) JOIN rb USING (b), tt)
SELECT round((cells - pa*pb/(t*(t-1)/2)) / ((pa+pb)/2 - pa*pb/(t*(t-1)/2)), 9) AS ari, round(2*mi/(ha+hb), 9) AS nmi FROM tt, sa, sb, mi""")
def label_agreement(t: Tables):
    return sim.agreement(t.part, "p_type", "p_brand").select(F.round("ari", 9).alias("ari"), F.round("nmi", 9).alias("nmi"))


@query("centroid_accuracy")
def centroid_accuracy(t: Tables):
    return sim.centroid_accuracy(t.embeddings, "vec_id", "embedding", "label")


@query("effective_rank")
def effective_rank(t: Tables):
    return sim.effective_rank(t.embeddings, "embedding")


@query("unit_length", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, 1.0::DOUBLE AS scaled FROM embeddings")
def unit_length(t: Tables):
    v = t.embeddings.withColumn("u", scalars.unit_length(F.col("embedding")))
    return v.select("vec_id", F.round(F.sqrt(scalars.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.round(F.sqrt(scalars.dot(F.col("u"), F.col("u"))), 6).alias("scaled"))


@query("document_frequency", "WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT l_partkey, count(*) AS decks, count(*)::DOUBLE / (SELECT count(DISTINCT l_orderkey) FROM d) AS df FROM d GROUP BY 1")
def document_frequency(t: Tables):
    return sampling.document_frequency(t.lineitem, "l_orderkey", "l_partkey")


@query("holdout_buckets", "SELECT o_orderkey, CASE WHEN b < 3435973836 THEN 'train' WHEN b < 3865470566 THEN 'validation' ELSE 'test' END AS split FROM (SELECT o_orderkey, CAST('0x' || substr(sha256('seed:' || o_orderkey::VARCHAR), 9, 8) AS BIGINT) AS b FROM orders)")
def holdout_buckets(t: Tables):
    return t.orders.select("o_orderkey", hashing.split_of("seed", F.col("o_orderkey"), {"train": 8, "validation": 1, "test": 1}).alias("split"))


@query("seeded_rank", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('s:' || o_orderkey::VARCHAR)) AS INTEGER) AS rank FROM orders")
def seeded_rank(t: Tables):
    return sampling.ranked(t.orders, "s", "o_orderkey", ["o_orderstatus"]).select("o_orderkey", "rank")


@query("per_label_cap", "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('c:' || vec_id::VARCHAR), vec_id) AS r FROM embeddings) WHERE r <= 20")
def per_label_cap(t: Tables):
    return sampling.capped(t.embeddings.select("vec_id", "label"), "c", "vec_id", ["label"], 20)


@query("held_out_cards")
def held_out_cards(t: Tables):
    return sampling.held_out(t.lineitem, "h", "l_orderkey", "l_partkey", 7, 0.001).withColumn("decoys", F.array_join("decoys", ","))


@query("staple_thinning", """WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), n AS (SELECT count(DISTINCT l_orderkey) AS total FROM p), f AS (SELECT l_partkey, count(*)::DOUBLE / max(total) AS df FROM p, n GROUP BY 1)
SELECT l_orderkey, l_partkey FROM p JOIN f USING (l_partkey) WHERE CAST('0x' || substr(sha256('thin:' || l_orderkey::VARCHAR || ':' || l_partkey::VARCHAR), 9, 8) AS BIGINT) / 4294967296.0::DOUBLE < least(1.0::DOUBLE, sqrt(0.0005::DOUBLE / df))""")
def staple_thinning(t: Tables):
    freq = sampling.document_frequency(t.lineitem, "l_orderkey", "l_partkey")
    return sampling.thinned(t.lineitem.select("l_orderkey", "l_partkey").distinct(), freq, "thin", "l_orderkey", "l_partkey", 0.0005)


@query("temperature_shares", "WITH c AS (SELECT n_name, count(*)::DOUBLE AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT n_name, round(pow(n, 0.5) / sum(pow(n, 0.5)) OVER (), 9) AS share FROM c")
def temperature_shares(t: Tables):
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
    return sampling.temperature_shares(c, "n_name", "n", 0.5).withColumn("share", F.round("share", 9))


@query("spread_order", "SELECT range AS position, (7 + range * 37) % 1000 + 1 AS id FROM range(1000)")
def spread_order(t: Tables):
    return sampling.spread_order(1000, 37, 7, t._spark)


@query("balanced_draws", """WITH n AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY sha256('b:' || p_partkey::VARCHAR), p_partkey) AS rn FROM part),
g AS (SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY p_type) - 1 AS g, count(*) OVER () AS groups FROM part GROUP BY 1),
d AS (SELECT range AS draw, CAST('0x' || substr(sha256('bg:' || range::VARCHAR), 9, 8) AS BIGINT) AS x, CAST('0x' || substr(sha256('bi:' || range::VARCHAR), 9, 8) AS BIGINT) AS y FROM range(500))
SELECT draw, p_type, p_partkey FROM d JOIN g ON g.g = d.x % g.groups JOIN n USING (p_type) WHERE rn = y % n + 1""")
def balanced_draws(t: Tables):
    return sampling.balanced_draws(t.part.select("p_type", "p_partkey"), "b", "p_type", "p_partkey", 500)


@query("weighted_choice", """SELECT p_partkey, CASE WHEN u < 0.2::DOUBLE THEN 'keep' WHEN u < 0.8::DOUBLE THEN 'mask' ELSE 'shuffle' END AS mod
FROM (SELECT p_partkey, CAST('0x' || substr(sha256('w:' || p_partkey::VARCHAR), 9, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM part)""")
def weighted_choice(t: Tables):
    table = t._spark.createDataFrame([("mask", 3.0), ("keep", 1.0), ("shuffle", 1.0)], "mod string, w double")
    return sampling.weighted_choice(t.part.select("p_partkey"), table, "w", "p_partkey", "mod", "w")


@query("budgeted_batches")
def budgeted_batches(t: Tables):
    rows = t.lineitem.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_quantity").cast("long").alias("cost"))
    return sampling.packed(rows, "l_suppkey", "at", "cost", 200)


@query("loss_bce_mse_huber", """SELECT round(avg(ln(1 + exp(-abs(z))) + greatest(z, 0) - z * y), 9) AS bce, round(avg((z - y) * (z - y)), 9) AS mse, round(avg(CASE WHEN abs(z - y) <= 1.345 THEN (z-y)*(z-y) ELSE 2 * 1.345 * abs(z - y) - 1.345 * 1.345 END), 9) AS huber
FROM (SELECT l_discount * 20 - 1 AS z, (l_returnflag = 'R')::INT::DOUBLE AS y FROM lineitem)""")
def loss_bce_mse_huber(t: Tables):
    r = t.lineitem.select((F.col("l_discount") * 20 - 1).alias("z"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    z, y = F.col("z"), F.col("y")
    return r.agg(F.round(losses.bce(z, y), 9).alias("bce"), F.round(losses.mse(z, y), 9).alias("mse"), F.round(losses.huber(z, y), 9).alias("huber"))


@query("loss_class_prior", "WITH n AS (SELECT p_type, count(*)::DOUBLE AS n FROM part GROUP BY 1) SELECT round(-sum(n / t * ln(n / t)), 9) AS baseline FROM n, (SELECT sum(n) AS t FROM n)")
def loss_class_prior(t: Tables):
    return losses.entropy_baseline(t.part, "p_type").select(F.round("baseline", 9).alias("baseline"))


@query("loss_uniform_options", "WITH n AS (SELECT l_orderkey, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1) SELECT round(avg(ln(n)), 9) AS baseline FROM n")
def loss_uniform_options(t: Tables):
    packs = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("options"))
    return losses.uniform_baseline(packs, "options").select(F.round("baseline", 9).alias("baseline"))


@query("loss_softmax_options", "WITH r AS (SELECT l_orderkey, l_discount * 10 AS z, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount) AS rn FROM lineitem), n AS (SELECT l_orderkey, ln(sum(exp(z))) AS lse, max(CASE WHEN rn = 1 THEN z END) AS own FROM r GROUP BY 1) SELECT round(avg(lse - own), 6) AS loss FROM n")
def loss_softmax_options(t: Tables):
    packs = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_discount") * 10).alias("z")))), lambda e: e["z"]).alias("z"))
    return packs.agg(F.round(losses.cross_entropy(F.col("z"), F.lit(0)), 6).alias("loss"))


@query("standardised_labels", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS z FROM orders")
def standardised_labels(t: Tables):
    stats = losses.label_stats(t.orders, F.col("o_totalprice"))
    return losses.standardised(F.col("o_totalprice"), stats, t.orders, "z").select("o_orderkey", F.round("z", 6).alias("z"))


@query("view_single_card", "SELECT p_partkey, p_type, avg(l_quantity) AS label FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 25 GROUP BY 1, 2")
def view_single_card(t: Tables):
    metric = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("label"))
    return views.card_view(metric, t.part.select("p_partkey", "p_type", "p_size"), "p_partkey", F.col("p_size") <= 25).drop("p_size")


@query("view_deck", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS cards, max(o_totalprice) AS label FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_size <= 25 GROUP BY 1")
def view_deck(t: Tables):
    bags = decks.decks_of(t.lineitem, ["l_orderkey"], "l_partkey")
    cards = t.part.select(F.col("p_partkey").cast("string").alias("card"), "p_size")
    metric = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("label"))
    out = views.deck_view(metric, bags, cards, "l_orderkey", "card", F.col("p_size") <= 25)
    return out.withColumn("cards", F.array_join("cards", ","))


@query("view_options", f"""WITH k AS ({PICK}), x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey::VARCHAR, picked) - 1 AS place FROM k),
p AS (SELECT l_orderkey, arg_min(l_partkey, place) AS part FROM x WHERE picked GROUP BY 1) SELECT l_orderkey, min(place) AS pick_index FROM x JOIN p USING (l_orderkey) WHERE l_partkey = part GROUP BY 1""")
def view_options(t: Tables):
    rows = decks.options_and_pick(picks(t), ["l_orderkey"], "l_partkey", "l_linenumber", F.col("picked"))
    return views.option_view(rows, "options", "pick").select("l_orderkey", "pick_index")


@query("view_deck_pairs", """WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY sha256('p:' || l_partkey::VARCHAR), l_partkey) AS r FROM p)
SELECT a.l_orderkey, a.l_partkey AS a, b.l_partkey AS b FROM s a JOIN s b USING (l_orderkey) WHERE a.r <= 4 AND b.r <= 4 AND a.l_partkey <> b.l_partkey""")
def view_deck_pairs(t: Tables):
    return views.same_deck_pairs(t.lineitem.select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", 4, "p")


@query("view_slices")
def view_slices(t: Tables):
    bags = decks.decks_of(t.lineitem, ["l_orderkey"], "l_partkey")
    return views.missing_card(bags, "m", 2).withColumn("slice", F.array_join("slice", ","))


@query("rounds_best", "SELECT l_suppkey AS name, CAST(arg_min(r, struct_pack(l := loss, r := r)) AS INTEGER) AS best_round, min(loss) AS best_loss FROM (SELECT l_suppkey, l_linenumber AS r, avg(l_discount) AS loss FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def rounds_best(t: Tables):
    r = t.lineitem.groupBy(F.col("l_suppkey").alias("name"), F.col("l_linenumber").alias("round")).agg(F.avg("l_discount").alias("loss"))
    return views.best_round(r, "name", "loss")


@query("rounds_saturated", """WITH r AS (SELECT l_suppkey AS name, l_linenumber AS round, avg(l_discount) AS loss FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, coalesce(loss < min(loss) OVER (PARTITION BY name ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 0.001, true) AS better FROM r)
SELECT name, round, count(*) OVER w = 2 AND NOT bool_or(better) OVER w AS saturated FROM b WINDOW w AS (PARTITION BY name ORDER BY round ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""")
def rounds_saturated(t: Tables):
    r = t.lineitem.groupBy(F.col("l_suppkey").alias("name"), F.col("l_linenumber").alias("round")).agg(F.avg("l_discount").alias("loss"))
    return views.saturated(r, "name", "loss", 2, 0.001)
