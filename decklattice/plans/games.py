"""Rates, averages and labels: orders as games, their lines as copies of cards in a deck."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decks, rates, store
from ..operators.rates import RateSpec
from .registry import Tables, query


IN_DECK = "SELECT DISTINCT l_orderkey, l_partkey, o_orderstatus = 'F' AS won, o_totalprice, o_orderpriority, o_custkey, date_part('year', o_orderdate) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def won():
    return F.col("o_orderstatus") == "F"


def in_deck(t: Tables):
    """One row per game and card; the wide side of the join is shuffled once, by game."""
    pairs = rates.presence(t.lineitem, ["l_orderkey"], "l_partkey")
    games = t.orders.select("o_orderkey", won().alias("won"), "o_totalprice", "o_orderpriority", "o_custkey", "o_orderdate")
    return pairs.join(games, F.col("l_orderkey") == F.col("o_orderkey"))


def copies(t: Tables):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))


@query("win_rate_when_in_deck", f"SELECT l_partkey, avg(CASE WHEN won THEN 1.0::DOUBLE ELSE 0.0 END) AS label, count(*) AS sample_count FROM ({IN_DECK}) GROUP BY 1")
def win_rate_when_in_deck(t: Tables):
    return rates.rate(in_deck(t), RateSpec(["l_partkey"], F.col("won").cast("int")))


@query("win_rate_delta_to_baseline", f"SELECT l_partkey, round(avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders), 4) AS delta, count(*) AS sample_count FROM ({IN_DECK}) GROUP BY 1")
def game_length_association(t: Tables):
    out = rates.delta_to_mean(in_deck(t), "l_partkey", F.col("o_totalprice"), t.orders, F.col("o_totalprice"))
    return out.withColumn("delta", F.round("delta", 4))


@query("on_play_win_rate_delta", f"""WITH s AS (SELECT l_partkey, sum((o_custkey % 2 = 0)::INT) n1, sum((o_custkey % 2 <> 0)::INT) n2, sum((o_custkey % 2 = 0 AND won)::INT) h1, sum((o_custkey % 2 <> 0 AND won)::INT) h2 FROM ({IN_DECK}) GROUP BY 1)
SELECT l_partkey, CASE WHEN n1 > 0 AND n2 > 0 THEN round(h1::DOUBLE / n1 - h2::DOUBLE / n2, 9) END AS delta, CAST(n1 + n2 AS BIGINT) AS sample_count FROM s""")
def on_play_win_rate_delta(t: Tables):
    out = rates.side_delta(in_deck(t), ["l_partkey"], F.col("o_custkey") % 2 == 0, F.col("won"))
    return out.withColumn("delta", F.round("delta", 9))


@query("mean_per_copy", "SELECT l_partkey, round(avg(o_totalprice), 4) AS label, count(*) AS sample_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def mean_per_copy(t: Tables):
    return rates.mean_per_copy(copies(t), "l_partkey", F.col("o_totalprice")).withColumn("label", F.round("label", 4))


@query("win_rate_per_copy", "SELECT l_partkey, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS label, count(*) AS sample_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def win_rate_per_copy(t: Tables):
    return rates.mean_per_copy(copies(t), "l_partkey", won().cast("int"))


@query("upgrade_rate", "SELECT l_partkey, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS label, count(*) AS sample_count FROM lineitem GROUP BY 1")
def upgrade_rate(t: Tables):
    return rates.mean_per_copy(t.lineitem, "l_partkey", (F.col("l_returnflag") == "R").cast("int"))


@query("win_rate_at_act", "SELECT l_partkey, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS label, count(*) AS sample_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 GROUP BY 1")
def win_rate_at_act(t: Tables):
    return rates.mean_per_copy(copies(t).where("l_linenumber <= 2"), "l_partkey", won().cast("int"))


@query("share_by_class", "SELECT l_partkey, avg((l_returnflag='A')::INT::DOUBLE) AS \"A\", avg((l_returnflag='N')::INT::DOUBLE) AS \"N\", avg((l_returnflag='R')::INT::DOUBLE) AS \"R\", count(*) AS sample_count FROM lineitem GROUP BY 1")
def share_by_class(t: Tables):
    return rates.share_by_class(t.lineitem, "l_partkey", "l_returnflag", ["A", "N", "R"])


PICK = "SELECT l_orderkey, l_partkey, l_linenumber, o_orderpriority, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1 AS picked FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def picks(t: Tables):
    """Options of each draft with whether they were picked: the dearest line."""
    best = t.lineitem.groupBy("l_orderkey").agg(F.max(F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("b"))
    rows = t.lineitem.join(best, "l_orderkey").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.withColumn("picked", (F.col("l_linenumber") == -F.col("b.col2")) & (F.col("l_extendedprice") == F.col("b.l_extendedprice")))


@query("take_rate", f"SELECT l_partkey, l_linenumber, avg(picked::INT::DOUBLE) AS label, count(*) AS sample_count FROM ({PICK}) GROUP BY 1, 2")
def take_rate(t: Tables):
    return rates.rate(picks(t), RateSpec(["l_partkey", "l_linenumber"], F.col("picked").cast("int")))


@query("first_pick_rate", f"SELECT l_partkey, avg(picked::INT::DOUBLE) AS label, count(*) AS sample_count FROM ({PICK}) WHERE l_linenumber = 1 GROUP BY 1")
def first_pick_rate(t: Tables):
    return rates.rate(picks(t), RateSpec(["l_partkey"], F.col("picked").cast("int"), where=F.col("l_linenumber") == 1))


@query("rank_stratified_take_rate", f"SELECT l_partkey, o_orderpriority, avg(picked::INT::DOUBLE) AS label, count(*) AS sample_count FROM ({PICK}) WHERE o_orderpriority IS NOT NULL AND o_orderpriority <> '' GROUP BY 1, 2")
def rank_stratified_take_rate(t: Tables):
    known = F.col("o_orderpriority").isNotNull() & (F.col("o_orderpriority") != "")
    return rates.rate(picks(t), RateSpec(["l_partkey", "o_orderpriority"], F.col("picked").cast("int"), where=known))


@query("pick_decay_curve", f"""WITH s AS (SELECT o_orderpriority, least(l_linenumber, 4) AS pos, avg(picked::INT::DOUBLE) AS r, count(*) AS n FROM ({PICK}) GROUP BY 1, 2)
SELECT o_orderpriority, {', '.join(f'max(CASE WHEN pos = {i} THEN r END) AS r{i}, coalesce(max(CASE WHEN pos = {i} THEN n END), 0) AS n{i}' for i in range(5))} FROM s GROUP BY 1""")
def pick_decay_curve(t: Tables):
    c = rates.curve(picks(t), ["o_orderpriority"], F.col("l_linenumber"), 5, F.col("picked").cast("int"), F.lit(1))
    return c.select("o_orderpriority", *[F.get("rates", i).alias(f"r{i}") for i in range(5)], *[F.get("sample_counts", i).alias(f"n{i}") for i in range(5)])


@query("pack_to_pick_choice_set", f"""SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey::VARCHAR) AS options, max(CASE WHEN picked THEN l_partkey END)::VARCHAR AS pick FROM ({PICK}) GROUP BY 1""")
def pack_to_pick_choice_set(t: Tables):
    out = decks.options_and_pick(picks(t), ["l_orderkey"], "l_partkey", "l_linenumber", F.col("picked"))
    return out.withColumn("options", F.array_join("options", ","))


@query("deck_occurrence_count", """WITH d AS (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS deck FROM lineitem GROUP BY 1),
p AS (SELECT date_part('year', o_orderdate) AS y, deck, count(DISTINCT o_custkey) AS n FROM d JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT deck, CAST(sum(n) AS BIGINT) AS "count" FROM p GROUP BY 1""")
def deck_occurrence_count(t: Tables):
    bags = decks.decks_of(t.lineitem, ["l_orderkey"], "l_partkey").select("l_orderkey", F.array_join("cards", ",").alias("deck"))
    rows = bags.join(t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y")), F.col("l_orderkey") == F.col("o_orderkey"))
    return rates.distinct_then_sum(rows, ["y"], "deck", "o_custkey")


LEGAL = """g AS (SELECT DISTINCT l_orderkey, l_partkey, n_regionkey AS grp FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
size AS (SELECT grp, count(DISTINCT l_orderkey) AS decks FROM g GROUP BY 1), inc AS (SELECT grp, l_partkey, count(*) AS n FROM g GROUP BY 1, 2),
legal AS (SELECT grp, p_partkey AS l_partkey, decks FROM size, part WHERE (p_partkey + grp) % 4 <> 0)"""


def _inclusion(t: Tables):
    games = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    g = t.lineitem.select("l_orderkey", "l_partkey").distinct().join(games.select("o_orderkey", F.col("n_regionkey").alias("grp")), F.col("l_orderkey") == F.col("o_orderkey"))
    size = g.groupBy("grp").agg(F.count_distinct("l_orderkey").alias("decks"))
    included = g.groupBy("grp", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    groups = t.region.count()
    legal = t.part.select(F.col("p_partkey").alias("l_partkey"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")).where("(l_partkey + grp) % 4 <> 0").join(F.broadcast(size), "grp")
    return included, legal


@query("conditional_inclusion_rate", f"""WITH {LEGAL} SELECT l_partkey, CAST(sum(coalesce(n,0)) AS DOUBLE) / sum(decks) AS inclusion_rate, CAST(sum(decks) AS BIGINT) AS legal_deck_count, CAST(sum(coalesce(n,0)) AS BIGINT) AS included_deck_count
FROM legal LEFT JOIN inc USING (grp, l_partkey) GROUP BY 1 HAVING sum(coalesce(n,0)) > 0""")
def conditional_inclusion_rate(t: Tables):
    included, legal = _inclusion(t)
    return rates.conditional_inclusion(included, legal, "grp", "l_partkey")


@query("inclusion_by_group", f"""WITH {LEGAL}, s AS (SELECT l_partkey, grp, coalesce(n,0)::DOUBLE / decks AS r FROM legal LEFT JOIN inc USING (grp, l_partkey)), k AS (SELECT l_partkey FROM legal JOIN inc USING (grp, l_partkey) GROUP BY 1)
SELECT l_partkey, {', '.join(f'max(CASE WHEN grp = {g} THEN r END) AS g{g}' for g in range(5))} FROM s SEMI JOIN k USING (l_partkey) GROUP BY 1""")
def inclusion_by_group(t: Tables):
    included, legal = _inclusion(t)
    out = rates.inclusion_by_group(included, legal, "grp", "l_partkey", list(range(5)))
    return out.select("l_partkey", *[F.get("inclusion_rate_by_group", g).alias(f"g{g}") for g in range(5)])


@query("deck_labels_by_content", """WITH d AS (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS cards FROM lineitem GROUP BY 1) SELECT l_orderkey, cards, o_orderstatus = 'F' AS label FROM d JOIN orders ON l_orderkey = o_orderkey""")
def deck_labels_by_content(t: Tables):
    bags = decks.decks_of(t.lineitem, ["l_orderkey"], "l_partkey")
    labels = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), won().alias("label"))
    return bags.select("l_orderkey", F.array_join("cards", ",").alias("cards")).join(labels, "l_orderkey")


BAGS = """SELECT l_orderkey, list_sort(list(l_partkey::VARCHAR)) AS cards FROM lineitem GROUP BY 1"""
#: The version 5 identifier of a bag: the same bytes as the engine's, written out.
DECK_UUID = f"""SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (CAST('0x' || substr(h, 17, 1) AS INT) % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS deck_uuid
FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(array_to_string(cards, ','))) AS h FROM ({BAGS}))"""


@query("deck_uuids", f"SELECT l_orderkey, deck_uuid FROM ({DECK_UUID})")
def deck_uuids(t: Tables):
    return decks.decks_of(t.lineitem, ["l_orderkey"], "l_partkey").select("l_orderkey", "deck_uuid")


@query("deck_card_counts", """WITH n AS (SELECT l_orderkey, l_partkey, least(count(*), 255) AS n FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(l_partkey || 'x' || n, ',' ORDER BY l_partkey) AS entries FROM n GROUP BY 1""")
def deck_card_counts(t: Tables):
    c = decks.card_counts(t.lineitem, ["l_orderkey"], "l_partkey")
    return c.select("l_orderkey", F.array_join(F.transform("entries", lambda e: F.concat_ws("x", e["card"].cast("string"), e["n"].cast("string"))), ",").alias("entries"))


@query("deck_masked_card", f"""WITH d AS ({DECK_UUID}), t AS (SELECT l_orderkey, cards, arg_min(card, sha256('mask:' || deck_uuid || ':' || card)) AS target_card FROM (SELECT l_orderkey, cards, deck_uuid, unnest(list_distinct(cards)) AS card FROM d) GROUP BY ALL)
SELECT l_orderkey, target_card, array_to_string(list_concat(cards[:list_position(cards, target_card) - 1], cards[list_position(cards, target_card) + 1:]), ',') AS rest FROM t""")
def deck_masked_card(t: Tables):
    return decks.masked_card(decks.decks_of(t.lineitem, ["l_orderkey"], "l_partkey"), "mask").select("l_orderkey", "target_card", F.array_join("rest", ",").alias("rest"))


@query("deck_pair_winner", """WITH g AS (SELECT o_custkey, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY 1 HAVING count(*) = 2)
SELECT g.o_custkey, a AS lo, b AS hi, x.o_totalprice > y.o_totalprice AS lo_won FROM g JOIN orders x ON x.o_orderkey = a JOIN orders y ON y.o_orderkey = b""")
def deck_pair_winner(t: Tables):
    g = t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("s")).where(F.size("s") == 2)
    rows = g.select("o_custkey", F.col("s")[1]["o_orderkey"].alias("a"), F.col("s")[0]["o_orderkey"].alias("b"), (F.col("s")[1]["o_totalprice"] > F.col("s")[0]["o_totalprice"]).alias("won"))
    pairs = decks.canonical_pair(rows, "a", "b", F.col("won"))
    return pairs.join(rows.select("o_custkey", F.least("a", "b").alias("lo")), "lo").select("o_custkey", "lo", "hi", "lo_won")


@query("guide_votes_signed_log", "SELECT o_orderkey, round(sign(o_totalprice - 100000) * ln(1 + abs(o_totalprice - 100000)), 9) AS label FROM orders")
def guide_votes(t: Tables):
    from ..functions.scalars import signed_log

    return t.orders.select("o_orderkey", F.round(signed_log(F.col("o_totalprice") - 100000), 9).alias("label"))


@query("deck_snapshot", """WITH i AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS ix FROM part WHERE p_partkey % 7 <> 0), n AS (SELECT l_orderkey, coalesce(ix, 999999) AS ix, least(count(*), 255) AS n FROM lineitem LEFT JOIN i ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT l_orderkey, string_agg(ix || ':' || n, ',' ORDER BY ix) AS cards FROM n GROUP BY 1""")
def deck_snapshot(t: Tables):
    index = store.dense_index(t.part.where("p_partkey % 7 <> 0"), "p_partkey", most=10**7)
    s = store.deck_snapshot(t.lineitem, index, "l_orderkey", "l_partkey", 999999)
    return s.select("l_orderkey", F.array_join(F.transform("cards", lambda e: F.concat_ws(":", e["card_index"].cast("string"), e["count"].cast("string"))), ",").alias("cards"))


@query("mergeable_count_tables", f"SELECT l_partkey, avg(CASE WHEN won THEN 1.0::DOUBLE ELSE 0.0 END) AS label, count(*) AS sample_count FROM ({IN_DECK}) GROUP BY 1")
def mergeable_count_tables(t: Tables):
    spec = RateSpec(["l_partkey"], F.col("won").cast("int"))
    rows = in_deck(t)
    return rates.finished([rates.counts(rows.where("year(o_orderdate) < 1997"), spec), rates.counts(rows.where("year(o_orderdate) >= 1997"), spec)], ["l_partkey"])


@query("compare_outputs", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 4 THEN 'only_a' ELSE 'differs' END AS kind FROM lineitem GROUP BY 1, 2 HAVING l_linenumber > 4 OR max(l_quantity) > 25")
def compare_outputs(t: Tables):
    b = t.lineitem.where("l_linenumber <= 4").withColumn("l_quantity", F.when(F.col("l_quantity") > 25, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    keys = ["l_orderkey", "l_linenumber"]
    one = lambda f: f.groupBy(*keys).agg(F.max("l_quantity").alias("l_quantity"))
    out = store.compare(one(t.lineitem), one(b), keys, ["l_quantity"], 0.5)
    return out
