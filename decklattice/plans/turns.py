"""Turn events: users as games, event order as turns, event types as fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import rates
from .registry import Tables, query

TURN = "SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS card, CAST(event_id // 100 AS BIGINT) AS turn FROM events"


def turns(t: Tables):
    card = F.get_json_object("props", "$.k").cast("long")
    return t.events.withColumns({"card": card, "turn": F.floor(F.col("event_id") / 100).cast("long")})


@query("average_turn_cast", f"SELECT card, avg(turn::DOUBLE) AS label, count(*) AS sample_count FROM ({TURN}) WHERE event_type = 'click' GROUP BY 1")
def average_turn_cast(t: Tables):
    return rates.mean_per_copy(turns(t).where("event_type = 'click'"), "card", F.col("turn"))


@query("combat_hit_rate", f"""WITH e AS ({TURN}), h AS (SELECT DISTINCT user_id, turn FROM e WHERE event_type = 'error'), a AS (SELECT DISTINCT user_id, turn, card FROM e WHERE event_type = 'click')
SELECT card, avg(CASE WHEN h.turn IS NULL THEN 0.0::DOUBLE ELSE 1 END) AS rate, count(*) AS sample_count FROM a LEFT JOIN h USING (user_id, turn) GROUP BY 1""")
def combat_hit_rate(t: Tables):
    e = turns(t)
    return ev.hit_rate(e.where("event_type = 'click'"), e.where("event_type = 'error'"), ["user_id", "turn"], "card")


@query("push_through_rate", f"""WITH e AS ({TURN}), h AS (SELECT DISTINCT user_id, turn FROM e WHERE event_type = 'error')
SELECT card, avg(CASE WHEN h.turn IS NULL THEN 0.0::DOUBLE ELSE 1 END) AS rate, count(*) AS sample_count FROM e LEFT JOIN h USING (user_id, turn) WHERE event_type = 'click' GROUP BY 1""")
def push_through_rate(t: Tables):
    e = turns(t)
    return ev.hit_rate(e.where("event_type = 'click'"), e.where("event_type = 'error'"), ["user_id", "turn"], "card", distinct_events=False)


@query("turns_after_first_cast", f"WITH e AS ({TURN}), f AS (SELECT user_id, card, min(turn) AS f FROM e WHERE event_type = 'click' GROUP BY 1, 2), g AS (SELECT user_id, max(turn) AS n FROM e GROUP BY 1) SELECT card, avg((n - f)::DOUBLE) AS label, count(*) AS sample_count FROM f JOIN g USING (user_id) GROUP BY 1")
def turns_after_first_cast(t: Tables):
    e = turns(t)
    first = ev.first_turn(e.where("event_type = 'click'"), ["user_id"], "card")
    last = e.groupBy("user_id").agg(F.max("turn").alias("n"))
    return rates.mean_per_copy(first.join(last, "user_id"), "card", F.col("n") - F.col("first_turn"))


@query("next_turn_action_count", f"WITH c AS (SELECT user_id, turn, count(*) AS actions FROM ({TURN}) GROUP BY 1, 2) SELECT a.user_id, a.turn, a.actions, b.actions AS next_actions FROM c a JOIN c b ON a.user_id = b.user_id AND b.turn = a.turn + 1")
def next_turn_action_count(t: Tables):
    c = turns(t).groupBy("user_id", "turn").agg(F.count(F.lit(1)).alias("actions"))
    return ev.next_turn(c, ["user_id"], "turn", "actions")


@query("deck_before_turn", f"""WITH e AS (SELECT user_id, card, turn, event_id, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS d FROM ({TURN})),
s AS (SELECT *, sum(d) OVER w AS total FROM e WINDOW w AS (PARTITION BY user_id, card ORDER BY turn, event_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, least(min(total) OVER (PARTITION BY user_id, card ORDER BY turn, event_id ROWS UNBOUNDED PRECEDING), 0) AS low FROM s)
SELECT user_id, card, turn, CAST(arg_max(total - low, event_id) AS BIGINT) AS held_after FROM m GROUP BY 1, 2, 3""")
def deck_before_turn(t: Tables):
    e = turns(t).withColumn("d", F.when(F.col("event_type") == "error", -1).otherwise(1))
    return ev.deck_before(e, ["user_id"], "card", "turn", "event_id", "d")


@query("held_at_floor", f"""WITH i AS (SELECT user_id, card, min(turn) AS floor_added, CASE WHEN count(*) > 1 THEN max(turn) END AS floor_left FROM ({TURN}) GROUP BY 1, 2), m AS (SELECT DISTINCT user_id, turn AS floor FROM ({TURN}))
SELECT m.user_id, floor, card, floor_added, floor_left FROM m JOIN i ON m.user_id = i.user_id AND floor_added < floor AND (floor_left IS NULL OR floor_left >= floor)""")
def held_at_floor(t: Tables):
    e = turns(t)
    n = F.count(F.lit(1))
    i = e.groupBy("user_id", "card").agg(F.min("turn").alias("floor_added"), F.when(n > 1, F.max("turn")).alias("floor_left"))
    m = e.select("user_id", F.col("turn").alias("floor")).distinct()
    return ev.held_at(i, m, ["user_id"])


@query("zone_presence_wide", """WITH z AS (SELECT l_orderkey, l_linenumber, l_quantity::INT % 3 AS zone_a, l_suppkey % 2 AS zone_a2, l_linenumber % 2 AS zone_b FROM lineitem),
u AS (SELECT l_orderkey, l_linenumber, 'a' AS card, zone_a AS n FROM z UNION ALL SELECT l_orderkey, l_linenumber, 'a', zone_a2 FROM z UNION ALL SELECT l_orderkey, l_linenumber, 'b', zone_b FROM z)
SELECT l_orderkey, l_linenumber, card, CAST(max(n) AS INTEGER) AS n FROM u WHERE n > 0 GROUP BY 1, 2, 3""")
def zone_presence_wide(t: Tables):
    z = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 3).alias("zone_a"), (F.col("l_suppkey") % 2).alias("zone_a2"), (F.col("l_linenumber") % 2).alias("zone_b"))
    return ev.zone_presence(z, ["l_orderkey", "l_linenumber"], {"zone_a": "a", "zone_a2": "a", "zone_b": "b"})


@query("melt_turn_columns", """WITH w AS (SELECT user_id, string_agg(CASE WHEN event_type='click' THEN event_id::VARCHAR END, '|' ORDER BY event_id) AS c1, string_agg(CASE WHEN event_type='error' THEN event_id::VARCHAR END, '|' ORDER BY event_id) AS c2 FROM events GROUP BY 1)
SELECT user_id, 'user' AS actor, 1 AS turn, unnest(string_split(c1,'|')) AS card FROM w WHERE c1 IS NOT NULL UNION ALL SELECT user_id, 'oppo', 2, unnest(string_split(c2,'|')) FROM w WHERE c2 IS NOT NULL""")
def melt_turn_columns(t: Tables):
    of = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.col("event_id")))), lambda x: x.cast("string")), "|")
    wide = t.events.groupBy("user_id").agg(of("click").alias("c1"), of("error").alias("c2"))
    return ev.melt_turns(wide, ["user_id"], {"c1": ("user", 1), "c2": ("oppo", 2)})


@query("net_combat_outcome", f"SELECT user_id, turn, CAST(sum(CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS BIGINT) AS net FROM ({TURN}) GROUP BY 1, 2")
def net_combat_outcome(t: Tables):
    return ev.net_outcome(turns(t), ["user_id", "turn"], "event_type", ["click"], ["error"])


@query("exclusion_tally", "SELECT CASE WHEN value IS NULL THEN 'no value' WHEN value > 20 THEN 'too large' WHEN event_type = 'error' THEN 'failed' END AS reason, count(*) AS n FROM events GROUP BY 1")
def exclusion_tally(t: Tables):
    reason = ev.exclusion_reason([("no value", F.col("value").isNull()), ("too large", F.col("value") > 20), ("failed", F.col("event_type") == "error")])
    return t.events.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("windowed_event_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(t: Tables):
    from ..streaming.counts import windowed_counts

    return windowed_counts(t.events, "ts", "1 hour", "1 hour", ["event_type"])


@query("html_text_length")
def html_text(t: Tables):
    from ..sources.readers import text_of_html

    return t.pages.select("page_id", text_of_html(F.col("html")).alias("text"))
