"""Single-card labels over ``part`` as the card table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import mods, store
from .registry import Tables, query

TYPES = ["ECONOMY", "STANDARD", "PROMO", "SMALL"]
BRANDS = [f"Brand#{i}" for i in range(1, 6)]
COLORS = ["red", "green", "blue", "small", "large"]


@query("card_mask_closed_class", "SELECT p_partkey, 'type' AS masked_field, CASE WHEN p_type IN ('ECONOMY','STANDARD','PROMO','SMALL') THEN p_type ELSE 'OTHER' END AS label FROM part WHERE p_type IS NOT NULL")
def card_mask_closed_class(t: Tables):
    return t.part.where("p_type is not null").select("p_partkey", F.lit("type").alias("masked_field"), scalars.closed_class(F.col("p_type"), TYPES).alias("label"))


@query("card_mask_regression", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS label FROM part WHERE p_size BETWEEN 0 AND 20")
def card_mask_regression(t: Tables):
    return t.part.select("p_partkey", scalars.printed_number(F.col("p_size").cast("string"), 20).alias("label")).where("label is not null")


@query("card_mask_multi_label", "SELECT p_partkey, list_contains(string_split(p_name,' '),'red') AS is_red, list_contains(string_split(p_name,' '),'green') AS is_green, list_contains(string_split(p_name,' '),'blue') AS is_blue FROM part")
def card_mask_multi_label(t: Tables):
    hot = scalars.multi_hot(F.split("p_name", " "), COLORS)
    return t.part.select("p_partkey", *[hot[i].alias(f"is_{c}") for i, c in enumerate(COLORS[:3])])


@query("card_mask_priority_type", "SELECT p_partkey, CASE WHEN list_contains(string_split(p_name,' '),'widget') THEN 'widget' WHEN list_contains(string_split(p_name,' '),'ring') THEN 'ring' ELSE 'OTHER' END AS label FROM part")
def card_mask_priority_type(t: Tables):
    return t.part.select("p_partkey", scalars.first_of(F.split("p_name", " "), ["widget", "ring"]).alias("label"))


@query("card_rarity_tier", """SELECT p_partkey, p_type AS raw_rarity, CASE p_type WHEN 'ECONOMY' THEN 'tier_1' WHEN 'STANDARD' THEN 'tier_2' WHEN 'PROMO' THEN 'special' ELSE 'other' END AS label FROM part WHERE p_type IS NOT NULL""")
def card_rarity_tier(t: Tables):
    tiers = F.create_map(*[F.lit(x) for x in ("ECONOMY", "tier_1", "STANDARD", "tier_2", "PROMO", "special")])
    return t.part.where("p_type is not null").select("p_partkey", F.col("p_type").alias("raw_rarity"), F.coalesce(F.try_element_at(tiers, F.col("p_type")), F.lit("other")).alias("label"))


@query("card_majority_content", """
WITH v AS (SELECT p_name, p_type AS value, count(*) AS n, max(p_partkey) AS latest FROM part GROUP BY 1,2),
r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY n DESC, latest DESC, value DESC) AS rn FROM v)
SELECT p_name, value AS p_type FROM r WHERE rn = 1""")
def card_majority_content(t: Tables):
    return store.majority_content(t.part, ["p_name"], ["p_type"], "p_partkey")


@query("card_representative_printing", """SELECT p_name, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) AS rn FROM part) WHERE rn = 1""")
def card_representative_printing(t: Tables):
    return store.representative(t.part.select("p_name", "p_partkey", "p_size"), ["p_name"], ["p_size", "p_partkey"])


@query("card_upsert_merge", """
SELECT p_partkey, coalesce(n.p_name, o.p_name) AS p_name, CASE WHEN o.p_type IS NULL OR length(n.p_type) > length(o.p_type) THEN n.p_type ELSE o.p_type END AS p_type
FROM (SELECT p_partkey, p_name, p_type FROM part WHERE p_partkey % 3 <> 0) o FULL JOIN (SELECT p_partkey, upper(p_name) AS p_name, p_type || '!' AS p_type FROM part WHERE p_partkey % 2 = 0) n USING (p_partkey)""")
def card_upsert_merge(t: Tables):
    old = t.part.where("p_partkey % 3 <> 0").select("p_partkey", "p_name", "p_type")
    new = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), F.concat("p_type", F.lit("!")).alias("p_type"))
    return store.upsert(old, new, ["p_partkey"], {"p_name": store.keep_incoming, "p_type": store.keep_longer})


@query("card_mirror_delete_absent", "SELECT p_partkey, upper(p_name) AS p_name FROM part WHERE p_partkey % 2 = 0")
def card_mirror(t: Tables):
    return store.mirror(t.part.select("p_partkey", "p_name"), t.part.where("p_partkey % 2 = 0").select("p_partkey", F.upper("p_name").alias("p_name")), ["p_partkey"])


@query("card_match_chain", """
WITH once AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1)
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_partkey AS VARCHAR) WHEN o.id IS NOT NULL THEN CAST(o.id AS VARCHAR) ELSE 'unknown' END AS card_id,
 CASE WHEN l_partkey % 5 <> 0 THEN 'id' WHEN o.id IS NOT NULL THEN 'name' ELSE 'unknown' END AS match_kind
FROM lineitem JOIN part ON l_partkey = part.p_partkey LEFT JOIN once o ON o.p_name = part.p_name""")
def card_match_chain(t: Tables):
    entries = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "p_name")
    by_id = t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("card_id"))
    by_name = t.part.select("p_name", F.col("p_partkey").alias("card_id"))
    return store.match_chain(entries, [("id", by_id, ["l_partkey"]), ("name", by_name, ["p_name"])], "unknown").drop("l_partkey", "p_name")


@query("card_dense_index", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS card_index FROM part")
def card_dense_index(t: Tables):
    return store.dense_index(t.part, "p_partkey", most=10**7)


@query("card_table_version")
def card_table_version(t: Tables):
    return store.version_of(t.part, ["p_partkey"])


@query("card_lookup_regex", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^red .*t$')")
def card_lookup_regex(t: Tables):
    return t.part.where(F.col("p_name").rlike("^red .*t$")).select("p_partkey", "p_name")


@query("card_lookup_folded_name", "SELECT p_partkey, lower(p_name) AS folded FROM part")
def card_lookup_folded_name(t: Tables):
    return t.part.select("p_partkey", scalars.fold_name(F.col("p_name")).alias("folded"))


@query("card_visible_tier", "SELECT p_partkey FROM part WHERE CAST('0x' || substr(sha256('holdout:' || p_partkey::VARCHAR), 9, 8) AS BIGINT) < 3865470566")
def card_visible_tier(t: Tables):
    from ..operators import sampling

    return sampling.holdout_view(t.part.select("p_partkey"), "holdout", "p_partkey", {"train": 8, "validation": 1, "test": 1}, ["train", "validation"])


@query("event_payload_masked", """SELECT event_id, '{"k":"[MASK]"}' AS content FROM events""")
def event_payload_masked(t: Tables):
    return t.events.select("event_id", scalars.json_masked(F.col("props"), "k").alias("content"))


@query("card_content_mods", """SELECT p_partkey, upper(p_name) AS name, '[MASK]' AS type FROM part""")
def card_content_mods(t: Tables):
    content = F.create_map(F.lit("Name"), F.col("p_name"), F.lit("Type"), F.col("p_type"))
    c = mods.mask_key(mods.key_case(mods.value_case(content, "upper"), "lower"), "type")
    return t.part.select("p_partkey", c["name"].alias("name"), c["type"].alias("type"))
