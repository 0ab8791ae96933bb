"""Augmentations of card content: JSON objects with string values as maps, rewritten by key or value."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import hashing

MASK = "[MASK]"


def key_case(content: Column, style: str) -> Column:
    """Keys as lower, UPPER or snake_case."""
    rules = {"lower": F.lower, "upper": F.upper, "snake": lambda k: F.lower(F.regexp_replace(k, r"(?<=[a-z0-9])(?=[A-Z])", "_"))}
    return F.transform_keys(content, lambda k, v: rules[style](k))


def value_case(content: Column, style: str) -> Column:
    return F.transform_values(content, lambda k, v: F.upper(v) if style == "upper" else F.lower(v))


def mask_key(content: Column, key: str, missing: str = "add") -> Column:
    """One field masked; where it is missing: add it, skip it, or fail."""
    masked = F.transform_values(content, lambda k, v: F.when(k == key, F.lit(MASK)).otherwise(v))
    has = F.map_contains_key(content, key)
    other = {"add": F.map_concat(content, F.create_map(F.lit(key), F.lit(MASK))), "skip": content, "strict": F.raise_error(F.lit(f"no field {key}")).cast("map<string,string>")}[missing]
    return F.when(has, masked).otherwise(other)


def mask_random_key(content: Column, seed: str, identity: Column, probability: float = 1.0) -> Column:
    """With a probability, one key by the hash of seed and identity."""
    keys = F.array_sort(F.map_keys(content))
    at = F.pmod(hashing.bucket32(seed, identity), F.greatest(F.size(keys), F.lit(1)).cast("long")).cast("int")
    chosen = F.get(keys, at)
    hit = hashing.unit(seed + "p", identity) < probability
    return F.when(hit & (F.size(keys) > 0), F.transform_values(content, lambda k, v: F.when(k == chosen, F.lit(MASK)).otherwise(v))).otherwise(content)


def shuffled_keys(content: Column, seed: str, identity: Column) -> Column:
    """The entries as an array in a seeded order."""
    keyed = F.transform(F.map_entries(content), lambda e: F.struct(hashing.rank_key(seed, F.concat_ws(":", identity, e["key"])).alias("k"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x["e"])


def list_to_string(values: Column, separator: str = ", ") -> Column:
    return F.array_join(values, separator)


def bool_to_string(value: Column, yes: str = "yes", no: str = "no") -> Column:
    return F.when(value, F.lit(yes)).when(~value, F.lit(no))


def without_noise(content: Column, noise: list[str]) -> Column:
    """Entries without noise keys and without null, empty or false values; 0 stays."""
    return F.map_filter(content, lambda k, v: ~k.isin(noise) & v.isNotNull() & ~v.isin("", "false", "[]", "{}"))


def first_of_repeated(content: Column, order: Column) -> Column:
    """Entries whose value an earlier key (in the given order) has already are dropped."""
    kept = F.filter(order, lambda k, i: F.element_at(content, k).isNull() | ~F.exists(F.slice(order, F.lit(1), i), lambda e: F.element_at(content, e) == F.element_at(content, k)))
    return F.map_from_arrays(kept, F.transform(kept, lambda k: F.element_at(content, k)))


def number_to_string(value: Column, decimals: int = 2) -> Column:
    """A number as text, whole ones without a fraction."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(F.regexp_replace(F.format_string(f"%.{decimals}f", value.cast("double")), r"0+$", ""))


def weighted_mask(content: Column, table: list[tuple[float, tuple[str, ...]]], seed: str, identity: Column, probability: float = 1.0) -> Column:
    """With a probability, the keys of one entry of (weight, keys) masked, drawn by the hash of seed and identity.

    Only entries count whose keys the content has; an entry without keys masks nothing.
    """
    fits = [F.forall(F.array(*[F.lit(k) for k in keys]), lambda k: F.map_contains_key(content, k)) if keys else F.lit(True) for _, keys in table]
    weights = [F.when(f, F.lit(float(w))).otherwise(0.0) for f, (w, _) in zip(fits, table)]
    total = sum(weights[1:], weights[0])
    at, running, out = hashing.unit(seed, identity) * total, F.lit(0.0), None
    for w, (_, keys) in zip(weights, table):
        running = running + w
        masked = F.transform_values(content, _masked(keys))
        out = F.when((w > 0) & (at < running), masked) if out is None else out.when((w > 0) & (at < running), masked)
    return F.when(hashing.unit(seed + "p", identity) < probability, out.otherwise(content)).otherwise(content)


def _masked(keys: tuple[str, ...]):
    return lambda k, v: F.when(k.isin(*keys), F.lit(MASK)).otherwise(v) if keys else v


def shuffled(cards: Column, seed: str, identity: Column) -> Column:
    """The cards in a seeded order; copies are told apart by their place."""
    keyed = F.transform(cards, lambda c, i: F.struct(hashing.rank_key(seed, F.concat_ws(":", identity, c, i.cast("string"))).alias("k"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda e: e["c"])


def without_copies(cards: Column) -> Column:
    """The first copy of each card, in order."""
    return F.array_distinct(cards)


def per_game(game: Column, content: Column, rules: dict) -> Column:
    """The content by the rule of its game; games without a rule stay as they are."""
    out = content
    for name, rule in rules.items():
        out = F.when(game == name, rule(content)).otherwise(out)
    return out


def unchanged(content: Column) -> Column:
    return content


def with_field(content: Column, key: str, value: Column, missing: str = "strict") -> Column:
    """The content with one field replaced; where it is missing: fail, add it or skip it."""
    has = F.map_contains_key(content, key)
    replaced = F.transform_values(content, lambda k, v: F.when(k == key, value).otherwise(v))
    other = {"add": F.map_concat(content, F.create_map(F.lit(key), value)), "skip": content, "strict": F.raise_error(F.lit(f"no field {key}")).cast("map<string,string>")}[missing]
    return F.when(has, replaced).otherwise(other)


def _flat(value, path=""):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from _flat(v, f"{path}.{k}" if path else k)
    else:
        yield path, value


def flattened(content: Column) -> Column:
    """Nested JSON objects as one with dotted keys; the depth is not known beforehand."""

    @F.pandas_udf("string")
    def flat(texts):
        return texts.map(lambda t: None if t is None else json.dumps(dict(_flat(json.loads(t))), sort_keys=True, ensure_ascii=False))

    return flat(content)


def pipeline(frame, *steps):
    """Steps applied in order, each a function of the frame."""
    for step in steps:
        frame = frame.transform(step)
    return frame
