"""Key-value annotations as ordered arrays of (key, value): order is observable, so maps won't do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _pair(key, value) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.cast("string").alias("value"))


def from_xml(infon) -> Column:
    """Array of (key, value) from an XML scan; null keys become empty."""
    return F.transform(F.coalesce(_c(infon), F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda x: F.struct(F.coalesce(x["_key"], F.lit("")).alias("key"), F.coalesce(x["_VALUE"], F.lit("")).alias("value")))


def to_xml(infons) -> Column:
    return F.transform(_c(infons), lambda x: F.struct(x["key"].alias("_key"), x["value"].alias("_VALUE")))


def get(infons, key: str) -> Column:
    """The last value under a key; null if there is none."""
    return F.try_element_at(F.filter(_c(infons), lambda x: x["key"] == key), F.lit(-1))["value"]


def by_suffix(infons, suffix: str) -> Column:
    """The first value whose key ends with the suffix."""
    return F.get(F.filter(_c(infons), lambda x: x["key"].endswith(suffix)), F.lit(0))["value"]


def as_map(infons) -> Column:
    """The last value of each key wins; empty keys are skipped."""
    named = F.filter(_c(infons), lambda x: x["key"] != "")
    keys = F.array_distinct(F.transform(named, lambda x: x["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter(named, lambda x: x["key"] == k), F.lit(-1))["value"]))


def upsert_all(infons, pairs: Column) -> Column:
    """Sets an array of (key, value) in turn: the first entry of a present key changes in place, a new key goes to the front."""
    kind = "array<struct<key:string,value:string>>"

    def one(now: Column, pair: Column) -> Column:
        at = F.array_position(F.transform(now, lambda x: x["key"]), pair["key"])
        return F.when(at > 0, F.transform(now, lambda x, i: F.when(i + 1 == at, pair).otherwise(x))).otherwise(F.concat(F.array(pair), now)).cast(kind)

    return F.aggregate(pairs.cast(kind), _c(infons).cast(kind), one)


def upsert(infons, new: list[tuple[str, Column]]) -> Column:
    """`upsert_all` of keys and values; a null value changes nothing."""
    return upsert_all(infons, F.filter(F.array(*[_pair(k, v) for k, v in new]), lambda x: x["value"].isNotNull()))


def drop_suffixes(infons, suffixes: list[str]) -> Column:
    return F.filter(_c(infons), lambda x: ~F.coalesce(x["key"].rlike("(?:" + "|".join(suffixes) + ")$"), F.lit(False)))


#: Endings of the keys that a linker writes and an evaluation input must not carry: those of the best candidate. What
#: it says of lower ranks, of aliases and of the normalised text stays, as does the gold identifier.
PREDICTED = [
    "_id_0", "_identifier_name_0", "_identifier_score_0", "_embedding_score_0", "_preferred_label_0", "_match_source",
    "_abbreviation_method", "_expanded_long_form", "_ab3p_method", "_ab3p_matched_key", "_ab3p_match_score",
]


def clean_for_linking(infons) -> Column:
    """Drops predicted entries and keeps the gold identifier."""
    return drop_suffixes(infons, PREDICTED)
