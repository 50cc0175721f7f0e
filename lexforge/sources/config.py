"""Settings from files and tables: later ones win over earlier ones."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_settings(spark: SparkSession, path: str) -> dict:
    """A JSON object, or flat ``key: value`` lines with lists as ``- item`` lines below their key; from any store."""
    text = "\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect())
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict = {}
    key = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        if bare.lstrip().startswith("- ") and key is not None:
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(_value(bare.lstrip()[2:]))
        else:
            key, _, value = bare.partition(":")
            key = key.strip()
            out[key] = _value(value.strip())
    return out


def _value(text: str):
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return {"true": True, "false": False, "": None, "null": None}.get(text.lower(), text)


def merged(*settings: dict) -> dict:
    """The last given value of each key; None does not override."""
    out: dict = {}
    for s in settings:
        out |= {k: v for k, v in s.items() if v is not None or k not in out}
    return out


def allowed(settings: dict, keys: list[str]) -> dict:
    return {k: v for k, v in settings.items() if k in keys}


def option(local: Column, overall: Column, default: Column) -> Column:
    return F.coalesce(local, overall, default)


def merge_maps(*maps: Column) -> Column:
    """Map columns merged; the last one wins, null maps and null values don't count."""
    out = None
    for m in maps:
        own = F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
        out = own if out is None else F.map_concat(_without(out, own), own)
    return out


def _without(left: Column, right: Column) -> Column:
    return F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))


def to_listing(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Lines ``- key: n`` by falling count."""
    ordered = counts.agg(F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("o"), F.col(key).cast("string").alias("k"), F.col(n).alias("n")))).alias("r"))
    return ordered.select(F.array_join(F.transform("r", lambda x: F.format_string("- %s: %d", x["k"], x["n"])), "\n").alias("listing"))
