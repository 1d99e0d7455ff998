"""Scalar functions: symbols, names, hashes, backoff, envelopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_symbol(symbol: Column) -> Column:
    """BTC-USD, BTC/USD -> BTCUSD."""
    return F.upper(F.regexp_replace(symbol, "[-/]", ""))


def paired_symbol(symbol: Column) -> Column:
    """Six or more letters or digits without a separator -> AAA/BBB; others upper-cased."""
    up = F.upper(symbol)
    return F.when(up.rlike("^[A-Z0-9]{6,}$"), F.regexp_replace(up, "^(.{3})", "$1/")).otherwise(up)


def canonical_json(parameters: Column) -> Column:
    """A map of strings as JSON with its keys in order, a space behind commas and colons."""
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    pairs = F.transform(F.array_sort(F.map_entries(parameters)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def parameter_hash(parameters: Column) -> Column:
    """md5 of a map's canonical JSON."""
    return F.md5(canonical_json(parameters))


def config_hash(parameters: Column) -> Column:
    """The first ten hexadecimal digits of the sha256 of a map's canonical JSON."""
    return F.substring(F.sha2(canonical_json(parameters), 256), 1, 10)


def backoff_seconds(attempt: Column, base: float = 1.0, multiplier: float = 2.0, cap: float = 300.0) -> Column:
    """Exponential backoff before the given attempt: 0 before the first, never more than `cap`."""
    return F.when(attempt <= 0, F.lit(0.0)).otherwise(F.least(F.lit(base) * F.pow(F.lit(multiplier), attempt - 1), F.lit(cap)))


def feature_column(name: Column, config: Column, parameters: Column, sub: Column | None = None) -> Column:
    parts = [name, config, parameter_hash(parameters)]
    return F.concat_ws("_", *parts, *([sub] if sub is not None else []))


def view_name(role: Column) -> Column:
    names = {"observation_space": "observation_features", "reward_engineering": "reward_features"}
    return F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])[role]


def envelope(kind: str, symbol: Column, ts: Column, **data: Column) -> Column:
    """An event: its data as a map of strings, and its context."""
    pairs = [x for k, v in data.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(F.lit(kind).alias("kind"), F.struct(symbol.alias("symbol"), ts.alias("timestamp")).alias("context"), F.create_map(*pairs).alias("data"))


def flat_context(context: Column, metadata: Column) -> Column:
    """Non-null context fields, and metadata under meta_ names, as one map."""
    named = F.transform_keys(metadata, lambda k, _: F.concat(F.lit("meta_"), k))
    return F.map_concat(F.map_filter(context, lambda _, v: v.isNotNull()), F.map_filter(named, lambda _, v: v.isNotNull()))


def account_rules(size: Column) -> Column:
    """Targets and limits that follow from the account size."""
    lots = size / 100_000.0 * 10.0
    return F.struct(F.when(size <= 100_000, 10.0).otherwise(8.0).alias("profit_target_pct"), lots.alias("max_lots"), F.greatest(F.lit(5), F.least(F.lit(10), (size / 20_000).cast("int"))).alias("max_open_trades"))
