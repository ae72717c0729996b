"""The cost of model calls: prices by route, one currency a run, budgets with a reserve, sums of usage.

Amounts are in millionths of a currency unit, as token prices are per million tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRITE_FACTOR, BATCH_FACTOR, DEEPEN_FACTOR, MILLION = 1.25, 0.5, 1.45, 1_000_000
CURRENCY = "USD"
RATES = ["input", "cached_input", "cache_write", "output", "request", "currency"]


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with amount, currency and basis (reported, priced or estimated; all null where the cost is unknown).

    calls: provider, model, input_tokens, cached_tokens, write_tokens, output_tokens, requests, batch,
    estimated, reported (a provider's own amount) and reported_currency. prices: key and RATES, one row
    a route; a call takes the price of provider:model, else of its model, else of its provider.
    """
    rows = calls
    keys = [F.concat_ws(":", "provider", "model"), F.col("model"), F.col("provider")]
    for k, key in enumerate(keys):
        route = F.lower(F.when(F.col("model").isNotNull(), key)) if k < 2 else F.lower(key)
        table = prices.select(F.lower("key").alias(f"_key{k}"), F.struct(*RATES).alias(f"_price{k}"))
        rows = rows.join(table, route == F.col(f"_key{k}"), "left")
    rows = rows.withColumn("_p", F.coalesce("_price0", "_price1", "_price2"))
    p = {name: F.col(f"_p.{name}") for name in RATES}
    zero = lambda c: F.coalesce(c, F.lit(0))
    tokens = F.col("input_tokens") + zero(F.col("cached_tokens")) + zero(F.col("write_tokens")) + F.col("output_tokens")
    rated = p["input"].isNotNull() | p["output"].isNotNull()
    base = zero(p["input"])
    by_token = F.col("input_tokens") * base + zero(F.col("cached_tokens")) * F.coalesce(p["cached_input"], base) + zero(F.col("write_tokens")) * F.coalesce(p["cache_write"], base * WRITE_FACTOR) + F.col("output_tokens") * zero(p["output"])
    amount = by_token * F.when(F.col("batch"), BATCH_FACTOR).otherwise(1.0) + F.coalesce("requests", F.lit(1)) * zero(p["request"]) * MILLION
    known = F.col("_p").isNotNull() & ~((tokens > 0) & ~rated & p["request"].isNull())
    told = F.col("reported").isNotNull()
    return rows.select(
        *calls.columns,
        F.when(told, F.col("reported") * MILLION).when(known, amount).alias("amount"),
        F.when(told, F.col("reported_currency")).when(known, F.coalesce(p["currency"], F.lit(CURRENCY))).alias("currency"),
        F.when(told, "reported").when(known, F.when(F.col("estimated") & rated, "estimated").otherwise("priced")).alias("basis"),
    )


def route(provider: Column, model: Column) -> Column:
    return F.concat_ws(":", provider, model)


def meter(costs: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Each run's amount in whole millionths, in the first currency it met; other calls are counted as unknown and their routes listed."""
    first = F.min(F.when(F.col("currency").isNotNull(), F.struct(*order, "currency"))).over(Window.partitionBy(run))
    rows = costs.withColumn("_main", first["currency"]).withColumn("_counts", F.coalesce(F.col("currency") == F.col("_main"), F.lit(False)))
    whole = F.floor(F.col("amount") + 0.5)
    return rows.groupBy(run).agg(
        F.coalesce(F.sum(F.when(F.col("_counts"), whole)), F.lit(0)).alias("amount"), F.coalesce(F.max("_main"), F.lit(CURRENCY)).alias("currency"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("_counts"), F.col("basis")))), ",").alias("basis"), F.count_if(~F.col("_counts")).alias("unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("_counts"), route(F.col("provider"), F.col("model"))))), ",").alias("unpriced"),
    )


def gate(costs: DataFrame, run: str, order: list[str], limit: int, reserve: float) -> DataFrame:
    """costs with `allowed`: whether the run had spent less than its limit when the call began; reviews leave a share to the critique."""
    spent = F.coalesce(F.sum(F.when(F.col("currency") == CURRENCY, F.floor(F.col("amount") + 0.5))).over(Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return costs.withColumn("allowed", spent < F.when(F.col("role") == "critique", F.lit(float(limit))).otherwise(F.lit(limit * (1 - reserve))))


def sum_usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of usage: estimated if any call is, a batch if all are, the reported cost only if every call reports one in one currency."""
    whole = (F.count("reported") == F.count(F.lit(1))) & (F.count_distinct("reported_currency") == 1)
    return calls.groupBy(*keys).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.sum("requests").alias("requests"),
        F.bool_or("estimated").alias("estimated"), F.bool_and("batch").alias("batch"), F.when(whole, F.sum(F.floor(F.col("reported") * 100 + 0.5))).alias("reported_cents"),
    )


def deepen_advice(chunks: DataFrame, run: str) -> DataFrame:
    """(run, chunks, estimate): runs with reviewed chunks and a finding; the estimate only if every chunk's cost is known, positive and in one currency.

    chunks: status, findings, cents, currency.
    """
    done = chunks.filter("status = 'done'")
    known = F.bool_and(F.coalesce(F.col("cents") > 0, F.lit(False))) & (F.count_distinct("currency") == 1) & (F.count("currency") == F.count(F.lit(1)))
    found = done.groupBy(run).agg(F.count(F.lit(1)).alias("chunks"), F.sum("findings").alias("_f"), F.when(known, F.sum("cents") * DEEPEN_FACTOR).alias("estimate"))
    return found.filter("_f > 0").drop("_f")
