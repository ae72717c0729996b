"""Queries over the store of signed entries: runs by time, answers kept by key. Each writes its tables' rows to a store of its own and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleanline.operators.graph import shared_dir
from gleanline.plans.facts import table
from gleanline.plans.registry import query
from gleanline.sources import store

SECRET, SINCE, UNTIL = "of the queries alone", "1995-01-01", "1997-01-01"


def _place(spark) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


@query("stored_runs", f"SELECT printf('%010d', o_orderkey) AS id, epoch_us(o_orderdate)::BIGINT AS created_us, o_custkey AS customer, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= '{SINCE}' AND o_orderdate < '{UNTIL}'")
def stored_runs(spark, sf_dir):
    """Every order is stored as a run; those of one kind and a span of time are read back. An altered copy signed by another secret stands beside each."""
    orders = table(spark, sf_dir, "orders")
    entry = orders.select(F.col("o_orderstatus").alias("kind"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("key"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))).alias("data"))
    path = _place(spark)
    store.write(entry.repartitionByRange("created_at"), path, SECRET)
    store.write(entry.withColumn("data", F.lit('{"customer":0}')), path, "of a stranger")
    found = store.read(spark, path, SECRET, kind="F", since=SINCE, until=UNTIL)
    return found.select(F.col("key").alias("id"), F.unix_micros("created_at").alias("created_us"), F.from_json("data", "customer long, priority string").alias("j")).select("id", "created_us", "j.*")


@query("kept_answers", "WITH k AS (SELECT sha256(text) AS key, length(text) AS n, lang FROM documents WHERE text IS NOT NULL) SELECT key, CASE WHEN bool_or(lang = 'en') THEN 'kept ' ELSE 'made ' END || max(n) AS data FROM k GROUP BY key")
def kept_answers(spark, sf_dir):
    """Answers about all texts by their hash: those of English documents are in the store, those of others are made; what a stranger stored for them is refused."""
    texts = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"), F.length("text").cast("string").alias("n"), "lang")
    path = _place(spark)
    answer = lambda rows, word: rows.select("key", F.concat(F.lit(word), "n").alias("data"))
    as_entries = lambda rows: rows.filter("key IS NOT NULL").dropDuplicates(["key"]).select(F.lit("answer").alias("kind"), "key", F.timestamp_seconds(F.lit(0)).alias("created_at"), "data")
    store.write(as_entries(answer(texts.filter("lang = 'en'"), "kept ")), path, SECRET)
    store.write(as_entries(answer(texts, "forged ")), path, "of a stranger")
    return store.answered(texts, path, SECRET, "answer", lambda rows: answer(rows, "made "))
