"""Whitening of embeddings: one aggregation of centred products for each pair of dimensions, LAPACK on the driver.

Entries become integers x = floor(64 c) + 1000000, so that counts and sums of the fit list (each
distinct vector once) are exact. The upper triangle of the covariance is a list of generated SQL
sums of centred products, taken in one aggregation over the fit list (pairs beyond PAIRS in
further ones); the driver gets d(d + 1)/2 numbers, whatever the number of rows, decomposes them and
writes the components back into SQL expressions, which every row evaluates by itself.

Edge cases: a null vector and one with a null or non-finite entry are dropped; an entry beyond 2**46
counts as non-finite, as its integer would not be exact; vectors of another length than the longest
usable ones (an empty one, say) are dropped; rows that repeat a vector weigh once in the fit and all
get their result; a null vec_id is kept; equal eigenvalues give some basis of their space, the same
for all rows; a component without variance (all vectors equal, or fewer vectors than dimensions) has
whitened null and explained 0, and identity_error is over the others (null if there are none); a
deviation beyond a long is null; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import cut

SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**46
COMPONENTS = 16
#: Sums of one aggregation (enough for 128 dimensions), and its tasks, each of which sends one row of them to the last step.
PAIRS, TASKS = 8256, 4096
LONG = 2**63


def fixed_point(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the usable vectors as arrays of integers."""
    entry = lambda c: c.cast("double")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(entry(c)) | (F.abs(entry(c)) > LARGEST))
    x = F.transform("embedding", lambda c: F.floor(entry(c) * SCALE) + SHIFT)
    return vectors.filter(F.col("embedding").isNotNull() & ~bad & (F.size("embedding") > 0)).select("vec_id", x.alias("x"))


def sums_of(rows: DataFrame, terms: list[str]) -> np.ndarray:
    """The sum of each SQL term over all rows. Tasks beyond TASKS are merged before, so few partial rows meet in the last step."""
    rows, out = rows.coalesce(TASKS), []
    for at in range(0, len(terms), PAIRS):
        out += rows.selectExpr(f"array({', '.join(f'sum({t})' for t in terms[at : at + PAIRS])}) AS sums").first()[0]
    return np.array(out)


def upper(terms: list[str]) -> list[str]:
    """The products of all pairs of terms, by rows of the upper triangle."""
    return [f"{a} * {b}" for k, a in enumerate(terms) for b in terms[k:]]


def symmetric(values: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = values
    return out + np.triu(out, 1).T


def columns(array: str, n: int, name: str) -> list[str]:
    """The entries of an array as columns that cannot be null, which sums are quicker over."""
    return [f"coalesce({array}[{i}], 0D) AS {name}{i}" for i in range(n)]


class Whitening:
    """What a fit list gives: n, the sums of each dimension, components (columns) and eigenvalues, falling."""

    def __init__(self, fit: DataFrame, d: int) -> None:
        first = fit.selectExpr("count(1)", "min(array_min(x))", "max(array_max(x))", f"array({', '.join(f'sum(CAST(x[{i}] AS DECIMAL(20,0)))' for i in range(d))})").first()
        self.d, self.n, self.sums = d, first[0], [int(v) for v in first[3]]
        #: whether n x - S and the squared deviation are sure to fit into a long
        self.fits = self.n * max(abs(first[1]), abs(first[2]), 1) < LONG // 2
        self.squares_fit = self.fits and d * (self.n * (first[2] - first[1])) ** 2 < LONG
        self.covariance = symmetric(sums_of(fit.select(self.centred().alias("z")).selectExpr(*columns("z", d, "z")), upper([f"z{i}" for i in range(d)])), d) / self.n
        values, vectors = np.linalg.eigh(self.covariance)
        self.values, self.vectors = values[::-1], vectors[:, ::-1]
        self.trace = float(np.trace(self.covariance))
        #: components with a variance above rounding
        self.live = int(np.sum(self.values > d * np.finfo(float).eps * max(float(self.values[0]), 0.0)))

    def centred(self) -> Column:
        """x - S/n as an array; the difference is taken in integers, so that no digit is lost."""
        if self.fits:
            return F.zip_with("x", F.array(*map(F.lit, self.sums)), lambda x, s: (F.lit(self.n) * x - s) / F.lit(float(self.n)))
        return F.zip_with("x", F.array(*(F.lit(s / self.n) for s in self.sums)), lambda x, m: x - m)

    def deviation(self) -> Column:
        if self.squares_fit:
            return F.aggregate(F.zip_with("x", F.array(*map(F.lit, self.sums)), lambda x, s: F.lit(self.n) * x - s), F.lit(0).cast("long"), lambda a, c: a + c * c)
        sums = F.array(*(F.lit(str(s)).try_cast("bigint") for s in self.sums))
        away = F.zip_with("x", sums, lambda x, s: F.try_subtract(F.try_multiply(F.lit(self.n).cast("long"), x), s))
        return F.aggregate(away, F.lit(0).cast("long"), lambda a, c: F.try_add(a, F.try_multiply(c, c)))

    def whitened(self, k: int) -> Column:
        """The first k components' values of the array z, for those with a variance."""
        weights = self.vectors[:, : min(k, self.live)] / np.sqrt(self.values[: min(k, self.live)])
        each = F.array(*(F.array(*map(F.lit, w)) for w in weights.T.tolist())) if weights.size else F.array().cast("array<array<double>>")
        return F.transform(each, lambda w: F.aggregate(F.zip_with("z", w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))

    def identity_error(self, fit: DataFrame, k: int) -> float | None:
        """The largest absolute entry of the whitened fit list's covariance less the identity, over k components."""
        k = min(k, self.live)
        if not k:
            return None
        rows = fit.select(self.centred().alias("z")).select(self.whitened(k).alias("w")).selectExpr(*columns("w", k, "w"))
        return float(np.max(np.abs(symmetric(sums_of(rows, upper([f"w{j}" for j in range(k)])), k) / self.n - np.eye(k))))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row of vectors (vec_id, embedding)."""
    rows = fixed_point(vectors)
    distinct = cut(rows.select("x").distinct())
    d = distinct.agg(F.max(F.size("x"))).first()[0]
    if d is None:
        return rows.selectExpr("vec_id", "1 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error").limit(0)
    fit = distinct.filter(F.size("x") == d)
    model, k = Whitening(fit, d), min(components, d)
    explained = [float(v) / model.trace if j < model.live else 0.0 for j, v in enumerate(model.values[:k])]
    each = F.array(*(F.struct(F.lit(j + 1).alias("component"), F.get("w", F.lit(j)).alias("whitened"), F.lit(explained[j]).alias("explained")) for j in range(k)))
    out = rows.filter(F.size("x") == d).select("vec_id", model.deviation().alias("deviation"), model.centred().alias("z")).withColumn("w", model.whitened(k)).select("vec_id", "deviation", F.inline(each))
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(model.identity_error(fit, k)).cast("double").alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
