"""Technologies of a repository: evidence into scores, versions, implications, and where each applies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores below which a technology is dropped and from which it is active; reasons that are kept; rounds of implications.
WEAK, ACTIVE, REASONS, ROUNDS = 0.3, 0.6, 10, 3
#: Evidence in sample directories counts for less.
SAMPLE = 0.3


def tech_scores(evidence: DataFrame) -> DataFrame:
    """(package, tech, score) by noisy-or over the strongest weight of each signal. evidence: package, tech, signal, weight, sample."""
    weight = F.least(F.greatest(F.col("weight") * F.when(F.col("sample"), SAMPLE).otherwise(1.0), F.lit(0.0)), F.lit(0.999))
    strongest = evidence.groupBy("package", "tech", "signal").agg(F.max(weight).alias("w"))
    # in the order of the signals, so that the product comes out alike each time
    ordered = strongest.groupBy("package", "tech").agg(F.array_sort(F.collect_list(F.struct("signal", "w"))).alias("ws"))
    return ordered.select("package", "tech", (1 - F.aggregate("ws", F.lit(1.0), lambda a, x: a * (1 - x["w"]))).alias("score"))


def tech_rollup(scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """(tech, score, active, packages, reasons): the best score of each technology that is not weak everywhere, how many packages it is active in, its strongest signals."""
    best = scores.groupBy("tech").agg(F.max("score").alias("score"), F.count_if(F.col("score") >= ACTIVE).alias("packages")).filter(F.col("score") >= WEAK)
    signals = evidence.groupBy("tech", "signal").agg(F.max("weight").alias("w")).groupBy("tech").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "signal"))).alias("s"))
    reasons = F.array_join(F.transform(F.slice("s", 1, REASONS), lambda x: x["signal"].cast("string")), ",")
    return best.join(signals, "tech").select("tech", "score", (F.col("score") >= ACTIVE).alias("active"), "packages", reasons.alias("reasons"))


def implied(scores: DataFrame, implications: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(package, tech, score) after implications (tech, implies) have passed on higher scores, round by round."""
    for _ in range(rounds):
        passed = scores.join(implications, "tech").select("package", F.col("implies").alias("tech"), "score")
        scores = scores.unionByName(passed).groupBy("package", "tech").agg(F.max("score").alias("score"))
    return scores


def tech_versions(declared: DataFrame) -> DataFrame:
    """(tech, version, by_package): the least version of the surest source, and the packages' own ones where they differ.

    declared: package, tech, rank (0 is surest), key (an array of numbers), version.
    """
    own = declared.groupBy("package", "tech").agg(F.min(F.struct("rank", "key", "version")).alias("v"))
    out = own.groupBy("tech").agg(F.min("v")["version"].alias("version"), F.count_distinct("v.version").alias("_n"), F.array_sort(F.collect_list(F.concat(F.col("package").cast("string"), F.lit("="), F.col("v.version")))).alias("_all"))
    return out.select("tech", "version", F.when(F.col("_n") > 1, F.array_join("_all", ",")).alias("by_package"))


def techs_of_files(files: DataFrame, techs: DataFrame, wide: DataFrame) -> DataFrame:
    """(file, tech): technologies of the packages that a file lies in, and those that hold for the whole repository.

    files: file; techs: dir, tech ('.': everywhere); wide: tech. Packages are found by equality with a file's ancestors;
    what holds everywhere is sent to the files, which would else all meet under one key.
    """
    parts = F.split("file", "/", -1)
    ups = files.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir"))
    local = ups.join(techs.filter("dir <> '.'").select("dir", "tech"), "dir").select("file", "tech")
    everywhere = files.select("file").crossJoin(F.broadcast(techs.filter("dir = '.'").select("tech").unionByName(wide.select("tech")).distinct()))
    return local.unionByName(everywhere).distinct()
