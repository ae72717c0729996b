"""Scoring of reviews against expected defects: fits, one-to-one matches, counts, ratios.

findings: case, id, file, start, end, title, confidence, severity; defects: case, defect (a number),
severity, note, optional, spots: array of (file, start, end), the defect's own place first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanline.functions import text as T
from gleanline.operators.greedy import decided, similarity, title_words
from gleanline.operators.intervals import overlap_join

#: Lines of tolerance; title similarities from which a finding is about a defect and repeats another finding.
TOLERANCE, ON_TOPIC, REPEAT = 3, 0.15, 0.3
COUNTS = ["expected", "found", "missed", "unexpected", "false_positives", "duplicates", "nearby", "acceptable", "underrated", "lost", "saved"]


def fits(findings: DataFrame, defects: DataFrame, slack: int = TOLERANCE, also: dict[str, Column] | None = None) -> DataFrame:
    """(case, id, defect, gap, iou, on_topic, ...) of findings within the slack of a defect, by its best spot.

    also: further columns, made of those of finding and defect that are in neither's list above.
    """
    also, known = also or {}, {"case", "id", "file", "start", "end", "title", "confidence", "defect", "note", "spots"}
    more_f, more_d = ([c for c in df.columns if c not in known] if also else [] for df in (findings, defects))
    spots = defects.select("case", "defect", "note", *more_d, F.explode("spots").alias("s")).select("case", F.col("s.file").alias("file"), F.col("s.start").alias("start_b"), F.col("s.end").alias("end_b"), "defect", "note", *more_d)
    rows = findings.select("case", T.posix_path(F.col("file")).alias("file"), "id", F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"), "title", "confidence", *more_f)
    met = overlap_join(rows, spots.withColumn("file", T.posix_path(F.col("file"))), ["case", "file"], slack, 64)
    gap = F.greatest(F.lit(0), F.greatest("start", "start_b") - F.least("end", "end_b"))
    overlap = F.greatest(F.lit(0), F.least("end", "end_b") - F.greatest("start", "start_b") + 1)
    iou = overlap / (F.greatest("end", "end_b") - F.least("start", "start_b") + 1)
    topic = T.similarity(T.title_words(F.col("title")), T.title_words(F.col("note"))) >= ON_TOPIC
    each = met.select("case", "id", "defect", "title", "start", "end", "confidence", topic.alias("on_topic"), *(v.alias(k) for k, v in also.items()), F.struct(gap.alias("gap"), (-iou).alias("less")).alias("fit"))
    best = each.groupBy("case", "id", "defect", "title", "start", "end", "confidence", "on_topic", *also).agg(F.min("fit").alias("fit"))
    return best.select("case", "id", "defect", "title", "start", "end", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "on_topic", *also, F.col("fit.gap").alias("gap"), (-F.col("fit.less")).alias("iou"))


def _roles(rows: list) -> dict:
    """By id: (the pair, role) of a case's pairs in their order."""
    of_finding: dict = {}
    of_defect: dict = {}
    best: dict = {}
    for r in rows:
        best.setdefault(r.id, r)
        if r.id not in of_finding and r.defect not in of_defect:
            of_finding[r.id], of_defect[r.defect] = r, r
    out = {}
    for r in best.values():
        if r.id in of_finding:
            out[r.id] = (of_finding[r.id], "matched")
            continue
        kept = of_defect[r.defect]
        same = (r.start, r.end) == (kept.start, kept.end) or similarity(title_words(r.title), title_words(kept.title)) >= REPEAT
        out[r.id] = (r, "duplicate" if same else "nearby")
    return out


def _order() -> list:
    return [F.desc("on_topic"), "gap", F.desc("iou"), F.desc("confidence"), "id", "defect"]


def match(findings: DataFrame, defects: DataFrame, slack: int = TOLERANCE) -> DataFrame:
    """(case, id, defect, role): matched one to one, best fit first; what is left is a duplicate of a match, nearby or unmatched.

    The choices within a case depend on each other, so a case is decided by itself; it holds the pairs of one review.
    """

    pairs = fits(findings, defects, slack)
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    decide = lambda rows: [(r.case, r.id, r.defect, role) for r, role in _roles(rows).values()]
    near = decided(pairs, ["case"], _order(), f"case {kinds['case']}, id {kinds['id']}, defect {kinds['defect']}, role string", decide)
    away = findings.select("case", "id").join(near.select("case", "id"), ["case", "id"], "left_anti")
    return near.unionByName(away.select("case", "id", F.lit(None).cast(kinds["defect"]).alias("defect"), F.lit("unmatched").alias("role")))


def score(cases: DataFrame, findings: DataFrame, removed: DataFrame, defects: DataFrame) -> DataFrame:
    """COUNTS of each case. removed: findings that the critique or a threshold dropped.

    Optional defects take part in the matching but not in recall; a case with no other is clean, and what
    is found there besides is a false positive. A case's pairs, of kept and of removed findings, are read
    once and counted where they are decided; ids are unique within a case.
    """
    both = findings.withColumn("dropped", F.lit(False)).unionByName(removed.withColumn("dropped", F.lit(True)))
    also = {"dropped": F.col("dropped"), "optional": F.col("optional"), "worse": T.severity_rank(F.col("severity")) > T.severity_rank(F.col("floor"))}
    pairs = fits(both.select("case", "id", "file", "start", "end", "title", "confidence", "severity", "dropped"), defects.withColumnRenamed("severity", "floor"), also=also)

    def decide(rows: list) -> list[tuple]:
        roles = _roles([r for r in rows if not r.dropped])
        matched = [r for r, role in roles.values() if role == "matched"]
        found = {r.defect for r in matched}
        firm = [r for r in matched if r.optional is False]
        of = lambda role: sum(x == role for _, x in roles.values())
        # what was dropped and would have found a defect that nothing else did
        lost = _roles([r for r in rows if r.dropped and r.optional is False and r.defect not in found])
        met = {r.id for r in rows if r.dropped}
        return [(rows[0].case, len(firm), sum(r.optional is True for r in matched), sum(r.worse is True for r in firm), of("duplicate"), of("nearby"), len(roles), sum(role == "matched" for _, role in lost.values()), len(met))]

    counts = ["found", "acceptable", "underrated", "duplicates", "nearby", "_near", "lost", "_met"]
    kind = pairs.schema["case"].dataType.simpleString()
    of_case = decided(pairs, ["case"], _order(), f"case {kind}, " + ", ".join(f"{c} long" for c in counts), decide)
    sizes = both.groupBy("case").agg(F.count_if(~F.col("dropped")).alias("_kept"), F.count_if("dropped").alias("_dropped"))
    wanted = defects.groupBy("case").agg(F.count_if(~F.col("optional")).alias("expected"))
    rows = cases.select("case").distinct()
    for part in (wanted, of_case, sizes):
        rows = rows.join(part, "case", "left")
    rows = rows.fillna(0).withColumn("leftover", F.col("_kept") - F.col("_near")).withColumn("saved", F.col("_dropped") - F.col("_met"))
    rows = rows.withColumn("clean", F.col("expected") == 0)
    rows = rows.withColumn("missed", F.col("expected") - F.col("found"))
    rows = rows.withColumn("unexpected", F.when(F.col("clean"), 0).otherwise(F.col("leftover")).cast("long")).withColumn("false_positives", F.when(F.col("clean"), F.col("leftover")).otherwise(0).cast("long"))
    return rows.select("case", "clean", *COUNTS)


def ratios(rows: DataFrame) -> DataFrame:
    """rows of COUNTS with recall, precision, f1 and the raw ones before the filters: always made from summed counts."""
    c = {name: F.col(name) for name in COUNTS}
    recall = T.ratio(c["found"], c["expected"])
    precision = T.ratio(c["found"], c["found"] + c["unexpected"] + c["false_positives"])
    raw = c["found"] + c["lost"]
    return rows.select(
        "*", recall.alias("recall"), precision.alias("precision_"),
        F.when(c["expected"] > 0, F.when(c["found"] == 0, 0.0).otherwise(2 * recall * precision / (recall + precision))).alias("f1"),
        T.ratio(raw, c["expected"]).alias("raw_recall"), T.ratio(raw, raw + c["unexpected"] + c["false_positives"] + c["saved"]).alias("raw_precision"),
    )


def aggregate(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The micro average of scores, in total or by keys: counts are summed, ratios made anew."""
    return ratios(scores.groupBy(*(keys or [])).agg(*(F.sum(c).alias(c) for c in COUNTS)))
