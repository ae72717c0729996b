"""Personal data by weak supervision: labelers vote on spans, EM weighs the labelers, a classifier decides.

Candidates are all matches of the four base kinds, whose valid ones are exact and always stay, and of
further kinds that looser patterns propose: secrets assigned to a name, and phone numbers without a
plus. Three sorts of labelers vote yes, no or nothing on each candidate: regular expressions on its
form, gazetteers of words before it and of known non-data, and its context (what borders on it).
Expectation-maximisation estimates from the votes how reliable each labeler is. The fit is anchored:
a base match is known to be data or not by its check (Luhn, ranges, digits), and a labeler's weight
stays within HOLD of what it is known for, so that no mix of candidates turns a labeler round. The
votes are counted by combination first: one aggregation over all candidates gives at most
3 ** N_VOTES rows a kind (13122 in all, some hundred in fact), and both fits run over these counts.
The posteriors train the final span classifier, a logistic regression over votes and kind fitted to
convergence, and it alone decides on the spans of the further kinds.

Spans are in code points, their ends exclusive. Edge cases: a null or empty text has no spans; spans of
different kinds may overlap, but an added span that touches a base span goes; very long texts are
searched in whole; repeated rows get equal results; an empty table gives an empty result; further
columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanline.llm.common import cut, documents

#: The base kinds in order and what each matches. The lookbehinds spare second tries within a run of
#: characters, and possessive loops need no stack; neither changes what the leftmost matches are.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = {
    "secret": r"(?i)(?<=[=:][\x20\x22\x27]{0,3})[A-Za-z0-9_/+-]{16,}+",
    "phone2": r"(?<![0-9+-])(?:\([0-9]{3}\)[\x20-]?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])",
}
KINDS = {**BASE, **ADDED}
ORDER = {kind: k for k, kind in enumerate(KINDS)}
#: What a text with any match holds: a piece of every match of ip, phone2, secret, phone and card in this order; an email has its @.
ANY = r"[0-9][.]|[0-9]{3}|[=:]|[+][0-9]|[0-9](?:[\x20-]?[0-9]){12}"
CONTEXT = 40
#: Gazetteers: words before a span that speak for and against personal data, and spans that are none.
FOR_WORDS = r"(?i)\b(?:e?-?mail|contact|write|reach|tel|phone|call|fax|mobile|card|visa|account|ip|host|server|address|token|secret|key|password|pwd)\b"
AGAINST_WORDS = r"(?i)\b(?:version|release|isbn|issn|order|invoice|page|section|figure|fig|no|nr|id|sha1|sha256|md5|commit|path|file|dir)\b[^A-Za-z0-9]{0,4}$"
NOT_DATA = r"(?i)^(?:127\.|0\.0\.0\.0|255\.255\.|.*(?:example_?key|changeme|placeholder|xxxx))"
#: Runs of one character, paths of words, and what stands before a span inside an address.
RUN, PATH_LIKE, IN_ADDRESS = r"([A-Za-z0-9])\1{6,}", r"^/?(?:[A-Za-z]+[0-9]{0,2}[/_-]){2,}[A-Za-z]+[0-9]{0,2}$", r"(?i)\b(?:https?|ftp|data):\S*$"
#: Log odds that a vote of yes or of no adds, as each labeler is known, and how far the estimate may leave that; the log odds of a candidate without votes.
KNOWN = {"form": (1.2, -2.5), "strong": (1.2, -2.5), "words": (1.5, -1.5), "against": (1.5, -3.0), "borders": (1.0, -2.0), "runs": (1.0, -3.0), "places": (1.0, -3.0)}
HOLD, PRIOR, PRIOR_HOLD = 0.3, -0.6, 0.2
ROUNDS, STEPS = 12, 40
KEEP_AT = 0.5
N_VOTES = len(KNOWN)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test: from the right every second digit counts double, less 9 beyond 9."""
    doubled = F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    values = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(c == "", 0).when(i % 2 == 0, c.cast("int")).otherwise(F.get(doubled, c.cast("int"))))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """Whether a match of a base kind is one of its spans."""
    n = F.length(digits(match))
    small = F.forall(F.split(match, r"\."), lambda part: F.length(F.regexp_replace(part, "^0+", "")).between(0, 3) & (F.coalesce(F.regexp_replace(part, "^0+", "").try_cast("int"), F.lit(0)) <= 255))
    return F.when(kind == "email", True).when(kind == "ip", small).when(kind == "card", n.between(13, 19) & luhn(F.substring(digits(match), 1, 19))).when(kind == "phone", n.between(9, 15)).otherwise(False)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, x, kind, start, end, match, before, after) of all matches; x tells texts of one doc_id apart.

    The pieces between a kind's matches and the matches add up to their places: a running sum.
    """
    rows = docs.filter(F.col("text").isNotNull() & (F.contains("text", F.lit("@")) | F.col("text").rlike(ANY))).select("doc_id", F.xxhash64("text").alias("x"), "text")
    for kind, pattern in KINDS.items():
        rows = rows.withColumn(f"m_{kind}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    rows = rows.filter(F.greatest(*(F.size(f"m_{k}") for k in KINDS)) > 0)
    for kind, pattern in KINDS.items():
        rows = rows.withColumn(f"b_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)))

    def found(kind: str) -> Column:
        b = F.col(f"b_{kind}")
        return F.transform(F.col(f"m_{kind}"), lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(b, i)).alias("gap"), F.length(m).alias("size"), m.alias("match"),
            F.right(F.get(b, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(b, i + 1), F.lit(CONTEXT)).alias("after")))

    each = rows.select("doc_id", "x", F.explode(F.concat(*(found(k) for k in KINDS))).alias("c")).select("doc_id", "x", "c.*").dropDuplicates(["doc_id", "x", "kind", "i"])
    upto = Window.partitionBy("doc_id", "x", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    return each.withColumn("end", end.cast("long")).withColumn("start", (F.col("end") - F.col("size")).cast("long")).drop("i", "gap", "size")


def votes(rows: DataFrame) -> DataFrame:
    """rows with `ok` (valid base spans) and the labelers' votes v0, v1 ... of -1, 0 or 1."""
    kind, m, before, after = (F.col(c) for c in ("kind", "match", "before", "after"))
    n = F.length(digits(m))
    mixed = m.rlike("[A-Za-z]") & m.rlike("[0-9]")
    vote = lambda yes, no=None: F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)
    base = rows.withColumn("ok", F.coalesce(valid(kind, m), F.lit(False)))
    secret, phone2 = kind == "secret", kind == "phone2"
    many = F.size(F.array_distinct(F.split(m, ""))) >= 9
    shaped = m.rlike("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$") | (m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]"))
    labelers = {
        "form": vote(F.col("ok") | (secret & mixed & many) | phone2, ~F.col("ok")),
        "strong": vote((kind == "email") & m.rlike(r"\.[A-Za-z]{2,24}$") | (kind == "card") & n.isin(15, 16) | (kind == "phone") & n.between(10, 13) | secret & shaped & many | (kind == "ip") & ~m.rlike(r"(?:^|\.)0[0-9]"), secret & (F.length(m) > 200)),
        "words": vote(before.rlike(FOR_WORDS)),
        "against": vote(F.lit(False), before.rlike(AGAINST_WORDS) | m.rlike(NOT_DATA)),
        "borders": vote(F.lit(False), before.rlike("[A-Za-z0-9_/.-]$") | after.rlike("^[A-Za-z0-9_/-]")),
        "runs": vote(F.lit(False), m.rlike(RUN)),
        "places": vote(F.lit(False), secret & (m.rlike(PATH_LIKE) | before.rlike(IN_ADDRESS))),
    }
    return base.select("*", *(labelers[name].cast("int").alias(f"v{k}") for k, name in enumerate(KNOWN)))


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _features(kinds: np.ndarray, voted: np.ndarray) -> np.ndarray:
    """A combination's kind, and its votes of yes and of no apart."""
    return np.column_stack([kinds[:, None] == np.arange(len(KINDS)), voted == 1, voted == -1]).astype(float)


def reliabilities(kinds: np.ndarray, voted: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The EM estimate for each combination (kind number, row of votes, count) that it is personal data.

    A base kind's combination is data if its form is (the first vote) and is not otherwise: these are sure.
    For the rest, a labeler's log odds for a vote are those that the weighted counts give, held within HOLD of
    what it is known for; a kind's prior is held likewise. Abstaining says nothing.
    """
    known = np.array([list(KNOWN[name]) for name in KNOWN])
    weight, prior = known.copy(), np.full(len(KINDS), PRIOR)
    sure = kinds < len(BASE)
    truth = (voted[:, 0] == 1).astype(float)
    spoke = np.stack([voted == 1, voted == -1], axis=2).astype(float)
    of_kind = (kinds[:, None] == np.arange(len(KINDS))).astype(float)

    def posterior() -> np.ndarray:
        odds = prior[kinds] + (spoke * weight).sum(axis=(1, 2))
        return np.where(sure, truth, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))

    for _ in range(rounds):
        yes = n * posterior()
        no = n - yes
        rate = lambda mass: (np.einsum("c,clv->lv", mass, spoke) + 1) / (mass.sum() + 3)
        weight = np.clip(np.log(rate(yes) / rate(no)), known - HOLD, known + HOLD)
        prior = np.clip(_logit((yes @ of_kind + 1) / (n @ of_kind + 2)), PRIOR - PRIOR_HOLD, PRIOR + PRIOR_HOLD)
    return posterior()


def train(kinds: np.ndarray, voted: np.ndarray, n: np.ndarray, posterior: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of the span classifier (kinds, votes of yes, votes of no): Newton steps on the log loss against the posteriors of the further kinds."""
    own = kinds >= len(BASE)
    x, y, mass = _features(kinds[own], voted[own]), posterior[own], n[own]
    theta = np.zeros(len(KINDS) + 2 * N_VOTES)
    if not own.any():
        return theta
    ridge = 1e-6 * np.eye(len(theta))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (mass * (y - p)) / mass.sum() - ridge @ theta
        step = np.linalg.solve((x * (mass * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x / mass.sum() + ridge, slope)
        theta = theta + step * min(1.0, 4.0 / max(float(np.abs(step).max()), 1e-12))
        if float(np.abs(step).max()) < 1e-9:
            break
    return theta


def classifier(combos: DataFrame) -> Column:
    """The probability that a voted candidate is personal data, fitted to the combinations (kind, v*, n); a base match has its check's 0 or 1."""
    rows = combos.collect()  # at most 3 ** N_VOTES rows a kind
    theta = np.zeros(len(KINDS) + 2 * N_VOTES)
    if rows:
        kinds, n = np.array([ORDER[r.kind] for r in rows]), np.array([r.n for r in rows], float)
        voted = np.array([[r[f"v{k}"] for k in range(N_VOTES)] for r in rows])
        theta = train(kinds, voted, n, reliabilities(kinds, voted, n))
    score = F.coalesce(*(F.when(F.col("kind") == kind, F.lit(float(theta[j]))) for kind, j in ORDER.items()))
    for k in range(N_VOTES):
        yes, no = float(theta[len(KINDS) + k]), float(theta[len(KINDS) + N_VOTES + k])
        score = score + F.when(F.col(f"v{k}") == 1, yes).when(F.col(f"v{k}") == -1, no).otherwise(0.0)
    return F.when(F.col("kind").isin(*BASE), F.col("ok").cast("double")).otherwise(1 / (1 + F.exp(-score)))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, x, kind, start, end, match, probability) of the spans that stay."""
    voted = cut(votes(candidates(docs)))
    combos = voted.groupBy("kind", *(f"v{k}" for k in range(N_VOTES))).agg(F.count(F.lit(1)).alias("n"))
    judged = voted.withColumn("probability", classifier(combos))
    return judged.filter(F.col("ok") | (F.col("kind").isin(*ADDED) & (F.col("probability") >= KEEP_AT))).select("doc_id", "x", "kind", "start", "end", "match", "ok", "probability")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rank = F.coalesce(*(F.when(F.col("kind") == kind, F.lit(k)) for kind, k in ORDER.items()))
    span = F.struct(rank.alias("k"), "start", "end", "kind")
    per_doc = detect(docs).groupBy("doc_id", "x").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), span))).alias("base"), F.array_sort(F.collect_list(F.when(~F.col("ok"), span))).alias("more"))
    more = F.filter("more", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("x").alias("_x"), "base", more.alias("more"))
    out = docs.select("doc_id", F.xxhash64("text").alias("_y")).join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_y") == F.col("_x")), "left")
    none = F.array().cast("array<struct<k:int,start:bigint,end:bigint,kind:string>>")
    out = out.withColumn("base", F.coalesce("base", none)).withColumn("more", F.coalesce("more", none))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(count(k) for k in BASE), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "more")).alias("spans"))
