"""Merging findings of two sources: candidate edges, matching, conflicts, layered merge, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import jaccard, location, metric, sequence_ratio, words
from ..registry import written


def edges(f: DataFrame, threshold: float = 0.85) -> DataFrame:
    """J8 with F5: pairs of an ai and a rule finding of one document at or above the threshold. Without a common
    tag a pair reaches .8 at most, so above that the join is by document and tag (a pair counts at its first one)."""
    keep = ["doc_id", "idx", "title", "section", "table_name", "page", "tags", "amount", "severity", "finding_id"]
    a = f.where("source = 'ai'").select([F.col(c).alias(c if c == "doc_id" else f"a_{c}") for c in keep])
    b = f.where("source = 'rule'").select([F.col(c).alias(c if c == "doc_id" else f"b_{c}") for c in keep])
    lower = lambda c: F.transform(F.col(c), lambda x: F.lower(x))
    if threshold > 0.8:
        by_tag = lambda f, c: f.withColumn("tag", F.explode(F.array_distinct(lower(c))))
        p = by_tag(a, "a_tags").join(by_tag(b, "b_tags"), ["doc_id", "tag"])
        p = p.where(F.col("tag") == F.array_min(F.array_intersect(lower("a_tags"), lower("b_tags")))).drop("tag")
    else:
        p = a.join(b, "doc_id")
    # string similarities run in Python: only pairs that could still reach the threshold with equal strings get there
    one = F.lit(1.0)
    tags, amounts = jaccard(lower("a_tags"), lower("b_tags")), metric(F.col("a_amount"), F.col("b_amount"))
    known = lambda c: F.when(F.col(f"a_{c}").isNotNull() & F.col(f"b_{c}").isNotNull(), one)
    best = 0.4 + location(F.col("a_page"), F.col("b_page"), known("section"), known("table_name")) * 0.3 + tags * 0.2 + amounts * 0.1
    p = p.where(best >= threshold - 1e-6)
    p = p.withColumns({
        "title_sim": sequence_ratio(F.lower("a_title"), F.lower("b_title")),
        "section_sim": sequence_ratio(F.col("a_section"), F.col("b_section")),
        "table_sim": sequence_ratio(F.col("a_table_name"), F.col("b_table_name")),
    })
    score = (
        F.col("title_sim") * 0.4
        + location(F.col("a_page"), F.col("b_page"), F.col("section_sim"), F.col("table_sim")) * 0.3
        + tags * 0.2
        + amounts * 0.1
    )
    return p.withColumn("score", F.round(score, 6)).where(F.col("score") >= threshold)


def greedy_matches(e: DataFrame) -> DataFrame:
    """One-to-one matching by score, ties to the larger indexes. Round by round every edge that is the best of
    both its ends is taken and the other edges of these ends go, which takes what going through all edges in order
    takes. A round is windows over one exchange by document, written, so that the next starts from a table; there
    are as many rounds as the longest chain of edges that wait for one another, a few where scores are mixed."""
    order = ["score", "a_idx", "b_idx", "a_finding_id", "b_finding_id"]
    left = e.select("doc_id", "a_idx", "b_idx", "a_finding_id", "b_finding_id", "a_severity", "b_severity", "a_page", "b_page", "a_amount", "b_amount", "score").repartition("doc_id")
    best = [F.row_number().over(Window.partitionBy("doc_id", c).orderBy(*map(F.desc, order))) == 1 for c in ("a_finding_id", "b_finding_id")]
    ends = [F.max("taken").over(Window.partitionBy("doc_id", c)) for c in ("a_finding_id", "b_finding_id")]
    taken = []
    while True:
        turn = written(left.withColumn("taken", best[0] & best[1]).withColumn("gone", ends[0] | ends[1]).where("taken or not gone"))
        taken.append(turn.where("taken").drop("taken", "gone"))
        left = turn.where("not gone").drop("taken", "gone")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, taken)
        left = left.repartition("doc_id")


def unmatched(f: DataFrame, matches: DataFrame) -> DataFrame:
    """Findings of either source without a partner."""
    taken = matches.select("doc_id", F.explode(F.array("a_finding_id", "b_finding_id")).alias("finding_id"))
    return f.join(taken, ["doc_id", "finding_id"], "left_anti")


LEVELS = {"info": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}


def conflicts(matches: DataFrame, reach: int = 1, tolerance: float = 0.005) -> DataFrame:
    """M001: first reason that applies: severity two levels apart, amounts apart, pages apart; else agreement."""
    level = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col(c)], F.lit(0))
    a, b = F.col("a_amount"), F.col("b_amount")
    apart = (a != 0) & (b != 0) & (F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)) > tolerance)
    pages = F.coalesce((F.col("a_page") > 0) & (F.col("b_page") > 0) & (F.abs(F.col("a_page") - F.col("b_page")) > reach), F.lit(False))
    reason = F.when(F.abs(level("a_severity") - level("b_severity")) >= 2, "severity-mismatch").when(apart, "value-mismatch").when(pages, "page-mismatch")
    return matches.withColumn("reason", F.coalesce(reason, F.lit("agreement")))


def summary(f: DataFrame, judged: DataFrame) -> DataFrame:
    """Totals of each document, rates, and the alarm when conflicts pass 30% of findings."""
    n = f.groupBy("doc_id").agg(F.count_if(F.col("source") == "ai").alias("n_ai"), F.count_if(F.col("source") == "rule").alias("n_rule"))
    m = judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_matched"), F.count_if(F.col("reason") != "agreement").alias("n_conflicts"))
    out = n.join(m, "doc_id", "left").na.fill(0, ["n_matched", "n_conflicts"])
    merged = F.col("n_ai") + F.col("n_rule") - F.col("n_matched")
    return out.withColumns({
        "n_merged": merged, "n_agreements": F.col("n_matched") - F.col("n_conflicts"), "ai_only": F.col("n_ai") - F.col("n_matched"), "rule_only": F.col("n_rule") - F.col("n_matched"),
        "agreement_rate": F.when(F.col("n_matched") > 0, (F.col("n_matched") - F.col("n_conflicts")) / F.col("n_matched")).otherwise(0.0),
        "alarm": F.col("n_conflicts") > 0.3 * merged,
    })


def similar_findings(f: DataFrame, threshold: float = 0.8, extra: tuple[str, ...] = ()) -> DataFrame:
    """pairs of an ai and a rule finding of one document: .4 same rule, .4 shared words, .2 one section in the other.
    Above .6 only findings of one rule can meet, which the join uses."""
    keep = ["doc_id", "idx", "rule_id", "title", "section", "amount", *extra]
    a = f.where("source = 'ai'").select([F.col(c).alias(c if c == "doc_id" else f"a_{c}") for c in keep])
    b = f.where("source = 'rule'").select([F.col(c).alias(c if c == "doc_id" else f"b_{c}") for c in keep])
    p = a.join(b, (a["doc_id"] == b["doc_id"]) & (F.col("a_rule_id") == F.col("b_rule_id")) if threshold > 0.6 else a["doc_id"] == b["doc_id"]).drop(b["doc_id"])
    same = F.when(F.col("a_rule_id") == F.col("b_rule_id"), 0.4).otherwise(0.0)
    within = F.coalesce(F.col("a_section").contains(F.col("b_section")) | F.col("b_section").contains(F.col("a_section")), F.lit(False))
    sim = same + jaccard(words(F.col("a_title")), words(F.col("b_title"))) * 0.4 + F.when(within, 0.2).otherwise(0.0)
    return p.withColumn("sim", F.round(sim, 6)).where(F.col("sim") >= threshold)


def first_rule(f: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Every ai finding goes to the first rule finding it resembles."""
    return similar_findings(f, threshold).groupBy("doc_id", "a_idx", "a_amount").agg(F.min("b_idx").alias("rule_idx"))


def layered_merge(f: DataFrame, threshold: float = 0.8, most: int = 50) -> DataFrame:
    """M002: findings without a rule or a message of over five characters go; an ai finding joins the first rule
    finding it resembles, which takes the longest of such messages when longer than its own and one step of
    confidence (up to 3); equal rule, message and section stay once; of more than `most` in a document the
    gravest and surest stay. All windows follow the document, so one exchange by doc_id serves them."""
    valid = f.where((F.col("rule_id") != "") & (F.length(F.trim("message")) > 5))
    pairs = similar_findings(valid, threshold, ("finding_id", "message"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "a_finding_id").orderBy("b_idx", "b_amount", "b_finding_id"))
    taken = pairs.withColumn("turn", turn).where("turn = 1")
    longest = F.max_by("a_message", F.struct(F.length("a_message"), -F.col("a_idx"), "a_message")).alias("said")
    helped = taken.groupBy("doc_id", F.col("b_finding_id").alias("finding_id")).agg(longest, F.count(F.lit(1)).alias("n_ai"))
    rules = valid.where("source = 'rule'").join(helped, ["doc_id", "finding_id"], "left").withColumns({
        "message": F.when(F.length("said") > F.length("message"), F.col("said")).otherwise(F.col("message")),
        "confidence": F.when((F.col("n_ai") > 0) & (F.col("confidence") < 3), F.col("confidence") + 1).otherwise(F.col("confidence")),
    })
    alone = valid.where("source = 'ai'").join(taken.select("doc_id", F.col("a_finding_id").alias("finding_id")), ["doc_id", "finding_id"], "left_anti")
    every = rules.drop("said").unionByName(alone, allowMissingColumns=True).withColumn("n_ai", F.coalesce("n_ai", F.lit(0)).cast("long"))
    order = [F.desc("source"), "idx", "amount", "finding_id"]  # rule findings first
    copies = F.row_number().over(Window.partitionBy("doc_id", "rule_id", "message", "section").orderBy(*order))
    gravity = F.when(F.col("severity") == "error", 3).when(F.col("severity") == "warn", 2).otherwise(1)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(gravity.desc(), F.desc("confidence"), *order))
    once = every.withColumn("copy", copies).where("copy = 1")
    return once.withColumn("place", place).where(F.col("place") <= most).drop("copy", "place")


def enhanced(f: DataFrame, texts: DataFrame) -> DataFrame:
    """Last step of M003: findings take the description written for them, where one is given that isn't blank."""
    met = f.join(texts.select("finding_id", F.col("description").alias("better")), "finding_id", "left")
    return met.withColumn("message", F.when(F.trim("better") != "", F.col("better")).otherwise(F.col("message"))).drop("better")


def verdict(f: DataFrame, verdicts: DataFrame) -> DataFrame:
    """CONFIRM lifts low confidence, REJECT drops, ENHANCE replaces the message, others stay."""
    met = f.join(verdicts, "finding_id", "left").where("action is null or action <> 'REJECT'")
    return met.withColumns({
        "confidence": F.when((F.col("action") == "CONFIRM") & (F.col("confidence") < 2), 2).otherwise(F.col("confidence")),
        "message": F.when(F.col("action") == "ENHANCE", F.coalesce("description", "message")).otherwise(F.col("message")),
    })


def newly_found(candidates: DataFrame, known: DataFrame, most: int = 10) -> DataFrame:
    """A document's first candidates of medium confidence or more that aren't known by text."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx", "amount"))
    first = candidates.withColumn("r", rank).where(F.col("r") <= most).where("confidence >= 2")
    key = F.lower(F.concat_ws(":", "title", F.coalesce("section", F.lit(""))))
    return first.withColumn("k", key).join(known.select("doc_id", key.alias("k")).distinct(), ["doc_id", "k"], "left_anti")
