"""Queries on two-source merging (F3-F6, J8-J13, M001-M003, A6, A10, U3, U4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.similarity import fuzzy, jaccard, sequence_ratio, words
from ..operators import findings as O
from ..operators import merge as M
from ..registry import query, table
from ..sources.corpus import FINDINGS_SQL, findings
from .findings import ID

W = f"WITH {FINDINGS_SQL}"
EDGE_SQL = W + f""", i AS (SELECT *, {ID} || ':' || idx || ':' || CAST(amount AS VARCHAR) AS fid FROM f), a AS (SELECT * FROM i WHERE source = 'ai'), b AS (SELECT * FROM i WHERE source = 'rule'),
j AS (SELECT a.doc_id, a.idx AS a_idx, b.idx AS b_idx, a.amount AS a_amount, b.amount AS b_amount, a.fid AS a_fid, b.fid AS b_fid, a.severity AS a_severity, b.severity AS b_severity, a.page AS a_page, b.page AS b_page,
  CASE WHEN a.title = b.title THEN 1.0::DOUBLE ELSE 12.0::DOUBLE / 14 END AS title_sim,
  CASE WHEN a.page IS NOT NULL AND b.page IS NOT NULL THEN CASE WHEN abs(a.page - b.page) <= 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END AS page_part,
  CASE WHEN a.section IS NOT NULL AND b.section IS NOT NULL THEN CASE WHEN a.section = b.section THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END END AS section_sim,
  CASE WHEN a.table_name IS NOT NULL AND b.table_name IS NOT NULL THEN CASE WHEN a.table_name = b.table_name THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END END AS table_sim,
  len(list_intersect([lower(a.tag1), lower(a.tag2)], [lower(b.tag1), lower(b.tag2)]))::DOUBLE / len(list_distinct([lower(a.tag1), lower(a.tag2), lower(b.tag1), lower(b.tag2)])) AS tag_sim,
  CASE WHEN abs(a.amount - b.amount) / greatest(a.amount, b.amount) <= 0.005 THEN 1.0::DOUBLE ELSE 1 - abs(a.amount - b.amount) / greatest(a.amount, b.amount) END AS metric_sim
  FROM a JOIN b ON a.doc_id = b.doc_id),
l AS (SELECT *, (CASE WHEN page_part IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END) + (CASE WHEN section_sim IS NULL THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END) + (CASE WHEN table_sim IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END) AS weight,
  coalesce(page_part, 0.0::DOUBLE) + coalesce(section_sim * 0.3::DOUBLE, 0.0::DOUBLE) + coalesce(table_sim * 0.2::DOUBLE, 0.0::DOUBLE) AS got FROM j),
e AS (SELECT *, round(title_sim * 0.4::DOUBLE + (CASE WHEN weight > 0 THEN got / weight ELSE 0.0::DOUBLE END) * 0.3::DOUBLE + tag_sim * 0.2::DOUBLE + metric_sim * 0.1::DOUBLE, 6) AS score FROM l)
"""

# The greedy matching edge by edge, documents side by side: g holds what is taken after each edge.
MATCH_SQL = EDGE_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, a_idx DESC, b_idx DESC, a_fid DESC, b_fid DESC) AS r FROM e WHERE score >= 0.85),
g AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[]) AS ua, CAST([] AS VARCHAR[]) AS ub, false AS ok FROM o
  UNION ALL SELECT o.doc_id, o.r, CASE WHEN list_contains(g.ua, o.a_fid) OR list_contains(g.ub, o.b_fid) THEN g.ua ELSE list_append(g.ua, o.a_fid) END,
    CASE WHEN list_contains(g.ua, o.a_fid) OR list_contains(g.ub, o.b_fid) THEN g.ub ELSE list_append(g.ub, o.b_fid) END,
    NOT (list_contains(g.ua, o.a_fid) OR list_contains(g.ub, o.b_fid)) FROM g JOIN o ON o.doc_id = g.doc_id AND o.r = g.r + 1),
m AS (SELECT o.* FROM o JOIN g ON o.doc_id = g.doc_id AND o.r = g.r WHERE g.ok),
q AS (SELECT *, CASE WHEN abs(coalesce(list_position(['info', 'low', 'medium', 'high', 'critical'], a_severity), 0) - coalesce(list_position(['info', 'low', 'medium', 'high', 'critical'], b_severity), 0)) >= 2 THEN 'severity-mismatch'
  WHEN a_amount <> 0 AND b_amount <> 0 AND abs(a_amount - b_amount) / greatest(abs(a_amount), abs(b_amount)) > 0.005 THEN 'value-mismatch'
  WHEN a_page > 0 AND b_page > 0 AND abs(a_page - b_page) > 1 THEN 'page-mismatch' ELSE 'agreement' END AS reason FROM m),
nm AS (SELECT doc_id, count(*) AS n_matched, count(*) FILTER (reason <> 'agreement') AS n_conflicts FROM q GROUP BY 1),
s AS (SELECT n.doc_id, n_ai, n_rule, coalesce(n_matched, 0) AS n_matched, coalesce(n_conflicts, 0) AS n_conflicts FROM (SELECT doc_id, count(*) FILTER (source = 'ai') AS n_ai, count(*) FILTER (source = 'rule') AS n_rule FROM f GROUP BY 1) n LEFT JOIN nm USING (doc_id)),
left_over AS (SELECT doc_id, source, fid FROM i WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = i.doc_id AND i.fid IN (m.a_fid, m.b_fid)))
"""


def with_ids(spark, sf):
    f = findings(spark, sf)
    return f.withColumn("finding_id", F.concat_ws(":", O.finding_id(f), "idx", F.col("amount").cast("string")))


@query("j8_similar_pairs", EDGE_SQL + "SELECT doc_id, a_idx, b_idx, a_amount, b_amount, score FROM e WHERE score >= 0.85")
def j8(spark, sf):
    return M.edges(with_ids(spark, sf)).select("doc_id", "a_idx", "b_idx", "a_amount", "b_amount", "score")


@query("f5_finding_similarity", EDGE_SQL + "SELECT doc_id, a_idx, b_idx, a_amount, b_amount, score FROM e WHERE score >= 0.5")
def f5(spark, sf):
    return M.edges(with_ids(spark, sf), 0.5).select("doc_id", "a_idx", "b_idx", "a_amount", "b_amount", "score")


@query("f4_sequence_ratio", W + " SELECT doc_id, idx, CASE u % 7 WHEN 3 THEN 1.0::DOUBLE ELSE 12.0::DOUBLE / 14 END AS ratio FROM f")
def f4(spark, sf):
    f = findings(spark, sf)
    return f.select("doc_id", "idx", sequence_ratio("title", F.lit("第3项预算差异")).alias("ratio"))


@query("f3_fuzzy_ratios", W + " SELECT doc_id, idx, CASE u % 7 WHEN 3 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * 6 / 14 END AS ratio, CASE u % 7 WHEN 3 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * 6 / 14 END AS token_sort FROM f")
def f3(spark, sf):
    f = findings(spark, sf).withColumn("z", fuzzy("title", F.lit("第3项预算差异")))
    return f.select("doc_id", "idx", "z.ratio", "z.token_sort")


@query("f6_issue_similarity", "WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(lang || ' ' || left(text, 200)), '\\s+'), lambda x: x <> '')) AS b FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) ELSE 0 END, 6) AS sim FROM w")
def f6(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    other = F.concat_ws(" ", "lang", F.substring("text", 1, 200))
    return d.select("doc_id", F.round(jaccard(words(F.col("text")), words(other)), 6).alias("sim"))


#: A name of two words against one of three written forms of it, and the four ratios worked out by hand.
RATIO_SQL = W + """, v(form, same, ratio, partial, token_sort, token_set) AS (VALUES
  (0, true, 100.0::DOUBLE, 100.0::DOUBLE, 100.0::DOUBLE, 100.0::DOUBLE), (0, false, 1400.0::DOUBLE / 16, 1400.0::DOUBLE / 16, 1400.0::DOUBLE / 16, 1400.0::DOUBLE / 16),
  (1, true, 50.0::DOUBLE, 800.0::DOUBLE / 12, 100.0::DOUBLE, 100.0::DOUBLE), (1, false, 50.0::DOUBLE, 800.0::DOUBLE / 12, 1400.0::DOUBLE / 16, 1400.0::DOUBLE / 16),
  (2, true, 1600.0::DOUBLE / 24, 100.0::DOUBLE, 1600.0::DOUBLE / 24, 100.0::DOUBLE), (2, false, 1400.0::DOUBLE / 24, 1400.0::DOUBLE / 16, 1400.0::DOUBLE / 24, 1400.0::DOUBLE / 19))
SELECT doc_id, idx, ratio, partial, token_sort, token_set FROM f JOIN v ON v.form = idx % 3 AND v.same = (u % 7 = 3)"""


@query("f3b_four_ratios", RATIO_SQL)
def f3b(spark, sf):
    """All four ratios of names with words in order, turned round, and among others."""
    n = F.regexp_extract("title", "第(\\d)项", 1)
    name = F.concat(F.lit("第"), n, F.lit("项"))
    form = F.when(F.col("idx") % 3 == 0, F.concat(name, F.lit(" 预算差异"))).when(F.col("idx") % 3 == 1, F.concat(F.lit("预算差异 "), name)).otherwise(F.concat(F.lit("附注 "), name, F.lit(" 预算差异 预算差异")))
    return findings(spark, sf).withColumn("z", fuzzy(form, F.lit("第3项 预算差异"))).select("doc_id", "idx", "z.*")


@query("f6b_similar_findings", W + """, p AS (SELECT a.doc_id, a.idx AS a_idx, b.idx AS b_idx, round(CASE WHEN a.rule_id = b.rule_id THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN a.title = b.title THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN a.section = b.section THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 6) AS sim FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.source = 'ai' AND b.source = 'rule') SELECT * FROM p WHERE sim >= 0.4""")
def f6b(spark, sf):
    """Pairs of findings by all three terms: rule, shared words, one section in the other."""
    return M.similar_findings(findings(spark, sf), 0.4).select("doc_id", "a_idx", "b_idx", "sim")


@query("j9_greedy_matching", MATCH_SQL + "SELECT doc_id, a_fid AS a_finding_id, b_fid AS b_finding_id, score FROM m")
def j9(spark, sf):
    return M.greedy_matches(M.edges(with_ids(spark, sf))).select("doc_id", "a_finding_id", "b_finding_id", "score")


def _judged(f):
    return M.conflicts(M.greedy_matches(M.edges(f)))


@query("j11_unmatched", MATCH_SQL + "SELECT doc_id, source, fid AS finding_id FROM left_over")
def j11(spark, sf):
    """Findings of either source that the one-to-one matching leaves over."""
    f = with_ids(spark, sf)
    return M.unmatched(f, M.greedy_matches(M.edges(f))).select("doc_id", "source", "finding_id")


@query("u3_merged_ids", MATCH_SQL + "SELECT doc_id, a_fid AS finding_id, 1 AS part FROM m UNION ALL SELECT doc_id, fid, CASE source WHEN 'ai' THEN 2 ELSE 3 END FROM left_over")
def u3(spark, sf):
    """Merged id list: matched ai ids, then ai-only, then rule-only."""
    f = with_ids(spark, sf)
    matches = M.greedy_matches(M.edges(f))
    rest = M.unmatched(f, matches).select("doc_id", "finding_id", F.when(F.col("source") == "ai", 2).otherwise(3).alias("part"))
    return matches.select("doc_id", F.col("a_finding_id").alias("finding_id"), F.lit(1).alias("part")).unionByName(rest)


@query("u4_displayed", MATCH_SQL + "SELECT doc_id, finding_id, max(kind) AS kind FROM (SELECT doc_id, a_fid AS finding_id, CASE reason WHEN 'agreement' THEN 1 ELSE 2 END AS kind FROM q UNION ALL SELECT doc_id, b_fid, 2 FROM q WHERE reason <> 'agreement' UNION ALL SELECT doc_id, fid, 3 FROM left_over) GROUP BY ALL")
def u4(spark, sf):
    """Agreements (the ai side), both sides of conflicts, the unmatched; one row for each id, of the last kind."""
    f = with_ids(spark, sf)
    judged = _judged(f)
    apart = judged.where("reason <> 'agreement'")
    shown = judged.select("doc_id", F.col("a_finding_id").alias("finding_id"), F.when(F.col("reason") == "agreement", 1).otherwise(2).alias("kind"))
    shown = shown.unionByName(apart.select("doc_id", F.col("b_finding_id").alias("finding_id"), F.lit(2).alias("kind")))
    shown = shown.unionByName(M.unmatched(f, judged).select("doc_id", "finding_id", F.lit(3).alias("kind")))
    return shown.groupBy("doc_id", "finding_id").agg(F.max("kind").alias("kind"))


@query("m001_dual_merge", MATCH_SQL + "SELECT doc_id, a_fid AS a_finding_id, b_fid AS b_finding_id, reason FROM q")
def m001(spark, sf):
    return _judged(with_ids(spark, sf)).select("doc_id", "a_finding_id", "b_finding_id", "reason")


@query("a6_merge_totals", MATCH_SQL + "SELECT doc_id, n_ai, n_rule, n_ai + n_rule - n_matched AS n_merged, n_conflicts, n_matched - n_conflicts AS n_agreements, n_ai - n_matched AS ai_only, n_rule - n_matched AS rule_only FROM s")
def a6(spark, sf):
    f = with_ids(spark, sf)
    return M.summary(f, _judged(f)).select("doc_id", "n_ai", "n_rule", "n_merged", "n_conflicts", "n_agreements", "ai_only", "rule_only")


@query("a10_agreement_rates", MATCH_SQL + "SELECT doc_id, CASE WHEN n_matched > 0 THEN (n_matched - n_conflicts)::DOUBLE / n_matched ELSE 0.0::DOUBLE END AS agreement_rate, n_conflicts > 0.3 * (n_ai + n_rule - n_matched) AS alarm FROM s")
def a10(spark, sf):
    """Rates over the matched findings; the alarm when conflicts pass 30% of the merged ones."""
    f = with_ids(spark, sf)
    return M.summary(f, _judged(f)).select("doc_id", "agreement_rate", "alarm")


FIRST_SQL = W + ", s AS (SELECT a.doc_id, a.idx AS a_idx, a.amount AS a_amount, min(b.idx) AS rule_idx FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.source = 'ai' AND b.source = 'rule' WHERE a.rule_id = b.rule_id AND a.title = b.title GROUP BY ALL)"


@query("j10_first_rule", FIRST_SQL + " SELECT * FROM s")
def j10(spark, sf):
    return M.first_rule(findings(spark, sf))


LAYERED_SQL = W + f""", v AS (SELECT *, {ID} || ':' || idx || ':' || CAST(amount AS VARCHAR) AS fid FROM f WHERE rule_id <> '' AND length(trim(message)) > 5),
p AS (SELECT a.doc_id, a.fid AS a_fid, a.idx AS a_idx, a.message AS said, b.fid AS b_fid, row_number() OVER (PARTITION BY a.doc_id, a.fid ORDER BY b.idx, b.amount, b.fid) AS r
  FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.source = 'ai' AND b.source = 'rule' AND a.rule_id = b.rule_id AND a.title = b.title),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, b_fid ORDER BY length(said) DESC, a_idx, said DESC) AS place, count(*) OVER (PARTITION BY doc_id, b_fid) AS n FROM p WHERE r = 1),
u AS (SELECT v.doc_id, rule_id, source, severity, title, section, idx, amount, fid, CASE WHEN length(said) > length(message) THEN said ELSE message END AS message,
    CASE WHEN n > 0 AND confidence < 3 THEN confidence + 1 ELSE confidence END AS confidence, coalesce(n, 0) AS n_ai
  FROM v LEFT JOIN t ON t.doc_id = v.doc_id AND t.b_fid = v.fid AND place = 1 WHERE source = 'rule'
  UNION ALL SELECT doc_id, rule_id, source, severity, title, section, idx, amount, fid, message, confidence, 0 FROM v WHERE source = 'ai' AND NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = v.doc_id AND p.a_fid = v.fid)),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id, message, section ORDER BY source DESC, idx, amount, fid) AS copy FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'error' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END DESC, confidence DESC, source DESC, idx, amount, fid) AS place FROM d WHERE copy = 1)
SELECT doc_id, rule_id, title, idx, message, confidence, n_ai FROM k WHERE place <= """


@query("m002_layered_merge", LAYERED_SQL + "50")
def m002(spark, sf):
    return M.layered_merge(with_ids(spark, sf)).select("doc_id", "rule_id", "title", "idx", "message", "confidence", "n_ai")


def _verdicts(f):
    action = F.when(F.col("idx") % 4 == 0, "CONFIRM").when(F.col("idx") % 4 == 1, "REJECT").when(F.col("idx") % 4 == 2, "ENHANCE")
    return f.select("finding_id", action.alias("action"), F.lit("更清楚的说明").alias("description")).where("action is not null").dropDuplicates(["finding_id"])


VERDICT_SQL = " SELECT doc_id, idx, CASE WHEN idx % 4 = 0 AND confidence < 2 THEN 2 ELSE confidence END AS confidence, CASE WHEN idx % 4 = 2 THEN '更清楚的说明' ELSE message END AS message FROM f WHERE idx % 4 <> 1"


@query("j12_verdicts", W + VERDICT_SQL)
def j12(spark, sf):
    f = with_ids(spark, sf)
    return M.verdict(f, _verdicts(f)).select("doc_id", "idx", "confidence", "message")


NEW_SQL = ", c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, amount) AS r FROM f WHERE source = 'ai') SELECT doc_id, idx, amount FROM c WHERE r <= 10 AND confidence >= 2 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.source = 'rule' AND g.doc_id = c.doc_id AND g.title = c.title AND coalesce(g.section, '') = coalesce(c.section, ''))"


@query("j13_new_issues", W + NEW_SQL)
def j13(spark, sf):
    f = findings(spark, sf)
    return M.newly_found(f.where("source = 'ai'"), f.where("source = 'rule'")).select("doc_id", "idx", "amount")


PASS_SQL = (
    W
    + """, v AS (SELECT doc_id, 'kept' AS origin, idx, amount, CASE WHEN idx % 4 = 0 AND confidence < 2 THEN 2 ELSE confidence END AS confidence, CASE WHEN idx % 4 = 2 THEN '更清楚的说明' ELSE message END AS message FROM f WHERE source = 'rule' AND idx % 4 <> 1),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, amount) AS r FROM f WHERE source = 'ai'),
n AS (SELECT doc_id, 'new' AS origin, idx, amount, confidence, message FROM c WHERE r <= 10 AND confidence >= 2 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.source = 'rule' AND g.doc_id = c.doc_id AND g.title = c.title AND coalesce(g.section, '') = coalesce(c.section, '') AND g.idx % 4 <> 1))
SELECT doc_id, origin, idx, amount, confidence, CASE WHEN idx % 3 = 0 THEN '补充后的完整说明' ELSE message END AS message FROM (SELECT * FROM v UNION ALL SELECT * FROM n)"""
)


@query("m003_verdict_pass", PASS_SQL)
def m003(spark, sf):
    """Verdicts on the rule findings, new findings that those kept don't have, then better descriptions for both."""
    f = with_ids(spark, sf)
    rules = f.where("source = 'rule'")
    columns = ["finding_id", "doc_id", "origin", "idx", "amount", "confidence", "message"]
    kept = M.verdict(rules, _verdicts(rules))
    new = M.newly_found(f.where("source = 'ai'"), kept)
    both = kept.withColumn("origin", F.lit("kept")).select(*columns).unionByName(new.withColumn("origin", F.lit("new")).select(*columns))
    texts = f.select("finding_id", F.when(F.col("idx") % 3 == 0, "补充后的完整说明").otherwise(" ").alias("description")).dropDuplicates(["finding_id"])
    return M.enhanced(both, texts).drop("finding_id")
