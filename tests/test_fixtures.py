"""Small Chinese fixtures with answers worked out by hand, and brute-force checks of iterative operators."""

import difflib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.functions import numbers as N
from tallyglass.functions import similarity as S
from tallyglass.functions import text as X
from tallyglass.operators import evidence as E
from tallyglass.operators import findings as O
from tallyglass.operators import merge as M
from tallyglass.operators import prose as P
from tallyglass.operators import tables as T
from tallyglass.plans.merging import with_ids
from tallyglass.registry import RuleBook


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_strict_cells(spark):
    got = column(spark, ["1,234.5", "12%", "—", "abc", "-3", "", None, "１２"], lambda v: N.parse_cell(v).cast("double"))
    assert got[:7] == [1234.5, 12, None, None, -3, None, None]


def test_robust_numbers(spark):
    got = column(spark, ["(123.45)", "15.5%", "1,234.56万元", "三千五百万", "12\n34", "约8.5左右", "—", None], lambda v: N.parse_robust(v).cast("double"))
    assert got == [-123.45, 15.5, 12345600, 35000000, 1234, 8.5, None, None]


def test_numerals(spark):
    got = column(spark, ["十", "二十一", "三千五百万", "一亿零三百", "两千零五", "x"], N.numeral)
    assert got == [10, 21, 35000000, 100000300, 2005, None]
    got = column(spark, ["壹万贰千叁百肆拾伍", "叁仟伍佰萬", "二○二四", "一兆零五", "三千万亿", "壹億○伍", "九千亿兆", None], N.numeral)
    assert got == [12345, 35000000, 4, 10**12 + 5, 3 * 10**15, 100000005, None, None]
    assert column(spark, ["人民币壹万贰千叁百肆拾伍元整", "减少伍佰"], lambda v: N.parse_robust(v).cast("double")) == [12345, -500]


def test_units(spark):
    assert column(spark, ["12,345.67亿元", "3千元", "无"], lambda v: N.amount_in_yuan(v).cast("double")) == [1234567000000, 3000, None]


def test_ordinals(spark):
    assert column(spark, [1, 10, 11, 20, 21, 99, 100], N.ordinal, "int") == ["一", "十", "十一", "二十", "二十一", "九十九", "100"]


def test_years_units_and_text(spark):
    assert column(spark, ["2013901 2024年度", None, "2023-2024"], X.years) == [[2024], [], [2023]]
    assert column(spark, ["单位： 万元", "单位"], X.money_unit) == ["万元", None]
    assert column(spark, ["部门预算编制", None], X.settled_wording) == ["部门决算编制", None]
    assert column(spark, ["", None, "部门"], X.quality) == [0.0, 0.0, 1.0]


def test_tolerances(spark):
    rows = spark.createDataFrame([(50.0, 51.0), (1000.0, 1004.0), (1000.0, 1006.0), (20000.0, 20070.0)], "a double, b double")
    got = rows.select((F.abs(F.col("a") - F.col("b")) <= N.dynamic_tolerance(F.col("a"), F.col("b"))).alias("x")).collect()
    assert [r.x for r in got] == [True, True, False, False]


def comparison(spark, text):
    pages = spark.createDataFrame([(1, 1, text)], "doc_id long, page_no int, text string")
    return sorted((r.kind, r.severity) for r in P.verdicts(P.accepted(P.candidates(P.sections(pages)))).collect())


HEAD = "（三）一般公共预算财政拨款支出决算具体情况\n其中：\n1、"


def test_budget_against_final(spark):
    say = lambda b, a, phrase, more="": f"{HEAD}年初预算为{b}万元，支出决算为{a}万元，决算数{phrase}预算数。{more}"
    assert comparison(spark, say("232.02", "219.24", "大于", "主要原因：调整。")) == [("mismatch", "error")]
    assert comparison(spark, say("100", "100", "基本持平")) == [("wording", "warn")]
    assert comparison(spark, say("100", "200", "大于")) == [("no_reason", "error")]
    assert comparison(spark, say("100", "200", "大于", "主要原因：补。")) == []
    assert comparison(spark, say("100", "200", "小于", "同比增长。主要原因：补。")) == []
    assert comparison(spark, say("1,200", "1,100.5", "大于", "主要原因：补。")) == [("mismatch", "error")]
    assert comparison(spark, say("1,2,3", "200", "大于")) == []
    assert comparison(spark, "没有这一节") == []


def test_cell_rules(spark):
    rows = [[["科目", "占比"], ["a", "120%"], ["b", "-5"], ["c"]]]
    from tallyglass.sources.corpus import cells

    c = cells(spark.createDataFrame([(1, 1, rows)], "doc_id long, page_no int, tables array<array<array<string>>>"))
    assert sorted((r.row_ix, r.severity) for r in T.validity(c).collect()) == [(2, "error"), (3, "warn")]
    table = [[["项目", "金额"], ["甲", "10"], ["乙", "20"], ["其中", "5"], ["合计", "40"]], [["收入", "支出"], ["合计", "1"]]]
    c = cells(spark.createDataFrame([(1, 1, table)], "doc_id long, page_no int, tables array<array<array<string>>>"))
    assert [(float(r.sum_value), float(r.total_value), r.total_row) for r in T.totals(c).collect()] == [(30, 40, 5)]


def test_nearby_groups(spark):
    hits = [(1, 1, i, float(c), 0.0, float(c), 0.0, "x") for i, c in enumerate([0, 90, 180, 400])]
    g = E.grouped(spark.createDataFrame(hits, "doc_id long, page_no int, hit long, x1 double, y1 double, x2 double, y2 double, text string"))
    assert sorted((r.hit, r.grp) for r in g.collect()) == [(0, 1), (1, 1), (2, 1), (3, 2)]


def test_snapshots(spark):
    rows = [(1, "merged", 1, [5]), (1, "merged", 2, []), (2, "merged", 1, [5]), (2, "merged", 2, None), (2, "merged", 3, [])]
    out = {r.doc_id: r.value for r in O.upsert(spark.createDataFrame(rows, "doc_id long, key string, seq long, value array<int>")).collect()}
    assert out == {1: [5], 2: []}


def against_sql(spark, folder, name, **tables):
    """A query's rows and its oracle's over small tables (schema, rows) written to a folder."""
    import duckdb

    from tallyglass.plans import load
    from tallyglass.registry import ORACLES, QUERIES

    load()
    db = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    return sorted(map(tuple, df.collect()), key=str), sorted(db.execute(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall(), key=str)


LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def line(order, number, part):
    import datetime

    return (order, number, part, 1, 10.0, 1.0, "A", "F", datetime.datetime(2024, 1, 1))


def test_ordinals_of_documents_with_many_findings(spark, tmp_path):
    rows = [line(n, i, 5) for n in (1, 10, 11, 19, 20, 21, 30, 99, 100, 123) for i in range(n)]
    got, want = against_sql(spark, tmp_path, "f12_ordinals", lineitem=(LINES, rows))
    assert got == want and (21, "二十一") in got and (123, "123") in got


def test_snapshots_of_equal_rank(spark, tmp_path):
    """Parts beyond a million give snapshots of two lines the same place: a null comes last, else the greater value."""
    rows = [line(1, 1, 1_000_001), line(1, 2, 1), line(2, 1, 1_000_010), line(2, 2, 10), line(3, 1, 1_000_006), line(3, 2, 6), line(4, 1, 1_000_027), line(4, 2, 28), line(4, 2, 27)]
    rows += [line(5, 1, 1_000_013), line(5, 2, 14), line(5, 1, 1_000_014)]
    for order in (rows, rows[::-1]):
        got, want = against_sql(spark, tmp_path, "s13_snapshot_upsert", lineitem=(LINES, order))
        assert got == want
    snaps = [(1, "a", 5, [1]), (1, "a", 5, None), (2, "a", 5, [1]), (2, "a", 5, [3]), (2, "a", 5, [2]), (3, "a", -7, [4])]
    out = {r.doc_id: r.value for r in O.upsert(spark.createDataFrame(snaps, "doc_id long, key string, seq long, value array<int>")).collect()}
    assert out == {1: None, 2: [3], 3: [4]}


def test_contents_meet_pages_without_a_join(spark):
    """Titles listed twice, on one side only, and moved; the plan holds no join that could be broadcast."""
    from tallyglass.operators import checks as K

    entries = [(1, 1, "甲表", 3), (1, 2, "乙表", 4), (1, 3, "丙表", 5), (1, 4, "乙表", 40), (2, 1, "甲表", 3)]
    titles = [(1, "甲表", 3), (1, "乙表", 6), (1, "丙表", 5), (1, "丁表", 9), (3, "甲表", 1)]
    df = K.contents_alignment(spark.createDataFrame(entries, "doc_id long, line int, title string, toc_page int"), spark.createDataFrame(titles, "doc_id long, title string, page_no int"))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.doc_id, r.title, r.problem) for r in df.collect())
    want = [(1, "丁表", "not_in_contents"), (1, "乙表", "wrong_page"), (1, "乙表", "out_of_order"), (2, "甲表", "not_in_body"), (3, "甲表", "not_in_contents")]
    assert got == sorted(want)


def test_sections_are_read_once(spark):
    """All rounds read a section where it stands: no union of rounds, no grouping of their rows; the same pairs."""
    text = "三、一般公共预算财政拨款支出决算情况\n其中：年初预算10万元，决算12万元，决算大于预算。决算9，年初预算为7，决算大于预算。主要原因：增。\n四、其他"
    pages = spark.createDataFrame([(1, 1, text), (2, 1, text.replace("增", "减少")), (3, 1, "四、其他"), (4, 1, None)], "doc_id long, page_no int, text string")
    df = P.accepted_pairs(P.sections(pages))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Aggregate [") <= 1
    rows = P.accepted(P.candidates(P.sections(pages)))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, rows.collect())) and df.count() > 0
    assert [r.sec for r in P.sections(pages).where("doc_id = 1").collect()] == [text[: text.index("四、其他")]]


def test_pages_are_compared_once(spark, sf):
    """No filter on the tables found has every page compared again; first pages come from one grouping."""
    from tallyglass.operators import anchors as A

    pages = spark.createDataFrame([(1, 3, "收入决算表\n单位：万元"), (1, 5, "收入决算表\n单位：万元"), (1, 5, "收入决算表\n单位：万元"), (2, 1, "目录"), (2, 2, None)], "doc_id long, page_no int, text string")
    plan = A.anchors(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted((r.doc_id, r.table_name, r.page_no) for r in A.anchors(pages).where("ord = 1").collect()) == [(1, "收入决算表", 3), (1, "收入决算表", 5)]
    first = A.first_anchors(pages, ["收入决算表"]).collect()
    assert [(r.doc_id, r.table_name, r.ord, r.page_no) for r in first] == [(1, "收入决算表", 1, 3)]


def test_nested_tables_give_what_cells_give(spark):
    from tallyglass.sources.corpus import cells

    a = [["编码", "额"], ["2010101", "5", "12%"], ["201", "x", "7.5"], [" 2080501", "1,000", None], ["合计", "9"], [], None, [None, "3"], ["30401"]]
    b = [["编码"], ["2010102", "1", "2", "3"], ["x", "1", "1", "1"]]
    rows = [(1, 1, [a, b]), (1, 2, [b, None, a]), (2, 1, [b, b]), (2, 2, []), (3, 1, None), (3, 2, [None, []])]
    nested = spark.createDataFrame(rows, "doc_id long, page_no int, tables array<array<array<string>>>")
    assert sorted(map(tuple, T.nested_class_sums(nested).collect())) == sorted(map(tuple, T.class_sums(cells(nested)).collect()))
    largest = cells(nested).join(T.largest_table(cells(nested)).select(*T.TABLE), T.TABLE)
    key = lambda r: (r.doc_id, r.page_no, r.table_ix, r.row_ix, r.col_ix, r.text)
    assert sorted(map(key, cells(T.only_largest(nested)).collect())) == sorted(map(key, largest.collect()))


def test_greedy_matching_is_the_ordered_greedy(spark, sf):
    from tallyglass.sources.corpus import findings

    edges = M.edges(with_ids(spark, sf), 0.7).cache()
    by_doc = defaultdict(list)
    for r in edges.collect():
        by_doc[r.doc_id].append((r.score, r.a_idx, r.b_idx, r.a_finding_id, r.b_finding_id))
    expected = set()
    for doc, items in by_doc.items():
        used = set()
        for score, _, _, a, b in sorted(items, reverse=True):
            if a not in used and b not in used:
                used |= {a, b}
                expected.add((doc, a, b))
    got = {(r.doc_id, r.a_finding_id, r.b_finding_id) for r in M.greedy_matches(edges).collect()}
    assert len(got) == len(expected)
    assert set(got) == set(expected)


def test_conflicts(spark):
    rows = [(1, 1, 2, "a", "b", "high", "low", 1, 1, 5.0, 5.0, 1.0), (2, 1, 2, "a", "b", "high", "medium", 1, 1, 5.0, 5.0, 1.0), (3, 1, 2, "a", "b", "high", "high", 1, 4, 5.0, 5.0, 1.0), (4, 1, 2, "a", "b", "high", "high", 1, 1, 5.0, 6.0, 1.0)]
    schema = "doc_id long, a_idx int, b_idx int, a_finding_id string, b_finding_id string, a_severity string, b_severity string, a_page int, b_page int, a_amount double, b_amount double, score double"
    out = {r.doc_id: r.reason for r in M.conflicts(spark.createDataFrame(rows, schema)).collect()}
    assert out == {1: "severity-mismatch", 2: "agreement", 3: "page-mismatch", 4: "value-mismatch"}


def test_rule_book_isolates_failures(spark):
    f = spark.createDataFrame([(1, "warn")], "doc_id long, severity string")
    book = RuleBook(["doc_id", "rule_id", "severity"])
    book.rule("A")(lambda t: t["f"])
    book.rule("B")(lambda t: t["nothing"])
    book.rule("C")(lambda t: t["f"].select("missing"))
    assert sorted((r.rule_id, r.severity) for r in book.run(spark, {"f": f}).collect()) == [("A", "warn"), ("B", "hint"), ("C", "hint")]


def test_numbering_is_dense(spark, sf):
    from tallyglass.sources.corpus import findings

    n = O.numbered(findings(spark, sf)).groupBy("doc_id").agg(F.max("seq").alias("m"), F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("d"))
    assert n.where("m <> n or d <> n").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text("ab决算 ", max_size=12), st.text("ab决算 ", max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert S.common(a, b) == table[len(a)][len(b)]
    assert 0 <= S.indel(a, b) <= 100
    assert S.sequence(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("a, b, expected", [("决算表", "支出决算表（续）", 100.0), ("", "x", 0.0)])
def test_partial_ratio(a, b, expected):
    assert S.partial(a, b) == expected


def test_words_of_decrease_and_all_numbers(spark):
    got = column(spark, ["下降5%", "负三百二十", "减少3.5万元", "万", "-4%"], lambda v: N.parse_robust(v).cast("double"))
    assert got == [-5, -320, -35000, None, -4]
    rows = column(spark, ["共（12）项，占3.5%，三百万元1,234和-5", "无", None], N.all_numbers)
    assert [(r.start, r.found, r.value) for r in rows[0]] == [(1, "（12）", -12), (8, "3.5%", 3.5), (13, "三百万", 3000000), (17, "1,234", 1234), (23, "-5", -5)]
    assert rows[1:] == [[], []]


def test_parts_of_a_damaged_clip_are_found(spark):
    page = "前文" + "甲乙丙丁戊己庚辛壬癸" * 2 + "后文"
    clip = "¤" * 20 + "甲乙丙丁戊己庚辛壬癸" * 2 + "¤" * 20
    rows = spark.createDataFrame([(page, clip), (page, "¤" * 60)], "p string, c string")
    assert [r[0] for r in rows.select(X.guess_position("p", F.col("c"))).collect()] == [2, 10**9]


def test_layered_merge(spark):
    schema = "doc_id long, idx int, source string, rule_id string, severity string, title string, message string, section string, amount double, confidence int, finding_id string"
    rows = [
        (1, 1, "rule", "R1", "warn", "甲 乙", "规则发现的问题", None, 1.0, 1, "a"),
        (1, 2, "ai", "R1", "warn", "甲 乙", "模型给出的更长的说明", None, 1.0, 2, "b"),
        (1, 3, "ai", "R1", "warn", "甲 乙", "模型说明一二三", None, 1.0, 2, "c"),
        (1, 4, "ai", "R2", "error", "丙", "没有伙伴的发现", None, 1.0, 3, "d"),
        (1, 5, "ai", "R2", "info", "丙", "没有伙伴的发现", None, 1.0, 3, "e"),
        (1, 6, "ai", "R3", "error", "丁", "太短", None, 1.0, 3, "f"),
    ]
    f = spark.createDataFrame(rows, schema)
    got = {r.finding_id: (r.message, r.confidence, r.n_ai) for r in M.layered_merge(f).collect()}
    assert got == {"a": ("模型给出的更长的说明", 2, 2), "d": ("没有伙伴的发现", 3, 0)}
    assert [r.finding_id for r in M.layered_merge(f, most=1).collect()] == ["d"]


def test_a_late_entry_stays_out_of_a_closed_window(spark, tmp_path):
    import time

    from tallyglass.streaming.logs import drained, overview

    schema = "ts timestamp, stage string, duration_ms double"
    at = tmp_path.as_posix()
    batches = [["2024-01-01 10:00:00", "2024-01-05 10:00:00"], ["2024-01-06 10:00:00"], ["2024-01-01 11:00:00", "2024-01-09 10:00:00"]]  # entries are late by the watermark of the batch before
    for i, times in enumerate(batches):
        rows = spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("ts"), F.lit("parse").alias("stage"), F.lit(1.0).alias("duration_ms"))
        rows.coalesce(1).write.parquet(f"{at}/in/{i}")
        time.sleep(1.1)  # files are read in the order of their times
    logs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")
    got = sorted((str(r.start)[:10], r.n) for r in drained(overview(logs), "append").collect())
    assert got == [("2024-01-01", 1), ("2024-01-05", 1), ("2024-01-06", 1)]


def test_best_and_first_tables(spark):
    from tallyglass.plans.joins import best_tables, first_table

    names = spark.createDataFrame([("部门收入决算表",), ("附支出决算表",), ("三公及经费的各项支出",), ("无关",)], "title string")
    got = {r.title: (r.table_name, r.score) for r in best_tables(names).collect()}
    assert got["部门收入决算表"] == ("收入决算表", 100.0) and got["附支出决算表"][0] == "支出决算表" and got["三公及经费的各项支出"][1] == 80.0
    assert "无关" not in got
    assert [r[0] for r in names.select(first_table("title")).collect()] == ["收入决算表", "支出决算表", "一般公共预算财政拨款“三公”经费支出决算表", None]


def test_near_mentions_against_brute_force():
    """Windows around blocks find what all windows find, for every threshold."""
    import random

    draw = random.Random(5)
    for _ in range(3000):
        letters = "abcdef"[: draw.randint(2, 6)]
        text = "".join(draw.choice(letters) for _ in range(draw.randint(1, 40)))
        alias = "".join(draw.choice(letters) for _ in range(draw.randint(1, 14)))
        least = draw.choice([70.0, 80.0, 85.0, 92.0, 95.0])
        best = S.partial(alias, text)
        assert S.mention(text, alias, least) == (best if best >= least else 0.0)


def test_containment_joins_against_nested_loops(spark):
    """Every alias length class, shared beginnings, repeated and empty strings, null ids."""
    import random

    from tallyglass.operators import containment as J

    draw = random.Random(9)
    text = lambda n: "".join(draw.choice("ab 部门决算") for _ in range(n))
    docs = [(i, text(draw.choice([0, 1, 5, 20, 60, 200]))) for i in range(120)] + [(None, "部门决算表"), (7, None)]
    names = [(i, t[a : a + n]) for i, n in enumerate([1, 2, 3, 5, 6, 8, 11, 12, 20, 24, 30, 70] * 8) for t in [draw.choice(docs)[1] or ""] for a in [draw.randint(0, max(0, len(t) - n))]]
    names += [(900 + i, "部门决算" + text(20)) for i in range(20)] + [(990, ""), (991, None)]
    d, a = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(names, "item_id long, alias string")
    every = [(i, t, j, n) for i, t in docs for j, n in names if t and n]
    assert {tuple(r) for r in J.contained(d, a).collect()} == {(i, j) for i, t, j, n in every if n in t}
    assert {tuple(r) for r in J.contained_either(d, a).collect()} == {(i, j) for i, t, j, n in every if n in t or t in n}
    for least in (80.0, 92.0):
        best = {}
        for i, t, j, n in every:
            if len(t) >= len(n) and (s := S.partial(n, t)) >= least:
                best[i, j] = max(s, best.get((i, j), 0))
        assert {(r.doc_id, r.item_id): r.score for r in J.near_mentions(d, a.withColumn("least", F.lit(least))).collect()} == best


def test_near_pairs_lose_nothing_and_bring_little(spark):
    """Names with letters left out, put in or exchanged, at a text's ends too; names of two words that only share pairs of
    letters don't meet."""
    import random

    from tallyglass.operators import containment as J

    draw = random.Random(21)
    word = lambda n: "".join(chr(0x4E00 + draw.randrange(256)) for _ in range(n))
    names = [(i, f"{word(8)} {word(8)}") for i in range(300)]

    def worn(x):
        x = list(x)
        for _ in range(draw.randint(0, 7)):
            at = draw.randrange(len(x))
            x[at : at + 1] = draw.choice([[], [x[at], "?"], ["!"]])
        return "".join(x)

    docs = [(i, draw.choice(["", word(3)]) + worn(names[i][1]) + draw.choice(["", "一批；" + worn(names[-i][1])])) for i in range(300)]
    d, a = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(names, "item_id long, alias string")
    for least in (80.0, 85.0):
        best = {(i, j): s for i, t in docs for j, n in names if len(set(t) & set(n)) > 8 and len(t) >= len(n) and (s := S.partial(n, t)) >= least}
        a_least = a.withColumn("least", F.lit(least))
        assert {(r.doc_id, r.item_id): r.score for r in J.near_mentions(d, a_least).collect()} == best
        assert len(best) <= J.near_pairs(d, a_least).count() < 1200  # 90,000 pairs


def test_values_are_read_where_they_stand(spark):
    """Labelled values of nested tables are those of their cells: first row with a label, its last plain number."""
    from tallyglass.operators import tables as T
    from tallyglass.sources.corpus import cells

    wanted = {"total": ["合计", "总计"], "basic": ["基本支出"], "none": ["没有"]}
    first = [["项目", "决算数"], None, [], [" 本年合计 ", "1,000.50", "12%", " 7 ", "说明", None], ["合计", "9"], ["基本支出", "-", None], ["基本支出", "5"]]
    second = [["总计"], ["总计", "3"], ["基本支出合计", "4%", "-2.5"]]
    rows = [(1, 1, [first, second]), (1, 2, [[["其他", "8"]], None, second]), (2, 1, None), (3, 1, [])]
    nested = spark.createDataFrame(rows, "doc_id long, page_no int, tables array<array<array<string>>>")
    order = ["doc_id", "page_no", "table_ix"]
    read = lambda df: [tuple(r) for r in df.where("coalesce(total, basic) is not null").select(*order, *wanted).orderBy(*order).collect()]
    got = T.nested_row_values(nested, wanted)
    assert read(got) == read(T.row_values(cells(nested), wanted)) and got.count() == 3
    assert [str(r.total) for r in got.orderBy(*order).collect()] == ["7.0000", "None", "None"]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_title_with_a_wrong_letter_is_an_anchor(spark):
    from tallyglass.operators import anchors as A

    wrong = "政府性基金预算财政拔款收入支出决算表\n单位：万元"
    pages = spark.createDataFrame([(1, 4, wrong), (2, 4, wrong.replace("收入", "")), (3, 1, "收人决算表\n单位：万元"), (4, 2, "目录\n" + wrong)], "doc_id long, page_no int, text string")
    assert {(r.doc_id, r.ord) for r in A.anchors(pages).collect()} == {(1, 7), (1, 2), (2, 2)}


def test_matching_takes_what_one_pass_takes(spark):
    """Rounds of locally best edges equal the greedy pass, on long chains and on many ties."""
    import random

    draw = random.Random(3)
    rows = [(1, i, i, f"a{i}", f"b{i}", float(2 * i)) for i in range(12)] + [(1, i + 1, i, f"a{i + 1}", f"b{i}", float(2 * i + 1)) for i in range(12)]
    for doc in range(2, 30):
        rows += [(doc, a, b, f"a{a}", f"b{b}", draw.choice([0.85, 0.9, 1.0])) for a in range(6) for b in range(6) if draw.random() < 0.6]
    e = spark.createDataFrame(rows, "doc_id long, a_idx int, b_idx int, a_finding_id string, b_finding_id string, score double")
    e = e.withColumns({c: F.lit(None).cast("string") for c in ("a_severity", "b_severity")} | {c: F.lit(None).cast("double") for c in ("a_page", "b_page", "a_amount", "b_amount")})
    want, used = set(), set()
    for doc, a, b, x, y, score in sorted(rows, key=lambda r: (r[0], -r[5], -r[1], -r[2])):
        if (doc, x) not in used and (doc, y) not in used:
            used |= {(doc, x), (doc, y)}
            want.add((doc, a, b, score))
    assert {(r.doc_id, r.a_idx, r.b_idx, r.score) for r in M.greedy_matches(e).collect()} == want


NINE = ["收入支出决算总表", "收入决算表", "支出决算表", "财政拨款收入支出决算总表", "一般公共预算财政拨款支出决算表", "一般公共预算财政拨款基本支出决算表", "一般公共预算财政拨款“三公”经费支出决算表", "政府性基金预算财政拨款收入支出决算表", "国有资本经营预算财政拨款收入支出决算表"]
#: Figures of a book in order; every sample changes some.
FIGURES = {"total": 110, "year": 100, "alloc": 4, "carry": 6, "grant": 80, "basic": 70, "project": 30, "said_total": 110, "fund": "0", "said_fund": "本表无数据。"}


def sample_book(doc, absent=(), **changed):
    f = FIGURES | changed
    rows = [
        [["支出合计", f["total"]], ["本年支出合计", f["year"]], ["结余分配", f["alloc"]], ["年末结转和结余", f["carry"]]], [["本年收入合计", f["year"]], ["财政拨款收入", f["grant"]]],
        [["本年支出合计", f["year"]], ["基本支出", f["basic"]], ["项目支出", f["project"]]], [["支出合计", f["said_total"]]], [["2010101", f["basic"]], ["2080501", f["project"]], ["合计", f["year"]]],
        [["人员经费合计", 50], ["公用经费合计", 20]], [["合计预算数", 9], ["合计决算数", 8]], [["合计", f["fund"]]], [["合计", "0"]],
    ]
    text = f"总体情况说明：支出总计{f['said_total']}万元。\n收入决算情况说明：本年收入合计{f['year']}万元，财政拨款收入{f['grant']}万元。{f['said_fund']}"
    pages = [(doc, 1, "2024年度部门决算"), (doc, 2, text)] + [(doc, 3 + i, f"{n}\n单位：万元") for i, n in enumerate(NINE) if n not in absent] + [(doc, 20 + i, "附件") for i in range(3)]
    tables = [(doc, 3 + i, [[["项目", "决算数"]] + [[a, str(b)] for a, b in r]]) for i, (n, r) in enumerate(zip(NINE, rows)) if n not in absent]
    return pages, tables


def test_manifest_of_samples(spark):
    """Good samples stay silent, each bad one triggers its rule as often as the manifest asks."""
    from tallyglass.operators.audit import audit

    manifest = [  # sample, rules that must be silent, least hits of rules that must speak
        (1, sample_book(1), ["V33-001", "V33-002", "V33-101", "V33-102", "V33-103", "V33-109"], {}),
        (2, sample_book(2, year=90, basic=60, total=100, said_total=100), ["V33-002", "V33-101", "V33-102"], {}),
        (3, sample_book(3, total=150, said_total=150), ["V33-002", "V33-102"], {"V33-101": 1}),
        (4, sample_book(4, said_total=130), ["V33-002", "V33-101"], {"V33-102": 1}),
        (5, sample_book(5, absent=NINE[1:3]), ["V33-101"], {"V33-002": 2}),
        (6, sample_book(6, said_fund=""), ["V33-002"], {"V33-109": 1}),
    ]
    pages = spark.createDataFrame([p for _, (p, _), _, _ in manifest for p in p], "doc_id long, page_no int, text string")
    tables = spark.createDataFrame([t for _, (_, t), _, _ in manifest for t in t], "doc_id long, page_no int, tables array<array<array<string>>>")
    found = defaultdict(list)
    for r in audit(pages, tables).collect():
        found[r.doc_id, r.rule_id].append(r.message)
    assert not [k for k in found if k[0] is None]  # every rule could be planned
    for doc, _, silent, speaks in manifest:
        assert {r: found[doc, r] for r in silent if found[doc, r]} == {}
        for rule, least in speaks.items():
            assert len(found[doc, rule]) >= least, (doc, rule)
    assert {m for m in found[5, "V33-002"] if m.startswith("缺失表")} == {"缺失表：收入决算表"}


def test_next_heads_cross_ranges(spark, monkeypatch):
    from tallyglass.operators import anchors as A

    monkeypatch.setattr(A, "RANGE_ROWS", 7)
    rows = [(i * 10, f"t{i}\na\nb\nc\nd", None if i % 3 == 0 else f"s{i % 2}") for i in range(60)]
    got = {r.doc_id: r.searched for r in A.with_next_head(spark.createDataFrame(rows, "doc_id long, text string, source string"), "source", "doc_id").collect()}
    for d, t, s in rows:
        later = [x for e, x, z in rows if z == s and e > d]
        assert got[d] == t + ("\n" + "\n".join(later[0].split("\n")[:3]) if later else "")


def test_longest_rise_is_longest_and_rising(spark):
    import random

    from tallyglass.operators.checks import longest_rise

    draw = random.Random(8)
    rows = [(i, draw.sample(range(40), draw.randint(1, 9))) for i in range(60)]
    for r in spark.createDataFrame(rows, "i int, v array<int>").select("v", longest_rise(F.col("v")).alias("kept")).collect():
        best = [1] * len(r.v)
        for j in range(len(r.v)):
            best[j] = 1 + max([best[i] for i in range(j) if r.v[i] < r.v[j]], default=0)
        taken = [r.v[i] for i in r.kept]
        assert taken == sorted(taken) and len(taken) == max(best) and r.kept == sorted(set(r.kept))


def test_seed_map_lets_few_others_through(spark, monkeypatch):
    """Eleven bits of the map for every seed, as where it can't grow: all seeds pass and less than a hundredth of others."""
    from tallyglass.operators import containment as J

    monkeypatch.setattr(J, "BITS", (1 << 16, 1 << 16))
    name = lambda i: "".join(chr(0x4E00 + int(c)) for c in np.random.default_rng(i).integers(0, 3000, 10))
    dim = spark.createDataFrame([(i, name(i), 80.0) for i in range(200)], "item_id long, alias string, least double")
    docs = lambda of: spark.createDataFrame([(i, name(i)) for i in of], "doc_id long, text string")
    own = J._part_seeds(dim).cache()
    bitmap = J._bitmap(own, n := own.count())
    assert len(bitmap) * 8 == 1 << 16 and n > 4000
    wanted = sorted({(k, t) for _, k, e in J.parts_of(10, 80.0) for t in range(e + 1)})
    assert J._window_seeds(docs(range(200)), wanted, bitmap).select("doc_id").distinct().count() == 200
    every = np.full(len(bitmap), 255, np.uint8)
    others = docs(range(1000, 1400))
    assert J._window_seeds(others, wanted, bitmap).count() < J._window_seeds(others, wanted, every).count() / 100


def test_codes_of_three_levels(spark):
    from tallyglass.operators.checks import undescribed_codes

    codes = spark.createDataFrame([(1, c) for c in ("201", "20101", "2010101", "2010102", "20102", "2010201", "208", "20805")], "doc_id long, code string")
    said = spark.createDataFrame([(1, "2010101"), (1, "2010102"), (1, "20102"), (1, "999")], "doc_id long, code string")
    assert {r.code for r in undescribed_codes(codes, said).collect()} == {"2010201", "208", "20805"}


def test_codes_of_three_levels_in_rows(spark):
    """Codes and mentions of one row, with null tables, rows and cells; and one exchange in the whole query."""
    from tallyglass.operators.checks import undescribed_in_rows
    from tallyglass.operators.tables import first_cells
    from tallyglass.plans import load
    from tallyglass.registry import QUERIES

    load()
    codes = ("201", "20101", "2010101", " 2010102", "20102", "2010201", "208", "20805", "208", "x", "2010")
    rows = [
        (1, [None, [["科目编码"], None, [None, "305"], []] + [[c, "名称"] for c in codes]], ["2010101", "2010102", "20102", "999"]),
        (2, [[["305"], ["30501"], ["3050101"]]], ["3050101"]),
        (3, [[["305"], ["30501"]]], []),
        (4, None, ["305"]),
    ]
    books = spark.createDataFrame(rows, "doc_id long, tables array<array<array<string>>>, mentions array<string>")
    got = undescribed_in_rows(books.select("doc_id", first_cells("tables", "^(?:\\d{3}|\\d{5}|\\d{7})$").alias("codes"), "mentions"))
    assert sorted((r.doc_id, r.code) for r in got.collect()) == [(1, "2010201"), (1, "208"), (1, "20805"), (3, "305"), (3, "30501")]
    plan = QUERIES["t06_class_details"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_arriving_pages_withdraw_what_they_mend(spark, tmp_path):
    from tallyglass.streaming.arrivals import held, row_findings, run

    name, cell = "收入决算表\n单位：万元", [[["项目", "金额"], ["合计", "-1"]]]
    schema = "doc_id long, page_no int, text string, tables array<array<array<string>>>"
    at = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, "2024年度", cell), (2, 1, name, None)], schema).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(schema).parquet(f"{at}/in")
    run(stream, at)
    before = {(r.doc_id, r.message, r.state) for r in held(spark, at).collect()}
    assert (1, "缺失表：收入决算表", "open") in before and (2, "缺失表：收入决算表", "open") not in before
    spark.createDataFrame([(1, 2, name, None)], schema).write.mode("append").parquet(f"{at}/in")
    run(stream, at)
    after = {(r.doc_id, r.message, r.state) for r in held(spark, at).collect()}
    assert after == before - {(1, "缺失表：收入决算表", "open")} | {(1, "缺失表：收入决算表", "withdrawn")}
    assert [(r.doc_id, r.message) for r in row_findings(spark, at).collect()] == [(1, "负数")]


def test_class_shares_deal_each_document_once(spark, sf):
    from tallyglass.operators import checks
    from tallyglass.plans.checks import t05

    a = [["编码", "额"], ["2010101", "5", "12%"], ["201", "x", "7.5"], [" 2080501", "1,000", None], ["合计", "9"], [], None, [None, "3"], ["30401"]]
    rows = [(1, 1, "201类占比50%，208类占比98.8%", [a, None]), (1, 2, None, [a, []]), (2, 1, "201类占比9%，201类占比100%", [a]), (3, 1, "201类占比1%", None)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string, tables array<array<array<string>>>")
    flat = pages.select("doc_id", "page_no", F.explode(T.class_rows("tables")).alias("x")).groupBy("doc_id", "page_no", "x.code").agg(F.sum("x.value").alias("value"))
    sums = T.nested_class_sums(pages).groupBy("doc_id", "page_no", "code").agg(F.sum("value").alias("value"))
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, sums.collect()))
    found = checks.class_shares(pages.select("doc_id", T.class_rows("tables").alias("rows"), "text")).collect()
    assert sorted(map(tuple, found)) == [(1, "201"), (2, "201"), (2, "201")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = t05(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2  # lines and orders, each once
