"""Dimensions: small fixed tables that every job broadcasts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# The nine standard tables in their expected order, with aliases.
NINE_TABLES = [
    ("收入支出决算总表", ["部门收支决算总表", "收入支出决算总表", "收支决算总表"]),
    ("收入决算表", ["部门收入决算表", "收入决算表"]),
    ("支出决算表", ["部门支出决算表", "支出决算表"]),
    ("财政拨款收入支出决算总表", ["财政拨款收支决算总表", "财政拨款收入支出决算总表"]),
    ("一般公共预算财政拨款支出决算表", ["一般公共预算财政拨款支出决算表", "一般公共预算支出决算表"]),
    ("一般公共预算财政拨款基本支出决算表", ["一般公共预算财政拨款基本支出决算表", "基本支出决算表"]),
    ("一般公共预算财政拨款“三公”经费支出决算表", ["财政拨款“三公”经费支出决算表", "三公经费支出决算表", "“三公”经费支出决算表"]),
    ("政府性基金预算财政拨款收入支出决算表", ["政府性基金预算财政拨款收入支出决算表", "政府性基金决算表"]),
    ("国有资本经营预算财政拨款收入支出决算表", ["国有资本经营预算财政拨款收入支出决算表", "国有资本经营预算财政拨款支出决算表", "国有资本经营支出决算表"]),
]

# Category and keywords of each standard table, in the same order.
TABLE_KEYWORDS = [
    ("comprehensive", ["收入", "支出", "决算", "总表"]),
    ("income", ["收入", "决算"]),
    ("expenditure", ["支出", "决算"]),
    ("fiscal_allocation", ["财政", "拨款", "收入", "支出", "决算"]),
    ("general_budget", ["一般", "公共", "预算", "财政", "拨款", "支出"]),
    ("basic_expenditure", ["一般", "公共", "预算", "基本", "支出"]),
    ("three_public", ["三公", "经费", "支出"]),
    ("government_fund", ["政府", "基金", "预算", "收入", "支出"]),
    ("state_capital", ["国有", "资本", "经营", "预算", "支出"]),
]

# Severity names of the four schemes and their ranks (higher is graver).
SEVERITIES = [
    ("engine", "error", "error", 3), ("engine", "fatal", "error", 3), ("engine", "critical", "error", 3),
    ("engine", "warn", "warn", 2), ("engine", "warning", "warn", 2), ("engine", "info", "info", 1), ("engine", "hint", "info", 1),
    ("five", "error", "high", 4), ("five", "warn", "medium", 3), ("five", "info", "low", 2), ("five", "hint", "info", 1), ("five", "critical", "critical", 5),
]

# Wording replacements, applied in this order.
WORDING = [
    ("预算单位", "决算单位"), ("预算编制", "决算编制"), ("预算公开", "决算公开"), ("预算报表", "决算报表"), ("预算说明", "决算说明"),
    ("预算执行", "决算执行"), ("预算收入", "决算收入"), ("预算支出", "决算支出"), ("预算总额", "决算总额"), ("预算金额", "决算金额"),
    ("预算数据", "决算数据"), ("预算表", "决算表"), ("部门预算", "部门决算"),
]

# How many yuan a unit is.
UNITS = [("元", 1), ("千元", 1_000), ("万元", 10_000), ("万", 10_000), ("百万元", 1_000_000), ("千万元", 10_000_000), ("亿元", 100_000_000), ("亿", 100_000_000)]

# Fixed value: what messages of parse noise say.
NOISE = "表出现多次|页码异常|格式错误|解析失败"


class Template(NamedTuple):
    key: str
    name: str
    aliases: list[str]
    anchors: list[str]


_TABLES = [name for name, _ in NINE_TABLES]
# The two templates with names and aliases; the others are variants of ours that share anchors with them.
TEMPLATES = [
    Template("dept_decision_template_v1", "附件2：部门决算模板", ["部门决算模板", "附件2", "部门模板", "部门决算", "部门决算公开"], _TABLES),
    Template("unit_decision_template_district_v1", "附件2-2：单位决算公开模板（区级）", ["单位决算公开模板", "附件2-2", "单位模板", "单位决算", "单位决算公开"], _TABLES[:6]),
    Template("dept_short", "部门决算简表", ["部门简表"], _TABLES[:3]),
    Template("unit_short", "单位决算简表", ["单位简表"], _TABLES[3:5]),
    Template("fund", "政府性基金专表", ["基金专表"], _TABLES[7:8]),
    Template("state_capital", "国有资本经营专表", ["国资专表"], _TABLES[8:]),
]

# What a department's and a unit's book must hold, each table by name or alias, each section by title.
SECTION_TITLES = ["收入支出决算总体情况说明", "收入决算情况说明", "支出决算情况说明", "财政拨款收入支出决算总体情况说明", "其他重要事项的情况说明"]
REQUIRED = [(dept, "table", list(dict.fromkeys([name, *aliases]))) for dept in (True, False) for name, aliases in (NINE_TABLES if dept else NINE_TABLES[:6])]
REQUIRED += [(dept, "title", [title]) for dept in (True, False) for title in (SECTION_TITLES if dept else SECTION_TITLES[:3])]


def table_dim(spark: SparkSession) -> DataFrame:
    """One row per standard table and alias."""
    rows = [(name, i, alias) for i, (name, aliases) in enumerate(NINE_TABLES) for alias in dict.fromkeys([name, *aliases])]
    return spark.createDataFrame(rows, "table_name string, ord int, alias string")


def severity_dim(spark: SparkSession, scheme: str) -> DataFrame:
    rows = [(raw, norm, rank) for s, raw, norm, rank in SEVERITIES if s == scheme]
    return spark.createDataFrame(rows, "raw string, norm string, rank int")


def rule_dim(spark: SparkSession) -> DataFrame:
    """Rule catalogue: code, section, severity, priority, money tolerance."""
    codes = [*range(1, 6), *range(101, 111)]
    rows = [(f"V33-{c:03d}", "表内" if c < 100 else "文数", "error" if c in (2, 4, 5, 101, 110) else "warn", 10 if c in (2, 4, 5, 101, 110) else 50, 0.001) for c in codes]
    return spark.createDataFrame(rows, "rule_id string, section string, severity string, priority int, money_rel double")
