"""Number parsing and tolerances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import UNITS
from .text import spans, text

WHOLE = "(?:\\d+|\\d{1,3}(?:,\\d{3})+)"
CELL = f"(?U)^-?\\s*{WHOLE}(?:[.]\\d+)?(?:\\s*%)?$"


def parse_cell(c) -> Column:
    """strict parse; dashes and blanks are null, percent signs and thousands commas are dropped."""
    s = F.trim(text(c))
    plain = F.regexp_replace(s, "(?U)[,%\\s]", "")
    return F.when(s.rlike(CELL), plain.cast("decimal(28,4)"))


def is_percent(c) -> Column:
    return text(c).contains("%")


def is_negative(c) -> Column:
    return F.trim(text(c)).startswith("-")


# Chinese digits and place values, common and formal.
DIGITS = {"零": 0, "〇": 0, "○": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
DIGITS |= {"壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9}
PLACES = {"十": 10, "百": 100, "千": 1000, "拾": 10, "佰": 100, "仟": 1000}
#: Section words, greatest first, each with its other form.
SECTIONS = [("兆", "兆", 10**12), ("亿", "億", 10**8), ("万", "萬", 10**4)]
NUMERALS = "[" + "".join([*DIGITS, *PLACES, *dict.fromkeys(c for a, b, _ in SECTIONS for c in (a, b))]) + "]+"
NUMERAL = f"^{NUMERALS}$"
# Words that make an amount negative, and units that alone are no number.
NEGATIVE = "负|减少|下降"
LONE_UNITS = ["千", "万", "亿", "仟", "萬", "億", "兆"]


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def numeral(c) -> Column:
    """Chinese numeral to integer: a digit waits for its place, places add up to a section, a section word
    multiplies all that is smaller than it (三千万亿 is 3000 * 10**12). Beyond 64 bits: null."""
    chars = F.filter(F.split(F.translate(c, "".join(b for _, b, _ in SECTIONS), "".join(a for a, _, _ in SECTIONS)), ""), lambda x: x != "")
    digits, places, sections = _map(DIGITS), _map(PLACES), _map({a: n for a, _, n in SECTIONS})
    zero = F.lit(0).cast("long")
    state = lambda total, part, digit: F.struct(total.cast("long").alias("total"), part.cast("long").alias("part"), digit.cast("long").alias("digit"))

    def step(acc, x):
        lone = F.when(acc["digit"] == 0, 1).otherwise(acc["digit"])
        size = sections[x]
        smaller = acc["total"] % (size * 10_000)
        given = smaller + acc["part"] + acc["digit"]
        scaled = F.try_multiply(F.when(given == 0, F.lit(1).cast("long")).otherwise(given), size)
        return (
            F.when(places[x].isNotNull(), state(acc["total"], acc["part"] + lone * places[x], zero))
            .when(size.isNotNull(), state(F.try_add(acc["total"] - smaller, scaled), zero, zero))
            .otherwise(state(acc["total"], acc["part"], F.coalesce(digits[x], zero)))
        )

    value = F.aggregate(chars, state(zero, zero, zero), step, lambda acc: acc["total"] + acc["part"] + acc["digit"])
    return F.when(c.rlike(NUMERAL), value)


def parse_robust(c) -> Column:
    """F8: bracketed negatives, percent, multipliers, numerals, cleaned fallback; first tier that fits.
    Look-alike letters are mended inside numeric tokens only. A word of decrease makes a positive value negative."""
    joined = F.regexp_replace(F.trim(text(c)), "(?U)\\s*\n\\s*", "")

    def mended(s):
        numeric = s.rlike("(?U)^[-(（]?[\\dOoIlSB,.]+") & s.rlike("\\d")
        return F.regexp_replace(F.when(numeric, F.translate(s, "OoIlSB", "001158")).otherwise(s), "(?U)[,\\s]", "")

    def signed(whole):
        inner = F.regexp_extract(whole, "^[(（](\\d+(?:\\.\\d+)?)[)）]$", 1)
        bracket = F.when(inner != "", -inner.cast("decimal(28,4)"))
        less = F.when(whole.rlike(NEGATIVE), F.lit(-1)).otherwise(F.lit(1))
        value = let(F.regexp_replace(whole, NEGATIVE, ""), unsigned)
        return F.coalesce(bracket, let(value, lambda v: F.when(v > 0, (v * less).cast("decimal(28,4)")).otherwise(v)))

    return let(let(joined, mended), signed)


def unsigned(bare) -> Column:
    """The tiers of parse_robust after brackets, on a text without commas and blanks."""
    rate = F.regexp_extract(bare, "^([+-]?\\d+(?:\\.\\d+)?)[%％]$", 1)
    percent = F.when(rate != "", rate.cast("decimal(28,4)"))
    factor = F.regexp_extract(bare, "^-?\\d+(?:\\.\\d+)?(千万|百万|千|万|亿)元?$", 1)
    amount = F.regexp_extract(bare, "^(-?\\d+(?:\\.\\d+)?)", 1)
    scale = _map({"千": 1000, "万": 10_000, "百万": 1_000_000, "千万": 10_000_000, "亿": 100_000_000})[factor]
    scaled = F.when(factor != "", (amount.cast("decimal(20,4)") * scale).cast("decimal(28,4)"))
    plain = F.when(bare.rlike("^-?\\d+(\\.\\d+)?$"), bare.cast("decimal(28,4)"))
    cleaned = F.regexp_extract(bare, "(-?\\d+(?:\\.\\d+)?)", 1)
    fallback = F.when(cleaned != "", cleaned.cast("decimal(28,4)"))
    run = F.regexp_extract(bare, NUMERALS, 0)
    spoken = F.when(~bare.rlike("\\d") & (run != "") & ~run.isin(LONE_UNITS), numeral(run).cast("decimal(28,4)"))
    return F.coalesce(plain, percent, scaled, spoken, fallback)


DIGITAL = "\\d+(?:,\\d{3})*(?:\\.\\d+)?"
#: Written forms of a number; of two that begin together the earlier form wins.
FORMS = [f"[(（]{DIGITAL}[)）]", f"{DIGITAL}[%％]", NUMERALS, f"[+-]?{DIGITAL}"]


def all_numbers(c) -> Column:
    """array of (start, form, found, value): every number of a text by position, overlapping ones left out."""

    def parsed(form: int):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(form).alias("form"), m["found"].alias("found"), parse_robust(m["found"]).cast("double").alias("value"))

    met = F.concat(*[F.transform(spans(c, p), parsed(i)) for i, p in enumerate(FORMS)])
    known = F.array_sort(F.filter(met, lambda m: m["value"].isNotNull()))
    start = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<struct<start:int,form:int,found:string,value:double>>)").alias("out"))

    def keep(acc, m):
        free = m["start"] >= acc["end"]
        end = F.when(free, m["start"] + F.length(m["found"])).otherwise(acc["end"])
        return F.struct(end.alias("end"), F.when(free, F.concat(acc["out"], F.array(m))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(known, start, keep, lambda acc: acc["out"])


def amount_in_yuan(c) -> Column:
    """amount times its unit, longest unit first."""
    units = sorted(UNITS, key=lambda u: -len(u[0]))
    pattern = "(-?\\d+(?:,\\d{3})*(?:\\.\\d+)?)\\s*(" + "|".join(u for u, _ in units) + ")"
    value = F.regexp_replace(F.regexp_extract(text(c), "(?U)" + pattern, 1), ",", "")
    scale = _map({u: n for u, n in units})[F.regexp_extract(text(c), "(?U)" + pattern, 2)]
    return F.when(value != "", (value.cast("decimal(20,4)") * scale).cast("decimal(28,4)"))


def ordinal(n: Column) -> Column:
    """Chinese ordinal up to 99, digits beyond."""
    names = F.array(*[F.lit(x) for x in "零一二三四五六七八九十"])
    one, ten = (n % 10).cast("int"), F.floor(n / 10).cast("int")
    tail = F.when(one > 0, F.element_at(names, one + 1)).otherwise("")
    return (
        F.when(n <= 10, F.element_at(names, n.cast("int") + 1))
        .when(n < 20, F.concat(F.lit("十"), tail))
        .when(n < 100, F.concat(F.element_at(names, ten + 1), F.lit("十"), tail))
        .otherwise(n.cast("string"))
    )


def close(a: Column, b: Column, absolute: float = 1.0, relative: float = 0.001) -> Column:
    """Within the larger of an absolute and a relative tolerance."""
    a, b = a.cast("double"), b.cast("double")
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.abs(a) * relative, F.abs(b) * relative)


def dynamic_tolerance(a: Column, b: Column) -> Column:
    """1 below 100, half a percent below ten thousand, else 0.3 percent."""
    top = F.greatest(F.abs(a.cast("double")), F.abs(b.cast("double")))
    return F.when(top < 100, F.lit(1.0)).when(top < 10_000, F.greatest(F.lit(1.0), top * 0.005)).otherwise(F.greatest(F.lit(1.0), top * 0.003))


def close_either(a: Column, b: Column, absolute: float = 0.01, relative: float = 0.005) -> Column:
    """Absolute or relative."""
    a, b = a.cast("double"), b.cast("double")
    return (F.abs(a - b) <= absolute) | (F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * relative)
