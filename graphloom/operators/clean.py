"""Page cleaning and classification (native text and OCR text), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE, let, normalize, squeeze_blanks, trim_ws, unify_newlines

# Patterns that decide what counts as noise, title or contents line.
DOT_RUN, DASH_RUN = r"[\.．·•…。]{4,}", r"[_—\-]{4,}"
PAGE_NUMBER_LINES = [r"^\s*[-—]?\s*\d+\s*[-—]?\s*$", r"^\s*第\s*\d+\s*页\s*$"]
CHAPTER = r"^(\d+(\.\d+)*|第[一二三四五六七八九十百]+[章节部分篇])"
NOISE = [
    r"学\s*兔\s*兔", r"www\s*\.\s*bzfxw\s*\.\s*com", r"bzfxw\s*\.\s*com", r"w\s*w\s*w\s*\.\s*b\s*z\s*f\s*x\s*w\s*\.\s*c\s*o\s*m", r"标\s*准\s*下\s*载", r"免\s*费\s*下\s*载",
    r"仅\s*供.*?使\s*用", r"内\s*部\s*资\s*料", r"扫\s*描\s*全\s*能\s*王", r"仅\s*供\s*学\s*习\s*交\s*流", r"更\s*多\s*免\s*费\s*资\s*料\s*下\s*载",
]
#: What every match of NOISE holds, and a class of characters one of which every change of spaces and signs in OCR text needs. A class takes time by its parts, so these have two.
NOISE_HINT, SIGN_HINT = r"(?U)[zZ\x{4e00}-\x{9fff}](?:(?<=[学标免仅内扫更])|(?<=[zZ])\s*+[fF])", r"[|¦–-\x{ffff}]"
PURE_NOISE_LINES = [r"^\s*$", r"^[\-_=~·•.。,:：;；、\s]+$", r"^\d+\s*$", r"^第\s*\d+\s*页\s*$", r"^Page\s*\d+\s*$", r"^www\..*$", r"^bzfxw.*$"]
TITLE_LINES = [
    r"^\d+(\.\d+)*\s*[^\d].*$", r"^附录\s*[A-ZＡ-Ｚ一二三四五六七八九十].*$", r"^表\s*[A-Za-z0-9一二三四五六七八九十\.\-].*$", r"^图\s*[A-Za-z0-9一二三四五六七八九十\.\-].*$",
    r"^前言\s*$", r"^目次\s*$", r"^目录\s*$", r"^范围\s*$", r"^规范性引用文件\s*$", r"^术语和定义\s*$", r"^技术要求\s*$", r"^试验方法\s*$", r"^检验规则\s*$", r"^运行与维护\s*$", r"^总则\s*$", r"^引用标准\s*$",
]
TOC_LINES = [r"^.*\.{2,}\s*\d+\s*$", r"^.*…{2,}\s*\d+\s*$"]
LOW_VALUE = ["责任编辑", "印刷", "定价", "统一书号", "版权所有", "侵权必究"]
ABNORMAL = r"[\\|~`�□○¤§¦¬¢£¥]"
SOLID, DIGIT = r"(?U)[^\s]", r"(?U)[\d]"
NOISE_RUNS = [DOT_RUN, DASH_RUN, r"[/\\]{3,}", r"[|]{3,}"]


def _ranges(chars: str) -> str:
    """A class of these characters, written as ranges: what is tested for each character of a text should be short."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in out) + "]"


#: White space other than line ends.
BLANK = _ranges(WHITE.replace("\n", ""))


def trimmed_lines(x: Column) -> Column:
    """x without white space at either end of its lines, but for the first one's beginning and the last one's end."""
    return F.regexp_replace(F.regexp_replace(x, rf"\n{BLANK}++", "\n"), rf"{BLANK}++\n", "\n")


def counted(x: Column, one: str) -> Column:
    """How many characters of x are of the class `one`."""
    return F.length(x) - F.length(F.regexp_replace(x, f"{one}+", ""))


def lines_of(x: Column, keep_blank: bool = False) -> Column:
    lines = F.transform(F.split(x, "\n", -1), trim_ws)
    return lines if keep_blank else F.filter(lines, lambda s: s != "")


def _any(line: Column, patterns: list[str], flags: str = "(?Ud)") -> Column:
    """Whether one of the patterns, each of which begins with ^, fits line: the one ^ before them all keeps them from being tried at each character."""
    return line.rlike(flags + "^(?:" + "|".join(f"(?:{p.removeprefix('^')})" for p in patterns) + ")")


def clean_page(x: Column) -> Column:
    """Native text: leaders, rules and page-number lines go; blanks, lines and empty lines are tidied."""
    x = F.replace(unify_newlines(F.coalesce(x, F.lit(""))), F.lit("　"), F.lit(" "))
    x = let(F.regexp_replace(F.regexp_replace(x, DOT_RUN, " "), DASH_RUN, " "), _without_page_numbers)
    x = trimmed_lines(squeeze_blanks(x))
    return trim_ws(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def _without_page_numbers(x: Column) -> Column:
    """A line that only a number and dashes stand on is sought first, quickly; most texts have none."""
    numbers, pages = ("(?mUd)" + p for p in PAGE_NUMBER_LINES)
    bare = x.rlike(r"(?mUd)^[\s—\-&&[^\n]]*+\d++[\s—\-&&[^\n]]*+$")
    return let(F.when(bare, F.regexp_replace(x, numbers, "")).otherwise(x), lambda y: F.when(y.contains("第"), F.regexp_replace(y, pages, "")).otherwise(y))


def is_toc_page(x: Column, contents_word: str = "目录") -> Column:
    x = trim_ws(F.coalesce(x, F.lit("")))
    lines = lines_of(x)
    short = F.size(F.filter(lines, lambda s: (F.length(s) <= 80) & s.rlike(r"(?Ud)\d+\s*$")))
    runs = F.regexp_count(x, F.lit(DOT_RUN)) + F.regexp_count(x, F.lit(DASH_RUN))
    chapters = F.size(F.filter(F.slice(lines, 1, 15), lambda s: s.rlike("(?Ud)" + CHAPTER)))
    return (x != "") & (F.substring(x, 1, 100).contains(contents_word) | ((short >= 3) & ((runs >= 3) | (chapters >= 5))))


def remove_noise(x: Column, patterns: list[str] = NOISE) -> Column:
    for p in patterns:
        x = F.regexp_replace(x, "(?iuUd)" + p, " ")
    return x


def fix_ocr_noise(x: Column, patterns: list[str] = NOISE) -> Column:
    """Noise, spaces that Chinese does not have and broken signs go; texts that hold none of their characters are only tidied."""
    if patterns == NOISE:
        x = let(x, lambda s: F.when(s.rlike(NOISE_HINT), remove_noise(s)).otherwise(s))
    else:
        x = remove_noise(x, patterns)
    x = let(x, lambda s: F.when(s.rlike(SIGN_HINT), _fix_signs(s)).otherwise(s))
    return trim_ws(squeeze_blanks(x))


def _fix_signs(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?U)(?<=[一-鿿])\s+(?=[一-鿿])", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)\s+([，。；：！？、）】》])", "$1"), r"(?U)([（【《])\s+", "$1")
    return F.regexp_replace(F.regexp_replace(x, r"[—–]{2,}", "——"), r"[|¦]+", " ")


def is_title_line(s: Column) -> Column:
    return _any(s, TITLE_LINES)


def is_toc_line(s: Column) -> Column:
    return (s.contains("..") | s.contains("……")) & _any(s, TOC_LINES)


def is_noise_line(s: Column) -> Column:
    return _any(s, PURE_NOISE_LINES, "(?iuUd)")


def merge_lines(lines: Column, short: int = 15, patterns: list[str] = NOISE) -> Column:
    """Ordered fold: titles and contents lines stand alone; short lines are joined to a short buffer, without a separator."""
    tidy = F.filter(F.transform(lines, lambda s: fix_ocr_noise(s, patterns)), lambda s: (s != "") & ~is_noise_line(s))
    marked = F.transform(tidy, lambda s: F.struct(s.alias("s"), (is_title_line(s) | is_toc_line(s)).alias("alone")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def flush(acc: Column) -> Column:
        return F.when(acc["held"] != "", F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        joins = (acc["held"] != "") & (F.length(acc["held"]) < short) & (F.length(x["s"]) < short)
        return (
            F.when(x["alone"], F.struct(F.concat(flush(acc), F.array(x["s"])).alias("out"), F.lit("").alias("held")))
            .when(joins, F.struct(acc["out"].alias("out"), F.concat(acc["held"], x["s"]).alias("held")))
            .otherwise(F.struct(flush(acc).alias("out"), x["s"].alias("held")))
        )

    return F.aggregate(marked, start, step, flush)


def clean_ocr_page(x: Column, patterns: list[str] = NOISE) -> Column:
    x = fix_ocr_noise(unify_newlines(F.coalesce(x, F.lit(""))), patterns)
    return normalize(F.array_join(merge_lines(lines_of(x), patterns=patterns), "\n"))


def visible_ratio(x: Column, script: str = r"[一-鿿\p{Alnum}]") -> Column:
    """The part of visible characters that are of the class script, to four places; ties go to the even one."""
    # blanks and line ends go without a pattern; what else is white space is seldom there
    solid = F.regexp_replace(F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")), r"(?U)\s+", "")
    return let(solid, lambda s: F.bround(F.when(F.length(s) > 0, counted(s, script) / F.length(s)).otherwise(F.lit(0.0)), 4))


def has_structure(x: Column) -> Column:
    lines = lines_of(x)
    return F.exists(lines, is_title_line) | (F.size(F.filter(lines, is_toc_line)) >= 2)


def drop_reason(text: Column, ratio: Column, structured: Column, ocr_lines: Column, low_value: list[str] = LOW_VALUE) -> Column:
    """Why an OCR page is filtered, or the empty string."""
    hint = F.lit(False)
    for w in low_value:
        hint = hint | F.lower(text).contains(w.lower())
    return (
        F.when(text == "", F.lit("empty_after_clean")).when(structured, F.lit("")).when(F.length(text) < 15, F.lit("text_too_short<15"))
        .when(F.size(lines_of(text)) < 1, F.lit("line_count<1")).when(ratio < 0.15, F.lit("visible_text_ratio<0.15"))
        .when(ocr_lines <= 0, F.lit("ocr_line_count<=0")).when((F.length(text) < 80) & hint, F.lit("low_value_page_hint")).otherwise(F.lit(""))
    )


def clean_ocr_records(pages: DataFrame, text: str = "text", lines: str = "ocr_line_count") -> DataFrame:
    """Every OCR page with its cleaned text, measures and filter reason; none is dropped."""
    out = pages.withColumn("clean_text", clean_ocr_page(F.col(text)))
    out = out.withColumns({"raw_text_len": F.length(F.coalesce(F.col(text), F.lit(""))), "clean_text_len": F.length("clean_text"), "visible_text_ratio": visible_ratio(F.col("clean_text")), "has_structure_hint": has_structure(F.col("clean_text"))})
    out = out.withColumn("filter_reason", drop_reason(F.col("clean_text"), F.col("visible_text_ratio"), F.col("has_structure_hint"), F.coalesce(F.col(lines), F.lit(0))))
    return out.withColumn("is_filtered", F.col("filter_reason") != "")


def clean_native_docs(docs: DataFrame) -> DataFrame:
    """Documents with pages (page_num, text): cleaned pages with a contents flag, blank ones dropped, and the joined text."""
    pages = F.transform("pages", lambda p: F.struct(p["page_num"].alias("page_num"), is_toc_page(clean_page(p["text"])).alias("is_toc_page"), clean_page(p["text"]).alias("text")))
    out = docs.withColumn("cleaned_pages", F.filter(pages, lambda p: p["text"] != ""))
    body = F.transform(F.filter("cleaned_pages", lambda p: ~p["is_toc_page"]), lambda p: p["text"])
    return out.withColumn("cleaned_full_text", F.array_join(body, "\n\n"))


def text_quality(x: Column, script: str = r"[一-鿿]") -> Column:
    """struct of a text's label, reason, seven counts and three ratios; script: the characters that speak for it."""
    x = F.coalesce(x, F.lit(""))
    visible, main, english, digits, abnormal = (counted(x, c) for c in (SOLID, script, "[A-Za-z]", DIGIT, ABNORMAL))
    noise = sum((F.length(x) - F.length(F.regexp_replace(x, p, "")) for p in NOISE_RUNS), F.lit(0))

    def garbled(s: Column) -> Column:
        seen, own, odd, letters = (counted(s, c) for c in (SOLID, script, ABNORMAL, "[A-Za-z]"))
        return let(F.struct(seen.alias("n"), own.alias("own"), odd.alias("odd"), letters.alias("a")), lambda c: ((c["n"] >= 15) & (c["own"] <= 2) & (c["odd"] >= 3)) | ((c["n"] >= 25) & (c["own"] / c["n"] < 0.08) & ((c["odd"] + c["a"]) / c["n"] > 0.6)))

    segments = F.size(F.filter(F.split(x, "[\n。；;]", -1), lambda s: F.when(F.length(s) >= 15, garbled(s)).otherwise(False)))
    counts = F.struct(visible.alias("v"), main.alias("m"), english.alias("e"), digits.alias("d"), abnormal.alias("a"), noise.alias("n"), segments.alias("g"))

    def judged(c: Column) -> Column:
        part = lambda n: F.when(c["v"] > 0, n / c["v"]).otherwise(F.lit(0.0))
        own, odd, loud = part(c["m"]), part(c["a"]), part(c["a"] + c["n"])
        high, mixed = (own >= 0.25) & (odd < 0.03) & (c["g"] <= 2), (own >= 0.12) & (loud < 0.20) & (c["g"] <= 8)
        reason = F.when(c["v"] < 80, "text_too_short").when(high, "readable_chinese_text").when(mixed, "partially_readable").otherwise("garbled_or_noisy")
        label = F.when(c["v"] < 80, "low_quality").when(high, "high_quality").when(mixed, "mixed_quality").otherwise("low_quality")
        return F.struct(
            label.alias("quality_label"), reason.alias("quality_reason"), c["v"].alias("visible_chars"), c["m"].alias("script_chars"), c["e"].alias("english_chars"), c["d"].alias("digits"), c["a"].alias("abnormal_chars"),
            c["n"].alias("punctuation_noise"), c["g"].alias("garbled_segments"), F.bround(own, 4).alias("script_ratio"), F.bround(odd, 4).alias("abnormal_ratio"), F.bround(loud, 4).alias("noise_ratio"),
        )

    return let(counts, judged)
