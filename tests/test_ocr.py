"""OCR pages cleaned by columns against the same rules applied line by line in Python."""

import re
import time
from fractions import Fraction

import numpy as np
from graphloom.operators import clean
from graphloom.plans import queries
from pyspark.sql import functions as F


def fix(x):
    for p in clean.NOISE:
        x = re.sub(p, " ", x, flags=re.I)
    x = re.sub(r"(?<=[一-鿿])\s+(?=[一-鿿])", "", x)
    x = re.sub(r"([（【《])\s+", r"\1", re.sub(r"\s+([，。；：！？、）】》])", r"\1", x))
    x = re.sub(r"[|¦]+", " ", re.sub(r"[—–]{2,}", "——", x))
    return re.sub(r"[ \t]+", " ", x).strip()


def any_of(patterns, x, flags=0):
    return any(re.search(p, x, flags) for p in patterns)


def page(text):
    text = fix((text or "").replace("\r\n", "\n").replace("\r", "\n"))
    out, held = [], ""
    for line in filter(None, map(str.strip, text.split("\n"))):
        line = fix(line)
        if not line or any_of(clean.PURE_NOISE_LINES, line, re.I):
            continue
        if any_of(clean.TITLE_LINES, line) or any_of(clean.TOC_LINES, line):
            out += ([held] if held else []) + [line]
            held = ""
        elif held and len(held) < 15 and len(line) < 15:
            held += line
        else:
            out += [held] if held else []
            held = line
    joined = "\n".join(out + ([held] if held else [])).replace("　", " ")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", joined)).strip()


def record(text, lines, script=r"[一-鿿A-Za-z0-9]"):
    x = page(text)
    solid, parts = len(re.sub(r"\s+", "", x)), [y for y in map(str.strip, x.split("\n")) if y]
    ratio = round(Fraction(len(re.findall(script, x)), solid) * 10_000) / 10_000 if solid else 0.0
    structured = any(any_of(clean.TITLE_LINES, y) for y in parts) or sum(any_of(clean.TOC_LINES, y) for y in parts) >= 2
    if not x:
        why = "empty_after_clean"
    elif structured:
        why = ""
    elif len(x) < 15:
        why = "text_too_short<15"
    elif ratio < 0.15:
        why = "visible_text_ratio<0.15"
    elif (lines or 0) <= 0:
        why = "ocr_line_count<=0"
    else:
        why = "low_value_page_hint" if len(x) < 80 and any(w in x for w in clean.LOW_VALUE) else ""
    return x, len(text or ""), len(x), ratio, structured, why, why != ""


KEPT = ["clean_text", "raw_text_len", "clean_text_len", "visible_text_ratio", "has_structure_hint", "filter_reason", "is_filtered"]


def test_pages_put_together_from_all_kinds_of_lines(spark):
    rng = np.random.default_rng(5)
    lines = ["1 总则", "附录 A", "表 3 参数", "目录", "前言", "4.2.1 试验方法........ 12", "范围…… 3", "12", "- 5 -", "第 3 页", "Page 7", "www.bzfxw.com", "学 兔 兔", "标 准 下 载", "~~~~", "", " ", "　", "短句", "本规范 适用于 设备", "运行 ， 维护",
             "（ 见 图 ）", "a|b¦¦c", "——–—", "一二三四五六七八九十一二三四五六", "责任编辑", "版权所有 侵权必究", "仅供内部使用", "the quick brown fox", "$%^&*()", "温度\t\t升高", "GB/T 1234", "内 部 资 料", "扫描全能王"]
    texts = [rng.choice(["\n", "\r\n", "\r"]).join(rng.choice(lines, int(n))) for n in rng.integers(0, 14, 600)] + [None, "\n\n\n", "$%^&*()" * 9 + "a"]
    rows = [(i, t, [None, 0, 3][i % 3]) for i, t in enumerate(texts)]
    got = {r["i"]: tuple(r[k] for k in KEPT) for r in clean.clean_ocr_records(spark.createDataFrame(rows, "i int, text string, ocr_line_count int")).collect()}
    wrong = [(texts[i], got[i], record(t, n)) for i, t, n in rows if got[i] != record(t, n)]
    assert not wrong, wrong[0]
    assert len({x[5] for x in got.values()}) == 6


def test_registered_query_over_whole_texts(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = ["word", "12", "|", "—", "technique", ".", "3.1 Scope", "短", "\n", "\n\n", "x" * 30]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 200, 150)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.ocr_drop_reason(spark, str(tmp_path)).select("doc_id", "clean_text_len", "visible_text_ratio", "has_structure_hint", "is_filtered", "filter_reason").collect()}
    for i, t in enumerate(texts):
        _, _, n, ratio, structured, why, filtered = record(t, t.count("\n") + 1)
        assert got[i] == (n, ratio, structured, filtered, why)


def test_hints_hold_for_all_that_they_guard(spark):
    noise = ["学 兔\u3000兔", "WWW . bzfxw.COM", "w w w . B z\u00a0F\nx w. c o m", "w w w.b z f x w.com", "标\n准下载", "免费下 载", "仅 供 谁 使 用", "内部资料", "扫描全能王", "仅供学习交流", "更多免费资料下载"]
    signs = ["机 油", "油 ，", "（ 油", "a——–b", "a|b", "a¦b", "a  \t b", "a\tb", "中|文", "文|，"]
    quiet = ["abzug", "b zip", "plain text - with signs.", "é ñ", ""]
    rows = spark.createDataFrame([(t,) for t in [*(f"x {t} y" for t in noise + signs), *quiet]], "t string")
    got = {r["t"]: r for r in rows.select("t", clean.fix_ocr_noise(F.col("t")).alias("fixed"), clean.fix_ocr_noise(F.col("t"), list(clean.NOISE) + ["(?!)"]).alias("plain")).collect()}
    assert all(r["fixed"] == r["plain"] == fix(t) for t, r in got.items())
    assert all(got[f"x {t} y"]["fixed"] == "x y" for t in noise)


def test_lines_are_not_tried_at_each_character(spark):
    """2,000 lines of 4,000 characters against the patterns of titles: with an anchor in each pattern every character was tried."""
    lines = spark.range(2000).select(F.concat(F.lit("x"), F.repeat(F.lit("word "), 800), F.col("id").cast("string")).alias("s")).cache()
    lines.count()

    def seconds(c):
        best = 9e9
        for _ in range(3):
            began = time.perf_counter()
            lines.select(F.count_if(c)).collect()
            best = min(best, time.perf_counter() - began)
        return best

    each = F.col("s").rlike("(?Ud)" + "|".join(f"(?:{p})" for p in clean.TITLE_LINES))
    assert seconds(clean.is_title_line(F.col("s"))) < seconds(each) / 2
