"""Text functions as column expressions; the sequential ones as Arrow UDFs over whole columns."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import small_batches

# Code points that count as CJK for the splitter, and the fewer that do in entity names.
CJK = (
    r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{F900}-\x{FAFF}"
    r"\x{2F800}-\x{2FA1F}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\x{2E80}-\x{2EFF}\x{31C0}-\x{31EF}]"
)
CJK_NAME = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{F900}-\x{FAFF}]"
# Control, replacement, zero-width and byte-order characters that names should not hold.
SUSPICIOUS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}\x{FFFE}\x{FFFF}\x{200B}-\x{200F}\x{FEFF}]"
# What a number with a unit ends in.
UNITS = "|".join((
    "[元块角分]", "万元?", "[亿万千百]元?", "[天年月日周时分钟秒]", "[个只条件次项笔张份篇页本节章]", "[%％]", "[倍成]", "[点份股手]",
    "ng/ml", "ng/mL", "ng/dl", "ng/L", "mmol/L", "mmol/l", "μmol/L", "pg/ml", "pg/mL", "g/L", "mg/L", "U/L", "U/ml", "mIU/L",
    r"[×xX]10\^?\p{Nd}+/L", "kg", "g", "mg", "μg", "[mkc]?m", "[kMGT]?Hz", "[kMGT]?B", "[kMGT]?bps",
))
# Identity cards, phone numbers, codes, dates and times, as whole names.
ID_CARD = r"^\p{Nd}{17}[\p{Nd}Xx]$"
PHONE = r"^\p{Nd}{3}-?\p{Nd}{7,8}$|^\p{Nd}{4}-?\p{Nd}{7,8}$|^\p{Nd}{11}$"
CODES = (r"^\p{Nd}{8,}$", r"^\p{Nd}{2,4}[-/]\p{Nd}{2,4}[-/]\p{Nd}{2,8}$", r"^\p{Nd}{6,}[A-Za-z]{1,3}\p{Nd}*$", r"^(?=.*\p{Nd})[A-Za-z0-9]{12,}$")
DATES = (
    r"^\p{Nd}{4}年(\p{Nd}{1,2}月(\p{Nd}{1,2}日?)?)?$", r"^\p{Nd}{4}-\p{Nd}{2}(-\p{Nd}{2})?$", r"^\p{Nd}{4}/\p{Nd}{1,2}(/\p{Nd}{1,2})?$",
    r"^\p{Nd}{4}\.\p{Nd}{1,2}(\.\p{Nd}{1,2})?$", r"^\p{Nd}{1,2}:\p{Nd}{2}(:\p{Nd}{2})?$", r"^\p{Nd}+\s*[天年月日周时分钟秒]$", r"^\p{Nd}{4}$",
)
# Endings of Chinese names of organisations, places, people and undertakings; frequent surnames.
NAME_ENDINGS = tuple(
    "大学 学院 中学 小学 学校 研究院 研究所 公司 集团 中心 部门 委员会 办公室 办事处 银行 医院 图书馆 博物馆 省 市 县 区 镇 村 街道 山 河 湖 海 岛 教授 博士 老师 先生 女士 同学 "
    "项目 计划 方案 报告 通知 办法 规定 系统 平台 模型 方法 技术 理论 工程 专业 课程 教材 论文 实验".split()
)
SURNAMES = frozenset(
    "王李张刘陈杨黄赵周吴徐孙马胡朱郭何罗高林郑梁谢唐许冯宋韩邓彭曹曾田萧潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤温康"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def trim(c: Column) -> Column:
    """Trim of Unicode white space. What begins and ends with a visible ASCII character has none."""
    return F.when(c.rlike(r"(?s)^[!-~](?:.*[!-~])?\z"), c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def is_cjk(c: Column, names: bool = False) -> Column:
    """STR-01."""
    return c.rlike("^" + (CJK_NAME if names else CJK))


def detect_chinese(c: Column, threshold: float = 0.5) -> Column:
    """STR-02: share of CJK characters among letters."""
    cjk = F.regexp_count(c, F.lit(CJK))
    letters = F.regexp_count(c, F.lit(r"\p{L}|" + CJK))
    return F.when(letters > 0, cjk / letters >= threshold).otherwise(F.lit(False))


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), trim), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    """STR-03."""
    return _parts(c, r"\n\s*\n")


def lines(c: Column) -> Column:
    """STR-04."""
    return _parts(c, LINE_BREAK)


def sentences(c: Column) -> Column:
    """STR-05."""
    return _parts(c, r"(?<=[.!?。！？])\s+")


def hard_split(c: Column, width: int) -> Column:
    """STR-07."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)), F.lit(width))
    return F.filter(F.transform(starts, lambda i: F.substring(c, i, F.lit(width))), lambda x: x != "")


def pack_parts(parts: list[str], limit: int, glue: str = "\n\n") -> list[str]:
    """STR-06: greedy packing of parts under a limit."""
    out, now = [], ""
    for p in parts:
        if now and len(now) + len(glue) + len(p) > limit:
            out.append(now)
            now = p
        else:
            now = now + glue + p if now else p
    return out + [now] if now else out


def _split(text: str, pattern: str) -> list[str]:
    return [x for x in (p.strip() for p in re.split(pattern, text)) if x]


def _levels(text: str, limit: int, splits: list) -> list[str]:
    """Parts by the first of the splits, packed; what is still too long goes on to the next one."""
    out: list[str] = []
    for part in pack_parts(splits[0](text), limit):
        if len(part) <= limit:
            out.append(part)
        elif len(splits) > 1:
            out += _levels(part, limit, splits[1:])
        else:
            out += [part[i : i + limit] for i in range(0, len(part), limit)]
    return out


def chunk(text: str | None, max_chars: int = 24000, overlap: int = 500) -> list[str]:
    """STR-08: paragraphs; what is too long by lines, then sentences, then hard cuts, packed anew at each level. A chunk is
    led by the tail of the one before if that is longer than the overlap."""
    if not (text or "").strip():
        return []
    by_lines = lambda t: [x for x in map(str.strip, t.splitlines()) if x]
    out = _levels(text, max_chars, [lambda t: _split(t, r"\n\s*\n"), by_lines, lambda t: _split(t, r"(?<=[.!?。！？])\s+")])
    if overlap <= 0:
        return out
    return out[:1] + [a[-overlap:] + "\n\n" + b if len(a) > overlap else b for a, b in zip(out, out[1:])]


def resplit(text: str, depth: int = 0, deepest: int = 3) -> list[str]:
    """STR-09: two halves, cut behind the last paragraph, else line, else sentence that ends in the second quarter; from
    the depth `deepest` on in the middle, whatever stands there."""
    half = len(text) // 2
    if depth >= deepest:
        return [text[:half], text[half:]]
    # The boundaries, in the order they are looked for.
    for mark in ("\n\n", "\n", ". ", "。", "! ", "？", "? "):
        at = text.rfind(mark, 0, half)
        if at > 0 and at > half // 2:
            half = at + len(mark)
            break
    return [x for x in (text[:half].strip(), text[half:].strip()) if x]


def chunk_udf(max_chars: int, overlap: int):
    @F.pandas_udf("array<string>")
    def fn(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunk(t, max_chars, overlap))

    small_batches(SparkSession.active())
    return fn.asNondeterministic()  # or a filter that explode brings along would cut all texts a second time


def _runs(parts: Column, n: int) -> Column:
    """Parts of n characters each, sorted, so that equal ones are a run: the runs."""
    return F.regexp_extract_all(F.array_join(F.sort_array(parts), ""), F.lit(rf"(?s)(.{{{n}}})\1*"), 0)


def _histogram(c: Column) -> Column:
    return F.transform(_runs(F.split(c, ""), 1), F.length)


def char_entropy(c: Column) -> Column:
    """STR-10, AGG-13: bits a character."""
    n = F.length(c)
    return F.when(n > 0, F.aggregate(_histogram(c), F.lit(0.0), lambda a, k: a - (k / n) * F.log2(k / n))).otherwise(F.lit(0.0))


def repeated_ngrams(c: Column, n: int = 2) -> Column:
    """STR-11: share of the distinct n-grams that occur more than once; 0 for texts of less than two of them."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    runs = _runs(grams, n)
    again = F.size(F.filter(runs, lambda x: F.length(x) > n))
    return F.when(F.length(c) < 2 * n, F.lit(0.0)).otherwise(again / F.greatest(F.size(runs), F.lit(1)))


def has_repeated_chars(c: Column, threshold: int = 4) -> Column:
    """STR-12: any character that occurs so often in all."""
    return F.exists(_histogram(c), lambda k: k >= threshold)


def suspicious_count(c: Column) -> Column:
    """STR-13."""
    return F.regexp_count(c, F.lit(SUSPICIOUS))


def gibberish(c: Column) -> Column:
    """STR-14."""
    latin, cjk = F.regexp_count(c, F.lit("[A-Za-z]")), F.regexp_count(c, F.lit(CJK_NAME))
    score = (
        F.least(F.lit(0.4), suspicious_count(c) * 0.1)
        + F.when((F.length(c) >= 3) & (char_entropy(c) < 1.5), 0.3).otherwise(0.0)
        + F.when(repeated_ngrams(c) > 0.5, 0.3).otherwise(0.0)
        + F.when(has_repeated_chars(c), 0.2).otherwise(0.0)
        + F.when((latin > 0) & (latin <= 2) & (cjk >= 3), 0.2).otherwise(0.0)
    )
    return F.when(trim(c) == "", F.lit(1.0)).otherwise(F.least(F.lit(1.0), score))


def _ranges(pattern: str) -> np.ndarray:
    """The code points of a class of escaped ones, as sorted ends of stretches: a point is in it if an odd number of ends is not above it."""
    code = r"\\x(?:\{([0-9A-F]+)\}|([0-9A-F]{2}))"
    found = [[int(x, 16) for x in m.groups() if x] for m in re.finditer(f"{code}(?:-{code})?", pattern)]
    return np.array(sorted(e for f in found for e in (f[0], f[-1] + 1)))


_SUSPICIOUS_ENDS, _NAME_ENDS = _ranges(SUSPICIOUS), _ranges(CJK_NAME)


def _per_row(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the distinct keys row * width + value: their rows, and how often each occurs."""
    values, counts = np.unique(keys, return_counts=True)
    return values // width, counts


def gibberish_scores(names: list[str | None]) -> np.ndarray:
    """`gibberish` of names that are not blank, a batch at once."""
    n, width = len(names), 0x110000
    joined = "".join(x or "" for x in names)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    length = np.fromiter((len(x or "") for x in names), np.int64, n)
    row = np.repeat(np.arange(n), length)
    of = lambda hit: np.bincount(row[hit], minlength=n)
    within = lambda ends: of(np.searchsorted(ends, points, "right") % 2 == 1)
    at, k = _per_row(row * width + points, width)
    share = k / np.maximum(length[at], 1)
    entropy = np.bincount(at, -share * np.log2(share), minlength=n)
    four = np.bincount(at[k >= 4], minlength=n) > 0
    # Pairs of neighbours within a row; a pair's number is given by its first and second character among those of the batch.
    known, number = np.unique(points, return_inverse=True)
    pair = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    base = max(1, len(known)) ** 2
    at, k = _per_row(row[:-1][pair] * base + number[:-1][pair] * max(1, len(known)) + number[1:][pair], base)
    again = np.bincount(at[k > 1], minlength=n) / np.maximum(np.bincount(at, minlength=n), 1)
    letter = points | 0x20
    latin, own = of((letter >= 0x61) & (letter <= 0x7A)), within(_NAME_ENDS)
    score = np.minimum(0.4, within(_SUSPICIOUS_ENDS) * 0.1) + np.where((length >= 3) & (entropy < 1.5), 0.3, 0.0)
    score = score + np.where((length >= 4) & (again > 0.5), 0.3, 0.0) + np.where(four, 0.2, 0.0)
    return np.minimum(1.0, score + np.where((latin > 0) & (latin <= 2) & (own >= 3), 0.2, 0.0))


def gibberish_of(c: Column) -> Column:
    """STR-14 for tables of names: `gibberish`, counted in batches."""

    @F.pandas_udf("double")
    def fn(s: pd.Series) -> pd.Series:
        return pd.Series(gibberish_scores(s.tolist()))

    return F.when(c.isNull(), F.lit(0.4)).when(trim(c) == "", F.lit(1.0)).otherwise(fn.asNondeterministic()(c))


def _digits(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{Nd}"))


#: What every number, code and date begins with, or ends in, or is made of: names that are none of these pass by one pattern. Its
#: long class is looked up once a name, for the last character, and not at each place.
_ODD = r"""(?Us)^(?:[\p{Nd}.+\-,，'"\s]|.*+(?<=[元块角分万亿千百天年月日周时钟秒个只条件次项笔张份篇页本节章%％倍成点股手lLgmzBs])|[A-Za-z0-9]{12,}$)"""


def numeric_dominant(c: Column) -> Column:
    """STR-15: a plain number; a third of digits or nearly, and a unit; or a number with up to six characters behind it."""
    s = trim(c)
    bare = F.regexp_replace(s, r"""(?U)[,，\s'"]""", "")
    number = bare.rlike(r"^[\p{Nd}.+-]+$") & (_digits(bare) / F.length(bare) >= 0.5) & (F.length(bare) >= 2)
    measured = (_digits(s) >= F.length(s) * 0.3) & s.rlike(rf"({UNITS})$") & (_digits(s) > 0)
    lead = r"(?U)^[-+]?\s*[\p{Nd},，.\s]+"
    led = s.rlike(lead) & (F.length(F.regexp_replace(s, lead, "")) <= 6) & (_digits(s) >= 2)
    return F.when((s == "") | ~s.rlike(_ODD), F.lit(False)).otherwise(number | measured | led)


def is_phone(c: Column) -> Column:
    return trim(c).rlike(PHONE)


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def code_like(c: Column) -> Column:
    """STR-16."""
    s = trim(c)
    return F.when(~s.rlike(_ODD), F.lit(False)).otherwise(s.rlike(ID_CARD) | (~is_phone(s) & _any(s, CODES)))


def date_like(c: Column) -> Column:
    """STR-17."""
    return _any(trim(c), DATES)


def is_literal(c: Column) -> Column:
    """STR-18: blank, or no phone number and a date, numeric or code-like. Dates come first, as their rule is the shortest."""
    s = trim(c)
    return F.when(s == "", F.lit(True)).when(~s.rlike(_ODD), F.lit(False)).otherwise(~is_phone(c) & (date_like(c) | numeric_dominant(c) | code_like(c)))


_NAME_CHAR = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), CJK_NAME))


def plausible_word(name: str, segment) -> bool:
    """STR-19 for one name: `segment` cuts it into words. Up to two Chinese characters, a known ending or a surname before
    two characters pass; mostly single characters, or one long word and little else, do not."""
    own = _NAME_CHAR.findall(name)
    if len(own) <= 2 or name.endswith(NAME_ENDINGS) or (len(own) == 3 and own[0] in SURNAMES):
        return True
    words = list(segment(name))
    chinese = [w for w in words if w and all(map(_NAME_CHAR.match, w))]
    long_words = [w for w in chinese if len(w) > 1]
    if (len(chinese) - len(long_words)) * 2 > len(own) or (len(long_words) == 1 and len(long_words[0]) > 2):
        return False
    return len(own) < 4 or len(words) > 2 or len(long_words) > 1


def word_check(segment):
    """STR-19 over a column, with an injected segmenter (str -> words)."""

    @F.pandas_udf("boolean")
    def fn(s: pd.Series) -> pd.Series:
        return s.map(lambda x: plausible_word(x or "", segment))

    return fn


def string_similarity(a: Column, b: Column) -> Column:
    """STR-20, SET-06."""
    x, y = F.lower(a), F.lower(b)
    sets = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda v: v != ""))
    shared = F.size(F.array_intersect(sets(x), sets(y))) / F.greatest(F.size(sets(x)), F.size(sets(y)), F.lit(1))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.85).otherwise(shared)


def canonical_name(a: Column, b: Column) -> Column:
    """STR-21: the longer one, the first at a tie."""
    return F.when(F.length(b) > F.length(a), b).otherwise(a)


def safe_path(c: Column) -> Column:
    """STR-22."""
    return F.translate(c, "/\\: ", "____")


def cut(c: Column, n: int = 500) -> Column:
    """STR-23."""
    return F.left(c, F.lit(n))


def human_size(c: Column) -> Column:
    """FLT-22."""
    tenth = lambda unit: F.floor(c * 10 / float(unit) + 0.5) / 10  # noqa: E731  halves go up
    return (
        F.when(c < 1024, F.format_string("%d B", c.cast("long")))
        .when(c < 1024**2, F.format_string("%.1f KB", tenth(1024)))
        .when(c < 1024**3, F.format_string("%.1f MB", tenth(1024**2)))
        .otherwise(F.format_string("%.1f GB", tenth(1024**3)))
    )
