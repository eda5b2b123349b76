"""Column expressions on text: normalising, cutting into terms, judging whether there is anything in it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F

# Punctuation that a normalised name has as spaces.
NAME_PUNCTUATION = "，。！？、,.!?;；:\"'“”‘’（）()【】[]{}<>"
# Words that say nothing as a node's name.
STOP_WORDS = """今天 明天 昨天 后天 前天 上午 下午 中午 晚上 早上 傍晚 凌晨 白天 夜里 本周 上周 下周 本月 上月 下月 今年 去年 明年 最近 刚刚 刚才 一会 一会儿 待会 今晚 明晚 昨晚
周一 周二 周三 周四 周五 周六 周日 周末 星期 工作日 休息日 放假 假期 节假日 一天 两天 三天 一周 两周 三周 一个月 两个月 三个月 半年 一年 一小时 两小时 三小时 半天 几分钟 几小时 几天 几周 几个月 几年
家里 家 公司 单位 食堂 学校 宿舍 教室 这边 那边 这里 那里 这儿 那儿 超市 商场 厕所 洗手间 电梯 楼梯 门口 早饭 午饭 晚饭 早餐 午餐 晚餐 夜宵 宵夜 吃饭 喝水 喝咖啡 喝茶 做饭 煮饭 买菜 购物 逛街 网购
买东西 取快递 拿快递 做家务 打扫 洗衣服 晾衣服 洗碗 倒垃圾 无意义 随便 测试 不知道 没什么 没事 还行 还好 可以 事情 东西 问题 情况 状态 想法 睡觉 我 你 他 她 它 我们 你们 他们 她们 自己 别人 大家
有人 某人 一个人 很多人 计划 目标 任务 工作 学习 生活 健康 时间 钱 心情 天气 温度 效率 很多 很少 一些 几个 一点 多点 少点""".split()
# Words of vague state.
VAGUE_WORDS = "还行 还好 可以 不错 一般 正常 普通 开心 难过 郁闷 烦躁 焦虑 生气 累 困 饿 冷 热 忙 闲 对了 错了".split()
# Patterns of names that are only a time, a number or a chapter, whole and contained.
TIME_NAMES = (
    r"\d{1,2}[:：]\d{2}",
    r"(凌晨|早上|上午|中午|下午|晚上|傍晚|夜里)?\d{1,2}点(半|多|过|左右)?",
    r"(凌晨|早上|上午|中午|下午|晚上|傍晚|夜里)?\d{1,2}点\d{1,2}分?",
    r"[零一二三四五六七八九十]{1,2}点[半多]",
    r"\d{1,2}月\d{1,2}[日号]",
    r"\d{4}年(\d{1,2}月)?",
    r"\d{1,4}",
    r"\d+[个只条次元块毛分角%％倍斤两克千克吨]",
    r"第\d+[章节篇]",
    r"第[零一二三四五六七八九十百]+[章节篇]",
    r"\d+(\.\d+)?(分钟|小时|天|周|月|年|秒)",
)
TIME_INSIDE = (r"周[一二三四五六日][^\d]{0,3}(上|中|下)午\d{1,2}点", r"每[周天月年][^\d]*\d{1,2}点", r"(凌晨|早上|上午|中午|下午|晚上|傍晚)[^\d]*\d{1,2}点")
# What makes a capture noise: contained words, beginnings of titles.
NOISE_WORDS = "无意义|随便|测试|test|不知道写什么|没什么|没事|asdf|qwer|test test|不知道|123|abc|无法提取|未提供实际|仅提供了|仅包含文件名|建议提供更详细|过于简短".split("|")
NOISE_TITLES = (r"^无意义", r"^随便", r"^测试", r"(?i)^test", r"^\d+$", r"^无法提取", r"^无标题内容", r"^截图文件", r"^屏幕截图\s*\d", r"(?i)^img[_-]?\d", r"(?i)^screenshot")
FILE_FACTS = r"^\s*文件名[:：][\s\S]{0,200}文件类型[:：][\s\S]{0,80}文件大小[:：]"
# Document types by file ending.
DOCUMENT_TYPES = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "md": "text/markdown", "txt": "text/plain"}
IMPORT_ENDINGS = ("pdf", "doc", "docx", "txt", "md")
MAX_FILE_BYTES = 10 * 1024 * 1024


def or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalize_name(c: Column | str) -> Column:
    """Lower case, punctuation as spaces, single spaces; '' for null."""
    spaced = F.translate(F.lower(F.trim(or_empty(c))), NAME_PUNCTUATION, " " * len(NAME_PUNCTUATION))
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def terms(c: Column | str) -> Column:
    """Han characters, pairs of neighbouring ones (other characters between them don't count), and Latin words of two characters and more."""
    text = or_empty(c)
    han = F.regexp_replace(text, "[^一-鿿]+", "")
    one, two = F.regexp_extract_all(han, F.lit("."), 0), F.regexp_extract_all(han, F.lit("(?=(..))"), 1)
    return F.concat(one, two, F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9-]+)"), 1))


def meaningful_length(c: Column | str, latin: bool = False) -> Column:
    """Han characters (and letters, where latin) left of a name without stop words, digits, punctuation and vague words."""
    s = or_empty(c)
    # longest first and one after the other, as a word may come about where another was taken out
    for n in sorted({len(w) for w in STOP_WORDS}, reverse=True):
        s = F.regexp_replace(s, "|".join(w for w in dict.fromkeys(STOP_WORDS) if len(w) == n), "")
    s = F.regexp_replace(s, r"[\d.,;:!?，。；：！？、…—\-·'\"“”‘’【】《》（）()\[\]{}<>+\s]+", "")
    s = F.regexp_replace(s, "|".join(VAGUE_WORDS), "")
    return F.length(F.regexp_replace(s, r"[^一-鿿\p{L}]" if latin else "[^一-鿿]", ""))


def is_trivial_name(c: Column | str, latin: bool = True) -> Column:
    """Whether a node's name says nothing: empty, a stop word, a time or number, or nothing left of it.

    latin: letters count as something; else only Han characters do.
    """
    s = F.trim(or_empty(c))
    whole = "^(?:" + "|".join(TIME_NAMES) + ")$"
    inside = "|".join(TIME_INSIDE)
    return (
        (s == "")
        | s.isin(STOP_WORDS + VAGUE_WORDS)
        | s.rlike("^[一-鿿]$")
        | s.rlike(r"^[\s\p{P}`~$^+=<>|]+$")
        | s.rlike(whole)
        | s.rlike(inside)
        | (meaningful_length(s, latin) <= 1)
    )


def is_noise_capture(title: Column | str, summary: Column | str, content: Column | str, tags: Column | str) -> Column:
    """Whether a capture says nothing: noise words, a noise title, file facts only, or a very short untagged body."""
    title, summary, content = or_empty(title), or_empty(summary), or_empty(content)
    tags = F.col(tags) if isinstance(tags, str) else tags
    text = F.trim(F.lower(F.concat_ws(" ", title, summary, content)))
    words = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in NOISE_WORDS])
    titles = reduce(lambda a, b: a | b, [title.rlike(p) for p in NOISE_TITLES])
    rest = F.regexp_replace(F.regexp_replace(content, FILE_FACTS, ""), r"[\s\p{P}\p{N}A-Za-z]", "")
    body = F.regexp_replace(F.concat_ws(" ", summary, content), r"[\s，。、！？；：,.!?;:\"“”‘’（）()\-—…\dA-Za-z]", "")
    untagged = F.coalesce(F.size(tags), F.lit(0)) <= 0
    return (text == "") | words | titles | (content.rlike(FILE_FACTS) & (F.length(rest) <= 10)) | (untagged & (F.length(body) > 0) & (F.length(body) <= 10))


def has_signal(content: Column | str, summary: Column | str, tags: Column | str) -> Column:
    """Tagged, or 24 characters of text and more."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    return (F.coalesce(F.size(tags), F.lit(0)) > 0) | (F.greatest(F.length(or_empty(content)), F.length(or_empty(summary))) >= 24)


def contains_text(query: str, *columns: str) -> Column:
    """Whether the words of a search occur in any column, without letter case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(or_empty(c)), F.lit(query.lower())) for c in columns])


def mime_of(file_name: Column | str) -> Column:
    """Document type by file ending; '' for others."""
    ending = F.lower(F.regexp_extract(or_empty(file_name), r"([^.]+)$", 1))
    out = F.lit("")
    for e, m in DOCUMENT_TYPES.items():
        out = F.when(ending == e, m).otherwise(out)
    return out


def is_supported_file(mode: Column | str, mime: Column | str, file_name: Column | str) -> Column:
    mode = F.col(mode) if isinstance(mode, str) else mode
    ending = F.lower(F.regexp_extract(or_empty(file_name), r"([^.]+)$", 1))
    return (
        F.when(mode == "photo", or_empty(mime).startswith("image/"))
        .when(mode == "audio", or_empty(mime).startswith("audio/"))
        .when(mode == "import", ending.isin(*IMPORT_ENDINGS))
        .otherwise(F.lit(False))
    )


def size_text(n: Column | str) -> Column:
    """Bytes for people: B, KB, MB, GB with one decimal from KB on."""
    n = F.coalesce(F.col(n) if isinstance(n, str) else n, F.lit(0)).cast("double")
    step = lambda power, unit: F.concat(F.format_string("%.1f", n / float(1024**power)), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1024**2, step(1, " KB")).when(n < 1024**3, step(2, " MB")).otherwise(step(3, " GB"))


def clip(c: Column | str, n: int, mark: str = "…") -> Column:
    """The first n characters; longer texts end in the mark."""
    c = or_empty(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def days_ago_text(at: Column | str, asof: Column) -> Column:
    """today, yesterday or n days ago; '' for null. Halves round up, the future counts as today."""
    at = F.col(at) if isinstance(at, str) else at
    days = F.greatest(F.floor((F.unix_millis(asof) - F.unix_millis(at)) / F.lit(86400000.0) + 0.5), F.lit(0))
    return F.when(at.isNull(), "").when(days == 0, "today").when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def embedding_text(*parts: Column) -> Column:
    """Parts that are not empty, on a line each, at most 8000 characters."""
    return F.substring(F.concat_ws("\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts]), 1, 8000)


def node_embedding_text(name: Column, normalized: Column, kind: Column, aliases: Column, metadata: Column | None = None) -> Column:
    """What a node is embedded by: its name, the normalised one where it differs, kind, aliases and metadata as JSON."""
    differs = F.when(F.coalesce(normalized, F.lit("")) != F.coalesce(name, F.lit("")), normalized)
    said = [name, differs, kind, F.array_join(F.coalesce(aliases, F.array().cast("array<string>")), ", "), *([F.to_json(metadata)] if metadata is not None else [])]
    return embedding_text(*said)


def trimmed_norm(c: Column | str) -> Column:
    """The plain normal form that tables are filled with: trimmed, in lower case."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def spaced_norm(c: Column | str) -> Column:
    """The normal form of seeded names: trimmed, in lower case, any run of blanks as one space."""
    return F.regexp_replace(trimmed_norm(c), r"\s+", " ")


def unique_strings(c: Column | str) -> Column:
    """Trimmed, without blanks and repeats, in the order of first occurrence; [] for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def json_array_in(c: Column | str) -> Column:
    """From the first [ to the last ] of a text; null without them."""
    return F.nullif(F.regexp_extract(or_empty(c), r"(?s)(\[.*\])", 1), F.lit(""))


def json_object_in(c: Column | str) -> Column:
    """From the first { to the last } of a text; null without them."""
    return F.nullif(F.regexp_extract(or_empty(c), r"(?s)(\{.*\})", 1), F.lit(""))


# ---- tolerant JSON: what built-in parsing cannot read goes through one scan that knows strings and brackets


def repair_json(text: str | None) -> str | None:
    """The first JSON object of a text, as JSON: fences and talk around it dropped, inner quotes escaped, open brackets closed.

    null where there is none. At most eight brackets are closed.
    """
    import json

    if not text:
        return None
    start = text.find("{")
    if start < 0:
        return None
    for candidate in _objects(text, start):
        try:
            return json.dumps(json.loads(candidate, strict=False), ensure_ascii=False)
        except ValueError:
            continue
    return None


def _objects(text: str, start: int) -> Iterator[str]:
    """The object as it stands, then with lone quotes escaped, then with open brackets closed."""
    for body in (text[start:], _escape_inner_quotes(text[start:])):
        stack, inside, skip, closed = [], False, False, None
        for i, c in enumerate(body):
            if skip:
                skip = False
            elif c == "\\" and inside:
                skip = True
            elif c == '"':
                inside = not inside
            elif not inside and c in "{[":
                stack.append("}" if c == "{" else "]")
            elif not inside and c in "}]" and stack:
                stack.pop()
                if not stack:
                    closed = i + 1
                    break
        if closed is not None:
            yield body[:closed]
        elif len(stack) <= 8:
            rest = body.rstrip()
            yield (rest + '"' if inside else rest.rstrip(",")) + "".join(reversed(stack))


def _escape_inner_quotes(text: str) -> str:
    """A quote inside a string that neither closes a key nor a value is escaped: what follows a closing one is , : } ] or the end."""
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and inside:
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            if not inside:
                inside = True
            elif text[i + 1 :].lstrip()[:1] in (",", ":", "}", "]", ""):
                inside = False
            else:
                out.append("\\")
        out.append(c)
        i += 1
    return "".join(out)


def parsed_json(c: Column | str, schema: str) -> Column:
    """``c`` as a struct: by the built-in parser, or repaired where that finds nothing."""

    @F.pandas_udf("string")
    def repaired(s: pd.Series) -> pd.Series:
        return s.map(repair_json, na_action="ignore")

    col = F.col(c) if isinstance(c, str) else c
    direct = F.from_json(col, schema)
    valid = F.try_parse_json(col).isNotNull()
    return F.when(valid, direct).otherwise(F.from_json(repaired(F.when(~F.coalesce(valid, F.lit(False)), col)), schema))
