"""One consistent form for text that looks the same in different characters.

Folded: width, invisible characters, kinds of space and hyphen, ligatures and radicals, combining accents, look-alike
letters. Kept: letter case, accents, superscripts, circled numbers, simplified and traditional characters.

Every character has a quick-check property: it is stable if it stands for itself and cannot join what stands before it.
Only runs of other characters are normalised, with the character before as context, and spliced into the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Letters of other scripts with the same look as a Latin letter, by that letter.
LOOKALIKES = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐ", "C": "СϹᏟⲤꓚ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "ΗНᎻⲎꓧ", "I": "ΙІӀⲒꓲ", "J": "ЈͿᎫꓙ", "K": "ΚКᏦⲔꓗ",
    "L": "Ꮮꓡ", "M": "ΜМᎷϺⲘꓟ", "N": "ΝⲚꓠ", "O": "ΟОՕⲞꓳ", "P": "ΡРᏢⲢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢⲦꓔ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ",
    "X": "ΧХⲬꓫ", "Y": "ΥҮⲨꓬ", "Z": "ΖᏃꓜ",
    "a": "аɑα", "c": "сϲᴄⲥ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօᴏⲟ", "p": "рρⲣ",
    "q": "ԛ", "s": "ѕꜱ", "u": "υսᴜ", "v": "νѵᴠ", "w": "ԝᴡ", "x": "х", "y": "уγү", "z": "ᴢ",
}
# Radicals without a decomposition of their own, and the characters that they are.
RADICALS = {
    "⺁": "厂", "⺌": "小", "⺏": "尣", "⺒": "巳", "⺓": "幺", "⺖": "忄", "⺘": "扌", "⺙": "攵", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺤": "爫",
    "⺦": "丬", "⺨": "犭", "⺩": "王", "⺫": "目", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺯": "糹", "⺰": "纟", "⺶": "羊", "⺹": "耂", "⺼": "肉",
    "⺾": "艹", "⻁": "虎", "⻂": "衤", "⻄": "西", "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻋": "车", "⻌": "辶", "⻐": "钅", "⻑": "長",
    "⻓": "长", "⻔": "门", "⻕": "阜", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻠": "饣", "⻢": "马",
    "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀",
}
# Hyphens of another code, and invisible characters that are not in the format category.
HYPHENS = "‐‑‒–−⁃﹣－˗"
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
#: Compatibility letters that are another encoding of the same glyph, as ranges.
SAME_GLYPH = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0x2E9F, 0x2E9F), (0x2EF3, 0x2EF3), (0x2F00, 0x2FD5), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
_TAGS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")

#: Characters that are stable for certain, as a class for Java and Python; texts of these only are never sent to Python.
STABLE_CLASS = "\\x21-\\x7e\\u00a1-\\u00ac\\u00ae-\\u0131\\u0134-\\u013e\\u0141-\\u0148\\u014a-\\u017e\\u4e00-\\u9fff\\u3001-\\u3029\\u3030-\\u303f\\u3041-\\u3096\\u30a1-\\u30fa\\uac00-\\ud7a3"

_FOLD = {c: a for a, cs in LOOKALIKES.items() for c in cs} | RADICALS | {c: "-" for c in HYPHENS} | {c: "" for c in INVISIBLE}
#: Stands for a joiner that is kept; a code point that no text may hold.
_KEEP = "\ufdd0"


def _fold(c: str) -> str:
    """What one decomposed character is written as."""
    if c in _FOLD:
        return _FOLD[c]
    kind, code = unicodedata.category(c), ord(c)
    if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
        return ""
    if kind in ("Zs", "Zl", "Zp") or c in "\t\n\v\f\r\x85":
        return " "
    tag, _, points = unicodedata.decomposition(c).partition(" ")
    if tag in _TAGS or tag == "<compat>" and any(a <= code <= b for a, b in SAME_GLYPH):
        return "".join(_fold(d) for p in points.split() for d in unicodedata.normalize("NFD", chr(int(p, 16))))
    return c


@lru_cache(maxsize=65536)
def _folded(c: str) -> str:
    """The folded canonical decomposition of one character."""
    return "".join(_fold(d) for d in unicodedata.normalize("NFD", c))


@lru_cache(maxsize=65536)
def stable(c: str) -> bool:
    """Whether a character stands for itself and neither combines with nor composes onto what stands before it."""
    return c != _KEEP and unicodedata.combining(c) == 0 and unicodedata.is_normalized("NFC", c) and unicodedata.is_normalized("NFC", "e" + c) and unicodedata.normalize("NFC", _folded(c)) == c and not _joins_back(c)


def _joins_back(c: str) -> bool:
    """Vowels and finals of conjoining Hangul and the like may compose onto a starter before them."""
    code = ord(c)
    return 0x1161 <= code <= 0x1175 or 0x11A8 <= code <= 0x11C2 or code in (0x09BE, 0x09D7, 0x0B3E, 0x0B56, 0x0B57, 0x0BBE, 0x0BD7, 0x0CC2, 0x0CD5, 0x0CD6, 0x0D3E, 0x0D57, 0x0DCF, 0x0DDF, 0x102E, 0x1B35)


@lru_cache(maxsize=1)
def _patterns():
    import regex

    clearly = regex.compile(f"[^ {STABLE_CLASS}]+")
    emoji = r"\p{Extended_Pictographic}[︎️\U0001F3FB-\U0001F3FF]*"
    return clearly, regex.compile(rf"(?<={emoji})‍(?={emoji})", regex.V1)


def normalise_segment(segment: str) -> str:
    return unicodedata.normalize("NFC", "".join(_folded(c) if c != _KEEP else c for c in segment))


def canonical(text: str | None) -> str | None:
    """The one form of all texts that look like this one; null for null. Spaces at the ends are not seen, so they go."""
    if not text:
        return text
    clearly, joiner = _patterns()
    if "‍" in text:  # joiners inside an emoji show
        text = joiner.sub(_KEEP, text)
    out, at = [], 0
    for m in clearly.finditer(text):
        i, end = m.start(), m.end()
        while i < end:
            if stable(text[i]):
                i += 1
                continue
            j = i + 1
            while j < end and not stable(text[j]):
                j += 1
            start = max(at, i - 1)  # the character before, onto which the first may compose
            out.append(text[at:start])
            out.append(normalise_segment(text[start:j]))
            at = i = j
    out.append(text[at:])
    return "".join(out).replace(_KEEP, "‍").strip(" ")


def canonical_texts(df: DataFrame, text_col: str, out_col: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of ``text_col``; null for null, other columns as they are.

    A column of the name ``out_col`` is replaced. Texts of stable characters only stay in the JVM and keep their text; the rest goes through Arrow batches.
    """
    df = df.select(*[c for c in df.columns if c.lower() != out_col.lower() or c == text_col])
    c = F.col(text_col)
    # one class and no repeated group: such a pattern would overflow Java's stack on a long text
    seen = c.isNull() | ~(c.rlike(f"[^ {STABLE_CLASS}]") | c.startswith(" ") | c.endswith(" "))
    kept = df.where(seen).withColumn(out_col, F.col(text_col))
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = pa.array([canonical(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, forms], names=[*b.schema.names, out_col])

    return kept.unionByName(df.where(~seen).mapInArrow(run, schema))


def alike(texts: DataFrame, scope_col: str, text_col: str) -> DataFrame:
    """``(scope, a, b)``: distinct texts of one scope that look the same but differ, a before b by code point.

    Repeated texts are united first, so their copies are never paired. Null texts are left out; a null scope is one scope.
    """
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(scope_col).alias("scope"), F.col(text_col).alias("text")).distinct()
    forms = canonical_texts(rows, "text")
    shared = forms.groupBy("scope", "canonical").agg(F.count("*").alias("n")).where("n > 1").select("scope", "canonical")
    x, y, s = forms.alias("x"), forms.alias("y"), shared.alias("s")
    same = lambda l, r: F.col(f"{l}.scope").eqNullSafe(F.col(f"{r}.scope")) & (F.col(f"{l}.canonical") == F.col(f"{r}.canonical"))
    return x.join(s, same("x", "s")).join(y, same("s", "y") & (F.col("x.text") < F.col("y.text"))).select(F.col("x.scope").alias("scope"), F.col("x.text").alias("a"), F.col("y.text").alias("b"))


def forms_of(texts: DataFrame, scope_col: str, text_col: str) -> DataFrame:
    """``(scope, text, canonical, n_alike)``: distinct texts of a scope with their one form and how many texts share it.

    The membership from which pairs follow; for texts that look alike in more characters than pairs are wanted of.
    """
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(scope_col).alias("scope"), F.col(text_col).alias("text")).distinct()
    forms = canonical_texts(rows, "text")
    shared = forms.groupBy("scope", "canonical").agg(F.count("*").alias("n_alike"))
    f, s = forms.alias("f"), shared.alias("s")
    return f.join(s, F.col("f.scope").eqNullSafe(F.col("s.scope")) & (F.col("f.canonical") == F.col("s.canonical"))).select("f.scope", "f.text", "f.canonical", "n_alike")


def alike_records(df: DataFrame, id_col: str, scope_col: str, text_col: str) -> DataFrame:
    """``(key_a, key_b)``: records of one scope whose texts look the same but differ, the smaller id first."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.lower(F.col(id_col)).alias("id"), F.col(scope_col).alias("scope"), F.col(text_col).alias("text")).distinct()
    pairs = alike(rows, "scope", "text").alias("p")
    x, y = rows.alias("x"), rows.alias("y")
    both = pairs.join(x, F.col("p.scope").eqNullSafe(F.col("x.scope")) & (F.col("p.a") == F.col("x.text"))).join(y, F.col("p.scope").eqNullSafe(F.col("y.scope")) & (F.col("p.b") == F.col("y.text")))
    return both.where(F.col("x.id") != F.col("y.id")).select(F.least("x.id", "y.id").alias("key_a"), F.greatest("x.id", "y.id").alias("key_b")).distinct()
