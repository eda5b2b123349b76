"""Text that was decoded with the wrong character encoding: finding it and getting the original back.

The texts that can be reached by encoding with one character set and decoding with another, or by unescaping, form a
graph. A best-first search walks it from the text as it stands, cheapest first, remembering the hashes of texts seen.
The cost of a text is how implausible its characters and their neighbours are; the cheapest text reached wins if
it is clearly cheaper than the original. Steps apply to the stretches of a text that the two character sets
allow, so that garbled passages inside sound text are found too.

A step changes a stretch only to a cheaper reading, or takes escapes away, so the search ends by itself, however many times a
text was garbled. It is bounded from below: what lies outside the stretches that some step may change costs what it costs, and
each step has its price, so texts that cannot lead to a cheaper one than the best so far are left out. It also ends once many texts in
a row, cheapest first, have led to none; without that patience the search is exact, but slow where wrong readings abound.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loamgraph.runtime import free_name

#: By how much the cost has to fall for a text to count as garbled.
CLEARLY = 2.0
#: Cost of a step.
STEP = 0.3
#: Characters of several bytes in a row that a stretch of Han text needs to be read anew.
STRETCH = 2
#: Letters in a row beyond ASCII that a Latin word may have, and what each further one costs.
ACCENTS, UNSPELLABLE = 3, 0.6
#: Texts in a row that lead to no cheaper one after which a search ends; None for an exact search.
PATIENCE = 3
#: Characters beside a stretch that may become a part of one after a step.
BESIDE = 3
#: Pairs of bytes that all have to lie in the Hangul rows of EUC-KR to be read as Korean rather than Chinese.
HANGUL = 6

# Character sets that UTF-8 is read as by mistake.
READ_AS = ("cp1252", "latin-1", "cp850", "cp437", "mac-roman", "cp1251", "koi8-r", "cp866", "cp1250", "cp1254")
# One-byte Cyrillic sets.
CYRILLIC = ("cp1251", "koi8-r", "cp866")
# Typographic characters that stand after a letter, before a letter, or by themselves in sound text.
CLOSING, OPENING, FREE = "’”»…–—™®©›′″", "“‘«¿¡„‚‹–—’", "•·§€£¥°ºª№×−"


@lru_cache(maxsize=1)
def _letters_of() -> dict[str, list[str | None]]:
    """Of each character set the character of each byte; where cp1252 and its kin have none, the control of that code."""
    out = {}
    for name in READ_AS:
        row = []
        for b in range(256):
            try:
                row.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                row.append(chr(b))
        out[name] = row
    return out


@lru_cache(maxsize=65536)
def kind(c: str) -> str:
    """a ASCII letter, L other Latin, C Cyrillic, c rare Cyrillic, H h r Han by rarity, q typographic, y symbol, B box,
    i phonetic sign or mark, S letter of another script with words between spaces, x broken, o other."""
    n = ord(c)
    if n < 0x80:
        return "a" if c.isalpha() else "x" if n < 32 and c not in "\t\n\r\f\v" else "s"
    if n < 0xA0 or n == 0xFFFD:
        return "x"
    if c in CLOSING or c in OPENING or c in FREE:
        return "q"
    if n < 0x250:
        return "s" if n == 0xA0 else "L" if c.isalpha() else "y"
    if 0x180 <= n < 0x2B0 and not c.isalpha() or 0x250 <= n < 0x370:
        return "i"
    if 0x400 <= n < 0x530:
        return "C" if 0x410 <= n <= 0x44F or c in "Ёё" else "c"
    if 0x2500 <= n < 0x25A0:
        return "B"
    if 0x3400 <= n < 0xA000 or n >= 0x20000 and n < 0x30000:
        try:
            # GB 2312 orders its first level, the common characters, before the second
            return "H" if c.encode("gb2312")[0] <= 0xD7 else "h"
        except UnicodeEncodeError:
            return "r"
    if unicodedata.category(c) in ("Co", "Cn", "Cs", "Cc"):
        return "x"
    if 0x370 <= n < 0x1200 and c.isalpha():
        return "S"
    return "y" if 0x2200 <= n < 0x2300 or c in "‰†‡ƒ" else "o"


ALONE = {"x": 6.0, "r": 2.0, "h": 1.0, "c": 2.0, "i": 2.0, "B": 0.9, "L": 0.1, "y": 0.3, "q": 0.1}


def _beside(a: str, b: str) -> float:
    """Cost of two neighbours of which at least one is not ASCII."""
    p, q = kind(a), kind(b)
    letter_p, letter_q = p in "aLi", q in "aLi"
    if b == "\xa0":  # what is left of many a two-byte character
        return 0.6 if p in "LC" and a.isupper() else 0.0
    if letter_p and q == "y":
        return 2.5
    if p == "y" and letter_q:
        return 2.0
    if p == "y" and q == "y":
        return 1.5
    if letter_p and q == "q":
        return 0.3 if b in CLOSING else 2.0
    if p == "q" and letter_q:
        return 0.3 if a in OPENING else 1.5
    if p in "qy" and q in "qy":
        return 1.0
    if "B" in (p, q) and (letter_p or letter_q or p in "qyCc" or q in "qyCc"):
        return 3.0
    if letter_p and "가" <= b <= "힣" or letter_q and "가" <= a <= "힣":
        return 1.0
    if letter_p and letter_q and a.islower() and b.isupper():
        return 2.0
    if (letter_p and q in "Cc") or (p in "Cc" and letter_q):
        return 2.0
    if p in "Cc" and "⺀" <= b <= "힣" and b not in "、。《》「」『』【】・" or q in "Cc" and "⺀" <= a <= "힣" and a not in "、。《》「」『』【】・":
        return 4.0
    if p == "S" and q in "aLCc" or q == "S" and p in "aLCc":
        return 2.5
    if p in "Cc" and q in "Cc":
        return 3.0 if a.islower() and b.isupper() else 0.0
    if p in "Cc" and q in "qy" and b not in CLOSING or q in "Cc" and p in "qy" and a not in OPENING:
        return 1.5
    if (p in "Hhr" and letter_q) or (letter_p and q in "Hhr"):
        return 0.5 if "L" in (p, q) else 0.3
    return 0.0


@lru_cache(maxsize=1 << 18)
def _step_cost(last: str, c: str) -> float:
    return ALONE.get(kind(c), 0.0) + _beside(last, c)


_ISLANDS = re.compile("[^\x00-\x7f]+")
_ACCENTED = re.compile("[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]{%d,}" % (ACCENTS + 1))


def cost(text: str) -> float:
    """Implausibility of a text; 0 for ASCII and ordinary letters of any script."""
    if text.isascii():
        return 0.0
    total = sum(UNSPELLABLE * (len(w) - ACCENTS) for w in _ACCENTED.findall(text))
    for m in _ISLANDS.finditer(text):
        a = m.start()
        s = text[a - 1 : m.end() + 1] if a else " " + text[: m.end() + 1]
        total += sum(map(_step_cost, s, s[1:]))
    return total


def _class(chars) -> str:
    return "[" + "".join(sorted({re.escape(c) for c in chars})) + "]"


def _bytes_of(name: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_letters_of()[name])))}


def _if_cheaper(m: re.Match, new: str) -> str:
    """The new reading of a stretch if it is cheaper between its neighbours, else the old one."""
    old, whole = m.group(), m.string
    if new == old:
        return old
    before, after = whole[max(0, m.start() - 1) : m.start()], whole[m.end() : m.end() + 1]
    return new if cost(before + new + after) < cost(before + old + after) else old


def _lone(c: str) -> bool:
    """Whether a character may stand alone in a text of other script: Latin, typographic, or of three bytes and more."""
    n = ord(c)
    return 0xA0 <= n < 0x180 or 0x2010 <= n < 0x2040 or n in (0x20AC, 0x2122) or 0x2600 <= n < 0x2800 or 0x2E80 <= n < 0xD7A4 or 0xF900 <= n < 0xFB00 or n >= 0xFE10


def _spans(pattern: re.Pattern) -> Callable[[str], list[tuple[int, int]]]:
    return lambda s: [m.span() for m in pattern.finditer(s)]


def _utf8_read_as(name: str):
    row, byte = _letters_of()[name], _bytes_of(name)
    t = _class(row[0x80:0xC0])
    one = f"{_class(row[0xC2:0xE0])}{t}|{_class(row[0xE0:0xF0])}{t}{{2}}|{_class(row[0xF0:0xF5])}{t}{{3}}"
    pattern = re.compile(f"(?:{one})+")

    def again(m: re.Match) -> str:
        try:
            new = bytes(byte[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        if len(new) == 1 and not _lone(new):
            return m.group()
        return _if_cheaper(m, new)

    leads, tails = frozenset(row[0xC2:0xF5]), frozenset(row[0x80:0xC0])
    return f"{name}>utf-8", (leads, tails), pattern, _spans(pattern), lambda s: pattern.sub(again, s)


def _pairs_read_as(name: str, true: str):
    """Characters of two bytes above ASCII: Chinese in GBK; Korean in EUC-KR, if all pairs of the text lie in its Hangul rows."""
    row, byte = _letters_of()[name], _bytes_of(name)
    high = _class(row[0x80:])
    first, second, mark = _class(row[0xB0:0xF8]), _class(row[0xA1:0xFF]), _class(row[0xA1:0xAA])
    pattern = re.compile(f"(?<!{high})(?:{first}{second}|{mark}{second}){{2,}}(?!{high})")

    def again(m: re.Match) -> str:
        try:
            return _if_cheaper(m, bytes(byte[c] for c in m.group()).decode(true))
        except UnicodeDecodeError:
            return m.group()

    def step(s: str) -> str:
        leads = [byte[c] for run in pattern.findall(s) for c in run[::2]]
        korean = len(leads) >= HANGUL and max(leads) <= 0xC8 and min(leads) >= 0xB0 and len(set(leads)) > 2  # not one lead byte of UTF-8
        return pattern.sub(again, s) if korean == (true == "euc-kr") else s

    return f"{name}>{true}", (frozenset(row[0xA1:0xF8]), frozenset(row[0xA1:0xFF])), pattern, _spans(pattern), step


def _shift_jis_read_as(name: str):
    """Japanese in Shift JIS, whose second bytes may be ASCII: runs with kana, three characters and more."""
    row, byte = _letters_of()[name], _bytes_of(name)
    one = f"{_class(row[0x81:0xA0] + row[0xE0:0xF0])}(?:[@-~]|{_class(row[0x80:0xFD])})"
    pattern = re.compile(f"(?:{one}){{3,}}")

    def again(m: re.Match) -> str:
        try:
            new = bytes(byte.get(c, ord(c) & 0x7F) for c in m.group()).decode("cp932")
        except UnicodeDecodeError:
            return m.group()
        japanese = any("\u3041" <= c <= "\u30fe" for c in new) and not any("\u0370" <= c < "\u0530" for c in new)
        return _if_cheaper(m, new) if japanese else m.group()

    return f"{name}>shift-jis", (frozenset(row[0x81:0x85]),), None, _spans(pattern), lambda s: pattern.sub(again, s)


def _cyrillic_read_as(name: str, true: str):
    """One-byte Cyrillic sets: whole clauses whose letters all lie in the upper half."""
    row, byte = _letters_of()[name], _bytes_of(name)
    high = _class([*row[0x80:0xA0], *row[0xA1:]])
    words = 1 if name == "cp1251" else 0  # a Latin word of such letters is a sign by itself
    pattern = re.compile(f"(?<!\\w){high}+(?:[ ,:;-]+{high}+|[ ]\\d+){{{words},}}(?!\\w)")
    odd = re.compile("[\u0430-\u044f][\u0410-\u042f]|[\u0400-\u040f\u0450-\u045f]") if name == "cp1251" else re.compile(f"{_class(row[0xC0:])}{{4}}")

    def again(m: re.Match) -> str:
        if not odd.search(m.group()):
            return m.group()
        return _if_cheaper(m, bytes(byte.get(c, ord(c) & 0x7F) for c in m.group()).decode(true, errors="replace"))

    return f"{name}>{true}", (frozenset(row[0xC0:]),), odd, _spans(pattern), lambda s: pattern.sub(again, s)


# UTF-8 of characters of three bytes, with ASCII between them
_STRETCH = re.compile(rb"(?:[\xe2-\xe9\xef][\x80-\xbf]{2}[\x20-\x7e]{0,6}){%d,}" % STRETCH)
_GBK_RUN = re.compile("[^\x00-\x1f\ufffd]{4,}")


def _may_be_gbk(text: str) -> bool:
    return _STRETCH.search(text.encode("gbk", errors="replace")) is not None


def _gbk_spans(text: str) -> list[tuple[int, int]]:
    data = text.encode("gbk", errors="replace")
    at = lambda n: len(data[:n].decode("gbk", errors="ignore"))
    return [(at(m.start()), at(m.end()) + 1) for m in _STRETCH.finditer(data)]


def _utf8_read_as_gbk(text: str) -> str:
    """Stretches whose bytes in GBK are UTF-8; a byte that a stretch leaves over becomes U+FFFD."""

    def again(m: re.Match) -> str:
        try:
            data = m.group().encode("gbk")
        except UnicodeEncodeError:
            return m.group()
        out, at = [], 0
        for s in _STRETCH.finditer(data):
            try:
                new = s.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [data[at : s.start()].decode("gbk", errors="replace"), new]
            at = s.end()
        return m.group() if at == 0 else _if_cheaper(m, "".join(out) + data[at:].decode("gbk", errors="replace"))

    return _GBK_RUN.sub(again, text)


@lru_cache(maxsize=1)
def steps() -> list[tuple[str, tuple[frozenset[str], ...], re.Pattern | None, Callable[[str], list[tuple[int, int]]], Callable[[str], str]]]:
    """``(name, characters of each of which it needs some, a sign among those beyond ASCII, the stretches that it may change, the step)``."""
    out = [_utf8_read_as(name) for name in READ_AS]
    out += [_pairs_read_as(name, true) for name in ("latin-1", "cp1252") for true in ("gbk", "euc-kr")]
    out += [_shift_jis_read_as("latin-1"), _shift_jis_read_as("cp1252")]
    out += [_cyrillic_read_as(a, b) for a in ("latin-1", "cp1252", "cp1251") for b in CYRILLIC if b != a]
    out.append(("gbk>utf-8", (), re.compile("[\u4e00-\u9fff]{2}"), _gbk_spans, _utf8_read_as_gbk))
    out.append(("unescape", (), None, _spans(_ESCAPE), html.unescape))
    return out


_ESCAPE = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{2,6}|#x[0-9A-Fa-f]{2,5});")


def _applicable(text: str) -> list[tuple[str, Callable[[str], str], list[tuple[int, int]]]]:
    """``(name, step, stretches)`` of the steps that may apply; most are ruled out by the characters beyond ASCII alone."""
    islands = " ".join(_ISLANDS.findall(text))
    held = set(islands)
    out = []
    for name, needs, sign, spans, step in steps():
        if any(held.isdisjoint(n) for n in needs) or sign is not None and not sign.search(islands):
            continue
        if at := spans(text):
            out.append((name, step, at))
    return out


def _fixed_cost(text: str, some: list[tuple[str, Callable[[str], str], list[tuple[int, int]]]]) -> float:
    """Cost of what no step may change."""
    total, last = 0.0, 0
    for a, b in sorted((a - BESIDE, b + BESIDE) for _, _, spans in some for a, b in spans):
        if a > last:
            total += cost(text[last:a])
        last = max(last, b)
    return total + cost(text[last:])


def search(text: str, patience: int | None = PATIENCE, enough: float | None = None) -> tuple[str, list[str], float]:
    """The cheapest text that can be reached, the steps to it, and how much cheaper it is.

    enough: the gain by a change of encoding from which it does not matter how much more there is to gain; the search ends there.
    """
    some = _applicable(text)
    if not some:
        return text, [], 0.0
    start = cost(text)
    best, best_cost, best_path = text, start, []
    seen = {hash(text)}
    queue: list[tuple[float, int, str, list[str]]] = [(start, 0, text, [])]
    idle = 0
    while queue and (patience is None or idle <= patience):
        _, _, now, path = heapq.heappop(queue)
        some = _applicable(now) if path else some
        if not some or _fixed_cost(now, some) + STEP * (len(path) + 1) >= best_cost:
            continue
        idle += 1
        for name, step, _ in some:
            new = step(now)
            if hash(new) in seen:
                continue
            seen.add(hash(new))
            own = cost(new) + STEP * (len(path) + 1)
            if own < best_cost:
                best, best_cost, best_path, idle = new, own, [*path, name], 0
                if enough is not None and start - own >= enough and any(p != "unescape" for p in best_path):
                    return best, best_path, start - own
            heapq.heappush(queue, (own, len(seen), new, [*path, name]))
    return best, best_path, start - best_cost


@lru_cache(maxsize=1)
def _at_all() -> re.Pattern:
    """Two characters with which any step on one-byte sets begins; a quick look before the steps are tried."""
    leads = {c for row in _letters_of().values() for c in row[0xC2:0xF5]}
    tails = {c for row in _letters_of().values() for c in row[0x80:0xC0]}
    latin = _class(_letters_of()["cp1252"][0x80:] + _letters_of()["latin-1"][0x80:])
    return re.compile(f"{_class(leads)}{_class(tails)}|{latin}{{4}}|[\x81-\x84\u201a\u0192\u201e][^\x00-\x3f]|[\u0430-\u044f][\u0410-\u042f]|[\u0400-\u040f\u0450-\u045f]|&[#A-Za-z]")


def examine(text: str | None, restore: bool = True) -> tuple[bool, str | None, list[str]]:
    """Whether a text is garbled, the text restored as far as can be, and the steps; without restore only the first counts.

    Unescaping alone is no sign of a wrong encoding. A replacement character is one, though it cannot be undone. What is garbled
    behind escapes is judged once they are taken away, which costs a sound text nothing.
    """
    if not text or text.isascii() and "&" not in text:
        return False, text, []
    for before, now in (([], text), (["unescape"], html.unescape(text) if "&" in text and _ESCAPE.search(text) else text)):
        if before and now == text or now.isascii():
            continue
        if _at_all().search(now) or _may_be_gbk(now):
            best, path, gain = search(now, enough=None if restore else CLEARLY)
            if gain >= CLEARLY and any(p != "unescape" for p in path):
                return True, best, before + path
    return "\ufffd" in text, text, []


RESULT = [T.StructField("garbled", T.BooleanType()), T.StructField("restored", T.StringType()), T.StructField("lossy", T.BooleanType()), T.StructField("steps", T.ArrayType(T.StringType()))]


def garbled_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, restored, lossy, steps)`` of the rows whose text is garbled, whole or in part.

    restored is the text with all garbled stretches that can be undone put right; lossy tells that some character is
    lost for good. Null and empty texts, and ASCII texts without escapes, are never garbled; repeated rows come out each. Texts are read whole.
    """
    schema = T.StructType([docs.schema[id_col], *RESULT[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts, lost, paths = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                bad, new, path = examine(t)
                if bad:
                    at.append(i)
                    texts.append(new)
                    lost.append("�" in new)
                    paths.append(path)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(texts, pa.string()), pa.array(lost, pa.bool_()), pa.array(paths, pa.list_(pa.string()))], names=schema.names)

    return _beyond_ascii(docs, id_col, text_col).mapInArrow(run, schema)


def garbled_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col)`` of the rows of :func:`garbled_texts`; a search ends as soon as it is clear that a text is one of them."""
    schema = T.StructType([docs.schema[id_col]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = [examine(t, restore=False)[0] for t in b.column(1).to_pylist()]
            yield b.select([0]).filter(pa.array(bad, pa.bool_()))

    return _beyond_ascii(docs, id_col, text_col).mapInArrow(run, schema)


def _beyond_ascii(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """ASCII texts without escapes need no look; the pattern is checked where the text is read."""
    return docs.select(id_col, text_col).where(F.col(text_col).rlike("[^\\x00-\\x7f]|&[#A-Za-z]"))


def restored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with garbled texts restored as far as can be; all other rows and columns as they are."""
    new = free_name(docs, "_restored")
    fixed = garbled_texts(docs, id_col, text_col).select(id_col, F.col("restored").alias(new)).dropDuplicates([id_col])
    return docs.join(fixed, id_col, "left").withColumn(text_col, F.coalesce(new, text_col)).select(*docs.columns)
