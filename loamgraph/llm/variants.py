"""Variant spellings of the names of people and organisations.

A spelling is cut into words; MinHash bands over the padded q-grams of its telling words (those that do not occur in many
scopes) give candidates, with as many bands as the collision curve needs. Candidates are verified by a Monge-Elkan
comparison whose word similarity knows typos, initials, abbreviations, short forms and transliteration, and the
links are clustered into stars around the best linked spelling.

A band's bucket that many spellings of a scope share (a family name, say) is not paired off. Its spellings meet by finer
keys instead: two words of each, in every form in which the comparison may still take a word for another.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loamgraph.runtime import cut

#: Length of the q-grams; similarity from which candidates are wanted, and the share of them that is to be found.
Q, CANDIDATE, RECALL = 3, 0.35, 0.99
#: Mean similarity of words from which two spellings are the same.
SAME = 0.88
#: Scopes in which a word occurs to be no telling one, and its share of all spellings; so few words are such.
COMMON_SCOPES, COMMON_SHARE = 5, 0.001
#: Spellings of a bucket that are paired off; those of larger ones meet by finer keys.
CROWD = 48
#: Hashes of a signature at most.
HASHES = 128

# Short forms of given names, by the full name.
SHORT_FORMS = {
    "alexander": "alex sascha xander sandy", "andrew": "andy drew", "anthony": "tony ant", "antonio": "toni tono", "benjamin": "ben benny", "catherine": "cathy kate cat",
    "charles": "charlie chuck", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "dolores": "lola loli", "edward": "ed eddie ted ned teddy",
    "elisabeth": "elli lisa lisbeth sissi liesl elise", "elizabeth": "liz lizzie beth betty eliza bess libby", "francisco": "paco pancho curro fran", "francois": "fanfan francky", "frederic": "fred fredo",
    "genevieve": "gen ginette viviane", "gunther": "gunni", "helene": "leni lena nelly", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hannes hans jo johann", "john": "jack johnny", "jose": "pepe pepito",
    "joseph": "joe joey jo", "jurgen": "jurg jogi", "katharina": "kathi katja kati", "katherine": "kate kathy katie kit kitty", "margaret": "maggie meg peggy madge greta", "matthias": "matze hias matti", "matthew": "matt", "michael": "mike mick mickey",
    "nicholas": "nick", "patricia": "pat patty trish tricia", "ramon": "moncho mon", "rebecca": "becky becca", "richard": "rick dick rich ricky", "robert": "rob bob bobby robbie bert", "samuel": "sam sammy", "sebastian": "basti seb bastian",
    "stephane": "steph fane", "stephen": "steve", "susan": "sue susie suzy", "susanne": "susi sanne", "thomas": "tom tommy", "victoria": "vicky vic tori", "william": "will bill billy liam willy", "amelie": "amy melie mel", "theresa": "terry tess",
    "maria": "mia mariechen", "ignacio": "nacho", "guadalupe": "lupe", "manuel": "manolo", "enrique": "quique", "rosario": "charo", "concepcion": "concha",
}
# Titles of people, and words that say the legal form or join the words of an organisation's name.
TITLES = set("dr prof professor mr mrs ms miss mx coach sir dame herr frau mme mlle monsieur madame sr sra srta don dona med phd rev lic ing".split())
TITLES_HAN = re.compile("(?:老师|先生|女士|小姐|太太|医生|大夫|教授|博士|律师|经理|主任|校长|院长|教练|师傅|同学|总监|部长|阿姨|叔叔|老師|醫生)$")
LEGAL = set("gmbh ltd limited llc inc incorporated co company corp corporation ag kg ohg ev verein eingetragener sa sarl sas srl plc bv nv lp llp pty oy ab as spa".split())
JOINING = set("the for of and de la le les des du der die das fur und et y e del para da do of".split())
# Traditional and simplified forms of characters in names.
SIMPLIFIED = dict(zip("張劉陳楊趙黃吳孫馬羅鄭謝韓馮蕭鄧許呂蘇盧蔣賈葉閻陸龍錢湯賀賴龔鍾範譚鄒顧喬萬嚴華國偉強軍蘭鳳麗嵐澤寧靜嶼箏澄霽書語輝傑俊雲夢瑩瓊慶", "张刘陈杨赵黄吴孙马罗郑谢韩冯萧邓许吕苏卢蒋贾叶阎陆龙钱汤贺赖龚钟范谭邹顾乔万严华国伟强军兰凤丽岚泽宁静屿筝澄霁书语辉杰俊云梦莹琼庆"))
# Readings of characters that are common in names.
READINGS = """wang王汪旺望 li李黎丽力立利莉理 zhang张章彰 liu刘柳 chen陈晨辰尘 yang杨阳洋扬 zhao赵昭 huang黄煌 zhou周舟州洲 wu吴武伍 xu徐许旭煦绪叙序 sun孙 hu胡湖 zhu朱祝竹 gao高 lin林琳霖临
he何贺荷禾和鹤河合 guo郭国果 ma马 luo罗洛骆落 liang梁亮良 song宋松颂 zheng郑筝正征争铮政 xie谢 han韩涵寒翰 tang唐汤棠堂糖 feng冯枫锋峰风凤丰 yu于余屿予宇雨玉语羽瑜渝钰 dong董东冬栋 xiao萧晓小笑潇
cheng程澄诚成承城橙呈 cao曹 yuan袁元源远圆 deng邓 fu傅福富 shen沈申深 zeng曾 peng彭鹏 lv吕律 su苏素 lu卢陆路鹿露璐鲁 jiang蒋姜江疆 cai蔡才 jia贾嘉佳家 ding丁定 wei魏伟维薇韦威卫 xue薛雪学 ye叶烨夜业
yan阎严颜妍言岩雁燕 pan潘盼 du杜 dai戴黛代 xia夏霞 zhong钟中忠仲 tian田天甜 ren任仁 fan范凡帆 fang方芳坊 shi石史施诗世时适 yao姚瑶遥 tan谭檀 liao廖 zou邹 xiong熊雄 jin金锦晋瑾 hao郝浩昊皓 kong孔空
bai白柏 cui崔翠 kang康 mao毛茂 qiu邱秋丘 qin秦琴沁勤 gu顾谷古 hou侯 shao邵韶 meng孟梦萌 long龙隆 wan万婉 duan段端 qian钱倩谦千 yin尹银音吟 yi易怡艺毅逸依一 chang常昌畅 qiao乔巧 lai赖 gong龚公
wen文温雯 xi汐西曦夕希溪熙茜析 zhi芷止之志智芝知 lan岚兰蓝澜览 heng珩恒衡横亨 ning宁凝柠咛 ke柯科可珂克 ge歌戈格阁哥 ji霁季纪济吉寄冀记 qing青清晴庆卿 yun云韵芸允 hua华花桦 jun军俊君钧 lei雷蕾磊 jie杰洁 min敏民 na娜
juan娟 ping平萍 hong红宏洪虹鸿 jing静京敬晶菁 mei梅美 hui辉慧惠会 ying英莹颖 bo波博 gang刚 qiang强 tao涛陶桃 jian建健剑 ting婷庭 shu书舒淑 ran然冉 xuan轩萱宣 xin欣心新鑫 zi子紫梓 mo墨默 an安 ai艾爱 qi琪齐琦奇""".split()  # fmt: skip

_READ = {c: re.match("[a-z]+", r)[0] for r in READINGS for c in r[len(re.match("[a-z]+", r)[0]) :]}
_SYLLABLES = sorted({re.match("[a-z]+", r)[0] for r in READINGS}, key=len, reverse=True)
_PINYIN = re.compile("(?:" + "|".join(_SYLLABLES) + "){1,3}$")
_FULL = {s: full for full, short in SHORT_FORMS.items() for s in short.split()}
_HAN = re.compile("^[㐀-鿿·• ]+$")


def bands(candidate: float = CANDIDATE, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows a band: the most rows with which the collision curve ``1 - (1 - s^r)^b`` still reaches the recall."""
    best = (hashes, 1)
    for r in range(1, 9):
        b = int(np.ceil(np.log(1 - recall) / np.log(1 - candidate**r)))
        if b * r <= hashes:
            best = (b, r)
    return best


@lru_cache(maxsize=100_000)
def plain(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("ł", "l"))
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


@dataclass(frozen=True)
class Name:
    """A spelling taken apart. words: in order, plain; dotted: those that end in a full stop; han: simplified, or ''."""

    words: tuple[str, ...]
    dotted: frozenset[str]
    han: str
    numbers: tuple[str, ...]
    upper: str  # the spelling itself where it may be an acronym


@lru_cache(maxsize=100_000)
def parse(name: str, kind: str) -> Name:
    s = unicodedata.normalize("NFKC", name)
    s = "".join(c for c in s if unicodedata.category(c) not in ("Cf", "Mn") or unicodedata.category(c) == "Mn").strip()
    if _HAN.match(s):
        han = "".join(SIMPLIFIED.get(c, c) for c in re.sub("[·• ]", "", s))
        if kind == "person":
            han = TITLES_HAN.sub("", han) if len(TITLES_HAN.sub("", han)) >= 2 else han
        return Name((), frozenset(), han, (), "")
    if kind == "person" and s.count(",") == 1:
        last, first = (x.strip() for x in s.split(","))
        if first and last and plain(first).strip(".") not in TITLES:
            s = f"{first} {last}"
    if kind == "organization":
        s = re.sub(r"\be\.\s?V\.?", " eV ", s)
    s = re.sub(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ])", " ", s)  # joined words
    pieces = re.findall(r"[^\W_]+(?:['’][^\W_]+)*\.?", s)
    words, dotted, numbers = [], set(), []
    for p in pieces:
        w = plain(p.rstrip("."))
        if not w:
            continue
        if w.isdigit():
            numbers.append(w.lstrip("0") or "0")
            continue
        if kind == "person" and w in TITLES and len(pieces) > 1 or kind == "organization" and (w in LEGAL or w in JOINING) and len(pieces) > 1:
            continue
        words.append(w)
        if p.endswith("."):
            dotted.add(w)
    compact = re.sub(r"[.\s]", "", s)
    return Name(tuple(words), frozenset(dotted), "", tuple(numbers), compact.lower() if 2 <= len(compact) <= 6 and compact.isupper() and compact.isascii() else "")


def romanised(han: str) -> tuple[str, str] | None:
    """Family and given name in Latin letters; null where a character's reading is not known."""
    if not 2 <= len(han) <= 4 or any(c not in _READ for c in han):
        return None
    return _READ[han[0]], "".join(_READ[c] for c in han[1:])


def acronym(n: Name) -> str:
    return "".join(w[0] for w in n.words) if len(n.words) >= 2 else ""


def keys(name: str, kind: str, common: frozenset[str]) -> tuple[list[str], list[str]]:
    """Exact keys and q-grams of a spelling."""
    n = parse(name, kind)
    exact = []
    if n.han:
        r = romanised(n.han) if kind == "person" else None
        exact.append("han:" + n.han if r is None else "read:" + "|".join(sorted(r)))
        grams = {n.han[i : i + 2] for i in range(len(n.han) - 1)} if kind == "organization" else set()
        return exact, sorted(grams)
    if kind == "person" and len(n.words) == 2 and all(_PINYIN.match(w) for w in n.words):
        exact.append("read:" + "|".join(sorted(n.words)))
    if kind == "organization":
        if n.upper:
            exact.append("acr:" + n.upper)
        elif len(n.words) >= 2:
            exact.append("acr:" + acronym(n))
            exact.append("acr:" + acronym(n)[:1] + acronym(n)[-1] + acronym(n)[1:-1])
    telling = [w for w in n.words if w not in common and len(w) > 2] or [w for w in n.words if len(w) > 2] or list(n.words)
    pad = "#" * (Q - 1)
    grams = {x[i : i + Q] for w in telling for x in (pad + w + pad,) for i in range(len(x) - Q + 1)}
    return exact, sorted(grams)


_MEANT: dict[str, set[str]] = {}
for _full, _short in SHORT_FORMS.items():
    for _w in (_full, *_short.split()):
        _MEANT.setdefault(_w, set()).add(_full)


def forms(w: str, dotted: bool, kind: str, common: frozenset[str]) -> set[tuple[str, int]]:
    """Keys of a word such that any two words that :func:`word_likeness` takes for each other share one, with the side they stand on.

    0: both sides alike; 1: an initial or abbreviation; 2: a word that one may stand for. Words one edit apart share what
    is left when a letter is dropped; two swapped letters leave the letters the same.
    """
    if kind == "person" and len(w) == 1:
        return {("p:" + w, 1), ("d:" + w, 0)}
    near = {w, _FULL.get(w, w)} if kind == "person" else {w}
    out = {("d:" + x, 0) for v in near for x in ((v, *(v[:i] + v[i + 1 :] for i in range(len(v)))) if len(v) >= 3 else (v,))}
    if len(w) >= 6:
        out.add(("s:" + "".join(sorted(w)), 0))
    if kind == "person":
        out |= {("n:" + f, 0) for f in _MEANT.get(w, ())} | {("p:" + w[0], 2)}
    if kind == "organization" or dotted:
        out.add(("p:" + w, 1))
    out |= {("p:" + w[:k], 2) for k in range(2, len(w))}
    if kind == "organization" and 2 < len(w):
        if len(w) <= 4 and not re.search("[aeiou]", w):
            out.add((f"c:{w[0]}{w[-1]}", 1))
        if w in common:
            out.add((f"c:{w[0]}{w[-1]}", 2))
    return out


def finer_keys(name: str, kind: str, common: frozenset[str]) -> set[tuple[str, int, int]]:
    """Keys ``(two words, side of the one, side of the other)`` of a spelling; the same spellings as :func:`compare` links share one.

    Every word has to have its counterpart (up to eight words), so two of them do. Spellings of one word have keys of it alone.
    """
    n = parse(name, kind)
    by_word = [sorted(forms(w, w in n.dotted, kind, common)) for w in dict.fromkeys(n.words)]
    if len(by_word) == 1:
        return {(k, s, 0) for k, s in by_word[0]} | ({("j:" + "".join(n.words), 0, 0)} if kind == "person" else set())
    out = set()
    for i in range(len(by_word)):
        for j in range(i + 1, len(by_word)):
            for x in by_word[i]:
                for y in by_word[j]:
                    (k, s), (m, t) = (x, y) if x[0] <= y[0] else (y, x)
                    out.add((f"{k}|{m}", s, t))
    if kind == "person" and n.words:
        out.add(("j:" + "".join(n.words), 0, 0))
    return out


@lru_cache(maxsize=200_000)
def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; 3 stands for more than 2."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        before, last = last, row
    return min(3, last[-1])


def _subsequence(short: str, full: str) -> bool:
    it = iter(full)
    return all(c in it for c in short)


def known(word: str, common: frozenset[str]) -> str:
    """The full given name behind a word: of a short form, or of a typo of a known one; else the word."""
    if word in _FULL:
        return _FULL[word]
    if word in common or word in SHORT_FORMS or len(word) < 5:
        return word
    return next((c for c in sorted(SHORT_FORMS) if edits(word, c) == 1), None) or next((c for c in sorted(common) if abs(len(c) - len(word)) < 2 and c[0] == word[0] and edits(word, c) == 1), word)


def word_likeness(a: str, b: str, da: bool, db: bool, common: frozenset[str], kind: str) -> tuple[float, bool]:
    """Similarity of two words, and whether it rests on an initial alone."""
    if a == b:
        return 1.0, False
    if len(a) > len(b):
        a, b, da, db = b, a, db, da
    if kind == "person":
        if len(a) == 1:
            return (0.9, True) if b[0] == a else (0.0, False)
        if len(b) > 1 and (_FULL.get(a) == b or _FULL.get(b) == a or b in SHORT_FORMS and a in SHORT_FORMS[b].split() or a in SHORT_FORMS and b in SHORT_FORMS[a].split()):
            return 0.95, False
        if a in _FULL and edits(_FULL[a], b) == 1 and b not in SHORT_FORMS:
            return 0.9, False
    if da and len(a) >= 2 and b.startswith(a):
        return 0.95, False
    if kind == "organization":
        if len(a) >= 3 and b.startswith(a) and len(b) >= len(a) + 3 and b in common:
            return 0.93, False
        if 2 < len(a) <= 4 and b in common and a[0] == b[0] and a[-1] == b[-1] and not re.search("[aeiou]", a) and _subsequence(a, b):
            return 0.93, False
    e = edits(a, b)
    if a in common and b in common:  # two names of their own
        return 0.0, False
    if e == 1 and len(b) >= 4:
        return 0.92, False
    if e == 2 and len(a) >= 6 and kind == "person" and a[0] == b[0] and sorted(a) == sorted(b):
        return 0.88, False
    return 0.0, False


def monge_elkan(x: Name, y: Name, common: frozenset[str], kind: str) -> tuple[float, bool]:
    """The lower of both directions' mean best similarity of words, each word taken once, and whether an initial decides.

    Middle initials and doubled family names beside a full match do not count.
    """
    a, b = list(x.words), list(y.words)
    if not a or not b:
        return 0.0, False
    score, weak, pairs = 0.0, False, []
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            s, w = word_likeness(p, q, p in x.dotted, q in y.dotted, common, kind)
            if s:
                pairs.append((-s, abs(i - j), i, j, w))
    used_a, used_b = set(), set()
    for s, _, i, j, w in sorted(pairs):
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            score -= s
            weak |= w
    left_a = [a[i] for i in range(len(a)) if i not in used_a]
    left_b = [b[j] for j in range(len(b)) if j not in used_b]
    if kind == "person" and len(used_a) >= 2 and not weak:
        left_a, left_b = [w for w in left_a if len(w) > 1], [w for w in left_b if len(w) > 1]
        if any(len(w) == 1 for w in a) and any(len(w) == 1 for w in b):  # two middle initials have to agree
            if {w for w in a if len(w) == 1} != {w for w in b if len(w) == 1}:
                return 0.0, False
    n = max(len(used_a) + len(left_a), len(used_b) + len(left_b))
    return score / n, weak


def compare(a: str, b: str, kind: str, common: frozenset[str], rare: dict[str, float]) -> tuple[bool, bool, str]:
    """Whether two spellings are the same, whether only by an initial or acronym, and the full given name behind it."""
    x, y = parse(a, kind), parse(b, kind)
    if x.numbers != y.numbers and (kind == "organization" or not (x.words and y.words) or len(x.words) < 2 or len(y.words) < 2):
        return False, False, ""
    if x.han and y.han:
        if x.han == y.han:
            return True, False, ""
        if kind != "person" or len(x.han) != len(y.han):
            return False, False, ""
        differ = [(p, q) for p, q in zip(x.han, y.han) if p != q]
        # a homophone typed by mistake is rare in names; two common ones are two people
        ok = len(differ) == 1 and x.han[0] == y.han[0] and _READ.get(differ[0][0], "x") == _READ.get(differ[0][1], "y") and _rare(*differ[0], rare)
        return ok, False, ""
    if x.han or y.han:
        if kind != "person":
            return False, False, ""
        r, other = (romanised(x.han), y) if x.han else (romanised(y.han), x)
        return r is not None and sorted(r) == sorted(other.words), False, ""
    if kind == "organization" and bool(x.upper) != bool(y.upper):
        up, n = (x.upper, y) if x.upper else (y.upper, x)
        got = acronym(n)
        if len(got) >= 2 and (up == got or up == got[:1] + got[-1] + got[1:-1] or sorted(up) == sorted(got) and up[0] == got[0]):
            return True, True, ""
        return False, False, ""
    if x.words and set(x.words) == set(y.words):
        return True, False, ""
    if kind == "person" and "".join(x.words) == "".join(y.words):
        return True, False, ""
    if kind == "person" and (len(x.words) < 2 or len(y.words) < 2):
        return False, False, ""
    score, weak = monge_elkan(x, y, common, kind)
    if score < SAME:
        return False, False, ""
    full = ""
    if weak:
        longer = x if sum(map(len, x.words)) >= sum(map(len, y.words)) else y
        full = next((known(w, common) for w in longer.words if len(w) > 1 and (w in common or known(w, common) != w)), "")
    return True, weak, full


def _rare(p: str, q: str, share: dict[str, float]) -> bool:
    a, b = share.get(p, 0.0), share.get(q, 0.0)
    return min(a, b) < 0.2 * max(a, b)


# ---- over tables


def spellings(df: DataFrame, id_col: str, scope_col: str, kind_col: str, name_col: str, aliases_col: str, kinds: list[str]) -> DataFrame:
    """Distinct ``(scope, kind, id, name, alias)``: every name with each of its other spellings, null where it has none."""
    some = F.filter(F.coalesce(F.col(aliases_col), F.array().cast("array<string>")), lambda a: a.isNotNull() & (F.trim(a) != ""))
    return (
        df.where(F.col(id_col).isNotNull() & F.col(kind_col).isin(kinds) & (F.trim(name_col) != ""))
        .select(F.coalesce(F.col(scope_col), F.lit("")).alias("scope"), F.col(kind_col).alias("kind"), F.lower(id_col).alias("id"), F.trim(name_col).alias("name"), F.explode_outer(some).alias("alias"))
        .select("scope", "kind", "id", "name", F.trim("alias").alias("alias"))
        .distinct()
    )


def _statistics(names: DataFrame) -> tuple[frozenset[str], dict[str, float]]:
    """Words that occur in many scopes, and the share of each Han character; both bounded by COMMON_SHARE."""
    schema = "scope string, word string, n bigint"

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for scope, kind, name in zip(*(c.to_pylist() for c in b.columns)):
                n = parse(name, kind)
                out += [(scope, w) for w in (set(n.words) if not n.han else {"1" + c for c in n.han[1:]})]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([1] * len(out), pa.int64())], names=["scope", "word", "n"])

    counted = names.select("scope", "kind", "name").mapInArrow(words, schema).groupBy("word", "scope").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("scopes"))
    counted = cut(counted)
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    many = counted.where((F.col("n") >= COMMON_SHARE * total) & ((F.col("scopes") >= COMMON_SCOPES) | F.col("word").startswith("1"))).collect()
    common = frozenset(r["word"] for r in many if r["word"][0] != "1" and len(r["word"]) > 1) | frozenset(SHORT_FORMS)
    return common, {r["word"][1:]: r["n"] / max(1, total) for r in many if r["word"][0] == "1"}


def links(names: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """``(scope, kind, a, b)``, a before b: verified pairs of distinct spellings of one scope and kind.

    names: distinct ``(scope, kind, name)``; told: pairs that are known to be the same. An initial or an acronym that fits several
    names of the scope links none; spellings of a body that are linked among themselves are one name.
    """
    spark = names.sparkSession
    common, share = _statistics(names)
    held = spark.sparkContext.broadcast((common, share))
    n_bands, rows = bands()
    rng = np.random.default_rng(3)
    mult = (rng.integers(1, 1 << 62, n_bands * rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    plus = rng.integers(0, 1 << 62, n_bands * rows, dtype=np.uint64)

    def keyed(b: pa.RecordBatch, at: list[int], key: list[int], sides: list[list[int]], columns: list[str]) -> Iterator[pa.RecordBatch]:
        """Keys with the hashes of their spelling; scope and kind are mixed into the key."""
        own = b.column(5).to_numpy()[np.array(at, dtype=np.int64)] if at else np.empty(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            mixed = (np.array(key, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ own.view(np.uint64)
        t = b.select([3, 4]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), *t.columns, *[pa.array(c, pa.int32()) for c in sides]], names=["bucket", "i", "j", *columns])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        common, _ = held.value
        for b in batches:
            at, key, side = [], [], []
            for i, (kind, name) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                exact, grams = keys(name, kind, common)
                own = {xxhash.xxh64_intdigest(e, seed=1) for e in exact}
                got = set()
                if grams:
                    h = np.array([xxhash.xxh64_intdigest(g) for g in grams], dtype=np.uint64)
                    with np.errstate(over="ignore"):
                        least = ((h[:, None] * mult + plus) >> np.uint64(16)).min(0).reshape(n_bands, rows)
                    got |= {xxhash.xxh64_intdigest(least[j].tobytes(), seed=100 + j) for j in range(n_bands)}
                at += [i] * (len(own) + len(got))
                key += [*own, *got]
                # 0 exact, 1 acronym, 2 what it may stand for, 3 a band
                side += [0 if kind != "organization" or not exact[0].startswith("acr:") else 1 if parse(name, kind).upper else 2] * len(own) + [3] * len(got)
            yield from keyed(b, at, key, [side], ["side"])

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        common, _ = held.value
        for b in batches:
            for start in range(0, b.num_rows, 100):  # some hundred keys a spelling
                part = b.slice(start, 100)
                got = [(i, *k) for i, (kind, name) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())) for k in finer_keys(name, kind, common)]
                yield from keyed(part, [g[0] for g in got], [xxhash.xxh64_intdigest(g[1], seed=2) for g in got], [[g[2] for g in got], [g[3] for g in got]], ["s", "t"])

    # buckets and spellings travel as hashes: 64 bits of scope, kind and key, 128 of scope, kind and spelling
    named = cut(names.select("scope", "kind", "name", F.xxhash64("scope", "kind", "name").alias("i"), F.xxhash64("scope", "kind", "name", F.lit(5)).alias("j"), F.xxhash64("scope", "kind").alias("own")))
    bucketed = lambda d, f, sides: d.mapInArrow(f, ", ".join(["bucket bigint, i bigint, j bigint", *[f"{c} int" for c in sides]]))
    placed = cut(bucketed(named, buckets, ["side"]))
    crowds = cut(placed.where("side = 3").groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).drop("n"))
    few, crowded = placed, None
    if not crowds.isEmpty():
        few = placed.join(crowds, "bucket", "left_anti")
        full = placed.where("side = 3").join(crowds, "bucket", "left_semi").select("i", "j").distinct()
        crowded = cut(bucketed(named.join(full, ["i", "j"], "left_semi").select(named.columns), finer, ["s", "t"]))
    other = lambda d: d.withColumnsRenamed({c: c + "2" for c in ("i", "j", "side", "s", "t")})
    apart = "(i < i2 OR i = i2 AND j < j2)"
    # an acronym meets what it may stand for, spellings with the same one do not meet each other
    near = few.join(other(few), "bucket").where(f"{apart} AND (side = side2 AND side IN (0, 3) OR side + side2 = 3 AND side IN (1, 2))").select("i", "j", "i2", "j2").distinct()
    if crowded is not None:
        near = near.unionByName(crowded.join(other(crowded), "bucket").where(f"{apart} AND (s + s2) % 3 = 0 AND (t + t2) % 3 = 0").select("i", "j", "i2", "j2")).distinct()
    x, y = named.select("i", "j", "scope", "kind", F.col("name").alias("x")), named.select(F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("scope").alias("scope2"), F.col("kind").alias("kind2"), F.col("name").alias("y"))
    near = near.join(x, ["i", "j"]).join(y, ["i2", "j2"]).where("scope = scope2 AND kind = kind2").select("scope", "kind", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, share = held.value
        for b in batches:
            got = [compare(p, q, k, common, share) for k, p, q in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            keep = [i for i, g in enumerate(got) if g[0]]
            short = []
            for i in keep:  # the spelling with the initial or the acronym
                p, q, k = b.column(2)[i].as_py(), b.column(3)[i].as_py(), b.column(1)[i].as_py()
                lp, lq = (sum(map(len, parse(s, k).words)) for s in (p, q))
                short.append((p if lp <= lq else q) if got[i][1] else None)
            t = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(short, pa.string()), pa.array([got[i][2] for i in keep], pa.string())], names=["scope", "kind", "a", "b", "short", "full"])

    same = cut(near.mapInArrow(verify, "scope string, kind string, a string, b string, short string, full string"))
    weak = same.where(F.col("short").isNotNull()).withColumn("other", F.when(F.col("a") == F.col("short"), F.col("b")).otherwise(F.col("a")))
    sure = same.where(F.col("short").isNull()).select("scope", "kind", "a", "b")
    # what an acronym may stand for: linked spellings count as the smallest of them
    bodies = weak.where("kind = 'organization'").select("scope", "kind", "short", "other")
    known = sure if told is None else sure.unionByName(told.select("scope", "kind", "a", "b"))
    beside = known.unionByName(known.select("scope", "kind", F.col("b").alias("a"), F.col("a").alias("b"))).withColumnsRenamed({"a": "other", "b": "also"})
    shared = bodies.join(beside, ["scope", "kind", "other"]).join(bodies.withColumnRenamed("other", "also"), ["scope", "kind", "short", "also"], "left_semi")
    least = shared.groupBy("scope", "kind", "short", "other").agg(F.min("also").alias("also"))
    meant = bodies.join(least, ["scope", "kind", "short", "other"], "left").select("scope", "kind", "short", F.least("other", F.coalesce("also", "other")).alias("full"))
    meant = meant.unionByName(weak.where("kind <> 'organization'").select("scope", "kind", "short", "full"))
    clear = meant.groupBy("scope", "kind", "short").agg(F.countDistinct(F.nullif("full", F.lit(""))).alias("n")).where("n <= 1").drop("n")
    return sure.unionByName(weak.join(clear, ["scope", "kind", "short"], "left_semi").select("scope", "kind", "a", "b"))


def stars(edges: DataFrame) -> DataFrame:
    """``(scope, kind, name, centre)`` by star clustering of ``edges (scope, kind, a, b)``.

    In order of the number of links, most first, then of the spelling, a spelling that has no star yet becomes a centre and takes its
    neighbours that have none. Rounds decide all at once whose better neighbours are decided.
    """
    key = ["scope", "kind"]
    both = edges.select(*key, "a", "b").unionByName(edges.select(*key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = both.groupBy(*key, "a").agg((-F.count("*")).alias("d"))
    ranked = cut(both.join(degree, [*key, "a"]).join(degree.withColumnsRenamed({"a": "b", "d": "e"}), [*key, "b"]))
    nodes = degree.select(*key, F.col("a").alias("name"), F.struct("d", F.col("a").alias("n")).alias("rank"))
    state = None  # decided so far: name, centre
    waiting = cut(nodes)
    while True:
        near = ranked.join(waiting.select(*key, F.col("name").alias("a")), [*key, "a"], "left_semi").select(*key, F.col("a").alias("name"), F.struct(F.col("e").alias("d"), F.col("b").alias("n")).alias("other"))
        if state is not None:  # satellites of other stars no longer count
            gone = state.where(F.col("name") != F.col("centre")).select(*key, F.col("name").alias("gone"))
            near = near.withColumn("gone", F.col("other.n")).join(gone, [*key, "gone"], "left_anti")
        best = near.groupBy(*key, "name").agg(F.min("other").alias("best"))
        at = waiting.join(best, [*key, "name"], "left")
        heads = at.where(F.col("best").isNull() | (F.col("rank") < F.col("best"))).select(*key, "name", F.col("name").alias("centre"))
        centres = heads if state is None else heads.unionByName(state.where(F.col("name") == F.col("centre")))
        follow = at.where(F.col("best").isNotNull() & (F.col("rank") > F.col("best"))).withColumn("to", F.col("best.n")).join(centres.select(*key, F.col("name").alias("to"), "centre"), [*key, "to"], "left")
        follow = cut(follow.select(*key, "name", "rank", "centre"))
        new = heads.unionByName(follow.where(F.col("centre").isNotNull()).select(*key, "name", "centre"))
        state = cut(new if state is None else state.unionByName(new))
        waiting = follow.where(F.col("centre").isNull()).select(*key, "name", "rank")
        if waiting.isEmpty():
            return state


def same_entities(df: DataFrame, id_col: str = "id", scope_col: str = "scope_id", kind_col: str = "kind", name_col: str = "name", aliases_col: str = "aliases", kinds: tuple[str, ...] = ("person", "organization")) -> DataFrame:
    """``(scope, kind, id, entity)``: the records of one scope and kind whose name or aliases denote one person or body.

    entity is a spelling of it. Records without a link are entities of their own and come out too. Null and empty names
    are left out, repeated rows count once, a null scope is one scope.
    """
    rows = cut(spellings(df, id_col, scope_col, kind_col, name_col, aliases_col, list(kinds)))
    key = ["scope", "kind"]
    names = rows.select(*key, "name").unionByName(rows.where(F.col("alias").isNotNull()).select(*key, F.col("alias").alias("name"))).distinct()
    told = rows.where(F.col("alias").isNotNull() & (F.col("alias") != F.col("name"))).select(*key, F.least("name", "alias").alias("a"), F.greatest("name", "alias").alias("b"))
    edges = links(names, told).unionByName(told).distinct()
    stars_ = stars(edges)
    return rows.select(*key, "id", "name").distinct().join(stars_, [*key, "name"], "left").select(*key, "id", F.coalesce("centre", "name").alias("entity"))


def pairs(entities: DataFrame) -> DataFrame:
    """``(id_a, id_b)`` of the records of one entity, the smaller id first."""
    x, y = entities.withColumnRenamed("id", "id_a"), entities.withColumnRenamed("id", "id_b")
    return x.join(y, ["scope", "kind", "entity"]).where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b").distinct()
