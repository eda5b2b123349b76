"""Personal information in free text: found by type and replaced by typed placeholders.

Emails, phone and identity numbers and street addresses show their type by their shape. Names do not: which words name
people is estimated from the corpus. For every term the co-occurrence counts give the information that it carries
about a person, ``log2 P(person slot | term) / P(person slot)``, and the entropy of what shares the slot with it; a term
that discloses more than the threshold, in an open slot, is a part of names. Listed names are the seeds.

Other terms may give a person away as well: :func:`disclosing_terms` estimates from the corpus how many bits a term tells about
a protected entity that it stands beside, and :func:`generalised` takes those out that exceed the threshold of the entity's type.
A shape cannot be told by co-occurrence, since most numbers and addresses occur once; that is why those types are matched.
"""

from __future__ import annotations

import bisect
import datetime
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loamgraph.runtime import broadcast_if, cut, free_name

TYPES = ("email", "phone", "id_number", "address", "name")
#: Bits about a person from which a term counts as a part of names.
DISCLOSURE = 2.0
#: Share of a term's occurrences that lie in a person slot, at least.
IN_SLOT = 0.5
#: Share of the largest possible entropy that the other words of its slot have, at least, and bits that are enough.
OPEN, OPEN_BITS = 0.75, 4.5
#: Share of a term's next words that are given names themselves, at most; more show a word before names ("Met Robert").
SEEDS_NEXT = 0.2
#: The same for characters of Han names, whose slot (after a family character) ordinary words fill too, but each after few of them.
DISCLOSURE_HAN, OPEN_BITS_HAN = 1.0, 3.2
#: Learned words up to which all are broadcast; with more, texts are joined to them.
BROADCAST_WORDS = 200_000
#: Times that a term is seen at least.
LEAST_SEEN = 3
#: Bits about an entity from which a term beside it gives it away, by the entity's type, and the share of all that there is to tell.
REVEALING = {"email": 6.0, "phone": 6.0, "id_number": 6.0, "address": 6.0, "name": 6.0}
REVEALING_SHARE = 0.5
#: Terms on either side of an entity that are looked at.
WINDOW = 12

# Common given names, beside those listed with the data.
GIVEN = """James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Paul
Andrew Joshua Kenneth Kevin Brian George Edward Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret
Betty Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Hans Peter Wolfgang Klaus Jürgen Matthias
Stefan Andreas Ursula Monika Petra Sabine Renate Helga Jean Pierre Michel Philippe Alain Nicolas Geneviève Monique Nathalie Isabelle Sylvie
Antonio Manuel Carlos Javier Carmen Josefa Ana Dolores João Pedro Maria""".split()
# Common Chinese family names of one character.
FAMILY = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文張劉陳楊趙黃吳孫馬羅鄭謝韓馮蕭鄧許呂蘇盧蔣賈葉閻陸龍錢湯賀賴龔"
# Titles before and after a family name.
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Professor Sir Coach Herr Frau Monsieur Madame Mme Mlle M Sr Sra Srta Don Doña Señor Señora Dra Senhor Senhora".split()
TITLES_ZH = "老师|先生|女士|小姐|太太|医生|大夫|护士|教授|博士|律师|经理|主任|校长|院长|教练|师傅|同学|局长|处长|总监|部长|阿姨|叔叔|老師|醫生"
# Words that follow a given name in running text and are no family names.
PLAIN = set("""is was has had said says and or will would can could should asked wants went from with who which that this then about at in on to for of the a an as but
not did does do gets got made makes told knows et est a dit und ist hat war mit von sagt sagte der die das y e o es ha dijo que del de da do em""".split())

_UPPER, _LOWER = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
# letters of names: Latin and Cyrillic
_UP, _LOW = _UPPER + "А-ЯЁ", _LOWER + "а-яё"
_WORD = rf"[{_UP}](?:[{_UP}{_LOW}]|['’-](?=[{_UP}{_LOW}]))+"
_NO = "A-Za-zÀ-ÖØ-öø-ÿА-яЁё0-9_"
_CAP = re.compile(rf"(?<![{_NO}@.+-]){_WORD}(?![{_NO}@])")
_HAN = re.compile("[㐀-鿿]+")
_WORDS = re.compile(rf"[{_UP}{_LOW}]+(?:['’-][{_UP}{_LOW}]+)*")
_TITLE_WORDS = frozenset(t.lower() for t in TITLES)


# ---- shapes

_AT, _DOT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?|\s[Aa][Tt]\s(?=[\w-]+\s?(?:[\[(]\s?dot|\sdot\s)))", r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
_EMAIL = re.compile(rf"[A-Za-z0-9][\w.%+-]*{_AT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w-])", re.I | re.A)
# Endings of file names that look like domains.
_FILES = set("png jpg jpeg gif svg webp bmp pdf md txt py js ts css html json csv zip mp3 mp4 mov docx xlsx".split())

_ROAD_ZH = "(?:大道|大街|胡同|路|街|巷|弄|道|里弄|条|村)"
_UNIT_ZH = "(?:弄|号楼|号院|号|栋|幢|座|单元|楼|层|室|房)"
_ADDRESS = [
    re.compile(rf"(?:[㐀-鿿]{{2,8}}(?:省|自治区))?(?:[㐀-鿿]{{2,6}}(?:市|州))?(?:[㐀-鿿]{{1,6}}(?:区|县|旗|镇|乡))?[㐀-鿿]{{1,6}}{_ROAD_ZH}\s?\d+(?:-\d+)?\s?(?:弄|号楼|号院|号)(?:\s?\d+(?:-\d+)?\s?{_UNIT_ZH})*"),
    re.compile(
        rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)\s\w{{1,5}},\s)?(?<![A-Za-z0-9_.-])\d{{1,5}}[A-Za-z]?\s(?:[{_UPPER}][\w’'.-]*\s){{1,4}}(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Boulevard|Blvd|Court|Ct|Drive|Dr|Place|Pl|Terrace|Ter|Close|Crescent|Cres|Square|Sq|Parkway|Pkwy|Highway|Hwy|Gardens|Grove|Mews|Row|Hill|Way)\b\.?"
        rf"(?:,\s(?:Apt\.?|Apartment|Flat|Unit|Suite|#)\s?\w{{1,5}})?(?:,\s[{_UPPER}][\w’' -]{{1,30}},\s[A-Z]{{2}}\s\d{{4,5}}(?:-\d{{4}})?)?"
    ),
    re.compile(
        rf"(?<!\w)(?:[{_UPPER}][\wäöüß-]*(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|ufer|damm|steig|pfad|chaussee)|[{_UPPER}][\wäöüß-]*\s(?:Straße|Str\.|Weg|Allee|Gasse|Platz|Ring|Ufer|Damm)|(?:Am|Im|An\sder|An\sden|Auf\sder|Auf\sdem|Zum|Zur|In\sder|Unter\sden|Hinter\sder)\s(?!Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|Kapitel|Jahr|Tag|Abend|Punkt|Ende|Anfang|Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Zeitraum|Schnitt|Monat)[{_UPPER}][\wäöüß-]+)"
        rf"\s\d{{1,4}}(?:\s?[a-z](?!\w))?(?![\d.:]*\d)(?:,?\s(?:[A-Z]-?)?\d{{4,5}}\s[{_UPPER}][\wäöüß-]+)?"
    ),
    re.compile(
        rf"(?<![\w.-])\d{{1,4}}(?:\s?(?:bis|ter|quater|[a-d])(?!\w))?,?\s(?:[Rr]ue|[Aa]venue|[Aa]v\.|[Bb]oulevard|[Bb]d|[Ii]mpasse|[Aa]llée|[Pp]lace|[Cc]hemin|[Qq]uai|[Cc]ours|[Ss]quare|[Rr]oute|[Pp]assage|[Rr]uelle|[Ss]entier|[Ff]aubourg)\s(?:d[eu]\s|des\s|de\sla\s|de\sl[’']|d[’']|du\s|la\s|le\s|les\s)?(?:[{_UPPER}][\w’'-]*)(?:\s(?:d[eu]|des|la|le|les|l[’'])?\s?[{_UPPER}][\w’'-]*)*"
        rf"(?:,\s(?:bât|bat|apt|appt|esc|étage)\.?\s?\w{{1,4}})*(?:,\s\d{{5}}\s[{_UPPER}][\w’'-]+)?"
    ),
    re.compile(rf"(?<!\w)(?:[Cc]alle|C/|[Aa]venida|[Aa]v\.|[Aa]vda\.|[Pp]laza|[Pp]aseo|[Cc]arrera|[Cc]amino|[Rr]ua|[Tt]ravessa|[Ll]argo|[Pp]raça|[Aa]lameda)\s(?:(?:del?|de\sla|de\slos|das?|dos?)\s)?[{_UPPER}][\w’'-]*(?:\s(?:(?:del?|la|los|das?|dos?)\s)?[{_UPPER}][\w’'-]*)*,?\s(?:n\.?[ºo°]\s?)?\d{{1,4}}(?:,\s\d{{4,5}}(?:-\d{{3}})?\s[{_UPPER}][\w’'-]+)?"),
    re.compile(r"(?<!\w)(?:ул\.|улица|улице|улицу|просп\.|проспект|проспекте|пер\.|переулок|бульвар|б-р|наб\.|набережная|площадь|шоссе)\s[А-ЯЁ][\w-]*(?:\s[А-ЯЁ][\w-]*)*,?\s(?:д\.|дом)?\s?\d{1,4}\s?[а-яА-Я]?(?!\w)(?:,\s(?:корп|к|кв|стр)\.?\s?\d+)*"),
    re.compile(rf"(?<!\w)(?:Via|Viale|Piazza|Corso|Vicolo)\s(?:[a-z]{{1,5}}\s|dell[’'])*[{_UPPER}][\w’'-]*(?:\s[{_UPPER}][\w’'-]*)*,?\s(?:n\.\s?)?\d{{1,4}}(?:/[a-zA-Z])?,\s(?:\d{{5}}\s)?[{_UPPER}][\w’'-]+"),
]

_ID_WORD = r"(?:SSN|social security(?: number| no\.?)?|passport(?: number| no\.?)?|passeport|Reisepass(?:nummer)?|Ausweis(?:nummer|nr\.?)?|Personalausweis(?:nummer)?|Pass(?:nummer|nr\.)|Steuer-?ID|Steuernummer|Sozialversicherungsnummer|tax (?:ID|number|no\.?)|TIN|ITIN|NIN|national ID|ID (?:number|no\.?)|DNI|NIE|NIF|CPF|pasaporte|passaporte|carte d[’']identité|CNI|n° de sécurité sociale|numéro de sécu(?:rité sociale)?|NIR|паспорт|ИНН|СНИЛС|护照(?:号码?)?|身份证(?:号码?)?|证件号码?)"
_ID = [
    re.compile(r"(?<![\dA-Za-z])\d{6}[ -]?(?P<date>(?:18|19|20)\d{6})[ -]?\d{3}[\dXx](?![\dA-Za-z])"),
    re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<![\d.,-])(?<!\d )\d{3} \d{2} \d{4}(?!\d| \d)"),
    re.compile(rf"(?<![A-Za-z0-9_]){_ID_WORD}(?:\s?(?:n[°ºo]\.?|Nr\.?|no\.?|#|:|：|号码?|是|为))*\s?(?P<id>(?=[A-Z0-9 .-]*\d)[A-Z0-9](?:[ .-]?[A-Z0-9]){{5,20}})(?![A-Za-z0-9])", re.I),
    re.compile(r"(?<![\d.])[12] \d{2} (?:0[1-9]|1[0-2]|[2-9]\d) (?:\d{2}|2[AB]) \d{3} \d{3}(?: \d{2})?(?!\d)"),
    re.compile(r"(?<![\w-])(?:\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]-?\d{7}-?[A-Z])(?![\w-])"),
    re.compile(r"(?<![\d.-])\d{3}\.\d{3}\.\d{3}-\d{2}(?!\d)"),
]

_EXT = r"(?:\s?(?:ext|x|Durchwahl|转|分机)\.?\s?\d{1,5})?"
# Han characters stand beside numbers without a space, so only ASCII words count as neighbours
_END = r"(?![-.]?\d|[A-Za-z_])"
_START = r"(?<![A-Za-z0-9_@/#])(?<!\d[., /-])"
_PHONE = [
    re.compile(rf"(?<![A-Za-z0-9_])\(?\+\s?\d{{1,3}}\)?(?:[\s./-]?\(?\d{{1,6}}\)?(?:\s?/\s?)?){{1,6}}(?<=\d){_EXT}(?!\d)"),
    re.compile(rf"{_START}00\d{{2}}(?:[ ./-]?\d{{1,6}}){{2,6}}{_END}"),
    re.compile(rf"{_START}1[3-9]\d(?P<s>[ -]?)\d{{4}}(?P=s)\d{{4}}(?!\d)"),
    re.compile(rf"{_START}0\d{{2,3}}[- ]?\d{{7,8}}(?:-\d{{1,4}})?(?!\d)|(?<![A-Za-z0-9_])\(0\d{{2,3}}\)\s?\d{{7,8}}(?!\d)"),
    re.compile(rf"(?<![A-Za-z0-9_.-])\(\d{{3}}\)\s?\d{{3}}[-. ]\d{{4}}{_EXT}{_END}|{_START}(?:1[-. ])?[2-9]\d{{2}}(?P<t>[-. ])\d{{3}}(?P=t)\d{{4}}{_EXT}{_END}"),
    re.compile(rf"{_START}0\d(?P<u>[ .-]?)\d{{2}}(?P=u)\d{{2}}(?P=u)\d{{2}}(?P=u)\d{{2}}{_END}"),
    re.compile(rf"{_START}\(?0\d{{1,5}}\)?(?:\s?[ /-]\s?\d{{2,8}}){{1,4}}{_END}"),
    re.compile(rf"{_START}[6789]\d{{2}}(?P<v>[ ])\d{{3}}(?P=v)\d{{3}}{_END}"),
]
# Digits of a full number by country code, the code included; other numbers are taken as long as they go.
DIGITS = {"1": (11,), "7": (11,), "30": (12,), "31": (11,), "33": (11,), "34": (11,), "351": (12,), "41": (11,), "44": (12, 11), "55": (13, 12), "61": (11,), "81": (12, 11), "82": (12, 11), "86": (13, 12, 11), "91": (12,), "852": (11,), "886": (12, 11)}
_NOT_PHONE = re.compile(r"(?:ISBN|ISSN|IBAN|EAN|Host|IP|build|order|ticket|version|ratio|Bestellung|Commande|Pedido|订单|单号|编号|版本|第)[\s:：.n°º]*$", re.I)

_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20, 0x2007: 0x20, 0x2009: 0x20, 0x202F: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2012: 0x2D, 0x2013: 0x2D, 0x2212: 0x2D}


# What any number, identity or street address holds; a quick look before their patterns are tried
_LONG_NUMBER = re.compile(r"\d(?:[\s().\-/]{0,4}\d){6}")
_LETTERED = re.compile(r"\d{5}|[A-Za-z]\d|\d[A-Za-z]|\d(?:[ .-]?\d){4}")
_NUMBERED = [
    re.compile(r"[路街巷弄道条村同]\s?\d"),
    re.compile(r"\d[A-Za-z]?\s[A-ZÀ-ÖØ-Þ]"),
    re.compile(r"[\w.-]\s\d"),
    re.compile(r"\d(?:\s?[a-z]{1,6})?,?\s(?:[Rr]u|[Aa]v|[Bb]o|[Bb]d|[Ii]mp|[Aa]ll|[Pp]l|[Cc]h|[Qq]u|[Cc]o|[Ss]q|[Rr]o|[Pp]a|[Ss]e|[Ff]a)"),
    re.compile(r"[\w’'-],?\s(?:n\.?[ºo°]\s?)?\d"),
    re.compile(r"[\w.-],?\s?(?:д\.|дом)?\s?\d"),
    re.compile(r"(?:Vi|Pi|Co)\w+\s[\w’' ]+,?\s(?:n\.\s?)?\d"),
]


def _cut_number(number: str) -> int:
    """Length of the first number of a run that starts with a country code; the next number may follow after a space."""
    code = re.match(r"\D*(\d{1,3})", number)[1]
    lengths = next((DIGITS[code[:k]] for k in (3, 2, 1) if code[:k] in DIGITS), None)
    if lengths is None or "x" in number.lower():
        return len(number)
    ends, n = {}, 0
    for i, c in enumerate(number):
        n += c.isdigit()
        if c.isdigit() and (i + 1 == len(number) or not number[i + 1].isdigit()):
            ends[n] = i + 1
    return next((ends[k] for k in lengths if k in ends), len(number))


def _date(s: str) -> bool:
    try:
        datetime.date(int(s[:4]), int(s[4:6]), int(s[6:8]))
    except ValueError:
        return False
    return True


def shapes(text: str) -> tuple[list[tuple[int, int, str]], str]:
    """Spans of emails, addresses, identity and phone numbers, and the text with them blanked out, of the same length."""
    plain, found = text.translate(_WIDE), []

    def take(m: re.Match, kind: str) -> str:
        found.append((m.start(), m.end(), kind))
        return "\0" * len(m.group())

    if "@" in plain or "at" in plain.lower():
        plain = _EMAIL.sub(lambda m: m.group() if m.group().rpartition(".")[2].lower() in _FILES else take(m, "email"), plain)
    if not any(c.isdigit() for c in plain):
        return found, plain
    for may, p in zip(_NUMBERED, _ADDRESS):
        if may.search(plain):
            plain = p.sub(lambda m: take(m, "address"), plain)
    long = _LONG_NUMBER.search(plain) is not None
    for i, p in enumerate(_ID):
        if long or i == 2 and _LETTERED.search(plain) or i == 3 and ("2A" in plain or "2B" in plain):
            plain = p.sub(lambda m, i=i: take(m, "id_number") if i or _date(m["date"]) else m.group(), plain)
    if not long:
        return found, plain
    at = 0
    while m := _PHONE[0].search(plain, at):
        at = m.start() + _cut_number(m.group())
        if 7 <= sum(c.isdigit() for c in plain[m.start() : at]) <= 18:
            found.append((m.start(), at, "phone"))
            plain = plain[: m.start()] + "\0" * (at - m.start()) + plain[at:]
    for p in _PHONE[1:]:
        plain = p.sub(lambda m: m.group() if not 7 <= sum(c.isdigit() for c in m.group()) <= 18 or _NOT_PHONE.search(plain, 0, m.start()) else take(m, "phone"), plain)
    return found, plain


# ---- names


@dataclass
class Names:
    """Parts of names: given names in lower case, family names and given characters of Han names.

    more: ``(word)``, further given names, in lower case, where they are too many to hold.
    """

    given: frozenset[str]
    family: frozenset[str]
    given_han: frozenset[str]
    more: DataFrame | None = None

    def __post_init__(self):
        titles = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
        sur = rf"(?:(?:von|van|de|del|della|di|da|dos|du|le|la)\s)*{_WORD}"
        self.titled = re.compile(rf"(?<![{_NO}@])(?:(?:{titles})\.?\s)+(?P<rest>(?:{_WORD}\s)?(?:[{_UP}]\.\s)*{sur})")
        any_word = rf"[{_UP}{_LOW}](?:[{_UP}{_LOW}]|['’-](?=[{_UP}{_LOW}]))+"
        self.pair = re.compile(rf"(?<![{_NO}@.+-])(?P<g>{any_word})\s(?:(?P<i>[{_UP}{_LOW}]\.?)\s){{0,2}}(?P<s>{any_word})(?![{_NO}@])")
        self.turned = re.compile(rf"(?<![{_NO}@.+-])(?P<s>{any_word}),\s(?P<g>{any_word})(?:\s[{_UP}]\.)?(?![{_NO}@])")
        single, giv = "".join(sorted(f for f in self.family if len(f) == 1)), "".join(sorted(self.given_han))
        fam = "|".join([*sorted((f for f in self.family if len(f) > 1), key=lambda f: (-len(f), f)), *[f"[{single}]"] * bool(single)])
        self.han = re.compile(f"(?:{fam})(?:[{giv}]{{1,2}}(?:{TITLES_ZH})?|(?:{TITLES_ZH}))" if giv else f"(?:{fam})(?:{TITLES_ZH})") if fam else None

    def is_given(self, w: str, also: frozenset[str] = frozenset()) -> bool:
        return w.lower() in self.given or w.lower() in also

    def find(self, text: str, also: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
        """Spans of names in a text whose other entities are blanked out; also: further given names among its words."""
        spans: list[tuple[int, int]] = []

        def add(a: int, b: int) -> None:
            if all(b <= x or a >= y for x, y in spans):
                spans.append((a, b))

        said = set(_WORDS.findall(text.lower()))  # most texts hold no part of a name
        for m in self.titled.finditer(text) if not _TITLE_WORDS.isdisjoint(said) else ():
            add(m.start(), m.end())
        for pattern in (self.turned, self.pair) if not self.given.isdisjoint(said) or not also.isdisjoint(said) else ():
            at = 0
            while m := pattern.search(text, at):
                g, s = m["g"], m["s"]
                at = m.start() + (len(g) if pattern is self.pair else len(s))
                if not self.is_given(g, also) or self.is_given(s, also) and pattern is self.turned:
                    continue
                if s[0].islower() and (g[0].isupper() or s in PLAIN or len(s) < 4):
                    continue
                if s[0].isupper() and g[0].islower() or s[0].islower() and pattern is self.turned:
                    continue
                if s.lower() in PLAIN:
                    continue
                add(m.start(), m.end())
                at = m.end()
        if self.han is not None:
            for m in self.han.finditer(text):
                add(m.start(), m.end())
        return sorted(spans)


def learn_names(texts: DataFrame, seeds: DataFrame, text_col: str = "text") -> Names:
    """Parts of names from co-occurrence counts over all texts.

    seeds: ``(name, name_part, lang)`` with name_part 'given' or 'family'; family names count where they are Han. The counts
    are of terms and pairs of terms; listed and learned words come to the driver up to BROADCAST_WORDS each, beyond that texts are
    joined to them; characters come all.
    """
    spark = texts.sparkSession
    listed = seeds.where(F.col("name").isNotNull() & (F.col("name") != "")).select("name", "name_part").distinct()
    firsts = listed.where("name_part = 'given'").select(F.lower("name").alias("word")).unionByName(spark.createDataFrame([(n.lower(),) for n in GIVEN], "word string")).distinct()
    firsts = cut(firsts)
    n_firsts = firsts.count()
    few = n_firsts <= BROADCAST_WORDS
    given = {r["word"] for r in firsts.collect()} if few else set()
    # Han family names have one or two characters, so their number is bounded
    family = {r["name"] for r in listed.where(F.col("name").rlike("^[㐀-鿿]{1,2}$") & (F.col("name_part") == "family")).select("name").collect()} | set(FAMILY)
    counts = T.StructType([T.StructField("what", T.StringType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("n", T.LongType())])
    known = spark.sparkContext.broadcast(family)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        follows = re.compile(f"(?=({'|'.join(sorted(known.value, key=lambda f: (-len(f), f)))})(?!{TITLES_ZH})([㐀-鿿]))")

        def rows() -> pa.RecordBatch:
            keys = list(c)
            out = pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([c[k] for k in keys], pa.int64())], names=counts.names)
            c.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                last, end = None, -1
                for m in _CAP.finditer(text):
                    w = m.group()
                    between = text[end : m.start()] if last else ""
                    c["word", w, ""] += 1
                    if last and (between == " " or re.fullmatch(rf" [{_UP}]\. ", between)):
                        c["next", last, w] += 1
                    last, end = w, m.end()
                for ch in _HAN.findall(text):
                    for x in ch:
                        c["char", x, ""] += 1
                    for f, g in follows.findall(ch):
                        c["han", g, f] += 1
            if len(c) > 200_000:
                yield rows()
        if c:
            yield rows()

    table = texts.select(text_col).mapInArrow(count, counts).groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    table = cut(table)
    total = {r["what"]: (r["n"], r["k"]) for r in table.groupBy("what").agg(F.sum("n").alias("n"), F.countDistinct("b").alias("k")).collect()}
    log2 = lambda c: F.log(c) / F.log(F.lit(2.0))

    def slots(what: str, all_of: str) -> DataFrame:
        """Per term: times in the slot, entropy of the other word, times at all."""
        s = table.where(F.col("what") == what)
        n = F.sum("n")
        if what == "next":
            s = s.withColumn("word", F.lower("b")).join(broadcast_if(firsts.withColumn("seed", F.lit(True)), n_firsts), "word", "left")
        seed = F.sum(F.when(F.col("seed"), F.col("n")).otherwise(0)) if what == "next" else F.lit(0)
        e = s.groupBy("a").agg(n.alias("n"), (log2(n) - F.sum(F.col("n") * log2("n")) / n).alias("bits"), (seed / n).alias("seeds"))
        return e.where(F.col("n") >= LEAST_SEEN).join(table.where(F.col("what") == all_of).select("a", F.col("n").alias("times")), "a")

    def told(what: str, all_of: str) -> float:
        """Share of terms in the slot at all."""
        return total.get(what, (0, 0))[0] / max(1, total.get(all_of, (1, 0))[0])

    base, share = told("next", "word"), F.col("n") / F.col("times")
    words: list[str] = []
    more = None
    if base:
        # where names are so frequent that no term could disclose more, half of what one could is asked for
        least = min(DISCLOSURE, -0.5 * math.log2(min(base, 0.99)))
        open_slot = F.col("bits") >= F.least(F.lit(OPEN_BITS), OPEN * log2(F.col("n")))
        kept = slots("next", "word").where((share >= IN_SLOT) & (log2(share / F.lit(base)) >= least) & open_slot & (F.col("seeds") <= SEEDS_NEXT))
        kept = kept.where(~F.col("a").isin(TITLES) & (F.length("a") > 2)).select(F.lower("a").alias("word")).distinct()
        words = [r["word"] for r in kept.limit(BROADCAST_WORDS + 1).collect()]
        if len(words) > BROADCAST_WORDS:
            words, more = [], cut(kept)
    if not few:
        more = firsts if more is None else cut(firsts.union(more).distinct())
    given |= set(words)
    # Han: the character after a family name; the entropy is over family names, which ordinary words don't vary
    base = max(told("han", "char"), 1e-9)
    families = max(1, total.get("han", (0, 1))[1])
    open_slot = F.col("bits") >= F.least(F.lit(min(OPEN_BITS_HAN, 0.8 * math.log2(families))), OPEN * log2(F.col("n")))
    first = {r["a"] for r in slots("han", "char").where((log2(share / F.lit(base)) >= DISCLOSURE_HAN) & open_slot).select("a").collect()}
    return Names(frozenset(given), frozenset(family), frozenset(first - family), more)


def with_own_names(df: DataFrame, fields: list[str], names: Names) -> tuple[DataFrame, str]:
    """``df`` with a column of the words of ``names.more`` that the row's texts hold, and its name; joined by a hash of the texts.

    Texts of equal hash see the words of each other, which all are given names, so this changes nothing.
    """
    own, key = free_name(df, "_own"), free_name(df, "_key")
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("word", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: set[tuple[int, str]] = set()
            for k, *texts in zip(*(c.to_pylist() for c in b.columns)):
                for text in filter(None, texts):
                    for w in _WORDS.findall(shapes(text)[1].lower()):
                        at = [0, *(m.end() for m in re.finditer("['’-]", w)), len(w) + 1]  # a pattern may see a part of a word alone
                        rows |= {(k, w[x : y - 1]) for i, x in enumerate(at) for y in at[i + 1 :]}
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=schema.names)

    keyed = df.withColumn(key, F.xxhash64(*fields))
    held = keyed.select(key, *fields).mapInArrow(run, schema).join(names.more, "word").groupBy(key).agg(F.collect_set("word").alias(own))
    return keyed.join(held, key, "left").drop(key), own


def entities(text: str | None, names: Names, also: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """Spans ``(start, end, type)`` in reading order; none overlap."""
    if not text:
        return []
    found, blank = shapes(text)
    found += [(a, b, "name") for a, b in names.find(blank, also)]
    return sorted(found)


FOUND = [T.StructField("field", T.StringType()), T.StructField("pii_type", T.StringType()), T.StructField("nth", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]


def personal_entities(df: DataFrame, id_col: str, fields: list[str], names: Names) -> DataFrame:
    """``(id_col, field, pii_type, nth, start, end)`` of each piece; nth counts from 1 within record, field and type.

    Null and empty texts hold none; repeated rows come out each. Texts are read whole.
    """
    schema = T.StructType([df.schema[id_col], *FOUND])
    held = df.sparkSession.sparkContext.broadcast(replace(names, more=None))  # bounded by BROADCAST_WORDS
    df, own = with_own_names(df, fields, names) if names.more is not None else (df, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            at, rows = [], []
            also = [frozenset(w or ()) for w in b.column(1 + len(fields)).to_pylist()] if own else [frozenset()] * b.num_rows
            for k, f in enumerate(fields):
                for i, text in enumerate(b.column(1 + k).to_pylist()):
                    seen: Counter = Counter()
                    for start, end, kind in entities(text, model, also[i]):
                        seen[kind] += 1
                        at.append(i)
                        rows.append((f, kind, seen[kind], start, end))
            arrays = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *arrays], names=schema.names)

    return df.select(id_col, *fields, *([own] if own else [])).mapInArrow(run, schema)


def sanitise(text: str | None, names: Names, also: frozenset[str] = frozenset()) -> str | None:
    """The text with each piece replaced by ``[TYPE]``; null for null."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in entities(text, names, also):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def sanitised(df: DataFrame, fields: list[str], names: Names) -> DataFrame:
    """``df`` with the texts of ``fields`` sanitised; rows, order of columns and other columns as they are."""
    held = df.sparkSession.sparkContext.broadcast(replace(names, more=None))
    at, schema = {df.columns.index(f) for f in fields}, df.schema
    df, own = with_own_names(df, fields, names) if names.more is not None else (df, None)
    if own:
        df = df.select(*schema.names, own)  # the join puts its key first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            also = [frozenset(w or ()) for w in b.columns[-1].to_pylist()] if own else [frozenset()] * b.num_rows
            cols = [pa.array([sanitise(t, held.value, w) for t, w in zip(c.to_pylist(), also)], pa.string()) if i in at else c for i, c in enumerate(b.columns[: len(schema)])]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(run, schema)


# ---- terms that give an entity away

_TERM = re.compile(r"[^\W\d_]+")
_OF_WORDS = re.compile("[㐀-鿿]|[぀-ヿ]")


def _terms(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, term)``: words of three letters and more in lower case; of Han and kana, neighbouring pairs."""
    out = []
    for m in _TERM.finditer(text):
        if _OF_WORDS.search(m.group()):
            out += [(i, i + 2, text[i : i + 2]) for i in range(m.start(), m.end() - 1)]
        elif m.end() - m.start() >= 3:
            out.append((m.start(), m.end(), m.group().lower()))
    return out


def _beside(text: str, names: Names, also: frozenset[str] = frozenset()) -> tuple[list[str], list[tuple[str, str]], list[tuple[str, str, str, int, int]]]:
    """Terms of a text, its entities ``(type, spelling)``, and the terms beside each ``(term, type, spelling, start, end)``."""
    spans = entities(text, names, also)
    terms = [t for t in _terms(text) if all(t[1] <= a or t[0] >= b for a, b, _ in spans)]
    starts, near = [t[0] for t in terms], []
    for a, b, kind in spans:
        i = bisect.bisect_left(starts, a)
        near += [(t, kind, text[a:b].lower(), x, y) for x, y, t in terms[max(0, i - WINDOW) : i + WINDOW]]
    return [t for _, _, t in terms], [(kind, text[a:b].lower()) for a, b, kind in spans], near


def disclosing_terms(df: DataFrame, fields: list[str], names: Names, least: int = LEAST_SEEN, revealing: dict[str, float] = REVEALING, share: float = REVEALING_SHARE) -> DataFrame:
    """``(term, pii_type, entity, n, n_term, n_entity, bits)``: terms that tell which entity they stand beside.

    bits is the pointwise mutual information of term and entity over all texts. A term is told that was seen beside the entity
    ``least`` times, with at least the bits of the entity's type and ``share`` of the entity's own information. entity is a hash, so that the
    table gives nothing away. Null and empty texts count as no text; repeated rows count each.
    """
    held = df.sparkSession.sparkContext.broadcast(replace(names, more=None))
    df, own = with_own_names(df, fields, names) if names.more is not None else (df, None)
    schema = "what string, term string, pii_type string, entity bigint, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        c: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(c)
            out = pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))] + [pa.array([c[k] for k in keys], pa.int64())], names=["what", "term", "pii_type", "entity", "n"])
            c.clear()
            return out

        for b in batches:
            also = [frozenset(w or ()) for w in b.columns[-1].to_pylist()] if own else [frozenset()] * b.num_rows
            for k in range(len(fields)):
                for text, w in zip(b.column(k).to_pylist(), also):
                    if not text:
                        continue
                    terms, found, near = _beside(text, held.value, w)
                    code = {e: xxhash.xxh64_intdigest("\0".join(e)) - (1 << 63) for e in found}
                    c["texts", "", "", 0] += 1
                    c.update(("term", t, "", 0) for t in set(terms))
                    c.update(("entity", "", e[0], code[e]) for e in set(found))
                    c.update(("both", t, kind, code[kind, s]) for t, kind, s in {x[:3] for x in near})
            if len(c) > 200_000:
                yield rows()
        if c:
            yield rows()

    seen = cut(df.select(*fields, *([own] if own else [])).mapInArrow(run, schema).groupBy("what", "term", "pii_type", "entity").agg(F.sum("n").alias("n")))
    texts = seen.where("what = 'texts'").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    both = seen.where((F.col("what") == "both") & (F.col("n") >= least)).drop("what")
    both = both.join(seen.where("what = 'term'").select("term", F.col("n").alias("n_term")), "term").join(seen.where("what = 'entity'").select("pii_type", "entity", F.col("n").alias("n_entity")), ["pii_type", "entity"])
    bits = F.log2(F.col("n") * F.lit(float(max(1, texts))) / (F.col("n_term").cast("double") * F.col("n_entity")))
    all_of = F.log2(F.lit(float(max(1, texts))) / F.col("n_entity"))
    wanted = F.coalesce(*[F.when(F.col("pii_type") == t, v) for t, v in revealing.items()], F.lit(float("inf")))
    out = both.withColumn("bits", F.round(bits, 6)).where((F.col("bits") >= wanted) & (F.col("bits") >= share * all_of))
    return out.select("term", "pii_type", "entity", "n", "n_term", "n_entity", "bits")


def generalised(df: DataFrame, fields: list[str], names: Names, disclosing: DataFrame) -> DataFrame:
    """``df`` with the texts of ``fields`` sanitised and the terms of ``disclosing (term, entity)`` beside their entity replaced by ``[TERM]``.

    Texts are joined to the terms by what they hold, so there may be any number of them; rows, order of columns and other columns stay.
    """
    held = df.sparkSession.sparkContext.broadcast(replace(names, more=None))
    schema, key, told = df.schema, free_name(df, "_key"), free_name(df, "_told")
    df, own = with_own_names(df, fields, names) if names.more is not None else (df, None)
    extra = [own] if own else []
    keyed = df.withColumn(key, F.xxhash64(*fields))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            also = [frozenset(w or ()) for w in b.columns[-1].to_pylist()] if own else [frozenset()] * b.num_rows
            rows = set()
            for k, w, *texts in zip(b.column(0).to_pylist(), also, *(b.column(1 + i).to_pylist() for i in range(len(fields)))):
                for text in filter(None, texts):
                    rows |= {(k, t, xxhash.xxh64_intdigest(f"{kind}\0{s}") - (1 << 63)) for t, kind, s, _, _ in _beside(text, held.value, w)[2]}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=[key, "term", "entity"])

    pairs = keyed.select(key, *fields, *extra).mapInArrow(hold, f"{key} bigint, term string, entity bigint").join(disclosing.select("term", "entity").distinct(), ["term", "entity"])
    keyed = keyed.join(pairs.groupBy(key).agg(F.collect_set("term").alias(told)), key, "left").select(*schema.names, *extra, told)
    at = {schema.names.index(f) for f in fields}

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            also = [frozenset(w or ()) for w in b.column(len(schema)).to_pylist()] if own else [frozenset()] * b.num_rows
            gone = [frozenset(w or ()) for w in b.columns[-1].to_pylist()]
            cols = [pa.array([_general(t, held.value, w, g) for t, w, g in zip(c.to_pylist(), also, gone)], pa.string()) if i in at else c for i, c in enumerate(b.columns[: len(schema)])]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return keyed.mapInArrow(out, schema)


def _general(text: str | None, names: Names, also: frozenset[str], gone: frozenset[str]) -> str | None:
    if not text:
        return text
    spans = [(a, b, f"[{kind.upper()}]") for a, b, kind in entities(text, names, also)]
    for _, _, _, a, b in sorted(x for x in set(_beside(text, names, also)[2]) if x[0] in gone):
        if all(b <= x or a >= y for x, y, _ in spans):
            spans.append((a, b, "[TERM]"))
    out, last = [], 0
    for a, b, mark in sorted(spans):
        out += [text[last:a], mark]
        last = b
    return "".join(out) + text[last:]
