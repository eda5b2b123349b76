"""Look-alikes, encoding, leakage, tokens: against brute force, round trips and hand-made cases."""

import os
import random
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loamgraph.llm import encoding, leakage, lookalikes, tokens

RANKS = os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.tiktoken")
LONG = "睡眠 debt, " * 30_000


# ---- look-alikes


@pytest.mark.parametrize(
    ("a", "b"),
    [("Νugemuһа 2025", "Nugemuha 2025"), ("Ｄｅｅｐ-绘本", "Deep-绘本"), ("café", "café"), ("论⽂", "论文"), ("ﬂow", "flow"), ("a​b­", "ab"), ("a　b", "a b"), ("x‑y", "x-y"), ("e‍́", "é"), (" a ", "a"), ("⻋", "车")],
)
def test_same_looks(a, b):
    assert lookalikes.canonical(a) == lookalikes.canonical(b)


@pytest.mark.parametrize(("a", "b"), [("m²", "m2"), ("①", "1"), ("Café", "Cafe"), ("A", "a"), ("谢", "謝"), ("👩‍💻", "👩💻"), ("CO₂", "CO2")])
def test_other_looks(a, b):
    assert lookalikes.canonical(a) != lookalikes.canonical(b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aȩ́​­一ｎоΥᅡᄀᆨﬁ①² 　é각️")))
def test_splicing_equals_normalising_all(text):
    whole = unicodedata.normalize("NFC", "".join(lookalikes._folded(c) for c in text)).strip(" ")
    assert lookalikes.canonical(text) == whole
    assert lookalikes.canonical(whole) == whole


def test_stable_class_is_stable():
    import re

    for i in range(0x20, 0x10000):
        if i != 0x20 and re.match(f"[{lookalikes.STABLE_CLASS}]", chr(i)):
            assert lookalikes.stable(chr(i)), hex(i)


def test_canonical_texts_keeps_rows_and_columns(spark):
    rows = [("a", "x y", "old"), ("b", "ｘ y", "old"), ("c", None, "old"), ("d", "", "old"), ("d", "", "old"), ("e", LONG + "​", None), ("f", " lead", "old")]
    df = spark.createDataFrame(rows, "id string, name string, canonical string")
    got = lookalikes.canonical_texts(df, "name").collect()
    assert len(got) == len(rows)
    by = {r["id"]: r["canonical"] for r in got}
    assert by["a"] == by["b"] == "x y" and by["c"] is None and by["d"] == "" and by["e"] == LONG.strip() and by["f"] == "lead"
    assert lookalikes.canonical_texts(df.limit(0), "name").isEmpty()


def test_alike_against_brute_force(spark):
    rng = random.Random(3)
    forms = ["note", "nоte", "ｎote", "no​te", "Note", "plan 1", "plan 1", "plan ①", None, ""]
    rows = [(f"i{k}", rng.choice(["s", "t", None]), rng.choice(forms)) for k in range(60)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "id string, scope string, name string")
    got = sorted(map(tuple, lookalikes.alike_records(df, "id", "scope", "name").collect()))
    distinct = sorted(set(rows), key=str)
    want = sorted({tuple(sorted((x[0], y[0]))) for x in distinct for y in distinct if x[0] < y[0] and x[1] == y[1] and x[2] is not None and y[2] is not None and x[2] != y[2] and lookalikes.canonical(x[2]) == lookalikes.canonical(y[2])})
    assert got == want and want
    assert lookalikes.alike(df.limit(0), "scope", "name").isEmpty()


def test_lisu_and_coptic_letters_and_membership(spark):
    assert [lookalikes.canonical(t) for t in ("ꓮbc", "ꓝⲟⲟ", "ꓢⲥ")] == ["Abc", "Foo", "Sc"]
    df = spark.createDataFrame([(1, "Foo"), (1, "ꓝoo"), (1, "Foo"), (None, "Foo"), (2, None), (1, "")], "scope int, tag string")
    assert sorted(map(str, lookalikes.forms_of(df, "scope", "tag").collect())) == sorted(map(str, [tuple_ for tuple_ in spark.createDataFrame([(1, "Foo", "Foo", 2), (1, "ꓝoo", "Foo", 2), (None, "Foo", "Foo", 1), (1, "", "", 1)], "scope int, text string, canonical string, n_alike bigint").collect()]))


# ---- wrong encodings

SOUND = [
    "", "plain ascii & more", "naïve café, Þór, ÆØÅ", "ÀÉÎÕÜ ßÿ 4", "LIÇÃO Nº 5: SÃO 49 PÁGINAS", "«Ça ira» – Nº5 © § ¶", "√52 ≈ 5.7, 20 ºC", "犇骉淼焱，念法查了2遍", "Мешает не тишина, а ОБЗОР.", "src/\n├── lib\n└── note.md",
    "日本語のメモ 2", "수면 기록 51", "Σημείωση 9: αύριο", "l’été, l’année", "ข้อความ 7", "我今天写了“笔记”——还不错……", "Paid 12 €, she’d noted", "É», dit-il",
]
TRUE = ["It’s “just” a déjà vu", "Schöne Grüße, übrigens", "周五重新看了排期，发现和站会的关系比想象中紧。", "Сегодня проверил список дел, помогло", "Atenção à lição"]
WAYS = [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "cp850"), ("utf-8", "mac-roman"), ("utf-8", "cp1251"), ("gbk", "latin-1"), ("cp1251", "latin-1"), ("koi8-r", "cp1251")]


@pytest.mark.parametrize("text", SOUND + TRUE)
def test_sound_texts_are_left_alone(text):
    assert encoding.examine(text) == (False, text, [])


def _misread(text, true, read):
    try:
        return text.encode(true).decode(read)
    except UnicodeError:
        return None


@pytest.mark.parametrize(("true", "read"), WAYS)
def test_garbled_texts_are_restored(true, read):
    for t in TRUE:
        bad = _misread(t, true, read)
        if bad is None or bad == t or true == "gbk" and t.isascii() or true == "gbk" and not any("一" <= c <= "鿿" for c in t) or true in ("cp1251", "koi8-r") and not any("а" <= c <= "я" for c in t):
            continue
        for around in ("{}", "先把环境准备好。{}\n值得单独开一页。"):
            found, back, path = encoding.examine(around.format(bad))
            assert found and path, (true, read, bad)
            assert back == around.format(t), (true, read, back)


def test_twice_garbled_and_lost():
    twice = "Schöne Grüße".encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.examine(twice)[:2] == (True, "Schöne Grüße")
    assert encoding.examine("d�j� vu")[0]
    lost = "复盘发酵时想到，备餐缺一个明确的触发条件".encode().decode("gbk", errors="replace")
    assert encoding.examine(lost)[0]


def test_garbled_table(spark):
    bad = "Itâ€™s fine"
    rows = [(1, bad, "x"), (2, None, "x"), (3, "", None), (4, "sound", "x"), (5, bad, "x"), (6, LONG + bad, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _restored string")
    got = {r["doc_id"]: r["restored"] for r in encoding.garbled_texts(df).collect()}
    assert got == {1: "It’s fine", 5: "It’s fine", 6: LONG + "It’s fine"}
    back = {r["doc_id"]: tuple(r)[1:] for r in encoding.restored_texts(df).collect()}
    assert back[2] == (None, "x") and back[3] == ("", None) and back[1] == ("It’s fine", "x") and len(back) == 6
    assert encoding.garbled_texts(df.limit(0)).isEmpty()


@pytest.mark.parametrize(
    ("text", "written", "read"),
    [
        ("Привет мир", "cp1251", "latin-1"), ("Заметка о сне", "cp1251", "latin-1"), ("한국어 텍스트", "euc-kr", "latin-1"), ("これは日本語です", "shift-jis", "latin-1"), ("これは日本語です", "shift-jis", "cp1252"),
        ("今天的会议记录", "gbk", "latin-1"), ("lição de atenção, intenção, canção, nação", "utf-8", "latin-1"),
    ],
)
def test_short_texts_of_many_character_sets(text, written, read):
    assert encoding.examine(text.encode(written).decode(read))[:2] == (True, text)
    assert encoding.examine(text.encode(written).decode(read), restore=False)[0]


def test_text_garbled_many_times_over_and_behind_escapes():
    text = "Ein Café für Jürgen, schöne Grüße"
    for times in range(1, 8):
        bad = text
        for _ in range(times):
            bad = bad.encode("utf-8").decode("latin-1")
        assert encoding.examine(bad)[:2] == (True, text), times
    assert encoding.examine("caf&Atilde;&copy; au lait &Atilde;&nbsp; Paris")[:2] == (True, "café au lait à Paris")
    for sound in ("Tom &amp; Jerry, caf&eacute; &eacute;t&eacute;", "créée à l'été", "Việt Nam người được", "þórður ðað", "│ имя │ тип │", "a &lt; b"):
        assert encoding.examine(sound) == (False, sound, [])


def test_patience_finds_what_the_exact_search_finds():
    for bad in ("Ð£Ñ‚Ñ€Ð¾ Ð¸ Ð²ÐµÑ‡ÐµÑ€", "Schöne GrÃ¼ÃŸe", "C'est trÃ¨s bien, d'accord", "½ñÌìµÄ»áÒé¼ÇÂ¼"):
        assert encoding.search(bad) == encoding.search(bad, patience=None)


def test_detection_alone_gives_the_rows_of_the_restoration(spark):
    rows = [(1, "Schöne GrÃ¼ÃŸe aus MÃ¼nchen"), (2, "plain"), (3, None), (4, ""), (5, "d\ufffdj\ufffd vu"), (1, "Schöne GrÃ¼ÃŸe aus MÃ¼nchen"), (6, "caf&Atilde;&copy; cr&Atilde;&uml;me")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("restored", F.lit("x"))
    assert sorted(r[0] for r in encoding.garbled_ids(df).collect()) == sorted(r["doc_id"] for r in encoding.garbled_texts(df).collect()) == [1, 1, 5, 6]



# ---- leakage

ITEM = "Before the ferry crossing Wanucove balanced kiln recipes beside Bevotihu while loom patterns rusted"


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, lang string")


@pytest.mark.parametrize("broadcast_chars", [leakage.BROADCAST_CHARS, 0])
def test_leaks_against_brute_force(spark, broadcast_chars):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(12)]
    han = "钟楼学徒拆解了码头的种子袋"
    items = [(i, " ".join(rng.choices(vocab, k=14)), "en") for i in range(4)] + [(10, "".join(rng.choices(han, k=30)), "zh"), (11, None, "en"), (12, "short", "en"), (13, "", None)]
    docs = []
    for k in range(60):
        words = rng.choices(vocab, k=8)
        if k % 3 == 0:
            src = leakage.words(items[rng.randrange(4)][1])
            at, n = rng.randrange(6), rng.choice([8, 9, 10, 11])
            words += [w.upper() if rng.random() < 0.3 else w for w in src[at : at + n]] + rng.choices(vocab, k=3)
        text = rng.choice([" ", ", ", "\n"]).join(words)
        if k % 7 == 0:
            text += "！" + "，".join(items[4][1][2 : 2 + rng.choice([23, 24, 26])])
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, LONG)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")

    def has(item, doc):
        n = 24 if item[2] == "zh" else 10
        a, b = leakage.words(item[1]), leakage.words(doc[1])
        grams = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}
        return any(tuple(b[i : i + n]) in grams for i in range(len(b) - n + 1))

    want = sorted((i[0], d[0]) for i in items for d in docs if has(i, d))
    got = leakage.leaked_items(df, _items(spark, items + items[:2]), broadcast_chars=broadcast_chars)
    assert sorted(map(tuple, got.select("item_id", "doc_id").collect())) == want and want
    assert leakage.leaked_items(df.limit(0), _items(spark, items), broadcast_chars=broadcast_chars).isEmpty()
    assert leakage.leaked_items(df, _items(spark, items).limit(0), broadcast_chars=broadcast_chars).isEmpty()


@pytest.mark.parametrize("broadcast_chars", [leakage.BROADCAST_CHARS, 0])
def test_each_row_is_judged_by_its_own_text(spark, broadcast_chars):
    passage = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, passage, "en")], "item_id bigint, text string, lang string")
    rows = [(1, f"Before {passage} after", "x"), (1, "sound", "x"), (None, passage, None), (None, None, "y"), (2, f"{passage}. Before", "x"), (2, f"{passage}. Before", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _items string")
    got = sorted((str(tuple(r)) for r in leakage.without_leaks(docs, items, broadcast_chars=broadcast_chars).collect()))
    assert got == sorted(map(str, [(1, "Before  after", "x"), (1, "sound", "x"), (None, "", None), (None, None, "y"), (2, ". Before", "x"), (2, ". Before", "x")]))
    kept = leakage.without_leaks(docs, items, whole_documents=True, broadcast_chars=broadcast_chars)
    assert sorted(str(r["text"]) for r in kept.collect()) == ["None", "sound"] and kept.schema == docs.schema
    assert sorted(str(r["doc_id"]) for r in leakage.leaked_spans(docs, items, broadcast_chars=broadcast_chars).collect()) == ["1", "2", "2", "None"]


def test_leaks_are_cut_out(spark):
    docs = spark.createDataFrame([(1, f"Start. {ITEM}! End.", "z"), (2, "clean", None), (3, None, "z")], "doc_id bigint, text string, _spans string")
    items = _items(spark, [(7, ITEM, "en")])
    got = {r["doc_id"]: r["text"] for r in leakage.without_leaks(docs, items).collect()}
    assert got == {1: "Start. ! End.", 2: "clean", 3: None}
    assert sorted(r["doc_id"] for r in leakage.without_leaks(docs, items, whole_documents=True).collect()) == [2, 3]


# ---- tokens


def test_encoding_equals_the_public_encoder():
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=tokens.PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
    bpe = tokens.encoder(RANKS)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=("Cs",)), max_size=200))
    def same(text):
        ids = bpe.encode_batch([text])[0]
        assert ids == (own.encode_ordinary(text) if text else [])
        assert bpe.decode(ids) == text

    same()
    for text in (LONG, "a" * 20_000, " \n\t ", "<|endoftext|>", "▁ <unk>", "\x00\x01", "👍🏽"):
        assert bpe.encode_batch([text])[0] == own.encode_ordinary(text)


def test_encode_corpus(spark):
    docs = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", None), (1, "hello world", 5)], "doc_id bigint, text string, ids int")
    e = tokens.encode_corpus(docs, RANKS)
    got = [(r["doc_id"], r["ids"]) for r in e.orderBy("doc_id").collect()]
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert {r["text"] for r in tokens.decode_corpus(e, RANKS).collect()} == {"hello world", ""}
    assert tokens.encode_corpus(docs.limit(0), RANKS).isEmpty()
    assert e.agg(F.count("*")).head()[0] == 4
