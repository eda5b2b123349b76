"""Vectors, clusters, co-occurrence, names and personal information: against brute force and hand-made cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.llm import clusters, cooccurrence, neighbours, personal, variants, vectors

DIM = 8


def _records(rng, groups, noise, dim=DIM):
    """Tight groups around random directions, and noise."""
    rows = []
    for g, size in enumerate(groups):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for k in range(size):
            v = centre + rng.normal(size=dim) * 0.07
            rows.append((f"g{g:02d}-{k:03d}", v * rng.uniform(0.5, 2)))
    rows += [(f"n-{k:03d}", rng.normal(size=dim)) for k in range(noise)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in rows]


def _table(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<float>")


ODD = [("Null", None), ("short", [1.0] * 5), ("zero", [0.0] * DIM), ("nan", [float("nan")] + [1.0] * (DIM - 1)), ("hole", [None] + [1.0] * (DIM - 1)), (None, [1.0] * DIM)]


def _brute(rows, k, threshold):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = np.round(x @ x.T, 6)
    near = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i and c[i, j] >= threshold), key=lambda j: (-c[i, j], ids[j]))
        near |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order[:k]}
    return near, (x @ x.T >= threshold), ids


@pytest.mark.parametrize("tile", [vectors.TILE, 16])
def test_neighbours_and_clusters_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors.tiles, "__defaults__", (tile,))
    monkeypatch.setattr(vectors.over_tiles, "__defaults__", (tile,))
    rng = np.random.default_rng(4)
    rows = _records(rng, [9, 5, 4, 3, 2], 60)
    same = [0.3, -0.2, 0.9, 0.1, 0.0, 0.4, -0.5, 0.2]
    rows += [(f"copy-{k:02d}", same) for k in range(11)]  # more copies than neighbours asked for
    want, close, ids = _brute(rows, 5, 0.9)
    df = vectors.vector_rows(_table(spark, [*rows, *rows[:7], ("G00-000", rows[0][1]), *ODD]), "id", "embedding", DIM, "k")
    index = vectors.fit(df, DIM, codes_for=0.9, cell=20)
    got = {tuple(r)[1:] for r in neighbours.pairs(neighbours.nearest(df, 5, 0.9, DIM, index)).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    members = clusters.pivot_clusters(df, 0.9, DIM, vectors.fit(df, DIM, cell=20))
    rows_ = members.collect()
    assert len(rows_) == len({r["id"] for r in rows_})
    at = {i: k for k, i in enumerate(ids)}
    found = {}
    for r in rows_:
        assert r["id"] == r["pivot"] or close[at[r["id"]], at[r["pivot"]]]
        if r["isolated"]:
            found.setdefault(r["pivot"], set()).add(r["id"])
    around = {i: frozenset(ids[j] for j in np.flatnonzero(close[k])) | {i} for i, k in at.items()}
    whole = {s for s in around.values() if len(s) > 1 and all(around[i] == s for i in s)}
    assert {frozenset(s) for s in found.values()} == whole and whole
    # a chain has no isolated cluster, but its members are still clustered
    alone = {i for i, s in around.items() if len(s) == 1}
    assert {r["id"] for r in rows_} == set(ids) - alone


def test_pivots_are_those_of_the_sequential_algorithm(spark):
    rng = np.random.default_rng(9)
    angles = np.cumsum(rng.uniform(0.1, 0.6, 40))  # a chain on a circle
    rows = [(f"v{k:02d}", [float(np.float32(np.cos(a))), float(np.float32(np.sin(a)))]) for k, a in enumerate(angles)]
    df = vectors.vector_rows(_table(spark, rows), "id", "embedding", 2, "k")
    placed = vectors.with_rank(spark.createDataFrame([(r[0],) for r in rows], "id string"))
    h = {r["id"]: r["h"] for r in placed.collect()}
    _, close, ids = _brute(rows, 1, 0.9)
    pivots, done = [], set()
    for i in sorted(ids, key=lambda i: (h[i], i)):
        k = ids.index(i)
        if not any(close[k, ids.index(p)] for p in pivots):
            pivots.append(i)
        done.add(i)
    got = {r["pivot"] for r in clusters.pivot_clusters(df, 0.9, 2).collect()}
    lonely = {i for k, i in enumerate(ids) if close[k].sum() == 1}
    assert got == set(pivots) - lonely


def test_members_move_to_the_closest_medoid(spark):
    rng = np.random.default_rng(12)
    rows = [(f"v{k:03d}", list(map(float, v.astype(np.float32)))) for k, v in enumerate(rng.normal(size=(90, 3)))]
    rows += [(f"w{k}", rows[k][1]) for k in range(5)]  # copies
    df = vectors.vector_rows(_table(spark, rows), "id", "embedding", 3, "k")
    _, close, ids = _brute(rows, 1, 0.9)
    x = np.array([v for _, v in sorted(rows)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    at = {i: k for k, i in enumerate(ids)}
    exact = vectors.fit(df, 3, cell=1000)

    def spread(rounds):
        got = {r["id"]: r["pivot"] for r in clusters.pivot_clusters(df, 0.9, 3, exact, rounds).collect()}
        assert all(i == p or close[at[i], at[p]] for i, p in got.items())
        return got, sum(float(x[at[i]] @ x[at[p]]) for i, p in got.items())

    first, before = spread(0)
    last, after = spread(4)
    assert set(first) == set(last) and after > before and set(last.values()) != set(first.values())


def test_cells_grow_beyond_the_sample_and_recall_is_measured(spark):
    rng = np.random.default_rng(7)
    rows = _records(rng, [5] * 24, 60)
    df = vectors.vector_rows(_table(spark, rows), "id", "embedding", DIM, "k")
    index = vectors.fit(df, DIM, codes_for=0.9, cell=6, sample=60, margin=0.3)  # wide, for so few dimensions
    assert index.finer is not None and len(index.centres) * len(index.finer) >= 30
    found = neighbours.nearest(df, 5, 0.9, DIM, index)
    assert vectors.recall(found, df, 5, 0.9, DIM, 100) >= 0.99
    assert vectors.recall(found.where("id < 'g04'"), df, 5, 0.9, DIM, 10_000) < 0.5
    whole = neighbours.nearest(df, 5, 0.9, DIM, index, exact=True)
    near, _, _ = _brute(rows, 5, 0.9)
    assert {tuple(r)[1:] for r in neighbours.pairs(whole).collect()} == near


def test_cells_beyond_what_may_lie_on_disk_wait_for_another_pass(spark, monkeypatch):
    rng = np.random.default_rng(7)
    df = vectors.vector_rows(_table(spark, _records(rng, [5] * 24, 60)), "id", "embedding", DIM, "k")
    index = vectors.fit(df, DIM, codes_for=0.9, cell=6, margin=0.3)
    pairs = lambda: sorted(map(tuple, neighbours.nearest(df, 5, 0.9, DIM, index).collect()))
    labels = lambda: sorted(map(tuple, clusters.pivot_clusters(df, 0.9, DIM, index, rounds=2).collect()))
    want, seen, tiles = (pairs(), labels()), [], vectors.tiles
    monkeypatch.setattr(vectors, "PASS_ROWS", 300)
    monkeypatch.setattr(vectors, "tiles", lambda *a: seen.append((t := tiles(*a)).count()) or t)
    assert (pairs(), labels()) == want
    assert len(seen) > 3 and max(seen) < sum(seen) / 2


def test_cluster_description(spark):
    rng = np.random.default_rng(2)
    rows = _records(rng, [6, 4], 0)
    df = vectors.vector_rows(_table(spark, rows), "id", "embedding", DIM, "k")
    c = spark.createDataFrame([("k", i, i[:3]) for i, _ in rows], "kind string, id string, cluster_id string")
    got = {r["cluster_id"]: r for r in clusters.describe(c, df, DIM).collect()}
    x = np.array([v for i, v in rows if i.startswith("g00")])
    x /= np.linalg.norm(x, axis=1)[:, None]
    mean = (x @ x.T).sum(1) - 1
    assert got["g00"]["size"] == 6 and got["g00"]["members"][0] == f"g00-{int(mean.argmax()):03d}" and len(got["g01"]["members"]) == 3


def test_empty_vectors(spark):
    df = vectors.vector_rows(_table(spark, ODD), "id", "embedding", DIM, "k")
    assert neighbours.nearest(df, 5, 0.8, DIM).isEmpty() and clusters.pivot_clusters(df, 0.8, DIM).isEmpty()
    assert neighbours.nearest(df.limit(0), 5, 0.8, DIM).isEmpty() and clusters.pivot_clusters(df.limit(0), 0.8, DIM).isEmpty()


def test_anisotropic_codes_keep_parallel_errors_small():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = vectors.centroids(x, 10)
    aware = vectors.fit_codes(x, c, 0.8)
    own = (x.astype(np.float32) @ c.T).argmax(1)
    r = (x - c[own]).astype(np.float32)
    xf = x.astype(np.float32)
    plain = vectors.Codes(aware.books, 1.0)
    along = lambda code: np.abs(((r - code.decode(code.encode(xf, r))) * xf).sum(1)).mean()
    assert along(aware) < 0.6 * along(plain)
    packed = vectors.Codes.packed(aware.encode(xf, r))
    q = rng.normal(size=(4, 32)).astype(np.float32)
    assert np.allclose(aware.scan(aware.tables(q), packed), q @ aware.decode(aware.encode(xf, r)).T, atol=1e-4)


# ---- co-occurrence


def test_pair_table_against_recount(spark, tmp_path):
    rng = random.Random(2)
    tags = ["a", "b", "B", "é", "", None, "hot"]

    def make(n):
        return [(f"c{k}", None if rng.random() < 0.1 else ["hot"] * (rng.random() < 0.5) + rng.choices(tags, k=rng.randrange(4))) for k in range(n)]

    first, second = make(40), make(55)
    table = lambda rows: cooccurrence.clean_baskets(spark.createDataFrame([*rows, rows[0], (None, ["a"])], "id string, tags array<string>"), "id", "tags")
    before, after = table(first), table(second)
    t = cooccurrence.PairTable(spark, "file://" + str(tmp_path / "t"), buckets=3).apply(cooccurrence.first_load(before))
    t.apply(cooccurrence.changes_between(before, after))
    sets = {k: sorted({x for x in (v or []) if x}) for k, v in second}
    n, pairs = {}, {}
    for s in sets.values():
        for i, x in enumerate(s):
            n[x] = n.get(x, 0) + 1
            for y in s[i + 1 :]:
                pairs[x, y] = pairs.get((x, y), 0) + 1
    total = sum(bool(s) for s in sets.values())
    got = {(r["a"], r["b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n_baskets"]) for r in t.scores().collect()}
    assert got == {p: (c, n[p[0]], n[p[1]], total) for p, c in pairs.items()}
    assert {(r["a"], r["b"]) for r in t.scores(3, 1.2).collect()} == {p for p, c in pairs.items() if c >= 3 and c * total >= 1.2 * n[p[0]] * n[p[1]]}
    t.apply(cooccurrence.changes_between(after, after.limit(0)))
    assert t.pairs().isEmpty() and t.items().isEmpty() and t.scores().isEmpty()


def _counts(table) -> dict:
    return {(r["a"], r["b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n_baskets"]) for r in table.scores().collect()}


def _inserts(spark, *rows):
    return cooccurrence.first_load(spark.createDataFrame(list(rows), "basket string, items array<string>"))


def test_pair_table_opened_again_keeps_its_counts(spark, tmp_path):
    path = "file://" + str(tmp_path / "t")
    cooccurrence.PairTable(spark, path).apply(_inserts(spark, ("1", ["a", "b"]), ("2", ["a", "b"])))
    again = cooccurrence.PairTable(spark, path).apply(_inserts(spark, ("3", ["a", "c"])))
    want = {("a", "b"): (2, 3, 2, 3), ("a", "c"): (1, 3, 1, 3)}
    assert _counts(again) == want and _counts(cooccurrence.PairTable(spark, path)) == want


def test_pair_of_items_that_keep_their_counts(spark, tmp_path):
    """A basket that swaps one item for another leaves the third item's count as it was, yet makes a new pair with it."""
    path = "file://" + str(tmp_path / "t")
    t = cooccurrence.PairTable(spark, path).apply(_inserts(spark, ("1", ["a", "b"]), ("2", ["c"])))
    change = spark.createDataFrame([("1", ["a", "b"], ["b", "c"]), ("2", ["c"], ["a"])], "basket string, before array<string>, after array<string>")
    assert _counts(t.apply(change)) == {("b", "c"): (1, 1, 1, 2)}


def test_pair_table_after_a_run_that_died_and_over_more_buckets(spark, tmp_path):
    path = "file://" + str(tmp_path / "t")
    t = cooccurrence.PairTable(spark, path, buckets=2, bucket_rows=2).apply(_inserts(spark, ("1", ["a", "b", "c"])))
    t._commit = lambda state: None  # dies before its manifest
    t.apply(_inserts(spark, ("2", ["a", "b", "c", "d", "e", "f"])))
    t = cooccurrence.PairTable(spark, path, buckets=2, bucket_rows=2)
    assert _counts(t) == {p: (1, 1, 1, 1) for p in [("a", "b"), ("a", "c"), ("b", "c")]}
    t.apply(_inserts(spark, ("2", ["a", "b", "c", "d", "e", "f"])))
    assert t.state["pairs"]["buckets"] > 2
    got = _counts(cooccurrence.PairTable(spark, path))
    assert len(got) == 15 and got["a", "b"] == (2, 2, 2, 2) and got["e", "f"] == (1, 1, 1, 2)


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = cooccurrence.PairTable(spark, "file://" + str(tmp_path / "t"), buckets=16).apply(_inserts(spark, *[(str(i), [f"x{i}", f"y{i}"]) for i in range(200)]))
    t.apply(_inserts(spark, ("new", ["p", "q"])))
    assert sum(v == 2 for v in t.state["pairs"]["at"].values()) == 1 and len(t.state["pairs"]["at"]) == 16


def test_pairs_of_a_large_basket_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cooccurrence, "ITEMS_A_TASK", 7)
    items = sorted(f"i{k}" for k in range(40))
    got = _counts(cooccurrence.PairTable(spark, "file://" + str(tmp_path / "t")).apply(_inserts(spark, ("1", items), ("2", items[:1]))))
    assert set(got) == {(x, y) for i, x in enumerate(items) for y in items[i + 1 :]} and got[items[0], items[1]] == (1, 2, 1, 2)


# ---- names


@pytest.mark.parametrize(
    ("a", "b", "kind", "same"),
    [
        ("Robert Vofajusi", "Rob Vofajusi", "person", True), ("Samuel Dagiguzo", "Dagiguzo, Samuel", "person", True), ("Samuel M. Dagiguzo", "Samuel Dagiguzo", "person", True), ("José Jucomuwu", "Pepe Jcuomuwu", "person", True),
        ("Hélène Gukubimu", "helene-gukubimu", "person", True), ("Anthony Cinifafe", "Cinifafe, A.", "person", True), ("Coach Robert Vofajusi", "Robert Vofajusi", "person", True), ("罗舟岚", "Luo Zhoulan", "person", True),
        ("邓芷珩", "DengZhiheng", "person", True), ("谢汐霁老师", "謝汐霁", "person", True), ("Amélie Jewuhibe", "Frédéric Jewuhibe", "person", False), ("Elizabeth Zahokuga", "Elisabeth Zahokuga", "person", False), ("张芷", "张汐", "person", False),
        ("Ravorace Travel Foundation GmbH", "Ravorace Travel Fdn", "organization", True), ("Ravorace Travel Foundation", "Travel Foundation Ravorace", "organization", True), ("JefahaneFocus Society", "Jefahane Focu. Society", "organization", True),
        ("Lifehacu Writing Institute GmbH", "LWI", "organization", True), ("The Kigicefi Society for Reading", "Kigicefi Reading Society LLC", "organization", True), ("Pazevigu Memory Academy 3", "Pazevigu Memory Academy 4", "organization", False),
        ("Pakenoja Focus Association", "Pakenoja Travel Academy", "organization", False), ("Pazevigu Memory Academy", "Pazevigu Memory Academy 3", "organization", False),
    ],
)
def test_comparison_of_spellings(a, b, kind, same):
    common = frozenset(variants.SHORT_FORMS) | {"foundation", "society", "academy", "focus", "travel", "memory", "reading", "institute", "writing"}
    assert variants.compare(a, b, kind, common, {})[0] is same and variants.compare(b, a, kind, common, {})[0] is same


_FAMILIES = [f"{a}{b}{c}" for a in ("Bora", "Cilu", "Demo", "Fuka", "Gavi") for b in ("ten", "rosh", "miw", "zel") for c in ("a", "on", "ik", "us", "er")]


def _crowd(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    syllables = [x + y for x in "bdfgklmnprstvz" for y in "aeiou"]
    return sorted({f"{''.join(rng.choices(syllables, k=3)).title()} {rng.choice(_FAMILIES)}" for _ in range(n)})


def test_finer_keys_find_what_the_comparison_links():
    """Every pair that the comparison links shares a finer key, sides agreeing."""
    common = frozenset(variants.SHORT_FORMS) | {"laboratory", "association", "reading"}
    rng = random.Random(4)
    people = _crowd(40, 1)
    spelled = {"person": ["Robert Vofajusi", "Rob Vofajusi", "R. Vofajusi", "Vofajusi, Robert", "Robrt Vofajusi", "Vofajusi Robert K.", "Anna Maria Zelik", "Annamaria Zelik", "Matias Zelik", "Matze Zelik"], "organization": ["Dutabive Reading Laboratory", "Dutabive Read. Laboratory", "Dutabive Reading Lab", "Dutabive Rdg Laboratory", "Laboratory Dutabive Reading Ltd"]}
    for name in people:
        i = rng.randrange(1, len(name) - 1)
        first, last = name.split()
        spelled["person"] += [name, name[:i] + name[i + 1 :], name[:i] + name[i + 1] + name[i] + name[i + 2 :], f"{last}, {first[0]}.", f"{first} {last[0]}. {last}"]
    n = 0
    for kind, names in spelled.items():
        keys = {x: variants.finer_keys(x, kind, common) for x in names}
        for x, y in itertools.combinations(sorted(set(names)), 2):
            if variants.compare(x, y, kind, common, {})[0]:
                n += 1
                assert any(k == m and (s + u) % 3 == 0 and (t + v) % 3 == 0 for k, s, t in keys[x] for m, u, v in keys[y]), (x, y)
    assert n > 150


def test_crowded_buckets_lose_no_link_and_grow_with_the_names(spark, monkeypatch):
    rows = [("s", "person", x) for x in _crowd(600, 2)]
    rows += [("s", "person", x[:2] + x[3:]) for _, _, x in rows[::20]]
    names = spark.createDataFrame(rows, "scope string, kind string, name string").distinct()
    found = lambda: {(r["a"], r["b"]) for r in variants.links(names).collect()}
    split = found()
    monkeypatch.setattr(variants, "CROWD", 1 << 30)
    assert split >= found() and len(split) >= 25


def test_acronym_of_a_body_with_two_spellings(spark):
    rows = [("1", "s", "organization", "Dutabive Reading Laboratory"), ("2", "s", "organization", "Dutabive Read. Laboratory"), ("3", "s", "organization", "DRL"), ("4", "t", "organization", "Kigicefi Foundation"), ("5", "t", "organization", "Kagomoto Foundation"), ("6", "t", "organization", "KF")]
    df = spark.createDataFrame(rows, "id string, scope_id string, kind string, name string").withColumn("aliases", F.lit(None).cast("array<string>"))
    assert {(r["id_a"], r["id_b"]) for r in variants.pairs(variants.same_entities(df)).collect()} == {("1", "2"), ("1", "3"), ("2", "3")}



def test_homophones_by_how_common_the_characters_are():
    share = {"宁": 0.05, "霁": 0.05, "季": 0.001, "予": 0.05, "屿": 0.05}
    assert variants.compare("冯霁禾", "冯季禾", "person", frozenset(), share)[0]
    assert not variants.compare("冯予禾", "冯屿禾", "person", frozenset(), share)[0]


def test_bands_follow_the_collision_curve():
    b, r = variants.bands(0.35, 0.99, 128)
    assert b * r <= 128 and 1 - (1 - 0.35**r) ** b >= 0.99
    assert r == max(k for k in range(1, 9) if k * int(np.ceil(np.log(0.01) / np.log(1 - 0.35**k))) <= 128)


def test_same_entities(spark):
    rows = [
        ("1", "s", "person", "Dolores Kiramowa", ["moss-1"]), ("2", "s", "person", "Lola Kiramowa", None), ("3", "s", "person", "moss-1", []), ("4", "s", "person", "Susan Kiramowa", [None, ""]), ("5", "t", "person", "Dolores Kiramowa", None),
        ("6", "s", "organization", "Dolores Kiramowa", None), ("7", "s", "concept", "Dolores Kiramowa", None), ("8", "s", "person", None, ["x"]), ("9", None, "person", "", None), ("1", "s", "person", "Dolores Kiramowa", ["moss-1"]), ("10", "s", "person", "Dolores Kiramowa", None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, scope_id string, kind string, name string, aliases array<string>, entity string")
    got = {tuple(r) for r in variants.pairs(variants.same_entities(df)).collect()}
    ids = ["1", "10", "2", "3"]
    assert got == {(min(a, b), max(a, b)) for a in ids for b in ids if a < b}
    assert variants.same_entities(df.limit(0)).isEmpty()


# ---- personal information

NAMES = personal.Names(frozenset(n.lower() for n in personal.GIVEN), frozenset(personal.FAMILY), frozenset("芷珩汐禾宁"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail a.b@post.example, c (at) mail.example.com or d [at] x [dot] org", ["email"] * 3),
        ("cover@2x.png @team Uses @app.route", []),
        ("打14000005742，旧号140-0000-4517或010-00006379停用", ["phone"] * 3),
        ("+44 7700 900150 202-555-0139 (202) 555-0175 +1-202-555-0193 ext. 59", ["phone"] * 4),
        ("（＋86）14000009604，１４０－００００－５６５０", ["phone"] * 2),
        ("编号86843219575的设备，单号624001632262546880，订单 20250313-0785，ISBN 978-0-00-924940-5, Ratio 555-369, Host 192.0.2.48, build 901242", []),
        ("992024195808198289 996063 19880721 7689 993581-19560314-408X", ["id_number"] * 3),
        ("SSN 666252487. 666 60 3768. passport no. X00147386", ["id_number"] * 3),
        ("寄到云汐市青石街 143 弄 4 号 103 室，或梧桐路12号6栋1004室", ["address"] * 2),
        ("Flat 9, 70 Old Tannery Avenue; 188 Fenwick St., Westermill, ZZ 00372", ["address"] * 2),
        ("Birkenstraße 84 und Am Mühlgraben 19; 161 bis impasse du Lavoir, 00210 Valmérac", ["address"] * 3),
        ("Chapter 12 Lane changes and 3 Road games. 会议室 3 号，二号线换乘。", []),
        ("问过谢芷禾老师和吴先生，苏宁说好。老师说明天停课。", ["name"] * 3),
        ("Met Richard CIRETUJO and Nanumore, Anthony; thomas polomamu; Prof. Carocuta; Herr Fulenuba", ["name"] * 5),
        ("Robert said that Mark is Open question", []),
        ("", []),
    ],
)
def test_personal_entities(text, want):
    found = personal.entities(text, NAMES)
    assert [k for _, _, k in found] == want
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_sanitised_text_is_unchanged_elsewhere(spark):
    long = "just notes, nothing else. " * 20_000
    rows = [("A", "write to a@post.example!", None, 1), ("b", None, "", 2), ("c", long, "call 202-555-0175", 3)]
    df = spark.createDataFrame(rows, "id string, content string, note string, field int")
    got = {r["id"]: tuple(r) for r in personal.sanitised(df, ["content", "note"], NAMES).collect()}
    assert got == {"A": ("A", "write to [EMAIL]!", None, 1), "b": ("b", None, "", 2), "c": ("c", long, "call [PHONE]", 3)}
    found = personal.personal_entities(df, "id", ["content", "note"], NAMES)
    assert sorted(tuple(r)[:4] for r in found.collect()) == [("A", "content", "email", 1), ("c", "note", "phone", 1)]
    assert personal.personal_entities(df.limit(0), "id", ["content", "note"], NAMES).isEmpty()


def test_parts_of_names_are_learned_from_their_slots(spark):
    rng = random.Random(1)
    sur = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)).capitalize() for _ in range(300)]
    texts = [f"Lunch with Quilda {rng.choice(sur)} went well. Open Question remains." for _ in range(60)] + [f"Met Robert {rng.choice(sur)} today." for _ in range(60)]
    texts += [f"约了{rng.choice('陈刘张赵吴')}{rng.choice('曦昀')}周五聊。把它放进同一张表里对照。" for _ in range(120)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    seeds = spark.createDataFrame([("Robert", "given", "en"), ("陈", "family", "zh"), (None, "given", None)], "name string, name_part string, lang string")
    names = personal.learn_names(df, seeds)
    assert "quilda" in names.given and "robert" in names.given and not {"open", "met", "lunch"} & names.given
    assert {"曦", "昀"} <= names.given_han and "表" not in names.given_han
    assert personal.learn_names(df.limit(0), seeds.limit(0)).given_han == frozenset()


def test_no_localcheckpoint_anywhere():
    import pathlib

    import loamgraph

    for p in pathlib.Path(loamgraph.__file__).parent.rglob("*.py"):
        assert "localCheckpoint" not in p.read_text()
    assert F is not None
