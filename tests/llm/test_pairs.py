"""Operator 2 and the near-copy stage against brute force."""

import random
import re

import duckdb
import pytest

from tessera.llm import ngram_join as nj
from tessera.llm import queries

WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def grams(text, n):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéf") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    docs = []
    for family in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            docs.append(rng.choice([" ", ", ", "\n"]).join(text))
    docs += ["", "a", "A!", "a b", "a b", "x " * 500 + "y", None, "...", docs[0], docs[0].upper()]
    return list(enumerate(docs))


def brute(docs, n, threshold):
    sets = {i: frozenset(grams(t, n)) for i, t in docs if t and grams(t, n)}
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    pairs = {(rep[s], i): 1.0 for i, s in sets.items() if rep[s] != i}
    names = sorted(rep.values())
    for x, a in enumerate(names):
        for b in names[x + 1 :]:
            both = len(sets[a] & sets[b])
            j = both / (len(sets[a]) + len(sets[b]) - both)
            if j >= threshold - 1e-9:
                pairs[a, b] = j
    return pairs


@pytest.mark.parametrize(("n", "threshold", "block"), [(3, 0.55, 1024), (2, 0.3, 2), (1, 0.8, 1)])
def test_pairs_equal_brute_force(spark, n, threshold, block):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs] + [(None, "a b c", "x")], "doc_id long, text string, home string")
    got = {(r.id_a, r.id_b): r.jaccard for r in nj.similar_pairs(df, n, threshold, block).collect()}
    want = brute(docs, n, threshold)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_one_of_each_group_stays(spark):
    docs = corpus(5)
    df = spark.createDataFrame([(i, t, i) for i, t in docs] + [(None, "q", 1), (0, docs[0][1], 7)], "doc_id long, text string, n int")
    kept = nj.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(docs, nj.N, nj.THRESHOLD):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({find(i) for i, _ in docs})
    assert sum(r.doc_id is None for r in got) == 1


def test_clashing_names_copies_and_long_texts(spark):
    names = ["doc_id", "text", "number", "row", "mark", "id", "home", "to", "__number", "a.b"]
    long = " ".join(f"w{i}" for i in range(200_000))
    texts = [(1, long), (2, long + " end"), (3, "p q r s"), *((i, "one two three four") for i in range(10, 40)), (3, "p q r s"), (4, None), (None, "p q r s"), (5, "")]
    df = spark.createDataFrame([(i, t, *"abcdefgh") for i, t in texts], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    kept = nj.keep_one(df, block=2)
    assert kept.columns == names
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 10), (True, 0)]


@pytest.mark.parametrize("forest", [True, False])
def test_a_hot_group_is_opened_in_bounded_blocks(spark, forest, tmp_path):
    docs = [(i, " ".join(f"c{k}" for k in range(60)) + f" u{i}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    near, copies, sets = nj._near(df, 3, 0.55, 4, forest)
    pairs = {(r.id_a, r.id_b) for r in near.collect()}
    root = {i: i for i, _ in docs}
    for a, b in sorted(pairs):
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {k: new if v == old else v for k, v in root.items()}
    assert set(root.values()) == {0} and copies.isEmpty() and sets.count() == 60
    assert forest or len(pairs) == 60 * 59 // 2


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_filter_keeps_all_wanted_rows(spark, bits):
    texts, wanted = spark.range(-500, 500).selectExpr("id doc_id", "array('x') texts"), spark.range(-20, 20, 3).withColumnRenamed("id", "doc_id")
    left = nj.only_of(texts, wanted, bits)
    assert left.columns == texts.columns and left.join(wanted, "doc_id").count() == wanted.count()
    assert left.count() <= (1000 if bits == 64 else 100)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.similar_pairs(df).count() == 0 and nj.keep_one(df).count() == 0


def test_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "id_a long, id_b long")
    got = {r.doc_id: r.root for r in nj.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_repeated_ids_with_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " " + b), (3, b), (4, c), (5, c + " end"), (6, a), (6, a.upper()), (6, None), (7, "q"), (7, c)]
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = sorted((*r[:2], round(r[2], 6), *r[3:]) for r in con.sql(queries.OP2_SQL).fetchall())
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
        assert sorted((r.id_a, r.id_b, round(r.jaccard, 6), r.copies_a, r.copies_b) for r in nj.similar_pairs(df).collect()) == want
        kept = nj.keep_one(df)
        assert kept.columns == df.columns
        got = sorted(map(tuple, kept.collect()), key=repr)
        assert got == sorted([(1, a), (1, b), (2, a + " " + b), (4, c), (6, None), (7, "q")], key=repr)


def test_a_large_family_meets_in_few_groups(spark, monkeypatch):
    rng, tables, kept = random.Random(9), {}, nj.stored
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(240):
        text = list(base)
        for k in rng.sample(range(150), 5):
            text[k] = f"u{i}x{k}"
        docs.append((i, " ".join(text)))
    monkeypatch.setattr(nj, "stored", lambda df, name: tables.setdefault(name, kept(df, name)))
    got = {(r.id_a, r.id_b): r.jaccard for r in nj.similar_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute(docs, nj.N, nj.THRESHOLD)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert tables["pairs"].count() < 240  # pairs of groups that must be compared; 351 when each text kept its own smallest hash


def test_classes_and_links_are_those_of_all_pairs(spark):
    docs = corpus(11) + [(100 + i, " ".join(f"c{k}" for k in range(60)) + f" u{i % 40}") for i in range(50)]
    df = spark.createDataFrame([*docs, (None, "a b c")], "doc_id long, text string")
    rows = nj.classes(df, 3, 0.55, 8).collect()
    assert len(rows) == len(docs)  # one row per document, however many pairs there are
    sets = {i: frozenset(grams(t, 3)) if t else frozenset() for i, t in docs}
    linked = {i: {j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.55 * len(sets[i] | sets[j]) - 1e-9} for i in sets}
    root = {}
    for i in sorted(sets):
        new = {i} if i not in root else set()
        while new:
            root |= dict.fromkeys(new, i)
            new = {j for x in new for j in linked[x]} - root.keys()
    assert {r.doc_id: (r.class_id, r.links) for r in rows} == {i: (root[i], len(linked[i])) for i in sets}


def test_classes_of_odd_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "q"), (3, "q")], "doc_id int, text string")
    assert sorted(map(tuple, nj.classes(df).collect())) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]
    assert nj.classes(df.limit(0)).count() == 0
