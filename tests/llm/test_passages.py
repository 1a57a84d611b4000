"""Operator 5 against brute force, and its index by itself."""

import random
import re

import numpy as np
import pytest

from tessera.llm import substring_dedup as sd

WORD = re.compile(rb"[0-9a-zA-Z\x80-\xff]+")


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcü") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [words(rng.randint(8, 40)) for _ in range(6)]
    docs = []
    for _ in range(40):
        text = words(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared)
            text += [w.upper() if rng.random() < 0.1 else w for w in piece[rng.randint(0, 3) :]] + words(rng.randint(0, 12))
        docs.append(rng.choice([" ", ", ", " -\n"]).join(text))
    docs += ["", None, "!!!", docs[0], "ab " * 200, "ab " * 150]
    return list(enumerate(docs))


def brute(docs, least):
    spans = {i: [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer((t or "").encode())] for i, t in docs}
    holders = {}
    for i, ws in spans.items():
        for k in range(len(ws) - least + 1):
            holders.setdefault(tuple(w[2] for w in ws[k : k + least]), set()).add(i)

    def covered(later):
        out = set()
        for i, ws in spans.items():
            merged = []
            for k in range(len(ws) - least + 1):
                who = holders[tuple(w[2] for w in ws[k : k + least])]
                if len(who) > 1 and (not later or min(who) != i):
                    a, b = ws[k][0], ws[k + least - 1][1]
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
            out |= {(i, a, b) for a, b in merged}
        return out

    return covered(False), covered(True)


@pytest.mark.parametrize(("seed", "least", "shard", "most"), [(1, 8, 1 << 19, 2048), (2, 12, 100, 2048), (3, 50, 1 << 19, 2048), (4, 8, 100, 1), (5, 9, 50, 3)])
def test_intervals_equal_brute_force(spark, seed, least, shard, most):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, i) for i, t in docs] + [(None, docs[0][1], 0), (0, docs[0][1], 0)], "doc_id long, text string, begin int")
    want, later = brute(docs, least)
    assert {tuple(r) for r in sd.repeated_intervals(df, least, shard, most).collect()} == want
    kept = sd.remove_repeats(df.withColumn("n_chars", df.begin.cast("long")), least, shard, most)
    assert kept.columns == ["doc_id", "text", "begin", "n_chars"]
    texts = {}
    for i, t in docs:
        data, at, parts = (t or "").encode(), 0, []
        for _, a, b in sorted(x for x in later if x[0] == i):
            parts.append(data[at:a])
            at = b
        texts[i] = None if t is None else b"".join([*parts, data[at:]]).decode()
    cut = {x[0] for x in later}
    want_kept = {i: t for i, t in texts.items() if i not in cut or WORD.search(t.encode())}
    got = kept.filter("doc_id is not null").collect()
    assert {r.doc_id: r.text for r in got} == want_kept
    assert all(r.n_chars == len(r.text) for r in got if r.doc_id in cut)
    assert kept.filter("doc_id is null").count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.repeated_intervals(df).count() == 0 and sd.remove_repeats(df).count() == 0


@pytest.mark.parametrize("least", [0, 1, 65])
def test_lengths_beyond_the_index_are_refused(spark, least):
    with pytest.raises(ValueError):
        sd.repeated_intervals(spark.createDataFrame([], "doc_id long, text string"), least)


def test_clashing_names_and_long_texts(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"w{i}" for i in range(300_000)) + " " + passage
    names = ["doc_id", "text", "__cuts", "cuts", "row", "key", "kept", "__kept", "later", "anchor", "n.chars"]
    df = spark.createDataFrame([(i, t, *"abcdefghi") for i, t in ((1, passage), (2, long), (3, passage + " tail"), (4, None), (5, ""))], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    kept = sd.remove_repeats(df)
    assert kept.columns == names
    got = {r.doc_id: tuple(r) for r in kept.collect()}
    assert {i: r[1] for i, r in got.items()} == {1: passage, 2: long[: -len(passage)], 3: " tail", 4: None, 5: ""}
    assert all(r[2:] == tuple("abcdefghi") for r in got.values())


def test_shards_are_closed_between_anchors(spark):
    seen = []
    rows = [(a, c, c, False, " ".join(f"x{a}y{i}" for i in range(40))) for a in range(60) for c in range(1 + a % 3)]
    contexts = spark.createDataFrame(rows, "anchor long, context long, doc_id long, copied boolean, text string")
    for shard in (1, 200, 1 << 18):
        got = sorted(map(tuple, sd._search(contexts, 20, shard).collect()))
        seen.append(got)
        assert {(r[0], r[1]) for r in got} == {(a, c) for a, c, *_ in rows if a % 3}
        assert all(r[4] == 0 for r in got)
    assert seen[0] == seen[1] == seen[2]


def test_next_smaller_prefixes():
    rng = np.random.default_rng(1)
    for n in (1, 70, 5000, 20_000):
        lcp = np.r_[-1, rng.integers(0, 50, n) if n < 10_000 else np.full(n, 40), -1].astype(np.int8)
        index, at = sd.Prefixes(lcp), rng.integers(1, n + 1, 200)
        value = np.maximum(0, lcp[at].astype(np.int64) - rng.integers(0, 3, 200))
        assert index.smaller(at, value, -1).tolist() == [max(j for j in range(i) if lcp[j] < v) for i, v in zip(at, value)]
        assert index.smaller(at, value, 1).tolist() == [min(j for j in range(i + 1, n + 2) if lcp[j] < v) for i, v in zip(at, value)]


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(4)
    text = np.r_[rng.integers(1, 5, 300), 0, rng.integers(1, 5, 200), 0]
    document = np.r_[np.zeros(301, np.int64), np.ones(201, np.int64)]
    index = sd.FMIndex(text, document, np.zeros(len(text), bool))
    for _ in range(60):
        n, at = int(rng.integers(1, 7)), int(rng.integers(0, 290))
        pattern = text[at : at + n]
        low, high = np.array([0]), np.array([index.n])
        for c in pattern[::-1]:
            low, high = index.step(np.array([c]), low, high)
        assert high[0] - low[0] == sum((text[i : i + n] == pattern).all() for i in range(len(text) - n + 1))


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(9)
    a, b = rng.integers(1, 3, 120), rng.integers(1, 3, 90)
    text = np.r_[a, 0, b, 0]
    index = sd.FMIndex(text, np.r_[np.zeros(121, np.int64), np.ones(91, np.int64)], np.zeros(len(text), bool))
    length, _ = sd.matching_statistics(index, text, np.array([0, 121]), np.array([120, 211]), 30)
    own = ["".join(map(str, a)), "".join(map(str, b))]
    for which, start in ((0, 0), (1, 121)):
        for i in range(len(own[which])):
            best = max(n for n in range(31) if own[which][i : i + n] in own[1 - which] and i + n <= len(own[which]))
            assert length[start + i] == best
