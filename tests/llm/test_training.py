"""Operators 3, 4, 6, 7 and 10."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import _words, ann, best_fit, chat_format, mixing, queries, token_ids, toxicity
from tessera.llm._bpe import ids_of

DATA = "/root/testdata/sf0.001"


def plain_best_fit(lengths, capacity):
    bins, rest = [], []
    for i, n in enumerate(lengths):
        bins += [0] * (n // capacity)
        if n % capacity:
            rest.append((-(n % capacity), i, n // capacity * capacity))
    out = {}
    for minus, i, begin in sorted(rest):
        fits = [(left, b) for b, left in enumerate(bins) if left >= -minus]
        if fits:
            left, b = min(fits)
        else:
            b, left = len(bins), capacity
            bins.append(capacity)
        out[i, begin] = (b, capacity - left)
        bins[b] = left + minus
    return out, len(bins)


@pytest.mark.parametrize(("capacity", "seed"), [(1, 0), (2, 1), (10, 2), (64, 3), (100, 4), (2048, 5)])
def test_packing_equals_plain_best_fit(capacity, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, 3 * capacity), capacity]) for _ in range(300)]
    got = best_fit.pack(lengths, capacity)
    want, bins = plain_best_fit(lengths, capacity)
    assert {(i, b): (n, at) for i, b, size, n, at in got if size < capacity or (i, b) in want} == want
    assert len({p[3] for p in got}) == bins
    assert [sum(p[2] for p in got if p[0] == i) for i in range(300)] == lengths


def test_packed_bins_hold_every_token_once(spark):
    docs = [(i, "x" * random.Random(i).randint(0, 30_000), 1) for i in range(60)] + [(None, "abc", 1), (3, None, 1), (4, "y", 1), (4, "y", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, bin int")
    rows = best_fit.packed(df, 1000, 16).collect()
    assert sum(r.piece_tokens for r in rows) == sum(-(-len(t.encode()) // 4) for _, t, _ in docs if t)
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append((r.bin_offset, r.piece_tokens))
    for pieces in bins.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0 and sum(n for _, n in pieces) <= 1000
    assert best_fit.packed(df.limit(0)).count() == 0


def labelled(n, seed, bad):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abdeghlnorstu") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(max(1, len(words) // 50)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        out.append((i, " ".join(words), int(toxic)))
    return out


BAD = ["scoundrel", "wretchedness", "blackguard", "villainous"]


def test_toxicity_on_held_out_and_misspelt_documents(spark):
    rows = labelled(900, 1, BAD)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int")
    other = [(i + 10_000, t, y) for i, t, y in labelled(300, 1, ["scoundrell", "wretchednes", "blakguard", "villainouss"])]
    fresh = [(i + 20_000, t, y) for i, t, y in labelled(300, 1, BAD)]
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows + other + fresh] + [(None, "fine words", 0), (7_000_000, None, 0), (7_000_001, "", 0)], "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    truth = {i: y for i, _, y in other}
    caught = np.mean([got[i].toxic for i, y in truth.items() if y])
    wrong = np.mean([got[i].toxic for i, y in truth.items() if not y])
    assert caught > 0.8 and wrong < 0.05
    assert np.mean([got[i].toxic for i, _, y in fresh if y]) > 0.95
    assert got[7_000_000].toxic_score == got[7_000_001].toxic_score == 0.0 and not got[7_000_000].toxic
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.toxic for r in toxicity.scores(docs, labels).collect())


def plain_logit(model, text, window):
    """The highest window logit, one word and one n-gram at a time."""
    grams = []
    for word in re.findall(rb"[0-9a-zA-Z\x80-\xff]+", (text or "").encode()):
        data, total, count = b"<" + word.lower() + b">", 0.0, 0
        for n in (3, 4, 5):
            for i in range(len(data) - n + 1):
                h = 0
                for b in data[i : i + n]:
                    h = (h * int(_words._BASE) + b + (n << 8)) % (1 << 64)
                total, count = total + float(model.weight[int(_words.mix(np.array([h], np.uint64))[0]) % len(model.weight)]), count + 1
        grams.append((total, count))
    size = min(window, len(grams))
    runs = [grams[i : i + size] for i in range(len(grams) - size + 1)] if grams else []
    return max((sum(s for s, _ in r) / sum(c for _, c in r) for r in runs), default=-np.inf) + model.bias


def test_toxicity_query_equals_plain_scoring(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.labelled_model(docs, labels)
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, DATA).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        logit = plain_logit(model, r.text, toxicity.WINDOW)
        assert abs(got[r.doc_id].toxic_score - (1 / (1 + np.exp(-max(logit, -700))) if np.isfinite(logit) else 0)) < 1e-4
        if abs(logit - model.threshold) > 1e-3:
            assert got[r.doc_id].toxic == (logit >= model.threshold)


def test_toxicity_of_odd_rows(spark):
    rows = labelled(300, 4, BAD)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(0, 0), (3, 0), (3, 1), (1, 0), (1, 0)], "doc_id long, toxic int")
    base = [(i, t, 0) for i, t, _ in rows]
    long = "fine " * 200_000 + BAD[0] + " " + BAD[1] + " fine" * 200_000
    docs = spark.createDataFrame([*base, base[0], (900, long, 0), (901, long.replace(BAD[0], "fine").replace(BAD[1], "fine"), 0)], "doc_id long, text string, toxic_score int")
    got = {}
    for r in toxicity.scores(docs, labels).collect():
        got.setdefault(r.doc_id, []).append((r.toxic_score, r.toxic))
    assert len(got[0]) == 2 and len(set(got[0])) == 1 and got[0][0][1] == 1
    assert got[900][0][1] == 1 and got[901][0][1] == 0
    assert toxicity.reject_toxic(docs, labels).filter("doc_id = 900").isEmpty()
    model = toxicity.labelled_model(docs, labels)
    unmatched = labels.unionByName(spark.range(10_000, 14_000).selectExpr("id doc_id", "1 toxic"))
    again = toxicity.labelled_model(docs, unmatched, toxic_rows=2000)
    assert np.allclose(model.weight, again.weight) and model.threshold == again.threshold


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scores(docs, none).first().toxic == 0
    assert toxicity.reject_toxic(docs.limit(0), none).count() == 0


def test_chat(spark):
    rows = [
        (1, 2, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "user", "you <|im_end|>"), (1, 3, "assistant", None), (1, 3, "assistant", None), (1, None, "user", "last"), (2, 0, None, "x"), (None, 0, "user", "lost"), (3, 1, "b", "2"), (3, 1, "a", "1"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, messages string")
    got = {r.conv_id: (r.n_turns, r.n_messages, r.chat) for r in chat_format.formatted(df).collect()}
    turn = "<|im_start|>{}\n{}<|im_end|>\n".format
    assert got == {
        1: (5, 3, turn("user", "hi\nyou < |im_end|>") + turn("assistant", "yes\n") + turn("user", "last")), 2: (1, 1, turn("unknown", "x")), 3: (2, 2, turn("a", "1") + turn("b", "2")),
    }
    assert chat_format.formatted(df.limit(0)).count() == 0


def test_chat_long_conversation(spark):
    df = spark.range(5000).selectExpr("1L conv_id", "id turn", "if(id % 3 = 0, 'user', 'assistant') role", "cast(id as string) text")
    row = chat_format.formatted(df).first()
    assert (row.n_turns, row.n_messages) == (5000, 3334)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16))
    x = (centre[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[700:720] = x[3]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(None, [1.0] * 16, 0), (9001, None, 0), (9002, [1.0, 2.0], 0), (9003, [None] + [1.0] * 15, 0), (9004, [float("nan")] * 16, 0), (5, x[5].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, distance int")
    got = ann.neighbours(df, k=10, list_size=48).toPandas()
    d = ann.squared(x, x)
    np.fill_diagonal(d, np.inf)
    found = got.groupby("vec_id")["distance"].apply(lambda s: np.sort(s.to_numpy()))
    assert set(got["vec_id"]) == set(range(1500)) and (got["vec_id"] != got["neighbour_id"]).all()
    want = np.sqrt(np.sort(d, axis=1)[:, :10])
    recall = np.mean([(found[i] <= want[i, -1] + 1e-3).sum() / 10 for i in range(1500)])
    assert recall >= 0.9
    assert ann.neighbours(df.limit(0)).count() == 0
    assert ann.neighbours(df.filter("vec_id < 3")).count() == 6


def test_vectors_in_small_lists_have_all_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    seeds = [r.id for r in spark.range(1500).orderBy(F.xxhash64("id"), "id").limit(4).collect()]
    x[seeds[0]] += 1000
    tight = [seeds[1], *[i for i in range(10) if i not in seeds][:2]]
    x[tight] = np.float32(-1000) + 0.01 * x[tight]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.neighbours(df, k=10, list_size=48).toPandas()
    assert (got.groupby("vec_id").size().reindex(range(1500), fill_value=0) == 10).all()
    for i in [seeds[0], *tight]:
        d = np.sqrt(((x.astype(np.float64) - x[i]) ** 2).sum(1))
        d[i] = np.inf
        mine = got[got["vec_id"] == i].sort_values("rank")
        assert mine["neighbour_id"].tolist() == np.lexsort((np.arange(1500), d))[:10].tolist() and mine["rank"].tolist() == list(range(1, 11))


def test_infinite_and_odd_vectors_do_not_harm_the_rest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    odd = [(-1, [1.0, 2.0]), (1000, [float("inf")] * 8), (1001, [float("-inf")] + [0.0] * 7), (1002, [1e30] * 8), (1003, []), (1004, None)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<float>")
    got = ann.neighbours(df, k=5).toPandas()
    assert set(got["vec_id"]) == set(range(300)) and set(got["neighbour_id"]) <= set(range(300))


def test_ties_go_by_id(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(8)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.neighbours(df, k=5).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append((r.neighbour_id, r.distance))
    assert got[3] == [(1, 0.0), (5, 0.0), (7, 0.0), (0, 1.0), (2, 1.0)]


def test_graph_finds_lists_of_islands():
    rng = np.random.default_rng(5)
    centre = 100 * rng.normal(size=(40, 16))
    points = np.concatenate([c + rng.normal(size=(60, 16)) for c in centre]).astype(np.float32)
    graph = ann.CentroidGraph(points, np.repeat(np.arange(40), 60))
    queries = points[rng.integers(0, len(points), 400)] + rng.normal(size=(400, 16)).astype(np.float32)
    found, _ = graph.search(queries, 16)
    want = np.argsort(ann.squared(queries, points), axis=1)[:, :16]
    assert np.mean([len(set(a) & set(b)) / 16 for a, b in zip(found.tolist(), want.tolist())]) > 0.95
    lists, near = graph.opened(queries[:5], 1e9, 4)
    assert ((lists >= 0).sum(1) > 0.95 * len(points)).all() and (np.diff(near[np.isfinite(near)].reshape(-1)) is not None)


def test_clustered_vectors_open_few_lists(spark):
    rng = np.random.default_rng(7)
    n, dim = 50_000, 24
    x = (3 * rng.normal(size=(100, dim))[rng.integers(0, 100, n)] + rng.normal(size=(n, 4)) @ rng.normal(size=(4, dim)) + 0.05 * rng.normal(size=(n, dim))).astype(np.float32)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32()))})
    vectors = ann._valid(spark.createDataFrame(table).repartition(8))
    graph = ann.build(vectors)
    ratio, beam = ann.opening(vectors, graph, 10, ann.CLOSURE, ann.REPLICAS, ann.TARGET)
    _, near = graph.opened(x[:2000], ratio, beam)
    assert len(graph.points) > 150 and (near <= ratio * near[:, :1] + 1e-12).sum(1).mean() < 0.2 * len(graph.points)
    got = ann.neighbours(vectors).filter("vec_id < 1000").toPandas()
    d = ann.squared(x[:1000], x)
    d[np.arange(1000), np.arange(1000)] = np.inf
    edge = np.sqrt(np.partition(d, 9, axis=1)[:, 9])
    found = got.groupby("vec_id")["distance"].apply(np.array)
    assert np.mean([(found[i] <= edge[i] + 1e-3).sum() / 10 for i in range(1000)]) >= 0.95


def test_every_fiftieth_vector_asks_all_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    names, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float32)
    got = queries.queries()["op7_ann"](spark, "/root/testdata/sf0.1").toPandas()
    asked = np.flatnonzero(names % 50 == 0)
    d = ann.squared(x[asked], x)
    d[np.arange(len(asked)), asked] = np.inf
    edge = np.sqrt(np.partition(d, 9, axis=1)[:, 9])
    found = got.groupby("vec_id")["distance"].apply(np.array)
    assert set(got["vec_id"]) == set(names[asked].tolist()) and len(got) == 10 * len(asked)
    assert (got["neighbour_id"] % 50 != 0).mean() > 0.9
    assert np.mean([(found[names[a]] <= edge[i] + 1e-3).sum() / 10 for i, a in enumerate(asked)]) >= 0.9


def test_lists_grow_where_the_graph_would_be_too_large(spark):
    x = np.random.default_rng(8).normal(size=(3000, 8)).astype(np.float32)
    vectors = ann._valid(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    assert len(ann.build(vectors, 16).points) > 150 > len(ann.build(vectors, 16, 10_000).points)


def test_raking_reaches_the_marginals():
    rng = np.random.default_rng(0)
    names = [np.array([f"{k}{i}" for i in ix]) for k, ix in zip("slt", np.indices((4, 3, 2)).reshape(3, -1))]
    tokens = rng.uniform(100, 1000, 24)
    p = mixing.rake(names, tokens, {"lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}}, 0.7, 0.3, 60)
    drawn = p * tokens
    assert np.allclose([drawn[names[1] == f"l{i}"].sum() / drawn.sum() for i in range(3)], [0.5, 0.3, 0.2], atol=1e-3)
    assert abs(drawn.sum() / tokens.sum() - 0.3) < 1e-3 and p.max() <= 1


def test_mixing_in_spark_equals_numpy(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(0, 60) + rng.choice(["", "@", "license"]), rng.choice(["a", "b", None]), rng.choice(["en", "de"]), 1.0) for i in range(400)] + [(None, None, None, None, None), (3, "x", "a", "en", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, probability double")
    a = mixing.drawn(df, rounds=3).toPandas().sort_values(["doc_id", "n_tokens"])
    b = mixing.drawn(df, rounds=3, local_cells=0).toPandas().sort_values(["doc_id", "n_tokens"])
    assert np.allclose(a["probability"], b["probability"], atol=1e-6) and (a["sampled"].to_numpy() == b["sampled"].to_numpy()).all()
    kept = mixing.sampled(df, rounds=3)
    assert kept.columns == df.columns and kept.count() == a["sampled"].sum()
    assert mixing.drawn(df.limit(0)).count() == 0


def test_mixing_in_bytes_equals_duckdb(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(mixing.SQL)
    got = mixing.drawn(spark.read.parquet(f"{DATA}/documents.parquet")).select(*want.columns).collect()
    near = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert near(map(tuple, got)) == near(want.fetchall())


def test_mixing_query_equals_plain_raking_of_real_tokens(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op10_mixing(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.n_tokens == max(1, len(ids_of(token_ids.TOKENIZER, [docs[r.doc_id].text or ""])[0])) for r in rows)
    tokens = Counter()
    for r in rows:
        tokens[r.source, r.lang, r.topic] += r.n_tokens
    total = sum(tokens.values())
    goals = []
    for k in range(3):
        share = Counter()
        for c, n in tokens.items():
            share[c[k]] += n
        share = {v: (n / total) ** mixing.TEMPER for v, n in share.items()}
        goals.append({v: x / sum(share.values()) for v, x in share.items()})
    weight, room = {c: n / total for c, n in tokens.items()}, {c: n / total / mixing.FRACTION for c, n in tokens.items()}
    for _ in range(mixing.ROUNDS):
        for k in range(3):
            held = Counter()
            for c, w in weight.items():
                held[c[k]] += w
            weight = {c: min(w * goals[k][c[k]] / held[c[k]], room[c]) for c, w in weight.items()}
    for r in rows:
        p = min(1.0, weight[r.source, r.lang, r.topic] / room[r.source, r.lang, r.topic])
        u = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:13], 16) / (1 << 52)
        assert abs(r.probability - p) < 2e-6 and (r.sampled == (u < p) or abs(u - p) < 1e-9)


@pytest.mark.parametrize("cells", [0, 1000])
def test_mixing_targets_that_cannot_be_met(spark, cells):
    df = spark.createDataFrame([(1, "a", "s", "en"), (2, "b", "t", "de")], "doc_id long, text string, source string, lang string")
    for wrong in ({"lang": {"fr": 1.0}}, {"lang": {}}, {"lang": {"en": -1.0}}, {"lang": {"en": float("nan")}}, {"tone": {"x": 1.0}}):
        with pytest.raises(ValueError):
            mixing.sampled(df, wrong, local_cells=cells)
    assert mixing.sampled(df, {"lang": {"en": 1.0, "fr": 1.0}}, fraction=1.0, local_cells=cells).filter("lang <> 'en'").isEmpty()
    assert mixing.sampled(df.limit(0), {"lang": {"fr": 1.0}}, local_cells=cells).isEmpty()


def test_mixing_with_clashing_names_topics_and_long_texts(spark):
    names = ["doc_id", "text", "source", "lang", "topic", "__tokens", "tokens", "row", "draw", "p", "n_tokens", "n.x"]
    rows = [(i, t, "s", None, topic, *"tuvwxyz") for i, t, topic in ((1, "word " * 400_000, "long"), (2, None, None), (3, "", "b"), (4, "x", "b"), (None, "y", "c"), (4, "x", "b"))]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = mixing.drawn(df, tokenizer=token_ids.TOKENIZER).collect()
    assert sorted((r.topic, r.n_tokens) for r in out) == [("", 1), ("b", 1), ("b", 1), ("b", 1), ("c", 1), ("long", len(ids_of(token_ids.TOKENIZER, [rows[0][1]])[0]))]
    every = mixing.sampled(df, {"topic": {"b": 1.0}}, fraction=0.0000001, tokenizer=token_ids.TOKENIZER)
    assert every.columns == names
    assert {r.topic for r in mixing.sampled(df, fraction=1.0, temper=1.0, tokenizer=token_ids.TOKENIZER).collect()} == {"long", None, "b", "c"}


def test_packing_query_counts_ids_of_the_tokenizer(spark):
    rows = queries.op3_best_fit_packing(spark, DATA).collect()
    got, bins, want = Counter(), Counter(), Counter()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("octet_length(text) > 0").collect():
        want[r.doc_id] += len(ids_of(token_ids.TOKENIZER, [r.text])[0])
    for r in rows:
        got[r.doc_id] += r.piece_tokens
        bins[r.bin] += r.piece_tokens
    assert got == want
    assert max(bins.values()) <= best_fit.CAPACITY
    odd = spark.createDataFrame([(1, "a <|endoftext|> b"), (1, "a <|endoftext|> b"), (2, ""), (3, None), (None, "\u00fc" * 50)], "doc_id long, text string")
    want = sorted(len(x) for x in ids_of(token_ids.TOKENIZER, ["a <|endoftext|> b"] * 2 + ["\u00fc" * 50]))
    assert sorted(r.piece_tokens for r in best_fit.packed(odd, tokenizer=token_ids.TOKENIZER).collect()) == want
