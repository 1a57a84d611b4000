"""Operator 4: toxicity by subword-bag embeddings under a linear softmax.

A word is the bag of its character n-grams (3 to 5 bytes of ``<word>``; not the word as a
whole, which would learn spellings by heart), hashed to rows of an embedding matrix. A bag of words is the mean of its
subword embeddings, classified by a linear softmax; embeddings and softmax are trained
jointly in numpy, in one task (Adam). As n-grams are shared, a
misspelling never seen in training lands near the word it distorts.

A label speaks of a whole document, the words at fault are few. Training therefore
starts with whole documents as bags, all of the sample in batches of about ``BATCH`` words, and goes on, in a few rounds, with the ``window``
words of each document that the model so far finds most toxic. A document is scored by the
highest of all its windows, at whatever length. The decision threshold is
set on labelled documents held out of training, where F1 is best; within the gap between the scores there, a quarter
of the way up from the clean side, as unseen misspellings score below the words they distort.

The only bounded part is the training sample: at most ``toxic_rows`` and ``clean_rows``
labelled documents that have a text, those with the smallest hashes of ``doc_id``. Every document is scored.

Defined results: a text without a word, or null, scores 0.0 and is not toxic; a null
``doc_id`` is scored like any other; repeated rows score alike, each in its own
row; labels that are null or unmatched are ignored, contradictory ones count as toxic; without labels of
both classes every document scores 0.0. Texts are read whole at any length; other columns, whatever their names, are not read, or are
passed through by ``reject_toxic``; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _words as words

TOXIC_ROWS = 2000
CLEAN_ROWS = 4000
BUCKETS = 1 << 17
DIMENSIONS = 8
WINDOW = 5
ROUNDS = 4
BATCH = 1 << 17
AT_ONCE = 1 << 19
DECAY = 0.1


@dataclass
class Model:
    """What scoring needs: each bucket's share of the logit, the bias, the decision threshold on the logit."""

    weight: np.ndarray
    bias: float
    threshold: float


def subwords(data: np.ndarray, begin: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first one of each word with an end) of words given by byte ranges; lower case in ASCII."""
    size = end - begin + 2
    edge = np.r_[0, np.cumsum(size)]
    of = np.repeat(np.arange(len(begin), dtype=np.int32), size)
    source = np.clip(np.arange(edge[-1]) + (begin - edge[:-1] - 1)[of], 0, max(0, len(data) - 1))
    letter = words.LOWER[data[source]].astype(np.uint64) if len(of) else np.zeros(0, np.uint64)
    letter[edge[:-1]] = ord("<")
    letter[edge[1:] - 1] = ord(">")
    mask = np.uint64(buckets - 1)
    found, owner = [], []
    for n in (3, 4, 5):
        gram = words.grams(letter + np.uint64(n << 8), n)
        inside = np.flatnonzero(of[: len(gram)] == of[n - 1 :]) if len(gram) else np.zeros(0, np.int64)
        found.append((gram[inside] & mask).astype(np.int32))
        owner.append(of[inside])
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(begin) + 1))


def vocabulary(s: words.Slice, x: words.Words, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's entry, and the subwords of the entries."""
    _, sample, entry = np.unique(x.hash, return_index=True, return_inverse=True)
    found, count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(sample), 1 << 15):
        some = sample[at : at + (1 << 15)]
        bucket, first = subwords(s.data, x.begin[some], x.end[some], buckets)
        found.append(bucket)
        count.append(np.diff(first))
    return entry, np.concatenate(found), np.r_[0, np.cumsum(np.concatenate(count))]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts, none of them empty."""
    return np.add.reduceat(values, first[:-1], axis=0) if len(first) > 1 else values[:0]


class Entries:
    """The vocabulary of texts read slice by slice: each word's entry, the subwords of each entry, the first word of each text."""

    def __init__(self, column: pa.Array, buckets: int):
        known, number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        entry, rows, found, count, total = [], [0], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        for s in words.slices(column):
            x = words.scan(s)
            hashes, sample, local = np.unique(x.hash, return_index=True, return_inverse=True)
            fresh = np.flatnonzero(~np.isin(hashes, known))
            for at in range(0, len(fresh), 1 << 15):
                some = sample[fresh[at : at + (1 << 15)]]
                bucket, first = subwords(s.data, x.begin[some], x.end[some], buckets)
                found.append(bucket)
                count.append(np.diff(first))
            number = np.r_[number, np.arange(len(known), len(known) + len(fresh), dtype=np.int32)]
            known = np.r_[known, hashes[fresh]]
            order = np.argsort(known)
            entry.append(number[order[np.searchsorted(known, hashes, sorter=order)]][local].astype(np.int32))
            rows.extend((x.of_row[1:] + total).tolist())
            total += len(x.hash)
        self.entry = np.concatenate(entry) if entry else np.zeros(0, np.int32)
        self.of_row, self.subword, self.count = np.array(rows, np.int64), np.concatenate(found), np.concatenate(count)
        self.first = np.r_[0, np.cumsum(self.count)]

    def windows(self, share: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """``best_windows`` of all texts under the buckets' ``share``, some texts at a time."""
        word, best, place, at = _sums(share[self.subword], self.first), [], [], 0
        while at < len(self.of_row) - 1:
            end = max(at + 1, int(np.searchsorted(self.of_row, self.of_row[at] + AT_ONCE, side="right")) - 1)
            entry = self.entry[self.of_row[at] : self.of_row[end]]
            b, p = best_windows(word[entry], self.count[entry], self.of_row[at : end + 1] - self.of_row[at], window)
            best.append(b)
            place.append(np.where(p >= 0, p + self.of_row[at], -1))
            at = end
        return np.concatenate(best), np.concatenate(place)


def best_windows(score: np.ndarray, count: np.ndarray, of_row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the highest mean over ``window`` consecutive words, and the first of those words (-1: no word)."""
    n = len(score)
    best, place = np.full(len(of_row) - 1, -np.inf), np.full(len(of_row) - 1, -1)
    if n == 0:
        return best, place
    s, c = np.r_[0, np.cumsum(score, dtype=np.float64)], np.r_[0, np.cumsum(count)]
    row = np.repeat(np.arange(len(of_row) - 1), np.diff(of_row))
    stop = np.minimum(np.arange(n) + window, of_row[1:][row])
    mean = (s[stop] - s[:-1]) / (c[stop] - c[:-1])
    short = stop - np.arange(n) < np.minimum(window, np.diff(of_row)[row])
    mean[short] = -np.inf
    some = np.flatnonzero(np.diff(of_row) > 0)
    best[some] = np.maximum.reduceat(mean, of_row[some])
    hit = np.flatnonzero(mean == best[row])
    place[row[hit[::-1]]] = hit[::-1]
    return best, place


def _fit(bags: list[np.ndarray], label: np.ndarray, subword: np.ndarray, first: np.ndarray, state: dict, steps: int, rate: float) -> None:
    """Full-batch Adam steps on bags of vocabulary entries; ``state`` holds embeddings, softmax and moments."""
    sizes = np.array([len(b) for b in bags])
    entry, of_token = np.unique(np.concatenate(bags), return_inverse=True)
    count = np.diff(first)[entry]
    bucket = subword[np.repeat(first[:-1][entry] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
    of_pair = np.repeat(np.arange(len(entry), dtype=np.int32), count)
    used, bucket = np.unique(bucket, return_inverse=True)
    edge, bag_edge = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(sizes)]
    of_bag = np.repeat(np.arange(len(bags)), sizes)
    total = np.maximum(1, np.bincount(of_bag, count[of_token], len(bags)))
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    target = np.stack([1 - label, label], 1)
    e = state["E"][used]
    moments = [np.zeros_like(e), np.zeros_like(e), np.zeros_like(state["W"]), np.zeros_like(state["W"]), np.zeros(2), np.zeros(2)]
    for step in range(1, steps + 1):
        vector = _sums(e[bucket], edge)
        mean = _sums(vector[of_token], bag_edge) / total[:, None]
        logit = mean @ state["W"] + state["b"]
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) * weight[:, None]
        g_mean = (g @ state["W"].T) / total[:, None]
        spread = g_mean[of_bag]
        g_vector = np.stack([np.bincount(of_token, spread[:, d], len(entry)) for d in range(spread.shape[1])], 1)
        g_e = np.stack([np.bincount(bucket, g_vector[of_pair, d], len(used)) for d in range(g_vector.shape[1])], 1).astype(np.float32)
        for i, (value, grad) in enumerate(((e, g_e), (state["W"], mean.T @ g), (state["b"], g.sum(0)))):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) + DECAY * value)
    state["E"][used] = e


def train(texts, label: np.ndarray, buckets: int = BUCKETS, window: int = WINDOW, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> Model:
    """A model from labelled texts (1: toxic); a fifth of the toxic ones and the surplus of clean ones set the threshold."""
    nothing = Model(np.zeros(buckets, np.float32), -np.inf, np.inf)
    if not len(texts) or label.min() == label.max():
        return nothing
    x = Entries(texts if isinstance(texts, pa.Array | pa.ChunkedArray) else pa.array(texts, pa.large_string()), buckets)
    if len(x.entry) == 0:
        return nothing
    entry, subword, first = x.entry, x.subword, x.first
    toxic, clean = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    held = len(toxic) // 5
    fit_rows = np.r_[toxic[held:], clean[len(clean) // 2 :]]
    fit_rows = fit_rows[np.diff(x.of_row)[fit_rows] > 0]
    rng = np.random.default_rng(7)
    state = {"E": rng.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions)).astype(np.float32), "W": np.zeros((dimensions, 2)), "b": np.zeros(2)}
    state["W"][:, 1], state["W"][:, 0] = 0.1, -0.1

    def share() -> np.ndarray:
        return state["E"] @ (state["W"][:, 1] - state["W"][:, 0])

    bag = lambda row, at, n: entry[at : min(at + n, x.of_row[row + 1])]
    mixed = fit_rows[np.argsort(words.mix(fit_rows.astype(np.uint64)), kind="stable")]
    upto = np.cumsum(np.diff(x.of_row)[mixed]) // BATCH
    for some in np.split(mixed, np.flatnonzero(np.diff(upto)) + 1) if len(mixed) else ():
        _fit([bag(r, x.of_row[r], 1 << 62) for r in some], label[some], subword, first, state, 8, 0.05)
    quiet, hard = fit_rows[label[fit_rows] == 0], []
    loud = fit_rows[label[fit_rows] == 1]
    for _ in range(rounds):
        _, place = x.windows(share(), window)
        other = x.of_row[:-1] + (rng.random(len(texts)) * np.maximum(1, np.diff(x.of_row) - window)).astype(np.int64)
        hard += [bag(r, place[r], window) for r in quiet] + [bag(r, other[r], window) for r in quiet]
        bags = [bag(r, place[r], window) for r in loud] + hard
        _fit(bags, np.r_[np.ones(len(loud), np.int64), np.zeros(len(hard), np.int64)], subword, first, state, 40, 0.05)
    best, _ = x.windows(share(), window)
    rows = np.r_[toxic[:held], clean[: len(clean) // 2]] if held else np.arange(len(texts))
    score, truth = best[rows], label[rows]
    cost = np.where(truth == 1, 1.0, 9.0 * max(1, (truth == 1).sum()) / max(1, (truth == 0).sum()))
    order = np.argsort(-score, kind="stable")
    hit, false = np.cumsum((truth * cost)[order]), np.cumsum(((1 - truth) * cost)[order])
    f1 = 2 * hit / (hit + false + (truth * cost).sum())
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)[0]
    below = score[order][top + 1] if top + 1 < len(order) and np.isfinite(score[order][top + 1]) else score[order][top] - 1
    bias = float(state["b"][1] - state["b"][0])
    return Model(share().astype(np.float32), bias, float(below + (score[order][top] - below) / 4) + bias)


def score_slice(model: Model, s: words.Slice, window: int) -> np.ndarray:
    """Highest window logit of each row; -inf without a word."""
    x = words.scan(s)
    entry, subword, first = vocabulary(s, x, len(model.weight))
    word = _sums(model.weight[subword], first)[entry]
    return best_windows(word, np.diff(first)[entry], x.of_row, window)[0] + model.bias


def labelled_model(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, window: int = WINDOW) -> Model:
    """The model trained on a bounded sample of ``labels`` (doc_id, toxic) and the texts of ``docs``."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    known = known.join(docs.filter("text is not null").select("doc_id"), "doc_id", "left_semi")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = known.filter("toxic = 1").orderBy(*order).limit(toxic_rows).unionByName(known.filter("toxic = 0").orderBy(*order).limit(clean_rows))
    texts = docs.filter("text is not null").select("doc_id", "text")
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def fit(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy().astype(np.int64)
        order = np.lexsort((ids, words.mix(ids.view(np.uint64))))
        model = train(table["text"].take(pa.array(order)), table["toxic"].to_numpy()[order].astype(np.int64), window=window)
        return pa.table({"weight": pa.array([model.weight.tobytes()], pa.binary()), "bias": [model.bias], "threshold": [model.threshold]})

    found = rows.select(F.col("doc_id").cast("long"), "toxic", "text", F.lit(0).alias("all")).groupBy("all").applyInArrow(fit, "weight binary, bias double, threshold double").collect()
    if not found:
        return Model(np.zeros(BUCKETS, np.float32), -np.inf, np.inf)
    return Model(np.frombuffer(found[0].weight, np.float32), found[0].bias, found[0].threshold)


def _logits(batch: pa.RecordBatch, at: int, model: Model, window: int) -> np.ndarray:
    parts = [score_slice(model, s, window) for s in words.slices(batch.column(at))]
    return np.concatenate(parts) if parts else np.zeros(0)


def scores(docs: DataFrame, labels: DataFrame, window: int = WINDOW, **bounds: int) -> DataFrame:
    """(doc_id, toxic_score, toxic) of every document; the score is the softmax probability of its worst window."""
    model = docs.sparkSession.sparkContext.broadcast(labelled_model(docs, labels, window=window, **bounds))

    def run(batches):
        for batch in batches:
            logit = _logits(batch, 1, model.value, window)
            toxic = (logit >= model.value.threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), np.round(1 / (1 + np.exp(-np.maximum(logit, -700))), 6) * np.isfinite(logit), toxic], ["doc_id", "toxic_score", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, toxic_score double, toxic int")


def reject_toxic(docs: DataFrame, labels: DataFrame, window: int = WINDOW, **bounds: int) -> DataFrame:
    """``docs`` without the documents found toxic; all columns and other rows stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(labelled_model(docs, labels, window=window, **bounds))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_logits(batch, at, model.value, window) < model.value.threshold))

    return docs.mapInArrow(run, docs.schema)
