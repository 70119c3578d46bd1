"""A convolutional text classifier in numpy: hashed word embeddings, filters of several widths, max pooling.

A word's vector is the sum of three rows of one hashed table: of the whole word and of its first four and six bytes, after
A-Z became lower case and ASCII punctuation at both ends went. Filters of 1, 2 and 3 words run over the whole text, the
maximum of each over all places goes through a logistic unit. Only rows that occur more often with one label than with
the other take part, and rows that no gradient reached are set to zero: a word that tells nothing, or that training
didn't see, is neutral. Scores are calibrated to probabilities (Platt) on rows of the sample kept out of the fit, and a
threshold for each language is chosen on all labelled rows that are neither fitted nor held out; the language is no
input of the score.

Training reads a bounded sample on the driver (see `train`) and counts the scores of the labelled rows by language and
label on the executors; scoring is one pass over the documents without a shuffle.
The model that goes to the executors has a fixed size of 8 MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources import scratch

from . import words
from .columns import own, packed, unpacked

BUCKET_BITS, DIM, WIDTHS, FILTERS, PREFIXES = 17, 16, (1, 2, 3), 8, (4, 6)
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Zero rows after each text, so that no filter reaches into the next one.
PAD = max(WIDTHS) - 1
DEFAULT_THRESHOLD = 0.3
#: Squared gradient that each row of the table begins with: one stray gradient then moves a row little.
START = 1e-5
#: Documents of the fit that a row of the table must occur in to be used, and how far its shares of the documents of the
#: two labels must lie apart, in standard errors.
LEAST_DOCUMENTS, LEAST_Z = 3, 2.0
#: Equal parts of the scores by which labelled rows are counted, and the rows of each label that a language must have.
BINS, LEAST_ROWS = 1000, 10


@dataclass
class Model:
    table: np.ndarray = field(repr=False)
    filters: dict[int, np.ndarray] = field(repr=False)  # width -> (width, DIM, FILTERS)
    offsets: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = DEFAULT_THRESHOLD

    def scores(self, values: pa.ChunkedArray) -> np.ndarray:
        parts = [self.logits(*features(c)) for c in words.chunks(values, lower=True)]
        return sigmoid(self.scale * (np.concatenate(parts) if parts else np.empty(0)) + self.shift)

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        pooled, _ = self.pool(self.vectors(ids, counts), counts)
        return (np.maximum(pooled, 0) @ self.weights + self.bias).astype(np.float64)

    def vectors(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One row a word, and PAD zero rows after each text; a text without words has one zero row before them."""
        real = places(counts)[2]
        out = np.zeros((len(real), DIM), np.float32)
        out[real] = self.table[ids[0]] + self.table[ids[1]] + self.table[ids[2]]
        return out

    def pool(self, x: np.ndarray, counts: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The maximum of each filter over each text, and its place in x."""
        begin, size, _ = places(counts)
        n = len(x)
        inside = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        outs, at = [], []
        for w in WIDTHS:
            conv = np.zeros((n, FILTERS), np.float32)
            for k in range(w):
                conv[: n - k] += (x @ self.filters[w][k])[k:]
            conv = conv[inside]
            edges = np.concatenate(([0], np.cumsum(size)))
            outs.append(np.maximum.reduceat(conv, edges[:-1], axis=0))
            if where:
                at.append(np.stack([begin[i] + conv[edges[i] : edges[i + 1]].argmax(0) for i in range(len(counts))]))
        return np.concatenate(outs, 1) + self.offsets, np.concatenate(at, 1) if where else None


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row of each text, the rows that filters may start at, and which rows are words."""
    size = np.maximum(counts, 1)
    begin = np.concatenate(([0], np.cumsum(size + PAD)[:-1])).astype(np.int64)
    total = int((size + PAD).sum())
    real = np.zeros(total, bool)
    real[np.repeat(begin - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())] = True
    return begin, size, real


def features(c: words.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(3, words) bucket numbers, and the words of each text."""
    starts, ends = c.starts.copy(), c.ends.copy()
    for _ in range(4):
        starts += PUNCTUATION[c.data[starts]] & (ends - starts > 1)
        ends -= PUNCTUATION[c.data[ends - 1]] & (ends - starts > 1)
    spans = [words.FIRST.spans(c.data, starts, ends), *(words.FIRST.spans(c.data, starts, np.minimum(starts + n, ends)) + np.uint64(n) for n in PREFIXES)]
    return np.stack([(words.mix(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) for h in spans]), c.counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def part(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4: 2 is held out, 3 calibrates, 0 and 1 fit."""
    return F.crc32(own(id_col).cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", rows_per_class: int = 3000, max_bytes: int = 48 << 20, steps: int = 600, seed: int = 7) -> Model:
    """Fits a model to labels of rows whose crc32(id as text) modulo 4 is not 2.

    The sample is bounded: at most rows_per_class rows of each label, in the order of a hash of the id, whose texts have at
    most max_bytes together; whole texts, none cut, and one that doesn't fit into the rest is passed over. Several labels of one id count as their maximum; null labels, null
    ids and ids without a document are ignored. Of rows that share an id the least text is taken. Without rows of both labels, or where those of one label are all too long, the model scores every text alike, by the
    share of label 1.
    """
    marks = labels.select(own(id_col).alias("id"), own(label_col).alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    named = docs.select(own(id_col).alias("id"), F.octet_length(own(text_col)).alias("size"))
    usable = named.join(marks.where(part("id") != 2), "id")
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    model = _fresh(np.random.default_rng(seed))
    sized = usable.select("id", "y", "size", F.xxhash64("id").alias("h"))
    both = [sized.where(F.col("y") == y).orderBy("h").limit(rows_per_class).collect() if counts.get(1 - y) else [] for y in (0, 1)]
    chosen = _within(both, max_bytes)
    if len({y for _, y in chosen}) < 2:
        model.weights[:] = 0
        model.shift = float(np.log(prior / (1 - prior)))
        return model
    picked = docs.sparkSession.createDataFrame(sorted(set(chosen)), T.StructType([T.StructField("id", usable.schema["id"].dataType), T.StructField("y", T.IntegerType())]))
    lang = own(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(own(id_col).alias("id"), own(text_col).alias("text"), lang.alias("lang"))
    single = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min(F.struct("text", "lang")).alias("row"))  # at most 2 * rows_per_class ids
    rows = single.select("id", "y", "row.*").withColumn("part", part("id")).orderBy(F.xxhash64("id")).toArrow()
    ids, sizes = [], []
    for c in words.chunks(rows["text"], lower=True):
        i, n = features(c)
        ids.append(i)
        sizes.append(n)
    ids, sizes, y = np.concatenate(ids, 1), np.concatenate(sizes), rows["y"].to_numpy().astype(np.float64)
    fit = np.flatnonzero(rows["part"].to_numpy() != 3)
    fit = fit if len(set(y[fit])) == 2 else np.arange(len(y))
    _fit(model, ids, sizes, y, fit, steps, np.random.default_rng(seed))
    check = np.flatnonzero(rows["part"].to_numpy() == 3)
    _calibrate(model, ids, sizes, y, check if len(set(y[check])) == 2 else fit, counts, np.array([x or "" for x in rows["lang"].to_pylist()]))
    fitted = picked if len(fit) == len(y) else picked.where(part("id") != 3)
    _set_thresholds(model, _score_counts(model, texts, marks.where(part("id") != 2), fitted), counts)
    return model


def _within(both: list[list], left: int) -> list[tuple[object, int]]:
    """Ids and labels of the rows whose texts fit together into so many bytes; in turns, so that the bound takes from both labels."""
    chosen = []
    for r in (r for pair in zip_longest(*both) for r in pair if r is not None):
        if (size := r["size"] or 0) <= left:
            chosen.append((r["id"], r["y"]))
            left -= size
    return chosen


def _fresh(draw: np.random.Generator) -> Model:
    table = (draw.standard_normal((1 << BUCKET_BITS, DIM)) * 0.05).astype(np.float32)
    filters = {w: (draw.standard_normal((w, DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS}
    n = FILTERS * len(WIDTHS)
    return Model(table, filters, np.zeros(n, np.float32), (draw.standard_normal(n) * 0.3).astype(np.float32))


def _fit(model: Model, ids: np.ndarray, counts: np.ndarray, y: np.ndarray, fit: np.ndarray, steps: int, draw: np.random.Generator, batch: int = 32, rate: float = 0.05) -> None:
    """Adagrad on the logistic loss; the gradient of a maximum goes to the words at its place."""
    at = np.concatenate(([0], np.cumsum(counts)))
    usable = _telling(ids, at, y, fit, len(model.table))
    model.table[~usable] = 0
    weight = np.where(y == 1, 0.5 / max(y[fit].mean(), 1e-9), 0.5 / max(1 - y[fit].mean(), 1e-9))
    dense = {"offsets": model.offsets, "weights": model.weights, **{w: model.filters[w] for w in WIDTHS}}
    seen = {k: np.full(v.shape, 1e-2, np.float32) for k, v in dense.items()}
    seen_bias, seen_table = 1e-2, np.full(len(model.table), START, np.float32)
    rounds, per_round = max(8, round(steps * batch / len(fit))), max(1, len(fit) // batch)
    # What stays is the mean of the weights over the second half: single steps of a small fit are noisy.
    every, sums, bias, taken = max(1, rounds * per_round // 60), {k: np.zeros(v.shape) for k, v in [*dense.items(), ("table", model.table)]}, 0.0, 0
    for turn in range(rounds):
        for number, b in enumerate(np.array_split(draw.permutation(fit), per_round)):
            n, own_ids = counts[b], np.concatenate([ids[:, at[i] : at[i + 1]] for i in b], 1)
            x = model.vectors(own_ids, n)
            pooled, where = model.pool(x, n, where=True)
            active = np.maximum(pooled, 0)
            error = ((sigmoid(active @ model.weights + model.bias) - y[b]) * weight[b] / len(b)).astype(np.float32)
            grad = {k: np.zeros_like(v) for k, v in dense.items()}
            grad["weights"] = active.T @ error
            back = error[:, None] * model.weights * (pooled > 0)
            grad["offsets"] = back.sum(0)
            dx = np.zeros_like(x)
            for j, w in enumerate(WIDTHS):
                g, p = back[:, j * FILTERS : (j + 1) * FILTERS], where[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(w):
                    row = np.minimum(p + k, len(x) - 1)
                    grad[w][k] = np.einsum("bfd,bf->df", x[row], g)
                    np.add.at(dx, row.ravel(), (g[:, :, None] * model.filters[w][k].T[None]).reshape(-1, DIM))
            touched = places(n)[2]
            hit = np.flatnonzero(np.abs(dx[touched]).max(1) > 0) if touched.any() else np.empty(0, np.int64)
            rows = own_ids[:, hit].ravel()
            unique, back_to = np.unique(rows, return_inverse=True)
            change = np.zeros((len(unique), DIM), np.float32)
            np.add.at(change, back_to, np.tile(dx[touched][hit], (3, 1)))
            unique, change = unique[usable[unique]], change[usable[unique]]
            seen_table[unique] += (change**2).mean(1)
            model.table[unique] -= rate * change / np.sqrt(seen_table[unique] + 1e-8)[:, None]
            for k, v in dense.items():
                seen[k] += grad[k] ** 2
                v -= rate * grad[k] / np.sqrt(seen[k])
            seen_bias += float(error.sum()) ** 2
            model.bias -= rate * float(error.sum()) / np.sqrt(seen_bias)
            step = turn * per_round + number
            if 2 * step >= rounds * per_round and step % every == 0:
                for k in dense:
                    sums[k] += dense[k]
                sums["table"] += model.table
                bias, taken = bias + model.bias, taken + 1
    for k in dense:
        dense[k][:] = sums[k] / taken
    model.table[:], model.bias = sums["table"] / taken, bias / taken
    model.table[seen_table == np.float32(START)] = 0


def _telling(ids: np.ndarray, at: np.ndarray, y: np.ndarray, fit: np.ndarray, size: int) -> np.ndarray:
    """Rows of the table whose share of documents differs between the labels: others would only let the fit remember."""
    seen = np.zeros((2, size))
    for i in fit:
        seen[int(y[i]), np.unique(ids[:, at[i] : at[i + 1]])] += 1
    n = np.array([(y[fit] == 0).sum(), (y[fit] == 1).sum()], float)
    share, both = seen / n[:, None], seen.sum(0) / n.sum()
    z = (share[1] - share[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n).sum())
    return (seen.sum(0) >= LEAST_DOCUMENTS) & (np.abs(z) >= LEAST_Z)


def _calibrate(model: Model, ids: np.ndarray, counts: np.ndarray, y: np.ndarray, rows: np.ndarray, totals: dict[int, int], lang: np.ndarray) -> None:
    """Platt scaling with the labels' true shares, then the threshold of each language with the best F1."""
    at = np.concatenate(([0], np.cumsum(counts)))
    z = np.concatenate([model.logits(ids[:, at[i] : at[i + 1]], counts[i : i + 1]) for i in rows])
    t = y[rows]
    share = {k: totals[k] / max(1, (t == k).sum()) for k in (0, 1)}
    weight = np.where(t == 1, share[1], share[0])
    weight /= weight.mean()
    n1, n0 = (t == 1).sum(), (t == 0).sum()
    goal = np.where(t == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # Platt's targets keep the slope finite
    theta = np.array([1.0, 0.0])
    design = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = sigmoid(design @ theta)
        gradient = design.T @ (weight * (p - goal)) + np.array([1e-3 * (theta[0] - 1), 0])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-3
        step = np.linalg.solve(hessian, gradient)
        theta -= step / max(1, np.abs(step).max())
    model.scale, model.shift = float(max(theta[0], 1e-3)), float(theta[1])
    score = sigmoid(model.scale * z + model.shift)
    model.threshold = _threshold(score, t, weight)
    for name in set(lang[rows]):
        of = lang[rows] == name
        if name and min((t[of] == 1).sum(), (t[of] == 0).sum()) >= LEAST_ROWS:
            model.thresholds[str(name)] = _threshold(score[of], t[of], weight[of])


def _score_counts(model: Model, texts: DataFrame, marks: DataFrame, fitted: DataFrame) -> list[tuple[str, int, int, int]]:
    """(language, label, part of the scores, rows) of the marked documents besides the fitted ones: for the empty string
    all languages together, else those with LEAST_ROWS rows of each label. Texts are not shuffled."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # of fixed size
    inner = texts.where(F.col("id").isNotNull() & (part("id") != 2)).select("id", "lang", "text")
    schema = T.StructType([inner.schema["id"], inner.schema["lang"], T.StructField("bin", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = shared.value.scores(pa.chunked_array([b["text"]]))
            at = np.minimum((score * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays([b["id"], b["lang"], pa.array(at, pa.int32())], names=["id", "lang", "bin"])

    rows = inner.mapInArrow(run, schema).join(marks, "id").join(F.broadcast(fitted.select("id")), "id", "left_anti")  # at most 2 * rows_per_class ids
    found = scratch.save(rows.groupBy("lang", "y", "bin").agg(F.count(F.lit(1)).alias("n")), "scores")
    per_label = found.where("lang <> ''").groupBy("lang").agg(F.sum(F.when(F.col("y") == 0, F.col("n"))).alias("n0"), F.sum(F.when(F.col("y") == 1, F.col("n"))).alias("n1"))
    enough = per_label.where((F.col("n0") >= LEAST_ROWS) & (F.col("n1") >= LEAST_ROWS)).select("lang")
    every = found.groupBy("y", "bin").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang"), "y", "bin", "n")
    out = every.unionByName(found.join(enough, "lang").select("lang", "y", "bin", "n")).collect()  # 2 * BINS rows a language at most
    scratch.drop(found)
    return [(r["lang"], r["y"], r["bin"], r["n"]) for r in out]


def _set_thresholds(model: Model, found: list[tuple[str, int, int, int]], totals: dict[int, int]) -> None:
    """The threshold of each language from counts of scores; those of the sample stay where a label has no such rows."""
    counts: dict[str, np.ndarray] = {}
    for name, y, at, n in found:
        counts.setdefault(name, np.zeros((2, BINS)))[y, at] += n
    every = counts.pop("", np.zeros((2, BINS)))
    if not every.sum(1).all():
        return
    share = np.array([totals[0], totals[1]]) / every.sum(1)
    middle, y = np.tile((np.arange(BINS) + 0.5) / BINS, 2), np.repeat([0, 1], BINS)
    cut = lambda n: _threshold(middle[n.ravel() > 0], y[n.ravel() > 0], (n * share[:, None]).ravel()[n.ravel() > 0])
    model.threshold = cut(every)
    model.thresholds = {name: cut(n) for name, n in counts.items()}


def _threshold(score: np.ndarray, t: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the best cut: weighted F1 of label 1, ties to the value nearest the default, and never below it.

    A score is a probability; where too few labels or a weak fit put the best cut lower, clean documents stay.
    """
    order = np.argsort(-score)
    hits, picked = np.cumsum((weight * t)[order]), np.cumsum(weight[order])
    f1 = 2 * hits / (picked + (weight * t).sum())
    cuts = (score[order] + np.append(score[order][1:], 0)) / 2
    last = np.append(score[order][1:] != score[order][:-1], True)  # rows of one score stay together
    f1, cuts = f1[last], cuts[last]
    good = cuts[f1 >= f1.max() - 1e-9]
    return max(DEFAULT_THRESHOLD, float(good[np.abs(good - DEFAULT_THRESHOLD).argmin()]))


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", out_col: str = "toxicity", reject_col: str = "rejected") -> DataFrame:
    """docs with two columns more: the score of each whole text, a double from 0 to 1, and whether it reaches the
    threshold of the row's language (that of all rows, for a null or unknown language or without such a column).

    Null text scores as the empty text. Columns of the two new names are replaced, all others pass through, whatever
    they are called; repeated rows score alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    names = [c for c in docs.columns if c not in (out_col, reject_col)]
    lang = own(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    inner = docs.select(own(text_col).alias("text"), lang.alias("lang"), packed(names).alias("row"))
    schema = T.StructType([inner.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            score = m.scores(pa.chunked_array([b["text"]]))
            limit = np.array([m.thresholds.get(x, m.threshold) for x in b["lang"].to_pylist()])
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(score, pa.float64()), pa.array(score >= limit, pa.bool_())], names=["row", "score", "rejected"])

    return inner.mapInArrow(run, schema).select(*unpacked("row", names), F.col("score").alias(out_col), F.col("rejected").alias(reject_col))
