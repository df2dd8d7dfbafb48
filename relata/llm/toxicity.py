"""Toxicity by maximum-scoring segments of token log-odds.

Learning, on a bounded sample of labelled documents (``SAMPLE`` rows of either class, chosen by a hash of their
ids; written once, so the corpus is scanned once):

* Token log-odds between toxic and other documents. Each word's Dirichlet prior is the estimate of its
  six-byte prefix, whose prior is that of its five- and four-byte prefixes, down to the share of all tokens;
  so inflected and unseen forms of a known stem score too. Only log-odds of at least ``Z`` standard errors
  count.
* Background: the scores of tokens of other documents give the exponent lambda of the extreme-value law of
  segment scores (the positive root of E[exp(lambda * score)] = 1); the maxima of their texts give its constant
  K by maximum likelihood (a text of n words stays below x with probability exp(-K n exp(-lambda x))).
* Calibration: a logistic regression, on documents that the log-odds haven't seen, from a document's
  extreme-value measures to its label.

Scoring: every word of every document scores its log-odds less ``DRIFT``, words without evidence -DRIFT. A
linear-time scan finds all maximal scoring segments; those with an E-value of at most ``E_VALUE`` are passages.

Defined results: null and empty texts have no tokens and get the score of a text without evidence; where a
class has no labelled rows, every score is the share of toxic rows (0 without any); repeated rows get equal
scores; repeated labels of one document: toxic if any says so; an empty table gives an empty result; extra
columns stay, but for columns named like the results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relata.llm.arrow import LETTERS, LOWER, Words, add_columns, find_words, map_arrow, prefix_sums, slices_hash, text_blocks
from relata.llm.store import cut

#: Most labelled rows of either class that are learnt from.
SAMPLE = 20_000
PREFIXES = (4, 5, 6)
#: Strength of a prior, in tokens.
PRIOR = 4.0
Z = 3.5
DRIFT = 1.0
E_VALUE = 0.01
#: Where the background has few maxima, the constant K counts as seen once at this value.
SHAPE = 0.1
#: Scores are counted in bins of this width for lambda.
BIN = 1e-3
THRESHOLD = 0.7

PASSAGES = "array<struct<first_word: int, last_word: int, score: double, e_value: double>>"


@dataclass
class Lexicon:
    """Sorted feature hashes (of all levels) and their log-odds."""

    hash: np.ndarray
    odds: np.ndarray
    seen: np.ndarray  # which low 16 bits occur

    @staticmethod
    def of(hashes: np.ndarray | list[int], odds: np.ndarray | list[float]) -> Lexicon:
        h = np.array(hashes, np.int64).view(np.uint64)
        order = np.argsort(h)
        seen = np.zeros(1 << 16, bool)
        seen[(h & np.uint64(0xFFFF)).astype(np.int64)] = True
        return Lexicon(h[order], np.array(odds, np.float64)[order], seen)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are in the lexicon, and their log-odds."""
        some = np.flatnonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(some) or not len(self.hash):
            return some[:0], self.odds[:0]
        at = np.minimum(np.searchsorted(self.hash, h[some]), len(self.hash) - 1)
        hit = self.hash[at] == h[some]
        return some[hit], self.odds[at[hit]]


def _levels(data: np.ndarray, w: Words) -> list[np.ndarray]:
    """Hashes of each word's prefixes and of the word, told apart by level."""
    sums = prefix_sums(LOWER[data])
    out = [slices_hash(sums, w.start, np.minimum(w.end, w.start + n)) for n in PREFIXES]
    return [h * np.uint64(2 * k + 3) for k, h in enumerate([*out, w.hash])]


def token_scores(data: np.ndarray, w: Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Words with a positive score, and the scores: the longest known feature decides."""
    odds = np.zeros(len(w.start))
    for h in _levels(data, w):
        at, value = lexicon.find(h)
        odds[at] = value
    at = np.flatnonzero(odds > DRIFT)
    return at, odds[at] - DRIFT


def maximal_segments(places: np.ndarray, scores: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text.

    places: words with positive scores; each word between scores -drift. Linear time: every candidate
    segment is put on the list or joined to an earlier one, once.
    """
    # a candidate: first, last, total before it, total with it
    found: list[tuple[int, int, float, float]] = []
    total, before = 0.0, -1
    for place, score in zip(places.tolist(), scores.tolist()):
        total -= drift * (place - before - 1)
        now = (place, place, total, total + score)
        total, before = now[3], place
        while found:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= now[2]:  # the next one to the left that starts lower
                k -= 1
            if k < 0 or found[k][3] >= now[3]:
                break
            now = (found[k][0], now[1], found[k][2], now[3])
            del found[k:]
        found.append(now)
    return [(a, b, high - low) for a, b, low, high in found]


def _measures(segments: list[tuple[int, int, float]], n: int, rate: float, shape: float) -> tuple[list[tuple[int, int, float, float]], float, float]:
    """Passages with their E-values; the least likely count of high segments, as -log of its chance; the log of all surpluses.

    By chance, the segments of at least some score are Poisson, their mean the E-value of that score. So
    many segments that are nothing special alone count in a long text.
    """
    chance = np.log(shape * max(n, 1))
    surplus = [rate * s - chance for *_, s in segments]
    passages = [(a, b, s, float(np.exp(-x))) for (a, b, s), x in zip(segments, surplus) if x >= -np.log(E_VALUE)]
    best = 0.0
    for r, x in enumerate(sorted(surplus, reverse=True), 1):
        e = np.exp(-x)
        if e < r:  # Chernoff bound of r or more where e are expected
            best = max(best, r * (np.log(r) + x) - r + e)
    return passages, float(best), float(np.log1p(sum(x for x in surplus if x > 0)))


def _counts(rows: DataFrame) -> DataFrame:
    """(h0..h2 prefixes, h3 word, n1, n0): tokens of toxic and of other documents."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in text_blocks(batch.column(0)):
                w = find_words(data, offsets, LETTERS)
                own = np.repeat(toxic[lo : lo + len(offsets) - 1], w.counts)
                levels = _levels(data, w)
                _, first, inverse = np.unique(levels[-1], return_index=True, return_inverse=True)
                n1 = np.bincount(inverse, own, len(first)).astype(np.int64)
                n0 = np.bincount(inverse, 1 - own, len(first)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(h[first].view(np.int64)) for h in levels), pa.array(n1), pa.array(n0)], ["h0", "h1", "h2", "h3", "n1", "n0"])

    return map_arrow(rows.select("text", "toxic"), run, "h0 long, h1 long, h2 long, h3 long, n1 long, n0 long").groupBy("h0", "h1", "h2", "h3").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Log-odds from labelled rows (text, toxic 0 or 1), of all features that have evidence or are below one that has.

    Each level meets the one above it by key, so no key has more rows than it has continuations.
    """
    words = cut(_counts(rows))
    total = words.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).first()
    if not total.n1 or not total.n0:
        return Lexicon.of([], [])
    share = total.n1 / (total.n1 + total.n0)
    base = float(np.log(share / (1 - share)))
    # from words up: each feature with that above it
    levels = [words.select(F.col("h3").alias("h"), F.col("h2").alias("up"), "h1", "h0", "n1", "n0")]
    for up in ("h1", "h0", None):
        below = levels[0].groupBy(F.col("up").alias("h")).agg(*[F.min(c).alias(c) for c in ("h1", "h0")], F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        levels.insert(0, below.withColumn("up", F.col(up) if up else F.lit(None).cast("long")))
    entries, parents = [], None
    for level in levels:
        if parents is None:
            out = level.withColumns({"prior": F.lit(share), "above": F.lit(False)})
        else:
            out = level.join(parents, "up")
        p = (F.col("n1") + PRIOR * F.col("prior")) / (F.col("n1") + F.col("n0") + PRIOR)
        out = out.withColumn("p", p).withColumn("o", F.log(F.col("p") / (1 - F.col("p"))) - base)
        error = F.sqrt(1 / (F.col("n1") + PRIOR * F.col("prior")) + 1 / (F.col("n0") + PRIOR * (1 - F.col("prior"))))
        # a feature without enough evidence passes its prefix's estimate on; below a good prefix, all are listed
        good = (F.col("o") > DRIFT) & (F.col("o") / error >= Z)
        out = cut(out.select("h", "p", "o", (F.col("above") | good).alias("good")))
        entries.append(out.where("good").select("h", "o"))
        parents = out.select(F.col("h").alias("up"), F.col("p").alias("prior"), F.col("good").alias("above"))
    found = entries[0].unionByName(entries[1]).unionByName(entries[2]).unionByName(entries[3]).toArrow()  # of the bounded sample
    return Lexicon.of(found.column("h").to_numpy(), found.column("o").to_numpy())


@dataclass
class Model:
    lexicon: Lexicon
    rate: float  # lambda
    shape: float  # K
    weights: np.ndarray  # of 1 and the two measures

    def score(self, best: float, summed: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights @ np.array([1.0, np.log1p(best), summed]), -30, 30))))


def _rate(scores: np.ndarray, times: np.ndarray, n_tokens: int) -> float:
    """lambda of a background with these positive scores so many times among n_tokens, all others -DRIFT."""
    scores, times = np.append(scores, 5.0), np.append(times, 1.0)  # one toxic token unseen
    share = 1 / max(n_tokens + 1, 2)
    lo, hi = 1e-6, 50.0
    for _ in range(100):
        mid = (lo + hi) / 2
        value = share * (times * np.exp(np.minimum(mid * scores, 600))).sum() + (1 - share * times.sum()) * np.exp(-mid * DRIFT)
        lo, hi = (mid, hi) if value < 1 else (lo, mid)
    return lo


def _shape(maxima: np.ndarray, n: np.ndarray, rate: float) -> float:
    """K from the highest segment of each background text of n words (0: none has a positive score)."""
    some = maxima > 0
    least = maxima[some].min() if some.any() else 1.0  # texts without a segment stayed below it
    return float((some.sum() + 1) / ((n * np.exp(-rate * np.where(some, maxima, least))).sum() + 1 / SHAPE))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from the labelled rows of docs; may_learn: condition on the labels' doc_id."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(may_learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    # at most `sample` rows of each class: small enough to send everywhere
    chosen = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]).withColumn("check", F.pmod(order, F.lit(4)) == 0).withColumnRenamed("doc_id", "__id"))
    rows = cut(docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(ids, "__id").select("text", "toxic", "check"))
    lexicon = learn_lexicon(rows.where("NOT check"))
    checked = rows.where("check").select("text", "toxic")

    def measured(make, ddl: str) -> DataFrame:  # noqa: ANN001
        """Rows that make(toxic, words, places with a positive score, scores) gives for each checked text."""

        def run(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                toxic, out = batch.column(1).to_pylist(), []
                for lo, _, data, offsets in text_blocks(batch.column(0)):
                    w = find_words(data, offsets, LETTERS)
                    at, score = token_scores(data, w, lexicon)
                    edge = np.searchsorted(at, w.first).tolist()
                    for k, (a, b, first, n) in enumerate(zip(edge, edge[1:], w.first.tolist(), w.counts.tolist())):
                        out += make(toxic[lo + k], n, at[a:b] - first, score[a:b])
                yield pa.RecordBatch.from_pylist(out, schema)

        names = [c.split() for c in ddl.split(", ")]
        schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[t]) for n, t in names])
        return map_arrow(checked, run, ddl)

    def binned(toxic: int, n: int, at: np.ndarray, score: np.ndarray) -> list[dict]:
        bins, times = np.unique(np.round(score / BIN).astype(np.int64), return_counts=True)
        return [{"toxic": toxic, "bin": b, "n": t} for b, t in zip([-1, *bins.tolist()], [n, *times.tolist()])]

    def highest(toxic: int, n: int, at: np.ndarray, score: np.ndarray) -> list[dict]:
        return [] if toxic else [{"n": n, "top": max((s for *_, s in maximal_segments(at, score)), default=0.0)}]

    bins = measured(binned, "toxic int, bin long, n long").groupBy("toxic", "bin").agg(F.sum("n").alias("n")).collect()  # bounded by the range of log-odds
    classes = {r.toxic for r in bins}
    if len(classes) < 2 or not len(lexicon.hash):
        shares = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        share = shares.get(1, 0) / max(1, sum(shares.values()))
        return Model(lexicon, 1.0, SHAPE, np.array([np.log(max(share, 1e-13) / max(1 - share, 1e-13)), 0.0, 0.0]))
    background = [(r.bin, r.n) for r in bins if not r.toxic]
    hits = np.array([(b * BIN, n) for b, n in background if b >= 0], float).reshape(-1, 2)
    rate = _rate(hits[:, 0], hits[:, 1], sum(n for b, n in background if b < 0))
    maxima = measured(highest, "n long, top double").toArrow()  # a row each of a quarter of the sample
    shape = _shape(maxima.column("top").to_numpy(), maxima.column("n").to_numpy(), rate)

    def weighed(toxic: int, n: int, at: np.ndarray, score: np.ndarray) -> list[dict]:
        _, best, summed = _measures(maximal_segments(at, score), n, rate, shape)
        return [{"toxic": toxic, "best": best, "summed": summed}]

    x = measured(weighed, "toxic int, best double, summed double").toArrow()  # likewise
    return Model(lexicon, rate, shape, _logistic(np.stack([np.ones(len(x)), np.log1p(x.column("best").to_numpy()), x.column("summed").to_numpy()], 1), x.column("toxic").to_numpy().astype(float)))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with score, predicted and passages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        model, score, passages = shared.value, [], []
        for _, _, data, offsets in text_blocks(batch.column(batch.schema.get_field_index(text))):
            w = find_words(data, offsets, LETTERS)
            at, value = token_scores(data, w, model.lexicon)
            edge = np.searchsorted(at, w.first).tolist()
            nothing = model.score(0.0, 0.0)
            for a, b, first, n in zip(edge, edge[1:], w.first.tolist(), w.counts.tolist()):
                if a == b:
                    score.append(nothing)
                    passages.append([])
                    continue
                found, best, summed = _measures(maximal_segments(at[a:b] - first, value[a:b]), n, model.rate, model.shape)
                score.append(model.score(best, summed))
                passages.append([dict(zip(("first_word", "last_word", "score", "e_value"), p)) for p in found])
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
        return {"score": pa.array(score, pa.float64()), "predicted": pa.array([int(s >= THRESHOLD) for s in score], pa.int32()), "passages": pa.array(passages, kind)}

    return add_columns(docs if keep is None else docs.select(*dict.fromkeys([*keep, text])), make, f"score double, predicted int, passages {PASSAGES}", keep)
