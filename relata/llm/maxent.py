"""LM scoring with a hashed maximum-entropy model over classes of words.

All that is learnt covers all training documents; what is gathered grows with them.

1. Counts of all words: each task sends its words' counts to the partition of their hash. Words of at least
   one in ``RARE_SHARE`` tokens (so of bounded number), the most frequent ``VOCABULARY`` of them, are the
   vocabulary. Others are rare; their counts stay dealt by hash.
2. Classes: the ``SINGLES`` most frequent words have one each; the others are clustered by which of these
   stand before them, and each cluster is cut into bins of equal mass. Rare words and the end have one each.
3. Counts of each class after each two classes.
4. A maximum-entropy model of a word's class with hashed features: the class before it (n-gram), the one
   before that (skip), and both (n-gram). Tasks compute the gradient over their part of the contexts; the
   sum updates the weights, which go out again.
5. The probability of a text is the product over its tokens of P(class | two before) and P(word | class);
   class probabilities are a table by then and batches of tokens look them up. Rare words meet their counts
   by hash, and their sums come back by document.

Defined results: null and empty texts are one end token; without training documents N is 0 and probabilities
are those of an unseen word (base) and an untrained model; repeated rows get equal scores; an empty table
gives an empty result; a null id is in fold 0; extra columns stay, but for columns named like the results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relata.llm.arrow import SPACED, add_columns, find_words, map_arrow, mix, text_blocks
from relata.llm.store import cut

RARE_SHARE = 1_000_000
VOCABULARY = 1 << 16
SINGLES = 32
CLUSTERS = 8
BINS = 7
RARE = SINGLES + CLUSTERS * BINS
END = RARE + 1
CLASSES = END + 1
FEATURE_BITS = 14
STEPS = 12
RATE = 2.0
#: Strength of the pull of weights towards 0, in tokens.
RIDGE = 5.0


@dataclass
class WordTable:
    """Word hash to number, by open addressing at a sixteenth of the slots."""

    slots: np.ndarray
    numbers: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray) -> WordTable:
        size = 1 << max(10, int(16 * len(hashes)).bit_length())
        slots, numbers = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left = np.arange(len(hashes))
        at = (hashes & np.uint64(size - 1)).astype(np.int64)
        while len(left):
            free = numbers[at[left]] < 0
            numbers[at[left][free]] = left[free]  # the last of those at one slot stays
            slots[at[left][free]] = hashes[left[free]]
            left = left[numbers[at[left]] != left]
            at[left] = (at[left] + 1) % size
        return WordTable(slots, numbers)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 if it has none."""
        mask = np.uint64(len(self.slots) - 1)
        at = (h & mask).astype(np.int64)
        out = np.where(self.slots[at] == h, self.numbers[at], -1)
        left = np.flatnonzero((self.slots[at] != h) & (self.numbers[at] >= 0))
        while len(left):
            at[left] = (at[left] + 1) % len(self.slots)
            same = self.slots[at[left]] == h[left]
            out[left[same]] = self.numbers[at[left[same]]]
            left = left[~same & (self.numbers[at[left]] >= 0)]
        return out


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)


def _split(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal (sorted) keys."""
    if len(keys):
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        yield from zip(first.tolist(), [*first[1:].tolist(), len(keys)])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    found, inverse = np.unique(every, return_inverse=True)
    return found, np.bincount(inverse, np.concatenate(counts) if counts else None, len(found)).astype(np.int64)


def word_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, payload: hashes, then counts as int64) of all words of texts (text), each bucket in one row or a few."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                k, c = np.unique(find_words(data, offsets, SPACED).hash, return_counts=True)
                keys.append(k)
                counts.append(c)
                if len(keys) > 32:
                    k, c = _summed(keys, counts)
                    keys, counts = [k], [c]
        k, c = _summed(keys, counts)
        bucket = (k % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        k, c, bucket = k[order], c[order], bucket[order]
        yield _rows([(int(bucket[a]), k[a:b].tobytes() + c[a:b].tobytes()) for a, b in _split(bucket)], ["bucket", "payload"], [pa.int64(), pa.binary()])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = own.setdefault(bucket, ([], []))
                n = len(payload) // 16
                keys.append(np.frombuffer(payload, np.uint64, n))
                counts.append(np.frombuffer(payload, np.int64, n, 8 * n))
        for bucket, (keys, counts) in own.items():
            k, c = _summed(keys, counts)
            yield _rows([(bucket, k.tobytes() + c.tobytes(), len(k), int(c.sum()))], ["bucket", "payload", "words", "tokens"], [pa.int64(), pa.binary(), pa.int64(), pa.int64()])

    return map_arrow(map_arrow(texts, send, "bucket long, payload binary").repartition("bucket"), gather, "bucket long, payload binary, words long, tokens long")


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(payload) // 16
    return np.frombuffer(payload, np.uint64, n), np.frombuffer(payload, np.int64, n, 8 * n)


def _frequent(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of at least `least` tokens, at most RARE_SHARE of them; the VOCABULARY most frequent, those first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                k, c = _unpacked(payload)
                yield _rows([(k[c >= least].tobytes() + c[c >= least].tobytes(),)], ["payload"], [pa.binary()])

    found = [_unpacked(r.payload) for r in map_arrow(counts.select("payload"), run, "payload binary").collect()]
    k = np.concatenate([np.zeros(0, np.uint64), *(a for a, _ in found)])
    c = np.concatenate([np.zeros(0, np.int64), *(b for _, b in found)])
    order = np.lexsort((k, -c))[:VOCABULARY]
    return k[order], c[order]


Counter = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _sum_cells(texts: DataFrame, table: WordTable, size: int, cells: Counter) -> np.ndarray:
    """Sum of 1 at cells(word numbers, first word of each text) over all texts; size is bounded by the model's."""
    width = -(-size // 16)
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                w = find_words(data, offsets, SPACED)
                total += np.bincount(cells(shared.value.find(w.hash), w.first), minlength=size)
        rows = []
        for b in range(16):
            part = total[b * width : (b + 1) * width]
            some = np.flatnonzero(part)
            if len(some):
                rows.append((b, some.astype(np.int32).tobytes() + part[some].tobytes()))
        yield _rows(rows, ["bucket", "payload"], [pa.int64(), pa.binary()])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(payload) // 12
                own.setdefault(bucket, np.zeros(width, np.int64))[np.frombuffer(payload, np.int32, n)] += np.frombuffer(payload, np.int64, n, 4 * n)
        yield _rows([(b, t.tobytes()) for b, t in own.items()], ["bucket", "payload"], [pa.int64(), pa.binary()])

    out = np.zeros(16 * width, np.int64)
    for r in map_arrow(map_arrow(texts, send, "bucket long, payload binary").repartition(16, "bucket"), gather, "bucket long, payload binary").collect():
        out[r.bucket * width : (r.bucket + 1) * width] = np.frombuffer(r.payload, np.int64)
    return out[:size]


def _kmeans(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Cluster of each (unit-length) row; centres start at the heaviest row and those least like the ones before."""
    centres = [int(weight.argmax())]
    near = x @ x[centres[0]]
    for _ in range(1, min(k, len(x))):
        centres.append(int((np.sqrt(weight) * (1 - near)).argmax()))
        near = np.maximum(near, x @ x[centres[-1]])
    c = x[centres]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            mean = (x[own == j] * weight[own == j, None]).sum(0)
            if np.linalg.norm(mean) > 0:
                c[j] = mean / np.linalg.norm(mean)
    return own


def _neighbours(number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Cells (word, which single word is before it; SINGLES: another, or none) of words of the vocabulary."""
    before = np.full(len(number), SINGLES)
    before[1:] = np.where((number[:-1] >= 0) & (number[:-1] < SINGLES), number[:-1], SINGLES)
    starts = first[:-1][first[:-1] < len(number)]
    before[starts] = SINGLES
    some = number >= 0
    return number[some].astype(np.int64) * (SINGLES + 1) + before[some]


def _classes(seen: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Class of each word of the vocabulary (most frequent first)."""
    out = np.arange(len(counts))
    rest = np.arange(SINGLES, len(counts))
    if not len(rest):
        return out.astype(np.int16)
    x = np.sqrt(seen[rest].astype(np.float32))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    cluster = _kmeans(x, counts[rest].astype(np.float64), CLUSTERS)
    for k in range(CLUSTERS):
        own = rest[cluster == k]
        if len(own):
            mass = np.cumsum(counts[own])
            out[own] = SINGLES + k * BINS + np.minimum((mass - counts[own]) * BINS // mass[-1], BINS - 1)
    return out.astype(np.int16)


def token_classes(number: np.ndarray, first: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token, an end after each text, and the context (two classes before, as one number); then the place of each text's end."""
    n = len(first) - 1
    ends = first[1:] + np.arange(n)
    is_end = np.zeros(len(number) + n, bool)
    is_end[ends] = True
    c = np.full(len(is_end), END, np.int64)
    c[~is_end] = np.where(number >= 0, classes[np.maximum(number, 0)] if len(classes) else RARE, RARE)
    one = np.concatenate([[END], c[:-1]])
    two = np.concatenate([[END], one[:-1]])
    starts = ends - np.diff(first)  # a text's first token
    two[(starts + 1)[starts < ends]] = END  # its second one sees one word and the start
    two[starts] = END
    return c, two * CLASSES + one, ends


def _features() -> np.ndarray:
    """Hashed features of each context: bias, class before, skip, both."""
    two, one = np.divmod(np.arange(CLASSES * CLASSES, dtype=np.uint64), np.uint64(CLASSES))
    hashed = lambda kind, x: (mix(x + np.uint64(kind << 32)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    return np.stack([hashed(1, one * np.uint64(0)), hashed(2, one), hashed(3, two), hashed(4, two * np.uint64(CLASSES) + one)], 1)


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def train(spark, after: np.ndarray) -> np.ndarray:  # noqa: ANN001
    """Log10 probability of each class in each context, from counts `after` (context, class).

    Each step is a job: every task computes the gradient over its contexts.
    """
    features = _features()
    own = np.flatnonzero(after.sum(1))
    weights = np.zeros((1 << FEATURE_BITS, CLASSES), np.float32)
    total = after.sum(0) + 1.0
    weights[features[0, 0]] = np.log(total / total.sum())
    if len(own):
        mass = np.zeros(len(weights))
        for f in range(features.shape[1]):
            np.add.at(mass, features[own, f], after[own].sum(1))
        rows = spark.createDataFrame([(int(k), after[k].tobytes()) for k in own], "context long, counts binary")
        rows = cut(rows.repartition(4))
        for _ in range(STEPS):
            shared = spark.sparkContext.broadcast(weights)

            def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                w, out = shared.value, np.zeros((1 << FEATURE_BITS, CLASSES), np.float32)
                for batch in batches:
                    if not len(batch):
                        continue
                    f = features[batch.column(0).to_numpy()]
                    counts = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(len(batch), CLASSES)
                    p = np.exp(_log_softmax(w[f].sum(1)))
                    g = counts - p * counts.sum(1, keepdims=True)
                    for k in range(f.shape[1]):
                        np.add.at(out, f[:, k], g.astype(np.float32))
                some = np.flatnonzero(np.abs(out).sum(1))
                yield _rows([(some.tobytes(), out[some].tobytes())], ["rows", "values"], [pa.binary(), pa.binary()])

            g = np.zeros_like(weights)
            for r in map_arrow(rows, gradient, "rows binary, values binary").collect():  # bounded by the model's size
                g[np.frombuffer(r.rows, np.int64)] += np.frombuffer(r["values"], np.float32).reshape(-1, CLASSES)
            weights = weights + (RATE * (g - RIDGE * weights) / (mass + RIDGE)[:, None]).astype(np.float32)
            weights[mass == 0] = 0
            shared.destroy()
    return (_log_softmax(weights[features].sum(1)) / np.log(10)).astype(np.float32)


@dataclass
class Model:
    table: WordTable
    counts: np.ndarray  # of the vocabulary
    classes: np.ndarray
    transitions: np.ndarray  # log10 P(class | context)
    inside: np.ndarray  # log10 P(word | class)
    tokens: int  # N, ends included
    words: int  # V, the end included
    documents: int
    rare_tokens: int
    rare_words: int


def learn(texts: DataFrame, counts: DataFrame) -> Model:
    """A model of the training texts (text), whose word_counts are counts."""
    spark = texts.sparkSession
    sums = counts.agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()
    documents = texts.count()
    tokens, words = (sums.n or 0) + documents, (sums.v or 0) + (documents > 0)
    hashes, c = _frequent(counts, max(2, -(-tokens // RARE_SHARE)))
    table = WordTable.of(hashes)
    seen = _sum_cells(texts, table, max(1, len(c) * (SINGLES + 1)), _neighbours)[: len(c) * (SINGLES + 1)].reshape(len(c), SINGLES + 1)
    classes = _classes(seen, c)

    def following(number: np.ndarray, first: np.ndarray) -> np.ndarray:
        own, context, _ = token_classes(number, first, classes)
        return context * CLASSES + own

    after = _sum_cells(texts, table, CLASSES**3, following).reshape(CLASSES**2, CLASSES)
    in_class = np.bincount(classes, c, CLASSES) if len(c) else np.zeros(CLASSES)
    inside = np.log10(c / in_class[classes]) if len(c) else np.zeros(0)
    return Model(table, c, classes, train(spark, after), inside, tokens, words, documents, tokens - documents - int(c.sum()), words - (documents > 0) - len(c))


_DEALT = "bucket long, kind int, payload binary"


def _sum_rows(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _score_frequent(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """docs with what the vocabulary tells of each text, in columns __n_words, __n_rare, __known, __base, __model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY words

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m, out = shared.value, []
        for _, _, data, offsets in text_blocks(batch.column(batch.schema.get_field_index(text))):
            w = find_words(data, offsets, SPACED)
            number = m.table.find(w.hash)
            known = number >= 0
            own, context, ends = token_classes(number, w.first, m.classes)
            moves = m.transitions[context, own].astype(np.float64)
            by_text = _sum_rows(moves, np.concatenate([[0], ends + 1]))
            at = np.maximum(number, 0)
            inside = np.where(known, m.inside[at], 0.0) if len(m.inside) else np.zeros(len(number))
            base = np.where(known, np.log10(m.counts[at] + 1.0), 0.0) if len(m.counts) else np.zeros(len(number))
            n_known = _sum_rows(known.astype(np.float64), w.first)
            out.append((w.counts, w.counts - n_known, n_known, _sum_rows(base, w.first), by_text + _sum_rows(inside, w.first)))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0)] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return {f"__{k}": pa.array(c.astype(np.float64 if t == pa.float64() else np.int64), t) for k, c, t in zip(("n_words", "n_rare", "known", "base", "model"), columns, kinds)}

    return add_columns(docs, make, "__n_words long, __n_rare long, __known long, __base double, __model double")


def _send_rare(docs: DataFrame, model: Model, text: str, buckets: int) -> DataFrame:
    """Rare words of each text: (bucket, kind 1, payload: hash, key, number of times)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_numpy(), []
            for lo, _, data, offsets in text_blocks(batch.column(1)):
                w = find_words(data, offsets, SPACED)
                rare = np.flatnonzero(shared.value.find(w.hash) < 0)
                found.append((w.hash[rare], ids[lo + np.repeat(np.arange(len(offsets) - 1), w.counts)[rare]]))
            h, key = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((h, key, bucket))
            h, key, bucket = h[order], key[order], bucket[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])[: len(h)])
            times = np.diff(np.append(new, len(h))).astype(np.int32)
            h, key, bucket = h[new], key[new], bucket[new]
            yield _rows([(int(bucket[a]), 1, h[a:b].tobytes() + key[a:b].tobytes() + times[a:b].tobytes()) for a, b in _split(bucket)], ["bucket", "kind", "payload"], [pa.int64(), pa.int32(), pa.binary()])

    return map_arrow(docs.select("__key", text), run, _DEALT)


_SUMS = {"key": np.int64, "times": np.int64, "known": np.int64, "base": np.float64, "model": np.float64}


def _score_rare(dealt: DataFrame, model: Model, buckets: int) -> DataFrame:
    """Sums over rare words by key, from their counts (kind 0) and places (kind 1), a bucket in one task.

    A text's words are in many buckets, so the sums go packed to the bucket of the key and are added there.
    """
    bottom = np.log10(model.rare_tokens + model.rare_words + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[np.ndarray] = [np.zeros(0, np.uint64)]
        counts: list[np.ndarray] = [np.zeros(0, np.int64)]
        h, key, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for batch in batches:
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind == 0:
                    k, c = _unpacked(payload)
                    words.append(k)
                    counts.append(c)
                else:
                    n = len(payload) // 20
                    h.append(np.frombuffer(payload, np.uint64, n))
                    key.append(np.frombuffer(payload, np.int64, n, 8 * n))
                    times.append(np.frombuffer(payload, np.int32, n, 16 * n))
        k, c = np.concatenate(words), np.concatenate(counts)
        order = np.argsort(k)
        k, c = k[order], c[order]
        h_, key_, n = np.concatenate(h), np.concatenate(key), np.concatenate(times).astype(np.int64)
        if not len(h_):
            return
        at = np.minimum(np.searchsorted(k, h_), max(len(k) - 1, 0))
        count = np.where(k[at] == h_, c[at], 0) if len(k) else np.zeros(len(h_), np.int64)
        keys, inverse = np.unique(key_, return_inverse=True)
        by = lambda x: np.bincount(inverse, x, len(keys))
        logs = np.log10(count + 1.0)
        sums = [keys, by(n).astype(np.int64), by(n * (count > 0)).astype(np.int64), by(n * logs), by(n * (logs - bottom))]
        bucket = keys % buckets
        order = np.argsort(bucket, kind="stable")
        sums, bucket = [x[order] for x in sums], bucket[order]
        yield _rows([(int(bucket[a]), b"".join(x[a:b].tobytes() for x in sums)) for a, b in _split(bucket)], ["bucket", "payload"], [pa.int64(), pa.binary()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in _SUMS.values()]
        for batch in batches:
            for payload in batch.column(1).to_pylist():
                n = len(payload) // 40
                for k, (part, t) in enumerate(zip(parts, _SUMS.values())):
                    part.append(np.frombuffer(payload, t, n, 8 * n * k))
        key, *values = map(np.concatenate, parts)
        keys, inverse = np.unique(key, return_inverse=True)
        added = [np.bincount(inverse, v, len(keys)).astype(v.dtype) for v in values]
        yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, added)], ["__key", *(f"__r_{c}" for c in list(_SUMS)[1:])])

    sums = map_arrow(dealt, run, "bucket long, payload binary").repartition("bucket")
    return map_arrow(sums, add, "__key long, __r_times long, __r_known long, __r_base double, __r_model double")


def score_documents(docs: DataFrame, may_learn: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score (log10), learnt from the rows where may_learn."""
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.where(may_learn).select(text)
    counts = cut(word_counts(texts, buckets))
    model = learn(texts, counts)
    keyed = docs.withColumn("__key", F.xxhash64(doc_id, text))
    dealt = _send_rare(keyed, model, text, buckets).unionByName(counts.select("bucket", F.lit(0).alias("kind"), "payload"))
    rare = _score_rare(dealt.repartition("bucket"), model, buckets // 8)
    out = _score_frequent(keyed, model, text).drop(text).join(rare, "__key", "left")
    # rows that are equal in id and text have one key: their sums came together
    copies = F.greatest(F.lit(1), F.round(F.coalesce("__r_times", F.lit(0)) / F.greatest("__n_rare", F.lit(1))))
    own = lambda c: F.coalesce(F.col(f"__r_{c}") / copies, F.lit(0.0))
    n = F.col("__n_words") + 1
    end_base = float(np.log10(model.documents + 1.0))
    below = float(np.log10(model.tokens + (model.words + 1)))
    return out.withColumns({
        "n_tokens": n.cast("long"),
        "n_known": (F.col("__known") + F.round(own("known")) + int(model.documents > 0)).cast("long"),
        "train_tokens": F.lit(model.tokens).cast("long"),
        "base_score": F.col("__base") + own("base") + end_base - n * below,
        "score": F.col("__model") + own("model"),
    }).drop("__key", "__n_words", "__n_rare", "__known", "__base", "__model", "__r_times", "__r_known", "__r_base", "__r_model")
