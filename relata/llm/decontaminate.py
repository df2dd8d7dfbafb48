"""Benchmark decontamination with suffix arrays over the training texts.

Every block of documents (a shard of the corpus) gets a suffix array over its words: the suffixes that begin
with words which begin some benchmark window are sorted by their next ``WINDOW`` words. (Other suffixes can
hold no match, so the array is sparse.) The test suffixes that begin with the same words as one of these are
binary-searched in it; the ranges found give the places of verbatim matches, which join along their diagonals
into the longest ones. A document word inside any match is hit; documents with enough hit words are contaminated.

The benchmark needn't fit into memory: its words come to the driver in pieces, and of every ``BLOCK_WORDS`` of
them the sorted test suffixes are written to a file (about 40 bytes a word). Spark ships the file to executors, where
workers map it into memory, so one pass over the documents sees all blocks. Beyond ``PASS_WORDS`` there are more
files and passes; then only hits are kept between passes and meet their documents by the hash of the text.

Defined results: null texts have no words and no hits; an item without words has no window; an item of fewer
than 13 words is one window; repeated rows (and items with equal texts) each count; an item without id hits, but
isn't listed or counted; an empty benchmark hits nothing; an empty document table gives an empty result; extra
columns stay, but for columns named like the results.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.arrow import LETTERS, Words, add_columns, find_words, map_arrow, mix, row_blocks, text_blocks, text_bytes
from relata.llm.store import cut, free, own_dir, ship_file

WINDOW = 13
#: Most words (and windows) of a block of the benchmark, and of a pass over the documents.
BLOCK_WORDS = 1 << 20
PASS_WORDS = 1 << 24
#: Words of an item in one row on the way to the driver.
CHUNK_WORDS = 1 << 15
#: Occurrences that are spread over the items of their window at once.
SPREAD = 1 << 20
#: Windows of items with fewer words than this have blocks of their own, by their number of words.
DEPTH = 3

MATCH = "array<struct<item_id: long, item_word: int, doc_word: int, n_words: int>>"
NO_ID = np.iinfo(np.int64).min


@dataclass
class Queries:
    """The test suffixes of a block of items, sorted for the search."""

    vocabulary: np.ndarray  # sorted hashes of the items' words; id = place + 1
    ids: np.ndarray  # word ids of the items, WINDOW zeros after each
    windows: np.ndarray  # places in ids of the distinct windows, in order
    starts: np.ndarray  # sorted hashes of the first `depth` word ids of all windows
    start_low: np.ndarray  # windows start_low[k] : start_high[k] begin with start k
    start_high: np.ndarray
    owner_first: np.ndarray  # window k belongs to owners owner_first[k] : owner_first[k + 1]
    owner_item: np.ndarray
    owner_word: np.ndarray
    depth: int

    def rows(self, k: np.ndarray) -> np.ndarray:
        """The WINDOW ids of windows; 0 after the last."""
        return self.ids[self.windows[k][:, None] + np.arange(WINDOW)]


_ARRAYS = [(f.name, t) for f, t in zip(fields(Queries), (np.uint64, np.int32, np.int32, np.uint64, np.int32, np.int32, np.int32, np.int64, np.int32))]


def _gram_hash(ids: np.ndarray, depth: int) -> np.ndarray:
    """Hash of ids[..., :depth] along the last axis."""
    h = np.zeros(ids.shape[:-1], np.uint64)
    for k in range(depth):
        h = mix(h + ids[..., k].astype(np.uint64) + np.uint64(k + 1))
    return h


def build_queries(items: list[tuple[int, int, np.ndarray]], depth: int = DEPTH) -> Queries:
    """Windows of (item id, first word, word hashes), all of at least `depth` words; equal windows are one."""
    vocabulary = np.unique(np.concatenate([h for *_, h in items])) if items else np.zeros(0, np.uint64)
    ids = np.zeros(sum(len(h) + WINDOW for *_, h in items) + WINDOW, np.int32)
    place, owner, word, at = [], [], [], 0
    for item, first, h in items:
        ids[at : at + len(h)] = np.searchsorted(vocabulary, h) + 1
        n = max(1, len(h) - WINDOW + 1)
        place.append(np.arange(at, at + n))
        owner.append(np.full(n, item))
        word.append(np.arange(first, first + n))
        at += len(h) + WINDOW
    at, owner, word = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (place, owner, word))
    # order of the next 2, 4, 8 and WINDOW words of every place, by pairs of ranks
    rank, size = ids.astype(np.int64), 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        after = np.concatenate([rank[step:], np.zeros(step, np.int64)])
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)
        size += step
    _, first, of = np.unique(rank[at], return_index=True, return_inverse=True)
    order = np.argsort(of, kind="stable")
    q = Queries(vocabulary, ids, at[first].astype(np.int32), *[np.zeros(0, np.uint64)] * 3, np.searchsorted(of[order], np.arange(len(first) + 1)).astype(np.int32), owner[order], word[order].astype(np.int32), depth)
    gram = _gram_hash(q.ids[q.windows[:, None] + np.arange(depth)], depth)
    low = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    by = np.argsort(gram[low])
    q.starts, q.start_low, q.start_high = gram[low][by], low[by].astype(np.int32), np.append(low[1:], len(gram))[by].astype(np.int32) if len(low) else low.astype(np.int32)
    return q


def _save(q: Queries, f) -> None:  # noqa: ANN001
    head = np.array([q.depth, *(len(getattr(q, n)) for n, _ in _ARRAYS)], np.int64)
    f.write(head.tobytes())
    for name, kind in _ARRAYS:
        data = getattr(q, name).astype(kind).tobytes()
        f.write(data + bytes(-len(data) % 8))


def load_queries(path: str) -> list[Queries]:
    """All blocks of a file, mapped into memory."""
    data = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    out, at = [], 0
    while at < len(data):
        depth, *sizes = np.frombuffer(data, np.int64, len(_ARRAYS) + 1, at).tolist()
        at += 8 * (len(_ARRAYS) + 1)
        arrays = []
        for (_, kind), n in zip(_ARRAYS, sizes):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8
        out.append(Queries(*arrays, depth))
    return out


@lru_cache(2)
def _shipped(name: str) -> list[Queries]:
    return load_queries(SparkFiles.get(name))


def _find(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in sorted values, and which are there."""
    if not len(sorted_values):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return at, sorted_values[at] == x


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) of all values of the ranges low : high."""
    n = (high - low).astype(np.int64)
    which = np.repeat(np.arange(len(n)), n)
    return which, low[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]


def _pack(rows: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings that compare like them."""
    return np.ascontiguousarray(rows.astype(">i4")).view(f"S{4 * WINDOW}").ravel() if len(rows) else np.zeros(0, f"S{4 * WINDOW}")


def suffix_array(ids: np.ndarray, doc_end: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the suffixes that may begin a match, in order; their first WINDOW ids (0 past the document); the starts met."""
    padded = np.concatenate([ids, np.zeros(WINDOW, ids.dtype)])
    at = np.flatnonzero(ids)
    for k in range(1, q.depth):
        at = at[padded[at + k] > 0]
    gram = _gram_hash(np.stack([padded[at + k] for k in range(q.depth)], -1), q.depth) if len(at) else np.zeros(0, np.uint64)
    start, hit = _find(q.starts, gram)
    at, start = at[hit], start[hit]
    rows = padded[at[:, None] + np.arange(WINDOW)]
    rows[at[:, None] + np.arange(WINDOW) >= doc_end[at][:, None]] = 0
    order = np.lexsort(rows.T[::-1])
    return at[order], rows[order], np.unique(start)


def find_windows(w: Words, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in a block of texts: window, place of its first word, number of words."""
    at, hit = _find(q.vocabulary, w.hash)
    ids = np.where(hit, at + 1, 0).astype(np.int32)
    at, rows, starts = suffix_array(ids, np.repeat(w.first[1:], w.counts), q)
    _, asked = _ranges(q.start_low[starts], q.start_high[starts])
    suffixes, found = _pack(rows), []
    for k in range(0, len(asked), SPREAD):
        some = asked[k : k + SPREAD]
        own = q.rows(some)
        low = np.searchsorted(suffixes, _pack(own), "left")
        high = np.searchsorted(suffixes, _pack(np.where(own > 0, own, np.iinfo(np.int32).max)), "right")
        which, place = _ranges(low, high)
        found.append((some[which], at[place], (own > 0).sum(1)[which]))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 3


def _chained(doc: np.ndarray, item: np.ndarray, word: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows that follow each other in document and item made one match."""
    order = np.lexsort((place, place - word, item, doc))
    doc, item, word, place, size = doc[order], item[order], word[order], place[order], size[order]
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(place - word) != 0) | (np.diff(place) != 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(doc)) - 1 if len(begin) else begin
    return doc[begin], item[begin], word[begin], place[begin], place[last] + size[last] - place[begin]


def _marked(places: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in some run."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def _pairs(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Distinct (document, item), sorted."""
    order = np.lexsort((item, doc))
    doc, item = doc[order], item[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return np.stack([doc[new], item[new]], 1)


@dataclass
class Hits:
    """What a block of texts has: rows of documents start at 0, places at the block's first word."""

    marked: np.ndarray  # words inside any match
    items: np.ndarray  # (document, item), distinct, sorted
    matches: tuple[np.ndarray, ...]  # document, item, item's word, place, number of words


def find_hits(w: Words, blocks: list[Queries], matches: bool) -> Hits:
    marked, items, runs = np.zeros(len(w.hash), bool), [np.zeros((0, 2), np.int64)], []
    row = np.repeat(np.arange(len(w.counts)), w.counts)
    for q in blocks:
        window, place, size = find_windows(w, q)
        if not len(window):
            continue
        marked |= _marked(place, size, len(marked))
        doc = row[place]
        once = _pairs(doc, window)
        for k in range(0, len(once), SPREAD >> 4):  # each window of a document once, however often it occurs
            part = once[k : k + (SPREAD >> 4)]
            which, own = _ranges(q.owner_first[part[:, 1]], q.owner_first[part[:, 1] + 1])
            items.append(_pairs(part[which, 0], q.owner_item[own]))
        if matches:
            which, own = _ranges(q.owner_first[window], q.owner_first[window + 1])
            runs.append((doc[which], q.owner_item[own], q.owner_word[own].astype(np.int64), place[which], size[which]))
    items = _pairs(*np.concatenate(items).T)
    return Hits(marked, items[items[:, 1] != NO_ID], _chained(*map(np.concatenate, zip(*runs))) if runs else (np.zeros(0, np.int64),) * 5)


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """values grouped by their (ascending) rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _scan(docs: DataFrame, name: str, text: str, matches: bool, runs: bool) -> DataFrame:
    """docs with n_words, n_hit, __hit_items (distinct ids), matches and, if asked for, __runs (hit words: first, last + 1)."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        blocks, n_words, n_hit, items, found, hit_runs = _shipped(name), [], [], [], [], []
        for lo, _, data, offsets in text_blocks(batch.column(batch.schema.get_field_index(text))):
            w = find_words(data, offsets, LETTERS)
            hits = find_hits(w, blocks, matches)
            total = np.concatenate([[0], np.cumsum(hits.marked)])
            n_words.append(w.counts)
            n_hit.append(total[w.first[1:]] - total[w.first[:-1]])
            items.append(hits.items + np.array([lo, 0]))
            doc, item, word, place, size = hits.matches
            found.append((doc + lo, item, word, place - w.first[:-1][doc], size))
            if runs:
                edge = np.zeros(len(hits.marked) + 1, bool)
                edge[w.first[:-1]] = True
                inside = np.append(hits.marked, False)
                begin = np.flatnonzero(inside & (edge | ~np.concatenate([[False], inside[:-1]])))
                end = np.flatnonzero(inside[:-1] & (edge[1:] | ~inside[1:])) + 1
                doc = np.searchsorted(w.first, begin, "right") - 1
                hit_runs.append((doc + lo, begin - w.first[doc], end - w.first[doc]))
        join = lambda parts, k: tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, np.int64),) * k
        doc, item, word, place, size = join(found, 5)
        match = pa.StructArray.from_arrays([pa.array(item, pa.int64(), mask=item == NO_ID), pa.array(word, pa.int32()), pa.array(place, pa.int32()), pa.array(size, pa.int32())], ["item_id", "item_word", "doc_word", "n_words"])
        pairs = np.concatenate(items) if items else np.zeros((0, 2), np.int64)
        both = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        out = {"n_words": both(n_words), "n_hit": both(n_hit), "__hit_items": _lists(pairs[:, 0], len(batch), pa.array(pairs[:, 1], pa.int64())), "matches": _lists(doc, len(batch), match)}
        if runs:
            doc, begin, end = join(hit_runs, 3)
            out["__runs"] = _lists(doc, len(batch), pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["a", "b"]))
        return out

    return add_columns(docs, make, f"n_words long, n_hit long, __hit_items array<long>, matches {MATCH}" + ", __runs array<struct<a: long, b: long>>" * runs)


def _item_words(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(n, item_id, first, words): the hashes of each item's words in pieces that overlap by a window; n: words up to WINDOW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_blocks(offsets):
                w = find_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], LETTERS)
                for k in range(hi - lo):
                    h = w.hash[w.first[k] : w.first[k + 1]]
                    at = range(0, max(1, len(h) - WINDOW + 1), CHUNK_WORDS) if len(h) else ()
                    out = [{"n": min(len(h), WINDOW), "item_id": ids[lo + k], "first": a, "words": h[a : a + CHUNK_WORDS + WINDOW - 1].tobytes()} for a in at]
                    if out:
                        yield pa.RecordBatch.from_pylist(out, pa.schema([("n", pa.int32()), ("item_id", pa.int64()), ("first", pa.int64()), ("words", pa.binary())]))

    return map_arrow(benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")), run, "n int, item_id long, first long, words binary")


def ship_queries(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> list[str]:
    """Names of the files with the benchmark's test suffixes; one (maybe empty) at least."""
    spark, names, total, path, f = benchmark.sparkSession, [], 0, "", None
    words = cut(_item_words(benchmark, item_id, text))

    def close() -> None:
        f.close()
        names.append(ship_file(spark, path))
        os.remove(path)

    def write(items: list[tuple[int, int, np.ndarray]], depth: int) -> None:
        nonlocal total, path, f
        if f is None or total > PASS_WORDS:
            if f is not None:
                close()
            path, total = f"{own_dir()}/suffixes-{uuid.uuid4().hex}", 0
            f = open(path, "wb")
        if items:
            _save(build_queries(items, depth), f)
        total += sum(len(h) for *_, h in items)

    write([], DEPTH)
    items: dict[int, list] = {d: [] for d in range(1, DEPTH + 1)}  # short items' windows begin with fewer words
    size = dict.fromkeys(items, 0)
    for r in words.toLocalIterator():  # in pieces; a block of each depth at once
        depth = min(r.n, DEPTH)
        items[depth].append((NO_ID if r.item_id is None else r.item_id, r["first"], np.frombuffer(r.words, np.uint64)))
        size[depth] += len(items[depth][-1][2])
        if size[depth] >= BLOCK_WORDS:
            write(items[depth], depth)
            items[depth], size[depth] = [], 0
    for depth, own in items.items():
        if own:
            write(own, depth)
    close()
    free(words)
    return names


def _in_passes(docs: DataFrame, names: list[str], text: str, matches: bool) -> DataFrame:
    """As _scan(), over several files: hits of all passes come together by the hash of their text."""
    key = [F.xxhash64(text).alias("__k0"), F.xxhash64(F.lit(13), text).alias("__k1")]
    found = None
    for name in names:
        one = _scan(docs.select(text, *key).where(F.col(text).isNotNull()), name, text, matches, runs=True).where("n_hit > 0").select("__k0", "__k1", "__hit_items", "matches", "__runs")
        one = one.dropDuplicates(["__k0", "__k1"])
        found = one if found is None else found.unionByName(one)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    found = cut(found.groupBy("__k0", "__k1").agg(F.array_distinct(flat("__hit_items")).alias("__hit_items"), flat("matches"), flat("__runs")))
    names_ = ["n_words", "n_hit", "__hit_items", "matches", "__runs"]
    kept = docs.drop(*names_)

    def count(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n = [find_words(data, offsets, LETTERS, hashes=False).counts for _, _, data, offsets in text_blocks(batch.column(batch.schema.get_field_index(text)))]
        return {"n_words": pa.array(np.concatenate(n) if n else [], pa.int64())}

    out = add_columns(kept.withColumns({"__k0": key[0], "__k1": key[1]}), count, "n_words long").join(found, ["__k0", "__k1"], "left").drop("__k0", "__k1")
    runs = F.array_sort("__runs")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(s["to"], r["a"]))).alias("n"), F.greatest(s["to"], r["b"]).alias("to"))
    n_hit = F.coalesce(F.aggregate(runs, start, step, lambda s: s["n"]), F.lit(0).cast("long"))
    none = {"__hit_items": "array<long>", "matches": MATCH}
    return out.withColumn("n_hit", n_hit).drop("__runs").withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in none.items()}).select(*kept.columns, *names_[:-1])


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", matches: bool = True) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and matches (longest ones with their places; empty if not asked for)."""
    names = ship_queries(benchmark, item_id, item_text)
    out = _scan(docs, names[0], text, matches, runs=False) if len(names) == 1 else _in_passes(docs, names, text, matches)
    digest = F.sha2(F.array_join(F.array_sort(F.transform("__hit_items", lambda i: i.cast("string"))), ","), 256)
    return out.withColumns({"n_items": F.size("__hit_items").cast("long"), "items_sha256": digest, "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))}).drop("__hit_items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that are contaminated, in their own columns."""
    result = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches")
    marked = docs.withColumns({f"__own_{c}": F.col(c) for c in docs.columns if c in result})
    kept = scan_benchmark(marked, benchmark, text, matches=False).where(~F.col("contaminated"))
    return kept.select(*[F.col(f"__own_{c}").alias(c) if c in result else F.col(c) for c in docs.columns])
