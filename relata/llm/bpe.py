"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words of the corpus (counted over all documents with mergeable Misra-Gries summaries) and the
whole words of the vocabulary are compiled into a minimal acyclic automaton whose edges carry how many
words lie before them; the sum along a word's path is its ordinal, which points at its ids. States with
equal futures are shared. The automaton is written as flat arrays into one file, which Spark ships to the
executors and workers map into memory. Words that it lacks are merged exactly, lowest rank first. So the
lexicon decides about speed only, never about ids.

Characters that this Python's Unicode tables don't know yet may be classed otherwise than by a newer library.

Defined results: null and empty texts have no ids and decode to the empty string; strings of special tokens
in a text become these tokens, as in the tokenizers library; repeated rows give equal results; an empty
table gives an empty result; extra columns stay, but for columns named like the results.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import sys
import unicodedata
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.arrow import LETTERS, LOWER, add_columns, find_words, map_arrow, strings, text_blocks
from relata.llm.store import own_dir, ship_file

LEXICON_WORDS = 50_000
#: Entries of a task's summary; a word's count is too low by at most the task's tokens / SUMMARY.
SUMMARY = 50_000
MEMO_WORDS = 200_000
_SMALL_ENDIAN = sys.byteorder == "little" and array("I").itemsize == 4


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Rules:
    """Vocabulary, merges and word pattern of a tokenizer file with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        pairs = list(pairs)
        #: Rank of a pair of ids (first << 20 | second), and the id that a merge of each rank makes.
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.none = len(pairs)
        self.chars = _byte_chars()
        self.byte_ids = [self.vocab[c] for c in self.chars]
        self.last_ids = {self.vocab[c]: self.vocab[c + self.end] for c in self.chars}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if not text.isascii():
            # lower-casing goes character by character: a final capital sigma gets no final form
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())

    def merge(self, word: str) -> list[int]:
        """Ids of a pre-token, by merges alone: the pair of lowest rank first, the leftmost of equal ones."""
        parts = [self.byte_ids[b] for b in word.encode()]
        if not parts:
            return parts
        parts[-1] = self.last_ids[parts[-1]]
        get, none = self.ranks.get, self.none
        if len(parts) > 48:
            return self._merge_long(parts)
        pairs = [get(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            rank = min(pairs)
            if rank == none:
                break
            at = pairs.index(rank)
            parts[at : at + 2] = [new] = [self.made[rank]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] << 20 | new, none)
            if at < len(pairs):
                pairs[at] = get(new << 20 | parts[at + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges with a queue of pairs: a long word doesn't take quadratic time."""
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        rank = lambda i: self.ranks.get(parts[i] << 20 | parts[right[i]]) if right[i] < len(parts) else None
        queue = [(r, i, parts[i], parts[right[i]]) for i in range(len(parts)) if (r := rank(i)) is not None]
        heapify(queue)
        while queue:
            r, i, a, b = heappop(queue)
            j = right[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j], right[i] = self.made[r], -1, right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heappush(queue, (r, k, parts[k], parts[right[k]]))
        return [p for p in parts if p >= 0]


def compile_lexicon(entries: dict[bytes, list[int]], path: str) -> None:
    """Writes the minimal acyclic transducer of entries (word: ids) to a file.

    Words come in byte order; what the next word can't reach any more is registered, and replaced by an
    equal state that is there already.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    open_states: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
    last = b""

    def close(down_to: int) -> None:
        while len(open_states) > down_to + 1:
            final, edges = open_states.pop()
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            open_states[-1][1].append((last[len(open_states) - 1], register[key]))

    for word in words:
        common = len(os.path.commonprefix([last, word]))
        close(common)
        for _ in word[common:]:
            open_states.append((False, []))
        open_states[-1] = (True, open_states[-1][1])
        last = word
    close(0)
    states.append((open_states[0][0], tuple(open_states[0][1])))
    below = np.zeros(len(states), np.int64)  # words that a state accepts; its targets come before it
    keys, targets, skips = [], [], []
    for s, (final, edges) in enumerate(states):
        n = int(final)
        for label, target in edges:
            keys.append(s << 8 | label)
            targets.append(target)
            skips.append(n)
            n += int(below[target])
        below[s] = n
    out = [entries[w] for w in words]
    arrays = [np.array(keys, np.int64), np.array(targets, np.int64), np.array(skips, np.int64), np.array([f for f, _ in states], np.int64), np.cumsum([0, *map(len, out)], dtype=np.int64), np.array([i for o in out for i in o], np.int64)]
    with open(path, "wb") as f:
        np.array([len(states) - 1, *map(len, arrays)], np.int64).tofile(f)
        for a in arrays:
            a.tofile(f)


class Lexicon:
    """A compiled transducer, mapped into memory."""

    def __init__(self, path: str) -> None:
        flat = np.memmap(path, np.int64, "r")
        self.root, sizes = int(flat[0]), flat[1:7]
        at = np.cumsum([7, *sizes])
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = (flat[a:b] for a, b in zip(at, at[1:]))

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """Ordinal of each word, -1 if it isn't in. All words walk together, one byte a step."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(words), np.uint8)
        state, ordinal = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        alive = np.arange(len(words)) if len(self.keys) else np.zeros(0, np.int64)
        if not len(self.keys):
            return np.full(len(words), -1)
        for step in range(int(sizes.max(initial=0))):
            alive = alive[sizes[alive] > step]
            if not len(alive):
                break
            key = state[alive] << 8 | data[begin[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            ordinal[alive[~hit]] = -1
            alive, at = alive[hit], at[hit]
            ordinal[alive] += self.skips[at]
            state[alive] = self.targets[at]
        return np.where((ordinal >= 0) & (self.final[state] == 1), ordinal, -1)


class Encoder:
    """Encodes texts; keeps what it found for a bounded number of words."""

    def __init__(self, rules: Rules, lexicon: Lexicon | None) -> None:
        self.rules, self.lexicon = rules, lexicon
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.shown = {i: t.encode() for i, t in rules.tokens.items()}

    def _made(self, ids: list[int]) -> tuple[bytes, bytes]:
        return array("I", ids).tobytes() if _SMALL_ENDIAN else np.array(ids, "<u4").tobytes(), b" ".join([self.shown[i] for i in ids])

    def learn(self, words: set[str]) -> None:
        """Puts the ids of all words into the memo."""
        new = list(words.difference(self.memo))
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = list(words)
        at = self.lexicon.ordinals([w.encode() for w in new]) if self.lexicon and new else np.full(len(new), -1)
        known = np.flatnonzero(at >= 0)
        if len(known):
            ids, offsets = self.lexicon.ids, self.lexicon.offsets
            for k, a, b in zip(known.tolist(), offsets[at[known]].tolist(), offsets[at[known] + 1].tolist()):
                self.memo[new[k]] = self._made(ids[a:b].tolist())
        merge, special = self.rules.merge, self.rules.special
        for k in np.flatnonzero(at < 0).tolist():
            word = new[k]
            self.memo[word] = self._made([special[word]] if word in special else merge(word))

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens; no pre-token looks like a special one."""
        special = self.rules.special
        if self.rules.split is None or not any(s in text for s in special):
            return self.rules.words(text)
        return [w for part in self.rules.split(text) for w in ([part] if part in special else self.rules.words(part))]

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text in UTF-8) of each text."""
        pieces, size = [], 0
        for text in texts:
            pieces.append(self.pieces(text))
            size += len(pieces[-1])
            if size > 1 << 17:
                yield from self._encoded(pieces)
                pieces, size = [], 0
        yield from self._encoded(pieces)

    def _encoded(self, pieces: list[list[str]]) -> Iterator[tuple[bytes, bytes]]:
        self.learn(set().union(*pieces))
        get = self.memo.__getitem__
        for own in pieces:
            ids, shown = zip(*map(get, own)) if own else ((), ())
            yield b"".join(ids), b" ".join(shown)


@cache
def _rules(name: str) -> Rules:
    return Rules(SparkFiles.get(name))


@lru_cache(1)
def _encoder(rules: str, lexicon: str) -> Encoder:
    """A worker's own; both files came with the job."""
    return Encoder(_rules(rules), Lexicon(SparkFiles.get(lexicon)))


class Summary:
    """Misra-Gries summary of words: at most `most` entries; a count is too low by what was taken off at most."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.hash, self.count, self.word = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, hashes: np.ndarray, counts: np.ndarray, words: np.ndarray) -> None:
        every = np.concatenate([self.hash, hashes])
        self.hash, first, inverse = np.unique(every, return_index=True, return_inverse=True)
        self.count = np.bincount(inverse, np.concatenate([self.count, counts]), len(self.hash)).astype(np.int64)
        self.word = np.concatenate([self.word, words])[first]
        if len(self.hash) > 4 * self.most:
            self.prune()

    def prune(self) -> None:
        """Takes the largest count that has no place off all counts."""
        if len(self.hash) > self.most:
            self.count = self.count - np.partition(self.count, -self.most - 1)[-self.most - 1]
            keep = self.count > 0
            self.hash, self.count, self.word = self.hash[keep], self.count[keep], self.word[keep]


def word_counts(docs: DataFrame, text: str = "text", most: int = SUMMARY) -> DataFrame:
    """(word, n): the frequent runs of letters of all texts, A-Z lower-cased; binary, as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, found, size = Summary(most), [], 0
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                w = find_words(data, offsets, LETTERS)
                hashes, first, counts = np.unique(w.hash, return_index=True, return_counts=True)
                low = LOWER[data].tobytes()
                words = np.empty(len(first), object)
                words[:] = [low[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist())]
                found.append((hashes, counts, words))
                size += len(first)
                if size > 2 * most:  # each merge sorts the whole summary
                    summary.add(*map(np.concatenate, zip(*found)))
                    found, size = [], 0
        if found:
            summary.add(*map(np.concatenate, zip(*found)))
        summary.prune()
        yield pa.RecordBatch.from_arrays([pa.array(summary.word.tolist(), pa.binary()), pa.array(summary.count)], ["word", "n"])

    return map_arrow(docs.select(text), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ship_lexicon(docs: DataFrame, path: str, text: str = "text", size: int = LEXICON_WORDS) -> tuple[str, str]:
    """Names under which executors find the tokenizer file and the lexicon compiled for docs."""
    spark = docs.sparkSession
    rules = Rules(path)
    back = {c: b for b, c in enumerate(rules.chars)}
    whole = (t.removesuffix(rules.end) for t in rules.vocab if t.endswith(rules.end))
    words = {bytes(back[c] for c in t) for t in whole if t}
    frequent = word_counts(docs, text).where(F.length("word") <= 64).orderBy(F.desc("n"), "word").limit(size).collect()  # at most `size`
    words |= {bytes(r.word) for r in frequent}
    entries = {}
    for w in words:
        try:
            word = w.decode()
        except UnicodeDecodeError:  # part of a character: no word
            continue
        if rules.words(word) == [word]:
            entries[w] = rules.merge(word)
    made = f"{own_dir()}/lexicon-{uuid.uuid4().hex}"
    compile_lexicon(entries, made)
    del entries, words, whole, back, frequent, rules
    gc.collect()  # the driver goes on for long
    names = ship_file(spark, path), ship_file(spark, made)
    os.remove(made)
    return names


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """docs (or its columns `keep`) with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (binary, 4 bytes each)."""
    names = ship_lexicon(docs, path, text)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n, a, b, raw = [], [], [], []
        for got, shown in _encoder(*names).encode(strings(batch.column(batch.schema.get_field_index(text)))):
            n.append(len(got) // 4)
            a.append(hashlib.sha256(got).hexdigest())
            b.append(hashlib.sha256(shown).hexdigest())
            if ids:
                raw.append(got)
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string()), "ids": pa.array(raw, pa.binary())}

    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return add_columns(docs if keep is None else docs.select(*dict.fromkeys([*keep, text])), make, ddl, keep, lambda: _encoder(*names).memo.clear())


def decode_ids(ids: bytes, rules: Rules) -> str:
    """Text of an ids column's value, special tokens included."""
    return " ".join(rules.tokens[i] for i in np.frombuffer(ids, "<u4").tolist())


