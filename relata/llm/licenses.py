"""License scans: fuzzy search of short notices.

A notice that may have k edits is split into k + 1 pieces; wherever it occurs, one piece at least occurs
exactly. An Aho-Corasick automaton finds the pieces of all notices in one pass; around each hit the regex
library's bounded-error matching looks for the notice with up to k edits and gives the span. An edit is one code
point more, less or other. White space, and a line break with the signs of a comment around it, counts as
one space.

Beside that, the base phrases are found word by word. Defined results: null and empty texts have no words,
labels or spans and score 0; spans are places in the text in code points, the end exclusive; of overlapping
ones that with the fewest edits is reported; repeated rows give equal results; an empty table gives an empty
result; extra columns stay, but for columns named like the results.
"""

from __future__ import annotations

from bisect import bisect
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from relata.llm.arrow import LETTERS, LOWER, add_columns, find_words, text_blocks

#: Phrases whose words count wherever they stand consecutively.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, notice in lower case, most edits.
NOTICES: tuple[tuple[str, str, int], ...] = (
    ("mit", "released under the mit license", 3),
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy", 6),
    ("apache", "licensed under the apache license, version", 4),
    ("gpl", "licensed under the gnu general public license", 4),
    ("lgpl", "gnu lesser general public license", 3),
    ("agpl", "gnu affero general public license", 3),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("bsd", "licensed under the bsd license", 2),
    ("mpl", "mozilla public license", 2),
    ("epl", "eclipse public license", 2),
    ("cc-by-nc", "licensed under cc by-nc", 1),
    ("cc-by-sa", "licensed under cc by-sa", 1),
    ("cc-by-nd", "licensed under cc by-nd", 1),
    ("cc-by", "licensed under cc by 4.0", 1),
    ("cc", "creative commons attribution", 2),
    ("unlicense", "released into the public domain", 3),
    ("reserved", "all rights reserved", 2),
)

SPANS = "array<struct<label: string, start: int, end: int, edits: int>>"

#: Bytes that may stand around a line break within a comment.
_COMMENT = np.isin(np.arange(256), np.frombuffer(b"#*/;>!-%|", np.uint8))


@dataclass
class Scanner:
    seeds: ahocorasick.Automaton  # piece: [(notice, offset of the piece, its length)]
    patterns: list[regex.Pattern]
    base: list[tuple[str, np.ndarray]]  # label, hashes of the phrase's words


def _pieces(text: str, edits: int) -> list[tuple[int, str]]:
    at = [len(text) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, text[a:b]) for a, b in zip(at, at[1:])]


@cache
def scanner(notices: tuple[tuple[str, str, int], ...] = NOTICES) -> Scanner:
    found: dict[str, list[tuple[int, int, int]]] = {}
    for n, (_, text, edits) in enumerate(notices):
        for at, piece in _pieces(text, edits):
            found.setdefault(piece, []).append((n, at, len(piece)))
    seeds = ahocorasick.Automaton()
    for piece, places in found.items():
        seeds.add_word(piece, places)
    seeds.make_automaton()
    patterns = [regex.compile(f"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}") for _, text, edits in notices]
    base = []
    for phrase, label in BASE:
        data = np.frombuffer(phrase.encode(), np.uint8)
        base.append((label, find_words(data, np.array([0, len(data)]), LETTERS).hash))
    return Scanner(seeds, patterns, base)


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, place of each in data, offsets) with blank runs of each text made one space."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    soft = white | _COMMENT[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True

    def starts(inside: np.ndarray) -> np.ndarray:
        out = inside.copy()
        out[1:] &= ~inside[:-1] | edge[1:]
        return out

    run = np.cumsum(starts(soft))
    broken = np.zeros(run[-1] + 1 if len(run) else 1, bool)
    broken[run[data == 10]] = True
    blank = white | (soft & broken[run])
    first = starts(blank)
    places = np.flatnonzero(~blank | first)
    out = np.where(first, 32, data)[places].astype(np.uint8)
    return out, places, np.searchsorted(places, offsets)


def _matches(pattern: regex.Pattern, text: str, least: int) -> list[regex.Match]:
    """The best match, and likewise before and after it."""
    out, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        m = pattern.search(text, a, b) if b - a >= least else None
        if m and m.end() > m.start():
            out.append(m)
            todo += [(a, m.start()), (m.end(), b)]
    return out


def find_notices(data: np.ndarray, offsets: np.ndarray, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> list[tuple[int, int, int, int, int]]:
    """(row, notice, start, end, edits) of a block's texts (A-Z in lower case); places count code points from the text's start."""
    s = scanner(notices)
    folded, places, edges = fold(data, offsets)
    low = folded.tobytes()
    windows: dict[tuple[int, int], list[list[int]]] = {}
    for last, hits in s.seeds.iter(low.decode("latin-1")):
        row = int(np.searchsorted(edges, last, "right")) - 1
        for n, at, size in hits:
            _, text, edits = notices[n]
            start = last + 1 - size
            if start < edges[row]:
                continue
            # a code point that an edit changes or adds has up to four bytes
            a, b = max(start - at - 4 * edits, int(edges[row])), min(start - at + len(text) + 4 * edits, int(edges[row + 1]))
            own = windows.setdefault((row, n), [])
            if own and a <= own[-1][1] and b - own[-1][0] <= 4 * len(text):
                own[-1] = [min(own[-1][0], a), max(own[-1][1], b)]
            else:
                own.append([a, b])
    out, chars = set(), None  # code points up to each byte
    for (row, n), own in windows.items():
        _, text, edits = notices[n]
        for a, b in own:
            while a < b and low[a] & 0xC0 == 0x80:
                a += 1
            window = low[a:b].decode("utf-8", "ignore")
            for m in _matches(s.patterns[n], window, len(text) - edits):
                first = a + len(window[: m.start()].encode())
                last = first + len(m[0].encode()) - 1
                if chars is None:
                    chars = np.cumsum(data & 0xC0 != 0x80)
                ahead = int(chars[offsets[row] - 1]) if offsets[row] else 0
                out.add((row, n, int(chars[places[first]]) - 1 - ahead, int(chars[places[last]]) - ahead, sum(m.fuzzy_counts)))
    return _best(sorted(out))


def _best(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of overlapping spans of a text, those of the fewest edits (then the longest, then the first)."""
    out: list[tuple[int, int, int, int, int]] = []
    by_row: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for x in found:
        by_row.setdefault(x[0], []).append(x)
    for row in sorted(by_row):
        taken: list[tuple[int, int]] = []  # (start, end), sorted
        own = []
        for x in sorted(by_row[row], key=lambda x: (x[4], x[2] - x[3], x[2], x[1])):
            k = bisect(taken, (x[2], x[3]))
            if (not k or taken[k - 1][1] <= x[2]) and (k == len(taken) or x[3] <= taken[k][0]):
                taken.insert(k, (x[2], x[3]))
                own.append(x)
        out += sorted(own, key=lambda x: x[2])
    return out


def scan_licenses(docs: DataFrame, text: str = "text", keep: list[str] | None = None, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> DataFrame:
    """docs (or its columns `keep`) with n_words, n_base, first_word, last_word, base_labels, labels, score and spans."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n_words, n_base, first, last, base_labels, labels, score, spans = ([] for _ in range(8))
        for _, _, data, offsets in text_blocks(batch.column(batch.schema.get_field_index(text))):
            w = find_words(data, offsets, LETTERS)
            rows = len(offsets) - 1
            places: list[list[int]] = [[] for _ in range(rows)]
            base: list[set[str]] = [set() for _ in range(rows)]
            own_row = np.repeat(np.arange(rows), w.counts)
            for label, hashes in scanner(notices).base:
                k = len(hashes)
                hit = np.flatnonzero(w.hash == hashes[0])
                hit = hit[hit + k <= len(w.hash)]
                for j in range(1, k):
                    hit = hit[(w.hash[hit + j] == hashes[j]) & (own_row[hit + j] == own_row[hit])]
                for i in hit.tolist():
                    r = int(own_row[i])
                    places[r].append(i - int(w.first[r]))
                    base[r].add(label)
            matched: list[list[dict]] = [[] for _ in range(rows)]
            for r, n, a, b, edits in find_notices(LOWER[data], offsets, notices):
                matched[r].append({"label": notices[n][0], "start": a, "end": b, "edits": edits, "_score": 1 - edits / len(notices[n][1])})
            n_words += w.counts.tolist()
            for r in range(rows):
                own = matched[r]
                n_base.append(len(places[r]))
                first.append(min(places[r], default=None))
                last.append(max(places[r], default=None))
                base_labels.append(",".join(sorted(base[r])))
                labels.append(",".join(sorted(base[r] | {m["label"] for m in own})))
                score.append(max([1.0 if base[r] else 0.0, *(m.pop("_score") for m in own)]))
                spans.append(own)
        kinds = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
        return {
            "n_words": pa.array(n_words, pa.int64()), "n_base": pa.array(n_base, pa.int64()), "first_word": pa.array(first, pa.int64()), "last_word": pa.array(last, pa.int64()),
            "base_labels": pa.array(base_labels, pa.string()), "labels": pa.array(labels, pa.string()), "score": pa.array(score, pa.float64()), "spans": pa.array(spans, kinds),
        }

    ddl = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"
    return add_columns(docs if keep is None else docs.select(*dict.fromkeys([*keep, text])), make, ddl, keep)
