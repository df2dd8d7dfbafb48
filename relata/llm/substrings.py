"""Removal of byte strings that occur earlier in the corpus, by a sparse suffix array.

A byte goes if a string of ``LENGTH`` bytes around it also starts earlier. Equal strings have equal anchors:
the place whose ``GRAM`` bytes have the smallest hash in the string. So only suffixes at anchors are sorted,
one byte in 35; strings that share an anchor place are one run, and the text around a run is its context.

1. Each anchor goes to the bucket of its hash with the hash of its context. There, all but the first of
   equal contexts are repeated whole; of anchors with several contexts, the first of each may be repeated in
   part. (A task sends the first of its equal contexts only, so a passage that many documents share costs a
   row a task.)
2. The contexts of the latter are gathered by anchor hash. Deep-shallow sorting orders their parts to the
   right of the anchor, and the reversed ones to the left. Common prefixes of neighbours give, for each
   depth, the classes of equal parts; two strings are equal if both parts are.
3. An anchor with more than ``HOT`` contexts in one task (at the edges of a passage that many documents share) is
   split by the bytes beside it: its task sends a mark in place of the contexts, and each string of such runs, from
   whatever task, goes to the bucket of its own hash; equal strings meet there, one of a task.
4. What is repeated comes together by document, and the bytes go.

Tasks take their buckets one after the other, so a task holds one bucket at a time.

Documents are ordered by id, so ids must tell them apart: rows of one id count as one document, and equal
ones get equal results. Defined results: null and empty texts have no bytes; texts shorter than LENGTH keep
all; an empty table gives an empty result; a null id counts as the smallest; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.arrow import add_columns, map_arrow, mix, powers, prefix_sums, slices_hash, text_blocks
from relata.llm.deepshallow import neighbours_common, order_rows
from relata.llm.store import cut

LENGTH = 100
GRAM = 32
PLACES = LENGTH - GRAM + 1
#: Most contexts of an anchor that a task sends to one place.
HOT = 16
#: Runs, or strings, that are sent at once.
CHUNK = 1 << 20
#: Buckets of a partition.
SPREAD = 8
#: A mark instead of contexts, where a run's `lo` (less than PLACES) stands.
_MARK = 255
_AT_BITS = np.uint64((1 << 36) - 1)
#: A run: anchor place, and how far before it its first and its last string start.
RUN = np.dtype([("at", "<i4"), ("lo", "u1"), ("hi", "u1")])
_NULL_ID = -(1 << 63)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    out, size = x, 1
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, anchor, first and last string start, anchor hash and context hash of all runs of a block."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(data) < LENGTH:
        return none
    sums = prefix_sums(data)
    _, down = powers(len(sums))
    n = len(data) - GRAM + 1
    gram = (sums[GRAM:] - sums[:-GRAM]) * down[:n]  # unmixed; multiplied once more it is random enough to choose by
    key = (gram * np.uint64(0xBF58476D1CE4E5B9)) ^ (gram >> np.uint64(31))
    key = (key * np.uint64(0x94D049BB133111EB)) & ~_AT_BITS | np.arange(n, dtype=np.uint64)
    anchor = (_sliding_min(key, PLACES) & _AT_BITS).astype(np.int64)
    sizes = np.diff(offsets)
    ok = sizes >= LENGTH
    many = np.where(ok, sizes - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(sizes)), many)
    start = np.arange(len(row)) + np.repeat(offsets[:-1] - (np.cumsum(many) - many), many)
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none
    last = np.append(first[1:], len(start)) - 1
    at, lo, hi = anchor[first], start[first], start[last]
    context = slices_hash(sums, lo, hi + LENGTH)
    return row[first], at, lo, hi, mix(gram[at]), mix(context + ((at - lo) << 8 | (at - hi)).astype(np.uint64))


def _pack(**columns: np.ndarray) -> bytes:
    return b"".join(c.tobytes() for c in columns.values())


_ENTRY = {"ah": "<u8", "ch": "<u8", "doc": "<i8", "at": "<i4", "lo": "u1", "hi": "u1"}
_CONTEXT = {"ah": "<u8", "doc": "<i8", "at": "<i4", "lo": "u1", "hi": "u1"}
_STRING = {"ah": "<u8", "sh": "<u8", "doc": "<i8", "at": "<i4"}


def _unpack(payloads: list[bytes], kinds: dict[str, str], sizes: list[int]) -> dict[str, np.ndarray]:
    """Columns of all payloads; a payload has its columns one after the other."""
    parts: dict[str, list[np.ndarray]] = {k: [np.zeros(0, t)] for k, t in kinds.items()}
    for payload, n in zip(payloads, sizes):
        at = 0
        for k, t in kinds.items():
            parts[k].append(np.frombuffer(payload, t, n, at))
            at += n * np.dtype(t).itemsize
    return {k: np.concatenate(p) for k, p in parts.items()}


def _groups(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(sorted_values):
        begin = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
        yield from zip(begin.tolist(), [*begin[1:].tolist(), len(sorted_values)])


def _run_rows(doc: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[int, bytes]:
    """Runs of each document, as bytes."""
    order = np.argsort(doc, kind="stable")
    out = np.zeros(len(doc), RUN)
    out["at"], out["lo"], out["hi"] = at[order], lo[order], hi[order]
    return {int(doc[order[a]]): out[a:b].tobytes() for a, b in _groups(doc[order])}


_SENT = "bucket long, size int, doc long, payload binary"
#: size of a row that tells a document's repeated runs (or spans), and its runs of hot anchors.
_KNOWN, _HOT_RUNS = 0, -1
_FLAGS = "doc long, whole binary, part binary, hot binary"


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, (_, t) in zip(zip(*rows), names)], [n for n, _ in names])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int | None, bytes]]]:
    """The (size, doc, payload) of each bucket; rows come in order of buckets."""
    now, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and rows:
                yield rows
                rows = []
            now = bucket
            rows.append(row)
    if rows:
        yield rows


def _send_runs(docs: DataFrame, buckets: int) -> DataFrame:
    """Entries by bucket (doc null); and, of runs that a task has seen before, the repeated runs of a document; and runs of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []

        def sent() -> pa.RecordBatch:
            ah, ch, doc, at, lo, hi = map(np.concatenate, zip(*found))
            found.clear()
            order = np.lexsort((at, doc, ch, ah))
            ah, ch, doc, at, lo, hi = (x[order] for x in (ah, ch, doc, at, lo, hi))
            again = np.zeros(len(ah), bool)
            again[1:] = (ah[1:] == ah[:-1]) & (ch[1:] == ch[:-1])
            rows = [(d % buckets, _KNOWN, d, p) for d, p in _run_rows(doc[again], at[again], lo[again], hi[again]).items()]
            ah, ch, doc, at, lo, hi = (x[~again] for x in (ah, ch, doc, at, lo, hi))
            new = np.concatenate([[True], ah[1:] != ah[:-1]])
            hot = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > HOT
            rows += [(d % buckets, _HOT_RUNS, d, p) for d, p in _run_rows(doc[hot], at[hot], lo[hot], hi[hot]).items()]
            lo = np.where(hot, _MARK, lo).astype(np.uint8)
            ah, ch, doc, at, lo, hi = (x[~hot | new] for x in (ah, ch, doc, at, lo, hi))
            bucket = (ah % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((doc, bucket))
            ah, ch, doc, at, lo, hi, bucket = (x[order] for x in (ah, ch, doc, at, lo, hi, bucket))
            rows += [(int(bucket[a]), b - a, None, _pack(ah=ah[a:b], ch=ch[a:b], doc=doc[a:b], at=at[a:b], lo=lo[a:b], hi=hi[a:b])) for a, b in _groups(bucket)]
            return _batch(rows, _SENT)

        total = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, offsets in text_blocks(batch.column(1)):
                row, at, lo, hi, ah, ch = runs(data, offsets)
                if len(row):
                    base = offsets[row]
                    found.append((ah, ch, ids[first + row], (at - base).astype(np.int32), (at - lo).astype(np.uint8), (at - hi).astype(np.uint8)))
                    total += len(row)
            if total > CHUNK:
                yield sent()
                total = 0
        if found:
            yield sent()

    return map_arrow(docs.select("doc", "text"), run, _SENT)


def _flag_runs(sent: DataFrame) -> DataFrame:
    """(doc, whole, part, hot): runs that are repeated whole, those that may be in part, and those that are split."""

    def flagged(rows: list[tuple[int, int | None, bytes]]) -> list[tuple]:
        out = [(doc, p, b"", b"") if size == _KNOWN else (doc, b"", b"", p) for size, doc, p in rows if doc is not None]
        entries = [(size, p) for size, doc, p in rows if doc is None]
        e = _unpack([p for _, p in entries], _ENTRY, [n for n, _ in entries])
        if not len(e["ah"]):
            return out
        anchor = np.unique(e["ah"], return_inverse=True)[1]
        mark = e["lo"] == _MARK
        split = np.bincount(anchor, mark) > 0
        e, anchor = {k: v[~mark] for k, v in e.items()}, anchor[~mark]
        order = np.lexsort((e["at"], e["doc"], e["ch"], anchor))
        ch, anchor = e["ch"][order], anchor[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (ch[1:] != ch[:-1])
        several = np.bincount(anchor, new, len(split)) > 1
        of = lambda which: _run_rows(*(e[k][order[which]] for k in ("doc", "at", "lo", "hi")))
        whole, part, hot = of(~new), of(new & (several & ~split)[anchor]), of(new & split[anchor])
        return out + [(d, whole.get(d, b""), part.get(d, b""), hot.get(d, b"")) for d in sorted(whole.keys() | part.keys() | hot.keys())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            out = flagged(rows)
            if out:
                yield _batch(out, _FLAGS)

    return map_arrow(sent, run, _FLAGS)


def _by_doc(flags: DataFrame, *columns: str) -> DataFrame:
    return flags.groupBy("doc").agg(*[F.collect_list(F.when(F.length(c) > 0, F.col(c))).alias(c) for c in columns])


def _spans(doc: np.ndarray, start: np.ndarray) -> dict[int, bytes]:
    """Byte ranges (pairs of int) of each document's strings."""
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + LENGTH)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    spans = np.stack([start[first], start[last] + LENGTH], 1).astype("<i4")
    return {int(doc[first[a]]): spans[a:b].tobytes() for a, b in _groups(doc[first])}


def _firsts(e: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[int, bytes]]:
    """The first of equal strings, and the spans of the others."""
    order = np.lexsort((e["at"], e["doc"], e["sh"], e["ah"]))
    e = {k: v[order] for k, v in e.items()}
    again = np.zeros(len(order), bool)
    again[1:] = (e["ah"][1:] == e["ah"][:-1]) & (e["sh"][1:] == e["sh"][:-1])
    return {k: v[~again] for k, v in e.items()}, _spans(e["doc"][again], e["at"][again])


def _send_contexts(joined: DataFrame, buckets: int) -> DataFrame:
    """Contexts of the runs in `part`, by the bucket of their anchor's hash; and the strings of those in `hot`, by that of their own (size negative)."""

    def dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(bucket, kind="stable")
        for a, b in _groups(bucket[order]):
            yield int(bucket[order[a]]), order[a:b]

    def strings(found: list[dict[str, np.ndarray]]) -> list[tuple]:
        e, known = _firsts({k: np.concatenate([f[k] for f in found]) for k in _STRING})
        rows = [(d % buckets, _KNOWN, d, p) for d, p in known.items()]
        for bucket, k in dealt(((e["ah"] + e["sh"]) % np.uint64(buckets // SPREAD)).astype(np.int64) * SPREAD):  # few and small, so in larger pieces
            rows.append((bucket, -len(k), None, _pack(**{c: v[k] for c, v in e.items()})))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            texts: list[bytes] = []
            found, n_found = [], 0
            for doc, text, part, hot in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = np.frombuffer(text, np.uint8)
                sums = prefix_sums(data)
                down = powers(len(sums))[1]

                def of(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    r = np.unique(np.frombuffer(b"".join(payloads), RUN))
                    r = r[r["at"].astype(np.int64) - r["hi"] + LENGTH <= len(text)]  # noqa: B023
                    at = r["at"].astype(np.int64)
                    return r, at, mix((sums[at + GRAM] - sums[at]) * down[at])  # noqa: B023

                if part:
                    r, at, ah = of(part)
                    texts += [text[a - lo : a - hi + LENGTH] for a, lo, hi in zip(at.tolist(), r["lo"].tolist(), r["hi"].tolist())]
                    out.append((ah, np.full(len(r), doc), r["at"], r["lo"], r["hi"]))
                if hot:
                    r, at, ah = of(hot)
                    many = r["lo"].astype(np.int64) - r["hi"] + 1
                    k = np.repeat(np.arange(len(r)), many)
                    before = r["hi"][k].astype(np.int64) + np.arange(len(k)) - (np.cumsum(many) - many)[k]
                    start = at[k] - before
                    sh = mix(slices_hash(sums, start, start + LENGTH) + before.astype(np.uint64))
                    found.append({"ah": ah[k], "sh": sh, "doc": np.full(len(k), doc), "at": start.astype(np.int32)})
                    n_found += len(k)
                    if n_found > CHUNK:
                        yield _batch(strings(found), _SENT)
                        found, n_found = [], 0
            rows = strings(found) if found else []
            if texts:
                ah, doc, at, lo, hi = map(np.concatenate, zip(*out))
                for bucket, k in dealt((ah % np.uint64(buckets)).astype(np.int64)):
                    rows.append((bucket, len(k), None, _pack(ah=ah[k], doc=doc[k], at=at[k], lo=lo[k], hi=hi[k]) + b"".join([texts[i] for i in k])))
            if rows:
                yield _batch(rows, _SENT)

    return map_arrow(joined.select("doc", "text", "part", "hot"), run, _SENT)


def _classes(common: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Class of each row: equal for rows of a group that have `depth` bytes in common."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeated_strings(group: np.ndarray, contexts: list[bytes], lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start before the anchor) of strings that an earlier row has too; rows come in document order."""
    n = len(contexts)
    lo, hi = lo.astype(np.int64), hi.astype(np.int64)
    sizes = lo - hi + LENGTH
    data = np.concatenate([np.frombuffer(b"".join(contexts), np.uint8), np.zeros(1, np.uint8)])
    anchor = np.cumsum(sizes) - sizes + lo

    def parts(width: int, step: int, have: np.ndarray, first: np.ndarray) -> np.ndarray:
        k = np.arange(width)
        at = first[:, None] + step * k
        inside = k < have[:, None]
        return np.where(inside, data[np.where(inside, at, len(data) - 1)], 0).astype(np.uint8)

    right, left = parts(LENGTH, 1, LENGTH - hi, anchor), parts(PLACES - 1, -1, lo, anchor - 1)
    orders = order_rows(group, right), order_rows(group, left)
    common = neighbours_common(group, right, orders[0]), neighbours_common(group, left, orders[1])
    rows, starts = [], []
    for o in range(PLACES):
        own = np.flatnonzero((hi <= o) & (o <= lo))
        if len(own) < 2:
            continue
        # depth 0 on the left still tells groups apart, by their first rows
        key = _classes(common[1], orders[1], max(o, 0))[own] * (n + 1) + _classes(common[0], orders[0], LENGTH - o)[own]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        again = first[inverse] != np.arange(len(own))
        rows.append(own[again])
        starts.append(np.full(int(again.sum()), o))
    return (np.concatenate(rows), np.concatenate(starts)) if rows else (np.zeros(0, np.int64),) * 2


def _repeated(contexts: list[tuple[int, bytes]]) -> dict[int, bytes]:
    """Spans of the strings that an earlier context of the same anchor has too."""
    sizes, payloads = [n for n, _ in contexts], [p for _, p in contexts]
    e = _unpack(payloads, _CONTEXT, sizes)
    if not len(e["ah"]):
        return {}
    head = sum(np.dtype(t).itemsize for t in _CONTEXT.values())
    length = e["lo"].astype(np.int64) - e["hi"] + LENGTH
    texts, k = [], 0
    for payload, n in zip(payloads, sizes):
        at = n * head
        for size in length[k : k + n].tolist():
            texts.append(payload[at : at + size])
            at += size
        k += n
    order = np.lexsort((e["at"], e["doc"]))
    e = {c: v[order] for c, v in e.items()}
    group = np.unique(e["ah"], return_inverse=True)[1]
    row, start = repeated_strings(group, [texts[i] for i in order], e["lo"], e["hi"])
    return _spans(e["doc"][row], e["at"][row].astype(np.int64) - start)


def _compare(sent: DataFrame) -> DataFrame:
    """(doc, spans): byte ranges (pairs of int) of repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            out = [(doc, p) for _, doc, p in rows if doc is not None]
            out += _repeated([(n, p) for n, doc, p in rows if doc is None and n > 0]).items()
            strings = [(-n, p) for n, doc, p in rows if doc is None and n < 0]
            out += _firsts(_unpack([p for _, p in strings], _STRING, [n for n, _ in strings]))[1].items()
            if out:
                yield _batch(out, "doc long, spans binary")

    return map_arrow(sent, run, "doc long, spans binary")


def _apply(joined: DataFrame, keep_text: bool) -> DataFrame:
    """Removes the ranges of whole and spans."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
        n, removed, n_spans, digest, left = [], [], [], [], []
        for text, whole, spans in zip(batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist(), get("whole"), get("spans")):
            r = np.frombuffer(b"".join(whole or []), RUN)
            s = np.frombuffer(b"".join(spans or []), "<i4").reshape(-1, 2)
            n.append(len(text))
            if not len(r) and not len(s):
                kept, gone, runs_ = text, 0, 0
            else:
                edge = np.zeros(len(text) + LENGTH * 2 + 1, np.int32)
                at = r["at"].astype(np.int64)
                for places, step in ((at - r["lo"], 1), (at - r["hi"] + LENGTH, -1), (s[:, 0], 1), (s[:, 1], -1)):
                    np.add.at(edge, np.minimum(places, len(edge) - 1), step)
                out = np.cumsum(edge)[: len(text)] > 0
                kept, gone = np.frombuffer(text, np.uint8)[~out].tobytes(), int(out.sum())
                runs_ = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
            removed.append(gone)
            n_spans.append(runs_)
            digest.append(hashlib.sha256(kept).hexdigest())
            left.append(kept)
        made = {"n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return made | ({"kept_bytes": pa.array(left, pa.binary())} if keep_text else {})

    return add_columns(joined, make, "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * keep_text, ["doc_id"])


def remove_repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and if asked for kept_bytes) of every row.

    The bytes kept may end inside a character, so they are binary.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = SPREAD * partitions
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_ID)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = lambda sent: sent.repartition("bucket").sortWithinPartitions("bucket")
    flags = cut(_by_doc(_flag_runs(dealt(_send_runs(own, buckets))), "whole", "part", "hot"))
    # the texts are dealt by document once; both joins read that exchange
    part = flags.where((F.size("part") > 0) | (F.size("hot") > 0)).select("doc", "part", "hot")
    contexts = _send_contexts(own.select("doc", "text").join(part, "doc"), buckets)
    spans = cut(_by_doc(_compare(dealt(contexts)), "spans"))
    joined = own.join(flags.select("doc", "whole"), "doc", "left").join(spans, "doc", "left")
    return _apply(joined.select("doc_id", "text", "whole", "spans"), keep_text)
