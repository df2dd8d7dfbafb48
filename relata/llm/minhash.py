"""MinHash near-duplicates by a chosen-path set similarity join.

Documents with equal shingle sets form a class; classes are joined. A class has ``SIGNATURE`` minwise
tokens. In each of ``TREES`` independent trees a class descends from the root: a node's path chooses one or
two of the tokens' places (so that 1 / ``THRESHOLD`` are chosen on average), and the class goes on to the
child that each chosen token names. Two classes of similarity ``THRESHOLD`` share a node at depth ``DEPTH``
of one tree with probability 0.60, of any of 12 trees with 0.99998; more similar ones all but always.

Nodes of up to ``SMALL`` classes are compared exhaustively. In larger ones, which hold groups of near
copies, all are compared with the smallest. Pairs are first held against an estimate from the signatures,
loose by 4.6 standard deviations, then confirmed on the full sets, and links give components. Large nodes
that still hold several components (near copies just under the threshold, mostly) hardly come apart by
branching: they are joined into families, and the classes outside of a family's largest component are compared
with all of it, in blocks of bounded size, by products of incidence matrices, of which only links that join
components come out. So no group is written out pair by pair. A member of a large node with fewer than
``FAMILY_EQUAL`` places in common with the node's smallest class isn't of its family there and depends on other nodes.

Defined results: null and empty texts and those without words have empty sets, link with nothing and are
kept; repeated rows share their component; rows of one id stand or fall together; a null id has no component
and is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.arrow import add_columns, map_arrow, mix
from relata.llm.components import components
from relata.llm.shingles import jaccard_at_least, set_list, sets_of
from relata.llm.store import cut, free, small_batches

PERCENT = 75
SIGNATURE = 64
TREES = 12
DEPTH = 3
SMALL = 16
#: About so many classes and shingles are in a part of a family.
PART_CLASSES = 512
PART_SHINGLES = 250_000
#: Pairs of texts that are confirmed at once; rows that workers get at once.
CONFIRM_ROWS, BATCH_ROWS = 512, 2048
#: A shingle in so many sets of a block is a column of the dense product.
DENSE = 32
#: Equal places that connect a class with its node's pivot in a family.
FAMILY_EQUAL = 20
#: Equal places of two signatures that make a candidate; similarity 0.75 gives 48 +- 3.5.
LEAST_EQUAL = 32
#: Equal places from which a pair is tried first.
LIKELY_EQUAL = 44

_RANDOM = np.random.default_rng(75)
_FACTORS = _RANDOM.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64))
_SALT = mix(np.array([11, 12, 13], np.uint64))


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, fp0, fp1, sig): set size, fingerprints of the set, minwise tokens (null: empty set)."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = len(batch)
        n, fp0, fp1 = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        sig = np.zeros((rows, SIGNATURE), np.uint32)
        for lo, hashes, sizes in sets_of(batch.column(batch.schema.get_field_index(text))):
            own = np.flatnonzero(sizes)
            n[lo : lo + len(sizes)] = sizes
            if not len(own):
                continue
            first = (np.cumsum(sizes) - sizes)[own]
            fp0[lo + own] = np.add.reduceat(mix(hashes ^ _SALT[0]), first).view(np.int64)
            fp1[lo + own] = np.add.reduceat(mix(hashes ^ _SALT[1]), first).view(np.int64)
            for k in range(SIGNATURE):
                sig[lo + own, k] = np.minimum.reduceat((hashes * _FACTORS[k]) >> np.uint64(32), first)
        return {"n_shingles": pa.array(n), "fp0": pa.array(fp0), "fp1": pa.array(fp1), "sig": pa.array([s.tobytes() if k else None for s, k in zip(sig, n)], pa.binary())}

    out = add_columns(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(text)), make, "n_shingles long, fp0 long, fp1 long, sig binary", ["doc_id"])
    return out


def _children(node: np.ndarray, row: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the parent, child node) one level on: a node chooses one place, and for every third node another."""
    h = mix(node + _SALT[2])
    first = (h % np.uint64(SIGNATURE)).astype(np.int64)
    more = ((h >> np.uint64(8)) % np.uint64(SIGNATURE - 1)).astype(np.int64)
    second = (first + 1 + more) % SIGNATURE
    two = (h >> np.uint64(32)) % np.uint64(3) == 0
    every = np.arange(len(node))
    parent = np.concatenate([every, every[two]])
    place = np.concatenate([first, second[two]])
    return parent, mix(mix(node[parent] ^ _PLACES[place]) + sig[row[parent], place].astype(np.uint64))


def _signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), SIGNATURE)


def _branch(df: DataFrame, levels: int) -> DataFrame:
    """(node, cid) `levels` below the rows' node (of all trees' roots if they have none); rows have cid and sig."""
    rooted = "node" in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            cid, sig = batch.column(0).to_numpy(zero_copy_only=False), _signature_rows(batch.column(1))
            if rooted:
                row, node = np.arange(len(cid)), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            else:
                row, node = np.repeat(np.arange(len(cid)), TREES), np.tile(mix(np.arange(1, TREES + 1, dtype=np.uint64)), len(cid))
            for _ in range(levels):
                parent, node = _children(node, row, sig)
                row = row[parent]
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(cid[row])], ["node", "cid"])

    return map_arrow(df.select("cid", "sig", *["node"] * rooted), run, "node long, cid long")


def _crowded(entries: DataFrame) -> DataFrame:
    """(node, cid, n, pivot) of nodes with two classes or more."""
    sizes = entries.groupBy("node").agg(F.count("*").alias("n"), F.min("cid").alias("pivot")).where("n > 1")
    return entries.join(sizes, "node")


def _node_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b), a < b: all of small nodes, those with the pivot of large ones."""
    small = nodes.where(F.col("n") <= SMALL).groupBy("node").agg(F.sort_array(F.collect_set("cid")).alias("c"))
    each = F.flatten(F.transform("c", lambda a, i: F.transform(F.slice(F.col("c"), i + 2, SMALL), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = small.select(F.explode(each).alias("p")).select("p.a", "p.b")
    stars = nodes.where((F.col("n") > SMALL) & (F.col("cid") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("cid").alias("b"))
    return pairs.unionByName(stars).distinct()


def _likely(pairs: DataFrame, classes: DataFrame, least: int = LEAST_EQUAL) -> DataFrame:
    """pairs with their number of equal signature places, if that is enough."""
    sig = classes.select("cid", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            equal = (_signature_rows(batch.column(2)) == _signature_rows(batch.column(3))).sum(1)
            keep = equal >= least
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(equal[keep].astype(np.int32))], ["a", "b", "equal"])

    left = pairs.join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a")
    return map_arrow(left.join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb"), run, "a long, b long, equal int")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough; texts has (cid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, CONFIRM_ROWS) for b in batches for at in range(0, len(b), CONFIRM_ROWS)):
            ids: dict[int, int] = {}
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for side in (0, 1):  # a text that is in many pairs is cut into shingles once
                for row, p in enumerate(pairs):
                    ids.setdefault(p[side], row + side * len(pairs))
            both = pa.chunked_array([batch.column(2), batch.column(3)]).take(pa.array(list(ids.values()), pa.int64())).combine_chunks()
            sets = dict(zip(ids, set_list(both)))
            good = pa.array([jaccard_at_least(sets[a], sets[b], percent) for a, b in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    left = pairs.select("a", "b").join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
    return map_arrow(left.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"), run, "a long, b long")


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pairs whose ends have different components so far."""
    label = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    both = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _texts(docs: DataFrame, cids: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(cid, text) of the classes named. They grow with the corpus, so they are merged with it at any size."""
    return cut(docs.select(F.col(doc_id).cast("long").alias("cid"), F.col(text).alias("text")).join(cids.distinct().hint("merge"), "cid", "left_semi"))


def _intersections(sets: list[np.ndarray], few: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets `few` (indices) with all sets.

    Tokens of one set count nothing. Those of many sets are columns of a dense product; those of some sets
    add one to each pair of their sets.
    """
    m, k = len(sets), len(few)
    place = np.full(m, -1)
    place[few] = np.arange(k)
    token = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.lexsort((row, token))
    token, row = token[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(first, len(token)))
    out = np.zeros(k * m, np.float32)
    for n in np.unique(size[(size > 1) & (size < DENSE)]):
        rows = row[first[size == n][:, None] + np.arange(n)]
        for part in np.array_split(rows, max(1, rows.size * n >> 19)):
            pairs = place[part][:, :, None] * m + part[:, None, :]
            pairs = pairs[place[part] >= 0]  # those of the few
            out += np.bincount(pairs.ravel(), minlength=k * m).astype(np.float32)
    out = out.reshape(k, m)
    dense = np.flatnonzero(size >= DENSE)
    for some in np.array_split(dense, max(1, -(-len(dense) // 2048))) if len(dense) else []:
        holds = np.zeros((m, len(some)), np.float32)
        for c, t in enumerate(some):
            holds[row[first[t] : first[t] + size[t]], c] = 1
        out += holds[few] @ holds.T
    return out


def _spanning_links(cids: np.ndarray, component: np.ndarray, few: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of the classes `few` (indices) with those of other components, as many as join them."""
    names, comp = np.unique(component, return_inverse=True)
    n = np.array([len(s) for s in sets])
    both = _intersections(sets, few)
    x, y = np.nonzero((100 * both >= percent * (n[few][:, None] + n[None, :] - both)) & (comp[few][:, None] != comp[None, :]))
    parent = list(range(len(names)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for a, b in zip(few[x].tolist(), y.tolist()):
        i, j = top(comp[a]), top(comp[b])
        if i != j:
            parent[i] = j
            out.append((int(cids[a]), int(cids[b])))
    return out


def _family_blocks(nodes: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame | None:
    """(family, i, j, few, cid, component): the blocks in which large nodes of several components are compared; None if there are none.

    A family is what likely pairs with the nodes' pivots connect. Its classes outside of the largest component
    (few) and all of its classes are cut into parts of bounded size; a block is part i of the few with part j of all.
    """
    label = found.select(F.col("id").alias("cid"), "component")
    own = cut(nodes.join(label, "cid", "left").select("node", "cid", "pivot", F.coalesce("component", "cid").alias("component")))
    mixed = own.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("node")
    stars = own.where("cid <> pivot").join(mixed, "node").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
    near = cut(_likely(stars, classes, FAMILY_EQUAL))
    free(own)
    if near.isEmpty():
        free(near)
        return None
    families = components(near.select("a", "b"))
    members = families.select(F.col("id").alias("cid"), F.col("component").alias("family"))
    members = members.join(label, "cid", "left").join(classes.select("cid", "n_shingles"), "cid").withColumn("component", F.coalesce("component", "cid"))
    members = cut(members)
    free(near, families)
    parts = lambda n, m: F.greatest(F.ceil(n / PART_CLASSES), F.ceil(m / PART_SHINGLES))
    sizes = members.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    sizes = sizes.groupBy("family").agg(F.max(F.struct("n", "m", "component")).alias("top"), F.sum("n").alias("n"), F.sum("m").alias("m")).where("n > top.n")
    sizes = sizes.select("family", F.col("top.component").alias("largest"), parts(F.col("n") - F.col("top.n"), F.col("m") - F.col("top.m")).alias("few_parts"), parts(F.col("n"), F.col("m")).alias("parts"))
    dealt = members.join(sizes, "family")
    own_part = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    few = dealt.where("component <> largest").select("family", own_part("few_parts").alias("i"), other("parts").alias("j"), F.lit(True).alias("few"), "cid", "component")
    every = dealt.select("family", other("few_parts").alias("i"), own_part("parts").alias("j"), F.lit(False).alias("few"), "cid", "component")
    return few.unionByName(every)


def _compare_blocks(blocks: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, found on full sets within blocks."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        cids, component, few = (block.column(c).to_numpy() for c in ("cid", "component", "few"))
        links = _spanning_links(cids, component, np.flatnonzero(few), set_list(block.column("text").combine_chunks()), percent) if few.any() else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return blocks.join(texts, "cid").groupBy("family", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs."""
    with small_batches(docs.sparkSession, BATCH_ROWS):  # some have two texts a row
        signed, classes, found = _classes_and_components(docs, text, doc_id, percent)
    named = classes.drop("sig").join(found.select(F.col("id").alias("cid"), "component"), "cid", "left").select("n_shingles", "fp0", "fp1", F.coalesce("component", "cid").alias("component_id"))
    out = signed.drop("sig").join(named, ["n_shingles", "fp0", "fp1"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _classes_and_components(docs: DataFrame, text: str, doc_id: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What signatures() gives, the classes (n_shingles, fp0, fp1, cid, sig), and the (id, component) of those that are linked."""
    signed = cut(signatures(docs, text, doc_id))
    classes = cut(signed.where("n_shingles > 0").groupBy("n_shingles", "fp0", "fp1").agg(F.min("doc_id").alias("cid"), F.min("sig").alias("sig")))
    own = classes.where("cid IS NOT NULL").select("cid", "sig", "n_shingles")
    nodes = cut(_crowded(_branch(own, DEPTH)))
    pairs = cut(_likely(_node_pairs(nodes), own))
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    texts = _texts(docs, ends, text, doc_id)
    # first each class with the smallest likely one, which links most groups as a star; then what lies across
    star = pairs.where(F.col("equal") >= LIKELY_EQUAL).groupBy("b").agg(F.min("a").alias("a"))
    links = cut(_confirmed(star, texts, percent))
    found = components(links)
    links = links.unionByName(cut(_confirmed(_across(pairs, found), texts, percent)))
    free(found, pairs, texts)
    found = components(links)
    blocks = _family_blocks(nodes.where(F.col("n") > SMALL).select("node", "cid", "pivot"), own, found)
    if blocks is not None:
        blocks = cut(blocks)
        texts = _texts(docs, blocks.select("cid"), text, doc_id)
        links = links.unionByName(cut(_compare_blocks(blocks, texts, percent)))
        free(found, blocks, texts)
        found = components(links)
    free(nodes)
    return signed, classes, found


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one document of each component."""
    gone = near_duplicates(docs, text, doc_id).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[doc_id] == F.col("__gone"), "left_anti")
