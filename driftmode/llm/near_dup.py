"""Near-duplicate classes of documents by DartMinHash bands and exact checks.

Words are runs of ``[a-z0-9]`` and non-ASCII characters after lowering A-Z; a shingle is five of them,
a document of fewer words (but not none) is one shingle. Similarity is the Jaccard similarity of the
shingle sets (``weighted=True``: of the shingle counts), and texts are linked from 0.8.

1. One pass writes a row per document: text digest and band keys. Signatures are weighted by the shingles' counts. A text
   that repeats shingles has the bands of its set as well (that of weights 1) if sets are compared: what repeats itself
   may be as similar by its set as it is different by its counts. Equal texts are one node from here on.
2. Nodes that share a band key are candidates. A bucket is never expanded into pairs: every member is
   compared with the bucket's smallest node.
3. Links are checked against the shingle sets of the whole texts; linked nodes form components.
4. Buckets whose members are still in several components are settled exactly: buckets that share members
   make a group, a group is cut into blocks of about ``BLOCK`` nodes or ``BLOCK_BYTES`` bytes of text, and for each pair of blocks one task
   counts the common shingles of all its nodes (a matrix product for the frequent ones, postings for the
   rest) and returns a spanning set of the links it finds. So no link between texts that share a bucket
   is lost, and no task or table holds the pairs of a group.

With 20 bands of 4 darts a pair of similarity 0.8 shares no band with probability 2.6e-5, one of 0.9
with 1e-9.

Defined results: null text counts as empty; texts without words are equal to equal texts only; rows
with the same id and text are one document; a class is named by its smallest doc_id (null if it has
null ids only); texts of any length are compared whole; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import _text
from ._spark import drop_table, put_back, set_aside, written
from .dart_minhash import band_keys, signatures

SHINGLE = 5
SIMILAR = 0.8
BANDS = 20
BAND_DARTS = 4
#: Nodes of a group, and bytes of their texts, that one task compares with as many others.
BLOCK = 1500
BLOCK_BYTES = 4 << 20


def shingles(block: _text.Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every row (repeats included), with row offsets."""
    w = _text.words(block, "alnum")
    h = w.hashes()
    out, at = _text.windows(h, w.off, size)
    n = np.diff(w.off)
    counts = np.maximum(n - size + 1, (n > 0).astype(np.int64))
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=off[1:])
    short = np.flatnonzero((n > 0) & (n < size))
    if not len(short):
        return out, off
    full = np.zeros(off[-1], np.uint64)
    is_short = np.zeros(off[-1], bool)
    is_short[off[short]] = True
    full[~is_short] = out
    acc = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        has = n[short] > k
        acc[has] = _text.mix(acc[has]) + h[w.off[short[has]] + k]
    full[off[short]] = _text.mix(acc + np.uint64(1))
    return full, off


def _counted(s: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row with their counts as weights."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return s[at], np.searchsorted(row[at], np.arange(len(off))), np.diff(np.append(at, len(s))).astype(np.float64)


def _node(text: bytes) -> bytes:
    return hashlib.md5(text, usedforsecurity=False).digest()


def sketches(docs: DataFrame, id_col: str, text_col: str, bands: int, darts: int, weighted: bool) -> DataFrame:
    """(id, node, keys) of every document; keys is empty for a text without words."""

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _text.blocks(batch.column(1)):
                some, off, weight = _counted(*shingles(block))
                has = np.diff(off) > 0
                own = band_keys(signatures(some, off, bands * darts, weight), bands).astype(np.int64)
                count = has * bands
                keys = own[has].ravel()
                again = np.flatnonzero(_text.counts_in_rows(weight > 1, off)) if not weighted else np.zeros(0, np.int64)
                if len(again):
                    # the bands of their sets that the weighted ones lack
                    size = np.diff(off)[again]
                    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(off[again], size)
                    sets = band_keys(signatures(some[at], np.append(0, np.cumsum(size)), bands * darts), bands).astype(np.int64)
                    lists = list(own)
                    for i, more in zip(again.tolist(), sets):
                        lists[i] = np.union1d(own[i], more)
                        count[i] = len(lists[i])
                    keys = np.concatenate([x for x, h in zip(lists, has) if h])
                at = np.append(0, np.cumsum(count)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, len(block)),
                        pa.array([_node(block.text(i)) for i in range(len(block))], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(keys)),
                    ],
                    ["id", "node", "keys"],
                )

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, node binary, keys array<bigint>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def element_sets(column: pa.Array, weighted: bool) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending; with ``weighted`` an element for each repeat as well, so that
    common elements count the lesser of two counts."""
    out = []
    for block in _text.blocks(column):
        s, off = shingles(block)
        for x, y in zip(off[:-1], off[1:]):
            u, c = np.unique(s[x:y], return_counts=True)
            if weighted and len(u) and c.max() > 1:
                nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                u = np.sort(np.where(nth, _text.mix(np.repeat(u, c) + _text.mix(nth.astype(np.uint64))), np.repeat(u, c)))
            out.append(u)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets."""
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 0.0


def checked(pairs: DataFrame, texts: DataFrame, similar: float, weighted: bool) -> DataFrame:
    """Pairs (a, b) of nodes whose texts are similar enough. ``texts``: (node, text), one row a node."""

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hub = None, None  # rows of one hub mostly follow one another
        for batch in batches:
            a, keep = batch.column(0).to_pylist(), []
            text_a = batch.column(2)
            for i, mine in enumerate(element_sets(batch.column(3), weighted)):
                if a[i] != held:
                    held, hub = a[i], element_sets(text_a.slice(i, 1), weighted)[0]
                if jaccard(hub, mine) >= similar - 1e-12:
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = max(16, n // 32)
    out = np.zeros((n, n), np.float32)
    dense = count > often
    number = np.cumsum(dense) - 1
    pick = dense[element]
    col, row = number[element[pick]], owner[pick]
    by = np.argsort(col, kind="stable")
    col, row = col[by], row[by]
    for k in range(0, int(dense.sum()), 2048):
        a, b = np.searchsorted(col, (k, k + 2048))
        m = np.zeros((n, 2048), np.float32)
        m[row[a:b], col[a:b] - k] = 1
        out += m @ m.T
    pick = (count > 1)[element] & ~pick
    by = np.argsort(element[pick], kind="stable")
    e, o = element[pick][by], owner[pick][by]
    for lag in range(1, often):
        same = np.flatnonzero(e[lag:] == e[:-lag])
        if not len(same):
            break
        np.add.at(out, (o[same], o[same + lag]), 1)
        np.add.at(out, (o[same + lag], o[same]), 1)
    return out


def spanning_links(sets: list[np.ndarray], label: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """Links between sets of different labels, as few as span what these links join."""
    size = np.array([len(x) for x in sets], np.float32)
    common = common_counts(sets)
    linked = common >= similar * (size[:, None] + size[None, :] - common) - 1e-6
    linked &= label[:, None] != label[None, :]
    left, out = np.ones(len(sets), bool), []
    for i in range(len(sets)):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            k = queue.pop()
            near = np.flatnonzero(linked[k] & left)
            left[near] = False
            out += [(k, int(x)) for x in near]
            queue += near.tolist()
    return out


def _settled(members: DataFrame, texts: DataFrame, similar: float, weighted: bool, block: int) -> DataFrame:
    """Links (a, b) within groups, from (node, root, grp): all that join different roots, or some that span the same."""
    bytes_of = texts.select("node", F.octet_length("text").alias("size"))
    sizes = members.join(bytes_of, "node").groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    # (a group of n nodes is read n / block times)
    cut = members.join(sizes, "grp").withColumn("parts", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("size") / BLOCK_BYTES))).withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")))
    both = cut.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    both = both.select("grp", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", "root").join(texts, "node")

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(table: pa.Table) -> pa.RecordBatch:
            nodes, roots = table.column("node").to_pylist(), table.column("root").to_pylist()
            number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
            links = spanning_links(element_sets(table.column("text"), weighted), np.array([number[r] for r in roots]), similar)
            return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in links], pa.binary()), pa.array([nodes[y] for _, y in links], pa.binary())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            names = list(zip(*(table.column(c).to_pylist() for c in ("grp", "i", "j"))))
            edges = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1])]
            for x, y in zip(edges, edges[1:]):
                yield settle(table.slice(x, y - x))
            held = table.slice(edges[-1]).to_batches()
        if held:
            yield settle(pa.Table.from_batches(held))

    keyed = both.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return keyed.select("grp", "i", "j", "node", "root", "text").mapInArrow(run, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, bands: int = BANDS, darts: int = BAND_DARTS, weighted: bool = False, block: int = BLOCK
) -> DataFrame:
    """(doc_id, class_id, node, root) of every row of ``docs``: class_id is the smallest id of the document's class, and
    root is the class itself, since classes of null or repeated ids can have equal class_ids."""
    rows = written(sketches(docs, id_col, text_col, bands, darts, weighted), "sketches")
    nodes = written(rows.groupBy("node").agg(F.min("id").alias("id"), F.first("keys").alias("keys")), "nodes")
    members = nodes.select(F.explode("keys").alias("key"), "node")
    # (aggregates are written before they are joined: then a hot key's rows can be split over tasks)
    sizes = written(members.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1"), "sizes")
    buckets = written(members.join(sizes, "key").select("key", "node", "a", "n"), "buckets")
    ids = buckets.select("node").distinct()
    whole = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("node", F.unhex(F.md5("text")))
    # one row for each node: that of its smallest id, and should that id occur twice, one of the equal rows
    wanted = nodes.join(ids, "node", "left_semi").select(F.col("node").alias("n"), F.col("id").alias("i"))
    texts = whole.join(wanted, (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")
    texts = written(texts.select("node", "text").dropDuplicates(["node"]), "texts")
    links = written(checked(buckets.where("node <> a").select("a", F.col("node").alias("b")).distinct(), texts, similar, weighted), "links")
    drop_table(sizes)
    roots = connected_components(links)
    # buckets in which not all members have met, and that are not one component yet
    known = buckets.where("n > 2").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_keys = known.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("node").alias("hub")).where("x <> y")
    open_keys = written(open_keys.select("key", "hub"), "open-keys")
    left = written(known.join(open_keys, "key").select("node", "root", "hub").distinct(), "open")
    if not left.isEmpty():
        groups = connected_components(left.select("hub", "node"), "hub", "node").select("node", F.col("root").alias("grp"))
        members = written(left.select("node", "root").distinct().join(groups, "node"), "members")
        links = links.unionByName(written(_settled(members, texts, similar, weighted, block), "links"))
        drop_table(members)
        roots = connected_components(links)
    for done in (buckets, texts, open_keys, left):
        drop_table(done)
    named = nodes.select("node", "id").join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = written(named.groupBy("root").agg(F.min("id").alias("class_id")), "classes")
    classes = named.join(least, "root").select("node", "class_id", "root")
    return rows.select("id", "node").join(classes, "node").select(F.col("id").alias(id_col), "class_id", "node", "root")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of every class, that with the smallest id, with all its columns."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    # of a class whose smallest id occurs with several texts, the text of the smallest digest
    kept = found.where(F.col(id_col).eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("class_id").alias("class_id"), F.min("node").alias("kept_node"))
    own, names = set_aside(docs)
    own = own.withColumn("digest", F.unhex(F.md5(F.coalesce(names[text_col], F.lit("")))))
    hit = own.join(kept, F.col(names[id_col]).eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("kept_node")))
    first = Window.partitionBy(names[id_col], "digest").orderBy(F.lit(1))
    return put_back(hit.withColumn("nth", F.row_number().over(first)).where("nth = 1"), names)
