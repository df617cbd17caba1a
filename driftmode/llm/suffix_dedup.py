"""Repeated passages by sparse suffix arrays.

A passage is repeated if a window of ``MIN_WORDS`` white-space-separated words stands in two places of
the corpus. Only suffixes that begin at minimisers are sorted: the ``ANCHOR``-word gram of least hash
in a window is chosen by content, so equal windows choose the same one at the same distance.

1. One pass writes the minimiser grams of every document; equal texts are one document from here on,
   its copies are repeats as a whole. Grams that occur once can't lie in a repeated window and go.
2. Documents with repeated grams are read again. Every occurrence becomes a row with the words around
   it that its windows reach.
3. Rows of a gram are sorted as suffixes. Neighbours give common lengths, so the runs of suffixes that
   share enough words to the right of the gram; inside them, matches are extended to the left word by
   word. A window whose words on both sides agree with another row's is repeated; the first of equal
   windows (least doc_id, then place) is its source.
4. The windows of a document are merged into spans.

A gram with more than ``HOT`` occurrences isn't sorted in one task: its rows are split by the content of
their windows, counted with map-side combining.

Defined results: ids are integers; null text counts as empty and repeats nothing; texts of any length are searched whole; texts shorter than a window repeat
nothing, copies of each other included; rows with the same id and text count as copies; null ids come last;
words of the first occurrence stay, also where it overlaps a later one (as in a text of one word, over
and over); an empty table gives an empty result; other columns are passed on by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._spark import drop_table, put_back, set_aside, written

MIN_WORDS = 50
ANCHOR = 16
#: Occurrences of one gram that a single task sorts.
HOT = 20_000
#: Rows that one kernel call sorts; the rows of one gram stay together.
CHUNK = 10_000
_LAST = (1 << 63) - 1


def anchors(h: np.ndarray, off: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers of all windows of ``size`` words: (gram hash, place, first and last window that chose it)."""
    none = np.zeros(0, np.int64)
    if len(h) < size:
        return np.zeros(0, np.uint64), none, none, none
    g = np.full(len(h), np.uint64(0xFFFFFFFFFFFFFFFF))
    value, at = _text.windows(h, off, gram)
    g[at] = value
    width = size - gram + 1
    best, reach = np.arange(len(g)), 1
    while reach < width:  # leftmost least gram in [i, i + reach)
        step = min(reach, width - reach)
        n = len(best) - step
        left, right = best[:n], best[step:]
        best = np.where(g[right] < g[left], right, left)
        reach += step
    last = np.repeat(off[1:], np.diff(off))
    start = np.flatnonzero(np.arange(len(h)) + size <= last)
    chosen = best[start]
    row = np.searchsorted(off, start, side="right")
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(start)) - 1
    return g[chosen[first]], chosen[first], start[first], start[end]


def _hashes(w: _text.Words, scopes: pa.Array | None) -> np.ndarray:
    """Hashes of words, salted by the scope of their text if there are scopes: then only texts of one scope have words in common."""
    h = w.hashes()
    if scopes is None:
        return h
    salt = [int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "little") for x in scopes.to_pylist()]
    return _text.mix(h + np.repeat(np.array(salt, np.uint64), np.diff(w.off)))


def _grams(docs: DataFrame, size: int, gram: int, scoped: bool) -> DataFrame:
    """(id, node, n_words, grams) of every document, from (id, text) or (id, text, scope)."""

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _text.blocks(batch.column(1)):
                w = _text.words(block)
                scopes = batch.column(2).slice(block.first, len(block)) if scoped else None
                g, place, _, _ = anchors(_hashes(w, scopes), w.off, size, gram)
                at = np.searchsorted(place, w.off).astype(np.int32)
                tails = scopes.to_pylist() if scoped else [None] * len(block)
                nodes = [_node(block.text(i), t) for i, t in enumerate(tails)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), pa.array(nodes, pa.binary()), pa.array(np.diff(w.off)), pa.ListArray.from_arrays(pa.array(at), pa.array(g.astype(np.int64)))],
                    ["id", "node", "n_words", "grams"],
                )

    return docs.mapInArrow(run, "id bigint, node binary, n_words bigint, grams array<bigint>")


def _node(text: bytes, scope: str | None) -> bytes:
    """The name of a text (in its scope), as ``digest`` makes it in SQL."""
    return hashlib.md5(text if scope is None else text + b"\x00" + scope.encode(), usedforsecurity=False).digest()


def digest(text_col: str, scope_col: str | None = None) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.unhex(F.md5(text if scope_col is None else F.when(F.col(scope_col).isNull(), text).otherwise(F.concat(text, F.lit("\x00"), F.col(scope_col)))))


_OCCURRENCE = "gram bigint, key bigint, id bigint, place bigint, before int, windows int, words binary"


def _occurrences(texts: DataFrame, size: int, gram: int, scoped: bool) -> DataFrame:
    """A row for each occurrence of a repeated gram, from (key, id, text, picked): the place of the gram, how many
    of its words stand before it, how many windows chose it, and the hashed words from its first window's start to its last one's end."""

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _text.blocks(batch.column(2)):
                w = _text.words(block)
                part = batch.slice(block.first, len(block))
                h = _hashes(w, part.column(4) if scoped else None)
                g, place, lo, hi = anchors(h, w.off, size, gram)
                at = np.searchsorted(place, w.off)
                lists = part.column(3)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                count = np.diff(lists.offsets.to_numpy())
                pick = flat + np.repeat(at[:-1], count)
                doc = np.repeat(np.arange(len(block)), count)
                whole = np.maximum(h, np.uint64(1)).astype("<u8")
                for k in range(0, len(pick), 4096):
                    p, d = pick[k : k + 4096], doc[k : k + 4096]
                    n = hi[p] + size - lo[p]
                    begin = np.cumsum(n) - n
                    index = np.arange(n.sum()) - np.repeat(begin, n) + np.repeat(lo[p], n)
                    ends = np.append(begin, n.sum()).astype(np.int32) * 8
                    data = pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(whole[index].tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(g[p].astype(np.int64)),
                            part.column(0).take(pa.array(d)),
                            part.column(1).take(pa.array(d)),
                            pa.array(place[p] - w.off[d]),
                            pa.array((place[p] - lo[p]).astype(np.int32)),
                            pa.array((hi[p] - lo[p] + 1).astype(np.int32)),
                            data,
                        ],
                        [x.split()[0] for x in _OCCURRENCE.split(", ")],
                    )

    return texts.select("key", "id", "text", "picked", *(["scope"] if scoped else [])).mapInArrow(run, _OCCURRENCE)


_FOUND = "key bigint, lo bigint, hi bigint, later_lo bigint, later_hi bigint, own_lo bigint, own_hi bigint, first_id bigint"


def sorted_matches(rows: pa.RecordBatch, size: int, distinct: bool = False) -> pa.RecordBatch | None:
    """Repeated windows among occurrences; all rows of a gram must be in ``rows``. For each row that has some: [lo, hi)
    covers them, [later_lo, later_hi) those that stood before, [own_lo, own_hi) their source where it overlaps them."""
    grams, keys, place = (rows.column(c).to_numpy() for c in ("gram", "key", "place"))
    ids = rows.column("id").fill_null(_LAST).to_numpy()
    before, windows = (rows.column(c).to_numpy().astype(np.int64) for c in ("before", "windows"))
    n, most = len(grams), int(before.max(initial=0))
    words = rows.column("words")
    data = np.frombuffer(words.buffers()[2], "<u8") if words.buffers()[2] is not None else np.zeros(0, "<u8")
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64) // 8
    length = np.diff(at) - before  # from the gram on
    col = np.arange(size)
    right = np.where(col < length[:, None], data[np.minimum(at[:-1, None] + before[:, None] + col, len(data) - 1)], 0).astype(">u8")
    col = np.arange(most)
    left = np.where(col < before[:, None], data[np.maximum(at[:-1, None] + before[:, None] - 1 - col, 0)], 0)
    suffix = np.concatenate((grams.astype(">i8").view(">u8").reshape(n, 1), right), axis=1)
    order = np.argsort(np.ascontiguousarray(suffix).view(f"S{suffix.shape[1] * 8}").ravel(), kind="stable")
    same = suffix[order[1:]] == suffix[order[:-1]]
    common = np.where(same.all(axis=1), size + 1, np.argmin(same, axis=1)) - 1  # -1: another gram
    turn = np.lexsort((place, keys, ids))
    rank = np.empty(n, np.int64)
    rank[turn] = np.arange(n)
    big = np.int64(1) << 62
    lo, later_lo, own_lo = (np.full(n, big) for _ in range(3))
    hi, later_hi, own_hi = (np.full(n, -1) for _ in range(3))
    source = np.full(n, -1)
    extended = np.zeros(n, np.uint64)
    for k in range(most + 1):  # the window that begins k words before the gram
        if k:
            extended = _text.mix(extended) + left[:, k - 1]
        run = np.zeros(n, np.uint64)
        run[order[1:]] = np.cumsum(common < size - k).astype(np.uint64)
        mine = np.flatnonzero((before >= k) & (before - k < windows))
        if len(mine) < 2:
            continue
        key = _text.mix(run[mine] * np.uint64(0x9E3779B97F4A7C15) + _text.mix(extended[mine]))
        by = np.argsort(key)
        key, who = key[by], mine[by]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(head)
        many = np.diff(np.append(begin, len(key)))
        first = turn[np.repeat(np.minimum.reduceat(rank[who], begin), many)]
        if distinct:  # equal windows of one document alone don't count
            several = np.minimum.reduceat(keys[who], begin) != np.maximum.reduceat(keys[who], begin)
            hit = np.repeat(several, many)
        else:
            hit = np.repeat(many, many) > 1
        who, first = who[hit], first[hit]
        s = place[who] - k
        lo[who], hi[who] = np.minimum(lo[who], s), np.maximum(hi[who], s + size)
        later = who != first
        who, first, s = who[later], first[later], s[later]
        later_lo[who], later_hi[who] = np.minimum(later_lo[who], s), np.maximum(later_hi[who], s + size)
        source[who] = first
        near = (keys[who] == keys[first]) & (place[who] - place[first] < size)
        who, s = who[near], place[first[near]] - k
        own_lo[who], own_hi[who] = np.minimum(own_lo[who], s), np.maximum(own_hi[who], s + size)
    some = np.flatnonzero(hi >= 0)
    if not len(some):
        return None
    out = [keys[some], lo[some], hi[some]]
    for a, b in ((later_lo, later_hi), (own_lo, own_hi)):
        a[b < 0] = -1
        out += [a[some], b[some]]
    first_id = np.where(source[some] >= 0, ids[np.maximum(source[some], 0)], ids[some])
    arrays = [*map(pa.array, out), pa.array(first_id, mask=first_id == _LAST)]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _FOUND.split(", ")])


def _sorted_groups(rows: DataFrame, size: int, distinct: bool) -> DataFrame:
    """Sort and compare the suffixes of each gram. Rows come ordered by gram; whole grams are gathered up to CHUNK rows."""

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows and (found := sorted_matches(table.combine_chunks().to_batches()[0], size, distinct)):
                yield found

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            grams = table.column("gram").to_numpy()
            cut = int(np.searchsorted(-(grams != grams[-1]).astype(np.int8), 0))  # where the last gram begins
            if cut:
                yield from settle(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                count = table.num_rows - cut
        if held:
            yield from settle(pa.Table.from_batches(held))

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, _FOUND)


def _split_groups(rows: DataFrame, size: int, distinct: bool) -> DataFrame:
    """The same for grams of very many occurrences: windows are counted by their content."""

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                b = batch.slice(k, 4096)
                h = [np.frombuffer(x, "<u8") for x in b.column("words").to_pylist()]
                off = np.cumsum([0, *map(len, h)])
                value, at = _text.windows(np.concatenate(h), off, size)
                row = np.searchsorted(off, at, side="right") - 1
                start = b.column("place").to_numpy()[row] - b.column("before").to_numpy()[row] + at - off[row]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("gram").take(take), pa.array(value.view(np.int64)), b.column("key").take(take), b.column("id").take(take), pa.array(start)], ["gram", "window", "key", "id", "s"])

    flat = rows.mapInArrow(run, "gram bigint, window bigint, key bigint, id bigint, s bigint")
    place = F.struct(F.coalesce("id", F.lit(_LAST)).alias("id"), "key", "s")
    # (two hashes of 64 bits tell windows apart: that of the gram, and that of all words)
    first = flat.groupBy("gram", "window").agg(F.count("*").alias("n"), F.min(place).alias("f"), (F.min("key") != F.max("key")).alias("several"))
    first = written(first.where("several" if distinct else "n > 1").drop("several"), "windows")
    both = flat.join(first, ["gram", "window"])
    later = (F.col("key") != F.col("f.key")) | (F.col("s") != F.col("f.s"))
    near = later & (F.col("key") == F.col("f.key")) & (F.col("s") - F.col("f.s") < size)
    pick = lambda c, x: F.when(c, x).otherwise(-1)
    return both.select(
        "key", F.col("s").alias("lo"), (F.col("s") + size).alias("hi"), pick(later, F.col("s")).alias("later_lo"), pick(later, F.col("s") + size).alias("later_hi"),
        pick(near, F.col("f.s")).alias("own_lo"), pick(near, F.col("f.s") + size).alias("own_hi"), F.nullif(F.col("f.id"), F.lit(_LAST)).alias("first_id"),
    )


_SPANS = "array<struct<start:bigint,end:bigint,first_id:bigint>>"


def _merged(found: DataFrame) -> DataFrame:
    """(key, repeats, removed): the spans of each document in words. A document's rows are as many as its words at most."""

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = part.column(1)
                flat = lists.flatten()
                lo, hi, later_lo, later_hi, own_lo, own_hi = (flat.field(c).to_numpy() for c in ("lo", "hi", "later_lo", "later_hi", "own_lo", "own_hi"))
                ids = flat.field("first_id").fill_null(_LAST).to_numpy()
                off = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
                repeats, removed = [], []
                for x, y in zip(off[:-1], off[1:]):
                    s, e = _text.merge_spans(lo[x:y], hi[x:y])
                    by = np.lexsort((ids[x:y], lo[x:y]))
                    first = ids[x:y][by][np.searchsorted(lo[x:y][by], s)]
                    repeats.append([{"start": u, "end": v, "first_id": None if f == _LAST else f} for u, v, f in zip(s.tolist(), e.tolist(), first.tolist())])
                    gone = np.zeros(int(hi[x:y].max()) + 1, np.int32)
                    for a, b, sign in ((later_lo[x:y], later_hi[x:y], 1), (own_lo[x:y], own_hi[x:y], -(1 << 20))):
                        some = b >= 0
                        np.add.at(gone, a[some], sign)
                        np.add.at(gone, b[some], -sign)
                    change = np.diff(np.concatenate(([0], (np.cumsum(gone) > 0).astype(np.int8), [0])))
                    removed.append([{"start": u, "end": v, "first_id": None} for u, v in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist())])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_id", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(repeats, kind), pa.array(removed, kind)], ["key", "repeats", "removed"])

    grouped = found.groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "later_lo", "later_hi", "own_lo", "own_hi", "first_id")).alias("rows"))
    return grouped.mapInArrow(run, f"key bigint, repeats {_SPANS}, removed {_SPANS}")


def find_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope_col: str | None = None, distinct: bool = False, min_words: int = MIN_WORDS, anchor: int = ANCHOR, hot: int = HOT
) -> DataFrame:
    """Documents with repeated passages: (id, node, n_words, repeats, removed). ``node`` is the text's MD5; spans are in
    words, half-open and ascending; ``first_id`` is the document of the first occurrence of the span's first window;
    ``removed`` leaves out what is a first occurrence. One row for each distinct (id, text) of ``docs``. With ``scope_col``
    only texts of equal scope are compared; with ``distinct`` a window must stand in two different texts, and equal ones
    are one, that has one row."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer: the first occurrence is that of the least one")
    scoped = scope_col is not None
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *([F.coalesce(scope_col, F.lit("")).alias("scope")] if scoped else []))
    rows = written(_grams(base, min_words, anchor, scoped), "grams")
    # equal texts: the row of the smallest id stands for all
    # (written: then the rows of a very common text can be split over tasks in the joins)
    texts = written(rows.groupBy("node").agg(F.min("id").alias("least"), (F.lit(1) if distinct else F.count("*")).alias("copies")), "texts")
    own = rows.join(texts, "node").where(F.col("id").eqNullSafe(F.col("least"))).dropDuplicates(["node"])
    own = written(own.select(F.monotonically_increasing_id().alias("key"), "id", "node", "n_words", "copies", "grams"), "own")
    flat = own.select("key", F.posexplode("grams").alias("i", "gram"))
    # written, so that the join below has a plain shuffle on either side and a very frequent gram can be split
    repeated = written(flat.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    kept = flat.join(repeated, "gram").groupBy("key").agg(F.collect_list(F.struct("i", "n")).alias("p"))
    kept = written(own.drop("grams", "copies").join(kept, "key"), "kept")
    drop_table(repeated)
    whole = base.withColumnRenamed("id", "_id").withColumn("text", F.coalesce("text", F.lit("")))
    whole = whole.withColumn("_node", digest("text", "scope" if scoped else None))
    both = whole.join(kept, F.col("_node").eqNullSafe(F.col("node")) & F.col("_id").eqNullSafe(F.col("id"))).dropDuplicates(["key"])
    # written, so that the texts are shuffled once for both ways
    scope = ["scope"] if scoped else []
    both = written(both.select("key", "id", "text", "p", *scope), "repeated-texts")
    drop_table(kept)
    pick = lambda c: F.transform(F.filter("p", c), lambda x: x["i"])
    found = _sorted_groups(_occurrences(both.withColumn("picked", pick(lambda x: x["n"] <= hot)), min_words, anchor, scoped), min_words, distinct)
    often = both.where(F.exists("p", lambda x: x["n"] > hot))
    if not often.isEmpty():
        rows_of_hot = written(_occurrences(often.withColumn("picked", pick(lambda x: x["n"] > hot)), min_words, anchor, scoped), "hot")
        found = found.unionByName(_split_groups(rows_of_hot, min_words, distinct))
    spans = _merged(found)
    # a text with copies is a repeat from end to end; its first document keeps it
    all_words = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end"), F.col("least").alias("first_id")))
    none = F.array().cast(_SPANS)
    first = own.withColumn("least", F.col("id")).join(spans, "key", "left").where((F.col("copies") > 1) & (F.col("n_words") >= min_words) | F.col("repeats").isNotNull())
    first = first.select("id", "node", "n_words", F.when((F.col("copies") > 1) & (F.col("n_words") >= min_words), all_words).otherwise(F.col("repeats")).alias("repeats"), F.coalesce("removed", none).alias("removed"))
    copies = rows.join(texts.where("copies > 1"), "node").where(F.col("n_words") >= min_words).where(~F.col("id").eqNullSafe(F.col("least")))
    copies = copies.select("id", "node", "n_words", all_words.alias("repeats"), all_words.alias("removed")).dropDuplicates(["id", "node"])
    return first.unionByName(copies)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` without the words of later occurrences; a document of which no word is left goes. White space after a
    removed word goes with it. ``chars_col``, where the table has it, is counted anew for changed texts."""
    found = find_repeats(docs, id_col=id_col, text_col=text_col, **options).where(F.size("removed") > 0)
    found = found.select(F.col("id").alias("_id"), F.col("node").alias("_node"), F.col("removed").alias("_removed"))
    own, named = set_aside(docs)
    own = own.withColumn("digest", digest(named[text_col]))
    both = own.join(found, F.col(named[id_col]).cast("bigint").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_node")), "left")
    names = list(named.values())
    text_at, cut_at = docs.columns.index(text_col), len(names)

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            cuts, keep = batch.column(cut_at).to_pylist(), []
            for i, spans in enumerate(cuts):
                if not spans:
                    keep.append(i)
                    continue
                block = next(_text.blocks(pa.array([texts[i]], pa.string())))
                w = _text.words(block)
                after = np.append(w.start[1:], len(w.buf))
                left = np.ones(len(w.buf), bool)
                gone = 0
                for s in spans:
                    left[w.start[s["start"]] : after[s["end"] - 1]] = False
                    gone += s["end"] - s["start"]
                if gone < len(w.start):
                    keep.append(i)
                    texts[i] = w.buf[left].tobytes().decode()
            columns = list(batch.columns[:cut_at])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in columns], names=names)

    out = put_back(both.select(*names, "_removed").mapInArrow(run, own.drop("digest").schema), named)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out
