"""Benchmark decontamination with suffix arrays over the training words.

A task's documents are cut into shards of words.  The suffixes of a shard that
start with a word of the benchmark are sorted by prefix doubling; words that no
benchmark item holds end a suffix, as nothing can match across them.  Every
suffix of the benchmark is then binary-searched in the sorted suffixes, word by
word and all at once, which gives the longest verbatim match with its places, and
the places of every window of `window` words.  Documents with a hit are removed.

The benchmark is taken in blocks of at most BLOCK_WORDS words, each broadcast on
its own, so its size needs no bound.

Defined results: a null or empty text has no words and is clean; an item without
words matches nothing; an item shorter than the window is one window; items of
equal text count each; an item without an id hits like any other, but isn't among
the items told; repeated documents are judged each; empty tables give
empty results, an empty benchmark removes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fjordline.llm import text as tx
from fjordline.llm.spark import Table, small_batches

WINDOW = 10
BLOCK_WORDS = 1_000_000
_SPANS = "_fj_n_words long, _fj_spans binary, _fj_items array<string>, _fj_longest long, _fj_longest_at long, _fj_longest_item string"
_OUT = ["_fj_n_words", "_fj_spans", "_fj_items", "_fj_longest", "_fj_longest_at", "_fj_longest_item"]


class Items:
    """A block of the benchmark: its words as ranks, item by item, each item closed by rank 0."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int) -> None:
        self.ids = ids
        hashes, owner, left = [], [], []
        chunk_base = 0
        for chunk in tx.chunks(pa.array(texts, pa.large_string())):
            w = tx.words(chunk)
            for row in range(len(w.first) - 1):
                own = w.hash[w.first[row] : w.first[row + 1]]
                n = len(own)
                hashes.append(np.append(own, np.uint64(0)))
                owner.append(np.full(n + 1, chunk_base + row))
                # A window starts where enough words are left; a shorter item is a window from its first word.
                need = np.zeros(n + 1, np.int64)
                if n >= window:
                    need[: n - window + 1] = window
                elif n:
                    need[0] = n
                left.append(need)
            chunk_base += len(w.first) - 1
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.need = np.concatenate(left) if left else np.zeros(0, np.int64)
        self.end = self.hash == 0
        self.vocabulary = np.unique(self.hash[~self.end])
        self.rank = np.where(self.end, 0, np.searchsorted(self.vocabulary, self.hash) + 1)
        self.longest = int(np.diff(np.flatnonzero(np.concatenate([[True], self.end]))).max()) if len(self.hash) else 0


def suffix_array(rank: np.ndarray, depth: int) -> np.ndarray:
    """The positions with rank > 0 in the order of their suffixes' first `depth` ranks (0 ends a suffix)."""
    at = np.flatnonzero(rank > 0)
    order = rank.astype(np.int64)
    size = 1
    while size < depth and len(at):
        behind = np.zeros(len(at), np.int64)
        inside = at + size < len(order)
        behind[inside] = order[at[inside] + size]
        pair = order[at] * (int(order.max()) + 1) + behind
        distinct, place = np.unique(pair, return_inverse=True)
        order = np.zeros(len(order), np.int64)
        order[at] = place + 1
        size *= 2
        if len(distinct) == len(at):
            break
    return at[np.argsort(order[at], kind="stable")]


def search(rank: np.ndarray, suffixes: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """Matches of the benchmark's suffixes: (suffix, lo, hi) of each whole window found, and the longest match of each suffix: (suffix, length, lo)."""
    padded = np.append(rank, np.zeros(items.longest + 1, rank.dtype))
    alive = np.flatnonzero(~items.end)
    lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), len(suffixes), np.int64)
    found, best = [], []
    depth = 0
    while len(alive):
        want = items.rank[alive + depth]
        live = (want > 0) & (hi > lo)
        bounds = []
        for strict in (False, True):
            a, b = lo.copy(), hi.copy()
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = (a + b) >> 1
                here = padded[suffixes[np.minimum(mid, len(suffixes) - 1)] + depth]
                right = open_ & ((here <= want) if strict else (here < want))
                a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
            bounds.append(a)
        ok = live & (bounds[1] > bounds[0])
        if depth:
            ended = ~ok
            best.append((alive[ended], np.full(int(ended.sum()), depth), lo[ended]))
        alive, lo, hi = alive[ok], bounds[0][ok], bounds[1][ok]
        depth += 1
        whole = items.need[alive] == depth
        found.append((alive[whole], lo[whole], hi[whole]))
    cat = lambda parts, k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
    return *(cat(found, k) for k in range(3)), *(cat(best, k) for k in range(3))


def shard_hits(chunk: tx.Chunk, items: Items) -> list[tuple]:
    """For each document of the chunk: words, hit spans (start, end), items, longest match with its place and item."""
    w = tx.words(chunk)
    rows = len(w.first) - 1
    # One rank-0 cell after each document keeps matches inside it.
    cell = np.arange(len(w.hash)) + w.row
    place = np.searchsorted(items.vocabulary, w.hash)
    known = place < len(items.vocabulary)
    known[known] = items.vocabulary[place[known]] == w.hash[known]
    rank = np.zeros(len(w.hash) + rows, np.int64)
    rank[cell] = np.where(known, place + 1, 0)
    spans: list[list] = [[] for _ in range(rows)]
    own: list[set] = [set() for _ in range(rows)]
    longest = [(0, -1, None)] * rows
    if len(items.hash) and known.any():
        suffixes = suffix_array(rank, items.longest)
        suffix, lo, hi, bs, bl, blo = search(rank, suffixes, items)
        start_cell = w.first[:-1] + np.arange(rows)
        if len(suffix):
            which = np.repeat(np.arange(len(suffix)), hi - lo)
            at = suffixes[np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
            row = np.searchsorted(start_cell, at, "right") - 1
            begin = at - start_cell[row]
            size = items.need[suffix[which]]
            pair = np.unique(row * (len(items.ids) + 1) + items.owner[suffix[which]])
            for r, i in zip(pair // (len(items.ids) + 1), pair % (len(items.ids) + 1), strict=True):
                own[r].add(int(i))
            order = np.lexsort((begin, row))
            row, begin, stop = row[order], begin[order], (begin + size)[order]
            reach = np.maximum.accumulate(stop + row * (1 << 40))
            fresh = np.ones(len(row), bool)
            fresh[1:] = (begin + row * (1 << 40))[1:] > reach[:-1]
            head = np.flatnonzero(fresh)
            for k, h in enumerate(head):
                spans[row[h]].append((int(begin[h]), int(reach[(head[k + 1] if k + 1 < len(head) else len(row)) - 1] - row[h] * (1 << 40))))
        if len(bs):
            at = suffixes[blo]
            row = np.searchsorted(start_cell, at, "right") - 1
            order = np.lexsort((bs, at, -bl, row))
            head = order[np.unique(row[order], return_index=True)[1]]
            for h in head:
                longest[row[h]] = (int(bl[h]), int(at[h] - start_cell[row[h]]), items.ids[items.owner[bs[h]]])
    n = np.diff(w.first)
    return [(int(n[r]), spans[r], sorted({items.ids[i] for i in own[r]} - {None}), *longest[r]) for r in range(rows)]


def _scan(shared, text_col: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in batches:
            hits = [h for chunk in tx.chunks(batch.column(text_col)) for h in shard_hits(chunk, items)]
            own = [[h[0] for h in hits], [np.array(h[1], np.int64).tobytes() for h in hits], [h[2] for h in hits], [h[3] for h in hits], [h[4] for h in hits], [h[5] for h in hits]]
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(c, k) for c, k in zip(own, kinds, strict=True))], names=[*keep, *_OUT])

    return run


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int, window: int) -> Iterator[Items]:
    """The benchmark in blocks of at most block_words words (or one item), in order of item, streamed through the driver; one block at least."""
    ids: list[str | None] = []
    texts: list[str | None] = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).orderBy("i", "t")
    for item, text in rows.toLocalIterator():
        n = len(text or "")
        if ids and size + n > block_words * 6:
            yield Items(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text)
        size += n
    yield Items(ids, texts, window)


def _merge(spans: list[bytes | None]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(tuple(x) for s in spans if s for x in np.frombuffer(s, np.int64).reshape(-1, 2).tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _union(spans: pd.Series) -> pd.Series:
    return spans.map(_merge)


def _found(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str, item_col: str, item_text_col: str, window: int, block_words: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(*dict.fromkeys([*keep, text_col]))
    blocks = [spark.sparkContext.broadcast(block) for block in item_blocks(benchmark, item_col, item_text_col, block_words, window)]
    if len(blocks) > 1:  # each block scans the rows again: a written number tells them apart
        narrow = Table(narrow.withColumn("_fj_row", F.monotonically_increasing_id())).df
        keep = [*keep, "_fj_row"]
    schema = T.StructType([*(narrow.schema[k] for k in keep), *T._parse_datatype_string(_SPANS).fields])
    parts = [narrow.mapInArrow(_scan(block, text_col, keep), schema) for block in blocks]
    if len(parts) == 1:
        return parts[0].withColumn("_fj_spans", F.array("_fj_spans"))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionAll(p)
    best = F.max(F.struct("_fj_longest", (-F.col("_fj_longest_at")).alias("at"), "_fj_longest_item"))
    merged = merged.groupBy(*keep, "_fj_n_words").agg(F.collect_list("_fj_spans").alias("_fj_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_fj_items")))).alias("_fj_items"), best.alias("_fj_best"))
    return merged.withColumns({"_fj_longest": F.col("_fj_best._fj_longest"), "_fj_longest_at": -F.col("_fj_best.at"), "_fj_longest_item": F.col("_fj_best._fj_longest_item")}).drop("_fj_best")


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: the id, n_words, spans (words that windows cover, as [start, end)), n_hit, items, contaminated, and the
    longest verbatim match: longest (words), longest_at (its first word), longest_item."""
    found = _found(docs, benchmark, [id_col], text_col, item_col, item_text_col, window, block_words)
    union = F.pandas_udf(_union, "array<array<long>>")
    found = found.withColumn("spans", F.when(F.exists("_fj_spans", lambda s: F.length(s) > 0), union("_fj_spans")).otherwise(F.expr("cast(array() as array<array<bigint>>)")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    return found.select(id_col, F.col("_fj_n_words").alias("n_words"), hit.alias("n_hit"), "spans", F.col("_fj_items").alias("items"), (F.size("spans") > 0).alias("contaminated"), F.col("_fj_longest").alias("longest"), F.col("_fj_longest_at").alias("longest_at"), F.col("_fj_longest_item").alias("longest_item"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows that hold a window of the benchmark; columns as they are."""
    spark = docs.sparkSession
    small_batches(spark)
    out = docs
    for block in item_blocks(benchmark, item_col, item_text_col, block_words, window):
        out = out.mapInArrow(_drop(spark.sparkContext.broadcast(block), text_col), docs.schema)
    return out


def _drop(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [not h[1] for chunk in tx.chunks(batch.column(text_col)) for h in shard_hits(chunk, shared.value)]
            yield batch.filter(pa.array(hits, pa.bool_()))

    return run
