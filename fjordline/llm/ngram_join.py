"""Jaccard self-join on word n-grams by vertical partitioning.

The global order of n-grams (by their 64-bit hashes) is cut into fragments of equal
width, which cut every document's sorted set into segments.  A task holds one
fragment; what it counts of a pair is partial, and the parts are summed per pair.

1. Counting.  Fragments tell which n-grams stand in more than one row.  A set with
   J >= t to another shares t of its n-grams at least, so all others drop out here;
   a batch ships each of its n-grams once, 6 bytes each, so a frequent one is no hot key.
   (Shipped are 32 bits within the fragment: a collision keeps a set, it loses none.)
2. Order.  Among what is left, one set of each class of equal ones, fragments count how
   many sets hold each n-gram.  Rare ones first, linked sets share one within their first
   |x| - ceil(t |x|) + 1: sets with one of these in common are a list.
3. Stars.  Each list has a pivot, its least set; every other set of the list is paired with
   it.  Fragment tasks count the partial overlap of each pair, sums decide on links, links
   give components.  That is a row per set and pivot, not per pair of a list.
4. Tiles.  Lists whose other sets lie in several components still hide links between
   them.  Their sets chain to groups; a group is cut into blocks, and a task counts the
   partial overlaps of two blocks in one fragment as one matrix, so that no row per pair
   is made.  Matrices are summed over the fragments, and a tile tells a spanning forest of
   its links.  Blocks of one component needn't meet.  A group of sets that are much alike but
   not linked costs the square of its size here, in tiles; an exact join can't avoid that.

No pair is lost: a linked pair shares a list; it is a star's pair, lies in one component,
or shares a tile.

Defined results: a null or empty text, or one without words, has the empty set and
links with nothing; with fewer words than n the whole sequence is one n-gram; each row
is a document of its own, repeated rows are equal sets; rows without an id link as all
others, and a component goes by its smallest id that isn't null (null if there is none);
ids of any type that has an order; very long texts are taken whole, a task holding the set of
one; columns that clash are left alone, only id and text are read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fjordline.llm import text as tx
from fjordline.llm.spark import BROADCAST_ROWS, Table, attach, components, small_batches, steady

N, NUM, DEN = 3, 90, 100
FRAGMENT_GRAMS = 1_000_000  # of a counting task, about
FRAGMENTS = 8  # of a comparison
BLOCK_GRAMS, BLOCK_SETS = 500_000, 1_000  # of a block of sets that a task compares, about
_NONE = 0xFFFF


def shingle_sets(chunk: tx.Chunk, n: int = N) -> list[np.ndarray]:
    """Each row's distinct n-word shingles as sorted hashes (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased)."""
    w = tx.words(chunk, tx.SOLID, tx.LOWER)
    grams = tx.ngrams(w.hash, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            out.append(tx.mix(tx.ngrams(w.hash[a:b], b - a), 77))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _batch_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a batch end to end, and their sizes."""
    sets = [s for chunk in tx.chunks(texts) for s in shingle_sets(chunk, n)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)


def signatures(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    one, two = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    full = size > 0
    at = (np.cumsum(size) - size)[full]
    if len(at):
        one[full] = np.add.reduceat(tx.mix(flat, 1), at)
        two[full] = np.bitwise_xor.reduceat(tx.mix(flat, 2), at)
    return one, two


def fragment_of(grams: np.ndarray, fragments: int) -> np.ndarray:
    """The fragment of the global order that holds each n-gram: ranges of equal width."""
    return ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def _cuts(ordered: np.ndarray, fragments: int) -> np.ndarray:
    """Where each fragment begins in ascending n-grams; fragments + 1 places."""
    return np.searchsorted(fragment_of(ordered, fragments), np.arange(fragments + 1))


def _binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _read(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) if v.is_valid else np.zeros(0, kind) for v in column]


def _batch_number(seq: int) -> int:
    return (TaskContext.get().partitionId() << 32) + seq


# Step 1: which n-grams stand in more than one row.


def _pieces(n: int, fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for whole in batches:
            for lo in range(0, whole.num_rows, _NONE):
                batch = whole.slice(lo, _NONE)
                number = _batch_number(seq)
                seq += 1
                flat, size = _batch_sets(batch.column(1), n)
                owner = np.repeat(np.arange(len(size)), size)
                by = np.argsort(flat)
                flat_sorted, owner_sorted = flat[by], owner[by]
                head = np.flatnonzero(np.concatenate([[True], flat_sorted[1:] != flat_sorted[:-1]])) if len(flat) else np.zeros(0, np.int64)
                often = np.diff(np.append(head, len(flat)))
                # What the batch holds twice is shared already; it is shipped once, for others to see.
                known = np.bincount(owner_sorted[np.repeat(often > 1, often)], minlength=len(size))
                gram = flat_sorted[head]
                place = np.where(often > 1, _NONE, owner_sorted[head]).astype(np.uint16)
                cut = _cuts(gram, fragments)
                filled = np.flatnonzero(np.diff(cut))
                rest = (gram & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                one, two = signatures(flat, size)
                own = np.stack([one.view(np.int64), two.view(np.int64), size, known])
                ends = np.zeros(len(filled) + 2, np.int32)
                ends[1:] = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(-1 - number % fragments, filled)),
                        pa.array(np.full(len(filled) + 1, number)),
                        pa.ListArray.from_arrays(pa.array(ends), batch.column(0)),
                        _binary([own, *(rest[cut[f] : cut[f + 1]] for f in filled)]),
                        _binary([np.zeros(0, np.uint16), *(place[cut[f] : cut[f + 1]] for f in filled)]),
                    ],
                    names=["frag", "batch", "ids", "a", "b"],
                )

    return run


def _shared(table: pa.Table) -> pa.Table:
    """A fragment's n-grams that stand in several batches, as the batches' places; the batches' own rows pass."""
    if not table.num_rows or table.column("frag")[0].as_py() < 0:
        return table.select(["batch", "ids", "a", "b"])
    grams, places = _read(table.column("a"), np.uint32), _read(table.column("b"), np.uint16)
    # Sorted with their positions in the low half: faster than a sort of positions.
    both = (np.concatenate(grams).astype(np.uint64) << np.uint64(32)) | np.arange(sum(map(len, grams)), dtype=np.uint64)
    both.sort()
    same = (both[1:] >> np.uint64(32)) == (both[:-1] >> np.uint64(32))
    twice = np.zeros(len(both), bool)
    position = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    twice[position[1:][same]] = True
    twice[position[:-1][same]] = True
    ends = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
    found = [p[twice[a:b]] for p, a, b in zip(places, ends[:-1], ends[1:], strict=True)]
    found = [p[p != _NONE] for p in found]
    keep = np.array([len(p) > 0 for p in found])
    out = table.select(["batch", "ids"]).filter(pa.array(keep))
    return out.append_column("a", pa.nulls(out.num_rows, pa.binary())).append_column("b", _binary([p for p in found if len(p)]))


def _tally(table: pa.Table) -> pa.Table:
    """A batch's rows with the number of their n-grams that stand in other rows too."""
    info = [k for k, a in enumerate(table.column("a")) if a.is_valid]
    if not info:
        return pa.table({"id": table.column("ids").combine_chunks().flatten()[:0], **{c: pa.array([], pa.int64()) for c in ("one", "two", "n", "shared")}})
    ids = table.column("ids")[info[0]].values
    one, two, size, known = np.frombuffer(table.column("a")[info[0]].as_buffer(), np.int64).reshape(4, -1)
    places = np.concatenate([np.zeros(0, np.uint16), *_read(table.column("b"), np.uint16)])
    return pa.table({"id": ids, "one": one, "two": two, "n": size, "shared": known + np.bincount(places, minlength=len(size))})


# Step 2: sets that may have partners, and the n-grams by which they meet.


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                flat, size = _batch_sets(batch.column(1).slice(lo, 256), n)
                one, two = signatures(flat, size)
                ends = np.cumsum(size)
                yield pa.RecordBatch.from_arrays([*(pa.array(v.view(np.int64)) for v in (one, two, size)), _binary([flat[b - k : b] for b, k in zip(ends, size, strict=True)])], names=["one", "two", "n", "grams"])

    return run


def _gram_pieces(fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, batch in enumerate(batches):
            number = _batch_number(seq)
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column("grams")]
            flat = np.concatenate([np.zeros(0, np.uint64), *sets])
            gram, often = np.unique(flat, return_counts=True)
            cut = _cuts(gram, fragments)
            filled = np.flatnonzero(np.diff(cut))
            own = np.stack([batch.column("sid").to_numpy(), batch.column("n").to_numpy(), [len(s) for s in sets]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(-1 - number % fragments, filled)),
                    pa.array(np.full(len(filled) + 1, number)),
                    _binary([own, *(gram[cut[f] : cut[f + 1]] for f in filled)]),
                    _binary([flat, *(often[cut[f] : cut[f + 1]] for f in filled)]),
                ],
                names=["frag", "batch", "a", "b"],
            )

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """How many sets hold each n-gram of a fragment, told to each batch in its own order."""
    if not table.num_rows or table.column("frag")[0].as_py() < 0:
        return table
    grams, often = _read(table.column("a"), np.uint64), _read(table.column("b"), np.int64)
    values, which = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(often), minlength=len(values)).astype(np.int64)[which]
    ends = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
    out = table.select(["frag", "batch"])
    return out.append_column("a", pa.nulls(out.num_rows, pa.binary())).append_column("b", _binary([total[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]))


def _prefixes(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        """The n-grams of each set's prefix that other sets hold: (sid, n, gram)."""
        by = np.argsort(table.column("frag").to_numpy(), kind="stable")
        table = table.take(pa.array(by))
        sid, n, held = np.frombuffer(table.column("a")[0].as_buffer(), np.int64).reshape(3, -1)
        flat = np.frombuffer(table.column("b")[0].as_buffer(), np.uint64)
        df = np.concatenate([np.zeros(0, np.int64), *_read(table.column("b").slice(1), np.int64)])
        owner = np.repeat(np.arange(len(sid)), held)
        df = df[np.searchsorted(np.unique(flat), flat)]
        shared = df > 1
        flat, owner, df = flat[shared], owner[shared], df[shared]
        order = np.lexsort((flat, df, owner))
        flat, owner = flat[order], owner[order]
        many = np.bincount(owner, minlength=len(sid))
        need = -(-num * n // den)
        # The prefix has n - need + 1 n-grams, those of one set only (n - many) first.
        take = np.maximum(many - need + 1, 0)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        kept = rank < take[owner]
        return pa.table({"sid": sid[owner[kept]], "n": n[owner[kept]], "gram": flat[kept].view(np.int64)})

    return run


# Steps 3 and 4: partial overlaps by fragment, summed.


def _segments(fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                segs = []
                for v in part.column("grams"):
                    own = np.frombuffer(v.as_buffer(), np.uint64)
                    cut = _cuts(own, fragments)
                    segs += [own[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                again = pa.array(np.repeat(np.arange(part.num_rows), fragments))
                frag = pa.array(np.tile(np.arange(fragments), part.num_rows))
                keep = ("bucket", "a", "b", "c", "role", "sid", "n")
                yield pa.RecordBatch.from_arrays([frag, *(part.column(k).take(again) for k in keep), _binary(segs)], names=["frag", *keep, "seg"])

    return run


def overlap(rows: list[np.ndarray], cols: list[np.ndarray], step: int = 1_000_000) -> np.ndarray:
    """How many n-grams each of rows has in common with each of cols, as a matrix."""
    size = np.array([len(c) for c in cols], np.int64)
    gram = np.concatenate([np.zeros(0, np.uint64), *cols])
    by = np.argsort(gram)
    gram, owner = gram[by], np.repeat(np.arange(len(cols)), size)[by]
    out = np.zeros((len(rows), len(cols)), np.int32)
    mine = np.concatenate([np.zeros(0, np.uint64), *rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    lo = np.searchsorted(gram, mine)
    spans = np.searchsorted(gram, mine, "right") - lo
    # Rows are taken in steps whose matches fit in memory.
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, weights=spans, minlength=len(rows)).astype(np.int64))])
    first = np.searchsorted(row, np.arange(len(rows) + 1))
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + step, "right")) - 1)
        part = slice(first[at], first[to])
        many = spans[part]
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        cell = np.repeat((row[part] - at) * len(cols), many) + owner[np.repeat(lo[part], many) + inner]
        out[at:to] = np.bincount(cell, minlength=(to - at) * len(cols)).reshape(to - at, len(cols))
        at = to
    return out


def _jobs(table: pa.Table, keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    table = table.sort_by([(k, "ascending") for k in keys])
    columns = [table.column(k).to_numpy() for k in keys[:3]]
    change = np.any([c[1:] != c[:-1] for c in columns], axis=0) if table.num_rows else np.zeros(0, bool)
    heads = np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])
    for lo, hi in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        if hi > lo:
            yield tuple(int(c[lo]) for c in columns), table.slice(lo, hi - lo)


def _partial(table: pa.Table) -> pa.Table:
    """The jobs of one fragment: partial overlaps of each job's rows (role 0, 2) and columns (role 1, 2)."""
    out: list[tuple] = []
    for key, job in _jobs(table, ["a", "b", "c", "sid"]):
        role = job.column("role").to_numpy()
        who = np.stack([job.column("sid").to_numpy(), job.column("n").to_numpy()], 1)
        segs = _read(job.column("seg"), np.uint64)
        row, col = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        out.append((*key, who[row], who[col], overlap([segs[k] for k in row], [segs[k] for k in col])))
    bucket = pa.array(np.full(len(out), table.column("bucket")[0].as_py()))
    return pa.table([bucket, *(pa.array([o[k] for o in out], pa.int64()) for k in range(3)), *(_binary([o[k] for o in out]) for k in (3, 4, 5))], names=["bucket", "a", "b", "c", "rows", "cols", "counts"])


def forest(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of a spanning forest of edges between places below count."""
    root = np.arange(count)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if (root == before).all():
            break
    own = np.flatnonzero(root != np.arange(count))
    return own, root[own]


def _total(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        """Partial overlaps summed over the fragments; the links, as edges that span each component."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, job in _jobs(table, ["a", "b", "c"]):
            rows, cols = (np.frombuffer(job.column(k)[0].as_buffer(), np.int64).reshape(-1, 2) for k in ("rows", "cols"))
            both = sum(c.astype(np.int64) for c in _read(job.column("counts"), np.int32)).reshape(len(rows), len(cols))
            union = rows[:, 1][:, None] + cols[:, 1][None, :] - both
            x, y = np.nonzero((den * both >= num * union) & (both > 0))
            names, place = np.unique(np.concatenate([rows[:, 0], cols[:, 0]]), return_inverse=True)
            member, root = forest(place[x], place[len(rows) + y], len(names))
            left.append(names[member])
            right.append(names[root])
        return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})

    return run


def partial_overlaps(jobs: DataFrame, sets: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """jobs: (a, b, c) names a job, role, sid, n; sets: sid, grams.  One row per job and fragment: who, and a matrix of partial overlaps."""
    grams, count = jobs.agg(F.sum("n"), F.count("*")).first()
    sides = jobs.groupBy("a", "b", "c").agg((F.count_if(F.col("role") != 1) * F.count_if(F.col("role") != 0)).alias("cells"))
    cells = sides.agg(F.sum("cells")).first()[0] or 0
    buckets = 8 + max((grams or 0) // (fragments * BLOCK_GRAMS), 4 * cells // BLOCK_SETS**2)
    dealt = attach(sets.select("sid", "grams"), jobs.withColumn("bucket", F.pmod(F.xxhash64("a", "b", "c"), F.lit(buckets))), "sid", rows=count)
    pieces = dealt.mapInArrow(_segments(fragments), "frag long, bucket long, a long, b long, c long, role byte, sid long, n long, seg binary")
    return pieces.groupBy("bucket", "frag").applyInArrow(_partial, "bucket long, a long, b long, c long, rows binary, cols binary, counts binary")


def _links(jobs: Table, sets: DataFrame, num: int, den: int) -> Table:
    edges = Table(partial_overlaps(jobs.df, sets).groupBy("bucket").applyInArrow(_total(num, den), "a long, b long"))
    jobs.drop()
    return edges


def _blocks(total: str, many: str, grams: int, sets: int):
    return F.ceil(F.greatest(F.col(total) / grams, F.col(many) / sets)).cast("long")


def _stars(prefix: DataFrame, lists: DataFrame, num: int, den: int) -> Table:
    """Jobs: each pivot as the row, the sets of its lists as columns, cut into blocks."""
    pairs = attach(prefix, lists, "gram").where((F.col("sid") != F.col("p")) & (den * F.least("n", "p_n") >= num * F.greatest("n", "p_n"))).select("p", "p_n", "sid", "n").distinct()
    pairs = Table(pairs)
    cut = pairs.df.groupBy("p").agg(F.sum("n").alias("t"), F.count("*").alias("m")).select("p", _blocks("t", "m", BLOCK_GRAMS, 50 * BLOCK_SETS).alias("cut"))
    zero, byte = F.lit(0).cast("long").alias("b"), lambda k: F.lit(k).cast("byte").alias("role")
    dealt = attach(pairs.df, cut, "p").withColumn("c", F.pmod(F.xxhash64("sid"), F.col("cut")))
    cols = dealt.select(F.col("p").alias("a"), zero, "c", byte(1), "sid", "n")
    rows = dealt.select(F.col("p").alias("a"), zero, "c", byte(0), F.col("p").alias("sid"), F.col("p_n").alias("n")).distinct()
    jobs = Table(cols.unionAll(rows))
    pairs.drop()
    return jobs


def _tiles(prefix: DataFrame, lists: DataFrame, linked: DataFrame) -> Table | None:
    """Jobs: pairs of blocks of the sets whose lists, but for the pivots, lie in several components."""
    here = attach(prefix, linked.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("comp", F.coalesce("component", "sid"))
    rest = Table(attach(here, lists, "gram").where("sid <> p").select("gram", "sid", "n", "comp"))
    still = rest.df.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("sid").alias("hub")).where("lo <> hi").select("gram", "hub")
    members = Table(attach(rest.df, still, "gram", rows=rest.df.count()).select("sid", "n", "comp", "hub").distinct())
    rest.drop()
    if not members.df.take(1):
        members.drop()
        return None
    groups = components(members.df.select(F.col("sid").alias("a"), F.col("hub").alias("b")))
    sets = Table(attach(members.df.select("sid", "n", "comp").distinct(), groups.select(F.col("node").alias("sid"), F.col("component").alias("g")), "sid"))
    # Large components have blocks of their own; small ones are dealt to blocks whole.
    of_comp = sets.df.groupBy("g", "comp").agg(F.sum("n").alias("t"), F.count("*").alias("m")).withColumn("cut", _blocks("t", "m", BLOCK_GRAMS, BLOCK_SETS))
    of_group = of_comp.where("cut = 1").groupBy("g").agg(F.sum("t").alias("gt"), F.sum("m").alias("gm")).select("g", _blocks("gt", "gm", BLOCK_GRAMS, BLOCK_SETS).alias("g_cut"))
    split = attach(attach(sets.df, of_comp.select("g", "comp", "cut"), ["g", "comp"]), of_group, "g", "left")
    split = split.select("g", "sid", "n", F.when(F.col("cut") > 1, F.col("comp")).otherwise(-1).alias("own"), F.when(F.col("cut") > 1, F.pmod(F.xxhash64("sid"), F.col("cut"))).otherwise(F.pmod(F.xxhash64("comp"), F.col("g_cut"))).alias("k"))
    split = Table(split)
    numbered = split.df.select("g", "own", "k").distinct().withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy("own", "k")) - 1)
    whole = Window.partitionBy("g", "own")
    numbered = numbered.withColumns({"lo": F.min("at").over(whole), "hi": F.max("at").over(whole), "count": F.max("at").over(Window.partitionBy("g")) + 1})
    meets = F.filter(F.sequence(F.lit(0), F.col("count") - 1), lambda j: (F.col("own") < 0) | (j < F.col("lo")) | (j > F.col("hi")))
    dealt = numbered.select("g", "own", "k", "at", F.explode(meets).alias("j"))
    role = F.when(F.col("at") == F.col("j"), 2).when(F.col("at") < F.col("j"), 0).otherwise(1).cast("byte")
    jobs = attach(split.df, dealt, ["g", "own", "k"])
    jobs = Table(jobs.select(F.col("g").alias("a"), F.least("at", "j").cast("long").alias("b"), F.greatest("at", "j").cast("long").alias("c"), role.alias("role"), "sid", "n"))
    for table in (members, sets, split):
        table.drop()
    return jobs


def _counted(docs: DataFrame, n: int) -> Table:
    """Step 1: per row its id, two hashes of its set, n (its size) and shared (how many of its n-grams stand in other rows too, or more)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(16, size // (6 * FRAGMENT_GRAMS))
    id_type = docs.schema["id"].dataType.simpleString()
    pieces = docs.mapInArrow(_pieces(n, fragments), f"frag long, batch long, ids array<{id_type}>, a binary, b binary")
    found = pieces.groupBy("frag").applyInArrow(_shared, f"batch long, ids array<{id_type}>, a binary, b binary")
    return Table(found.groupBy("batch").applyInArrow(_tally, f"id {id_type}, one long, two long, n long, shared long"))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id (the smallest id that links of J >= num / den lead to)."""
    small_batches(docs.sparkSession)
    narrow = steady(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = _counted(narrow, n)
    which = ["one", "two", "n"]
    classes = rows.df.where("n > 0").groupBy(*which).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("shared").alias("shared"))
    classes = Table(classes.withColumns({"sid": F.monotonically_increasing_id(), "alive": den * F.col("shared") >= num * F.col("n")}).where("alive or copies > 1"))
    alive = classes.df.where("alive").select("sid", *which, "rep")
    n_alive = alive.count()
    homes = attach(narrow.where("id is not null"), alive.select(F.col("rep").alias("id")).where("id is not null").distinct(), "id", rows=n_alive).select("id", "text").unionAll(narrow.where("id is null"))
    sets = Table(attach(homes.mapInArrow(_sets(n), "one long, two long, n long, grams binary"), alive.select("sid", *which), which, rows=n_alive).select("sid", "n", "grams").dropDuplicates(["sid"]))
    fragments = max(16, (sets.df.agg(F.sum("n")).first()[0] or 0) // FRAGMENT_GRAMS)
    pieces = "frag long, batch long, a binary, b binary"
    told = sets.df.mapInArrow(_gram_pieces(fragments), pieces).groupBy("frag").applyInArrow(_frequencies, pieces)
    prefix = Table(told.groupBy("batch").applyInArrow(_prefixes(num, den), "sid long, n long, gram long"))
    lists = Table(prefix.df.groupBy("gram").agg(F.min(F.struct("sid", "n")).alias("p"), F.count("*").alias("m")).where("m > 1").select("gram", F.col("p.sid").alias("p"), F.col("p.n").alias("p_n")))
    stars = _links(_stars(prefix.df, lists.df, num, den), sets.df, num, den)
    linked = Table(components(stars.df))
    tiles = _tiles(prefix.df, lists.df, linked.df)
    if tiles is not None:
        more = _links(tiles, sets.df, num, den)
        linked.drop()
        linked = Table(components(stars.df.unionAll(more.df)))
        more.drop()
    named = attach(classes.df, linked.df.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = Table(attach(named.select(*which, "component"), least, "component").select(*which, "component_id"))
    out = attach(rows.df, labels.df, which, "left")
    for table in (classes, sets, prefix, lists, stars, linked):
        table.drop()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one_row(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of docs, that of the smallest id (a null id comes last).  Rows are linked each by
    itself, whatever their ids; rows without words go only for one of the same id.  Columns as they are."""
    rows = Table(docs.withColumn("_fj_row", F.monotonically_increasing_id())).df  # written, so that the numbers hold
    ids = rows.select("_fj_row", F.col(id_col).alias("_fj_id"))
    linked = Table(link(rows, "_fj_row", text_col, **options))
    placed = Table(attach(linked.df, ids, "_fj_row", rows=linked.df.count()))
    wordless = F.when(F.col("n_shingles") == 0, F.col("_fj_id"))
    first = placed.df.groupBy(F.when(wordless.isNull(), F.col("component_id")), wordless).agg(F.min(F.struct(F.col("_fj_id").isNull(), "_fj_id", "_fj_row"))["_fj_row"].alias("_fj_row"))
    lost = Table(placed.df.select("_fj_row").join(first.select("_fj_row"), "_fj_row", "left_anti"))
    linked.drop()
    placed.drop()
    return rows.join(F.broadcast(lost.df) if lost.df.count() <= BROADCAST_ROWS else lost.df, "_fj_row", "left_anti").select(*docs.columns)
