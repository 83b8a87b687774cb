"""Line dedup with a deletion-neighbourhood join.

Lines are the `\\n`-split pieces of the texts, in the order (id, line number).  A
line goes if an earlier one, kept or not, is equal to it or within one edit of a
code point; the earliest stays.  Blank lines always stay, and lines of fewer than
`least` code points go only for equal ones.

Near lines meet by deletion: every line gives the hashes of itself and of itself
without each of its code points.  A substitution makes two lines equal without the
same place, an insertion makes the one equal to the other without a place, so a key
of these three kinds holds only lines within the bound, and the earliest line of a
key is witness for all others: no pairs are made.  The edit distance to the witness
is then verified on the texts.

Only lines that can have a partner give their neighbourhood.  One edit leaves the
first or the second half as it is (for an insertion, either half of the shorter
line), so the hashes of those halves are counted first; a line that shares none of
them with a different line has no partner and drops out, and the others give variants
only of the half that a shared one leaves open.  Keys are aggregated, combined before
they are shuffled, so a key of very many lines is no task of its own.

Defined results: a document is a pair of id and text, so repeated rows are one
document, and rows that share an id, or have none, are documents each if their texts
differ, in the order of a hash; a null id sorts first; a null text has no lines, an empty
one a blank line; of equal lines the earliest stays; a very long line is a line like any
other (a task holds its variants in steps); only id and text are read, so columns that
clash are left alone; an empty table gives an empty result.  Should two different keys
have one 64-bit hash, verification keeps the line; lines are equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordline.llm import text as tx
from fjordline.llm.spark import Table, attach, small_batches

LEAST = 10
_SPACE = np.array([9, 10, 11, 12, 13, 32])
_VALUE = np.uint64(0x9E3779B97F4A7C15)
_POINT = np.uint64(0xD6E8FEB86659FD93)


def points(line: bytes) -> np.ndarray:
    return np.frombuffer(line.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """P[i] hashes codes[:i]: sums of mixed code points times powers of an odd base."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(tx.mix(codes.astype(np.uint64), 9) * tx._powers(len(codes) + 1)[: len(codes)], out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Hash of codes[a:b] as if it began at place a - shift.  Works on any places at once."""
    return (prefix[b] - prefix[a]) * _inverse(shift)


_INV = np.ones(1, np.uint64)
_BASE_INVERSE = np.uint64(pow(int(tx._BASE), -1, 2**64))


def _inverse(n: np.ndarray) -> np.ndarray:
    """Powers of the base to -n."""
    global _INV
    most = int(n.max(initial=0)) + 1
    if len(_INV) < most:
        steps = np.full(max(most, 2 * len(_INV), 256), _BASE_INVERSE, np.uint64)
        steps[0] = 1
        _INV = np.multiply.accumulate(steps)
    return _INV[n]


def _places(chunk: tx.Chunk, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of the chunk, without making a string of each line, and each line's span in them."""
    lead = (chunk.raw & 0xC0) != 0x80
    codes = points(chunk.raw.tobytes())
    place = np.concatenate([[0], np.cumsum(lead)])
    if len(codes) != place[-1]:  # not UTF-8: bytes stand in for code points
        return chunk.raw.astype(np.uint32), start, end
    return codes, place[start], place[end]


def _whole(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tx.mix(spans_hash(prefix, a, b, a) + (b - a).astype(np.uint64) * _VALUE)


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tx.chunks(batch.column(2)):
                start, end, row, first = tx.lines(chunk)
                codes, a, b = _places(chunk, start, end)
                solid = np.concatenate([[0], np.cumsum(~np.isin(codes, _SPACE))])
                blank = solid[b] == solid[a]
                prefix = prefix_hashes(codes)
                n = b - a
                whole = _whole(prefix, a, b)
                keys = []
                for longer in (0, 1):  # as it is, and as the longer line of an insertion
                    m = np.maximum(n - longer, 0)
                    h = m // 2
                    salt = m.astype(np.uint64) * _POINT
                    keys.append(tx.mix(spans_hash(prefix, a, a + h, a) + salt, 21))
                    keys.append(tx.mix(spans_hash(prefix, np.minimum(a + h + longer, b), b, np.minimum(a + h + longer, b)) + salt, 22))
                none = blank | (n < least)
                long = lambda v, m=None: pa.array(v.view(np.int64), pa.int64(), mask=m)
                which = pa.array(row)
                own = [batch.column(k).slice(chunk.lo, chunk.hi - chunk.lo).take(which) for k in (0, 1)]
                number = pa.array((np.arange(len(row)) - first[:-1][row]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*own, number, pa.array(blank), long(whole), *(long(k, none) for k in keys)], names=["id", "doc", "line", "blank", "h", "k0", "k1", "k2", "k3"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in tx.chunks(batch.column(1)):
            start, end, row, first = tx.lines(chunk)
            raw = chunk.raw.tobytes()
            doc = batch.column(0).slice(chunk.lo, chunk.hi - chunk.lo).take(pa.array(row))
            number = pa.array((np.arange(len(row)) - first[:-1][row]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([doc, number, pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(start.tolist(), end.tolist(), strict=True)], pa.string())], names=["doc", "line", "text"])


#: Bits of `halves`: the line as it is shares its first, its second half; as the longer line of an insertion its first, its second.
ALL = 15


def neighbourhood(codes: np.ndarray, halves: int = ALL) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their roles: 0 without a place, keyed by place (substitution); 1 without a place (the longer of an insertion); 2 whole
    (the shorter).  A shared half says that the place is in the other one."""
    n = len(codes)
    prefix = prefix_hashes(codes)
    i = np.arange(n)
    # codes without place i: what stands before it, and what stands after it moved one to the left.
    cut = prefix[i] + (prefix[n] - prefix[i + 1]) * _BASE_INVERSE
    salt = np.full(1, max(n - 1, 0), np.uint64) * _VALUE
    half, shorter_half = n // 2, max(n - 1, 0) // 2
    place = i[half if not halves & 2 else 0 : half if not halves & 1 else n]
    by_place = tx.mix(cut[place] + salt + (place + 1).astype(np.uint64) * _POINT, 31)
    some = i[shorter_half if not halves & 8 else 0 : n if halves & 4 else shorter_half + 1 if halves & 8 else shorter_half]
    fresh = np.ones(len(some), bool)  # a run gives the same line wherever it is cut
    fresh[1:] = codes[some[1:]] != codes[some[:-1]]
    shorter = tx.mix(cut[some[fresh]] + salt, 32)
    whole = tx.mix(prefix[n : n + 1] + np.full(1, n, np.uint64) * _VALUE, 32)[: 1 if halves & 3 else 0]
    return np.concatenate([by_place, shorter, whole]), np.concatenate([np.zeros(len(by_place), np.int8), np.ones(len(shorter), np.int8), np.full(len(whole), 2, np.int8)])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, roles, owners, held = [], [], [], 0
        numbers, halves = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k in range(batch.num_rows):
            key, role = neighbourhood(points(batch.column(2)[k].as_py().encode()), halves[k])
            keys.append(key)
            roles.append(role)
            owners.append(np.full(len(key), numbers[k]))
            held += len(key)
            if held > 200_000 or k + 1 == batch.num_rows:
                flat = [np.concatenate(x) for x in (keys, roles, owners)]
                for lo in range(0, held, 200_000):
                    part = slice(lo, lo + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(flat[0][part].view(np.int64)), pa.array(flat[1][part]), pa.array(flat[2][part])], names=["key", "role", "no"])
                keys, roles, owners, held = [], [], [], 0


def _doc(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per line that goes: the id, doc (xxhash64 of id and text), line, kind ('exact' or 'near'), and the earlier line it goes for: of_id, of_doc, of_line."""
    return _decide(docs, id_col, text_col, least)[0].distinct()


def _near(texts: DataFrame) -> Table:
    """(no, witness): each line's earliest one within one edit.  texts: no, halves, text; numbers in the order of lines."""
    keys = texts.select("no", "halves", "text").mapInArrow(_neighbours, "key long, role byte, no long")
    of = lambda f, role: f(F.when(F.col("role") == role, F.col("no")))
    met = keys.groupBy("key").agg(of(F.min, 0).alias("n0"), of(F.max, 0).alias("x0"), of(F.min, 1).alias("n1"), of(F.min, 2).alias("n2"))
    met = Table(met.where("n0 < x0 or (n1 is not null and n2 is not null)").select("key", "n0", "n1", "n2"))
    witness = F.when(F.col("role") == 0, F.col("n0")).when(F.col("role") == 1, F.col("n2")).otherwise(F.col("n1"))
    first = attach(keys, met.df, "key").select("no", witness.alias("witness")).where("witness < no").groupBy("no").agg(F.min("witness").alias("witness"))
    first = Table(first)
    met.drop()
    return first


def _decide(docs: DataFrame, id_col: str, text_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), _doc(id_col, text_col).alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    id_type = docs.schema[id_col].dataType.simpleString()
    lines = Table(narrow.mapInArrow(_lines(least), f"id {id_type}, doc long, line long, blank boolean, h long, k0 long, k1 long, k2 long, k3 long"))
    me = F.struct("id", "doc", "line")
    firsts = lines.df.where("not blank").groupBy("h").agg(F.min(me).alias("first"), F.max(me).alias("last"))
    exact = Table(firsts.where("first <> last").select("h", "first"))
    halves = lines.df.where("k0 is not null").select("h", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("k", "key"))
    shared = Table(halves.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key"))
    able = Table(attach(halves, shared.df, "key").groupBy("h").agg(F.expr("bit_or(shiftleft(1, k))").alias("halves")))
    # The first of each line that may have a partner, with its text, numbered in order.
    origin = attach(lines.df.select("h", "id", "doc", "line"), able.df, "h").groupBy("h", "halves").agg(F.min(me).alias("at"))
    origin = Table(origin.select("h", "halves", "at.id", "at.doc", "at.line"))
    homes = attach(narrow.select("doc", "text"), origin.df.select("doc").distinct(), "doc")
    texts = attach(homes.mapInArrow(_texts, "doc long, line long, text string"), origin.df, ["doc", "line"]).dropDuplicates(["h"])
    texts = Table(texts.orderBy("id", "doc", "line").withColumn("no", F.monotonically_increasing_id()))
    first = _near(texts.df)
    count = first.df.count()
    theirs = texts.df.select(F.col("no").alias("witness"), F.col("text").alias("of_text"), F.struct("id", "doc", "line").alias("near"))
    near = attach(texts.df.select("no", "h", "text"), first.df, "no", rows=count)
    near = attach(theirs, near, "witness", rows=count).where(F.levenshtein("text", "of_text", 1).between(0, 1))
    near = Table(near.select("h", "near"))
    rows = lines.df.where("not blank").select("id", "doc", "line", "h")
    rows = attach(attach(rows, exact.df, "h", "left"), near.df, "h", "left")
    equal = F.col("first").isNotNull() & (F.col("first") != me)
    gone = rows.withColumn("kind", F.when(equal, "exact").when(F.col("near").isNotNull(), "near")).where("kind is not null")
    gone = gone.withColumn("of", F.when(F.col("kind") == "exact", F.least("first", F.coalesce("near", "first"))).otherwise(F.col("near")))
    for table in (shared, able, origin, texts, first):
        table.drop()
    return gone.select("id", "doc", "line", "kind", F.col("of.id").alias("of_id"), F.col("of.doc").alias("of_doc"), F.col("of.line").alias("of_line")), lines.df


def _counted(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """Per document (doc): n_lines, and of the lines that go n_exact, n_near, gone (their numbers)."""
    gone, lines = _decide(docs, id_col, text_col, least)
    gone = gone.select("doc", "line", "kind").distinct().groupBy("doc").agg(F.count_if(F.col("kind") == "exact").alias("n_exact"), F.count_if(F.col("kind") == "near").alias("n_near"), F.array_sort(F.collect_list("line")).alias("gone"))
    return lines.groupBy("doc").agg((F.max("line") + 1).alias("n_lines")).join(gone, "doc", "left")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row of docs: the id, n_lines, n_exact, n_near (lines that go), n_kept, gone (their numbers)."""
    counted = _counted(docs, id_col, text_col, least)
    out = docs.select(F.col(id_col).alias("id"), _doc(id_col, text_col).alias("doc")).join(counted, "doc", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), zero("n_lines").alias("n_lines"), zero("n_exact").alias("n_exact"), zero("n_near").alias("n_near"), (zero("n_lines") - zero("n_exact") - zero("n_near")).alias("n_kept"), F.coalesce("gone", F.expr("cast(array() as array<bigint>)")).alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs with the lines that go taken out of the text; columns as they are."""
    gone = _counted(docs, id_col, text_col, least).where(F.size("gone") > 0).select(F.col("doc").alias("_fj_doc"), F.col("gone").alias("_fj_gone"))
    joined = docs.join(gone, _doc(id_col, text_col) == F.col("_fj_doc"), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.col("_fj_gone"), i.cast("long"))), "\n")
    return joined.withColumn(text_col, F.when(F.col("_fj_gone").isNull(), F.col(text_col)).otherwise(kept)).select(*[c for c in docs.columns])
