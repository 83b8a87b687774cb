"""Quality classifier: a second-order factorisation machine.

Inputs are hashed words of the whole text, statistics of its structure and the
n_chars column, each statistic cut into bins.  The score is
    w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],
the identity that gives all pairwise interactions in time linear in the inputs
(Rendle, 2010), through the logistic function.

The machine is fitted by AdaGrad on at most `sample` labelled rows, the first by a
hash of the id; held-out rows (crc32 of the id as text, mod 5, is 0) never count.
Labels, language, source and id are no inputs.

Defined results: a null text is an empty one and is scored by its statistics; a
null n_chars counts as -1; labels that are null or of unknown documents are left
out; of repeated labels the largest counts; without labels every score is 0.5;
repeated rows are scored each, and one row of an id teaches; a statistic on the border of two bins is in the upper one; a
very long text is scored whole; columns that clash are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordline.llm import text as tx
from fjordline.llm.spark import held_out, small_batches

SAMPLE = 8_000
WORDS = 1 << 16
FACTORS = 8
BINS = 16
EPOCHS = 4
STATS = ("log_words", "log_chars", "upper", "signs", "bars", "bangs", "stops", "digits", "high", "lines", "word_length", "distinct", "repeats", "dup_lines", "top_word", "metadata")


def _share(chunk: tx.Chunk, members: bytes | np.ndarray) -> np.ndarray:
    flags = members if isinstance(members, np.ndarray) else np.isin(np.arange(256), list(members))
    return np.diff(np.concatenate([[0], np.cumsum(flags[chunk.raw])])[chunk.at])


def features(chunk: tx.Chunk, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of each distinct hashed word, sorted, and the matrix of STATS by row."""
    rows = len(chunk.at) - 1
    w = tx.words(chunk)
    n = np.diff(w.first)
    pair, often = np.unique(w.row * WORDS + (w.hash % np.uint64(WORDS)).astype(np.int64), return_counts=True)
    row, bucket = pair // WORDS, pair % WORDS
    top = np.zeros(rows)
    np.maximum.at(top, row, often)
    grams = tx.ngrams(w.hash, 3)
    at = np.flatnonzero(w.row[: len(grams)] == w.row[2:]) if len(grams) else np.zeros(0, np.int64)
    _, which, count = np.unique(tx.mix(grams[at] ^ tx.mix(w.row[at].astype(np.uint64), 4)), return_inverse=True, return_counts=True)
    repeats = np.bincount(w.row[at[count[which] > 1]], minlength=rows)
    start, end, line_row, _ = tx.lines(chunk)
    line = np.unique(tx.mix(tx.hash_spans(chunk.raw, start, end) ^ tx.mix(line_row.astype(np.uint64), 3)), return_index=True)[1]
    n_lines = np.bincount(line_row, minlength=rows)
    size = np.maximum(np.diff(chunk.at), 1)
    words = np.maximum(n, 1)
    upper = (np.arange(256) >= 65) & (np.arange(256) <= 90)
    stats = [
        np.log1p(n), np.log1p(np.diff(chunk.at)), _share(chunk, upper) / size, _share(chunk, b"#*$%&<>@~^{}[]") / size, _share(chunk, b"|") / size, _share(chunk, b"!?") / size,
        _share(chunk, b".,;:") / words, _share(chunk, b"0123456789") / size, _share(chunk, np.arange(256) >= 0xC0) / size, n_lines / words, np.bincount(w.row, weights=w.end - w.start, minlength=rows) / words,
        np.bincount(row, minlength=rows) / words, repeats / words, 1 - np.bincount(line_row[line], minlength=rows) / n_lines, top / words, np.log1p(np.maximum(n_chars, -0.5)),
    ]
    return row, bucket, np.stack(stats, 1)


class Machine:
    """Edges of the statistics' bins and the weights of WORDS + len(STATS) * BINS inputs."""

    def __init__(self, edges: np.ndarray, seed: int = 7) -> None:
        self.edges = edges  # len(STATS) x (BINS - 1)
        size = WORDS + len(STATS) * BINS
        self.w0 = 0.0
        self.w = np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, FACTORS)).astype(np.float32)

    def inputs(self, row: np.ndarray, bucket: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices and values, row by row, and where each row begins.  Each word counts 1 / sqrt(distinct words), each bin 1 / 2."""
        rows = len(stats)
        bins = np.stack([np.searchsorted(self.edges[k], stats[:, k]) for k in range(len(STATS))], 1)
        extra = (WORDS + np.arange(len(STATS)) * BINS + bins).ravel()
        own = np.bincount(row, minlength=rows)
        index = np.concatenate([bucket, extra])
        value = np.concatenate([(1 / np.sqrt(np.maximum(own, 1)))[row], np.full(len(extra), 0.5)]).astype(np.float32)
        order = np.argsort(np.concatenate([row, np.repeat(np.arange(rows), len(STATS))]), kind="stable")
        return index[order], value[order], np.concatenate([[0], np.cumsum(own + len(STATS))])

    def raw(self, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scores before the logistic function, sum v x by row, and v x by input."""
        vx = self.v[index] * value[:, None]
        total = np.add.reduceat(vx, at[:-1], axis=0)
        square = np.add.reduceat(vx * vx, at[:-1], axis=0)
        return self.w0 + np.add.reduceat(self.w[index] * value, at[:-1]) + 0.5 * (total * total - square).sum(1), total, vx

    def score(self, row: np.ndarray, bucket: np.ndarray, stats: np.ndarray) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.inputs(row, bucket, stats))[0].astype(float), -30, 30)))

    def fit(self, index: np.ndarray, value: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4, batch: int = 256) -> None:
        rng = np.random.default_rng(11)
        gw, gv, g0 = np.full(len(self.w), 1e-4, np.float32), np.full(self.v.shape, 1e-4, np.float32), 1e-4
        # Both labels weigh alike, however rare one is.
        mean = min(max(float(y.mean()), 0.01), 0.99)
        share = np.where(y > 0.5, 0.5 / mean, 0.5 / (1 - mean))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                size = at[rows + 1] - at[rows]
                begin = np.cumsum(size) - size
                take = np.arange(int(size.sum())) - np.repeat(begin, size) + np.repeat(at[rows], size)
                i, x = index[take], value[take]
                raw, total, vx = self.raw(i, x, np.append(begin, len(take)))
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) * share[rows]
                err = err.astype(np.float32)
                each = np.repeat(err, size) * x
                grad = each[:, None] * (np.repeat(total, size, axis=0) - vx)
                used, place = np.unique(i, return_inverse=True)
                by = np.argsort(place, kind="stable")
                head = np.flatnonzero(np.concatenate([[True], np.diff(place[by]) > 0]))
                dw = np.add.reduceat(each[by], head) / len(rows) + decay * self.w[used]
                dv = np.add.reduceat(grad[by], head, axis=0) / len(rows) + decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
                d0 = float(err.mean())
                g0 += d0 * d0
                self.w0 -= rate * d0 / np.sqrt(g0)


def sample_labels(labels: DataFrame, label_col: str, id_col: str, sample: int) -> DataFrame:
    """At most `sample` labelled, not held-out ids with their label y, the first by a hash of the id."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    return usable.groupBy(F.col(id_col).alias("_fj_id")).agg(F.max(label_col).cast("double").alias("_fj_y")).orderBy(F.xxhash64("_fj_id"), "_fj_id").limit(sample)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch.column(2).to_numpy()
        n_chars = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        for chunk in tx.chunks(batch.column(0)):
            row, bucket, stats = features(chunk, n_chars[chunk.lo : chunk.hi])
            at = np.searchsorted(row, np.arange(chunk.hi - chunk.lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(y[chunk.lo : chunk.hi]), pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32))), pa.array(list(stats.astype(np.float32)), pa.list_(pa.float32()))], names=["y", "words", "stats"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str | None = "n_chars", sample: int = SAMPLE) -> Machine:
    """A machine fitted on the driver; what is gathered is bounded by `sample` rows."""
    small_batches(docs.sparkSession)
    picked = sample_labels(labels, label_col, id_col, sample)  # at most `sample` rows: safe to broadcast
    chars = F.coalesce(F.col(chars_col).cast("double"), F.lit(-1.0)) if chars_col else F.lit(-1.0)
    rows = docs.select(F.col(id_col).alias("_fj_id"), F.col(text_col).alias("text"), chars.alias("chars")).join(F.broadcast(picked), "_fj_id")
    # Of rows of one id one teaches, the first by a hash.
    rows = rows.groupBy("_fj_id").agg(F.min_by(F.struct("text", "chars", "_fj_y"), F.xxhash64("text", "chars")).alias("r")).select("r.*")
    table = rows.select("text", "chars", "_fj_y").mapInArrow(_collect, "y double, words array<int>, stats array<float>").toArrow()
    stats = np.array(table.column("stats").combine_chunks().flatten() if table.num_rows else [], np.float64).reshape(-1, len(STATS))
    y = table.column("y").to_numpy().astype(float)
    if not len(y):
        nothing = Machine(np.zeros((len(STATS), BINS - 1)))
        nothing.v[:] = 0
        return nothing
    # The order in which rows arrive must not matter.
    words = table.column("words").combine_chunks()
    order = np.lexsort((*stats.T, y))
    machine = Machine(np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T)
    at, flat = words.offsets.to_numpy(), words.values.to_numpy()
    size = np.diff(at)[order]
    take = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[:-1][order], size)
    machine.fit(*machine.inputs(np.repeat(np.arange(len(y)), size), flat[take].astype(np.int64), stats[order]), y[order])
    return machine


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_chars = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            got = [shared.value.score(*features(chunk, n_chars[chunk.lo : chunk.hi])) for chunk in tx.chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got) if got else np.zeros(0))], names=["id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str | None = "n_chars", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: the id, held_out, score (0 to 1), predicted (1 from `threshold` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, chars_col, sample))
    chars = F.coalesce(F.col(chars_col).cast("double"), F.lit(-1.0)) if chars_col else F.lit(-1.0)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), chars.alias("chars")).mapInArrow(_score(shared), f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
