"""Masked pseudo-likelihood scoring with a bidirectional window network.

Every word of a text is predicted from REACH words on either side, itself masked:
    h = tanh(b + sum_p E[context_p] * P_p),   p(word) = p(class | h) p(word | class, h),
two softmaxes over 64, as a word is one of 64 classes of 64.  The most frequent words
of the corpus have numbers of their own, all others share numbers by hash; a shared number's
probability is split among its words by their counts, so that every word has a
probability of its own (a word that wasn't counted has one as if counted once more).  A
text's score is the sum of its words' conditional log-probabilities.

The vocabulary is counted by Spark over all texts; it grows with the corpus and stays a
table.  The network is trained in numpy in the tasks, on every document once, in ROUNDS
rounds: the documents of a round are dealt to as many tasks as their number asks for, each takes
AdaGrad steps from the same start, and the networks are averaged, weighed by words; so the
training data grow with the corpus, while a network has a fixed size.

Defined results: a null text or one without words has log_prob 0 and no mean; repeated
rows are scored each, and each trains; words that are equally frequent at the border of the vocabulary
go by their hashes; only id and text are read, so columns that clash are left alone; an empty
table gives an empty result.  Texts are whole: long ones are taken in steps of STEP words
that see their neighbours across the step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordline.llm import text as tx
from fjordline.llm.spark import Table, attach, small_batches

SIDE = 64  # classes, and words in a class
VOCABULARY = SIDE * SIDE
OWN = VOCABULARY // 2  # numbers 1 .. OWN - 1 are frequent words; 0 is outside the text
DIM = 16
REACH = 2
DOCS_PER_TASK = 4_000
ROUNDS = 2
STEP = 1 << 15
RATE, BATCH, FLOOR = 0.1, 8192, 1e-6
_SHAPES = {"E": (VOCABULARY, DIM), "P": (2 * REACH, DIM), "b": (DIM,), "C": (DIM, SIDE), "c": (SIDE,), "W": (SIDE, DIM, SIDE), "w": (SIDE, SIDE)}
_BLOCK = 2_048


class Network:
    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        """The softmaxes' weights and biases lie in one array each, the biases last, so that they are applied and moved together."""
        self.outer = np.concatenate([parts["C"], parts["c"][None]])
        self.inner = np.concatenate([parts["W"], parts["w"][:, None]], 1)
        views = {"C": self.outer[:-1], "c": self.outer[-1], "W": self.inner[:, :-1], "w": self.inner[:, -1]}
        self.parts = {k: views.get(k, v) for k, v in parts.items()}

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 5) -> Network:
        """Random inputs; the softmaxes begin at the words' frequencies."""
        rng = np.random.default_rng(seed)
        parts = {k: (rng.normal(0, 0.1, s) if k in "ECW" else np.ones(s) if k == "P" else np.zeros(s)).astype(np.float32) for k, s in _SHAPES.items()}
        share = (counts + 0.5).reshape(SIDE, SIDE)
        parts["c"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
        parts["w"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
        return cls(parts)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.parts[k].ravel() for k in _SHAPES])

    @classmethod
    def unflat(cls, flat: np.ndarray) -> Network:
        parts, at = {}, 0
        for k, s in _SHAPES.items():
            n = int(np.prod(s))
            parts[k], at = flat[at : at + n].reshape(s).astype(np.float32), at + n
        return cls(parts)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """The hidden layer and a column of ones; context: the numbers of each place, by row."""
        p = self.parts
        out = np.ones((context.shape[1], DIM + 1), np.float32)
        total = (p["E"] * p["P"][0] + p["b"]).take(context[0], axis=0)
        for k in range(1, 2 * REACH):
            total += (p["E"] * p["P"][k]).take(context[k], axis=0)
        np.tanh(total, out=out[:, :DIM])
        return out

    def log_prob(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """ln p of each word given its context, classes in turn."""
        order, at = _by_class(word)
        inner = (word % SIDE)[order]
        h = self.hidden(_places(context, order))
        got = np.empty(len(word), np.float32)
        logits = h @ self.outer
        own = logits[np.arange(len(word)), (word // SIDE)[order]]
        np.subtract(own, _lse(logits), out=got)
        for g in np.flatnonzero(np.diff(at)):
            part = slice(at[g], at[g + 1])
            logits = h[part] @ self.inner[g]
            own = logits[np.arange(len(logits)), inner[part]]
            got[part] += own - _lse(logits)
        out = np.empty_like(got)
        out[order] = got
        return out

    def train(self, context: np.ndarray, word: np.ndarray, rate: float = RATE, batch: int = BATCH, floor: float = FLOOR, seen: dict[str, np.ndarray] | None = None) -> None:
        """One pass of AdaGrad in order; seen: the squares so far, for passes that go on."""
        p = self.parts
        if seen is None:
            seen = self.squares(floor)

        def move(k, values, grad, at=slice(None)):
            squares = seen[k][at] + grad * grad
            seen[k][at] = squares
            values[at] -= rate * grad / np.sqrt(squares)

        for lo in range(0, len(word), batch):
            # Within a batch words are taken class by class.
            order, at = _by_class(word[lo : lo + batch])
            target, ctx = word[lo : lo + batch][order], _places(context[lo : lo + batch], order)
            n = len(target)
            inner, every = target % SIDE, np.arange(n)
            h = self.hidden(ctx)
            d = _softmax(h @ self.outer)
            d[every, target // SIDE] -= 1
            dh = d @ p["C"].T
            move("outer", self.outer, h.T @ d / n)
            for g in np.flatnonzero(np.diff(at)):
                own = slice(at[g], at[g + 1])
                mine = h[own]
                d = _softmax(mine @ self.inner[g])
                d[every[: len(mine)], inner[own]] -= 1
                dh[own] += d @ p["W"][g].T
                move("inner", self.inner, mine.T @ d / n, g)
            dz = dh * (1 - h[:, :DIM] * h[:, :DIM])
            move("b", p["b"], dz.mean(0))
            # What each number of a place gets, summed before it is weighed.
            grads, gate, touched = np.zeros_like(p["E"]), np.empty_like(p["P"]), np.zeros(VOCABULARY, bool)
            for k in range(2 * REACH):
                by = np.argsort(ctx[k].astype(np.int16), kind="stable")
                ranked = ctx[k][by]
                head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                rows = ranked[head]
                sums = np.add.reduceat(dz.take(by, axis=0), head, axis=0)
                sums /= n
                gate[k] = (sums * p["E"][rows]).sum(0)
                grads[rows] += sums * p["P"][k]
                touched[rows] = True
            rows = np.flatnonzero(touched)
            move("E", p["E"], grads[rows], rows)
            move("P", p["P"], gate)

    def squares(self, floor: float = FLOOR) -> dict[str, np.ndarray]:
        arrays = {"outer": self.outer, "inner": self.inner, **{k: self.parts[k] for k in "EPb"}}
        return {k: np.full(v.shape, floor, np.float32) for k, v in arrays.items()}


def _places(context: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The contexts in this order, a row per place."""
    return context.take(order, axis=0).T.astype(np.intp, order="C")


def _by_class(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that takes words class by class, and where each class begins."""
    group = (word // SIDE).astype(np.int8)  # SIDE is below 128; small integers are sorted by radix
    order = np.argsort(group, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(group, minlength=SIDE))])


#: exp of logits between -SAFE and SAFE, and sums of them, neither overflow nor vanish in single precision.
SAFE = 80.0
_ONES = np.ones(SIDE, np.float32)


def _tops(x: np.ndarray) -> np.ndarray | None:
    """Each row's maximum, which must be taken off before exp; None where all are safe."""
    return None if x.max(initial=0) < SAFE and x.min(initial=0) > -SAFE else x.max(1)


def _lse(x: np.ndarray) -> np.ndarray:
    """ln of the sum of exp(x) by row; x is overwritten."""
    top = _tops(x)
    if top is not None:
        x -= top[:, None]
    total = np.log(np.exp(x, out=x) @ _ONES)
    return total if top is None else top + total


def _softmax(x: np.ndarray) -> np.ndarray:
    """By row, in place."""
    top = _tops(x)
    if top is not None:
        x -= top[:, None]
    np.exp(x, out=x)
    x *= (1 / (x @ _ONES))[:, None]
    return x


def contexts(number: np.ndarray, first: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The REACH numbers before and after each word, 0 outside its text."""
    padded = np.zeros(len(number) + REACH * len(first), np.int32)
    at = np.arange(len(number)) + REACH * (row + 1)
    padded[at] = number
    return np.stack([padded[at + k] for k in range(-REACH, REACH + 1) if k], 1)


class Vocabulary:
    def __init__(self, hashes: np.ndarray, shares: str | None = None, totals: np.ndarray | None = None) -> None:
        """hashes: of the frequent words, most frequent first; shares: path of the table (h, n) of all others; totals: their counts by number from OWN on."""
        self.shares, self.totals = shares, totals
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = OWN + (hashes % np.uint64(VOCABULARY - OWN)).astype(np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            known = self.sorted[at] == hashes
            out[known] = self.order[at[known]] + 1
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge():
        h = np.concatenate([a for a, _ in held])
        values, at = np.unique(h, return_inverse=True)
        return values, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(values)).astype(np.int64)

    def out(values, n):
        for k in range(0, len(values), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(values[k : k + 100_000].view(np.int64)), pa.array(n[k : k + 100_000])], names=["h", "n"])

    for batch in batches:
        for chunk in tx.chunks(batch.column(0)):
            held.append(np.unique(tx.words(chunk).hash, return_counts=True))
            if len(held) >= 16:
                held = [merge()]
                if len(held[0][0]) > 2_000_000:
                    yield from out(*held.pop())
    if held:
        yield from out(*merge())


def _bucket(h: str) -> Column:
    """The shared number of a hash, from 0: the remainder by a power of two, whatever the sign."""
    return F.col(h).bitwiseAND(F.lit(VOCABULARY - OWN - 1)).cast("int")


def vocabulary(docs: DataFrame, text_col: str = "text") -> tuple[Vocabulary, np.ndarray]:
    """The OWN - 1 most frequent words of all texts, and how often each number occurs."""
    counts = Table(docs.select(text_col).mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))).df
    top = counts.orderBy(F.desc("n"), "h").limit(OWN - 1)
    rows = top.collect()
    known = docs.sparkSession.createDataFrame([(r["h"],) for r in rows], "h long")  # OWN - 1 rows at most
    others = Table(counts.join(F.broadcast(known), "h", "left_anti"))
    totals = np.zeros(VOCABULARY - OWN)
    for r in others.df.groupBy(_bucket("h").alias("b")).agg(F.sum("n").alias("n")).collect():
        totals[r["b"]] = r["n"]
    voc = Vocabulary(np.array([r["h"] for r in rows], np.int64).view(np.uint64), others.path, totals)
    total = np.zeros(VOCABULARY)
    total[1 : len(rows) + 1] = [r["n"] for r in rows]
    # What the others share is spread evenly: the start needs no more.
    everything = counts.agg(F.sum("n")).first()[0] or 0
    total[OWN:] = max(everything - total.sum(), 0) / (VOCABULARY - OWN)
    return voc, total


def _encode(shared):
    """Texts as numbers, two bytes a word, with the words that share numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc: Vocabulary = shared.value
        for batch in batches:
            for chunk in tx.chunks(batch.column(1)):
                w = tx.words(chunk)
                number = voc.numbers(w.hash)
                small = number.astype(np.int16)
                out = [small[a:b].tobytes() for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, chunk.hi - chunk.lo), pa.array(out, pa.binary()), _others(w, number, voc.shares is not None)], names=["id", "numbers", "others"])

    return run


def encode(docs: DataFrame, voc: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> Table:
    """row, id, numbers, others (h, times) of each row of docs, written: training and scoring read it."""
    shared = docs.sparkSession.sparkContext.broadcast(voc)
    kinds = f"id {docs.schema[id_col].dataType.simpleString()}, numbers binary, others array<struct<h: long, times: long>>"
    rows = Table(docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(_encode(shared), kinds).withColumn("row", F.monotonically_increasing_id()))
    shared.destroy()
    return rows


def _train(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, words, part = Network.unflat(shared.value.copy()), 0, 0
        seen = net.squares()
        held, size = [], 0

        def learn():
            number = np.concatenate(held).astype(np.int32)
            first = np.concatenate([[0], np.cumsum([len(t) for t in held])])
            ctx = contexts(number, first, np.repeat(np.arange(len(held)), np.diff(first)))
            net.train(ctx, number, seen=seen)

        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows else part
            for b in batch.column(1):
                held.append(np.frombuffer(b.as_buffer(), np.int16))
                size += len(held[-1])
                if size >= 8 * BATCH:
                    learn()
                    words, held, size = words + size, [], 0
        if size:
            learn()
            words += size
        if words:
            flat = net.flat()
            blocks = range(0, len(flat), _BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([k // _BLOCK for k in blocks], pa.int32()), pa.array([part % 256] * len(blocks), pa.int64()), pa.array([float(words)] * len(blocks)), pa.array([flat[k : k + _BLOCK].tobytes() for k in blocks], pa.binary())], names=["block", "part", "weight", "values"])

    return run


def _average(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table.column("part").to_pylist(), table.column("weight").to_pylist(), table.column("values").to_pylist(), strict=True))
    weight = sum(r[1] for r in rows)
    mean = sum(np.frombuffer(r[2], np.float32).astype(float) * (r[1] / weight) for r in rows).astype(np.float32)
    return pa.table({"block": table.column("block")[:1], "part": pa.array([0], pa.int64()), "weight": pa.array([weight]), "values": pa.array([mean.tobytes()], pa.binary())})


def learn(rows: DataFrame, counts: np.ndarray, docs_per_task: int = DOCS_PER_TASK, rounds: int = ROUNDS) -> Network:
    """The network trained on encoded rows: each in one of the rounds, those of a round in as many tasks as their number asks for."""
    sc = rows.sparkSession.sparkContext
    keyed = rows.select(F.xxhash64(F.lit(1), "id", "numbers").alias("k"), "numbers")
    turn = F.pmod(F.shiftright("k", 8), F.lit(rounds))
    sizes = dict(keyed.groupBy(turn.alias("turn")).count().collect())
    net = Network.start(counts)
    schema = "block int, part long, weight double, values binary"
    for k in range(rounds):
        tasks = -(-sizes.get(k, 0) // docs_per_task)
        if not tasks:
            continue
        # Sorted, so that a lost task repeats itself.
        dealt = keyed.where(turn == k).repartition(tasks, "k").sortWithinPartitions("k", "numbers")
        start = sc.broadcast(net.flat())
        parts = dealt.mapInArrow(_train(start), schema)
        mean = parts.groupBy("block", "part").applyInArrow(_average, schema).groupBy("block").applyInArrow(_average, schema)
        found = sorted(mean.collect(), key=lambda r: r["block"])  # one network: 136,000 numbers
        if found:
            net = Network.unflat(np.concatenate([np.frombuffer(r["values"], np.float32) for r in found]))
        start.destroy()
    return net


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[Vocabulary, Network]:
    """Vocabulary and network of all texts."""
    small_batches(docs.sparkSession)
    voc, counts = vocabulary(docs, text_col)
    rows = encode(docs, voc, id_col, text_col)
    net = learn(rows.df, counts, **options)
    rows.drop()
    return voc, net


def summed(number: np.ndarray, first: np.ndarray, net: Network) -> np.ndarray:
    """The summed log-probability of each text, the numbers of all being end to end."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ctx = contexts(number, first, row)
    lp = np.concatenate([np.zeros(0, np.float32), *(net.log_prob(ctx[a : a + STEP], number[a : a + STEP]) for a in range(0, len(number), STEP))])
    return np.bincount(row, weights=lp.astype(float), minlength=len(first) - 1).astype(float)


def measure(chunk: tx.Chunk, voc: Vocabulary, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log-probability of each row."""
    w = tx.words(chunk)
    return np.diff(w.first), summed(voc.numbers(w.hash), w.first, net)


def _others(w: tx.Words, number: np.ndarray, tell: bool) -> pa.Array:
    """Each row's words that share numbers: (h, times); none if nobody asks."""
    at = np.flatnonzero(number >= OWN) if tell else np.zeros(0, np.int64)
    order = at[np.lexsort((w.hash[at], w.row[at]))]
    row, hashes = w.row[order], w.hash[order]
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])])) if len(order) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(order)))
    ends = np.searchsorted(row[head], np.arange(len(w.first)))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(hashes[head].view(np.int64)), pa.array(times.astype(np.int64))], names=["h", "times"]))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.unflat(shared.value)
        for batch in batches:
            texts = [np.frombuffer(v.as_buffer(), np.int16) for v in batch.column(2)]
            size = np.array([len(t) for t in texts], np.int64)
            total = np.zeros(len(texts))
            ends, lo = np.cumsum(size), 0
            while lo < len(texts):  # texts of about a step together
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + STEP, "right")))
                first = np.concatenate([[0], np.cumsum(size[lo:hi])])
                total[lo:hi] = summed(np.concatenate(texts[lo:hi]).astype(np.int32), first, net)
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(total)], names=["row", "id", "n_words", "log_prob"])

    return run


def _split(scored: DataFrame, rows: DataFrame, voc: Vocabulary) -> DataFrame:
    """scored with the words' shares of their numbers: n of a number's total + 1, the one being what wasn't counted."""
    spark = scored.sparkSession
    totals = spark.createDataFrame([(k, float(n)) for k, n in enumerate(voc.totals)], "b int, total double")  # one row per shared number
    words = rows.select("row", F.explode("others").alias("o")).select("row", "o.h", "o.times")
    counted = attach(words, spark.read.schema("h long, n long").parquet(voc.shares), "h", "left").withColumn("b", _bucket("h")).join(F.broadcast(totals), "b")
    share = F.col("times") * (F.log(F.coalesce("n", F.lit(1))) - F.log(F.col("total") + 1))
    sums = counted.groupBy("row").agg(F.sum(share).alias("share"))
    return scored.join(sums, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("share", F.lit(0.0)))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[Vocabulary, Network] | None = None, **options) -> DataFrame:
    """Per row of docs: the id, n_words, log_prob (summed over its words), mean_log_prob, pseudo_perplexity.  Without a model, one is fitted on docs."""
    small_batches(docs.sparkSession)
    voc, counts = (model[0], None) if model else vocabulary(docs, text_col)
    rows = encode(docs, voc, id_col, text_col).df
    net = model[1] if model else learn(rows, counts, **options)
    shared = docs.sparkSession.sparkContext.broadcast(net.flat())
    scored = rows.select("row", "id", "numbers").mapInArrow(_score(shared), f"row long, id {docs.schema[id_col].dataType.simpleString()}, n_words long, log_prob double")
    if voc.shares is not None:
        scored = _split(scored, rows, voc)
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return scored.select(F.col("id").alias(id_col), "n_words", "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("pseudo_perplexity"))
