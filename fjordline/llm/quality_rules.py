"""Quality rules with an n-gram perplexity band.

Spark counts the n-grams of code points of all texts, by language.  A code point of 16 bits
is a symbol (A-Z and a-z the same one, so any script keeps its letters; those
beyond share the 2,048 numbers that UTF-16 leaves free), an n-gram a code of 16 bits a symbol, which
is its own perfect hash.  From the counts a modified Kneser-Ney model of each language is made (Chen and
Goodman, 1999), a table of codes with their log-probabilities, of order ORDER whatever the input's size.  Up to
MODEL_GRAMS n-grams the table is sent to every task as sorted arrays; beyond, the texts are dealt to parts of
PART_BYTES, and each part is joined with the n-grams it holds.  Both ways give the same sums.  Each text
gets its perplexity under the model of its language; in each
language, texts beyond an upper or lower bound are rejected.
Middle and spread are those of the shorter half (the shortest interval that holds half
of the language's texts), which a third of bad texts on one side can't open.

Words, rather than code points, as symbols would not keep to a disk of 1.5 times the input: 27 million words hold
12 million different pairs.

Defined results: a null text is an empty one; a text of fewer code points than the order has
no perplexity and is left to the base rules; a null language is a language of its
own; a language whose texts don't differ has a band of MIN_WIDTH around them; texts on a bound are in the band;
repeated rows are scored and counted each; a very long text is taken whole; only id, text and language are read, so
columns that clash are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fjordline.llm import text as tx
from fjordline.llm.spark import Table, attach, small_batches

ORDER = 4
#: A table of more n-grams is not sent to every task; texts are then dealt to parts of about PART_BYTES.
MODEL_GRAMS = 2_000_000
PART_BYTES = 16 << 20
#: Width of the band in robust standard deviations of log-perplexity below and above the middle, and its least half-width.
LOWER_WIDTH, UPPER_WIDTH, MIN_WIDTH = 3.0, 3.0, 0.15
#: Half of the shorter half of a normal distribution, in standard deviations.
_HALF = 0.6745
BITS = 16
SYMBOLS = 1 << BITS
_SIGNS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CODEPOINT = tx.SOLID & ((np.arange(256) & 0xC0) != 0x80)


def symbols(chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a chunk and each row's span in them."""
    raw = chunk.raw.tobytes()
    place = np.concatenate([[0], np.cumsum((chunk.raw & 0xC0) != 0x80)])
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    at = place[chunk.at]
    if len(points) != place[-1]:  # not UTF-8: bytes stand in for code points
        points, at = chunk.raw.astype(np.uint32), chunk.at
    points = points + np.where((points >= 65) & (points <= 90), 32, 0).astype(np.uint32)
    return np.where(points < SYMBOLS, points, 0xD800 + points % 2048).astype(np.uint64), at


def _codes(chunk: tx.Chunk, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams inside each text, and the row of each."""
    symbol, at = symbols(chunk)
    count = max(0, len(symbol) - order + 1)
    code = np.zeros(count, np.uint64)
    for k in range(order):
        code = (code << np.uint64(BITS)) | symbol[k : k + count]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = row[:count] == row[order - 1 :][:count] if count else np.zeros(0, bool)
    return code[inside], row[:count][inside]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(code)).astype(np.int64)


def _count(order: int, text: str, keys: list[str], most: int = 500_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def tell(key):
            code, n = _merge(held.pop(key))
            for k in range(0, len(code), 100_000):
                part = slice(k, k + 100_000)
                same = [pa.array([v] * len(code[part]), t) for v, t in zip(key, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(code[part].view(np.int64)), pa.array(n[part])], names=[*keys, "code", "n"])

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            of = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            for chunk in tx.chunks(batch.column(text)):
                code, row = _codes(chunk, order)
                names = sorted(set(of[chunk.lo : chunk.hi]))
                place = {name: k for k, name in enumerate(names)}
                own = np.array([place[name] for name in of[chunk.lo : chunk.hi]])
                for k, name in enumerate(names):
                    parts = held.setdefault(name, [])
                    parts.append(np.unique(code[(own == k)[row]], return_counts=True))
                    if sum(len(c) for c, _ in parts) > most:
                        parts[:] = [_merge(parts)]
                        if len(parts[0][0]) > most // 2:
                            yield from tell(name)
        for name in sorted(held):
            yield from tell(name)

    return run


def _mask(symbols: int) -> np.uint64:
    return np.uint64((1 << BITS * symbols) - 1)


class KneserNey:
    """Interpolated modified Kneser-Ney over n-gram codes; level k of `grams` has the (k + 1)-grams."""

    def __init__(self, code: np.ndarray, count: np.ndarray, order: int = ORDER) -> None:
        self.order = order
        levels = [(code, count)]
        for k in range(order - 1, 0, -1):  # how many different symbols precede each shorter gram
            levels.append(np.unique(levels[-1][0] & _mask(k), return_counts=True))
        levels.reverse()
        self.grams: list[np.ndarray] = []
        self.prob: list[np.ndarray] = []
        self.context: list[np.ndarray] = []
        self.weight: list[np.ndarray] = []
        for k, (grams, n) in enumerate(levels):
            d = self._discounts(n)
            context, inverse = np.unique(grams >> np.uint64(BITS), return_inverse=True)
            total = np.bincount(inverse, weights=n, minlength=len(context))
            cut = d[np.minimum(n, 3)]
            lost = np.bincount(inverse, weights=cut, minlength=len(context)) / np.maximum(total, 1)
            below = np.full(len(grams), 1.0 / SYMBOLS) if k == 0 else self._lookup(k - 1, grams & _mask(k))
            self.grams.append(grams)
            self.prob.append((n - cut) / np.maximum(total, 1)[inverse] + lost[inverse] * below)
            self.context.append(context)
            self.weight.append(lost)

    @staticmethod
    def _discounts(n: np.ndarray) -> np.ndarray:
        """What is taken off counts of 0, 1, 2 and more."""
        n1, n2, n3, n4 = (max(int((n == k).sum()), 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return np.array([0.0, *(min(max(v, 0.05), k - 0.05) for v, k in zip(raw, (1, 2, 3), strict=True))])

    def _lookup(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Probability of each (k + 1)-gram's last symbol, backing off where it wasn't seen."""
        if k < 0:
            return np.full(len(grams), 1.0 / SYMBOLS)
        at = np.minimum(np.searchsorted(self.grams[k], grams), max(len(self.grams[k]) - 1, 0))
        seen = self.grams[k][at] == grams if len(self.grams[k]) else np.zeros(len(grams), bool)
        out = np.empty(len(grams))
        out[seen] = self.prob[k][at[seen]]
        rest = grams[~seen]
        if len(rest):
            context = rest >> np.uint64(BITS)
            c = np.minimum(np.searchsorted(self.context[k], context), max(len(self.context[k]) - 1, 0))
            known = self.context[k][c] == context if len(self.context[k]) else np.zeros(len(rest), bool)
            out[~seen] = np.where(known, self.weight[k][c] if len(self.weight[k]) else 1.0, 1.0) * self._lookup(k - 1, rest & _mask(k))
        return out

    def log_prob(self, grams: np.ndarray) -> np.ndarray:
        return np.log(self._lookup(self.order - 1, grams))


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """(lang, code, n): how often each n-gram occurs in all texts of each language."""
    narrow = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return narrow.mapInArrow(_count(order, "text", ["lang"]), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _by_language(table: pa.Table, value: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Each language of (lang, code, value) with its codes, sorted, and their values."""
    lang = table.column("lang").combine_chunks().dictionary_encode()
    lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
    names, which = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
    code, values = table.column("code").to_numpy().view(np.uint64), table.column(value).to_numpy()
    for k in sorted(range(len(names)), key=names.__getitem__):
        own = np.flatnonzero(which == k)
        by = own[np.argsort(code[own])]
        yield names[k], code[by], values[by]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, grams: int | None = None) -> tuple[int, dict[str, KneserNey]]:
    """The order of the models, and the model of each language, held by the driver; lang_col holds strings, no nulls.

    The order is the one asked for, unless the caller bounds the number of n-grams; judge() doesn't go by this.
    """
    small_batches(docs.sparkSession)
    table = Table(counts(docs, text_col, lang_col, order))
    held = table.df
    while grams is not None and order > 1 and held.count() > grams:
        order -= 1
        held = held.groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("code")).agg(F.sum("n").alias("n"))
    found = held.toArrow()
    table.drop()
    return order, {name: KneserNey(code, n, order) for name, code, n in _by_language(found, "n")}


def log_probs(held: DataFrame, order: int = ORDER) -> Table:
    """(lang, code, log_prob) of the n-grams of held, which is counts() as a written table: KneserNey's values, level by level as joins."""
    suffix = lambda k: F.col("code").bitwiseAND(F.lit((1 << BITS * k) - 1))
    tables, levels = [], [held]
    for k in range(order - 1, 0, -1):  # how many different symbols precede each shorter gram
        tables.append(Table(levels[0].groupBy("lang", suffix(k).alias("code")).agg(F.count("*").alias("n"))))
        levels.insert(0, tables[-1].df)
    every = levels[0].select(F.lit(0).alias("k"), "lang", "n")
    for k, level in enumerate(levels[1:], 1):
        every = every.unionAll(level.select(F.lit(k).alias("k"), "lang", "n"))
    n1, n2, n3, n4 = (F.col(f"n{j}") for j in range(1, 5))
    y = n1 / (n1 + 2 * n2)
    found = every.groupBy("k", "lang").agg(*(F.greatest(F.count_if(F.col("n") == j), F.lit(1)).cast("double").alias(f"n{j}") for j in range(1, 5)))
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    tables.append(Table(found.select("k", "lang", *(F.least(F.greatest(v, F.lit(0.05)), F.lit(j - 0.05)).alias(f"d{j}") for j, v in enumerate(raw, 1)))))
    discounts, below = tables[-1].df, None
    together = Window.partitionBy("lang", "context")
    n = F.col("n")
    for k, level in enumerate(levels):
        rows = attach(level.withColumn("context", F.shiftrightunsigned("code", BITS)), discounts.where(F.col("k") == k).drop("k"), "lang")
        lost = sum((F.col(f"d{j}") * F.sum((n == j if j < 3 else n >= j).cast("long")).over(together) for j in (2, 3)), F.col("d1") * F.sum((n == 1).cast("long")).over(together))
        cut = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.select("lang", "code", ((n - cut) / F.sum("n").over(together)).alias("own"), (lost / F.sum("n").over(together)).alias("lost"))
        if below is None:
            below = rows.select("lang", "code", (F.col("own") + F.col("lost") / SYMBOLS).alias("prob"))
        else:
            shorter = below.select("lang", F.col("code").alias("suffix"), F.col("prob").alias("below"))
            below = rows.withColumn("suffix", suffix(k)).join(shorter, ["lang", "suffix"]).select("lang", "code", (F.col("own") + F.col("lost") * F.col("below")).alias("prob"))
    out = Table(below.select("lang", "code", F.log("prob").alias("log_prob")))
    for table in tables:
        table.drop()
    return out


class Known:
    """A model's log-probabilities of n-grams that it has seen; codes are sorted."""

    def __init__(self, code: np.ndarray, value: np.ndarray) -> None:
        self.code, self.value = code, value

    def log_prob(self, grams: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.code, grams), len(self.code) - 1)
        if (self.code[at] != grams).any():
            raise ValueError("an n-gram that was not counted")
        return self.value[at]


def measure(chunk: tx.Chunk, order: int, models: dict[str, KneserNey] | dict[str, Known], lang: np.ndarray) -> list[np.ndarray]:
    """Per row, whose languages are lang: words, word_chars, n_symbols, n_dup_lines, n_repeat_words, sum of log-probabilities, their number."""
    rows = len(chunk.at) - 1
    per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[chunk.at])
    w = tx.words(chunk, tx.SOLID, tx.ASIS)
    start, end, row, _ = tx.lines(chunk)
    solid = np.concatenate([[0], np.cumsum(tx.SOLID[chunk.raw])])
    real = solid[end] > solid[start]
    line = tx.mix(tx.hash_spans(chunk.raw, start, end)[real] ^ tx.mix(row[real].astype(np.uint64), 3))
    line_row = row[real]
    first = np.zeros(len(line), bool)
    first[np.unique(line, return_index=True)[1]] = True
    dup = np.bincount(line_row[~first], minlength=rows)
    grams = tx.ngrams(w.hash, 3)
    inside = w.row[: len(grams)] == w.row[2:] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    _, which, often = np.unique(tx.mix(grams[at] ^ tx.mix(w.row[at].astype(np.uint64), 4)), return_inverse=True, return_counts=True)
    hot = at[often[which] > 1]
    covered = np.zeros(len(w.hash), bool)
    for k in range(3):
        covered[hot + k] = True
    code, code_row = _codes(chunk, order)
    lp = np.zeros(len(code))
    for name in set(lang.tolist()) & models.keys():
        own = np.flatnonzero((lang == name)[code_row])
        distinct, which = np.unique(code[own], return_inverse=True)
        lp[own] = models[name].log_prob(distinct)[which]
    return [np.diff(w.first), per_row(_CODEPOINT[chunk.raw]), per_row(_SIGNS[chunk.raw]), dup, np.bincount(w.row[covered], minlength=rows), np.bincount(code_row, weights=lp, minlength=rows), np.bincount(code_row, minlength=rows)]


_KINDS = ["long"] * 5 + ["double", "long"]
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_prob", "n_grams"]


def _scored(rows: pa.RecordBatch | pa.Table, order: int, models: dict[str, Known]) -> Iterator[pa.RecordBatch]:
    ids, langs = (c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in (rows.column("id"), rows.column("lang")))
    for chunk in tx.chunks(rows.column("text")):
        own = slice(chunk.lo, chunk.hi)
        got = measure(chunk, order, models, np.array(langs[own].to_pylist(), object))
        yield pa.RecordBatch.from_arrays([ids[own], langs[own], *(pa.array(v, pa.float64() if k == "double" else pa.int64()) for v, k in zip(got, _KINDS, strict=True))], names=["id", "lang", *_NAMES])


def _score(shared, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _scored(batch, order, shared.value)

    return run


def _score_part(order: int):
    def run(texts: pa.Table, grams: pa.Table) -> pa.Table:
        models = {name: Known(code, value) for name, code, value in _by_language(grams, "log_prob")} if grams.num_rows else {}
        return pa.Table.from_batches(_scored(texts, order, models))

    return run


def _deal(narrow: DataFrame, probs: DataFrame, order: int, schema: str) -> DataFrame:
    """narrow scored part by part: each part is joined with the n-grams it holds, so no task needs the whole model."""
    parts = -(-(narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // PART_BYTES)
    dealt = narrow.withColumn("part", F.pmod(F.xxhash64("id", "lang", "text"), F.lit(parts)).cast("int")).repartition(parts, "part")
    # Both readers take all columns of dealt, so that texts are shuffled once.
    grams = dealt.mapInArrow(_count(order, "text", ["part", "lang"]), "part int, lang string, code long, n long").drop("n")
    found = grams.join(probs, ["lang", "code"]).select("part", "lang", "code", "log_prob")
    return dealt.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_score_part(order), schema)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", lower: float = LOWER_WIDTH, upper: float = UPPER_WIDTH, order: int = ORDER, grams: int = MODEL_GRAMS) -> DataFrame:
    """Per row of docs: the id, counts of the base rules, base_failed, perplexity, the band of its language (low, high), in_band, kept."""
    small_batches(docs.sparkSession)
    kinds = ", ".join(f"{n} {k}" for n, k in zip(_NAMES, _KINDS, strict=True))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, lang string, {kinds}"
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    held = Table(counts(narrow, order=order))
    probs = log_probs(held.df, order)
    held.drop()
    if probs.df.count() <= grams:
        shared = docs.sparkSession.sparkContext.broadcast({name: Known(code, value) for name, code, value in _by_language(probs.df.toArrow(), "log_prob")})
        scored = Table(narrow.mapInArrow(_score(shared, order), schema))
        shared.destroy()
    else:
        scored = Table(_deal(narrow, probs.df, order, schema))
    probs.drop()
    level = -F.col("log_prob") / F.col("n_grams")
    rows = scored.df.withColumn("level", F.when(F.col("n_grams") > 0, level))
    grid = rows.groupBy("lang").agg(F.percentile_approx("level", [k / 100 for k in range(101)], 1000).alias("q"))
    at = lambda k: F.element_at("q", k)
    half = F.array_min(F.transform(F.sequence(F.lit(1), F.lit(51)), lambda k: F.struct((at(k + 50) - at(k)).alias("length"), at(k).alias("least"))))
    middle = grid.select("lang", half.alias("half")).select("lang", (F.col("half.least") + F.col("half.length") / 2).alias("mid"), (F.col("half.length") / (2 * _HALF)).alias("spread"))
    wide = lambda width: F.greatest(F.lit(MIN_WIDTH), width * F.col("spread"))
    bands = Table(middle.select("lang", (F.col("mid") - wide(lower)).alias("low"), (F.col("mid") + wide(upper)).alias("high")))
    out = attach(rows, bands.df, "lang", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    in_band = F.coalesce(F.col("level").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select(F.col("id").alias(id_col), *_NAMES[:5], failed.alias("base_failed"), F.exp("level").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"), in_band.alias("in_band"), (in_band & ~failed).alias("kept"))
