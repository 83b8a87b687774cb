"""Toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learnt: words and stems (open-ended prefixes) that stand in toxic
texts far more often than in clean ones, counted by Spark over a bounded sample of
labelled rows.  Its trie is intersected with the Levenshtein automaton of each
word: a state is a set of (trie node, edits so far), made deterministic as it is
used, so that most words are turned down after a few characters, and misspelt terms
are found (one edit from FUZZY characters on, two from twice as many; stems must
stand exactly).

Every hit is weighed by its context of WINDOW words to either side: hits near others
count more (abuse), hits inside quotation marks less (quotation).  A logistic model
over the terms' weighed hits and their totals, fitted on the same sample, scores the text.

Held-out rows (crc32 of the id as text, mod 5, is 0) teach nothing; labels, language,
source and id are no inputs.

Defined results: a null text is an empty one and gets the score of texts without
hits; labels that are null or of unknown documents are left out; of repeated labels
the largest counts; without labels of either kind every score is the share of toxic
ones (0 without any); a word as near to several terms matches each; repeated rows are scored each, and one row of an
id teaches; a very long text is scored whole; columns that clash are left alone; empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordline.llm import text as tx
from fjordline.llm.spark import held_out, small_batches

SAMPLE = 6_000  # rows of each label, at most
TERMS = 2_000  # of the lexicon, at most
STEMS = (3, 4, 5, 6)
FUZZY = 5
WINDOW = 6
LONGEST = 40  # longer words are no terms
_QUOTES = np.isin(np.arange(256), list(b"\"'`"))


def plain_marks(chunk: tx.Chunk) -> tx.Chunk:
    """The chunk with curly and angle quotation marks as ASCII ones and spaces, byte for byte, and apostrophes (marks
    between letters) as spaces, so that words end at marks and the marks left over quote."""
    raw = np.concatenate([chunk.raw, np.zeros(3, np.uint8)])
    for at in np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x80) & (raw[2:] >= 0x98) & (raw[2:] <= 0x9F)).tolist():
        raw[at : at + 3] = (34 if raw[at + 2] >= 0x9C else 39, 32, 32)
    for at in np.flatnonzero((raw[:-1] == 0xC2) & ((raw[1:] == 0xAB) | (raw[1:] == 0xBB))).tolist():
        raw[at : at + 2] = (34, 32)
    mark = np.flatnonzero(raw == 39)
    letter = tx.ALNUM[tx.LOWER]
    wide = np.where((raw[np.minimum(mark + 1, len(raw) - 1)] == 32) & (chunk.raw[mark] != 39), 3, 1)
    ends = chunk.at[np.minimum(np.searchsorted(chunk.at, mark, "right"), len(chunk.at) - 1)]
    inner = (mark > 0) & (mark + wide < ends) & letter[raw[mark - 1]] & letter[raw[np.minimum(mark + wide, len(raw) - 1)]]
    raw[mark[inner]] = 32
    return chunk._replace(raw=raw[:-3])


class Lexicon:
    """The trie of the terms and its product with Levenshtein automata.  A term that ends in * is a stem."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        self.budget = [0]  # the most edits any word below allows
        for number, term in enumerate(terms):
            body, stem = term.rstrip("*"), term.endswith("*")
            edits = 0 if stem else self.edits(len(body))
            at = 0
            self.budget[0] = max(self.budget[0], edits)
            for c in body:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.budget.append(0)
                at = self.child[at][c]
                self.budget[at] = max(self.budget[at], edits)
            (self.stem_at if stem else self.word_at)[at] = number
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.arcs: list[dict[str, int]] = []
        self.stems: list[tuple] = []
        self.ends: list[tuple] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._close({0: 0}))

    @staticmethod
    def edits(length: int) -> int:
        return min(2, length // FUZZY) if length >= FUZZY else 0

    def _close(self, least: dict[int, int]) -> frozenset:
        """Adds what skipping characters of the terms reaches; least: node -> fewest edits."""
        todo = list(least)
        while todo:
            node = todo.pop()
            for to in self.child[node].values():
                e = least[node] + 1
                if e <= self.budget[to] and e < least.get(to, 99):
                    least[to] = e
                    todo.append(to)
        return frozenset(least.items())

    def _state(self, members: frozenset) -> int:
        if members not in self.states:
            self.states[members] = len(self.members)
            self.members.append(members)
            self.arcs.append({})
            self.stems.append(tuple(self.stem_at[n] for n, e in members if e == 0 and n in self.stem_at))
            self.ends.append(tuple((self.word_at[n], e) for n, e in members if n in self.word_at and e <= self.edits(len(self.terms[self.word_at[n]]))))
        return self.states[members]

    def _step(self, state: int, c: str) -> int:
        least: dict[int, int] = {}
        for node, e in self.members[state]:
            moves = [(to, e if label == c else e + 1) for label, to in self.child[node].items()]
            moves.append((node, e + 1))
            for to, cost in moves:
                if cost <= self.budget[to] and cost < least.get(to, 99) or cost == 0:
                    least[to] = min(cost, least.get(to, 99))
        to = self.arcs[state][c] = self._state(self._close(least))
        return to

    def find(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, edits) of what the word matches: its nearest whole terms and its longest stem."""
        state, stem = self.start, ()
        for c in word:
            to = self.arcs[state].get(c)
            state = self._step(state, c) if to is None else to
            if not state:
                break
            stem = self.stems[state] or stem
        ends = self.ends[state]
        if ends:
            near = min(e for _, e in ends)
            ends = tuple(sorted(x for x in ends if x[1] == near))
        return ends + tuple((s, 0) for s in stem)


def _texts_terms(words: set[str]) -> set[str]:
    found = {w for w in words if len(w) <= LONGEST}
    return found | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): texts that hold it, one row for a term and a batch."""
    for batch in batches:
        y = batch.column(1).to_numpy()
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for chunk in map(plain_marks, tx.chunks(batch.column(0))):
            w = tx.words(chunk)
            folded = tx.LOWER[chunk.raw].tobytes()
            for r in range(chunk.hi - chunk.lo):
                a, b = w.first[r], w.first[r + 1]
                own = np.unique(w.hash[a:b], return_index=True)[1] + a
                terms = _texts_terms({folded[w.start[k] : w.end[k]].decode("utf-8", "replace") for k in own.tolist()})
                (toxic if y[chunk.lo + r] > 0.5 else clean).update(terms)
        keys = list(toxic.keys() | clean.keys())
        for k in range(0, len(keys), 50_000):
            part = keys[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[t] for t in part], pa.int64()), pa.array([clean[t] for t in part], pa.int64())], names=["term", "toxic", "clean"])


def prune(rows: list[tuple[str, int, int]]) -> list[str]:
    """Terms worth keeping: no stem that one word explains, no stem or word that a stem at least as clean covers."""
    seen = {t: (a, b) for t, a, b in rows}
    best: dict[str, int] = {}
    for t, a, _ in rows:
        if not t.endswith("*"):
            for n in STEMS:
                best[t[:n] + "*"] = max(best.get(t[:n] + "*", 0), a)
    stems = {t for t, a, _ in rows if t.endswith("*") and a > 1.2 * best.get(t, 0) + 2}
    kept = []
    for t, a, b in rows:
        if t.endswith("*") and t not in stems:
            continue
        body = t.rstrip("*")
        covers = [body[:n] + "*" for n in STEMS if n < len(body) + (not t.endswith("*")) and body[:n] + "*" in stems and body[:n] + "*" != t]
        if any((b + 0.5) / (a + 1) >= 0.8 * (seen[c][1] + 0.5) / (seen[c][0] + 1) for c in covers):
            continue
        kept.append(t)
    return kept


class Hits:
    """Finds terms in chunks of texts; remembers words it has seen, up to `most`."""

    def __init__(self, terms: list[str], most: int = 100_000) -> None:
        self.lexicon, self.memo, self.most = Lexicon(terms), {}, most

    def scan(self, chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each hit: row, word in the text, term, edits, quoted, strength."""
        chunk = plain_marks(chunk)
        w = tx.words(chunk)
        folded = tx.LOWER[chunk.raw]
        distinct, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.memo) > self.most:
            self.memo.clear()
            if len(self.lexicon.states) > self.most:
                self.lexicon = Lexicon(self.lexicon.terms)
        raw = folded.tobytes()
        found = np.zeros(len(distinct), bool)
        matches = {}
        for k, (h, at) in enumerate(zip(distinct.tolist(), first.tolist(), strict=True)):
            got = self.memo.get(h)
            if got is None:
                a, b = w.start[at], w.end[at]
                got = self.memo[h] = self.lexicon.find(raw[a : min(b, a + 4 * (LONGEST + 3))].decode("utf-8", "replace"))
            if got:
                found[k] = True
                matches[k] = got
        words = np.flatnonzero(found[which]) if len(which) else np.zeros(0, np.int64)
        out = [(int(w.row[i]), int(i), t, e) for i in words.tolist() for t, e in matches[int(which[i])]]
        row, word, term, edits = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
        # Other hit words within the window; texts are set apart so that it ends with its text.
        apart = 2 * WINDOW * w.row
        place, own = words + apart[words], word + apart[word]
        near = np.searchsorted(place, own + WINDOW, "right") - np.searchsorted(place, own - WINDOW) - 1
        # Quoted: an odd number of marks before it in its text, and one within the window on both sides.
        marks = np.concatenate([[0], np.cumsum(_QUOTES[chunk.raw])])
        lo = np.maximum(word - WINDOW, w.first[row]) if len(word) else word
        hi = np.minimum(word + WINDOW, w.first[row + 1] - 1) if len(word) else word
        opened = (marks[w.start[word]] - marks[chunk.at[row]]) % 2 == 1
        since = np.where(lo > w.first[row], w.end[np.maximum(lo - 1, 0)], chunk.at[row])
        until = np.where(hi + 1 < w.first[row + 1], w.start[np.minimum(hi + 1, max(len(w.start) - 1, 0))], chunk.at[row + 1])
        quoted = opened & (marks[w.start[word]] > marks[since]) & (marks[until] > marks[w.end[word]])
        strength = np.clip(1 + 0.25 * np.minimum(near, 4) - 0.75 * quoted, 0.1, 2.0) * np.array([1.0, 0.7, 0.5])[np.minimum(edits, 2)]
        return row, word - (w.first[row] if len(row) else 0), term, edits, quoted, strength

    def features(self, chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows (row, input, value), and the texts' number of hits.  Inputs: the terms, then totals."""
        row, _, term, edits, quoted, strength = self.scan(chunk)
        rows, n = chunk.hi - chunk.lo, len(self.lexicon.terms)
        pair, at = np.unique(row * (n + 1) + term, return_inverse=True)
        value = np.log1p(np.bincount(at, weights=strength, minlength=len(pair))) if len(pair) else np.zeros(0)
        hits = np.bincount(row, minlength=rows)
        total = np.bincount(row, weights=strength, minlength=rows)
        size = np.log1p(np.diff(chunk.at) / 6)
        some = np.flatnonzero(hits)
        extra = [(some, 0, np.ones(len(some))), (some, 1, np.log1p(total[some])), (some, 2, np.log1p(total[some]) / np.maximum(size[some], 1)), (some, 3, np.bincount(row, weights=quoted, minlength=rows)[some] / hits[some]), (some, 4, np.bincount(row, weights=edits == 0, minlength=rows)[some] > 0)]
        return np.concatenate([pair // (n + 1), *(e[0] for e in extra)]), np.concatenate([pair % (n + 1), *(np.full(len(e[0]), n + e[1]) for e in extra)]), np.concatenate([value, *(np.asarray(e[2], float) for e in extra)]), hits


TOTALS = 5


class Model:
    def __init__(self, terms: list[str], weights: np.ndarray, bias: float) -> None:
        self.terms, self.weights, self.bias = terms, weights, bias

    def score(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(row, weights=self.weights[column] * value, minlength=rows), -30, 30)))


def logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, inputs: int, ridge: float = 0.5, steps: int = 300) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Adam steps on the whole sample."""
    weights, bias = np.zeros(inputs), float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))
    first, second, b1, b2 = np.zeros(inputs + 1), np.zeros(inputs + 1), 0.9, 0.99
    for step in range(1, steps + 1):
        err = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weights=weights[column] * value, minlength=len(y)), -30, 30))) - y
        grad = np.append(np.bincount(column, weights=err[row] * value, minlength=inputs) + ridge * weights, err.sum())
        first = b1 * first + (1 - b1) * grad
        second = b2 * second + (1 - b2) * grad * grad
        move = 0.05 * (first / (1 - b1**step)) / (np.sqrt(second / (1 - b2**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, bias


def _features(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(terms)
        for batch in batches:
            y = batch.column(1).to_numpy()
            for chunk in tx.chunks(batch.column(0)):
                row, column, value, _ = hits.features(chunk)
                by = np.argsort(row, kind="stable")
                at = pa.array(np.searchsorted(row[by], np.arange(chunk.hi - chunk.lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(y[chunk.lo : chunk.hi]), pa.ListArray.from_arrays(at, pa.array(column[by].astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value[by]))], names=["y", "i", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, terms: int = TERMS) -> Model:
    """What the driver gathers is bounded by 2 x `sample` rows and `terms` terms."""
    small_batches(docs.sparkSession)
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.groupBy(F.col(id_col).alias("_fj_id")).agg(F.max(label_col).cast("double").alias("_fj_y"))
    by_hash = (F.xxhash64("_fj_id"), F.col("_fj_id"))
    picked = usable.where("_fj_y > 0.5").orderBy(*by_hash).limit(sample).unionAll(usable.where("_fj_y <= 0.5").orderBy(*by_hash).limit(sample))
    sizes = dict(usable.groupBy((F.col("_fj_y") > 0.5).alias("t")).count().collect())
    n_toxic, n_clean = (min(sizes.get(k, 0), sample) for k in (True, False))
    if not n_toxic or not n_clean:
        return Model([], np.zeros(TOTALS), 30.0 if n_toxic else -30.0)
    # At most 2 x sample ids: safe to broadcast.  Of rows of one id one teaches, the first by a hash; equal texts count once.
    rows = docs.select(F.col(id_col).alias("_fj_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_fj_id")
    rows = rows.groupBy("_fj_id").agg(F.min_by(F.struct("text", "_fj_y"), F.xxhash64("text")).alias("r")).select("r.text", "r._fj_y").groupBy("text").agg(F.max("_fj_y").alias("_fj_y"))
    counted = rows.mapInArrow(_count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = ((F.col("toxic") + 0.1) / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    strong = counted.where((F.col("toxic") >= max(3, n_toxic // 200)) & (odds >= 6)).orderBy(F.desc(F.col("toxic") * F.log(odds)), "term").limit(terms)
    lexicon = prune([(r["term"], r["toxic"], r["clean"]) for r in strong.collect()])
    table = rows.mapInArrow(_features(lexicon), "y double, i array<int>, x array<double>").toArrow()
    y = table.column("y").to_numpy()
    if not len(y):
        return Model([], np.zeros(TOTALS), -30.0)
    size = np.array([len(v) for v in table.column("i").to_pylist()], np.int64)
    column = np.array(table.column("i").combine_chunks().flatten(), np.int64) if table.num_rows else np.zeros(0, np.int64)
    value = np.array(table.column("x").combine_chunks().flatten(), float) if table.num_rows else np.zeros(0)
    weights, bias = logistic(np.repeat(np.arange(len(y)), size), column, value, y, len(lexicon) + TOTALS)
    # The sample holds more toxic texts than the corpus: shift to the true share.
    true = sizes.get(True, 0) / sum(sizes.values())
    seen = n_toxic / (n_toxic + n_clean)
    shift = float(np.log(true / (1 - true)) - np.log(seen / (1 - seen))) if 0 < true < 1 else 0.0
    return Model(lexicon, np.round(weights, 6), round(bias + shift, 6))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        hits = Hits(model.terms)
        for batch in batches:
            scores, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
            for chunk in tx.chunks(batch.column(1)):
                row, column, value, n = hits.features(chunk)
                scores.append(model.score(row, column, value, chunk.hi - chunk.lo))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores)), pa.array(np.concatenate(counts))], names=["id", "score", "n_hits"])

    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: the id, held_out, score (0 to 1), predicted (1 from `threshold` on), n_hits."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, sample))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_score(shared), f"id {docs.schema[id_col].dataType.simpleString()}, score double, n_hits long")
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def _drop(shared, text_col: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        hits = Hits(model.terms)
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for chunk in tx.chunks(batch.column(text_col)):
                row, column, value, _ = hits.features(chunk)
                keep.append(model.score(row, column, value, chunk.hi - chunk.lo) < threshold)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return run


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows scored at or above `threshold`; columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, sample))
    return docs.mapInArrow(_drop(shared, text_col, threshold), docs.schema)
