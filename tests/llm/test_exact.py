"""Operators with exact results, held against plain Python versions on the small tables and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fjordline.llm import decontam, licenses, line_dedup, mixing, ngram_join, queries, quality_rules, sharding
from fjordline.llm import text as tx
from fjordline.llm.spark import small_batches
from tests.llm import helpers as h


def _docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_words_and_lines_match_regular_expressions():
    texts = [t for _, t, _, _ in h.AWKWARD]
    for size in (64, 1 << 21):
        words = {"alnum": [], "solid": []}
        lines = []
        for chunk in tx.chunks(pa.array(texts), size):
            for name, member, fold in (("alnum", tx.ALNUM, tx.LOWER), ("solid", tx.SOLID, tx.ASIS)):
                w = tx.words(chunk, member, fold)
                folded = fold[chunk.raw].tobytes()
                own = [folded[a:b].decode() for a, b in zip(w.start, w.end, strict=True)]
                words[name] += [own[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                assert len(set(w.hash.tolist())) == len(set(own))
            start, end, _, first = tx.lines(chunk)
            own = [tx.spell(chunk, a, b) for a, b in zip(start, end, strict=True)]
            lines += [own[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        assert words["alnum"] == [h.alnum(t) for t in texts]
        assert words["solid"] == [h.solid(t) for t in texts]
        assert lines == [(t or "").split("\n") for t in texts]


@pytest.mark.parametrize("own", [None, "700", "20000"])
def test_batches_are_held_to_their_bound(spark, own):
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    for key in keys:
        spark.conf.unset(key)
    if own is not None:
        spark.conf.set(keys[0], own)
    small_batches(spark)
    assert int(spark.conf.get(keys[0])) == min(int(own or 1_000), 1_000)
    assert spark.conf.get(keys[1]).rstrip("b") == str(4 << 20)
    spark.conf.unset(keys[0])
    small_batches(spark)


# 1


def test_line_dedup_query(spark, sf_dir):
    want = h.line_counts(_docs(spark, sf_dir))
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near) for r in queries.op1_line_dedup(spark, sf_dir).collect()}
    assert got == want


def test_line_dedup_finds_every_single_edit(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(10, 16))).strip() + "zz" for _ in range(12)]
    rows = []
    for k, line in enumerate(base * 3):
        at = rng.randrange(len(line))
        kind = k // len(base)
        rows.append(line if kind == 0 else line[:at] + ("X" if kind == 1 else "") + line[at + 1 :] if rng.random() < 0.7 else line[:at] + "Y" + line[at:])
    docs = [(k, "\n".join(rows[k : k + 3]), "en", "a") for k in range(0, len(rows), 3)]
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near) for r in line_dedup.summary(h.awkward(spark, docs)).collect()}
    assert got == h.line_counts([d[:2] for d in docs])
    assert sum(v[2] for v in got.values()) > 5


def test_line_dedup_awkward(spark):
    docs = [(1, "the very first line\nshort\nshort\n\n\n", None, "a"), (2, "the very first lime\nshorx\nsolo line here", None, "a"), (3, None, None, "a"), (4, "", None, "a"), (None, "solo line here", None, "a")]
    df = h.awkward(spark, docs)
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near) for r in line_dedup.summary(df).collect()}
    # A null id comes first, so its line is the earliest.
    assert got == {1: (6, 1, 0), 2: (3, 1, 1), 3: (0, 0, 0), 4: (1, 0, 0), None: (1, 0, 0)}
    kept = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert kept == {1: "the very first line\nshort\n\n\n", 2: "shorx", 3: None, 4: "", None: "solo line here"}
    assert line_dedup.dedup(df).columns == df.columns
    assert line_dedup.summary(h.empty(spark)).count() == 0


def test_line_dedup_takes_lines_of_null_ids_as_witnesses(spark):
    rows = [(1, "the very first lime\nother words stand here"), (2, "the very first line"), (None, "words of no other\nthe very first line"), (None, "a line of its own\nsome other words stand here"), (3, "same other words stand here")]
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near) for r in line_dedup.summary(h.awkward(spark, [(*r, None, "a") for r in rows])).where("doc_id is not null").collect()}
    assert got == {1: (2, 0, 1), 2: (1, 1, 0), 3: (1, 0, 1)}


# 2


def test_line_dedup_never_takes_a_line_that_stands_alone(spark):
    """Rows that share an id, or have none, are documents each."""
    rng = random.Random(11)
    name = lambda k: "".join(rng.choice("abcdefghij") for _ in range(14)) + f" {k}"
    own = [name(k) for k in range(60)]
    common = "a line that many documents hold"
    rows = []
    for k in range(20):
        lines = own[3 * k : 3 * k + 3]
        lines.insert(k % 4, common)
        rows.append((None if k % 3 == 0 else 2 if k % 3 == 1 else k, "\n".join(lines), None, "a"))
    rows += rows[:2]
    kept = [r.text for r in line_dedup.dedup(h.awkward(spark, rows)).collect()]
    assert len(kept) == 22
    left = Counter(x for t in kept for x in t.split("\n"))
    assert set(own) <= set(left)
    first = [t for t in kept if common in t]
    assert len(set(first)) == 1, first


def test_halves_lose_no_single_edit():
    rng = random.Random(5)
    for _ in range(300):
        x = [rng.choice("aab") for _ in range(rng.randint(10, 17))]
        y = list(x)
        at = rng.randrange(len(y))
        if rng.random() < 0.5:
            y[at] = "z"
        else:
            y.insert(at, rng.choice("ab"))
        same = 0 if len(x) == len(y) else 1
        m, half = len(x), len(x) // 2
        first, second = x[:half] == y[:half], x[half:] == y[half + same :]
        mine = line_dedup.neighbourhood(line_dedup.points("".join(x).encode()), first + 2 * second)
        theirs = line_dedup.neighbourhood(line_dedup.points("".join(y).encode()), (first + 2 * second) << (2 * same))
        keys = lambda got, role: set(got[0][got[1] == role].tolist())
        assert first or second
        assert keys(mine, 2 * same) & keys(theirs, same), (x, y, m)


def _base(text):
    w = h.alnum(text)
    starts, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_query(spark, sf_dir):
    docs = dict(_docs(spark, sf_dir))
    rows = queries.op2_license_scans(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _base(docs[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_automaton_takes_what_the_markup_says():
    auto = licenses.Automaton((licenses.Template("t", "t", "a [[b [[c]] d]] {{1-2}} e"), licenses.Template("z", "z", "x {{0-1}} y")))
    pattern = {0: re.compile(r"a( b( c)? d)?( \w){1,2} e"), 1: re.compile(r"x( \w)? y")}
    rng = random.Random(1)
    for _ in range(3000):
        w = [rng.choice("abcdexyq") for _ in range(rng.randint(1, 8))]
        numbers = [auto.words.get(x, 0) for x in w]
        want = {}
        for t, p in pattern.items():
            ends = [n for n in range(1, len(w) + 1) if p.fullmatch(" ".join(w[:n]))]
            if ends:
                want[t] = max(ends)
        assert auto.matches(numbers) == want
        if want and len(w) > 1:
            assert auto.pairs[numbers[0], numbers[1]] or auto.alone[numbers[0]]


def test_license_awkward(spark):
    docs = [*h.AWKWARD, (50, "Licensed under CC BY-NC 4.0. cc by cc by; Released under the MIT License", None, None), (51, "all rights", None, None), (52, "reserved all rights reserved", None, None)]
    df = h.awkward(spark, docs)
    got = licenses.digest(licenses.scan(df)).collect()
    assert len(got) == len(docs)
    want = Counter((i, *_base(t)) for i, t, _, _ in docs)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[50].labels == "cc-by,cc-by-nc,mit"
    versions = spark.createDataFrame([(k, f"CC BY {v}.") for k, v in enumerate(("4.0", "3.0", "2.5", "9.0"))], "doc_id long, text string")
    assert [r.labels for r in licenses.digest(licenses.scan(versions)).orderBy("doc_id").collect()] == ["cc-by,cc-by-4.0", "cc-by,cc-by-3.0", "cc-by,cc-by-2.5", "cc-by"]
    assert licenses.scan(h.empty(spark)).count() == 0


# 4


def test_decontamination_query(spark, sf_dir):
    docs = dict(_docs(spark, sf_dir))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = h.windows(bench)
    for r in queries.op4_benchmark_decontamination(spark, sf_dir).collect():
        n, hit, items = h.contamination(docs[r.doc_id], found)
        sha = hashlib.sha256(",".join(items).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), sha, hit > 0)


def test_decontamination_random_and_in_blocks(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    bench = [(k, say(rng.choice([0, 1, 3, 10, 12, 25]))) for k in range(30)] + [(99, None), (98, "- . -")]
    docs = [(k, say(rng.randint(0, 60)), None, None) for k in range(40)] + [(100, None, None, None), (101, "", None, None)]
    docs[3] = (3, f"{say(5)} {bench[5][1]} {say(3)}", None, None)
    found = h.windows([b for b in bench if b[1]])
    df, items = h.awkward(spark, docs), spark.createDataFrame(bench, "item_id long, text string")
    want = {d[0]: h.contamination(d[1], found) for d in docs}
    for block in (1_000_000, 5):
        rows = decontam.find(df, items, block_words=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == want
        clean = decontam.clean(df, items, block_words=block)
        assert clean.columns == df.columns
        assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, v in want.items() if not v[1])


def test_decontamination_longest_match(spark):
    bench = spark.createDataFrame([(7, "a b c d e f g h i j k l m")], "item_id long, text string")
    docs = h.awkward(spark, [(1, "x y b c d e f z", None, None), (2, "q a b c d e f g h i j k l q", None, None)])
    got = {r.doc_id: (r.longest, r.longest_at, r.longest_item, r.contaminated, [tuple(s) for s in r.spans]) for r in decontam.find(docs, bench).collect()}
    assert got == {1: (5, 2, "7", False, []), 2: (12, 1, "7", True, [(1, 13)])}


def test_decontamination_awkward(spark):
    bench = spark.createDataFrame([(1, h.PROSE)], "item_id long, text string")
    df = h.awkward(spark)
    assert decontam.find(df, bench).where("contaminated").count() == 4
    assert decontam.clean(df, bench).count() == len(h.AWKWARD) - 4
    assert decontam.find(h.empty(spark), bench).count() == 0
    assert decontam.clean(df, bench.where("false")).count() == len(h.AWKWARD)


@pytest.mark.parametrize("block", [1_000_000, 5])
def test_decontamination_by_items_without_id_and_of_each_row(spark, block):
    words = " ".join(f"q{k}" for k in range(12))
    bench = spark.createDataFrame([(None, words), (3, " ".join(f"r{k}" for k in range(12))), (None, None)], "item_id long, text string")
    plain = " ".join(f"x{k}" for k in range(12))
    docs = h.awkward(spark, [(1, words, None, None), (2, plain, None, None), (2, plain, None, None), (None, words, None, None), (None, plain, None, None), (4, words, None, None), (4, plain, None, None)])
    rows = decontam.find(docs, bench, block_words=block).collect()
    assert Counter((r.doc_id, r.contaminated, r.n_hit, len(r["items"])) for r in rows) == Counter({(1, True, 12, 0): 1, (2, False, 0, 0): 2, (None, True, 12, 0): 1, (None, False, 0, 0): 1, (4, True, 12, 0): 1, (4, False, 0, 0): 1})
    assert Counter((r.doc_id, r.text) for r in decontam.clean(docs, bench, block_words=block).collect()) == Counter({(2, plain): 2, (None, plain): 1, (4, plain): 1})


# 5


def test_join_query(spark, sf_dir):
    want = h.components(_docs(spark, sf_dir))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_ngram_jaccard_join(spark, sf_dir).collect()}
    assert got == want


def _near_copies(seed=9, groups=4, copies=25, most=3):
    rng = random.Random(seed)
    rows = []
    for base in range(groups):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(60 + 40 * base)]
        for _ in range(copies):
            copy = list(words)
            for _ in range(rng.randint(0, most)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(1000)}"
            rows.append((len(rows) + 1, " ".join(copy[: len(copy) - rng.randint(0, 4)]), None, None))
    return rows


@pytest.mark.parametrize("grams,sets", [(500_000, 1_000), (400, 3)])
def test_join_of_many_near_copies(spark, monkeypatch, grams, sets):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", grams)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", sets)
    rows = _near_copies()
    want = h.components([r[:2] for r in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(h.awkward(spark, rows)).collect()}
    assert got == want
    assert 4 < len({c for _, c in got.values()}) < 100


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_of_copies_that_pivots_miss(spark, seed):
    """Edits near the bound: much alike, seldom linked, so that tiles must find links."""
    rows = _near_copies(seed, 2, 60, 7)
    want = h.components([r[:2] for r in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(h.awkward(spark, rows)).collect()}
    assert got == want


def test_fragments_count_partial_overlaps(spark):
    rng = np.random.default_rng(3)
    common = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    sets = [np.sort(rng.choice(common, size, replace=False)) for size in (200, 150, 299, 1)]
    held = spark.createDataFrame([(k, len(s), s.tobytes()) for k, s in enumerate(sets)], "sid long, n long, grams binary")
    jobs = spark.createDataFrame([(7, 0, 0, 2, k, len(s)) for k, s in enumerate(sets)], "a long, b long, c long, role byte, sid long, n long")
    parts = [np.frombuffer(r["counts"], np.int32).reshape(4, 4) for r in ngram_join.partial_overlaps(jobs, held, 8).collect()]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert len(parts) == 8 and all((p[:3, :3] < want[:3, :3]).all() for p in parts)
    assert (sum(parts) == want).all()
    bounds = ngram_join._cuts(common, 8)
    for part, own in zip(range(8), np.split(common, bounds[1:-1]), strict=True):
        assert (ngram_join.fragment_of(own, 8) == part).all()


def test_join_by_ids_that_are_words(spark):
    rows = [("b", h.PROSE), ("a", h.PROSE + " today"), ("c", "else"), (None, h.PROSE), (None, "else")]
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == Counter([("b", "a"), ("a", "a"), ("c", "c"), (None, "a"), (None, "c")])


def test_join_awkward(spark):
    df = h.awkward(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(df).collect()}
    assert got[1][1] == got[2][1] == got[3][1] == 1 and got[4] == (0, 4) and got[5] == (0, 5) and got[6] == (0, 6)
    assert got[10] == (1, 10) and got[11] == (1, 10) and got[9] == (1, 9) and got[13] == (1, 13) and got[-5][1] == -5 and got[None][1] is None
    assert ngram_join.link(h.empty(spark)).count() == 0


def test_keep_one_row_leaves_one_of_each_group(spark):
    rows = [(5, h.PROSE), (5, h.PROSE), (5, "one two three"), (None, h.PROSE), (7, "one two three"), (None, "three four"), (None, "three four"), (8, None), (8, ""), (9, ""), (None, None), (None, ""), (6, h.PROSE + " today")]
    df = h.awkward(spark, [(*r, None, "a") for r in rows])
    kept = ngram_join.keep_one_row(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter({(5, h.PROSE): 1, (5, "one two three"): 1, (None, "three four"): 1, (8, ""): 1, (9, ""): 1, (None, ""): 2})
    assert ngram_join.keep_one_row(h.empty(spark)).count() == 0


# 7


def test_quality_rules_query(spark, sf_dir):
    docs = dict(_docs(spark, sf_dir))
    rows = queries.op7_quality_rules(spark, sf_dir).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == h.base_rules(docs[r.doc_id])
        assert r.kept == (not r.base_failed and r.in_band)
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    passed = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in passed) >= 0.98 * len(passed)


def test_kneser_ney_sums_to_one_and_matches_a_plain_version(spark):
    texts = [h.PROSE, h.PROSE[:40], "abcABCabd", "x", "Добрый день, добрый вечер \U0001f600 día"]
    df = spark.createDataFrame([(t, "=en") for t in texts] + [(h.PROSE, "=de")], "text string, lang string")
    counts = Counter()
    for t in texts:
        s = [ord(c) if ord(c) < 65536 else 0xD800 + ord(c) % 2048 for c in h.lower(t)]
        for k in range(len(s) - 3):
            counts[tuple(s[k : k + 4])] += 1
    size = quality_rules.SYMBOLS
    code = lambda g: sum(v * size ** (len(g) - 1 - k) for k, v in enumerate(g))
    got = {r.code % 2**64: r.n for r in quality_rules.counts(df).where("lang = '=en'").collect()}
    assert got == {code(g): n for g, n in counts.items()}
    order, models = quality_rules.fit(df)
    model = models["=en"]
    assert order == 4 and sorted(models) == ["=de", "=en"]
    assert quality_rules.fit(df, grams=100)[0] < 4
    levels = {4: dict(counts)}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def prob(g):
        n = len(g)
        if n == 0:
            return 1 / size
        d = model._discounts(np.array(list(levels[n].values())))
        after = {w: c for w, c in levels[n].items() if w[:-1] == g[:-1]}
        total = sum(after.values())
        if not total:
            return prob(g[1:])
        c = after.get(g, 0)
        return (c - d[min(c, 3)]) / total + sum(d[min(v, 3)] for v in after.values()) / total * prob(g[1:])

    for context in [(1, 2, 3), next(iter(counts))[:3], (9, 9, 9)]:
        grams = np.array([code((*context, w)) for w in range(size)], np.uint64)
        p = np.exp(model.log_prob(grams))
        assert abs(p.sum() - 1) < 1e-9
        some = sorted({g[-1] for g in counts} | {0, 9, 500, size - 1})
        assert np.allclose(p[some], [prob((*context, w)) for w in some])


def test_quality_rules_awkward(spark):
    got = quality_rules.judge(h.awkward(spark)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((i, *h.base_rules(t)) for i, t, _, _ in h.AWKWARD)
    assert all(r.perplexity is None and r.in_band for r in got if r.doc_id in (4, 5))
    assert quality_rules.judge(h.empty(spark)).count() == 0


def test_quality_model_keeps_its_order_at_any_size(spark):
    rng = np.random.default_rng(5)
    points = rng.integers(0x4E00, 0x9000, (900, 2_400))  # more different 4-grams than are sent to every task
    docs = h.awkward(spark, [(k, "".join(map(chr, p)), "zh", None) for k, p in enumerate(points.tolist())])
    code = np.zeros((900, 2_397), np.uint64)
    for k in range(4):
        code = (code << np.uint64(16)) | points[:, k : k + 2_397].astype(np.uint64)
    grams, n = np.unique(code, return_counts=True)
    assert len(grams) > quality_rules.MODEL_GRAMS
    model = quality_rules.KneserNey(grams, n)
    got = {r.doc_id: r.perplexity for r in quality_rules.judge(docs).collect()}
    assert len(got) == 900
    for k in range(0, 900, 90):
        assert abs(np.log(got[k]) + model.log_prob(code[k]).mean()) < 1e-9


def test_quality_results_do_not_depend_on_how_the_model_is_sent(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(quality_rules, "PART_BYTES", 20_000)
    for docs in (h.awkward(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        sent, dealt = (Counter(quality_rules.judge(docs, grams=grams).collect()) for grams in (quality_rules.MODEL_GRAMS, 0))
        assert sent == dealt and sent.total() == docs.count()


@pytest.mark.parametrize("letters", ["етаоинсрвлкм", "あいうえおかきくけこさし", "ابتثجحخدذرزس"])
def test_quality_band_reads_other_scripts(spark, letters):
    rng = random.Random(4)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)]
    good = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(100)]
    junk = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(80)) for _ in range(10)]
    rows = quality_rules.judge(h.awkward(spark, [(k, t, "xx", None) for k, t in enumerate(good + junk)])).collect()
    inside = {r.doc_id: r.in_band for r in rows}
    assert not any(inside[k] for k in range(100, 110)) and sum(inside[k] for k in range(100)) >= 98
    low, high = rows[0].low, rows[0].high
    level = np.sort(np.log([r.perplexity for r in rows]))
    half = min((level[k + 55] - level[k], level[k]) for k in range(55))  # the shorter half, plainly
    middle, spread = half[1] + half[0] / 2, half[0] / (2 * 0.6745)
    width = max(0.15, 3 * spread)
    assert abs(np.log(low) - (middle - width)) < 0.05 and abs(np.log(high) - (middle + width)) < 0.05


@pytest.mark.parametrize("share", [0.05, 0.2, 0.33])
def test_quality_band_rejects_planted_junk(spark, share):
    rng = random.Random(12)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    say = lambda own, n: " ".join(rng.choice(own) for _ in range(n))
    good = [say(words, rng.randint(60, 120)) for _ in range(134)]
    junk = [say(words[: 2 + k % 4], rng.randint(60, 120)) for k in range(round(len(good) * share / (1 - share)))]
    docs = h.awkward(spark, [(k, t, "en", None) for k, t in enumerate(good + junk)] + [(1000 + k, t, "de", None) for k, t in enumerate(good)])
    inside = {r.doc_id: r.in_band for r in quality_rules.judge(docs).collect()}
    assert not any(inside[k] for k in range(len(good), len(good) + len(junk)))
    assert sum(inside[k] for k in range(len(good))) >= 0.98 * len(good) and sum(inside[1000 + k] for k in range(len(good))) >= 0.98 * len(good)


# 9


def _check_shards(rows, shards):
    sizes = Counter(r.shard for r in rows)
    counts = [sizes.get(k, 0) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_query(spark, sf_dir):
    docs = dict(_docs(spark, sf_dir))
    rows = queries.op9_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    _check_shards(rows, 16)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    share = Counter(r.source for r in rows)
    for (_, source), n in Counter((r.shard, r.source) for r in rows).items():
        assert abs(n - share[source] / 16) <= 2


def test_sharding_is_the_sort_by_fractional_rank(spark, monkeypatch):
    rows = [(k, f"t{k}", None, ["a", "b", None][k % 7 % 3]) for k in range(500)]
    df = h.awkward(spark, rows)
    plain = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(df, 7).collect()}
    monkeypatch.setattr(sharding, "buckets", lambda n: 1)
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(df, 7).collect()} == plain
    monkeypatch.setattr(sharding, "buckets", lambda n: 37)
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(df.repartition(5), 7).collect()} == plain
    order = [r for _, r in sorted((v, k) for k, v in plain.items())]
    by = {r[0]: r[3] for r in rows}
    rank, n, values = Counter(), Counter(by.values()), []
    for i in order:
        rank[by[i]] += 1
        values.append((rank[by[i]] - 0.5) / n[by[i]])
    assert values == sorted(values)


def test_sharding_awkward(spark):
    df = h.awkward(spark)
    out = sharding.interleave(df, 4)
    rows = out.collect()
    assert len(rows) == len(h.AWKWARD) and set(out.columns) == set(df.columns)
    _check_shards(rows, 4)
    assert sharding.interleave(h.empty(spark), 4).count() == 0


# 10


def fill(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Targets by repeated resharing of what overflows."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_mixing_query(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_mixing(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes = Counter()
    for d in docs.values():
        sizes[d.source] += len(h.solid(d.text))
    want = fill(sizes)
    taken, longest = Counter(), Counter()
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len(h.solid(d.text)) and r.source_size == sizes[d.source] and abs(r.target - want[d.source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[d.source] += r.taken
        longest[d.source] = max(longest[d.source], r.size)
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.5 * longest[s] + 1
    assert {r.doc_id: r.taken for r in queries.op10_mixing(spark, sf_dir).collect()} == {r.doc_id: r.taken for r in rows}


def test_mixing_in_several_levels(spark):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randint(1, 40), None, "abc"[min(k % 11, 2)]) for k in range(2000)]
    got = mixing.plan(h.awkward(spark, rows), block=40, fan=4).collect()
    by = {r[0]: r[3] for r in rows}
    taken, target, count = Counter(), {}, Counter()
    for r in got:
        s = by[r.doc_id]
        taken[s] += r.taken
        count[s] += r.copies
        target[s] = (r.target, r.source_size)
    n = Counter(by.values())
    for s, (want, size) in target.items():
        assert abs(taken[s] - want) <= 3
        assert abs(count[s] - n[s] * want / size) <= 12


def test_mixing_by_ids_that_are_words(spark):
    rows = [(f"id {k}" if k % 7 else None, h.PROSE + f" {k}" * (k % 5), None, "ab"[k % 2]) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    got = mixing.plan(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert sum(r.taken for r in got) > 0
    again = mixing.plan(df.repartition(3)).collect()
    key = lambda r: (r.doc_id or "", r["_fj_crc"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_cube_flight_keeps_its_totals():
    rng = np.random.default_rng(1)
    x, c = rng.integers(0, 50, 400).astype(float), np.ones(400)
    p = rng.random(400)
    hits = np.zeros(400)
    for k in range(200):
        q = mixing.flight(x, c, p, np.random.default_rng(k))
        assert abs(q @ x - p @ x) < 1e-4 and abs(q.sum() - p.sum()) < 1e-6
        assert ((q > 0) & (q < 1)).sum() <= 2
        hits += q
    assert np.abs(hits / 200 - p).mean() < 0.05


def test_mixing_awkward(spark):
    df = h.awkward(spark)
    rows = mixing.plan(df).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in h.AWKWARD)
    assert all(r.taken <= 2 * r.size and (r.size or not r.taken) for r in rows)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(h.solid(r.text))
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.taken
    assert +words == +want
    assert mixing.plan(h.empty(spark)).count() == 0 and mixing.mix(h.empty(spark)).count() == 0
