"""Learnt operators: held-out accuracy, plain versions of their scores, awkward rows, and the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fjordline.llm import decontam, lm_score, mixing, queries, quality_classifier, toxicity
from fjordline.llm import text as tx
from fjordline.llm.spark import components
from tests.llm import helpers as h

BIG = "/root/testdata/sf0.01"


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    _, place, count = np.unique(s, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    rank = ((last - count + 1 + last) / 2)[place]
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def _held(spark, rows, label):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    own = [(truth[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    return [np.array(v) for v in zip(*own, strict=True)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5050)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3


def test_automaton_is_the_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(2)
    terms = list({"".join(rng.choice("abc") for _ in range(rng.randint(2, 11))) for _ in range(40)}) + ["ab*", "cac*", "caccb*"]
    lexicon = toxicity.Lexicon(terms)
    for _ in range(4000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) if rng.random() < 0.4 else rng.choice(terms[:-3])
        if rng.random() < 0.7:
            at = rng.randrange(len(word) + 1)
            word = word[:at] + rng.choice("abcd") * rng.randint(0, 1) + word[at + rng.randint(0, 1) :]
        whole = {t: distance(word, t) for t in terms if not t.endswith("*")}
        ok = {t: d for t, d in whole.items() if d <= lexicon.edits(len(t))}
        want = {(t, d) for t, d in ok.items() if d == min(ok.values())}
        stems = [t for t in terms if t.endswith("*") and word.startswith(t[:-1])]
        want |= {(max(stems, key=len), 0)} if stems else set()
        assert {(terms[t], e) for t, e in lexicon.find(word)} == want, word


def test_quotation_weighs_less_than_abuse():
    hits = toxicity.Hits(["stupid", "moron"])
    texts = ['they wrote "stupid" in the old report', "you stupid moron you", "a stupid idea in the old report", "stupld thing", '"' + "far away " * 20 + "stupid " + "far away " * 20 + '"']
    (chunk,) = tx.chunks(pa.array(texts))
    row, _, _, edits, quoted, strength = hits.scan(chunk)
    best = {k: max(s for r, s in zip(row, strength, strict=True) if r == k) for k in range(5)}
    assert best[0] < best[2] < best[1] and best[3] < best[2]
    assert list(quoted[row == 0]) == [True] and not quoted[row != 0].any()
    assert edits[row == 3].tolist() == [1]


def test_quotation_marks_of_all_kinds_and_no_apostrophes():
    hits = toxicity.Hits(["stupid", "moron"])
    texts = ["you're a stupid fool and i don't care", "you\u2019re a stupid fool and i don\u2019t care", "he wrote \u201cstupid\u201d there", "he wrote \u2018moron\u2019 there", "\u00abstupid\u00bb", 'not "this" stupid "that"', "it is 'stupid'", "next row"]
    (chunk,) = tx.chunks(pa.array(texts))
    row, word, _, edits, quoted, _ = hits.scan(chunk)
    got = {int(r): bool(q) for r, q in zip(row, quoted, strict=True)}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: True, 5: False, 6: True} and not edits.any()
    assert word[row == 2].tolist() == [2]


def test_toxicity_is_its_parts_put_together_plainly(spark, sf_dir):
    """The query's scores from the fitted model, by plain Python over hits."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    hits = toxicity.Hits(model.terms)
    got = {r.doc_id: r.score for r in queries.op3_toxicity(spark, sf_dir).collect()}
    n = len(model.terms)
    for r in docs.collect():
        found = []
        for chunk in tx.chunks(pa.array([r.text or ""])):
            found = list(zip(*(x.tolist() for x in hits.scan(chunk)[2:]), strict=True))
        raw, total = model.bias, sum(s for *_, s in found)
        for t in {f[0] for f in found}:
            raw += model.weights[t] * np.log1p(sum(s for u, *_, s in found if u == t))
        if found:
            size = max(np.log1p(len((r.text or "").encode()) / 6), 1)
            extra = [1, np.log1p(total), np.log1p(total) / size, sum(q for _, _, q, _ in found) / len(found), float(any(e == 0 for _, e, _, _ in found))]
            raw += sum(model.weights[n + k] * v for k, v in enumerate(extra))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-9, r.doc_id


def test_toxicity_held_out(spark):
    rows = queries.op3_toxicity(spark, BIG).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == h.held_out(r.doc_id) for r in rows)
    y, s, p = _held(spark, rows, "toxic")
    assert auc(y, s) > 0.75 and (y == p).mean() > 0.9
    again = {r.doc_id: r.score for r in queries.op3_toxicity(spark, BIG).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def _labels(spark, name):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(300):
        bad = k % 3 == 0
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(9)) for _ in range(30)]
        if bad:
            words[rng.randrange(30)] = rng.choice(["dreadful", "horrid", "grumbly", "grumblish", "grumblous"])
        rows.append((k, " ".join(words), None, "a"))
        labels.append((k, int(bad)))
    labels += [(k, None) for k in range(5)] + [(99_999, 1), (None, 1)]
    return rows, spark.createDataFrame(labels, f"doc_id long, {name} int")


def test_toxicity_awkward(spark):
    rows, labels = _labels(spark, "toxic")
    extra = [(1000 + k, t, None, None) for k, t in enumerate(["a dreadfull thing", "grumblify", "fine words", None, "", h.LONG])]
    df = h.awkward(spark, rows + extra)
    got = {r.doc_id: r for r in toxicity.classify(df, labels).collect()}
    assert len(got) == len(rows) + len(extra)
    assert got[1000].score > got[1002].score and got[1001].score > got[1002].score
    assert got[1002].score == got[1003].score == got[1004].score == got[1005].score < 0.5
    assert sum((r.predicted == (k % 3 == 0)) for k, r in got.items() if k < 300) > 290
    kept = toxicity.clean(df, labels)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(k for k, r in got.items() if not r.predicted)
    awkward = toxicity.classify(h.awkward(spark), labels)
    assert Counter(r.doc_id for r in awkward.collect()) == Counter(i for i, *_ in h.AWKWARD)
    assert toxicity.classify(h.empty(spark), labels).count() == 0
    assert {r.score < 0.01 for r in toxicity.classify(h.awkward(spark), labels.where("false")).collect()} == {True}


# 6


@pytest.fixture(scope="module")
def small_model():
    texts = [t for _, t, _, _ in h.AWKWARD if t and len(t) < 1000]
    found = Counter(w for t in texts for w in h.alnum(t))
    hashes = np.array([tx.seed_of(w) for w, _ in found.most_common(20)], np.uint64)
    voc = lm_score.Vocabulary(hashes)
    counts = np.zeros(lm_score.VOCABULARY)
    counts[1:21] = [n for _, n in found.most_common(20)]
    return voc, lm_score.Network.start(counts)


def _plain_score(text, voc, net):
    words = h.alnum(text)
    number = voc.numbers(np.array([tx.seed_of(w) for w in words], np.uint64)).tolist() if words else []
    p, total = net.parts, 0.0
    for k, w in enumerate(number):
        z = p["b"].astype(float).copy()
        for slot, d in enumerate([-2, -1, 1, 2]):
            z += p["E"][number[k + d] if 0 <= k + d < len(number) else 0] * p["P"][slot]
        hidden = np.tanh(z)
        a = hidden @ p["C"] + p["c"]
        b = hidden @ p["W"][w // 64] + p["w"][w // 64]
        total += a[w // 64] - np.log(np.exp(a).sum()) + b[w % 64] - np.log(np.exp(b).sum())
    return len(words), total


def test_lm_score_is_the_sum_of_masked_log_probabilities(spark, small_model):
    voc, net = small_model
    rows = [r for r in h.AWKWARD if r[1] is None or len(r[1]) < 1000]
    got = lm_score.score(h.awkward(spark, rows), model=small_model).collect()
    want = {i: _plain_score(t, voc, net) for i, t, _, _ in rows}
    for r in got:
        n, total = want[r.doc_id]
        assert r.n_words == n and abs(r.log_prob - total) < 1e-3 * max(1, n)
        assert (r.mean_log_prob is None) == (n == 0)


def test_lm_steps_do_not_change_scores(small_model, monkeypatch):
    (chunk,) = tx.chunks(pa.array([h.LONG[:20_000]]))
    whole = lm_score.measure(chunk, *small_model)[1]
    monkeypatch.setattr(lm_score, "STEP", 100)
    assert np.allclose(lm_score.measure(chunk, *small_model)[1], whole, rtol=1e-5)


def test_lm_training_beats_word_frequencies(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    voc, net = lm_score.fit(docs, docs_per_task=250)
    counts = lm_score.vocabulary(docs)[1]
    start = lm_score.Network.start(counts)
    start.parts["E"][:] = 0
    trained = lm_score.score(docs, model=(voc, net)).agg({"log_prob": "sum"}).first()[0]
    assert trained > lm_score.score(docs, model=(voc, start)).agg({"log_prob": "sum"}).first()[0]
    again = lm_score.fit(docs, docs_per_task=250)[1]
    assert np.allclose(again.flat(), net.flat())


@pytest.mark.parametrize("scale", [1, 300])  # logits that exp can take as they are, and beyond
def test_lm_step_is_plain_adagrad(scale):
    rng = np.random.default_rng(9)
    n = 70
    word, ctx = rng.integers(0, 200, n), rng.integers(0, 40, (n, 4))  # numbers repeat within a place and across places
    start = lm_score.Network.start(rng.integers(0, 50, lm_score.VOCABULARY))
    flat = lm_score.Network.unflat(start.flat() + rng.normal(0, 0.3, len(start.flat())) * scale).flat()
    p = {k: v.astype(float).copy() for k, v in lm_score.Network.unflat(flat).parts.items()}
    grads, want = {k: np.zeros_like(v) for k, v in p.items()}, []
    for w, c in zip(word.tolist(), ctx.tolist(), strict=True):
        hidden = np.tanh(p["b"] + sum(p["E"][c[k]] * p["P"][k] for k in range(4)))
        a, b = hidden @ p["C"] + p["c"], hidden @ p["W"][w // 64] + p["w"][w // 64]
        a, b = (x - x.max() - np.log(np.exp(x - x.max()).sum()) for x in (a, b))
        want.append(a[w // 64] + b[w % 64])
        da, db = np.exp(a) - np.eye(64)[w // 64], np.exp(b) - np.eye(64)[w % 64]
        dz = (p["C"] @ da + p["W"][w // 64] @ db) * (1 - hidden**2)
        for k, at, g in [("C", ..., np.outer(hidden, da)), ("c", ..., da), ("W", w // 64, np.outer(hidden, db)), ("w", w // 64, db), ("b", ..., dz)]:
            grads[k][at] += g / n
        for k in range(4):
            grads["E"][c[k]] += dz * p["P"][k] / n
            grads["P"][k] += dz * p["E"][c[k]] / n
    net = lm_score.Network.unflat(flat)
    assert np.allclose(net.log_prob(ctx, word), want, rtol=1e-4, atol=1e-3)
    seen = net.squares()
    net.train(ctx, word, seen=seen)
    for k, g in grads.items():
        step = lm_score.RATE * g / np.sqrt(lm_score.FLOOR + g * g)
        clear = (np.abs(g) > 1e-4) | (g == 0)  # single precision
        assert np.allclose((p[k] - net.parts[k])[clear], step[clear], atol=2e-3 if scale == 1 else 2e-2), k


def test_lm_awkward(spark):
    got = lm_score.score(h.awkward(spark))
    assert Counter(r.doc_id for r in got.collect()) == Counter(i for i, *_ in h.AWKWARD)
    assert lm_score.score(h.empty(spark)).count() == 0


def test_lm_trains_on_every_document(spark):
    for k in (0, -1):  # tables of one document, whatever its hash
        docs = h.awkward(spark, [h.AWKWARD[k]])
        net = lm_score.fit(docs)[1]
        assert not np.allclose(net.flat(), lm_score.Network.start(lm_score.vocabulary(docs)[1]).flat())


def test_lm_words_have_probabilities_of_their_own(spark, monkeypatch):
    words = [f"w{k}" for k in range(6_000)]
    rng = random.Random(4)
    texts = [" ".join(rng.choice(words[:3_000]) for _ in range(400)) for _ in range(40)] + [" ".join(words)]
    docs = h.awkward(spark, [(k, t, None, None) for k, t in enumerate(texts)])
    voc, net = lm_score.fit(docs)
    counts = Counter(w for t in texts for w in t.split())
    number = dict(zip(words, voc.numbers(np.array([tx.seed_of(w) for w in words], np.uint64)).tolist(), strict=True))
    bucket = Counter()
    for w, n in counts.items():
        bucket[number[w]] += n
    asked = texts[:3] + texts[-1:] + ["neverseen", None]
    got = {r.doc_id: (r.n_words, r.log_prob) for r in lm_score.score(h.awkward(spark, [(k, t, None, None) for k, t in enumerate(asked)]), model=(voc, net)).collect()}
    for k, t in enumerate(asked):
        n, want = _plain_score(t, voc, net)
        for w in h.alnum(t):
            b = number.get(w, int(voc.numbers(np.array([tx.seed_of(w)], np.uint64))[0]))
            if b >= lm_score.OWN:
                want += np.log(counts.get(w, 1) / (bucket[b] + 1))
        assert got[k][0] == n and abs(got[k][1] - want) < 1e-3 * max(1, n)
    alike = next(b for b, n in Counter(number.values()).items() if n > 2 and b >= lm_score.OWN)
    own = sorted((w for w in words if number[w] == alike), key=counts.get)
    least, most = (r.log_prob for r in sorted(lm_score.score(h.awkward(spark, [(0, own[0], None, None), (1, own[-1], None, None)]), model=(voc, net)).collect(), key=lambda r: r.doc_id))
    assert abs(most - least - np.log(counts[own[-1]] / counts[own[0]])) < 1e-4


# 8


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = quality_classifier.Machine(np.sort(rng.random((len(quality_classifier.STATS), quality_classifier.BINS - 1)), 1))
    m.w, m.v, m.w0 = rng.normal(0, 1, m.w.shape).astype(np.float32), rng.normal(0, 0.3, m.v.shape).astype(np.float32), 0.3
    row, bucket = np.array([0, 0, 0, 2, 2]), np.array([5, 7, 9, 5, 11])
    stats = rng.random((3, len(quality_classifier.STATS)))
    index, value, at = m.inputs(row, bucket, stats)
    raw = m.raw(index, value, at)[0]
    for k in range(3):
        i, x = index[at[k] : at[k + 1]], value[at[k] : at[k + 1]]
        want = 0.3 + m.w[i] @ x + sum(float(m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(raw[k] - want) < 1e-3


def test_classifier_held_out(spark):
    rows = queries.op8_quality_classifier(spark, BIG).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    y, s, p = _held(spark, rows, "quality")
    assert auc(y, s) > 0.9 and (y == p).mean() > 0.85


def test_classifier_awkward(spark):
    rows, labels = _labels(spark, "quality")
    got = quality_classifier.classify(h.awkward(spark, rows + h.AWKWARD[3:]), labels).collect()
    assert len(got) == len(rows) + len(h.AWKWARD) - 3
    assert quality_classifier.classify(h.empty(spark), labels).count() == 0
    assert {r.score for r in quality_classifier.classify(h.awkward(spark), labels.where("false")).collect()} == {0.5}


# The pipeline


def _plain_stage(name, rows, spark, sf_dir):
    """The ids that a plain version of the exact stages keeps: near copies by five words and similarity 0.8."""
    if name == "ngram_jaccard_join":
        return {i for i, (_, c) in h.components([(r.doc_id, r.text) for r in rows], 80, 100, 5).items() if c == i}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = h.windows(bench)
    return {r.doc_id for r in rows if not h.contamination(r.text, found)[1]}


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.Table(stage(spark, docs, sf_dir)).df
        after = out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        texts = {r.doc_id: r.text for r in before}
        assert all(texts[r.doc_id] == r.text for r in after)
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            assert {r.doc_id for r in after} == {r.doc_id for r in toxicity.classify(docs, labels).where("predicted = 0").collect()}
        elif name in ("ngram_jaccard_join", "benchmark_decontamination"):
            assert {r.doc_id for r in after} == _plain_stage(name, before, spark, sf_dir) and len(after) == len({r.doc_id for r in after})
        elif name == "mixing":
            want = {r.doc_id: r.copies for r in mixing.plan(docs).where("taken > 0").collect()}
            assert Counter(r.doc_id for r in after) == Counter(want)
        else:
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
            sizes = Counter(r.shard for r in after)
            assert max(sizes.values()) - min(sizes.values()) <= 1
        docs, before = out, after
    assert decontam.WINDOW == 10


def test_pipeline_drops_copies_by_five_words_and_similarity_0_8(spark, sf_dir):
    words = [f"w{k}" for k in range(104)]
    edited = ["new" if k in (30, 70) else w for k, w in enumerate(words)]  # 90 of 110 shingles shared by five words, 96 of 108 by three
    more = [*words, *(f"x{k}" for k in range(20))]  # 100 of 120 by five words, 102 of 122 by three
    far = [*words[:60], *(f"y{k}" for k in range(44))]
    docs = h.awkward(spark, [(k, " ".join(w), "en", "a") for k, w in enumerate([words, edited, more, far])] + [(0, " ".join(words), "en", "a"), (None, " ".join(words), "en", "a")])
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"]
    assert sorted(r.doc_id for r in stage(spark, docs, sf_dir).collect()) == [0, 3]


def test_pipeline_stage_is_the_join_by_five_words_and_similarity_0_8(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(i for i, (_, c) in h.components([(r.doc_id, r.text) for r in docs.collect()], 80, 100, 5).items() if c == i)
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"]
    assert sorted(r.doc_id for r in stage(spark, docs, sf_dir).collect()) == want


def test_pipeline_run_is_its_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[-2:] == ["shard", "slot"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert Counter((r.doc_id, r.shard, r.slot) for r in docs.collect()) == Counter((r.doc_id, r.shard, r.slot) for r in out.collect())


def test_pipeline_awkward(spark, sf_dir, tmp_path):
    base = f"file://{tmp_path}"
    h.awkward(spark).write.parquet(f"{base}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{base}/{name}.parquet")
    assert corpus_pipeline.run(spark, base).count() > 0
    h.empty(spark).write.parquet(f"{base}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{base}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{base}/none").count() == 0
