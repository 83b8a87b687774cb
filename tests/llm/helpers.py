"""Plain Python versions of the operators' definitions, and a table of awkward rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return ALNUM.findall(lower(text))


def solid(text):
    return SOLID.findall(text or "")


LONG = " ".join(f"w{k % 977}x{k // 977}" for k in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog while seventeen patient owls watch from the old oak tree near the river bank and say nothing at all about it"
AWKWARD = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (3, PROSE + " today", "en", "a"),
    (4, None, "en", "b"),
    (5, "", None, "b"),
    (6, " \n\t\n ", "de", None),
    (7, LONG, "en", "a"),
    (8, "Ünï çödé  \U0001f600 straße\x00\x01 ok", "de", "a"),
    (9, "one", "en", "c"),
    (10, "one two", "en", "c"),
    (11, "ONE TWO", "en", "c"),
    (12, "a\na\n\nb\r\na", None, None),
    (13, "!!! ??? ...", "en", "a"),
    (13, "!!! ??? ...", "en", "a"),
    (None, "a row without an id", "en", "a"),
    (-5, PROSE.replace("fox", "cat"), "en", "d"),
]


def awkward(spark, rows=None):
    """The rows with columns that clash with names the operators use inside."""
    df = spark.createDataFrame(AWKWARD if rows is None else rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    for name in ("id", "h", "key", "size", "shard", "slot", "n", "n_words", "items", "score", "line", "component", "taken", "y", "k"):
        df = df.withColumn(name, F.lit(name))
    return df


def empty(spark):
    return awkward(spark, AWKWARD[:1]).where("false")


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def windows(bench, size=10):
    found = defaultdict(set)
    for item, text in bench:
        w = alnum(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            found[tuple(w[k : k + n])].add(str(item))
    return found


def contamination(text, found):
    w = alnum(text)
    hit, items = set(), set()
    for n in {len(k) for k in found}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in found:
                items |= found[tuple(w[k : k + n])]
                hit |= set(range(k, k + n))
    return len(w), len(hit), sorted(items)


def shingles(text, n=3):
    w = SOLID.findall(lower(text))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(docs, num=90, den=100, n=3):
    """doc_id -> smallest id reachable by links."""
    sets = {i: shingles(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    holders = defaultdict(list)
    for i in ids:
        both = Counter(j for g in sets[i] for j in holders[g])
        for j, k in both.items():
            if den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for g in sets[i]:
            holders[g].append(i)
    return {i: (len(sets[i]), root(i)) for i in ids}


def base_rules(text):
    text = text or ""
    w = solid(text)
    lines = [x for x in text.split("\n") if SOLID.search(x)]
    often = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) if often[tuple(w[k : k + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def edits_within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def line_counts(docs, least=10):
    """doc_id -> (n_lines, exact, near), earlier lines in order of (id, line)."""
    seen, order, out = {}, [], {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        lines = t.split("\n") if t is not None else []
        exact = near = 0
        for x in lines:
            if not x.strip(" \t\n\r\x0b\x0c"):
                continue
            if x in seen:
                exact += 1
                continue
            if len(x) >= least and any(edits_within_one(x, y) for y in order):
                near += 1
            seen[x] = True
            if len(x) >= least:
                order.append(x)
        out[i] = (len(lines), exact, near)
    return out
