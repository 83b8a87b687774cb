"""The registered queries of the corpus operators, over whole tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fjordline.llm import line_dedup

    return line_dedup.summary(_read(spark, sf_dir, "documents")).drop("gone")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fjordline.llm import licenses

    found = licenses.digest(licenses.scan(_read(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fjordline.llm import toxicity

    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fjordline.llm import decontam

    found = decontam.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long").alias("n_items")
    return found.select("doc_id", "n_words", "n_hit", n_items, F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fjordline.llm import ngram_join

    return ngram_join.link(_read(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fjordline.llm import lm_score

    return lm_score.score(_read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fjordline.llm import quality_rules

    return quality_rules.judge(_read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fjordline.llm import quality_classifier

    return quality_classifier.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fjordline.llm import sharding

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.interleave(docs, 16, tie=["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fjordline.llm import mixing

    return mixing.plan(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scans": op2_license_scans,
    "op3_toxicity": op3_toxicity,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SOLID = "regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

_DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format("text")} w FROM documents), b AS (SELECT item_id::VARCHAR item, {_ALNUM.format("text")} w FROM benchmark),
bw AS (SELECT item, least(len(w), 10) n, unnest(range(1, len(w) - least(len(w), 10) + 2)) i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, w[i : i + n - 1] g FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, w[i : i + n - 1] g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.n, dw.i, win.item FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
items AS (SELECT doc_id, count(DISTINCT item) n_items, string_agg(DISTINCT item, ',' ORDER BY item) items FROM hits GROUP BY 1),
words AS (SELECT doc_id, count(DISTINCT k) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) k FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN words USING (doc_id)"""

_JOIN = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_SOLID.format("text")} w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, w[i : i + n - 1] g FROM (SELECT doc_id, w, least(len(w), 3) n, unnest(range(1, len(w) - least(len(w), 3) + 2)) i FROM d WHERE len(w) > 0)),
size AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY 1),
pairs AS MATERIALIZED (SELECT a.doc_id x, b.doc_id y, count(*) shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON reach.other = edges.x)
SELECT r.doc_id, coalesce(any_value(size.n), 0) n_shingles, min(other) component_id FROM reach r LEFT JOIN size ON size.doc_id = r.doc_id GROUP BY 1"""

_SHARDING = """
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) t),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda v: ('0x' || v)::BIGINT)), lambda a, v: xor(t[(xor(a, v) & 255) + 1], a >> 8)), 4294967295) text_crc32 FROM documents, tab),
d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 size, md5('2024:' || coalesce(doc_id::VARCHAR, 'null')) h, coalesce('=' || source, '') s FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id) r, count(*) OVER (PARTITION BY s) n, count(*) OVER () total FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2.0::DOUBLE * n), s, r) - 1 p FROM r),
q AS (SELECT *, ((p * 16) // total)::INTEGER shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' law, shard, p - (shard * total + 15) // 16 slot, NULL::INTEGER grown_shard, source FROM q JOIN crc USING (doc_id)"""

_LINES = r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) a FROM documents WHERE text IS NOT NULL),
l AS MATERIALIZED (SELECT doc_id, unnest(range(len(a))) n, unnest(a) l FROM a),
full_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY l ORDER BY doc_id NULLS FIRST, n) copy FROM l WHERE regexp_matches(l, '[^ \t\r\x0B\x0C]')),
f AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, n) rn FROM full_ WHERE copy = 1 AND length(l) >= 10),
cut AS MATERIALIZED (SELECT rn, i, length(l) size, hash(l[1 : i] || l[i + 2 :]) k FROM (SELECT *, unnest(range(length(l))) i FROM f)),
same AS (SELECT rn, min(rn) OVER (PARTITION BY size, i, k) w FROM cut),
longer AS (SELECT cut.rn a, f.rn b FROM cut JOIN f ON cut.k = hash(f.l) AND cut.size = length(f.l) + 1),
near AS (SELECT DISTINCT rn FROM (SELECT rn FROM same WHERE w < rn UNION ALL SELECT greatest(a, b) FROM longer)),
gone AS (SELECT full_.doc_id, count_if(full_.copy > 1) n_exact, count_if(near.rn IS NOT NULL) n_near FROM full_ LEFT JOIN f ON full_.doc_id = f.doc_id AND full_.n = f.n LEFT JOIN near ON near.rn = f.rn GROUP BY 1),
total AS (SELECT doc_id, len(a) n_lines FROM a)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT n_lines, coalesce(n_exact, 0)::BIGINT n_exact, coalesce(n_near, 0)::BIGINT n_near, (coalesce(n_lines, 0) - coalesce(n_exact, 0) - coalesce(n_near, 0))::BIGINT n_kept
FROM documents d LEFT JOIN total USING (doc_id) LEFT JOIN gone USING (doc_id)"""


def _licenses_sql() -> str:
    """The templates as regular expressions over the words, each with a space before it."""
    import re

    from fjordline.llm.licenses import BASE, NOTICES

    def pattern(markup: str) -> tuple[str, int]:
        out, fixed = "", 0
        for mark in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", markup):
            if mark == "[[":
                out += "(?:"
            elif mark == "]]":
                out += ")?"
            elif mark.startswith("{{"):
                out += "(?: [^ ]+){%s}" % mark[2:-2].replace("-", ",")
            else:
                out, fixed = out + " " + mark, fixed + 1
        return out + " ", fixed

    labels, scores = [], []
    for t in BASE + NOTICES:
        regex, fixed = pattern(t.markup)
        labels.append(f"CASE WHEN regexp_matches(t, '{regex}') THEN '{t.label}' END")
        scores.append(f"least(1.0, coalesce(list_max(list_transform(regexp_extract_all(t, '{regex}'), lambda m: length(m) - length(replace(m, ' ', '')) - 1)), 0) / {fixed}::DOUBLE)" + (" / 2" if t.base else ""))
    starts = []
    for t in BASE:
        words = t.markup.split()
        starts.append("list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words, 1)) + ")")
    own = "array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH d AS (SELECT doc_id, {_ALNUM.format("text")} w FROM documents), t AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' t, list_concat({", ".join(starts)}) s FROM d)
SELECT doc_id, len(w) n_words, len(s)::BIGINT n_base, list_min(s) first_word, list_max(s) last_word, {own.format(", ".join(labels[: len(BASE)]))} base_labels, {own.format(", ".join(labels))} labels,
  greatest({", ".join(scores)})::DOUBLE score FROM t"""


#: The operators without SQL are learnt, drawn or automata: tests hold those against plain versions.
ORACLES: dict[str, str] = {
    "op1_line_dedup": _LINES,
    "op2_license_scans": _licenses_sql(),
    "op4_benchmark_decontamination": _DECONTAMINATION,
    "op5_ngram_jaccard_join": _JOIN,
    "op9_sharding": _SHARDING,
}
