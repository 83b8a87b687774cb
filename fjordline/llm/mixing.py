"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target number of words.  With r = target / size a document is
taken floor(r) times for certain and once more with probability r - floor(r).
Which documents are taken once more is drawn by the cube method (Deville and
Tille, 2004; Chauvet and Tille, 2006): the vector of inclusion probabilities moves
at random along the null-space of the two balancing constraints, words and
documents, until each probability is 0 or 1 but for at most two units and a
reserve of a dozen that waits.  Those few land on the choice nearest to both totals.

The flight runs over blocks of about BLOCK units; what is left of a block flies
on with what is left of FAN other blocks, level by level, and only the last level
lands, so that no task holds a whole source.  Within a block large units fly
first, and the reserve is spread over the sizes, so that the landing comes near.  A
source of one block lands at once and may exchange a few pairs of documents.

Defined results: a null source is a source of its own, last in order; a null or
empty text has size 0 and is taken 0 words; rows of equal id, source and text are
one unit and decided alike; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fjordline.llm.spark import BROADCAST_ROWS, Table, attach

BLOCK, FAN = 4096, 512
WEIGHTS = (5, 2, 1)
_STATE = "s string, b long, idx int, uid long, crc long, size long, m long, p double"
_STATE_NAMES = ["s", "b", "idx", "uid", "crc", "size", "m", "p"]


def word_count(column):
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (s, source_size, units) with weight and target: the weights' part of share x all sizes, filled up like
    water below most x the source's size.  s is '=' and the source's name, or '~' for null, which sorts last by first byte."""
    ranked = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy("s")) - 1, F.lit(len(weights))) + 1).cast("int")))
    every = Window.partitionBy(F.lit(0))
    by_room = Window.orderBy(F.col("source_size") / F.col("w"), "s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({"total": F.sum("source_size").over(every), "w_all": F.sum("w").over(every), "full": F.coalesce(F.sum("source_size").over(by_room), F.lit(0)), "w_full": F.coalesce(F.sum("w").over(by_room), F.lit(0.0))})
    level = (share * F.col("total") - most * F.col("full")) / (F.col("w_all") - F.col("w_full"))
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= most * F.col("source_size"))
    # The first source, by room for each weight, that the level doesn't fill fixes the level for all after it.
    ranked = ranked.withColumn("level", F.min_by("level", F.when(F.col("open"), F.col("source_size") / F.col("w"))).over(every))
    return ranked.select("s", "source_size", "units", F.least(most * F.col("source_size").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"))


def flight(x: np.ndarray, c: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves p within the null-space of (x, c) until at most two units (or units that no step can move) are open."""
    p = p.copy()
    x, c = x.tolist(), c.tolist()
    queue = [i for i in range(len(x)) if 0.0 < p[i] < 1.0]
    draws = rng.random(len(queue) + 1).tolist()
    at, hold, q = 0, [], p.tolist()
    for draw in draws:
        while len(hold) < 3 and at < len(queue):
            hold.append(queue[at])
            at += 1
        if len(hold) < 3:
            break
        i, j, k = hold
        u = [x[j] * c[k] - x[k] * c[j], x[k] * c[i] - x[i] * c[k], x[i] * c[j] - x[j] * c[i]]
        if not any(u):
            u = [c[j], -c[i], 0]
        scale = max(map(abs, u))
        u = [v / scale for v in u]
        up = min(((1.0 - q[n]) / v if v > 0 else q[n] / -v) for n, v in zip(hold, u, strict=True) if v)
        down = min((q[n] / v if v > 0 else (1.0 - q[n]) / -v) for n, v in zip(hold, u, strict=True) if v)
        step = up if draw * (up + down) < down else -down
        for n, v in zip(hold, u, strict=True):
            y = q[n] + step * v
            q[n] = 0.0 if y < 1e-9 else 1.0 if y > 1.0 - 1e-9 else y
        hold = [n for n in hold if 0.0 < q[n] < 1.0]
    return np.array(q)


def reserve(x: np.ndarray, p: np.ndarray, most: int = 12) -> np.ndarray:
    """Up to `most` of the open units, spread over their sizes, that wait for the landing."""
    is_open = np.flatnonzero((p > 0) & (p < 1))
    is_open = is_open[np.argsort(-x[is_open], kind="stable")]
    n = min(most, -(-len(is_open) // 4))
    return is_open[np.unique(np.linspace(0, len(is_open) - 1, n).astype(int))] if n else is_open[:0]


def fly(x: np.ndarray, c: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """flight() of all but the reserve."""
    wait = np.zeros(len(p), bool)
    wait[reserve(x, p)] = True
    p = p.copy()
    p[~wait] = flight(x[~wait], c[~wait], p[~wait], rng)
    return p


def land(x: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rounds the few open units (the reserve and what flight leaves) to the choice, of all, nearest to the words and documents expected of them."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    for n in left[16:]:
        p[n] = np.round(p[n])
    left = left[:16]
    if len(left):
        take = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
        off = np.abs(take @ x[left] - x[left] @ p[left]) + 0.02 * x[left].mean() * np.abs(take @ c[left] - c[left] @ p[left])
        p[left] = take[np.argmin(np.round(off, 6))]
    return p


def repair(x: np.ndarray, was: np.ndarray, p: np.ndarray, tries: int = 16) -> np.ndarray:
    """Exchanges taken and untaken units, one pair at a time, as long as the words come nearer to those expected.  A source
    with one huge document may need it: no landing of small ones makes up for that."""
    p = p.copy()
    moves = (was > 0) & (was < 1)
    for _ in range(tries):
        off = float(p @ x - was @ x)
        ins, outs = np.flatnonzero(moves & (p == 0)), np.flatnonzero(moves & (p == 1))
        if abs(off) < 1 or not len(ins) or not len(outs):
            break
        ins = ins[np.argsort(x[ins], kind="stable")]
        want = x[outs] - off  # what should come in for each that goes out
        at = np.clip(np.searchsorted(x[ins], want), 1, len(ins) - 1) if len(ins) > 1 else np.zeros(len(outs), np.int64)
        at = np.where((at > 0) & (np.abs(x[ins[at - 1]] - want) <= np.abs(x[ins[at]] - want)), at - 1, at)
        left = np.abs(x[ins[at]] - want)
        best = int(left.argmin())
        if left[best] >= abs(off) - 0.5:
            break
        p[outs[best]], p[ins[at[best]]] = 0.0, 1.0
    return p


def _block(seed: int, last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        alone = len(key) > 2 and key[2].as_py()  # the block is the whole source
        frame = table.to_pandas().sort_values(["size", "uid", "crc", "b", "idx"], ascending=[False, True, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
        x, c = (frame["size"] * frame["m"]).to_numpy(float), frame["m"].to_numpy(float)
        was = frame["p"].to_numpy(float)
        p = fly(x, c, was, np.random.default_rng(zlib.crc32(f"{seed}|{key[0].as_py()}|{key[1].as_py()}|{last}".encode())))
        frame["p"] = repair(x, was, land(x, c, p)) if alone else land(x, c, p) if last else p
        if (frame["idx"] < 0).all():
            frame["idx"] = np.arange(len(frame), dtype=np.int32)
        return pa.Table.from_pandas(frame[_STATE_NAMES], schema=pa.schema([table.schema.field(n) for n in _STATE_NAMES]), preserve_index=False)

    return run


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 2024, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row per document: the id, _fj_crc (of its text), size, source_size, target, copies, taken."""
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~"))
    rows = docs.select(F.col(id_col).alias("id"), name.alias("s"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"), word_count(F.col(text_col)).alias("size"))
    rows = Table(rows.withColumn("uid", F.xxhash64(F.lit(seed), "id", "crc")))  # ids of any type, null or not
    units = rows.df.groupBy("s", "uid", "crc", "size").agg(F.count("*").alias("m"))
    sources = Table(targets(rows.df.groupBy("s").agg(F.sum("size").alias("source_size"), F.count("*").alias("units")), share, most, weights))
    n_sources = sources.df.count()
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    drawn = attach(units, sources.df, "s", rows=n_sources).withColumn("p", ratio - F.floor(ratio + 1e-12))
    drawn = drawn.withColumn("p", F.when(F.col("p") < 1e-12, 0.0).otherwise(F.col("p")))
    drawn = drawn.withColumn("b", F.pmod(F.xxhash64("uid"), F.ceil(F.col("units") / block)))
    state = Table(drawn.select("s", "b", F.lit(-1).alias("idx"), "uid", "crc", "size", "m", "p", (F.col("units") <= block).alias("alone")).groupBy("s", "b", "alone").applyInArrow(_block(seed, False), _STATE))
    most_blocks = (sources.df.agg(F.max(F.ceil(F.col("units") / block))).first()[0]) or 1
    settled, width, tables = [], 1, []
    flying = state.df.where("p > 0 and p < 1")
    while True:
        width *= fan
        last = width >= most_blocks
        level = Table(flying.groupBy("s", F.expr(f"b div {width}L")).applyInArrow(_block(seed, last), _STATE))
        tables.append(level)
        settled.append(level.df.where("p <= 0 or p >= 1"))
        flying = level.df.where("p > 0 and p < 1")
        if last:
            break
    done = settled[0]
    for other in settled[1:]:
        done = done.unionAll(other)
    done = done.select("s", "b", "idx", F.col("p").alias("q"))
    chosen = attach(state.df, done, ["s", "b", "idx"], "left").withColumn("p", F.coalesce("q", "p")).drop("q", "b", "idx", "m")
    chosen = attach(chosen, sources.df, "s", rows=n_sources).withColumn("copies", (F.floor(ratio + 1e-12) + F.col("p")).cast("long"))
    chosen = chosen.select("s", "uid", "crc", "size", "source_size", "target", "copies")
    same = (rows.df["s"] == chosen["s"]) & (rows.df["uid"] == chosen["uid"]) & (rows.df["crc"] == chosen["crc"]) & (rows.df["size"] == chosen["size"])
    small = chosen.count() <= BROADCAST_ROWS
    out = rows.df.join(F.broadcast(chosen) if small else chosen, same)
    return out.select(rows.df["id"].alias(id_col), rows.df["s"].alias("_fj_s"), rows.df["crc"].alias("_fj_crc"), rows.df["size"], "source_size", "target", "copies", (F.col("copies") * rows.df["size"]).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture: each row of docs as often as plan() takes it; documents without words are never taken.  Same columns as docs."""
    chosen = plan(docs, id_col, text_col, source_col, **options).where("taken > 0")
    chosen = chosen.groupBy(id_col, "_fj_s", "_fj_crc").agg(F.max("copies").alias("_fj_copies")).withColumnsRenamed({id_col: "_fj_id", "_fj_s": "_fj_t", "_fj_crc": "_fj_sum"})
    name = F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit("~"))
    same = docs[id_col].eqNullSafe(F.col("_fj_id")) & (name == F.col("_fj_t")) & (F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary")) == F.col("_fj_sum"))
    rows = chosen.count()
    taken = docs.join(F.broadcast(chosen) if rows <= BROADCAST_ROWS else chosen, same)
    return taken.withColumn("_fj_n", F.explode(F.sequence(F.lit(1), F.col("_fj_copies").cast("int")))).select(*[docs[c] for c in docs.columns])
