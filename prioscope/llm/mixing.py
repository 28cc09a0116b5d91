"""Mixing sources to target weights by balanced sampling (the cube method of Deville and Tille, 2004).

A document is taken `target / size of its source` times. The whole part is
certain; the fractional parts are inclusion probabilities. The flight moves the
probabilities of three documents at a time along the null space of the two
balance constraints (documents, words) until one of them is 0 or 1, and goes on
with the next document, so both totals stay put. It runs in chunks of each
source; the at most two fractional documents a chunk leaves fly again together
with those of other chunks, until one chunk per source is left. There a few dozen
units of all sizes wait while the others fly; they and what the flight leaves land
on the combination that is nearest to their expected words, then documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import written
from .common import column, packed, unpacked

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
# Units that one flight holds in memory.
CHUNK = 4096
# Units that wait for the landing.
RESERVE = 21
_EPS = 1e-9


def word_count(text: str = "text") -> Column:
    """Number of maximal runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(column(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most_copies: float = MOST_COPIES) -> DataFrame:
    """source, source_size, units, target: words to take from each source.

    `sized` has source and size. Sources by code point, null last, take the
    weights in turn and share `share` of all words. Targets stop at
    `most_copies` times the source's size; the excess is reshared by weight until
    none is above: all others get weight times one level. Sources are
    aggregated first; only their table passes through one task.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sources.withColumns({
        "weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1),
        "cap": most_copies * F.col("source_size"),
    })
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    levels = ranked.withColumn("_all", share * F.sum("source_size").over(everything)).withColumn(
        "_level", (F.col("_all") - before) / left)
    open_ = F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.col("_level"))
    return levels.withColumn("_fill", F.max(open_).over(everything)).select(
        "source", "source_size", "units",
        F.least("cap", F.coalesce(F.col("_fill") * F.col("weight"), "cap")).alias("target"))


def plan_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 23,
             chunk: int = CHUNK, **weighing) -> DataFrame:
    """One row per different (key, source, size): key, source, size, rows, source_size, target, copies.

    `rows` is how many rows of `docs` share the three values, `copies` how often
    they are taken together. Null keys, texts (size 0) and sources are values like
    others. Draws depend on seed, key and size alone: reruns agree, whatever the
    partitions. An empty table gives an empty plan.
    """
    sized = docs.select(column(key).alias("key"), column(source).alias("source"), word_count(text).alias("size"))
    units = written(sized.groupBy("key", "source", "size").agg(F.count("*").alias("rows")), "units")
    weighted = units.select("source", (F.col("size") * F.col("rows")).alias("size"))
    targets = written(source_targets(weighted, **weighing), "targets")
    most = targets.agg(F.max("units")).first()[0] or 0
    units = units.alias("u").join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source"))).select(
        "u.key", "u.source", "u.size", "u.rows", "t.source_size", "t.target", "t.units")
    wanted = F.coalesce(F.try_divide(F.col("rows") * F.col("target"), F.col("source_size")), F.lit(0.0))
    flying = units.withColumn("_wanted", wanted).withColumns({
        "copies": F.floor(F.col("_wanted") + _EPS).cast("bigint"),
        "chunks": F.ceil(F.col("units") / chunk).cast("bigint"),
        "order": F.xxhash64(F.lit(seed), F.col("key"), F.col("size"), F.col("source")),
    }).withColumn("p", F.greatest(F.lit(0.0), F.col("_wanted") - F.col("copies"))).drop("_wanted", "units")
    decided = []
    while True:
        last = most <= chunk
        level = written(_fly(flying, seed + len(decided), last), "flight")
        decided.append(level.where("p = 0"))
        if last:
            break
        most = 2 * -(-most // chunk)
        flying = level.where("p > 0").withColumn("chunks", F.ceil(2 * F.col("chunks") / chunk).cast("bigint"))
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "rows", "source_size", "target", "copies")


def _fly(units: DataFrame, seed: int, land: bool) -> DataFrame:
    """One flight per source and chunk: p is 0 for all units that are decided."""
    dealt = units.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), F.col("order")), F.col("chunks")))

    def fly(table: pa.Table) -> pa.Table:
        # Large documents first: those that are left to land are small.
        order = np.lexsort((table["order"].to_numpy(), -table["size"].to_numpy()))
        table = table.take(pa.array(order))
        p, added = cube(table["p"].to_numpy().copy(), table["size"].to_numpy().astype(float), seed, land)
        copies = table["copies"].to_numpy() + added
        at = table.schema.get_field_index
        return (table.set_column(at("p"), "p", pa.array(p)).set_column(at("copies"), "copies", pa.array(copies))
                .drop_columns(["chunk"]))

    return dealt.groupBy("source", "chunk").applyInArrow(fly, dealt.drop("chunk").schema)


def cube(p: np.ndarray, size: np.ndarray, seed: int, land: bool) -> tuple[np.ndarray, np.ndarray]:
    """What is left of the probabilities, and 1 for each unit that was taken.

    Of the probabilities returned at most two are not 0 (three if their sizes
    admit no move); none with `land`.
    """
    draw = np.random.default_rng(seed + len(p))
    taken = np.zeros(len(p), np.int64)
    waiting = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    taken[p >= 1 - _EPS] = 1
    p[(p <= _EPS) | (p >= 1 - _EPS)] = 0
    reserve: list[int] = []
    if land:
        # Evenly through the units as they come, so that all sizes are among them.
        reserve = [waiting[i] for i in np.unique(np.linspace(0, len(waiting) - 1, RESERVE).astype(int))] if waiting else []
        held = set(reserve)
        waiting = [i for i in waiting if i not in held]
    waiting.reverse()
    prob, sizes, chance = p.tolist(), size.tolist(), iter(draw.random(len(waiting)).tolist())
    active: list[int] = []
    while True:
        while waiting and len(active) < 3:
            active.append(waiting.pop())
        move = _null_space([sizes[i] for i in active])
        if move is None:
            break
        up = down = float("inf")
        for i, u in zip(active, move):
            if u > 0:
                up, down = min(up, (1 - prob[i]) / u), min(down, prob[i] / u)
            elif u < 0:
                up, down = min(up, -prob[i] / u), min(down, (prob[i] - 1) / u)
        step = up if next(chance) * (up + down) < down else -down
        still = []
        for i, u in zip(active, move):
            prob[i] += step * u
            if prob[i] <= _EPS:
                prob[i] = 0.0
            elif prob[i] >= 1 - _EPS:
                prob[i], taken[i] = 0.0, 1
            else:
                still.append(i)
        active = still
    if land:
        last = active + reserve
        for i, picked in zip(last, _landed([prob[i] for i in last], [sizes[i] for i in last])):
            taken[i], prob[i] = picked, 0.0
    return np.array(prob, float), taken


def _landed(prob: list[float], size: list[float]) -> list[int]:
    """1 for each unit of the combination nearest to the expected words; half a word counts like a document.

    Sums of either half of the units are listed, and each of one half meets those
    of the other that are next to what it lacks.
    """
    p, size = np.array(prob), np.array(size)
    words, number = float(p @ size), float(p.sum())
    half = len(p) // 2

    def sums(at: slice) -> tuple[np.ndarray, np.ndarray]:
        picks = (np.arange(1 << len(p[at]))[:, None] >> np.arange(len(p[at]))) & 1
        return picks, np.stack([picks @ size[at], picks.sum(axis=1)], axis=1)

    (left, of_left), (right, of_right) = sums(slice(0, half)), sums(slice(half, len(p)))
    order = np.lexsort((of_right[:, 1], of_right[:, 0]))
    at = np.searchsorted(of_right[order, 0], words - of_left[:, 0])
    near = np.clip(at[:, None] + np.arange(-4, 4), 0, len(order) - 1)
    total = of_left[:, None, :] + of_right[order[near]]
    cost = np.abs(total[..., 0] - words) + 0.5 * np.abs(total[..., 1] - number)
    i, j = np.unravel_index(cost.argmin(), cost.shape)
    return np.concatenate([left[i], right[order[near[i, j]]]]).tolist()


def _null_space(sizes: list[float]) -> tuple[float, ...] | None:
    """A move that changes neither the number of documents nor of words."""
    if len(sizes) == 3:
        a, b, c = sizes
        if a == b:
            return (1.0, -1.0, 0.0)
        scale = max(abs(c - b), abs(a - c), abs(b - a))
        return ((c - b) / scale, (a - c) / scale, (b - a) / scale)
    if len(sizes) == 2 and sizes[0] == sizes[1]:
        return (1.0, -1.0)
    return None


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 23,
        **options) -> DataFrame:
    """The rows of `docs`, each as often as the plan takes it; columns as they were.

    Rows that share key, source and size divide their copies exactly: each gets
    the whole part, and as many as copies remain, the first by a hash of the row,
    get one more. Reruns agree, whatever the partitions.
    """
    plan = plan_mix(docs, key, text, source, seed, **options).select(
        F.col(key).alias("k"), F.col(source).alias("s"), F.col("size").alias("n"), "rows", "copies").where("copies > 0")
    rows = docs.select(packed(docs), column(key).alias("key"), column(source).alias("source"), word_count(text).alias("size"))
    same = F.col("key").eqNullSafe(F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n"))
    times = F.floor(F.col("copies") / F.col("rows")).alias("times")
    uneven = plan.where("copies % rows > 0")
    each = rows.join(plan.where("copies % rows = 0"), same).select("row", times)
    if not uneven.isEmpty():
        divided = _divided(rows.join(uneven, same), seed)
        each = each.unionByName(divided.select("row", (times + F.col("extra")).alias("times"))).where("times > 0")
    return each.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select(
        *unpacked(docs.columns, []))


def _divided(joined: DataFrame, seed: int) -> DataFrame:
    """Adds extra: 1 for the first copies % rows rows of each group (k, s, n) by row hash, else 0.

    Counts per group and range of hashes give every range its place; only rows of
    the one range of a group in which the copies run out are numbered.
    """
    group = ["k", "s", "n"]
    marked = written(joined.withColumn("text_row", F.to_json("row")).withColumn(
        "hash", F.xxhash64(F.lit(seed), F.col("text_row"))).withColumn("part", F.shiftrightunsigned("hash", 52)), "uneven")
    counts = marked.groupBy(*group, "part").agg(F.count("*").alias("here"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0))).alias("o")
    placed = marked.alias("m").join(offsets, F.col("m.k").eqNullSafe(F.col("o.k")) & F.col("m.s").eqNullSafe(F.col("o.s"))
                                    & (F.col("m.n") == F.col("o.n")) & (F.col("m.part") == F.col("o.part"))).select(
        "m.*", "o.here", (F.col("copies") % F.col("rows") - F.col("o.before")).alias("left"))
    runs_out = (F.col("left") > 0) & (F.col("left") < F.col("here"))
    nth = F.row_number().over(Window.partitionBy(*group, "part").orderBy("hash", "text_row"))
    numbered = placed.where(runs_out).withColumn("extra", (nth <= F.col("left")).cast("bigint"))
    return placed.where(~runs_out).withColumn("extra", (F.col("left") >= F.col("here")).cast("bigint")).unionByName(numbered)
