"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming distance.

Search follows the generalised pigeonhole principle (Qin et al., 2018). Bits are
grouped into parts so that correlated ones share a part. If two fingerprints
differ in at most t bits, then for any thresholds with sum(threshold + 1) =
t + 1 they agree within its threshold on some part (-1: part not probed). Each
fingerprint gets the thresholds with the fewest probes and candidates, by dynamic
programming over estimated counts, looks up all values of each part within
its threshold, and verifies what it finds.

Parts whose value more than `BUCKET` fingerprints share are not compared member by
member: their members, and those whose probes lead there, meet at the values one
bit (in general half the distance) away from each, where two fingerprints meet exactly
if they are linked. That takes as many rows as there are bits, however many share a value.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import written
from .common import column, connected_components, packed, unpacked
from .words import spaced_words

BITS = 64
SHINGLE = 3
DISTANCE = 2
SEED = 42
BUCKET = 64
# Bins of the histogram that estimates candidate counts, per part.
BINS = 1 << 16
_MIX = 0x9E3779B97F4A7C15
_LANES = np.uint64(0x0101010101010101)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """key and fingerprint (bigint) of every row; the key column keeps its type.

    Words are runs of characters other than ASCII white space, A-Z in lower case. A
    bit is 1 if set in over half of the XXH64 hashes of the shingles, repeats
    counted. Fewer words than a shingle: the whole sequence is one; null or no
    words: fingerprint 0.
    """
    rows = docs.select(column(key).alias("key"), column(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = [], []
            out, held = [], 0
            for value in batch.column(1).cast(pa.binary()):
                found = shingle_hashes(value.as_py() or b"", shingle, seed)
                hashes.append(found)
                sizes.append(len(found))
                held += len(found)
                if held > 1 << 20:
                    out.append(majority(hashes, sizes))
                    hashes, sizes, held = [], [], 0
            out.append(majority(hashes, sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).view(np.int64))],
                                             names=["key", "fingerprint"])

    return rows.mapInArrow(compute, f"key {kind}, fingerprint bigint")


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    words = spaced_words(text.lower())
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)] if words else [], np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b - 1], seed) for a, b in zip(starts, ends[shingle - 1:])], np.uint64)


def majority(hashes: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """A fingerprint per group of hashes. Eight bits of a hash are counted at a time, one to a byte, 255 hashes deep."""
    out = np.zeros(len(sizes), np.uint64)
    filled = [i for i, n in enumerate(sizes) if n]
    if not filled:
        return out
    everything = np.concatenate([hashes[i] for i in filled])
    number = np.array([sizes[i] for i in filled], np.int64)
    begins = np.cumsum(number) - number
    pieces = -(-number // 255)
    first = np.cumsum(pieces) - pieces
    inside = np.arange(pieces.sum()) - np.repeat(first, pieces)
    cuts = np.repeat(begins, pieces) + inside * 255
    result = np.zeros(len(filled), np.uint64)
    for bit in range(8):
        sums = np.add.reduceat((everything >> np.uint64(bit)) & _LANES, cuts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for lane in range(8):
            result |= (counts[:, lane] * 2 > number).astype(np.uint64) << np.uint64(8 * lane + bit)
    out[filled] = result
    return out


def bit_parts(prints: DataFrame, n: int, distance: int = DISTANCE) -> list[list[int]]:
    """Bits of each part: correlated ones together, as many parts as make probes and candidates fewest for n fingerprints."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                both += bits[at:at + (1 << 16)].T @ bits[at:at + (1 << 16)]
            rows += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), rows))],
                                         names=["at", "n"])

    sums = dict(prints.select("fingerprint").mapInArrow(pairs, "at bigint, n double").groupBy("at").agg(F.sum("n")).collect())
    both = np.array([sums.get(i, 0.0) for i in range(BITS * BITS)]).reshape(BITS, BITS) / max(1.0, sums.get(BITS * BITS, 0.0))
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    related = np.abs(both - np.outer(mean, mean)) / np.outer(spread, spread)
    number = min(range(1, distance + 2), key=lambda m: _uniform_cost(n, m, distance))
    free, parts = set(range(BITS)), []
    for part in range(number):
        width = -(-len(free) // (number - part))
        inside = [max(sorted(free), key=lambda b: related[b, sorted(free)].sum())]
        free.discard(inside[0])
        while len(inside) < width:
            inside.append(max(sorted(free), key=lambda b: related[b, inside].sum()))
            free.discard(inside[-1])
        parts.append(sorted(inside))
    return parts


def _uniform_cost(n: int, parts: int, distance: int) -> float:
    """Probes and candidates of a fingerprint if all values were equally likely and thresholds as equal as can be."""
    width, total = BITS / parts, distance + 1
    cost = 0.0
    for part in range(parts):
        threshold = total // parts + (part < total % parts) - 1
        ball = sum(float(np.prod([(width - k) / (k + 1) for k in range(t)])) for t in range(threshold + 1))
        cost += ball * (1 + n / 2.0 ** width)
    return cost


class Prober:
    """Values of parts to look up for each fingerprint."""

    def __init__(self, parts: list[list[int]], distance: int, histogram: np.ndarray):
        self.parts, self.distance, self.histogram = parts, distance, histogram
        self.masks = [np.uint64(sum(1 << b for b in part)) for part in parts]
        # Flips of a part, by number of flipped bits.
        self.flips = [[np.array([sum(1 << b for b in pick) for pick in itertools.combinations(part, t)], np.uint64)
                       for t in range(distance + 1)] for part in parts]

    def thresholds(self, prints: np.ndarray) -> np.ndarray:
        """Per fingerprint and part the allowed difference, -1 for none: fewest probes and estimated candidates."""
        total = self.distance + 1
        best = np.full((total + 1, len(prints)), np.inf)
        best[0] = 0
        picks = []
        for part, mask in enumerate(self.masks):
            cost, costs = np.zeros(len(prints)), [np.zeros(len(prints))]
            for flips in self.flips[part]:
                for flip in flips:
                    cost = cost + 1 + self.histogram[part][bin_of((prints & mask) ^ flip)]
                costs.append(cost)
            options = np.full((total + 1, total + 1, len(prints)), np.inf)
            for used in range(total + 1):
                for here in range(used + 1):
                    options[used, here] = best[used - here] + costs[here]
            picks.append(np.argmin(options, axis=1))
            best = np.min(options, axis=1)
        out = np.empty((len(prints), len(self.parts)), np.int64)
        left, rows = np.full(len(prints), total), np.arange(len(prints))
        for part in reversed(range(len(self.parts))):
            spent = picks[part][left, rows]
            out[:, part] = spent - 1
            left = left - spent
        return out

    def probes(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        allowed = self.thresholds(prints)
        who, where, what = [], [], []
        for part, mask in enumerate(self.masks):
            for t, flips in enumerate(self.flips[part]):
                rows = np.flatnonzero(allowed[:, part] >= t)
                values = (prints[rows] & mask)[:, None] ^ flips[None, :]
                who.append(np.repeat(prints[rows], len(flips)))
                where.append(np.full(values.size, part, np.int32))
                what.append(values.ravel())
        return np.concatenate(who), np.concatenate(where), np.concatenate(what)


def bin_of(values: np.ndarray) -> np.ndarray:
    return (values * np.uint64(_MIX)) >> np.uint64(BITS - (BINS - 1).bit_length())


def near_links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect all fingerprints within `distance` bits, from a table of different fingerprints.

    Every row is a link within the distance; fingerprints that share a crowded
    part are linked through the smallest one that meets them, so rows grow with
    fingerprints, not with their pairs.
    """
    parts = bit_parts(prints, prints.count(), distance)
    values = [(sum(1 << b for b in part) + 2**63) % 2**64 - 2**63 for part in parts]
    index = prints.select("fingerprint", F.posexplode(F.array(*[
        F.col("fingerprint").bitwiseAND(F.lit(mask).cast("bigint")) for mask in values])).alias("part", "value"))
    sizes = written(index.groupBy("part", "value").agg(F.count("*").alias("n")), "bucket-sizes")

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = bin_of(batch.column(1).to_numpy().view(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), batch.column(2)], names=["part", "bin", "n"])

    # At most bins x parts rows, whatever the data.
    histogram = np.zeros((len(parts), BINS))
    for r in sizes.mapInArrow(binned, "part int, bin bigint, n bigint").groupBy("part", "bin").agg(F.sum("n").alias("n")).toLocalIterator():
        histogram[r["part"], r["bin"]] = r["n"]
    prober = prints.sparkSession.sparkContext.broadcast(Prober(parts, distance, histogram))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                who, where, what = prober.value.probes(batch.column(0).slice(at, 4096).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who.view(np.int64)), pa.array(where), pa.array(what.view(np.int64))],
                    names=["fingerprint", "part", "value"])

    probes = written(prints.select("fingerprint").mapInArrow(probe, "fingerprint bigint, part int, value bigint"), "probes")
    small = sizes.where(F.col("n") <= bucket).select("part", "value")
    crowded = sizes.where(F.col("n") > bucket).select("part", "value")
    members = index.join(small, ["part", "value"]).groupBy("part", "value").agg(F.collect_list("fingerprint").alias("members"))
    differing = lambda f: F.bit_count(f.bitwiseXOR(F.col("fingerprint")))
    verified = probes.join(members, ["part", "value"]).select("fingerprint", F.filter(
        "members", lambda f: (f != F.col("fingerprint")) & (differing(f) <= distance)).alias("near"))
    direct = verified.where(F.size("near") > 0).select(F.col("fingerprint").alias("u"), F.explode("near").alias("v"))
    return direct.unionByName(_crowded_links(index.join(crowded, ["part", "value"]).select("fingerprint").unionByName(
        probes.join(crowded, ["part", "value"]).select("fingerprint")).distinct(), distance))


def _crowded_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links between fingerprints that meet at a value: the balls of half the distance around two touch if they are linked."""
    near, far = distance // 2, distance - distance // 2
    flips = [sum(1 << b for b in pick) for t in range(far + 1) for pick in itertools.combinations(range(BITS), t)]
    signed = F.array(*[F.lit((f + 2**63) % 2**64 - 2**63).cast("bigint") for f in flips])
    within = sum(1 for f in flips if bin(f).count("1") <= near)
    met = written(prints.select("fingerprint", F.posexplode(signed).alias("at", "flip")).select(
        "fingerprint", (F.col("at") < within).alias("near"), F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("value")), "met")
    heads = met.where("near").groupBy("value").agg(F.min("fingerprint").alias("head"), F.count("*").alias("n"))
    if near == far:
        heads = heads.where(F.col("n") > 1)
    return met.join(heads.select("value", "head"), "value").where(F.col("fingerprint") != F.col("head")).select(
        F.col("fingerprint").alias("u"), F.col("head").alias("v"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """key, fingerprint (bigint) and component_id of every row.

    component_id is the smallest key among all documents reachable over links,
    null if all of them are null. Copies share a fingerprint and are compared
    once. Repeated keys are documents of their own. An empty table gives none.
    """
    marked = written(fingerprints(docs, key, text, shingle), "fingerprints")
    owners = _components(marked, distance, bucket)
    firsts = marked.groupBy("fingerprint").agg(F.min("key").alias("first")).join(owners, "fingerprint").groupBy("component").agg(
        F.min("first").alias("component_id"))
    ids = owners.join(firsts, "component").select("fingerprint", "component_id")
    return marked.join(ids, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")


def _components(marked: DataFrame, distance: int, bucket: int) -> DataFrame:
    """fingerprint and component (the smallest fingerprint reachable) of every different fingerprint."""
    prints = written(marked.select("fingerprint").distinct(), "distinct-fingerprints")
    links = written(near_links(prints, distance, bucket), "near-links")
    parts = written(connected_components(links), "components")
    return prints.join(parts.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """The rows of `docs` without near-duplicates: one of each component of linked fingerprints.

    That is the row with the smallest key (null last), then the smallest fingerprint,
    then the smallest hash of the row. Rows that repeat a key are documents like
    others: those of other components stay. Columns stay as they are.
    """
    rows = docs.select(column(key).alias("key"), column(text).alias("text"), packed(docs))
    hashed = rows.withColumn("mark", F.xxhash64(F.to_json("row")))
    # The fingerprints carry key and row hash, not the row.
    names = F.struct(F.col("key").isNull().alias("last"), F.col("key").alias("key"), F.col("mark").alias("mark"))
    marked = written(fingerprints(hashed.select(names.alias("name"), "text"), "name", "text", shingle).withColumnRenamed("key", "name"), "fingerprints")
    owners = _components(marked, distance, bucket)
    kept = marked.groupBy("fingerprint").agg(F.min("name").alias("name")).join(owners, "fingerprint").groupBy("component").agg(
        F.min(F.struct("name.last", "name.key", "fingerprint", "name.mark")).alias("k")).select(
        F.col("k.key").alias("kept"), F.col("k.mark").alias("kept_mark"))
    chosen = hashed.join(kept, F.col("key").eqNullSafe(F.col("kept")) & (F.col("mark") == F.col("kept_mark")), "left_semi")
    # Rows that repeat a whole row are one document.
    return chosen.dropDuplicates(["key", "mark"]).select(*unpacked(docs.columns, []))
