"""Substring dedup: passages that recur across documents are found by word automata and cut.

1. Confirm: hashes of all windows, packed per batch of documents, meet in buckets
   of bounded size, which name the recurring ones, the smallest document of each,
   and which documents share windows with it.
2. Compile: runs of recurring windows of that smallest document are its passages.
   Passages are dealt to shards by document; each is cut into tiles of half a
   window, which become the patterns of the shard's Aho-Corasick automaton.
3. Stream: every document passes through the automata of the shards whose passages
   it may hold. Any window inside a passage holds a whole tile, so each
   occurrence is hit; the windows around a hit are compared word by word with those
   of the passages, and equal ones removed.

Hashes choose what is compared, so nothing is removed without equal words. Two
different windows with one 64-bit hash count as one in step 1, which may lose the
removal of the one in the larger document: for 5e9 windows (30 GB) the chance is
about 5e9 / 2^64 = 3e-10 a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.tables import written
from .common import column
from .words import spaced_words

WINDOW = 13
# Text bytes whose windows meet in one bucket, windows per shard, and routed text bytes per streaming task.
BUCKET_BYTES = 24 << 20
LEAST_BUCKETS = 16
# Beyond so many, tasks take several buckets, one after the other.
MOST_TASKS = 1 << 16
SHARD_WINDOWS = 20_000
STREAM_BYTES = 1 << 20
# Documents of a batch; windows that more of them share send one posting for all, and their documents are joined apart.
BATCH = 8192
CROWD = 64
# Bits of the filter that picks documents to stream: a fixed size, whatever the data.
FILTER_BITS = 26
_VALUE_BITS = 64
_MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPANS = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def window_values(words: list[bytes], window: int, hashes: dict) -> np.ndarray:
    """A 64-bit hash of each window."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for j in range(window):
        out += each[j:n + j] * _MULTIPLIERS[j % 64]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(29)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, n_words, n_removed, spans and kept_sha256 for every row of `docs`; key is an integer column.

    `spans` are the runs of words (from, to: zero-based, end excluded) covered by
    windows of `window` words that also start in a document with a smaller key;
    kept_sha256 is that of the other words, joined by one space. Null and empty
    texts have no words; texts shorter than a window keep all. Rows with equal keys
    never count against each other; rows with a null key are left whole. An empty
    table gives no rows.
    """
    rows = docs.select(column(key).cast("bigint").alias("key"), column(text).alias("text"))
    size, number = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    size = size or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    found = written(_confirmed(rows, window, buckets), "recurring-windows")
    pairs = found.where("kind = 1").select(F.col("a").alias("e"), F.col("b").alias("d"))
    # A crowded window of a batch meets the others through the first document of the batch that has it: its documents go where that one goes.
    crowd = found.where("kind = 3").select(F.col("a").alias("e"), F.col("b").alias("m")).distinct()
    pairs = pairs.unionByName(crowd.select("e", F.col("m").alias("d"))).unionByName(
        crowd.join(pairs.distinct().withColumnRenamed("e", "m"), "m").select("e", "d"))
    windows = found.where("kind = 2").agg(F.sum(F.size("values"))).first()[0] or 0
    shards = max(1, -(-windows // SHARD_WINDOWS))
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards))
    routes = written(pairs.select("e", shard("d").alias("shard")).distinct(), "routes")
    mean = max(1.0, size / max(1, number))
    tasks = written(routes.groupBy("shard").agg(
        F.ceil(F.count("*") * F.lit(mean) / STREAM_BYTES).alias("tasks")), "stream-tasks")
    passages = found.where("kind = 2").groupBy("a").agg(F.flatten(F.collect_list("values")).alias("values"))
    wanted = _key_filter(routes.select(F.col("e").alias("key")).unionByName(passages.select(F.col("a").alias("key"))))
    base = written(_measured(rows, wanted), "measured")
    candidates = base.where(F.col("text").isNotNull())
    patterns = _passages(candidates.join(passages.withColumnRenamed("a", "key"), "key"), window).withColumn(
        "shard", shard("key")).join(tasks, "shard").withColumn("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)))
    dealt = routes.join(tasks, "shard").groupBy("e").agg(F.collect_list(F.struct(
        "shard", F.pmod(F.xxhash64("e"), F.col("tasks")).alias("task"))).alias("to"))
    streams = candidates.select("key", "mark", "text").join(dealt, F.col("key") == F.col("e")).select(
        "key", "mark", "text", F.explode("to").alias("to")).select("key", "mark", "text", "to.shard", "to.task")
    spans = _streamed(patterns.select("shard", "task", "key", "words"), streams, window).groupBy("key", "mark").agg(
        F.flatten(F.collect_list("spans")).alias("spans"))
    cut = _cut(candidates.join(spans, ["key", "mark"], "left").select("key", "n_words", "text", "spans"))
    whole = base.where(F.col("text").isNull()).select(
        "key", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.array().cast(SPANS).alias("spans"), "kept_sha256")
    return whole.unionByName(cut).withColumnRenamed("key", key)


def _confirmed(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """Rows by kind: 1 document a shares windows first seen in b; 2 values of windows first seen in a; 3 document a
    shares a window with b, the first document of its batch that has it, which the batch is crowded with."""
    width = -(-(1 << _VALUE_BITS) // buckets)
    # Where the values of each bucket begin.
    edges = np.array([b * width for b in range(buckets)], np.uint64)
    blobs = ("low", "high", "at", "keys", "crowd")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                yield from _posted(batch.slice(at, BATCH), hashes)

    def _posted(batch: pa.RecordBatch, hashes: _WordHashes) -> Iterator[pa.RecordBatch]:
        keys = batch.column(0).to_numpy()
        found = []
        for i, value in enumerate(batch.column(1).cast(pa.binary())):
            values = window_values(spaced_words(value.as_py()), window, hashes)
            found.append(np.unique(values))
        values = np.concatenate(found) if found else np.empty(0, np.uint64)
        at = np.repeat(np.arange(len(found)), [len(f) for f in found])
        # Stable: within a value by document.
        order = np.argsort(values, kind="stable")
        values, at = values[order], at[order]
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
        runs = np.diff(np.append(starts, len(values)))
        crowded = np.repeat(runs > CROWD, runs)
        out: list[list] = [[] for _ in range(6)]

        def put(bucket: int, *parts: np.ndarray) -> None:
            for column_, x in zip(out, (bucket, *(p.tobytes() for p in parts))):
                column_.append(x)

        none = np.empty(0, np.int64)
        if crowded.any():
            # To a bucket that only passes them on, so that no bucket gathers a crowd.
            many = np.flatnonzero(runs > CROWD)
            least = np.array([a + int(np.argmin(keys[at[a:a + n]])) for a, n in zip(starts[many].tolist(), runs[many].tolist())])
            met = np.unique(at[crowded] << 16 | np.repeat(at[least], runs[many]))
            put(buckets + int(keys[0]) % buckets, keys[met & 0xFFFF], none, none, keys[met >> 16], none)
            stay = ~crowded
            stay[least] = True
            crowd_values = values[least]
            values, at = values[stay], at[stay]
        else:
            crowd_values = np.empty(0, np.uint64)
        cuts = np.append(np.searchsorted(values, edges), len(values))
        crowd_cuts = np.append(np.searchsorted(crowd_values, edges), len(crowd_values))
        for bucket in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[bucket], cuts[bucket + 1]
            local = values[a:b] - edges[bucket]
            here, place = np.unique(at[a:b], return_inverse=True)
            put(bucket, (local & np.uint64(0xFFFFFFFF)).astype(np.uint32), (local >> np.uint64(32)).astype(np.uint32), place.astype(np.uint16),
                keys[here], crowd_values[crowd_cuts[bucket]:crowd_cuts[bucket + 1]])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])],
                                         names=["bucket", *blobs])

    def meet(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        raw = {c: [x.as_py() for x in table[c]] for c in blobs}
        if bucket >= buckets:
            firsts = np.concatenate([np.frombuffer(x, np.int64) for x in raw["low"]])
            keys = np.concatenate([np.frombuffer(x, np.int64) for x in raw["keys"]])
            return _rows(3, keys[keys != firsts], firsts[keys != firsts])
        local = np.concatenate([np.frombuffer(x, np.uint32) for x in raw["low"]]).astype(np.int64)
        local |= np.concatenate([np.frombuffer(x, np.uint32) for x in raw["high"]]).astype(np.int64) << 32
        keys = np.concatenate([np.frombuffer(k, np.int64)[np.frombuffer(x, np.uint16)] for k, x in zip(raw["keys"], raw["at"])])
        crowd = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in raw["crowd"]]))
        order = np.argsort(local)
        local, keys = local[order], keys[order]
        starts = np.flatnonzero(np.append(True, local[1:] != local[:-1]))
        runs = np.diff(np.append(starts, len(local)))
        again = np.repeat(runs > 1, runs)
        # A crowded window recurs even if a single batch holds all of it.
        again |= np.isin(local.astype(np.uint64) + edges[bucket], crowd)
        local, keys = local[again], keys[again]
        order = np.lexsort((keys, local))
        local, keys = local[order], keys[order]
        if not len(local):
            return _rows(1, local, local)
        starts = np.flatnonzero(np.append(True, local[1:] != local[:-1]))
        runs = np.diff(np.append(starts, len(local)))
        firsts, values = keys[starts], local[starts].astype(np.uint64) + edges[bucket]
        recurs = (keys[starts + runs - 1] != firsts) | np.isin(values, crowd)
        first_of = np.repeat(firsts, runs)
        other = keys != first_of
        e, d = keys[other], first_of[other]
        order = np.lexsort((d, e))
        e, d = e[order], d[order]
        fresh = np.append(True, (e[1:] != e[:-1]) | (d[1:] != d[:-1])) if len(e) else np.empty(0, bool)
        firsts_r, values_r = firsts[recurs], values[recurs]
        order = np.argsort(firsts_r, kind="stable")
        firsts_r, values_r = firsts_r[order], values_r[order]
        heads = np.flatnonzero(np.append(True, firsts_r[1:] != firsts_r[:-1])) if len(firsts_r) else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(values_r)), pa.int32()), pa.array(values_r.view(np.int64)))
        own = pa.table({"kind": pa.array(np.full(len(heads), 2), pa.int32()), "a": pa.array(firsts_r[heads]),
                        "b": pa.nulls(len(heads), pa.int64()), "values": lists})
        return pa.concat_tables([_rows(1, e[fresh], d[fresh]), own])

    posted = rows.where(F.col("key").isNotNull() & F.col("text").isNotNull()).mapInArrow(
        post, "bucket bigint, " + ", ".join(f"{c} binary" for c in blobs))
    # As many tasks as buckets, whatever the session's partitions: adaptive execution would join them again.
    dealt = posted.repartition(min(2 * buckets, MOST_TASKS), "bucket")
    return dealt.groupBy("bucket").applyInArrow(meet, "kind int, a bigint, b bigint, values array<bigint>")


def _rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"kind": pa.array(np.full(len(a), kind), pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
                     "values": pa.nulls(len(a), pa.list_(pa.int64()))})


def _key_filter(keys: DataFrame) -> np.ndarray:
    """A bit per hashed key, 64 to a word: at most 2^20 words reach the driver, whatever the data."""
    spots = keys.select(F.shiftrightunsigned(F.xxhash64("key"), 64 - FILTER_BITS).alias("spot"))
    words = spots.select(F.shiftright("spot", 6).alias("word"), F.expr("shiftleft(1L, cast(spot & 63 as int))").alias("bit"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["word"]] = np.uint64(r["bits"] % 2**64)
    return out


def _measured(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """key, n_words, kept_sha256 of all words, and the text (packed) with a hash of it where the filter wants the key."""
    words_of = rows.sparkSession.sparkContext.broadcast(wanted)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pack = words_of.value, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            spot = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            hit = (bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
            hit &= np.asarray(batch.column(0).is_valid())
            counts, digests, texts, marks = [], [], [], []
            for chosen, value in zip(hit.tolist(), batch.column(1).cast(pa.binary())):
                raw = value.as_py() or b""
                words = spaced_words(raw)
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                keep = chosen and value.is_valid
                texts.append(pack(raw) if keep else None)
                marks.append(xxhash.xxh64_intdigest(raw) - 2**63 if keep else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(texts, pa.binary()), pa.array(marks, pa.int64())],
                names=["key", "n_words", "kept_sha256", "text", "mark"])

    return rows.select("key", "text", F.xxhash64("key").alias("spot")).mapInArrow(
        measure, "key bigint, n_words bigint, kept_sha256 string, text binary, mark bigint")


def _passages(sources: DataFrame, window: int) -> DataFrame:
    """key and words (joined by spaces) of each run of recurring windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = _WordHashes(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keys, passages = [], []
            for key, text, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = spaced_words(unpack(text))
                recurs = np.isin(window_values(words, window, hashes).view(np.int64), np.array(values, np.int64))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], recurs, [0]]).astype(np.int8)))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    keys.append(key)
                    passages.append(b" ".join(words[a:b - 1 + window]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(passages, pa.binary())], names=["key", "words"])

    return sources.select("key", "text", "values").mapInArrow(cut, "key bigint, words binary")


class PhraseAutomaton:
    """Finds every occurrence of a window of its passages."""

    def __init__(self, passages: list[tuple[int, list[bytes]]], window: int):
        self.window, self.tile = window, (window + 1) // 2
        self.codes: dict[bytes, int] = {}
        # The smallest document with each window.
        self.owners: dict[tuple[int, ...], int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for owner, words in passages:
            codes = tuple([self.codes.setdefault(w, len(self.codes) + 1) for w in words])
            for at in range(0, len(codes) - self.tile + 1, self.tile):
                self.automaton.add_word(codes[at:at + self.tile], 1)
            for at in range(len(codes) - window + 1):
                key = codes[at:at + window]
                self.owners[key] = min(owner, self.owners.get(key, owner))
        if self.owners:
            self.automaton.make_automaton()

    def matches(self, key: int, words: list[bytes]) -> list[tuple[int, int]]:
        """Runs of words covered by windows of passages of smaller documents."""
        if not self.owners or len(words) < self.window:
            return []
        code, owner = self.codes.get, self.owners.get
        codes = tuple([code(w, 0) for w in words])
        last, checked, out = len(codes) - self.window, 0, []
        for end, _ in self.automaton.iter(codes):
            # The windows that hold this tile whole.
            for at in range(max(checked, end - self.window + 1), min(end - self.tile + 1, last) + 1):
                first = owner(codes[at:at + self.window])
                if first is not None and first < key:
                    if out and at <= out[-1][1]:
                        out[-1][1] = at + self.window
                    else:
                        out.append([at, at + self.window])
            checked = max(checked, end - self.tile + 2)
        return [(a, b) for a, b in out]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _streamed(patterns: DataFrame, streams: DataFrame, window: int) -> DataFrame:
    def stream(left: pa.Table, right: pa.Table) -> pa.Table:
        # In a fixed order, so that a repeated task gives the same rows.
        passages = sorted(zip(left["key"].to_pylist(), left["words"].to_pylist()))
        automaton = PhraseAutomaton([(key, words.split(b" ")) for key, words in passages], window)
        keys, marks, spans = [], [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for key, mark, text in zip(right["key"].to_pylist(), right["mark"].to_pylist(), right["text"]):
            if found := automaton.matches(key, spaced_words(unpack(text.as_py()))):
                keys.append(key)
                marks.append(mark)
                spans.append([{"from": a, "to": b} for a, b in found])
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        return pa.table({"key": pa.array(keys, pa.int64()), "mark": pa.array(marks, pa.int64()), "spans": pa.array(spans, kind)})

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("spans", SPANS)])
    return patterns.groupBy("shard", "task").cogroup(streams.groupBy("shard", "task")).applyInArrow(stream, schema)


def _cut(rows: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("spans", SPANS), T.StructField("kept_sha256", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            removed, out, digests = [], [], []
            for text, spans in zip(batch.column(2), batch.column(3).to_pylist()):
                words = spaced_words(unpack(text.as_py()))
                found = merged([(s["from"], s["to"]) for s in spans or ()])
                kept, at = [], 0
                for a, b in found:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                removed.append(len(words) - len(kept))
                out.append([{"from": a, "to": b} for a, b in found])
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(out, kind),
                                              pa.array(digests)], names=[f.name for f in schema.fields])

    return rows.mapInArrow(cut, schema)
