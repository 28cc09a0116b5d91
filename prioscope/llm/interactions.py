"""Filter interaction audit: what each filter removes, in every order of the filters, kept up to date by a stream.

All files of a table go through a stream of micro-batches. Every row counts at
once with the filters its text fails, as if it repeated another one. Per text, the
state of the stream keeps the smallest id so far and the rows that hold it; those
are corrected to be the first. (Texts share states by buckets of their digests, a
bucket for every 2,048 rows: a call per text costs a hundred times its work.) When a smaller id arrives in a later batch, the
correction of the earlier holders is retracted. The sum of all counts is a table
of parts and masks of failed filters, from which all orders follow.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import work_folder, written
from .common import column

FILTERS = "ABCDE"
_BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
_MASKS = 1 << len(FILTERS)
# Micro-batches that the files are dealt to.
BATCHES = 4
# Texts of a state: so many share one, whatever the size of the table.
TEXTS = 2048
# Entries that a task adds up before it hands them on.
FLUSH = 50_000
_MARKS = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(0x41, 0x5B))
_SIGNS = b"#$%&*|"
_STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else every small store takes 4 MB of disk ahead.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_COUNTS = "part string, mask int, quality boolean, toxic boolean, n bigint"


def failed_filters(text: bytes) -> int:
    """Mask of A to D: too few words, too few different words, too many capitals, a sign of #$%&*|."""
    words = text.split()
    points = len(text.translate(None, _MARKS))
    capitals = len(text) - len(text.translate(None, _UPPER))
    return (_BIT["A"] * (len(words) < 200) | _BIT["B"] * (100 * len(set(words)) < 50 * len(words))
            | _BIT["C"] * (100 * capitals > 2 * points) | _BIT["D"] * (len(text.translate(None, _SIGNS)) < len(text)))


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, part, mask and digest of each row (id, part, text)."""
    for batch in batches:
        masks, digests = [], []
        for value in batch.column(2).cast(pa.binary()):
            text = value.as_py() or b""
            masks.append(failed_filters(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
            names=["id", "part", "mask", "digest"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for the state, added up per task.

    A text gives one row with its smallest id and the rows that hold it; counts of
    parts and masks, which need no state, are rows marked as plain.
    """
    counts: Counter = Counter()
    lowest: dict[bytes, tuple[int, Counter]] = {}

    def handed() -> pa.RecordBatch:
        rows = [(hashlib.sha256(repr(entry).encode()).digest(), 0, True, [[*entry, n]]) for entry, n in counts.items()]
        rows += [(digest, id_, False, [[*entry, n] for entry, n in holders.items()]) for digest, (id_, holders) in lowest.items()]
        counts.clear()
        lowest.clear()
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.bool_()), pa.array([json.dumps(r[3]) for r in rows], pa.string()),
        ], names=["digest", "id", "plain", "entries"])

    for batch in batches:
        for id_, part, mask, digest, quality, toxic in zip(*(batch.column(i).to_pylist() for i in range(6))):
            entry = (part, mask, quality, toxic)
            if id_ is None:
                counts[entry] += 1
                continue
            # Counted as a repeat; the state corrects those that hold the smallest id.
            counts[(part, mask | _BIT["E"], quality, toxic)] += 1
            known = lowest.get(digest)
            if known is None or id_ < known[0]:
                lowest[digest] = (id_, Counter({entry: 1}))
            elif id_ == known[0]:
                known[1][entry] += 1
        if len(lowest) + len(counts) >= FLUSH:
            yield handed()
    yield handed()


def _corrected(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of counts that new rows bring about; the state has the smallest id and its holders per text of a bucket."""
    texts: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
    change: Counter = Counter()

    def first(holders: list, sign: int) -> None:
        for part, mask, quality, toxic, n in holders:
            change[part, mask, quality, toxic] += sign * n
            change[part, mask | _BIT["E"], quality, toxic] -= sign * n

    for frame in frames:
        for digest, id_, plain, entries in zip(frame["digest"], frame["id"].tolist(), frame["plain"].tolist(), frame["entries"]):
            holders = json.loads(entries)
            if plain:
                for *entry, n in holders:
                    change[tuple(entry)] += n
                continue
            name = digest.hex()
            low, known = texts.get(name, (None, []))
            if low is not None and id_ > low:
                continue
            if low is None or id_ < low:
                # The earlier holders repeat this one after all.
                first(known, -1)
                texts[name] = [id_, holders]
            else:
                both = Counter({tuple(e[:4]): e[4] for e in known})
                both.update({tuple(e[:4]): e[4] for e in holders})
                texts[name] = [low, [[*entry, n] for entry, n in both.items()]]
            first(holders, 1)
    state.update((json.dumps(texts),))
    yield pd.DataFrame([(*entry, n) for entry, n in change.items() if n], columns=["part", "mask", "quality", "toxic", "n"])


def mask_counts(spark: SparkSession, path: str, labels: DataFrame | None = None, batches: int = BATCHES, key: str = "doc_id",
                text: str = "text", part: str = "source") -> DataFrame:
    """part, mask, quality, toxic, n: rows of the Parquet table at `path` by the filters they fail and their labels.

    Bits 1 to 16 of a mask are the filters A to E. `labels` has doc_id, quality and
    toxic; a row has quality or toxic if any label of its id is 1. Texts are equal
    if their SHA-256 digests are; a null text is an empty one, a null part the
    empty string. E fails where the same text has a smaller id: rows that repeat
    the smallest id all pass, and null ids neither fail nor make others fail.
    Columns that are not named are not read. An empty table has no counts.

    A text is one row per task and batch on its way to its state, however many
    rows it has; the state has one id per text and counts of the rows that hold it.
    """
    schema = spark.read.parquet(path).schema
    files = max(1, len(spark.read.parquet(path).inputFiles()))
    marks = labels.where(column("doc_id").isNotNull()).groupBy(column("doc_id").cast("bigint").alias("of")).agg(
        F.max((column("quality") == 1).cast("int")).alias("quality"), F.max((column("toxic") == 1).cast("int")).alias("toxic")
    ) if labels is not None else spark.createDataFrame([], "of bigint, quality int, toxic int")
    marks = written(marks.select("of", *[(F.coalesce(F.col(c), F.lit(0)) == 1).alias(c) for c in ("quality", "toxic")]), "marks")
    # Old files count like new ones.
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", -(-files // batches)).option(
        "maxFileAge", "36500d").parquet(_pattern(path))
    rows = arriving.select(column(key).cast("bigint").alias("id"), F.coalesce(column(part).cast("string"), F.lit("")).alias("part"),
                           column(text).cast("string").alias("text"))
    profiled = rows.mapInArrow(_profiled, "id bigint, part string, mask int, digest binary")
    # Rows without id match no label; they are spread by their text.
    profiled = profiled.withColumn("at", F.coalesce("id", F.xxhash64("digest")))
    judged = profiled.join(marks, (F.col("at") == F.col("of")) & F.col("id").isNotNull(), "left").select(
        "id", "part", "mask", "digest", F.coalesce("quality", F.lit(False)).alias("quality"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    combined = judged.mapInArrow(_combined, "digest binary, id bigint, plain boolean, entries string")
    buckets = max(1, -(-spark.read.parquet(path).count() // TEXTS))
    changes = combined.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(
        _corrected, _COUNTS, "texts string", "append", GroupStateTimeout.NoTimeout)
    folder = f"{work_folder(spark)}/interactions-{uuid.uuid4().hex}"
    with _settings(spark, _STATE_SETTINGS):
        query = changes.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option(
            "checkpointLocation", f"{folder}/stream").start(f"{folder}/changes")
    query.awaitTermination()
    found = spark.read.schema(changes.schema).parquet(f"{folder}/changes")
    counted = found.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")
    return written(counted, "mask-counts")


def _pattern(path: str) -> str:
    """A pattern that only `path` matches: file streams take a single file only as a match of a pattern."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


class _settings:
    """Session settings while a stream starts, which keeps its own copy of them."""

    def __init__(self, spark: SparkSession, settings: dict[str, str]):
        self.spark, self.settings = spark, settings

    def __enter__(self) -> None:
        self.before = {k: self.spark.conf.get(k, None) for k in self.settings}
        for k, v in self.settings.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_) -> None:
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def interactions(counts: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what the step's filter does there, from a table of mask counts.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. Filters that remove nothing have zeros; a part
    without rows has none. One row per part holds its 32 masks; the 600 steps are
    read off it.
    """
    sums = [F.array(*[F.sum(F.when((F.col("mask") == m) & flag, F.col("n")).otherwise(0)) for m in range(_MASKS)]).alias(name)
            for name, flag in (("rows", F.lit(True)), ("good", F.col("quality")), ("bad", F.col("toxic")))]
    parts = counts.groupBy("part").agg(*sums)
    steps = []
    for order in itertools.permutations(FILTERS):
        for at, name in enumerate(order):
            before = sum(_BIT[f] for f in order[:at])
            steps.append(f"named_struct('filter_order', '{''.join(order)}', 'step', {at + 1}, 'bit', {_BIT[name]}, 'before', {before})")
    listed = parts.withColumn("s", F.explode(F.expr(f"array({', '.join(steps)})"))).select("part", "rows", "good", "bad", "s.*")
    masks = F.sequence(F.lit(0), F.lit(_MASKS - 1))

    def total(array: str, wanted) -> Column:
        chosen = F.zip_with(array, masks, lambda n, m: F.when(wanted(m), n).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda a, b: a + b)

    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~gone(m)
    orders = len(list(itertools.permutations(FILTERS)))
    # In one of so many orders as a mask has filters a given one of them comes first.
    share = F.zip_with("rows", masks, lambda n, m: F.when(
        fails(m), F.floor(n * orders / F.bit_count(m)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return listed.select(
        "part", "filter_order", "step",
        total("rows", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("rows", removed).alias("removed"),
        total("rows", lambda m: fails(m) & gone(m)).alias("redundant"), total("rows", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("bad", removed).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("shapley"))
