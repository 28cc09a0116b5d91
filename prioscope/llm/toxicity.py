"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine over all words.

A word weighs (1 + log n) x idf, damped by what the examples tell about it: the
absolute difference between the log odds of the label with the word and without,
shrunk towards nothing by PRIOR imagined examples. Every word of the examples has
its place in vectors and norms; a word in none of them tells nothing and weighs
nothing by the same formula. How rare a word is is counted over all documents.

Examples are indexed by word, in blocks with the largest weight of each frequent
word per block. A query adds up the postings of its rarer words, which with the
blocks' bounds gives every example an upper bound; examples are then scored in
full until no bound exceeds the nearest found, so the neighbours are exact. Votes
weigh by distance and are calibrated by cross-fit: every example is scored against
others only, with damping that has not seen its label.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.tables import written
from .common import column
from .words import letter_words

# The examples are the labelled documents with the smallest hashes, at most so many; everything else covers all rows.
MAX_EXAMPLES = 8_192
NEIGHBOURS = 15
BLOCK = 64
# A word in more than one of so many examples is frequent; at most MAX_FREQUENT, the most frequent ones.
RARITY = 64
MAX_FREQUENT = 256
PRIOR = 20.0
FOLDS = 2
# Tasks that share the votes of a fold.
_PARTS = 4
THRESHOLD = 0.3
_SOFTENING = 0.05
# Words counted together in one row of partial counts, and first sums of them.
_CHUNK = 4096
_SALTS = 32
_TASKS_PER_CORE = 4
# Scores of different texts that a task remembers.
_REMEMBERED = 20_000

EVIDENCE = T.ArrayType(T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))
_ADDED = ("score", "evidence")


def word_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the different words of a text, ascending, and how often each occurs."""
    counts = Counter(letter_words(text))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts))
    order = np.argsort(hashes)
    return hashes[order], np.fromiter(counts.values(), np.int32, len(counts))[order]


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions of several ranges, one after the other."""
    sizes = end - start
    return np.arange(sizes.sum()) + np.repeat(start - np.append(0, np.cumsum(sizes)[:-1]), sizes)


class BlockMaxIndex:
    """Exact nearest neighbours by cosine among sparse vectors of non-negative weights, given as rows of terms."""

    def __init__(self, start: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int):
        self.n = len(start) - 1
        rows = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(start))
        length = np.sqrt(np.bincount(rows, weights=weights * weights, minlength=self.n))
        unit = (weights / np.where(length > 0, length, 1)[rows]).astype(np.float32)
        df = np.bincount(terms, minlength=n_terms)
        frequent = np.argsort(-df, kind="stable")[:MAX_FREQUENT]
        frequent = frequent[df[frequent] > self.n / RARITY]
        self.slot = np.full(n_terms, -1, np.int16)
        self.slot[frequent] = np.arange(len(frequent))
        self.blocks = max(1, -(-self.n // BLOCK))
        often = self.slot[terms] >= 0
        at, held = self.slot[terms[often]], unit[often]
        # Examples with the same heaviest frequent words share blocks, which keeps the bounds tight.
        by_weight = np.lexsort((held, rows[often]))
        last = np.flatnonzero(np.append(np.diff(rows[often][by_weight]) > 0, True)) if len(held) else np.empty(0, int)
        heaviest = np.full((2, self.blocks * BLOCK), MAX_FREQUENT, np.int32)
        owners = rows[often][by_weight[last]]
        heaviest[0, owners] = at[by_weight[last]]
        more = np.append(True, np.diff(last) > 1) & (last > 0) if len(last) else np.empty(0, bool)
        heaviest[1, owners[more]] = at[by_weight[last[more] - 1]]
        order = np.lexsort((heaviest[1], heaviest[0], np.arange(self.blocks * BLOCK) >= self.n))
        self.number = order.astype(np.int32)
        place = np.empty(len(order), np.uint16 if len(order) <= 1 << 16 else np.int32)
        place[order] = np.arange(len(order))
        self.dense = np.zeros((self.blocks * BLOCK, len(frequent)), np.float32)
        self.dense[place[rows[often]], at] = held
        # Largest weight per frequent word and block.
        self.largest = np.ascontiguousarray(self.dense.reshape(self.blocks, BLOCK, len(frequent)).max(axis=1).T)
        rare = np.flatnonzero(~often)
        rare = rare[np.argsort(terms[rare], kind="stable")]
        self.ids, self.weights = place[rows[rare]], unit[rare]
        self.start = np.searchsorted(terms[rare], np.arange(n_terms + 1)).astype(np.int32)

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest with a positive cosine to the vector `values` at `terms`; ties by number."""
        length = np.sqrt((values * values).sum())
        if not self.n or not length:
            return np.empty(0, np.int64), np.empty(0)
        values = (values / length).astype(np.float32)
        slots = self.slot[terms]
        often = slots >= 0
        rare = terms[~often]
        start, end = self.start[rare], self.start[rare + 1]
        ranges = list(zip(start.tolist(), end.tolist()))
        base = np.zeros(len(self.number))
        if ranges:
            weights = np.concatenate([self.weights[a:b] for a, b in ranges])
            weights *= np.repeat(values[~often], end - start)
            base = np.bincount(np.concatenate([self.ids[a:b] for a, b in ranges]), weights=weights, minlength=len(base))
        slots, values = slots[often].astype(np.int64), values[often]
        above = values @ self.largest[slots]
        top = base.reshape(self.blocks, BLOCK).max(axis=1) + above
        width, dense = self.dense.shape[1], self.dense.reshape(-1)
        rows, scores, worst = np.empty(0, np.int64), np.empty(0), 0.0
        # Blocks in the order of their bounds, more at a time: no other block can hold a nearer example.
        order, done, step = np.argsort(-top, kind="stable"), 0, 2
        while done < self.blocks and top[order[done]] >= max(worst - 1e-6, 1e-12):
            chosen = order[done:done + step]
            done, step = done + step, 2 * step
            found = (chosen[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            found = found[base[found] + np.repeat(above[chosen], BLOCK) >= worst - 1e-6]
            rows, scores = np.append(rows, found), np.append(scores, base[found] + dense.take(found[:, None] * width + slots) @ values)
            if len(scores) >= k:
                worst = np.partition(scores, -k)[-k]
        kept = scores > max(worst - 1e-6, 1e-12)
        rows, scores = self.number[rows[kept]].astype(np.int64), scores[kept]
        if len(scores) > k:
            # All that tie with the k-th, then by number.
            near = scores >= np.partition(scores, -k)[-k]
            rows, scores = rows[near], scores[near]
        top = np.lexsort((rows, -scores))[:k]
        return rows[top], scores[top]


@dataclass
class Examples:
    """Labelled examples as rows of terms; bounded by MAX_EXAMPLES and their lengths."""

    ids: np.ndarray
    labels: np.ndarray
    start: np.ndarray
    terms: np.ndarray
    frequency: np.ndarray    # 1 + log n
    idf: np.ndarray

    def damping(self, used: np.ndarray) -> np.ndarray:
        """Per term the shrunk difference of log odds among the `used` examples."""
        share = (self.labels[used].sum() + 1) / (used.sum() + 2)
        rows = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.start))
        inside = used[rows]
        seen = np.bincount(self.terms[inside], minlength=len(self.idf))
        hits = np.bincount(self.terms[inside], weights=self.labels[rows[inside]], minlength=len(self.idf))
        odds = np.log((hits + PRIOR * share) / (seen - hits + PRIOR * (1 - share)))
        return np.abs(odds - np.log(share / (1 - share)))

    def index(self, used: np.ndarray, factor: np.ndarray) -> BlockMaxIndex:
        chosen = np.flatnonzero(used)
        at = _ranges(self.start[chosen], self.start[chosen + 1])
        start = np.append(0, np.cumsum(np.diff(self.start)[chosen]))
        return BlockMaxIndex(start, self.terms[at], self.frequency[at] * factor.astype(np.float32)[self.terms[at]], len(self.idf))


@dataclass
class ToxicityModel:
    """A fitted scorer; bounded by the number of examples and their words."""

    hashes: np.ndarray
    factor: np.ndarray       # idf x damping
    index: BlockMaxIndex
    example_ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    chances: np.ndarray = field(default_factory=lambda: np.array([0.5]))
    base: float = 0.5

    def vector(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text's words; words of no example weigh nothing."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        terms = at[known]
        return terms, (1 + np.log(counts[known])) * self.factor[terms]

    def neighbours(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.index.nearest(*self.vector(hashes, counts), NEIGHBOURS)

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        weight = 1 / (1 - np.minimum(cosines, 1.0) + _SOFTENING)
        return float(weight @ self.labels[rows] / weight.sum())

    def score(self, text: bytes) -> tuple[float, list]:
        """Calibrated chance of label 1, and the nearest examples as evidence."""
        rows, cosines = self.neighbours(*word_counts(text))
        if not len(rows):
            return self.base, []
        evidence = [{"doc_id": int(self.example_ids[i]), "label": int(self.labels[i]), "cosine": float(c)}
                    for i, c in zip(rows[:3].tolist(), cosines[:3])]
        return float(np.interp(self.vote(rows, cosines), self.votes, self.chances)), evidence


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                 max_examples: int = MAX_EXAMPLES) -> ToxicityModel:
    """A scorer from the documents that `labels` marks 0 or 1 (other or null marks are none; repeated marks: the larger).

    Labels are learned from at most `max_examples` documents; how rare a word is
    is counted over all of `docs`. Of documents that repeat an id one is an
    example. Without any example all scores are 0.5.
    """
    spark = docs.sparkSession
    marked = labels.where(column(label).isin(0, 1) & column(key).isNotNull()).groupBy(
        column(key).cast("bigint").alias("id")).agg(F.max(column(label)).cast("int").alias("label"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(max_examples)
    tasks = _TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    rows = docs.select(column(key).cast("bigint").alias("id"), column(text).alias("text")).join(F.broadcast(chosen), "id")
    # Ids that several documents bear: their count needs no text, and the smallest text of each is found map-side.
    again = written(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids")
    if not again.isEmpty():
        rows = rows.join(F.broadcast(again), "id", "left_anti").unionByName(
            rows.join(F.broadcast(again), "id", "left_semi").groupBy("id", "label").agg(F.min("text").alias("text")).select(rows.columns))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_counts(value.as_py() or b"") for value in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("label"), pa.array([h.tobytes() for h, _ in found], pa.binary()),
                pa.array([c.tobytes() for _, c in found], pa.binary())], names=["id", "label", "hashes", "counts"])

    packed = written(rows.select("id", "label", "text").coalesce(tasks).mapInArrow(
        counted, "id bigint, label int, hashes binary, counts binary"), "examples")
    # At most max_examples rows.
    examples, hashes = _examples(packed.toArrow())
    if not len(examples.ids):
        return ToxicityModel(np.empty(0, np.uint64), np.empty(0), BlockMaxIndex(np.zeros(1, int), np.empty(0, int), np.empty(0), 0),
                             np.empty(0, int), np.empty(0))
    total, seen = _document_frequencies(docs, text, hashes, tasks)
    examples.idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    model = _fitted(examples, hashes, np.ones(len(examples.ids), bool))
    _calibrate(model, _cross_votes(packed, examples.idf))
    return model


def _examples(rows: pa.Table) -> tuple[Examples, np.ndarray]:
    """Packed examples in the order of their ids, and the hashes of their words, ascending."""
    rows = rows.sort_by("id")
    parts = [np.frombuffer(value.as_buffer(), np.uint64) for value in rows["hashes"]]
    start = np.append(0, np.cumsum([len(p) for p in parts], dtype=np.int64))
    hashes = np.unique(np.concatenate([*parts, np.empty(0, np.uint64)]))
    terms, frequency = np.empty(start[-1], np.int32), np.empty(start[-1], np.float32)
    for a, b, own, counts in zip(start, start[1:], parts, rows["counts"]):
        terms[a:b] = np.searchsorted(hashes, own)
        frequency[a:b] = 1 + np.log(np.frombuffer(counts.as_buffer(), np.int32))
    return Examples(rows["id"].to_numpy(), rows["label"].to_numpy().astype(float), start, terms, frequency,
                    np.ones(len(hashes), np.float32)), hashes


def _fitted(examples: Examples, hashes: np.ndarray, used: np.ndarray) -> ToxicityModel:
    factor = (examples.idf * examples.damping(used)).astype(np.float32)
    chosen = np.flatnonzero(used)
    return ToxicityModel(hashes, factor, examples.index(used, factor), examples.ids[chosen], examples.labels[chosen])


def _document_frequencies(docs: DataFrame, text: str, hashes: np.ndarray, tasks: int) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each word: tasks send packed counts, which are summed in two steps."""
    spark = docs.sparkSession
    known, chunks = spark.sparkContext.broadcast(hashes), -(-(len(hashes) + 1) // _CHUNK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = known.value
        seen = np.zeros(chunks * _CHUNK, np.int32)
        for batch in batches:
            # The count of documents stands behind those of the words.
            seen[len(hashes)] += batch.num_rows
            for value in batch.column(0).cast(pa.binary()):
                own, _ = word_counts(value.as_py() or b"")
                at = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
                seen[at[hashes[at] == own] if len(hashes) else []] += 1
        parts = seen.reshape(chunks, _CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())],
                                         names=["chunk", "counts"])

    def kind_of(value: pa.Scalar) -> type:
        # Counts of a task, or sums of them.
        return np.int32 if value.as_buffer().size == 4 * _CHUNK else np.int64

    def added(table: pa.Table) -> pa.Table:
        sums = np.zeros(_CHUNK, np.int64)
        for value in table["counts"]:
            sums += np.frombuffer(value.as_buffer(), kind_of(value))
        return pa.table({"chunk": table["chunk"][:1], "counts": pa.array([sums.tobytes()], pa.binary())})

    partial = docs.select(column(text)).coalesce(tasks).mapInArrow(count, "chunk int, counts binary").withColumn(
        "salt", F.spark_partition_id() % _SALTS)
    schema = "chunk int, counts binary"
    found = partial.groupBy("chunk", "salt").applyInArrow(added, schema).groupBy("chunk").applyInArrow(added, schema).toArrow()
    seen = np.zeros(chunks * _CHUNK)
    for at, value in zip(found["chunk"].to_pylist(), found["counts"]):
        seen[at * _CHUNK:(at + 1) * _CHUNK] = np.frombuffer(value.as_buffer(), np.int64)
    known.destroy()
    return int(seen[len(hashes)]), seen[:len(hashes)]


def _cross_votes(packed: DataFrame, idf: np.ndarray) -> list[tuple[float | None, float]]:
    """Vote and label of every example, from a model fitted on the other folds; no vote without neighbours.

    A task reads all examples, which are bounded, fits the model of its fold and
    scores its part of the fold.
    """
    known = packed.sparkSession.sparkContext.broadcast(idf)

    def part(fold: int, number: int) -> DataFrame:
        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(list(batches)).sort_by("id")
            examples, hashes = _examples(rows)
            examples.idf = known.value
            folds = np.arange(len(examples.ids)) % FOLDS
            model = _fitted(examples, hashes, folds != fold)
            own = np.flatnonzero(folds == fold)[number::_PARTS]
            votes = []
            for i in own.tolist():
                a, b = examples.start[i], examples.start[i + 1]
                terms = examples.terms[a:b]
                near, cosines = model.index.nearest(terms, examples.frequency[a:b].astype(float) * model.factor[terms], NEIGHBOURS)
                votes.append(model.vote(near, cosines) if len(near) else None)
            yield pa.RecordBatch.from_arrays([pa.array(examples.labels[own]), pa.array(votes, pa.float64())], names=["label", "vote"])

        return packed.coalesce(1).mapInArrow(vote, "label double, vote double")

    # One job each, side by side: a union would put all of them into one task.
    target = inheritable_thread_target(packed.sparkSession)
    with ThreadPool(FOLDS * _PARTS) as pool:
        found = pool.starmap(target(lambda fold, number: part(fold, number).toArrow()),
                             [(fold, number) for fold in range(FOLDS) for number in range(_PARTS)])
    found = pa.concat_tables(found)
    known.destroy()
    return list(zip(found["vote"].to_pylist(), found["label"].to_pylist()))


def _calibrate(model: ToxicityModel, votes: list[tuple[float | None, float]]) -> None:
    """Isotonic regression of the labels on the votes; examples without neighbours give the base chance."""
    bare = [mark for vote, mark in votes if vote is None]
    share = float(model.labels.mean())
    model.base = (sum(bare) + share) / (len(bare) + 1)
    pooled: list[list[float]] = []  # vote low, vote high, sum of labels, number
    for vote, mark in sorted((v, m) for v, m in votes if v is not None):
        pooled.append([vote, vote, mark, 1.0])
        while len(pooled) > 1 and pooled[-2][2] * pooled[-1][3] >= pooled[-1][2] * pooled[-2][3]:
            _, high, marked, number = pooled.pop()
            pooled[-1][1:] = [high, pooled[-1][2] + marked, pooled[-1][3] + number]
    at = [(v, (s + share) / (m + 1)) for low, high, s, m in pooled for v in dict.fromkeys((low, high))]
    model.votes, model.chances = (np.array(x) for x in zip(*at)) if at else (np.array([0.0]), np.array([share]))


def score_toxicity(docs: DataFrame, model: ToxicityModel | Broadcast, text: str = "text") -> DataFrame:
    """All rows and columns of `docs`, plus score (0 to 1) and evidence (the three nearest examples).

    Scores read the text only; null and empty texts, and texts without a word of
    an example, get the chance found among examples without neighbours. Equal
    texts score alike. Columns of `docs` named score or evidence are replaced.
    Nothing is shuffled.
    """
    if not isinstance(model, Broadcast):
        model = docs.sparkSession.sparkContext.broadcast(model)
    base = [c for c in docs.columns if c not in _ADDED]
    inputs = docs.select(*[column(c) for c in base])
    schema = T.StructType([*inputs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("evidence", EVIDENCE)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.value
        # Copies score alike.
        known: dict[int, tuple[float, list]] = {}

        def scored(text: bytes) -> tuple[float, list]:
            mark = xxhash.xxh3_128_intdigest(text)
            if mark not in known:
                if len(known) >= _REMEMBERED:
                    known.clear()
                known[mark] = scorer.score(text)
            return known[mark]

        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
        for batch in batches:
            found = [scored(value.as_py() or b"") for value in batch.column(text).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], kind)],
                                             names=[*batch.schema.names, "score", "evidence"])

    return inputs.mapInArrow(score, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(column(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
