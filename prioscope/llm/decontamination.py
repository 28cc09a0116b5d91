"""Benchmark decontamination: an FM-index per training shard, searched for all benchmark windows at once.

Words outside the benchmark's vocabulary cannot be part of a match, nor can
stretches of known words shorter than the shortest window; the index of a shard
holds the remaining stretches, separated, so nothing that could match is left
out. Windows are searched backwards through the wavelet-matrix ranks of its
Burrows-Wheeler transform, occurrences are located by walking to sampled suffix
positions, and overlapping ones merge into spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import column
from .words import letter_bytes, letter_words

WINDOW = 10
# A shard's index is built when its documents reach either size.
SHARD_WORDS = 1 << 19
SHARD_BYTES = 32 << 20
# Benchmarks are broadcast in blocks of about so many bytes; larger ones are searched block after block.
BLOCK_BYTES = 16 << 20
SAMPLE = 8

SPANS = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))
_ADDED = ("n_words", "spans", "items", "clean_text")


class FMIndex:
    """Search in a sequence of integer symbols (at least 1)."""

    def __init__(self, symbols: np.ndarray):
        text = np.append(symbols.astype(np.int64), 0)  # the end, smaller than all others
        suffixes = suffix_array(text)
        self.n = len(text)
        last = text[suffixes - 1]
        size = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.levels = []
        row = last
        for level in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = (row >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32)
            zeros = self.n - int(ones[-1])
            self.levels.append((level, ones, zeros))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.last = last
        self.sampled = suffixes % SAMPLE == 0
        self.positions = suffixes[self.sampled]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled, dtype=np.int64)])

    def step(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """First row whose suffix starts with the symbol, plus its count in the transform before the row."""
        low, at = np.zeros(len(rows), np.int64), rows.astype(np.int64)
        for level, ones, zeros in self.levels:
            bit = ((symbols >> level) & 1).astype(bool)
            low_ones, at_ones = ones[low], ones[at]
            low = np.where(bit, zeros + low_ones, low - low_ones)
            at = np.where(bit, zeros + at_ones, at - at_ones)
        return self.first[symbols] + at - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that start with each row of `patterns`."""
        start, end = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for at in range(patterns.shape[1] - 1, -1, -1):
            symbols = patterns[alive, at]
            known = symbols < len(self.first) - 1
            end[alive[~known]] = start[alive[~known]]
            alive, symbols = alive[known], symbols[known]
            start[alive], end[alive] = self.step(symbols, start[alive]), self.step(symbols, end[alive])
            alive = alive[start[alive] < end[alive]]
        return start, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in the given rows."""
        out, walked = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, open_ = rows.copy(), np.arange(len(rows))
        while len(open_):
            done = self.sampled[at[open_]]
            found = open_[done]
            out[found] = self.positions[self.sample_rank[at[found]]] + walked[found]
            open_ = open_[~done]
            at[open_] = self.step(self.last[at[open_]], at[open_])
            walked[open_] += 1
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling; only undecided ones are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    starts = np.concatenate([[True], text[order][1:] != text[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    length = 1
    while True:
        slots = np.flatnonzero(~(starts & np.append(starts[1:], True)))
        if not len(slots):
            return order
        at = order[slots]
        behind = np.where(at + length < n, rank[np.minimum(at + length, n - 1)] + 1, 0)
        moved = at[np.lexsort((behind, rank[at]))]
        order[slots] = moved
        key = np.where(moved + length < n, rank[np.minimum(moved + length, n - 1)] + 1, 0)
        fresh = np.concatenate([[True], (rank[moved][1:] != rank[moved][:-1]) | (key[1:] != key[:-1])])
        starts[slots] = fresh
        rank[moved] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        length *= 2


class Windows:
    """The windows of a block of benchmark items, as codes of its vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.codes: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[int]]] = {}
        self.names = [name for name, _ in items]
        for i, (_, text) in enumerate(items):
            codes = [self.codes.setdefault(w, len(self.codes) + 2) for w in letter_words(text)]
            length = min(window, len(codes))
            for at in range(len(codes) - length + 1 if codes else 0):
                owners = by_length.setdefault(length, {}).setdefault(tuple(codes[at:at + length]), [])
                if not owners or owners[-1] != i:
                    owners.append(i)
        self.groups = [(length, np.array(list(found), np.int64), list(found.values())) for length, found in by_length.items()]
        self.shortest = min(by_length, default=0)


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of `docs`, plus n_words, spans, items and clean_text.

    `spans` are the merged runs of words (from, to: zero-based, end excluded)
    inside occurrences of a window, `items` the sorted ids, as strings, of the
    items with occurring windows, `clean_text` the text without the spans,
    unchanged where there are none. A window is `window` consecutive words of an
    item; shorter items are one window, items without words none. Null texts
    have no words and stay null; a null item id is the empty string. Repeated items
    and rows count like others. Columns of `docs` with the added names are
    replaced. Nothing is shuffled: shards are parts of the scan.
    """
    size = benchmark.agg(F.sum(F.octet_length(column(item_text)))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    base = [c for c in docs.columns if c not in _ADDED]
    out = docs.select(*[column(c) for c in base], F.lit(0).alias("n_words"), F.array().cast(SPANS).alias("spans"),
                      F.array().cast("array<string>").alias("items"), column(text).alias("clean_text"))
    named = benchmark.where(column(item_text).isNotNull()).select(
        F.coalesce(column(item).cast("string"), F.lit("")).alias("item"), F.encode(column(item_text), "UTF-8").alias("text"))
    for block in range(blocks):
        part = named.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block) if blocks > 1 else named
        windows = docs.sparkSession.sparkContext.broadcast(
            Windows([(r["item"], bytes(r["text"])) for r in part.sort("item", "text").toLocalIterator()], window))
        out = out.mapInArrow(_marker(windows, text, block == blocks - 1), out.schema)
    return out


def n_hit(spans: str = "spans") -> Column:
    """Words inside spans."""
    return F.aggregate(F.col(spans), F.lit(0).cast("bigint"), lambda n, s: n + s["to"] - s["from"])


def _marker(windows, text: str, cut: bool):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(windows.value, text, cut)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                shard.add(batch.slice(at, 1000))
                if shard.full():
                    yield from shard.marked()
                    shard = _Shard(windows.value, text, cut)
        yield from shard.marked()

    return mark


class _Shard:
    def __init__(self, windows: Windows, text: str, cut: bool):
        self.windows, self.text, self.cut = windows, text, cut
        self.batches: list[pa.RecordBatch] = []
        self.counts: list[int] = []
        self.symbols: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.size = self.bytes = 0

    def full(self) -> bool:
        return self.size >= SHARD_WORDS or self.bytes >= SHARD_BYTES

    def add(self, batch: pa.RecordBatch) -> None:
        code = self.windows.codes.get
        shortest = self.windows.shortest
        self.batches.append(batch)
        for value in batch.column(self.text).cast(pa.binary()):
            words = letter_words(value.as_py() or b"")
            self.bytes += len(value.as_py() or b"")
            row = len(self.counts)
            self.counts.append(len(words))
            if not shortest or len(words) < shortest:
                continue
            codes = np.fromiter((code(w, 0) for w in words), np.int64, len(words))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], codes > 0, [0]]).astype(np.int8)))
            starts, ends = edge[::2], edge[1::2]
            for start, end in zip(starts[ends - starts >= shortest], ends[ends - starts >= shortest]):
                self.symbols += [codes[start:end], np.ones(1, np.int64)]
                self.places.append(np.arange(start, end + 1))
                self.owners.append(np.full(end - start + 1, row))
                self.size += end - start + 1

    def marked(self) -> Iterator[pa.RecordBatch]:
        spans, items = self._search() if self.symbols else ({}, {})
        row = 0
        for batch in self.batches:
            table = {name: batch.column(name) for name in batch.schema.names}
            old_spans, old_items = table["spans"].to_pylist(), table["items"].to_pylist()
            new_spans, new_items, clean = [], [], {}
            for i in range(batch.num_rows):
                merged = merged_spans([(s["from"], s["to"]) for s in old_spans[i]] + spans.get(row + i, []))
                new_spans.append([{"from": a, "to": b} for a, b in merged])
                new_items.append(sorted({*old_items[i], *items.get(row + i, ())}))
                if self.cut and merged:
                    clean[i] = without_spans(batch.column(self.text)[i].as_py(), merged)
            if clean:
                kept = batch.column("clean_text").to_pylist()
                for i, cleaned in clean.items():
                    kept[i] = cleaned
                table["clean_text"] = pa.array(kept, batch.schema.field("clean_text").type)
            table["n_words"] = pa.array(self.counts[row:row + batch.num_rows], batch.schema.field("n_words").type)
            table["spans"] = pa.array(new_spans, batch.schema.field("spans").type)
            table["items"] = pa.array(new_items, batch.schema.field("items").type)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(list(table.values()), schema=batch.schema)

    def _search(self) -> tuple[dict[int, list], dict[int, set]]:
        """Spans and item names by row of the shard."""
        index = FMIndex(np.concatenate(self.symbols))
        places, owners = np.concatenate(self.places), np.concatenate(self.owners)
        cover = np.zeros(len(places) + 1, np.int64)
        items: dict[int, set] = {}
        for length, patterns, item_lists in self.windows.groups:
            start, end = index.search(patterns)
            times = end - start
            which = np.repeat(np.arange(len(patterns)), times)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            at = index.locate(start[which] + inside)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            for pattern, row in np.unique(np.stack([which, owners[at]], 1), axis=0).tolist():
                items.setdefault(row, set()).update(self.windows.names[k] for k in item_lists[pattern])
        hit = np.cumsum(cover)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8)))
        spans: dict[int, list] = {}
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            spans.setdefault(int(owners[a]), []).append((int(places[a]), int(places[b - 1]) + 1))
        return spans, items


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    words = [m.span() for m in re.finditer(rb"[^ ]+", letter_bytes(raw))]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:words[a][0]])
        at = words[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode()
