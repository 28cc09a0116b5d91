"""Exact top-k search by inner product, best first through M-trees of paged metric nodes.

With M the largest length of a vector, a coordinate sqrt(M^2 - |x|^2) more puts
all vectors on one sphere, and d(q, x)^2 = |q|^2 + M^2 - 2 q.x for a query q whose
own extra coordinate is 0: the largest products are the smallest distances, which
obey the triangle inequality.

Vectors are dealt to the cell of their nearest pivot, crowded cells to blocks of
bounded size, and each block becomes an M-tree: pages with a routing vector, a
covering radius and, per entry, the distance to the routing vector and the
entry's own radius. A page is visited in the order of its smallest possible
distance; an entry e is passed over without computing its distance where
|d(q, parent) - d(e, parent)| - radius(e) exceeds the k-th distance found. Queries
first search one tree of the most promising cell, then all trees whose cell can
hold something as good as their k-th score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import written
from .common import column

SCALE = 256
TOP = 5
# Vectors of a tree; one pivot for so many, at most MAX_PIVOTS (they are broadcast). Beyond, cells have several trees.
TREE = 8192
MAX_PIVOTS = 1024
# Entries of a leaf and of an inner page.
PAGE = 64
FANOUT = 16
# Queries that one task searches together, and that it gets at once.
BATCH = 1024
CHUNK = 65_536
# Squared lengths below this have products that fit a long.
_LONGEST = 2.0**62
_EXACT = 2.0**53
_SLACK = 1e-6

_PAGES = ("dim int, cell int, block bigint, page int, leaf boolean, centre array<int>, radius double, vectors array<int>, "
          "distances array<double>, radii array<double>, children array<int>, ids array<array<bigint>>")
_FOUND = "query bigint, mark bigint, dim int, vector array<int>, cell int, block bigint, id bigint, score bigint"


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id and v (array<int>): floor(scale * x) of every component, repeated rows once.

    Without rows whose key or vector is null or whose vector holds null or
    non-finite components. Components beyond 32 bits and vectors of a squared
    length from 2^62 have no product in 64 bits and take no part either.
    """
    rows = vectors.select(column(key).cast("bigint").alias("id"), column(vector).alias("raw"))
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < 2.0**31))
    usable = rows.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return usable.select("id", F.transform("raw", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v")).where(
        length < _LONGEST).distinct()


def top_products(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = TOP, scale: int = SCALE,
                 tree: int = TREE) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest inner products of each query with rows of another key.

    `queries` says which rows of `vectors` are queries; all rows are candidates
    (see `integer_vectors` for those that take no part). Vectors of different
    lengths have no product. Equal scores rank by key; fewer candidates than k
    are all returned. Equal vectors are compared once, by their k + 1 smallest
    keys: a query cannot need more of them. Other columns are not read. An empty
    table, or no query, gives no rows.
    """
    ints = written(integer_vectors(vectors, key, vector, scale), "integer-vectors")
    # Limited before the shuffle too, so a vector that a third of all rows share costs a few rows per task.
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = written(ints.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(
        F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v")), "vector-classes")
    square = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x.cast("bigint"))
    sizes = classes.agg(F.count("*").alias("n"), F.max(square).alias("largest")).first()
    largest = sizes["largest"] or 0
    pivots = _Pivots(classes.orderBy(F.xxhash64("v"), "v").limit(min(MAX_PIVOTS, -(-sizes["n"] // tree))).select("v").collect(), largest)
    placed = written(_placed(classes, pivots), "placed")
    cells = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / tree).cast("bigint").alias("blocks"), F.max("far").alias("far"))
    # One row per pivot and vector length.
    cells = written(cells, "cells")
    blocked = placed.join(F.broadcast(cells.select("dim", "cell", "blocks")), ["dim", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("v"), F.col("blocks")))
    def build(block: pa.Table) -> pa.Table:
        return _Builder(largest).build(block)

    pages = written(blocked.groupBy("dim", "cell", "block").applyInArrow(build, _PAGES), "pages")

    asked = vectors.where(queries).select(column(key).cast("bigint").alias("id")).distinct()
    asked = written(ints.join(asked, "id", "left_semi").select(
        F.col("id").alias("query"), F.xxhash64("v").alias("mark"), F.size("v").alias("dim"), F.col("v").alias("vector")), "queries")
    chunks = max(1, -(-asked.count() // CHUNK))
    balls = {(r["dim"], r["cell"]): (r["blocks"], r["far"]) for r in cells.collect()}
    first = written(_searched(pages, _routed(asked, pivots, balls), chunks, k, largest), "first")
    best = first.groupBy("query", "mark", "dim", "vector", "cell", "block").agg(
        F.when(F.count("id") >= k, F.min("score")).alias("least"))
    rest = _searched(pages, _routed(best, pivots, balls), chunks, k, largest)
    ranked = first.unionByName(rest).where(F.col("id").isNotNull()).withColumn("rank", F.row_number().over(
        Window.partitionBy("query", "mark").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias(key), "score")


class _Pivots:
    """Routing vectors of the cells by vector length; bounded by MAX_PIVOTS."""

    def __init__(self, rows: list, largest: int):
        self.largest = float(largest)
        by: dict[int, list] = {}
        for i, r in enumerate(rows):
            by.setdefault(len(r["v"]), []).append((i, r["v"]))
        self.numbers = {dim: np.array([i for i, _ in own]) for dim, own in by.items()}
        self.vectors = {dim: np.array([v for _, v in own], float).reshape(len(own), dim) for dim, own in by.items()}

    def extra(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.largest - (vectors * vectors).sum(axis=1), 0))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot for vectors of one length; cell -1 at distance 0 if there is no pivot."""
        dim = vectors.shape[1]
        if dim not in self.numbers:
            return np.full(len(vectors), -1), np.zeros(len(vectors))
        own = self.vectors[dim]
        products = vectors @ own.T + np.outer(self.extra(vectors), self.extra(own))
        at = products.argmax(axis=1)
        square = 2 * (self.largest - products[np.arange(len(vectors)), at])
        return self.numbers[dim][at], np.sqrt(np.maximum(square, 0))


def _matrix(column_: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    whole = column_.combine_chunks() if isinstance(column_, pa.ChunkedArray) else column_
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), dim)


def _placed(classes: DataFrame, pivots: _Pivots) -> DataFrame:
    known = classes.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cell, far = np.empty(len(dims), np.int32), np.empty(len(dims))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                cell[own], far[own] = known.value.nearest(_matrix(batch.column(0).take(pa.array(own)), int(dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["v", "ids", "dim", "cell", "far"])

    return classes.select("v", "ids", "dim").mapInArrow(place, "v array<int>, ids array<bigint>, dim int, cell int, far double")


class _Builder:
    """Bulk-loads the M-tree of a block; its pages are rows, page 0 is the root."""

    def __init__(self, largest: int):
        self.largest = float(largest)

    def build(self, table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        # The same tree whatever the order of arrival.
        order = sorted(range(len(table)), key=table["v"].to_pylist().__getitem__)
        table = table.take(pa.array(order))
        self.vectors = _matrix(table["v"], dim)
        extra = np.sqrt(np.maximum(self.largest - (self.vectors * self.vectors).sum(axis=1), 0))
        self.points = np.hstack([self.vectors, extra[:, None]])
        self.ids = table["ids"].to_pylist()
        self.pages: list[dict] = []
        everything = np.arange(len(self.points))
        self._page(everything, self._central(everything))
        out = pa.Table.from_pylist(self.pages, schema=pa.schema([
            ("page", pa.int32()), ("leaf", pa.bool_()), ("centre", pa.list_(pa.int32())), ("radius", pa.float64()),
            ("vectors", pa.list_(pa.int32())), ("distances", pa.list_(pa.float64())), ("radii", pa.list_(pa.float64())),
            ("children", pa.list_(pa.int32())), ("ids", pa.list_(pa.list_(pa.int64())))]))
        for at, name in enumerate(("dim", "cell", "block")):
            out = out.add_column(at, name, pa.array(table[name].to_pylist()[:1] * len(out), table.schema.field(name).type))
        return out

    def _distances(self, members: np.ndarray, centre: int) -> np.ndarray:
        gap = self.points[members] - self.points[centre]
        return np.sqrt((gap * gap).sum(axis=1))

    def _central(self, members: np.ndarray) -> int:
        gap = self.points[members] - self.points[members].mean(axis=0)
        return int(members[(gap * gap).sum(axis=1).argmin()])

    def _page(self, members: np.ndarray, centre: int) -> tuple[int, float]:
        """Number and covering radius of a new page over `members`."""
        number, away = len(self.pages), self._distances(members, centre)
        page = {"page": number, "leaf": len(members) <= PAGE, "centre": self.vectors[centre].astype(int).tolist(),
                "radius": float(away.max()), "children": [], "ids": []}
        self.pages.append(page)
        if page["leaf"]:
            entries, page["distances"], page["radii"] = members, away.tolist(), [0.0] * len(members)
            page["ids"] = [self.ids[i] for i in members.tolist()]
        else:
            parts = self._split(members)
            entries = np.array([self._central(part) for part in parts])
            page["distances"] = self._distances(entries, centre).tolist()
            below = [self._page(part, int(c)) for part, c in zip(parts, entries)]
            page["children"], page["radii"] = [n for n, _ in below], [r for _, r in below]
        page["vectors"] = self.vectors[entries].astype(int).ravel().tolist()
        return number, page["radius"]

    def _split(self, members: np.ndarray) -> list[np.ndarray]:
        seeds = np.random.default_rng(len(members)).choice(members, min(FANOUT, -(-2 * len(members) // PAGE)), replace=False)
        home = np.stack([self._distances(members, int(s)) for s in seeds]).argmin(axis=0)
        parts = [members[home == i] for i in range(len(seeds)) if (home == i).any()]
        return parts if len(parts) > 1 else np.array_split(members, 2)


def _routed(asked: DataFrame, pivots: _Pivots, balls: dict[tuple[int, int], tuple[int, float]]) -> DataFrame:
    """A row per query and tree to search.

    Without scores yet, one tree of the cell with the largest product; with
    `least`, the k-th score so far (null: fewer found), all other trees of cells
    that can hold a product as large.
    """
    again = "least" in asked.columns
    known = asked.sparkSession.sparkContext.broadcast((pivots, balls))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, balls = known.value
        for batch in batches:
            take, cells, blocks = [], [], []
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                queries = _matrix(batch.column("vector").take(pa.array(own)), dim)
                numbers = pivots.numbers.get(dim, np.array([-1]))
                if dim in pivots.numbers:
                    products = queries @ pivots.vectors[dim].T
                else:
                    products = np.zeros((len(own), 1))
                marks = batch.column("mark").to_numpy()[own]
                counts, far = zip(*(balls.get((dim, int(c)), (0, 0.0)) for c in numbers))
                counts, far = np.array(counts), np.array(far)
                if not again:
                    products[:, counts == 0] = -np.inf
                    at = products.argmax(axis=1)
                    take.append(own)
                    cells.append(numbers[at])
                    blocks.append(marks.astype(np.uint64) % counts[at].astype(np.uint64))
                    continue
                sphere = (queries * queries).sum(axis=1)[:, None] + pivots.largest
                away = np.sqrt(np.maximum(sphere - 2 * products, 0))
                nearest = np.maximum(away - far - _SLACK * np.sqrt(sphere) - _SLACK, 0)
                least = batch.column("least").take(pa.array(own)).cast(pa.float64()).fill_null(-np.inf).to_numpy()
                can = (sphere - nearest * nearest) / 2 * (1 + 1e-12) + 1 >= least[:, None]
                if dim not in pivots.numbers:
                    can[:] = True
                done = list(zip(batch.column("cell").take(pa.array(own)).to_pylist(), batch.column("block").take(pa.array(own)).to_pylist()))
                for cell, number, column_ in zip(numbers.tolist(), counts.tolist(), can.T):
                    rows = np.flatnonzero(column_)
                    for block in range(number):
                        other = np.array([done[i] != (cell, block) for i in rows], bool)
                        take.append(own[rows[other]])
                        cells.append(np.full(int(other.sum()), cell))
                        blocks.append(np.full(int(other.sum()), block))
            picked = np.concatenate(take) if take else np.empty(0, np.int64)
            rows = batch.take(pa.array(picked))
            least = rows.column("least") if again else pa.nulls(len(picked), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows.column("query"), rows.column("mark"), rows.column("dim"), rows.column("vector"),
                 pa.array(np.concatenate(cells) if cells else [], pa.int32()), pa.array(np.concatenate(blocks).astype(np.int64) if blocks else [], pa.int64()),
                 least], names=["query", "mark", "dim", "vector", "cell", "block", "least"])

    return asked.mapInArrow(route, "query bigint, mark bigint, dim int, vector array<int>, cell int, block bigint, least bigint")


def _searched(pages: DataFrame, asked: DataFrame, chunks: int, k: int, largest: int) -> DataFrame:
    """The best candidates per query and tree; a query for which a tree has none keeps a row without id."""
    def search(trees: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in ("query", "mark", "dim", "vector", "cell", "block", "id", "score")}
        if not len(queries) or not len(trees):
            return pa.table(out, schema=found)
        tree = MTree(trees, largest)
        for at in range(0, len(queries), BATCH):
            part = queries.slice(at, BATCH)
            least = part["least"].combine_chunks().cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            best = tree.search(_matrix(part["vector"], tree.dim), part["query"].to_pylist(), least, k)
            rows = part.to_pylist()
            for row, hits in zip(rows, best):
                for score, id_ in hits or [(None, None)]:
                    for name in ("query", "mark", "dim", "vector", "cell", "block"):
                        out[name].append(row[name])
                    out["id"].append(id_)
                    out["score"].append(score)
        return pa.table(out, schema=found)

    found = pa.schema([("query", pa.int64()), ("mark", pa.int64()), ("dim", pa.int32()), ("vector", pa.list_(pa.int32())),
                       ("cell", pa.int32()), ("block", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
    place = ["dim", "cell", "block", "chunk"]
    dealt = asked.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int"))
    copies = pages.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return copies.groupBy(*place).cogroup(dealt.groupBy(*place)).applyInArrow(search, _FOUND)


class MTree:
    """Best-first search over the pages of a tree, for many queries at once."""

    def __init__(self, pages: pa.Table, largest: int):
        self.largest, self.dim = float(largest), pages["dim"][0].as_py()
        self.pages = {row["page"]: row for row in pages.to_pylist()}
        # Products of such lengths are exact as doubles.
        self.exact = largest < _EXACT
        # Distances that were computed, and entries that stored bounds ruled out.
        self.computed = self.avoided = 0
        for page in self.pages.values():
            page["vectors"] = np.array(page["vectors"], float if self.exact else np.int64).reshape(-1, self.dim)
            page["distances"], page["radii"] = np.array(page["distances"]), np.array(page["radii"])

    def search(self, queries: np.ndarray, own: list[int], least: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """Per query the k best (score, id) with a score of at least `least`; ties by id, `own` ids left out."""
        square = (queries * queries).sum(axis=1)
        sphere = square + self.largest
        slack = _SLACK * np.sqrt(sphere) + _SLACK
        queries = queries if self.exact else queries.astype(np.int64)
        floor = least.copy()
        reach = self._reach(sphere, floor) + slack
        best: list[list[tuple[int, int]]] = [[] for _ in own]
        root = self.pages[0]
        to_root = self._to(queries, sphere, np.array([root["centre"]], queries.dtype).reshape(1, self.dim))[:, 0]
        nearest = np.maximum(to_root - root["radius"], 0)
        # By the smallest possible distance of any query; the page number settles ties.
        heap = [(float(nearest.min()), 0, nearest, to_root)]
        while heap:
            _, number, nearest, away = heapq.heappop(heap)
            rows = np.flatnonzero(nearest <= reach)
            if not len(rows):
                continue
            page = self.pages[number]
            bound = np.abs(away[rows][:, None] - page["distances"]) - page["radii"]
            can = bound <= reach[rows][:, None]
            columns = np.flatnonzero(can.any(axis=0))
            self.computed += len(rows) * len(columns)
            self.avoided += len(rows) * (can.shape[1] - len(columns))
            if not len(columns):
                continue
            if not page["leaf"]:
                at = self._to(queries[rows], sphere[rows], page["vectors"][columns])
                for column_, to in zip(columns.tolist(), at.T):
                    near = np.full(len(own), np.inf)
                    near[rows] = np.where(can[:, column_], np.maximum(to - page["radii"][column_], 0), np.inf)
                    there = np.full(len(own), np.inf)
                    there[rows] = to
                    if np.isfinite(near).any():
                        heapq.heappush(heap, (float(near.min()), page["children"][column_], near, there))
                continue
            scores = queries[rows] @ page["vectors"][columns].T
            good = scores >= floor[rows][:, None]
            for i in np.flatnonzero(good.any(axis=1)).tolist():
                row = int(rows[i])
                hits = best[row] + [(int(scores[i, j]), id_) for j in np.flatnonzero(good[i]).tolist()
                                    for id_ in page["ids"][columns[j]] if id_ != own[row]]
                best[row] = sorted(hits, key=lambda h: (-h[0], h[1]))[:k]
                if len(best[row]) == k:
                    floor[row] = max(floor[row], best[row][-1][0])
                    reach[row] = self._reach(sphere[row:row + 1], floor[row:row + 1])[0] + slack[row]
        return best

    @staticmethod
    def _reach(sphere: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The distance at which a product is `floor`."""
        return np.sqrt(np.maximum(sphere - 2 * floor, 0))

    @staticmethod
    def _to(queries: np.ndarray, sphere: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(sphere[:, None] - 2.0 * (queries @ vectors.T), 0))
