"""Embedding near-dedup by an inverted multi-index.

Unit vectors are cut in halves, and each half has its own codebook, fitted by k-means on at most
``sample`` vectors; the product of the two codebooks is a grid of cells, and every vector is
filed in the cell of its two nearest codewords.  A query visits cells in the order of a lower
bound on the distance to anything filed there: for each half the distance to the plane between
the nearest codeword and the cell's one, the squares added up, as a multi-sequence traversal of
the two sorted lists.  It ends where the bound exceeds the distance that the wanted cosine
allows, so that every pair meets.  The bound holds from both sides of a pair, so of two cells
only the vectors of the lower numbered one visit the other, and a tile counts for both sides;
a vector's own cell is visited by all of its vectors.  A ``recall`` below 1 ends it earlier, at the bound within which
that share of the sample's vectors, turned by that angle in random directions, meet; pairs that
differ within a subspace of few dimensions cross more borders and are lost more often than that.
Visited vectors are verified in double precision.

Equal vectors of one label are filed once, with their number as weight.  A cell and its visitors
are compared in tiles of at most about ``tile`` rows a side, so a cell that holds a third of all
rows is many tasks; tiles return link counts and a spanning forest of links, never pairs.

Results in special cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label or identifier, link with nothing and are their own
component.  Vectors of different lengths don't link.  Rows that repeat an identifier are one
vector, the least in order; each gets its result.  An empty table gives an empty result.  Only
named columns are read.  Identifiers are whole numbers, or text of such; others raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, groups, reach


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = distances(x, centres).argmin(1)
        for c in np.unique(near):
            centres[c] = x[near == c].mean(0)
    return np.unique(centres, axis=0)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None], 0)


def unit(raw: list, dim: int) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float64) for r in raw]) if len(raw) else np.zeros((0, dim))
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in squares
    return x / np.sqrt((x**2).sum(1, keepdims=True))


class MultiIndex:
    """Codebooks of the two halves of vectors of one length."""

    def __init__(self, x: np.ndarray, words: int):
        self.half = max(1, x.shape[1] // 2)
        self.books = [kmeans(h, words, seed=s) for s, h in enumerate(self.cut(x))]
        with np.errstate(divide="ignore"):
            self.apart = [1 / (2 * np.sqrt(distances(b, b)) + np.where(np.eye(len(b)), np.inf, 0)) for b in self.books]

    def cut(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half :]] if x.shape[1] > 1 else [x, np.zeros((len(x), 1))]

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For both halves: the nearest codeword, and squared lower bounds to each codeword's region."""
        own, low = [], []
        for h, book, apart in zip(self.cut(x), self.books, self.apart, strict=True):
            d = distances(h, book)
            near = d.argmin(1)
            gap = (d - d[np.arange(len(d)), near][:, None]) * apart[near]
            own.append(near)
            low.append(np.where(np.isfinite(gap), np.maximum(gap, 0), 0) ** 2)
        return own, low

    def visits(self, x: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own cell of each row, row of each visit, cell of each visit), rows' visits by ascending bound."""
        own, low = self.bounds(x)
        order = [np.argsort(v, axis=1, kind="stable") for v in low]
        sorted_ = [np.take_along_axis(v, o, 1) for v, o in zip(low, order, strict=True)]
        wide = len(self.books[1])
        rows, cells, bound = [], [], []
        for i in range(sorted_[0].shape[1]):  # a step down the first list; down the second as far as the sum allows
            live = np.flatnonzero(sorted_[0][:, i] <= most)
            if not len(live):
                break
            for j in range(wide):
                total = sorted_[0][live, i] + sorted_[1][live, j]
                live, total = live[total <= most], total[total <= most]
                if not len(live):
                    break
                rows.append(live)
                cells.append(order[0][live, i] * wide + order[1][live, j])
                bound.append(total)
        row, cell, total = np.concatenate(rows), np.concatenate(cells), np.concatenate(bound)
        by = np.lexsort((total, row))
        return own[0] * wide + own[1], row[by], cell[by]

    def until(self, x: np.ndarray, cosine: float, recall: float) -> float:
        """The bound at which a traversal has met the wanted share of neighbours at this cosine."""
        rng = np.random.default_rng(7)
        aside = rng.normal(size=x.shape)
        aside -= (aside * x).sum(1, keepdims=True) * x
        length = np.sqrt((aside**2).sum(1, keepdims=True))
        ok = length[:, 0] > 1e-9
        if recall >= 1 or not ok.any():
            return 2 - 2 * cosine + 1e-9
        x, aside = x[ok], (aside / np.maximum(length, 1e-12))[ok]
        _, low = self.bounds(x)
        at, _ = self.bounds(cosine * x + np.sqrt(1 - cosine**2) * aside)
        need = sum(b[np.arange(len(x)), a] for b, a in zip(low, at, strict=True))
        return min(float(np.quantile(need, recall)) + 1e-9, 2 - 2 * cosine + 1e-9)


def tile_links(group: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links, least reached id) of a tile's queries against its filed vectors.

    Queries from other cells count for the filed vectors too; those filed in the cell itself don't,
    as each of such a pair is a query.
    """
    filed, home = (group[c].to_numpy(zero_copy_only=False) for c in ("_filed", "_home"))
    ids, weight, dim = group["_id"].to_numpy(), group["_weight"].to_numpy(), group["_dim"][0].as_py()
    raw = group["_vec"].to_pylist()
    x = unit(raw, dim)
    q, f = np.flatnonzero(~filed), np.flatnonzero(filed)
    close = x[q] @ x[f].T >= cosine - 1e-12
    i, j = np.nonzero(close)
    # sums near the wanted cosine are repeated without a matrix product's rounding
    edge = np.abs((x[q[i]] * x[f[j]]).sum(1) - cosine) < 1e-9
    if edge.any():
        a, b = (np.stack([np.frombuffer(raw[k], np.float64) for k in side]) for side in (q[i[edge]], f[j[edge]]))
        exact = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
        close[i[edge], j[edge]] = exact >= cosine
    close &= ids[q][:, None] != ids[f][None]
    every, place = np.unique(ids, return_inverse=True)
    linked = np.zeros((len(every), len(every)), bool)
    a, b = np.nonzero(close)
    linked[place[q[a]], place[f[b]]] = linked[place[f[b]], place[q[a]]] = True
    least = every[reach(linked)]
    guests = ~home[q]
    return np.r_[ids[q], ids[f]], np.r_[close @ weight[f], close[guests].T @ weight[q][guests]], np.r_[least[place[q]], least[place[f]]]


def embedding_links(vectors: DataFrame, cosine: float = 0.98, sample: int = 20_000, words: int | None = None, recall: float = 1.0, tile: int = 512, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    words: codewords a half; by default so many that a cell holds about 200 vectors of a label, 4 to 2,048.
    recall: 1 meets all pairs; less is a share of pairs at exactly the wanted cosine, in random directions.
    label_col: only vectors with equal, not null labels link; None compares all.
    """
    v = F.col(vec_col).cast("array<double>")
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), label.alias("_label"), v.alias("_v"))
    fine = F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_v").isNotNull() & F.coalesce(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("_v", lambda x: x != 0), F.lit(False))
    known = rows.where(fine).groupBy("_id").agg(F.min(F.struct("_label", "_v")).alias("_s")).select("_id", "_s.*")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) + 0.0 for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in vecs], pa.int32()), pa.array([x.tobytes() for x in vecs], pa.binary())], names=["_id", "_label", "_dim", "_vec"])

    packed = cut(known.mapInArrow(pack, "_id long, _label string, _dim int, _vec binary"))
    members = cut(packed.groupBy("_label", "_dim", "_vec").agg(F.min("_id").alias("_id"), F.count("*").alias("_weight")))
    books: dict[int, tuple[MultiIndex, float]] = {}
    if not words:
        # cells are compared label by label: what counts is the size of a vector's label, on average
        sizes = members.groupBy("_label", "_dim").agg(F.count("*").cast("double").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n")).first()["n"] or 0
        words = int(np.clip(round((sizes / 200) ** 0.5), 4, 2048))
    chosen = members.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    picked = members.select("_dim", "_vec", "_id").join(F.broadcast(chosen), "_id").toArrow().sort_by("_id")
    dims = [r[0] for r in members.select("_dim").distinct().collect()]  # each length has a codebook
    for dim in dims:
        own = [x for x, d in zip(picked["_vec"].to_pylist(), picked["_dim"].to_pylist(), strict=True) if d == dim]
        if not own:
            own = [r[0] for r in members.where(F.col("_dim") == dim).select("_vec").limit(1).collect()]
        x = unit(own, dim)
        index = MultiIndex(x, words)
        books[dim] = index, index.until(x[:8000], cosine, recall)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                part = whole.slice(start, 2000)
                dim_of = part.column(1).to_numpy()
                for dim in np.unique(dim_of):
                    batch = part.filter(pa.array(dim_of == dim))
                    index, most = shared.value[int(dim)]
                    own, row, cell = index.visits(unit(batch.column(2).to_pylist(), int(dim)), most)
                    row, cell = row[cell >= own[row]], cell[cell >= own[row]]
                    n = batch.num_rows
                    take = batch.take(pa.array(np.r_[np.arange(n), row]))
                    filed, home = np.r_[np.ones(n, bool), np.zeros(len(row), bool)], np.r_[np.ones(n, bool), cell == own[row]]
                    yield pa.RecordBatch.from_arrays([take.column(0), take.column(1), pa.array(np.r_[own, cell]), pa.array(filed), pa.array(home), take.column(3), take.column(4)], names=["_label", "_dim", "_cell", "_filed", "_home", "_id", "_weight"])

    filed = cut(members.select("_label", "_dim", "_vec", "_id", "_weight").mapInArrow(file, "_label string, _dim int, _cell long, _filed boolean, _home boolean, _id long, _weight long"))
    cell = ["_label", "_dim", "_cell"]
    counts = filed.groupBy(*cell).agg(F.count_if(F.col("_filed")).alias("_f"), F.count_if(~F.col("_filed")).alias("_q"))
    # cells that hold nothing, or nothing but their only visitor, need no look
    counts = counts.where("_f > 0 and _q > 0 and not (_f = 1 and _q = 1)").select(*cell, F.ceil(F.col("_f") / tile).cast("int").alias("_ft"), F.ceil(F.col("_q") / tile).cast("int").alias("_qt"))
    placed = filed.join(counts.hint("merge"), cell)
    mine = lambda n: F.pmod(F.xxhash64("_id", F.lit(5)), F.col(n)).cast("int")
    as_filed = placed.where("_filed").select("*", mine("_ft").alias("_a"), F.explode(F.sequence(F.lit(0), F.col("_qt") - 1)).alias("_b"))
    as_query = placed.where("not _filed").select("*", F.explode(F.sequence(F.lit(0), F.col("_ft") - 1)).alias("_a"), mine("_qt").alias("_b"))
    tiles = as_filed.unionByName(as_query).join(members.select("_id", "_vec").hint("merge"), "_id").select(*cell, "_a", "_b", "_filed", "_home", "_id", "_weight", "_vec")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 5):
            if group.num_rows > 1 and 0 < group["_filed"].to_numpy(zero_copy_only=False).sum() < group.num_rows:
                ids, links, least = tile_links(group, cosine)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links, pa.int64()), pa.array(least)], names=["_id", "_links", "_least"]).filter(pa.array(links > 0))

    ordered = tiles.repartition(*cell, "_a", "_b").sortWithinPartitions(*cell, "_a", "_b")
    verified = cut(ordered.mapInArrow(verify, "_id long, _links long, _least long"))
    links = verified.groupBy("_id").agg(F.sum("_links").alias("_links"))
    parts = components(verified.select(F.col("_id").alias("u"), F.col("_least").alias("v")))
    found = members.join(links.hint("merge"), "_id", "left").join(parts.withColumnRenamed("node", "_id").hint("merge"), "_id", "left")
    found = found.select("_label", "_dim", "_vec", (F.col("_weight") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"), F.coalesce("component", "_id").alias("component_id"))
    spread = found.where("n_links > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_salt"))
    chosen = packed.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(16)).cast("int")).join(spread.hint("merge"), ["_label", "_dim", "_vec", "_salt"]).select("_id", "n_links", "component_id")
    return rows.select("_id").join(chosen.hint("merge"), "_id", "left").select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("_id"), F.lit(True)).alias("kept"),
    )
