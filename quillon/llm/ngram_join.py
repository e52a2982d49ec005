"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them.

1. Every whole text becomes the set of hashes of its runs of n words; from the set come its
   digest and its band hashes.  Bands and rows are chosen so that a pair at the threshold
   shares a band with probability ``recall`` or more.  Texts with one and the same set are one
   class member from here on, with their number as weight.
2. Members that share a band hash are linked to the least of them, by salted parts of the
   bucket and then over the parts, so that a bucket with a third of all rows is no task's alone.
   Connected parts of these links are candidate groups.
3. Members of candidate groups send their full sets to square tiles of their group, each of at
   most about ``tile`` members a side; a tile compares sets exactly and returns link counts and a
   spanning forest of links, never pairs.  Groups of more than one tile are cut into classes of
   set size first, each a factor of 1/threshold wide; similar sets lie in one class or in
   neighbouring ones, so other classes never meet.  All other pairs of a candidate group are
   compared, so links that no band found are found as well.
4. Links' connected parts are the classes; the smallest identifier stands for each.

Words are maximal runs of letters, digits and non-ASCII characters in lower case.  A text of
fewer than n words has one shingle, of all its words.

Results in special cases: null, empty and wordless texts link with nothing.  Rows with a null
identifier link with nothing and are their own class (null).  Rows that repeat an identifier
are one document, that with the smallest set digest; each gets its result.  Equal texts are
links of each other.  An empty table gives an empty result.  Only named columns are read.
Identifiers are whole numbers, or text of such; others raise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import components, cut, groups, reach

_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE = np.random.default_rng(29).integers(0, 2**64, 256, dtype=np.uint64)
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
SALTS = 64
#: Tiles of a size class are numbered from its number times this.
SIDES = 1 << 40


def plan_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows with which ``most`` hashes reach the recall at the threshold."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    return most, 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, all in one array; the size of each set."""
    data = [t.lower().encode(errors="replace") + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8)
    inside = _WORD[raw]
    start = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    stop = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    edges = np.searchsorted(start, np.cumsum(np.fromiter(map(len, data), np.int64, len(data))))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(raw), _P)])
        total = np.r_[np.uint64(0), np.cumsum(_BYTE[raw] * power[:-1])]
        word = mixed((total[stop] - total[start]) * np.cumprod(np.r_[np.uint64(1), np.full(len(raw), _INV)])[start])
        run = np.zeros(len(word), np.uint64)
        for k in range(min(n, len(word))):
            run[: len(word) - k] = run[: len(word) - k] * _P + word[k:]
        run = mixed(run)
    out, sizes = [], []
    for a, b in zip(np.r_[0, edges[:-1]], edges, strict=True):
        if b - a >= n:
            own = np.unique(run[a : b - n + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                own = mixed(np.array([sum(int(w) * pow(31, k, 2**64) for k, w in enumerate(word[a:b])) % 2**64], np.uint64) + np.uint64(b - a))
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        sizes.append(len(own))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(sizes, np.int64)


def band_hashes(flat: np.ndarray, sizes: np.ndarray, bands: int, rows: int, seed: int = 3) -> np.ndarray:
    """(texts x bands) hashes of MinHash rows; texts without shingles get zeros."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(sizes), bands), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    first = (np.cumsum(sizes) - sizes)[full]
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(full), np.uint64(band + 1))
            for _ in range(rows):
                a, b = rng.integers(1, 2**63, 2, dtype=np.uint64)
                h = flat * (a | np.uint64(1)) + b
                h ^= h >> np.uint64(32)
                h *= _P
                key = mixed(key + np.minimum.reduceat(h, first))
            out[full, band] = key
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(_id, _d1, _d2, _n, _bands) of docs (_id, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(1), 2_000_000):
                flat, sizes = shingle_sets(texts, n)
                keys = band_hashes(flat, sizes, bands, rows)
                digests = np.zeros((2, len(sizes)), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    first = (np.cumsum(sizes) - sizes)[full]
                    with np.errstate(over="ignore"):
                        digests[0, full] = np.add.reduceat(mixed(flat), first)
                        digests[1, full] = np.add.reduceat(mixed(flat ^ _P), first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), *(pa.array(d.view(np.int64)) for d in digests), pa.array(sizes), pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))],
                    names=["_id", "_d1", "_d2", "_n", "_bands"],
                )

    return docs.mapInArrow(run, "_id long, _d1 long, _d2 long, _n long, _bands array<long>")


def star(members: DataFrame, key: list[str]) -> DataFrame:
    """Edges (u, v) that connect all members (_id) of every key, in salted parts."""
    part = Window.partitionBy(*key, "_salt")
    parts = members.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS))).withColumn("_m", F.min("_id").over(part))
    inside = parts.where("_id <> _m").select(F.col("_id").alias("u"), F.col("_m").alias("v"))
    heads = parts.where("_id = _m").select(*key, "_id").withColumn("_m", F.min("_id").over(Window.partitionBy(*key)))
    return inside.unionByName(heads.where("_id <> _m").select(F.col("_id").alias("u"), F.col("_m").alias("v")))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    out = np.zeros((n, n), np.float32)
    if len(column):
        kept = np.unique(column)
        column = np.searchsorted(kept, column)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for a in range(0, len(kept), 4096):
            lo, hi = np.searchsorted(column, [a, a + 4096])
            block = np.zeros((n, min(4096, len(kept) - a)), np.float32)
            block[owner[lo:hi], column[lo:hi] - a] = 1
            out += block @ block.T
    return out


def tile_links(group: pa.Table, threshold: float) -> tuple[np.ndarray, ...]:
    """(ids, links, least linked id) of one tile's members."""
    side_a, side_b = group["_a"][0].as_py(), group["_b"][0].as_py()
    ids, tile, weight = (group[c].to_numpy() for c in ("_id", "_tile", "_weight"))
    sets = [np.frombuffer(s.as_py(), np.uint64) for s in group["_set"]]
    size = np.array([len(s) for s in sets], float)
    inter = overlaps(sets)
    linked = inter >= threshold * (size[:, None] + size[None] - inter) - 1e-6
    np.fill_diagonal(linked, False)
    if side_a != side_b:
        linked &= tile[:, None] != tile[None]
    order = np.argsort(ids, kind="stable")
    least = np.empty(len(ids), np.int64)
    least[order] = ids[order][reach(linked[np.ix_(order, order)])]
    return ids, linked @ weight, least


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, tile: int = 96, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_links, class_id, kept.

    n_links: other documents whose Jaccard similarity is at least the threshold.
    """
    bands, rows = plan_bands(threshold, recall)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    every = cut(signatures(texts, n, bands, rows))
    known = every.where("_id is not null and _n > 0").groupBy("_id").agg(F.min(F.struct("_d1", "_d2", "_n", "_bands")).alias("_s")).select("_id", "_s.*")
    members = cut(known.groupBy("_d1", "_d2").agg(F.min("_id").alias("_id"), F.count("*").alias("_weight"), F.first("_n").alias("_n"), F.first("_bands").alias("_bands")))
    buckets = members.select("_id", F.posexplode("_bands").alias("_band", "_key"))
    comps = components(star(buckets, ["_band", "_key"]))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("_salt")
    placed = comps.select(F.col("node").alias("_id"), F.col("component").alias("_g"), salt).join(members.select("_id", "_weight", "_d1", "_n").hint("merge"), "_id")
    # a class is a hair wider than the factor, so that rounding never parts similar sets by two
    step = max(math.log(1 / threshold) * (1 + 1e-9), 1e-3)
    placed = cut(placed.withColumn("_c", F.floor(F.ln("_n") / step).cast("int")))
    counts = placed.groupBy("_g", "_c").agg(F.ceil(F.count("*") / tile).cast("int").alias("_own"), F.count("*").alias("_k"))
    by_class = Window.partitionBy("_g").orderBy("_c")
    beside = lambda k: F.when(F.col("_large"), F.coalesce(F.sum("_own").over(by_class.rangeBetween(k, k)), F.lit(0))).otherwise(0).cast("int")
    per = counts.withColumn("_large", F.sum("_k").over(Window.partitionBy("_g")) > tile)
    per = per.select("_g", "_c", F.when(F.col("_large"), F.col("_c")).otherwise(0).alias("_class"), F.when(F.col("_large"), F.col("_own")).otherwise(1).alias("_own"), beside(-1).alias("_before"), beside(1).alias("_after"))
    per = per.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    placed = placed.join(per.hint("merge"), ["_g", "_c", "_salt"])
    placed = placed.withColumn("_tile", F.col("_class") * F.lit(SIDES) + F.pmod(F.xxhash64("_id", F.lit(1)), F.col("_own")))

    kept = ["_id", "_g", "_tile", "_class", "_own", "_before", "_after", "_weight"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column(0), 1_000_000):
                flat, sizes = shingle_sets(part, n)
                with np.errstate(over="ignore"):
                    first = np.cumsum(sizes) - sizes
                    digest = np.array([int(mixed(flat[a : a + k]).sum(dtype=np.uint64)) for a, k in zip(first, sizes, strict=True)], np.uint64).view(np.int64)
                values = pa.array([flat[a : a + k].tobytes() for a, k in zip(first, sizes, strict=True)], pa.binary())
                rest = batch.slice(start, len(part))
                right = pa.array(digest == rest.column(9).to_numpy())
                yield pa.RecordBatch.from_arrays([*(rest.column(k) for k in range(1, 9)), values], names=[*kept, "_set"]).filter(right)

    own = texts.join(placed.hint("merge"), "_id").select("_text", *kept, "_d1")
    full = own.mapInArrow(sets, "_id long, _g long, _tile long, _class int, _own int, _before int, _after int, _weight long, _set binary")
    sides = lambda n, k: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i + (F.col("_class") + k) * F.lit(SIDES))).otherwise(F.array().cast("array<long>"))
    others = F.concat(sides(F.col("_own"), 0), sides(F.col("_before"), -1), sides(F.col("_after"), 1))
    full = full.select("*", F.explode(others).alias("_other"))
    full = full.select("_g", F.least("_tile", "_other").alias("_a"), F.greatest("_tile", "_other").alias("_b"), "_id", "_tile", "_weight", "_set")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            ids, links, least = tile_links(group, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links, pa.int64()), pa.array(least)], names=["_id", "_links", "_least"])

    tiles = full.repartition("_g", "_a", "_b").sortWithinPartitions("_g", "_a", "_b", "_id")
    verified = cut(tiles.mapInArrow(verify, "_id long, _links long, _least long").where("_links > 0"))
    links = verified.groupBy("_id").agg(F.sum("_links").alias("_links"))
    classes = components(verified.select(F.col("_id").alias("u"), F.col("_least").alias("v")))
    found = members.select("_d1", "_d2", "_id", "_weight").join(links.hint("merge"), "_id", "left").join(classes.withColumnRenamed("node", "_id").hint("merge"), "_id", "left")
    found = found.select("_d1", "_d2", (F.col("_weight") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"), F.coalesce("component", "_id").alias("class_id"))
    # back to the rows: classes of one document need no join on a digest that others share
    spread = found.where("n_links > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_salt"))
    chosen = known.select("_id", "_d1", "_d2", F.pmod(F.xxhash64("_id"), F.lit(16)).cast("int").alias("_salt")).join(spread.hint("merge"), ["_d1", "_d2", "_salt"]).select("_id", "n_links", "class_id")
    return every.select("_id").join(chosen.hint("merge"), "_id", "left").select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_id", "_id").alias("class_id"),
        F.coalesce(F.col("class_id") == F.col("_id"), F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stand for their class, all columns as they were."""
    gone = jaccard_classes(docs, id_col=id_col, text_col=text_col, **how).where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs[id_col] == gone["_gone"], "left_anti")
