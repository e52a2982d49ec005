"""Removal of repeated byte strings by a sparse suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a document
with a smaller identifier or further left in the same one.

Only suffixes at anchors are sorted.  The anchor of a string is its leftmost k-byte piece with
the least hash, so equal strings have their anchors at equal offsets, and neighbouring strings
share them: about one suffix in 39 is left, without losing any match.  An anchor owns the
strings whose anchor it is.

1. Anchors of all texts are range-partitioned by their suffixes' leading eight bytes, with
   splitters from a sample.  Chunks first drop anchors whose whole reach (all bytes of the owned
   strings) is met earlier in the chunk, so many copies of one passage become one row a chunk.
2. Buckets sort by anchor.  An anchor met once is done.  Of equal reaches the earliest stays;
   the others' strings all repeat.  Anchors with several reaches are open.
3. Open anchors fetch their reach's bytes and are range-partitioned again.  Buckets sort the
   owned strings by multikey quicksort: groups are split by one token after the other (20 bytes,
   as 64-bit fingerprints) and drop out as soon as they hold one string.  All but the earliest
   of a group repeat.
4. Anchors with more than ``hot`` reaches are compared across all buckets instead, each of
   their strings in the bucket of its own hash, after every task has kept only its earliest
   of equal strings.  Anchors that a sample of documents expects to be hot never meet in one
   bucket at all: already in step 1 their reaches are dealt by their own hashes.
5. Marked intervals meet their documents, which are cut.

Copies of a whole text are marked by the exact dedup operator.

Results in special cases: a null text is empty; texts shorter than ``length`` hold no string of
that length and lose nothing.  A null identifier comes after all
others.  Rows that repeat identifier and text are one document, each gets its result; of
different texts with one identifier the one with the smaller SHA-256 (its first 28 bits, which
are also what tells the two apart) counts as earlier.  An
empty table gives an empty result.  Only named columns are read.  Identifiers are whole numbers, or
text of such; others raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole, width
from .exact_dedup import exact_dedup

K = 24
CHUNK = 500_000
#: Anchors that a task compares among themselves before it deals them out.
HELD = 60_000
#: Bytes of hot anchors' reaches that a task compares among themselves before it deals them out.
REACHES = 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE = np.random.default_rng(41).integers(0, 2**64, 256, dtype=np.uint64)
_LAST = 2**63 - 1
ANCHOR = np.dtype([("kmer", "<u8"), ("full", "<u8"), ("did", "<i8"), ("tie", "<i4"), ("pos", "<u4"), ("left", "u1"), ("right", "u1")])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes:
    """Fingerprints of any pieces of a byte array, from prefix sums."""

    power = inverse = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray):
        if len(Hashes.power) <= len(raw):
            with np.errstate(over="ignore"):
                Hashes.power, Hashes.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(len(raw) + CHUNK // 4, p)]) for p in (_P, _INV))
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), np.cumsum(_BYTE[raw] * Hashes.power[: len(raw)])]

    def pieces(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[stop] - self.sums[start]) * Hashes.inverse[start])

    def every(self, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[size:] - self.sums[:-size]) * Hashes.inverse[: len(self.sums) - size])


def chunks(rows: Iterator[tuple[int, int, bytes]], length: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of (did, tie, offset, bytes) of about CHUNK bytes; long texts in parts that overlap by length - 1."""
    held: list = []
    size = 0
    for did, tie, text in rows:
        for a in range(0, max(1, len(text) - length + 1), CHUNK):
            part = text[a : a + CHUNK + length - 1]
            if len(part) < length:
                continue
            held.append((did, tie, a, part))
            size += len(part)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchors(parts: list[tuple[int, int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(ANCHOR rows, leading eight bytes) of the parts, in order."""
    raw = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    hashes = Hashes(raw)
    kmer = hashes.every(K)
    bits = np.uint64((1 << 24) - 1)
    value = (kmer & ~bits) | np.arange(len(kmer), dtype=np.uint64)
    span, have = length - K + 1, 1
    while have * 2 <= span:
        value = np.minimum(value[:-have], value[have:])
        have *= 2
    if have < span:
        value = np.minimum(value[: len(value) - (span - have)], value[span - have :])
    sizes = np.array([len(p[3]) for p in parts])
    base = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    starts = np.arange(int(count.sum())) + np.repeat(base - (np.cumsum(count) - count), count)
    owner = np.repeat(np.arange(len(parts)), count)
    at = (value[starts] & bits).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[new[1:], len(at)] - 1
    pos, low, high, who = at[new], starts[new], starts[last], owner[new]
    out = np.zeros(len(new), ANCHOR)
    out["kmer"] = kmer[pos]
    out["left"], out["right"] = pos - low, high - low
    with np.errstate(over="ignore"):
        out["full"] = mixed(hashes.pieces(low, high + length) + out["left"].astype(np.uint64) * _P + out["right"])
    for name, k in (("did", 0), ("tie", 1)):
        out[name] = np.array([p[k] for p in parts], np.int64)[who]
    out["pos"] = pos - base[who] + np.array([p[2] for p in parts])[who]
    lead = np.zeros(len(pos), np.uint64)
    for k in range(8):
        lead = (lead << np.uint64(8)) | raw[pos + k]
    return out, lead


def repeats(first: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Whether rows in groups, each in order of place, lie elsewhere than the group's first (repeated rows don't)."""
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return np.any([p != p[head] for p in place], axis=0) if len(first) else first


def earliest(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by anchor, reach and place; whether each is the first of its anchor and reach; whether it repeats that)."""
    order = np.lexsort((rows["pos"], rows["tie"], rows["did"], rows["full"], rows["kmer"]))
    r = rows[order]
    first = np.r_[True, (r["kmer"][1:] != r["kmer"][:-1]) | (r["full"][1:] != r["full"][:-1])][: len(r)]
    return order, first, repeats(first, r["did"], r["tie"], r["pos"])


def marks_of(rows: np.ndarray, length: int, parts: int = 0) -> pa.RecordBatch:
    """Marks over all strings that the rows own, strings that follow each other in one mark.

    parts: to be dealt to so many buckets, by place, as very many marks may be of one passage.
    """
    start = rows["pos"].astype(np.int64) - rows["left"]
    order = np.lexsort((start, rows["tie"], rows["did"]))
    did, tie, start = rows["did"][order], rows["tie"][order], start[order]
    last = start + rows["right"][order]
    edge = np.flatnonzero(np.r_[True, (did[1:] != did[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > last[:-1] + 1)])[: len(rows)]
    end = np.r_[edge[1:], len(rows)][: len(edge)] - 1
    with np.errstate(over="ignore"):
        pid = (mixed(did[edge].astype(np.uint64) * _P + start[edge].astype(np.uint64)) % np.uint64(parts)).astype(np.int32) if parts else None
    return mark_batch(did[edge], tie[edge], start[edge], last[end] - start[edge] + length, pid)


SCHEMA = "pid int, did long, tie long, start long, size long, blob binary"
#: What a blob holds: one anchor with the bytes of its reach, or rows of single strings.
REACH, STRINGS = b"r", b"s"
NAMES = ["pid", "did", "tie", "start", "size", "blob"]


def mark_batch(did: np.ndarray, tie: np.ndarray, start: np.ndarray, size: np.ndarray, pid: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(did)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32) if pid is None else pid), pa.array(did), pa.array(tie.astype(np.int64)), pa.array(start.astype(np.int64)), pa.array(size.astype(np.int64)), pa.nulls(n, pa.binary())], names=NAMES)


def blob_batch(pids: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    none = pa.nulls(len(pids), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), none, none, none, none, pa.array(blobs, pa.binary())], names=NAMES)


def same_strings(rows: np.ndarray, key: np.ndarray, text: list[bytes], length: int, token: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset in its reach) of owned strings that an earlier one equals.

    Multikey quicksort of all owned strings: the first key is the anchor with the string's
    offset to it, then come the string's tokens from the left.
    """
    raw = np.frombuffer(b"".join(text), np.uint8)
    hashes = Hashes(raw)
    sizes = np.array([len(t) for t in text])
    base = np.cumsum(sizes) - sizes
    count = rows["right"].astype(np.int64) + 1
    row = np.repeat(np.arange(len(rows)), count)
    off = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = base[row] + off
    with np.errstate(over="ignore"):
        split = mixed(key[row] + (rows["left"][row].astype(np.int64) - off).astype(np.uint64) * _P)
    group = np.zeros(len(row), np.int64)
    for a in range(-token, length, token):
        value = split if a < 0 else hashes.pieces(start + a, start + min(a + token, length))
        order = np.lexsort((value, group))
        group, value, row, off, start = group[order], value[order], row[order], off[order], start[order]
        edge = np.r_[True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])][: len(group)]
        group = np.cumsum(edge)
        more = np.bincount(group, minlength=1)[group] > 1
        group, row, off, start = group[more], row[more], off[more], start[more]
    place = rows["pos"][row].astype(np.int64) - rows["left"][row] + off
    order = np.lexsort((place, rows["tie"][row], rows["did"][row], group))
    group, row, off = group[order], row[order], off[order]
    first = np.r_[True, group[1:] != group[:-1]][: len(group)]
    later = repeats(first, rows["did"][row], rows["tie"][row], place[order])
    return row[later], off[later]


def own_strings(rows: np.ndarray, text: list[bytes], length: int) -> np.ndarray:
    """ANCHOR rows of all strings that the rows own: kmer and full together are 128 bits of the string, pos its start."""
    hashes = Hashes(np.frombuffer(b"".join(text), np.uint8))
    sizes = np.array([len(t) for t in text])
    count = rows["right"].astype(np.int64) + 1
    row = np.repeat(np.arange(len(rows)), count)
    off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(sizes) - sizes)[row] + off
    out = np.zeros(len(row), ANCHOR)
    out["kmer"] = hashes.pieces(start, start + length)
    with np.errstate(over="ignore"):
        out["full"] = mixed(hashes.pieces(start, start + length // 2) * _P + hashes.pieces(start + length // 2, start + length))
    out["did"], out["tie"] = rows["did"][row], rows["tie"][row]
    out["pos"] = rows["pos"][row] - rows["left"][row] + off
    return out


def dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.repartitionById(parts, F.col("pid")) if hasattr(df, "repartitionById") else df.repartition(parts, "pid")


def survey(docs: DataFrame, parts: int, length: int, hot: int, sample: int = 20_000, least: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(leading bytes that cut the anchors into equal parts, anchors expected in more than ``hot`` documents).

    Both from a sample of documents; no anchor counts as hot that fewer than ``least`` of them hold.
    """
    picked = docs.select("did").orderBy(F.xxhash64("did"), "did").limit(sample).distinct()
    texts = docs.join(F.broadcast(picked), "did").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (t.encode() for batch in batches for t in batch.column(0).to_pylist())
        for part in chunks(((k, 0, t) for k, t in enumerate(texts)), length):
            rows, lead = anchors(part, length)
            at = np.lexsort((rows["kmer"], rows["did"]))
            at = at[np.r_[True, (np.diff(rows["did"][at]) != 0) | (np.diff(rows["kmer"][at]) != 0)][: len(at)]]
            yield pa.RecordBatch.from_arrays([pa.array(rows["kmer"][at].view(np.int64)), pa.array(lead[at].view(np.int64))], names=["kmer", "lead"])

    found = cut(texts.mapInArrow(run, "kmer long, lead long"))
    rows = docs.count()
    need = max(least, int(hot * min(1.0, sample / max(rows, 1))))
    often = found.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") > need).select("kmer").toArrow()["kmer"].to_numpy()
    few = found.orderBy(F.rand(5)).select("lead").limit(50_000).toArrow()["lead"].to_numpy()
    lead = np.sort(few.astype(np.int64).view(np.uint64)) if len(few) else np.zeros(1, np.uint64)
    return lead[(np.arange(1, parts) * len(lead) // parts)], np.sort(often.astype(np.int64).view(np.uint64))


def repeated(texts: DataFrame, length: int, hot: int) -> DataFrame:
    """Marks (did, tie, start, size) of strings that start earlier, for texts (did, tie, text)."""
    spark = texts.sparkSession
    parts = width(spark)
    cuts, known = survey(texts, parts, length, hot)

    def pid_of(lead: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, lead, side="right")

    def is_hot(kmer: np.ndarray) -> np.ndarray:
        return known[np.minimum(np.searchsorted(known, kmer), len(known) - 1)] == kmer if len(known) else np.zeros(len(kmer), bool)

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py().encode()

    def deal(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows, lead = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        order, first, again = earliest(rows)
        yield marks_of(rows[order[again]], length, parts)
        rows, pid = rows[order[first]], pid_of(lead[order[first]])
        pid = np.where(is_hot(rows["kmer"]), rows["full"] % np.uint64(parts), pid).astype(np.int64)
        by = np.argsort(pid, kind="stable")
        rows, pid = rows[by], pid[by]
        edge = np.flatnonzero(np.r_[True, pid[1:] != pid[:-1]])
        yield blob_batch(pid[edge].tolist(), [rows[a:b].tobytes() for a, b in zip(edge, np.r_[edge[1:], len(rows)], strict=True)])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for part in chunks((row for batch in batches for row in rows_of(batch)), length):
            held.append(anchors(part, length))
            if sum(len(h[0]) for h in held) >= HELD:
                yield from deal(held)
                held = []
        if held:
            yield from deal(held)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in batches:
            passed = batch.filter(batch.column(5).is_null())
            if passed.num_rows:
                yield mark_batch(*(passed.column(k).to_numpy() for k in range(1, 5)))
            blobs += batch.column(5).drop_null().to_pylist()
        rows = np.frombuffer(b"".join(blobs), ANCHOR)
        del blobs
        order, first, again = earliest(rows)
        yield marks_of(rows[order[again]], length)
        rows = rows[order[first]]
        edge = np.flatnonzero(np.r_[True, rows["kmer"][1:] != rows["kmer"][:-1]])[: len(rows)]
        size = np.diff(np.r_[edge, len(rows)])
        many = np.where(is_hot(rows["kmer"]), max(hot, 1) + 1, np.repeat(size, size))
        rows, many = rows[many > 1], many[many > 1]
        for a in range(0, len(rows), 20_000):
            r = rows[a : a + 20_000]
            n = len(r)
            yield pa.RecordBatch.from_arrays([pa.array((many[a : a + n] > hot).astype(np.int32)), pa.array(r["did"]), pa.array(r["tie"].astype(np.int64)), pa.array(r["pos"].astype(np.int64)), pa.nulls(n, pa.int64()), pa.array([x.tobytes() for x in r], pa.binary())], names=NAMES)

    settled = cut(dealt(texts.mapInArrow(sample, SCHEMA), parts).mapInArrow(settle, SCHEMA))
    open_ = settled.where("pid >= 0").groupBy("did").agg(F.collect_list(F.struct("pid", "blob")).alias("open"))

    def deal_strings(rows: list[np.ndarray], reaches: list[bytes]) -> Iterator[pa.RecordBatch]:
        strings = own_strings(np.concatenate(rows), reaches, length)
        order, first, again = earliest(strings)
        yield marks_of(strings[order[again]], length, parts)
        strings = strings[order[first]]
        pid = (strings["kmer"] % np.uint64(parts)).astype(np.int64)
        by = np.argsort(pid, kind="stable")
        strings, pid = strings[by], pid[by]
        edge = np.flatnonzero(np.r_[True, pid[1:] != pid[:-1]])
        yield blob_batch(pid[edge].tolist(), [STRINGS + strings[a:b].tobytes() for a, b in zip(edge, np.r_[edge[1:], len(strings)], strict=True)])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        reaches: list[bytes] = []
        size = 0
        for batch in batches:
            found: dict[int, list[bytes]] = {}
            for i in range(batch.num_rows):
                tie, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().encode()
                for item in batch.column(2)[i].as_py():
                    row = np.frombuffer(item["blob"], ANCHOR)
                    if row["tie"][0] != tie:
                        continue
                    low = int(row["pos"][0]) - int(row["left"][0])
                    reach = text[low : low + int(row["right"][0]) + length]
                    if item["pid"]:  # hot
                        rows.append(row)
                        reaches.append(reach)
                        size += len(reach)
                        if size >= REACHES:
                            yield from deal_strings(rows, reaches)
                            rows, reaches, size = [], [], 0
                    else:
                        lead = int.from_bytes(text[int(row["pos"][0]) : int(row["pos"][0]) + 8], "big")
                        found.setdefault(int(pid_of(np.array([lead], np.uint64))[0]), []).append(REACH + row.tobytes() + reach)
            yield blob_batch([p for p, b in found.items() for _ in b], [x for b in found.values() for x in b])
        if rows:
            yield from deal_strings(rows, reaches)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, single = [], []
        for batch in batches:
            passed = batch.filter(batch.column(5).is_null())
            if passed.num_rows:
                yield mark_batch(*(passed.column(k).to_numpy() for k in range(1, 5)))
            for b in batch.column(5).drop_null().to_pylist():
                (single if b[:1] == STRINGS else blobs).append(b[1:])
        strings = np.frombuffer(b"".join(single), ANCHOR)
        del single
        order, first, again = earliest(strings)
        yield marks_of(strings[order[again]], length)
        del strings, order, first, again
        rows = np.frombuffer(b"".join(b[: ANCHOR.itemsize] for b in blobs), ANCHOR)
        order = np.argsort(rows["kmer"], kind="stable")
        # groups of one anchor stay together; slices of about so many strings are sorted at a time
        total = np.cumsum(rows["right"][order].astype(np.int64) + 1)
        edge = np.flatnonzero(np.r_[True, rows["kmer"][order][1:] != rows["kmer"][order][:-1]])[: len(rows)]
        a = 0
        while a < len(rows):
            goal = (total[a - 1] if a else 0) + 400_000
            b = int(np.searchsorted(total, goal))
            nxt = edge[edge >= max(b, a + 1)]
            b = int(nxt[0]) if len(nxt) else len(rows)
            pick = order[a:b]
            own = rows[pick]
            row, off = same_strings(own, own["kmer"], [blobs[i][ANCHOR.itemsize :] for i in pick], length)
            by = np.lexsort((off, row))
            row, off = row[by], off[by]
            begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1)])[: len(row)]
            end = np.r_[begin[1:], len(row)][: len(begin)] - 1
            r = own[row[begin]]
            yield mark_batch(r["did"], r["tie"], r["pos"].astype(np.int64) - r["left"] + off[begin], off[end] - off[begin] + length)
            a = b

    joined = texts.repartition(parts, "did").join(open_.hint("merge"), "did").select("tie", "text", "open")
    compared = dealt(joined.mapInArrow(fetch, SCHEMA), parts).mapInArrow(compare, SCHEMA)
    marks = lambda df: df.where("pid = -1").select("did", "tie", "start", "size")
    return marks(settled).unionByName(marks(compared))


def drop_repeats(docs: DataFrame, length: int = 100, hot: int = 20_000, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: id_col, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept_text (binary).

    length: from 48 to 279 bytes, so that offsets to anchors fit a byte.
    """
    if not 2 * K <= length < 256 + K:
        raise ValueError(f"length {length} is not within {2 * K} and {255 + K}")
    text = whole(F.col(text_col).cast("string"))
    tie = F.conv(F.substring(F.sha2(text, 256), 1, 7), 16, 10).cast("long")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("did"), tie.alias("tie"), text.alias("text"))
    copies = exact_dedup(texts, "did", "text", "min").where("keep_id <> did").select("did", F.conv(F.substring("text_sha256", 1, 7), 16, 10).cast("long").alias("tie"), F.lit(0).cast("long").alias("start"), F.lit(_LAST).alias("size")).distinct()
    marks = repeated(texts, length, hot).unionByName(copies)
    lists = marks.groupBy("did").agg(F.collect_list(F.struct("tie", "start", "size")).alias("marks"))
    parts = width(docs.sparkSession)
    joined = texts.repartition(parts, "did").join(lists.hint("merge"), "did", "left").select("did", "tie", "text", "marks")
    schema = "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * with_text

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                tie, data = batch.column(1)[i].as_py(), batch.column(2)[i].as_py().encode()
                own = batch.column(3)[i]
                spans: list[list[int]] = []
                if own.is_valid and len(data) >= length:
                    v = own.values
                    t, a, n = (v.field(k).to_numpy() for k in range(3))
                    a, n = a[t == tie], n[t == tie]
                    for b, e in sorted(zip(a.tolist(), np.minimum(a + np.minimum(n, len(data)), len(data)).tolist(), strict=True)):
                        if spans and b <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], e)
                        else:
                            spans.append([b, e])
                kept = b"".join(data[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(data)], strict=True)) if spans else data
                out.append((batch.column(0)[i].as_py(), len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)[: 5 + with_text])
            names = ["did", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 5 + with_text]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)] if out else [pa.array([], k) for k in kinds[: 5 + with_text]], names=names)

    done = joined.mapInArrow(cut_out, schema)
    return done.withColumn("did", F.when(F.col("did") != _LAST, F.col("did"))).withColumnRenamed("did", id_col)
