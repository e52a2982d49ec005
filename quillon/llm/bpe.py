"""BPE encoding and decoding of a tokenizers file with word ends, in batched numpy merge rounds.

A batch of texts is cut into pieces (words, digits, runs of signs).  The pieces not seen lately
are encoded together: their symbols lie in one flat array, and each round looks the new
neighbour pairs up by binary search in the sorted keys (left << 32 | right) of the merge list,
finds every word's lowest rank, and merges that pair wherever it stands in its word.  A round
touches only words that still merge.  A piece cache, emptied when it reaches its bound, keeps
common words from being encoded again; it changes speed, never results.

Results in special cases: a null text is the empty text; an empty text has no ids and decodes to
the empty text.  The strings of special tokens in a text become their ids.  Symbols outside the
vocabulary are left out, as the file names no unknown token.  Texts are encoded whole, whatever
their length.  Only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Unicode white space, as a character class.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where printable, else 256 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A tokenizers file whose model is BPE over byte characters with a word-end suffix."""

    def __init__(self, path: str, cache: int = 100_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = token
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = added
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        chars = byte_chars()
        self.inner = np.array([vocab.get(c, -1) for c in chars])
        self.last = np.array([vocab.get(c + end, -1) for c in chars])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.none = len(pairs)
        self.bound = cache
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of many words, and how many each word has left."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), self.none)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same] = self.ranks(symbols[same], symbols[same + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            span = np.diff(np.r_[first, len(word)])
            low = np.minimum.reduceat(rank, first)
            live = np.repeat(low < self.none, span)
            if not live.all():
                done.append((word[~live], symbols[~live]))
                symbols, word, rank, low, span = symbols[live], word[live], rank[live], low[low < self.none], span[low < self.none]
                if not len(symbols):
                    break
            hit = rank == np.repeat(low, span)
            # of hits that overlap (the same symbol again and again) every second one merges
            if (hit[1:] & hit[:-1]).any():
                begin = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
                run = np.cumsum(hit & ~np.r_[False, hit[:-1]]) - 1
                hit &= (np.arange(len(hit)) - begin[np.maximum(run, 0)]) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.made[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            symbols, word, rank = symbols[stay], word[stay], rank[stay]
            here = moved[at]
            for p in (here, here[here > 0] - 1):
                inside = p[p + 1 < len(word)]
                inside = inside[word[inside] == word[inside + 1]]
                rank[p] = self.none
                rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
        if done:
            word, symbols = (np.concatenate([d[k] for d in done]) for k in (0, 1))
            order = np.argsort(word, kind="stable")
            word, symbols = word[order], symbols[order]
        return symbols, np.bincount(word, minlength=len(sizes))

    def learn(self, pieces: list[str]) -> None:
        """Add pieces, all of them new, to the cache."""
        data = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        if (symbols < 0).any():
            known = symbols >= 0
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes))
            symbols = symbols[known]
        flat, sizes = self.merge(symbols, sizes)
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.seen.update(zip(pieces, range(len(self.seen), len(self.seen) + len(pieces)), strict=True))
        self.flat, self.starts, self.sizes = np.r_[self.flat, flat], np.r_[self.starts, starts], np.r_[self.sizes, sizes]

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text; special tokens keep their place, marked by a leading NUL."""
        if self.special is None or "<|" not in text:
            return self.plain(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += ["\0" + part] if i % 2 else self.plain(part)
        return out

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.piece.findall(text.lower())

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the number of ids of each text."""
        if len(self.seen) > self.bound:
            self.clear()
        cut = [self.pieces(t) for t in texts]
        new = set().union(*cut) - self.seen.keys() if cut else set()
        if marked := [p for p in new if p[0] == "\0" and p[1:] in self.added]:
            new -= set(marked)
            self.flat, self.starts, self.sizes = np.r_[self.flat, [self.added[p[1:]] for p in marked]], np.r_[self.starts, len(self.flat) + np.arange(len(marked))], np.r_[self.sizes, np.ones(len(marked), np.int64)]
            self.seen.update(zip(marked, range(len(self.seen), len(self.seen) + len(marked)), strict=True))
        if new:
            self.learn(sorted(new))
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        get = self.seen.__getitem__
        place = np.fromiter((get(p) for c in cut for p in c), np.int64, int(count.sum()))
        size = self.sizes[place]
        stop = np.cumsum(size)
        at = np.arange(int(size.sum())) + np.repeat(self.starts[place] - (stop - size), size)
        edge = np.r_[0, stop][np.r_[0, np.cumsum(count)]]
        return self.flat[at], np.diff(edge)

    def decode(self, ids: np.ndarray) -> str:
        """As without a decoder: the tokens with a space between."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for runs of rows with about ``most`` characters together; null is empty."""
    rows: list[str] = []
    start = held = 0
    for i in range(len(texts)):
        rows.append(texts[i].as_py() or "")
        held += len(rows[-1])
        if held >= most:
            yield start, rows
            rows, start, held = [], i + 1, 0
    if rows:
        yield start, rows


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id_col, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids and decoded.

    Runs of whole texts are encoded in place: no shuffle, memory by the longest text.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for start, texts in slices(batch.column(1), 1_000_000):  # pieces and ids take some 30 bytes a character
                flat, counts = bpe.encode_batch(texts)
                stops = np.cumsum(counts)
                parts = [flat[b - n : b] for b, n in zip(stops, counts, strict=True)]
                decoded = [bpe.decode(p) for p in parts]
                columns = [
                    batch.column(0).slice(start, len(texts)),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                ]
                if with_ids:
                    columns += [pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return docs.select(id_col, docs[text_col].cast("string").alias("_text")).mapInArrow(run, schema)
