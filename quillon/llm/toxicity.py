"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

A word's embedding is the sum of those of its hash and of the hashes of its first four and five
bytes.  A bucket holds the fingerprint of the training feature it was given to, so unseen words
that fall into it count as unknown (the zero vector) and not as that feature.  Filters of widths
1 to 3 slide over the whole text, each is max-pooled, and a logistic layer reads the pools.
Embeddings start from smoothed class log-odds in one dimension and noise in the others, then
everything is trained by Adam.  Thresholds are calibrated on rows that training did not see, by
the language guessed from the text's function words: a language's own threshold is shrunk
towards the common one, the less the more rows of its rarer class there are.  The score is the
logistic of the logit moved so that the threshold lies at ``cut``.

Learning reads at most ``sample`` labelled rows, those with the smallest hashes of their
identifiers, whose crc32(identifier as text) mod 3 is not 1, and of these texts while they take
at most ``sample_bytes`` together.  It runs in one task.  The model's size is fixed by the number
of buckets; it is the only thing that comes to the driver and goes to executors.

Results in special cases: null and empty texts get the score of no words.  A null identifier is
not held out.  Labels that are null or of absent rows are ignored; of several labels of one row
the largest counts.  Without rows of both classes every score is 0.  Texts are scored whole.
Only named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

BITS, DIM, FILTERS, WIDTHS = 18, 8, 8, (1, 2, 3)
SLOTS = sum(WIDTHS)
#: Rows of a language's rarer class at which its own threshold and the common one count alike.
SHRINK = 10
#: Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with as was be by on are this from or at",
    "de": "der die das und ist nicht von zu mit den ein eine auf für im sich des dem auch wir",
    "fr": "le la les de et est un une des du dans pour que qui en pas sur au avec ce",
    "es": "el los las y que del se por con una para como su al lo más pero sus es o",
}
LANGS = tuple(FUNCTION_WORDS)
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words x 3) hashes of the texts' words and of their heads; words of each text."""
    data = [t.lower().encode(errors="replace") + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8)
    inside = _WORD[raw]
    start = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    stop = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(raw), _P)])
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(raw), _INV)])
        total = np.r_[np.uint64(0), np.cumsum(_BYTE[raw] * power[:-1])]
        out = np.empty((len(start), 3), np.uint64)
        for k, head in enumerate((None, 4, 5)):
            end = stop if head is None else np.minimum(stop, start + head)
            out[:, k] = _mixed((total[end] - total[start]) * inverse[start] + np.uint64(k))
    edges = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
    return out, np.diff(np.r_[0, np.searchsorted(start, edges)])


_FUNCTION = [(hashes([w])[0][0, 0], k) for k, lang in enumerate(LANGS) for w in FUNCTION_WORDS[lang].split()]
_FUNCTION_KEYS = np.array(sorted({h for h, _ in _FUNCTION}), np.uint64)
_FUNCTION_LANG = np.zeros((len(_FUNCTION_KEYS) + 1, len(LANGS)), np.float32)
for _h, _k in _FUNCTION:
    _FUNCTION_LANG[np.searchsorted(_FUNCTION_KEYS, _h), _k] = 1


def languages(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Index in LANGS of each text by its function words; len(LANGS) where it has none."""
    at = np.minimum(np.searchsorted(_FUNCTION_KEYS, words), len(_FUNCTION_KEYS) - 1)
    hit = np.flatnonzero(_FUNCTION_KEYS[at] == words)
    text = np.searchsorted(np.cumsum(counts), hit, side="right")
    votes = np.zeros((len(counts), len(LANGS)))
    for k in range(len(LANGS)):
        votes[:, k] = np.bincount(text, _FUNCTION_LANG[at[hit], k], len(counts))
    return np.where(votes.max(1, initial=0) > 0, votes.argmax(1), len(LANGS))


@dataclass
class Model:
    mark: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.uint32))
    emb: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, DIM), np.float32))
    conv: np.ndarray = field(default_factory=lambda: np.zeros((SLOTS, DIM, FILTERS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros((len(WIDTHS), FILTERS), np.float32))
    head: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    base: np.ndarray = field(default_factory=lambda: np.full(1, -40.0, np.float32))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGS) + 1, np.float32))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **vars(self))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as found:
            return cls(**{k: found[k] for k in found.files})

    def buckets(self, words: np.ndarray) -> np.ndarray:
        """Buckets of the hashes, 0 (kept empty) for unknown ones."""
        at = (words >> np.uint64(64 - BITS)).astype(np.int64)
        return np.where(self.mark[at] == (words & np.uint64(0xFFFFFFFF)).astype(np.uint32), at, 0)

    def pools(self, vectors: np.ndarray, place: np.ndarray, counts: np.ndarray, track: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filters of texts whose words have the vectors at place; where each maximum is."""
        pad = max(WIDTHS)
        size = counts + pad
        first = np.cumsum(size) - size
        row = np.full(int(size.sum()) + pad, len(vectors))
        row[np.arange(len(place)) + np.repeat(first - (np.cumsum(counts) - counts), counts)] = place
        vectors = np.vstack([vectors, np.zeros((1, DIM), np.float32)])
        pooled = np.empty((len(counts), len(WIDTHS) * FILTERS), np.float32)
        where = np.zeros(pooled.shape, np.int64) if track else pooled
        slot = 0
        n = int(size.sum())
        for w, wide in enumerate(WIDTHS):
            out = np.zeros((n, FILTERS), np.float32)
            for k in range(wide):
                out += (vectors @ self.conv[slot]).take(row[k : n + k], 0)
                slot += 1
            top = np.maximum.reduceat(out, first) if len(counts) else np.zeros((0, FILTERS), np.float32)
            pooled[:, w * FILTERS : (w + 1) * FILTERS] = np.maximum(top + self.bias[w], 0)
            if track:
                for i, (a, b) in enumerate(zip(first, first + size, strict=True)):
                    where[i, w * FILTERS : (w + 1) * FILTERS] = a + out[a:b].argmax(0)
        return pooled, (where, row) if track else None

    def logits(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        key, place = np.unique(words[:, 0], return_index=True)[1], None
        _, place = np.unique(words[:, 0], return_inverse=True)
        vectors = self.emb[self.buckets(words[key])].sum(1)
        return self.pools(vectors, place, counts)[0] @ self.head + self.base[0]

    def scores(self, texts: list[str], cut: float) -> np.ndarray:
        words, counts = hashes(texts)
        z = self.logits(words, counts) - self.shift[languages(words[:, 0], counts)] + np.log(cut / (1 - cut))
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -500, 500)))


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the fewest errors, in the middle of its gap."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    wrong = np.r_[0, np.cumsum(y)] + np.r_[np.cumsum((1 - y)[::-1])[::-1], 0]
    best = np.flatnonzero(wrong == wrong.min())
    edge = np.r_[z[0] - 1, z, z[-1] + 1]
    gaps = edge[best + 1] - edge[best]
    k = best[gaps.argmax()]
    return float((edge[k] + edge[k + 1]) / 2)


def fit(texts: list[str], toxic: np.ndarray, seed: int = 5, steps: int = 360, batch: int = 48) -> Model:
    """Train on four fifths of the texts, calibrate on the rest."""
    model, rng = Model(), np.random.default_rng(seed)
    toxic = np.asarray(toxic, np.float32)
    if not 0 < toxic.sum() < len(toxic):
        return model
    parts, pairs, held_over, size = [], [], [], 0
    for i, text in enumerate(texts):  # in slices, as prefix sums take far more than the text
        held_over.append(text)
        size += len(text)
        if size >= 1_000_000 or i == len(texts) - 1:
            own, n = hashes(held_over)
            at = np.repeat(np.arange(i + 1 - len(held_over), i + 1), n)
            parts.append((own, n))
            for k in range(own.shape[1]):
                order = np.lexsort((own[:, k], at))
                a, w = at[order], own[order, k]
                fresh = np.r_[True, (w[1:] != w[:-1]) | (a[1:] != a[:-1])][: len(w)]
                pairs.append((a[fresh].astype(np.int32), w[fresh]))
            held_over, size = [], 0
    words, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    stop = np.cumsum(counts)
    order = rng.permutation(len(texts))
    held = np.zeros(len(texts), bool)
    for c in (0, 1):
        own = order[toxic[order] == c]
        held[own[: len(own) // 5]] = True
    learn = np.flatnonzero(~held)
    # features of at least two training texts get buckets, the more telling first
    pair_text, pair_word = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    del parts, pairs
    pair_text, pair_word = pair_text[~held[pair_text]], pair_word[~held[pair_text]]
    order = np.argsort(pair_word, kind="stable")
    pair_text, pair_word = pair_text[order], pair_word[order]
    feature, first = np.unique(pair_word, return_index=True)
    y, n1 = toxic[learn], 0.0
    if len(feature):
        n1 = np.add.reduceat(toxic[pair_text], first)
        n = np.diff(np.r_[first, len(pair_word)])
        prior = y.mean()
        odds = np.log((n1 + 4 * prior) / (n - n1 + 4 * (1 - prior))) - np.log(prior / (1 - prior))
        often = np.flatnonzero(n >= 2)
        often = often[np.argsort(np.abs(odds[often]), kind="stable")]
        at = (feature[often] >> np.uint64(64 - BITS)).astype(np.int64)
        ok = at > 0
        model.mark[at[ok]] = (feature[often][ok] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        model.emb[at[ok]] = rng.normal(0, 0.02, (int(ok.sum()), DIM))
        model.emb[at[ok], 0] = np.clip(odds[often][ok], -1, None)
    model.conv[:] = rng.normal(0, 0.1, model.conv.shape)
    model.conv[0, :, 0] = np.eye(DIM)[0]
    model.head[:] = rng.normal(0, 0.1, model.head.shape)
    model.head[0] = 1
    model.base[:] = 0
    model.base[:] = -threshold(np.concatenate([model.logits(words[stop[i] - counts[i] : stop[i]], counts[i : i + 1]) for i in learn[:1000]]), toxic[learn[:1000]]) if 0 < toxic[learn[:1000]].sum() < len(learn[:1000]) else 0
    moments = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in ("conv", "bias", "head", "base", "emb")}
    classes = [learn[toxic[learn] == c] for c in (0, 1)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(c, batch // 2) for c in classes])
        sub = np.concatenate([words[stop[i] - counts[i] : stop[i]] for i in pick])
        bucket = model.buckets(sub)
        vectors = model.emb[bucket].sum(1)
        pooled, (where, row) = model.pools(vectors, np.arange(len(sub)), counts[pick], True)
        z = pooled @ model.head + model.base[0]
        error = (1 / (1 + np.exp(-z)) - toxic[pick]) / len(pick)
        back = error[:, None] * model.head * (pooled > 0)
        padded = np.vstack([vectors, np.zeros((1, DIM), np.float32)])
        grads = {"head": pooled.T @ error + 1e-4 * model.head, "base": np.array([error.sum()]), "conv": 1e-4 * model.conv, "bias": np.stack([back[:, w * FILTERS : (w + 1) * FILTERS].sum(0) for w in range(len(WIDTHS))])}
        touched, change = [], []
        slot = 0
        for w, wide in enumerate(WIDTHS):
            g, p = back[:, w * FILTERS : (w + 1) * FILTERS], where[:, w * FILTERS : (w + 1) * FILTERS]
            for k in range(wide):
                words_at = row[p + k]
                grads["conv"][slot] += np.einsum("bfd,bf->df", padded[words_at], g)
                real = words_at < len(sub)
                touched.append(bucket[words_at[real]])
                change.append(((g[..., None] * model.conv[slot].T[None])[real])[:, None, :].repeat(3, 1))
                slot += 1
        rows, inverse = np.unique(np.concatenate(touched).ravel(), return_inverse=True)
        emb = np.zeros((len(rows), DIM), np.float32)
        np.add.at(emb, inverse, np.concatenate(change).reshape(-1, DIM))
        emb[rows == 0] = 0
        rate = 0.01 * min(1, 4 * (1 - step / (steps + 1)))
        for k, g in [*grads.items(), ("emb", emb)]:
            target, part = getattr(model, k), rows if k == "emb" else slice(None)
            m, v = moments[k]
            m[part] = 0.9 * m[part] + 0.1 * g
            v[part] = 0.99 * v[part] + 0.01 * g * g
            target[part] -= rate * (m[part] / (1 - 0.9**step)) / (np.sqrt(v[part] / (1 - 0.99**step)) + 1e-6)
    rest = np.flatnonzero(held)
    rest = rest if 0 < toxic[rest].sum() < len(rest) else np.arange(len(texts))
    z = np.concatenate([model.logits(words[stop[i] - counts[i] : stop[i]], counts[i : i + 1]) for i in rest])
    lang = languages(words[:, 0], counts)[rest]
    common = threshold(z, toxic[rest])
    model.shift[:] = common
    for k in range(len(LANGS)):  # a language's own threshold counts by the rows of its rarer class
        own = lang == k
        rows = min(toxic[rest][own].sum(), (1 - toxic[rest][own]).sum())
        if rows:
            model.shift[k] = (rows * threshold(z[own], toxic[rest][own]) + SHRINK * common) / (rows + SHRINK)
    return model


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_bytes: int = 64_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of at most ``sample`` labelled rows and ``sample_bytes`` bytes of text, trained in one task.

    The rows are those with the smallest hashes; only the model, of fixed size, comes to the driver.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    known = known.where(~held_out("_id")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    # rows that repeat an identifier may be very many: the bound holds after the join as well
    got = rows.join(F.broadcast(known), "_id").orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text"), "_text").limit(sample).select("_text", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic, size = [], [], 0
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(text.encode(errors="replace"))
                if size + n <= sample_bytes:
                    texts.append(text)
                    toxic.append(y)
                    size += n
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, np.array(toxic)).dump()], pa.binary())], names=["model"])

    found = got.mapInArrow(run, "model binary").collect()
    return Model.load(found[0][0]) if found else Model()


def scored(source: DataFrame, text: list[str], shared, cut: float) -> DataFrame:
    """source with columns score and predicted after its own; text leads to the column or struct field that is scored."""
    from .bpe import slices

    names = source.columns
    schema = StructType([*source.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column(names.index(text[0]))
            for field_name in text[1:]:
                column = column.field(field_name)
            for start, texts in slices(column, 1_000_000):  # prefix sums take some 60 bytes a byte of text
                score = model.scores(texts, cut)
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= cut).astype(np.int32))], names=[*names, "score", "predicted"])

    return source.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.7, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: id_col, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, id_col=id_col, text_col=text_col, label_col=label_col))
    source = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.col(id_col).alias("_id"), held_out(id_col).alias("_held"))
    return scored(source, ["_text"], shared, cut).select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.7, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs whose score is below the cut, all columns as they were, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, id_col=id_col, text_col=text_col, label_col=label_col))
    plain = dict(docs.dtypes)[text_col] == "string"
    source = docs.select(F.struct("*").alias("_row"), *([] if plain else [F.col(text_col).cast("string").alias("_text")]))
    return scored(source, ["_row", text_col] if plain else ["_text"], shared, cut).where("predicted = 0").select("_row.*")
