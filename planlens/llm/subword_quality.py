"""Quality of texts by learned subword embeddings.

A document's features are its words, its pairs of neighbouring words (with
marks for a pair of equal words and for a pair that the text had before), the
character n-grams of each word with its edges (3 to 5 characters), and one mark
for its end. All are hashed into one table of learned vectors; their mean is the
document's vector, and a linear layer with softmax gives the probabilities of
both labels. Table and layer are learned together by stochastic gradient
descent in numpy, from at most ``TRAIN_ROWS`` labelled documents chosen by a
hash of doc_id; their features, not their texts, come to the driver. The rest
covers all documents: as the layer is linear, each vector's part in the
difference of the two outputs is one number, so tasks get a table of numbers
and add up a document's words, pairs and n-grams. Scores are the same as by the
vectors.

A null or empty text has the mark alone. Null labels and null ids aren't learned
from; an id labelled both ways counts as good quality; of repeated rows with one
id each counts, within the bound. Texts of any length are read whole. Repeated
rows get a row each, other columns are ignored, an empty table gives no rows;
without any label every score is 0.5, with labels of one kind it tends to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.llm.bpe_chunks import spans
from planlens.llm.frames import offsets_of, planes, texts_of, unplanes
from planlens.llm.text_arrays import mix
from planlens.llm.worker_memory import slices, worker_cache
from planlens.workspace import ship_package

#: Labelled documents used for fitting, at most.
TRAIN_ROWS = 6_000
#: Vectors in the table and their width; n-grams have 3 to 5 characters.
BUCKETS, WIDTH, GRAMS = 1 << 17, 8, (3, 4, 5)
#: Descent: steps at least, passes at least and at most, and the rate at the start, which falls to none.
LEAST_STEPS, LEAST_PASSES, MOST_PASSES, RATE = 12_000, 3, 30, 5.0
#: Characters of the words that a worker remembers.
KEPT_CHARS = 4_000_000

#: Buckets of the end, of a pair of equal words, and of a pair that the text had before.
_END, _SAME, _AGAIN = 0, 1, 2
_EDGES = ("<", ">")
_GRAM_STEP, _PAIR_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    """Buckets of 64-bit hashes; the first three are for marks."""
    return (mix(hashes) % np.uint64(BUCKETS - 3) + np.uint64(3)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word; how many features each has; the buckets of all, a word's own first."""
    own = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))
    edged = [f"{_EDGES[0]}{w}{_EDGES[1]}" for w in words]
    lengths = np.fromiter(map(len, edged), np.int64, len(words))
    code = np.frombuffer("".join(edged).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    of_word = np.repeat(np.arange(len(words)), lengths)
    found, place = [buckets_of(own)], [np.arange(len(words))]
    for n in GRAMS:
        if len(code) < n:
            break
        h = np.full(len(code) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * _GRAM_STEP + code[k : len(code) - n + 1 + k]
        inside = of_word[: len(h)] == of_word[n - 1 :]
        found.append(buckets_of(h[inside]))
        place.append(of_word[: len(h)][inside])
    order = np.argsort(np.concatenate(place), kind="stable")
    return own, np.bincount(np.concatenate(place), minlength=len(words)), np.concatenate(found)[order]


class WordTable:
    """What is known of words: their hashes, and what ``reduce`` makes of their features; bounded in characters."""

    def __init__(self, weights: np.ndarray | None):
        self.weights = weights
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.chars = 0
        self.hashes, self.counts, self.sums = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        self.starts, self.buckets = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def slots(self, words: list[str]) -> np.ndarray:
        if self.chars > KEPT_CHARS:
            self._clear()
        at = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        gaps = np.flatnonzero(at < 0)
        if len(gaps):
            lost = list(dict.fromkeys(words[k] for k in gaps.tolist()))
            hashes, counts, buckets = word_features(lost)
            self.slot.update(zip(lost, range(len(self.hashes), len(self.hashes) + len(lost))))
            self.chars += sum(map(len, lost))
            self.hashes, self.counts = np.concatenate([self.hashes, hashes]), np.concatenate([self.counts, counts])
            if self.weights is None:  # for learning the features themselves are needed
                self.starts = np.concatenate([self.starts, len(self.buckets) + offsets_of(counts)[:-1]])
                self.buckets = np.concatenate([self.buckets, buckets])
            else:
                self.sums = np.concatenate([self.sums, np.add.reduceat(self.weights[buckets], offsets_of(counts)[:-1])])
            at[gaps] = np.fromiter((self.slot[words[k]] for k in gaps.tolist()), np.int64, len(gaps))
        return at


def pairs_of(hashes: np.ndarray) -> np.ndarray:
    return buckets_of(hashes[:-1] * _PAIR_STEP + hashes[1:])


def words_of(texts: list[str | None], known: WordTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all words, the words of each text, and the buckets of pairs of neighbours with the text of each."""
    words = [(t or "").split() for t in texts]
    at = known.slots([w for ws in words for w in ws])
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    of_doc = np.repeat(np.arange(len(words)), sizes)
    together = of_doc[1:] == of_doc[:-1]
    hashes = known.hashes[at]
    found, place = pairs_of(hashes)[together] if len(at) > 1 else np.zeros(0, np.int64), of_doc[1:][together]
    same = (hashes[1:] == hashes[:-1])[together]
    again = place << 32 | found
    order = np.argsort(again, kind="stable")
    later = np.zeros(len(again), bool)
    later[order[1:]] = again[order[1:]] == again[order[:-1]]
    marks = np.concatenate([np.full(int(same.sum()), _SAME), np.full(int(later.sum()), _AGAIN)])
    return at, sizes, np.concatenate([found, marks]).astype(np.int64), np.concatenate([place, place[same], place[later]])


def document_features(texts: list[str | None], known: WordTable) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each whole text and how often each occurs."""
    at, sizes, pairs, place = words_of(texts, known)
    pairs = pairs[np.argsort(place, kind="stable")]
    word_cuts, pair_cuts = offsets_of(sizes), offsets_of(np.bincount(place, minlength=len(texts)))
    out = []
    for k in range(len(texts)):
        own = at[word_cuts[k] : word_cuts[k + 1]]
        every = known.buckets[spans(known.starts[own], known.counts[own])]
        out.append(np.unique(np.concatenate([[_END], every, pairs[pair_cuts[k] : pair_cuts[k + 1]]]), return_counts=True))
    return out


@dataclass
class Model:
    """Numbers of the buckets and the constant: what of the vectors counts for the difference of the outputs."""

    weights: np.ndarray
    constant: float

    def scores(self, texts: list[str | None], known: WordTable) -> np.ndarray:
        at, sizes, pairs, place = words_of(texts, known)
        of_doc = np.repeat(np.arange(len(texts)), sizes)
        total = self.weights[_END] + np.bincount(of_doc, known.sums[at], len(texts)) + np.bincount(place, self.weights[pairs], len(texts))
        count = 1 + np.bincount(of_doc, known.counts[at], len(texts)) + np.bincount(place, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / count + self.constant, -40, 40)))


_PRESS, _RELEASE = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed_features(used: np.ndarray, times: np.ndarray) -> bytes:
    return _PRESS.compress(planes(np.diff(used, prepend=0).astype("<u4")) + planes(times.astype("<u4")))


def unpacked_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = _RELEASE.decompress(data)
    half = len(body) // 2
    return np.cumsum(unplanes(body[:half], "<u4").astype(np.int64)), unplanes(body[half:], "<u4").astype(np.float32)


def descend(examples: list[tuple[bytes, int]], seed: int = 7) -> Model:
    """Vectors and layer by stochastic gradient descent, a document at a time in an order that changes each pass."""
    r = np.random.default_rng(seed)
    vectors = ((r.random((BUCKETS, WIDTH), np.float32) - 0.5) / WIDTH).astype(np.float32)
    layer, constant = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    passes = min(MOST_PASSES, max(LEAST_PASSES, -(-LEAST_STEPS // max(len(examples), 1))))
    steps, done = passes * len(examples), 0
    for _ in range(passes):
        for k in r.permutation(len(examples)).tolist():
            data, label = examples[k]
            used, times = unpacked_features(data)
            share = times / times.sum()
            rows = vectors[used]
            mean = share @ rows
            out = layer @ mean + constant
            p = np.exp(out - out.max())
            p /= p.sum()
            p[label] -= 1  # the gradient at the outputs
            rate = np.float32(RATE * (1 - done / steps))
            back = p @ layer
            layer -= rate * np.outer(p, mean)
            constant -= np.float32(0.1) * rate * p
            vectors[used] = rows - rate * np.outer(share, back)
            done += 1
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(constant[1] - constant[0]))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, train_rows: int = TRAIN_ROWS) -> Model:
    """The model, from labelled documents (doc_id, quality) for which ``may_learn`` (on doc_id) holds."""
    spark = docs.sparkSession
    ship_package(spark)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    chosen = chosen.filter(may_learn) if may_learn is not None else chosen
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chosen = spark.createDataFrame([(r["doc_id"], r["quality"]) for r in chosen.collect()], "doc_id long, quality int")  # at most train_rows
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    fields = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("features", pa.binary())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache("subword features", lambda: WordTable(None))
        for batch in slices(batches, keep="subword features"):
            found = [packed_features(*f) for f in document_features(batch.column("text").to_pylist(), known)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary())], schema=fields)

    found = sample.mapInArrow(features, "doc_id long, quality int, features binary")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(train_rows).collect()
    return descend([(bytes(r["features"]), r["quality"]) for r in rows])


def score(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= 0.5) of every row."""
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col)
    model = train(texts, labels, may_learn)
    shared = spark.sparkContext.broadcast(model)
    kind = f"subword scores {xxhash.xxh3_64_hexdigest(model.weights.tobytes())}"
    fields = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache(kind, lambda: WordTable(shared.value.weights))
        for batch in slices(batches, keep=kind):
            s = shared.value.scores(batch.column("text").to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=fields)

    return texts.mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for testing: crc32 of its id as text leaves 1 when divided by three."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
