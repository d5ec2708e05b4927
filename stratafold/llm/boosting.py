"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts come from vectorised kernels.  Trees are grown on a bounded
sample of labelled rows in the driver, from per-bin sums of gradients, and flattened
into arrays: one comparison for each tree and level scores a whole batch.

Defined results: a null text is empty and is scored like any other; without labelled
rows of both kinds every score is the share of good labels (0.5 without labels);
repeated rows score alike; very long texts are scored whole, in memory of some ten times their length; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import BYTES, BYTE_VALUE, WORDS, Words, chunks, mix, per_doc

#: At most so many labelled documents are learned from, the first by hashed id.
MAX_LABELLED = 20_000
FEATURES = [
    "log_bytes", "log_words", "mean_word", "upper", "digit", "symbol", "bang", "pipe", "stop", "comma", "wide",
    "line_words", "repeated_lines", "distinct_words", "same_neighbour", "repeated_windows", "long_words",
]


def _flags(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_KINDS = [_flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("0123456789"), _flags("#*$%&<>@^~=+{}[]\\_"), _flags("!?"), _flags("|"), _flags("."), _flags(","), np.arange(256) >= 128]


def _distinct(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """How many different values each document has."""
    keys = mix(values ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    first = np.ones(len(keys), bool)
    first[1:] = keys[order][1:] != keys[order][:-1]
    return np.bincount(doc[order][first], minlength=docs)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    words = Words(texts)
    raw, docs, size = words.raw, words.docs, np.diff(words.offsets)
    n, doc = words.counts, words.doc_of_word()
    length = words.end - words.start
    chars = per_doc(length, words.ptr)
    solid = np.maximum(chars, 1)
    share = [per_doc(kind[raw], words.offsets) / solid for kind in _KINDS]
    hashes = words.hashes()
    # Lines end at a line break or with the text; empty ones don't count.
    stops = np.union1d(np.flatnonzero(raw == 10), words.offsets[1:][size > 0])
    begins = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
    begins = np.where(raw[np.minimum(begins, max(len(raw) - 1, 0))] == 10, begins + 1, begins) if len(stops) else begins
    some = begins < stops
    begins, stops = begins[some].astype(np.int64), stops[some].astype(np.int64)
    line_doc = np.searchsorted(words.offsets, begins, "right") - 1
    lines = np.bincount(line_doc, minlength=docs)
    line_hash = BYTES.spans(BYTES.prefix(BYTE_VALUE[raw]), begins, stops)
    inside = np.arange(max(len(hashes) - 2, 0))
    inside = inside[doc[inside] == doc[inside + 2]] if len(inside) else inside
    windows = WORDS.spans(WORDS.prefix(hashes), inside, inside + 3)
    n_windows = np.bincount(doc[inside], minlength=docs)
    same = np.zeros(len(hashes), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])

    def over(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    return np.column_stack([
        np.log1p(size), np.log1p(n), over(chars, n), *share,
        over(n, lines), over(lines - _distinct(line_hash, line_doc, docs), lines), over(_distinct(hashes, doc, docs), n),
        over(per_doc(same, words.ptr), n), over(n_windows - _distinct(windows, doc[inside], docs), n_windows), over(per_doc(length > 20, words.ptr), n),
    ])


@dataclass
class Forest:
    """Perfect trees as arrays: node k of a tree has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray  #: (trees, 2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  #: (trees, 2**depth)
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[:, None]
        node = np.zeros((len(self.feature), len(x)), np.int64)
        row = np.arange(len(x))[None, :]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[trees, node]] > self.threshold[trees, node])
        return self.base + self.value[trees, node - (2**self.depth - 1)].sum(axis=0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: int = 10) -> Forest:
    """Boosting of the logistic loss; splits come from histograms of binned features."""
    good = y.mean() if len(y) else 0.5
    base = float(np.log(max(good, 1e-6) / max(1 - good, 1e-6)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not len(y) or good in (0.0, 1.0):
        return Forest(feature[:0], threshold[:0], value[:0], base if len(y) else 0.0, depth)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = [np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)]
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-6)
            for f, (e, b) in enumerate(zip(edges, binned)):
                if not len(e):
                    continue
                k = len(e) + 1
                at = local * k + b
                sums = [np.cumsum(np.bincount(at, weights=w, minlength=width * k).reshape(width, k), axis=1) for w in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (gt, ht, nt) = (s[:, :-1] for s in sums), (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(nl < least) | (nt - nl < least)] = -1
                cut = gain.argmax(axis=1)
                up = gain[np.arange(width), cut]
                for w in np.flatnonzero(up > best):
                    best[w], feature[t, first + w], threshold[t, first + w] = up[w], f, e[cut[w]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + ridge)
        margin += value[t][leaf]
    return Forest(feature, threshold, value, base, depth)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns and the statistics of each text, as one array."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            x = statistics(part.column(len(carry)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], flat], [*carry, "x"])

    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", x array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **shape) -> Forest:
    chosen = labels.where("quality is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select(F.col("doc_id").alias("_id"), "quality")
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # An id with several rows is learned from its least text.
    one = joined.groupBy("_id").agg(F.min("quality").alias("quality"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = measured(one, ["_id", "quality"]).toArrow()
    order = np.argsort(rows.column("_id").to_numpy(), kind="stable")
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))[order] if rows.num_rows else np.zeros((0, len(FEATURES)))
    return train(x, rows.column("quality").to_numpy().astype(float)[order], **shape)


def scored(docs: DataFrame, forest: Forest) -> DataFrame:
    """Rows (doc_id, score) for all documents."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(forest.score(statistics(part.column(1))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    forest = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, forest).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
