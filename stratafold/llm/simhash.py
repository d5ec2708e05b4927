"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share at least one value that lies within
half the radius of both.  Each distinct fingerprint emits that whole ball, the
variants are shuffled, and fingerprints that meet are verified and linked.  Links
are then closed to components by alternating large-star and small-star rounds,
all in tables; nothing is collected.

Defined results: a null text is an empty one; texts without words have the
fingerprint zero and link like any other; equal texts, repeated rows included,
share a component; null document ids never name a component unless the whole
component has none; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .words import Words, chunks

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Ids of 8 bytes that a broadcast may hold, checked by a count.
BROADCAST_IDS = 2_000_000


def fingerprints_of(texts: pa.Array, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is set if over half the shingles set it."""
    words = Words(texts, lower=True)
    joined, at = words.joined()
    counts = words.counts
    shingles = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    doc = np.repeat(np.arange(words.docs), shingles)
    ptr = np.zeros(words.docs + 1, np.int64)
    np.cumsum(shingles, out=ptr[1:])
    first = words.ptr[:-1][doc] + np.arange(len(doc)) - ptr[:-1][doc]
    last = np.minimum(first + size, words.ptr[1:][doc])
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[s:e], seed) for s, e in zip(at[first].tolist(), (at[last] - 1).tolist())), np.uint64, len(doc))
    return majority(hashes, doc, shingles)


def majority(hashes: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The 64 bits of each document that over half of its ``counts`` hashes set; ``doc`` ascends."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        # Bits of many hashes are counted together; pieces bound the memory.
        ones = np.zeros((len(counts), 64), np.int64)
        for a in range(0, len(hashes), 1 << 17):
            b = min(a + (1 << 17), len(hashes))
            bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            here, starts = np.unique(doc[a:b], return_index=True)
            ones[here] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        majority = (2 * ones[full] > counts[full, None]).astype(np.uint8)
        out[full] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): the fingerprint of each document as a signed long."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            fp = fingerprints_of(part.column(1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"id {kind}, fp long")


def ball(radius: int, width: int = 64) -> list[int]:
    """Masks (signed) of all changes of at most ``radius`` of ``width`` bits."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v), u < v, between nodes (node, fp) of different fingerprints.

    Values that meet in one variant are at most 2 * (radius // 2) bits apart from
    each other, so a star around the least node of a variant connects all that
    meet there: rows grow with the ball, not with pairs.  That needs an even radius.
    """
    if radius % 2:
        raise ValueError("the radius must be even, so that all that meet in a variant are linked")
    masks = F.array(*[F.lit(m) for m in ball(radius // 2)])
    variants = nodes.select("node", "fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    meet = Window.partitionBy("variant")
    star = variants.select("node", "fp", F.min(F.struct("node", "fp")).over(meet).alias("hub"))
    return (
        star.where((F.col("hub.node") < F.col("node")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= radius))
        .select(F.col("hub.node").alias("u"), F.col("node").alias("v"))
        .distinct()
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of the links (u, v): root is the least node
    reachable.  Alternating large-star and small-star; each round is written to the
    shared folder, and hubs are summarised by map-side minima before any shuffle.
    """
    spark, since = edges.sparkSession, store.mark()
    current = store.table(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = current.union(current.select("v", "u"))
        # Written, so that the joins have an exchange on either side and a hub can be split.
        least = store.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = store.table(both.join(least, "u").where("v > u").select("m", "v").where("m < v").distinct(), "large")
        small = store.table(large.groupBy("v").agg(F.min("m").alias("m")), "small")
        joined = large.withColumnRenamed("m", "w").join(small, "v")
        # v and its other lesser neighbours w all hang on v's least neighbour m.
        current = joined.select(F.col("m").alias("u"), "v").union(joined.where("w > m").select(F.col("m").alias("u"), F.col("w").alias("v"))).distinct()
        current = store.table(current, "links")
        store.release(spark, since, keep=(current,))
        state = current.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("x")).first()
        if state == before or not state["n"]:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows (id, fp, root): each document with its fingerprint and the least id of
    its component."""
    signed = store.table(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = signed.groupBy("fp").agg(F.min("id").alias("node"))
    closed = components(links(nodes.where(F.col("node").isNotNull()), radius))
    roots = nodes.join(closed, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    # Written first, so that the join below has an exchange on either side and a hot
    # fingerprint can be split.
    return signed.join(store.table(roots, "roots"), "fp", "left").select("id", "fp", "root")


def row_of(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What names a row: its id, nulls last, and its text.  Least rows have least ids."""
    return F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("print"))


def key_of(row: str) -> Column:
    return F.xxhash64(f"{row}.unknown", f"{row}.id", f"{row}.print")


def bounded(keys: DataFrame) -> DataFrame:
    """Keys of 8 bytes, to be broadcast up to a checked number; beyond it a join is shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys


def stay(docs: DataFrame, judged: DataFrame, since: int) -> DataFrame:
    """The documents whose row is the root of its component, from judged rows (id, root)
    of :func:`row_of`; of equal rows one stays.  Tables since ``since`` are deleted."""
    rows = judged.groupBy("id").agg(F.count("*").alias("n"), F.max(F.col("id") == F.col("root")).alias("stays"))
    rows = store.table(rows.where("n > 1 or not stays").select(key_of("id").alias("_gone"), "stays"), "dropped")
    store.release(docs.sparkSession, since, keep=(rows,))
    # The rows that go are few as a rule, so that whole texts stay where they are.
    keyed = docs.withColumn("_near", row_of()).withColumn("_near", key_of("_near"))
    gone, again = (bounded(rows.where(which).select("_gone")) for which in ("not stays", "stays"))
    met = F.col("_near") == F.col("_gone")
    first = keyed.join(gone, met, "left_anti")
    # Rows are unique as a rule; only those that are not meet again.
    if not again.isEmpty():
        first = first.join(again, met, "left_anti").unionByName(first.join(again, met, "left_semi").dropDuplicates(["_near"]))
    return first.drop("_near")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay: the least row, by id and text, of each component.

    Rows with a null or repeated id replace each other only within a component; of
    equal rows one stays.  Columns are those of ``docs``.
    """
    since = store.mark()
    return stay(docs, near_duplicates(docs.select(row_of().alias("id"), "text"), "id"), since)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("root").alias("component_id")
    )
