"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the short word grams inside every window of
``length`` words the least hash is kept, so equal windows always keep the same
anchor.  Documents are joined on repeated anchors, and each match is extended both
ways.  Extension is done on all occurrences of an anchor at once, without pairs:
first the whole context that an anchor answers for is compared (equal contexts are
settled together), then every split of the remaining left and right extents.  Runs
of confirmed windows are the maximal repeats.

Words are known by 64-bit hashes; a window by two 64-bit hashes of these.

Defined results: a null text is empty; texts under ``length`` words lose nothing;
equal texts of enough words, repeated rows included, lose all words; overlapping
repeats are removed once; a very long text is read whole, in memory of some ten times
its length; extra columns are kept or ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .words import WORDS, Powers, Words, chunks, lists, mix

LENGTH = 35
GRAM = 12
#: Bits of the sieve of touched texts: 16 for each, and at most 16 MB in all.
SIEVE_BITS = 1 << 27
_BLOCK = 1 << 15
_WINDOW = Powers(0xC2B2AE3D27D4EB4F)


class Anchors:
    """The winnowed anchors of a flat buffer: for each, its document, the first
    and last window start that it answers for, and the hashes of gram and context."""

    def __init__(self, words: Words, length: int = LENGTH, gram: int = GRAM):
        self.hashes = words.hashes()
        self.prefix = WORDS.prefix(self.hashes)
        n, span = len(self.hashes), length - gram + 1
        doc_end = np.repeat(words.ptr[1:], words.counts)
        starts = np.flatnonzero(np.arange(n) + length <= doc_end) if n else np.zeros(0, np.int64)
        if not len(starts):
            self.doc = self.first = self.last = np.zeros(0, np.int64)
            self.seed = self.context = np.zeros(0, np.uint64)
            return
        begin = np.arange(n - gram + 1)
        grams = mix(WORDS.spans(self.prefix, begin, begin + gram))
        # The leftmost least gram of span grams from each place on, by doubling.
        best, reach = begin, 1
        while reach < span:
            step = min(reach, span - reach)
            a, b = best[: len(best) - step], best[step:]
            best = np.where(grams[b] < grams[a], b, a)
            reach += step
        chosen = best[starts]
        doc = np.repeat(np.arange(words.docs), words.counts)[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        until = np.append(at[1:], len(starts)) - 1
        first, last, anchor = starts[at], starts[until], chosen[at]
        place = ((anchor - first) * 64 + (last - first)).astype(np.uint64)
        self.doc, self.first, self.last = doc[at], first, last
        self.seed = grams[anchor]
        self.context = mix(_WINDOW.spans(_WINDOW.prefix(self.hashes), first, last + length) ^ mix(place + np.uint64(1)))


def _sha(words: Words, keep: np.ndarray) -> tuple[list[bytes], list[str]]:
    """Kept words of each document joined by one space, and their SHA-256."""
    joined, at = words.joined()
    byte_keep = np.repeat(keep, np.diff(at))
    data = joined[byte_keep].tobytes()
    size = np.zeros(len(at), np.int64)
    np.cumsum(np.diff(at) * keep, out=size[1:])
    bounds = size[words.ptr].tolist()
    kept = [data[a : max(a, b - 1)] for a, b in zip(bounds, bounds[1:])]
    return kept, [hashlib.sha256(k).hexdigest() for k in kept]


def seeds(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each document: key (MD5 of the text), n_words, SHA-256 of all its
    words, and its anchors as parallel arrays."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            words = Words(part.column(2))
            anchors = Anchors(words, length, gram)
            _, sha = _sha(words, np.ones(len(words.start), bool))
            ptr = np.searchsorted(anchors.doc, np.arange(words.docs + 1))
            base = words.ptr[:-1][anchors.doc] if len(anchors.doc) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(words.counts.astype(np.int64)), pa.array(sha),
                 lists(anchors.seed, ptr, pa.int64()), lists(anchors.context, ptr, pa.int64()),
                 lists((anchors.first - base).astype(np.int32), ptr, pa.int32()), lists((anchors.last - anchors.first).astype(np.int32), ptr, pa.int32())],
                ["doc_id", "key", "n_words", "full_sha", "h", "e", "s", "w"],
            )

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.unhex(F.md5(text)).alias("key"), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, key binary, n_words long, full_sha string, h array<long>, e array<long>, s array<int>, w array<int>"
    )


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """Window hashes (h, wh, tid, s, settled) of the anchors that are to be emitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            words = Words(part.column(1))
            prefix = _WINDOW.prefix(words.hashes())
            found = part.column(2)
            flat, counts = found.flatten(), np.diff(np.asarray(found.offsets))
            take = np.flatnonzero(np.asarray(flat.field("emit")))
            row = np.repeat(np.arange(words.docs), counts)[take]
            s, w = (np.asarray(flat.field(c)).astype(np.int64)[take] for c in ("s", "w"))
            each = np.repeat(np.arange(len(take)), w + 1)
            start = s[each] + np.arange(len(each)) - np.repeat(np.cumsum(w + 1) - (w + 1), w + 1)
            at = start + words.ptr[:-1][row[each]]
            hashes = mix(_WINDOW.spans(prefix, at, at + length))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(flat.field("h"))[take][each]), pa.array(hashes.view(np.int64)), pa.array(np.asarray(part.column(0))[row[each]]), pa.array(start.astype(np.int32)), pa.array(np.asarray(flat.field("settled").cast(pa.int8()))[take][each])],
                ["h", "wh", "tid", "s", "settled"],
            )

    return texts.select("tid", "text", "found").mapInArrow(run, "h long, wh long, tid long, s int, settled byte")


def _sieved(docs: DataFrame, wanted: DataFrame, on: dict[str, str]) -> DataFrame:
    """The rows of ``docs`` whose columns (keys of ``on``) may be those of a wanted row
    (values of ``on``): all that are, and some that are not, which a join is to drop.
    A bitmap of bounded size is broadcast, so that the rest is not shuffled."""
    bits = min(SIEVE_BITS, max(_BLOCK, 1 << (16 * wanted.count()).bit_length()))

    def placed(df: DataFrame, columns: list[str]) -> DataFrame:
        at = F.pmod(F.xxhash64(*columns), F.lit(bits))
        return df.withColumn("_block", F.shiftright(at, 15)).withColumn("_bit", at % _BLOCK)

    blocks = placed(wanted, list(on.values())).select("_block", "_bit").repartition("_block")
    blocks = blocks.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(F.col("_bit"), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
    return placed(docs, list(on)).join(F.broadcast(blocks), "_block").where(held).drop("_block", "_bit", "_map")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(seeds table, texts): the texts that repeats touch, one row for each distinct
    text, with ``key``, ``text`` and the starts of its repeated windows as arrays of
    runs ``runs`` (s, w): windows s to s + w.  A table goes as soon as the next is written."""
    spark, since = docs.sparkSession, store.mark()
    table = store.table(seeds(docs, length, gram), "seeds")
    seen = table.select("key", F.explode(F.arrays_zip("h", "e", "s", "w")).alias("o")).select("key", "o.*")
    # Seeds that join nothing end here: one count for each anchor, combined before the shuffle.
    # Written first, so that the join has an exchange on either side and a hot anchor can be split.
    again = store.table(seen.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    # So is what it gives: an aggregate by the same key in its stage would forbid that.
    met = store.table(seen.join(again, "h", "left_semi"), "met")
    store.release(spark, since, keep=(table, met))
    matched = store.table(met.groupBy("h", "e", "key", "s", "w").agg(F.count("*").alias("n")), "matched")
    store.release(spark, since, keep=(table, matched))
    contexts = matched.groupBy("h", "e").agg(F.sum("n").alias("n"), F.min(F.struct("key", "s")).alias("one"))
    contexts = store.table(contexts, "contexts")
    kinds = store.table(contexts.groupBy("h").agg(F.count("*").alias("kinds")), "kinds")
    contexts = store.table(contexts.join(kinds, "h"), "contexts")
    # Several contexts share the anchor: each open occurrence, and one of each settled context, is extended window by window.
    judged = matched.drop("n").join(contexts, ["h", "e"]).where("n > 1 or kinds > 1")
    judged = judged.select("key", "h", "s", "w", (F.col("n") > 1).alias("settled"), ((F.col("kinds") > 1) & ((F.col("n") == 1) | (F.struct("key", "s") == F.col("one")))).alias("emit"))
    found = judged.groupBy("key").agg(F.collect_list(F.struct("h", "s", "w", "settled", "emit")).alias("found"))
    one = table.groupBy("key").agg(F.min("doc_id").alias("_id")).join(found, "key")
    one = store.table(one, "found")
    store.release(spark, since, keep=(table, one))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("_key"))
    # Most texts are not touched as a rule: they stay where they are.
    keyed = _sieved(keyed, one, {"_key": "key", "doc_id": "_id"})
    texts = keyed.join(one, (F.col("_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = store.table(texts.select("key", "text", "found").withColumn("tid", F.monotonically_increasing_id()), "texts")
    store.release(spark, since, keep=(table, texts))
    windows = store.table(_windows(texts, length), "windows")
    place = F.struct("tid", "s")
    twice = windows.groupBy("h", "wh").agg(F.max("settled").alias("x"), F.min(place).alias("a"), F.max(place).alias("b")).where("x = 1 or a != b").select("h", "wh")
    more = windows.where("settled = 0").join(twice, ["h", "wh"], "left_semi").groupBy("tid").agg(F.collect_list("s").alias("more"))
    more = store.table(more, "more")
    store.release(spark, since, keep=(table, texts, more))
    settled = F.filter("found", lambda x: x["settled"])
    runs = F.concat(
        F.transform(settled, lambda x: F.struct(x["s"].alias("s"), x["w"].alias("w"))),
        F.transform(F.coalesce("more", F.array().cast("array<int>")), lambda s: F.struct(s.alias("s"), F.lit(0).alias("w"))),
    )
    return table, texts.join(more, "tid", "left").select("key", "text", runs.alias("runs")).where(F.size("runs") > 0)


def removed(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (key, n_removed, kept, kept_sha256, spans) from the texts of :func:`repeats`;
    spans are the maximal repeats, as word positions (start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            words = Words(part.column(1))
            found = part.column(2)
            flat, counts = found.flatten(), np.diff(np.asarray(found.offsets))
            base = np.repeat(words.ptr[:-1], counts)
            s, w = (np.asarray(flat.field(c)).astype(np.int64) for c in ("s", "w"))
            edge = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(edge, base + s, 1)
            np.add.at(edge, base + s + w + length, -1)
            gone = np.cumsum(edge)[:-1] > 0
            kept, sha = _sha(words, ~gone)
            doc = words.doc_of_word()
            begins = gone.copy()
            begins[1:] &= ~(gone[:-1] & (doc[1:] == doc[:-1]))
            ends = gone.copy()
            ends[:-1] &= ~(gone[1:] & (doc[1:] == doc[:-1]))
            a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            ptr = np.searchsorted(a, words.ptr)
            spans = pa.StructArray.from_arrays([pa.array((a - words.ptr[:-1][doc[a]]).astype(np.int32)), pa.array((b - words.ptr[:-1][doc[a]]).astype(np.int32))], ["start", "end"])
            lost = np.bincount(doc[gone], minlength=words.docs)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(lost.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha), pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), spans)],
                ["key", "n_removed", "kept", "kept_sha256", "spans"],
            )

    return texts.select("key", "text", "runs").mapInArrow(run, "key binary, n_removed long, kept string, kept_sha256 string, spans array<struct<start:int,end:int>>")


def _removals(table: DataFrame, texts: DataFrame, columns: list[str]) -> DataFrame:
    """One written row for each text that loses words."""
    lost = removed(texts).select("key", *columns)
    # A text is looked up by its least id; only repeated rows of that id bring it twice.
    twice = table.groupBy("key", "doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return store.table(lost if twice.isEmpty() else lost.dropDuplicates(["key"]), "removed")


def digest(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256) for all documents."""
    since = store.mark()
    with store.lean(docs.sparkSession):
        table, texts = repeats(docs)
        lost = _removals(table, texts, ["n_removed", "kept_sha256"])
    store.release(docs.sparkSession, since, keep=(table, lost))
    return (
        table.select("doc_id", "key", "n_words", "full_sha")
        .join(lost, "key", "left")
        .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "full_sha").alias("kept_sha256"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages: texts that lose words become their kept
    words joined by single spaces, with n_chars to match; other texts stay as they
    are.  Every row stays."""
    since = store.mark()
    with store.lean(docs.sparkSession):
        lost = _removals(*repeats(docs), ["kept"])
    store.release(docs.sparkSession, since, keep=(lost,))
    lost = lost.select(F.col("key").alias("__key"), F.col("kept").alias("__kept"))
    joined = docs.withColumn("__md5", F.unhex(F.md5(F.coalesce("text", F.lit(""))))).join(lost, F.col("__md5") == F.col("__key"), "left")
    changed = {"text": F.coalesce("__kept", "text"), "n_chars": F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.char_length("__kept").cast("long")) if "n_chars" in docs.columns else None}
    return joined.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


ORACLE = """
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT r, s, md5(array_to_string(w[s : s + 34], ' ')) AS k FROM split, unnest(range(1, len(w) - 33)) AS u(s) WHERE len(w) >= 35
), repeated AS (
  SELECT r, s FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1
), covered AS (
  SELECT DISTINCT r, s + d AS i FROM repeated, range(0, 35) AS g(d)
), gone AS (
  SELECT r, list(i) AS gone FROM covered GROUP BY r
), kept AS (
  SELECT r, array_to_string(list(w[i] ORDER BY i), ' ') AS kept
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM split) x WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.r = x.r AND c.i = x.i) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
