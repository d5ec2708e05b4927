"""Brown class-based bigram language model.

Exchange clustering assigns words to classes in two steps.  The most frequent training
words are exchanged one by one in the driver, together with a few shared units that
stand for all other words by ending and length.  Then every other word that training
saw twice or more is exchanged against the class table that came of it: its counts by
class of the word before and of the word after, gathered from all training texts and
never by the driver, say which class it raises most.  Words seen once, like words never
seen, stay with their shared unit.  Class transitions, counted anew with these classes,
and word emissions give a smoothed log probability; perplexity follows from it.

All counts cover all training documents.  Only tables of a fixed bound come to the
driver or are broadcast: the ``TOP`` most frequent words and the bigram counts of
``UNITS`` units.  Other words meet their counts and classes by a shuffle join.

Words are known by 64-bit hashes of their lower-cased bytes.

Defined results: a null text is empty and scores its end token alone; repeated rows
score alike and each count in training; a very long text is scored whole, in memory of
some twenty times its length; with no training rows every word is unknown and all
classes are equally likely; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .words import Words, chunks, lists, mix, per_doc

#: Words broadcast with their counts; a proven bound of 16 bytes each.
TOP = 65536
#: Words that are units of their own, and units that the other words share.
OWN_UNITS = 768
SHARED_UNITS = 32
CLASSES = 32
DISCOUNT = 0.1
FOLDS = 10
#: Bounds of a worker's memory: rows sent to it at a time, bytes of text cut at a time, rows
#: held before they are combined, and counts weighed at a time (some 2 KB each for 32 classes).
BATCH_ROWS = 512
CUT_BYTES = 256 << 10
HELD_ROWS = 250_000
WEIGHED = 1 << 14
#: Stands for the end of a text; it has no bytes, so no word is taken for it.
END = np.uint64(0xE0D0E0D0E0D0E0D1)


def small_batches(step: Callable) -> Callable:
    """The step, all of whose tables are written before it returns, with Arrow batches of at
    most ``BATCH_ROWS`` rows: whole texts stand in them, in the JVM and in the worker."""

    @functools.wraps(step)
    def run(df: DataFrame, *args, **kwargs):
        conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        rows = int(was := conf.get(key))
        conf.set(key, min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)
        try:
            return step(df, *args, **kwargs)
        finally:
            conf.set(key, was)

    return run


def shared_unit(words: Words) -> np.ndarray:
    """The shared unit of each word, by its last byte and its length."""
    last = words.raw[words.end - 1].astype(np.int64)
    return (last * 7 + np.minimum(words.end - words.start, 16)) % SHARED_UNITS


def _with_end(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes and shared units with an end token after each document, and pointers."""
    hashes = np.insert(words.hashes(), words.ptr[1:], END)
    units = np.insert(shared_unit(words), words.ptr[1:], 0)
    return hashes, units, words.ptr + np.arange(words.docs + 1)


def _summed(parts: list[tuple]) -> tuple:
    """One row for each key, which comes first: its last value summed, the others as met."""
    key, *others, n = (np.concatenate(c) for c in zip(*parts))
    parts.clear()
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    first = order[starts]
    return key[starts], *(c[first] for c in others), np.add.reduceat(n[order], starts) if len(n) else n


def combined(found: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (key, others, n) combined by key before the shuffle, in bounded memory: at most
    ``HELD_ROWS`` and those of one part are held."""
    held, size = [], 0
    for part in found:
        held.append(_summed([part]))
        size += len(held[-1][0])
        if size > HELD_ROWS:
            held = [_summed(held)]
            size = len(held[0][0])
            if size > HELD_ROWS // 2:
                yield held.pop()
                size = 0
    if held:
        yield _summed(held)


def word_counts(train: DataFrame) -> DataFrame:
    """Rows (h, unit, n): every training token with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for part in chunks(batches, "text", CUT_BYTES):
                hashes, units, _ = _with_end(Words(part.column(0), lower=True))
                yield hashes, units.astype(np.int32), np.ones(len(hashes), np.int64)

        for keys, units, n in combined(found()):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(units), pa.array(n)], ["h", "unit", "n"])

    return train.select("text").mapInArrow(run, "h long, unit int, n long").groupBy("h").agg(F.min("unit").alias("unit"), F.sum("n").alias("n"))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = 8) -> np.ndarray:
    """Classes of units by exchange: each unit in turn moves to the class that raises
    the likelihood of the class bigrams most, until none moves."""
    units = len(bigrams)
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1)), kind="stable")
    member = np.zeros(units, np.int64)
    member[order] = np.arange(units) % classes
    one_hot = np.eye(classes)[member]
    to, fro = bigrams @ one_hot, bigrams.T @ one_hot  # by unit: counts to and from classes
    table = one_hot.T @ to

    def ent(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(rounds):
        moved = 0
        for u in order:
            a, own = member[u], bigrams[u, u]
            out, into = to[u].copy(), fro[u].copy()
            out[a] -= own
            into[a] -= own
            base = table.copy()
            base[a] -= out
            base[:, a] -= into
            base[a, a] -= own
            rows, cols = base.sum(1), base.sum(0)
            diag = base.diagonal()
            # Joining class b adds out to row b, into to column b, and own to their crossing.
            gain = (ent(base + out) - ent(base)).sum(1) + (ent(base.T + into) - ent(base.T)).sum(1)
            gain += ent(diag + out + into + own) + ent(diag) - ent(diag + out) - ent(diag + into)
            row_up, col_up = out.sum() + own, into.sum() + own
            gain -= ent(rows + row_up) - ent(rows) + ent(cols + col_up) - ent(cols)
            b = int(np.argmax(gain))
            if gain[b] > gain[a] + 1e-9:
                moved += 1
                member[u] = b
                to[:, a] -= bigrams[:, u]
                to[:, b] += bigrams[:, u]
                fro[:, a] -= bigrams[u]
                fro[:, b] += bigrams[u]
            b = member[u]
            table = base
            out, into = to[u].copy(), fro[u].copy()
            out[b] -= own
            into[b] -= own
            table[b] += out
            table[:, b] += into
            table[b, b] += own
        if not moved:
            break
    return member


def _units(own: np.ndarray, own_units: np.ndarray, hashes: np.ndarray, shared: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(own, hashes), max(len(own) - 1, 0))
    return np.where(own[at] == hashes, own_units[at], shared) if len(own) else shared


def unit_bigrams(train: DataFrame, own: np.ndarray, own_units: np.ndarray, units: int) -> np.ndarray:
    """Counts of adjacent units in all training texts; a text begins after an end."""
    end_unit = int(_units(own, own_units, np.array([END]), np.zeros(1, np.int64))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(units * units, np.int64)
        for part in chunks(batches, "text", CUT_BYTES):
            hashes, shared, ptr = _with_end(Words(part.column(0), lower=True))
            u = _units(own, own_units, hashes, shared)
            before = np.concatenate([[end_unit], u[:-1]])
            total += np.bincount(before * units + u, minlength=units * units)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    found = train.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(units * units)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(units, units)


def contexts(train: DataFrame, own: np.ndarray, own_units: np.ndarray, member: np.ndarray, classes: int) -> DataFrame:
    """Rows (h, a, slot, n) of every training word without a unit of its own: its class so far
    and how often the word before it (slot below ``classes``) or after it is of a class, dealt by h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for part in chunks(batches, "text", CUT_BYTES):
                hashes, shared, ptr = _with_end(Words(part.column(0), lower=True))
                units = _units(own, own_units, hashes, shared)
                cls = member[units]
                # A text begins after an end; its last token is an end, which has a unit.
                before, after = np.roll(cls, 1), np.roll(cls, -1)
                before[ptr[:-1]] = member[units[ptr[1:] - 1]]
                at = np.flatnonzero(units < SHARED_UNITS)
                h, pair = hashes[at], before[at] * classes + after[at]
                yield mix(h ^ mix(pair.astype(np.uint64) + np.uint64(1))), h, cls[at].astype(np.int8), pair.astype(np.int32), np.ones(len(h), np.int64)

        for _, h, a, pair, n in combined(found()):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(a), pa.array(pair), pa.array(n)], ["h", "a", "pair", "n"])

    # Dealt by word once, both neighbours in one row, which is parted afterwards.
    dealt = train.select("text").mapInArrow(run, "h long, a byte, pair int, n long").repartition("h")
    return dealt.select("h", "a", F.explode(F.expr(f"array(smallint(pair div {classes}), smallint(pair % {classes} + {classes}))")).alias("slot"), "n")


def assigned(context: DataFrame, table: np.ndarray) -> DataFrame:
    """Rows (h, cls): for words seen twice or more the class that raises the likelihood
    of the class bigrams ``table`` most, by one exchange of all words at once."""
    classes = len(table)
    rows, cols = table.sum(1), table.sum(0)
    by_slot = np.concatenate([table, table.T])  # what meets class b: before it, then after it

    def ent(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    def gain(held: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What n more bring to each class, and what the same n brought where they are."""
        return ent(held + n) - ent(held), ent(held) - ent(np.maximum(held - n, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends, end = np.asarray(whole.column(2).offsets), 0
            while end < whole.num_rows:
                begin = end
                end = max(int(np.searchsorted(ends, ends[begin] + WEIGHED, "right")) - 1, begin + 1)
                part = whole.slice(begin, end - begin)
                found = part.column(2)
                flat, counts = found.flatten(), np.diff(np.asarray(found.offsets))
                slot, n = np.asarray(flat.field("slot")).astype(np.int64), np.asarray(flat.field("n"))
                now, total = np.asarray(part.column(1)).astype(np.int64), np.asarray(part.column(3))
                word, starts = np.repeat(np.arange(len(now)), counts), np.cumsum(counts) - counts
                kinds, back = np.unique(slot * (1 << 48) + n, return_inverse=True)
                join, leave = gain(by_slot[kinds >> 48], (kinds & ((1 << 48) - 1)).astype(float)[:, None])
                each = join[back]
                each[np.arange(len(word)), now[word]] = leave[back, now[word]]
                score = np.add.reduceat(each, starts, axis=0)
                for margin in (rows, cols):
                    add, lost = gain(margin[None, :], total.astype(float)[:, None])
                    add[np.arange(len(now)), now] = lost[np.arange(len(now)), now]
                    score -= add
                best = score.argmax(axis=1)
                stay = score[np.arange(len(now)), best] <= score[np.arange(len(now)), now] + 1e-9
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(stay, now, best).astype(np.int32))], ["h", "cls"])

    # The counts of a word are at most two for each class.
    summed = context.groupBy("h", "a", "slot").agg(F.sum("n").alias("n"))
    listed = summed.groupBy("h", "a").agg(F.array_sort(F.collect_list(F.struct("slot", "n"))).alias("found"), F.sum(F.when(F.col("slot") < classes, F.col("n")).otherwise(0)).alias("total"))
    return listed.where("total > 1").mapInArrow(run, "h long, cls int")


@dataclass
class Lexicon:
    """Words with their counts and classes."""

    top: np.ndarray  #: the most frequent words' hashes, ascending
    top_counts: np.ndarray
    top_classes: np.ndarray
    shared: np.ndarray  #: class of each shared unit
    end: int  #: class of the end token
    classes: int
    tokens: int
    distinct: int
    words: np.ndarray  #: distinct words of each class
    known: DataFrame  #: (h, n, cls) of all training words


@dataclass
class Model:
    lexicon: Lexicon
    step: np.ndarray  #: log10 of class transitions
    base: np.ndarray  #: log10 of each class's emission denominator


@small_batches
def lexicon_of(train: DataFrame, top: int = TOP, own_units: int = OWN_UNITS, classes: int = CLASSES) -> Lexicon:
    counts = store.table(word_counts(train), "counts")
    totals = counts.agg(F.sum("n").alias("N"), F.count("*").alias("V")).first()
    h = counts.orderBy(F.desc("n"), "h").limit(own_units).select("h").toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64)
    # Units: shared ones first, then the most frequent words; the end is always one.
    own = np.sort(h if END in h else np.append(h[: max(own_units - 1, 0)], END))
    own_ids = SHARED_UNITS + np.arange(len(own))
    units = SHARED_UNITS + len(own)
    member = exchange(bigrams := unit_bigrams(train, own, own_ids, units), classes)
    one_hot = np.eye(classes)[member]
    moved = assigned(contexts(train, own, own_ids, member, classes), one_hot.T @ bigrams @ one_hot)
    shared = member[:SHARED_UNITS]
    by_unit = F.get(F.array(*[F.lit(int(c)) for c in shared]), F.col("unit"))
    known = store.table(counts.join(moved, "h", "left").select("h", "n", F.coalesce("cls", by_unit).alias("cls")), "known")
    named = F.col("h").isin([int(x) for x in own.view(np.int64)])
    best = known.orderBy(F.desc("n"), "h").limit(top).union(known.where(named)).distinct().toArrow()
    h, n, cls = (best.column(c).to_numpy().astype(np.int64) for c in ("h", "n", "cls"))
    h = h.view(np.uint64)
    at = np.argsort(h)
    h, n, cls = h[at], n[at], cls[at]
    words = np.zeros(classes)
    found = known.groupBy("cls").agg(F.count("*").alias("v")).toArrow()
    words[found.column("cls").to_numpy()] = found.column("v").to_numpy()
    # Words with a unit of their own have its class.
    is_own = np.isin(h, own)
    words -= np.bincount(cls[is_own], minlength=classes)
    cls[is_own] = member[own_ids[np.searchsorted(own, h[is_own])]]
    words += np.bincount(cls[is_own], minlength=classes)
    end = int(member[own_ids[np.searchsorted(own, END)]])
    return Lexicon(h, n, cls, shared, end, classes, int(totals["N"] or 0), int(totals["V"]), words, known)


@small_batches
def resolved(docs: DataFrame, lexicon: Lexicon, carry: list[str]) -> DataFrame:
    """Rows (carried columns, n_tokens, n_known, logs, classes), written: the class of
    every token, one byte each, and the sum of log10 of the smoothed counts."""
    kinds = dict(docs.dtypes)
    names = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", " * bool(carry)
    top, top_counts, top_classes = (lexicon.top, lexicon.top_counts, lexicon.top_classes) if len(lexicon.top) else (np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64))
    some, shared_class, end = len(lexicon.top) > 0, lexicon.shared, lexicon.end

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text", CUT_BYTES):
            hashes, shared, ptr = _with_end(Words(part.column(len(carry)), lower=True))
            at = np.minimum(np.searchsorted(top, hashes), len(top) - 1)
            hit = (top[at] == hashes) & some
            cls = np.where(hit, top_classes[at], shared_class[shared])
            cls[ptr[1:] - 1] = end
            # Sums of each document on its own, so that equal texts score alike to the last bit.
            logs = np.add.reduceat(np.where(hit, np.log10(top_counts[at] + DISCOUNT), 0.0), ptr[:-1])
            rare = np.flatnonzero(~hit)
            rare_ptr = np.searchsorted(rare, ptr)
            place = rare - np.repeat(ptr[:-1], np.diff(rare_ptr))
            data = pa.Array.from_buffers(pa.binary(), len(ptr) - 1, [None, pa.py_buffer(ptr.astype(np.int32)), pa.py_buffer(cls.astype(np.uint8))])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[: len(carry)], pa.array(np.diff(ptr)), pa.array(per_doc(hit, ptr)), pa.array(logs), data, lists(hashes[rare], rare_ptr, pa.int64()), lists(place.astype(np.int32), rare_ptr, pa.int32())],
                [*carry, "n_tokens", "n_known", "logs", "classes", "rare", "place"],
            )

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(carry)
            n, logs, known = (np.array(batch.column(rows + i)) for i in range(3))
            data = [bytearray(x) for x in batch.column(rows + 3).to_pylist()]
            for i, found in enumerate(batch.column(rows + 4)):
                if found.is_valid and len(found.values):
                    place, c, cls = (np.asarray(found.values.field(k)) for k in ("place", "n", "cls"))
                    seen = c > 0
                    np.frombuffer(data[i], np.uint8)[place[seen]] = cls[seen]
                    logs[i] += np.log10(c + DISCOUNT).sum()
                    known[i] += seen.sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:rows], pa.array(n), pa.array(known), pa.array(logs), pa.array([bytes(x) for x in data], pa.binary())], [*carry, "n_tokens", "n_known", "logs", "classes"])

    text = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").alias("_text"))
    partial = text.mapInArrow(cut, names + "n_tokens long, n_known long, logs double, classes binary, rare array<long>, place array<int>")
    partial = store.table(partial.withColumn("_row", F.monotonically_increasing_id()), "partial")
    # Words below the top that are unknown keep the smallest share; a left join finds them.
    rare = partial.select("_row", F.explode(F.arrays_zip(F.col("rare").alias("h"), F.col("place").alias("place"))).alias("r")).select("_row", "r.h", "r.place")
    met = rare.join(lexicon.known, "h", "left").select("_row", "place", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("cls", F.lit(0)).alias("cls"))
    found = met.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("place", "n", "cls"))).alias("found"))
    whole = partial.join(found, "_row", "left").select(*[F.col(f"`{c}`") for c in carry], "n_tokens", "logs", "n_known", "classes", "found")
    return store.table(whole.mapInArrow(filled, names + "n_tokens long, n_known long, logs double, classes binary"), "resolved")


def _flat(part: pa.RecordBatch, at: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens, of the tokens before them, and pointers."""
    data = part.column(at).to_pylist()
    cls = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    ptr = np.cumsum([0, *map(len, data)])
    before = np.roll(cls, 1)
    before[ptr[:-1]] = end
    return cls, before, ptr


def model_of(train: DataFrame, lexicon: Lexicon) -> Model:
    """The model from the resolved training documents."""
    classes, end = lexicon.classes, lexicon.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for part in batches:
            if part.num_rows:
                cls, before, _ = _flat(part, 0, end)
                total += np.bincount(before * classes + cls, minlength=classes * classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["pair", "n"])

    found = train.select("classes").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(classes * classes)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    table = table.reshape(classes, classes)
    step = np.log10((table + DISCOUNT) / (table.sum(1, keepdims=True) + DISCOUNT * classes))
    return Model(lexicon, step, np.log10(table.sum(0) + DISCOUNT * (lexicon.words + 1)))


def fit(train: DataFrame, top: int = TOP, own_units: int = OWN_UNITS, classes: int = CLASSES) -> Model:
    lexicon = lexicon_of(train, top, own_units, classes)
    return model_of(resolved(train, lexicon, []), lexicon)


def evaluated(found: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """Rows (carried columns, n_tokens, n_known, base_score, score) of resolved documents."""
    kinds = dict(found.dtypes)
    step, base, end = model.step, model.base, model.lexicon.end
    known_base = float(np.log10(model.lexicon.tokens + DISCOUNT * (model.lexicon.distinct + 1)))
    rows = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                cls, before, ptr = _flat(part, rows + 3, end)
                moves = np.add.reduceat(step[before, cls] - base[cls], ptr[:-1])
                n, logs = np.asarray(part.column(rows)), np.asarray(part.column(rows + 2))
                yield pa.RecordBatch.from_arrays([*part.columns[: rows + 2], pa.array(logs - n * known_base), pa.array(logs + moves)], [*carry, "n_tokens", "n_known", "base_score", "score"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", " * bool(carry) + "n_tokens long, n_known long, base_score double, score double"
    return found.select(*[F.col(f"`{c}`") for c in carry], "n_tokens", "n_known", "logs", "classes").mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """Rows (carried columns, n_tokens, n_known, base_score, score) for all documents."""
    return evaluated(resolved(docs, model.lexicon, carry), model, carry)


def held_out(folds: int = FOLDS) -> Column:
    """Documents whose id falls into fold 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))


def perplexity(score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / n_tokens)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = lexicon_of(docs.where(~held_out()))
    found = resolved(docs.select("doc_id", "text"), lexicon, ["doc_id"])
    model = model_of(found.where(~held_out()), lexicon)
    return evaluated(found, model, ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(lexicon.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity(F.col("score"), F.col("n_tokens")).alias("perplexity")
    )
