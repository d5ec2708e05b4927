"""Best-fit packing of token sequences by bin completion.

Only the histogram of piece lengths comes to the driver.  There bin completion plans
patterns: around the largest remaining piece, undominated fillings are enumerated,
branches are pruned by the waste that the incumbent still allows, and the
best-fit-decreasing plan is the first incumbent.  A pattern is used as often as the
counts allow, or once, so every multiplicity can be reached.  With :data:`COMPLETE` the
search ends only with a least number of sequences; with the usual effort, which grows
with the number of lengths, the best plan found stands.  Pieces as long as a sequence need no plan.
All others are ranked within their length, salted by how many there are so that a
common length is no hot spot, and looked up in the plan.

Defined results: a null text is empty and packs as its end id alone; equal texts and
repeated rows are packed each on their own; only documents of over ``capacity`` ids
are cut; a very long text is encoded whole, in memory of some twenty times its length;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .tokens import tokenizer
from .words import Words, chunks, lists

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are ranked in one task.
SALT_ROWS = 100_000

Pattern = tuple[tuple[int, int], ...]
Plan = list[tuple[Pattern, int]]


@dataclass(frozen=True)
class Effort:
    """Limits of the search; None is no limit."""

    nodes: int | None = None  #: sequences completed
    fillings: int | None = None  #: branches of a node
    steps: int | None = None  #: pieces tried for the fillings of a node
    width: int | None = None  #: lengths tried for one space


COMPLETE = Effort()


def usual_effort(lengths: int) -> Effort:
    return Effort(4000 + 2 * lengths, 12, 200, 4)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram, whole groups of equal bins at a time."""
    open_bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    full: list[tuple[dict[int, int], int]] = []

    def put(room: int, pattern: dict[int, int], n: int) -> None:
        (open_bins.setdefault(room, []) if room else full).append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                each = capacity // length
                for k, n in ((each, left // each), (left % each, 1)):
                    if k and n:
                        put(capacity - k * length, {length: k}, n)
                break
            pattern, n = open_bins[room].pop()
            each = min(room // length, left)
            used = min(n, left // each)
            if used < n:
                open_bins[room].append((pattern, n - used))
            if not open_bins[room]:
                del open_bins[room]
            put(room - each * length, pattern | {length: pattern.get(length, 0) + each}, used)
            left -= used * each
    bins = full + [b for group in open_bins.values() for b in group]
    return [(tuple(sorted(p.items(), reverse=True)), n) for p, n in bins]


def _fits_inside(small: list[int], large: list[int]) -> bool:
    """Whether the items of ``small`` go into bins of the sizes ``large``."""
    if not small:
        return True
    head, rest = small[0], small[1:]
    for i in range(len(large)):
        if large[i] >= head and _fits_inside(rest, [*large[:i], large[i] - head, *large[i + 1 :]]):
            return True
    return False


def fillings(room: int, lengths: list[int], counts: dict[int, int], effort: Effort = COMPLETE) -> list[list[int]]:
    """Undominated maximal fillings of ``room`` from ascending ``lengths``, least waste first."""
    found: list[list[int]] = []
    most, width = effort.steps or 1 << 60, effort.width or 1 << 60
    steps = 0

    def extend(top: int, space: int, chosen: list[int]) -> None:
        nonlocal steps
        steps += 1
        closed, tried = True, 0
        at = bisect_right(lengths, min(top, space)) - 1
        while at >= 0 and tried < width and steps < most:
            x = lengths[at]
            if chosen.count(x) < counts[x]:
                closed, tried = False, tried + 1
                extend(x, space - x, [*chosen, x])
                if x == space:  # one that fits exactly dominates all that follow
                    break
            at -= 1
        if closed and chosen:
            found.append(chosen)

    extend(room, room, [])
    kept: list[list[int]] = []
    for f in sorted(found, key=lambda f: (room - sum(f), len(f))):
        if effort.fillings is not None and len(kept) >= effort.fillings:
            break
        if not any(_fits_inside(f, k) for k in kept if len(f) <= 5):
            kept.append(f)
    return kept or [[]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by pieces that can't share."""
    n = np.zeros(capacity + 2, np.int64)
    n[list(counts)] = list(counts.values())
    some = np.concatenate([[0], np.cumsum(n)])  # some[x]: pieces shorter than x
    mass = np.concatenate([[0], np.cumsum(n * np.arange(capacity + 2))])
    half = capacity // 2 + 1
    small = np.arange(1, half)
    alone = some[capacity + 1] - some[capacity - small + 1]
    pairs = some[capacity - small + 1] - some[half]
    spare = capacity * pairs - (mass[capacity - small + 1] - mass[half])
    rest = mass[half] - mass[small]
    sharing = alone + pairs + np.maximum(0, -(-(rest - spare) // capacity))
    return int(max(-(-mass[-1] // capacity), sharing.max(initial=0)))


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, effort: Effort | None = None) -> Plan:
    """A packing of a histogram of lengths by bin completion, in bulk steps."""
    counts = {x: n for x, n in counts.items() if n}
    effort = effort or usual_effort(len(counts))
    total = sum(x * n for x, n in counts.items())
    plan = best_fit(counts, capacity)
    bins = sum(n for _, n in plan)
    least = lower_bound(counts, capacity) if counts else 0
    nodes = 0
    # Depth first: (counts before the step, the step, bins and waste with it, path before it).
    stack: list[tuple] = [(counts, None, 0, 0, None)]
    while stack and bins > least and (effort.nodes is None or nodes < effort.nodes):
        left, step, used, waste, path = stack.pop()
        nodes += 1
        if waste > (bins - 1) * capacity - total:  # can't end below the incumbent
            continue
        if step:
            need, times = step
            left = dict(left)
            for x, k in need.items():
                left[x] -= k * times
                if not left[x]:
                    del left[x]
            path = ((tuple(sorted(need.items(), reverse=True)), times), path)
        if not left:
            steps: Plan = []
            while path:
                steps.append(path[0])
                path = path[1]
            plan, bins = steps[::-1], used
            continue
        lengths = sorted(left)
        largest = lengths[-1]
        left[largest] -= 1
        often, once = [], []
        for filling in fillings(capacity - largest, lengths, left, effort):
            need = Counter([largest, *filling])
            times = min((left[x] + (x == largest)) // k for x, k in need.items())
            for into, n in ((often, times), (once, 1)):
                if into is often or times > 1:
                    into.append((left, (need, n), used + n, waste + n * (capacity - largest - sum(filling)), path))
        left[largest] += 1
        stack += once[::-1] + often[::-1]
    return plan


class Lookup:
    """Places of ranked pieces: the piece of a length with a rank goes to a sequence
    and an offset there."""

    def __init__(self, plan: Plan):
        rows, next_bin, given = [], 0, {}
        for pattern, times in plan:
            offset = 0
            for length, k in pattern:
                rank = given.get(length, 0)
                rows.append(((length << 44) + rank, k, next_bin, offset))
                given[length] = rank + k * times
                offset += k * length
            next_bin += times
        rows.sort()
        self.key, self.each, self.bin, self.offset = (np.array(c, np.int64) for c in (zip(*rows) if rows else ([], [], [], [])))

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 44) + rank
        row = np.searchsorted(self.key, key, "right") - 1
        within = key - self.key[row]
        return self.bin[row] + within // self.each[row], self.offset[row] + within % self.each[row] * length


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) for all documents, and ``ids``
    if asked for."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = tokenizer(path)
        for part in chunks(batches, "text"):
            words = Words(part.column(1))
            ids, bounds = engine.encode(words)
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            bounds = bounds + np.arange(words.docs + 1)
            sizes = np.diff(bounds)
            cuts = -(-sizes // capacity)
            doc = np.repeat(np.arange(words.docs), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            a = bounds[:-1][doc] + start
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(a.tolist(), (a + length).tolist())]
            columns = [part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(lists(ids.astype(np.int32), np.append(a, bounds[-1]), pa.int32()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, effort: Effort | None = None, with_ids: bool = False, salt_rows: int = SALT_ROWS) -> DataFrame:
    """The pieces with sequence_id and offset."""
    cut = store.table(pieces(docs, path, capacity, with_ids=with_ids).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    short = cut.where(F.col("length") < capacity)
    totals = np.zeros(capacity, np.int64)
    found = short.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    totals[found.column("length").to_numpy()] = found.column("n").to_numpy()
    salts = 1 + totals // salt_rows
    first = np.cumsum(salts) - salts
    salt = F.pmod(F.xxhash64("_row"), F.get(F.array(*[F.lit(int(s)) for s in salts]), F.col("length").cast("int"))).cast("int")
    short = short.withColumn("_salt", salt)
    # One row for each salt_rows pieces and one for each length.
    found = short.groupBy("length", "_salt").agg(F.count("*").alias("n")).toArrow()
    table = np.zeros(int(salts.sum()), np.int64)
    table[first[found.column("length").to_numpy()] + found.column("_salt").to_numpy()] = found.column("n").to_numpy()
    base = np.cumsum(table) - table
    base -= np.repeat(base[first], salts)
    plan = plan_bins({int(x): int(totals[x]) for x in np.flatnonzero(totals)}, capacity, effort)
    place, planned = Lookup(plan), sum(n for _, n in plan)
    ranked = short.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")))
    keep = [c for c in cut.columns if not c.startswith("_")]
    at = {c: i for i, c in enumerate(ranked.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            size = np.asarray(part.column(at["length"]))
            rank = base[first[size] + np.asarray(part.column(at["_salt"]))] + np.asarray(part.column(at["_rank"])) - 1
            sequence, offset = place(size, rank)
            yield pa.RecordBatch.from_arrays([*(part.column(at[c]) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    kinds = dict(cut.dtypes)
    placed = ranked.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", sequence_id long, offset long")
    # A whole sequence each, numbered after the planned ones.
    full = cut.where(F.col("length") == capacity).select(*keep, (F.col("_row") + planned).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids) from :func:`pack` with ids: at most a capacity each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
