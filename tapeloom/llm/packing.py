"""Best-fit packing of token sequences by bin completion.

Only the lengths matter to a packing, and there are at most ``capacity`` of
them, so the plan is made from the histogram of lengths: patterns of lengths
that share a sequence, each with the number of times it is used.  The plan's
size is bounded by the capacity, whatever the number of documents.

Bin completion: the largest length left opens a sequence; the undominated
fillings of the rest of it are listed (best first), the incumbent of each step
being the best-fit filling; a branch is left when its waste exceeds what the
best plan so far allows.  Where the waste bound shows that a plan can't be
improved, the search ends.

Texts are cut only where they exceed the capacity.  Null text is an empty one;
with its end id it is a piece of length 1.  Repeated rows are packed each time;
pieces of one length are alike to the plan, and go by task and place in it.
Texts of any length are encoded whole; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import materialize, read_table
from tapeloom.llm.tokens import WordEncoder, encoder, text_slices, tokenizer_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, nth long"

#: Fillings listed for one sequence, and partial fillings looked at for them.
FILLINGS, LOOKED_AT = 4, 400
#: Steps of the search for a whole plan.
STEPS = 1_500


def best_fit(room: int, sizes: list[int], left: dict[int, int]) -> tuple[int, ...]:
    """The best-fit filling of ``room``: the largest item left that fits, as often as it does, again and again."""
    out: list[int] = []
    i = bisect_right(sizes, room) - 1
    while i >= 0:
        s = sizes[i]
        k = min(left[s], room // s)
        out += [s] * k
        room -= s * k
        i = min(i, bisect_right(sizes, room)) - 1
    return tuple(out)


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of ``b`` fit into those of ``a`` (first fit, which may miss some), so that ``a`` is as good as ``b``."""
    if sum(b) > sum(a):
        return False
    own, other = Counter(a), Counter(b)
    rooms = sorted((own - other).elements())
    for s in sorted((other - own).elements(), reverse=True):
        i = bisect_left(rooms, s)
        if i == len(rooms):
            return False
        insort(rooms, rooms.pop(i) - s)
    return True


def fillings(room: int, sizes: list[int], left: dict[int, int], most: int = FILLINGS, looks: int = LOOKED_AT) -> list[tuple[int, ...]]:
    """Fillings of ``room`` by sizes left (ascending list), undominated ones first: least waste, then fewest and largest items.

    The best-fit filling is found first and outside the budget, however many
    items it takes.  ``looks`` bounds the search for others, which branches on
    how often a size is used.  A filling that leaves room for an item left is
    dominated, and so are others where one item fits exactly.
    """
    first = best_fit(room, sizes, left)
    found: list[tuple[int, tuple[int, ...]]] = [(room - sum(first), first)]
    budget = [looks]
    chosen: list[tuple[int, int]] = []

    def extend(room: int, upto: int, skipped: int) -> None:
        if budget[0] <= 0:
            return
        budget[0] -= 1
        i = min(upto, bisect_right(sizes, room) - 1)
        while i >= 0 and not left[sizes[i]]:
            i -= 1
        if i < 0:
            if room >= skipped:
                return
            own = tuple(s for s, k in chosen for _ in range(k))
            if not any(dominates(f, own) for _, f in found):
                found[:] = [f for f in found if not dominates(own, f[1])] + [(room, own)]
                found.sort(key=lambda f: (f[0], len(f[1])))
                del found[most:]
            return
        s = sizes[i]
        for k in range(min(left[s], room // s), -1, -1):
            chosen.append((s, k))
            extend(room - s * k, i - 1, min(skipped, s) if k < left[s] else skipped)
            chosen.pop()
            if budget[0] <= 0 or (len(found) >= most and found[-1][0] == 0) or (k == 1 and s == room):
                return

    if found[0][0] or most > 1:
        extend(room, len(sizes) - 1, room + 1)
    return [f for _, f in found]


def plan_packing(counts: dict[int, int], capacity: int, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence) and how often each is used, for so many pieces of each length.

    Greedy descent along the best filling of each step gives the first plan; the
    search then goes back over the last steps, the only ones where waste arises,
    trying the other fillings while the waste bound allows a better plan.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if not left:
        return []
    if max(left) > capacity or min(left) < 1:
        raise ValueError("lengths must be from 1 to the capacity")
    total = sum(s * n for s, n in left.items())
    least = -(-total // capacity)

    def descend(left: dict[int, int], first: list[tuple[int, ...]] | None = None) -> tuple[list[tuple[tuple[int, ...], int]], int]:
        left = dict(left)
        sizes = sorted(left)
        plan, bins = [], 0
        while sizes:
            top = sizes[-1]
            left[top] -= 1
            fill = first.pop(0) if first else fillings(capacity - top, sizes, left)[0]
            left[top] += 1
            need: dict[int, int] = {}
            for s in (top, *fill):
                need[s] = need.get(s, 0) + 1
            times = min(left[s] // k for s, k in need.items())
            for s, k in need.items():
                left[s] -= k * times
                if not left[s]:
                    del left[s]
                    sizes.remove(s)
            plan.append(((top, *fill), times))
            bins += times
        return plan, bins

    plan, bins = descend(left)
    # Waste bound: a plan of one sequence less may waste this much in all.
    spent, depth = 0, min(len(plan), 12)
    while bins > least and spent < steps and depth <= len(plan):
        tail, rest = plan[len(plan) - depth :], {}
        for pattern, times in tail:
            for s in pattern:
                rest[s] = rest.get(s, 0) + times
        size = sum(t for _, t in tail)
        bound = -(-sum(s * n for s, n in rest.items()) // capacity)
        better = None
        if bound < size:
            better, used = _search(rest, capacity, size, bound, steps - spent)
            spent += used
        if better:
            plan, bins = plan[: len(plan) - depth] + better, bins - size + sum(t for _, t in better)
        elif depth == len(plan):
            break
        spent += depth
        depth = min(len(plan), depth * 2)
    return plan


def _search(counts: dict[int, int], capacity: int, incumbent: int, least: int, steps: int):
    """Branch and bound on a pattern times its count; the best plan of fewer sequences than ``incumbent``, or None, and steps taken.

    A pattern is used as often as it can be, or ``grain`` times; as what is left
    may take it again, its count is any multiple.  Grains go from the counts'
    common divisor or a quarter of the sequences down to one, so the number of
    sequences doesn't matter.  Each grain has its share of the steps left.
    """
    grains = sorted({gcd(*counts.values()), *(max(1, incumbent // k) for k in (4, 8, 16, 64)), 1}, reverse=True)
    best, spent = None, 0
    for i, grain in enumerate(grains):
        found, used = _search_by(counts, capacity, incumbent, least, (steps - spent) // (len(grains) - i), grain)
        spent += used
        if found:
            best, incumbent = found, sum(t for _, t in found)
        if incumbent <= least:
            break
    return best, spent


def _search_by(counts: dict[int, int], capacity: int, incumbent: int, least: int, steps: int, grain: int):
    left = dict(counts)
    # waste beyond this can't give a better plan
    allowed = (incumbent - 1) * capacity - sum(s * n for s, n in left.items())

    def branches():
        top = max(left)
        left[top] -= 1
        options = fillings(capacity - top, sorted(s for s, n in left.items() if n), left)
        left[top] += 1
        for fill in options:
            waste = capacity - top - sum(fill)
            need = Counter((top, *fill))
            most = min(left[s] // k for s, k in need.items())
            for times in dict.fromkeys((most, min(most, grain))):
                if waste * times <= allowed:
                    yield (top, *fill), need, times, waste * times

    best, spent, taken, stack = None, 0, [], [branches()]
    while stack and spent < steps:
        step = next(stack[-1], None)
        if step is not None:
            spent += 1
            _, need, times, waste = step
            taken.append(step)
            allowed -= waste
            for s, k in need.items():
                left[s] -= k * times
                if not left[s]:
                    del left[s]
            if left:
                stack.append(branches())
                continue
            best = [(pattern, times) for pattern, _, times, _ in taken]
            bins = sum(t for _, t in best)
            if bins <= least:
                break
            allowed -= (incumbent - bins) * capacity
            incumbent = bins
        else:
            stack.pop()
        if taken:
            _, need, times, waste = taken.pop()
            allowed += waste
            for s, k in need.items():
                left[s] = left.get(s, 0) + k * times
    return best, spent


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece, with ``nth``: its place among the pieces of its length in task ``pid``.  No shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("pid", pa.int32()), ("nth", pa.int64())])

    def run(batches):
        enc = encoder(WordEncoder, tokenizer)
        end = np.array([end_id], "<u4")
        seen = np.zeros(capacity + 1, np.int64)
        for b in text_slices(batches):
            if not b.num_rows:
                continue
            pid = b.column("pid")[0].as_py()
            doc, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, ids in zip(b.column("doc_id").to_pylist(), enc.encode(pc.fill_null(b.column("text"), ""))):
                ids = np.concatenate([ids, end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(own))
                    crc.append(zlib.crc32(own))
                    nth.append(int(seen[len(own)]))
                    seen[len(own)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((doc, piece, start, length, crc, [pid] * len(doc), nth), schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.spark_partition_id().alias("pid"))
    return rows.mapInArrow(run, PIECES)


def assign(pieces: DataFrame, plan: list[tuple[tuple[int, ...], int]], id_cols: list[str]) -> DataFrame:
    """Give the r-th piece of a length (column ``rank``) its sequence and offset under the plan."""
    runs: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for s in pattern:
            offsets.setdefault(s, []).append(at)
            at += s
        for s, places in offsets.items():
            runs.setdefault(s, []).append((given.get(s, 0), sequence, tuple(places)))
            given[s] = given.get(s, 0) + len(places) * times
        sequence += times
    table = {s: ([r[0] for r in rows], rows) for s, rows in runs.items()}
    names = [*id_cols, "length", "rank"]

    def run(batches):
        for b in batches:
            seq, off = [], []
            for s, r in zip(b.column("length").to_pylist(), b.column("rank").to_pylist()):
                firsts, rows = table[s]
                base, first, places = rows[bisect_right(firsts, r) - 1]
                seq.append(first + (r - base) // len(places))
                off.append(places[(r - base) % len(places)])
            keep = [b.column(c) for c in b.schema.names if c not in ("rank",)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*(c for c in b.schema.names if c != "rank"), "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.select(*names).dtypes if n != "rank")
    return pieces.select(*names).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with the sequence and offset each is given.

    The pieces' table is written once; the plan sees the histogram of lengths
    (at most ``capacity`` rows).  A piece's rank within its length is its place
    in its task plus the counts of the tasks before, so no length is gathered
    in one place however frequent it is.
    """
    pieces = materialize(pieces_of(docs, tokenizer, capacity, end_id), "pieces")
    each = pieces.groupBy("length", "pid").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    starts = each.select("length", "pid", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["length", "pid"]).withColumn("rank", F.col("before") + F.col("nth"))
    return assign(ranked, plan_packing(counts, capacity), ["doc_id", "piece", "start", "ids_crc32"])


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
