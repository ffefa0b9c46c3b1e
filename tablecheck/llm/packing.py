"""Best-fit packing of documents into fixed-length sequences by bin completion.

Only lengths matter to the packing, and there are at most ``capacity`` of them.  So
the plan is made on a histogram of piece lengths (at most ``capacity`` rows, whatever
the corpus), as runs of equal sequences: (filling, how many sequences have it).  The
pieces then find their place by their rank among the pieces of their length, all in
parallel tasks.

Planning is a branch and bound over fillings (bin completion).  A node takes the
longest remaining length, enumerates the undominated fillings of the room beside it,
least waste first, and branches on them with every multiplicity the counts allow,
greatest first.  A branch ends where its sequences plus the waste bound of what remains
cannot beat the incumbent; at every node the best-fit packing of the remaining counts
completes the path and may become the incumbent.

The search has three limits, all parameters of :func:`plan_packing`: ``max_nodes``
nodes, ``most_fillings`` fillings for a node and ``max_steps`` steps to enumerate them.
They bound planning time only; every piece is packed either way.  A plan is a proven
optimum if it meets :func:`waste_bound`, or if the search ran to its end with all three
limits off (None); otherwise it is the best found.

Ranks: a task numbers its pieces per length while it writes them, and per-(task,
length) totals, summed over the tasks before, complete the rank, so a length that
holds a third of all pieces is spread over all tasks.

Defined cases: null text is empty and still gets its end id; repeated rows are
separate pieces; a null id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import byte_bpe, text_rows

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first
Plan = list[tuple[Filling, int]]  # (filling, how many sequences)

SHARES = 4  # order of branches only: how many times its share of the spare room a filling may waste to come first

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long")


def waste_bound(counts: np.ndarray, capacity: int) -> int:
    """A number of sequences that no packing of ``counts[length]`` pieces can beat.

    For every threshold k: pieces over ``capacity - k`` leave no room for any of
    length k or more; those over half need a sequence each, and the waste beside
    them can only be filled with pieces of k up to half.
    """
    sizes = np.arange(capacity + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * sizes)
    half = capacity // 2
    k = np.arange(half + 1)
    large = n[capacity] - n[capacity - k]
    middle = n[capacity - k] - n[half]
    middle_size = total[capacity - k] - total[half]
    small = total[half] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    beyond = np.maximum(0, -(-(small - (middle * capacity - middle_size)) // capacity))
    return int(max((large + middle + beyond).max(), -(-total[capacity] // capacity)))


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing on the histogram: each length goes where it leaves least room."""
    by_room: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []  # the keys of by_room, ascending

    def put(room: int, filling: Filling, many: int) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((filling, many))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        for room in rooms[bisect_left(rooms, length):]:
            group, kept = by_room[room], []
            fits = room // length
            for filling, many in group:
                full, part = (min(many, left // fits), 0)
                left -= full * fits
                if full < many and left:
                    part, left = left, 0
                for used, copies in ((full, fits), (1 if part else 0, part)):
                    if used:
                        put(room - copies * length, filling + ((length, copies),), used)
                if rest := many - full - (1 if part else 0):
                    kept.append((filling, rest))
            if kept:
                by_room[room] = kept
            else:
                del by_room[room]
                del rooms[bisect_left(rooms, room)]
            if not left:
                break
        fits = capacity // length
        if left >= fits:
            put(capacity - fits * length, ((length, fits),), left // fits)
        if left % fits:
            put(capacity - left % fits * length, ((length, left % fits),), 1)
    return [item for group in by_room.values() for item in group]


def fillings(counts: np.ndarray, room: int, max_steps: int | None = None) -> Iterator[tuple[int, Filling]]:
    """Undominated (waste, filling) for ``room``, least waste first, longer pieces first.

    A filling is dominated, and left out, if a further piece still fits beside it, if one
    of its pieces could be exchanged for a longer unused piece, or if several of them
    together could be exchanged for one unused piece, without overflowing.  Sets of sums
    and lengths are integers with a bit for each; ``reach[i]`` holds the sums that pieces
    from the i-th longest length on can make, so that no step leads nowhere.
    """
    lengths = [int(x) for x in np.flatnonzero(counts[:room + 1])[::-1] if x]
    copies_of = [min(int(counts[x]), room // x) for x in lengths]
    within = (1 << room + 1) - 1
    reach = [1]
    for length, copies in zip(reversed(lengths), reversed(copies_of), strict=True):
        sums, step = reach[-1], 1
        while copies:
            step = min(step, copies)
            sums |= sums << step * length & within
            copies, step = copies - step, 2 * step
        reach.append(sums)
    reach.reverse()
    # index of the longest length that a room can take
    longest_in = np.searchsorted(-np.asarray(lengths, np.int64), -np.arange(room + 1)).tolist()
    unused = sum(1 << x for x in lengths)
    steps = 0

    def extend(at: int, left: int, taken: Filling, free: int, ones: int, more: int) -> Iterator[tuple[Filling, int, int, int]]:
        """``ones`` and ``more``: sums of at most one, and of several, of the pieces taken."""
        nonlocal steps
        if not left:
            yield taken, free, ones, more
            return
        for i in range(max(at, longest_in[left]), len(lengths)):
            length = lengths[i]
            grown = [(ones, more)]
            for _ in range(min(left // length, copies_of[i])):
                one, many = grown[-1]
                grown.append((one | 1 << length, many | (many | one & ~1) << length))
            for copies in range(len(grown) - 1, 0, -1):
                if max_steps is not None and steps >= max_steps:
                    return
                rest = left - copies * length
                still = free if counts[length] > copies else free & ~(1 << length)
                if reach[i + 1] >> rest & 1 and not grown[copies][1] & still:
                    steps += 1
                    yield from extend(i + 1, rest, (*taken, (length, copies)), still, *grown[copies])
            if not reach[i + 1] >> left & 1:
                return

    for waste in range(room + 1):
        if not reach[0] >> room - waste & 1:
            continue
        for taken, free, ones, more in extend(0, room - waste, (), unused, 1, 0):
            if not any((ones | more) << d & free for d in range(1, waste + 1)):
                yield waste, taken
        if max_steps is not None and steps >= max_steps:
            return


def undominated(counts: np.ndarray, room: int, most: int | None, max_steps: int | None = None) -> list[tuple[int, Filling]]:
    """The first ``most`` of :func:`fillings`."""
    return list(islice(fillings(counts, room, max_steps), most))


def _complete(counts: np.ndarray, capacity: int, most: int | None, max_steps: int | None,
              sequences: int) -> Iterator[tuple[Filling, int, np.ndarray]]:
    """The node's branches: (filling with the longest length, how often, remaining counts).

    Fillings that waste no more than ``SHARES`` times what each of ``sequences`` may waste
    come first, those of long pieces (by squares) before those that use up short ones.
    """
    longest = int(np.flatnonzero(counts)[-1])
    total = int(counts @ np.arange(len(counts)))
    share = SHARES * max(0, sequences * capacity - total) / max(1, sequences)
    rest = counts.copy()
    rest[longest] -= 1
    # listed at once: a suspended enumeration would keep its sums in memory for every node of the path
    found = iter(undominated(rest, capacity - longest, most, max_steps))

    def ordered() -> Iterator[Filling]:
        cheap: list[Filling] = []
        beyond = None
        for waste, filling in found:
            if cheap and waste > share:
                beyond = filling
                break
            cheap.append(filling)
        yield from sorted(cheap, key=lambda f: -sum(x * x * c for x, c in f))
        if beyond is not None:
            yield beyond
            yield from (filling for _, filling in found)

    for filling in ordered():
        need = dict(filling)
        need[longest] = need.get(longest, 0) + 1
        for times in range(min(int(counts[x]) // c for x, c in need.items()), 0, -1):
            left = counts.copy()
            for x, c in need.items():
                left[x] -= times * c
            yield tuple(sorted(need.items(), reverse=True)), times, left


def plan_packing(counts: Sequence[int], capacity: int, max_nodes: int | None = 1_000, most_fillings: int | None = 12,
                 max_steps: int | None = 200) -> Plan:
    """Pack ``counts[length]`` pieces of each length into few sequences of ``capacity``."""
    counts = np.asarray(counts, np.int64)
    if len(counts) != capacity + 1 or counts[0] or (counts < 0).any():
        raise ValueError("counts must hold one entry per length from 0 (none) to the capacity")
    done: Plan = [(((capacity, 1),), int(counts[capacity]))] if counts[capacity] else []
    counts = counts.copy()
    counts[capacity] = 0
    if not counts.any():
        return done
    target = waste_bound(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(m for _, m in best)
    nodes, most_odd = 0, 0
    while fewest > target:
        # depth first among the plans with at most ``most_odd`` departures from the first branch; a frame holds
        # the branches of a node still to try, and the path the branch taken in each frame but the last
        path: Plan = []
        used, beyond = 0, False
        stack = [(enumerate(_complete(counts, capacity, most_fillings, max_steps, target)), most_odd)]
        while stack and fewest > target and (max_nodes is None or nodes < max_nodes):
            branches, odd = stack[-1]
            number, branch = next(branches, (0, None))
            if branch is None or number > odd:
                beyond |= branch is not None
                stack.pop()
                if path:
                    used -= path.pop()[1]
                continue
            filling, times, left = branch
            if used + times + (waste_bound(left, capacity) if left.any() else 0) >= fewest:
                continue
            nodes += 1
            rest = best_fit(left, capacity)
            if (found := used + times + sum(m for _, m in rest)) < fewest:
                best, fewest = [*path, (filling, times), *rest], found
            if left.any():
                path.append((filling, times))
                used += times
                stack.append((enumerate(_complete(left, capacity, most_fillings, max_steps, target - used)),
                              odd - number))
        if not beyond:
            break
        most_odd += 1
    return done + best


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be short when cut."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(i, capacity) for i in range(first, n, capacity)]


def encode_pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Written pieces of all documents, numbered per (task, length)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task = byte_bpe(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.asarray([end_id], "<u4")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(),
                                    strict=True):
                ids = np.concatenate([np.frombuffer(encoder.encode(text), encoder.dtype).astype("<u4"), end])
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start:start + length].tobytes())
                    out.append((doc_id, k, start, length, crc, task, int(seen[length])))
                    seen[length] += 1
            if out:
                schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                                    ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()),
                                    ("place", pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return materialize(text_rows(df, id_col, text_col).mapInArrow(pieces, PIECES), "pieces")


def place_pieces(pieces: DataFrame, plan: Plan) -> DataFrame:
    """Give every piece its sequence and offset from its rank among its length."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    base, taken = 0, {}
    for filling, many in plan:
        offset = 0
        for length, copies in filling:
            first = taken.get(length, 0)
            slots.setdefault(length, []).append((first, base, copies, offset))
            taken[length] = first + many * copies
            offset += length * copies
        base += many
    tables = {x: np.asarray(rows, np.int64) for x, rows in slots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                rows, here = tables[int(x)], np.flatnonzero(length == x)
                at = rows[np.searchsorted(rows[:, 0], rank[here], "right") - 1]
                step = rank[here] - at[:, 0]
                sequence[here] = at[:, 1] + step // at[:, 2]
                offset[here] = at[:, 3] + step % at[:, 2] * x
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    ranked = (pieces.join(offsets, ["length", "task"])
              .withColumn("rank", F.col("before") + F.col("place"))
              .select("doc_id", "piece", "start", "length", "ids_crc32", "rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = encode_pieces(df, tokenizer, capacity, end_id, id_col, text_col)
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most one row per length
        counts[row["length"]] = row["count"]
    return place_pieces(pieces, plan_packing(counts, capacity))
