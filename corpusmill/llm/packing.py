"""Best-fit packing of token sequences by linear grouping.

Lengths are integers up to the size of a sequence, so the histogram of lengths has at most that many entries however
large the corpus is. The plan is made from it alone: lengths over ``small`` are cut into groups of equal cardinality
and rounded up to the longest of their group; configurations of the rounded sizes are chosen; the actual lengths take
the places of the rounded ones; the space that is left is filled with the small lengths by best fit.

Of few sizes, the configurations and how often each is used are the solution of the linear program that covers the
supply with the fewest sequences, rounded down; its columns are generated by a knapsack over the dual prices. Of many
sizes, where the program gets slow, and for what rounding down leaves over, each configuration is the fullest one for
the largest size left. Few groups waste more by rounding, and few small lengths fill less of it, so plans are made for
several numbers of groups and limits of small lengths; the one with the fewest sequences is used. The plan says where the documents of a length go by their rank among equals, and
ranks come from a distributed count; documents never visit the driver.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import TOKENIZER, encoded, encoder, forget

SEQUENCE, SMALL, GROUPS = 2048, 256, (64, 128, 256, 512, 1024)
#: Where linear programs are solved: the share of a sequence up to which a length is small, and the number of groups.
PROGRAMS = ((2 / 5, 512), (1 / 3, 256), (1 / 8, 64))
ROUNDS = 100  # prices of a linear program at most; stopped early, its columns still make a whole plan
SALT_ROWS = 10_000  # pieces of one length that are ranked in one task, about
BROADCAST_SALTS = 1_000_000  # rows of 24 bytes that are sent to every task at most


def _piece_rows(size: int, name: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(name).dtype
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, packed in encoded(batch.column(1), name):
                ids = np.frombuffer(packed, dtype).astype("<u4")
                first = len(ids) % size or size
                for k, s in enumerate([0, *range(first, len(ids), size)] if len(ids) > size else [0]):
                    e = len(ids) if len(ids) <= size else (first if k == 0 else s + size)
                    row.append(i), piece.append(k), start.append(s), length.append(e - s), crc.append(zlib.crc32(ids[s:e].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        forget(name)

    return rows


def pieces(docs: DataFrame, size: int = SEQUENCE, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each piece: longer documents are cut into whole sequences, their first piece taking what is left over."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _piece_rows(size, tokenizer), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def groups_of(counts: dict[int, int], n_groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Linear grouping: (rounded size, [(length, count)] from the longest) of groups of equal cardinality, largest first."""
    total = sum(counts.values())
    share = max(1, -(-total // n_groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = share
            take = min(left, room)
            out[-1][1].append((length, take))
            left, room = left - take, room - take
    merged: dict[int, list[tuple[int, int]]] = {}
    for size, runs in out:  # groups of one rounded size are one supply
        merged.setdefault(size, []).extend(runs)
    return list(merged.items())


def configurations(sizes: list[int], supply: list[int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """([(index of a size, how often)], bins): the largest size left is filled up best by exact subset sums, again and again."""
    left, out = list(supply), []
    for lead, size in enumerate(sizes):
        while left[lead]:
            left[lead] -= 1
            steps, reach, mask = [], 1, (1 << (capacity - size + 1)) - 1
            for k in range(lead, len(sizes)):
                if left[k]:
                    for _ in range(min(left[k], (capacity - size) // sizes[k])):
                        grown = (reach | reach << sizes[k]) & mask
                        if grown == reach:
                            break
                        steps.append((k, reach))
                        reach = grown
            fill, used = reach.bit_length() - 1, {lead: 1}
            for k, before in reversed(steps):
                if not before >> fill & 1:
                    used[k] = used.get(k, 0) + 1
                    fill -= sizes[k]
            left[lead] += 1
            bins = min(left[k] // n for k, n in used.items())
            for k, n in used.items():
                left[k] -= n * bins
            out.append((sorted(used.items()), bins))
    return out


def _columns(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> list[np.ndarray]:
    """For each size the dearest configuration that holds it, the dearest first, by a knapsack over the prices."""
    source = np.arange(capacity + 1)[None, :] - sizes[:, None]
    source[source < 0] = capacity + 1  # a place that nothing reaches
    best, picks = np.zeros(capacity + 2), []
    best[-1] = -np.inf
    for _ in range(capacity // int(sizes.min())):  # no configuration has more items
        grown = best[source] + prices[:, None]
        pick, value = grown.argmax(axis=0), grown.max(axis=0)
        better = value > best[:-1] + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, pick, -1))
        best[:-1] = np.where(better, value, best[:-1])
    out = []
    for lead in np.argsort(-(prices + best[capacity - sizes]), kind="stable").tolist():
        column, space = np.zeros(len(sizes), np.int64), capacity - int(sizes[lead])
        column[lead] = 1
        for pick in reversed(picks):
            if pick[space] >= 0:
                column[pick[space]] += 1
                space -= int(sizes[pick[space]])
        out.append(column)
    return out


def solved(sizes: list[int], supply: list[int], capacity: int, rounds: int = ROUNDS) -> list[tuple[list[tuple[int, int]], int]]:
    """``configurations`` from the linear program over all of them, by column generation; its fractions are filled up greedily."""
    if not sizes:
        return []
    size, need = np.array(sizes, np.int64), np.array(supply, np.float64)
    basis = np.diag(capacity // size).astype(np.float64)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        columns = _columns(size, inverse.sum(axis=0), capacity)
        if columns[0] @ inverse.sum(axis=0) <= 1 + 1e-9:
            break
        for column in columns:
            if column @ inverse.sum(axis=0) <= 1 + 1e-9:
                continue
            used, change = inverse @ need, inverse @ column
            ratio = np.where(change > 1e-7, used / np.where(change > 1e-7, change, 1), np.inf)
            out = int(ratio.argmin())
            if change[out] <= 1e-7:
                continue
            basis[:, out] = column
            row = inverse[out] / change[out]
            inverse -= np.outer(change, row)
            inverse[out] = row
    used = np.linalg.solve(basis, need)
    left, found = np.array(supply, np.int64), []
    for column, times in zip(basis.T.astype(np.int64), np.floor(used + 1e-6).astype(np.int64).tolist(), strict=True):
        some = np.flatnonzero(column)
        bins = int(min(times, (left[some] // column[some]).min()))
        if bins > 0:
            left[some] -= column[some] * bins
            found.append(([(int(k), int(column[k])) for k in some], bins))
    return found + configurations(sizes, left.tolist(), capacity)


class _Plan:
    """Runs: documents of a length with ranks from ``rank`` on go one by one into bins from ``bin`` on, at ``offset``."""

    def __init__(self):
        self.runs: list[tuple[int, int, int, int]] = []
        self.rank: dict[int, int] = {}
        self.bins = 0

    def put(self, length: int, n: int, first_bin: int, offset: int) -> None:
        at = self.rank.get(length, 0)
        self.runs.append((length, at, first_bin, offset))
        self.rank[length] = at + n


def best_plan(
    counts: dict[int, int], capacity: int = SEQUENCE, small: int = SMALL, groups: tuple[int, ...] = GROUPS, programs: tuple[tuple[float, int], ...] = PROGRAMS
) -> tuple[np.ndarray, int]:
    """The first plan that fills all sequences but the last, else the one with the fewest sequences; solved ones come first."""
    limits = sorted({int(capacity * share) for share, _ in programs[:1]} | {small}, reverse=True)
    tries = [(int(capacity * share), n, solved) for share, n in programs] + [(limit, n, configurations) for limit in limits for n in groups]
    fewest = -(-sum(length * n for length, n in counts.items()) // capacity)
    best: tuple[np.ndarray, int] | None = None
    for limit, n, choose in tries:
        found = plan(counts, capacity, limit, n, choose)
        if best is None or found[1] < best[1]:
            best = found
        if best[1] == fewest:
            break
    return best


def plan(
    counts: dict[int, int], capacity: int = SEQUENCE, small: int = SMALL, n_groups: int = GROUPS[-1], choose: Callable = configurations
) -> tuple[np.ndarray, int]:
    """(runs sorted by length and rank, sequences) for a histogram of lengths of 1 to ``capacity``."""
    out = _Plan()
    groups = groups_of({k: v for k, v in counts.items() if k > small and v}, n_groups)
    sizes = [s for s, _ in groups]
    feeds = [[list(r) for r in runs] for _, runs in groups]
    free: dict[int, list[tuple[int, int, int]]] = {}  # free tokens -> (first bin, bins)
    levels: list[int] = []

    def add(space: int, first: int, n: int) -> None:
        if space > 0 and n:
            if space not in free:
                bisect.insort(levels, space)
                free[space] = []
            free[space].append((first, n))

    for config, bins in choose(sizes, [sum(n for _, n in f) for f in feeds], capacity):
        slots = [[] for k, n in config for _ in range(n)]  # runs (length, bins) of each place
        for slot, k in zip(slots, [k for k, n in config for _ in range(n)], strict=True):
            need = bins
            while need:
                head = feeds[k][0]
                take = min(need, head[1])
                slot.append([head[0], take])
                head[1] -= take
                need -= take
                if not head[1]:
                    feeds[k].pop(0)
        done = 0
        while done < bins:
            n = min(s[0][1] for s in slots)
            offset = 0
            for s in slots:
                out.put(s[0][0], n, out.bins + done, offset)
                offset += s[0][0]
                s[0][1] -= n
                if not s[0][1]:
                    s.pop(0)
            add(capacity - offset, out.bins + done, n)
            done += n
        out.bins += bins
    for length in sorted((k for k, v in counts.items() if k <= small and v), reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(levels, length)
            if i == len(levels):  # no bin has room: open as many as the rest needs
                n = -(-left // (capacity // length))
                add(capacity, out.bins, n)
                out.bins += n
                continue
            space = levels[i]
            first, n = free[space].pop()
            if not free[space]:
                del free[space], levels[i]
            take = min(n, left)
            out.put(length, take, first, capacity - space)
            left -= take
            add(space - length, first, take)
            add(space, first + take, n - take)
    runs = np.array(sorted(out.runs), np.int64).reshape(-1, 4)
    return runs, out.bins


def _place(runs: np.ndarray):
    keys = runs[:, 0] << 40 | runs[:, 1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 40 | rank, "right") - 1
            found = [pa.array(runs[at, 2] + rank - runs[at, 1]), pa.array(runs[at, 3])]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + found, [*kept, "sequence_id", "offset"])

    return rows


def pack(docs: DataFrame, size: int = SEQUENCE, tokenizer: str = TOKENIZER, small: int = SMALL, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of ``docs``.

    Null and empty texts are one end id; only texts longer than a sequence are cut, into whole sequences and a shorter
    first piece. Rows that repeat a doc_id, null ones too, are packed each on its own; which of equal pieces comes
    first is open. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, size, tokenizer), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    runs, _ = best_plan(counts, size, small, groups)
    salts = {length: -(-n // SALT_ROWS) for length, n in counts.items()}
    table = spark.createDataFrame(list(salts.items()), "length long, salts int")
    salted = cut.join(F.broadcast(table), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    tally = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = tally.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    before = F.broadcast(before) if sum(salts.values()) <= BROADCAST_SALTS else before
    ranked = salted.join(before, ["length", "salt"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    )
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _place(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
