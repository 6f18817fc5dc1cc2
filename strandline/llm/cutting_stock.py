"""Packing of token sequences as a cutting-stock problem, by column generation over a histogram of lengths.

A document of n tokens gives n // capacity sequences of its own and one rest. Only the number of rests of each length, at most
capacity - 1 rows at any corpus size, goes to the driver. There a linear program chooses how often each pattern (lengths that share a
sequence) is used. It starts from greedy patterns; a knapsack over the dual prices of the lengths gives patterns that lower the cost,
until the cost is within GAP of a bound. A sequence costs its padded size: its own tokens if they are a power of two, else the
capacity. A rest may also be cut in two; a cut costs CUT tokens, so it is used where it saves more padding.
Numbers of patterns are rounded down, then up where the rests allow; what is left is filled exactly where lengths allow,
and the last of it laid end to end and cut at sequence bounds. Rests of a length are ranked (by task of the tokenisation, then in
the order read), a pattern takes a range of ranks, and every piece finds its sequence by arithmetic on its rank: no rests are
gathered, however many share a length.

Which of several rests of one length goes where follows the order of the input's files; the numbers and lengths of pieces don't.
Null text counts as empty: one end token. A repeated or null doc_id is packed for each of its rows. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byte_bpe
from .store import Shelf, text_bytes

CAPACITY = 1024
#: Tokens of padding that one more cut is worth.
CUT = 8
#: Distance of the program's cost from its lower bound, as a share of it, at which no more columns are looked for.
GAP = 0.001
#: Rounds of pricing after which the program stops with what it has: every basis is a whole plan.
ROUNDS = 60
#: Tokens that a column must save, as its price promises, to be looked at.
LITTLE = 0.05


def padded(total: int, capacity: int) -> int:
    """Size of a sequence: a power of two stays, all others are padded to the capacity."""
    return total if total & (total - 1) == 0 else capacity


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Matrix times vector in one thread: the driver's cores are not for the taking."""
    return np.einsum("ij,j->i", matrix, vector)


class Program:
    """The linear program, solved by the revised simplex method with priced columns.

    Its rows are the lengths that rests have, and those that a cut may give: powers of two, what is left of a rest beside one, and what
    fills a sequence beside a rest. A column is (cost, {length: number}); a cut takes one of its length and gives two others, so
    these stand with -1. The first basis is a greedy plan: each of its patterns uses up one length, so they are independent."""

    def __init__(self, demand: dict[int, int], capacity: int, cut: float):
        self.capacity, self.cut = capacity, cut
        powers = [1 << k for k in range(capacity.bit_length()) if 1 << k < capacity]
        rows = set(demand) | set(powers) | {capacity - x for x in demand} | {x - p for x in demand for p in powers if p < x}
        self.lengths = np.array(sorted(x for x in rows if 0 < x < capacity))
        self.row = {int(x): i for i, x in enumerate(self.lengths)}
        own = np.array([demand.get(int(x), 0) for x in self.lengths], float)
        self.tokens = float(self.lengths @ own)
        self.demand = own + 1e-3 * (1 + np.arange(len(own)) % 7) / 7  # no two ratios alike, none zero
        self.columns, self.used_up = self._greedy()
        self.basis = list(range(len(self.columns)))
        self.cost = np.array([c for c, _ in self.columns], float)
        self.inverse = self._first_inverse()
        self.amount = _times(self.inverse, self.demand)

    def _greedy(self) -> tuple[list[tuple], list[int]]:
        """Patterns from the longest length down, each used until one of its lengths is used up."""
        left, out, used_up = np.zeros(self.capacity + 1), [], []
        left[self.lengths] = self.demand
        while (have := left.nonzero()[0]).size:
            items = _filled(int(have[-1]), left > 0, self.capacity)
            times, x = min((left[y] / k, y) for y, k in items.items())
            for y, k in items.items():
                left[y] = max(1e-9, left[y] - times * k)  # of two that run out at once one goes first
            left[x] = 0.0
            total = sum(y * k for y, k in items.items())
            out.append((padded(total, self.capacity), items))
            used_up.append(x)
        return out, used_up

    def _dense(self, columns: list[tuple]) -> np.ndarray:
        out = np.zeros((len(columns), len(self.lengths)))
        for i, (_, items) in enumerate(columns):
            for x, k in items.items():
                out[i, self.row[x]] = k
        return out

    def _first_inverse(self) -> np.ndarray:
        """Inverse of the greedy basis: pattern i uses up a length that no later one holds, so the matrix is triangular."""
        out = np.zeros((len(self.columns), len(self.lengths)))
        for i, x in enumerate(self.used_up):
            out[i, self.row[x]] = 1.0
            for j, (_, items) in enumerate(self.columns[:i]):
                if x in items:
                    out[i] -= items[x] * out[j]
            out[i] /= self.columns[i][1][x]
        return out

    def price(self, prices: np.ndarray, most: int = 400) -> tuple[list[tuple], np.ndarray, float]:
        """Columns whose reduced cost is negative, the best for each length that they hold, the demand of these lengths, and by what
        factor the prices are too high. A gain counts by the demand of its length, so lengths that no rest has come last."""
        size = self.capacity
        dual = np.full(size, -np.inf)
        dual[self.lengths] = prices
        value, last = np.full(size + 1, -np.inf), np.zeros(size + 1, int)
        value[0] = 0.0
        for c in range(1, size + 1):  # the knapsack: best value of lengths that fill c exactly
            n = min(c, size - 1)
            of = value[c - n : c][::-1] + dual[1 : n + 1]
            last[c] = int(of.argmax()) + 1
            value[c] = of[last[c] - 1]
        best_to = np.maximum.accumulate(value)
        at_to = np.maximum.accumulate(np.where(value == best_to, np.arange(size + 1), 0))
        totals = [(size, True), *((1 << k, False) for k in range(size.bit_length()) if 1 << k < size)]
        gains = np.full((len(totals), len(prices)), -np.inf)
        for i, (total, pads) in enumerate(totals):
            x = self.lengths[self.lengths <= total]
            gains[i, : len(x)] = prices[: len(x)] + (best_to if pads else value)[total - x] - total
        over = max(1.0, float((gains.max(axis=1) / [t for t, _ in totals]).max()) + 1)
        found = [(gains[i, j], int(self.lengths[j]), i) for j, i in enumerate(gains.argmax(axis=0).tolist()) if gains[i, j] * self.demand[j] > LITTLE]
        for j, x in enumerate(self.lengths.tolist()):
            pair = dual[1:x] + dual[x - 1 : 0 : -1]
            if x > 1 and np.isfinite(low := pair.min(where=np.isfinite(pair), initial=np.inf)):
                gain = prices[j] - low - self.cut
                over = max(over, gain / self.cut + 1)
                if gain * self.demand[j] > LITTLE:
                    found.append((gain, x, -1 - int(np.flatnonzero(pair == low)[0])))
        weigh = lambda g: g[0] * self.demand[self.row[g[1]]]
        found = sorted(found, key=weigh, reverse=True)[:most]
        out = []
        for _, x, i in found:
            items: dict[int, int] = defaultdict(int, {x: 1})
            if i < 0:
                items[-i] -= 1
                items[x + i] -= 1
                out.append((self.cut, dict(items)))
                continue
            total, pads = totals[i]
            rest = c = int(at_to[total - x]) if pads else total - x
            while c:
                items[int(last[c])] += 1
                c -= int(last[c])
            out.append((padded(rest + x, size), dict(items)))
        return out, np.array([self.demand[self.row[x]] for _, x, _ in found]), over

    def solve(self) -> list[tuple[float, tuple]]:
        """(amount, column) of the last basis."""
        for _ in range(ROUNDS):
            dual = _times(self.inverse.T, self.cost[self.basis])
            now = float((self.cost[self.basis] * self.amount).sum())
            if now - self.tokens <= GAP * self.tokens + 1:
                break
            fresh, weight, over = self.price(dual)
            if not fresh or now - float((dual * self.demand).sum()) / over <= GAP * now:
                break
            self.columns = [self.columns[b] for b in self.basis] + fresh
            self.basis, first = list(range(len(self.basis))), len(self.basis)
            self.cost = np.array([c for c, _ in self.columns], float)
            new = self._dense(fresh)
            for _ in range(len(fresh)):
                reduced = self.cost[first:] - _times(new, dual)
                j = int((reduced * weight).argmin())
                if reduced[j] * weight[j] > -LITTLE:
                    break
                dual = dual + reduced[j] * self._pivot(new[j], first + j)
        return [(float(x), self.columns[b]) for x, b in zip(self.amount, self.basis, strict=True)]

    def _pivot(self, column: np.ndarray, number: int) -> np.ndarray:
        """Take a column into the basis; returns the row of the inverse that is its now."""
        u = _times(self.inverse, column)
        fits = u > 1e-9
        ratio = np.where(fits, np.maximum(self.amount, 0) / np.where(fits, u, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        self.amount -= step * u
        self.amount[out] = step
        row = self.inverse[out] / u[out]
        moved = np.flatnonzero(np.abs(u) > 1e-12)
        self.inverse[moved] -= np.outer(u[moved], row)
        self.inverse[out] = row
        self.basis[out] = number
        return row


def _filled(x: int, have: np.ndarray, capacity: int) -> dict[int, int]:
    """Lengths of a sequence that begins with x: one or two others that fill it exactly, else the longest that fits and on."""
    items, room = {x: 1}, capacity - x
    while room and (fits := have[: room + 1].nonzero()[0]).size:
        pair = fits[have[room - fits]]
        take = [room] if have[room] else [int(pair[-1]), room - int(pair[-1])] if pair.size else [int(fits[-1])]
        for y in take:
            items[y] = items.get(y, 0) + 1
            room -= y
    return items


class Stock:
    """Rests of each length as ranges of ranks: (first length, from rank, to rank, start in the rest)."""

    def __init__(self, demand: dict[int, int]):
        self.held = defaultdict(list, {x: [(x, 0, n, 0)] for x, n in demand.items() if n})
        self.count = defaultdict(int, demand)

    def take(self, x: int, n: int) -> list[tuple[int, int, int, int]]:
        out, held = [], self.held[x]
        self.count[x] -= n
        while n:
            own, low, high, start = held.pop()
            if high - low > n:
                held.append((own, low + n, high, start))
                high = low + n
            out.append((own, low, high, start))
            n -= high - low
        return out

    def put(self, x: int, ranges: list[tuple[int, int, int, int]]) -> None:
        self.held[x] += ranges
        self.count[x] += sum(high - low for _, low, high, _ in ranges)

    def times(self, items: dict[int, int]) -> int:
        return min(self.count[x] // k for x, k in items.items())


class Plan:
    """Places of all rests. places[length]: (ranks at which an interval begins, for each interval its pieces); a piece is
    (start, length, rank that counts as 0, sequence, pieces of the length in a sequence, offset, sequences to the next)."""

    def __init__(self, demand: dict[int, int], capacity: int = CAPACITY, cut: int = CUT):
        self.stock, self.capacity, self.cut, self.sequences = Stock(demand), capacity, cut, 0
        self.rows: dict[int, list] = defaultdict(list)
        if any(demand.values()):
            self._round(Program({x: n for x, n in demand.items() if n}, capacity, cut).solve())
            self._fill()
            self._lay()
        self.places = {x: self._intervals(rows) for x, rows in self.rows.items()}

    def _use(self, items: dict[int, int], times: int) -> None:
        offset = 0
        for x, k in sorted(items.items(), reverse=True):
            seen = 0
            for own, low, high, start in self.stock.take(x, k * times):
                self.rows[own].append((low, high, (start, x, low - seen, self.sequences, k, offset, 1)))
                seen += high - low
            offset += k * x
        self.sequences += times

    def _split(self, x: int, a: int, n: int) -> None:
        ranges = self.stock.take(x, n)
        self.stock.put(a, ranges)
        self.stock.put(x - a, [(own, low, high, start + a) for own, low, high, start in ranges])

    def _round(self, solved: list[tuple[float, tuple]]) -> None:
        cuts, patterns = [], []
        for amount, (_, items) in solved:
            if any(k < 0 for k in items.values()):
                (x,) = (x for x, k in items.items() if k > 0)
                cuts.append((x, min(items), amount))
            elif padded(total := sum(x * k for x, k in items.items()), self.capacity) - total <= self.cut:
                patterns.append((amount, items))
        for x, a, amount in sorted(cuts, reverse=True):  # what cuts give may be cut again
            if n := min(int(amount + 0.01), self.stock.count[x]):
                self._split(x, a, n)
        for amount, items in patterns:
            if n := min(int(amount + 1e-6), self.stock.times(items)):
                self._use(items, n)
        for _, items in sorted(patterns, key=lambda p: (-(p[0] % 1), sorted(p[1].items()))):
            if self.stock.times(items):
                self._use(items, 1)

    def _fill(self) -> None:
        """Patterns from the longest rest down, each as often as its lengths allow; a length that no others fill is set aside."""
        count = np.zeros(self.capacity + 1, np.int64)
        for x, n in self.stock.count.items():
            count[x] = n
        while count.any():
            x = int(count.nonzero()[0][-1])
            items, room, left = {x: 1}, self.capacity - x, count.copy()
            left[x] -= 1
            while room and (fits := left[: room + 1].nonzero()[0]).size:
                pair = fits[left[room - fits] > (2 * fits == room)]
                for y in [room] if left[room] else [int(pair[-1]), room - int(pair[-1])] if pair.size else [int(fits[-1])]:
                    items[y] = items.get(y, 0) + 1
                    left[y] -= 1
                    room -= y
            if padded(self.capacity - room, self.capacity) - self.capacity + room <= self.cut:
                times = min(int(count[y]) // k for y, k in items.items())
                for y, k in items.items():
                    count[y] -= times * k
                self._use(items, times)
            else:
                count[x] = 0

    def _lay(self) -> None:
        """What is left, end to end: runs of one length first, as often as a whole number of them ends where a sequence does, then the
        others. The last tokens go into one sequence or, where padding costs more, into powers of two."""
        for x in sorted(self.stock.count, reverse=True):
            each = self.capacity // math.gcd(x, self.capacity)  # rests that fill a whole number of sequences
            if times := self.stock.count[x] // each:
                step = x * each // self.capacity
                ends = [self.capacity * (q + 1) for q in range(step)]
                for i in range(each):
                    self._cut_at(x, self.stock.take(x, times), i * x, ends, step)
                self.sequences += times * step
        left = [(x, (own, r, r + 1, start)) for x in sorted(self.stock.count, reverse=True) for own, low, high, start in self.stock.take(x, self.stock.count[x]) for r in range(low, high)]
        total = sum(x for x, _ in left)
        tail = total % self.capacity
        parts = [1 << k for k in reversed(range(tail.bit_length())) if tail >> k & 1]
        sizes = [self.capacity] * (total // self.capacity) + (parts if self.capacity - tail > self.cut * (len(parts) - 1) else [tail])
        at, ends = 0, list(accumulate(sizes))
        for x, r in left:
            self._cut_at(x, [r], at, ends, 0)
            at += x
        self.sequences += len(sizes) if tail else total // self.capacity

    def _cut_at(self, x: int, ranges: list[tuple[int, int, int, int]], at: int, ends: list[int], step: int) -> None:
        """Places of rests that begin at a token of sequences with these ends; each rest after the first lies step sequences on."""
        seen = 0
        for own, low, high, start in ranges:
            done = 0
            while done < x:
                q = bisect_right(ends, at + done)
                n = min(x - done, ends[q] - at - done)
                self.rows[own].append((low, high, (start + done, n, low - seen, self.sequences + q, 1, at + done - (ends[q - 1] if q else 0), step)))
                done += n
            seen += high - low

    @staticmethod
    def _intervals(rows: list) -> tuple[list[int], list[list[tuple]]]:
        edges = sorted({e for low, high, _ in rows for e in (low, high)})
        pieces: list[list[tuple]] = [[] for _ in edges]
        for low, high, piece in sorted(rows, key=lambda r: r[2][0]):
            for i in range(bisect_right(edges, low) - 1, bisect_right(edges, high - 1)):
                pieces[i].append(piece)
        return edges, pieces

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of a rest."""
        edges, pieces = self.places[length]
        out = []
        for start, n, zero, sequence, k, offset, step in pieces[bisect_right(edges, rank) - 1]:
            t = rank - zero
            out.append((start, n, sequence + t // k * step, offset + t % k * n))
        return out


TOKENS = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("whole_nth", pa.int64()), ("whole_crc", pa.list_(pa.int64())), ("rest", pa.int32()), ("nth", pa.int64()), ("rest_crc", pa.int64()), ("rest_ids", pa.binary())])
TOKENS_DDL = "doc_id bigint, doc_tokens bigint, part int, row bigint, whole_nth bigint, whole_crc array<bigint>, rest int, nth bigint, rest_crc bigint, rest_ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def tokenised(docs: DataFrame, file: str, ranks: str | None = None, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """A row for each document: its number of tokens with the end token, checksums of its whole sequences, its rest with ids and
    checksum, and how many rests of the same length and how many whole sequences its task had before it."""
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = byte_bpe.encoder(file, ranks), TaskContext.get().partitionId()
        last, before, whole, row = end.to_bytes(4, "little"), defaultdict(int), 0, 0
        for batch in batches:
            rows = []
            for data in batch.column(1):
                ids = own.packed(data.as_py().decode("utf-8", "replace")) + last
                crcs = [zlib.crc32(ids[i : i + step]) for i in range(0, len(ids) - step + 1, step)]
                rest = ids[len(crcs) * step :]
                n = len(rest) // 4
                rows.append((len(ids) // 4, part, row, whole, crcs, n, before[n], zlib.crc32(rest), rest))
                whole, row = whole + len(crcs), row + 1
                before[n] += 1
            cols = zip(*rows, strict=True) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(TOKENS)[1:], strict=True))], schema=TOKENS)

    return text_bytes(docs).mapInArrow(run, TOKENS_DDL)


def pack_tokens(docs: DataFrame, file: str, ranks: str | None = None, end: int = 0, capacity: int = CAPACITY, cut: int = CUT) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32 (of little-endian 32-bit ids), doc_tokens, sequence_id, offset.

    file: the tokenizer file; ranks: a rank file of the same vocabulary, for speed; end: the id that closes a document."""
    shelf = Shelf(docs.sparkSession)
    tokens = shelf.put(tokenised(docs, file, ranks, end, capacity))
    counts = shelf.put(tokens.filter("rest > 0").groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n")))
    earlier = F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("part", "rest", F.coalesce(earlier, F.lit(0)).alias("first"))
    # At most capacity - 1 rows.
    plan = Plan({r.rest: r.n for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}, capacity, cut)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, total, part, row, nth, crcs, rest, rank, crc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, whole in enumerate(crcs):
                    rows.append((doc, i * capacity, capacity, whole, total, plan.sequences + (part << 40) + nth + i, 0, None, None, None))
                if rest:
                    found, base = plan.pieces(rest, rank), len(crcs) * capacity
                    for start, n, sequence, offset in found:
                        rows.append((doc, base + start, n, crc if n == rest else None, total, sequence, offset, part, row, start))
            cols = zip(*rows, strict=True) if rows else [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in placed_ddl.split(", ")])

    placed_ddl = PIECES + ", part bigint, row bigint, at bigint"
    ranked = tokens.join(first, ["part", "rest"], "left")
    rank = F.col("nth") + F.coalesce("first", F.lit(0))
    placed = shelf.put(ranked.select("doc_id", "doc_tokens", "part", "row", "whole_nth", "whole_crc", "rest", rank.alias("rank"), "rest_crc").mapInArrow(place, placed_ddl))

    columns = [c.split()[0] for c in PIECES.split(", ")]
    parts = sorted(x for x, (_, found) in plan.places.items() if any(len(p) > 1 for p in found))
    if not parts:
        return placed.select(columns)
    # Checksums of the pieces of rests that were cut, from the ids of the rests of these lengths.
    cut_ids = tokens.filter(F.col("rest").isin(parts)).select("part", "row", "rest_ids")
    slices = placed.filter("ids_crc32 is null").join(cut_ids, ["part", "row"])
    crc = F.crc32(F.substring("rest_ids", (F.col("at") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")))
    return placed.filter("ids_crc32 is not null").select(columns).unionByName(slices.withColumn("ids_crc32", crc).select(columns))
