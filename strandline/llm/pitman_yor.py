"""Language-model scores by a hierarchical Pitman-Yor model, trained and applied in Spark.

Tokens are lower-cased words and one end for each text. Each token, and the start of a text, is a context with a restaurant of its
own: its customers are the training tokens that follow, its dishes are words. All of them share one parent restaurant, whose
customers are their tables and whose base is uniform over the known words and one unknown. Number and size of restaurants grow with
the corpus; there are no classes and no caps.

Gibbs sampling, a dish at a time: given all other tables, a dish with c customers has t tables with a probability proportional to
S(c, t), the generalised Stirling number that counts its seatings, times the weight of t - 1 further tables in its restaurant and
of as many further customers in the parent. Up to EXACT customers t is drawn from just that law. Beyond, EXACT customers are drawn so and the
rest sit down after them in groups of a twentieth of those seated. All dishes of a sweep see the totals of the sweep before. The
first BURN sweeps are left out; the predictive probabilities of the next SAMPLES are averaged, and their logarithms summed.

How it runs: a scan task makes blocks of documents, bounded by characters, and writes for each block its distinct (word, context)
pairs, dealt to the cells of a grid (rows by word hash, columns by context hash), beside the pair of each token. A frequent word is
spread over the columns and a frequent context over the rows, whatever their share. A cell holds its pairs once. A pair seen
once has one table for good, so a sweep works on the others alone: cells send the tables of each context and word to shards by key,
which add them up, seat the parent's customers and send the totals back. At the end all keys get their totals for each sample,
and each cell answers a block with one probability for each of its pairs. Only sums over all words reach the driver.
Every step's result is a table in the shared folder, deleted when nothing needs it any more. Cells are built and answer in turns, and
blocks are scored in turns, so that shuffle files and what they were made from lie side by side for a part of the data only. At the
end just the scores are left.

Null and empty texts have the end token alone. A null doc_id counts as the empty text for the split, so it is held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Shelf
from .words import Hashes

#: Discount and strength of the context restaurants and of their parent.
DISCOUNT, STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 0.75, 2.0, 0.6, 20.0
#: Sweeps that are not averaged, and that are.
BURN, SAMPLES = 1, 3
#: Customers of a dish up to which its tables are drawn from their exact law.
EXACT = 128
#: Additive smoothing of the base score, a fixed value.
ADD = 0.1
#: Characters of a block, and for each cell of the grid; cells and blocks take so many turns, to keep what lies on disk at once small.
BLOCK_CHARS, CELL_CHARS, TURNS = 8_000_000, 16_000_000, 4
END = np.uint64(xxhash.xxh64_intdigest(b"\x00end"))
#: The context at the start of a text; it sorts after every word.
START = np.uint64(0xFFFFFFFFFFFFFFFF)


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as planes of bytes, low bytes first, as many as the largest needs: mostly equal bytes compress well."""
    planes = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([planes]) + np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i8").ravel()


def top(h: np.ndarray, bits: int) -> np.ndarray:
    """The highest bits of hashes."""
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)


def edges(x: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of runs of equal values."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist() if len(x) else []
    return list(zip(at, [*at[1:], len(x)], strict=True))


class Grid(NamedTuple):
    """Bits of the word's row and of the context's column."""

    rows: int
    columns: int

    def cell(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        return top(words, self.rows) << self.columns | top(contexts, self.columns)

    def shard_bits(self, side: int) -> int:
        """A column's contexts (side 0), or a row's words (side 1), are dealt to some shards of their own."""
        return self.rows + self.columns // 2 if side else self.columns + self.rows // 2


TYPES = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], TYPES[c.split()[1]]) for c in ddl.split(", ")])


def _turn(block: int) -> int:
    """The turn in which a block is scored: a task's blocks, and the first blocks of all tasks, are dealt over the turns."""
    return ((block >> 32) + block) % TURNS


BLOCKS = "block bigint, cell bigint, words binary, fan binary, contexts binary, at binary, counts binary, doc_ids array<bigint>, train array<boolean>, lengths binary, places binary, kind string"


def tokens(texts: list[bytes], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, and the number of tokens of each text."""
    h, n, end = [], [], np.array([END])
    for data in texts:
        words = data.lower().split()
        h += [hashes.of(words), end]
        n.append(len(words) + 1)
    return np.concatenate(h), np.array(n, dtype=np.int64)


def _block(block: int, ids: list, train: list, texts: list[bytes], grid: Grid, hashes: Hashes) -> list[dict]:
    """A block's pairs for each cell, by cell, word and context, and the place of each token's pair in that order."""
    h, n = tokens(texts, hashes)
    words, at = np.unique(h, return_inverse=True)
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[np.cumsum(n) - n] = len(words)
    known = np.append(words, START)
    pairs, inverse = np.unique(at * len(known) + before, return_inverse=True)
    count = np.bincount(inverse, weights=np.repeat(np.array(train, dtype=np.float64), n), minlength=len(pairs)).astype(np.int64)
    w, u = np.divmod(pairs, len(known))
    cell = grid.cell(known[w], known[u])
    order = np.argsort(cell, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    w, u, cell, count = w[order], u[order], cell[order], count[order]
    rows = [{"kind": f"docs{_turn(block)}", "block": block, "doc_ids": ids, "train": train, "lengths": squeeze(n), "places": squeeze(place[inverse])}]
    for a, b in edges(cell):
        mine, fan = np.unique(w[a:b], return_counts=True)
        others, where = np.unique(u[a:b], return_inverse=True)
        rows.append({"kind": f"pairs{cell[a] % TURNS}", "block": block, "cell": int(cell[a]), "words": words[mine].tobytes(), "fan": squeeze(fan), "contexts": known[others].tobytes(), "at": squeeze(where), "counts": squeeze(count[a:b])})
    return rows


def _block_rows(grid: Grid):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number, held, size = Hashes(150_000), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[2])
                if size > BLOCK_CHARS:
                    yield pa.RecordBatch.from_pylist(_block(number, *map(list, zip(*held, strict=True)), grid, hashes), schema=_schema(BLOCKS))
                    number, held, size = number + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pylist(_block(number, *map(list, zip(*held, strict=True)), grid, hashes), schema=_schema(BLOCKS))

    return work


#: Rows of cells: all pairs (state), those seen twice or more (active), the pairs that a block asked for (asked), and keys.
BUILT = "cell bigint, block bigint, fan binary, at binary, counts binary, word binary, places binary, words binary, contexts binary, side int, shard bigint, keys binary, n binary, once binary, active binary, kind string"


def _shards(grid: Grid, side: int, keys: np.ndarray, **columns: np.ndarray) -> list[dict]:
    """Sorted keys and numbers that go with them, a row for each shard."""
    shard = top(keys, grid.shard_bits(side))
    return [{"side": side, "shard": int(shard[a]), "keys": keys[a:b].tobytes(), **{c: squeeze(x[a:b]) for c, x in columns.items()}} for a, b in edges(shard)]


def _sum(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=x, minlength=n).astype(np.int64)


def _build(grid: Grid):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        w, u, c, sizes = [], [], [], []
        for words, fan, contexts, at, counts in zip(*(rows[x].to_pylist() for x in ("words", "fan", "contexts", "at", "counts")), strict=True):
            at = spread(at)
            w.append(np.repeat(np.frombuffer(words, np.uint64), spread(fan)))
            u.append(np.frombuffer(contexts, np.uint64)[at])
            c.append(spread(counts))
            sizes.append(len(at))
        words, wi = np.unique(np.concatenate(w), return_inverse=True)
        contexts, ui = np.unique(np.concatenate(u), return_inverse=True)
        pairs, inverse = np.unique(wi * len(contexts) + ui, return_inverse=True)
        count = _sum(inverse, np.concatenate(c), len(pairs))
        word, context = np.divmod(pairs, len(contexts))
        out = [{"kind": "state", "fan": squeeze(np.bincount(word, minlength=len(words))), "at": squeeze(context), "counts": squeeze(count)}]
        for block, places in zip(rows["block"].to_pylist(), np.split(inverse, np.cumsum(sizes)[:-1]), strict=True):
            out.append({"kind": "asked", "block": block, "places": squeeze(np.diff(places, prepend=0))})  # they ascend
        again = count > 1
        act_words, act_word = np.unique(word[again], return_inverse=True)
        act_contexts, act_context = np.unique(context[again], return_inverse=True)
        if again.any():
            out.append({"kind": "active", "words": words[act_words].tobytes(), "contexts": contexts[act_contexts].tobytes(), "word": squeeze(act_word), "at": squeeze(act_context), "counts": squeeze(count[again])})
        for side, keys, at in ((0, contexts, context), (1, words, word)):
            found = [_sum(at, x, len(keys)) for x in (count, count == 1, again)]
            out += [r | {"kind": "keys"} for r in _shards(grid, side, keys, n=found[0], once=found[1], active=found[2])]
        return pa.Table.from_pylist([r | {"cell": key[0].as_py()} for r in out], schema=_schema(BUILT))

    return run


@cache
def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c and t up to most."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = np.log(c - discount * t) + out[c, 1 : c + 1]
        out[c + 1, 2 : c + 2] = np.logaddexp(out[c + 1, 2 : c + 2], out[c, 1 : c + 1])
    return out


def seat(count: np.ndarray, own: np.ndarray, up: np.ndarray, rise: float, scale: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with count customers. own: the weight of a new table in the dish's restaurant before the discount of the dish's
    own tables; (up + rise * (k - 1)) * scale: the parent's probability of the dish's k-th further customer."""
    tables, logs = np.minimum(count, 1), stirling(discount)
    todo = np.flatnonzero(count > 1)
    c = np.minimum(count[todo], EXACT)
    order = np.argsort(c, kind="stable")
    todo, c = todo[order], c[order]
    for a, b in edges(c):
        customers = int(c[a])
        k = np.arange(1, customers)
        for i in range(a, b, max(1, 1_000_000 // customers)):
            d = todo[i : min(b, i + max(1, 1_000_000 // customers))]
            step = np.log((own[d, None] + discount * k) * (up[d, None] + rise * (k - 1)) * scale)
            p = logs[customers, 1 : customers + 1] + np.concatenate([np.zeros((len(d), 1)), np.cumsum(step, axis=1)], axis=1)
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            tables[d] = 1 + (p < rng.random((len(d), 1)) * p[:, -1:]).sum(axis=1)
    seated, rest = EXACT, np.flatnonzero(count > EXACT)
    while len(rest):
        group, t = np.minimum(count[rest] - seated, seated // 20), tables[rest]
        new = (own[rest] + discount * t) * (up[rest] + rise * (t - 1)) * scale
        tables[rest] += rng.binomial(group, new / (seated - discount * t + new))
        seated += seated // 20
        rest = rest[count[rest] > seated]
    return tables


class Model(NamedTuple):
    """What all cells share: customers and tables of the parent, training tokens, and known words."""

    customers: int
    tables: int
    n: int
    known: int

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probability of words, times the next."""
        return customers - ROOT_DISCOUNT * tables + (ROOT_STRENGTH + ROOT_DISCOUNT * self.tables) / (self.known + 1)

    @property
    def scale(self) -> float:
        return 1.0 / (ROOT_STRENGTH + self.customers)


def _merged(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys of a shard's rows, and the places of each row's keys among them."""
    keys = [np.frombuffer(x, np.uint64) for x in rows["keys"].to_pylist()]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.split(at, np.cumsum([len(k) for k in keys])[:-1])


def _added(rows: pa.Table, column: str, places: list[np.ndarray], n: int) -> np.ndarray:
    return _sum(np.concatenate(places), np.concatenate([spread(x) for x in rows[column].to_pylist()]), n)


def _root(model: Model, customers: np.ndarray, seed: tuple) -> np.ndarray:
    """The parent's tables of words, given their customers."""
    own = np.full(len(customers), ROOT_STRENGTH + ROOT_DISCOUNT * max(model.tables - 1, 0))
    return seat(customers, own, np.ones(len(customers)), 0.0, 1.0 / (model.known + 1), ROOT_DISCOUNT, np.random.default_rng(seed))


FIRST = "cell bigint, side int, shard bigint, n binary, once binary, t binary, root binary, c_all bigint, t_all bigint, n_all bigint, known bigint, c_rest bigint, t_rest bigint"


def _first(key: tuple, rows: pa.Table) -> pa.Table:
    """Keys of a shard to each cell's active ones: customers, tables of pairs seen once, and of the others, one each to start with.

    Words with pairs seen once alone have fixed customers in the parent; these start with as many tables as words."""
    side, shard = (x.as_py() for x in key)
    rows = rows.sort_by("cell")
    found, places = _merged(rows)
    n, once, t = (_added(rows, c, places, len(found)) for c in ("n", "once", "active"))
    out = []
    for cell, active, at in zip(rows["cell"].to_pylist(), rows["active"].to_pylist(), places, strict=True):
        at = at[spread(active) > 0]
        out.append({"cell": cell, "side": side, "shard": shard, **{c: squeeze(x[at]) for c, x in (("n", n), ("once", once), ("t", once + t), ("root", np.minimum(once + t, 1)))}})
    if side:
        rest = once[t == 0]
        out[0] |= {"c_all": int((once + t).sum()), "t_all": int((n > 0).sum()), "n_all": int(n.sum()), "known": int((n > 0).sum()), "c_rest": int(rest.sum()), "t_rest": int((rest > 0).sum())}
    return pa.Table.from_pylist(out, schema=_schema(FIRST))


SWEPT = "cell bigint, side int, shard bigint, keys binary, once binary, t binary, kind string"
TOTALS = "cell bigint, side int, shard bigint, t binary, root binary, c_all bigint, t_all bigint"


def _joined(rows: list[dict], side: int, column: str) -> np.ndarray:
    return np.concatenate([spread(r[column]) for r in sorted((r for r in rows if r["side"] == side), key=lambda r: r["shard"])])


def _sweep(model: Model, sweep: int, grid: Grid):
    """All tables but one leave each active dish and the parent; then their number is drawn again."""

    def run(key: tuple, state: pa.Table, rows: pa.Table) -> pa.Table:
        state, rows = state.to_pylist()[0], rows.to_pylist()
        fixed, last = ([r for r in rows if r["side"] >= 0 and r["sweep"] == x] for x in (0, sweep - 1))
        word, context, count = (spread(state[c]) for c in ("word", "at", "counts"))
        seats = next((spread(r["t"]) for r in rows if r["side"] < 0), np.ones(len(count), dtype=np.int64))
        own = STRENGTH + DISCOUNT * (_joined(last, 0, "t")[context] - seats)
        left = _joined(last, 1, "t")[word] - (seats - 1)
        up = model.parent(left, np.minimum(_joined(last, 1, "root")[word], left))
        seats = seat(count, own, up, 1.0, model.scale, DISCOUNT, np.random.default_rng((key[0].as_py(), sweep)))
        out = [{"kind": "tables", "side": -1, "t": squeeze(seats)}]
        for side, keys, at in ((0, state["contexts"], context), (1, state["words"], word)):
            keys = np.frombuffer(keys, np.uint64)
            out += [r | {"kind": "sums"} for r in _shards(grid, side, keys, t=_sum(at, seats, len(keys)), once=_joined(fixed, side, "once"))]
        return pa.Table.from_pylist([r | {"cell": key[0].as_py()} for r in out], schema=_schema(SWEPT))

    return run


def _total(model: Model, sweep: int):
    """Tables of a shard's active keys to totals for each cell; a shard of words seats the parent's customers too."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        side, shard = (x.as_py() for x in key)
        rows = rows.sort_by("cell")
        found, places = _merged(rows)
        t = _added(rows, "t", places, len(found))
        once = np.zeros(len(found), dtype=np.int64)
        for at, x in zip(places, rows["once"].to_pylist(), strict=True):
            once[at] = spread(x)  # a total already, the same from every cell
        t += once
        root = _root(model, t, (shard, sweep)) if side else t[:0]
        out = [{"cell": cell, "side": side, "shard": shard, "t": squeeze(t[at]), "root": squeeze(root[at]) if side else None} for cell, at in zip(rows["cell"].to_pylist(), places, strict=True)]
        if side:
            out[0] |= {"c_all": int(t.sum()), "t_all": int(root.sum())}
        return pa.Table.from_pylist(out, schema=_schema(TOTALS))

    return run


LAST = "cell bigint, side int, shard bigint, sweep int, n binary, t binary, root binary, c_all bigint, t_all bigint"


def _last(models: dict[int, Model]):
    """All keys of a shard to customers, and for each sample totals and the parent's tables, for each cell."""

    def run(key: tuple, rows: pa.Table, sums: pa.Table) -> pa.Table:
        side, shard = (x.as_py() for x in key)
        rows = rows.sort_by("cell")
        found, places = _merged(rows)
        n, once = (_added(rows, c, places, len(found)) for c in ("n", "once"))
        out = [{"cell": cell, "side": side, "shard": shard, "sweep": 0, "n": squeeze(n[at])} for cell, at in zip(rows["cell"].to_pylist(), places, strict=True)]
        for sweep, model in models.items():
            mine, t = sums.filter(pc.equal(sums["sweep"], sweep)), once.copy()
            if len(mine):
                keys, at = _merged(mine)
                t[np.searchsorted(found, keys)] += _added(mine, "t", at, len(keys))
            root = _root(model, t, (shard, sweep, 1)) if side else t[:0]
            more = [{"cell": cell, "side": side, "shard": shard, "sweep": sweep, "t": squeeze(t[at]), "root": squeeze(root[at]) if side else None} for cell, at in zip(rows["cell"].to_pylist(), places, strict=True)]
            if side:
                more[0] |= {"c_all": int(t.sum()), "t_all": int(root.sum())}
            out += more
        return pa.Table.from_pylist(out, schema=_schema(LAST))

    return run


ANSWERS = "answer_block bigint, answer_cell bigint, logs binary, known binary, kind string"


def _answer(models: dict[int, Model]):
    """A cell's pairs to the averaged predictive probabilities, for each block that asked."""

    def run(key: tuple, facts: pa.Table, asked: pa.Table) -> pa.Table:
        facts, total = facts.to_pylist(), 0.0
        state, customers = next(r for r in facts if r["side"] == -2), [r for r in facts if r["side"] >= 0 and r["sweep"] == 0]
        context, count = spread(state["at"]), spread(state["counts"])
        fan = spread(state["fan"])
        word, n = np.repeat(np.arange(len(fan)), fan), _joined(customers, 0, "n")[context]
        for sweep, model in models.items():
            mine = [r for r in facts if r["sweep"] == sweep]
            seats = np.minimum(count, 1)
            if (count > 1).any():
                seats[count > 1] = spread(next(r["t"] for r in mine if r["side"] == -1))
            parent = model.parent(_joined(mine, 1, "t"), _joined(mine, 1, "root")) * model.scale
            total = total + (count - DISCOUNT * seats + (STRENGTH + DISCOUNT * _joined(mine, 0, "t")[context]) * parent[word]) / (STRENGTH + n)
        logs, known = np.log10(total / len(models)).astype(np.float32), _joined(customers, 1, "n")[word]
        places = [np.cumsum(spread(x)) for x in asked["places"].to_pylist()]
        rows = [{"answer_block": b, "answer_cell": key[0].as_py(), "logs": logs[p].tobytes(), "known": squeeze(known[p]), "kind": f"docs{_turn(b)}"} for b, p in zip(asked["block"].to_pylist(), places, strict=True)]
        return pa.Table.from_pylist(rows, schema=_schema(ANSWERS))

    return run


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(model: Model):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        row, answers = docs.to_pylist()[0], answers.sort_by("answer_cell")
        logs = np.frombuffer(b"".join(answers["logs"].to_pylist()), np.float32).astype(np.float64)
        counts = np.concatenate([spread(x) for x in answers["known"].to_pylist()])
        base, places, n = np.log10((counts + ADD) / (model.n + ADD * (model.known + 1))), spread(row["places"]), spread(row["lengths"])
        sums = [np.add.reduceat(x[places], np.cumsum(n) - n) for x in ((counts > 0).astype(np.int64), base, logs)]
        columns = [row["doc_ids"], [not x for x in row["train"]], n, sums[0], np.full(len(n), model.n), sums[1], sums[2]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _schema(SCORES), strict=True)], schema=_schema(SCORES))

    return run


def _sums(df: DataFrame, *columns: str) -> list[int]:
    return [int(x or 0) for x in df.agg(*(F.sum(c) for c in columns)).first()]


def scores(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text)."""
    shelf = Shelf(docs.sparkSession)
    cells = -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // CELL_CHARS)
    bits = max(0, cells - 1).bit_length()
    grid = Grid(bits - bits // 2, bits // 2)
    train = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) != 0
    rows = docs.select("doc_id", train.alias("train"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    blocks = shelf.put(rows.mapInArrow(_block_rows(grid), BLOCKS), by="kind")
    turns = []
    for turn in range(TURNS):
        turns.append(shelf.put(blocks.filter(F.col("kind") == f"pairs{turn}").groupBy("cell").applyInArrow(_build(grid), BUILT), by="kind"))
        shelf.drop(blocks, f"kind=pairs{turn}")
        shelf.clean()

    def built(kind: str, *columns: str) -> DataFrame:
        return reduce(DataFrame.union, [t.filter(F.col("kind") == kind).select(*columns) for t in turns])

    keys, active = built("keys", "cell", "side", "shard", "keys", "n", "once", "active"), built("active", "cell", "words", "contexts", "word", "at", "counts")
    first = shelf.put(keys.groupBy("side", "shard").applyInArrow(_first, FIRST))
    c, t, n, known, c_rest, t_rest = _sums(first, "c_all", "t_all", "n_all", "known", "c_rest", "t_rest")
    model = Model(c, t, n, known)
    fixed = first.select("cell", "side", "shard", "once", "t", "root", F.lit(0).alias("sweep"))
    last, sums, seats, models, kept, done = fixed, [], [], {}, [], [first]
    for sweep in range(1, BURN + SAMPLES + 1):
        swept = shelf.put(active.groupBy("cell").cogroup(last.groupBy("cell")).applyInArrow(_sweep(model, sweep, grid), SWEPT), by="kind")
        moved = swept.filter("kind = 'sums'").drop("kind")
        totals = shelf.put(moved.groupBy("side", "shard").applyInArrow(_total(model, sweep), TOTALS))
        c, t = _sums(totals, "c_all", "t_all")
        model = Model(c + c_rest, t + t_rest, n, known)
        mine = swept.filter("kind = 'tables'").select("cell", "side", "shard", "t", F.lit(sweep).alias("sweep"))
        last = fixed.unionByName(totals.select("cell", "side", "shard", "t", "root", F.lit(sweep).alias("sweep")), allowMissingColumns=True).unionByName(mine, allowMissingColumns=True)
        done.append(totals)
        kept.append(swept)
        if sweep <= BURN:
            shelf.drop(swept, "kind=sums")
        else:
            sums.append(moved.select("side", "shard", "cell", "keys", "t", F.lit(sweep).alias("sweep")))
            seats.append(mine)
            models[sweep] = model
        shelf.clean()
    for x in done:
        shelf.drop(x)
    for x in turns:
        shelf.drop(x, "kind=active")
    final = shelf.put(keys.groupBy("side", "shard").cogroup(reduce(DataFrame.union, sums).groupBy("side", "shard")).applyInArrow(_last(models), LAST))
    for r in final.groupBy("sweep").agg(F.sum("c_all").alias("c"), F.sum("t_all").alias("t")).filter("sweep > 0").collect():
        models[r.sweep] = Model(r.c or 0, r.t or 0, n, known)
    for x in turns:
        shelf.drop(x, "kind=keys")
    for x in kept:
        shelf.drop(x, "kind=sums")
    shelf.clean()
    answers = []
    for turn, table in enumerate(turns):
        facts = table.filter("kind = 'state'").select("cell", "fan", "at", "counts", F.lit(-2).alias("side"), F.lit(-1).alias("sweep"))
        for x in (final.select("cell", "side", "shard", "n", "t", "root", "sweep"), *seats):
            facts = facts.unionByName(x.filter(F.col("cell") % TURNS == turn), allowMissingColumns=True)
        asked = table.filter("kind = 'asked'").select("cell", "block", "places")
        answers.append(shelf.put(facts.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(_answer(models), ANSWERS), by="kind"))
        shelf.drop(table)
        shelf.clean()
    for x in (final, *kept):
        shelf.drop(x)
    out = []
    for turn in range(TURNS):
        mine = F.col("kind") == f"docs{turn}"
        texts, found = blocks.filter(mine).select("block", "doc_ids", "train", "lengths", "places"), reduce(DataFrame.union, [x.filter(mine).drop("kind") for x in answers])
        out.append(shelf.put(texts.groupBy("block").cogroup(found.groupBy("answer_block")).applyInArrow(_score(model), SCORES)))
        for x in (blocks, *answers):
            shelf.drop(x, f"kind=docs{turn}")
        shelf.clean()
    for x in (blocks, *answers):
        shelf.drop(x)
    return reduce(DataFrame.union, out)
