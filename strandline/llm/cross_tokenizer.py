"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids stand together in the corpus.

Byte ranges of the B tokens make a static interval index: their starts and ends, sorted. For every A token two bisections give the B
tokens that its range overlaps. Between two A tokens lies a group boundary if no B token spans the gap, that is if the last B token of
the one isn't the first of the other. All pairs of an A and a B token of a group are links.

What stands between single spaces encodes alone with both tokenizers (see byte_bpe; in the B model spaces stand only at the front of a
piece), and so does what stands between single line feeds, which are tokens of their own in both. So a memo keeps the alignment of such
parts; other texts are aligned whole. A part or text whose joined A or B bytes differ from
its own has no tokens, and then its document has none.

Documents are gathered into chunks of bounded size where they are read. The new parts of a chunk are encoded together and laid end to
end; as tokens of both end where a part ends, one pass of bisections aligns them all. The memo numbers the parts and keeps what they
give in arrays, from which a chunk's documents gather theirs. It is emptied between chunks when full, so a worker's memory stays bounded.

A chunk keeps its distinct id pairs once, with how many of its
documents hold each; every document keeps the places of its pairs there. Pairs are counted over chunks, with partial sums; the counts
go back to the chunks by a join on the pair, in which a pair that all documents hold is one row for each chunk, never one for each document.

Null and empty texts have no tokens: zeros, and the empty string as digest. Each row is a document: repeated rows and ids count each
for itself, null ids too. Other columns are not read. Memory in a task is a chunk, or the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from .store import Shelf, text_bytes

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 1_000_000
#: An A id stands above this many bits of a B id in a pair.
BITS = 32
#: Parts, and bytes of them, from which the memo is emptied.
MOST, MOST_BYTES = 300_000, 16_000_000
#: Links of a group are listed one by one up to so many a token; of larger groups the distinct pairs are, with their numbers.
WIDE = 8
#: Columns of what the memo keeps of a part, and states: aligned, tokens with other bytes, not to be encoded alone.
N_A, N_B, GROUPS, LINKS, FIRST, PAIRS, STATE = range(7)
FINE, BAD, UNSAFE = range(3)


def boundaries(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens that end at these bytes: places in A and B at which groups end (numbers of tokens up to there)."""
    a_starts, b_starts = (np.concatenate([[0], x[:-1]]) for x in (a_ends, b_ends))
    first = np.searchsorted(b_ends, a_starts, "right")  # the first B token that ends after the A token starts
    last = np.searchsorted(b_starts, a_ends, "left")  # the first that starts at its end or later
    cuts = np.flatnonzero(last[:-1] <= first[1:]) + 1  # no B token spans the gap before these A tokens
    return np.append(cuts, len(a_ends)), np.append(last[cuts - 1], len(b_ends))


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whole numbers from each start, so many."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def links(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id pair and number of links, a pair more than once if it likes."""
    n_a, n_b = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
    wide = n_a * n_b > WIDE * (n_a + n_b)
    group = np.repeat(np.arange(len(n_a)), n_a)
    group, own = (x[~wide[group]] for x in (group, a))
    others = n_b[group]
    out = [(np.repeat(group, others), np.repeat(own, others) << BITS | b[spans((b_cuts - n_b)[group], others)], np.ones(others.sum(), np.int64))]
    for g in np.flatnonzero(wide).tolist():
        (p, m), (q, k) = (np.unique(x[c - n : c], return_counts=True) for x, c, n in ((a, a_cuts[g], n_a[g]), (b, b_cuts[g], n_b[g])))
        out.append((np.full(len(p) * len(q), g), (p[:, None] << BITS | q).ravel(), np.outer(m, k).ravel()))
    group, pairs, times = map(np.concatenate, zip(*out, strict=True))
    if wide.any():
        order = np.argsort(group, kind="stable")
        group, pairs, times = group[order], pairs[order], times[order]
    return group, pairs, times


def _longer(x: np.ndarray, n: int) -> np.ndarray:
    """An array with room for n rows, at least twice as long if it has to grow."""
    return x if n <= len(x) else np.concatenate([x, np.zeros((max(n - len(x), len(x)), *x.shape[1:]), x.dtype)])


def _totals(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running totals of x at the ends of stretches of these sizes, with 0 in front."""
    return np.append(0, np.cumsum(x))[np.append(0, np.cumsum(sizes))]


class Parts(dict):
    """Numbers of parts; what is looked up for the first time gets the next one and waits in new."""

    def __init__(self):
        super().__init__()
        self.n, self.new = 0, []

    def __missing__(self, part: str) -> int:
        self[part] = number = self.n
        self.n += 1
        self.new.append(part)
        return number


class Aligner:
    """The two tokenizers, and the memo of parts: their numbers, facts, digest texts, and links in pairs and times from FIRST on."""

    def __init__(self, a_file: str, a_ranks: str | None, b_model: str):
        import sentencepiece

        self.a = byte_bpe.encoder(a_file, a_ranks, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        n = self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)}
        self.a_bytes = self.a.token_bytes()
        self.b_bytes = [b"\xff" if i in special else bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]  # FF is in no text
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        self.signs = [b"%d%c" % (i, c) for m, end in ((len(self.a_bytes), "|"), (n, ";")) for c in map(ord, ("," + end)) for i in range(m)]
        self.sign_sizes = np.array(list(map(len, self.signs)))
        self.apart = all("▁" not in p.lstrip("▁") and not (p.startswith("▁▁") and p.strip("▁")) for p in pieces) and not any("\n" in p for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.parts, self.shown, self.held, self.bytes = Parts(), [], 0, 0
        self.facts, self.pairs, self.times = np.zeros((1024, 7), np.int64), np.zeros(4096, np.int64), np.zeros(4096, np.int64)

    def _a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A ids of texts that encode alone, one after another, and how many each has."""
        ids = np.array(self.a.ids("".join(texts)), np.int64)
        at, ends = np.cumsum(self.a_sizes[ids]), np.cumsum([len(t.encode()) for t in texts])
        cuts = np.searchsorted(at, ends)
        if len(ids) and cuts[-1] < len(at) and (at[cuts] == ends).all():
            return ids, np.diff(cuts + 1, prepend=0)
        every = list(map(self.a.ids, texts))
        return np.fromiter(chain.from_iterable(every), np.int64), np.array(list(map(len, every)))

    def _add_new(self) -> None:
        """Align the parts that wait."""
        new, kinds = self.parts.new, ([], [])
        self.parts.new, first = [], self.parts.n - len(new)
        self._grow()
        for number, part in enumerate(new, first):
            bare = part[1:] if part[:1] == "\n" else part
            if not bare or bare[0].isspace() or bare[-1].isspace():
                self.facts[number, STATE] = UNSAFE
            else:
                kinds[byte_bpe.PLAIN.fullmatch(part) is None].append((number, part))
        for together, kind in zip((True, False), kinds, strict=True):
            numbers, texts, b = [], [], []
            for (number, part), ids in zip(kind, self.b.encode([p for _, p in kind], num_threads=1) if kind else [], strict=True):
                if part[0] == "\n":
                    if not ids or self.b_bytes[ids[0]] != b" ":  # the space that encoding puts before a text
                        self.facts[number, STATE] = UNSAFE
                        continue
                    ids = ids[1:]
                numbers.append(number)
                texts.append(part if part[0] == "\n" else " " + part)
                b.append(ids)
            if together and texts:
                self._align(numbers, texts, *self._a(texts), b)
            elif texts:
                self._align_each(numbers, texts, b)

    def _align_each(self, numbers: list[int], texts: list[str], b: list[list[int]]) -> None:
        """Align texts that the A tokenizer gets one by one."""
        a = list(map(self.a.ids, texts))
        self._align(numbers, texts, np.fromiter(chain.from_iterable(a), np.int64), np.array(list(map(len, a))), b)

    def _grow(self) -> None:
        self.facts = _longer(self.facts, self.parts.n)
        self.shown += [b""] * (self.parts.n - len(self.shown))

    def _align(self, numbers: list[int], texts: list[str], a: np.ndarray, n_a: np.ndarray, b: list[list[int]]) -> None:
        """Align the tokens of texts and keep what they give under these numbers."""
        numbers, data, n_b = np.array(numbers), [t.encode() for t in texts], np.array(list(map(len, b)))
        b = np.fromiter(chain.from_iterable(b), np.int64, n_b.sum())
        self.bytes += sum(map(len, data))
        fine = np.ones(len(data), bool)
        for ids, n, own, sizes in ((a, n_a, self.a_bytes, self.a_sizes), (b, n_b, self.b_bytes, self.b_sizes)):
            joined, ends = b"".join(map(own.__getitem__, ids.tolist())), _totals(sizes[ids], n).tolist()
            fine &= [joined[x:y] == d for x, y, d in zip(ends[:-1], ends[1:], data, strict=True)]
        self.facts[numbers, STATE] = np.where(fine, FINE, BAD)
        if not fine.any():
            return
        numbers, a, b, n_a, n_b = numbers[fine], a[np.repeat(fine, n_a)], b[np.repeat(fine, n_b)], n_a[fine], n_b[fine]
        a_cuts, b_cuts = boundaries(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]))
        a_own, b_own = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
        group, pairs, times = links(a, b, a_cuts, b_cuts)
        groups = np.diff(np.searchsorted(a_cuts, np.cumsum(n_a), "right"), prepend=0)
        found = np.diff(np.searchsorted(group, np.cumsum(groups)), prepend=0)
        self.pairs, self.times = (_longer(x, self.held + len(pairs)) for x in (self.pairs, self.times))
        self.pairs[self.held : self.held + len(pairs)], self.times[self.held : self.held + len(pairs)] = pairs, times
        self.facts[numbers, :STATE] = np.column_stack([n_a, n_b, groups, np.diff(_totals(a_own * b_own, groups)), self.held + np.cumsum(found) - found, found])
        self.held += len(pairs)
        # digest texts: group after group its A tokens, then its B tokens, each with the sign that follows
        signs, last_a, last_b = np.empty(len(a) + len(b), np.int64), np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[a_cuts - 1], last_b[b_cuts - 1] = 1, 1
        signs[np.arange(len(a)) + np.repeat(b_cuts - b_own, a_own)] = a + last_a * len(self.a_bytes)
        signs[np.arange(len(b)) + np.repeat(a_cuts, b_own)] = 2 * len(self.a_bytes) + b + last_b * len(self.b_bytes)
        joined, ends = b"".join(map(self.signs.__getitem__, signs.tolist())), _totals(self.sign_sizes[signs], n_a + n_b).tolist()
        for number, x, y in zip(numbers.tolist(), ends[:-1], ends[1:], strict=True):
            self.shown[number] = joined[x:y]

    def chunk(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text A ids, B ids, groups and links, and a digest; the distinct pairs; and by text and pair the text, the pair's place and links."""
        if self.parts.n >= MOST or self.bytes >= MOST_BYTES:
            self.clear()
        found = []
        for text in texts:
            words = text.replace("\n", " \n").split(" ") if text and self.apart else []
            found.append(np.fromiter(map(self.parts.__getitem__, words), np.int64, len(words)))
        self._add_new()
        whole = [i for i, own in enumerate(found) if texts[i] and (not self.apart or (self.facts[own, STATE] == UNSAFE).any())]
        if whole:
            numbers = range(self.parts.n, self.parts.n + len(whole))
            self.parts.n += len(whole)
            self._grow()
            self._align_each(list(numbers), [" " + texts[i] for i in whole], [self.b.encode(texts[i]) for i in whole])
            for i, number in zip(whole, numbers, strict=True):
                found[i] = np.array([number])
        found = [own[:0] if (self.facts[own, STATE] == BAD).any() else own for own in found]
        digests = [hashlib.sha256(b"".join(map(self.shown.__getitem__, own.tolist()))[:-1]).hexdigest() if len(own) else "" for own in found]
        part, text = np.concatenate(found), np.repeat(np.arange(len(found)), list(map(len, found)))
        facts = np.column_stack([np.bincount(text, self.facts[part, c], len(found)).astype(np.int64) for c in (N_A, N_B, GROUPS, LINKS)])
        key, often = np.unique(text * self.parts.n + part, return_counts=True)
        text, part = np.divmod(key, max(self.parts.n, 1))
        n = self.facts[part, PAIRS]
        at = spans(self.facts[part, FIRST], n)
        pairs, place = np.unique(self.pairs[at], return_inverse=True)
        key, inverse = np.unique(np.repeat(text, n) * len(pairs) + place, return_inverse=True)
        times = np.bincount(inverse, self.times[at] * np.repeat(often, n), len(key)).astype(np.int64)
        return facts, digests, pairs, *np.divmod(key, max(len(pairs), 1)), times


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(*files: str | None) -> Aligner:
    """The aligner of two tokenizers, kept for the life of a Python worker."""
    if files not in _ALIGNERS:
        _ALIGNERS[files] = Aligner(*files)
    return _ALIGNERS[files]


def _longs(*names: str) -> list[pa.Field]:
    return [pa.field(n, pa.int64()) for n in names]


DOCUMENT = [*_longs("doc_id", "n_a", "n_b", "n_groups", "n_links"), pa.field("groups_sha256", pa.string()), pa.field("places", pa.binary()), pa.field("times", pa.binary())]
CHUNKS = pa.schema([*_longs("chunk"), pa.field("docs", pa.list_(pa.struct(DOCUMENT))), pa.field("pairs", pa.list_(pa.int64())), pa.field("held", pa.list_(pa.int64()))])
CHUNKS_DDL = "chunk bigint, docs array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string, places: binary, times: binary>>, pairs array<bigint>, held array<bigint>"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def chunks(docs: DataFrame, a_file: str, a_ranks: str | None, b_model: str, most: int = CHUNK) -> DataFrame:
    """A row for each chunk: its documents, its distinct pairs, and how many of its documents hold each."""

    def packed(number: int, ids: list, texts: list[str]) -> pa.RecordBatch:
        facts, digests, pairs, text, place, times = aligner(a_file, a_ranks, b_model).chunk(texts)
        held, ends, rows = np.bincount(place, minlength=len(pairs)), np.searchsorted(text, np.arange(len(texts) + 1)).tolist(), []
        place, times = place.astype(np.int32), times.astype(np.int32)
        for i, (doc, (n_a, n_b, groups, links), digest) in enumerate(zip(ids, facts.tolist(), digests, strict=True)):
            own = slice(ends[i], ends[i + 1])
            rows.append(dict(zip((f.name for f in DOCUMENT), (doc, n_a, n_b, groups, links, digest, place[own].tobytes(), times[own].tobytes()), strict=True)))
        lists = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (pairs, held))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([rows], CHUNKS.field("docs").type), *lists], schema=CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, data in zip(batch.column(0), batch.column(1), strict=True):
                data = data.as_py()
                if ids and size + len(data) > most:
                    yield packed(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc.as_py())
                texts.append(data.decode("utf-8", "replace"))
                size += len(data) + 64
        if ids:
            yield packed(number, ids, texts)

    return text_bytes(docs).mapInArrow(run, CHUNKS_DDL)


def pair_counts(chunked: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold an id pair linked, and whether no pair of its A id has more. Pairs are A id << 32 | B id."""
    held = chunked.select(F.inline(F.arrays_zip("pairs", "held"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("n"))
    counts = held.withColumn("a", F.shiftright("pair", BITS))
    most = counts.groupBy(F.col("a").alias("a_id")).agg(F.max("n").alias("most"))
    return counts.join(most, F.col("a") == F.col("a_id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def cross_tokenizer(docs: DataFrame, a_file: str, a_ranks: str | None, b_model: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    shelf = Shelf(docs.sparkSession)
    chunked = shelf.put(chunks(docs, a_file, a_ranks, b_model))
    counts = shelf.put(pair_counts(chunked))
    own = chunked.select("chunk", F.explode("pairs").alias("own"))
    found = own.join(counts, F.col("own") == F.col("pair")).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("found"))  # bounded by a chunk
    met = chunked.select("chunk", "docs").join(found, "chunk", "left").select("docs", F.col("found.n").alias("n"), F.col("found.best").alias("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(0)[i].as_py()
                n, best = (np.asarray(batch.column(c)[i].as_py() or [], t) for c, t in ((1, np.int64), (2, bool)))
                out = []
                for d in rows:
                    at, times = np.frombuffer(d["places"], np.int32), np.frombuffer(d["times"], np.int32).astype(np.int64)
                    out.append((d["doc_id"], d["n_a"], d["n_b"], d["n_groups"], d["n_links"], int(times[best[at]].sum()), int((times * n[at]).sum()), d["groups_sha256"]))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.string())], names=[c.split()[0] for c in RESULT.split(", ")])

    return met.mapInArrow(run, RESULT)
