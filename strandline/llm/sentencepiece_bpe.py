"""Exact merge-type (BPE) encoding with a SentencePiece model, by backtracking.

Merging never crosses a place that no piece of the vocabulary covers, so a text falls into segments (a run of spaces with the word
or the signs after it, a digit, a line feed) that encode alone. In a segment an Aho-Corasick automaton gives the longest piece at each
place. Pieces are taken left to right; a piece may follow the last one if merging the two together again gives these two; if
none may, the last one is taken back and a bitfield remembers that no encoding passes the place it ended. The result is the
merge encoding, in linear time.

Runs of spaces have one score for all their pieces, so only their own re-merging (kept by length) settles them. Null counts as
empty; the empty text has no ids.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import text_bytes

SPACE = "▁"


class _Kept(dict):
    """Results of make() for short segments; emptied when full, so a worker's memory stays bounded."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, segment: str) -> tuple:
        got = self.make(segment)
        if len(segment) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[segment] = got
        return got


class Codec:
    """Encoder and decoder of one model file. Only the vocabulary and its scores are read from the library."""

    def __init__(self, model: str, most: int = 500_000):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.vocab_size()
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.pieces = {lib.id_to_piece(i): i for i in plain}
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        self.byte_id = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        self.shown = {i: p.replace(SPACE, " ").encode() for p, i in self.pieces.items()}
        self.shown |= {i: bytes([b]) for b, i in self.byte_id.items()}
        self.shown |= {i: lib.decode([i]).encode() for i in range(n) if lib.is_unknown(i)}
        if lib.encode(" ﬁ", out_type=str)[-1] == "▁fi" or not lib.encode("a", out_type=str)[0].startswith(SPACE):
            raise ValueError("this codec needs a space prefix and no normalisation")
        self.segment_pattern = _segments_of(self.pieces)
        #: Of each piece that merging can make: its last merge. Others never occur.
        self.halves: dict[str, tuple[str, str]] = {}
        self.made = ahocorasick.Automaton()
        for p in sorted(self.pieces, key=len):
            if len(p) > 1 and self.remerge(p) == [p]:
                self.made.add_word(p, len(p))
                self.halves[p] = self.last
        self.made.make_automaton()
        self.spines: tuple[dict, dict] = {}, {}
        self.most, self.good, self.bad, self.runs = most, set(), set(), {}
        self.words = _Kept(self._word, most)
        self.word = self.words.__getitem__

    def remerge(self, text: str) -> list[str]:
        """The merge encoding by its definition: the best-scored adjacent pair first, the leftmost of equal ones."""
        part, nxt, prv = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < len(part) and (whole := part[i] + part[j]) in self.score:
                heapq.heappush(heap, (-self.score[whole], i, whole))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = nxt[i] if part[i] else len(part)
            if j >= len(part) or part[i] + part[j] != whole:
                continue
            self.last = part[i], part[j]
            part[i], part[j] = whole, ""
            nxt[i] = nxt[j]
            if nxt[i] < len(part):
                prv[nxt[i]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [p for p in part if p]

    def _spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """Parts of a piece at one of its ends, the character first, each with the score of the merge that takes it in."""
        got = self.spines[side].get(piece)
        if got is None:
            got, above = [], -float("inf")
            part = piece
            while True:
                got.append((part, above))
                if part not in self.halves:
                    break
                part, above = self.halves[part][side], self.score[part]
            got.reverse()
            self.spines[side][piece] = got
        return got

    def _fits(self, a: str, b: str) -> bool:
        """Whether b may stand after a: whether merging the two together again leaves these two.

        Both grow by their own merges, the better score first; they stay apart unless at some moment the parts that face each
        other make a piece with a better score than the next merge of either. Of equal scores the left place merges first.
        """
        left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            (x, up), (y, next_up) = left[i], right[j]
            both = self.score.get(x + y)
            if both is not None and both > up and both >= next_up:
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if up >= next_up and i + 1 < len(left):
                i += 1
            elif j + 1 < len(right):
                j += 1
            else:
                i += 1

    def backtrack(self, text: str) -> list[str]:
        """Merge encoding of a segment without runs of spaces."""
        tries: list[list[int]] = [[1] for _ in text]  # lengths of the pieces that start at a place, shortest first
        for end, n in self.made.iter(text):
            tries[end + 1 - n].append(n)
        size, good, bad = len(text), self.good, self.bad
        if len(good) + len(bad) > self.most:
            good.clear()
            bad.clear()
        failed, at, out, last = 0, 0, [], ""  # failed: bit i is set if no encoding passes place i
        choice = len(tries[0]) - 1 if text else 0
        while at < size:
            own = tries[at]
            while choice >= 0:
                end = at + own[choice]
                if not failed >> end & 1:
                    piece = text[at:end]
                    if not last or (pair := last + "\n" + piece) in good:
                        break
                    if pair not in bad:
                        if self._fits(last, piece):
                            good.add(pair)
                            break
                        bad.add(pair)
                choice -= 1
            if choice < 0:
                failed |= 1 << at
                at -= len(out.pop())
                choice = tries[at].index(len(last)) - 1
                last = out[-1] if out else ""
            else:
                out.append(piece)
                last, at = piece, end
                if at < size:
                    choice = len(tries[at]) - 1
        return out

    def _ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if p in self.pieces:
                out.append(self.pieces[p])
            elif self.byte_id:
                out += [self.byte_id[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def segment(self, text: str) -> list[int]:
        """Ids of one segment: spaces, then what follows them."""
        word = text.lstrip(SPACE)
        n = len(text) - len(word)
        if not word or n == 0:
            return self.run(n) if not word else self._ids(self.backtrack(word))
        head = self.backtrack(SPACE + word)
        if head[0] == SPACE:
            return self.run(n) + self._ids(head[1:])
        return self.run(n - 1) + self._ids(head)

    def run(self, n: int) -> list[int]:
        if n not in self.runs:
            if len(self.runs) >= 10_000:
                self.runs.clear()
            self.runs[n] = self._ids(self.remerge(SPACE * n))
        return self.runs[n]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, as the library's encode() gives them."""
        return [int(i) for s in self.segments(text) for i in self.word(s)[1].split(",")]

    def segments(self, text: str) -> list[str]:
        """Segments of a text with the space before it that the model adds; of the empty text, none."""
        return self.segment_pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def summary(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal with commas, SHA-256 of what they decode to."""
        counts, ids, shown = zip(*map(self.word, self.segments(text)), strict=True) if text else ((), (), ())
        n, ids, shown = sum(counts), ",".join(ids), b"".join(shown)
        if shown[:1] == b" ":  # the prefix that encoding puts before a text
            shown = shown[1:]
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(_repaired(shown).encode()).hexdigest()

    def _word(self, segment: str) -> tuple[int, str, bytes]:
        """Number of ids of a segment, the ids in decimal, and what they decode to."""
        ids = self.segment(segment)
        return len(ids), ",".join(map(str, ids)), b"".join([self.shown[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Text of ids, as the library's decode() gives it."""
        shown = b"".join([self.shown.get(i, b"") for i in ids])
        return _repaired(shown[1:] if shown[:1] == b" " else shown)


def _segments_of(pieces: dict[str, int]) -> re.Pattern:
    """Pattern of the segments that encode alone: cuts fall only between characters that no piece holds side by side.

    Latin letters, and whatever stands beside one in a piece, make one class; digits and line feeds stand alone where no piece
    joins them to others; all the rest is a second class. Spaces begin a segment.
    """
    bad = [p for p in pieces if SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE)]
    if bad:
        raise ValueError(f"pieces with spaces inside: {bad[:5]}")
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False) if SPACE not in (a, b)}
    latin = {chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()}
    while more := {x for a, b in pairs if (a in latin) != (b in latin) for x in (a, b)} - latin:
        latin |= more
    lone = [c for c in "0123456789\n" if not any(c in pair for pair in pairs) and SPACE + c not in pieces]
    one, first = re.escape("".join(lone)), re.escape("".join(sorted(latin)))
    return re.compile(f"[{one}]|{SPACE}*(?:[{first}]+|[^{one}{first}{SPACE}]+)|{SPACE}+" if lone else f"{SPACE}*(?:[{first}]+|[^{first}{SPACE}]+)|{SPACE}+")


def _repaired(data: bytes) -> str:
    """UTF-8, each byte that isn't part of a character as U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", "\ufffd", data.decode("utf-8", "surrogateescape"))


_CODECS: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """The codec of a model file, kept for the life of a Python worker."""
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_summary(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        gc.disable()  # millions of small tuples and no cycles
        try:
            for batch in batches:
                rows = [own.summary(data.decode("utf-8", "replace")) for data in batch.column(1).to_pylist()]
                n, ids, shown = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(shown, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            gc.enable()

    return text_bytes(docs).mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """The same rows with an array column of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.append_column(ids, pa.array([own.encode(t or "") for t in texts], pa.list_(pa.int32())))

    if ids in docs.columns:
        raise ValueError(f"there is a column {ids} already")
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{ids}` array<int>"]))


def decode(docs: DataFrame, model: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """The same rows with a text column decoded from the ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            yield batch.append_column(text, pa.array([own.decode(r or []) for r in rows], pa.string()))

    if text in docs.columns:
        raise ValueError(f"there is a column {text} already")
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{text}` string"]))
