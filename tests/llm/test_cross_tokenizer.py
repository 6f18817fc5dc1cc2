"""Groups, links and corpus counts against a plain version built on the libraries' own ids of whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as files
import sentencepiece
from tokenizers import Tokenizer

from conftest import SF
from strandline.llm import cross_tokenizer as X
from strandline.llm import queries

FILES = files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.path("piece_bpe_32k.model")


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(FILES[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
        printable = [b for b in range(256) if 0x20 < b < 0x7F or 0xA0 < b < 0x100 and b != 0xAD]
        rest = [b for b in range(256) if b not in printable]
        self.byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()


def split(plain, text):
    """Groups of a text, with running offsets."""
    if not text:
        return []
    a, b, whole = plain.a.encode(" " + text, add_special_tokens=False).ids, plain.b.encode(text), (" " + text).encode()
    ab, bb = [bytes(plain.byte[c] for c in plain.a.id_to_token(i)) for i in a], [plain.b_bytes(i) for i in b]
    if b"".join(ab) != whole or b"".join(bb) != whole:
        return []
    at = lambda tokens: np.cumsum([len(t) for t in tokens]).tolist()
    a_ends, b_ends = at(ab), at(bb)
    cuts, out, i, j = sorted(set(a_ends) & set(b_ends)), [], 0, 0
    for cut in cuts:
        x, y = a_ends.index(cut, i) + 1, b_ends.index(cut, j) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def expected(rows):
    plain = Plain()
    groups = [split(plain, t) for _, t in rows]
    links = [Counter((p, q) for a, b in g for p in a for q in b) for g in groups]
    held, most = Counter(pair for own in links for pair in own), defaultdict(int)
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    out = []
    for (doc, _), g, own in zip(rows, groups, links, strict=True):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(k for (p, q), k in own.items() if held[p, q] == most[p])
        total = sum(k * held[pair] for pair, k in own.items())
        out.append((doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), best, total, hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def test_query_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op11_cross_tokenizer(spark, SF).collect()), key=str) == expected(rows)


def test_odd_texts_equal_plain_version(spark):
    rng, signs = random.Random(8), ["a", "B", "é", "ß", "1", "22", " ", "  ", "\n", "\t", "'s", ",", "<|endoftext|>", "</s>", "<unk>", "<0x41>", "▁", "日", " ", "–", "ﬁ", "\x00", "😀", "word", " of", "not"]
    texts = [None, "", " ", "x", " lead", "trail ", "日本語 テキスト", "long " * 3000, "y" * 5000] + ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(600)]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, chunk string").repartition(3)
    got = sorted(map(tuple, X.cross_tokenizer(docs, *FILES).collect()), key=str)
    assert got == expected(rows) and 0 < sum(r[1] == 0 for r in got) < 400
    assert X.cross_tokenizer(docs.limit(0), *FILES).count() == 0


def test_small_chunks_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plain = sorted(map(tuple, X.cross_tokenizer(docs, *FILES).collect()))
    many = X.chunks
    monkeypatch.setattr(X, "chunks", lambda *a: many(*a, most=5000))
    assert sorted(map(tuple, X.cross_tokenizer(docs, *FILES).collect())) == plain


def test_new_parts_are_encoded_together(monkeypatch):
    own, calls = X.Aligner(*FILES), []
    ids = own.a.ids
    monkeypatch.setattr(own.a, "ids", lambda text: calls.append(text) or ids(text))
    texts = [" ".join(f"wort{i * j}x{j},\nzeile" for j in range(40)) for i in range(50)]
    facts, digests, *_ = own.chunk(texts)
    assert len(calls) == 1 and own.parts.n > 1000
    groups = [split(Plain(), t) for t in texts[:5]]
    assert [tuple(f) for f in facts[:5]] == [(sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(len(a) * len(b) for a, b in g)) for g in groups]
    assert digests[:5] == [hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() for g in groups]


def test_wide_groups_and_an_emptied_memo_change_nothing(monkeypatch):
    texts = ["日本語の文書" * 20, "a b\nc", "<unk> x", "y" * 900, " two  spaces ", "ﬁ", "", "a b\nc d'été"]
    plain = X.Aligner(*FILES).chunk(texts)
    monkeypatch.setattr(X, "WIDE", 0)
    monkeypatch.setattr(X, "MOST", 1)
    own = X.Aligner(*FILES)
    for _ in range(2):
        for a, b in zip(plain, own.chunk(texts), strict=True):
            assert np.array_equal(a, b)
