"""Plans and whole queries: every token in one piece, sequences without gaps, little padding, ids as the library gives them."""

import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers as files
import pytest
from tokenizers import Tokenizer

from conftest import SF
from strandline.llm import byte_bpe, cutting_stock, queries
from strandline.llm.cutting_stock import CAPACITY, Plan, padded


def hist(lengths):
    return dict(Counter(max(1, min(CAPACITY - 1, int(x))) for x in lengths))


RNG = random.Random(4)
TABLES = {
    "even": hist(RNG.randrange(1, CAPACITY) for _ in range(3000)),
    "one length": {600: 5000},
    "a third of one length": hist([700] * 2000) | hist(RNG.randrange(1, CAPACITY) for _ in range(4000)),
    "none fit together": hist(RNG.gauss(700, 40) for _ in range(3000)),
    "short": hist(RNG.expovariate(1 / 30) + 1 for _ in range(3000)),
    "single": {600: 1},
    "ones": {1: 3000},
    "few": hist([5, 900, 1023]),
}


@pytest.mark.parametrize("name", TABLES)
def test_plan_places_every_token_once(name):
    demand = TABLES[name]
    plan, held = Plan(demand), defaultdict(list)
    for x, n in demand.items():
        for rank in range(n):
            at = 0
            for start, size, sequence, offset in sorted(plan.pieces(x, rank)):
                assert start == at and size > 0
                at += size
                held[sequence].append((offset, size))
            assert at == x
    padding = 0
    for pieces in held.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= CAPACITY
        padding += padded(at, CAPACITY) - at
    tokens = sum(x * n for x, n in demand.items())
    assert set(held) == set(range(plan.sequences)) and padding <= 8 + 0.002 * tokens


def whole(spark, docs, special="<|endoftext|>"):
    lib = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    out = cutting_stock.pack_tokens(docs, files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken")).collect()
    texts = docs.select("doc_id", "text").collect()
    return out, {r.doc_id: lib.encode(r.text or "", add_special_tokens=False).ids + [0] for r in texts}


def check(out, ids):
    pieces, held = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        held[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for i, want in ids.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(array("I", want[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(want)
    padding = 0
    for found in held.values():
        at = 0
        for offset, size in sorted(found):
            assert offset == at
            at += size
        assert at <= CAPACITY
        padding += padded(at, CAPACITY) - at
    assert padding <= 0.005 * sum(map(len, ids.values())) + 8


def test_query_equals_library(spark):
    out = queries.op12_cutting_stock(spark, SF).collect()
    _, ids = whole(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    check(out, ids)


def test_edge_rows(spark):
    texts = [None, "", " ", "x", "a  b\n c", " lead", "trail ", "sign <|endoftext|> in", "日本語 テキスト ٣ x y z", "wort " * 20_000, "x" * 3000, "tab\there \r\n"]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(100 + i, "same text of a few words", "k") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    check(*whole(spark, docs))
    copies = spark.createDataFrame([(None, "one two"), (None, "one two"), (7, "three"), (7, "three")], "doc_id long, text string")
    out = cutting_stock.pack_tokens(copies, files.path("byte_bpe_50k.json")).collect()
    assert sum(r.length for r in out) == 2 * 3 + 2 * 2 and Counter(r.doc_id for r in out if r.start == 0) == {None: 2, 7: 2}
    assert cutting_stock.pack_tokens(docs.limit(0), files.path("byte_bpe_50k.json")).count() == 0


def test_memo_equals_library():
    lib = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    rng, signs = random.Random(8), ["a", "B", "é", "ß", "1", "22", " ", "  ", "\n", "\t", "'s", "'ll", ",", ".", "<|endoftext|>", "日", " ", " ", "€", "–", "ŉ", "ε", "ж", "\x1c", "٣", "😀", "word", " of"]
    for special in (True, False):
        lib.encode_special_tokens = not special
        own = byte_bpe.ByteBPE(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), special)
        for _ in range(3000):
            text = "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
            assert list(array("I", own.packed(text))) == lib.encode(text, add_special_tokens=False).ids, repr(text)
