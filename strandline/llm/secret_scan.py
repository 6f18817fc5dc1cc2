"""Secret scan with structural confirmation.

Three base patterns give spans as they stand. Beside them, base64 and hex candidates are decoded and reported only if the bytes
parse: ASN.1 keys whose nested lengths fill the encoding, SSH key blobs whose length-prefixed fields fill the blob, and signed
tokens whose header is a JSON object that names an algorithm. Spans count code points, end exclusive.

Null and empty texts have no spans. Texts are scanned whole, one row at a time, so a row's cost doesn't depend on others.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .store import text_bytes

#: Fixed values of the contract: kind, pattern, smallest length, group that the length holds for.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 16, 0),
)
#: hex is searched with its smallest length in the pattern: a run is found whole or not at all either way.
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "asn1", "ssh", "signed")
SIGNED = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
#: Where a candidate may begin: not inside a run, and after an escaped line end rather than at its letter.
BEGIN = r"(?:(?<![\\{0}])|(?<=\\)(?![nrt])|(?<=\\[nrt]))"
#: Line ends inside a body: real or escaped, with white space around them.
BREAK = re.compile(r"[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*")


def _candidates(alphabet: str, begin: str, pad: str) -> re.Pattern:
    """Runs of an alphabet over one or more lines; all lines but the last, which may be of any length, have 16 or more."""
    return re.compile(f"{BEGIN.format(begin)}(?=[{alphabet}]{{16}})(?:[{alphabet}]{{16,}}+{BREAK.pattern})*[{alphabet}]++{pad}")


#: Candidates and the bits of a character: base64, its url-safe form, hex in either case, and hex in lower case alone.
ENCODED = (
    (_candidates("A-Za-z0-9+/", "A-Za-z0-9+/", "={0,2}"), 6),
    (_candidates("A-Za-z0-9_-", "A-Za-z0-9_-", "={0,2}"), 6),
    (_candidates("0-9A-Fa-f", "0-9A-Fa-f", ""), 4),
    (_candidates("0-9a-f", "0-9a-f", ""), 4),
)
BASE64_LEAST, HEX_LEAST = 40, 64


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """ASN.1 length at a place: (value, place after it)."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n


def _elements(data: bytes, start: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill data[start:end] exactly, sequences inside them too; None if they don't."""
    out = []
    while start < end:
        got = _length(data, start + 1)
        if got is None or got[1] + got[0] > end:
            return None
        tag, (n, body) = data[start], got
        if tag in (0x30, 0x31) and (depth > 8 or _elements(data, body, body + n, depth + 1) is None):
            return None
        out.append((tag, body, body + n))
        start = body + n
    return out


def is_asn1_key(data: bytes) -> bool:
    """A sequence over the whole of data that starts as a private or public key does: a small version number or an algorithm."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    got = _length(data, 1)
    if got is None or got[1] + got[0] != len(data):
        return False
    inner = _elements(data, got[1], len(data))
    if not inner or len(inner) < 2:
        return False
    tag, a, b = inner[0]
    if tag == 0x02:  # version, or a modulus
        return b - a == 1 and data[a] < 4 and len(inner) >= 3 or b - a >= 48
    if tag != 0x30:
        return False
    algorithm = _elements(data, a, b)
    return bool(algorithm) and algorithm[0][0] == 0x06 and inner[1][0] in (0x03, 0x04)


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key container, or length-prefixed fields that fill the blob, the first one naming a key type."""
    if data.startswith(b"openssh-key-v1\0"):
        data = data[15:]
        return len(data) > 4 and 0 < int.from_bytes(data[:4], "big") <= min(64, len(data) - 4)
    at, fields = 0, []
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return at == len(data) and len(fields) >= 2 and re.match(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+$", fields[0]) is not None


def is_signed_header(part: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def _decode(run: str, bits: int) -> bytes:
    if bits == 4:
        return bytes.fromhex(run[: len(run) // 2 * 2])
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run.translate(URL_SAFE) + "=" * (-len(run) % 4))


URL_SAFE = str.maketrans("-_", "+/")


def _ssh_ends(data: bytes) -> list[int]:
    """Places in data where an SSH key blob or container that begins it may end, the last first."""
    at, ends = 0, []
    if data.startswith(b"openssh-key-v1\0"):  # three fields, a count, so many public keys, the private part
        at, left, counted = 15, 3, False
        while at + 4 <= len(data):
            n = int.from_bytes(data[at : at + 4], "big")
            if left == 0 and not counted:
                at, left, counted = at + 4, n + 1, True
                continue
            at, left = at + 4 + n, left - 1
            if left == 0 and counted:
                return [at, len(data)] if at <= len(data) else [len(data)]
        return [len(data)]
    while at + 4 <= len(data):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at <= len(data):
            ends.append(at)
    return ends[::-1]


def _encoded_keys(text: str, m: re.Match, bits: int) -> Iterator[tuple[int, int, int]]:
    """(start, kind number, end) of keys that begin at a line of a candidate and end at the end of one."""
    lines, at = [], m.start()
    for x in BREAK.finditer(text, m.start(), m.end()):
        lines.append((at, x.start()))
        at = x.end()
    lines.append((at, m.end()))
    parts = [text[a:b].rstrip("=") for a, b in lines]
    before = [0, *accumulate(map(len, parts))]
    line_of = {n: i for i, n in enumerate(before)}
    least, free = BASE64_LEAST if bits == 6 else HEX_LEAST, 0
    for i, (start, _) in enumerate(lines):
        if i < free or not parts[i].startswith(("M", "AAAA", "b3Bl") if bits == 6 else ("30", "000000", "6f70656e", "6F70656E", "6F70656e", "6f70656E")):
            continue
        head = _decode(parts[i][:24], bits)
        if head[:1] == b"\x30":
            got = _length(head, 1)
            ends = [got[0] + got[1]] if got else []
            kind, body = 3, None
        elif head[4:7] in (b"ssh", b"ecd", b"sk-") or head.startswith(b"openssh-"):
            body = _decode("".join(parts[i:]), bits)
            ends, kind = _ssh_ends(body), 4
        else:
            continue
        for n in ends:
            j = line_of.get(before[i] + -(-n * 8 // bits))
            if j is None or j <= i or lines[j - 1][1] - start < least:
                continue
            data = body[:n] if body is not None else _decode("".join(parts[i:j]), bits)
            if (is_asn1_key if kind == 3 else is_ssh_key)(data):
                yield start, kind, lines[j - 1][1]
                free = j
                break


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    out = []
    for kind, (_, pattern, least, group) in enumerate(BASE):
        for m in (HEX if kind == 2 else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what decodes and parses."""
    out = []
    for m in SIGNED.finditer(text):
        if is_signed_header(m[1]):
            out.append((m.start(), 5, m.end()))
    for pattern, bits in ENCODED:
        for m in pattern.finditer(text):
            if m.end() - m.start() >= (BASE64_LEAST if bits == 6 else HEX_LEAST):
                out += _encoded_keys(text, m, bits)
    return sorted(set(out))


def spans(text: str) -> tuple[list, list]:
    """Base spans, and all spans, in order."""
    base = base_spans(text)
    return base, sorted(base + confirmed_spans(text))


def _said(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_confirmed bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[] for _ in range(6)]
        for data in batch.column(1).to_pylist():
            base, every = spans(data.decode("utf-8", "replace"))
            kinds = [k for _, k, _ in base]
            values = kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_said(base).encode()).hexdigest(), _said(every), len(every) - len(base)
            for column, value in zip(rows, values, strict=True):
                column.append(value)
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, t) for r, t in zip(rows, types, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])


def secret_scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed (spans that the method adds)."""
    return text_bytes(docs).mapInArrow(_scan, SCHEMA)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, out = batch.schema.get_field_index("text"), []
        for text in batch.column(at).to_pylist():
            found, parts, end = spans(text)[1] if text else [], [], 0
            for a, k, b in found:
                if a >= end:
                    parts += [text[end:a], f"<{KINDS[k]}>"]
                end = max(end, b)
            out.append("".join(parts) + text[end:] if found else text)
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, each secret in text replaced by its kind in angle brackets; overlapping spans are one."""
    return docs.mapInArrow(_clean, docs.schema)
