"""The whole query's base spans against plain regular expressions, text by text."""

import hashlib
import re

from conftest import SF
from strandline.llm import queries

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_base_spans_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op3_secret_scan(spark, SF).collect()}
    found = 0
    for r in rows:
        spans = base(r.text or "")
        shown = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans]
        own = got[r.doc_id]
        assert [own.n_assign, own.n_access, own.n_hex] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert own.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(own.spans.split(","))
        found += len(spans)
    assert len(got) == len(rows) and found > 5
