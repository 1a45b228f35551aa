import hashlib
import re

import pytest

from structlake.llm.exact_dedup import exact_dedup, exact_groups

from .data import empty, frame, odd, rows


def brute(some):
    groups = {}
    for r in some:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    out = set()
    for norm, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0]))[0]
        out |= {(r[0], keep, len(members), r[0] == keep, hashlib.sha256(norm.encode()).hexdigest()) for r in members}
    return out


@pytest.mark.parametrize("bits", [64, 2])
def test_equals_brute_force(spark, bits):
    got = {tuple(r)[:5] for r in exact_groups(frame(spark), hash_bits=bits, least=8, most=40).collect()}
    assert got == brute(rows())


def test_production_chunks(spark):
    assert {tuple(r)[:5] for r in exact_groups(frame(spark)).collect()} == brute(rows())


def test_filter_keeps_columns(spark):
    out = exact_dedup(frame(spark))
    assert out.columns == frame(spark).columns
    assert {r.doc_id for r in out.collect()} == {x[0] for x in brute(rows()) if x[3]}


def test_edges(spark):
    assert exact_groups(empty(spark)).count() == 0
    assert exact_groups(odd(spark)).count() == 7
    assert exact_groups(odd(spark), hash_bits=1, least=8, most=40).count() == 7
    assert exact_dedup(odd(spark)).count() > 0
