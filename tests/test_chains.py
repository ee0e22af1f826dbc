"""Chains folded by segments against the plain fold."""

import hashlib
import random

import pytest

from provena.operators import audit

RECORD = "chain string, pos long, seq_id long, prev_hash string, entry_hash string, signature string, ts string, action string, actor string, detail string"


def plain(rows):
    out, expected, chain = [], audit.GENESIS, object()
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if r[0] != chain:
            chain, expected = r[0], audit.GENESIS
        _, pos, seq, prev, own, signature, ts, action, actor, detail = r
        good = own == hashlib.sha256("|".join(x for x in (str(seq), prev, ts, action, actor, detail) if x is not None).encode()).hexdigest()
        if action is None and actor is None:
            out.append((chain, pos, "json_parse_error"))
        elif not own or not prev:
            if signature is None:
                out.append((chain, pos, "legacy_signature_invalid"))
            else:
                expected = signature or expected
        elif prev != expected:
            out.append((chain, pos, "chain_broken"))
        elif not good:
            out.append((chain, pos, "payload_tampered"))
        else:
            expected = own
    return out


def records(chain, n, draw, spoil):
    rows, last, heads = [], audit.GENESIS, [audit.GENESIS]
    for pos in range(n):
        kind = draw.choice(spoil)
        prev = draw.choice(heads) if kind == "fork" else "f" * 64 if kind == "lost" else last
        fields = (str(pos), prev, "t", "act", "who", "{}")
        own = hashlib.sha256("|".join(fields).encode()).hexdigest()
        row = [chain, pos, pos, prev, own, None, "t", "act", "who", "{}"]
        if kind == "forged":
            row[9] = '{"x":1}'
        elif kind == "unread":
            row[7] = row[8] = None
        elif kind == "legacy":
            row[3], row[4], row[5] = None, None, draw.choice([None, "", last, own, "e" * 64])
        rows.append(tuple(row))
        if kind in ("good", "fork"):
            last = own
            heads.append(own)
    return rows


@pytest.mark.parametrize("segment", [3, 7, 4096])
def test_segments_settle_as_the_plain_fold_does(spark, monkeypatch, segment):
    monkeypatch.setattr(audit, "SEGMENT", segment)
    draw = random.Random(segment)
    rows = records("intact", 50, draw, ["good"]) + records("one", 1, draw, ["good"]) + records(None, 9, draw, ["good", "forged"])
    rows += records("broken", 60, draw, ["good"] * 20 + ["forged", "lost"]) + records("odd", 80, draw, ["good"] * 4 + ["fork", "unread", "legacy", "lost"])
    rows += records("forks", 40, draw, ["good", "fork"])
    got = [(r.chain, r.pos, r.reason) for r in audit.verify(spark.createDataFrame(rows, RECORD)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_no_records_have_no_faults(spark):
    assert audit.verify(spark.createDataFrame([], RECORD)).collect() == []
