"""Filter interactions and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from provena.llm import lattice, queries, turns


def failed(rows, at):
    i, text, _ = rows[at]
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    out = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
    out += "D" * bool(re.search("[#$%&*|]", text))
    return out + "E" * any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows)


def test_filter_audit_matches_brute_force(spark):
    draw = random.Random(5)
    say = lambda n, k: " ".join(draw.choice([f"wé{i}" for i in range(k)]) for _ in range(n))
    texts = [None, "", "  \t ", "SHOUT " * 60, "a" * 20_000, say(60, 3), say(70, 1000), say(70, 1000) + " #", say(10, 100) + "|", "CAPS and\x0bblanks kept", say(20_000, 30)]
    rows = [(n, draw.choice(texts), draw.choice(["s1", "s2", None, "S1"])) for n in range(120)]
    rows += [(5, rows[5][1], "s1"), rows[7], (None, "", "s2"), (None, texts[6], None), (3, texts[5], "s2")] + [(1000 + n, "same text", "hot") for n in range(60)]
    labels = [(n, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for n in range(100)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5000, 1, 1)]
    docs = spark.createDataFrame([(i, t, s, "clash", 1, "x") for i, t, s in rows], "doc_id long, text string, source string, part string, n long, key string")
    got = lattice.audit(docs, spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string")).collect()
    sets = [(s or "", failed(rows, k), any(x == i and q == 1 for x, q, _ in labels if i is not None), any(x == i and t == 1 for x, _, t in labels if i is not None)) for k, (i, _, s) in enumerate(rows)]
    want, shapley = {}, Counter()
    for part in {s[0] for s in sets}:
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                own = [s for s in sets if s[0] == part]
                before = [s for s in own if not set(s[1]) & set(order[:k])]
                gone = [s for s in before if f in s[1]]
                want[part, "".join(order), k + 1] = (
                    len(before) - len(gone), len(gone), sum(f in s[1] for s in own) - len(gone), sum(s[1] == f for s in own), sum(s[2] for s in gone), sum(s[3] for s in gone),
                )
                shapley[part, f] += len(gone)
    assert len(got) == len(want) == 600 * len({s[0] for s in sets})
    for r in got:
        assert want[r.part, r.filter_order, r.step] == (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost)
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]


def test_filter_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert lattice.audit(docs.limit(0), labels).collect() == []
    assert {(r.kept, r.removed) for r in lattice.audit(docs, labels).where("filter_order = 'BACDE'").collect()} == {(1, 0), (0, 1), (0, 0)}


def damaged(rows):
    """Rows after damage, by conversation and in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest())) for c, r in out.items()}


def best_edits(rows):
    """(cost, audit, repaired lines) by search from the end: what the rest costs in each state of the pattern."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    rest = [{} for _ in range(len(rows) + 1)]
    for at in range(len(rows), -1, -1):
        own = {}
        for state in after:
            ways = [(0, "", ())] if at == len(rows) and state in ("", "a") else []
            if at < len(rows):
                fault, role, text = rows[at]
                c, a, out = rest[at + 1].get(state, (10**9, "", ()))
                ways.append((c + 2, "D" + a, out))
                if fault not in ("blank", "duplicate"):
                    extra = 5 if fault == "truncated" else 0
                    for letter, new in [("K", role)] + [("R", x) for x in ("user", "assistant")]:
                        if new[:1] and new[:1] in after[state]:
                            c, a, out = rest[at + 1].get(new[:1], (10**9, "", ()))
                            ways.append((c + extra + (letter == "R"), letter + a, (f"{new}:{text}", *out)))
            own[state] = min(ways, default=(10**9, "", ()))
        for _ in range(3):  # rows put in here
            for state in after:
                for new in ("user", "assistant"):
                    if new[0] in after[state]:
                        c, a, out = own[new[0]]
                        own[state] = min(own[state], (c + 5, "I" + a, (f"{new}:", *out)))
        rest[at] = own
    return rest[0][""]


def repaired(rows):
    seen, flagged = set(), []
    for _, role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        flagged.append(("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "", role, text))
        seen.add((role, text))
    known = [t for t, _, _ in rows if t is not None]
    counts = Counter(f for f, _, _ in flagged)
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(flagged, flagged[1:], strict=False))
    cost, audit, lines = best_edits(flagged)
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(n, longest, seed):
    draw = random.Random(seed)
    texts = ["Yes.", "no", "Why? ", "\t \x0b", "", None, "é!", "x" * 30_000 + ".", "Bien.\u2028"]
    roles = ["user", "assistant"] * 4 + ["system", "tool", None, "", "User", "agent"]
    rows = []
    for conv in range(n):
        for turn in range(draw.randint(1, longest)):
            usual = ["system", "user", "assistant", "user", "assistant"][turn] if turn < 5 and conv % 3 else draw.choice(roles)
            rows.append((conv, draw.choice([turn, turn, turn, turn * 2, None, 0]), usual, draw.choice(texts) if draw.random() < 0.5 else f"Turn {turn} of {conv}."))
    return rows + rows[:7]


@pytest.mark.parametrize(("segment", "fan", "longest"), [(256, 16, 9), (2, 2, 14), (3, 16, 12)])
def test_repair_matches_brute_force(spark, monkeypatch, segment, fan, longest):
    monkeypatch.setattr(turns, "SEGMENT", segment)
    monkeypatch.setattr(turns, "FAN", fan)
    rows = conversations(60, longest, segment) + [(None, 1, "user", "Lost?"), (None, None, "assistant", "Found.")]
    alone = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((alone, 0, "user", "dropped"))
    frame = spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id long, turn long, role string, text string, audit string, seq int")
    got = {r.conv_id: tuple(r)[1:] for r in turns.damage_and_repair(frame).collect()}
    want = {c: repaired(r) for c, r in damaged(rows).items()}
    want |= {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows} - set(want)}
    assert got == want


def test_repair_of_a_long_conversation(spark):
    rows = conversations(1, 1, 1) + [(7, t, ["user", "assistant", "system", "assistant"][t * t % 4], "Same." if t % 3 else f"Text {t}") for t in range(1500)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in turns.damage_and_repair(frame).collect()}
    assert got == {c: repaired(r) for c, r in damaged(rows).items()}


def test_repair_gives_the_edited_rows(spark):
    rows = [("a", 1, "user", "One."), ("a", 2, "user", "Two"), ("a", 3, "assistant", "Three!"), ("b", 1, "system", "Be."), ("b", 2, "tool", "Go.")]
    audits, edited = turns.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    assert {r.conv_id: (r.cost, r.audit) for r in audits.collect()} == {"a": (2, "KDK"), "b": (2, "RR")}
    assert [tuple(r)[2:] for r in edited.where("conv_id = 'b'").orderBy("nth").collect()] == [("R", "user", "Be."), ("R", "assistant", "Go.")]
    own = spark.createDataFrame([("a", "KDK"), ("b", "KRI")], "conv_id string, audit string")  # any audit can be applied
    edited = turns.repaired(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"), own)
    assert [tuple(r)[2:] for r in edited.where("conv_id = 'b'").orderBy("nth").collect()] == [("K", "system", "Be."), ("R", "user", "Go."), ("I", "assistant", "")]
    assert [r.edit for r in edited.where("conv_id = 'a' AND role IS NULL").collect()] == ["D"]


def test_repair_of_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.damage_and_repair(none).collect() == []
    assert set(queries.oracle_sql()) >= {"op12_turns", "op13_lattice"}
