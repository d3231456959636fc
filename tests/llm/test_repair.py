"""Repaired conversations against an exhaustive search for the cheapest edits."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fault = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(faults):
    """Least (cost, audit, kept roles): for every place and last role the best of
    all audits of the rest, compared as whole strings."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    n, rest = len(faults), {}
    for i in range(n, -1, -1):
        for inserts in (0, 1, 2):  # rows that may still be added here: two are enough
            for last in follows:
                best = [(0, "", ())] if i == n and last in ("", "a") else []
                for role in set(follows[last]) & {"u", "a"} if inserts else ():
                    cost, audit, kept = rest[i, role, inserts - 1]
                    best.append((cost + 2, "I" + audit, ((None, role), *kept)))
                if i < n:
                    initial, fault = faults[i]
                    cost, audit, kept = rest[i + 1, last, 2]
                    best.append((cost + 3, "D" + audit, kept))
                    more = fault == "truncated"
                    if fault in ("blank", "duplicate"):
                        pass
                    else:
                        for role, price, edit in [(initial, 0, "K"), ("u", 2, "R"), ("a", 2, "R")]:
                            if role and role in follows[last]:
                                cost, audit, kept = rest[i + 1, role, 2]
                                whose = (i, None if edit == "K" else role)
                                best.append((cost + more + price, edit + audit, (whose, *kept)))
                rest[i, last, inserts] = min(best, key=lambda b: b[:2], default=(1 << 40, "", ()))
    return rest[0, "", 2]


def by_hand(rows, ids):
    by = {c: [] for c in ids}
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role, text, turn))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, faults, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", "none"), 0)
        for _, _, role, text, _ in own:
            bare = text.strip(BLANK)
            fault = (
                "blank" if not bare else "duplicate" if (role, text) in seen
                else "none" if bare[-1] in ".!?" else "truncated"
            )
            seen.add((role, text))
            counts[fault] += 1
            faults.append((role[:1], fault))
        turns = [r[4] for r in own if r[4] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[0] + b[0] for a, b in zip(faults, faults[1:])]
        cost, audit, kept = cheapest(faults)
        names = {"u": "user", "a": "assistant"}
        lines = [
            f"{names[role]}:{own[i][3] if i is not None else ''}" if role else f"{own[i][2]}:{own[i][3]}"
            for i, role in kept
        ]
        out[conv] = (
            gaps, counts["blank"], counts["duplicate"], counts["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def rows_of():
    rng = random.Random(11)
    texts = ["Well.", "Yes!", "No?", "and then", "open ended", " ", "", " ", "é😀.", "x. \n", "so?\t"]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "sage", ""])
            rows.append((conv, turn * rng.choice([1, 1, 2]), role, rng.choice(texts) + rng.choice(["", str(turn) + "."])))
    rows += [
        (200, None, None, None), (200, None, "user", "a."), (201, None, None, None), (None, 1, "assistant", "none."),
        (None, 0, "user", "none"), (202, 5, "user", "b."), (202, 5, "assistant", "a."), (202, 5, "user", "b."),
        (203, 1, "system", "alone."),
    ]
    rows += [(204, i, ("user", "assistant")[i % 2 if i % 7 else 0], f"t{i}.") for i in range(300)]
    rows += [(205, i, "user", "again and again.") for i in range(50)]
    rows += [(206, 0, "user", "long " * 200_000), (206, 1, "assistant", "ok.")]
    return rows


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.fixture(scope="module")
def chats(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(3)
    names = ("pos", "kind", "slice", "_whose", "_fault", "copy", "fault", "initial", "cost", "_tie")
    return df.withColumns({c: F.lit(1) for c in names})


@pytest.mark.parametrize("slice_rows", [repair.SLICE_ROWS, 3])
def test_repair(chats, slice_rows):
    rows = rows_of()
    want = by_hand(damaged_by_hand(rows), {r[0] for r in rows})
    got = {
        r.conv_id: tuple(r[c] for c in COLUMNS)
        for r in repair.repair(repair.damaged(chats), slice_rows, chats).collect()
    }
    assert got == want


@pytest.mark.parametrize("slice_rows", [repair.SLICE_ROWS, 5])
def test_repaired_turns(chats, slice_rows):
    turns = repair.repaired_turns(chats, slice_rows).collect()
    by = {}
    for r in sorted(turns, key=lambda r: (r.conv_id or -1, r.place)):
        by.setdefault(r.conv_id, []).append(r)
    digests = {r.conv_id: r.repaired_sha256 for r in repair.repair(chats, slice_rows).collect()}
    for conv, own in by.items():
        assert [r.place for r in own] == list(range(len(own)))
        said = "\n".join(f"{r.role}:{r.text}" for r in own)
        assert hashlib.sha256(said.encode()).hexdigest() == digests[conv]
    silent = hashlib.sha256(b"").hexdigest()
    assert {c for c, d in digests.items() if d != silent} == set(by)


def test_all_dropped_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(empty).count() == 0
    assert repair.repaired_turns(empty).count() == 0
    some = spark.createDataFrame([(5, 0, "user", "x.")], SCHEMA)
    (row,) = repair.repair(empty, every=some).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_ranks_order_the_audits():
    """Arcs are ranked as the audits that begin with them, whole ones compared."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 12, 40)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    code = rng.integers(0, 4, starts[-1]) + 4 * rng.integers(0, 2, starts[-1]) * rng.integers(0, 2, starts[-1])
    solved = repair.Slices(code, starts, np.tile(repair._END, (40, 1)), np.ones(40, bool))
    edit, target, selected, steps, rank = solved.ranked()

    def audit(arc):
        out = ""
        while edit[arc] != repair._STOP:
            out += "DIKR"[edit[arc]]
            arc = selected[target[arc]]
        return out

    told = [audit(arc) for arc in range(len(edit))]
    order = {a: i for i, a in enumerate(sorted(set(told)))}
    assert [order[a] for a in told] == rank.tolist()
    assert 1 << len(steps) > max(map(len, told)) >= 1 << (len(steps) - 2)
