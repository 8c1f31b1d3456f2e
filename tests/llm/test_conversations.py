"""Conversation repair against plain recursion over all edits."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerline.llm import conversations as cv
from ledgerline.llm.queries import QUERIES


def damage(rows):
    """``conv_id, turn, role, text`` rows after damage, in order, by conversation."""
    out = {}
    for k, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if k is None else k}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(k, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for k in out:
        out[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def repair(rows):
    """Report of one conversation's damaged rows."""
    faults, seen = [], set()
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]

    @functools.cache
    def best(i, done, inserts):
        """``cost, audit, lines`` from row ``i`` on; ``done`` is what the initials so far come to."""
        options = []
        if i == len(rows) and done in ("", "a"):
            options.append((0, "", ()))
        nexts = {"": "u", "s": "u", "u": "a", "a": "u"}[done]
        name = {"u": "user", "a": "assistant"}[nexts]
        if inserts < 3:
            options.append((2, "I", (f"{name}:",), i, nexts, inserts + 1))
        if i < len(rows):
            _, role, text = rows[i]
            options.append((3, "D", (), i + 1, done, 0))
            if faults[i] not in ("blank", "duplicate"):
                more = int(faults[i] == "truncated")
                if role[:1] == nexts or role[:1] == "s" and done == "":
                    options.append((more, "K", (f"{role}:{text}",), i + 1, role[:1], 0))
                options.append((2 + more, "R", (f"{name}:{text}",), i + 1, nexts, 0))
        out = []
        for o in options:
            c, a, lines = best(*o[3:]) if len(o) > 3 else (0, "", ())
            out.append((o[0] + c, o[1] + a, o[2] + lines))
        return min(out) if out else (10**9, "", ())

    for i in range(len(rows), -1, -8):  # keeps the recursion shallow
        for done in ("", "s", "u", "a"):
            best(i, done, 0)
    cost, audit, lines = best(0, "", 0)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in cv.FAULTS),
            sum(a + b not in cv.LEGAL for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _found(spark, rows, tmp_path, **extra):
    schema = "conv_id long, turn int, role string, text string, `key` string, g string, at string, copy string"
    spark.createDataFrame([(*r, *"wxyz") for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_conversation_repair"](spark, str(tmp_path))
    assert got.columns == COLUMNS
    return {r["conv_id"]: tuple(r)[1:] for r in got.collect()}


def _random(rng, k, n, roles):
    texts = ["Yes.", "no", "", " ", "What? ", "a\n", None, "end!\t\n"]
    return [(k, rng.choice([None, rng.randint(0, 9), i, i]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"said {rng.random()}.") for i in range(n)]


def test_odd_conversations(spark, tmp_path):
    rng = random.Random(1)
    rows = [r for k in range(250) for r in _random(rng, k, rng.randint(1, 9), ["user", "assistant", "system", "user", "assistant", "tool", "", None])]
    rows += _random(rng, None, 7, ["user", "assistant"]) + [(900, None, None, None), (901, 3, "user", "x" * 300_000 + "."), (901, 4, "assistant", "ok.")] + [(902, 1, "user", "same.")] * 30
    got = _found(spark, rows, tmp_path)
    want = {k: repair(v) for k, v in damage(rows).items()}
    assert got == want


def test_long_conversations_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cv, "CHUNK", 4)
    monkeypatch.setattr(cv, "_BITS", 2)
    rng = random.Random(2)
    rows = []
    for k, roles in enumerate((["user", "assistant"], ["user"], ["tool"], ["system"], ["assistant", "system", "user"], ["user", "assistant", "tool"])):
        for j in range(3):
            rows += [(10 * k + j, i, rng.choice(roles), f"turn {i}" + rng.choice([".", "!", ""])) for i in range(rng.randint(20, 90))]
    rows += [(100, i, ("user", "assistant")[i % 2], f"good {i}.") for i in range(150)] + [(101, i, "user", "") for i in range(70)]
    got = _found(spark, rows, tmp_path)
    assert got == {k: repair(v) for k, v in damage(rows).items()}


def test_all_rows_gone_and_empty_table(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = _found(spark, [(gone, 0, "user", "Hi.")], tmp_path)
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert _found(spark, [], tmp_path / "none") == {}


@pytest.mark.parametrize("seed", range(3))
def test_vectors_differ_by_a_constant_where_ends_do(seed):
    rng = np.random.default_rng(seed)
    codes = rng.choice([0, 1, 2, 3, 5, 13, 14, 9, cv._NONE], (50, 12))
    ends = rng.integers(0, 5, (50, 4))
    a, b = cv.costs(codes, ends), cv.costs(codes, ends + 17)
    assert (b - a == 17).all()


def test_table(spark):
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.01").collect()}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == {k: repair(v) for k, v in damage(rows).items()}
