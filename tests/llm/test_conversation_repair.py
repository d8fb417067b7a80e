"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from promptloom.llm import conversation_repair
from promptloom.llm.conversation_repair import Stacks, damaged, digests, repair

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def brute_repair(rows):
    """rows: (role, text, fault), in order.  Cheapest edits by search over (rows read, state)."""
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, i, state, out = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
        for letter, role in (("u", "user"), ("a", "assistant")):
            if (state, letter) in NEXT:
                heapq.heappush(queue, (cost + 3, audit + "I", i, NEXT[state, letter], (*out, role + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state, out))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if (state, role[:1]) in NEXT:
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, NEXT[state, role[:1]], (*out, f"{role}:{text}")))
            for letter, new in (("u", "user"), ("a", "assistant")):
                if (state, letter) in NEXT:
                    heapq.heappush(queue, (cost + 3 + more, audit + "R", i + 1, NEXT[state, letter], (*out, f"{new}:{text}")))


def brute(table, damage=True):
    conversations = defaultdict(list)
    for conv, turn, role, text in table:
        rows = conversations[conv]
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        if c == 0:
            continue
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        rows += [(turn, "user" if c == 4 else role, text)] * (2 if c == 3 else 1)
    out = {}
    for conv, rows in conversations.items():
        rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, sha = brute_repair([(r, t, f) for (_, r, t), f in zip(rows, faults)])
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def table(seed, n):
    r = random.Random(seed)
    texts = ["Hello.", "Why?", "cut off", "", " \n", "Yes!", "More text.\n", None, "odd\x0b", "é."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ua"]
    rows = []
    for conv in [*range(n), None]:
        turns = list(range(r.randint(1, 9)))
        for t in turns:
            if r.random() < 0.1:
                continue
            role = ("user", "assistant")[t % 2] if r.random() < 0.6 else r.choice(roles)
            rows.append((conv, None if r.random() < 0.05 else t + (r.random() < 0.1), role, r.choice(texts) if r.random() < 0.6 else f"text {r.randint(0, 40)}."))
    rows += [rows[3]] * 4
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "x", 1) for x in rows], "conv_id long, turn long, role string, text string, part string, edits int")


def results(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("piece", [1024, 2])
def test_against_search(spark, monkeypatch, piece):
    monkeypatch.setattr(conversation_repair, "PIECE", piece)
    rows = table(1, 120)
    got = digests(repair(damaged(frame(spark, rows).repartition(4))))
    assert results(got) == brute(rows) and got.count() == len(brute(rows))


def test_undamaged_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "PIECE", 3)
    rows = table(2, 30)
    repairs = repair(frame(spark, rows))
    assert results(digests(repairs)) == brute(rows, damage=False)
    blocks = defaultdict(dict)
    for r in repairs.collect():
        blocks[r["conv_id"]][r["block"]] = r
    assert any(len(b) > 1 for b in blocks.values())
    for conv, b in blocks.items():
        edits = [e for k in sorted(b) for e in b[k]["edits"]]
        assert sorted(b) == list(range(b[0]["blocks"]))
        initials = "".join(e["role"][:1] for e in edits if e["action"] != "D")
        assert re.fullmatch("(s?(ua)+)?", initials)
        given = sorted((t is not None, t or 0) for c, t, _, _ in rows if c == conv)
        assert [(e["turn"] is not None, e["turn"] or 0) for e in edits if e["action"] != "I"] == given


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "PIECE", 16)
    r = random.Random(3)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", f"{t}."])) for t in range(700) if r.random() < 0.9]
    rows += [(7, None, "user", "a."), (8, 0, "user", "x"), (6, 1, None, "Long. " * 200_000)]
    assert results(digests(repair(damaged(frame(spark, rows))))) == brute(rows)


def test_all_rows_lost_and_no_rows(spark):
    lost = [(c, t, "user", "x.") for c in range(200) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert lost and results(digests(repair(damaged(frame(spark, lost))))) == {x[0]: empty for x in lost}
    assert digests(repair(damaged(frame(spark, [])))).collect() == []


def test_stacks_merge():
    """However many rows are read, at most five stacks are left."""
    s = Stacks()
    tops = s.insertions(s.run("suxa-UAsuua" * 5, {0: (0, "")}))
    assert len(tops) <= 5 and len(s.nodes) < 20
