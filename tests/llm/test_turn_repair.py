"""Operator 13 against an exhaustive search over all edits, on damaged and odd conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

SHAPE = "conv_id long, turn long, role string, text string, g long, part int, audit string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired lines) over every choice of an edit a row and of up to two inserted turns in each gap."""
    best = None
    gap = ["", "u", "a", "ua", "au"]
    edits = [["D"] if fault in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for _, _, fault in rows]
    for chosen in itertools.product(*edits):
        kept = [(role if e == "K" else {"u": "user", "a": "assistant"}[e[1]], text) for (role, text, _), e in zip(rows, chosen, strict=True) if e != "D"]
        base = sum({"D": 3, "K": 0, "R": 2}[e[0]] + (e != "D" and f == "truncated") for e, (_, _, f) in zip(chosen, rows, strict=True))
        if best and base > best[0]:
            continue
        slots = len(rows) + 1
        for given in itertools.product(gap, repeat=slots):
            cost = base + 2 * sum(map(len, given))
            if best and cost > best[0]:
                continue
            audit, lines, initials = "", [], ""
            it = iter(kept)
            for k in range(slots):
                for one in given[k]:
                    audit += "I"
                    initials += one
                    lines.append({"u": "user:", "a": "assistant:"}[one])
                if k < len(rows):
                    audit += chosen[k][0]
                    if chosen[k] != "D":
                        role, text = next(it)
                        initials += role[:1] or "?"
                        lines.append(f"{role}:{text}")
            if GRAMMAR.match(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def by_hand(given, all_convs, search=cheapest):
    out = []
    for conv in all_convs:
        rows = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in given if c == conv]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            cut = text.strip(WHITE)
            faults.append("blank" if not cut else "duplicate" if (role, text) in seen else "truncated" if cut[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = search([(r, x, f) for (_, r, x), f in zip(rows, faults, strict=True)])
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], SHAPE).repartition(3)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(n, longest, seed):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            if rng.random() < 0.15:
                role = rng.choice(["system", "tool", "User", None, ""])
            rows.append((c, rng.choice([t, t, t, t + 1, None]), role, rng.choice(["Yes.", "No!", "cut off", " ", None, f"Turn {t}?", "é日\n.", "x. \t"])))
    return rows


@pytest.mark.parametrize("segment", [512, 2])
def test_against_all_edits(spark, monkeypatch, segment):
    from termloom.llm import turn_repair

    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    rows = conversations(36, 4, 1) + [(None, 1, "user", "A."), (None, 0, "system", "B."), (900, 3, "assistant", "X." * 50_000), (900, 2, "user", "Y" * 100_000), (901, 5, "user", "Same."), (901, 5, "user", "Same.")]
    assert collected(turn_repair.repair(frame(spark, rows))) == by_hand(rows, {r[0] for r in rows})


def search_by_turn(rows):
    """The same by dynamic programming with whole audits, written apart from the operator; for long conversations."""
    following = {"": "u", "s": "u", "u": "a", "a": "u"}

    def with_inserts(ways):
        out = {}
        for s, (c, a, lines) in ways:
            for n in range(3):
                if s not in out or (c, a) < out[s][:2]:
                    out[s] = (c, a, lines)
                s = following[s]
                c, a, lines = c + 2, a + "I", (lines, {"u": "user:", "a": "assistant:"}[s])
        return out

    state = with_inserts([("", (0, "", None))])
    for role, text, fault in rows:
        ways, more = [], fault == "truncated"
        for s, (c, a, lines) in state.items():
            ways.append((s, (c + 3, a + "D", lines)))
            if fault not in ("blank", "duplicate"):
                ways.append((following[s], (c + 2 + more, a + "R", (lines, {"u": "user", "a": "assistant"}[following[s]] + ":" + text))))
                if role[:1] == following[s] or (role[:1] == "s" and s == ""):
                    ways.append((role[:1], (c + more, a + "K", (lines, f"{role}:{text}"))))
        state = with_inserts(ways)
    cost, audit, chain = min((state[s] for s in ("", "a") if s in state), key=lambda w: w[:2])
    lines = []
    while chain:
        chain, line = chain
        lines.append(line)
    return cost, audit, lines[::-1]


def test_long_conversations_fall_into_segments(spark, monkeypatch):
    from termloom.llm import turn_repair

    monkeypatch.setattr(turn_repair, "SEGMENT", 64)
    rows = conversations(3, 3, 2) + [(50 + c % 2, t, r, x) for c, (_, t, r, x) in enumerate(conversations(900, 3, 3))]
    assert collected(turn_repair.repair(frame(spark, rows))) == by_hand(rows, {r[0] for r in rows}, search_by_turn)


def test_damage_and_lost_conversations(spark):
    from termloom.llm import turn_repair

    given = [(c, t, r, x) for c, t, r, x in conversations(60, 4, 4) if t is not None or c % 3 == 0]
    damaged = []
    for c, t, r, x in given:
        k = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        damaged += [] if k == 0 else [(c, t, r, "")] if k == 1 else [(c, t, r, re.sub("[.!?]", "", x))] if k == 2 else [(c, t, r, x)] * 2 if k == 3 else [(c, t, "user", x)] if k == 4 else [(c, t, r, x)]
    df = frame(spark, given)
    assert collected(turn_repair.repair(turn_repair.damage(df), df)) == by_hand(damaged, {g[0] for g in given}, search_by_turn)
    none = turn_repair.repair(frame(spark, given).limit(0), frame(spark, [(7, 1, "user", "x")]))
    assert collected(none) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert turn_repair.repair(frame(spark, []), frame(spark, [])).count() == 0
