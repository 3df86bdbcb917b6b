"""Conversation repair against plain dynamic programming over whole edit sequences."""

import hashlib
import random
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from proseforge.llm import repair as rp


def broken(rows):
    """Rows (conv, turn, role, text) after damage."""
    out = []
    plain = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        role, text = plain(role), plain(text)
        code = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        if code == 1:
            text = ""
        elif code == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        elif code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def plain(rows):
    """(report, lines) of the (turn, role, text) rows of one conversation."""
    rows = ordered(rows)
    faults, seen = [], set()
    for _, role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    # State: role initials so far, as far as they matter.
    fits = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    full = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for c in "ua":
                    after = fits.get((state, c))
                    if after:
                        new = (cost + 2, audit + "I", [*lines, full[c] + ":"])
                        best[after] = min(best.get(after, new), new)
        return best

    best = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit, lines) in best.items():
            steps = [(state, 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                steps.append((fits.get((state, role[:1])), more, "K", [f"{role}:{text}"]))
                steps += [(fits.get((state, c)), 2 + more, "R", [f"{full[c]}:{text}"]) for c in "ua"]
            for after, c, letter, line in steps:
                if after is not None:
                    way = (cost + c, audit + letter, lines + line)
                    new[after] = min(new.get(after, way), way)
        best = inserted(new)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, int(cost), audit), lines


def conversations(seed):
    draw = random.Random(seed)
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system"] * 2 + ["tool", "", None]
    texts = ["One.", "Two!", "three", " \n", "", None, "Four? \t", "Fünf。", "."]
    rows = []
    for conv in range(120):
        n = draw.choice([1, 2, 3, 5, 8, 12])
        turns = [draw.choice([None, draw.randrange(-3, 12)]) if draw.random() < 0.1 else t * draw.choice([1, 1, 1, 2]) for t in range(n)]
        rows += [(conv, t, draw.choice(roles), draw.choice(texts) if draw.random() < 0.7 else f"row {draw.randrange(10**6)}.") for t in turns]
    rows += [(None, t, "user", "null conversation.") for t in (1, 2, None)] + [(500, None, "user", "a."), (500, None, "assistant", "b.")]
    draw.shuffle(rows)
    return rows


def grouped(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault("none" if conv is None else f"c:{conv}", []).append(tuple(rest))
    return out


@pytest.mark.parametrize("block", [1, 2, 5, 256])
def test_against_plain_search(spark, block):
    rows = broken(conversations(3)) if block == 5 else [tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)) for r in conversations(block)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "place": F.lit("x"), "a.b": F.lit(2)})
    report, repaired = rp.repair(df, block=block)
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.key, r.place)):
        lines.setdefault(r.key, []).append(f"{r.role}:{r.text}")
    got = {r.key: (tuple(r)[1:], lines.get(r.key, [])) for r in report.collect()}
    want = {k: plain(v) for k, v in grouped(rows).items()}
    assert got == want
    digests = {r.key: r.sha256 for r in rp.digests(repaired).collect()}
    assert digests == {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, (_, v) in want.items() if v}


def test_damage_is_the_stated_one(spark):
    rows = conversations(9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("code", F.lit(1))
    got = rp.damage(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, broken(rows)))
    assert len({zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, _, _ in rows} & set(range(5))) == 5


def test_long_conversation_and_tables_without_rows(spark):
    draw = random.Random(4)
    rows = [(t, draw.choice(["user", "assistant"]), f"text {t}" + draw.choice([".", ".", ""])) for t in range(3_000)]
    rows += [(3_000, "assistant", "x" * 300_000)] * 2
    df = spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn long, role string, text string")
    report, repaired = rp.repair(df)
    want, lines = plain(rows)
    assert tuple(report.collect()[0])[1:] == want
    assert rp.digests(repaired).collect()[0].sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    report, repaired = rp.repair(df.limit(0))
    assert report.count() == repaired.count() == rp.digests(repaired).count() == 0


def test_agenda_on_sums_of_two():
    """Items 1 to 9, each a leaf with a weight or two smaller ones; every split is tried beside the agenda."""
    draw = random.Random(1)
    for _ in range(50):
        leaf = {n: (draw.randrange(1, 12), draw.choice("xyz")) for n in range(1, 10)}
        edges = lambda item: ((a + b, (a, b)) for a, b in product(range(1, 10), repeat=2) if a + b < 10 and item in (a, b))
        got = rp.lightest([(w, n) for n, w in leaf.items()], edges, set(leaf))
        want = {}
        for n in range(1, 10):
            ways = [(want[a][0] + want[n - a][0], want[a][1] + want[n - a][1]) for a in range(1, n)]
            want[n] = min([leaf[n], *ways])
        assert {n: w[0] for n, w in got.items()} == {n: w[0] for n, w in want.items()}


def test_goal_ends_the_agenda():
    seen = []
    rp.lightest([((1, "a"), "near"), ((9, "b"), "far")], lambda x: seen.append(x) or [], {"near"})
    assert seen == ["near"] or seen == []


def test_query_against_brute_force_of_every_conversation(spark, sf):
    from proseforge.llm.queries import op13_conversation_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after, got = grouped(broken(rows)), op13_conversation_repair(spark, sf).collect()
    assert {r.conv_id for r in got} == {r[0] for r in rows} and len(got) == len({r[0] for r in rows})
    for r in got:
        want, lines = plain(after[f"c:{r.conv_id}"]) if f"c:{r.conv_id}" in after else ((0, 0, 0, 0, 0, 0, ""), [])
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
