"""Conversation repair against brute force: every edit of short conversations, a dynamic program of long ones."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from lumenframe.llm import conversation_repair as cr

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for row in rows:
        c, t, r, x = (" " if v is None else v for v in row)
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        if k:
            out += [(row[0], row[1], "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults_of(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        m = VISIBLE.findall(x)
        out.append("blank" if not m else "duplicate" if (r, x) in seen else "truncated" if m[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def summary(rows, best):
    turns, faults, initials = {t for _, t, _, _ in rows if t is not None}, faults_of(rows), [r[:1] for _, _, r, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit, kept = best(rows, faults)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest())


def every_edit(rows, faults):
    """The best of all edits with up to two insertions in each gap."""
    gaps = [()] + [(a,) for a in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    best = None
    for edits in itertools.product(*[("D",) if f in ("blank", "duplicate") else ("K", "user", "assistant", "D") for f in faults]):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, kept = 0, "", []
            for i, added in enumerate(ins):
                cost, audit, kept = cost + 2 * len(added), audit + "I" * len(added), kept + [(r, "") for r in added]
                if i < len(rows):
                    e, (_, _, role, text) = edits[i], rows[i]
                    cost += 3 if e == "D" else (0 if e == "K" else 2) + (faults[i] == "truncated")
                    audit += e if e in "DK" else "R"
                    kept = kept if e == "D" else [*kept, (role if e == "K" else e, text)]
            if all(r for r, _ in kept) and LEGAL.fullmatch("".join(r[0] for r, _ in kept)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, kept)
    return best


STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def program(rows, faults):
    def put(v, s, z):
        if s not in v or z[:2] < v[s][:2]:
            v[s] = z

    def insertions(v):
        for _ in range(3):
            for s, (c, a, kept) in list(v.items()):
                for r in ("user", "assistant"):
                    if (s, r[0]) in STEPS:
                        put(v, STEPS[s, r[0]], (c + 2, a + "I", (kept, r, "")))

    now = {0: (0, "", None)}
    for (_, _, role, text), f in zip(rows, faults, strict=True):
        insertions(now)
        after = {}
        for s, (c, a, kept) in now.items():
            put(after, s, (c + 3, a + "D", kept))
            if f not in ("blank", "duplicate"):
                for e, r, more in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if (s, r[:1]) in STEPS:
                        put(after, STEPS[s, r[:1]], (c + more + (f == "truncated"), a + e, (kept, r, text)))
        now = after
    insertions(now)
    cost, audit, kept = min((now[s] for s in (0, 3) if s in now), key=lambda z: z[:2])
    out = []
    while kept:
        kept, *row = kept
        out.append(tuple(row))
    return cost, audit, out[::-1]


def by_hand(rows, best=program, hurt=damaged):
    return sorted(((c, *summary(hurt([r for r in rows if r[0] == c]), best)) for c in {r[0] for r in rows}), key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select(COLUMNS).collect()), key=repr)


def frame(spark, rows, kind="long"):
    rows = [(*r, "clash", 1, "x") for r in rows]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string, node string, head int, n string").repartition(3)


def conversations(seed=3, most=9):
    rng, out = random.Random(seed), []
    texts = ["Yes.", "No!", "why", "what? ", "", " \n", "é…", "a.b", "Yes.\t", "ok\x0b.", "x" * 50, None, "\x1c"]
    roles = ["user", "assistant", "system", "tool", None, "User", "u", "a", "", "s"]
    for c in range(60):
        turns = sorted(rng.choice([None, *range(-2, 12)]) or 0 if rng.random() < 0.9 else 0 for _ in range(rng.randint(1, most)))
        for t in turns:
            out.append((c, None if rng.random() < 0.1 else t, rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts)))
    return out + [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 1, "user", "Hi.")]


def test_query_equals_brute_force(spark):
    rows = conversations()
    assert got(cr.repair(cr.damage(frame(spark, rows)))[0]) == by_hand(rows)


def test_every_edit_of_short_conversations(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["A.", "b", "", "A."])) for c in range(70) for t in range(rng.randint(1, 3))]
    plain = lambda r: sorted(r, key=lambda x: (x[1], x[2], x[3]))
    assert by_hand(rows, every_edit, plain) == by_hand(rows, program, plain) == got(cr.repair(frame(spark, rows))[0])


def test_long_conversations_over_many_leaves(spark):
    """Two leaves a round at most, so that the tree is deep; one conversation holds most rows, many of them equal."""
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["A.", "b", f"{t}!", f"{t}", "", "So."])) for t in range(900)]
    rows += [(7, 5, "user", "A.")] * 40 + [(8, None, "user", "A.")] * 30 + [(9, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(60)]
    hurt = cr.damage(frame(spark, rows))
    assert cr.ordered_leaves(hurt, 4).groupBy("conv_id").count().where("count > 50").count() == 1
    out, lines = cr.repair(hurt, leaf_rows=4, fan=1)
    assert got(out) == by_hand(rows)
    text = "\n".join(r.lines for r in lines.where("conv_id = 9 AND lines IS NOT NULL").orderBy("node").collect())
    assert hashlib.sha256(text.encode()).hexdigest() == next(r[-1] for r in by_hand(rows) if r[0] == 9)


def test_product_is_associative():
    rng = random.Random(2)
    kinds = [cr.living_row(i, c) for i in ("s", "u", "a", "") for c in (False, True)] + [cr.dead_rows(n) for n in (1, 2, 5)] + [cr.ONE, cr.INSERTIONS]
    for _ in range(300):
        a, b, c = (cr.times(rng.choice(kinds), rng.choice(kinds)) for _ in range(3))
        assert cr.times(cr.times(a, b), c) == cr.times(a, cr.times(b, c))
    power = cr.dead_rows(1)
    for n in range(2, 6):
        power = cr.times(power, cr.dead_rows(1))
        assert power == cr.dead_rows(n)


def test_all_rows_dropped(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    out = got(cr.repair(cr.damage(frame(spark, [(dropped, 0, "user", "Hi.")])))[0])
    assert out == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_string_ids_and_empty_table(spark):
    rows = [(None if c is None else f"c{c}", t, r, x) for c, t, r, x in conversations(4)]
    assert got(cr.repair(cr.damage(frame(spark, rows, "string")))[0]) == by_hand(rows)
    assert got(cr.repair(cr.damage(frame(spark, [])))[0]) == []


def test_sql(spark):
    con, rows = duckdb.connect(), conversations(5)
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r for r in rows])
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({cr.SQL})").fetchall(), key=repr) == by_hand(rows)
    d = "/root/testdata/sf0.001"
    con.execute(f"CREATE OR REPLACE VIEW v AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({cr.SQL.replace('FROM conversations', 'FROM v')})").fetchall()
    assert got(cr.query(spark, d)) == sorted(want, key=repr)
