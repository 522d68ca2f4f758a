"""Conversation repair, filter audit and SimHash on small and odd inputs, against plain versions."""
import hashlib
import heapq
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paytide.llm import conversations, filter_audit, simhash

# ---- conversation repair ---------------------------------------------------------------------------


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(turns):
    """(cost, audit, repaired) of (role, text) turns: the least (cost, audit) of all paths, by shortest paths."""
    seen, fault = set(), []
    for role, text in turns:
        bare = text.strip(" \t\n\r\x0b\x0c")
        fault.append("gone" if not bare or (role, text) in seen else "cut" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, shape, made = heapq.heappop(heap)
        state = {"": 0, "s": 1}.get(shape, 2 if shape.endswith("u") else 3)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in (0, 3):
            return cost, audit, list(made)

        def go(add, letter, j, role, text):
            initial = role[:1]
            if (initial == "s" and shape == "") or (initial == "u" and shape[-1:] != "u") or (initial == "a" and shape[-1:] == "u"):
                heapq.heappush(heap, (cost + add, audit + letter, j, shape[-1:] + initial if shape else initial, (*made, f"{role}:{text}")))

        for role in ("user", "assistant"):
            go(3, "I", i, role, "")
        if i < len(turns):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, shape, made))
            if fault[i] != "gone":
                extra = 3 if fault[i] == "cut" else 0
                go(extra, "K", i + 1, *turns[i])
                for role in ("user", "assistant"):
                    go(3 + extra, "R", i + 1, role, turns[i][1])


def some_conversations(seed, n, longest=9):
    pick = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(pick.randint(1, longest)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = pick.choice(["Yes.", "No!", "what", "ends here. ", " \n", "", None, f"t{turn}.", "a?b"])
            rows.append((conv if conv else None, pick.choice([turn, turn, turn * 3, None]), role, text))
    return rows


def expected(rows):
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in plain_damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        cost, audit, made = plain_repair([r[2:] for r in turns])
        want[conv] = cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()
    return want


def odd_conversations(spark, seed=1, n=60):
    rows = some_conversations(seed, n)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return rows, df.withColumns({c: F.lit("x") for c in ("audit", "k", "i", "segment", "letters", "fault")})


@pytest.mark.parametrize("sizes", [{}, {"most_rows": 0, "segment": 2}, {"most_rows": 5, "segment": 3}, {"most_bytes": 10}])
def test_repair_equals_shortest_paths(spark, sizes):
    rows, df = odd_conversations(spark)
    got = {r["conv_id"]: r for r in conversations.repair(conversations.damage(df), **sizes).collect()}
    want = expected(rows)
    assert {k: (r["cost"], r["audit"], r["repaired_sha256"]) for k, r in got.items()} == want
    if sizes:  # the counts do not depend on the path
        plain = {r["conv_id"]: r for r in conversations.repair(conversations.damage(df)).collect()}
        assert got == plain
    turns = conversations.repaired_turns(conversations.damage(df), **sizes).collect()
    for conv, (_, _, digest) in want.items():
        mine = sorted((r for r in turns if r["conv_id"] == conv), key=lambda r: r["at"])
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest() == digest


def test_checkpoints_of_long_conversations():
    pick = random.Random(5)
    codes = [(pick.choice(["s", "u", "a", ""]), pick.random() < 0.1, pick.random() < 0.1) for _ in range(3000)]
    cost, edits, state = conversations.walk(codes)
    vectors = [conversations.END]
    for code in reversed(codes):
        vectors.append(conversations.before(vectors[-1], code))
    assert cost == vectors[-1][0]
    spent, at = 0, 0
    for letters, code in zip(edits, codes, strict=True):
        for letter in letters:
            if letter == "I":
                spent, at = spent + 3, conversations.NEW[at]
            else:
                _, price, at = next(m for m in conversations.moves(code, at) if m[0] == letter)
                spent += price
    assert spent + 3 * len(conversations.last_insertions(state)) == cost and at == state


def test_repair_of_no_rows_and_of_clean_conversations(spark):
    _, df = odd_conversations(spark, n=2)
    assert conversations.repair(df.limit(0)).count() == 0
    clean = [(1, t, "ua"[t % 2] + "x", f"turn {t}.") for t in range(400)] + [(2, 0, None, "w " * 200_000 + ".")]
    got = {r["conv_id"]: r for r in conversations.repair(spark.createDataFrame(clean, "conv_id long, turn long, role string, text string"), most_rows=100, segment=64).collect()}
    assert got[1]["audit"] == "K" * 400 and got[1]["cost"] == 0 and got[1]["illegal"] == 0
    assert got[2]["audit"] == "D" and got[2]["cost"] == 4
    none = spark.createDataFrame([(1, 0, "user", "x.", 0)], "conv_id long, turn long, role string, text string, copies int")
    for rows in (20_000, 0, -1):
        row = conversations.repair(none, most_rows=rows).first()
        assert row["audit"] == "" and row["cost"] == row["gaps"] == 0 and row["repaired_sha256"] == hashlib.sha256().hexdigest()


# ---- filter audit ----------------------------------------------------------------------------------


def plain_audit(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    rows = []
    for i, t, part in docs:
        t = t or ""
        ws = t.encode().split()
        rows.append((i, part or "", {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                                     "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}))
    out = {}
    shapley = Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for _, p, _ in rows}:
            left = [r for r in rows if r[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [r for r in left if r[2][f]]
                left = [r for r in left if not r[2][f]]
                shapley[part, f] += len(now)
                out[part, order, step] = [len(left), len(now), sum(r[2][f] for r in gone), sum(r[2][f] and sum(r[2].values()) == 1 for r in rows if r[1] == part),
                                          sum(r[0] in good for r in now), sum(r[0] in toxic for r in now)]
                gone += now
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_equals_plain_version(spark):
    pick = random.Random(3)
    texts = [" ".join(f"w{pick.randint(0, 400)}" for _ in range(130)), "Same WORDS " * 70, "few words", "one # two " * 60, "", None, "x" * 300_000,
             " ".join(f"W{i}" for i in range(120)), "  no-break É " * 40]
    docs = [(pick.choice([i, i, i // 2, None]), pick.choice(texts), pick.choice(["en", "de", "", None])) for i in range(150)]
    labels = [(i, pick.choice([0, 1, None]), pick.choice([0, 1, None])) for i in range(0, 150, 3)] * 2 + [(4, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("mask", "digest", "part", "n", "id", "t")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in filter_audit.audit(df, marks).collect()}
    assert got == plain_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), marks).count() == 0
    assert filter_audit.audit(df, marks.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


# ---- SimHash ---------------------------------------------------------------------------------------


def plain_fingerprint(text):
    ws = (text or "").encode().lower().split()
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(len(ws) - 2, 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    """Smallest member of each value's component at 3 bits or fewer."""
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(values[i] ^ values[:i]) <= 3)
        for j in near:
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("sizes", [{}, {"groups": 8}, {"groups": 5, "limit": 8}])
def test_simhash_links_equal_all_pairs(spark, sizes):
    pick = random.Random(7)
    values = {pick.getrandbits(64) for _ in range(300)}
    for centre in (0, (1 << 64) - 1, pick.getrandbits(64)):
        near = {centre}
        while len(near) < 250:  # a cloud of variants, and a chain through it
            near.add(pick.choice(sorted(near)) ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)))
        values |= near
    values = np.array(sorted(values), dtype=np.uint64)
    points = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "f long")
    links = [(int(np.int64(a).view(np.uint64)), int(np.int64(b).view(np.uint64))) for a, b in simhash.links(points, **sizes).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    up = {int(v): int(v) for v in values}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    want = plain_components(values)
    assert [root(int(v)) for v in values] == [int(values[i]) for i in want]


def test_flips_equal_all_pairs():
    pick = random.Random(2)
    values = np.array(sorted({pick.getrandbits(14) << 20 for _ in range(400)}), dtype=np.uint64)
    for found in (simhash.linked_by_flips(values), simhash.linked_in_runs(np.zeros(len(values), np.int64), values)):
        up = {int(v): int(v) for v in values}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in found:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
        assert [root(int(v)) for v in values] == [int(values[i]) for i in plain_components(values)]


def test_near_duplicates_of_odd_texts(spark, monkeypatch):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [(1, base), (2, base + " End"), (3, base.upper()), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "One  TWO"), (9, "w " * 200_000),
             (None, base), (None, "alone in the dark"), (10, "first face of ten"), (10, "second face of the ten"), (11, "second face of the ten"), (3, base), (12, "İstanbul É x y z")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("fingerprint", "f", "n", "id", "least", "component_id")})
    prints = np.array([plain_fingerprint(t) for _, t in texts], dtype=np.uint64)
    group = plain_components(prints)
    ids = [i for i, _ in texts]
    for a, i in enumerate(ids):  # rows of one id are one document
        for b in range(a):
            if i is not None and ids[b] == i:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    least = {g: min((i for i, h in zip(ids, group) if h == g and i is not None), default=None) for g in set(group)}
    want = Counter((i, f"{int(f):016x}", least[g]) for i, f, g in zip(ids, prints, group))
    assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
    monkeypatch.setattr(simhash, "HOT_ROWS", 1)
    assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_embedding_bounds_the_distance(spark):
    pick = random.Random(4)
    values = np.array([pick.getrandbits(64) for _ in range(200)], dtype=np.uint64)
    native = [r[0] for r in spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "f long").select(simhash.embedding(F.col("f"))).collect()]
    assert native == simhash.embedded(values).view(np.int64).tolist()
    for a, b in itertools.combinations(values.tolist()[:40], 2):
        counts = [[(x >> 2 * i & 3).bit_count() for i in range(32)] for x in (a, b)]
        manhattan = sum(abs(p - q) for p, q in zip(*counts))
        u, v = simhash.embedded(np.array([a, b], dtype=np.uint64))
        assert int(np.bitwise_count(u ^ v)) == manhattan <= (a ^ b).bit_count()
