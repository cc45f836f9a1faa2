"""Operators 11 to 13: mixing sources, the prefix trie of conversations and their repair, against SQL and brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from daftar.llm import mixing, prefix_trie, queries, repair
from daftar.llm.shared import running
from tests.conftest import SF, same_rows

TURNS = "conv_id long, turn long, role string, text string, depth int, seg long, before string"
EMPTY = hashlib.sha256(b"").hexdigest()
repair_pattern = re.compile("(s?(ua)+)?")


def turns(spark, rows):
    """Conversations with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, 7, 8, "x") for r in rows], TURNS)


@pytest.mark.parametrize("name", ["op11_source_mixing", "op12_prefix_trie", "op13_structure_repair"])
def test_rows_are_those_of_sql(spark, duck, name):
    same_rows(getattr(queries, name)(spark, SF), duck.execute(queries.oracle_sql()[name]))


def test_running_sums_of_a_group_over_many_partitions(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 5L ELSE id % 7 END AS g", "hash(id) AS o", "id", "id % 11 AS v")
    got = running(rows.repartition(9), ["g"], ["o", "id"], "v").collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r)
    assert sum(map(len, by.values())) == 20_000
    for group in by.values():
        total = 0
        for r in sorted(group, key=lambda r: (r.o, r.id)):
            assert r.before == total
            total += r.v


# 11


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "k", 1, 2.0) for i, t, s in rows], "doc_id long, text string, lang string, source string, size int, key string, target int, epochs double")


def test_targets_by_force(spark):
    rng = random.Random(5)
    for weights in ((5, 2, 1), (1,), (7, 1)):
        sizes = [(f"s{i:02}", rng.choice([0, 1, 10, 200, 5000])) for i in range(9)] + [(None, 40)]
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long"), weights).collect()}
        w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
        total, limit = sum(n for _, n in sizes), {s: 3 * n for s, n in sizes}
        stopped: set = set()
        while True:
            left, of = total - sum(limit[s] for s in stopped), sum(w[s] for s in w if s not in stopped)
            over = {s for s in w if s not in stopped and limit[s] < left * w[s] / of}
            if not over:
                break
            stopped |= over
        for s in w:
            assert got[s] == pytest.approx(limit[s] if s in stopped else left * w[s] / of)
        assert sum(got.values()) == pytest.approx(total)


def test_mix_of_awkward_rows(spark):
    rows = [(None, "same words here", "a")] * 3000 + [(4, "same words here", "a")] * 5 + [(1, None, "b"), (2, "", "b"), (3, " \t\n", None), (6, "w " * 30_000, "c"), (7, "one", None), (7, "one", None)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    per = defaultdict(lambda: [0, 0, None])
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        per[r.source][0] += r.taken
        per[r.source][1] += r.size
        per[r.source][2] = r.target
    for source, (taken, size, target) in per.items():
        assert taken == round(target) and target <= 3 * size, source
    assert sum(p[1] for p in per.values()) == pytest.approx(sum(p[2] for p in per.values()))
    again = mixing.mix(docs(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(docs(spark, [])).count() == 0


def test_better_documents_come_first_and_shares_follow_weights(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("w"))
    got = mixing.mix(rows, budget=1200, weight=F.col("w"), keep=("doc_id", "w")).where("taken > 0").groupBy("w").count().collect()
    n = {r.w: r["count"] for r in got}
    assert sum(n.values()) == 600
    assert 0.72 < n[4.0] / 600 < 0.86  # 4 of 5 at first, a little less as they run out


def test_mixture_has_the_words_that_are_taken(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.mix(given).collect()}
    texts = {r.doc_id: r.text for r in given.collect()}
    count = defaultdict(int)
    for r in mixing.mixture(given).collect():
        n = len((r.text or "").split())
        assert (texts[r.doc_id] or "").startswith(r.text)
        count[r.doc_id] += n
    words = lambda t: len([w for w in (t or "").replace("\x1c", "x").split()])
    for doc, n in taken.items():
        if words(texts[doc]) == len((texts[doc] or "").split()):
            assert count[doc] == n, doc


# 12


def trie_by_force(sequences):
    nodes = {(): []}
    for c, seq in sorted(sequences.items()):
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    children = defaultdict(int)
    for s in nodes:
        if s:
            children[s[:-1]] += 1
    out = []
    for s, members in nodes.items():
        below = [t for t in nodes if t[: len(s)] == s]
        ends = ",".join(str(c) for c in members if len(sequences[c]) == len(s))
        out.append((members[0], len(s), nodes[s[:-1]][0] if s else None, len(members), children[s], sum(not children[t] for t in below), sum((len(nodes[t]) - 1) * len(t[-1][1].encode()) for t in below if t), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt_by_force(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for _, _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + mine[h:]
    return out


@pytest.mark.parametrize("segment, shard", [(256, 200_000), (3, 7), (2, 40)])
def test_trie_by_force(spark, segment, shard):
    rng = random.Random(segment)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "bé", ""])) for c in list(range(-7, 60)) + [500, 1001] for t in range(rng.choice([1, 2, 5, 9, 12]))]
    rows += [(c, t, "user", "hot") for c in range(200, 320) for t in range(3)]  # copies
    rows += [(700, t, "user", str(t % 4)) for t in range(40)] + [(705, t, "user", str(t % 4)) for t in range(37)]
    rows += [(9, None, "user", "first"), (None, 1, "user", "no id"), (None, None, None, None)]
    rng.shuffle(rows)
    got = prefix_trie.trie(prefix_trie.rebuilt_turns(turns(spark, rows).repartition(3)), segment, shard)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie_by_force(rebuilt_by_force(rows))


def test_trie_of_no_conversations(spark):
    assert prefix_trie.trie(prefix_trie.rebuilt_turns(turns(spark, []))).count() == 0
    assert prefix_trie.trie(prefix_trie.rebuilt_turns(turns(spark, [(None, 1, "user", "x")]))).count() == 0


# 13


def cheapest_by_force(rows):
    """Cost and least audit by the whole lattice; rows are (initial, fault)."""
    then, who = (2, 2, 3, 2), "uuau"
    after = [(0, ""), None, None, (0, "")]
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            initial, fault = rows[i]
            here = []
            for q in range(4):
                options = [(3, "D", after[q])]
                if fault in ("", "truncated"):
                    more = fault != ""
                    options.append((2 + more, "R", after[then[q]]))
                    if initial == who[q]:
                        options.append((more, "K", after[then[q]]))
                    if initial == "s" and q == 0:
                        options.append((more, "K", after[1]))
                here.append(min([(c + o[0], a + o[1]) for c, a, o in options if o], default=None))
        else:
            here = after
        with_inserts = []
        for q in range(4):
            options, at = [here[q]], q
            for n in (1, 2, 3):
                at = then[at]
                options.append(here[at] and (2 * n + here[at][0], "I" * n + here[at][1]))
            with_inserts.append(min([o for o in options if o], default=None))
        after = with_inserts
    return after[0]


def repair_by_force(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        of = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if of == 1 else "".join(x for x in text if x not in ".!?") if of == 2 else text
        for _ in range({0: 0, 3: 2}.get(of, 1)):
            by[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len('user' if of == 4 else role)}:{'user' if of == 4 else role}:{text}".encode()).hexdigest(), turn, "user" if of == 4 else role, text))
    out = []
    for c in {r[0] for r in rows}:
        mine, seen, faults, kinds = sorted(by[c], key=lambda r: r[:2]), set(), defaultdict(int), []
        for _, _, _, role, text in mine:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            kinds.append((role[:1], fault))
        turns_ = [r[2] for r in mine if r[2] is not None]
        gaps = max(turns_) - min(turns_) + 1 - len(set(turns_)) if turns_ else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        cost, audit = cheapest_by_force(kinds)
        state, lines, it = 0, [], iter(mine)
        for letter in audit:
            row = None if letter == "I" else next(it)
            if letter != "D":
                role = row[3] if letter == "K" else ("user", "user", "assistant", "user")[state]
                lines.append(f"{role}:{row[4] if row else ''}")
                state = 1 if role[:1] == "s" else (2, 2, 3, 2)[state]
        out.append((c, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def some_conversations(seed, lengths):
    rng = random.Random(seed)
    rows = []
    for c, n in enumerate(lengths):
        for t in range(n):
            turn = rng.choice([t, t, t, t, t + 3, None])
            rows.append((rng.choice([c] * 40 + [None]), turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice(["Yes.", f"No {t}!", "cut off", " \t", None, "x?\n", f"part {t}"])))
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_repair_by_force(spark, block):
    rows = some_conversations(block, [1, 2, 3, 4, 5, 8, 13, 30, 60] * 12)
    given = turns(spark, rows).repartition(3)
    got = repair.repair(repair.damaged(given), given, block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == repair_by_force(rows)


def test_search_by_force():
    rng = random.Random(1)
    for _ in range(3000):
        rows = "".join(rng.choice(repair.SYMBOLS) for _ in range(rng.randrange(12)))
        cost, audit, _ = repair.search(rows)
        assert (cost, audit) == cheapest_by_force([("" if x == "d" else x.lower(), "blank" if x == "d" else "truncated" if x.isupper() else "") for x in rows]), rows


def test_repaired_rows_obey_the_grammar(spark):
    rows = some_conversations(9, [20, 7, 3, 50])
    by = defaultdict(list)
    for r in repair.repaired(turns(spark, rows), 8).collect():
        by[r.conv_id].append(r)
    assert set(by) == {r[0] for r in rows}
    for lines in by.values():
        lines.sort(key=lambda r: (r.block, r.place))
        initials = "".join(r.role[:1] for r in lines if r.edit != "D")
        assert repair_pattern.fullmatch(initials)
        assert all((r.role is None) == (r.edit == "D") for r in lines)


def test_repair_of_no_rows(spark):
    assert repair.repair(repair.damaged(turns(spark, []))).count() == 0
    given = turns(spark, [(5, 1, "user", "Hi."), (None, None, None, None)])
    got = repair.repair(given.where("false"), given).collect()
    assert sorted((r.conv_id is None, r.cost, r.audit, r.repaired_sha256) for r in got) == [(False, 0, "", EMPTY), (True, 0, "", EMPTY)]
