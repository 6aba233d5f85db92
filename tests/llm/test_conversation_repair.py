import hashlib
import heapq
import random
import re
import zlib

from pricewell.llm import conversation_repair
from pricewell.llm.conversation_repair import Conversation, damaged, repair_report, repaired_turns
from pricewell.llm.queries import op12_conversation_repair
from pricewell.llm.role_grammar import Automaton, Repair, Row

SPACE = " \t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?")


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        row = (turn, "user" if harm == 4 else role, "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text)
        out.setdefault(conv, []).extend([row] * {0: 0, 3: 2}.get(harm, 1))
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0)) for c, rs in out.items()}


def search(rows):
    """(cost, audit, lines) by a plain search: the cheapest way first, all ways tried; rows are (role, text, must_go, short)."""
    heap, seen = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        letters = "".join(m[0] for m in made)
        if i == len(rows) and GOOD.fullmatch(letters):
            return cost, audit, [f"{m[1]}:{m[2]}" for m in made]
        if (i, made, audit) in seen or not re.fullmatch("(s?(ua)*u?)?", letters):
            continue
        seen.add((i, made, audit))
        push = lambda more, edit, j, new: heapq.heappush(heap, (cost + more, audit + edit, j, made + new))
        for name in ("user", "assistant"):
            push(3, "I", i, ((name[0], name, ""),))
        if i < len(rows):
            role, text, must_go, short = rows[i]
            push(4, "D", i + 1, ())
            if not must_go:
                if role[:1] in ("s", "u", "a"):
                    push(3 * short, "K", i + 1, ((role[0], role, text),))
                for name in ("user", "assistant"):
                    push(3 + 3 * short, "R", i + 1, ((name[0], name, text),))
    return None


def table(rows):
    """The same by a table of the last role put, for rows of any number."""
    best = {"": (0, "", ())}
    one = lambda b, cost, edit, line=(): (b[0] + cost, b[1] + edit, b[2] + line)
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def spread(best):
        for _ in range(3):
            for x in list(best):
                for name in ("user", "assistant"):
                    if name[0] in after[x]:
                        new = one(best[x], 3, "I", (f"{name}:",))
                        best[name[0]] = min(best.get(name[0], new), new)
        return best

    for role, text, must_go, short in rows:
        best, new = spread(best), {}

        def offer(x, b, new=new):
            new[x] = min(new.get(x, b), b)

        for x, b in best.items():
            offer(x, one(b, 4, "D"))
            if not must_go:
                if role[:1] and role[:1] in after[x]:
                    offer(role[0], one(b, 3 * short, "K", (f"{role}:{text}",)))
                for name in ("user", "assistant"):
                    if name[0] in after[x]:
                        offer(name[0], one(b, 3 + 3 * short, "R", (f"{name}:{text}",)))
        best = new
    return min(b for x, b in spread(best).items() if x in ("", "a"))


def judged(rows):
    seen, out, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        out.append((role, text, fault in (0, 1), fault == 2))
    return out, counts


def brute(rows, find=table):
    out = {}
    for conv, rs in brute_damage(rows).items():
        turns = [r[0] for r in rs if r[0] is not None]
        marked, counts = judged(rs)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (_, a, _), (_, b, _) in zip(rs, rs[1:], strict=False))
        cost, audit, lines = find(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def by_conv(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_conv(op12_conversation_repair(spark, sf_dir)) == brute(rows)


def test_parser_equals_search_of_all_edits():
    rng, repair = random.Random(5), Repair()
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), f"t{i}", rng.random() < 0.2, rng.random() < 0.3) for i in range(rng.randrange(6))]
        rows = [(r, t, g, s and not g) for r, t, g, s in rows]
        put = []
        c = Conversation(repair, lambda *x, put=put: put.append(x))
        for i, (role, text, must_go, short) in enumerate(rows):
            c.add(i, role, text, must_go, not short, False)
        c.end()
        found = c.cost, "".join(p[0] for p in put), [f"{p[2]}:{p[3]}" for p in put if p[0] != "D"]
        assert found == search(rows) == (lambda b: (b[0], b[1], list(b[2])))(table(rows)), rows


def test_long_conversations_are_decided_on_the_way(monkeypatch):
    rng, repair = random.Random(6), Repair()
    for chance in (0.05, 0.5):
        rows = [("user" if i % 2 == 0 else "assistant", f"t{i}", False, False) for i in range(3000)]
        rows = [(rng.choice(["system", "user", "assistant"]), t, rng.random() < 0.3, False) if rng.random() < chance else (r, t, g, s) for r, t, g, s in rows]
        put, most = [], 0
        c = Conversation(repair, lambda *x, put=put: put.append(x))
        for i, (role, text, must_go, _) in enumerate(rows):
            c.add(i, role, text, must_go, True, False)
            most = max(most, len(c.pending))
        c.end()
        cost, audit, lines = table(rows)
        assert (c.cost, "".join(p[0] for p in put), [f"{p[2]}:{p[3]}" for p in put if p[0] != "D"]) == (cost, audit, list(lines))
        assert most <= 2 * conversation_repair.PENDING
    assert len(repair._steps) < 2000  # fronts are few, whatever the rows


def test_stacks_are_shared_and_few():
    a = Automaton()
    front = {a.bottom}
    for _ in range(6):
        front |= {new for cell in front for symbol in "sua" for new in a.shifts(cell, symbol)}
    assert len(front) == 5  # none, after s, after u, after pairs, within the next pair
    assert a.accepts(a.bottom) and not a.shifts(a.bottom, "a") and not a.shifts(a.bottom, "")
    word = lambda w: [c for cells in [[a.bottom]] for s in w for cells in [[n for c in cells for n in a.shifts(c, s)]] for c in cells][-1:]
    for w, good in (("sua", True), ("uaua", True), ("su", False), ("s", False)):
        assert any(a.accepts(c) for c in word(w)) is good
    assert Repair().step(Repair().start, Row("u"))[1] == 0


def test_edge_tables(spark):
    long = "x" * 300_000 + "."
    rows = [(1, 0, "user", "Hi."), (1, None, "system", "Be good."), (1, 1, None, None), (1, 3, "assistant", long), (1, 3, "assistant", long), (1, 3, "assistant", "Again."), (None, 5, "user", "One."), (None, None, "user", "Two "), (2, 0, "", "."), (2, 9, "assistant", "\n\t "), (3, 0, "user", "a. \r\n"), (4, None, "assistant", "a?"), (4, None, "assistant", "a?")]
    rows += [(100 + i, 0, "user", "Only.") for i in range(60)]  # some lose their only row
    frame = spark.createDataFrame([(*r, "k", 7) for r in rows], "conv_id long, turn int, role string, text string, kind string, times int")
    got, want = by_conv(repair_report(damaged(frame))), brute(rows)
    assert {k: v for k, v in got.items() if k != 1} == {k: v for k, v in want.items() if k != 1}
    assert got[1][:4] == want[1][:4] and got[1][5] == want[1][5]  # of one turn the order is by digest
    gone = [v for v in got.values() if v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert gone
    assert by_conv(repair_report(damaged(frame.limit(0)))) == {} and repaired_turns(damaged(frame.limit(0))).count() == 0


def test_turns_are_what_the_digest_is_of(spark, sf_dir):
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    turns = {}
    for r in sorted(repaired_turns(rows).collect(), key=lambda r: (r.conv_id, r.place)):
        turns.setdefault(r.conv_id, []).append(r)
    for r in repair_report(rows).collect():
        mine = turns.get(r.conv_id, [])
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in mine).encode()).hexdigest() == r.repaired_sha256
        assert "".join(t.edit for t in mine) == r.audit.replace("D", "") and GOOD.fullmatch("".join(t.role[0] for t in mine))
        assert [t.place for t in mine] == list(range(len(mine))) and all((t.turn is None) == (t.edit == "I") for t in mine)
