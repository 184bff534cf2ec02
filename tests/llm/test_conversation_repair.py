import hashlib
import itertools
import random
import re
import zlib

import pytest

from perilake.llm import conversation_repair as cr

BLANK = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = "conv_id long, turn long, role string, text string, cost string, audit int"


def fault(text):
    return "blank" if not BLANK.search(text) else "" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated"


def options(role, kind):
    """(letter, role after, cost) of a row's edits."""
    if kind in ("blank", "duplicate"):
        return [("D", None, 2)]
    extra = 5 if kind == "truncated" else 0
    return [("K", role, extra), ("R", "user", 1 + extra), ("R", "assistant", 1 + extra), ("D", None, 2)]


def every_repair(rows):
    """All edit sequences with up to two insertions in each gap, judged by the pattern itself."""
    gaps = [()] + [x for n in (1, 2) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for chosen in itertools.product(*[options(*r) for r in rows]):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            roles, audit, cost = list(put[0]), "I" * len(put[0]), 5 * sum(map(len, put))
            for (letter, role, price), more in zip(chosen, put[1:], strict=True):
                roles += ([] if role is None else [role]) + list(more)
                audit += letter + "I" * len(more)
                cost += price
            if all(roles) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in roles)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, roles)
    return best


def plain_repair(rows):
    """Weights of suffixes with their whole audits, row by row; insertions relaxed until nothing changes."""
    steps = {("S", "s"): "A", ("S", "u"): "B", ("A", "u"): "B", ("B", "a"): "C", ("C", "u"): "B"}

    def relaxed(w):
        while True:
            more = dict(w)
            for (q, x), to in steps.items():
                if x != "s" and to in w:
                    more[q] = min(more.get(q, (10**9, "")), (w[to][0] + 5, "I" + w[to][1]))
            if more == w:
                return w
            w = more

    weights = relaxed({"S": (0, ""), "C": (0, "")})
    for role, kind in reversed(rows):
        new = {}
        for q in "SABC":
            found = []
            for letter, after, cost in options(role, kind):
                to = q if after is None else steps.get((q, after[:1]))
                if to in weights:
                    found.append((weights[to][0] + cost, letter + weights[to][1]))
            if found:
                new[q] = min(found)
        weights = relaxed(new)
    return weights["S"]


def codes(rows):
    kinds = {"": cr.SOUND, "truncated": cr.CUT, "blank": cr.VOID, "duplicate": cr.VOID}
    return bytes(4 * kinds[kind] + ("sua".index(role[0]) if role and role[0] in "sua" else 3) for role, kind in rows)


def drawn(rng, n):
    return [(rng.choice(["user", "user", "assistant", "assistant", "system", "tool", ""]), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(n)]


def test_agenda_against_every_repair():
    rng = random.Random(1)
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 3, 3):
        for _ in range(4):
            rows = drawn(rng, n)
            assert cr.lightest(codes(rows)) == every_repair(rows)[:2], rows


def test_agenda_against_plain_repair_over_stretches(monkeypatch):
    rng = random.Random(2)
    for stretch, sizes in ((1, range(1, 40)), (3, range(1, 60)), (512, (5, 200, 512, 513, 1400))):
        monkeypatch.setattr(cr, "STRETCH", stretch)
        for n in sizes:
            rows = drawn(rng, n)
            assert cr.lightest(codes(rows)) == plain_repair(rows), rows
            same = [rng.choice([("tool", ""), ("user", ""), ("assistant", "truncated"), ("system", "")])] * n
            assert cr.lightest(codes(same)) == plain_repair(same), same
            cycle = list(itertools.islice(itertools.cycle(drawn(rng, 3)), n))
            assert cr.lightest(codes(cycle)) == plain_repair(cycle), cycle


def test_long_conversation_is_linear():
    cost, audit = cr.lightest(bytes([1, 2] * 60_000))
    assert cost == 0 and audit == "K" * 120_000
    cost, audit = cr.lightest(bytes([3]) * 30_001)
    assert (cost, len(audit)) == (30_002, 30_001)


def brute(table):
    """The whole contract in plain Python."""
    groups = {}
    for conv, turn, role, text in table:
        held = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        held += [(turn, role, text)] * (2 if hit == 3 else 1)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, md5(md5(r[1]) + md5(r[2]))))
        turns = {r[0] for r in rows} - {None}
        seen, kinds = set(), []
        for _, role, text in rows:
            kind = fault(text)
            kinds.append("blank" if kind == "blank" else "duplicate" if (role, text) in seen else kind)
            seen.add((role, text))
        cost, audit = plain_repair([(r[1], k) for r, k in zip(rows, kinds, strict=True)])
        told, left = [], list(rows)
        for letter in audit:
            row = (None, "", "") if letter == "I" else left.pop(0)
            due = "user" if not told or told[-1][0][0] in "sa" else "assistant"
            if letter != "D":
                told.append((row[1] if letter == "K" else due, row[2]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest()
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, sha)
    return out


def run(spark, monkeypatch, table, columns=COLUMNS):
    frame = spark.createDataFrame([(*r, "x", 1) for r in table], columns)
    monkeypatch.setattr(cr, "table", lambda *_: frame)
    got = cr.op13_conversation_repair(spark, "")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = [(r.conv_id, tuple(r[n] for n in names)) for r in got.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["Fine.", "no end", "", "\t \n", "What?  ", "Yes! ", "Ärger…", "a.b", ".", " ", "x" * 50_000, None]
    table = [(conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts))
             for conv in range(300) for turn in range(rng.randrange(1, 9)) if rng.random() < 0.9]
    table += [(5, None, "user", "Later."), (5, None, "assistant", None), (None, 3, "user", "Hi."), (None, None, None, None), (7, 1, "user", "Again."), (7, 1, "user", "Again."), (7, 1, "tool", "Other.")]
    table += [(-4, turn, "user" if turn % 2 == 0 else "assistant", "Same.") for turn in range(1500)]
    assert run(spark, monkeypatch, table) == brute(table)


def test_dropped_and_empty(spark, monkeypatch):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert run(spark, monkeypatch, [(lost, 0, "user", "Hi.")]) == {lost: (0, 0, 0, 0, 0, 0, "", empty)}
    assert run(spark, monkeypatch, []) == {}


def test_repaired_rows(spark):
    talk = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello?"), (1, 3, "user", "Hi."), (1, 4, "tool", "Yes."), (2, 0, "user", "")]
    planned, fixed = cr.repair(spark.createDataFrame([(*r, "x", 1) for r in talk], COLUMNS))
    assert {r.conv_id: (r.duplicate, r.blank, r.cost, r.audit) for r in planned.collect()} == {1: (1, 0, 5, "KDKDR"), 2: (0, 1, 2, "D")}
    rows = [(r.conv_id, r.position, r.role, r.text, r.edit) for r in fixed.collect()]
    audit = {r.conv_id: r.audit for r in planned.collect()}[1]
    assert [r[4] for r in rows] == [x for x in audit if x != "D"] and [r[1] for r in rows] == list(range(len(rows)))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[2][0] for r in rows)) and all(r[0] == 1 for r in rows)


def test_order_of_audits():
    end = cr.Rest(0, "", None)
    assert cr.less("KD", end, "KR", end) and not cr.less("KR", end, "KR", end)
    one, two = cr.Rest(0, "D", end), cr.Rest(0, "KR", end)
    assert cr.less("K", one, "KK", end)
    assert not cr.less("KKK", end, "K", one) and cr.less("K", two, "KR", end)


@pytest.mark.parametrize("code", range(cr.GONE))
def test_edits_of_a_code(code):
    role = {0: "system", 1: "user", 2: "assistant", 3: "tool"}[code % 4]
    kind = {0: "", 1: "truncated", 2: "blank"}[code // 4]
    want = {}
    for letter, after, cost in options(role, kind):
        if after in ("system", "user", "assistant") and cost < want.get(after[0], (99,))[0]:
            want[after[0]] = (cost, letter)
    assert {x: (cost, letter) for x, letter, cost in cr.EDITS[code]} == want
