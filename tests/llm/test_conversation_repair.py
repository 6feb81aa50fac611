"""Conversation repair against exhaustive search, a plain forward program and hand-made cases."""

import hashlib
import itertools
import random
import re

import pytest

from hybridq.llm import conversation_repair as C

WORD = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        marks = WORD.findall(text)
        out.append("b" if not marks else "d" if (role, text) in seen else "" if marks[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """(cost, audit) over all edits with up to two inserts in a gap."""
    found = faults(rows)
    gaps = [""] + ["".join(p) for n in (1, 2) for p in itertools.product("ua", repeat=n)]
    per_row = []
    for (role, _), fault in zip(rows, found):
        late = 3 if fault == "t" else 0
        options = [("D", 4, "")]
        if fault not in ("b", "d"):
            options += [("K", late, role[:1] or "?"), ("R", 3 + late, "u"), ("R", 3 + late, "a")]
        per_row.append(options)
    best = None
    for edits in itertools.product(*per_row):
        for fill in itertools.product(gaps, repeat=len(rows) + 1):
            said = fill[0] + "".join(e[2] + f for e, f in zip(edits, fill[1:]))
            if LEGAL.fullmatch(said):
                audit = "I" * len(fill[0]) + "".join(e[0] + "I" * len(f) for e, f in zip(edits, fill[1:]))
                cost = sum(e[1] for e in edits) + 3 * sum(map(len, fill))
                best = min(best or (cost, audit), (cost, audit))
    return best


def forward(rows):
    """(cost, audit, repaired rows): the least per state, row by row."""
    into = {0: [(2, "user")], 1: [(2, "user")], 2: [(3, "assistant")], 3: [(2, "user")]}
    paths = {0: (0, "", ())}

    def filled(paths):
        for _ in range(2):
            for s, (cost, audit, said) in list(paths.items()):
                for t, name in into[s]:
                    new = (cost + 3, audit + "I", said + (name + ":",))
                    paths[t] = min(paths.get(t, new), new)
        return paths

    for (role, text), fault in zip(rows, faults(rows)):
        after, late = {}, 3 if fault == "t" else 0
        for s, (cost, audit, said) in filled(paths).items():
            options = [(s, 4, "D", ())]
            if fault not in ("b", "d"):
                options += [(t, 3 + late, "R", (f"{name}:{text}",)) for t, name in into[s]]
                options += [(t, late, "K", (f"{role}:{text}",)) for t, name in into[s] if role[:1] == name[0]]
                options += [(1, late, "K", (f"{role}:{text}",))] if s == 0 and role[:1] == "s" else []
            for t, more, letter, add in options:
                new = (cost + more, audit + letter, said + add)
                after[t] = min(after.get(t, new), new)
        paths = after
    done = filled(paths)
    return min(done[s] for s in (0, 3) if s in done)


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def report(rows):
    """The summary of one conversation from (turn, role, text, copies)."""
    spaced = [(t, " " if r is None else r, " " if x is None else x) for t, r, x, n in rows for _ in range(n)]
    spaced.sort(key=lambda r: (r[0] is not None, r[0] or 0, key(r[1], r[2])))
    plain = [r[1:] for r in spaced]
    cost, audit, said = forward(plain)
    turns = {t for t, _, _ in spaced if t is not None}
    found = faults(plain)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
    return (gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, digest)


def conversation(rnd, most):
    roles, texts = ["user", "assistant", "system", "tool", "agent", "", None], ["a.", "b!", "c", " ", "", None, "d? \n", "e", "f."]
    return [
        (rnd.choice([None, *range(12)]), rnd.choice(roles), rnd.choice(texts), rnd.choice([0, 1, 1, 1, 2]))
        for _ in range(rnd.randint(0, most))
    ]


@pytest.mark.parametrize("seed", range(60))
def test_plans_are_the_least_cheapest(seed):
    rnd = random.Random(seed)
    rows = [(r or " ", x or " ") for _, r, x, _ in conversation(rnd, 3)]
    runs = []
    for (role, _), fault in zip(rows, faults(rows)):
        who = role[:1] if role[:1] in ("s", "u", "a") else "x"
        symbol = C.SYMBOLS.index(("", fault) if fault in ("b", "d") else (who, fault))
        runs = runs[:-1] + [(symbol, runs[-1][1] + 1)] if runs and runs[-1][0] == symbol else runs + [(symbol, 1)]
    edits, state = C.unroll(runs, C.START, C.ENDED)
    audit = edits + "I" * C.closing(state)
    ahead = C.ENDED
    for symbol, count in reversed(runs):
        ahead = C.back(symbol, count, ahead)
    assert (ahead[C.START], audit) == exhaustive(rows) == forward(rows)[:2]


def test_long_runs_by_powers():
    """A run of many rows costs what its rows cost one by one, and is unrolled in stretches."""
    for symbol in range(len(C.SYMBOLS)):
        v = C.ENDED
        for _ in range(5000):
            v = C.apply(C.power(symbol, 0), v)
        assert C.back(symbol, 5000, C.ENDED) == v
        edits, state = C.unroll([(symbol, 5000)], C.START, C.ENDED)
        assert sum(c in "KRD" for c in edits) == 5000
        extra = 3 * sum(c in "KR" for c in edits) if C.SYMBOLS[symbol][1] == "t" else 0
        assert sum(C.COSTS[c] for c in edits) + extra + 3 * C.closing(state) == v[C.START]
    assert C.back(1, 10**12, C.ENDED)[C.START] == 3 * 10**12 // 2  # every other one becomes an assistant


SCHEMA = "conv_id long, turn long, role string, text string, copies int, digest string, side int, symbols string"


@pytest.mark.parametrize("segment", [C.SEGMENT, 3])
def test_equals_forward_program(spark, segment):
    rnd = random.Random(segment)
    tables = {i: conversation(rnd, 14) for i in range(120)} | {None: conversation(rnd, 9)}
    tables[500] = [(t, rnd.choice(["user", "assistant"]), rnd.choice(["x.", f"{t}!", f"{t}"]), 1) for t in range(1500)]
    tables[501] = [(7, "user", "same.", 1)] * 400 + [(8, "user", "same.", 1)]
    tables[502] = [(1, "user", "long " * 200_000 + "end.", 1), (2, "assistant", "ok.", 1)]
    tables[503] = [(1, "user", "x.", 0)]
    rows = [(i, *r, "d", 3, "s") for i, t in tables.items() for r in t]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    rnd.shuffle(rows)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair_report(frame, segment).collect()}
    want = {i: report(t) for i, t in tables.items() if t}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == want[i], i


def test_rows_make_the_report(spark, sf):
    told = C.damage(spark.read.parquet(f"{sf}/conversations.parquet"))
    rows, report = C.repair(told).collect(), {r.conv_id: r for r in C.repair_report(told).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.position)):
        by.setdefault(r.conv_id, []).append(r)
    for i, r in report.items():
        mine = by.get(i, [])
        assert "".join(x.edit for x in mine) == r.audit
        said = [x for x in mine if x.edit != "D"]
        assert LEGAL.fullmatch("".join(x.role[:1] for x in said))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in said).encode()).hexdigest() == r.repaired_sha256


def test_damage_by_hand(spark):
    import zlib

    rows = [(c, t, "assistant", "Hi. There!") for c in (1, None) for t in [*range(60), None]]
    got = C.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in got:
        k = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        fate = zlib.crc32(k.encode()) % 20
        text = {1: "", 2: "Hi There"}.get(fate, "Hi. There!")
        assert (r.role, r.text, r.copies) == ("user" if fate == 4 else "assistant", text, {0: 0, 3: 2}.get(fate, 1))


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair_report(C.damage(none)).collect() == [] and C.repair(none).collect() == []
