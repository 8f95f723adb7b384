"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import pytest

from strikelake.llm import queries as Q
from strikelake.llm.conversations import MUST_GO, SYMBOLS, Tables, damaged, repair_conversations, repaired_rows

SF = "/root/testdata/sf0.01"


def plain_repair(symbols):
    """(cost, audit): least over all edits, inserts at most three in a row."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    known = {}

    def best(at, state, inserts):
        if (at, state, inserts) not in known:
            options = [(0, "")] if at == len(symbols) and state in (0, 3) else []
            due = "a" if state == 2 else "u"
            if inserts < 3:
                cost, rest = best(at, moves[state, due], inserts + 1)
                options.append((cost + 5, "I" + rest))
            if at < len(symbols):
                cost, rest = best(at + 1, state, 0)
                options.append((cost + 2, "D" + rest))
                if symbols[at] != MUST_GO:
                    extra = 5 if symbols[at] >= 4 else 0
                    cost, rest = best(at + 1, moves[state, due], 0)
                    options.append((cost + 1 + extra, "R" + rest))
                    to = moves.get((state, "sua?"[symbols[at] % 4]))
                    if to is not None:
                        cost, rest = best(at + 1, to, 0)
                        options.append((cost + extra, "K" + rest))
            known[at, state, inserts] = min(options, default=(10**9, "~"))
        return known[at, state, inserts]

    return best(0, 0, 0)


def plain_result(rows):
    """Everything the query returns for one conversation's rows (turn, role, text) in order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    counts, symbols, seen = Counter(), [], set()
    for _, role, text in rows:
        initial = "sua".find(role[0]) if role else -1
        symbol = initial if initial >= 0 else 3
        inked = re.findall(r"[^\x20\x09-\x0D]", text)
        if not inked:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "truncated" if inked[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        symbols.append(MUST_GO if fault in ("blank", "duplicate") else symbol + 4 if fault else symbol)
    cost, audit = plain_repair(symbols)
    out, left, state = [], iter(rows), ""
    for edit in audit:
        due = "assistant" if state == "u" else "user"
        if edit == "I":
            out.append((due, ""))
        elif edit == "D":
            next(left)
            continue
        else:
            _, role, text = next(left)
            out.append((role if edit == "K" else due, text))
        state = out[-1][0][0]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha), out


def plain_damage(rows):
    """Conversations (id -> rows) after the damage; an id without rows stays."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        mine = convs[conv]
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if code == 0:
            continue
        text = "" if code == 1 else re.sub(r"[.!?]", "", text) if code == 2 else text
        mine += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {c: sorted(mine, key=key) for c, mine in convs.items()}


def found_rows(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("block", [1, 3, 4])
def test_tables_against_search(block):
    tables = Tables(block)
    assert len(tables.vectors) < 200
    for symbols in product(range(SYMBOLS), repeat=3):
        assert tables.repair(bytes(symbols)) == plain_repair(symbols)
    draw = random.Random(block)
    for _ in range(300):
        symbols = bytes(draw.choices(range(SYMBOLS), [2, 9, 9, 1, 1, 2, 2, 1, 2], k=draw.randrange(40)))
        assert tables.repair(symbols) == plain_repair(symbols)


def test_query_against_search(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    want = {c: plain_result(mine)[0] for c, mine in plain_damage(rows).items()}
    df = Q.op12_conversation_repair(spark, SF)
    assert found_rows(df) == want
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, None, "system", "S."),
        (2, None, None, None), (2, None, "", "x."), (2, None, "other", "y"), (2, None, "usher", "z!"),
        (None, 5, "user", "one?"), (None, None, "user", "\t \n"), (None, 5, "user", "one?"), (None, 9, None, "é."),
        (3, None, None, None), (4, 2**40, "assistant", "long " * 50_000 + "."), (4, -3, "user", "?"),
        *[(5, t, "user" if t % 2 else "assistant", f"{t // 3}.") for t in range(40)],
    ]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, position long, audit string")


@pytest.mark.parametrize("chunk", [3, 4096])
def test_odd_rows(spark, odd, chunk):
    rows = [tuple(r)[:4] for r in odd.collect()]
    mine = plain_damage(rows)
    want = {c: plain_result(m) for c, m in mine.items()}
    assert found_rows(repair_conversations(damaged(odd), chunk=chunk)) == {c: w[0] for c, w in want.items()}
    out = defaultdict(list)
    for r in sorted(repaired_rows(damaged(odd), chunk).collect(), key=lambda r: r.place):
        out[r.conv_id].append((r.role, r.text))
    assert out == {c: w[1] for c, w in want.items() if w[1]}
    assert repair_conversations(odd.limit(0)).count() == 0


def test_all_rows_dropped(spark):
    ids = [i for i in range(400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(i, 0, "user", "Hi.") for i in ids], "conv_id long, turn long, role string, text string")
    found = found_rows(repair_conversations(damaged(df)))
    assert len(ids) > 5 and found == {i: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in ids}
