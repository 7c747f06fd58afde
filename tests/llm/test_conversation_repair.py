"""Conversation repair against a plain search over all edit sequences, and against a plain replay."""

import hashlib
import itertools
import re
import zlib

import pytest

from recordvol.llm import conversation_repair as repair
from recordvol.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, place int"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """Cost, audit and repaired (role, text) of rows (role, text, fault): all edit strings by a search over states."""
    best = {"": (0, "", [])}  # initials so far -> cheapest, ASCII-least
    legal = re.compile("(s?(ua)+)?")

    def prefix(x):
        return any(legal.fullmatch(x + y) for y in ("", "a", "ua"))

    def short(x):  # what matters of the initials
        return x if len(x) <= 3 else "ua" + "u" * ((len(x) - x.count("s")) % 2)

    def put(to, initials, cost, audit, out):
        if prefix(initials):
            k = short(initials)
            if k not in to or (cost, audit) < to[k][:2]:
                to[k] = (cost, audit, out)

    def with_inserts(states):
        for _ in range(3):
            for initials, (cost, audit, out) in list(states.items()):
                for r in ("user", "assistant"):
                    put(states, initials + r[0], cost + 3, audit + "I", [*out, (r, "")])
        return states

    for role, text, fault in rows:
        after = {}
        for initials, (cost, audit, out) in with_inserts(best).items():
            put(after, initials, cost + 4, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                put(after, initials + (role[:1] or "o"), cost + more, audit + "K", [*out, (role, text)])
                for r in ("user", "assistant"):
                    put(after, initials + r[0], cost + 3 + more, audit + "R", [*out, (r, text)])
        best = after
    ends = [(cost, audit, out) for initials, (cost, audit, out) in with_inserts(best).items() if legal.fullmatch(initials)]
    return min(ends, key=lambda x: x[:2])


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(conversations):
    out = {}
    for conv, rows in conversations.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{'null' if conv is None else conv}:{len(r[1])}\n{r[1]}\n{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            solid = BLANK.findall(text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit, repaired = cheapest([(role, text, f) for (_, role, text), f in zip(rows, faults)])
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def found(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_over_the_whole_table(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert found(queries.op13_conversation_repair(spark, SF)) == expected(damaged(rows))


def test_every_short_signature():
    for n in range(6):
        for signature in itertools.product("suaoSUAOx" if n < 5 else "suaUx", repeat=n):
            rows = [("x" if c == "x" else {"s": "system", "u": "user", "a": "assistant", "o": "tool"}[c.lower()], "", "blank" if c == "x" else "truncated" if c.isupper() else None) for c in signature]
            cost, audit, _ = cheapest(rows)
            assert repair.solve("".join(signature)) == audit, signature


def odd(spark):
    text = "It is so."
    rows = [
        (1, 0, "system", text), (1, 1, "user", "Why?"), (1, 2, "assistant", "Because."), (1, 4, "user", "Why?"), (1, 4, "user", "Why?"), (1, 9, "tool", "cut"),
        (2, None, "user", text), (2, None, "assistant", None), (2, 3, None, text), (3, None, None, None), (4, 5, "user", ""), (4, 5, "user", "\t \n"),
        (None, 1, "assistant", "No! "), (None, 1, "assistant", "No! "), (None, None, "user", "Y" * 70_000), (5, -3, "", "x."), (5, -3, "admin", "x. "), (5, -3, "admin", "x. ?"),
        *((6, i, ("user", "assistant", "system", "tool")[i * i % 7 % 4], f"{i % 40} {'.' * (i % 3)}") for i in range(500)),
        *((7, 1, "user", "same.") for _ in range(100)), *((8, i, "user", "ok.") for i in range(300)),
    ]
    return rows, spark.createDataFrame([(*r, "k", 3, 4) for r in rows], SCHEMA)


@pytest.mark.parametrize("piece", [1, 7, 1024])
def test_odd_rows_and_long_conversations(spark, piece):
    rows, df = odd(spark)
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert found(repair.audit(df.repartition(5), piece=piece)) == expected(by)
    assert found(repair.audit(repair.damage(df), df, piece=piece)) == expected(damaged(rows))


def test_repaired_rows_are_the_hashed_ones(spark):
    _, df = odd(spark)
    audits, out = found(repair.audit(df, piece=7)), {}
    for r in repair.repair(df, piece=7).orderBy("conv_id", "place").collect():
        out.setdefault(r["conv_id"], []).append(r)
    for conv, (*_, audit, digest) in audits.items():
        rows = out.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in rows).encode()).hexdigest() == digest
        assert "".join(r["edit"] for r in rows) == audit.replace("D", "") and [r["place"] for r in rows] == list(range(1, len(rows) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in rows))


def test_empty_table_and_conversations_without_rows(spark):
    _, df = odd(spark)
    assert repair.audit(df.where("false")).count() == 0 and repair.repair(df.where("false")).count() == 0
    empty = found(repair.audit(df.where("false"), df.where("conv_id = 1")))
    assert empty == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
