"""Repair of conversations' structure: distinct signatures are solved once, and their edits replayed.

A conversation's rows in order of turn (nulls first, then by role and by a hash of role and text)
are written as a compact string, a letter a row: its role's initial, in upper case if its text is cut
short, `x` if it must go because its text is blank or its role and text were seen earlier. Edits are
to Keep a row, to Rerole it to user or assistant, to Delete it, or to Insert an empty one, and make the
roles' initials match `(s?(ua)+)?`: that is a machine of four states. What a string costs from state
to state is a small table, found by memoised recursion over its halves, and what the cheapest edits
are, the ASCII-least of them, depends on the string, the state before it and the costs after it only.

So signatures are cut into pieces of at most PIECE rows; each distinct piece is measured once, the
costs after each piece are chained backwards through its conversation, each distinct pair of piece
and costs is solved once, and the audits are joined back and replayed over the texts. A conversation
of a third of all rows is many pieces; its texts pass through one task as a stream, as the result is
one hash over them in order, of which only the letters are held. Repeats are found by the smallest
turn of each role and text, not by looking at a conversation as a whole.

Defined results: null roles and texts count as one space; a null turn comes first and is no turn for
gaps; a null conv_id is a conversation; roles other than s, u and a by their first letter, the empty
one as well, can be reroled or deleted only; rows that repeat another are duplicates of it; equal turns are ordered by role,
then by hash; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordvol.llm._common import followed, spread, stored

#: Most rows of a piece of a signature.
PIECE = 1024
#: Costs of edits, and what an undeleted text that is cut short adds.
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: States: nothing yet, after the system's row, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Costs at a conversation's end, and the inserts that complete it.
END, COMPLETED = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
NEVER = 1 << 40

Costs = tuple[int, ...]


def _steps(letter: str, state: int) -> list[tuple[str, int, int]]:
    """Edit, cost and state after it of one row, in ASCII order of edits."""
    out = [("D", DELETE, state)]
    if letter != "x":
        more, role = CUT_SHORT if letter.isupper() else 0, letter.lower()
        after = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role)
        if after is not None and (after == NEXT[state] or (after == SYSTEM and state == START)):
            out.append(("K", more, after))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


@lru_cache(1 << 16)
def costs(signature: str) -> tuple[Costs, ...]:
    """Least costs of a signature from each state to each; inserts come before a row."""
    if len(signature) > 1:
        left, right = costs(signature[: len(signature) // 2]), costs(signature[len(signature) // 2 :])
        return tuple(tuple(min(x[k] + right[k][t] for k in range(4)) for t in range(4)) for x in left)
    table = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        at = state
        for inserts in range(3):
            for _, cost, after in _steps(signature, at):
                table[state][after] = min(table[state][after], inserts * INSERT + cost)
            at = NEXT[at]
    return tuple(map(tuple, table))


def before(table: tuple[Costs, ...], after: Costs) -> Costs:
    """Costs before a signature with these tables, less their least."""
    found = [min(x + y for x, y in zip(row, after)) for row in table]
    return tuple(x - min(found) for x in found)


@lru_cache(1 << 16)
def audits(signature: str, after: Costs) -> tuple[tuple[str, int], ...]:
    """For each state, the cheapest edits (the ASCII-least of them) and the state they end in."""
    if len(signature) > 1:
        left, right = signature[: len(signature) // 2], signature[len(signature) // 2 :]
        last = audits(right, after)
        first = audits(left, before(costs(right), after))
        return tuple((edits + last[state][0], last[state][1]) for edits, state in first)
    own = [min(cost + after[t] for _, cost, t in _steps(signature, s)) for s in range(4)]
    least = [min(own[s], INSERT + own[NEXT[s]], 2 * INSERT + own[NEXT[NEXT[s]]]) for s in range(4)]
    out = []
    for state in range(4):
        edits = ""
        while True:
            fits = [(e, t) for e, cost, t in _steps(signature, state) if cost + after[t] == least[state]]
            if least[state] == INSERT + least[NEXT[state]] and (not fits or fits[0][0] > "I"):
                edits, state = edits + "I", NEXT[state]
                continue
            out.append((edits + fits[0][0], fits[0][1]))
            break
    return tuple(out)


def solve(signature: str) -> str:
    """The cheapest edits of a whole conversation, the ASCII-least of them."""
    if not signature:
        return ""
    edits, state = audits(signature, END)[START]
    return edits + COMPLETED[state]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32(`conv_id:turn`) mod 20: dropped, emptied, cut short, repeated or reroled rows."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return (
        rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
        .where("kind != 0")
        .withColumns({"role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))})
        .select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
        .drop("copy")
    )


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with their key (a hash of conversation, role and text), role's letter and whether they are blank or cut short."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), value("role").alias("role"), value("text").alias("text"))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    key = F.unhex(F.sha2(F.concat_ws("\n", F.concat(conv, F.lit(":"), F.length("role").cast("string")), "role", "text").cast("binary"), 256))
    letter: Column = F.substring("role", 1, 1)
    letter = F.when(letter.isin("s", "u", "a"), letter).otherwise("o")
    return rows.withColumns({"key": key, "letter": letter, "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "short": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")})


def signatures(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, part, no, signature: the pieces of each conversation's signature, in order of part and no."""
    marked = _marked(rows)
    letter = F.when(F.col("blank"), "x").when(F.col("short"), F.upper("letter")).otherwise(F.col("letter"))
    light = marked.groupBy("conv_id", "turn", "role", "key", letter.alias("letter")).agg(F.count("*").alias("copies"))
    light = stored(light, "conversation-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = light.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    light = followed(light, stored(seen, "repeated-rows"), "key", "left")
    later = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place)
    light = light.select("conv_id", "turn", "role", "key", F.when(later, "x").otherwise(F.col("letter")).alias("letter"), "copies")
    order = ("conv_id", "turn", "role", "key")
    light = light.repartitionByRange(spread(rows), *order).sortWithinPartitions(*order)
    light = light.select("conv_id", "letter", "copies", F.spark_partition_id().alias("part"))
    kind = light.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, no, own = None, 0, 0, ""
        names = ["conv_id", "part", "no", "signature"]
        for batch in batches:
            out, types = [], batch.schema.field(0).type
            for c, letter, copies, p in zip(*(x.to_pylist() for x in batch.columns)):
                if own and c != conv:
                    out.append((conv, part, no, own))
                    own = ""
                if c != conv:
                    conv, no = c, 0
                part = p
                while copies:  # what comes after the first of equal rows must go
                    take = min(copies, piece - len(own))
                    own += letter + "x" * (take - 1)
                    letter, copies = "x", copies - take
                    if len(own) == piece:
                        out.append((conv, part, no, own))
                        no, own = no + 1, ""
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (types, pa.int32(), pa.int64(), pa.string()))], names=names)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv, part, no, own), (types, pa.int32(), pa.int64(), pa.string()))], names=names)

    return light.mapInArrow(cut, f"conv_id {kind}, part int, no long, signature string")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = [[x for row in costs(s) for x in row] for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tables, pa.list_(pa.int64()))], names=["signature", "costs"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs after each piece, from pieces in falling order."""
    conv, after, some = None, END, False
    for batch in batches:
        found = []
        for c, table in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
            if c != conv or not some:
                conv, after, some = c, END, True
            found.append(" ".join(map(str, after)))
            after = before(tuple(tuple(table[i : i + 4]) for i in range(0, 16, 4)), after)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.string())], names=["conv_id", "part", "no", "signature", "after"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for problem in batch.column(0).to_pylist():
            signature, after = problem.split("|")
            found.append(audits(signature, tuple(map(int, after.split()))))
        edits, states = ([[x[i] for x in f] for f in found] for i in range(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(edits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))], names=["problem", "edits", "states"])


class Replay:
    """One conversation: its pieces first, then its rows in order; gives repaired rows and sums."""

    def __init__(self, conv_id):
        self.conv_id, self.state = conv_id, START
        self.signature, self.edits = [], []
        self.at = self.row = self.place = 0
        self.role_state, self.last = START, ""
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.turn, self.turns, self.first = None, 0, None
        self.hash = hashlib.sha256()

    def piece(self, signature: str, edits: list[str], states: list[int]) -> None:
        self.signature.append(signature)
        self.edits.append(edits[self.state])
        self.state = states[self.state]

    def ready(self) -> None:
        if isinstance(self.edits, list):
            self.signature, self.edits = "".join(self.signature), "".join(self.edits) + COMPLETED[self.state]

    def _out(self, edit: str, role: str, text: str, turn: int | None) -> tuple:
        self.hash.update(("\n" * (self.place > 0) + f"{role}:{text}").encode())
        self.place += 1
        return self.conv_id, self.place, edit, role, text, turn

    def _inserted(self) -> Iterator[tuple]:
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            self.counts["cost"] += INSERT
            self.role_state = NEXT[self.role_state]
            yield self._out("I", ROLES[self.role_state], "", None)

    def add(self, turn: int | None, role: str, text: str, letter: str, blank: bool) -> Iterator[tuple]:
        self.ready()
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.last and self.last + letter not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = letter
        own = self.signature[self.row]
        self.row += 1
        cut = own.isupper()
        if blank or own == "x" or cut:
            self.counts["blank" if blank else "duplicate" if own == "x" else "truncated"] += 1
        yield from self._inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "D":
            self.counts["cost"] += DELETE
            return
        self.counts["cost"] += REROLE * (edit == "R") + CUT_SHORT * cut
        self.role_state = SYSTEM if edit == "K" and letter == "s" else NEXT[self.role_state]
        yield self._out(edit, role if edit == "K" else ROLES[self.role_state], text, turn)

    def end(self) -> Iterator[tuple]:
        self.ready()
        yield from self._inserted()

    def summary(self) -> tuple:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, *self.counts.values(), self.edits, self.hash.hexdigest()


def _replayed(summaries: bool):
    """Repaired rows, or a summary of each conversation, from pieces and rows in order."""
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256") if summaries else ("conv_id", "place", "edit", "role", "text", "turn")
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 if summaries else [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, size, types = None, [], 0, None

        def give(rows: Iterator[tuple]) -> int:
            n = 0
            for r in rows:
                if not summaries:
                    out.append(r)
                    n += len(r[4]) + 64
            return n

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (types, *kinds))], names=list(names))

        for batch in batches:
            types = batch.schema.field(0).type
            for i in range(0, batch.num_rows, 256):
                for c, kind, signature, edits, states, turn, role, text, letter, blank in zip(*(x.to_pylist() for x in batch.slice(i, 256).columns)):
                    if own is None or own.conv_id != c:
                        if own is not None:
                            size += give(own.end())
                            if summaries:
                                out.append(own.summary())
                        own = Replay(c)
                    if kind == 0 and signature is not None:
                        own.piece(signature, edits, states)
                    elif kind == 1:
                        size += give(own.add(turn, role, text, letter, blank))
                    if size > 4 << 20 or len(out) >= 4096:
                        yield batch_of()
                        out, size = [], 0
        if own is not None:
            give(own.end())
            if summaries:
                out.append(own.summary())
        if out:
            yield batch_of()

    return replayed, names, ["long"] * 6 + ["string"] * 2 if summaries else ["long", "string", "string", "string", "long"]


def _replay(rows: DataFrame, conversations: DataFrame | None, summaries: bool, piece: int) -> DataFrame:
    pieces = stored(signatures(rows, piece), "signatures")
    tables = stored(pieces.select("signature").distinct().mapInArrow(_measured, "signature string, costs array<long>"), "costs")
    kind = pieces.schema["conv_id"].dataType.simpleString()
    held = followed(pieces, tables, "signature").repartition(spread(rows), "conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("no"))
    held = held.select("conv_id", "part", "no", "signature", "costs").mapInArrow(_chained, f"conv_id {kind}, part int, no long, signature string, after string")
    held = stored(held.withColumn("problem", F.concat_ws("|", "signature", "after")).drop("after"), "problems")
    solved = stored(held.select("problem").distinct().mapInArrow(_solved, "problem string, edits array<string>, states array<int>"), "solutions")
    held = followed(held, solved, "problem")

    marked = _marked(rows)
    null = lambda kind: F.lit(None).cast(kind)
    some = [("signature", "string"), ("edits", "array<string>"), ("states", "array<int>")], [("turn", "long"), ("role", "string"), ("text", "string"), ("letter", "string"), ("blank", "boolean"), ("key", "binary")]
    stream = held.select("conv_id", F.lit(0).alias("kind"), "part", "no", *(n for n, _ in some[0]), *(null(t).alias(n) for n, t in some[1]))
    stream = stream.unionByName(marked.select("conv_id", F.lit(1).alias("kind"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("no"), *(null(t).alias(n) for n, t in some[0]), *(n for n, _ in some[1])))
    if conversations is not None:
        every = conversations.select("conv_id").distinct()
        stream = stream.unionByName(every.select("conv_id", F.lit(0).alias("kind"), F.lit(-1).alias("part"), F.lit(0).cast("long").alias("no"), *(null(t).alias(n) for n, t in (*some[0], *some[1]))))
    stream = stream.repartition(spread(rows), "conv_id").sortWithinPartitions("conv_id", "kind", "part", "no", "turn", "role", "key")
    stream = stream.select("conv_id", "kind", *(n for n, _ in some[0]), "turn", "role", "text", "letter", "blank")
    run, names, kinds = _replayed(summaries)
    return stream.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, (kind, *kinds))))


def repair(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), edit (K, R or I), role, text and the turn it had."""
    return _replay(rows, None, False, piece)


def audit(rows: DataFrame, conversations: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation.

    Conversations that have no row left, but are in `conversations`, have zeros and an empty audit.
    """
    return _replay(rows, conversations, True, piece)
