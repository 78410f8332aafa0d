"""Conversation structure repair: the cheapest edits that give the turns' roles the form ``(system? (user assistant)+)?``.

1. Equal rows of a conversation are counted as one line; the first of each role and text is known from a grouping. Every row
   is then a symbol: to be deleted, or an initial (s, u, a, other) with a whole or a truncated text.
2. Lines are ranged by conversation and turn, so a conversation of any length is spread over partitions, in order. What a
   partition holds of a conversation is a piece.
3. Four-Russians tables. The costs to go from the four states of the form (start, after s, after u, after a) differ by at most
   10, so less their minimum they are one of few vectors. For each vector and each block of ``BLOCK`` symbols a table has the
   vector before the block. Pieces are processed from their end by lookups, once for each state behind them: a piece is a
   4 x 4 matrix of costs. The matrices of a conversation, one for each piece, give the vector behind each piece.
4. Tracing. Behind each block its vector is known; the block is expanded backward to the costs between its symbols, and edits
   are chosen forward, at each place the least letter that keeps the cost, which gives the least string of all cheapest. A
   piece is traced for each state it may be entered in; the exits, four numbers a piece, say which entry is real.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import positional, written

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5  # costs; keeping costs nothing, truncated rows that stay cost more
BLOCK = 3  # symbols of a block
START, SYSTEM, USER, ASSISTANT = range(4)
GONE, PAD, SYMBOLS = 0, 9, 10  # 1 + 2 * initial + truncated are between; PAD fills the first block and is no row
INITIALS = "sua"
NEVER = 1 << 20
FILL = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what a user or assistant turn leads to
KEEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
SPACES = " \t\n\x0b\x0c\r"
ROLES = {USER: "user", ASSISTANT: "assistant"}
Vector = tuple[int, ...]


def _inserted(costs: list[int]) -> Vector:
    for _ in range(3):
        costs = [min(c, INSERT + costs[FILL[q]], NEVER) for q, c in enumerate(costs)]
    return tuple(costs)


FINAL = _inserted([0, NEVER, NEVER, 0])  # the empty conversation is right, and so is one that ends with the assistant


def _options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row; inserting comes beside."""
    if symbol == PAD:
        return [("", 0, state)]
    out = [("D", DELETE, state)]
    if symbol != GONE:
        initial, extra = "sua?"[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2)
        if (initial, state) in KEEP:
            out.append(("K", extra, KEEP[initial, state]))
        out.append(("R", REROLE + extra, FILL[state]))
    return out


def _before(symbol: int, behind: Vector) -> Vector:
    """Costs to go before a row, inserting included."""
    if symbol == PAD:
        return behind
    return _inserted([min(c + behind[to] for _, c, to in _options(symbol, q)) for q in range(4)])


def _normal(costs: Vector) -> tuple[Vector, int]:
    least = min(costs)
    return tuple(c - least if c < NEVER else NEVER for c in costs), least


class Tables:
    """Vectors by number; of each vector and symbol, and of each vector and block, the vector before and what is added to the costs."""

    def __init__(self):
        self.vectors: list[Vector] = []
        self.number: dict[Vector, int] = {}
        for v in [FINAL, *[tuple(0 if q == r else NEVER for q in range(4)) for r in range(4)]]:
            self._add(v)
        self.step: list[list[tuple[int, int]]] = []
        while len(self.step) < len(self.vectors):
            v = self.vectors[len(self.step)]
            found = [_normal(_before(s, v)) for s in range(SYMBOLS)]
            self.step.append([(self._add(x), more) for x, more in found])
        self.block = [[self._through(v, code) for code in range(SYMBOLS**BLOCK)] for v in range(len(self.vectors))]
        self.traced: dict[tuple[int, int, int], tuple[str, int]] = {}

    def _add(self, v: Vector) -> int:
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
        return self.number[v]

    def _through(self, v: int, code: int) -> tuple[int, int]:
        total = 0
        for _ in range(BLOCK):
            code, s = divmod(code, SYMBOLS)
            v, more = self.step[v][s]
            total += more
        return v, total

    def codes(self, symbols: bytes) -> list[int]:
        padded = bytes([PAD]) * (-len(symbols) % BLOCK) + symbols
        digits = np.frombuffer(padded, dtype=np.uint8).reshape(-1, BLOCK).astype(np.int64)
        return (digits @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()

    def matrix(self, symbols: bytes) -> list[int]:
        """Costs from each state before the symbols (rows) to each behind them (columns)."""
        columns = []
        for r in range(4):
            v, total = self.number[tuple(0 if q == r else NEVER for q in range(4))], 0
            for code in reversed(self.codes(symbols)):
                v, more = self.block[v][code]
                total += more
            columns.append([min(c + total, NEVER) for c in self.vectors[v]])
        return [columns[r][q] for q in range(4) for r in range(4)]

    def trace(self, symbols: bytes, behind: Vector) -> list[tuple[str, int]]:
        """For each state before the symbols: the least string of cheapest edits, and the state behind them (-1: no way there)."""
        codes = self.codes(symbols)
        at = [self.number[_normal(behind)[0]]]
        for code in reversed(codes):
            at.append(self.block[at[-1]][code][0])
        at.reverse()
        out = []
        for q in range(4):
            letters = []
            for k, code in enumerate(codes):
                if q < 0 or self.vectors[at[k]][q] >= NEVER:
                    q = -1
                    break
                made, q = self._expand(at[k + 1], code, q)
                letters.append(made)
            out.append(("".join(letters) if q >= 0 else "", q))
        return out

    def _expand(self, behind: int, code: int, q: int) -> tuple[str, int]:
        """Edits of one block from state ``q``, and the state behind it."""
        key = (behind, code, q)
        if key not in self.traced:
            symbols = [code // SYMBOLS**k % SYMBOLS for k in range(BLOCK - 1, -1, -1)]
            inside = [(behind, 0)]
            for s in reversed(symbols):
                inside.append(self.step[inside[-1][0]][s])
            inside.reverse()
            letters = ""
            for k, s in enumerate(symbols):
                now, more = self.vectors[inside[k][0]], inside[k][1]
                after = self.vectors[inside[k + 1][0]]
                while True:  # D, I, K, R
                    best = {letter: to for letter, c, to in _options(s, q) if c + after[to] == now[q] + more}
                    if "D" not in best and s != PAD and INSERT + now[FILL[q]] == now[q]:
                        letters, q = letters + "I", FILL[q]
                        continue
                    letter = min(best)
                    letters, q = letters + letter, best[letter]
                    break
            self.traced[key] = letters, q
        return self.traced[key]


@cache
def tables() -> Tables:
    return Tables()


def _closing(q: int) -> str:
    """What is inserted behind the last row."""
    return "I" * (FINAL[q] // INSERT)


# --- rows -------------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text with planted faults, by the crc32 of ``conv_id:turn`` modulo 20 (a null there is one space, as are null roles and texts).

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats the row, 4 makes its role user.
    """
    plain, (conv, turn, role, text) = positional(conversations, conv_col, turn_col, role_col, text_col)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat_ws(":", part(conv), part(turn)).cast("binary")) % 20
    text_ = F.when(k == 1, "").when(k == 2, F.regexp_replace(part(text), "[.!?]", "")).otherwise(part(text))
    rows = plain.filter(k != 0).select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.when(k == 4, "user").otherwise(part(role)).alias("role"), text_.alias("text"), F.when(k == 3, 2).otherwise(1).alias("times")
    )
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def _name(conv: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def _lines(rows: DataFrame) -> DataFrame:
    """Different rows in order: conv, part, seq, turn, role, text, m (equal rows), blank, fresh (one of them is the first of its kind), truncated."""
    digest = [F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")]
    lines = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("m")).withColumns({"d1": digest[0], "d2": digest[1]})
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = written(lines.groupBy("conv", "role", "d1", "d2").agg(F.min(when).alias("first")), "repair-first")
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    blank = end == ""
    lines = lines.join(first, ["conv", "role", "d1", "d2"]).withColumns({
        "blank": blank, "fresh": ~blank & (when == F.col("first")), "truncated": ~blank & ~F.substring(end, -1, 1).isin(".", "!", "?"),
    }).drop("d1", "d2", "first")
    order = ["conv", F.asc_nulls_first("turn"), "role"]
    lines = lines.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    return written(lines.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "repair-lines")


def _schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def _symbols(piece: list[dict]) -> bytes:
    """A symbol for each row of a piece."""
    out = bytearray()
    for line in piece:
        kept = 1 if line["fresh"] else 0
        if kept:
            initial = INITIALS.find(line["initial"]) if line["initial"] else -1
            out.append(1 + 2 * (initial if initial >= 0 else 3) + line["truncated"])
        out += bytes([GONE]) * (line["m"] - kept)
    return bytes(out)


LEGAL = {"su", "ua", "au"}
SUMMARY = "conv string, part int, matrix array<int>, head string, tail string, illegal long, symbols binary"


def _summary_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(conv=pa.string(), part=pa.int32(), matrix=pa.list_(pa.int32()), head=pa.string(), tail=pa.string(), illegal=pa.int64(), symbols=pa.binary())
    for batch in batches:
        out = []
        for conv, part, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            symbols = _symbols(lines)
            initials = [x["initial"] for x in lines]
            illegal = sum(x["m"] - 1 for x in lines) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            out.append({"conv": conv, "part": part, "matrix": tables().matrix(symbols), "head": initials[0], "tail": initials[-1], "illegal": illegal, "symbols": symbols})
        yield pa.RecordBatch.from_pylist(out, schema)


WHOLE = "conv string, illegal long, cost long, parts array<struct<part: int, behind: array<int>>>"


def _whole_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the matrices of a conversation's pieces: its cost, and the costs to go behind each piece."""
    schema = _schema(conv=pa.string(), illegal=pa.int64(), cost=pa.int64(), parts=pa.list_(pa.struct([("part", pa.int32()), ("behind", pa.list_(pa.int32()))])))
    for batch in batches:
        out = []
        for conv, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            go, total, parts = FINAL, 0, []
            for piece in reversed(pieces):
                parts.append({"part": piece["part"], "behind": list(go)})
                m = piece["matrix"]
                go, more = _normal(tuple(min(min(m[4 * q + r] + go[r], NEVER) for r in range(4)) for q in range(4)))
                total += more
            illegal = sum(p["illegal"] for p in pieces) + sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(pieces, pieces[1:], strict=False))
            out.append({"conv": conv, "illegal": illegal, "cost": go[START] + total, "parts": parts})
        yield pa.RecordBatch.from_pylist(out, schema)


TRACED = "conv string, part int, exits array<int>, audits array<string>"


def _trace_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(conv=pa.string(), part=pa.int32(), exits=pa.list_(pa.int32()), audits=pa.list_(pa.string()))
    for batch in batches:
        out = []
        for conv, part, symbols, behind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = tables().trace(symbols, tuple(behind))
            out.append({"conv": conv, "part": part, "exits": [q for _, q in found], "audits": [a for a, _ in found]})
        yield pa.RecordBatch.from_pylist(out, schema)


ENTRIES = "conv string, parts array<struct<part: int, entry: int, closing: string>>"


def _entry_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each piece of a conversation is entered, and what follows the last."""
    schema = _schema(conv=pa.string(), parts=pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("closing", pa.string())])))
    for batch in batches:
        out = []
        for conv, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            q, parts = START, []
            for piece in pieces:
                parts.append({"part": piece["part"], "entry": q, "closing": ""})
                q = piece["exits"][q]
            parts[-1]["closing"] = _closing(q)
            out.append({"conv": conv, "parts": parts})
        yield pa.RecordBatch.from_pylist(out, schema)


EDITS = "conv string, seq long, k int, edit string, new_role string, times long"


def _edit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of a piece by line: ``k`` orders those of one line; equal rows that go are one edit."""
    schema = _schema(conv=pa.string(), seq=pa.int64(), k=pa.int32(), edit=pa.string(), new_role=pa.string(), times=pa.int64())
    for batch in batches:
        out: list[dict] = []
        for conv, lines, audit, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = 0
            for i, line in enumerate(lines):
                left, k = line["m"], 0
                while left or (i == len(lines) - 1 and at < len(audit)):
                    edit, n, role = audit[at], 1, None
                    if edit == "D":
                        while n < left and audit[at + n] == "D":
                            n += 1
                    elif edit == "K":
                        q = KEEP[line["initial"], q]
                    else:
                        q = FILL[q]
                        role = ROLES[q]
                    out.append({"conv": conv, "seq": line["seq"], "k": k, "edit": edit, "new_role": role, "times": n})
                    left, k, at = left - n * (edit != "I"), k + 1, at + n
        yield pa.RecordBatch.from_pylist(out, schema)


def _pieces(df: DataFrame, *columns: str) -> DataFrame:
    """conv and what its pieces have, in their order: as many entries as a conversation has pieces."""
    return df.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", *columns))).alias("pieces"))


def _repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines; whole: conv, illegal, cost; audits: conv, part, audit; edits)."""
    lines = _lines(rows)
    line = F.struct("seq", "m", "fresh", "truncated", F.substring("role", 1, 1).alias("initial"))
    pieces = lines.groupBy("conv", "part").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    held = written(pieces.mapInArrow(_summary_task, SUMMARY), "repair-pieces")
    whole = written(_pieces(held, "matrix", "head", "tail", "illegal").mapInArrow(_whole_task, WHOLE), "repair-whole")
    behind = whole.select("conv", F.inline("parts"))
    traced = held.select("conv", "part", "symbols").join(behind, ["conv", "part"]).mapInArrow(_trace_task, TRACED)
    traced = written(traced, "repair-traced")
    entries = _pieces(traced, "exits").mapInArrow(_entry_task, ENTRIES).select("conv", F.inline("parts"))
    chosen = F.concat(F.get("audits", F.col("entry")), "closing")
    audits = written(traced.join(entries, ["conv", "part"]).select("conv", "part", "entry", chosen.alias("audit")), "repair-audits")
    edits = pieces.join(audits, ["conv", "part"]).select("conv", "lines", "audit", "entry").mapInArrow(_edit_task, EDITS)
    return lines, whole.select("conv", "illegal", "cost"), audits, written(edits, "repair-edits")


def _named(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    plain, (conv, turn, role, text) = positional(conversations, conv_col, turn_col, role_col, text_col)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias
    return plain.select(_name(F.col(conv)).alias("conv"), F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), part(role)("role"), part(text)("text"))


def repaired(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edits as rows, in the order of (conv_id, seq, k): conv_id, seq, k, edit (K, R, D, I), times, turn, role, text.

    ``role`` and ``text`` are what the row says after the edit; inserted rows have the text of none, deleted rows have what
    went, ``times`` of them. The semantics are those of ``report``.
    """
    rows = _named(conversations, conv_col, turn_col, role_col, text_col)
    lines, _, _, edits = _repair(rows.drop("conv_id"))
    ids = rows.select("conv", "conv_id").distinct()
    return _with_lines(edits, lines).join(ids, "conv").select("conv_id", "seq", "k", "edit", "times", "turn", "role", "text")


def _with_lines(edits: DataFrame, lines: DataFrame) -> DataFrame:
    found = edits.join(lines.select("seq", "turn", "role", "text"), "seq")
    inserted = F.col("edit") == "I"
    text = F.when(inserted, "").otherwise(F.col("text"))
    turn = F.when(~inserted, F.col("turn"))
    return found.withColumns({"role": F.coalesce("new_role", "role"), "text": text, "turn": turn}).drop("new_role")


def _digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's lines, read in order and never held."""
    schema = _schema(conv=pa.string(), repaired_sha256=pa.string())
    name, digest = None, None
    for batch in batches:
        out = []
        for conv, role, text in zip(*batch.columns, strict=True):
            conv = conv.as_py()
            if conv != name:
                if digest is not None:
                    out.append((name, digest.hexdigest()))
                name, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role.as_py()}:{text.as_py()}".encode())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"conv": name, "repaired_sha256": digest.hexdigest()}], schema)


def report(conversations: DataFrame, known: DataFrame | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation of ``known`` or of the table.

    Rows are taken by turn, null turns first, then by role and text. Null roles and texts are one space. A row without any
    character but spaces and control characters 9 to 13 is blank; else one whose role and text the conversation had before
    is a duplicate; else one that does not end with ``.``, ``!`` or ``?`` is truncated. Keeping costs 0, a new role 1, deleting 2,
    inserting a user or an assistant 5, a truncated row that stays 5 more; blank and duplicate rows are deleted. ``audit`` has
    the letters of the cheapest edits, the least string of them. A null id is a conversation of its own; one without rows
    has zeros, no audit and the hash of nothing; an empty table gives an empty result. Other columns are ignored.

    A conversation of any number of rows is spread over tasks, but for the hash of its text, which one task reads as a
    stream, and its audit, which is one string.
    """
    rows = _named(conversations, conv_col, turn_col, role_col, text_col)
    ids = rows.select("conv", "conv_id") if known is None else known.select(_name(F.col(f"`{conv_col}`")).alias("conv"), F.col(f"`{conv_col}`").alias("conv_id"))
    lines, whole, audits, edits = _repair(rows.drop("conv_id"))
    turns = lines.filter("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    lost = F.col("m") - F.col("fresh").cast("long")
    counts = lines.groupBy("conv").agg(
        F.sum(F.when(F.col("blank"), F.col("m")).otherwise(0)).alias("blank"), F.sum(F.when(F.col("blank"), 0).otherwise(lost)).alias("duplicate"),
        F.sum((F.col("fresh") & F.col("truncated")).cast("long")).alias("truncated"),
    )
    audit = audits.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    kept = _with_lines(edits.filter("edit <> 'D'"), lines).select("conv", "seq", "k", "role", "text")
    digests = kept.repartition("conv").sortWithinPartitions("conv", "seq", "k").select("conv", "role", "text").mapInArrow(_digest_task, "conv string, repaired_sha256 string")
    out = ids.distinct()
    for part in (turns, counts, whole, audit, digests):
        out = out.join(part, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("conv_id").alias(conv_col), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
