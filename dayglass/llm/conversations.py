"""Operator 13: repair of conversation structure, by min-plus matrices over a Re-Pair grammar.

A conversation's rows in order are a word over nine signs (who speaks, and whether the row
is whole, cut off, or must go). A sign is a 4 x 4 matrix in the (min, +) algebra over the
states of the grammar `(s?(ua)+)?`: the least cost of editing the row on the way from one
state to another, with the edits as a rope. Re-Pair replaces frequent pairs of signs by
symbols, counted over all conversations in Spark; a symbol's matrix is the product of its
two, made once and used wherever the symbol occurs. Costs tie to the ASCII-least edits:
edits of the same rows from the same state are never prefixes of one another (each ends
with its last row's edit), so the least of a product is the product of the least.

Long conversations are cut into chunks of bounded size; each becomes one matrix in its own
task. One task per long conversation then walks over its chunks (the hash of the repaired
text is sequential by nature), in bounded memory but for the edits that it returns.

Defined results: null role, text, turn and conv_id count as one space where they are read
as text; turns are ordered nulls first; rows of one turn are ordered by role and
MD5 of the text after damage, so repeated rows are adjacent. Equal rows count each. Rows whose role starts with
none of s, u, a can only be deleted or get another role. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.llm.common import shuffle_tasks, stored

SPACES = " \t\n\x0b\x0c\r"

#: States: nothing yet, after the system row, after a user row, after an assistant row.
STATES, FINAL = range(4), (0, 3)
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLES = {"u": "user", "a": "assistant"}
#: Signs: `x` must go; `s`, `u`, `a`, `o` (another role) are whole rows, capitals are cut off.
SIGNS = "xsuaoSUAO"


@dataclass(frozen=True)
class Costs:
    """What an edit costs, and what a cut-off row that stays adds."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    cut_off: int = 5


@dataclass(frozen=True)
class Grammar:
    """Re-Pair: rounds over all sequences, rules a round, occurrences that make a rule."""

    rounds: int = 6
    rules: int = 48
    least: int = 2


class Rope:
    """Edits as a concatenation that is only written out where they are compared or returned."""

    __slots__ = ("parts", "flat")

    def __init__(self, flat: str | None = None, parts: tuple[Rope, Rope] | None = None) -> None:
        self.flat, self.parts = flat, parts

    def __str__(self) -> str:
        if self.flat is None:
            out, stack = [], [self]
            while stack:
                rope = stack.pop()
                if rope.flat is not None:
                    out.append(rope.flat)
                else:
                    stack += reversed(rope.parts)
            self.flat, self.parts = "".join(out), None
        return self.flat


#: {(from, to): (cost, edits)}; a missing entry cannot be reached.
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def _better(new: tuple[int, Rope], old: tuple[int, Rope] | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and str(new[1]) < str(old[1]))


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (cost, edits) in a.items():
        for j in STATES:
            if (k, j) in b:
                new = (cost + b[k, j][0], Rope(parts=(edits, b[k, j][1])))
                if _better(new, out.get((i, j))):
                    out[i, j] = new
    return out


def inserts(costs: Costs) -> Matrix:
    """The cheapest insertions between two rows; more than two are never needed."""
    one = {(i, j): (costs.insert, Rope("I")) for role in "ua" for i, j in MOVES[role].items()}
    none: Matrix = {(i, i): (0, Rope("")) for i in STATES}
    return {**times(one, one), **one, **none}


def sign_matrix(sign: str, costs: Costs) -> Matrix:
    """Insertions, then the edit of one row."""
    out: Matrix = {(i, i): (costs.delete, Rope("D")) for i in STATES}
    if sign != "x":
        stay = costs.cut_off if sign.isupper() else 0
        edits = [(j, i, costs.rerole + stay, "R") for role in "ua" for i, j in MOVES[role].items()]
        edits += [(j, i, stay, "K") for i, j in MOVES.get(sign.lower(), {}).items()]
        for j, i, cost, edit in edits:
            if _better((cost, Rope(edit)), out.get((i, j))):
                out[i, j] = (cost, Rope(edit))
    return times(inserts(costs), out)


def matrices(rules: Sequence[tuple[str, str]], costs: Costs) -> dict[str, Matrix]:
    """The matrix of every sign, and bottom-up of every rule's symbol."""
    known = {sign: sign_matrix(sign, costs) for sign in SIGNS}
    for symbol, (left, right) in rules:
        known[symbol] = times(known[left], known[right])
    return known


def product(sequence: str, rules, known: dict[str, Matrix]) -> Matrix:
    """The matrix of a whole sequence: its symbols' matrices, multiplied in pairs."""
    level = [known[symbol] for symbol in compress(sequence, rules)]
    while len(level) > 1:
        level = [times(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def compress(sequence: str, rules) -> str:
    for symbol, pair in rules:
        sequence = sequence.replace("".join(pair), symbol)
    return sequence


def _compatible(counts: list[tuple[str, int]], most: int) -> list[str]:
    """Frequent pairs whose occurrences cannot overlap, the most frequent first."""
    lefts, rights, chosen = set(), set(), []
    for pair, _ in counts:
        a, b = pair
        if a == b and a not in lefts | rights or a != b and a not in rights and b not in lefts:
            chosen.append(pair)
            lefts.add(a)
            rights.add(b)
        if len(chosen) == most:
            break
    return chosen


def learn_grammar(sequences: DataFrame, g: Grammar) -> list[tuple[str, tuple[str, str]]]:
    """Rules (symbol, (left, right)) from a table (signs, times); at most rounds * rules.

    Pairs are counted over all sequences, each distinct one once with its number. Another
    grammar changes the work, never a result.
    """
    rules: list[tuple[str, tuple[str, str]]] = []
    for _ in range(g.rounds):
        now = tuple(rules)

        def pairs(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            found: Counter[str] = Counter()
            for batch in batches:
                for signs, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    short = compress(signs, now)
                    for a, b in zip(short, short[1:]):
                        found[a + b] += n
            schema = pa.schema([("pair", pa.string()), ("n", pa.int64())])
            yield pa.RecordBatch.from_pylist([{"pair": p, "n": n} for p, n in found.items()], schema)

        counts = sequences.mapInArrow(pairs, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        # at most the square of the symbols so far
        top = counts.where(F.col("n") >= g.least).orderBy(F.desc("n"), "pair").limit(4 * g.rules).collect()
        chosen = _compatible([(r["pair"], r["n"]) for r in top], g.rules)
        if not chosen:
            break
        rules += [(chr(0x100 + len(rules) + k), (pair[0], pair[1])) for k, pair in enumerate(chosen)]
    return rules


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after damage by the CRC-32 of `conv_id:turn`, modulo 20."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text, role = _text("text"), _text("role")
    return rows.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text")).where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _faults(role: str, text: str, copies: int, first: bool) -> tuple[str, int, int, int]:
    """Signs of `copies` equal rows, and how many are blank, duplicate and cut off."""
    end = text.rstrip(SPACES)[-1:]
    if not end:
        return "x" * copies, copies, 0, 0
    if not first:
        return "x" * copies, 0, copies, 0
    sign = role[:1] if role[:1] in ("s", "u", "a") else "o"
    cut = end not in ".!?"
    return (sign.upper() if cut else sign) + "x" * (copies - 1), 0, copies - 1, int(cut)


@dataclass(frozen=True)
class Bounds:
    """Rows and characters of text after which a chunk ends."""

    rows: int = 1024
    chars: int = 4 << 20


CHUNK = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("alone", pa.bool_()), ("signs", pa.string())]
    + [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("runs", pa.list_(pa.int64()))]
    + [(c, pa.int64()) for c in ("turns", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal")]
    + [("first_role", pa.string()), ("last_role", pa.string())]
)
CHUNK_SQL = (
    "conv_id bigint, part bigint, seq bigint, alone boolean, signs string, roles array<string>, texts array<string>, runs array<bigint>, "
    "turns bigint, first_turn bigint, last_turn bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string"
)


def legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


def _chunk(conv_id, part: int, seq: int, rows: list[tuple]) -> dict:
    signs, blank, duplicate, cut, illegal = [], 0, 0, 0, 0
    last = None
    for _, role, text, copies, first in rows:
        one, b, d, c = _faults(role, text, copies, first)
        signs.append(one)
        blank, duplicate, cut = blank + b, duplicate + d, cut + c
        illegal += (copies - 1) * (not legal(role, role)) + (last is not None and not legal(last, role))
        last = role
    turns = [r[0] for r in rows if r[0] is not None]
    return {
        "conv_id": conv_id, "part": part, "seq": seq, "alone": False, "signs": "".join(signs),
        "roles": [r[1] for r in rows], "texts": [r[2] for r in rows], "runs": [r[3] for r in rows],
        "turns": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "blank": blank, "duplicate": duplicate, "truncated": cut, "illegal": illegal, "first_role": rows[0][1], "last_role": last,
    }


def _cut(batches: Iterator[pa.RecordBatch], bounds: Bounds) -> Iterator[dict]:
    """Chunks of a partition's rows, which come in order; conversations that end inside it may be alone."""
    part, seq = TaskContext.get().partitionId(), 0
    rows: list[tuple] = []
    signs = chars = 0
    now, inner, done = None, False, 0  # conversation, does it start inside the partition, its chunks so far
    for batch in batches:
        for conv_id, turn, role, text, copies, first in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and conv_id != now:
                yield {**_chunk(now, part, seq, rows), "alone": inner and not done}
                rows, signs, chars, inner, done, seq = [], 0, 0, True, 0, seq + 1
            now = conv_id
            while copies:
                if signs >= bounds.rows or chars >= bounds.chars:
                    yield _chunk(now, part, seq, rows)
                    rows, signs, chars, done, seq = [], 0, 0, done + 1, seq + 1
                some = min(copies, bounds.rows - signs)
                rows.append((turn, role, text, some, bool(first)))
                copies, first, signs, chars = copies - some, 0, signs + some, chars + len(text)
    if rows:
        yield _chunk(now, part, seq, rows)


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def chunks(rows: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """The damaged rows in order, in chunks of bounded size that are numbered by (part, seq).

    Equal rows are counted before any shuffle; the first of a conversation's rows of one
    role and text is found by an aggregate, not by gathering them.
    """
    key = ["conv_id", "turn", "role", "mark"]
    hurt = damaged(rows).withColumn("mark", F.unhex(F.md5(F.col("text").cast("binary"))))
    # texts stay out of this: their digests tell them apart
    earliest = hurt.groupBy("conv_id", "role", "mark").agg(F.bool_or(F.col("turn").isNull()).alias("any"), F.min("turn").alias("turn"))
    earliest = earliest.select(
        "conv_id", F.when(~F.col("any"), F.col("turn")).alias("turn"), "role", F.lit(None).cast("string").alias("text"),
        F.lit(0).cast("bigint").alias("copies"), "mark", F.lit(1).alias("first"),
    )
    both = hurt.withColumn("first", F.lit(0)).unionByName(earliest)
    counted = both.groupBy(*key).agg(F.max("text").alias("text"), F.sum("copies").alias("copies"), F.max("first").alias("first"))
    # ordered by digests, so that no text is a sample of the ranges
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("mark")]
    ranged = counted.repartitionByRange(shuffle_tasks(rows.sparkSession), *order)
    ordered = ranged.sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies", "first")
    return ordered.mapInArrow(lambda batches: _batches(_cut(batches, bounds), CHUNK), CHUNK_SQL)


def replay(edits: str, state: int, row: dict) -> list[str]:
    """The repaired `role:text` rows of a chunk by its edits from a state."""
    out = []
    place, left = 0, row["runs"][0] if row["runs"] else 0
    for edit in edits:
        if edit == "I":
            needed = "a" if state == 2 else "u"
            out.append(f"{ROLES[needed]}:")
            state = MOVES[needed][state]
            continue
        while not left:
            place += 1
            left = row["runs"][place]
        left -= 1
        if edit == "D":
            continue
        role = row["roles"][place]
        sign = role[:1]
        if edit == "R":
            sign = "a" if state == 2 else "u"
            role = ROLES[sign]
        out.append(f"{role}:{row['texts'][place]}")
        state = MOVES[sign][state]
    return out


@dataclass
class Path:
    """The best way to a state: cost, place among the ways to other states, edits, repaired text so far."""

    cost: int
    rank: int
    edits: Rope
    digest: object
    empty: bool

    def onward(self, cost: int, rank: int, edits: str, rows: list[str]) -> Path:
        digest = self.digest.copy()
        if rows:
            digest.update(("" if self.empty else "\n").encode() + "\n".join(rows).encode("utf-8", "surrogatepass"))
        return Path(cost, rank, Rope(parts=(self.edits, Rope(edits))), digest, self.empty and not rows)


def _walk(paths: dict[int, Path], chunk: dict, moves: Matrix, end: Matrix | None) -> dict[int, Path]:
    """The paths behind a chunk; with `end`, the insertions behind the last row, only the best one."""
    ways: dict[int, list] = {}
    for (i, j), (cost, edits) in moves.items():
        if i not in paths:
            continue
        for f in (j,) if end is None else FINAL:
            after = (0, "") if end is None else (end[j, f][0], str(end[j, f][1])) if (j, f) in end else None
            if after:
                ways.setdefault(f, []).append((paths[i].cost + cost + after[0], paths[i].rank, str(edits) + after[1], i))
    best = {f: min(found) for f, found in ways.items()}
    if end is not None:
        f = min(best, key=lambda f: best[f])
        best = {f: best[f]}
    ranks = {f: k for k, f in enumerate(sorted(best, key=lambda f: best[f][1:3]))}
    return {f: paths[i].onward(cost, ranks[f], edits, replay(edits, i, chunk)) for f, (cost, _, edits, i) in best.items()}


RESULT = pa.schema(
    [("conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
RESULT_SQL = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _result(parts: Iterator[tuple[dict, Matrix]], end: Matrix) -> dict:
    """One conversation from its chunks in order; only the chunk before the present one is held."""
    paths = {0: Path(0, 0, Rope(""), hashlib.sha256(), True)}
    sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    low = high = last = None
    held = None
    for chunk, moves in parts:
        for c in sums:
            sums[c] += chunk[c]
        if last is not None:
            sums["illegal"] += not legal(last, chunk["first_role"])
        if chunk["first_turn"] is not None:
            sums["turns"] -= high == chunk["first_turn"]
            low, high = chunk["first_turn"] if low is None else low, chunk["last_turn"]
        last = chunk["last_role"]
        if held is not None:
            paths = _walk(paths, *held, None)
        held = (chunk, moves)
    (best,) = _walk(paths, *held, end).values()
    gaps = 0 if low is None else high - low + 1 - sums.pop("turns")
    return {
        "conv_id": held[0]["conv_id"], "gaps": gaps, **{c: n for c, n in sums.items() if c != "turns"},
        "cost": best.cost, "audit": str(best.edits), "repaired_sha256": best.digest.hexdigest(),
    }


MOVES_SQL = f"{CHUNK_SQL}, moves array<struct<i:int,j:int,cost:bigint,edits:string>>"
_MOVE = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])


def repaired(cut: DataFrame, rules: list[tuple[str, tuple[str, str]]], costs: Costs = Costs()) -> DataFrame:
    """One row of every conversation that has chunks: counts, cost, edits, hash of the repaired text."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known, end = matrices(rules, costs), inserts(costs)
        for batch in batches:
            for row in batch.to_pylist():
                yield _result(iter([(row, product(row["signs"], rules, known))]), end)

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = matrices(rules, costs)
        for batch in batches:
            for row in batch.to_pylist():
                moves = product(row["signs"], rules, known)
                yield {**row, "moves": [{"i": i, "j": j, "cost": c, "edits": str(e)} for (i, j), (c, e) in moves.items()]}

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        end = inserts(costs)
        rows = (row for batch in batches for part in (batch.slice(k, 16) for k in range(0, batch.num_rows, 16)) for row in part.to_pylist())
        for _, group in groupby(rows, key=lambda row: row["conv_id"]):
            yield _result(((row, {(m["i"], m["j"]): (m["cost"], Rope(m["edits"])) for m in row["moves"]}) for row in group), end)

    short = cut.where("alone").mapInArrow(lambda b: _batches(whole(b), RESULT), RESULT_SQL)
    schema = pa.schema([*CHUNK, pa.field("moves", pa.list_(_MOVE))])
    pieces = cut.where("not alone").mapInArrow(lambda b: _batches(piece(b), schema), MOVES_SQL)
    ordered = pieces.repartition(shuffle_tasks(cut.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return short.unionByName(ordered.mapInArrow(lambda b: _batches(joined(b), RESULT), RESULT_SQL))


def repair(conversations: DataFrame, costs: Costs = Costs(), grammar: Grammar = Grammar(), bounds: Bounds = Bounds()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    cut = stored(chunks(rows, bounds), "conversation-chunks")
    sequences = stored(cut.groupBy("signs").agg(F.count("*").alias("times")), "sequences")
    found = repaired(cut, learn_grammar(sequences, grammar), costs)
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
