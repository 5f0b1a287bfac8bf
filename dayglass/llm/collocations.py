"""Operator 12: phrases of two to four words that occur more often than their parts let expect.

Level by level: the frequent words of each language get ids by falling frequency, and pairs
of neighbouring ids are counted in tiles of a pair matrix. Tiles of the most frequent ids
are counted densely with bincount, the others as sorted (code, count) lists. Pairs that are
frequent enough become ids themselves, ranked anew, and neighbouring pairs that overlap are
the phrases of three words, those the phrases of four. A phrase occurs at most as often as
its parts, so nothing frequent is missed.

Every task counts its tiles before anything is shuffled; sums go over two steps, so that the
hottest tile is not read by one task from all others. At most `Mining.ranked` ids a level
are broadcast. If a level has more, the others are known by a filter of fixed size and
counted as plain pairs of hashes, which is slower but as exact.

Words and phrases are told apart by 64-bit hashes that include the language.

Defined results: null text is empty, null lang is `und` (and one with a lang of that name);
rows are counted each, also equal ones and those without doc_id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayglass.llm.byte_words import Words, by_bytes, byte_classes, words
from dayglass.llm.common import shuffle_tasks, stored
from dayglass.llm.words import mix

CLASSES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Ids of a dense tile's side; ids below DENSE_IDS have dense tiles. Strips of the others.
SIDE, DENSE_IDS, STRIPS = 1 << 11, 1 << 13, 64
#: Pairs that a task holds before it counts them, and words that it counts before it sends them.
HELD, WORDS_HELD = 3 << 19, 60_000
#: Bits of the filter of symbols without a rank, and the parts in which it is made.
FILTER_BITS, FILTER_PARTS = 1 << 26, 16
#: First step of the sums: tasks of the scan that one of its tasks reads, as a share.
SALTS = 8


@dataclass(frozen=True)
class Mining:
    """Words of the longest phrase; least occurrences; phrases a language; containment in percent; broadcast ids a level."""

    longest: int = 4
    least: int = 30
    top: int = 2000
    contained: int = 80
    ranked: int = 1 << 20


class Ranks:
    """Symbols by falling frequency and a direct-address table to find their ranks."""

    def __init__(self, symbols: np.ndarray, others: np.ndarray | None = None) -> None:
        self.symbols, self.others = symbols.astype("u8"), others
        bits = max(4, int(2 * len(symbols)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, "i4")
        self.slots[(self.symbols >> self.shift)] = np.arange(len(symbols), dtype="i4")
        self.order = np.argsort(self.symbols)
        self.ascending = self.symbols[self.order]

    def of(self, symbols: np.ndarray) -> np.ndarray:
        """Rank; -1 if infrequent; -2 if only the filter of the others holds it."""
        if not len(self.symbols):
            return np.full(len(symbols), -1, "i4")
        rank = self.slots[symbols >> self.shift]
        wrong = np.flatnonzero((rank >= 0) & (self.symbols[rank] != symbols))
        # two symbols of one slot: search for the one that it does not hold
        place = np.minimum(np.searchsorted(self.ascending, symbols[wrong]), len(self.ascending) - 1)
        rank[wrong] = np.where(self.ascending[place] == symbols[wrong], self.order[place], -1)
        if self.others is not None:
            unknown = np.flatnonzero(rank < 0)
            bit = mix(symbols[unknown]) % np.uint64(FILTER_BITS)
            held = (self.others[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype("u1")) & 1
            rank[unknown[held == 1]] = -2
        return rank


def language_marks(langs: list[str]) -> np.ndarray:
    known = {lang: xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")) for lang in set(langs)}
    return np.array([known[lang] for lang in langs], "u8")


def symbols_of(found: Words, langs: list[str]) -> np.ndarray:
    return mix(found.hashes ^ language_marks(langs)[found.rows]) if len(found.hashes) else found.hashes


def longer(symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The symbol of a phrase from that of all but its last word, and its last word's."""
    return mix(symbols * np.uint64(0xA0761D6478BD642F) + last)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, symbol, f of every word; counted within each task first."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("symbol", pa.int64()), ("f", pa.int64())])

    def sent(counts: dict[int, int], names: dict[int, tuple[str, bytes]]) -> pa.RecordBatch:
        columns = [
            pa.array([names[s][0] for s in counts], pa.string()), pa.array([names[s][1] for s in counts], pa.binary()).cast(pa.string()),
            pa.array(np.array(list(counts), "u8").view("i8")), pa.array(list(counts.values()), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        names: dict[int, tuple[str, bytes]] = {}
        for batch in by_bytes(batches, "text"):
            langs = batch.column(0).to_pylist()
            found = words(batch.column(1), CLASSES)
            some, first, n = np.unique(symbols_of(found, langs), return_index=True, return_counts=True)
            for symbol, k, times in zip(some.tolist(), first.tolist(), n.tolist()):
                if symbol in counts:
                    counts[symbol] += times
                else:
                    counts[symbol] = times
                    names[symbol] = (langs[found.rows[k]], found.raw[found.starts[k] : found.ends[k]].tobytes())
            if len(counts) > WORDS_HELD:
                yield sent(counts, names)
                counts, names = {}, {}
        if counts:
            yield sent(counts, names)

    rows = _rows(docs).mapInArrow(run, "lang string, word string, symbol bigint, f bigint")
    return rows.groupBy("lang", "word", "symbol").agg(F.sum("f").alias("f"))


def ranks(level: DataFrame, m: Mining) -> tuple[Ranks, bool]:
    """The most frequent symbols of a level table in order; and whether there are others."""
    n = level.count()
    top = level.orderBy(F.desc("f"), "symbol").limit(m.ranked).select("symbol").toArrow()
    symbols = top.column(0).to_numpy().view("u8")
    return Ranks(symbols, symbol_filter(level) if n > m.ranked else None), n > m.ranked


def symbol_filter(level: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set for every symbol of the table."""
    width = FILTER_BITS // FILTER_PARTS // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(mix(batch.column(0).to_numpy().view("u8")) % np.uint64(FILTER_BITS)).astype("i8")
            yield pa.RecordBatch.from_arrays([pa.array(bit // (8 * width)), pa.array(bit)], ["part", "bit"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            bits = batch.column(1).to_numpy()
            for part in np.unique(bits // (8 * width)).tolist():
                one = held.setdefault(part, np.zeros(8 * width, bool))
                one[bits[bits // (8 * width) == part] - part * 8 * width] = True
        rows = [{"part": part, "bits": np.packbits(one, bitorder="little").tobytes()} for part, one in held.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int64()), ("bits", pa.binary())]))

    placed = level.select("symbol").mapInArrow(run, "part bigint, bit bigint").distinct()
    out = np.zeros(FILTER_BITS // 8, "u1")
    for row in placed.repartition(FILTER_PARTS, "part").mapInArrow(join, "part bigint, bits binary").collect():
        out[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["bits"], "u1")
    return out


#: Bits of a code within its tile; the tile's number is above them.
CODE_BITS = 32


def tiled(left: np.ndarray, right: np.ndarray, ids: int) -> np.ndarray:
    """Tile and code within it of each pair of ranks, in one number. Dense tiles come first."""
    side, strip = DENSE_IDS // SIDE, -(-ids // STRIPS)
    left, right = left.astype("i8"), right.astype("i8")
    dense = (left < DENSE_IDS) & (right < DENSE_IDS)
    tile = np.where(dense, (left // SIDE) * side + right // SIDE, side * side + (left // strip) * STRIPS + right // strip)
    width = np.where(dense, SIDE, strip)
    return (tile << CODE_BITS) + (left % width) * width + right % width


def untiled(tile: int, code: np.ndarray, ids: int) -> tuple[np.ndarray, np.ndarray]:
    side = DENSE_IDS // SIDE
    width = SIDE
    if tile >= side * side:
        tile, side, width = tile - side * side, STRIPS, -(-ids // STRIPS)
    return (tile // side) * width + code // width, (tile % side) * width + code % width


def counted(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Codes and their counts, tile by tile: by bincount, or as runs of the sorted codes."""
    first_sparse = (DENSE_IDS // SIDE) ** 2 << CODE_BITS
    dense = keys[keys < first_sparse]
    for t in np.unique(dense >> CODE_BITS).tolist():
        cells = np.bincount(dense[dense >> CODE_BITS == t] & ((1 << CODE_BITS) - 1))
        some = np.flatnonzero(cells)
        yield t, some, cells[some]
    sparse = np.sort(keys[keys >= first_sparse])
    if not len(sparse):
        return
    new = np.flatnonzero(np.r_[True, sparse[1:] != sparse[:-1]])
    n = np.diff(np.r_[new, len(sparse)])
    sparse = sparse[new]
    tile, code = sparse >> CODE_BITS, sparse & ((1 << CODE_BITS) - 1)
    starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(tile)]):
        yield int(tile[a]), code[a:b], n[a:b]


def packed(code: np.ndarray, count: np.ndarray) -> tuple[int, bytes]:
    """Ascending codes as steps, and counts, compressed."""
    steps = np.diff(code, prepend=0).astype("<i8").tobytes() + count.astype("<i8").tobytes()
    return len(code), pa.compress(steps, codec="zstd", asbytes=True)


def unpacked(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(data, decompressed_size=16 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, "<i8", n)), np.frombuffer(raw, "<i8", n, 8 * n)


PAIRS = pa.schema([("tile", pa.int64()), ("salt", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("left", pa.int64()), ("right", pa.int64())])
PAIRS_SQL = "tile bigint, salt bigint, n bigint, data binary, left bigint, right bigint"


def _tile_batch(tile: int, salt: int, code: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    n, data = packed(code, count)
    return pa.RecordBatch.from_pylist([{"tile": tile, "salt": salt, "n": n, "data": data}], PAIRS)


def pairs(docs: DataFrame, known: list[Broadcast]) -> DataFrame:
    """Neighbouring symbols of the last level in `known`: tiles of counts, or pairs of hashes with n."""

    def flush(keys: list[np.ndarray], salt: int) -> Iterator[pa.RecordBatch]:
        for tile, codes, counts in counted(np.concatenate(keys)):
            yield _tile_batch(tile, salt, codes, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [t.value for t in known]
        salt = TaskContext.get().partitionId() % SALTS
        ids = len(tables[-1].symbols)
        keys, held = [], 0
        for batch in by_bytes(batches, "text"):
            found = words(batch.column(1), CLASSES)
            single = symbols = symbols_of(found, batch.column(0).to_pylist())
            rank = tables[0].of(symbols)
            joined = (found.rows[1:] == found.rows[:-1]) & (found.pieces[1:] == found.pieces[:-1])
            for k, table in enumerate(tables[1:], 2):
                alive = (rank[:-1] != -1) & (rank[1:] != -1)
                alive &= joined if k == 2 else True
                symbols = longer(symbols[:-1], single[k - 1 :])
                rank = np.full(len(symbols), -1, "i4")
                rank[alive] = table.of(symbols[alive])
            both = (rank[:-1] != -1) & (rank[1:] != -1)
            both &= joined if len(tables) == 1 else True
            a, b = rank[:-1][both], rank[1:][both]
            ranked = (a >= 0) & (b >= 0)
            keys.append(tiled(a[ranked], b[ranked], ids))
            held += len(keys[-1])
            if not ranked.all():
                rest = np.stack([symbols[:-1][both][~ranked], symbols[1:][both][~ranked]], axis=1)
                some, n = np.unique(rest, axis=0, return_counts=True)
                none = pa.nulls(len(n))
                columns = [none.cast(pa.int64()), none.cast(pa.int64()), pa.array(n), none.cast(pa.binary()), pa.array(some[:, 0].view("i8")), pa.array(some[:, 1].view("i8"))]
                yield pa.RecordBatch.from_arrays(columns, schema=PAIRS)
            if held >= HELD:
                yield from flush(keys, salt)
                keys, held = [], 0
        if held:
            yield from flush(keys, salt)

    return _rows(docs).mapInArrow(run, PAIRS_SQL)


def _merged(rows: Iterator[tuple[int, bytes]], dense: bool) -> tuple[np.ndarray, np.ndarray]:
    """The sum of packed tiles: in a dense array, or by merging sorted lists now and then."""
    if dense:
        cells = np.zeros(SIDE * SIDE, "i8")
        for n, data in rows:
            code, count = unpacked(n, data)
            cells[code] += count
        code = np.flatnonzero(cells)
        return code, cells[code]
    codes, counts, held = [np.zeros(0, "i8")], [np.zeros(0, "i8")], 0

    def merge() -> tuple[np.ndarray, np.ndarray]:
        code = np.concatenate(codes)
        order = np.argsort(code)
        code, count = code[order], np.concatenate(counts)[order]
        new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
        return code[new], np.add.reduceat(count, new) if len(new) else count

    for n, data in rows:
        code, count = unpacked(n, data)
        codes.append(code)
        counts.append(count)
        held += n
        if held >= max(HELD, len(codes[0])):
            code, count = merge()
            codes, counts, held = [code], [count], 0
    return merge()


def pair_counts(docs: DataFrame, known: list[Broadcast], more: bool, m: Mining) -> DataFrame:
    """left, right, f of neighbouring symbols that occur at least m.least times."""
    last = known[-1]
    found = pairs(docs, known)
    if more:
        found = stored(found, "pairs")
    dense_tiles = (DENSE_IDS // SIDE) ** 2
    tasks = shuffle_tasks(docs.sparkSession)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("tile", "salt", "n", "data"))))
        return groupby(rows, key=lambda row: row[:2])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tile, _), rows in tiles(batches):
            yield _tile_batch(tile, 0, *_merged((row[2:] for row in rows), tile < dense_tiles))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = last.value.symbols
        for (tile, _), rows in tiles(batches):
            code, count = _merged((row[2:] for row in rows), tile < dense_tiles)
            often = count >= m.least
            a, b = untiled(tile, code[often], len(symbols))
            columns = [pa.array(symbols[a].view("i8")), pa.array(symbols[b].view("i8")), pa.array(count[often])]
            yield pa.RecordBatch.from_arrays(columns, ["left", "right", "f"])

    in_tiles = found.where("tile is not null")
    salted = in_tiles.repartition(tasks, "tile", "salt").sortWithinPartitions("tile", "salt").mapInArrow(first, PAIRS_SQL)
    summed = salted.repartition(tasks, "tile").sortWithinPartitions("tile").mapInArrow(second, "left bigint, right bigint, f bigint")
    if more:
        rest = found.where("tile is null").groupBy("left", "right").agg(F.sum("n").alias("f")).where(F.col("f") >= m.least)
        summed = summed.unionByName(rest)
    return summed


def _longer_column(symbol: Column, last: Column) -> Column:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(longer(a.to_numpy(zero_copy_only=False).view("u8"), b.to_numpy(zero_copy_only=False).view("u8")).view("i8"))

    return F.arrow_udf(run, "bigint")(symbol, last)


def phrase_counts(docs: DataFrame, m: Mining = Mining()) -> tuple[list[DataFrame], DataFrame]:
    """Level tables (lang, words, parts, symbol, f) of the frequent words and phrases; and (lang, n)."""
    sc = docs.sparkSession.sparkContext
    counts = stored(word_counts(docs), "words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    level = counts.where(F.col("f") >= m.least).select("lang", F.array("word").alias("words"), F.array("symbol").alias("parts"), "symbol", "f")
    levels, known = [level], []
    for _ in range(2, m.longest + 1):
        table, more = ranks(level, m)
        known.append(sc.broadcast(table))
        found = pair_counts(docs, known, more or any(k.value.others is not None for k in known), m)
        one = level.select(F.col("symbol").alias("left"), "lang", "words", "parts")
        two = level.select(F.col("symbol").alias("right"), F.element_at("words", -1).alias("word"), F.element_at("parts", -1).alias("part"))
        joined = found.join(one, "left").join(two, "right")
        level = joined.select(
            "lang", F.array_append("words", F.col("word")).alias("words"), F.array_append("parts", F.col("part")).alias("parts"),
            _longer_column(F.col("left"), F.col("part")).alias("symbol"), "f",
        )
        level = stored(level, "phrases")
        levels.append(level)
    return levels, totals


def collocations(docs: DataFrame, m: Mining = Mining()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first m.top phrases by score.

    A phrase scores floor(2000000 a / (l + r)) at its worst cut, l and r being the counts of
    the parts. Phrases that a longer candidate mostly accounts for are dropped.
    """
    levels, totals = phrase_counts(docs, m)
    many = lambda c: F.col(c).cast("decimal(38,0)")
    counts = levels[0].select("parts", "f")
    for level in levels[1:]:
        counts = counts.unionByName(level.select("parts", "f"))
    phrases = levels[1]
    for level in levels[2:]:
        phrases = phrases.unionByName(level)
    cuts = phrases.select("parts", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("cut"))
    cuts = cuts.select("*", F.slice("parts", F.lit(1), F.col("cut")).alias("head"), F.slice("parts", F.col("cut") + 1, F.size("parts")).alias("tail"))
    cuts = cuts.join(counts.select(F.col("parts").alias("head"), F.col("f").alias("l")), "head")
    cuts = cuts.join(counts.select(F.col("parts").alias("tail"), F.col("f").alias("r")), "tail")
    cuts = cuts.withColumn("sides", (many("l") + many("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("cast(2000000 * cast(a as decimal(28,0)) as decimal(38,0)) div sides"))
    worst = cuts.groupBy("parts").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
    inside = [
        level.select("f", F.explode(F.array(*[F.slice("parts", i, k) for k in range(2, size) for i in range(1, size - k + 2)])).alias("parts"))
        for size, level in enumerate(levels[2:], 3)
    ]
    scored = phrases.join(worst, "parts")
    if inside:
        within = inside[0]
        for one in inside[1:]:
            within = within.unionByName(one)
        within = within.groupBy("parts").agg(F.max("f").alias("longer"))
        scored = scored.join(within, "parts", "left").where(F.coalesce(100 * many("longer") < m.contained * many("f"), F.lit(True)))
    named = scored.select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "worst.l", "worst.r", F.col("worst.score").cast("bigint").alias("score")
    )
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = named.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= m.top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
