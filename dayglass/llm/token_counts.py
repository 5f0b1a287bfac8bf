"""Exact token counts of texts and of all their prefixes, under a byte-level BPE.

Prefix dynamic programming (prefix_bpe) gives the count at every prefix of a word; the
counts of the words before it add up. The stored counts answer truncation and budget
questions without encoding again: `tokens_at`, `longest_within`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.llm.common import slices, texts
from dayglass.llm.prefix_bpe import PrefixBPE

#: Chunks and words whose counts a worker remembers; further ones are counted each time.
CHUNKS, WORDS = 700_000, 700_000

#: Fixed value: how the byte-level vocabulary splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_words = regex.compile(PATTERN)
_chunks = regex.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+").findall
_last_run = regex.compile(r"(?r)\s*\S*\Z").search
_odd_space = regex.compile(r"[\s\x1c-\x1f\x85--[ \n\t\r]]", regex.V1).search


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


_LETTERS = {b: letter for b, letter in enumerate(_byte_letters())}
_counters: dict[str, "TokenCounter"] = {}


def counter(path: str) -> "TokenCounter":
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            saved = json.load(f)
        rank = {tuple(m): i for i, m in enumerate(saved["model"]["merges"])}
        special = [t["content"] for t in saved["added_tokens"]]
        self.bpe = PrefixBPE(set(saved["model"]["vocab"]) - set(special), lambda a, b: rank.get((a, b)))
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def _row(self, word: str) -> list[int]:
        """Counts at each character of one word: entry k for its first k characters."""
        counts = self.bpe.counts(word.encode("utf-8").decode("latin-1").translate(_LETTERS))
        if len(counts) == len(word) + 1:
            return counts
        ends = np.cumsum([0, *(len(c.encode("utf-8")) for c in word)])
        return [counts[e] for e in ends]

    def _word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            found = self.bpe.counts(word.encode("utf-8").decode("latin-1").translate(_LETTERS))[-1]
            if len(self.words) < WORDS:
                self.words[word] = found
        return found

    def _chunk(self, chunk: str) -> int:
        found = self.chunks.get(chunk)
        if found is None:
            found = sum(map(self._word, _words.findall(chunk)))
            if len(self.chunks) < CHUNKS:
                self.chunks[chunk] = found
        return found

    def _parts(self, text: str) -> list[tuple[str, bool]]:
        """Ordinary text and special strings, which are one token each."""
        if self.special is None or "<|" not in text:
            return [(text, False)] if text else []
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False)] * (m.start() > at) + [(m[0], True)]
            at = m.end()
        return out + [(text[at:], False)] * (at < len(text))

    def pieces(self, text: str) -> tuple[list[str], list[int]]:
        """Consecutive pieces that are encoded apart from each other, and the tokens of each.

        Pieces start where white space follows other characters: no word crosses that,
        and whether white space is cut before its last character shows inside the piece.
        """
        strings: list[str] = []
        counts: list[int] = []
        known = self.chunks
        for part, special in self._parts(text):
            if special:
                own, tokens = [part], [1]
            elif _odd_space(part):
                own, tokens = [part], [sum(map(self._word, _words.findall(part)))]
            else:
                own = _chunks(part)
                try:
                    tokens = list(map(known.__getitem__, own))
                except KeyError:
                    tokens = list(map(self._chunk, own))
            strings += own
            counts += tokens
        return strings, counts

    def prefixes(self, text: str) -> list[int]:
        """The number of tokens of text[:k], for each k from 0 to len(text)."""
        out, before = [0], 0
        parts = self._parts(text)
        for i, (part, special) in enumerate(parts):
            if special:
                # cut short, the special string is ordinary text after what precedes it
                lead = parts[i - 1][0] if i and not parts[i - 1][1] else ""
                lead = lead[_last_run(lead).start() :]
                lead_tokens = before - self.count(lead)
                row = self._ordinary(lead + part)
                out += [lead_tokens + c for c in row[len(lead) + 1 : -1]]
                before += 1
                out.append(before)
            else:
                row = self._ordinary(part)
                out += [before + c for c in row[1:]]
                before += row[-1]
        return out

    def _ordinary(self, text: str) -> list[int]:
        out, before, run = [0], 0, None  # run: where the current white space began, tokens there
        for m in _words.finditer(text):
            word, start = m[0], m.start()
            spaces = len(word) if word.isspace() else int(word[0] == " ")
            if spaces:
                run = run or (start, before)
                row = self._row(text[run[0] : start + spaces])
                out += [run[1] + c for c in row[start - run[0] + 1 :]]
            if spaces < len(word):
                if word[0] == "'" and len(word) > 1:  # cut short, a contraction is two words
                    row = [sum(map(self._word, _words.findall(word[:k]))) for k in range(len(word) + 1)]
                else:
                    row = self._row(word)
                out += [before + c for c in row[spaces + 1 :]]
                run = None
            before += self._word(word)
        return out

    def count(self, text: str) -> int:
        return sum(self.pieces(text)[1])

    def within(self, text: str, strings: list[str], counts: list[int], limit: int) -> int:
        """The greatest k for which text[:k] has at most `limit` tokens.

        Only the pieces around the limit are looked into.
        """
        total = np.cumsum(counts)
        if not len(total) or total[-1] <= limit:
            return len(text)
        # a later piece starts above the limit; cut inside, a special string changes two pieces
        last = int(np.searchsorted(total, limit, side="right"))
        first = max(0, last - 2)
        start = sum(map(len, strings[:first]))
        near = "".join(strings[first : last + 2])
        base = int(total[first - 1]) if first else 0
        row = self.prefixes(near)
        return start + max(k for k, c in enumerate(row) if base + c <= limit)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit, chars_within.

    `chars_within` is the length of the longest prefix of at most `limit` tokens. A null
    text is empty and has no tokens; repeated rows give repeated rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer)
        for part in slices(batches):
            rows = []
            for text in texts(part.column(1)):
                strings, counts = tokens.pieces(text)
                n = sum(counts)
                rows.append((len(text.encode("utf-8")), n, n > limit, tokens.within(text, strings, counts, limit)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *columns], ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within"]
            )

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, chars_within bigint"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, schema)


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, tokens: an array whose entry k is the token count of the first k characters."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer)
        for part in slices(batches, 64):
            found = [tokens.prefixes(t) for t in texts(part.column(1))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "tokens"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(rows, "doc_id bigint, tokens array<int>")


def tokens_at(tokens: Column, chars: Column | int) -> Column:
    """Token count of the first `chars` characters, from stored prefix counts."""
    return F.get(tokens, F.least(F.lit(chars), F.size(tokens) - 1))


def longest_within(tokens: Column, limit: int) -> Column:
    """Length of the longest prefix of at most `limit` tokens, from stored prefix counts."""
    fits = F.reverse(F.transform(tokens, lambda n: n <= limit))
    return F.size(tokens) - F.array_position(fits, True).cast("int")
