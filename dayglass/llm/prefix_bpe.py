"""Byte-pair encoding of every prefix of a string, in one pass.

The encoding of a string under ordered merges is the one token sequence whose
neighbours are all stable: two tokens are stable if encoding their concatenation gives
back the two. So the last token of the encoding of a prefix is the one token that ends
there and is stable after the last token of what it leaves, and the number of tokens of
each prefix follows from that of a shorter one. A string of n symbols takes n steps of
at most `longest` look-ups, whatever it looks like.
"""

from __future__ import annotations

from collections.abc import Callable

#: Stable pairs a worker remembers.
PAIRS = 1_500_000


class PrefixBPE:
    def __init__(self, tokens: set[str], priority: Callable[[str, str], float | None]):
        """`priority` of merging two neighbours: the smallest goes first, None is no merge."""
        self.tokens = tokens
        self.longest = max(map(len, tokens))
        self.priority = priority
        self.stable: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Encode a short string by its merges, first of the best."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                p = self.priority(parts[i], parts[i + 1])
                if p is not None and (best is None or p < best):
                    best, at = p, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def backpointers(self, text: str) -> list[int]:
        """For each prefix length, where the last token of its encoding starts."""
        tokens, stable, longest = self.tokens, self.stable, self.longest
        n = len(text)
        back = [0] * (n + 1)
        last = [""] * (n + 1)
        for end in range(1, n + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = text[start:end]
                if token not in tokens and end - start > 1:
                    continue
                if start:
                    pair = (last[start], token)
                    good = stable.get(pair)
                    if good is None:
                        good = self._learn(pair)
                else:
                    good = self.whole.get(token)
                    if good is None:
                        good = self.merged(token) == [token]
                        if len(self.whole) < PAIRS:
                            self.whole[token] = good
                if good:
                    back[end], last[end] = start, token
                    break
        return back

    def _learn(self, pair: tuple[str, str]) -> bool:
        good = self.merged(pair[0] + pair[1]) == list(pair)
        if len(self.stable) < PAIRS:
            self.stable[pair] = good
        return good

    def counts(self, text: str) -> list[int]:
        """Number of tokens of each prefix, from the empty one on."""
        back = self.backpointers(text)
        out = [0] * len(back)
        for end in range(1, len(back)):
            out[end] = out[back[end]] + 1
        return out

    def encode(self, text: str) -> list[str]:
        back, end, out = self.backpointers(text), len(text), []
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]
