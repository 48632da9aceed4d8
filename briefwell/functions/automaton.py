"""One pass over whole texts for all words of many lists: an Aho-Corasick automaton as a table, stepped over pieces of texts side by side."""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Bytes of one automaton's table; longer lists are dealt to several automata.
MOST_BYTES = 32 << 20
#: Bytes of a text that are stepped together, and pieces stepped side by side.
PIECE, ABREAST = 1024, 4096
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True


class Automaton:
    """Goto, fail and output of a set of words as one table over bytes. States from ``first_out`` on end a word."""

    def __init__(self, words: list[tuple[int, bytes, bool]]):
        """Words are (id, bytes, bounded): a bounded word counts only between characters other than A-Z, a-z, 0-9 and _."""
        children: list[dict[int, int]] = [{}]
        out: list[list[int]] = [[]]
        for k, (_, word, _) in enumerate(words):
            state = 0
            for byte in word:
                if byte not in children[state]:
                    children[state][byte] = len(children)
                    children.append({})
                    out.append([])
                state = children[state][byte]
            out[state].append(k)
        n = len(children)
        goto, fail, queue = np.zeros((n, 256), np.int64), [0] * n, deque(children[0].values())
        for byte, child in children[0].items():
            goto[0, byte] = child
        while queue:  # breadth first, so a state's fail state is complete before it
            state = queue.popleft()
            out[state] += out[fail[state]]
            goto[state] = goto[fail[state]]
            for byte, child in children[state].items():
                fail[child] = int(goto[fail[state], byte])
                goto[state, byte] = child
                queue.append(child)
        order = sorted(range(n), key=lambda s: (bool(out[s]), s))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.table = place[goto[order]].astype(np.uint16 if n < 1 << 16 else np.int32).ravel()
        self.first_out = sum(not o for o in out)
        ends = [out[s] for s in order[self.first_out :]]
        self.out_at = np.cumsum([0, *map(len, ends)])
        self.out = np.array([k for o in ends for k in o], np.int64)
        self.ids = np.array([i for i, _, _ in words], np.int64)
        self.sizes = np.array([len(w) for _, w, _ in words], np.int64)
        self.bounded = np.array([b for _, _, b in words], bool)

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, id) of every word that occurs in each text, once, in order."""
        texts = texts.cast(pa.large_binary())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        size = np.diff(at)
        pieces = np.maximum(1, -(-size // PIECE))
        row = np.repeat(np.arange(len(size)), pieces)
        start = at[row] + (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        end = np.minimum(at[row + 1], start + PIECE + int(self.sizes.max(initial=1)) - 1)  # a word may pass a piece's end
        keys = [np.zeros(0, np.int64)]
        for first in range(0, len(row), ABREAST):
            keys.append(self._stepped(data, at, row[first : first + ABREAST], start[first : first + ABREAST], end[first : first + ABREAST]))
        key = np.unique(np.concatenate(keys))
        return key // len(self.ids), self.ids[key % len(self.ids)]

    def _stepped(self, data: np.ndarray, at: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        order = np.argsort(start - end, kind="stable")  # long pieces first, so that those that go on are a prefix
        row, start, end = row[order], start[order], end[order]
        size = end - start
        state, hits = np.zeros(len(row), np.int64), []
        alive = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
        for step, n in enumerate(alive):
            state = self.table[(state[:n].astype(np.int64) << 8) | data[start[:n] + step]]
            told = np.flatnonzero(state >= self.first_out)
            if len(told):
                hits.append((told, state[told].astype(np.int64) - self.first_out, start[told] + step))
        if not hits:
            return np.zeros(0, np.int64)
        piece, ending, last = (np.concatenate(x) for x in zip(*hits))
        n = self.out_at[ending + 1] - self.out_at[ending]
        take = np.repeat(self.out_at[ending] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        word, piece, last = self.out[take], np.repeat(piece, n), np.repeat(last, n)
        before, after = last - self.sizes[word], last + 1
        lies = at[row[piece]], at[row[piece] + 1]
        open_ = (before >= lies[0]) & _WORD[data[np.maximum(before, 0)]] | (after < lies[1]) & _WORD[data[np.minimum(after, len(data) - 1)]]
        good = ~(self.bounded[word] & open_)
        return row[piece[good]] * len(self.ids) + word[good]


@lru_cache(maxsize=64)
def automata(words: tuple[str, ...], bounded: frozenset[str]) -> tuple[Automaton, ...]:
    parts: list[list[tuple[int, bytes, bool]]] = [[]]
    room = MOST_BYTES // (256 * 4)  # states
    for k, word in enumerate(words):
        piece = word.encode()
        if not piece:
            continue
        if parts[-1] and sum(len(w) for _, w, _ in parts[-1]) + len(piece) > room:
            parts.append([])
        parts[-1].append((k, piece, word in bounded))
    return tuple(Automaton(p) for p in parts if p)


def words_found(text: Column, words: tuple[str, ...], bounded: frozenset[str] = frozenset()) -> Column:
    """Places, in ``words``, of the words that occur in the text, ascending; an empty array for a null text. Empty words never occur.

    Words are found as substrings, those that are ``bounded`` only as whole words. The text is read once, whatever the
    number of words and lists. Both are compared as they are, so give both in lower case to ignore case.
    """
    machines = automata(words, bounded)

    def run(values: pa.Array) -> pa.Array:
        rows, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for machine in machines:
            r, i = machine.found(values)
            rows.append(r)
            ids.append(i)
        row, found = np.concatenate(rows), np.concatenate(ids)
        order = np.lexsort((found, row))
        offsets = np.searchsorted(row[order], np.arange(len(values) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found[order], pa.int32()))

    return F.arrow_udf(run, ArrayType(IntegerType()))(F.coalesce(text, F.lit("")))


def count_of(found: Column, words: tuple[str, ...], listed: tuple[str, ...]) -> Column:
    """How many of the ``listed`` words are among those found of ``words``."""
    place = {w: k for k, w in enumerate(words)}
    return F.size(F.array_intersect(found, F.array(*[F.lit(place[w]) for w in dict.fromkeys(listed)])))
