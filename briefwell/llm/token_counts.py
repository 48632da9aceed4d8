"""Token counts by a compiled finite-state transducer.

The tokenizer file (byte-level BPE with word ends, lower-cased, white space dropped) is compiled, state by state and
only as far as texts need it, into a deterministic transducer. A state holds the part of the current word that a later
character can still change: the longest suffix that begins some vocabulary entry, and for each position in it the last
token of the encoding up to there. Reading a symbol leads to one next state and emits a number of tokens. That works
because a sequence of tokens is the BPE encoding of its text exactly if each neighbouring pair is (checked by merging the
two alone), so the last token after each position is unique.

A long text is cut into chunks. A chunk's state map sends any entry state to an exit state and a count; white space
brings every state back to the start, so a map is fully given by the text before its first white space, the tokens
counted between, and the text after the last. Maps compose associatively and are combined pairwise, level by level.
Chunks of very long texts go to tasks of their own, and their maps are composed by a tree of shuffles, FAN at a time.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

CHUNK_CHARS = 1 << 16
#: Texts of more characters are cut into parts of so many, which are mapped and composed by tasks of their own.
LONG_CHARS, PART_CHARS, FAN = 1 << 21, 1 << 19, 64
MAX_STATES = 250_000
MAX_WORDS = 600_000
#: Pieces longer than this are run through the transducer each time, not kept.
LONGEST_KEPT = 64
#: What the compiled transducer stands for, as fixed values: the file's normaliser, pre-tokenizer and model options.
NORMALISERS = ["NFC", ("\\s+", " "), "Lowercase"]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: White space of the tokenizer's pattern (Unicode White_Space), as a fixed value.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Control characters that str.split() takes for white space and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
#: Outside these ranges combining marks and full case folding rules may apply, so the full normalisation runs.
_PLAIN = re.compile("[\x00-įĲ-˿‐-‧‰-⁞]*")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest for 256 onwards."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def check_kind(spec: dict) -> None:
    """Raise unless the file is of the kind that is compiled here, so that another tokenizer never gets wrong counts."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    normalisers = [(n["pattern"].get("Regex"), n["content"]) if n["type"] == "Replace" else n["type"] for n in steps]
    cutters = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    cut = [(c["pattern"].get("Regex"), c["behavior"], c["invert"]) if c["type"] == "Split" else (c["type"], c.get("add_prefix_space"), c.get("use_regex")) for c in cutters]
    model = spec["model"]
    plain = model["type"] == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    whole = not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if normalisers != NORMALISERS or cut != [(SPLIT, "Removed", True), ("ByteLevel", False, False)] or not plain or not whole:
        raise ValueError("the tokenizer file is not a lower-casing byte-level BPE with word ends, which is what the transducer is compiled from")


class CountingTransducer:
    """Counts the tokens of whole texts; tables grow lazily up to fixed bounds and are then rebuilt."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_kind(spec)
        end = spec["model"]["end_of_word_suffix"]
        symbols = byte_symbols()
        #: One character for each byte, and one more for each byte at a word's end, so that entries are plain strings.
        self.inner = {b: symbols[b] for b in range(256)}
        self.final = {b: chr(0x1000 + b) for b in range(256)}
        ends = {symbols[b]: self.final[b] for b in range(256)}

        def plain(token: str) -> str:
            stem = token.removesuffix(end)
            return stem[:-1] + ends[stem[-1]] if stem != token and stem else token

        self.rank = {tuple(plain(x) for x in (m.split(" ") if isinstance(m, str) else m)): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))) or "(?!)")
        self.tokens = {plain(t) for t in spec["model"]["vocab"]}
        self.longest = max(map(len, self.tokens))
        self.prefixes = {s[:k] for s in self.tokens for k in range(1, len(s))}
        self.reset()

    def reset(self) -> None:
        self.pair_ok: dict[tuple[str | None, str], bool] = {}
        self.states: dict[tuple, int] = {}
        self.content: list[tuple[str, tuple, tuple]] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.words: dict[str, int] = {}
        self.start = self._state(("", (None,), (0,)))

    def _state(self, content: tuple) -> int:
        k = self.states.setdefault(content, len(self.content))
        if k == len(self.content):
            self.content.append(content)
            self.moves.append({})
        return k

    def merged(self, symbols: str) -> list[str]:
        """Plain BPE: join the pair of lowest rank, leftmost first, until none is left."""
        parts, none = list(symbols), 1 << 60
        while len(parts) > 1:
            ranks = [self.rank.get(pair, none) for pair in zip(parts, parts[1:])]
            if (least := min(ranks)) == none:
                break
            best = ranks.index(least)
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fits(self, left: str | None, right: str) -> bool:
        fits = self.pair_ok.get((left, right))
        if fits is None:
            fits = self.pair_ok[left, right] = self.merged((left or "") + right) == ([left, right] if left else [right])
        return fits

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """The next state and the number of tokens emitted; states are compiled when first reached."""
        move = self.moves[state].get(symbol)
        if move is None:
            move = self.moves[state][symbol] = self._compile(state, symbol)
        return move

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        window, last, count = self.content[state]
        window += symbol
        n = len(window)
        for k in range(max(0, n - self.longest), n):
            if window[k:] in self.tokens and self._fits(last[k], window[k:]):
                break
        else:
            raise ValueError(f"no token ends with {symbol!r}")
        last, count = (*last, window[k:]), (*count, count[k] + 1)
        alive = [i == n or window[i:] in self.prefixes for i in range(n + 1)]
        cut = alive.index(True)
        emitted = count[cut]
        return self._state((window[cut:], tuple(last[i] if alive[i] else "" for i in range(cut, n + 1)), tuple(count[i] - emitted if alive[i] else 0 for i in range(cut, n + 1)))), emitted

    def word(self, text: str) -> int:
        """Tokens of one pre-token: run the transducer to its word end and flush what the last state holds."""
        raw = text.encode("utf-8")
        state, total, moves, inner = self.start, 0, self.moves, self.inner
        for b in raw[:-1]:
            symbol = inner[b]
            state, emitted = moves[state].get(symbol) or self.step(state, symbol)
            total += emitted
        state, emitted = self.step(state, self.final[raw[-1]])
        return total + emitted + self.content[state][2][-1]

    def piece(self, text: str) -> int:
        """Tokens of a text without white space: an automaton over character kinds cuts it into pre-tokens.

        The run over a whole piece starts and ends in the start state, so its count is kept as one long transition.
        """
        total = self.words.get(text)
        if total is None:
            if len(self.content) >= MAX_STATES:
                self.reset()
            elif len(self.words) >= MAX_WORDS:
                self.words.clear()
            if text.isalpha():
                total = self.word(text)
            elif text[:-1].isalpha() and _kind(text[-1]) == "P":
                total = self.piece(text[:-1]) + self.piece(text[-1])
            else:
                total = sum(map(self.word, pre_tokens(text)))
            if len(text) <= LONGEST_KEPT:
                self.words[text] = total
        return total

    def chunk_map(self, chunk: str) -> tuple[str, int, str] | tuple[str]:
        """(head, count, tail) of a chunk with white space; (text,) of one without, which composes by joining texts."""
        spaces = list(_SPACE.finditer(chunk, 0)) if _ODD.search(chunk) else None
        if spaces is None:
            words = chunk.split()
            if not words:
                return ("", 0, "") if chunk else ("",)
            head = "" if chunk[0].isspace() else words[0]
            tail = "" if chunk[-1].isspace() else words[-1]
            if len(words) == 1 and head and tail:
                return (chunk,)
            inner = words[bool(head) : len(words) - bool(tail)]
        else:
            if not spaces:
                return (chunk,)
            head, tail = chunk[: spaces[0].start()], chunk[spaces[-1].end() :]
            inner = [w for w in _SPACE.split(chunk[spaces[0].end() : spaces[-1].start()]) if w] if len(spaces) > 1 else []
        known = self.words
        return head, sum(known[w] if w in known else self.piece(w) for w in inner), tail

    def compose(self, left: tuple, right: tuple) -> tuple:
        if len(left) == 1 and len(right) == 1:
            return (left[0] + right[0],)
        if len(left) == 1:
            return left[0] + right[0], right[1], right[2]
        if len(right) == 1:
            return left[0], left[1], left[2] + right[0]
        glued = left[2] + right[0]
        return left[0], left[1] + right[1] + (self.piece(glued) if glued else 0), right[2]

    def plain_count(self, text: str) -> int:
        """Tokens of a normalised text without special strings."""
        maps = [self.chunk_map(text[i : i + CHUNK_CHARS]) for i in range(0, len(text), CHUNK_CHARS)] or [("",)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        whole = self.compose(self.compose((" "[:0], 0, ""), maps[0]), ("", 0, ""))
        return whole[1] + (self.piece(whole[0]) if whole[0] else 0)

    def part_map(self, part: str) -> tuple[str, int | None, str]:
        """(head, count, tail) of a part of a text as it stands, or (part, None, '') without white space; heads and tails are not normalised yet."""
        spaces = list(_SPACE.finditer(part))
        if not spaces:
            return part, None, ""
        return part[: spaces[0].start()], self.count(part[spaces[0].end() : spaces[-1].start()]) if len(spaces) > 1 else 0, part[spaces[-1].end() :]

    def joined(self, left: tuple, right: tuple) -> tuple[str, int | None, str]:
        """The map of two parts in a row; a word over their border is counted once both its sides are known."""
        if left[1] is None:
            return (left[0] + right[0], None, "") if right[1] is None else (left[0] + right[0], right[1], right[2])
        if right[1] is None:
            return left[0], left[1], left[2] + right[0]
        return left[0], left[1] + self.count(left[2] + right[0]) + right[1], right[2]

    def finished(self, whole: tuple) -> int:
        return self.count(whole[0]) + (whole[1] or 0) + self.count(whole[2])

    def count(self, text: str) -> int:
        """Tokens of a whole text; an added special string inside it counts as one token, as the library has it by default."""
        if "<|" not in text or not self.special.search(text):
            return self.plain_count(normalise(text))
        return len(self.special.findall(text)) + sum(self.plain_count(normalise(part)) for part in self.special.split(text) if part)


def normalise(text: str) -> str:
    """NFC, then lower case character by character (a final sigma is not special)."""
    if _PLAIN.fullmatch(text):
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


#: Endings that an apostrophe forms a pre-token with, as fixed values.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1 << 16)
def _kind(ch: str) -> str:
    k = unicodedata.category(ch)[0]
    return k if k in "LN" else "P"


def pre_tokens(text: str) -> Iterator[str]:
    """Runs of letters, single numerals, runs of other characters; at a run's start, an apostrophe with one of the endings."""
    i, n = 0, len(text)
    while i < n:
        if text[i] == "'":
            ending = next((e for e in _ENDINGS if text.startswith(e, i + 1)), None)
            if ending:
                yield text[i : i + 1 + len(ending)]
                i += 1 + len(ending)
                continue
        kind, j = _kind(text[i]), i + 1
        while kind != "N" and j < n and _kind(text[j]) == kind:
            j += 1
        yield text[i:j]
        i = j


_compiled: dict[str, CountingTransducer] = {}


def transducer(path: str) -> CountingTransducer:
    """One transducer for each worker process and file."""
    if path not in _compiled:
        _compiled[path] = CountingTransducer(path)
    return _compiled[path]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > max_tokens).

    Whole texts in one pass without a shuffle, those of more than LONG_CHARS characters in parts. A null text counts as
    empty: 0 bytes, 0 tokens. Repeated rows give repeated results; an empty table gives an empty one; other columns are
    not read. A run of characters without white space is counted by one task.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.char_length("text") > LONG_CHARS, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = transducer(tokenizer_path)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text) if text.isascii() else len(text.encode("utf-8")))
                n_tokens.append(counting.count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    counted = own.filter(~is_long).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    n_long = own.agg(F.max(F.char_length("text"))).first()[0] or 0
    if n_long > LONG_CHARS:
        counted = counted.unionByName(_long_counts(own.filter(is_long), tokenizer_path, -(-n_long // PART_CHARS)))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))


def _long_counts(texts: DataFrame, tokenizer_path: str, most_parts: int) -> DataFrame:
    """(id, n_bytes, n_tokens) of (id, text) rows by parts: mapped where they land, composed FAN at a time in their order."""
    rows = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "long-texts")
    n = F.ceil(F.char_length("text") / F.lit(PART_CHARS)).cast("int")
    parts = rows.select("row", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"), "text").select("row", "part", F.expr(f"substring(text, part * {PART_CHARS} + 1, {PART_CHARS})").alias("text"))
    schema = "row long, part int, head string, count long, tail string"
    fields = ["row", "part", "head", "count", "tail"]

    def table(found: list[tuple]) -> pa.Table:
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()]
        return pa.table({name: pa.array([f[i] for f in found], kind) for i, (name, kind) in enumerate(zip(fields, kinds))})

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = transducer(tokenizer_path)
        for batch in batches:
            found = [(row, part, *counting.part_map(text)) for row, part, text in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield from table(found).to_batches()

    def composed(group: pa.Table) -> pa.Table:
        counting = transducer(tokenizer_path)
        ordered = sorted(zip(*(group.column(f).to_pylist() for f in fields)), key=lambda m: m[1])
        return table([(ordered[0][0], ordered[0][1] // FAN, *reduce(counting.joined, (m[2:] for m in ordered)))])

    maps = parts.repartition("row", "part").mapInArrow(mapped, schema)
    while most_parts > 1:
        maps = maps.groupBy("row", F.floor(F.col("part") / FAN)).applyInArrow(composed, schema)
        most_parts = -(-most_parts // FAN)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = transducer(tokenizer_path)
        for batch in batches:
            whole = zip(*(batch.column(f).to_pylist() for f in ("head", "count", "tail")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([counting.finished(m) for m in whole], pa.int64())], ["row", "n_tokens"])

    done = maps.mapInArrow(finished, "row long, n_tokens long")
    return rows.select("row", "id", F.octet_length("text").cast("long").alias("n_bytes")).join(done, "row").select("id", "n_bytes", "n_tokens")
