"""Fields of damaged JSON objects: a pushdown automaton reads an answer once, keeps what is complete and names what is lost."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

# Quotes and the characters that may close them, colons and commas, literals.
QUOTES = {'"': '"', "'": "'", "“": '”"', "”": '”"', "‘": "’'", "’": "’'"}
COLONS, COMMAS = ":：", ",，"
OPEN, CLOSE = {"{": "}", "[": "]", "｛": "}"}, {"}": "}", "]": "]", "｝": "}"}
LITERALS = {"true": True, "false": False, "null": None, "none": None}
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
NEXT_KEY = re.compile(r"""[,，\n]\s*(?:"([^"\n]{1,80})"|'([^'\n]{1,80})'|“([^”\n]{1,80})”|([A-Za-z_]\w*))\s*[:：]""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
RESULT = StructType([StructField("fields", MapType(StringType(), StringType())), StructField("lost", ArrayType(StringType()))])


class Damaged(Exception):
    """The text cannot go on here."""


class Reader:
    """One pass over a text. ``stack`` holds the containers that are open inside the field that is being read."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def blank(self) -> str:
        """The next character that is not blank; empty at the end."""
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def quoted(self) -> str:
        """A string. Its quote ends it only before a comma, colon, bracket or the end, so quotes inside do no harm."""
        closing, out = QUOTES[self.text[self.at]], []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "\\" and self.at < len(self.text):
                e = self.text[self.at]
                self.at += 1
                if e == "u" and re.fullmatch("[0-9a-fA-F]{4}", self.text[self.at : self.at + 4]):
                    out.append(chr(int(self.text[self.at : self.at + 4], 16)))
                    self.at += 4
                else:
                    out.append(ESCAPES.get(e, e))
            elif c in closing:
                here, follows = self.at, self.blank()
                if not follows or follows in COMMAS + COLONS or follows in CLOSE:
                    return "".join(out)
                out.append(c + self.text[here : self.at])
            else:
                out.append(c)
        raise Damaged

    def scalar(self):
        """A string, number, literal, or bare words up to a comma, a bracket or the end of the line. What the end of the text may have cut is damaged."""
        c = self.blank()
        if c in QUOTES:
            return self.quoted()
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in COMMAS + "\n" and self.text[self.at] not in CLOSE and self.text[self.at] not in OPEN:
            self.at += 1
        word = self.text[start : self.at].strip()
        if not word or self.at == len(self.text):
            raise Damaged
        if NUMBER.fullmatch(word):
            return json.loads(word)
        return LITERALS.get(word.lower(), word)

    def key(self) -> str:
        if self.blank() in QUOTES:
            name = self.quoted()
        else:
            found = re.compile(r"[A-Za-z_]\w*").match(self.text, self.at)
            if not found:
                raise Damaged
            name, self.at = found.group(), found.end()
        if self.blank() not in COLONS or self.at == len(self.text):
            raise Damaged
        self.at += 1
        return name

    def value(self):
        """One value with all that it holds; containers are pushed and popped, never recursed into."""
        stack: list[tuple[object, str | None, str]] = []  # container, key of it, its closing bracket
        while True:
            c = self.blank()
            if c in OPEN and c:
                self.at += 1
                stack.append(({} if OPEN[c] == "}" else [], None, OPEN[c]))
                done = None
            elif c in CLOSE and c and stack:
                done = False  # an empty container, or a comma before its end
            else:
                done = True
                item = self.scalar()
            while True:  # put what is complete into what holds it
                if done:
                    if not stack:
                        return item
                    container, name, end = stack[-1]
                    if isinstance(container, list):
                        container.append(item)
                    else:
                        container[name] = item
                    if self.blank() and self.blank() in COMMAS:
                        self.at += 1
                container, _, end = stack[-1]
                c = self.blank()
                if not c:
                    raise Damaged
                if c in CLOSE:
                    if CLOSE[c] != end:
                        raise Damaged
                    self.at += 1
                    item, done = stack.pop()[0], True
                    continue
                if isinstance(container, dict):
                    stack[-1] = (container, self.key(), end)
                break

    def fields(self) -> tuple[dict[str, object], list[str]]:
        """Complete fields of the first object and the names of those that were begun but damaged."""
        found: dict[str, object] = {}
        lost: list[str] = []
        self.at = next((i for i, c in enumerate(self.text) if c in "{｛"), len(self.text)) + 1
        while self.blank() and self.blank() not in "}｝":
            name = None
            try:
                name = self.key()
                found[name] = self.value()
                if self.blank() and self.blank() in COMMAS:
                    self.at += 1
            except Damaged:
                if name is not None:
                    lost.append(name)
                further = NEXT_KEY.search(self.text, max(0, self.at - 1))
                if not further:
                    break
                self.at = further.start() + 1
        return found, [n for n in dict.fromkeys(lost) if n not in found]


def unwrapped(text: str) -> str:
    """The answer inside an interface's envelope (output_text, or the texts of output's contents, joined by lines), else the text itself."""
    if not text.lstrip().startswith("{"):
        return text
    try:
        whole = json.loads(text)
    except (ValueError, RecursionError):
        return text
    if isinstance(whole.get("output_text"), str):
        return whole["output_text"]
    if isinstance(whole.get("output"), list):
        parts = [c for item in whole["output"] if isinstance(item, dict) for c in item.get("content") or [] if isinstance(c, dict)]
        texts = [str(c.get("text") or c.get("output_text")) for c in parts if c.get("text") or c.get("output_text")]
        return "\n".join(texts) if texts else text
    return text


def recovered_fields(text: str | None) -> tuple[dict[str, str], list[str]]:
    found, lost = Reader(unwrapped(text or "")).fields()
    out = {}
    for name, value in found.items():
        try:
            out[name] = json.dumps(value, ensure_ascii=False)
        except RecursionError:  # nested too deeply to be written
            lost = [*lost, name]
    return out, lost


def recovered(text: Column) -> Column:
    """struct(fields, lost): complete fields of a model's answer as JSON texts, and names of fields that are damaged.

    Envelopes, fences and prose before the object are passed over. Keys may be bare, quotes single or curly, literals
    Python's, commas doubled at the end or missing between fields. A damaged field is given up and reading goes on at the
    next key; of a repeated key the last complete value stays. Null, empty and prose answers have no fields.
    """

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        rows = [recovered_fields(t) for t in texts.to_pylist()]
        return pa.array([{"fields": list(f.items()), "lost": lost} for f, lost in rows], pa.struct([("fields", pa.map_(pa.string(), pa.string())), ("lost", pa.list_(pa.string()))]))

    return run(text)
