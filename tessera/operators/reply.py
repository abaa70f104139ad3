"""What a vision model says of a page: its text and lists, however much of the reply arrived.

Replies are JSON objects, bare or fenced, or plain Markdown with an optional comment of lists at its end.
Objects are read by a parser that knows strings, escapes and nesting and stops where the reply ends or
goes wrong: what was complete by then counts, and a text counts as far as it goes.  So every beginning of a
valid reply gives a beginning of its fields.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------------------------
#: Phrases of the prompt that a model repeats instead of filling them in.
PLACEHOLDERS = ("本页主要功能块", "本页核心主题", "中英文并列", "如「STM32F407", "按本页实际内容动态命名")
#: A comment that lists components, nets and interfaces.
META = re.compile(r"<!--\s*\w+:major_components=([^;]*);nets=([^;]*);interfaces=([^>]*?)\s*-->", re.IGNORECASE)
DESIGNATOR = re.compile(r"\b([UCRLDQXJFETSW]\d+[A-Z]?)\b", re.IGNORECASE)
QUOTED_NET = re.compile(r"`([A-Z][A-Z0-9_./+-]{1,48})`")
NO_NETS = {"MCU", "LDO"}
BUSES = ("I2C", "SPI", "USB", "UART", "CAN", "RMII", "MDIO", "SWD", "JTAG")
WINDOW = 24
# ------------------------------------------------------------------------------------------------

LISTS = ("major_components", "nets", "interfaces")
REPLY = T.StructType().add("markdown", "string").add("major_components", T.ArrayType(T.StringType())).add("nets", T.ArrayType(T.StringType())).add("interfaces", T.ArrayType(T.StringType()))
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "\\": "\\", "/": "/"}
NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
WORDS = {"true": True, "false": False, "null": None}


class Prefix:
    """Reads a JSON value from ``text`` as far as it goes.  ``whole`` tells whether the value ended."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at, self.whole = text, at, True

    def blank(self) -> str:
        """Skip white space; the next character, or nothing at the end."""
        while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
            self.at += 1
        return self.text[self.at : self.at + 1]

    def stop(self) -> None:
        self.whole = False

    def value(self) -> object:
        c = self.blank()
        if c == '"':
            return self.string()
        if c == "{":
            return self.members({}, "}")
        if c == "[":
            return self.members([], "]")
        if found := NUMBER.match(self.text, self.at):
            self.at = found.end()
            if self.at == len(self.text):
                self.stop()  # more digits may follow
            return float(found[0]) if set(found[0]) & set(".eE") else int(found[0])
        for word, value in WORDS.items():
            if self.text.startswith(word, self.at):
                self.at += len(word)
                return value
        self.stop()
        return None

    def string(self) -> str:
        """A text; line breaks may stand in it, and an escape that is not all there is left out."""
        out: list[str] = []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == '"':
                self.at += 1
                return joined_surrogates("".join(out))
            if c != "\\":
                out.append(c)
                self.at += 1
                continue
            code = self.text[self.at + 1 : self.at + 2]
            if code == "u":
                digits = self.text[self.at + 2 : self.at + 6]
                if len(digits) < 4:
                    break
                try:
                    out.append(chr(int(digits, 16)))
                except ValueError:
                    break
                self.at += 6
            elif code:
                out.append(ESCAPES.get(code, code))
                self.at += 2
            else:
                break
        self.stop()
        return joined_surrogates("".join(out))

    def members(self, out: dict | list, end: str) -> dict | list:
        """The members of an object or a list.  Of an object's last member a text counts in part; of a
        list, whole members alone."""
        self.at += 1
        while self.whole:
            c = self.blank()
            if c == end:
                self.at += 1
                return out
            if c == ",":
                self.at += 1
                continue
            name = None
            if isinstance(out, dict):
                if c != '"':
                    break
                name = self.string()
                if not self.whole or self.blank() != ":":
                    break
                self.at += 1
            value = self.value()
            if name is not None and (self.whole or isinstance(value, (str, list, dict))):
                out[name] = value
            elif name is None and self.whole:
                out.append(value)
        self.stop()
        return out


def joined_surrogates(text: str) -> str:
    """Pairs of escapes as the character they stand for; halves alone go."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "ignore")


def payload(text: str) -> tuple[dict | None, bool]:
    """(the object of a reply as far as it goes, whether it is whole); null if there is none."""
    at = 0
    if found := re.search(r"```(?:json)?\s*(?=\{)", text):
        at = found.end()
    elif not text.startswith("{"):
        return None, False
    reader = Prefix(text, at)
    made = reader.value()
    return (made if isinstance(made, dict) else None), reader.whole


def unfenced(text: str) -> str:
    found = re.match(r"(?s)^```(?:markdown|md)?\s*\n(.*)\n```\s*$", text.strip())
    return found[1].strip() if found else text.strip()


def without_loop(text: str) -> str:
    """A reply that repeats its last ``WINDOW`` characters, cut where they come for the second time."""
    if len(text) < 3 * WINDOW:
        return text
    tail = text[-WINDOW:]
    again = text.find(tail, text.find(tail) + WINDOW)
    return text if again < 0 else text[:again].rstrip()


def listed(found: re.Match) -> list[list[str]]:
    return [[part.strip() for part in own.split(",") if part.strip()] for own in found.groups()]


def clean(text: str) -> str:
    """A page's Markdown without loops, placeholder lines, stray objects and the comment of lists."""
    lines = [line for line in without_loop(text.strip()).splitlines() if not any(p in line for p in PLACEHOLDERS) and not (line.strip().startswith("{") and '"markdown"' in line)]
    return META.sub("", "\n".join(lines).strip(), count=1).strip()


def inferred(markdown: str) -> list[list[str]]:
    """Components, nets and interfaces that the Markdown names."""
    nets = [n for n in QUOTED_NET.findall(markdown) if n not in NO_NETS]
    return [DESIGNATOR.findall(markdown), nets, [n for n in nets if any(bus in n for bus in BUSES)]]


def once(values: list) -> list[str]:
    return list(dict.fromkeys(v.strip() for v in map(str, values) if v.strip()))


def parsed(reply: str | None) -> dict[str, object]:
    """markdown, major_components, nets and interfaces of a reply."""
    text = (reply or "").strip()
    made, whole = payload(unfenced(text) if not text.startswith("{") and not re.search(r"```(?:json)?\s*\{", text) else text)
    if made is not None:
        told = made.get("markdown")
        markdown = clean(told) if isinstance(told, str) else ""
        lists = [made.get(name) if isinstance(made.get(name), list) else [] for name in LISTS]
        if not markdown and whole:
            markdown = clean(text)
        if not any(map(once, lists[:2])):
            lists = inferred(markdown)
    else:
        body = unfenced(text)
        found = META.search(body)
        markdown = clean(META.sub("", body, count=1)) or clean(text)
        lists = [own or guess for own, guess in zip(listed(found) if found else [[], [], []], inferred(markdown), strict=True)]
    return {"markdown": markdown, **{name: once(own) for name, own in zip(LISTS, lists, strict=True)}}


def with_parsed(rows: DataFrame, reply_col: str, out: str = "parsed") -> DataFrame:
    """``rows`` with ``out``, a struct of the fields of each reply; a null reply has empty fields."""

    @F.pandas_udf(REPLY)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for replies in batches:
            yield pd.DataFrame([parsed(r) for r in replies], columns=REPLY.names)

    return rows.withColumn(out, run(reply_col))
