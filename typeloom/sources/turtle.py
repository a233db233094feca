"""Turtle, read in ranges of files: statements are cut out where they lie, then parsed with the prefixes that hold there.

A range is a split of Spark's text source. Whether it begins inside a long string is known from the lines before it
that hold triple quotes, its prefixes from the directives before it. Statements that cross ranges are put together.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from urllib.parse import urldefrag, urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from typeloom.session import staged

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
COLUMNS = "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string, line string, reason string"
#: Text of statements between two directives that goes as one row, in characters: a task's batch has some 10,000 rows.
CHUNK = 1 << 11
#: Rows, and characters of the statements they come from, after which a task hands on a batch.
ROWS, TEXT = 10_000, 1 << 22

_PIECES = "file string, block long, phase int, n int, text string, before string, net string"
_IN = r"(?:\\.|[^\s<>\"'()\[\];,#.\\^@])"
_TOKEN = re.compile(
    rf"""(?P<space>\s+|\#[^\n]*)
    |(?P<iri><[^<>\"\x00-\x20]*>)
    |(?P<long>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+''')
    |(?P<open>\"\"\"|''')
    |(?P<short>\"(?:[^\"\\\n\r]|\\[^\n\r])*+\"|'(?:[^'\\\n\r]|\\[^\n\r])*+')
    |(?P<mark>\^\^|[;,()\[\]])
    |(?P<word>\.[0-9]+(?:[eE][+-]?[0-9]+)?|{_IN}++(?:\.+{_IN}++)*+)
    |(?P<dot>\.)
    |(?P<tag>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bad>[^\n]+|.)""",
    re.X | re.S,
)
_CLOSE = {'"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*+"""', re.S), "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*+'''", re.S)}
_DIRECTIVES = {"prefix", "base", "@prefix", "@base"}
_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_NUMBERS = {"integer": re.compile(r"[+-]?[0-9]+"), "decimal": re.compile(r"[+-]?[0-9]*\.[0-9]+"), "double": re.compile(r"[+-]?(?:[0-9]+\.[0-9]*|\.?[0-9]+)[eE][+-]?[0-9]+")}
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
# What an escape of one letter stands for.
_LETTERS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class Fault(ValueError):
    """Why a statement is none: syntax, escape, character, prefix or base."""


class _Cutter:
    """Cuts lines into statements; holds what has begun and the quotes of a long string that is open."""

    def __init__(self, quotes: str = "") -> None:
        self.quotes, self.parts, self.sparql, self.given = quotes, [], False, False

    def feed(self, line: str) -> Iterator[str]:
        """The statements that end in a line."""
        at = start = 0
        if not self.quotes and "." not in line and "'" not in line and '"' not in line and not self.sparql and not re.search("prefix|base", line, re.I):
            self.parts.append(line)
            self.given = self.given or not line.isspace()
            return
        while at < len(line):
            if self.quotes:
                closed = _CLOSE[self.quotes].match(line, at)
                if closed is None:
                    break
                at, self.quotes = closed.end(), ""
                continue
            token = _TOKEN.match(line, at)
            kind, text, here, at = token.lastgroup, token.group(), at, token.end()
            if kind == "open":
                self.quotes, self.given = text, True
                continue
            if kind == "word" and text.lower() in ("prefix", "base"):
                if self.given:  # the statement before it has no end
                    yield self._take(line[start:here])
                    start = here
                self.sparql = True
            if kind == "dot" or (kind == "iri" and self.sparql) or (kind == "bad" and text.rstrip().endswith(".")):
                yield self._take(line[start:at])
                start = at
            elif kind != "space":
                self.given = True
        self.parts.append(line[start:])

    def _take(self, last: str) -> str:
        text = "".join([*self.parts, last])
        self.parts, self.sparql, self.given = [], False, False
        return text

    def rest(self) -> str:
        return self._take("")


def _tokens(text: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m.group()) for m in _TOKEN.finditer(text) if m.lastgroup != "space"]


def _directive(text: str) -> tuple[str, str | None, str] | None:
    """(kind, prefix, IRI) of a directive, None for any other statement; a broken one is a statement that fails."""
    if not re.search("prefix|base", text, re.I):
        return None
    found = _tokens(text)
    if not found or found[0][1].lower() not in _DIRECTIVES:
        return None
    word = found[0][1].lower()
    found = found[1:-1] if word.startswith("@") and found[-1][0] == "dot" else found[1:]
    kinds = [k for k, _ in found]
    if word.endswith("base") and kinds == ["iri"]:
        return "base", None, found[0][1][1:-1]
    if word.endswith("prefix") and kinds == ["word", "iri"] and found[0][1].endswith(":"):
        return "prefix", found[0][1][:-1], found[1][1][1:-1]
    return None


def _net(told: list[tuple]) -> list[tuple]:
    """Directives that do as much as all those told: the last of each name, where none is relative to a base."""
    if all(_ABSOLUTE.match(iri) for _, _, iri in told):
        return list({(kind, name): (kind, name, iri) for kind, name, iri in told}.values())
    return told


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        code = m.group(1)
        if len(code) == 1:
            if code not in _LETTERS:
                raise Fault("escape")
            return _LETTERS[code]
        value = int(code[1:], 16)
        if value > 0x10FFFF or 0xD800 <= value < 0xE000:
            raise Fault("character")
        return chr(value)

    return _ESCAPE.sub(one, text) if "\\" in text else text


class _Space:
    """The prefixes and the base that hold for a statement."""

    def __init__(self, told: Iterable[tuple], base: str | None) -> None:
        self.base, self.prefixes = base, {}
        for kind, name, iri in told:
            try:
                iri = self.iri(iri)
            except Fault:  # what uses it has no prefix
                self.prefixes.pop(name, None)
                continue
            if kind == "base":
                self.base = iri
            else:
                self.prefixes[name] = iri

    def iri(self, written: str) -> str:
        written = _unescape(written)
        if _ABSOLUTE.match(written):
            return written
        if self.base is None:
            raise Fault("base")
        return urljoin(urldefrag(self.base)[0], written)

    def named(self, word: str) -> str:
        prefix, colon, local = word.partition(":")
        if not colon or "\\" in prefix:
            raise Fault("syntax")
        if prefix not in self.prefixes:
            raise Fault("prefix")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)


def parse(text: str, space: _Space, label: str) -> list[tuple]:
    """The triples of one statement; blank nodes without a label get ``label`` and their number. Nesting costs no stack of calls."""
    out: list[tuple] = []
    found = _tokens(text)
    made = itertools.count()
    # open objects and lists: [subject, predicate, what comes next, whether it may end here, last cell of a list]
    stack = [[None, None, "subject", False, None]]

    def blank() -> tuple:
        return f"{label}x{next(made)}", "blank"

    def say(s: tuple, p: str, o: tuple) -> None:
        out.append((s[0], s[1], p, *(o if len(o) == 4 else (*o, None, None)), None, None))

    def put(node: tuple) -> None:
        top = stack[-1]
        if top[2] == "subject" and len(node) == 2:
            top[0], top[2], top[3] = node, "predicate", False
        elif top[2] == "object":
            say(top[0], top[1], node)
            top[2], top[3] = "after", True
        elif top[2] == "item":
            cell = blank()
            if top[4] is None:
                top[0] = cell
            else:
                say(top[4], RDF + "rest", cell)
            say(cell, RDF + "first", node)
            top[4] = cell
        else:
            raise Fault("syntax")

    i = 0
    while i < len(found):
        kind, token = found[i]
        i += 1
        top = stack[-1]
        if kind == "dot":
            if i < len(found) or len(stack) > 1 or not top[3]:
                raise Fault("syntax")
            return out
        if token == "[" or token == "(":
            if top[2] not in ("subject", "object", "item"):
                raise Fault("syntax")
            stack.append([blank(), None, "predicate", True, None] if token == "[" else [None, None, "item", True, None])
        elif token == "]":
            if len(stack) == 1 or top[2] not in ("after", "predicate") or not top[3]:
                raise Fault("syntax")
            stack.pop()
            put(top[0])
            # an object with members can stand alone
            stack[-1][3] = stack[-1][3] or (len(stack) == 1 and top[1] is not None)
        elif token == ")":
            if top[2] != "item":
                raise Fault("syntax")
            stack.pop()
            if top[4] is not None:
                say(top[4], RDF + "rest", (RDF + "nil", "iri"))
            put(top[0] or (RDF + "nil", "iri"))
        elif token == ";":
            if top[2] == "predicate" and top[1] is not None or top[2] == "after":
                top[2], top[3] = "predicate", True
            else:
                raise Fault("syntax")
        elif token == ",":
            if top[2] != "after":
                raise Fault("syntax")
            top[2], top[3] = "object", False
        elif kind in ("long", "short"):
            value = _unescape(token[3:-3] if kind == "long" else token[1:-1])
            datatype = lang = None
            if i < len(found) and found[i][0] == "tag":
                lang, i = found[i][1][1:], i + 1
            elif i + 1 < len(found) and found[i][1] == "^^" and found[i + 1][0] in ("iri", "word"):
                datatype = space.iri(found[i + 1][1][1:-1]) if found[i + 1][0] == "iri" else space.named(found[i + 1][1])
                i += 2
            put((value, "literal", datatype, lang))
        elif kind == "iri" or (kind == "word" and (top[2] == "predicate" or not token.startswith("_:"))):
            if kind == "word" and top[2] in ("object", "item") and ":" not in token:
                datatype = "boolean" if token in ("true", "false") else next((n for n, form in _NUMBERS.items() if form.fullmatch(token)), None)
                if datatype is None:
                    raise Fault("syntax")
                put((token, "literal", XSD + datatype, None))
                continue
            name = space.iri(token[1:-1]) if kind == "iri" else RDF + "type" if token == "a" and top[2] == "predicate" else space.named(token)
            if top[2] == "predicate":
                top[1], top[2], top[3] = name, "object", False
            else:
                put((name, "iri"))
        elif kind == "word":
            put((token[2:], "blank"))
        else:
            raise Fault("syntax")
    raise Fault("syntax")


def _runs(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """Each range with its lines, in order."""
    rows = (row for b in batches for row in zip(b["file"], b["block"], b["value"], strict=True))
    for key, own in itertools.groupby(rows, key=lambda r: r[:2]):
        yield (key[0], int(key[1])), (line + "\n" for _, _, line in own)


def _frames(rows: Iterable[tuple], schema: str) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded text."""
    columns = [c.split()[0] for c in schema.split(", ")]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= ROWS or size >= TEXT:
            yield pd.DataFrame(held, columns=columns, dtype=object)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns, dtype=object)


def _batches(found: Iterable[tuple[str, list[tuple]]], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows of texts, given with each text, as batches of bounded rows and text."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in zip(*rows, strict=True)], columns)

    held, size = [], 0
    for text, rows in found:
        held += rows
        size += len(text)
        if len(held) >= ROWS or size >= TEXT:
            yield from (batch(held[i : i + ROWS]) for i in range(0, len(held), ROWS))
            held, size = [], 0
    if held:
        yield batch(held)


def _pieces(file: str, block: int, phase: int, statements: Iterable[str]) -> Iterator[tuple]:
    """Rows of statements between directives, with the directives of the range before them; last, those of all the range."""
    told: list[tuple] = []
    before = "[]"
    held, size, n = [], 0, 0

    def row() -> tuple:
        return file, block, phase, n, json.dumps(held), before, None

    for text in statements:
        directive = _directive(text)
        # each row has the directives with it, so that many of them take as much text
        if held and (directive is not None or size > max(CHUNK, len(before))):
            yield row()
            held, size, n = [], 0, n + 1
        if directive is None:
            held.append(text)
            size += len(text)
        else:
            told = _net([*told, directive])
            before = json.dumps(told)
    if held:
        yield row()
    if told:
        yield file, block, phase, n + 1, None, None, before


def _long_strings(lines: DataFrame) -> dict[str, tuple[list[int], list[str]]]:
    """For each file, its ranges that hold triple quotes and the quotes that are open after each: a row a range."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for (file, block), own in _runs(batches):
                cutters = [_Cutter(q) for q in ("", '"""', "'''")]
                for line in own:
                    for c in cutters:
                        for _ in c.feed(line):
                            pass
                        c.rest()
                yield file, block, *(c.quotes for c in cutters)

        return _frames(rows(), "file, block, plain, double, single")

    found: dict[str, tuple[list[int], list[str]]] = {}
    which = {"": "plain", '"""': "double", "'''": "single"}
    for r in lines.filter(F.col("value").rlike("\"\"\"|'''")).mapInPandas(ends, "file string, block long, plain string, double string, single string").orderBy("file", "block").collect():
        blocks, after = found.setdefault(r["file"], ([], []))
        after.append(r[which[after[-1] if after else ""]])
        blocks.append(r["block"])
    # files in which no range ends inside a string need no mention
    return {f: v for f, v in found.items() if any(v[1])}


def turtle_table(spark: SparkSession, path: str, base: str | None = None, by_file: bool = False) -> DataFrame:
    """s, s_kind, p, o, o_kind, o_datatype, o_lang, line, reason of the statements of Turtle files.

    A statement that is none has its text in ``line`` and why in ``reason``: syntax, escape (one that there is not),
    character (an escape that stands for none), prefix (one not declared before it) or base (a relative IRI without
    one); its other columns are null, and no other statement is lost. Labels of blank nodes stay as written, as one
    graph may lie in many files; with ``by_file`` they hold for their file alone. Blank nodes without a label are named by
    their place. A statement is held by one task, as is a line; the driver gets a row for each range with triple quotes.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    inside = _long_strings(lines)

    def opened(file: str, block: int) -> str:
        blocks, after = inside.get(file, ((), ()))
        i = bisect_left(blocks, block)
        return after[i - 1] if i else ""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for (file, block), own in _runs(batches):
                cutter = _Cutter(opened(file, block))
                ended = (text for line in own for text in cutter.feed(line))
                head = next(ended, None)
                if head is not None:
                    yield file, block, 0, 0, head, "head", None
                    yield from _pieces(file, block, 1, ended)
                    yield file, block, 2, 0, cutter.rest(), "tail", None
                else:
                    yield file, block, 0, 0, cutter.rest(), "whole", None

        return _frames(rows(), _PIECES)

    pieces, _ = staged(lines.mapInPandas(cut, _PIECES), "turtle")
    # a statement that crosses ranges: the tail of one, ranges without an end, the head of another
    crossing = pieces.filter("phase <> 1")
    order = Window.partitionBy("file").orderBy("block", "phase")
    number = F.sum(F.when(F.col("before") == "tail", 1).otherwise(0)).over(order)
    joined = crossing.withColumn("g", number).groupBy("file", "g").agg(F.array_sort(F.collect_list(F.struct("block", "phase", "text"))).alias("all"), F.max("block").alias("block"), F.max(F.col("before") == "head").alias("ends"))
    texts = joined.select("file", "block", F.when(F.col("ends"), 0).otherwise(2).alias("phase"), F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text"))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for file, block, phase, text in zip(b["file"], b["block"], b["phase"], b["text"], strict=True):
                    cutter = _Cutter()
                    found = [s for line in re.findall(r"[^\n]*\n|[^\n]+", text) for s in cutter.feed(line)]
                    rest = cutter.rest()
                    yield from _pieces(file, int(block), int(phase), [*found, rest] if _tokens(rest) else found)

        return _frames(rows(), _PIECES)

    every = pieces.filter("phase = 1").unionByName(texts.mapInPandas(again, _PIECES))
    every, _ = staged(every, "turtle")

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        told: list[tuple] = []
        rows = []
        for file, block, phase, net in own.sort_values(["block", "phase"])[["file", "block", "phase", "net"]].itertuples(index=False):
            rows.append((file, block, phase, json.dumps(told)))
            told = _net([*told, *map(tuple, json.loads(net or "[]"))])
        return pd.DataFrame(rows, columns=["file", "block", "phase", "above"])

    ranges = every.groupBy("file", "block", "phase").agg(F.max("net").alias("net"))
    above = ranges.groupBy("file").applyInPandas(fold, "file string, block long, phase int, above string")
    whole = every.filter("text IS NOT NULL").join(above, ["file", "block", "phase"])

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few rows at a time become Python's, and rows with the same directives share their space
        few = (b.slice(i, 64).to_pydict() for b in batches for i in range(0, b.num_rows, 64))

        def found() -> Iterator[tuple[str, list[tuple]]]:
            known = space = None
            for b in few:
                for file, block, phase, n, text, before, told in zip(*(b[c] for c in ("file", "block", "phase", "n", "text", "before", "above")), strict=True):
                    if known != (told, before):
                        known, space = (told, before), _Space(map(tuple, [*json.loads(told), *json.loads(before)]), base)
                    place = hashlib.md5(f"{file}|{block}|{phase}|{n}".encode()).hexdigest()
                    scope = hashlib.md5(file.encode()).hexdigest() + "x" if by_file else ""
                    for i, statement in enumerate(json.loads(text)):
                        if not _tokens(statement):
                            continue
                        try:
                            own = parse(statement, space, f"g{place}x{i}")
                        except Fault as fault:
                            yield statement, [(None,) * 7 + (statement.strip(), str(fault))]
                            continue
                        if scope:
                            made = f"g{place}x"
                            own = [tuple(f"f{scope}{t[j]}" if j in (0, 3) and t[j + 1] == "blank" and not t[j].startswith(made) else t[j] for j in range(9)) for t in own]
                        yield statement, own

        return _batches(found(), COLUMNS)

    return whole.mapInArrow(triples, COLUMNS)


def read_turtle(spark: SparkSession, path: str, base: str | None = None, by_file: bool = False) -> DataFrame:
    """s, s_kind, p, o, o_kind, o_datatype of the triples of Turtle files; see ``turtle_table`` for languages and for statements that are none."""
    return turtle_table(spark, path, base, by_file).filter("reason IS NULL").drop("o_lang", "line", "reason")
