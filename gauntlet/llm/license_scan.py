"""Licence scan: one Aho-Corasick pass finds notice phrases and identifier tags, a shunting-yard parser reads expressions.

A text is read as its words (runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased first), so a phrase is found
across line breaks and punctuation.  The automaton holds every phrase and the words of the identifier tag; a task
runs it over the words of about a megabyte of whole texts at a time, written with one blank between them.

What follows a tag in its line is a licence expression: identifiers joined by ``and``, ``or`` and ``with``, with
parentheses; ``with`` binds closest, then ``and``, then ``or``.  It is turned to postfix order and evaluated twice:
to the identifiers it names, and to how freely the text may be used (the least of what ``and`` joins, the most of
what ``or`` offers).  An expression that does not parse gives the finding without identifiers.

Cases: a null or empty text has no words and no findings (score 0, null words, empty labels).  Repeated rows are
scanned each; a phrase at several places, and phrases that overlap, count at each place.  An empty table gives an
empty result.  Texts of any length are scanned whole.  Only the id and text columns are read, so other columns
cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauntlet.llm.common import batches_of
from gauntlet.llm.textkernel import Chunk, chunks

#: The notice phrases that are counted, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases and their labels.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: How freely text under an identifier may be used (1 freely, 0 not), by the beginning of the identifier.
FREEDOM = {
    "0bsd": 1.0, "agpl": 0.2, "all-rights-reserved": 0.0, "apache": 0.9, "bsd": 0.9, "cc-by": 0.8, "cc-by-nc": 0.3,
    "cc-by-nd": 0.3, "cc-by-sa": 0.5, "cc0": 1.0, "epl": 0.5, "gfdl": 0.4, "gpl": 0.3, "isc": 0.9, "lgpl": 0.4,
    "mit": 0.9, "mpl": 0.5, "public-domain": 1.0, "unlicense": 1.0, "zlib": 0.9,
}
UNKNOWN_FREEDOM = 0.5

WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

_TOKEN = re.compile(rb"\s*(\(|\)|[a-z0-9][a-z0-9.+:-]*)")
_LEAD = re.compile(rb"[ \t:=\"']*")
_BINDING = {b"or": 1, b"and": 2, b"with": 3}


@dataclass(frozen=True)
class Licence:
    """The value of an expression: the identifiers it names and how freely it lets the text be used."""

    names: frozenset[str]
    freedom: float


def identifier(name: str) -> Licence:
    fits = [b for b in FREEDOM if name.startswith(b)]
    return Licence(frozenset([name]), FREEDOM[max(fits, key=len)] if fits else UNKNOWN_FREEDOM)


def _join(operator: bytes, a: Licence, b: Licence) -> Licence:
    if operator == b"with":                             # an exception lifts part of the licence's terms
        (licence,), (exception,) = a.names, b.names
        return Licence(frozenset([f"{licence} with {exception}"]), (a.freedom + 1) / 2)
    freedom = min(a.freedom, b.freedom) if operator == b"and" else max(a.freedom, b.freedom)
    return Licence(a.names | b.names, freedom)


def postfix(text: bytes, at: int = 0, end: int | None = None) -> tuple[list[bytes], int]:
    """The tokens of the longest expression that begins at ``at``, operators after their operands, and where it ends.

    Reading stops where the next token cannot continue an expression (a comment's end, prose).  What is read must be
    complete: ValueError if an operand or a parenthesis is missing.
    """
    out, waiting, depth, operand_next = [], [], 0, True
    end = len(text) if end is None else end
    while found := _TOKEN.match(text, at, end):
        token = found[1]
        if operand_next:
            if token == b"(":
                waiting.append(token)
                depth += 1
            elif token == b")" or token in _BINDING:
                raise ValueError("an operand is missing")
            else:
                out.append(token)
                operand_next = False
        elif token in _BINDING:
            while waiting and _BINDING.get(waiting[-1], 0) >= _BINDING[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        elif token == b")" and depth:
            while (top := waiting.pop()) != b"(":
                out.append(top)
            depth -= 1
        else:
            break
        at = found.end()
    if operand_next or depth:
        raise ValueError("the expression is not complete")
    return out + waiting[::-1], at


def evaluate(tokens: list[bytes]) -> Licence:
    """The value of an expression in postfix order; ValueError if an exception has no single licence."""
    values: list[Licence] = []
    for token in tokens:
        if token not in _BINDING:
            values.append(identifier(token.decode()))
            continue
        b, a = values.pop(), values.pop()
        if token == b"with" and len(a.names) + len(b.names) != 2:
            raise ValueError("an exception belongs to one licence")
        values.append(_join(token, a, b))
    (value,) = values
    return value


def automaton(phrases: Mapping[str, object]) -> ahocorasick.Automaton:
    """Finds phrases of whole words in text of the form `` word word ``; values are (phrase, its number of words)."""
    machine = ahocorasick.Automaton()
    for phrase in phrases:
        # the text is decoded byte by byte, and so are the phrases
        machine.add_word(f" {phrase} ".encode().decode("latin-1"), (phrase, phrase.count(" ") + 1))
    machine.make_automaton()
    return machine


@dataclass
class Place:
    row: int
    phrase: str
    first: int          # words from 0 within the row
    end_byte: int       # in the chunk, after the last word


def find_phrases(chunk: Chunk, machine: ahocorasick.Automaton) -> tuple[np.ndarray, list[Place]]:
    """The number of words of each row, and every place of every phrase, in order within a row."""
    starts, ends, rows = chunk.runs(WORD[chunk.data])
    counts = np.diff(rows)
    if not len(starts):
        return counts, []
    # the words with a blank before and after; a row's first word has a line feed before, which no phrase has
    lengths = ends - starts
    row_of = np.repeat(np.arange(len(counts)), counts)
    leading = np.ones(len(starts), np.int64)
    leading[rows[:-1][counts > 0]] = 3                   # blank (of the row before), line feed, blank
    at = np.cumsum(leading + lengths) - lengths          # where each word stands
    line = np.full(int(at[-1] + lengths[-1]) + 1, 32, np.uint8)
    line[at[rows[:-1][counts > 0]] - 2] = 10
    inside = np.repeat(at - starts, lengths) + _ranges(starts, lengths)
    line[inside] = chunk.data[_ranges(starts, lengths)]
    found = []
    for last, (phrase, width) in machine.iter(line.tobytes().decode("latin-1")):
        end = int(np.searchsorted(at, last)) - 1         # the word before the blank at `last`
        row = int(row_of[end])
        found.append(Place(row, phrase, end - width + 1 - int(rows[row]), int(ends[end])))
    return counts, found


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


FINDINGS = "doc_id long, n_words long, findings array<struct<kind:string,phrase:string,word:long,names:array<string>,freedom:double>>"
_FINDING = pa.struct([("kind", pa.string()), ("phrase", pa.string()), ("word", pa.int64()), ("names", pa.list_(pa.string())),
                      ("freedom", pa.float64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("findings", pa.list_(_FINDING))])


def scan_texts(docs: DataFrame, phrases: Mapping[str, str] | None = None, tag: str = TAG) -> DataFrame:
    """One row per document: its number of words and its findings, in the order of the text.

    A finding is a notice (``phrase`` as given, its label in ``names``) or a tag (``phrase`` is the expression,
    lower-cased, and ``names`` are its identifiers; empty if it does not parse), with the word it begins at.
    """
    labels = dict(phrases if phrases is not None else MORE_PHRASES | BASE_PHRASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton({**labels, tag: None})
        known = {p: identifier(label) for p, label in labels.items()}
        for batch in batches:
            for chunk in chunks(batch.column("text"), lower=True):
                counts, places = find_phrases(chunk, machine)
                out: list[list[dict]] = [[] for _ in counts]
                lines = Lines(chunk) if any(p.phrase == tag for p in places) else None
                for p in places:
                    if p.phrase == tag:
                        kind, (phrase, value) = "tag", lines.expression(p)
                    else:
                        kind, phrase, value = "notice", p.phrase, known[p.phrase]
                    out[p.row].append({"kind": kind, "phrase": phrase, "word": p.first, "names": sorted(value.names),
                                       "freedom": value.freedom})
                ids = batch.column("doc_id").slice(chunk.first, len(chunk))
                yield from batches_of(pa.table({"doc_id": ids, "n_words": counts, "findings": pa.array(out, pa.list_(_FINDING))}),
                                      _SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FINDINGS)


_NOTHING = Licence(frozenset(), UNKNOWN_FREEDOM)


class Lines:
    """What stands after a tag up to the end of its line; the chunk's lines are found once for all its tags."""

    def __init__(self, chunk: Chunk):
        self.text, self.offsets = chunk.data.tobytes(), chunk.offsets
        self.breaks = np.flatnonzero((chunk.data == 10) | (chunk.data == 13))

    def expression(self, place: Place) -> tuple[str, Licence]:
        begin = _LEAD.match(self.text, place.end_byte).end()
        k = int(np.searchsorted(self.breaks, begin))
        end = min(int(self.breaks[k]) if k < len(self.breaks) else len(self.text), int(self.offsets[place.row + 1]))
        try:
            tokens, stop = postfix(self.text, begin, end)
            return self.text[begin:stop].decode("utf-8", "replace"), evaluate(tokens)
        except ValueError:
            return "", _NOTHING


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: words, places of the base phrases, labels, and a score.

    ``score`` says how freely the text may be used: the least freedom of all findings, 0 where nothing grants a use.
    ``labels`` holds the labels of all notices and the identifiers of all tags.
    """
    found = scan_texts(docs)
    base = F.filter("findings", lambda f: (f["kind"] == "notice") & f["phrase"].isin(list(BASE_PHRASES)))
    place = F.transform("_base", lambda f: f["word"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(c, lambda f: f["names"])))), ",")
    found = found.withColumn("_base", base)
    return found.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"), joined("_base").alias("base_labels"), joined("findings").alias("labels"),
        F.coalesce(F.array_min(F.transform("findings", lambda f: f["freedom"])), F.lit(0.0)).alias("score"))
