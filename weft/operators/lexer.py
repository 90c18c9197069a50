"""Source texts taken apart at their brackets: a table of the parts of every bracketed group, with their lines and how they nest.

One pass over each file, linear in its length, with no recursion: comments and strings are skipped, a stack holds the open brackets, and
commas and semicolons end parts. What the parts mean is found by joins and filters on the table.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CLOSES = {")": "(", "]": "[", "}": "{"}
#: Groups nested deeper than this are part of their parents' text and have no parts of their own; of what stands before a bracket so many characters are told.
DEPTH, HEAD = 24, 300
_STRING = r"\"(?:\\.|[^\"\\])*+(?:\"|\Z)|'(?:\\.|[^'\\])*+(?:'|\Z)|`(?:\\.|[^`\\])*+(?:`|\Z)"
_COMMENTS = {"slash": "//[^\n]*", "dash": "--[^\n]*", "hash": "#[^\n]*"}
_KEY = re.compile(r"\s*([\"'`]?)([A-Za-z_$][\w$]*)\1\s*:")
_MARKS = re.compile(_STRING + r"|[()\[\]{},;]", re.S)

SCHEMA = (
    "path string, id int, part int, bracket string, up int, up_part int, depth int, head string, opened int, line int, at int, key string, value string, text string, "
    "closed boolean, chain array<struct<id:int,bracket:string,key:string,part:int>>"
)


def masked(text: str, comment: str) -> str:
    """The text with comments (of lines by kind, and blocks) as blanks; line ends and all places stay."""
    pattern = re.compile(rf"({_STRING})|{_COMMENTS[comment]}|/\*.*?(?:\*/|\Z)", re.S)
    return pattern.sub(lambda m: m[0] if m[1] is not None else re.sub("[^\n]", " ", m[0]), text)


def parts(text: str, comment: str) -> Iterator[tuple]:
    """Rows of SCHEMA without path: the file itself is group 0, without a bracket. A group that is never closed says so."""
    text = masked(text, comment)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(breaks, at - 1) + 1
    # A frame: id, bracket, up, up_part, head, opened, chain, the running part's start and number, and the rows made so far.
    stack: list[list] = [[0, "", None, None, "", 1, [], 0, 0, []]]
    made = 0

    def end(frame: list, at: int) -> None:
        start, number = frame[7], frame[8]
        own = text[start:at]
        if own.strip():
            first = start + len(own) - len(own.lstrip())
            key = _KEY.match(own)
            frame[9].append((frame[0], number, frame[1], frame[2], frame[3], len(frame[6]), frame[4], frame[5], line(first), first, key and key[2], own[key.end() :].strip() if key else None, own.strip()))
        frame[7], frame[8] = at + 1, number + 1

    def rows(frame: list, closed: bool) -> Iterator[tuple]:
        blank = (frame[0], 0, frame[1], frame[2], frame[3], len(frame[6]), frame[4], frame[5], frame[5], None, None, None, "")
        for row in (frame[9] or [blank]) if len(frame[6]) <= DEPTH else ():
            yield (*row, closed, frame[6])

    for m in _MARKS.finditer(text):
        sign, at = m[0], m.start()
        if sign in "([{":
            made += 1
            top = stack[-1]
            key = _KEY.match(text, top[7], at)
            link = {"id": made, "bracket": sign, "key": key and key[2], "part": top[8]}
            chain = [*top[6], link] if len(top[6]) <= DEPTH else top[6]
            stack.append([made, sign, top[0], top[8], text[max(0, at - HEAD) : at], line(at), chain, at + 1, 0, []])
        elif sign in ",;":
            end(stack[-1], at)
        elif sign in CLOSES and any(frame[1] == CLOSES[sign] for frame in stack[-DEPTH:]):
            while True:  # brackets within it that were never closed end with it
                frame = stack.pop()
                end(frame, at)
                yield from rows(frame, frame[1] == CLOSES[sign])
                if frame[1] == CLOSES[sign]:
                    break
    while stack:
        frame = stack.pop()
        end(frame, len(text))
        yield from rows(frame, not frame[1])


def lexed(files: DataFrame, comment: str) -> DataFrame:
    """The parts of all groups of files (path, content), one row each: see SCHEMA.

    A group has an `id`, its bracket, the group and part that it stands in (up, up_part), what stands before it (head) and the line where it opens;
    a part has a number, a line, a place (at), and, if it reads `key: value`, these two. `chain` lists the groups around a part from the outermost.
    A group without parts has one blank one; null contents are empty.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in re.split(r", (?![^<]*>)", SCHEMA)]
        link = pa.struct([("id", pa.int32()), ("bracket", pa.string()), ("key", pa.string()), ("part", pa.int32())])
        kinds = [pa.string(), *[pa.int32()] * 2, pa.string(), *[pa.int32()] * 3, pa.string(), *[pa.int32()] * 3, *[pa.string()] * 3, pa.bool_(), pa.list_(link)]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                found = [(path, *row) for row in parts(content or "", comment)]
                for at in range(0, len(found), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found[at : at + 4096]), kinds)], names=names)

    return files.select("path", "content").mapInArrow(read, SCHEMA)
