"""Traces to sentences. Mathematics and abbreviations keep their periods; short fragments join their neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelore.functions.patterns import PROTECTED, STANDALONE

_BREAK = "__NEWLINE__"
_ENDS = re.compile(rf"(?<=[.!?])\s+(?=[A-Z_])|{_BREAK}")
_ALONE = re.compile(STANDALONE, re.IGNORECASE)
_KEPT = [(re.compile(p, re.DOTALL), label) for p, label in PROTECTED]


def protect(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with marks for protected expressions, and what each mark stands for.

    A pattern's matches are those of the text as the pattern found it; each takes the place
    of the first occurrence that is left.
    """
    marks: list[tuple[str, str]] = []
    for pattern, label in _KEPT:
        for found in [m.group() for m in pattern.finditer(text)]:
            mark = f"__PROT_{label}_{len(marks)}__"
            marks.append((mark, found))
            text = text.replace(found, mark, 1)
    return text, marks


def merged(sentences: list[str], least: int) -> list[str]:
    """Sentences under ``least`` words, unless they carry a signal, go with the next one, or at the end with the one before."""
    if len(sentences) < 2:
        return sentences
    out: list[str] = []
    todo = iter(sentences)
    for s in todo:
        if len(s.split()) >= least or _ALONE.search(s):
            out.append(s)
            continue
        after = next(todo, None)
        if after is not None:
            out.append(f"{s} {after}")
        elif out:
            out[-1] += f" {s}"
        else:
            out.append(s)
    return out


def segment(trace: str | None, least: int = 4, merge: bool = True) -> list[str]:
    """Sentences of a trace; none for null and blank ones."""
    out: list[str] = []
    for paragraph in re.split(r"\n\s*\n", (trace or "").strip()):
        text, marks = protect(paragraph.strip())
        parts = _ENDS.split(text.replace("\n", f" {_BREAK} "))
        for mark, found in marks:
            parts = [p.replace(mark, found) for p in parts]
        parts = [p for p in (p.strip().replace(_BREAK, "").strip() for p in parts) if p]
        out += merged(parts, least) if merge and least > 0 else parts
    return out


def sentences(least: int = 4, merge: bool = True):
    """A column function from a trace to its array of sentences, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: segment(t, least, merge))

    return run


def plain_sentences(text: Column) -> Column:
    """The older splitter, natively: line feeds, and ends of sentences before a capital, quote or bracket."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n+")
    parts = F.flatten(F.transform(lines, lambda x: F.split(F.trim(x), r"(?<=[.!?])\s+(?=[A-Z\"'(])")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
