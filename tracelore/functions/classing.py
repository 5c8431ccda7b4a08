"""Classes of sentences in Arrow batches: all patterns of a class in one pass of a regular expression without backtracking."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracelore.functions.patterns import SEVEN, SIX

TABLES = {"seven": SEVEN, "six": SIX}
#: What may not follow stands at the end of a pattern; it is looked at where the rest of the pattern matches.
_AHEAD = re.compile(r"\(\?!.*$")
_PLAIN = r"[^\x00-\x7F]|[\x0b\x1c-\x1f]"


class _Plain(dict):
    """Characters as the patterns see them: letters and digits of any script end no word, its spaces are spaces, other signs are signs."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = c if code < 128 and not c.isspace() or c in "\t\n\r\f " else "_" if c.isalnum() else " " if c.isspace() else "\x01"
        return out


# fixed values: the two signs that are another letter's capital
_TABLE = _Plain({0x17F: "s", 0x212A: "k"})


def _matches(s: pa.Array, patterns: list[str]) -> np.ndarray:
    """Whether any of the patterns is found in each text."""
    free = [p for p in patterns if not _AHEAD.search(p)]
    hit = np.zeros(len(s), bool)
    if free:
        hit = pc.match_substring_regex(s, "|".join(f"(?:{p})" for p in free), ignore_case=True).to_numpy(zero_copy_only=False)
    for p in patterns:
        if _AHEAD.search(p):
            whole = re.compile(p, re.IGNORECASE)
            likely = np.flatnonzero(pc.match_substring_regex(s, _AHEAD.sub("", p), ignore_case=True).to_numpy(zero_copy_only=False) & ~hit)
            hit[[k for k in likely.tolist() if whole.search(s[k].as_py())]] = True
    return hit


def labels(sentences: list[str], table: str = "seven") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(behavior, confidence, matched pattern) of each sentence: the strongest class with a match, else F.

    Confidence is 1 with one class matching, 0.7 with several, 0.5 with none, 0 for blank text.
    """
    patterns = TABLES[table]
    s = pc.utf8_trim_whitespace(pa.array(sentences, pa.string()))
    odd = np.flatnonzero(pc.match_substring_regex(s, _PLAIN).to_numpy(zero_copy_only=False))
    if len(odd):
        plain = s.to_pylist()
        for k in odd.tolist():
            plain[k] = plain[k].translate(_TABLE)
        s = pa.array(plain, pa.string())
    behavior, which = np.full(len(s), "F", object), np.full(len(s), None, object)
    classes = np.zeros(len(s), np.int64)
    for b, ps in patterns.items():
        hit = _matches(s, list(ps))
        open_ = np.flatnonzero(hit & (classes == 0))
        behavior[open_] = b
        classes += hit
        for p in ps:
            if not len(open_):
                break
            found = _matches(s.take(pa.array(open_)), [p])
            which[open_[found]] = p
            open_ = open_[~found]
    blank = pc.equal(s, "").to_numpy(zero_copy_only=False)
    confidence = np.where(blank, 0.0, np.where(classes == 0, 0.5, np.where(classes == 1, 1.0, 0.7)))
    return behavior, confidence, which
