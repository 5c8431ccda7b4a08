"""Think blocks, answers in model outputs, and whether an answer is right."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Commands whose braces are dropped, and the patterns of stated answers and choices, in order.
WRAPPERS = ("text", "textbf", "textit", "mathrm", "mathbf", "mathit", "operatorname", "textrm")
STATED = (r"(?:the\s+)?(?:final\s+)?answer\s+is\s*:?\s*(.+?)(?:\.\s*$|$)", r"(?:therefore|thus|so|hence),?\s*(?:the\s+)?answer\s+is\s*:?\s*(.+?)(?:\.\s*$|$)", r"####\s*(.+?)$")
CHOICES = (
    r"(?:the\s+)?(?:correct\s+)?(?:final\s+)?answer\s+is\s*:?\s*\(?([A-Da-d])\)?", r"\\boxed\{\s*\(?([A-Da-d])\)?\s*\}", r"(?:i(?:'ll)?\s+)?(?:choose|pick|select|go\s+with)\s+\(?([A-Da-d])\)?",
    r"\(([A-Da-d])\)\s*\.?\s*$", r"(?:^|\n)\s*([A-Da-d])\s*\.?\s*$", r"(?:option|choice)\s+([A-Da-d])\b",
)
NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def think_block(text: Column) -> Column:
    """struct(trace, answer): between the tags, before a lone closing tag, or no trace at all."""
    t = F.coalesce(text, F.lit(""))
    full = F.regexp_extract(t, r"(?s)<think>(.*?)</think>(.*)$", 0) != ""
    close = F.locate("</think>", t)
    trace = F.when(full, F.regexp_extract(t, r"(?s)<think>(.*?)</think>", 1)).when(close > 0, F.substring(t, F.lit(1), close - 1)).otherwise("")
    answer = F.when(full, F.regexp_extract(t, r"(?s)<think>.*?</think>(.*)$", 1)).when(close > 0, F.substring(t, close + 8, F.char_length(t))).otherwise(t)
    return F.struct(_strip(trace).alias("trace"), _strip(answer).alias("answer"))


def repaired_trace(trace: Column, response: Column) -> Column:
    """The trace, or where it has ten characters at most what the full response holds."""
    return F.when(F.char_length(F.coalesce(trace, F.lit(""))) <= 10, think_block(response).getField("trace")).otherwise(trace)


def closing(s: str, start: int) -> int:
    """Place of the brace that closes the one before ``start``, -1 if there is none."""
    depth = 1
    for k in range(start, len(s)):
        depth += (s[k] == "{") - (s[k] == "}")
        if not depth:
            return k
    return -1


def boxed(s: str) -> str | None:
    """What the last \\boxed{} holds, braces matched; to the last brace of all where they don't."""
    at = s.rfind(r"\boxed{")
    if at < 0:
        return None
    end = closing(s, at + 7)
    if end >= 0:
        return s[at + 7 : end].strip()
    found = re.search(r"\\boxed\{(.+)\}", s, re.DOTALL)
    return found.group(1).strip() if found else None


def normalized(s: str) -> str:
    """A canonical form of a mathematical answer, as text."""
    s = s.strip()
    inner = boxed(s)
    s = (s if inner is None else inner).replace("$", "").strip()
    for name in WRAPPERS:
        head = f"\\{name}{{"
        while (at := s.find(head)) >= 0 and (end := closing(s, at + len(head))) >= 0:
            s = s[:at] + s[at + len(head) : end] + s[end + 1 :]
    s = s.replace(r"\left", "").replace(r"\right", "")
    s = re.sub(r"\s+([)\]])", r"\1", re.sub(r"([(\[])\s+", r"\1", s))
    s = re.sub(r"\s+", " ", s).strip()
    # a period ends a sentence unless it ends an ellipsis or a number like 1.2.
    if s.endswith(".") and not s.endswith("...") and not re.search(r"\d+\.\d+\.$", s):
        s = s[:-1].strip()
    return s


def numeric(s: str) -> float | None:
    """The number that an answer is: plain, a fraction, a percentage, with commas."""
    s = normalized(s)
    for form, value in (
        (None, lambda m: float(s)),
        (r"^(-?\d+(?:\.\d+)?)\s*/\s*(-?\d+(?:\.\d+)?)$", lambda m: float(m[1]) / float(m[2])),
        (r"^\\frac\{(-?\d+(?:\.\d+)?)\}\{(-?\d+(?:\.\d+)?)\}$", lambda m: float(m[1]) / float(m[2])),
        (r"^(-?\d+(?:\.\d+)?)\s*%$", lambda m: float(m[1]) / 100),
        (None, lambda m: float(s.replace(",", ""))),
    ):
        found = form is None or re.match(form, s)
        if found:
            try:
                return value(found)
            except (ValueError, ZeroDivisionError):
                continue
    return None


def equivalent(a: str, b: str, tolerance: float = 1e-6, symbolic: Callable[[str, str], bool] | None = None) -> bool:
    """Whether two answers are the same as text, in either case, as numbers, or by a symbolic test that the caller has."""
    a, b = normalized(a), normalized(b)
    if a == b or a.lower() == b.lower():
        return True
    x, y = numeric(a), numeric(b)
    return (x is not None and y is not None and abs(x - y) < tolerance) or bool(symbolic and symbolic(a, b))


def after_marks(text: str) -> str:
    """The answer after "####", else the last number, else the text."""
    found = re.search(r"####\s*(.+?)$", text, re.MULTILINE)
    if found:
        return found[1].strip().replace(",", "")
    numbers = re.findall(NUMBER, text)
    return numbers[-1].replace(",", "") if numbers else text.strip()


def stated_answer(text: str) -> str | None:
    """The boxed answer, else a stated one, else the last number."""
    text = text.strip()
    if (inner := boxed(text)) is not None:
        return inner.strip()
    for pattern in STATED:
        if found := re.search(pattern, text, re.IGNORECASE | re.MULTILINE):
            said = found[1].strip()
            inner = boxed(said)
            return said if inner is None else inner.strip()
    numbers = re.findall(NUMBER + r"(?:/\d+)?", text)
    return numbers[-1].replace(",", "") if numbers else None


def choice(text: str) -> str | None:
    """The letter chosen, else the last letter A-D that stands alone (the article "a" counts)."""
    text = text.strip()
    for pattern in CHOICES:
        if found := re.search(pattern, text, re.IGNORECASE | re.MULTILINE):
            return found[1].upper()
    alone = re.findall(r"\b([A-Da-d])\b", text)
    return alone[-1].upper() if alone else None


def score(answer: str, truth: str, kind: str, extraction: str | None = None) -> dict:
    """{is_correct, extracted_answer, ground_truth_normalized, comparison_method}; an unknown kind is an error."""
    if kind == "exact_match_math":
        got, want, method = stated_answer(answer), normalized(truth), "math_equiv"
        right = got is not None and equivalent(got, truth)
        want = truth if got is None else want
    elif kind == "exact_match_numeric":
        got, want, method = stated_answer(answer), after_marks(truth) if extraction == "gsm8k" else truth.strip(), "numeric_equiv"
        right = got is not None and equivalent(got, want)
    elif kind == "multiple_choice":
        got, method, want = choice(answer), "mc_letter_match", truth.strip().upper()
        want = dict(zip("1234", "ABCD", strict=True)).get(want, want)
        right = got is not None and got == want
        want = truth if got is None else want
    else:
        raise ValueError(f"unknown answer type: {kind}")
    return {"is_correct": right, "extracted_answer": got, "ground_truth_normalized": want, "comparison_method": method if got is not None else "extraction_failed"}


SCORE = "is_correct boolean, extracted_answer string, ground_truth_normalized string, comparison_method string"


KINDS = ("exact_match_math", "exact_match_numeric", "multiple_choice")
#: Scored rows that a task remembers.
KNOWN = 20_000


def score_answer(answer: Column, truth: Column, kind: Column, extraction: Column) -> Column:
    """``score`` as a column of structs, in Arrow batches; null answers and truths are empty texts.

    Rows of an unknown or null kind have no verdict: null, and the method "unknown_type".
    Equal rows of a task are scored once, as far as KNOWN of them are remembered; long ones are not.
    """

    @F.pandas_udf(SCORE)
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names, known = [x.split()[0] for x in SCORE.split(", ")], {}
        for part in parts:
            out = []
            for row in zip(*part, strict=True):
                found = known.get(row)
                if found is None:
                    found = tuple(score(row[0] or "", row[1] or "", row[2], row[3])[n] for n in names) if row[2] in KINDS else (None, None, row[1], "unknown_type")
                    if len(row[0] or "") + len(row[1] or "") < 500:
                        if len(known) >= KNOWN:
                            known.clear()
                        known[row] = found
                out.append(found)
            yield pd.DataFrame(out, columns=names)

    return run(answer, truth, kind, extraction)


def each(f: Callable, kind: str = "string"):
    """A column function from one of the functions of texts above, in Arrow batches; null where a text is null."""

    @F.pandas_udf(kind)
    def one(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else f(x))

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return lambda *columns: (one, two)[len(columns) - 1](*columns)


def native_choice(text: Column) -> Column:
    """``choice`` in expressions."""
    t = _strip(F.coalesce(text, F.lit("")))
    tried = [F.nullif(F.upper(F.regexp_extract(t, f"(?im){p}", 1)), F.lit("")) for p in CHOICES]
    alone = F.regexp_extract_all(t, F.lit(r"\b([A-Da-d])\b"), F.lit(1))
    return F.coalesce(*tried, F.upper(F.try_element_at(alone, F.lit(-1))))


def native_after_marks(text: Column) -> Column:
    """``after_marks`` in expressions."""
    t = F.coalesce(text, F.lit(""))
    marked = F.nullif(F.regexp_extract(t, r"(?m)####\s*(.+?)$", 1), F.lit(""))
    last = F.try_element_at(F.regexp_extract_all(t, F.lit(f"({NUMBER})"), F.lit(1)), F.lit(-1))
    return F.coalesce(F.replace(_strip(marked), F.lit(","), F.lit("")), F.replace(last, F.lit(","), F.lit("")), _strip(t))


def byte_text(text: Column) -> Column:
    """Text whose bytes a tokenizer spelled as printable letters, read back; text without its marks stays as it is."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    table = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}

    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        def back(t: str | None) -> str | None:
            if not t or ("Ġ" not in t and "Ċ" not in t):
                return t
            return b"".join(bytes([table[c]]) if c in table else c.encode("utf-8", "replace") for c in t).decode("utf-8", "replace")

        return part.map(back)

    return run(text)
