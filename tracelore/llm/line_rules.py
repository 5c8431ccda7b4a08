"""Line-first cleaning: rules per line, failures removed, documents that lose too much rejected.

Everything is DataFrame functions: a document's lines and words are arrays inside
its row, so there is no shuffle and a row is the largest unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelore.llm.textkit import WORD

#: Characters that mark markup rather than prose.
SYMBOLS = "#*$%&|<>"
#: Phrases of boilerplate lines, lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript",
    "click here", "read more", "subscribe to", "sign up for", "lorem ipsum", "powered by",
)
#: Words that alone make up navigation lines, lower case.
NAVIGATION = "home|menu|login|log in|sign in|next|previous|back|search|share|print|top|contact|sitemap"
#: A line fails when more than 1 in so many of its characters are SYMBOLS.
SYMBOL_SHARE = 12
#: A line of at least so many words fails when as many as half of them end in '!' or '?'.
SHOUT_WORDS = 3
#: A document must keep at least so many percent of its characters outside white space.
KEEP_PERCENT = 70


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def dense(col: Column) -> Column:
    """The text without white space."""
    return F.translate(col, " \t\n\x0b\x0c\r", "")


def n_symbols(col: Column) -> Column:
    return F.char_length(col) - F.char_length(F.translate(col, SYMBOLS, ""))


def bind(value: Column, body) -> Column:
    """``body`` of the value, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that is found twice or more in the array, the first one included.

    Each window is a number, hash bits above its place; sorted, windows with the same hash
    bits are neighbours. Those are compared as strings, so the count is exact.
    """
    place = (1 << PLACE_BITS) - 1
    numbers = lambda w: F.sort_array(F.transform(F.sequence(F.lit(0).cast("long"), (F.size(w) - 3).cast("long")), lambda i: F.xxhash64(F.get(w, i.cast("int")), F.get(w, (i + 1).cast("int")), F.get(w, (i + 2).cast("int"))).bitwiseAND(F.lit(~place)).bitwiseOR(i)))
    suspects = lambda p: F.filter(p, lambda x, k: _same(F.shiftright(x, PLACE_BITS), F.shiftright(F.get(p, k - 1), PLACE_BITS)) | _same(F.shiftright(x, PLACE_BITS), F.shiftright(F.get(p, k + 1), PLACE_BITS)))
    places = lambda p: F.transform(p, lambda x: x.bitwiseAND(F.lit(place)).cast("int"))
    everywhere = lambda w: F.sequence(F.lit(0), F.size(w) - 3)  # noqa: E731  beyond the places that a number can hold, all windows are compared as strings
    found = lambda w: F.when(F.size(w) <= place, places(bind(numbers(w), suspects))).otherwise(everywhere(w))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(words, lambda w: bind(_named(found(w), w), lambda p: _covered(_repeated(p)))))


#: Bits of a window's number that hold its place.
PLACE_BITS = 24


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def _repeated(pairs: Column) -> Column:
    """Entries whose key equals that of a neighbour in a sorted array of (h, i)."""
    return F.filter(pairs, lambda x, k: _same(x.getField("h"), F.get(pairs, k - 1).getField("h")) | _same(x.getField("h"), F.get(pairs, k + 1).getField("h")))


def _named(places: Column, words: Column) -> Column:
    return F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))


def _covered(pairs: Column) -> Column:
    """Words that the windows at the given positions cover together."""
    at = F.sort_array(F.transform(pairs, lambda x: x.getField("i")))
    return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc.getField("n") + F.least(F.lit(3), i - acc.getField("last"))).alias("n")), lambda acc: acc.getField("n"))


def line_profile(line: Column) -> Column:
    """(line, size, n_symbols, bad): characters outside white space, symbols, and whether it breaks a rule.

    The rules are on punctuation, navigation and boilerplate. Lines without a word never fail.
    """
    words = F.regexp_count(line, F.lit(WORD))
    shouts = F.regexp_count(line, F.lit(r"[!?](?:[\x20\x09-\x0D]|$)"))

    def judged(x: Column) -> Column:
        size, symbols, n_words, n_shouts = (x.getField(k) for k in ("size", "n_symbols", "n_words", "n_shouts"))
        low = F.lower(line)
        navigation = low.rlike(rf"^[\x20\x09-\x0D]*(?:(?:{NAVIGATION})[\x20\x09-\x0D|>/]*)+$")
        bad = (symbols * SYMBOL_SHARE > size) | ((n_words >= SHOUT_WORDS) & (n_shouts * 2 >= n_words)) | ~line.rlike(r"\p{L}|[0-9]") | navigation
        for phrase in BOILERPLATE:
            bad = bad | low.contains(phrase)
        return F.struct(line.alias("line"), size.alias("size"), symbols.alias("n_symbols"), ((size > 0) & bad).alias("bad"))

    return bind(F.struct(F.char_length(dense(line)).alias("size"), n_symbols(line).alias("n_symbols"), words.alias("n_words"), shouts.alias("n_shouts")), judged)


def profiled(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with _lines, the profiles of the lines; each line is looked at once for all that follows."""
    return docs if "_lines" in docs.columns else docs.withColumn("_lines", F.transform(F.split(_text(F.col(text)), "\n"), line_profile))


def total(lines: Column, field: str) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda acc, x: acc + x.getField(field))


def clean(docs: DataFrame, *, text: str = "text", keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """All columns of ``docs``, plus clean_text, n_lines, n_failed_lines, kept_chars, all_chars and lines_kept.

    clean_text has the lines that pass, in order. lines_kept is false where the passing
    lines hold under ``keep_percent`` of the characters outside white space; texts that
    are null or empty, or have no words, are not kept. Repeated rows get equal results.
    """
    out = profiled(docs, text)
    good = F.filter("_lines", lambda x: ~x.getField("bad"))
    out = out.withColumns({"clean_text": F.array_join(F.transform(good, lambda x: x.getField("line")), "\n"), "n_lines": F.size("_lines"), "n_failed_lines": F.size(F.filter("_lines", lambda x: x.getField("bad"))), "all_chars": total(F.col("_lines"), "size"), "kept_chars": total(good, "size")})
    return out.withColumn("lines_kept", (F.col("all_chars") > 0) & (F.col("kept_chars") * 100 >= F.col("all_chars") * keep_percent)).drop("_lines")


def base_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """All columns of ``docs``, plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    had = "_lines" in docs.columns
    out = profiled(docs, text).withColumn("_words", F.regexp_extract_all(_text(F.col(text)), F.lit(WORD), F.lit(0)))
    worded = F.transform(F.filter("_lines", lambda x: x.getField("size") > 0), lambda x: x.getField("line"))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"), "word_chars": total(F.col("_lines"), "size"), "n_symbols": total(F.col("_lines"), "n_symbols"),
        "n_dup_lines": bind(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long"), "n_repeat_words": repeat_words(F.col("_words")).cast("long"),
    })
    return out.drop("_words", *([] if had else ["_lines"])).withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def rule_report(docs: DataFrame) -> DataFrame:
    """The digest that query op5 returns: one row per row of ``docs`` (doc_id, text)."""
    out = clean(base_counts(profiled(docs.select("doc_id", "text"), "text")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("lines_kept")).alias("kept"), F.col("kept_chars"), F.col("n_failed_lines").cast("long").alias("n_failed_lines"))


def _sql() -> str:
    space, words = r"[\x20\x09-\x0D]", f"regexp_extract_all(t, '{WORD}')"
    size = f"length(regexp_replace(l, '{space}+', '', 'g'))"
    fails = f"""{size} > 0 AND (length(regexp_replace(l, '[^{SYMBOLS}]', '', 'g')) * {SYMBOL_SHARE} > {size}
        OR (len(regexp_extract_all(l, '{WORD}')) >= {SHOUT_WORDS} AND len(regexp_extract_all(l, '[!?](?:{space}|$)')) * 2 >= len(regexp_extract_all(l, '{WORD}')))
        OR NOT regexp_matches(l, '\\p{{L}}|[0-9]') OR regexp_matches(lower(l), '^{space}*(?:(?:{NAVIGATION})[\\x20\\x09-\\x0D|>/]*)+$')
        OR regexp_matches(lower(l), '{"|".join(BOILERPLATE)}'))"""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, {words} AS ws FROM d)),
g AS (SELECT r, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM m, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
l AS (SELECT r, l, ({fails}) AS bad, {size} AS size FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
s AS (SELECT r, (count(*) FILTER (size > 0)) - (count(DISTINCT l) FILTER (size > 0)) AS n_dup, sum(CASE WHEN bad THEN 0 ELSE size END) AS kept_chars, count(*) FILTER (bad) AS n_bad FROM l GROUP BY r),
x AS (SELECT doc_id, len({words})::BIGINT AS n_words, length(regexp_replace(t, '{space}+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
  s.n_dup::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, s.kept_chars::BIGINT AS kept_chars, s.n_bad::BIGINT AS n_failed_lines FROM d JOIN s USING (r) LEFT JOIN p USING (r)),
y AS (SELECT *, (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND word_chars > 0 AND kept_chars * 100 >= word_chars * {KEEP_PERCENT}) AS kept, kept_chars, n_failed_lines FROM y"""


RULES_SQL = _sql()
