"""Removal of passages that repeat, by suffix arrays of shards.

Every string of LENGTH bytes holds an anchor: the least hash among its strings of GRAM
bytes. Consecutive strings with one anchor make a segment, and two equal strings lie in
segments of the same anchor, at the same place. Hence:

1. Tasks cut texts into segments. Equal segments are counted; all strings of a segment that
   is found twice repeat.
2. Segments that are found once, but share their anchor with others, go to shards by
   anchor, one copy of each; a shard's suffix array (induced sorting) and permuted
   common prefixes tell which of their strings repeat.
3. Anchors with over HOT different segments are not taken to one shard: their strings are
   cut into blocks. A block that is found twice as a whole repeats; one whose strings'
   common core is found twice is cut further, down to blocks of one string.

Removed spans are unions of repeated strings, judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelore.llm import textkit
from tracelore.llm.suffix_array import longest_shared, suffix_array
from tracelore.llm.textkit import chunks, drop_stored, ids_of, join_sizes, lean, left_by_key, likely_in, marked_in, mix, prefix_hash, shuffle_width, span_hash, stored, word_bounds, word_hashes

#: Bytes of a repeated string, and of the grams that anchors are chosen among.
LENGTH, GRAM = 400, 100
#: Words of a repeated passage (over 50); characters that stand for a word in ``word_codes``.
WORDS, CODE = 51, 7
#: Different segments of one anchor that may go to one shard; block sizes for those of more.
HOT, BLOCKS = 256, (64, 16, 4, 1)
#: Bytes of one suffix array, and of texts that are cut at once: a worker holds some 100 bytes for each.
SLAB, CUT_BYTES = 1 << 20, 1 << 18
_PLACE = 22


def _letters(data: np.ndarray, step: int) -> np.ndarray:
    """The letters of the data: its bytes, or where ``step`` is more, numbers of so many bytes, eight at most."""
    if step == 1:
        return data
    out = np.zeros(len(data) // step, np.uint64)
    for k in range(step):
        out = (out << np.uint64(8)) | data[k::step]
    return out


def _grams(letters: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Running hash of the letters, and the hash of each of their strings of ``gram`` letters."""
    prefix = prefix_hash(letters)
    _, down = textkit._powers(len(prefix))
    return prefix, mix((prefix[gram:] - prefix[:-gram]) * down[: len(prefix) - gram])


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, step: int = 1) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, document, first start, last start) of all segments of a chunk, starts from the text's begin.

    Everything is in bytes; with ``step`` strings start at multiples of it only, and their letters have so many bytes.
    """
    none = np.zeros(0, np.int64)
    data, offsets, length, gram = _letters(data, step), offsets // step, length // step, gram // step
    n, width = len(data), length - gram + 1
    if n < length or np.diff(offsets).max(initial=0) < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    prefix, grams = _grams(data, gram)
    bits = np.uint64(max(_PLACE, int(n).bit_length()))
    place = (np.uint64(1) << bits) - np.uint64(1)
    # the place is below the hash: the first of equal ones is least
    value = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    rows = np.concatenate([value, np.full(-len(value) % width, ~np.uint64(0))]).reshape(-1, width)
    up = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    m = len(value)
    anchor = (np.minimum(back[: m - width + 1], up[width - 1 : m]) & place).astype(np.int64)
    size = np.diff(offsets)
    inside = np.zeros(n + 1, np.int32)
    some = size >= length
    np.add.at(inside, offsets[:-1][some], 1)
    np.add.at(inside, (offsets[1:] - length + 1)[some], -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(anchor)] > 0)
    anchor = anchor[start]
    # a segment ends with its text: the next one that is long enough starts at its first byte
    opens = np.zeros(n, bool)
    opens[offsets[:-1][some]] = True
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | opens[start[1:]]))
    last = np.append(first[1:], len(start)) - 1
    lo, hi = start[first], start[last]
    doc = np.searchsorted(offsets, lo, side="right") - 1
    return grams[anchor[first]], span_hash(prefix, lo, hi + length), doc, step * (lo - offsets[doc]), step * (hi - offsets[doc])


SEGMENTS = "h long, seg long, n long, key binary, lo int, hi int, covered boolean"


def _cut(length: int, gram: int, step: int):
    """Texts to segments; of segments that are equal within the batch the first counts for all, the others come out covered, joined where they touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            parts = [(h, s, d + first, lo, hi) for first, _, data, offsets in chunks(batch.column(1), CUT_BYTES) for h, s, d, lo, hi in [segments(data, offsets, length, gram, step)]]
            h, s, d, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 5
            if not len(h):
                continue
            order = np.lexsort((np.arange(len(h)), s, h))
            head = np.append(True, (h[order][1:] != h[order][:-1]) | (s[order][1:] != s[order][:-1]))
            count = np.diff(np.append(np.flatnonzero(head), len(h)))
            first = order[head]
            yield _segment_rows(h[first], s[first], count, keys.take(pa.array(d[first])), lo[first], hi[first], count > 1)
            rest = np.sort(order[~head])
            if len(rest):
                # consecutive segments of a text in one row
                joins = np.append(False, (d[rest][1:] == d[rest][:-1]) & (lo[rest][1:] == hi[rest][:-1] + step))
                begin = np.flatnonzero(~joins)
                end = np.append(begin[1:], len(rest)) - 1
                zero = np.zeros(len(begin), np.int64)
                yield _segment_rows(zero.astype(np.uint64), zero.astype(np.uint64), zero, keys.take(pa.array(d[rest[begin]])), lo[rest[begin]], hi[rest[end]], np.ones(len(begin), bool))

    return run


def _segment_rows(h, s, n, key, lo, hi, covered) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(n.astype(np.int64)), key, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(covered)], [f.split()[0] for f in SEGMENTS.split(", ")])


def shard_starts(pieces: list[bytes], singles: np.ndarray, length: int = LENGTH, step: int = 1) -> list[np.ndarray]:
    """For each piece that is single, the starts whose string of ``length`` bytes begins elsewhere in the shard as well; with ``step`` all counts are of letters of so many bytes."""
    size = np.array([len(p) for p in pieces], np.int64) // step
    length //= step
    # 0xFF is no byte of UTF-8, so no string reaches over the end of its piece
    end = b"\xff" * step
    text = _letters(np.frombuffer(end.join(pieces) + end, np.uint8), step)
    sigma = 256
    if step > 1:
        names, text = np.unique(text, return_inverse=True)
        text, sigma = text.astype(np.int32), len(names)
    shared = longest_shared(text, suffix_array(text, sigma))
    first = np.cumsum(size + 1) - size - 1
    return [np.flatnonzero(shared[first[k] : first[k] + size[k] - length + 1] >= length) if singles[k] else np.zeros(0, np.int64) for k in range(len(pieces))]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    head = np.flatnonzero(np.append(True, np.diff(starts) != 1)) if len(starts) else np.zeros(0, np.int64)
    return starts[head], starts[np.append(head[1:], len(starts)) - 1] if len(starts) else starts


SPANS = "key binary, lo int, hi int"


def _span_rows(key: list, lo: list, hi: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["key", "lo", "hi"])


def _sort_shards(length: int, step: int):
    """Rows (h, key, lo, single, piece) in order of h to spans of repeated starts; anchors stay whole, slabs hold many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            out: tuple[list, list, list] = ([], [], [])
            for (_, key, lo, _, _), starts in zip(held, shard_starts([r[4] for r in held], np.array([r[3] for r in held]), length, step), strict=True):
                for a, b in zip(*_runs(starts), strict=True):
                    out[0].append(key)
                    out[1].append(lo + step * int(a))
                    out[2].append(lo + step * int(b))
            return _span_rows(*out)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SLAB and row[0] != last:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield done()

    return run


def _split_blocks(length: int, block: int):
    """Rows (h, key, base, lo, hi, anchor, piece) to (core, full, h, key, base, lo, hi): blocks of starts with hashes of what all their strings share and of the whole block.

    Starts are counted from the piece's begin; blocks are laid by the distance to the
    anchor, which equal strings have in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a chunk has at most a block for each of its bytes
            for begin, end, data, offsets in chunks(batch.column(6), min(textkit.CHUNK_BYTES, CUT_BYTES * block)):
                h, base, lo, hi, anchor = (batch.column(k).slice(begin, end - begin).to_numpy() for k in (0, 2, 3, 4, 5))
                first = (anchor - hi) // block
                many = (anchor - lo) // block - first + 1
                row = np.repeat(np.arange(end - begin), many)
                nth = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                # distance to the anchor in [nth * block, (nth + 1) * block)
                to = anchor[row] - nth * block
                a, b = np.maximum(lo[row], to - block + 1), np.minimum(hi[row], to)
                prefix = prefix_hash(data)
                shift = offsets[row]
                # a piece may not hold a whole core at its ends: then the part that it holds, of a length that says so
                size = offsets[row + 1] - shift
                x, y = np.clip(to, 0, size), np.clip(to - block + 1 + length, 0, size)
                core = mix(span_hash(prefix, shift + x, shift + y) ^ h[row].view(np.uint64)) + nth.astype(np.uint64)
                full = mix(span_hash(prefix, shift + a, shift + b + length)) + (anchor[row] - a).astype(np.uint64)
                key = batch.column(1).slice(begin, end - begin).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), pa.array(h[row]), key, pa.array(base[row]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["core", "full", "h", "key", "base", "lo", "hi"])

    return run


View = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, step: int = 1, view: View | None = None) -> DataFrame:
    """(key, lo, hi): runs of starts whose strings repeat.

    ``docs`` has key and text; rows with equal keys hold equal rows, each its own document.
    ``view`` turns batches of ``docs`` to (key, text) with the texts that are compared, in the
    worker that reads them: runs are then of its texts. With ``step`` their letters have so
    many bytes each, and only strings of whole letters are sure to be found.
    """
    spark = docs.sparkSession
    docs = docs.select("key", "text", *([] if view is None else [c for c in docs.columns if c not in ("key", "text")]))
    width = shuffle_width(spark)
    cuts = _cut(length, gram, step)
    cut = stored(docs.mapInArrow(lean(cuts if view is None else lambda batches: cuts(view(batches))), SEGMENTS), "segments")
    real = cut.where("n > 0")
    kinds = stored(real.groupBy("h", "seg").agg(F.sum("n").alias("c"), F.min(F.struct("key", "lo", "hi")).alias("at")), "kinds")
    anchors = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.sum((F.col("c") == 1).cast("long")).alias("singles"))
    open_ = kinds.join(anchors.where("kinds > 1 AND singles > 0"), "h").select("h", "at.key", "at.lo", "at.hi", (F.col("c") == 1).alias("single"), "kinds")
    whole = real.where("NOT covered").join(kinds.where("c > 1").select("h", "seg"), ["h", "seg"]).select("key", "lo", "hi").union(cut.where("covered").select("key", "lo", "hi"))
    open_, whole = stored(open_, "open"), stored(whole, "whole")
    # the texts that matter further on: those with an open or a repeated segment
    wanted = open_.select("key").union(whole.select("key")).distinct()
    wanted = stored(wanted, "wanted")
    texts = likely_in(docs, "key", wanted).join(wanted, "key").dropDuplicates(["key"])
    texts = stored(texts if view is None else texts.mapInArrow(lean(view), "key binary, text string"), "texts")
    piece = F.substring(F.col("text").cast("binary"), F.col("lo") + 1, F.col("hi") - F.col("lo") + length)
    pieces = open_.join(texts, "key").select("h", "key", "lo", "hi", "single", "kinds", piece.alias("piece"))
    pieces = stored(pieces, "pieces")
    cool = pieces.where(F.col("kinds") <= HOT).select("h", "key", "lo", "single", "piece")
    found = cool.repartition(width, "h").sortWithinPartitions("h").mapInArrow(lean(_sort_shards(length, step)), SPANS)
    hot = pieces.where(F.col("kinds") > HOT)
    found = stored(found, "found")
    if hot.limit(1).count():
        found = found.union(_hot(hot, length, gram, step))
    runs = stored(whole.union(found), "spans")
    for done in (cut, kinds, open_, whole, wanted, texts, pieces):
        drop_stored(done)
    return runs


def _hot(hot: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """Repeated starts of segments whose anchor has too many kinds for one shard, by blocks of falling size."""
    # the anchor's place is the same in equal strings: any fixed point of the segment that depends on its strings alone
    hot = stored(hot.select("h", "key", F.col("lo").alias("base"), "hi", "piece").mapInArrow(lean(_find_anchor(length, gram, step)), "h long, key binary, base int, last int, anchor int, piece binary"), "hot")
    rows = hot.select("h", "key", "base", F.lit(0).alias("lo"), F.col("last").alias("hi"))
    found = []
    # a block's strings must share a core
    for block in [b for b in BLOCKS if b == 1 or 2 * b <= length]:
        cut = rows.join(hot, ["h", "key", "base"]).select("h", "key", "base", "lo", "hi", "anchor", "piece").mapInArrow(lean(_split_blocks(length, block)), "core long, full long, h long, key binary, base int, lo int, hi int")
        cut = stored(cut, "blocks")
        whole = stored(cut.groupBy("core", "full").agg(F.count("*").alias("n"), F.min(F.struct("h", "key", "base", "lo", "hi")).alias("one")), "judged")
        found.append(cut.join(whole.where("n > 1").select("core", "full"), ["core", "full"]).select("key", "base", "lo", "hi"))
        # one of each kind goes on where some kind was found once: the others are there to be found again
        cores = whole.groupBy("core").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("singles")).where("kinds > 1 AND singles > 0")
        rows = join_sizes(whole, stored(cores, "cores"), "core", "kinds", whole.count()).select("one.*")
    return reduce(DataFrame.union, found).select("key", (F.col("base") + F.col("lo")).cast("int").alias("lo"), (F.col("base") + F.col("hi")).cast("int").alias("hi"))


def _find_anchor(length: int, gram: int, step: int):
    length, gram = length // step, gram // step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = []
            for p in batch.column(4).to_pylist():
                data = _letters(np.frombuffer(p, np.uint8), step)
                _, grams = _grams(data, gram)
                # the anchor is in all strings of the segment: the least of the grams that they share
                a, b = len(data) - length, length - gram
                high = grams[a : b + 1] >> np.uint64(_PLACE)
                anchors.append(step * (a + int(np.argmin(high))))
            last = batch.column(3).to_numpy() - batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(last.astype(np.int32)), pa.array(anchors, pa.int32()), batch.column(4)], ["h", "key", "base", "last", "anchor", "piece"])

    return run


def keyed(docs: DataFrame, name: str = "key") -> DataFrame:
    """The rows with a key of their contents, two hashes of 64 bits; rows with one key are equal in id and text."""
    half = lambda *of: F.lpad(F.hex(F.xxhash64(*of)), 16, "0")
    return docs.withColumn(name, F.unhex(F.concat(half("doc_id", "text"), half(F.lit(1), "doc_id", "text"))))


def merged(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the spans that runs of starts cover, joined where they touch."""
    order = np.argsort(lo, kind="stable")
    lo, end = np.asarray(lo, np.int64)[order], np.maximum.accumulate(np.asarray(hi, np.int64)[order] + length)
    head = np.ones(len(lo), bool)
    head[1:] = lo[1:] > end[:-1]
    return lo[head], end[np.append(head[1:], True)] if len(lo) else end


def _runs_of(column: pa.ListArray) -> Iterator[dict[str, np.ndarray]]:
    """The fields of each row's runs as arrays, a row at a time; a null list has none."""
    flat = column.flatten()
    fields = {f.name: x.to_numpy(zero_copy_only=False) for f, x in zip(flat.type, flat.flatten(), strict=True)}
    end = np.cumsum(column.value_lengths().fill_null(0).to_numpy())
    for a, b in zip(np.append(0, end[:-1]), end, strict=True):
        yield {name: x[a:b] for name, x in fields.items()}


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PASSAGES = ", n_passages long, passage_bytes long"


def _kept(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
    """What the spans leave of the bytes, in order."""
    view, at = memoryview(raw), 0
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        yield view[at:a]
        at = b
    yield view[at:]


def _to_characters(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans shrunk to whole characters of UTF-8; those that hold none are gone."""
    inner = np.append((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80, False)
    begins, ends = begins.copy(), ends.copy()
    # a character has at most three bytes after its first
    for _ in range(3):
        begins += inner[begins]
        ends -= inner[ends]
    some = begins < ends
    return begins[some], ends[some]


def _digest(length: int, words: int | None):
    """Rows (doc_id, text, runs) to the columns of REPORT, and of PASSAGES where ``words`` is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, count, sha, many, size = [], [], [], [], [], []
            for text, runs in zip(batch.column(1), _runs_of(batch.column(2)), strict=True):
                raw = text.as_buffer() or b""
                coded = runs["coded"].astype(bool)
                begins, ends = passages(raw, {c: x[coded] for c, x in runs.items()}, words or 0, length)
                many.append(len(begins))
                size.append(int((ends - begins).sum()))
                begins, ends = merged(runs["lo"][~coded], runs["hi"][~coded], length)
                digest = hashlib.sha256()
                for part in _kept(raw, begins, ends):
                    digest.update(part)
                n.append(len(raw))
                removed.append(int((ends - begins).sum()))
                count.append(len(begins))
                sha.append(digest.hexdigest())
            columns = [ids_of(batch), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(sha, pa.string()), *(pa.array(x, pa.int64()) for x in (many, size))]
            names = [f.split()[0] for f in (REPORT + PASSAGES).split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names) if words else pa.RecordBatch.from_arrays(columns[:5], names[:5])

    return run


def _without(names: list[str], spans_of: Callable[[bytes, dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]):
    """Rows with the columns ``names`` and last their runs, to rows whose text is without the spans that ``spans_of`` makes of a text and its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text, runs in zip(batch.column(at), _runs_of(batch.column(batch.num_columns - 1)), strict=True):
                if len(runs["lo"]):
                    raw = text.as_buffer().to_pybytes()
                    out.append(b"".join(_kept(raw, *_to_characters(raw, *spans_of(raw, runs)))).decode())
                else:
                    out.append(text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(len(names))], schema=pa.schema([batch.schema.field(k) for k in range(len(names))]))

    return run


def repeat_report(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """The digest that query op8 returns: one row per row of ``docs`` (doc_id, text).

    A null text is empty. Texts under ``length`` bytes lose nothing. Equal rows are
    documents of their own, so all of their strings repeat.

    With ``words`` two columns follow: the runs of so many words that stand anywhere else as
    well, joined where they touch, and their bytes. They are told only, however short, and
    count for nothing in the columns before. Then strings of bytes are looked for in fewer
    texts: one that holds ``words`` whole words makes such a run in every text that it is in,
    and the others are in texts that are not ``wordy``.
    """
    rows = keyed(docs.select("doc_id", "text"))
    texts = rows.select("key", "text")
    if words:
        coded = spans(texts, length=CODE * words, gram=CODE * max(1, words // 4), step=CODE, view=_as_codes)
        runs = spans(marked_in(texts, "key", coded.select("key"), "likely"), length=length, gram=gram, view=_may_repeat(words, length)).withColumn("coded", F.lit(False)).union(coded.withColumn("coded", F.lit(True)))
    else:
        runs = spans(texts, length=length, gram=gram).withColumn("coded", F.lit(False))
    per = runs.groupBy("key").agg(F.collect_list(F.struct("coded", "lo", "hi")).alias("runs"))
    per = stored(per, "runs")
    return left_by_key(rows, "key", per.withColumnRenamed("key", "_k"), "_k").select("doc_id", "text", "runs").mapInArrow(lean(_digest(length, words)), REPORT + (PASSAGES if words else ""))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated passages taken out of text, all columns; n_chars, where there is one, follows the text.

    Spans shrink to whole characters, so texts stay valid. Rows stay even if nothing is left.
    """
    names = docs.columns
    rows = keyed(docs, "_key")
    runs = spans(rows.select(F.col("_key").alias("key"), "text"), length=length, gram=gram)
    per = runs.groupBy(F.col("key").alias("_key2")).agg(F.collect_list(F.struct("lo", "hi")).alias("_runs"))
    joined = left_by_key(rows, "_key", stored(per, "runs"), "_key2").select(*names, "_runs")
    out = joined.mapInArrow(lean(_without(names, lambda raw, found: merged(found["lo"], found["hi"], length))), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CODE characters of ASCII for each word, from its hash; only the first has bit 6, so equal strings of codes stand at whole words."""
    codes = (word_hashes(data, starts, ends)[:, None] >> np.arange(0, 6 * CODE, 6, dtype=np.uint64)).astype(np.uint8) & 63
    codes[:, 0] |= 64
    return codes


def _as_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) with each text as the codes of its words."""
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column(1), CUT_BYTES):
            starts, ends, per_doc = word_bounds(data, offsets)
            where = np.concatenate([[0], np.cumsum(CODE * per_doc)]).astype(np.int32)
            text = pa.Array.from_buffers(pa.string(), end - first, [None, pa.py_buffer(where), pa.py_buffer(word_codes(data, starts, ends).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), text], ["key", "text"])


def wordy(data: np.ndarray, offsets: np.ndarray, words: int, length: int) -> np.ndarray:
    """For each text whether all of its strings of ``length`` bytes hold ``words`` words, with what bounds these on both sides.

    The fewest words are in strings that begin with a word, which is then not bounded, or with the text.
    """
    starts, ends, per_doc = word_bounds(data, offsets)
    after = np.cumsum(per_doc)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    # (text, begin, first bounded word) of these strings
    text = np.concatenate([doc, np.arange(len(per_doc))])
    begin = np.concatenate([starts, offsets[:-1]])
    last = np.concatenate([np.arange(len(starts)) + 1, np.searchsorted(starts, offsets[:-1], side="right")]) + words - 1
    few = last >= after[text]
    few[~few] = ends[last[~few]] >= begin[~few] + length
    few &= begin + length <= offsets[text + 1]
    out = np.ones(len(per_doc), bool)
    out[text[few]] = False
    return out


def _may_repeat(words: int, length: int):
    """The rows (key, text, likely) that are likely or whose texts are not ``wordy``, as (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            rest = batch.filter(pa.array(~likely)).column(1)
            parts = [wordy(data, offsets, words, length) for _, _, data, offsets in chunks(rest, CUT_BYTES)]
            likely[~likely] = ~np.concatenate(parts) if parts else np.zeros(0, bool)
            yield batch.select(["key", "text"]).filter(pa.array(likely))

    return run


def _not_wordy(words: int, length: int):
    """The rows (key, text) whose texts are not ``wordy``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [wordy(data, offsets, words, length) for _, _, data, offsets in chunks(batch.column(1), CUT_BYTES)]
            yield batch.filter(pa.array(~np.concatenate(parts) if parts else np.zeros(0, bool)))

    return run


def passages(raw: bytes, runs: dict[str, np.ndarray], words: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the byte spans that the runs of a text cover; runs are of starts in bytes, or where ``coded`` in the codes of words."""
    coded = runs["coded"].astype(bool)
    begins, ends = merged(runs["lo"][~coded], runs["hi"][~coded], length)
    # starts of whole words: the first at or after lo, the last at or before hi
    first, last = -(-runs["lo"][coded].astype(np.int64) // CODE), runs["hi"][coded].astype(np.int64) // CODE
    whole = first <= last
    if whole.any():
        begin, end, _ = word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        a, b = merged(first[whole], last[whole], words)
        begins, ends = merged(np.append(begins, begin[a]), np.append(ends, end[b - 1]), 0)
    return begins, ends


def remove_passages(docs: DataFrame, *, words: int = WORDS, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` without runs of ``words`` words, or of ``length`` bytes, that stand anywhere else as well; all columns, and n_chars follows the text.

    Words are compared by hash, whatever white space is between them. Where ``length`` bytes
    always hold ``words`` words the words alone decide; texts with longer ones are compared
    by bytes too, so nothing that ``remove_repeats`` finds stays but parts of words.
    """
    names = docs.columns
    rows = keyed(docs, "_key")
    keyed_rows = rows.select(F.col("_key").alias("key"), "text")
    coded = spans(keyed_rows, length=CODE * words, gram=CODE * max(1, words // 4), step=CODE, view=_as_codes)
    plain = spans(keyed_rows, length=length, gram=gram, view=_not_wordy(words, length))
    runs = coded.withColumn("coded", F.lit(True)).union(plain.withColumn("coded", F.lit(False)))
    per = runs.groupBy(F.col("key").alias("_key2")).agg(F.collect_list(F.struct("coded", "lo", "hi")).alias("_runs"))
    joined = left_by_key(rows, "_key", stored(per, "runs"), "_key2").select(*names, "_runs")
    out = joined.mapInArrow(lean(_without(names, lambda raw, found: passages(raw, found, words, length))), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
