"""Language-model scoring with a hidden Markov model over words.

The model's alphabet is bounded: the KEPT most frequent training words, one class for
each of CLASSES endings that holds all other words, and the end of the text. Baum-Welch
runs over all training texts: every task adds up its expected counts, one shuffle sums
them per symbol, and the driver gets one row per symbol. A word inside a class has the
smoothed share of its count, from exact counts of all words in the corpus, so the score
is the log10 probability of the text itself; the scaled forward recursion sums over all
state paths. Counts of rare words reach their texts by a join on the word's 64-bit hash;
only words among the LOCAL most frequent (a fixed number) are looked up in a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelore.llm.textkit import LOWER, chunks, fold, ids_of, lean, stored, word_bounds, word_hashes

#: Latent states; most rounds of Baum-Welch over all training texts, and the gain in log10 a token at which they end.
STATES, ROUNDS, SETTLED = 8, 6, 0.002
#: Passes over all training texts that make the first guess of the states: how sharply each tells the states apart.
HEATS = (0.1, 0.3, 1.0, 1.0, 1.0)
#: Words with an emission of their own; classes of the others; words whose counts are broadcast (16 bytes each).
KEPT, CLASSES, LOCAL = 16_384, 256, 262_144
#: Bands of counts to each doubling, by which the most frequent words are told.
BANDS = 16
#: Words that a worker runs the recursion over at once, unless one text has more.
GROUP = 700_000
#: The hash that stands for the end of a text.
END = 0x5EED_0F_7E57
_SMOOTH = 0.5


@dataclass
class Lookup:
    """The LOCAL most frequent words, by hash, and the totals of the corpus."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray
    end_count: int

    @property
    def size(self) -> int:
        return KEPT + CLASSES + 1

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + _SMOOTH) / (self.total + _SMOOTH * (self.distinct + 1)))

    def inside(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class."""
        return np.log10((c + _SMOOTH) / (self.class_total[k] + _SMOOTH * (self.class_distinct[k] + 1)))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, words per text) of the lower-cased words of a chunk. The class comes from the last two bytes."""
    data = LOWER[data]
    starts, ends, per_doc = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), per_doc
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return word_hashes(data, starts, ends), (last * 31 + before * 7) % CLASSES, per_doc


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, k, c): hash, class and count of every word of the texts, summed within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [words_of(data, offsets)[:2] for _, _, data, offsets in chunks(batch.column(0))]
            if not parts:
                continue
            h, k = (np.concatenate(x) for x in zip(*parts, strict=True))
            h, at, c = np.unique(h, return_index=True, return_counts=True)
            h, k, c = np.append(h, np.uint64(END)), np.append(k[at], -1), np.append(c, len(batch))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(c.astype(np.int64))], ["h", "k", "c"])

    return docs.select("text").mapInArrow(lean(run), "h long, k int, c long").groupBy("h").agg(F.max("k").alias("k"), F.sum("c").alias("c"))


def lookup_of(counts: DataFrame) -> Lookup:
    """What tasks need of the counts; the driver gets LOCAL rows at most, CLASSES sums and a count for each band.

    The words of the highest bands go out that have LOCAL words at most together.
    """
    band = F.floor(F.log2("c") * BANDS).cast("int")
    words = counts.where(F.col("k") >= 0)
    room, least = LOCAL, None
    for r in sorted(words.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            break
        least = r["band"]
    top = words.where(band >= F.lit(least)).toArrow().sort_by([("c", "descending"), ("h", "ascending")])
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy().astype(np.int64)
    symbol = np.where(np.arange(len(h)) < KEPT, np.arange(len(h)), KEPT + top["k"].to_numpy().astype(np.int64))
    sums = {r["k"]: (r["c"], r["n"]) for r in counts.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    total, distinct = sum(x[0] for x in sums.values()), sum(x[1] for x in sums.values())
    end = sums.get(-1, (0, 0))[0]
    class_total = np.array([sums.get(k, (0, 0))[0] for k in range(CLASSES)], np.int64)
    class_distinct = np.array([sums.get(k, (0, 0))[1] for k in range(CLASSES)], np.int64)
    own = top["k"].to_numpy()[:KEPT]
    class_total -= np.bincount(own, c[:KEPT], CLASSES).astype(np.int64)
    class_distinct -= np.bincount(own, minlength=CLASSES)
    order = np.argsort(h)
    return Lookup(h[order], c[order], symbol[order].astype(np.int64), total, distinct, class_total, class_distinct, end)


ENCODED = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, symbols binary, miss_h array<long>, miss_k array<smallint>"


def encode(docs: DataFrame, lookup: Lookup) -> DataFrame:
    """Each text as symbols, with the sums over words that the broadcast knows, and the rare words that need the join."""
    shared = docs.sparkSession.sparkContext.broadcast(lookup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, held, texts = ids_of(batch), batch.column(1), batch.column(2)
            for first, end, data, offsets in chunks(texts):
                h, k, per_doc = words_of(data, offsets)
                n = len(per_doc)
                at = np.minimum(np.searchsorted(known.hashes, h), max(len(known.hashes) - 1, 0))
                hit = known.hashes[at] == h if len(known.hashes) else np.zeros(len(h), bool)
                symbol = KEPT + k
                if hit.any():
                    symbol[hit] = known.symbols[at[hit]]
                doc = np.repeat(np.arange(n), per_doc)
                c = known.counts[at[hit]] if hit.any() else np.zeros(0, np.int64)
                base = np.bincount(doc[hit], known.base(c), minlength=n).astype(np.float64) + known.base(np.array([known.end_count]))[0]
                rare = symbol[hit] >= KEPT
                inside = np.bincount(doc[hit][rare], known.inside(c[rare], k[hit][rare]), minlength=n).astype(np.float64)
                n_known = np.bincount(doc[hit], minlength=n) + (known.end_count > 0)
                ends = np.cumsum(per_doc)
                full = np.insert(symbol, ends, KEPT + CLASSES).astype("<u2")
                binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(2 * (per_doc + 1))]).astype(np.int32)), pa.py_buffer(full)])
                missed = np.bincount(doc[~hit], minlength=n)
                where = pa.array(np.concatenate([[0], np.cumsum(missed)]).astype(np.int32))
                miss_h = pa.ListArray.from_arrays(where, pa.array(h[~hit].view(np.int64)))
                miss_k = pa.ListArray.from_arrays(where, pa.array(k[~hit].astype(np.int16)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + n)), ids.slice(first, n), held.slice(first, n), pa.array(per_doc + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(inside), binary, miss_h, miss_k],
                    [f.split()[0] for f in ENCODED.split(", ")],
                )
                key += n

    return docs.select("doc_id", "held_out", "text").mapInArrow(lean(run), ENCODED)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # [symbol, state]


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of a binary column and the number in each row."""
    n = len(column)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if n and data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(flat.tobytes(), "<u2").astype(np.int64), np.diff(offsets) // 2


def groups(lengths: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Rows by falling length, in groups of at most ``limit`` symbols or one row."""
    order = np.argsort(-lengths, kind="stable")
    total = np.cumsum(lengths[order])
    first = 0
    while first < len(order):
        base = total[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield order[first:end]
        first = end


def time_major(symbols: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by position, rows of falling length within; and the number of rows that reach each position."""
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    row = np.arange(alive.sum()) - np.repeat(np.cumsum(alive) - alive, alive)
    return symbols[first[row] + np.repeat(np.arange(len(alive)), alive)], alive


def forward(model: Model, symbols: np.ndarray, lengths: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """log10 probability of each sequence of symbols, over all state paths."""
    out = np.zeros(len(lengths))
    first = np.cumsum(lengths) - lengths
    move, start, table = model.move.astype(kind), model.start.astype(kind), model.emit.astype(kind)
    for rows in groups(lengths, GROUP):
        s, alive = time_major(symbols, first[rows], lengths[rows])
        a, total, at = None, np.zeros(len(rows)), 0
        for k in alive.tolist():
            e = table[s[at : at + k]]
            a = start * e if a is None else (a[:k] @ move) * e
            scale = a.sum(1)
            a /= scale[:, None]
            total[:k] += np.log10(scale)
            at += k
        out[rows] = total
    return out


def expected_counts(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of (symbol, state), (state, state) and first states over the sequences, and their log10 probability."""
    size, states = model.emit.shape
    emit_n, move_n, start_n, likely = np.zeros((size, states)), np.zeros((states, states)), np.zeros(states), 0.0
    first = np.cumsum(lengths) - lengths
    move, start, table = (x.astype(np.float32) for x in (model.move, model.start, model.emit))
    back_move = np.ascontiguousarray(move.T)
    for rows in groups(lengths, GROUP):
        s, alive = time_major(symbols, first[rows], lengths[rows])
        local = table[s]
        alpha, inverse = np.empty_like(local), np.empty(len(s), np.float32)
        at, before = 0, 0
        for t, k in enumerate(alive.tolist()):
            a = start * local[:k] if not t else (alpha[before : before + k] @ move) * local[at : at + k]
            inverse[at : at + k] = r = 1 / a.sum(1)
            np.multiply(a, r[:, None], out=alpha[at : at + k])
            before, at = at, at + k
        likely -= float(np.log10(inverse, dtype=np.float64).sum())
        local *= inverse[:, None]
        beta = np.ones((len(rows), states), np.float32)
        at = len(s)
        for t in range(len(alive) - 1, 0, -1):
            k, at = int(alive[t]), at - int(alive[t])
            ahead = local[at : at + k] * beta[:k]
            alpha[at : at + k] *= beta[:k]
            before = at - int(alive[t - 1])
            move_n += alpha[before : before + k].T @ ahead
            beta[:k] = ahead @ back_move
        alpha[: len(rows)] *= beta
        start_n += alpha[: len(rows)].sum(0)
        for state in range(states):
            emit_n[:, state] += np.bincount(s, alpha[:, state], size)
    return emit_n, move_n * model.move, start_n, likely


def estimate(emit_n: np.ndarray, move_n: np.ndarray, start_n: np.ndarray, prior: np.ndarray) -> Model:
    """Probabilities from counts; ``prior`` (over symbols) smooths each state's emissions, so none is 0."""
    emit = emit_n + 50.0 * prior[:, None]
    return Model((start_n + 1) / (start_n + 1).sum(), (move_n + 1) / (move_n + 1).sum(1, keepdims=True), emit / emit.sum(0))


def mixture_counts(emit: np.ndarray, share: np.ndarray, heat: float, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (symbol, state) and of texts per state, each text in a mixture of states by its words whatever their order."""
    emit_n, share_n = np.zeros(emit.shape), np.zeros(len(share))
    first = np.cumsum(lengths) - lengths
    table = np.log(emit).astype(np.float32)
    for rows in groups(lengths, GROUP):
        size = lengths[rows]
        s = symbols[np.repeat(first[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        p = heat * np.add.reduceat(table[s], np.cumsum(size) - size, axis=0).astype(np.float64) + np.log(share)
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        share_n += p.sum(0)
        for state in range(len(share)):
            emit_n[:, state] += np.bincount(s, np.repeat(p[:, state], size), len(emit))
    return emit_n, share_n


def _added_up(texts: DataFrame, rows: int, counts: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all texts of tables (rows, STATES) that ``counts`` makes of symbols and lengths; the driver gets one table."""
    names = [f"s{k}" for k in range(STATES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((rows, STATES))
        for batch in batches:
            s, lengths = sequences(batch.column(0))
            if len(lengths):
                table += counts(s, lengths)
        some = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(table[some, k]) for k in range(STATES))], ["row", *names])

    got = texts.select("symbols").mapInArrow(lean(run), "row int, " + ", ".join(f"{x} double" for x in names)).groupBy("row").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    table = np.zeros((rows, STATES))
    if got.num_rows:
        table[got["row"].to_numpy()] = np.column_stack([got[x].to_numpy() for x in names])
    return table


def first_guess(texts: DataFrame, prior: np.ndarray, seed: int = 7) -> Model:
    """States from a mixture of unigrams, fitted in passes over all training texts from a random start."""
    spark, size = texts.sparkSession, len(prior)
    emit = prior[:, None] * np.random.default_rng(seed).uniform(0.5, 1.5, (size, STATES))
    emit, share = emit / emit.sum(0), np.full(STATES, 1 / STATES)
    for heat in HEATS:
        shared = spark.sparkContext.broadcast((emit, share))
        table = _added_up(texts, size + 1, lambda s, n, shared=shared, heat=heat: np.vstack(mixture_counts(*shared.value, heat, s, n)))
        shared.unpersist()
        emit = table[:size] + 50.0 * prior[:, None]
        emit, share = emit / emit.sum(0), (table[size] + 1) / (table[size] + 1).sum()
    move = np.full((STATES, STATES), 0.1 / max(STATES - 1, 1))
    np.fill_diagonal(move, 0.9)
    return Model(share, move, emit)


def train(encoded: DataFrame, lookup: Lookup, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training texts of an encoded table, until a round gains less than SETTLED a token."""
    texts = encoded.where(~F.col("held_out"))
    mass = np.zeros(lookup.size)
    mass[lookup.symbols[lookup.symbols < KEPT]] = lookup.counts[lookup.symbols < KEPT]
    mass[KEPT : KEPT + CLASSES], mass[-1] = lookup.class_total, lookup.end_count
    prior = (mass + _SMOOTH) / (mass + _SMOOTH).sum()
    model, size, before = first_guess(texts, prior), lookup.size, -np.inf
    for _ in range(rounds):
        shared = encoded.sparkSession.sparkContext.broadcast(model)

        def counts(s: np.ndarray, lengths: np.ndarray, shared=shared) -> np.ndarray:
            emit_n, move_n, start_n, likely = expected_counts(shared.value, s, lengths)
            return np.vstack([emit_n, move_n, start_n, np.full(STATES, likely)])

        table = _added_up(texts, size + STATES + 2, counts)
        shared.unpersist()
        model = estimate(table[:size], table[size : size + STATES], table[size + STATES], prior)
        likely = table[-1, 0] / max(lookup.total, 1)
        if likely - before < SETTLED:
            break
        before = likely
    return model


def lm_report(docs: DataFrame) -> DataFrame:
    """The digest that query op7 returns: one row per row of ``docs`` (doc_id, text).

    A null text is empty: its one token is the end. With no training text at all every
    count is 0 and all probability is that of unseen words.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "text")
    counts = stored(word_counts(rows.where(~F.col("held_out"))), "hmm-counts")
    lookup = lookup_of(counts)
    encoded = stored(encode(rows, lookup), "hmm-texts")
    model = train(encoded, lookup)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(forward(shared.value, *sequences(batch.column(batch.num_columns - 1))))], [*batch.schema.names[:-1], "path"])

    plain = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double"
    scored = encoded.select(*[x.split()[0] for x in plain.split(", ")], "symbols").mapInArrow(lean(run), plain + ", path double")
    rare = encoded.select("key", F.explode(F.arrays_zip("miss_h", "miss_k")).alias("m")).select("key", F.col("m.miss_h").alias("h"), F.col("m.miss_k").alias("k"))
    sums = spark.createDataFrame([(k, float(t + _SMOOTH * (d + 1))) for k, (t, d) in enumerate(zip(lookup.class_total.tolist(), lookup.class_distinct.tolist(), strict=True))], "k int, class_mass double")
    c = F.coalesce(F.col("c"), F.lit(0)) + _SMOOTH
    rare = rare.join(counts.select("h", "c"), "h", "left").join(F.broadcast(sums), "k")
    rare = rare.groupBy("key").agg(F.sum(F.log10(c / (lookup.total + _SMOOTH * (lookup.distinct + 1)))).alias("rare_base"), F.sum(F.log10(c / F.col("class_mass"))).alias("rare_inside"), F.count("c").alias("rare_known"))
    out = scored.join(rare, "key", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(lookup.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"), (F.col("path") + F.col("inside") + F.coalesce("rare_inside", zero)).alias("score"),
    )
