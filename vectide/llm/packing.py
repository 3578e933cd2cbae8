"""Best-fit packing of documents into training sequences by length patterns fitted with non-negative least squares."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.bpe_transducer import Tokenizer, load_spec
from vectide.llm.common import materialize, small_batches, text_slices

SALTS = 256


def pieces(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the tokens of every whole text and a final `end_id`, cut only
    where longer than `max_len`: full pieces of `max_len`, the first piece takes what is left over.

    Null texts count as empty and give one piece that holds `end_id`. Repeated rows and null ids give their own pieces.
    """
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(tokenizer_path))

    def run(batches):
        tokenizer = Tokenizer(spec.value)
        for part in text_slices(batches, 1 << 20):
            ids, bounds = tokenizer.ids(part.column("text"))
            bounds = np.asarray(bounds, np.int64)
            rows = len(bounds) - 1
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            bounds = bounds + np.arange(rows + 1)
            size = np.diff(bounds)
            n = -(-size // max_len)
            row = np.repeat(np.arange(rows), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = size - (n - 1) * max_len
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * max_len)
            length = np.where(piece == 0, first[row], max_len)
            begin = bounds[row] + start
            crc = [zlib.crc32(ids[b : b + k].data) for b, k in zip(begin.tolist(), length.tolist())]
            columns = [part.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def length_patterns(counts: np.ndarray, thirds: int = 4) -> np.ndarray:
    """Patterns of at most three lengths that fill a sequence exactly, as rows padded with 0.

    All pairs, and for each length up to `thirds` triples spread evenly over the possible second lengths; only
    lengths that occur. The number depends on the sequence length alone.
    """
    top = len(counts) - 1
    found = {(top, 0, 0)} if counts[top] else set()
    for a in np.flatnonzero(counts).tolist():
        if top - a > 0 and counts[top - a]:
            found.add((max(a, top - a), min(a, top - a), 0))
        second = [b for b in range(1, (top - a) // 2 + 1) if counts[b] and counts[top - a - b]]
        for b in second[:: max(1, len(second) // thirds)][:thirds]:
            found.add(tuple(sorted((a, b, top - a - b), reverse=True)))
    return np.array(sorted(found, reverse=True), np.int64).reshape(-1, 3)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares: repeat counts x >= 0 whose pattern lengths come nearest to the histogram.

    Coordinate descent: each pattern in turn takes its exact minimiser given all others. Every pattern touches at most
    three lengths, so a sweep is linear in the patterns.
    """
    x = np.zeros(len(patterns))
    left = counts.astype(float).tolist()
    columns = []
    for p in patterns.tolist():
        uses: dict[int, int] = defaultdict(int)
        for v in p:
            if v:
                uses[v] += 1
        columns.append((list(uses.items()), float(sum(m * m for m in uses.values()))))
    for _ in range(sweeps):
        moved = 0.0
        for k, (uses, norm) in enumerate(columns):
            step = max(sum(m * left[v] for v, m in uses) / norm, -x[k])
            if step:
                x[k] += step
                moved = max(moved, abs(step))
                for v, m in uses:
                    left[v] -= m * step
        if moved < 0.25:
            break
    return x


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal lengths move together, so the work follows the number of lengths."""
    top = len(counts) - 1
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by free space
    for v in range(top, 0, -1):
        n = int(counts[v])
        while n:
            space = next((s for s in range(v, top) if bins.get(s)), None)
            if space is None:
                per = min(top // v, n)
                whole = n // per
                bins[top - v * per][(v,) * per] = bins[top - v * per].get((v,) * per, 0) + whole
                n -= whole * per
                continue
            held, have = next(iter(bins[space].items()))
            per = min(space // v, n)
            take = min(have, n // per)
            if take == have:
                del bins[space][held]
            else:
                bins[space][held] = have - take
            key = held + (v,) * per
            bins[space - v * per][key] = bins[space - v * per].get(key, 0) + take
            n -= take * per
    return [(held, n) for by_space in bins.values() for held, n in by_space.items()]


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that place every entry of the histogram (index: length) exactly once.

    Fit the patterns, round (down or to the nearest), take what the histogram still holds, pack the rest best-fit;
    of the few combinations of pattern set and rounding the one with the fewest sequences is kept.
    """
    best: list[tuple[tuple[int, ...], int]] | None = None
    for thirds in (1, 4):
        patterns = length_patterns(counts, thirds)
        fitted = fit_repeats(patterns, counts)
        for up in (0.0, 0.5):
            left = counts.astype(np.int64).copy()
            chosen = []
            repeats = np.floor(fitted + up).astype(np.int64).tolist()
            for p, r in sorted(zip(patterns.tolist(), repeats), key=lambda pr: (-pr[0][0], -pr[1])):
                lengths = tuple(v for v in p if v)
                for v in set(lengths):
                    r = min(r, int(left[v]) // lengths.count(v))
                if r > 0:
                    chosen.append((lengths, r))
                    for v in lengths:
                        left[v] -= r
            chosen += best_fit(left)
            if best is None or sum(r for _, r in chosen) < sum(r for _, r in best):
                best = chosen
    return best


def pack(parts: DataFrame, max_len: int = 2048) -> DataFrame:
    """Place every row of `parts` (doc_id, piece, length, ...) in a sequence: adds sequence_id and offset.

    Lengths must lie in 1..max_len. Only the histogram of lengths (at most `max_len` rows) passes the driver, which
    plans patterns and their repeats; the size of the plan follows `max_len`, not the data. Rows are numbered within
    their length by salted counts, so one length may hold any share of the rows, and a row's number gives its place.
    An empty table gives an empty table.
    """
    spark = parts.sparkSession
    counts = np.zeros(max_len + 1, np.int64)
    for length, n in parts.groupBy("length").count().collect():  # at most max_len rows
        counts[length] = n
    keys, bases, offsets, given, base = [], [], [], np.zeros(max_len + 1, np.int64), 0
    for lengths, repeats in plan(counts):
        offset = 0
        for v in lengths:
            keys.append((v << 44) + given[v])
            bases.append(base - given[v])
            offsets.append(offset)
            given[v] += repeats
            offset += v
        base += repeats
    order = np.argsort(keys)
    table = spark.sparkContext.broadcast(tuple(np.array(x, np.int64)[order] for x in (keys, bases, offsets)))

    salted = parts.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n")).select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("__nth", F.row_number().over(within)).join(groups, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__nth") - 1).select(*parts.columns, "__rank")

    names = parts.columns

    def place(batches):
        keys, bases, offsets = table.value
        for batch in batches:
            rank = batch.column("__rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 44) + rank, side="right") - 1
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bases[at] + rank), pa.array(offsets[at])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack all of `docs`; with `with_ids` each row also carries its token ids.

    Texts are tokenized once; what is written to the shared folder is a short row per piece.
    """
    return pack(materialize(pieces(docs, tokenizer_path, max_len, with_ids=with_ids), "pieces"), max_len)
