"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import components, flat_text, forest, give_back, materialize, text_slices

BITS = 64


def _digests(text: bytes, shingle: int, seed: int) -> bytes:
    """XXH64 of each shingle, eight bytes each; fewer words than a shingle are one shingle, no words none."""
    words = text.lower().split()  # bytes: lower-cases A-Z only, splits at ASCII white space only
    n = len(words) - shingle + 1
    line = b" ".join(words)
    if n < 1:
        return xxhash.xxh64_digest(line, seed) if words else b""
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: n - 1]]
    digest = xxhash.xxh64_digest
    return b"".join([digest(line[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :])])


def _majority(hashes: np.ndarray) -> int:
    """Bits that over half of the 8-byte hashes have."""
    n = len(hashes) // 8
    ones = np.add.reduce(np.unpackbits(hashes).reshape(n, BITS), axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of one text: a bit is set where over half of the shingles' XXH64 have it; no words: 0."""
    return _majority(np.frombuffer(_digests(text, shingle, seed), np.uint8))


def shingle_set(text: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct shingles of one text as sorted hashes."""
    return np.unique(np.frombuffer(_digests(text, shingle, seed), ">u8").astype(np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every whole text; null texts count as empty. One narrow pass."""

    def run(batches):
        for part in text_slices(batches):
            data, offsets = flat_text(part.column("text"))
            raw, bounds = data.tobytes(), offsets.tolist()
            fps = np.array([fingerprint(raw[a:b], shingle, seed) for a, b in zip(bounds, bounds[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps.astype(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(n: int, distance: int, fill: int = 64) -> list[int]:
    """Bit masks such that any two fingerprints at most `distance` bits apart agree on one of them.

    The bits are cut into r blocks and every choice of r - distance blocks is a mask. r grows with the number of
    fingerprints until a mask's values would hold about `fill` of them if spread evenly, so work stays near linear.
    """
    blocks = distance + 1
    while n > fill << (BITS * (blocks - distance) // blocks) and comb(blocks + 1, distance) <= 500:
        blocks += 1
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def close_links(distinct: DataFrame, distance: int, tile: int = 2048) -> DataFrame:
    """Links (a, b) that join all rows of `distinct` (fp long, id long; one row a fingerprint) whose fingerprints differ
    in at most `distance` bits, as spanning forests of each task's links.

    Rows go to their blocks; a block of more than `tile` fingerprints is cut into chunks, and each pair of chunks is a
    task of its own, so no block has to fit in one task.
    """
    n = distinct.count()
    masks = block_masks(n, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    blocks = F.array(*[F.struct(F.lit(i).alias("mask"), F.lit(m).cast("long").bitwiseAND(F.col("fp")).alias("part")) for i, m in enumerate(signed)])
    spread = distinct.select("fp", "id", F.explode(blocks).alias("k")).select("fp", "id", "k.mask", "k.part")
    hot = spread.groupBy("mask", "part").count().where(F.col("count") > tile).select("mask", "part", F.ceil(F.col("count") / tile).cast("int").alias("chunks"))
    hot = materialize(hot, "hot-blocks")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: F.struct(F.least("chunk", other).alias("low"), F.greatest("chunk", other).alias("high")),
    )
    tiled = spread.join(hot, ["mask", "part"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", chunk)
    tiled = tiled.select("fp", "id", "mask", "part", "chunk", F.explode(pairs).alias("t")).select("fp", "id", F.xxhash64("mask", "part", "t.low", "t.high").alias("task"), (F.col("chunk") == F.col("t.low")).alias("is_low"), (F.col("t.low") == F.col("t.high")).alias("alone"))
    sorted_ = tiled.repartition("task").sortWithinPartitions("task")

    def run(batches):
        held: list[np.ndarray] = []

        def solve(cols):
            task, fp, ids, is_low, alone = cols
            fp = fp.view(np.uint64)  # counting the bits of signed numbers would drop the sign
            edge = np.flatnonzero(np.diff(task, prepend=task[:1] - 1))
            size = np.diff(np.append(edge, len(task)))
            found_a, found_b = [], []
            small = np.repeat(size <= 96, size)
            for gap in range(1, int(size[size <= 96].max(initial=0))):
                same = np.flatnonzero((task[:-gap] == task[gap:]) & small[gap:])
                close = same[np.bitwise_count(fp[same] ^ fp[same + gap]) <= distance]
                # two tiles of different chunks only pair across
                close = close[alone[close] | (is_low[close] != is_low[close + gap])]
                found_a.append(ids[close])
                found_b.append(ids[close + gap])
            for at, k in zip(edge[size > 96].tolist(), size[size > 96].tolist()):
                s = slice(at, at + k)
                f, i, low = fp[s], ids[s], is_low[s]
                left, right = (np.arange(k), np.arange(k)) if alone[at] else (np.flatnonzero(low), np.flatnonzero(~low))
                for c in range(0, len(left), 256):
                    x, y = np.nonzero(np.bitwise_count(f[left[c : c + 256], None] ^ f[right]) <= distance)
                    if len(x):
                        a, b = forest(i[left[c + x]], i[right[y]])
                        found_a.append(a)
                        found_b.append(b)
            a, b = np.concatenate(found_a or [ids[:0]]), np.concatenate(found_b or [ids[:0]])
            a, b = forest(a, b) if len(a) else (a, b)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "fp", "id", "is_low", "alone")]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))  # the last task may go on in the next batch
            if last:
                yield solve([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held:
            yield solve(held)

    return sorted_.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Documents link when their fingerprints differ in at most `distance` bits; component_id is the smallest doc_id
    reachable. Equal fingerprints are one node whatever their number, so copies never pair with each other. Null and
    empty texts have fingerprint 0 and link like any other. Repeated rows give a row each; a null doc_id is only ever a
    component_id if nothing else is reachable.
    """
    marked = materialize(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").cast("long").alias("id")), "distinct-fingerprints")
    # an id may be shared by several fingerprints (repeated ids), so links are between fingerprints
    links = close_links(distinct.select("fp", F.col("fp").alias("id")), distance)
    joined = components(links, "simhash")
    classes = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = materialize(classes.join(smallest, "root").select("fp", "component_id"), "simhash-classes")
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _firsts(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` whose id is the component_id of their group in `groups`, one row of each."""
    keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__keep")).distinct()
    kept = docs.join(keep, docs[id_col].eqNullSafe(keep["__keep"]), "left_semi")
    same = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.lit(0))
    return kept.withColumn("__copy", F.row_number().over(same)).where("__copy = 1").drop("__copy")


def near_dedup(docs: DataFrame, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each group of near-duplicates the one with the smallest id, with the columns of
    `docs`. Rows are kept by id: where an id has several texts all of them stay if one of them is the smallest of its group,
    and equal rows of it are one. Null texts count as empty; null ids form a group's rest only where nothing else is in it."""
    return _firsts(docs, simhash_groups(docs, distance, id_col=id_col, text_col=text_col), id_col, text_col)


def parity_bits(shingles: np.ndarray) -> bytes:
    """One bit for each residue of the shingle hashes, about as many as shingles: whether an odd number of them has it.
    Two sets differ in at least as many shingles as their bitmaps differ in bits."""
    size = 1 << max(6, int(len(shingles)).bit_length())
    return np.packbits((np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def signature(shingles: np.ndarray) -> bytes:
    """The same in 512 bits, whatever the number of shingles."""
    return np.packbits((np.bincount((shingles & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8), bitorder="little").tobytes()


def fewest_differences(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets has; the longer bitmap is folded."""
    x, y = (np.frombuffer(v, np.uint64) for v in sorted((a, b), key=len))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _common_shingles(docs: DataFrame, shingle: int, seed: int, texts: int = 4_000, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingle hashes, texts that hold each) of shingles that `least` of about `texts` sampled texts share,
    counted where a slice of texts has them at least twice.

    Only the order in which prefixes are taken depends on them, never which pairs are found.
    """
    rate = int((1 << 30) * min(1.0, texts / max(1, docs.count())))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < rate).select("text").distinct()

    def run(batches):
        for part in text_slices(batches):
            data, offsets = flat_text(part.column("text"))
            raw, bounds = data.tobytes(), offsets.tolist()
            found = [shingle_set(raw[a:b], shingle, seed) for a, b in zip(bounds, bounds[1:])]
            one, n = np.unique(np.concatenate(found), return_counts=True)
            one, n = one[n > 1], n[n > 1]
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n)], ["token", "n"])

    counted = sample.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    token = counted["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], counted["n"].to_numpy(np.int64)[order]


def _sketches(docs: DataFrame, shingle: int, seed: int, share: Fraction) -> DataFrame:
    """(doc_id, node, fp, n, bits, sig, prefix) of every row of (doc_id, text): a hash of its shingle set, the set's SimHash
    and size, its parity bitmaps (in proportion to its size, and short), and the shingles of which two texts of similarity `share` have one in common."""
    shared = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, shingle, seed))

    def run(batches):
        common, texts = shared.value
        for part in text_slices(batches):
            data, offsets = flat_text(part.column("text"))
            raw, bounds = data.tobytes(), offsets.tolist()
            node, fp, size, bits, sig, prefix = [], [], [], [], [], []
            for a, b in zip(bounds, bounds[1:]):
                s = shingle_set(raw[a:b], shingle, seed)
                n = len(s)
                node.append(xxhash.xxh64_intdigest(s.tobytes(), seed))
                fp.append(_majority(s.astype(">u8").view(np.uint8)))
                size.append(n)
                bits.append(parity_bits(s))
                sig.append(signature(s))
                if len(common):  # rare shingles first, so that few texts meet
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    s = s[np.argsort(np.where(common[at] == s, texts[at], 0), kind="stable")]
                prefix.append(s[: n - -(-share.numerator * n // share.denominator) + 1 if n else 0].tobytes())
            cols = [part.column("doc_id"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(bits, pa.binary()), pa.array(sig, pa.binary()), pa.array(prefix, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "node", "fp", "n", "bits", "sig", "prefix"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, fp long, n int, bits binary, sig binary, prefix binary")


def _prefix_tokens(nodes: DataFrame) -> DataFrame:
    """(token, node, root, n, pos): a row for each shingle of a prefix."""

    def spread(batches):
        for batch in batches:
            raw = [np.frombuffer(x, np.int64) for x in batch.column("prefix").to_pylist()]
            size = np.array([len(x) for x in raw], np.int64)
            cols = [np.repeat(batch.column(c).to_numpy(), size) for c in ("node", "root", "n")]
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            token = np.concatenate(raw) if raw else np.zeros(0, np.int64)
            for lo in range(0, len(token), 1 << 17):
                cut = slice(lo, lo + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(token[cut]), *[pa.array(c[cut]) for c in cols], pa.array(pos[cut].astype(np.int32))], ["token", "node", "root", "n", "pos"])

    return nodes.select("node", "root", "n", "prefix").mapInArrow(spread, "token long, node long, root long, n int, pos int")


#: Any eight different numbers.
MIX = np.arange(1, 9, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _prefix_pairs(tokens: DataFrame, share: Fraction, hub: int | None) -> DataFrame:
    """(a, b, token): pairs of nodes with different roots that share a token and may reach `share`; of tokens that more
    than `hub` nodes have, only pairs with one of these (chosen by the token, of eight), and the token itself is told. None: all pairs of all tokens.

    Two sets of that similarity share a shingle of their prefixes, their sizes allow for it, and so does what follows
    the first shared shingle, and the bits in which their signatures differ, if `tokens` has them (sig).
    """
    p, q = share.numerator, share.denominator
    names = ["token", "node", "root", "n", "pos", *(["sig"] if "sig" in tokens.columns else [])]

    def run(batches):
        held: list[list[np.ndarray]] = []

        def fits(x, y, root, n, pos, sig=None):
            nx, ny = n[x].astype(np.int64), n[y].astype(np.int64)
            left = np.minimum(nx - pos[x], ny - pos[y])
            ok = (root[x] != root[y]) & (q * np.minimum(nx, ny) >= p * np.maximum(nx, ny)) & ((p + q) * left >= p * (nx + ny))
            if sig is not None:
                i = np.flatnonzero(ok)
                differ = np.bitwise_count(sig[x[i]] ^ sig[y[i]]).sum(1, dtype=np.int64)
                ok[i] = differ * (p + q) <= (nx[i] + ny[i]) * (q - p)
            return ok

        def solve(cols):
            token, node, root, n, pos, *sig = cols
            edge = np.flatnonzero(np.diff(token, prepend=token[:1] - 1))
            size = np.diff(np.append(edge, len(token)))
            most = 96 if hub is None else hub
            small = np.repeat(size <= most, size)
            found = [(node[:0], node[:0])]
            for gap in range(1, int(size[size <= most].max(initial=0))):
                x = np.flatnonzero((token[:-gap] == token[gap:]) & small[gap:])
                x = x[fits(x, x + gap, root, n, pos, *sig)]
                found.append((node[x], node[x + gap]))
            large = np.flatnonzero(size > most)
            for at, k in zip(edge[large].tolist(), size[large].tolist()):
                if (root[at : at + k] == root[at]).all():
                    continue
                if hub is not None:
                    # one of eight nodes, by the token: a group that shares many tokens meets several of its own
                    mixed = (node[at : at + k].view(np.uint64) ^ MIX[int(token[at]) & 7]) * np.uint64(0x9E3779B97F4A7C15)
                    x, y = np.full(k, at + int(mixed.argmin())), np.arange(at, at + k)
                    ok = fits(x, y, root, n, pos, *sig)
                    found.append((node[x[ok]], node[y[ok]]))
                    continue
                s = at + np.argsort(n[at : at + k], kind="stable")  # by size: only the next ones up to 1 / share are compared
                until = np.searchsorted(n[s].astype(np.int64) * p, n[s].astype(np.int64) * q, side="right")
                for c in range(0, k, 256):
                    rows, others = s[c : c + 256], s[c : until[min(c + 256, k) - 1]]
                    i, j = np.nonzero(np.arange(len(rows))[:, None] < np.arange(len(others)))
                    x, y = rows[i], others[j]
                    ok = fits(x, y, root, n, pos, *sig)
                    found.append((node[x[ok]], node[y[ok]]))
            a, b = (np.concatenate(f) for f in zip(*found))
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            told = token[edge[large]] if hub is not None else token[:0]
            none = pa.nulls(len(told), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.nulls(len(pair), pa.int64())], ["a", "b", "token"])
            yield pa.RecordBatch.from_arrays([none, none, pa.array(told)], ["a", "b", "token"])

        def take(last_too):
            cols = [np.concatenate(x) for x in zip(*held)]
            last = len(cols[0]) if last_too else int(np.searchsorted(cols[0], cols[0][-1], side="left"))  # the last token may go on in the next batch
            held[:] = [[c[last:] for c in cols]]
            return [c[:last] for c in cols]

        waiting = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in names[:5]]
            if len(names) > 5:
                cols.append(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(-1, 8))
            held.append(cols)
            waiting += batch.num_rows
            if waiting >= 1 << 15:  # pairs that meet at many tokens are told once
                cols = take(False)
                if len(cols[0]):
                    yield from solve(cols)
                waiting = 0
        if held and len((cols := take(True))[0]):
            yield from solve(cols)
        cols = None
        held.clear()
        give_back()

    return tokens.select(*names).repartition("token").sortWithinPartitions("token").mapInArrow(run, "a long, b long, token long").distinct()


def _alike(pairs: DataFrame, nodes: DataFrame, share: Fraction, name: str) -> DataFrame:
    """Those of `pairs` (a, b) whose bitmaps do not rule out a similarity of `share`."""
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    p, q = share.numerator, share.denominator

    def run(batches):
        for batch in batches:
            total = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            apart = np.array([fewest_differences(x, y) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())], np.int64)
            ok = pa.array((p + q) * apart <= (q - p) * total)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return materialize(both.mapInArrow(run, "a long, b long"), f"{name}-alike")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, seed: int, share: Fraction, name: str) -> DataFrame:
    """Those of `pairs` (a, b) whose whole shingle sets have a Jaccard similarity of at least `share`."""
    pairs = _alike(pairs, nodes, share, name)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    ends = materialize(nodes.join(ends, "node", "left_semi").select("node", F.col("id").alias("at")), f"{name}-ends")

    def sets(batches):
        for part in text_slices(batches):
            data, offsets = flat_text(part.column("text"))
            raw, bounds = data.tobytes(), offsets.tolist()
            found = [shingle_set(raw[a:b], shingle, seed).tobytes() for a, b in zip(bounds, bounds[1:])]
            node = np.array([xxhash.xxh64_intdigest(s, seed) for s in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(found, pa.binary())], ["node", "shingles"])

    at = ends.select("at").distinct()
    texts = docs.join(at, docs["doc_id"].cast("long").eqNullSafe(at["at"]), "left_semi").select("text")
    held = texts.mapInArrow(sets, "node long, shingles binary").join(ends.select("node"), "node", "left_semi").dropDuplicates(["node"])
    held = materialize(held, f"{name}-sets")
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(s, np.uint64) for s in batch.column(c).to_pylist()] for c in ("x", "y"))
            both = np.array([len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y)], np.int64)
            total = np.array([len(s) + len(t) for s, t in zip(x, y)], np.int64)
            ok = pa.array((share.numerator + share.denominator) * both >= share.numerator * total)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), f"{name}-links")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = 42, distance: int = 4, hub: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row of `docs`.

    Documents link when the Jaccard similarity of their sets of `shingle` words is at least `similarity`, counted on the
    whole sets; component_id is the smallest doc_id reachable. SimHash blocks propose the close copies first, so that
    large groups are one before the rest is compared; what differs in more bits comes from a join on shingle prefixes,
    which leaves out no pair of that similarity. Of a shingle that more than `hub` nodes have in their prefixes, pairs
    with one of them come first, so that a large group is one before its other pairs are looked at. Bitmaps rule out most
    candidates before whole sets are sent. Equal sets are one node; texts without words are equal. Null texts count as
    empty, repeated rows give a row each, a null doc_id is only ever a component_id if nothing else is reachable.
    """
    share = Fraction(str(similarity))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = materialize(_sketches(docs, shingle, seed, share), "sketches")
    nodes = marked.groupBy("node").agg(F.min("doc_id").cast("long").alias("id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix"))
    nodes = materialize(nodes, "distinct-sets")
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "first-of-fingerprint")
    near = close_links(first.select("fp", F.col("fp").alias("id")), distance).distinct()  # forests of many blocks say the same
    near = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    same = nodes.join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = near.select(F.col("x").alias("a"), F.col("y").alias("b")).union(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _verified(near, nodes, docs, shingle, seed, share, "near")

    def rooted(links: DataFrame, name: str) -> DataFrame:
        roots = materialize(components(links, name), f"{name}-roots").withColumnRenamed("component", "root")
        return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    found = materialize(_prefix_pairs(_prefix_tokens(rooted(links, "near")), share, hub), "similar-pairs")
    links = links.union(_verified(found.where("a is not null").select("a", "b"), nodes, docs, shingle, seed, share, "similar"))
    hot = found.where("token is not null").select("token")
    if not hot.isEmpty():  # what large groups have besides their pairs with one node, where roots still differ
        tokens = _prefix_tokens(rooted(links, "similar")).join(hot, "token").join(nodes.select("node", "sig"), "node")
        links = links.union(_verified(_prefix_pairs(tokens, share, None).select("a", "b"), nodes, docs, shingle, seed, share, "rest"))
    joined = components(links, "linked")
    classes = nodes.select("node", "id").join(joined, "node", "left").select("node", "id", F.coalesce("component", "node").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = materialize(classes.join(smallest, "root").select("node", "component_id"), "similar-classes")
    return marked.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id")


def similar_dedup(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each group of similar_groups the one with the smallest id, by the rules of
    near_dedup."""
    return _firsts(docs, similar_groups(docs, similarity, shingle, id_col=id_col, text_col=text_col), id_col, text_col)
