"""Exact substring deduplication across documents by hash-compared suffix sorting.

A byte goes if it lies in a `span`-byte string that also starts in a document with a smaller doc_id. Which strings are
repeats is decided by sorted suffixes: a mergesort whose comparisons find the common extension of two suffixes by binary
search over prefix polynomial hashes, and whose neighbours are then compared byte by byte. Sorting every suffix of a
large corpus would move it many times over, so only suffixes that start at anchors are sorted. Hashes only decide which
suffixes meet; nothing goes without its bytes being compared.

1. Sparse anchors are content-defined cuts, one in about 256 bytes. The suffix from a cut to the next one and span - 1
   bytes further is a segment; where an earlier document has an equal one, all strings that start in it are repeats.
   This settles the inside of long copies. What remains open are first occurrences, edges and short repeats.
2. Of every open string the 24-gram with the smallest hash (leftmost at ties) is its dense anchor; equal strings have
   equal anchors at equal places. Only anchors whose 24-gram occurs in several documents go on.
3. The suffixes that go on from a dense anchor and the reversed prefixes that lead to it are sorted, each within the
   anchors of the same 24-gram. Neighbours' common extensions give classes of equal strings, and the smallest doc_id of
   a class tells which of its strings are repeats.

Equal pieces of one slice of texts are one row from there on, under their smallest doc_id. The text moves once, into a
table bucketed by document; all joins with it are free of further shuffles.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import flat_text, materialize, shared_dir, text_slices

SPAN = 50
GRAM = 24
#: A segment is cut after so many bytes without a content-defined cut.
LONGEST = 1024
#: More anchors of one 24-gram than this are dealt out as their single strings, which are sorted in the same way, so no
#: group need fit in a task.
HOT = 20_000
#: Dense anchors of about so many bytes of text meet in one task.
BUCKET_BYTES = 16 << 20

_RNG = np.random.default_rng(20_231)
_TABLE = _RNG.integers(0, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n of the base or its inverse, modulo 2^64."""
    if len(_powers.get(kind, ())) <= n:
        size = max(n + 1, 1 << 16)
        out = np.full(size, _BASE if kind == "base" else _INVERSE, np.uint64)
        out[0] = 1
        _powers[kind] = np.cumprod(out, dtype=np.uint64)
    return _powers[kind][: n + 1]


def _prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power("base", len(data))[: len(data)], out=out[1:])
    return out


def gram_hashes(data: np.ndarray, gram: int = GRAM, block: int = 1 << 20) -> np.ndarray:
    """Hash of the `gram` bytes from each position, from prefix polynomial hashes; grams may cross texts."""
    out = np.zeros(max(0, len(data) - gram + 1), np.uint64)
    for lo in range(0, len(out), block):
        prefix = _prefix_hashes(data[lo : lo + block + gram - 1])
        h = (prefix[gram:] - prefix[:-gram]) * _power("inverse", len(prefix))[: len(prefix) - gram]
        h ^= h >> np.uint64(32)
        h *= _MIX
        out[lo : lo + len(h)] = h ^ (h >> np.uint64(29))
    return out


def _digest(piece: bytes, size: int) -> int:
    return int.from_bytes(hashlib.blake2b(piece, digest_size=size).digest(), "little", signed=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _starts_and_ends(offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings' possible starts in each text: the first, and one past the last."""
    return offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - span + 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` entries."""
    done, m = 1, x
    while done * 2 <= width:
        m = np.minimum(m[: len(m) - done], m[done:])
        done *= 2
    if done < width:
        m = np.minimum(m[: len(m) - (width - done)], m[width - done :])
    return m


def smallest_grams(h: np.ndarray, is_open: np.ndarray, width: int, block: int = 1 << 18) -> np.ndarray:
    """True at the smallest of each run of `width` grams that begins at an open position (ties: the first). A part at a
    time, as ranks and minima are eight bytes each a byte of text, several times over."""
    chosen = np.zeros(len(h), bool)
    for lo in range(0, len(h) - width + 1, block):
        part = h[lo : lo + block + width - 1]
        ranked = (part & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(part), dtype=np.uint64)
        starts = np.flatnonzero(is_open[lo : lo + block])
        chosen[lo + (sliding_min(ranked, width)[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    return chosen


_SEGMENT = pa.schema([("h", pa.int64()), ("k", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _segments(table: DataFrame, span: int, mean: int, digest_size: int) -> DataFrame:
    """(h, k, doc_id, lo, hi): segments, whose strings start at lo..hi-1, with a digest. h is null where the same slice of
    texts has an equal segment under a smaller doc_id: those are repeats already."""
    limit = np.uint64((1 << 64) // mean)

    def run(batches):
        for part in text_slices(batches):
            data, offsets = flat_text(part.column("text"))
            ids = part.column("doc_id").to_pylist()
            keys = part.column("k").to_pylist()
            first, last = _starts_and_ends(offsets, span)
            cut = np.flatnonzero(gram_hashes(data) < limit)
            raw, found, best = data.tobytes(), [], {}
            at = np.searchsorted(cut, first, side="right").tolist()
            to = np.searchsorted(cut, last, side="left").tolist()
            first, last, ends = first.tolist(), last.tolist(), offsets.tolist()
            for i, doc in enumerate(ids):
                if doc is None or last[i] <= first[i]:
                    continue
                marks = [first[i], *cut[at[i] : to[i]].tolist(), last[i]]
                for begin, end in zip(marks, marks[1:]):
                    for a in range(begin, end, LONGEST):
                        b = min(end, a + LONGEST)
                        piece = raw[a : b + span - 1]
                        found.append((piece, i, a - ends[i], b - ends[i]))
                        best[piece] = min(doc, best.get(piece, doc))
            digests = {piece: _digest(piece, digest_size) for piece in best}
            yield _batch([(None if best[g] < ids[i] else digests[g], keys[i], ids[i], a, b) for g, i, a, b in found], _SEGMENT)

    return table.select("k", "doc_id", "text").mapInArrow(run, "h long, k long, doc_id long, lo int, hi int")


_EQUAL = pa.schema([("h", pa.int64()), ("k", pa.int64()), ("doc_id", pa.int64()), ("suffix", pa.binary()), ("places", pa.list_(pa.int32())), ("reach", pa.int32())])


def _segment_suffixes(table: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """(h, k, doc_id, suffix, places, reach) of the segments `wanted` (h, k, doc_id, lo, hi), with their bytes."""

    def run(batches):
        for part in text_slices(batches):
            data, offsets = flat_text(part.column("text"))
            raw, ends = data.tobytes(), offsets.tolist()
            found = []
            for i, (k, doc, some) in enumerate(zip(*(part.column(c).to_pylist() for c in ("k", "doc_id", "some")))):
                for s in some:
                    if s["doc_id"] == doc:
                        found.append((s["h"], k, doc, raw[ends[i] + s["lo"] : ends[i] + s["hi"] + span - 1], [s["lo"]], s["hi"] - s["lo"] + span - 1))
            yield _batch(found, _EQUAL)

    by_key = wanted.groupBy("k").agg(F.collect_list(F.struct("h", "doc_id", "lo", "hi")).alias("some"))
    joined = table.select("k", "doc_id", "text").join(by_key, "k")
    return joined.mapInArrow(run, "h long, k long, doc_id long, suffix binary, places array<int>, reach int")


def _pack_places(keys: np.ndarray, at: np.ndarray) -> bytes:
    return keys.astype("<i8").tobytes() + at.astype("<i4").tobytes()


def _unpack_places(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    return np.frombuffer(blob, "<i8", n), np.frombuffer(blob, "<i4", n, 8 * n)


def _anchors(open_docs: DataFrame, span: int, buckets: int) -> DataFrame:
    """(bucket, known, blob) of anchors of open strings: packed (hash, k, position) for the reducers of `bucket`, or packed
    (k, position) of anchors that a slice of texts by itself shows to occur in several documents."""
    width = span - GRAM + 1

    def run(batches):
        for part in text_slices(batches):
            data, offsets = flat_text(part.column("text"))
            first, last = _starts_and_ends(offsets, span)
            is_open = np.zeros(len(data) + 1, np.int32)
            real = last > first
            np.add.at(is_open, first[real], 1)
            np.add.at(is_open, last[real], -1)
            is_open = np.cumsum(is_open[:-1]) > 0
            for i, (doc, done) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("done").to_pylist())):
                if doc is None:
                    is_open[offsets[i] : offsets[i + 1]] = False
                for s in done or ():
                    if s["doc_id"] == doc:
                        is_open[offsets[i] + s["lo"] : offsets[i] + s["hi"]] = False
            if not is_open.any():
                continue
            h = gram_hashes(data)
            pos = np.flatnonzero(smallest_grams(h, is_open, width))
            row = np.searchsorted(offsets, pos, side="right") - 1
            keys = part.column("k").to_numpy()[row]
            code, at = h[pos], (pos - offsets[row]).astype(np.int32)
            order = np.lexsort((keys, code))
            code, keys, at = code[order], keys[order], at[order]
            new = np.diff(code, prepend=code[:1] ^ np.uint64(1)) != 0
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            begin = np.flatnonzero(new)
            several = keys[begin] != keys[begin + size - 1]
            known = several[group]
            send = ~known | new
            bucket = (code >> np.uint64(32)).astype(np.int64) % buckets
            whole = [(int(bucket[0]), True, _pack_places(keys[known], at[known]))] if known.any() else []
            code, keys, at, bucket = code[send], keys[send], at[send], bucket[send]
            order = np.argsort(bucket, kind="stable")
            code, keys, at, bucket = code[order], keys[order], at[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs = []
            for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
                docs, of = np.unique(keys[a:b], return_inverse=True)
                head = np.array([b - a, len(docs)], "<i8").tobytes()
                blobs.append(head + code[a:b].tobytes() + docs.tobytes() + of.astype("<u4").tobytes() + at[a:b].tobytes())
            out = whole + [(int(bucket[a]), False, blob) for a, blob in zip(cuts, blobs)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.bool_(), pa.binary()))], ["bucket", "known", "blob"])

    return open_docs.mapInArrow(run, "bucket long, known boolean, blob binary")


def _shared_anchors(packed: DataFrame, n: int) -> DataFrame:
    """(k, places) of anchors whose 24-gram occurs under several keys. Each task reads whole buckets and deals what it
    finds to `n` groups of keys, packed, so that the rows in between follow the tasks and not the documents."""

    def unpack(blob: bytes):
        n, m = np.frombuffer(blob, "<i8", 2).tolist()
        code = np.frombuffer(blob, "<u8", n, 16)
        docs = np.frombuffer(blob, "<i8", m, 16 + 8 * n)
        of = np.frombuffer(blob, "<u4", n, 16 + 8 * (n + m))
        return code, docs[of], np.frombuffer(blob, "<i4", n, 16 + 8 * (n + m) + 4 * n)

    def find(batches):
        held, found = [], []
        for batch in batches:
            for known, blob in zip(batch.column("known").to_pylist(), batch.column("blob").to_pylist()):
                if known:
                    found.append(_unpack_places(blob))
                else:
                    held.append(unpack(blob))
        if held:
            code, keys, at = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((keys, code))
            code, keys, at = code[order], keys[order], at[order]
            begin = np.flatnonzero(np.diff(code, prepend=code[:1] ^ np.uint64(1)) != 0)
            size = np.diff(np.append(begin, len(code)))
            several = np.repeat(keys[begin] != keys[begin + size - 1], size)
            found.append((keys[several], at[several]))
        if found:
            keys, at = (np.concatenate(x) for x in zip(*found))
            group = (keys.view(np.uint64) % np.uint64(n)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            group, keys, at = group[order], keys[order], at[order]
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            blobs = [_pack_places(keys[a:b], at[a:b]) for a, b in zip(cuts, [*cuts[1:], len(group)])]
            yield pa.RecordBatch.from_arrays([pa.array(group[cuts]), pa.array(blobs, pa.binary())], ["grp", "blob"])

    def gather(batches):
        found = [_unpack_places(blob) for batch in batches for blob in batch.column("blob").to_pylist()]
        if found:
            keys, at = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            begin = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ 1) != 0)
            for lo in range(0, len(begin), 10_000):
                some = begin[lo : lo + 10_000]
                end = begin[lo + 10_000] if lo + 10_000 < len(begin) else len(keys)
                places = pa.ListArray.from_arrays(pa.array((np.append(some, end) - some[0]).astype(np.int32)), pa.array(at[some[0] : end]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), places], ["k", "places"])

    grouped = packed.mapInArrow(find, "grp long, blob binary").repartition(n, "grp")
    return grouped.mapInArrow(gather, "k long, places array<int>")


_CONTEXT = pa.schema([("h", pa.int64()), ("k", pa.int64()), ("doc_id", pa.int64()), ("before", pa.binary()), ("suffix", pa.binary()), ("places", pa.list_(pa.int32())), ("lo", pa.int32()), ("hi", pa.int32())])
_CONTEXT_SQL = "h long, k long, doc_id long, before binary, suffix binary, places array<int>, lo int, hi int"


def _distinct_rows(found: list[tuple], core: int, digest_size: int) -> list[tuple]:
    """found: (before, suffix, k, doc, at). One row for equal bytes of one document; those of larger ids than the
    smallest in the slice are bytes to remove (lo, hi) instead. h is the digest of the first `core` bytes of the suffix."""
    best: dict[tuple, int] = {}
    for before, suffix, _, doc, _ in found:
        best[before, suffix] = min(doc, best.get((before, suffix), doc))
    held: dict[tuple, list[int]] = {}
    gone = []
    for before, suffix, k, doc, at in found:
        if doc > best[before, suffix]:
            gone.append((None, k, doc, None, None, None, at - len(before), at + len(suffix)))
        else:
            held.setdefault((before, suffix, k, doc), []).append(at)
    return gone + [(_digest(suffix[:core], digest_size), k, doc, before, suffix, places, None, None) for (before, suffix, k, doc), places in held.items()]


def _contexts(docs: DataFrame, span: int, digest_size: int) -> DataFrame:
    """(h, k, doc_id, before, suffix, places, lo, hi): the suffix from each shared anchor and the reversed bytes before it."""
    around = span - GRAM

    def run(batches):
        for part in text_slices(batches):
            data, offsets = flat_text(part.column("text"))
            raw, ends = data.tobytes(), offsets.tolist()
            found = []
            for i, (k, doc, places) in enumerate(zip(*(part.column(c).to_pylist() for c in ("k", "doc_id", "places")))):
                a, b = ends[i], ends[i + 1]
                for at in sorted(set(places)):
                    before, suffix = raw[max(a, a + at - around) : a + at][::-1], raw[a + at : min(b, a + at + span)]
                    if len(before) + len(suffix) >= span:
                        found.append((before, suffix, k, doc, at))
            yield _batch(_distinct_rows(found, GRAM, digest_size), _CONTEXT)

    return docs.mapInArrow(run, _CONTEXT_SQL)


def _strings_of_hot(hot: DataFrame, span: int, digest_size: int) -> DataFrame:
    """The strings around hot anchors as suffixes of their own, of which the first `span` bytes count."""

    def run(batches):
        for batch in batches:
            found = []
            for k, doc, before, suffix, places in zip(*(batch.column(c).to_pylist() for c in ("k", "doc_id", "before", "suffix", "places"))):
                text = before[::-1] + suffix
                for s in range(len(text) - span + 1):
                    found += [(b"", text[s : s + span], k, doc, at - len(before) + s) for at in places]
            yield _batch(_distinct_rows(found, span, digest_size), _CONTEXT)

    return hot.mapInArrow(run, _CONTEXT_SQL)


def suffix_sort(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes data[start : start + size] within their groups (group: ascending ids). Returns the order, and for
    each place in it the number of leading bytes shared with the suffix before it (0 at a group's first).

    Mergesort by ranks: at each level every suffix finds its place in the partner run by binary search, all at once.
    A comparison finds the common extension by binary search over prefix polynomial hashes and looks at the next byte.
    The shared bytes that are returned are counted on the bytes themselves, so a collision of hashes can neither create
    nor hide a match between neighbours.
    """
    n = len(start)
    prefix, inverse = _prefix_hashes(data), _power("inverse", len(data))
    bytes_ = np.append(data, 0)

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = start[x], start[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(size[x], size[y])
        short = high.copy()
        while True:
            going = low < high
            if not going.any():
                break
            mid = (low + high + 1) // 2
            same = (prefix[a + mid] - prefix[a]) * inverse[a] == (prefix[b + mid] - prefix[b]) * inverse[b]
            low = np.where(going & same, mid, low)
            high = np.where(going & ~same, mid - 1, high)
        return np.where(low == short, size[x] < size[y], bytes_[a + low] < bytes_[b + low])

    order = np.arange(n)
    first = np.searchsorted(group, group, side="left")
    last = np.searchsorted(group, group, side="right")
    place = np.arange(n)
    run = 1
    while n and run < (last - first).max():
        at = np.flatnonzero(last - first > run)
        own = (place[at] - first[at]) // run
        begin = first[at] + (own ^ 1) * run
        low, high = np.minimum(begin, last[at]), np.minimum(begin + run, last[at])
        begin = low.copy()
        while True:
            going = np.flatnonzero(low < high)
            if not len(going):
                break
            mid = (low[going] + high[going]) // 2
            x, y = order[at[going]], order[mid]
            # the left run's suffix goes first at ties
            after = np.where(own[going] % 2 == 1, ~less(x, y), less(y, x))
            low[going] = np.where(after, mid + 1, low[going])
            high[going] = np.where(after, high[going], mid)
        to = first[at] + (own & ~1) * run + (place[at] - first[at] - own * run) + (low - begin)
        merged = order.copy()
        merged[to] = order[at]
        order = merged
        run *= 2
    shared = np.zeros(n, np.int64)
    together = np.flatnonzero(group[1:] == group[:-1])
    if len(together):
        x, y = order[together + 1], order[together]
        most = np.minimum(size[x], size[y])
        begin = np.cumsum(most) - most
        step = np.arange(most.sum()) - np.repeat(begin, most)
        differ = np.append(np.flatnonzero(data[np.repeat(start[x], most) + step] != data[np.repeat(start[y], most) + step]), len(step))
        shared[together + 1] = np.minimum(differ[np.searchsorted(differ, begin)] - begin, most)
    return order, shared


def _sorted(column: pa.Array, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, shared, size) of a column of byte strings as suffixes."""
    data, offsets = flat_text(column)
    size = np.diff(offsets)
    return *suffix_sort(data, offsets[:-1], size, group), size


def repeated_spans(group: np.ndarray, doc: np.ndarray, before: pa.Array, suffix: pa.Array, span: int, core: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For items of ascending groups, each an anchor of `core` bytes with the bytes before it (reversed) and the suffix that
    starts at it: the smallest and largest number of bytes before the anchor at which a string of `span` bytes around it
    is a repeat; -1 if none is."""
    n = len(group)
    left_order, left_shared, left_size = _sorted(before, group)
    right_order, right_shared, right_size = _sorted(suffix, group)
    start = np.diff(group, prepend=group[:1] - 1) != 0
    least, most = np.full(n, -1), np.full(n, -1)

    def classes(order, shared, length):
        label = np.empty(n, np.int64)
        label[order] = np.cumsum(start | (shared < length))
        return label

    for s in range(span - core + 1):
        able = np.flatnonzero((left_size >= s) & (right_size >= span - s))
        if len(able) < 2:
            continue
        key = classes(left_order, left_shared, s)[able] * (n + 1) + classes(right_order, right_shared, span - s)[able]
        by = np.lexsort((doc[able], key))
        key, item = key[by], able[by]
        new = np.diff(key, prepend=key[0] - 1) != 0
        low = doc[item][np.flatnonzero(new)]
        repeat = item[doc[item] > low[np.cumsum(new) - 1]]
        least[repeat] = np.where(least[repeat] < 0, s, least[repeat])
        most[repeat] = s
    return least, most


def _spans_at(table: pa.Table, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    """(k, doc_id, lo, hi): `before` bytes left of each place of rows `at` to `after` bytes right of it."""
    some = table.take(pa.array(at))
    places = some.column("places").combine_chunks()
    n = np.diff(places.offsets.to_numpy())
    row, place = np.repeat(np.arange(len(at)), n), places.flatten().to_numpy()
    lo, hi = (place - before[row]).astype(np.int32), (place + after[row]).astype(np.int32)
    taken = [some.column(c).combine_chunks().take(pa.array(row)) for c in ("k", "doc_id")]
    return pa.RecordBatch.from_arrays([*taken, pa.array(lo), pa.array(hi)], ["k", "doc_id", "lo", "hi"])


def _groups(table: pa.Table) -> np.ndarray:
    h = table.column("h").to_numpy()
    return np.cumsum(np.diff(h, prepend=h[:1]) != 0)


def _solved_contexts(items: DataFrame, span: int, most_at_once: int = 20_000) -> DataFrame:
    """(k, doc_id, lo, hi): bytes to remove around anchors. Items of one h are in one task, next to each other."""

    def solve(table):
        group = _groups(table)
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        table, group = table.take(pa.array(several)), group[several]
        if table.num_rows:
            before, suffix = (table.column(c).combine_chunks() for c in ("before", "suffix"))
            least, most = repeated_spans(group, table.column("doc_id").to_numpy(), before, suffix, span)
            hit = np.flatnonzero(most >= 0)
            yield _spans_at(table, hit, most[hit], span - least[hit])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= most_at_once:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                whole = int(np.searchsorted(h, h[-1]))  # the last h may go on
                yield from solve(table.slice(0, whole)) if whole else ()
                held = table.slice(whole).to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    return items.mapInArrow(run, "k long, doc_id long, lo int, hi int")


def _solved_equal(items: DataFrame, most_at_once: int = 1 << 21) -> DataFrame:
    """(k, doc_id, lo, hi): whole suffixes that an earlier document has. Items of one h are in one task, by doc_id; so of
    those seen already one for each distinct suffix stands for them, and a task holds about `most_at_once` bytes however
    many there are."""

    def solve(table, known):
        group = _groups(table)
        order, shared, size = _sorted(table.column("suffix").combine_chunks(), group)
        equal = (shared == size[order]) & np.append(False, size[order][1:] == size[order][:-1]) & np.append(False, group[1:] == group[:-1])
        label = np.empty(len(group), np.int64)
        label[order] = np.cumsum(~equal) - 1
        doc = table.column("doc_id").to_numpy()
        low = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, label, doc)
        repeat = (doc > low[label]) & (np.arange(len(doc)) >= known)
        rep = np.unique(label, return_index=True)[1]
        keep = np.sort(rep[group[rep] == group[-1]])  # one of each distinct suffix of the last h, which may go on
        hit = np.flatnonzero(repeat)
        reach = table.column("reach").to_numpy()[hit]
        return _spans_at(table, hit, np.zeros(len(hit), np.int64), reach), table.take(pa.array(keep))

    def run(batches):
        held, known, size = [], 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("suffix"))).as_py() or 0
                if size >= most_at_once:
                    spans, kept = solve(pa.Table.from_batches(held), known)
                    yield spans
                    held, known, size = kept.to_batches(), kept.num_rows, 0
        if held:
            yield solve(pa.Table.from_batches(held), known)[0]

    return items.mapInArrow(run, "k long, doc_id long, lo int, hi int")


def _met(items: DataFrame, n: int) -> DataFrame:
    """Items of one h in one task, by doc_id."""
    return items.repartition(n, "h").sortWithinPartitions("h", "doc_id")


def _found(docs: DataFrame, span: int, id_col: str, text_col: str, hot: int, digest_size: int) -> tuple[DataFrame, DataFrame]:
    """(the bucketed text table, spans): the table has the columns of `docs`, k, doc_id and text; spans has one row a key."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"vectide_texts_{uuid.uuid4().hex}"
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    keyed = keyed.withColumn("k", F.xxhash64("doc_id", "text"))
    keyed.repartition(n, "k").write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/vectide/{name}").bucketBy(n, "k").saveAsTable(name)
    table = spark.table(name)

    segments = materialize(_segments(table, span, 256, digest_size), "segments")
    several = segments.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h")
    copies = _solved_equal(_met(_segment_suffixes(table, segments.join(several, "h"), span), n))
    told = segments.where("h is null").select("k", "doc_id", "lo", (F.col("hi") + span - 1).alias("hi"))
    done = materialize(told.unionByName(copies), "repeated-segments")

    size = segments.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0))).first()[0]
    buckets = max(n, -(-size // BUCKET_BYTES))
    by_key = done.groupBy("k").agg(F.collect_list(F.struct("doc_id", "lo", (F.col("hi") - span + 1).alias("hi"))).alias("done"))
    open_docs = table.select("k", "doc_id", "text").join(by_key, "k", "left")
    packed = _anchors(open_docs, span, buckets).repartition(buckets, "bucket")
    shared = _shared_anchors(packed, n)
    contexts = materialize(_contexts(table.select("k", "doc_id", "text").join(shared, "k").where("doc_id is not null"), span, digest_size), "contexts")

    counts = materialize(contexts.where("h is not null").groupBy("h").count().where(F.col("count") > hot).select("h", F.lit(True).alias("hot")), "hot-grams")
    marked = contexts.where("h is not null").drop("lo", "hi").join(counts, "h", "left")
    solved = _solved_contexts(_met(marked.where("hot is null").drop("hot"), n), span)
    gone = [contexts.where("h is null").select("k", "doc_id", "lo", "hi")]
    if not counts.isEmpty():
        strings = materialize(_strings_of_hot(marked.where("hot"), span, digest_size), "hot-strings")
        gone.append(strings.where("h is null").select("k", "doc_id", "lo", "hi"))
        gone.append(_solved_equal(_met(strings.where("h is not null").select("h", "k", "doc_id", "suffix", "places", F.lit(span).alias("reach")), n)))
    spans = done.unionByName(solved)
    for more in gone:
        spans = spans.unionByName(more)
    return table, spans.groupBy("k").agg(F.collect_list(F.struct("doc_id", "lo", "hi")).alias("spans"))


def _covered(n: int, doc, spans) -> np.ndarray:
    """True for each byte that goes."""
    change = np.zeros(n + 1, np.int32)
    for s in spans or ():
        if s["doc_id"] == doc:
            change[s["lo"]] += 1
            change[min(s["hi"], n)] -= 1
    return np.cumsum(change[:-1]) > 0


def repeats(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, digest_size: int = 8) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of `docs`.

    Null texts are empty; texts shorter than `span` lose nothing. Rows that share a doc_id do not count as earlier for
    each other. A row without doc_id is neither earlier nor later than any: it loses nothing.
    """
    table, spans = _found(docs.select(id_col, text_col), span, id_col, text_col, hot, digest_size)

    def run(batches):
        for part in text_slices(batches):
            data, offsets = flat_text(part.column("text"))
            out = []
            for i, (doc, some) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("spans").to_pylist())):
                text = data[offsets[i] : offsets[i + 1]]
                gone = _covered(len(text), doc, some)
                runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                out.append((doc, len(text), int(gone.sum()), runs, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = table.select("k", "doc_id", "text").join(spans, "k", "left").drop("k")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, digest_size: int = 8) -> DataFrame:
    """`docs` with repeated bytes cut from the text; where a run begins or ends inside a character, that character stays.

    Rows, other columns and their order are kept; a text of which nothing is left becomes empty, a null text stays null.
    """
    table, spans = _found(docs, span, id_col, text_col, hot, digest_size)

    def run(batches):
        for part in text_slices(batches):
            data, offsets = flat_text(part.column("text"))
            out = []
            for i, (doc, old, some) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").is_valid().to_pylist(), part.column("spans").to_pylist())):
                text = data[offsets[i] : offsets[i + 1]]
                if not some:
                    out.append(text.tobytes() if old else None)
                    continue
                gone = _covered(len(text), doc, some)
                head = np.flatnonzero((text & 0xC0) != 0x80)
                whole = np.logical_and.reduceat(gone, head) if len(head) else np.zeros(0, bool)
                gone = np.repeat(whole, np.diff(np.append(head, len(text))))
                out.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out, pa.binary()).cast(pa.string())], ["row", "text"])

    joined = table.select("k", "doc_id", "row", "text").join(spans, "k", "left").drop("k")
    kind = table.schema["row"].dataType.simpleString()
    cut = joined.mapInArrow(run, f"row {kind}, text string")
    return cut.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
