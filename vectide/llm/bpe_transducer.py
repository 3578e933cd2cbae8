"""Token counts (and ids) of byte-level BPE by finite-state transducers.

Two deterministic machines do the library's work:

* the *splitter* reads one symbol per character (its class) and annotates transitions with "a word starts here /
  one character ago". It has eleven states, so a chunk of text is a map from states to states. All chunks compute
  their maps in lock step, a parallel prefix scan composes the maps, and a second pass runs each chunk from its now
  known entry state.
* the *merger* reads the bytes of a word and annotates every transition with the change in the number of tokens that
  the bytes so far encode to. It is determinised lazily: a state is the longest suffix that some token may still
  extend, with the last token and relative count at each position of that suffix. Words reset it, so the map of a
  chunk that starts at a word start is constant. Longer words are cut into chunks as well: a chunk's map is evaluated
  for the entry states that its predecessor hands on, and runs from different states soon meet. The table is bounded;
  when full it is flushed and rebuilt from the states in use.

Both rest on a property of BPE: an encoding is the canonical one exactly if every adjacent pair of its tokens is what
the merges make of that pair's bytes, so the last token of every prefix follows from those of shorter prefixes.
"""

from __future__ import annotations

import json
import marshal
import re
from bisect import bisect_left
from itertools import takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import flat_text, small_batches, text_slices

# Character classes of the splitter; contraction letters have their own.
STMD, RV, E, L_LETTER, LETTER, NUMBER, OTHER, QUOTE, SPACE, BLANK, END = range(11)
LETTERS = (STMD, RV, E, L_LETTER, LETTER)
# States: nothing open; a run of letters, numbers, others; a lone quote; quote and r or v; quote and l;
# one blank that is a space or not; several blanks of which the last is a space or not.
(S_NEW, S_LETTER, S_NUMBER, S_OTHER, S_QUOTE, S_QUOTE_RV, S_QUOTE_L, S_SPACE, S_BLANK, S_SPACES, S_BLANKS) = range(11)
HERE, BEFORE = 1, 2


def _begin(c: int) -> int:
    """The state after a word's first character."""
    if c in LETTERS:
        return S_LETTER
    return {NUMBER: S_NUMBER, OTHER: S_OTHER, QUOTE: S_QUOTE, SPACE: S_SPACE, BLANK: S_BLANK}[c]


def _move(s: int, c: int) -> tuple[int, int]:
    """(next state, word starts: HERE, BEFORE the previous character, or both)."""
    blank = c in (SPACE, BLANK)
    if c == END:
        return S_NEW, BEFORE if s in (S_QUOTE_RV, S_QUOTE_L) else 0
    if s == S_QUOTE:
        if c in (OTHER, QUOTE):
            return S_OTHER, 0
        if c in (STMD, RV, L_LETTER):
            return {STMD: S_NEW, RV: S_QUOTE_RV, L_LETTER: S_QUOTE_L}[c], 0
    if s in (S_QUOTE_RV, S_QUOTE_L):
        if c == (E if s == S_QUOTE_RV else L_LETTER):
            return S_NEW, 0
        after, start = _move(S_LETTER, c)
        return after, start | BEFORE
    if s == S_LETTER and c in LETTERS or s == S_NUMBER and c == NUMBER or s == S_OTHER and c in (OTHER, QUOTE):
        return s, 0
    if s in (S_SPACE, S_BLANK, S_SPACES, S_BLANKS):
        if blank:
            return (S_SPACES if c == SPACE else S_BLANKS), 0
        before = BEFORE if s in (S_SPACES, S_BLANKS) else 0
        if s in (S_SPACE, S_SPACES):
            return (S_OTHER if c == QUOTE else _begin(c)), before
        return _begin(c), before | HERE
    return _begin(c), HERE


NEXT = np.array([[_move(s, c)[0] for s in range(11)] for c in range(11)], np.uint8).ravel()
STARTS = np.array([[_move(s, c)[1] for s in range(11)] for c in range(11)], np.uint8).ravel()
NEXT_TABLE = NEXT.tobytes().ljust(256, b"\0")


def load_spec(path: str) -> dict:
    """Read a byte-level BPE tokenizer file on the driver; the result (about 3 MB, fixed by the vocabulary) is broadcast.

    Character classes are asked of the tokenizers library itself, so that both see the same Unicode version.
    """
    from tokenizers import Regex, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    as_bytes = {t: bytes(byte_of[c] for c in t) for t in model["vocab"]}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    classes = np.full(0x110000, OTHER, np.uint8)
    splits = [(pre_tokenizers.Split(Regex(f"[^{pattern}]+"), "removed"), code) for pattern, code in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK))]
    for low in range(0, 0x110000, 1 << 13):  # a part at a time: the library needs some hundred bytes a character
        if not 0xD800 <= low < 0xE000:
            part = "".join(map(chr, range(low, low + (1 << 13)))) if low != 0xC000 else "".join(map(chr, range(low, 0xD800)))
            for split, code in splits:
                for _, (a, b) in split.pre_tokenize_str(part):
                    classes[low + a : low + b] = code
    for letters, code in (("stmd", STMD), ("rv", RV), ("e", E), ("l", L_LETTER), ("'", QUOTE), (" ", SPACE)):
        classes[[ord(c) for c in letters]] = code
    return {
        "name": path,
        "vocab": {as_bytes[t]: i for t, i in model["vocab"].items()},
        "merges": {(model["vocab"][a], model["vocab"][b]): (rank, model["vocab"][a + b]) for rank, (a, b) in enumerate(pairs)},
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "classes": classes,
    }


def word_starts(classes: np.ndarray, width: int = 256) -> np.ndarray:
    """Run the splitter over a stream of classes; True where a word starts (never at END)."""
    n = len(classes)
    lanes = max(1, -(-n // width))
    grid = np.full(lanes * width, END, np.uint8)
    grid[:n] = classes
    steps = np.ascontiguousarray(grid.reshape(lanes, width).T) * np.uint8(11)
    maps = np.tile(np.arange(11, dtype=np.uint8), (lanes, 1))
    for row in steps:  # bytes.translate is the fastest table lookup for single bytes
        maps = np.frombuffer((row[:, None] + maps).tobytes().translate(NEXT_TABLE), np.uint8).reshape(lanes, 11)
    maps = maps.copy()
    reach = 1
    while reach < lanes:  # inclusive scan of map composition
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.zeros(lanes, np.uint8)
    state[1:] = maps[:-1, S_NEW]
    marks = np.empty((width, lanes), np.uint8)
    for t, row in enumerate(steps):
        key = row + state
        marks[t] = STARTS[key]
        state = NEXT[key]
    flat = marks.T.ravel()[:n]
    starts = (flat & HERE).astype(bool)
    starts[:-1] |= (flat[1:] & BEFORE).astype(bool)
    starts[classes == END] = False
    return starts


class Merger:
    """The lazily determinised merge transducer of one vocabulary.

    Every Python worker of an executor holds one, so it is kept small: the table has a column for each byte that texts
    have held so far, grows in place by a few thousand states at a time, and states are held in packed form.
    """

    def __init__(self, spec: dict, max_states: int = 60_000):
        self.vocab, self.max_states, self.merges = spec["vocab"], max_states, spec["merges"]
        self.made = {i: (rank, *pair) for pair, (rank, i) in reversed(spec["merges"].items())}  # the first merge that makes it
        self.sorted = sorted(self.vocab)  # tokens with one beginning lie together
        self.made_tables = 0
        self.column, self.byte = np.full(256, -1, np.int16), []  # by byte, and the bytes by column
        self.length = np.zeros(max(self.vocab.values()) + 1, np.int32)
        for t, i in self.vocab.items():
            self.length[i] = len(t)
        self._clear()

    def _clear(self) -> None:
        self.made_tables += 1
        self.keys: list[bytes] = []
        self.index: dict[bytes, int] = {}
        self.same: dict[bytes, dict[int, int | None]] = {}
        self.stand: dict[tuple, int] = {}
        self.next = np.full((1024, len(self.byte)), -1, np.int32)
        self.emit = np.zeros((1024, len(self.byte)), np.int8)
        self.last = np.zeros(1024, np.int32)
        self._state((b"", ((-1, 0),)))

    def _state(self, key: tuple) -> int:
        packed = marshal.dumps(key, 2)  # version 2 has no references: equal keys are equal bytes
        s = self.index.get(packed)
        if s is None:
            s = self.index[packed] = len(self.keys)
            self.keys.append(packed)
            if s == len(self.next):
                for table in (self.next, self.emit, self.last):  # in place: a copy would hold both for a while
                    table.resize((s + 4096, *table.shape[1:]), refcheck=False)
                self.next[s:] = -1
            self.last[s] = key[1][-1][0]
        return s

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """The table's column of each byte; bytes not seen before get one."""
        new = np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0))
        if len(new):
            self.column[new] = np.arange(len(self.byte), len(self.byte) + len(new))
            self.byte += new.tolist()
            self.next = np.pad(self.next, ((0, 0), (0, len(new))), constant_values=-1)
            self.emit = np.pad(self.emit, ((0, 0), (0, len(new))))
        return self.column.astype(np.uint8)[data]

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b side by side.

        Undo the merges that made them, latest first, and look at the two pieces that face each other: had a merge of
        these come before the merge just undone, it would have joined them. At equal ranks the left one comes first.
        """
        before = 1 << 30
        while True:
            joined = self.merges.get((a, b))
            if joined is not None and joined[0] < before:
                return False
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_a is None and made_b is None:
                return True
            if made_b is None or made_a is not None and made_a[0] > made_b[0]:
                before, a = made_a[0], made_a[2]
            else:
                before, b = made_b[0] + 1, made_b[1]

    def _stands_for(self, last: int, begun: bytes) -> int | None:
        """A token that allows the same tokens to follow as `last` among those that go on from `begun`; None if none can."""
        known = self.same.setdefault(begun, {})
        if last in known:
            return known[last]
        lo = bisect_left(self.sorted, begun)
        lo += lo < len(self.sorted) and self.sorted[lo] == begun
        longer = list(takewhile(lambda t: t.startswith(begun), self.sorted[lo : lo + 41]))
        if len(longer) > 40:
            found = last
        else:
            able = tuple(i for i in map(self.vocab.get, longer) if last < 0 or self.fits(last, i))
            found = self.stand.setdefault((begun, able), last) if able else None
        known[last] = found
        return found

    def _build(self, s: int, column: int) -> None:
        tail, history = marshal.loads(self.keys[s])
        tail += bytes([self.byte[column]])
        for k in range(len(tail)):  # longest first
            token = self.vocab.get(tail[k:])
            if token is not None and history[k] and (history[k][0] < 0 or self.fits(history[k][0], token)):
                break
        count = history[k][1] + 1
        self.emit[s, column] = count - history[-1][1]
        history = (*history, (token, count))
        n = len(tail)
        held = [token if k == n else history[k] and self._stands_for(history[k][0], tail[k:]) for k in range(n + 1)]
        k = next(k for k in range(n + 1) if held[k] is not None)
        after = self._state((tail[k:], tuple(None if held[j] is None else (held[j], history[j][1] - count) for j in range(k, n + 1))))
        self.next[s, column] = after

    def _step(self, data: np.ndarray, keep: np.ndarray, pos: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state and column, next state) of lanes that read the columns at `pos`; transitions not yet known are built."""
        width = len(self.byte)
        key = state & keep.take(pos, mode="clip")
        key *= width
        key += data.take(pos, mode="clip")
        after = self.next.ravel().take(key, mode="clip")
        if after.min() < 0:
            if len(self.keys) > self.max_states:
                used, where = np.unique(key // width, return_inverse=True)
                held = [marshal.loads(self.keys[s]) for s in used]
                self._clear()
                key = np.array([self._state(k) for k in held])[where] * width + key % width
            for k in np.unique(key[self.next.ravel()[key] < 0]).tolist():
                self._build(*divmod(k, width))
            after = self.next.ravel()[key]
        return key, after

    def run(self, data: np.ndarray, starts: np.ndarray, tokens: bool, width: int = 256, split: bool = True) -> np.ndarray:
        """For each byte the last token of its word so far if `tokens`, else the change of its word's token count.

        Lanes begin at word starts. A word longer than two lanes is cut into chunks whose entry states are not known
        yet: each is first run from the start state, then from what the chunk before it ended in, all such chunks at
        once, until it meets the states of its earlier run; the map of a chunk is known from there on. Rounds end when
        no chunk's entry has changed, most often after the first.
        """
        return self._run(self._columns(data), starts, tokens, width, split)

    def _run(self, data: np.ndarray, starts: np.ndarray, tokens: bool, width: int, split: bool) -> np.ndarray:
        out = np.zeros(len(data), np.int32 if tokens else np.int8)
        at = np.flatnonzero(starts)
        if not len(at):
            return out
        cuts = np.unique(at[np.minimum(np.searchsorted(at, np.arange(0, len(data), width)), len(at) - 1)])
        size = np.diff(np.append(cuts, len(data)))
        long = np.flatnonzero(size > 2 * width) if split else cuts[:0]
        inner = np.concatenate([cuts[:0], *[np.arange(cuts[i] + width, cuts[i] + size[i], width) for i in long]])
        if len(inner):
            cuts = np.sort(np.concatenate([cuts, inner]))
            size = np.diff(np.append(cuts, len(data)))
        states = np.empty(len(data), np.int32) if len(inner) else None
        order = np.argsort(-size, kind="stable")
        pos, size = cuts[order], size[order]
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # lanes longer than t
        keep = np.where(starts, np.int8(0), np.int8(-1))
        state = np.zeros(len(pos), np.int64)
        made = self.made_tables
        for n in active:
            pos, state = pos[:n], state[:n]
            key, after = self._step(data, keep, pos, state)
            out[pos] = self.last.take(after, mode="clip") if tokens else self.emit.ravel().take(key, mode="clip")
            if states is not None:
                states[pos] = after
            state = after.astype(np.int64)
            pos += 1
        if states is None:
            return out
        entry, end = np.zeros(len(inner), np.int32), np.append(cuts, len(data))[np.searchsorted(cuts, inner) + 1]
        while self.made_tables == made:
            before = states[inner - 1]
            lane = np.flatnonzero(before != entry)
            if not len(lane):
                return out
            entry = before
            pos, state = inner[lane], before[lane].astype(np.int64)
            while len(lane):
                key, after = self._step(data, keep, pos, state)
                if self.made_tables != made:
                    break
                going = states[pos] != after
                out[pos] = self.last.take(after, mode="clip") if tokens else self.emit.ravel().take(key, mode="clip")
                states[pos] = after
                pos += 1
                going &= pos < end[lane]
                lane, pos, state = lane[going], pos[going], after[going].astype(np.int64)
        return self._run(data, starts, tokens, width, split=False)  # the table was flushed, and with it the states' numbers


_mergers: dict[str, Merger] = {}


class Tokenizer:
    """Counts and ids for batches of texts. One per Python worker and vocabulary; its tables stay warm between tasks."""

    def __init__(self, spec: dict):
        self.spec = spec
        name = spec["name"]
        if name not in _mergers:
            _mergers[name] = Merger(spec)
        self.merger = _mergers[name]
        special = sorted(spec["special"], key=len, reverse=True)
        self.special = re.compile(b"(" + b"|".join(re.escape(s.encode()) for s in special) + b")") if special else None
        self.special_id = {s.encode(): i for s, i in spec["special"].items()}

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Bytes without special strings, the offsets of the parts between them, and (part before it, row, id) of each."""
        raw = data.tobytes()
        if not self.special or not self.special.search(raw):
            return data, offsets, []
        parts, found = [], []
        for row in range(len(offsets) - 1):
            for k, piece in enumerate(self.special.split(raw[offsets[row] : offsets[row + 1]])):
                if k % 2:
                    found.append((len(parts) - 1, row, self.special_id[piece]))
                else:
                    parts.append(piece)
        joined = np.frombuffer(b"".join(parts), np.uint8)
        return joined, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), found

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Word starts by byte."""
        first = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
        if (data < 128).all():
            points = data
        else:
            points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        classes = self.spec["classes"][points]
        ends = np.searchsorted(first, offsets[1:])  # in characters
        stream = np.insert(classes, ends, END)
        marks = word_starts(stream)
        real = np.ones(len(stream), bool)
        real[ends + np.arange(len(ends))] = False
        starts = np.zeros(len(data), bool)
        starts[first] = marks[real]
        inside = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[inside] = True
        return starts

    def counts(self, column: pa.Array) -> np.ndarray:
        data, offsets = flat_text(column)
        data, bounds, found = self._parts(data, offsets)
        change = self.merger.run(data, self._starts(data, bounds), tokens=False)
        total = np.zeros(len(change) + 1, np.int64)
        np.cumsum(change, out=total[1:])
        by_part = total[bounds[1:]] - total[bounds[:-1]]
        if not found:
            return by_part
        rows = len(offsets) - 1
        specials = np.bincount([row for _, row, _ in found], minlength=rows)
        return np.bincount(np.repeat(np.arange(rows), specials + 1), weights=by_part, minlength=rows).astype(np.int64) + specials

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch, and the offset at which each row's ids start (one more at the end)."""
        data, offsets = flat_text(column)
        data, bounds, found = self._parts(data, offsets)
        starts = self._starts(data, bounds)
        last = self.merger.run(data, starts, tokens=True)
        begin = np.flatnonzero(starts)
        at = np.append(begin[1:], len(data)) - 1 if len(begin) else begin
        token = np.full(len(data), -1, np.int32)
        while len(at):  # walk back from the ends of all words at once
            t = last[at]
            token[at] = t
            at = at - self.merger.length[t]
            more = at >= begin
            at, begin = at[more], begin[more]
        at = np.flatnonzero(token >= 0)
        before = np.searchsorted(at, bounds)
        ids = token[at]
        if not found:
            return ids, before
        ids = np.insert(ids, [before[part + 1] for part, _, _ in found], [i for _, _, i in found])
        specials = np.bincount([row for _, row, _ in found], minlength=len(offsets) - 1)
        parts_end = np.cumsum(specials + 1)
        return ids, np.concatenate([[0], before[parts_end] + np.cumsum(specials)])


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, as the tokenizers library counts them.

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and null ids give a row each. Other columns are
    dropped. Special strings inside texts count as one token (the library's default). One narrow pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(tokenizer_path))

    def run(batches):
        tokenizer = Tokenizer(spec.value)
        for part in text_slices(batches, 1 << 20):
            text = part.column("text")
            n = tokenizer.counts(text)
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
