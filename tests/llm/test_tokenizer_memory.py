"""What a tokenizer's tables take in each Python worker, and that they stay right when they grow, widen and are flushed."""

import tracemalloc

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from vectide.llm import bpe_transducer, registry, suffix_dedup


def texts(letters: str, n: int, seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return [" ".join("".join(rng.choice(list(letters), k)) for k in rng.integers(2, 12, 40)) for _ in range(n)]


def test_tables_take_little_memory():
    spec = bpe_transducer.load_spec(registry.tokenizer_path()) | {"name": "memory"}
    tokenizer = bpe_transducer.Tokenizer(spec)
    some = pa.array(texts("abcdefghijklmnopqrstuvwxyz", 600, 1))
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    tokenizer.ids(some)
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    states = len(tokenizer.merger.keys)
    assert states > 5_000
    assert held < 1_300 * states, held / states  # over 1,280 for the dense table alone when it had a column for every byte


def test_tables_grow_widen_and_are_flushed():
    spec = bpe_transducer.load_spec(registry.tokenizer_path()) | {"name": "flushed"}
    plain = Tokenizer.from_file(registry.tokenizer_path())
    tokenizer = bpe_transducer.Tokenizer(spec)
    tokenizer.merger.max_states = 3_000
    for seed, letters in enumerate(["", "abcdefgh", "abcdefghijklmnopqrstuvwxyzäöü", "東京都あいう0123456789", "abcXYZ😀éß,.;"]):
        some = texts(letters, 150, seed) + ["", "".join(texts(letters, 30, 9)).replace(" ", "")] if letters else ["", ""]
        expected = [plain.encode(x, add_special_tokens=False).ids for x in some]
        ids, bounds = tokenizer.ids(pa.array(some))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == expected
        assert tokenizer.counts(pa.array(some)).tolist() == [len(x) for x in expected]
    assert tokenizer.merger.made_tables > 2


def test_smallest_grams_by_parts():
    """Ranks by parts of a slice choose what one pass over all of it chooses."""
    h = np.random.default_rng(3).integers(0, 1 << 63, 700_000, dtype=np.uint64) << np.uint64(1)
    h[::3] = h[0]  # ties go to the smaller position
    width = 27
    is_open = np.random.default_rng(4).random(len(h)) < 0.5
    is_open[len(h) - width + 1 :] = False
    whole = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    expected = np.zeros(len(h), bool)
    expected[(suffix_dedup.sliding_min(whole, width)[np.flatnonzero(is_open)] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    assert np.array_equal(suffix_dedup.smallest_grams(h, is_open, width), expected)
