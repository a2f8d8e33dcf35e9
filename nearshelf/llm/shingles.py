"""Word shingles of texts as 64-bit numbers, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts, width: int) -> Iterator[np.ndarray]:
    """The sorted set of each text's shingles of width words, A-Z lower-cased; of a text with
    fewer words the one shingle of all, of one without words (or null) none."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    before = np.concatenate(([0], np.cumsum(some)))
    cut = np.concatenate(([0], before[ends]))
    coded = flat.dictionary_encode()
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = codes[coded.indices.to_numpy()[some]] if len(codes) else np.empty(0, np.uint64)
    n = max(0, len(words) - width + 1)
    whole = np.full(n, width, np.uint64)
    for k in range(width):
        whole += words[k:k + n] * _ODD[k]
    whole = mixed(whole)
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if y - x >= width:
            yield np.unique(whole[x:y - width + 1])
        elif y > x:
            yield mixed(np.array([y - x], np.uint64) + (words[x:y] * _ODD[:y - x]).sum(dtype=np.uint64))
        else:
            yield np.empty(0, np.uint64)
