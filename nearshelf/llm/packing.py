"""Token ids of documents in sequences of one length, by multiway differencing.

What a document has beyond whole sequences goes into groups of some windows. In a group
the largest differences meet first: two partial partitions are merged so that the fullest
windows of one take the emptiest of the other, until one partition is left.
A share of a group is cut into grains of a sixteenth of a sequence, half of that, and so on
to single ids, which even the windows out at the end.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearshelf.llm.batches import slices
from nearshelf.llm.encoding import STOPS, Numbers
from nearshelf.llm.worker import kept

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Text encoded at a time, in bytes, and distinct pieces of text that a worker remembers.
CHUNK, REMEMBERED = 4_000_000, 2_000_000
#: Strings encoded by one call.
TOGETHER = 256
#: The largest grain is this part of a sequence.
LARGEST_GRAIN = 16
#: Sequence numbers of a partition.
NUMBERS = 1 << 40


class WordIds:
    """Ids of a tokenizer that drops white space and never joins across it: each distinct piece between blanks is encoded once.

    Letters and the stops after them have ids of their own, so these are remembered apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.strings, self.pieces = Numbers(), Numbers()
        self.strings.add(Numbers.codes_of([""]), np.zeros(1, np.int32))
        self.ids, self.sizes = array("I"), array("i", [0])
        self.table = np.zeros((2, 0), np.int32)

    def _learn(self, strings: list[str]) -> np.ndarray:
        first = len(self.sizes)
        for at in range(0, len(strings), TOGETHER):
            group = strings[at:at + TOGETHER]
            e = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            begins = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            ends = np.cumsum(np.fromiter((len(s) + 1 for s in group), np.int64, len(group)))
            self.sizes.extend(np.diff(np.searchsorted(begins, ends, "left"), prepend=0).tolist())
            self.ids.extend(e.ids)
        return np.arange(first, len(self.sizes), dtype=np.int32)

    def _numbered(self, strings: list[str]) -> np.ndarray:
        codes = Numbers.codes_of(strings)
        out = self.strings.get(codes)
        missing = np.flatnonzero(out < 0)
        new, first, place = np.unique(codes[missing], return_index=True, return_inverse=True)
        if len(new):
            numbers = self._learn([strings[k] for k in missing[first].tolist()])
            self.strings.add(new, numbers)
            out[missing] = numbers[place]
        return out.astype(np.int32)

    def encode(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with end_id after it, and the number of ids of each text."""
        import pyarrow.compute as pc

        if self.table.shape[1] > REMEMBERED:
            self._forget()
        split = pc.ascii_split_whitespace(texts)
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        del split, texts
        pieces = coded.dictionary.to_pylist()
        codes = Numbers.codes_of(pieces)
        row = self.pieces.get(codes)
        new = np.flatnonzero(row < 0)
        words, stops = [], []
        for piece in map(pieces.__getitem__, new.tolist()):
            word = piece.rstrip(STOPS)
            words.append(word if word.isalpha() else piece)
            stops.append(piece[len(words[-1]):])
        found = np.stack((self._numbered(words), self._numbered(stops)))
        row[new] = np.arange(self.table.shape[1], self.table.shape[1] + len(new))
        self.table = np.concatenate((self.table, found), axis=1)
        self.pieces.add(codes[new], row[new].astype(np.int32))
        # The end is one more string, after each text's.
        end = len(self.sizes)
        size = np.append(np.array(self.sizes, np.int64), 1)
        start = np.append(np.cumsum(size[:-1]) - size[:-1], len(self.ids))
        which = self.table[:, row[coded.indices.to_numpy()]].T.ravel()
        which = np.insert(which, 2 * np.cumsum(counts), end)
        sizes = size[which]
        after = np.cumsum(sizes)
        at = np.repeat(start[which] - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)
        ids = np.append(np.frombuffer(self.ids, np.uint32), np.uint32(end_id))[at]
        ends = after[2 * np.cumsum(counts) + np.arange(len(counts))]
        return ids, np.diff(ends, prepend=0)


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each item, by merging the two partitions of largest difference again and again."""
    heap, nodes = [], []
    for n, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-size, n, sums))
        nodes.append(None)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, first = heapq.heappop(heap)
        _, b, second = heapq.heappop(heap)
        sums = first + second[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), len(nodes), sums))
        nodes.append((a, b, order))
    window = np.zeros(len(sizes), np.int64)
    if not nodes:
        return window
    labels = {len(nodes) - 1: np.arange(windows)}
    for n in range(len(nodes) - 1, -1, -1):
        label = labels.pop(n)
        if nodes[n] is None:
            window[n] = label[0]
            continue
        a, b, order = nodes[n]
        labels[a], labels[b] = np.empty_like(label), np.empty_like(label)
        labels[a][order] = label
        labels[b][windows - 1 - order] = label
    return window


def _cut(items: list, wanted: int, capacity: int) -> list:
    """items (doc, start, ids, ...), the largest cut into grains until these hold the wanted number of ids."""
    sizes = [1]
    while 2 * sizes[0] <= capacity // LARGEST_GRAIN:
        sizes.insert(0, 2 * sizes[0])
    sizes.append(1)
    out, grains = [], 0
    for item in sorted(items, key=lambda x: -len(x[2])):
        if grains >= wanted:
            out.append(item)
            continue
        doc, start, ids, total = item
        at, k = 0, 0
        while at < len(ids):
            size = sizes[k % len(sizes)]
            out.append((doc, start + at, ids[at:at + size], total))
            at, k = at + size, k + 1
        grains += len(ids)
    return out


def packed(items: list, capacity: int, share: int = 8) -> list[list]:
    """Windows of pieces of the items, none over capacity; one in share of the ids is cut into grains."""
    total = sum(len(x[2]) for x in items)
    windows = -(-total // capacity)
    if windows <= 1:
        return [items] if items else []
    items = _cut(items, total // share, capacity)
    sizes = [len(x[2]) for x in items]
    while True:
        window = differencing(sizes, windows)
        if np.bincount(window, sizes, windows).max() <= capacity:
            break
        windows += 1
    out: list[list] = [[] for _ in range(windows)]
    for item, w in zip(items, window.tolist()):
        out[w].append(item)
    return [x for x in out if x]


def _pack(path: str, end_id: int, capacity: int, windows: int):
    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = kept(("words", path), lambda: WordIds(path))
        number = TaskContext.get().partitionId() * NUMBERS
        waiting, held = [], 0

        def rows(sequences: list[list]):
            nonlocal number
            columns = [[], [], [], [], [], [], []]
            for pieces in sequences:
                offset = 0
                for doc, start, ids, total in pieces:
                    for column, value in zip(columns, (doc, start, len(ids), ids.tobytes(), total, number, offset)):
                        column.append(value)
                    offset += len(ids)
                number += 1
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in slices(batches, size=CHUNK):
            found, sizes = encoder.encode(batch.column("text").cast(pa.large_string()), end_id)
            at, whole, ready = 0, [], []
            for doc, n in zip(batch.column("doc_id").to_pylist(), sizes.tolist()):
                ids, at = found[at:at + n], at + n
                full = n - n % capacity
                whole.extend([(doc, a, ids[a:a + capacity], n)] for a in range(0, full, capacity))
                if full < n:
                    waiting.append((doc, full, ids[full:], n))
                    held += n - full
                if held >= windows * capacity:
                    # The last one gives only what fills the windows.
                    doc, start, ids, total = waiting.pop()
                    here = len(ids) - (held - windows * capacity)
                    ready.extend(packed([*waiting, (doc, start, ids[:here], total)], capacity))
                    waiting = [(doc, start + here, ids[here:], total)] if here < len(ids) else []
                    held -= windows * capacity
            if whole or ready:
                yield rows(whole + ready)
            # Copies, so that the ids of this slice can go.
            waiting = [(doc, start, ids.copy(), total) for doc, start, ids, total in waiting]
        if waiting:
            yield rows(_last(waiting, held, capacity))

    return pack


def _last(items: list, held: int, capacity: int) -> list[list]:
    """What is left at a partition's end: full windows, and the rest in sequences that are powers of two long."""
    sequences, room, rest = [], held - held % capacity, held % capacity
    front = []
    while room:
        doc, start, ids, total = items.pop(0)
        front.append((doc, start, ids[:room], total))
        if len(ids) > room:
            items.insert(0, (doc, start + room, ids[room:], total))
        room -= len(front[-1][2])
    sequences.extend(packed(front, capacity))
    for bit in range(rest.bit_length() - 1, -1, -1):
        room = rest & 1 << bit
        pieces = []
        while room:
            doc, start, ids, total = items.pop(0)
            pieces.append((doc, start, ids[:room], total))
            if len(ids) > room:
                items.insert(0, (doc, start + room, ids[room:], total))
            room -= len(pieces[-1][2])
        if pieces:
            sequences.append(pieces)
    return sequences


def pack_documents(docs: DataFrame, *, tokenizer_path: str, end_id: int = 1, capacity: int = 2_048, windows: int = 64,
                   text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset of every piece of every document.

    A document is the ids of its whole text and end_id; ids holds a piece's as little-endian
    unsigned 32-bit numbers. Whole sequences of a document stand alone; what is left is
    dealt to groups of windows sequences by differencing, and the last group of a partition
    ends in sequences that are powers of two long, which need no padding. Where a window would
    pass capacity, the group gets one more. Null texts count as empty: one piece, the
    end. Rows without doc_id, repeated rows and rows with one doc_id are documents of their own; other
    columns are not read. A very long text is encoded on its own. No row, no piece.

    Spark's partitions are packed each by itself, in the order of their rows; give a scan or a
    written table, whose order is the same when a lost task is run again.
    tokenizer_path names a file that every worker can open.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_pack(tokenizer_path, end_id, capacity, windows), PIECES)
