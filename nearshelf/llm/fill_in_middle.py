"""Texts rearranged for filling in the middle, cut at word boundaries found through a learned index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearshelf.llm.batches import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Boundaries that one line is tried on first, and how far a line may be off: what one signed byte holds.
SPAN, ERROR = 1024, 127
FORMED = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class RankIndex:
    """Rising offsets as pieces of lines and one byte each: rank to offset.

    A line runs through the first and last offset of its span; a span in which an offset
    is further than ERROR from the line is halved. Lines are whole-number arithmetic, so
    predicted offset plus stored residual is the offset itself.
    """

    def __init__(self, offsets: np.ndarray):
        offsets = np.asarray(offsets, np.int64)
        self.residuals = np.zeros(len(offsets), np.int8)
        first = np.arange(0, len(offsets), SPAN)
        size = np.minimum(SPAN, len(offsets) - first)
        done = []
        while len(first):
            base, rise = offsets[first], offsets[first + size - 1] - offsets[first]
            before = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(before, size)
            at = np.repeat(first, size) + step
            off = offsets[at] - self._line(np.repeat(base, size), np.repeat(rise, size), np.repeat(size, size), step)
            fits = np.maximum.reduceat(np.abs(off), before) <= ERROR
            inside = np.repeat(fits, size)
            self.residuals[at[inside]] = off[inside]
            done.append(np.stack((first, base, rise, size))[:, fits])
            first, size = first[~fits], size[~fits]
            half = (size + 1) // 2
            first, size = np.concatenate((first, first + half)), np.concatenate((half, size - half))
        lines = np.concatenate(done, axis=1) if done else np.zeros((4, 0), np.int64)
        self.first, self.base, self.rise, self.size = lines[:, np.argsort(lines[0])]

    @staticmethod
    def _line(base, rise, size, step):
        return base + rise * step // np.maximum(size - 1, 1)

    def __getitem__(self, ranks: np.ndarray) -> np.ndarray:
        line = np.searchsorted(self.first, ranks, "right") - 1
        return self._line(self.base[line], self.rise[line], self.size[line], ranks - self.first[line]) + self.residuals[ranks]


def boundaries(texts) -> tuple[np.ndarray, np.ndarray]:
    """Code point offsets at which tokens of texts (a large string array without nulls), laid end to end, begin,
    then the end of all; and the number of each text's first token, then that of all tokens.

    A token is a run of A-Z and a-z or one other code point.
    """
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    point = (raw & 0xC0) != 0x80
    letter = _LETTER[raw]
    begins = point.copy()
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[ends[:-1][ends[:-1] < len(raw)]] = True
    where = np.flatnonzero(begins)
    points = np.cumsum(point)
    starts = np.append(points[where] - 1, points[-1] if len(raw) else 0)
    return starts, np.searchsorted(where, ends)


def _draws(seed: int, doc_id) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def _form(seed: int, plain_percent: int, spm_percent: int):
    def form(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            texts = batch.column("text").cast(pa.large_string())
            starts, first = boundaries(texts)
            index = RankIndex(starts)
            del starts
            names = batch.column("doc_id").to_pylist()
            draws = np.array([_draws(seed, d) for d in names], np.int64).reshape(-1, 4)
            n = np.diff(first)
            cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
            begin = index[first[:-1]]
            prefix = index[first[:-1] + cuts[:, 0]] - begin
            middle = index[first[:-1] + cuts[:, 1]] - begin - prefix
            rows = []
            for text, a, m, (_, _, h3, h4) in zip(texts.to_pylist(), prefix.tolist(), middle.tolist(), draws.tolist()):
                if not text or h3 % 100 >= 100 - plain_percent or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append(("plain", None, None, text))
                    continue
                one, two, three = text[:a], text[a:a + m], text[a + m:]
                if h4 % 100 < spm_percent:
                    rows.append(("spm", a, m, f"{SUFFIX}{three}{PREFIX}{one}{MIDDLE}{two}"))
                else:
                    rows.append(("psm", a, m, f"{PREFIX}{one}{SUFFIX}{three}{MIDDLE}{two}"))
            forms, before, inside, outputs = zip(*rows)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n), pa.array(forms), pa.array(before, pa.int64()), pa.array(inside, pa.int64()),
                pa.array(outputs, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return form


def fill_in_middle(docs: DataFrame, *, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20,
                   text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every document.

    A text is cut before two of its n + 1 token boundaries, drawn from the sha256 of seed
    and doc_id. psm writes prefix, suffix, middle behind their marks, spm suffix, prefix, middle.
    plain, without cuts, are plain_percent of the documents, empty texts (null counts as
    empty) and texts that hold a mark. A row without doc_id is drawn as if its doc_id
    were empty; rows with one doc_id are drawn alike but cut by their own texts. Only the two
    columns are read. Each slice of the texts has an index of its own; a very long text is
    one slice. An empty table gives no row.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_form(seed, plain_percent, spm_percent), FORMED)


def restored(form: Column, output: Column) -> Column:
    """The text that a form and its output were made from. A mark cannot overlap another, so each stands once in an output."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
