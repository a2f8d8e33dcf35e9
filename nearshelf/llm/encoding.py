"""Texts to token ids with a public tokenizer, each distinct piece of text encoded once.

A byte-level tokenizer of this kind never joins characters across a space that
stands alone between other characters, across a lone line break, or between a word
of letters and the stops that end it. So a text cut at those places has the ids of
its pieces, one after the other. Texts with any other white space, with control
characters, or with the string of an added token are encoded whole.
"""

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What makes a text go whole: other white space, control characters, gaps of two or more, gaps at an end.
UNUSUAL = (r"[\x00-\x09\x0B-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
           r"|[ \n][ \n]|\A[ \n]|[ \n]\z")
#: Marks in front of a piece: no space before it; a whole text, by its number; the end of a text.
START, WHOLE, END = "\x01", "\x02", "\x03"
STOPS = ".,;:!?"
#: Distinct pieces a worker remembers before it starts anew.
REMEMBERED = 3_000_000


class Numbers:
    """Strings by a 64-bit hash, without keeping them."""

    def __init__(self):
        self.codes, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    @staticmethod
    def codes_of(strings: list[str]) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings))

    def get(self, codes: np.ndarray) -> np.ndarray:
        """Values, -1 for unknown ones."""
        if not len(self.codes):
            return np.full(len(codes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.values[at], -1).astype(np.int64)

    def add(self, codes: np.ndarray, values: np.ndarray) -> None:
        """Codes that are not known yet, each once."""
        order = np.argsort(codes)
        at = np.searchsorted(self.codes, codes[order])
        self.codes, self.values = np.insert(self.codes, at, codes[order]), np.insert(self.values, at, values[order])


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A text that holds an added token's string goes whole, as the library looks for those strings first.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.unusual = "|".join([UNUSUAL, *map(re.escape, added)])
        # Pieces side by side could make such a string only if it holds a space.
        self.together = 1 if any(" " in x for x in added) else 256
        self._forget()

    def _forget(self) -> None:
        self.words, self.pieces = Numbers(), Numbers()  # a piece is a word and its stops
        self.ids, self.sizes = array("I"), array("i", [0])
        self.words.add(Numbers.codes_of([""]), np.zeros(1, np.int32))
        self.table = np.zeros((2, 0), np.int32)
        self._measure()

    def _measure(self) -> None:
        self.size = np.array(self.sizes, np.int32)
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size

    def whole(self, texts: list[str]) -> list:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, ids) -> int:
        self.sizes.append(len(ids))
        self.ids.extend(ids)
        return len(self.sizes) - 1

    def _learn(self, strings: list[str]) -> np.ndarray:
        """Numbers of new strings. Those that begin with a space keep their ids side by side, so one call encodes many."""
        spaced, other = [k for k, p in enumerate(strings) if p[0] == " "], [k for k, p in enumerate(strings) if p[0] != " "]
        first = len(self.sizes)
        for at in range(0, len(spaced), self.together):
            group = [strings[k] for k in spaced[at:at + self.together]]
            e = self.tokenizer.encode("".join(group), add_special_tokens=False)
            begins = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            cut = np.searchsorted(begins, np.cumsum(np.fromiter(map(len, group), np.int64, len(group))), "left")
            self.sizes.extend(np.diff(cut, prepend=0).tolist())
            self.ids.extend(e.ids)
        for ids in self.whole([strings[k] for k in other]):
            self._add(ids)
        out = np.empty(len(strings), np.int64)
        out[np.array(spaced + other, np.int64)] = np.arange(first, first + len(strings))
        return out

    def _numbered(self, strings: list[str]) -> np.ndarray:
        codes = Numbers.codes_of(strings)
        out = self.words.get(codes)
        new, place = np.unique(codes[out < 0], return_inverse=True)
        if len(new):
            missing = np.flatnonzero(out < 0)
            first = np.empty(len(new), np.int64)
            first[place[::-1]] = missing[::-1]
            numbers = self._learn([strings[k] for k in first.tolist()])
            self.words.add(new, numbers.astype(np.int32))
            out[missing] = numbers[place]
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with end_id after it, and the number of ids of each text."""
        if self.table.shape[1] > REMEMBERED:
            self._forget()
        odd = pc.match_substring_regex(texts, self.unusual).to_numpy(zero_copy_only=False).astype(bool)
        rows = np.flatnonzero(odd)
        special = {}
        for row, ids in zip(rows.tolist(), self.whole(texts.take(rows).to_pylist())):
            special[f"{START}{WHOLE}{row}"] = self._add(ids)
        if len(rows):
            marks = pa.array([f"{WHOLE}{r}" for r in rows.tolist()], texts.type)
            texts = pc.replace_with_mask(texts, pa.array(odd), marks)
        special[END] = self._add([end_id])
        special[START] = 0
        texts = pc.replace_substring(texts, "\n", f" \n {START}")
        marked = pc.binary_join_element_wise(*(pa.scalar(x, texts.type) if isinstance(x, str) else x for x in (START, texts, f" {END}", "")))
        split = pc.split_pattern(marked, " ")
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        del marked, split, texts
        pieces = coded.dictionary.to_pylist()
        codes = Numbers.codes_of(pieces)
        row = self.pieces.get(codes)
        new = np.flatnonzero(row < 0)
        words, stops, fixed = [], [], {}
        for n, piece in enumerate(map(pieces.__getitem__, new.tolist())):
            bare = piece.lstrip(START)
            word = bare.rstrip(STOPS)
            space = "" if piece[0] == START else " "
            if piece in special:
                fixed[n] = special[piece]
                word, bare = "", ""
            elif piece == "\n":
                word = bare
            elif word.isalpha():
                word = space + word
                bare = space + bare
            else:
                word = bare = space + bare
            words.append(word)
            stops.append(bare[len(word):])
        found = np.stack((self._numbered(words), self._numbered(stops))).astype(np.int32)
        found[0, list(fixed)] = list(fixed.values())
        self._measure()
        row[new] = np.arange(self.table.shape[1], self.table.shape[1] + len(new))
        self.table = np.concatenate((self.table, found), axis=1)
        lasting = np.delete(new, list(fixed))
        self.pieces.add(codes[lasting], row[lasting].astype(np.int32))
        which = self.table[:, row[coded.indices.to_numpy()]].T.ravel()
        del coded, row, pieces
        sizes = self.size[which]
        after = np.cumsum(sizes, dtype=np.int32)
        at = np.repeat(self.start[which] - (after - sizes), sizes)
        at += np.arange(len(at), dtype=np.int32)
        ids = np.frombuffer(self.ids, np.uint32)[at]
        ends = np.concatenate(([0], after))[2 * np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)
