"""Token ids of texts, many at a time: pieces of text that occur again are encoded once.

A text is cut where the tokenizer's own pattern always cuts: before a space that follows a non-space, before a full stop or
comma after a letter, around a single line feed between a non-space and a letter. Texts with other white space or markers
of special tokens are encoded whole. The pieces' ids, joined, are the ids of the text.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from aeroframe.llm.text import range_hashes

CUT = "\x01"
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: White space beyond space, tab, line feed, form feed and carriage return, and what else needs the whole text.
WHOLE = r"[\x{01}\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|<\|"


def ragged(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``values``, joined, and the starts of the result."""
    out = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(out[-1]) + np.repeat(begin - out[:-1], sizes)
    return values[at], out


class Encoder:
    """Encodes Arrow string arrays with a ``tokenizers`` file; keeps the ids of pieces for later batches.

    Pieces are kept by a 96-bit hash in sorted arrays, about 40 bytes each; of more than ``most`` the half that was used longest
    ago is dropped."""

    def __init__(self, path: str, most: int = 1_500_000):
        from tokenizers import Tokenizer
        self.tokenizer, self.most, self.batch = Tokenizer.from_file(path), most, 0
        self.key, self.check, self.begin, self.size, self.used = (np.zeros(0, t) for t in (np.uint64, np.uint32, np.int64, np.int32, np.int32))
        self.ids = np.zeros(0, "<u4")

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin in ``self.ids``, and how many they are."""
        at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
        raw = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
        key = range_hashes(raw, at[:-1] - at[0], at[1:] - at[0])
        check = (range_hashes(raw, at[:-1] - at[0], at[1:] - at[0], 2) >> np.uint64(32)).astype(np.uint32)
        self.batch += 1
        place = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        known = (self.key[place] == key) & (self.check[place] == check) if len(self.key) else np.zeros(len(key), bool)
        begin, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int32)
        begin[known], size[known] = self.begin[place[known]], self.size[place[known]]
        self.used[place[known]] = self.batch
        new = np.flatnonzero(~known)
        if len(new):
            made = array("I")
            for k in range(0, len(new), 4_000):
                part = new[k:k + 4_000]
                for j, ids in zip(part, self._plain(pieces.take(pa.array(part)).to_pylist()), strict=True):
                    begin[j], size[j] = len(made), len(ids)
                    made.extend(ids)
            begin[new] += len(self.ids)
            self.ids = np.concatenate([self.ids, np.frombuffer(made, np.uint32)])
            order = new[np.argsort(key[new], kind="stable")]
            spot = np.searchsorted(self.key, key[order])
            for name, own in (("key", key), ("check", check), ("begin", begin), ("size", size), ("used", np.full(len(key), self.batch, np.int32))):
                setattr(self, name, np.insert(getattr(self, name), spot, own[order]))
        return begin, size

    def _forget(self) -> None:
        if len(self.key) > self.most:
            keep = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
            for name in ("key", "check", "begin", "size", "used"):
                setattr(self, name, getattr(self, name)[keep])
            self.ids, starts = ragged(self.ids, self.begin, self.size)
            self.begin = starts[:-1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and where each text begins."""
        whole = pc.match_substring_regex(texts, WHOLE)
        spaced = pc.and_(pc.match_substring_regex(texts, r"[ \t\n\f\r] "), pc.invert(whole))
        easy = pc.invert(pc.or_(whole, spaced))
        values, starts, order = [], [np.zeros(1, np.int64)], []
        for mask, cut in ((easy, lambda x: pc.replace_substring(x, " ", CUT + " ")),
                          (spaced, lambda x: pc.replace_substring_regex(x, rf"([^\s])( [{LETTER}])", rf"\1{CUT}\2")), (whole, None)):
            at = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
            if len(at):
                part = texts.take(pa.array(at))
                if cut:
                    v, s = self._joined(cut(part))
                else:
                    ids = self._plain(part.to_pylist())
                    v, s = np.asarray([i for x in ids for i in x], "<u4"), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                values.append(v)
                starts.append(s[1:] + starts[-1][-1])
                order.append(at)
        joined = np.concatenate(values) if values else np.zeros(0, "<u4")
        back = np.argsort(np.concatenate(order), kind="stable") if order else np.zeros(0, np.int64)
        self._forget()
        starts = np.concatenate(starts).astype(np.int64)
        return ragged(joined, starts[:-1][back], np.diff(starts)[back])

    def _joined(self, cut: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(cut, CUT)
        words = lists.values.dictionary_encode()
        inner = pc.replace_substring_regex(words.dictionary, rf"([{LETTER}])([.,])", rf"\1{CUT}\2")
        inner = pc.split_pattern(pc.replace_substring_regex(inner, rf"([^\s])\n([{LETTER}])", f"\\1{CUT}\n{CUT}\\2"), CUT)
        pieces = inner.values.dictionary_encode()
        begin, size = self._pieces(pieces.dictionary)
        which = pieces.indices.to_numpy()
        word_ids, at = ragged(self.ids, begin[which], size[which])
        word_starts = at[inner.offsets.to_numpy()]
        which = words.indices.to_numpy()
        text_ids, at = ragged(word_ids, word_starts[:-1][which], np.diff(word_starts)[which])
        return text_ids, at[lists.offsets.to_numpy()]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process: its pieces serve all tasks that the process runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
