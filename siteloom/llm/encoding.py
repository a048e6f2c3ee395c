"""Whole texts to token ids with the tokenizers library, remembering the ids of each part.

A byte-level tokenizer cuts a text into pieces by a pattern and encodes each piece by itself. Some places are always between
two pieces: white space after a character that is none, an ASCII character that is no letter after a Latin letter, and what
follows a lone line end. All texts of a batch are cut at those places at once, Arrow looks the parts up in a memory of known ones,
and the library encodes each part that is new. Not every such place is cut: wherever libraries may differ on a character, the part
just stays longer. A text that holds one of the tokenizer's added tokens goes to the library whole. The memory of parts is
bounded: when it is full, what was met once goes, and of the rest at most half as many parts as fit stay, those met most often.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
#: Parts remembered by a worker; about 30 bytes each, and as much again while they are looked up.
REMEMBERED = 600_000
#: Those looked up first, in a table small enough to stay in the cache: the earliest ones, which hold the commonest.
FIRST = 1 << 16
#: Bytes of text to encode at a time: the memory is indexed anew for each slice.
SLICE = 8 << 20
#: Longest part that is remembered, in bytes.
LONGEST = 64
#: Parts that are one piece of letters: ASCII ones and U+00C0 to U+024F but for the two signs among them, in UTF-8.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")
#: The visible characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from U+0100 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = "".join(chr(b if b in _SELF else 256 + sum(x not in _SELF for x in range(b))) for b in range(256))

#: Classes of bytes: white space, ASCII letters, other printable ASCII, bytes beyond ASCII; 0 for control characters.
_SPACE, _LETTER, _OTHER, _HIGH = 1, 2, 4, 8
_CLASS = np.array([_SPACE if b == 32 or 9 <= b <= 13 else _HIGH if b > 127 else 0 if b < 32 or b == 127 else _LETTER if chr(b).isalpha() else _OTHER for b in range(256)], np.uint8)


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Which bytes begin a part."""
    kind = _CLASS[raw]
    out = np.zeros(len(raw), bool)
    if not len(raw):
        return out
    out[0] = True
    before, now = kind[:-1], kind[1:]
    out[1:] = ((now == _SPACE) & (before & (_LETTER | _OTHER) != 0)) | ((now == _OTHER) & (before == _LETTER))
    at = np.flatnonzero((before == _HIGH) & (now & (_SPACE | _OTHER) != 0)) + 1
    if len(at):  # after a character beyond ASCII: before a space, if it can't be white space itself; else, if it is a Latin letter
        lead, last = raw[at - 2], raw[at - 1]
        latin = (lead >= 0xC3) & (lead <= 0xC8) & ((lead != 0xC3) | ((last != 0x97) & (last != 0xB7)))
        out[at] = np.where(kind[at] == _SPACE, ~np.isin(lead, (0xC2, 0x80, 0x81, 0x9A)), latin)
    at = np.flatnonzero(raw[1:-1] == 10) + 2  # after a line end between two visible ASCII characters
    visible = _LETTER | _OTHER
    out[at[(kind[at - 2] & visible != 0) & (kind[at] & visible != 0)]] = True
    return out


def _ascii_words(parts: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Which parts are a space, if any, and ASCII letters, and those as the vocabulary writes them."""
    edges = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1]
    raw = np.frombuffer(parts.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    begin, lens = edges[:-1] - edges[0], np.diff(edges)
    other = _CLASS[raw] != _LETTER
    other[begin[raw[begin] == 32]] = False
    plain = (np.add.reduceat(other, begin, dtype=np.int64) == 0) & ((lens > 1) | (raw[begin] != 32))
    text = pc.binary_join(pa.ListArray.from_arrays([0, int(plain.sum())], parts.filter(pa.array(plain))), b"\n")[0].as_py()
    return plain, text.replace(b" ", _VISIBLE[32].encode()).decode().split("\n") if text else []


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = remembered
        self.parts, self.ids, self.ends, self.met = pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _forget(self, room: int) -> None:
        """Keeps the parts met most often, beside which there is so much room."""
        keep = np.flatnonzero(self.met > 1)
        most = max(0, min(self.most // 2, self.most - room))
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-self.met[keep], kind="stable")[:most]])
        size, begin = np.diff(self.ends)[keep], self.ends[keep]
        ends = np.cumsum(size)
        self.ids = self.ids[np.repeat(begin - ends + size, size) + np.arange(size.sum())]
        self.parts, self.ends, self.met = self.parts.take(pa.array(keep)), np.r_[0, ends], self.met[keep] // 2

    def _whole(self, part: bytes) -> list[int]:
        return self.tokenizer.encode(part.decode(), add_special_tokens=False).ids

    def _new(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that are not remembered, in a row, and how many each has."""
        word, tokenize, ids, ends = _WORD.fullmatch, self.tokenizer.model.tokenize, [], [0]
        plain, shown = _ascii_words(parts)
        shown = iter(shown)
        others = iter(parts.filter(pa.array(~plain)).to_pylist())
        for is_plain in plain.tolist():
            if is_plain:
                ids += [t.id for t in tokenize(next(shown))]
            else:
                part = next(others)
                ids += [t.id for t in tokenize(part.decode("latin-1").translate(_VISIBLE))] if word(part) else self._whole(part)
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(ends)

    def _codes(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each part its place in a store: places, the store's ids, and where each place's ids end (from a 0 on)."""
        ids, ends = self.ids, self.ends
        code = pc.index_in(parts, value_set=self.parts[:FIRST]).fill_null(-1).to_numpy().astype(np.int64)
        lost = np.flatnonzero(code < 0)
        if len(lost) and len(self.parts) > FIRST:
            more = pc.index_in(parts.take(pa.array(lost)), value_set=self.parts[FIRST:]).fill_null(-1).to_numpy()
            code[lost] = np.where(more < 0, -1, more + FIRST)
            lost = lost[more < 0]
        self.met += np.bincount(code + 1, minlength=len(self.parts) + 1)[1:]
        if len(lost):
            new = parts.take(pa.array(lost)).dictionary_encode()
            more, size = self._new(new.dictionary)
            again = new.indices.to_numpy()
            code[lost] = len(self.parts) + again
            ids, ends = np.concatenate([ids, more]), np.concatenate([ends, ends[-1] + np.cumsum(size)])
            short = pc.binary_length(new.dictionary).to_numpy() <= LONGEST
            if len(self.parts) + short.sum() > self.most:
                self._forget(int(short.sum()))
            if short.sum() <= self.most:
                self.met = np.append(self.met, np.bincount(again, minlength=len(short))[short])
                self.parts = pa.concat_arrays([self.parts, new.dictionary.filter(pa.array(short))])
                self.ids = np.concatenate([self.ids, more[np.repeat(short, size)]])
                self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size[short])])
        return code, ids, ends

    def encode_all(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with the end id behind it, and how many each has."""
        blob = b"".join(texts)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(lens) - lens
        raw = np.frombuffer(blob, np.uint8)
        begins = _cuts(raw)
        begins[starts[lens > 0]] = True
        for i in [i for i, t in enumerate(texts) if any(a in t for a in self.added)] if any(a in blob for a in self.added) else ():
            begins[starts[i] + 1 : starts[i] + lens[i]] = False
        at = np.flatnonzero(begins)
        edges = pa.py_buffer(np.r_[at, len(raw)].astype(np.int32))
        code, store, place = self._codes(pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, edges, pa.py_buffer(blob)]))
        size, source = np.diff(place), place[:-1][code]
        each = size[code]
        owner = np.searchsorted(at, starts)  # the first part of each text
        if end is not None:  # one more place after the last part of each text
            store = np.append(store, np.uint32(end))
            last = np.r_[owner[1:], len(at)]
            each, source = np.insert(each, last, 1), np.insert(source, last, len(store) - 1)
            owner = owner + np.arange(len(texts))
        ends = np.cumsum(each)
        ids = store[np.repeat(source - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]
        place = np.r_[0, ends][np.r_[owner, len(each)]]
        return ids, np.diff(place)

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text.encode()])[0].tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
