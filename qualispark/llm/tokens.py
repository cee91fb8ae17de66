"""Token ids of whole texts by a public tokenizer, through a cache of words.

Two kinds of vocabulary are known to split a text before the merges so that a
change from a non-space to a space is always a boundary, and so are one from a
letter or digit to ASCII punctuation and the place after a lone line feed.
With these a text is the concatenation of the ids of its pieces (words with
the spaces before them, and what follows a word), and most pieces are met
again: their ids are kept in two generations of bounded
size in each worker; when the younger is full it becomes the older one, and words
met again move to the younger. Texts of ASCII and the letters of Latin-1 are cut
by a table over pairs of bytes, and their pieces looked up in arrays
(``piece_table``), some ten thousand at a time; other texts are cut by an expression and
looked up in dictionaries. Pieces that are new go to the tokenizer many at a
time, as one text: with a mark between them or, where a vocabulary has own
tokens for the ends of words, words of letters with a space between. A vocabulary file with any other splitting is applied to whole
texts, as are texts with control characters on which libraries differ (are they
space?).
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

from qualispark.llm.common import KEPT
from qualispark.llm.piece_table import SHORT, PieceTable, keys_of, padded

#: Words, and bytes of words and ids, in each of the two generations that a worker keeps, by kind:
#: words with their spaces and punctuation come in many more forms.
CACHE = {"spaces": (500_000, 20 << 20), "words": (300_000, 12 << 20), "other": (0, 0)}

#: Characters of text cut at a time, pieces looked up at a time, and new pieces in one text for the tokenizer.
GROUP_CHARS, LOOKED_UP, JOINED = 256 << 10, 32 << 10, 1000
#: What stands between such pieces: a byte that no merge of the vocabulary takes.
_MARK = "\x01"

# The splitting of the two kinds, as vocabulary files state it.
_BYTE_LEVEL = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
_WORD_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_UNSURE = re.compile("[\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff]")
_WORD = r"[a-zA-Z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]++(?=[\s!-/:-@\[-`{-~]|\Z)"
_LED = re.compile(rf"\n(?=\S)|\s*(?:{_WORD}|\S+)|\s+")  # a match begins after a non-space
_BARE = re.compile(rf"{_WORD}|\S+")

#: How byte-level vocabularies write each byte.
_WRITTEN = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_WRITTEN |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _WRITTEN)}

# Kinds of bytes: both bytes of a letter of Latin-1 are letters, all other bytes from 128 on are odd.
_END, _LETTER, _DIGIT, _SIGN, _APOSTROPHE, _BLANK, _GAP, _ODD = range(8)
_KINDS = np.full(256, _SIGN, np.uint8)
_KINDS[0], _KINDS[0x27], _KINDS[0x20], _KINDS[9:14] = _END, _APOSTROPHE, _BLANK, _GAP
_KINDS[0x30:0x3A] = _DIGIT
_KINDS[0x41:0x5B] = _KINDS[0x61:0x7B] = _KINDS[0x80:0xC0] = _KINDS[0xC3] = _LETTER
_KINDS[0x1C:0x20] = _KINDS[0x97] = _KINDS[0xB7] = _KINDS[0xC0:0xC3] = _KINDS[0xC4:] = _ODD


def _cuts(keeps_spaces: bool) -> np.ndarray:
    """By 8 times the kind of a byte plus that of the next: does a piece begin with the next?

    An apostrophe may take letters with it. A last blank goes with what follows it
    where spaces are kept; ``_begins`` parts it from those before it.
    """
    out = np.zeros((8, 8), bool)
    out[_END], out[:, _END] = True, True
    out[_LETTER : _BLANK, _BLANK : _ODD] = True
    out[_LETTER, _DIGIT] = out[_DIGIT, _LETTER] = True
    out[_LETTER : _SIGN, _SIGN : _BLANK] = out[_SIGN, _LETTER : _SIGN] = True
    out[_GAP, _LETTER : _BLANK] = True
    out[_BLANK, _LETTER : _BLANK] = out[_DIGIT, _DIGIT] = not keeps_spaces
    return out.ravel()


_CUTS = {kind: _cuts(kind == "spaces") for kind in ("spaces", "words")}


def _begins(kinds: np.ndarray, kind: str) -> np.ndarray:
    """Where pieces begin in texts that end with a zero byte each; the zero bytes and, if the kind drops them, spaces are left out."""
    begins = np.empty(len(kinds), bool)
    begins[0] = True
    np.take(_CUTS[kind], kinds[:-1] << 3 | kinds[1:], out=begins[1:])
    space = kinds >= _BLANK
    if kind == "spaces":
        begins[1:-1] |= space[:-2] & space[1:-1] & ~space[2:] & (kinds[2:] != _END)
    return begins


def splitting(path: str) -> str:
    """What is known of a vocabulary file: it keeps spaces ("spaces"), drops them ("words"), or nothing ("other")."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = all(t["special"] for t in spec.get("added_tokens", ()))
    before = spec.get("pre_tokenizer") or {}
    if plain and {k: spec.get(k) for k in _BYTE_LEVEL} == _BYTE_LEVEL:
        return "spaces"
    steps = before.get("pretokenizers", ())
    forms = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", ())]
    if plain and forms == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"]:
        split = steps[0]
        if split["pattern"] == {"Regex": _WORD_PIECES} and split["behavior"] == "Removed" and split["invert"] and not steps[1]["use_regex"]:
            return "words"
    return "other"


def largest_id(path: str) -> int:
    """The largest token id of a vocabulary file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab = spec["model"]["vocab"]
    ids = vocab.values() if isinstance(vocab, dict) else range(len(vocab))
    return max(max(ids, default=0), max((t["id"] for t in spec.get("added_tokens", ())), default=0))


def keeps_mark(vocab: Iterable[str]) -> bool:
    """Is the mark in no token of the vocabulary but its own?"""
    sign = "\u0101"  # how byte-level vocabularies write the byte 1
    return {t for t in vocab if sign in t} == {sign}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # pieces are text; whole texts with a special token go to ``_whole``
        named = [re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(named), re.IGNORECASE) if named else None
        self.path, self.plain = path, None
        self.kind = splitting(path)
        spec = json.loads(self.model.to_str())["model"]
        vocab, suffix = spec["vocab"], spec.get("end_of_word_suffix")
        self.mark = vocab["\u0101"] if self.kind == "spaces" and keeps_mark(vocab) else None
        #: by id: does a word end with the token?
        self.ending = np.zeros(0, bool)
        if self.kind == "words" and suffix:
            self.ending = np.zeros(self.model.get_vocab_size(), bool)
            self.ending[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.young, self.old = PieceTable(), PieceTable()
        self.bare, self.size = None, np.zeros(self.model.get_vocab_size(), np.int64)  # by id: bytes of the token
        for t, i in vocab.items() if self.kind == "spaces" else ():
            self.size[i] = len(t)
        names = [t.content for t in self.model.get_added_tokens_decoder().values()]
        #: names that lower-case bytes of ASCII and Latin-1's letters can be searched for
        self.names = [n.lower().encode() for n in names] if "".join(names).isascii() else None

    def _cut(self, text: str) -> list[str]:
        if self.kind == "spaces":
            return _LED.findall(text)
        return _BARE.findall(text.lower() if text.isascii() else text)

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _whole(self, text: str) -> bytes:
        """Ids of a text that has a special token's name, as the library gives them."""
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
        return array("I", self.plain.encode(text, add_special_tokens=False).ids).tobytes()

    def _joins(self, piece: str) -> bool:
        """Can the piece go with others? An apostrophe at the beginning or a space at the end is split otherwise next to a mark."""
        if len(self.ending):
            return piece.isalpha()
        return self.mark is not None and _MARK not in piece and piece[0] != "'" and not piece[-1].isspace()

    def _together(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that go to the tokenizer as one text."""
        between = " " if len(self.ending) else _MARK
        ids = np.array(self.model.encode_batch_fast([between.join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        if len(self.ending):
            ends = np.flatnonzero(self.ending[ids]) + 1
            starts = np.append(0, ends[:-1])
        else:
            marks = np.flatnonzero(ids == self.mark)
            starts, ends = np.append(0, marks + 1), np.append(marks, len(ids))
        if len(ends) != len(pieces):  # each piece has at least one end: a word that the normalizer splits
            return self._each(pieces)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]

    def _pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Pieces and their ids, in any order."""
        alone, joint = [], []
        for p in pieces:
            (joint if self._joins(p) else alone).append(p)
        for begin in range(0, len(joint), JOINED):
            some = joint[begin : begin + JOINED]
            yield from zip(some, self._together(some), strict=True)
        yield from zip(alone, self._each(alone), strict=True)

    def _spelled(self, text: str) -> bytes:
        """Ids of a text that can be cut, by dictionaries."""
        words = self._cut(text)
        missing = set(words).difference(self.known)
        if missing:
            new = {w: self.older[w] for w in missing if w in self.older}
            new.update(self._pieces(list(missing.difference(new))))
            self.held += sum(map(len, new)) + sum(map(len, new.values()))
            self.known.update(new)
        ids = b"".join(map(self.known.__getitem__, words))
        most, size = CACHE[self.kind]
        if self.held > size or len(self.known) > most:
            self.known, self.older, self.held = {}, self.known, 0
        return ids

    def _ones(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces that the splitting leaves whole, and how many each has: the vocabulary's own model without its splitting.

        Those are the table's pieces without an apostrophe that are not all spaces.
        """
        from tokenizers import Tokenizer

        if self.bare is None:
            spec = json.loads(self.model.to_str())
            mark = {"type": "Split", "pattern": {"String": _WRITTEN[1]}, "behavior": "Removed", "invert": False}
            spec |= {"normalizer": None, "pre_tokenizer": mark, "post_processor": None, "decoder": None, "added_tokens": []}
            self.bare = Tokenizer.from_str(json.dumps(spec))
        joined = _MARK.encode().join(pieces)
        if self.kind == "words" and not joined.isascii():
            joined = joined.decode().lower().encode()
        text = joined.decode("latin-1").translate(_WRITTEN)
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        if len(self.ending):
            ends = np.flatnonzero(self.ending[ids]) + 1
        else:
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(p) for p in pieces])) + 1
        if len(ends) != len(pieces):
            return None
        return ids, np.diff(ends, prepend=0)

    def _learn(self, pieces: list[bytes], keys: np.ndarray) -> np.ndarray:
        """Places in the younger table of different pieces that it lacks; keys of the short ones come first."""
        n = len(keys)
        places = np.zeros(len(pieces), np.int64)
        was = self.old.find(keys)
        was = np.concatenate((was, np.array([self.old.long.get(p, 0) for p in pieces[n:]], np.int64)))
        met = np.flatnonzero(was)
        places[met] = self.young.store(self.old.runs(was[met]), was[met] & 0xFFFF)
        new = np.flatnonzero(was == 0).tolist()
        fast = len(self.ending) or (self.kind == "spaces" and self.mark is not None)
        ones = [i for i in new if pieces[i][-1] > 32 and b"'" not in pieces[i] and b"\1" not in pieces[i]] if fast else []
        for begin in range(0, len(ones), JOINED):
            some = ones[begin : begin + JOINED]
            found = self._ones([pieces[i] for i in some])
            if found:
                places[some] = self.young.store(*found)
        rest = [i for i in new if not places[i]]
        if rest:
            at = {pieces[i].decode(): i for i in rest}
            order, ids = zip(*((at[p], x) for p, x in self._pieces(list(at))), strict=True)
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            places[list(order)] = self.young.store(np.frombuffer(b"".join(ids), "<u4"), counts)
        self.young.add(keys, places[:n])
        self.young.long.update(zip(pieces[n:], places[n:].tolist(), strict=True))
        return places

    def _places(self, joined: bytes, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Places of pieces of ``joined`` (``data``, padded) in the younger table."""
        keys = keys_of(data, starts, lengths)
        places = self.young.find(keys)
        longer = lengths > SHORT
        at = np.flatnonzero(longer)
        places[at] = [self.young.long.get(joined[a : a + n], 0) for a, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)]
        missing = np.flatnonzero(places == 0)
        if len(missing):
            missing = missing[np.argsort(longer[missing], kind="stable")]
            number: dict[bytes, int] = {}
            same = [number.setdefault(joined[a : a + n], len(number)) for a, n in zip(starts[missing].tolist(), lengths[missing].tolist(), strict=True)]
            firsts = missing[np.unique(same, return_index=True)[1]]
            found = self._learn(list(number), keys[firsts[~longer[firsts]]])
            places[missing] = found[same]
        return places

    def _group(self, texts: list[str]) -> list[bytes]:
        """Ids of texts."""
        raw = [t.encode() for t in texts]
        joined = b"\0".join(raw) + b"\0"
        low = joined.lower()
        own = low if self.kind == "words" else joined
        data = padded(own)
        kinds = _KINDS[data[: len(joined)]]
        stops = np.cumsum([len(r) + 1 for r in raw]) - 1
        odd = set(np.searchsorted(stops, np.flatnonzero(kinds == _ODD)).tolist())
        if np.count_nonzero(kinds == _END) != len(texts):
            odd.update(i for i, t in enumerate(texts) if "\0" in t)
        if self.names is None or any(n in low for n in self.names):
            odd.update(i for i, t in enumerate(texts) if self.special and self.special.search(t))
        # a longer piece without a cut could have more ids than a place can tell
        starts = np.flatnonzero(_begins(kinds, self.kind))
        lengths = np.diff(starts, append=len(kinds))
        odd.update(np.searchsorted(stops, starts[lengths > 0x4000]).tolist())
        if odd:
            out = [self._odd(t) if i in odd else b"" for i, t in enumerate(texts)]
            rest = [i for i in range(len(texts)) if i not in odd]
            for i, ids in zip(rest, self._group([texts[i] for i in rest]) if rest else (), strict=True):
                out[i] = ids
            return out
        first = kinds[starts]
        keep = first != _END if self.kind == "spaces" else (first != _END) & (first < _BLANK)
        starts, lengths = starts[keep], lengths[keep]
        counts, ids = [np.zeros(1, np.int64)], []
        for a in range(0, len(starts), LOOKED_UP):
            places = self._places(own, data, starts[a : a + LOOKED_UP], lengths[a : a + LOOKED_UP])
            counts.append(places & 0xFFFF)
            ids.append(self.young.runs(places).tobytes())
            if self.young.n + len(self.young.long) > CACHE[self.kind][0] or 4 * self.young.used > CACHE[self.kind][1]:
                self.young, self.old = PieceTable(), self.young
        ids = b"".join(ids)
        ends = 4 * np.cumsum(np.concatenate(counts))[np.searchsorted(starts, stops)]
        begin, out = 0, []
        for end in ends.tolist():
            out.append(ids[begin:end])
            begin = end
        return out

    def _odd(self, text: str) -> bytes:
        """Ids of a text that the table of bytes doesn't cut."""
        if self.special and self.special.search(text):
            return self._whole(text)
        if _UNSURE.search(text):
            return self._each([text])[0]
        return self._spelled(text)

    def each(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, in order; null is empty."""
        group, size = [], 0
        for text in texts:
            text = text or ""
            if self.kind == "other":
                yield self._whole(text) if self.special and self.special.search(text) else self._each([text])[0]
                continue
            group.append(text)
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def __call__(self, text: str) -> bytes:
        return next(self.each([text]))


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a vocabulary file, kept for tasks that ask for it (``arrow_map``)."""
    if path not in KEPT:
        KEPT.clear()  # one vocabulary at a time
        KEPT[path] = Encoder(path)
    return KEPT[path]
