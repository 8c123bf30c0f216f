"""Texts to token ids with a public byte-level BPE vocabulary.

The vocabulary's pre-tokeniser never lets a token cross a space that is
followed by something other than white space, nor a line end that stands
alone, so texts are cut before these.  Words
repeat heavily: Arrow numbers the distinct ones of a group of texts, each new
one is encoded by the tokenizers library, and Arrow lays the ids of all words
out in order again.  ``tests/llm`` holds this against encoding whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r" (?=\S)")
_LOOSE = re.compile(r" [^\S ]")
_SPECIAL = "<|endoftext|>"
_MARKS = ".,;:!?"
#: Blocks up to here (Latin, Greek, Cyrillic) have had the same letters since Unicode 7.0.
_LAST = "\u052f"
#: White space, rather too wide, as RE2 has it.
_WHITE = r"[\s\pZ\x{0b}\x{1c}-\x{1f}\x{85}]"
#: Texts where a space or line end is not always a cut, or that hold the special token.
_SLOW = rf"^[ \n]|[ \n]{_WHITE}|{_WHITE}\n|[ \n]$|<\|endoftext\|>"
#: Bytes of a word, its ids and its place in the cache, about.
_ENTRY = 240


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stand
    for themselves, the others for the letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTES = _byte_letters()
_SPACE = _BYTES[32]
_encoders: dict[tuple[str, int], Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str, most_bytes: int = 256 << 20) -> Encoder:
    """This process's encoder for a vocabulary; Python workers outlive tasks."""
    key = path, most_bytes
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, most_bytes)
    return _encoders[key]


def _cuts(text: str) -> list[str]:
    return [text] if _SPECIAL in text else _CUT.split(text)


def encoded_rows(own: Encoder, batch: pa.RecordBatch, limit: int = 1 << 22) -> Iterator[tuple[object, bytes]]:
    """(id, ids as bytes) of each row; texts are taken together up to about ``limit`` bytes."""
    keys, texts = batch.column("_id"), pc.fill_null(batch.column("text"), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = np.flatnonzero(np.diff(ends // limit, prepend=-1))
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(ends)]):
        yield from zip(keys[start:stop].to_pylist(), own.encode_column(texts[start:stop]))


class Encoder:
    """ids of texts as little-endian unsigned 32-bit integers.

    Words of at most 64 characters are kept in two generations of about
    ``most_bytes`` together.  When the younger is full it becomes the older, and
    what was only in the older goes; words still in use move to the younger."""

    def __init__(self, path: str, most_bytes: int = 256 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most_bytes = most_bytes
        self.held = 0
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bare = dict(zip((*_MARKS, "\n"), self.whole([*_MARKS, "\n"])))

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _model(self, word: str, lead: str) -> bytes:
        """ids of one piece, which the pre-tokeniser would hand to the model whole."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(lead + word)]).tobytes()

    def _learn(self, new: list[str]) -> list[str]:
        """Puts the ids of words that the cache lacks into it; returns the long ones.

        Letters with the space before them are one piece, and so are letters
        after a line end and a closing mark after letters; other words go
        through the whole tokeniser."""
        cache, bare = self.cache, self.bare
        stems: set[str] = set()
        made: list[tuple[str, str]] = []
        rest: list[str] = []
        for word in new:
            stem = word[:-1] if word[-1] in _MARKS else word
            letters = stem[1:] if stem[:1] == "\n" else stem
            if not letters.isalpha() or max(letters) > _LAST:
                rest.append(word)
                continue
            if stem is not word:
                made.append((word, stem))
            if stem not in cache:
                stems.add(stem)
        for stem in stems:
            cache[stem] = bare["\n"] + self._model(stem[1:], "") if stem[0] == "\n" else self._model(stem, _SPACE)
        for word, stem in made:
            cache[word] = cache[stem] + bare[word[-1]]
        cache.update(zip(rest, self.whole([w if w[0] == "\n" else " " + w for w in rest])))
        return [w for w in (*stems, *new) if len(w) > 64]

    def _renew(self) -> None:
        if 2 * self.held > self.most_bytes:
            self.older, self.cache, self.held = self.cache, {}, 0

    def _known(self, words: list[str]) -> list[bytes]:
        """ids of distinct words, each with a space before it unless it starts with a line end."""
        self._renew()
        cache, older = self.cache, self.older
        before = len(cache)
        found = list(map(cache.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        if new:
            cache.update((w, older[w]) for w in new if w in older)
            long_words = self._learn([w for w in new if w not in cache])
            found = list(map(cache.__getitem__, words))
            for w in set(long_words):
                del cache[w]
        self.held += _ENTRY * (len(cache) - before)
        return found

    def _joined(self, lists: pa.ListArray) -> list[bytes]:
        """ids of texts that are given as the lists of their parts, one part at least each."""
        starts, flat = lists.offsets.to_numpy(), lists.flatten()
        starts = starts - starts[0]
        heads = self.whole(flat.take(pa.array(starts[:-1])).to_pylist())
        others = np.ones(len(flat), bool)
        others[starts[:-1]] = False
        coded = flat.filter(pa.array(others)).dictionary_encode()
        ids = pa.array(self._known(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        bounds = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[starts - np.arange(len(starts))].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [b"".join((head, data[a:b])) for head, a, b in zip(heads, bounds, bounds[1:])]

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """ids of each text; no text may be null."""
        if not len(texts):
            return []
        slow = pc.match_substring_regex(texts, _SLOW)
        rest = np.flatnonzero(slow.to_numpy(zero_copy_only=False)).tolist()
        plain = texts.filter(pc.invert(slow)) if rest else texts
        lines = pc.replace_substring(plain, "\n", " \n")
        out = self._joined(pc.split_pattern(lines, " ")) if len(plain) else []
        if not rest:
            return out
        cut = pa.array([_cuts(texts[k].as_py()) for k in rest], pa.list_(pa.large_string()))
        for k, ids in zip(rest, self._joined(cut)):  # ascending, so each lands at its place
            out.insert(k, ids)
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.large_string()))

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]
