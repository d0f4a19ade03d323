"""Encoding of whole texts with a public tokenizer: the helper that the token operators run inside tasks."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's caches of words and of their pieces, about 200 bytes each. Full caches take no more.
CACHE_WORDS, CACHE_PIECES = 500_000, 50_000
#: Words that are cut into pieces here: printable ASCII without the apostrophe, and letters of Latin-1.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Code points of texts that are cut into words together.
TOGETHER = 1 << 20
#: Words that both ways must encode alike before the short one is used.
TRIAL = ["Ab,", "naïve", "ÉÀ!!", "x###", "|", "a1b22", "+1", "(555)", "end.", "straße", "a@b.de", "a_b", "<a>"]

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of whole texts as little-endian unsigned integers of ``width`` bytes (2 where the vocabulary allows, else 4).

    Where pre-tokenization never crosses a space or line feed, a text's ids are those of its space-separated words in
    turn. Words repeat, so their ids are kept in a bounded cache of the worker; plain words are cut at the vocabulary's
    own piece borders and only the pieces go through its merges. Other vocabularies encode texts as they are."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.type = np.dtype("<u2" if self.width == 2 else "<u4")
        self.code = "H" if self.width == 2 else "I"
        self.merge = self.tok.model.tokenize
        self.letters: dict[int, str] = {}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}
        self.ends = {}
        try:
            self.letters = {ord(c): self.tok.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}
            self.ends = {c: self._piece(c) for c in ".,"}
            self.by_words = all(self._word(w) == self._whole(w) for w in TRIAL) and b"".join(map(self._whole, TRIAL)) == self._whole(" ".join(TRIAL)) == self._whole("\n".join(TRIAL))
        except Exception:  # a model that can't be asked for single pieces
            self.by_words = False

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _merged(self, p: str) -> bytes:
        """Ids of one piece in lower case."""
        return array(self.code, [t.id for t in self.merge(p if p.isascii() else p.translate(self.letters))]).tobytes()

    def _piece(self, p: str) -> bytes:
        got = self.pieces.get(p)
        if got is None:
            got = self._merged(p)
            if len(self.pieces) < CACHE_PIECES:
                self.pieces[p] = got
        return got

    def _word(self, w: str) -> bytes:
        low = w.lower()
        stem, end = (low, b"") if low[-1:] not in self.ends else (low[:-1], self.ends[low[-1:]])
        if stem.isalpha() and (stem.isascii() or PLAIN.fullmatch(w)):  # letters alone, or before a stop or comma
            return (self.words.get(stem) or self._merged(stem)) + end
        if PLAIN.fullmatch(w) and "<|" not in w:
            return b"".join(map(self._piece, PIECE.findall(low)))
        return self._whole(w)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A null text has no ids."""
        if not self.by_words:
            return [self._whole(t or "") for t in texts]
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            k, size = i, 0
            while k < len(texts) and (k == i or size + len(texts[k] or "") <= TOGETHER):
                size += len(texts[k] or "")
                k += 1
            split = pc.split_pattern(pc.replace_substring(pa.array([t or "" for t in texts[i:k]], pa.large_string()), "\n", " "), " ")
            words = split.flatten().dictionary_encode()  # each word of the texts is looked up once
            ids = pa.array(self._words(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
            if isinstance(ids, pa.ChunkedArray):
                ids = ids.combine_chunks()
            data, at = memoryview(ids.buffers()[2] or b""), np.frombuffer(ids.buffers()[1], "<i8")[ids.offset : ids.offset + len(ids) + 1]
            border = at[split.offsets.to_numpy()].tolist()
            out += [bytes(data[x:y]) for x, y in zip(border, border[1:])]
            i = k
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        got = list(map(self.words.get, words))
        new: dict[str, bytes] = {}
        at = -1
        try:
            while True:  # the places of words that aren't in the cache
                at = got.index(None, at + 1)
                new[words[at]] = got[at] = self._word(words[at])
        except ValueError:
            pass
        if len(self.words) < CACHE_WORDS:
            self.words.update(new)
        return got


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    """Path of the vocabulary that the queries use; every operator takes it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
