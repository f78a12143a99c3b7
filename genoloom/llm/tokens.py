"""Token ids of whole texts, word by word through a bounded memory of encodings."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: the id that ends every document.
END_ID = 1
#: Words and chunks that a worker remembers before it starts anew with the next batch. It bounds memory and doesn't change results.
PIECES = 300_000

_PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[.,;:!?|]*)$"

# Fixed value: the pre-tokenizer for which a chunk's ids are those of its letters and of its punctuation.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """How byte-level BPE writes the UTF-8 bytes of Latin letters: printable bytes as themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


class Encoder:
    """The ids that the tokenizer gives a text with add_special_tokens=False, as little-endian unsigned 32-bit bytes.

    Where the tokenizer's pre-tokenizer is the known one, it never joins what ASCII white space parts, and drops that
    white space, so a text's ids are those of its chunks. A chunk of Latin letters and plain punctuation is again the
    word's ids in lower case and the punctuation's, which the tokenizers library's model gives; other chunks
    are encoded whole. Each is encoded once while it is remembered. With another pre-tokenizer whole texts are encoded.
    """

    _one: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        own = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in (own["normalizer"] or {}).get("normalizers", [])], [x.get("pattern", {}).get("Regex") for x in (own["pre_tokenizer"] or {}).get("pretokenizers", [])]
        replaced = [(x.get("pattern"), x.get("content")) for x in (own["normalizer"] or {}).get("normalizers", []) if x.get("type") == "Replace"]
        self.by_chunk = steps == (["NFC", "Replace", "Lowercase"], [_SPLIT, None]) and replaced == [({"Regex": r"\s+"}, " ")]
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder per worker process and file."""
        if path not in cls._one:
            cls._one[path] = cls(path)
        return cls._one[path]

    def _forget(self) -> None:
        """Empty memories; place 0 is the empty piece."""
        self.words, self.others = {"": 0}, {"": 0}
        self.store, self.ends = array("I"), array("q", [0, 0])

    def _keep(self, known: dict[str, int], pieces: list[str], ids: list[list[int]]) -> None:
        """Remembers the ids of pieces that weren't known: their places follow those there are."""
        first = len(self.ends) - 1
        self.store.extend(chain.from_iterable(ids))
        self.ends.extend((self.ends[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))).tolist())
        known.update(zip(pieces, range(first, first + len(pieces)), strict=True))

    def _word_places(self, words: list[str]) -> np.ndarray:
        """Places of distinct lower-case words or punctuation, each as the tokenizer's model splits it."""
        known, tokenize, letters = self.words, self.model.tokenize, self.letters
        fresh = [w for w in words if w not in known]
        self._keep(known, fresh, [[t.id for t in tokenize(w if w.isascii() else w.translate(letters))] for w in fresh])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _other_places(self, chunks: list[str]) -> np.ndarray:
        """Places of distinct chunks that are encoded whole."""
        known = self.others
        fresh = [c for c in chunks if c not in known]
        self._keep(known, fresh, [e.ids for e in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)])
        return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))

    @staticmethod
    def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The stretches of flat with those starts and sizes, one after another."""
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (a null text taken as empty), without end ids, and the bounds of each text's."""
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            return np.array([i for ids in encoded for i in ids], "<u4"), np.concatenate([[0], np.cumsum(sizes)])
        if len(self.ends) > PIECES:
            self._forget()
        lists = pc.split_pattern_regex(texts, r"[\t-\r ]+")
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary
        parts = pc.extract_regex(chunks, _PLAIN)
        plain = parts.is_valid()
        is_plain = plain.to_numpy(zero_copy_only=False)
        places = np.zeros((len(chunks), 2), np.int64)  # of a word and its punctuation, or of a whole chunk
        own = parts.filter(plain)
        for column, name, lowered in ((0, "word", True), (1, "mark", False)):
            pieces = pc.struct_field(own, name)
            pieces = (pc.utf8_lower(pieces) if lowered else pieces).dictionary_encode()
            places[is_plain, column] = self._word_places(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()] if len(pieces) else 0
        places[~is_plain, 0] = self._other_places(chunks.filter(pc.invert(plain)).to_pylist())
        flat, ends = np.frombuffer(self.store, "<u4").copy() if len(self.store) else np.zeros(0, "<u4"), np.array(self.ends, np.int64)
        starts, sizes = ends[:-1], np.diff(ends)
        each = sizes[places].sum(axis=1)  # ids of each distinct chunk
        flat = self._gathered(flat, starts[places].ravel(), sizes[places].ravel())
        codes = coded.indices.to_numpy()
        ids = self._gathered(flat, (np.cumsum(each) - each)[codes], each[codes])
        return ids, np.concatenate([[0], np.cumsum(each[codes])])[bounds]

    def encode_each(self, texts: pa.Array, end_id: int, most: int = 4 << 20) -> Iterator[np.ndarray]:
        """The ids of each text with the end id; texts of about `most` bytes (or one longer text) are held at a time."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, seen = 0, 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, seen + most, "right")))
            ids, bounds = self.encode_batch(texts.slice(at, to - at))
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield np.append(ids[s:e], np.uint32(end_id))
            at, seen = to, int(sizes[to - 1])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the vocabulary file lies on this machine; resolved in each worker."""
    import public_tokenizers

    return public_tokenizers.path(name)
