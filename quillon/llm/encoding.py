"""Token ids of whole texts through the tokenizers library, cached by chunk.

For a tokenizer that drops white space and treats every stretch between white space alone (its file says
so: an NFC / white space / lower-case normaliser and a splitter that removes what it doesn't match, with the patterns
below), equal chunks give equal ids.  Each batch is split at ASCII white space and its distinct chunks are looked up; only
chunks not met before are tokenized.  Other tokenizer files are encoded text by text.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import joined

#: Stems kept in each of the two generations of the cache.
GENERATION = 80_000

# The patterns of the tokenizer file that is read by chunk.
SPACES = r"\s+"
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: A chunk of letters that NFC leaves alone, then marks that the splitter cuts off as one piece.
MARKS = ".,;:!?*#$%&|"
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"


def _byte_letters() -> list[str]:
    """How each character up to U+00FF is spelt in the byte-level alphabet.

    Printable bytes stand for themselves, the others follow in order from U+0100 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    letter = [chr(b) if b in plain else chr(next(others)) for b in range(256)]
    return ["".join(letter[b] for b in chr(c).encode()) for c in range(256)]


def _strings(values: pa.Array) -> list[str]:
    """The strings of an array as a list; none holds a line feed, as chunks hold no white space."""
    if not len(values):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pc.binary_join(whole, "\n")[0].as_py().split("\n")


class Encoder:
    """encode(texts) gives all ids end to end (little-endian unsigned 32-bit) and each text's end in ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.chunked = self._by_chunk(spec)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.alphabet = "".join(chr(c) for c in (*range(65, 91), *range(97, 123), *range(192, 256)) if c not in (215, 247))
        self.plain = re.compile(LETTERS).match

    @staticmethod
    def _by_chunk(spec: dict) -> bool:
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        norm = [x.get("type") for x in steps]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        cut = pre[0]
        return (
            norm == ["NFC", "Replace", "Lowercase"]
            and steps[1].get("pattern") == {"Regex": SPACES}
            and steps[1].get("content") == " "
            and cut.get("pattern") == {"Regex": SPLITTER}
            and cut.get("type") == "Split"
            and cut.get("behavior") == "Removed"
            and bool(cut.get("invert"))
            and [x.get("type") for x in pre[1:]] == ["ByteLevel"]
            and not pre[1].get("add_prefix_space")
        )

    def _ids(self, piece: str) -> bytes:
        if not piece:
            return b""
        if self.plain(piece):  # lower-cased letters: one piece for the model, spelt in byte letters
            spelt = piece if piece.isascii() else "".join([self.letters[ord(c)] for c in piece])
            return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _lookup(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces.  What a whole generation doesn't ask for is dropped."""
        found = list(map(self.young.get, pieces))
        new = {}
        for i, ids in enumerate(found):
            if ids is None:
                ids = self.old.get(pieces[i])
                new[pieces[i]] = found[i] = self._ids(pieces[i]) if ids is None else ids
        if len(self.young) + len(new) > GENERATION:
            self.old, self.young = self.young, {}
        self.young.update(new)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = joined(texts)
        if not self.chunked:
            at = offsets.tolist()
            found = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch([data[a:b].decode() for a, b in zip(at, at[1:], strict=False)], add_special_tokens=False)]
            return np.concatenate([*found, np.zeros(0, "<u4")]), np.cumsum([len(x) for x in found], dtype=np.int64)
        plain = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        lists = pc.ascii_split_whitespace(plain)
        coded = lists.values.dictionary_encode()
        chunks = coded.dictionary
        stems = pc.utf8_rtrim(chunks, MARKS)
        fast = pc.match_substring_regex(stems, LETTERS)
        stems = pc.if_else(fast, pc.utf8_lower(stems), chunks).dictionary_encode()
        tails = pc.if_else(fast, pc.utf8_ltrim(chunks, self.alphabet), "").dictionary_encode()
        pieces = self._lookup(_strings(stems.dictionary)) + self._lookup(_strings(tails.dictionary))
        pair = np.empty(2 * len(chunks), dtype=np.int32)
        pair[0::2] = stems.indices.to_numpy()
        pair[1::2] = tails.indices.to_numpy() + len(stems.dictionary)
        spread = pa.array(pieces, pa.binary()).take(pa.array(pair)).cast(pa.binary())
        own = np.frombuffer(spread.buffers()[1], dtype=np.int32, count=len(spread) + 1)[::2] if len(chunks) else np.zeros(1, np.int32)
        whole = pa.BinaryArray.from_buffers(pa.binary(), len(chunks), [None, pa.py_buffer(np.ascontiguousarray(own)), spread.buffers()[2]])
        spread = whole.take(coded.indices)
        ends = lists.offsets.to_numpy()[1:]
        if not len(spread):
            return np.zeros(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
        places = np.frombuffer(spread.buffers()[1], dtype=np.int32, count=len(spread) + 1)
        flat = np.frombuffer(spread.buffers()[2], dtype="<u4", count=int(places[-1]) // 4)
        return flat, places[ends].astype(np.int64) // 4


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file; its cache outlives the task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(flat: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text, and each text's end in them."""
    out = np.empty(len(flat) + len(ends), dtype="<u4")
    after = ends + np.arange(1, len(ends) + 1)
    own = np.ones(len(out), dtype=bool)
    own[after - 1] = False
    out[own] = flat
    out[after - 1] = end_id
    return out, after
