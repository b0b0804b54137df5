"""Whole texts to token ids with the tokenizers library, units at which its pre-tokenizer always splits being encoded once.

Both supported pre-tokenizers begin a new pre-token wherever white space follows another character,
so that the ids of a text are the ids of its units one after the other. The distinct units of a batch
of texts are looked up among those a worker has met, which it keeps in two generations of up to
CACHE / 2; a full one takes the place of the elder, whose units stay as far as they are met again.
A text that holds the string of a special token is encoded whole, so that all ids are those of the
library's plain call.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm._shared import claim

#: Units kept by a worker; a unit longer than UNIT_CHARS is encoded each time.
CACHE, UNIT_CHARS = 1_000_000, 64
#: Characters that no normaliser composes and whose lower case depends on nothing else.
_PLAIN = r"[!-~\u00a1-\u012f\u0131-\u02ff]+"
_SPACED = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space but blank and line feed, by any definition in use.
_EXOTIC = (*(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"), "\u180e", "\u200b", "\ufeff")
_ENDS = ".,"
#: What ends a unit in a text that is to be cut, and white space whose pre-tokens a cut before each character would tear.
_CUT = "\0"
_RUNS = tuple(map("".join, product(" \n", repeat=3)))
#: Rows of the pieces in which texts are best encoded: the more, the fewer units are new to a piece.
ROWS = 4096

_encoders: dict[tuple, UnitEncoder] = {}


class UnitEncoder:
    """path: a tokenizer's JSON file. drops_space: its pre-tokenizer drops white space; else a unit keeps what stands before it.

    The strings of special tokens in a text are these tokens unless specials is unset, which makes them ordinary text.
    cache: units kept, CACHE by default; fewer where a worker shares its memory with more.
    """

    def __init__(self, path: str, drops_space: bool, specials: bool = True, cache: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self.drops_space = drops_space
        self.limit = cache or CACHE
        #: Bytes of the pieces in which texts are best encoded: what a piece makes stays in proportion to what is kept.
        self.piece = 8 * self.limit
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if specials else []
        self.young: dict[str, bytes] = {"": b""}
        self.elder: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.highest = max(vocabulary.values())
        self.bytes_of = np.zeros(self.highest + 1, np.int64)  # a byte-level token has a character for each byte
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token.removesuffix("</w>") if drops_space else token)
        self.plain = re.compile(_PLAIN if drops_space else f"[ \\n]+{_PLAIN}")
        self.ends = {c: self.whole(c) for c in _ENDS}
        self.glue = " " if drops_space else ""

    def _alone(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return array("I", self._alone(text)).tobytes()

    def _marked(self, text: str) -> str | None:
        """The text with its units' ends marked; None if it is to be encoded whole."""
        if any(x in text for x in self.literals):
            return None
        if self.drops_space:
            if "\u0130" not in text and "\u03a3" not in text:  # the others' lower case depends on nothing else
                text = text.lower()
            return text.replace("\n", " ")
        if _CUT in text or any(c in text for c in _EXOTIC):
            return None
        if any(x in text for x in _RUNS) or text[-2:].isspace():
            return _CUT.join(_SPACED.findall(text))
        return text.replace(" ", _CUT + " ").replace("\n", _CUT + "\n")

    def _learn(self, joined: list[str], alone: list[str]) -> dict[str, bytes]:
        """The ids of units; those of plain ones are encoded a thousand in one text, where the bytes that the ids stand for tell where a unit ends."""
        out: dict[str, bytes] = {}
        for at in range(0, len(joined), 1000):
            some = joined[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.glue.join(some)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.cumsum(self.bytes_of[ids])
            ends = np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in some])
            last = np.searchsorted(stops, ends)
            if len(stops) == 0 or stops[-1] != ends[-1] or (stops[last] != ends).any():
                alone = alone + some
                continue
            data, cuts = ids.tobytes(), [0, *((last + 1) * 4).tolist()]
            out.update(zip(some, [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], strict=True))
        if alone:
            out.update((u, array("I", e.ids).tobytes()) for u, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True))
        return out

    def _found(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units; of those that end in a mark after a letter, where a pre-token always ends, the rest's and the mark's."""
        if len(self.young) > self.limit // 2:
            self.young, self.elder = {"": b""}, self.young
        young, elder, plain = self.young, self.elder, self.plain.fullmatch
        out = list(map(young.get, units))
        joined, alone, ended = [], [], []
        missing = [k for k, ids in enumerate(out) if ids is None]
        for k in missing:
            u = units[k]
            ids = elder.get(u)
            if ids is not None:
                young[u] = out[k] = ids
            elif not plain(u):
                alone.append(u)
            elif u[-1] in _ENDS and u[-2:-1].isalpha():
                ended.append(u)
            else:
                joined.append(u)
        stems = {u[:-1] for u in ended}.difference(joined)
        joined += [s for s in stems if s not in young and s not in elder]
        learned = self._learn(joined, alone)
        for u in ended:
            s = u[:-1]
            ids = learned.get(s) or young.get(s) or elder[s]
            learned[u] = ids + self.ends[u[-1]]
        for k in missing:
            if out[k] is None:
                out[k] = learned[units[k]]
        young.update(learned if max(map(len, learned), default=0) <= UNIT_CHARS else {u: ids for u, ids in learned.items() if len(u) <= UNIT_CHARS})
        return out

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text (null: empty) as little-endian unsigned 32-bit integers."""
        marked = [self._marked(t) if t else "" for t in texts]
        units = pc.split_pattern(pa.array([m or "" for m in marked], pa.large_string()), " " if self.drops_space else _CUT)
        codes = units.flatten().dictionary_encode()
        data = pa.array(self._found(codes.dictionary.to_pylist()), pa.large_binary()).take(codes.indices)
        stops = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1)[units.offsets.to_numpy()].tolist()
        ids = memoryview(data.buffers()[2] or b"")
        for k, text in enumerate(texts):
            yield self.whole(text) if marked[k] is None else bytes(ids[stops[k] : stops[k + 1]])


def encoder(path: str, drops_space: bool, specials: bool = True, cache: int | None = None) -> UnitEncoder:
    """The worker's encoder of that file."""
    key = (path, drops_space, specials, cache)
    claim(f"encoder {key}", lambda: _encoders.pop(key, None))
    if key not in _encoders:
        _encoders[key] = UnitEncoder(*key)
    return _encoders[key]


def tokenizer_path(name: str) -> str:
    """The file of one of the public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
