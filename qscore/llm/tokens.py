"""Token ids of whole texts by a public tokenizer."""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

# Byte-level pieces do not go on past white space that follows anything else, and take one blank at most before
# them. So a text may be cut before white space that follows anything else, and the ids of the parts are those
# of the whole. What is white space differs from engine to engine: that after a cut is what all take for such,
# that before is any.
_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")
_LETTER, _SIGN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r"!-/:-@\[-`{-~"
_SMALL = re.compile(rf"(?<=\S)(?=\n)|(?<=[{_LETTER}])(?=[{_SIGN}])|(?<=\S\n)(?=[{_LETTER}])")
_WORD = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")  # letters in any version of Unicode
_HELD = 176 << 20  # bytes of parts of texts, with their ids, that a worker keeps, and as much of older ones
_AT_ONCE = 1 << 21  # characters of texts that are looked at together


class _Bytes(dict):
    """For each character, by its number, the characters that stand for its bytes in a byte-level vocabulary."""

    def __missing__(self, number: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel

        self[number] = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(number))[0][0]
        return self[number]


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers.

    Where the vocabulary allows it, texts are cut at white space, and parts are looked up among those encoded
    before; the ids are those of the whole text. Special tokens in a text are what the vocabulary's file says.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are many enough
        from tokenizers import Tokenizer

        self.tokenizer, said = Tokenizer.from_str(vocabulary), json.loads(vocabulary)
        cut, added = said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
        self.by_part = (
            said.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
            and not cut.get("add_prefix_space") and said["model"]["type"] == "BPE" and not said["model"].get("dropout")
            and not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in added)
        )
        self.added = [t["content"] for t in added]
        self.bytes_of = _Bytes()
        self.known: dict[str, dict[str, bytes]] = {"": {}, " ": {}}  # by what stands before a part
        self.forget()

    def forget(self) -> None:
        """Only parts that come again are taken over from those known before."""
        self.old, self.known = self.known, {"": {}, " ": {}}
        self.held = 0

    def _keep(self, before: str, parts: list[str], ids: list[bytes]) -> None:
        self.known[before].update(zip(parts, ids))
        self.held += 200 * len(parts) + sum(map(len, parts)) + sum(map(len, ids))

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str], before: str) -> None:
        """Words of letters after a blank, or after nothing, are one piece each, which the model can take as it is."""
        split, bytes_of = self.tokenizer.model.tokenize, self.bytes_of
        self._keep(before, words, [array("I", [t.id for t in split((before + w).translate(bytes_of))]).tobytes() for w in words])

    def _learn(self, before: str, parts: set[str], whole: bool) -> None:
        """Parts that are not known; ``whole``: they must not be cut further."""
        known, old = self.known[before], self.old[before]
        new = parts.difference(known)
        again = [p for p in new if p in old]
        self._keep(before, again, [old[p] for p in again])
        new.difference_update(again)
        words = [p for p in new if _WORD.fullmatch(p)]
        self._words(words, before)
        new.difference_update(words)
        if not new:
            return
        others = list(new)
        if whole or len(others) == 1:
            self._keep(before, others, self._encoded([before + p for p in others]))
            return
        cut = [_SMALL.split(before + p) for p in others]
        blank, bare = set(), set()
        for pieces in cut:
            for p in pieces:
                blank.add(p[1:]) if p[0] == " " else bare.add(p)
        for lead, some in ((" ", blank), ("", bare)):
            self._learn(lead, some, True)
        of = {" ": self.known[" "], "": self.known[""]}
        self._keep(before, others, [b"".join([of[" "][p[1:]] if p[0] == " " else of[""][p] for p in pieces]) for pieces in cut])

    def _cut(self, text: str) -> list[tuple[str, list[str]]]:
        """Parts of a text, by what stands before them."""
        if _RUN.search(text):
            return [(" ", [p[1:]]) if p[0] == " " else ("", [p]) for p in _CUT.split(text)]
        first, *others = text.split(" ")
        return [("", [first]), (" ", others)] if first else [(" ", others)]

    def _some(self, texts: list[str]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # of very many parts none refers to another
        try:
            return self._joined(texts)
        finally:
            if collects:
                gc.enable()

    def _joined(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) if t else [] for t in texts]
        special = any(a in t for t in texts for a in self.added)
        for lead in ("", " "):
            self._learn(lead, set().union(*[parts for mine in cut for before, parts in mine if before == lead]), special)
        out = [b"".join([i for before, parts in mine for i in map(self.known[before].__getitem__, parts)]) for mine in cut]
        if self.held > _HELD:
            self.forget()
        return out

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; a null text has none."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < _AT_ONCE:
                size += len(texts[end] or "")
                end += 1
            some = [t or "" for t in texts[at:end]]
            if self.by_part:
                yield from self._some(some)
            else:
                for text in some:
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            at = end


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One for all batches of a worker."""
    return Encoder(vocabulary)
