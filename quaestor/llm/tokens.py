"""Token ids of whole texts under a byte-level BPE vocabulary file."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import tiktoken
from tokenizers import Tokenizer

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as that pattern means it, and the blanks of a run from which it is cut out of its text.
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 10_000
_RUN = re.compile(f"{_BLANK}{{{LONG_RUN},}}")


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """Ids of texts, as the `tokenizers` library gives them for its JSON file of a byte-level BPE whose ids follow its
    merges, at its defaults: the string of an added token is that token wherever it stands. The work is done by `tiktoken`,
    which takes a quarter of the time. A text is cut at added tokens, as the library does, and around very long runs of
    blanks, whose last blank belongs to what follows them; so no run of any length is matched by backtracking."""

    def __init__(self, path: str):
        made = json.loads(Path(path).read_text("utf-8"))
        model, byte_of = made["model"], _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(model["merges"])}
        self._added = {t["content"]: t["id"] for t in made.get("added_tokens", ())}
        for t in made.get("added_tokens", ()):
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError(f"{path}: added tokens that take blanks or whole words only are not supported")
        self._cut = re.compile("|".join(map(re.escape, sorted(self._added, key=len, reverse=True)))) if self._added else None
        self._code = "H" if max(len(ranks), *self._added.values(), 0) < 65_000 else "I"
        self.dtype = np.dtype(f"<u{array(self._code).itemsize}")
        self._bpe = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _parts(self, text: str) -> Iterator[list[int]]:
        """Ids of a text without added tokens."""
        at = 0
        for run in _RUN.finditer(text) if len(text) >= LONG_RUN else ():
            # At a text's end the whole run is one piece; elsewhere its last blank starts the next one.
            end = run.end() if run.end() == len(text) else run.end() - 1
            yield self._bpe.encode_ordinary(text[at : run.start()])
            yield self._run(text[run.start() : end])
            at = end
        yield self._bpe.encode_ordinary(text[at:] if at else text)

    def _run(self, blanks: str) -> list[int]:
        return self._bpe._encode_single_piece(blanks)

    def ids(self, text: str) -> np.ndarray:
        out, at = array(self._code), 0
        for mark in self._cut.finditer(text) if self._cut else ():
            for part in self._parts(text[at : mark.start()]):
                out.extend(part)
            out.append(self._added[mark[0]])
            at = mark.end()
        for part in self._parts(text[at:] if at else text):
            out.extend(part)
        return np.frombuffer(out, dtype=self.dtype)


#: Characters whose class, lower case and normal form are the same in every Unicode version: Latin, Cyrillic and common marks.
_STEADY = re.compile("[\t-\r -~¡-±´-¸º»¿-įı-ǃǍ-ǰǴ-ȠȢ-ʯЀ-҂Ҋ-ԧ–-―‘-•…€]*")
#: Words of such texts: contractions, letters, single digits, other marks.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class WordBPE:
    """Ids of texts, as the `tokenizers` library gives them for its JSON file of a byte-level BPE with word ends, over NFC,
    lower case and words of the usual pattern. Texts of steady characters are cut into words here and encoded by `tiktoken`, in
    a quarter of the time; other texts, and those with an added token, go to the library as a whole."""

    DTYPE = "<u2"

    def __init__(self, path: str):
        self._library = Tokenizer.from_file(path)
        made = json.loads(Path(path).read_text("utf-8"))
        model, byte_of = made["model"], _byte_of()
        if model["end_of_word_suffix"] != "</w>" or len(model["vocab"]) > 65_536:
            raise ValueError(f"{path}: not a BPE with word ends and 16-bit ids")
        # The end of a word is a byte of its own, a control character that no steady text holds; it is merged first.
        ranks = {}
        for token, i in model["vocab"].items():
            word, end = (token[:-4], b"\x01") if token.endswith("</w>") else (token, b"")
            if all(c in byte_of for c in word) and word:
                ranks[bytes(byte_of[c] for c in word) + end] = i
        self._added = [t["content"] for t in made.get("added_tokens", ())]
        self._bpe = tiktoken.Encoding(Path(path).stem, pat_str=r"[^\x01]*\x01", mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype(self.DTYPE)

    def ids(self, text: str) -> np.ndarray:
        if any(t in text for t in self._added) or not _STEADY.fullmatch(text):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        words = _WORD.findall(text.lower())
        return np.array(self._bpe.encode_ordinary("\x01".join([*words, ""])), dtype=self.dtype)
