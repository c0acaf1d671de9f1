"""Token ids of whole texts by a public word BPE, quickly and exactly.

A vocabulary whose pieces end words with a marker, that splits words off by one pattern and drops white space,
gives each blank-separated word ids of its own. Words are therefore encoded once per block of texts (and mostly found
in a bounded cache), and rare words go through a byte-level merge table in which the end marker is the byte 0xFF, which
UTF-8 never has. Words outside plain Latin script, and special tokens, take the tokenizers library itself.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from tokenizers import Tokenizer

from palimpsest.llm.words import split

#: Words in the cache of one worker; beyond, it starts anew with the words of the current block.
CACHE_WORDS = 1_000_000
# The vocabulary's own word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What the quick way takes: printable ASCII, Latin letters, common marks.
_PLAIN = regex.compile(r"[\x21-\x7e¡-¬®-ɏ‐-‧€]+")
#: Ends a piece, and ends a word, while words are encoded together; neither is in a plain word.
_END, _NEXT = b"\x01", b"\n"


def _byte_of_char() -> dict[str, int]:
    """The usual printable alphabet of byte-level BPE: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, alphabet = model["end_of_word_suffix"], _byte_of_char()
        made = {"".join(pair): i for i, m in enumerate(model["merges"]) for pair in [m.split(" ") if isinstance(m, str) else m]}
        ranks = {bytes([b]): b for b in range(256)}
        of_rank = {}
        for piece, i in model["vocab"].items():
            if piece in ("<|startoftext|>", "<|endoftext|>"):
                continue
            end = piece.endswith(suffix) and len(piece) > len(suffix)
            raw = bytes(alphabet[c] for c in (piece[: -len(suffix)] if end else piece)) + _END * end
            # A last byte takes its end marker first of all; then the merges follow in their own order.
            ranks.setdefault(raw, 512 + made[piece] if piece in made else 256 + raw[0])
            of_rank[ranks[raw]] = i
        self.core = tiktoken.Encoding("words", pat_str=r"[^\x01\n]+\x01|\n", mergeable_ranks=ranks, special_tokens={})
        self.of_rank = np.zeros(max(ranks.values()) + 1, np.uint16)
        self.of_rank[list(of_rank)] = list(of_rank.values())
        self.pieces = regex.compile(PATTERN)
        self._clear()

    def _clear(self) -> None:
        self.known, self.start, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        texts = [x.decode("utf-8", "replace") for x in raw]
        odd = [i for i, t in enumerate(texts) if not _PLAIN.fullmatch(t) or "<|" in t]
        others = {i: self.slow.encode(texts[i], add_special_tokens=False).ids for i in odd}
        for i in odd:
            texts[i] = ""
        joined = "\n".join([*texts, ""]).lower()
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined)
        ranks = np.array(self.core.encode_ordinary(self.pieces.sub("\\g<0>\x01", joined)), np.int64)
        at = np.flatnonzero(ranks == _NEXT[0])
        size = np.diff(at, prepend=-1) - 1
        ids = self.of_rank[np.delete(ranks, at)]
        if odd:
            end = np.cumsum(size)
            parts, last = [], 0
            for i in odd:
                parts += [ids[last : end[i]], np.array(others[i], np.uint16)]
                last, size[i] = end[i], len(others[i])
            ids = np.concatenate([*parts, ids[last:]])
        return ids, size

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of the texts in them)."""
        w = split(texts)
        if not len(w.start):
            return np.zeros(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
        every, first, number = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self._clear()
        new = np.flatnonzero(~np.isin(every, self.known, assume_unique=True))
        if len(new):
            data = w.data.tobytes()
            ids, size = self.words([data[s:e] for s, e in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)])
            start = len(self.flat) + np.cumsum(size) - size
            known = np.concatenate([self.known, every[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.flat = known[order], np.concatenate([self.flat, ids])
            self.start, self.size = np.concatenate([self.start, start])[order], np.concatenate([self.size, size])[order]
        at = np.searchsorted(self.known, every)[number]
        each = self.size[at]
        ends = np.cumsum(each)
        source = np.repeat(self.start[at] - (ends - each), each) + np.arange(ends[-1])
        return self.flat[source], np.concatenate([[0], ends])[w.bounds]
