"""Token ids of whole texts under a word-level BPE file, by distinct words.

The tokenizer's pre-tokens never cross white space, so each distinct word is
tokenised once and texts are assembled from word ids by array gathers.  Words of
plain Latin characters go through a byte-pair engine that takes all new words of a
batch in one call; its ranks are derived from the file's merges, which is exact
where every merged token's own last merge is the listed one (a test checks the file).
All other words go through the file's own tokenizer.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import repeat

import numpy as np

from .words import Words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MARK = "\x01"
#: Words a worker remembers; beyond that it forgets and starts anew.
MEMORY = 300_000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand
    for themselves, all others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()

        def raw(token: str) -> bytes:
            body, mark = (token[: -len(end)], MARK.encode()) if token.endswith(end) else (token, b"")
            return bytes(letters[c] for c in body) + mark

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Marked single bytes merge before all else: they are symbols of the vocabulary.
        singles = [(bytes([b]) + MARK.encode(), c + end) for c, b in letters.items()] + [(bytes([b]), c) for c, b in letters.items()]
        self.merges = [(raw(a), raw(b)) for a, b in pairs]
        ranks = {r: i for i, (r, _) in enumerate(singles)}
        ids = [vocab.get(t, -1) for _, t in singles]
        for (a, b), (x, y) in zip(pairs, self.merges):
            ranks.setdefault(x + y, len(ids))
            ids.append(vocab[a + b])
        self.ranks, self.ids = ranks, np.array(ids, np.int64)
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{MARK}\n]+{MARK}", mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.strange = regex.compile(r"[^\n!-~¡-¬®-įĲ-ɏ]|<\|")
        self.ends = np.zeros(len(ids), bool)
        for r, i in ranks.items():
            self.ends[i] = r.endswith(MARK.encode())
        self.known: dict[bytes, int] = {}
        self.flat, self.ptr = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each word; words hold no line breaks."""
        text = "\n".join(words) + "\n"
        starts = np.cumsum(np.array([0, *map(len, words)], np.int64) + 1)[:-1] - 1
        starts[0] = 0
        odd = np.unique(np.searchsorted(starts, [m.start() for m in self.strange.finditer(text)], "right") - 1)
        if len(odd):
            lines = list(words)
            for i in odd.tolist():
                lines[i] = ""
            text = "\n".join(lines) + "\n"
        text = self.pieces.sub("\\g<0>" + MARK, text.lower())
        raw = np.frombuffer(text.encode(), np.uint8)
        marks = np.cumsum(raw == ord(MARK))[raw == 10]
        codes = np.array(self.fast.encode_ordinary(text), np.int64)
        stops = np.concatenate([[0], np.flatnonzero(self.ends[codes]) + 1])
        bounds = np.concatenate([[0], stops[marks]])
        ids, counts = self.ids[codes].astype(np.uint32), np.diff(bounds)
        if len(odd):
            found = self.slow.encode_batch([words[i] for i in odd.tolist()], add_special_tokens=False)
            ids = np.insert(ids, np.repeat(bounds[odd], [len(e.ids) for e in found]), [x for e in found for x in e.ids])
            counts[odd] = [len(e.ids) for e in found]
        return ids.astype(np.uint32), counts

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words in order, and pointers of the documents into them."""
        codes = words.strings().dictionary_encode()
        distinct = codes.dictionary.to_pylist()
        if not distinct:
            return np.zeros(0, np.uint32), np.zeros(words.docs + 1, np.int64)
        if len(self.known) > MEMORY:
            self.known, self.flat, self.ptr = {}, self.flat[:0], self.ptr[:1]
        slot = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            new = [distinct[i] for i in fresh.tolist()]
            ids, counts = self.encode_words(b"\n".join(new).decode().split("\n"))
            first = len(self.known)
            self.flat = np.concatenate([self.flat, ids])
            self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum(counts)])
            self.known.update(zip(new, range(first, first + len(new))))
            slot[fresh] = np.arange(first, first + len(new))
        place = slot[np.asarray(codes.indices)]
        start = self.ptr[place]
        count = self.ptr[place + 1] - start
        ends = np.cumsum(count)
        take = np.arange(int(ends[-1])) + np.repeat(start - (ends - count), count)
        return self.flat[take], np.concatenate([[0], ends])[words.ptr]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each file and worker process."""
    return WordTokenizer(path)
