"""Byte-pair ids of many texts, as the ``tokenizers`` library makes them, each different chunk encoded once.

A byte-level vocabulary splits texts before the merges, and always in front of a blank that stands
before a character that is not white space.  So a text's ids are the ids of its blank-led chunks in
order; chunks recur, and are remembered (up to a bound).
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

from scorelens.llm.common import ragged

END_POINTS = ".,;:!?"
#: Fixed value: the pattern by which byte-level vocabularies of this kind split texts.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _shown_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabulary files write bytes: printable ones stand for
    themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def encoder(tokenizer_file: str):
    """A function from texts to lists of ids (no special tokens added).

    ``tokenizers`` makes them.  Where the file is a plain byte-level vocabulary whose ids are in the order
    of its merges, ``tiktoken`` gives the same ids of short chunks in half the time, and is used for
    texts in which no added token stands."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark shares out the work
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_file)
    by_file = lambda texts: [e.ids for e in slow.encode_batch_fast(texts, add_special_tokens=False)]
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    own = {t["content"] for t in spec.get("added_tokens", [])}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    ordered = model.get("type") == "BPE" and all(model["vocab"].get(m) == 256 + i for i, m in enumerate(merges))
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
    if not (ordered and plain and not model.get("ignore_merges")):
        return by_file
    import tiktoken

    byte = _shown_bytes()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in own}
    fast = tiktoken.Encoding("chunks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [by_file([t])[0] if any(x in t for x in own) else fast.encode_ordinary(t) for t in texts]

    return encode


@functools.lru_cache(1)
def chunk_ids(tokenizer_file: str) -> ChunkIds:
    """One for each Python worker, with what earlier tasks have learned."""
    return ChunkIds(tokenizer_file)


class ChunkIds:
    def __init__(self, tokenizer_file: str, most: int = 900_000):
        self._encode, self.most = encoder(tokenizer_file), most
        self._forget()

    def _forget(self):
        self.numbers = _Numbers()
        self.starts, self.lengths, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def _learn(self):
        """Ids of the chunks met for the first time.  A word with end points is the word's ids and theirs."""
        new = self.numbers.new
        self.numbers.new = []
        plain, composed = {}, []
        for key, number in new:
            if key[:1] != " " and (not key or key[0].isspace()):
                self._put(number, [], -1)  # the cut before it is not one of the rule's
                continue
            core = key.rstrip(END_POINTS)
            if core != key and core[-1:].isalpha():
                composed.append((number, core, key[len(core):]))
                if core not in self.numbers and core not in plain:
                    plain[core] = None
            else:
                plain[key] = number
        texts = [k[1:] if k[0] == " " else " " + k for k in plain]
        for (key, number), ids in zip(plain.items(), self._encode(texts)):
            if number is None:
                number = self.numbers[key]
                self.numbers.new.pop()
            self._put(number, ids, len(ids))
        found = sorted({e for _, _, e in composed})
        ends = dict(zip(found, self._encode(found)))
        for number, core, end in composed:
            at = self.numbers[core]
            ids = [*self.flat[self.starts[at] : self.starts[at] + self.lengths[at]], *ends[end]]
            self._put(number, ids, len(ids))

    def _put(self, number: int, ids: list[int], length: int):
        if number >= len(self.starts):
            self.starts, self.lengths = (np.resize(x, max(number + 1, 2 * len(x))) for x in (self.starts, self.lengths))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(self.used + len(ids), 2 * len(self.flat)))
        self.starts[number], self.lengths[number] = self.used, length
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32 arrays."""
        if len(self.numbers) > self.most:
            self._forget()
        parts, counts = [], []
        for text in texts:
            own = text.split(" ")
            own[0] = " " + own[0]  # a first chunk has no blank before it; no other key has a blank
            parts += own
            counts.append(len(own))
        numbers = np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts))
        self._learn()
        lengths = self.lengths[numbers]
        first = np.cumsum([0, *counts])[:-1]
        strange = np.minimum.reduceat(lengths, first) < 0 if len(texts) else np.zeros(0, bool)
        lengths = np.maximum(lengths, 0)
        flat = self.flat[ragged(self.starts[numbers], lengths)]
        ends = np.cumsum(np.add.reduceat(lengths, first)) if len(texts) else []
        out = np.split(flat, ends[:-1]) if len(texts) else []
        for i in np.flatnonzero(strange):
            out[i] = np.array(self._encode([texts[i]])[0], np.uint32)
        return out


class _Numbers(dict):
    """Numbers of keys by first use; ``new`` lists those not yet learned."""

    def __init__(self):
        super().__init__()
        self.new: list[tuple[str, int]] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append((key, n))
        return n
