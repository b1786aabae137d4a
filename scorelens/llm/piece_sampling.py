"""Operator 3: sampled segmentations over a piece lattice, reproducible by row key, and decoding.

The lattice of a text has an edge for each piece of the vocabulary that matches; a character without a
piece is an edge of its byte pieces.  No piece has a blank after another character, so the lattice
falls apart into segments (blanks and the word after them), and each different segment is filtered
forward once: the weight of all ways to each node.  Then all occurrences are sampled backward together,
one edge of each at a step, with random numbers that depend on seed, row key, place and step alone.

A piece of rank r weighs (1 + r) ** -alpha (Zipf's law for vocabularies that carry ranks, not
probabilities).  Texts are not normalised, blanks are the pieces' sign for blanks and all else without
a piece is bytes, so decoding gives each text back exactly.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm.common import guarded, mix64, ragged, replace_columns

BLANK = "▁"
#: Texts sampled at once.
SLICE = 128


class Pieces:
    """Ids, ranks and bytes of a SentencePiece vocabulary."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids, self.rank, self.raw, self.byte = {}, {}, [], [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                if BLANK in piece.lstrip(BLANK):
                    raise ValueError("a piece has a blank inside: segments are not independent")
                self.ids[piece] = i
                self.raw.append(piece.replace(BLANK, " ").encode())
        for r, i in enumerate(sorted(self.ids.values(), key=lambda i: (-model.get_score(i), i))):
            self.rank[i] = r
        self.longest = max(map(len, self.ids))
        self.length = np.array([len(r) for r in self.raw], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the lists ids[offsets[i]:offsets[i+1]]."""
        lengths = self.length[ids]
        raw = self.flat[ragged(self.start[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


@functools.lru_cache(2)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


@functools.lru_cache(2)
def sampler(model_file: str, alpha: float) -> Sampler:
    """One for each Python worker, with the segments that earlier tasks have filtered."""
    return Sampler(pieces(model_file), alpha)


END_POINTS = ".,;:!?|%$&*#"


_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Ends(dict):
    """End node of each segment met so far; ``new`` lists the segments still to be filtered."""

    def __init__(self):
        super().__init__()
        self.nodes, self.new = 0, []

    def __missing__(self, s: str) -> int:
        self.nodes += 2 if s[:1] == "\0" and len(s) == 2 else len(s) + 1
        self.new.append(s)
        node = self[s] = self.nodes - 1
        return node


class _Grown:
    """An array that is added to; ``room`` for more is kept, so most additions copy nothing old."""

    def __init__(self, kind):
        self.room, self.used = np.zeros(1 << 16, kind), 0

    def add(self, x: np.ndarray):
        if self.used + len(x) > len(self.room):
            room = np.empty(int(1.3 * (self.used + len(x))), self.room.dtype)
            room[: self.used] = self.room[: self.used]
            self.room = room
        self.room[self.used : self.used + len(x)] = x
        self.used += len(x)


class Sampler:
    def __init__(self, vocabulary: Pieces, alpha: float, most: int = 250_000):
        self.v, self.most, self.known = vocabulary, most, len(vocabulary.raw)
        self.joined = {p[i : i + 2] for p in vocabulary.ids for i in range(len(p) - 1)}
        names = list(vocabulary.ids)
        hashes = np.array([self._hash(p) for p in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.piece = hashes[order], np.array([vocabulary.ids[p] for p in names], np.int64)[order]
        self.weight = (1.0 + np.array([vocabulary.rank[i] for i in self.piece])) ** -alpha
        self.maybe = np.zeros(2**20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self._forget()

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % 2**64
        return h

    def _forget(self):
        self.ends = _Ends()
        # of nodes: first edge (-1: a start); of edges: share of the ways up to it, source node, what it emits
        self.arrays = [_Grown(kind) for kind in (np.int32, float, np.int32, np.int32)]
        self.extra: list[list[int]] = []  # byte pieces of characters that have none

    def segments(self, text: str) -> list[str]:
        """Parts of a text that no piece crosses: blanks with the word after them, end points, line
        ends.  A literal blank sign stands alone, with a mark before it."""
        out: list[str] = []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append("\n")
            if BLANK in line or "  " in line or line[:1] == " " or line[-1:] == " ":
                words = self._odd(line)
            else:
                words = (BLANK + line.replace(" ", " " + BLANK)).split(" ")
                words[0] = words[0][1:]
            for word in words:
                core = word.rstrip(END_POINTS)
                if core is word or not core:
                    if word:
                        out.append(word)
                elif core[-1] + word[len(core)] in self.joined:
                    out.append(word)
                else:
                    out += (core, word[len(core) :])
        return out

    @staticmethod
    def _odd(line: str) -> list[str]:
        out, gap = [], ""
        for i, word in enumerate(line.split(" ")):
            gap += BLANK if i else ""
            for j, part in enumerate(word.split(BLANK)):
                if j:
                    out += [gap, "\0" + BLANK]
                    gap = ""
                if part:
                    out.append(gap + part)
                    gap = ""
        return [*out, gap]

    def _edges(self, chars, room, literal):
        """(first character, length, weight, what it emits) of all edges."""
        h, alone, out = np.zeros(len(chars), np.uint64), np.ones(len(chars), bool), []
        at = np.arange(len(chars))
        for size in range(1, self.v.longest + 1):
            at = at[room[at] >= size]
            h[at] = h[at] * _BASE + chars[at + size - 1] + np.uint64(1)
            some = at[self.maybe[(h[at] >> np.uint64(44)).astype(np.int64)] & ~literal[at]]
            row = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            hit = self.hashes[row] == h[some]
            some, row = some[hit], row[hit]
            out.append((some, np.full(len(some), size), self.weight[row], self.piece[row]))
            if size == 1:
                alone[some] = False
        some = np.flatnonzero(alone)
        out.append((some, np.ones(len(some), np.int64), np.ones(len(some)), self.known + len(self.extra) + np.arange(len(some))))
        self.extra += [[self.v.byte[b] for b in chr(c).encode()] for c in chars[some].tolist()]
        return [np.concatenate(x) for x in zip(*out)]

    def _filter(self, new: list[str]) -> None:
        """Forward filtering of new segments, all together, character by character."""
        literal_segment = np.array([s[:1] == "\0" and len(s) == 2 for s in new])
        plain = [s[1:] if x else s for s, x in zip(new, literal_segment)]
        sizes = np.array([len(s) for s in plain], np.int64)
        chars = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32).astype(np.uint64)
        segment = np.repeat(np.arange(len(new)), sizes)
        local = ragged(np.zeros(len(new), np.int64), sizes)
        source, size, weight, emit = self._edges(chars, sizes[segment] - local, literal_segment[segment])
        to = local[source] + size
        order = np.lexsort((source, to))
        source, size, weight, emit, to = (x[order] for x in (source, size, weight, emit, to))
        node = source + segment[source]  # each earlier segment has one node more than characters
        target = node + size
        ways, share, first_edge = np.zeros(len(chars) + len(new)), np.zeros(len(source)), np.full(len(chars) + len(new), -1, np.int64)
        ways[np.cumsum(sizes + 1) - sizes - 1] = 1.0
        cuts = np.searchsorted(to, np.arange(1, int(sizes.max()) + 2))
        for low, high in zip(cuts[:-1], cuts[1:]):
            w, own = ways[node[low:high]] * weight[low:high], target[low:high]
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            total, count = np.add.reduceat(w, begin), np.diff(np.append(begin, len(own)))
            part = np.cumsum(w / np.repeat(total, count))
            share[low:high] = part - np.repeat(np.append(0.0, part[begin[1:] - 1]), count)
            share[low + begin + count - 1] = 1.0
            ways[own[begin]], first_edge[own[begin]] = total, low + begin
            for end in own[begin[total < 1e-200]]:  # a very long segment: keep the weights in range
                ways[end - self.v.longest + 1 : end + 1] /= ways[end]
        base = self.arrays[0].used, self.arrays[1].used
        first_edge[first_edge >= 0] += base[1]
        for array, x in zip(self.arrays, (first_edge, share, node + base[0], emit)):
            array.add(x)

    def __call__(self, texts: list[str], row_keys: np.ndarray) -> list[np.ndarray]:
        """Sampled ids of each text; ``row_keys`` (uint64) seed them."""
        if not texts:
            return []
        if len(self.ends) > self.most:
            self._forget()
        parts = [self.segments(t) for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        node = np.fromiter(map(self.ends.__getitem__, itertools.chain.from_iterable(parts)), np.int64, int(counts.sum()))
        if self.ends.new:
            self._filter(self.ends.new)
            self.ends.new = []
        first_edge, share, source, emit = (a.room for a in self.arrays)
        place = ragged(np.zeros(len(counts), np.int64), counts).astype(np.uint64)
        seeds = mix64(np.repeat(row_keys, counts) + place * np.uint64(0x9E3779B97F4A7C15))
        alive, steps, length = np.arange(len(node)), [], np.zeros(len(node), np.int64)
        while len(alive):  # one step back of every segment that has not reached its start
            u = (mix64(seeds[alive] + np.uint64(len(steps) + 1)) >> np.uint64(11)).astype(float) * 2.0**-53
            edge = first_edge[node]
            low = np.flatnonzero(share[edge] <= u)
            while len(low):
                edge[low] += 1
                low = low[share[edge[low]] <= u[low]]
            steps.append((alive, emit[edge]))
            length[alive] += 1
            node = source[edge]
            on = first_edge[node] >= 0
            alive, node = alive[on], node[on]
        first = np.cumsum(length) - length
        emitted = np.zeros(int(length.sum()), np.int32)
        for t, (who, what) in enumerate(steps):
            emitted[first[who] + length[who] - 1 - t] = what
        cuts = np.append(first, len(emitted))[np.cumsum(counts)[:-1]]
        out = []
        for ids in np.split(emitted, cuts):
            if len(ids) and ids.max() >= self.known:
                ids = np.array([y for x in ids.tolist() for y in (self.extra[x - self.known] if x >= self.known else (x,))])
            out.append(ids.astype(np.int32))
        return out


@guarded
def sample_encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, seed: int = 0,
                  ids_col: str = "ids") -> DataFrame:
    """All rows and columns of ``docs`` with ``ids``, a sampled segmentation (array<int>).

    Seeded by ``seed`` and the row's id (null: a value of its own), so rows with equal id and text get equal
    ids wherever they run.  Null or empty text: no ids.  An empty table gives an empty one; an input
    column named like the added one is replaced."""
    keep = replace_columns(docs, [ids_col])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches):
        sample = sampler(model_file, alpha)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                keys = [xxhash.xxh3_64_intdigest(f"{seed}/{i}") for i in batch.column("__piece_id").to_pylist()]
                ids = sample([t or "" for t in batch.column("__piece_text").to_pylist()], np.array(keys, np.uint64))
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                yield pa.record_batch([*(batch.column(c) for c in keep), lists], names=[*keep, ids_col])

    return docs.select(*keep, F.col(id_col).alias("__piece_id"), F.col(text_col).alias("__piece_text")).mapInArrow(run, schema)


@guarded
def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """All rows and columns with ``decoded``, the text of the ids ('' for null or none; ids that don't
    spell UTF-8 give the replacement character)."""
    keep = replace_columns(encoded, [decoded_col])
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField(decoded_col, T.StringType())])

    def run(batches):
        vocabulary = pieces(model_file)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                lists = batch.column("__piece_ids")
                sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = vocabulary.decode(ids, np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, decoded_col])

    return encoded.select(*keep, F.col(ids_col).alias("__piece_ids")).mapInArrow(run, schema)
