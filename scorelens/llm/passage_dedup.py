"""Operator 5: repeated passages by MinHash bands over short paragraphs.

A text is cut into units: sentences inside a line, those under five words joined to the next.  As the
host's punctuation cuts them, a text also has blocks: ``min_words`` words from each anchor, the position
whose block start hashes least among ``min_words`` positions.  Anchors depend on the words alone, so of
any 2 * min_words - 1 words that two texts share, also from the middle of a sentence or over line ends,
at least one block is the same in both.

1. Bands: a unit has ``bands`` keys, each the least of one hash function over its 5-word shingles
   (one row a band: texts that share no shingle never collide, and recall is 1 - 0.2**bands at
   similarity 0.8).  Keys that units of two documents share stay: a batch of texts knows some of them itself
   (their rows are spread at will, and one mark a key goes to the key's home); all other rows are
   shuffled once, by key, and pass if their key has a mark or a second document.
2. Colliding units are collapsed to classes of equal units.  Units of common words collide by chance, in pairs
   that grow with the square of the corpus: a bucket's classes are first held against each other by sketches
   alone (64 bits a unit, a lower bound of the shingles that two units do not share), and only those that some
   other one may be similar to are looked up in the texts.  These are compared by exact Jaccard similarity of
   their shingles, and links give components.
3. A component that two documents hold is a repeat, as is a block (equal ones only): it stays in the
   smallest id.  Runs of neighbouring repeated units and blocks of ``min_words`` words or more are the
   passages that are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import blocks_of, came_in, mix64, stored, with_id
from scorelens.llm.components import components
from scorelens.llm.shingles import _ODD, similar

SHINGLE = 5
#: Shingles of texts that are hashed together, and key rows that leave a worker together.
TOGETHER, SENT = 65_536, 100_000
#: Classes that one call verifies, and classes up to which the list of units to verify is broadcast.
GATHER, BROADCAST_CLASSES = 20_000, 2_000_000
#: Classes of a bucket up to which it is compared together with others.
FEW = 32
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_END = np.isin(np.arange(256), list(b".!?"))


class Units:
    """Units of texts, with the words found and hashed by array operations alone.

    A word's hash is a polynomial of its bytes modulo 2**64, taken from running sums, then mixed."""

    BASE = int(_ODD[50])

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int):
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            self.powers, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x % 2**64, np.uint64)])) for x in (self.BASE, pow(self.BASE, -1, 2**64)))

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end word) of each unit and the shingle hash at each word position."""
        b = np.frombuffer((text or "").encode().lower(), np.uint8)
        blank = np.concatenate([[True], _BLANK[b], [True]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, stops = edges[::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if len(b) >= len(self.powers):
            self._grow(len(b))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.powers[: len(b)])])
        h = mix64((sums[stops] - sums[starts]) * self.inverse[starts] + (stops - starts).astype(np.uint64) * _ODD[51])
        n = max(len(h) - SHINGLE + 1, 0)
        acc = np.zeros(n, np.uint64)
        for j in range(SHINGLE if n else 0):
            acc += mix64(h[j : j + n] + _ODD[j])
        line = np.searchsorted(np.flatnonzero(b == 10), starts)
        line_end = np.append(line[1:] != line[:-1], True)
        cuts = np.flatnonzero(line_end | _END[b[stops - 1]])
        first, line_first, out = 0, 0, []
        for cut, last in zip((cuts + 1).tolist(), line_end[cuts].tolist()):
            if cut - first >= SHINGLE:
                out.append([first, cut])
                first = cut
            if last:
                if first < cut and len(out) > line_first:
                    out[-1][1] = cut  # a short last sentence joins the one before
                first, line_first = cut, len(out)
        u = np.array(out, np.int64).reshape(-1, 2)
        return u[:, 0], u[:, 1], mix64(acc)


def unit_keys(first: np.ndarray, end: np.ndarray, shingles: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit (equal for equal shingles) and its band keys, one row a unit."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros((0, bands), np.int64)
    at = np.stack([first, end - SHINGLE + 1], 1).ravel()
    over = lambda values, how, last: how.reduceat(np.append(values, last), at)[::2]
    cls = mix64(over(mix64(shingles), np.add, np.uint64(0)) + (end - first).astype(np.uint64))
    keys = [over(mix64(shingles * _ODD[20 + b]), np.minimum, np.uint64(2**64 - 1)) ^ np.uint64(b) for b in range(bands)]
    return cls.view(np.int64), np.stack(keys, 1).view(np.int64)


def bits(shingles: np.ndarray) -> np.ndarray:
    """One of 64 bits for each shingle."""
    return np.uint64(1) << (shingles >> np.uint64(58))


def unit_sketches(first: np.ndarray, end: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The bits of each unit's shingles."""
    if not len(first):
        return np.zeros(0, np.int64)
    at = np.stack([first, end - SHINGLE + 1], 1).ravel()
    return np.bitwise_or.reduceat(np.append(bits(shingles), np.uint64(0)), at)[::2].view(np.int64)


def may_be_similar(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with the sketches ``a`` and ``b`` can reach ``percent`` of similarity; ``sizes`` is the sum of
    their sizes, or more.  A bit that one sketch lacks is a shingle that its set lacks, so no similar pair is lost."""
    return (100 + percent) * np.bitwise_count(a ^ b).astype(np.int64) <= (100 - percent) * sizes


def blocks(shingles: np.ndarray, size: int, texts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, class, key) of the blocks of ``size`` words: one in any ``size`` neighbouring positions.

    Class and key are two 64-bit hashes of the same words: a block is a repeat only if both are.

    Neighbours of one class (words that repeat with a short period) are thinned, without a gap.
    ``texts`` has the numbers of shingles of several texts that stand one after another; no block crosses two, and
    first words are positions in the whole array."""
    texts = np.array([len(shingles)]) if texts is None else texts
    begin = np.cumsum(texts) - texts
    n = np.maximum(texts - size + SHINGLE, 0)  # where a block may start
    begin, n = begin[n > 0], n[n > 0]
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = np.cumsum(n)
    text = np.repeat(np.arange(len(n)), n)
    places = np.arange(stop[-1]) + (begin - (stop - n))[text]
    order = mix64(shingles[places] ^ _ODD[52])
    at = [a + int(order[a:b].argmin()) for a, b in zip((stop - n)[n < size].tolist(), stop[n < size].tolist())]
    if len(order) >= size:
        least = np.lib.stride_tricks.sliding_window_view(order, size).argmin(axis=1) + np.arange(len(order) - size + 1)
        at = np.append(at, least[text[: len(least)] == text[size - 1 :]])
    at = np.unique(np.asarray(at, np.int64))
    text, at = text[at], places[at]
    cls, key = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j, start in enumerate([*range(0, size - SHINGLE, SHINGLE), size - SHINGLE]):
        cls = mix64(cls + shingles[at + start] * _ODD[53] + np.uint64(j + 1))
        key = mix64(key ^ (shingles[at + start] * _ODD[54] + np.uint64(j + 1)))
    new = np.append(True, (cls[1:] != cls[:-1]) | (text[1:] != text[:-1]))
    away = at - at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    part = away // max(size // 2, 1)
    keep = new | np.append(True, part[1:] != part[:-1]) | np.append(new[1:], True)
    return at[keep], cls[keep].view(np.int64), key[keep].view(np.int64)


#: What a row is: a key's mark, a row whose key may repeat, one whose key does, and a document's number of units.
MARK, OPEN, KNOWN, COUNT = range(4)
_ROW = {"key": "long", "kind": "int", "id": "long", "idx": "int", "start": "int", "stop": "int", "words": "int", "cls": "long", "sketch": "long"}
_KINDS = [np.int64 if t == "long" else np.int32 for n, t in _ROW.items() if n != "kind"]


def _several_ids(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each row's key stands with two different ids."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    last = np.append(first[1:], len(k)) - 1
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(i[first] != i[last], last - first + 1)
    return out


def _text_rows(ids: list[int], found: list[tuple], bands: int, min_words: int) -> tuple:
    """Key rows (key, id, idx, start, stop, words, cls, sketch) of some texts, from their units and shingles: one call of each
    array operation for all of them."""
    n_units, n_shingles = (np.array([len(x[i]) for x in found]) for i in (0, 2))
    offset = np.cumsum(n_shingles) - n_shingles
    first, end, shingles = (np.concatenate([x[i] for x in found]) for i in range(3))
    unit_text = np.repeat(np.arange(len(found)), n_units)
    cls, keys = unit_keys(first + offset[unit_text], end + offset[unit_text], shingles, bands)
    sketch = unit_sketches(first + offset[unit_text], end + offset[unit_text], shingles)
    at, block, block_key = blocks(shingles, min_words, n_shingles)
    block_text = np.searchsorted(offset + n_shingles, at, "right")
    at = at - offset[block_text]
    last = np.append(unit_text[1:] != unit_text[:-1], True)[: len(first)]
    stop = np.where(last, end, np.append(first[1:], 0)[: len(first)])
    ids, idx = np.array(ids, np.int64), np.arange(len(first)) - (np.cumsum(n_units) - n_units)[unit_text]
    m = len(at)
    rows = (
        np.concatenate([keys.T.ravel(), block_key]), np.concatenate([np.tile(ids[unit_text], bands), ids[block_text]]),
        np.concatenate([np.tile(idx, bands), np.full(m, -1)]), np.concatenate([np.tile(first, bands), at]),
        np.concatenate([np.tile(stop, bands), at + min_words]), np.concatenate([np.tile(end - first, bands), np.full(m, min_words)]),
        np.concatenate([np.tile(cls, bands), block]), np.concatenate([np.tile(sketch, bands), np.zeros(m, np.int64)]),
    )
    return tuple(x.astype(kind, copy=False) for x, kind in zip(rows, _KINDS))


def _key_rows(bands: int, min_words: int):
    """A row for each key of each unit (idx from 0) and block (idx -1); ``stop`` is the next unit's first word.
    ``home`` says where a row is shuffled to."""

    batch_of = lambda *columns: pa.record_batch([pa.array(x) for x in columns], names=[*_ROW, "home"])
    spread = lambda k, i: mix64(k.view(np.uint64) + mix64(i.view(np.uint64))).view(np.int64)

    def run(batches):
        units = Units()
        for batch in batches:
            parts: list[tuple] = []
            counts: list[tuple[int, int]] = []
            some, found, n = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = units(text)
                counts.append((i, len(got[0])))
                some.append(i)
                found.append(got)
                n += len(got[2])
                if n >= TOGETHER:
                    parts.append(_text_rows(some, found, bands, min_words))
                    some, found, n = [], [], 0
            if some:
                parts.append(_text_rows(some, found, bands, min_words))
            columns = [np.concatenate([x[j] for x in parts]) if parts else np.zeros(0, kind) for j, kind in enumerate(_KINDS)]
            parts.clear()
            key, ids = columns[:2]
            known = _several_ids(key, ids)
            kind = np.where(known, KNOWN, OPEN).astype(np.int32)
            for s in range(0, len(key), SENT):
                of = slice(s, s + SENT)
                yield batch_of(key[of], kind[of], *(x[of] for x in columns[1:]), np.where(known[of], spread(key[of], ids[of]), key[of]))
            marks = np.unique(key[known])
            of = np.array(counts, np.int64).reshape(-1, 2)
            own, units_of, none, nothing = of[:, 0].copy(), of[:, 1].astype(np.int32), np.zeros(len(of), np.int32), np.zeros(len(of), np.int64)
            yield batch_of(nothing, np.full(len(of), COUNT, np.int32), own, none, none, none, units_of, nothing, nothing, spread(nothing, own))
            none, nothing = np.zeros(len(marks), np.int32), np.zeros(len(marks), np.int64)
            yield batch_of(marks, np.full(len(marks), MARK, np.int32), nothing, none, none, none, none, nothing, nothing, marks)

    return run, ", ".join(f"{n} {t}" for n, t in _ROW.items()) + ", home long"


#: Two columns for the five small ones of a key row while it is shuffled, and the way back.  A text has fewer than 2**30 words.
_PACKED = {"place": "shiftleft(bigint(idx), 32) | bigint(start)", "rest": "shiftleft(bigint(stop) - start - words, 32) | shiftleft(bigint(words), 2) | kind"}
_UNPACKED = {
    "kind": "int(rest & 3)", "idx": "int(shiftright(place, 32))", "start": "int(place & 4294967295)",
    "stop": "int((place & 4294967295) + (shiftright(rest, 2) & 1073741823) + shiftright(rest, 32))", "words": "int(shiftright(rest, 2) & 1073741823)",
}


def _by_key(rows: DataFrame) -> DataFrame:
    """Key rows at their homes, sorted by key, kind and id."""
    packed = rows.select("key", "id", *(F.expr(x).alias(n) for n, x in _PACKED.items()), "cls", "sketch", "home")
    dealt = packed.repartition("home").drop("home").sortWithinPartitions("key", F.expr("rest & 3"), "id")
    return dealt.select(*(F.expr(_UNPACKED[n]).alias(n) if n in _UNPACKED else n for n in _ROW))


def _repeated(batches):
    """Rows sorted by key and kind to those whose key several ids have, and all known and count rows.

    Rows wait only while their key has shown a single id, so no key is held as a whole."""
    waiting, settled = None, None
    for batch in batches:
        batch = batch.select(list(_ROW))
        kind = batch.column("kind").to_numpy()
        direct = batch.filter(pa.array(kind >= KNOWN))
        if direct.num_rows:
            yield direct
        rows = batch.filter(pa.array(kind < KNOWN))
        if waiting is not None:
            rows = pa.Table.from_batches([waiting, rows]).combine_chunks().to_batches()
            rows, waiting = rows[0], None
        if not rows.num_rows:
            continue
        key, kind, ids = (rows.column(c).to_numpy() for c in ("key", "kind", "id"))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        low = np.minimum.reduceat(np.where(kind == OPEN, ids, np.iinfo(np.int64).max), first)
        high = np.maximum.reduceat(np.where(kind == OPEN, ids, np.iinfo(np.int64).min), first)
        good = np.logical_or.reduceat(kind == MARK, first) | (low < high)
        if settled is not None and key[0] == settled:
            good[0] = True
        settled = key[-1] if good[-1] else None
        if not good[-1]:
            waiting = rows.slice(int(first[-1]))
        out = rows.filter(pa.array(np.repeat(good, size) & (kind == OPEN)))
        if out.num_rows:
            yield out


def _set_rows():
    def run(batches):
        units = Units()
        for batch in batches:
            cls, sets = [], []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                first, end, shingles = units(text)
                own, wanted = unit_keys(first, end, shingles, 1)[0], set(wanted)
                for c, a, b in zip(own.tolist(), first, end):
                    if c in wanted:
                        wanted.discard(c)
                        cls.append(c)
                        sets.append(np.unique(shingles[a : b - SHINGLE + 1]).tobytes())
            yield pa.record_batch([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "set"])

    return run


def _with_partners(percent: int):
    """(key, cls, id) of the classes whose sketch leaves another class of their bucket (``sub``) as a similar one.
    ``words`` counts a shingle that repeats in its unit each time, so the sizes are never too small."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(np.argsort(t.column("sub").to_numpy(), kind="stable"))
        of, size = t.column("sub").to_numpy(), t.column("words").to_numpy().astype(np.int64) - SHINGLE + 1
        sketch, found = t.column("sketch").to_numpy().view(np.uint64), np.zeros(t.num_rows, bool)
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))[: t.num_rows]
        stop = np.append(first[1:], t.num_rows)[: len(first)]
        behind = np.repeat(stop, stop - first) - np.arange(t.num_rows) - 1  # rows of the same bucket that follow
        at, away = np.flatnonzero(np.repeat(stop - first <= FEW, stop - first)), 0
        while len(at := at[behind[at] > away]):  # all small buckets together
            away += 1
            hit = at[may_be_similar(sketch[at], sketch[at + away], size[at] + size[at + away], percent)]
            found[hit] = found[hit + away] = True
        for a, b in zip(first[stop - first > FEW].tolist(), stop[stop - first > FEW].tolist()):
            for i in range(a, b - 1):
                hit = may_be_similar(sketch[i], sketch[i + 1 : b], size[i] + size[i + 1 : b], percent)
                found[i] |= hit.any()
                found[i + 1 : b] |= hit
        return t.select(["key", "cls", "id"]).filter(pa.array(found))

    return run


def _verify(percent: int):
    def run(t: pa.Table) -> pa.Table:
        keys, cls, raw = t.column("key").to_numpy(), t.column("cls").to_numpy(), t.column("set").to_pylist()
        edges = set()
        order = np.argsort(keys, kind="stable")
        for g in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
            sets = [np.frombuffer(raw[i], np.uint64) for i in g]
            sizes = np.array([len(s) for s in sets])
            flat, starts, label = np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum(sizes) - sizes, np.arange(len(g))
            sketch = np.bitwise_or.reduceat(bits(flat), starts) if len(flat) else np.zeros(len(g), np.uint64)
            for lead in range(len(g)):  # each pair is compared, or joined already
                rows = lead + np.flatnonzero(label[lead:] != label[lead])
                if not len(rows):
                    if (label[lead:] == label[lead]).all():
                        break
                    continue
                rows = rows[may_be_similar(sketch[lead], sketch[rows], sizes[lead] + sizes[rows], percent)]
                rows = rows[similar(sets[lead], flat, starts, sizes, rows, percent)]
                if len(rows):
                    edges |= {(max(cls[g[lead]], cls[g[r]]), min(cls[g[lead]], cls[g[r]])) for r in rows}
                    label[np.isin(label, label[rows])] = label[lead]
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return run


def _dealt(held: DataFrame) -> DataFrame:
    """The rows (key, cls, blocks) with the number ``sub`` of their bucket, or of each pair of its blocks that holds them, and
    the ``part`` they are gathered in."""
    own = F.expr("pmod(xxhash64(cls), blocks)")
    with_others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    dealt = held.withColumn("pair", F.explode(with_others)).withColumn("sub", F.when(F.col("blocks") > 1, F.xxhash64("key", "pair.i", "pair.j")).otherwise(F.col("key")))
    parts = blocks_of(held.count(), GATHER)
    return dealt.withColumn("part", F.when(F.col("blocks") > 1, F.col("sub")).otherwise(F.expr(f"pmod(key, {parts}L)")))


def _held(pairs: DataFrame) -> DataFrame:
    """The rows (key, cls) of buckets of several classes, with the number of blocks they are dealt in."""
    sizes = pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / (GATHER // 4)).alias("blocks"))
    return pairs.join(sizes, "key")


def similar_classes(plain: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(cls, root) of the classes that share a bucket with another class, verified on full sets.

    A bucket that holds very many classes is dealt in blocks of its classes, in pairs."""
    pairs = members.where("idx >= 0").groupBy("key", "cls").agg(F.min("id").alias("id"), F.max("words").alias("words"), F.max("sketch").alias("sketch"))
    held = stored(_held(stored(pairs, "passage-pairs")), "passage-buckets")
    alike = _dealt(held).groupBy("part").applyInArrow(_with_partners(percent), "key long, cls long, id long").dropDuplicates(["key", "cls"])
    held = stored(_held(stored(alike, "passage-alike")), "passage-open")
    one = held.groupBy("cls").agg(F.min("id").alias("id"))
    wanted = stored(one.groupBy("id").agg(F.collect_list("cls").alias("wanted")), "passage-wanted")  # classes of one text
    classes = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    texts = plain.join(F.broadcast(wanted) if classes <= BROADCAST_CLASSES else wanted, plain["__id"] == wanted["id"])
    sets = texts.select(F.col("__text").alias("text"), "wanted").mapInArrow(_set_rows(), "cls long, set binary").dropDuplicates(["cls"])
    dealt = _dealt(held).select("part", F.col("sub").alias("key"), "cls")
    edges = dealt.join(sets, "cls").groupBy("part").applyInArrow(_verify(percent), "a long, b long")
    return components(edges, "passage-links").select(F.col("node").alias("cls"), "root")


def _ranges(held: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _runs(min_words: int):
    def run(t: pa.Table) -> pa.Table:
        columns = ("id", "idx", "start", "stop", "words", "keeper")
        got = [t.column(c).to_numpy() for c in columns]
        order = np.lexsort((got[1], got[2], got[0]))
        ids, idx, start, stop, words, keeper = (x[order] for x in got)
        rows = []
        for g in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1) if len(ids) else ():
            end = start[g] + words[g]
            reach = np.maximum.accumulate(np.maximum(stop[g], end))
            number = np.cumsum(np.append(False, start[g][1:] > reach[:-1]))
            before = np.append(0, np.maximum.accumulate(end)[:-1])
            long = np.bincount(number, np.maximum(end - np.maximum(start[g], before), 0))[number] >= min_words
            g = g[long]
            if not len(g):
                continue
            own, unit = int(ids[g[0]]), idx[g] >= 0
            n = int((start[g] + words[g]).max())

            def words_of(rows, n=n):
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, start[rows], 1)
                np.add.at(change, start[rows] + words[rows], -1)
                return np.cumsum(change)[:n] > 0

            units, block, stays = g[unit], g[~unit], keeper[g] == own
            seen = np.unique(idx[units], return_index=True)[1]  # rows that share an id are one document
            units = units[seen]
            gone = units[keeper[units] != own]
            outside = ~words_of(g[unit])
            kept = words_of(g[~unit & stays])
            lost = words_of(g[~unit & ~stays]) & outside & ~kept
            total = np.append(0, np.cumsum(lost))
            pieces = _ranges(lost)
            from_block = block[(keeper[block] != own) & (total[start[block] + words[block]] > total[start[block]])]
            ranges = [x for a, b in pieces for x in (a, b)]
            removed = np.append(gone, from_block)
            n_repeated = len(units) + len(pieces) + len(_ranges(kept & outside))
            rows.append((own, n_repeated, len(gone) + len(pieces), int(words[gone].sum() + lost.sum()), int(min(keeper[np.append(units, from_block)], default=own)), np.unique(keeper[removed]).tolist(), idx[gone].tolist(), ranges))
        names = ["id", "n_repeated", "n_removed", "words_removed", "class_id", "kept_in", "removed", "ranges"]
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 3
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, bands: int = 3, min_words: int = 25) -> DataFrame:
    """One row per id: n_units, n_repeated (units in passages that other ids hold too, and pieces of passages
    outside such units), n_removed and words_removed (what another id keeps), class_id (the smallest id that
    keeps one of its passages, or the own id), kept_in (ids that keep what is removed), removed (numbers of the
    removed units) and ranges (first and end word of each removed piece outside them, one after another).

    Null, empty or short texts have no units.  Rows that share an id are one document (their units are
    numbered each; a repeat between them is none).  A null id stays null and is the smallest id.  Equal texts of two ids
    lose all units in the larger.  An empty table gives an empty one.
    """
    plain = with_id(docs.select(F.col(id_col).alias("__in"), F.col(text_col).alias("__text")), "__in", "__id").select("__id", "__text")
    make, schema = _key_rows(bands, min_words)
    members = stored(_by_key(plain.mapInArrow(make, schema)).mapInArrow(_repeated, ", ".join(f"{n} {t}" for n, t in _ROW.items())), "passage-members")
    counts = members.where(f"kind = {COUNT}").groupBy("id").agg(F.sum("words").alias("n_units"))
    members = members.where(f"kind < {COUNT}")
    roots = similar_classes(plain, members, percent)
    colliding = members.select("id", "idx", "start", "stop", "words", "cls").distinct().join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    colliding = stored(colliding, "passage-colliding")
    repeats = colliding.groupBy("root").agg(F.min("id").alias("keeper"), F.max("id").alias("high")).where("keeper < high").select("root", "keeper")
    marked = colliding.join(repeats, "root").select("id", "idx", "start", "stop", "words", "keeper")
    parts = blocks_of(marked.count(), 50_000)
    schema = "id long, n_repeated long, n_removed long, words_removed long, class_id long, kept_in array<long>, removed array<long>, ranges array<long>"
    found = marked.withColumn("part", F.expr(f"pmod(xxhash64(id), {parts}L)")).groupBy("part").applyInArrow(_runs(min_words), schema)

    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_units", "n_repeated", "n_removed", "words_removed")]
    empty = F.array().cast("array<bigint>")
    return counts.join(found, "id", "left").select(
        came_in("id").alias(id_col), *zero, F.coalesce("class_id", "id").alias("class_id"),
        *(F.coalesce(c, empty).alias(c) for c in ("kept_in", "removed", "ranges")),
    )
