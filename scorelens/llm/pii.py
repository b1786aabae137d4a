"""Operator 8: personal data by rules and by candidate gradient boosting.

Rules find the plain forms (they always stay).  High-recall generators propose more, overlapping spans
of four kinds; boosted trees score them by format and context, and those over their kind's threshold
that touch no chosen span are added, best first.  The trees learn from examples of both sorts (written
by a grammar) put into contexts that come from a bounded sample of the corpus; a kind's threshold is
the least with the wanted precision on examples kept back.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.llm.boosting import BoostedTrees
from scorelens.llm.common import free_name, replace_columns

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
# The look-behinds change no match (a match always starts at the start of a run of digits), but keep
# long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])


def digits_of(s: str) -> list[int]:
    return [int(c) for c in s if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(odd) + sum(d * 2 - 9 * (d > 4) for d in even)) % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end and (found := DOMAIN.match(text, at)):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = found.end()
                yield "email", start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' spans by start, then kind; each kind leftmost and without overlaps."""
    out = list(_emails(text)) if "@" in text else []
    first = DIGIT.search(text)
    if first:
        out += [("ip", *m.span()) for m in IP.finditer(text, first.start()) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text, first.start()):
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- candidates -----------------------------------------------------------------------------------

NUMBER_RUN = re.compile(r"[0-9][0-9\x20().\[\]/:-]*[0-9]")
GROUP = re.compile(r"[0-9]+")
#: Digits that a candidate takes at most, and characters between two of its groups of digits.
DIGITS, GAP = 19, 3
#: Range of the hashes by which contexts are chosen.
RANGE = 2**52
#: Characters around a found span in which candidates are judged again.
NEAR = 24
#: The sign of an address: @, or "at" between blanks or brackets.
AT = re.compile(r"\x20?[\[(]?\x20?(?:@|(?<=[\x20\[(])at(?=[\x20\])]))\x20?[\])]?\x20?", re.IGNORECASE)
HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(](?:\.|dot)[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]+)+", re.IGNORECASE)
USER = re.compile(r"[A-Za-z0-9._%+-]+")
#: Words that announce a kind.
CUES = {
    "email": ["mail", "contact", "write", "kontakt", "correo", "courriel"],
    "ip": ["ip", "host", "server", "address", "adresse", "ping"],
    "card": ["card", "visa", "credit", "karte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "call", "fax", "mobile", "anruf"],
}


def _windows(text: str, start: int, stop: int):
    """Spans of neighbouring groups of digits with 7 to 19 digits: at most 19 from a group, so linear in the run."""
    groups = [m.span() for m in GROUP.finditer(text, start, stop)]
    if len(groups) < 2:
        return
    for i, (s, e) in enumerate(groups):
        n = 0
        for a, b in groups[i : i + DIGITS]:
            n += b - a
            if n > DIGITS or a - e > GAP:
                break
            e = b
            if n >= 7:
                yield s, e


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data, overlapping, of high recall: runs of numbers, their parts between
    blanks, neighbouring groups of digits in them, and all that stands around a sign of an address."""
    out = []
    first = DIGIT.search(text)
    for m in NUMBER_RUN.finditer(text, first.start()) if first else ():
        start, stop = m.span()
        apart = re.finditer(r"[^\x20]+(?:\x20[^\x20]+){0,4}", m[0]) if "  " in m[0] else ()
        alone = re.finditer(r"[^\x20]+", m[0]) if " " in m[0] else ()
        whole = [(start, stop), *((start + x.start(), start + x.end()) for x in alone), *((start + x.start(), start + x.end()) for x in apart)]
        for s, e in dict.fromkeys([*whole, *_windows(text, start, stop)]):
            while e > s and not "0" <= text[e - 1] <= "9":
                e -= 1
            if text[s - 1 : s].isalpha() or text[e : e + 1].isalpha():
                continue  # inside a word, such as a hexadecimal token
            n = sum("0" <= c <= "9" for c in text[s:e])
            before = s
            while before > 0 and text[before - 1] in "+(" and s - before < 2:
                before -= 1
            if 7 <= n <= 15:
                out += [("phone", b, e) for b in {s, before}]
            if 12 <= n <= DIGITS:
                out.append(("card", s, e))
            if 4 <= n <= 12 and text.count(".", s, e) >= 3:
                out.append(("ip", s, e))
    signs = list(AT.finditer(text))
    users = {m.end(): m.start() for m in USER.finditer(text)} if signs else {}
    for m in signs:
        host = HOST.match(text, m.end()) if m.start() in users else None
        if host:
            out.append(("email", users[m.start()], host.end()))
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and what stands around it."""
    s = text[start:end]
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    digits = digits_of(s)
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 12].lower()
    last, following = text[start - 1 : start], text[end : end + 1]
    parts = s.split(".")
    return [
        KINDS.index(kind), len(s), len(digits), len(groups), groups[0], groups[-1], max(groups), min(groups),
        s.count(" "), s.count("-"), s.count("."), s.count("("), s.count("/") + s.count(":"), s[:1] == "+", s[:1] in ("(", "0"),
        bool(digits) and luhn(digits), digits[0] if digits else -1, len(set(digits)),
        len(parts) == 4 and all(p.isdigit() and int(p[:4]) <= 255 for p in parts),
        "@" in s, " dot " in s.lower(), "(at)" in s.lower() or "[at]" in s.lower(), " at " in s.lower(), len(s) - len(digits),
        any(w in before for w in CUES[kind]), any(w in before for k in KINDS if k != kind for w in CUES[k]),
        last.isalnum(), last in "$#=.-", following.isalnum(), following in "%.,-/", "no" in before[-5:] or "#" in before[-3:], "%" in after[:2],
        before.rstrip(" +(")[-1:].isdigit(), after.lstrip(" +(")[:1].isdigit(), groups[1] if len(groups) > 1 else 0,
    ]


# --- examples -------------------------------------------------------------------------------------


def _valid_card(rng, n: int) -> str:
    d = [int(rng.integers(3, 7)), *rng.integers(0, 10, n - 2)]
    return "".join(map(str, d)) + next(str(c) for c in range(10) if luhn([*d, c]))


def _cut_at(s: str, sizes: list[int], sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(s[at : at + n])
        at += n
    return sep.join(filter(None, [*out, s[at:]]))


def example(rng) -> tuple[str, str | None]:
    """A span of personal data and its kind, or something alike and None."""
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstuvw"), rng.integers(3, 9)))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    kind = int(rng.integers(8))
    if kind == 0:
        at, dot = pick(("@", "."), ("@", "."), (" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "))
        return f"{word()}{pick('.', '_', '')}{pick(word(), num(2))}{at}{"".join(pick(word(), word()[:1]) + dot for _ in range(pick(1, 1, 1, 2, 4, 9)))}{pick('com', 'org', 'de', 'fr')}", "email"
    if kind == 1:
        return pick(".", ".", "[.]").join(str(x) for x in rng.integers(0, 256, 4)), "ip"
    if kind == 2:
        n = pick(13, 14, 15, 16, 16, 16, 19)
        sizes, sep = pick(([], ""), ([4, 4, 4], " "), ([4, 4, 4], "-"), ([4, 4, 4], "."), ([4, 6], " "))
        return _cut_at(_valid_card(rng, n), sizes, sep), "card"
    if kind == 3:
        area, mid, tail = num(3), num(3), num(4)
        return pick(f"({area}) {mid}-{tail}", f"{area}-{mid}-{tail}", f"{area}.{mid}.{tail}", f"+1 ({area}) {mid}-{tail}", f"+{pick('44', '49', '33', '34')} {area} {num(7)}", f"00{pick('44', '49')} {area} {mid} {tail}", f"0{num(3)} {num(6)}", f"0{num(3)}/{num(7)}", f"{area} {mid} {tail}"), "phone"
    if kind == 4:
        wrong = _valid_card(rng, 16)
        wrong = wrong[:-1] + str((int(wrong[-1]) + int(rng.integers(1, 10))) % 10)
        return _cut_at(wrong, *pick(([], ""), ([4, 4, 4], " "), ([4, 4, 4], "-"))), None
    if kind == 5:
        return pick(f"20{num(2)}-0{pick(*'123456789')}-1{num(1)}", f"1{num(1)}/0{pick(*'123456789')}/20{num(2)} 1{num(1)}:3{num(1)}", f"{num(2)}:{num(2)}:{num(2)}.{num(3)}", f"19{num(2)}-20{num(2)}", " ".join(str(1900 + x) for x in rng.integers(0, 130, 6))), None
    if kind == 6:
        return pick(f"{num(3)}.{num(3)}.{num(3)},{num(2)}", f"3.{num(9)}", f"{num(1)}.{num(2)}.{num(1)}", f"1.{num(1)}.{num(4)}.{num(2)}", f"{rng.integers(256, 999)}.{num(3)}.{num(2)}.{num(1)}", f"{num(10)}", f"{num(8)}", f"{num(20)}"), None
    return pick(f"no {num(9)}", f"#{num(7)}", f"id {num(5)}-{num(5)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{word()} at {word()} dot", f"{num(2)} 1{num(1)} 2{num(1)} 3{num(1)}", f"{num(4)} {num(4)} {num(2)}", f"{word()} at {word()}. {word()}", f"@{word()}"), None


class Finder:
    """The fitted trees and thresholds; ``spans`` gives all spans of a text."""

    def __init__(self, contexts: list[str], examples: int = 8000, precision: float = 0.98, seed: int = 11):
        rng = np.random.default_rng(seed)
        rows, labels, kinds = [], [], []
        contexts = [c for c in contexts if c] or ["and the of"]
        for _ in range(examples):
            c = contexts[int(rng.integers(len(contexts)))]
            cut = c.find(" ", int(rng.integers(len(c))))
            head, tail = (c[: cut + 1], c[cut:]) if cut >= 0 else (c + " ", "")
            s, kind = example(rng)
            if rng.random() < 0.2 and kind:
                head += CUES[kind][int(rng.integers(6))] + " "
            if kind in ("card", "phone") and rng.random() < 0.4:  # a number beside it, or one of its sort
                other = next(x for x in iter(lambda: example(rng), None) if x[1] == kind)[0] if rng.random() < 0.5 else "".join(map(str, rng.integers(0, 10, int(rng.integers(1, 6)))))
                head, tail = (f"{head}{other} ", tail) if rng.random() < 0.5 else (head, f" {other}{tail}")
            text = head + s + tail
            for k, start, end in candidates(text):
                if start < len(head) + len(s) and end > len(head):
                    rows.append(features(text, k, start, end))
                    labels.append(k == kind and (start, end) == (len(head), len(head) + len(s)))
                    kinds.append(KINDS.index(k))
        x, y, kinds = np.array(rows, float), np.array(labels, float), np.array(kinds)
        test = np.arange(len(x)) % 3 == 0
        self.trees = BoostedTrees().fit(x[~test], y[~test])
        p = self.trees.predict(x[test])
        self.thresholds = [self._threshold(p[kinds[test] == k], y[test][kinds[test] == k], precision) for k in range(len(KINDS))]

    @staticmethod
    def _threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
        order = np.argsort(-p)
        right = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
        good = np.flatnonzero(right >= precision)
        return max(0.5, float(p[order][good[-1]])) if len(good) else 2.0

    def spans(self, text: str) -> list[tuple[str, int, int, bool]]:
        base = base_spans(text)
        chosen = [(*s, True) for s in base]
        found = Intervals((s, e) for _, s, e in base)
        more = [c for c in dict.fromkeys(candidates(text)) if not found.meets(c[1], c[2])]
        by_start = sorted(range(len(more)), key=lambda i: more[i][1])
        starts = [more[i][1] for i in by_start]
        longest = max((e - s for _, s, e in more), default=0)
        todo, new, hidden = more, [(s, e) for _, s, e in base], Intervals()
        while todo:
            p = self.trees.predict(np.array([features(*self._shown(text, hidden, c)) for c in todo], float))
            for i in np.argsort(-p, kind="stable"):
                kind, s, e = todo[i]
                if p[i] >= self.thresholds[KINDS.index(kind)] and not found.meets(s, e):
                    found.add(s, e)
                    new.append((s, e))
                    chosen.append((kind, s, e, False))
            # what stands beside a found span is judged again, as if that were no number
            near = {by_start[k] for s, e in new for k in range(bisect.bisect_right(starts, s - NEAR - longest), bisect.bisect_left(starts, e + NEAR)) if more[by_start[k]][2] > s - NEAR}
            todo = [more[i] for i in sorted(near) if not found.meets(*more[i][1:])]
            new, hidden = [], found
        return sorted(chosen, key=lambda s: (s[1], KINDS.index(s[0])))

    @staticmethod
    def _shown(text: str, found: Intervals, c: tuple[str, int, int]) -> tuple[str, str, int, int]:
        """A candidate in its surroundings, with what has been found there as blanks."""
        kind, s, e = c
        start, stop = max(0, s - NEAR - 2), min(len(text), e + NEAR)
        around = text[start:stop]
        for a, b in found.within(start, stop):
            a, b = max(a, start) - start, min(b, stop) - start
            around = around[:a] + " " * (b - a) + around[b:]
        return around, kind, s - start, e - start


class Intervals:
    """Merged intervals in order."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def within(self, s: int, e: int):
        """Intervals that meet [s, e)."""
        return [(self.starts[i], self.ends[i]) for i in range(bisect.bisect_right(self.ends, s), bisect.bisect_left(self.starts, e))]

    def meets(self, s: int, e: int) -> bool:
        return bisect.bisect_right(self.ends, s) < bisect.bisect_left(self.starts, e)

    def add(self, s: int, e: int) -> None:
        """An interval that meets none."""
        i = bisect.bisect_left(self.starts, s)
        self.starts.insert(i, s)
        self.ends.insert(i, e)


def fit_finder(docs: DataFrame, text_col: str = "text", most_contexts: int = 400, width: int = 60) -> Finder:
    """Fit on contexts (``width`` code points from the middle) of ``most_contexts`` different texts at most, those
    with the least hashes: a bounded sample of the corpus, which copies don't fill."""
    t = F.col(text_col)
    middle = F.substring(t, F.greatest(F.floor(F.length(t) / 2).cast("int") - width // 2, F.lit(1)), F.lit(width))
    known = docs.where(F.length(t) > width).select(F.pmod(F.xxhash64(t), F.lit(RANGE)).alias("h"), middle.alias("c"))
    different = known.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    share = min(1.0, (2 * most_contexts + 100) / max(different, 1))
    while True:
        sample = known.where(F.col("h") < F.lit(int(share * RANGE))).distinct().orderBy("h", "c").limit(most_contexts).collect()
        if len(sample) >= most_contexts or share >= 1:
            return Finder([r["c"] for r in sample])
        share = min(1.0, 4 * share)


def find_pii(docs: DataFrame, finder: Finder | None = None, text_col: str = "text", spans_col: str = "pii_spans", output: list[str] | None = None) -> DataFrame:
    """All rows of ``docs``, its columns (or those in ``output``) and ``pii_spans``: kind, start, end (code
    points, end exclusive) and whether the rules found it, by start, then kind.

    Null or empty text: no spans.  Repeated rows get equal spans, an empty table an empty one; an input
    column of that name is replaced."""
    finder = finder or fit_finder(docs, text_col)
    text = free_name(docs, "pii_text")
    keep = [c for c in replace_columns(docs, [spans_col]) if output is None or c in output]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(spans_col, T.ArrayType(SPAN))])

    def run(batches):
        for batch in batches:
            found = [finder.spans(t) if t else [] for t in batch.column(text).to_pylist()]
            spans = pa.array([[dict(zip(SPAN.names, s)) for s in x] for x in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])))
            yield pa.record_batch([*(batch.column(c) for c in keep), spans], names=[*keep, spans_col])

    return docs.select(*keep, F.col(text_col).alias(text)).mapInArrow(run, schema)


def redact(docs: DataFrame, finder: Finder | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (spans that overlap by the first's).

    A null text stays null, an empty table gives an empty one; other columns, and rows without spans, stay as they are."""
    finder = finder or fit_finder(docs, text_col)

    def clean(text: str | None) -> str | None:
        out, at = [], 0
        for kind, start, end, _ in finder.spans(text) if text else []:
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            texts = pa.array([clean(t) for t in batch.column(i).to_pylist()], batch.schema.field(i).type)
            yield batch.set_column(i, batch.schema.field(i), texts)

    return docs.mapInArrow(run, docs.schema)
