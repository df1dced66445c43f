"""Personal data by fixed patterns and a semi-Markov conditional random field (operator 2).

The base spans are those of four patterns with their checks. The field adds spans of the same kinds in forms that the
patterns don't have (a telephone number without its plus, a card number in other groups, an address with "(at)"), and a fifth
kind, secret: keys and passwords after a word that names them.
It reads windows of tokens around digits and at signs. Each candidate segment of at most LONGEST tokens (addresses: of any
number within WIDE characters, and never with a part of a local part or host) is scored as a whole, per kind, from features of its shape, its checks and its surroundings; dynamic programming over the ends of
segments, in which a token outside any segment scores nothing, chooses boundaries and kinds jointly.

The weights are fitted by the driver, by stochastic gradients of the conditional likelihood (forward and backward
sums over all segmentations), on at most `windows` windows around base spans, taken by smallest hash from all
documents, each also rewritten to the other forms and to look-alikes that are no personal data.

A base span always stays; spans of the field that overlap one are left out. Positions are code points, ends exclusive.

Edge cases: a null or empty text has no spans. Texts of any length are read in one pass; a run of digits or letters
is one token. Without a base span in any document the field adds none. Rows are independent; null and repeated
keys and further columns don't matter.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as Over

from skypairs.llm.columns import tidied
from skypairs.llm.words import slices

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds of the base patterns.
BASE = KINDS[:4]
WINDOWS, ROUNDS, RATE, DECAY = 1_200, 4, 0.3, 1e-4
LONGEST, REACH, WIDTH, WIDE = 14, 48, 72, 254
SLOTS = 1 << 14

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IN_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_HOST_GOES_ON = re.compile(r"\.?[A-Za-z0-9-]")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+\x20?(@|[\[(]at[\])])\x20?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Keys and passwords, by the word before them; at least sixteen characters with letters and digits.
_SECRET = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_NAMED = re.compile(r"(?i)(token|secret|passw(or)?d|pwd|key|auth|bearer|credential)s?[\"']?\s{0,2}[:=]?\s{0,2}[\"']?\Z")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^\sA-Za-z0-9]")
_ANCHOR = re.compile(r"[0-9]+|@|[\[(]at[\])]")
_SOME = r"[0-9@]|\[at\]|\(at\)"
_DIGITS = re.compile(r"[0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        # the local part can only be the run of its characters before this sign
        start = at
        while start > end and _LOCAL.match(text, start - 1, start):
            start -= 1
        if start < at and (host := _HOST.match(text, at + 1)):
            yield start, host.end()
            end = host.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, by kind as listed, then start."""
    out = [("email", *s) for s in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) < 4 and int(p[-4:]) < 256 for p in m.group().split("."))]
    for kind, pattern, low, high in (("card", _CARD, 16, 19), ("phone", _PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = _only_digits(m.group())
            if low <= len(digits) <= high and (kind != "card" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def _secret_at(text: str, start: int) -> int:
    """Where a key or password that begins there ends, or 0."""
    found = _SECRET.match(text, start)
    if not found or start and _SECRET.match(text[start - 1] * 16) or not _NAMED.search(text, max(0, start - 24), start):
        return 0
    value = found.group()
    return found.end() if len(value) <= WIDE and any(map(str.isdigit, value)) and any(map(str.isalpha, value)) else 0


def examples_in(text: str) -> list[Span]:
    """Spans to learn from: the base spans, and keys and passwords after a word that names them."""
    named = (m.end() for m in re.finditer(r"(?i)(token|secret|passw(or)?d|pwd|key|auth|bearer|credential)s?[\"']?\s{0,2}[:=]?\s{0,2}[\"']?", text))
    return base_spans(text) + [("secret", a, b) for a in named if (b := _secret_at(text, a))]


@lru_cache(maxsize=1 << 16)
def _of_segment(segment: str) -> tuple[int, ...]:
    """Numbers of the features of a segment as a whole."""
    groups = _DIGITS.findall(segment)
    digits = "".join(groups)
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda m: str(min(len(m.group()), 9)), segment))
    marks = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", segment))))
    names = ["bias", f"digits={min(len(digits), 20)}", f"groups={min(len(groups), 7)}", f"marks={marks[:8]}",
             f"first={_class(segment[0])}", f"last={_class(segment[-1])}", f"letters={bool(re.search('[A-Za-z]', segment))}"]
    if not re.search("[A-Za-z]", segment):
        names.append(f"shape={shape[:40]}")
    if "@" in segment or "at)" in segment or "at]" in segment:
        local, _, host = re.sub(r" ?[\[(]at[\])] ?", "@", segment).partition("@")
        good = bool(_LOCAL.fullmatch(local)) and bool(_HOST.fullmatch(host))
        names += [f"address={good}", f"host={host.count('.') if good else -1}"]
    if len(groups) == 4 and set(marks) == {"."} and len(shape) == 7:
        names.append(f"parts={all(len(g) < 4 and int(g) < 256 for g in groups)}")
    if 13 <= len(digits) <= 19:
        names.append(f"luhn={luhn(digits)}")
    return tuple(zlib.crc32(n.encode()) % SLOTS for n in names)


def _class(char: str) -> str:
    return "0" if char.isdigit() else "a" if char.isalpha() else "_" if char.isspace() or not char else char


@lru_cache(maxsize=1 << 14)
def _of_sides(before: str, after: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(n.encode()) % SLOTS for n in (f"before={_class(before)}", f"after={_class(after)}"))


_NAMES_IT = (zlib.crc32(b"named") % SLOTS,)


class Window:
    """Tokens of a stretch of text and its candidate segments: bounds in tokens, and features."""

    def __init__(self, text: str, begin: int, end: int):
        self.tokens = [m.span() for m in _TOKEN.finditer(text, begin, end)]
        self.ends: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(len(self.tokens) + 1)]
        useful = [bool(_ANCHOR.match(text, a)) for a, _ in self.tokens]
        blank = [text[a].isspace() for a, _ in self.tokens]
        at_end = {b: k for k, (_, b) in enumerate(self.tokens)}
        for i, (start, _) in enumerate(self.tokens):
            if blank[i] or not (text[start].isalnum() or text[start] in "+(._%-"):
                continue
            some = at = False
            inside = start > 0 and bool(_IN_LOCAL.match(text, start - 1))
            for j in range(i, min(i + LONGEST, len(self.tokens))):
                a, stop = self.tokens[j]
                if stop - start > WIDTH or blank[j] and (stop - a > 1 or text[a] != " "):
                    break
                some, at = some or useful[j], at or text[a] in "@[(" and useful[j]
                if at:
                    good = not inside and not _HOST_GOES_ON.match(text, stop)
                else:
                    good = text[start] not in "._%-" and sum(map(str.isdigit, text[start:stop])) > 5
                if some and good and text[a].isalnum():
                    self._add(text, i, j)
            # an address of more tokens is a candidate as a whole
            whole = None if inside else _ADDRESS.match(text, start)
            if whole and (j := at_end.get(whole.end())) is not None and whole.end() - start <= WIDE:
                if j >= i + LONGEST or whole.end() - start > WIDTH:
                    self._add(text, i, j)
            # so is a key or password; its feature is that something names it
            if (stop := _secret_at(text, start)) and (j := at_end.get(stop)) is not None:
                self._add(text, i, j, _NAMES_IT)

    def _add(self, text: str, i: int, j: int, more: tuple[int, ...] = ()) -> None:
        start, stop = self.tokens[i][0], self.tokens[j][1]
        sides = _of_sides(text[start - 1:start], text[stop:stop + 1])
        self.ends[j + 1].append((i, _of_segment(text[start:stop]) + sides + more))


def _windows(text: str) -> Iterator[Window]:
    begin = end = -1
    for m in _ANCHOR.finditer(text):
        if m.start() - REACH > end and end >= 0:
            yield Window(text, begin, end)
            begin = -1
        floor = max(end, 0)
        if begin < 0:
            begin = max(0, m.start() - REACH)
        end = min(len(text), m.end() + REACH)
        if not text[m.start()].isdigit():  # addresses are taken whole
            while begin > floor and m.start() - begin < WIDE and _IN_LOCAL.match(text, begin - 1):
                begin -= 1
            while end < len(text) and end - m.end() < WIDE and _HOST_GOES_ON.match(text, end):
                end += 1
    if end >= 0:
        yield Window(text, begin, end)


class Field:
    """Weights by kind and feature."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self._known: dict[tuple[int, ...], tuple[int, float]] = {}

    def _best_kind(self, features: tuple[int, ...]) -> tuple[int, float]:
        if features not in self._known:
            if len(self._known) > 1 << 16:
                self._known = {}
            by_kind = self.weights[:, list(features)].sum(axis=1)
            self._known[features] = int(by_kind.argmax()), float(by_kind.max())
        return self._known[features]

    def best(self, window: Window) -> list[Span]:
        """The segments of the best segmentation, and their kinds."""
        top, back = [0.0], [None]
        for j, found in enumerate(window.ends[1:], 1):
            score, step = top[j - 1], None
            for i, features in found:
                k, value = self._best_kind(features)
                if top[i] + value > score:
                    score, step = top[i] + value, (i, k)
            top.append(score)
            back.append(step)
        out, j = [], len(back) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((KINDS[k], window.tokens[i][0], window.tokens[j - 1][1]))
                j = i
        return out[::-1]

    def step(self, window: Window, spans: list[Span], seen: np.ndarray) -> None:
        """One gradient step towards the given segmentation."""
        w, n = self.weights, len(window.ends)
        scores = [[(i, f, w[:, list(f)].sum(axis=1)) for i, f in found] for found in window.ends]
        forward, backward = [0.0] + [-math.inf] * (n - 1), [-math.inf] * (n - 1) + [0.0]
        for j in range(1, n):
            forward[j] = _total([forward[j - 1], *(forward[i] + s for i, _, by in scores[j] for s in by)])
        for j in range(n - 1, 0, -1):
            backward[j - 1] = _total([backward[j - 1], backward[j]])
            for i, _, by in scores[j]:
                backward[i] = _total([backward[i], *(backward[j] + s for s in by)])
        true = {(a, b): KINDS.index(k) for k, a, b in spans}
        for j in range(1, n):
            for i, f, by in scores[j]:
                grad = -np.exp(forward[i] + by + backward[j] - forward[-1])
                if (k := true.get((window.tokens[i][0], window.tokens[j - 1][1]))) is not None:
                    grad[k] += 1
                if np.abs(grad).max() > 1e-3:
                    at = list(f)
                    seen[:, at] += (grad * grad)[:, None]
                    w[:, at] += RATE * (grad[:, None] / np.sqrt(seen[:, at] + 1e-2) - DECAY * w[:, at])


def _total(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def _forms(kind: str, value: str, rng: random.Random) -> list[tuple[str, bool]]:
    """Other ways to write a value, and look-alikes (False)."""
    d = _only_digits(value)
    n = "".join(rng.choice("0123456789") for _ in range(rng.randint(6, 12)))
    if kind == "phone":
        c = d[-10:].rjust(10, "5")
        return [(f"({c[:3]}) {c[3:6]}-{c[6:]}", True), (f"{c[:3]}-{c[3:6]}-{c[6:]}", True), (f"{c[:3]}.{c[3:6]}.{c[6:]}", True),
                (f"00{d[:2]} {c[:3]} {c[3:]}", True), (n, False), (f"{c[0]},{c[1:4]},{c[4:7]},{c[7:]}", False), (f"20{c[:2]}-{c[2:4]}-{c[4:6]}", False)]
    if kind == "card":
        wrong = d[:-1] + str((int(d[-1]) + rng.randint(1, 9)) % 10)
        return [(".".join(d[k:k + 4] for k in range(0, len(d), 4)), True), (wrong, False), (n + n, luhn(n + n) and None)]
    if kind == "secret":
        turned = value[1:] + value[0]
        return [(turned, True), (value.upper(), True), (n, False)]
    if kind == "ip":
        p = value.split(".")
        return [(".".join([str(300 + rng.randint(0, 600)), *p[1:]]), False), (".".join(p[:3]), False), (".".join([*p, "7"]), False)]
    local, _, host = value.partition("@")
    return [(f"{local}(at){host}", True), (f"{local} [at] {host}", True), (f"{local}@", False), (n, False)]


def fit(examples: list[tuple[str, str]]) -> Field:
    """From windows (text with the value between two NUL characters, kind) and their rewritten forms."""
    rng, weights, seen = random.Random(7), np.zeros((len(KINDS), SLOTS)), np.zeros((len(KINDS), SLOTS))
    field, cases = Field(weights), []
    for text, kind in examples:
        before, value, after = text.split("\0")
        for form, good in [(value, True), *_forms(kind, value, rng)]:
            if good is not None:
                # the surroundings may hold other spans; those are known to be right
                whole = before + form + after
                here = (kind, len(before), len(before) + len(form))
                spans = [s for s in examples_in(whole) if s[2] <= here[1] or s[1] >= here[2]] + [here] * good
                cases += [(w, spans) for w in _windows(whole)]
    for _ in range(ROUNDS):
        rng.shuffle(cases)
        for window, spans in cases:
            field.step(window, spans, seen)
    return Field(weights)


def spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by kind as listed, then start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    more = []
    for window in _windows(text):
        for span in field.best(window):
            k = int(np.searchsorted(starts, span[2], "left"))
            if not k or reach[k - 1] <= span[1]:
                more.append(span)
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _with(docs: DataFrame, key: str, text: str, make, types: str) -> DataFrame:
    """Rows made from texts that hold a digit or an at sign; other texts give `make` nothing to do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            some = pc.match_substring_regex(batch.column(1), _SOME).to_pylist()
            yield make(batch.column(0), batch.column(1), some)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(tidied(run, _of_segment, _of_sides), types.replace("KEY", kind))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", windows: int = WINDOWS) -> Field:
    """Weights from at most `windows` windows around base spans of the documents."""
    def make(keys: pa.Array, texts: pa.Array, some: list[bool]) -> pa.RecordBatch:
        out = []
        for k in np.flatnonzero(some):
            t = texts[k].as_py().replace("\0", " ")
            out += [("\0".join((t[max(0, a - REACH):a], t[a:b], t[b:b + REACH])), kind)
                    for kind, a, b in examples_in(t) if b - a <= WIDTH]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*out) if out else ([], []))], ["example", "kind"])

    found = _with(docs, key, text, make, "example string, kind string").distinct()
    # the same share for each kind, so that a rare one is learnt as well
    lowest = Over.partitionBy("kind").orderBy(F.xxhash64("example"), "example")
    rows = found.withColumn("n", F.row_number().over(lowest)).filter(F.col("n") <= windows // len(KINDS)).collect()
    return fit(sorted((r["example"], r["kind"]) for r in rows))


def find(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and spans of each text; both are arrays of kind, start, end."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make(keys: pa.Array, texts: pa.Array, some: list[bool]) -> pa.RecordBatch:
        both = [spans(texts[k].as_py(), field) if odd else ([], []) for k, odd in enumerate(some)]
        return pa.RecordBatch.from_arrays(
            [keys, *(pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in b[k]] for b in both], span)
                     for k in (0, 1))], ["key", "base", "spans"])

    one = "array<struct<kind string, start int, end int>>"
    return _with(docs, key, text, make, f"key KEY, base {one}, spans {one}").withColumnRenamed("key", key)


def masked(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The table with each span of the text replaced by its kind in brackets; overlapping ones by that which starts
    first. Other columns are as they were."""
    def mask(t: str) -> str:
        out, end = [], 0
        for kind, a, b in sorted(spans(t, field)[1], key=lambda s: (s[1], -s[2])):
            if a >= end:
                out += [t[end:a], f"[{kind.upper()}]"]
            end = max(end, b)
        return "".join([*out, t[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at)
            some = pc.fill_null(pc.match_substring_regex(texts, _SOME), False).to_pylist()
            if any(some):
                new = [mask(t) if odd else t for t, odd in zip(texts.to_pylist(), some, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, texts.type))
            yield batch

    return docs.mapInArrow(tidied(run, _of_segment, _of_sides), docs.schema)
