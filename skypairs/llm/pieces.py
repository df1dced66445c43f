"""Encoding and decoding with merge-type (BPE) vocabularies of the sentencepiece library (operator 13).

Blanks become U+2581 and one is put before a text that isn't empty. The adjacent symbols whose joined string is a piece
stand on an agenda ordered by the piece's score, highest first, the leftmost of equals first; the head of the
agenda merges and its new neighbours go on the agenda, until it is empty. A character that no piece covers in the end becomes the
ids of its UTF-8 bytes.

No piece goes from a word on to a blank (a vocabulary that has such a piece is refused), so runs of blanks with the
word that follows have agendas of their own, and each distinct run of a task is worked on once. `Agenda.long` is one
agenda as a heap; `Agenda.short` takes the heads of many short agendas at once, as rows of a matrix. Every
distinct run is also encoded by the library in the same Arrow batch; a text with a run that the library encodes otherwise says so
in the column `agrees`.

Decoding joins the pieces, leaves out control symbols and the blank that encoding put first, and reads runs of byte
pieces as UTF-8, with U+FFFD for each byte that is none.

Edge cases: a null or empty text has only the begin and end ids and decodes to an empty text. Null ids decode to an
empty text. Repeated rows, repeated or null keys and further columns don't matter: rows are independent, only the key and
the results are returned. A text of any length is one row. Vocabularies with user-defined or unused pieces, another
normalizer than the identity, or blanks removed, are refused.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from skypairs.llm.columns import binary_column, binary_rows, flat, ranges, tidied
from skypairs.llm.words import Remembered, row_totals, slices

BLANK = "▁"
NONE = 2**31 - 1
#: Runs of more characters get a heap each.
SHORT = 48
#: Rows of a matrix of agendas.
ROWS = 1 << 14
#: Pairs are looked up in a table of 2^SLOTS.
SLOTS = 20
_RUN = re.compile(f"{BLANK}+[^{BLANK}]*")


class Vocabulary:
    """What a model file says: pieces, scores, and what each id decodes to."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as data:
            model.ParseFromString(data.read())
        kind, spec = type(model.pieces[0]), model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("not a merge-type vocabulary with byte pieces")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only the identity as normalizer, with a blank put first and none removed")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.size = len(model.pieces)
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.unknown = model.trainer_spec.unk_surface
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.scores = np.array([p.score for p in model.pieces], np.float32)
        self.of_byte = np.zeros(256, np.int32)
        self.text: list[bytes] = []
        self.kinds = np.zeros(self.size, np.int8)  # 0 ordinary, 1 byte, 2 control, 3 unknown
        for k, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                byte = int(p.piece[3:5], 16)
                self.of_byte[byte], self.kinds[k] = k, 1
                self.text.append(bytes([byte]))
            elif p.type in (kind.CONTROL, kind.UNKNOWN):
                self.kinds[k] = 2 if p.type == kind.CONTROL else 3
                self.text.append(b"" if p.type == kind.CONTROL else self.unknown.encode())
            else:
                self.text.append(p.piece.replace(BLANK, " ").encode())


class Agenda:
    """Ids of runs, by merges in the order of their scores. A character without a piece has the number size + code point."""

    def __init__(self, vocabulary: Vocabulary):
        ids, size = vocabulary.ids, vocabulary.size
        if odd := [p for p in ids if BLANK in p.lstrip(BLANK)]:
            raise ValueError(f"pieces cross from a word into a blank: {odd[:5]}")
        self.size, self.of_byte = size, vocabulary.of_byte
        self.space = size + 0x110000
        self.of_char = np.arange(size, self.space, dtype=np.int32)
        for piece, k in ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = k

        def symbol(part: str) -> int | None:
            return ids.get(part, size + ord(part) if len(part) == 1 else None)

        order = np.unique(-vocabulary.scores, return_inverse=True)[1]
        pairs = {}
        for piece, k in ids.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.space + right] = k
        self.keys = np.array([*sorted(pairs), np.iinfo(np.int64).max])
        self.joined = np.array([*(pairs[k] for k in self.keys[:-1].tolist()), 0], np.int32)
        self.place = np.append(order[self.joined[:-1]], NONE).astype(np.int32)
        slot = self._slot(self.keys)
        shared = np.bincount(slot, minlength=1 << SLOTS)[slot] > 1
        self.slots = np.full(1 << SLOTS, len(self.keys) - 1, np.int32)  # number of the only key of a slot
        self.slots[slot] = np.where(shared, -1, np.arange(len(self.keys)))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).view(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place on the agenda (NONE: no piece) and piece of joined symbols."""
        key = left.astype(np.int64) * self.space + right
        at = self.slots[self._slot(key)]
        if len(several := np.flatnonzero(at < 0)):
            at[several] = np.searchsorted(self.keys, key[several])
        at[self.keys[at] != key] = len(self.keys) - 1
        return self.place[at], self.joined[at]

    def _bytes_for_unknown(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = ids >= self.size
        if not odd.any():
            return ids, lengths
        chars = ids[odd] - self.size
        counts = np.ones(len(ids), np.int64)
        counts[odd] = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        out, odd = np.repeat(ids, counts), np.repeat(odd, counts)
        data = "".join(map(chr, chars.tolist())).encode()
        out[odd] = self.of_byte[np.frombuffer(data, np.uint8)]
        ends = np.cumsum(lengths)
        return out, row_totals(counts, np.concatenate([[0], ends]))

    def encode(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs one after another, and how many each has."""
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        chars = self.of_char[np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)]
        starts = np.cumsum(sizes) - sizes
        lengths = np.zeros(len(runs), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # runs, and their ids one after another
        short = np.flatnonzero(sizes <= SHORT)
        short = short[np.argsort(sizes[short], kind="stable")]
        for begin in range(0, len(short), ROWS):
            some = short[begin:begin + ROWS]
            ids, lengths[some] = self.short(chars[ranges(starts[some], sizes[some])], sizes[some])
            parts.append((some, ids))
        for k in np.flatnonzero(sizes > SHORT):
            ids = self.long(chars[starts[k]:starts[k] + sizes[k]])
            lengths[k] = len(ids)
            parts.append((np.array([k]), ids))
        out = np.empty(lengths.sum(), np.int32)
        at = np.cumsum(lengths) - lengths
        for some, ids in parts:
            out[ranges(at[some], lengths[some])] = ids
        return self._bytes_for_unknown(out, lengths)

    def short(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Many agendas at once: a turn takes the head of each, the least place in its row."""
        if not len(sizes):
            return symbols, sizes
        n, width = len(sizes), int(sizes.max()) + 1
        filled = np.arange(width) < sizes[:, None]
        ids = np.zeros(n * width, np.int32)
        where = np.flatnonzero(filled)
        ids[where] = symbols
        place, piece = np.full(n * width, NONE, np.int32), np.zeros(n * width, np.int32)
        pair = where[np.flatnonzero(filled.reshape(-1)[where + 1])]
        place[pair], piece[pair] = self.look_up(ids[pair], ids[pair + 1])
        after, before = np.arange(1, n * width + 1, dtype=np.int32), np.arange(-1, n * width - 1, dtype=np.int32)
        alive = filled.reshape(-1)
        table, rows = place.reshape(n, width), np.arange(n)
        start, end = np.arange(n) * width, np.arange(n) * width + sizes
        while len(rows):
            head = start[rows] + (table if len(rows) == n else table[rows]).argmin(axis=1)
            busy = place[head] != NONE
            rows, head = rows[busy], head[busy]
            gone = after[head]
            ids[head] = joined = piece[head]
            alive[gone], place[gone], place[head] = False, NONE, NONE
            after[head] = following = after[gone]
            inner = following < end[rows]
            h, f = head[inner], following[inner]
            before[f] = h
            place[h], piece[h] = self.look_up(joined[inner], ids[f])
            left = before[head]
            inner = left >= start[rows]
            b = left[inner]
            place[b], piece[b] = self.look_up(ids[b], joined[inner])
        return ids[alive], alive.reshape(n, width).sum(axis=1)

    def long(self, symbols: np.ndarray) -> np.ndarray:
        """One agenda as a heap of (place, left symbol, piece, right symbol); entries whose symbols have changed are passed over."""
        places, pieces = self.look_up(symbols[:-1], symbols[1:])
        ids, n = symbols.tolist(), len(symbols)
        agenda = [(p, k, piece, ids[k], ids[k + 1])
                  for k, (p, piece) in enumerate(zip(places.tolist(), pieces.tolist(), strict=True)) if p != NONE]
        heapq.heapify(agenda)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        seen: dict[tuple[int, int], tuple[int, int]] = {}

        def put(k: int) -> None:
            pair = ids[k], ids[after[k]]
            if pair not in seen:
                place, piece = self.look_up(np.array(pair[:1]), np.array(pair[1:]))
                seen[pair] = int(place[0]), int(piece[0])
            place, piece = seen[pair]
            if place != NONE:
                heapq.heappush(agenda, (place, k, piece, *pair))

        while agenda:
            _, k, piece, left, right = heapq.heappop(agenda)
            gone = after[k]
            if ids[k] != left or gone >= n or ids[gone] != right:
                continue
            ids[k], ids[gone], after[k] = piece, -1, after[gone]
            if after[k] < n:
                before[after[k]] = k
                put(k)
            if before[k] >= 0:
                put(before[k])
        return np.array([s for s in ids if s >= 0], np.int32)


class Encoder:
    """Ids of whole texts, the agenda's results by distinct run, each compared with the library's."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.agenda = Agenda(self.vocabulary)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.remembered = Remembered(self._new)
        self.differing: set[str] = set()

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """words: runs without their first blank, which the library puts back."""
        values, lengths = self.agenda.encode([BLANK + w for w in words])
        theirs = self.library.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
        flat_ids = np.fromiter(chain.from_iterable(theirs), np.int32, sizes.sum())
        real = np.array([w != "" for w in words], bool)  # of an empty text the library makes nothing, not a blank
        same = (sizes[real] == lengths[real]).all() and (flat_ids == values[np.repeat(real, lengths)]).all()
        if not same:
            ends = np.cumsum(lengths)
            self.differing |= {w for w, e, n, ids in zip(words, ends, lengths, theirs, strict=True)
                               if w and values[e - n:e].tolist() != ids}
        return values, lengths

    @staticmethod
    def runs(texts: pa.Array) -> pa.Array:
        """Of each text the runs without their first blank."""
        words = pc.split_pattern(texts, " ")
        odd = pc.match_substring_regex(texts, f"  |^ |{BLANK}").to_numpy(zero_copy_only=False)
        if not odd.any():
            return words
        rows = [[r[1:] for r in _RUN.findall(BLANK + t.as_py().replace(" ", BLANK))] if o else w.as_py()
                for t, w, o in zip(texts, words, odd, strict=True)]
        return pa.array(rows, words.type)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, how many each has, and whether the library agrees."""
        words, offsets = flat(self.runs(texts))
        values, lengths = self.remembered(words)
        empty = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
        if empty.any():  # no blank is put before nothing
            none = np.repeat(empty, np.diff(offsets))
            values, lengths = values[~np.repeat(none, lengths)], np.where(none, 0, lengths)
        agrees = np.ones(len(texts), bool)
        if self.differing:
            bad = np.fromiter((w in self.differing for w in words.to_pylist()), np.int64, len(words))
            agrees = row_totals(bad, offsets) == 0
        return values, row_totals(lengths, offsets), agrees


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", ids: str = "ids",
           begin: bool = True, end: bool = True) -> DataFrame:
    """The key, the ids of each text as little-endian unsigned 32-bit integers in a binary column, and `agrees`: whether the
    library gives the same ids. model: path of a sentencepiece model, readable on every executor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in slices(batches, "text"):
            values, sizes, agrees = encoder(batch.column(1))
            ends = np.cumsum(sizes + begin + end)
            out = np.empty(ends[-1], "<u4")
            inner = np.ones(len(out), bool)
            if begin:
                first = ends - sizes - begin - end
                out[first], inner[first] = encoder.vocabulary.begin, False
            if end:
                out[ends - 1], inner[ends - 1] = encoder.vocabulary.end, False
            out[inner] = values
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_column(out, 4 * np.concatenate([[0], ends])), pa.array(agrees)],
                                             ["key", "ids", "agrees"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(tidied(run), f"key {kind}, ids binary, agrees boolean").toDF(key, ids, "agrees")


class Decoder:
    """Texts of ids."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.sizes = np.fromiter(map(len, self.vocabulary.text), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(self.vocabulary.text), np.uint8)

    def one(self, ids: np.ndarray) -> bytes:
        """Piece by piece, for ids that no text has."""
        out, run, first = b"", b"", True
        for k in [*ids.tolist(), None]:
            kind = None if k is None else self.vocabulary.kinds[k]
            if kind == 1:
                run += self.vocabulary.text[k]
                continue
            while run:
                size = next((n for n in range(1, 5) if _is_char(run[:n])), 0)
                out += run[:size] if size else "�".encode()
                run = run[size or 1:]
            if k is None or kind == 2:
                continue
            piece = self.vocabulary.text[k]
            if first and not out and kind == 0 and piece.startswith(b" "):
                piece = piece[1:]
            first = False
            out += piece
        return out

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts of rows of ids between the offsets, and the offsets of their bytes."""
        sizes, rows = self.sizes[ids], len(offsets) - 1
        out = self.data[ranges(self.starts[ids], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        filled = np.flatnonzero(np.diff(ends))
        kinds = self.vocabulary.kinds[ids]
        row = np.repeat(np.arange(rows), np.diff(offsets))
        seen = np.flatnonzero(kinds != 2)
        first = seen[np.concatenate([[True], row[seen[1:]] != row[seen[:-1]]])[:len(seen)]]
        odd = np.zeros(rows, bool)  # those that don't start with the blank that encoding puts first, or hold no text
        odd[row[first[(kinds[first] != 0) | (out[ends[row[first]]] != 32)]]] = True
        odd[row[kinds == 3]] = True
        for k in np.unique(row[kinds == 1]):
            odd[k] |= not _is_text(out[ends[k]:ends[k + 1]].tobytes())
        keep = np.ones(len(out), bool)
        keep[ends[filled]] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        if not odd.any():
            return out[keep], kept[ends]
        parts = [self.one(ids[offsets[k]:offsets[k + 1]]) if odd[k] else out[ends[k]:ends[k + 1]][keep[ends[k]:ends[k + 1]]].tobytes()
                 for k in range(rows)]
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([*map(len, parts)])]).astype(np.int64)


def _is_text(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _is_char(data: bytes) -> bool:
    return _is_text(data) and len(data.decode()) == 1


def decode(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The key and the text that the ids stand for, as the library's decode gives it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                data, offsets = binary_rows(part.column(1))
                out, ends = decoder(np.frombuffer(data.tobytes(), "<u4").astype(np.int64), offsets // 4)
                texts = binary_column(out, ends).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], ["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(tidied(run), f"key {kind}, text string").toDF(key, text)
