"""Packing tokenised documents into as few sequences as can be, by a linear grouping scheme and best fit.

Documents longer than a sequence are cut into pieces of full length; a rest stays a piece of its own. Then

1. large lengths are sorted and cut into ``groups`` of equal cardinality; within a group each counts as its longest,
2. for these few sizes a linear program over configurations (how many pieces of each size share a sequence) is
   solved by column generation, a knapsack finding each next configuration; counts are rounded down,
3. the actual pieces take the places of their group's size, so every sequence has room at least for them,
4. small pieces, and large ones that rounding left over, go by falling length where they fit best.

All four work on the histogram of lengths, which has no more entries than a sequence has places, however many documents
there are. Pieces in order of length are numbered; a plan is a list of ranges of numbers, each with the first sequence it
goes to, how many of its pieces share one, and where in it they start. A range is made when a length ends, a group is
exhausted or a set of equal sequences is used up, so the plan's size is bounded by the sequence length too (below 200,000
ranges). What is sent to the driver is the histogram and to executors the plan, never pieces.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundtrace.llm.store import documents, prepare, table
from fundtrace.llm.words import LOWER, SPACES, buffers, positions

CAPACITY = 4096
END_ID = 1
GROUPS = 128
# Pieces of more than such a part of a sequence are large. Each value gives a plan, the one with the fewest sequences is used:
# where small pieces are plenty few sizes need the program, where they are rare most do.
LARGE = (1 / 4, 2 / 5)
VOCABULARY = "word_bpe_49k.json"
# Words an encoder remembers before it starts over.
REMEMBERED = 1 << 19
# Kinds of bytes.
_ALPHANUMERIC, _MARK, _SPACE = 1, 2, 3


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """How often to use which configuration {index of size: pieces} so that few sequences hold the counted pieces.

    The linear program's optimum, rounded down: some pieces stay without a place, never the other way round.
    """
    n = len(sizes)
    if n == 0:
        return []
    columns = [{g: capacity // sizes[g]} for g in range(n)]
    inverse = np.diag([1 / (capacity // s) for s in sizes])
    need = np.array(counts, float)
    basis = list(range(n))
    while True:
        prices = inverse.sum(axis=0)
        chosen, worth = _knapsack(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        entry = np.zeros(n)
        for g, k in chosen.items():
            entry[g] = k
        rate, held = inverse @ entry, inverse @ need
        ratio = np.where(rate > 1e-9, np.maximum(held, 0) / np.where(rate > 1e-9, rate, 1), np.inf)
        leaving = int(np.argmin(ratio))
        columns.append(chosen)
        basis[leaving] = len(columns) - 1
        inverse[leaving] /= rate[leaving]
        others = np.arange(n) != leaving
        inverse[others] -= np.outer(rate[others], inverse[leaving])
    left, out = list(counts), []
    for column, times in sorted(zip(basis, inverse @ need), key=lambda b: -b[1]):
        use = min([int(times + 1e-6)] + [left[g] // k for g, k in columns[column].items()])
        if use > 0:
            for g, k in columns[column].items():
                left[g] -= k * use
            out.append((columns[column], use))
    return out


def _knapsack(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """The configuration of the greatest worth, pieces added one at a time."""
    room = np.arange(capacity + 1)[None, :] - np.array(sizes)[:, None]
    reachable, room = room >= 0, np.maximum(room, 0)
    best, steps = np.zeros(capacity + 1), []
    while True:
        tried = np.where(reachable, best[room] + prices[:, None], 0.0)
        taken = tried.argmax(axis=0)
        found = tried[taken, np.arange(capacity + 1)]
        better = found > best + 1e-12
        if not better.any():
            break
        steps.append(np.where(better, taken, -1))
        best = np.where(better, found, best)
    chosen: dict[int, int] = defaultdict(int)
    at = capacity
    for step in reversed(steps):
        if step[at] >= 0:
            chosen[int(step[at])] += 1
            at -= sizes[int(step[at])]
    return dict(chosen), float(best[capacity])


class Plan:
    """Ranges of piece numbers and where their pieces go, from the histogram of lengths.

    Pieces are numbered by falling length. The ``i``-th piece of a range (lo, hi, per, sequence, offset, length) goes to
    ``sequence + i // per`` at ``offset + i % per * length``.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int = GROUPS, large: float = LARGE[0]):
        self.capacity = capacity
        self.lengths = sorted((x for x in histogram if histogram[x]), reverse=True)
        self.begins = [0]
        for x in self.lengths:
            self.begins.append(self.begins[-1] + histogram[x])
        self.sequences = 0
        self.ranges: list[tuple[int, int, int, int, int, int]] = []
        self.gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.open = np.zeros(capacity + 1, bool)
        rest = self._large(groups, int(capacity * large))
        for x, lo, hi in rest:
            self._fit(x, lo, hi)
        self.ranges.sort()

    def _length_at(self, place: int) -> int:
        return self.lengths[int(np.searchsorted(self.begins, place, "right")) - 1]

    def _free(self, gap: int, first: int, last: int) -> None:
        if gap > 0 and last > first:
            self.gaps[gap].append((first, last))
            self.open[gap] = True

    def _large(self, groups: int, above: int) -> list[tuple[int, int, int]]:
        """Place full and large pieces; (length, lo, hi) of all others by falling length."""
        full = self.begins[1] if self.lengths and self.lengths[0] == self.capacity else 0
        if full:
            self.ranges.append((0, full, 1, 0, 0, self.capacity))
            self.sequences = full
        end = max(full, self.begins[sum(x > above for x in self.lengths)])
        # Lengths that are few already need no rounding.
        cuts = [b for b in self.begins if full <= b < end]
        if len(cuts) > groups:
            cuts = sorted({full + (end - full) * g // groups for g in range(groups)})
        members: dict[int, list[int]] = {}
        for lo, hi in zip(cuts, cuts[1:] + [end]):
            # Groups whose longest pieces are equal are one size.
            members.setdefault(self._length_at(lo), [lo, hi])[1] = hi
        sizes = sorted(members, reverse=True)
        spans = [members[s] for s in sizes]
        for configuration, times in configurations(sizes, [hi - lo for lo, hi in spans], self.capacity):
            taken = []
            for g, k in configuration.items():
                taken.append((spans[g][0], k))
                spans[g][0] += k * times
            self._substitute(taken, times)
        rest = [(lo, hi) for lo, hi in spans if hi > lo] + ([(end, self.begins[-1])] if self.begins[-1] > end else [])
        return [part for lo, hi in rest for part in self._by_length(lo, hi)]

    def _by_length(self, lo: int, hi: int) -> list[tuple[int, int, int]]:
        out = []
        first = int(np.searchsorted(self.begins, lo, "right")) - 1
        for i in range(first, len(self.lengths)):
            if self.begins[i] >= hi:
                break
            out.append((self.lengths[i], max(lo, self.begins[i]), min(hi, self.begins[i + 1])))
        return out

    def _substitute(self, taken: list[tuple[int, int]], times: int) -> None:
        """``times`` new sequences, each with the next ``k`` pieces from ``lo`` for every (lo, k) in ``taken``."""
        marks = {0, times}
        for lo, k in taken:
            a, b = np.searchsorted(self.begins, [lo + 1, lo + k * times])
            for change in self.begins[a:b]:
                marks.add((change - lo) // k)
                marks.add(-((lo - change) // k))
        marks = sorted(m for m in marks if 0 <= m <= times)
        for t0, t1 in zip(marks, marks[1:]):
            offset = 0
            for lo, k in taken:
                lo, hi = lo + k * t0, lo + k * t1
                if self._length_at(lo) == self._length_at(hi - 1):
                    self.ranges.append((lo, hi, k, self.sequences + t0, offset, self._length_at(lo)))
                    offset += k * self._length_at(lo)
                    continue
                for place in range(lo, hi):  # pieces of several lengths in a single sequence
                    self.ranges.append((place, place + 1, 1, self.sequences + t0, offset, self._length_at(place)))
                    offset += self._length_at(place)
            self._free(self.capacity - offset, self.sequences + t0, self.sequences + t1)
        self.sequences += times

    def _fit(self, length: int, lo: int, hi: int) -> None:
        """Pieces [lo, hi) of one length to the sequences with the least room that takes them, each filled before the next."""
        while lo < hi:
            gap = length + int(np.argmax(self.open[length:]))
            if self.open[gap]:
                first, last = self.gaps[gap].pop()
                self.open[gap] = bool(self.gaps[gap])
            else:
                gap, first = self.capacity, self.sequences
                last = first - (lo - hi) // (self.capacity // length)
                self.sequences = last
            per = gap // length
            whole = min((hi - lo) // per, last - first)
            if whole:
                self.ranges.append((lo, lo + whole * per, per, first, self.capacity - gap, length))
                self._free(gap - per * length, first, first + whole)
                lo, first = lo + whole * per, first + whole
            if first < last and lo < hi:
                self.ranges.append((lo, hi, hi - lo, first, self.capacity - gap, length))
                self._free(gap - (hi - lo) * length, first, first + 1)
                lo, first = hi, first + 1
            self._free(gap, first, last)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lengths rising, number of their first piece, ranges) for ``place``."""
        lengths = np.array(self.lengths[::-1], np.int64)
        return lengths, np.array(self.begins[:-1][::-1], np.int64), np.array(self.ranges, np.int64).reshape(-1, 6)


def best_plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> Plan:
    return min((Plan(histogram, capacity, groups, part) for part in large), key=lambda plan: plan.sequences)


def place(arrays, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces, given their lengths and their ranks among the pieces of equal length."""
    lengths, begins, ranges = arrays
    number = begins[np.searchsorted(lengths, length)] + rank
    lo, _, per, sequence, offset, size = ranges[np.searchsorted(ranges[:, 0], number, "right") - 1].T
    return sequence + (number - lo) // per, offset + (number - lo) % per * size


class Encoder:
    """Ids of whole columns. Words are cut where no token can reach across, and each different word is encoded once.

    White space separates tokens, and so does the place between an ASCII letter or digit and a mark of ``MARKS``; the
    normaliser changes nothing across either. A-Z are lower-cased beforehand, as the vocabulary does. Special tokens are
    ordinary text unless ``specials``.
    """

    MARKS = b".,;:!?"

    def __init__(self, vocabulary: str, specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = not specials
        self.lower = LOWER if '"Lowercase"' in vocabulary and not specials else np.arange(256, dtype=np.uint8)
        self.kinds = np.zeros(256, np.uint8)
        self.kinds[[b for b in range(128) if chr(b).isalnum()]] = _ALPHANUMERIC
        self.kinds[list(self.MARKS)] = _MARK
        self.kinds[SPACES] = _SPACE
        vocabulary_of = self.tokenizer.get_vocab()
        suffix = json.loads(vocabulary)["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary_of.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary_of.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Places of the words in ``begin`` and ``size``, new ones encoded first."""
        if len(self.known) > REMEMBERED:
            self._forget()
        found = list(map(self.known.get, words))
        new = [w for w, at in zip(words, found) if at is None]
        if new:
            at = len(self.known)
            sizes, ids = self._encoded(new)
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes) - sizes])
            self.size, self.ids = np.concatenate([self.size, sizes]), np.concatenate([self.ids, ids])
            self.known.update(zip(new, range(at, at + len(new))))
            later = iter(range(at, at + len(new)))
            found = [next(later) if number is None else number for number in found]
        return np.array(found, np.int64)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids in a row.

        Words of letters below U+0100, which no normaliser takes apart, are one token run each: many go through the
        tokenizer as one text, and each ends with the id of a word's end.
        """
        plain = np.array([w.isalpha() and (w.isascii() or max(w) < "\u0100") for w in words], bool) & bool(self.ends.any())
        of: list = [None, None]
        rest = [w for w, p in zip(words, plain) if not p]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        of[0] = np.array([len(f) for f in found], np.int64), np.array([i for f in found for i in f], np.uint32)
        texts = [" ".join(part) for part in (list(itertools.compress(words, plain))[i : i + 2000] for i in range(0, int(plain.sum()), 2000))]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.uint32)
        of[1] = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1), ids
        sizes = np.zeros(len(words), np.int64)
        sizes[~plain], sizes[plain] = of[0][0], of[1][0]
        both = np.zeros(int(sizes.sum()), np.uint32)
        kind = np.repeat(plain, sizes)
        both[~kind], both[kind] = of[0][1], of[1][1]
        return sizes, both

    def blocks(self, column: pa.Array):
        """Per block of the column's bytes: its end, the first byte of every word in it, where the word's ids begin, all ids."""
        data, offsets = buffers(column)
        for begin, end, starts, _ in positions(data, offsets, SPACES):
            raw = data[begin:end]
            kind = self.kinds[raw]
            first = np.zeros(len(raw), bool)
            first[1:] = (kind[:-1] == _ALPHANUMERIC) & (kind[1:] == _MARK)
            first[starts - begin] = True
            begins = np.flatnonzero(first) + begin
            if len(begins) == 0:
                yield end, begins, np.zeros(1, np.int64), self.ids[:0]
                continue
            letters = kind != _SPACE
            # Without the white space a word ends where the next begins.
            places = np.append(np.cumsum(letters, dtype=np.int32)[begins - begin] - 1, np.int32(np.count_nonzero(letters)))
            text = self.lower[raw[letters]]
            words = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(text)]).dictionary_encode()
            number = self._numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
            sizes = self.size[number]
            at = np.append(0, np.cumsum(sizes))
            flat = np.repeat((self.begin[number] - at[:-1]).astype(np.int32), sizes) + np.arange(at[-1], dtype=np.int32)
            yield end, begins, at, self.ids[flat]


def _cut(column: pa.Array, encoder: Encoder, capacity: int, end_id: int):
    """(row, start, ids) of every piece of every row, in order; a text is held one block at a time."""
    offsets = buffers(column)[1]
    closing = np.array([end_id], np.uint32)
    row, start, held = 0, 0, np.zeros(0, np.uint32)

    def full(ids, start):
        for k in range(0, len(ids) - capacity + 1, capacity):
            yield row, start + k, ids[k : k + capacity]

    def finished(ids, start):
        yield from full(ids, start)
        if len(ids) % capacity:
            done = len(ids) - len(ids) % capacity
            yield row, start + done, ids[done:]

    for end, begins, at, ids in encoder.blocks(column):
        while row < len(column) and offsets[row] < end:
            a, b = at[np.searchsorted(begins, offsets[row])], at[np.searchsorted(begins, min(offsets[row + 1], end))]
            if offsets[row + 1] <= end:
                yield from finished(np.concatenate([held, ids[a:b], closing]), start)
                row, start, held = row + 1, 0, held[:0]
                continue
            held = np.concatenate([held, ids[a:b]])
            yield from full(held, start)
            done = len(held) - len(held) % capacity
            start, held = start + done, held[done:].copy()
            break
    for row in range(row, len(column)):  # what follows the last byte is empty
        yield from finished(np.concatenate([held, closing]), start)
        start, held = 0, held[:0]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, specials: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, here) of every row of ``docs`` (doc_id, text).

    ``here`` counts the pieces of equal length in a task's ``part``. Ids are 4 bytes each, little-endian.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    numbers = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "here"]
    fields = [(n, pa.int32() if n == "piece" else pa.int64()) for n in numbers] + ([("ids", pa.binary())] if with_ids else [])
    schema = pa.schema(fields)

    def scan(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(sent.value, specials)
            names, out = batch.column(0).to_pylist(), [[] for _ in fields]
            for row, start, ids in _cut(batch.column(1), encoder, capacity, end_id):
                raw = ids.astype("<u4").tobytes()
                values = (names[row], start // capacity, start, len(ids), zlib.crc32(raw), part, int(seen[len(ids)]), raw)
                seen[len(ids)] += 1
                for column, value in zip(out, values):
                    column.append(value)
                if len(out[0]) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(out, fields)], schema=schema)
                    out = [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(out, fields)], schema=schema)

    kinds = ", ".join(f"{n} {'int' if n == 'piece' else 'long'}" for n in numbers) + (", ids binary" if with_ids else "")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(scan, kinds)


def packed(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> DataFrame:
    """Stored ``pieces`` with ``sequence_id`` and ``offset``, without ``part`` and ``here``."""
    counts = table(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("count")))
    histogram = {r["length"]: r["count"] for r in counts.groupBy("length").agg(F.sum("count").alias("count")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    plan = cut.sparkSession.sparkContext.broadcast(best_plan(histogram, capacity, groups, large).arrays())
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("here") + F.col("before"))
    ranked = ranked.select(*[c for c in cut.columns if c not in ("part", "here")], "rank")

    def scan(batches):
        for batch in batches:
            at = place(plan.value, *[batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank")])
            kept = [c for c in batch.schema.names if c != "rank"]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(a, pa.int64()) for a in at]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(scan, kinds)


def public_vocabulary(name: str = VOCABULARY) -> str:
    """The text of an installed public vocabulary file: a few MB, whatever the corpus."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of all pieces of all rows.

    Every row, repeated ones and those without an id too, is a document: its ids, then ``end_id``. Null and empty texts
    have only that. Other columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    return packed(table(pieces(docs, vocabulary, capacity, end_id, with_ids)), capacity, groups, large)


def sequences(packs: DataFrame) -> DataFrame:
    """(sequence_id, ids): what ``pack`` put into each sequence, joined; at most ``capacity`` ids each."""
    parts = packs.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids")))["ids"].alias("parts"))
    return parts.select("sequence_id", F.unhex(F.array_join(F.transform("parts", F.hex), "")).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir, "doc_id", "text"), public_vocabulary(), with_ids=False)
