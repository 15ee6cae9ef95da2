"""Documents packed into sequences of bounded length by linear grouping.

Long pieces are sorted by length and cut into groups of equal cardinality; within a group all count
as long as its longest.  Few sizes remain, for which a linear program over configurations (ways to
fill one sequence) is solved by column generation.  Its whole multiples take actual pieces, which are
no longer than their places, and the room left over takes the remaining pieces, longest first, each in
the fullest sequence that it fits in.

The plan needs only the number of pieces of every length, so it has at most ``capacity`` rows to read and
works on runs of equal sequences; it is the same work at every size of the corpus.  Pieces of one
length are interchangeable: their numbers, counted per task and length, name their places in the plan.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roleweave.llm.storage import stage
from roleweave.llm.vectors import slices

#: Words whose ids a task remembers; the memory is emptied when it is full.
REMEMBERED_WORDS = 300_000
#: So many words are encoded by one call.
_JOINED = 512


@dataclass(frozen=True)
class Settings:
    """``end``: the id after each document.  Pieces of ``large`` or more are grouped, into ``groups``.

    ``vocabulary`` is a file of the tokenizers library; None is word_bpe_49k.json of public_tokenizers.
    """

    capacity: int = 4096
    end: int = 1
    large: int = 1366
    groups: int = 192
    vocabulary: str | None = None


@cache
def _tokenizer(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of texts, by way of their distinct words.

    Where a vocabulary lower-cases, drops white space and ends tokens with words, a text may be lower-cased
    and cut between an ASCII letter and an ASCII sign without a change of its ids; then each
    stretch between blanks is encoded once.  Texts that may hold a special token are only cut at blanks.
    Other vocabularies encode whole texts.
    """

    def __init__(self, vocabulary: str | None):
        self.tokenizer = _tokenizer(vocabulary)
        special = [(t.content, number) for number, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.names = [name for name, _ in special]
        self.mark = special[0] if special else None
        ends = getattr(self.tokenizer.model, "end_of_word_suffix", None) and "Lowercase" in str(self.tokenizer.normalizer)
        self.by_words = bool(ends and self.mark) and all(name.startswith("<|") for name in self.names)
        if self.by_words:
            suffix = self.tokenizer.model.end_of_word_suffix
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode many words at once.

        Words of ASCII letters end with their first token that ends a word; others stand between
        special tokens, and those that may hold one are encoded alone.
        """
        kind = np.array([0 if w.isascii() and w.isalpha() else 2 if "<|" in w else 1 for w in words], np.int8)
        flat, start, size, end = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), len(self.flat)
        for k, joined, alone in ((0, " ", 1 << 14), (1, f" {self.mark[0]} ", _JOINED), (2, "", 1)):
            rows = np.flatnonzero(kind == k)
            for at in range(0, len(rows), alone):
                some = rows[at : at + alone]
                text = joined.join([words[i] for i in some])
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                if k == 0:
                    sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
                elif k == 1:
                    sizes = np.diff(np.flatnonzero(ids == self.mark[1]), prepend=-1, append=len(ids)) - 1
                    ids = ids[ids != self.mark[1]]
                else:
                    sizes = np.array([len(ids)])
                size[some], start[some] = sizes, end + np.cumsum(sizes) - sizes
                flat.append(ids)
                end += len(ids)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.starts = np.concatenate([self.starts, start])
        self.sizes = np.concatenate([self.sizes, size])
        self.flat = np.concatenate([self.flat, *flat])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and the rows' offsets in them; null is empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        if not self.by_words:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            sizes = np.array([len(i) for i in ids], np.int64)
            return np.array([i for part in ids for i in part], np.uint32), np.concatenate([[0], np.cumsum(sizes)])
        cut_ = pc.ascii_lower(pc.replace_substring_regex(texts, r"([A-Za-z])([!-@\[-`{-~])", r"\1 \2"))  # lower-casing a slice is wrong in Arrow
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, cut_)
        parts = pc.ascii_split_whitespace(texts)
        words = parts.flatten().dictionary_encode()
        known = words.dictionary.to_pylist()
        fresh = [w for w in known if w not in self.place]
        if len(self.place) + len(fresh) > REMEMBERED_WORDS:
            self._forget()
            fresh = list(known)
        if fresh:
            self._learn(fresh)
        row = np.fromiter((self.place[w] for w in known), np.int64, len(known))
        row = row[words.indices.to_numpy(zero_copy_only=False)] if len(known) else row
        counts = self.sizes[row]
        ends = np.cumsum(counts)
        take = np.repeat(self.starts[row] - ends + counts, counts) + np.arange(counts.sum())
        offsets = parts.offsets.to_numpy()
        return self.flat[take], np.concatenate([[0], ends])[offsets - offsets[0]]


def cut(docs: DataFrame, settings: Settings = Settings(), ids: bool = False) -> DataFrame:
    """The pieces of documents: doc_id, piece, start, length, ids_crc32, and with ``ids`` the token ids.

    ``task`` and ``number`` tell pieces of one length apart: the number counts them within the task.
    A null text is empty; every document has at least its end.  Rows that share a doc_id are cut each.
    """
    s = settings
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, number long" + ", ids array<long>" * ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = WordIds(s.vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(s.capacity + 1, np.int64)
        for batch in slices(batches, "text"):
            flat, edges = encoder.encode(batch.column("text").cast(pa.string()))
            n = np.diff(edges) + 1
            whole = np.zeros(len(flat) + len(n), "<u4")
            first = np.cumsum(n) - n
            inner = np.ones(len(whole), bool)
            inner[first + n - 1] = False
            whole[inner], whole[~inner] = flat, s.end
            counts = -(-n // s.capacity)
            row = np.repeat(np.arange(len(n)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * s.capacity
            length = np.minimum(s.capacity, n[row] - start)
            at = first[row] + start
            by = np.argsort(length, kind="stable")
            number = np.empty(len(row), np.int64)
            ordered = length[by]
            number[by] = seen[ordered] + np.arange(len(by)) - np.searchsorted(ordered, ordered)
            np.add.at(seen, length, 1)
            crc = [zlib.crc32(whole[a : a + k]) for a, k in zip(at.tolist(), length.tolist())]
            columns = [
                batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()),
                pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(number),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(whole)), pa.int32()), pa.array(whole, pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, schema)


# ---------------------------------------------------------------- the plan, on lengths and their counts


def configurations(sizes: list[int], counts: list[int], capacity: int, tolerance: float = 1e-3) -> list[tuple[float, np.ndarray]]:
    """Fractional multiples of configurations that hold all ``counts`` of ``sizes`` in least sequences.

    Column generation: a basis of one configuration per size, priced by a knapsack over the capacity,
    until no configuration is worth more than ``tolerance`` above a sequence.
    """
    k = len(sizes)
    size, need = np.array(sizes), np.array(counts, np.float64)
    basis = np.diag(capacity // size).astype(np.float64)
    most = capacity // int(size.min())
    reach = np.arange(capacity + 1)[None, :] - size[:, None]
    fits = reach >= 0
    reach = np.where(fits, reach, 0)
    for _ in range(60 * k):
        amounts = np.linalg.solve(basis, need)
        price = np.linalg.solve(basis.T, np.ones(k))
        best, chosen = np.zeros(capacity + 1), []  # best value with one piece more in each round, and the piece
        for _ in range(most):
            gains = np.where(fits, best[reach] + price[:, None], -1.0)
            top = gains.argmax(0)
            value = gains[top, np.arange(capacity + 1)]
            chosen.append(np.where(value > best, top, -1))
            best = np.maximum(best, value)
        if best[capacity] <= 1 + tolerance:  # amounts.sum() is at most so far above the optimum
            break
        column, room = np.zeros(k), capacity
        for picks in reversed(chosen):
            if picks[room] >= 0:
                column[picks[room]] += 1
                room -= sizes[picks[room]]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
    return [(float(a), basis[:, i].astype(int)) for i, a in enumerate(np.linalg.solve(basis, need)) if a > 1e-9]


class Plan:
    """Runs of pieces and where they go.

    A row says: of the pieces of ``length``, ``count`` ones from number ``first`` on go to sequences
    from ``sequence`` on, ``each`` to a sequence, one after the other from ``offset``.
    """

    def __init__(self, histogram: dict[int, int], settings: Settings):
        self.s = settings
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(settings.capacity + 1)]  # by room: runs of sequences
        self.used = {length: 0 for length in histogram}
        self._configure({k: v for k, v in histogram.items() if k >= settings.large})
        for length in sorted(histogram, reverse=True):
            self._best_fit(length, histogram[length] - self.used[length])

    def _put(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.rows.append((length, self.used[length], count, sequence, each, offset))
        self.used[length] += count

    def _configure(self, large: dict[int, int]) -> None:
        total = sum(large.values())
        if not total:
            return
        groups: list[list[list[int]]] = [[] for _ in range(self.s.groups)]  # (length, count) runs, longest first
        place = 0
        for length in sorted(large, reverse=True):
            left = large[length]
            while left:
                group = place * self.s.groups // total
                end = -(-(group + 1) * total // self.s.groups)  # where the next group begins
                take = min(left, end - place)
                groups[group].append([length, take])
                place, left = place + take, left - take
        merged: dict[int, list[list[int]]] = {}
        for runs in filter(None, groups):  # groups of one size are one
            merged.setdefault(runs[0][0], []).extend(runs)
        sizes = list(merged)
        counts = [sum(n for _, n in merged[size]) for size in sizes]
        for amount, column in sorted(configurations(sizes, counts, self.s.capacity), key=lambda c: -c[0]):
            number = int(amount + 1e-6)
            slots = [sizes[i] for i in range(len(sizes)) for _ in range(column[i])]
            slots = slots[:-1] if len(slots) > 1 else slots  # the last place goes to the longest piece that fits, of any group
            for size in set(slots):  # rounding may ask for a piece more than there is
                number = min(number, sum(n for _, n in merged[size]) // slots.count(size))
            self._fill(number, slots, merged)

    def _fill(self, number: int, slots: list[int], merged: dict[int, list[list[int]]]) -> None:
        """``number`` sequences with one piece for each slot, as runs in which every slot has one length."""
        queues = []
        for slot in slots:
            runs, left = [], number
            while left:
                length, n = merged[slot][0]
                take = min(n, left)
                runs.append([length, take])
                left -= take
                merged[slot][0][1] -= take
                if not merged[slot][0][1]:
                    merged[slot].pop(0)
            queues.append(runs)
        while number:
            count = min(q[0][1] for q in queues)
            offset = 0
            for q in queues:
                self._put(q[0][0], count, self.sequences, 1, offset)
                offset += q[0][0]
                q[0][1] -= count
                if not q[0][1]:
                    q.pop(0)
            self.open[self.s.capacity - offset].append((self.sequences, count))
            self.sequences += count
            number -= count

    def _best_fit(self, length: int, count: int) -> None:
        capacity, room = self.s.capacity, length
        while count and room <= capacity:
            if not self.open[room]:
                room += 1
                continue
            sequence, n = self.open[room].pop()
            count = self._into(length, count, sequence, n, room)
        if count:
            each = capacity // length
            n = -(-count // each)
            self.sequences += n
            self._into(length, count, self.sequences - n, n, capacity)

    def _into(self, length: int, count: int, sequence: int, n: int, room: int) -> int:
        """Fill sequences of one room with as many as fit in each; return how many pieces are left."""
        each = room // length
        full = min(n, count // each)
        offset = self.s.capacity - room
        if full:
            self._put(length, full * each, sequence, each, offset)
            self.open[room - each * length].append((sequence, full))
        count -= full * each
        if full < n:
            part = min(count, each)
            if part:
                self._put(length, part, sequence + full, part, offset)
                self.open[room - part * length].append((sequence + full, 1))
                count, full = 0, full + 1
            if full < n:
                self.open[room].append((sequence + full, n - full))
        return count


def pack(pieces: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``cut``, which have to be read from a written table.

    The counts per task and length shuffle; of the pieces only their rows in ``pieces`` do, on task
    and length, so a length that many documents share is spread over the tasks that cut it.
    """
    s = settings
    counts = stage(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = np.array(sorted(Plan(histogram, s).rows), np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    step = int(plan[:, 1].max() + plan[:, 2].max() + 1) if len(plan) else 1
    # A plan row is found by length and first number at once while their product stays whole, else in two steps.
    wide = step * (s.capacity + 1) < 1 << 62
    keys = plan[:, 0] * step + plan[:, 1] if wide else None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            number = batch.column("number").to_numpy() + batch.column("before").to_numpy()
            if wide:
                row = np.searchsorted(keys, length * step + number, "right") - 1
            else:
                row = np.empty(len(length), np.int64)
                for one in np.unique(length):
                    low, high = np.searchsorted(plan[:, 0], [one, one + 1])
                    row[length == one] = low + np.searchsorted(plan[low:high, 1], number[length == one], "right") - 1
            _, first, _, sequence, each, offset = plan[row].T
            within = number - first
            kept = [c for c in batch.schema.names if c != "before"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence + within // each), pa.array(offset + within % each * length)],
                names=[*kept, "sequence_id", "offset"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    # the counts grow with the tasks, so both sides shuffle at every size
    return pieces.join(firsts.hint("merge"), ["length", "task"]).select(*pieces.columns, "before").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of one id.  Rows that share a doc_id or a text, or lack a doc_id,
    are packed each; other columns are ignored; an empty table gives none.
    """
    placed = pack(stage(cut(docs, settings), "pieces"), settings)
    length = F.col("length").cast("long").alias("length")
    return placed.select("doc_id", "piece", "start", length, "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The packed sequences: sequence_id, ids, and ``ends``, the place after each piece."""
    placed = pack(stage(cut(docs, settings, ids=True), "pieces"), settings)
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))  # at most capacity ids
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: p["offset"] + p["length"]).alias("ends")
    )
