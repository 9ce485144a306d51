"""Held-out test items that leaked into messages: SimHash windows, multi-index Hamming blocks, exact verification.

The windows of an item have the size that at least one unaltered window is bound to have in every stretch that counts as a
leak (a third of the item, one word in eight altered). Fingerprints of all windows of all messages are looked up in four
tables, one per 16-bit block: two fingerprints within a distance of 3 bits agree in at least one block, so none within this
radius is missed. Every candidate is verified on the words themselves: by the length of the stretch that they align to, and by
the weight of its five-word shingles, which is the less the more items share a shingle.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.mail import html_text, text_parts
from weftgraph.session import written

RADIUS, BLOCKS = 3, 4
SHARE, ALTERED = 1 / 3, 1 / 8
#: Words of a shingle; items with fewer words than SHORT count only as a whole.
SHINGLE, SHORT = 5, 6
#: Least share of an item's shingle weight that a leak has: less is a line that many items share.
LEAST_WEIGHT = 1 / 16
#: Words of items that every task may hold; beyond it windows and items are joined by block.
MAX_HELD_WORDS = 1_000_000
SLICE_WORDS = 300_000
#: Cells of one batch of alignments, and rows of it that are held at a time.
BATCH_CELLS, BLOCK_ROWS = 2_000_000, 512

# Letters of other scripts that look like Latin ones.
LOOK_ALIKE = dict(zip("асеорхуіјѕһԁӏԛԝгАВЕКМНОРСТХУІЈЅοανικρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceopxyijshdlqwrABEKMHOPCTXYIJSoavikptuxABEZHIKMNOPTYX", strict=True))
DROPPED = "­​‌‍⁠﻿"
_TABLE = str.maketrans(LOOK_ALIKE | dict.fromkeys(DROPPED, ""))
_WORD = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\W_㐀-䶿一-鿿豈-﫿]+")
_QUOTE = re.compile(r"(?m)^(?:[ \t]*>)+[ \t]?")
_MARKS = re.compile(r"[̀-ͯ]+")


def words_of(text: str) -> list[str]:
    """Words (Chinese characters one by one) whatever the case, punctuation, look-alike letters, accents and quote marks."""
    if ">" in text:
        text = _QUOTE.sub("", text)
    if not text.isascii():
        text = text.translate(_TABLE)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


def window_size(n_words: int) -> int:
    """Words of an unaltered run that every leak of an item of ``n_words`` holds: of L >= a third of its words at most an eighth
    is altered, which leaves at least one run of (L - altered) / (altered + 1) words. An item under ``SHORT`` words is its own window."""
    if n_words < SHORT:
        return n_words
    least = max(1, math.ceil(n_words * SHARE))
    return max(2, min(math.ceil((size - size // 8) / (size // 8 + 1)) for size in range(least, least + 64)))


class WordHashes(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def hashes(words: list[str], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)


def neighbours(h: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of neighbouring words."""
    with np.errstate(over="ignore"):
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]
        pairs ^= pairs >> np.uint64(29)
        pairs *= np.uint64(0xBF58476D1CE4E5B9)
        pairs ^= pairs >> np.uint64(32)
    return pairs


def fingerprints(h: np.ndarray, window: int) -> np.ndarray:
    """SimHash of every window of ``window`` words over its words and pairs of neighbouring words (an odd number of features)."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    one, two = _bits(h), _bits(neighbours(h)) if window > 1 else None
    votes = one[:n].copy()
    for i in range(1, window):
        votes += one[i : i + n]
    for i in range(window - 1):
        votes += two[i : i + n]
    return np.packbits(votes > (2 * window - 1) // 2, axis=1).view(np.uint64).ravel()


@dataclass
class ItemIndex:
    """Fingerprints of the item windows of one size with a table for each block."""

    window: int
    prints: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    order: list[np.ndarray]
    start: list[np.ndarray]

    @staticmethod
    def build(window: int, items: list[tuple[int, np.ndarray]]) -> ItemIndex:
        prints, item, offset = [], [], []
        for no, h in items:
            p = fingerprints(h, window)
            prints.append(p)
            item.append(np.full(len(p), no, np.int32))
            offset.append(np.arange(len(p), dtype=np.int32))
        p = np.concatenate(prints)
        order, start = [], []
        for b in range(BLOCKS):
            key = (p >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)
            o = np.argsort(key, kind="stable")
            order.append(o.astype(np.int32))
            start.append(np.searchsorted(key[o], np.arange(65537)).astype(np.int32))
        return ItemIndex(window, p, np.concatenate(item), np.concatenate(offset), order, start)

    def near(self, q: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in q, item window) within the radius, some of them twice."""
        at, hit = [], []
        for b in range(BLOCKS):
            key = (q >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)
            first, last = self.start[b][key], self.start[b][key + 1]
            some = np.flatnonzero(last > first)
            size = (last - first)[some]
            i = np.repeat(some, size)
            j = self.order[b][np.repeat(first[some], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))]
            close = np.bitwise_count(q[i] ^ self.prints[j]) <= radius
            at.append(i[close])
            hit.append(j[close])
        return np.concatenate(at), np.concatenate(hit)


@dataclass(frozen=True)
class Item:
    """A test item: hashes of its words, and the weight of each."""

    item_id: int
    words: np.ndarray
    weights: np.ndarray


def longest_stretch(same: np.ndarray, own: np.ndarray | None = None) -> tuple[int, int, int]:
    """Length, begin and end of the longest stretch of which at most one word in eight is altered; it begins and ends with an equal
    word. ``own`` says which words count for the length, all if None."""
    score = np.cumsum(np.where(same, 1, 1 - round(1 / ALTERED)))
    score = np.r_[0, score]
    begins, ends = np.flatnonzero(same), np.flatnonzero(same) + 1
    if not len(begins):
        return 0, 0, 0
    # for each end the first begin whose prefix is not higher: prefix minima over begins fall, so a search finds it
    low = np.minimum.accumulate(score[begins])
    where = np.searchsorted(-low, -score[ends], side="left")
    ok = where < len(begins)
    ok[ok] &= begins[where[ok]] < ends[ok]
    if not ok.any():
        return 0, 0, 0
    length = np.r_[0, np.cumsum(np.ones(len(same), np.int64) if own is None else own)]
    a, b = begins[where[ok]], ends[ok]
    k = int((length[b] - length[a]).argmax())
    return int(length[b[k]] - length[a[k]]), int(a[k]), int(b[k])


Case = tuple[np.ndarray, np.ndarray, int, int]


def _aligned_batch(cases: list[Case]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each case (document, item, first and last shift) the alignment with the fewest edits whose shifts lie in first..last, as a
    path: is it a word equal to the item's, and is it a word of the item.

    Words replaced, left out and put in all count as edits; the alignment may begin and end at any of the shifts. The cases step
    together through one array; of long items only ``BLOCK_ROWS`` rows are held, the others are made again on the way back.
    """
    n = np.array([len(item) for _, item, _, _ in cases])
    width = np.array([last - first + 1 for _, _, first, last in cases])
    rows, shifts, many = int(n.max()), int(width.max()), len(cases)
    own, text = np.zeros((many, rows), np.uint64), np.zeros((many, rows + shifts - 1), np.uint64)
    there = np.zeros(text.shape, bool)
    for b, (doc, item, first, last) in enumerate(cases):
        own[b, : len(item)] = item
        lo, hi = max(0, first), min(len(doc), last + len(item))
        if hi > lo:
            text[b, lo - first : hi - first] = doc[lo:hi]
            there[b, lo - first : hi - first] = True
    k = np.arange(shifts, dtype=np.int32)
    beyond = np.where(k < width[:, None], 0, 1 << 24).astype(np.int32)

    def differ(i: int) -> np.ndarray:
        return (text[:, i : i + shifts] != own[:, i : i + 1]) | ~there[:, i : i + shifts]

    def following(cost: np.ndarray, i: int) -> np.ndarray:
        step = cost + differ(i)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # the item's word is left out
        return np.minimum.accumulate(step - k, axis=1) + k + beyond  # words put in move on to greater shifts

    marks = [beyond]
    for i in range(rows // BLOCK_ROWS * BLOCK_ROWS):
        at = following(at if i % BLOCK_ROWS else marks[-1], i)
        if (i + 1) % BLOCK_ROWS == 0:
            marks.append(at)
    steps = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool))]
    i, s, who = n.copy(), np.full(many, -1), np.arange(many)
    for block in range(len(marks) - 1, -1, -1):
        low = block * BLOCK_ROWS
        cost = [marks[block]]
        for r in range(low, min(low + BLOCK_ROWS, rows)):
            cost.append(following(cost[-1], r))
        held = np.stack(cost)
        new = (s < 0) & (i > low)
        s[new] = held[i[new] - low, who[new]].argmin(1)
        while len(b := np.flatnonzero(i > low)):
            at, sh = i[b] - low, s[b]
            now, before = held[at, b, sh], held[at - 1, b]
            edit = (text[b, i[b] - 1 + sh] != own[b, i[b] - 1]) | ~there[b, i[b] - 1 + sh]
            straight = now == before[np.arange(len(b)), sh] + edit
            left_out = ~straight & (sh + 1 < width[b])
            left_out[left_out] = now[left_out] == before[left_out, sh[left_out] + 1] + 1
            put_in = ~straight & ~left_out
            steps.append((b, straight & ~edit, ~put_in))
            i[b[~put_in]] -= 1
            s[b] += left_out.astype(int) - put_in
    whose, equal, of_item = (np.concatenate(x)[::-1] for x in zip(*steps, strict=True))
    order = np.argsort(whose, kind="stable")
    cuts = np.searchsorted(whose[order], np.arange(1, many))
    return list(zip(np.split(equal[order], cuts), np.split(of_item[order], cuts), strict=True))


def aligned(cases: list[Case]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``_aligned_batch`` of all cases, those of similar size together."""
    size = [(len(item), last - first) for _, item, first, last in cases]
    order = sorted(range(len(cases)), key=size.__getitem__)
    out: list = [None] * len(cases)
    while order:
        take = 1
        while take < len(order) and (take + 1) * size[order[take]][0] * (max(size[k][1] for k in order[: take + 1]) + 1) <= BATCH_CELLS:
            take += 1
        for k, path in zip(order[:take], _aligned_batch([cases[k] for k in order[:take]]), strict=True):
            out[k] = path
        order = order[take:]
    return out


def verified(pairs: list[tuple[np.ndarray, Item, np.ndarray]]) -> list[tuple[float, float]]:
    """Share and weight of the best stretch of each pair of a document and an item: the share of the item's words in a stretch of the
    document in the same order, of which at most one word in eight is altered, and the share of the item's shingle weight that the
    equal words of this stretch have. The third of a pair has document position minus item position of its candidates.

    Words left out or put in shift what follows by a few places; the words are aligned over all shifts within an eighth of the item
    around each candidate. Of items under ``SHORT`` words only the whole, unaltered, counts.
    """
    best = [(0, 0.0)] * len(pairs)
    cases, of = [], []
    in_order: dict[int, np.ndarray] = {}
    for k, (doc, item, found) in enumerate(pairs):
        n = len(item.words)
        least = math.ceil(n * SHARE) * (1 - ALTERED)  # equal words that a sufficient stretch has at least
        if n >= SHORT:  # of its pairs of neighbouring words, each altered word breaks two at most
            if id(doc) not in in_order:
                in_order[id(doc)] = np.sort(neighbours(doc))
            there, own = in_order[id(doc)], neighbours(item.words)
            equal = there[np.minimum(np.searchsorted(there, own), len(there) - 1)] == own if len(there) else own[:0]
            if equal.sum() < min(size - 1 - 2 * (size // 8) for size in range(math.ceil(n * SHARE), math.ceil(n * SHARE) + 8)):
                continue
        shifts = np.unique(found)
        at = shifts[:, None] + np.arange(n)
        inside = (at >= 0) & (at < len(doc))
        same = (doc[np.where(inside, at, 0)] == item.words) & inside
        if n < SHORT:
            best[k] = (n, float(item.weights.sum())) if same.all(1).any() else (0, 0.0)
            continue
        for row in same[same.sum(1) >= least]:
            length, a, b = longest_stretch(row)
            best[k] = max(best[k], (length, float(item.weights[a:b][row[a:b]].sum())))
        band = math.ceil(n * ALTERED)
        for group in np.split(shifts, np.flatnonzero(np.diff(shifts) > 2 * band) + 1):
            near = doc[max(0, group[0] - band) : max(0, group[-1] + band + n)]
            if best[k][0] < n and np.isin(item.words, near).sum() >= max(least, best[k][0] * (1 - ALTERED)):
                cases.append((doc, item.words, int(group[0]) - band, int(group[-1]) + band))
                of.append(k)
    for k, (equal, of_item) in zip(of, aligned(cases), strict=True):
        length, a, b = longest_stretch(equal, of_item)
        weights = pairs[k][1].weights[np.maximum(np.cumsum(of_item) - 1, 0)]
        best[k] = max(best[k], (length, float(weights[a:b][equal[a:b]].sum())))
    return [(length / len(item.words), weight / item.weights.sum()) for (length, weight), (_, item, _) in zip(best, pairs, strict=True)]


def _message_words(text: str) -> list[list[str]]:
    return [words_of(html_text(p.text) if p.kind == "text/html" else p.text) for p in text_parts(text)]


def weighted_items(items: DataFrame) -> DataFrame:
    """item_no (unique), item_id, words (hashes) and weights of all items with words. The weight of a word is that of the
    commonest shingle around it: one over the number of items that hold it. Repeated rows of an item count once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            ids, words = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = hashes(words_of(text), known)
                if len(h):
                    ids.append(i)
                    words.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(words, pa.list_(pa.int64()))], names=["item_id", "words"])

    given = items.select(F.col("item_id").cast("int").alias("item_id"), "passage").where("passage IS NOT NULL AND item_id IS NOT NULL").distinct()
    rows = written(given.mapInArrow(cut, "item_id int, words array<long>").withColumn("item_no", F.monotonically_increasing_id()), "items")
    count = F.greatest(F.size("words") - SHINGLE + 1, F.lit(1))
    at = rows.select("item_no", F.size("words").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), count), lambda k: F.struct(k.alias("k"), F.xxhash64(F.slice("words", k, SHINGLE)).alias("shingle")))).alias("s"))
    at = at.select("item_no", "n", "s.k", "s.shingle")
    held = at.groupBy("shingle").agg(F.countDistinct("item_no").alias("held"))
    covered = at.join(held, "shingle").select("item_no", "held", F.explode(F.sequence(F.col("k"), F.least(F.col("k") + SHINGLE - 1, F.col("n")))).alias("k"))
    by_word = covered.groupBy("item_no", "k").agg((1 / F.max("held")).alias("w"))
    weights = by_word.groupBy("item_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]).alias("weights"))
    return written(rows.join(weights, "item_no"), "weighted")


def leaked_items(documents: DataFrame, items: DataFrame, radius: int = RADIUS, window: int | None = None, max_held_words: int = MAX_HELD_WORDS) -> DataFrame:
    """(doc_id, item_id, share, weight): the items of which a text part of a message holds at least a third in one stretch, with up to
    one word in eight altered, the share of the item's words that this stretch has, and the share of its shingle weight.

    Stretches with less than ``LEAST_WEIGHT`` are lines that many items share and left out. ``items`` (item_id, passage) is held by
    every task up to ``max_held_words`` words; more are joined with the windows by block. Null and empty texts and passages match
    nothing; items under ``SHORT`` words count only as a whole. Repeated messages are reported under each doc_id, items with equal
    passages each. ``window`` sets one size for all windows, else each item has its own. Other columns are ignored.
    """
    held = weighted_items(items)
    n_words = held.agg(F.sum(F.size("words"))).first()[0] or 0
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL AND text <> ''")
    if n_words <= max_held_words:
        found = _search(texts, [Item(r.item_id, np.array(r.words, np.int64).view(np.uint64), np.array(r.weights)) for r in held.toLocalIterator()], radius, window)
    else:
        found = _joined(texts, held, radius, window)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "weight")).alias("s")).select("doc_id", "item_id", "s.share", "s.weight")


FOUND = "doc_id long, item_id int, share double, weight double"


def _rows(ids: list[int], pairs: list[tuple[np.ndarray, Item, np.ndarray]]) -> pa.RecordBatch:
    """The rows of FOUND of the pairs that are verified."""
    rows = [(i, item.item_id, s, w) for i, (_, item, _), (s, w) in zip(ids, pairs, verified(pairs), strict=True) if s >= SHARE and w >= LEAST_WEIGHT]
    d, i, s, w = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int32()), pa.array(s, pa.float64()), pa.array(w, pa.float64())], names=["doc_id", "item_id", "share", "weight"])


def _search(texts: DataFrame, items: list[Item], radius: int, window: int | None) -> DataFrame:
    """All items against all messages, the items and their index held by every task."""
    by_window: dict[int, list[tuple[int, np.ndarray]]] = {}
    for no, item in enumerate(items):
        by_window.setdefault(window or window_size(len(item.words)), []).append((no, item.words))
    held = texts.sparkSession.sparkContext.broadcast((items, [ItemIndex.build(w, of) for w, of in by_window.items()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, indexes = held.value
        known = WordHashes()
        ids: list[int] = []
        parts: list[np.ndarray] = []
        total = 0

        def search() -> pa.RecordBatch:
            flat = np.concatenate(parts)
            begin = np.cumsum([0, *map(len, parts)])
            cases: dict[tuple[int, int], list[np.ndarray]] = {}
            for index in indexes:
                for a in range(0, len(flat), SLICE_WORDS):
                    q = fingerprints(flat[a : a + SLICE_WORDS + index.window - 1], index.window)
                    at, hit = index.near(q, radius)
                    at = at + a
                    part = np.searchsorted(begin, at, side="right") - 1
                    whole = at + index.window <= begin[part + 1]
                    at, hit, part = at[whole], hit[whole], part[whole]
                    if not len(at):
                        continue
                    shift = at - begin[part] - index.offset[hit]
                    both = part.astype(np.int64) * len(items) + index.item[hit]
                    order = np.argsort(both, kind="stable")
                    keys, first = np.unique(both[order], return_index=True)
                    for k, s in zip(keys, np.split(shift[order], first[1:]), strict=True):
                        cases.setdefault(divmod(int(k), len(items)), []).append(s)
            return _rows([ids[part] for part, _ in cases], [(parts[part], items[no], np.concatenate(shifts)) for (part, no), shifts in cases.items()])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for words in _message_words(text):
                    if words:
                        ids.append(i)
                        parts.append(hashes(words, known))
                        total += len(words)
                if total >= SLICE_WORDS:
                    yield search()
                    ids, parts, total = [], [], 0
                    if len(known) > 1_000_000:
                        known = WordHashes()
        if parts:
            yield search()

    return texts.mapInArrow(run, FOUND)


def _windows(rows: DataFrame, sizes: list[int] | None, window: int | None, key: str) -> DataFrame:
    """(size, print, pos, key) of all windows of ``words``: of each of the sizes, or of the size that an item's own length gives."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, words in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
                h = np.ascontiguousarray(words, np.int64).view(np.uint64)
                for size in sizes or [window or window_size(len(h))]:
                    p = fingerprints(h, size)
                    n = len(p)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), pa.array(p.view(np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, no))], names=["size", "print", "pos", key])

    return rows.select(key, "words").mapInArrow(cut, f"size int, print long, pos int, {key} long")


def _joined(texts: DataFrame, items: DataFrame, radius: int, window: int | None) -> DataFrame:
    """The same for items of any number: the windows of messages and of items meet in a join on each of the four blocks."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            ids, out = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in _message_words(text):
                    if w:
                        ids.append(i)
                        out.append(hashes(w, known).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "words"])

    parts = written(texts.mapInArrow(words, "doc_id long, words array<long>").withColumn("part", F.monotonically_increasing_id()), "words")
    lengths = [r.n for r in items.select(F.size("words").alias("n")).distinct().toLocalIterator()]
    sizes = [window] if window else sorted({window_size(n) for n in lengths})
    blocks = F.array(*(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("print", 16 * b).bitwiseAND(F.lit(0xFFFF)).alias("bits")) for b in range(BLOCKS)))
    left = _windows(parts, sizes, window, "part").select("size", "print", "pos", "part", F.inline(blocks))
    right = _windows(items, None, window, "item_no").select("size", F.col("print").alias("item_print"), F.col("pos").alias("item_pos"), "item_no", F.inline(blocks))
    near = left.join(right, ["size", "block", "bits"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    cases = near.groupBy("part", "item_no").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("shifts"))
    rows = cases.join(parts, "part").join(items.withColumnRenamed("words", "item_words"), "item_no").select("doc_id", "words", "item_id", "item_words", "weights", "shifts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            code = lambda x: np.ascontiguousarray(x, np.int64).view(np.uint64)
            pairs = [(code(d), Item(int(i), code(w), np.asarray(g, float)), np.asarray(s, np.int64)) for d, i, w, g, s in zip(c["words"], c["item_id"], c["item_words"], c["weights"], c["shifts"], strict=True)]
            yield _rows(c["doc_id"].tolist(), pairs)

    return rows.mapInArrow(check, FOUND)
