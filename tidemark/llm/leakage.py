"""Evaluation texts that leak into training text: a BM25 index of the items, pivots and block maxima, exact verification.

Passages of the documents are the queries. The threshold of an item is the least score that a leak can have, so
retrieval loses none; what is retrieved is verified word by word.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread

#: Consecutive words of an item that make a leak, and the share of an item's words that do in order.
RUN, SHARE = 16, 2 / 3
#: A stretch of a document in which that share must lie, in lengths of the item.
STRETCH = 2
#: Items that share block maxima and are scored together, and the words that a block may hold (more only in one item).
GROUP, GROUP_WORDS = 32, 4096
K1, B = 1.2, 0.75
#: Factor that keeps rounding from lifting a threshold.
SLACK = 1 - 1e-4
#: Entries of the lists that a worker walks at a time, and blocks whose tables it keeps.
ENTRIES, TABLES = 3_000_000, 64
#: Items of one index, a copy of which each worker holds; more items go in several indexes.
INDEX_ITEMS = 20_000
#: Texts that are searched together.
TEXTS = 512

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_OUTSIDE = re.compile(r"\[(?:https?:)?//\S+?(?:\s+([^\]\n]*))?\]")
_TABLE = re.compile(r"^\s*(?:\{\||\|-).*$", re.M)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_QUOTES = re.compile(r"'{2,}")
_WORD = re.compile(r"[^\W_]+")


def shown_text(text: str) -> str:
    """Wiki markup to its shown text: comments, ref elements and templates go with their content, links
    leave their label, tags and table frames vanish, entities are resolved. Unclosed ones stay."""
    if "<" in text:
        if "<!--" in text:
            text = _COMMENT.sub("", text)
        if "<ref" in text or "<REF" in text or "<Ref" in text:
            text = _REF.sub(" ", text)
    if "{{" in text:
        n = 1
        while n:
            text, n = _TEMPLATE.subn(" ", text)
    if "[" in text:
        if "[[" in text:
            n = 1
            while n:
                text, n = _LINK.subn(r"\1", text)
        if "[http" in text or "[//" in text:
            text = _OUTSIDE.sub(lambda m: m.group(1) or " ", text)
    if "{|" in text or "|-" in text:
        text = _TABLE.sub(" ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "''" in text:
        text = _QUOTES.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    return text


def words(text: str) -> list[str]:
    """The words of a text's shown form, without punctuation and case."""
    return _WORD.findall(shown_text(text).lower())


@dataclass
class Item:
    item_id: int
    ids: np.ndarray
    given: dict[int, int] | None = None
    answer: list[str] | None = None

    @property
    def masks(self) -> dict[int, int]:
        """For each word the bits of its places in the item."""
        if self.given is None:
            self.given = {}
            for k, x in enumerate(self.ids.tolist()):
                self.given[x] = self.given.get(x, 0) | (1 << k)
        return self.given


class Index:
    """The items of an evaluation set: their runs of RUN words, and inverted lists from words to blocks of items."""

    def __init__(self, items: list[tuple]):
        parsed = [(r[0], words(r[1]), words(r[2]) if len(r) > 2 and r[2] else None) for r in items]
        self.vocabulary: dict[str, int] = {}
        for _, w, _ in parsed:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary))
        self.items = [Item(i, np.array([self.vocabulary[x] for x in w], dtype=np.int32), None, a) for i, w, a in parsed]
        hashes, owners, places = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
        df, v = np.zeros(len(self.vocabulary), dtype=np.int64), len(self.vocabulary)
        common: dict[int, int] = {}
        for d, x in enumerate(self.items):
            if len(x.ids):
                df[np.unique(x.ids)] += 1
                common[d] = int(np.bincount(x.ids).argmax())
                h = _hashes(x.ids)
                hashes.append(h), owners.append(np.full(len(h), d, dtype=np.int32)), places.append(np.arange(len(h), dtype=np.int32))
        h, owner, place = np.concatenate(hashes), np.concatenate(owners), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        #: Hash of every run of RUN words, sorted, with the item and the place where it stands.
        self.run_hash, self.run_item, self.run_place = h[order], owner[order], place[order]
        n = max(1, len(self.items))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        mean = max(1.0, float(np.mean([len(x.ids) for x in self.items]))) if self.items else 1.0
        # Neighbours are of like length and have the same most frequent word, as they then tend to share words.
        self.blocks: list[Block] = []
        held: list[int] = []
        size = lambda d: len(self.items[d].ids)
        for d in sorted(common, key=lambda d: (common[d], size(d), d)):
            if held and (len(held) == GROUP or size(d) > 1.3 * size(held[0]) + 8 or (len(held) + 1) * size(d) > GROUP_WORDS):
                self.blocks.append(Block(held, self.items, idf, mean))
                held = []
            held.append(d)
        if held:
            self.blocks.append(Block(held, self.items, idf, mean))
        # The lists: for each word the blocks that hold it, and its number there.
        sizes = [len(b.terms) for b in self.blocks]
        term = np.concatenate([b.terms for b in self.blocks]) if self.blocks else np.zeros(0, dtype=np.int64)
        order = np.argsort(term, kind="stable")
        self.listed = np.bincount(term, minlength=v)
        self.first = np.concatenate([[0], np.cumsum(self.listed)[:-1]]).astype(np.int64) if v else np.zeros(0, dtype=np.int64)
        self.list_block = np.repeat(np.arange(len(sizes)), sizes)[order].astype(np.int32)
        self.list_local = np.concatenate([np.arange(s) for s in sizes])[order].astype(np.int32) if sizes else np.zeros(0, dtype=np.int32)


class Block:
    """Items of like length and words, scored together, with the greatest weights among them (block maxima).

    A word that an item holds k times has k columns: in a passage column j is set if the word stands
    there at least j times, so every occurrence that can count adds its share of the word's BM25 weight.
    """

    def __init__(self, members: list[int], items: list[Item], idf: np.ndarray, mean: float):
        self.members = np.array(members)
        self.lengths = np.array([len(items[d].ids) for d in members], dtype=np.int64)
        n = len(members)
        self.stretch, self.need = STRETCH * self.lengths, -(-2 * self.lengths // 3)
        self.reach = int(self.stretch.max())
        self.limbs = -(-int(self.lengths.max()) // 64)
        self.place = np.concatenate([np.arange(k) for k in self.lengths])
        self.owner = np.repeat(np.arange(n), self.lengths)
        self.terms, self.local = np.unique(np.concatenate([items[d].ids for d in members]).astype(np.int64), return_inverse=True)
        times = np.bincount(self.local * n + self.owner, minlength=len(self.terms) * n).reshape(-1, n)
        weight = idf[self.terms][:, None] * times * (K1 + 1) / (times + K1 * (1 - B + B * self.lengths / mean))
        unit = weight / np.maximum(times, 1)
        self.threshold = np.zeros(n)
        pivotal = np.zeros(len(self.terms), dtype=bool)
        for i in range(n):
            # The least that SHARE of an item's words can score: all but its heaviest third of occurrences.
            t = np.flatnonzero(times[:, i])
            heavy = t[np.argsort(-unit[t, i], kind="stable")]
            before = np.cumsum(times[heavy, i]) - times[heavy, i]
            lost = np.clip(self.lengths[i] - self.need[i] - before, 0, times[heavy, i]) @ unit[heavy, i]
            self.threshold[i] = (weight[:, i].sum() - lost) * SLACK
            # Pivots: the commonest words that together stay below the threshold are no reason to look at an item.
            light = t[np.argsort(idf[self.terms[t]], kind="stable")]
            pivotal[light[np.cumsum(weight[light, i]) >= self.threshold[i]]] = True
        most = times.max(axis=1)
        self.column_term = np.repeat(np.arange(len(self.terms)), most)
        self.column_level = np.arange(len(self.column_term)) - np.repeat(np.cumsum(most) - most, most) + 1
        self.column_max = np.where(self.column_level[:, None] <= times[self.column_term], unit[self.column_term], 0).max(axis=1).astype(np.float32)
        self.pivotal = pivotal
        for name in ("place", "owner", "local", "column_term", "column_level"):
            setattr(self, name, getattr(self, name).astype(np.int32))
        self.idf, self.mean = idf[self.terms].astype(np.float32), mean
        self.made: tuple | None = None

    def tables(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(weights and presence by column and item, masks of places by word and item, a table per limb); the
        tables of the last blocks are kept."""
        if self.made is None:
            n = len(self.members)
            times = np.bincount(self.local * n + self.owner, minlength=len(self.terms) * n).reshape(-1, n)
            unit = self.idf[:, None] * (K1 + 1) / (times + K1 * (1 - B + B * self.lengths / self.mean))
            there = self.column_level[:, None] <= times[self.column_term]
            masks = []
            for q in range(self.limbs):
                m = np.zeros(len(self.terms) * n, dtype=np.uint64)
                x = self.place // 64 == q
                np.bitwise_or.at(m, self.local[x] * n + self.owner[x], np.uint64(1) << (self.place[x] % 64).astype(np.uint64))
                masks.append(m.reshape(-1, n))
            self.made = (np.where(there, unit[self.column_term], 0).astype(np.float32), there.astype(np.float32), masks)
            _MADE.append(self)
            if len(_MADE) > TABLES:
                _MADE.pop(0).made = None
        return self.made


_MADE: list[Block] = []


def _hashes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of RUN ids."""
    n = len(ids) - RUN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    wide, out = ids.astype(np.int64).astype(np.uint64), np.zeros(n, dtype=np.uint64)
    for k in range(RUN):
        out = out * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + n]
    return out


def _gather(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the runs first[i] .. first[i] + count[i]."""
    total = int(count.sum())
    row = np.repeat(np.arange(len(count)), count)
    start = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return row, start + np.arange(total)


def flatten(texts: list[list[str]], index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(word ids of all texts, -1 for words of no item, two of them after each text; each text's start)."""
    get = index.vocabulary.get
    flat: list[int] = []
    bounds = [0]
    for w in texts:
        flat.extend([get(x, -1) for x in w])
        flat.extend((-1, -1))
        bounds.append(len(flat))
    return np.array(flat, dtype=np.int64), np.array(bounds)


def sharing(ids: np.ndarray, starts: np.ndarray, index: Index) -> set[tuple[int, int]]:
    """(text, item) wherever SHARE of an item's words stand in its order within its stretch. Exact.

    Words are looked up in the lists, which gives for each block that any of them is in the sequence of its
    own words; see _in_block().
    """
    out: set[tuple[int, int]] = set()
    if not len(index.listed):
        return out
    room = np.cumsum(np.where(ids >= 0, index.listed[ids], 0))
    room = np.concatenate([[0], room])[starts]
    at = 0
    while at < len(starts) - 1:
        # As many texts at once as have room in the array of list entries; at least one.
        end = max(at + 1, int(np.searchsorted(room, room[at] + ENTRIES, side="right")) - 1)
        place = np.flatnonzero(ids[starts[at] : starts[end]] >= 0) + starts[at]
        row, entry = _gather(index.first[ids[place]], index.listed[ids[place]])
        block = index.list_block[entry]
        # Stable, so that words stay in order (16-bit numbers are sorted by radix).
        order = np.argsort(block.astype(np.uint16) if len(index.blocks) < 2**16 else block, kind="stable")
        edges = np.searchsorted(block[order], np.arange(len(index.blocks) + 1))
        place, local = place[row[order]], index.list_local[entry[order]]
        for b in np.flatnonzero(np.diff(edges)).tolist():
            x = slice(edges[b], edges[b + 1])
            out |= _in_block(place[x], local[x], starts[at : end + 1], at, index.blocks[b], index)
        at = end
    return out


def _in_block(place: np.ndarray, local: np.ndarray, starts: np.ndarray, at: int, block: Block, index: Index) -> set[tuple[int, int]]:
    """sharing() for the items of a block; place and local are the texts' words that the block has, in order.

    Passages are the queries: passage h of a text answers for the stretches that begin in its h-th `reach`
    words and sees as many words more, so every stretch lies in one. A passage without a pivotal word, or
    whose block maxima fall short of the least threshold, is not scored. What reaches its threshold
    - which SHARE of an item's words cannot miss - is verified by common subsequences: first of whole
    passages with all items of the block at once, then of ever fewer starts of a stretch, down to single ones.
    """
    if not block.pivotal[local].any():
        return set()
    reach, n = block.reach, len(block.members)
    text = np.searchsorted(starts, place, side="right") - 1
    # Halves: the texts' pieces of `reach` words that hold any of the block's words; a passage is two neighbours.
    half = (place - starts[text]) // reach
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (half[1:] != half[:-1])]))
    begin, end = new, np.append(new[1:], len(place))
    owner, half = text[new], half[new]
    follows = np.concatenate([(owner[1:] == owner[:-1]) & (half[1:] == half[:-1] + 1), [False]])
    # A stretch whose words all stand in a half that follows an empty one begins there.
    number = np.repeat(np.arange(len(new)), end - begin)
    counts = np.bincount(number * len(block.terms) + local, minlength=len(new) * len(block.terms)).reshape(len(new), -1)
    counts[:-1] += counts[1:] * follows[:-1, None]
    rows = np.flatnonzero(counts[:, block.pivotal].any(axis=1))
    there = (counts[rows][:, block.column_term] >= block.column_level).astype(np.float32)
    alive = there @ block.column_max >= block.threshold.min() * SLACK
    if not alive.any():
        return set()
    weights, presence, masks = block.tables()
    there, rows = there[alive], rows[alive]
    good = (there @ weights >= block.threshold * SLACK) & (there @ presence >= block.need - 0.5)
    alive = good.any(axis=1)
    good, rows = good[alive], rows[alive]
    if not len(rows):
        return set()
    last = np.where(follows[rows], end[np.minimum(rows + 1, len(end) - 1)], end[rows])
    good &= common(local, begin[rows], last, masks, None) >= block.need
    row, item = np.nonzero(good)
    origin, close = starts[owner[rows]] + half[rows] * reach, starts[owner[rows] + 1]
    a, b = np.zeros(len(row), dtype=np.int64), np.full(len(row), reach - 1)
    found = np.zeros(good.shape, dtype=bool)
    while len(row):
        # The stretch that begins in the middle, and the starts on either side of it.
        middle = (a + b) // 2
        hit = _shared(place, local, origin[row] + middle, origin[row] + middle, close[row], item, block, masks)
        found[row[hit], item[hit]] = True
        row, item = np.concatenate([row, row]), np.concatenate([item, item])
        a, b = np.concatenate([a, middle + 1]), np.concatenate([middle - 1, b])
        keep = np.flatnonzero((a <= b) & ~found[row, item])
        row, item, a, b = row[keep], item[keep], a[keep], b[keep]
        keep = _shared(place, local, origin[row] + a, origin[row] + b, close[row], item, block, masks)
        row, item, a, b = row[keep], item[keep], a[keep], b[keep]
    row, item = np.nonzero(found)
    return {(at + t, d) for t, d in zip(owner[rows[row]].tolist(), block.members[item].tolist())}


def _shared(place, local, first, final, close, item, block: Block, masks) -> np.ndarray:
    """Whether the words from place `first` to where a stretch from `final` ends share enough with the item."""
    x = np.searchsorted(place, first)
    y = np.searchsorted(place, np.minimum(final + block.stretch[item], close))
    return common(local, x, y, masks, item) >= block.need[item]


def common(local: np.ndarray, first: np.ndarray, end: np.ndarray, masks: list[np.ndarray], item: np.ndarray | None) -> np.ndarray:
    """Lengths of the longest common subsequences of the sequences local[first[i] : end[i]] with item[i], or, without
    item, with all items of the block.

    The bit-parallel recurrence, a bit per word of the item in 64-bit limbs with carries, for all
    sequences at once.
    """
    size = end - first
    order = np.argsort(-size, kind="stable")
    begin, size = first[order], size[order]
    shape = (len(first),) if item is not None else (len(first), masks[0].shape[1])
    out = np.zeros(shape, dtype=np.int64)
    if not len(first):
        return out
    if item is not None:
        item = item[order]
    free = [np.full(shape, 2**64 - 1, dtype=np.uint64) for _ in masks]
    live = len(first)
    for j in range(int(size[0])):
        while size[live - 1] <= j:
            live -= 1
        t = local[begin[:live] + j]
        carry = None
        for q, mask in enumerate(masks):
            v = free[q][:live]
            u = mask[t] if item is None else mask[t, item[:live]]
            u &= v
            s = v + u
            if q + 1 == len(masks):
                over = None
            else:
                over = s < v
            if carry is not None:
                s += carry
                if over is not None:
                    over |= s < carry
            carry = None if over is None else over.astype(np.uint64)
            # The bits outside the mask stay as they were.
            np.bitwise_xor(u, v, out=u)
            np.bitwise_or(s, u, out=v)
    out[order] = 64 * len(masks) - sum(np.bitwise_count(f).astype(np.int64) for f in free)
    return out


def runs(ids: np.ndarray, starts: np.ndarray, index: Index) -> set[tuple[int, int]]:
    """(text, item) wherever RUN consecutive words of the item stand in the text. Exact."""
    if len(ids) < RUN or not len(index.run_hash):
        return set()
    total = np.concatenate([[0], np.cumsum(ids >= 0)])
    at = np.flatnonzero(total[RUN:] - total[:-RUN] == RUN)
    hashes = _hashes(ids)[at]
    low = np.searchsorted(index.run_hash, hashes, side="left")
    count = np.searchsorted(index.run_hash, hashes, side="right") - low
    row, run = _gather(low, count)
    out = set()
    for a, d, k in zip(at[row].tolist(), index.run_item[run].tolist(), index.run_place[run].tolist()):
        text = int(np.searchsorted(starts, a, side="right") - 1)
        if (text, d) not in out and (ids[a : a + RUN] == index.items[d].ids[k : k + RUN]).all():
            out.add((text, d))
    return out


def in_stretch(ids: list[int], item: Item) -> bool:
    """Whether SHARE of the item's words stand in its order within STRETCH times its length. Exact."""
    length = len(item.ids)
    need = -(-2 * length // 3)
    if not length or _in_order(ids, item, length) < need:
        return False
    width = STRETCH * length
    if len(ids) <= width:
        return True
    # Starts are tried in groups: where a stretch and the group's starts together fall short, each does.
    step = max(1, length // 2)
    for c in range(0, len(ids), step):
        if _in_order(ids[c : c + width + step], item, length) < need:
            continue
        for k in range(c, min(c + step, len(ids))):
            if ids[k] in item.masks and _in_order(ids[k : k + width], item, length) >= need:
                return True
    return False


def _in_order(ids: list[int], item: Item, length: int) -> int:
    """Length of the longest common subsequence with the item, a bit per word of the item."""
    full = (1 << length) - 1
    v = full
    get = item.masks.get
    for x in ids:
        m = get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def leaks(texts: list[str], index: Index) -> list[tuple[int, int]]:
    """(text, item position) of all leaks among the texts."""
    return _leaks([words(t) for t in texts], index)


def _leaks(texts: list[list[str]], index: Index) -> list[tuple[int, int]]:
    ids, starts = flatten(texts, index)
    return sorted(runs(ids, starts, index) | sharing(ids, starts, index))


def holds(text: list[str], part: list[str]) -> bool:
    """Whether the words of part stand one after the other in the text."""
    return f" {' '.join(part)} " in f" {' '.join(text)} "


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document that holds a leaked passage of an item.

    docs (doc_id bigint, text string), items (item_id bigint, text string); null and empty texts
    leak nothing, items without words are never leaked; equal items are all reported. An empty
    table on either side gives an empty result.

    A leak is RUN consecutive words of the item, or SHARE of its words in its order within a stretch
    of STRETCH times its length, in the document's shown text. Items are held-out sets of bounded
    size: they are counted, indexed INDEX_ITEMS at a time on the driver, and each index is sent to the
    workers once; every document is read whole, in one pass per index, and nothing is shuffled but the result.
    """
    return leaked_answers(docs, items).select("doc_id", "item_id").distinct()


def leaked_answers(docs: DataFrame, items: DataFrame) -> DataFrame:
    """leaked_items() with answer: whether the item's answer stands in the document too; null where the
    item has none (or items have no column answer). A repeated doc_id gives repeated rows."""
    spark = docs.sparkSession
    answer = F.col("answer") if "answer" in items.columns else F.lit(None)
    held = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text", answer.cast("string").alias("answer"))
    rows = sorted((tuple(r) for r in held.toLocalIterator()), key=lambda r: (r[0], r[1], r[2] or ""))
    texts = spread(docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.col("text") != "")))
    out = None
    for k in range(0, max(1, len(rows)), INDEX_ITEMS):
        shared = spark.sparkContext.broadcast(Index(rows[k : k + INDEX_ITEMS]))
        part = texts.mapInPandas(_leaks_of(shared), "doc_id bigint, item_id bigint, answer boolean")
        out = part if out is None else out.unionByName(part)
    return out


def _leaks_of(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            for k in range(0, len(batch), TEXTS):
                part = batch.iloc[k : k + TEXTS]
                texts = [words(t) for t in part["text"]]
                doc = part["doc_id"].to_numpy()
                found = []
                for t, d in _leaks(texts, index):
                    answer = index.items[d].answer
                    found.append((doc[t], index.items[d].item_id, None if not answer else holds(texts[t], answer)))
                if found:
                    yield pd.DataFrame(found, columns=["doc_id", "item_id", "answer"]).astype({"answer": "boolean"})

    return run
