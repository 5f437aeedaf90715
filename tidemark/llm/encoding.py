"""Text decoded with the wrong character encoding: find it, learn the swap, restore the original.

A code-page swap is a substitution cipher: each byte of the text stands for another letter. Which
swap was at work is unknown and differs by source and stretch. The text's own language decides: a
bigram model over all documents says how likely each reading is. Ciphers start from pairs of code
pages: the usual ones, and of all others those that the texts' own counts of neighbours propose;
their byte-to-letter tables are re-estimated per source by expectation-maximization against the
bigrams, and the stretches that a cipher explains better are rewritten with translate().
"""

from __future__ import annotations

import importlib
import json
import pkgutil
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, join_lookup, spread

#: Encodings in which text may have been written, and in which it may have been read instead.
WRITTEN = ("utf-8", "cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850")
READ = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac_roman")
#: Pages of other systems than the reader's own, which were read as one of Windows or the web.
FOREIGN, COMMON = ("mac_roman", "cp437", "cp850"), ("cp1252", "cp1250", "iso8859-2")
SWAPS = tuple((w, r) for w in WRITTEN for r in READ if w != r and (w not in FOREIGN or r in COMMON))

#: Characters that the bigram model tells apart, by block; all others are one.
BLOCKS = (
    (0x00, 0x17F),
    (0x2C0, 0x2DF),
    (0x370, 0x3FF),
    (0x400, 0x45F),
    (0x490, 0x491),
    (0x5D0, 0x5EA),
    (0x60C, 0x6FF),
    (0xE01, 0xE5B),
    (0x1E9E, 0x1E9E),
    (0x2010, 0x203A),
    (0x2070, 0x20AC),
    (0x2100, 0x2126),
    (0x2190, 0x21FF),
    (0x2200, 0x2265),
    (0x2310, 0x2321),
    (0x2500, 0x25A0),
    (0xFB01, 0xFB02),
    (0xFFFD, 0xFFFD),
)
#: Signs whose bigrams are counted together, as a text's choice among them says nothing about its encoding.
SAME_SIGN = {"„": "“", "”": "“", "«": "“", "»": "“", "—": "–"}
LOST = "�"
#: Nats by which a stretch must read better under a cipher to be a case: one of single bytes, and UTF-8,
#: whose byte sequences hardly come about by chance.
CASE, CASE_UTF8 = 5.0, 4.0
#: A pair of pages that is not of SWAPS is proposed if it explains so many symbols, of so many places each at least: where
#: they stand is then known, within these factors, as well as where the letters stand that they would be, and those are
#: so many times as frequent.
SYMBOLS, PLACES_EACH, FIT, COMMONER = 3, 10, (0.7, 1.3), 2
#: A symbol leaves the letter of its start only if another one fits better in so many different places, in this share
#: of them, and by so many nats in all.
PLACES, VOTES, LEAVE = 5, 0.95, 20.0
#: A token speaks for a single-byte cipher with its whole gain only if what it becomes is known: each
#: changed letter stands between its neighbours at least SEEN times in all texts and RATIO times as often
#: as the one it replaces; else with at most WEAK nats.
SEEN, RATIO, WEAK = 5, 8, 1.0
#: That ratio for a sign that stands alone between blanks, where no letter beside it helps.
RATIO_ALONE = 400
#: Slots of the table of letter triples (a bounded sketch; two triples may share a slot).
TRIPLES = 4_194_301
#: Bigrams of a token below this (nats) make it suspicious; tokens of likelier ones are taken as they are.
UNLIKELY = -5.0
#: What a clean-looking token that the cipher would change costs a stretch.
BREAK = 3.0
#: Times a stretch can have been decoded wrongly one after the other.
LAYERS = 3
CACHE = 400_000
#: Nats by which the letter triples of a stretch must be more frequent in all texts under a swap than as they
#: stand for the stretch to be left out of the counts, and the most that one token adds to that.
SUSPECT, MOST = 8.0, 4.0
#: Different tokens of which such a stretch must hold.
SUSPECT_TOKENS = 3


@cache
def _classes() -> tuple[np.ndarray, list[str]]:
    """Class of each 16-bit unit (upper and lower case share one, digits too), and a letter per class."""
    table = np.ones(0x10000, dtype=np.int32)
    letters = [" ", "\x01"]
    known: dict[str, int] = {" ": 0}
    for first, last in BLOCKS:
        for code in range(first, last + 1):
            low = chr(code).lower()
            low = "0" if low.isdigit() and low.isascii() else " " if low in "\n\t\r" else low[:1]
            if low not in known:
                known[low] = len(letters)
                letters.append(low)
            table[code] = known[low]
    return table, letters


def _units(text: str) -> np.ndarray:
    return _classes()[0][np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)]


def _triples(u: np.ndarray) -> np.ndarray:
    size = len(_classes()[1])
    return ((u[..., :-2].astype(np.int64) * size + u[..., 1:-1]) * size + u[..., 2:]) % TRIPLES


def _alone(code):
    """Slot of a character that stands between blanks; unlike in triples, case counts."""
    return (code * 7919 + 17) % TRIPLES


@cache
def _foreign() -> np.ndarray:
    """Whether a class is no ASCII character."""
    return np.array([i == 1 or not c.isascii() for i, c in enumerate(_classes()[1])])


def _add_counts(texts: list[str], total: np.ndarray, triples: np.ndarray, sign: int = 1, where: np.ndarray | None = None, bit: int = 0) -> None:
    size, foreign = len(_classes()[1]), _foreign()
    for i in range(0, len(texts), 256):
        text = "\n".join(texts[i : i + 256])
        u = _units(text)
        if len(u) < 3:
            continue
        total += sign * np.bincount(u[:-1] * size + u[1:], minlength=size * size)
        at = np.flatnonzero(foreign[u])
        near = np.unique(np.concatenate([at - 2, at - 1, at]))
        near = near[(near >= 0) & (near + 2 < len(u))]
        slot, n = np.unique(_triples(np.stack([u[near], u[near + 1], u[near + 2]], axis=1))[:, 0], return_counts=True)
        triples[slot] += sign * n
        if where is not None:
            where[slot] |= bit
        inner = at[(at > 0) & (at + 1 < len(u))]
        lone = inner[(u[inner - 1] == 0) & (u[inner + 1] == 0)]
        code = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)[lone].astype(np.int64)
        slot, n = np.unique(_alone(code), return_counts=True)
        triples[slot] += sign * n


def _count_rows(total: np.ndarray, triples: np.ndarray, where: np.ndarray) -> Iterator[pd.DataFrame]:
    size = len(_classes()[1])
    at, slot = np.flatnonzero(total), np.flatnonzero(triples)
    yield pd.DataFrame({"a": (at // size).astype(np.int32), "b": (at % size).astype(np.int32), "n": total[at], "groups": np.int32(0)})
    yield pd.DataFrame({"a": slot.astype(np.int32), "b": np.int32(-1), "n": triples[slot], "groups": where[slot]})


def _no_counts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(len(_classes()[1]) ** 2, dtype=np.int64), np.zeros(TRIPLES, dtype=np.int64), np.zeros(TRIPLES, dtype=np.int32)


_COUNTS = "a int, b int, n bigint, groups int"


def language_counts(docs: DataFrame) -> DataFrame:
    """(a, b, n, groups) over all whole texts of docs(source, text), a null source being '': how often class b follows class a, and, with
    b = -1, how often the triples of slot a stand in the texts (those with a character that is not ASCII, and
    such characters between blanks) and in which of 31 groups of sources, a bit per group."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, triples, where = _no_counts()
        for batch in batches:
            groups: dict[int, list[str]] = defaultdict(list)
            for source, text in zip(batch["source"], batch["text"]):
                if text:
                    groups[zlib.crc32((source or "").encode("utf-8", "surrogatepass")) % 31].append(text)
            for g, texts in groups.items():
                _add_counts(texts, total, triples, where=where, bit=1 << g)
        yield from _count_rows(total, triples, where)

    return docs.select("source", "text").mapInPandas(count, _COUNTS).groupBy("a", "b").agg(F.sum("n").alias("n"), F.bit_or("groups").alias("groups"))


def suspect_counts(docs: DataFrame, tables, proposed: tuple[int, ...] = ()) -> DataFrame:
    """(a, b, n) as language_counts(), negative: what the suspected stretches of docs(text) add to the counts.

    tables are the broadcast triple_table() and group_table() of all texts, suspected stretches included.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, less, where = _no_counts()
        suspects = Suspects(*tables.value, proposed)
        for batch in batches:
            texts = batch["text"].tolist()
            for i in range(0, len(texts), 256):
                pruned = suspects.without(texts[i : i + 256])
                _add_counts([t for t, _ in pruned], total, less, -1)
                _add_counts([t for _, t in pruned], total, less)
        yield from _count_rows(total, less, where)

    return docs.select("text").mapInPandas(count, _COUNTS).groupBy("a", "b").agg(F.sum("n").alias("n"))


def bigram_model(counts: pd.DataFrame) -> np.ndarray:
    """log P(b | a) by class, smoothed with the classes' own frequencies."""
    size = len(_classes()[1])
    counts = counts[counts["b"] >= 0]
    letters = _classes()[1]
    pool = np.array([letters.index(SAME_SIGN.get(c, c)) for c in letters])
    n = np.zeros((size, size))
    np.add.at(n, (pool[counts["a"]], pool[counts["b"]]), counts["n"])
    alone = n.sum(0) + 0.05
    alone /= alone.sum()
    weight = 1.0
    return np.log((n + weight * alone) / (n.sum(1, keepdims=True) + weight)).astype(np.float32)[np.ix_(pool, pool)]


def triple_table(counts: pd.DataFrame) -> np.ndarray:
    counts = counts[counts["b"] < 0]
    out = np.zeros(TRIPLES, dtype=np.int32)
    out[counts["a"]] = np.minimum(counts["n"], 2**31 - 1)
    return out


def group_table(counts: pd.DataFrame) -> np.ndarray:
    """Number of groups of sources in which the triples of each slot stand."""
    counts = counts[counts["b"] < 0]
    out = np.zeros(TRIPLES, dtype=np.int8)
    out[counts["a"]] = np.bitwise_count(counts["groups"].to_numpy().astype(np.int64))
    return out


@cache
def _open(byte: int, read: str) -> bool:
    """Open in the code page, or a control character of Latin-1 that its extension reads as something else."""
    if byte < 0xA0 and read == "cp1252":
        return True
    try:
        bytes([byte]).decode(read)
        return False
    except UnicodeDecodeError:
        return True


@cache
def code_page_table(written: str, read: str) -> dict[int, str]:
    """Character read -> character written, for single-byte encodings; ASCII stays."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            true = bytes([b]).decode(written)
        except UnicodeDecodeError:
            continue
        try:
            seen = bytes([b]).decode(read)
        except UnicodeDecodeError:
            seen = chr(b)
        if seen != true:
            out[ord(seen)] = true
        if read == "cp1252" and b < 0xA0:
            out.setdefault(b, true)
    return out


@cache
def _bytes_read(read: str) -> dict[str, int]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(read)] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0x100):
        if _open(b, read):
            out.setdefault(chr(b), b)
    return out


@cache
def _runs(read: str) -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, _bytes_read(read))) + "]{2,}")


_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xe0[\xa0-\xbf][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}")


def _from_utf8(text: str, read: str) -> str:
    """Every whole UTF-8 sequence within the runs of characters that stand for bytes; the rest as it is."""
    known = _bytes_read(read)

    def run(m: re.Match) -> str:
        chars = m.group()
        raw = bytes(known[c] for c in chars)
        out, at = [], 0
        for s in _SEQUENCE.finditer(raw):
            out.append(chars[at : s.start()])
            out.append(s.group().decode("utf-8"))
            at = s.end()
        out.append(chars[at:])
        return "".join(out)

    return _runs(read).sub(run, text)


@cache
def _pages() -> tuple[str, ...]:
    """Every single-byte code page that extends ASCII, of those that come with Python; one name per table."""
    import encodings

    out: dict[str, str] = {}
    plain = bytes(range(0x80)).decode("ascii")
    for name in sorted(m.name for m in pkgutil.iter_modules(encodings.__path__)):
        try:
            table = getattr(importlib.import_module(f"encodings.{name}"), "decoding_table", None)
        except ImportError:
            continue
        if isinstance(table, str) and len(table) == 256 and table[:0x80] == plain:
            out.setdefault(table[0x80:], name)
    return tuple(out.values())


@cache
def _page_codes() -> np.ndarray:
    """Code point of each upper byte in each page, -1 where it has none (or none of 16 bits)."""
    out = np.full((len(_pages()), 0x80), -1, dtype=np.int64)
    for i, page in enumerate(_pages()):
        for b in range(0x80):
            try:
                out[i, b] = ord(bytes([b + 0x80]).decode(page))
            except UnicodeDecodeError:
                pass
    return np.where(out < 0x10000, out, -1)


def pages_of(swap: int) -> tuple[str, str]:
    """(written, read) of a swap's number: SWAPS come first, then all pairs of pages."""
    if swap < len(SWAPS):
        return SWAPS[swap]
    written, read = divmod(swap - len(SWAPS), len(_pages()))
    return _pages()[written], _pages()[read]


def swap_name(swap: int) -> str:
    return ">".join(pages_of(swap))


def start_table(swap: int) -> dict[int, str]:
    return code_page_table(*pages_of(swap))


def propose(counts: pd.DataFrame) -> tuple[int, ...]:
    """The pairs of code pages beyond SWAPS that the counts of neighbours speak for, by their numbers.

    The expectation of expectation-maximization, with each pair of pages as start: the symbols that a
    pair changes are taken for its letters, and so are their neighbours. A symbol is explained if its
    neighbours are as likely beside that letter as the letter's own ones are (both against any letter's).
    Rare but right letters have neighbours of their own, and a wrong pair hardly explains several
    symbols; of pairs that explain the same symbols the first is taken, then what explains other ones.
    """
    letters, table = _classes()[1], _classes()[0]
    size = len(letters)
    counts = counts[counts["b"] >= 0]
    n = np.zeros((size, size))
    np.add.at(n, (counts["a"], counts["b"]), counts["n"])
    if not n.sum():
        return ()
    alpha = np.array([c.isalpha() and not c.isascii() for c in letters])
    often = np.maximum(n.sum(0), n.sum(1))
    gains, own = [], np.zeros(size)
    # Once for what stands before a class, once for what stands after it.
    for m in (n, n.T):
        any_ = np.maximum(m.sum(1) / m.sum(), 1e-12)
        beside = (m + 0.5 * any_[:, None]) / (m.sum(0) + 0.5)
        gain = np.maximum(np.log(np.maximum(beside, 1e-12) / any_[:, None]), -8.0)
        own += (beside * gain).sum(0)
        gains.append(gain)
    codes = _page_codes()
    classes = np.where(codes >= 0, table[np.maximum(codes, 0)], -1)
    present = np.flatnonzero(often)
    near = [m[present] for m in (n, n.T)]
    found, tried = [], {}
    for r, w in np.ndindex(len(codes), len(codes)):
        if (_pages()[w], _pages()[r]) in _listed():
            continue
        changed = (codes[r] >= 0) & (codes[w] >= 0) & (codes[r] != codes[w])
        s, t = classes[r][changed], classes[w][changed]
        keep = (s != t) & (s > 1) & alpha[t] & (often[s] >= PLACES_EACH) & (often[t] >= COMMONER * often[s])
        if keep.sum() < SYMBOLS:
            continue
        # Upper and lower case are one class: of two letters for it the commoner one.
        becomes = np.arange(size)
        order = np.argsort(often[t], kind="stable")
        becomes[s[order]] = t[order]
        symbols = np.unique(s[keep])
        symbols = symbols[(becomes[symbols] != symbols) & alpha[becomes[symbols]] & (often[becomes[symbols]] >= COMMONER * often[symbols])]
        if len(symbols) < SYMBOLS:
            continue
        letter, neighbour = becomes[symbols], becomes[present]
        # Pages that do the same to what is there are one.
        known = tried.setdefault(neighbour.tobytes(), [])
        if not known:
            score = sum((m[:, symbols] * gain[np.ix_(neighbour, letter)]).sum(0) for m, gain in zip(near, gains))
            fit = score / (often[symbols] * np.maximum(own[letter], 1e-9))
            known.append((fit >= FIT[0]) & (fit <= FIT[1]))
        good = known[0]
        if good.sum() >= SYMBOLS:
            pairs = set(zip(symbols[good].tolist(), letter[good].tolist()))
            found.append((-good.sum() * often[symbols[good]].sum(), len(SWAPS) + w * len(_pages()) + r, pairs))
    out, explained = [], set()
    for _, swap, pairs in sorted(found, key=lambda x: x[:2]):
        if len(pairs - explained) >= SYMBOLS:
            out.append(swap)
            explained |= pairs
    return tuple(out)


@cache
def _listed() -> set[tuple[str, str]]:
    """SWAPS in the names of _pages()."""
    same = {bytes(range(0x80, 0x100)).decode(p, "replace"): p for p in _pages()}
    name = lambda p: p if p == "utf-8" else same.get(bytes(range(0x80, 0x100)).decode(p, "replace"), p)
    return {(name(w), name(r)) for w, r in SWAPS}


@dataclass
class Ciphers:
    """Byte-to-letter tables per (source, swap); where a source has none, those of the code pages."""

    learned: dict[tuple[str, int], dict[int, str]] = field(default_factory=dict)
    sources: set[str] = field(default_factory=set)
    #: Swaps beyond SWAPS that are tried.
    proposed: tuple[int, ...] = ()

    def add(self, source: str, text: str) -> None:
        """Tables of a source from rows (swap, symbol, letter) as JSON, each on top of its code page's."""
        self.sources.add(source)
        for swap, symbol, letter in json.loads(text):
            table = self.learned.setdefault((source, int(swap)), dict(start_table(int(swap))))
            table[int(symbol)] = letter

    def table(self, source: str, swap: int) -> dict[int, str]:
        return self.learned.get((source, swap)) or start_table(swap)

    def read(self, text: str, source: str, swap: int) -> str:
        if swap < len(SWAPS) and SWAPS[swap][0] == "utf-8":
            return _from_utf8(text, SWAPS[swap][1])
        return text.translate(self.table(source, swap))


SINGLE = tuple(k for k, (w, _) in enumerate(SWAPS) if w != "utf-8")
UTF8 = tuple(k for k, (w, _) in enumerate(SWAPS) if w == "utf-8")
_TWO = re.compile(r"[^\x00-\x7f]{2}")


class Reader:
    """Scores tokens under each cipher of a source, remembering those it has seen."""

    def __init__(self, model: np.ndarray, triples: np.ndarray, ciphers: Ciphers):
        self.model, self.triples, self.ciphers = model, triples, ciphers
        self.seen: dict[tuple[str, str], dict[int, float] | None] = {}
        self.maps: dict[str, np.ndarray] = {}
        self.single = (*SINGLE, *ciphers.proposed)

    def learn(self, source: str, tables: str) -> None:
        if source not in self.ciphers.sources:
            self.ciphers.add(source, tables)

    def _map(self, source: str) -> np.ndarray:
        """Class of each 16-bit unit after each single-byte cipher of the source."""
        if source not in self.maps:
            plain = _classes()[0]
            out = np.repeat(plain[None, :].astype(np.int16), len(self.single), axis=0)
            for i, k in enumerate(self.single):
                table = self.ciphers.table(source, k)
                for a, b in table.items():
                    if a < 0x10000:
                        out[i, a] = plain[ord(b)]
            self.maps[source] = out
        return self.maps[source]

    def score(self, u: np.ndarray) -> float:
        return float(self.model[u[:-1], u[1:]].sum())

    def gains(self, token: str, source: str) -> dict[int, float] | None:
        """Nats that speak for each swap that changes the token; None for a token that reads well as it is."""
        # Sources without ciphers of their own share what is known of a token.
        source = source if source in self.ciphers.sources else ""
        key = (token, source)
        if key in self.seen:
            return self.seen[key]
        if len(self.seen) > CACHE:
            self.seen.clear()
        text = " " + token + " "
        u = _units(text)
        pairs = self.model[u[:-1], u[1:]]
        out: dict[int, float] | None = None
        if float(pairs.min()) < UNLIKELY:
            out, total = {}, float(pairs.sum())
            raw = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
            new = self._map(source)[:, raw]
            changed = new != u
            gain = self.model[new[:, :-1], new[:, 1:]].sum(1) - total
            for i in np.flatnonzero(changed.any(1)).tolist():
                g = float(gain[i])
                if g > WEAK:
                    known = self._known(u, new[i], changed[i]) if len(u) > 3 else self._known_alone(token, source, self.single[i])
                    g = g if known else WEAK
                out[self.single[i]] = g
            if _TWO.search(token):
                for k in UTF8:
                    fixed = _from_utf8(token, SWAPS[k][1])
                    if fixed != token:
                        out[k] = self._undone(fixed) - total
        self.seen[key] = out
        return out

    def _undone(self, text: str) -> float:
        """Score of a text decoded from UTF-8, or of what it becomes if it is UTF-8 again."""
        best = self.score(_units(" " + text + " "))
        for _ in range(LAYERS - 1):
            more = {_from_utf8(text, SWAPS[k][1]) for k in UTF8} - {text} if _TWO.search(text) else ()
            if not more:
                break
            score, text = max((self.score(_units(" " + t + " ")), t) for t in more)
            best = max(best, score)
        return best

    def _known(self, old: np.ndarray, new: np.ndarray, changed: np.ndarray) -> bool:
        touched = changed[:-2] | changed[1:-1] | changed[2:]
        after = self.triples[_triples(new)][touched].min()
        before = self.triples[_triples(old)][touched].min()
        return bool(after >= SEEN and after >= RATIO * before)

    def _known_alone(self, token: str, source: str, swap: int) -> bool:
        new = self.ciphers.read(token, source, swap)
        if len(new) != 1 or ord(max(token, new)) > 0xFFFF:
            return False
        after, before = self.triples[_alone(ord(new))], self.triples[_alone(ord(token))]
        return bool(after >= SEEN and after >= RATIO_ALONE * before)

    def changes(self, token: str, source: str, swap: int) -> bool:
        return self.ciphers.read(token, source, swap) != token

    def best_stretch(self, tokens: list[tuple[int, str]], source: str) -> tuple[float, int, int, int]:
        """(gain, swap, first, last index into tokens) of the stretch and cipher that gain most, if it is a
        case; else a gain of 0.

        tokens are the (position, text) of the non-ASCII tokens. The gains within a stretch add up;
        tokens that read well and that the cipher would change count against it.
        """
        each = [self.gains(t, source) for _, t in tokens]
        swaps = {k for g in each if g for k, v in g.items() if v > WEAK}
        best = (0.0, -1, 0, 0)
        for k in sorted(swaps):
            least = CASE_UTF8 if k < len(SWAPS) and SWAPS[k][0] == "utf-8" else CASE
            run, first = 0.0, 0
            for i, g in enumerate(each):
                if g is None:
                    v = -BREAK if self.changes(tokens[i][1], source, k) else 0.0
                else:
                    v = g.get(k, 0.0)
                if run <= 0:
                    run, first = 0.0, i
                run += v
                if run >= least and run > best[0] + 1e-9:
                    best = (run, k, first, i)
        return best


class Suspects:
    """Finds the stretches that a swap turns into what is more frequent in all texts, however frequent they are.

    Where much text is misread alike, its letter sequences are no rarities, and a bigram model with them in it takes
    them for a language. But the right letters stay the more frequent ones, or those of more sources, in
    nearly every triple of a stretch; of a text that is right, a swap makes triples that are rarer or unknown.
    What counts is the frequency times the number of groups of sources.
    """

    def __init__(self, triples: np.ndarray, groups: np.ndarray, proposed: tuple[int, ...] = ()):
        self.reader = Reader(np.zeros((1, 1), dtype=np.float32), triples, Ciphers(proposed=proposed))
        self.swaps = len(SWAPS) + len(proposed)
        self.logs = np.log(triples + 0.5, dtype=np.float32) + np.log(groups + 0.5, dtype=np.float32)
        self.known: dict[str, np.ndarray] = {}

    def _learn(self, tokens: list[str]) -> None:
        """Per token the nats for each swap, 0 where it changes nothing."""
        text = " " + " ".join(tokens) + " "
        u = _units(text)
        raw = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
        blanks = np.flatnonzero(u == 0)
        before = self.logs[_triples(u)]
        inside = np.ones(len(u) - 2, dtype=bool)
        inside[blanks[1:-1] - 1] = False
        out = np.zeros((len(tokens), self.swaps), dtype=np.float32)
        for i, k in enumerate([*SINGLE, *range(len(SWAPS), self.swaps)]):
            new = self.reader._map("")[i][raw]
            changed = new != u
            touched = np.flatnonzero((changed[:-2] | changed[1:-1] | changed[2:]) & inside)
            if len(touched):
                gain = np.zeros(len(u) - 2, dtype=np.float32)
                after = _triples(np.stack([new[touched], new[touched + 1], new[touched + 2]], axis=1))[:, 0]
                gain[touched] = self.logs[after] - before[touched]
                out[:, k] = np.add.reduceat(gain, blanks[:-1])
        for row, token in zip(out, tokens):
            if _TWO.search(token):
                for k in UTF8:
                    fixed = _from_utf8(token, SWAPS[k][1])
                    if fixed != token:
                        v = _units(" " + fixed + " ")
                        odd = _foreign()[v]
                        seen = self.reader.triples[_triples(v)][odd[:-2] | odd[1:-1] | odd[2:]]
                        row[k] = MOST if len(seen) and seen.min() >= SEEN else -BREAK
        np.clip(out, -BREAK, MOST, out=out)
        self.known.update(zip(tokens, out))

    def stretches(self, tokens: list[tuple[int, str]]) -> set[int]:
        """Positions of the tokens in suspected stretches."""
        each = np.stack([self.known[t] for _, t in tokens])
        out: set[int] = set()
        for k in np.flatnonzero(np.maximum(each, 0).sum(0) >= SUSPECT).tolist():
            run, first, best, last = 0.0, 0, 0.0, 0
            for i, v in enumerate([*each[:, k].tolist(), -np.inf]):
                if run + v <= 0:
                    found = [x for x in range(first, last + 1) if each[x, k] > 0] if best >= SUSPECT else []
                    if len({tokens[x][1] for x in found}) >= SUSPECT_TOKENS:
                        out.update(tokens[x][0] for x in found)
                    run, first, best = 0.0, i + 1, 0.0
                    continue
                run += v
                if run > best:
                    best, last = run, i
        return out

    def without(self, texts: list[str]) -> list[tuple[str, str]]:
        """(text, text without the tokens in suspected stretches) of those that have any."""
        split = [(t, *split_tokens(t)) for t in texts]
        if len(self.known) > CACHE // 4:
            self.known.clear()
        new = list({t for _, _, odd in split for _, t in odd if t not in self.known})
        if new:
            self._learn(new)
        out = []
        for text, parts, odd in split:
            drop = self.stretches(odd) if odd else None
            if drop:
                out.append((text, " ".join(p for i, p in enumerate(parts) if i not in drop)))
        return out


def split_tokens(text: str) -> tuple[list[str], list[tuple[int, str]]]:
    """All tokens between blanks, and those that are not ASCII with their positions."""
    parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    return parts, [(i, t) for i, t in enumerate(parts) if not t.isascii()]


def repair(text: str, source: str, reader: Reader) -> tuple[str, float, list[tuple[int, float]]]:
    """(text with the stretches rewritten, total gain, [(swap, gain)...]); several stretches and layers."""
    gained, swaps = 0.0, []
    pieces = re.split(r"([ \n\t\r])", text)
    # A token is rewritten LAYERS times at most, so that this ends; stretches are not limited.
    layers: dict[int, int] = defaultdict(int)
    while True:
        odd = [(i, t) for i, t in enumerate(pieces) if not t.isascii() and layers[i] < LAYERS]
        gain, k, first, last = reader.best_stretch(odd, source) if odd else (0.0, -1, 0, 0)
        if gain <= 0:
            break
        changed = False
        for i, t in odd[first : last + 1]:
            new = reader.ciphers.read(t, source, k)
            if new != t:
                pieces[i], changed = new, True
                layers[i] += 1
        if not changed:
            break
        gained += gain
        swaps.append((k, gain))
    return "".join(pieces), gained, swaps


def fill_lost(text: str, model: np.ndarray) -> str:
    """Replacement characters set to the letter that the bigrams on both sides make likeliest."""
    _, letters = _classes()
    if LOST not in text:
        return text
    u = _units(text)
    if len(u) != len(text):
        return text
    lost = _units(LOST)[0]
    ok = np.array([i for i, c in enumerate(letters) if i > 1 and i != lost and not c.isascii()])
    out = list(text)
    for i, ch in enumerate(text):
        if ch == LOST:
            score = np.zeros(len(ok))
            if i and u[i - 1] != lost:
                score += model[u[i - 1], ok]
            if i + 1 < len(u) and u[i + 1] != lost:
                score += model[ok, u[i + 1]]
            out[i] = letters[ok[int(score.argmax())]]
            u[i] = ok[int(score.argmax())]
    return "".join(out)


def maximize(contexts: pd.DataFrame, model: np.ndarray, start: dict[int, str] | None = None, rounds: int = 8) -> dict[int, str]:
    """A byte-to-letter table by expectation-maximization against the bigrams.

    contexts(before, symbol, after, n): how often a garbled symbol stood between two characters
    (themselves garbled or not). P(letter | symbol) starts with most of its weight on `start` (or
    flat, where nothing is known); the expectation weighs each letter by how well it fits its
    neighbours' present letters, the maximization adds the weights up. No letter of ASCII is ever
    allowed: those stand for themselves on every page. A symbol leaves its start only if the new letter fits
    better in VOTES of at least PLACES different places beside another letter, by LEAVE nats in all.
    """
    start = start or {}
    _, letters = _classes()
    table = _classes()[0]
    symbols = sorted(set(contexts["symbol"]))
    size = len(letters)
    freq = np.exp(model[0]) + 1e-9
    allowed = np.array([i > 1 and not c.isascii() for i, c in enumerate(letters)])
    cls = lambda ch: int(table[ord(ch)]) if ord(ch) < 0x10000 else 1
    p = {}
    for s in symbols:
        row = np.where(allowed, 0.2 / allowed.sum() if s in start else freq, 0.0)
        row /= row.sum()
        if s in start:
            row *= 0.1
            row[cls(start[s])] += 0.9
        p[s] = row
    rows = list(zip(contexts["before"], contexts["symbol"], contexts["after"], contexts["n"]))
    lm = model.astype(np.float64)
    for _ in range(rounds):
        best = {s: int(row.argmax()) for s, row in p.items()}
        added = {s: np.full(size, 1e-6) for s in symbols}
        for before, s, after, n in rows:
            a = best.get(before, cls(chr(before)))
            b = best.get(after, cls(chr(after)))
            fit = np.log(p[s] + 1e-12) + lm[a] + lm[:, b]
            fit = np.exp(fit - fit.max()) * (p[s] > 0)
            added[s] += n * fit / fit.sum()
        p = {s: row * allowed / (row * allowed).sum() for s, row in added.items()}
    best = {s: int(row.argmax()) for s, row in p.items()}
    votes: dict[int, list[float]] = {s: [0, 0, 0.0] for s in symbols}
    for before, s, after, _ in rows:
        if chr(before).isspace() and chr(after).isspace():
            continue
        a, b = best.get(before, cls(chr(before))), best.get(after, cls(chr(after)))
        old = cls(start[s]) if s in start else cls(chr(s))
        more = float(lm[a, best[s]] + lm[best[s], b] - lm[a, old] - lm[old, b])
        votes[s][0] += 1
        votes[s][1] += more > 0
        votes[s][2] += n * more
    out = dict(start)
    for s in symbols:
        places, better, nats = votes[s]
        least = PLACES if s in start else 3
        if p[s][best[s]] > 0.8 and places >= least and better >= VOTES * places and nats >= LEAVE and (s not in start or cls(start[s]) != best[s]):
            low = letters[best[s]]
            out[s] = low.upper() if (start[s] if s in start else chr(s)).isupper() else low
    return out


def _less(counts: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
    out = pd.concat([counts, more]).groupby(["a", "b"], as_index=False)["n"].sum()
    return out.assign(n=out["n"].clip(lower=0))


def wrongly_decoded(docs: DataFrame) -> DataFrame:
    """(doc_id, source, repaired, gain, swaps) of the documents that hold wrongly decoded stretches.

    docs: (doc_id bigint, source string, text string); null or empty texts and pure ASCII are no
    cases, a null source is the source ''. repaired is the text with all found stretches restored;
    bytes that were lost (replacement characters) are set to their likeliest letter. gain is how
    many nats better the stretches read, swaps the ciphers used ("written>read", "lost"). Equal
    texts of one source get equal results; an empty table gives an empty result.

    All whole texts are read: once for the bigrams and triples (sums of two tables of fixed size, the
    only thing that comes to the driver), once to take suspected stretches out of these (twice where pairs of
    pages are proposed), once for the candidate stretches. Only candidates are kept (text included) for the estimation of
    the ciphers, which gathers counts per (source, swap, context) by shuffled sums, and for the
    final decision.
    """
    docs = spread(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text"))
    spark = docs.sparkSession
    odd = docs.filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    counts = language_counts(docs).toPandas()
    everything = spark.sparkContext.broadcast((triple_table(counts), group_table(counts)))
    pruned = _less(counts, suspect_counts(odd, everything).toPandas())
    proposed = propose(pruned)
    if proposed:
        pruned = _less(counts, suspect_counts(odd, everything, proposed).toPandas())
    everything.unpersist()
    counts = pruned
    shared = spark.sparkContext.broadcast((bigram_model(counts), triple_table(counts)))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*shared.value, Ciphers(proposed=proposed))
        for batch in batches:
            keep = []
            for i, (text, source) in enumerate(zip(batch["text"], batch["source"])):
                if LOST in text:
                    keep.append(i)
                    continue
                _, tokens = split_tokens(text)
                if reader.best_stretch(tokens, source)[0] > 0:
                    keep.append(i)
            yield batch.iloc[keep]

    found = cut(odd.mapInPandas(candidates, "doc_id bigint, source string, text string"))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*shared.value, Ciphers(proposed=proposed))
        counts: dict = defaultdict(int)
        for batch in batches:
            for text, source in zip(batch["text"], batch["source"]):
                _, tokens = split_tokens(text)
                gain, k, first, last = reader.best_stretch(tokens, source)
                if gain <= 0 or k < len(SWAPS) and SWAPS[k][0] == "utf-8":
                    continue
                symbols = start_table(k)
                for _, t in tokens[first : last + 1]:
                    t = " " + t + " "
                    for x, y, z in zip(t, t[1:], t[2:]):
                        if ord(y) in symbols:
                            counts[source, k, ord(x), ord(y), ord(z)] += 1
        rows = [(*key, n) for key, n in counts.items()]
        yield pd.DataFrame(rows, columns=["source", "swap", "before", "symbol", "after", "n"])

    seen = (
        found.mapInPandas(contexts, "source string, swap int, before int, symbol int, after int, n bigint")
        .groupBy("source", "swap", "before", "symbol", "after")
        .agg(F.sum("n").alias("n"))
    )

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        source, k = group["source"].iloc[0], int(group["swap"].iloc[0])
        start = start_table(k)
        table = maximize(group, shared.value[0], start)
        new = {s: c for s, c in table.items() if start.get(s) != c}
        rows = [(source, k, symbol, letter) for symbol, letter in new.items()]
        return pd.DataFrame(rows, columns=["source", "swap", "symbol", "letter"], dtype=object)

    # What a source's ciphers have beyond their pages goes to its documents with them, however many sources there are.
    tables = cut(
        seen.groupBy("source", "swap")
        .applyInPandas(learn, "source string, swap int, symbol int, letter string")
        .groupBy("source")
        .agg(F.to_json(F.collect_list(F.array(F.col("swap").cast("string"), F.col("symbol").cast("string"), F.col("letter")))).alias("tables"))
    )
    known = join_lookup(found, tables, ["source"], how="left")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*shared.value, Ciphers(proposed=proposed))
        for batch in batches:
            rows = []
            for doc_id, source, text, learned in zip(batch["doc_id"], batch["source"], batch["text"], batch["tables"]):
                if learned is not None:
                    reader.learn(source, learned)
                fixed, gain, swaps = repair(text, source, reader)
                names = [swap_name(k) for k, _ in swaps]
                if LOST in fixed:
                    fixed, names = fill_lost(fixed, shared.value[0]), [*names, "lost"]
                if names:
                    rows.append((doc_id, source, fixed, gain, names))
            yield pd.DataFrame(rows, columns=["doc_id", "source", "repaired", "gain", "swaps"])

    return known.mapInPandas(decide, "doc_id bigint, source string, repaired string, gain double, swaps array<string>")
