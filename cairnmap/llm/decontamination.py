"""Benchmark decontamination by template windows.

A text becomes canonical words: punctuation at the ends goes, numbers, names and
units become typed placeholders, everything else is lower-cased.  A capitalised
word that begins a line or sentence may be a name or not, and a run of names, or
a number and its unit, may be one placeholder or several: such words have several
readings, on both sides.  Every run of ``width`` canonical words is hashed in each
of its readings, and document windows are joined by hash with the windows of the
benchmark items.  A question with other numbers or names keeps its windows.  Hits that lie at one place of the document (the distances between the
places in document and item differ by half the item at most) are checked for slot consistency: what stands in a
slot of the item must always be replaced by the same thing in the document, and
different things by different things.  The item is found if consistent windows
cover at least ``coverage`` of its words.

Windows of which fewer than half are words (not placeholders) don't count so, and
neither do items of fewer than ``shortest`` words.  Windows of the words themselves
(in lower case, nothing replaced) are joined as well and find those where they
stand verbatim.  An item shorter than ``width`` is one window of its own length.

The benchmark may be as large as the documents.  Its windows are a table, and so
are those windows of documents that pass a bitmap of at most 2 ** ``FILTER_BITS``
bits (the only thing sent out); the two are joined by hash in one pass over the
documents.  Windows in more than ``OWN_ITEMS`` items, such as a shared line of
instructions, are shared wording.  Beside a window of the item's own they count as
cover of the item.  By themselves they are matched once for all items that hold the
same shared wording (a class, whose shortest item stands for it): a document that has
it covers ``n_covered`` words, and each member of which that is at least ``coverage``
is linked (``item_classes``), so that no pair is lost and none is written out for each
item.  A class is met by its rarest windows, so many that those left cover less than
``coverage`` of the shortest item; items of which shared wording can't cover so much
have none.  An item without windows of its own is a class for itself.
Items of the same words are one, and so are, for windows with placeholders, items of
the same template (with the same things equal); the least id stands for
them.  Pairs of document and item are then checked on the texts
of just those documents, of which one with very many items is checked for
``GROUP_ITEMS`` items at a time.

Defined results: null or empty texts match nothing; items that repeat are reported
by their least id; documents that repeat an id are merged by taking the best match
(``clean`` decides on each row by its own text); an empty benchmark or table gives
no rows; a null id is reported as such; ties of coverage go to more windows, then
fewer changed slots; a very long text is one chunk of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmap.llm.common import byte_views, documents, mixed, same, small_batches, stored, trimmed, windows

WIDTH, SHORTEST, COVERAGE = 8, 5, 0.5
OWN_ITEMS, GROUP_ITEMS = 8, 4096
FILTER_BITS = 28
#: Ids of documents that are read again are sent to all executors up to this many, else joined.
BROADCAST_IDS = 1_000_000
LITERAL, NUMBER, UNIT, NAME = range(4)
#: What counts as a unit.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml l liter liters litre litres gallon gallons cup cups "
    "s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur gbp percent degree degrees kmh mph".split()
)
#: What is known of a word: its kind, its kind if no line or sentence begins with it, whether it ends a sentence, is nothing but punctuation, ends in punctuation, or is a number without a sign of money.
PROPERTIES = "kind", "as_name", "stops", "empty", "apart", "plain"
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first bytes of eight.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_NUMBER = re.compile(r"[+\-]?[$€£]?[+\-]?\d+(?:[.,:/]\d+)*%?$")
_MEASURE = re.compile(r"([+\-]?\d+(?:[.,]\d+)*)([a-z]+)$")
_EDGES = re.compile(r"^[^\w$€£+\-]+|[^\w%]+$")
_STOP = re.compile(r"[.!?:][\"')\]]*$")


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words in ``raw`` (bytes, then 8 of padding), eight bytes at a time."""
    view = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))
    left = ends - starts
    out = mixed((view[starts] & _BYTES[np.minimum(left, 8)]) ^ (left.astype(np.uint64) * _MIX))
    some = np.flatnonzero(left > 8)
    done = 8
    while len(some):
        out[some] = mixed(out[some] ^ (view[starts[some] + done] & _BYTES[np.minimum(left[some] - done, 8)]))
        done += 8
        some = some[left[some] > done]
    return out


class Canon(dict):
    """word -> its index in the arrays below; emptied between chunks when it is full."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit
        self.bare: list[str] = []
        self.fresh: list[tuple[int, int, bool, bool, bool, bool]] = []
        self.table = np.zeros(limit, [(x, np.int8 if x in ("kind", "as_name") else bool) for x in PROPERTIES])
        self.hashes = np.zeros(limit, np.uint64)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Indices of ``words``, whose properties are in ``table`` from now on."""
        if len(self) >= self.limit:
            self.clear()
            self.bare.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            n = len(self.bare)
            if n > len(self.table):
                self.table = np.concatenate([self.table, np.zeros(n, self.table.dtype)])
                self.hashes = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
            new = [x.encode("utf-8", "surrogatepass") for x in self.bare[n - len(self.fresh) :]]
            cuts = np.cumsum([0, *map(len, new)])
            self.table[n - len(self.fresh) : n] = self.fresh
            self.hashes[n - len(self.fresh) : n] = word_hashes(np.frombuffer(b"".join(new) + bytes(8), np.uint8), cuts[:-1], cuts[1:])
            self.fresh.clear()
        return at

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self.bare)
        if word.isalpha() and word.islower():  # most words
            kind = UNIT if word in UNITS else LITERAL
            self.bare.append(word)
            self.fresh.append((kind, kind, False, False, False, False))
            return i
        kind, stops = LITERAL, False
        if word.isalpha():
            bare = word
        elif word[-1] in ".,;:!?" and word[:-1].isalpha():
            bare, stops = word[:-1], word[-1] not in ",;"
        else:
            bare, stops = _EDGES.sub("", word), bool(_STOP.search(word))
            if _NUMBER.match(bare) or ((m := _MEASURE.match(bare.lower())) and m[2] in UNITS):
                kind = NUMBER
        low = bare.lower()
        if low in UNITS:
            kind = UNIT
        self.bare.append(low)
        name = NAME if kind == LITERAL and low != bare and bare[:1] != low[:1] and bare[1:] == low[1:] else kind
        apart = not (word[-1].isalnum() or word[-1] in "%$€£")
        plain = kind == NUMBER and bare[-1].isdigit() and not any(c in bare for c in "$€£")
        self.fresh.append((kind, name, stops, not bare, apart, plain))
        return i


@dataclass
class Reading:
    """The words of one text, their kinds, which may also be names, and where the placeholder that starts at each may end."""

    words: list[str]
    kinds: list[int]
    free: list[bool]
    ends: list[int]

    def slots(self) -> list[int]:
        """The first word of the run of names, or number and unit, that each word is in."""
        out = list(range(len(self.words)))
        for i, e in enumerate(self.ends):
            if e > i + 1 and out[i] == i:
                out[i:e] = [i] * (e - i)
        return out

    def shortest(self) -> int:
        """Canonical words when all runs are joined."""
        return len(set(self.slots()))

    def parts(self, start: int, path: int, width: int) -> list[tuple[int, int, int]]:
        """(first word, end, kind) of each canonical word of a window."""
        out, at = [], start
        for _ in range(width):
            path, way = divmod(path, 3)
            end = self.ends[at] if way == JOINED else at + 1
            out.append((at, end, NAME if way and self.free[at] else self.kinds[at]))
            at = end
        return out

    def value(self, at: int, end: int) -> str:
        return ("" if self.kinds[at] == NUMBER else " ").join(self.words[at:end])

    def split(self, parts: list[tuple[int, int, int]]) -> int:
        """How many runs a window takes apart."""
        return sum(k != LITERAL and self.ends[i] > e for i, e, k in parts)


@dataclass
class Canonical:
    """Canonical words of some texts, one after the other: indices, kinds, and where each text starts.

    ``exact`` are the hashes of the words themselves; ``free`` words may be literal or names; ``ends`` is where the placeholder ends that a word and those after it can be read as.
    """

    index: np.ndarray
    kind: np.ndarray
    starts: np.ndarray
    keys: np.ndarray
    exact: np.ndarray
    free: np.ndarray
    ends: np.ndarray

    def words(self, canon: Canon, text: int) -> Reading:
        first, last = self.starts[text], self.starts[text + 1]
        part = slice(first, last)
        return Reading([canon.bare[i] for i in self.index[part].tolist()], self.kind[part].tolist(), self.free[part].tolist(), (self.ends[part] - first).tolist())


_SLOTS = mixed(np.arange(1, 5, dtype=np.uint64))
#: How a word of a window is read: by its kind, as a name, or as one placeholder with those after it.
ALONE, NAMED, JOINED = range(3)
_STARTS = 1 << 14


def canonical(texts: list[list[list[str]]], canon: Canon) -> Canonical:
    """``texts``: the words of each line of each text.

    A capitalised word is a name; one that begins a line or follows the end of a sentence may be.
    """
    lines = [line for text in texts for line in text]
    words = [w for line in lines for w in line]
    at = canon.look_up(words)
    begins = np.zeros(len(words) + 1, np.int64)
    begins[np.cumsum([0, *map(len, lines)])] = 1
    table = canon.table[at]
    cuts = np.cumsum([0, *(sum(map(len, text)) for text in texts)])
    return _read({x: table[x] for x in PROPERTIES}, canon.hashes[at], np.cumsum(begins)[: len(words)], cuts, at)


def _read(table: dict[str, np.ndarray], hashes: np.ndarray, begun: np.ndarray, cuts: np.ndarray, at: np.ndarray) -> Canonical:
    """``begun`` tells words of different lines apart, ``cuts`` are the first words of the texts."""
    ended = np.concatenate([[0], np.cumsum(table["stops"])])  # before each word
    full = np.flatnonzero(~table["empty"])
    begun, ended = begun[full], ended[full]
    fresh = np.ones(len(full), bool)
    if len(full):
        fresh[1:] = (begun[1:] > begun[:-1]) | (ended[1:] > ended[:-1])
    at, hashes, literal, as_name, apart, plain = (x[full] for x in (at, hashes, table["kind"], table["as_name"], table["apart"], table["plain"]))
    kind = np.where(fresh, literal, as_name)
    free = fresh & (kind == LITERAL) & (as_name == NAME)
    n = len(at)
    joins = np.zeros(n, bool)  # with the next word
    if n:
        near = ~apart[:-1] & ~fresh[1:]
        names = ((kind[:-1] == NAME) | free[:-1]) & (kind[1:] == NAME)
        joins[:-1] = near & (names | (plain[:-1] & (kind[1:] == UNIT)))
    last = np.where(joins, n, np.arange(n))
    run_ends = np.minimum.accumulate(last[::-1])[::-1] + 1
    return Canonical(at, kind, np.searchsorted(full, cuts), np.where(kind == LITERAL, hashes, _SLOTS[kind]), hashes, free, run_ends)


def _ascii(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE, _END, _PAUSE, _UPPER = _ascii("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "), _ascii(".,;:!?"), _ascii(",;"), _ascii(_CAPITALS)
#: The bytes of a word that are no letters, and 2 ** 32 for each capital; both are summed at once.
_COUNTED = np.where(_UPPER, 1 << 32, ~_ascii(_CAPITALS + _CAPITALS.lower()))
_LOW = np.arange(256, dtype=np.uint8) + np.uint8(32) * _UPPER
_UNIT_BYTES = sorted(x.encode() for x in UNITS)
_UNIT_CUTS = np.cumsum([0, *map(len, _UNIT_BYTES)])
_UNIT_HASHES = np.sort(word_hashes(np.frombuffer(b"".join(_UNIT_BYTES) + bytes(8), np.uint8), _UNIT_CUTS[:-1], _UNIT_CUTS[1:]))


def canonical_bytes(raw: np.ndarray, offsets: np.ndarray, canon: Canon) -> Canonical:
    """What ``canonical`` says of texts in UTF-8, without indices of words.

    Words of ASCII and Latin-1 letters, with one mark at the end or none, are read
    all at once, others by ``canon``.
    """
    low = np.zeros(len(raw) + 8, np.uint8)
    low[: len(raw)] = _LOW[raw]
    space, counted = _SPACE[raw], _COUNTED[raw]
    high = np.flatnonzero(raw >= 0xC2) if len(raw) and raw.max() >= 0xC2 else np.zeros(0, np.int64)
    if len(high):
        lead, second, third = raw[high], low[high + 1], low[high + 2]
        letter = (lead == 0xC3) & (second != 0x97) & (second != 0xB7)
        counted[high[letter]] = counted[high[letter] + 1] = 0
        upper = high[letter & (second < 0x9F)]
        counted[upper] = 1 << 32
        low[upper + 1] += 32
        wide = ((lead == 0xE2) & (((second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))) | ((second == 0x81) & (third == 0x9F)))) | ((lead == 0xE1) & (second == 0x9A) & (third == 0x80)) | ((lead == 0xE3) & (second == 0x80) & (third == 0x80))
        some = high[wide | ((lead == 0xC2) & ((second == 0x85) | (second == 0xA0)))]
        space[some] = space[some + 1] = True
        space[high[wide] + 2] = True
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = after[offsets[1:][offsets[1:] > 0] - 1] = True
    space = ~space
    starts, ends = np.flatnonzero(space & before), np.flatnonzero(space & after) + 1
    sums = np.concatenate([[0], np.cumsum(counted)])
    sums = sums[ends] - sums[starts]
    others, final = sums & 0xFFFFFFFF, raw[ends - 1]
    mark = _END[final] & (others == 1) & (ends - starts > 1)
    hashes = word_hashes(low, starts, ends - mark)
    unit = _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, hashes), len(_UNIT_HASHES) - 1)] == hashes
    kind = np.where(unit, np.int8(UNIT), np.int8(LITERAL))
    named = ~unit & (sums >> 32 == 1) & (counted[starts] == 1 << 32)
    no = np.zeros(len(starts), bool)
    table = dict(zip(PROPERTIES, (kind, np.where(named, np.int8(NAME), kind), mark & ~_PAUSE[final], no, mark, no.copy()), strict=True))
    odd = np.flatnonzero((others != 0) & ~mark)
    if len(odd):
        data = raw.tobytes()
        at = canon.look_up([data[i:j].decode("utf-8", "replace") for i, j in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)])
        hashes[odd] = canon.hashes[at]
        for x in PROPERTIES:
            table[x][odd] = canon.table[x][at]
    begun = np.searchsorted(np.flatnonzero(raw == 10), starts) + np.searchsorted(offsets, starts, "right")
    return _read(table, hashes, begun, np.searchsorted(starts, offsets), np.zeros(len(starts), np.int64))


def window_keys(c: Canonical, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and readings (base 3 digits, one a word) of the windows that count; none goes over the end of a text."""
    n = len(c.keys)
    if not n:
        return np.zeros(0, np.int64), c.keys.astype(np.uint64), np.zeros(0, np.int64)
    limit = np.repeat(c.starts[1:], np.diff(c.starts))
    literal = c.kind == LITERAL
    joined = c.ends > np.arange(n) + 1
    many = np.concatenate([[0], np.cumsum(c.free | joined)])
    stop = np.minimum(np.arange(n) + width, n)
    several = many[stop] > many[:-1]
    # windows of one reading
    sums = np.concatenate([[0], np.cumsum(literal)])
    one = np.flatnonzero(~several & (np.arange(n) + width <= limit) & (2 * (sums[stop] - sums[:-1]) >= width))
    found = [(one, windows(c.keys, width)[one], np.zeros(len(one), np.int64))] if len(one) else []
    starts = np.flatnonzero(several)
    slot = np.where(c.kind == NUMBER, _SLOTS[NUMBER], _SLOTS[NAME])
    for s in range(0, len(starts), _STARTS):
        start = cur = starts[s : s + _STARTS]
        h, path, lit = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for step in range(width):
            ok = np.flatnonzero((cur < limit[start]) & (2 * (lit + width - step) >= width))
            start, cur, h, path, lit = start[ok], cur[ok], h[ok], path[ok], lit[ok]
            named, together = np.flatnonzero(c.free[cur]), np.flatnonzero(joined[cur])
            rows = np.concatenate([np.arange(len(cur)), named, together])
            way = np.repeat([ALONE, NAMED, JOINED], [len(cur), len(named), len(together)])
            here = cur[rows]
            alone = way == ALONE
            with np.errstate(over="ignore"):
                h = h[rows] * _MIX + np.where(alone, c.keys[here], slot[here])
            start, lit, path = start[rows], lit[rows] + (alone & literal[here]), path[rows] + way * 3**step
            cur = np.where(way == JOINED, c.ends[here], here + 1)
        ok = np.flatnonzero(2 * lit >= width)
        found.append((start[ok], mixed(h[ok]), path[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def exact_keys(c: Canonical, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for windows of the words themselves; all count."""
    keys = windows(c.exact, width)
    limit = np.repeat(c.starts[1:], np.diff(c.starts))[: len(keys)]
    at = np.flatnonzero(np.arange(len(keys)) + width <= limit)
    return at, keys[at], np.zeros(len(at), np.int64)


def _lines(text: str | None) -> list[list[str]]:
    return [line.split() for line in text.split("\n")] if text else []


def item_windows(c: Canonical, reading: Reading, width: int, shortest: int) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, exact, places, hashes, readings) of the windows of one item, by length and whether they are exact."""
    whole = min(width, len(c.index))
    yield whole, True, *exact_keys(c, whole)
    if len(c.index) >= shortest:
        # an item that gets shorter than a window when joined is also one window of that length
        for n in sorted({whole, min(width, max(shortest, reading.shortest()))}):
            yield n, False, *window_keys(c, n)


@dataclass
class Block:
    """Windows of some benchmark items, sorted by hash, per width and whether they are exact.

    ``common`` has, of each item, its shared windows (their table, hash, place and
    reading), which count near one of its own only, and ``shared`` their hashes.
    ``reach`` is how far the places of a match may be shifted.
    """

    ids: list[int | None]
    items: list[Reading]
    tables: dict[tuple[int, bool], tuple[np.ndarray, ...]]
    common: list[list[tuple[tuple[int, bool], int, int, int]]]
    shared: dict[tuple[int, bool], np.ndarray]
    reach: list[int]
    at: list[int]


def block(items: list[tuple[int | None, str | None]], width: int, shortest: int, shared: np.ndarray | None = None, alone: list[int | None] | None = None) -> Block:
    """``shared``: (salted) hashes of the shared windows, else those in many of ``items``.

    ``alone`` has the reach of those items of which only shared windows count.
    """
    canon = Canon()
    ids, readings, found, reach, only, order_of = [], [], defaultdict(list), [], [], []
    for place, (item, text) in enumerate(items):
        c = canonical([_lines(text)], canon)
        if not len(c.index):
            continue
        reading = c.words(canon, 0)
        for n, exact, at, keys, paths in item_windows(c, reading, width, shortest):
            found[n, exact].append((keys, np.full(len(at), len(ids), np.int64), at, paths))
        far = alone[place] if alone else None
        only.append(far is not None)
        reach.append(max(1, len(reading.words) // 2 if far is None else far))
        order_of.append(place)
        ids.append(item)
        readings.append(reading)
    of_itself, lone, sorted_ = np.zeros(len(ids), bool), np.array(only, bool), {}
    for kind, parts in found.items():
        keys, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, (which, at, paths) = keys[order], (x[order] for x in rest)
        if shared is None:
            many = np.searchsorted(keys, keys, "right") - np.searchsorted(keys, keys, "left") > OWN_ITEMS
        else:
            many = np.isin(_salted(keys, *kind), shared)
        of_itself[which[~many]] = True
        sorted_[kind] = keys, which, at, paths, many
    tables, common, hashes = {}, [[] for _ in ids], {}
    for kind, (keys, which, at, paths, many) in sorted_.items():
        cover = many & of_itself[which] & ~lone[which]
        for w, f, a, p in zip(*(x[cover].tolist() for x in (which, keys, at, paths)), strict=True):
            common[w].append((kind, f, a, p))
        hashes[kind] = np.unique(keys[cover])
        kept = ~cover & (many | ~lone[which])
        tables[kind] = keys[kept], which[kept], at[kept], paths[kept]
    return Block(ids, readings, tables, common, hashes, reach, order_of)


def _aligned(item: Reading, mine: Reading, hits: list[tuple[int, int, int, int, int, bool]]) -> list[tuple]:
    """(runs taken apart, place in the item, its end, slots) of each hit.

    Those that take the fewest runs apart come first, then those whose slots most
    hits agree on.  A slot is (place, kind, what stands there in the item, what in
    the document).  A word that may be literal on both sides and is the same is none.
    """
    out = set()
    for at, path, place, other, width, exact in hits:
        left, right = item.parts(at, path, width), mine.parts(place, other, width)
        slots = []
        for (i, e, k), (j, f, _) in zip(left, right, strict=True):
            x, y = item.value(i, e), mine.value(j, f)
            if k != LITERAL and not (x == y and item.free[i] and mine.free[j]):
                slots.append((i, k, x, y))
        out.add((0 if exact else item.split(left) + mine.split(right), at, left[-1][1], tuple(slots)))
    votes = Counter(v for *_, slots in out for v in {x[1:] for x in slots})
    return sorted(out, key=lambda x: (x[0], -min((votes[v[1:]] for v in x[3]), default=len(out)), x))


def _consistent(item: Reading, aligned: list[tuple]) -> tuple[int, int, int]:
    """Words covered by consistent windows, changed slots, windows used."""
    there: dict[tuple[int, str], str] = {}
    back: dict[tuple[int, str], str] = {}
    covered: set[int] = set()
    changed: set[int] = set()
    used: set[int] = set()
    of = item.slots()
    for _, at, end, slots in aligned:
        if any(there.get((k, x), y) != y or back.get((k, y), x) != x for _, k, x, y in slots) or len({(k, x) for _, k, x, _ in slots}) != len({(k, y) for _, k, _, y in slots}):
            continue
        for i, k, x, y in slots:
            there[k, x], back[k, y] = y, x
            if x != y:
                changed.add(of[i])
        covered.update(range(at, end))
        used.add(at)
    return len(covered), len(changed), len(used)


def _places(diagonals: dict[int, list[tuple]], reach: int) -> Iterator[list[tuple]]:
    """The hits of each diagonal, and of all within ``reach`` of it: one place in the document, with words put in or left out."""
    order = sorted(diagonals)
    for d in order:
        yield diagonals[d]
    end = 0
    for n, d in enumerate(order):
        stop = bisect_right(order, d + reach)
        if stop > max(end, n + 1):  # not part of the place before
            yield [x for e in order[n:stop] for x in diagonals[e]]
        end = max(end, stop)


def matches(texts: list[list[list[str]]], b: Block, canon: Canon, coverage: float, allowed: set[tuple[int, int]] | None = None) -> list[tuple[int, int, int, float, int]]:
    """(text, item, windows, coverage, changed slots), texts and items by their place; of ``allowed`` pairs, if given."""
    c = canonical(texts, canon)
    found: dict[tuple[int, int], dict[int, list[tuple]]] = defaultdict(lambda: defaultdict(list))
    shared: dict[tuple, list[tuple[int, int]]] = defaultdict(list)  # places of shared windows
    for kind, (keys, which, at, paths) in b.tables.items():
        width, exact = kind
        place, mine, path = (exact_keys if exact else window_keys)(c, width)
        for some, own in ((np.flatnonzero(np.isin(mine, b.shared[kind])) if len(b.shared[kind]) else (), False), (np.flatnonzero(np.isin(mine, keys)), True)):
            if not len(some):
                continue
            text = np.searchsorted(c.starts, place[some], "right") - 1
            where = text.tolist(), (place[some] - c.starts[text]).tolist(), path[some].tolist()
            if not own:
                for t, p, way, key in zip(*where, mine[some].tolist(), strict=True):
                    shared[t, kind, key].append((p, way))
                continue
            lo, hi = np.searchsorted(keys, mine[some], "left"), np.searchsorted(keys, mine[some], "right")
            for t, p, way, i, j in zip(*where, lo.tolist(), hi.tolist(), strict=True):
                for k in range(i, j):
                    pair = t, int(which[k])
                    if allowed is None or pair in allowed:
                        a = int(at[k])
                        found[pair][p - a].append((a, int(paths[k]), p, way, width, exact))
    for places in shared.values():
        places.sort()
    best: dict[tuple[int, int], tuple[int, float, int]] = {}
    known: tuple = (None, None)
    for t, i in sorted(found):
        item, diagonals = b.items[i], found[t, i]
        reach = b.reach[i]
        own = sorted(diagonals)
        for kind, key, a, way in b.common[i]:  # only those near a window of the item's own
            places = shared.get((t, kind, key), [])
            for p, other in places[bisect_left(places, (own[0] + a - reach,)) : bisect_left(places, (own[-1] + a + reach + 1,))]:
                near = bisect_left(own, p - a - reach)
                if near < len(own) and own[near] <= p - a + reach:
                    diagonals[p - a].append((a, way, p, other, *kind))
        if known[0] != t:
            known = t, c.words(canon, t)
        for hits in _places(diagonals, reach):
            covered, changed, used = _consistent(item, _aligned(item, known[1], hits))
            part = covered / len(item.words)
            if used and part >= coverage and part > best.get((t, i), (0, 0.0, 0))[1]:
                best[t, i] = used, part, changed
                if part == 1:
                    break
    return [(*k, *v) for k, v in best.items()]


def _chunks(batches: Iterator[pa.RecordBatch], words: int = 100_000) -> Iterator[tuple[list[tuple], list]]:
    """All columns but the last, and the lines of that, of some rows at a time: about ``words`` words, or one longer text."""
    rows, texts, held = [], [], 0
    for batch in batches:
        for *row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            texts.append(_lines(text))
            held += sum(map(len, texts[-1]))
            if held >= words:
                yield rows, texts
                rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def _byte_chunks(batches: Iterator[pa.RecordBatch], size: int = 1 << 19) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """All columns but the last, and the bytes and offsets of that, of some rows at a time: about ``size`` bytes, or one longer text."""
    for batch in batches:
        raw, offsets = byte_views(batch.columns[-1])
        first = 0
        while first < batch.num_rows:
            end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
            part = offsets[first : end + 1]
            yield [x.slice(first, end - first) for x in batch.columns[:-1]], raw[part[0] : part[-1]], part - part[0]
            first = end


def _salted(keys: np.ndarray, n: int, exact: bool) -> np.ndarray:
    """Hashes of windows that differ by length and by whether they are exact."""
    return mixed(keys ^ mixed(np.array([2 * n + exact + 1], np.uint64))).view(np.int64)


def _batch(cols: list, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols or [()] * len(names), kinds, strict=True)], names)


def _pattern(r: Reading) -> list[int]:
    """Which things in the slots are the same, in any reading: two texts of one template and pattern are consistent with the same texts."""
    first: dict[tuple[int, str], int] = {}
    out = []
    for i, (k, e) in enumerate(zip(r.kinds, r.ends, strict=True)):
        k = NAME if r.free[i] else k
        out += (e - i, r.free[i])
        if k != LITERAL:
            out += (first.setdefault((k, r.value(i, end)), len(first)) for end in {i + 1, e})
    return out


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item_id, text) with hashes of their words and kinds (i) and of their template (t); those without words go."""
    canon = Canon()
    for b in batches:
        rows = []
        for item, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            c = canonical([_lines(text)], canon)
            if len(c.index):
                template = c.keys.tobytes()
                alike = template + np.array(_pattern(c.words(canon, 0)), np.int64).tobytes()
                rows.append((item, text, *(xxhash.xxh3_64_intdigest(x) - 2**63 for x in (c.exact.tobytes() + template, alike)), len(c.index)))
        yield _batch(list(zip(*rows, strict=True)), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()], ["item_id", "text", "i", "t", "n_words"])


def _all_windows(width: int, shortest: int):
    """(key, i, n, exact, leads): windows with placeholders lead to those items only that stand for their template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for b in batches:
            for i, stands, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = canonical([_lines(text)], canon)
                for n, exact, _, keys, _ in item_windows(c, c.words(canon, 0), width, shortest):
                    key = np.unique(_salted(keys, n, exact))
                    cols = [key, [i] * len(key), [n] * len(key), [exact] * len(key), [exact or stands] * len(key)]
                    yield _batch(cols, [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()], ["key", "i", "n", "exact", "leads"])

    return run


def _shared_part(text: str, stands: bool, held: dict[int, int], canon: Canon, width: int, shortest: int, coverage: float) -> tuple[int, bool, list[int]] | None:
    """Hash of the shared wording of an item, whether it has no windows of its own (exact or not), and the windows of which a text that covers enough has one."""
    c = canonical([_lines(text)], canon)
    r = c.words(canon, 0)
    of: dict[int, set[int]] = defaultdict(set)
    parts, kinds, own = [], set(), set()
    for n, exact, at, keys, paths in item_windows(c, r, width, shortest):
        for a, key, path in zip(at.tolist(), _salted(keys, n, exact).tolist(), paths.tolist(), strict=True):
            kinds.add(exact)
            if key in held:
                of[key].update(range(a, r.parts(a, path, n)[-1][1]))
                parts.append((n, exact, a, path))
            else:
                own.add(exact)
    words = sorted(set().union(*of.values()))
    enough = lambda some: len(some) / len(r.words) >= coverage
    if not enough(words):
        return None
    left: set[int] = set()
    leads = sorted(of, key=lambda k: (held[k], k))
    while leads and not enough(left | of[leads[-1]]):
        left |= of[leads.pop()]
    first, whole = words[0], any(exact or stands for exact in kinds - own)
    same_words = [(w - first, r.words[w], r.kinds[w], r.free[w], r.ends[w] - w) for w in words], sorted((n, e, a - first, p) for n, e, a, p in parts), r.words if whole else 0
    return xxhash.xxh3_64_intdigest(repr(same_words).encode("utf-8", "surrogatepass")) - 2**63, whole, leads


def _shared_parts(width: int, shortest: int, coverage: float):
    """Rows (i, stands, text, often: key and held) with the class, if any, that the item is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for b in batches:
            rows = []
            for i, stands, text, often in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = _shared_part(text, stands, {x["key"]: x["held"] for x in often}, canon, width, shortest, coverage)
                if got:
                    rows.append((i, *got))
            yield _batch(list(zip(*rows, strict=True)), [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())], ["i", "c", "whole", "leads"])

    return run


@dataclass
class Benchmark:
    """Tables of a benchmark: all items, one of the same words each, their windows, which are shared, and classes of shared wording."""

    named: DataFrame
    items: DataFrame
    each: DataFrame
    often: DataFrame
    parts: DataFrame
    classes: DataFrame


def _least(*first: str):
    return F.min(F.struct(*first, F.col("item_id").isNull().alias("nil"), "item_id", "i")).alias("x")


def prepared(benchmark: DataFrame, width: int = WIDTH, shortest: int = SHORTEST, coverage: float = COVERAGE) -> Benchmark:
    kinds = "item_id long, text string, i long, t long, n_words long"
    named = stored(benchmark.select("item_id", "text").mapInArrow(_named, kinds), "named")
    least = F.min(F.struct(F.col("item_id").isNull().alias("nil"), "item_id", "text", "n_words")).alias("x")
    items = named.groupBy("i", "t").agg(least).select("x.item_id", "x.text", "x.n_words", "i", "t")
    first = items.groupBy("t").agg(_least()).select("t", F.col("x.i").alias("first"))
    items = stored(items.join(first, "t").select("i", "t", (F.col("i") == F.col("first")).alias("stands"), "item_id", "text", "n_words"), "items")
    each = stored(items.select("i", "stands", "text").mapInArrow(_all_windows(width, shortest), "key long, i long, n int, exact boolean, leads boolean"), "windows")
    often = stored(each.where("leads").groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > OWN_ITEMS), "often")
    held = each.join(often, "key").groupBy("i").agg(F.collect_list(F.struct("key", "held")).alias("often"))
    found = items.select("i", "stands", "text").join(held, "i").select("i", "stands", "text", "often").mapInArrow(_shared_parts(width, shortest, coverage), "i long, c long, whole boolean, leads array<long>")
    parts = stored(found.join(items.select("i", "item_id", "n_words"), "i"), "shared")
    stand = parts.groupBy("c").agg(_least("n_words"), F.max("n_words").alias("longest")).select(F.col("c").alias("_c"), F.col("x.i").alias("_i"), (F.col("longest") / 2).cast("long").alias("reach"))
    classes = stored(parts.join(stand, (parts["c"] == stand["_c"]) & (parts["i"] == stand["_i"])).select("c", "i", "item_id", "whole", "leads", "reach"), "classes")
    return Benchmark(named, items, each, often, parts, classes)


def item_classes(benchmark: DataFrame | Benchmark, **limits) -> DataFrame:
    """item_id, same_words, same_template, same_wording, wording, n_words: the items that stand for each one.

    The least ids of the items of the same words and of the same template, and the
    shortest item of the same shared wording and its class (null if that can't cover enough); of the
    documents found by that class, those whose n_covered is ``coverage`` of n_words hold the item.
    """
    b = benchmark if isinstance(benchmark, Benchmark) else prepared(benchmark, **limits)
    least = b.items.where("stands").select("t", F.col("item_id").alias("same_template"))
    wording = b.parts.select("i", "c").join(b.classes.where("not whole").select("c", F.col("item_id").alias("same_wording")), "c").withColumnRenamed("c", "wording")
    words = b.items.select("i", F.col("item_id").alias("same_words"))
    return b.named.select("item_id", "i", "t", "n_words").join(words, "i").join(least, "t").join(wording, "i", "left").select("item_id", "same_words", "same_template", "same_wording", "wording", "n_words")


def _bitmap(keys: DataFrame, n: int) -> np.ndarray:
    """A bit for each value that the first bits of some key (of ``n``) have."""
    bits = min(FILTER_BITS, max(16, n.bit_length() + 8))
    slot = F.shiftrightunsigned("key", 64 - bits)
    words = keys.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _hits(sent, kinds: list[tuple[int, bool]]):
    """(key, doc_id, row_key) of the windows that may be the items'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, bitmap = Canon(), sent.value
        shift = np.uint64(64 - (len(bitmap).bit_length() + 5))
        for rows, raw, offsets in _byte_chunks(batches):
            c = canonical_bytes(raw, offsets, canon)
            for n, exact in kinds:
                place, keys, _ = (exact_keys if exact else window_keys)(c, n)
                key = _salted(keys, n, exact)
                slot = key.view(np.uint64) >> shift
                some = np.flatnonzero(bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
                text = np.searchsorted(c.starts, place[some], "right") - 1
                pairs = sorted(set(zip(text.tolist(), key[some].tolist(), strict=True)))
                at = pa.array([t for t, _ in pairs], pa.int64())
                yield pa.record_batch([pa.array([k for _, k in pairs], pa.int64()), *(x.take(at) for x in rows)], ["key", "doc_id", "row_key"])

    return run


def _verified(width: int, shortest: int, coverage: float):
    """Rows (doc_id, row_key, items, text): which of the items are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for rows, texts in _chunks(batches):
            known = {(str(x["item_id"]), x["item_id"], x["text"], x["reach"] is not None): x for r in rows for x in r[2]}
            items = sorted(known, key=str)
            often = np.unique(np.array([k for x in known.values() for k in x["often"] or ()], np.int64))
            b = block([x[1:3] for x in items], width, shortest, often, [known[x]["reach"] for x in items])
            at = {x[1:]: i for i, x in enumerate(items)}
            allowed = {(t, at[x["item_id"], x["text"], x["reach"] is not None]) for t, r in enumerate(rows) for x in r[2]}
            found = []
            for t, i, used, part, changed in matches(texts, b, canon, coverage, allowed):
                found.append((*rows[t][:2], b.ids[i], used, part, changed, round(part * len(b.items[i].words)), known[items[b.at[i]]]["wording"]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield _batch(list(zip(*found, strict=True)), kinds, ["doc_id", "row_key", "item_id", "n_windows", "coverage", "n_changed", "n_covered", "wording"])

    return run


def row_key(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def found_in_rows(docs: DataFrame, benchmark: DataFrame | Benchmark, width: int = WIDTH, shortest: int = SHORTEST, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, row_key (a hash of the text), item_id, n_windows, coverage, n_changed, n_covered, wording, once for rows that repeat.

    ``wording`` is the class of those found by shared wording alone (else null), for all of which the item stands.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", row_key().alias("row_key"), "text")
    b = benchmark if isinstance(benchmark, Benchmark) else prepared(benchmark, width, shortest, coverage)
    own = b.each.where("leads").join(b.often, "key", "left_anti").select("key", "i", F.lit(False).alias("alone")).distinct()
    leads = stored(own.union(b.classes.select(F.explode("leads").alias("key"), "i", F.lit(True))), "leads")
    kinds = sorted((r["n"], r["exact"]) for r in b.each.select("n", "exact").distinct().collect())
    often = b.each.join(b.often, "key").groupBy("i").agg(F.collect_set("key").alias("often"))
    entries = b.items.select("i", "item_id", "text").withColumn("alone", F.lit(False)).withColumn("wording", F.lit(None).cast("long")).withColumn("reach", F.lit(None).cast("long"))
    lone = b.classes.select("i", "reach", F.when(~F.col("whole"), F.col("c")).alias("wording")).join(b.items.select("i", "item_id", "text"), "i")
    entries = entries.unionByName(lone.withColumn("alone", F.lit(True))).join(often, "i", "left")

    sent = spark.sparkContext.broadcast(_bitmap(leads, leads.count()))
    hits = docs.mapInArrow(trimmed(_hits(sent, kinds)), "key long, doc_id long, row_key long")
    pairs = stored(hits.join(leads, "key").select("doc_id", "row_key", "i", "alone").distinct(), "pairs")
    groups = pairs.groupBy("doc_id", "row_key").agg(F.ceil(F.count("*") / GROUP_ITEMS).alias("groups")).select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k"), "groups")
    of_row = lambda left: same(left["doc_id"], groups["_d"]) & (left["row_key"] == groups["_k"])
    dealt = pairs.join(groups, of_row(pairs)).withColumn("part", F.pmod(F.xxhash64("i", "alone"), F.col("groups")))
    asked = dealt.join(entries, ["i", "alone"]).groupBy("doc_id", "row_key", "part").agg(F.collect_list(F.struct("item_id", "text", "often", "wording", "reach")).alias("items"))
    asked = asked.select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k"), "items")
    wanted = stored(pairs.select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k")).distinct(), "wanted")
    texts = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, same(docs["doc_id"], wanted["_d"]) & (docs["row_key"] == wanted["_k"]), "left_semi")
    texts = texts.groupBy("doc_id", "row_key").agg(F.first("text").alias("text"))
    both = texts.join(asked, same(texts["doc_id"], asked["_d"]) & (texts["row_key"] == asked["_k"])).select("doc_id", "row_key", "items", "text")
    found = "doc_id long, row_key long, item_id long, n_windows long, coverage double, n_changed long, n_covered long, wording long"
    return both.mapInArrow(trimmed(_verified(width, shortest, coverage)), found)


def _best(found: DataFrame, *by: str) -> DataFrame:
    values = "n_windows", "coverage", "n_changed", "n_covered"
    best = F.max_by(F.struct(*values), F.struct("coverage", "n_windows", -F.col("n_changed")))
    return found.groupBy("doc_id", "item_id", *by).agg(best.alias("x")).select("doc_id", "item_id", *(f"x.{v}" for v in values), *by)


def contaminated(docs: DataFrame, benchmark: DataFrame | Benchmark, **limits) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, n_changed: the items found in each document, not by shared wording alone.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.
    """
    return _best(found_in_rows(docs, benchmark, **limits).where("wording is null")).drop("n_covered")


def links(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shortest: int = SHORTEST, coverage: float = COVERAGE) -> DataFrame:
    """All of it: the pairs of documents and items, and the members of the classes that items stand for.

    doc_id, item_id, n_windows, coverage, n_changed, n_covered, by, wording, member.  ``by``
    is `item`, or `shared` for pairs by shared wording alone.  Rows with null doc_id and
    n_windows, a ``member`` and by `words`, `template` or `shared` say for which other items item_id
    stands; one by `shared` is held by documents that cover at least its n_covered words
    of its ``wording``.
    """
    b = prepared(benchmark, width, shortest, coverage)
    found = _best(found_in_rows(docs, b, width, shortest, coverage), "wording").withColumn("by", F.when(F.col("wording").isNotNull(), "shared").otherwise("item"))
    null = F.lit(None).cast("long")
    out = found.select("doc_id", "item_id", "n_windows", "coverage", "n_changed", "n_covered", "by", "wording", null.alias("member"))
    classes = item_classes(b)
    for by in "words", "template":
        some = classes.where(~same(F.col("item_id"), F.col(f"same_{by}")))
        out = out.union(some.select(null, f"same_{by}", null, null.cast("double"), null, null, F.lit(by), null, "item_id").distinct())
    some = classes.where(F.col("wording").isNotNull() & ~same(F.col("item_id"), F.col("same_wording")))
    least = F.ceil(F.round(F.lit(coverage) * F.col("n_words"), 9))
    return out.union(some.select(null, "same_wording", null, null.cast("double"), null, least, F.lit("shared"), "wording", "item_id").distinct())


def clean(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The rows in whose text no item is found, by shared wording alone or not."""
    found = stored(found_in_rows(docs, benchmark, **limits).select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k")).distinct(), "found")
    small = found.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(found) if small else found, same(docs["doc_id"], found["_d"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_k"]), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
