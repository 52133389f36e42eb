"""A hierarchical Pitman-Yor language model over word contexts, words and letters.

The word before opens a restaurant whose dishes are the words that follow it.  All these
restaurants share one parent, the restaurant of words without context; its parent draws
words letter by letter: contexts of three bytes have restaurants whose parent is the context
of one byte, then the empty context, then the uniform distribution.  Every table of a child is
a customer of its parent.  The two bytes before the last are folded into 127 values, so many
contexts of three bytes share a restaurant; the letter part thus has a fixed bound and lives
on the driver and in broadcasts, while words and their contexts grow with the corpus and stay
in files of the shared folder.

Chinese-restaurant seating is sampled by blocked Gibbs: a sweep over a level seats all
customers of every dish anew, by drawing the dish's number of tables (which is all that
probabilities need) from its distribution given the customers and the parent's probability,
however many they are.  At first each (context, word) has one table; the levels above are
swept, then the contexts several times, and after each of the KEPT last sweeps the levels
above once more.  Scores are logarithms of predictive probabilities averaged over these.

How it runs: tokens become 64-bit word hashes.  A block of documents sends its distinct
(context, word) cells with their counts to buckets by context; a context with more than its
share of the corpus is spread over several buckets by word, and its totals are added up.
Words belong to owners, by hash.  Buckets tell owners the tables of their words, owners
answer with the words' probabilities, and at the end buckets answer each block in the order
of its cells.  So only cells are shuffled, never texts, and memory is bounded by a block,
a bucket or an owner, whose numbers follow ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvane.llm.common import forget, forgettable, fresh_folder, remove_folder, steady_scans
from sparvane.llm.neardup import _mix

BLOCK_BYTES = 8_000_000
DISCOUNT, STRENGTH = 0.7, 10.0
CONTEXT_DISCOUNT, CONTEXT_STRENGTH = 0.7, 0.3
LETTER_DISCOUNT, LETTER_STRENGTH = 0.5, 2.0
BURN_IN, KEPT, EXACT, DIRECT = 2, 3, 1024, 24
SYMBOLS, STOP, START = 258, 256, 257
FOLDED = 32768
CHUNK = 1 << 20
END_WORD, START_WORD = np.uint64(0x5D1F0A3C9E2B7745), np.uint64(0xA17C3E5590D24B1F)  #: hashes of a text's end and of the context before its first word
_FACTOR = 0x9E6C63D0873F52A5
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MESSAGE = "target int, source string, data binary"


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's factor and of its inverse modulo 2**64."""
    factors = [np.full(n, x, np.uint64) for x in (_FACTOR, pow(_FACTOR, -1, 2**64))]
    for f in factors:
        f[0] = 1
    return tuple(np.cumprod(f) for f in factors)


def _spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space."""
    return (data - np.uint8(9) < 5) | (data == 32)


def _lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)


def _words(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hash, start and length of the words of ``data``, bytes of texts that begin and end at ``bounds``.

    A word's hash is a polynomial of its bytes, so one running sum gives those of all words.
    """
    begin = 0
    while begin < len(data):
        end = len(data)
        if end - begin > CHUNK:  # cut at the next white space or text
            end = begin + CHUNK
            limit = int(bounds[np.searchsorted(bounds, end)])
            while end < limit and not _spaces(data[end : end + 1])[0]:
                found = np.flatnonzero(_spaces(data[end : min(limit, end + 65536)]))
                end = end + int(found[0]) if len(found) else min(limit, end + 65536)
        part = _lowered(data[begin:end])
        solid = ~_spaces(part)
        fresh = np.ones(len(part), bool)
        fresh[1:] = ~solid[:-1]
        cuts = bounds[np.searchsorted(bounds, begin) : np.searchsorted(bounds, end)] - begin
        fresh[cuts] = True
        starts = np.flatnonzero(solid & fresh)
        last = np.ones(len(part), bool)
        last[:-1] = ~solid[1:] | fresh[1:]
        ends = np.flatnonzero(solid & last) + 1
        size = CHUNK + 65536 if len(part) <= CHUNK + 65536 else len(part)
        power, inverse = _powers(size)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
        yield _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts + begin, ends - starts
        begin = end


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text closed by END_WORD; tokens of each text; and the words' first bytes, lengths and the bytes they point to."""
    binary = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(binary) else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    parts = list(_words(data, bounds))
    h, starts, lengths = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int64, np.int64)))
    sizes = np.diff(np.searchsorted(starts, bounds)) + 1
    tokens = np.full(len(h) + len(binary), END_WORD)
    inside = np.ones(len(tokens), bool)
    inside[np.cumsum(sizes) - 1] = False
    tokens[inside] = h
    return tokens, sizes, starts, lengths, data


def contexts_of(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token, START_WORD at a text's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = START_WORD
    return before


def ordered(hashes: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts rows of equal columns together, and marks where a new one begins.

    ``hashes``: 64 bits of each row, equal for equal columns.  Their upper bits are sorted
    together with the rows' numbers; the few rows of which only these bits are equal are
    put in order by all columns.
    """
    n = len(hashes)
    low = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    packed = np.sort(hashes & ~low | np.arange(n, dtype=np.uint64))
    order, same = (packed & low).astype(np.int64), packed[1:] & ~low == packed[:-1] & ~low

    def changes() -> np.ndarray:
        differs = np.zeros(max(n - 1, 0), bool)
        for column in columns:
            taken = column[order]
            differs |= taken[1:] != taken[:-1]
        return differs

    differs = changes()
    if (differs & same).any():
        run = np.cumsum(np.r_[0, ~same])
        at = np.flatnonzero(np.isin(run, run[1:][differs & same]))
        order[at] = order[at][np.lexsort((*(c[order[at]] for c in columns), run[at]))]
        differs = changes()
    return order, np.r_[np.ones(min(1, n), bool), differs]


def cells_in_order(contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different (context, word), those of a context together: a token of each, its number of tokens' first place in the order, that order, and the rank of each in the first order."""
    mixed = _mix(contexts)
    order, new = ordered(_mix(mixed ^ words), contexts, words)
    first = order[new]
    by_context = ordered(mixed[first], contexts[first])[0]
    return first[by_context], np.flatnonzero(new), order, by_context


class Split:
    """Which bucket holds a cell: that of its context, or one of several, by word, for a context above a quarter of a bucket's share."""

    def __init__(self, buckets: int, frequent: dict[int, int], total: int) -> None:
        self.buckets, self.counts = buckets, dict(sorted(frequent.items()))
        self.hot = np.array(list(self.counts), np.uint64)
        self.pieces = np.array([min(buckets, 1 + 4 * buckets * n // max(total, 1)) for n in self.counts.values()], np.uint64)

    def of(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        n = np.uint64(self.buckets)
        at = (_mix(contexts) >> np.uint64(32)) * n >> np.uint64(32)
        if len(self.hot):
            i = np.minimum(np.searchsorted(self.hot, contexts), len(self.hot) - 1)
            hot = np.flatnonzero(self.hot[i] == contexts)
            at[hot] = (at[hot] + (_mix(words[hot] ^ _mix(contexts[hot])) >> np.uint64(20)) % self.pieces[i[hot]]) % n
        return at.astype(np.int64)


def owners(hashes: np.ndarray, tasks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(tasks) >> np.uint64(32)).astype(np.int64)


class Store:
    """Numbered files of a shared folder; a file appears whole, and all attempts write the same."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _path(self, kind: str, number: int | str) -> tuple:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.folder)
        return system, f"{path}/{kind}", f"{path}/{kind}/{number}"

    def put(self, kind: str, number: int | str, what: object) -> None:
        system, folder, path = self._path(kind, number)
        system.create_dir(folder, recursive=True)
        temporary = f"{path}.{TaskContext.get().taskAttemptId()}"
        with system.open_output_stream(temporary, compression=None) as out:
            out.write(dumped(what))
        system.move(temporary, path)

    def get(self, kind: str, number: int | str) -> object:
        system, _, path = self._path(kind, number)
        with system.open_input_stream(path, compression=None) as file:
            return loaded(file.readall())

    def there(self, kind: str, number: int | str) -> bool:
        from pyarrow import fs

        system, _, path = self._path(kind, number)
        return system.get_file_info(path).type == fs.FileType.File


def dumped(what: object) -> bytes:
    raw = pickle.dumps(what, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def loaded(data: bytes) -> object:
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))


def _messages(rows: list[tuple[int, str, object]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([dumped(r[2]) for r in rows], pa.binary())], names=["target", "source", "data"])


def _received(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, str, object]]:
    """All messages of a task, ordered by target and source."""
    forget()
    rows = [(t, s, d) for b in batches for t, s, d in zip(*(b.column(i).to_pylist() for i in range(3)))]
    return [(t, s, loaded(d)) for t, s, d in sorted(rows, key=lambda r: (r[0], r[1]))]


def _name(number: int) -> str:
    return f"{number:010d}"


def _parts(at: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Values of a sorted array, and where each stands."""
    cuts = np.flatnonzero(np.diff(at)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(at)]) if len(at) else ():
        yield int(at[a]), slice(int(a), int(b))


class Dice:
    """Uniform numbers in [0, 1) that depend on a seed alone."""

    def __init__(self, seed: int) -> None:
        self.state = (seed * 2 + 1) & 0xFFFFFFFFFFFFFFFF

    def __call__(self) -> float:
        self.state = (self.state * 0x5851F42D4C957F2D + 0x14057B7EF767814F) & 0xFFFFFFFFFFFFFFFF
        return (self.state >> 11) / 9007199254740992.0


def _sit(sizes: list[int], fresh: float, discount: float, dice: Dice) -> None:
    """Seats one customer: at a table by its size less the discount, or at a new one by ``fresh``."""
    at = dice() * (sum(sizes) - discount * len(sizes) + fresh)
    for i, n in enumerate(sizes):
        at -= n - discount
        if at < 0:
            sizes[i] += 1
            return
    sizes.append(1)


def reseat(sizes: list[int], customers: int, fresh: float, discount: float, dice: Dice, moves: int | None = None) -> list[int]:
    """One sweep over a dish with table ``sizes``, customer by customer; ``customers`` may have changed since the last.

    ``fresh``: the weight of a new table, parent probability included.  New customers sit
    down one by one.  Then ``moves`` customers (all, if None), drawn at random, stand up and
    sit down again.  The model itself uses :func:`draw_tables`, which has the distribution
    that such sweeps tend to and costs nothing per customer.
    """
    sizes, held = list(sizes), sum(sizes)
    while held > customers:
        i = max(range(len(sizes)), key=sizes.__getitem__)
        out = min(held - customers, max(1, sizes[i] // 2)) if sizes[i] > 1 else 1
        sizes[i] -= out
        held -= out
        if not sizes[i]:
            sizes.pop(i)
    for _ in range(customers - held):
        _sit(sizes, fresh, discount, dice)
    if customers > 1:
        for _ in range(customers if moves is None else moves):
            at, i = dice() * customers, 0
            while i < len(sizes) - 1 and at >= sizes[i]:
                at -= sizes[i]
                i += 1
            sizes[i] -= 1
            if not sizes[i]:
                sizes.pop(i)
            _sit(sizes, fresh, discount, dice)
    return sizes


@cache
def _stirling(discount: float) -> list[np.ndarray]:
    """Logarithms of the generalised Stirling numbers: row c has 1..c tables, c up to EXACT."""
    rows = [np.zeros(0), np.zeros(1)]
    for c in range(1, EXACT):
        row = np.full(c + 1, -np.inf)
        row[:c] = rows[-1] + np.log(c - np.arange(1, c + 1) * discount)
        row[1:] = np.logaddexp(row[1:], rows[-1])
        rows.append(row)
    return rows


def _saddle(c: float | np.ndarray, t: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Saddle-point logarithms of the Stirling numbers of c customers and t < c tables, less lgamma(c + 1); and t * y**discount at the saddle 1 - y."""
    low, high = np.full(t.shape, -400.0), np.full(t.shape, -1e-12)
    for _ in range(60):
        m = (low + high) / 2
        few = t * -np.expm1(m) * discount * np.exp((discount - 1) * m) > -c * np.expm1(discount * m)
        low, high = np.where(few, m, low), np.where(few, high, m)
    m = (low + high) / 2
    y, z, f = np.exp(m), -np.expm1(m), -np.expm1(discount * m) / discount
    g = z * np.exp((discount - 1) * m) / f
    spread = t * g * (1 + z * (1 - discount) / y - g)
    return t * np.log(f) - c * np.log1p(-y) - 0.5 * np.log(2 * np.pi * spread) - np.array(list(map(math.lgamma, (t + 1).ravel().tolist()))).reshape(t.shape), t * np.exp(discount * m)


@cache
def _off(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """How far the saddle point is off in the last exact row; beyond it this depends on t * y**discount alone."""
    approximate, place = _saddle(EXACT, np.arange(1.0, EXACT), discount)
    return np.log(place), _stirling(discount)[EXACT][:-1] - math.lgamma(EXACT + 1) - approximate


def _many(customers: np.ndarray, fresh: np.ndarray, discount: float, at: np.ndarray) -> np.ndarray:
    """Numbers of tables of dishes with more than EXACT customers, drawn at the uniform numbers ``at``.

    Around each dish's mode the logarithms of the weights are a smooth function of t: they
    are computed at all t if these are few, else at Chebyshev's places.
    """
    c = customers.astype(float)
    low, high = np.full(len(c), -400.0), np.full(len(c), -1e-12)  # the mode: fresh * z * y ** (discount - 1) = c
    for _ in range(60):
        m = (low + high) / 2
        more = fresh * -np.expm1(m) * np.exp((discount - 1) * m) > c
        low, high = np.where(more, m, low), np.where(more, high, m)
    mode = np.minimum(c, fresh * -np.expm1(discount * low) / discount)
    reach = 12 * np.sqrt(mode) + 40
    first, last = np.maximum(1, np.floor(mode - reach)), np.minimum(c - 1, np.floor(mode + reach)) + 1
    x, off = _off(discount)
    slope = (off[1] - off[0]) / (x[1] - x[0])
    share = (1 - np.cos(np.pi * np.arange(33) / 32)) / 2
    out, few = np.empty(len(c), np.int64), last - first < 160
    for own, width in ((few, 160), (~few, 33)):
        for part in np.split(np.flatnonzero(own), range(0, int(own.sum()), 2000)[1:]):
            begin, end = first[part, None], last[part, None] - 1
            places = np.minimum(begin + np.arange(width), end) if width == 160 else begin + (end - begin) * share
            logs, place = _saddle(c[part, None], places, discount)
            near = np.log(place)
            # Few tables of many customers lie below the last exact row's places: a straight line.
            logs = logs + np.interp(near, x, off) + np.minimum(near - x[0], 0) * slope + places * np.log(fresh[part, None])
            for i, a, b, row in zip(part, begin[:, 0], end[:, 0], logs):
                t = np.arange(a, b + 1)
                w = row[: len(t)] if width == 160 else np.polynomial.chebyshev.chebval(2 * (t - a) / (b - a) - 1, _chebyshev() @ row)
                sums = np.cumsum(np.exp(w - w.max()))
                out[i] = t[min(int(np.searchsorted(sums, at[i] * sums[-1], side="right")), len(t) - 1)]
    return out


@cache
def _chebyshev() -> np.ndarray:
    """From values at 33 places to the coefficients of the polynomial of degree 20 that fits them best."""
    places = -np.cos(np.pi * np.arange(33) / 32)
    return np.linalg.pinv(np.polynomial.chebyshev.chebvander(places, 20))


@cache
def _padded(discount: float) -> np.ndarray:
    """The exact rows side by side, minus infinity beyond their ends."""
    table = np.full((EXACT + 1, EXACT), -np.inf)
    for c, row in enumerate(_stirling(discount)):
        table[c, :c] = row
    return table


@cache
def _direct(discount: float) -> list[list[float]]:
    """The generalised Stirling numbers themselves, up to DIRECT customers."""
    return [np.exp(row).tolist() for row in _stirling(discount)[: DIRECT + 1]]


def _drawn(numbers: list[float], fresh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of tables of dishes with equally many customers: weights ``numbers[t - 1] * fresh ** (t - 1)``, summed in order."""
    total = np.zeros(len(fresh))
    for x in reversed(numbers):
        total = total * fresh + x
    wanted, power, below, t = at * total, np.ones(len(fresh)), np.zeros(len(fresh)), np.ones(len(fresh), np.int64)
    for x in numbers[:-1]:
        below += x * power
        power *= fresh
        t += below <= wanted
    return t


def groups_of(customers: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Dishes of two customers or more with the most that one of the group has: equally many up to DIRECT, similarly many up to EXACT, all beyond."""
    order = np.argsort(customers, kind="stable")
    order = order[np.searchsorted(customers[order], 2) :]
    held = customers[order]
    limits = [*range(2, DIRECT + 1), *(DIRECT << k for k in range(1, 12) if DIRECT << k < EXACT), EXACT]
    cuts = np.searchsorted(held, limits, side="right")
    groups = [(limit, order[a:b]) for limit, a, b in zip(limits, np.r_[0, cuts[:-1]], cuts)] + [(EXACT + 1, order[cuts[-1] :])]
    return [(limit, same) for limit, same in groups if len(same)]


def draw_tables(customers: np.ndarray, fresh: np.ndarray, discount: float, at: np.ndarray, groups: list[tuple[int, np.ndarray]] | None = None) -> np.ndarray:
    """Each dish's number of tables, drawn from its distribution given its ``customers``, at the uniform numbers ``at``.

    The weight of t tables is the generalised Stirling number of (customers, t) times
    ``fresh`` (the weight of a new table) to the power of t: exact up to EXACT customers,
    beyond by saddle points set right on the last exact row.
    """
    tables = np.minimum(customers, 1)
    fresh = np.maximum(fresh, 1e-300)
    for most, same in groups_of(customers) if groups is None else groups:
        if most <= DIRECT:
            tables[same] = _drawn(_direct(discount)[most], fresh[same], at[same])
        elif most > EXACT:
            tables[same] = _many(customers[same], fresh[same], discount, at[same])
        else:
            t = np.arange(1.0, most + 1)
            for part in np.split(same, range(0, len(same), 1 + 500_000 // most)[1:]):
                logs = _padded(discount)[customers[part], :most] + t * np.log(fresh[part, None])
                sums = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
                tables[part] = 1 + np.minimum((sums <= at[part, None] * sums[:, -1:]).sum(1), customers[part] - 1)
    return tables


def _uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on 64-bit keys and a seed alone."""
    return (_mix(_mix(keys.astype(np.uint64)) + np.uint64(seed)) >> np.uint64(11)).astype(float) / 9007199254740992.0


class Letters:
    """The letter restaurants: contexts of 3, 1 and 0 bytes, and their predictive probabilities."""

    contexts = (1, SYMBOLS, FOLDED)

    def __init__(self) -> None:
        self.seats: list[dict[int, tuple[int, int]]] = [{}, {}, {}]  # customers who opened a table, and who joined one
        #: Cells of the longest contexts with their own mass, each context's mass for its parent, and the parents' probabilities.
        self.parts = np.zeros(0, np.int32), np.zeros(0, np.float32), np.ones(FOLDED, np.float32), np.full((SYMBOLS, SYMBOLS), 1.0 / SYMBOLS, np.float32)

    @property
    def p(self) -> np.ndarray:
        return letter_table(self.parts)

    def sweep(self, cells: np.ndarray, counts: np.ndarray, seed: int) -> None:
        """Seats the customers ``counts`` of the cells (context * SYMBOLS + symbol) of the longest contexts, then their parents'."""
        parent_of = self._parents()
        customers = dict(zip(cells.tolist(), counts.tolist()))
        need = [customers]
        predictive = [np.full((1, SYMBOLS), 1.0 / SYMBOLS, np.float32)]
        for level in (2, 1, 0):  # up: tables of the last sweep (or one each) are the parents' customers
            if level:
                up: Counter = Counter()
                for cell, n in need[-1].items():
                    context, symbol = divmod(cell, SYMBOLS)
                    up[int(parent_of[level][context]) * SYMBOLS + symbol] += max(1, min(n, self.seats[level].get(cell, (1, 0))[0]))
                need.append(up)
        for level, wanted in zip((0, 1, 2), reversed(need)):  # down: parents first, so children know their probabilities
            above = predictive[-1]
            base = above[parent_of[level]] if level == 1 else above
            tables = np.zeros(self.contexts[level])
            for cell, (opened, _) in self.seats[level].items():
                tables[cell // SYMBOLS] += opened
            at, n = np.array(list(wanted), np.int64), np.array(list(wanted.values()), np.int64)
            fresh = (LETTER_STRENGTH + LETTER_DISCOUNT * tables[at // SYMBOLS]) * above[parent_of[level][at // SYMBOLS], at % SYMBOLS]
            t = draw_tables(n, fresh, LETTER_DISCOUNT, _uniform(at, level * 7 + seed * 31))
            self.seats[level] = {cell: (x, y) for cell, x, y in zip(at.tolist(), t.tolist(), (n - t).tolist())}
            total, number = np.bincount(at // SYMBOLS, n, self.contexts[level]), np.bincount(at // SYMBOLS, t, self.contexts[level])
            share = ((LETTER_STRENGTH + LETTER_DISCOUNT * number) / (total + LETTER_STRENGTH)).astype(np.float32)
            own = ((n - LETTER_DISCOUNT * t) / (total + LETTER_STRENGTH)[at // SYMBOLS]).astype(np.float32)
            if level == 2:
                self.parts = at.astype(np.int32), own, share, predictive[-1]
                return
            p = share[:, None] * base
            p.reshape(-1)[at] += own
            predictive.append(p)

    @staticmethod
    def _parents() -> list[np.ndarray]:
        """For each level the parent's context of every context.

        A folded context of three bytes keeps its last byte: (last byte, hash of the two before).
        """
        return [np.zeros(1, np.int64), np.zeros(SYMBOLS, np.int64), np.minimum(np.arange(FOLDED) // _FOLD, SYMBOLS - 1)]


def letter_table(parts: tuple[np.ndarray, ...]) -> np.ndarray:
    """Probabilities of all symbols after all longest contexts, from :attr:`Letters.parts`."""
    cells, own, share, parents = parts
    p = share[:, None] * parents[Letters._parents()[2]]
    p.reshape(-1)[cells] += own
    return p


_LOGS: dict[tuple, np.ndarray] = {}
forgettable(_LOGS.clear)


def log_table(key: tuple, parts: tuple[np.ndarray, ...]) -> np.ndarray:
    """Logarithms of :func:`letter_table`, flat; a worker remembers those of the last KEPT keys."""
    if key not in _LOGS:
        while len(_LOGS) >= KEPT:
            del _LOGS[next(iter(_LOGS))]
        _LOGS[key] = np.log(letter_table(parts)).reshape(-1)
    return _LOGS[key]


_FOLD = FOLDED // SYMBOLS  #: restaurants that share the same last byte


def letter_cells(lengths: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each letter and end of each word (given by lengths and joined bytes): its cell among the longest contexts, and the word's number."""
    wide = lengths + 4  # three before the word, one after it
    ends = np.cumsum(wide)
    symbols = np.full(int(wide.sum()), START, np.int32)
    inside = np.ones(len(symbols), bool)
    for k in range(3):
        inside[ends - wide + k] = False
    symbols[ends - 1] = STOP
    at = np.flatnonzero(inside)
    inside[ends - 1] = False
    symbols[inside] = letters
    context = symbols[at - 1] * np.int32(_FOLD) + ((symbols[at - 2] * np.int32(SYMBOLS) + symbols[at - 3]) * np.int32(40503) >> 7) % np.int32(_FOLD)
    return context * np.int32(SYMBOLS) + symbols[at], np.repeat(np.arange(len(lengths)), lengths + 1)


def cells_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`letter_cells` of a list of words."""
    return letter_cells(np.array([len(w) for w in words], np.int64), np.frombuffer(b"".join(words), np.uint8))


def spelled(lengths: np.ndarray, letters: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Natural logarithm of each word's probability by letters."""
    cells, owner = letter_cells(lengths, letters)
    return np.bincount(owner, log_p[cells], len(lengths)) if len(lengths) else np.zeros(0)


def take_words(lengths: np.ndarray, letters: np.ndarray, at: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined bytes of the words numbered ``at``."""
    starts = np.cumsum(lengths) - lengths if starts is None else starts
    n = lengths[at]
    return n, letters[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _blocks(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Rows with the name of their block: a task's rows in order, a new block after BLOCK_BYTES of text."""
    number, held = 0, 0
    for batch in batches:
        sizes, start = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")]), 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = int(np.searchsorted(sizes, base + BLOCK_BYTES - held, side="right"))
            if end <= start and held:  # the next row opens a new block, wherever batches end
                number, held = number + 1, 0
                continue
            end = max(start + 1, end)
            yield f"{task}-{number}", batch.slice(start, end - start)
            held += int(sizes[end - 1] - base)
            start = end


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[pa.RecordBatch]]]:
    forget()
    name, parts = "", []
    for block, batch in _blocks(batches, TaskContext.get().partitionId()):
        if block != name and parts:
            yield name, parts
            parts = []
        name = block
        parts.append(batch)
    if parts:
        yield name, parts


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the runs of equal neighbours."""
    first = np.flatnonzero(np.r_[np.ones(min(1, len(values)), bool), values[1:] != values[:-1]])
    return values[first], np.diff(np.r_[first, len(values)])


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


class Model:
    """The jobs that count, sample and score; files of one folder hold what they hand on."""

    def __init__(self, rows: DataFrame, seed: int) -> None:
        self.rows, self.seed = rows, seed
        self.spark: SparkSession = rows.sparkSession
        self.tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.store = Store(fresh_folder(self.spark, "hpylm"))
        self.letters, self.tables, self.customers = [Letters()], [0], [0]

    def _sent(self, df: DataFrame, run: Callable) -> DataFrame:
        return self._dealt(df.mapInArrow(run, MESSAGE))

    def _dealt(self, messages: DataFrame) -> DataFrame:
        return messages.repartitionById(self.tasks, F.col("target"))

    def _numbers(self) -> DataFrame:
        return self.spark.range(0, self.tasks, 1, self.tasks)

    def count_words(self) -> None:
        """Owners' vocabularies: words, and how often training rows have them."""
        tasks, store = self.tasks, self.store

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, parts in _whole_blocks(batches):
                found = []
                for part in parts:
                    tokens, sizes, starts, lengths, data = tokens_of(part.column("text"))
                    train = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool), sizes)
                    words = tokens != END_WORD
                    h = tokens[words]
                    order, new = ordered(h, h)
                    first = order[new]
                    n, letters = take_words(lengths, data, first, starts)
                    found.append((h[first], np.add.reduceat(train[words][order].astype(np.int64), np.flatnonzero(new)) if len(h) else np.zeros(0, np.int64), n, _lowered(letters)))
                    found.append((np.array([END_WORD]), np.array([int(train[~words].sum())]), np.zeros(1, np.int64), np.zeros(0, np.uint8)))
                merged = merge_words(found)
                first = np.r_[0, np.cumsum(merged[2])]
                yield _messages([(o, block, (*(x[at] for x in merged[:2]), _small(merged[2][at]), merged[3][first[at.start] : first[at.stop]])) for o, at in _parts(owners(merged[0], tasks))])

        def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = _received(batches)
            if got:
                merged = merge_words([m for _, _, m in got])
                store.put("vocabulary", got[0][0], merged)
                yield pa.RecordBatch.from_arrays([pa.array([int(merged[1].sum())], pa.int64()), pa.array([int((merged[1] > 0).sum())], pa.int64())], names=["n", "v"])

        self.n, self.v = self._sent(self.rows, send).mapInArrow(receive, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
        least = self.n // (4 * tasks)

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for o in (int(i) for b in batches for i in b.column(0).to_pylist()):
                if store.there("vocabulary", o):
                    h, c, *_ = store.get("vocabulary", o)
                    hot = (c > least) | (h == END_WORD)
                    yield pa.RecordBatch.from_arrays([pa.array(h[hot].view(np.int64)), pa.array(c[hot])], names=["h", "c"])

        found = {r.h % 2**64: r.c for r in self._numbers().mapInArrow(frequent, "h long, c long").collect()}  # 4 x tasks rows at most
        texts = found.pop(int(END_WORD), 0)
        if texts > least:
            found[int(START_WORD)] = texts
        self.split = Split(tasks, {h: c for h, c in found.items() if c > least}, self.n)

    def count_cells(self) -> dict[int, int]:
        """Buckets' cells with their counts, and where each block's cells are among them; returns the frequent contexts' numbers of different words."""
        split, store = self.split, self.store

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, parts in _whole_blocks(batches):
                contexts, words, train, _ = block_tokens(parts)
                first, starts, order, rank = cells_in_order(contexts, words)
                n = np.add.reduceat(train[order].astype(np.int64), starts)[rank]
                at = split.of(contexts[first], words[first])
                dealt = np.argsort(at.astype(np.uint16) if split.buckets < 65536 else at, kind="stable")
                c, w, n = contexts[first[dealt]], words[first[dealt]], n[dealt]
                for b, i in _parts(at[dealt]):
                    values, lengths = _runs(c[i])
                    yield _messages([(b, block, (values, _small(lengths), w[i], _small(n[i])))])

        def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = _received(batches)
            if not got:
                return
            contexts = np.concatenate([np.repeat(m[0], m[1]) for _, _, m in got])
            words, n = (np.concatenate([m[i].astype(t) for _, _, m in got]) for i, t in ((2, np.uint64), (3, np.int64)))
            first, starts, order, rank = cells_in_order(contexts, words)
            c = np.add.reduceat(n[order], starts)[rank]
            place = places_of(starts, order, rank)
            ends = np.cumsum([len(m[2]) for _, _, m in got])
            check = _mix(contexts ^ _mix(words))
            places = [(block, np.diff(place[e - len(m[2]) : e], prepend=0).astype(np.int32), check[e - len(m[2]) : e].sum()) for (_, block, m), e in zip(got, ends)]
            values, lengths = _runs(contexts[first])
            v, run = np.unique(values, return_inverse=True)
            w, at = numbered_words(words[first])
            store.put("places", got[0][0], places)
            store.put("cells", got[0][0], (v, np.repeat(run, lengths).astype(np.uint32), w, at.astype(np.uint32), _small(c)))
            hot = np.isin(v, split.hot)
            tables = np.bincount(np.repeat(run, lengths), c > 0, len(v)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v[hot].view(np.int64)), pa.array(tables[hot])], names=["h", "n"])

        found = self._sent(self.rows, send).mapInArrow(receive, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        return {r.h % 2**64: r.n for r in found.collect()}  # 4 x tasks rows at most

    def first_customers(self) -> None:
        """Each (context, word) has one table; owners learn how many customers that makes, and which buckets ask for which words."""
        tasks, store = self.tasks, self.store

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (int(i) for x in batches for i in x.column(0).to_pylist()):
                if store.there("cells", b):
                    _, _, w, at, c = store.get("cells", b)
                    n = np.bincount(at, c > 0, len(w)).astype(np.int64)
                    yield _messages([(o, _name(b), (w[i], _small(n[i]))) for o, i in _parts(owners(w, tasks))])

        def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = _received(batches)
            if got:
                h = store.get("vocabulary", got[0][0])[0]
                sums, requests = np.zeros(len(h), np.int64), []
                for _, bucket, (w, n) in got:
                    at = np.searchsorted(h, w)
                    sums[at] += n
                    requests.append((int(bucket), np.diff(at, prepend=0).astype(np.int32)))
                store.put("requests", got[0][0], requests)
                store.put("customers0", got[0][0], [sums])
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["n"])

        self._sent(self._numbers(), send).mapInArrow(receive, "n long").agg(F.sum("n")).first()

    def sweep_words(self, step: int) -> None:
        """One sweep over the restaurant without context and, with its tables, over the letters, for each sample of ``customers{step}``."""
        store, seed = self.store, self.seed + 101 * step
        shared = self.spark.sparkContext.broadcast([(x.parts, t) for x, t in zip(self.letters, self.tables)])
        name = (self.store.folder, "sweep", step)
        kind, out = ("customers2" if step == 2 else "customers0"), f"tables{step}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for o in (int(i) for x in batches for i in x.column(0).to_pylist()):
                if not store.there(kind, o):
                    continue
                h, _, lengths, letters = store.get("vocabulary", o)
                cells, owner = letter_cells(lengths.astype(np.int64), letters)
                drawn = []
                for s, (n, (parts, tables)) in enumerate(zip(store.get(kind, o), shared.value)):
                    log_p = log_table((*name, s), parts)
                    fresh = (STRENGTH + DISCOUNT * tables) * np.exp(np.bincount(owner, log_p[cells], len(h)))
                    t = draw_tables(n, fresh, DISCOUNT, _uniform(h, seed + 7919 * s))
                    drawn.append(t)
                    sums = np.bincount(cells, t[owner], len(log_p))
                    different = np.flatnonzero(sums)
                    rows = np.r_[-1, -2, different], np.r_[int(t.sum()), int(n.sum()), sums[different].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([s] * len(rows[0]), pa.int32()), pa.array(rows[0]), pa.array(rows[1])], names=["sample", "cell", "n"])
                store.put(out, o, drawn)

        sums = self._numbers().mapInArrow(run, "sample int, cell long, n long").groupBy("sample", "cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")
        sample, cell, n = (sums.column(c).to_numpy() for c in ("sample", "cell", "n"))
        for s, letters in enumerate(self.letters):
            own = sample == s
            of = dict(zip(cell[own & (cell < 0)].tolist(), n[own & (cell < 0)].tolist()))
            self.tables[s], self.customers[s] = of.get(-1, 0), of.get(-2, 0)
            letters.sweep(cell[own & (cell >= 0)], n[own & (cell >= 0)], seed + s)
        shared.unpersist()

    def _answers(self, step: int) -> DataFrame:
        """Owners tell buckets, for each word these asked for, the logarithm of its probability in each sample, and its count."""
        store = self.store
        shared = self.spark.sparkContext.broadcast([(x.parts, t, n) for x, t, n in zip(self.letters, self.tables, self.customers)])
        name = (self.store.folder, "answer", step)
        kind, seats = ("customers2" if step == 2 else "customers0"), f"tables{step}"

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for o in (int(i) for x in batches for i in x.column(0).to_pylist()):
                if not store.there("requests", o):
                    continue
                _, c, lengths, letters = store.get("vocabulary", o)
                cells, owner = letter_cells(lengths.astype(np.int64), letters)
                logs = []
                for s, (n, t, (parts, tables, customers)) in enumerate(zip(store.get(kind, o), store.get(seats, o), shared.value)):
                    log_p = log_table((*name, s), parts)
                    below = np.bincount(owner, log_p[cells], len(c)) + math.log((STRENGTH + DISCOUNT * tables) / (STRENGTH + customers))
                    own = np.maximum(n - DISCOUNT * t, 0) / (STRENGTH + customers)
                    with np.errstate(divide="ignore"):
                        logs.append(np.logaddexp(np.log(own), below).astype(np.float32))
                for bucket, steps in store.get("requests", o):
                    at = np.cumsum(steps.astype(np.int64))
                    yield _messages([(bucket, _name(o), ([x[at] for x in logs], _small(c[at])))])

        return self._sent(self._numbers(), send)

    def sweep_contexts(self, totals: dict[int, int]) -> dict[int, list[int]]:
        """Sweeps over the context restaurants; owners get the customers that the kept ones make. Returns the frequent contexts' tables in these."""
        tasks, store, seed, hot_totals = self.tasks, self.store, self.seed, totals

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = _received(batches)
            if not got:
                return
            b = got[0][0]
            v, context, w, at, c = store.get("cells", b)
            log_p = np.concatenate([m[0][0] for _, _, m in got])
            live = np.flatnonzero(c)
            kept, sums = [], []
            for t, number in context_sweeps(v, w, context[live], at[live], c[live].astype(np.int64), log_p, hot_totals, seed):
                kept.append((_small(t), number))
                sums.append(np.bincount(at[live], t, len(w)).astype(np.int64))
            store.put("seats", b, kept)
            yield _messages([(o, _name(b), [_small(x[i]) for x in sums]) for o, i in _parts(owners(w, tasks))])

        def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = _received(batches)
            if got:
                places = dict(store.get("requests", got[0][0]))
                sums = np.zeros((KEPT, len(store.get("vocabulary", got[0][0])[0])), np.int64)
                for _, bucket, counts in got:
                    at = np.cumsum(places[int(bucket)].astype(np.int64))
                    for s in range(KEPT):
                        sums[s, at] += counts[s]
                store.put("customers2", got[0][0], list(sums))
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["n"])

        self._dealt(self._answers(1).mapInArrow(sweep, MESSAGE)).mapInArrow(receive, "n long").agg(F.sum("n")).first()
        hot = self.split.hot

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (int(i) for x in batches for i in x.column(0).to_pylist()):
                if store.there("seats", b):
                    v = store.get("cells", b)[0]
                    own = np.flatnonzero(np.isin(v, hot))
                    for s, (_, number) in enumerate(store.get("seats", b)):
                        yield pa.RecordBatch.from_arrays([pa.array([s] * len(own), pa.int32()), pa.array(v[own].view(np.int64)), pa.array(number[own])], names=["sample", "h", "n"])

        found: dict[int, list[int]] = {int(h): [0] * KEPT for h in hot}
        for r in self._numbers().mapInArrow(frequent, "sample int, h long, n long").groupBy("sample", "h").agg(F.sum("n").alias("n")).collect():  # KEPT x 4 x tasks rows at most
            found[r.h % 2**64][r.sample] = r.n
        return found

    def answer_blocks(self, totals: dict[int, list[int]]) -> None:
        """Buckets tell each block the averaged log10 probability of its cells and the counts of their words."""
        tasks, store, customers = self.tasks, self.store, self.split.counts

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = _received(batches)
            if not got:
                return
            b = got[0][0]
            v, context, w, at, c = store.get("cells", b)
            logs = [np.concatenate([m[0][s] for _, _, m in got]) for s in range(KEPT)]
            known = np.concatenate([m[1] for _, _, m in got])[at]
            scores = predictive(v, context, at, c.astype(np.int64), logs, store.get("seats", b), customers, totals).astype(np.float32)
            for block, steps, check in store.get("places", b):
                place = np.cumsum(steps.astype(np.int64))
                yield _messages([(int(block.split("-")[0]) % tasks, block, (b, check, scores[place], _small(known[place])))])

        def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            name, parts, written = None, {}, 0
            for batch in batches:
                for block, data in zip(batch.column("source").to_pylist(), batch.column("data").to_pylist()):
                    if block != name and parts:
                        store.put("answers", name, parts)
                        parts, written = {}, written + 1
                    b, *rest = loaded(data)
                    name, parts[b] = block, rest
            if parts:
                store.put("answers", name, parts)
            yield pa.RecordBatch.from_arrays([pa.array([written + bool(parts)], pa.int64())], names=["n"])

        self._dealt(self._answers(2).mapInArrow(answer, MESSAGE)).sortWithinPartitions("source").mapInArrow(receive, "n long").agg(F.sum("n")).first()

    def scored(self) -> DataFrame:
        """The scores of all rows, written."""
        store, split, n, v = self.store, self.split, self.n, self.v

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, parts in _whole_blocks(batches):
                contexts, words, _, sizes = block_tokens(parts)
                first, begins, order, rank = cells_in_order(contexts, words)
                c, w = contexts[first], words[first]
                at = split.of(c, w)
                dealt = np.argsort(at.astype(np.uint16) if split.buckets < 65536 else at, kind="stable")
                check = _mix(c ^ _mix(w))[dealt]
                answers = store.get("answers", block) if len(first) else {}
                model, count = np.empty(len(first)), np.empty(len(first), np.int64)
                for b, i in _parts(at[dealt]):
                    total, scores, counts = answers.get(b, (None, (), ()))
                    if total != check[i].sum() or len(scores) != i.stop - i.start:
                        raise RuntimeError("two scans deal the rows differently: a block's words have changed")
                    model[dealt[i]], count[dealt[i]] = scores, counts
                place = places_of(begins, order, rank)
                base = np.log10((count + 1) / float(n + v + 1))
                known = count > 0
                starts = np.cumsum(sizes) - sizes
                total = lambda x: np.add.reduceat(x[place], starts)
                out = [sizes, total(known.astype(np.int64)), np.full(len(sizes), n), total(base), total(model), total(np.where(known, base, 0.0)), total(np.where(known, model, 0.0))]
                keep = pa.Table.from_batches(parts).select(["doc_id", "held_out"]).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*keep.columns, *(pa.array(x) for x in out)], names=["doc_id", "held_out", *NUMBERS])

        where = fresh_folder(self.spark, "scores")
        schema = "doc_id long, held_out boolean, " + ", ".join(f"{c} {t}" for c, t in NUMBERS.items())
        self.rows.mapInArrow(run, schema).write.parquet(where)
        return self.spark.read.schema(schema).parquet(where)

    def run(self) -> DataFrame:
        self.count_words()
        distinct = self.count_cells()
        self.first_customers()
        for step in (0, 1):
            self.sweep_words(step)
        totals = self.sweep_contexts(distinct)
        state = pickle.dumps((self.letters[0], self.tables[0]))
        self.letters, self.tables, self.customers = ([pickle.loads(state)[i] for _ in range(KEPT)] if i < 2 else [0] * KEPT for i in range(3))
        self.sweep_words(2)
        self.answer_blocks(totals)
        return self.scored()


NUMBERS = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double", "known_base_score": "double", "known_score": "double"}


def places_of(starts: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each token the place of its cell, from :func:`cells_in_order`."""
    at = np.empty(len(rank), np.int64)
    at[rank] = np.arange(len(rank))
    place = np.empty(len(order), np.int64)
    place[order] = np.repeat(at, np.diff(np.r_[starts, len(order)]))
    return place


def numbered_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes, sorted, and the number of each one among them."""
    order, new = ordered(words, words)
    w = words[order[new]]
    number = np.empty(len(words), np.int64)
    number[order] = np.cumsum(new) - 1
    back = np.argsort(w)
    at = np.empty(len(w), np.int64)
    at[back] = np.arange(len(w))
    return w[back], at[number]


def merge_words(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, summed counts, lengths and joined bytes of the words of all parts."""
    h, c = (np.concatenate([p[i].astype(t) for p in parts]) for i, t in ((0, np.uint64), (1, np.int64)))
    lengths, letters = np.concatenate([p[2].astype(np.int64) for p in parts]), np.concatenate([p[3] for p in parts])
    order, new = ordered(h, h)
    sums, first = np.add.reduceat(c[order], np.flatnonzero(new)), order[new]
    up = np.argsort(h[first])
    return (h[first[up]], sums[up], *take_words(lengths, letters, first[up]))


def block_tokens(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and words of a block's tokens, whether they are learned from, and the tokens of each text."""
    found = [tokens_of(p.column("text"))[:2] for p in parts]
    words, sizes = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    held_out = np.concatenate([p.column("held_out").to_numpy(zero_copy_only=False) for p in parts]).astype(bool)
    return contexts_of(words, sizes), words, np.repeat(~held_out, sizes), sizes


def context_sweeps(v: np.ndarray, w: np.ndarray, context: np.ndarray, at: np.ndarray, c: np.ndarray, log_p: np.ndarray, totals: dict[int, int], seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of tables of the cells (number of context, number of word, customers) and of the contexts, for each kept sweep.

    ``log_p``: the words' probabilities without context.  ``totals``: tables at the start of
    the contexts that other buckets have parts of; their parts are taken to grow as this one does.
    """
    own = np.flatnonzero(c > 1)  # a lone customer has a table of its own
    alone = np.bincount(context, c == 1, len(v)).astype(np.int64)
    p, keys, many = np.exp(log_p.astype(float))[at[own]], _mix(v[context[own]] ^ _mix(w[at[own]])), c[own]
    groups, of, t = groups_of(many), context[own], np.ones(len(c), np.int64)
    number = start = np.bincount(context, minlength=len(v)).astype(np.int64)
    shared = np.flatnonzero(np.isin(v, np.array(list(totals), np.uint64)))
    grown = np.ones(len(v))
    grown[shared] = [totals[int(h)] / max(n, 1) for h, n in zip(v[shared], start[shared])]
    for k in range(BURN_IN + KEPT):
        fresh = (CONTEXT_STRENGTH + CONTEXT_DISCOUNT * (number * grown)[of]) * p
        drawn = draw_tables(many, fresh, CONTEXT_DISCOUNT, _uniform(keys, seed + 13 * k), groups)
        number = alone + np.bincount(of, drawn, len(v)).astype(np.int64)
        if k >= BURN_IN:
            t[own] = drawn
            yield t.copy(), number


def predictive(v: np.ndarray, context: np.ndarray, at: np.ndarray, c: np.ndarray, logs: list[np.ndarray], seats: list[tuple], customers: dict[int, int], totals: dict[int, list[int]]) -> np.ndarray:
    """Log10 of each cell's predictive probability, averaged over the samples.

    ``customers`` and ``totals`` (tables in each sample) are those of contexts that other buckets have parts of.
    """
    live = np.flatnonzero(c)
    shared = np.flatnonzero(np.isin(v, np.array(list(totals), np.uint64)))
    held = np.bincount(context, c, len(v))
    held[shared] = [customers[int(h)] for h in v[shared]]
    mean = None
    for s, (t, number) in enumerate(seats):
        number = number.astype(float)
        number[shared] = [totals[int(h)][s] for h in v[shared]]
        log_p = logs[s].astype(float)[at] + np.log((CONTEXT_STRENGTH + CONTEXT_DISCOUNT * number) / (CONTEXT_STRENGTH + held))[context]
        own = (c[live] - CONTEXT_DISCOUNT * t) / (CONTEXT_STRENGTH + held[context[live]])
        log_p[live] = np.logaddexp(np.log(own), log_p[live])
        mean = log_p if mean is None else np.logaddexp(mean, log_p)
    return (mean - math.log(len(seats))) / math.log(10)


def score(docs: DataFrame, remainder: int = 2, modulus: int = 7, seed: int = 11) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, known_base_score, known_score`` of every row of ``docs``.

    Rows with crc32(doc_id as text) mod ``modulus`` = ``remainder`` are held out of the
    learning (a null id counts as an empty text, so it is learned from unless 0 is the
    remainder).  A null or empty text is its end alone.  Very long texts are one block each,
    held as numbers of their words.  Repeated rows are learned from and scored each; other
    columns are ignored; an empty table gives no rows.  The columns ``known_*`` are the parts
    that words of the learned rows have in the scores.  The result is written to the shared folder.
    """
    doc_id = F.col("doc_id").cast("long")
    held_out = F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    with steady_scans(docs.sparkSession):
        model = Model(rows, seed)
        scored = model.run()
    remove_folder(docs.sparkSession, model.store.folder)
    return scored


def perplexity(scored: DataFrame) -> DataFrame:
    """``held_out, tokens, perplexity, base_perplexity`` of :func:`score`'s rows, and the same over known tokens and over unseen ones."""
    known, unseen = F.sum("n_known"), F.sum(F.col("n_tokens") - F.col("n_known"))

    def per(total: Column, n: Column) -> Column:
        return F.pow(F.lit(10.0), -total / F.nullif(n, F.lit(0)))

    figures = {"perplexity": per(F.sum("score"), F.sum("n_tokens")), "base_perplexity": per(F.sum("base_score"), F.sum("n_tokens"))}
    for name, part in (("", "score"), ("base_", "base_score")):
        figures[f"known_{name}perplexity"] = per(F.sum(f"known_{part}"), known)
        figures[f"unseen_{name}perplexity"] = per(F.sum(F.col(part) - F.col(f"known_{part}")), unseen)
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), known.alias("known_tokens"), *(x.alias(c) for c, x in figures.items()))
