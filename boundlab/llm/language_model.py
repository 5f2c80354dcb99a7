"""Hierarchical Pitman-Yor language model: scores by sampled Chinese restaurants.

Tokens are the words of a text and one end. A token's context is the word before
it (a text begins as after an end); each different context is a restaurant, told
by 64 bits of hash. All context restaurants share one parent, the unigram
restaurant, whose base is uniform over the known words and one unknown. A table
of a context restaurant is a customer of the parent.

Seatings (the customers of each table) are kept from sweep to sweep. In a Gibbs
sweep customers of a dish, drawn at random, get up and sit down again one by one,
at a new table with the Pitman-Yor probability given the parent; a dish has as
many turns as customers, however many. Sweeps run in parallel over dishes:
each sees the restaurants' table counts and the parent's probabilities as they
were before the sweep. Random numbers are hashes of dish, sweep and turn (dishes
of more than `LONG` customers: drawn from a seed of dish and sweep), so results
depend neither on partitions nor on retries. Predictive probabilities are
averaged over the sweeps after the burn-in. Customers first come one by one, too.

How it is spread: a bucket holds all dishes of its words; their number follows
from the size of the texts. Tokens are shuffled once, packed by batch and bucket.
Hot words (found in a sample of the ids, which decides the placement alone) are
spread over the buckets by context; their unigram dishes are seated in tasks of
their own. Contexts meet all buckets: each bucket sends its table counts to the
partition of the context and gets the sums back, by shuffle; a sweep's seatings
are messages of a bucket to itself. Dishes with one customer never change and are only
counted. Scores are summed by document inside the tasks, then over the buckets.

Nulls: a null text has the end alone. Rows with equal doc_id and text get the
same scores. A null doc_id is learnt from. With no training row N and V are 0.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

FOLDS, HELD = 7, 2
SWEEPS, BURN_IN = 3, 1
STRENGTH = (1.0, 1.0)  # of contexts, of the unigram restaurant
END, END_BYTES = xxhash.xxh64_intdigest(b"\n"), xxhash.xxh64_digest(b"\n")
SLICE_TOKENS, BUCKET_BYTES, MOST_HOT, HOT_TASKS = 60_000, 24_000_000, 4096, 64
TURNS = sys.maxsize  # of a dish in a sweep: its customers alone limit them
LONG, PIECE, EMPTY, DRAWS = 512, 1 << 13, 12_000, 1 << 14  # customers from which a dish is seated on its own; dishes seated side by side, and cells without a table among them; turns drawn at once
FAR = 1 << 13  # more than customers, tables and turns of a dish seated side by side
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + U(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> U(shift)
            x *= U(by)
        x ^= x >> U(31)
        return x


def uniform(key: np.ndarray, sweep: int, turn: int | np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each dish (and turn)."""
    return (mixed(np.asarray(key, np.uint64) ^ mixed(np.asarray(sweep << 40 | turn, np.uint64))) >> U(11)) * 2.0**-53


def dish_key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mixed(word ^ mixed(context))


def slim(x: np.ndarray) -> tuple:
    """Counts, most of them small, in a byte each."""
    x = np.asarray(x)
    big = np.flatnonzero(x >= 255).astype(np.uint32)
    return np.minimum(x, 255).astype(np.uint8), big, x[big].astype(np.int64)


def full(packed: tuple) -> np.ndarray:
    out = packed[0].astype(np.int64)
    out[packed[1]] = packed[2]
    return out


def close(x: np.ndarray) -> np.ndarray:
    """Rising hashes as their differences, byte by byte: the highest bytes are alike, which a shuffle's compression uses."""
    return np.ascontiguousarray(np.diff(x, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)


def apart(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(x.T).view("<u8").ravel(), dtype=np.uint64)


def token_hashes(text: bytes | None) -> np.ndarray:
    return np.frombuffer(b"".join([*map(xxhash.xxh64_digest, (text or b"").lower().split()), END_BYTES]), ">u8").astype(np.uint64)


def before(hashes: np.ndarray) -> np.ndarray:
    """The context of each token."""
    out = np.empty_like(hashes)
    out[0], out[1:] = END, hashes[:-1]
    return out


# Seatings: (t, sizes), the number of tables of each dish and all tables' customers, dish after dish.


def _pieces(chosen: np.ndarray, steps: np.ndarray, tables: np.ndarray):
    """The chosen dishes in pieces of bounded size, of like steps (within a factor of four) and like numbers of tables; those with more steps first."""
    kind = np.log2(np.maximum(steps[chosen], 1)).astype(np.int64) // 2
    order = chosen[np.lexsort((tables[chosen], kind))]
    kind, most = np.sort(kind), tables[order]
    i = 0
    while i < len(order):
        n = min(PIECE, int(np.searchsorted(kind, kind[i], "right")) - i)
        empty = most[i : i + n] * np.arange(1, n + 1) - np.cumsum(most[i : i + n])  # cells of the piece without a table, if it ends here
        n = max(1, int(np.searchsorted(empty, EMPTY)))
        part = order[i : i + n]
        yield part[np.argsort(-steps[part], kind="stable")]
        i += n


def _joined(n: int, parts) -> tuple[np.ndarray, np.ndarray]:
    """The seatings of n dishes from (dishes, matrix of tables), or (dish, tables)."""
    t = np.zeros(n, np.int64)
    found = []
    for rows, m in parts:
        m = m.T
        there = m > 0
        t[rows] = there.sum(axis=-1)
        found.append((np.repeat(rows, t[rows]), m[there]))
    if not found:
        return t, np.zeros(0, np.int64)
    who, size = (np.concatenate(x) for x in zip(*found, strict=True))
    return t, size[np.argsort(who, kind="stable")].astype(np.int64)


class Side:
    """Dishes seated side by side, a column each: under a row of zeros the customers of the first table, of the first two and so on, then numbers too large for any."""

    def __init__(self, own: np.ndarray, sizes: np.ndarray):
        """Tables of each dish, and all their customers, dish after dish."""
        self.t, ends = own.astype(np.int64), np.cumsum(own)
        self.s = np.repeat(np.arange(FAR, FAR + int(own.max(initial=0)) + 3, dtype=np.int16)[:, None], len(own), axis=1)
        self.s[0] = 0
        total = np.r_[0, np.cumsum(sizes)]
        who = np.repeat(np.arange(len(own)), own)
        self.s[np.arange(len(who)) - (ends - own)[who] + 1, who] = total[1:] - total[ends - own][who]
        self.n = np.diff(total[np.r_[0, ends]]).astype(float)
        self.most = int(own.max(initial=0))

    def leave(self, at: slice | np.ndarray, u: np.ndarray) -> None:
        """One customer of each dish, drawn by u, gets up."""
        s = self.s[:, at]
        s -= s > (u * self.n[at]).astype(np.int16)
        self.n[at] -= 1
        gone = np.flatnonzero((s[1:] == s[:-1]).any(axis=0))
        if len(gone):  # a table was left: those after it move up
            own = s[:, gone]
            k = (own[1:] == own[:-1]).argmax(axis=0) + 1
            s[:, gone] = np.where(np.arange(len(s))[:, None] >= k, np.r_[own[1:], own[-1:] + 1], own)
            self.t[gone if isinstance(at, slice) else at[gone]] -= 1
        if not isinstance(at, slice):
            self.s[:, at] = s

    def sit(self, at: slice | np.ndarray, a: np.ndarray, d: float, u: np.ndarray) -> None:
        """One customer of each dish sits down: at a new table with weight a, at others by their customers less d."""
        if self.most + 2 > len(self.s):
            self.s = np.r_[self.s, self.s[-1] + np.arange(1, 3 + len(self.s) // 4, dtype=np.int16)[:, None]]
        s, n, t = self.s[:, at], self.n[at] + 1, self.t[at]
        rest = n - 1 - d * t
        x = u * (rest + a) - a
        new = (x < 0) | (n == 1)
        x = np.where(new, 2.0 * FAR, np.minimum(x, rest * (1 - 1e-9)))
        s += s > (x + (d * np.arange(len(s)))[:, None]).astype(np.int16)
        self.n[at] = n
        new = np.flatnonzero(new)
        if len(new):
            own = t[new] + 1
            s[own, new] = n[new]
            self.t[new if isinstance(at, slice) else at[new]] = own
            self.most = max(self.most, int(own.max()))
        if not isinstance(at, slice):
            self.s[:, at] = s

    def tables(self) -> np.ndarray:
        """Customers of each table, zeros after a dish's last."""
        m = np.diff(self.s[: self.most + 1], axis=0)
        return np.where(np.arange(self.most)[:, None] < self.t, m, 0)


def _draws(key: np.ndarray, left: np.ndarray, sweep: int, turns: int, each: int):
    """(first dishes that have this turn, `each` rows of draws) turn after turn, drawn for some turns at once; left: turns of each dish, falling."""
    up, j = left[::-1], 0
    while j < turns:
        n = len(left) - int(np.searchsorted(up, j, "right"))
        some = min(turns - j, max(1, (1 << 14) // n))
        u = uniform(key[:n], sweep, np.arange(each * j, each * (j + some))[:, None])
        for i in range(some):
            n = len(left) - int(np.searchsorted(up, j + i, "right"))
            yield slice(0, n), u[each * i : each * (i + 1), :n]
        j += some


def _pair(a: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes with two customers: the last to sit down decides, whatever was before."""
    return np.where(u * ((1 - d) + a) < a, [[1], [1]], [[2], [0]])


def _long(sizes: np.ndarray, want: int, turns: int, a: float, d: float, seed: int) -> np.ndarray:
    """The same for one dish of many customers, who come or go up to `want` and then have their turns.

    A list of all customers' tables gives one to leave, and one to join if a draw
    keeps it (by 1 less d / customers), so a turn costs the same for any number of
    tables. Draws are made for many turns at once.
    """
    rng = np.random.default_rng(seed)
    n, t, size, free = int(sizes.sum()), len(sizes), sizes.tolist(), []
    seat = np.repeat(np.arange(t), sizes).tolist()

    def draws(turns):
        for i in range(0, turns, DRAWS):
            u = rng.random((4, min(DRAWS, turns - i)))
            u[3] = d / np.maximum(u[3], 1e-300)
            yield u

    def place(least, n, hole):
        """A table to join: that of a customer drawn (none in the hole), unless it has fewer customers than the draw asks for."""
        while True:
            i = int(rng.random() * n)
            k = seat[n if i == hole else i]
            if size[k] >= least:
                return k
            least = d / max(rng.random(), 1e-300)

    def opened():
        if free:
            return free.pop()
        size.append(0)
        return len(size) - 1

    while n > want:
        i = int(rng.random() * n)
        k = seat[i]
        n -= 1
        seat[i] = seat[n]
        seat.pop()
        size[k] -= 1
        if not size[k]:
            t -= 1
            free.append(k)
    for new, which, _, least in draws(want - n):
        at = (which * np.arange(n, n + len(which))).astype(np.int64).tolist()
        for u, i, enough in zip(new.tolist(), at, least.tolist(), strict=True):
            if u * (n - d * t + a) < a or not n:
                k = opened()
                t += 1
            else:
                k = seat[i]
                if size[k] < enough:
                    k = place(d / max(rng.random(), 1e-300), n, -1)
            seat.append(k)
            size[k] += 1
            n += 1
    others = n - 1
    limit = a / (others - d * t + a) if n > 1 else 1.0
    for new, which, gone, least in draws(turns):
        up, at = ((x * m).astype(np.int64).tolist() for x, m in ((gone, n), (which, others)))
        for i, u, j, enough in zip(up, new.tolist(), at, least.tolist(), strict=True):
            k = seat[i]
            left = size[k] - 1
            size[k] = left
            if not left:
                t -= 1
                free.append(k)
                limit = a / (others - d * t + a)
            if u < limit:
                k = opened()
                t += 1
                limit = a / (others - d * t + a)
            else:
                k = seat[others if i == j else j]  # the others are all but i
                if size[k] < enough:
                    k = place(d / max(rng.random(), 1e-300), others, i)
            size[k] += 1
            seat[i] = k
    return np.array([x for x in size if x], np.int64)


def first_seats(c: np.ndarray, a: np.ndarray, d: float, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seatings of dishes with c customers each, who come one by one."""

    def made():
        pairs = np.flatnonzero(c == 2)
        yield pairs, _pair(a[pairs], d, uniform(key[pairs], 0, 1))
        alone = np.flatnonzero(c == 1)
        yield alone, np.ones((1, len(alone)), np.int16)
        guess = (1 + a * np.log1p(c / (1 + a))).astype(np.int64)  # puts like dishes side by side, no more
        for rows in _pieces(np.flatnonzero((c <= LONG) & (c > 2)), c, guess):
            side, own = Side(np.ones(len(rows), np.int64), np.ones(len(rows), np.int64)), a[rows]
            for j, (r, u) in enumerate(_draws(key[rows], c[rows], 0, int(c[rows[0]]), 1)):
                if j:  # the first has sat down
                    side.sit(r, own[r], d, u[0])
            yield rows, side.tables()
        for i in np.flatnonzero(c > LONG):
            yield np.array([i]), _long(np.zeros(0, np.int64), int(c[i]), 0, float(a[i]), d, int(key[i]))[:, None]

    return _joined(len(c), made())


def gibbs(t: np.ndarray, sizes: np.ndarray, c: np.ndarray, want: np.ndarray, a: np.ndarray, d: float, key: np.ndarray, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """Brings each dish from c to `want` customers, one by one, then has as many customers as it has change their seats."""

    def made():
        long = np.maximum(c, want) > LONG
        pairs = np.flatnonzero((want == 2) & ~long)
        yield pairs, _pair(a[pairs], d, uniform(key[pairs], sweep, 3))
        alone = np.flatnonzero((want == 1) & ~long)
        yield alone, np.ones((1, len(alone)), np.int16)
        start = np.cumsum(t) - t
        for rows in _pieces(np.flatnonzero(~long & (want > 2)), want, t):
            own, weight, keys, change = t[rows], a[rows], key[rows], (want - c)[rows]
            side = Side(own, sizes[np.repeat(start[rows] - np.cumsum(own) + own, own) + np.arange(own.sum())])
            for j in range(int(np.abs(change).max())):
                r = np.flatnonzero(change < -j)
                if len(r):
                    side.leave(r, uniform(keys[r], sweep, 1 << 20 | j))
                r = np.flatnonzero(change > j)
                if len(r):
                    side.sit(r, weight[r], d, uniform(keys[r], sweep, 1 << 20 | j))
            for r, (u, v) in _draws(keys, want[rows], sweep, int(want[rows[0]]), 2):
                side.leave(r, u)
                side.sit(r, weight[r], d, v)
            yield rows, side.tables()
        for i in np.flatnonzero(long):
            yield np.array([i]), _long(sizes[start[i] : start[i] + t[i]], int(want[i]), int(want[i]) if want[i] > 1 else 0, float(a[i]), d, int(mixed(key[i] ^ U(sweep))))[:, None]

    return _joined(len(t), made())


def hot_counter(rows):
    """(word, n): words with at least 1/4096 of the tokens of 2000 texts; a word that common overall is that common somewhere."""
    found: Counter = Counter()

    def told():
        least = max(1, sum(found.values()) // 4096)
        return [(xxhash.xxh64_intdigest(w) - (1 << 64 if xxhash.xxh64_intdigest(w) >> 63 else 0), n) for w, n in found.items() if n >= least]

    for i, r in enumerate(rows, 1):
        found.update(bytes(r["text"]).lower().split())
        if i % 2000 == 0:
            yield from told()
            found.clear()
    yield from told()


def packer(buckets: int, hot: np.ndarray):
    """Messages to buckets: tokens of a batch of documents by bucket; words and contexts as places in a list of hashes."""

    most = min(1_200_000, max(300_000, SLICE_TOKENS * buckets))  # tokens of a batch

    def flush(held):
        h, c = np.concatenate([x[2] for x in held]), np.concatenate([before(x[2]) for x in held])
        owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x[2]) for x in held])
        spread = np.where(np.isin(h, hot), mixed(c), U(0)) if len(hot) else U(0)
        with np.errstate(over="ignore"):
            bucket = ((h + spread) % U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        ids, train = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], bool)
        out = []
        for k in range(buckets):
            own = order[ends[k] : ends[k + 1]]
            if len(own):
                mine = owner[own]
                first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                rows, sizes = mine[first], np.diff(np.r_[first, len(mine)])
                known, at = np.unique(np.concatenate([h[own], c[own]]), return_inverse=True)
                at = at.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32)
                out.append((k, ("tokens", 0, k, pickle.dumps((ids[rows], train[rows], slim(sizes), close(known), at[: len(own)], at[len(own) :]), 5))))
        return out

    def run(rows):
        held, size = [], 0
        for r in rows:
            hashes = token_hashes(bytes(r["text"]))
            held.append((r["key"], r["train"], hashes))
            size += len(hashes)
            if size >= most:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


class Bucket:
    """All tokens of a bucket: dishes (word, context) with training counts, and where documents use them."""

    def __init__(self, payloads: list[bytes], hot: np.ndarray):
        read = []
        while payloads:
            ids, taught, sizes, known, words, contexts = pickle.loads(payloads.pop())
            read.append((ids, taught, sizes, apart(known), words, contexts))
        hashes = np.unique(np.concatenate([r[3] for r in read])) if read else np.zeros(0, np.uint64)
        wide = [(np.searchsorted(hashes, r[3]).astype(np.uint64), r[4], r[5]) for r in read]
        empty = [np.zeros(0, k) for k in (np.int64, bool, np.int64)]
        self.docs, train, sizes = (np.concatenate([empty[k], *(full(r[k]) if k == 2 else r[k] for r in read)]) for k in range(3))
        del read
        key = np.concatenate([np.zeros(0, np.uint64), *(at[w] << U(32) | at[v] for at, w, v in wide)])
        del wide
        self.owner = np.repeat(np.arange(len(self.docs), dtype=np.int32), sizes)
        order = np.argsort(key)  # equal keys are one dish: their order doesn't matter
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]][: len(key)]
        self.cell = np.empty(len(key), np.int32)
        self.cell[order] = np.cumsum(new, dtype=np.int32) - 1
        cells = key[new]
        del key, order, new
        self.words, self.word = self._used(hashes, (cells >> U(32)).astype(np.int64))
        self.contexts, self.context = self._used(hashes, (cells & U(0xFFFFFFFF)).astype(np.int64))
        taught = train[self.owner]
        self.count = np.bincount(self.cell[taught], minlength=len(cells)).astype(np.int64)
        self.word_count = np.bincount(self.word, self.count, len(self.words)).astype(np.int64)
        self.several = np.flatnonzero(self.count > 1)  # the dishes that a sweep can change
        self.hot = np.full(len(self.words), -1)  # place in the list of hot words
        if len(hot):
            at = np.minimum(np.searchsorted(hot, self.words), len(hot) - 1)
            self.hot = np.where(hot[at] == self.words, at, -1)

    @staticmethod
    def _used(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes at these places, and where each place's is among them."""
        there = np.zeros(len(hashes), bool)
        there[at] = True
        return hashes[there], (np.cumsum(there) - 1)[at]

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """Words that are taught, and places of those whose unigram seating can change, or that are hot."""
        known = self.word_count > 0
        return known, np.flatnonzero(known & ~((self.hot < 0) & (self.word_count == 1)))

    def fixed(self, parts: int, n_hot: int) -> tuple[dict, list, dict]:
        """What sweeps need of the bucket, what contexts' partitions need (by partition), and totals."""
        one = self.count == 1
        cells = lambda mask: np.bincount(self.context[mask], minlength=len(self.contexts))
        several = cells(self.count > 1)
        marked = several > 0
        seats = np.bincount(self.context, self.count, len(self.contexts)).astype(np.int64)
        ones = cells(one)  # of contexts that aren't marked all customers sit alone
        part = (self.contexts % U(parts)).astype(np.int64)
        up = []
        for p in range(parts):
            at = np.flatnonzero(part == p)
            mine = at[marked[at]]
            up.append((self.contexts[at], slim(seats[at]), np.packbits(marked[at]), slim(ones[mine]), slim(several[mine])))
        cool = self.hot < 0
        known, kept = self.kept()
        place = np.full(len(self.words), -1)
        place[kept] = np.arange(len(kept))
        asked = np.full(len(self.contexts), -1)
        asked[marked] = np.arange(marked.sum())
        alone = np.bincount(self.word[one], minlength=len(self.words))[kept]
        runs = np.bincount(place[self.word[self.several]], minlength=len(kept))  # dishes come word by word
        at_hot = np.flatnonzero(self.hot[kept] >= 0)
        held = {"c": slim(self.count[self.several]), "context": asked[self.context[self.several]].astype(np.int32), "runs": slim(runs), "words": self.words[kept], "contexts": self.contexts[marked], "alone": slim(alone), "hot": (at_hot, self.hot[kept][at_hot])}
        first = (np.bincount(self.word[self.count > 0], minlength=len(self.words))).astype(np.int64)  # tables, if each dish has one
        hot = lambda x: np.bincount(self.hot[~cool], x[~cool], n_hot) if n_hot else np.zeros(0)
        totals = {"n": self.count.sum(), "v": (known & cool).sum(), "single": (known & cool & (self.word_count == 1)).sum(), "customers": first[cool].sum(), "hot": hot(first), "hot_count": hot(self.word_count)}
        for name, x in (("cells", self.count), ("types", first[cool])):
            totals |= {f"{name}{k}": (x == k).sum() for k in (1, 2)}
        return held, up, totals


def parent(customers, tables, hot, model, state):
    """Probability of words in the unigram restaurant; hot words' seatings come from the state."""
    d = model["discounts"][1]
    if len(hot) and (hot >= 0).any():
        customers, tables = customers.astype(float), tables.astype(float)
        mine = hot >= 0
        customers[mine], tables[mine] = state["hot"][hot[mine]], state["hot_tables"][hot[mine]]
    return (np.maximum(customers - d * tables, 0) + (STRENGTH[1] + d * state["tables"]) * model["base"]) / (STRENGTH[1] + state["customers"])


def root_weight(model, state) -> float:
    return (STRENGTH[1] + model["discounts"][1] * state["tables"]) * model["base"]


class Held:
    """What a bucket's sweeps work on, unpacked."""

    def __init__(self, packed: bytes):
        h = pickle.loads(packed)
        self.c, self.context, self.words, self.contexts, self.alone = full(h["c"]), h["context"], h["words"], h["contexts"], full(h["alone"])
        self.word = np.repeat(np.arange(len(self.words)), full(h["runs"]))
        self.hot = np.full(len(self.words), -1)
        self.hot[h["hot"][0]] = h["hot"][1]

    def customers(self, t: np.ndarray) -> np.ndarray:
        """Of the unigram restaurant's dishes: the tables of all contexts."""
        return np.bincount(self.word, t, len(self.words)).astype(np.int64) + self.alone

    def part(self, parts: int) -> np.ndarray:
        return (self.contexts % U(parts)).astype(np.int64)


def packed_seats(t: np.ndarray, sizes: np.ndarray, c: np.ndarray) -> tuple:
    """Tables, and the sizes of those that don't follow from c customers at one table or at c."""
    return slim(t), slim(sizes[np.repeat((t > 1) & (t < c), t)])


def read_seats(packed: tuple, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t, told = map(full, packed)
    sizes = np.repeat(np.where(t == 1, c, 1), t)
    sizes[np.repeat((t > 1) & (t < c), t)] = told
    return t, sizes


def unpacked(seats: bytes, held: Held) -> dict:
    s = pickle.loads(seats)
    t, sizes = read_seats(s["dishes"], held.c)
    own = np.where(held.hot < 0, held.customers(t), 0)
    rt, rsizes = read_seats(s["words"], own)
    return {"t": t, "sizes": sizes, "rt": rt, "rsizes": rsizes}


def sweep(held: Held, seats: dict | None, tables: np.ndarray, model: dict, state: dict, number: int, n_hot: int) -> tuple[dict, dict]:
    """The bucket's seatings after a sweep (number 0: the first ones), and totals. tables: of the marked contexts, before the sweep."""
    d, cool = model["discounts"], held.hot < 0
    old = held.customers(np.ones(len(held.c)) if seats is None else seats["t"])
    prob = parent(old, np.ones(len(old)) if seats is None else seats["rt"], held.hot, model, state)
    a = (STRENGTH[0] + d[0] * tables[held.context]) * prob[held.word]
    weight = np.full(len(old), root_weight(model, state))
    key = dish_key(held.words[held.word], held.contexts[held.context])
    t, sizes = first_seats(held.c, a, d[0], key) if seats is None else gibbs(seats["t"], seats["sizes"], held.c, held.c, a, d[0], key, number)
    customers = held.customers(t)
    own, key = np.where(cool, customers, 0), mixed(held.words)
    rt, rsizes = first_seats(own, weight, d[1], key) if seats is None else gibbs(seats["rt"], seats["rsizes"], np.where(cool, old, 0), own, weight, d[1], key, number)
    hot = np.bincount(held.hot[~cool], customers[~cool], n_hot) if n_hot else np.zeros(0)
    return {"dishes": packed_seats(t, sizes, held.c), "words": packed_seats(rt, rsizes, own)}, {"customers": own.sum(), "tables": rt.sum(), "hot": hot}


def hot_sweep(spark, hot: np.ndarray, seats: list | None, c: np.ndarray, want: np.ndarray, weight: np.ndarray, d: float, number: int) -> list[np.ndarray]:
    """The tables of each hot word's unigram dish after a sweep, some words a task: such dishes grow with the corpus, their tables hardly."""

    def seated(i):
        one, key = slice(i, i + 1), mixed(hot[i : i + 1])
        if seats is None:
            return first_seats(want[one], weight[one], d, key)[1]
        return gibbs(np.array([len(seats[i])]), seats[i], c[one], want[one], weight[one], d, key, number)[1]

    return spark.sparkContext.parallelize(range(len(hot)), min(len(hot), HOT_TASKS)).map(seated).collect() if len(hot) else []


def told(messages) -> dict:
    """What a partition was told: (sender, body) by kind and sweep. A message is (to, (kind, sweep, sender, body))."""
    out = defaultdict(list)
    for _, (kind, number, sender, body) in messages:
        out[kind, number].append((sender, body))
    return out


class Contexts:
    """A partition of contexts: customers and tables of dishes with one customer, and which bucket asked for which."""

    def __init__(self, ups):
        ups = sorted(ups, key=lambda x: x[0])
        keys = np.unique(np.concatenate([u[1][0] for u in ups])) if ups else np.zeros(0, np.uint64)
        self.seats, self.ones, self.several = (np.zeros(len(keys), np.int64) for _ in range(3))
        self.at, self.marked = {}, {}
        for b, (k, seats, marked, ones, several) in ups:
            at, marked, seats = np.searchsorted(keys, k).astype(np.int32), np.unpackbits(marked, count=len(k)).astype(bool), full(seats)
            self.at[b], self.marked[b] = at, marked
            alone = seats.copy()
            alone[marked] = full(ones)
            self.seats[at] += seats
            self.ones[at] += alone
            self.several[at[marked]] += full(several)

    def packed(self) -> dict:
        return vars(self) | {k: slim(getattr(self, k)) for k in ("seats", "ones", "several")}

    @classmethod
    def read(cls, packed: bytes) -> Contexts:
        out = cls([])
        vars(out).update(pickle.loads(packed))
        out.seats, out.ones, out.several = map(full, (out.seats, out.ones, out.several))
        return out

    def tables(self, sums) -> np.ndarray:
        """Tables of each context. sums: (bucket, tables of its marked contexts); None: one for each dish."""
        out = self.ones.copy()
        if sums is None:
            return out + self.several
        for b, x in sums:
            out[self.at[b][self.marked[b]]] += full(x)
        return out


def _added(a, b):
    return {k: a[k] + b[k] for k in a}


def _summed(messages, number: int) -> dict | None:
    """Totals of all buckets, summed in a tree, so that the driver gets a few small arrays."""
    read = messages.filter(lambda x: x[1][:2] == ("totals", number)).map(lambda x: x[1][3])
    return read.treeAggregate(None, lambda a, b: b if a is None else _added(a, b), lambda a, b: b if a is None else a if b is None else _added(a, b))


def _by_document(docs, sums, parts: int):
    """A bucket's sums, cut by document: (part, packed sums)."""
    part = (docs.view(np.uint64) % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    cuts = [(k, order[ends[k] : ends[k + 1]]) for k in range(parts) if ends[k] < ends[k + 1]]
    return [(k, docs[at], [x[at] for x in sums]) for k, at in cuts]


def _merged(rows):
    """All buckets' sums of a part's documents, added up in the order of the buckets."""
    keys, sums = np.zeros(0, np.int64), None
    for _, packed in sorted(((b, p) for _, (b, p) in rows), key=lambda x: x[0]):
        docs, new, counts = pickle.loads(packed)
        new = new + [full(x) for x in counts]
        both, at = np.unique(np.concatenate([keys, docs]), return_inverse=True)
        old = sums or [np.zeros(0, x.dtype) for x in new]
        sums = [np.bincount(at, np.concatenate([a, b]), len(both)) for a, b in zip(old, new, strict=True)]
        keys = both
    if sums:
        yield (bytearray(pickle.dumps((keys, [x if k < 2 else x.astype(np.int32) for k, x in enumerate(sums)]), 5)),)


def _unpack(batches):
    for b in batches:
        for p in b.column("sums"):
            docs, sums = pickle.loads(p.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(docs), *map(pa.array, sums)], ["key", "score", "plus", "n_tokens", "n_known", "ends"])


def scored(bucket: Bucket, samples: list[dict], reply: tuple, model: dict):
    """By document: sums of log10 of the averaged probability, log10(c + 1), tokens, known tokens, ends."""
    seats, tables = reply
    hot, (known, kept) = bucket.hot, bucket.kept()
    total = np.zeros(len(bucket.count))
    for s, sample in enumerate(samples):
        state = model["averaged"][s]
        t = (bucket.count > 0).astype(np.int64)
        t[bucket.several] = sample["t"]
        customers, roots = np.bincount(bucket.word, t, len(known)).astype(np.int64), known.astype(np.int64)
        roots[kept] = sample["rt"]
        prob = parent(customers, roots, hot, model, state)
        d = model["discounts"][0]
        back = (STRENGTH[0] + d * tables[s][bucket.context]) * prob[bucket.word]
        total += (np.maximum(bucket.count - d * t, 0) + back) / (STRENGTH[0] + seats[bucket.context])
    word_count = bucket.word_count.copy()
    word_count[hot >= 0] = model["hot_count"][hot[hot >= 0]]
    values = (np.log10(total / len(samples)), np.log10(word_count + 1.0)[bucket.word], np.ones(len(total)), (word_count > 0)[bucket.word], (bucket.words == U(END))[bucket.word])
    docs, at = np.unique(bucket.docs, return_inverse=True)
    sums = [np.zeros(len(docs)) for _ in values]
    for i in range(0, len(bucket.cell), 1 << 19):
        cell, owner = (x[i : i + (1 << 19)] for x in (bucket.cell, bucket.owner))
        for sum_, value in zip(sums, values, strict=True):
            sum_ += np.bincount(at[owner], value[cell], len(docs))
    return docs, [x if k < 2 else x.astype(np.int32) for k, x in enumerate(sums)]


def score_texts(docs: DataFrame, held_out: F.Column, sweeps: int = SWEEPS, burn_in: int = BURN_IN, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.xxhash64("doc_id", text).alias("key"), text.cast("binary").alias("text"))
    layout = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    size, n_rows = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if not n_rows:
        return spark.createDataFrame([], layout)
    buckets = max(1, -(-(size + n_rows) // bucket_bytes))
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(16)) == 0).select("text")
    # RDDs throughout: Arrow functions would run in Python workers of their own, which stay and keep their memory
    counted = spark.createDataFrame(sample.rdd.mapPartitions(hot_counter), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    size = counted.agg(F.sum("n")).first()[0] or 0
    limit = min(4 * buckets, MOST_HOT)  # no more words can have 1 / limit of the tokens
    hot = counted.where(F.col("n") * limit >= size).orderBy(F.desc("n"), "word").limit(limit).toPandas()["word"] if buckets > 1 else []
    hot = np.sort(np.array(hot, np.int64).view(np.uint64))
    n_hot = len(hot)
    # Partition k of all that follows is bucket k and the k-th part of the contexts. What is dealt out alike is put side by side by `union`
    # without a shuffle, so that one Python worker a task reads it; zipped RDDs would take one for each and one for every pair.
    dealt = lambda rdd: rdd.partitionBy(buckets, int)
    beside = lambda *rdds: spark.sparkContext.union(list(rdds))
    tokens = dealt(rows.select("key", (~F.col("held_out")).alias("train"), "text").rdd.mapPartitions(packer(buckets, hot)))

    def built(b, messages):
        payloads = [body for _, body in told(messages)["tokens", 0]]
        if payloads:
            held, up, totals = Bucket(payloads, hot).fixed(buckets, n_hot)
            yield b, ("held", 0, b, pickle.dumps(held, 5))
            yield b, ("totals", 0, b, totals)
            yield from ((p, ("up", 0, b, u)) for p, u in enumerate(up) if len(u[0]))

    def arranged(p, messages):
        found = told(messages)
        if found["up", 0]:
            yield p, ("contexts", 0, p, pickle.dumps(Contexts(found["up", 0]).packed(), 5))

    made = dealt(tokens.mapPartitionsWithIndex(built))
    first = _summed(made, 0)
    held = made.filter(lambda x: x[1][0] == "held")
    fixed = dealt(made.mapPartitionsWithIndex(arranged))
    n, v = int(first["n"]), int(first["v"] + (first["hot_count"] > 0).sum())
    for j in (1, 2):  # hot words' tables lie in several buckets
        first[f"types{j}"] += (first["hot"] == j).sum()
    rate = lambda name: min(0.95, max(0.05, first[f"{name}1"] / max(1, first[f"{name}1"] + 2 * first[f"{name}2"])))
    model = {"discounts": (float(rate("cells")), float(rate("types"))), "base": 1 / (v + 1), "hot_count": first["hot_count"]}
    single = int(first["single"])
    seen = (first["hot"] > 0).astype(np.int64)
    state = {"customers": int(first["customers"] + first["hot"].sum()), "tables": v, "hot": first["hot"].astype(np.int64), "hot_tables": seen}
    hot_seats = None

    def replies(moved: dict, whole: bool):
        """For each bucket the tables of the contexts that it marked; if whole, customers and tables of all that it has. moved: messages of sweeps."""
        numbers = list(moved)

        def answer(p, messages):
            found = told(messages)
            for _, packed in found["contexts", 0]:
                c = Contexts.read(packed)
                tables = [c.tables(found["sums", j]) for j in numbers] or [c.tables(None)]
                for b, at in c.at.items():
                    at = at if whole else at[c.marked[b]]
                    yield b, ("reply", 0, p, [slim(x[at]) for x in ([c.seats] if whole else []) + tables])

        return dealt(beside(fixed, *moved.values()).mapPartitionsWithIndex(answer))

    moved, history = {}, []
    for k in range(sweeps + 1):

        def step(b, messages, k=k, state=state):
            found = told(messages)
            for _, packed in found["held", 0]:
                h, before_ = Held(packed), found["seats", k - 1]
                tables, part = np.zeros(len(h.contexts), np.int64), h.part(buckets)
                for p, (t,) in found["reply", 0]:
                    tables[part == p] = full(t)
                seats, totals = sweep(h, unpacked(before_[0][1], h) if before_ else None, tables, model, state, k, n_hot)
                yield b, ("seats", k, b, pickle.dumps(seats, 5))
                yield b, ("totals", k, b, totals)
                sums = np.bincount(h.context, full(seats["dishes"][0]), len(h.contexts)).astype(np.int64)
                yield from ((int(p), ("sums", k, b, slim(sums[part == p]))) for p in np.unique(part))

        moved = {k: dealt(beside(held, *moved.values(), replies(moved, False)).mapPartitionsWithIndex(step))}
        found = _summed(moved[k], k)
        customers, weight = found["hot"].astype(np.int64), np.full(n_hot, root_weight(model, state))
        d = model["discounts"][1]
        hot_seats = hot_sweep(spark, hot, hot_seats, state["hot"], customers, weight, d, k)
        hot_tables = np.array([len(x) for x in hot_seats], np.int64)
        state = {"customers": int(found["customers"]) + single + int(customers.sum()), "tables": int(found["tables"]) + single + int(hot_tables.sum()), "hot": customers, "hot_tables": hot_tables}
        history.append((k, moved[k], state))
    used = history[burn_in + 1 :] or history[-1:]
    model["averaged"] = [s for _, _, s in used]
    sampled = {k: m for k, m, _ in used}
    numbers = list(sampled)

    def finish(b, messages):
        found = told(messages)
        if not found["tokens", 0]:
            return
        bucket = Bucket([body for _, body in found.pop(("tokens", 0))], hot)
        part = (bucket.contexts % U(buckets)).astype(np.int64)
        seats, tables = np.zeros(len(part), np.int64), [np.zeros(len(part), np.int64) for _ in numbers]
        for p, (customers, *more) in found["reply", 0]:
            mine = part == p
            seats[mine] = full(customers)
            for own, t in zip(tables, more, strict=True):
                own[mine] = full(t)
        samples = [{"t": full(x["dishes"][0]), "rt": full(x["words"][0])} for x in (pickle.loads(found["seats", k][0][1]) for k in numbers)]
        docs_, sums = scored(bucket, samples, (seats, tables), model)
        yield from ((p, (b, pickle.dumps((d, s[:2], [slim(x) for x in s[2:]]), 5))) for p, d, s in _by_document(docs_, sums, buckets))

    split = beside(tokens, *sampled.values(), replies(sampled, True)).mapPartitionsWithIndex(finish)
    merged = split.partitionBy(buckets, int).mapPartitions(_merged)
    sums = spark.createDataFrame(merged, "sums binary").mapInArrow(_unpack, "key long, score double, plus double, n_tokens int, n_known int, ends int")
    names = ["score", "plus", "n_tokens", "n_known", "ends"]
    sums = sums.withColumnRenamed("key", "s_key")
    both = rows.drop("text").join(sums, F.col("key") == F.col("s_key"))
    each = {c: F.col(c) / F.col("ends") for c in names}  # every row has one end, so `ends` counts equal rows
    return both.select(
        "doc_id",
        "held_out",
        F.round(each["n_tokens"]).cast("long").alias("n_tokens"),
        F.round(each["n_known"]).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (each["plus"] - each["n_tokens"] * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        each["score"].alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, perplexity: ten to the mean of minus the tokens' log10 probabilities."""
    mean = F.try_divide(F.sum("score"), F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -mean).alias("perplexity"))


def op9_language_model(spark, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD
    return score_texts(table(spark, sf_dir, "documents"), held)
