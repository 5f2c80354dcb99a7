"""Seatings of the language model: every customer of a dish has a turn, however many there are."""

import numpy as np
import pyarrow as pa
import pytest

from boundlab.llm import language_model as lm


def plain(sizes, want, turns, a, d, draw):
    """One dish, one customer after another; draw(turn of coming or going) or draw(turn of changing)."""
    sizes = list(sizes)

    def sit(x):
        held = np.cumsum([max(s - d, 0) for s in sizes]) if sizes else np.zeros(1)
        at = x * (held[-1] + a)
        if at < a or held[-1] <= 0:
            sizes.append(1)
        else:
            sizes[int(np.argmax(held > at - a))] += 1

    def leave(x):
        held = np.cumsum(sizes)
        sizes[int(np.argmax(held > x * held[-1]))] -= 1

    have = sum(sizes)
    for j in range(abs(want - have)):
        leave(draw(1 << 20 | j)) if want < have else sit(draw(1 << 20 | j))
    for j in range(turns):
        leave(draw(2 * j))
        sit(draw(2 * j + 1))
    return [s for s in sizes if s]


def test_every_customer_has_a_turn():
    """Dishes beyond 16 turns and 64 customers, against the plain sampler with the same random numbers."""
    rng = np.random.default_rng(3)
    c = np.r_[2, 2, 3, rng.integers(2, lm.LONG + 1, 40), 17, 100, lm.LONG]
    a, d, key = rng.uniform(0.05, 40, len(c)), 0.55, lm.mixed(np.arange(len(c)))
    draw = lambda i, sweep: lambda turn: float(lm.uniform(key[i : i + 1], sweep, turn)[0])
    t, sizes = lm.first_seats(c, a, d, key)
    for i, own in enumerate(np.split(sizes, np.cumsum(t)[:-1])):
        first = draw(i, 0)
        assert own.tolist() == plain([1], c[i], 0, a[i], d, lambda turn, first=first: first((turn & 0xFFFFF) + 1))
    for sweep in (1, 2):
        want = np.clip(c + rng.integers(-3, 4, len(c)), 2, lm.LONG)
        before = np.split(sizes, np.cumsum(t)[:-1])
        t, sizes = lm.gibbs(t, sizes, c, want, a, d, key, sweep)
        for i, own in enumerate(np.split(sizes, np.cumsum(t)[:-1])):
            assert sorted(own.tolist()) == sorted(plain(before[i], want[i], want[i], a[i], d, draw(i, sweep)))
        c = want


@pytest.mark.parametrize(("customers", "a", "d"), [(90, 2.0, 0.5), (300, 2.0, 0.5), (700, 12.0, 0.8)])
def test_sweeps_reach_the_exact_law_of_tables(customers, a, d):
    """From one table, sweeps lead to tables by a^t S(c, t), S the Stirling numbers for the discount."""
    law = np.full(customers + 1, -np.inf)
    law[1], t = 0.0, np.arange(customers + 1)
    for n in range(1, customers):
        with np.errstate(invalid="ignore", divide="ignore"):
            law = np.logaddexp(np.r_[-np.inf, law[:-1]], law + np.log(np.maximum(n - d * t, 0)))
    law += t * np.log(a)
    law = np.exp(law - law.max())
    mean = (law * t).sum() / law.sum()
    spread = np.sqrt((law * (t - mean) ** 2).sum() / law.sum())
    dishes = 100
    c, weight, key = np.full(dishes, customers), np.full(dishes, a), lm.mixed(np.arange(dishes))
    tables, sizes = np.ones(dishes, int), c
    for sweep in range(1, 26):
        tables, sizes = lm.gibbs(tables, sizes, c, c, weight, d, key, sweep)
    assert abs(tables.mean() - mean) < 5 * spread / np.sqrt(dishes)
    assert 0.7 < tables.std() / spread < 1.3
    assert np.array_equal(np.bincount(np.repeat(np.arange(dishes), tables), sizes), c)


def test_hot_words_are_seated_like_others(spark):
    """A word's unigram dish is the same in a task of its own."""
    rng = np.random.default_rng(5)
    hot, c = lm.mixed(np.arange(9)), np.r_[rng.integers(1, 90, 7), 400, 0]
    want, weight = np.r_[c[:-2] + 2, 390, 0], np.full(9, 0.8)
    first = lm.hot_sweep(spark, hot, None, np.zeros(9, int), c, weight, 0.6, 0)
    again = lm.hot_sweep(spark, hot, first, c, want, weight, 0.6, 1)
    t, sizes = lm.first_seats(c, weight, 0.6, lm.mixed(hot))
    assert [x.tolist() for x in first] == [x.tolist() for x in np.split(sizes, np.cumsum(t)[:-1])]
    t, sizes = lm.gibbs(t, sizes, c, want, weight, 0.6, lm.mixed(hot), 1)
    assert [x.tolist() for x in again] == [x.tolist() for x in np.split(sizes, np.cumsum(t)[:-1])]
    assert lm.hot_sweep(spark, hot[:0], None, c[:0], c[:0], weight[:0], 0.6, 0) == []


def test_turns_are_drawn_for_many_dishes_and_turns_at_once(monkeypatch):
    """The calls for draws of a sweep don't follow the turns: before, two a turn and piece, and some a turn of a large dish."""
    rng = np.random.default_rng(7)
    c = np.r_[np.full(60, 100), np.full(3, 500)]
    a, key, calls = rng.uniform(0.5, 3, len(c)), lm.mixed(np.arange(len(c))), []
    plainly = lm.uniform
    monkeypatch.setattr(lm, "uniform", lambda *x: calls.append(1) or plainly(*x))
    t, sizes = lm.first_seats(c, a, 0.6, key)
    lm.gibbs(t, sizes, c, c, a, 0.6, key, 1)
    assert len(calls) < 40


def test_a_large_dish_comes_one_by_one():
    """The tables of a dish beyond LONG whose customers came alone, by the law of their number step by step."""
    customers, a, d, dishes = lm.LONG + 90, 3.0, 0.6, 300
    law = np.zeros(customers + 1)
    law[1], t = 1.0, np.arange(customers + 1)
    for n in range(1, customers):
        new = a / np.maximum(n - d * t + a, a)  # no more tables than customers
        law = law * (1 - new) + np.r_[0, (law * new)[:-1]]
    mean = (law * t).sum()
    spread = np.sqrt((law * (t - mean) ** 2).sum())
    c, key = np.full(dishes, customers), lm.mixed(np.arange(dishes))
    tables, sizes = lm.first_seats(c, np.full(dishes, a), d, key)
    assert abs(tables.mean() - mean) < 5 * spread / np.sqrt(dishes) and 0.8 < tables.std() / spread < 1.2
    fewer = c - 40
    tables, sizes = lm.gibbs(tables, sizes, c, fewer, np.full(dishes, a), d, key, 1)
    assert np.array_equal(np.bincount(np.repeat(np.arange(dishes), tables), sizes), fewer)


def test_token_messages_are_tight():
    """A batch's hashes are sent as differences, which the shuffle's compression shortens, and come back as they were."""
    words = lm.mixed(np.arange(9000))
    hashes = np.sort(np.r_[words, lm.U(0), lm.U(2**64 - 1)])
    assert np.array_equal(lm.apart(lm.close(hashes)), hashes) and len(lm.apart(lm.close(hashes[:0]))) == 0
    rng = np.random.default_rng(1)
    rows = [{"key": i, "train": True, "text": " ".join(f"w{k}" for k in rng.integers(0, 40_000, 200)).encode()} for i in range(1500)]
    sent = [m[3] for _, m in lm.packer(8, words[:0])(rows)]
    tokens = 201 * len(rows)
    assert sum(len(pa.compress(m, codec="lz4", asbytes=True)) for m in sent) < 9.3 * tokens  # 9.8 as plain hashes
    every = [lm.token_hashes(r["text"]) for r in rows]
    pairs = np.unique(np.concatenate([lm.dish_key(h, lm.before(h)) for h in every]), return_counts=True)
    parts = [lm.Bucket([m], words[:0]) for m in sent]
    assert sum(len(b.cell) for b in parts) == tokens
    got = np.concatenate([np.repeat(lm.dish_key(b.words[b.word], b.contexts[b.context]), b.count) for b in parts])
    again = np.unique(got, return_counts=True)
    assert np.array_equal(pairs[0], again[0]) and np.array_equal(pairs[1], again[1])
