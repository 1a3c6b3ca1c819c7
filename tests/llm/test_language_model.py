"""The language model against seating customers one at a time, and its sums of probabilities."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyforge.llm import pitman_yor, seating

D, A = pitman_yor.DISCOUNT, pitman_yor.STRENGTH


class Restaurant:
    """Table sizes of each dish, with a parent that serves new tables."""

    def __init__(self, parent, rng):
        self.parent, self.rng = parent, rng
        self.sizes = defaultdict(list)
        self.customers = self.tables = 0

    def p(self, dish):
        s = self.sizes.get(dish, ())
        return (sum(s) - D * len(s) + (A + D * self.tables) * self.parent.p(dish)) / (A + self.customers)

    def add(self, dish):
        s = self.sizes[dish]
        new = (A + D * self.tables) * self.parent.p(dish)
        r = self.rng.random() * (new + sum(s) - D * len(s))
        self.customers += 1
        for i, n in enumerate(s):
            r -= n - D
            if r < 0:
                s[i] += 1
                return
        s.append(1)
        self.tables += 1
        self.parent.add(dish)

    def remove(self, dish):
        s = self.sizes[dish]
        i = self.rng.choices(range(len(s)), weights=s)[0]
        s[i] -= 1
        self.customers -= 1
        if not s[i]:
            del s[i]
            self.tables -= 1
            self.parent.remove(dish)


class Uniform:
    def __init__(self, n):
        self.n = n

    def p(self, dish):
        return 1 / self.n

    def add(self, dish):
        pass

    remove = add


def brute_scores(rows, sweeps=120, burn_in=20):
    """Gibbs sampling customer by customer; scores by predictive probabilities averaged over sweeps."""
    rng = random.Random(5)
    tokens = {i: [*t.lower().split(), None] for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    known = {w for i in train for w in tokens[i]}
    root = Restaurant(Uniform(len(known) + 1), rng)
    classes, contexts = {}, {}

    def context(u):
        if u not in contexts:
            kind = u if u is None else u[-2:]
            classes.setdefault(kind, Restaurant(root, rng))
            contexts[u] = Restaurant(classes[kind], rng)
        return contexts[u]

    pairs = [(context(u), w) for i in train for u, w in zip([None, *tokens[i]], tokens[i], strict=False)]
    for r, w in pairs:
        r.add(w)
    sums = defaultdict(float)
    for sweep in range(sweeps):
        for r, w in pairs:
            r.remove(w)
            r.add(w)
        if sweep >= burn_in:
            for i, ts in tokens.items():
                for j, (u, w) in enumerate(zip([None, *ts], ts, strict=False)):
                    sums[i, j] += context(u).p(w) / (sweeps - burn_in)
    return {i: sum(math.log10(sums[i, j]) for j in range(len(ts))) for i, ts in tokens.items()}


def test_scores_match_seating_one_at_a_time(spark):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "kmprst" for b in ("an", "el", "or", "un")]
    follow = {w: rng.sample(vocabulary, 3) for w in vocabulary}
    rows = []
    for i in range(90):
        ws = [rng.choice(vocabulary)]
        for _ in range(rng.randint(3, 25)):
            ws.append(rng.choice(follow.get(ws[-1], vocabulary)) if rng.random() < 0.8 else rng.choice([*vocabulary, f"x{i}"]))
        rows.append((i, " ".join(ws)))
    want = brute_scores(rows)
    got = {r.doc_id: r.score for r in pitman_yor.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), sweeps=12, burn_in=4).collect()}
    off = [got[i] / want[i] - 1 for i in want]
    assert abs(np.mean(off)) < 0.01 and max(map(abs, off)) < 0.05


@pytest.mark.parametrize(("count", "theta"), [(2, 0.5), (5, 1.0), (12, 0.3), (30, 4.0)])
def test_one_draw_is_where_seating_one_at_a_time_ends(count, theta):
    rng = random.Random(3)
    sizes, total, n = [count], 0, 6000
    for _ in range(n):
        for _ in range(count):
            i = rng.choices(range(len(sizes)), weights=sizes)[0]
            sizes[i] -= 1
            sizes = [s for s in sizes if s]
            r = rng.random() * (theta + sum(sizes) - D * len(sizes))
            for i, s in enumerate(sizes):
                r -= s - D
                if r < 0:
                    sizes[i] += 1
                    break
            else:
                sizes.append(1)
        total += len(sizes)
    mean, sd = seating.mean_tables(count, theta, D)
    assert abs(total / n - mean) < 0.1
    drawn = seating.draw_tables(np.full(20000, count), np.full(20000, theta), D, np.arange(20000, dtype=np.uint64), 1)
    assert abs(drawn.mean() - mean) < 0.05 and abs(drawn.std() - sd) < 0.05


@pytest.mark.parametrize("theta", [0.01, 0.5, 3.0, 30.0, 300.0, 3000.0])
def test_many_customers_follow_the_tabulated_law(theta):
    n = seating.EXACT
    mean, sd = seating.mean_tables(n, theta, D)
    drawn = seating._many(np.full(4000, n), np.full(4000, theta), D, seating.uniform(np.arange(4000, dtype=np.uint64), 2))
    assert abs(drawn.mean() - mean) < 0.1 + 0.01 * mean and abs(drawn.std() - sd) < 0.1 + 0.05 * sd


def test_probabilities_sum_to_one():
    """Over the known words and the unknown one, at every level."""
    rng = np.random.default_rng(1)
    word, kind = np.repeat(np.arange(50), 4), np.tile(np.arange(4), 50)
    k = rng.integers(1, 2000, 200)
    tables = np.minimum(k, rng.integers(1, 40, 200))
    customers = np.bincount(word, weights=tables)
    root = np.minimum(customers, rng.integers(1, 9, 50)).astype(int)
    o = {"discount": D, "strength": A, "discount0": pitman_yor.DISCOUNT0, "strength0": pitman_yor.STRENGTH0}
    t = pitman_yor.Totals(pitman_yor._totals(k, tables, root, kind, np.ones(50)))
    up = pitman_yor.Upper(k, tables, root, word, kind, 50, t, o)
    unknown = up.known / (o["strength0"] + t.customers)
    assert abs(up.root_p().sum() + unknown - 1) < 1e-9
    for c in range(4):
        p = up.class_p()[kind == c].sum()
        rest = (A + D * t.laid[c]) * unknown / (A + t.seated[c])
        assert abs(p + rest - 1) < 1e-9


def test_dictionary_round_trip():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    for frequent in (h[::3], h[:0], np.unique(rng.integers(0, 2**63, 50).astype(np.uint64))):
        words = pitman_yor.Dictionary(frequent)
        assert (words.read(*words.write(h)) == h).all() and len(words.read(*words.write(h[:0]))) == 0


def test_gamma_draws():
    x = seating.gamma(np.full(50000, 6.25), np.arange(50000, dtype=np.uint64), 5)
    assert abs(x.mean() - 6.25) < 0.05 and abs(x.var() - 6.25) < 0.2
