"""Best-fit packing, periodic runs and spelling variants against brute force on small fixtures."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyforge.llm import best_fit, periodic_runs, registry, spelling
from tests.llm.test_llm_operators import corpus
from tests.test_queries import DIR

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    r = corpus(seed=8, n=70)
    r += [(r[5][0], r[5][1], "en", "s1", 3), (None, "null key null key", "en", None, 1), (None, None, None, None, None)]
    return r


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for clash in ("piece", "rank", "length", "worker", "k", "n", "word", "runs", "h", "w", "a", "best"):
        df = df.selectExpr("*", f"'x' AS {clash}")
    return df.cache()


# --- best-fit packing


def lengths_of(texts, capacity):
    exact = best_fit.Encoder()
    out = []
    for t in texts:
        n = len(exact.exact(t or "")) // 4 + 1
        out += [capacity] * (n // capacity) + ([n % capacity] if n % capacity else [])
    return out


def first_best_fit(lengths, capacity):
    """Bins of a best fit by decreasing length, one piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits)[1]] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("capacity", [4096, 100])
def test_pieces_give_back_every_document(docs, rows, capacity):
    out = best_fit.pack(docs, capacity=capacity, keep_ids=True).collect()
    encode = best_fit.Encoder()
    got, bins = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.start == r.piece * capacity
        got[r.doc_id].append((r.piece, tuple(r.ids)))
        bins[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for d, t, *_ in rows:
        ids = [*np.frombuffer(encode.exact(t or ""), "<u4").tolist(), 1]
        want[d] += [(k, tuple(ids[k * capacity : (k + 1) * capacity])) for k in range(-(-len(ids) // capacity))]
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) <= first_best_fit(lengths_of([r[1] for r in rows], capacity), capacity)


def test_plans_pair_large_pieces_and_fill_gaps():
    r = random.Random(2)
    for capacity in (30, 64, 100):
        for _ in range(200):
            lengths = [r.choice([r.randint(1, capacity), r.randint(1, capacity // 3), r.randint(capacity // 3, capacity)]) for _ in range(r.randint(0, 80))]
            plan, bins = best_fit.Plan(Counter(lengths), capacity), defaultdict(list)
            for n, _, count, per, b, offset in plan.rows:
                for k in range(count):
                    bins[b + k // per].append((offset + k % per * n, n))
            assert sorted(n for v in bins.values() for _, n in v) == sorted(lengths) and len(bins) == plan.bins
            for v in bins.values():
                ends = [o + n for o, n in sorted(v)]
                assert [o for o, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= capacity
                assert sum(3 * n > capacity for _, n in v) <= 2
            assert plan.bins == first_best_fit(lengths, capacity)


def test_plan_is_bounded_by_the_capacity():
    plan = best_fit.Plan({n: 10**9 + n for n in range(1, 4097)})
    assert len(plan.rows) < 5 * 4096
    total = sum(n * (10**9 + n) for n in range(1, 4097))
    assert sum(n * c for n, _, c, *_ in plan.rows) == total and plan.bins >= total // 4096


def test_words_and_whole_texts_get_the_same_ids():
    fast = best_fit.Encoder()
    r = random.Random(5)
    texts = [f"x{c}y {c} {c}{c}'s a{c}1 don{c}t" for c in best_fit.PLAIN]
    texts += ["".join(r.choice(best_fit.PLAIN) for _ in range(r.randint(0, 200))) for _ in range(500)]
    texts += ["", " ", "it's we'RE 'S 's's I'll'd", "a" * 500, "<|endoftext|> x <|startoftext|>", "<|x|>", "naïve Ünder 12²½ ªº", "漢字 tail", "é İ", "\x85\xa0"]
    assert fast(texts) == [fast.exact(t) for t in texts]


def test_best_fit_of_nothing(spark, docs):
    assert best_fit.pack(docs.limit(0)).count() == 0


# --- periodic runs


def brute_runs(w, shortest=6, repeats=4):
    out = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            x = w[i : j + q]
            if j > i and len(x) >= max(shortest, repeats * q) and all(x[p:] != x[:-p] for p in range(1, q)):
                out.append((i, len(x), q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(r):
    w = []
    for _ in range(r.randint(0, 8)):
        if r.random() < 0.4:
            w += [r.choice("abc") for _ in range(r.randint(1, 6))]
        else:
            p = [r.choice("abc") for _ in range(r.randint(1, 7))]
            w += (p * 8)[: r.randint(1, 7 * len(p))]
    return w


def test_runs_match_brute_force():
    r = random.Random(1)
    for _ in range(1500):
        w = periodic(r)
        shortest, repeats = r.choice([(6, 4), (6, 4), (1, 2), (12, 3)])
        ids = periodic_runs.numbers([x.encode() for x in w])
        assert periodic_runs.find(ids, shortest, repeats, r.choice([2, 5, None])) == brute_runs(w, shortest, repeats), w


@pytest.mark.parametrize("frequent", [2, 10, None])
def test_matches_of_lags_are_exact(frequent):
    ids = np.minimum(np.random.default_rng(4).zipf(1.3, 3000), 40) - 1
    got = periodic_runs.lag_matches(ids, 750, frequent)
    assert got.tolist() == [0] + [int((ids[q:] == ids[:-q]).sum()) for q in range(1, 751)]


def test_long_texts_of_few_words_end():
    assert periodic_runs.find(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic_runs.find(np.arange(200_000) % 997) == [(0, 200_000, 997)]


def expected_runs(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w) if n < 500 or h % 10 == 0 else []
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    s, m, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (doc_id, len(runs), s, m, q, m * 1000 // q if runs else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query(spark, tmp_path):
    r = random.Random(3)
    seps = [" ", "\t", "\n", "  ", "\x0b", "\r\n"]
    rows = [(i, "".join(x + r.choice(seps) for x in periodic(r) or ["z"])) for i in range(200)]
    rows += [(i, " ".join(f"w{r.randint(0, 400)}" for _ in range(300))) for i in range(200, 260)] + [(300, None), (301, ""), (302, " \n"), (None, "a a a a a a"), (303, "é ü é ü é ü é ü"), (303, "é ü é ü é ü é ü"), (304, "a b " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS runs", "3 AS w").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, out.collect()), key=key) == sorted((expected_runs(*x) for x in rows), key=key)
    planted = [x for x in rows if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 10 == 0]
    assert len(planted) > 15


def test_runs_of_nothing_and_copies(spark, docs):
    assert periodic_runs.runs(docs.limit(0)).count() == 0
    assert periodic_runs.runs(docs).count() == docs.count()


# --- spelling variants


def brute_variants(counts, least_length=5, least_count=3, lead=2):
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        found = sorted((-m, v) for v, m in words.items() if v != w and near(w, v))
        if found and -found[0][0] >= lead * n:
            form[w] = found[0][1]
        out[w] = (n, len(found))
    rows = set()
    for w, (n, k) in out.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n, k, words.get(form.get(w))))
    return rows


def test_variants_match_brute_force(spark):
    r = random.Random(6)
    for seed, letters in enumerate(["ab", "aàb", "abcdefgh"]):
        words = {"".join(r.choice(letters) for _ in range(r.randint(3, 8))): r.choice([1, 2, 3, 3, 5, 9, 20, 64, 200]) for _ in range(350)}
        rows = [(w, n, "x") for w, n in words.items()] + [(None, 9, "x"), ("nulls", None, "x"), ("abbab", 4, "again")]
        words["abbab"] = words.get("abbab", 0) + 4
        df = spark.createDataFrame(rows, "word string, n long, rank string").repartition(3)
        out = spelling.variants(df)
        assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        got = [tuple(x) for x in out.collect()]
        assert len(got) == len(set(got)) and set(got) == brute_variants(words), seed


def test_long_chains_and_long_words(spark):
    chain = {"a" * (5 + i): 3 * 2**i for i in range(12)}  # each the form of the one before
    long_ = {"b" * 3000: 3, "b" * 2999 + "c": 7, "b" * 3001: 40, "b" * 1500 + "x" + "b" * 1500: 100}
    got = {tuple(x) for x in spelling.variants(spark.createDataFrame(list((chain | long_).items()), "word string, n long")).collect()}
    assert got == brute_variants(chain | long_)
    assert {x[2] for x in got if x[0][0] == "a"} == {"a" * 16}


def test_word_counts(spark, docs, rows):
    want = Counter(w for _, t, *_ in rows for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate({c: c + 32 for c in range(65, 91)})))
    assert {r.word: r.n for r in spelling.count_words(docs).collect()} == want
    altered = Counter()
    for d, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{d}:{w}".encode())
            i = h % len(w)
            altered[w[:i] + w[i + 1 :] if h % 97 == 0 else w] += 1
    got = {r.word: r.n for r in spelling.count_words(docs, alter=spelling.drop_letter).collect()}
    assert {w: n for w, n in got.items() if w} == {w: n for w, n in altered.items() if w and w != "None"} or got.keys() ^ altered.keys() <= {""}


def test_group_keys_tell_words_apart():
    words = ["abcde", "abcd", "abced", "aabcd", "bacde", "aaaaa", "aaaa", "é" * 5, "éa" * 3]
    which, kind, a, b = spelling.group_keys(words, 4)
    of = defaultdict(set)
    for w, k, x, y in zip(which.tolist(), kind.tolist(), a.tolist(), b.tolist()):
        of[words[w], k].add((x, y))
    own = {w: next(iter(of[w, 0])) for w in words}
    assert len(set(own.values())) == len(words)
    for w in words:
        assert len(of[w, 2]) == len(w)
        assert {v for v in words if own[v] in of[w, 1]} == {v for v in words if len(w) > 4 and any(w[:i] + w[i + 1 :] == v for i in range(len(w)))}
        assert len(of[w, 1]) == (len({w[:i] + w[i + 1 :] for i in range(len(w))}) if len(w) > 4 else 0)


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


# --- the registered queries on the smallest tables


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_best_fit_query(spark):
    out = registry.QUERIES["op11_best_fit"](spark, DIR)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    rows = out.collect()
    lengths = lengths_of(texts, 4096)
    assert sorted(r.length for r in rows) == sorted(lengths)
    assert len({r.sequence_id for r in rows}) == first_best_fit(lengths, 4096)
