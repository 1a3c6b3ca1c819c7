"""Language-model scores by a hierarchical Pitman-Yor model over words.

The restaurant of a context (the preceding word by its 64-bit hash, or the start of a text)
serves words.  Its parent is the restaurant of the context's class (the preceding word's last
two bytes), all classes share one parent, the restaurant of words without context, and the
parent of that is uniform over the known words and one unknown.  Customers of a context are
its tokens in the training texts; each table is a customer of the parent.  In every Gibbs
sweep all customers of a dish leave their restaurant (and its parent) and are seated anew, in
one exact draw (``seating``), given what the others hold.  After the burn-in each sweep gives
a predictive probability

    p(w | u) = (c_uw - d t_uw + (a + d T_u) p(w | class of u)) / (a + C_u)
    p(w | c) = (k_cw - d t_cw + (a + d T_c) p(w)) / (a + K_c)
    p(w)     = (k_w - d0 t_w + (a0 + d0 T) / (V + 1)) / (a0 + K)

and these are averaged.  Dishes of one sweep are drawn side by side, against the totals that
the last sweep left.

Chunks of documents send their distinct (word, context) pairs with training counts to shards
by word; a shard holds all contexts of its words, so it seats all levels alone.  Of the others
it needs totals, which are exact sums over shards before each sweep: of classes and the root
through the driver, of contexts through the shard that owns the context as a word.  Random
numbers are hashes of what they are drawn for, so scores don't depend on the number of shards.
At last each shard answers a chunk's pairs with their averaged probabilities, and the chunk
adds them up over every token of every text.

An owner keeps the first letter of each shard, which names its contexts; later letters are bare
numbers in the same order.  What a shard keeps for itself lies in tables bucketed by shard, so
from sweep to sweep only letters and their answers move.

A dictionary of frequent words (from a few chunks, of bounded size) shortens what is sent; it
changes no result.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import answered, bucketed, buckets_for, chunk_table, one_row_batches, pack_arrays, unpack_arrays, unpack_stream
from .common import WordBatch, discard, mix
from .seating import draw_tables, gamma

CLASSES = 1024  # in the last ten bits of a word's hash
DISCOUNT, STRENGTH = 0.8, 5.0  # of contexts and classes
DISCOUNT0, STRENGTH0 = 0.8, 5.0  # of their parent
SWEEPS, BURN_IN = 6, 2
BYTES, CHUNKS_PER_SHARD = 4 << 20, 3  # larger chunks repeat fewer pairs
FREQUENT, LEARNED_FROM = 1 << 16, 64  # words of the dictionary, and chunks it is drawn up from at most
SEED = 23
_LOW = np.uint64(CLASSES - 1)
_END = np.uint64(0x5BD1E9955BD1E995) & ~_LOW  # of class 0: the start of a text


def owner(words: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each word; it grows with the hash."""
    return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _runs(of: np.ndarray):
    """(value, from, to) of the runs of a sorted array."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]]) if len(of) else np.zeros(0, np.int64)
    return [(int(of[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def small(x: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


class Dictionary:
    """Sets of hashes (distinct, in order) as places of frequent ones and differences of the others."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent

    def write(self, hashes: np.ndarray) -> list[np.ndarray]:
        at = np.minimum(np.searchsorted(self.frequent, hashes), max(0, len(self.frequent) - 1))
        known = self.frequent[at] == hashes if len(self.frequent) else np.zeros(len(hashes), bool)
        return [small(np.diff(at[known], prepend=0)), np.diff(hashes[~known], prepend=np.uint64(0))]

    def read(self, places: np.ndarray, differences: np.ndarray) -> np.ndarray:
        known = self.frequent[np.cumsum(places, dtype=np.int64)] if len(places) else np.zeros(0, np.uint64)
        return np.sort(np.concatenate([known, np.cumsum(differences, dtype=np.uint64)]))


class Tokens:
    """The tokens of a chunk: hash (the class in its last bits) and row of each, end tokens
    included.  The context of a token is the one before it, of the first of a text an end token."""

    def __init__(self, text: pa.Array):
        b = WordBatch(text)
        h = b.hashes(lower=True)
        n = len(h) + b.rows
        ends = b.first[1:] + np.arange(b.rows)  # where the end tokens stand
        is_end = np.zeros(n, bool)
        is_end[ends] = True
        self.row = np.repeat(np.arange(b.rows), b.counts + 1)
        d = b.data
        last = d[b.ends - 1] if len(h) else np.zeros(0, np.uint8)
        former = np.where(b.ends - b.starts > 1, d[np.maximum(b.ends - 2, 0)], 0) if len(h) else last
        fold = lambda x: np.where((x >= 65) & (x <= 90), x + 32, x).astype(np.uint64)
        kind = mix((fold(former) << np.uint64(8)) | fold(last)) % _LOW + np.uint64(1)
        self.hash = np.empty(n, np.uint64)
        self.hash[is_end], self.hash[~is_end] = _END, (h & ~_LOW) | kind
        self.counts = b.counts + 1


class Request:
    """The distinct pairs of a chunk in order of word, then context, with training counts."""

    def __init__(self, tokens: Tokens, training: np.ndarray):
        self.words, word = np.unique(tokens.hash, return_inverse=True)
        n = max(1, len(self.words))
        end = np.searchsorted(self.words, _END)
        key = word.astype(np.int64) * n + np.concatenate([[end], word[:-1]])[: len(word)]
        self.pairs, self.of = np.unique(key, return_inverse=True)
        self.word_of, self.context_of = self.pairs // n, self.pairs % n
        self.count = np.bincount(self.of, weights=training[tokens.row], minlength=len(self.pairs)).astype(np.uint32)
        self.edges = np.searchsorted(self.word_of, np.arange(len(self.words) + 1))


def _chunk(body, folds: int, held: int):
    docs = unpack_stream(body.as_buffer())
    ids = docs.column(0).to_pylist()
    out = np.array([i is not None and zlib.crc32(str(i).encode()) % folds == held for i in ids], bool)
    return docs, Tokens(docs.column(1)), out


def frequent_words(chunks: DataFrame, n: int) -> Dictionary:
    """Of ``n`` chunks LEARNED_FROM at most are asked for their most frequent words."""

    def run(batches):
        for batch in batches:
            for body in batch.column(0):
                h, count = np.unique(Tokens(unpack_stream(body.as_buffer()).column(1)).hash, return_counts=True)
                top = np.argsort(-count, kind="stable")[:FREQUENT]
                yield pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array(count[top])], names=["word", "n"])

    some = chunks
    if n > LEARNED_FROM:  # ids only are sorted; the chunks themselves stay where they are
        some = chunks.where(F.col("chunk").isin([r.chunk for r in chunks.select("chunk").orderBy(F.xxhash64("chunk")).limit(LEARNED_FROM).collect()]))
    counts = one_row_batches(some.select("body"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").toArrow()
    return Dictionary(np.sort(top.column(0).to_numpy().view(np.uint64)))


def _send(words: Dictionary, shards: int, folds: int, held: int):
    def run(batches):
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, tokens, out = _chunk(body, folds, held)
                r = Request(tokens, ~out)
                rows = []
                for s, a, b in _runs(owner(r.words, shards)):
                    x, y = r.edges[a], r.edges[b]
                    u, at = np.unique(r.context_of[x:y], return_inverse=True)
                    blob = pack_arrays(*words.write(r.words[a:b]), small(np.diff(r.edges[a : b + 1])), *words.write(r.words[u]), small(at), small(r.count[x:y]))
                    rows.append((s, chunk, "asked", blob, None))
                if rows:
                    yield from _table(rows, _ASKED).to_batches()

    return run


class Totals:
    """Sums over all shards: tokens and words known, tables and customers of the root and of each class."""

    def __init__(self, x: np.ndarray):
        self.tokens, self.known, self.root, self.customers = x[:4]
        self.laid, self.seated = x[4 : 4 + CLASSES], x[4 + CLASSES :]


def _totals(k, tables, root, kind, tokens) -> np.ndarray:
    """What Totals takes, of one shard; ``tokens``: of each word."""
    per = lambda x: np.bincount(kind, weights=x, minlength=CLASSES)
    return np.concatenate([[tokens.sum(), (tokens > 0).sum(), root.sum(), tables.sum()], per(tables), per(k)])


class Pairs:
    """The pairs of a shard, from what chunks sent it: words, contexts, and pairs of word and class."""

    def __init__(self, blobs: list, words: Dictionary):
        parts = [unpack_arrays(b.as_buffer()) for b in blobs]
        heard = [words.read(*p[:2]) for p in parts]
        around = [words.read(*p[3:5]) for p in parts]
        self.words, self.at = np.unique(np.concatenate(heard), return_inverse=True)
        self.contexts, at = np.unique(np.concatenate(around), return_inverse=True)
        per_word = np.concatenate([p[2] for p in parts]).astype(np.int64)
        first = np.cumsum([0, *map(len, around)])
        context = at[np.concatenate([p[5].astype(np.int64) + f for p, f in zip(parts, first, strict=False)])]
        self.sizes = [(len(h), len(p[5])) for h, p in zip(heard, parts, strict=True)]
        key, self.of = np.unique(np.repeat(self.at, per_word).astype(np.int64) * len(self.contexts) + context, return_inverse=True)
        self.count = np.bincount(self.of, weights=np.concatenate([p[6] for p in parts]), minlength=len(key)).astype(np.int64)
        self.word, self.context = key // len(self.contexts), key % len(self.contexts)
        mids, self.mid = np.unique(self.word * CLASSES + (self.contexts & _LOW).astype(np.int64)[self.context], return_inverse=True)
        self.mid_word, self.mid_kind = mids // CLASSES, mids % CLASSES
        self.tokens = np.bincount(self.word, weights=self.count, minlength=len(self.words)).astype(np.int64)
        self.many = np.flatnonzero(self.count > 1)
        self.single = np.bincount(self.mid, weights=self.count == 1, minlength=len(mids)).astype(np.int64)

    def of_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=x, minlength=len(self.contexts)).astype(np.int64)


class Upper:
    """The restaurants of classes and the root, as far as they concern the words of a shard."""

    def __init__(self, k, tables, root, mid_word, mid_kind, n_words: int, t: Totals, o: dict):
        self.k, self.tables, self.root, self.word, self.kind, self.t, self.o = k, tables, root, mid_word, mid_kind, t, o
        self.customers = np.bincount(mid_word, weights=tables, minlength=n_words)
        self.known = (o["strength0"] + o["discount0"] * t.root) / (t.known + 1)

    def root_p(self, own=None) -> np.ndarray:
        """Of each word; or with ``own`` tables of each pair of word and class away, of each pair."""
        k, tables, n = self.customers, self.root, self.t.customers
        if own is not None:
            k, tables = k[self.word], tables[self.word]
            k, tables, n = k - own, tables * (k - own) / np.maximum(k, 1), n - own
        return (k - self.o["discount0"] * tables + self.known) / (self.o["strength0"] + n)

    def class_p(self, pairs=slice(None), own=0) -> np.ndarray:
        """Of pairs of word and class; ``own``: customers that are away, and their share of tables."""
        k, tables, kind = self.k[pairs], self.tables[pairs], self.kind[pairs]
        left = k - own
        tables = tables * left / np.maximum(k, 1)
        high = (self.o["strength"] + self.o["discount"] * self.t.laid[kind]) * self.root_p()[self.word[pairs]]
        return (left - self.o["discount"] * tables + high) / (self.o["strength"] + self.t.seated[kind] - own)


_MAIL = "shard long, sender long, tag string, blob binary, stats array<double>"
_ASKED = "shard long, chunk long, tag string, blob binary, stats array<double>"
_KEPT = "shard long, receiver long, tag string, blob binary, stats array<double>"  # by the shard that wrote it


def _table(rows: list, names: str) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.float64()))
    names = [x.split()[0] for x in names.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def _letters(*tables: pa.Table) -> dict:
    """By tag, the contents in order of sender."""
    out: dict[str, list] = {}
    rows = [r for t in tables for r in zip(t.column(1).to_pylist(), t.column("tag").to_pylist(), t.column("blob"), strict=True)]
    for sender, tag, blob in sorted(rows, key=lambda r: r[:2]):
        if blob.is_valid:
            out.setdefault(tag, []).append((sender, unpack_arrays(blob.as_buffer())))
    return out


def _open(words: Dictionary, shards: int):
    """The first state of a shard: each pair has one table.  Owners of contexts hear of tables that
    stay, customers, and pairs that will be seated."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        order = np.argsort(table.column("chunk").to_numpy())
        p = Pairs([table.column("blob")[int(i)] for i in order], words)
        here, at = np.unique(p.context[p.many], return_inverse=True)
        state = pack_arrays(*words.write(p.contexts[here]), small(at), small(p.mid[p.many]), small(p.count[p.many]), small(p.single), small(p.mid_word), p.mid_kind.astype(np.uint16), small(p.tokens), *words.write(p.words))
        k = p.single + np.bincount(p.mid[p.many], minlength=len(p.mid_word))
        tables, root = (k > 0).astype(np.int64), (p.tokens > 0).astype(np.int64)
        rows = [(shard, shard, "state", state, None), (-1, shard, "stats", None, _totals(k, tables, root, p.mid_kind, p.tokens))]
        numbers = [p.of_context(x) for x in (p.count == 1, p.count, p.count > 1)]
        for s, a, b in _runs(owner(p.contexts, shards)):
            blob = pack_arrays(*words.write(p.contexts[a:b]), *[small(x[a:b]) for x in numbers])
            rows.append((s, shard, "opened", blob, None))
        return _table(rows, _MAIL)

    return run


class Address:
    """What the first letters to an owner name: the distinct contexts, and where those of each sender are."""

    def __init__(self, opened: list, words: Dictionary):
        self.opened, lists = opened, [words.read(*x[:2]) for _, x in opened]
        self.distinct, at = np.unique(np.concatenate(lists), return_inverse=True)
        self.at = dict(zip([s for s, _ in opened], np.split(at, np.cumsum([len(c) for c in lists])[:-1]), strict=True))
        self.seated = {s: self.at[s][x[4] > 0] for s, x in opened}

    def first(self, i: int) -> np.ndarray:
        """Sums of the numbers that the first letters bring."""
        out = np.zeros(len(self.distinct), np.int64)
        for s, x in self.opened:
            out[self.at[s]] += x[i].astype(np.int64)
        return out

    def later(self, letters: list) -> np.ndarray:
        """Sums of later letters: one number for each context of which the sender has a pair to seat."""
        out = np.zeros(len(self.distinct), np.int64)
        for s, x in letters:
            out[self.seated[s]] += x[0].astype(np.int64)
        return out


def _first_sums(words: Dictionary):
    """The sums of tables that stay and of pairs that will be seated, to all that have a pair to seat."""

    def run(table: pa.Table) -> pa.Table:
        shard, a = table.column("shard")[0].as_py(), Address(_letters(table)["opened"], words)
        single, seated = a.first(2), a.first(4)
        return _table([(s, shard, "opened sums", pack_arrays(small(single[at]), small(seated[at])), None) for s, at in a.seated.items() if len(at)], _MAIL)

    return run


def _sums(words: Dictionary, tag: str):
    """The sums of the tables laid in a sweep, to the same."""

    def run(opened: pa.Table, laid: pa.Table) -> pa.Table:
        if not laid.num_rows:
            return _table([], _MAIL)
        shard, a = opened.column("shard")[0].as_py(), Address(_letters(opened)["opened"], words)
        total = a.later(_letters(laid)[tag])
        return _table([(s, shard, f"{tag} sums", pack_arrays(small(total[at])), None) for s, at in a.seated.items() if len(at)], _MAIL)

    return run


def _sweep(words: Dictionary, shards: int, sweep: int, g: np.ndarray, o: dict):
    """All pairs of a shard seated anew, then its classes, then the root."""

    def run(state: pa.Table, mail: pa.Table) -> pa.Table:
        shard = state.column("shard")[0].as_py()
        letters = _letters(state, mail)
        x = letters["state"][0][1]
        contexts, names = words.read(*x[:2]), words.read(*x[9:11])
        at, mid, count, single, word, kind, tokens = (y.astype(np.int64) for y in x[2:9])
        opened = letters.get("opened sums", [])
        joined = lambda letters, i: np.concatenate([x[i] for _, x in letters]).astype(np.float64) if letters else np.zeros(0)
        if sweep:
            many, tables, root = (y.astype(np.int64) for y in letters[f"tables {sweep - 1}"][0][1])
            laid = joined(opened, 0) + joined(letters.get(f"laid {sweep - 1} sums", []), 0)
        else:
            many, laid = np.ones(len(count), np.int64), joined(opened, 0) + joined(opened, 1)
            tables, root = None, (tokens > 0).astype(np.int64)
        k = single + np.bincount(mid, weights=many, minlength=len(word)).astype(np.int64)
        tables = (k > 0).astype(np.int64) if tables is None else tables
        t, d, d0, a = Totals(g), o["discount"], o["discount0"], o["strength"]
        salt = (o["seed"] * 1000 + sweep) * 16
        upper = Upper(k, tables, root, word, kind, len(names), t, o)
        drawn = lambda shape, keys, j: gamma(shape, keys, salt + j)

        free = drawn(a / d + laid, mix(contexts), 1)
        many = draw_tables(count, d * free[at] * upper.class_p(mid, many), d, mix(names[word[mid]]) ^ mix(contexts[at] + np.uint64(1)), salt + 4)
        k = single + np.bincount(mid, weights=many, minlength=len(word)).astype(np.int64)
        free = drawn(a / d + t.laid, np.arange(CLASSES, dtype=np.uint64), 5)
        tables = draw_tables(k, d * free[kind] * upper.root_p(tables), d, mix(names[word]) ^ (kind.astype(np.uint64) + np.uint64(1)), salt + 8)
        customers = np.bincount(word, weights=tables, minlength=len(names)).astype(np.int64)
        free = drawn(np.array([o["strength0"] / d0 + t.root]), np.zeros(1, np.uint64), 9)
        root = draw_tables(customers, np.full(len(names), d0 * free[0] / (t.known + 1)), d0, names, salt + 12)

        rows = [(shard, shard, f"tables {sweep}", pack_arrays(small(many), small(tables), small(root)), None), (shard, -1, "stats", None, _totals(k, tables, root, kind, tokens))]
        per = np.bincount(at, weights=many, minlength=len(contexts)).astype(np.int64)
        rows += [(shard, s, f"laid {sweep}", pack_arrays(small(per[x:y])), None) for s, x, y in _runs(owner(contexts, shards))]
        return _table(rows, _KEPT)

    return run


def _reply(words: Dictionary, kept: list[int]):
    """An owner's answer to all that asked about contexts: customers, and tables after each kept sweep."""

    def run(opened: pa.Table, laid: pa.Table) -> pa.Table:
        shard, letters = opened.column("shard")[0].as_py(), _letters(laid)
        a = Address(_letters(opened)["opened"], words)
        numbers = [a.first(3), *[a.first(2) + a.later(letters.get(f"laid {sweep}", [])) for sweep in kept]]
        return _table([(s, shard, "contexts", pack_arrays(*[small(x[at]) for x in numbers]), None) for s, at in a.at.items()], _MAIL)

    return run


def _rounded(p: np.ndarray) -> np.ndarray:
    """Single precision with 16 bits of mantissa: a relative error of 8e-6."""
    x = p.astype(np.float32).view(np.uint32)
    return ((x + np.uint32(64)) & np.uint32(0xFFFFFF80)).view(np.float32)


def _answer(words: Dictionary, kept: list[int], means: list[np.ndarray], o: dict):
    """Answers to the chunks: training count of each word, averaged probability of each pair."""

    def run(held: pa.Table, mail: pa.Table) -> pa.Table:
        asked = held.filter(pc.equal(held.column("tag"), "asked"))
        shard = asked.column("shard")[0].as_py()
        chunk = asked.column(1)
        order = np.argsort(chunk.to_numpy())
        p = Pairs([asked.column("blob")[int(i)] for i in order], words)
        letters = _letters(held.filter(pc.not_equal(held.column("tag"), "asked")), mail)
        d, a = o["discount"], o["strength"]
        numbers = [np.concatenate([x[i] for _, x in letters["contexts"]]).astype(np.float64) for i in range(1 + len(kept))]
        customers = numbers[0][p.context]
        total = np.zeros(len(p.count))
        for i, (sweep, g) in enumerate(zip(kept, means, strict=True)):
            many, tables, root = (x.astype(np.int64) for x in letters[f"tables {sweep}"][0][1])
            own = (p.count > 0).astype(np.int64)
            own[p.many] = many
            k = np.bincount(p.mid, weights=own, minlength=len(p.mid_word))
            parent = Upper(k, tables, root, p.mid_word, p.mid_kind, len(p.words), Totals(g), o).class_p()
            total += (p.count - d * own + (a + d * numbers[1 + i][p.context]) * parent[p.mid]) / (a + customers)
        mean = _rounded(total / len(kept))
        out, w, q = [], 0, 0
        for nw, np_ in p.sizes:
            out.append(pack_arrays(np.array([shard]), small(p.tokens[p.at[w : w + nw]]), mean[p.of[q : q + np_]]))
            w, q = w + nw, q + np_
        return pa.table({"chunk": chunk.take(pa.array(order)), "answer": pa.array(out, pa.binary())})

    return run


def _score(shards: int, folds: int, held: int, g: np.ndarray):
    n, v = g[:2]

    def run(batches):
        for batch in batches:
            for body, answers in zip(batch.column(1), batch.column(2), strict=True):
                docs, tokens, out = _chunk(body, folds, held)
                r = Request(tokens, ~out)
                got = {int(x[0][0]): x for x in (unpack_arrays(y.as_buffer()) for y in answers.values)}
                parts = [got[s] for s, _, _ in _runs(owner(r.words, shards))]
                total, p = (np.concatenate([x[i] for x in parts]).astype(np.float64) for i in (1, 2))
                word = r.word_of[r.of]
                add = lambda x: np.bincount(tokens.row, weights=x, minlength=docs.num_rows)  # noqa: B023, E731
                score = add(np.log10(p)[r.of])
                base = add((np.log10(total + 1) - math.log10(n + v + 1))[word])
                known = add((total > 0)[word]).astype(np.int64)
                cols = [docs.column(0), pa.array(out), pa.array(tokens.counts.astype(np.int64)), pa.array(known), pa.array(np.full(docs.num_rows, int(n))), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / tokens.counts, 300))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return run


def _summed(mail: DataFrame) -> np.ndarray:
    out = np.zeros(4 + 2 * CLASSES)
    for r in mail.where("tag = 'stats'").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("x")).collect():
        out[r[0]] = r[1]
    return out


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, key: str = "doc_id", text: str = "text", discount: float = DISCOUNT, strength: float = STRENGTH, discount0: float = DISCOUNT0, strength0: float = STRENGTH0, sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, perplexity.

    Held out are ids whose CRC-32 (of their text) leaves ``held`` modulo ``folds``; all other
    rows are learned from, each as often as it occurs, null ids too.  Null and empty texts are
    one end token.  Without any training token every probability is that of the unknown word.
    Other columns, whatever their names, play no part.  An empty table gives no rows.  Strengths
    are at least their discounts; 0 < discounts < 1.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    o = {"discount": discount, "strength": strength, "discount0": discount0, "strength0": strength0, "seed": seed}
    chunks = chunk_table(docs, "scored", BYTES)
    n, buckets = chunks.count(), buckets_for(docs)
    shards = max(1, math.ceil(n / CHUNKS_PER_SHARD))
    words = frequent_words(chunks, n)
    # tables bucketed by shard are read several times and never shuffled, nor are their unions
    sent = bucketed(one_row_batches(chunks, _send(words, shards, folds, held), _ASKED), "asked", "shard", buckets)
    begun = bucketed(sent.groupBy("shard").applyInArrow(_open(words, shards), _MAIL), "begun", "shard", buckets)
    of = lambda mail, tag: mail.where(F.col("tag") == tag)
    union = lambda *parts: functools.reduce(DataFrame.unionAll, parts)
    letters = lambda swept, tag: of(swept, tag).select(F.col("receiver").alias("shard"), F.col("shard").alias("sender"), "tag", "blob", "stats")
    opened = of(begun, "opened")
    fixed = bucketed(opened.groupBy("shard").applyInArrow(_first_sums(words), _MAIL).repartition(buckets, "shard"), "sums", "shard", buckets)
    state, laid, g, kept, means = union(of(begun, "state"), fixed), None, _summed(begun), [], []
    last = None
    for sweep in range(sweeps):
        own = state if last is None else union(state, of(last, f"tables {sweep - 1}"))
        heard = docs.sparkSession.createDataFrame([], _MAIL) if last is None else opened.groupBy("shard").cogroup(letters(last, f"laid {sweep - 1}").groupBy("shard")).applyInArrow(_sums(words, f"laid {sweep - 1}"), _MAIL)
        now = bucketed(own.groupBy("shard").cogroup(heard.groupBy("shard")).applyInArrow(_sweep(words, shards, sweep, g, o), _KEPT), "swept", "shard", buckets)
        if last is not None and sweep <= burn_in:
            discard(last)  # nothing reads a sweep of the burn-in after the next one
        g, last = _summed(now), now
        if sweep >= burn_in:
            kept.append((sweep, now))
            means.append(g)
    samples = [i for i, _ in kept]
    laid = union(*[letters(x, f"laid {i}") for i, x in kept])
    mail = opened.groupBy("shard").cogroup(laid.groupBy("shard")).applyInArrow(_reply(words, samples), _MAIL)
    held_by = union(sent, *[of(x, f"tables {i}") for i, x in kept])  # no projection: it would cost the bucketing
    answers = held_by.groupBy("shard").cogroup(mail.groupBy("shard")).applyInArrow(_answer(words, samples, means, o), "chunk long, answer binary")
    scored = answered(chunks, answers)
    return one_row_batches(scored, _score(shards, folds, held, g), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole ``documents`` texts; null texts count as empty, repeated rows each get a row."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
