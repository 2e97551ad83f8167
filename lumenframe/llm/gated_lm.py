"""Gated recurrent language model in numpy, trained and applied by Spark tasks.

Tokens are words and one end per document. Spark counts them over all training documents. The
most frequent become symbols of their own, in classes of about equal mass; every other word is the
symbol of its ending's class (by a checksum of its last bytes), so unknown words have a symbol too.
``HEAD`` and ``ENDINGS`` are the least numbers of both, which grow with the square root of the
counted vocabulary. A gated recurrent unit reads symbols; the output is factored: softmax over
groups of classes (about the square root of the classes' number, so that a token meets few scores
whatever the vocabulary), then over the group's classes, then, within a class of head words, over
its members, within an ending's class the counts with absolute discounting, whose discounted mass
belongs to the words not seen in training (one event per class, as the base's unknown token is one
event).

Training is truncated backpropagation over windows of ``WINDOW`` tokens with the state carried
from window to window and cleared where a document begins; each task trains on its own part of
the training documents and the parts' parameters are averaged, for ``ROUNDS`` rounds over disjoint
shares of the documents, which together cover all of them. A part's documents are one stream, cut
into lanes that run side by side (a lane may begin inside a document, with an empty state); every
token is trained on, and what pads the last lanes is masked. Scoring runs many documents side by
side, each in full with its state carried through.

The static within-class terms need each word's count. The counts of the most frequent words after
the head (at most ``MID``) are known to the encoding tasks, which sum their terms by document;
rarer and unknown words leave as postings (one row per word and chunk of documents) and meet the
counts in a join.

Defined results: a null or empty text is one end token; every row is scored by itself, whatever ids
it shares; a row without an id is never learned from; a word of more than ``LONGEST`` bytes is never
a head word and meets its count in the join; without any training document all tokens are unknown;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

HEAD, HEAD_CLASSES, MEMBERS, ENDINGS, LAST = 2047, 40, 128, 32, 3
#: Documents whose words are split at once, that share postings, and that are learned from together.
SPLIT_DOCS, POSTING_DOCS, TOGETHER = 256, 5000, 4096
HIDDEN, WINDOW, LANES, ROUNDS, RATE = 16, 16, 512, 3, 0.01
#: Tokens scored and computed at once, documents scored side by side, parameters that stay in the cache.
FLUSH, BLOCK, SIDE, CACHED = 1 << 16, 1 << 15, 1024, 1 << 14
#: Words after the head that travel with their counts to the encoding tasks; longest word of these and of the head in bytes.
MID, LONGEST = 1 << 17, 256
ENCODED = "rn long, doc_id {id}, held_out boolean, n_tokens long, ids binary, known long, base double, score double, word binary, docs array<long>, times array<int>"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def sizes_for(vocab: int) -> tuple[int, int]:
    """Numbers of head words and of endings for so many distinct words."""
    return max(HEAD, 4 * math.isqrt(vocab)), max(ENDINGS, math.isqrt(vocab) // 20)


def ending_of(word: Column, endings: int) -> Column:
    """Of a binary column: its class by the checksum of its last bytes."""
    return (F.crc32(F.substring(word, -LAST, LAST)) % endings).cast("int")


class Symbols:
    """Symbols 0 (end) and 1.. (head words by count), then one for each ending; and their classes.

    All head words fill classes of about equal mass of up to MEMBERS words, whose members the network
    tells apart; a class is a run of symbols, a group one of classes. tail, kinds and discount: by ending, what the words
    outside the head count, how many they are, and what is taken off each count of the class.
    """

    def __init__(self, head: list[bytes], counts: np.ndarray, tail: np.ndarray, kinds: np.ndarray | None = None, discount: np.ndarray | None = None):
        self.head = pa.array(head, pa.binary())
        self.first_ending, self.endings = len(head) + 1, len(tail)
        self.n = self.first_ending + self.endings
        self.id_type = "<i2" if self.n < 1 << 15 else "<i4"
        # short integers, which a stable sort takes by their digits
        self.class_of, self.member = np.zeros(self.n, np.int16), np.zeros(self.n, np.int64)
        goal, mass, k, m = counts.sum() / HEAD_CLASSES, 0.0, 0, 0
        for s in range(self.first_ending):
            if m and (mass + counts[s] > goal or m == MEMBERS):
                k, m, mass = k + 1, 0, 0.0
            self.class_of[s], self.member[s] = k, m
            m, mass = m + 1, mass + counts[s]
        self.n_soft = k + 1
        self.n_classes = self.n_soft + self.endings
        self.class_of[self.first_ending :] = self.n_soft + np.arange(self.endings)
        self.cuts = np.r_[0, np.cumsum(np.bincount(self.class_of[: self.first_ending]))]
        self.counts = np.concatenate([counts, tail]).astype(np.float64)
        self.class_mass = np.bincount(self.class_of, self.counts + 0.5, self.n_classes)
        # groups of about equal mass, of up to twice the classes that they would have on average
        some, cuts, held = math.isqrt(self.n_classes), [0], 0.0
        for c, mass in enumerate(self.class_mass):
            if c > cuts[-1] and (held + mass > self.class_mass.sum() / some or c - cuts[-1] == 2 * some):
                cuts, held = [*cuts, c], 0.0
            held += mass
        self.group_cuts = np.array([*cuts, self.n_classes])
        self.group_of = np.repeat(np.arange(len(cuts), dtype=np.int16), np.diff(self.group_cuts))
        self.totals = tail
        self.discount = np.full(self.endings, 0.75) if discount is None else discount
        self.unseen = self.discount * (tail > 0 if kinds is None else kinds)
        self.mid, self.mid_counts = pa.array([], pa.binary()), np.empty(0)

    def know(self, words: pa.Array, counts: np.ndarray) -> None:
        """The counts of some words outside the head."""
        self.mid, self.mid_counts = words, counts.astype(np.float64)

    def static(self, words: pa.Array, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is its count known, log10 of what the base has for it, log10 of its share of its class) of words; 0 for others."""
        hit, base, term = np.zeros(len(words), bool), np.zeros(len(words)), np.zeros(len(words))
        at = _places(words, self.mid)
        those = np.flatnonzero(at >= 0)
        c, e = self.mid_counts[at[those]], of[those].astype(np.int64) - self.first_ending
        hit[those], base[those], term[those] = True, np.log10(c + 0.5), np.log10((c - self.discount[e]) / self.totals[e])
        return hit, base, term

    def of_words(self, words: pa.Array) -> np.ndarray:
        """The symbol of each word (binary)."""
        at = _places(words, self.head)
        last = pc.binary_slice(words, -LAST).dictionary_encode()
        endings = np.array([zlib.crc32(w) % self.endings for w in last.dictionary.to_pylist()], np.int64)
        return np.where(at >= 0, at + 1, self.first_ending + endings[last.indices.to_numpy()]).astype(self.id_type)


def _places(words: pa.Array, among: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy()


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words per text, the number of each word, and the distinct words by number."""
    sizes, parts = [], []
    for at in range(0, len(texts), SPLIT_DOCS):
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, SPLIT_DOCS)))
        flat = words.flatten()
        # white space at an end leaves an empty word
        real = pc.not_equal(pc.binary_length(flat), 0)
        ends = np.cumsum(pc.list_value_length(words).to_numpy())
        sizes.append(np.diff(np.r_[0, np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][ends]]))
        parts.append(flat.filter(real).dictionary_encode())
    chunks = pa.chunked_array(parts).unify_dictionaries().chunks
    return np.concatenate(sizes), np.concatenate([c.indices.to_numpy() for c in chunks]), chunks[0].dictionary.cast(pa.binary())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, POSTING_DOCS):
        _, codes, words = _codes(batch.column(0))
        yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes, minlength=len(words)).astype(np.int64))], names=["word", "c"])


def _encode(shared):
    """Per row its symbols and sums of known terms, and per chunk of rows a posting for each other word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sym: Symbols = shared.value
        none = lambda t, k: pa.nulls(k, t)
        for batch in _slices(batches, POSTING_DOCS):
            n = batch.num_rows
            size, codes, words = _codes(batch.column("text"))
            of = sym.of_words(words)
            hit, base, term = sym.static(words, of)
            doc = np.repeat(np.arange(n, dtype=np.int32), size)
            sums = [np.bincount(doc, x[codes], n) for x in (hit, base, term)]
            ids, ends = of[codes], np.cumsum(size)
            whole = np.insert(ids, ends, 0)
            ends = (ends + np.arange(1, n + 1)) * of.itemsize
            blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(whole)])
            kind = batch.schema.field("doc_id").type
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rn", "doc_id", "held_out")), pa.array(size + 1, pa.int64()), blobs, pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), none(pa.binary(), n), none(pa.list_(pa.int64()), n), none(pa.list_(pa.int32()), n)], names=names_)
            rare = np.flatnonzero((ids >= sym.first_ending) & ~hit[codes])
            pair, times = np.unique(codes[rare].astype(np.int64) * n + doc[rare], return_counts=True)
            word, doc = pair // n, pair % n
            cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)
            offsets = pa.array(np.r_[cut, len(word)].astype(np.int32)) if len(word) else pa.array([0], pa.int32())
            k = len(cut)
            yield pa.RecordBatch.from_arrays([none(pa.int64(), k), none(kind, k), none(pa.bool_(), k), none(pa.int64(), k), none(pa.binary(), k), none(pa.int64(), k), none(pa.float64(), k), none(pa.float64(), k), words.take(pa.array(word[cut])), pa.ListArray.from_arrays(offsets, batch.column("rn").take(pa.array(doc))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))], names=names_)

    names_ = [c.split()[0] for c in ENCODED.split(", ")]
    return run


class Network:
    """Parameters of the unit and the factored output; float32."""

    SHAPES = ("inputs", "recurrent", "groups", "group_bias", "classes", "class_bias", "members", "member_bias")

    def __init__(self, sym: Symbols):
        rng, h = np.random.default_rng(5), HIDDEN
        scale = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.inputs, self.recurrent = scale(sym.n, 3 * h), scale(h, 3 * h)
        self.classes, self.members = scale(sym.n_classes, h), scale(sym.first_ending, h)
        self.groups, self.cuts = scale(len(sym.group_cuts) - 1, h), sym.group_cuts
        mass = np.add.reduceat(sym.class_mass, self.cuts[:-1])
        self.group_bias = np.log(mass / mass.sum()).astype(np.float32)
        self.class_bias = np.log(sym.class_mass / sym.class_mass.sum()).astype(np.float32)
        self.member_bias = np.log(sym.counts[: sym.first_ending] + 0.5).astype(np.float32)

    def pack(self) -> bytes:
        return b"".join(getattr(self, k).astype(np.float32).tobytes() for k in self.SHAPES)

    def unpack(self, flat: np.ndarray) -> Network:
        at = 0
        for k in self.SHAPES:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def step(self, x: np.ndarray, h: np.ndarray):
        """One token for many sequences: (state, gates, candidate, what enters it)."""
        n = HIDDEN
        e = self.inputs.take(x, 0)
        gate = h @ self.recurrent[:, : 2 * n]
        gate += e[:, : 2 * n]
        # logistic: 1 / (1 + exp(-x)), where a float32 holds the exponential
        np.negative(gate, out=gate)
        np.minimum(gate, np.float32(80), out=gate)
        np.exp(gate, out=gate)
        gate += np.float32(1)
        np.reciprocal(gate, out=gate)
        rh = gate[:, n:] * h
        cand = rh @ self.recurrent[:, 2 * n :]
        cand += e[:, 2 * n :]
        np.tanh(cand, out=cand)
        new = cand - h
        new *= gate[:, :n]
        new += h
        return new, gate, cand, rh

    def class_log_probs(self, h: np.ndarray) -> np.ndarray:
        """log P(class | h) of every class, a row per state."""

        def log_softmax(z):
            z = z - z.max(1, keepdims=True)
            return z - np.log(np.exp(z).sum(1, keepdims=True))

        group, z = log_softmax(h @ self.groups.T + self.group_bias), h @ self.classes.T + self.class_bias
        return np.hstack([group[:, g, None] + log_softmax(z[:, a:b]) for g, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False))])


def _choices(weights: np.ndarray, bias: np.ndarray, cuts: np.ndarray, h: np.ndarray, run: np.ndarray, item: np.ndarray, grads: tuple | None = None, dh: np.ndarray | None = None) -> np.ndarray:
    """log P(item | its run, h), where run r is the rows cuts[r] up to cuts[r + 1]; adds gradients if asked.

    h ends with a column of ones. Runs of one item and the run after the last are certain: 0.
    """
    out, width = np.zeros(len(h), np.float32), np.diff(cuts)
    order = np.argsort(run, kind="stable")
    order = order[np.append(width > 1, False)[run[order]]]
    # the bias is a column of the weights; less its run's largest, no score exceeds what the state adds
    w = np.column_stack([weights, bias - np.repeat(np.maximum.reduceat(bias, cuts[:-1]), width)])
    wide, ones = float(np.abs(w).sum(1).max()) > 80, np.ones(width.max(), np.float32)
    if grads is not None:
        slope, back, place = np.zeros_like(w), np.zeros((len(order) + 1, HIDDEN), np.float32), np.full(len(h), len(order))
        place[order] = np.arange(len(order))
    for at in range(0, len(order), BLOCK):
        own = order[at : at + BLOCK]
        runs, ho = run[own], h.take(own, 0)
        sizes = width[runs]
        starts = np.cumsum(sizes) - sizes
        p, total, parts = np.empty(starts[-1] + sizes[-1], np.float32), np.empty(len(own), np.float32), []
        first = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
        for a, b, r in zip(first.tolist(), [*first[1:].tolist(), len(own)], runs[first].tolist(), strict=True):
            rows = slice(cuts[r], cuts[r + 1])
            z = p[starts[a] : starts[a] + (b - a) * width[r]].reshape(b - a, -1)
            np.matmul(ho[a:b], w[rows].T, out=z)
            if wide:
                z -= z.max(1, keepdims=True)
            parts.append((slice(a, b), rows, z))
        chosen = starts + item[own]
        term = p.take(chosen)
        np.exp(p, out=p)
        for part, _, z in parts:
            np.matmul(z, ones[: z.shape[1]], out=total[part])
        out[own] = term - np.log(total)
        if grads is not None:
            # probabilities are p / total: the smaller arrays are divided
            p[chosen] -= total
            total = (1 / total)[:, None]
            ho *= total
            back_ = back[at : at + len(own)]
            for part, rows, z in parts:
                slope[rows] += z.T @ ho[part]
                np.matmul(z, weights[rows], out=back_[part])
            back_ *= total
    if grads is not None:
        grads[0][...] += slope[:, :-1]
        grads[1][...] += slope[:, -1]
        dh += back.take(place, 0)
    return out


def _with_ones(h: np.ndarray) -> np.ndarray:
    out = np.ones((len(h), HIDDEN + 1), np.float32)
    out[:, :-1] = h
    return out


def _class_terms(net: Network, sym: Symbols, h1: np.ndarray, y: np.ndarray, grads: dict | None = None, dh: np.ndarray | None = None) -> np.ndarray:
    """log P(class of y | h): its group's, then its own within the group."""
    cls, of = sym.class_of[y], (lambda *k: None if grads is None else tuple(grads[x] for x in k))
    group = sym.group_of[cls]
    out = _choices(net.groups, net.group_bias, np.array([0, len(net.groups)]), h1, np.zeros(len(y), np.int16), group, of("groups", "group_bias"), dh)
    out += _choices(net.classes, net.class_bias, sym.group_cuts, h1, group, cls - sym.group_cuts[group], of("classes", "class_bias"), dh)
    return out


def _member_terms(net: Network, sym: Symbols, h1: np.ndarray, y: np.ndarray, grads: dict | None = None, dh: np.ndarray | None = None) -> np.ndarray:
    """log P(member | class, h) where the class is one of head words; 0 elsewhere."""
    cls = np.minimum(sym.class_of[y], sym.n_soft)
    of = None if grads is None else (grads["members"], grads["member_bias"])
    return _choices(net.members, net.member_bias, sym.cuts, h1, cls, sym.member[y], of, dh)


def _head_terms(net: Network, sym: Symbols, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """_member_terms of states without the column of ones."""
    return _member_terms(net, sym, _with_ones(h), y)


def train_stream(net: Network, sym: Symbols, ids: np.ndarray, begins: np.ndarray, lanes: int, opt: dict) -> None:
    """Truncated backpropagation over one long stream of documents, cut into lanes that run side by side."""
    total, n, hid = len(ids), -(-len(ids) // lanes), HIDDEN
    pad = n * lanes - total
    y_all, b_all = np.pad(ids, (0, pad)).reshape(lanes, n), np.pad(begins, (0, pad)).reshape(lanes, n)
    x_all = np.where(b_all, 0, np.pad(np.roll(ids, 1), (0, pad)).reshape(lanes, n))
    place = np.arange(lanes)[None, :] * n
    state = np.zeros((lanes, hid), np.float32)
    for at in range(0, n, WINDOW):
        steps = min(WINDOW, n - at)
        hs, kept = np.empty((steps + 1, lanes, hid), np.float32), []
        hs[0] = state
        for t in range(steps):
            before = np.where(b_all[:, at + t, None], np.float32(0), hs[t])
            hs[t + 1], gate, cand, rh = net.step(x_all[:, at + t], before)
            kept.append((before, gate, cand, rh))
        state = hs[steps].copy()
        h, y = hs[1:].reshape(-1, hid), y_all[:, at : at + steps].T.reshape(-1)
        grads = {k: np.zeros_like(getattr(net, k)) for k in net.SHAPES}
        real = np.flatnonzero((place + np.arange(at, at + steps)[:, None] < total).reshape(-1))
        dh_out, every = np.zeros_like(h), len(real) == len(y)
        own, of, wanted = (dh_out, h, y) if every else (dh_out[real], h[real], y[real])
        of = _with_ones(of)
        _class_terms(net, sym, of, wanted, grads, own)
        _member_terms(net, sym, of, wanted, grads, own)
        if not every:
            dh_out[real] = own
        dh_out = dh_out.reshape(steps, lanes, hid)
        dh, d_in = np.zeros((lanes, hid), np.float32), np.empty((steps, lanes, 3 * hid), np.float32)
        u = net.recurrent
        for t in reversed(range(steps)):
            before, gate, cand, rh = kept[t]
            dh += dh_out[t]
            z, r = gate[:, :hid], gate[:, hid:]
            d, dz = d_in[t], dh * z
            d_cand = cand * cand
            np.subtract(1, d_cand, out=d_cand)
            d_cand *= dz
            d_rh = d_cand @ u[:, 2 * hid :].T
            # of a gate s, s * (1 - s)
            slope = gate * gate
            np.subtract(gate, slope, out=slope)
            cand -= before
            cand *= dh
            np.multiply(cand, slope[:, :hid], out=d[:, :hid])
            np.multiply(d_rh * before, slope[:, hid:], out=d[:, hid : 2 * hid])
            d[:, 2 * hid :] = d_cand
            dh -= dz
            d_rh *= r
            dh += d_rh
            dh += d[:, : 2 * hid] @ u[:, : 2 * hid].T
            dh[b_all[:, at + t]] = 0
        flat_in = d_in.reshape(-1, 3 * hid)
        grads["recurrent"][:, : 2 * hid] = np.concatenate([k[0] for k in kept]).T @ flat_in[:, : 2 * hid]
        grads["recurrent"][:, 2 * hid :] = np.concatenate([k[3] for k in kept]).T @ flat_in[:, 2 * hid :]
        x = x_all[:, at : at + steps].T.reshape(-1).astype(sym.id_type)
        order = np.argsort(x, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(x[order]) != 0])
        grads["inputs"][x[order][cut]] = np.add.reduceat(flat_in[order], cut, axis=0)
        _adam(net, grads, opt, 1 / max(len(real), 1))


def _adam(net: Network, grads: dict, opt: dict, scale: float) -> None:
    opt["t"] = opt.get("t", 0) + 1
    norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) * scale
    scale = np.float32(0.1 * scale * min(1.0, 1.0 / max(norm, 1e-9)))
    fix = np.float32(RATE * np.sqrt(1 - 0.99 ** opt["t"]) / (1 - 0.9 ** opt["t"]))
    for k, g in grads.items():
        moments = opt.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
        flat = [a.reshape(-1) for a in (g, *moments, getattr(net, k))]
        for at in range(0, g.size, CACHED):
            # the block of g becomes a tenth of the scaled gradient, its square, then the step
            g_, m, v, w = (a[at : at + CACHED] for a in flat)
            g_ *= scale
            m *= np.float32(0.9)
            m += g_
            g_ *= g_
            v *= np.float32(0.99)
            v += g_
            np.sqrt(v, out=g_)
            g_ += np.float32(1e-6)
            np.divide(m, g_, out=g_)
            g_ *= fix
            w -= g_


def _stream(batch: pa.RecordBatch, id_type: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(b, id_type) for b in batch.column("ids").to_pylist()]
    size = np.array([len(p) for p in parts])
    begins = np.zeros(size.sum(), bool)
    begins[np.r_[0, np.cumsum(size)[:-1]]] = True
    return np.concatenate(parts).astype(np.int64), begins


def _train(shared, flat):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sym: Symbols = shared.value
        net, opt, n = Network(sym).unpack(np.frombuffer(flat.value, np.float32)), {}, 0
        for batch in _slices(batches, TOGETHER):
            if batch.num_rows:
                ids, begins = _stream(batch, sym.id_type)
                train_stream(net, sym, ids, begins, int(min(LANES, max(1, len(ids) // (4 * WINDOW)))), opt)
                n += len(ids)
        if n:
            yield _weighted(n, net.pack())

    return run


def _weighted(n: int, w: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w], pa.binary())], names=["n", "w"])


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, w = 0, 0.0
    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n, w = n + k, w + np.frombuffer(v, np.float32) * np.float64(k)
    if n:
        yield _weighted(n, (w / n).astype(np.float32).tobytes())


def train(encoded: DataFrame, sym: Symbols, shared, rounds: int = ROUNDS) -> bytes:
    """Averaged parameters after the given rounds, each over its own share of the training documents."""
    ctx, flat = encoded.sparkSession.sparkContext, Network(sym).pack()
    mine = encoded.where("ids IS NOT NULL AND NOT held_out AND doc_id IS NOT NULL").select("rn", "ids")
    for r in range(rounds):
        share = mine.where(F.pmod(F.xxhash64("rn"), F.lit(rounds)) == r)
        # one vector of each task, then of eight, then one
        sums = share.mapInArrow(_train(shared, ctx.broadcast(flat)), "n long, w binary")
        total = sums.repartition(8).mapInArrow(_mean, "n long, w binary").repartition(1).mapInArrow(_mean, "n long, w binary").first()
        if total is not None:
            flat = bytes(total["w"])
    return flat


def score_sequences(net: Network, sym: Symbols, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document's symbols; longest first, so that finished ones drop out."""
    order = np.argsort([-len(d) for d in docs], kind="stable")
    size = np.array([len(docs[i]) for i in order])
    out, ends = np.zeros(len(docs)), np.cumsum(size)
    flat = np.concatenate([docs[i] for i in order]) if len(docs) else np.empty(0, np.int64)
    starts = ends - size
    held_h, held_y, held_d, n = [], [], [], 0

    def flush():
        hh, yy, dd = np.concatenate(held_h), np.concatenate(held_y), np.concatenate(held_d)
        hh = _with_ones(hh)
        lp = _class_terms(net, sym, hh, yy) + _member_terms(net, sym, hh, yy)
        np.add(out, np.bincount(dd, lp, len(out)), out=out)

    for a in range(0, len(docs), SIDE):
        own, begin = size[a : a + SIDE], starts[a : a + SIDE]
        h, x = np.zeros((len(own), HIDDEN), np.float32), np.zeros(len(own), flat.dtype)
        for t, k in enumerate(np.searchsorted(-own, -np.arange(own[0]), "left").tolist()):
            h = net.step(x[:k], h[:k])[0]
            x = flat[begin[:k] + t]
            held_h.append(h)
            held_y.append(x)
            held_d.append(order[a : a + k])
            n += k
            if n >= FLUSH:
                flush()
                held_h, held_y, held_d, n = [], [], [], 0
    if n:
        flush()
    return out


def _score(shared, flat):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sym: Symbols = shared.value
        net = Network(sym).unpack(np.frombuffer(flat.value, np.float32))
        head = sym.counts[: sym.first_ending]
        log_base, is_known = np.r_[np.log10(head + 0.5), np.zeros(sym.endings)], np.r_[head > 0, np.zeros(sym.endings)].astype(np.int8)
        # whole batches (Spark bounds their rows): the more documents side by side, the fewer steps
        for batch in batches:
            if not batch.num_rows:
                continue
            docs = [np.frombuffer(b, sym.id_type) for b in batch.column("ids").to_pylist()]
            lp = score_sequences(net, sym, docs) / np.log(10)
            of, size = np.concatenate(docs), np.array([len(d) for d in docs])
            ends = np.cumsum(size)
            base, known = np.add.reduceat(log_base[of], ends - size), np.add.reduceat(is_known[of], ends - size, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rn", "doc_id", "held_out", "n_tokens")), pa.array(known + batch.column("known").to_numpy()), pa.array(base + batch.column("base").to_numpy()), pa.array(lp + batch.column("score").to_numpy())], names=["rn", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    return run


def log_likelihood(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark, kind, ctx = docs.sparkSession, dict(docs.dtypes)[id_col], docs.sparkSession.sparkContext
    rows = docs.select(F.monotonically_increasing_id().alias("rn"), F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("held_out", held_out())
    learn = rows.where(~F.col("held_out") & F.col("doc_id").isNotNull())
    words = learn.select("text").mapInArrow(_count_words, "word binary, c long")
    counts = materialize(words.groupBy("word").agg(F.sum("c").alias("c")))
    n_docs = learn.count()
    most, endings = sizes_for(counts.count())
    top = counts.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("c"), "word").limit(most).collect()
    head, head_counts = [bytes(r["word"]) for r in top], np.array([n_docs] + [r["c"] for r in top], np.float64)
    tail = counts.join(F.broadcast(spark.createDataFrame([(w,) for w in head], "word binary")), "word", "left_anti") if head else counts
    by_ending = tail.groupBy(ending_of(F.col("word"), endings).alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"))
    tail_c, kinds, discount = np.zeros(endings), np.zeros(endings), np.full(endings, 0.75)
    for r in by_ending.collect():
        tail_c[r["e"]], kinds[r["e"]] = r["c"], r["v"]
        if r["n1"] and r["n2"]:
            discount[r["e"]] = r["n1"] / (r["n1"] + 2 * r["n2"])
    n_train = int(head_counts.sum() + tail_c.sum())
    vocab = int(kinds.sum()) + len(head) + (1 if n_docs else 0)
    sym = Symbols(head, head_counts, tail_c, kinds, discount)
    # the least count from which on there are at most MID words
    below, least = 0, None
    for r in tail.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(MID).collect():
        below += r["n"]
        if below > MID:
            break
        least = r["c"]
    if least is not None:
        mid = tail.where((F.col("c") >= least) & (F.octet_length("word") <= LONGEST)).select("word", "c").toArrow().combine_chunks()
        sym.know(pa.concat_arrays(mid["word"].chunks).cast(pa.binary()) if mid.num_rows else sym.mid, mid["c"].to_numpy())
    shared = ctx.broadcast(sym)
    encoded = materialize(rows.select("rn", "doc_id", "held_out", "text").mapInArrow(_encode(shared), ENCODED.format(id=kind)))
    flat = ctx.broadcast(train(encoded, sym, shared))
    scored = encoded.where("ids IS NOT NULL").select("rn", "doc_id", "held_out", "n_tokens", "ids", "known", "base", "score").mapInArrow(_score(shared, flat), f"rn long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")
    # within its ending's class, a word has (c - discount) / total, an unseen one the discounted mass
    table_ = F.broadcast(spark.createDataFrame([(e, float(sym.totals[e]), float(sym.discount[e]), float(sym.unseen[e])) for e in range(endings) if sym.totals[e]], "e int, total double, discount double, unseen double"))
    posted = encoded.where("word IS NOT NULL").select("word", "docs", "times").join(counts, "word", "left").withColumn("e", ending_of(F.col("word"), endings)).join(table_, "e", "left")
    term = F.coalesce(F.log10(F.when(F.col("c").isNotNull(), F.col("c") - F.col("discount")).otherwise(F.col("unseen")) / F.col("total")), F.lit(0.0))
    # logarithms once per posting, before its documents are taken apart
    logs = posted.select("docs", "times", F.log10(F.coalesce("c", F.lit(0)) + 0.5).alias("base"), term.alias("score"), F.col("c").isNotNull().cast("long").alias("known"))
    parts = logs.select(F.explode(F.arrays_zip("docs", "times")).alias("d"), "base", "score", "known")
    tails = parts.select(F.col("d.docs").alias("rn"), F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"), (F.col("known") * F.col("d.times")).alias("n_known"), (F.col("base") * F.col("d.times")).alias("base"), (F.col("score") * F.col("d.times")).alias("score"))
    total = scored.unionByName(tails).groupBy("rn").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    down = float(np.log10(n_train + 0.5 * (vocab + 1)))
    return total.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * down).alias("base_score"), "score")


def query(spark, sf_dir) -> DataFrame:
    return log_likelihood(table(spark, sf_dir, "documents"))
