"""Operator 5: language-model scores of whole texts.

The model reads subword ids of lower-cased words. Its vocabulary is the CLASSES - 2 most frequent ids of the
training texts, the end of text, and one class for the tail, whose ids share its probability by smoothed counts.
Classes lie in GROUPS groups by frequency; a class's probability is its group's times its own in the group.
One block of causal self-attention and a small layer, trained here in numpy, give each id's probability
after its context. Scoring cuts a text's ids into windows of CONTEXT + STEP, each overlapping the one
before by CONTEXT; a window scores its last STEP ids, so each id is scored once, in batches of windows
under a mask. A word's probability mixes the product over its ids with its share of the training tokens,
counted over the whole corpus, which weighs SHARE.

Training: all training documents. Each task cuts the words of its documents into subwords once and gives shards of
about SHARD_WORDS words; few words are one shard. The first shard's task trains a first model for WARM steps; then in ROUNDS
rounds each shard trains it on with its share of the shard's windows, so that every window of every shard is learned from once
in all rounds (more often in a shard of fewer than SHARD_STEPS batches), and the weights are averaged by an aggregation over
(weight, value) rows. A lone shard is gone through in whole for STEPS steps or once, whichever is more. The driver sees the counts of
the subword ids and one averaged model a round, never a text.

Base: add-one unigram scores of words and the end of each text, from the same counts.

Texts are dealt by a hash into buckets of about BUCKET_BYTES. A bucket lists its distinct words, in a table;
a word's counts are summed over buckets, combined before the shuffle, and joined back to the buckets that
hold it; a word that every bucket holds is a skewed key, which adaptive execution splits. Words are told apart by a
64-bit hash. The driver gets three totals.

Nulls: a null text is an empty one: one token, the end. A null doc_id is held out if crc32 of the empty
text says so. Repeated rows each give a row. With no training tokens every count is 0 and the model is
uniform. An empty table gives an empty result. A very long text is one row: it is scored in slices of windows, but
its words and scores are held at once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.arrow_text import SPACED, Words, slices, split_words
from weirgate.llm.shared import bucket_of, map_arrow, stage
from weirgate.llm.vocabulary import VOCABULARY, encoder, sizes
from weirgate.materialize import scratch

FOLDS, HELD_OUT = 7, 2
SUBWORDS = 50_257
CLASSES, GROUPS = 1024, 32
SIDE = CLASSES // GROUPS
WIDTH, HIDDEN = 16, 32
CONTEXT, STEP = 8, 32
#: Least steps of a model that has one shard alone; else the first model's, and the least of each shard after it.
STEPS, WARM, SHARD_STEPS, ROUNDS = 3000, 1500, 200, 2
BATCH, RATE, LATE_RATE = 64, 0.008, 0.002
SHARD_WORDS = 600_000
SHARE = 0.2
BUCKET_BYTES = 12 << 20
AT_ONCE = 256
#: Bytes of text that are scored at once, and distinct words that a task tallies before it gives them out.
SLICE = 1 << 20
TALLY = 1 << 19
#: Distinct words whose subwords a task that makes shards remembers, before it begins anew.
KEPT_WORDS = 1 << 19
#: Words that are cut into subwords in one call.
LOT = 4096
_OTHER_SPACE = re.compile(r"[^\S ]")


class Attention:
    """Weights by name; class 0 is the end of a text and stands before its start."""

    def __init__(self, weights: dict[str, np.ndarray], class_of: np.ndarray, tail: np.ndarray) -> None:
        self.w, self.class_of, self.tail = weights, class_of, tail

    @classmethod
    def fresh(cls, class_of: np.ndarray, tail: np.ndarray, bias: np.ndarray, seed: int = 5) -> Attention:
        rng = np.random.default_rng(seed)
        shape = {"E": (CLASSES, WIDTH), "P": (CONTEXT + STEP, WIDTH), "Q": (WIDTH, WIDTH), "K": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "O": (WIDTH, WIDTH), "A": (WIDTH, HIDDEN), "B": (HIDDEN, WIDTH), "G": (WIDTH, GROUPS), "U": (GROUPS, WIDTH, SIDE)}
        w = {k: (rng.standard_normal(s) * (0.3 if k in "EGU" else s[0] ** -0.5 * 0.7)).astype(np.float32) for k, s in shape.items()}
        sides = bias.reshape(GROUPS, SIDE)
        w |= {"a": np.zeros(HIDDEN, np.float32), "b": sides.astype(np.float32), "g": np.log(np.exp(sides).sum(axis=1)).astype(np.float32)}
        return cls(w, class_of, tail)

    def forward(self, seen: np.ndarray, hidden: np.ndarray) -> dict[str, np.ndarray]:
        """seen: windows x (CONTEXT + STEP) classes; hidden: which of them are padding. What comes before the logits of the STEP last places.

        Keys and values are not made: a query times QK' meets what is seen as it is, and V with O is one product after the sum over places.
        Rows have a last column of ones, which takes in the biases and the sums of exponents. x, es and ts by window, the rest a row for
        each late place; es begins with the exponents of what is seen, and ts ends with the queries; their other halves are for the gradients.
        """
        w, n = self.w, len(seen)
        x = _bordered(w["E"], 1, 0).take(seen, axis=0)
        x += _bordered(w["P"], 0, 0)
        late, plain = x[:, CONTEXT:].reshape(-1, WIDTH + 1), x[..., :WIDTH]
        es, ts = np.empty((n, 2 * STEP, CONTEXT + STEP), x.dtype), np.empty((n, 2 * STEP, WIDTH + 1), x.dtype)
        e = es[:, :STEP]
        t = ts[:, STEP:, :WIDTH]
        t[:] = (late[:, :WIDTH] @ (w["Q"] @ w["K"].T * _SCALE)).reshape(n, STEP, WIDTH)
        np.matmul(t, plain.transpose(0, 2, 1), out=e)
        _exp(e)
        _hide(e, hidden)
        o = (e @ x).reshape(-1, WIDTH + 1)
        # A row that sees nothing is padding, and is not counted.
        inv = 1 / np.maximum(o[:, WIDTH:], np.float32(1e-30))
        o *= inv
        h = o @ _bordered(w["V"] @ w["O"], 0, 1)
        h += late
        m = h @ np.concatenate([w["A"], w["a"][None]])
        signs = m.view(f"i{m.itemsize}")
        keep = ~(signs >> (8 * m.itemsize - 1))
        signs &= keep
        z = m @ _bordered(w["B"], 0, 0)
        z += h
        return {"x": x, "late": late, "es": es, "ts": ts, "inv": inv, "o": o, "h": h, "m": m, "keep": keep, "z": z}

    def gradients(self, seen: np.ndarray, hidden: np.ndarray, wanted: np.ndarray, counts: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean negative log likelihood of `wanted` where `counts`."""
        w, f, many = self.w, self.forward(seen, hidden), len(seen)
        rows, want, group, members = _by_group(wanted, counts)
        z = f["z"].take(rows, axis=0)
        n, begin = max(1, len(want)), np.arange(0, SIDE * len(want), SIDE)

        def errors(y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float]:
            at, flat = at + begin, y.reshape(-1)
            own = flat.take(at)
            p = _exp(y)
            total = _row_sums(p)
            p *= 1 / (total * n)
            flat[at] = flat.take(at) - 1 / n
            return p, float(np.log(total[:, 0]).sum() - own.sum()) / n

        dg, lost_group = errors(z @ np.concatenate([w["G"], w["g"][None]]), group)
        dy, lost_side = errors(self._sides(z, members), want - group * SIDE)
        late, inner, du = dg @ w["G"].T, np.empty((len(z), WIDTH), z.dtype), np.empty((GROUPS, WIDTH + 1, SIDE), z.dtype)
        for own, u, into in zip(members, w["U"], du, strict=True):
            np.dot(z[own].T, dy[own], out=into)
            np.dot(dy[own], u.T, out=inner[own])
        late += inner
        dz = np.zeros((len(f["z"]), WIDTH), z.dtype)
        dz[rows] = late
        dg = z.T @ dg
        g = {"G": dg[:WIDTH], "g": dg[WIDTH], "U": du[:, :WIDTH], "b": du[:, WIDTH]}

        dm = dz @ w["B"].T
        signs = dm.view(f["keep"].dtype)
        signs &= f["keep"]
        da = f["h"].T @ dm
        g |= {"B": f["m"].T @ dz, "A": da[:WIDTH], "a": da[WIDTH]}
        dh = dm @ w["A"].T
        dh += dz
        dvo = (f["o"].T @ dh)[:WIDTH]
        g["V"], g["O"] = dvo @ w["O"].T, w["V"].T @ dvo
        # The sums of exponents are divided out in rows of WIDTH, not in those of all places seen; the column beside takes off each row's mean.
        do = dh @ _bordered((w["V"] @ w["O"]).T, 0, 0)
        do *= f["inv"]
        do[:, WIDTH:] = -_row_sums(do * f["o"])
        f["ts"][:, :STEP] = do.reshape(many, STEP, WIDTH + 1)
        ds = f["es"][:, STEP:]
        np.matmul(f["ts"][:, :STEP], f["x"].transpose(0, 2, 1), out=ds)
        ds *= f["es"][:, :STEP]
        dt = (ds @ f["x"][..., :WIDTH]).reshape(-1, WIDTH)
        # What is seen gets both e' do and ds' t, in one product.
        dx = f["es"].transpose(0, 2, 1) @ f["ts"][..., :WIDTH]
        dqk = f["late"][:, :WIDTH].T @ dt * _SCALE
        g["Q"], g["K"] = dqk @ w["K"], dqk.T @ w["Q"]
        dh += dt @ (w["K"] @ w["Q"].T * _SCALE)
        dx[:, CONTEXT:] += dh.reshape(many, STEP, WIDTH)
        g["P"] = dx.sum(axis=0)
        g["E"] = np.bincount(_PLACES.take(seen, axis=0).reshape(-1), dx.reshape(-1), _PLACES.size).astype(dx.dtype).reshape(_PLACES.shape)
        return g, lost_group + lost_side

    def _sides(self, z: np.ndarray, members: list[slice]) -> np.ndarray:
        """Logits within their groups of rows in the order of the groups; the last column of z is ones."""
        y = np.empty((len(z), SIDE), z.dtype)
        for own, u in zip(members, np.concatenate([self.w["U"], self.w["b"][:, None]], axis=1), strict=True):
            np.dot(z[own], u, out=y[own])
        return y

    def train(self, ids: np.ndarray, first: np.ndarray, steps: int = STEPS, seed: int = 6, top_rate: float = RATE, part: tuple[int, int] | None = (0, 1)) -> list[float]:
        """ids of texts, each with its end; Adam over windows in random order.

        part: the i-th of n parts of the windows, all of which is gone through, in `steps` steps or more, again from its start where
        it is short; None: `steps` steps and no more.
        """
        order = np.random.default_rng(seed).permutation(int((-(-np.diff(first) // STEP)).sum()))
        if part is not None:
            order = order[len(order) * part[0] // part[1] : len(order) * (part[0] + 1) // part[1]]
            steps = max(steps, -(-len(order) // BATCH)) if len(order) else 0
        # Those that no step comes to are not made.
        seen, hidden, wanted, counts, _ = windows(self.class_of[ids], first, order[: steps * BATCH])
        flat = _flat(self.w)
        self.w = _views(flat, self.w)
        m, v = np.zeros_like(flat), np.zeros_like(flat)
        losses = []
        for step in range(1, steps + 1):
            at = np.arange((step - 1) * BATCH, step * BATCH) % len(seen)
            g, loss = self.gradients(seen[at], hidden[at], wanted[at], counts[at])
            losses.append(loss)
            rate = top_rate * min(1, step / 50) * (1 - 0.9 * step / steps)
            slope = _flat(g)
            m *= 0.9
            m += 0.1 * slope
            v *= 0.99
            slope *= slope
            slope *= 0.01
            v += slope
            # In place: slope is the divisor from here on.
            np.multiply(v, 1 / (1 - 0.99**step), out=slope)
            np.sqrt(slope, out=slope)
            slope += 1e-8
            np.divide(m, slope, out=slope)
            slope *= rate / (1 - 0.9**step)
            flat -= slope
        return losses

    def log10(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each id of the texts ids[first[d]:first[d + 1]].

        What depends on a class or a place alone is multiplied out once; exponents are small enough to need no shift.
        """
        w = self.w
        # Beside the places' own rows a column for the sums of exponents, which are ones once divided by themselves and so take in the biases.
        late, late_place = (np.concatenate([_bordered(y, 0, 0), y @ w["Q"] * _SCALE], axis=1) for y in (w["E"], w["P"][CONTEXT:]))
        pair, pair_place = (np.concatenate([y @ w["K"], _bordered(y @ w["V"] @ w["O"], one, 0)], axis=1) for y, one in ((w["E"], 1), (w["P"], 0)))
        inner, outer, of_group = np.concatenate([w["A"], w["a"][None]]), _bordered(w["B"], 0, 0), np.concatenate([w["G"], w["g"][None]])
        out = np.zeros(len(ids))
        seen, hidden, wanted, counts, place = windows(self.class_of[ids], first)
        for lo in range(0, len(seen), AT_ONCE):
            part = slice(lo, lo + AT_ONCE)
            x = late.take(seen[part, CONTEXT:], axis=0)
            x += late_place
            kv = pair.take(seen[part], axis=0)
            kv += pair_place
            e = _exp(x[..., WIDTH + 1 :] @ kv[..., :WIDTH].transpose(0, 2, 1))
            _hide(e, hidden[part])
            h = (e @ kv[..., WIDTH:]).reshape(-1, WIDTH + 1)
            # A row that sees nothing is padding, and is not counted.
            h /= np.maximum(h[:, WIDTH:], np.float32(1e-30))
            h += x[..., : WIDTH + 1].reshape(-1, WIDTH + 1)
            rows, want, group, members = _by_group(wanted[part], counts[part])
            h = h.take(rows, axis=0)
            m = h @ inner
            z = np.maximum(m, 0, out=m) @ outer
            z += h
            begin, got = np.arange(0, SIDE * len(want), SIDE), 0
            for y, at in ((z @ of_group, group), (self._sides(z, members), want - group * SIDE)):
                got += y.reshape(-1).take(at + begin) - np.log(_row_sums(_exp(y))[:, 0])
            out[place[part].ravel()[rows]] = got
        return out / np.log(10) + self.tail[ids]


_SEEN = (np.arange(CONTEXT + STEP)[None, :] <= CONTEXT + np.arange(STEP)[:, None]).astype(np.float32)
_SCALE = np.float32(WIDTH**-0.5)
#: Where each class's weights lie in E.
_PLACES = np.arange(CLASSES * WIDTH).reshape(CLASSES, WIDTH)
#: Logits are small and need no shift before they are exponents; none of a model that went astray makes them infinite.
MOST_LOGIT = np.float32(80)


def _exp(y: np.ndarray) -> np.ndarray:
    """In place."""
    if y.size and y.max() > MOST_LOGIT:
        np.minimum(y, MOST_LOGIT, out=y)
    return np.exp(y, out=y)


def _bordered(a: np.ndarray, beside: float, below: int) -> np.ndarray:
    """a with a column beside it, and with so many rows of zeros below."""
    out = np.zeros((len(a) + below, a.shape[1] + 1), a.dtype)
    out[: len(a), :-1], out[: len(a), -1] = a, beside
    return out


def _row_sums(y: np.ndarray) -> np.ndarray:
    """Of the last axis, as one column; a product with ones, which takes a fifth of a sum's time."""
    return y.reshape(-1, y.shape[-1]) @ np.ones((y.shape[-1], 1), y.dtype)


def _hide(e: np.ndarray, hidden: np.ndarray) -> None:
    """What a place can't see counts nothing, in place: later places, and padding, which few windows have."""
    e *= _SEEN
    some = np.flatnonzero(hidden.any(axis=1))
    e[some] *= ~hidden[some, None, :]


def _by_group(wanted: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[slice]]:
    """The late places that count, in the order of their wanted classes' groups; those classes, their groups, and each group's slice."""
    rows = np.flatnonzero(counts)
    want = wanted.ravel()[rows]
    group = want // SIDE
    order = np.argsort(group.astype(np.uint8), kind="stable")
    rows, want, group = rows[order], want[order], group[order]
    ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    return rows, want, group, [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def windows(classes: np.ndarray, first: np.ndarray, some: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, ...]:
    """Windows of inputs (the class before each place), padding, wanted classes, which count, and their places; of all windows or of some, in their order."""
    size = np.diff(first)
    n = -(-size // STEP)
    doc = np.repeat(np.arange(len(size)), n)
    nth = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))[some]
    doc = doc[some]
    inside = (nth[:, None] * STEP - CONTEXT + np.arange(CONTEXT + STEP)).astype(np.int32)
    hidden = (inside < 0) | (inside > size[doc][:, None])
    place = first[doc][:, None] + inside
    before = np.concatenate([[0], classes])
    seen = np.where(inside > 0, before[np.clip(place, 0, len(classes))], 0).astype(np.int32)
    late = place[:, CONTEXT:]
    counts = inside[:, CONTEXT:] < size[doc][:, None]
    wanted = classes[np.clip(late, 0, max(0, len(classes) - 1))]
    return seen, hidden, wanted, counts, late


def subwords(words: list[bytes], vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, each with a space before it, and where each word's begin.

    Many words are cut in one call: no piece of the vocabulary's pattern goes on over a space into the next word. It may where a
    word has other white space; such words' lots are cut word by word.
    """
    encode, size = encoder(vocabulary).encode_ordinary, sizes(vocabulary)
    ids, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for lo in range(0, len(words), LOT):
        lot = words[lo : lo + LOT]
        text = b" ".join([b"", *lot]).decode()
        if _OTHER_SPACE.search(text):
            each = [encode(" " + w.decode()) for w in lot]
            ids.append(np.array([i for x in each for i in x], dtype=np.int64))
            counts.append(np.array([len(x) for x in each], dtype=np.int64))
        else:
            ids.append(np.array(encode(text), dtype=np.int64))
            upto = np.searchsorted(np.cumsum(size[ids[-1]]), np.cumsum([len(w) + 1 for w in lot]), side="right")
            counts.append(np.diff(upto, prepend=0))
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


END = SUBWORDS


def spelled(words: Words, known: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of whole texts, END after each; begins of texts; begins of words and ends of text among them. known: number of each word in ids, first."""
    docs = len(words.first) - 1
    # The end counts as one more word.
    ids, first = np.append(ids, END), np.append(first, len(ids) + 1)
    entry = np.full(len(known) + docs, len(first) - 2)
    ends = words.first[1:] + np.arange(docs)
    own = np.ones(len(entry), dtype=bool)
    own[ends] = False
    entry[own] = known
    size = np.diff(first).take(entry)
    upto = np.cumsum(size)
    at = upto - size
    source = np.repeat(first.take(entry) - at, size)
    source += np.arange(len(source))
    return ids.take(source), np.concatenate([[0], upto[ends]]), at


class Cutter:
    """Cuts words into subwords, each once as long as it remembers it: it forgets all words so far once they are `most`."""

    def __init__(self, vocabulary: str, most: float) -> None:
        self.vocabulary, self.most = vocabulary, most
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, dtype=np.int64)
        self.words = self.hashes = none.view(np.uint64)
        self.number, self.ids, self.first = none, none, np.zeros(1, dtype=np.int64)

    def numbers(self, words: Words) -> np.ndarray:
        """Of each word, its number in ids, first and words, which has the hashes; hashes and number are the same in the order of hashes."""
        if len(self.hashes) >= self.most:
            self.forget()
        h, at, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, h)
        met = self.hashes.take(place, mode="clip") == h if len(self.hashes) else np.zeros(len(h), dtype=bool)
        new = ~met
        number = np.empty(len(h), dtype=np.int64)
        number[met] = self.number[place[met]]
        number[new] = len(self.first) - 1 + np.arange(int(new.sum()))
        ids, first = subwords([words.low[s:e].tobytes() for s, e in zip(words.start[at[new]].tolist(), words.end[at[new]].tolist(), strict=True)], self.vocabulary)
        self.first = np.concatenate([self.first, self.first[-1] + first[1:]])
        self.ids, self.words = np.concatenate([self.ids, ids]), np.concatenate([self.words, h[new]])
        self.hashes, self.number = (np.insert(x, place[new], y[new]) for x, y in ((self.hashes, h), (self.number, number)))
        return number.take(inverse)


def untrained(counts: np.ndarray) -> Attention:
    """A model that knows how often each id occurs, with the end's count as the last."""
    class_of = np.full(SUBWORDS + 1, CLASSES - 1)
    top = np.argsort(-counts[:SUBWORDS], kind="stable")[: CLASSES - 2]
    class_of[top] = np.arange(1, CLASSES - 1)
    class_of[END] = 0
    rare = class_of == CLASSES - 1
    tail = np.where(rare, np.log10((counts + 1) / (counts[rare].sum() + rare.sum())), 0.0)
    share = np.bincount(class_of, weights=counts, minlength=CLASSES) + 1
    return Attention.fresh(class_of, tail, np.log(share / share.sum()))


def ids_of(column: pa.Array, vocabulary: str, cutter: Cutter | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids of the texts of a column, END after each, where each text begins, and the number of words; each distinct word is cut into subwords once."""
    cutter = cutter or Cutter(vocabulary, KEPT_WORDS)
    words = split_words(pc.fill_null(column.cast(pa.large_string()), ""), SPACED)
    known = cutter.numbers(words)
    ids, text_first, _ = spelled(words, known, cutter.ids, cutter.first)
    return ids, text_first, len(words.start)


def fit(texts: list[str], vocabulary: str = VOCABULARY, steps: int = STEPS) -> Attention:
    """A model of a few texts, here and now."""
    ids, first, _ = ids_of(pa.array(texts, pa.large_string()), vocabulary)
    model = untrained(np.bincount(ids, minlength=SUBWORDS + 1).astype(np.float64))
    if len(texts):
        model.train(ids, first, steps)
    return model


def _shards(batches: Iterator[pa.RecordBatch], vocabulary: str, most: float) -> Iterator[pa.RecordBatch]:
    """Shards of so many words or a little more, and one of what is left: a number by content, the ids of the texts in 16 bits, and where each text begins."""

    def row() -> pa.RecordBatch:
        ids = np.concatenate([x for x, _ in kept]).tobytes()
        size = np.concatenate([np.diff(f) for _, f in kept])
        return pa.RecordBatch.from_arrays([pa.array([zlib.crc32(ids)], pa.int64()), pa.array([ids], pa.binary()), pa.array([np.concatenate([[0], np.cumsum(size)]).astype(np.int64).tobytes()], pa.binary())], names=["shard", "ids", "first"])

    kept, words, cutter = [], 0, Cutter(vocabulary, KEPT_WORDS)
    for batch in batches:
        for _, texts in slices(batch.column("text"), SLICE):
            ids, first, n = ids_of(texts, vocabulary, cutter)
            kept.append((ids.astype(np.uint16), first))
            words += n + len(texts)
            if words >= most:
                yield row()
                kept, words = [], 0
    if kept:
        yield row()


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.zeros(SUBWORDS + 1, dtype=np.int64)
        for raw in batch.column("ids"):
            n += np.bincount(np.frombuffer(raw.as_py(), dtype=np.uint16), minlength=SUBWORDS + 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["id", "n"])


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def _views(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _trained(batches: Iterator[pa.RecordBatch], shared, steps: int, rate: float, part: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """Each shard's weights after training on its part, times the shard's number of ids."""
    for batch in batches:
        for shard, raw, starts in zip(*(batch.column(c).to_pylist() for c in ("shard", "ids", "first")), strict=True):
            start = shared.value
            model = Attention({k: v.copy() for k, v in start.w.items()}, start.class_of, start.tail)
            ids = np.frombuffer(raw, dtype=np.uint16).astype(np.int64)
            model.train(ids, np.frombuffer(starts, dtype=np.int64), steps, seed=6 + shard, top_rate=rate, part=part)
            values = _flat(model.w).astype(np.float64) * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values), pa.array(np.full(len(values), len(ids)))], names=["weight", "value", "n"])


def learn(texts: DataFrame, words: int, vocabulary: str = VOCABULARY) -> Attention:
    """A model of all training texts (column text; A-Z is lower-cased where it is cut into words), of so many words in all."""
    with scratch(texts.sparkSession):
        return _learned(texts, words, vocabulary)


def _learned(texts: DataFrame, words: int, vocabulary: str) -> Attention:
    spark = texts.sparkSession
    shards = max(1, round(words / SHARD_WORDS))
    # No task has much less than a shard's words.
    most = SHARD_WORDS if shards > 1 else float("inf")
    ids = stage(map_arrow(texts.select("text").coalesce(shards), lambda b: _shards(b, vocabulary, most), "shard long, ids binary, first binary"), "lm-shards")
    counts = np.zeros(SUBWORDS + 1)
    for r in map_arrow(ids.select("ids"), _id_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    model = untrained(counts)
    if not counts.sum():
        return model

    def averaged(rows: DataFrame, steps: int, rate: float, part: tuple[int, int] | None) -> None:
        """The model's weights become the mean of those that the shards come to."""
        shared = spark.sparkContext.broadcast(model)
        rows = map_arrow(rows, lambda b: _trained(b, shared, steps, rate, part), "weight long, value double, n long")
        mean = rows.groupBy("weight").agg((F.sum("value") / F.sum("n")).alias("value")).toArrow()
        values = np.zeros(len(mean))
        values[mean.column("weight").to_numpy()] = mean.column("value").to_numpy()
        model.w = _views(values.astype(np.float32), model.w)

    lone = shards == 1
    # The largest shard, so that it is not what one task had left.
    averaged(ids.orderBy(F.octet_length("ids").desc(), "shard").limit(1), STEPS if lone else WARM, RATE, (0, 1) if lone else None)
    for turn in range(0 if lone else ROUNDS):
        averaged(ids, SHARD_STEPS // ROUNDS, LATE_RATE, (turn, ROUNDS))
    return model


def _summed(b: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n summed by (b, h)."""
    order = np.lexsort((h, b))
    b, h, n = b[order], h[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, dtype=np.int64)
    return b[new], h[new], np.add.reduceat(n, new) if len(new) else n


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words by bucket: word (its hash) and its count in training documents. A word may come again after TALLY others."""

    def rows(b: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(b), pa.array(h.view(np.int64)), pa.array(n)], names=["bucket", "word", "n"])

    kept, size = [], 0
    for batch in batches:
        trains = batch.column("trains").to_numpy(zero_copy_only=False)
        bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
        for lo, part in slices(batch.column("text")):
            words = split_words(part, SPACED)
            doc = lo + np.repeat(np.arange(len(part)), np.diff(words.first))
            kept.append(_summed(bucket[doc], words.hashes(), trains[doc].astype(np.int64)))
            size += len(kept[-1][0])
            if size >= TALLY:
                whole = _summed(*(np.concatenate(x) for x in zip(*kept, strict=True)))
                kept, size = [whole], len(whole[0])
                if size >= TALLY // 2:
                    yield rows(*whole)
                    kept, size = [], 0
    if kept:
        yield rows(*_summed(*(np.concatenate(x) for x in zip(*kept, strict=True))))


def _looked_up(table: np.ndarray, values: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The value of each word in a sorted table of words; 0 where it isn't there."""
    if not len(table):
        return np.zeros(len(words), dtype=values.dtype)
    where = np.searchsorted(table, words)
    return np.where(table.take(where, mode="clip") == words, values.take(where, mode="clip"), 0)


def _score(docs: pa.Table, counts: pa.Table, model: Attention, total: int, ends: int, vocabulary: str) -> pa.Table:
    table = counts.column("word").to_numpy().view(np.uint64)
    order = np.argsort(table)
    table, n = table[order], counts.column("c").to_numpy()[order]
    # Each word of the bucket is cut into subwords once.
    cutter, c = Cutter(vocabulary, float("inf")), np.zeros(0, dtype=np.int64)
    out = []
    for lo, part in slices(docs.column("text"), SLICE):
        words = split_words(part, SPACED)
        known = cutter.numbers(words)
        c = np.concatenate([c, _looked_up(table, n, cutter.words[len(c) :])])
        ids, text_first, word_at = spelled(words, known, cutter.ids, cutter.first)
        p = np.add.reduceat(model.log10(ids, text_first), word_at)
        tokens = np.full(len(word_at), ends)
        own = np.ones(len(word_at), dtype=bool)
        own[words.first[1:] + np.arange(len(part))] = False
        tokens[own] = c[known]
        begin = words.first[:-1] + np.arange(len(part))
        share = tokens / total if total else np.zeros(len(tokens))
        trust = SHARE if total else 0.0
        mixed = np.log10(trust * share + (1 - trust) * np.maximum(10.0**p, 1e-300))
        out.append(
            pa.table(
                {
                    "doc_id": docs.column("doc_id").slice(lo, len(part)),
                    "held_out": docs.column("held_out").slice(lo, len(part)),
                    "n_tokens": np.diff(words.first) + 1,
                    "n_known": np.add.reduceat((tokens > 0).astype(np.int64), begin),
                    "log_counts": np.add.reduceat(np.log10(tokens + 1.0), begin),
                    "score": np.add.reduceat(np.where(mixed > -300, mixed, p + np.log10(1 - trust)), begin),
                }
            )
        )
    return pa.concat_tables(out)


def score(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document."""
    held_out = bucket_of(F.col("doc_id"), FOLDS) == HELD_OUT
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("held_out", held_out)
    stats = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("ends")).first()
    ends = stats["ends"]
    buckets = max(1, -(-(stats["bytes"] or 0) // BUCKET_BYTES))
    dealt = rows.withColumn("trains", (~F.col("held_out")).cast("long")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets))).repartition("bucket")
    words = stage(map_arrow(dealt.select("bucket", "trains", "text"), _tally, "bucket long, word long, n long"), "lm-words")
    counts = stage(words.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"), "lm-counts")
    sums = counts.agg(F.count("*").alias("known"), F.sum("c").alias("n")).first()
    known, total = sums["known"] + (ends > 0), (sums["n"] or 0) + ends

    model = learn(rows.filter(~F.col("held_out")).select("text"), total, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    counted = words.select("bucket", "word").join(counts, "word")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = (
        dealt.groupBy("bucket")
        .cogroup(counted.groupBy("bucket"))
        .applyInArrow(lambda d, c: _score(d, c, shared.value, total, ends, vocabulary), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, log_counts double, score double")
    )
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(total + known + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
