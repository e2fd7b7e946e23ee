"""Plain versions of the operators, and awkward rows to try them on."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; a table may have them too.
CLASHING = ("row_key", "bucket", "score", "fp", "words", "place", "window", "text_", "size", "block", "anchor", "component_id", "copies", "lines", "found_id", "lines_before", "copy_id", "stay_id", "bad_id", "rest", "next_text")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def rows(seed: int, n: int = 60) -> list[tuple]:
    """Texts with exact and near copies, repeated lines, nulls, empty and odd ones, and a long one."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["an", "er", "ti", "ö", "É", "on", "th", "7"]) for _ in range(rng.randint(1, 4))) for _ in range(90)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    common = [line(rng.randint(4, 40)) for _ in range(6)]
    texts: list[str | None] = [None, "", " \n\t ", "one", "!!! ???", "a b  c", "x\x0by\x0cz", "\n".join(line(9) for _ in range(400))]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.2 and len(texts) > 12:
            texts.append(texts[rng.randrange(8, len(texts))])
        elif kind < 0.4 and len(texts) > 12:
            words = (texts[rng.randrange(8, len(texts))] or "").split(" ")
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        else:
            texts.append("\n".join(rng.choice(common) if rng.random() < 0.3 else line(rng.randint(0, 30)) for _ in range(rng.randint(1, 9))))
    out = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", "\U0001f600", "￮", None]), len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return out


def roots(nodes, pairs) -> dict:
    """The smallest node that each can reach."""
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in nodes}


def simhash(text: str | None) -> int:
    words = spaced(lower(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def contamination(text: str | None, items: list[tuple]) -> tuple[int, int, list[str]]:
    """Number of words, of words hit, and the ids of the items found."""
    words, hit, found = alnum(text), set(), set()
    places = defaultdict(list)
    for n in range(1, 11):
        for i in range(len(words) - n + 1):
            places[tuple(words[i : i + n])].append(i)
    for item, body in items:
        own = alnum(body)
        n = min(10, len(own))
        for i in range(len(own) - n + 1) if own else ():
            for p in places.get(tuple(own[i : i + n]), ()):
                hit |= set(range(p, p + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def _gram(hashes: list[int]) -> int:
    """Spark's xxhash64 of longs, folded from the left."""
    out = hashes[0]
    for x in hashes[1:]:
        out = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), xxhash.xxh64_intdigest(out.to_bytes(8, "little"), 42))
    return out


def marks(text: str | None, gram: int = 3, run: int = 4) -> set[tuple[int, int]]:
    """(hash, place) that winnowing keeps: of each run the least of the high 32 bits, the rightmost of equal ones."""
    words = spaced(text)
    if not words:
        return set()
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    g = [_gram(h[i : i + gram]) for i in range(len(h) - gram + 1)] if len(h) >= gram else [xxhash.xxh64_intdigest(" ".join(words).encode(), 42)]
    signed = [x - (1 << 64) if x >> 63 else x for x in g]
    least = (min((signed[i] >> 32, -i) for i in range(a, min(a + run, len(g)))) for a in range(max(1, len(g) - run + 1)))
    return {(signed[-i], -i) for _, i in least}


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def line_dedup(docs: list[tuple[int, str | None]], min_words: int) -> dict[int, list[int]]:
    """Lines deleted of each document: those that a later copy of a shortest run of min_words words covers."""
    seen: dict[tuple, tuple] = {}
    gone: dict[int, set[int]] = {i: set() for i, _ in docs}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if spaced(x)] if text is not None else []
        for a in range(len(lines)):
            n = b = 0
            for b in range(a, len(lines)):
                n += len(spaced(lines[b][1]))
                if n >= min_words:
                    break
            if n < min_words:
                break
            run = tuple(x for _, x in lines[a : b + 1])
            if seen.setdefault(run, (doc_id, a)) != (doc_id, a):
                gone[doc_id] |= {i for i, _ in lines[a : b + 1]}
    return {i: sorted(x) for i, x in gone.items()}


MASK = (1 << 64) - 1


def mix(h: int) -> int:
    """The 64-bit finaliser of MurmurHash3."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * factor & MASK
    return h ^ h >> 33


def letter_grams(text: str, orders: tuple[int, ...]) -> list[int]:
    """Hashes of the n-grams of a text's lower-cased words, with one space around each."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} ")
    plain = re.sub(" +", " ", low)
    out = []
    for order in orders:
        for i in range(len(plain) - order + 1):
            h = order
            for c in plain[i : i + order]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) & MASK
            out.append(mix(h))
    return out


def next_log10(model, ids, context: int, step: int, groups: int, side: int) -> list[float]:
    """log10 probability of each id of one text, one place at a time."""
    import numpy as np

    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    before, out = [0, *model.class_of[ids].tolist()], []
    for i, wanted in enumerate(model.class_of[ids].tolist()):
        low = i // step * step - context
        seen = [j for j in range(low, i + 1) if j >= 0]
        x = np.stack([w["E"][before[j]] + w["P"][j - low] for j in seen])
        s = (x @ w["K"]) @ (x[-1] @ w["Q"]) / w["Q"].shape[0] ** 0.5
        s = np.exp(s - s.max())
        h = x[-1] + (s / s.sum()) @ (x @ w["V"]) @ w["O"]
        z = h + np.maximum(h @ w["A"] + w["a"], 0) @ w["B"]
        g, m = divmod(wanted, side)
        soft = lambda y, at: y[at] - y.max() - np.log(np.exp(y - y.max()).sum())
        out.append((soft(z @ w["G"] + w["g"], g) + soft(z @ w["U"][g] + w["b"][g], m)) / np.log(10) + model.tail[ids[i]])
    return out


def licence_labels(docs: list[tuple[int, str | None]], templates, base, rare: int, weight: float, cover: float) -> dict[int, set[str]]:
    """Labels of the phrases, and of the templates of which enough weight, words and all phrases stand at one start."""
    import math

    words = {i: alnum(t) for i, t in docs}
    n = {w: sum(w in set(ws) for ws in words.values()) for _, t, _ in templates for w in t.split()}
    idf = {w: math.log1p(len(docs) / (k + 1)) for w, k in n.items()}
    holds = lambda ws, p: any(ws[i : i + len(p)] == p for i in range(len(ws) - len(p) + 1))
    out = {}
    for i, ws in words.items():
        out[i] = {label for phrase, label in base if holds(ws, phrase.split())}
        for label, t, phrases in templates:
            t = t.split()
            need = weight * sum(sorted((idf[w] for w in set(t)), reverse=True)[:rare])
            for start in range(1 - len(t), len(ws)):
                met = [w for j, w in enumerate(t) if 0 <= start + j < len(ws) and ws[start + j] == w]
                inside = ws[max(0, start) : start + len(t)]
                if met and sum(idf[w] for w in met) >= need - 1e-9 and len(met) >= cover * len(t) and all(holds(inside, p.split()) for p in phrases):
                    out[i].add(label)
                    break
    return out
