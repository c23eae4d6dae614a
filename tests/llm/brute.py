"""Plain versions of the operators' contracts, for small fixtures."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def held(doc_id: int, modulus: int, rest: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def rules(text: str | None) -> dict:
    t = text or ""
    w = WORD.findall(t)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(five)
    inside = {j for i, x in enumerate(five) if c[x] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(x in "#*$%&|<>" for x in t), "n_dup_lines": dup, "n_repeat_words": len(inside),
        "base_failed": len(w) < 10 or 100 * len(inside) > 20 * len(w),
    }


def coverage(text: str | None, n: int) -> float:
    w = WORD.findall(text or "")
    g = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    seen, inside = set(), set()
    for i, x in enumerate(g):
        if x in seen:
            inside.update(range(i, i + n))
        seen.add(x)
    return sum(len(w[j]) for j in inside) / max(1, sum(map(len, w)))


def dup_line_chars(text: str | None) -> int:
    seen, n = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            n += sum(map(len, WORD.findall(line))) if line in seen else 0
            seen.add(line)
    return n


def kept(text: str | None, limits: dict[int, float], line_limit: float, symbol_limit: float) -> bool:
    r = rules(text)
    return (
        not r["base_failed"] and all(coverage(text, n) <= x for n, x in limits.items())
        and dup_line_chars(text) <= line_limit * r["word_chars"] and r["n_symbols"] <= symbol_limit * max(1, r["word_chars"])
    )


def simhash(text: str | None) -> int:
    w = WORD.findall(lower(text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(ids: list[int], prints: list[int], radius: int = 2) -> tuple[list[int], list[int]]:
    f = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    label = np.array(ids)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return (near.sum(axis=1) - 1).tolist(), label.tolist()
        label = new


def water(sizes: dict, weights: dict, most: int = 3) -> dict:
    """Capped shares by repeated clamping."""
    total, clamped, level = sum(sizes.values()), set(), 0.0
    while True:
        free = [s for s in sizes if s not in clamped]
        if not free:
            break
        level = (total - sum(most * sizes[s] for s in clamped)) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > most * sizes[s]}
        if not over:
            break
        clamped |= over
    return {s: float(most * sizes[s]) if s in clamped else weights[s] * level for s in sizes}


def backoff_scores(texts: dict[int, str | None], priors: tuple[float, ...]):
    """(n_tokens, n_known, train_tokens, base_score, score) by document, by recursion over shorter and shorter contexts."""
    tok = {i: [*WORD.findall(lower(t or "")), None] for i, t in texts.items()}
    seen = Counter()
    for i, w in tok.items():
        if not held(i, 5, 1):
            s = ["<s>", *w]
            seen.update(tuple(s[a : a + n]) for n in range(1, len(priors) + 2) for a in range(len(s) - n + 1))
    starts = seen.pop(("<s>",), 0)
    n, v = sum(c for g, c in seen.items() if len(g) == 1), sum(len(g) == 1 for g in seen)

    def p(context: tuple, x) -> float:
        if not context:
            return (seen[(x,)] + 0.5) / (n + 0.5 * (v + 1))
        total = starts if context == ("<s>",) else seen[context]
        prior = priors[len(context) - 1]
        if not seen[context + (x,)]:
            return prior / (total + prior) * p(context[1:], x)
        return (seen[context + (x,)] + prior * p(context[1:], x)) / (total + prior)

    out = {}
    for i, w in tok.items():
        s = ["<s>", *w]
        score = sum(math.log10(p(tuple(s[max(0, a - len(priors)) : a]), s[a])) for a in range(1, len(s)))
        out[i] = (len(w), sum(seen[(x,)] > 0 for x in w), n, sum(math.log10(p((), x)) for x in w), score)
    return out
