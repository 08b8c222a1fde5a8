"""Plain-Python versions of what the operators must return, written from the contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import regex

from sievework.llm import pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    out = []
    for rank, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def base_sha(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in base_spans(text)).encode()).hexdigest()


def _plain(text: str) -> list[str]:
    """Words in lower case without the punctuation around them; a label keeps one colon."""
    out = []
    for w in WORD.findall(text):
        w = re.sub(r"[:=]+$", ":", w.lower())
        w = regex.sub(rf"{pii._MARK}+$", "", w)
        w = regex.sub(rf"^{pii._MARK}+", "", w)
        if w:
            out.append(w)
    return out


def _slot_patterns(two: str | None, one: str | None, nxt: str | None) -> list[str]:
    out = [f"L {one}"] if one and one.endswith(":") and regex.search(r"\p{L}", one) else []
    out += [f"LL {two} {one}"] if two is not None and one is not None else []
    return out + ([f"LR {one} _ {nxt}"] if one is not None and nxt is not None else [])


def bootstrap(texts: list[str], support: int = 3, confidence: float = 0.5, score: float = 0.6) -> dict[int, list[tuple[str, str]]]:
    """Text number → (kind, value as written) of all values found beyond the fixed patterns, in order of place."""
    around = lambda t, s, e: ((_plain(t[:s])[-2:-1] or [None])[0], (_plain(t[:s])[-1:] or [None])[0], (x := (_plain(t[e:])[:1] or [None])[0]) and x.rstrip(":"))
    kinds, seeds, places, slots = list(BASE), {}, [], defaultdict(set)
    for i, t in enumerate(texts):
        base = base_spans(t)
        for s, _, kind, e in base:
            value = " ".join(_plain(t[s:e])).rstrip(":")
            for p in _slot_patterns(*around(t, s, e)):
                seeds[p, value] = max(kind, seeds.get((p, value), ""))
        for m in regex.finditer(pii.CANDIDATE, t):
            v = m[0].lower()
            if any(regex.search(x, v) for x in pii.SHAPES.values()) and not any(s < m.end() and m.start() < e for s, _, _, e in base):
                places.append((i, m[0], v, _slot_patterns(*around(t, m.start(), m.end()))))
        ws = _plain(t)
        for k, w in enumerate(ws):
            for p in _slot_patterns(ws[k - 2] if k > 1 else None, ws[k - 1] if k else None, ws[k + 1].rstrip(":") if k + 1 < len(ws) else None):
                slots[p].add(w.rstrip(":"))
    found: dict[str, str] = {}
    while True:
        edges = dict(seeds)
        for _, _, v, ps in places:
            for p in ps:
                if v in found:
                    edges[p, v] = max(found[v], edges.get((p, v), ""))
        trust = {}
        for p in {p for p, _ in edges}:
            per = Counter(k for (q, _), k in edges.items() if q == p)
            f, kind = max((n, k) for k, n in per.items())
            if f >= support:
                firsts = {(_plain(v)[:1] or [""])[0].rstrip(":") for q, v in edges if q == p}
                c = f / (f + len(slots[p] - firsts))
                if c >= confidence:
                    trust[p] = (kind, c)
        doubt: dict[tuple[str, str], float] = defaultdict(lambda: 1.0)
        for v, p in {(v, p) for _, _, v, ps in places for p in ps if v not in found and p in trust}:
            if regex.search(pii.SHAPES[trust[p][0]], v):
                doubt[v, trust[p][0]] *= max(1e-9, 1 - trust[p][1])
        new: dict[str, tuple[float, str]] = {}
        for (v, k), d in doubt.items():
            new[v] = max((1 - d, k), new.get(v, (0.0, "")))
        new = {v: k for v, (x, k) in new.items() if x >= score - 1e-12}
        if not new:
            break
        found |= new
    assert set(found.values()) <= set(kinds)
    return {i: [(found[v], w) for j, w, v, _ in places if j == i and v in found] for i in range(len(texts))}


def quality_base(text: str | None) -> dict:
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "base_failed": failed}


def shingle_set(text: str | None, size: int) -> frozenset:
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near_components(rows: list[tuple[int, str | None]], size: int) -> dict[int, tuple[int, int]]:
    """doc_id → (set size, component), every pair that shares a shingle compared."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    held, parent = defaultdict(list), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shared: dict[int, Counter] = {}
    for i in sorted(sets):
        c = Counter(j for s in sets[i] for j in held[s])
        for s in sets[i]:
            held[s].append(i)
        shared[i] = c
        for j, n in c.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def substring(rows: list[tuple[int, str | None]], window: int) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    ws = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(ws):
        for k in range(len(ws[i]) - window + 1):
            first.setdefault(tuple(ws[i][k : k + window]), i)
    out = {}
    for i, w in ws.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def bm25_hits(texts: list, items: list, threshold: float, overlap: float, answer_overlap: float) -> list[tuple]:
    """(doc_id, item_id, score) by scoring every item on every passage of its length class."""
    words = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    all_items = [(i, t, words(t)) for i, t in items if words(t)]
    n, mean = len(all_items), sum(len(w) for _, _, w in all_items) / len(all_items)
    df = Counter(t for _, _, w in all_items for t in set(w))
    out = []
    for d, text in texts:
        ws, best = words(text), {}
        for i, t, w in all_items:
            tf, norm = Counter(w), 1.2 * (0.25 + 0.75 * len(w) / mean)
            weight = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * k * 2.2 / (k + norm) for x, k in tf.items()}
            m = re.match(r"(?s)(.*[.!?])\s+(\S.*)$", t.strip())
            q, a = (words(m[1]), set(words(m[2]))) if m else (w, set())
            if len(q) < 5:
                q, a = w, set()
            size = min(5, len(q))
            grams = lambda x, k=size: {tuple(x[j : j + k]) for j in range(len(x) - k + 1)}
            stride = 64
            while stride < len(w):
                stride *= 2
            for lo in range(0, max(1, len(ws) - stride), stride):
                p = ws[lo : lo + 2 * stride]
                score = sum(x for y, x in weight.items() if y in set(p)) / sum(weight.values())
                if score < threshold or len(grams(q) & grams(p)) < overlap * len(grams(q)) or len(a & set(p)) < answer_overlap * len(a):
                    continue
                best[i] = max(score, best.get(i, 0.0))
        out += [(d, i, s) for i, s in best.items()]
    return out


def exact_groups(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, keep_id, group_size, kept, sha256) of every row."""
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k, i))
    out = []
    for bare, members in groups.items():
        top = min(members)
        out += [(m[4], top[4], len(members), m is top or m[3] == top[3], hashlib.sha256(bare.encode()).hexdigest()) for m in members]
    return out


def resampled(rows: list[tuple[int | None, str | None]], target: list[str | None], percent: int = 25, min_words: int = 20) -> list[tuple]:
    """(doc_id, n_features, weight, score, rank) of every row."""

    def buckets(text: str | None) -> tuple[int, list[int]]:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        return len(ws), [zlib.crc32(f.encode()) % 10_000 for f in [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))]]

    each = [buckets(t) for _, t in rows]
    s, t = Counter(b for _, bs in each for b in bs), Counter(b for x in target for b in buckets(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    out = []
    for (i, _), (n, bs) in zip(rows, each):
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def planted(doc_id: int | None, text: str | None) -> list[str]:
    ws = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not ws:
        return ws
    g, n = h // 10, len(ws)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def periodic_runs(ws: list[str], exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period: for every period the stretches equal to themselves shifted, of
    which those that have a smaller period go."""
    number = {w: k for k, w in enumerate(dict.fromkeys(ws))}
    ids, out = np.array([number[w] for w in ws], np.int64), {}
    for q in range(1, len(ids) // exponent + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        start, end = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(~same[1:] & same[:-1])
        for s, e in zip(start.tolist(), end.tolist()):
            if e - s + q >= max(least, exponent * q):
                out.setdefault((s, e - s + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(ws: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def op13_row(doc_id: int | None, text: str | None) -> tuple:
    ws = planted(doc_id, text)
    runs = periodic_runs(ws)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(collapsed(ws, runs)))
