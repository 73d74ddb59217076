"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWEST = -(1 << 63)


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality(text):
    text = text or ""
    ws = words(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = set()
    for i in range(len(ws) - 4):
        if grams[tuple(ws[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    chars, symbols = sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>")
    dup, repeats = len(lines) - len(set(lines)), len(covered)
    base = len(ws) < 10 or 100 * repeats > 20 * len(ws)
    kept = (not base and 100 * symbols <= 10 * len(ws) and 100 * dup <= 30 * (text.count("\n") + 1)
            and 3 * len(ws) <= chars <= 12 * len(ws))
    return len(ws), chars, symbols, dup, repeats, base, kept


def line_dedup(docs, min_lines=2, min_words=20):
    """docs: (id, text) with distinct ids; {id: (text, n_lines, n_removed)}."""
    seen, single, out = set(), set(), {}
    for name, text in sorted(docs, key=lambda d: LOWEST if d[0] is None else d[0]):
        lines = (text or "").split("\n")
        at = [k for k, line in enumerate(lines) if WORD.search(line)]
        drop = set()
        for i in range(len(at) - min_lines + 1):
            window = at[i : i + min_lines]
            run = tuple(lines[k] for k in window)
            if run in seen:
                drop.update(window)
            seen.add(run)
        for k in at:
            if len(words(lines[k])) >= min_words and lines[k] in single:
                drop.add(k)
            single.add(lines[k])
        out[name] = ("\n".join(x for k, x in enumerate(lines) if k not in drop), len(at), len(drop))
    return out


def shingles(text, size):
    ws = words(fold(text))
    if not ws:
        return frozenset()
    size = min(size, len(ws))
    return frozenset(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))


def near(docs, size):
    """{id: (n_shingles, component)} for (id, text) with distinct ids."""
    sets = {name: shingles(text, size) for name, text in docs}
    root = {name: name for name in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {name: (len(sets[name]), find(name)) for name in names}


def passages(docs, size=20):
    """{id: (n_words, n_removed, kept)}."""
    seen, out = set(), {}
    for name, text in sorted(docs, key=lambda d: LOWEST if d[0] is None else d[0]):
        ws, drop = words(text), set()
        for i in range(len(ws) - size + 1):
            window = tuple(ws[i : i + size])
            if window in seen:
                drop.update(range(i, i + size))
            seen.add(window)
        out[name] = (len(ws), len(drop), " ".join(w for k, w in enumerate(ws) if k not in drop))
    return out


def capped_split(budget, children):
    """{name: share} of (name, capacity, weight): fill by rounds until nothing is over."""
    got, left, open_ = {}, budget, dict((n, (c, w)) for n, c, w in children)
    while open_:
        total = sum(w for _, w in open_.values())
        if total == 0:
            for n, (c, _) in sorted(open_.items()):
                got[n] = min(c, max(left, 0))
                left -= got[n]
            break
        full = [n for n, (c, w) in open_.items() if c <= left * w / total]
        if not full:
            got |= {n: left * w / total for n, (_, w) in open_.items()}
            break
        for n in full:
            got[n] = open_.pop(n)[0]
            left -= got[n]
    return got


def mixture(rows, weights, share, epochs, seed):
    """{id: copies} for rows (id, domain, lang, source, tokens)."""
    tokens = defaultdict(int)
    for _, d, la, s, n in rows:
        tokens[d, la, s] += n
    given = {(): int(sum(tokens.values()) * share)}
    for depth, level in enumerate(("domain", "lang", "source")):
        below = defaultdict(int)
        for leaf, n in tokens.items():
            below[leaf[: depth + 1]] += n * epochs
        nxt = {}
        for parent, budget in given.items():
            kids = [(k[depth], c, weights.get(level, {}).get(k[depth], 1.0)) for k, c in below.items() if k[:depth] == parent]
            for name, got in capped_split(budget, kids).items():
                nxt[(*parent, name)] = int(got + 1e-6)
        given = nxt
    out, leaves = {}, defaultdict(list)
    for name, d, la, s, n in rows:
        leaves[d, la, s].append((name, n))
    for leaf, held in leaves.items():
        whole, rest = divmod(given[leaf], tokens[leaf]) if tokens[leaf] else (0, 0)
        before = 0
        for name, n in sorted(held, key=lambda h: hashlib.md5(f"{seed}:{whole}:{h[0]}".encode()).hexdigest()):
            out[name] = whole + (before < rest)
            before += n
    return out


def runs(ws, least=6, copies=4):
    """[(start, length, period)] straight from the definition."""
    found = []
    for q in range(1, len(ws) // copies + 1):
        s = 0
        while s + q < len(ws):
            e = s
            while e + q < len(ws) and ws[e] == ws[e + q]:
                e += 1
            length = e - s + q
            if e > s and length >= max(least, copies * q):
                part = ws[s : s + length]
                if all(any(part[i] != part[i + p] for i in range(length - p)) for p in range(1, q)):
                    found.append((s, length, q))
            s = e + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(ws, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def phrases(docs, floor, longest, cover, top):
    """Rows of the collocation table for (text, lang)."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", fold(text)):
            ws = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(ws)
            for size in range(1, longest + 1):
                for i in range(len(ws) - size + 1):
                    counts[lang][tuple(ws[i : i + size])] += 1
    out = []
    for lang, held in counts.items():
        often = {p: a for p, a in held.items() if len(p) > 1 and a >= floor}
        rows = []
        for p, a in often.items():
            score, k = min((10**6 * a * a // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for o, b in often.items() if len(o) > len(p) and any(o[i : i + len(p)] == p for i in range(len(o)))]
            if not any(100 * b >= cover * a for b in longer):
                rows.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def contaminated(docs, items, size=10):
    """[(n_words, hit words as text, items)] for texts and (item, text)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for name, text in items:
        ws = word.findall(fold(text))
        for i in range(max(len(ws) - size, 0) + 1 if ws else 0):
            windows[tuple(ws[i : i + size])].add(name)
    out = []
    for text in docs:
        ws, hit, names = word.findall(fold(text)), set(), set()
        for window, held in windows.items():
            for i in range(len(ws) - len(window) + 1):
                if tuple(ws[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    names |= held
        out.append((len(ws), len(hit), sorted(n for n in names if n is not None)))
    return out
