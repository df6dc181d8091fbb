"""Plain Python versions of the corpus operators, for small inputs."""

import re


def near_duplicates(docs, percent=85):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def repeats(docs, length=100):
    import hashlib

    seen, out = set(), {}
    for i, text in sorted(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if w in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def contamination(docs, items, window=10):
    """Per doc: n_words, n_hit, and the ids of items with occurring windows."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = lambda t: word.findall((t or "").translate(low))
    windows = {}
    for i, t in items:
        w = of(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(n, {}).setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, who = of(t), set(), set()
        for n, known in windows.items():
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in known:
                    hit |= set(range(s, s + n))
                    who |= known[tuple(w[s : s + n])]
        out.append((d, len(w), len(hit), sorted(str(x) for x in who if x is not None)))
    return out
