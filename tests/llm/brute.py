"""The operators in plain Python, one document after the other."""

import hashlib
import math
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def letters(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def decontaminated(docs, items, n=10):
    """(words, words hit, items) of each text."""
    windows = defaultdict(set)
    for item, text in items:
        w = letters(text)
        k = min(n, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j : j + k])].add(str(item))
    sizes, out = {len(w) for w in windows}, []
    for text in docs:
        w, hit, found = letters(text), set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    hit.update(range(j, j + k))
                    found |= windows[tuple(w[j : j + k])]
        out.append((len(w), len(hit), sorted(found)))
    return out


def shingles(text, size):
    w = [x.translate(LOWER) for x in words(text)]
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def components(docs, size, percent):
    """{doc_id: least doc_id that links reach}; docs: {doc_id: text}."""
    sets = {i: shingles(t, size) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def counts(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    repeated = {p for i, x in enumerate(windows) if often[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def without_boilerplate(docs, ratio):
    """Texts of docs [(source, text)] without lines that other pages of the source have, over ratio of its different texts."""
    blanks, pages, on = " \t\n\x0b\f\r", defaultdict(set), defaultdict(set)
    for s, t in docs:
        pages[s].add(t or "")
        for x in (t or "").split("\n"):
            on[s, x.strip(blanks)].add(t)
    bad = {(s, x) for (s, x), n in on.items() if x and len(n) - 1 > ratio * len(pages[s])}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(blanks)) not in bad) for s, t in docs]


def targets(sizes, weights=(5, 2, 1)):
    """{source: target} of {source: size}: poured out by weight until none is over three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        rest = sum(w[s] for s in order if s not in stopped)
        out = {s: 3 * sizes[s] if s in stopped else w[s] * left / rest for s in order}
        over = {s for s in order if s not in stopped and out[s] > 3 * sizes[s]}
        if not over:
            return out
        stopped |= over


def mixed(docs, slots=65536, most=4096):
    """[(size, source's size, target, taken)] of docs [(doc_id, source, text)]."""
    size = [len(words(t)) for _, _, t in docs]
    by = Counter()
    for (_, s, _), n in zip(docs, size, strict=True):
        by[s] += n
    if not sum(by.values()):
        return [(0, 0, 0.0, 0) for _ in docs]
    target, total = targets(by), sum(by.values())
    block = max(1, min(most, total // slots))
    edges, low = [], 0.0
    for s in sorted(by, key=lambda s: (s is None, s or "")):
        edges.append((s, low, low + target[s] / total))
        low += target[s] / total
    dealt = Counter()
    for i in range(-(-total // block)):
        u = (i * 0.6180339887498949) % 1.0
        dealt[next((s for s, a, b in edges if a <= u < b), edges[-1][0])] += 1
    place, out = Counter(), [None] * len(docs)
    key = lambda i: (hashlib.md5(str(docs[i][0]).encode()).hexdigest(), docs[i][0], size[i])
    for i in sorted(range(len(docs)), key=key):
        s, n = docs[i][1], size[i]
        blocks = math.ceil(by[s] / block)
        k = min(dealt[s], 3 * blocks)
        whole, part = divmod(k, blocks) if blocks else (0, 0)
        out[i] = (n, by[s], target[s], n * whole + max(0, min(n, part * block - place[s])))
        place[s] += n
    return out


KINDS = {
    "assign": (re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def secrets(text):
    found = [(m.start(), p, m.end(), k) for p, (k, (r, good)) in enumerate(KINDS.items()) for m in r.finditer(text or "") if good(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
