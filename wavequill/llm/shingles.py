"""Sets of word shingles, their parity sketches and the keys by which similar sets meet. In numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .hashing import BY_SPACE, chunks, mix, word_hashes

U = np.uint64
#: Bytes of text, about, that a worker holds the shingles of; a longer text is held alone.
PART = 1 << 22


def parts(batch, column: str = "text"):
    """Slices of an Arrow batch with about PART bytes in its column of texts each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    part = np.cumsum(sizes) // PART
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the sorted different hashes of its shingles of size words; fewer words are one shingle, none no shingle."""
    out, factors = [], mix(np.arange(1, size + 1, dtype=np.uint64)) | U(1)
    for a, b in chunks(texts):
        hashes, at = word_hashes(texts[a:b], BY_SPACE)
        if len(hashes) >= size:
            rolled = sum(hashes[i : len(hashes) - size + 1 + i] * factors[i] for i in range(size))
            rolled = mix(rolled)
        for i in range(b - a):
            x, y = at[i], at[i + 1]
            if y - x >= size:
                out.append(np.unique(rolled[x : y - size + 1]))
            elif y > x:
                out.append(mix((hashes[x:y] * factors[: y - x]).sum(dtype=np.uint64, keepdims=True) + U(y - x)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set, as two arrays; zeros for empty ones."""
    one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    full = np.flatnonzero([len(s) for s in sets])
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        begins = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        one[full] = np.bitwise_xor.reduceat(mix(flat + U(1)), begins)
        two[full] = np.add.reduceat(mix(flat + U(2)), begins)
    return one, two


@dataclass(frozen=True)
class Scheme:
    """For pairs whose larger set has lo to hi - 1 shingles: these differ in most shingles at most, and have chunks chunks.

    Each differing shingle spoils one chunk, so chunks - most of them agree: one more than spare. A set with at most spare
    empty chunks agrees in one that isn't empty, so it needs no keys of its empty ones.
    """

    number: int
    lo: int
    hi: int
    most: int
    spare: int

    @property
    def chunks(self) -> int:
        return self.most + 1 + self.spare


def _spare(most: int, least_size: int) -> int:
    """As few as let hardly any set have more empty chunks."""
    best = (2.0, 0)
    for s in range(2 * most + 6):
        k = most + 1 + s
        mean = k * math.exp(-least_size / k)
        term = total = math.exp(-mean)
        for i in range(1, s + 1):
            term *= mean / i
            total += term
        best = min(best, (max(0.0, 1 - total), s))
        if 1 - total < 1e-3:
            return s
    return best[1]


class Bands:
    """The size bands of sets and their schemes, for pairs of at least percent similarity (Jaccard).

    A band is wide enough that a pair's sizes are in one band or neighbours. A set has the keys of its own scheme, and of the
    next if a set there could be similar.
    """

    def __init__(self, percent: int):
        self.percent, self.schemes = percent, []

    def scheme(self, number: int) -> Scheme:
        while len(self.schemes) <= number:
            lo = self.schemes[-1].hi if self.schemes else 1
            hi = max(lo + 1, -(-lo * 100 * 100 // self.percent**2))
            most = 2 * (hi - 1) * (100 - self.percent) // (100 + self.percent)
            self.schemes.append(Scheme(len(self.schemes), lo, hi, most, _spare(most, max(1, -(-lo * self.percent // 100)))))
        return self.schemes[number]

    def of(self, n: int) -> list[Scheme]:
        t = 0
        while self.scheme(t).hi <= n:
            t += 1
        own, above = self.scheme(t), self.scheme(t + 1)
        return [own, above] if 100 * n >= self.percent * above.lo else [own]

    def apart(self, n: int, scheme: Scheme) -> int:
        """In how many shingles at most a set of n differs from a similar one whose scheme with it is this."""
        other = min(scheme.hi - 1, n * 100 // self.percent)
        return (n + other) * (100 - self.percent) // (100 + self.percent)


def _chunk(s: np.ndarray, number, chunks) -> np.ndarray:
    """The chunk of each shingle in a scheme of this number and so many chunks."""
    salt = mix(np.asarray(number, np.uint64) + U(1))
    return ((mix(s ^ salt) >> U(32)) * np.asarray(chunks, np.uint64) >> U(32)).astype(np.int64)


def _chunk_keys(s: np.ndarray, doc: np.ndarray, chunks: np.ndarray, numbers: np.ndarray, space: int):
    """(keys, empty, begins): a key for each chunk of each set, the XOR of the hashes in it, so that equal parts have equal keys.

    s: the shingles of all sets, and doc: which set each is of. The keys of set i begin at begins[i].
    """
    begins = np.concatenate([[0], np.cumsum(chunks)])
    slot = begins[doc] + _chunk(s, numbers[doc], chunks[doc])
    xor = np.zeros(begins[-1], np.uint64)
    np.bitwise_xor.at(xor, slot, s)
    of = np.repeat(np.arange(len(chunks)), chunks)
    place = ((np.arange(begins[-1]) - begins[of]).astype(np.uint64) << U(16)) + U(2) * numbers[of].astype(np.uint64) + U(space)
    # The last two bits tell the scheme from its neighbours, of which a set has keys too, and the space.
    key = (mix(mix(xor) + mix(place)) & ~U(3)) | (numbers[of].astype(np.uint64) & U(1)) | U(2 * space)
    return key, np.bincount(slot, minlength=begins[-1]) == 0, begins


def keys_of(sets: list[np.ndarray], bands: Bands, hot: Hot) -> tuple[list[np.ndarray], np.ndarray]:
    """(the keys of each set, needs): of its cold shingles' chunks, and where too many of these are empty of all shingles' too.

    Leaving out the same shingles everywhere never adds to a difference, so what holds for whole sets holds for their cold
    parts. Two similar sets meet in a chunk of cold shingles if either has enough of them, else both have the other keys.
    needs[i, g]: of its keys k with k & 3 = g, a set shares so many at least with every similar set that it meets by them.
    """
    found, needs = [[] for _ in sets], np.ones((len(sets), 4), np.int16)
    if not any(map(len, sets)):
        return [np.zeros(0, np.uint64) for _ in sets], needs
    flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cold = hot.cold(flat)
    schemes = [bands.of(len(s)) if len(s) else [] for s in sets]
    for which in (0, 1):
        at = [i for i, x in enumerate(schemes) if len(x) > which]
        for space in (0, 1):
            if not at:
                break
            place = np.full(len(sets), -1)
            place[at] = np.arange(len(at))
            mine = (place[doc] >= 0) & (cold if space == 0 else True)
            chosen = [schemes[i][which] for i in at]
            chunks, numbers = np.array([x.chunks for x in chosen]), np.array([x.number for x in chosen])
            key, empty, begins = _chunk_keys(flat[mine], place[doc[mine]], chunks, numbers, space)
            few = []
            for i, scheme, a, b in zip(at, chosen, begins, begins[1:], strict=False):
                k, e = key[a:b], empty[a:b]
                missing = int(e.sum())
                g = (scheme.number & 1) | 2 * space
                needs[i, g] = min(32767, max(1, scheme.chunks - bands.apart(len(sets[i]), scheme) - missing))
                if missing > scheme.spare:
                    few.append(i)
                found[i].append(k if space and missing > scheme.spare else k[~e])
            at = few
    return [np.concatenate([np.zeros(0, np.uint64), *f]) for f in found], needs


class Hot:
    """Membership in a sorted list of hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.maybe = hashes, np.zeros(1 << 20, bool)
        self.maybe[(hashes >> U(44)).astype(np.int64)] = True

    def cold(self, s: np.ndarray) -> np.ndarray:
        cold = np.ones(len(s), bool)
        if len(self.hashes):
            at = np.flatnonzero(self.maybe[(s >> U(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.hashes, s[at]), len(self.hashes) - 1)
            cold[at[self.hashes[place] == s[at]]] = False
        return cold


def sketch(s: np.ndarray, scheme: Scheme) -> np.ndarray:
    """16 bits a chunk; each shingle flips one. The Hamming distance of two is at most the symmetric difference of the sets."""
    words = np.zeros(scheme.chunks, np.uint16)
    np.bitwise_xor.at(words, _chunk(s, scheme.number, scheme.chunks), (U(1) << (s & U(15))).astype(np.uint16))
    return words


def sketches_allow(a: list[np.ndarray], b: list[np.ndarray], n_a: int, n_b: int, bands: Bands) -> bool:
    """Whether sets with these sketches (of their schemes) and sizes can be similar."""
    if 100 * min(n_a, n_b) < bands.percent * max(n_a, n_b):
        return False
    of_a, of_b = bands.of(n_a), bands.of(n_b)
    number = max(of_a[0].number, of_b[0].number)
    x = next((w for s, w in zip(of_a, a, strict=True) if s.number == number), None)
    y = next((w for s, w in zip(of_b, b, strict=True) if s.number == number), None)
    if x is None or y is None:
        return False
    return int(np.bitwise_count(x ^ y).sum()) <= (n_a + n_b) * (100 - bands.percent) // (100 + bands.percent)


def close_pairs(members: list[dict], between: bool, percent: int) -> list[tuple[int, int]]:
    """Pairs of doc_ids of members (doc_id, n, root, sketch, block) that differ in root and whose sketches, all of one scheme,
    allow that they are similar; between: only of different blocks."""
    if len({m["root"] for m in members}) < 2:
        return []
    sketches = np.stack([np.frombuffer(m["sketch"], np.uint16) for m in members])
    doc, n, root, block = (np.array([m[c] for m in members]) for c in ("doc_id", "n", "root", "block"))
    out = []
    for i in range(len(members) - 1):
        j = slice(i + 1, None)
        fits = (root[j] != root[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))
        if between:
            fits &= block[j] != block[i]
        at = np.flatnonzero(fits) + i + 1
        if len(at):
            apart = np.bitwise_count(sketches[at] ^ sketches[i]).sum(axis=1, dtype=np.int64)
            out += [(doc[i].item(), doc[k].item()) for k in at[apart <= (n[at] + n[i]) * (100 - percent) // (100 + percent)]]
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, of sorted different hashes."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0
