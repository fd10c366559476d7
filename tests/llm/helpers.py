"""Brute-force versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def components(docs):
    """doc_id -> smallest linked doc_id, of (doc_id, text) pairs with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((find(x), find(y)))
                    parent[b] = a
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def cut_repeats(texts, span=200):
    """For each text: bytes, removed, runs, what is left."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        left = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, left, hashlib.sha256(left).hexdigest()))
    return out


def quality(text):
    words = WORD.findall(text or "")
    grams = list(zip(words, words[1:], words[2:], strict=False))
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def places(rows):
    """Checks that pieces fill their sequences without gaps or overlaps; returns pieces by document."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append(r)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return documents


def flac_samples(media):
    """A plain FLAC reader, bit by bit: the signed samples of each frame of a file with one channel of 8 bits, and where each frame begins."""
    assert media[:4] == b"fLaC"
    at, last = 4, False
    while not last:
        last, size = bool(media[at] & 0x80), int.from_bytes(media[at + 1 : at + 4], "big")
        at += 4 + size
    first, frames = at, []
    while at < len(media):
        begin, bits, place = at, "".join(f"{b:08b}" for b in media[at : at + 4000]), 0

        def take(n):
            nonlocal place
            place += n
            return int(bits[place - n : place], 2) if n else 0

        def signed(n):
            value = take(n)
            return value - (1 << n) if n and value >> (n - 1) else value

        assert take(14) == 0b11111111111110
        take(2)
        assert take(4) == 2 and take(4) == 4 and take(8) == 0x02  # 576 samples, 8 kHz, mono of 8 bits
        lead = f"{take(8):08b}"
        take(8 * max(0, lead.index("0") - 1))  # the rest of the frame number
        take(8)
        assert take(1) == 0
        kind = take(6)
        assert take(1) == 0
        if kind == 0:
            out = [signed(8)] * 576
        elif kind == 1:
            out = [signed(8) for _ in range(576)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            out = [signed(8) for _ in range(order)]
            shift, weights = 0, [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)][order] if kind < 32 else ()
            if kind >= 32:
                precision, shift = take(4) + 1, signed(5)
                weights = [signed(precision) for _ in range(order)]
            width, parts = (4, 5)[take(2)], 1 << take(4)
            for part in range(parts):
                k = take(width)
                for _ in range(576 // parts - (order if part == 0 else 0)):
                    q = bits.index("1", place) - place
                    place += q + 1
                    u = (q << k) | take(k)
                    out.append((u >> 1 if u % 2 == 0 else -(u + 1) // 2) + (sum(w * out[-1 - j] for j, w in enumerate(weights)) >> shift))
        place += -place % 8 + 16
        at += place // 8
        frames.append((begin - first, out))
    return frames
