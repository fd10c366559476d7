"""Distinct sampled segmentations of texts with a SentencePiece vocabulary: Gumbel top-k without replacement.

The lattice of a text has an edge for every piece that fits, weighted by the piece's score times ``alpha``; characters without
a piece become their byte pieces. Each segmentation has the log-probability of its path. Adding independent Gumbel noise to
all of them and taking the k largest samples k distinct ones. A perturbed A* search finds these without listing the rest: the
noise of a set's best member is drawn first, and the search follows it down the lattice; at every edge the rest of the set is
left on the frontier with noise cut off at the best member's, and the next sample starts at the frontier's highest node.

Pieces never reach over the start of a word, so lattices are built once for each distinct word of a batch, and the paths of
all words of all texts are drawn in lockstep with numpy; so are the branches of all texts of a round. Random numbers are hashes of the row's key, the sample, the word and
the step: results depend neither on batches nor on partitions.

Each sample has its log-probability, its perturbed value and its inclusion score, the probability 1 - exp(-exp(log p - kappa))
of being among the k, where kappa is the highest value left on the frontier.

Defined results: a null or empty text has no pieces and one sample, the empty one, with score 1. A text with fewer than k
segmentations has all of them, with score 1. Repeated rows get equal samples. Rows with a null key share the key's hash of
null. A very long text is a batch of its own. A text with U+2581, the model's sign for a space, decodes to a space there, and
its round_trip is false. An empty table gives an empty result. Other columns than the key are dropped; result columns replace
key columns of the same name.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget_after, gather, lean, mix, runs_of, small_batches

SAMPLES = 3
ALPHA = 1 / 4000
SPACE = "▁"
LEAST_SCORE = -40_000.0
#: Probabilities and their logs are summed up as multiples of 1 / UNIT.
UNIT = 2.0**36
BATCH_CHARS = 800_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _fixed(x: np.ndarray) -> np.ndarray:
    """Running sums of x from 0 on, as whole numbers, so that sums of a part do not depend on what lies before it."""
    return np.concatenate([[0], np.cumsum(np.rint(x * UNIT).astype(np.int64))])


def _running(x: np.ndarray, since: np.ndarray) -> np.ndarray:
    """For each item the sum from the item number since up to and with it."""
    total = _fixed(x)
    return (total[1:] - total[since]) / UNIT


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Vocabulary:
    """Pieces by rolling hash, their scores, and the bytes they decode to."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(count)]
        plain = [i for i in range(count) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        self.longest = max(len(pieces[i]) for i in plain)
        self.bytes = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in enumerate(self.byte_ids.tolist()):
            self.bytes[i] = bytes([b])
        self.sizes = np.array([len(x) for x in self.bytes], dtype=np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.content = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        hashes = np.array([self._hash(pieces[i]) for i in plain], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(plain, dtype=np.int64)[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.scores = np.maximum([model.get_score(i) for i in range(count)], LEAST_SCORE)
        slot = (self.hashes >> np.uint64(44)).astype(np.int64)  # 2^20 slots, few of them with more than one piece
        self.first = np.full(1 << 20, len(slot), dtype=np.int32)
        self.first[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.crowd = int(np.bincount(slot).max())
        self.hashes = np.append(self.hashes, np.uint64(0))  # the places behind the last piece hold none
        self.ids = np.append(self.ids, -1)

    @staticmethod
    def _hash(piece: str) -> int:
        h = np.zeros(1, dtype=np.uint64)
        for c in piece:
            h = h * _BASE + np.uint64(ord(c) + 1)
        return int(mix(h + np.uint64(len(piece)))[0])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids, -1 where there is none."""
        at = self.first[(hashes >> np.uint64(44)).astype(np.int64)]
        out = np.full(len(hashes), -1, dtype=np.int64)
        some = np.flatnonzero(at < len(self.ids) - 1)
        at, wanted = at[some], hashes[some]
        for _ in range(self.crowd):
            hit = self.hashes[at] == wanted
            out[some[hit]] = self.ids[at[hit]]
            at = np.minimum(at + 1, len(self.ids) - 1)
        return out


_vocabularies: dict[str, Vocabulary] = {}
forget_after(__name__, _vocabularies.clear)


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def words(text: str) -> list[str]:
    """The text as the model sees it, cut before each run of spaces."""
    out, first = [], 0
    for part in text.replace(SPACE, " ").split(" "):
        first += 1
        if part:
            out.append(SPACE * first + part)
            first = 0
    if first:
        out.append(SPACE * first)
    return out


def distinct_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of all texts; the words of one text after the other, as numbers; and how many each text has.

    Texts whose words have single spaces between them are split by Arrow.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = [(t or "").replace(SPACE, " ") for t in texts]
    easy = np.array([bool(t) and "  " not in t and t[0] != " " and t[-1] != " " for t in plain], dtype=bool)
    lists = pc.split_pattern(pa.array([plain[i] for i in np.flatnonzero(easy).tolist()], pa.large_string()), " ")
    coded = pc.list_flatten(lists).dictionary_encode()
    units = [SPACE + w for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
    sizes = np.zeros(len(texts), dtype=np.int64)
    sizes[easy] = np.diff(lists.offsets.to_numpy())
    rest = {i: words(plain[i]) for i in np.flatnonzero(~easy).tolist() if plain[i]}
    known = {w: i for i, w in enumerate(units)} if rest else {}
    for i, own in rest.items():
        sizes[i] = len(own)
        rest[i] = [known.setdefault(w, len(known)) for w in own]
    units += list(known)[len(units) :]
    start, flat = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), dtype=np.int64)
    flat[gather(start[easy], sizes[easy])] = coded.indices.to_numpy()
    for i, own in rest.items():
        flat[start[i] : start[i] + len(own)] = own
    return units, flat, sizes


class Lattice:
    """Edges of many words. Places are numbered through; each word's places end with one behind its last character."""

    def __init__(self, vocab: Vocabulary, units: list[str], alpha: float):
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        self.base = np.cumsum(lengths + 1) - lengths - 1
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        owner = np.repeat(np.arange(len(units)), lengths)
        place = np.arange(len(codes)) + owner  # one place more for each word before
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
        at, rolled, heads, ids = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64), [], []
        for n in range(1, vocab.longest + 1):
            inside = left[at] >= n
            at = at[inside]
            if not len(at):
                break
            rolled = rolled[inside] * _BASE + codes[at + (n - 1)]
            found = vocab.find(mix(rolled + np.uint64(n)))
            hit = np.flatnonzero(found >= 0)
            heads.append(place[at[hit]])
            ids.append(found[hit])
            if n == 1:  # a character without a piece of its own: byte pieces, marked by its code
                odd = np.flatnonzero(found < 0)
                heads[0] = np.concatenate([heads[0], place[odd]])
                ids[0] = np.concatenate([ids[0], -codes[odd].astype(np.int64)])
        # edges by place; those of a place lie in the order of their lengths
        places = int(lengths.sum()) + len(units)
        degree = np.zeros(places, dtype=np.int64)
        for head in heads:
            degree[head] += 1
        self.start = np.concatenate([[0], np.cumsum(degree)])
        edges, filled = int(self.start[-1]), self.start[:-1].copy()
        self.tail, self.piece = np.empty(edges, dtype=np.int64), np.empty(edges, dtype=np.int64)
        for n, (head, own) in enumerate(zip(heads, ids, strict=True), 1):
            slot = filled[head]
            self.tail[slot], self.piece[slot] = head + n, own
            filled[head] += 1
        self.head = np.repeat(np.arange(places), degree)
        piece = self.piece
        odd = np.flatnonzero(piece < 0)
        weight = alpha * vocab.scores[np.maximum(piece, 0)]
        width = 1 + (piece[odd] < -0x80) + (piece[odd] < -0x800) + (piece[odd] < -0x10000)
        weight[odd] = alpha * LEAST_SCORE * width
        # what follows each place, from places one character before the end on
        rest, away = np.zeros(places), np.zeros(places, dtype=np.int64)
        away[place] = left
        order = np.argsort(np.minimum(away, 0x7FFF).astype(np.int16), kind="stable") if places and away.max() <= 0x7FFF else np.argsort(away, kind="stable")
        for a, b in zip(*runs_of(away[order]), strict=True):
            own = order[a:b]
            if not away[own[0]]:
                continue
            total = weight[index := gather(self.start[own], degree[own])] + rest[self.tail[index]]
            starts = np.cumsum(degree[own]) - degree[own]
            high = np.maximum.reduceat(total, starts)
            rest[own] = high + np.log(np.add.reduceat(np.exp(total - np.repeat(high, degree[own])), starts))
        self.log = weight + rest[self.tail] - rest[self.head]
        # the likeliest edge of a place comes first
        full = np.flatnonzero(degree)
        first = self.start[full]
        best = np.repeat(np.maximum.reduceat(self.log, first), degree[full]) if edges else self.log
        likely = np.flatnonzero(self.log == best)
        likely = likely[runs_of(self.head[likely])[0]]
        for column in (self.log, self.tail, self.piece):
            column[likely], column[first] = column[first], column[likely]
        p = np.exp(self.log)
        self.upto = np.maximum(_running(p, self.start[self.head]), p)
        self.upto[self.start[1:][degree > 0] - 1] = 2.0  # rounding leaves no gap at the end
        self.end = self.base + lengths

    def draw(self, here: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each place; likely edges come first, so few steps are needed."""
        edge = self.start[here]
        late = np.flatnonzero(u > self.upto[edge])
        while len(late):
            edge[late] += 1
            late = late[u[late] > self.upto[edge[late]]]
        return edge


def _walk(lattice: Lattice, here: np.ndarray, end: np.ndarray, seed: np.ndarray, step: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A free path from each place to its end, all in lockstep: the edges of one after the other, and how many each has."""
    here, counts, parts = here.copy(), np.zeros(len(here), dtype=np.int64), []
    alive = np.flatnonzero(here < end)
    while len(alive):
        edge = lattice.draw(here[alive], _uniform(seed[alive] + np.uint64(step) * _M2))
        parts.append((alive, edge))
        counts[alive] += 1
        here[alive] = lattice.tail[edge]
        alive = alive[here[alive] < end[alive]]
        step += 1
    start, out = np.cumsum(counts) - counts, np.empty(int(counts.sum()), dtype=np.int64)
    for number, (own, edge) in enumerate(parts):
        out[start[own] + number] = edge
    return out, counts


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _cut_gumbel(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel noise at a location, given that it is below top: arrival times have no memory."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-top, np.log(-np.log(u)) - location)


class Round:
    """The samples that one round has drawn, of several texts, one text after the other.

    texts: their numbers; edges and frontier (the perturbed value of what was left beside each edge) with offsets; starts: where
    each word begins, absolute in edges, with word_offsets; branch (within the text's edges), banned edges there, -1 for none.
    """

    __slots__ = ("banned", "branch", "edges", "frontier", "log", "offsets", "starts", "texts", "value", "word_offsets")

    def highest(self, count: int) -> np.ndarray:
        """The highest value on the frontier of each of count texts; -inf without a sample."""
        out = np.full(count, -np.inf)
        out[self.texts] = np.maximum.reduceat(self.frontier, self.offsets[:-1])
        return out


def _other_edges(lattice: Lattice, edge: np.ndarray, banned: np.ndarray, u: np.ndarray) -> np.ndarray:
    """An edge beside each given one, from the same place, that is not banned."""
    here = lattice.head[edge]
    counts = lattice.start[here + 1] - lattice.start[here]
    flat, owner = gather(lattice.start[here], counts), np.repeat(np.arange(len(edge)), counts)
    free = (flat[:, None] != banned[owner]).all(1)
    p = np.where(free, np.exp(lattice.log[flat]), 0.0)
    first = _offsets(counts)[:-1]
    upto = _running(p, first[owner])
    total = upto[first + counts - 1]
    pick = first + np.bincount(owner, (upto < (u * total)[owner]).astype(np.float64), minlength=len(edge)).astype(np.int64)
    last = np.maximum.reduceat(np.where(free, np.arange(len(flat)), -1), first)
    pick = np.minimum(pick, last)
    # rounding may stop at a banned edge: go on to the next free one
    after = np.minimum.accumulate(np.where(free, np.arange(len(flat)), len(flat))[::-1])[::-1]
    return flat[after[pick]]


def _draw_rounds(lattice: Lattice, own: np.ndarray, word_offsets: np.ndarray, seeds: np.ndarray, k: int) -> list[Round]:
    """The samples of all texts, a round for each rank. own: the words of all texts, of which each has at least one."""
    count, rounds = len(word_offsets) - 1, []
    sizes = np.diff(word_offsets)
    texts, value = np.arange(count), -np.log(-np.log(_uniform(seeds ^ _M1)))
    for number in range(k):
        made = Round()
        if number:
            # where each text's next path leaves the old ones: the frontier's highest node
            tops = np.stack([r.highest(count) for r in rounds])
            best, value = tops.argmax(0), tops.max(0)
            texts = np.flatnonzero(value > -np.inf)
            if not len(texts):
                break
            best, value = best[texts], value[texts]
            begin, at, words_at, banned = (np.zeros(len(texts), dtype=np.int64) for _ in range(4))
            banned = np.full((len(texts), number), -1, dtype=np.int64)
            base, word_base = _offsets([len(r.edges) for r in rounds]), _offsets([len(r.starts) for r in rounds])
            all_edges = np.concatenate([r.edges for r in rounds])
            all_starts = np.concatenate([r.starts + b for r, b in zip(rounds, base[:-1], strict=True)])
            for which, r in enumerate(rounds):
                mine = np.flatnonzero(best == which)
                if not len(mine):
                    continue
                slot = np.searchsorted(r.texts, texts[mine])
                top = np.full(len(r.texts), np.inf)
                top[slot] = value[mine]
                hits = np.flatnonzero(r.frontier == np.repeat(top, np.diff(r.offsets)))
                owner, first = np.unique(np.searchsorted(r.offsets, hits, side="right") - 1, return_index=True)
                place = np.empty(len(r.texts), dtype=np.int64)
                place[owner] = hits[first]
                place = place[slot]
                r.frontier[place] = -np.inf
                begin[mine], at[mine], words_at[mine] = base[which] + r.offsets[slot], place - r.offsets[slot], word_base[which] + r.word_offsets[slot]
                again = at[mine] == r.branch[slot]
                banned[mine[again], : r.banned.shape[1]] = r.banned[slot[again]]
            left = all_edges[begin + at]
            banned[:, number - 1] = left
            first_word = np.searchsorted(all_starts, begin + at, side="right") - words_at  # the word after the branch
        else:
            at = first_word = np.zeros(count, dtype=np.int64)
            banned = np.zeros((count, 0), dtype=np.int64)
        row = seeds[texts] + np.uint64(number + 1) * np.uint64(0xD1342543DE82EF95)
        rest = sizes[texts] - first_word
        index = gather(word_offsets[texts] + first_word, rest)
        holder = np.repeat(np.arange(len(texts)), rest)
        inside = (index - word_offsets[texts][holder]).astype(np.uint64)
        free, steps = _walk(lattice, lattice.base[own[index]], lattice.end[own[index]], row[holder] + inside * _M1)
        free_counts = np.bincount(holder, steps, minlength=len(texts)).astype(np.int64)
        if number:
            turn = _other_edges(lattice, left, banned, _uniform(row ^ _M2))
            word = own[word_offsets[texts] + first_word - 1]
            tail, tail_counts = _walk(lattice, lattice.tail[turn], lattice.end[word], row ^ _M2, 1)
            lead = at + 1 + tail_counts
        else:
            lead = np.zeros(count, dtype=np.int64)
        lengths = lead + free_counts
        made.texts, made.offsets, made.branch, made.banned, made.value = texts, _offsets(lengths), at, banned, value
        start = made.offsets[:-1]
        edges = np.empty(int(lengths.sum()), dtype=np.int64)
        edges[gather(start + lead, free_counts)] = free
        fresh = np.repeat(start + lead - _offsets(free_counts)[:-1], rest) + np.cumsum(steps) - steps
        if number:
            edges[gather(start, at)] = all_edges[gather(begin, at)]
            edges[start + at] = turn
            edges[gather(start + at + 1, tail_counts)] = tail
            made.word_offsets = _offsets(sizes[texts])
            made.starts = np.empty(int(made.word_offsets[-1]), dtype=np.int64)
            made.starts[gather(made.word_offsets[:-1], first_word)] = all_starts[gather(words_at, first_word)] + np.repeat(start - begin, first_word)
            made.starts[gather(made.word_offsets[:-1] + first_word, rest)] = fresh
        else:
            made.word_offsets, made.starts = word_offsets, fresh
        made.edges = edges
        # the other edges of each place from the branch on
        log = lattice.log[edges]
        summed = _fixed(log)
        made.log = np.diff(summed[made.offsets]) / UNIT
        owner = np.repeat(np.arange(len(texts)), lengths)
        local = np.arange(len(edges)) - start[owner]
        taken = np.exp(log)
        if number:
            taken[start + at] += np.where(banned >= 0, np.exp(lattice.log[np.maximum(banned, 0)]), 0.0).sum(1)
        with np.errstate(divide="ignore"):
            location = (summed[:-1] - summed[start][owner]) / UNIT + np.log(np.maximum(1 - taken, 0))
        here = lattice.head[edges]
        degree = lattice.start[here + 1] - lattice.start[here]
        used = np.ones(len(edges), dtype=np.int64)
        used[start + at] += (banned >= 0).sum(1)
        open_places = np.flatnonzero((local >= at[owner]) & (degree > used) & (location > -np.inf))
        mark = seeds[texts] + np.uint64(number + 1) * np.uint64(0x9FB21C651E98DF25)
        holder = owner[open_places]
        u = _uniform(mark[holder] + local[open_places].astype(np.uint64) * _BASE)
        made.frontier = np.full(len(edges), -np.inf)
        made.frontier[open_places] = _cut_gumbel(location[open_places], value[holder], u)
        rounds.append(made)
    return rounds


class Samples:
    """Samples of a batch of texts, in the order of text and rank: text, rank, log, value, inclusion, and ids with offsets."""

    def __init__(self, vocab: Vocabulary, texts: list[str | None], seeds: np.ndarray, k: int, alpha: float):
        units, flat, sizes = distinct_words(texts)
        full = np.flatnonzero(sizes)
        empty = np.flatnonzero(sizes == 0)
        rounds: list[Round] = []
        if len(full):
            lattice = Lattice(vocab, units, alpha)
            rounds = _draw_rounds(lattice, flat, _offsets(sizes[full]), seeds[full], k)
        kappa = np.max([r.highest(len(full)) for r in rounds], axis=0) if rounds else np.zeros(0)
        text = np.concatenate([empty, *(full[r.texts] for r in rounds)])
        rank = np.concatenate([np.ones(len(empty), dtype=np.int64), *(np.full(len(r.texts), i + 1) for i, r in enumerate(rounds))])
        log = np.concatenate([np.zeros(len(empty)), *(r.log for r in rounds)])
        value = np.concatenate([np.zeros(len(empty)), *(r.value for r in rounds)])
        limit = np.concatenate([np.full(len(empty), -np.inf), *(kappa[r.texts] for r in rounds)])
        with np.errstate(invalid="ignore", over="ignore"):
            inclusion = np.where(limit == -np.inf, 1.0, -np.expm1(-np.exp(np.minimum(log - limit, 700.0))))
        ids, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(len(empty), dtype=np.int64)]
        for r in rounds:
            own_ids, lengths = _ids(vocab, lattice.piece[r.edges])
            ids.append(own_ids)
            counts.append(np.diff(_offsets(lengths)[r.offsets]))
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        order = np.lexsort((rank, text))
        starts = _offsets(counts)[:-1]
        self.text, self.rank, self.log, self.value, self.inclusion = text[order], rank[order], log[order], value[order], inclusion[order]
        self.ids, self.offsets = ids[gather(starts[order], counts[order])], _offsets(counts[order])


def _ids(vocab: Vocabulary, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces, and how many each has: characters without a piece become the ids of their bytes."""
    odd = np.flatnonzero(pieces < 0)
    counts = np.ones(len(pieces), dtype=np.int64)
    if not len(odd):
        return pieces, counts
    codes, which = np.unique(pieces[odd], return_inverse=True)
    spelled = [vocab.byte_ids[list(chr(-1 - i).encode("utf-8", "replace"))] for i in codes.tolist()]
    lengths = np.array([len(x) for x in spelled])
    counts[odd] = lengths[which]
    out = np.empty(int(counts.sum()), dtype=np.int64)
    start = _offsets(counts)[:-1]
    plain = np.flatnonzero(pieces >= 0)
    out[start[plain]] = pieces[plain]
    out[gather(start[odd], counts[odd])] = np.concatenate(spelled)[gather((np.cumsum(lengths) - lengths)[which], lengths[which])]
    return out, counts


def sample_texts(vocab: Vocabulary, texts: list[str | None], seeds: np.ndarray, k: int = SAMPLES, alpha: float = ALPHA):
    """For each text at most k samples (ids, log-probability, perturbed value, inclusion score), best value first."""
    found = Samples(vocab, texts, seeds, k, alpha)
    out: list[list[tuple]] = [[] for _ in texts]
    for i, row in enumerate(zip(found.text.tolist(), found.log.tolist(), found.value.tolist(), found.inclusion.tolist(), strict=True)):
        out[row[0]].append((found.ids[found.offsets[i] : found.offsets[i + 1]], *row[1:]))
    return out


def decode_all(vocab: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The texts of ids between offsets, as UTF-8: the first space belongs to the model, byte pieces join to characters."""
    counts = vocab.sizes[ids]
    whole = vocab.content[gather(vocab.places[ids], counts)].tobytes()
    ends = _offsets(counts)[offsets].tolist()
    return [whole[a + 1 : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def sample(df: DataFrame, path: str, keys: list[str], text: str = "text", k: int = SAMPLES, alpha: float = ALPHA, seed: int = 0, keep_ids: bool = False) -> DataFrame:
    """Rows of keys, rank (1 first), n_pieces, ids_crc32 (unsigned, little-endian 32-bit ids), log_prob, perturbed,
    inclusion, and whether decoding gave the text back; with keep_ids also the ids."""
    import pyarrow as pa

    small_batches(df.sparkSession, 512)
    own = [("rank", T.IntegerType()), ("n_pieces", T.LongType()), ("ids_crc32", T.LongType()), ("log_prob", T.DoubleType()), ("perturbed", T.DoubleType()), ("inclusion", T.DoubleType()), ("round_trip", T.BooleanType())]
    own += [("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    fields = [f for f in df.schema.fields if f.name in keys and f.name not in (n for n, _ in own)]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in own)])
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts, seeds = batch.column("_text").to_pylist(), batch.column("_seed").to_numpy().view(np.uint64)
            first, size = 0, 0
            for i in range(len(texts)):
                size += len(texts[i] or "")
                if size < BATCH_CHARS and i < len(texts) - 1:
                    continue
                with np.errstate(over="ignore"):
                    found = Samples(vocab, texts[first : i + 1], seeds[first : i + 1], k, alpha)
                packed, ends = found.ids.astype("<u4").tobytes(), (4 * found.offsets).tolist()
                crc = [zlib.crc32(packed[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                source = [(t or "").encode("utf-8", "replace") for t in texts[first : i + 1]]
                same = [source[t] == d for t, d in zip(found.text.tolist(), decode_all(vocab, found.ids, found.offsets), strict=True)]
                taken = batch.take(pa.array(first + found.text, pa.int64()))
                made = [found.rank, np.diff(found.offsets), crc, found.log, found.value, found.inclusion, same]
                columns = [taken.column(n) for n in names] + [pa.array(c, kind) for c, kind in zip(made, kinds, strict=False)]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(found.offsets, pa.int32()), pa.array(found.ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                first, size = i + 1, 0

    seeded = df.select(*names, F.col(text).cast("string").alias("_text"), F.xxhash64(*keys, F.lit(seed)).alias("_seed"))
    return seeded.mapInArrow(lean(run, 16 << 20), schema)
