"""SentencePiece encoding and decoding by a Viterbi pass that words with a common prefix share.

A text gets a leading mark and its spaces become marks; as no piece has a mark after another character, each marked word
(a run of marks and what follows it) is encoded by itself. The distinct words of a batch are sorted, which lays out their
trie in depth-first order: the forward states of a word's prefix are kept, and only what follows the prefix that it
shares with the word before it is computed.

The forward state of a prefix depends on the kind of model. For a unigram model it is the best score and its last piece.
For a merge (BPE) model best total scores give wrong pieces, so the pass keeps instead the last piece of the prefix's
own encoding: that is the one piece that ends there, encodes to itself and stands unmerged beside the last piece of what
precedes it. Words with runs of marks, whose pieces all have one score, go through the merges themselves.

For a merge model the nodes of the trie are computed level by level, all of one depth at once as arrays (`Levels`); words
of more than LEVELS characters, unigram models and unusual merge models go node by node (`Encoder.encode_sorted`).

Edge cases: a null text and an empty one have no pieces and decode to an empty text; characters without a piece become
byte pieces; a null doc_id is kept; repeated rows each get a row; an empty table gives an empty result; other columns are
ignored. Texts decode to themselves, but that a mark which the text itself holds decodes to a space.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.words import P, expand, giving_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text whose words are sorted into one trie.
SLAB_BYTES = 1 << 21
#: Pairs of pieces, and endings of words, that a worker remembers for words that go node by node.
REMEMBERED = 1 << 17
#: Characters of the longest words whose trie is computed level by level.
LEVELS = 64
#: Bits of the number of pairs of pieces whose standing side by side `Levels` remembers.
PAIR_BITS = 17

NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNIGRAM, MERGES = 1, 2
SCHEMA = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"
_MARK = MARK.encode()


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbered fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if size is None:
                size, at = varint(at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class Vocabulary:
    """The pieces of a model file; a few megabytes at most, and sent to workers as such."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], model: int):
        self.pieces, self.scores, self.kinds, self.model = pieces, scores, kinds, model
        self.key = hashlib.sha256(repr((pieces, scores, kinds, model)).encode()).hexdigest()

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Vocabulary) and self.key == other.key

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        with open(path, "rb") as f:
            raw = f.read()
        pieces, scores, kinds, model, normal = [], [], [], UNIGRAM, {}
        for field, value in _fields(raw):
            if field == 1:
                told = dict(_fields(value))
                pieces.append(told.get(1, b"").decode())
                scores.append(struct.unpack("<f", told[2])[0] if 2 in told else 0.0)
                kinds.append(told.get(3, NORMAL))
            elif field == 2:
                model = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                normal = dict(_fields(value))
        if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or USER_DEFINED in kinds or model not in (UNIGRAM, MERGES):
            raise ValueError("only models that leave text unchanged but for a leading mark are supported")
        return cls(pieces, scores, kinds, model)


class Table:
    """A map from whole numbers to whole numbers (-1: not there) by open addressing, for arrays of keys."""

    def __init__(self, told: dict[int, int]):
        keys, bits = np.fromiter(told.keys(), np.int64, len(told)), (4 * len(told) + 4).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot, rest = self._slots(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] < 0]
            self.keys[slot[free]] = keys[free]
            rest = rest[self.keys[slot[rest]] != keys[rest]]
            slot[rest] = slot[rest] + 1 & self.last
        self.values[slot] = np.fromiter(told.values(), np.int32, len(told))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * P >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        held = self.keys[slot]
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            slot[rest] = slot[rest] + 1 & self.last
            held = self.keys[slot[rest]]
            rest = rest[(held != keys[rest]) & (held >= 0)]
        return self.values[slot]


class Levels:
    """The forward pass of a merge model over the trie of sorted words, all nodes of one depth at once.

    Pieces that end at a node are found by the suffix links of the pieces' own trie. Whether two pieces stay side by side is
    told by undoing their merges, the latest first: they do not if, while both of two symbols stood at the border, these made a
    piece that comes before the next merge on either side.
    """

    def __init__(self, vocabulary: Vocabulary, ids: dict[str, int], stable: dict[str, int], trails: dict[str, list[tuple[str, str]]]):
        v, self.size = vocabulary, len(vocabulary.pieces)
        single = {p: i for p, i in ids.items() if MARK + MARK not in p}
        order = {p: k for k, p in enumerate(sorted((p for p in single if len(p) > 1), key=lambda p: -v.scores[ids[p]]))}
        self.order, self.first, self.final = np.full(self.size, -1, np.int32), np.arange(self.size, dtype=np.int32), np.arange(self.size, dtype=np.int32)
        for p, k in order.items():
            self.order[ids[p]] = k
            if p in stable:
                left, right = trails[p][-1]
                self.first[ids[p]], self.final[ids[p]] = ids[left], ids[right]
        self.pairs = Table({ids[p[:k]] * self.size + ids[p[k:]]: at for p, at in order.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids})
        pieces = {p: i for p, i in stable.items() if p in single}
        letters = {c: k for k, c in enumerate(sorted({c for p in pieces for c in p}), 1)}
        self.letters = np.zeros(0x110000, np.int32)
        self.letters[[ord(c) for c in letters]] = list(letters.values())
        prefixes = sorted({p[:k] for p in pieces for k in range(len(p) + 1)} | {""}, key=len)
        at = {p: k for k, p in enumerate(prefixes)}
        self.link, self.longest = np.zeros(len(prefixes), np.int32), np.full(len(prefixes), -1, np.int32)
        self.shorter, self.lengths, steps = np.full(self.size, -1, np.int32), np.ones(self.size + 1, np.int32), {}
        self.width = len(letters) + 1
        for k, p in enumerate(prefixes[1:], 1):
            link = next(at[p[i:]] for i in range(1, len(p) + 1) if p[i:] in at)
            self.link[k], self.longest[k] = link, self.longest[link]
            if (piece := pieces.get(p)) is not None:
                self.shorter[piece], self.longest[k], self.lengths[piece] = self.longest[link], piece, len(p)
            steps[at[p[:-1]] * self.width + letters[p[-1]]] = k
        self.steps = Table(steps)
        self.beside = np.full(1 << PAIR_BITS, -1, np.int64)

    @classmethod
    def fitting(cls, vocabulary: Vocabulary, ids: dict[str, int], stable: dict[str, int], trails: dict[str, list[tuple[str, str]]]) -> Levels | None:
        """None unless scores are distinct and the merges of each piece come in the order of their scores."""
        score = {p: vocabulary.scores[i] for p, i in ids.items() if len(p) > 1 and MARK + MARK not in p}
        if len(set(score.values())) < len(score):
            return None
        for p in stable.keys() & score.keys():
            told = [score[a + b] for a, b in trails[p]]
            if any(a < b for a, b in pairwise(told)):
                return None
        return cls(vocabulary, ids, stable, trails)

    def _step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The longest prefix of a piece that ends at each node, from that of its parent."""
        out, rest = np.zeros(len(state), np.int32), np.flatnonzero(letter)
        state, letter = state[rest].astype(np.int64), letter[rest]
        while len(rest):
            found = self.steps(state * self.width + letter)
            out[rest] = np.maximum(found, 0)
            more = np.flatnonzero((found < 0) & (state > 0))
            rest, state, letter = rest[more], self.link[state[more]].astype(np.int64), letter[more]
        return out

    def _undone(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        stays, rest, limit = np.ones(len(left), bool), np.arange(len(left)), np.full(len(left), self.size, np.int64)
        while len(rest):
            at = self.pairs(left * self.size + right)
            made = (at >= 0) & (at < limit)
            stays[rest[made]] = False
            a, b = self.order[left], self.order[right]
            more = np.flatnonzero(~made & ((a >= 0) | (b >= 0)))
            left, right, a, b, rest = left[more], right[more], a[more], b[more], rest[more]
            later = a > b  # of equals, the left one is made first
            limit = np.where(later, a, b + 1)
            left, right = np.where(later, self.final[left], left), np.where(later, right, self.first[right])
        return stays

    def _stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces side by side are left as they are by the merges."""
        key = left * self.size + right
        slot = (key.view(np.uint64) * P >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        held = self.beside[slot]
        stays = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            stays[new] = self._undone(left[new], right[new])
            self.beside[slot[new]] = key[new] << 1 | stays[new]
        return stays

    def encode(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of sorted distinct words end to end, and how many each has, from their code points and their lengths.
        -1 - code point is a character without a piece."""
        letters, start = self.letters[codes], np.cumsum(sizes) - sizes
        word, state, fresh = np.arange(len(sizes)), np.zeros(len(sizes), np.int32), np.zeros(len(sizes), bool)
        root = start + word  # a word's place in `last`, the last piece of each of its prefixes
        last = np.full(len(codes) + len(sizes), -1, np.int32)
        for depth in range(1, int(sizes.max()) + 1):
            at = start[word] + (depth - 1)
            code = codes[at]
            fresh[0] = True
            fresh[1:] |= (word[1:] != word[:-1] + 1) | (code[1:] != code[:-1])
            node = np.flatnonzero(fresh)
            reached = self._step(state[node], letters[at[node]])
            best, piece, base = -1 - code[node], self.longest[reached], root[word[node]] + depth
            rest = np.flatnonzero(piece >= 0)
            while len(rest):
                right = piece[rest]
                left = last[base[rest] - self.lengths[right]]
                stays = left < 0
                inner = np.flatnonzero(~stays)
                stays[inner] = self._stay(left[inner].astype(np.int64), right[inner].astype(np.int64))
                best[rest[stays]] = right[stays]
                rest = rest[~stays]
                piece[rest] = self.shorter[piece[rest]]
                rest = rest[piece[rest] >= 0]
            node = np.cumsum(fresh) - 1
            last[root[word] + depth] = best[node]
            longer = np.flatnonzero(sizes[word] > depth)
            word, state, fresh = word[longer], reached[node[longer]], fresh[longer]
        return self._path(last, root, sizes)

    def _path(self, last: np.ndarray, root: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that lead to each word's end."""
        counts, rest, left, steps = np.zeros(len(sizes), np.int64), np.arange(len(sizes)), sizes.copy(), []
        while len(rest):
            piece = last[root[rest] + left]
            steps.append((rest, piece))
            counts[rest] += 1
            left = left - self.lengths[np.maximum(piece, -1)]  # the last of the lengths is that of a character without a piece
            rest, left = rest[left > 0], left[left > 0]
        flat, ends = np.empty(int(counts.sum()), np.int32), np.cumsum(counts)
        for k, (words, piece) in enumerate(steps, 1):
            flat[ends[words] - k] = piece
        return flat, counts


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.v, self.size = v, len(v.pieces)
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == NORMAL}
        self.unknown = v.kinds.index(UNKNOWN) if UNKNOWN in v.kinds else 0
        self.bytes_of = {int(v.pieces[i][3:5], 16): i for i, k in enumerate(v.kinds) if k == BYTE}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark after another character, so words cannot be encoded one by one")
        if v.model == MERGES:
            if any(c not in self.ids for p in self.ids for c in p):
                raise ValueError("a piece has a character that is no piece")
            trails: dict[str, list[tuple[str, str]]] = {p: [] for p in self.ids}
            stable = {p: i for p, i in self.ids.items() if self.merged(p, trails[p]) == [i]}
        else:
            stable = self.ids
        self.stable = stable
        ending: dict[str, set[int]] = {}
        for p in stable:
            for k in (1, 2, 3):
                ending.setdefault(p[-k:], set()).add(len(p))
        self.ending = ending
        self.lengths: dict[str, list[int]] = {}
        self.worst = min(v.scores, default=0.0) - 10
        self.beside: dict[int, bool] = {}
        self.levels = Levels.fitting(v, self.ids, stable, trails) if v.model == MERGES else None

    def merged(self, word: str, trail: list[tuple[str, str]] | None = None) -> list[int]:
        """Pieces by the merges themselves: always the pair of the highest score, the first of equals. -1 - code point
        stands for a character without a piece. The pairs merged are added to `trail`."""
        symbols: list[str | None] = list(word)
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(word)
            if i >= 0 and j < len(word):
                both = symbols[i] + symbols[j]
                if both in self.ids:
                    heapq.heappush(queue, (-self.v.scores[self.ids[both]], i, j, both))

        for i in range(len(word) - 1):
            offer(i)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if symbols[i] is None or symbols[j] is None or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(both):
                continue
            if trail is not None:
                trail.append((symbols[i], symbols[j]))
            symbols[i], symbols[j] = both, None
            after[i] = after[j]
            if after[i] < len(word):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [self.ids.get(s, -1 - ord(s[0])) for s in symbols if s is not None]

    def _stays(self, left: int, right: int) -> bool:
        """Whether two pieces side by side are left as they are by the merges."""
        key = left * self.size + right
        if left < 0:
            return True
        found = self.beside.get(key)
        if found is None:
            found = self.beside[key] = self.merged(self.v.pieces[left] + self.v.pieces[right]) == [left, right]
        return found

    def _lengths(self, tail: str) -> list[int]:
        """Lengths, the greatest first, of the pieces that may end with the up to three characters of a tail."""
        told = {n for k in (1, 2, 3) for n in self.ending.get(tail[-k:], ()) if n == k or k == len(tail[-3:]) and n >= k}
        found = self.lengths[tail] = sorted(told, reverse=True)
        return found

    def encode_sorted(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Pieces of distinct words that come in order. State k of the current path: (last piece, where it begins, score)."""
        merges, lengths, stable, scores, beside, size = self.v.model == MERGES, self.lengths, self.stable, self.v.scores, self.beside, self.size
        last, begin, score = [-1], [0], [0.0]
        previous = ""
        for word in words:
            if merges and word.startswith(MARK + MARK):
                yield word, self._with_bytes(self.merged(word))
                continue
            n, shared, most = len(word), 0, min(len(word), len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :], score[shared + 1 :]
            for end in range(shared + 1, n + 1):
                best = (-1 - ord(word[end - 1]), end - 1, score[end - 1] + self.worst)
                tail = word[end - 3 if end > 3 else 0 : end]
                for length in lengths.get(tail) or self._lengths(tail):
                    start = end - length
                    if start < 0:
                        continue
                    piece = stable.get(word[start:end])
                    if piece is None:
                        continue
                    if merges:
                        stays = start == 0 or beside.get(last[start] * size + piece)
                        if stays or stays is None and self._stays(last[start], piece):
                            best = (piece, start, 0.0)
                            break
                    elif score[start] + scores[piece] > best[2]:
                        best = (piece, start, score[start] + scores[piece])
                last.append(best[0])
                begin.append(best[1])
                score.append(best[2])
            previous, at, found = word, n, []
            while at:
                found.append(last[at])
                at = begin[at]
            yield word, self._with_bytes(found[::-1])

    def _with_bytes(self, pieces: list[int]) -> tuple[int, ...]:
        if min(pieces) >= 0:
            return tuple(pieces)
        out: list[int] = []
        for p in pieces:
            if p >= 0:
                out.append(p)
            elif self.bytes_of:
                out.extend(self.bytes_of[b] for b in chr(-1 - p).encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def _distinct(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of distinct sorted words, with spaces for marks, end to end; where each word's begin, and how many it has."""
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(words) + 1]
        data = np.frombuffer(data, np.uint8)[: offsets[-1]]
        heads = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])[offsets]
        sizes, second = np.diff(heads), np.minimum(offsets[:-1] + 1, len(data) - 1)
        odd = (sizes > LEVELS) | (data[second] == 32) & (sizes > 1)
        odd |= self.levels is None
        counts, parts = np.zeros(len(words), np.int64), []
        plain, told = np.flatnonzero(~odd), []
        if len(plain):
            codes = np.frombuffer(data.tobytes().decode().replace(" ", MARK).encode("utf-32-le"), np.int32)
            flat, counts[plain] = self.levels.encode(codes if len(plain) == len(words) else codes[np.repeat(~odd, sizes)], sizes[plain])
            parts.append(flat)
            ends = np.cumsum(counts[plain])
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(flat < 0), side="right")).tolist():
                told.append((plain[k], self._with_bytes(flat[ends[k] - counts[plain[k]] : ends[k]].tolist())))
        begin = np.cumsum(counts) - counts
        odd = np.flatnonzero(odd)
        texts = (w.decode().replace(" ", MARK) for w in words.take(pa.array(odd)).to_pylist())
        told.extend(zip(odd, (found for _, found in self.encode_sorted(texts)), strict=True))
        at = sum(map(len, parts))
        for k, found in told:
            begin[k], counts[k] = at, len(found)
            at += len(found)
        parts.append(np.fromiter(chain.from_iterable(found for _, found in told), np.int32))
        return np.concatenate(parts), begin, counts

    def encode(self, texts: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 if bytes) end to end, and how many each has."""
        raw = [(t.encode() if isinstance(t, str) else t).replace(_MARK, b" ") for t in texts]
        if len(self.beside) > REMEMBERED:
            self.beside.clear()
        if len(self.lengths) > REMEMBERED:
            self.lengths.clear()
        sizes = np.fromiter((len(t) + 1 if t else 0 for t in raw), np.int64, len(raw))
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(b" " + t for t in raw if t), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(raw), np.int64)
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[starts[sizes > 0]] = True
        begins = np.flatnonzero(begins)
        buffers = [None, pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)]
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), buffers).dictionary_encode()
        order = pc.array_sort_indices(every.dictionary)
        flat, begin, counts = self._distinct(every.dictionary.take(order))
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        word = place[every.indices.to_numpy()]
        counts = counts[word]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(begins, np.append(starts, len(data)))]
        return flat[expand(begin[word], counts)[1]], np.diff(ends)


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        kinds, pieces = vocabulary.kinds, vocabulary.pieces
        told = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k == NORMAL else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for p, k in zip(pieces, kinds, strict=True)]
        self.sizes = np.array([len(t) for t in told], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(told), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Texts of ids end to end, without the leading space."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        raw = self.bytes[place].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a + (raw[a : a + 1] == b" ") : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=1)
def _tools(vocabulary: Vocabulary) -> tuple[Encoder, Decoder]:
    """Made once in a worker, for all its tasks."""
    return Encoder(vocabulary), Decoder(vocabulary)


def _slabs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    row = 0
    while row < len(texts):
        end, held = row, 0
        while end < len(texts) and (end == row or held + len(texts[end]) <= SLAB_BYTES):
            held += len(texts[end])
            end += 1
        yield row, end
        row = end


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Rows of SCHEMA: the ids of each whole text, and whether they decode to the text again."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _tools(sent.value)
        for batch in batches:
            ids, texts = batch.column("doc_id"), [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            for row, end in _slabs(texts):
                flat, counts = encoder.encode(texts[row:end])
                same = [a == b for a, b in zip(decoder.decode(flat, counts), texts[row:end], strict=True)]
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.record_batch(
                    {
                        "doc_id": ids.slice(row, end - row),
                        "n_tokens": pa.array(counts.astype(np.int64)),
                        "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        "round_trip": pa.array(same, pa.bool_()),
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(giving_back(run), SCHEMA)


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Rows (doc_id, text) from (doc_id, ids); null ids give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            held = batch.column("ids").fill_null([])
            texts = decoder.decode(held.flatten().to_numpy(zero_copy_only=False), np.diff(held.offsets.to_numpy()))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array([t.decode(errors="replace") for t in texts], pa.string())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(giving_back(run), "doc_id long, text string")
