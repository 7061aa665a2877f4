"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut into words where no piece of the model can cross: between two characters whose neighbouring bytes stand side by side
in no piece. No piece of a supported model has a mark (U+2581) after another character, so this cuts before marks as well. The
different words of a slice are found by Arrow's dictionary encoding, and all new ones are merged together: one flat array of
symbols, the minimum pair rank of each word by a segmented reduction, that pair merged at its leftmost places in all words
at once, then compaction, until no word has a pair. Words seen before come from a bounded cache. Ids and surfaces are gathered
as arrays, no word of the text is handled by itself.

Long words would need a round for each rank that they hold. They are split further where no piece holds the two neighbouring
characters. In what stays long a round may also merge every pair that comes before all others within the length of the longest
piece on both sides: whatever could take one of its two symbols away has to be made of symbols in that reach, so by a pair there
that comes first, and there is none.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import document_batches, slices

MARK = "▁"
#: Words kept with their ids in a Python worker, and the most bytes of a word that is kept. When it is full, only a slice's words stay.
CACHE_WORDS, CACHE_LENGTH = 300_000, 256
#: Characters merged together at a time (a longer word alone), and bytes of text split into words at a time.
MERGE_CHARS, SLICE_BYTES = 1 << 17, 2 << 20
NONE = np.int64(1) << 40
#: Words over so many characters are split where no piece can cross, and in parts over so many symbols pairs are chosen by reach.
LONG_WORD = 64


def _wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """Pieces, byte pieces and pair ranks of a BPE model file.

    Supported: BPE with byte fallback, no text normalisation (identity), a dummy prefix, white space neither removed nor
    treated as a suffix, no user-defined or unused pieces. Other models raise ValueError.
    """

    def __init__(self, model: bytes):
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        fields = list(_wire(model))
        normalizer = dict(_wire(next(v for k, v in fields if k == 3)))
        trainer = dict(_wire(next(v for k, v in fields if k == 2)))
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("unsupported kind of SentencePiece model")
        size = processor.vocab_size()
        self.pieces = [processor.id_to_piece(i) for i in range(size)]
        kinds = [processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i) for i in range(size)]
        kinds_of = [dict(_wire(v)).get(3, 1) for k, v in fields if k == 1]
        if any(k in (4, 5) for k in kinds_of) or any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("unsupported pieces")
        self.normal = {p: i for i, p in enumerate(self.pieces) if not kinds[i]}
        self.bytes = np.array([processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        scores = np.array([processor.get_score(i) for i in range(size)])
        rank = np.unique(-scores, return_inverse=True)[1]
        self.rank = rank.astype(np.int64)
        own, counts = np.unique(rank[list(self.normal.values())], return_counts=True)
        self.tied = np.isin(self.rank, own[counts > 1])
        if any(set(self.pieces[i]) != {MARK} for i in np.flatnonzero(self.tied) if i in set(self.normal.values())):
            raise ValueError("pieces with equal scores")
        left, right, merged = [], [], []
        for piece, i in self.normal.items():
            for cut in range(1, len(piece)):
                a, b = self.normal.get(piece[:cut]), self.normal.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        keys = np.array(left, np.int64) * size + np.array(right, np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.merged = size, keys[order], np.array(merged, np.int64)[order]
        # Pairs are found by a hash table of open addresses, which beats binary search on large arrays.
        self.mask = (1 << max(4, int(len(keys) * 4 - 1).bit_length())) - 1
        self.slot_key, self.slot_id, self.probes = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int64), 0
        pending, step = np.arange(len(self.keys)), 0
        while len(pending):
            slot = (self._hash(self.keys[pending]) + step) & self.mask
            free = self.slot_key[slot] < 0
            first = np.zeros(len(pending), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            take = free & first
            self.slot_key[slot[take]] = self.keys[pending[take]]
            self.slot_id[slot[take]] = self.merged[pending[take]]
            pending, step = pending[~take], step + 1
        self.probes = step
        self.mark = self.normal[MARK]
        self.runs = {len(p): i for p, i in self.normal.items() if set(p) == {MARK}}
        self.longest = max(map(len, self.normal), default=1)
        #: Pairs of neighbouring characters in pieces; no merge crosses another pair.
        self.neighbours = np.unique(np.array([ord(a) << 21 | ord(b) for p in self.normal for a, b in zip(p[:-1], p[1:])], np.int64))
        #: By two neighbouring bytes, 256 times the first and the second: whether no piece holds them where a character ends.
        self.border = np.ones((256, 256), bool)
        self.border[:, 0x80:0xC0] = False
        for p in self.normal:
            spelt = np.frombuffer(p.replace(MARK, " ").encode(), np.uint8)
            self.border[spelt[:-1], spelt[1:]] = False
        self.border = self.border.ravel()
        single = [(ord(p), i) for p, i in self.normal.items() if len(p) == 1]
        self.char = np.full(0x110000, -1, np.int64)
        self.char[[c for c, _ in single]] = [i for _, i in single]
        self.surface = [bytes([self.bytes.tolist().index(i)]) if processor.is_byte(i) else b"" if processor.is_control(i) else processor.decode([i]).encode() if processor.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.is_byte = np.array([processor.is_byte(i) for i in range(size)])
        self.control = np.array([processor.is_control(i) for i in range(size)])

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the merged piece of each pair, -1 where there is none."""
        keys = left * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        at, found, open_ = self._hash(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for step in range(self.probes):
            slot = (at[open_] + step) & self.mask
            there = self.slot_key[slot]
            hit = there == keys[open_]
            found[open_[hit]] = self.slot_id[slot[hit]]
            open_ = open_[~hit & (there >= 0)]
            if not len(open_):
                break
        return found


def _merge_marks(vocabulary: Vocabulary, symbols: list[int]) -> list[int]:
    """Merges a run of marks. All their pieces have one score, so the leftmost pair goes first, and after each merge again."""
    if len(symbols) < 2:
        return symbols
    n, following, before, alive = len(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1)), [True] * len(symbols)
    length = vocabulary.runs
    size = [len(vocabulary.pieces[s]) for s in symbols]
    agenda = [(i, size[i] + size[i + 1]) for i in range(n - 1) if size[i] + size[i + 1] in length]
    heapq.heapify(agenda)
    while agenda:
        i, total = heapq.heappop(agenda)
        j = following[i] if alive[i] else n
        if j >= n or size[i] + size[j] != total:
            continue
        size[i], alive[j], following[i] = total, False, following[j]
        if following[i] < n:
            before[following[i]] = i
            if total + size[following[i]] in length:
                heapq.heappush(agenda, (i, total + size[following[i]]))
        if before[i] >= 0 and size[before[i]] + total in length:
            heapq.heappush(agenda, (before[i], size[before[i]] + total))
    return [length[size[i]] for i in range(n) if alive[i]]


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row and their number for each word; words are merged together in rounds, MERGE_CHARS at a time, so that the arrays stay small."""
    made, start, size = [], 0, 0
    for i, word in enumerate(words):
        if size and size + len(word) > MERGE_CHARS:
            made.append(_merge_words(vocabulary, words[start:i]))
            start, size = i, 0
        size += len(word)
    if words:
        made.append(_merge_words(vocabulary, words[start:]))
    flat, counts = zip(*made, strict=True) if made else ((), ())
    return np.concatenate((np.empty(0, np.int32), *flat)), np.concatenate((np.empty(0, np.int64), *counts))


def _split_long(vocabulary: Vocabulary, points: np.ndarray, word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The number of each character's part: words are parts, long ones are split where no piece holds the two characters."""
    border = np.r_[False, word[1:] != word[:-1]]
    inside = np.flatnonzero(~border & (lengths > LONG_WORD)[word])
    inside = inside[inside > 0]
    if not len(inside):
        return word
    pair = points[inside - 1] << 21 | points[inside]
    known = vocabulary.neighbours
    at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
    border[inside] = known[at] != pair if len(known) else True
    return np.cumsum(border)


def _least_around(rank: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the least rank of the `reach` places before it, and of those after it."""

    def before(x: np.ndarray) -> np.ndarray:
        least, width = np.r_[NONE, x[:-1]], 1  # of `width` places that end just before
        while width < reach:
            shift = min(width, reach - width)
            least = np.minimum(least, np.r_[np.full(min(shift, len(x)), NONE), least[: max(0, len(x) - shift)]])
            width += shift
        return least

    return before(rank), before(rank[::-1])[::-1]


def _by_reach(vocabulary: Vocabulary, rank: np.ndarray, word: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places `at`, but for long parts those that come first in their reach, if these are more."""
    long_parts = sizes > LONG_WORD
    if not long_parts.any():
        return at
    inside = np.flatnonzero(np.repeat(long_parts, sizes))
    here = rank[inside]
    before, after = _least_around(here, vocabulary.longest)
    first = inside[(here < NONE) & (here < before) & (here <= after)]
    part = np.repeat(np.arange(len(starts)), sizes)
    now, reached = np.bincount(part[at], minlength=len(starts)), np.bincount(part[first], minlength=len(starts))
    better = reached > now
    return np.sort(np.r_[at[~better[part[at]]], first[better[part[first]]]])


def _merge_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = b"".join(words)
    points = np.frombuffer(data.decode().replace(" ", MARK).encode("utf-32-le"), "<u4").astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    heads = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    lengths = np.diff(heads[ends - 1], prepend=0)
    origin = np.repeat(np.arange(len(words)), lengths)
    word = _split_long(vocabulary, points, origin, lengths)
    parts = int(word[-1]) + 1 if len(word) else 0
    symbol = vocabulary.char[points]
    # Unknown characters take part in no merge; they are spelt in bytes at the end. -2 - c keeps the character.
    symbol = np.where(symbol < 0, -2 - points, symbol)
    done_at, done_symbol = [], []
    place = np.arange(len(symbol))
    merged, rank = np.full(len(symbol), -1, np.int64), np.full(len(symbol), NONE)
    touched = np.arange(len(symbol))
    while len(symbol):
        # Only pairs with a symbol that the last round made are looked up.
        touched = touched[(touched >= 0) & (touched < len(symbol) - 1)]
        touched = touched[word[touched] == word[touched + 1]]
        found = vocabulary.pair(symbol[touched], symbol[touched + 1])
        # Marks with equal scores are left for the end of the word.
        found[(found >= 0) & vocabulary.tied[found]] = -1
        merged[touched], rank[touched] = found, np.where(found >= 0, vocabulary.rank[found], NONE)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, len(symbol)])
        least = np.minimum.reduceat(rank, starts)
        over = np.repeat(least == NONE, sizes)
        if over.any():
            done_at.append(place[over])
            done_symbol.append(symbol[over])
            keep = ~over
            symbol, word, place, rank, merged = symbol[keep], word[keep], place[keep], rank[keep], merged[keep]
            if not len(symbol):
                break
            sizes, least = sizes[least != NONE], least[least != NONE]
            starts = np.cumsum(sizes) - sizes
        at = np.flatnonzero(rank == np.repeat(least, sizes))
        # In a chain of overlapping places every other one merges, from the left.
        chain = np.r_[True, at[1:] != at[:-1] + 1]
        position = np.arange(len(at)) - np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
        at = at[position % 2 == 0]
        first = np.r_[True, word[at][1:] != word[at][:-1]]
        if not first.all():
            # Several places in a word merge at once only if no pair that this makes would come before them.
            after, gone = symbol.copy(), np.zeros(len(symbol), bool)
            after[at], gone[at + 1] = merged[at], True
            kept = np.flatnonzero(~gone)
            s, w = after[kept], word[kept]
            new = np.zeros(len(symbol), bool)
            new[at] = True
            touches = (new[kept][1:] | new[kept][:-1]) & (w[1:] == w[:-1])
            pair = vocabulary.pair(s[:-1][touches], s[1:][touches])
            owner = w[:-1][touches]
            by_word = np.full(parts, NONE)
            by_word[word[starts]] = least
            early = np.unique(owner[(pair >= 0) & (np.where(pair >= 0, vocabulary.rank[pair], NONE) < by_word[owner])])
            if len(early):
                at = at[first | ~np.isin(word[at], early)]
        at = _by_reach(vocabulary, rank, word, starts, sizes, at)
        symbol[at] = merged[at]
        merged[at], rank[at] = -1, NONE
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        before = at - 1 - np.arange(len(at))
        symbol, word, place, merged, rank = symbol[keep], word[keep], place[keep], merged[keep], rank[keep]
        merged[before[before >= 0]], rank[before[before >= 0]] = -1, NONE
        touched = np.r_[before, before + 1]
    place, symbol = np.concatenate(done_at), np.concatenate(done_symbol)
    order = np.argsort(place)
    word, symbol = origin[place[order]], symbol[order]
    counts = np.bincount(word, minlength=len(words))
    special = np.unique(np.r_[word[symbol < 0], word[:-1][(symbol[1:] == vocabulary.mark) & (symbol[:-1] == vocabulary.mark) & (word[1:] == word[:-1])]])
    if not len(special):
        return symbol.astype(np.int32), counts
    bounds, spelt = np.cumsum(counts) - counts, []
    usual = np.ones(len(words), bool)
    usual[special] = False
    plain = symbol[np.repeat(usual, counts)]
    for i in special.tolist():
        ids = symbol[bounds[i] : bounds[i] + counts[i]].tolist()
        marks = next((k for k, s in enumerate(ids) if s != vocabulary.mark), len(ids))
        own = _merge_marks(vocabulary, ids[:marks])
        for s in ids[marks:]:
            own += [s] if s >= 0 else vocabulary.bytes[list(chr(-2 - s).encode())].tolist()
        spelt += own
        counts[i] = len(own)
    flat, slots = np.empty(int(counts.sum()), np.int32), np.repeat(usual, counts)
    flat[slots], flat[~slots] = plain, spelt
    return flat, counts


def _gather(flat: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[first : first + count] of each, in a row."""
    skipped = first - (np.cumsum(counts) - counts)
    return flat[np.repeat(skipped, counts) + np.arange(int(counts.sum()))]


class Codec:
    """Encodes and decodes texts with one vocabulary; keeps words that it has met."""

    def __init__(self, model: bytes):
        self.vocabulary = Vocabulary(model)
        #: Number of each kept word; first place and number of its ids in `flat`.
        self.known: dict[bytes, int] = {}
        self.flat, self.first, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.names = pa.array([b"%d," % i for i in range(self.vocabulary.size)], pa.large_binary())
        self.surfaces = pa.array(self.vocabulary.surface, pa.large_binary())

    def words(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts in a row, and for each text the place of its first one; in words, marks are spaces. Null is the empty text."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
        nothing, mark = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        texts = pc.if_else(pc.equal(texts, nothing), nothing, pc.binary_join_element_wise(mark, texts, nothing))
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        border = np.ones(len(data) + 1, bool)
        border[1:-1] = self.vocabulary.border[data[:-1].astype(np.uint16) << 8 | data[1:]]
        border[bounds] = True
        starts = np.flatnonzero(border)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)])
        return words.dictionary_encode(), np.searchsorted(starts, bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, with the end of the last."""
        words, bounds = self.words(texts)
        different = words.dictionary.to_pylist()
        number = np.fromiter(map(self.known.get, different, repeat(-1)), np.int64, len(different))
        new = np.flatnonzero(number < 0)
        size = np.fromiter((len(different[i]) for i in new.tolist()), np.int64, len(new))
        # Words too long to be kept come last.
        new = new[np.argsort(size > CACHE_LENGTH, kind="stable")]
        kept = int((size <= CACHE_LENGTH).sum())
        if len(self.known) + kept > CACHE_WORDS:
            stay = np.flatnonzero(number >= 0)
            self.flat = _gather(self.flat, self.first[number[stay]], self.counts[number[stay]])
            self.counts = self.counts[number[stay]]
            self.first = np.cumsum(self.counts) - self.counts
            number[stay] = np.arange(len(stay))
            self.known = dict(zip([different[i] for i in stay.tolist()], range(len(stay)), strict=True))
        flat, counts = encode_words(self.vocabulary, [different[i] for i in new.tolist()])
        old = len(self.known)
        first, counts = np.r_[self.first, len(self.flat) + np.cumsum(counts) - counts], np.r_[self.counts, counts]
        flat = np.concatenate((self.flat, flat))
        number[new] = old + np.arange(len(new))
        self.known.update(zip([different[i] for i in new[:kept].tolist()], range(old, old + kept), strict=True))
        self.first, self.counts = first[: old + kept], counts[: old + kept]
        self.flat = flat if kept == len(new) else flat[: int(first[old + kept])].copy()
        number = number[words.indices.to_numpy(zero_copy_only=False)]
        counts = counts[number]
        return _gather(flat, first[number], counts), np.r_[0, np.cumsum(counts)][bounds]

    def ids(self, text: str) -> list[int]:
        return self.encode(pa.array([text]))[0].tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """What the library's decode(ids) gives: byte pieces joined, bytes that are not UTF-8 each as U+FFFD, one leading space off."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        runs = np.flatnonzero(np.r_[True, self.vocabulary.is_byte[ids][1:] != self.vocabulary.is_byte[ids][:-1], True])
        parts = []
        for a, b in zip(runs[:-1].tolist(), runs[1:].tolist()):
            raw = b"".join([self.vocabulary.surface[i] for i in ids[a:b].tolist()])
            parts.append(_lenient(raw) if self.vocabulary.is_byte[ids[a]] else raw.decode())
        shown = ids[~self.vocabulary.control[ids]]
        if len(shown) and self.vocabulary.pieces[shown[0]].startswith(MARK):
            whole = "".join(parts)
            return whole[1:]
        return "".join(parts)


def _lenient(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no whole character."""
    out, at = [], 0
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_CODECS: dict[str, Codec] = {}


def _codec(model: bytes) -> Codec:
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def _spelt(table: pa.Array, ids: np.ndarray, bounds: np.ndarray, left_out: int) -> pa.Array:
    """For each text the table's bytes of its ids as one string, without the first byte (left_out 0) or the last (-1)."""
    taken = table.take(pa.array(ids))
    place = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)[bounds]
    data = np.frombuffer(taken.buffers()[2] or b"", np.uint8)[: int(place[-1])]
    some = place[1:] > place[:-1]
    stays = np.ones(len(data), bool)
    stays[(place[:-1] if left_out == 0 else place[1:] - 1)[some]] = False
    ends = (place - np.r_[0, np.cumsum(some)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(data[stays])]).cast(pa.string())


def tokenize(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """(id_col, n_tokens, decoded, ids_text, ids) for each document.

    Without with_ids or with_text, ids or ids_text are left out. Null is encoded as the empty text: no ids, and "" decoded. Rows stay as they are, repeated ones included; other columns are
    left out. The model file is read on the driver only and sent to the executors as a broadcast of its own size. ids_text holds
    the ids in decimal digits, joined by commas.
    """
    document_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in slices(batches, "t", SLICE_BYTES):
            ids, bounds = codec.encode(batch.column("t"))
            # Every text begins with a mark, whose space goes. Bytes of one character never stand in two words, so the surfaces in a row are the text.
            columns = {"i": batch.column("i"), "n_tokens": pa.array(np.diff(bounds)), "decoded": _spelt(codec.surfaces, ids, bounds, 0)}
            columns |= {"ids_text": _spelt(codec.names, ids, bounds, -1)} if with_text else {}
            columns |= {"ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))} if with_ids else {}
            yield pa.record_batch(list(columns.values()), names=list(columns))

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"i {id_type}, n_tokens long, decoded string" + ", ids_text string" * with_text + ", ids array<int>" * with_ids).withColumnRenamed("i", id_col)
