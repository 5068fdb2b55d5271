"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of many words lie in one flat array. A round finds the best pair of each word by a segmented
minimum over the pairs' ranks, merges its leftmost occurrences in all words at once, and compacts the
array; words without a pair left drop out, and the rounds end when none remains. The ids are those of merging
one pair at a time: where an occurrence, once merged, makes a pair with its neighbours that is as good or
better, the later ones of its word wait for the next round. A long word in which that happens would need as many
rounds as it has symbols, and one of over ``MOST`` symbols as many as it has kinds of pairs; such words are merged by
themselves, pair by pair off a heap, in n log n steps.

Texts are cut where no piece can cross: before a space that follows another character, around line
breaks, between a letter and punctuation that follows letters in no piece, and in words of over 64 characters
between any characters that are neighbours in no piece. Words are kept, with their ids, by each task, up to a bound.

Null texts count as empty; the encoding of an empty text is no ids. Rows are encoded one by one, whatever their
length, with repeated rows giving equal results; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.llm import textbuf as tb
from loomgraph.llm.common import two

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: symbols of a word that is merged by itself if its occurrences don't go together
LONG = 400
MOST = 10_000


class Model:
    """Pieces and their ranks, read from a model file; its own encoder isn't used."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        byte = {i: int(self.pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = np.zeros(256, np.int32)
        for i, b in byte.items():
            self.byte_id[b] = i
        self.as_bytes = [bytes([byte[i]]) if i in byte else b"" if sp.is_control(i) else self.pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.id = {self.pieces[i]: i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        scores = {p: sp.get_score(i) for p, i in self.id.items()}
        rank = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.chars = dict(self.id)
        pairs, unsafe = [], set()
        for p, i in self.id.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                left, right = self._symbol(a), self._symbol(b)
                if left is not None and right is not None:
                    pairs.append((left, right, rank[scores[p]], i))
                unsafe |= {q for q in (a, b) if q in scores and scores[q] <= scores[p]}
        self.width = len(self.chars) + n + 2
        pairs.sort()
        self.keys = np.array([a * self.width + b for a, b, _, _ in pairs], np.int64)
        self.ranks = np.array([r for _, _, r, _ in pairs], np.int32)
        self.merged = np.array([m for _, _, _, m in pairs], np.int32)
        self.table: dict[int, tuple[int, int]] | None = None
        #: pieces that are part of one as good or better
        self.unsafe = np.zeros(n, bool)
        self.unsafe[[self.id[q] for q in unsafe]] = True
        self.neighbours = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.as_str = [str(i) for i in range(n)]
        self.size = np.array([len(x) for x in self.as_bytes], np.int64)
        #: the symbol of each character; one outside of all pieces merges with nothing, and -1 less its code says which it is
        self.symbol = -1 - np.arange(0x110000, dtype=np.int64)
        for c, i in self.chars.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.name = {v: k for k, v in self.chars.items() if v >= n}
        letters = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
        after = {x[1] for x in self.neighbours if re.match(f"[{letters}]", x)}
        c = "".join(map(re.escape, (x for x in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" if x not in after)))
        self.cut = re.compile(rf" *[{letters}]+(?![^ \n{c}])|" * bool(c) + r" *[^ \n]+|\n| +")

    def _symbol(self, s: str) -> int | None:
        if s in self.id:
            return self.id[s]
        return self.chars.setdefault(s, len(self.pieces) + len(self.chars)) if len(s) == 1 else None

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each pair of symbols merges to."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        good = self.keys[at] == key
        return np.where(good, self.ranks[at], NONE), np.where(good, self.merged[at], 0)

    def parts(self, word: str) -> list[str]:
        """A long word, cut where no piece can cross."""
        if len(word) <= 64:
            return [word]
        out, last = [], 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in self.neighbours:
                out.append(word[last:k])
                last = k
        return [*out, word[last:]]

    def encode(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The ids of all words, one behind the other, and where each ends; spaces are written as in pieces."""
        if not words:
            return [], []
        if max(map(len, words)) > 64:
            parts = [self.parts(w) for w in words]
            ids, ends = self._rounds([p for x in parts for p in x])
            ends = ends[np.cumsum([len(x) for x in parts], dtype=np.int64) - 1]
        else:
            ids, ends = self._rounds(words)
        return ids.tolist(), ends.tolist()

    def _rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(words)
        sym = self.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        n = np.array([len(w) for w in words], np.int64)
        seg = np.repeat(np.arange(len(words)), n)
        done_sym, done_seg = [], []
        if len(n) and n.max() > MOST:
            ends = np.cumsum(n)
            for w in np.flatnonzero(n > MOST).tolist():
                one = self._one_by_one(sym[ends[w] - n[w] : ends[w]].tolist())
                done_sym.append(np.array(one, np.int64))
                done_seg.append(np.full(len(one), w))
            go = np.repeat(n <= MOST, n)
            sym, seg = sym[go], seg[go]
        rank, into = self._pairs(sym, seg)
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.concatenate([starts, [len(sym)]]))
            best = np.repeat(best, size)
            over = best == NONE
            if over.any():
                done_sym.append(sym[over])
                done_seg.append(seg[over])
                on = ~over
                sym, seg, rank, into, best = sym[on], seg[on], rank[on], into[on], best[on]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            alone = np.concatenate([[True], at[1:] != at[:-1] + 1])
            head = np.flatnonzero(alone)
            place = np.arange(len(at)) - np.repeat(head, np.diff(np.concatenate([head, [len(at)]])))
            at = at[place % 2 == 0]
            stop = self._stops(sym, seg, into, best, at)
            if stop.any():
                own = seg[at]
                late = np.cumsum(stop) - stop  # occurrences that stop before each
                begin = np.concatenate([[True], own[1:] != own[:-1]])
                late -= np.repeat(late[begin], np.diff(np.append(np.flatnonzero(begin), len(at))))
                on = late == 0
                slow = np.unique(own[stop])
                length = np.searchsorted(seg, slow, side="right") - np.searchsorted(seg, slow)
                slow = slow[length > LONG]
                if len(slow):
                    for w in slow.tolist():
                        one = self._one_by_one(sym[np.searchsorted(seg, w) : np.searchsorted(seg, w, side="right")].tolist())
                        done_sym.append(np.array(one, np.int64))
                        done_seg.append(np.full(len(one), w))
                    go = ~np.isin(seg, slow)
                    sym, seg, rank, into = sym[go], seg[go], rank[go], into[go]
                    continue
                at = at[on]
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            sym, seg, rank, into = sym[keep], seg[keep], rank[keep], into[keep]
            for redo in (new, new[new > 0] - 1):
                rank[redo], into[redo] = self._pairs(sym, seg, redo)
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        seg = np.concatenate(done_seg) if done_seg else np.zeros(0, np.int64)
        order = np.argsort(seg, kind="stable")
        sym, seg = sym[order], seg[order]
        ids, size = self._bytes(sym)
        ends = np.cumsum(np.bincount(seg, weights=size, minlength=len(words)).astype(np.int64))
        return ids, ends

    def _stops(self, sym: np.ndarray, seg: np.ndarray, into: np.ndarray, best: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the occurrences at these places, merged from left to right, make a pair as good as theirs or better."""
        out = np.zeros(len(at), bool)
        k = np.flatnonzero(self.unsafe[into[at]])
        if not len(k):
            return out
        a = at[k]
        p, n = into[a], len(sym)
        left = np.where((a > 0) & (seg[np.maximum(a, 1) - 1] == seg[a]), sym[np.maximum(a, 1) - 1], -1)
        joined = (k > 0) & (at[np.maximum(k, 1) - 1] == a - 2) & (seg[np.maximum(a, 2) - 2] == seg[a])  # the one before lies right before it
        left = np.where(joined, into[at[np.maximum(k, 1) - 1]], left)
        after = np.minimum(a + 2, n - 1)
        right = np.where((a + 2 < n) & (seg[after] == seg[a]), sym[after], -1)
        bad = np.zeros(len(k), bool)
        for x, y, has in ((left, p, left), (p, right, right)):
            i = np.flatnonzero(has >= 0)
            bad[i] |= self.find(x[i], y[i])[0] <= best[a[i]]
        out[k] = bad
        return out

    def _one_by_one(self, sym: list[int]) -> list[int]:
        """The symbols of a word, merged pair by pair: the best rank first, of equal ones the leftmost."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), zip((self.ranks.astype(np.int64) << 32).tolist(), self.merged.tolist())))
        get, wide, n, low = self.table.get, self.width, len(sym), (1 << 32) - 1
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [x[0] + i for i in range(n - 1) if sym[i] >= 0 <= sym[i + 1] and (x := get(sym[i] * wide + sym[i + 1]))]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i = top & low
            j = after[i]
            if j < 0 or sym[i] < 0 or sym[j] < 0:
                continue
            x = get(sym[i] * wide + sym[j])
            if x is None or x[0] + i != top or before[j] != i:
                continue
            sym[i] = s = x[1]
            after[i] = k = after[j]
            after[j] = -1
            before[j] = -2
            if k >= 0:
                before[k] = i
                if sym[k] >= 0 and (x := get(s * wide + sym[k])):
                    push(heap, x[0] + i)
            h = before[i]
            if h >= 0 and sym[h] >= 0 and (x := get(sym[h] * wide + s)):
                push(heap, x[0] + h)
        return [s for s, b in zip(sym, before) if b != -2]

    def _pairs(self, sym: np.ndarray, seg: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(sym)) if at is None else at
        rank, into = np.full(len(at), NONE, np.int32), np.zeros(len(at), np.int32)
        k = np.flatnonzero(at + 1 < len(sym))
        a = at[k]
        good = (seg[a] == seg[a + 1]) & (sym[a] >= 0) & (sym[a + 1] >= 0)
        k, a = k[good], a[good]
        rank[k], into[k] = self.find(sym[a], sym[a + 1])
        return rank, into

    def _bytes(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, with the bytes of characters that no piece is; and how many each symbol gives."""
        extra = np.flatnonzero((sym < 0) | (sym >= len(self.pieces)))
        size = np.ones(len(sym), np.int64)
        if not len(extra):
            return sym.astype(np.int32), size
        coded = [(self.name[s] if s >= 0 else chr(-1 - s)).encode() for s in sym[extra].tolist()]
        size[extra] = [len(x) for x in coded]
        ids = np.repeat(sym, size)
        at = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(coded), np.uint8)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(size[extra]) - size[extra], size[extra])
        ids[np.repeat(at[extra], size[extra]) + step] = self.byte_id[flat]
        return ids.astype(np.int32), size

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces with their spaces, runs of byte ids as UTF-8, without the space put in front."""
        text = self.text(ids)
        return text[1:] if text.startswith(" ") else text

    def text(self, ids: np.ndarray) -> str:
        return b"".join([self.as_bytes[i] for i in ids]).decode("utf-8", "replace")


class Codec:
    """A model with the words that it has met lately; at most ``keep`` of them."""

    def __init__(self, path: str, keep: int = 300_000):
        self.model, self.keep = Model(path), keep
        self.clear()

    def clear(self) -> None:
        self.said: dict[str, str] = {}
        #: decoded text of the words that aren't decoded to themselves
        self.odd: dict[str, str] = {}

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.said))
        if len(self.said) + len(new) > self.keep:
            self.clear()
            new = list(words)
        m = self.model
        ids, ends = m.encode([w.replace(" ", SPACE) for w in new])
        said = [m.as_str[i] for i in ids]
        self.said.update(zip(new, [",".join(said[a:b]) for a, b in zip([0, *ends], ends)]))
        plain = [w.encode() for w in new]
        sizes = np.concatenate([[0], np.cumsum(m.size[np.array(ids, np.int64)])])[np.array(ends, np.int64)]
        if not np.array_equal(sizes, np.cumsum([len(x) for x in plain], dtype=np.int64)) or b"".join([m.as_bytes[i] for i in ids]) != b"".join(plain):
            back = [m.text(ids[a:b]) for a, b in zip([0, *ends], ends)]
            self.odd.update((w, t) for w, t in zip(new, back) if t != w)

    def batches(self, texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[list[str]]]:
        """Words of some texts at a time, all of them learnt."""
        some, size, cut = [], 0, self.model.cut
        for t in texts:
            some.append(cut.findall(" " + t.replace(SPACE, " ")) if t else [])
            size += len(t or "")
            if size >= chars:
                self.learn(set().union(*some))
                yield some
                some, size = [], 0
        if some:
            self.learn(set().union(*some))
            yield some

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        out = []
        for some in self.batches(texts):
            said, odd = self.said.__getitem__, self.odd
            for w in some:
                ids, back = ",".join(map(said, w)), "".join([odd.get(x, x) for x in w] if odd else w)
                out.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back[1:].encode()).hexdigest()))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        out = []
        for some in self.batches(texts):
            out += [[int(i) for x in w for i in self.said[x].split(",")] for w in some]
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


#: rows whose ids are Python's integers at once
ROWS = 100


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids and the decoded text of each row."""
    small = two(df, id_col, text_col)
    out = T.StructType([T.StructField(id_col, small.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, schema = codec(path), to_arrow_schema(out)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                ids = c.encode(b.column(1).slice(i, ROWS).to_pylist())
                text = [c.model.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, ROWS), pa.array(ids, schema.field(1).type), pa.array(text, schema.field(2).type)], schema=schema)
        c.clear()
        tb.release()

    return small.mapInArrow(apply, out)


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each row."""
    small = two(df, id_col, text_col)
    out = T.StructType([T.StructField(id_col, small.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, schema = codec(path), to_arrow_schema(out)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                n, a, d = zip(*c.digests(b.column(1).slice(i, 500).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 500), pa.array(n, pa.int64()), *(pa.array(x, f.type) for x, f in zip((a, d), list(schema)[2:]))], schema=schema)
        c.clear()
        tb.release()

    return small.mapInArrow(apply, out)
