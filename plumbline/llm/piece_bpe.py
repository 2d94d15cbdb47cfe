"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The unknown words of a batch become one flat array of symbols. Each round
looks up the rank of every adjacent pair, takes the least rank of each word
(a segmented minimum), merges all its occurrences from the left at once, and
compacts the arrays; words in which no pair has a rank leave. Merging all
occurrences of a pair at once equals merging one by one from the left unless
the merged piece can take part in a better pair; the vocabulary tells which
pieces can, and of those only the leftmost occurrence merges in a round.
Rounds of a word grow with its distinct pairs and each touches the whole word,
so words beyond LONG symbols take their merges from a heap instead, in the same
order: least rank first, leftmost first.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm._common import fill, map_text, pick, texts

SPACE = "▁"
_NONE = np.int64(1) << 40
#: Symbols of a word from which a heap is quicker than rounds over the whole word.
LONG = 2000
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PieceBpe:
    """A BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.last_byte = max(self.id_byte, default=-1)
        self.plain = [p.replace(SPACE, " ") for p in self.pieces]
        self.silent = {i for i in range(n) if sp.is_control(i)}
        normal = {self.pieces[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        score = {p: sp.get_score(i) for p, i in normal.items()}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        # Symbols: a piece's id, or n + code point for a character that is no piece.
        self.n = n
        self.char = {p: i for p, i in normal.items() if len(p) == 1}
        risky = {order[s] for s, k in Counter(score.values()).items() if k > 1}
        keys, ranks, merged = [], [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if (len(a) == 1 or a in normal) and (len(b) == 1 or b in normal):
                    keys.append(self._symbol(a, normal) << 32 | self._symbol(b, normal))
                    ranks.append(order[score[p]])
                    merged.append(i)
                    for part in (a, b):
                        if part in normal and len(part) > 1 and order[score[part]] >= order[score[p]]:
                            risky.add(order[score[part]])
        by = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[by]
        self.ranks = np.array(ranks, dtype=np.int64)[by]
        self.merged = np.array(merged, dtype=np.int64)[by]
        #: No piece spans a line feed: words may end there.
        self.lines = not any("\n" in p and len(p) > 1 for p in normal)
        self.by_key: dict[int, tuple[int, int]] | None = None
        self.risky = np.zeros(len(order) + 1, dtype=bool)
        self.risky[list(risky)] = True

    def _symbol(self, p: str, normal: dict[str, int]) -> int:
        return normal[p] if p in normal else self.n + ord(p)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; _NONE where there is no such piece."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; a word is a run of spaces (as U+2581) and what follows it."""
        out: list[list[int]] = [[] for _ in words]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        if not len(points):
            return out
        distinct, back = np.unique(points, return_inverse=True)
        sym = np.array([self.char.get(chr(c), self.n + int(c)) for c in distinct], dtype=np.int64)[back]
        word = np.repeat(np.arange(len(words)), lengths)
        if len(long := np.flatnonzero(lengths > LONG)):
            ends = np.cumsum(lengths)
            for w in long.tolist():
                out[w] = self._ids(self._merged_by_heap(sym[ends[w] - lengths[w] : ends[w]]))
            stay = np.repeat(lengths <= LONG, lengths)
            sym, word = sym[stay], word[stay]
        rank = np.full(len(sym), _NONE)
        into = np.zeros(len(sym), dtype=np.int64)
        same = np.flatnonzero(word[:-1] == word[1:])
        rank[same], into[same] = self._pairs(sym[same], sym[same + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(sym)])
            if (least == _NONE).any():  # compaction: finished words leave
                done = least == _NONE
                ends = first + count
                for f, e in zip(first[done], ends[done], strict=True):
                    out[word[f]] = self._ids(sym[f:e])
                stay = np.repeat(~done, count)
                sym, word, rank, into = sym[stay], word[stay], rank[stay], into[stay]
                continue
            at = np.flatnonzero(rank == np.repeat(least, count))
            start = np.r_[True, np.diff(at) != 1]
            run = np.flatnonzero(start)
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            lone = np.r_[True, word[at[1:]] != word[at[:-1]]]
            at = at[np.where(self.risky[rank[at]], lone, place % 2 == 0)]
            sym[at] = into[at]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            moved = at - np.arange(len(at))  # one symbol went for each merge before
            sym, word, rank, into = sym[stay], word[stay], rank[stay], into[stay]
            near = np.unique(np.r_[moved, moved[moved > 0] - 1])
            rank[near] = _NONE
            near = near[near + 1 < len(sym)]
            near = near[word[near] == word[near + 1]]
            rank[near], into[near] = self._pairs(sym[near], sym[near + 1])
        return out

    def _merged_by_heap(self, sym: np.ndarray) -> np.ndarray:
        """Symbols of one word after all merges, taken one by one: n log n in its length."""
        if self.by_key is None:
            self.by_key = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        n, s, known = len(sym), sym.tolist(), self.by_key
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, into = self._pairs(sym[:-1], sym[1:])
        at = np.flatnonzero(rank != _NONE)
        heap = list(zip(rank[at].tolist(), at.tolist(), sym[at].tolist(), sym[at + 1].tolist(), into[at].tolist(), strict=True))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue  # one of the two has merged since
            s[i], s[j] = piece, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (got := known.get(s[left] << 32 | s[right])):
                    heapq.heappush(heap, (got[0], left, s[left], s[right], got[1]))
        left = np.array(s, dtype=np.int64)
        return left[left >= 0]

    def _ids(self, sym: np.ndarray) -> list[int]:
        ids = sym.tolist()
        if max(ids) < self.n:
            return ids
        return [i for s in ids for i in ([s] if s < self.n else [self.byte_id[b] for b in chr(s - self.n).encode("utf-8", "surrogatepass")])]

    @staticmethod
    def split(text: str) -> list[str]:
        """Words of a text after the dummy prefix; no merge crosses their borders."""
        return _RUNS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without begin and end ids."""
        return [i for ids in self.encode_words(self.split(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces join to UTF-8 (bad bytes become U+FFFD), the dummy prefix goes."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.id_byte:
                held.append(self.id_byte[i])
                continue
            if held:
                out.append(_utf8(held))
                held = bytearray()
            if i not in self.silent:
                piece = self.pieces[i].replace(SPACE, " ")
                out.append(piece.removeprefix(" ") if not out else piece)
        if held:
            out.append(_utf8(held))
        return "".join(out)

    def inside(self, ids: list[int], prefix: bool) -> str:
        """Text of ids within a text: the dummy prefix, or any other, stays."""
        if ids and min(ids) > self.last_byte:
            return "".join(map(self.plain.__getitem__, ids))
        return (" " if prefix else "") + self.decode(ids)


def _utf8(held: bytearray) -> str:
    """Bytes as text; each byte that is no part of a character becomes U+FFFD."""
    out, i = [], 0
    while i < len(held):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(held[i : i + n]).decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def encode_documents(df: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", cache_words: int = 600_000, with_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text; rows do not move.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 and, with ``with_ids``, ids array<int> and decoded. A null
    text counts as empty: no ids, decoded ''. Other columns are ignored; rows
    repeat as they come; an empty table gives an empty table. ``cache_words``
    bounds the distinct words that a worker keeps between batches.
    """
    extra = ", ids array<int>, decoded string" if with_ids else ""

    def make():
        model, ids_of, text_of = PieceBpe(model_path), {}, {}

        def learn(words: list[str]) -> dict:
            got = {}
            raw = [w if model.lines and w[:1] == "\n" else SPACE + w for w in words]
            for w, whole, ids in zip(words, raw, model.encode_words(raw), strict=True):
                got[w] = ",".join(map(str, ids))
                text_of[w] = model.inside(ids, whole[0] == SPACE)
            return got

        def lines(word: str) -> list[str]:
            first, *more = word.split("\n")
            return [first, *["\n" + x for x in more]]

        def work(part):
            rows = []
            for t in texts(part):
                plain = t.replace(SPACE, " ")
                odd = "  " in plain or plain[:1] in ("", " ", "\n") or plain[-1] == " " or " \n" in plain
                if odd or not model.lines:  # a word keeps all its spaces but the last before it
                    words = [x for w in PieceBpe.split(t) for x in (lines(w[1:]) if model.lines else [w[1:]])]
                else:  # a line feed begins a word without a prefix
                    words = plain.replace("\n", " \n").split(" ")
                rows.append(words)
            if len(ids_of) > cache_words:
                ids_of.clear()
                text_of.clear()
            fill(ids_of, rows, learn, 1 << 62)
            out = {"doc_id": part.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for words in rows:
                ids = ",".join(map(ids_of.__getitem__, words))
                plain = "".join(map(text_of.__getitem__, words))[1:]
                out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    out["ids"].append(list(map(int, ids.split(","))) if ids else [])
                    out["decoded"].append(plain)
            return out

        return work

    return map_text(pick(df, doc_id=doc_id, text=text), "text", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra, make)
