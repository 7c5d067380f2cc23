"""SentencePiece BPE encoding and decoding with a prefix table.

A sequence of tokens is the BPE encoding of its text exactly when each adjacent pair is the
encoding of the pair's own text: merges inside a pair are not touched by what stands around it
until one crosses the pair's ends. So each prefix of a text has one last token, which is the one
match ending there that is compatible with the last token of the prefix before it. The table of
last tokens is filled left to right from the matches of an Aho-Corasick automaton, and the ids
are read from it backwards. The time is linear in the text, also without any space in it.

Spaces start segments that no merge crosses (checked for the vocabulary when it is loaded), so
encodings of segments are kept in a memo, and the tables of all new segments of a batch are filled
together, one position of all segments at a time, with numpy. Segments of over 64 characters and
those with characters that only stand inside pieces are filled one by one, in the same way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import Memo, held, slices, texts

SPACE = "▁"
END_ID = 2
#: Segments that a memo holds, about 400 bytes each.
MOST = 200_000


class Pairs:
    """Yes or no by key, asked in bulk; made once for each key. A large sorted array and a small recent one."""

    def __init__(self, most: int = 3_000_000):
        self.most = most
        self.keys = self.recent = np.array([-1, 1 << 62], np.int64)
        self.values = self.recent_values = np.zeros(2, bool)

    def lookup(self, keys: np.ndarray, make) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        out, known = self.values[at], self.keys[at] == keys
        if known.all():
            return out
        rest = np.flatnonzero(~known)
        wanted = keys[rest]
        at = np.searchsorted(self.recent, wanted)
        out[rest] = self.recent_values[at]
        missing = self.recent[at] != wanted
        if missing.any():
            new, back = np.unique(wanted[missing], return_inverse=True)
            made = np.fromiter(map(make, new.tolist()), bool, len(new))
            out[rest[missing]] = made[back]
            keys_now, values_now = np.concatenate([self.recent, new]), np.concatenate([self.recent_values, made])
            order = np.argsort(keys_now)
            self.recent, self.recent_values = keys_now[order], values_now[order]
            if len(self.recent) > 20_000:
                if len(self.keys) > self.most:
                    self.keys, self.values = self.recent, self.recent_values
                else:
                    keys_now, first = np.unique(np.concatenate([self.keys, self.recent]), return_index=True)
                    self.keys, self.values = keys_now, np.concatenate([self.values, self.recent_values])[first]
                self.recent, self.recent_values = np.array([-1, 1 << 62], np.int64), np.zeros(2, bool)
        return out


class Trie:
    """The automaton of all pieces, stepped from all places of a text at once. Transitions are in an open hash table."""

    BITS = 20

    def __init__(self, pieces: dict[str, int]):
        alphabet = {c: k for k, c in enumerate(sorted({c for p in pieces for c in p}), 1)}
        self.code = np.zeros(0x110000, np.int64)
        for c, k in alphabet.items():
            self.code[ord(c)] = k
        self.width = len(alphabet) + 1
        steps: dict[int, int] = {}
        accepts = {}
        for p, i in pieces.items():
            state = 0
            for c in p:
                state = steps.setdefault(state * self.width + alphabet[c], len(steps) + 1)
            accepts[state] = i
        self.accept = np.full(len(steps) + 1, -1, np.int64)
        self.accept[list(accepts)] = list(accepts.values())
        self.keys, self.next = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS, np.int64)
        for key, state, slot in zip(steps, steps.values(), self._slot(np.fromiter(steps, np.int64, len(steps))).tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.BITS) - 1)
            self.keys[slot], self.next[slot] = key, state

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(end, piece) of all occurrences of all pieces."""
        codes = np.append(self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], 0)
        at = np.flatnonzero(codes)
        state, ends, found = np.zeros(len(at), np.int64), [], []
        while len(at):
            keys = state * self.width + codes[at]
            slot = self._slot(keys)
            seen = self.keys[slot]
            while (off := (seen != keys) & (seen >= 0)).any():
                slot = np.where(off, (slot + 1) & ((1 << self.BITS) - 1), slot)
                seen = self.keys[slot]
            live = np.flatnonzero(seen == keys)
            at, state = at[live], self.next[slot[live]]
            piece = self.accept[state]
            hit = np.flatnonzero(piece >= 0)
            ends.append(at[hit])
            found.append(piece[hit])
            at = at + 1
            go = np.flatnonzero(codes[at])
            at, state = at[go], state[go]
        return (np.concatenate(ends), np.concatenate(found)) if ends else (np.zeros(0, np.int64),) * 2


class PieceBpe:
    """The encoder of one model file (SentencePiece, type BPE, with byte fallback)."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.piece: dict[int, str] = {}
        self.byte_of: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.byte_of[i] = int(piece[1:-1], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.score[piece], self.piece[i] = i, sp.get_score(i), piece
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after other characters: segments would not be independent")
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, self.ids[piece])
        self.automaton.make_automaton()
        size = sp.get_piece_size()
        self.size, self.length = size, np.ones(size + 1, np.int64)
        for i, piece in self.piece.items():
            self.length[i] = len(piece)
        self.names = [str(i) for i in range(size)]
        self.plain = [self.piece.get(i, "").replace(SPACE, " ") for i in range(size)]
        #: Characters that only stand inside pieces.
        self.odd = {c for p in self.ids for c in p if c not in self.ids}
        self.pairs = Pairs()
        self.trie = Trie(self.ids)
        self.compatible: dict[tuple[str, str], bool] = {}
        self.reachable: dict[str, bool] = {}
        self.histories = Memo(self._history)
        self.segments: dict[str, tuple[str, int, str]] = {}
        lone = {c for c in ("\n",) if not any(c in p for p in self.ids)}
        #: A character in no piece stands alone, so that it may end a segment as well.
        alone = "".join(sorted(lone))
        self.cut = re.compile(rf"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merge(self, text: str) -> list[str]:
        """BPE by definition: the best-scored adjacent pair first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _history(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """Of the merges that make a piece: their scores in order, then its first and last part before each and at the end. None if no merges make it."""
        parts, scores, first, last = list(piece), [], [piece[0]], [piece[-1]]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            first.append(parts[0])
            last.append(parts[-1])
        return scores, first, last

    def _fits(self, a: str, b: str) -> bool:
        """Whether merge(a + b) is [a, b]: the merges of both go on side by side until one would cross."""
        if self.histories[b] is None:
            return False
        (left, _, ends), (right, starts, _) = self.histories[a], self.histories[b]
        i, j, n, m, fits = 0, 0, len(left), len(right), True
        while True:
            across = self.score.get(ends[i] + starts[j])
            if across is not None and (i == n or across > left[i]) and (j == m or across >= right[j]):
                fits = False
                break
            if i < n and (j == m or left[i] >= right[j]):
                i += 1
            elif j < m:
                j += 1
            else:
                break
        return fits

    def last_tokens(self, text: str) -> list[str]:
        """For each prefix, its last token."""
        last: list[str | None] = [None] * len(text)
        compatible, reachable, done = self.compatible, self.reachable, 0
        for end, number in self.automaton.iter(text):
            piece = self.piece[number]
            while done < end:  # no piece ends there: the character stands alone
                if last[done] is None:
                    last[done] = text[done]
                done += 1
            if last[end] is not None:
                continue
            start = end - len(piece)
            if start < 0:
                ok = reachable.get(piece)
                if ok is None:
                    ok = reachable[piece] = self.merge(piece) == [piece]
            else:
                before = last[start]
                ok = compatible.get((before, piece))
                if ok is None:
                    if len(compatible) > MOST // 2:
                        compatible.clear()
                    ok = compatible[before, piece] = self._fits(before, piece)
            if ok:
                last[end] = piece
        return [text[i] if t is None else t for i, t in enumerate(last)]

    def tokens(self, text: str) -> list[str]:
        last, at, out = self.last_tokens(text), len(text) - 1, []
        while at >= 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _segment(self, text: str, numbers: list[int] | None = None) -> tuple[str, int, str]:
        if numbers is None:
            tokens = self.tokens(text)
        else:
            tokens, at = [], 0
            for i in numbers:
                tokens.append(text[at : at + int(self.length[i])])
                at += len(tokens[-1])
        out: list[int] = []
        for t in tokens:
            i = self.ids.get(t)
            if i is None:
                out += [self.bytes[b] for b in t.encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return " ".join(map(str, out)), len(out), self._decode(out)

    def _decode(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.piece.get(i, ""))  # control ids have no text
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def _fill(self, new: list[str]) -> None:
        """Encodes new segments together: last tokens forwards by position, then ids backwards."""
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        starts = np.cumsum(sizes + 1) - sizes - 1
        end, piece = self.trie.matches("\n".join(new))
        seg = np.searchsorted(starts, end, "right") - 1
        before = end - self.length[piece] - starts[seg]  # place of the token before, in the segment
        last = np.full(starts[-1] + sizes[-1] + 1, self.size, np.int64)  # no piece: stands alone
        free = np.ones(len(last), bool)
        order = np.argsort(end - starts[seg], kind="stable")
        end, piece, before, at = end[order], piece[order], before[order], (end - starts[seg])[order]
        previous = end - self.length[piece]
        for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
            if not len(group):
                continue
            e, p, head = end[group], piece[group], before[group] < 0
            a = np.where(head, self.size, last[np.where(head, 0, previous[group])])
            ok = self.pairs.lookup(a * (self.size + 1) + p, self._pair)
            ok &= free[e]
            last[e[ok]] = p[ok]
            free[e[ok]] = False
        ends = np.zeros(len(last), bool)
        where, low = starts + sizes - 1, starts
        while len(where):
            ends[where] = True
            where = where - self.length[last[where]]
            on = where >= low
            where, low = where[on], low[on]
        flat = np.flatnonzero(ends)
        ids = last[flat].tolist()
        cuts = np.searchsorted(flat, starts).tolist() + [len(ids)]
        alone = set(np.searchsorted(starts, flat[last[flat] == self.size], "right").tolist())
        for i, text in enumerate(new):
            if i + 1 in alone:
                self.segments[text] = self._segment(text, ids[cuts[i] : cuts[i + 1]])
            else:
                own = ids[cuts[i] : cuts[i + 1]]
                self.segments[text] = " ".join([self.names[x] for x in own]), len(own), "".join([self.plain[x] for x in own])

    def _pair(self, key: int) -> bool:
        a, b = divmod(key, self.size + 1)
        if a == self.size:  # the segment's start, or a character that is in no piece
            return self.merge(self.piece[b]) == [self.piece[b]]
        return self._fits(self.piece[a], self.piece[b])

    def found_all(self, batch: list[str]) -> Iterator[list[tuple[str, int, str]]]:
        """For each text, of each segment: ids as text, their number, the decoded text."""
        if len(self.segments) > MOST:
            self.segments.clear()
        cut = [self.cut.findall(f" {t}".replace(" ", SPACE)) if t else [] for t in batch]
        new = [s for s in set(chain.from_iterable(cut)) if s not in self.segments]
        odd = [s for s in new if len(s) > 64 or s == "\n" or not self.odd.isdisjoint(s)]
        apart = set(odd)
        if new := [s for s in new if s not in apart]:
            self._fill(new)
        for s in odd:
            self.segments[s] = self._segment(s)
        for segments in cut:
            yield list(map(self.segments.__getitem__, segments))
        for s in odd:
            if len(s) > 64:
                del self.segments[s]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, with the end id."""
        return self.encode_all([text])[0]

    def encode_all(self, batch: list[str]) -> list[list[int]]:
        return [[int(i) for s in found for i in s[0].split()] + [END_ID] for found in self.found_all(batch)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the space put before each text is taken off again."""
        return self._decode(ids).removeprefix(" ")


@held
def load(model_file: str) -> PieceBpe:
    """One encoder for each Python worker, with its memo, across tasks."""
    return PieceBpe(model_file)


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text with the end id.

    One row for each input row, repeated rows and null ids included; a null or empty text has the end
    id alone. Other columns are not read. No shuffle.
    """
    return _map(docs, model_file, id_col, text_col, False)


def decode_pieces(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the inverse of encode_pieces(). Null ids give the empty text."""
    schema = encoded.select(encoded[id_col].alias("doc_id")).schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(model_file)
        for b in slices(batches):
            yield pa.record_batch([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"{schema}, text string")


def piece_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the same ids and of the text decoded from them."""
    return _map(docs, model_file, id_col, text_col, True)


def _map(docs: DataFrame, model_file: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    first, second, third = itemgetter(0), itemgetter(1), itemgetter(2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = load(model_file), hashlib.sha256
        for b in slices(batches, 256):
            if not digest:
                ids = pa.array(bpe.encode_all(texts(b)), pa.list_(pa.int32()))
                yield pa.record_batch([b.column(0), ids], ["doc_id", "ids"])
                continue
            n, a, d = [], [], []
            for found in bpe.found_all(texts(b)):
                n.append(sum(map(second, found)) + 1)
                a.append(sha(" ".join([*map(first, found), str(END_ID)]).encode()).hexdigest())
                d.append(sha("".join(map(third, found)).removeprefix(" ").encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return own.mapInArrow(run, f"doc_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"))
