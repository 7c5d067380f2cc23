"""Language identification by unigrams over a fixed public vocabulary, all segmentations summed.

Each language has a probability for each piece of the vocabulary. A word's probability is the sum
over all of its segmentations into pieces of the product of the pieces' probabilities, by the
forward algorithm; a text is scored by all of its words. Training is expectation maximisation with
forward and backward sums over the counted words of the training rows; only expected counts of
pieces (languages x vocabulary, a fixed size) meet on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .arrow import free, held, raw_texts, slices, summed
from .pieces import SPACE, Trie
from .words import RUN, WordMemo, WordRun, chunks

UNDETERMINED = "und"
#: Probability of a character outside the vocabulary, and what is added to each expected count.
ALONE = 1e-7
ADDED = 0.05
#: Longer words are summed in logs, as products of so many probabilities may be below the least double.
LONGEST = 32
#: Words summed at once, and letters of long words, about.
WORDS = 5_000
LETTERS = 1 << 17
WORD = re.compile(r"[^\W\d_]+")
SLICE = 1024


class Lattice:
    """Sums over the segmentations of many words at once."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        own = {p: i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for p in (sp.id_to_piece(i),)}
        self.size = sp.get_piece_size()
        self.trie = Trie(own)
        self.length = np.ones(self.size + 1, np.int64)
        for p, i in own.items():
            self.length[i] = len(p)
        self.single = np.zeros(0x110000, bool)
        for p in own:
            if len(p) == 1:
                self.single[ord(p)] = True

    def edges(self, words: list[str]):
        """(starts, sizes, and by place in the word: first place, end, piece, word) of all pieces in words."""
        joined = "\n".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        end, piece = self.trie.matches(joined)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lone = np.flatnonzero(~self.single[codes])
        inside = np.ones(len(codes), bool)
        inside[starts[1:] - 1] = False
        lone = lone[inside[lone]]
        end, piece = np.concatenate([end, lone]), np.concatenate([piece, np.full(len(lone), self.size, np.int64)])
        word = np.searchsorted(starts, end, "right") - 1
        place = end - starts[word]
        order = np.argsort(place * len(codes) + end, kind="stable")
        end, piece, word, place = end[order], piece[order], word[order], place[order]
        return starts, sizes, end - self.length[piece] + 1, end, piece, word, place

    def forward(self, lattice, probability: np.ndarray):
        """alpha by place: entry e + 1 is the sum over the segmentations of the word up to place e; entry of a start is 1."""
        starts, sizes, begin, end, piece, word, place = lattice
        total = int(starts[-1] + sizes[-1])
        # places are shifted by one word so that each word has its own entry before its first character
        alpha = np.zeros((total + len(starts) + 1, probability.shape[1]))
        shift = word
        alpha[starts + np.arange(len(starts))] = 1.0
        for a, b in _groups(place):
            values = alpha[begin[a:b] + shift[a:b]] * probability[piece[a:b]]
            to = end[a:b] + shift[a:b] + 1
            first = np.flatnonzero(np.diff(to, prepend=-1))
            alpha[to[first]] = np.add.reduceat(values, first)
        return alpha, alpha[starts + sizes + np.arange(len(starts))]

    def forward_logs(self, lattice, logs: np.ndarray):
        """As forward(), in logs."""
        starts, sizes, begin, end, piece, word, place = lattice
        alpha = np.full((int(starts[-1] + sizes[-1]) + len(starts) + 1, logs.shape[1]), -np.inf)
        alpha[starts + np.arange(len(starts))] = 0.0
        for a, b in _groups(place):
            to = end[a:b] + word[a:b] + 1
            first = np.flatnonzero(np.diff(to, prepend=-1))
            alpha[to[first]] = _log_sums(alpha[begin[a:b] + word[a:b]] + logs[piece[a:b]], first)
        return alpha, alpha[starts + sizes + np.arange(len(starts))]

    def log_totals(self, words: list[str], probability: np.ndarray) -> np.ndarray:
        """Logs of the sums over all segmentations, a row for each word."""
        out = np.zeros((len(words), probability.shape[1]))
        for some, long in _dealt(words):
            lattice = self.edges([words[i] for i in some])
            out[some] = self.forward_logs(lattice, np.log(probability))[1] if long else np.log(self.forward(lattice, probability)[1])
        return out

    def expected_counts(self, words: list[str], weights: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """As expected(), for words of any length."""
        out = np.zeros_like(probability)
        for some, long in _dealt(words):
            own = [words[i] for i in some]
            out += self._expected_logs(own, weights[some], np.log(probability)) if long else self.expected(own, weights[some], probability)
        return out

    def _expected_logs(self, words: list[str], weights: np.ndarray, logs: np.ndarray) -> np.ndarray:
        lattice = self.edges(words)
        starts, sizes = lattice[:2]
        alpha, whole = self.forward_logs(lattice, logs)
        beta = np.full_like(alpha, -np.inf)
        beta[starts + sizes + np.arange(len(starts))] = -whole
        at, to, piece, groups = self._backward(lattice)
        for a, b, first in groups:
            beta[at[a:b][first]] = _log_sums(beta[to[a:b]] + logs[piece[a:b]], first)
        owner = np.searchsorted(starts + np.arange(len(starts)), at, "right") - 1
        return self._uses(piece, np.exp(alpha[at] + beta[to] + logs[piece]) * weights[owner], logs)

    def expected(self, words: list[str], weights: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece for each language; weights: counts of words by language."""
        lattice = self.edges(words)
        starts, sizes = lattice[:2]
        alpha, whole = self.forward(lattice, probability)
        beta = np.zeros_like(alpha)
        beta[starts + sizes + np.arange(len(starts))] = np.divide(weights, whole, out=np.zeros_like(whole), where=whole > 0)
        at, to, piece, groups = self._backward(lattice)
        for a, b, first in groups:
            beta[at[a:b][first]] = np.add.reduceat(beta[to[a:b]] * probability[piece[a:b]], first)
        return self._uses(piece, alpha[at] * beta[to] * probability[piece], probability)

    def _backward(self, lattice):
        """(entry of the begin, entry of the end, piece) of all pieces by the place of their begin, last first, and the runs of one place."""
        starts, sizes, begin, end, piece, word, place = lattice
        before = begin - starts[word]
        order = np.argsort(begin - before * (int(starts[-1] + sizes[-1]) + 1), kind="stable")
        at, to = (begin + word)[order], (end + word + 1)[order]
        groups = [(a, b, np.flatnonzero(np.diff(at[a:b], prepend=-1))) for a, b in _groups(before[order])]
        return at, to, piece[order], groups

    def _uses(self, piece: np.ndarray, uses: np.ndarray, probability: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(piece, column, len(probability)) for column in np.ascontiguousarray(uses.T)], 1)


def _log_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Logs of sums over runs of rows that begin at first."""
    most = np.maximum.reduceat(values, first)
    return most + np.log(np.add.reduceat(np.exp(values - np.repeat(most, np.diff(np.append(first, len(values))), axis=0)), first))


def _dealt(words: list[str]) -> Iterator[tuple[list[int], bool]]:
    """Places of words that are summed together, short ones and long ones apart."""
    short, long, letters = [], [], 0
    for i, w in enumerate(words):
        if len(w) <= LONGEST:
            short.append(i)
            if len(short) == WORDS:
                yield short, False
                short = []
            continue
        if long and letters + len(w) > LETTERS:
            yield long, True
            long, letters = [], 0
        long.append(i)
        letters += len(w)
    for some, kind in ((short, False), (long, True)):
        if some:
            yield some, kind


def _groups(place: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(place, prepend=-1)).tolist() + [len(place)]
    return list(zip(cuts, cuts[1:], strict=False))


@held
def lattice_of(model_file: str) -> Lattice:
    return Lattice(model_file)


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case: its runs of letters. White space parts them, so a text's are those of its parts."""
    return WORD.findall(text.lower())


class _Counts(WordMemo):
    """Uses of parts between white space by language, and the expected counts of pieces drawn from them."""

    def __init__(self, lattice: Lattice, probability: np.ndarray):
        self.lattice, self.probability, self.total = lattice, probability, np.zeros_like(probability)
        self.parts: list[str] = []
        super().__init__(20)

    def learn(self, words: list[str]) -> None:
        self.parts += words

    def forget(self) -> None:
        if self.parts:
            place: dict[str, int] = {}
            pairs = [(i, place.setdefault(w, len(place))) for i, part in enumerate(self.parts) for w in words_of(part)]
            if pairs:
                part, word = np.array(pairs).T
                weights = np.zeros((len(place), self.uses.shape[1]))
                np.add.at(weights, word, self.uses[part])
                self.total += self.lattice.expected_counts([SPACE + w for w in place], weights, self.probability)
        super().forget()
        self.parts = []
        self.uses = np.zeros((1 << (self.table.bits - 1), self.probability.shape[1]))

    def count(self, batch: list[bytes], languages: np.ndarray) -> None:
        run, width = WordRun(batch), self.probability.shape[1]
        of = np.repeat(languages, np.diff(run.bounds))
        for a in range(0, len(run.hashes), RUN):
            at = self.numbers(run, a, a + RUN)
            np.add.at(self.uses.reshape(-1), at * width + of[a : a + RUN], 1.0)


@dataclass(frozen=True)
class LanguageModel:
    """Log-free piece probabilities: languages x (vocabulary and one entry for characters outside it)."""

    model_file: str
    languages: tuple[str, ...]
    probability: np.ndarray


def train(docs: DataFrame, model_file: str, rounds: int = 1, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from all rows with a language. Languages are the distinct values, in order; they are a small set by nature."""
    own = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where("lang is not null")
    languages = tuple(sorted(r[0] for r in own.select("lang").distinct().collect()))
    size = lattice_of(model_file).size + 1
    probability = np.full((size, max(1, len(languages))), 1.0 / size)
    for _ in range(rounds if languages else 0):
        given = own.sparkSession.sparkContext.broadcast(probability)
        number = {v: k for k, v in enumerate(languages)}

        def count(batches: Iterator[pa.RecordBatch], given=given, number=number) -> Iterator[pa.RecordBatch]:
            counts, seen = _Counts(lattice_of(model_file), given.value), False
            for b in slices(batches):
                raw, languages = raw_texts(b), np.array([number[v] for v in b.column("lang").to_pylist()], np.int64)
                for i, j in chunks(raw):
                    counts.count(raw[i:j], languages[i:j])
                seen = True
            counts.forget()
            total = counts.total
            if seen:
                padded = np.zeros((-(-size // SLICE) * SLICE, total.shape[1]))
                padded[:size] = total
                parts = padded.reshape(-1, SLICE * total.shape[1])
                yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "counts"])

        rows = summed(own.mapInArrow(count, "part int, counts binary")).collect()
        expected = np.zeros((-(-size // SLICE), SLICE * len(languages)))
        for part, counts in rows:
            expected[part] = np.frombuffer(counts)
        expected = expected.reshape(-1, len(languages))[:size] + ADDED
        probability = expected / expected.sum(0)
        probability[-1] = ALONE
    return LanguageModel(model_file, languages, probability)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) of each row, or with keep all columns of docs and these two last. score is the posterior of lang_pred at equal priors.

    With keep, underscores are added to the two names where docs has such a column; without, other columns do not matter. Repeated rows are rows of their own.

    `und` with score 0 for null texts, for texts without a letter, and if no language was learned.
    """
    own = docs if keep else docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    name = text_col if keep else "text"
    out = own.schema if keep else own.select("doc_id").schema
    pred, sure = free(out.names, "lang_pred", "score")
    out = StructType([*out.fields, StructField(pred, StringType()), StructField(sure, DoubleType())])
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        scorer = Scorer(m)
        for b in slices(batches):
            names, scores = [], []
            for ll in scorer.totals(raw_texts(b, name)):
                if ll is None or not m.languages:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                else:
                    best = int(np.argmax(ll))
                    names.append(m.languages[best])
                    scores.append(float(1 / np.exp(ll - ll[best]).sum()))
            columns = b.columns if keep else [b.column(0)]
            yield pa.record_batch([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], out.names)

    return own.mapInArrow(run, out)


class Scorer(WordMemo):
    """Log probabilities of texts, with a memo of their parts between white space."""

    def __init__(self, model: LanguageModel):
        self.model, self.lattice = model, lattice_of(model.model_file)
        super().__init__(21)

    def forget(self) -> None:
        super().forget()
        size = 1 << (self.table.bits - 1)
        self.logs, self.letters = np.zeros((size, self.model.probability.shape[1])), np.zeros(size, bool)

    def learn(self, words: list[str]) -> None:
        first, place = self.table.count, {}
        pairs = [(i, place.setdefault(w, len(place))) for i, part in enumerate(words) for w in words_of(part)]
        self.logs[first : first + len(words)] = 0.0
        # \w has numerals that are no letters
        self.letters[first : first + len(words)] = [any(map(str.isalpha, part)) for part in words]
        if pairs:
            part, word = np.array(pairs).T
            np.add.at(self.logs, first + part, self.lattice.log_totals([SPACE + w for w in place], self.model.probability)[word])

    def totals(self, batch: list[bytes]) -> list[np.ndarray | None]:
        """Of each text the log probability by language, None without a letter."""
        out: list[np.ndarray | None] = []
        for i, j in chunks(batch):
            run = WordRun(batch[i:j])
            sums, letters = np.zeros((j - i, self.logs.shape[1])), np.zeros(j - i, bool)
            for a in range(0, len(run.hashes), RUN):
                at = self.numbers(run, a, a + RUN)
                bounds = np.clip(run.bounds, a, a + len(at)) - a
                some = np.flatnonzero(np.diff(bounds))
                sums[some] += np.add.reduceat(self.logs[at], bounds[some])
                letters[some] |= np.logical_or.reduceat(self.letters[at], bounds[some])
            out += [x if known else None for x, known in zip(sums, letters, strict=True)]
        return out


def held_out(id_column, parts: int, part: int) -> F.Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % parts == part, F.lit(False))


def language_report(docs: DataFrame, model_file: str, id_col: str = "doc_id", **columns) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows whose crc32(doc_id) mod 4 is not 2."""
    model = train(docs.where(~held_out(docs[id_col], 4, 2)), model_file, **columns)
    found = identify(docs, model, id_col, columns.get("text_col", "text"))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
