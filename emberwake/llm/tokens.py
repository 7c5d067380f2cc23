"""Token-id files with Re-Pair grammar compression.

A file is a Parquet folder whose rows are blocks of about BLOCK ids in ascending doc_id order: document ids,
document lengths, and a payload in the format below. In each block, frequent pairs of adjacent
symbols are replaced by new symbols (nonterminals), round after round, until no pair is frequent or ROUNDS are done.
The payload holds the rules, the length each rule expands to, and the rest of the sequence, so
that any range of ids is decoded without the others.

Payload, little-endian: magic `RPG1`, uint32 base (first nonterminal), uint32 rules, uint32 symbols,
uint32 ids; then rules x (uint32 left, uint32 right), rules x uint32 expansion length, symbols x 3 bytes.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .arrow import held, raw_texts, slices
from .words import IdMemo, chunks

MAGIC = b"RPG1"
BLOCK = 1 << 20
#: A pair is replaced if it occurs this often; pairs a round takes at most; rounds at most.
FREQUENT = 16
EACH_ROUND = 8192
ROUNDS = 4
#: Characters below this are plain Latin: normal form C leaves them, and lower case is one to one.
PLAIN = 0x130
#: White space of the tokenizer's pattern below PLAIN that is not ASCII.
_WIDE = "[\x85\xa0]"
#: Broadcast the blocks' starts only below this number of blocks; beyond it they are joined by a shuffle.
FEW_BLOCKS = 100_000


def compress(ids: np.ndarray, base: int) -> bytes:
    """Re-Pair of one block. Ids are below base."""
    seq = ids.astype(np.int64)
    left, right, sizes = [], [], []
    lengths = np.ones(base, np.int64)
    for _ in range(ROUNDS):
        if len(seq) < 2:
            break
        pairs = (seq[:-1] << 24) | seq[1:]
        kinds, counts = _counted(pairs)
        often = np.flatnonzero(counts >= FREQUENT)
        if not len(often):
            break
        if len(often) > EACH_ROUND:
            often = np.sort(often[np.argsort(-counts[often], kind="stable")[:EACH_ROUND]])
        chosen = kinds[often]
        # Only pairs whose symbols are both in a chosen pair, each on its side, are looked up.
        sides = np.zeros((2, len(lengths)), bool)
        sides[0, chosen >> 24] = sides[1, chosen & 0xFFFFFF] = True
        maybe = np.flatnonzero(sides[0, seq[:-1]] & sides[1, seq[1:]])
        found = np.searchsorted(chosen, pairs[maybe])
        real = chosen[np.minimum(found, len(chosen) - 1)] == pairs[maybe]
        hit, at = np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64)
        hit[maybe[real]], at[maybe[real]] = True, found[real]
        # Overlapping pairs: every other one of a run, from the left.
        place = np.arange(len(hit))
        start = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0))
        take = hit & ((place - start) % 2 == 0)
        new = base + len(left)
        a, b = chosen >> 24, chosen & 0xFFFFFF
        made = lengths[a] + lengths[b]
        left += a.tolist()
        right += b.tolist()
        sizes += made.tolist()
        lengths = np.concatenate([lengths, made])
        keep = np.ones(len(seq), bool)
        keep[1:] = ~take
        seq = seq.copy()
        seq[:-1][take] = new + at[take]
        seq = seq[keep]
    rules = np.array([left, right], "<u4").T.tobytes() if left else b""
    packed = seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return MAGIC + np.array([base, len(left), len(seq), len(ids)], "<u4").tobytes() + rules + np.array(sizes, "<u4").tobytes() + packed


def _counted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(pairs)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.diff(np.append(first, len(s)))


class Grammar:
    """A payload, ready to decode."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token block")
        self.base, rules, symbols, self.ids = np.frombuffer(payload, "<u4", 4, 4).tolist()
        self.rules = np.frombuffer(payload, "<u4", 2 * rules, 20).reshape(-1, 2).astype(np.int64)
        sizes = np.frombuffer(payload, "<u4", rules, 20 + 8 * rules)
        raw = np.zeros((symbols, 4), np.uint8)
        raw[:, :3] = np.frombuffer(payload, np.uint8, 3 * symbols, 20 + 12 * rules).reshape(-1, 3)
        self.seq = raw.view("<u4")[:, 0].astype(np.int64)
        self.lengths = np.concatenate([np.ones(self.base, np.int64), sizes.astype(np.int64)])

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        while (big := seq >= self.base).any():
            at = np.cumsum(1 + big) - (1 + big)
            out = np.empty(len(seq) + int(big.sum()), np.int64)
            out[at[~big]] = seq[~big]
            rule = self.rules[seq[big] - self.base]
            out[at[big]], out[at[big] + 1] = rule[:, 0], rule[:, 1]
            seq = out
        return seq

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start..stop of the block; only the symbols that cover them are expanded."""
        stop = self.ids if stop is None else min(stop, self.ids)
        if stop <= start:
            return np.zeros(0, np.int64)
        if start == 0 and stop == self.ids:
            return self._expand(self.seq)
        ends = np.cumsum(self.lengths[self.seq])
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        before = int(ends[a - 1]) if a else 0
        return self._expand(self.seq[a : b + 1])[start - before : stop - before]


class Words:
    """A tokenizers file with memos of the ids of parts between ASCII white space, and of words.

    Its pattern never spans white space and its normalizer works on each part alike, so that the
    ids of a text are those of its parts, one after another. New parts of plain Latin characters,
    which composition leaves as they are, are put in lower case and cut into words by the same
    pattern here, and only new words go to the library, without the steps already done. All other parts go to it whole.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        tree = json.loads(self.tokenizer.to_str())
        first, *rest = tree["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in tree["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or first["type"] != "Split" or not first["invert"] or first["behavior"] != "Removed":
            raise ValueError("a tokenizer of other steps")
        # The pattern for the characters below PLAIN, with its classes written out, and the space that parts are joined by.
        pattern, plain = first["pattern"]["Regex"], [chr(c) for c in range(PLAIN)]
        for name in ("L", "N"):
            pattern = pattern.replace(rf"\p{{{name}}}", "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == name))
        self.pattern = re.compile(pattern.replace(r"\s", " ") + "| ")
        # Added tokens are found in the raw text, so parts that may hold one go the long way, as do those of other characters or white space.
        marks = "|".join(sorted({re.escape(t["content"][:2]) for t in tree["added_tokens"]}))
        self.special = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]|{_WIDE}" + (f"|{marks}" if marks else ""))
        #: Words parted by spaces, many in one call; each ends with a token of the end-of-word suffix, and no other token has it.
        self.plain = Tokenizer.from_str(json.dumps(tree | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}}))
        suffix = tree["model"]["end_of_word_suffix"]
        self.last = np.zeros(self.size, bool)
        for token, i in self.plain.get_vocab(with_added_tokens=False).items():
            self.last[i] = token.endswith(suffix)
        self.memo = IdMemo(self._make, self.kind)
        self.words: dict[str, bytes] = {}

    def _ids(self, new: list[str], into: dict[str, bytes]) -> None:
        """Of words, by one call for many."""
        width = np.dtype(self.kind).itemsize
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * width).tolist()
            if len(ends) != len(some):
                raise ValueError("a word of the pattern has no single end")
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, ends, strict=True):
                into[w] = raw[start:end]
                start = end

    def _make(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, and how many each has."""
        joined, lengths = " ".join(new), np.fromiter(map(len, new), np.int64, len(new))
        starts = np.cumsum(lengths + 1) - lengths - 1
        hits = np.array([m.start() for m in self.special.finditer(joined)], np.int64)
        long = np.zeros(len(new), bool)
        long[np.searchsorted(starts, hits, "right") - 1] = True
        runs, sizes = np.zeros(len(new), object), np.zeros(len(new), np.int64)
        if not long.all():
            if len(self.words) > 300_000:
                self.words.clear()
            words = self.words
            text = " ".join([w for w, skip in zip(new, long.tolist(), strict=True) if not skip]) if len(hits) else joined
            parts = self.pattern.findall(text.lower())
            self._ids([x for x in set(parts) if x not in words and x != " "], words)
            words[" "] = b""
            found = list(map(words.__getitem__, parts))
            counts = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            ends = np.append(np.flatnonzero(np.fromiter(map(" ".__eq__, parts), bool, len(parts))), len(parts) - 1)
            raw, ends = b"".join(found), counts[ends]
            sizes[~long] = np.diff(ends, prepend=0)
            if not long.any():
                return np.frombuffer(raw, self.kind), sizes // np.dtype(self.kind).itemsize
            runs[~long] = [raw[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        whole = [w for w, skip in zip(new, long.tolist(), strict=True) if skip]
        made = [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        runs[long], sizes[long] = made, list(map(len, made))
        return np.frombuffer(b"".join(runs.tolist()), self.kind), sizes // np.dtype(self.kind).itemsize

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as bytes of `kind`."""
        return self.encode_raw([t.encode() for t in batch])

    def encode_raw(self, batch: list[bytes]) -> list[bytes]:
        out, width = [], np.dtype(self.kind).itemsize
        for a, b in chunks(batch):
            ids, sizes = self.memo.encode(batch[a:b])
            raw, ends = ids.tobytes(), (np.cumsum(sizes) * width).tolist()
            out += [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        return out


@held
def words_of(file: str) -> Words:
    return Words(file)


def write_tokens(docs: DataFrame, file: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all whole texts, each with the end id, in ascending doc_id order (null first).

    A null text counts as empty; repeated rows are written each, equal ids in the order of their texts' hashes. The rows are
    range partitioned, so a file's part and block numbers follow the order of ids.
    """
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    ordered = own.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part = words_of(file), TaskContext.get().partitionId()
        end = np.array([end_id], words.kind).tobytes()
        base = max(words.size, end_id + 1)
        ids, lengths, parts, held, block = [], [], [], 0, 0

        def full() -> pa.RecordBatch:
            sequence = np.frombuffer(b"".join(parts), words.kind)
            values = [[part], [block], [len(sequence)], [ids], [lengths], [compress(sequence, base)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.binary()]
            return pa.record_batch([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["part", "block", "n_ids", "ids", "lengths", "payload"])

        for b in slices(batches):
            id_type = b.schema.field("doc_id").type
            for i, raw in zip(b.column("doc_id").to_pylist(), words.encode_raw(raw_texts(b)), strict=True):
                raw += end
                n = len(raw) // np.dtype(words.kind).itemsize
                if held and held + n > BLOCK:
                    yield full()
                    ids, lengths, parts, held, block = [], [], [], 0, block + 1
                ids.append(i)
                lengths.append(n)
                parts.append(raw)
                held += n
        if held:
            yield full()

    ordered.mapInArrow(run, f"part int, block int, n_ids long, ids array<{kind}>, lengths array<int>, payload binary").write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of a token file, and its ids if asked for."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    sizes = blocks.select("part", "block", "n_ids")
    starts = sizes.select("part", "block", (F.sum("n_ids").over(W.orderBy("part", "block")) - F.col("n_ids")).alias("first"))
    few = blocks.count() <= FEW_BLOCKS
    placed = blocks.join(F.broadcast(starts) if few else starts, ["part", "block"])
    extra = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(iter([whole]), 1):
                lengths = np.array(b.column("lengths")[0].as_py(), np.int64)
                ids = Grammar(b.column("payload")[0].as_py()).decode().astype("<u4")
                ends = np.cumsum(lengths)
                own = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [b.column("ids")[0].values, pa.array(ends - lengths + b.column("first")[0].as_py(), pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    return placed.select("ids", "lengths", "payload", "first").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long{extra}")


def token_report(docs: DataFrame, file: str, path: str | None = None, **columns) -> DataFrame:
    """Writes the token file (in the shared checkpoint folder unless path is given) and reads it back."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/token-files/{uuid.uuid4().hex}"
    write_tokens(docs, file, path, **columns)
    return read_tokens(spark, path)
