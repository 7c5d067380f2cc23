"""LM scoring by cross-entropy difference.

A target model (documents of the target set) and a background model (all documents) are bigram models of the same
form over one vocabulary, the pieces of a public tokenizer. A document's score is the mean over its
tokens of the background's probability less the target's, in logs: low for what is like the target.

Counts cover all documents and are never capped: documents are dealt into blocks of bounded text,
each block's distinct bigrams are counted in it, the counts of all blocks are added up by bigram, and
each block gets back the totals of its own bigrams alone. So no task and no broadcast holds the
whole model; only the unigram totals (one per piece of the fixed vocabulary) go through the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .arrow import held, raw_texts
from .words import IdMemo, WordTable, chunks, mixed

#: Characters of text in a block, about.
BLOCK = 12_000_000
BITS = 16
BEGIN, END = 1, 2
DISCOUNT = 0.75
ADDED = 0.5


class Pieces:
    """Piece ids of words by a SentencePiece model, with a memo. Words are what ASCII white space parts."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = self.sp.get_piece_size()
        if self.size > 1 << BITS:
            raise ValueError("the vocabulary is too large for the keys of bigrams")
        self.memo = IdMemo(self._make, "<u2")

    def _make(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.sp.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), "<u2", int(sizes.sum())), sizes

    def bigrams(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(keys of the bigrams of all texts one after another, number of bigrams of each): each text stands between BEGIN and END."""
        ids, sizes = self.memo.encode(batch)
        begins = np.cumsum(sizes + 2) - sizes - 2
        whole = np.empty(len(ids) + 2 * len(batch), np.uint32)
        inside = np.ones(len(whole), bool)
        inside[begins] = inside[begins + sizes + 1] = False
        whole[begins], whole[begins + sizes + 1], whole[inside] = BEGIN, END, ids
        follows = np.ones(len(whole), bool)
        follows[begins] = False
        return ((whole[:-1] << BITS) | whole[1:])[follows[1:]], sizes + 1

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text between BEGIN and END."""
        keys, _ = self.bigrams([text.encode()])
        return np.append(keys >> BITS, keys[-1] & ((1 << BITS) - 1)).astype(np.int64)


@held
def pieces_of(model_file: str) -> Pieces:
    return Pieces(model_file)


def _counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often they occur."""
    s = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint32)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.append(first, len(s)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums counts of sorted runs by key."""
    keys, counts = (np.concatenate(z) for z in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def score_documents(docs: DataFrame, targets: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", target_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) of each row.

    targets names the documents of the target set; unknown and null ids in it do nothing. Losses are
    mean negative logs over the document's pieces and its end; difference = target_loss - background_loss. A
    null text counts as empty and is scored by its end alone. Repeated rows count each. Without targets the target
    model is uniform.
    """
    spark = docs.sparkSession
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK))
    place = lambda c: F.pmod(F.xxhash64(c.cast("string")), F.lit(blocks)).cast("int")
    # rows without an id are in no target set and may lie anywhere
    dealt = own.withColumn("block", F.when(own["doc_id"].isNull(), place(own["text"])).otherwise(place(own["doc_id"])))
    named = targets.select(targets[target_col].alias("doc_id")).where("doc_id is not null").distinct()
    named = named.withColumn("block", place(named["doc_id"]))
    kind = own.schema["doc_id"].dataType.simpleString()

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces, wanted = pieces_of(model_file), set(right.column("doc_id").to_pylist())
        # Of all documents, then of the target's: counted runs, and keys not counted yet.
        runs: list[list] = [[], []]
        fresh: list[list] = [[], []]
        held = 0

        def add() -> None:
            for r, f in zip(runs, fresh, strict=True):
                if f:
                    r[:] = [_merged([*r, _counted(f)])]
                    f.clear()

        for batch in left.to_batches(max_chunksize=512):
            named, raw = batch.column("doc_id").to_pylist(), raw_texts(batch)
            for i, j in chunks(raw):
                keys, sizes = pieces.bigrams(raw[i:j])
                fresh[0].append(keys)
                marked = np.fromiter((x in wanted for x in named[i:j]), bool, j - i)
                if marked.any():
                    fresh[1].append(keys[np.repeat(marked, sizes)])
                held += len(keys)
                if held > 4_000_000:
                    add()
                    held = 0
        add()
        if not runs[0]:
            return pa.table({"block": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "t": pa.array([], pa.int64())})
        key, n = runs[0][0]
        of_target = np.zeros(len(key), np.int64)
        if runs[1]:
            of_target[np.searchsorted(key, runs[1][0][0])] = runs[1][0][1]
        return pa.table({"block": pa.array(np.full(len(key), left.column("block")[0].as_py(), np.int32)), "key": key.astype(np.int64), "n": n, "t": of_target})

    counted = dealt.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(count, "block int, key long, n long, t long")
    asked = cut(counted.repartition("key"))
    model = cut(asked.groupBy("key").agg(F.sum("n").alias("n"), F.sum("t").alias("t")))
    answers = asked.select("block", "key").join(model, "key")

    # Of each piece: as context, its count and distinct followers; as token, its count. A row for each piece at most.
    size = pieces_of(model_file).size
    context = model.groupBy(F.shiftright("key", BITS).alias("a")).agg(F.sum("n"), F.sum("t"), F.count_if(F.col("n") > 0), F.count_if(F.col("t") > 0)).collect()
    token = model.groupBy(F.col("key").bitwiseAND((1 << BITS) - 1).alias("b")).agg(F.sum("n"), F.sum("t")).collect()
    contexts, tokens = np.zeros((4, size)), np.zeros((2, size))
    for r in context:
        contexts[:, r[0]] = r[1:]
    for r in token:
        tokens[:, r[0]] = r[1:]
    unigram = (tokens + ADDED) / (tokens.sum(1) + ADDED * size)[:, None]
    some = np.maximum(contexts[:2], 1)
    # Of each context: one over its count, and the share that goes to the unigrams.
    given = spark.sparkContext.broadcast((1 / some, np.where(contexts[:2] > 0, DISCOUNT * contexts[2:] / some, 1.0), unigram))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces, (inverse, rest, unigram) = pieces_of(model_file), given.value
        key = right.column("key").to_numpy()
        a, b = key >> BITS, key & ((1 << BITS) - 1)
        # of each bigram of the block: its losses, and its place by a hash
        losses = [-np.log(np.maximum(right.column(c).to_numpy() - DISCOUNT, 0) * inverse[k][a] + rest[k][a] * unigram[k][b]) for k, c in enumerate(("n", "t"))]
        table = WordTable(max(10, (2 * len(key)).bit_length()))
        table.add(mixed(key.astype(np.uint64)))
        out: list[list] = [[], [], []]
        for batch in left.to_batches(max_chunksize=512):
            raw = raw_texts(batch)
            for i, j in chunks(raw):
                keys, sizes = pieces.bigrams(raw[i:j])
                at = table.find(mixed(keys.astype(np.uint64)))
                for k in range(2):
                    out[k].append(np.add.reduceat(losses[k][at], np.cumsum(sizes) - sizes) / sizes)
                out[2].append(sizes)
        base, target, n = (np.concatenate(z) if z else np.zeros(0) for z in out)
        return pa.table({"doc_id": left.column("doc_id"), "n_tokens": pa.array(n.astype(np.int64), pa.int64()), "target_loss": pa.array(target, pa.float64()), "background_loss": pa.array(base, pa.float64())})

    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double")
    return scored.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
