"""N-gram Jaccard join with grouped prefixes.

Shingles stand in one global order: rare ones first, by a count sketch of fixed width, then by hash.
Two sets with Jaccard similarity of the threshold share a shingle among the first
n - ceil(t n) + 1 of each. Texts of equal sets are one member, and members with identical prefixes and
size are one group; postings exist for groups only. Pairs of groups that share a prefix shingle
are filtered by size and by position, expanded to members and verified exactly on the whole sets.

The result is the classes of linked documents, so no more pairs are made than it takes to know
them: first each group of a posting list is paired with one group of the list alone (a star), for a few
rounds with other hubs, and once those links are known, whatever pairs of a list stand in different
classes. A hub leaves its list with its star, since all its pairs are known then. In a list of near copies of one
text this leaves a few pairs in place of all. No list is gathered in a task.

Two exact bounds end most pairs that do not link. In the last join of lists: each set has MARKS bits, the
parity of its shingles in as many hash slots; two sets differ in as many shingles at least as in bits.
Before whole sets are fetched: the numbers of shingles in each of SLOTS hash slots bound what two sets share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut, discard, tidy
from .arrow import raw_texts, release, slices, summed
from .shingles import mixed, shingle_sets

#: Width of the count sketch and of the map of wanted documents. Fixed sizes: wider is only faster.
SKETCH_BITS = 20
WANTED_BITS = 23
#: Rows that a task remembers to have hashed; beyond, it forgets them.
DONE = 65_536
PARTS = 64
SLOTS = 256
MARKS = 1024
_FULL = 65_535
#: Rounds of stars before the pairs that are left.
STARS = 3


def _prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _member(s: np.ndarray) -> int:
    """The hash that names a set that is not empty."""
    return int(mixed(np.array([mixed(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _sketch(own: DataFrame, k: int) -> np.ndarray:
    """For each hash bucket, how much more often than the mean it occurs: one byte, logarithmic. 1 MB in all."""
    width = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(width, np.uint64)
        for b in slices(batches):
            sets = [s for s in shingle_sets(raw_texts(b), k) if len(s)]
            if sets:
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=width).astype(np.uint64)
        if total.any():
            rows = total.reshape(PARTS, -1)
            yield pa.record_batch([pa.array(range(PARTS), pa.int32()), pa.array([r.astype("<u4").tobytes() for r in rows], pa.binary())], ["part", "counts"])

    rows = summed(own.select("text").mapInArrow(count, "part int, counts binary"), "<u4", "uint64").collect()
    total = np.ones(width, np.uint64)
    for part, counts in rows:
        total[part * (width // PARTS) : (part + 1) * (width // PARTS)] = np.frombuffer(counts, np.uint64)
    over = np.log2(np.maximum(total, 1) / max(1.0, float(total.mean())))
    return np.clip(np.floor(4 * over), 0, 255).astype(np.uint8)


def _members(own: DataFrame, k: int, percent: int, kind: str) -> DataFrame:
    """(doc_id, text_key, n, member, grp, prefix, slots, marks) of each row: member and grp are hashes of the set, and of size and prefix."""
    spread = own.sparkSession.sparkContext.broadcast(_sketch(own, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rank = spread.value
        for b in slices(batches):
            n, member, group, prefix, slots, marks = [], [], [], [], [], []
            for s in shingle_sets(raw_texts(b), k):
                n.append(len(s))
                if len(s):
                    order = np.argsort(rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                    p = s[order[: _prefix(len(s), percent)]]
                    member.append(_member(s))
                    group.append(int(mixed(np.array([mixed(p + np.uint64(len(s))).sum()], np.uint64)).view(np.int64)[0]))
                    prefix.append(p.view(np.int64))
                    counts = np.bincount((s & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
                    slots.append(np.minimum(counts, _FULL).astype("<u2").tobytes())
                    odd = np.bincount((s >> np.uint64(8) & np.uint64(MARKS - 1)).astype(np.int64), minlength=MARKS) & 1
                    marks.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                else:
                    slots.append(None)
                    marks.append(None)
                    member.append(None)
                    group.append(None)
                    prefix.append(None)
            longs = pa.list_(pa.int64())
            columns = [b.column(0), b.column("text_key"), pa.array(n, pa.int64()), pa.array(member, pa.int64()), pa.array(group, pa.int64())]
            columns += [pa.array(prefix, longs), pa.array(slots, pa.binary()), pa.array(marks, longs)]
            yield pa.record_batch(columns, ["doc_id", "text_key", "n", "member", "grp", "prefix", "slots", "marks"])

    return own.mapInArrow(run, f"doc_id {kind}, text_key long, n long, member long, grp long, prefix array<long>, slots binary, marks array<long>")


def _near(a_n, b_n, a_pos, b_pos, percent: int) -> F.Column:
    """Whether two sets may still reach the threshold if these are the places of the first shingle they share."""
    rest = F.least(a_n - a_pos, b_n - b_pos)
    return (F.least(a_n, b_n) * 100 >= F.greatest(a_n, b_n) * percent) & (rest * (100 + percent) >= (a_n + b_n) * percent)


def _alike(a_n, b_n, a_marks, b_marks, percent: int) -> F.Column:
    """Whether two sets may reach the threshold: beyond it they differ in (100 - percent) / (100 + percent) of both sizes at most."""
    bits = [F.bit_count(a_marks[k].bitwiseXOR(b_marks[k])) for k in range(MARKS // 64)]
    return sum(bits[1:], bits[0]) * (100 + percent) <= (a_n + b_n) * (100 - percent)


def _sets(own: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(member, hashes) for wanted(doc_id, text_key, member), one row each. A fixed-size map of wanted rows spares most others the work."""
    row = F.xxhash64("doc_id", "text_key")
    bit = F.pmod(row, F.lit(1 << WANTED_BITS))
    cell = wanted.select(F.shiftright(bit, 12).alias("part"), (bit % 4096).cast("int").alias("bit")).distinct()
    rows = cell.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # 2048 rows of 4096 bits at most
    marks = np.zeros(1 << WANTED_BITS, bool)
    for part, bits in rows:
        marks[part * 4096 : (part + 1) * 4096] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[:4096]
    packed = own.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wants = np.unpackbits(packed.value)
        done: set[int] = set()
        for batch in batches:
            keys = batch.column("row").to_numpy()
            keep = np.zeros(len(keys), bool)
            for i in np.flatnonzero(wants[keys & ((1 << WANTED_BITS) - 1)]).tolist():
                if (key := int(keys[i])) not in done:  # repeated rows are hashed once
                    keep[i] = True
                    if len(done) >= DONE:
                        done.clear()
                    done.add(key)
            for b in slices(iter([batch.filter(pa.array(keep))])):
                sets = [s for s in shingle_sets(raw_texts(b), k) if len(s)]
                yield pa.record_batch([pa.array([_member(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["member", "hashes"])

    found = own.select(row.alias("row"), "text").mapInArrow(run, "member long, hashes array<long>")
    return found.join(wanted.select("member"), "member", "left_semi").dropDuplicates(["member"])


def _possible(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b), those whose slots allow the threshold: they share at most the smaller number of each slot."""
    one = members.select(F.col("member").alias("a"), F.col("n").alias("an"), F.col("slots").alias("as"))
    two = members.select(F.col("member").alias("b"), F.col("n").alias("bn"), F.col("slots").alias("bs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, SLOTS) for c in ("as", "bs"))
            share = np.minimum(x, y).sum(1, dtype=np.int64)
            share += ((x == _FULL) & (y == _FULL)).any(1) * (1 << 40)  # two full slots bound nothing
            most = share * (100 + percent) >= (b.column("an").to_numpy() + b.column("bn").to_numpy()) * percent
            yield pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(most))

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, own: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs(a, b), those that reach the threshold on their whole sets, which are made again for these members alone and then deleted."""
    left = tidy(_possible(pairs, members, percent))
    if left.isEmpty():
        return left
    wanted = left.select(F.col("a").alias("member")).union(left.select("b")).distinct()
    asked = cut(members.join(wanted, "member", "left_semi").select("doc_id", "text_key", "member"))
    sets = tidy(_sets(own, asked, k))
    one = sets.select(F.col("member").alias("a"), F.col("hashes").alias("a_hashes"))
    two = sets.select(F.col("member").alias("b"), F.col("hashes").alias("b_hashes"))
    both = left.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("a_hashes", "b_hashes"))
    union = F.size("a_hashes") + F.size("b_hashes") - F.col("shared")
    out = tidy(both.select("a", "b", "a_hashes", "b_hashes", shared.alias("shared")).where(F.col("shared") * 100 >= union * percent).select("a", "b").distinct())
    discard(left, asked, sets)
    return out


def jaccard_classes(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: documents linked at percent / 100 or more, transitively.

    component_id is the smallest id reachable. Null and empty texts have no shingles and are linked with
    nothing. Repeated rows, and rows of equal sets, are one member. A row with a null id counts for links and
    gets the class of its text. Members are told apart by 64-bit hashes of their sets.
    """
    return jaccard_rows(docs, percent, k, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def text_key(text: str | F.Column) -> F.Column:
    """The 64-bit hash that stands for a text where ids may be null or repeated."""
    return F.xxhash64(text)


def jaccard_rows(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As jaccard_classes(), with text_key of each row's text and class_id, which is null without shingles.

    Classes of equal component_id differ in class_id if an id is repeated with another text, or if no row of theirs has an id.
    """
    kind = docs.select(docs[id_col]).schema[0].dataType.simpleString()
    text = docs[text_col].cast("string")
    own = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), text_key(text).alias("text_key"))
    rows = tidy(_members(own, k, percent, kind))
    found = rows.where("member is not null")
    members = tidy(found.groupBy("member", "grp", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_key")).alias("row"), F.first("slots").alias("slots"), F.first("marks").alias("marks")).select("member", "grp", "n", "row.doc_id", "row.text_key", "slots", "marks"))
    postings = found.groupBy("grp", "n").agg(F.first("prefix").alias("prefix")).select("grp", "n", F.posexplode("prefix").alias("pos", "token")).repartition("token")
    often = postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    shared = tidy(postings.join(often.hint("shuffle_hash"), "token", "left_semi"))
    # Groups of several members are lists of their own: each member shares the whole prefix.
    several = members.groupBy("grp").agg(F.count("*").alias("c")).where("c > 1").select("grp")

    # Pairs of groups, by the first star; filtered, then expanded to members.
    hubs = shared.groupBy("token").agg(F.min(F.struct("grp", "n", "pos")).alias("h"))
    others = shared.join(hubs, "token").where(F.col("grp") != F.col("h.grp"))
    groups = others.where(_near(F.col("n"), F.col("h.n"), F.col("pos"), F.col("h.pos"), percent)).select("grp", F.col("h.grp").alias("hub")).distinct()
    left = members.select("grp", F.col("member").alias("x"))
    right = members.select(F.col("grp").alias("hub"), F.col("member").alias("y"))
    expanded = groups.join(left, "grp").join(right, "hub").select("x", "y")
    least = members.groupBy("grp").agg(F.min("member").alias("y"))
    within = members.join(several, "grp", "left_semi").join(least, "grp").where("member != y").select(F.col("member").alias("x"), "y")
    tried = tidy(expanded.union(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    links = _verified(tried, own, members, k, percent)
    classes = connected_components(links, "a", "b")

    # Stars with other hubs, between classes only; then all pairs of a list that still stand in different classes.
    lists = others.select("token", "grp", "pos").join(members.select("grp", "member", "n"), "grp").select("token", "member", "n", "pos")
    lists = lists.union(within.join(members, within["x"] == members["member"]).select(F.col("grp").alias("token"), "member", "n", F.lit(0).alias("pos")))
    kept = None
    for turn in range(1, STARS + 1):
        named = lists.join(classes, lists["member"] == classes["node"], "left").select("token", "member", "n", "pos", F.coalesce("component", "member").alias("cls"))
        open_ = named.groupBy("token").agg(F.min("cls").alias("l"), F.max("cls").alias("m")).where("l != m").select("token")
        before, lists = kept, tidy(named.join(open_, "token", "left_semi"))
        kept = lists
        if before is not None:
            discard(before)
        one = lists.select("token", F.col("member").alias("x"), F.col("n").alias("xn"), F.col("pos").alias("xp"), F.col("cls").alias("xc"))
        may = _near(F.col("xn"), F.col("yn"), F.col("xp"), F.col("yp"), percent)
        if turn < STARS:
            order = F.xxhash64("member", F.lit(turn))
            two = lists.groupBy("token").agg(F.min(F.struct(order.alias("o"), F.col("member").alias("y"), F.col("n").alias("yn"), F.col("pos").alias("yp"), F.col("cls").alias("yc"))).alias("h")).select("token", "h.*")
            apart = "xc != yc"
        else:
            marked = lists.join(members.select("member", "marks"), "member")
            one = marked.select("token", F.col("member").alias("x"), F.col("n").alias("xn"), F.col("pos").alias("xp"), F.col("cls").alias("xc"), F.col("marks").alias("xm"))
            two = marked.select("token", F.col("member").alias("y"), F.col("n").alias("yn"), F.col("pos").alias("yp"), F.col("cls").alias("yc"), F.col("marks").alias("ym"))
            may = may & _alike(F.col("xn"), F.col("yn"), F.col("xm"), F.col("ym"), percent)
            apart = "xc < yc"
        crossing = one.join(two, "token").where(apart).where(may).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        crossing = tidy(crossing.join(tried, ["a", "b"], "left_anti"))
        if turn < STARS:
            lists = lists.join(two.select("token", "y"), "token").where("member != y").select("token", "member", "n", "pos")
        more = _verified(crossing, own, members, k, percent)
        if not more.isEmpty():
            links = links.union(more)
            classes = connected_components(links, "a", "b")
        tried = tried.union(crossing)

    whole = members.join(classes, members["member"] == classes["node"], "left").select("member", "doc_id", F.coalesce("component", "member").alias("cls"))
    least = whole.groupBy("cls").agg(F.min("doc_id").alias("component_id"))
    known = whole.join(least, "cls").select("member", "component_id", F.col("cls").alias("class_id"))
    out = rows.select("doc_id", "text_key", "n", "member").join(known, "member", "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "class_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
