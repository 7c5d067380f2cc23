"""Secret scans with an incremental ledger of blobs. DataFrame and SQL functions only.

Every version of a text is a blob, addressed by its SHA-256. The ledger holds the findings of each
(blob, rule, rule version) that was ever scanned, also when it found nothing. A scan takes one copy of
each blob that has a rule version not in the ledger, scans it under those rules alone, adds the findings to the ledger
and joins them back to all paths (documents) of the blob. Only one copy's text is read by the rules,
however many copies there are; the group of copies itself is pre-aggregated by its address.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import free

SPAN = "struct<start:int,rank:int,kind:string,end:int>"


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if group `group` has `least` characters or more. `rank` orders kinds at one start."""

    kind: str
    rank: int
    version: int
    pattern: str
    group: int
    least: int
    base: bool = True


#: Fixed patterns of the base, then further kinds of keys.
RULES = (
    Rule("assign", 0, 1, r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", 1, 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 2, 1, r"[0-9a-f]+", 0, 24),
    Rule("private_key", 3, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    Rule("web_token", 4, 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, False),
    Rule("host_token", 5, 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, False),
)
#: What any match of the rule holds: a plain search that spares most texts the slower pattern.
NEEDS = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "private_key": r"-----BEGIN ",
    "web_token": r"eyJ",
    "host_token": r"gh[pousr]_",
}


def spans(text, rule: Rule) -> F.Column:
    """Array of SPAN: leftmost non-overlapping matches in code points, end exclusive; failing matches are dropped.

    The text is cut at the matches, and the lengths of cuts and matches give the places.
    """
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    cuts = F.transform(F.split(text, rule.pattern, -1), lambda c: F.length(c))
    both = F.arrays_zip(hits.alias("hit"), F.slice(cuts, 1, F.size(hits)).alias("gap"))

    def step(acc, z):
        start = acc["at"] + z["gap"]
        end = start + F.length(z["hit"])
        kept = F.length(F.regexp_extract(z["hit"], rule.pattern, rule.group)) >= rule.least
        one = F.array(F.struct(start.alias("start"), F.lit(rule.rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    walked = F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.coalesce(text.rlike(NEEDS.get(rule.kind, rule.pattern)), F.lit(False)), walked).otherwise(none)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, additions): findings(doc_id, blob, spans) for each row of docs, additions(blob, kind, version, spans) to the ledger.

    A null text counts as empty, and repeated rows or ids each get their findings. Without a ledger
    every blob is new. A blob and rule version in the ledger is not scanned again; a raised version is.
    """
    own = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    paths = own.select("doc_id", F.unhex(F.sha2("text", 256)).alias("blob"))
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("path"))
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        unseen = blobs.withColumn("due", current)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        unseen = blobs.join(seen, "blob", "left").withColumn("due", F.when(F.col("seen").isNull(), current).otherwise(F.array_except(current, F.col("seen")))).drop("seen").where(F.size("due") > 0)
    # One copy's text for each blob: a row that is not the path of a new blob leaves the plan here.
    copies = own.withColumn("blob", F.unhex(F.sha2("text", 256)))
    todo = copies.join(unseen.hint("shuffle_hash"), (copies["doc_id"].eqNullSafe(unseen["path"])) & (copies["blob"] == unseen["blob"])).select(copies["blob"], "text", "due")
    due = {r.kind: F.array_contains("due", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))) for r in rules}
    found = todo.select("blob", *[F.when(due[r.kind], spans(F.col("text"), r)).alias(r.kind) for r in rules])
    additions = found.select("blob", F.explode(F.filter(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(r.kind).alias("spans")) for r in rules]), lambda x: x["spans"].isNotNull())).alias("x")).select("blob", "x.*")
    return paths, additions


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Joins the ledger's findings under the given rules back to all paths: (doc_id, blob, spans), sorted by start, then rank."""
    versions = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    hit = ledger.where(F.size("spans") > 0).where(F.array_contains(versions, F.struct("kind", "version")))
    # Copies of one blob that were scanned together bring equal findings: a set of them.
    by_blob = hit.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"))
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def _line(spans) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def secret_report(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, **columns) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs."""
    paths, additions = scan(docs, ledger, rules, **columns)
    found = findings(paths, additions if ledger is None else ledger.select("blob", "kind", "version", "spans").unionByName(additions), rules)
    kinds = [r.kind for r in rules if r.base]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    named = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(named) - F.size(F.array_remove(named, k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each found span replaced by mask (overlapping spans by one); all rows and columns stay, a null text stays null.

    Findings are joined by address, so that each copy is masked alike; a path is matched by its blob. Columns of docs may have any names.
    """
    at, blob, found = free(docs.columns, "_address", "_blob", "_spans")
    paths, additions = scan(docs, None, rules, id_col, text_col)
    by_blob = findings(paths, additions, rules).where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(found)).distinct()
    text = docs[text_col].cast("string")

    def step(acc, s):
        free = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(free, piece).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2147483647))))
    joined = docs.withColumn(at, F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))).join(by_blob, F.col(at) == F.col(blob), "left")
    return joined.withColumn(text_col, F.when(F.col(found).isNull(), text).otherwise(masked)).select(*docs.columns)
