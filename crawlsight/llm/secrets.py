"""Secret scans with an incremental blob ledger. Native column expressions only.

A text is a blob, addressed by its SHA-256. A rule's version is a digest of what it says. The ledger holds which
pairs of blob and rule version are scanned, with their findings; only unseen pairs are scanned, each once however
many paths carry the blob, and findings are joined back to every path.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping; kept where ``keep`` (of the match) holds.

    ``hint``: a cheaper test that every kept match passes.
    """

    kind: str
    pattern: str
    keep: str
    hint: str
    base: bool = True

    @property
    def version(self) -> str:
        """Changes with anything the rule says."""
        return f"{self.kind}-{sha256(repr(astuple(self)).encode()).hexdigest()[:12]}"


#: The kinds and patterns to find, in the order in which equal starts are listed.
_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
RULES = (
    Rule("assign", _ASSIGN, "{6,}", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", "20", "AKIA"),
    Rule("hex", r"[0-9a-f]+", "24", r"[0-9a-f]{24}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "0", "PRIVATE KEY-----", base=False),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "40", r"eyJ", base=False),
)
FINDINGS = "array<struct<start:int,no:int,kind:string,stop:int,rule:string>>"
#: Hits of a text that are walked as one array; longer lists are walked in blocks of so many, so in linear time.
BLOCK = 256


def _kept(rule: Rule, match: Column) -> Column:
    if rule.keep == "{6,}":  # on the value, which ends the match
        return F.length(F.regexp_extract(match, rule.pattern, 1)) >= 6
    return F.length(match) >= int(rule.keep)


def _spans(text: Column, rule: Rule, no: int) -> Column:
    """Findings of one rule: where its matches stand, from what stands between them. Code points, from 0."""
    # runs of the pattern that are too short to keep are long before and after no match, so they needn't be cut out
    pattern = r"[0-9a-f]{24,}" if rule.kind == "hex" else rule.pattern
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(hits, lambda m, i: F.struct(
        F.length(F.element_at(between, i + 1)).alias("gap"), F.length(m).alias("size"), _kept(rule, m).alias("kept")
    ))
    empty = F.array().cast(FINDINGS)

    def walk(block: Column) -> Column:  # (at, out): the block's length and its findings, placed within the block
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda acc, x: F.struct(
            (acc["at"] + x.gap + x["size"]).alias("at"),
            F.when(x.kept, F.concat(acc["out"], F.array(_finding(acc["at"] + x.gap, F.lit(no), F.lit(rule.kind), acc["at"] + x.gap + x["size"], F.lit(rule.version)))))
            .otherwise(acc["out"]).alias("out"),
        ))

    starts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(BLOCK))
    walked = F.aggregate(
        F.transform(starts, lambda i: walk(F.slice(sizes, i, BLOCK))),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FINDINGS}>").alias("out")),
        lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(
            F.transform(b["out"], lambda x: _finding(acc["at"] + x.start, x.no, x.kind, acc["at"] + x.stop, x.rule))
        )).alias("out")),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(text.rlike(rule.hint), walked).otherwise(empty)


def _finding(start: Column, no: Column, kind: Column, stop: Column, rule: Column) -> Column:
    return F.struct(start.alias("start"), no.alias("no"), kind.alias("kind"), stop.alias("stop"), rule.alias("rule"))


def scan_text(text: Column, rules: tuple[Rule, ...] = RULES, wanted: Column | None = None) -> Column:
    """All findings in a text, by start, then rule order; with ``wanted`` (array) only of the rule versions in it."""
    spans = lambda r, i: _spans(text, r, i)
    if wanted is not None:
        spans = lambda r, i: F.when(F.array_contains(wanted, r.version), _spans(text, r, i)).otherwise(F.array().cast(FINDINGS))
    return F.array_sort(F.concat(*(spans(r, i) for i, r in enumerate(rules))))


def address(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, store: Store | None = None):
    """(found, ledger): findings of ``docs`` (doc_id, text, more) by ``rules``, and the ledger with what was new.

    found: doc_id, blob, findings (array of start, no, kind, stop, rule), by the rules asked for alone; a null text is
    empty, a repeated row is found again. ledger: blob, rules (the versions scanned), findings; blobs without findings
    too, and a further row for a blob that later met a new or changed rule. Pass it to the next scan: only pairs of
    blob and rule version that it doesn't have are scanned, so one changed rule scans by that rule alone.
    """
    store = store or Store(docs.sparkSession, "secrets")
    text = F.coalesce(F.col("text"), F.lit(""))
    versions = F.array(*(F.lit(r.version) for r in rules))
    # doc_id and address tell which copy of a blob is scanned, the same in every scan of the input
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("key"), text.alias("text"), address(text).alias("blob"))
    paths = store.put(rows.select("doc_id", "key", "blob"), "paths")
    first, wanted = paths.groupBy("blob").agg(F.min("key").alias("key")), None
    if ledger is not None:  # a blob has at most one row for each rule version ever asked for
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        unseen = F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>")))
        first, wanted = first.join(seen, "blob", "left").select("blob", "key", unseen.alias("wanted")).where(F.size("wanted") > 0), F.col("wanted")
    # the one copy of each blob with unseen pairs; the texts are dealt by key, so evenly, and never sorted
    fresh = rows.join(first.hint("shuffle_hash"), ["key", "blob"], "left_semi" if wanted is None else "inner")
    scanned = fresh.select("blob", (versions if wanted is None else wanted).alias("rules"), scan_text(F.col("text"), rules, wanted).alias("findings"))
    new = store.put(scanned.dropDuplicates(["blob"]), "new")
    whole, hits = new, new.where(F.size("findings") > 0).select("blob", "findings")
    if ledger is not None:
        whole = ledger.select("blob", "rules", "findings").union(new)
        asked = F.transform(
            F.filter(F.flatten(F.collect_list("findings")), lambda x: F.array_contains(versions, x.rule)),
            lambda x: _finding(x.start, F.array_position(versions, x.rule).cast("int") - 1, x.kind, x.stop, x.rule),
        )
        hits = whole.where(F.size("findings") > 0).groupBy("blob").agg(F.array_sort(asked).alias("findings"))
    found = paths.join(hits, "blob", "left").select(
        "doc_id", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings")
    )
    return found, whole


def span_list(findings: Column, rules: tuple[Rule, ...] | None = None) -> Column:
    """kind:start:end of findings, comma-joined; only of ``rules`` if given."""
    if rules is not None:
        findings = F.filter(findings, lambda x: x.kind.isin([r.kind for r in rules]))
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x.kind, x.start, x.stop)), ",")


def redact(text: Column, findings: Column) -> Column:
    """The text with each finding replaced by ``[kind]``; of overlapping ones the first to start counts."""
    done = F.aggregate(
        findings, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x.start < acc["at"], F.struct(F.greatest(acc["at"], x.stop).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(x.stop.alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x.start - acc["at"]), F.lit("["), x.kind, F.lit("]")).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(findings) > 0, done).otherwise(text)
