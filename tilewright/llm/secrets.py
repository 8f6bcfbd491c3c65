r"""Secret scans over a ledger of blobs, with DataFrame functions only.

Every version of a text is a blob, named by its SHA-256. The ledger has a row for each pair of blob and rule version that
was ever scanned, with the spans found, if any. A scan reads only blobs of which a pair is missing, one document of each,
looks only for what is missing, and its findings are joined back to every document (path) that holds the blob. An
unchanged corpus costs a hash of each text and no pattern; a new or changed rule costs that rule alone.

Which texts to read is settled on a table of ids and digests before any text moves: the shorter of the two lists, of what
to scan or of what to leave out, is broadcast after a look at its size; beyond that it meets the texts in a shuffled join.

Positions come from splitting a text at a pattern's matches: pieces and matches alternate, so their running lengths are
starts and ends, in code points. Running sums come from doubling, so a text with any number of matches takes n log n steps.

Defined cases: null text is the empty blob; equal texts share a blob, however many paths hold it; repeated rows each get
their findings; a null id is a path like others; a text may have thousands of matches; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.rows import whole_row
from tilewright.functions.text import filled
from tilewright.llm.sized import checked
from tilewright.scratch import materialize, temporary

SPAN = "struct<start:int,kind:int,end:int>"
SPANS = f"array<{SPAN}>"
LEDGER = f"blob string, rule string, spans {SPANS}"

# The patterns of the contract, in the order in which kinds are listed. Where a match that is too short can
# only be followed by shorter ones of the same run, the least length stands in the pattern itself.
KINDS = ("assign", "access", "hex")
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MARK = "[SECRET]"

#: Rule versions by kind; a rule that changes gets a new version, and every blob is unseen under it.
RULES = {"assign": "assign-1", "access": "access-1", "hex": "hex-1"}
_PATTERNS = (ASSIGN, ACCESS, HEX)


def _running(numbers: Column) -> Column:
    """Running sums of an array, by adding each element to those 1, 2, 4, ... places on."""
    turns = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int")))

    def double(sums: Column, turn: Column) -> Column:
        apart = F.pow(F.lit(2), turn).cast("int")
        shifted = F.concat(F.array_repeat(F.lit(0), apart), sums)
        return F.when(F.size(sums) > apart, F.zip_with(sums, F.slice(shifted, 1, F.size(sums)), lambda x, y: x + y)).otherwise(sums)

    return F.aggregate(turns, numbers, double)


def _spans(text: Column, kind: int) -> Column:
    """Spans of a kind's matches, from the pieces of text between them."""
    pattern = _PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    long = F.transform(found, lambda hit: F.length(hit))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece)), 1, F.size(found))
    ends = _running(F.zip_with(gaps, long, lambda gap, n: gap + n))
    spans = F.zip_with(ends, long, lambda end, n: F.struct((end - n).alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
    if KINDS[kind] == "assign":
        secret = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.length(x))
        both = F.zip_with(spans, secret, lambda s, n: F.struct(s.alias("s"), n.alias("n")))
        spans = F.transform(F.filter(both, lambda x: x["n"] >= ASSIGN_LEAST), lambda x: x["s"])
    none = F.array().cast(SPANS)
    return F.when(text.rlike(pattern), spans.cast(SPANS)).otherwise(none)


def paths_of(docs: DataFrame) -> DataFrame:
    """``doc_id, blob``: which blob each document holds."""
    return docs.select("doc_id", F.sha2(filled(F.col("text")), 256).alias("blob"))


def unseen(paths: DataFrame, ledger: DataFrame | None, rules: dict[str, str] = RULES) -> DataFrame:
    """``blob, scan_id, missing``: one document for each blob of which ``ledger`` lacks pairs, and the rule versions they lack."""
    versions = F.array(*[F.lit(v) for v in sorted(rules.values())])
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("scan_id"))
    if ledger is None:
        return blobs.withColumn("missing", versions)
    known = ledger.where(F.col("rule").isin(*rules.values())).groupBy(F.col("blob").alias("known_blob")).agg(F.collect_set("rule").alias("known"))
    met = blobs.join(known, F.col("blob") == F.col("known_blob"), "left")
    missing = F.array_except(versions, F.coalesce("known", F.array().cast("array<string>")))
    return met.select("blob", "scan_id", missing.alias("missing")).where(F.size("missing") > 0)


def scan_unseen(docs: DataFrame, paths: DataFrame, ledger: DataFrame | None, rules: dict[str, str] = RULES) -> DataFrame:
    """Ledger rows for the pairs of blobs of ``docs`` and ``rules`` that ``ledger`` lacks."""
    pending = materialize(unseen(paths, ledger, rules), "blob-pending")
    n_pending, n_paths = pending.count(), paths.count()
    texts = docs.select("doc_id", filled(F.col("text")).alias("text")).withColumn("blob", F.sha2("text", 256))
    wanted = pending.select(F.col("blob").alias("w_blob"), "scan_id", "missing")
    pair = lambda other: (F.col("blob") == F.col(f"{other}_blob")) & F.col("doc_id").eqNullSafe(F.col("scan_id"))
    sets = [r.missing for r in pending.select("missing").distinct().collect()]  # at most one for each set of rules
    if 2 * n_pending > n_paths and len(sets) == 1:  # all lack the same: leave out the other paths
        others = paths.distinct().join(wanted, pair("w"), "left_anti").select(F.col("blob").alias("o_blob"), F.col("doc_id").alias("scan_id"))
        chosen = texts.join(checked(materialize(others, "blob-others"), 120), pair("o"), "left_anti")
        chosen = chosen.withColumn("missing", F.array(*[F.lit(v) for v in sets[0]]))
    else:
        chosen = texts.join(checked(wanted, 160), pair("w"))
    none = F.array().cast(SPANS)
    asked = sorted({v for x in sets for v in x})
    kinds = [(KINDS.index(kind), version) for kind, version in rules.items() if version in asked]
    each = lambda nth, version: F.when(F.array_contains("missing", version), _spans(F.col("text"), nth)).otherwise(none)
    found = chosen.select("blob", F.array(*[F.struct(F.lit(v).alias("rule"), each(k, v).alias("spans")) for k, v in kinds], F.struct(F.lit(None).cast("string").alias("rule"), none.alias("spans"))).alias("all"), "missing")
    apart = found.select("blob", F.explode(F.filter("all", lambda x: F.array_contains("missing", x["rule"]))).alias("one"))
    whole = apart.select("blob", "one.rule", "one.spans").groupBy("blob", "rule").agg(F.max("spans").alias("spans"))  # repeated rows scan one blob
    return whole.select("blob", "rule", F.col("spans").cast(SPANS).alias("spans"))


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: dict[str, str] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings of every document under ``rules`` and the ledger as it stands after the scan.

    Findings: ``doc_id, blob, spans``, spans by start, then kind as listed. Keep the second frame and give it to the next
    call: it scans only pairs of blob and rule version that are not in it.
    """
    paths = materialize(paths_of(docs), "blob-paths")
    fresh = materialize(scan_unseen(docs, paths, ledger, rules), "blob-ledger")
    after = fresh if ledger is None else ledger.unionByName(fresh)
    hits = after.where(F.col("rule").isin(*rules.values()) & (F.size("spans") > 0)).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    hits = hits.select(F.col("blob").alias("hit_blob"), F.sort_array("spans").alias("spans"))
    hits = materialize(hits, "blob-hits")
    findings = paths.join(hits, F.col("blob") == F.col("hit_blob"), "left")
    return findings.select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")), after


def named(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(one, ",")


def redact(text: Column, spans: Column, mark: str = MARK) -> Column:
    """``text`` with each span, or chain of overlapping spans, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        kept = F.concat(state["out"], text.substr(state["at"] + 1, span["start"] - state["at"]), F.lit(mark))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"), F.when(fresh, kept).otherwise(state["out"]).alias("out")
        )

    rest = lambda state: F.concat(state["out"], text.substr(state["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def redacted_documents(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` (and ``n_chars`` to match, where there is such a column).

    Documents without a finding pass as they are. Only blobs with findings are on the joined side.
    """
    with temporary() as tables:
        findings, _ = scan_secrets(docs, ledger)
        dirty = findings.where(F.size("spans") > 0).select(F.col("blob").alias("hit_blob"), "spans").dropDuplicates(["hit_blob"])
        dirty = tables.keep(dirty, "blob-dirty")
    rows = docs.select(whole_row(docs).alias("row"), filled(F.col("text")).alias("whole")).withColumn("blob", F.sha2("whole", 256))
    met = rows.join(checked(dirty, 200), rows["blob"] == dirty["hit_blob"], "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(redact(F.col("whole"), F.col("spans")))
    fields = {c: F.col("row").getField(c).alias(c) for c in docs.columns}
    met = met.withColumn("clean", text)
    fields["text"] = F.col("clean").alias("text")
    if "n_chars" in fields:
        changed = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("clean").cast("long"))
        fields["n_chars"] = changed.alias("n_chars")
    return met.select(*fields.values())
