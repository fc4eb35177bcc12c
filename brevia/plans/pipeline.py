"""The compaction of payloads: redact, route, collapse blocks, compact by kind, gate on fidelity, annotate, account."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redact import redact
from ..functions.route import detect
from ..functions.text import once, text_of
from ..functions.tokens import cost, count_tokens, price_per_mtok, token_estimate, token_units
from ..operators.code import compact_code
from ..operators.dedup import dedup_blocks
from ..operators.fidelity import fidelity, gate
from ..operators.logs import compact_logs
from ..operators.prose import compact_prose
from ..operators.records import compact_json
from ..options import Options
from ..sources.scratch import staged


class Compactor(Protocol):
    """Adds a column to a DataFrame with a unique key: the compacted text. Deterministic, and must not fail on any text."""

    def __call__(self, df: DataFrame, key: str, text: str, options: Options, out: str) -> DataFrame: ...


_PROSE: Compactor = lambda df, key, text, o, out: compact_prose(df, key, text, o.keep_ratio, o.normalize_whitespace, out)
_CODE: Compactor = lambda df, key, text, o, out: compact_code(df, text, out)
_REGISTRY: dict[str, Compactor] = {
    "json": lambda df, key, text, o, out: compact_json(df, text, o.keep_ratio, out),
    "log": lambda df, key, text, o, out: compact_logs(df, key, text, o.keep_ratio, out),
    "code": _CODE,
    "diff": _CODE,
    "table": _PROSE,
    "text": _PROSE,
}


def register(kind: str, compactor: Compactor) -> None:
    """Adds or replaces the compactor of a kind."""
    _REGISTRY[kind] = compactor


def compactor_of(kind: str) -> Compactor:
    return _REGISTRY.get(kind, _PROSE)


def reference_of(text: Column) -> Column:
    """The key of an original in the store: 12 hex digits of its SHA-256."""
    return F.substring(F.sha2(text_of(text), 256), 1, 12)


def note_of(ref: Column, saved: Column, marker: str) -> Column:
    """What is added to a text that has a reference: a line of its own; null without one."""
    return F.concat(F.lit(f"\n[{marker} "), ref, F.lit(" +"), saved.cast("string"), F.lit(" tokens — retrieve to expand]"))


def annotate(text: Column, ref: Column, saved: Column, marker: str) -> Column:
    return F.when(ref.isNull(), text).otherwise(F.concat(text, note_of(ref, saved, marker)))


#: The kind of payloads that are too short to be compacted.
SMALL = "passthrough"
RESULT = (
    "kind", "original_tokens", "compressed_tokens", "saved_tokens", "ratio", "reversible", "ref", "fidelity", "cost_saved_usd", "reverted", "secrets"
)


def compact(df: DataFrame, key: str = "id", text: str = "text", options: Options | None = None, forced_kind: str | None = None) -> DataFrame:
    """One row per payload: key, text (compacted and annotated), original and the columns of RESULT. key must be unique.

    The input is read once. Routed rows are staged by kind, so that each kind's plan reads only its own; what follows is
    told row by row, but for logs. Small payloads are never shown to a worker. forced_kind names a column that overrides the
    routing where it isn't null.
    """
    o = options or Options()
    token_count = lambda c: count_tokens(c, o.tokenizer, o.vocabulary)
    base = df.select(F.col(key).alias("id"), text_of(F.col(text)).alias("original"), (F.col(forced_kind) if forced_kind else F.lit(None).cast("string")).alias("forced"))
    base = base.withColumn("original_tokens", token_count(F.col("original")))
    big = F.lit(o.enabled) & (F.col("original_tokens") >= o.min_tokens)
    rows = base.withColumn("big", big).withColumn("given", F.when(F.col("big"), F.col("original")))
    if o.redact_secrets:
        rows = redact(rows, "given", "working")
    else:
        rows = rows.withColumns({"working": text_of(F.col("given")), "secrets": F.lit(0).cast("long")})
    rows = rows.withColumn("kind", F.when(F.col("big"), F.coalesce("forced", detect(F.col("working")))).otherwise(SMALL))
    if o.dedup:
        whole = F.col("kind").isin("json", SMALL)
        rows = rows.withColumn("working", F.when(whole, F.col("working")).otherwise(dedup_blocks(F.when(~whole, F.col("working")))))
    # null stands for the original, which isn't written twice
    changed = F.when(F.col("big") & (F.col("working") != F.col("original")), F.col("working"))
    rows = staged(rows.select("id", "original", "original_tokens", changed.alias("working"), "secrets", "kind"), by="kind")
    small = rows.where(F.col("kind") == SMALL).select("id", "original", "original_tokens", F.col("original").alias("compacted"), "kind", "secrets", F.lit(1.0).alias("fidelity"))
    rows = rows.where(F.col("kind") != SMALL).withColumn("working", F.coalesce("working", "original"))
    parts = None
    known: dict = {}
    for k, c in _REGISTRY.items():
        known.setdefault(id(c), (c, []))[1].append(k)
    for c, names in known.values():
        mine = rows.where(F.col("kind").isin(*names) if c is not _PROSE else F.col("kind").isin(*names) | ~F.col("kind").isin(*_REGISTRY))
        part = c(mine, "id", "working", o, "compacted").select("id", "original", "original_tokens", "compacted", "kind", "secrets")
        parts = part if parts is None else parts.unionByName(part)
    # what is measured below reads the compacted text several times
    parts = parts.withColumn("compacted", once(F.col("compacted")))
    measured = fidelity(parts, "id", "original", "compacted").unionByName(small)
    plain = F.col("kind") == SMALL
    reverted = ~plain & gate(F.col("kind"), F.col("original"), F.col("compacted"), F.col("fidelity"), o.quality_threshold)
    if o.redact_outputs:  # else texts that go out whole go out as they came
        measured = redact(measured, "original", "whole", "whole_secrets").drop("whole_secrets")
    else:
        measured = measured.withColumn("whole", F.col("original"))
    measured = measured.withColumn("reverted", reverted).withColumn("shown", F.when(F.col("reverted") | plain, F.col("whole")).otherwise(F.col("compacted")))
    changed = F.when(F.col("shown") != F.col("original"), F.col("shown"))
    exact = o.tokenizer != "heuristic" and bool(o.vocabulary)
    measured = measured.withColumn("units", F.lit(None).cast("int") if exact else once(F.when(changed.isNotNull(), token_units(changed))))
    recount = token_count(changed) if exact else token_estimate(F.col("shown"), F.col("units"))
    measured = measured.withColumn("first_tokens", F.when(changed.isNull(), F.col("original_tokens")).otherwise(recount))
    gain = F.greatest(F.lit(0), F.col("original_tokens") - F.col("first_tokens"))
    keep = F.lit(o.reversible) & (gain > 0) & ~F.col("reverted") & ~plain & (F.col("shown") != F.col("original"))
    measured = measured.withColumn("ref", F.when(keep, reference_of(F.col("original")))).withColumn("gain", gain)
    measured = measured.withColumn("final", annotate(F.col("shown"), F.col("ref"), F.col("gain"), o.marker))
    # the note opens a line, so no word of it is one with the text's last
    more = token_units(note_of(F.col("ref"), F.col("gain"), o.marker))
    again = token_count(F.when(F.col("ref").isNotNull(), F.col("final"))) if exact else token_estimate(F.col("final"), F.col("units") + more)
    tokens = F.when(F.col("ref").isNull(), F.col("first_tokens")).otherwise(again)
    measured = measured.withColumn("compressed_tokens", F.when(F.col("reverted") | plain, F.col("original_tokens")).otherwise(tokens))
    saved = F.greatest(F.lit(0), F.col("original_tokens") - F.col("compressed_tokens"))
    ratio = F.when(F.col("original_tokens") == 0, 0.0).otherwise(1.0 - F.col("compressed_tokens") / F.col("original_tokens"))
    price = price_per_mtok(F.lit(o.model), o.price_per_mtok)
    return measured.select(
        F.col("id").alias(key), F.col("final").alias("text"), "original", "kind", "original_tokens", "compressed_tokens", saved.cast("long").alias("saved_tokens"),
        ratio.alias("ratio"), F.col("ref").isNotNull().alias("reversible"), "ref", "fidelity", cost(saved, price).alias("cost_saved_usd"), "reverted", "secrets",
    )


def store_rows(results: DataFrame, created_at: Column) -> DataFrame:
    """(ref, content, kind, created_at) of what compact() made reversible; the caller writes it."""
    return results.where("ref is not null").select("ref", F.col("original").alias("content"), "kind", created_at.alias("created_at")).dropDuplicates(["ref"])
