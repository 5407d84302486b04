"""Validity of provisions: actions of documents, confirmed changes, patches and the status at a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The status that a confirmed change gives a chunk; `add` changes none.
STATUS = {"repeal": "repealed", "replace": "superseded", "amend": "amended", "replace_text": "amended"}


#: The status that an action gives the document acted on, the relation of that document to the acting one, and the relation back.
DOCUMENT_STATUS = {"amend": "Đã sửa đổi bổ sung", "replace": "Hết hiệu lực", "partial_repeal": "Hết hiệu lực một phần"}
RELATIONS = {"amend": ("amended_by", "amends"), "replace": ("replaced_by", "replaces"), "partial_repeal": ("partially_repealed_by", "partially_repeals")}
NOTES = {"replace": "Bị thay thế toàn bộ bởi ", "repeal": "Bị bãi bỏ bởi ", "amend": "Bị sửa đổi bởi "}


def _lookup(values: dict, key):
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def apply_document_actions(actions: DataFrame, docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, chunks, edges) after a log of what documents do to earlier ones.

    actions: position, source_id, source_name, action (amend, replace, partial_repeal; others do nothing), document_id (the earlier document), effective_date, scope (null or partial),
    provisions (array of article, clause, action). docs: document_id, source_name, validity_status, ... chunks: document_id, chunk_id, article, clause, text, status, effective_to,
    validity_note, ... Actions on documents that are not there do nothing.

    A document takes the status of the last action on it. replace repeals all its chunks; partial_repeal changes those whose article holds a provision's (in any case), and whose
    clause or text holds its clause if it names one, by that provision's action (repeal or amend); amend changes no chunk. The last provision (by position, then place) that names a
    chunk counts, and its date and source stay with the chunk. edges: document_id, other_id, other_name, relation, effective_date, scope (partial if it is said or provisions are named, else full),
    affected_provisions: each action in both directions."""
    known = actions.where(F.col("action").isin(list(DOCUMENT_STATUS))).join(docs.select("document_id", F.col("source_name").alias("_parent")), "document_id")
    named = F.coalesce(F.size("provisions") > 0, F.lit(False))
    known = known.withColumn("scope", F.when((F.col("scope") == "partial") | named, "partial").otherwise("full"))

    last = known.groupBy("document_id").agg(F.max_by("action", "position").alias("_action"))
    new_docs = docs.join(last, "document_id", "left").withColumn("validity_status", F.coalesce(_lookup(DOCUMENT_STATUS, F.col("_action")), "validity_status")).drop("_action")

    def edge(own, other, name, side):
        return F.struct(F.col(own).alias("document_id"), F.col(other).alias("other_id"), F.col(name).alias("other_name"), _lookup({k: v[side] for k, v in RELATIONS.items()}, F.col("action")).alias("relation"))

    both = F.array(edge("document_id", "source_id", "source_name", 0), edge("source_id", "document_id", "_parent", 1))
    provisions = F.when(F.col("scope") == "partial", F.coalesce("provisions", F.array().cast(actions.schema["provisions"].dataType)))
    edges = known.select(F.explode(both).alias("e"), "effective_date", "scope", provisions.alias("affected_provisions")).select("e.*", "effective_date", "scope", "affected_provisions")

    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    own = chunks.select("document_id", "chunk_id", low(F.col("article")).alias("_article"), low(F.col("clause")).alias("_clause"), F.lower(F.coalesce("text", F.lit(""))).alias("_text"))
    whole = known.where("action = 'replace'").select("document_id", "position", F.lit(-1).alias("place"), F.lit("repealed").alias("status"), "effective_date", F.concat(F.lit(NOTES["replace"]), "source_name").alias("note"), F.lit("").alias("_a"), F.lit("").alias("_c"))
    parts = known.where("action = 'partial_repeal'").select("document_id", "position", "effective_date", "source_name", F.posexplode("provisions").alias("place", "p")).where(F.col("p.action").isin("repeal", "amend") & (low(F.col("p.article")) != ""))
    cited = F.concat(F.lit(" ("), F.coalesce("p.article", F.lit("")), F.lit(" "), F.coalesce("p.clause", F.lit("")), F.lit(")"))
    parts = parts.select("document_id", "position", "place", _lookup(STATUS, F.col("p.action")).alias("status"), "effective_date", F.trim(F.concat(_lookup(NOTES, F.col("p.action")), "source_name", cited)).alias("note"), low(F.col("p.article")).alias("_a"), low(F.col("p.clause")).alias("_c"))
    hits = own.join(whole.unionByName(parts), "document_id").where(F.col("_article").contains(F.col("_a")) & ((F.col("_c") == "") | F.col("_clause").contains(F.col("_c")) | F.col("_text").contains(F.col("_c"))))
    effect = hits.groupBy("chunk_id").agg(F.max_by(F.struct("status", "effective_date", "note"), F.struct("position", "place")).alias("_e"))
    new = lambda old, c: F.when(F.col("_e").isNotNull(), F.col(f"_e.{c}")).otherwise(F.col(old)).alias(old)
    changed = {"status": "status", "effective_to": "effective_date", "validity_note": "note"}
    new_chunks = chunks.join(effect, "chunk_id", "left").select(*(new(c, changed[c]) if c in changed else F.col(c) for c in chunks.columns))
    return new_docs, new_chunks, edges


def confirm_changes(changes: DataFrame, chunks: DataFrame, selected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, effects): chunks take the status of the last confirmed change (position) that names them; each change leaves a row in the log. selected
    (column position): only these changes are confirmed; null positions select nothing."""
    if selected is not None:
        changes = changes.join(selected.select("position"), "position", "left_semi")
    mapped = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    last = changes.where("action <> 'add'").withColumn("_r", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("position")))).where("_r = 1")
    last = last.select("chunk_id", F.coalesce(F.try_element_at(mapped, F.col("action")), F.lit("active")).alias("_s"))
    return chunks.join(last, "chunk_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s"), changes.select("chunk_id", "position", F.col("action").alias("effect_type"))


def patch_status(chunks: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """chunks with the status of patch (key, status) where there is one."""
    return chunks.join(patch.select(key, F.col("status").alias("_s")), key, "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def reindex(index: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """index without the chunks of the documents in fresh, and with the fresh ones."""
    return index.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def effective_as_of(chunks: DataFrame, effects: DataFrame, date: str, key: str) -> DataFrame:
    """key, status at a date: that of the last effect (effective_from, position) not after it, else active."""
    seen = effects.where(F.col("effective_from") <= F.lit(date).cast("date"))
    last = seen.groupBy(key).agg(F.max_by("status", F.struct("effective_from", "position")).alias("_s"))
    return chunks.select(key).distinct().join(last, key, "left").select(key, F.coalesce("_s", F.lit("active")).alias("status"))


def map_changes(changes: DataFrame, chunks: DataFrame, key: str, by: list[str]) -> DataFrame:
    """For each group of changes: how many were detected, how many of them name a chunk that is there, and how many chunks they name."""
    there = chunks.select(key).distinct().withColumn("_t", F.col(key))
    return changes.join(there, key, "left").groupBy(*by).agg(F.count("*").alias("detected"), F.count("_t").alias("mapped"), F.countDistinct("_t").alias("targets"))
