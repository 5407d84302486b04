"""Filters, joins, aggregates, windows and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_label


def filter_eq(df: DataFrame, **values) -> DataFrame:
    """Rows that equal the values given; a value of None asks for nothing."""
    return reduce(lambda d, kv: d if kv[1] is None else d.where(F.col(kv[0]) == kv[1]), values.items(), df)


def match_any(df: DataFrame, column: str, values) -> DataFrame:
    return df.where(F.col(column).isin(*values) if isinstance(values, (list, tuple, set)) else F.col(column) == values)


def exclude_expired(df: DataFrame, column: str, expired: Sequence) -> DataFrame:
    """Rows whose status is not among the expired; a null status stays."""
    return df.where(~F.coalesce(F.col(column).isin(*expired), F.lit(False)))


def widen(column: Column, rules: dict[str, list[str]]) -> Column:
    """The classes that a filter on a class admits."""
    return reduce(lambda c, kv: c.when(column == kv[0], F.array(F.lit(kv[0]), *map(F.lit, kv[1]))), rules.items(), F.when(column.isNull(), F.lit(None))).otherwise(F.array(column))


def search_contains(df: DataFrame, query: str, columns: Sequence[str], **facets) -> DataFrame:
    return filter_eq(df, **facets).where(F.lower(F.concat_ws(" ", *columns)).contains(query.lower()))


def resolve_user_ids(log: DataFrame, users: DataFrame, login: str, email: str) -> DataFrame:
    """log with the user whose email, or its part before the @, is the login, in any case: two equi-joins."""
    low = log.withColumn("_l", F.lower(F.trim(login)))
    whole = low.join(users, F.col("_l") == F.lower(email))
    part = low.join(users, (F.col("_l") == F.split_part(F.lower(email), F.lit("@"), F.lit(1))) & (F.col("_l") != F.lower(email)))
    return whole.unionByName(part).drop("_l")


def errors_of(**checks: Column) -> Column:
    """The names of the checks that hold, as an array."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())))


def count_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    counts = children.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias("n_children"))
    return parents.join(counts, F.col(parent_key) == F.col("_k"), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).drop("_k")


def asof_question(messages: DataFrame, by: str, order: Sequence[str], is_question: Column, value: Column, name: str = "question") -> DataFrame:
    """Each row with the latest question of its group at or before it: a window, no join."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn(name, F.last(F.when(is_question, value), ignorenulls=True).over(w))


def fuse_outer(dense: DataFrame, lexical: DataFrame, on: Sequence[str]) -> DataFrame:
    return dense.join(lexical, list(on), "full_outer")


def amend_theta(changes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Changes with the chunks they name: equal articles, and the clause absent, equal, or in the text. The article is the hash key."""
    c = changes.withColumn("_a", norm_label(F.col("article"))).withColumn("_c", norm_label(F.col("clause")))
    t = chunks.select(F.col("chunk_id"), F.col("text").alias("_t"), norm_label(F.col("chunk_article")).alias("_a"), norm_label(F.col("chunk_clause")).alias("_tc"))
    fits = (F.col("_c") == "") | (F.col("_c") == F.col("_tc")) | F.lower("_t").contains(F.col("_c"))
    return c.join(t, "_a").where(fits).drop("_a", "_c", "_t", "_tc")


def repeal_theta(provisions: DataFrame, chunks: DataFrame, exact: bool = True) -> DataFrame:
    """Provisions with the chunks of their article. exact=False also takes longer labels that begin or go on with the article's words
    ("1" in "10"): articles are compared as distinct labels, whose number does not grow with the chunks."""
    p = provisions.withColumn("_a", norm_label(F.col("article")))
    t = chunks.withColumn("_l", norm_label(F.col("chunk_article")))
    if exact:
        return p.join(t, F.col("_a") == F.col("_l")).drop("_a", "_l")
    labels = t.select("_l").distinct().withColumn("_part", F.explode(F.expr("array_distinct(flatten(transform(sequence(1, length(_l)), i -> transform(sequence(1, length(_l) - i + 1), n -> substring(_l, i, n)))))")))
    return p.join(labels, F.col("_a") == F.col("_part")).join(t, "_l").drop("_a", "_l", "_part")


def infer_parents(docs: DataFrame, catalog: DataFrame, hint: str, name: str) -> DataFrame:
    """docs with the catalog's rows whose name contains the document's hint, in any case; null and empty hints have none. Distinct names give their
    parts of the lengths that hints have, and a join on the part finds the pairs."""
    hints = docs.where(F.length(hint) > 0).withColumn("_h", F.lower(hint))
    sizes = [r[0] for r in hints.select(F.length("_h")).distinct().orderBy(F.length("_h")).collect()]
    named = catalog.withColumn("_n", F.lower(name))
    parts_of = lambda n: F.transform(F.sequence(F.lit(1), F.length("_n") - n + 1), lambda i: F.substr(F.col("_n"), i, F.lit(n)))
    parts = F.array_distinct(F.flatten(F.array(*(F.when(F.length("_n") >= n, parts_of(n)).otherwise(F.array().cast("array<string>")) for n in sizes)))) if sizes else F.array().cast("array<string>")
    held = named.select("_n").distinct().withColumn("_h", F.explode(parts)).join(hints.select("_h").distinct(), "_h", "left_semi")
    return hints.join(held, "_h").join(named, "_n").drop("_h", "_n")


def semi_selected(available: DataFrame, selected: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return available.join(selected, key, "left_semi"), selected.join(available, key, "left_anti")


def dim_labels(df: DataFrame, column: str, labels: dict[str, str]) -> Column:
    """The label of a code; the code itself if it has none."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column).cast("string")), F.col(column).cast("string"))


def percent(part: Column, whole: Column, digits: int = 0) -> Column:
    """Rounded half to even; 0 where there is no whole."""
    return F.when(whole > 0, F.bround(part / whole * 100, digits)).otherwise(F.lit(0.0))


def topic_topk(df: DataFrame, topic: str, k: int = 3) -> DataFrame:
    """The k most frequent topics and their share of the k together."""
    top = df.where(F.col(topic).isNotNull()).groupBy(topic).agg(F.count("*").alias("n")).orderBy(F.desc("n"), topic).limit(k)
    return top.withColumn("share", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100, 1))


def top_by(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked; pruned before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def majority(df: DataFrame, by: str, value: str, default: str) -> DataFrame:
    counts = df.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy(by, value).agg(F.count("*").alias("n"))
    best = top_by(counts, [by], [F.desc("n"), F.col(value)], 1).select(by, F.col(value).cast("string").alias("majority"))
    return df.select(by).distinct().join(best, by, "left").withColumn("majority", F.coalesce("majority", F.lit(default)))


def minmax_norm(hits: DataFrame, by: str, score: str, prior: str, weight: float = 0.8) -> Column:
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return weight * F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0) + (1 - weight) * F.col(prior)


def max_norm(by: str, score: str) -> Column:
    best = F.max(score).over(Window.partitionBy(by))
    return F.when(best > 0, F.col(score) / best).otherwise(0.0)


def last_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return top_by(df, [by], [F.desc(order)], n, "_r").drop("_r")


def run_diffs(runs: DataFrame, order: Sequence[str], metric: str, n: int = 6) -> DataFrame:
    """The last n runs with the difference to the run before, in hundredths; runs are few rows."""
    last = runs.orderBy(*(F.desc(c) for c in order)).limit(n)
    before = F.lag(metric).over(Window.partitionBy().orderBy(*order))
    return last.withColumn("diff", F.bround((F.col(metric) - before) * 100, 1))


def first_seen(df: DataFrame, by: Sequence[str], key: str, order: str) -> DataFrame:
    return top_by(df, [*by, key], [F.col(order)], 1, "_r").drop("_r")


def page_offset(df: DataFrame, keys: Sequence[str], page: int, size: int) -> DataFrame:
    page, size = max(page, 1), min(max(size, 10), 100)
    return df.orderBy(*keys).offset((page - 1) * size).limit(size)


def carry(df: DataFrame, by: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The latest non-null value at or before each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def template_match(forms: DataFrame, templates: DataFrame) -> DataFrame:
    """form, template, overlap, hits, score: the best template of each form by shared field keys and title words. Forms and templates have id, title
    and keys (array). A match needs two keys, or one and a title word."""
    part = lambda df, n, c: df.select(F.col("id").alias(n), F.explode(F.array_distinct(c)).alias("x"))
    words = F.split(F.lower(F.col("title")), "\\W+")
    keys = part(forms, "form", F.col("keys")).join(part(templates, "template", F.col("keys")), "x").groupBy("form", "template").agg(F.count("*").alias("overlap"))
    titles = part(forms, "form", words).join(part(templates, "template", words), "x").where("x <> ''").groupBy("form", "template").agg(F.count("*").alias("hits"))
    both = keys.join(titles, ["form", "template"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    fit = both.where("overlap >= 2 or (overlap >= 1 and hits >= 1)").withColumn("score", 100 * F.col("overlap") + 10 * F.col("hits"))
    return top_by(fit, ["form"], [F.desc("score"), F.col("template")], 1).drop("rank")


def upsert_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; new values where they are not null."""
    columns = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in columns))


def relation_edges(actions: DataFrame) -> DataFrame:
    """Both directions of each action (source, target, action) as edges."""
    names = {"amend": ("amends", "amended_by"), "replace": ("replaces", "replaced_by"), "partial_repeal": ("partially_repeals", "partially_repealed_by")}
    pick = lambda i: reduce(lambda c, kv: c.when(F.col("action") == kv[0], kv[1][i]), names.items(), F.when(F.lit(False), ""))
    there = actions.select(F.col("source").alias("document_id"), F.col("target").alias("other_id"), pick(0).alias("relation"))
    return there.unionByName(actions.select(F.col("target").alias("document_id"), F.col("source").alias("other_id"), pick(1).alias("relation")))


def one_row(*tables: DataFrame) -> DataFrame:
    """Tables of one row each, side by side in one row."""
    return reduce(lambda a, b: a.crossJoin(b), tables)


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    """df with a default in place of each null of the columns named."""
    return df.na.fill(defaults)


def index_stats(docs: DataFrame, chunks: DataFrame, index: DataFrame, indexed: Column, vector: str) -> DataFrame:
    """One row: documents, indexed ones, chunks, points and the size of vectors."""
    n_docs = docs.agg(F.count("*").alias("n_docs"), F.count_if(indexed).alias("n_indexed"))
    return one_row(n_docs, chunks.agg(F.count("*").alias("n_chunks")), index.agg(F.count("*").alias("n_points"), F.max(F.size(vector)).alias("size")))


def needs_attention(messages: DataFrame, by: str, order: Sequence[str], is_question: Column, question: Column, unsure: Column, n: int = 10) -> DataFrame:
    """The newest n rows that are unsure, with the question that each answers."""
    rows = asof_question(messages, by, order, is_question, question, "question_id")
    return rows.where(unsure).orderBy(*(F.desc(c) for c in order)).limit(n)


def flag_tables(text: Column, known: Column | None = None) -> Column:
    """Whether a chunk holds a table: known to, or by the marks of a table in its text."""
    marks = text.contains("[Bảng") | (text.contains("|") & text.contains("\n| ---")) | text.contains(" | ")
    return marks if known is None else F.coalesce(known, F.lit(False)) | marks


def validate_provisions(df: DataFrame, column: str, actions: Sequence[str], default: str = "repeal") -> DataFrame:
    """A row for each item of a JSON array of provisions: position, article, action (default where absent) and whether it is valid. An article is
    required; text that is no array, or an empty one, gives one row that is not valid."""
    items = df.select("*", F.posexplode_outer(F.from_json(column, "array<struct<article:string,action:string>>")).alias("position", "_p"))
    article, action = F.nullif(F.trim("_p.article"), F.lit("")), F.coalesce("_p.action", F.lit(default))
    return items.withColumns({"article": article, "action": action, "valid": article.isNotNull() & action.isin(*actions)}).drop("_p")


def join_chunks_docs(chunks: DataFrame, docs: DataFrame, on: str) -> DataFrame:
    """Chunks with their documents. Spark broadcasts the documents if its size estimate allows."""
    return chunks.join(docs, on)


def join_message_owner(messages: DataFrame, conversations: DataFrame, on: str, owner: Column, **wanted) -> DataFrame:
    """Messages that equal what is wanted, of conversations of the owner; both filters come before the join."""
    return filter_eq(messages, **wanted).join(conversations.where(owner), on)


def anti_new(incoming: DataFrame, existing: DataFrame, on: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not there yet."""
    return incoming.join(existing.select(*on), list(on), "left_anti")


def assign_projects(conversations: DataFrame, projects: DataFrame, key: str, members: str) -> DataFrame:
    """Conversations with assigned: whether a project lists them among its members (array)."""
    listed = projects.select(F.explode(members).alias(key)).distinct().withColumn("_in", F.lit(True))
    return conversations.join(listed, key, "left").withColumn("assigned", F.col("_in").isNotNull()).drop("_in")


def count_where(df: DataFrame, by: Sequence[str], counts: dict[str, Column], shares: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Rows (n), rows that meet each condition, and whole percentages of two conditions, in one pass; 0 where there is no whole."""
    found = [F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in counts.items())]
    parts = [percent(F.count_if(part), F.count_if(whole)).cast("int").alias(name) for name, (part, whole) in (shares or {}).items()]
    return df.groupBy(*by).agg(*found, *parts)


def daily_stats(df: DataFrame, ts: str, as_of: str, counts: dict[str, Column], share: tuple[Column, Column]) -> DataFrame:
    """Counts of the day of as_of and the percentage of one condition among another."""
    day = df.where((F.col(ts) >= F.date_trunc("day", F.lit(as_of).cast("timestamp"))) & (F.col(ts) < F.date_trunc("day", F.lit(as_of).cast("timestamp")) + F.expr("interval 1 day")))
    return count_where(day, [], counts, {"pct": share}).drop("n")


def count_subquery(df: DataFrame, keys: Sequence[str], page: int, size: int) -> DataFrame:
    """A page of rows, each with the number of all rows (total)."""
    return page_offset(df, keys, page, size).crossJoin(df.agg(F.count("*").alias("total")))


def status_breakdown(df: DataFrame, by: Sequence[str], status: str, values: Sequence[str]) -> DataFrame:
    """A column with the rows of each status; the values are named, so none is looked up first."""
    return df.groupBy(*by).pivot(status, list(values)).count().na.fill(0)


def group_min_order(fields: DataFrame, groups: Sequence[str], order: str) -> DataFrame:
    """group, name, first_order: the least order of the fields that refer to a name, for each column of references. Null refers to nothing."""
    refs = F.array(*(F.struct(F.lit(g).alias("group"), F.col(g).cast("string").alias("name")) for g in groups))
    named = fields.select(F.explode(refs).alias("_g"), order).where("_g.name is not null")
    return named.groupBy("_g.group", "_g.name").agg(F.min(order).alias("first_order"))


def one_of_groups(rows: DataFrame, by: Sequence[str], real: Column, boolean: Column) -> DataFrame:
    """Groups: fulfilled if any member has a real value; valid with two members or more, none of them boolean."""
    answered, plain = F.bool_or(F.coalesce(real, F.lit(False))), ~F.bool_or(F.coalesce(boolean, F.lit(False)))
    return rows.groupBy(*by).agg(answered.alias("fulfilled"), ((F.count("*") >= 2) & plain).alias("valid"))


def concat_group(df: DataFrame, by: Sequence[str], order: Sequence[str], text: str, sep: str = "\n\n", name: str = "text") -> DataFrame:
    """Texts of a group in order, joined; null texts are left out."""
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(text).cast("string").alias("_t"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), sep).alias(name))


def ocr_confidence(lines: DataFrame, doc: str, page: str, confidence: Column, digits: int = 6) -> DataFrame:
    """doc, confidence: the mean over pages of the mean over their lines; a page without one counts 0."""
    pages = lines.groupBy(doc, page).agg(F.avg(confidence).alias("_c"))
    return pages.groupBy(doc).agg(F.round(F.avg(F.coalesce("_c", F.lit(0.0))), digits).alias("confidence"))


def checklist_progress(items: DataFrame, by: Sequence[str], done: Column) -> DataFrame:
    """n, done and the percentage, rounded half up."""
    n = F.count_if(F.coalesce(done, F.lit(False)))
    return items.groupBy(*by).agg(F.count("*").alias("n"), n.alias("done"), F.round(n / F.count("*") * 100).cast("int").alias("pct"))


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """The place of each row in its group, from start."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + (start - 1))


def rank_per_query(hits: DataFrame, by: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The rank of each hit in its question's list, from 1, best score first."""
    return number_rows(hits, by, [F.desc(score), *ties], "rank", 1)


def enumerate_chunks(chunks: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """chunk_index: the position of a chunk in its document, from 0."""
    return number_rows(chunks, by, order, "chunk_index")


def reading_order(zones: DataFrame, by: Sequence[str], y: str, x: Sequence[str], tolerance: float = 6) -> DataFrame:
    """place: zones by rows of the page (bands of the tolerance's height), then from left to right, from 1."""
    return number_rows(zones, by, [F.floor(F.col(y) / tolerance), *x], "place", 1)


def group_digits(zones: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """digit_index: the place of a digit's zone in its group, from 0."""
    return number_rows(zones, group, order, "digit_index")


def order_by_keys(df: DataFrame, keys: Sequence[Column | str], unique: str) -> DataFrame:
    """Rows by the keys, and by a unique one, so that the order is total."""
    return df.orderBy(*keys, unique)


def limit_cases(cases: DataFrame, key: str, n: int, most: int = 200) -> DataFrame:
    """At most n cases, of 1 to most, by key."""
    return cases.orderBy(key).limit(min(max(n, 1), most))


def order_fields(fields: DataFrame, by: Sequence[str], order: str, index: str, key: str, members_first: str | None = None) -> DataFrame:
    """place: fields by their order; a condition over members stands just before the first of them; a field without either stands at 100 times
    its place (index) from 1."""
    at = [F.col(members_first) - 1] if members_first else []
    return number_rows(fields, by, [F.coalesce(*at, order, (F.col(index) + 1) * 100), key], "place", 1)


def union_candidates(**origins: DataFrame) -> DataFrame:
    """Candidates of all origins with the origin's name; a column that an origin lacks is null."""
    named = [df.withColumn("origin", F.lit(name)) for name, df in origins.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def ids_except(available: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Ids that are available and not selected, repeats counted."""
    return available.select(key).exceptAll(selected.select(key))


def relations_union(docs: DataFrame, edges: DataFrame, key: str, relations: str, entry: str) -> DataFrame:
    """docs with the entries of their edges appended to the relations (array), in order."""
    more = edges.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_more"))
    none = F.array().cast(edges.select(F.array(entry)).schema[0].dataType)
    return docs.join(more, key, "left").withColumn(relations, F.concat(F.coalesce(relations, none), F.coalesce("_more", none))).drop("_more")


def delete_cascade(gone: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the rows of the keys that are gone. A null key stays."""
    ids = gone.select(key).distinct()
    return [t.join(ids, key, "left_anti") for t in tables]


def retention_clear(key: str, *tables: DataFrame, ids: DataFrame | None = None) -> list[DataFrame]:
    """Each table (cases, results, runs) without the selected ids; without any row where none are selected."""
    return [t.limit(0) for t in tables] if ids is None else delete_cascade(ids, key, *tables)


def fallback_log(messages: DataFrame, by: str, order: Sequence[str], is_question: Column, question: Column, fallback: Column, n: int = 5) -> DataFrame:
    """The last n fallback answers with the question and the time of day (at); order begins with the time."""
    return needs_attention(messages, by, order, is_question, question, fallback, n).withColumn("at", F.date_format(order[0], "HH:mm"))
