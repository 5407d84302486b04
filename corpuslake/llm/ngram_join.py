"""Near-duplicate documents: an n-gram Jaccard self-join with token-combination prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ODD, bloom_words, discard, fresh, hinted, id_and_text, may_hold, mix, sliding, text_blocks, tidy, word_hashes, written
from .components import connected_components

N, PERCENT = 5, 75
HEAVY_KEYS = 1 << 20
FREQUENT = 32
TASK_KEYS = 1 << 17
CHUNK = 1 << 20
SAMPLE = 4
STAR_ROUNDS = 2
WIDE = 256
SEEN = 1 << 18
BIT_WORDS = 8


def shingle_sets(batch: pa.RecordBatch, n: int = N) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct hashes of the n-word shingles of each row: words are lower-cased (A-Z) and parted by ASCII white
    space; fewer words are one shingle; no words, none."""
    for first, data, offsets in text_blocks(batch):
        words, at = word_hashes(data, offsets)
        runs = sliding(words, n)
        for i in range(len(offsets) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= n:
                yield first + i, np.unique(runs[a : b - n + 1])
            elif b > a:
                short = np.array([int.from_bytes(hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest(), "little")], np.uint64)
                yield first + i, short
            else:
                yield first + i, words[:0]


def set_key(tokens: np.ndarray) -> int:
    """A signed 64-bit key of a set of shingles."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _summaries(n: int) -> Callable:
    """A row (doc_id, key, n) for each document, and (token, count) of the task's most frequent shingles over all its documents, if they
    come twice, in bounded memory: of equal counts the smallest hashes stay, so that tasks agree on which to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            all_ = np.concatenate([tokens, *held])
            weights = np.concatenate([counts, np.ones(size, np.int64)])
            order = np.argsort(all_, kind="stable")
            all_, weights = all_[order], weights[order]
            firsts = np.flatnonzero(np.r_[True, all_[1:] != all_[:-1]]) if len(all_) else np.zeros(0, np.int64)
            t, c = all_[firsts], np.add.reduceat(weights, firsts) if len(firsts) else weights
            if len(t) > TASK_KEYS:
                best = np.lexsort((t, -c))[:TASK_KEYS]
                t, c = t[best], c[best]
            return t, c

        for batch in batches:
            ids = batch.column(0).to_pylist()
            keys, sizes = [], []
            for _, s in shingle_sets(batch, n):
                keys.append(set_key(s) if len(s) else None)
                sizes.append(len(s))
                held.append(s)
                size += len(s)
                if size > CHUNK:
                    tokens, counts = merged()
                    held, size = [], 0
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), none, none], names=["doc_id", "key", "n", "token", "count"])
        tokens, counts = merged()
        tokens, counts = tokens[counts > 1], counts[counts > 1]
        none = pa.nulls(len(tokens), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(tokens.view(np.int64)), pa.array(counts)], names=["doc_id", "key", "n", "token", "count"])

    return tidy(run)


def frequent_tokens(summaries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of at most HEAVY_KEYS shingles that stand in more than FREQUENT documents, or more than a HEAVY_KEYS-th of all shingles, and the rank
    of each by count.

    Which shingles are called frequent decides how they are indexed, never which pairs are found."""
    total = summaries.agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT, total // HEAVY_KEYS)
    found = summaries.where("token is not null").groupBy("token").agg(F.sum("count").alias("c")).where(F.col("c") > least).toArrow()
    tokens, counts = found["token"].to_numpy().astype(np.int64).view(np.uint64), found["c"].to_numpy().astype(np.int64)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, counts))] = np.arange(len(tokens))
    order = np.argsort(tokens)
    return tokens[order], rank[order]


def ranks(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rank of each token among the frequent ones, or -1."""
    known, rank = frequent
    if not len(known):
        return np.full(len(tokens), -1, np.int64)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, rank[at], -1)


def errors(n: int, percent: int = PERCENT) -> int:
    """How many of n shingles a partner may lack."""
    return n - -(-n * percent // 100)


def classes_of(band: int) -> int:
    """Number of classes of frequent shingles for documents of 2**band to 2**(band + 1) - 1 shingles."""
    return max(1, (1 << band) // 16)


def signatures(n: int, alone: int, shared: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set of n shingles, and with each how many shingles of the set can't stand before the first that a partner shares.

    All sets stand in one order: the `alone` shingles that no other set has, then `shared`, the rare ones by count, then the `frequent` ones.
    A partner lacks at most t shingles, so of the first t + 1 it shares one: those of them that are rare and shared are signatures of their own. If
    only frequent ones are shared, frequent shingles fall into classes by hash, and a signature is a pair within a class. Two similar sets share at
    least p - t of the first p shingles of the one whose prefix ends first, so with d classes in the prefix, p - t > d shared ones include two
    of a class. The prefix is extended until then. The number of classes follows the size, so that classes stay small; a set signs for its own band
    of sizes and for that of its largest partners. A set of which more than t shingles are its own has no partner and no signature.
    """
    spare = errors(n, percent)
    rare = alone + len(shared)
    single = shared[: max(0, spare + 1 - alone)]
    found, rest = [mix(single)], [n - alone - np.arange(len(single))]
    if rare <= spare:
        for band in sorted({n.bit_length() - 1, (n * 100 // percent).bit_length() - 1}):
            kind = (mix(frequent) % np.uint64(classes_of(band))).astype(np.int64)
            _, first = np.unique(kind, return_index=True)
            new = np.zeros(len(frequent), np.int64)
            new[first] = 1
            p = np.arange(rare + 1, n + 1)
            enough = np.flatnonzero(p - spare > np.cumsum(new))
            end = int(enough[0]) + 1 if len(enough) else len(frequent)
            label = mix(frequent[:end] ^ mix(np.full(1, band + 1, np.uint64)))
            order = np.argsort(kind[:end], kind="stable")
            kind, label = kind[:end][order], label[order]
            for step in range(1, end):
                same = kind[step:] == kind[:-step]
                if not same.any():
                    break
                x, y = label[step:][same], label[:-step][same]
                found.append(mix(np.minimum(x, y) * ODD + np.maximum(x, y)))
                rest.append(np.full(len(x), n - rare))
    return np.concatenate(found), np.concatenate(rest)


def _samples(n: int, percent: int, frequent) -> Callable:
    """(token, key, need) of the first shingles by hash of each set, a few more than it has errors: `need` of the rare ones among them must stand in
    other sets, or too many are its own for any partner. Where no rare one is needed, a row with the key as token. A set comes once a task, unless
    more than SEEN others came between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts: list[tuple[np.ndarray, int, int]] = []
            held = 0
            for _, s in shingle_sets(batch, n):
                spare = errors(len(s), percent)
                if len(s) * 100 // percent == len(s) or (key := set_key(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                p = min(len(s), spare + spare // 4 + 1)
                rare = s[:p][ranks(s[:p], frequent.value) < 0]
                need = len(rare) - spare
                parts.append((rare, key, need) if need > 0 else (np.array([key], np.int64).view(np.uint64), key, 0))
                held += len(parts[-1][0])
                if held > CHUNK:
                    yield _rows(parts)
                    parts, held = [], 0
            if parts:
                yield _rows(parts)

    return tidy(run)


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    """(token, key, need): each of the parts' arrays with its two numbers."""
    counts = [len(t) for t, _, _ in parts]
    keys, needs = (np.repeat(np.array([x[i] for x in parts], np.int64), counts) for i in (1, 2))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in parts]).view(np.int64)), pa.array(keys), pa.array(needs.astype(np.int32))], names=["token", "key", "need"])


def _elsewhere(rows: DataFrame) -> DataFrame:
    """rows (token, key, ...), once each, with df, how many rows the token has, and `shared`: whether other keys have the token too. No token here is
    frequent, so none fills a task."""
    w = Window.partitionBy("token").orderBy("key")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("before", F.lag("key").over(w)).withColumn("shared", F.first("key").over(whole) != F.last("key").over(whole)).withColumn("df", F.count("*").over(whole))
    return rows.where("before is null or before <> key").drop("before")


def _wanted_sets(n: int, words: np.ndarray) -> Callable:
    """(key, tokens) of the documents that the filter lets pass, once a task as in _samples()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.filter(pa.array(may_hold(words, ids.view(np.uint64))))
            keys, sets, held = [], [], 0
            for _, s in shingle_sets(batch, n):
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                keys.append(key)
                sets.append(s.view(np.int64))
                held += len(s)
                if held > CHUNK:
                    yield _sets(keys, sets)
                    keys, sets, held = [], [], 0
            if keys:
                yield _sets(keys, sets)

    return tidy(run)


def _sets(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["key", "tokens"])


def _lists_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a column of lists of longs, null as an empty one."""
    values, offsets, there = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield values[offsets[i] : offsets[i + 1]] if there[i] else values[:0]


def _postings(frequent) -> Callable:
    """(token, key) of the rare shingles of sets (key, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0
            for key, s in zip(batch.column(0).to_pylist(), _lists_of(batch.column(1)), strict=True):
                s = s.view(np.uint64)
                parts.append((s[ranks(s, frequent.value) < 0], key, 0))
                held += len(s)
                if held > CHUNK:
                    yield _rows(parts).select(["token", "key"])
                    parts, held = [], 0
            if parts:
                yield _rows(parts).select(["token", "key"])

    return tidy(run)


def parities(tokens: np.ndarray) -> np.ndarray:
    """64 * BIT_WORDS bits: whether an odd number of the tokens falls to each. Sets differ in at least as many tokens as bits."""
    odd = np.bincount((mix(tokens + ODD) % np.uint64(64 * BIT_WORDS)).astype(np.int64), minlength=64 * BIT_WORDS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _signed(percent: int, frequent) -> Callable:
    """(key, n, bits, sigs, rest) from (key, tokens, df, token): a set, and those of its rare shingles that stand in other sets, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, tokens = (_lists_of(batch.column(i)) for i in (2, 3))
            keys, sizes, bits, sigs, rests = [], [], [], [], []
            for key, s, df, shared in zip(batch.column(0).to_pylist(), _lists_of(batch.column(1)), counts, tokens, strict=True):
                s, shared = s.view(np.uint64), shared.view(np.uint64)
                rank = ranks(s, frequent.value)
                common = s[rank >= 0][np.argsort(rank[rank >= 0])]
                sig, rest = signatures(len(s), len(s) - len(common) - len(shared), shared[np.lexsort((shared, df))], common, percent)
                if len(sig):
                    keys.append(key)
                    sizes.append(len(s))
                    bits.append(parities(s))
                    sigs.append(sig.view(np.int64))
                    rests.append(rest.astype(np.int64))
            if keys:
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(y) for y in x])].astype(np.int32)), pa.array(np.concatenate(x))) for x in (bits, sigs, rests)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["key", "n", "bits", "sigs", "rest"])

    return tidy(run)


def _asked(words: np.ndarray) -> Callable:
    """The sets whose keys the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(words, batch.column(0).to_numpy().view(np.uint64))))

    return run


def _verified(percent: int) -> Callable:
    """Of rows (a, b, ta, tb) those whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(_lists_of(batch.column(2)), _lists_of(batch.column(3)), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return tidy(run)


def near_duplicate_groups(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: documents link when 100 * |A and B| >= percent * |A or B| over their shingle sets.

    component_id is the smallest doc_id reachable by links, itself included. A document without words (null, empty or blank text) has no
    shingles and links with nothing, so its component_id is its doc_id; so it is for a null doc_id, which can't be reached. Documents with
    equal sets link; rows that share a doc_id are one document with a row each. An empty table gives no rows. Other columns are not read.

    1. Sets: each document's set of 64-bit shingle hashes gives a key; equal sets are one node from here on. Tasks count shingles over all
       documents and tell which are frequent. 2. Candidates: a set lacks no more than its errors in a partner, so one with more shingles of its own
       among a sample of them has none; one shuffle of the samples by shingle tells. 3. The shingles of the sets left are counted by a second
       shuffle; prefixes, rarest shingles first, give signatures (see signatures()). Sets of a signature pair only where the places
       of the shared shingle leave enough behind it. 4. Stars: each set is paired, in SAMPLE of its lists, with the member that has the fewest
       rare shingles before the signature; pairs are verified on whole sets, links joined into components. 5. Lists that still hold several
       components go on: while they hold more than WIDE pairs a member, each member with another centre, drawn anew each round, and at last all
       pairs of members from different components, those of a list's main component only with others, if sizes, places and the parities of hashed
       shingles allow the similarity. So each pair that shares a signature is verified, ruled out by a bound, or already connected, and
       components are exact. Tables are deleted as soon as the next is written.
    """
    spark = docs.sparkSession
    source = id_and_text(docs)
    summaries = written(source.mapInArrow(_summaries(n), "doc_id long, key long, n long, token long, count long"), "summaries")
    members = summaries.where("n is not null").select("doc_id", "key", "n")
    heads = written(members.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("head")), "heads")
    frequent = spark.sparkContext.broadcast(frequent_tokens(summaries))
    source = source.where("doc_id is not null")
    samples = _elsewhere(source.mapInArrow(_samples(n, percent, frequent), "token long, key long, need int"))
    left = samples.where("shared or need = 0").groupBy("key", "need").agg(F.count("*").alias("c")).where("c >= need").select("key").distinct()
    left = written(left.join(heads, "key"), "candidates")
    sets = written(source.mapInArrow(_wanted_sets(n, bloom_words(left, "head")), "key long, tokens array<long>"), "sets")
    discard(left)
    shared = _elsewhere(sets.mapInArrow(_postings(frequent), "token long, key long")).where("shared").groupBy("key").agg(F.collect_list("df").alias("df"), F.collect_list("token").alias("token"))
    signed = written(sets.join(shared, "key", "left").select("key", "tokens", "df", "token").mapInArrow(_signed(percent, frequent), "key long, n long, bits array<long>, sigs array<long>, rest array<long>"), "signed")

    found = _joined_up(None, _links(_first_stars(signed, percent), sets, percent))
    for turn in range(STAR_ROUNDS + 1):
        lists, stats = _still_open(signed, found)
        if stats.rows:
            last = turn == STAR_ROUNDS or stats.pairs <= WIDE * stats.rows
            found = _joined_up(found, _links(_all_pairs(lists, signed, percent) if last else _star_pairs(lists, turn, percent), sets, percent))
        discard(lists)
        if not stats.rows or last:
            break
    discard(signed, sets)
    named = written(heads.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")), "named")
    by_key = written(named.join(named.groupBy("component").agg(F.min("head").alias("component_id")), "component").select("key", "component_id"), "groups")
    discard(heads, found, named)
    out = members.join(by_key, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _joined_up(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of the links and of what was found before."""
    out = connected_components(links if found is None else links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    discard(links, *([] if found is None else [found]))
    return out


def _members(signed: DataFrame, most: int | None = None) -> DataFrame:
    """A row (sig, key, n, rest) for each signature, or for the `most` smallest of each set."""
    pairs = F.arrays_zip("sigs", "rest")
    kept = [c for c in signed.columns if c not in ("sigs", "rest")]
    return signed.select(*kept, F.explode(pairs if most is None else F.slice(F.array_sort(pairs), 1, most)).alias("s")).select(*kept, F.col("s.sigs").alias("sig"), F.col("s.rest").alias("rest"))


def _fit(na: str, ra: str, nb: str, rb: str, percent: int):
    """Whether sets of these sizes may reach the similarity, if no shared shingle stands before the rest."""
    return F.least(ra, rb) * (100 + percent) >= (F.col(na) + F.col(nb)) * percent


def _to_centres(rows: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the rows with c, the centre of their list."""
    joined = rows.join(centres, "sig").select("sig", "key", "n", "rest", F.col("c.key").alias("a"), F.col("c.n").alias("na"), F.col("c.rest").alias("ra"), *([F.col("component").alias("cb"), F.col("c.component").alias("ca")] if "component" in rows.columns else []))
    differ = F.col("a") != F.col("key") if "component" not in rows.columns else F.col("ca") != F.col("cb")
    return joined.where(differ & _fit("n", "rest", "na", "ra", percent)).select("a", F.col("key").alias("b"))


def _first_stars(signed: DataFrame, percent: int) -> DataFrame:
    """Each set with the member of its list that has the fewest rare shingles before the signature: what others are near copies of has few."""
    rows = _members(signed.drop("bits"), SAMPLE)
    centres = rows.groupBy("sig").agg(F.max(F.struct((F.col("rest") / F.col("n")).alias("part"), "key", "n", "rest")).alias("c"), F.count("*").alias("m")).where("m > 1")
    return _to_centres(rows, centres, percent)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of keys whose sets reach the similarity."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    asked = bloom_words(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key")
    some = written(sets.mapInArrow(_asked(asked), "key long, tokens array<long>"), "asked")
    with_b = pairs.join(some.select(F.col("key").alias("b"), F.col("tokens").alias("tb")), "b")
    both = with_b.join(some.select(F.col("key").alias("a"), F.col("tokens").alias("ta")), "a")
    out = written(both.select("a", "b", "ta", "tb").mapInArrow(_verified(percent), "a long, b long").distinct(), "links")
    discard(pairs, some)
    return out


def _still_open(signed: DataFrame, found: DataFrame):
    """The lists with members of several components (sig, key, n, rest, component, main: the component with most members), and how many rows and pairs
    across components they have. Of lists with the same members one is left, that of the first signature in the common order: it leaves most behind it."""
    named = signed.drop("bits").join(found.select(F.col("node").alias("key"), F.col("component").alias("c")), "key", "left").withColumn("component", F.coalesce("c", "key")).drop("c")
    rows = _members(named)
    several = written(rows.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig"), "several")
    rows = written(rows.join(several, "sig"), "rows")
    discard(several)
    members = F.struct(F.count("*"), F.min("key"), F.max("key"), F.sum(F.xxhash64("key").cast("decimal(20,0)")), F.sum(F.hash("key").cast("long")))
    lists = rows.groupBy("sig").agg(members.alias("members"), F.sum("rest").alias("rests"))
    one = written(lists.groupBy("members").agg(F.max(F.struct("rests", "sig")).alias("one")).select("one.sig"), "lists")
    parts = rows.join(one, "sig").groupBy("sig", "component").agg(F.count("*").alias("m"))
    parts = written(parts.groupBy("sig").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.max(F.struct("m", "component")).alias("main")), "parts")
    stats = parts.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("rows"), F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("squares")) / 2), F.lit(0)).alias("pairs")).first()
    out = written(rows.join(parts.select("sig", F.col("main.component").alias("main")), "sig"), "open")
    discard(one, parts, rows)
    return out, stats


def _star_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member of a list with one member, drawn by hash, where that is of another component."""
    centres = rows.groupBy("sig").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "key"), "key", "n", "rest", "component")).alias("c"))
    return _to_centres(rows, centres, percent)


def _all_pairs(rows: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """All pairs of members of a list that are of different components and may reach the similarity by size, place and parities; members of the main
    component are not paired with each other."""
    bits = [f"b{i}" for i in range(BIT_WORDS)]
    rows = rows.join(signed.select("key", *(F.col("bits")[i].alias(b) for i, b in enumerate(bits))), "key")
    x = rows.where("component <> main").select("sig", *(F.col(c).alias(f"{c}_a") for c in ("key", "n", "rest", "component", *bits)))
    y = rows.select("sig", "main", *(F.col(c).alias(f"{c}_b") for c in ("key", "n", "rest", "component", *bits)))
    once = (F.col("component_b") == F.col("main")) | (F.col("component_a") < F.col("component_b"))
    fit = _fit("n_a", "rest_a", "n_b", "rest_b", percent)
    both = F.col("n_a") + F.col("n_b")
    differ = sum((F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in bits), F.lit(0))
    alike = (both - differ) * (100 + percent) >= both * (2 * percent)
    return x.join(y, "sig").where(once & (F.col("component_a") != F.col("component_b")) & fit & alike).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def drop_near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs, with its own columns, without the documents that have a smaller doc_id in their group; a null doc_id stays. Null and empty texts stay, rows
    that share a doc_id stay or go together, and an empty table gives no rows. Columns may have any names."""
    name = fresh("dropped", docs)
    dropped = written(near_duplicate_groups(docs, n, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "dropped")
    return docs.join(hinted(dropped), docs["doc_id"].cast("long") == dropped[name], "left_anti")


def ngram_join_query(docs: DataFrame) -> DataFrame:
    return near_duplicate_groups(docs)
