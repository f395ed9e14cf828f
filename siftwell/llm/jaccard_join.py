"""Near duplicates: the exact Jaccard join of word shingles, by a token-group matrix.

A document is the set of its shingles, as 64-bit hashes. Two steps keep all pairs from being looked at:

1.  Similar documents are put into groups. Each document posts the first tokens of its set
    in a common order, a token's postings are read as one sorted run, and every document is
    compared with the few that most of its runs begin with. A common token's postings are several such runs;
    a document that links with the first of none is compared with the first of all of them. Those that
    link, and equal sets, are joined into groups.
2.  The matrix: for each token, the groups in whose postings it stands, with the least and largest
    size of a set there and the token's first place in one. Of two groups that share
    posted tokens, the documents of the one with fewer sets are queries to the other: the many near copies of a text
    are asked by the few others, not each of them asks each of those. If a member links with a query, the two share a part of their
    first tokens, how many of how many depends on both sizes; so a group whose column has fewer of the query's tokens, or no
    set of a fitting size, is not opened. The part is kept small: the more tokens count as first, the more of them
    are common ones, by which texts meet that share much and do not link. Of the others
    the union of all tokens bounds the overlap once more, and the query is compared with
    members until one links: it joins the two groups, whose other members are joined
    already, so the squares of large groups never arise.

The order of tokens puts the commonest ones last, so a line or passage that many documents share does
not bring them together. It is counted over all documents, block by block, and at most 2^19 tokens
are held; any order gives the same links, so that bound changes work, not results. Large groups are cut into
chunks and queries into packs.

A null text counts as empty; a text without words has no shingles and links with nothing. A null id
comes after all others. Repeated rows are equal sets. Long texts count whole. An empty table gives
an empty result. Further columns are not read; ``one_of_each`` passes them on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.llm.common import bitmap, blocks, components, give_back, id_or_last, id_or_null, in_bitmap, materialize, partitions, shingle_sets, signed, small_batches, whole_text

WIDTH = 5
PERCENT = 75
HOT = 1 << 19  # tokens whose frequency is known
COUNTED = 1 << 22  # tokens that are counted together
CHUNK = 64  # members of a group that are opened together
PACK = 256  # queries that are compared with them
CENTERS = 3  # documents that each is compared with before groups are formed
SALTS = 16  # parts of a common token's postings
EXTRA = 5  # percent of a set that is posted beyond what linked sets must share one of
FIRST = 1  # percent of it that counts as such in the matrix, where more tokens bring together more sets that do not link
TOKEN_BITS = 48  # of a hash that are posted: two tokens taken for one add candidates, no links
COMMON = 1 << TOKEN_BITS  # marks a posted token as a common one


def _repeated(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that several sets have, sorted, and how many; the list is emptied, so that its tokens are held once."""
    tokens = np.concatenate(sets)
    sets.clear()
    tokens.sort()
    same = np.zeros(len(tokens) + 1, bool)  # as the token before
    same[1:-1] = tokens[1:] == tokens[:-1]
    first, last = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
    return tokens[first], last - first + 1


def _common_tokens(rows: DataFrame, width: int) -> np.ndarray:
    """The commonest tokens, sorted: counted over all documents within blocks of COUNTED tokens, where
    a token that only one set of a block has is left out, and summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], set(), 0

        def several():
            tokens, n = _repeated(held)
            return pa.RecordBatch.from_arrays([pa.array(signed(tokens)), pa.array(n)], names=["token", "n"])

        for batch in batches:
            for _, _, data, offsets in blocks(batch.column("t")):
                for s in shingle_sets(data, offsets, width):
                    signature = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if signature not in seen:
                        seen.add(signature)
                        held.append(s)
                        size += len(s)
                if size > COUNTED:
                    yield several()
                    held, seen, size = [], set(), 0
        if held:
            yield several()
        del held
        give_back()

    counted = rows.select("t").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 4")
    with small_batches(rows.sparkSession):
        top = counted.orderBy(F.desc("n"), "token").limit(HOT).select("token").toArrow()
    return np.sort(top.column("token").to_numpy().view(np.uint64))


def _read(rows: DataFrame, common: np.ndarray, width: int, percent: int) -> DataFrame:
    """A row per document: uid, id, text_key, n (set size), a 128-bit signature of the set, and
    for the first such set of a task the tokens that it posts, ``rare`` of them not common.

    The fewer of what it posts is rare, the smaller a uid: of near copies of one text the text itself, or the one
    that is nearest to it, comes first, and links with most.
    """
    broadcast = rows.sparkSession.sparkContext.broadcast(common)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, seen, hot = TaskContext.get().partitionId() << 34, set(), broadcast.value
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("t")):
                part = batch.slice(first, end - first)
                sets = shingle_sets(data, offsets, width)
                sizes = [len(s) for s in sets]
                every = np.concatenate([np.zeros(0, np.uint64), *sets])
                place = np.searchsorted(hot, every)
                is_hot = hot[np.minimum(place, len(hot) - 1)] == every if len(hot) else np.zeros(len(every), bool)
                begin, posted, rare, highs, lows = 0, [], [], [], []
                for s in sets:
                    signature = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    highs.append(int.from_bytes(signature[:8], "little", signed=True))
                    lows.append(int.from_bytes(signature[8:], "little", signed=True))
                    own = is_hot[begin : begin + len(s)]
                    begin += len(s)
                    if not len(s) or signature in seen:
                        posted.append(None)
                        rare.append(0)
                        continue
                    seen.add(signature)
                    # with an overlap of percent of the set, linked sets share 1 + EXTRA percent of these
                    size = min(len(s), len(s) - -(-percent * len(s) // 100) + 1 + EXTRA * len(s) // 100)
                    tokens = s[~own][:size]
                    rare.append(len(tokens))
                    if len(tokens) < size:
                        tokens = np.concatenate([tokens, s[own][: size - len(tokens)]])
                    tokens = tokens >> np.uint64(64 - TOKEN_BITS)
                    tokens[rare[-1] :] |= np.uint64(COMMON)
                    posted.append(signed(tokens))
                rareness = [15 if p is None else 15 * r // len(p) for r, p in zip(rare, posted)]  # who posts nothing comes last
                uids = np.arange(uid, uid + len(part)) + (np.array(rareness, np.int64) << 58)
                uid += len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids), part.column("id"), part.column("key"), pa.array(sizes, pa.int64()), pa.array(highs, pa.int64()), pa.array(lows, pa.int64()), pa.array(posted, pa.list_(pa.int64())), pa.array(rare, pa.int32())],
                    names=["uid", "id", "text_key", "n", "high", "low", "posted", "rare"],
                )
        give_back()

    return materialize(rows.mapInArrow(read, "uid long, id long, text_key long, n long, high long, low long, posted array<long>, rare int"), "sets")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by token, those of tokens with several, and the first document of each run.
    The postings of a common token are salted, so one that is alone here is passed on: others are elsewhere."""
    last_token, first_uid, lone = None, None, None  # the run that goes on; its only posting, if not yet written
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        tokens, uids, places = (batch.column(c).to_numpy() for c in ("token", "uid", "at"))
        begins = np.ones(n, bool)
        begins[1:] = tokens[1:] != tokens[:-1]
        goes_on = tokens[0] == last_token
        begins[0] = not goes_on
        starts = np.flatnonzero(begins)
        run = np.cumsum(begins) - 1
        firsts = uids[starts]
        first = firsts[np.maximum(run, 0)] if len(starts) else np.full(n, first_uid)
        if goes_on:
            first = np.where(run < 0, first_uid, first)
        salted = batch.column("salt").to_numpy() > 0
        single = begins & np.append(begins[1:], False) & ~salted  # one posting, as far as is known; the batch's last is looked at later
        out = [x[~single] for x in (tokens, uids, places, first)]
        open_lone = None
        if begins[-1] and not salted[-1]:  # the last run has one posting so far
            out = [x[:-1] for x in out]
            open_lone = (tokens[-1], uids[-1], places[-1], uids[-1])
        if goes_on and lone is not None:
            out = [np.append(np.array([v], x.dtype), x) for v, x in zip(lone, out)]
        last_token, first_uid, lone = tokens[-1], first[-1], open_lone
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["token", "uid", "at", "center"])


def _compare(width: int, percent: int):
    def work(key, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """Links of queries with one member of a chunk each."""
        found: list[tuple[int, int]] = []
        if len(members) and len(queries):
            own, asked = (_sets(x["t"], width) for x in (members, queries))
            union = np.unique(np.concatenate(own))
            uids = members["uid"].tolist()
            for uid, q in zip(queries["uid"].tolist(), asked):
                if 100 * _overlap(q, union) < percent * len(q):
                    continue  # no member can reach the threshold
                for member, s in zip(uids, own):
                    if 100 * min(len(s), len(q)) >= percent * max(len(s), len(q)):
                        both = _overlap(q, s)
                        if 100 * both >= percent * (len(q) + len(s) - both):
                            found.append((uid, member))
                            break
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return work


def _sets(texts: pd.Series, width: int) -> list[np.ndarray]:
    expand = zstandard.ZstdDecompressor().decompress
    encoded = [expand(t) for t in texts]
    return shingle_sets(np.frombuffer(b"".join(encoded), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in encoded], dtype=np.int64)]), width)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _texts(rows: DataFrame, sets: DataFrame, uids: DataFrame) -> DataFrame:
    """uid and compressed text of documents; a bitmap of fixed size keeps most others from being shuffled."""
    wanted = materialize(sets.select("uid", "id", "text_key").join(uids.distinct(), "uid"), "wanted")
    hits = bitmap(wanted, F.xxhash64("id", "text_key"))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            part = batch.filter(pa.array(in_bitmap(hits.value, batch.column("h").to_numpy())))
            packed = pa.array([squeeze(t) for t in part.column("t").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), packed], names=["id", "key", "t"])

    # repeated rows go by the columns of the join, so texts travel once
    some = rows.select("id", "key", "t", F.xxhash64("id", "key").alias("h")).mapInArrow(narrow, "id long, key long, t binary").dropDuplicates(["id", "key"])
    named = wanted.groupBy("id", "text_key").agg(F.collect_set("uid").alias("uids"))  # one uid per task at most
    some = some.join(named, (some["id"] == named["id"]) & (some["key"] == named["text_key"]))
    return materialize(some.select(F.explode("uids").alias("uid"), "t"), "texts")


def _links(members: DataFrame, queries: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of queries (g, uid) with members (g, uid) of their groups: one in each chunk of a group
    that the token union does not rule out. Groups are opened in chunks, by packs of queries."""
    chunks = members.groupBy("g").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    packs = queries.groupBy("g").agg(F.ceil(F.count("*") / PACK).cast("int").alias("packs"))
    shape = chunks.join(packs, "g")
    left = members.join(shape, "g").select("g", F.pmod(F.xxhash64("uid"), "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("packs") - 1)).alias("pack"), "uid")
    right = queries.join(shape, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("uid"), "packs").cast("int").alias("pack"), "uid")
    keys = ["g", "chunk", "pack"]
    left, right = left.join(texts, "uid").toDF("uid", *keys, "t"), right.join(texts, "uid").toDF("uid", *keys, "t")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compare(width, percent), "a long, b long")
    return materialize(found, "links")


def _queries(shared: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Documents (g, uid) and the other groups g that the matrix does not rule out for them, from the postings
    (token, uid, at: -1 is no place) of shared tokens and the sets (uid, n, their group g and its size). Of two groups the one
    with fewer sets asks the other."""
    # sizes of members that can link with n, and the overlap that sizes n and m need
    low, high = F.greatest(F.col("lo"), F.ceil(F.col("n") * percent / 100)), F.least(F.col("hi"), F.floor(F.col("n") * 100 / percent))
    need = lambda m: F.ceil((F.col("n") + m) * percent / (100 + percent))
    some = lambda m: 1 + F.floor(F.least(F.col("n"), m) * FIRST / 100)
    labelled = materialize(shared.where("at >= 0").select("token", "uid", "at").join(named, "uid"), "labelled")
    # a group does not ask itself, so tokens of a single group need not be taken out first, which would shuffle more than it saves
    matrix = labelled.groupBy("token", F.col("g").alias("other")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("at").alias("first"), F.max("size").alias("others"))
    # two sets that link share some() of the first size - need() + some() tokens of each
    asks = (F.col("size") < F.col("others")) | ((F.col("size") == F.col("others")) & (F.col("g") < F.col("other")))
    fits = asks & (low <= high) & (F.col("at") < F.col("n") - need(low) + some(high)) & (F.col("first") < high - need(high) + some(high))
    met = labelled.join(matrix, "token").where(fits).groupBy("uid", "other", "n").agg(F.count("*").alias("c"), F.min(low).alias("low"))
    return materialize(met.where(F.col("c") >= some(F.col("low"))).select(F.col("other").alias("g"), "uid"), "queries")


def _classes(documents: DataFrame, text: str, id: str, width: int, percent: int) -> DataFrame:
    """uid, id, text_key, n, component (a uid, null if it links with nothing)."""
    spark = documents.sparkSession
    rows = documents.select(id_or_last(id).alias("id"), F.xxhash64(whole_text(text)).alias("key"), whole_text(text).alias("t"))
    sets = _read(rows, _common_tokens(rows, width), width, percent)

    # equal sets: linked with the first of them
    first = sets.where("n > 0").groupBy("high", "low").agg(F.min("uid").alias("b"), F.count("*").alias("c")).where("c > 1")
    equal = sets.join(first, ["high", "low"]).select(F.col("uid").alias("a"), "b")

    # postings of tokens that several sets share
    posted = sets.where("posted IS NOT NULL").select("uid", "n", "rare", F.posexplode("posted").alias("at", "token"))
    salt = F.when(F.col("at") >= F.col("rare"), 1 + F.pmod(F.xxhash64("uid"), F.lit(SALTS))).otherwise(0)
    # sets that link share 1 + FIRST percent of these at least; the matrix takes no other postings, which have no place
    widest = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 + F.floor(F.col("n") * FIRST / 100)
    place = F.when(F.col("at") < widest, F.col("at")).otherwise(-1)
    posted = posted.select("token", "uid", place.alias("at"), salt.alias("salt")).repartition(partitions(spark), "token", "salt").sortWithinPartitions("token", "uid")
    shared = materialize(posted.mapInArrow(_shared, "token long, uid long, at int, center long"), "shared")
    # from here on the first of equal sets stands for all
    firsts = sets.where("n > 0").select("uid", "n").join(equal.where("a <> b").select(F.col("a").alias("uid")), "uid", "left_anti")
    # of what two linked sets post they share so many, at least, whatever their sizes
    due = 1 + F.floor(F.col("n") * (EXTRA * percent) / 10_000)

    # 1. each document against those that begin most of its runs
    def nearest_of(runs: DataFrame) -> DataFrame:
        counts = runs.where("uid <> center").groupBy("uid", "center").agg(F.count("*").alias("c"))
        best = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("c"), "center"))
        ranked = counts.withColumn("rank", best).where(F.col("rank") <= CENTERS).join(firsts, "uid")
        return materialize(ranked.where(F.col("c") >= due).select(F.col("center").alias("g"), "uid"), "nearest")

    nearest = nearest_of(shared)
    centers = nearest.select("g").distinct().withColumn("uid", F.col("g"))
    texts = _texts(rows, sets, centers.select("uid").unionByName(nearest.select("uid")))
    near = _links(centers, nearest, texts, width, percent)
    # a common token's postings are parts by salt: who links with the first of no part is compared with the first of all parts
    heads = shared.where((F.col("uid") == F.col("center")) & (F.col("token") >= COMMON)).select("token", "center")
    parted = heads.groupBy("token").agg(F.min("center").alias("least"), F.max("center").alias("most")).where("least < most")
    parted = parted.join(centers.select(F.col("g").alias("least")), "least", "left_semi")
    moved = heads.join(parted, "token").where("center <> least").select("token", "center", "least")
    alone = centers.select("uid").unionByName(nearest.select("uid")).distinct().join(near.select(F.col("a").alias("uid")).distinct(), "uid", "left_anti")
    again = nearest_of(shared.join(alone, "uid").join(moved, ["token", "center"]).select("uid", F.col("least").alias("center")))
    near = near.unionByName(_links(again.select("g").distinct().withColumn("uid", F.col("g")), again, texts, width, percent))
    groups = components(near.unionByName(equal))

    # 2. documents as queries to the other groups that they share tokens with
    named = firsts.join(groups, F.col("uid") == F.col("node"), "left").select("uid", "n", F.coalesce("component", "uid").alias("g"))
    sizes = named.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    named = materialize(named.join(sizes, "g", "left").select("uid", "n", "g", F.coalesce("size", F.lit(1)).alias("size")), "named")
    queries = _queries(shared, named, percent)
    members = named.select("uid", "g").join(queries.select("g").distinct(), "g")
    more = _links(members, queries, _texts(rows, sets, members.select("uid").unionByName(queries.select("uid"))), width, percent)
    final = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    return sets.join(final, F.col("uid") == F.col("node"), "left").select("uid", "id", "text_key", "n", "component")


def classes(documents: DataFrame, text: str = "text", id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links)."""
    found = materialize(_classes(documents, text, id, width, percent), "classes")
    least = found.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least"))
    return found.join(least, "component", "left").select(
        id_or_null("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("c")
    ).select(id, "n_shingles", id_or_null("c").alias("component_id"))


def one_of_each(documents: DataFrame, text: str = "text", id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents with all their columns, of each component the one with the smallest id."""
    found = materialize(_classes(documents, text, id, width, percent), "classes")
    best = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("id", "uid")).alias("x"))
    gone = found.join(best, "component").where(F.col("uid") != F.col("x.uid")).select("id", "text_key")
    kept = best.join(found, F.col("x.uid") == F.col("uid")).select("id", "text_key").distinct()
    # rows that share id and text: one stays
    gone = gone.groupBy("id", "text_key").agg(F.lit(0).alias("_")).drop("_")
    twice = gone.join(kept, ["id", "text_key"])
    gone = gone.join(kept, ["id", "text_key"], "left_anti")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), id_or_last(id).alias("id"), F.xxhash64(whole_text(text)).alias("text_key"))
    marks = gone.withColumn("mark", F.lit("gone")).unionByName(twice.withColumn("mark", F.lit("once")))
    marked = rows.join(marks, ["id", "text_key"], "left")
    once = marked.where("mark = 'once'").dropDuplicates(["id", "text_key"])
    return marked.where("mark IS NULL").select("row.*").unionByName(once.select("row.*"))
