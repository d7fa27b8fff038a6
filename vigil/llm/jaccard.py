"""Exact self-join of documents by n-gram Jaccard, by token-group matrices, down to connected components.

A document's set: its distinct k-word shingles (fewer words: all of them as one; none: empty, linked with nothing) as
64-bit hashes. Two documents link when percent * |union| <= 100 * |intersection|.

1. Equal sets become one class, counted from then on as its smallest document: copies cost an aggregate, not pairs.
2. Classes are partitioned into groups of similar ones: one size class and one smallest token hash, on which sets agree
   as often as they are similar. The token-group matrix has a row for each (token, group): the union of the tokens of the
   group's members, with the range of their sizes. Every document is a query against all groups at once: an equi-join of
   its tokens with the matrix, whose count bounds its overlap with the group. Of each set only the rarest tokens are looked
   at, in one order for all: of n tokens, n - ceil(percent * n / 100) + k; sets that link agree on k of these (the smaller set's k), so a group
   of which fewer are hit (or whose sizes do not fit) can hold no link and stays closed. The order puts tokens that many
   documents hold last (counts are summed over all documents; a token missed there costs time, never a link).
3. Qualifying groups are opened: a task gets the whole sets of a group's members and of the queries that opened it, bounds
   these once more by parities (512 bits, more for larger sets, that differ in at most as many bits as the sets differ in
   tokens) and counts exact overlaps through the group's postings. Links found join components at once, so documents
   already joined are not compared again. This takes two rounds: first each group by itself and with the queries that it is
   the likeliest group of (each token counting for one group, so that rows stay as many as tokens), without those that share
   too few tokens with the rest; then a document counts as a member of its likeliest group, all of which it was compared with
   or can't link with, and the matrix bounds all other groups for all queries, members in the query's own component left out.
   Of a qualifying group only those queries and members are opened that may share enough tokens with one another, counted pair by
   pair where few members have a token. A large family of near copies is one group after the first round, whether its members link or not, and
   makes no rows in the second.
4. Links of all groups meet in connected components.

A token's documents are counted and joined as rows, never gathered in one task. Of two groups that one token joins, only
the documents of the smaller one are queries. A group beyond PART_TOKENS is split into blocks, and each pair of blocks (in the second
round one of members and one of queries) is a task of its own, so a large family of near copies does not gather in one task, and no pair is lost. Links and components stay tables
in the shared folder; the driver sees counts only. Tokens are 64-bit hashes: different shingles may share one by chance.
A null id is left out of joins but keeps its row (component null); rows with equal ids are one document if texts agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import small_batches, written
from .words import SPACED_LOWER, Words, mix, windows, words_of

BITS = 512
#: Tokens of a group that make a block; a task compares two blocks at most, in memory in proportion.
PART_TOKENS = 64_000
#: Tokens of a group's union that a query has to hit among its rarest ones, one more for each SHARE tokens of its set; size classes to a
#: doubling of the size.
HITS, SHARE, SIZES = 3, 100, 4
#: A token counts as common from COMMON documents among COUNTED words on; at most HOT of the most common are told to all tasks.
COMMON, COUNTED, HOT = 3, 4_000_000, 150_000
BROADCAST_ROWS = 400_000
#: A token that so many members of a group have at most is counted pair by pair.
LIGHT = 8


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """The sorted set of each document of a slice."""
    h, whole = windows(w, k)
    out = []
    for i in range(w.n):
        a, b = int(w.begin[i]), int(w.begin[i + 1])
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([np.bitwise_xor.reduce(mix(w.hashes[a:b] + np.arange(b - a, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))], np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parity_bits(n: int, percent: int) -> int:
    """Bits of the parity of a set: a power of two from BITS on, more than thrice the difference that a link allows."""
    most, bits = 2 * n * (100 - percent) // (100 + percent), BITS
    while 10 * bits < 34 * most:
        bits *= 2
    return bits


def parity(sets: list[np.ndarray], percent: int) -> list[bytes]:
    """Of each set parity_bits bits: whether an odd number of its tokens falls on each."""
    out = [b""] * len(sets)
    bits = np.array([parity_bits(len(s), percent) for s in sets], np.int64)
    for size in np.unique(bits):
        of = np.flatnonzero(bits == size)
        doc = np.repeat(np.arange(len(of)), [len(sets[i]) for i in of])
        bit = (mix(np.concatenate([sets[i] for i in of])) & np.uint64(size - 1)).astype(np.int64)
        odd = np.packbits((np.bincount(doc * size + bit, minlength=len(of) * size) & 1).astype(np.uint8).reshape(len(of), size), axis=1, bitorder="little")
        for i, x in zip(of, odd, strict=True):
            out[i] = x.tobytes()
    return out


def folded(odd: list[bytes], size: int) -> np.ndarray:
    """Parities of `size` bytes or more as rows of that size: bits that agree in their low positions are summed up."""
    out = np.empty((len(odd), size // 8), np.uint64)
    for i, x in enumerate(odd):
        row = np.frombuffer(x, np.uint64).reshape(-1, size // 8)
        out[i] = row[0] if len(row) == 1 else np.bitwise_xor.reduce(row, axis=0)
    return out


def group_of(s: np.ndarray) -> int:
    """The group of a set: a 32-bit hash of its smallest token and size class. Groups that share a number are one group."""
    return int(mix(s[:1] + np.uint64(int(SIZES * np.log2(len(s))) << 48)).view(np.int64)[0] >> 32)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two sums over the tokens, each mixed another way: 128 bits that stand for the set."""
    a = np.add.reduce(mix(s ^ np.uint64(0x2545F4914F6CDD1D)))
    b = np.add.reduce(mix(s + np.uint64(0x9E3779B97F4A7C15)))
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys out of batches sorted by them; holds one group and one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            new[0] = any(last.column(k)[last.num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in keys)
        cut = np.flatnonzero(new)
        at = 0
        for c in cut:
            if c > at:
                held.append(batch.slice(at, c - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], int(c)
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def may_link(n: np.ndarray, odd: np.ndarray, q: int, percent: int) -> np.ndarray:
    """Whether sizes and parities (rows of 64-bit words) allow a link of document q with each document."""
    both = n + n[q]
    ok = (n * percent <= 100 * n[q]) & (n[q] * percent <= 100 * n)
    at = np.flatnonzero(ok)
    differ = np.bitwise_count(odd[at] ^ odd[q]).sum(axis=1, dtype=np.int64)
    ok[at] = differ * (100 + percent) <= both[at] * (100 - percent)
    return ok


def linked(sets: list[np.ndarray], block: np.ndarray, cross: bool, percent: int, known: np.ndarray | None = None, asks: np.ndarray | None = None) -> np.ndarray:
    """The component (its first document) of each document of an opened group by their exact links.

    cross: documents of different blocks only; known: components that hold already; asks: the documents to compare with those that don't ask.
    """
    docs = len(sets)
    root = np.arange(docs)
    if known is not None:
        _, one, of = np.unique(known, return_index=True, return_inverse=True)
        root = one[of.ravel()]
    n = np.array([len(x) for x in sets], np.int64)
    if (root == root[0]).all() or (cross and (block == block[0]).all()):
        return root
    if docs == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if both * (100 + percent) >= percent * (n[0] + n[1]):
            root[1] = root[0]
        return root
    bits = parity_bits(int(n.min()), percent) // 8  # the larger sets' parities, folded to the length of the smallest's
    odd = folded(parity(sets, percent), bits)
    flat = np.concatenate(sets)
    by = np.argsort(flat, kind="stable")  # the postings: tokens in order, documents ascending within each
    post = np.repeat(np.arange(docs, dtype=np.int32), n)[by]
    new = np.ones(len(flat), bool)
    new[1:] = flat[by[1:]] != flat[by[:-1]]
    of_post = np.append(np.flatnonzero(new), len(flat))
    which = np.empty(len(flat), np.int32)
    which[by] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    start = np.concatenate([[0], np.cumsum(n)])
    for q in range(docs) if asks is None else np.flatnonzero(asks):
        may = root != root[q]
        if cross:
            may &= block != block[q]
        if asks is not None:
            may &= ~asks
        if not may.any() or not (may := may & may_link(n, odd, q, percent)).any():
            continue
        t = which[start[q] : start[q + 1]]
        size = of_post[t + 1] - of_post[t]
        hits = post[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(of_post[t], size)]
        overlap = np.bincount(hits[may[hits]], minlength=docs)
        for m in np.flatnonzero(may & (overlap * (100 + percent) >= percent * (n + n[q]))):
            if root[m] != root[q]:
                a, b = min(root[m], root[q]), max(root[m], root[q])
                root[root == b] = a
    return root


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, root): the smallest id that each id of the links (a, b) reaches.

    Rounds of taking the smallest label around and then the label's own label; every round is written to the shared folder.
    """
    sides = written(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-sides")
    labels = written(sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "id"), f"{name}-labels")
    while True:
        near = sides.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = written(lower.join(jump, "root").select("id", "was", F.least("root", "next").alias("root")), f"{name}-labels")
        labels = moved.select("id", "root")
        if not moved.where("was <> root").limit(1).count():
            return labels


def _blocks(counted: DataFrame, rows: str, most: int, on: str) -> DataFrame:
    """counted with i, j (the pair of blocks) and block; one row per pair that the row's block is in; one pair (0, 0) up to `most` rows."""
    parts = F.ceil(F.col(rows) / F.lit(most)).cast("int")
    return (
        counted.withColumn("block", F.pmod(F.xxhash64(on), parts).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o"))
        .drop("_o")
    )


def _facing_blocks(counted: DataFrame, most: int, on: str) -> DataFrame:
    """counted with i, j: in which block of members and which of queries a row is compared. A member is sent once for each block of
    queries of its group and a query once for each block of members; c and ca are the group's tokens of members and of queries."""
    of_members, of_queries = (F.ceil(F.col(c) / F.lit(most)).cast("int") for c in ("c", "ca"))
    block = F.pmod(F.xxhash64(on), F.when(F.col("asks"), of_queries).otherwise(of_members)).cast("int")
    rows = counted.withColumn("block", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), of_members).otherwise(of_queries) - 1)))
    return rows.withColumn("i", F.when(F.col("asks"), F.col("_o")).otherwise(F.col("block"))).withColumn("j", F.when(F.col("asks"), F.col("block")).otherwise(F.col("_o"))).drop("_o")


def need(n: Column, percent: int) -> Column:
    """Tokens that a set of n has to share with any set that it links with."""
    return F.ceil(F.lit(percent) * n / F.lit(100))


def size_class(n: Column, percent: int) -> Column:
    """Sets that link are of one class or of neighbouring ones."""
    return F.floor(F.log(n) / F.lit(np.log(100 / percent) * 1.0001 if percent < 100 else 1.0))


def of_like_size(rows: DataFrame) -> DataFrame:
    """(id, token) of rows (id, token, s) whose token another document has that is of a like size: of the same class s, modulo 64, or the next.

    A window over each token's rows, which are dealt out once, tells which classes have it; where more documents than classes
    do, some class has several.
    """
    bit, around = F.expr("shiftleft(1L, s)"), F.expr("shiftleft(1L, (s + 1) % 64) | shiftleft(1L, (s + 63) % 64)")
    same = Window.partitionBy("token")
    marked = rows.withColumns({"_c": F.count(F.lit(1)).over(same), "_m": F.bit_or(bit).over(same)})
    return marked.where((F.col("_c") > F.bit_count("_m")) | (F.col("_m").bitwiseAND(around) != 0)).select("id", "token")


def hits_of(n: Column) -> Column:
    return (F.lit(HITS) + F.floor(n / F.lit(SHARE))).cast("long")


def wanted(n: Column, percent: int) -> Column:
    """Tokens among its rarest ones that a set of n shares with any set that it links with (of at least `need` tokens)."""
    return F.least(hits_of(need(n, percent)), need(need(n, percent), percent))


def likeliest(live: DataFrame) -> DataFrame:
    """(id, g): for each document the other group it hits most, when each token counts for the one group that most of its
    documents are in; documents that hit none often enough have no row."""
    top = live.groupBy("token", "g").agg(F.count(F.lit(1)).alias("_c")).groupBy("token").agg(F.max(F.struct("_c", "g"))["g"].alias("_top"))
    hit = live.join(top, "token").where("_top <> g").groupBy("id", F.col("_top").alias("g")).agg(F.count(F.lit(1)).alias("hits"), F.max("least").alias("least"))
    return hit.where("hits >= least").groupBy("id").agg(F.max(F.struct("hits", "g"))["g"].alias("g"))


def inside(live: DataFrame, first: DataFrame) -> DataFrame:
    """(id, g, n): the documents of each group and of those whose likeliest group it is, as far as they may link with one another.

    A token that only one of them has can be no part of a link inside; who has too few others is left out.
    """
    columns = ("g", "token", "id", "n", "least")
    both = live.select(*columns).unionByName(live.drop("g").join(first, "id").select(*columns))
    shared = both.groupBy("g", "token").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a <> _b").select("g", "token")
    hits = both.join(shared, ["g", "token"]).groupBy("g", "id").agg(F.count(F.lit(1)).alias("hits"), F.max("n").alias("n"), F.max("least").alias("least"))
    return hits.where("hits >= least").select("id", "g", "n")


def regrouped(rows: DataFrame, first: DataFrame) -> DataFrame:
    """rows (id, g, ...) with g replaced by the likeliest group, where there is one."""
    return rows.join(first.withColumnRenamed("g", "_g"), "id", "left").withColumn("g", F.coalesce("_g", "g")).drop("_g")


def bounds(live: DataFrame, percent: int) -> DataFrame:
    """(id, g, hits, k): for each document the larger groups whose unions it hits, and the hits needed.

    live: token, id, g, n, comp, size (documents of the group); of groups of one size the lower number counts as larger.
    Members of a group count by component, and none of the document's own; tokens of one component or of one group only are
    left out before anything is joined.
    """
    ends = [f(c).alias(f"_{f.__name__}_{c}") for c in ("comp", "g") for f in (F.min, F.max)]
    crossing = live.groupBy("token").agg(*ends).where("_min_comp <> _max_comp and _min_g <> _max_g").select("token")
    rows = live.join(crossing, "token", "left_semi")
    matrix = rows.groupBy("token", F.col("g").alias("_g"), F.col("comp").alias("_comp")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("size").alias("_size"))
    larger = (F.col("_size") > F.col("size")) | ((F.col("_size") == F.col("size")) & (F.col("_g") < F.col("g")))
    fits = (F.col("n") * percent <= F.col("hi") * 100) & (F.col("lo") * percent <= F.col("n") * 100)
    hit = rows.join(matrix, "token").where(larger & (F.col("_comp") != F.col("comp")) & fits)
    once = hit.groupBy("id", F.col("_g").alias("g"), "token").agg(F.min(need(F.least("lo", "n"), percent)).alias("_k"), F.max("n").alias("n"))
    return once.groupBy("id", "g").agg(F.count(F.lit(1)).alias("hits"), F.least(hits_of(need(F.max("n"), percent)), F.min("_k")).alias("k"))


def facing(live: DataFrame, asked: DataFrame, percent: int, light: int = LIGHT) -> DataFrame:
    """(id, g, n, asks): the queries (id, g) of each group and its members, as far as a query and a member may link.

    live: token, id, g, n, least, comp. A link shows in `least` tokens of either side at least, between documents that fit in
    size and are of different components. Members are held against all tokens of their group's queries first. Of the tokens
    left, those that `light` members of the group at most have are counted for each query and member that share them; of the
    others, which a family of near copies shares, each side counts its own as if all were shared. Pairs are thus in
    proportion to rows.
    """
    queries = asked.join(live.drop("g"), "id").select("g", "token", F.col("id").alias("q"), F.col("n").alias("q_n"), F.col("least").alias("q_least"), F.col("comp").alias("q_comp"))
    told = queries.groupBy("g", "token").agg(F.min("q_comp").alias("_a"), F.max("q_comp").alias("_b"), F.min("q_n").alias("_lo"), F.max("q_n").alias("_hi"))
    fits = (F.col("n") * percent <= F.col("_hi") * 100) & (F.col("_lo") * percent <= F.col("n") * 100)
    hit = live.join(told, ["g", "token"]).where(fits & ((F.col("_a") != F.col("comp")) | (F.col("_b") != F.col("comp")))).drop("_a", "_b", "_lo", "_hi")
    enough = hit.groupBy("id", "g").agg(F.count(F.lit(1)).alias("_c"), F.max("least").alias("_k")).where("_c >= _k").select("id", "g")
    members = written(hit.join(enough, ["id", "g"], "left_semi"), "members")
    shares = written(members.groupBy("g", "token").agg((F.count(F.lit(1)) > light).alias("heavy")), "shares")
    of_heavy = lambda key: F.count(F.when(F.col("heavy"), 1)).alias(f"{key}_heavy")
    by_member = members.join(shares, ["g", "token"]).groupBy("g", "id").agg(of_heavy("m"), F.max("n").alias("n"), F.max("least").alias("least"), F.max("comp").alias("comp"))
    by_query = queries.join(shares, ["g", "token"]).groupBy("g", "q").agg(of_heavy("q"), F.max("q_n").alias("q_n"), F.max("q_least").alias("q_least"), F.max("q_comp").alias("q_comp"))
    by_member, by_query = written(by_member, "by-member"), written(by_query, "by-query")
    few = shares.where("not heavy").select("g", "token")
    both = members.join(few, ["g", "token"]).select("g", "token", "id").join(queries.select("g", "token", "q"), ["g", "token"])
    pairs = both.groupBy("g", "q", "id").agg(F.count(F.lit(1)).alias("_c")).join(by_query, ["g", "q"]).join(by_member, ["g", "id"])
    fit = (F.col("q_n") * percent <= F.col("n") * 100) & (F.col("n") * percent <= F.col("q_n") * 100) & (F.col("q_comp") != F.col("comp"))
    pairs = written(pairs.where(fit & (F.col("_c") + F.least("q_heavy", "m_heavy") >= F.greatest("q_least", "least"))).select("g", "q", "id"), "pairs")
    kept = pairs.select("g", "id").union(by_member.where("m_heavy >= least").select("g", "id")).distinct().join(by_member.select("g", "id", "n"), ["g", "id"])
    asking = pairs.select("g", "q").union(by_query.where("q_heavy >= q_least").select("g", "q")).distinct().join(by_query.select("g", "q", "q_n"), ["g", "q"])
    return kept.select("id", "g", "n", F.lit(False).alias("asks")).union(asking.select("q", "g", "q_n", F.lit(True)))


def link_documents(docs: DataFrame, k: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text", grouping: Callable[[np.ndarray], int] = group_of) -> DataFrame:
    """key, n_shingles and component_id (the smallest id reachable by links, itself included), one row per row of docs.

    grouping: the group of a set; any partition gives the same links, one of similar sets opens fewer groups.
    """
    base = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    small_batches(spark)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
            tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
            tokens.sort()
            at = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)])
            n = np.diff(at, append=len(tokens))
            return pa.RecordBatch.from_arrays([pa.array(tokens[at[n >= COMMON]].view(np.int64)), pa.array(n[n >= COMMON])], ["token", "n"])

        held, size = [], 0
        for batch in batches:
            for w in words_of(batch.column("text"), SPACED_LOWER):
                held += shingle_sets(w, k)
                size += len(w.hashes)
                if size >= COUNTED:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    counted = base.select("text").mapInArrow(common, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    hot_rows = counted.where(F.col("n") >= 4 * COMMON).orderBy(F.desc("n"), "token").limit(HOT).collect()  # HOT numbers
    hot = np.array([r[0] for r in hot_rows], np.int64).view(np.uint64)
    level = np.array([r[1] for r in hot_rows], np.int64)
    order = np.argsort(hot)
    told = spark.sparkContext.broadcast((hot[order], level[order]))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, level = told.value
        likely = np.zeros(1 << 20, bool)
        likely[(hot & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            for w in words_of(batch.column("text"), SPACED_LOWER):
                sets = shingle_sets(w, k)
                first, group = [], []
                for s in sets:
                    least = -(-percent * len(s) // 100)
                    p = len(s) - least + min(HITS + len(s) // SHARE, least)
                    group.append(grouping(s) if len(s) else 0)
                    at = np.flatnonzero(likely[(s & np.uint64((1 << 20) - 1)).astype(np.int64)]) if len(hot) else np.zeros(0, np.int64)
                    if len(at):
                        i = np.minimum(np.searchsorted(hot, s[at]), len(hot) - 1)
                        count = np.zeros(len(s), np.int64)
                        count[at] = np.where(hot[i] == s[at], level[i], 0)
                        s = s[np.argsort(count, kind="stable")]
                    first.append(s[:p].view(np.int64))
                prints = [fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(w.first, w.n), pa.array([len(s) for s in sets], pa.int32()), pa.array([x for x, _ in prints], pa.int64()),
                        pa.array([x for _, x in prints], pa.int64()), pa.array(group, pa.int32()), pa.array(first, pa.list_(pa.int64())),
                    ],
                    ["id", "n", "f1", "f2", "g", "first"],
                )

    sets = written(base.mapInArrow(sets_of, "id long, n int, f1 long, f2 long, g int, first array<long>"), "sets")
    classes = written(sets.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.min("g").alias("g")), "classes")

    members = classes.select("id", "g", "n", F.lit(False).alias("asks"))

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column("text"), SPACED_LOWER):
                sets = shingle_sets(w, k)
                cols = [batch.column(c).slice(w.first, w.n) for c in ("id", "g", "c", "ca", "asks", "known")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "g", "c", "ca", "asks", "known", "tokens"])

    def verify(again: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out_a, out_b = [], []
            for t in runs(batches, ["g", "i", "j"]):
                tokens = t.column("tokens").combine_chunks()
                tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
                ids = t.column("id").to_numpy()
                order = np.argsort(ids, kind="stable")
                ids, block, known = ids[order], t.column("block").to_numpy()[order], t.column("known").to_numpy()[order]
                asks = t.column("asks").to_numpy(zero_copy_only=False)[order].astype(bool)
                sets = [np.frombuffer(tokens[int(i)].as_buffer(), np.uint64) for i in order]
                cross = not again and t.column("i")[0].as_py() != t.column("j")[0].as_py()
                root = linked(sets, block, cross, percent, known if again else None, asks if again else None)
                join = np.flatnonzero(ids != ids[root])
                out_a += ids[root[join]].tolist()
                out_b += ids[join].tolist()
                if len(out_a) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
                    out_a, out_b = [], []
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

        return run

    def opened_links(docs_in: DataFrame, known: DataFrame | None) -> DataFrame:
        """(a, b): what joins the documents of the groups (id, g, n, asks); known: (id, root) of the round before."""
        tokens = lambda asks: F.sum(F.when(F.col("asks") == asks, F.col("n")))
        groups = docs_in.groupBy("g").agg(tokens(False).alias("c"), tokens(True).alias("ca"), F.count(F.lit(1)).alias("_d"))
        several = groups.where("_d > 1" if known is None else "c > 0 and ca > 0").drop("_d")
        sized = docs_in.join(several, "g")
        sized = sized.withColumn("known", F.col("id")) if known is None else sized.join(known.distinct(), "id", "left").withColumn("known", F.coalesce("root", "id"))
        sized = written(sized.select("id", "g", "c", "ca", "asks", "known"), "sized")
        small = sized.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        texts = base.join(F.broadcast(sized) if small else sized, "id").select("id", "text", "g", "c", "ca", "asks", "known")
        full = texts.mapInArrow(whole_sets, "id long, g int, c long, ca long, asks boolean, known long, tokens binary")
        full = _blocks(full, "c", PART_TOKENS, "id") if known is None else _facing_blocks(full, PART_TOKENS, "id")
        in_order = full.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
        return written(in_order.mapInArrow(verify(known is not None), "a long, b long"), "links")

    # the rarest tokens of all classes, those of several documents of like sizes; only ids and tokens are dealt out
    of_class = sets.select("id", "f1", "f2", "n", "first").join(classes.select("id", "f1", "f2"), ["id", "f1", "f2"], "left_semi")
    rows = of_class.select("id", (size_class(F.col("n"), percent) % 64).cast("int").alias("s"), F.explode("first").alias("token"))
    sized = classes.select("id", "g", "n", wanted(F.col("n"), percent).alias("least"))
    live = written(of_like_size(rows).join(sized, "id"), "live")
    # first round: groups by themselves, and for each query its likeliest group
    first = written(likeliest(live), "first")
    links = opened_links(inside(live, first).withColumn("asks", F.lit(False)), None)
    roots = components(links, "linked").where("id <> root")
    # second round: all other groups, now by likeliest group, that hold a member outside of the query's component
    rooted = members.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    moved = written(regrouped(members, first), "moved")
    of_doc = moved.select("id", "g").join(moved.groupBy("g").agg(F.count(F.lit(1)).alias("size")), "g").join(rooted.withColumnRenamed("root", "comp"), "id")
    grouped = written(live.drop("g").join(of_doc, "id"), "grouped")
    rest = written(bounds(grouped, percent).where("hits >= k").select("id", "g"), "rest")
    if rest.limit(1).count():
        more = opened_links(facing(grouped, rest, percent), rooted)
        roots = components(links.unionByName(more), "joined").where("id <> root")
    of_class = classes.select("f1", "f2", "n", F.col("id").alias("class")).join(roots.withColumnRenamed("id", "class"), "class", "left")
    of_class = of_class.select("f1", "f2", "n", F.coalesce("root", "class").alias("component_id"))
    out = sets.select("id", "n", "f1", "f2").join(of_class, ["f1", "f2", "n"], "left")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
