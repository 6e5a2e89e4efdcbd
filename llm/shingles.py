"""Near-duplicate documents by the Jaccard similarity of their word shingles, with adaptive multi-match prefixes.

Every document orders its shingles by one order for all documents. Two similar documents share at least ``m`` shingles
within prefixes lengthened for ``m`` matches, and at least the smaller ``m`` of both if each chooses its own. A
document chooses the ``m`` whose estimated cost is least: the entries its prefix meets, plus the candidates left to
verify, which become fewer with every further match that is required.

The smaller document of a pair needs a shorter prefix, because it must share more of itself than the larger one does. Only
lists that hold such an inner entry are met, which spares the shingles that all texts of one template have.

What is asked for are groups, so pairs within a group that is already linked are not met: each prefix shingle first
links its documents to one of them, and only documents of different groups meet afterwards.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial, reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from llm.bloom import through_twice_seen
from llm.common import without
from placemap.sources.storage import stored

#: Matches a document may ask for.
MATCHES = (1, 2, 3, 4, 6, 8)
#: Least number of repeated shingles a document's head holds; heads tell most dissimilar pairs apart.
HEAD = 64
#: Cost of verifying a candidate, in entries of a list met.
VERIFY = 20
#: Entries of a list that one task meets; longer lists are split.
LONG_LIST = 2_048
_MIX = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F)]


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``size`` (up to 8) words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out += h[i : i + n] * _MIX[i]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def needed(n, percent: int):
    """Least overlap with any document that is similar to one of ``n`` shingles."""
    return -(-percent * n // 100)


def _first_matches(n):
    return np.maximum(1, n // 10)


def _prefixes(size: int, percent: int):
    """What the first filter holds: the prefix of each document for a tenth of its shingles as matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text in batch.column(2):
                own = shingles(text.as_py(), size)
                found.append(own[: len(own) - needed(len(own), percent) + int(_first_matches(len(own)))])
            yield np.concatenate(found)

    return run


_SETS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("tokens", pa.binary())])


def _sets(size: int, percent: int):
    """Every document's number of shingles, and its set unless too few of its prefix are seen elsewhere."""

    def run(seen, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t.as_py(), size) for t in part.column(2)]
                heads = [s[: len(s) - needed(len(s), percent) + int(_first_matches(len(s)))] for s in sets]
                hits = seen.holds(np.concatenate(heads)) if heads else np.zeros(0, bool)
                ends = np.cumsum([0, *map(len, heads)])
                rows = []
                for s, a, b in zip(sets, ends, ends[1:]):
                    n = len(s)
                    # a similar document has at least ``needed`` shingles and asks for as many matches
                    if n and hits[a:b].sum() >= _first_matches(needed(n, percent)):
                        packed = s.tobytes()
                        rows.append((n, hashlib.blake2b(packed, digest_size=16).digest(), packed))
                    else:
                        rows.append((n, None, None))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows), _SETS.types[2:])]], schema=_SETS)

    return lambda seen, _: partial(run, seen)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        sets = [np.frombuffer(t.as_py(), np.uint64) for t in batch.column(1)]
        yield np.concatenate(sets) if sets else np.zeros(0, np.uint64)


PROFILES = "node long, n long, shared long, most long, head array<long>, last long"
_PROFILES = pa.schema([*[(c, pa.int64()) for c in ("node", "n", "shared", "most")], ("head", pa.list_(pa.int64())), ("last", pa.int64())])


def _profiles(percent: int):
    """The first shingles of each set in the order of all sets: those seen once (left out), then rare ones first.

    A shingle is its place in that order, count and hash. ``most`` of the head are the longest prefix; the set has no
    shingle up to ``last`` that is not in the head or seen once.
    """

    def run(seen, counts, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(packed.as_py(), np.uint64)
                n, often = len(own), own[seen.holds(own)]
                if len(often) >= needed(n, percent):
                    rank = np.minimum(counts.of(often), 0x7FFE).astype(np.int64) << 48 | (often >> np.uint64(16)).astype(np.int64)
                    rank.sort()
                    most = max(0, n - needed(n, percent) + MATCHES[-1] - (n - len(often)))
                    head = rank[: max(HEAD, most)]
                    rows.append((node, n, len(often), most, head.tolist(), int(head[-1]) if len(head) < len(often) else 2**63 - 1))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PROFILES.types)], schema=_PROFILES)

    return lambda seen, counts: partial(run, seen, counts)


def _overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b):
        both = np.concatenate([np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)])
        both.sort(kind="stable")
        out.append(int((both[1:] == both[:-1]).sum()))
    return pa.array(out, pa.int64())


def _least_as_smaller(n, percent: int):
    """Least overlap of a set of ``n`` shingles with a similar one that is not smaller."""
    return F.ceil(2 * percent * n / (100 + percent))


def _adaptive(profiles: DataFrame, percent: int) -> DataFrame:
    """node, n, shared, matches, token, inner: each document with the number of matches it asks for and the prefix for it.

    ``inner`` marks the shorter prefix that is enough to meet documents that are not smaller. A document that has too little in common
    with others to be the smaller of a pair has none. What texts of one template all have is seldom inner, as their own words are rarer.
    """
    prefix = F.slice("head", F.lit(1), F.col("most").cast("int"))
    least, smaller = F.ceil(F.col("n") * percent / 100), _least_as_smaller(F.col("n"), percent)
    lists = profiles.select("node", "n", "shared", F.posexplode(prefix).alias("rank", "token")).withColumn("rank", F.col("rank") + F.col("n") - F.col("shared"))

    def inner(m):
        return (F.col("shared") >= smaller) & (F.col("rank") < F.col("n") - smaller + m)

    sizes = lists.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.count_if(inner(1)).alias("inner_df")).filter("df > 1")
    met = lists.join(sizes, "token")
    base = F.col("n") - least
    entries = [F.sum(F.when(inner(m), F.col("df")).otherwise(0) + F.when(F.col("rank") < base + m, F.col("inner_df")).otherwise(0)) for m in MATCHES]
    cost = F.array_min(F.array(*[
        # all lists together hold each candidate as often as it matches, m times at least; what a similar document surely
        # has in common is ``least`` shingles, so no more matches can be asked for
        F.when(least >= m, F.struct((e + F.floor(e * VERIFY / m)).alias("cost"), F.lit(m).alias("matches"))) for m, e in zip(MATCHES, entries)
    ])).getField("matches")
    chosen = met.groupBy("node", "n", "shared").agg(cost.alias("matches"), F.collect_list(F.struct("rank", "token")).alias("all"))
    rows = chosen.select("node", "n", "shared", "matches", F.explode("all").alias("e")).select("node", "n", "shared", "matches", "e.*")
    return rows.filter(F.col("rank") < base + F.col("matches")).select("node", "n", "shared", "matches", "token", inner(F.col("matches")).alias("inner"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("__a"), F.col("n").alias("__na"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("__b"), F.col("n").alias("__nb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("__o", F.arrow_udf("long")(_overlap)("__a", "__b"))
    return both.filter((100 + percent) * F.col("__o") >= percent * (F.col("__na") + F.col("__nb"))).select("a", "b")


def _may_link(a: str, b: str, percent: int):
    return (100 + percent) * F.least(f"{a}shared", f"{b}shared") >= percent * (F.col(f"{a}n") + F.col(f"{b}n"))


def _star_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs of each document with the one of its list that has most in common with others."""
    rank = F.struct((F.lit(1.0) - F.col("shared") / F.col("n")).alias("own"), F.xxhash64("node").alias("x"), "node", "n", "shared", "matches")
    heads = postings.groupBy("token").agg(F.min(rank).alias("h")).select("token", *[F.col(f"h.{c}").alias(f"h_{c}") for c in ("node", "n", "shared", "matches")])
    met = postings.join(heads, "token").filter(F.col("node") != F.col("h_node"))
    met = met.filter(_may_link("", "h_", percent))
    pairs = met.groupBy(F.col("h_node").alias("a"), F.col("node").alias("b"), F.least("matches", "h_matches").alias("least")).agg(F.count(F.lit(1)).alias("k"))
    return pairs.filter(F.col("k") >= F.col("least")).select("a", "b")


def _cross_pairs(postings: DataFrame, profiles: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups with enough matches, each once, at the first shingle of their prefixes.

    The smaller of a pair has that shingle in its inner prefix, so a list meets its inner entries with larger documents only, and not those
    of its largest group with each other. Long lists are split by bands of set size and dealt to several tasks. What
    one head has up to the other's end and the other lacks cannot be in both sets, which bounds their overlap.
    """
    rooted = postings.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"), F.count_if("inner").alias("inner"))
    top = counts.groupBy("token").agg(F.max(F.struct("k", "root")).alias("t"), F.sum("k").alias("all"), F.sum("inner").alias("inners"))
    mixed = top.filter((F.col("t.k") < F.col("all")) & (F.col("inners") > 0)).select("token", F.col("t.root").alias("top"), "all")
    rows = rooted.join(mixed, "token").join(profiles.select("node", "head", "last"), "node")
    once = F.col("n") - F.col("shared")  # these come before the head

    def prefix(least):
        return F.slice("head", F.lit(1), F.greatest(F.col("n") - least + F.col("matches") - once, F.lit(0)).cast("int"))

    # equal sizes are ordered by node; a similar larger document is in the same band or the next (or, by rounding, one more)
    band = F.when(F.col("all") > LONG_LIST, F.floor(F.log(F.col("n")) / math.log(100 / min(percent, 99)))).otherwise(0).cast("int")
    bands = F.when(F.col("all") > LONG_LIST, F.array(band, band + 1, band + 2)).otherwise(F.array(F.lit(0)))
    deals = F.ceil(F.col("all") / LONG_LIST).cast("int")
    major = F.col("root") == F.col("top")
    names = ("node", "n", "shared", "matches", "root", "head", "last", "prefix")
    small = rows.filter("inner").withColumn("prefix", prefix(_least_as_smaller(F.col("n"), percent)))
    small = small.withColumn("major", F.explode(F.when(major, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    small = small.withColumn("band", F.explode(bands)).withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1)))
    small = small.select("token", "major", "band", "deal", *[F.col(c).alias(f"l_{c}") for c in names])
    large = rows.withColumn("prefix", prefix(F.ceil(F.col("n") * percent / 100)))
    large = large.select("token", major.alias("major"), band.alias("band"), F.pmod(F.xxhash64("node"), deals).cast("int").alias("deal"), *[F.col(c).alias(f"r_{c}") for c in names])

    def overlap(a: str, b: str):
        """At most so many shingles of a are in b."""
        lacking = F.filter(F.array_except(f"{a}head", f"{b}head"), lambda t: t <= F.col(f"{b}last"))
        return F.col(f"{a}shared") - F.size(lacking)

    both = F.array_intersect("l_prefix", "r_prefix")
    first = (F.array_min(both) == small["token"]) & (F.size(both) >= F.least("l_matches", "r_matches"))
    close = (100 + percent) * F.least(overlap("l_", "r_"), overlap("r_", "l_")) >= percent * (F.col("l_n") + F.col("r_n"))
    larger = (F.col("l_n") < F.col("r_n")) | ((F.col("l_n") == F.col("r_n")) & (F.col("l_node") < F.col("r_node")))
    plain = larger & (F.col("l_root") != F.col("r_root")) & _may_link("l_", "r_", percent)
    keys = [small[c] == large[c] for c in ("token", "major", "band", "deal")]
    met = small.join(large, reduce(and_, keys) & F.when(plain, first & close).otherwise(False))
    return met.select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over links (a, b), for every node that has a link.

    Each round takes the smallest root of all neighbours and then the root of the root, so rounds grow with the
    logarithm of a chain's length. Labels of a round are a written table.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("before"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("over"))
        after = lower.join(jump, "root", "left").select("node", F.least("root", F.coalesce("over", "root")).alias("root"), "before")
        after = stored(after, "labels")
        if after.filter("root <> before").limit(1).count() == 0:
            return after.select("node", "root")
        labels = after.select("node", "root")


def _grouped(rows: DataFrame, words: int, percent: int, max_filter_bytes: int) -> DataFrame:
    """doc_id, row, n_shingles and best (doc_id and row of the first of its group) of each of ``rows`` (doc_id, row, text)."""
    size = rows.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    sets = stored(through_twice_seen(
        rows.select("doc_id", "row", "text"), _prefixes(words, percent), _sets(words, percent), from_arrow_schema(_SETS),
        expected=size // 24 + 1, max_bytes=max_filter_bytes,
    ), "shingle-sets")
    found = sets.filter("sig IS NOT NULL")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = found.groupBy("sig").agg(F.min(first).alias("best"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "shingle-classes")
    total = classes.select(F.sum("n").alias("n")).first()["n"] or 0
    profiles = stored(through_twice_seen(
        classes.select("node", "tokens"), _tokens, _profiles(percent), from_arrow_schema(_PROFILES), expected=total + 1, max_bytes=max_filter_bytes, counted=True
    ), "profiles")
    postings = stored(_adaptive(profiles, percent), "postings")
    links = stored(_verified(_star_pairs(postings, percent), classes, percent), "links")
    labels = components(links)
    more = stored(_verified(_cross_pairs(postings, profiles, labels, percent), classes, percent), "links")
    labels = components(links.union(more))

    roots = classes.select("sig", "best", "node").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = roots.groupBy("root").agg(F.min("best").alias("best"))
    by_class = roots.select("sig", "root").join(smallest, "root").select("sig", "best")
    alone = sets.filter("sig IS NULL").select("doc_id", "row", "n", first.alias("best"))
    return found.select("doc_id", "row", "n", "sig").join(by_class, "sig").drop("sig").unionByName(alone)


def similar_groups(docs: DataFrame, *, words: int = 4, percent: int = 85, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id it reaches over links, itself included.

    Documents link when their sets of ``words``-word shingles (lower-cased A-Z, words split at ASCII white space; a shorter
    text is one shingle) have 100 * intersection >= ``percent`` * union. Without words, or with a null text, the set is
    empty and links with nothing. Rows with equal sets are one group from the start. Rows that share a doc_id are
    compared by their texts; a group's id passes over rows without doc_id (null if all are). Other columns are not
    read. An empty table gives no rows. Shingles are compared by 64-bit hashes.

    The two filters (of shingles seen twice) and the counts that order shingles follow the number of shingles. Up to
    ``max_filter_bytes`` they are broadcast; larger ones stay on the executors and are asked by exchanged hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    groups = _grouped(rows, words, percent, max_filter_bytes)
    return groups.select("doc_id", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, *, words: int = 4, percent: int = 85, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """One row of docs per group, with its columns: that of the smallest doc_id, rows without one last.

    Rows are told apart by a number of their own, so of rows that share a doc_id only those with similar texts are one group, and
    of equal rows one stays. Null and empty texts are groups of their own and stay. An empty table gives an empty one.
    """
    docs = without(docs, "__row", "__gone")
    numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__row").alias("row"), F.col("text").cast("string").alias("text"))
    gone = _grouped(rows, words, percent, max_filter_bytes).filter(F.col("best.row") != F.col("row")).select(F.col("row").alias("__gone"))
    return numbered.join(gone, F.col("__row") == F.col("__gone"), "left_anti").drop("__row")
