"""N-gram Jaccard self-join with signature trees.

1. Every document becomes the set of its hashed word shingles; documents with equal sets form a class, and only classes go on.
2. A class can have a partner only if enough of its smallest hashes also occur in another class (prefix filtering with a
   margin). Hash buckets count that for all classes; the great majority end here, without a shuffle of text.
3. The rest order their shingles by rarity. Partners must share a shingle among the rarest ones, so classes meet in the buckets of those.
4. In a bucket a signature tree is built: each node holds the OR of its members' token bitmaps, their range of sizes and
   the most tokens that share a bit. Two nodes are traversed together and left as soon as their greatest
   possible overlap, or their sizes, or a link that is already known, rules out a new link. Leaves are compared exactly.
5. Links join classes into components. Each class meets others in its largest bucket first; a bucket whose members all met in one
   of those, or are in one component by then, is not opened again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotile.llm.common import attach, in_batches, join_ids, saved, shuffle_partitions
from chronotile.llm.shingles import mixed, shingle_sets
from chronotile.operators.graph import components

WIDTH, PERCENT = 5, 80
#: Members of a bucket that one tree takes; a larger bucket is split, and its parts are compared in pairs.
TREE_MEMBERS, FANOUT = 512, 8
#: Tokens of all prefixes that one hash bucket takes on average; characters of text that a worker hashes at a time.
BUCKET_TOKENS, PIECE_CHARS = 500_000, 2_000_000
#: What two classes are told apart by: 128 bits of digest and the number of shingles.
CLASS = ("mark", "check", "n_shingles")


def least_overlap(n):
    """Shingles that a set of n must share with any partner."""
    return (PERCENT * n + 99) // 100


def _marks(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set."""
    one = np.array([mixed(x.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x)))[0] if len(x) else 0 for x in sets], np.uint64)
    two = np.array([mixed(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) if len(x) else 0 for x in sets], np.uint64)
    return one.view(np.int64), two.view(np.int64)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of the batches in pieces of about PIECE_CHARS characters, so that a worker's sets and sorts are neither many nor large."""
    held, chars = [], 0
    for batch in batches:
        held.append(batch)
        chars += int(batch["text"].str.len().sum())
        if chars >= PIECE_CHARS:
            yield pd.concat(held, ignore_index=True)
            held, chars = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _pieces(batches):
        sets = shingle_sets(batch["text"].tolist(), WIDTH)
        one, two = _marks(sets)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": [len(x) for x in sets], "mark": one, "check": two})


def _prefix_length(n: int) -> int:
    return min(n, n - least_overlap(n) + 1 + n // 10)


def _dealt(buckets: int):
    """Rows (bucket, marks, counts, tokens, credit_marks, credits): the smallest hashes of all classes of a batch, dealt by hash."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches):
            sets = shingle_sets(batch["text"].tolist(), WIDTH)
            marks, _ = _marks(sets)
            firsts = {int(m): k for k, m in enumerate(marks) if len(sets[k])}
            chosen = list(firsts.values())
            if not chosen:
                continue
            heads = [sets[k][: _prefix_length(len(sets[k]))] for k in chosen]
            token = np.concatenate(heads)
            owner = np.repeat(np.arange(len(chosen)), [len(x) for x in heads])
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            run = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            place = np.arange(len(token)) - np.repeat(run, np.diff(np.append(run, len(token))))
            # Two classes of this batch show that a token is shared; the others are credited here and not sent.
            credit = np.bincount(owner[place >= 2], minlength=len(chosen))
            token, owner = token[place < 2], owner[place < 2]
            bucket = (token % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            token, owner, bucket = (token[order] // np.uint64(buckets)).astype(np.uint32), owner[order], bucket[order]
            mark = marks[chosen]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own, counts = np.unique(owner[cut[b] : cut[b + 1]], return_counts=True)
                rows.append((b, mark[own].tobytes(), counts.astype(np.uint32).tobytes(), token[cut[b] : cut[b + 1]].tobytes(), b"", b""))
            if credit.any():
                rows.append((int(mark[0] % buckets), b"", b"", b"", mark[credit > 0].tobytes(), credit[credit > 0].astype(np.int64).tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "marks", "counts", "tokens", "credit_marks", "credits"])

    return deal


def _credited(rows: pd.DataFrame) -> pd.DataFrame:
    """For each class the number of its tokens in this bucket that another class has as well."""
    mark = np.repeat(np.frombuffer(b"".join(rows["marks"]), np.int64), np.frombuffer(b"".join(rows["counts"]), np.uint32))
    token = np.frombuffer(b"".join(rows["tokens"]), np.uint32)
    order = np.lexsort((mark, token))
    mark, token = mark[order], token[order]
    new = np.append(True, (token[1:] != token[:-1]) | (mark[1:] != mark[:-1]))[: len(token)]
    mark, token = mark[new], token[new]
    run = np.flatnonzero(np.append(True, token[1:] != token[:-1]))[: len(token)]
    size = np.diff(np.append(run, len(token)))
    found, credits = np.unique(mark[np.repeat(size, size) > 1], return_counts=True)
    here = [np.frombuffer(b"".join(rows[c]), np.int64) for c in ("credit_marks", "credits")]
    return pd.DataFrame({"mark": np.append(found, here[0]), "credit": np.append(credits, here[1])})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _pieces(batches):
        sets = shingle_sets(batch["text"].tolist(), WIDTH)
        one, two = _marks(sets)
        columns = {"doc_id": batch["doc_id"], "mark": one, "check": two, "n_shingles": [len(x) for x in sets]}
        yield pd.DataFrame(columns | {"tokens": [x.view(np.int64) for x in sets]})


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A token bitmap of at least two bits a token, in 64-bit words; folding its halves together gives that of half the width."""
    words = 1 << max(0, int(np.ceil(np.log2(max(1, 2 * len(tokens)) / 64))))
    bits = np.zeros(words * 64, np.uint8)
    bits[(mixed(tokens.view(np.uint64)) % np.uint64(words * 64)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _ones(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


class SignatureTree:
    """Members in order of size, FANOUT to a node.

    A node is (first, last, bitmap, low, high, slack, children): the OR of its members' bitmaps at the width of the narrowest, the
    range of their sizes, and the most tokens of a member beyond the bits that they set at this width.
    """

    def __init__(self, bitmaps: list[np.ndarray], counts: list[int], sizes: np.ndarray):
        level = [(k, k + 1, m, int(sizes[k]), int(sizes[k]), counts[k] - _ones(m), ()) for k, m in enumerate(bitmaps)]
        while len(level) > 1:
            groups, level = [level[k : k + FANOUT] for k in range(0, len(level), FANOUT)], []
            for g in groups:
                words = min(len(x[2]) for x in g)
                union = np.bitwise_or.reduce([_folded(x[2], words) for x in g])
                first, last = g[0][0], g[-1][1]
                slack = max(counts[k] - _ones(_folded(bitmaps[k], words)) for k in range(first, last))
                level.append((first, last, union, min(x[3] for x in g), max(x[4] for x in g), slack, tuple(g)))
        self.root = level[0]


def _apart(a: tuple, b: tuple) -> bool:
    """Whether no member of a can link to one of b: by sizes, or by the most tokens that can be in both."""
    if 100 * a[4] < PERCENT * b[3] or 100 * b[4] < PERCENT * a[3]:
        return True
    words = min(len(a[2]), len(b[2]))
    slack = min(x[5] for x in (a, b) if len(x[2]) == words)
    most = _ones(_folded(a[2], words) & _folded(b[2], words)) + slack
    return (100 + PERCENT) * most < PERCENT * (a[3] + b[3])


def _traverse(root: tuple, comps: list[int], test) -> list[tuple[int, int]]:
    """Pairs of members for which ``test`` (called only where the tree leaves a chance) holds; pairs joined already are not tested.

    A pair is joined by equal ``comps`` or pairs found before, unless ``test`` is None: then every pair with a chance is returned.
    """
    first: dict[int, int] = {}
    parent = [first.setdefault(c, k) for k, c in enumerate(comps)]

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    def joined(a: tuple, b: tuple) -> bool:
        root_ = find(a[0])
        return all(find(k) == root_ for k in range(a[0] + 1, a[1])) and all(find(k) == root_ for k in range(b[0], b[1]))

    out, stack = [], [(root, root)]
    while stack:
        a, b = stack.pop()
        if joined(a, b) or a is not b and _apart(a, b):
            continue
        if a is b:
            stack += [(a[6][k], a[6][m]) for k in range(len(a[6])) for m in range(k, len(a[6]))][::-1]
        elif a[6] or b[6]:
            stack += [(x, y) for x in a[6] or (a,) for y in b[6] or (b,)]
        elif test is None:
            out.append((a[0], b[0]))
        elif test(a[0], b[0]):
            out.append((a[0], b[0]))
            parent[find(a[0])] = find(b[0])
    return out


def shared_tokens(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    low, high = (a, b) if len(a) < len(b) else (b, a)
    if not len(low):
        return 0
    at = np.minimum(np.searchsorted(high, low), len(high) - 1)
    return int((high[at] == low).sum())


def similar(both: int, n: int, m: int) -> bool:
    return 100 * both >= PERCENT * (n + m - both)


def tree_links(marks: np.ndarray, comps: np.ndarray, sizes: np.ndarray, tokens: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all linked members of one bucket, found by a dual traversal of its signature tree and exact comparison of leaves."""
    order = np.lexsort((marks, comps, sizes))
    tokens, sizes, marks = [np.sort(tokens[k]) for k in order], sizes[order], marks[order]
    root = SignatureTree([bitmap(x) for x in tokens], [len(x) for x in tokens], sizes).root
    found = _traverse(root, comps[order].tolist(), lambda x, y: similar(shared_tokens(tokens[x], tokens[y]), int(sizes[x]), int(sizes[y])))
    return [(int(marks[x]), int(marks[y])) for x, y in found]


def tree_pairs(marks: np.ndarray, comps: np.ndarray, sizes: np.ndarray, counts: list[int], bitmaps: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of members of different components that the signature tree of a bucket leaves a chance."""
    order = np.lexsort((marks, comps, sizes))
    root = SignatureTree([bitmaps[k] for k in order], [counts[k] for k in order], sizes[order]).root
    return [(int(marks[order[x]]), int(marks[order[y]])) for x, y in _traverse(root, comps[order].tolist(), None)]


def stars(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links with the same components as ``pairs`` and one step to the least member, which saves rounds later."""
    least: dict[int, int] = {}

    def find(k: int) -> int:
        while least.setdefault(k, k) != k:
            least[k] = k = least[least[k]]
        return k

    for x, y in pairs:
        a, b = find(x), find(y)
        least[max(a, b)] = min(a, b)
    return [(k, find(k)) for k in list(least) if find(k) != k]


def _bucket_links(rows: pd.DataFrame) -> pd.DataFrame:
    links = []
    if rows["comp"].nunique() > 1:
        tokens = [np.asarray(x, np.int64) for x in rows["tokens"]]
        links = stars(tree_links(rows["node"].to_numpy(), rows["comp"].to_numpy(), rows["n"].to_numpy(), tokens))
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def _bucket_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    pairs = []
    if rows["comp"].nunique() > 1:
        bitmaps = [np.frombuffer(x, np.uint64) for x in rows["bitmap"]]
        pairs = tree_pairs(rows["node"].to_numpy(), rows["comp"].to_numpy(), rows["n"].to_numpy(), rows["held"].tolist(), bitmaps)
    return pd.DataFrame([(max(x), min(x)) for x in pairs], columns=["u", "v"], dtype="int64")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, held (tokens) and bitmap; the tokens are read where Arrow has put them."""
    for batch in batches:
        lists = batch.column("tokens")
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        bitmaps = [bitmap(values[a:b]).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        columns = [batch.column("node"), batch.column("n"), pa.array(np.diff(ends), pa.int64()), pa.array(bitmaps, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "n", "held", "bitmap"])


def _survivors(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id of one document, mark, check, n_shingles and node, a number, of each class that may have partners."""
    spark = docs.sparkSession
    tokens = classes.agg(F.sum(F.col("n_shingles") * 3 / 10 + 1)).first()[0] or 0
    buckets = max(2 * shuffle_partitions(spark), int(tokens // BUCKET_TOKENS))
    shape = "bucket int, marks binary, counts binary, tokens binary, credit_marks binary, credits binary"
    dealt = docs.filter("doc_id is not null").select("text").mapInPandas(_dealt(buckets), shape)
    credits = dealt.groupBy("bucket").applyInPandas(_credited, "mark long, credit long").groupBy("mark").agg(F.sum("credit").alias("credit"))
    need = 1 + F.floor(F.floor((PERCENT * F.col("n_shingles") + 99) / 100) / 10)
    found = classes.join(credits, "mark").filter(F.col("credit") >= need)
    return saved(found.select("doc_id", *CLASS, F.monotonically_increasing_id().alias("node")))


def _candidates(docs: DataFrame, survivors: DataFrame) -> DataFrame:
    """node, n, tokens (those that other classes share, rarest first), head (the first of which a partner must share one)."""
    texts = join_ids(docs.select("doc_id", "text"), survivors.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = texts.mapInPandas(_sets, "doc_id long, mark long, check long, n_shingles long, tokens array<long>")
    sets = sets.join(survivors, ["doc_id", *CLASS]).dropDuplicates(["node"]).select("node", F.col("n_shingles").alias("n"), "tokens")
    sets = saved(sets)
    held = sets.select("node", "n", F.explode("tokens").alias("token"))
    counts = saved(held.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    rows = attach(held, counts, "token", how="inner")
    least = F.floor((PERCENT * F.col("n") + 99) / 100)
    listed = rows.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).filter(F.size("t") >= least)
    head = F.slice(F.col("t.token"), 1, (F.size("t") - least + 1).cast("int"))
    return saved(listed.select("node", "n", F.col("t.token").alias("tokens"), head.alias("head")))


def _open_buckets(rows: DataFrame) -> DataFrame:
    """The buckets of (token, node, comp, home) rows that hold several components, one of those with the same members.

    token, d (members), parts, p1 and p2 (two members), and home, the bucket in which all members have met, if there is one.
    """
    stats = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("d"),
        F.expr("bit_xor(xxhash64(node))").alias("members"),
        F.min("comp").alias("c1"),
        F.max("comp").alias("c2"),
        F.min("node").alias("p1"),
        F.max("node").alias("p2"),
        F.when((F.count("home") == F.count(F.lit(1))) & (F.min("home") == F.max("home")), F.min("home")).alias("home"),
    )
    same = stats.filter("c1 < c2").groupBy("members", "d", "p1", "p2").agg(F.min("token").alias("token"), F.first("home").alias("home"))
    return saved(same.withColumn("parts", F.ceil(F.col("d") / TREE_MEMBERS)))


def _first_links(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links in the buckets of ``members`` (node, comp, token, parts, p1, p2).

    A bucket in several parts is searched part by part, each with two members that stand for the whole bucket.
    """
    part = F.pmod(F.xxhash64("node"), "parts")
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    where = F.when(F.col("node").isin(F.col("p1"), F.col("p2")), every).otherwise(F.array(part))
    placed = members.select("node", "comp", "token", F.explode(where).alias("part"))
    full = placed.join(candidates.select("node", "n", "tokens"), "node")
    return saved(full.groupBy("token", "part").applyInPandas(lambda _, x: _bucket_links(x), "u long, v long"))


def _other_links(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links between components in the buckets of ``members``: trees of bitmaps alone leave few pairs, which are compared exactly.

    Every two parts of a bucket in several parts meet.
    """
    part = F.pmod(F.xxhash64("node"), "parts")
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    met = F.transform(every, lambda k: F.concat_ws("-", F.least(k, part), F.greatest(k, part)))
    where = F.when(F.col("parts") <= 2, F.array(F.lit("0"))).otherwise(met)
    signed = candidates.select("node", "n", "tokens").mapInArrow(_signed, "node long, n long, held long, bitmap binary")
    full = members.select("node", "comp", "token", F.explode(where).alias("part")).join(signed, "node")
    pairs = full.groupBy("token", "part").applyInPandas(lambda _, x: _bucket_pairs(x), "u long, v long").distinct()
    left = candidates.select(F.col("node").alias("u"), "n", "tokens")
    right = candidates.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("tokens").alias("other"))
    both = F.size(F.array_intersect("tokens", "other"))
    return saved(pairs.join(left, "u").join(right, "v").filter(100 * both >= PERCENT * (F.col("n") + F.col("m") - both)).select("u", "v"))


def _all_links(candidates: DataFrame) -> DataFrame:
    """(node, component) of all linked classes.

    First each class meets others in the largest of its buckets, its home. A bucket whose members all have one home, a home itself, and a
    bucket in one component by then are done; the others follow.
    """
    heads = candidates.select("node", F.explode("head").alias("token"))
    open_ = _open_buckets(heads.withColumn("comp", F.col("node")).withColumn("home", F.lit(None).cast("long"))).drop("home")
    largest = heads.join(open_, "token").groupBy("node").agg(F.max(F.struct("d", "token", "parts")).alias("c"))
    homes = saved(largest.select("node", F.col("c.token").alias("home"), F.col("c.parts").alias("parts")))
    first = open_.join(homes.select(F.col("home").alias("token")).distinct(), "token", "left_semi")
    linked = saved(components(_first_links(heads.join(first, "token").withColumn("comp", F.col("node")), candidates)))

    whole = homes.filter("parts = 1").drop("parts")
    state = candidates.select("node").join(linked, "node", "left").join(whole, "node", "left")
    state = candidates.select("node", "head").join(state.select("node", F.coalesce("component", "node").alias("comp"), "home"), "node")
    rows = state.select("node", "comp", "home", F.explode("head").alias("token"))
    left = _open_buckets(rows).filter("home is null")
    left = saved(left.join(whole.select(F.col("home").alias("token")).distinct(), "token", "left_anti").select("token", "parts"))
    if left.isEmpty():
        return linked
    more = _other_links(rows.join(left, "token"), candidates)
    if more.isEmpty():
        return linked
    return saved(components(more.unionByName(linked.select(F.col("node").alias("u"), F.col("component").alias("v")))))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when their sets' Jaccard similarity is at least PERCENT / 100. component_id is the smallest doc_id that
    links lead to. A text without words has no shingles and links to nothing, not even its like; a null doc_id links
    to nothing and has a null component. Rows that repeat a doc_id are rows of their own. Extra columns are ignored; an empty table
    gives an empty result; a very long text is one class like others, its set is held in one task.
    """
    docs = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    meta = saved(docs.mapInPandas(_digests, "doc_id long, n_shingles long, mark long, check long"))
    return _named(docs, meta).select("doc_id", "n_shingles", "component_id")


def _named(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """``meta``, the digests of ``docs``, with component_id and root, a number that linked classes share, null without links."""
    usable = meta.filter("n_shingles > 0 and doc_id is not null")
    classes = saved(usable.groupBy(*CLASS).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))
    survivors = _survivors(docs, classes)
    linked = survivors.join(_all_links(_candidates(docs, survivors)), "node").select("doc_id", *CLASS, F.col("component").alias("root"))
    least = saved(linked.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    linked = attach(linked, least, "root", how="inner").select(*CLASS, "component_id", "root")
    named = classes.join(linked, list(CLASS), "left").filter("copies > 1 or component_id is not null")
    named = saved(named.select(*CLASS, F.coalesce("component_id", "doc_id").alias("component_id"), "root"))
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return attach(meta, named, *CLASS).withColumn("component_id", own)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of those with the smallest doc_id one, by the digest of its text, and of its repeats one.

    Rows without words or without a doc_id are in no component and stay, all of them. All columns come through as they are.
    """
    rows = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    meta = saved(rows.mapInPandas(_digests, "doc_id long, n_shingles long, mark long, check long"))
    named = saved(_named(rows, meta))
    repeated = saved(named.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return join_ids(docs, saved(named.filter("component_id < doc_id").select("doc_id")), "doc_id", "left_anti")
    key = ("doc_id", *CLASS)
    usable = named.filter("doc_id is not null and n_shingles > 0")
    group = F.coalesce(F.col("root").cast("string"), F.concat_ws(":", *CLASS))
    kept = saved(usable.groupBy(group.alias("group")).agg(F.min(F.struct(*key)).alias("k")).select("k.*"))
    single = join_ids(usable, repeated, "doc_id", "left_anti").select(*key)
    dropped = saved(single.join(kept, list(key), "left_anti").select("doc_id"))
    of_single = join_ids(join_ids(docs, repeated, "doc_id", "left_anti"), dropped, "doc_id", "left_anti")

    @F.pandas_udf("mark long, check long, n_shingles long")
    def digest(text: pd.Series) -> pd.DataFrame:
        return next(_digests(iter([pd.DataFrame({"doc_id": 0, "text": text})])))[list(CLASS)]

    others = join_ids(docs, repeated, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("doc"), digest("text").alias("own"))
    others = others.select("doc", F.col("doc.doc_id").cast("long").alias("doc_id"), *[F.col(f"own.{c}").alias(c) for c in CLASS])
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("doc")))
    first = others.filter("n_shingles > 0").join(kept, list(key), "left_semi").withColumn("place", place).filter("place = 1")
    of_repeated = others.filter("n_shingles = 0").select("doc.*").unionByName(first.select("doc.*"))
    return of_single.unionByName(of_repeated)


#: DuckDB: op3 by counting the shingles that pairs share, then following links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[k:k + 4], ' ') END AS shingle
  FROM w, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS u(k) WHERE len(words) > 0
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r(doc_id, seen) AS (SELECT a, b FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.seen), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""
