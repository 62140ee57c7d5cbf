"""Spelling variant grouping: each word of the corpus with its near words (one edit away) and the frequent one that it is a variant of.

Near words are found by positional q-gram inverted indexes. One edit lies within one half of a word, so near words share the other half:
words are dealt out by halves, for each length that the shorter word of a pair may have, and blocks of more than BLOCK words are dealt
again by halves of the half in which they differ, as often as needed; a block whose words differ in one place cannot be large. Within a
block each word merges the posting lists of its q-grams through a heap. Lists are kept by q-gram and position, so that only words whose
length and positions one edit allows come up; those that reach the least overlap that one edit leaves are compared letter by letter.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotile.llm.common import attach, in_batches, saved, shuffle_partitions

#: Words have at least so many characters and occurrences; a form has at least RATIO times the occurrences of its variant.
LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
#: Where this divides the checksum of document and word, one character of the word is struck out.
STRIKE = 31
#: Words of a block that are indexed together.
BLOCK = 1000
#: Entries that a task counts before it hands them on, and bytes of a text that are split at a time.
HELD, PASS_BYTES = 300_000, 4_000_000
Q = 2

_IN_WORD = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)}
#: Latin-1 codes of words, A-Z lower-cased; all else is a blank.
_TO_WORDS = bytes((b + 32 if 0x41 <= b < 0x5B else b) if b in _IN_WORD else 0x20 for b in range(256))


def _runs(text: str) -> Counter:
    """Occurrences of each run of letters of a text, in Latin-1, A-Z lower-cased. Characters beyond Latin-1 end a run."""
    raw = text.encode("latin-1", "replace").translate(_TO_WORDS)
    out: Counter = Counter()
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PASS_BYTES)
        end = len(raw) if end < 0 else end
        out.update(raw[at:end].split())
        at = end
    return out


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, n) of the task's documents; words repeat where a task has more than HELD of them."""
    held: Counter = Counter()

    def rows() -> pd.DataFrame:
        out = pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())}, columns=["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            start = zlib.crc32(f"{doc_id}:".encode())
            for run, n in _runs(text).items():
                if len(run) < LEAST_CHARS:
                    continue
                mark = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                if mark % STRIKE == 0:
                    at = mark % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST_CHARS:
                        continue
                held[run] += n
        if len(held) > HELD:
            yield rows()
    if held:
        yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with enough characters and occurrences."""
    plain = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    some = in_batches(plain).mapInPandas(_counted, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _dealt(words: DataFrame, windows: Column) -> DataFrame:
    """``words`` (word, n, size) once per window (least, low, high) with the block ``key``: all characters outside the window, where
    ``least`` is the length of the shorter words of the block."""
    out = words.withColumn("_window", F.explode(windows)).select("word", "n", "size", "_window.*")
    before, behind = F.expr("left(word, low)"), F.expr("right(word, least - high)")
    return out.withColumn("key", F.xxhash64("least", "low", "high", before, behind))


def _window(least: str, low: str, high: str) -> str:
    return f"named_struct('least', {least}, 'low', {low}, 'high', {high})"


def blocks(words: DataFrame, most: int) -> DataFrame:
    """Rows (key, least, low, high, size, word, n) of all blocks that may hold near words; none has more than ``most`` words, unless its
    words differ in one place only. Blocks above it are dealt again; each round looks at their words alone."""
    halves = F.expr(
        f"flatten(transform(filter(array(size, size - 1), m -> m >= {LEAST_CHARS}), m -> array({_window('m', '0', 'm div 2')}, {_window('m', 'm div 2', 'm')})))"
    ).cast("array<struct<least:int, low:int, high:int>>")
    middle = "(low + high) div 2"
    quarters = F.expr(f"array({_window('least', 'low', middle)}, {_window('least', middle, 'high')})").cast("array<struct<least:int, low:int, high:int>>")
    live, done = saved(_dealt(words, halves)), []
    while True:
        sizes = live.groupBy("key").agg(F.count("*").alias("words"), F.count_if(F.col("size") == F.col("least")).alias("shorter"))
        sizes = saved(sizes.where("words > 1 and shorter > 0").select("key", "words"))
        sized = attach(live, sizes, "key", how="inner")
        large = (F.col("words") > most) & (F.col("high") - F.col("low") > 1)
        done.append(sized.where(~large).drop("words"))
        if sizes.where(F.col("words") > most).isEmpty():
            break
        live = saved(_dealt(sized.where(large).select("word", "n", "size", quarters.alias("_windows")), F.col("_windows")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def one_edit(short: str, other: str) -> bool:
    """Whether two distinct words, the first not the longer one, are one insertion or replacement apart."""
    k = next((k for k, (x, y) in enumerate(zip(short, other, strict=False)) if x != y), len(short))
    return short[k + 1 :] == other[k + 1 :] if len(short) == len(other) else short[k:] == other[k + 1 :]


def near_in_block(words: list[str], least: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Index pairs of near words, the first of length ``least``, the second of that length or one more; all are alike outside the window.

    Q-grams that lie wholly outside the window are common to all and are counted once; lists are kept for the others. One edit leaves
    ``longer length - Q + 1 - Q`` of a word's q-grams; with none left to find inside the window, each word of the block is a candidate.
    """
    common = max(0, low - Q + 1) + max(0, least - high - Q + 1)
    lists: dict[tuple[str, int], list[int]] = defaultdict(list)
    earlier: list[int] = []
    for k in sorted(range(len(words)), key=lambda k: (len(words[k]), k)):
        word = words[k]
        longer = len(word) - least
        need = len(word) - 2 * Q + 1 - common
        grams = [(word[p : p + Q], p) for p in range(max(0, low - Q + 1), min(len(word) - Q, high + longer - 1) + 1)]
        if need <= 0:
            found = earlier
        else:
            # A replacement moves nothing; an insertion moves the q-grams behind it by one.
            merged = heapq.merge(*(lists[g, p - move] for g, p in grams for move in range(longer + 1) if (g, p - move) in lists))
            found = [j for j, hits in groupby(merged) if sum(1 for _ in hits) >= need]
        for j in found:
            if words[j] != word and one_edit(words[j], word):
                yield j, k
        if not longer:
            earlier.append(k)
            for gram in grams:
                lists[gram].append(k)


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, n_a, b, n_b) of near words a < b, from rows sorted by key; the last block of a batch waits for the next one."""
    rest: list[pd.DataFrame] = []

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, block in rows.groupby("key", sort=False):
            words, n = block["word"].tolist(), block["n"].tolist()
            for j, k in near_in_block(words, *(int(block[c].iloc[0]) for c in ("least", "low", "high"))):
                one, other = sorted(((words[j], n[j]), (words[k], n[k])))
                out.append((*one, *other))
        return pd.DataFrame(out, columns=["a", "n_a", "b", "n_b"])

    for batch in batches:
        last = batch["key"] == batch["key"].iloc[-1]
        if last.all() and (not rest or rest[-1]["key"].iloc[-1] == batch["key"].iloc[-1]):
            rest.append(batch)
            continue
        if len(out := pairs(pd.concat([*rest, batch[~last]]))):
            yield out
        rest = [batch[last]]
    if rest and len(out := pairs(pd.concat(rest))):
        yield out


def near_pairs(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """Pairs (a, n_a, b, n_b), a < b, of ``words`` (word, n) that are one inserted, deleted or replaced character apart, each once."""
    dealt = blocks(words.withColumn("size", F.char_length("word")), most)
    dealt = dealt.select("key", "least", "low", "high", "word", "n").repartition(shuffle_partitions(words.sparkSession), "key").sortWithinPartitions("key", "word")
    return dealt.mapInPandas(_near, "a string, n_a long, b string, n_b long").dropDuplicates(["a", "b"])


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) by following ``forms`` (word, form, n) to the end, two steps become four become eight. Counts grow RATIO-fold
    from a word to its form, so the largest count ``most`` bounds the length of the chains."""
    steps = max(1.0, math.log(max(most, 1) / LEAST_COUNT + 1, RATIO))
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        out = saved(out)
        further = out.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        out = out.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return out


def variant_groups(docs: DataFrame) -> DataFrame:
    """One row per word of all texts of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n.

    A word's form is its near word of largest count, ties to the smallest in code-point order, if that has RATIO times its count. Null
    texts hold no words, a null doc_id counts as an empty one; rows are documents of their own, repeated ones too. Texts and words of any
    length are taken whole, in blocks; an empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    words = saved(word_counts(docs))
    pairs = near_pairs(words)
    ways = F.array(*(F.struct(F.col(w).alias("word"), F.col(v).alias("near"), F.col(f"n_{v}").alias("near_n")) for w, v in ("ab", "ba")))
    both = pairs.select(F.explode(ways).alias("_way")).select("_way.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    found = attach(words, best, "word")
    is_form = F.col("near_n") >= RATIO * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    found = saved(found)
    top = found.agg(F.max("n")).first()[0]
    out = attach(found, roots(found.where("form is not null"), top or 0), "word")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps),
runs AS (
  SELECT coalesce(doc_id::varchar, '') AS doc_id,
    translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS digits FROM runs WHERE length(run) >= 7 GROUP BY ALL),
marked AS (
  SELECT doc_id, run, n, xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(range(length(digits) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', digits[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', digits[2 * i + 2]) - 1)),
      lambda c, b: xor(c // 256, steps[xor(c, b) % 256 + 1]))) AS h
  FROM counted, crc),
struck AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM marked),
words AS (SELECT word, sum(n)::bigint AS n, length(word) AS size FROM struck WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, n, size, pos, word[:pos] || word[pos + 2:] AS rest FROM (SELECT *, unnest(range(size)) AS pos FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN gaps b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN gaps b ON a.word = b.rest),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
found AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND b.place = 1),
chain AS (SELECT word, form AS root FROM found WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN found f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN found f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM found f LEFT JOIN ends e USING (word)
"""
