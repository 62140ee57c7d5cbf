"""Source divergence audit: how far apart the term shares of the sources of a language lie, exactly.

Terms are counted in the executors, one row for each (lang, source, term) that a task has seen. For each pair of sources of a language,
tasks tally the distinct combinations (count here, count there) of the terms that both hold; terms that only one of them or neither
holds are implied: by inclusion and exclusion their cells follow from the tally of each source alone and the number of kept terms. The
divergence is worked out once for each distinct combination and multiplied by the number of terms in it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotile.llm.common import in_batches, join_ids, saved, shuffle_partitions

#: A term is kept in a language if at least so many of its documents hold it; shares are smoothed by SMOOTH and scaled to SCALE.
LEAST_DOCS, SMOOTH, SCALE = 10, 2, 1_000_000_000
#: Terms of a group that the report names.
TOP_TERMS = 10
#: Entries that a task counts before it hands them on, bytes of a text that are split at a time, and counts that a tally takes in at once.
HELD, PASS_BYTES, TALLY_ROWS = 600_000, 4_000_000, 200_000
DOC = 1 << 40

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of UTF-8 that belong to no term become blanks; A-Z are lower-cased.
_TO_TERMS = bytes((b + 32 if 0x41 <= b < 0x5B else b) if _LETTER[b] else 0x20 for b in range(256))


def term_counts(text: str) -> Counter:
    """Occurrences of each term (runs of ASCII letters and characters beyond ASCII, A-Z lower-cased) of a text, in UTF-8."""
    raw = text.encode().translate(_TO_TERMS)
    if len(raw) <= PASS_BYTES:
        return Counter(raw.split())
    out: Counter = Counter()
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PASS_BYTES)
        end = len(raw) if end < 0 else end
        out.update(raw[at:end].split())
        at = end
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the task's documents; terms repeat where a task has more than HELD of them."""
    held: dict[tuple[str, str], dict[bytes, int]] = defaultdict(dict)  # a term's documents in steps of DOC, plus its occurrences

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            both = np.fromiter(terms.values(), np.int64, len(terms))
            columns = [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(both % DOC), pa.array(both // DOC)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            terms = held[lang, source]
            seen = terms.get
            for term, n in term_counts(text).items():
                terms[term] = seen(term, 0) + n + DOC
        if sum(map(len, held.values())) > HELD:
            yield from rows()
    yield from rows()


def kept_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of kept terms (lang, term, gid, n > 0, and lang_n of the whole language), and every group (lang, source) with a number gid and
    n_group, n_lang and n_terms, the kept terms of its language."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    some = in_batches(plain).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    every = some.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = every.withColumn("lang_n", F.sum("n").over(of_term)).withColumn("docs", F.sum("docs").over(of_term)).where(F.col("docs") >= LEAST_DOCS)
    groups = saved(plain.groupBy("lang", "source").agg(F.count("*").alias("_rows")).select("lang", "source", F.monotonically_increasing_id().alias("gid")))
    kept = saved(join_ids(kept.select("lang", "source", "term", "n", "lang_n"), groups, ["lang", "source"], "inner").drop("source"))
    of_lang = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n").alias("n_lang"))
    sized = groups.join(kept.groupBy("gid").agg(F.sum("n").alias("n_group")), "gid", "left").join(of_lang, "lang", "left")
    return kept, saved(sized.na.fill(0, ["n_group", "n_lang", "n_terms"]))


def _tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b, in_a, in_b, terms): of rows (lang, term, gid, n) sorted by all of these, how many terms have each pair of counts in groups a < b.

    Rows of one term stay together: the last term of a batch waits for the next one. Rows are paired by their distance within a term,
    all terms at once, and every distance is tallied before the next, so memory holds TALLY_ROWS rows and the distinct combinations.
    """

    def summed(cells: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort(cells.T[::-1])
        cells, terms = cells[order], terms[order]
        first = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(1)))
        return cells[first], np.add.reduceat(terms, first)

    def tally(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        new = rows["term"].ne(rows["term"].shift()) | rows["lang"].ne(rows["lang"].shift())
        term, gid, n = new.cumsum().to_numpy(), rows["gid"].to_numpy(), rows["n"].to_numpy()
        found, apart = [], 1
        while apart < len(n) and (same := np.flatnonzero(term[apart:] == term[:-apart])).size:
            other = same + apart
            found.append(summed(np.stack([gid[same], gid[other], n[same], n[other]], 1), np.ones(len(same), np.int64)))
            apart += 1
        if found:
            cells, terms = summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pd.DataFrame(np.column_stack([cells, terms]), columns=["a", "b", "in_a", "in_b", "terms"])

    waiting: list[pd.DataFrame] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) < TALLY_ROWS:
            continue
        rows = pd.concat(waiting, ignore_index=True)
        last = (rows["lang"] == rows["lang"].iloc[-1]) & (rows["term"] == rows["term"].iloc[-1])
        waiting = [rows[last]]
        if not last.all():
            yield from tally(rows[~last].reset_index(drop=True))
    if waiting:
        yield from tally(pd.concat(waiting, ignore_index=True))


def joint_counts(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, in_a, in_b, terms): for groups a < b of a language, the number of kept terms with these counts, zeros included."""
    dealt = kept.select("lang", "term", "gid", "n").repartition(shuffle_partitions(kept.sparkSession), "lang", "term").sortWithinPartitions("lang", "term", "gid")
    both = dealt.mapInPandas(_tallied, "a long, b long, in_a long, in_b long, terms long")
    both = saved(both.groupBy("a", "b", "in_a", "in_b").agg(F.sum("terms").alias("terms")))
    alone = saved(kept.groupBy("gid", F.col("n").alias("count")).agg(F.count("*").alias("terms")))
    pairs = groups.select("lang", F.col("gid").alias("a"), "n_terms").join(groups.select("lang", F.col("gid").alias("b")), "lang").where("a < b").drop("lang")
    zero = F.lit(0).cast("long")

    def cells(rows: DataFrame, in_a: Column, in_b: Column, terms: Column) -> DataFrame:
        return rows.select("a", "b", in_a.alias("in_a"), in_b.alias("in_b"), terms.alias("terms"))

    count, terms, in_a, in_b = F.col("count"), F.col("terms"), F.col("in_a"), F.col("in_b")
    of_a = pairs.drop("n_terms").join(alone.withColumnRenamed("gid", "a"), "a")
    of_b = pairs.drop("n_terms").join(alone.withColumnRenamed("gid", "b"), "b")
    # Each term starts in the cell (0, 0). What a group holds moves it to (count, 0) or (0, count); terms of both, which were moved
    # twice, are put in their own cell.
    moved = [
        cells(pairs, zero, zero, F.col("n_terms")),
        cells(of_a, count, zero, terms), cells(of_a, zero, zero, -terms),
        cells(of_b, zero, count, terms), cells(of_b, zero, zero, -terms),
        cells(both, in_a, in_b, terms), cells(both, in_a, zero, -terms), cells(both, zero, in_b, -terms), cells(both, zero, zero, terms),
    ]
    out = moved[0]
    for part in moved[1:]:
        out = out.unionByName(part)
    return out.groupBy("a", "b", "in_a", "in_b").agg(F.sum("terms").alias("terms")).where("terms > 0")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), in decimals, so that counts of any size stay exact."""
    return F.expr(f"1L + ({SCALE}BD * (cast({count} as decimal(20, 0)) + {SMOOTH}BD)) div (cast({total} as decimal(20, 0)) + {SMOOTH}BD * cast({terms} as decimal(20, 0)))")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit_sources(docs: DataFrame) -> DataFrame:
    """One row per pair of sources of a language (part ``pair``, both ways round, all ranks) and for the TOP_TERMS terms by which each
    source exceeds its language most (part ``term``): lang, source, part, item, value, rank.

    ``docs`` has text, lang and source; nulls count as empty. Every row is a document, repeated ones too. A source without kept terms
    has the smoothed share of count 0 for each; a language without kept terms has value 0 for its pairs. Texts of any length are
    counted in blocks, an empty table gives no rows, and other columns, whatever their names, are not looked at. Ties rank by item in
    UTF-8 order. Groups (lang, source) are joined by broadcast up to a checked number, else by shuffle.
    """
    kept, groups = kept_counts(docs)
    joint = joint_counts(kept, groups)
    for side in ("a", "b"):
        of_side = groups.select(F.col("gid").alias(side), F.col("n_group").alias(f"n_{side}"), *(["n_terms"] if side == "a" else []))
        joint = join_ids(joint, of_side, side, "inner")
    joint = joint.withColumn("p", share("in_a", "n_a", "n_terms")).withColumn("q", share("in_b", "n_b", "n_terms"))
    value = joint.groupBy("a", "b").agg(F.sum(divergence("p", "q") * F.col("terms")).alias("value"))
    names = groups.select("lang", "source", "gid")
    pairs = names.join(names.select("lang", F.col("source").alias("item"), F.col("gid").alias("other")), "lang").where("gid <> other")
    pairs = pairs.withColumn("a", F.least("gid", "other")).withColumn("b", F.greatest("gid", "other"))
    pairs = pairs.join(value, ["a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.withColumn("rank", rank)

    terms = join_ids(kept.drop("lang"), groups, "gid", "inner")
    terms = terms.withColumn("p", share("n", "n_group", "n_terms")).withColumn("q", share("lang_n", "n_lang", "n_terms")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value"))
    return pairs.unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= TOP_TERMS))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs),
vocabulary AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM vocabulary GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(l.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) t USING (lang, source) LEFT JOIN langs l USING (lang)),
cells AS (
  SELECT g.lang, g.source, w.term, coalesce(c.n, 0) AS n, w.n AS lang_n,
    (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v))::bigint AS p
  FROM groups g JOIN vocabulary w USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = w.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::bigint AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
shares AS (
  SELECT c.lang, c.source, c.term, c.n, c.p, (1 + (1000000000::hugeint * (c.lang_n + 2)) // (l.total + 2 * l.v))::bigint AS q
  FROM cells c JOIN langs l USING (lang)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::int AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::bigint AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
