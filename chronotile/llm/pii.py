"""Personal data: patterns for e-mail, IP, card and phone, and terms that reveal them (DataFrame operations only).

Patterns give the base spans. Then the words of whole documents are weighed by information theory: with the probabilities
estimated from document counts over the whole corpus, a word discloses a value when their pointwise mutual information reaches
DISCLOSED of the value's own information content, that is, when most documents that have the word have the value too.
All occurrences of such words, in every document, are spans too and are generalised when a text is sanitised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotile.llm.common import attach, join_ids, let, saved

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the contract's patterns, with the same matches: no back-tracking and no recursion on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Documents that must show a pair; share of the information.
SUPPORT, DISCLOSED = 3, 0.9
WORDS = r"\p{L}++"
#: Most terms that a checked broadcast may hold; beyond it the join shuffles.
BROADCAST_TERMS = 200_000
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _no_spans() -> Column:
    return F.array().cast(SPANS)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def term(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d < 5, d * 2).otherwise(d * 2 - 9)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.concat(F.lit("0"), F.substring(part(x), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _placed(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as array<struct<start, end, value>>, in order; the gaps between matches give the offsets.

    Lengths are added up in blocks of about the square root of the number of matches, first within blocks and then over blocks, because an
    array that grows in a fold is copied at each step.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("value")), lambda x: x["value"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(x: Column) -> Column:
        return let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda width: let(in_blocks(x, width), from_blocks))

    def in_blocks(x: Column, width: Column) -> Column:
        every = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int"))
        return F.transform(every, lambda k: F.slice(x, k * width + 1, width))

    def from_blocks(blocks: Column) -> Column:
        long = lambda block: F.aggregate(block, F.lit(0), lambda n, m: n + m["gap"] + F.length(m["value"]))
        grown = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
        starts = F.slice(F.aggregate(F.transform(blocks, long), F.array(F.lit(0)), grown), 1, F.size(blocks))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), starts.alias("at")), inner))

    def inner(b: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            start = acc["at"] + m["gap"]
            end = start + F.length(m["value"])
            hit = F.array(F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value")))
            return F.struct(end.alias("at"), F.concat(acc["out"], hit).alias("out"))

        return F.aggregate(b["block"], F.struct(b["at"].alias("at"), none.alias("out")), step)["out"]

    return let(pairs, lambda x: F.when(F.size(x) > 0, placed(x)).otherwise(none))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of all base kinds, by kind as listed and start; offsets count characters."""
    hint = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9]{2}|[0-9][\x20-][0-9]"),
        "phone": text.rlike(r"\+[0-9]"),
    }

    def of(kind: str) -> Column:
        placed = F.filter(_placed(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        named = lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
        return F.transform(placed, named)

    return F.concat(*[F.when(hint[k], of(k)).otherwise(_no_spans()) for k in KINDS])


def _words_only(text: Column) -> Column:
    """The text with blanks in place of e-mail addresses, whose letters are no words; offsets stay. No other kind has letters."""
    pieces = F.arrays_zip(F.split(text, PATTERNS["email"], -1).alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0)).alias("value"))
    blank = F.array_join(F.transform(pieces, lambda x: F.concat(x["gap"], F.repeat(F.lit(" "), F.coalesce(F.length(x["value"]), F.lit(0))))), "")
    return F.when(F.contains(text, F.lit("@")), blank).otherwise(text)


def _words(text: Column) -> Column:
    """The distinct words of a whole text, in lower case."""
    found = F.array_distinct(F.regexp_extract_all(_words_only(text), F.lit(WORDS), F.lit(0)))
    return F.array_distinct(F.transform(found, F.lower))


def _key(text: Column) -> Column:
    """What rows with equal texts, and so with equal spans, are joined by."""
    return F.unhex(F.md5(text))


def _merged(rows: DataFrame, name: str, *same: str) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (key, ``name``, ``same`` and more) those of one name for each set of keys, and (``name``, first) for all names.

    Names that occur under just the same keys are told by two 64-bit sums over the keys and their number; ``same`` must be equal too.
    """
    sums = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"_sum{k}") for k in (1, 2)]
    signed = saved(rows.groupBy(name, *same).agg(*sums, F.count(F.lit(1)).alias("_keys")))
    kind = ["_sum1", "_sum2", "_keys", *same]
    firsts = saved(signed.groupBy(*kind).agg(F.min(name).alias("first")))
    members = saved(attach(signed, firsts, *kind, how="inner").select(name, "first"))
    return attach(rows, firsts.select(F.col("first").alias(name)), name, how="inner"), members


def _disclosing(found: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """term: the words that disclose a value, from documents (``found``: key, base; ``texts``: key, text, some) that have both.

    Rows with equal texts are counted, but weighed once with their number. Before terms meet values, those are left out that cannot
    reach the limit: pairs seen together in fewer than SUPPORT documents, and, as a pair is seen together at most df_entity times,
    terms with df_term above total ** (1 - DISCLOSED) * df_entity ** DISCLOSED. Terms that always occur together are weighed as one, and
    so are values, so that long lists that several documents share do not meet word by value.
    """
    entity = lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))
    held = found.filter(F.size("base") > 0).select("key", F.explode(F.array_distinct(F.transform("base", entity))).alias("entity"))
    held = saved(held.groupBy("key", "entity").agg(F.count(F.lit(1)).alias("copies")))
    entities = held.groupBy("entity").agg(F.sum("copies").alias("df_entity"))
    entities = saved(entities.filter((F.col("df_entity") >= SUPPORT) & (F.col("df_entity") < total)))
    carried = saved(attach(held, entities, "entity", how="inner"))
    most = lambda df: F.lit(float(max(total, 1)) ** (1 - DISCLOSED) * (1 + 1e-9)) * F.pow(df, F.lit(DISCLOSED))
    top = carried.agg(F.max("df_entity")).first()[0] or 0

    words = texts.select("key", "some", F.explode(_words(F.col("text"))).alias("term"))
    terms = words.groupBy("term").agg(F.count(F.lit(1)).alias("df_term"), F.count_if("some").alias("here"))
    terms = saved(terms.filter((F.col("here") >= SUPPORT) & F.col("df_term").between(F.lit(SUPPORT), most(F.lit(float(top))))).drop("here"))
    own = saved(join_ids(words.filter("some").select("key", "term"), terms, "term", "inner", BROADCAST_TERMS).distinct())
    own, alike = _merged(own, "term", "df_term")
    carried, _ = _merged(carried, "entity")
    both = own.join(carried, "key").filter(F.col("df_term") <= most(F.col("df_entity")))
    known = both.groupBy("term", "entity", "df_term", "df_entity").agg(F.sum("copies").alias("both")).filter(F.col("both") >= SUPPORT)
    information = F.log2(F.lit(float(max(total, 1))) / F.col("df_entity"))
    mutual = F.log2(F.lit(float(max(total, 1))) * F.col("both") / (F.col("df_term") * F.col("df_entity")))
    first = saved(known.filter(mutual >= DISCLOSED * information).select(F.col("term").alias("first")).distinct())
    return saved(attach(alike, first, "first", how="inner").select("term"))


def _marked(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, terms): every occurrence of a disclosing term in every whole text, once for rows with equal texts."""
    words = texts.select("key", F.explode(_words(F.col("text"))).alias("term"))
    hits = saved(join_ids(words, terms, "term", "left_semi", BROADCAST_TERMS).distinct())
    own = join_ids(texts.select("key", "text"), saved(hits.select("key").distinct()), "key", "left_semi")
    placed = own.select("key", F.explode(_placed(_words_only(F.col("text")), WORDS)).alias("w"))
    placed = placed.select("key", F.lower("w.value").alias("term"), "w.start", "w.end")
    spans = join_ids(placed, terms, "term", "left_semi", BROADCAST_TERMS)
    span = F.struct(F.lit("term").alias("kind"), "start", "end", F.col("term").alias("value"))
    return saved(spans.groupBy("key").agg(F.sort_array(F.collect_set(span)).alias("terms")))


def _with_terms(rows: DataFrame, docs: DataFrame, base: DataFrame) -> DataFrame:
    """``rows`` (key, base) of ``docs`` with terms; ``base`` is the materialised (key, base). No text is written or shuffled for the terms."""
    text = F.coalesce("text", F.lit(""))
    some = F.exists(base_spans(text), lambda _: F.lit(True))
    texts = docs.select(_key(text).alias("key"), text.alias("text"), some.alias("some"))
    terms = _marked(texts, _disclosing(base, texts, base.count()))
    return attach(rows, terms, "key").withColumn("terms", F.coalesce("terms", _no_spans())).drop("key")


def _keyed(docs: DataFrame, *kept: Column) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(*kept, _key(text).alias("key"), base_spans(text).alias("base"))


def find_spans(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, base and terms, arrays of struct<kind, start, end, value>.

    A null text is empty. Terms are all occurrences, in every document, of words that disclose a value that the corpus holds. A word in
    several cases is one term, its spans stay apart; no two spans of a kind overlap. Repeated rows count as documents of their own.
    A very long text is one row like others: its spans take time that grows with the 1.5th power of their number. Extra columns
    are ignored; an empty table gives an empty result.
    """
    base = saved(_keyed(docs, F.col("doc_id")))
    return _with_terms(base, docs, base)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """``find_spans`` as counts, the digest of the base spans and the text of all spans."""
    found = find_spans(docs)

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(span_text(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *map(number, KINDS), digest, span_text(F.concat("base", "terms")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans replaced by [KIND] and disclosing terms generalised to [TERM].

    Of spans that overlap, the one that starts first, or else the base span, is replaced.
    """
    placed = lambda s: F.struct(s["start"].alias("start"), (s["kind"] == "term").alias("late"), s["end"].alias("end"), s["kind"].alias("kind"))
    rows = _with_terms(_keyed(docs, F.struct(*docs.columns).alias("doc")), docs, saved(_keyed(docs)))
    rows = rows.select("doc", F.sort_array(F.transform(F.concat("base", "terms"), placed)).alias("spans"))
    text = F.coalesce("doc.text", F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), more.alias("out"))).otherwise(acc)

    clean = let(F.aggregate("spans", start, step), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    clean = F.when(F.size("spans") > 0, clean).otherwise(F.col("doc.text"))
    return rows.select(*[(clean if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns])
