import hashlib
import random

from pyspark.sql import functions as F

from chronotile.llm import exact_dedup


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = [(d, (t or "").translate(low)) for d, t in rows]
    groups = {}
    for d, t in norm:
        groups.setdefault(t, []).append(d)
    return sorted((d, max(groups[t]), len(groups[t]), d == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm)


LONG = "".join(f"word{k * k % 977} and é " for k in range(9000))
ROWS = [(1, "Hello World"), (2, "hello world"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, LONG), (8, LONG.upper().replace("É", "é")), (9, LONG + "x"), (10, "x" * 20000), (11, "X" * 20000), (12, "🙂" * 5000)]


def got(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))


def test_matches_brute_force(make_docs):
    assert got(exact_dedup.exact_groups(make_docs(*ROWS))) == brute(ROWS)


def test_clashing_fingerprints_stay_exact(make_docs):
    weak = lambda c: (F.length(c) % 3).cast("long")
    assert got(exact_dedup.exact_groups(make_docs(*ROWS), fingerprint=weak)) == brute(ROWS)


def test_repeated_rows_and_null_ids(make_docs):
    out = exact_dedup.exact_groups(make_docs((1, "a"), (1, "A"), (None, "a"), (None, "b"), (None, "b"))).collect()
    by = {}
    for r in out:
        by.setdefault(r.text_sha256, []).append(r)
    assert sorted((len(v), sum(r.kept for r in v), {r.keep_id for r in v} == {1}) for v in by.values()) == [(2, 1, False), (3, 1, True)]


def test_chunks_follow_the_content_in_any_script(spark):
    rng = random.Random(4)
    for first, last in ((0x61, 0x7B), (0x4E00, 0x9FA5), (0x430, 0x450), (0xAC00, 0xD7A3)):
        words = ["".join(chr(rng.randrange(first, last)) for _ in range(rng.randrange(2, 8))) for _ in range(900)]
        text = (" " if first < 0x4E00 else "").join(words * 8)
        rows = spark.createDataFrame([(text,), ("zz" + text,)], "text string").select(exact_dedup._chunks(F.col("text")).alias("c")).collect()
        a, b = (r.c for r in rows)
        assert "".join(a) == text and len(set(a) & set(b)) >= 0.5 * len(set(a))


def test_empty_table(make_docs):
    assert exact_dedup.exact_groups(make_docs().limit(0)).count() == 0


def test_drop_copies_keeps_columns(make_docs):
    docs = make_docs(*ROWS)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(ROWS) if r[3])


def test_drop_copies_of_repeated_rows_and_null_ids(make_docs):
    docs = make_docs((5, "x"), (5, "X"), (3, "x"), (7, "y"), (7, "y"), (7, "z"), (None, "x"), (None, "n"), (None, "n"), (None, "y"))
    kept = exact_dedup.drop_copies(docs).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept) == [("5", "x"), ("7", "y"), ("7", "z"), ("None", "n")]
