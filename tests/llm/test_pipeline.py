import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from logveil.llm import byte_bpe, line_quality
from logveil.llm.common import bucket
from test_operators import RANKS, brute_best, brute_near, split_words


def five(text):
    words = split_words(text)
    return set(zip(*[words[i:] for i in range(5)], strict=False))


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text or "" for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "decontamination", "tokens"]
    (_, quality), (_, exact), (_, near), (_, leaks), (_, tokens) = corpus_pipeline.STAGES

    out = quality(spark, docs, small)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    score = {r.doc_id: r.score for r in line_quality.judged(docs, labels.where(bucket("doc_id", 4) != 2)).collect()}
    assert out.columns == columns and {r.doc_id for r in out.collect()} == {k for k in kept if score[k] >= 0.7}
    kept = {r.doc_id: r.text or "" for r in out.collect()}

    out = exact(spark, out, small)
    largest = {}
    for k in sorted(kept):
        largest[hashlib.sha256(kept[k].encode()).digest()] = k
    assert out.columns == columns and {r.doc_id for r in out.collect()} == set(largest.values())
    kept = {k: kept[k] for k in largest.values()}

    out = near(spark, out, small)
    assert out.columns == columns and {r.doc_id for r in out.collect()} == {k for k, (_, c) in brute_near(kept, 80).items() if c == k}
    kept = {r.doc_id: r.text or "" for r in out.collect()}

    out = leaks(spark, out, small)
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = {r.doc_id for r in out.collect()}
    runs = set().union(*(five(i) for i in items))
    assert out.columns == columns and left == {k for k, t in kept.items() if not (five(t) & runs and brute_best(t, list(enumerate(items))))}

    ids = byte_bpe.coder(RANKS)
    got = {r.doc_id: r.ids for r in tokens(spark, out, small).collect()}
    assert got == {k: ids.encode(kept[k]) for k in left}
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).collect()} == left


def test_empty_documents(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0


def test_nulls_and_repeated_rows(spark, small, tmp_path):
    """Every stage on nulls, repeats, ids with two texts, and a very long text: the rows that stay, one by one."""
    item = " ".join(f"item{k}" for k in range(20))
    long = " ".join(f"long{k}" for k in range(60_000))
    prose = "Some ordinary prose of more than five words stands on this line and says nothing."
    rows = [
        (1, None), (2, ""), (2, ""), (3, prose), (3, prose), (3, "another text under the same id, of its own words entirely"),
        (None, "no id but a text of its own that nothing else resembles"), (None, "x " + item), (4, "y " + item), (5, long), (6, long + " more"), (None, prose),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars", "'clash' as id", "'clash' as row")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{small}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    (_, quality), (_, exact), (_, near), (_, leaks), (_, tokens) = corpus_pipeline.STAGES

    assert quality(spark, docs, str(tmp_path)).count() == 0  # nothing was learnt
    learnt = line_quality.fit(spark.read.parquet(f"{small}/documents.parquet"), labels.where(bucket("doc_id", 4) != 2))
    score = {r.k: r.score for r in line_quality.score_documents(spark.createDataFrame(list(enumerate(t for _, t in rows)), "k long, text string"), learnt, id_col="k").collect()}

    def left(df):
        return sorted(((r.doc_id or -1), r.text or "") for r in df.collect())

    assert left(quality(spark, docs, small)) == sorted((d or -1, t or "") for k, (d, t) in enumerate(rows) if score[k] >= 0.7)
    out = exact(spark, docs, small)
    unique = [(2, ""), (3, prose), (3, rows[5][1]), (-1, rows[6][1]), (-1, "x " + item), (4, "y " + item), (5, long), (6, long + " more")]
    assert out.columns == docs.columns and left(out) == sorted(unique)
    out = near(spark, out, small)
    assert left(out) == sorted(r for r in unique if r not in ((6, long + " more"), (-1, "x " + item)))
    out = leaks(spark, out, str(tmp_path))
    assert left(out) == sorted([(2, ""), (3, prose), (3, rows[5][1]), (-1, rows[6][1]), (5, long)])
    ids = byte_bpe.coder(RANKS)
    assert sorted((r.doc_id or -1, r.ids) for r in tokens(spark, out, small).collect()) == sorted((d, ids.encode(t)) for d, t in left(out))
    spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    assert leaks(spark, docs, str(tmp_path)).count() == len(rows)
