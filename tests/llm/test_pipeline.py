import corpus_pipeline as p
from remitgraph.plans.staging import stage

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for _, function in p.STAGES:
        seen.append(stage(function(spark, seen[-1], DATA), "test"))
    assert all(s.columns == docs.columns for s in seen[1:-1])
    counts = [s.count() for s in seen]
    letters = docs.filter("text rlike '\\\\p{L}'").count()
    assert counts[1] >= 0.95 * letters and 0 < counts[2] < counts[1] and counts[3] == counts[2]
    assert seen[3].filter("text rlike '[0-9a-f]{16}'").isEmpty()
    assert seen[2].select("doc_id").distinct().count() == counts[2]
    assert counts[5] == counts[4] and seen[5].filter("size(ids) = 0").isEmpty()


def test_near_duplicates_by_five_words(spark, docs):
    words = [f"w{i}" for i in range(42)]
    other = [*words[:20], "changed", *words[21:]]  # 35 of 43 shingles of four words in common, 33 of 43 of five
    close = [f"v{i}" for i in range(80)]
    frame = docs([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(close)), (4, " ".join([*close[:40], "changed", *close[41:]]))])
    assert sorted(r.doc_id for r in p.without_near_duplicates(spark, frame, DATA).collect()) == [1, 2, 3]


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, function in p.STAGES[:-1]:
        docs = stage(function(spark, docs, DATA), "test")
    assert docs.isEmpty()
