"""Taking duplicates out moves the texts that are named, not those of all rows."""

from stayflow.llm import ngram_join


def _shuffled(spark) -> int:
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    none = jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_other_texts_stay(spark):
    import hashlib

    text = lambda k: " ".join(hashlib.sha256(f"{k} {j}".encode()).hexdigest()[:12] for j in range(400))
    texts = [text(k) for k in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(200, texts[3]), (7, texts[7]), (7, texts[7]), (9, texts[8]), (None, texts[5]), (300, None), (301, "")]
    df = ngram_join.written(spark.createDataFrame(rows, "doc_id long, text string"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ngram_join.keep_one(df)
        before = _shuffled(spark)
        got = out.collect()
        moved = _shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = [(k, t) for k, t in enumerate(texts)] + [(None, texts[5]), (300, None), (301, "")]
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=k, text=t)) for k, t in want)
    assert moved < 0.5 * sum(map(len, texts))
