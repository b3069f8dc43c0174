from pyspark.sql import functions as F

from probatum.operators.ranking import numbered


def test_numbers_match_brute_force(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i * 7 % 101, i) for i in range(600)] + [(None, 1, 900), (None, 2, 901)]
    df = spark.createDataFrame(rows, "k string, v int, i long").repartition(7)
    got = {r["i"]: (r["rank"], r["before"]) for r in numbered(numbered(df, ["k"], ["v", "i"]), ["k"], ["v", "i"], "before", "v").collect()}
    for k in {r[0] for r in rows}:
        before = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))):
            assert got[r[2]] == (n, before)
            before += r[1]


def test_whole_table_and_empty(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 3)
    assert sorted(r["rank"] for r in numbered(df, [], ["x", "id"]).collect()) == list(range(1000))
    assert numbered(df.limit(0), ["x"], ["id"]).count() == 0
