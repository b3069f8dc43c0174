import hashlib

from probatum.operators.chain import ZERO
from probatum.streaming.ledgers import chain_faults, changed_states, windowed_counts


def run(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_chain_stream(spark, tmp_path):
    rows, last = [], ZERO
    for n in range(6):
        raw = f"line {n}"
        rows.append(("l", n, raw, "f" * 64 if n == 4 else last))
        last = hashlib.sha256(raw.encode()).hexdigest()
    schema = "ledger string, n long, raw string, prev_hash string"
    for i in range(2):
        spark.createDataFrame(rows[i * 3 : i * 3 + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    assert run(chain_faults(stream), spark, "faults") == [("l", 4, "edited")]


def test_changes_and_windows(spark, tmp_path):
    events = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, None), ("b", 2, "z")]
    schema = "identity string, at long, value string"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    got = run(changed_states(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))), spark, "changed")
    assert sorted(got) == [("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")]
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 'k' kind UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'k' UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'k'").coalesce(1).write.parquet(str(tmp_path / "w"))
    counts = windowed_counts(spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "w")), "ts", "kind")
    assert sorted(r[-1] for r in run(counts, spark, "counts", "complete")) == [1, 2]
