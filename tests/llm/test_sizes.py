import random

import pytest
from pyspark.sql import functions as F

from probatum.llm.mixing import expected_moment, mix, schedule, shares
from probatum.llm.packing import pack, plan
from probatum.llm.tokens import count_tokens, tokenizer_path


def plain_best_fit(sizes, capacity):
    """One item at a time into the fullest container that takes it."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = min((i for i, r in enumerate(rooms) if r >= s), key=lambda i: rooms[i], default=None)
        if fit is None:
            rooms.append(capacity - s)
        else:
            rooms[fit] -= s
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_matches_plain_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 100), rng.randint(1, 12), 7, 50]) for _ in range(rng.choice([1, 30, 700]))]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    slots, totals = plan(histogram, [100])
    assert totals["containers"] == plain_best_fit(sizes, 100)
    load = {}
    for s, n in histogram.items():
        for rank in range(n):
            row = [r for r in slots[s] if r[0] <= rank][-1]
            c = row[1] + (rank - row[0]) // row[2]
            load[c] = load.get(c, 0) + s
    assert max(load.values()) <= 100 and set(load) == set(range(totals["containers"]))


def test_several_capacities_cost_no_more_than_one():
    rng = random.Random(1)
    histogram = {rng.randint(1, 1000): rng.randint(1, 9) for _ in range(200)}
    joint = plan(histogram, [100, 300, 1000])[1]["cost"]
    assert sum(s * n for s, n in histogram.items()) <= joint <= plan(histogram, [1000])[1]["cost"]


def test_pack(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice([0, 3, 40, 99, 100, 101, 250, 1200]), "clash") for i in range(300)] + [(7, 40, "again")]
    df = spark.createDataFrame(docs, "doc_id long, tokens int, size string").select("doc_id", "tokens")
    specs = {1: [100], 2: [1000], 3: [50, 100, 1000]}
    rows = pack(df, specs).collect()
    for p, caps in specs.items():
        mine = [r for r in rows if r["pack_id"] == p]
        load, caps_seen, got = {}, {}, {}
        for r in mine:
            key = r["container_id"]
            load[key] = load.get(key, 0) + r["tokens"]
            caps_seen.setdefault(key, set()).add(r["capacity_tokens"])
            got.setdefault(r["doc_id"], []).append(r)
        assert all(len(c) == 1 and load[k] <= min(c) and min(c) in caps for k, c in caps_seen.items())
        assert sum(load.values()) == sum(d[1] for d in docs) and set(got) == {d[0] for d in docs}
        for i, tokens, _ in docs[8:300]:
            assert sum(r["tokens"] for r in got[i]) == tokens
            assert len(got[i]) == (1 if tokens <= max(caps) else -(-tokens // max(caps)))
    assert pack(df.limit(0), specs).count() == 0


def test_tokens():
    path = tokenizer_path()
    assert count_tokens(None, path) == count_tokens("", path) == 0
    assert count_tokens("<|endoftext|>", path) > 1
    long = ("some words of a very long text, 12345 numbers\n\n" * 9000) + "x" * 300_000
    import probatum.llm.tokens as t

    assert abs(count_tokens(long, path) - len(t._encoding(path).encode_ordinary(long[:200_000])) - len(t._encoding(path).encode_ordinary(long[200_000:]))) < 5


def test_mix(spark):
    docs = [(i, "a", 100) for i in range(200)] + [(1000 + i, "b", 10) for i in range(40)] + [(2000, "c", 5), (2001, None, 7), (2002, "b", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.2, 4), ("none", 0.2, 9)], "source string, target_share double, max_repeat int")
    mixed = mix(df, targets)
    rows = {r["doc_id"]: r for r in mixed.collect()}
    assert len(rows) == len(docs) and rows[2000]["uses"] == rows[2001]["uses"] == 0
    assert {r["uses"] for r in rows.values() if r["source"] == "b" and r["tokens"]} == {4}
    assert sum(r["uses"] for r in rows.values() if r["source"] == "a") == 48
    reached = {r["source"]: r["reached_share"] for r in shares(mixed, targets).collect()}
    assert reached == {"a": 0.75, "b": 0.25, "none": 0.0}
    order = schedule(mixed).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order) and 0 <= order[0]["position"] and order[-1]["position"] <= 1
    early = sum(r["tokens"] for r in order if r["source"] == "b" and r["position"] < 0.5)
    assert early < 0.5 * 1600  # weights rise for what is repeated more
    assert abs(expected_moment(0.25, 0.5) + 0.5 * (expected_moment(0.25, 0.5) ** 2 - expected_moment(0.25, 0.5)) - 0.25) < 1e-9
    assert all(r["tokens_unused"] == r["tokens_there"] * r["max_repeat"] - r["tokens_used"] >= 0 for r in shares(mixed, targets).collect())
    capped = {r["source"]: r for r in shares(mix(df, targets, total=1e6), targets).collect()}
    assert capped["a"]["most_uses"] == 1 and capped["b"]["most_uses"] == 4 and capped["a"]["tokens_used"] == 20000
    assert mix(df.limit(0), targets).count() == 0
