"""Search helpers: printed against stored numbers, index-like columns, pages of keys, digests of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.functions.exact import is_number, key_of, printed_places, roundings, written
from probatum.functions.folds import folded
from probatum.operators.chain import with_previous
from probatum.operators.ranking import numbered


def bindings(printed: DataFrame, stored: DataFrame) -> DataFrame:
    """Printed numbers a stored value rounds to, either way at a tie, also as a percentage: (printed, value_id, conversion).

    printed(printed string), stored(value_id, value), value a number or its text, both of any number of digits. Instead of
    comparing all with all, a stored value is rounded to those places that are printed and are fewer than its own, and
    joined on (places, number); printed with as many places as it has or more, a number must be the value itself.
    What is collected is the different counts of places, at most one for each digit of the longest number printed.
    """
    p = printed.select(F.trim("printed").alias("printed")).filter(is_number("printed")).distinct().select("printed", printed_places("printed").alias("_places"), key_of("printed").alias("_key"))
    used = sorted(r["_places"] for r in p.select("_places").distinct().collect())
    every = F.array(*[F.lit(k) for k in used]) if used else F.array().cast("array<int>")
    v = stored.select("value_id", F.col("value").cast("string").alias("_v")).filter(is_number("_v"))
    v = v.withColumn("_c", F.explode(F.array(F.struct(F.lit("none").alias("conversion"), F.lit(0).alias("shift")), F.struct(F.lit("percent").alias("conversion"), F.lit(2).alias("shift"))))).select("value_id", "_v", "_c.*")
    v = v.withColumns({"_own": written("_v", F.col("shift"))["places"].cast("int"), "_key": key_of("_v", F.col("shift"))})
    fewer = v.withColumn("_places", F.explode(F.filter(every, lambda k: k < F.col("_own"))))
    fewer = fewer.withColumn("_key", F.explode(roundings("_v", F.col("_places"), F.col("shift"))))
    met = fewer.join(p, ["_places", "_key"]).select("printed", "value_id", "conversion")
    same = v.join(p, "_key").filter("_places >= _own").select("printed", "value_id", "conversion")
    return met.unionByName(same).distinct()


def index_like(rows: DataFrame, order: list[str], column: str, least_rows: int = 10, least_share: float = 0.75) -> DataFrame:
    """One row: whether a column counts in even steps, with resets: (column, n_rows, step, step_share, index_like)."""
    ranked = numbered(rows.select(*order, *({column} - set(order))).filter(F.col(column).isNotNull()), [], order, "_n")
    steps = with_previous(ranked, [], "_n", {"_was": F.col(column)}).withColumn("_step", F.col(column) - F.col("_was"))
    counts = steps.groupBy("_step").agg(F.count("*").alias("_c"))
    total = F.sum("_c")
    known = F.col("_step").isNotNull() & (F.col("_step") != 0)
    best = F.max(F.when(known, F.struct(F.col("_c"), -F.col("_step"))))
    out = counts.agg(total.alias("n_rows"), (-best["col2"]).alias("step"), (best["_c"] / F.greatest(total - 1, F.lit(1))).alias("share"))
    return out.select(
        F.lit(column).alias("column_name"), "n_rows", "step", F.round("share", 6).alias("step_share"),
        ((F.col("n_rows") >= least_rows) & F.coalesce(F.col("share") >= least_share, F.lit(False))).alias("index_like"),
    )


def page_after(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next page in key order: the one use of a limit here, which is the feature."""
    return rows.filter(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def shallowest(paths: DataFrame, group: str, path: str) -> DataFrame:
    """Paths at the least depth of their group."""
    deep = paths.withColumn("depth", F.size(F.split(path, "/")) - 1)
    least = deep.groupBy(group).agg(F.min("depth").alias("depth"))
    return deep.join(least, [group, "depth"], "left_semi")


def first_appearances(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Each value of a group once, where it first appears."""
    return rows.groupBy(*keys, value).agg(F.min(order).alias(order))


def tree_digests(files: DataFrame, tree: str, path: str, sha256: str, blocks: int = 256) -> DataFrame:
    """A digest of each tree from its files' paths and digests, two levels deep so that no tree is one group.

    Files fall into blocks by a digest of their path; a block's digest is that of its sorted lines, the
    tree's that of its sorted blocks.
    """
    line = F.concat(F.length(path), F.lit(":"), F.col(path), F.coalesce(F.col(sha256), F.lit("-")))
    block = F.conv(F.substring(F.sha2(F.col(path), 256), 1, 4), 16, 10).cast("int") % blocks
    per_block = files.groupBy(tree, block.alias("_b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("_d"), F.count("*").alias("_n"))
    return per_block.groupBy(tree).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_d")), ""), 256).alias("digest"), F.sum("_n").alias("n_files"))


def missing_extractions(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What has to be extracted yet: keys wanted that the cache does not hold."""
    return wanted.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")


def collapsed(candidates: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first candidate of each group by order, with how many it stands for; candidates of a group meet as partial minima."""
    rest = [c for c in candidates.columns if c not in keys]
    return candidates.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"), F.count("*").alias("n_candidates")).select(*keys, "_b.*", "n_candidates")


def guarded_best(candidates: DataFrame, key: str, passes: str, value: str) -> DataFrame:
    """The one value of a key's candidates that pass their guards: (key, value, reason); null with a reason where none or several do."""
    each = candidates.groupBy(key).agg(
        F.countDistinct(F.when(F.col(passes), F.col(value))).alias("_n"), F.min(F.when(F.col(passes), F.col(value))).alias("_v"), F.count("*").alias("_all")
    )
    reason = F.when(F.col("_n") == 1, "unique").when(F.col("_n") > 1, "several pass").otherwise("none passes")
    return each.select(key, F.when(F.col("_n") == 1, F.col("_v")).alias(value), reason.alias("reason"))


def most_common(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each group, the least at a tie, from counts rather than from the group."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max("n").alias("n"), F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def table_votes(claims: DataFrame, captions: DataFrame, least: int = 12) -> DataFrame:
    """Declared table numbers against the tables whose text holds the claims' passages: (text_id, declared, table_no, votes).

    claims(text_id, declared, passage), captions(text_id, table_no, caption), a text's captions being few. Passages under
    least folded characters do not vote; the table with most votes stands for a declared number, the first at a tie.
    """
    c = claims.select("text_id", "declared", folded("passage").alias("_p")).filter(F.length("_p") >= least)
    t = captions.select("text_id", "table_no", folded("caption").alias("_c"))
    votes = c.join(t, "text_id").filter(F.contains("_c", "_p")).groupBy("text_id", "declared", "table_no").agg(F.count("*").alias("votes"))
    return votes.groupBy("text_id", "declared").agg(F.min_by("table_no", F.struct(-F.col("votes"), F.col("table_no"))).alias("table_no"), F.max("votes").alias("votes"))
