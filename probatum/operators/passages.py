"""Quotations in texts, set at a time: candidates by word shingles, then the exact rule.

Texts and quotations are folded once. A quotation's rarest part is not sought by scanning: its first words
form a key that is joined with the keys of the texts' words, within the source they both name. Shorter quotations
use two words, or one. Only what is not found verbatim is compared without blanks, and
only with the texts of its page (or, where no page is named, of its source).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.functions.folds import divergence_udf, folded, omission_udf, resolve_udf
from probatum.session import checkpointed, spread

#: Words in a key; a quotation with no more words than that uses two, or one.
KEY_WORDS = 5


def _keys(words, n: int):
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " "))))


def candidates(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, text_id): texts of a quotation's source that hold its first words in a row.

    quotes(quote_id, source, quote), texts(text_id, source, text). A quotation that begins inside a word of
    the text is sought by its second to fourth word as well.
    """
    words = lambda c: F.split(F.trim(F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", " ")), " ")
    # Written down, so that the keys below read the words and do not fold the text anew for each.
    q = checkpointed(spread(quotes).select("quote_id", "source", words("quote").alias("_w")))
    t = checkpointed(spread(texts).select("text_id", "source", words("text").alias("_w")))
    long = q.filter(F.size("_w") > KEY_WORDS)
    wanted = long.select(
        "quote_id", "source", F.explode(F.array(*[F.xxhash64(F.array_join(F.slice("_w", i, KEY_WORDS), " ")) for i in (1, 2)])).alias("_key")
    ).unionByName(
        q.filter(F.size("_w") <= KEY_WORDS).select("quote_id", "source", F.xxhash64(F.array_join(F.slice("_w", 1, 2), " ")).alias("_key"))
    )
    needed = wanted.select("source", "_key").distinct()
    held = t.select("text_id", "source", F.explode(F.array_union(F.array_union(_keys(F.col("_w"), KEY_WORDS), _keys(F.col("_w"), 2)), _keys(F.col("_w"), 1))).alias("_key"))
    met = held.join(needed, ["source", "_key"], "left_semi").join(wanted, ["source", "_key"])
    return met.select("quote_id", "text_id").distinct()


def quote_states(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quotes with state, n_texts that hold it, normalized and the least text that does.

    found where every text that holds it does so once; ambiguous where one holds it more often; not found.
    quotes may name a page; then texts of other pages make it wrong_page.
    """
    met = spread(checkpointed(candidates(quotes, texts))).join(quotes.select("quote_id", "quote", F.col("page").alias("_page")), "quote_id").join(texts.select("text_id", "text", "page"), "text_id")
    found = met.withColumn("r", resolve_udf("quote", "text")).filter("r.n > 0")
    return _summed(quotes, found)


def _summed(quotes: DataFrame, found: DataFrame) -> DataFrame:
    on_page = F.col("_page").isNull() | (F.col("_page") == F.col("page"))
    best = found.groupBy("quote_id").agg(
        F.count("*").alias("n_texts"),
        F.bool_or(F.col("r.state") == "ambiguous").alias("_many"),
        F.bool_and("r.normalized").alias("normalized"),
        F.bool_or(on_page).alias("_on_page"),
        F.min("text_id").alias("first_text"),
    )
    state = (
        F.when(F.col("n_texts").isNull(), "not found").when(~F.col("_on_page"), "wrong_page").when(F.col("_many"), "ambiguous").otherwise("found")
    )
    return quotes.join(best, "quote_id", "left").select(
        "quote_id", "source", state.alias("state"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("normalized", F.lit(False)).alias("normalized"), "first_text"
    )


def explain_missing(states: DataFrame, quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """For quotations not found: the text of their page that keeps most of them, how far, and what was left out.

    (quote_id, text_id, matched, quoted, found, gaps)."""
    missing = checkpointed(states.filter("state = 'not found'").select("quote_id").join(quotes, "quote_id"))
    t = texts.select("text_id", F.col("source").alias("_s"), F.col("page").alias("_p"), "text")
    met = missing.join(t, (F.col("source") == F.col("_s")) & (F.col("page") == F.col("_p")))
    each = met.withColumn("d", divergence_udf("quote", "text"))
    best = each.groupBy("quote_id").agg(F.max_by(F.struct("text_id", "quote", "text", "d"), F.struct("d.matched", "text_id")).alias("b")).select("quote_id", "b.*")
    return best.select("quote_id", "text_id", "d.matched", "d.quoted", "d.found", omission_udf("quote", "text").alias("gaps"))


def covered_by(fragments: DataFrame, spans: DataFrame, least: int = 12) -> DataFrame:
    """Quotations of a manuscript covered by a pinned passage: (quotation_id, finding, span_id).

    fragments(quotation_id, source, n, fragment), parts of a quotation around its ellipses; spans(span_id,
    source, span). All fragments must stand in one span; fragments under least characters decide nothing alone.
    """
    f = fragments.withColumn("_f", folded("fragment")).filter(F.col("_f") != "")
    s = spans.select("span_id", F.col("source").alias("_s"), folded("span").alias("_span"))
    whole = f.groupBy("quotation_id", "source").agg(F.collect_list("_f").alias("_fs"), F.max(F.length("_f")).alias("_long"))
    asked = whole.filter(F.col("_long") >= least)
    # A long fragment is sought by its words; what is short may begin and end inside words and meets the spans of its source.
    first = F.array_max(F.transform("_fs", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    asked = checkpointed(asked.withColumn("_first", first).withColumn("_sought", F.size(F.split("_first", r"[^\p{L}\p{N}]+")) > KEY_WORDS + 3))
    met = candidates(asked.filter("_sought").select(F.col("quotation_id").alias("quote_id"), "source", F.col("_first").alias("quote")), spans.select(F.col("span_id").alias("text_id"), "source", F.col("span").alias("text")))
    long = asked.join(met.select(F.col("quote_id").alias("quotation_id"), F.col("text_id").alias("span_id")), "quotation_id").join(s, "span_id")
    short = asked.filter("not _sought").join(s, F.col("source") == F.col("_s"))
    columns = ["quotation_id", "source", "_fs", "_long", "span_id", "_s", "_span"]
    joined = long.filter(F.col("source") == F.col("_s")).select(*columns).unionByName(short.select(*columns))
    fits = joined.filter(F.forall("_fs", lambda x: F.contains(F.col("_span"), x)))
    hit = fits.groupBy("quotation_id").agg(F.min("span_id").alias("span_id"))
    finding = F.when(F.col("_long") < least, "unresolvable").when(F.col("span_id").isNotNull(), "covered").otherwise("uncovered")
    return whole.join(hit, "quotation_id", "left").select("quotation_id", finding.alias("finding"), "span_id")


def inside(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str, width: int = 256) -> DataFrame:
    """points with the intervals of their keys that contain them: an equi-join on blocks of `width`, then the exact test.

    An interval enters every block it touches, so each pair meets once and no whole group is compared.
    """
    p = points.withColumn("_block", F.floor(F.col(at) / width))
    i = intervals.withColumn("_block", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.greatest(F.col(high) - 1, F.col(low)) / width))))
    return p.join(i, [*keys, "_block"]).filter((F.col(low) <= F.col(at)) & (F.col(at) < F.col(high))).drop("_block")


def triangulate(readings: DataFrame) -> DataFrame:
    """Readers' states of one passage: one state where they agree, indeterminate where they do not."""
    agreed = F.collect_set("state")
    return readings.groupBy("quote_id").agg(
        F.when(F.size(agreed) == 1, F.element_at(agreed, 1)).otherwise("indeterminate").alias("state"), F.count("*").alias("n_readers")
    )
