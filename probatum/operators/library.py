"""A library of bibliographic records: one work under several names, merges, losses, tags, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.functions.folds import family_variants_udf, names_disagree_udf, similarity_udf, venue_forms_udf

# Least likeness of titles, weight of the venue, form of an arXiv id.
TITLE_LEAST = 0.87
VENUE_WEIGHT = 1.5
_ARXIV = r"(\d{4}\.\d{4,8}|[a-z-]+(?:\.[a-z]{2})?/\d{7})"


def clean_doi(doi: Column | str) -> Column:
    """The DOI in lower case without resolver, label and closing punctuation; null where it is not shaped like one."""
    c = F.col(doi) if isinstance(doi, str) else doi
    found = F.regexp_extract(F.lower(c), r"(10\.\d{4,9}/\S+)", 1)
    return F.nullif(F.regexp_replace(found, r"[.,;/)\s]+$", ""), F.lit(""))


def title_key(title: Column | str, authors: Column | str) -> Column:
    """What makes two records one work when no identifier says so: title and first author, letters and digits only."""
    t = F.col(title) if isinstance(title, str) else title
    a = F.col(authors) if isinstance(authors, str) else authors
    first = F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(""))
    return F.regexp_replace(F.lower(F.concat(F.coalesce(t, F.lit("")), first)), r"[^a-z0-9]+", "")


def slug(doi: Column, arxiv: Column, title: Column, authors: Column) -> Column:
    """A stable name: DOI (an arXiv DOI as arXiv id), else arXiv id, else a digest of title and first author."""
    d = F.lower(F.trim(F.coalesce(doi, F.lit(""))))
    x = F.trim(F.coalesce(arxiv, F.lit("")))
    return (
        F.when(d.startswith("10.48550/arxiv."), F.concat(F.lit("arxiv-"), F.replace(F.substring_index(d, "arxiv.", -1), F.lit("."), F.lit("-"))))
        .when(d != "", F.concat(F.lit("doi-"), F.regexp_replace(F.regexp_replace(d, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")))
        .when(x != "", F.concat(F.lit("arxiv-"), F.replace(x, F.lit("."), F.lit("-"))))
        .otherwise(F.concat(F.lit("t-"), F.substring(F.sha2(title_key(title, authors), 256), 1, 16)))
    )


def arxiv_of(text: Column | str) -> Column:
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    by_url = F.regexp_extract(c, rf"arxiv\.org/(?:abs|pdf)/{_ARXIV}", 1)
    return F.nullif(F.when(by_url != "", by_url).otherwise(F.regexp_extract(c, rf"arxiv[:\s]+{_ARXIV}", 1)), F.lit(""))


def same_work(records: DataFrame, key: Column, name: str) -> DataFrame:
    """Names of records that share a key, where it has two or more: (work_key, n_records, n_names, first_name)."""
    named = records.withColumn("work_key", key).filter("work_key <> ''")
    return named.groupBy("work_key").agg(
        F.count("*").alias("n_records"), F.countDistinct(name).alias("n_names"), F.min(name).alias("first_name")
    ).filter("n_names > 1")


def fill_gaps(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """new with columns that are null or empty taken from old; maps are merged, new entries first. Every row of new stays once."""
    once = old.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(f"_{c}") for c in columns])
    joined = new.join(once, key, "left")
    out = {}
    for c in columns:
        kind = dict(new.dtypes)[c]
        if kind.startswith("map"):
            out[c] = F.map_concat(F.map_filter(F.coalesce(f"_{c}", F.create_map().cast(kind)), lambda k, v: ~F.map_contains_key(F.coalesce(c, F.create_map().cast(kind)), k)), F.coalesce(c, F.create_map().cast(kind)))  # noqa: B023
        elif kind == "string":
            out[c] = F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.coalesce(f"_{c}", c)).otherwise(F.col(c))
        else:
            out[c] = F.coalesce(c, f"_{c}")
    return joined.withColumns(out).drop(*[f"_{c}" for c in columns])


def losses(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What a rebuild would lose: (key, field) with field 'record' where the whole record goes."""
    has = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    n = new.groupBy(key).agg(*[F.bool_or(has(c)).alias(f"n_{c}") for c in columns], F.lit(True).alias("n_there"))
    o = old.groupBy(key).agg(*[F.bool_or(has(c)).alias(f"o_{c}") for c in columns])
    j = o.join(n, key, "left")
    gone = F.when(F.col("n_there").isNull(), F.array(F.lit("record"))).otherwise(
        F.array_compact(F.array(*[F.when(F.col(f"o_{c}") & ~F.col(f"n_{c}"), F.lit(c)) for c in columns]))
    )
    return j.select(key, F.explode(gone).alias("field"))


def roll_up(items: DataFrame, path: str, item: str, separator: str = "/") -> DataFrame:
    """Distinct items under every prefix of a path: (prefix, n_items)."""
    parts = F.split(path, separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    pairs = items.filter(F.col(path).isNotNull()).select(F.explode(prefixes).alias("prefix"), F.col(item).alias("item")).distinct()
    return pairs.groupBy("prefix").agg(F.count("*").alias("n_items"))


def effective_tags(records: DataFrame, project_tags: DataFrame) -> DataFrame:
    """Own tags and those of the citing projects: (slug, tag); records(slug, tags array, projects array)."""
    own = records.select("slug", F.explode("tags").alias("tag"))
    inherited = records.select("slug", F.explode("projects").alias("project")).join(project_tags, "project").select("slug", "tag")
    return own.union(inherited).distinct()


def compare_fields(entries: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """entries beside the registry's record of the same key: (entry_id, key, differs array of field names).

    An entry without a registry record has differs null: could not be checked.
    """
    norm = lambda c: F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]*>|[{}]", "")), r"[^a-z0-9]+", "")
    r = registry.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by("title", "registry_id").alias("_t"), F.min_by("year", "registry_id").alias("_y"), F.min_by(F.size("authors"), "registry_id").alias("_n")
    )
    j = entries.join(r, key, "left")
    there = lambda a, b: (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    differs = F.array_compact(
        F.array(
            F.when(there(F.col("title"), F.col("_t")) & (norm(F.col("title")) != norm(F.col("_t"))), F.lit("title")),
            F.when(there(F.col("year"), F.col("_y")) & (F.trim("year") != F.trim("_y")), F.lit("year")),
            F.when((F.size("authors") > 0) & (F.col("_n") > 0) & (F.size("authors") != F.col("_n")), F.lit("authors")),
        )
    )
    found = F.col("_t").isNotNull() | F.col("_y").isNotNull() | F.col("_n").isNotNull()
    return j.select("entry_id", key, F.when(found, differs).alias("differs"))


def author_positions(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, ours, theirs) of author lists, name against name: (pair_id, position, ours, theirs, problem).

    problem: surname, given, dropped (theirs has no such place) or extra; places that agree give no row.
    """
    at = F.sequence(F.lit(1), F.greatest(F.size("ours"), F.size("theirs"), F.lit(1)))
    each = pairs.select("pair_id", "ours", "theirs", F.explode(at).alias("position"))
    each = each.select("pair_id", "position", F.try_element_at("ours", F.col("position")).alias("ours"), F.try_element_at("theirs", F.col("position")).alias("theirs"))
    problem = (
        F.when(F.col("ours").isNull() & F.col("theirs").isNotNull(), "dropped")
        .when(F.col("theirs").isNull() & F.col("ours").isNotNull(), "extra")
        .otherwise(names_disagree_udf("ours", "theirs"))
    )
    return each.withColumn("problem", problem).filter("problem is not null")


def best_candidate(records: DataFrame, corpus: DataFrame) -> DataFrame:
    """The corpus record most like each record that passes every guard: (record_id, candidate_id, score).

    Blocked on the first author's family name in any spelling and on the year: a common family name meets
    only works of adjacent years. An unknown year disagrees with none, so where either side has none a word of
    the title stands for it, which keeps a common name from meeting everything. Titles must be at least TITLE_LEAST alike; the venue ranks versions of
    a work. A record without author matches nothing.
    """
    def spread(df: DataFrame, key: str) -> DataFrame:
        return df.select(
            F.col(key).alias("id"), "title", "venue", F.col("year").try_cast("int").alias("y"),
            F.explode(family_variants_udf(F.try_element_at("authors", F.lit(1)))).alias("family"),
        )

    r = spread(records, "record_id").withColumn("near", F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)))
    c = spread(corpus, "candidate_id").select(F.col("id").alias("cid"), F.col("title").alias("ct"), F.col("venue").alias("cv"), F.col("y").alias("near"), "family")
    dated = r.join(c, ["family", "near"])
    # Every word of a title, so that no pair with one in common is lost.
    words = lambda t: F.explode(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 3))).alias("word")
    known = lambda df: df.filter("y is not null")
    one = spread(records, "record_id")
    two = spread(corpus, "candidate_id").select(F.col("id").alias("cid"), F.col("title").alias("ct"), F.col("venue").alias("cv"), "y", "family")
    undated = one.filter("y is null").select("*", words("title")).join(two.select("cid", "ct", "cv", "family", words("ct")), ["family", "word"]).unionByName(
        known(one).select("*", words("title")).join(two.filter("y is null").select("cid", "ct", "cv", "family", words("ct")), ["family", "word"])
    )
    columns = ["id", "title", "venue", "cid", "ct", "cv"]
    met = dated.select(*columns).unionByName(undated.select(*columns)).dropDuplicates(["id", "cid"])
    t = similarity_udf("title", "ct")
    scored = met.withColumn("t", t).filter(F.col("t") >= TITLE_LEAST)
    v = F.when((F.coalesce("venue", F.lit("")) != "") & (F.coalesce("cv", F.lit("")) != ""), similarity_udf("venue", "cv")).otherwise(0.0)
    scored = scored.withColumn("score", F.round(F.col("t") + VENUE_WEIGHT * v, 9))
    return scored.groupBy(F.col("id").alias("record_id")).agg(F.max_by("cid", F.struct("score", -F.col("cid"))).alias("candidate_id"), F.max("score").alias("score"))


def venue_verdict(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, ours, theirs, our_ids, their_ids): match, mismatch or not_comparable, with the reason.

    Ids are 'kind:value'. A shared id or folded name makes a match; a mismatch needs ids of one serial kind on
    both sides and none in common; a workshop is never held against its conference.
    """
    workshop = lambda c: F.coalesce(F.lower(c).rlike(r"\bworkshops?\b"), F.lit(False))
    kinds = lambda c: F.array_intersect(F.transform(c, lambda x: F.substring_index(x, ":", 1)), F.array(F.lit("issn"), F.lit("nlm"), F.lit("dblp")))
    p = pairs.withColumns({"_fo": venue_forms_udf("ours"), "_ft": venue_forms_udf("theirs")})
    reason = (
        F.when(F.coalesce(F.trim("ours"), F.lit("")) == "", "no_entry_venue")
        .when(workshop(F.col("ours")) != workshop(F.col("theirs")), "workshop")
        .when(F.arrays_overlap("our_ids", "their_ids"), "shared_identifier")
        .when(F.arrays_overlap("_fo", "_ft"), "one_name")
        .when(F.size("their_ids") <= 0, "no_record_venue")
        .when(~F.arrays_overlap(kinds(F.col("our_ids")), kinds(F.col("their_ids"))), "no_common_kind")
        .otherwise("no_identifier_in_common")
    )
    verdict = F.when(F.col("reason").isin("shared_identifier", "one_name"), "match").when(F.col("reason") == "no_identifier_in_common", "mismatch").otherwise("not_comparable")
    return p.withColumn("reason", reason).withColumn("verdict", verdict).drop("_fo", "_ft")
