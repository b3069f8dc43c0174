"""Queries over bibliographies: records, registry works, bib entries, citing projects, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.operators import library as lib
from probatum.operators.graph import components
from probatum.operators.survey import first_appearances, index_like, missing_extractions, page_after, shallowest, tree_digests
from probatum.session import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "bib_records").withColumn("d", lib.clean_doi("doi"))


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "works").withColumn("d", lib.clean_doi("doi"))


_DOI_SQL = "nullif(regexp_replace(regexp_extract(lower(doi), '(10\\.\\d{4,9}/\\S+)', 1), '[.,;/)\\s]+$', ''), '')"
_KEY_SQL = "regexp_replace(lower(coalesce(title, '') || coalesce(authors[1], '')), '[^a-z0-9]+', '', 'g')"


def clean_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by what is left of their DOI: none, as written, or cleaned."""
    r = _records(spark, sf_dir)
    return r.groupBy(F.when(F.col("d").isNull(), "none").when(F.col("d") == F.col("doi"), "as_written").otherwise("cleaned").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("d").alias("n_dois"))


def record_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "bib_records")
    return r.select("record_id", lib.slug(F.col("doi"), F.col("arxiv"), F.col("title"), F.col("authors")).alias("name"))


def same_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one title and first author under several slugs."""
    r = table(spark, sf_dir, "bib_records")
    return lib.same_work(r, lib.title_key("title", "authors"), "slug")


def filled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library records with empty venues and years filled from the works of their DOI."""
    old = _works(spark, sf_dir).filter("d is not null").groupBy("d").agg(F.min(F.when(F.trim("venue") != "", F.col("venue"))).alias("venue"), F.min(F.when(F.trim("year") != "", F.col("year"))).alias("year"))
    return lib.fill_gaps(_records(spark, sf_dir).select("record_id", "d", "venue", "year"), old, "d", ["venue", "year"]).select("record_id", "venue", "year")


def rebuild_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the registry's works, by DOI, hold that the library's records of the DOI do not."""
    w, r = _works(spark, sf_dir).filter("d is not null"), _records(spark, sf_dir).filter("d is not null")
    return lib.losses(r, w, "d", ["venue", "year", "arxiv", "url"]).groupBy("field").agg(F.count("*").alias("n"))


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "bib_records")
    return r.select("record_id", "slug", F.explode("cited_by").alias("project", "cite")).select("record_id", "slug", "project", F.col("cite.key").alias("cite_key"))


def project_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct records cited under every prefix of a project's path."""
    return lib.roll_up(_cited(spark, sf_dir), "project", "slug")


def inherited_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags records take from their citing projects, a project's tag being the second part of its name; counted per tag."""
    c = _cited(spark, sf_dir)
    tags = c.select("project").distinct().withColumn("tag", F.element_at(F.split("project", "-"), -1))
    records = c.groupBy("slug").agg(F.collect_set("project").alias("projects")).withColumn("tags", F.array(F.lit("library")))
    return lib.effective_tags(records, tags).groupBy("tag").agg(F.count("*").alias("n"))


def uncited_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of bib entries that no record is cited under, with how many entries bear them."""
    e = table(spark, sf_dir, "bib_entries").select("entry_id", "cite_key")
    used = _cited(spark, sf_dir).select("cite_key").distinct()
    return e.join(used, "cite_key", "left_anti").groupBy("cite_key").agg(F.count("*").alias("n"))


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys defined more than once in a file, letter case aside."""
    e = table(spark, sf_dir, "bib_entries").select("bib_file", F.lower("cite_key").alias("folded_key"), "cite_key", "entry_id")
    return e.groupBy("bib_file", "folded_key").agg(F.count("*").alias("n"), F.countDistinct("cite_key").alias("n_spellings"), F.min("entry_id").alias("first_entry")).filter("n > 1")


def entry_vs_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with a DOI beside the registry's first record of it: the fields that differ, null where there is none."""
    r = _records(spark, sf_dir).filter("d is not null").select(F.col("record_id").alias("entry_id"), "d", "title", "year", "authors")
    w = _works(spark, sf_dir).select(F.col("work_id").alias("registry_id"), "d", "title", "year", "authors")
    return lib.compare_fields(r, w, "d").select("entry_id", F.array_join("differs", ",").alias("differs"))


def author_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author lists of records and works of one DOI, place against place: problems counted by kind and place."""
    w = _works(spark, sf_dir).filter("d is not null and authors is not null").groupBy("d").agg(F.min_by("authors", "work_id").alias("theirs"))
    r = _records(spark, sf_dir).filter("d is not null and authors is not null").select(F.col("record_id").alias("pair_id"), "d", F.col("authors").alias("ours"))
    return lib.author_positions(r.join(w, "d").select("pair_id", "ours", "theirs")).groupBy("problem", "position").agg(F.count("*").alias("n"))


def fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every record, the registry work most like it that passes title, family name and year."""
    w = table(spark, sf_dir, "works").select(F.col("work_id").alias("candidate_id"), "title", "authors", "year", "venue")
    return lib.best_candidate(table(spark, sf_dir, "bib_records").select("record_id", "title", "authors", "year", "venue"), w)


def venue_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues of records and works of one DOI: verdicts and reasons, work sources standing for venue identifiers."""
    w = _works(spark, sf_dir).filter("d is not null").groupBy("d").agg(F.min_by("venue", "work_id").alias("theirs"), F.min_by("publisher", "work_id").alias("publisher"))
    r = _records(spark, sf_dir).filter("d is not null").select(F.col("record_id").alias("pair_id"), "d", F.col("venue").alias("ours"))
    none = F.array().cast("array<string>")
    p = r.join(w, "d").select("pair_id", "ours", "theirs", none.alias("our_ids"), F.when(F.col("publisher").isNotNull(), F.array(F.concat(F.lit("publisher:"), "publisher"))).otherwise(none).alias("their_ids"))
    return lib.venue_verdict(p).groupBy("verdict", "reason").agg(F.count("*").alias("n"))


def connected_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works joined by a common DOI or a common title and first author: size of the component of each."""
    w = _works(spark, sf_dir).select("work_id", "d", lib.title_key("title", "authors").alias("k"))
    star = lambda c: w.filter(F.coalesce(F.col(c), F.lit("")) != "").groupBy(c).agg(F.min("work_id").alias("b")).join(w.select("work_id", c), c).select(F.col("work_id").alias("a"), "b")
    roots = components(star("d").unionByName(star("k")))
    return roots.groupBy("root").agg(F.count("*").alias("n_works"))


def works_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "works")
    empty = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias(f"no_{c}")
    return w.groupBy("source", "kind").agg(F.count("*").alias("n"), empty("doi"), empty("year"), empty("venue"), F.count_if(F.col("authors").isNull()).alias("no_authors"))


def latest_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answer of each registry about each DOI."""
    w = _works(spark, sf_dir).filter("d is not null")
    return w.groupBy("source", "d").agg(F.max_by("work_id", F.struct("fetched_at", "work_id")).alias("work_id"), F.count("*").alias("n"))


def index_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of part and orders in key order: which count like an index."""
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    rows = [index_like(part, ["p_partkey"], c) for c in ("p_partkey", "p_size")] + [index_like(orders, ["o_orderkey"], c) for c in ("o_orderkey", "o_custkey")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def entries_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of fifty entries in key order."""
    return page_after(table(spark, sf_dir, "bib_entries").select("entry_id", "cite_key", "kind"), "entry_id", 50, 50)


def shallowest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallowest(table(spark, sf_dir, "documents").select("project", "doc_path"), "project", "doc_path")


def first_seen_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each language and source first appears in each project."""
    d = table(spark, sf_dir, "documents").select("project", "lang", "source", "doc_id")
    return first_appearances(d, ["project", "lang"], "source", "doc_id")


def project_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of every project's documents by path and content."""
    d = table(spark, sf_dir, "documents").select("project", "doc_path", F.sha2("text", 256).alias("sha"))
    return tree_digests(d, "project", "doc_path", "sha", 16)


def extraction_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared artifacts without any reading, by media type."""
    a = table(spark, sf_dir, "artifacts").select("artifact_id", "media_type")
    return missing_extractions(a, table(spark, sf_dir, "readings"), ["artifact_id"]).join(a, "artifact_id").groupBy("media_type").agg(F.count("*").alias("n"))


def fallback_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that a fallback reader gave, by reader and reason."""
    return table(spark, sf_dir, "readings").groupBy("reader", "is_fallback", "fallback_reason").agg(F.count("*").alias("n"), F.countDistinct("artifact_id").alias("n_artifacts"))


def covered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked quotations by state with the pass rule: nothing measured is no pass."""
    c = table(spark, sf_dir, "covered").groupBy("artifact_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("state") == "found").alias("n_found"), F.count_if(F.col("state") == "not found").alias("n_missing"), F.countDistinct("quote").alias("n_quotes")
    )
    return c.withColumn("ok", (F.col("n_missing") == 0) & (F.col("n_found") > 0))


def stale_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations checked before the last reading of their artifact arrived."""
    last = table(spark, sf_dir, "readings").groupBy("artifact_id").agg(F.max("read_at").alias("read_at"))
    c = table(spark, sf_dir, "covered").join(last, "artifact_id", "left")
    fate = F.when(F.col("read_at").isNull(), "no_reading").when(F.col("checked_at") < F.col("read_at"), "stale").when(F.col("checked_at").isNull(), "unknown").otherwise("current")
    return c.groupBy(fate.alias("review")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_dois, record_slugs, same_works, filled_records, rebuild_losses, project_rollup, inherited_tags, uncited_entries, duplicate_keys,
        entry_vs_registry, author_checks, fuzzy_best, venue_checks, connected_works, works_by_source, latest_fetch, index_columns, entries_page,
        shallowest_documents, first_seen_words, project_digests, extraction_backlog, fallback_readers, covered_counts, stale_reviews,
    )
}

_CITED_SQL = "cited AS (SELECT record_id, slug, m.key AS project, m.value.key AS cite_key FROM (SELECT record_id, slug, unnest(map_entries(cited_by)) AS m FROM bib_records))"
_NORM = "regexp_replace(lower(regexp_replace(coalesce({c}, ''), '<[^>]*>|[{{}}]', '', 'g')), '[^a-z0-9]+', '', 'g')"

ORACLES = {
    "clean_dois": f"""
        SELECT CASE WHEN d IS NULL THEN 'none' WHEN d = doi THEN 'as_written' ELSE 'cleaned' END AS kind, count(*) AS n, count(DISTINCT d) AS n_dois
        FROM (SELECT doi, {_DOI_SQL} AS d FROM bib_records) GROUP BY 1""",
    "record_slugs": f"""
        WITH r AS (SELECT record_id, lower(trim(coalesce(doi, ''))) AS d, trim(coalesce(arxiv, '')) AS x, {_KEY_SQL} AS k FROM bib_records)
        SELECT record_id, CASE WHEN starts_with(d, '10.48550/arxiv.') THEN 'arxiv-' || replace(split_part(d, 'arxiv.', -1), '.', '-')
            WHEN d <> '' THEN 'doi-' || regexp_replace(regexp_replace(d, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')
            WHEN x <> '' THEN 'arxiv-' || replace(x, '.', '-') ELSE 't-' || sha256(k)[1:16] END AS name FROM r""",
    "same_works": f"""
        SELECT work_key, count(*) AS n_records, count(DISTINCT slug) AS n_names, min(slug) AS first_name FROM (SELECT slug, {_KEY_SQL} AS work_key FROM bib_records)
        WHERE work_key <> '' GROUP BY work_key HAVING count(DISTINCT slug) > 1""",
    "filled_records": f"""
        WITH o AS (SELECT d, min(CASE WHEN trim(venue) <> '' THEN venue END) AS v, min(CASE WHEN trim(year) <> '' THEN year END) AS y FROM (SELECT *, {_DOI_SQL} AS d FROM works) WHERE d IS NOT NULL GROUP BY d)
        SELECT record_id, CASE WHEN coalesce(trim(venue), '') = '' THEN coalesce(v, venue) ELSE venue END AS venue, CASE WHEN coalesce(trim(year), '') = '' THEN coalesce(y, year) ELSE year END AS year
        FROM (SELECT *, {_DOI_SQL} AS d FROM bib_records) LEFT JOIN o USING (d)""",
    "rebuild_losses": f"""
        WITH n AS (SELECT d, {', '.join(f"bool_or(coalesce(trim({c}), '') <> '') AS n_{c}" for c in ('venue', 'year', 'arxiv', 'url'))} FROM (SELECT *, {_DOI_SQL} AS d FROM bib_records) WHERE d IS NOT NULL GROUP BY d),
        o AS (SELECT d, {', '.join(f"bool_or(coalesce(trim({c}), '') <> '') AS o_{c}" for c in ('venue', 'year', 'arxiv', 'url'))} FROM (SELECT *, {_DOI_SQL} AS d FROM works) WHERE d IS NOT NULL GROUP BY d),
        j AS (SELECT o.*, n.*, n.d IS NULL AS gone FROM o LEFT JOIN n ON o.d = n.d)
        SELECT 'record' AS field, count(*) AS n FROM j WHERE gone HAVING count(*) > 0
        {' '.join(f"UNION ALL SELECT '{c}', count(*) FROM j WHERE NOT gone AND o_{c} AND NOT n_{c} HAVING count(*) > 0" for c in ('venue', 'year', 'arxiv', 'url'))}""",
    "project_rollup": f"""
        WITH {_CITED_SQL}, p AS (SELECT slug, string_split(project, '/') AS parts FROM cited),
        e AS (SELECT DISTINCT slug, array_to_string(parts[1:i], '/') AS prefix FROM (SELECT slug, parts, unnest(range(1, len(parts) + 1)) AS i FROM p))
        SELECT prefix, count(*) AS n_items FROM e GROUP BY prefix""",
    "inherited_tags": f"""
        WITH {_CITED_SQL} SELECT tag, count(*) AS n FROM (SELECT DISTINCT slug, split_part(project, '-', -1) AS tag FROM cited UNION SELECT DISTINCT slug, 'library' FROM cited) GROUP BY tag""",
    "uncited_entries": f"WITH {_CITED_SQL} SELECT cite_key, count(*) AS n FROM bib_entries WHERE cite_key NOT IN (SELECT cite_key FROM cited WHERE cite_key IS NOT NULL) GROUP BY cite_key",
    "duplicate_keys": """
        SELECT bib_file, lower(cite_key) AS folded_key, count(*) AS n, count(DISTINCT cite_key) AS n_spellings, min(entry_id) AS first_entry FROM bib_entries GROUP BY 1, 2 HAVING count(*) > 1""",
    "entry_vs_registry": f"""
        WITH r AS (SELECT *, {_DOI_SQL} AS d FROM bib_records), w AS (SELECT d, arg_min(title, work_id) AS t, arg_min(year, work_id) AS y, arg_min(len(authors), work_id) AS n, count(*) AS c
                   FROM (SELECT *, {_DOI_SQL} AS d FROM works) WHERE d IS NOT NULL GROUP BY d)
        SELECT record_id AS entry_id, CASE WHEN c IS NULL THEN NULL ELSE array_to_string(list_filter([
            CASE WHEN coalesce(title, '') <> '' AND coalesce(t, '') <> '' AND {_NORM.format(c='title')} <> {_NORM.format(c='t')} THEN 'title' END,
            CASE WHEN coalesce(year, '') <> '' AND coalesce(y, '') <> '' AND trim(year) <> trim(y) THEN 'year' END,
            CASE WHEN len(authors) > 0 AND n > 0 AND len(authors) <> n THEN 'authors' END], lambda x: x IS NOT NULL), ',') END AS differs
        FROM r LEFT JOIN w USING (d) WHERE d IS NOT NULL""",
    "connected_works": f"""
        WITH RECURSIVE w AS (SELECT work_id, {_DOI_SQL} AS d, {_KEY_SQL} AS k FROM works),
        e AS (SELECT a.work_id AS a, b.work_id AS b FROM w a JOIN w b ON a.d = b.d UNION SELECT a.work_id, b.work_id FROM w a JOIN w b ON a.k = b.k AND a.k <> ''),
        walk AS (SELECT a, b FROM e UNION SELECT walk.a, e.b FROM walk JOIN e ON walk.b = e.a),
        roots AS (SELECT a, min(b) AS root, count(DISTINCT b) AS size FROM walk GROUP BY a)
        SELECT root, count(*) AS n_works FROM roots WHERE size > 1 GROUP BY root""",
    "works_by_source": """
        SELECT source, kind, count(*) AS n, count(*) FILTER (coalesce(trim(doi), '') = '') AS no_doi, count(*) FILTER (coalesce(trim(year), '') = '') AS no_year,
               count(*) FILTER (coalesce(trim(venue), '') = '') AS no_venue, count(*) FILTER (authors IS NULL) AS no_authors FROM works GROUP BY ALL""",
    "latest_fetch": f"""
        SELECT source, d, (max({{'f': coalesce(fetched_at, TIMESTAMP '0001-01-01'), 'w': work_id}})).w AS work_id, count(*) AS n FROM (SELECT *, {_DOI_SQL} AS d FROM works) WHERE d IS NOT NULL GROUP BY source, d""",
    "index_columns": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS n_rows, (SELECT s FROM (SELECT {c} - lag({c}) OVER (ORDER BY {k}) AS s FROM {t}) WHERE s <> 0 GROUP BY s ORDER BY count(*) DESC, s LIMIT 1) AS step,
            round((SELECT count(*) FROM (SELECT {c} - lag({c}) OVER (ORDER BY {k}) AS s FROM {t}) WHERE s <> 0 GROUP BY s ORDER BY count(*) DESC, s LIMIT 1) / (count(*) - 1), 6) AS step_share,
            (SELECT count(*) FROM (SELECT {c} - lag({c}) OVER (ORDER BY {k}) AS s FROM {t}) WHERE s <> 0 GROUP BY s ORDER BY count(*) DESC, s LIMIT 1) / (count(*) - 1) >= 0.75 AS index_like FROM {t}"""
        for t, k, c in (("part", "p_partkey", "p_partkey"), ("part", "p_partkey", "p_size"), ("orders", "o_orderkey", "o_orderkey"), ("orders", "o_orderkey", "o_custkey"))
    ),
    "entries_page": "SELECT entry_id, cite_key, kind FROM bib_entries WHERE entry_id > 50 ORDER BY entry_id LIMIT 50",
    "shallowest_documents": """
        WITH d AS (SELECT project, doc_path, len(string_split(doc_path, '/')) - 1 AS depth FROM documents)
        SELECT project, doc_path, depth FROM d JOIN (SELECT project, min(depth) AS m FROM d GROUP BY project) USING (project) WHERE depth = m""",
    "first_seen_words": "SELECT project, lang, source, min(doc_id) AS doc_id FROM documents GROUP BY project, lang, source",
    "project_digests": """
        WITH f AS (SELECT project, CAST('0x' || sha256(doc_path)[1:4] AS INT) % 16 AS b, length(doc_path) || ':' || doc_path || coalesce(sha256(text), '-') AS line FROM documents),
        g AS (SELECT project, b, sha256(array_to_string(list_sort(list(line)), chr(10))) AS d, count(*) AS n FROM f GROUP BY project, b)
        SELECT project, sha256(array_to_string(list_sort(list(d)), '')) AS digest, CAST(sum(n) AS BIGINT) AS n_files FROM g GROUP BY project""",
    "extraction_backlog": "SELECT media_type, count(*) AS n FROM artifacts WHERE artifact_id NOT IN (SELECT artifact_id FROM readings WHERE artifact_id IS NOT NULL) GROUP BY media_type",
    "fallback_readers": "SELECT reader, is_fallback, fallback_reason, count(*) AS n, count(DISTINCT artifact_id) AS n_artifacts FROM readings GROUP BY ALL",
    "covered_counts": """
        SELECT artifact_id, count(*) AS n, count(*) FILTER (state = 'found') AS n_found, count(*) FILTER (state = 'not found') AS n_missing, count(DISTINCT quote) AS n_quotes,
               count(*) FILTER (state = 'not found') = 0 AND count(*) FILTER (state = 'found') > 0 AS ok FROM covered GROUP BY artifact_id""",
    "stale_reviews": """
        WITH l AS (SELECT artifact_id, max(read_at) AS read_at FROM readings GROUP BY 1)
        SELECT CASE WHEN read_at IS NULL THEN 'no_reading' WHEN checked_at < read_at THEN 'stale' WHEN checked_at IS NULL THEN 'unknown' ELSE 'current' END AS review, count(*) AS n
        FROM covered LEFT JOIN l USING (artifact_id) GROUP BY 1""",
}
