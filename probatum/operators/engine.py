"""verify: all evidence of many manifests against many artifacts, set at a time.

Each piece of evidence names one or more addresses (sides). Addresses of one kind are resolved by one join
against the cells of all artifacts; values are compared by the rule of the evidence's kind; what could not be
read stays a row saying so. As many decisions come out as pieces of evidence went in.

evidence: claim_id, ord, kind (value, correspondence, aggregate, quote), reported, mode, tolerance, places,
statistic, n_declared, quote, prefix, suffix, sides array<struct<name, artifact_id, conversion, locator>>.
artifacts: artifact_id, path, sha256. cells, texts: by path (see sources.files). files: path, actual, status.
Nulls: a null reported value is not numeric; a null locator kind is an invalid selector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.functions.exact import agrees, is_number, printed_places, shift_of, shifted, statistic_of_members, within
from probatum.functions.folds import folded, resolve_udf
from probatum.functions.numerals import CARDINALS, located_udf
from probatum.operators.correspond import side_pairs, verdicts
from probatum.operators.decide import outcome, pin_state
from probatum.schema import VALIDITY_RANK, rank_case
from probatum.session import checkpointed

LOCATOR = (
    "struct<kind:string,pointer:string,table_name:string,column:string,predicate:map<string,string>,row:long,array_name:string,index:array<int>,"
    "before:string,after:string,form:string>"
)
EVIDENCE = (
    "claim_id string, ord int, kind string, reported string, mode string, tolerance string, places int, statistic string, n_declared int, "
    f"quote string, prefix string, suffix string, sides array<struct<name:string,artifact_id:string,conversion:string,locator:{LOCATOR}>>"
)
_ID = ["claim_id", "ord", "pos"]


def _classify(addresses: DataFrame, found: DataFrame, absent: str) -> DataFrame:
    """addresses with resolution, raw and why; found has a row per cell an address selects."""
    hits = found.groupBy(*_ID).agg(F.count("*").alias("_n"), F.first("raw").alias("raw"), F.bool_or("is_container").alias("_c"), F.first("native_type").alias("_t"))
    n = F.coalesce("_n", F.lit(0))
    resolution = (
        F.when((n == 0) | ((n == 1) & (F.col("_t") == "null")), "absent").when(n > 1, "ambiguous").when(F.col("_c"), "not_scalar").otherwise("resolved")
    )
    why = F.when(resolution == "absent", absent).when(resolution == "ambiguous", "row_ambiguous").when(resolution == "not_scalar", "selector_not_scalar")
    return addresses.select(*_ID).join(hits, _ID, "left").select(*_ID, resolution.alias("resolution"), F.when(resolution == "resolved", F.col("raw")).alias("raw"), why.alias("why"))


def resolve_addresses(addresses: DataFrame, cells: DataFrame, texts: DataFrame) -> DataFrame:
    """(claim_id, ord, pos, resolution, raw, why) of addresses(claim_id, ord, pos, path, locator)."""
    a = addresses.select(*_ID, "path", "locator.*")
    cell = cells.filter("status = 'ok'").select("path", F.col("table_name").alias("_table"), "row_ord", F.col("column").alias("_column"), F.col("pointer").alias("_pointer"), F.col("index").alias("_index"), "raw", "native_type", "is_container", "address_kind")

    by_pointer = a.filter("kind = 'pointer'")
    tree = cell.filter("address_kind = 'pointer'").select("path", F.col("_pointer").alias("pointer"), "raw", "native_type", "is_container")
    out = _classify(by_pointer, by_pointer.join(tree, ["path", "pointer"]), "pointer_absent")

    grid = cell.filter("address_kind = 'table'")
    same_table = F.col("table_name").isNull() | F.col("table_name").eqNullSafe(F.col("_table"))
    by_where = a.filter("kind = 'table'")
    # The rows of a file come together once for each set of columns that predicates name, and rows with the same values
    # are counted before any address meets them: a value that fills a third of a table is one row of the join.
    said = lambda k, v: F.concat(F.length(k).cast("string"), F.lit(":"), k, F.coalesce(F.concat(F.lit("="), v), F.lit("~")))
    names = F.array_sort(F.map_keys("predicate"))
    where = by_where.select(*_ID, "path", "table_name", "column", names.alias("_cols"), F.array_join(F.transform(names, lambda k: said(k, F.col("predicate")[k])), "\u0001").alias("_key"))
    sets = where.select("path", "_cols").distinct().withColumn("_column", F.explode("_cols"))
    given = grid.join(sets, ["path", "_column"]).groupBy("path", "_table", "row_ord", "_cols").agg(F.sort_array(F.collect_list(F.struct("_column", "raw"))).alias("_kv"))
    given = given.filter(F.size("_kv") == F.size("_cols")).withColumn("_key", F.array_join(F.transform("_kv", lambda x: said(x["_column"], x["raw"])), "\u0001"))
    counted = given.groupBy("path", "_cols", "_key", "_table").agg(F.count("*").alias("_rows"), F.min("row_ord").alias("row_ord"))
    met = where.join(counted, ["path", "_cols", "_key"]).filter(same_table).groupBy(*_ID, "path", "column").agg(F.sum("_rows").alias("_rows"), F.min("row_ord").alias("row_ord"), F.first("_table").alias("_table"))
    values = grid.select("path", F.col("_table").alias("_t2"), "row_ord", "_column", "raw", "native_type", "is_container")
    single = met.filter("_rows = 1").withColumnRenamed("column", "_column").join(values, ["path", "row_ord", "_column"]).filter(F.col("_table").eqNullSafe(F.col("_t2"))).select(*_ID, "raw", "native_type", "is_container")
    many = met.filter("_rows > 1").select(*_ID, F.explode(F.array(F.lit(1), F.lit(2))).alias("_x"), F.lit(None).cast("string").alias("raw"), F.lit("string").alias("native_type"), F.lit(False).alias("is_container")).drop("_x")
    located = _classify(by_where, single.unionByName(many), "row_absent")
    columns = grid.select("path", "_column").distinct()
    named = by_where.select(*_ID, "path", F.explode(F.array_union(F.array("column"), F.map_keys("predicate"))).alias("_column"))
    unknown = named.join(columns, ["path", "_column"], "left_anti").select(*_ID).distinct().withColumn("_unknown", F.lit(True))
    located = located.join(unknown, _ID, "left").withColumn("why", F.when(F.col("_unknown"), "column_absent").otherwise(F.col("why"))).drop("_unknown")
    out = out.unionByName(located)

    by_row = a.filter("kind = 'row'")
    at_row = by_row.join(values.withColumnRenamed("row_ord", "row"), ["path", "row"]).filter((F.col("column") == F.col("_column")) & (F.col("table_name").isNull() | F.col("table_name").eqNullSafe(F.col("_t2"))))
    out = out.unionByName(_classify(by_row, at_row, "row_absent"))

    by_index = a.filter("kind = 'array'")
    elements = cell.filter("address_kind = 'array'").select("path", "_table", F.col("_index").alias("index"), "raw", "native_type", "is_container")
    at_index = by_index.join(elements, ["path", "index"]).filter(F.col("array_name").eqNullSafe(F.col("_table")))
    out = out.unionByName(_classify(by_index, at_index, "row_absent"))

    by_prose = a.filter("kind = 'prose'").join(texts.select("path", folded("text").alias("_text")), "path", "left")
    places = by_prose.withColumn("_at", F.array_distinct(F.transform(located_udf("_text", folded("before"), F.coalesce(folded("after"), F.lit(""))), lambda x: x["printed"])))
    word = F.element_at("_at", 1)
    cardinal = F.element_at(F.create_map(*[F.lit(x) for kv in CARDINALS.items() for x in (kv[0], str(kv[1]))]), word)
    grouped = F.when(word.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(word, F.lit(","), F.lit("")))
    read = F.when(F.col("form") == "cardinal_word", F.coalesce(cardinal, word)).when(F.col("form") == "grouped", F.coalesce(grouped, word)).otherwise(word)
    is_word = cardinal.isNotNull() & (F.coalesce("form", F.lit("decimal")) != "cardinal_word")
    resolution = F.when(F.size("_at") == 0, "absent").when(F.size("_at") > 1, "ambiguous").when(is_word, "number_as_word").otherwise("resolved")
    why = F.when(resolution == "absent", "passage_absent").when(resolution == "ambiguous", "passage_ambiguous").when(resolution == "number_as_word", "number_as_word")
    prose = places.select(*_ID, resolution.alias("resolution"), F.when(resolution == "resolved", read).alias("raw"), why.alias("why"))
    other = a.filter("kind is null or kind not in ('pointer', 'table', 'row', 'array', 'prose')").select(*_ID, F.lit("invalid_selector").alias("resolution"), F.lit(None).cast("string").alias("raw"), F.lit("row_selector_invalid").alias("why"))
    return out.unionByName(prose).unionByName(other)


def verify(evidence: DataFrame, artifacts: DataFrame, files: DataFrame, cells: DataFrame, texts: DataFrame) -> DataFrame:
    """One decision per piece of evidence: execution, extraction, comparison, outcome, reason, stored, validity."""
    states = checkpointed(pin_state(artifacts, files).join(files.select("path", "status"), "path", "left"))
    sides = evidence.select("claim_id", "ord", "kind", F.posexplode_outer("sides").alias("pos", "side"))
    addressed = checkpointed(
        sides.select(*_ID, "kind", F.col("side.name").alias("name"), F.col("side.artifact_id").alias("artifact_id"), F.col("side.conversion").alias("conversion"), F.col("side.locator").alias("locator"))
        .join(states.select("artifact_id", "path", "validity", F.col("status").alias("file_status"), F.lit(True).alias("declared")), "artifact_id", "left")
    )
    blocked = (
        F.when(F.col("declared").isNull(), "artifact_undeclared")
        .when(F.col("validity") == "artifact_absent", "artifact_missing")
        .when(F.col("file_status").isin("never_opened", "unsupported"), "format_unsupported")
        .when(F.col("file_status").isin("unreadable", "extractor_missing"), F.when(F.col("file_status") == "unreadable", "artifact_unreadable").otherwise("extractor_missing"))
    )
    addressed = addressed.withColumn("blocked", blocked)
    open_ = addressed.filter("blocked is null and kind <> 'quote'")
    resolved = checkpointed(resolve_addresses(open_, cells, texts))
    read = addressed.join(resolved, _ID, "left")
    # Values stay text: a conversion moves the point and keeps every digit.
    read = read.withColumn("value", F.when(is_number("raw"), shifted("raw", shift_of("conversion"))))
    read = read.withColumn("why", F.when((F.col("resolution") == "resolved") & F.col("value").isNull(), "value_not_numeric").otherwise(F.col("why")))
    bad = F.col("why").isNotNull()
    whole = read.groupBy("claim_id", "ord").agg(
        F.min_by("blocked", F.when(F.col("blocked").isNotNull(), F.col("pos"))).alias("blocked"),
        F.min_by("why", F.when(bad, F.col("pos"))).alias("why"),
        F.min_by("resolution", F.when(bad, F.col("pos"))).alias("bad_resolution"),
        F.min_by("raw", "pos").alias("raw"),
        F.min_by("value", "pos").alias("value"),
        F.collect_list("value").alias("values"),  # the members an author declared
        F.min_by("validity", F.expr(rank_case("validity", VALIDITY_RANK))).alias("validity"),
        F.min("path").alias("path"),
        F.collect_list(F.struct("name", F.coalesce("value", F.col("raw")).alias("raw"))).alias("read_sides"),
    )
    e = evidence.drop("sides").join(whole, ["claim_id", "ord"], "left")

    pairs = side_pairs(e.filter("kind = 'correspondence' and blocked is null and why is null").select(F.concat_ws("\u0001", "claim_id", "ord").alias("key"), F.col("read_sides").alias("sides")), "key")
    agreed = verdicts(pairs, "key").select("key", F.col("comparison").alias("_pairs"))
    q = e.filter("kind = 'quote' and blocked is null").join(texts.filter("text is not null"), "path").withColumn("_q", resolve_udf("quote", "text")).select("claim_id", "ord", F.col("_q.state").alias("_state"))
    e = e.withColumn("key", F.concat_ws("\u0001", "claim_id", "ord")).join(agreed, "key", "left").join(q, ["claim_id", "ord"], "left").drop("key")

    members = lambda c: F.when((F.col("kind") == "aggregate") & F.col("why").isNull(), F.col(c))
    statistic = statistic_of_members(members("statistic"), members("values"), members("reported"))
    tolerant = F.col("mode").isin("absolute", "relative")
    bounded = lambda c: F.when(tolerant, F.col(c))
    plain = F.when(tolerant, within(bounded("value"), bounded("reported"), "mode", bounded("tolerance"))).otherwise(agrees("value", "reported"))
    same = F.when(F.col("kind") == "aggregate", statistic).when(F.col("kind") == "correspondence", F.col("_pairs") == "match").otherwise(plain)
    e = e.withColumn("_same", same)
    same = F.col("_same")
    misplaced = F.col("places").isNotNull() & (F.col("places") != printed_places("reported"))
    quote_why = F.when(F.col("_state") == "found", "passage_present").when(F.col("_state") == "ambiguous", "quotation_ambiguous").when(F.col("_state").isNull(), "extractor_missing").otherwise("passage_absent")
    reason = (
        F.when(F.col("kind").isNull(), "not_offered")
        .when(F.col("blocked").isNotNull(), F.col("blocked"))
        .when(F.col("kind") == "quote", quote_why)
        .when(F.col("why").isNotNull(), F.col("why"))
        .when(same.isNull(), "value_not_numeric")
        .when(misplaced, "places_mismatch")
        .when(same, "value_match")
        .otherwise("value_mismatch")
    )
    execution = F.when(F.col("reason").isin("artifact_undeclared", "artifact_missing", "artifact_unreadable", "extractor_missing", "format_unsupported", "not_offered"), "unavailable").otherwise("completed")
    extraction = (
        F.when(F.col("execution") == "unavailable", "not_attempted")
        .when(F.col("reason").isin("pointer_absent", "row_absent", "row_ambiguous", "column_absent", "passage_ambiguous", "quotation_ambiguous"), "absent")
        .when((F.col("reason") == "passage_absent") & (F.col("kind") != "quote"), "absent")
        .when(F.col("reason").isin("value_not_numeric", "selector_not_scalar", "number_as_word", "row_selector_invalid"), "invalid")
        .otherwise("extracted")
    )
    comparison = F.when(F.col("extraction") != "extracted", "not_applicable").when(F.col("reason").isin("value_match", "passage_present"), "match").otherwise("mismatch")
    out = e.withColumn("reason", reason).withColumn("execution", execution).withColumn("extraction", extraction).withColumn("comparison", comparison)
    derived = outcome(F.col("execution"), F.col("extraction"), F.col("comparison"))
    return out.withColumn("outcome", F.when(F.col("reason") == "not_offered", "not_offered").otherwise(derived)).select(
        "claim_id", "ord", "execution", "extraction", "comparison", "outcome", "reason", F.col("raw").alias("stored"), "reported", "validity"
    )
