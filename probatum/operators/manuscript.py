"""Manuscripts: which numbers and quotations are accounted for, by claims, outputs and cited sources."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.functions.arrow import arrow
from probatum.functions.exact import number, printed_agree, printed_places, same_number, significant_digits
from probatum.functions.folds import folded
from probatum.functions.numerals import inventory
from probatum.operators.survey import bindings
from probatum.session import checkpointed

# Levels and quantiles a formula prints, words that split a question's data, suffixes of outputs.
QUANTILES = ("1.96", "1.645", "2.576", "1.28")
CONSTANTS = ("0.05", "0.01", "0.001", "95", "99", "90", "0.95", "0.5")
QUALIFIERS = (("train", "training"), ("test", "testing"), ("val", "validation", "dev"))
VALUE_SUFFIXES = ("csv", "tsv", "json", "txt", "xlsx", "rds", "dat")
FIGURE_SUFFIXES = ("png", "pdf", "svg", "jpg", "jpeg", "eps", "tif", "tiff")
LOOSE, THRESHOLD = "0.1", "0.05"

_WORDS = re.compile(r"(?P<number>[-+]?\d[\d,]*(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d_]+)")


def token_stream(text: str | None) -> list[str]:
    """Words in lower case and numbers without grouping commas, in order."""
    return [m["number"].replace(",", "") if m["number"] else m["word"].lower() for m in _WORDS.finditer(text or "")]


def neighbourhoods(text: str | None, window: int = 2) -> list[dict]:
    """Each number with the tokens before it and after it, joined; null where no word is among them."""
    stream = token_stream(text)
    out = []
    for i, t in enumerate(stream):
        if not any(c.isdigit() for c in t):
            continue
        sides = (stream[max(0, i - window) : i], stream[i + 1 : i + 1 + window])
        before, after = (" ".join(s) if len(s) == window and any(x[0].isalpha() for x in s) else None for s in sides)
        out.append({"at": i, "printed": t, "before": before, "after": after})
    return out


@arrow("array<struct<at:int,printed:string,before:string,after:string>>")
def neighbourhoods_udf(texts: pd.Series) -> pd.Series:
    return texts.map(neighbourhoods)


def stated(manuscript: DataFrame, claims: DataFrame) -> DataFrame:
    """Numbers of a manuscript that a claim states with the same two tokens before or after: (text_id, at, claim_id).

    manuscript(text_id, text), claims(claim_id, text). Both sides are joined on the number and one neighbourhood.
    """
    m = manuscript.select("text_id", F.explode(neighbourhoods_udf("text")).alias("n")).select("text_id", "n.*")
    c = claims.select("claim_id", F.explode(neighbourhoods_udf("text")).alias("n")).select("claim_id", F.col("n.printed"), F.col("n.before"), F.col("n.after"))
    once = lambda side: c.filter(F.col(side).isNotNull()).groupBy("printed", side).agg(F.min("claim_id").alias("claim_id"))
    hits = [m.join(once(side), ["printed", side]).select("text_id", "at", "claim_id") for side in ("before", "after")]
    return hits[0].unionByName(hits[1]).groupBy("text_id", "at").agg(F.min("claim_id").alias("claim_id"))


def held(printed: DataFrame, outputs: DataFrame) -> DataFrame:
    """Printed numbers that an output's values hold, rounded either way, as they are or as a percentage: (printed, output_id)."""
    found = bindings(printed, outputs.select(F.col("output_id").alias("value_id"), "value"))
    return found.groupBy("printed").agg(F.min("value_id").alias("output_id"))


def needs_no_claim(printed: Column, before: Column, after: Column) -> Column:
    """Why a number owes no claim, from it and the text on either side; null where it owes one."""
    whole = F.regexp_replace(printed, r"^[-+]|%$", "")
    formula = before.rlike(r"(?:[<>=≤≥]|\balpha\b|\blevel\b|\bp\b|α)\s*$") | after.rlike(r"^\s*(?:%\s*)?(?:CI\b|confidence|level|quantile)")
    return (
        F.when(whole.isin(*QUANTILES) | (whole.isin(*CONSTANTS) & formula), "constant")
        .when(~whole.rlike(r"[.eE]") & (F.length(F.regexp_replace(whole, r"^0+|,", "")) < 2), "single_digit")
        .when(before.rlike(r"[A-Za-z]\w*[-_]$") | after.rlike(r"^[-_][A-Za-z]"), "name")
        .when(before.rlike(r"(?i)\b(?:table|figure|fig\.|section|sec\.|equation|eq\.|appendix|chapter|page|p\.)\s*\(?$"), "place")
        .when(before.rlike(r"(?i)(?:doi|https?://|arxiv|10\.\d{4})\S*$"), "identifier")
    )


def coverage(numbers: DataFrame, by: list[str]) -> DataFrame:
    """numbers(exempt, attributed, bound) counted: exempt, bound, attributed, unbound, and the share bound of those owed."""
    owed = F.col("exempt").isNull()
    bound, attributed = F.coalesce("bound", F.lit(False)), F.coalesce("attributed", F.lit(False))
    out = numbers.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(~owed).alias("n_exempt"), F.count_if(owed & bound).alias("n_bound"),
        F.count_if(owed & ~bound & attributed).alias("n_attributed"), F.count_if(owed & ~bound & ~attributed).alias("n_unbound"),
    )
    return out.withColumn("share", F.when(F.col("n") > F.col("n_exempt"), F.round(F.col("n_bound") / (F.col("n") - F.col("n_exempt")), 6)))


def reported_notes(assertions: DataFrame) -> DataFrame:
    """assertions(reported, stored, mode, tolerance, matched, text, passages array) with notes: where the comparison is
    wider or less direct than it looks.

    reported_not_in_claim, reported_not_in_manuscript, reported_uncompared, coarse_precision,
    rounding_crosses_threshold, loose_tolerance.
    """

    @arrow("array<string>")
    def printed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [n["num_value"] for n in inventory(t) if n["num_value"] is not None])

    a = assertions.withColumns({"_said": printed("text"), "_quoted": printed(F.array_join(F.coalesce("passages", F.array().cast("array<string>")), "\n"))})
    agrees = lambda values: F.exists(values, lambda v: F.coalesce(printed_agree(v, F.col("reported")), F.lit(False)))
    r, s, t = number("reported"), number("stored"), number("tolerance")
    printed_mode = F.coalesce("mode", F.lit("printed")) == "printed"
    half = lambda x: (x >= 0) & (x <= 1)
    loose = F.when(F.col("mode") == "absolute", t > F.abs(r) * F.lit(LOOSE).cast("decimal(3,1)")).when(F.col("mode") == "relative", t > F.lit(LOOSE).cast("decimal(3,1)"))
    level = F.lit(THRESHOLD).cast("decimal(3,2)")
    notes = F.array_compact(
        F.array(
            F.when((F.size("_said") > 0) & ~agrees("_said"), F.lit("reported_not_in_claim")),
            F.when((F.size("_quoted") > 0) & ~agrees("_quoted"), F.lit("reported_not_in_manuscript")),
            F.when((F.size("_said") == 0) & (F.size("_quoted") == 0), F.lit("reported_uncompared")),
            F.when(printed_mode & F.col("matched") & ~same_number("stored", "reported") & (significant_digits("reported") < 2), F.lit("coarse_precision")),
            F.when(printed_mode & F.col("matched") & half(s) & half(r) & ((s < level) != (r < level)), F.lit("rounding_crosses_threshold")),
            F.when(loose, F.lit("loose_tolerance")),
        )
    )
    return a.withColumn("notes", notes).drop("_said", "_quoted")


def specific(written: Column | str) -> Column:
    """Whether one match of a value says something: three significant digits, and no small whole number."""
    v = number(written)
    return (significant_digits(written) >= 3) & ~((printed_places(written) <= 0) & (F.abs(v) < 100))


def qualifiers_agree(question: Column, words: Column) -> Column:
    """Whether an address carries each split of the data its question names."""
    asked = F.regexp_extract_all(F.lower(question), F.lit(r"([a-z0-9]+)"), 1)
    out = F.lit(True)
    for split in QUALIFIERS:
        named = F.array(*[F.lit(w) for w in split])
        out &= ~F.arrays_overlap(asked, named) | F.arrays_overlap(words, named)
    return out


def attribute(fragments: DataFrame, keys: DataFrame, artifacts: DataFrame, least: int = 12) -> DataFrame:
    """Whether a quotation stands in the artifact of a source cited near it: (quotation_id, finding).

    fragments(quotation_id, fragment); keys(quotation_id, key); artifacts(key, text), text null where a source
    could not be read. covered in any readable source; uncovered only where all were read; else unresolvable.
    """
    f = fragments.select("quotation_id", folded("fragment").alias("_f")).filter("_f <> ''").groupBy("quotation_id").agg(F.collect_list("_f").alias("_fs"), F.max(F.length("_f")).alias("_long"))
    near = keys.distinct().join(artifacts.select("key", folded("text").alias("_t"), F.lit(True).alias("_known")), "key", "left")
    j = f.join(near, "quotation_id", "left").withColumn("_in", F.forall("_fs", lambda x: F.contains(F.col("_t"), x)))
    each = j.groupBy("quotation_id").agg(
        F.max("_long").alias("_long"), F.bool_or(F.coalesce("_in", F.lit(False))).alias("_hit"), F.count("_t").alias("_read"),
        F.count_if(F.col("key").isNotNull() & F.col("_t").isNull() & F.coalesce("_known", F.lit(False))).alias("_unread"),
    )
    finding = (
        F.when(F.col("_long") < least, "unresolvable").when(F.col("_hit"), "covered").when((F.col("_read") == 0) | (F.col("_unread") > 0), "unresolvable").otherwise("uncovered")
    )
    return each.select("quotation_id", finding.alias("finding"))


def unmentioned(labels: DataFrame, texts: DataFrame, group: str) -> DataFrame:
    """Labels that no text of a group mentions as a word: (group, label). Labels are single words, those of a plan, and
    every group is asked for each of them: the result itself is groups times labels less those mentioned."""
    names = labels.select(F.lower("label").alias("label")).filter("label <> ''").distinct()
    named = checkpointed(names.agg(F.array_sort(F.collect_set("label")).alias("labels")).withColumn("_one", F.lit(1)))
    words = texts.select(group, F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("label")).distinct()
    words = words.join(names, "label", "left_semi")
    wanted = texts.select(group).distinct().withColumn("_one", F.lit(1)).join(named, "_one").select(group, F.explode("labels").alias("label"))
    return wanted.join(words, [group, "label"], "left_anti")


def classify_outputs(outputs: DataFrame) -> DataFrame:
    """outputs(file, comment) with kind, the tables its comment names, and whether it says the output is not in the paper."""
    suffix = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(suffix.isin(*VALUE_SUFFIXES), "value").when(suffix.isin(*FIGURE_SUFFIXES), "figure").otherwise("other")
    tables = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("comment", F.lit("")), F.lit(r"(?i)\btables?\s+([A-Z]?\d+)"), 1)))
    return outputs.withColumns({"kind": kind, "tables": tables, "outside_paper": F.coalesce(F.col("comment").rlike(r"(?i)\bnot (?:included )?in (?:the )?(?:paper|manuscript)\b"), F.lit(False))})


def reread(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Values read before and after a re-run: (key, state), unchanged, changed, or unreadable where either has none."""
    j = before.select(key, F.col("value").alias("_b")).join(after.select(key, F.col("value").alias("_a")), key, "full")
    return j.select(key, F.when(F.col("_a").isNull() | F.col("_b").isNull(), "unreadable").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed").alias("state"))


def origin_checks(artifacts: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Artifacts against the bytes at their declared origin: (artifact_id, origin_state).

    snapshot(repository, commit, path, sha256), one row per place.
    """
    o = artifacts.select("artifact_id", "sha256", "origin.repository", "origin.commit", "origin.path", F.col("origin").isNotNull().alias("_declared"))
    j = o.join(snapshot.withColumnRenamed("sha256", "_there"), ["repository", "commit", "path"], "left")
    state = (
        F.when(~F.col("_declared"), "no_origin").when(F.col("_there").isNull(), "not_there").when(F.col("sha256").isNull(), "unpinned").when(F.col("sha256") == F.col("_there"), "matches").otherwise("differs")
    )
    return j.select("artifact_id", state.alias("origin_state"))


def removed_lines(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows an append-only log held once and does not hold now, as often as they are gone."""
    return old.select(*columns).exceptAll(new.select(*columns))


# The lines a plan's status consists of, where its log begins, how a log entry begins.
_STATUS = re.compile(r"^\*\*(?:Status|Plan sha256|Frozen|Log):\*\*")
_LOG = "---\n\n## Log"
_DATED = re.compile(r"^\s*(?:[-*+]\s+|\|\s*)?(?:\*\*|`)?\d{4}-\d{2}-\d{2}")


def plan_text(text: str) -> str:
    """What a freeze covers: the plan up to its log, without its status lines."""
    body = text.split(_LOG, 1)[0]
    return "\n".join(x for x in body.splitlines() if not _STATUS.match(x)).strip() + "\n"


def added_beyond_log(old: str, new: str) -> str | None:
    """The first line added to a frozen text that is no dated log entry; '' where earlier text changed; None where all is a log."""
    a, b = old.rstrip("\n").split("\n"), new.rstrip("\n").split("\n")
    if b[: len(a)] != a:
        return ""
    entry = False
    for line in b[len(a) :]:
        if _DATED.match(line):
            entry = True
        elif line.startswith("#"):
            if not re.search(r"(?i)\b(?:log|deviations?|changelog|updates?)\b", line):
                return line
            entry = False
        elif line.strip() and not (entry and line[:1].isspace()) and not re.match(r"^\s*(?:```|~~~|\|[\s:|-]+\|?\s*$)", line):
            return line
    return None


@arrow("struct<text_sha:string,beyond:string>")
def plan_udf(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    import hashlib

    return pd.DataFrame([(hashlib.sha256(plan_text(n or "").encode()).hexdigest(), added_beyond_log(o or "", n or "")) for o, n in zip(old, new)], columns=["text_sha", "beyond"])
