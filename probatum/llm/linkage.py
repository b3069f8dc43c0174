"""Records of two tables that describe the same work, without a shared key, each match with a confidence.

1. Every record is read into words, authors, year, DOI and kind of work; rows that read alike are one class, and all
   that follows works on classes.
2. A class becomes terms over all its attributes: three telling title words in a row, rare title words, authors,
   author with year, DOI. A value that more than `HEAVY` of all records hold is no term by itself, only together
   with others, so no posting list grows with a popular author or word.
3. BM25 (term frequency, length of the record) scores the classes of the other table over an inverted index. Pruning
   is exact: of a query the rarest terms are looked up, as many as are needed so that the others together stay below
   half of `LEAST` of its own score, and pairs with the other half are kept. Of the rest each query keeps its `TOP`
   best and all others that reach a share of its best score, so copies, however many, are never cut.
4. Those are compared attribute by attribute. A logistic curve over the attributes, fitted on pairs whose DOIs settle
   the matter, scores each pair; a second one turns score and gap to the best other pair of either side into the
   confidence. A pair stands where it is among the nearest of both sides, its kind of work (erratum, reply, part,
   yearly report) is the same, and its confidence is a half or more.

Null titles, author lists, years and DOIs weigh nothing; a record without any term matches nothing.
Repeated rows match each like the first.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probatum.functions.arrow import arrow
from probatum.llm.names import GivenNames, edits, known_given, plain, read_name
from probatum.session import checkpointed, spread

#: Least share of a record's own retrieval score that a candidate reaches.
LEAST = 0.12
#: BM25: saturation of term frequency, weight of the record's length, and how much more than once a term may count.
K1, B, MOST_TF = 1.2, 0.3, 2
#: Best candidates of a query kept whatever their score; beyond them those with this share of the best score.
TOP, NEAR_BEST = 2, 0.3
#: A value that more than this share of all records hold (and HEAVY_COUNT of them) is no term by itself, so there are
#: at most some thousands.
HEAVY, HEAVY_COUNT = 5e-4, 24
#: A title word that more than this share of all records hold tells nothing by itself.
COMMON = 0.02
#: Weight from which a title tells a work by itself, in words that no other record has.
TELLING = 2.3
#: What the DOI adds to a score or takes from it.
DOI_WEIGHT = 1.0
#: Bound of the samples of pairs on which the curves are fitted.
SAMPLE = 20_000
#: Pairs of each kind that a fit takes at least, its rounds, and the chance under which an equal DOI is held to be wrong.
LABELLED, ROUNDS, WRONG = 20, 4, 0.02

# Words that make a work of its own out of the one whose title follows.
KINDS = {
    "erratum": "erratum", "errata": "erratum", "corrigendum": "erratum", "correction": "erratum", "corrections": "erratum",
    "addendum": "addendum", "reply": "reply", "response": "reply", "comment": "reply", "comments": "reply", "rejoinder": "reply",
}
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
_TAGS = re.compile(r"</?[A-Za-z][^<>]*>")
_WORDS = re.compile(r"[^\W_]+\.?")
_PART = re.compile(r"\b(?:p[a-z]{0,2}rt|part\w?|vol\w*|no)\.? ?,? ?([ivx]+|\d{1,2})\.?$")
_REPORT = re.compile(r"\b((?:19|20)\d\d)\s+(?:annual\s+|yearly\s+)?re\w{2,4}t\W*$|\bre\w{2,4}t\s+(?:for|of)\s+((?:19|20)\d\d)\W*$")
_DOI = re.compile(r"10\.\d{4,9}/\S+")
_CUT = re.compile(r"(?:\.\.\.|…)\s*$")


def clean_title(title: str | None) -> str:
    return " ".join(plain(_TAGS.sub("", title or "")).lower().replace("&", " and ").split())


def kind_of_work(title: str) -> str:
    """'' for a work itself, else what it is to another: erratum, reply, part and its number, report and its year."""
    words = re.findall(r"[a-z]+", title)[:2]
    found = next((KINDS[w] for w in words[:1] if w in KINDS), "")
    if not found and words and len(words[0]) >= 5:
        found = next((k for w, k in KINDS.items() if len(w) >= 5 and edits(words[0], w, 1) == 1), "")
    bare = title.rstrip(" .\"'”)")
    if m := _PART.search(bare):
        number = _ROMAN.get(m[1]) or (int(m[1]) if m[1].isdigit() else 0)
        found += f"|part{number}"
    if m := _REPORT.search(bare):
        found += f"|report{m[1] or m[2]}"
    return found


def clean_doi(doi: str | None) -> str:
    m = _DOI.search((doi or "").lower())
    return m[0].rstrip(" ./,;)") if m else ""


def _year(year) -> int | None:
    m = re.fullmatch(r"\s*(1[5-9]\d\d|20\d\d)\s*", str(year or ""))
    return int(m[1]) if m else None


_READ = "struct<words:array<string>,names:array<string>,y:int,d:string,kind:string,cut:boolean,fp:long>"


def _reader(given: GivenNames):
    @arrow(_READ)
    def read(titles: pd.Series, authors: pd.Series, years: pd.Series, dois: pd.Series) -> pd.DataFrame:
        rows = []
        known: dict[str, str | None] = {None: None}

        def named(name: str | None) -> str | None:
            if name not in known:
                r = read_name(name, given)
                known[name] = r[1] + "|" + r[2][:1] if r else None
            return known[name]

        for t, a, y, d in zip(titles, authors, years, dois):
            title = clean_title(t)
            names = list(dict.fromkeys(x for n in (a if a is not None else ()) if (x := named(n))))
            words = list(dict.fromkeys(_WORDS.findall(title)))
            record = (words, names, _year(y), clean_doi(d), kind_of_work(title), bool(_CUT.search(title)))
            rows.append((*record, xxhash.xxh64_intdigest(repr(record).encode()) - (1 << 63)))
        return pd.DataFrame(rows, columns=["words", "names", "y", "d", "kind", "cut", "fp"]).astype({"y": "Int32", "fp": "int64"})

    return read


class Weights:
    """How often values occur: words and authors held by a share of all records, a bounded number of them."""

    def __init__(self, counts: dict[str, int], total: int):
        self.counts, self.total = counts, max(total, 1)
        self.heavy_from = max(HEAVY_COUNT, HEAVY * self.total)
        #: What is not counted is rarer than any that is.
        self.rare = max(1.0, 0.4 * self.heavy_from)

    def idf(self, word: str) -> float:
        return math.log(1 + self.total / self.counts.get(word, self.rare))

    def common(self, word: str) -> bool:
        return self.counts.get(word, 0) > COMMON * self.total + 3

    def heavy(self, value: str) -> bool:
        return self.counts.get(value, 0) > self.heavy_from

    def told(self, words: list[str]) -> float:
        return sum(map(self.idf, words)) / (TELLING * math.log(1 + self.total))


def value_weights(docs: DataFrame) -> Weights:
    """Counts of the words, authors and DOIs that a share of all records hold: 16 values a record make some 1e5 at most."""
    total = docs.count()
    values = F.concat("words", F.transform("names", lambda n: F.concat(F.lit("a "), F.substring_index(n, "|", 1))), F.array(F.concat(F.lit("d "), "d")))
    each = docs.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    rows = each.filter(F.col("n") > 0.4 * max(HEAVY_COUNT, HEAVY * total)).collect()
    return Weights({r["value"]: r["n"] for r in rows}, total)


def record_terms(words: list[str], names: list[str], year: int | None, doi: str, w: Weights) -> list[str]:
    """The retrieval terms of a record, in order, repeated as they repeat in it."""
    bare = [x.rstrip(".") for x in words]
    telling = [x for x in bare if not w.common(x)]
    base = telling if len(telling) >= 3 else bare
    families = [n.split("|")[0] for n in names]
    terms = [f"a {f}" for f in families if not w.heavy(f"a {f}")]
    terms += [f"y {f} {year}" for f in families if year is not None]
    terms += [f"d {doi}"] if doi and not w.heavy(f"d {doi}") else []
    if w.told(words) >= 1:
        terms += [f"w {x}" for x in telling if len(x) > 3 and not w.heavy(x)]
        # Three words in a row, and with one left out, so that a misspelt word costs no more than its own terms.
        rows = [t for i in range(len(base) - 2) for t in {(base[i], base[i + 1], base[i + 2]), *([(base[i], base[i + 2], base[i + 3])] if i + 3 < len(base) else [])}]
        terms += ["t " + " ".join(sorted(t)) for t in rows or ([tuple(base)] if base else [])]
    else:
        # A title of little weight (that of an editorial, say) is looked up with an author only.
        terms += [f"b {f} {x}" for f in families for x in (telling if len(telling) >= 2 else bare)]
    return terms


def _term_maker(w: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            side, fps, terms, tfs, lens = [], [], [], [], []
            cols = [batch.column(c).to_pylist() for c in ("side", "fp", "words", "names", "y", "d")]
            for s, fp, words, names, y, d in zip(*cols):
                if (s, fp) in seen:
                    continue
                seen.add((s, fp))
                found = Counter(record_terms(words, names, y, d, w))
                size = sum(found.values())
                for t, n in found.items():
                    side.append(s), fps.append(fp), terms.append(xxhash.xxh64_intdigest(t.encode()) - (1 << 63)), tfs.append(min(n, MOST_TF)), lens.append(min(size, 32_000))
            yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.int64()), "side": pa.array(side, pa.int8()), "fp": pa.array(fps, pa.int64()), "tf": pa.array(tfs, pa.int8()), "len": pa.array(lens, pa.int16())})

    return run


def title_match(a: list[str], wa: list[float], b: list[str], wb: list[float]) -> tuple[float, float]:
    """Shares of the weight of each title's words that the other has, in some spelling."""
    if not len(a) or not len(b):
        return 0.0, 0.0
    strip = lambda ws: [w.rstrip(".") for w in ws]
    sa, sb = strip(a), strip(b)
    got_a, got_b = [0.0] * len(sa), [0.0] * len(sb)
    where = {w: j for j, w in enumerate(sb)}
    for i, w in enumerate(sa):
        if (j := where.get(w)) is not None:
            got_a[i] = got_b[j] = 1.0
    joined_b = {x + y: (j, j + 1) for j, (x, y) in enumerate(zip(sb, sb[1:]))}
    joined_a = {x + y: (i, i + 1) for i, (x, y) in enumerate(zip(sa, sa[1:]))}
    for i, w in enumerate(sa):
        if not got_a[i] and (p := joined_b.get(w)):
            got_a[i] = got_b[p[0]] = got_b[p[1]] = 1.0
    for j, w in enumerate(sb):
        if not got_b[j] and (p := joined_a.get(w)):
            got_b[j] = got_a[p[0]] = got_a[p[1]] = 1.0
    rest_b = [j for j in range(len(sb)) if not got_b[j]]
    for i, w in enumerate(sa):
        if got_a[i]:
            continue
        best, at = 0.0, -1
        for j in rest_b:
            v = sb[j]
            if got_b[j]:
                continue
            s = 0.0
            if len(w) >= 4 and len(v) >= 4 and abs(len(w) - len(v)) <= 2:
                most = 1 if min(len(w), len(v)) < 7 else 2
                if edits(w, v, most) <= most:
                    s = 0.9
            short, long, dotted = (w, v, a[i]) if len(w) < len(v) else (v, w, b[j])
            if not s and len(short) >= 3 and long.startswith(short) and dotted.endswith("."):
                s = 0.8
            if s > best:
                best, at = s, j
        if at >= 0:
            got_a[i] = got_b[at] = best
    ta, tb = sum(wa) or 1.0, sum(wb) or 1.0
    return sum(g * x for g, x in zip(got_a, wa)) / ta, sum(g * x for g, x in zip(got_b, wb)) / tb


def author_match(a: list[str], b: list[str]) -> float | None:
    """Share of the shorter author list that the other has, None where a list is missing."""
    if not len(a) or not len(b):
        return None
    fa, fb = [x.split("|")[0] for x in a], [x.split("|")[0] for x in b]
    left, n = list(fb), 0.0
    for x in fa:
        hit = next((y for y in left if y == x), None) or next((y for y in left if len(x) > 4 and edits(x, y, 1) <= 1), None)
        if hit is not None:
            left.remove(hit)
            n += 1
    return n / min(len(fa), len(fb))


_COMPARED = "struct<title:double,whole:double,names:double,year:double,doi:double,told:double>"


def _comparer(w: Weights):
    @arrow(_COMPARED)
    def compare(wa: pd.Series, na: pd.Series, ya: pd.Series, da: pd.Series, wb: pd.Series, nb: pd.Series, yb: pd.Series, db: pd.Series) -> pd.DataFrame:
        rows = []
        for w1, n1, y1, d1, w2, n2, y2, d2 in zip(wa, na, ya, da, wb, nb, yb, db):
            w1, w2 = list(w1), list(w2)
            s1, s2 = title_match(w1, [w.idf(x) for x in w1], w2, [w.idf(x) for x in w2])
            names = author_match(list(n1), list(n2))
            known = not (pd.isna(y1) or pd.isna(y2))
            year = 0.0 if not known else (1.0 if y1 == y2 else 0.5 if abs(y1 - y2) == 1 else -1.0)
            doi = 0.0 if not d1 or not d2 else (1.0 if d1 == d2 else -1.0)
            rows.append((max(s1, s2), min(s1, s2), -1.0 if names is None else names, year, doi, max(w.told(w1), w.told(w2))))
        return pd.DataFrame(rows, columns=["title", "whole", "names", "year", "doi", "told"])

    return compare


def candidates(docs: DataFrame, w: Weights) -> DataFrame:
    """(q, c, hit) of classes of side 1 and 0: BM25 score as a share of the query's own, exact top-k.

    docs(side, fp, words, names, y, d). One shuffle brings postings, document frequencies and look-ups together.
    """
    made = docs.select("side", "fp", "words", "names", "y", "d").mapInArrow(_term_maker(w), "term long, side byte, fp long, tf byte, len short")
    postings = checkpointed(made.repartition("term").dropDuplicates(["term", "side", "fp"]))
    # The few tables' statistics: classes of the corpus and their mean length.
    size, mean = postings.filter("side = 0").agg(F.countDistinct("fp"), F.avg("len")).first()
    size, mean = max(size or 0, 1), max(mean or 1.0, 1.0)
    held = postings.groupBy("term").agg(F.count_if(F.col("side") == 0).alias("df"), F.count_if(F.col("side") == 1).alias("qf"))
    saturated = lambda tf, n: tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))
    most = MOST_TF * (K1 + 1) / (MOST_TF + K1 * (1 - B))
    idf = F.log(1 + (size - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = postings.filter("side = 1").join(held.filter("qf > 0"), "term").select(F.col("fp").alias("q"), "term", (F.col("df") > 0).alias("met"), idf.cast("float").alias("w"), saturated(F.col("tf"), F.col("len")).alias("own"))
    # The terms of one record, rarest last; each with the weight of all commoner ones and itself.
    whole = checkpointed(asked.groupBy("q").agg(F.sum(F.col("w") * F.col("own")).alias("own"), F.sort_array(F.collect_list(F.struct("w", "term", "met"))).alias("ts")))
    tails = F.transform("ts", lambda t, i: F.struct(t["term"].alias("term"), t["w"].alias("w"), t["met"].alias("met"), F.aggregate(F.slice("ts", 1, i + 1), F.lit(0.0), lambda z, x: z + x["w"]).alias("tail")))
    needed = whole.select("q", "own", F.explode(F.filter(tails, lambda t: t["met"] & (t["tail"] * most >= LEAST / 2 * F.col("own")))).alias("t"))
    looked = needed.select("q", "t.term", "t.w")
    corpus = postings.filter("side = 0").select("term", F.col("fp").alias("c"), saturated(F.col("tf"), F.col("len")).cast("float").alias("part"))
    # From here on everything is per query: one shuffle by q serves sums, own weights, best scores and ranks.
    parts = looked.join(corpus, "term").select("q", "c", (F.col("w") * F.col("part")).cast("float").alias("s")).repartition("q")
    scored = parts.groupBy("q", "c").agg(F.sum("s").alias("s")).join(whole.select("q", "own"), "q").select("q", "c", (F.col("s") / F.col("own")).alias("hit"))
    # The terms left out weigh less than half of the bound together: a pair at the bound has the other half among those looked up.
    ranked = scored.filter(F.col("hit") >= LEAST / 2).withColumns({
        "best": F.max("hit").over(Window.partitionBy("q")), "rank": F.row_number().over(Window.partitionBy("q").orderBy(F.desc("hit"), "c")),
    })
    return ranked.filter((F.col("rank") <= TOP) | (F.col("hit") >= NEAR_BEST * F.col("best"))).select("q", "c", "hit")


def _fit(sample: pd.DataFrame, features: list[str]) -> np.ndarray:
    """Weights of a logistic regression (with intercept, ridge 1e-2) by Newton steps."""
    x = np.c_[np.ones(len(sample)), sample[features].to_numpy(float)]
    y = sample["y"].to_numpy(float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * len(y) / 100 * np.eye(x.shape[1])
        g = x.T @ (y - p) - 1e-2 * len(y) / 100 * w
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


#: Attributes the first curve weighs.
ATTRIBUTES = ("telling_title", "telling_whole", "weak_title", "named", "unnamed", "year", "hit")


def match_records(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, confidence, ...) of the rows of left and right that may describe the same work."""
    authors = left.select(F.explode("authors").alias("name")).unionByName(right.select(F.explode("authors").alias("name")))
    read = _reader(known_given(authors))
    side = lambda df, key, n: spread(df.select(F.col(key).alias("id"), "title", "authors", "year", "doi")).select(F.lit(n).cast("byte").alias("side"), "id", read("title", "authors", "year", "doi").alias("r")).select("side", "id", "r.*")
    docs = checkpointed(side(left, left_id, 0).unionByName(side(right, right_id, 1)))
    w = value_weights(docs)
    met = candidates(docs, w)
    record = lambda n, p: docs.filter(F.col("side") == n).dropDuplicates(["fp"]).select(*[F.col(c).alias(p + c) for c in ("fp", "words", "names", "y", "d", "kind", "cut")])
    joined = met.join(record(1, "r"), F.col("q") == F.col("rfp")).join(record(0, "l"), F.col("c") == F.col("lfp"))
    compared = joined.withColumn("f", _comparer(w)("rwords", "rnames", "ry", "rd", "lwords", "lnames", "ly", "ld"))
    telling, named = F.least(F.lit(1.0), "told"), F.greatest(F.lit(0.0), "names")
    # A shortened title may have lost the mark of its kind; year and DOI decide then.
    kept = compared.select("lfp", "rfp", "hit", "lkind", "rkind", "rcut", "f.*").filter("lkind = rkind or (rcut and rkind = '')")
    # The less a title tells, the more the authors stand for it.
    kept = checkpointed(kept.withColumns({
        "telling_title": telling * F.col("title"), "telling_whole": telling * F.col("whole"), "weak_title": (1 - telling) * named * F.col("title"),
        "named": named, "unnamed": (F.col("names") < 0).cast("double"),
    }))
    weights = _curve(kept, list(ATTRIBUTES))
    score = F.lit(float(weights[0]))
    for name, x in zip(ATTRIBUTES, weights[1:]):
        score = score + F.lit(float(x)) * F.col(name)
    # The DOI settles the curve and so cannot be weighed by it: equal ones speak for a pair, others against it, as much as a title does.
    scored = kept.withColumn("score", score + F.col("doi") * F.lit(float(DOI_WEIGHT)))
    nearest = scored.groupBy("rfp").agg(F.max_by("lkind", "score").alias("near_kind"), F.max("score").alias("rbest"))
    nearest_l = scored.groupBy("lfp").agg(F.max("score").alias("lbest"))
    ranked = checkpointed(
        scored.join(nearest, "rfp").join(nearest_l, "lfp").withColumn("gap", F.least(F.col("score") - F.col("rbest"), F.col("score") - F.col("lbest"))).filter(F.col("lkind") == F.col("near_kind"))
    )
    c0, c1, c2 = (float(x) for x in _curve(ranked, ["score", "gap"]))
    confident = ranked.withColumn("confidence", 1 / (1 + F.exp(-(F.lit(c0) + F.lit(c1) * F.col("score") + F.lit(c2) * F.col("gap")))))
    members = lambda n, key, fp: docs.filter(F.col("side") == n).select(F.col("fp").alias(fp), F.col("id").alias(key))
    out = confident.join(members(0, left_id, "lfp"), "lfp").join(members(1, right_id, "rfp"), "rfp")
    return out.select(left_id, right_id, "confidence", "score", "gap", "title", "whole", "names", "year", "doi", "told", "hit", "lkind", "rkind")


def _curve(pairs: DataFrame, features: list[str]) -> np.ndarray:
    """Weights of a logistic curve over pairs of which the DOI says something, at most SAMPLE of them, by hash.

    Equal DOIs make a match, but for the odd wrong one; of pairs whose DOIs differ most are none, but a preprint and
    its publication are. So the labels of the latter start from a fixed curve and are settled in a few rounds, each
    fitted on what the one before says. Without pairs of both kinds the fixed curve stands.
    """
    prior = {"telling_title": 20.0, "telling_whole": 6.0, "weak_title": 26.0, "named": 4.0, "unnamed": 2.0, "year": 1.5, "hit": 0.0, "score": 1.0, "gap": 0.3}
    w = np.array([-24.0 if "hit" in features else 0.0, *(prior[f] for f in features)])
    known = pairs.filter("doi <> 0").select(*features, "doi").orderBy(F.xxhash64("lfp", "rfp")).limit(SAMPLE).toPandas()
    if (known["doi"] > 0).sum() < LABELLED or (known["doi"] < 0).sum() < LABELLED:
        return w
    x = np.c_[np.ones(len(known)), known[features].to_numpy(float)]
    for _ in range(ROUNDS):
        sure = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        kept = known[(known["doi"] < 0) | (sure > WRONG)]
        kept = kept.assign(y=np.where(kept["doi"] > 0, 1.0, sure[kept.index] > 0.5))
        if kept["y"].nunique() < 2:
            break
        w = _fit(kept, features)
    return w


def same_work(left: DataFrame, right: DataFrame, left_id: str, right_id: str, least: float = 0.5) -> DataFrame:
    """The pairs with a confidence of least or more that have an author or the DOI in common, or no author to compare."""
    matched = match_records(left, right, left_id, right_id)
    shared = (F.col("names") != 0) | (F.col("doi") > 0)
    return matched.filter(shared & (F.col("confidence") >= least)).select(left_id, right_id, "confidence")
