"""Subject areas of each document, one or more, from few labelled passages and the corpus itself.

1. Texts become sentences (markup, headings, identifiers and code stripped) and sentences become hashed
   words, so a model has a fixed size whatever the corpus.
2. Word evidence per area, and for sentences about none of them, starts from the labelled passages and is
   completed by expectation-maximisation over all documents: a sentence belongs to an area or to none, and
   the areas of its document's other sentences speak for it. A sentence form (names and numbers left out)
   that stands alike in documents of many areas is about none. Counts add up per task before they meet.
3. Per document and area the terms give evidence: how far the sentences about it, each with its chance, exceed the
   fifth that counts. Evidence, source and structure feed a classifier chain: the decision on an area sees the
   decisions on those before it, so areas that occur together are modelled. The chain is fitted on a bounded sample
   of the corpus, in which a share of the words is struck out before the evidence is taken while the labels come from
   the whole texts (so it learns what source, structure and other areas say where terms are few), and on composed
   documents whose labels are known. Its scores are calibrated on rows kept apart; a beam search finds the most
   probable combination of labels.

Null and empty texts, and texts without sentences, have no area. Unknown sources weigh nothing.
Repeated rows are labelled alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.session import checkpointed, spread

#: Word buckets of the model for each language told apart, and of sentences in none of them.
PER_LANGUAGE = 1 << 15
#: Passes of expectation-maximisation over the corpus.
PASSES = 6
#: Weight of a labelled passage against a document.
LABELLED = 4.0
#: A form is about none where it makes up this share of all sentences (so there are at most 1 / FORM_SHARE),
#: occurs FORM_COUNT times and no more than FORM_TOP of that in documents mainly about one area.
FORM_SHARE, FORM_COUNT, FORM_TOP = 1e-5, 8, 0.6
#: Labelled rows read for fitting, at most.
LABELLED_ROWS = 50_000
#: Share of the sentences from which a document is about an area.
SHARE = 0.2
#: Documents of the corpus and composed documents on which the chain is fitted, at most; most words of such a document;
#: share of the words kept for the evidence; width of the beam.
SAMPLE_DOCS, COMPOSED, SAMPLE_WORDS, KEPT, BEAM = 4000, 2000, 4000, 0.6, 8
#: Kinds of source told apart make up this share of the documents, so there are at most 1 / SOURCE_SHARE.
SOURCE_SHARE = 1e-3

# Function words that tell the languages apart.
FUNCTION_WORDS = (
    frozenset("a an the of and in was were are be as to or for that it is at by we has had not when which each both no this from with".split()),
    frozenset("der die das und wurde wurden für liegt bei nach von ist sich mit den dem ein eine nicht zu am im".split()),
    frozenset("le la les et de du des est une un pour sur on dans que après diffère au aux à ne pas".split()),
)
BUCKETS = PER_LANGUAGE * (len(FUNCTION_WORDS) + 1)

_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_TEX = re.compile(r"\\(?:section|subsection|paragraph|title|label|cite\w*|ref|begin|end)\*?\{[^{}]*\}")
_FIELD = re.compile(r"^\s*-?\s*(?:id|ref|key|date|version|source|page|state)\s*:.*$", re.I)
_LEAD = re.compile(r"^\s*(?:[-*•>]+\s+|\d{1,3}[.)]\s+|(?:text|quote|note|claim|title|abstract)\s*:\s*)+", re.I)
_ORDINAL = re.compile(r"\b((?:am|vom|zum|im|der|des|dem|den)\s+\S*\d\S*)\.(?=\s+[A-ZÄÖÜ])")
_END = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+(?=[\"'“«(\[]*[A-ZÀ-ÞΑ-Ω\d])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence. A heading, a list of fields or a lone identifier is none."""
    if not text:
        return []
    out = []
    for line in _TEX.sub("\n", _CODE.sub("\n", text)).split("\n"):
        if not line.strip() or line.lstrip().startswith("#") or _FIELD.match(line):
            continue
        line = _LEAD.sub("", line).strip().strip('"')
        for s in _END.split(_ORDINAL.sub(r"\1", line)):
            words = _WORD.findall(s)
            if len(words) >= 3 and (s.rstrip("\"'”»)] ")[-1:] in ".!?…:;" or len(words) >= 6):
                out.append(words)
    return out


_SPOKEN = {w: [i for i, f in enumerate(FUNCTION_WORDS) if w in f] for f in FUNCTION_WORDS for w in f}


@lru_cache(maxsize=1 << 18)
def _read_word(word: str) -> tuple[int, bool, tuple[int, ...]]:
    """(hash within a language, starts with a lower-case letter, languages it is a function word of)."""
    low = word.lower()
    return zlib.crc32(low.encode()) & (PER_LANGUAGE - 1), word[0].islower(), tuple(_SPOKEN.get(low, ()))


def hashes(found: list[list[str]]) -> list[list[int]]:
    """Word buckets of each sentence, those of each language apart; names inside a sentence are left out where
    only names have a capital."""
    none = len(FUNCTION_WORDS)
    read, spoken = [], []
    for s in found:
        words = [_read_word(w) for w in s]
        hits = [0] * none
        for _, _, langs in words:
            for lang in langs:
                hits[lang] += 1
        best = max(range(none), key=hits.__getitem__)
        read.append(words)
        spoken.append(best if hits[best] else none)
    usual = max(set(spoken), key=spoken.count) if spoken else 0
    out = []
    for words, lang in zip(read, spoken):
        lang = usual if lang == none else lang
        base = lang * PER_LANGUAGE
        out.append([base + h for i, (h, low, _) in enumerate(words) if lang == 1 or low or not i])
    return out


def form_of(buckets: list[int]) -> int:
    return xxhash.xxh64_intdigest(np.array(buckets, dtype=np.int32).tobytes()) >> 1


def _structure(text: str | None) -> float:
    """Share of the lines that are headings, list items or fields."""
    lines = [x.lstrip() for x in (text or "").split("\n") if x.strip()]
    return sum(x[:1] in ("-", "*", "#") or bool(_FIELD.match(x)) for x in lines) / len(lines) if lines else 0.0


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ends, forms, lists = [], [], [], []
        for text in batch.column("text").to_pylist():
            flat: list[int] = []
            cut: list[int] = []
            found = hashes(sentences(text))
            for s in found:
                flat += s
                cut.append(len(flat))
            words.append(flat), ends.append(cut), forms.append([form_of(s) for s in found]), lists.append(_structure(text))
        yield pa.RecordBatch.from_pydict(
            {
                "id": batch.column("id"), "tag": batch.column("tag"), "words": pa.array(words, pa.list_(pa.int32())),
                "ends": pa.array(ends, pa.list_(pa.int32())), "forms": pa.array(forms, pa.list_(pa.int64())), "lists": pa.array(lists, pa.float32()),
            }
        )


def hashed(df: DataFrame, key: str, text: str, tag: str) -> DataFrame:
    """(id, tag, words, ends, forms, lists): hashed words of all sentences, where each ends, its form, share of lines that are structure."""
    rows = df.select(F.col(key).alias("id"), F.col(tag).cast("string").alias("tag"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(_hashed, "id long, tag string, words array<int>, ends array<int>, forms array<long>, lists float")


class Batch:
    """Documents of one Arrow batch as flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        words, ends = batch.column("words"), batch.column("ends")
        self.words = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n_words = np.diff(words.offsets.to_numpy())
        n_sentences = np.diff(ends.offsets.to_numpy())
        base = np.repeat(np.cumsum(n_words) - n_words, n_sentences)
        self.ends = ends.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + base
        self.starts = np.r_[0, self.ends[:-1]] if len(self.ends) else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(n_sentences)), n_sentences)
        self.docs = len(n_sentences)
        self.n_sentences = n_sentences
        self.forms = batch.column("forms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    def per_document(self, rows: np.ndarray) -> np.ndarray:
        """Sums over the sentences of each document, which lie side by side."""
        out = np.zeros((self.docs, rows.shape[1]))
        held = np.flatnonzero(self.n_sentences)
        if len(held):
            out[held] = np.add.reduceat(rows, (np.cumsum(self.n_sentences) - self.n_sentences)[held], axis=0)
        return out

    def posterior(self, model: np.ndarray, general: np.ndarray, allowed: np.ndarray | None = None, rounds: int = 4) -> np.ndarray:
        """Probability of each class for each sentence; a document's classes are found along with its sentences'."""
        k = model.shape[1]
        if not len(self.ends):
            return np.zeros((0, k))
        fit = np.add.reduceat(model[self.words], self.starts, axis=0)
        if allowed is not None:
            fit = np.where(allowed[self.doc], fit, -1e9)
        fit[:, -1] -= 3.0
        none = np.isin(self.forms, general)
        fit[none, :-1] = -1e9
        fit -= fit.max(axis=1, keepdims=True)
        like = np.exp(fit)
        theta = np.full((self.docs, k), 1.0 / k)
        for _ in range(rounds):
            r = like * theta[self.doc]
            r /= r.sum(axis=1, keepdims=True)
            theta = self.per_document(r)
            # Areas are sparse in a document; the last class, none of them, always stays open.
            theta += 0.02
            theta[:, -1] += 0.2
            theta /= theta.sum(axis=1, keepdims=True)
        return r

    def counts(self, r: np.ndarray) -> np.ndarray:
        each = np.repeat(r, np.diff(np.r_[self.starts, self.ends[-1:]]), axis=0)
        return np.stack([np.bincount(self.words, weights=each[:, c], minlength=BUCKETS) for c in range(r.shape[1])], axis=1)


def _step(model: np.ndarray, general: np.ndarray) -> Callable:
    """One pass: expected word counts per class, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, model.shape[1]))
        for batch in batches:
            b = Batch(batch)
            if len(b.ends):
                total += b.counts(b.posterior(model, general))
        at = np.flatnonzero(total.sum(axis=1))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(list(total[at]), pa.list_(pa.float64()))})

    return run


def _log_model(counts: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Log-probabilities of the words within each language, smoothed towards the language as a whole.

    shared words, those that labelled passages of many areas hold, are equally probable in every area: how
    often a turn of phrase happens to stand in the passages of one says nothing about it.
    """
    out = np.empty_like(counts, dtype=np.float32)
    for lang in range(len(FUNCTION_WORDS) + 1):
        at = slice(lang * PER_LANGUAGE, (lang + 1) * PER_LANGUAGE)
        part, alike = counts[at], shared[at]
        words = part.sum(axis=1) + 1e-3
        totals = part.sum(axis=0)
        background = words / words.sum()
        smooth = 40.0
        p = (part + smooth * background[:, None]) / (totals + smooth)
        pooled = (part[:, :-1].sum(axis=1) + smooth * background) / (totals[:-1].sum() + smooth)
        p[alike, :-1] = pooled[alike, None]
        out[at] = np.log(p)
    return out


def _forms(model: np.ndarray, general: np.ndarray) -> Callable:
    """(form, area, n): in how many sentences of documents mainly about an area each form occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Batch(batch)
            if not len(b.ends):
                continue
            soft, _ = document_shares(b, b.posterior(model, general))
            main = soft.argmax(axis=1)[b.doc]
            clear = soft.max(axis=1)[b.doc] > 0.3
            pairs, n = np.unique(np.stack([b.forms[clear], main[clear]]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_pydict({"form": pa.array(pairs[0], pa.int64()), "area": pa.array(pairs[1], pa.int32()), "n": pa.array(n, pa.int64())})

    return run


def general_forms(documents: DataFrame, model: np.ndarray, general: np.ndarray) -> np.ndarray:
    """Forms of sentences about none of the areas, from their spread over documents; bounded by FORM_SHARE."""
    spread = documents.select("words", "ends", "forms").mapInArrow(_forms(model, general), "form long, area int, n long")
    each = checkpointed(
        spread.groupBy("form", "area").agg(F.sum("n").alias("n")).groupBy("form").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count("*").alias("areas"))
    )
    total = each.agg(F.sum("n")).first()[0] or 0
    rows = each.filter((F.col("n") >= max(FORM_COUNT, FORM_SHARE * total)) & (F.col("top") <= FORM_TOP * F.col("n")) & (F.col("areas") > 2)).select("form").collect()
    return np.array([r["form"] for r in rows], dtype=np.int64)


def fit_words(documents: DataFrame, passages: list[tuple[list[list[str]], int]], areas: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each word bucket per area and, last, for sentences about none; the forms about none."""
    batch = Batch(_as_batch([p for p, _ in passages]))
    label = np.array([a for _, a in passages])
    allowed = np.zeros((len(passages), areas + 1), bool)
    allowed[np.arange(len(passages)), label] = True
    allowed[:, -1] = True
    # To begin with, forms that passages of several areas have in common are about none.
    seen: dict[int, set[int]] = {}
    for form, a in zip(batch.forms, label[batch.doc]):
        seen.setdefault(form, set()).add(a)
    general = np.array([f for f, a in seen.items() if len(a) > 1], dtype=np.int64)
    r = np.zeros((len(batch.ends), areas + 1))
    r[np.arange(len(r)), np.where(np.isin(batch.forms, general), areas, label[batch.doc])] = 1.0
    first = batch.counts(r) + 1e-6
    shared = (first[:, :areas] > 0.5).sum(axis=1) > 2
    model = _log_model(first, shared)
    for turn in range(PASSES):
        if turn == 2:
            general = np.union1d(general, general_forms(documents, model, general))
        fixed = LABELLED * batch.counts(batch.posterior(model, general, allowed))
        rows = (
            documents.select("words", "ends", "forms")
            .mapInArrow(_step(model, general), "bucket int, n array<double>")
            .groupBy("bucket")
            .agg(F.array(*[F.sum(F.col("n")[c]) for c in range(areas + 1)]).alias("n"))
            .toArrow()  # at most BUCKETS rows
        )
        at = rows.column("bucket").to_numpy()
        if len(at):
            fixed[at] += rows.column("n").combine_chunks().flatten().to_numpy().reshape(len(at), areas + 1)
        model = _log_model(fixed + 1e-6, shared)
    return model, general


def _as_batch(texts: list[list[list[str]]]) -> pa.RecordBatch:
    each = [hashes(t) for t in texts]
    words = [[w for s in t for w in s] for t in each]
    ends = [list(np.cumsum([len(s) for s in t])) for t in each]
    return pa.RecordBatch.from_pydict({"words": pa.array(words, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32())), "forms": pa.array([[form_of(s) for s in t] for t in each], pa.list_(pa.int64()))})


def evidence(b: Batch, r: np.ndarray) -> np.ndarray:
    """Per document and area, of the chances r of the sentences: by how many deviations the sentences about it exceed
    the count that makes the share, and their mean chance."""
    sums, doubt = b.per_document(r), b.per_document(r * (1 - r))
    needed = np.ceil(SHARE * b.n_sentences - 1e-9)[:, None]
    over = (sums - needed + 0.5) / np.sqrt(doubt + 0.01)
    share = sums / np.maximum(b.n_sentences, 1)[:, None]
    return np.stack([np.clip(over, -8, 8), np.clip((share - SHARE) * 12, -3, 3)], axis=2)[:, :-1]


def features(own: np.ndarray, n: np.ndarray, listed: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Per document and area: the evidence of its terms, then structure and source, the same for all areas."""
    common = np.c_[np.log1p(n), listed, source]
    return np.concatenate([own, np.repeat(common[:, None, :], own.shape[1], axis=1)], axis=2)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chain:
    """A logistic decision per area, each seeing those before it, calibrated, and decoded by beam search."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.order = np.argsort(-y.mean(axis=0), kind="stable")
        mixed = np.random.default_rng(5).permutation(len(x))
        x, y = x[mixed], y[mixed]
        part = len(x) * 3 // 4
        self.weights, self.scales = [], []
        for i, a in enumerate(self.order):
            z = np.c_[np.ones(len(x)), x[:, a], y[:, self.order[:i]]]
            w = _logistic(z[:part], y[:part, a])
            score = z[part:] @ w
            self.weights.append(w)
            self.scales.append(_logistic(np.c_[np.ones(len(score)), score], y[part:, a], 0.1))

    def decode(self, x: np.ndarray) -> np.ndarray:
        docs, areas = x.shape[0], x.shape[1]
        labels = np.zeros((docs, 1, areas))
        scores = np.zeros((docs, 1))
        for i, a in enumerate(self.order):
            w, (c0, c1) = self.weights[i], self.scales[i]
            own = w[0] + x[:, a] @ w[1 : 1 + x.shape[2]]
            before = labels[:, :, self.order[:i]] @ w[1 + x.shape[2] :]
            z = c0 + c1 * (own[:, None] + before)
            yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
            on = labels.copy()
            on[:, :, a] = 1
            labels = np.concatenate([labels, on], axis=1)
            scores = np.concatenate([scores + no, scores + yes], axis=1)
            top = np.argsort(-scores, axis=1, kind="stable")[:, :BEAM]
            labels = np.take_along_axis(labels, top[:, :, None], axis=1)
            scores = np.take_along_axis(scores, top, axis=1)
        return labels[:, 0, :]


def _thinned(b: Batch, rng: np.random.Generator) -> Batch:
    """The same documents with a share of the words struck out; every sentence keeps one."""
    kept = rng.random(len(b.words)) < KEPT
    kept[b.starts] = True
    out = Batch.__new__(Batch)
    out.words, out.ends = b.words[kept], np.cumsum(kept)[b.ends - 1] if len(b.ends) else b.ends
    out.starts = np.r_[0, out.ends[:-1]] if len(out.ends) else out.ends
    out.doc, out.docs, out.n_sentences, out.forms = b.doc, b.docs, b.n_sentences, b.forms
    return out


def _sampled(documents: DataFrame, model: np.ndarray, general: np.ndarray, sources: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features, from thinned texts, and labels, from whole ones, of at most SAMPLE_DOCS documents of the corpus."""
    some = documents.filter((F.size("ends") > 0) & (F.size("words") <= SAMPLE_WORDS)).orderBy(F.xxhash64("id")).limit(SAMPLE_DOCS)
    table = some.toArrow().combine_chunks()
    areas = model.shape[1] - 1
    xs, ys = [np.zeros((0, areas, 4 + len(sources)))], [np.zeros((0, areas))]
    rng = np.random.default_rng(11)
    for batch in table.to_batches(max_chunksize=200):
        b = Batch(batch)
        _, hard = document_shares(b, b.posterior(model, general))
        thin = _thinned(b, rng)
        xs.append(features(evidence(thin, thin.posterior(model, general)), b.n_sentences, np.array(batch.column("lists").to_pylist()), _one_hot(batch.column("tag").to_pylist(), sources)))
        ys.append((hard >= SHARE - 1e-9).astype(float))
    return np.concatenate(xs), np.concatenate(ys)


def _one_hot(tags: list[str | None], sources: list[str]) -> np.ndarray:
    at = {t: i for i, t in enumerate(sources)}
    out = np.zeros((len(tags), len(sources)))
    for i, t in enumerate(tags):
        if t in at:
            out[i, at[t]] = 1
    return out


def _compose(passages: list[tuple[list[list[str]], int]], model: np.ndarray, general: np.ndarray, areas: int, sources: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of documents put together from labelled sentences, around the share that counts; of no source."""
    rng = np.random.default_rng(7)
    batch = Batch(_as_batch([p for p, _ in passages]))
    label = np.array([a for _, a in passages])
    allowed = np.zeros((len(passages), areas + 1), bool)
    allowed[np.arange(len(passages)), label] = True
    allowed[:, -1] = True
    truth = batch.posterior(model, general, allowed).argmax(axis=1)
    flat = [s for p, _ in passages for s in p]
    pools = [[flat[i] for i in np.flatnonzero(truth == c)] for c in range(areas + 1)]
    texts, labels = [], []
    for _ in range(COMPOSED):
        n = int(rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 30]))
        some = rng.permutation(areas)[: int(rng.choice([1, 2, 3], p=[0.6, 0.3, 0.1]))]
        none = rng.choice([0.0, 0.2, 0.4, 0.85])
        weights = rng.dirichlet(np.ones(len(some)) * 1.2) * (1 - none)
        kinds = rng.choice([*some, areas], size=n, p=[*weights, max(0.0, 1 - weights.sum())])
        kinds = np.array([k if pools[k] else areas for k in kinds])
        if not all(pools[k] for k in kinds):
            continue
        texts.append([pools[k][rng.integers(len(pools[k]))] for k in kinds])
        labels.append([(kinds == a).mean() >= SHARE - 1e-9 for a in range(areas)])
    b = Batch(_as_batch(texts))
    x = features(evidence(b, b.posterior(model, general)), b.n_sentences, np.zeros(len(texts)), np.zeros((len(texts), sources)))
    return x, np.array(labels, float).reshape(len(texts), areas)


def document_shares(b: Batch, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document, of the chances r of its sentences, the mean chance of each area and the share of sentences it wins."""
    won = np.zeros_like(r)
    if len(r):
        won[np.arange(len(r)), r.argmax(axis=1)] = 1.0
    n = np.maximum(b.n_sentences, 1)[:, None]
    return (b.per_document(r) / n)[:, :-1], (b.per_document(won) / n)[:, :-1]


def _label(model: np.ndarray, general: np.ndarray, chain: Chain, names: list[str], sources: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Batch(batch)
            r = b.posterior(model, general)
            _, hard = document_shares(b, r)
            listed = np.array(batch.column("lists").to_pylist(), dtype=float)
            x = features(evidence(b, r), b.n_sentences, listed, _one_hot(batch.column("tag").to_pylist(), sources))
            y = chain.decode(x) * (b.n_sentences > 0)[:, None] if b.docs else np.zeros((0, len(names)))
            doc, area = np.nonzero(y)
            ids = np.array(batch.column("id").to_pylist(), dtype=np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids[doc] if len(doc) else [], pa.int64()),
                    "area": pa.array([names[a] for a in area], pa.string()),
                    "share": pa.array(hard[doc, area] if len(doc) else [], pa.float64()),
                }
            )

    return run


def subject_areas(documents: DataFrame, examples: DataFrame, areas: list[str]) -> DataFrame:
    """(doc_id, area, share) of documents(doc_id, text, source); share is that of the sentences about the area."""
    names = sorted(areas)
    labelled = examples.filter(F.col("area").isin(*names)).orderBy("example_id").limit(LABELLED_ROWS).select("text", "area").collect()
    passages = [(s, names.index(r["area"])) for r in labelled if (s := sentences(r["text"]))]
    docs = checkpointed(hashed(documents, "doc_id", "text", "source"))
    tags = checkpointed(docs.filter("tag is not null").groupBy("tag").count())
    total = tags.agg(F.sum("count")).first()[0] or 0
    sources = sorted(r["tag"] for r in tags.filter(F.col("count") >= SOURCE_SHARE * total).collect())
    if not passages:
        return docs.sparkSession.createDataFrame([], "doc_id long, area string, share double")
    model, general = fit_words(docs, passages, len(names))
    parts = [_compose(passages, model, general, len(names), len(sources)), _sampled(docs, model, general, sources)]
    chain = Chain(*(np.concatenate(p) for p in zip(*parts)))
    return docs.mapInArrow(_label(model, general, chain, names, sources), "doc_id long, area string, share double")
