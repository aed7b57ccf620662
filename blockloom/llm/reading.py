"""Reading level of documents, from the grades at which words are acquired.

Labelled texts give each word a distribution over grades, evened out for how much text each grade has; the grade by
which a quarter of its use has come is the grade of its acquisition. A document is described by quantiles of the
grades of the words of its prose that are known. A ridge regression on labelled documents turns the quantiles into a
school grade; it is fitted on word grades that were learned without the document's own part of the labels.

Texts are read on the executors only: what the driver sees are the grades of words and a few numbers per labelled
document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Most labelled documents used for fitting; of more, those with the least hashes are taken.
LABELLED = 20_000
FOLDS = 5
SHARE = 0.25  # of a word's use that marks its acquisition
QUANTILES = (0.25, 0.5, 0.75, 0.9)
LEAST = 3  # uses of a word that is not rare

_FRONT = re.compile(r"\A---[ \t]*\n.*?\n(?:---|\.\.\.)[ \t]*(?:\n|\Z)", re.S)
_DROP = re.compile(r"<!--.*?-->|\{/\*.*?\*/\}|<(script|style|pre)\b.*?</\1\s*>|\$\$.*?\$\$|\\\[.*?\\\]|\\begin\{(equation|align|verbatim|lstlisting)\*?\}.*?\\end\{\2\*?\}", re.S | re.I)
_INLINE = re.compile(r"`[^`\n]*`|\\\(.*?\\\)|(?<![\w$\\])\$(?!\s)[^$\n]*[\\^_={}+][^$\n]*\$|!?\[[^\]\n]*\](?:\([^)\n]*\)|\[[^\]\n]*\])|\[\^[^\]\n]+\]|<[^<>\n]+>|https?://\S+|\[\[[^\]\n]*\]\]|\{\{[^}\n]*\}\}|&#?\w+;")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
_ASIDE = re.compile(r"#{1,6}(?:\s|$)|\||</?(?:h[1-6]|table|thead|tbody|tfoot|caption|tr|td|th)\b|\\(?:sub)*section\b|(=+)(?:\s*$|[ \t]*[^=\s].*\1\s*$)", re.I)  # heading or table
_UNDERLINE = re.compile(r"[ \t]*(=+|-+)[ \t]*\Z")
_ENTRY = re.compile(r"[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?")
_END = re.compile(r"[.!?]+(?=[\s\"')\]]|\Z)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def sentences(text: str) -> list[list[str]]:
    """Words of the sentences of the prose, in lower case.

    Front matter, headings, code, tables, formulas, markers, tags and links are left out. A paragraph, and each list
    entry, ends a sentence.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _FRONT.sub("", text, count=1)
    if "<" in text or "$$" in text or "\\" in text or "{/*" in text:
        text = _DROP.sub(lambda m: "\n" * m[0].count("\n"), text)
    parts: list[list[str]] = [[]]
    fence = ""
    for line in text.split("\n"):
        if m := _FENCE.match(line):
            if not fence:
                fence = m[1]
            elif m[1][0] == fence[0] and len(m[1]) >= len(fence):
                fence = ""
            parts.append([])
            continue
        if fence:
            continue
        s = line.strip()
        if not s or _ASIDE.match(s):
            if s and s[0] == "=" and _UNDERLINE.match(line):
                parts.pop()
            parts.append([])
        elif _UNDERLINE.match(line):
            parts.pop()  # the line before was a heading
            parts.append([])
        elif line.startswith(("    ", "\t")) and not parts[-1]:
            continue
        elif m := _ENTRY.match(line):
            parts.append([line[m.end() :]])
        else:
            parts[-1].append(s.lstrip("> ") if s[0] == ">" else s)
        if not parts:
            parts.append([])
    found = []
    for p in parts:
        if p:
            for s in _END.split(_INLINE.sub(" ", " ".join(p))):
                ws = _WORD.findall(s.lower())
                if ws:
                    found.append(ws)
    return found


def acquisition(uses: dict[int, int], total: dict[int, int]) -> float | None:
    """Grade of acquisition of a word, of its uses by grade and the number of words of each grade; None if it is rare."""
    if sum(uses.values()) < LEAST:
        return None
    rates = sorted((g, n / total[g]) for g, n in uses.items() if n)
    want, seen = SHARE * sum(r for _, r in rates), 0.0
    for g, r in rates:
        seen += r
        if seen >= want:
            return float(g)
    return float(rates[-1][0])


def features(counts: Mapping[str, int], grades: dict[str, float]) -> list[float]:
    """Quantiles of the grades of the known words, of the words of a prose and how often they occur."""
    known = sorted((grades[w], n) for w, n in counts.items() if w in grades)
    total, q, at, seen = sum(n for _, n in known), [], 0, 0
    for x in QUANTILES:
        while known and seen + known[at][1] <= min(int(x * total), total - 1):
            seen += known[at][1]
            at += 1
        q.append(known[at][0] if known else 0.0)
    return [1.0, *q]


class Model:
    """Word grades and weights."""

    def __init__(self, grades: dict[str, float], weights: np.ndarray):
        self.grades, self.weights = grades, weights

    def level(self, text: str | None) -> float | None:
        """School grade of a text; null where it has no prose."""
        counts = prose(text)
        return float(np.dot(features(counts, self.grades), self.weights)) if counts else None


def prose(text: str | None) -> Counter:
    """The words of the prose of a text and how often they occur."""
    return Counter(w for s in sentences(text) for w in s) if text else Counter()


def labels(reading_labels: DataFrame) -> DataFrame:
    """One grade per document: the mean over its raters, each rater counting once. Null grades do not count."""
    per_rater = reading_labels.where("grade is not null and doc_id is not null").groupBy("doc_id", "rater").agg(F.avg("grade").alias("grade"))
    return per_rater.groupBy("doc_id").agg(F.avg("grade").alias("grade"))


def english(lang: Column) -> Column:
    return F.coalesce(F.lower(F.trim(lang)).rlike(r"^en([-_].*)?$"), F.lit(False))


def train(documents: DataFrame, reading_labels: DataFrame, limit: int = LABELLED) -> Model | None:
    """Fit on at most ``limit`` labelled English documents, a sample by hash that is the same at every size of the rest.

    Documents that cannot be used do not count. The sample is chosen by id, so that no text is shuffled, and broadcast:
    it is at most ``limit`` numbers.
    """
    spark = documents.sparkSession
    usable = documents.where(english(F.col("lang")) & (F.length("text") > 0)).select("doc_id")
    known = labels(reading_labels).join(usable, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = documents.join(F.broadcast(known), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "grade", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = [xxhash.xxh3_64_intdigest(str(i)) % FOLDS for i in b.column(0).to_pylist()]
            counts = [prose(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fold, pa.int32()), pa.array([list(c.items()) for c in counts], pa.map_(pa.string(), pa.int64()))], names=["doc_id", "grade", "fold", "words"])

    read_once = stored(chosen.mapInArrow(read, "doc_id long, grade double, fold int, words map<string,long>").where("size(words) > 0"), "labelled")
    uses = read_once.select("fold", F.bround("grade").cast("int").alias("g"), F.explode("words").alias("word", "n")).groupBy("word", "fold", "g").agg(F.sum("n").alias("n"))
    uses = stored(uses, "uses")
    total = {(r["fold"], r["g"]): r["n"] for r in uses.groupBy("fold", "g").agg(F.sum("n").alias("n")).collect()}  # folds by grades
    if not total:
        return None
    by_fold: list[dict[int, int]] = []  # words of each grade outside a fold; at the end, of all
    for k in range(FOLDS + 1):
        outside: Counter = Counter()
        for (f, g), n in total.items():
            if f != k:
                outside[g] += n
        by_fold.append(dict(outside))

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list[float | None]] = [[] for _ in range(FOLDS + 1)]
            for cells in b.column(1).to_pylist():
                for k in range(FOLDS + 1):
                    own: Counter = Counter()
                    for c in cells:
                        if c["fold"] != k:
                            own[c["g"]] += c["n"]
                    found[k].append(acquisition(own, by_fold[k]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.float64()) for x in found)], names=["word", *(f"g{k}" for k in range(FOLDS + 1))])

    cells = uses.groupBy("word").agg(F.collect_list(F.struct("fold", "g", "n")).alias("cells"))  # at most folds by grades
    rows = cells.mapInArrow(graded, "word string, " + ", ".join(f"g{k} double" for k in range(FOLDS + 1))).where(f"g{FOLDS} is not null")
    grades: list[dict[str, float]] = [{} for _ in range(FOLDS + 1)]
    for r in rows.toLocalIterator():  # the words of the sample that are not rare
        for k in range(FOLDS + 1):
            if r[1 + k] is not None:
                grades[k][r[0]] = r[1 + k]
    shared = spark.sparkContext.broadcast(grades)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(dict(w), shared.value[f]) for f, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "grade", "x"])

    points = sorted(tuple(r) for r in read_once.mapInArrow(described, "doc_id long, grade double, x array<double>").collect())  # at most ``limit``
    a = np.array([x for _, _, x in points])
    penalty = np.diag([1e-6] + [0.5] * (a.shape[1] - 1))
    return Model(grades[FOLDS], np.linalg.solve(a.T @ a + penalty, a.T @ np.array([g for _, g, _ in points])))


def levels(documents: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and ``level`` of every document; null without prose or without a model."""
    if model is None:
        return documents.select("doc_id", F.lit(None).cast("double").alias("level"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # its size is bound by the labelled sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.level(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "level"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, level double")


def judged(documents: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``level`` and ``status`` of every row of ``documents`` (doc_id, lang, text).

    The labels are of English texts, so a document in another or an unknown language is ``not calibrated``; one without
    words of prose has ``no prose``; without labels there is ``no model``. These have a null level, all others are
    ``levelled``. Only English texts go to the Python stage.
    """
    is_english = english(F.col("lang"))
    other = documents.where(~is_english).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("double").alias("level"), F.lit("not calibrated").alias("status"))
    known = levels(documents.where(is_english), model)
    status = F.when(F.col("level").isNotNull(), "levelled").otherwise("no model" if model is None else "no prose")
    return known.select(F.col("doc_id").cast("long").alias("doc_id"), "level", status.alias("status")).unionByName(other)
