"""Toxicity by a weighted lexicon.

Texts are folded character by character: lower case, accents and look-alike letters of other scripts to Latin ones. Digits
and signs that stand for letters are folded in a second and third view of a text that has some. An Aho-Corasick automaton
finds the lexicon's words in all views at once; matches count between word boundaries, once per place, and not inside an
exception phrase. The summed weights, and the sum for the text's length, are turned into a probability by a logistic curve.

The lexicon and its weights are learned from a bounded sample of labelled documents: words whose share in toxic documents
exceeds chance by a log-likelihood ratio that also covers the number of words tried.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from offerloom.llm.near_dedup import shingles
from offerloom.llm.samples import labelled_sample
from offerloom.llm.texts import crc32_of_id, table
from offerloom.plans.lineage import cut

#: Most labelled documents that the lexicon and the curve are fitted on.
SAMPLE = 20_000
#: Most words in the lexicon, the strongest first.
LEXICON = 2_000
#: Log-likelihood ratio asked of a word, beside the log of the number of words tried.
EVIDENCE = 3.0
LEVEL = 0.7
#: Most phrases that are learned as exceptions.
EXCEPTIONS_KEPT = 500
#: Phrases in which lexicon words are harmless whatever the sample says.
EXCEPTIONS = ("trash can", "trash bin", "class clown fish", "clown fish", "sore loser rule", "stupid mistake of mine", "idiot proof", "idiot board")

#: Look-alike letters, letter by letter.
_LOOKS = str.maketrans(
    "абвгеёзикмнорстухһіјѕԁԛԝαβεηικμνορτυχγωϲıɑɡʟ",
    "abvreeznkmhopctyxhijsdqwabenikuvoptuxywciagl",
)
_ACCENTED = {c: unicodedata.normalize("NFKD", chr(c))[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)] if unicodedata.normalize("NFKD", chr(c))[0].isascii()}
_FOLD = _ACCENTED | _LOOKS
#: Digits, then also signs, that stand for letters.
_DIGITS = str.maketrans("0134578", "oieastb")
_SIGNS = _DIGITS | str.maketrans("@$!|+", "asiit")
_HAS_DIGIT, _HAS_SIGN = re.compile("[0134578]"), re.compile(r"[@$!|+]")
#: A word: letters and their marks. Of scripts that leave no spaces every two and three neighbours count as words.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{2,}")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}][\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}\p{M}]+")
_PHRASE = regex.compile(r"(?=(?<![\p{L}\p{M}])(\p{L}[\p{L}\p{M}]* \p{L}[\p{L}\p{M}]*))")
_cache: dict = {}


def fold(text: str) -> str:
    """Lower case without accents and look-alikes; every character stays one character."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[0] for c in text)
    return low if low.isascii() else low.translate(_FOLD)


def views(text: str) -> list[str]:
    """The folded text, and with digits, then also signs, read as letters if it has some."""
    found = [fold(text)]
    if digit := _HAS_DIGIT.search(found[0]):
        found.append(found[0].translate(_DIGITS))
    if _HAS_SIGN.search(found[0]):
        found.append(found[0].translate(_SIGNS))
    return found if digit or len(found) > 1 else found[:1]


def words_of(view: str) -> Iterator[str]:
    """The words of a folded text that a lexicon may hold."""
    spaced = view if view.isascii() else _UNSPACED.sub(" ", view)
    yield from _WORD.findall(spaced)
    if spaced is not view:
        for run in _UNSPACED.findall(view):
            yield from (run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1))


class Matcher:
    """Weighted lexicon and exception phrases in one automaton. A word of a script with spaces counts only where it stands alone."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            self.automaton.add_word(fold(phrase), (phrase, None))
        self.inner = set()
        for word, weight in lexicon.items():
            self.automaton.add_word(word, (word, weight))
            if _UNSPACED.fullmatch(word):
                self.inner.add(word)
        if len(self.automaton):
            self.automaton.make_automaton()

    def places(self, text: str) -> dict[int, tuple[str, float]]:
        """Start of each match that counts: its word and weight; of several at one start the longest."""
        hits: dict[int, tuple[str, float]] = {}
        spans: list[tuple[int, int]] = []
        if not len(self.automaton):
            return hits
        for view in views(text):
            for end, (word, weight) in self.automaton.iter(view):
                start = end - len(word) + 1
                if word not in self.inner and ((start and view[start - 1].isalpha()) or (end + 1 < len(view) and view[end + 1].isalpha())):
                    continue
                if weight is None:
                    spans.append((start, end))
                elif len(word) > len(hits.get(start, ("",))[0]):
                    hits[start] = (word, weight)
        return {s: h for s, h in hits.items() if not any(a <= s and s + len(h[0]) - 1 <= b for a, b in spans)}

    def measures(self, text: str | None) -> tuple[float, float, int]:
        """Summed weights, the same per hundred words (of at least twenty), number of matches."""
        text = text or ""
        hits = self.places(text)
        total = sum(w for _, w in hits.values())
        return total, 100 * total / max(20, text.count(" ") + text.count("\n") + 1) if hits else 0.0, len(hits)


def _matcher(lexicon: dict[str, float], exceptions: tuple[str, ...]) -> Matcher:
    key = tuple(sorted(lexicon.items())), exceptions
    if _cache.get("key") != key:
        _cache.update(key=key, matcher=Matcher(lexicon, exceptions))
    return _cache["matcher"]


_MEASURES = T.StructType([T.StructField("total", T.DoubleType()), T.StructField("density", T.DoubleType()), T.StructField("matches", T.IntegerType())])


def measure_with(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
    """A column function: text to total, density, matches."""

    @F.pandas_udf(_MEASURES)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _matcher(lexicon, exceptions)
        for batch in texts:
            yield pd.DataFrame([own.measures(t) for t in batch], columns=_MEASURES.names).astype({"matches": "int32"})

    return run


@F.pandas_udf(T.LongType())
def least_shingle(texts: pd.Series) -> pd.Series:
    """The smallest shingle hash: equal for copies and for most near copies."""
    return texts.map(lambda t: int(s[0] >> np.uint64(1)) if len(s := shingles((t or "").encode("utf-8", "surrogatepass"))) else -1).astype("int64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted({w for v in views(t or "") for w in words_of(v)}))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words of the labelled sample (text, label) with evidence of toxicity, and their log-odds."""
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return {}
    words = sample.select("label", F.explode(folded_words("text")).alias("word")).groupBy("word")
    words = words.agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")).filter("t >= 3")
    share = toxic / (toxic + clean)
    t, n_, c = F.col("t"), F.col("n"), F.col("n") - F.col("t")
    words = words.withColumn("ratio", t * F.log(t / (n_ * share)) + F.when(c > 0, c * F.log(c / (n_ * (1 - share)))).otherwise(0.0))
    words = words.withColumn("weight", F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1)))
    tried = words.count()
    kept = words.filter((F.col("weight") > 1.0) & (F.col("ratio") >= EVIDENCE + np.log(max(tried, 1)).item()))
    return {r["word"]: round(r["weight"], 6) for r in kept.orderBy(F.desc("ratio"), "word").limit(LEXICON).collect()}


def learn_exceptions(sample: DataFrame, lexicon: dict[str, float]) -> tuple[str, ...]:
    """Two words in a row, one of them of the lexicon, that stand in clean texts only, and more often than chance would have it.

    With the share s of texts with the word that are toxic, n texts with the phrase are all clean with (1 - s) to the n; that must be
    below one in a hundred, divided by the number of phrases tried. The most frequent EXCEPTIONS_KEPT are kept, and the fixed ones.
    """
    if not lexicon:
        return EXCEPTIONS

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("phrase", T.StringType())])))
    def held(texts: pd.Series) -> pd.Series:
        def of(text: str) -> list[tuple[str, str]]:
            view = fold(text or "")
            phrases = {(w, p) for p in _PHRASE.findall(view) for w in p.split(" ") if w in lexicon}
            return sorted(phrases | {(w, "") for w in words_of(view) if w in lexicon})

        return texts.map(of)

    rows = sample.select("label", F.explode(held("text")).alias("x")).groupBy("x.word", "x.phrase").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t"))
    words = rows.filter("phrase = ''").select("word", (F.col("t") / F.col("n")).alias("share"))
    clean = rows.filter("phrase <> '' and t = 0").join(words, "word")
    tried = max(clean.count(), 1)
    sure = clean.filter(F.col("n") * F.log(F.greatest(1 - F.col("share"), F.lit(1e-12))) < float(np.log(0.01 / tried)))
    return (*EXCEPTIONS, *(r["phrase"] for r in sure.groupBy("phrase").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "phrase").limit(EXCEPTIONS_KEPT).collect()))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps; the ridge keeps separable data finite. Without both labels the curve is flat and low."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    if len(np.unique(y)) < 2:
        return np.array([-3.0, *w[1:]])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.diag([1e-3] + [1.0] * (len(w) - 1))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """A lexicon, phrases in which its words are harmless, and the curve over log(1 + total) and log(1 + density)."""

    def __init__(self, lexicon: dict[str, float], curve: list[float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.lexicon, self.curve, self.exceptions = lexicon, curve, exceptions


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = cut(labelled_sample(docs, labels, "toxic", SAMPLE).withColumn("least", least_shingle("text")), "sample")
    # copies would make the words of one toxic text look like evidence; of each group the smallest id counts
    single = sample.groupBy("least", "label").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    single = cut(single.select("label", "first.text"), "single")
    lexicon = learn_lexicon(single)
    exceptions = learn_exceptions(single, lexicon)
    rows = sample.select("label", measure_with(lexicon, exceptions)("text").alias("m")).select("label", "m.total", "m.density").toPandas()
    curve = fit_curve(np.log1p(rows[["total", "density"]].to_numpy(float)).reshape(-1, 2), rows.label.to_numpy(float))
    return Model(lexicon, curve.tolist(), exceptions)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (probability of toxic), predicted, matches.

    Null and empty texts have no matches. Repeated rows are scored each. An empty table gives no rows. Only doc_id and text are read.
    """
    rows = docs.select("doc_id", measure_with(model.lexicon, model.exceptions)("text").alias("m"))
    a, b, c = model.curve
    value = F.lit(a) + b * F.log1p("m.total") + c * F.log1p("m.density")
    rows = rows.select("doc_id", (1 / (1 + F.exp(-value))).alias("score"), F.col("m.matches").alias("matches"))
    return rows.select("doc_id", "score", (F.col("score") >= LEVEL).cast("int").alias("predicted"), "matches")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc32_of_id() % 3 == 1).alias("held_out"), "score", "predicted", "matches")
