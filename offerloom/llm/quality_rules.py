"""Quality rules under weak supervision.

Each rule looks at one measure of a text and votes good (1), bad (-1) or abstains (0). The corpus is reduced to a histogram
of vote patterns, which has at most 3^rules rows; expectation-maximisation on it estimates how often each rule votes and
how often it is right on good and on bad texts, and every pattern gets the posterior probability that a text with these votes is good.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from offerloom.llm.texts import has_word, release, table
from offerloom.plans.lineage import cut

#: (name, measure, bad from, good up to): bad if the measure is at least the first, good if at most the second, else no vote.
RULES = (
    ("symbols", "n_symbols / greatest(n_words, 1)", 0.20, 0.05),
    ("capitals", "n_capitals / greatest(n_letters, 1)", 0.50, 0.20),
    ("repeated_words", "n_repeat_words / greatest(n_words, 1)", 0.35, 0.15),
    ("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", 0.45, 0.34),
    ("shouting", "n_marks / greatest(n_words, 1)", 0.40, 0.10),
    ("no_letters", "(word_chars - n_letters) / greatest(word_chars, 1)", 0.18, 0.08),
    ("one_word", "most_common / greatest(n_words, 20)", 0.30, 0.20),
)
ITERATIONS = 60
#: What EM starts from and is drawn to: shares of the votes bad, none, good of a rule on bad and on good texts, and the
#: share of good texts. The prior counts as this share of all texts, so that the size of the corpus doesn't matter.
PRIOR_VOTES = ((0.35, 0.10, 0.55), (0.01, 0.09, 0.90))
PRIOR_GOOD, PRIOR_SHARE = 0.9, 0.02
THRESHOLD = 0.5
_SYMBOLS = b"#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_marks", "most_common")
_SPACES = b" \t\n\x0b\x0c\r"
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LEADS = bytes(range(0xC0, 0x100))


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    codes: dict = {}
    c = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    if len(codes) < 2_000_000:
        _, where, n = np.unique((c[:-2] * len(codes) + c[1:-1]) * len(codes) + c[2:], return_inverse=True, return_counts=True)
        twice = n[where] > 1
    else:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : len(words) - 2 + i] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text in the order of ``_COUNTS``; letters are A-Z, a-z and all characters beyond ASCII, capitals A-Z."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words, lines = data.split(), [x for x in text.split("\n") if has_word(x)]
    without = lambda some: len(data) - len(data.translate(None, some))
    most = Counter(words).most_common(1)[0][1] if words else 0
    return (
        len(words), len(text) - without(_SPACES), without(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        without(_LETTERS) + without(_LEADS), without(_LETTERS[:26]), without(b"!?"), most,
    )


@pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS]))
def measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([measure(t) for t in batch], columns=list(_COUNTS), dtype="int64")
    release()


def _code(counts: str) -> Column:
    """The votes as digits base 3: 0 bad, 1 none, 2 good. A text without words gets no votes but is rejected by the base rule."""
    code = F.lit(0)
    for _, expression, bad, good in RULES:
        value = F.expr(_of(expression, counts))
        code = code * 3 + F.when(value >= bad, 0).when(value <= good, 2).otherwise(1)
    return code.cast("int")


def _of(expression: str, counts: str) -> str:
    for c in sorted(_COUNTS, key=len, reverse=True):
        expression = expression.replace(c, f"`{counts}`.{c}")
    return expression


def fit(histogram: np.ndarray) -> np.ndarray:
    """Posterior probability of good for each pattern code, by EM on the histogram of codes.

    Given the truth the rules vote independently; a rule's accuracy is estimated for bad and for good texts apart, since most
    rules catch one kind of bad text and have nothing against the others.
    """
    votes = np.array(list(product((0, 1, 2), repeat=len(RULES))))
    one_hot = (votes[:, :, None] == np.arange(3)).astype(float)
    prior = np.array(PRIOR_VOTES)[None].repeat(len(RULES), 0)
    theta, good, total = prior, PRIOR_GOOD, max(1.0, float(histogram.sum()))
    for _ in range(ITERATIONS):
        logs = np.einsum("prv,rcv->pc", one_hot, np.log(theta))
        odds = np.clip(logs[:, 1] - logs[:, 0] + np.log(good / (1 - good)), -50, 50)
        posterior = 1 / (1 + np.exp(-odds))
        if not histogram.sum():
            break
        mass = np.stack((histogram * (1 - posterior), histogram * posterior), 1)
        counts = np.einsum("pc,prv->rcv", mass, one_hot) + PRIOR_SHARE * total * prior
        theta = counts / counts.sum(2, keepdims=True)
        good = float((mass[:, 1].sum() + PRIOR_SHARE * total * PRIOR_GOOD) / (total * (1 + PRIOR_SHARE)))
    return posterior


def _base_failed(counts: str) -> Column:
    return F.expr(_of("n_words < 50 or 100 * n_repeat_words > 50 * n_words", counts))


def _posteriors(codes: DataFrame) -> Column:
    """An array literal with the posterior of every code; its size depends on the number of rules only."""
    histogram = np.zeros(3 ** len(RULES))
    for code, n in codes.groupBy("code").count().collect():
        histogram[code] = n
    return F.lit([float(round(x, 12)) for x in fit(histogram)])


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, votes (-1, 0 or 1 by rule), posterior, base_failed, kept.

    ``kept`` is false if the base rules fail, else whether the posterior reaches the threshold. Null texts have no words and
    fail the base rules. Repeated rows are judged each; an empty table gives no rows. Other columns are not read.
    """
    counted = cut(docs.select("doc_id", measures("text").alias("counts")), "counts")
    posterior = F.element_at(_posteriors(counted.select(_code("counts").alias("code"))), _code("counts") + 1)
    votes = F.struct(*[(F.floor(_code("counts") / 3 ** (len(RULES) - 1 - i)) % 3 - 1).cast("int").alias(name) for i, (name, *_) in enumerate(RULES)])
    rows = counted.select("doc_id", "counts.*", votes.alias("votes"), posterior.alias("posterior"), _base_failed("counts").alias("base_failed"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= THRESHOLD))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with the columns of ``docs``.

    The rows are written once with their votes, so that the texts are measured once.
    """
    own = "_" * (1 + max(map(len, docs.columns)))  # a name that docs doesn't have
    counted = docs.withColumn(own, measures(docs["text"]))
    voted = cut(counted.withColumn(own, F.struct(_code(own).alias("code"), _base_failed(own).alias("failed"))), "voted")
    posterior = F.element_at(_posteriors(voted.select(F.col(f"{own}.code").alias("code"))), F.col(f"{own}.code") + 1)
    return voted.filter(~F.col(f"{own}.failed") & (posterior >= THRESHOLD)).select(*[f"`{c}`" for c in docs.columns])


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
