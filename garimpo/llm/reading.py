"""Reading level: share of unfamiliar words and length of sentences, as in familiar-word formulas.

Familiar words are those of high document frequency in the corpus itself, one list per language. A document's level is
a linear function of the share of words outside the list and of the logarithm of the average words in a sentence. The
coefficients, and which of a few list lengths is used, are least squares over graded documents, from sums that are
aggregated over all grades (nothing is sampled or collected).
Code, links and markup are taken out before words and sentences are counted.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.edges import let
from garimpo.session import cut

#: Lengths of a language's list of familiar words, by document frequency, that the grades choose from.
FAMILIAR = (60, 100, 160, 200, 250, 300, 400)
# Frequent function words that tell the two languages apart.
PORTUGUESE = ("o", "a", "de", "que", "não", "um", "uma", "os", "as", "do", "da", "em", "no", "na", "com", "para", "por", "se", "esse", "essa", "aquele", "aquela", "ele", "ela", "foi", "ficou")
ENGLISH = ("the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "with", "this", "we", "they", "are", "not", "be", "at", "by")


# What is no prose, as (what a text must hold for the pattern to match, pattern, replacement), in order.
NO_PROSE = (
    (r"```", r"(?s)```.*?(?:```|\z)", "\n"),
    (r"<", r"(?is)<(pre|code|script|style)\b.*?</\1\s*>", "\n"),
    (r"(?: {4}|\t)", r"(?m)^(?: {4}|\t).*$", ""),
    (r"\]\(", r"!?\[([^\[\]]*+)\]\([^)\s]*\)", "$1"),
    (r"`", r"`[^`\n]*`", " "),
    (r"<", r"(?i)</(?:p|div|li|h\d|tr|blockquote)>|<br */?>|<(?:p|div|li|h\d|tr|blockquote)\b[^<>]*>", "\n"),
    (r"<|-->", r"<!--|-->|</?[a-zA-Z][^<>]*>", " "),
    (r"&", r"(?i)&(?:nbsp|#160);", " "),
    (r"&", r"&[#\w]{2,8};", " "),
    (r"://|(?i:www\.)", r"(?i)\b(?:https?://|www\.)\S+", " "),
    (r">", r"(?m)^[ \t]*(?:>+ ?)+", ""),
    # Lines that are built like statements or commands rather than prose.
    (
        r"[{}=(]|\);|\./|(?:export|import|def|class|return|cat) |tar x|SELECT |FROM |JOIN |WHERE |(?:GROUP|ORDER) BY",
        r"(?m)^.*(?:[{}][ \t]*$|=>|\$\(|\);[ \t]*$|^[ \t]*(?:\./|export \w+=|import \w|def \w+\(|class \w+[:(]|return \w+;|tar x|cat \S+\.|SELECT |FROM \w+$|JOIN |WHERE |GROUP BY|ORDER BY)|\w\(\w*+\)|\w ?[=!]= ?\w).*$",
        "",
    ),
)


def prose(text: Column) -> Column:
    """A text without code, links, quoted headers and markup; null gives an empty text.

    A pattern is run on texts that hold what it needs only.
    """
    def step(needs: str, pattern: str, to: str) -> Callable[[Column], Column]:
        plain = re.sub(r"\\(.)", r"\1", needs) if re.fullmatch(r"(?:\\.|[^\\\[\](){}|?*+.^$])+", needs) else None
        holds = (lambda x: F.contains(x, F.lit(plain))) if plain else (lambda x: F.regexp_like(x, F.lit(needs)))
        return lambda x: let(x, lambda v: F.when(holds(v), F.regexp_replace(v, pattern, to)).otherwise(v))

    x = F.coalesce(text, F.lit(""))
    for needs, pattern, to in NO_PROSE:
        x = step(needs, pattern, to)(x)
    return x


def word_array(text: Column) -> Column:
    """Lower-case words of letters (numbers are no words)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*"), F.lit(0))


def measures(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", familiar: tuple[int, ...] = FAMILIAR) -> DataFrame:
    """(doc_id, language, words, sentences, unfamiliar, wordspersentence) of each document; rows are kept one to one.

    `unfamiliar` has the share of words outside the list for each length in `familiar` (ascending). Documents without words have 0 words
    and null ratios. Equal document frequencies at the end of a list are ordered by word.
    """
    plain = documents.select(F.col(doc_id).alias("doc_id"), prose(F.col(text)).alias("t"))
    df = plain.select("doc_id", word_array(F.col("t")).alias("w"), F.size(F.regexp_extract_all("t", F.lit(r"[^.!?\n]*\p{L}[^.!?\n]*"), F.lit(0))).alias("sentences"))
    among = lambda fixed: F.size(F.filter("w", lambda x: x.isin(*fixed)))
    df = cut(df.withColumn("language", F.when(among(PORTUGUESE) >= among(ENGLISH), "pt").otherwise("en")))
    frequency = df.select("language", F.explode(F.array_distinct("w")).alias("word")).groupBy("language", "word").agg(F.count("*").alias("df"))
    # At most max(familiar) words for each of two languages: bounded, whatever the corpus.
    top = lambda language: [r.word for r in frequency.filter(F.col("language") == language).orderBy(F.desc("df"), "word").limit(max(familiar)).collect()]
    lists = {language: top(language) for language in ("pt", "en")}
    # Words of a document are looked up in the steps between two lengths, so each is looked up in every list once.
    steps = list(zip((0, *familiar), familiar, strict=False))
    in_step = lambda words: among(words) if words else F.lit(0)
    counts = F.when(F.col("language") == "pt", F.array(*[in_step(lists["pt"][a:b]) for a, b in steps])).otherwise(F.array(*[in_step(lists["en"][a:b]) for a, b in steps]))
    df = df.select("doc_id", "language", F.size("w").cast("long").alias("words"), "sentences", counts.alias("known"))
    known = lambda n: F.aggregate(F.slice("known", 1, n), F.lit(0), lambda a, x: a + x)
    share = F.array(*[F.try_divide(F.col("words") - known(n + 1), F.col("words")) for n in range(len(familiar))])
    return df.select("doc_id", "language", "words", "sentences", share.alias("unfamiliar"), F.try_divide("words", "sentences").alias("wordspersentence"))


def fit(measured: DataFrame, grades: DataFrame, label: str = "readinglevel", familiar: tuple[int, ...] = FAMILIAR) -> tuple[int, list[float]]:
    """Place of the best list length in `familiar`, and coefficients (constant, unfamiliar share, log words per sentence).

    All grades that aren't null count; documents graded twice count twice. With too few or uniform grades the solution of
    least norm is taken; without any the level is 0 + 0 + 0.
    """
    y = grades.filter(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    df = measured.filter(F.col("words") > 0).join(y, "doc_id").withColumn("length", F.log("wordspersentence"))
    terms = lambda k: {"one": F.lit(1.0), "share": F.col("unfamiliar")[k], "length": F.col("length"), "y": F.col("y")}
    products = [(k, a, b) for k in range(len(familiar)) for a in terms(k) for b in terms(k)]
    sums = df.agg(*[F.sum(terms(k)[a] * terms(k)[b]).alias(f"{k}{a}{b}") for k, a, b in products]).first()
    best: tuple[float, int, list[float]] | None = None
    for k in range(len(familiar)):
        names = ("one", "share", "length")
        xx = np.array([[sums[f"{k}{a}{b}"] or 0.0 for b in names] for a in names])
        xy = np.array([sums[f"{k}{a}y"] or 0.0 for a in names])
        c = np.linalg.lstsq(xx, xy, rcond=None)[0]
        error = (sums[f"{k}yy"] or 0.0) - 2 * c @ xy + c @ xx @ c
        if best is None or error < best[0]:
            best = (error, k, [float(v) for v in c])
    return best[1], best[2]


def levels(measured: DataFrame, fitted: tuple[int, list[float]]) -> DataFrame:
    """measured with `unfamiliar` of the chosen list, `score` (linear) and `readinglevel` (1 easiest to 5 hardest); null without words."""
    k, (one, share, length) = fitted
    score = F.lit(one) + F.lit(share) * F.col("unfamiliar") + F.lit(length) * F.log("wordspersentence")
    df = measured.withColumn("unfamiliar", F.col("unfamiliar")[k]).withColumn("score", score)
    return df.withColumn("readinglevel", F.when(F.col("score").isNotNull(), F.greatest(F.least(F.floor(F.col("score") + 0.5), F.lit(5)), F.lit(1))).cast("int"))
