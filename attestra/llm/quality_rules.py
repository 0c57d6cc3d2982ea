"""Line-first quality rules, with DataFrame functions alone.

Every line is judged by itself: a line fails by punctuation (no sentence end in it, or runs of
marks), navigation (separators or addresses for a quarter of its words), symbols or boilerplate (a
short line with one of a list of phrases). Failing lines are removed; a document that loses too much text that way, or
fails the base rules on word count and repeats, is rejected. Whole texts are judged and nothing is
shuffled: repeats are found by sorting a text's own window hashes.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import WORD_GAP, field
from attestra.sources.shared import spread

GAP = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
SENTENCE_END = "[.!?…。！？][\\)\\]\"'»”’]*( |$)"
MARK_RUN = "[!?]{2,}|\\.{4,}"
SEPARATORS = "[|»›·•→]"
#: Addresses; a line of which they make up a quarter is navigation.
ADDRESS = "https?://|www\\."
#: Phrases of lines that belong to a page and not to its text, in the corpus's four languages.
BOILERPLATE = [
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum", "sign up for our newsletter",
    "click here to", "skip to content", "licensed under the", "released under the terms", "released under the mit", "released under the apache",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "zum inhalt springen", "newsletter anmelden",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "conditions générales d’utilisation", "aller au contenu", "mentions légales",
    "todos los derechos reservados", "aceptar cookies", "política de privacidad", "términos de uso", "saltar al contenido", "aviso legal",
]
WINDOW = 8


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, wherever and however often ``then`` uses it.

    Spark may put a column's expression in place of the column, inside a lambda too, where it would
    be worked out again for every element.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _words(text: Column) -> Column:
    return _let(F.btrim(text, F.lit(GAP)), lambda bare: F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP)))


def _line_passes(line: Column) -> Column:
    """Whether a line, trimmed of white space and not empty, stays."""
    words = F.size(F.split(line, WORD_GAP))
    phrase = lambda low: reduce(or_, (low.contains(x) for x in BOILERPLATE))
    boilerplate = (F.length(line) <= 200) & _let(F.lower(line), phrase)
    ends = line.rlike(SENTENCE_END)
    return ends & _let(words, lambda n: (F.regexp_count(line, F.lit(MARK_RUN)) * 4 <= n) & (F.regexp_count(line, F.lit(SEPARATORS)) * 4 <= n) & (F.regexp_count(line, F.lit(ADDRESS)) * 4 <= n)) & (F.regexp_count(line, F.lit(SYMBOLS)) * 10 <= F.length(line)) & ~boilerplate


def _repeat_positions(words: Column, hashes: Column) -> Column:
    """Starts of the windows that are found twice or more, ascending."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    window = lambda p: F.slice(words, p["i"] + 1, WINDOW)
    same = lambda p, q: (p["h"] == q["h"]) & (window(p) == window(q))
    twin = lambda s, p, k: ((k > 0) & same(F.get(s, k - 1), p)) | F.coalesce(same(F.get(s, k + 1), p), F.lit(False))
    return _let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda p, k: twin(s, p, k)), lambda p: p["i"])))


def _covered(positions: Column) -> Column:
    """Words in the windows that start at ``positions`` (ascending)."""
    reach = lambda s: F.transform(s, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - p, F.lit(WINDOW))))
    return _let(positions, lambda s: F.aggregate(reach(s), F.lit(0).cast("bigint"), lambda a, x: a + x))


def _repeated(words: Column) -> Column:
    """Words in eight-word windows found twice or more."""
    # the hash of two neighbours, of two such pairs, of two such fours
    paired = lambda by: lambda h: F.zip_with(F.slice(h, 1, F.size(h) - by), F.slice(h, by + 1, F.size(h) - by), lambda a, b: F.xxhash64(a, b))
    windows = F.transform(words, lambda w: F.xxhash64(w))
    for by in (1, 2, 4):
        windows = _let(windows, paired(by))
    count = lambda found: F.when(F.size(F.array_distinct(found)) < F.size(found), _covered(_repeat_positions(words, found))).otherwise(F.lit(0).cast("bigint"))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("bigint")).otherwise(_let(windows, count))


def _chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("bigint")


def judge(docs: DataFrame, *, text_col: str = "text", least_words: int = 20, most_repeated: int = 30, most_lost: int = 50) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and cleaned_text.

    Words are parted by ASCII white space; a repeat is a window of eight words found twice or more
    in the text. Base rules: ``least_words`` words, at most ``most_repeated`` percent of them in
    repeats. A document is kept if it passes them and the removed lines hold at most ``most_lost``
    percent of its characters in words. ``cleaned_text`` is the text without the failing lines
    (blank lines stay); null text has no words, is not kept and its cleaned text is null. Repeated
    rows are judged alike; the new columns must not clash.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned_text"]
    if clash := {c.lower() for c in docs.columns} & {*new}:
        raise ValueError(f"documents already have {sorted(clash)}")
    text = F.coalesce(field(text_col).cast("string"), F.lit(""))
    of_words = _let(_words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _chars(w).alias("chars"), _repeated(w).alias("repeated")))
    bare = lambda x: F.btrim(x, F.lit(GAP))
    stays = lambda x: _let(bare(x), lambda line: (line == "") | _line_passes(line))
    doubled = lambda full: (F.size(full) - F.size(F.array_distinct(full))).cast("bigint")
    of_lines = _let(F.split(text, "\n"), lambda lines: F.struct(_let(F.filter(lines, lambda x: bare(x) != ""), doubled).alias("doubled"), F.array_join(F.filter(lines, stays), "\n").alias("clean")))
    rows = spread(docs).select(F.struct(*(field(c) for c in docs.columns)).alias("row"), of_words.alias("words"), of_lines.alias("lines"), F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"), field(text_col).isNotNull().alias("given"))
    counted = rows.select(
        "row", F.col("words.n").alias("n_words"), F.col("words.chars").alias("word_chars"), "n_symbols", F.col("lines.doubled").alias("n_dup_lines"), F.col("words.repeated").alias("n_repeat_words"),
        F.length(F.regexp_replace("lines.clean", WORD_GAP, "")).alias("left"), F.when(F.col("given"), F.col("lines.clean")).alias("cleaned_text"),
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed)
    lost = F.col("word_chars") - F.col("left")
    judged = judged.withColumn("kept", ~F.col("base_failed") & (100 * lost <= most_lost * F.col("word_chars")))
    return judged.select("row.*", *new)
