import random
import re

import pytest

from attestra.llm import quality_rules

GAP = re.compile(r"[\x20\x09-\x0D]+")
NEW = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    text = text or ""
    words = [w for w in GAP.split(text) if w]
    seen = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    hit = {p for places in seen.values() if len(places) > 1 for k in places for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if GAP.sub("", x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)


def texts():
    r = random.Random(3)
    word = lambda: r.choice(["ab", "é", "日本", "a\x1cb", "c.", "#x", "|", "\xa0"])
    out = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 500, "\n".join(["same line."] * 5)]
    for _ in range(40):
        phrase = [word() for _ in range(r.choice([7, 8, 9, 12]))]
        words = [word() for _ in range(r.randrange(80))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(words) + 1)
            words[at:at] = phrase
        out.append("".join(w + r.choice([" ", "\n", "  ", "\t", "\x0b"]) for w in words))
    return out


def test_counts_against_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    for k, text in rows:
        assert tuple(got[k][c] for c in NEW) == brute(text), repr(text)
        assert not (got[k].kept and got[k].base_failed)


PROSE = "One more clause stands before it; this is a plain sentence with quite a few words in it, and it ends as it should."


@pytest.mark.parametrize(
    ("text", "kept", "left"),
    [
        (f"{PROSE}\n{PROSE[::-1]} end.\n\nAnother line of text here.", True, None),
        (f"{PROSE}\nHome | About | News | Contact | More\nIndeed so it is.", True, f"{PROSE}\nIndeed so it is."),
        (f"{PROSE} And then some more words for it.\nLicensed under the MIT terms.", True, f"{PROSE} And then some more words for it."),
        (f"{PROSE} And then some more words.\nno sentence end here", True, f"{PROSE} And then some more words."),
        ("word%%% other$$$ third### more&&& " * 10 + ".", False, ""),
        ("BUY!! NOW!! OR!! ELSE!! MISS!! IT!! ALL!! " + " ".join(f"W{k}!!" for k in range(40)), False, ""),
        (" | ".join(f"item{k}" for k in range(40)) + " .", False, ""),
        (None, False, None),
        ("", False, ""),
    ],
)
def test_lines(spark, text, kept, left):
    row = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row.kept is kept
    assert row.cleaned_text == (text if left is None else left)


def test_columns(spark):
    docs = spark.createDataFrame([(1, "a", 2, "x")], "doc_id bigint, text string, words int, `odd.name` string")
    assert quality_rules.judge(docs).columns[:4] == docs.columns
    with pytest.raises(ValueError):
        quality_rules.judge(docs.withColumnRenamed("words", "kept"))
    assert quality_rules.judge(docs.limit(0)).collect() == []
    plan = quality_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_very_long_text_and_clashing_columns(spark):
    """A text far over the others is judged whole; columns of any name but the new ones stay as they are."""
    text = "\n".join(f"Word{k} and word{k + 1} make this line {k} long enough." for k in range(6000)) + "\n" + "\n".join(["Same line of eight words here it is."] * 2)
    docs = spark.createDataFrame([(1, text, 1, 2, 3, 4), (1, text, 1, 2, 3, 4), (None, None, None, 0, 0, 0)], "doc_id bigint, text string, words int, lines int, `row` int, left int")
    rows = quality_rules.judge(docs).orderBy("doc_id").collect()
    assert [(r.words, r.lines, r["row"], r.left) for r in rows[1:]] == [(1, 2, 3, 4)] * 2 and rows[0].cleaned_text is None and not rows[0].kept
    assert tuple(rows[1][c] for c in NEW) == brute(text) and rows[1].kept and rows[1].cleaned_text == text and rows[1] == rows[2]
    with pytest.raises(ValueError):
        quality_rules.judge(docs.withColumnRenamed("words", "KEPT"))


def test_boilerplate_in_four_languages(spark):
    body = "\n".join(f"Line {k}x has word{k} then thing{k} and more{k} at end{k}." for k in range(6))
    tails = ["Alle Rechte vorbehalten bei uns.", "Tous droits réservés.", "Todos los derechos reservados.", "All rights reserved by us.", "See https://a.example http://b.example www.c.example."]
    docs = spark.createDataFrame([(k, f"{body}\n{tail}") for k, tail in enumerate(tails)] + [(9, f"{body}\nThe prisoners were released under the bridge, they say.")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert all(got[k].kept and got[k].cleaned_text == body for k in range(len(tails)))
    assert got[9].cleaned_text.endswith("they say.")
