"""Queries over sentences against their SQL, on texts whose sentences begin or end with digits and odd white space."""

from attestra.plans import registry
from tests.oracle import compare
from tests.test_whole_job import put

#: Sentence k has the digits of k at its ends, so a trim by an element's place shows.
TEXTS = ["0 ms at 10. 1 first of 11. 2 of 22! x3  ", " No break　. \x0b tab? Line\n\nend.\n5", "10.0.0.1 fails. 1 of 10.0.0.11. 21 of 2", "", "   ", None]


def same(spark, folder, name):
    got, expected = compare(spark, str(folder), name, registry.QUERIES[name], registry.SQL[name])
    assert got == expected
    return got[1]


def put_documents(spark, folder):
    put(spark, folder, "documents", list(enumerate(TEXTS)), "doc_id bigint, text string")


def test_sentence_chunks_keep_digits_at_their_ends(spark, tmp_path):
    put_documents(spark, tmp_path)
    rows = same(spark, tmp_path, "par14_sentence_chunks")
    assert len(rows) == 3


def test_sentence_groups_keep_digits_at_their_ends(spark, tmp_path):
    put_documents(spark, tmp_path)
    assert same(spark, tmp_path, "msc7_sentence_groups")


def test_tfidf_weighs_words_at_sentence_ends_whole(spark, tmp_path):
    put_documents(spark, tmp_path)
    texts = [*TEXTS[:3], "Of 11 at 22"]
    put(spark, tmp_path, "benchmark", [(k * 5 + d, t) for k, t in enumerate(texts) for d in range(3)], "item_id bigint, text string")
    assert same(spark, tmp_path, "rnk11_tfidf")


def test_tfidf_passes_over_empty_passages(spark, tmp_path):
    put_documents(spark, tmp_path)
    put(spark, tmp_path, "benchmark", [(k * 5 + 2, t) for k, t in enumerate(TEXTS)], "item_id bigint, text string")
    assert same(spark, tmp_path, "rnk11_tfidf")


def test_candidates_by_words_at_sentence_ends(spark, tmp_path):
    texts = [*TEXTS, "See 1 here. 1 alone. 2 more. Only 3", "Port 21 is open. 21 fits. 3 not 2"]
    put(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id bigint, text string")
    assert same(spark, tmp_path, "rnk3_candidate_gate")


#: Stops and blank lines that part texts with CJK characters for the operators, and the mark of the SQL itself.
MARKED = ["中文。第二句！ third. 第四\n\n五 5. six", "one\x01two. \x01 three\x01", "字.\x0bnot parted. 字？parted not!\xa0No", "a\x00b. c\x00 d", "\x01", "豈 of 字. ！ 字 of 豈"]


def test_sentence_groups_cut_where_the_sql_cuts(spark, tmp_path):
    put(spark, tmp_path, "documents", [(d * 10 + k, t) for d in range(4) for k, t in enumerate(MARKED)], "doc_id bigint, text string")
    assert same(spark, tmp_path, "msc7_sentence_groups")


def test_candidates_by_latin_words_alone(spark, tmp_path):
    texts = [*MARKED, "中文 a. 中文 b. a 中文。a", "中文。 中文. 中文 two", "第二句. one! two", "中㐀"]
    put(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id bigint, text string")
    assert same(spark, tmp_path, "rnk3_candidate_gate")
