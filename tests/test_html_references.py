"""Character references of pages, against the SQL and by the operator alone."""

from attestra.operators import parse
from attestra.plans import registry
from tests.oracle import compare
from tests.test_whole_job import put

PAGE = "<html><head><title>{0}</title></head><body><h1>{0}</h1><p>One &amp;amp; two {0}</p><p>&quot;{0}&quot;</p></body></html>"


def test_paragraphs_keep_references_that_were_cut_off(spark, tmp_path):
    texts = ["a &amp", "b &amp;&am", "c &quo", "d & e &ampf g; &ampf; &", "&amp;quot; h"]
    put(spark, tmp_path, "pages", [(k, PAGE.format(t)) for k, t in enumerate(texts)], "page_id bigint, html string")
    got, expected = compare(spark, str(tmp_path), "par11_html_paragraphs", registry.QUERIES["par11_html_paragraphs"], registry.SQL["par11_html_paragraphs"])
    assert got == expected
    assert len(got[1]) == 2 * len(texts)


def test_the_operator_reads_references_as_browsers_do(spark):
    pages = spark.createDataFrame([(1, PAGE.format("a &amp"))], "page_id bigint, html string")
    assert {x.title for x in parse.html_blocks(pages).collect()} == {"a &"}
    assert {x.title for x in parse.html_blocks(pages, closed=True).collect()} == {"a &amp"}
