"""Names without their semicolon (headings cut inside "&amp;") against the SQL of the queries that convert pages."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalogue import SF, plain

from millrace.html.pages import TRUNCATED, main_markdown
from millrace.html.tree import parse
from millrace.plans import catalogue

NAMES = ["css_records", "distill_pages", "election_candidates", "main_content_elect", "markdown_page", "page_captures", "page_fingerprint"]


def written(spark, at, html):
    """Some of the tables' pages, changed."""
    spark.read.parquet(f"{SF}/pages.parquet").where("page_id % 4 = 0").withColumn("html", html).coalesce(1).write.parquet(f"{at}/pages.parquet")
    return str(at)


def same(spark, folder, name):
    """The query's rows, which are those of its SQL."""
    df = catalogue.queries()[name](spark, folder)
    columns = sorted(df.columns)
    found = df.collect()
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    order = [want.columns.index(c) for c in columns]
    assert found and sorted(tuple(plain(r[c]) for c in columns) for r in found) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    return found


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("bare"), F.regexp_replace("html", "</(h1|title)>", " R&amp;D&amp</$1>"))


@pytest.mark.parametrize("name", NAMES)
def test_names_without_a_semicolon_stay(spark, folder, name):
    same(spark, folder, name)


def test_references():
    aside = chr(0xF0000)
    n = parse(f'<p>R&amp;D&amp {aside}&copy;&copy 1 &ampx; &notit; &#38; &#38 & && &am</p><a href="?a=1&copy=2&amp;lt=3">x</a><script>a && b &amp; &amp</script><x&y>z</x&y>w')
    assert [c.raw_text() for c in n.children[:-1]] == [f"R&D&amp {aside}©&copy 1 &ampx; &notit; & & & && &am", "x", "a && b &amp; &amp", "z"] and n.children[-1] == "w"
    assert n.first("a").get("href") == "?a=1&copy=2&lt=3"


@pytest.mark.parametrize("text", ["Erederre on heon oneden.", "Of 21 characters only", "a  * b * c * d * e * f * g *", "*** Of twenty-one chars ***"])
def test_short_paragraphs_of_a_reader_view(spark, tmp_path, text):
    """A paragraph of 22 characters and a line break is long enough; asterisks do not count."""
    page = F.regexp_replace("html", "(?s)</h1>.*</article>", f"</h1><p><b>{text}<br></article>")
    found = same(spark, written(spark, tmp_path, F.when(F.col("page_id") % 8 == 0, page).otherwise(F.regexp_replace("html", "(?s)</h1>.*</article>", f"</h1><p>{text}</p></article>"))), "election_candidates")
    assert any(r.source == "readability" for r in found) == (text == "Erederre on heon oneden.")


REPEATED = ["main_content_elect", "markdown_page"]


@pytest.mark.parametrize("name", REPEATED)
def test_repeats_are_no_truncated_arrays(spark, tmp_path, name):
    """Blocks that stand once make a page half as long; no array was cut, so there is no note of that."""
    block = "".join(f"<p>{w} said that words, sentences and paragraphs come again and again on this page.</p>" for w in ("Anna", "Bertha"))
    found = same(spark, written(spark, tmp_path, F.regexp_replace("html", "(?s)</h1>.*</article>", f"</h1>{block * 12}</article>")), name)
    assert all(not (r.n_warnings if name == "main_content_elect" else r.warnings) for r in found)


def test_truncated_arrays_are_noted():
    numbers = ", ".join(str(k / 7) for k in range(400))
    text, _, warnings = main_markdown(f"<article><h1>Numbers</h1><p>What the model printed, line by line.</p><p>{numbers}</p></article>", "https://a.example")
    assert "[truncated 384 of 400 values]" in text and warnings == [TRUNCATED]


CUT = ["distill_pages", "markdown_page", "page_captures", "page_fingerprint"]


@pytest.fixture(scope="module")
def cut_numbers(spark, tmp_path_factory):
    """Headings cut at one of three places inside "&#x27;"."""
    at = F.concat(F.lit(" It&amp;s &#x"), F.substring(F.lit("27"), 1, (F.col("page_id") / 4 % 3).cast("int")))
    html = F.regexp_replace("html", F.lit("</(h1|title)>"), F.concat(at, F.lit("</$1>")))
    return written(spark, tmp_path_factory.mktemp("cut"), html)


@pytest.mark.parametrize("name", CUT)
def test_numbers_cut_short_stay(spark, cut_numbers, name):
    same(spark, cut_numbers, name)


def test_numbers_cut_short():
    n = parse("<h1>a &#x2</h1><h2>b &#x27<br>&#39</h2><p>c &#x27 &#38 d &#x27; &#39;</p>e &#x2")
    assert [c.raw_text() for c in n.children[:-1]] == ["a &#x2", "b &#x27&#39", "c ' & d ' '"] and n.children[-1] == "e &#x2"


def test_captures_hold_whole_texts(spark, tmp_path):
    """A page of more than 200,000 characters, where captures of the operator end by default."""
    block = "".join(f"<p>Anna said in line {i} that words, sentences and paragraphs are kept to the end.</p>" for i in range(3000))
    html = F.when(F.col("page_id") % 40 == 0, F.regexp_replace("html", "(?s)</h1>.*</article>", f"</h1>{block}</article>")).otherwise(F.col("html"))
    assert max(r.n_chars for r in same(spark, written(spark, tmp_path, html), "page_captures")) > 200_000


def test_an_empty_url_folds_nothing(spark, tmp_path):
    spark.read.parquet(f"{SF}/pages.parquet").where("page_id % 40 = 0").withColumn("url", F.lit("")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    same(spark, str(tmp_path), "page_fingerprint")


BLANKS = ["main_content_elect", "markdown_page", "page_captures", "page_fingerprint"]


@pytest.mark.parametrize("name", BLANKS)
def test_blanks_that_html_does_not_collapse_stay(spark, tmp_path, name):
    """No-break and ideographic blanks of paragraphs are text (headings are flattened); a NUL is no line break anywhere."""
    html = F.regexp_replace(F.regexp_replace("html", "</(p|div)>", " 10\u00a0000\u3000km.</$1>"), "</(h1|p|div)>", " and\u0000so on</$1>")
    same(spark, written(spark, tmp_path, html), name)


def test_blanks_in_markdown():
    text, _, _ = main_markdown("<h1>a\0b&nbsp;c</h1><p>&nbsp;q\0r&nbsp;<br>&nbsp;<br>s&nbsp; \u3000 t</p><p>1.&nbsp;x</p><p>&nbsp;</p><table><tr><td>p\0q<br>r</td><td>&nbsp;</td></tr></table>", "")
    assert text == "# a\0b c\n\nq\0r  \n  \ns\u00a0 \u3000 t\n\n1.\u00a0x\n\n| p\0q r |  |\n| --- | --- |\n"
