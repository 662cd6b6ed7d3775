import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import chunking, formats, text, tidy, urls


def values(spark, rows, **columns):
    df = spark.createDataFrame(rows)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


URL_CASES = [
    ("HTTP://User:pw@Example.COM:80/a/./b/../c%20d/?utm_source=x&b=2&a=1&a=3&SID=9&e=#frag", "http://example.com/a/c d/?a=1&a=3&b=2&e="),
    ("https://x.com", "https://x.com/"),
    ("https://x.com:8443/a/../../b?q=1&q", "https://x.com:8443/b?q=1&q="),
    ("http://x.com/p;v=1?b=&a=%41", "http://x.com/p?a=A&b="),
]


@pytest.mark.parametrize("url,expected", URL_CASES)
def test_canonical(url, expected):
    assert urls.canonical(url) == expected


def test_canonical_expression_agrees_with_the_exact_one(spark):
    given_ = ["http://a.example.com/x/./y/../z?b=2&a=1", "https://B.example.com:443", "http://m.x.org:8080/en/25#top", "https://x.com/?utm_id=1&GCLID=2&k=v", "http://x.com/a/b/..", "http://x.com/p;v=1?z"]
    got = values(spark, [(u,) for u in given_], a=urls.canonical_expr("_1"), b=urls.canonical_url("_1"))
    assert all(a == b for a, b in got), got


@given(st.text("abc./", max_size=20))
@settings(max_examples=200, deadline=None)
def test_dot_segments_never_climb(path):
    parts = urls.dotless("/" + path).split("/")
    assert parts[0] == "" and "." not in parts and ".." not in parts


@given(st.text("abcxyz", min_size=1, max_size=8), st.lists(st.tuples(st.text("abc", min_size=1, max_size=3), st.text("xyz", max_size=3)), max_size=4))
@settings(max_examples=100, deadline=None)
def test_canonical_is_idempotent_on_decoded_urls(path, pairs):
    url = f"https://h.example/{path}?" + "&".join(f"{k}={v}" for k, v in pairs)
    assert urls.canonical(urls.canonical(url)) == urls.canonical(url)


def test_domains_and_gates(spark):
    got = values(spark, [("a.b.example.co.uk",), ("x.github.io",), ("foo.com.museum",), ("localhost",)], d=urls.registered_domain("_1"))
    assert [g[0] for g in got] == ["example.co.uk", "github.io", "com.museum", "localhost"]
    rows = [("https://a.example.com/x.PDF",), ("https://badexample.com/x",), ("ftp://example.com/",)]
    got = values(spark, rows, same=urls.same_domain("_1", "example.com:80"), page=urls.is_page("_1"), http=urls.scheme_guard("_1"))
    assert got == [(True, False, True), (False, True, True), (True, True, False)]
    assert values(spark, [("http://x/2024-01-02/post/17",)], p=urls.pattern_of("_1")) == [("{DATE}/post/{N}",)]
    assert values(spark, [("http://x/a/b/c/a/d",), ("http://x/a/b/a/d",)], t=urls.is_trap("_1")) == [(True,), (False,)]
    assert values(spark, [("https://app.x.com",), ("x.com",), ("y.com",)], o=urls.origin_allowed("_1", ["*.x.com"])) == [(True,), (True,), (False,)]


@pytest.mark.parametrize("url,safe", [
    ("http://example.com/", True), ("https://8.8.8.8/", True), ("http://10.0.0.1/", False), ("http://[::1]/", False), ("http://2130706433/", False), ("http://u:p@example.com/", False),
    ("http://localhost/", False), ("ftp://example.com/", False), ("http://metadata.google.internal/", False), ("http://169.254.169.254/", False), (None, False), ("http://224.0.0.1/", False),
])
def test_safe_url(url, safe):
    assert urls.is_safe_url(url) is safe


def test_words_and_sentences(spark):
    rows = [("a\u00a0b c\x1cd",), ("  ",), ("Dr. Smith left! Why? ok",)]
    got = values(spark, rows, n=text.count_words("_1"), s=text.split_sentences("_1"))
    assert [g[0] for g in got] == [4, 0, 5]
    assert got[2][1] == ["Dr.", "Smith left!", "Why?", "ok"] == chunking.sentences(rows[2][0])


@given(st.text(" \t\n \x1dab.!?", max_size=40))
@settings(max_examples=30, deadline=None)
def test_python_and_column_sentences_agree(s):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    assert values(spark, [(s,)], s=text.split_sentences("_1"))[0][0] == chunking.sentences(s)


def test_text_helpers(spark):
    one = lambda c, *row: values(spark, [row], x=c)[0][0]
    assert one(text.page_slug("_1", F.lit(12345)), "seed").endswith("-12345") and one(text.page_slug("_1", F.lit(3)), "seed") == chunking.record_id("seed", 3)
    assert one(text.sanitize_label("_1", 5), "a\u202eb\t \u00a0c\x07d\nd\u2028e") == "ab cd"
    assert one(text.sanitize_content("_1"), "a\u2028b\u2029c") == "a\nb\nc"
    assert one(text.source_label("_1"), "a/b\\c.pdf") == "c.pdf"
    assert one(text.code_fence("_1"), "x ```` y").startswith("`````\n")
    assert one(text.clean_cell("_1"), " a|b\n") == "a\\|b" and one(text.clean_cell("_1", 3), "abcdef") == "abc…"
    assert one(text.truncated_middle("_1", 100), "x" * 1010).__len__() == 100 and one(text.truncated_middle("_1", 100), "x" * 100) == "x" * 100
    assert one(text.object_key("_1"), "../a b<c>.txt") == "a_bc.txt" and one(text.object_key("_1"), "..") == "output.bin" and one(text.title_slug("_1"), "") == "capture"
    assert one(text.human_bytes("_1"), 1536) == "1.5 KB" and one(text.human_bytes("_1"), 5) == "5 B"
    assert one(text.host_name("_1"), "https://www.docs.x.com/a") == "docs"
    assert one(text.member_name(F.lit(6), "_1"), "https://x.com/Hello, World!") == "007_x.com-Hello-World_markdown.md"
    assert one(text.object_path("dev", F.lit(3), "/v1/convert/url-to-markdown", "_1"), "a/b c.md") == "dev/files/3/url-to-markdown/b_c.md"
    assert one(text.title_slug("_1"), "A/b: c_d-é!") == "Ab c_d-é"
    assert one(text.render_quality("_1"), "<p>" + "w " * 19) == 0.3 and one(text.render_quality("_1"), "<p>" + "w " * 20 + "<script>x y</script>") == 1.0
    assert one(text.nfc("_1"), "e\u0301") == "\u00e9" and one(text.ascii_fold("_1"), "\u00e9\u00b2") == "e2"
    assert one(text.content_category("_1"), "application/ld+json; charset=x") == "json" and one(text.content_category("_1"), "text/html") is None
    assert one(text.capped("_1", 3), "abcd") == "abc…"
    assert one(text.is_metric_probe("_1"), "w " * 30) is True and one(text.is_metric_probe("_1"), "w " * 29) is False


def test_overage_marker_round_trip(spark):
    got = values(spark, [("2024-01-31 10:11:12.7",)], m=text.overage_marker(F.lit(7), F.col("_1").cast("timestamp")), t=text.overage_time(text.overage_marker(F.lit(7), F.col("_1").cast("timestamp"))), n=text.overage_time(F.lit("x")))
    assert got[0][0] == "overage:7:20240131101112" and got[0][1].second == 12 and got[0][2] is None


def test_signature():
    s = text.signature("k", 100, b"body")
    assert text.signature_holds("k", 100, b"body", s, 400) and not text.signature_holds("k", 100, b"body", s, 401) and not text.signature_holds("k", 100, b"bodY", s, 100)


@pytest.mark.parametrize("raw,expected", [(b"\xef\xbb\xbfhi", "hi"), ("é".encode(), "é"), (b"\x93x\x94", "“x”"), (b"\x81\x93", "\x81“")])
def test_decode_bytes(raw, expected):
    assert text.decode_bytes(raw) == expected


def test_chunks_of_worked_cases():
    doc = "# T\n\nA b c. D e f. G h i."
    two = chunking.chunk_markdown(doc, 6, 1)
    assert [(c.text, c.word_count, c.headings_path) for c in two] == [("A b c. D e f.", 6, ("T",)), ("D e f. G h i.", 6, ("T",))]
    assert [c.word_count for c in chunking.chunk_markdown(doc, 5, 1)] == [3, 6, 6]
    assert chunking.chunk_markdown("# A\n## B") == [chunking.Chunk("A\n\nB", (), "", 2)]
    assert [(c.text, c.headings_path) for c in chunking.chunk_markdown("```\ncode\n# H\ntext")] == [("```\ncode", ()), ("text", ("H",))]
    assert chunking.parse_blocks("a|b\n---")[0].kind == "paragraph" and chunking.parse_blocks("a|b\n-|-\n1|2")[0].kind == "table"
    assert chunking.list_items("- a\n  - b\n- c") == ["- a\n  - b", "- c"]
    assert chunking.parse_blocks("# " + "w " * 33)[0].kind == "paragraph" and chunking.parse_blocks("# " + "w " * 32)[0].kind == "heading"
    assert [b.kind for b in chunking.parse_blocks("```py\nx\n```\n~~~\ny\n~~~~\n- i\n  more\n1. j")] == ["code", "code", "list"]
    assert [c.text for c in chunking.chunk_markdown("a b c d e f. g h.", 3, 1)] == ["a b c d e f.", "g h."]
    deep = chunking.chunk_markdown("# A\nx\n### C\ny\n## B\nz\n#### D\nw")
    assert [c.headings_path for c in deep] == [("A",), ("A", "C"), ("A", "B")] and "D" in deep[2].text


@given(st.lists(st.sampled_from(["a b c.", "```", "~~~~", "# H", "- item", "x | y", "--|--", "", "word"]), max_size=14), st.integers(1, 6), st.integers(0, 2))
@settings(max_examples=300, deadline=None)
def test_chunks_lose_no_word(lines, most, overlap):
    doc = "\n".join(lines)
    found = {w for c in chunking.chunk_markdown(doc, most, overlap) for w in c.text.split()}
    body = {w for b in chunking.parse_blocks(doc) if b.kind != "heading" for w in b.text.split()}
    assert body <= found and (bool(found) == bool(chunking.parse_blocks(doc)))


def test_chunk_records_and_table_function(spark):
    pages = spark.createDataFrame([(1, "http://x/a", "T\u202e", "# H\n\nOne two. Three."), (2, "http://x/b", None, "")], "page_id long, url string, title string, markdown string")
    rows = chunking.records(pages, max_words=2, overlap=0).orderBy("page_id", "metadata.chunk_index").collect()
    assert [r.content for r in rows] == ["One two.", "Three."] and rows[0].id == chunking.record_id("http://x/a", 0)
    assert rows[0].metadata.title == "T" and rows[0].metadata.headings_path == ["H"]
    spark.udtf.register("chunk_markdown", chunking.ChunkMarkdown)
    pages.createOrReplaceTempView("pages_v")
    assert spark.sql("select page_id, c.chunk_index, c.word_count from pages_v, lateral chunk_markdown(markdown, 2, 0) c").count() == 2


def test_packed_sentences_matches_the_packer(spark):
    docs = ["a b c. d. e f g h i j. k l.", "", "one. two. three. four."]
    got = values(spark, [(d,) for d in docs], p=chunking.packed_sentences("_1", 4))
    assert [g[0] for g in got] == [[c.word_count for c in chunking.chunk_markdown(d, 4, 0)] for d in docs]


def test_tidy():
    assert [len(tidy.without_repeats(["x"] * n)) for n in range(2, 10)] == [1, 1, 1, 2, 1, 2, 1, 2]
    assert tidy.without_repeats(["a", "b", "a", "b", "c"]) == ["a", "b", "c"] and tidy.without_repeats(["```", "a", "a", "```"]) == ["```", "a", "a", "```"]
    assert tidy.without_repeats(["| 1 |", "| 1 |"]) == ["| 1 |", "| 1 |"]
    numbers = ", ".join(map(str, range(70)))
    assert tidy.truncate_arrays(numbers).endswith("14, 15, ... [truncated 54 of 70 values]")
    assert tidy.truncate_arrays(", ".join(map(str, range(63)))) == ", ".join(map(str, range(63)))
    assert tidy.tidy_markdown("---\n# A\n##\n[](u)\n\n\n\ntext \n***\n---\n") == "# A\n\ntext \n"[:-2] + "\n"
    assert tidy.tidy_markdown("  ") == "  " and tidy.tidy_markdown(None) is None


def test_formats():
    assert formats.csv_to_json("a,b\n1\n2,3,4\n") == '[\n  {\n    "a": "1",\n    "b": null\n  },\n  {\n    "a": "2",\n    "b": "3",\n    "null": [\n      "4"\n    ]\n  }\n]'
    with pytest.raises(ValueError):
        formats.json_to_csv('[{"a":1},{"a":2,"b":3}]')
    assert formats.json_to_csv('[{"a":1,"b":null},{"a":2}]') == "a,b\r\n1,\r\n2,\r\n"
    assert formats.xml_to_json(formats.json_to_xml("[1]")) == '"1"'
    assert formats.xml_to_json(formats.json_to_xml('{"a b":{"c":[1,2]},"1x":true}')) == '{\n  "a_b": {\n    "c": [\n      "1",\n      "2"\n    ]\n  },\n  "_1x": "true"\n}'
    assert formats.xml_to_csv(formats.csv_to_xml("a,b\n1,<&\n")) == "a,b\r\n1,<&\r\n"
    assert formats.yaml_to_json(formats.json_to_yaml('{"b": [1, {"c": "é"}], "a": null}')) == '{\n  "b": [\n    1,\n    {\n      "c": "é"\n    }\n  ],\n  "a": null\n}'
    assert formats.toml_to_json(formats.json_to_toml('{"b": [1, 2], "t": {"x": "q\\"", "u": [{"k": 1}, {"k": 2}]}}')) == '{\n  "b": [\n    1,\n    2\n  ],\n  "t": {\n    "x": "q\\"",\n    "u": [\n      {\n        "k": 1\n      },\n      {\n        "k": 2\n      }\n    ]\n  }\n}'
    assert formats.json_to_toml("[1]") == "items = [1]\n" and formats.json_to_toml("1") == "value = 1\n"
    assert formats.markdown_table([["a", "b|c"], ["1"], ["", ""]]) == "| a | b\\|c |\n|---|------|\n| 1 |      |"
    html = formats.markdown_to_html("# Hi\n\n**b** `c<`\n\n- x\n- y\n\na|b\n-|-\n1|2\n\n```py\nz\n```")
    assert '<h1 id="hi">Hi</h1>' in html and "<strong>b</strong> <code>c&lt;</code>" in html and "<li>y</li>" in html and "<td>2</td>" in html and 'class="language-py"' in html


def test_conversion_errors_are_values(spark):
    df = spark.createDataFrame([("a,b\n1,2\n",), ("",), (None,)], "t string")
    rows = df.select(formats.converted("t", "csv_to_json").alias("r")).collect()
    assert rows[0].r.error is None and rows[1].r.error.startswith("ValueError") and rows[2].r.output is None


def test_table_lines_agree_with_python(spark):
    grid = [["h", "second"], ["", ""], ["1|2"], ["x", "y", "z"]]
    df = spark.createDataFrame([(grid,)], "g array<array<string>>")
    assert df.select(formats.table_lines(F.col("g"))).first()[0] == formats.markdown_table(grid)
