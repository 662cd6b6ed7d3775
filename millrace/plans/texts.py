"""Queries over documents, benchmark and conversations: words, sentences, chunks, deduplication, tables and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import chunking, formats, text, tidy
from millrace.operators import folds, layout


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.count_words("text").alias("n_words"))


def sentence_split(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(text.split_sentences("text")).alias("pos", "sentence"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def label_sanitize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.sanitize_label("text", 64).alias("label"))


def metric_probe(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.groupBy("doc_id").agg(F.count_if(text.is_metric_probe("t", 10)).alias("probes"), F.count(F.lit(1)).alias("lines"))


def array_truncate(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("a"))
    dump = lines.select("l_suppkey", F.concat(F.lit("data: "), F.array_join(F.transform("a", lambda x: x["q"].cast("string")), ", ")).alias("t"))
    return dump.select("l_suppkey", tidy.arrays_truncated("t").alias("truncated"), text.long_arrays("t")[0].cast("long").alias("n"))


def chunk_documents(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.chunks_of("text", 128, 1)).alias("chunk_index", "c"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("c.word_count").cast("long").alias("word_count"), F.sha2("c.text", 256).alias("text_sha256"))


def pack_documents(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.packed_sentences("text", 128)).alias("chunk", "words"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("words").cast("long").alias("words"))


def adjacent_dedup_simple(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    kept = lines.withColumn("last", F.lag("line").over(w)).where("last is null or line <> last")
    return kept.select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


def repeat_blocks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.size(tidy.repeats_collapsed("text")).cast("long").alias("kept"))


def tidy_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(tidy.tidied("text"), 256).alias("tidy_sha256"))


def content_dedup_first(spark, sf_dir):
    """First of equal contents: pre-aggregated minimum by digest, so a hot digest costs no task more."""
    rows = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def content_dedup_fold(spark, sf_dir):
    """Sequential URL-or-content dedup within jobs of a hundred documents."""
    rows = _docs(spark, sf_dir).select((F.col("doc_id") / 100).cast("long").alias("job_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("u"), F.col("doc_id") % 90).alias("final_url"), F.sha2("text", 256).alias("content_hash"))
    return folds.content_dedup(rows).select("job_id", "pos", "is_duplicate")


def boilerplate_lines(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    held = lines.groupBy("source", "line").agg(F.count_distinct("doc_id").alias("docs")).where("docs >= 3")
    return held


def benchmark_overlap(spark, sf_dir):
    """Share of each benchmark item's distinct words of four letters that a document holds, where it holds half: an inverted-index join."""
    four = lambda c: F.array_distinct(F.filter(text.words(F.lower(c)), lambda w: F.length(w) >= 4))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.explode(four(F.col("text"))).alias("w"))
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    docs = _docs(spark, sf_dir).select("doc_id", F.explode(four(F.col("text"))).alias("w"))
    hits = docs.join(items, "w").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("k"))
    return hits.join(sizes, "item_id").where("2 * k >= n").select("doc_id", "item_id", "k", "n")


def label_semi(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1")
    return _docs(spark, sf_dir).join(labels, "doc_id", "left_semi").select("doc_id", "lang")


def label_anti(spark, sf_dir):
    return _docs(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left_anti").select("doc_id", "lang")


def conversation_render(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("t"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["t"]), "\n").alias("rendered"), F.count(F.lit(1)).alias("turns"))


def nation_table(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", "n_nationkey", "n_name")
    return formats.records_as_table(n, [F.col("n_nationkey")], ["n_regionkey"])


def _region_rows(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    return r.select("r_regionkey", F.concat(F.lit("key,name\n"), F.col("r_regionkey"), F.lit(","), F.col("r_name"), F.lit("\n")).alias("csv"))


def csv_json_records(spark, sf_dir):
    return _region_rows(spark, sf_dir).select("r_regionkey", formats.converted("csv", "csv_to_json")["output"].alias("json"))


def format_round_trips(spark, sf_dir):
    rows = _region_rows(spark, sf_dir).withColumn("json", formats.converted("csv", "csv_to_json")["output"])
    back = {"csv": "json_to_csv", "xml": "json_to_xml", "yaml": "json_to_yaml", "toml": "json_to_toml"}
    for name, route in back.items():
        rows = rows.withColumn(f"as_{name}", formats.converted("json", route)["output"])
    again = rows.withColumn("from_yaml", formats.converted("as_yaml", "yaml_to_json")["output"]).withColumn("from_xml", formats.converted("as_xml", "xml_to_json")["output"]).withColumn("from_toml", formats.converted("as_toml", "toml_to_json")["output"])
    return again.select("r_regionkey", "as_csv", (F.col("from_yaml") == F.col("json")).alias("yaml_same"), F.get_json_object("from_xml", "$.name").alias("xml_name"), F.get_json_object("from_toml", "$.items[0].name").alias("toml_name"))


def code_fences(spark, sf_dir):
    ticks = F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", F.length(F.regexp_extract(text.code_fence(F.concat(ticks, F.lit(" "), F.col("text")), "md"), "^(`+)", 1)).cast("long").alias("fence"))


def error_truncate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.truncated_middle("text", 1000).alias("message"))


def layout_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out as words of PDF pages: ten words a line, thirty lines a page, each document's first line large."""
    w = _docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.posexplode(text.words("text")).alias("i", "text"))
    row = F.floor(F.col("i") / 10)
    return w.select(
        "doc", (F.floor(row / 30) + 1).alias("page"), ((F.col("i") % 10) * 50.0).alias("x0"), ((F.col("i") % 10) * 50.0 + 40).alias("x1"), ((row % 30) * 14.0).alias("top"),
        ((row % 30) * 14.0 + 10).alias("bottom"), F.when(row == 0, 18.0).otherwise(11.0).alias("size"), F.lit(True).alias("upright"), "text",
    )


def word_lines_layout(spark, sf_dir):
    words = layout_words(spark, sf_dir)
    found = layout.classified(layout.lines(words), words)
    return found.select("doc", "page", "line", "text", F.col("level").cast("long").alias("level"))


_WORDS = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')"

#: DuckDB's side of collapsing blocks of up to twelve lines that repeat at once: lined(id, lines) to collapsed(id, lines).
COLLAPSED = """
steps(id, n, out) as (
  select id, 0::bigint, []::varchar[] from lined union all
  select id, n + s * k, list_concat(out, case when len(list_distinct(block)) = 1 then block[1:1] else block end) from (
    select *, l[n + 1:n + s] block, case when found is null then 1 else coalesce(list_position(list_transform(range(1, (len(l) - n) // s + 1), lambda k: l[n + (k - 1) * s + 1:n + k * s] = l[n + 1:n + s]), false) - 1, (len(l) - n) // s) end k
    from (select *, coalesce(found, 1) s from (
      select steps.id, n, out, lines l, list_max(list_filter(range(1, least(12, (len(lines) - n) // 2) + 1), lambda s: lines[n + 1:n + s] = lines[n + s + 1:n + 2 * s]
        and len(list_filter(lines[n + 1:n + s], lambda x: trim(x) <> '')) > 0 and not (s = 1 and starts_with(ltrim(lines[n + 1]), '|')))) found
      from steps join lined on lined.id = steps.id where n < len(lines))))
),
collapsed as (select steps.id, out as lines from steps join lined on lined.id = steps.id where n >= len(lined.lines))"""

SQL = {
    "repeat_blocks": f"with recursive lined as (select doc_id id, string_split(text, chr(10)) lines from documents), {COLLAPSED} select doc_id, len(string_split(text, chr(10))) as lines, len(collapsed.lines) as kept from documents join collapsed on id = doc_id",
    "tidy_documents": f"""with recursive lined as (select doc_id id, list_filter(string_split(text, chr(10)), lambda l: not (len(list_filter(regexp_split_to_array(l, '\\s+'), lambda w: w <> '')) >= 30 and len(list_distinct(list_filter(regexp_split_to_array(l, '\\s+'), lambda w: w <> ''))) = 1)) lines from documents), {COLLAPSED}
        select doc_id, sha256(case when trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' then text else trim(regexp_replace(array_to_string(collapsed.lines, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) || chr(10) end) as tidy_sha256 from documents join collapsed on id = doc_id""",
    "word_count": f"select doc_id, len({_WORDS.format(t='text')}) as n_words from documents",
    "sentence_split": r"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') s from documents)
        select doc_id, i - 1 as pos, s[i] as sentence from (select *, unnest(range(1, len(s) + 1)) i from s)""",
    "label_sanitize": r"select doc_id, rtrim(substr(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0a-\x1f\x7f-\x{9f}]', '', 'g'), '\s+', ' ', 'g')), 1, 64)) as label from documents",
    "metric_probe": f"""with l as (select doc_id, unnest(string_split(text, chr(10))) t from documents), w as (select doc_id, {_WORDS.format(t='t')} w from l)
        select doc_id, count(*) filter (len(w) >= 10 and len(list_distinct(w)) = 1) as probes, count(*) as lines from w group by doc_id""",
    "array_truncate": """with a as (select l_suppkey, list(l_quantity::int order by l_orderkey, l_linenumber, l_quantity::int) a from lineitem group by 1)
        select l_suppkey, case when len(a) >= 64 then 'data: ' || array_to_string(a[1:16], ', ') || ', ... [truncated ' || (len(a) - 16) || ' of ' || len(a) || ' values]' else 'data: ' || array_to_string(a, ', ') end as truncated,
        case when len(a) >= 64 then len(a) end as n from a""",
    "pack_documents": r"""with s as (select doc_id, list_transform(list_filter(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> ''))) c from documents),
        f as (select doc_id, list_reduce(list_transform(c, lambda n: {'done': []::bigint[], 'held': n}), lambda a, x:
            case when x.held > 128 then {'done': list_concat(a.done, case when a.held > 0 then [a.held] else [] end, [x.held]), 'held': 0::bigint}
              when a.held + x.held > 128 then {'done': list_concat(a.done, case when a.held > 0 then [a.held] else [] end), 'held': x.held}
              else {'done': a.done, 'held': a.held + x.held} end, {'done': []::bigint[], 'held': 0::bigint}) r from s),
        p as (select doc_id, list_concat(r.done, case when r.held > 0 then [r.held] else [] end) p from f)
        select doc_id, i - 1 as chunk, p[i] as words from (select *, unnest(range(1, len(p) + 1)) i from p)""",
    "adjacent_dedup_simple": """with l as (select doc_id, string_split(text, chr(10)) l from documents), x as (select doc_id, i - 1 as pos, l[i] as line from (select *, unnest(range(1, len(l) + 1)) i from l)),
        y as (select *, lag(line) over (partition by doc_id order by pos) p from x) select doc_id, pos, line from y where p is null or p <> line""",
    "content_dedup_first": "select sha256(text) as digest, min(doc_id) as doc_id, count(*) as copies from documents group by 1",
    "boilerplate_lines": "with l as (select source, doc_id, unnest(string_split(text, chr(10))) line from documents) select source, line, count(distinct doc_id) as docs from l where trim(line) <> '' group by 1, 2 having count(distinct doc_id) >= 3",
    "benchmark_overlap": f"""with i as (select distinct item_id, unnest(list_filter({_WORDS.format(t='lower(text)')}, lambda w: length(w) >= 4)) w from benchmark), n as (select item_id, count(*) n from i group by 1),
        d as (select distinct doc_id, unnest(list_filter({_WORDS.format(t='lower(text)')}, lambda w: length(w) >= 4)) w from documents), k as (select doc_id, item_id, count(*) k from d join i using (w) group by 1, 2)
        select doc_id, item_id, k, n from k join n using (item_id) where 2 * k >= n""",
    "content_dedup_fold": """with recursive e as (select doc_id // 100 job, doc_id pos, 'u' || doc_id % 90 u, sha256(text) h, row_number() over (partition by doc_id // 100 order by doc_id) n from documents),
        r as (select job, 0::bigint n, null::bigint pos, null::boolean again, []::varchar[] seen from (select distinct job from e) union all
          select e.job, e.n, e.pos, list_contains(seen, u) or list_contains(seen, h), case when list_contains(seen, u) or list_contains(seen, h) then seen else list_concat(seen, [u, h]) end from r join e on e.job = r.job and e.n = r.n + 1)
        select job as job_id, pos, again as is_duplicate from r where n > 0""",
    "format_round_trips": "select r_regionkey, 'key,name' || chr(13) || chr(10) || r_regionkey || ',' || r_name || chr(13) || chr(10) as as_csv, true as yaml_same, r_name as xml_name, r_name as toml_name from region",
    "chunk_documents": r"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') s from documents),
        f as (select doc_id, list_reduce(list_transform(s, lambda x: {'done': []::varchar[][], 'held': [x], 'n': len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> ''))}), lambda a, x:
            case when x.n > 128 then {'done': list_concat(a.done, [a.held, x.held]), 'held': []::varchar[], 'n': 0::bigint}
              when len(a.held) > 0 and a.n + x.n > 128 then {'done': list_append(a.done, a.held), 'held': [a.held[-1], x.held[1]], 'n': len(list_filter(regexp_split_to_array(a.held[-1], '\s+'), lambda w: w <> '')) + x.n}
              else {'done': a.done, 'held': list_concat(a.held, x.held), 'n': a.n + x.n} end, {'done': []::varchar[][], 'held': []::varchar[], 'n': 0::bigint}) r from s),
        c as (select doc_id, list_filter(list_transform(list_append(r.done, r.held), lambda h: array_to_string(h, ' ')), lambda t: t <> '') c from f)
        select doc_id, i - 1 as chunk_index, len(list_filter(regexp_split_to_array(c[i], '\s+'), lambda w: w <> '')) as word_count, sha256(c[i]) as text_sha256 from (select *, unnest(range(1, len(c) + 1)) i from c)""".replace("\\\\", "\\"),
    "word_lines_layout": """with w as (select doc_id doc, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') w from documents), r as (select doc, w, unnest(range(0, (len(w) + 9) // 10)) r, len(w) > 20 as has_head from w),
        l as (select doc, r // 30 + 1 page, r % 30 line, array_to_string(w[r * 10 + 1:r * 10 + 10], ' ') as text, w[1:10] head, r = 0 and has_head as first from r),
        n as (select doc, max(page) pages from l group by 1 having max(page) >= 3), h as (select l.doc, text from l join n using (doc) group by l.doc, text, pages having count(distinct page) >= greatest(2, floor(pages * 0.6)))
        select doc, page, line, text, (first and length(text) >= 3 and regexp_matches(text, '\\p{L}') and len(list_filter(head, lambda x: length(x) > 1)) > 0)::bigint as level from l anti join h using (doc, text)""",
    "label_semi": "select doc_id, lang from documents where exists (select 1 from labels l where l.doc_id = documents.doc_id and toxic = 1)",
    "label_anti": "select doc_id, lang from documents where not exists (select 1 from labels l where l.doc_id = documents.doc_id)",
    "conversation_render": "select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as rendered, count(*) as turns from conversations group by 1",
    "csv_json_records": """select r_regionkey, '[' || chr(10) || '  {' || chr(10) || '    "key": "' || r_regionkey || '",' || chr(10) || '    "name": "' || r_name || '"' || chr(10) || '  }' || chr(10) || ']' as json from region""",
    "nation_table": """with w as (select n_regionkey, greatest(length('n_nationkey'), max(length(n_nationkey::varchar))) a, greatest(length('n_name'), max(length(n_name))) b from nation group by 1)
        select n.n_regionkey, '| ' || rpad('n_nationkey', any_value(a)::int, ' ') || ' | ' || rpad('n_name', any_value(b)::int, ' ') || ' |' || chr(10) || '|' || repeat('-', any_value(a)::int + 2) || '|' || repeat('-', any_value(b)::int + 2) || '|' || chr(10)
          || string_agg('| ' || rpad(n_nationkey::varchar, a::int, ' ') || ' | ' || rpad(n_name, b::int, ' ') || ' |', chr(10) order by n_nationkey) as "table" from nation n join w using (n_regionkey) group by 1""",
    "code_fences": "select doc_id, greatest(3, case when doc_id % 6 > 0 then doc_id % 6 + 1 else 0 end, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1)::bigint as fence from documents",
    "error_truncate": r"""with m as (select doc_id, text, chr(10) || chr(10) || '... [' || (length(text) - 1000) || ' characters omitted] ...' || chr(10) || chr(10) as m from documents)
        select doc_id, case when length(text) <= 1000 then text else substr(text, 1, floor((1000 - length(m)) * 0.6)::int) || m || right(text, 1000 - length(m) - floor((1000 - length(m)) * 0.6)::int) end as message from m""",
}

QUERIES = {f.__name__: f for f in (
    word_count, sentence_split, label_sanitize, metric_probe, array_truncate, chunk_documents, pack_documents, adjacent_dedup_simple, repeat_blocks, tidy_documents, content_dedup_first,
    content_dedup_fold, boilerplate_lines, benchmark_overlap, label_semi, label_anti, conversation_render, nation_table, csv_json_records, format_round_trips, code_fences, error_truncate, word_lines_layout,
)}
