"""Named queries over the test tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import entries as E
from quillspark.functions import korean, metadata, noise, reread
from quillspark.functions import text as X
from quillspark.operators import blocks as B
from quillspark.operators import books as K
from quillspark.operators import corpus as O
from quillspark.operators import layout, numbers, scans
from quillspark.operators import markdown as M
from quillspark.operators import pages as P
from quillspark.sources import documents, readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_category_sql = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(x, '{w.lower()}')" for w in words) + f" THEN '{label}'" for label, words in X.CATEGORIES) + f" ELSE '{X.DEFAULT_CATEGORY}' END"
_ko, _en = "len(regexp_extract_all(t, '[가-힣]'))", "len(regexp_extract_all(t, '[a-zA-Z]'))"
_language_sql = f"CASE WHEN {_ko} + {_en} = 0 OR {_ko} > 0.7 * ({_ko} + {_en}) THEN 'ko' WHEN {_ko} < 0.2 * ({_ko} + {_en}) THEN 'en' ELSE 'mixed' END"
#: Documents in which the defects that cleaning rules repair are put in, as the tables hold none.
_mixed = "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN repeat('한글 ', CAST(n_chars AS INTEGER)) || text ELSE repeat('가나다라마 ', CAST(n_chars AS INTEGER) // 12) || text END"


@query(f"SELECT doc_id, {_language_sql} AS language FROM (SELECT doc_id, {_mixed} AS t FROM documents)")
def doc_language(t):
    return t("documents").select("doc_id", X.language(F.expr(_mixed.replace("//", "div"))).alias("language"))


@query(f"SELECT doc_id, {_category_sql} AS category FROM (SELECT doc_id, lower(' ' || substr(text, 1, 3000)) AS x FROM documents)")
def doc_category(t):
    return t("documents").select("doc_id", X.category(F.col("text")).alias("category"))


@query(r"""WITH l AS (SELECT doc_id, [trim(y, ' ') FOR y IN string_split(text, chr(10))] AS ls FROM documents),
c AS (SELECT doc_id, [trim(regexp_replace(y, '^#+', ''), ' ') FOR y IN ls IF starts_with(y, '#') OR (length(y) BETWEEN 2 AND 60 AND NOT regexp_matches(y, '^(?:[-*|>\[]|```|http|값)'))] AS cs FROM l),
g AS (SELECT doc_id, [y FOR y IN cs IF length(y) > 2 AND NOT regexp_matches(y, '^(?i)(?:PART|CHAPTER|SECTION|제\s*\d+\s*[장절편]|부록|페이지|슬라이드|시트)')] AS gs FROM c)
SELECT doc_id, coalesce(gs[1], 'document ' || doc_id) AS title FROM g""")
def doc_title(t):
    return t("documents").select("doc_id", X.title(F.col("text"), F.concat(F.lit("document "), F.col("doc_id").cast("string"))).alias("title"))


@query(r"""WITH l AS (SELECT doc_id, [trim(y, ' ') FOR y IN string_split(text, chr(10))] AS ls FROM documents),
p AS (SELECT doc_id, [y FOR y IN ls IF y <> '' AND NOT regexp_matches(y, '^(?:[#\-*|>\[]|```|http|값|ISBN|PART|CHAPTER|SECTION|부록|감사의)')] AS ps FROM l)
SELECT doc_id, substr(coalesce(nullif(array_to_string(ps[1:2], ' '), ''), '문서 내용 요약 정보가 없습니다.'), 1, 220) AS summary FROM p""")
def doc_summary(t):
    return t("documents").select("doc_id", X.summary(F.col("text")).alias("summary"))


@query(r"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '(?:주식회사\s+|㈜|\(주\))([가-힣A-Za-z0-9]+)', 1) || regexp_extract_all(text, '([가-힣A-Za-z0-9]+(?:위원회|공사|진흥원|협회|재단|연구원|은행|대학|본부|센터))', 1) || regexp_extract_all(text, '([A-Z]{2,}(?:[-_][A-Z0-9]+)*)', 1) AS es FROM documents),
u AS (SELECT doc_id, unnest(es) AS v, generate_subscripts(es, 1) AS i FROM e),
f AS (SELECT doc_id, v, min(i) AS i FROM u WHERE length(v) >= 2 GROUP BY ALL),
r AS (SELECT doc_id, v FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 6)
SELECT d.doc_id, coalesce(string_agg(v, '|' ORDER BY v), '') AS entities FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""")
def doc_entities(t):
    return t("documents").select("doc_id", F.array_join(X.entities(F.col("text")), "|").alias("entities"))


@query("SELECT doc_id, 'doc_20260101_' || substr(sha256(source || ':' || CAST(n_chars AS VARCHAR)), 1, 8) AS id FROM documents")
def doc_id_hash(t):
    return t("documents").select("doc_id", X.doc_id(F.col("source"), F.col("n_chars"), "20260101").alias("id"))


@query(f"SELECT category, language, lang, count(*) AS n FROM (SELECT lang, {_category_sql} AS category, {_language_sql} AS language FROM (SELECT lang, text AS t, lower(' ' || substr(text, 1, 3000)) AS x FROM documents)) GROUP BY ALL")
def category_language_report(t):
    d = t("documents").select("lang", X.tidy(F.col("text")).alias("text"))
    d = d.select("lang", X.category(F.col("text")).alias("category"), X.language(F.col("text")).alias("language"))
    return d.groupBy("category", "language", "lang").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def category_rollup(t):
    return t("documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(r"""WITH u AS (SELECT doc_id, unnest(m) AS term, generate_subscripts(m, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\*\*([^*\n]+)\*\*', 1) AS m FROM documents))
SELECT doc_id, term, count(*) AS n, min(pos) AS first_pos FROM u GROUP BY ALL HAVING count(*) >= 2""")
def bold_terms(t):
    return O.bold_terms(t("documents"))


@query("""WITH u AS (SELECT doc_id, unnest(m) AS term, generate_subscripts(m, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(substr(text, 1, 4000), '[A-Za-z가-힣]{2,}') AS m FROM documents)),
c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS p FROM u GROUP BY ALL HAVING count(*) >= 3)
SELECT doc_id, term, n, rnk FROM (SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rnk FROM c) WHERE rnk <= 20""")
def top_terms(t):
    return O.top_terms(t("documents"))


_tags = ["LLM", "Local LC", "vibe coding", "smart/trade ledger", "Agent (beta)", "plain tag", "OCR--scan"]
_tag_sql = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_tags)) + " END"
_synonym_sql = "CASE lower(s) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.SYNONYMS.items()) + " ELSE s END"


@query(rf"""WITH a AS (SELECT doc_id, trim(regexp_replace(translate(regexp_replace({_tag_sql}, '\(.*?\)', '', 'g'), '/·', '  '), '\s+', ' ', 'g'), ' ') AS y FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(y, ' ', '-'), '[^0-9A-Za-z가-힣_\-]', '', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM a)
SELECT {_synonym_sql} AS tag, count(*) AS n FROM b GROUP BY ALL""")
def canonical_tags(t):
    return t("documents").select(X.canonical(X.slug(F.expr(_tag_sql))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def _dirty(name: str, spark_expr: str, duck_expr: str, column, duck_result: str) -> None:
    """A cleaning rule over documents into which its defect is put."""
    QUERIES[name] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(column(F.expr(spark_expr))).alias("digest"), F.length(column(F.expr(spark_expr))).cast("long").alias("n"))
    ORACLES[name] = f"SELECT doc_id, md5(y) AS digest, CAST(length(y) AS BIGINT) AS n FROM (SELECT doc_id, {duck_result} AS y FROM (SELECT doc_id, {duck_expr} AS x FROM documents))"


_dirty("tidy_text", r"concat('  ', replace(text, '. ', '.  \r\n\n\n\n'), '\r\n ')", r"'  ' || replace(text, '. ', '.  ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10)) || chr(13) || chr(10) || ' '", X.tidy, r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') || chr(10)")
_dirty("noise_lines", r"replace(text, '. ', '.\n~\n*a\n\n')", "replace(text, '. ', '.' || chr(10) || '~' || chr(10) || '*a' || chr(10) || chr(10))", X.noise_lines, r"array_to_string([y FOR y IN string_split(x, chr(10)) IF trim(y, ' ') = '' OR length(regexp_replace(y, '[^\p{L}\p{N}_]', '', 'g')) >= 2], chr(10))")
_dirty("page_label_lines", r"replace(text, '. ', '.\n- 12 -\n3 페이지\n## 페이지 4\n[페이지 5]\n')", "replace(text, '. ', '.' || chr(10) || '- 12 -' || chr(10) || '3 페이지' || chr(10) || '## 페이지 4' || chr(10) || '[페이지 5]' || chr(10))", X.page_labels, r"regexp_replace(replace(x, chr(10) || '- 12 -' || chr(10) || '3 페이지' || chr(10) || '## 페이지 4' || chr(10) || '[페이지 5]' || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")
_dirty("hyphen_join", r"regexp_replace(text, '([a-z]{3})([a-z]{3})', '$1-\n $2')", r"regexp_replace(text, '([a-z]{3})([a-z]{3})', '\1-' || chr(10) || ' \2', 'g')", X.hyphens, r"regexp_replace(x, '([a-zA-Z])-\n\s*([a-zA-Z])', '\1\2', 'g')")
_dirty("punct_spacing", "concat(replace(replace(text, ', ', ' , '), '. ', ' .( x ) '), '했다 .그리고 [ 끝 ]…')", "replace(replace(text, ', ', ' , '), '. ', ' .( x ) ') || '했다 .그리고 [ 끝 ]…'", X.punctuation, r"replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[ \t]+([.,!?。！？、])', '\1', 'g'), '([^A-Za-z])\.([가-힣])', '\1. \2', 'g'), '([,!?。！？])([가-힣])', '\1 \2', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g'), '\[\s+', '[', 'g'), '\s+\]', ']', 'g'), '…', '...')")
_dirty("symbol_map", "concat(replace(text, ' the ', ' -> (tm) '), ' 3 >= 2 != 1 +-4 deg C ﬁn œuvre')", "replace(text, ' the ', ' -> (tm) ') || ' 3 >= 2 != 1 +-4 deg C ﬁn œuvre'", X.symbols, "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(x, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'æ', 'ae'), 'œ', 'oe'), '(tm)', '™'), '(TM)', '™'), '+-', '±'), '->', '→'), '<-', '←'), '>=', '≥'), '<=', '≤'), '!=', '≠'), 'deg C', '℃')")
_dirty("digit_confusion", "concat(text, ' 1l2 3O4 5S6 7B8 9G0')", "text || ' 1l2 3O4 5S6 7B8 9G0'", X.confusion, r"regexp_replace(replace(x, ' 1l2 3O4 5S6 7B8 9G0', ' 112 304 556 788 960'), '([a-z])[I1]([a-z])', '\1l\2', 'g')")
_dirty("ocr_artifacts", "replace(text, ' the ', concat(' ᆞᆞ ', char(7)))", "replace(text, ' the ', ' ᆞᆞ ' || chr(7))", X.artifacts, r"replace(regexp_replace(x, '\s*ᆞ+\s*', ' ', 'g'), chr(7), '')")


@query("""WITH g AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS down FROM g WHERE trim(line, ' ') <> ''),
b AS (SELECT source, doc_id, regexp_replace(lower(line), '[^a-z가-힣]', '', 'g') AS s, least(up, down) <= 2 AS edge FROM l),
k AS (SELECT DISTINCT source, doc_id, substr(s, CAST(j AS INTEGER), 4) AS gram, edge FROM b, LATERAL (SELECT unnest(range(1, greatest(length(s) - 2, 1))) AS j) WHERE length(s) >= 4),
p AS (SELECT source, gram, doc_id, bool_or(edge) AS edge FROM k GROUP BY ALL)
SELECT source, gram, count(*) AS all_df, count(*) FILTER (edge) AS edge_df FROM p GROUP BY ALL""")
def gram_df(t):
    return O.gram_frequency(t("documents"), "source", "doc_id")


@query("""WITH m AS (SELECT DISTINCT o_custkey AS doc, o_orderkey % 40 AS page, o_orderkey % 40 + o_orderkey % 3 AS value FROM orders)
SELECT a.doc, a.page, a.value, count(*) AS near FROM m a JOIN m b ON a.doc = b.doc AND a.value - a.page = b.value - b.page AND b.page <> a.page AND abs(b.page - a.page) <= 3 GROUP BY ALL HAVING count(*) >= 2""")
def page_number_neighbours(t):
    return O.page_numbers(t("orders").selectExpr("o_custkey doc", "o_orderkey % 40 page", "o_orderkey % 40 + o_orderkey % 3 value"))


@query("SELECT conv_id, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) WHERE k = 1")
def first_part_header(t):
    return O.first_per(t("conversations").select("conv_id", "role", "turn"), ["conv_id", "role"], [F.col("turn")])


@query("""SELECT r_regionkey, '| n_name | n_nationkey |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS grid
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""")
def table_render(t):
    rows = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    cells = F.concat(F.array(F.array(F.lit("n_name"), F.lit("n_nationkey"))), F.transform("x", lambda v: F.array(v["n_name"], v["n_nationkey"].cast("string"))))
    return rows.select("r_regionkey", X.table(cells).alias("grid"))


@query("""SELECT r_regionkey, '### 시트: ' || r_name || ' (총 ' || (count(*) + 1) || '행)' || chr(10) || chr(10) || '**[분류 헤더: word - meaning]**' || chr(10) || chr(10) || string_agg('• **' || n_name || '**: ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS glossary
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def sheet_glossary(t):
    rows = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    cells = F.concat(F.array(F.array(F.lit("word"), F.lit("meaning"))), F.transform("x", lambda v: F.array(v["n_name"], v["n_nationkey"].cast("string"))))
    return rows.select("r_regionkey", readers.sheet_text(F.col("r_name"), cells).alias("glossary"))


@query("""SELECT CASE WHEN event_id % 5 <> 0 THEN 'success' WHEN event_id % 15 = 0 THEN 'password_protected' WHEN event_id % 10 = 0 THEN 'corrupted_file' ELSE 'failed' END AS status, count(*) AS n FROM events GROUP BY ALL""")
def status_report(t):
    e = t("events").selectExpr("if(event_id % 5 <> 0, 'success', 'failed') status", "case when event_id % 15 = 0 then 'Password needed' when event_id % 10 = 0 then 'file is Corrupt' else null end message")
    return O.status_report(e)


_name = "concat('doc', cast(doc_id as string), '.txt')"


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0")
def incremental_skip(t):
    d = t("documents")
    src = d.selectExpr("doc_id", f"concat('D:/in/', source, '/', {_name}) path", f"concat(source, '/', {_name}) rel_path", f"{_name} name", "source parent")
    old = d.selectExpr("doc_id", f"if(doc_id % 3 = 0, concat('e:/IN/', source, '/', {_name}), null) source_path", f"if(doc_id % 7 = 0, concat(source, '/', {_name}), null) source_rel_path", f"if(doc_id % 11 = 0, upper({_name}), null) source_file", "if(doc_id % 11 = 0, source, null) source_parent")
    return O.not_converted(src, old.where("doc_id % 3 = 0 or doc_id % 7 = 0 or doc_id % 11 = 0")).select("doc_id")


@query("""WITH f AS (SELECT source AS stem, lang AS ext, CAST(doc_id AS VARCHAR) AS name, row_number() OVER (PARTITION BY source ORDER BY lang, CAST(doc_id AS VARCHAR)) AS n FROM documents)
SELECT stem, ext, name, CASE n WHEN 1 THEN stem || '.md' ELSE stem || ' (' || n || ').md' END AS target FROM f""")
def target_names(t):
    return O.target_names(t("documents").selectExpr("source stem", "lang ext", "cast(doc_id as string) name"))


_block = "CAST(l_quantity AS BIGINT) AS doc, l_orderkey % 50 AS page, l_partkey % 600 AS cx, l_suppkey % 800 AS cy"


@query(f"""WITH b AS (SELECT l_orderkey, l_linenumber, {_block} FROM lineitem), t AS (SELECT DISTINCT p_size AS doc, p_partkey % 50 AS page, p_partkey % 500 AS x0, p_partkey % 700 AS y0 FROM part)
SELECT l_orderkey, l_linenumber FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc = b.doc AND t.page = b.page AND b.cx BETWEEN x0 - 5 AND x0 + 55 AND b.cy BETWEEN y0 - 5 AND y0 + 25)""")
def blocks_outside_tables(t):
    b = t("lineitem").selectExpr("l_orderkey", "l_linenumber", *_block.split(", "))
    return O.outside_tables(b, t("part").selectExpr("p_size doc", "p_partkey % 50 page", "p_partkey % 500 x0", "p_partkey % 700 y0", "p_partkey % 500 + 50 x1", "p_partkey % 700 + 20 y1")).select("l_orderkey", "l_linenumber")


@query("SELECT l_partkey % 600 AS cx, CAST(CASE WHEN l_partkey % 600 >= 400 THEN 2 WHEN l_partkey % 600 >= 200 THEN 1 ELSE 0 END AS INTEGER) AS col, count(*) AS n FROM lineitem GROUP BY ALL")
def column_assignment(t):
    return t("lineitem").selectExpr("l_partkey % 600 cx").withColumn("col", O.column_of(F.col("cx"), F.array(F.lit(200), F.lit(400)))).groupBy("cx", "col").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, min(l_partkey) AS x0, max(l_partkey) AS x1, min(l_suppkey) AS y0, max(l_suppkey) AS y1 FROM lineitem GROUP BY ALL")
def bbox_extents(t):
    return O.extents(t("lineitem").selectExpr("l_orderkey", "l_partkey x0", "l_partkey x1", "l_suppkey y0", "l_suppkey y1"), "l_orderkey")


@query("SELECT doc_id, ls[len(ls) // 2 + 1] AS median FROM (SELECT doc_id, list_sort([length(y) FOR y IN string_split(text, chr(10))]) AS ls FROM documents)")
def upper_median(t):
    return t("documents").select("doc_id", O.upper_median(F.transform(X.lines(F.col("text")), lambda x: F.length(x))).cast("long").alias("median"))


@query("""WITH l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
r AS (SELECT conv_id, turn, sum(CASE WHEN p IS NOT NULL AND p <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT conv_id, CAST(run AS BIGINT) AS run, count(*) AS n, min(turn) AS first_turn FROM r GROUP BY ALL""")
def paragraph_islands(t):
    changed = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")) != F.col("role")
    rows = t("conversations").withColumn("changed", changed)
    return O.islands(rows, "conv_id", "turn", F.col("changed")).groupBy("conv_id", "run").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query("""SELECT page, round(avg(score) FILTER (score > 0), 6) AS avg_score, CASE WHEN avg(score) FILTER (score > 0) IS NULL THEN 'unknown' WHEN avg(score) FILTER (score > 0) >= 0.85 THEN 'high' WHEN avg(score) FILTER (score > 0) >= 0.65 THEN 'medium' ELSE 'low' END AS grade
FROM (SELECT l_orderkey AS page, CASE WHEN l_orderkey % 11 = 0 THEN 0.0 ELSE l_quantity / 50 END AS score FROM lineitem) GROUP BY page""")
def ocr_confidence(t):
    return O.confidence(t("lineitem").selectExpr("l_orderkey page", "if(l_orderkey % 11 = 0, 0D, l_quantity / 50) score"))


_start = r"^(?:\s*#{1,6}\s|\s*[-*+•◦▪▫※▶▷]\s|\s*\d+[.)]\s|\s*>\s|\s*\||\s*```|\s*[-*_]{3,}\s*$)"


@query(rf"""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
r AS (SELECT doc_id, ls, 1 AS i, ls[1] AS first, ls[1] AS cur, '' AS done FROM l UNION ALL
SELECT doc_id, ls, i + 1, CASE WHEN go THEN first ELSE nxt END, CASE WHEN go THEN rtrim(cur, ' ') || ' ' || ltrim(nxt, ' ') ELSE nxt END, CASE WHEN go THEN done ELSE done || cur || chr(10) END FROM (
SELECT *, trim(cur, ' ') <> '' AND trim(nxt, ' ') <> '' AND NOT (length(trim(cur, ' ')) < 10 AND NOT regexp_matches(trim(cur, ' '), '(?:은|는|이|가|을|를|에|의|로|으로|와|과|도|만|고|며|면|서|등|,)$'))
AND NOT regexp_matches(trim(nxt, ' '), '^(?i)(?:PART|CHAPTER|SECTION|제\s*\d+\s*[장절편]|부록|감사의\s*글|\d+[.．]\s|\|)') AND NOT regexp_matches(first, '{_start}') AND NOT regexp_matches(nxt, '{_start}')
AND NOT (regexp_matches(trim(cur, ' '), '[.!?。！？…:;]$') AND NOT regexp_matches(ltrim(cur, ' '), '^["“‘'']')) AND NOT regexp_matches(nxt, '^(?:  |\t|　)') AS go FROM (SELECT *, ls[i + 1] AS nxt FROM r WHERE i < len(ls))))
SELECT doc_id, done || cur AS text FROM r WHERE i = len(ls)""")
def paragraph_join(t):
    return t("documents").select("doc_id", X.joined_paragraphs(F.col("text")).alias("text"))


@query()
def refine_plain(t):
    return t("documents").select("doc_id", M.refined_plain(F.col("text")).alias("text"))


@query()
def html_to_md(t):
    pages = t("pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return readers.parse(pages).select("path", "status", "body")


@query("SELECT doc_id, '---' || chr(10) || 'id: \"' || doc_id || '\"' || chr(10) || 'source: \"' || source || '\"' || chr(10) || 'tags:' || chr(10) || '  - \"' || lang || '\"' || chr(10) || 'topics: []' || chr(10) || '---' || chr(10) AS front FROM documents")
def frontmatter_render(t):
    return t("documents").select("doc_id", sinks.front_matter({"id": F.col("doc_id"), "source": F.col("source")}, {"tags": F.array("lang"), "topics": F.array().cast("array<string>")}).alias("front"))


@query("SELECT doc_id, 'source: ' || source AS front, md5(text) AS body FROM documents")
def frontmatter_split(t):
    front, body = sinks.split_front_matter(F.concat(F.lit("---\nsource: "), F.col("source"), F.lit("\n---\n"), F.col("text")))
    return t("documents").select("doc_id", front.alias("front"), F.md5(body).alias("body"))


@query("""SELECT doc_id, '# d' || doc_id || chr(10) || chr(10) || '## 문서 개요' || chr(10) || chr(10) || lang || chr(10) || chr(10) || '## 본문 내용' || chr(10) || chr(10) || text || chr(10) || chr(10) || '## 변환 품질' || chr(10) || chr(10) || '- success' || chr(10) AS md FROM documents""")
def markdown_template(t):
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return t("documents").select("doc_id", sinks.markdown(name, F.col("lang"), F.concat(F.lit("# "), name, F.lit("\n\n"), F.col("text")), F.lit("success")).alias("md"))


@query(r"""WITH l AS (SELECT o_custkey AS page, repeat('x', CAST(o_custkey % 40 AS INTEGER)) || ' ' || (o_orderkey % 2000) AS line FROM orders)
SELECT page, count(*) >= 12 AND avg(length(trim(line))) <= 30 AND avg(CASE WHEN regexp_matches(line, ' [0-9]{1,3}$') THEN 1 ELSE 0 END) >= 0.2 AS contents FROM l GROUP BY page""")
def contents_pages(t):
    line = F.expr("concat(repeat('x', int(o_custkey % 40)), ' ', o_orderkey % 2000)")
    page = t("orders").groupBy(F.col("o_custkey").alias("page")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return page.select("page", P.contents_page(F.col("text")).alias("contents"))


@query("""WITH p AS (SELECT conv_id AS doc, text FROM conversations UNION ALL SELECT -1 - o_orderkey, o_orderstatus FROM orders)
SELECT doc, count(*) AS pages, CAST(sum(length(trim(coalesce(text, ''), ' '))) AS BIGINT) AS chars, sum(length(trim(coalesce(text, ''), ' '))) < 20 * count(*) AS scan FROM p GROUP BY doc""")
def scan_report(t):
    """Whole turns as pages of conversations, and orders as books of one short page."""
    return P.scans(t("conversations").select(F.col("conv_id").alias("doc"), "text").unionByName(t("orders").selectExpr("-1 - o_orderkey AS doc", "o_orderstatus AS text")))


@query(r"""WITH p AS (SELECT conv_id AS doc, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM conversations), q AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY turn DESC) AS back FROM p WHERE x <> '')
SELECT doc, string_agg(x || CASE WHEN back = 1 THEN '' WHEN regexp_matches(x, '[.!?…:;]$') THEN chr(10) || chr(10) ELSE ' ' END, '' ORDER BY turn) AS body FROM q GROUP BY doc""")
def page_join(t):
    return P.joined_pages(t("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text"))


@query("""WITH l AS (SELECT doc_id AS page, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY line_no) AS up, row_number() OVER (PARTITION BY page ORDER BY line_no DESC) AS down FROM l WHERE trim(line, ' ') <> '')
SELECT page, CAST(line_no AS INTEGER) AS line_no, line FROM r WHERE least(up, down) <= 2""")
def edge_rows(t):
    return P.edge_lines(t("documents").select(F.col("doc_id").alias("page"), "text"))


@query("""WITH l AS (SELECT conv_id AS doc, turn AS page, CASE WHEN turn % 2 = 0 THEN 'PART ' || (turn % 3) ELSE role END AS line, turn % 2 = 0 AS part FROM conversations)
SELECT doc, page, line FROM (SELECT *, row_number() OVER (PARTITION BY doc, line ORDER BY page) AS n FROM l) WHERE NOT part OR n = 1""")
def part_header_lines(t):
    line = F.expr("CASE WHEN turn % 2 = 0 THEN concat('PART ', turn % 3) ELSE role END")
    return P.part_headers(t("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.lit(0).alias("line_no"), line.alias("line"))).drop("line_no")


@query("""WITH b AS (SELECT l_orderkey AS page, CAST(l_partkey % 5 * 100 AS DOUBLE) AS x0, CAST(l_partkey % 5 * 100 + 40 + l_suppkey % 50 AS DOUBLE) AS x1 FROM lineitem), w AS (SELECT *, min(x0) OVER (PARTITION BY page) AS lo, max(x1) OVER (PARTITION BY page) - min(x0) OVER (PARTITION BY page) AS span FROM b),
n AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY page) AS c FROM w WHERE x1 - x0 <= span * 0.6) WHERE c >= 2), g AS (SELECT page, lo, unnest(range(CAST(floor(span * 0.12) AS BIGINT), CAST(floor(span * 0.88) AS BIGINT))) AS x FROM (SELECT DISTINCT page, lo, span FROM n)),
e AS (SELECT g.*, x - row_number() OVER (PARTITION BY page ORDER BY x) AS island FROM g WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.page = g.page AND g.x >= floor(n.x0 - n.lo) AND g.x < floor(n.x1 - n.lo)))
SELECT page, unnest(list_sort(list(m))) AS gutter FROM (SELECT page, lo + (min(x) + max(x) + 1) / 2.0 AS m FROM e GROUP BY page, lo, island HAVING count(*) >= 6) GROUP BY page""")
def column_gutters(t):
    return P.gutters(t("lineitem").selectExpr("l_orderkey AS page", "double(l_partkey % 5 * 100) AS x0", "double(l_partkey % 5 * 100 + 40 + l_suppkey % 50) AS x1")).select("page", F.explode("gutters").alias("gutter"))


@query("""WITH RECURSIVE f AS (SELECT DISTINCT l_orderkey AS page, l_partkey % 800 AS y FROM lineitem WHERE l_partkey % 800 > 60 AND l_partkey % 800 < 680),
r AS (SELECT page, min(y) AS y FROM f GROUP BY page UNION ALL SELECT r.page, min(f.y) FROM r JOIN f ON f.page = r.page AND f.y >= r.y + 20 GROUP BY r.page, r.y)
SELECT p.page, CAST(count(r.y) AS INTEGER) AS n_cuts, CAST(count(r.y) FILTER (r.y <= 400) AS INTEGER) AS band FROM (SELECT DISTINCT l_orderkey AS page FROM lineitem) p LEFT JOIN r USING (page) GROUP BY p.page""")
def page_bands(t):
    page = t("lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_list(F.expr("double(l_partkey % 800)")).alias("edges"))
    return page.withColumn("cuts", P.cuts(F.col("edges"), F.lit(800.0))).select("page", F.size("cuts").alias("n_cuts"), P.band(F.lit(400.0), F.col("cuts")).alias("band"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, text || chr(10) || (SELECT string_agg(i || ' entry', chr(10) ORDER BY i) FROM range(1, CAST(doc_id % 60 AS INTEGER) + 2) t(i)) AS x FROM documents),
m AS (SELECT doc_id, regexp_extract_all(regexp_replace(x, '([^0-9])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_(\-:.,/])([0-9]{1,4})(?:[^\p{L}\p{N}_%)\-:.,/~]|$)', 1) AS v FROM d),
n AS (SELECT doc_id, unnest(v)::INTEGER AS v, generate_subscripts(v, 1) AS j FROM m),
c AS (SELECT doc_id, j, v, 1 AS k FROM n UNION SELECT b.doc_id, b.j, b.v, a.k + 1 FROM c a JOIN n b ON a.doc_id = b.doc_id AND b.v - a.v BETWEEN 1 AND 4 AND b.j - a.j BETWEEN 1 AND 400)
SELECT doc_id, CAST(coalesce(max(k), 0) AS INTEGER) AS entries, coalesce(max(k), 0) >= 30 AS numbered FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id""")
def numbered_books(t):
    text = F.expr("concat_ws('\n', text, array_join(transform(sequence(1, int(doc_id % 60) + 1), i -> concat(i, ' entry')), '\n'))")
    return t("documents").select("doc_id", E.chain_length(text).alias("entries")).withColumn("numbered", F.col("entries") >= E.LEAST)


@query()
def block_paragraphs(t):
    b = t("conversations").selectExpr("conv_id", "turn", "text", "turn * 30.0D AS y0", "turn * 30.0D + 30 - conv_id % 20 AS y1", "role = 'system' AS is_table")
    return B.paragraphs(b, ["conv_id"], "turn")


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS page, 'p' || l_partkey AS text, CAST(l_suppkey % 500 AS DOUBLE) AS x0, CAST(l_partkey % 800 AS DOUBLE) AS y0, CAST(l_partkey % 800 + 5 + l_linenumber * 6 AS DOUBLE) AS y1 FROM lineitem),
o AS (SELECT *, (y0 + y1) / 2 AS cy, y1 - y0 AS h, row_number() OVER (PARTITION BY page ORDER BY y0, x0, y1, text) AS i FROM l),
r AS (SELECT page, i, 0 AS row_no, cy AS first, h AS total, 1 AS n FROM o WHERE i = 1 UNION ALL
SELECT page, i, CASE WHEN same THEN row_no ELSE row_no + 1 END, CASE WHEN same THEN first ELSE cy END, CASE WHEN same THEN total + h ELSE h END, CASE WHEN same THEN n + 1 ELSE 1 END
FROM (SELECT o.page, o.i, o.cy, o.h, r.row_no, r.first, r.total, r.n, abs(o.cy - r.first) < greatest(12, r.total / r.n * 0.5) AS same FROM r JOIN o ON o.page = r.page AND o.i = r.i + 1))
SELECT page, CAST(row_no AS INTEGER) AS row_no, string_agg(text, ' ' ORDER BY x0, y0, text) AS text, min(y0) AS y0, max(y1) AS y1 FROM r JOIN o USING (page, i) GROUP BY page, row_no""")
def scan_rows(t):
    line = F.expr("named_struct('text', concat('p', l_partkey), 'x0', double(l_suppkey % 500), 'y0', double(l_partkey % 800), 'x1', double(600), 'y1', double(l_partkey % 800 + 5 + l_linenumber * 6))")
    return t("lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(B.scan_rows(F.collect_list(line)).alias("r")).select("page", F.posexplode("r").alias("row_no", "r")).select("page", "row_no", "r.text", "r.y0", "r.y1")


#: Conversations as books of pages, with a running header on each page.
_book = ["conv_id % 5 AS doc", "conv_id * 100 + turn AS page", "concat('아침에 읽는 짧은 글 모음 ', turn, '\\n', text) AS text"]
#: Defects of scanned Korean texts, one of them put before each document.
_defects = "element_at(array('훌륨한 영항을 주었디-. 할수있다 이를위해 ', 'OO52 우리의 성공（파트너십）：시작 艾^ ', '『길매기의 꿈J 〈용서받지 못한 자X2005) ', '모든 사람에게 모든 것을 공유할 힘을 주어라 Give everyone the power. '), int(doc_id % 4) + 1)"


@query()
def refine_markdown(t):
    return M.refined_markdown(t("documents").select("doc_id", F.expr("concat('---\\nid: ', doc_id, '\\n---\\n', text, '\\n```\\n', lang, '\\n```\\n| a | b |')").alias("text")))


@query()
def ko_refine(t):
    return t("documents").select("doc_id", korean.refined(F.expr(f"concat({_defects}, text)")).alias("text"))


@query()
def ko_noise_page(t):
    return t("documents").select("doc_id", noise.clean_page(F.expr(f"concat({_defects}, text)")).alias("text"))


@query()
def ko_brackets(t):
    return t("documents").select("doc_id", noise.quote_brackets(F.expr(f"concat({_defects}, text)")).alias("text"))


@query()
def ko_language_split(t):
    text, n = noise.split_languages(F.expr(f"concat({_defects}, text)"))
    return t("documents").select("doc_id", text.alias("text"), n.alias("splits"))


@query(r"""WITH p AS (SELECT conv_id % 5 AS doc, conv_id * 100 + turn AS page, '아침에 읽는 짧은 글 모음 ' || turn || chr(10) || coalesce(text, '') AS text FROM conversations),
l AS (SELECT doc, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls, regexp_replace(text, '[^가-힣A-Za-z]', '', 'g') AS bare FROM p),
e AS (SELECT doc, page, lower(regexp_replace(unnest(list_transform(ls[1:2] || ls[-2:], lambda x: substr(x, 1, 30)) || list_transform(ls[1:2] || ls[-2:], lambda x: right(x, 30))), '[^가-힣A-Za-z]', '', 'g')) AS s FROM l),
g AS (SELECT DISTINCT doc, page, substr(s, CAST(i AS INTEGER), 4) AS gram FROM e, LATERAL (SELECT unnest(range(1, greatest(length(s) - 2, 1))) AS i)),
w AS (SELECT DISTINCT doc, page, substr(lower(bare), CAST(i AS INTEGER), 4) AS gram FROM l, LATERAL (SELECT unnest(range(1, greatest(length(bare) - 2, 1))) AS i)),
a AS (SELECT doc, gram, count(*) AS n FROM w GROUP BY ALL), b AS (SELECT doc, gram, count(*) AS n FROM g JOIN w USING (doc, page, gram) GROUP BY ALL), c AS (SELECT doc, greatest(5, floor(count(*) * 0.03)) AS need FROM p GROUP BY doc)
SELECT doc, gram FROM b JOIN a USING (doc, gram) JOIN c USING (doc) WHERE b.n >= need AND b.n >= 0.6 * a.n""")
def header_grams(t):
    return K.header_grams(t("conversations").selectExpr(*_book)).select("doc", F.explode("grams").alias("gram"))


@query()
def fuzzy_headers(t):
    return K.without_headers(t("conversations").selectExpr(*_book))


@query()
def book_matter_pages(t):
    return K.book_matter(t("conversations").selectExpr("conv_id % 5 AS doc", "conv_id * 100 + turn AS page", "if(turn = 0, concat('저자 ', text, ' 지음 | 175면 | 11,000원'), text) AS text"))


@query()
def quote_groups(t):
    return K.grouped_quotes(t("conversations").selectExpr("conv_id % 5 AS doc", "conv_id * 100 + turn AS page", "concat('고난\\n46\\n', text, '\\n찰스 스탠리(1932-), 목사\\n', text, '\\n토저(1897-1963), 저자') AS text"))


@query()
def entry_paragraphs(t):
    text = F.expr("concat('019 001\\n002\\n', array_join(transform(sequence(1, int(doc_id % 60) + 1), i -> concat(lpad(i, 3, '0'), ' 하나의 긴 항목을 적은 문장이다')), '\\n'), '\\n', text)")
    return t("documents").select("doc_id", E.entry_paragraphs(text).alias("text"))


@query()
def re_read_lines(t):
    broken = t("conversations").select(F.col("conv_id").alias("doc"), F.col("text").alias("reading"))
    reads = broken.withColumn("line", F.translate("reading", "aeo", "\u0b01\u0c02\u0d03"))
    return reread.repaired(reads.select("doc", F.concat(F.lit("> "), "line").alias("text")), reread.fixes(reads))


@query()
def rejoined_pages(t):
    return P.rejoined_pages(t("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.regexp_replace("text", "[.!?]$", ",").alias("text")))


@query("""SELECT conv_id, turn, n >= 2 OR regexp_matches(name, '\\b(english|grammar|idioms?)\\b') AS study FROM (SELECT conv_id, turn, lower(coalesce(role, '')) AS name, CAST(contains(s, 'dialogue') AS INTEGER) + CAST(contains(s, 'idiom') AS INTEGER) AS n
FROM (SELECT *, lower(substr(text || CASE WHEN turn % 2 = 0 THEN ' Idiom' ELSE '' END || CASE WHEN conv_id % 3 = 0 THEN ' dialogue' ELSE '' END, 1, 3000)) AS s FROM conversations))""")
def study_material(t):
    c = F.expr("concat(text, if(turn % 2 = 0, ' Idiom', ''), if(conv_id % 3 = 0, ' dialogue', ''))")
    return t("conversations").select("conv_id", "turn", X.study_material(c, F.col("role")).alias("study"))


@query("""WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, coalesce(text, '') AS text FROM conversations),
n AS (SELECT a.conv_id, a.turn, count(b.turn) AS near FROM p a LEFT JOIN p b ON a.conv_id = b.conv_id AND b.nth <> a.nth AND abs(b.nth - a.nth) <= 3 GROUP BY ALL)
SELECT conv_id, turn, md5(CASE WHEN near >= 2 THEN 'body of the page' || chr(10) || 'its last words' ELSE 'body of the page' || chr(10) || 'its last words' || chr(10) || (70 + nth) END) AS digest, CAST(CASE WHEN near >= 2 THEN 1 ELSE 0 END AS INTEGER) AS removed FROM n JOIN p USING (conv_id, turn)""")
def page_numbers_removed(t):
    """Pages of conversations that end in a number which rises with them."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    text = F.concat(F.lit("body of the page\nits last words\n"), (nth + 70).cast("string"))
    done = numbers.without_page_numbers(t("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), text.alias("text")))
    return done.select(F.col("doc").alias("conv_id"), F.col("page").alias("turn"), F.md5("text").alias("digest"), "removed")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 800 AS y0, l_partkey % 800 + 12 AS y1, CASE l_suppkey % 4 WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN 'DBR ' || l_partkey WHEN 2 THEN repeat('a line of the page ', 5) ELSE 'Downloaded by ' || l_suppkey END AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, contains(t, 'Downloaded by') OR (y0 < 55 AND length(t) < 80 AND (contains(t, 'DBR') OR regexp_matches(t, '^[0-9]{1,4}$') OR length(t) <= 4)) OR (y1 > 685 AND length(t) < 80 AND (contains(t, 'DBR') OR regexp_matches(t, '^[0-9]{1,4}$'))) AS margin FROM b""")
def margin_blocks(t):
    text = F.expr("CASE l_suppkey % 4 WHEN 0 THEN string(l_partkey) WHEN 1 THEN concat('DBR ', l_partkey) WHEN 2 THEN repeat('a line of the page ', 5) ELSE concat('Downloaded by ', l_suppkey) END")
    y = F.expr("l_partkey % 800")
    return t("lineitem").select("l_orderkey", "l_linenumber", layout.margin(text, y, y + 12, F.lit(800)).alias("margin"))


@query("SELECT doc_id, trim(regexp_replace(trim(regexp_replace(replace(text, '. ', ' [1, 2-3]. '), '\\s*\\[[0-9]+(?:\\s*[-,]\\s*[0-9]+)*\\]', '', 'g')), '[.]+$', '')) AS text FROM documents".replace("\\\\", "\\"))
def citations_stripped(t):
    return t("documents").select("doc_id", metadata.strip_cite(F.expr("replace(text, '. ', ' [1, 2-3]. ')")).alias("text"))


@query("""SELECT doc_id, 'in/' || source || '/d' || doc_id || '.txt' AS normal, CASE WHEN source = 'src1' THEN 'd' || doc_id || '.txt' ELSE source || '/d' || doc_id || '.txt' END AS relative FROM documents""")
def paths_normal(t):
    d = t("documents").select("doc_id", "source", documents.normal_path(F.expr("concat(' \"in\\\\', source, '//./d', doc_id, '.txt\" ')")).alias("normal"))
    return d.select("doc_id", "normal", documents.relative_path(F.col("normal"), "in/src1").alias("relative"))


@query("""SELECT doc, round(avg(m), 6) AS avg_score, CASE WHEN avg(m) IS NULL THEN 'unknown' WHEN round(avg(m), 6) >= 0.85 THEN 'high' WHEN round(avg(m), 6) >= 0.65 THEN 'medium' ELSE 'low' END AS confidence, coalesce(round(avg(m), 6) < 0.7, true) AS review
FROM (SELECT l_suppkey AS doc, l_linenumber AS page, avg(s) FILTER (s > 0) AS m FROM (SELECT *, CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE (l_quantity + l_suppkey % 50) / 100 END AS s FROM lineitem) GROUP BY ALL) GROUP BY doc""")
def scan_confidence(t):
    return scans.document_confidence(t("lineitem").selectExpr("l_suppkey doc", "l_linenumber page", "if(l_suppkey % 10 = 0, 0, (l_quantity + l_suppkey % 50) / 100) score"))


def _fields(f: Callable[[str, str, str], str]) -> str:
    given = {"title": "'d' || doc_id", "category": "source", "source": "source", "id": "CAST(doc_id AS VARCHAR)", "created": "'2026-01-01'", "tags": "lang", "errors": "source"}
    return " || chr(10) || ".join(f(k, kind, given.get(k) if k in given else default) for k, kind, default in documents.FIELDS if k in given or default is not None)


def _field_sql(key: str, kind: str, x) -> str:
    if kind in (documents.TAGS, documents.LIST):
        return f"'{key}: []'" if x == [] else f"'{key}:' || chr(10) || '  - ' || " + (x if kind == documents.TAGS else f"'\"' || {x} || '\"'")
    literal = x if "||" in str(x) or x in ("source", "lang") or str(x).startswith(("CAST", "'")) else f"'{x}'"
    return f"'{key}: ' || " + (f"'\"' || {literal} || '\"'" if kind in (documents.TEXT, documents.QUOTED) else literal)


@query(f"SELECT doc_id, '---' || chr(10) || {_fields(_field_sql)} || chr(10) || '---' || chr(10) AS front FROM documents")
def front_matter_fields(t):
    values = {"title": F.concat(F.lit("d"), F.col("doc_id").cast("string")), "category": F.col("source"), "source": F.col("source"), "id": F.col("doc_id"), "created": F.lit("2026-01-01"), "tags": F.array("lang"), "errors": F.array("source")}
    return t("documents").select("doc_id", documents.front_matter(values).alias("front"))


@query()
def document_tags(t):
    d = t("documents").withColumn("category", metadata.category(F.col("text"), F.col("source"), F.col("lang")))
    return d.select("doc_id", "category", F.array_join(metadata.tags(F.col("text"), F.col("source"), F.col("category")), "|").alias("tags"), metadata.summary(F.col("text")).alias("summary"), metadata.title(F.col("text"), F.col("source")).alias("title"))


@query()
def converted_documents(t):
    """Documents as files, converted from bytes to the Markdown that is written."""
    f = t("documents").select(F.concat(F.lit("/in/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"), F.timestamp_seconds(F.col("doc_id")).alias("modificationTime"))
    return documents.converted(f, "2026-01-01T00:00:00Z", "/in")


@query()
def page_layout(t):
    """Line items as blocks of pages in two columns, with tables and wide blocks."""
    b = t("lineitem").selectExpr("l_suppkey AS doc", "l_orderkey AS page", "800.0D AS page_h", "IF(l_linenumber % 5 = 0, 50, IF(l_partkey % 2 = 0, 50, 320)) AS x0", "80.0 + l_linenumber * 40 AS y0", "IF(l_linenumber % 5 = 0, 560, IF(l_partkey % 2 = 0, 280, 550)) AS x1", "100.0 + l_linenumber * 40 AS y1", "concat('block ', l_partkey, ' of a page', IF(l_linenumber % 3 = 0, '.', '')) AS text", "l_linenumber = 7 AS is_table")
    return layout.page_texts(b)


@query()
def scanned_documents(t):
    """Turns of conversations as recognised lines of scanned books."""
    words = F.regexp_extract_all("text", F.lit("(?:[^ \n]+[ \n]?){1,8}"), 0)
    lines = t("conversations").select((F.col("conv_id") % 5).cast("string").alias("doc"), (F.col("conv_id") * 100 + F.col("turn")).alias("page"), F.posexplode(words).alias("k", "text"), F.lit(0.8).alias("score"))
    box = {"x0": F.lit(60.0), "y0": F.col("k") * 18 + 120.0, "x1": F.lit(500.0), "y1": F.col("k") * 18 + 132.0, "page_w": F.lit(595.0), "page_h": F.greatest(F.lit(842.0), F.max("k").over(Window.partitionBy("doc", "page")) * 18 + 400.0)}
    return scans.documents(lines.withColumns(box))
