"""Queries over files, pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import files, tables, text
from ..operators import pages
from .registry import Tables, query

PLAIN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
  '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[[^\]]*\]\([^)]*\)', ' ', 'g'), '```[\s\S]*?```', ' ', 'g'), '`[^`]+`', ' ', 'g'), '[#*_~|<>{{}}\\\-=+]', ' ', 'g'), '\s+', ' ', 'g'))"""
CLEAN = r"(1 - (length({0}) - length(regexp_replace({0}, '[\x{{FFFD}}\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'))) / length({0}))"
LETTERS = r"(length(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g')) / length({0}))"
WORDS = "(len(list_filter(string_split({0}, ' '), lambda w: length(w) BETWEEN 2 AND 20)) / len(string_split({0}, ' ')))"


def confidence_sql(source: str, keys: str, column: str = "text") -> str:
    """Page confidence over a relation, by the same rule as the column function."""
    clean = CLEAN.format("t")
    return f"""(SELECT {keys}, t AS text, round(least(99.9, greatest(0.0, CASE WHEN p = '' THEN {clean} * 50.0
      ELSE {clean} * 50.0 + {LETTERS.format("p")} * 30.0 + {WORDS.format("p")} * 20.0 END)), 2) AS confidence
      FROM (SELECT {keys}, {column} AS t, {PLAIN.format(column)} AS p FROM {source}))"""


#: Mean of page confidences, which have two digits, rounded half up: in whole hundredths, as a mean of doubles leaves ties to the order of their sum.
MEAN = "CAST((2 * sum(CAST(round(confidence * 100) AS BIGINT)) + count(confidence)) // (2 * count(confidence)) AS DOUBLE) / 100"
SNIFF = """CASE WHEN octet_length(content) < 10 THEN 'unknown' WHEN starts_with(h, '25504446') THEN 'pdf'
  WHEN starts_with(h, 'FFD8FF') OR starts_with(h, '89504E47') OR starts_with(h, '474946383761') OR starts_with(h, '474946383961') OR starts_with(h, '424D')
    OR starts_with(h, '49492A00') OR starts_with(h, '4D4D002A') OR (starts_with(h, '52494646') AND contains(h, '57454250')) THEN 'image' ELSE 'unknown' END"""
MIME = """CASE WHEN starts_with(h, 'FFD8') THEN 'image/jpeg' WHEN starts_with(h, '89504E470D0A1A0A') THEN 'image/png' WHEN starts_with(h, '47494638') THEN 'image/gif'
  WHEN starts_with(h, '424D') THEN 'image/bmp' WHEN starts_with(h, '52494646') AND contains(h, '57454250') THEN 'image/webp'
  WHEN starts_with(h, '49492A00') OR starts_with(h, '4D4D002A') THEN 'image/tiff' ELSE 'image/jpeg' END"""
HEADS = "(SELECT *, substr(hex(content), 1, 24) AS h FROM raw_files)"


@query("t1_file_type", f"SELECT file_id, {SNIFF} AS kind FROM {HEADS}")
def t1(t: Tables) -> DataFrame:
    return t.raw_files.select("file_id", files.file_type(F.col("content")).alias("kind"))


@query("t2_image_mime", f"SELECT file_id, {MIME} AS mime, {MIME} AS mime64 FROM {HEADS}")
def t2(t: Tables) -> DataFrame:
    return t.raw_files.select("file_id", files.image_mime(F.col("content")).alias("mime"), files.base64_mime(F.base64("content")).alias("mime64"))


@query("t3_extensions", f"""SELECT file_id, CASE m WHEN 'image/jpeg' THEN 'jpg' ELSE substr(m, 7) END AS extension, m AS back FROM (SELECT file_id, {MIME} AS m FROM {HEADS})""")
def t3(t: Tables) -> DataFrame:
    extension = files.extension_of(files.image_mime(F.col("content")))
    return t.raw_files.select("file_id", extension.alias("extension"), files.mime_of(extension).alias("back"))


@query("t4_admission", f"""
SELECT request_id, CASE WHEN file_size = 0 THEN '400 empty' WHEN file_size > (CASE channel WHEN 'user' THEN 104857600 WHEN 'trial' THEN 10485760 ELSE 52428800 END) THEN '413 too large'
  WHEN kind = 'unknown' THEN '415 unknown' ELSE 'ok' END AS admission
FROM (SELECT request_id, file_size, ['user', 'trial', 'enterprise'][request_id % 3 + 1] AS channel, coalesce(kind, 'unknown') AS kind
  FROM ocr_requests LEFT JOIN (SELECT file_id, {SNIFF} AS kind FROM {HEADS}) ON file_id = request_id % greatest(1, (SELECT count(*) FROM documents)))""")
def t4(t: Tables) -> DataFrame:
    kinds = t.raw_files.select("file_id", files.file_type(F.col("content")).alias("kind"))
    channel = F.element_at(F.array(*map(F.lit, ("user", "trial", "enterprise"))), (F.col("request_id") % 3 + 1).cast("int"))
    files_ = F.broadcast(t.documents.agg(F.greatest(F.lit(1), F.count("*")).alias("files")))  # one row
    joined = t.ocr_requests.crossJoin(files_).join(kinds, F.col("file_id") == F.col("request_id") % F.col("files"), "left")
    return joined.select("request_id", files.admission(F.col("file_size"), F.coalesce("kind", F.lit("unknown")), channel).alias("admission"))


@query("t6_engine", """SELECT request_id, CASE WHEN role IS NULL THEN 'docai' WHEN role IN ('super_user', 'admin') THEN 'mistral'
  WHEN subscription_pages_total > subscription_pages_used THEN 'mistral' ELSE 'docai' END AS engine FROM ocr_requests LEFT JOIN users ON id = user_id""")
def t6(t: Tables) -> DataFrame:
    joined = t.ocr_requests.join(t.users, F.col("id") == F.col("user_id"), "left")
    return joined.select("request_id", files.engine(F.col("role"), F.col("subscription_pages_total") > F.col("subscription_pages_used")).alias("engine"))


@query("t7_size_route", """
SELECT request_id, CASE WHEN engine = 'docai' THEN 'docai' WHEN rest > 52428800 THEN 'docai' WHEN error IS NOT NULL AND contains(error, '413') THEN 'docai' WHEN error IS NOT NULL THEN 'error' WHEN size > 47185920 THEN 'compress' ELSE 'mistral' END AS route,
  CASE WHEN engine = 'docai' THEN NULL WHEN rest > 52428800 THEN 'size' WHEN error IS NOT NULL AND contains(error, '413') THEN 'refused' WHEN error IS NOT NULL THEN 'error' END AS reason
FROM (SELECT *, CASE WHEN size > 47185920 THEN size * 7 // 10 ELSE size END AS rest FROM (SELECT request_id, (request_id * 7919 % 100000000)::BIGINT AS size,
  CASE WHEN request_id % 7 = 0 THEN 'HTTP 413' WHEN request_id % 11 = 0 THEN 'timeout' END AS error,
  CASE WHEN role IN ('super_user', 'admin') OR subscription_pages_total > subscription_pages_used THEN 'mistral' ELSE 'docai' END AS engine FROM ocr_requests LEFT JOIN users ON id = user_id))""")
def t7(t: Tables) -> DataFrame:
    size, error = (F.col("request_id") * 7919 % 100000000).cast("long"), F.when(F.col("request_id") % 7 == 0, "HTTP 413").when(F.col("request_id") % 11 == 0, "timeout")
    rows = t6(t).select("request_id", "engine", size.alias("size"), error.alias("error")).withColumn("compressed", F.expr("size * 7 div 10"))
    route = files.size_route(F.col("engine"), F.col("size"), F.col("compressed"), F.col("error"))
    return rows.select("request_id", route.alias("r")).select("request_id", "r.*")


@query("t8_stored_name", r"""SELECT id, strftime(created_at, '%Y%m%d_%H%M%S') || '_' || substr(sha256(id::VARCHAR), 1, 8) || '_' || substr(regexp_replace(source, '[^\p{L}\p{N}_-]', '', 'g'), 1, 50) || '.pdf' AS stored
FROM (SELECT *, substr(filename, 1, length(filename) - 4) AS source FROM ocr_documents)""")
def t8(t: Tables) -> DataFrame:
    return t.ocr_documents.select("id", files.stored_name(F.col("filename"), F.col("created_at"), F.col("id")).alias("stored"))


@query("s1_file_scan", f"SELECT {SNIFF} AS kind, count(*) AS files, sum(octet_length(content))::BIGINT AS bytes FROM {HEADS} GROUP BY 1")
def s1(t: Tables) -> DataFrame:
    return t.raw_files.groupBy(files.file_type(F.col("content")).alias("kind")).agg(F.count("*").alias("files"), F.sum(F.length("content")).cast("long").alias("bytes"))


@query("x1_x4_text_signals", f"""SELECT document_id, page_number, {PLAIN.format("text")} AS plain, {CLEAN.format("text")} AS clean, {LETTERS.format(PLAIN.format("text"))} AS letters,
  {WORDS.format(PLAIN.format("text"))} AS words FROM page_results WHERE {PLAIN.format("text")} <> ''""")
def x1(t: Tables) -> DataFrame:
    p = t.page_results.withColumn("plain", text.plain(F.col("text"))).where("plain <> ''")
    return p.select("document_id", "page_number", "plain", text.clean_share(F.col("text")).alias("clean"), text.letter_share(F.col("plain")).alias("letters"), text.word_share(F.col("plain")).alias("words"))


@query("x5_page_confidence", f"SELECT id, confidence FROM {confidence_sql('ocr_documents', 'id', 'extracted_text')}")
def x5(t: Tables) -> DataFrame:
    return t.ocr_documents.select("id", text.page_confidence(F.col("extracted_text")).alias("confidence"))


@query("x15_header_footer", """SELECT document_id, page_number, CASE WHEN page_number % 3 = 0 THEN 'Head ' || document_id || chr(10) || chr(10) ELSE '' END || text ||
  CASE WHEN page_number % 2 = 0 THEN chr(10) || chr(10) || 'p. ' || page_number ELSE '' END AS text FROM page_results""")
def x15(t: Tables) -> DataFrame:
    header = F.when(F.col("page_number") % 3 == 0, F.concat(F.lit("  Head "), F.col("document_id").cast("string"), F.lit(" ")))
    footer = F.when(F.col("page_number") % 2 == 0, F.concat(F.lit("p. "), F.col("page_number").cast("string"), F.lit("\n")))
    return t.page_results.select("document_id", "page_number", text.framed(header, F.col("text"), footer).alias("text"))


@query("x18_language_mode", """SELECT user_id, CASE WHEN len(langs) > 1 THEN 'mixed' ELSE coalesce(map {'en': 'english', 'fr': 'french', 'de': 'german', 'es': 'spanish'}[langs[1]], langs[1]) END AS mode
FROM (SELECT user_id, list(DISTINCT lang) AS langs FROM ocr_documents GROUP BY user_id)""")
def x18(t: Tables) -> DataFrame:
    return t.ocr_documents.groupBy("user_id").agg(F.collect_set("lang").alias("l")).select("user_id", text.language_mode(F.col("l")).alias("mode"))


@query("x19_token_confidence", """SELECT document_id, page_number, coalesce(round(avg(c) FILTER (WHERE c > 0) * 100, 2), 99.0) AS confidence
FROM (SELECT l_orderkey AS document_id, l_linenumber AS page_number, l_discount AS c FROM lineitem) GROUP BY ALL""")
def x19(t: Tables) -> DataFrame:
    tokens = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number"), F.col("l_discount").alias("confidence"))
    return pages.token_confidence(tokens, tokens)


@query("x20_x21_blend_preview", f"""SELECT id, 0.6 * confidence + 0.4 * 90.0 AS blend, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS preview,
  CASE WHEN length(text) > 180 THEN substr(text, 1, 180) || '...' ELSE text END AS description FROM {confidence_sql('ocr_documents', 'id', 'extracted_text')}""")
def x20(t: Tables) -> DataFrame:
    return t.ocr_documents.select("id", text.blend(text.page_confidence(F.col("extracted_text")), F.lit(90.0)).alias("blend"), text.preview(F.col("extracted_text")).alias("preview"), text.preview(F.col("extracted_text"), 180, 180).alias("description"))


E9 = f"""(SELECT document_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_number, text) AS text, {MEAN} AS confidence, count(*) AS total_pages,
  sum(length(text))::BIGINT AS page_characters FROM {confidence_sql('page_results', 'document_id, page_number')} GROUP BY document_id)"""


@query("e9_assembled", f"SELECT *, length(text) AS stored_characters, CASE WHEN confidence < 80 THEN 'LOW CONFIDENCE' ELSE 'OK' END AS class FROM {E9}")
def e9(t: Tables) -> DataFrame:
    """The flagship: page signals, confidence, assembly, class."""
    rows = t.page_results.select("document_id", "page_number", "text", text.page_confidence(F.col("text")).alias("confidence"))
    return pages.assembled(rows).withColumn("class", text.operation_class(F.lit(False), F.col("confidence")))


@query("b15_b16_flags", f"""SELECT id, CASE WHEN id % 19 = 0 THEN 'FAILED' WHEN confidence < 80 THEN 'LOW CONFIDENCE' ELSE 'OK' END AS class, processing_time > (CASE WHEN total_pages > 3 THEN 10.0 ELSE 5.0 END) AS slow,
  confidence < 80 OR processing_time > 10 AS concern, length(trim(text)) < 10 AS little FROM {confidence_sql('ocr_documents', 'id, total_pages, processing_time', 'extracted_text')}""")
def b15(t: Tables) -> DataFrame:
    d = t.ocr_documents.withColumn("confidence", text.page_confidence(F.col("extracted_text")))
    time, conf = F.col("processing_time"), F.col("confidence")
    return d.select("id", text.operation_class(F.col("id") % 19 == 0, conf).alias("class"), text.is_slow(time, F.col("total_pages")).alias("slow"), text.is_concern(time, conf).alias("concern"), text.has_little_text(F.col("extracted_text")).alias("little"))


@query("b16_large_files", "SELECT request_id, file_size > 10485760 AS large FROM ocr_requests")
def b16_large(t: Tables) -> DataFrame:
    return t.ocr_requests.select("request_id", text.is_large(F.col("file_size")).alias("large"))


@query("b18_replies", f"""WITH p AS (SELECT document_id, page_number, text, confidence, length(text) AS n FROM {confidence_sql('page_results', 'document_id, page_number')}),
  d AS (SELECT document_id, count(*) AS pages, {MEAN} AS confidence, CASE WHEN document_id % 3 = 0 THEN string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_number, text) ELSE string_agg(text, chr(10) || chr(10) ORDER BY page_number, text) END AS plain,
    list({{'page_number': page_number, 'confidence': confidence, 'character_count': n, 'text': text}} ORDER BY page_number, text) AS listed, sum(n)::BIGINT AS characters FROM p GROUP BY document_id)
SELECT document_id, plain, pages, languages, mode, engine, length(plain) AS characters, pages > 1 AS has_pages, confidence,
  CASE WHEN pages > 1 THEN characters ELSE length(plain) END AS total_characters, CASE WHEN pages > 1 THEN listed[len(listed)].text ELSE plain END AS last_text, CASE WHEN pages > 1 THEN listed[1].confidence ELSE confidence END AS first_confidence,
  CASE WHEN pages > 1 THEN pages || ' pages processed with ' || printf('%.2f', confidence) || '% average confidence' ELSE '1 page processed with ' || printf('%.2f', confidence) || '% confidence' END AS details
FROM (SELECT *, 'en' AS languages, 'english' AS mode, CASE WHEN document_id % 3 = 0 THEN 'Mistral OCR' ELSE 'Google Document AI' END AS engine FROM d)""")
def b18(t: Tables) -> DataFrame:
    rows = t.page_results.withColumn("confidence", text.page_confidence(F.col("text")))
    third = F.col("document_id") % 3 == 0
    facts = rows.select("document_id").distinct().select(
        "document_id", F.array(F.lit("en")).alias("languages"), F.lit("english").alias("mode"), F.when(third, "Mistral OCR").otherwise("Google Document AI").alias("engine"), F.when(third, "\n\n---\n\n").otherwise("\n\n").alias("separator")
    )
    reply = pages.replies(rows, facts)
    # Read back, so that every field of both replies is compared.
    page = "page_number INT, confidence DOUBLE, character_count INT, text STRING"
    doc = F.from_json("document", f"text STRING, confidence DOUBLE, pages LONG, languages ARRAY<STRING>, mode STRING, engine STRING, pages_data ARRAY<STRUCT<{page.replace(' INT', ': INT').replace(' DOUBLE', ': DOUBLE').replace(' STRING', ': STRING')}>>")
    info = F.from_json("by_page", f"pages_info ARRAY<STRUCT<{page.replace(' INT', ': INT').replace(' DOUBLE', ': DOUBLE').replace(' STRING', ': STRING')}>>, summary STRUCT<total_pages: LONG, average_confidence: DOUBLE, total_characters: LONG, processing_details: STRING>")
    read = reply.select("document_id", "plain", doc.alias("d"), info.alias("i"))
    return read.select(
        "document_id", F.col("d.text").alias("plain"), F.col("i.summary.total_pages").alias("pages"), F.array_join("d.languages", ",").alias("languages"), "d.mode", "d.engine", F.length("d.text").cast("long").alias("characters"), F.col("d.pages_data").isNotNull().alias("has_pages"),
        F.col("d.confidence").alias("confidence"), F.col("i.summary.total_characters").alias("total_characters"), F.element_at("i.pages_info", -1)["text"].alias("last_text"), F.element_at("i.pages_info", 1)["confidence"].alias("first_confidence"), F.col("i.summary.processing_details").alias("details"),
    )


def responses(t: Tables) -> DataFrame:
    """Page output in JSON, with a broken table and a figure on each page, from the conversations."""
    words = F.split("text", " ")
    body = F.concat(F.lit("| a | b |\n| --- | --- |\n| "), words[0], F.lit("\nand  more | "), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("-")), F.lit(" |"))
    table_ = F.array(F.struct(F.concat(F.lit("tbl-"), (F.col("page_number") - 1).cast("string")).alias("id"), body.alias("content")))
    image = F.array(F.struct(F.lit("img-0.png").alias("id"), F.base64(F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode("text", "UTF-8"))).alias("image_base64")))
    key = F.concat(F.lit("tbl-"), (F.col("page_number") - 1).cast("string"), F.lit(".md"))
    markdown = F.concat(F.col("text"), F.lit("\n["), key, F.lit("]("), key, F.lit(")\n![](img-0.png)"))
    page = F.struct((F.col("page_number") - 1).alias("index"), markdown.alias("markdown"), F.lit(" Head ").alias("header"), F.lit(None).cast("string").alias("footer"), image.alias("images"), table_.alias("tables"))
    return t.page_results.groupBy("document_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(page)).alias("pages"))).alias("response"))


@query("s3_page_scan", "SELECT document_id, page_number, length(text) AS n_chars, 1 AS n_tables FROM page_results")
def s3(t: Tables) -> DataFrame:
    rows = pages.from_responses(responses(t))
    tail = F.length(F.regexp_extract("markdown", r"(\n\[tbl-\d+\.md\]\(tbl-\d+\.md\)\n!\[\]\(img-0\.png\))$", 1))
    return rows.select("document_id", "page_number", (F.length("markdown") - tail).cast("long").alias("n_chars"), F.size("tables").alias("n_tables"))


X16 = r"""SELECT document_id, page_number, 'Head' || chr(10) || chr(10) || text || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || replace(string_split(text, ' ')[1], chr(10), ' ') || ' and more | '
  || coalesce(replace(string_split(text, ' ')[2], chr(10), ' '), '-') || ' |' || chr(10) || '![image](/api/v1/ocr/images/ocr_img_' || substr(sha256(document_id || '|' || page_number || '|img-0.png'), 1, 32) || '.png)' AS text FROM page_results"""


@query("x16_page_pipeline", f"WITH x AS ({X16}) SELECT document_id, page_number, text, confidence, length(text) AS character_count FROM {confidence_sql('x', 'document_id, page_number')}")
def x16(t: Tables) -> DataFrame:
    return pages.page_pipeline(pages.from_responses(responses(t))).select("document_id", "page_number", "text", "confidence", "character_count")


@query("s6_e11_figures", """SELECT document_id, count(*) AS figures, sum(round((8 + octet_length(encode(text))) / 1024, 1)) AS kb FROM page_results GROUP BY document_id""")
def s6(t: Tables) -> DataFrame:
    rows = pages.from_responses(responses(t)).select("document_id", "page_number", F.explode("images").alias("i")).select("document_id", "page_number", F.col("i.id").alias("image_id"), "i.image_base64")
    return pages.figures(rows).groupBy("document_id").agg(F.count("*").alias("figures"), F.sum("size_kb").alias("kb"))


def cells_sql(row: str) -> str:
    return f"list_transform(string_split(trim(trim({row}), '|'), '|'), lambda c: trim(c))"


def width_sql(row: str) -> str:
    return f"(length({row}) - length(replace({row}, '|', '')) - 1)"


def filled_sql(cell: str, n: str) -> str:
    return f"('| ' || array_to_string(list_transform(range({n}), lambda i: '{cell}'), ' | ') || ' |')"


HEADER_LIKE = "2 * len(list_filter({0}, lambda c: c <> '')) >= len({0})"
SAYS = f"lambda o: len(list_filter({cells_sql('o')}, lambda c: c NOT IN ('', '-', '–', '—', '.'))) > 0"
#: Table repair by rows of lines: glued by a running count of line starts, then sorted out as lists, one table a row.
REPAIR = rf"""WITH lines AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = 2 THEN x ELSE '| ' || replace(x, ' ', ' |  ') || ' |' END) AS r FROM documents),
  broken AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ['|---|---|'] || r WHEN 1 THEN r[1:1] || ['|---|---|'] || r[2:] WHEN 2 THEN r[1:4] || ['| :-- | --: |'] || r[5:]
    WHEN 4 THEN ['| a | b |', '|  | – | - |', '', '|  |  | c |', '|-|'] || r WHEN 5 THEN ['', ' '] || r || ['', ''] ELSE r END AS r FROM lines),
  l AS (SELECT doc_id, i, trim(r[i]) AS t FROM (SELECT doc_id, r, unnest(range(1, len(r) + 1)) AS i FROM broken)),
  starts AS (SELECT *, t = '' OR starts_with(t, '|') OR coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY i), '') = '' AS begins FROM l),
  g AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM starts),
  glued AS (SELECT doc_id, n, string_agg(t, ' ' ORDER BY i) AS t FROM g GROUP BY doc_id, n),
  squeezed AS (SELECT doc_id, n, CASE WHEN starts_with(t, '|') THEN regexp_replace(t, ' {{2,}}', ' ', 'g') ELSE t END AS t FROM glued),
  ends AS (SELECT *, min(CASE WHEN t <> '' THEN n END) OVER (PARTITION BY doc_id) AS a, max(CASE WHEN t <> '' THEN n END) OVER (PARTITION BY doc_id) AS z FROM squeezed),
  tables AS (SELECT doc_id, list(t ORDER BY n) AS r FROM ends WHERE n BETWEEN a AND z GROUP BY doc_id),
  placed AS (SELECT *, list_position(list_transform(r, lambda x: regexp_matches(x, '^\|\s*[-:]+[\s|:-]*\|$')), true) AS sep, list_position(list_transform(r, lambda x: starts_with(x, '|')), true) AS pipe FROM tables),
  parts AS (SELECT *, r[1:sep - 1] AS above, r[sep] AS line, r[sep + 1:] AS rest, r[sep - 1] AS last FROM placed),
  headed AS (SELECT doc_id, CASE
    WHEN sep IS NULL AND len(list_filter(r, lambda x: starts_with(x, '|'))) > 1 THEN r[1:pipe] || [{filled_sql('---', f"greatest({width_sql('r[pipe]')}, 1)")}] || r[pipe + 1:] WHEN sep IS NULL THEN r
    WHEN sep = 1 THEN [{filled_sql('', f"list_max([{width_sql('line')}, 1] || list_transform(list_filter(rest, lambda x: starts_with(x, '|')), lambda x: {width_sql('x')}))")}, line] || rest
    WHEN {HEADER_LIKE.format(cells_sql('last'))} THEN [last, line] || list_filter(above[1:len(above) - 1], {SAYS}) || rest
    ELSE [{filled_sql('', f"greatest({width_sql('line')}, 1)")}, line] || list_filter(above, {SAYS}) || rest END AS r FROM parts)
SELECT doc_id, array_to_string(list_filter(r, lambda x, i: NOT (trim(x) = '' AND i > 1 AND trim(coalesce(r[i - 1], 'x')) = '')), chr(10)) AS content FROM headed"""


@query("x6_x12_table_repair", REPAIR)
def x6(t: Tables) -> DataFrame:
    """Lines of whole texts as broken tables of six kinds: without, below one and below several rows a separator, with empty rows, blank ends, and none."""
    rows = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 2, x).otherwise(F.concat(F.lit("| "), F.replace(x, F.lit(" "), F.lit(" |  ")), F.lit(" |"))))
    head = lambda n: F.slice(rows, F.lit(1), F.lit(n))
    rest = lambda n: F.slice(rows, F.lit(n + 1), F.size(rows))
    kinds = [
        [tables.strings("|---|---|"), rows], [head(1), tables.strings("|---|---|"), rest(1)], [head(4), tables.strings("| :-- | --: |"), rest(4)], [rows],
        [tables.strings("| a | b |", "|  | – | - |", "", "|  |  | c |", "|-|"), rows], [tables.strings("", " "), rows, tables.strings("", "")],
    ]
    lines = F.element_at(F.array(*[F.concat(*k) for k in kinds]), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.documents.select("doc_id", tables.repaired(F.array_join(lines, "\n")).alias("content"))


@query("x17_languages")
def x17(t: Tables) -> DataFrame:
    """Profiles learned from all labelled documents; a test measures their accuracy on texts left out."""
    docs = t.ocr_documents.select(F.col("id").alias("document_id"), F.col("extracted_text").alias("text"), "lang")
    profiles = pages.language_profiles(docs.select("lang", "text"))
    return pages.detected_languages(docs, pages.language_shares(docs, profiles))


@query("x17_threshold", """WITH w AS (SELECT doc_id, text, unnest([('en', (doc_id * 7) % 11 + 1), ('de', (doc_id * 10) % 12 + 1), ('fr', (doc_id * 13) % 13 + 1), ('xx', (doc_id * 3) % 14 + 1), ('bn', doc_id % 3 * 20 + 1)]) AS x FROM documents),
  p AS (SELECT doc_id, text, x[1] AS lang, x[2]::DOUBLE / sum(x[2]) OVER (PARTITION BY doc_id) AS p FROM w),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, lang) AS n FROM p),
  l AS (SELECT doc_id, any_value(text) AS text, list(lang ORDER BY n) FILTER (WHERE p >= 0.2 OR n = 1) AS langs FROM r GROUP BY doc_id)
SELECT doc_id AS document_id, CASE WHEN length(trim(text)) < 10 THEN 'en' ELSE array_to_string(langs, ',') END AS languages,
  CASE WHEN length(trim(text)) < 10 THEN 'english' WHEN len(langs) > 1 THEN 'mixed' ELSE CASE langs[1] WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'bn' THEN 'bangla' ELSE langs[1] END END AS mode FROM l""")
def x17_threshold(t: Tables) -> DataFrame:
    """The rule on given shares: those of 20 % or more, else the first; short texts are English; several are mixed."""
    n = F.col("doc_id")
    weights = {"en": n * 7 % 11 + 1, "de": n * 10 % 12 + 1, "fr": n * 13 % 13 + 1, "xx": n * 3 % 14 + 1, "bn": n % 3 * 20 + 1}
    total = sum(weights.values(), F.lit(0))
    shares = t.documents.select(n.alias("document_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("lang"), (w.cast("double") / total).alias("p")) for k, w in weights.items()])).alias("x"))
    found = pages.detected_languages(t.documents.select(n.alias("document_id"), "text"), shares.select("document_id", "x.lang", "x.p"))
    return found.select("document_id", F.array_join("languages", ",").alias("languages"), "mode")
