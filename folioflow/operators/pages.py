"""Pages of recognised documents: substitution of tables and figures, assembly, confidence, language.

Substitution explodes a page's links to rows and joins them to the page's tables or figures by key; the rare link
without an equal key is matched by prefix within its page. Assembly gathers a document's pages, which are bounded by
the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import files, tables, text
from ..sources.shared import written

#: Rows of a language profile (a gram and a number for each language) up to which it is broadcast.
BROADCAST_GRAMS = 1_000_000
#: Rows of pages and tokens that a task takes, about.
TASK_ROWS = 1_000_000
PAGE = ["document_id", "page_number"]
#: Links that are no images, and image references.
TABLE_LINK = r"(?<!!)\[([^\]]+)\]\(([^)\s]+)\)"
IMAGE_LINK = r"!\[([^\]]*)\]\(([^)\s]+)\)"
RESPONSE = (
    "pages array<struct<index:int,markdown:string,header:string,footer:string,images:array<struct<id:string,image_base64:string>>,tables:array<struct<id:string,content:string>>>>"
)


def from_responses(responses: DataFrame) -> DataFrame:
    """One row a page from `document_id, response` (JSON); pages are numbered from 1, missing parts are empty."""
    page = responses.select("document_id", F.explode(F.from_json("response", RESPONSE)["pages"]).alias("p"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return page.select(
        "document_id", (F.col("p.index") + 1).alias("page_number"), F.coalesce("p.markdown", F.lit("")).alias("markdown"), "p.header", "p.footer",
        none(F.col("p.images"), "array<struct<id:string,image_base64:string>>").alias("images"), none(F.col("p.tables"), "array<struct<id:string,content:string>>").alias("tables"),
    )


def figures(images: DataFrame, base_url: str = "") -> DataFrame:
    """Figure rows of `document_id, page_number, image_id, image_base64`: bytes, name, url, mime, size_kb."""
    place = F.col("place") if "place" in images.columns else F.lit(0)
    usable = images.withColumn("place", place).where("coalesce(image_id, '') <> '' and coalesce(image_base64, '') <> ''")
    raw = F.when(F.col("image_base64").startswith("data:"), F.expr("substring(image_base64, locate(',', image_base64) + 1)")).otherwise(F.col("image_base64"))
    decoded = usable.withColumn("_raw", raw).withColumn("content", F.try_to_binary("_raw", F.lit("base64"))).where("content is not null")
    mime = files.base64_mime(F.col("_raw"))
    key = F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), F.col("page_number").cast("string"), "image_id"), 256)
    name = F.concat(F.lit("ocr_img_"), F.substring(key, 1, 32), F.lit("."), files.extension_of(mime))
    root = f"{base_url.rstrip('/')}/api/v1/ocr/images/"
    return decoded.select(*PAGE, "place", "image_id", name.alias("filename"), F.concat(F.lit(root), name).alias("url"), mime.alias("mime"), F.round(F.length("content") / 1024, 1).alias("size_kb"), "content")


def links(pages: DataFrame, pattern: str) -> DataFrame:
    """A row a link: PAGE, at, whole, label, href."""
    found = pages.select(*PAGE, F.posexplode(F.regexp_extract_all("markdown", F.lit(pattern), F.lit(0))).alias("at", "whole"))
    return found.select(*PAGE, "at", "whole", F.regexp_extract("whole", pattern.replace("(?<!!)", ""), 1).alias("label"), F.regexp_extract("whole", pattern.replace("(?<!!)", ""), 2).alias("href"))


def substituted(pages: DataFrame, pattern: str, found: DataFrame) -> DataFrame:
    """pages with each link replaced by `with` of (PAGE, at, with), where there is one."""
    texts = found.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("at", "with"))).alias("_with"))
    joined = pages.join(texts, PAGE, "left")
    gaps, whole = F.split("markdown", pattern, -1), F.regexp_extract_all("markdown", F.lit(pattern), F.lit(0))
    filled = F.transform(whole, lambda w, i: F.coalesce(F.try_element_at(F.col("_with"), i), w))
    woven = F.array_join(F.flatten(F.zip_with(gaps, filled, lambda g, w: F.array(g, F.coalesce(w, F.lit(""))))), "")
    return joined.withColumn("markdown", F.when(F.col("_with").isNull(), F.col("markdown")).otherwise(woven)).drop("_with")


def other_spelling(c: Column) -> Column:
    """With .md for without, and the other way round."""
    return F.when(c.endswith(".md"), F.regexp_replace(c, r"\.md$", "")).otherwise(F.concat(c, F.lit(".md")))


def in_order(rows: DataFrame) -> DataFrame:
    """PAGE, key, order, with: a key stands where it first occurs, with the value that it has last."""
    return rows.groupBy(*PAGE, "key").agg(F.min("order").alias("order"), F.max_by("with", "order").alias("with"))


def best(matches: DataFrame) -> DataFrame:
    """Of several matches of a link, the one of least rank, then order."""
    return matches.groupBy(*PAGE, "at").agg(F.min_by("with", F.struct("rank", "order")).alias("with"))


def with_tables(pages: DataFrame, table_rows: DataFrame) -> DataFrame:
    """Placeholders such as [tbl-0.md](tbl-0.md) replaced by the repaired table of `PAGE, table_id, content`.

    Tables of a page stand in order of `place`, or of table_id where there is no such column; the last of equal ids holds.
    """
    usable = table_rows.where("coalesce(table_id, '') <> '' and coalesce(content, '') <> ''").withColumn("content", tables.repaired(F.col("content")))
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("place" if "place" in table_rows.columns else "table_id"))
    spelled = F.explode(F.array(F.struct(F.col("table_id").alias("key"), F.lit(0).alias("o")), F.struct(other_spelling(F.col("table_id")).alias("key"), F.lit(1).alias("o"))))
    keys = in_order(usable.withColumn("_n", order).withColumn("k", spelled).select(*PAGE, "k.key", (2 * F.col("_n") + F.col("k.o")).alias("order"), F.col("content").alias("with")))
    found = links(pages, TABLE_LINK)
    tried = F.array(F.col("label"), F.col("href"), other_spelling(F.col("label")), other_spelling(F.col("href")))
    wanted = found.select(*PAGE, "at", F.posexplode(tried).alias("rank", "key"))
    exact = best(wanted.join(keys, [*PAGE, "key"]))
    left = found.join(exact.select(*PAGE, "at"), [*PAGE, "at"], "left_anti")
    either = F.col("key").startswith(F.col("label")) | F.col("label").startswith(F.col("key"))
    prefix = best(left.join(keys, PAGE).where(either).select(*PAGE, "at", F.lit(4).alias("rank"), "order", "with"))
    return substituted(pages, TABLE_LINK, exact.unionByName(prefix))


def with_figures(pages: DataFrame, figure_rows: DataFrame) -> DataFrame:
    """Image references replaced by the figures' URLs; an empty label becomes `image`."""
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("place", "key"))
    keys = in_order(figure_rows.select(*PAGE, "place", F.col("image_id").alias("key"), F.col("url").alias("with")).withColumn("order", order)).withColumnRenamed("with", "url")
    found = links(pages, IMAGE_LINK).withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.lit("image")))
    image = F.concat(F.lit("!["), F.col("label"), F.lit("]("), F.col("url"), F.lit(")"))
    exact = best(found.withColumn("key", F.col("href")).join(keys, [*PAGE, "key"]).select(*PAGE, "at", F.lit(0).alias("rank"), "order", image.alias("with")))
    left = found.join(exact.select(*PAGE, "at"), [*PAGE, "at"], "left_anti")
    either = F.col("key").startswith(F.col("href")) | F.col("href").startswith(F.col("key"))
    prefix = best(left.join(keys, PAGE).where(either).select(*PAGE, "at", F.lit(1).alias("rank"), "order", image.alias("with")))
    return substituted(pages, IMAGE_LINK, exact.unionByName(prefix))


def finished(pages: DataFrame) -> DataFrame:
    """Pages with header and footer attached, confidence and character_count."""
    framed = pages.withColumn("text", text.framed(F.col("header"), F.col("markdown"), F.col("footer")))
    return framed.select(*PAGE, "text", text.page_confidence(F.col("text")).alias("confidence"), F.length("text").alias("character_count"))


def page_pipeline(pages: DataFrame, base_url: str = "") -> DataFrame:
    """The whole chain from from_responses: tables, figures, header and footer, confidence."""
    table_rows = pages.select(*PAGE, F.posexplode("tables").alias("place", "t")).select(*PAGE, "place", F.col("t.id").alias("table_id"), "t.content")
    image_rows = pages.select(*PAGE, F.posexplode("images").alias("place", "i")).select(*PAGE, "place", F.col("i.id").alias("image_id"), "i.image_base64")
    return finished(with_figures(with_tables(pages, table_rows), figures(image_rows, base_url)))


def mean_confidence(digits: int) -> Column:
    """Mean confidence, summed and rounded (half up) as decimals: doubles would leave ties to the order of their sum."""
    return F.round(F.avg(F.col("confidence").cast("decimal(18,6)")), digits).cast("double")


def assembled(pages: DataFrame, separator: str = "\n\n---\n\n", digits: int | None = 2) -> DataFrame:
    """One row a document of `PAGE, text, confidence`: text in page order, mean confidence, pages, character totals."""
    mean = F.coalesce(F.avg("confidence") if digits is None else mean_confidence(digits), F.lit(0.0))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return (
        pages.groupBy("document_id")
        .agg(ordered.alias("_p"), mean.alias("confidence"), F.count("*").alias("total_pages"), F.sum(F.length("text")).cast("long").alias("page_characters"))
        .withColumn("text", F.array_join(F.transform("_p", lambda p: F.coalesce(p["text"], F.lit(""))), separator))
        .select("document_id", "text", "confidence", "total_pages", "page_characters", F.length("text").cast("long").alias("stored_characters"))
    )


def token_confidence(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Mean confidence of tokens above 0, in per cent with two digits; 99.0 for pages without one.

    Pages and tokens are dealt by page to tasks of some TASK_ROWS rows and meet in one aggregate, so a task's memory is
    bounded by that number, whatever the size of the input.
    """
    rows = pages.select(*PAGE, F.lit(True).alias("_page"), F.lit(None).cast("double").alias("_c")).unionByName(tokens.where("confidence > 0").select(*PAGE, F.lit(False).alias("_page"), F.col("confidence").alias("_c")))
    dealt = rows.repartition((pages.count() + tokens.count()) // TASK_ROWS + 1, *PAGE)
    met = dealt.groupBy(*PAGE).agg(F.max("_page").alias("_page"), F.round(F.avg("_c") * 100, 2).alias("_c"))
    return met.where("_page").select(*PAGE, F.coalesce("_c", F.lit(99.0)).alias("confidence"))


def replies(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Output shapes of a document: plain text, and as JSON the pages with a summary (by_page) and the document.

    documents has document_id, languages, mode, engine, separator. Of a document of one page, by_page has one page made
    of the whole text, and the document has no page list.
    """
    p = F.array_sort(F.collect_list(F.struct("page_number", "text", F.round("confidence", 2).alias("confidence"), F.length("text").alias("character_count"))))
    whole = pages.groupBy("document_id").agg(p.alias("_p"), mean_confidence(2).alias("confidence")).join(documents, "document_id")
    several = F.size("_p") > 1
    docs = whole.select("*", F.expr("array_join(transform(_p, x -> x.text), separator)").alias("plain"), F.size("_p").alias("n"), F.format_string("%.2f", "confidence").alias("shown"))
    page = lambda number, confidence, count, words: F.struct(number.alias("page_number"), confidence.alias("confidence"), count.alias("character_count"), words.alias("text"))
    listed = F.when(several, F.transform("_p", lambda x: page(x["page_number"], x["confidence"], x["character_count"], x["text"]))).otherwise(F.array(page(F.lit(1), F.col("confidence"), F.length("plain"), F.col("plain"))))
    total = F.when(several, F.aggregate("_p", F.lit(0), lambda acc, x: acc + x["character_count"])).otherwise(F.length("plain"))
    # The sentences of a summary.
    details = F.when(several, F.concat(F.col("n").cast("string"), F.lit(" pages processed with "), "shown", F.lit("% average confidence"))).otherwise(F.concat(F.lit("1 page processed with "), "shown", F.lit("% confidence")))
    summary = F.struct(F.col("n").alias("total_pages"), F.col("confidence").alias("average_confidence"), total.alias("total_characters"), details.alias("processing_details"))
    document = F.struct(F.col("plain").alias("text"), "confidence", F.col("n").alias("pages"), "languages", "mode", "engine", F.when(several, F.col("_p")).alias("pages_data"))
    return docs.select("document_id", "plain", F.to_json(F.struct(listed.alias("pages_info"), summary.alias("summary"))).alias("by_page"), F.to_json(document).alias("document"))


def language_profiles(labelled: DataFrame, n: int = 3) -> DataFrame:
    """lang, gram, logp, floor: smoothed log shares of character n-grams in labelled `lang, text`; counted by Spark."""
    grams = with_grams(labelled.where("lang is not null").select("lang", "text"), n).groupBy("lang", "gram").agg(F.count("*").alias("c"))
    totals = grams.groupBy("lang").agg(F.sum("c").alias("all"), F.count("*").alias("kinds"))
    return grams.join(F.broadcast(totals), "lang").select("lang", "gram", F.log((F.col("c") + 1) / (F.col("all") + F.col("kinds"))).alias("logp"), (-F.log(F.col("all") + F.col("kinds"))).alias("floor"))


def with_grams(docs: DataFrame, n: int) -> DataFrame:
    """A row a gram in place of text: all runs of n characters of the whole text, in time linear in its length. A shorter text is one gram."""
    low = docs.withColumn("_t", F.lower("text"))
    runs = F.regexp_extract_all("_t", F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1))
    return low.withColumn("gram", F.explode(F.when(F.length("_t") < n, F.array("_t")).otherwise(runs))).drop("_t", "text")


def language_shares(docs: DataFrame, profiles: DataFrame, n: int = 3, sure: int = 30) -> DataFrame:
    """document_id, lang, p of `document_id, text` by the n-grams' summed log shares, as a softmax over languages.

    The profile is one row a gram, with its gain in every language; grams meet it where they are made and are summed
    there, so that only one row a document and task is shuffled. The profile is broadcast if its counted rows are within
    BROADCAST_GRAMS; else a document's grams are counted before they are shuffled to it.
    """
    profiles = written(profiles, "profiles")
    # As many rows as languages.
    floors = profiles.groupBy("lang").agg(F.first("floor").alias("floor")).orderBy("lang").collect()
    own = F.map_from_entries(F.collect_list(F.struct("lang", F.col("logp") - F.col("floor"))))
    gains = F.transform(F.array(*[F.lit(r["lang"]) for r in floors]), lambda lang: F.coalesce(F.try_element_at(F.col("_own"), lang), F.lit(0.0)))
    wide = written(profiles.groupBy("gram").agg(own.alias("_own")).select("gram", gains.alias("_gains")), "gains")
    grams = with_grams(docs.select("document_id", "text"), n).withColumn("_c", F.lit(1))
    if wide.count() <= BROADCAST_GRAMS:
        met = grams.join(F.broadcast(wide), "gram", "left")
    else:
        met = grams.groupBy("document_id", "gram").agg(F.sum("_c").alias("_c")).join(wide, "gram", "left")
    sums = [F.coalesce(F.sum(F.col("_c") * F.col("_gains")[i]), F.lit(0.0)) for i in range(len(floors))]
    summed = met.groupBy("document_id").agg(F.sum("_c").alias("_grams"), F.array(*sums).alias("_sums"))
    scores = F.zip_with("_sums", F.array(*[F.lit(r["floor"]) for r in floors]), lambda gain, floor: (gain / F.col("_grams") + floor) * F.least("_grams", F.lit(sure)))
    shares = summed.withColumn("_s", scores).withColumn("_e", F.transform("_s", lambda x: F.exp(x - F.array_max("_s")))).withColumn("_all", F.aggregate("_e", F.lit(0.0), lambda acc, x: acc + x))
    each = F.explode(F.zip_with("_e", F.array(*[F.lit(r["lang"]) for r in floors]), lambda e, lang: F.struct(lang.alias("lang"), (e / F.col("_all")).alias("p"))))
    return shares.select("document_id", each.alias("x")).select("document_id", "x.lang", "x.p")


def detected_languages(docs: DataFrame, shares: DataFrame, least: float = 0.2) -> DataFrame:
    """document_id, languages (by falling p), mode; texts under ten characters are English."""
    ranked = shares.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("p"), "lang")))
    chosen = ranked.where((F.col("p") >= least) | (F.col("_n") == 1))
    lists = chosen.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "lang"))), lambda x: x["lang"]).alias("_langs"))
    joined = docs.select("document_id", "text").join(lists, "document_id", "left")
    short = (F.length(F.trim(F.coalesce("text", F.lit("")))) < 10) | F.col("_langs").isNull()
    found = joined.withColumn("languages", F.when(short, F.array(F.lit("en"))).otherwise(F.col("_langs")))
    return found.select("document_id", "languages", text.language_mode(F.col("languages")).alias("mode"))
