"""PDF pages as structured text: the contract by which any reader's JSON becomes pages.

No PDF library is at hand here; a reader that writes this JSON (one object a page) can be plugged in before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import iso_date

BOUNDS = "struct<x:double,y:double,width:double,height:double>"
LINE = "struct<text:string,x:double,y:double,bbox:struct<x:double,y:double,w:double,h:double>,font:struct<name:string,size:double>>"
PAGE = (
    f"doc_id bigint, page_number int, width double, height double, blocks array<struct<type:string,lines:array<{LINE}>>>, "
    f"form_fields array<struct<name:string,label:string,value:string,field_type:string,flags:int,options:array<string>,max_length:int,bounds:{BOUNDS}>>, "
    "metadata map<string,string>, annotations int, widgets int"
)
# Metadata keys and what they are called.
KEYS = {"info:Title": "title", "info:Author": "author", "info:Subject": "subject", "info:Keywords": "keywords", "info:Creator": "creator", "info:Producer": "producer", "info:CreationDate": "creationDate", "info:ModDate": "modificationDate"}


#: What a reader may add to a page: the document's layers as found, before any is shown, and the page's images (base64; bbox: left, top, right, bottom).
MORE = "layers array<struct<name:string,visible:boolean>>, images array<struct<data:string,width:int,height:int,bbox:array<double>>>"
CORRUPT = "corrupt_record"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Pages from JSON lines, `PAGE` and `MORE`; a line that isn't a page, or not wholly one, is kept in `corrupt_record`."""
    return spark.read.schema(f"{PAGE}, {MORE}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def refused(pages: DataFrame) -> Column:
    """Why a page can't be used; null: it can."""
    return (
        F.when(F.col(CORRUPT).isNotNull() & F.col("doc_id").isNull() & F.col("blocks").isNull(), "not a page")
        .when(F.col(CORRUPT).isNotNull(), "a field of another type")
        .when(F.col("doc_id").isNull() | F.col("page_number").isNull(), "no document or page number")
        .when(~(F.coalesce(F.col("width"), F.lit(0.0)) > 0) | ~(F.coalesce(F.col("height"), F.lit(0.0)) > 0), "no size")
    )


def sound(pages: DataFrame) -> DataFrame:
    return pages.where(refused(pages).isNull()).drop(CORRUPT)


def quarantined(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, reason, corrupt_record) of the pages that can't be used."""
    return pages.select("doc_id", "page_number", refused(pages).alias("reason"), CORRUPT).where("reason IS NOT NULL")


def images(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, image, filename, mime, data, width, height, bbox) of the pages' images, numbered from 1 on each page; those whose data can't be read are left out, and don't count."""
    readable = F.filter(F.transform(F.coalesce("images", F.array().cast(pages.schema["images"].dataType)), lambda i: i.withField("data", F.try_to_binary(i["data"], F.lit("base64")))), lambda i: i["data"].isNotNull() & (F.length(i["data"]) > 0))
    rows = pages.select("doc_id", "page_number", F.posexplode(readable).alias("at", "i"))
    b = F.col("i.bbox")
    box = F.struct(F.get(b, F.lit(0)).alias("x"), F.get(b, F.lit(1)).alias("y"), (F.get(b, F.lit(2)) - F.get(b, F.lit(0))).alias("width"), (F.get(b, F.lit(3)) - F.get(b, F.lit(1))).alias("height"))
    n = F.col("at") + 1
    return rows.select("doc_id", "page_number", n.alias("image"), F.format_string("image-page%d-%d.png", F.col("page_number"), n).alias("filename"), F.lit("image/png").alias("mime"), "i.data", "i.width", "i.height", box.alias("bbox"))


def layer_findings(pages: DataFrame) -> DataFrame:
    """(doc_id, layers, hidden): how many layers a document has, and the names of the invisible ones in order; a layer without a name is called by its number. Layers come with each page, or with the first."""
    rows = pages.select("doc_id", "page_number", F.posexplode("layers").alias("at", "l"))
    each = rows.groupBy("doc_id", "at").agg(F.min_by("l", "page_number").alias("l"))
    name = F.coalesce("l.name", F.concat(F.lit("Layer "), F.col("at").cast("string")))
    hidden = F.array_sort(F.collect_list(F.when(F.col("l.visible") == F.lit(False), F.struct("at", name.alias("name")))))
    return each.groupBy("doc_id").agg(F.count("*").cast("int").alias("layers"), F.transform(hidden, lambda h: h["name"]).alias("hidden"))


def form_fields(fields: Column, page_height: Column) -> Column:
    """Fields with y from the bottom of the page, and required from the second flag bit."""
    return F.transform(fields, lambda f: F.struct(
        f["name"].alias("name"), f["label"].alias("label"), f["value"].alias("value"), f["field_type"].alias("field_type"), (F.coalesce(f["flags"], F.lit(0)).bitwiseAND(2) != 0).alias("is_required"),
        (F.coalesce(f["flags"], F.lit(0)).bitwiseAND(1) != 0).alias("is_read_only"), f["options"].alias("options"), f["max_length"].alias("max_length"),
        F.struct(f["bounds"]["x"].alias("x"), (page_height - f["bounds"]["y"] - f["bounds"]["height"]).alias("y"), f["bounds"]["width"].alias("width"), f["bounds"]["height"].alias("height")).alias("bounds")))


def metadata(values: Column) -> Column:
    """Known keys under their short names, trimmed, blank ones left out; dates in ISO form where they can be read."""
    said = lambda k: F.trim(F.coalesce(F.try_element_at(values, F.lit(k)), F.lit("")))
    made = F.create_map(*(x for k, name in KEYS.items() for x in (F.lit(name), F.coalesce(iso_date(said(k)), said(k)) if k.endswith("Date") else said(k))))
    return F.map_filter(made, lambda _, v: v != "")


def page_statistics(pages: DataFrame) -> DataFrame:
    """Totals of annotations and widgets of each document, and the pages that have them."""
    on = lambda c: F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.col("page_number"))))
    return pages.groupBy("doc_id").agg(F.coalesce(F.sum("annotations"), F.lit(0)).alias("annotations"), on("annotations").alias("annotation_pages"), F.coalesce(F.sum("widgets"), F.lit(0)).alias("widgets"), on("widgets").alias("widget_pages"))
