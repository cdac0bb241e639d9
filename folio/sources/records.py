"""Records around the pages: metadata XML, page lists, library objects, block documents, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.functions import text as T

_TEXT = "struct<_VALUE:string,_type:string>"
MODS_DDL = (
    "titleInfo array<struct<title:string,subTitle:string,partNumber:string,partName:string>>,"
    f"name array<struct<namePart:array<{_TEXT}>,role:array<struct<roleTerm:array<{_TEXT}>>>>>,"
    f"originInfo array<struct<publisher:string,place:array<struct<placeTerm:array<{_TEXT}>>>,dateIssued:array<{_TEXT}>,edition:string>>,"
    f"language array<struct<languageTerm:array<{_TEXT}>>>,"
    "physicalDescription array<struct<extent:array<string>>>,"
    f"identifier array<{_TEXT}>,note array<{_TEXT}>,"
    "subject array<struct<topic:array<string>,geographic:array<string>,temporal:array<string>,genre:array<string>>>,"
    "part array<struct<detail:array<struct<_type:string,number:string>>>>"
)


def _filled(c: Column) -> Column:
    """Array without NULL and blank texts, trimmed."""
    return F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))


def _values(c: Column) -> Column:
    return _filled(F.transform(c, lambda x: x["_VALUE"]))


def _list(c: Column, glue: str) -> Column:
    """Ordered distinct texts joined; NULL when there are none."""
    return F.when(F.size(c) > 0, F.array_join(F.array_distinct(c), glue))


def ordered_distinct_list(values: Column, glue: str) -> Column:
    """Array of texts to one text: blanks dropped, first of equals kept, in order."""
    return _list(_filled(values), glue)


def mods_entries(records: DataFrame) -> DataFrame:
    """Label / value rows of bibliographic metadata, in order. Input: pid, xml."""
    m = F.col("m")
    empty = F.expr("cast(array() as array<struct<label:string,value:string>>)")
    entry = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))

    def title(t: Column) -> Column:
        part = F.array_join(_filled(F.array(t["partNumber"], t["partName"])), " ")
        return F.array_join(_filled(F.array(t["title"], t["subTitle"], part)), " - ")

    def author(n: Column) -> Column:
        names = _values(F.filter(n["namePart"], lambda p: F.coalesce(p["_type"] != "date", F.lit(True))))
        dates = _values(F.filter(n["namePart"], lambda p: F.coalesce(p["_type"] == "date", F.lit(False))))
        roles = F.array_distinct(_values(F.flatten(F.transform(n["role"], lambda r: r["roleTerm"]))))
        return F.when(
            F.size(names) > 0,
            F.concat(
                F.array_join(names, " "),
                F.when(F.size(dates) > 0, F.concat(F.lit(" ("), F.array_join(dates, ", "), F.lit(")"))).otherwise(""),
                F.when(F.size(roles) > 0, F.concat(F.lit(" ["), F.array_join(roles, ", "), F.lit("]"))).otherwise(""),
            ),
        )

    def origin(o: Column) -> Column:
        place = F.get(_values(F.flatten(F.transform(o["place"], lambda p: p["placeTerm"]))), F.lit(0))
        issued = F.get(F.transform(o["dateIssued"], lambda d: d["_VALUE"]), F.lit(0))
        facts = _filled(F.array(place, o["publisher"], issued))
        return F.array(
            entry("Edice", o["edition"]), entry("Publikační údaje", F.when(F.size(facts) > 0, F.array_join(facts, ", ")))
        )

    def typed(i: Column) -> Column:
        v = F.trim(i["_VALUE"])
        return F.when(v != "", F.when(i["_type"] != "", F.concat(i["_type"], F.lit(": "), v)).otherwise(v))

    notes = _values(m["note"])
    side = F.get(F.filter(notes, lambda x: F.lower(x).isin("left", "right")), F.lit(0))
    subjects = F.transform(m["subject"], lambda s: F.array_join(_filled(F.flatten(F.filter(
        F.array(s["topic"], s["geographic"], s["temporal"], s["genre"]), lambda a: a.isNotNull()))), " - "))
    details = F.flatten(F.transform(m["part"], lambda p: p["detail"]))
    page_facts = F.transform(
        F.filter(details, lambda d: F.lower(F.trim(d["_type"])).isin("pagenumber", "pageindex")),
        lambda d: F.struct(
            F.when(F.lower(F.trim(d["_type"])) == "pagenumber", "PageNumber").otherwise("PageIndex").alias("label"),
            d["number"].alias("value")),
    )
    rows = F.concat(
        F.array(
            entry("Název", _list(_filled(F.transform(m["titleInfo"], title)), "; ")),
            entry("Autoři", _list(_filled(F.transform(m["name"], author)), "; ")),
        ),
        F.coalesce(F.flatten(F.transform(m["originInfo"], origin)), empty),
        F.array(
            entry("Jazyk", _list(_values(F.flatten(F.transform(m["language"], lambda x: x["languageTerm"]))), ", ")),
            entry("Rozsah", _list(_filled(F.flatten(F.transform(m["physicalDescription"], lambda x: x["extent"]))), "; ")),
            entry("Identifikátory", _list(_filled(F.transform(m["identifier"], typed)), "; ")),
            entry("PageSide", side),
            entry("Poznámky", _list(notes, " | ")),
            entry("Témata", _list(_filled(subjects), "; ")),
        ),
        F.coalesce(page_facts, empty),
    )
    clean = F.filter(
        F.transform(rows, lambda e: F.struct(e["label"].alias("label"), T.clean_text(e["value"]).alias("value"))),
        lambda e: F.coalesce(e["value"] != "", F.lit(False)),
    )
    parsed = F.from_xml("xml", MODS_DDL, {"ignoreNamespace": "true", "attributePrefix": "_"})
    return records.select("pid", parsed.alias("m")).select("pid", F.posexplode_outer(clean).alias("ord", "e")).filter("ord IS NOT NULL").select(
        "pid", F.col("ord").cast("bigint").alias("ord"), "e.label", "e.value"
    )


def authors(mods: DataFrame) -> DataFrame:
    """Author names of each record: split at semicolons, trimmed, first of equals kept."""
    hit = mods.filter(F.lower(F.trim("label")).isin("autoři", "autori", "authors"))
    per_pid = hit.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("v"))
    names = F.array_distinct(_filled(F.flatten(F.transform("v", lambda x: F.split(x["value"], ";")))))
    return per_pid.select("pid", F.posexplode(names).alias("ord", "author")).select(
        "pid", F.col("ord").cast("bigint").alias("ord"), "author"
    )


_SERVICE = "struct<`@id`:string,id:string>"
MANIFEST_DDL = (
    "struct<items:array<struct<id:string,label:string,thumbnail:array<struct<id:string>>,seeAlso:array<struct<id:string>>,"
    f"items:array<struct<items:array<struct<body:struct<id:string,service:array<{_SERVICE}>>>>>>>>>"
)


def label_text(c: Column) -> Column:
    """Text of a label given as JSON or plain text: first value of none, cs, en, or of a list."""
    first = lambda path: F.when(F.trim(F.get_json_object(c, path)) != "", F.trim(F.get_json_object(c, path)))
    return F.when(
        F.trim(c).startswith("{"), F.coalesce(first("$.none[0]"), first("$.cs[0]"), first("$.en[0]"), F.lit(""))
    ).when(F.trim(c).startswith("["), F.coalesce(F.trim(F.get_json_object(c, "$[0]")), F.lit(""))).otherwise(F.coalesce(F.trim(c), F.lit("")))


def manifest_pages(manifests: DataFrame) -> DataFrame:
    """Pages of presentation manifests. Input: book_id, json.

    The page id is the last ``uuid:`` of the first place that has one; canvases without one, and those
    of the book itself, are dropped; the index is the place of the canvas.
    """
    def uuid(c: Column) -> Column:
        hits = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("uuid:([0-9a-fA-F-]+)"), F.lit(1))
        return F.when(F.size(hits) > 0, F.element_at(hits, -1))

    c = F.col("c")
    zero = F.lit(0)
    body = F.get(F.get(c["items"], zero)["items"], zero)["body"]
    service = F.get(body["service"], zero)
    page = F.coalesce(
        uuid(F.get(c["thumbnail"], zero)["id"]), uuid(F.get(c["seeAlso"], zero)["id"]),
        uuid(F.coalesce(F.when(service["@id"] != "", service["@id"]), service["id"])), uuid(body["id"]), uuid(c["id"]),
    )
    label = F.trim(F.substring_index(label_text(c["label"]), "(", 1))
    return (
        manifests.select("book_id", F.posexplode_outer(F.from_json("json", MANIFEST_DDL)["items"]).alias("page_index", "c"))
        .filter("page_index IS NOT NULL")
        .withColumn("page_uuid", F.lower(page))
        .filter(F.col("page_uuid").isNotNull() & (F.col("page_uuid") != F.lower(T.strip_uuid("book_id"))))
        .select("book_id", "page_uuid", F.col("page_index").cast("bigint").alias("page_index"), label.alias("title"), label.alias("page_number"))
    )


_CHILD = "struct<pid:string,model:string,type:string>"
OBJECT_DDL = (
    "struct<pid:string,model:string,title:string,root_pid:string,policy:string,details:map<string,string>,"
    "context:array<array<struct<pid:string,model:string>>>,"
    "parents:struct<own:struct<pid:string,model:string,relation:string>>,"
    f"children:struct<own:array<{_CHILD}>,foster:array<{_CHILD}>>>"
)


def objects(records: DataFrame) -> DataFrame:
    """Library objects merged from their info and structure JSON. Input: pid, info, structure.

    Own children come before foster ones; a child without a model is a page.
    """
    i, s = F.col("i"), F.col("s")
    both = lambda f: F.coalesce(i[f], s[f])
    parent = F.coalesce(i["parents"], s["parents"])["own"]
    none = F.expr(f"cast(array() as array<{_CHILD}>)")
    kids = F.coalesce(i["children"], s["children"])
    context = F.when(F.size(i["context"]) > 0, i["context"]).when(
        parent["pid"].isNotNull(),
        F.array(F.array(F.struct(parent["pid"].alias("pid"), F.coalesce(parent["model"], parent["relation"], F.lit("")).alias("model")))),
    )
    return records.select(
        "pid", F.from_json("info", OBJECT_DDL).alias("i"), F.from_json("structure", OBJECT_DDL).alias("s")
    ).select(
        F.coalesce(i["pid"], s["pid"], F.col("pid")).alias("pid"),
        both("model").alias("model"),
        i["title"].alias("title"),
        F.coalesce(F.when(i["root_pid"] != "", i["root_pid"]), parent["pid"]).alias("root_pid"),
        parent["pid"].alias("parent_pid"),
        context.alias("context"),
        i["details"].alias("details"),
        F.transform(
            F.concat(F.coalesce(kids["own"], none), F.coalesce(kids["foster"], none)),
            lambda c: F.struct(c["pid"].alias("pid"), F.coalesce(c["model"], c["type"], F.lit("page")).alias("model")),
        ).alias("children"),
    )


def object_children(objs: DataFrame) -> DataFrame:
    return objs.select(F.col("pid").alias("parent_pid"), F.posexplode("children").alias("ord", "c")).select(
        "parent_pid", F.col("ord").cast("bigint").alias("ord"), F.col("c.pid").alias("pid"), F.col("c.model").alias("model")
    )


def block_docs(docs: DataFrame) -> DataFrame:
    """Blocks of documents given as JSON text, fenced or with raw line breaks inside strings. Input: page_id, json."""
    shape = "struct<language_hint:string,blocks:array<struct<id:string,type:string,text:string>>>"
    bare = M.strip_fences(F.col("json"))
    first = F.from_json("bare", shape)["blocks"]
    again = F.from_json(M.json_repair(F.col("bare")), shape)["blocks"]
    return docs.select("page_id", bare.alias("bare")).select(
        "page_id", F.posexplode_outer(F.coalesce(first, again)).alias("ord", "b")
    ).filter("ord IS NOT NULL").select("page_id", F.col("b.id").alias("block_id"), F.col("ord").cast("bigint").alias("ord"), "b.type", "b.text")


_VALUES = "struct<temperature:double,top_p:double,reasoning_effort:string,max_output_tokens:bigint>"
AGENT_DDL = (
    "struct<name:string,display_name:string,prompt:string,model:string,temperature:double,top_p:double,reasoning_effort:string,"
    f"max_output_tokens:bigint,settings:struct<defaults:{_VALUES},per_model:map<string,{_VALUES}>>,updated_at:double>"
)


def settings_files(spark: SparkSession, path: str) -> DataFrame:
    """Agent files of a folder, one JSON each: file name and text."""
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_extract(F.col("path"), r"([^/]+?)(?:\.json)?$", 1).alias("name"), F.decode("content", "UTF-8").alias("json")
    )


def settings(files: DataFrame) -> DataFrame:
    """Agents of a settings folder; an unreadable file keeps only its name."""
    a = F.col("a")
    return files.select("name", F.from_json("json", AGENT_DDL).alias("a")).select(
        "name",
        F.coalesce(F.when(a["display_name"] != "", a["display_name"]), F.col("name")).alias("display_name"),
        a["prompt"].alias("prompt"), a["model"].alias("model"), a["temperature"].alias("temperature"), a["top_p"].alias("top_p"),
        a["reasoning_effort"].alias("reasoning_effort"), a["max_output_tokens"].alias("max_output_tokens"),
        a["settings"]["defaults"].alias("defaults"), a["settings"]["per_model"].alias("per_model"),
        a["updated_at"].alias("updated_at"),
    )
