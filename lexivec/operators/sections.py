"""Documents to nested records, each within its own row: a select over key-value pairs and the lists that tables give.

A converter's JSON, where there is one, wins over what the text gives, key by key: a key that is present wins even if
its value is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexivec.functions.text import base_type, clean_text, process_kind, to_float, to_int, yesno
from lexivec.operators import tables


def present_first(json: Column, path: str, fallback: Column) -> Column:
    """The value at a path of a JSON text if its key is there, null included, else the fallback."""
    parent, _, name = path.rpartition(".")
    holder = F.get_json_object(json, f"$.{parent}") if parent else json
    found = F.get_json_object(json, f"$.{path}")
    return F.when(F.coalesce(F.array_contains(F.json_object_keys(holder), name), F.lit(False)), found.cast("string")).otherwise(fallback.cast("string"))


def find_from(text: Column, pattern: str, start: Column) -> Column:
    """Place (from 1) of the first match at or after start, null without one."""
    at = F.regexp_instr(F.substr(text, start), F.lit(pattern))
    return F.when(at > 0, at + start - 1)


def end_of_text(x: str) -> int:
    """Where a text ends without what boundaries leave behind: white space, heading marks, two dashes or more, and a
    word of at most 60 characters before a slash. One index walks back from the end."""
    at = len(x)
    while at:
        last = x[at - 1]
        if last.isspace():
            back = at - 1
        elif last == "#":
            back = len(x[:at].rstrip("#"))
        elif last == "-" and at > 1 and x[at - 2] == "-":
            back = len(x[:at].rstrip("-"))
        elif last == "/" and at > 1 and not x[at - 2].isspace():
            word = at - 1
            while word > at - 61 and word and not x[word - 1].isspace():
                word -= 1
            back = word
        else:
            break
        at = back
    return at


@F.pandas_udf(StringType())
def trimmed(texts):  # noqa: ANN001, ANN201
    """Texts up to end_of_text, without white space at their beginning."""
    return texts.map(lambda x: None if x is None else x[: end_of_text(x)].strip())


#: Where the parts of the terms begin.
HEADING = r"(?i)buyer added bid specific terms and conditions"
DISCLAIMER = r"(?i)disclaimer"
BOILERPLATE = r"(?i)(?:the\s+additional\s+)?terms and conditions(?:\s*\(atc\))?\s+have been incorporated by the buyer after approval"
THANKS = r"(?i)thank you"


def terms(docs: DataFrame, md: str = "md") -> DataFrame:
    """The documents with generic and disclaimer: slices between the places of the marks."""
    one, text, tail = F.lit(1), F.coalesce(F.col(md), F.lit("")), F.col("_tail")
    # A long text is gone through once; all other marks are sought in what begins with the heading.
    out = docs.withColumn("_from", F.regexp_extract(text, f"(?s){HEADING}.*", 0))
    out = out.withColumn("_tail", F.coalesce(F.nullif("_from", F.lit("")), text))
    out = out.withColumn("_label", find_from(tail, DISCLAIMER, one))
    out = out.withColumn("_section", F.coalesce("_label", find_from(tail, BOILERPLATE, one)))
    out = out.withColumn("_content", F.when(F.col("_label").isNotNull(), F.col("_label") + F.lit(len("disclaimer"))).otherwise(F.col("_section")))
    out = out.withColumn("_end", F.coalesce(find_from(tail, THANKS, F.coalesce("_content", one)), F.length(tail) + 1))
    cut = lambda a, b: trimmed(clean_text(F.substr(tail, a, F.greatest(b - a, F.lit(0)))))
    out = out.withColumn("generic", F.when(F.col("_from") != "", cut(one, F.coalesce("_section", "_end"))).otherwise(F.lit("")))
    out = out.withColumn("disclaimer", F.when(F.col("_content").isNotNull(), cut(F.col("_content"), F.col("_end"))).otherwise(F.lit("")))
    return out.drop("_from", "_tail", "_label", "_section", "_content", "_end")


def emd_total(pairs: Column) -> Column:
    """Sum of all deposit amounts among the pairs, the last one of each key; null for none."""
    mine = tables.key_values(F.filter(pairs, lambda e: F.contains(e["low"], F.lit("emd amount")) | F.contains(e["low"], F.lit("ईएमडी राशि"))))
    return F.nullif(F.aggregate(mine, F.lit(0).cast("long"), lambda s, e: s + F.coalesce(to_int(e["value"]), F.lit(0).cast("long"))), F.lit(0))


def split_clean(raw: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), pattern), lambda x: clean_text(x)), lambda x: x != "")


def items(names: Column, total: Column, quantities: Column) -> Column:
    """struct<total_quantity_extracted, quantity_match_flag, items>: one name takes the total, several the tables'
    quantities by place if they are as many."""
    return tables.let(names, lambda n: _items(n, total, quantities))


def _items(names: Column, total: Column, quantities: Column) -> Column:
    same = F.size(names) == F.size(quantities)
    listed = F.transform(names, lambda x, i: F.struct((i + 1).alias("n"), x.alias("item_category"), F.when(F.size(names) == 1, total).when(same, F.get(quantities, i)).alias("quantity")))
    extracted = F.aggregate(listed, F.lit(0).cast("long"), lambda s, e: s + F.coalesce(e["quantity"], F.lit(0).cast("long")))
    flag = F.when((F.coalesce(total, F.lit(0)) != 0) & (extracted > 0) & (extracted == total), "Yes").otherwise("No")
    return F.struct(total.alias("total_quantity_extracted"), flag.alias("quantity_match_flag"), listed.alias("items"))


def field(json: Column, *names: str) -> Column:
    """The value of the first of the names that a JSON object has; '' without one."""
    return F.coalesce(*[F.get_json_object(json, f"$['{n}']") for n in names], F.lit(""))


def objects(json: Column, path: str) -> Column:
    """Key and value (JSON text) of the objects in a JSON object, in order; empty without one."""
    found = F.from_json(F.get_json_object(json, path), "map<string,string>")
    entries = F.filter(F.map_entries(found), lambda e: F.coalesce(e["value"].startswith("{"), F.lit(False)))
    return F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>"))


def schedule(group: Column, key: Column, value: Column) -> Column:
    """An entry of a schedule. Some converters break words of the labels."""
    return F.struct(
        group.alias("group_key"), key.alias("item_key"), field(value, "Item/Ca tegory", "Item/Category").alias("item_category"), field(value, "Consignee/Repor ting Officer", "Consignee/Reporting Officer").alias("officer"),
        field(value, "Consignee Address").alias("address"), field(value, "Qua ntity", "Quantity").alias("quantity"), field(value, "Estimated Value").alias("estimated_value"),
    )


def given_items(json: Column, total: Column) -> Column:
    """The items section as the converter gives it."""
    mine = F.filter(objects(json, "$.items"), lambda e: e["key"].rlike(r"(?i)^item \d+$"))
    listed = F.transform(mine, lambda e: F.struct(F.regexp_extract(e["key"], r"\d+", 0).cast("int").alias("n"), field(e["value"], "item_category").alias("item_category"), F.get_json_object(e["value"], "$.quantity").try_cast("long").alias("quantity")))
    extracted = F.aggregate(listed, F.lit(0).cast("long"), lambda a, e: a + F.coalesce(e["quantity"], F.lit(0).cast("long")))
    flag = F.when((F.coalesce(total, F.lit(0)) != 0) & (extracted > 0), F.when(extracted == total, "Yes").otherwise("No")).otherwise(F.coalesce(F.get_json_object(json, "$.items.quantity_match_flag"), F.lit("No")))
    return F.struct(total.alias("total_quantity_extracted"), flag.alias("quantity_match_flag"), listed.alias("items"))


def given_list(json: Column, path: str, kind: str = "string") -> Column:
    return F.from_json(F.get_json_object(json, path), f"array<{kind}>")


def parse_documents(docs: DataFrame, key: str = "doc", md: str = "md", product_type: str = "product_type", converter_json: str | None = None, strip_br: bool = True) -> DataFrame:
    """key and pdf (nested struct) of every document. converter_json: a column with the converter's JSON.

    Nothing is shuffled, and the key only passes through: documents whose keys are null or equal have each what is
    theirs. A null text is an empty one: no pairs, empty lists, flags 'No'."""
    # Labels in quotes below are fixed values: the names that documents and converters use, in English and Hindi.
    given_json = F.col(converter_json) if converter_json else F.lit(None).cast("string")
    base = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(md), F.lit("")).alias("md"), F.col(product_type).alias("product_type"), F.coalesce(F.get_json_object(given_json, "$.pdf"), given_json).alias("js"))
    found = F.col("tables")
    entry = "struct<group_key:string,item_key:string,item_category:string,officer:string,address:string,quantity:string,estimated_value:string>"
    person = "struct<consignee_reporting_officer:string,consignee_address:string,quantity:string,delivery_days:string>"
    blank = F.lit("")
    by_group = F.transform(F.array_sort(tables.group_schedules(found)), lambda x: F.struct(x["group_key"].alias("group_key"), F.concat(F.lit("Item_"), x["item_no"].cast("string")).alias("item_key"), x["item_category"].alias("item_category"), x["officer"].alias("officer"), x["address"].alias("address"), x["quantity"].alias("quantity"), blank.alias("estimated_value")))
    by_item = F.transform(tables.item_schedules(found), lambda x: F.struct(blank.alias("group_key"), x["key"].alias("item_key"), x["item_category"].alias("item_category"), blank.alias("officer"), blank.alias("address"), x["quantity"].alias("quantity"), x["estimated_value"].alias("estimated_value")))
    base = tables.with_tables(terms(base), "md", strip_br).withColumns({
        "kv": tables.pairs(found), "sums": F.transform(tables.table_quantities(found), lambda x: x["quantity"]), "by_group": by_group, "by_item": by_item,
        "people": tables.consignees(found).cast(f"array<{person}>"),
    })
    asked: dict[tuple[str, ...], str] = {}

    def get(*patterns: str) -> Column:
        """A field of the column that holds each value once, however often expressions below name it."""
        return F.col("got")[asked.setdefault(patterns, f"v{len(asked)}")]

    js = F.col("js")
    text = lambda path, *p: present_first(js, path, get(*p))
    number = lambda path, *p: present_first(js, path, to_int(get(*p))).try_cast("long")
    flag = lambda path, *p: yesno(present_first(js, path, F.coalesce(get(*p), F.lit("No"))))
    maybe = lambda path, *p: present_first(js, path, yesno(get(*p)))
    method = F.coalesce(text("evaluation.evaluation_method", "Evaluation Method", "मूल्यांकन पढ़ति", "मूल्यांकन विधि"), blank)
    total = number("items.total_quantity_extracted", "Total Quantity", "कुल मात्रा")
    emd_bank = F.coalesce(text("financials.emd.advisory_bank", "Advisory Bank", "एडवाईजरी बैंक"), blank)
    epbg_bank = F.coalesce(text("financials.epbg.advisory_bank", "Advisory Bank", "एडवाइजरी बैंक"), blank)
    amount = present_first(js, "financials.emd.amount_total", F.col("got")["emd"]).try_cast("long")
    auction = flag("ra.bid_to_ra_enabled", "Bid to RA enabled", "बिड से रिवर्स नीलामी")
    low = F.lower("method")
    nothing = F.array().cast(f"array<{entry}>")
    given = objects(js, "$.evaluation.schedules")
    given_by_item = F.transform(given, lambda e: schedule(blank, e["key"], e["value"]))
    given_by_group = F.flatten(F.transform(given, lambda g: F.transform(objects(g["value"], "$"), lambda e: schedule(tables.group_key(g["key"]), e["key"], e["value"]))))
    either = lambda a, b: F.when(F.size(a) > 0, a).otherwise(F.coalesce(b, nothing))
    schedules = F.when(F.contains(low, F.lit("total")), nothing).when(F.contains(low, F.lit("item")), either(given_by_item, F.col("by_item"))).when(F.contains(low, F.lit("group")), either(given_by_group, F.col("by_group"))).otherwise(given_by_item)
    from_json = F.when(js.isNotNull(), given_items(js, total))
    from_text = items(split_clean(get("Item Category", "वस्तु श्रेणी"), ","), total, F.col("sums"))
    some_people = given_list(js, "$.consignees", person)
    required = split_clean(get("Document required from seller", "विक्रेता से मांगे गए", "विकेता से"), r",\s*(?=[A-Z*])")
    exempt = F.coalesce(F.nullif(get("EMD EXEMPTION", "emd exemption", "ईएमडी छूट"), blank), clean_text(F.regexp_extract("md", r"(?is)EMD EXEMPTION[:\s]*(.*?)(?:\n\n|\(b\)|\(c\)|\z)", 1)))
    local = get("Allow participation only from Class", "सार्वजनिक खरीद", "सार्यजनिक खरीद")
    documents_shown = F.when(F.contains(F.lower(F.coalesce(text("documents.show_uploaded_docs_to_all_bidders", "Do you want to show documents", "क्या आप निविदाकारों"), F.lit("No"))), F.lit("yes")), "Yes").otherwise("No")
    empty = F.array().cast("array<string>")
    pdf = {
        "process_kind": process_kind(F.col("md")),
        "base_type": base_type(F.col("md"), F.col("product_type")),
        "timing": F.struct(get("Bid End Date/Time", "bid end date", "बिड बंद होने").alias("bid_end_datetime"), get("Bid Opening Date/Time", "bid opening date", "बिड खुलने").alias("bid_opening_datetime"), to_int(get("Bid Offer Validity", "बिड पेशकश वैधता")).alias("bid_offer_validity_days")),
        "departments": F.struct(
            text("departments.ministry_state_name", "Ministry", "मंत्रालय").alias("ministry_state_name"), text("departments.department_name", "Department Name", "विभाग का नाम").alias("department_name"),
            text("departments.organisation_name", "Organisation Name", "संगठन का नाम").alias("organisation_name"), text("departments.office_name", "Office Name", "कार्यालय का नाम").alias("office_name"),
        ),
        "items": F.col("found_items"),
        "evaluation": F.struct(F.col("method").alias("evaluation_method"), schedules.alias("schedules")),
        "documents": F.struct(F.coalesce(given_list(js, "$.documents.required_from_seller"), required).alias("required_from_seller"), documents_shown.alias("show_uploaded_docs_to_all_bidders"), F.coalesce(given_list(js, "$.documents.attachments"), empty).alias("attachments")),
        "consignees": F.coalesce(F.when(F.size(some_people) > 0, some_people), "people"),
        "relaxations": F.struct(flag("relaxations.mse_relaxation_experience_turnover", "MSE Relaxation", "एमाएसएमई के लिए अनुभव", "एमएसएमई के लिए अनुभव").alias("mse_relaxation_experience_turnover"), flag("relaxations.startup_relaxation_experience_turnover", "Startup Relaxation", "स्टार्टअप के लिए अनुभव").alias("startup_relaxation_experience_turnover")),
        "auto_extension": F.struct(
            number("auto_extension.min_bids_to_disable_extension", "Minimum number of bids", "बिड लगाने की समय सीमा स्वतः").alias("min_bids_to_disable_extension"),
            number("auto_extension.auto_extend_days", "Number of days for which Bid", "दिनों की संख्या").alias("auto_extend_days"),
            number("auto_extension.auto_extension_count", "Number of Auto Extension", "ऑटो एक्सर्टेशन", "ऑटो एक्सटैशन").alias("auto_extension_count"),
        ),
        "ra": F.struct(auction.alias("bid_to_ra_enabled"), F.when(auction == "Yes", text("ra.ra_qualification_rule", "RA Qualification Rule", "रिवर्स नीलामी योग्यता")).alias("ra_qualification_rule")),
        "bid_type": F.struct(F.coalesce(text("bid_type.type_of_bid", "Type of Bid", "बिड का प्रकार"), blank).alias("type_of_bid"), number("bid_type.technical_clarification_window_days", "Time allowed for Technical Clarification", "तकनीकी मूल्यांकन के दौरान").alias("technical_clarification_window_days")),
        "inspection": F.struct(flag("inspection.inspection_required", "Inspection Required", "निरीक्षण आवश्यक").alias("inspection_required"), F.get_json_object(js, "$.inspection.inspection_agency_type").alias("inspection_agency_type")),
        "clauses": F.struct(flag("clauses.arbitration_clause", "Arbitration Clause", "मध्यस्थता खंड").alias("arbitration_clause"), flag("clauses.mediation_clause", "Mediation Clause", "सुलह खंड").alias("mediation_clause")),
        "mii": F.struct(
            maybe("mii.mii_purchase_preference", "MII Purchase Preference", "एमआईआई खरीद वरीयता").alias("mii_purchase_preference"), number("mii.mii_price_band_percent", "Purchase Preference to MII", "मेक इन इंडिया विक्रेताओं को").alias("mii_price_band_percent"),
            number("mii.mii_max_quantity_percent", "Maximum Percentage of Bid quantity for MII", "मेक इन इंडिया खरीद में प्राथमिकता के लिए बिड").alias("mii_max_quantity_percent"),
            present_first(js, "mii.allow_only_class_1_2_local_suppliers", F.when(F.contains(F.lower(local), F.lit("yes")), "Yes")).alias("allow_only_class_1_2_local_suppliers"),
        ),
        "mse": F.struct(
            maybe("mse.mse_purchase_preference", "MSE Purchase Preference", "एमएसई खरीद वरीयता").alias("mse_purchase_preference"), number("mse.mse_price_band_percent", "Purchase Preference to MSE", "सूक्ष्म और लघु").alias("mse_price_band_percent"),
            number("mse.mse_max_quantity_percent", "Maximum Percentage of Bid quantity for MSE", "Percentage of Bid quantity/amount for MSE").alias("mse_max_quantity_percent"),
        ),
        "financials": F.struct(
            F.struct((F.coalesce(present_first(js, "financials.emd.required", ((emd_bank != "") | (F.coalesce(amount, F.lit(0)) != 0))), F.lit("false")) == "true").alias("required"), emd_bank.alias("advisory_bank"), amount.alias("amount_total"), F.coalesce(given_list(js, "$.financials.emd.schedule_breakup"), empty).alias("schedule_breakup")).alias("emd"),
            F.struct((F.coalesce(present_first(js, "financials.epbg.required", epbg_bank != ""), F.lit("false")) == "true").alias("required"), epbg_bank.alias("advisory_bank"), present_first(js, "financials.epbg.percent", to_float(get("ePBG Percentage", "ईपीबीजी प्रतिशत"))).try_cast("double").alias("percent"), number("financials.epbg.duration_months", "Duration of ePBG", "ईपीबीजी की आवश्यक अवधि").alias("duration_months")).alias("epbg"),
            present_first(js, "financials.emd_exemption_text", exempt).alias("emd_exemption_text"),
        ),
        "terms": F.struct(
            F.coalesce(F.get_json_object(js, "$.terms.special_terms_version"), blank).alias("special_terms_version"), F.coalesce(F.get_json_object(js, "$.terms.special_terms_text"), blank).alias("special_terms_text"),
            F.struct(F.coalesce(F.nullif(F.get_json_object(js, "$.terms.buyer_atc.generic"), blank), "generic").alias("generic"), F.coalesce(given_list(js, "$.terms.buyer_atc.items"), empty).alias("items"), F.coalesce(given_list(js, "$.terms.buyer_atc.hard_requirements"), empty).alias("hard_requirements"), F.coalesce(given_list(js, "$.terms.buyer_atc.info_clauses"), empty).alias("info_clauses")).alias("buyer_atc"),
            F.coalesce(F.nullif(F.get_json_object(js, "$.terms.disclaimer"), blank), "disclaimer").alias("disclaimer"),
        ),
    }
    fields = lambda kv: F.struct(emd_total(kv).alias("emd"), *[tables.kv_get(kv, *p).alias(name) for p, name in asked.items()])
    base = base.withColumn("got", tables.let(F.col("kv"), fields)).withColumn("method", method)
    base = base.withColumn("found_items", F.when(F.size(from_json["items"]) > 0, from_json).otherwise(from_text))
    return base.select(F.col("doc").alias(key), F.struct(*[v.alias(k) for k, v in pdf.items()]).alias("pdf"))
