"""Listing cards: structs from a card's text and HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivec.functions.html_cards import popover
from lexivec.functions.text import clean_text, label_of, record_number, revision_number, strip_tags, text_or_empty, to_24h

#: Product labels by type of record.
PRODUCT_LABELS = {
    "Product Bid/RAs": "Product", "Service Bid/RAs": "Service", "Bid To RAs": "Bid To RA", "Product Custom Bid/RAs": "Product", "BOQ Bids": "BOQ",
    "Rate Contract Bids": "Rate Contract", "Global Tender": "Global Tender", "Limited Tender": "Limited Tender", "Single Tender": "Single Tender",
}


def card_date(text: Column, which: str) -> Column:
    """'DD-MM-YYYY HH:MM:SS' of a card's Start or End date, '' without one."""
    # Fixed value: how a card writes its dates.
    pattern = rf"(?i){which}\s+Date\s*[:\-]?\s*(\d{{2}}-\d{{2}}-\d{{4}})\s+(\d{{1,2}}:\d{{2}})\s*(AM|PM)?"
    part = lambda k: F.regexp_extract(text_or_empty(text), pattern, k)
    return F.when(part(1) == "", F.lit("")).otherwise(F.concat(part(1), F.lit(" "), to_24h(part(2), part(3))))


def product_type(text: Column, bid_type: Column) -> Column:
    """A card's stated type, else the first word for a type that it holds, else the label of its record type."""
    text = text_or_empty(text)
    # The pattern, and the words for types in this order.
    stated = F.regexp_extract(text, r"(?i)Type\s*[:\-]\s*(Product|Service|Works|Goods)", 1)
    out = F.when(stated != "", F.initcap(stated))
    for word in ("Service", "Product", "Works", "Goods"):
        out = out.when(text.rlike(rf"(?i)\b{word}\b"), word)
    return out.otherwise(label_of(bid_type, PRODUCT_LABELS))


def quantity(text: Column) -> Column:
    # Fixed value: the pattern.
    found = F.replace(F.regexp_extract(text_or_empty(text), r"(?i)Quantity\s*[:\-]?\s*([\d][\d,]*)", 1), F.lit(","), F.lit(""))
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def departments(text: Column) -> Column:
    """array<struct<name, address, city, state, pincode>> of a card: none or one."""
    # Fixed value: where a card names its department.
    block = F.regexp_extract(text_or_empty(text), r"(?i)Department\s+Name(?:\s+And\s+Address)?\s*[:\-]?\s*\n?([^\n]+(?:\n[^\n]+)*?(?=\nStart Date|\Z))", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    address = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), ", ")
    one = F.struct(F.get(lines, F.lit(0)).alias("name"), address.alias("address"), F.lit("").alias("city"), F.lit("").alias("state"), F.regexp_extract(address, r"\b\d{6}\b", 0).alias("pincode"))
    return F.when(F.size(lines) > 0, F.array(one)).otherwise(F.array().cast("array<struct<name:string,address:string,city:string,state:string,pincode:string>>"))


def item_name(text: Column, html: Column) -> Column:
    """A card's item: that of its popovers, else of its text."""
    # Fixed value: where a card's text names its item.
    stated = F.regexp_extract(text_or_empty(text), r"(?is)Items?\s*:\s*(.+?)(?:\n|Quantity\s*:)", 1)
    return F.coalesce(popover(html), F.regexp_replace(clean_text(stated), r"\.+$", ""))


def href(link: Column) -> Column:
    """The target of a link: in double quotes, in single ones, or bare; '' without one."""
    part = lambda k: F.regexp_extract(link, r"""(?is)^<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", k)
    return F.replace(F.concat(part(1), part(2), part(3)), F.lit("&amp;"), F.lit("&"))


def links(html: Column, base_url: str) -> Column:
    """document_url, ra_url and corrigendum_url of a fragment's links; of several the last."""
    found = F.regexp_extract_all(text_or_empty(html), F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    label = lambda a: F.lower(strip_tags(a))
    low = lambda a: F.lower(href(a))

    def last(keep) -> Column:
        hit = F.try_element_at(F.filter(found, lambda a: (href(a) != "") & keep(a)), F.lit(-1))
        return F.coalesce(F.concat(F.lit(base_url + "/"), F.regexp_replace(href(hit), "^/+", "")), F.lit(""))

    doc = lambda a: F.contains(low(a), F.lit("showbiddocument"))
    return F.struct(
        last(doc).alias("document_url"),
        last(lambda a: ~doc(a) & F.contains(low(a), F.lit("showradocumentpdf"))).alias("ra_url"),
        last(lambda a: F.contains(label(a), F.lit("corrigendum"))).alias("corrigendum_url"),
    )


def card_details(text: Column, html: Column, bid_type: Column) -> Column:
    """A card as struct<bid, card>."""
    bid = F.struct(record_number(text).alias("bid_no"), revision_number(text).alias("ra_no"), bid_type.alias("bid_type"), product_type(text, bid_type).alias("product_type"), F.lit("").alias("base_type"), F.lit("").alias("process_kind"))
    items = F.array(F.struct(item_name(text, html).alias("name"), quantity(text).alias("quantity")))
    card = F.struct(items.alias("items"), departments(text).alias("departments"), card_date(text, "Start").alias("start_datetime"), card_date(text, "End").alias("end_datetime"), F.lit("").alias("bid_pdf_url"), F.lit("").alias("ra_pdf_url"))
    return F.struct(bid.alias("bid"), card.alias("card"))
