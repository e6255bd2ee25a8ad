"""Scalar functions on text columns: numbers, cleaning, flags, keys, tokens, intents and display forms."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DEVANAGARI = "०१२३४५६७८९"
#: Words that end a conversation.
EXIT_WORDS = ("quit", "exit", "q", "bye", "goodbye", "stop", "close", "end", "done", "ok bye", "/bye", "/quit", "/exit")
#: Words of questions that ask for a list, and of those that ask for one record.
LIST_WORDS = (
    "all", "every", "list", "show all", "show me all", "how many", "total", "complete list", "give me all", "show me", "display all",
    "what bids", "which bids", "bids do you have",
)
FOCUS_WORDS = ("bid number", "bid no", r"GEM/\d{4}", "specific", "one bid", "find bid", "this bid")
#: Fixed values of the document classifier.
CUSTOM_MARKS = ("Custom Bid for Services", "Custom BOQ")
BOQ_MARKS = ("BOQ Title", "BOQ Detail Document")
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def clean_text(x: Column, strip_br: bool = True) -> Column:
    """Line-break tags and white space runs become one blank; ends are trimmed. Null becomes ''."""
    x = text_or_empty(x)
    if strip_br:
        x = F.regexp_replace(x, r"(?i)<br\s*/?>", " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def to_int(x: Column) -> Column:
    """All digits of a text as one number, decimal digits of Devanagari included; null without digits."""
    digits = F.translate(F.regexp_replace(x.cast("string"), r"(?U)[^\d]", ""), DEVANAGARI, "0123456789")
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def to_float(x: Column) -> Column:
    """The first run of digits and points as a number; null if there is none or it is no number."""
    return F.nullif(F.regexp_extract(x.cast("string"), r"[0-9.]+", 0), F.lit("")).try_cast("double")


def yesno(x: Column) -> Column:
    """'Yes' or 'No' by the beginning of a text, else null."""
    low = F.lower(clean_text(x))
    return F.when(low.startswith("yes"), "Yes").when(low.startswith("no") & (low != "none"), "No")


def strip_tags(x: Column) -> Column:
    """Text of a fragment of HTML without its tags and with the six commonest entities as their characters."""
    out = F.regexp_replace(text_or_empty(x), r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return clean_text(out)


#: An entity with its end mark.
ENDED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def ended(text: str) -> str:
    """A text with the entities that end in a semicolon as their characters; names without one stay text, unknown ones too."""
    return ENDED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), text)


def unescaped(x: Column, bare: bool = True) -> Column:
    """A text with all entities of HTML as their characters; bare: those that lack their semicolon, too. Only texts with
    an ampersand leave the JVM."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else html.unescape(t) if bare else ended(t) for t in texts.to_pylist()], pa.string())

    return F.coalesce(F.arrow_udf(run, "string")(F.when(F.contains(x, F.lit("&")), x)), x)


def strip_html(x: Column, bare: bool = True) -> Column:
    """Text of a fragment of HTML: tags become blanks and entities their characters; bare as in unescaped."""
    return clean_text(unescaped(F.regexp_replace(text_or_empty(x), r"<[^>]+>", " "), bare))


def to_24h(time: Column, ampm: Column) -> Column:
    """hh:mm and a half of the day as HH:MM:00. Hours beyond 12 get twelve more, as they stand."""
    hour = F.split_part(time, F.lit(":"), F.lit(1)).try_cast("int")
    minute = F.split_part(time, F.lit(":"), F.lit(2)).try_cast("int")
    half = F.upper(F.trim(text_or_empty(ampm)))
    h = F.when((half == "PM") & (hour != 12), hour + 12).when((half == "AM") & (hour == 12), F.lit(0)).otherwise(hour)
    return F.when(hour.isNull() | minute.isNull(), F.lit("")).otherwise(F.format_string("%02d:%02d:00", h, minute))


def safe_key(x: Column) -> Column:
    """A key as a folder's name."""
    return F.replace(F.coalesce(F.nullif(x, F.lit("")), F.lit("unknown_bid")), F.lit("/"), F.lit("_"))


# The patterns of both numbers.
def record_number(x: Column) -> Column:
    return F.regexp_extract(text_or_empty(x), r"GEM/\d{4}/B/\d+", 0)


def revision_number(x: Column) -> Column:
    return F.regexp_extract(text_or_empty(x), r"GEM/\d{4}/R/\d+", 0)


def any_of(x: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(x, F.lit(m))
    return out


def process_kind(md: Column) -> Column:
    """CUSTOM, BOQ or CATALOGUE by marks in a document."""
    md = text_or_empty(md)
    return F.when(any_of(md, CUSTOM_MARKS), "CUSTOM").when(any_of(md, BOQ_MARKS), "BOQ").otherwise("CATALOGUE")


def base_type(md: Column, product_type: Column) -> Column:
    kind, product = process_kind(md), F.upper(text_or_empty(product_type))
    return F.when(kind == "CUSTOM", F.concat(F.lit("CUSTOM_"), product)).when(kind == "BOQ", "BOQ").otherwise(product)


def label_of(key: Column, labels: dict[str, str]) -> Column:
    """A key's label from a small fixed table; the key itself where it isn't there."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key) if pairs else key


def evaluation_method(x: Column) -> Column:
    """How bids are evaluated: the first method that a document names."""
    x = text_or_empty(x)
    # The methods' patterns and names.
    return (
        F.when(x.rlike(r"(?i)Item\s*wise\s*evaluation"), "Item_Wise")
        .when(x.rlike(r"(?i)Total\s*(?:value\s*)?wise\s*evaluation"), "Total_Wise")
        .when(x.rlike(r"(?i)Group\s*wise\s*evaluation"), "Group_Wise")
        .otherwise("Other")
    )


def words_pattern(words: tuple[str, ...]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def smart_top_k(question: Column, k: int) -> Column:
    """How many records a question asks for: lists get 15 at least, questions for one record half of k."""
    return F.when(question.rlike(words_pattern(LIST_WORDS)), F.lit(max(k, 15))).when(question.rlike(words_pattern(FOCUS_WORDS)), F.lit(max(1, k // 2))).otherwise(F.lit(k))


def is_exit(x: Column) -> Column:
    return F.lower(clean_text(x)).isin(*EXIT_WORDS)


def tokens(x: Column) -> Column:
    """Lower-case words between white space; no stems, no stop words."""
    return F.filter(F.split(F.lower(text_or_empty(x)), r"(?U)\s+"), lambda t: t != "")


def rich_text(*columns: Column) -> Column:
    """The text that is indexed by words: metadata before the passage."""
    return F.lower(F.concat_ws(" ", *[text_or_empty(c) for c in columns]))


def query_prefix(question: Column, model: Column) -> Column:
    return F.when(F.lower(model).like("%bge%"), F.concat(F.lit(QUERY_PREFIX), question)).otherwise(question)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def normal_bm25(x: Column) -> Column:
    return F.least(F.lit(1.0), x / 20)


def percent(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


#: Where a passage names its item.
ITEM_PATTERNS = (
    r"(?i)Item\s*Category\s*[:\-]?\s*([A-Z][^\n]{3,200}?)(?:\s{2,}|\n|Bid)",
    r"(?i)Item\s*Title\s*[:\-]?\s*([A-Z][^\n]{3,200}?)(?:\s{2,}|\n|Bid)",
    r"(?i)व\S+\s+\S+\s*/Item Category\s+([^\n]{3,200})",
)
UNFIT = "which regular"


def item_of(chunk: Column, meta_item: Column) -> Column:
    """The item that an answer names: of the metadata if it says something, else from the passage."""
    meta = F.trim(text_or_empty(meta_item))
    out = F.when((F.length(meta) > 3) & ~F.contains(F.lower(meta), F.lit(UNFIT)), F.substring(meta, 1, 200))
    for pattern in ITEM_PATTERNS:
        got = F.trim(F.regexp_extract(text_or_empty(chunk), pattern, 1))
        out = F.coalesce(out, F.when((got != "") & ~F.contains(F.lower(got), F.lit(UNFIT)), F.substring(got, 1, 200)))
    return F.coalesce(out, F.lit("N/A"))


#: Labels and columns of the metadata card.
CARD = [
    ("Bid Number", "bid_no"), ("RA Number", "ra_no"), ("Bid Type", "bid_type"), ("Product Type", "product_type"), ("Item", "full_item_name"), ("Items mentioned", "full_item_name"),
    ("Quantity", "quantity"), ("Department", "department"), ("Start Date", "start_date"), ("End Date", "end_date"), ("Estimated Value", "estimated_value"), ("Bid Packet Type", "bid_packet_type"),
]


def metadata_card(columns: dict[str, Column]) -> Column:
    """Labelled metadata of a record, in fixed order."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{label}: "), text_or_empty(columns.get(name, F.lit(""))), F.lit(".")) for label, name in CARD])


def record_document(card: Column, body: Column) -> Column:
    """A record as one text: its card, then its body."""
    return F.regexp_replace(F.concat(card, F.lit("\n"), text_or_empty(body)), r"(?U)^\s+|\s+$", "")


def shortened(x: Column, n: int) -> Column:
    """The first n characters of a text, for lists; '' for null."""
    return F.substring(text_or_empty(x), 1, n)


def closing_soon(end: Column, now_utc: Column, minutes: int = 20) -> Column:
    """Whether a record with an end time in India's zone is still open long enough; true where it can't be read."""
    at = F.try_to_timestamp(end, F.lit("dd-MM-yyyy h:mm a"))
    now = F.timestamp_add("MINUTE", F.lit(330), now_utc)
    return F.coalesce(F.timestamp_diff("SECOND", now, at) / 60 > minutes, F.lit(True))


def multi_item(name: Column) -> Column:
    """Whether an item's name lists several."""
    return F.instr(name, ",") > 0
