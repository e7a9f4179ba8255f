"""Ranking of a page's marks for a request, and the choice of a product on it: decision lists as tables of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskline.functions import patterns as P
from maskline.operators.facets import part, search_query

# --- fixed values: places and services in requests ---
SERVICES = [
    ("hotels", r"(?i)\b(hotels?|homestays?|villas?|resorts?|rooms?|lodging)\b"),
    ("trains", r"(?i)\b(trains?|rail|irctc)\b"),
    ("buses", r"(?i)\b(buses?|bus|volvo)\b"),
    ("cabs", r"(?i)\b(cabs?|taxi|car rental)\b"),
    ("flights", r"(?i)\b(flights?|flying|fly|airline|airlines?|airways?|airport|airports?)\b"),
    ("flights", r"(?i)\b(makemytrip|goibibo|cleartrip|expedia|booking\.com)\b"),
]
TRAVELS = r"(?i)\b(book|tickets?|travel|trip|vacation)\b"
#: Pattern, and which of its parts is the origin and which the destination; the first that fits.
ROUTES = [
    (r"(?i)\bfrom\s+([a-zA-Z\s]+?)\s+to\s+([a-zA-Z\s]+?)(?:\s+(?:on|for|date|and|,|tickets?|flights?)|$)", 1, 2),
    (r"(?i)\bto\s+([a-zA-Z\s]+?)\s+from\s+([a-zA-Z\s]+?)(?:\s+(?:on|for|date|and|,|tickets?|flights?)|$)", 2, 1),
    (r"(?i)\b(?:flights?|tickets?|cabs?|bus|trains?)\s+(?:from\s+)?([a-zA-Z\s]+?)\s+to\s+([a-zA-Z\s]+?)(?:\s+(?:on|for|date|and|,)|$)", 1, 2),
    (r"(?i)\b([a-zA-Z\s]+?)\s+to\s+([a-zA-Z\s]+?)\s+(?:flights?|tickets?|cabs?|bus|trains?)\b", 1, 2),
]
GOES_TO = r"(?i)\bto\s+([a-zA-Z\s]+?)(?:\s+(?:on|for|date|and|,|tickets?|flights?)|$)"
COMES_FROM = r"(?i)\bfrom\s+([a-zA-Z\s]+?)(?:\s+(?:on|for|date|and|,|tickets?|flights?)|$)"
ARTICLE, SERVICE_END = r"(?i)^(?:the|a|an)\s+", r"(?i)\s+(?:flights?|tickets?|cabs?|bus|trains?|hotels?)$"
# --- fixed values: kinds of requests ---
TRAVEL_WORDS = r"(?i)\b(flights?|hotels?|airports?|airlines?|makemytrip|goibibo|cleartrip|irctc|redbus)\b"
MESSAGE_WORDS = r"(?i)\b(whatsapp|telegram|slack|message|msg|send\s+.*to|chat|text\s+.*to)\b"
CART_WORDS = r"(?i)\b(add\s+to\s+cart|add\s+to\s+basket|buy\s+now)\b"
# --- fixed values: roles and labels of marks ---
FILLABLE = ("input:text", "input:search", "input:email", "input:tel", "input:password", "textarea", "editable", "combobox")
SELECTS = ("select", "input:select", "combobox")
CLICKABLE = ("link", "button", "clickable", "input:submit", "input:checkbox", "input:radio", "checkbox", "radio")
SEARCH_LABEL = "(?i)search|find|query|keyword|looking for|explore"
NOT_SENT_BY = "document|contact|photo|video|location|file|media|audio|voice|call|new"
SENT_BY = r"^\s*send(\s+message)?\s*$|^\s*send (msg|\(enter\))\s*$"
DISTRACTORS = r"\b(sign\s*in|sign\s*up|log\s*in|accounts?|profile|register|bestsellers?|best\s*sellers?|trending|todays?\s*deals?|deals?|customer\s*service|help|prime|sell|registry|gift\s*cards?|orders?|returns?)\b"
CART = r"\b(cart|basket)\b"
NO_FLIGHTS = r"\b(hotels?|homestays?|villas?|resorts?|holiday\s*packages?|trains?|buses?|cabs?)\b"
NO_HOTELS = r"\b(flights?|trains?|buses?|cabs?)\b"

#: The decision list (fixed values): kind of request, what the mark has to be, score, and whether that decides or is added.
STOP, ADD = "stop", "add"
RULES = [
    ("message", "sends", 800, STOP),
    ("message", "role = 'editable' or label like '%type a message%'", 600, STOP),
    ("message", "label like '%search%' and fillable or label like '%search or start new chat%'", 400, STOP),
    ("message", r"label rlike '^\\s*(back|<|←)\\s*$' or label rlike '^\\s*chats?(?![a-z0-9_])'", 300, STOP),
    ("message", "label rlike 'send document|add contact|new call|ask meta ai|go to calls|enter a phone number|phone number'", -1000, STOP),
    ("shop", "wants_cart and label rlike 'add to cart|add to basket|buy now'", 800, STOP),
    ("shop", "not landed and search_mark and fillable", 500, STOP),
    ("shop", "not landed and label rlike 'search|find|go' and role rlike 'button|submit|clickable'", 200, STOP),
    ("shop", "landed and wants_filter and not filtered and (selects or label rlike 'min|max|to|price|filter|under|₹')", 450, ADD),
    ("shop", "landed and role in ('link', 'clickable') and length(label) > 15", 250, ADD),
    ("shop", "distracts", -1000, STOP),
    ("flights", "label rlike no_flights", -1000, STOP),
    ("flights", r"label rlike '^\\s*flights?\\s*$'", 100, ADD),
    ("hotels", "label rlike no_hotels", -1000, STOP),
    ("hotels", r"label rlike '^\\s*hotels?\\s*$'", 100, ADD),
    ("any", "field", 50, ADD),
    ("any", "field and label rlike 'from|origin|departure|flying from|source'", 40, ADD),
    ("any", "field and label rlike 'to|destination|arrival|flying to'", 40, ADD),
    ("any", "field and label rlike 'date|depart'", 20, ADD),
    ("any", "field and (label like '%search%' or role = 'input:search')", 30, ADD),
    ("any", "label rlike 'search|find' and (role rlike 'button|clickable' or role = 'input:submit')", 60, ADD),
    ("any", "role rlike 'option|suggestion|listitem'", 70, ADD),
    ("any", "contains(label, lower(from_city))", 35, ADD),
    ("any", "contains(label, lower(to_city))", 35, ADD),
]


def travel(text: Column) -> Column:
    """Struct of category, from_city and to_city that a request speaks of; each null if it doesn't."""
    t = F.trim(F.coalesce(text, F.lit("")))
    named, origin, target, routed = F, F, F, F.lit(False)
    for name, words in SERVICES:
        named = named.when(t.rlike(P.java(words)), name)
    named = named.otherwise(None)
    for pattern, a, b in ROUTES:
        fits = t.rlike(P.java(pattern))
        origin, target, routed = origin.when(fits, F.regexp_extract(t, P.java(pattern), a)), target.when(fits, F.regexp_extract(t, P.java(pattern), b)), routed | fits
    goes = named.isNotNull() | t.rlike(P.java(TRAVELS))
    origin, target = origin.when(goes, part(t, P.java(COMES_FROM), 1)), target.when(goes, part(t, P.java(GOES_TO), 1))
    city = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), ARTICLE, ""), SERVICE_END, "")), F.lit(""))
    category = F.coalesce(named, F.when(routed, "flights"))
    return F.named_struct(F.lit("category"), category, F.lit("from_city"), city(origin), F.lit("to_city"), city(target))


def with_request(requests: DataFrame) -> DataFrame:
    """scan_id and what the rules ask of a request: its kinds, its wishes and how far it is.

    requests: scan_id, text, and if they are there category, wants_add_to_cart, wants_filter, max_price, query_landed, filter_applied."""
    have = set(requests.columns)
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in have else F.lit(False)
    t = F.coalesce("text", F.lit(""))
    given = F.nullif(F.col("category"), F.lit("")) if "category" in have else F.lit(None).cast("string")
    df = requests.withColumn("_go", travel(F.col("text")))
    goes = given.isNotNull() | F.expr("_go.category is not null or _go.from_city is not null or _go.to_city is not null") | t.rlike(P.java(TRAVEL_WORDS))
    message = t.rlike(P.java(MESSAGE_WORDS))
    priced = F.coalesce(F.col("max_price") > 0, F.lit(False)) if "max_price" in have else F.lit(False)
    return df.select(
        "scan_id", message.alias("message"), (search_query(t).isNotNull() & ~goes & ~message).alias("shop"), F.when(goes, F.coalesce(given, "_go.category", F.lit("flights"))).alias("service"),
        (flag("wants_add_to_cart") | t.rlike(P.java(CART_WORDS))).alias("wants_cart"), (flag("wants_filter") | priced).alias("wants_filter"), flag("query_landed").alias("landed"), flag("filter_applied").alias("filtered"),
        F.col("_go.from_city").alias("from_city"), F.col("_go.to_city").alias("to_city"),
    )


def with_mark(df: DataFrame) -> DataFrame:
    """df (role, label) with what the rules ask of a mark, in lower case."""
    df = df.withColumns({"own_role": F.col("role"), "own_label": F.col("label"), "role": F.lower(F.coalesce("role", F.lit(""))), "label": F.lower(F.coalesce("label", F.lit("")))})
    fillable, selects, clickable = (F.col("role").isin(*x) for x in (FILLABLE, SELECTS, CLICKABLE))
    travels = F.col("label").rlike("from|origin|departure|flying from|source|to|destination|arrival|flying to")
    return df.withColumns({
        "fillable": fillable, "selects": selects, "field": fillable | (travels & clickable), "sends": ~F.trim("label").rlike(NOT_SENT_BY) & F.col("label").rlike(SENT_BY),
        "search_mark": (F.coalesce("own_role", F.lit("")) == "input:search") | F.col("label").rlike(SEARCH_LABEL),
        "distracts": F.col("label").rlike(P.java(DISTRACTORS)) | (~F.col("wants_cart") & F.col("label").rlike(P.java(CART))), "no_flights": F.lit(P.java(NO_FLIGHTS)), "no_hotels": F.lit(P.java(NO_HOTELS)),
    })


def rule_score(rules: list[tuple[str, str, int, str]] = RULES) -> Column:
    """The score of the first rule that decides, else the sum of those that add."""
    kinds = {"message": "message", "shop": "shop", "flights": "service = 'flights'", "hotels": "service = 'hotels'", "any": "true"}
    holds = [(F.expr(f"coalesce(({kinds[kind]}) and ({what}), false)"), score, how) for kind, what, score, how in rules]
    first = F.coalesce(*(F.when(c, score) for c, score, how in holds if how == STOP))
    total = F.lit(0)
    for c, score, how in holds:
        if how == ADD:
            total = total + F.when(c, score).otherwise(0)
    return F.coalesce(first, total)


def rank_marks(requests: DataFrame, marks: DataFrame, filled: DataFrame, most: int = 45) -> DataFrame:
    """scan_id, mark_id, role, label, score, place: a request's most relevant marks, filled ones left out; labels cut to 60.

    One request a scan; marks: scan_id, mark_id, ord, role, label. Ties keep the page's order. Marks without a request don't appear."""
    rest = marks.join(filled.select("scan_id", "mark_id").distinct(), ["scan_id", "mark_id"], "left_anti")
    df = with_mark(rest.join(with_request(requests), "scan_id")).withColumn("score", rule_score())
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("score"), "ord"))
    out = df.withColumn("place", place).filter(F.col("place") <= most)
    return out.select("scan_id", "mark_id", F.col("own_role").alias("role"), F.left(F.coalesce("own_label", F.lit("")), F.lit(60)).alias("label"), "score", "place")


# --- fixed values: what is no product, and how labels tell prices and ratings ---
NO_PRODUCT = r"\b(sign\s*in|account|returns|orders|customer\s*service|customer\s*care|prime|todays?\s*deals|bestsellers|best\s*sellers|registry|sell|sellers?|selling|become\s+a|advertise|download\s+app|track\s+order|gift\s*cards|feedback|help|privacy|terms|skip\s*to|next|previous|page\s*\d+|cookie|explore|see\s*more|filter|sort\s*by|menu|nav)\b"
PRICE = r"(?:₹|rs\.?|inr|\$)\s*([\d,]+)"
RATING, PLAIN_RATING = r"([1-5](?:\.\d+)?)\s*(?:out of 5|\★|stars?)", r"\b([1-5]\.\d)\b"


def choose_products(requests: DataFrame, marks: DataFrame) -> DataFrame:
    """scan_id, mark_id, score: on each request's page the best product, if it scores above 0; ties: the first of the page.

    requests: scan_id, query, max_price, min_price, min_rating, cheapest; marks: scan_id, mark_id, ord, role, label. A product is a link or
    clickable of ten characters and more that isn't part of the site; with words sought (over two letters), one that tells a price,
    holds a word, or is a link of twenty characters. 100, 50 for each word; over the price -500, else 150 and for the cheapest a tenth of
    the rest; under the least price -300; a rating below the wanted one -500, else 40 a star; sponsored -30."""
    label = F.lower(F.coalesce(F.col("label"), F.lit("")))
    rows = marks.filter(F.col("role").isin("link", "clickable")).select("scan_id", "mark_id", "ord", "role", label.alias("l")).filter((F.length("l") >= 10) & ~F.col("l").rlike(P.java(NO_PRODUCT)))
    words = F.filter(F.split(F.lower(F.coalesce("query", F.lit(""))), r"\s+"), lambda w: F.length(w) > 2)
    asked = requests.select("scan_id", words.alias("words"), *(F.nullif(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("max_price", "min_price", "min_rating")), F.coalesce("cheapest", F.lit(False)).alias("cheapest"))
    df = rows.join(asked, "scan_id").withColumns({
        "held": F.size(F.filter("words", lambda w: F.contains(F.col("l"), w))), "price": F.replace(F.regexp_extract("l", P.java(PRICE), 1), F.lit(","), F.lit("")).try_cast("double"),
        "rating": F.coalesce(F.regexp_extract("l", P.java(RATING), 1).try_cast("double"), F.regexp_extract("l", P.java(PLAIN_RATING), 1).try_cast("double")),
    })
    evidence = F.col("l").rlike(P.java(PRICE)) | (F.col("held") > 0) | ((F.col("role") == "link") & (F.length("l") >= 20))
    df = df.filter((F.size("words") == 0) | evidence)
    price = F.when(F.col("price") > F.col("max_price"), -500.0).when(F.col("price").isNotNull() & F.col("max_price").isNotNull(), 150 + F.when(F.col("cheapest"), (F.col("max_price") - F.col("price")) / 10).otherwise(0)).otherwise(0.0)
    least = F.when(F.col("price") < F.col("min_price"), -300.0).otherwise(0.0)
    stars = F.when(F.col("rating") < F.col("min_rating"), -500.0).otherwise(F.coalesce(F.col("rating") * 40, F.lit(0.0)))
    score = 100 + 50 * F.col("held") + price + least + stars - F.when(F.contains(F.col("l"), F.lit("sponsored")), 30).otherwise(0)
    best = df.withColumn("score", score.cast("double")).groupBy("scan_id").agg(F.min_by(F.struct("mark_id", "score"), F.struct((-F.col("score")).alias("s"), "ord")).alias("b"))
    return best.select("scan_id", "b.mark_id", "b.score").filter("score > 0")
