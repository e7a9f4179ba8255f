"""Ranking of marks and choice of products: every rule once, with the score that it has to give."""

import pytest

from maskline.operators import facets, marks

ASKED = {
    "msg": {"text": "send hello to Asha on whatsapp"},
    "shop": {"text": "search for red shoes"},
    "landed": {"text": "search for red shoes", "query_landed": True, "max_price": 900.0},
    "filtered": {"text": "search for red shoes", "query_landed": True, "wants_filter": True, "filter_applied": True},
    "cart": {"text": "search for red shoes and add to cart"},
    "flight": {"text": "book a flight from New Delhi to Goa on Friday"},
    "hotel": {"text": "find hotels"},
    "given": {"text": "go on", "category": "hotels"},
    "other": {"text": "open it"},
}
SCORES = [
    ("msg", "button", "Send", 800), ("msg", "button", "Send message ", 800), ("msg", "button", "send (enter)", 800), ("msg", "button", "Send document", -1000), ("msg", "editable", "x", 600), ("msg", "text", "Type a message", 600),
    ("msg", "input:text", "Search", 400), ("msg", "text", "Search or start new chat", 400), ("msg", "button", " Back ", 300), ("msg", "button", "Chats now", 300), ("msg", "link", "Phone number", -1000), ("msg", "link", "Hotels", 0),
    ("shop", "input:search", "", 500), ("shop", "input:text", "Find it", 500), ("shop", "button", "Go", 200), ("shop", "link", "Sign in", -1000), ("shop", "link", "Your cart", -1000), ("shop", "link", "Hotels", 0), ("shop", "listitem", "shoes", 70),
    ("cart", "button", "Add to Cart", 800), ("cart", "link", "Your cart", 0), ("cart", "link", "Best sellers", -1000),
    ("landed", "select", "size", 450), ("landed", "combobox", "size", 500), ("landed", "link", "A very long red shoe", 250), ("landed", "link", "Under 900, a red shoe", 700), ("landed", "text", "price", 450), ("landed", "link", "help", -1000), ("landed", "input:search", "Search", 80),
    ("filtered", "select", "size", 0), ("filtered", "link", "A very long red shoe", 250),
    ("flight", "link", "Hotels", -1000), ("flight", "link", "Flights", 100), ("flight", "input:text", "From", 90), ("flight", "input:text", "Going to", 90), ("flight", "input:text", "Departure date", 110), ("flight", "button", "Search", 60),
    ("flight", "listitem", "Goa, to New Delhi", 140), ("flight", "input:submit", "Find", 60),
    ("hotel", "link", "Trains", -1000), ("hotel", "link", "hotels ", 100), ("given", "link", "cabs", -1000), ("given", "text", "Hotel", 100),
    ("other", "link", "Tokyo", 90), ("other", "text", "Tokyo", 0), ("other", "option", "A", 70), ("other", None, None, 0),
]


def test_every_rule(spark):
    names = {"scan_id": "string", "text": "string", "category": "string", "wants_add_to_cart": "boolean", "wants_filter": "boolean", "max_price": "double", "query_landed": "boolean", "filter_applied": "boolean"}
    requests = spark.createDataFrame([tuple({"scan_id": k, **v}.get(n) for n in names) for k, v in ASKED.items()], ", ".join(" ".join(x) for x in names.items()))
    rows = [(k, i, i, role, label) for i, (k, role, label, _) in enumerate(SCORES)]
    kind = "scan_id string, mark_id int, ord int, role string, label string"
    df = spark.createDataFrame(rows, kind)
    got = {r["mark_id"]: r["score"] for r in marks.rank_marks(requests, df, df.limit(0)).collect()}
    assert [(*SCORES[i][:3], got[i]) for i in range(len(SCORES))] == SCORES


def test_places(spark):
    kind = "scan_id string, mark_id int, ord int, role string, label string"
    df = spark.createDataFrame([("a", i, i, "link" if i % 7 else "option", "x" * 70) for i in range(60)] + [("b", 1, 0, "link", "y")], kind)
    requests = spark.createDataFrame([("a", "open it")], "scan_id string, text string")
    got = marks.rank_marks(requests, df, df.filter("mark_id in (7, 8)")).orderBy("place").collect()
    left = [i for i in range(60) if i not in (7, 8)]
    assert [r["mark_id"] for r in got] == ([i for i in left if i % 7 == 0] + [i for i in left if i % 7])[:45] and {len(r["label"]) for r in got} == {60}


@pytest.mark.parametrize("text, want", [
    ("book a flight from New Delhi to Goa on Friday", ("flights", "New Delhi", "Goa")), ("from the Paris to Rome", ("flights", "Paris", "Rome")), ("to Pune from Goa", ("flights", "Goa", "Pune")),
    ("cabs Pune to Goa", ("cabs", "Pune", "Goa")), ("Delhi to Pune flights", ("flights", "Delhi", "Pune")), ("tickets to Oslo", (None, None, "Oslo")), ("walk to Oslo", (None, None, None)), ("goibibo", ("flights", None, None)), (None, (None, None, None)),
])
def test_travel(spark, text, want):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(marks.travel(marks.F.col("t")).alias("g")).first()["g"]) == want


def test_products(spark):
    asked = [("a", "red shoe", 2000.0, None, 3.0, True), ("b", "red shoe", None, 500.0, None, False), ("c", None, None, None, None, False), ("d", "hat", None, None, None, None), ("e", "lamp", 10.0, None, None, None)]
    requests = spark.createDataFrame(asked, "scan_id string, query string, max_price double, min_price double, min_rating double, cheapest boolean")
    rows = [
        ("a", "link", "Red shoe, ₹1,500, 4.5 stars", 100 + 100 + 150 + 50 + 180), ("a", "link", "Red shoe ₹1,000 2.0 out of 5 stars", 100 + 100 + 150 + 100 - 500), ("a", "link", "Red shoe ₹2,500", 100 + 100 - 500), ("a", "link", "Become a seller of red shoes today", None), ("a", "button", "Red shoe ₹1", None),
        ("b", "clickable", "Sponsored red shoe rs. 600", 100 + 100 - 30), ("b", "link", "red shoe $400", 100 + 100 - 300), ("b", "link", "Aurex Stratos 14 with 4.1", 100 + 164),
        ("c", "clickable", "anything at all", 100), ("c", "link", "short", None), ("d", "clickable", "no evidence for it here", None), ("e", "link", "lamp for rs 400", 100 + 50 - 500),
    ]
    df = spark.createDataFrame([(s, i, i, role, label) for i, (s, role, label, _) in enumerate(rows)], "scan_id string, mark_id int, ord int, role string, label string")
    want = {}
    for i, (s, _, _, score) in enumerate(rows):
        if score is not None and score > 0 and score > want.get(s, (0, 0.0))[1]:
            want[s] = (i, float(score))
    assert {r["scan_id"]: (r["mark_id"], r["score"]) for r in marks.choose_products(requests, df).collect()} == want


def test_products_of_many_alike(spark):
    """Tasks and listings that are alike meet once, and every task still gets the best of all listings."""
    listings = spark.range(6000).selectExpr("id AS listing_id", "concat(element_at(array('red', 'blue', 'old'), int(id % 3) + 1), ' ', element_at(array('ring', 'bolt'), int(id % 2) + 1)) AS title", "IF(id % 11 = 0, NULL, double(900 + id % 400)) AS price", "IF(id % 13 = 0, NULL, double(id % 6)) AS rating", "id % 10 = 0 AS sponsored")
    tasks = spark.range(500).selectExpr("id AS task_id", "element_at(array('red ring', 'old bolt', 'blue x ring', 'green'), int(id % 4) + 1) AS query", "IF(id % 5 = 0, NULL, double(900 + id % 5 * 50)) AS max_price", "IF(id % 7 = 0, NULL, double(id % 7)) AS min_rating", "IF(id % 2 = 0, 'cheapest', NULL) AS pick")
    out = facets.select_products(tasks, listings)
    offers = [r.asDict() for r in listings.collect()]

    def score(t, p):
        n = sum(w in p["title"].split() for w in t["query"].split() if len(w) > 2)
        s = 100 + 50 * n + (0 if t["max_price"] is None else -500 if p["price"] is not None and p["price"] > t["max_price"] else 150)
        s += -500 if None not in (p["rating"], t["min_rating"]) and p["rating"] < t["min_rating"] else 40 * (p["rating"] or 0)
        return n, s - 30 * p["sponsored"] - (min((300 if p["price"] is None else p["price"]) / 10, 300) if t["pick"] == "cheapest" else 0)

    wanted = {}
    for t in tasks.collect():
        s, i = max(((x, -p["listing_id"]) for p in offers for n, x in [score(t, p)] if n), default=(0, 0))
        if s > 0:
            wanted[t["task_id"]] = (-i, s)
    assert {r["task_id"]: (r["listing_id"], r["score"]) for r in out.collect()} == wanted
    met = facets.never_behind(facets.never_behind(listings.selectExpr("*", "split(title, ' ') AS _ws", "price IS NULL AS _unpriced"), 64), None)
    assert met.count() < 1000
