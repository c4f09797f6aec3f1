"""Structured data: fixtures of nodes and what they lack."""

import json

from pyspark.sql import functions as F

from crawlsight.operators import linked_data, readiness, signals


def pages(spark, *blocks, host="a.test"):
    sources = ["".join(f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>' for x in b) for b in blocks]
    return spark.createDataFrame([(i, f"https://{host}/{i}", s) for i, s in enumerate(sources)] + [(99, f"https://{host}/99", None)], "page_id long, url string, html string")


def test_nodes_name_what_they_lack(spark):
    graph = {"@context": {"@type": "x"}, "@graph": [
        {"@type": "Organization", "name": "Acme", "url": "/"},
        {"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "Price?", "acceptedAnswer": {"@type": "Answer", "text": ""}}]},
        {"@type": "SoftwareApplication", "name": "Acme"}, {"@type": "Article", "headline": "Launch", "datePublished": "soon"},
    ]}
    typed = linked_data.nodes(pages(spark, [graph]))
    rows = linked_data.node_checks(typed).orderBy("no").collect()
    assert [r.type for r in rows] == ["Organization", "FAQPage", "Question", "SoftwareApplication", "Article"]
    by = {r.type: r for r in rows}
    assert not by["Organization"].ok and by["Organization"].problems == ['url is not absolute: "/".'] and by["Organization"].label == "Acme"
    assert by["Organization"].missing_recommended == ["logo", "sameAs", "description", "contactPoint"]
    assert by["FAQPage"].ok and by["Question"].problems == ["The accepted answer has no text."]
    assert by["SoftwareApplication"].missing_required == ["offers or aggregateRating or review"]
    assert by["Article"].problems == ['datePublished is not a date: "soon".'] and by["Article"].label == "Launch"


def test_odd_nodes(spark):
    deep = {"@type": "Person", "name": "six"}
    for _ in range(4):
        deep = {"a": deep}
    deeper = {"a": {"a": {"a": {"a": {"a": {"a": {"@type": "Person", "name": "too deep"}}}}}}}
    mixed = [
        {"@type": ["Thing", "Person"], "name": " "}, {"@type": "Person", "name": None}, {"@type": "Person", "name": ["", None, ["x"]]},
        {"@type": "Person", "name": 7}, {"@type": "Thing", "name": "no rule"}, {"@type": 5, "name": "no type"}, {"@type": "Event", "name": "e",
         "startDate": "2024-02-30", "location": {}}, {"@type": "Event", "name": "e", "startDate": "March 5, 2024", "location": "x"},
        {"@type": "Question", "name": "q", "acceptedAnswer": [{"text": "yes"}]}, {"@type": "Question", "name": "{\"@type\": \"Person\"}", "acceptedAnswer": "text"},
    ]
    typed = linked_data.nodes(pages(spark, [deep, deeper], ["{broken", mixed], ["[]", "3", '"x"', "null"], [[{"@type": "Person", "name": str(i)} for i in range(40)]]))
    rows = linked_data.node_checks(typed).orderBy("page_id", "no").collect()
    of = lambda page: [r for r in rows if r.page_id == page]
    assert [r.label for r in of(0)] == ["six"] and not of(2) and not of(99)
    assert [r.label for r in of(3)] == [str(i) for i in range(24)]
    assert [(r.type, bool(r.missing_required), len(r.problems)) for r in of(1)] == [
        ("Person", True, 0), ("Person", True, 0), ("Person", False, 0), ("Person", False, 0), ("Event", False, 1), ("Event", False, 0),
        ("Question", False, 0), ("Question", False, 1),
    ]
    assert linked_data.nodes(pages(spark).limit(0)).count() == 0


def test_organisation_checks(spark):
    full = {"@type": "LocalBusiness", "name": "B", "url": "https://b.test", "logo": "l", "sameAs": ["x", "y"]}
    some = {"@type": "Store", "name": "C", "url": "", "logo": False, "sameAs": "one"}
    link = '<a href="https://www.linkedin.com/company/c/">c</a><a href="https://linkedin.evil/">n</a>'
    rows = [
        (1, "https://b.test/", f'<script type="application/ld+json">{json.dumps([full, some])}</script>'),
        (2, "https://c.test/", link), (3, "https://c.test/x", f'<script type="application/ld+json">{json.dumps(some)}</script>'), (4, "https://d.test/", "<p>none</p>"),
    ]
    source = spark.createDataFrame(rows, "page_id long, url string, html string")
    orgs = linked_data.organisations(linked_data.nodes(source))
    assert {r.host: (r.core, r.same_as) for r in orgs.collect()} == {"b.test": (["name", "url", "logo"], 2), "c.test": (["name"], 1)}
    checks = readiness.entity_checks(signals.page_signals(source), orgs)
    got = {(r.host, r.check_id): (r.status, r.earned) for r in checks.collect()}
    assert got == {
        ("b.test", "organization-schema"): ("pass", 8.0), ("b.test", "same-as"): ("pass", 4.0), ("c.test", "organization-schema"): ("warn", 4.0),
        ("c.test", "same-as"): ("warn", 2.0), ("d.test", "organization-schema"): ("fail", 0.0), ("d.test", "same-as"): ("fail", 0.0),
    }
