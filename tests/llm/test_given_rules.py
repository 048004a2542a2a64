from quillon.llm import urls


def test_given_rules_are_those_of_the_contract(spark):
    """Each rule's word, and an exception within a rule of the other word, both ways."""
    assert urls.RULES == (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
    cases = {
        "http://a.com/en/7": ("com/en/", "block"), "http://b.example.com/en/71": ("example.com/en/7", "allow"), "http://shop.net/de/8": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://x.example.net/de/81": ("example.net/de/8", "block"), "http://x.org/es/": ("org/es/", "block"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    everything = [([["s:http"]], 1.0)]  # a mined rule that every url fits decides none that a given rule does
    for mined in ([], everything):
        got = {r.page_id: (r["rule"], r.verdict) for r in urls.filter_urls(pages, urls.RULES, mined).collect()}
        assert got == dict(enumerate(cases.values()))
