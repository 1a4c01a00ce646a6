from tallyspark.plans.query import from_url, parse_yen, resolve, short_yen, to_url


def test_defaults_and_limits():
    q, errors = resolve({})
    assert not errors and q.year == "2024" and (q.view.top_ministry, q.view.top_project, q.view.top_recipient) == (37, 50, 50)
    assert not q.filter.active
    assert resolve({"view": {"topProject": 999, "topMinistry": 0}})[0].view.top_project == 300


def test_errors_are_told():
    bad = {"year": "1999", "filter": {"subcontract": {"minDepth": 1}, "budget": {"min": 5, "max": 1}, "accountCategories": ["x"],
                                      "projectName": {"query": "(", "regex": True}}}
    assert len(resolve(bad)[1]) == 5


def test_url_round_trip():
    raw = {"year": "2025", "filter": {"projectName": {"query": "a+b", "regex": True}, "recipientName": {"query": "株式会社", "includeSubcontract": True},
                                      "ministries": ["A省", "B省"], "budget": {"min": 1e8, "max": 1.5e12}, "spending": {"min": 12345}, "accountCategories": ["both"],
                                      "subcontract": {"minDepth": 3}},
           "view": {"topProject": 7, "offset": {"target": "recipient", "recipient": 5}, "showAggProject": False, "focusRelated": True, "pin": {"ministryName": "A省"}}}
    q, errors = resolve(raw)
    assert not errors and resolve(from_url(to_url(q))) == (q, [])


def test_amounts():
    for text, yen in (("1.26億", 126_000_000), ("４５６７万円", 45_670_000), ("一千二百億", 120_000_000_000), ("1兆2000億", 1_200_000_000_000),
                      ("-51000円", -51_000), ("x", None), ("", None), ("5千円", 5000), ("1兆2000", 1_200_000_000_000), ("兆", None),
                      ("1.2.3", None), ("12億5千万", 1_250_000_000), ("1,234", 1234), ("1.5", 1.5), ("千", 1000), ("－３億", -300_000_000)):
        assert parse_yen(text) == yen
    for yen in (10**12, 3 * 10**8, 20_000, 12_345):
        assert parse_yen(short_yen(yen)) == yen


def test_patterns_are_those_of_the_jvm(spark):
    for pattern, fine in (("(?P<n>x)", False), ("(", False), ("(?<n>x)", True), ("a|b", True)):
        q, errors = resolve({"filter": {"projectName": {"query": pattern, "regex": True}}})
        assert bool(errors) != fine
