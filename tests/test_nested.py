"""Flatten of nested recipient documents (FIXTURES §2.1)."""

import json
import tempfile

from __spark_entry__ import queries
from honorlens.sources import nested as N


def _doc():
    return {"laureates": [
        {"id": "1", "givenName": {"en": "Ana"}, "familyName": {"en": "Ost"}, "gender": "female",
         "birth": {"date": "1867-11-07", "place": {"country": {"en": "X"}, "continent": {"en": "Europe"}}},
         "death": {"date": "1934-07-04"},
         "nobelPrizes": [{"awardYear": "1903", "category": {"en": "Physics"}, "motivation": {"en": "m"},
                          "prizeAmount": 100, "affiliations": [{"name": {"en": "U1"}}, {"name": {"en": "U2"}}]},
                         {"awardYear": "1911", "category": {"en": "Chemistry"}, "affiliations": []}]},
        {"id": "2", "orgName": {"en": "Org"}, "founded": {"date": "1863-00-00"},
         "nobelPrizes": [{"awardYear": "1917", "category": {"en": "Peace"}}]},
        {"id": "3", "givenName": {"en": "Bo"}, "birth": {"date": "1943-00-00"},
         "nobelPrizes": [{"awardYear": "1990"}]},
        {"id": "4", "givenName": {"en": "Cy"}, "birth": {"date": "1900-00-00"}, "death": {"date": "not-a-date"},
         "nobelPrizes": [{}]},
        {"id": "5", "givenName": {"en": "Di"}, "nobelPrizes": []},
        {"id": "6", "givenName": {"en": "Ed"}, "birth": {"date": "1900-00-00"}, "death": {"date": "1950-01-01"},
         "nobelPrizes": [{"awardYear": "1930", "prizeAmount": "n/a"}]},
    ]}


def test_flatten_fixture(spark):
    d = tempfile.mkdtemp(prefix="honorlens-json-")
    with open(f"{d}/page-1.json", "w", encoding="utf-8") as f:
        json.dump(_doc(), f)
    rows = N.flatten(N.read_documents(spark, d)).orderBy("id", "award_year").collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    assert "5" not in by  # no awards -> no rows
    a1, a2 = by["1"]
    assert (a1["age_at_award"], a2["age_at_award"]) == (36, 44) and (a1["decade"], a2["decade"]) == (1900, 1910)
    assert a1["lifespan"] == 66.7 and a1["is_alive"] is False
    assert a1["affiliation"] == "U1" and a2["affiliation"] is None and a2["motivation"] == ""
    org = by["2"][0]
    assert org["gender"] == "organization" and str(org["birth_date"]) == "1863-01-01" and org["age_at_award"] == 54
    assert org["lifespan"] is None and org["is_alive"] is False and org["name"] == "Org"
    p3 = by["3"][0]
    assert p3["gender"] == "unknown" and p3["age_at_award"] == 47 and p3["is_alive"] is True and p3["name"] == "Bo"
    assert p3["category"] == "Unknown" and p3["portion"] == "1"
    p4 = by["4"][0]
    assert p4["death_date"] is None and p4["is_alive"] is True and p4["award_year"] is None and p4["age_at_award"] is None
    p6 = by["6"][0]
    assert p6["lifespan"] == 50.0 and p6["prize_amount"] is None


def test_partial_dates(spark):
    from honorlens.functions.scalar import parse_partial_date

    vals = ["1943-05", "1943", "1943-5-1", "1943-02-30", "", "None"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [None if r[0] is None else str(r[0]) for r in df.select(parse_partial_date("s")).collect()]
    assert got == ["1943-05-01", "1943-01-01", "1943-05-01", None, None, None]


def test_pages_directory_concatenates_records(spark):
    d = tempfile.mkdtemp(prefix="honorlens-pages-")
    docs = _doc()["laureates"]
    for i in range(0, len(docs), 2):  # three page files of two records each
        with open(f"{d}/page-{i}.json", "w", encoding="utf-8") as f:
            json.dump({N.RECORDS_FIELD: docs[i:i + 2]}, f)
    assert N.read_documents(spark, d).count() == len(docs)
    one = tempfile.mkdtemp(prefix="honorlens-one-")
    with open(f"{one}/all.json", "w", encoding="utf-8") as f:
        json.dump(_doc(), f)
    a = sorted(map(str, N.flatten(N.read_documents(spark, d)).collect()))
    b = sorted(map(str, N.flatten(N.read_documents(spark, one)).collect()))
    assert a == b


def test_malformed_json_rows_yield_no_records(spark):
    rows = [(json.dumps(_doc()),), ("{not json",), (None,), ('{"other": 1}',)]
    df = spark.createDataFrame(rows, "json string")
    flat = N.flatten(N.parse_documents(df))
    assert flat.count() == N.flatten(N.parse_documents(df.limit(1))).count()


def test_documents_are_parsed_once_and_behind_the_join(spark):
    plan = queries()["nested_records_flatten"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.index("from_json(") < plan.index("Join")


def test_empty_and_missing_lists_give_no_rows_and_null_elements_stay(spark):
    texts = ['{"laureates": [null, {"id": "1", "nobelPrizes": [null, {"awardYear": "1999"}]}, {"id": "2", "nobelPrizes": []}, {"id": "3"}]}', '{"laureates": []}', "{}", "no json"]
    rec = N.parse_documents(spark.createDataFrame([(t,) for t in texts], "json string"))
    assert sorted(str(r.id) for r in rec.collect()) == ["1", "2", "3", "None"]
    assert sorted((r.id, str(r.award_year)) for r in N.flatten(rec).collect()) == [("1", "1999"), ("1", "None")]
