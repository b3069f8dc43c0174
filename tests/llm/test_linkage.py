import pytest

from probatum.llm.linkage import author_match, clean_doi, clean_title, kind_of_work, match_records, same_work, title_match

WORK = "work_id long, title string, authors array<string>, year string, doi string, id int"
RECORD = "record_id long, title string, authors array<string>, year string, doi string, id int"


@pytest.mark.parametrize(
    "title, kind",
    [
        ("Erratum: On the maize plot", "erratum"),
        ("Eratum: On the maize plot", "erratum"),
        ('Reply to "On the maize plot"', "reply"),
        ("On the maize plot, Part II", "|part2"),
        ("On the maize plot: Part 3.", "|part3"),
        ("On the maize plot: 2011 report", "|report2011"),
        ("On the maize plot and the report card", ""),
        ("", ""),
    ],
)
def test_kind(title, kind):
    assert kind_of_work(clean_title(title)) == kind


def test_parts():
    assert clean_doi(" https://doi.org/10.5555/ABC.2001.") == "10.5555/abc.2001" and clean_doi("n/a") == "" and clean_doi(None) == ""
    one = [1.0] * 4
    assert title_match(["the", "spin", "lattice", "sensor"], one, ["the", "spinlattice", "sensr", "x"], one)[0] > 0.9
    assert title_match([], [], ["a"], [1.0]) == (0.0, 0.0)
    assert author_match(["runut|k"], []) is None and author_match(["runut|k"], ["runutt|k", "homon|b"]) == 1.0


def test_matching(spark):
    words = "maize plot spin lattice verdict appeal kernel module vowel loanword dosage biopsy referee podium tariff subsidy".split()
    works, records = [], []
    for i in range(40):
        title = f"Measuring the {words[i % 16]} in Place{chr(97 + i % 26)}oni: a study of {words[(i * 5 + 3) % 16]} and {words[(i * 7 + 1) % 16]} {i}"
        authors = [f"Kofi Fam{chr(97 + i % 26)}{chr(98 + i % 7)}urnov", f"B. Nam{chr(97 + i * 3 % 26)}{chr(98 + i % 5)}ikov"]
        works.append((i, title, authors, str(2000 + i % 20), f"10.5555/w{i}.20", 1))
        if i % 2 == 0:
            records.append((1000 + i, title.upper().replace("MEASURING", "Mesuring"), authors[:1], str(2000 + i % 20), None, 1))
    works += [
        (100, "Erratum: " + works[0][1], works[0][2], "2001", "10.5555/e0.20", 1),
        (101, works[0][1], None, None, None, 1),
        (102, "Corrections", ["Kofi Other"], "2001", None, 1),
        (103, None, None, None, None, 1),
        (104, "", [], "", "", 1),
    ]
    records += [
        (2000, "Corrections", ["Wholly Different"], "2015", None, 1),
        (2001, None, None, None, None, 1),
        (2002, "long " * 3000, ["A " * 500], "1", "x", 1),
        records[0],
    ]
    a, b = spark.createDataFrame(works, WORK), spark.createDataFrame(records, RECORD)
    got = {(r["work_id"], r["record_id"]) for r in same_work(a, b, "work_id", "record_id").collect()}
    assert got == {(i, 1000 + i) for i in range(0, 40, 2)} | {(101, 1000)}
    assert match_records(a.limit(0), b, "work_id", "record_id").count() == 0
    assert all(0 < r["confidence"] < 1 for r in same_work(a, b, "work_id", "record_id").collect())
