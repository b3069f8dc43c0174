import pytest

from probatum.llm.names import GivenNames, assignment_cost, edits, entity_pairs, name_entities, plain, read_name

GIVEN = GivenNames({"kofi", "johanna", "veronika"})


@pytest.mark.parametrize(
    "name, kind, anchor, letters",
    [
        ("Kofi W. Runut", "p", "runut", "k"),
        ("Runut, K. W.", "p", "runut", "k"),
        ("RUNUT, Kofi", "p", "runut", "k"),
        ("Runut KW", "p", "runut", "k"),
        ("Runut Kofi", "p", "runut", "k"),
        ("Dr. kofi runut", "p", "runut", "k"),
        ("Veronika von der Skíem", "p", "skiem", "v"),
        ("Skíem, Vera von der", "p", "skiem", "v"),
        ("Veronika vonderSk{\\'i}em", "p", "skiem", "v"),
        ("Hanna Purkein Jeim", "p", "purkeinjeim", "j"),
        ("Purkein-Jeim, Johanna", "p", "purkeinjeim", "j"),
        ("Huk Committee for Tides and Currents", "o", "huk", "cct"),
        ("Tides & Currents Committee, Huk", "o", "huk", "cct"),
        ("The Huk Comm. of Tides and Currents (CTC)", "o", "huk", "cct"),
        ("CTC Huk", "o", "huk", "cct"),
        ("Inst. Open Meas., Schan", "o", "schan", "imo"),
    ],
)
def test_reading(name, kind, anchor, letters):
    assert read_name(name, GIVEN)[:3] == (kind, anchor, letters)


def test_nothing_to_read():
    assert read_name("K. P.", GIVEN)[:2] == ("p", "kp")
    assert read_name(None, GIVEN) is None and read_name(" , ", GIVEN) is None and read_name("1234", GIVEN) is None


def test_parts():
    assert plain("Fiemau{\\v s}ki Tasat{\\o}r Kr{\\\"o}l {\\aa}") == "Fiemauski Tasator Krol a"
    assert edits("thuttanen", "thuttaen") == 1 and edits("ab", "ba") == 1 and edits("abc", "xyz") == 3
    assert assignment_cost(["richard", "p"], ["p", "dick"]) < 0.5
    assert assignment_cost(["department", "language"], ["lang", "dept"]) < 1
    assert assignment_cost(["kofi"], ["johanna"]) >= 1


def test_pairs(spark):
    people = [f"{f}, {g}" for f in ("Tostunim", "Wekardal", "Brimsov", "Haldeniff") for g in ("Kofi", "Johanna", "Veronika")]
    same = ["Runutaver, Kofi W.", "K. W. Runutaver", "Kofi Runutavr", "Kofi W. Runutaver"]
    other = ["Runutaver, Johanna", "J. Runutaver", "Kofi B. Runutaver", "Huk Council for Open Data", "Council for Open Data, Huk"]
    names = people + same + other + [None, "", "  ", same[0], "Long " * 5000 + "Name"]
    df = spark.createDataFrame([(n, 1) for n in names], "name string, entity int")
    pairs = {(r["name_a"], r["name_b"]) for r in entity_pairs(name_entities(df)).collect()}
    among = lambda group: {(a, b) for a in group for b in group if a < b}
    assert among(same) <= pairs
    assert among(other[:2]) <= pairs and among(other[3:]) <= pairs
    assert not any("Kofi B. Runutaver" in p for p in pairs)
    assert not any(set(p) & set(people) for p in pairs)
    assert not any((p[0] in same) != (p[1] in same) for p in pairs)
    assert name_entities(df.limit(0)).count() == 0


def test_assignment_is_optimal():
    import itertools
    import random

    from probatum.llm.names import token_cost

    rng = random.Random(4)
    words = "k p kofi johanna hanna johanma dept department lang language w. richard dick".split()
    for _ in range(200):
        a, b = ([rng.choice(words) for _ in range(rng.randint(0, 4))] for _ in range(2))
        if len(a) > len(b):
            a, b = b, a
        best = min((sum(token_cost(x, y) for x, y in zip(a, p)) for p in itertools.permutations(b, len(a))), default=0.0)
        assert abs(assignment_cost(a, b) - best) < 1e-9, (a, b)
    many = [f"word{i}" for i in range(14)]
    assert assignment_cost(many, many[::-1]) == 0 and assignment_cost(many[:13] + ["zzzz"], many[::-1]) >= 2


def test_a_first_letter_misspelt(spark):
    df = spark.createDataFrame([(n,) for n in ("Sokormin Brelvanik", "Brelvanik, Sokormin", "S. Brelvanik", "Sokormin BRELVANIK", "Dokormin Brelvanik", "Brelvanik, Tokalis")], "name string")
    got = {r["name"]: r["entity"] for r in name_entities(df).collect()}
    assert got["Dokormin Brelvanik"] == got["Sokormin Brelvanik"] != got["Brelvanik, Tokalis"]


def test_edits_are_those_of_the_whole_table():
    import random

    def table(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(2))
        for most in (1, 2):
            assert edits(a, b, most) == min(table(a, b), most + 1), (a, b, most)
