import pytest

from probatum.operators.packed import block_fields, found_values, packed_values, resolve, skeleton


def split(value, persons=True):
    kinds, at = skeleton(value, persons)
    cuts = resolve(kinds, persons)
    return [value[at[2 * a] : at[2 * b + 1]] for a, b in zip(cuts[::2], cuts[1::2])]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("Homon, B. and C. P. Sossim", ["Homon, B.", "C. P. Sossim"]),
        ("A. Homon AND van Teist, Z. D. and others", ["A. Homon", "van Teist, Z. D."]),
        ("Oswaldo Homon, Christopher P. Sossim & Mikhail K. Teim", ["Oswaldo Homon", "Christopher P. Sossim", "Mikhail K. Teim"]),
        ("Homon, O.; Sossim, C. P.; et al.", ["Homon, O.", "Sossim, C. P."]),
        ("Homon, Amara\n   Hiroko Schul\n  Fleis, T.", ["Homon, Amara", "Hiroko Schul", "Fleis, T."]),
        ("Homon, Amara\n   Hiroko Schul et al.", ["Homon, Amara", "Hiroko Schul"]),
        ("Dmitri\n   B. Teisan", ["Dmitri\n   B. Teisan"]),
        ("Sus\\\"an Q. Dot / Kofi {\\'E}l", ["Sus\\\"an Q. Dot", "Kofi {\\'E}l"]),
        ('"CTC Huk", Mike Kriss, Y. Thang, and W. Moner', ['"CTC Huk"', "Mike Kriss", "Y. Thang", "W. Moner"]),
        ("{Tides and Currents Council, Rel} \\& P. van Wor", ["{Tides and Currents Council, Rel}", "P. van Wor"]),
        ("Homon, O., Sossim, C. P.", ["Homon, O.", "Sossim, C. P."]),
        ("Homon, O. and Sossim, C. P. and ...", ["Homon, O.", "Sossim, C. P."]),
        ("Homon, O.; Sossim, C. P.; etc.", ["Homon, O.", "Sossim, C. P."]),
        ("", []),
        ("  ,, ; and ", []),
    ],
)
def test_persons(value, expected):
    assert split(value) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("a b, c/d, e and f", ["a b", "c/d", "e and f"]),
        ("a / b | c · d;; e,", ["a", "b", "c", "d", "e"]),
        ("a, b, ...", ["a", "b"]),
        ("a\n b, c", ["a\n b", "c"]),
        ("a\n b", ["a", "b"]),
        ('"a, b", {c; d}', ['"a, b"', "{c; d}"]),
    ],
)
def test_keywords(value, expected):
    assert split(value, False) == expected


def test_block_fields_survive_damage():
    assert list(block_fields(None)) == []
    assert list(block_fields("@a{k")) == []
    assert list(block_fields('@a{k, Author = {A {\\"o} B}, year = 2001, t = "x {"} y"}')) == [
        ("author", 'A {\\"o} B'), ("year", "2001"), ("t", 'x {"} y')]
    assert list(block_fields("@a{k, author = {never closed"))[0][0] == "author"


def test_rows(spark):
    rows = [
        (1, '@a{k, author = {{A and B}  and "C, D"}, keywords = {x;  y\n z ; {}}}', 9),
        (1, '@a{k, author = {{A and B}  and "C, D"}, keywords = {x;  y\n z ; {}}}', 9),
        (2, None, 1),
        (3, "", 1),
        (4, "@a{k, author = {Only One}}", 1),
        (5, "@a{k, keywords = {" + ", ".join(f"w{i}" for i in range(3000)) + "}}", 1),
    ]
    df = spark.createDataFrame(rows, "entry_id long, text string, pos int")
    got = {tuple(r) for r in found_values(df).collect()}
    small = {r for r in got if r[0] != 5}
    assert small == {(1, "author", 1, "A and B"), (1, "author", 2, "C, D"), (1, "keywords", 1, "x"), (1, "keywords", 2, "y z")}
    assert len(got) == 3004
    assert packed_values(df.filter("entry_id = 4"), True).count() == 1
    assert found_values(df.limit(0)).count() == 0
