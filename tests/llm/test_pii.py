from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sensorgrid.llm import pii
from sensorgrid.llm.pii import configured_key, digest, luhn, mapping, replace
from tests.llm import brute_pii

KEY = "k"

TEXTS = [
    "Write to John.Smith@Mail8.example.com or john.smith@mail8.example.com, call +1 (988) 555-2485. Or 1-988-555-2485!",
    "Mr. John Smith and Mrs. Smith met Mary Miller. Mr. SMITH", "card 4111111111111111 and 4111-1111-1111-1111; ip 42.144.35.254 ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00",
    "г-жа Анна Петрова и Иван Петров", "12-31-1999 2024-01-05 v1.2.3.4.5 nothing", "a@b.co " * 3000,
]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_formats_and_coreference(spark, documents):
    found = texts(replace(documents(list(enumerate(TEXTS))), KEY))
    for i in (0, 1, 2, 3, 5):
        assert found[i] != TEXTS[i]
    assert found[4] == TEXTS[4]
    a, b = re.findall(r"[\w.]+@[\w.]+\.com", found[0])
    assert a.lower() == b and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{4}@[A-Z][a-z]{3}\d\.[a-z]{7}\.com", a)
    p, q = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4})\. Or 1-(\d{3})-", found[0]), re.search(r"1-(\d{3})-(\d{3}-\d{4})!", found[0])
    assert p and p.groups()[:2] == q.groups() and p[1] != "988"
    names = re.fullmatch(r"Mr\. (\w+) (\w+) and Mrs\. (\w+) met (\w+) (\w+)\. Mr\. (\w+)", found[1])
    assert names[2] == names[3] == names[6].capitalize() and names[6].isupper() and not {"John", "Smith", "Mary", "Miller"} & set(names.groups())
    cards = re.match(r"card (\d{16}) and (\d{4}-\d{4}-\d{4}-\d{4}); ip ((?:\d+\.){3}\d+) ssn (\d{3}-\d\d-\d{4}) iban DE(\d\d(?: \d{4}){4} \d\d)$", found[2])
    assert cards[1] == cards[2].replace("-", "") and cards[1][0] == "4" and all(0 <= int(x) < 256 for x in cards[3].split("."))
    assert spark.range(1).select(luhn(F.lit(cards[1])) % 10).first()[0] == 0
    assert re.fullmatch(r"г-жа [А-Я][а-я]+ [А-Я][а-я]+ и [А-Я][а-я]+ [А-Я][а-я]+", found[3])


def test_same_key_same_surrogates_other_key_others(spark, documents):
    df = documents([(1, TEXTS[0])])
    assert texts(replace(df, "k")) == texts(replace(df, "k")) != texts(replace(df, "l"))


def test_edge_cases(spark, documents, odd):
    rows = [*odd, (9, TEXTS[2]), (9, TEXTS[2])]
    found = replace(documents(rows), KEY, keep=("source", "lang")).collect()
    assert sorted((r.doc_id or -1, "~" if r.text is None else r.text) for r in found if r.doc_id != 9) == sorted((i or -1, "~" if t is None else t) for i, t in rows if i != 9)
    assert len({r.text for r in found if r.doc_id == 9}) == 1 and sum(r.doc_id == 9 for r in found) == 2
    assert replace(documents([]), KEY).count() == 0
    told = {r.doc_id: r for r in digest(replace(documents([(9, TEXTS[2]), (1, None)]), KEY)).collect()}
    assert [told[9][f"n_{k}"] for k in pii.KINDS] == [0, 1, 2, 1, 1, 0, 0] and not any(told[1][f"n_{k}"] for k in pii.KINDS)


def test_surrogates_are_distinct_and_new(spark):
    """Two-letter local parts and one-letter domains leave few surrogates, so that many are drawn again."""
    rows = [("email", f"{a}@{b}.co", "") for a in "abcdefghijklmnopqrst" for b in "abcdefghij"] + [("ssn", f"{i:09d}", "") for i in range(50)]
    found = mapping(spark.createDataFrame(rows, "kind string, canonical string, role string"), KEY).collect()
    assert len(found) == len(rows) == len({(r.kind, r.surrogate) for r in found})
    assert not {(r.kind, r.surrogate) for r in found} & {r[:2] for r in rows}
    assert all(re.fullmatch(r"\d*[a-z]@[a-z]\.co", r.surrogate) for r in found if r.kind == "email")


def test_plan_has_no_python(spark, documents):
    plan = replace(documents([(1, TEXTS[0])]), KEY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_names_are_replaced_in_all_their_forms(spark, documents):
    text = "Mr Peter Smith met Anna Meier. Meier left. Smith, Peter stayed. PETER SMITH called. Smith's dog, O'Neill and Jean-Luc Picard; Picard."
    found = texts(replace(documents([(1, text), (2, "Smith, Peter stayed.")]), KEY))
    assert not re.search("(?i)peter|smith|meier|anna|picard", found[1]) and "O'Neill" in found[1] and "'s dog" in found[1]
    m = re.fullmatch(r"Mr (\w+) (\w+) met (\w+) (\w+)\. (\w+) left\. (\w+), (\w+) stayed\. (\w+) (\w+) called\. (\w+)'s dog, O'Neill and (\w+) (\w+); (\w+)\.", found[1])
    assert (m[1], m[2]) == (m[7], m[6]) == (m[8].capitalize(), m[9].capitalize()) and m[4] == m[5] and m[2] == m[10] and m[12] == m[13]
    assert found[2] == "Smith, Peter stayed."  # no name of this document


def test_check_digits_stay_valid(spark, documents):
    found = texts(replace(documents([(1, "DE89 3704 0044 0532 0130 00"), (2, "GB82 WEST 1234 5698 7654 32"), (3, "DE88 3704 0044 0532 0130 00")]), KEY))
    assert [brute_pii.mod97(found[i].replace(" ", "")) == 1 for i in (1, 2, 3)] == [True, True, False]
    assert re.fullmatch(r"GB\d\d [A-Z]{4}( \d{4}){3} \d\d", found[2]) and "WEST" not in found[2]


def test_long_tokens(spark, documents):
    n = 200_000
    rows = [
        "x@" + "a." * n + "com", "y" * n + "@b.com", "x@" + "a-" * n, "1" * n, "1 " * n, "+1 " * n, "DE89 " + "3704 " * n, "1.2." * n, "Mr " + "A" * n, "Mr P" + "-Lee" * n,
        "Anna " + "Meier " * n, "Mr O" + "'" * n, "(" * n + "1" * 5, "0" + " " * n + "x", "@" * n,
    ]
    found = texts(replace(documents(list(enumerate(rows))), KEY))
    assert [found[i] != t for i, t in enumerate(rows)] == [True, True, False, False, found[4] != rows[4], found[5] != rows[5], found[6] != rows[6], False, True, True, True, False, False, False, False]
    assert len(found[0]) == len(rows[0]) and len(found[1]) == len(rows[1]) and "Meier" not in found[10]


def test_addresses_run_out_into_longer_ones(spark):
    row = spark.createDataFrame([("ip", "1.2.3.4", "")], "kind string, canonical string, role string")
    told = row.select(pii.surrogate(F.col("kind"), F.col("canonical"), F.col("role"), pii.ROUNDS + 1, KEY).alias("s")).first().s
    assert re.fullmatch("fd[0-9a-f]{2}(:[0-9a-f]{4}){7}", told)


def test_key_comes_from_the_session(spark):
    with pytest.raises(ValueError):
        configured_key(spark)
    spark.conf.set(pii.KEY_SETTING, "secret")
    assert configured_key(spark, "other") == "secret"
    spark.conf.unset(pii.KEY_SETTING)
    assert configured_key(spark, "other") == "other"


def test_equals_brute_force(spark, documents, odd):
    r = random.Random(4)
    names = [w for ws in (*pii.GIVEN.values(), "Smith Meier Petrova Иванов O'Brien Jean-Luc SMITH") for w in ws.split()]
    titles = [w for ws in pii.TITLES.values() for w in ws.split()]

    def piece():
        k, digits = r.randrange(12), lambda n: "".join(r.choice("0123456789") for _ in range(n))
        name = lambda: r.choice(names)
        return (
            f"{name()}.{digits(2)}@{r.choice('abc')}{digits(1)}.co", f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", r.choice(["4111111111111111", digits(16), "3782-822463-10005"]),
            f"{digits(3)}-{digits(2)}-{digits(4)}", f"{r.randint(0, 300)}.{r.randint(0, 255)}.1.{r.randint(0, 255)}", r.choice(["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", f"FR{digits(2)} {digits(4)} {digits(4)}"]),
            f"{r.choice(titles)}{r.choice(['.', ''])} {name()} {name()}", f"{name()} {name()}", name(), name() + "'s", "plain words, 3.5 and", r.choice(["\n", "—", "😀", "e.g."]),
        )[k]

    rows = [(i, " ".join(piece() for _ in range(r.randint(1, 25)))) for i in range(100, 400)] + [(i, t) for i, t in odd if i is not None]
    found = sorted((x.doc_id, x.text or "~") for x in replace(documents(rows), KEY).collect())
    assert found == sorted((i, t or "~") for (i, _), t in zip(rows, brute_pii.replace([t for _, t in rows], KEY), strict=True))
