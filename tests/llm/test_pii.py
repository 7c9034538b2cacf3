import random
import re
import time
from collections import Counter

import pytest

from helpers import awkward_docs, clashing, frame
from placerank.llm import pii

NAMES = pii.Pseudonyms(b"key")


@pytest.mark.parametrize("radix,length", [(10, 1), (10, 3), (10, 4), (2, 7), (3, 5), (26, 2)])
def test_feistel_is_a_permutation(radix, length):
    out = [NAMES.feistel.digits(v, radix, length, "x") for v in range(radix ** length)]
    assert sorted(out) == list(range(radix ** length)) and (length == 1 or out != sorted(out))


def test_ranges_are_permuted_within():
    even = [NAMES.feistel.below(v, 1000, "y", lambda v: v % 2 == 0) for v in range(0, 1000, 2)]
    assert sorted(even) == list(range(0, 1000, 2))


CASES = [
    ("card 4041894974608795.", {"card": 1}), ("card 4041 8949 7460 8795", {"card": 1}), ("card 4041894974608796", {}),
    ("ip 53.118.65.158 and 300.1.1.1", {"ip": 1}), ("v1.2.3.4.5", {}), ("+1 (906) 555-7738", {"phone": 1}), ("906-555-7738", {"phone": 1}),
    ("2024-02-29 2023-02-29 31/12/1999 1.2.2003 12.31.2003", {"date": 4}), ("1776-07-04", {}), ("123-45-6789 000-12-3456", {"ssn": 1}),
    ("a.b+c1@mail.example.org, x@y", {"email": 1}), ("password=531ccd051a92ebcb68", {"secret": 1}), ("TOKEN = \"9233A8ECF7C5B09F\"", {"secret": 1}),
    ("token = nothingsecrethere", {}), ("GB82 WEST 1234 5698 7654 32", {"iban": 1}), ("GB82 WEST 1234 5698 7654 33", {}),
    ("4041894974608795 53.118.65.158 +1 (906) 555-7738", {"card": 1, "ip": 1, "phone": 1}), ("abc4041894974608795", {}),
    ("Article 3.14 of 1000000 and 12-24", {}),
    ("2024 4111 1111 1111 1111", {"card": 1}), ("1234-5678-4111-1111-1111-1111", {"card": 1}), ("000-12-3456 4041894974608795", {"card": 1}),
    ("ES91 2100 0418 4502 0005 1332 BANK", {"iban": 1}), ("ES9121000418450200051332 EUR", {"iban": 1}),
    ("REF AB12 GB82 WEST 1234 5698 7654 32 PAID", {"iban": 1}), ("2024-01-15T10:30:00Z", {"date": 1}), ("2024-01-15Tx", {}),
]


@pytest.mark.parametrize("text,kinds", CASES)
def test_formats(text, kinds):
    found, again = {}, {}
    new = pii.pseudonymise(text, NAMES, found)
    assert found == kinds and len(new) == len(text)
    pii.pseudonymise(new, NAMES, again)
    assert again == kinds, "a pseudonym passes its own validation"
    assert re.sub("[0-9A-Za-z]", "", new) == re.sub("[0-9A-Za-z]", "", text)
    assert (new == text) == (not kinds)


def test_values_stay_linked_and_keys_differ():
    a = pii.pseudonymise("pay 4041894974608795", NAMES, {}).split()[-1]
    b = pii.pseudonymise("x\n4041 8949 7460 8795!", NAMES, {}).strip("x\n!").replace(" ", "")
    assert a == b and a not in pii.pseudonymise("4041894974608795", pii.Pseudonyms(b"other"), {})


def value(rng, kind):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "card":
        body = digits(15)
        return body + str(pii.luhn(body + "0"))
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "phone":
        return f"{rng.randint(200, 999)}-{digits(3)}-{digits(4)}"
    if kind == "ssn":
        return f"{rng.randint(100, 599)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    if kind == "date":
        return f"{rng.randint(1950, 2050)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    if kind == "email":
        return f"u{digits(3)}.{rng.choice('abc')}@mail{digits(1)}.example.org"
    return rng.choice(["word", "12", "3.14", "4041894974608796", "300.1.1.1", "2023-02-29", "000-12-3456", "x@y", "v1.2", "1776-07-04"])


def test_a_text_is_the_sum_of_its_values():
    """The plain version: a text that is put together from known values is replaced value by value."""
    rng, kinds = random.Random(4), ["card", "ip", "phone", "ssn", "date", "email", None]
    for _ in range(60):
        chosen = [rng.choice(kinds) for _ in range(rng.randint(1, 40))]
        parts = [value(rng, k) for k in chosen]
        gaps = [rng.choice([" ; ", "\n", ", and ", " <", "> "]) for _ in parts]
        new = [getattr(NAMES, k)(p) if k else p for k, p in zip(chosen, parts)]
        found = {}
        assert pii.pseudonymise("".join(map("".join, zip(parts, gaps))), NAMES, found) == "".join(map("".join, zip(new, gaps)))
        assert found == dict(Counter(k for k in chosen if k))


@pytest.mark.parametrize("kind,gap", [("email", "\n"), ("ip", " ")])
def test_time_grows_with_the_length(kind, gap):
    rng, spent = random.Random(8), []
    for n in (4_000, 32_000):
        text = gap.join(value(rng, kind) for _ in range(n))
        start, found = time.time(), {}
        pii.pseudonymise(text, pii.Pseudonyms(b"key"), found)
        spent.append(time.time() - start)
        assert found == {kind: n}
    assert spent[1] < 20 * max(spent[0], 0.05)


def test_table(spark):
    rows = awkward_docs() + [(70, "mail a1@b.example.com", None, "s", 3)] * 2
    docs = clashing(frame(spark, rows), "n_email", "n_card")
    out = pii.replace_personal_data(docs, b"key")
    assert out.columns == docs.columns and out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    plain = lambda d: sorted(str((r.doc_id, r.text)) for r in d.collect() if r.doc_id != 70)
    assert plain(out) == plain(docs)
    digest = pii.digest(docs, b"key").collect()
    assert sorted(r.n_email for r in digest)[-3:] == [0, 1, 1]
    assert pii.digest(frame(spark, []), b"key").count() == 0
