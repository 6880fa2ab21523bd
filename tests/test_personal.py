"""Spans of personal data: right check digits only, overlaps masked once."""

import numpy as np
import pytest

from loomwork.operators import personal as P


def inn(n, length):
    """A right number, by the published rule."""
    d = [int(c) for c in f"{n:0{length - (1 if length == 10 else 2)}d}"]
    for w in [[2, 4, 10, 3, 5, 9, 4, 6, 8]] if length == 10 else [[7, 2, 4, 10, 3, 5, 9, 4, 6, 8], [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]]:
        d.append(sum(a * b for a, b in zip(d, w, strict=True)) % 11 % 10)
    return "".join(map(str, d))


@pytest.mark.parametrize("seed", range(5))
def test_check_digits(seed):
    n = int(np.random.default_rng(seed).integers(10**8, 10**9))
    for right in (inn(n, 10), inn(n * 7, 12)):
        assert P.inn_is_right(right)
        assert not any(P.inn_is_right(right[:-1] + c) for c in "0123456789" if c != right[-1])


def test_known_numbers():
    assert P.inn_is_right("7707083893") and P.inn_is_right("500100732259") and not P.inn_is_right("7707083894") and not P.inn_is_right("12345")
    assert P.snils_is_right("11223344595") and not P.snils_is_right("11223344596") and not P.snils_is_right("112233445")


@pytest.mark.parametrize("text, masked, kinds", [
    ("Телефон: +7 999 123-45-67, паспорт: 12 34 567890.", "Телефон: ***, паспорт: ***.", ["passport_ru", "phone_number_ru"]),
    ("Серия и номер: 12 34 567890", "Серия и номер: ***", ["passport_ru"]), ("ИНН 7707083893 и 7707083894", "ИНН *** и 7707083894", ["inn_ru"]), ("СНИЛС 112-233-445 95, 112-233-445 96", "СНИЛС ***, 112-233-445 96", ["snils_ru"]),
    ("полис 1234567890123456", "полис ***", ["oms_ru"]), ("a.b@c.de,x@y.org", "***,***", ["email"]), ("8 (495) 123 45 67", "***", ["phone_number_ru"]), ("", "", []), ("18 номеров 123456789", "18 номеров 123456789", []),
    ("mail 7707083893@bank.ru now", "mail *** now", ["email", "inn_ru"]), ("89161234567", "***", ["phone_number_ru"]),
])
def test_masks(text, masked, kinds):
    found = list(P.spans(text))
    assert P.mask(text, found) == masked and sorted({k for _, _, k in found}) == kinds


@pytest.mark.parametrize("seed", range(20))
def test_union_covers_what_is_covered(seed):
    rng = np.random.default_rng(seed)
    found = [(int(a), int(a + rng.integers(1, 9)), "k") for a in rng.integers(0, 60, rng.integers(0, 12))]
    one = P.united(found)
    cover = lambda spans: {i for a, b, _ in spans for i in range(a, b)}
    assert cover(one) == cover(found) and all(x[1] < y[0] for x, y in zip(one, one[1:], strict=False))
    text = "".join(chr(0x430 + i % 30) for i in range(70))
    left = P.mask(text, found, "#")
    assert left.replace("#", "") == "".join(c for i, c in enumerate(text) if i not in cover(found)) and left.count("#") == len(one)


def test_rows_reasons_and_gate(spark):
    rows = [(1, "ИНН 7707083893, a@b.cd", "x"), (2, None, "x"), (3, "nothing", "x"), (3, "me@b.cd", "x"), (None, "12 34 567890", "x"), (4, "word " * 100_000 + "me@b.cd", "x")]
    out = P.gate(P.personal_data(spark.createDataFrame(rows, "id long, t string, spans string"), "id", "t"), "output", ["russian_pii"])
    got = sorted(((r["id"], r["verdict"], r["tripwires"], r["masked"] if r["id"] != 4 else r["masked"][-4:]) for r in out.collect()), key=repr)
    assert got == sorted([(1, "block", ["output:inn_ru", "output:email", "output:russian_pii"], "ИНН ***, ***"), (2, "pass", [], None), (3, "pass", [], "nothing"), (3, "mask", ["output:email"], "***"), (None, "block", ["output:passport_ru", "output:russian_pii"], "***"), (4, "mask", ["output:email"], " ***")], key=repr)
