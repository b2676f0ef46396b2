from __future__ import annotations

import datetime as dt
import ipaddress
import re

import pytest

from colloquy.llm.pseudonyms import Permutation, Pseudonyms, iban_digits, luhn_digit, pseudonymise

KEY = b"test"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 1000, 5003])
def test_permutation_without_fixed_points(n):
    p = Permutation(KEY, "kind", n)
    out = [p(k) for k in range(n)]
    assert sorted(out) == list(range(n)) and (n < 2 or all(a != b for a, b in enumerate(out)))


def replaced(text):
    return Pseudonyms(KEY).replaced(text)[0]


def test_formats_and_links():
    a, b = replaced("pay 4845168114407329 now"), replaced("or 4845 1681 1440 7329.")
    digits = re.search("[0-9]{16}", a)[0]
    assert digits != "4845168114407329" and luhn_digit(digits[:-1]) == digits[-1]
    assert re.sub("[^0-9]", "", b) == digits and re.fullmatch(r"or (\d{4} ){3}\d{4}\.", b)
    account = re.search("[0-9]{16}", replaced("9807915762804490!!"))[0]
    assert luhn_digit(account[:-1]) != account[-1]
    iban = re.search("DE[0-9]{20}", replaced("DE89370400440532013000"))[0]
    assert iban != "DE89370400440532013000" and iban_digits("DE", iban[4:]) == iban[2:4]
    assert re.fullmatch(r"Mr\.[a-z]{2}\.[0-9]{2}@x\.org".replace("Mr", "[A-Z][a-z]"), replaced("Mr.nt.26@x.org"))
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} \d+\.\d+\.\d+\.\d+ x", replaced("+1 (826) 555-4081 190.137.223.204 x"))
    assert re.fullmatch("[0-9A-F]{40}", replaced("9233A8ECF7C5B09FE5949719B6B82BC439E9329B"))


def test_values_beside_letters_and_rejected_matches():
    day = replaced("2024-03-05")
    assert replaced("at 2024-03-05T10:00:00Z.") == f"at {day}T10:00:00Z." and day != "2024-03-05"
    assert replaced("05.03.2024T10:00") == f"{dt.date.fromisoformat(day):%d.%m.%Y}T10:00"
    for value in ("BE68 5390 0754 7034", "NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"):
        new = replaced(value)
        assert new != value and iban_digits(new[:2], new[4:].replace(" ", "")) == new[2:4]
        for before, after in (("", " BIC GEBABEBB"), ("", " SWIFT KREDBEBB"), ("AB13 ", " AND MORE"), ("XX00 1234 5678 ", "."), ("", " CH93 0076 2011 6238 5295 7")):
            assert replaced(before + value + after).startswith(before + new + after[:3])
    assert "CH93 0076" not in replaced("BE68 5390 0754 7034 CH93 0076 2011 6238 5295 7")
    secret = replaced("AB12" * 8)
    assert re.fullmatch("[0-9A-F]{32}", secret) and secret != "AB12" * 8
    for card in ("3782 822463 10005", "3714-496353-98431", "3056 930902 5904"):
        new, digits = replaced(f"card {card}, x"), re.sub("[^0-9]", "", card)
        found = re.sub("[^0-9]", "", new)
        assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", f"card {card}, x")
        assert found != digits and found == replaced(digits) and luhn_digit(found[:-1]) == found[-1]


def test_dates_are_one_value_in_all_formats():
    iso = replaced("1985-03-12")
    day = dt.date.fromisoformat(iso)
    assert day != dt.date(1985, 3, 12)
    assert replaced("12.03.1985") == f"{day:%d.%m.%Y}"
    assert replaced("12 March 1985") == f"{day.day} {day:%B} {day.year}"
    assert replaced("MARCH 12, 1985") == f"{day:%B} {day.day}, {day.year}".replace(f"{day:%B}", f"{day:%B}".upper())


def test_dates_map_one_to_one_in_all_formats():
    first = dt.date(1960, 1, 1)
    days = [first + dt.timedelta(days=k) for k in range(0, 25_000, 3)]
    by_day = {}
    for pattern in ("{d:02}/{m:02}/{y}", "{m:02}/{d:02}/{y}", "{y}-{m:02}-{d:02}", "{d}.{m}.{y}"):
        back = {}
        for day in days:
            if pattern.startswith("{m") and day.day <= 12:
                continue  # reads day first
            new = replaced(pattern.format(d=day.day, m=day.month, y=day.year))
            numbers = list(map(int, re.findall("[0-9]+", new)))
            y, m, d = numbers if pattern.startswith("{y") else (numbers[2], numbers[0], numbers[1]) if pattern.startswith("{m") else numbers[::-1]
            found = dt.date(y, m, d)
            assert found != day and back.setdefault(new, day) == day
            assert by_day.setdefault(day, found) == found
    assert len(set(by_day.values())) == len(by_day)


@pytest.mark.parametrize("text", ["12 Mar 2024", "5th March 2024", "Mar. 12th, 2024", "1st of May 2001", "SEPT 3 1999", "tel 4155550123", "Phone: 04155550123"])
def test_more_spellings(text):
    new = replaced(text)
    assert new != text and re.sub("[0-9]+|[A-Za-z]+", "x", new) == re.sub("[0-9]+|[A-Za-z]+", "x", text)


def test_short_months_and_ordinals_agree_with_iso_dates():
    day = dt.date.fromisoformat(replaced("2024-03-05"))
    assert replaced("5 Mar 2024") == f"{day.day} {day:%b} {day.year}"
    ending = "th" if 10 < day.day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(day.day % 10, "th")
    assert replaced("5th March 2024") == f"{day.day}{ending} {day:%B} {day.year}"


def test_telephone_numbers_are_linked_however_they_are_spaced():
    spellings = ("+1 415 555 0123", "+14155550123", "+1 (415) 555-0123", "(415) 555-0123", "415-555-0123", "tel. 4155550123")
    found = {re.sub("[^0-9]", "", replaced(x))[-10:] for x in spellings}
    assert len(found) == 1 and found != {"4155550123"}
    assert replaced("+49 30 901820")[:4] == "+49 " and replaced("+4930901820")[:3] == "+49"
    assert re.sub("[^0-9]", "", replaced("+35312345678")) == re.sub("[^0-9]", "", replaced("+353 1 234 5678"))


@pytest.mark.parametrize("local", ["жанна", "_", "Ω.αβ", "李", "ß", "a", "é", "._-", "Łukasz", "x1"])
def test_no_address_stays(local):
    new = replaced(f"{local}@example.com")
    assert new.endswith("@example.com") and new != f"{local}@example.com" and len(new) == len(local) + 12
    assert [c.isupper() for c in new] == [c.isupper() for c in f"{local}@example.com"]
    assert replaced("ann@пример.рф") != "ann@пример.рф"


def test_local_parts_map_one_to_one():
    letters = "абвгё12.xΩ"
    names = {a + b for a in letters for b in letters}
    assert len({replaced(f"{x}@example.com") for x in names}) == len(names)


def test_lower_case_ibans_and_ipv6():
    new = replaced("de89370400440532013000")
    assert new == new.lower() and new != "de89370400440532013000" and iban_digits("DE", new[4:].upper()) == new[2:4]
    assert new.upper() == replaced("DE89370400440532013000")
    for address in ("2001:db8::8a2e:370:7334", "2001:0db8:0000:0000:0000:8a2e:0370:7334", "FE80::1"):
        assert ipaddress.IPv6Address(replaced(f"at {address},")[3:-1]) != ipaddress.IPv6Address(address)
    assert replaced("2001:db8::1") == replaced("2001:0db8:0:0:0:0:0:1")
    assert replaced("::1 at 10:30:45") == "::1 at 10:30:45"


@pytest.mark.parametrize(
    "text",
    ["", "version 3.0, 2001-13-45", "1999 pages", "12345678", "127.0.0.1", "300.1.1.1", "DE00370400440532013000x", "000-12-3456", "a@b", "CC BY-NC 4.0.", "deadbeef"],
)
def test_what_is_not_valid_stays(text):
    assert replaced(text) == text


def test_rows(documents):
    mail = "write to ann.27@mail.example.com or +1 (017) 555-7713"
    rows = [(1, mail), (1, mail), (2, mail.upper()), (3, None), (4, ""), (None, "no values"), (6, (mail + " ") * 5_000)]
    frame = documents(rows)
    out = pseudonymise(frame, KEY, n_values="found")
    assert out.columns == [*frame.columns, "found"]
    found = out.select("doc_id", "text", "found").collect()
    by = {x.doc_id: x for x in found}
    assert by[1].found == 2 and "ann.27" not in by[1].text and by[1].text != mail
    assert by[2].text == by[1].text.upper() and by[6].text == (by[1].text + " ") * 5_000
    assert (by[3].text, by[3].found, by[4].text, by[None].text) == (None, 0, "", "no values")
    assert pseudonymise(frame.limit(0), KEY).count() == 0
    named = frame.withColumnRenamed("kept", "n_values")
    assert pseudonymise(named, KEY).columns == [*named.columns, "n_values_"]
