import hashlib
import re
from datetime import date, timedelta

from fathomdoc.llm import pseudonyms

KEY = "k"


def plain_permute(values, sizes, kind, tweak=None):
    values = list(values)
    for r in range(pseudonyms.ROUNDS):
        seen = ",".join(str(x) for i, x in enumerate(values) if i % 2 != r % 2)
        seen = seen if tweak is None else f"{tweak}#{seen}"
        for i, size in enumerate(sizes):
            if i % 2 == r % 2 and size > 1:
                drawn = hashlib.sha256("|".join([KEY, kind, str(r), str(i), seen]).encode()).hexdigest()[:12]
                values[i] = (values[i] + int(drawn, 16)) % size
    return values


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def plain_date(y, m, d):
    """The date that this one becomes; the network is applied until there is one."""
    months, days = (range(1, 10), range(10, 13)), (range(1, 10), range(10, 13), range(13, 32))
    years = list(range(1900, 2100)) if 1900 <= y < 2100 else [*range(1, 1900), *range(2100, 10_000)]
    classes = [years, next(r for r in months if m in r), next(r for r in days if d in r)]
    sizes, state = [len(c) for c in classes], [list(c).index(v) for c, v in zip(classes, (y, m, d))]
    while True:
        state = plain_permute(state, sizes, "date", ",".join(map(str, sizes)))
        try:
            return date(*[c[i] for c, i in zip(classes, state)])
        except ValueError:
            pass


def changed(spark, *texts):
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    return [r for r in sorted(pseudonyms.pseudonymise(frame, KEY).collect(), key=lambda r: r.doc_id)]


def test_against_a_plain_network(spark):
    rows = changed(spark, "pay 4111 1111 1111 1111.", "host 97.51.17.173,", "on 2024-02-29;", "call +1 (017) 555-7713%%%", "id 123-45-6789")
    body = plain_permute([4] + [1] * 14, [10] * 15, "card")
    check = next(c for c in range(10) if luhn("".join(map(str, body)) + str(c)) % 10 == 0)
    card = "".join(map(str, [*body, check]))
    assert rows[0].text == "pay " + " ".join(card[i : i + 4] for i in range(0, 16, 4)) + "."
    assert rows[1].text == "host " + ".".join(map(str, plain_permute([97, 51, 17, 173], [256] * 4, "ip"))) + ","
    assert rows[2].text == f"on {plain_date(2024, 2, 29)};"
    phone = "".join(map(str, plain_permute([0, 1, 7, 5, 5, 5, 7, 7, 1, 3], [10] * 10, "phone", "")))
    assert rows[3].text == f"call +1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}%%%"
    area, group, serial = plain_permute([122, 44, 6788], [898, 99, 9999], "ssn")
    area += 1 + (area + 1 >= 666)
    assert rows[4].text == f"id {area:03}-{group + 1:02}-{serial + 1:04}"


def test_equal_values_stay_linked(spark):
    rows = changed(spark, "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1111", "una.34@mail7.example.com UNA.34@Mail7.Example.COM",
                   "+1 (017) 555-7713 (017) 555-7713 +10175557713", "1999-12-31 31/12/1999 31.12.1999 12/31/1999",
                   "DE89370400440532013000 DE89 3704 0044 0532 0130 00")
    found = [[v.pseudonym for v in r["values"]] for r in rows]
    assert len({re.sub(r"\D", "", v) for v in found[0]}) == 1 and luhn(re.sub(r"\D", "", found[0][0])) % 10 == 0
    assert found[1][0] == found[1][1].lower() and found[1][0].endswith(".com") and found[1][0] != "una.34@mail7.example.com"
    assert len({re.sub(r"\D", "", v)[-10:] for v in found[2]}) == 1 and len(found[2]) == 3
    y, m, d = found[3][0].split("-")
    assert found[3][1:] == [f"{d}/{m}/{y}", f"{d}.{m}.{y}", f"{m}/{d}/{y}"]
    whole = found[4][0]
    assert found[4][1].replace(" ", "") == whole and whole[:2] == "DE"
    assert int("".join(str(int(c, 36)) for c in whole[4:] + whole[:4])) % 97 == 1


def test_different_values_stay_different(spark):
    text = " ".join(f"10.0.{i % 256}.{i // 256}" for i in range(2000)) + " " + " ".join(
        str(date(1950, 1, 1) + timedelta(days=i)) for i in range(2000))
    row = changed(spark, text)[0]
    ips, dates = ([v.pseudonym for v in row["values"] if v.kind == kind] for kind in ("ip", "date"))
    assert len(set(ips)) == len(set(dates)) == 2000 and all(max(map(int, x.split("."))) < 256 for x in ips)
    assert all(1900 <= date.fromisoformat(x).year < 2100 for x in dates)


def test_dates_of_all_forms_and_years(spark):
    days = [date(y, m, d) for y in (1, 1582, 1899, 1900, 2000, 2024, 2099, 2100, 9999) for m, d in
            ((1, 1), (2, 28), (3, 9), (4, 30), (9, 10), (10, 12), (10, 13), (11, 30), (12, 31))] + [date(2024, 2, 29), date(1600, 2, 29)]
    days += [date(2000, 1, 1) + timedelta(days=i) for i in range(1500)]
    text = " ".join(f"{x.isoformat()} {x.day}.{x.month}.{x.year:04} {x.month}/{x.day}/{x.year:04}" for x in days)
    words, row = text.split(" "), changed(spark, text)[0]
    out = row.text.split(" ")
    expected = [plain_date(x.year, x.month, x.day) for x in days]
    assert len(row["values"]) == len(words) and out[::3] == [x.isoformat() for x in expected]
    assert out[1::3] == [f"{x.day}.{x.month}.{x.year:04}" for x in expected]
    assert out[2::3] == [f"{x.month}/{x.day}/{x.year:04}" for x in expected]
    assert all(re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) for a, b in zip(words, out))
    # A day above 12 stays above, so a date with the day in front is still read as one.
    assert all((a.day > 12) == (b.day > 12) for a, b in zip(days, expected)) and len(set(expected)) == len(set(days))


def test_long_addresses(spark):
    rest = [".".join(["b" * 60] * n) for n in (1, 5, 9, 30)]
    rows = changed(spark, *[f"to {'a' * 60}@{r}.example.org, or" for r in rest])
    for r, row in zip(rest, rows):
        value = row["values"][0].pseudonym
        assert row.text == f"to {value}, or" and len(value) == 60 + 1 + len(r) + 12 and value.endswith(".org")
        assert "a" * 8 not in value and "b" * 8 not in value and "example" not in value


def test_what_is_no_value_stays(spark):
    texts = [None, "", "no numbers", "9807915762804490 300.1.1.1 2023-02-29 31.02.2000 13/13/2000 666-12-1234 000-12-1234",
             'token = "e51a5499e3950eabef3742d6cf40b27b4e61a74a" v1.2.3.4.5 x4111111111111111 0000000000000000', "w" * 300_000,
             "1" * 50_000, "DE00370400440532013000 a@b 0000-01-01 1900-02-29"]
    rows = changed(spark, *texts)
    assert [r.text for r in rows] == texts and all(list(r["values"]) == [] for r in rows)


def test_long_texts_repeated_rows_and_nothing(spark):
    long = "abc 97.51.17.173\n" * 3000
    rows = changed(spark, long, long)
    assert rows[0].text == rows[1].text and len(rows[0]["values"]) == 3000 and "97.51" not in rows[0].text
    assert len(rows[0].text.split("\n")) == 3001
    assert pseudonyms.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0
    frame = spark.createDataFrame([(None, "a 97.51.17.173")], "doc_id long, text string")
    assert pseudonyms.pseudonymise(frame, KEY).first().text != pseudonyms.pseudonymise(frame, "other").first().text
