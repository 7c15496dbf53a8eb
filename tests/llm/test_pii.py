import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweave.llm import pii

P = pii.Pseudonyms(b"long key")
TEXT = "Call +1 (017) 555-7713 or und.34@mail7.example.com, card 4539 1488 0343 6467, not 4539148803436468; IBAN DE89 3704 0044 0532 0130 00, 123-45-6789, born 1979-02-28 or 28.02.1979, at 129.38.82.176, not 300.1.1.1 or 2020-13-41 or v1.2.3.4.5"


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 10**12), st.data())
def test_permutes(n, data):
    x = data.draw(st.integers(0, n - 1))
    y = P.feistel.move(x, n, b"t")
    assert 0 <= y < n and P.feistel.move(y, n, b"t", back=True) == x


def test_is_a_permutation():
    for n in (1, 2, 7, 100, 1001):
        assert sorted(P.feistel.move(i, n, b"t") for i in range(n)) == list(range(n))


def test_formats_and_links():
    counts = pii.Counter()
    out = P.replace(TEXT, counts)
    assert dict(counts) == {"phone": 1, "email": 1, "card": 1, "iban": 1, "ssn": 1, "date": 2, "ip": 1}
    for part in ("017", "und.34", "1488 0343", "3704", "123-45", "1979-02-28", "28.02.1979", "129.38.82.176"):
        assert part not in out
    for part in ("+1 (", "4539148803436468", "300.1.1.1", "2020-13-41", "v1.2.3.4.5", "IBAN DE"):
        assert part in out
    iso, dotted = out[out.index("born ") + 5 :].split(",")[0].split(" or ")
    assert datetime.date.fromisoformat(iso) == datetime.datetime.strptime(dotted, "%d.%m.%Y").date()
    assert P.replace(out, back=True) == TEXT and P.replace(TEXT) == out
    assert pii.Pseudonyms(b"other").replace(TEXT) != out


def test_checks_hold():
    card = P.card("4539148803436467")
    assert card[0] == "4" and pii.luhn(card[:-1]) == int(card[-1]) and P.card(card, back=True) == "4539148803436467"
    iban = P.iban("DE89370400440532013000")
    assert iban[:2] == "DE" and pii._mod97(iban[4:] + iban[:4]) == 1 and P.iban(iban, back=True) == "DE89370400440532013000"


def test_rows(spark):
    rows = [(1, TEXT, 0), (2, None, 0), (3, "", 0), (None, "no data", 0), (1, TEXT, 0), (4, "a " * 60_000 + "10.0.0.1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    got = sorted(((r.doc_id, r.text, r.n_email, r.n_ip) for r in pii.pseudonymise(docs, b"long key").collect()), key=str)
    want = sorted(((k, t and P.replace(t), int(t == TEXT), int(t == TEXT or k == 4)) for k, t, _ in rows), key=str)
    assert got == want
    assert pii.pseudonymise(docs.limit(0), b"long key").count() == 0


def test_iban_before_a_word():
    for iban in ("ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "PL61 1090 1014 0000 0712 1981 2874"):
        for after in ("", " OK", " 2024", " 2024 MORE", " 1979-02-28", " 129.38.82.176"):
            text = f"to {iban}{after}"
            counts = pii.Counter()
            out = P.replace(text, counts)
            assert counts["iban"] == 1 and iban not in out and out[:5] == text[:5]
            assert counts["date"] == (after == " 1979-02-28") and counts["ip"] == (after == " 129.38.82.176")


def test_spellings_of_a_value_are_linked():
    same = lambda *texts: len({"".join(c for c in P.replace(t).lower() if c.isalnum() or c in "@.") .removeprefix("1") if "@" not in t else P.replace(t).lower() for t in texts}) == 1
    assert same("+442079460018", "+44 2079460018", "+44 20 7946 0018", "+44-20-7946-0018")
    assert same("John@X.com", "john@x.com", "JOHN@x.COM")
    assert same("(212) 555-0147", "212-555-0147", "+1 212 555 0147", "+12125550147")
    for text in ("+442079460018", "+44 20 7946 0018", "+12125550147", "+351 912 345 678", "John@X.com"):
        out = P.replace(text)
        assert out != text and P.replace(out, back=True) == text
        assert out[:3] == text[:3] if text[0] == "+" and text[1] != "1" else True


VALUES = {
    "email": ["jane.roe@mail.example.org", "a1@b-2.co"], "card": ["4539148803436467", "4539 1488 0343 6467"], "iban": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19"], "ssn": ["123-45-6789"],
    "phone": ["+442079460018", "(212) 555-0147", "212.555.0147"], "ip": ["10.0.0.1", "192.168.255.7"], "date": ["1979-02-28", "28.02.1979", "12/31/1999"],
}
PLAIN = ["word", "4539148803436468", "300.1.1.1", "2020-13-41", "000-12-3456", "DE88370400440532013000", "v1.2.3.4.5", "é", "x@y", "12:30", "3.14"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([(k, v) for k, vs in VALUES.items() for v in vs]), st.sampled_from([(None, x) for x in PLAIN])), max_size=12), st.sampled_from([", ", "; ", "\n| ", " \u00e9, "]))
def test_against_planted_values(parts, between):
    """Brute force: what is planted is known, so the text that must come out can be put together part by part."""
    counts = pii.Counter()
    out = P.replace(between.join(v for _, v in parts), counts)
    assert out == between.join(v if k is None else getattr(P, k)(v) for k, v in parts)
    assert counts == pii.Counter(k for k, _ in parts if k)
    assert P.replace(out, back=True) == between.join(v for _, v in parts)


def test_a_key_is_needed(spark):
    import pytest

    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, b"short")
