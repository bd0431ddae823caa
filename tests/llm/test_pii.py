import datetime
import hashlib
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import empty, odd
from condensa.llm import pii as P

KEY = b"k"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations(n):
    assert sorted(P.permute(x, n, KEY, "t") for x in range(n)) == list(range(n))


@given(st.integers(0, 10**15 - 1))
@settings(max_examples=100, deadline=None)
def test_cards_stay_valid_and_apart(x):
    body = f"4{x:015d}"[:15]
    new = P.card(body + P.luhn_digit(body), KEY)
    assert len(new) == 16 and new[0] == "4" and P.luhn_digit(new[:-1]) == new[-1]


def test_only_valid_values_change():
    assert P.card("4111 1111 1111 1111", KEY) and P.card("4111 1111 1111 1112", KEY) is None
    assert P.iban("DE89 3704 0044 0532 0130 00", KEY) and P.iban("DE88 3704 0044 0532 0130 00", KEY) is None
    assert P.ip("1.2.3.256", KEY) is None and P.date("31.02.2020", KEY) is None and P.ssn("000-12-3456", KEY) is None


@pytest.mark.parametrize("kind,value,shape", [
    (P.card, "4111-1111-1111-1111", r"4\d{3}-\d{4}-\d{4}-\d{4}"), (P.iban, "DE89 3704 0044 0532 0130 00", r"DE\d\d( \d{4}){4} \d\d"), (P.ip, "192.168.1.10", r"\d{3}\.\d{3}\.\d\.\d\d"),
    (P.ssn, "123-45-6789", r"\d{3}-\d\d-\d{4}"), (P.date, "2020-02-29", r"20\d\d-\d\d-\d\d"), (P.date, "03.04.1999", r"\d\d\.\d\d\.19\d\d"), (P.email, "ann.lee@mail.example", r"[a-z]{3}\.[a-z]{3}@mail\.example"),
    (P.phone, "+1 (212) 555-0100", r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}"), (P.secret, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", r"[0-9a-f]{40}"),
])
def test_formats_and_links(kind, value, shape):
    new = kind(value, KEY)
    assert new != value and re.fullmatch(shape, new)
    assert kind(value, KEY) == new != kind(value, b"another key")


@pytest.mark.parametrize("value", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"])
@pytest.mark.parametrize("after", ["", " BIC: COBADEFF", " BIC COBADEFFXXX", " 2 mal", " 12345678", " 2020 AND MORE WORDS IN CAPITALS", " Please", ", 7", "\nBIC", " DE89370400440532013000"])
@pytest.mark.parametrize("before", ["IBAN ", "REF AB12 "])
def test_ibans_end_before_what_follows(before, value, after):
    out, n = P.pseudonymise_text(before + value + after, KEY)
    new = P.iban(value, KEY)
    assert new != value and out.startswith(before + new) and n == 1 + ("DE89" in after)
    assert "DE89" in after or out == before + new + after


def test_pseudonyms_of_different_values_differ():
    days = [f"19{y:02d}-{m:02d}-11" for y in range(100) for m in range(1, 13)]
    assert len({P.date(d, KEY) for d in days}) == len(days)
    ips = [f"10.0.{i}.{j}" for i in range(10) for j in range(10)]
    assert len({P.ip(x, KEY) for x in ips}) == len(ips)


def test_equal_values_stay_linked_across_documents(spark):
    rows = [(1, "mail ann@site.org now"), (2, "from ann@site.org, 4111111111111111"), (3, "no value"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in P.pseudonyms(df, key="k").collect()}
    one = re.search(r"\S+@\S+", out[1].text)[0]
    assert one != "ann@site.org" and one + "," in out[2].text
    assert (out[1].n_values, out[2].n_values, out[3].n_values, out[4].n_values) == (1, 2, 0, 0)
    assert out[3].text == "no value" and out[4].text is None


def feistel_by_hand(x, n, key, tweak):
    bits = (n - 1).bit_length()
    half = max(1, (bits + 1) // 2)
    while True:
        word = f"{x:0{2 * half}b}"
        left, right = int(word[:half], 2), int(word[half:], 2)
        for r in range(8):
            size = -(-half // 8)
            f = int.from_bytes(hashlib.shake_256(b"\0".join([key, tweak.encode(), str(n).encode(), bytes([r]) + right.to_bytes(size, "big")])).digest(size), "big")
            left, right = right, left ^ f % (1 << half)
        x = left * (1 << half) + right
        if x < n:
            return x


def among(sets, chosen, key, tweak):
    """The chosen tuple's place in the product of the sets, permuted."""
    x, n = 0, 1
    for s, c in zip(sets, chosen):
        x, n = x * len(s) + s.index(c), n * len(s)
    x, out = feistel_by_hand(x, n, key, tweak), []
    for s in reversed(sets):
        out.insert(0, s[x % len(s)])
        x //= len(s)
    return out


def luhn_holds(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def by_hand(kind, v):
    if kind == "date":
        days = [datetime.date(2000, 1, 1) + datetime.timedelta(k) for k in range(36525)]
        return str(among([days], [datetime.date.fromisoformat(v)], KEY, "dateymd-")[0])
    if kind == "ssn":
        sets = [[a for a in range(1, 900) if a != 666], list(range(1, 100)), list(range(1, 10000))]
        return "%03d-%02d-%04d" % tuple(among(sets, [int(x) for x in v.split("-")], KEY, "ssn"))
    if kind == "ip":
        sets = [[str(x) for x in range(256) if len(str(x)) == len(p)] for p in v.split(".")]
        return ".".join(among(sets, v.split("."), KEY, "ip"))
    if kind == "card":
        middle = among([range(10 ** (len(v) - 2))], [int(v[1:-1])], KEY, "card" + v[0])[0]
        return next(d for c in range(10) if luhn_holds(d := f"{v[0]}{middle:0{len(v) - 2}d}{c}"))
    local, domain = v.split("@")
    return "".join(among(["abcdefghijklmnopqrstuvwxyz"] * len(local), local, KEY, "mail" + domain + "." * len(local))) + "@" + domain


def test_against_values_by_hand(spark):
    """Texts are put together from values whose places are known, valid and not, with words between."""
    rng, docs, want = random.Random(5), [], []
    for i in range(60):
        text, new, n = [], [], 0
        for _ in range(rng.randint(0, 8)):
            kind = rng.choice(["date", "ssn", "ip", "card", "mail", "word", "no card", "no date", "no ip", "no ssn"])
            body = str(rng.randint(3, 5)) + "".join(rng.choices("0123456789", k=14))
            v = {
                "date": f"20{rng.randint(0, 99):02d}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", "no date": "2023-02-30",
                "ssn": f"{rng.choice([1, 899, 665, 667, rng.randint(1, 600)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", "no ssn": "666-12-1234",
                "ip": ".".join(str(rng.randint(0, 255)) for _ in range(4)), "no ip": "300.1.2.3", "mail": "".join(rng.choices("abcxyz", k=rng.randint(1, 40))) + "@site.example", "word": "plain",
                "card": next(d for c in range(10) if luhn_holds(d := f"{body}{c}")), "no card": next(d for c in range(10) if not luhn_holds(d := f"{body}{c}")),
            }[kind]
            text.append(v)
            changes = kind in ("date", "ssn", "ip", "card", "mail")
            new.append(by_hand(kind, v) if changes else v)
            n += changes
        docs.append((i, " and ".join(text)))
        want.append((i, " and ".join(new), n))
    got = P.pseudonyms(spark.createDataFrame(docs, "doc_id long, text string"), key=KEY.decode()).collect()
    assert sorted(map(tuple, got)) == want
    assert sorted(map(tuple, P.pseudonymise(spark.createDataFrame(docs, "doc_id long, text string"), key=KEY.decode()).collect())) == [r[:2] for r in want]


@pytest.mark.parametrize("mail", ["\u0438\u0432\u0430\u043d@\u043f\u043e\u0447\u0442\u0430.com", "\u738b@site.cn", "\u05d0\u05d1\u05d2.x@site.il", "\u03b1\u03b2@b.gr", "\uae40@b.kr"])
def test_letters_of_every_script(mail):
    out, n = P.pseudonymise_text(f"to {mail} now", KEY)
    local, new = mail.split("@")[0], out[3:-4].split("@")[0]
    assert n == 1 and new != local and len(new) == len(local) and out.endswith("@" + mail.split("@")[1] + " now")
    assert [unicodedata.category(c) for c in new] == [unicodedata.category(c) for c in local]


@pytest.mark.parametrize("size", [1, 63, 64, 65, 70, 130, 1000])
def test_long_local_parts_change_whole(size):
    local = "".join(random.Random(size).choices("abcdefgh", k=size))
    out, n = P.pseudonymise_text(f"x {local}@site.org y", KEY)
    new = out[2:].split("@")[0]
    assert n == 1 and len(new) == size and all(new[a : a + 30] != local[a : a + 30] for a in range(0, size, 30) if a + 8 < size or size < 8)
    assert P.pseudonymise_text(f"{local}@site.org", KEY)[0] == f"{new}@site.org"


def test_what_has_no_letter_is_not_counted():
    assert P.pseudonymise_text("_@site.org and %%@site.org", KEY) == ("_@site.org and %%@site.org", 0)


def test_a_key_is_needed(spark):
    df = spark.createDataFrame([(1, "ann@site.org")], "doc_id long, text string")
    for make in (P.pseudonyms, P.pseudonymise):
        with pytest.raises(ValueError, match="key"):
            make(df)
    assert P.job_key(spark) != P.job_key(spark)
    spark.conf.set(P.KEY_SETTING, "k")
    try:
        assert P.job_key(spark) == "k" and P.pseudonyms(df).first().text == P.pseudonyms(df, key="k").first().text
    finally:
        spark.conf.unset(P.KEY_SETTING)


def test_odd_rows(spark):
    df = odd(spark)
    out = P.pseudonymise(df, key="k")
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert P.pseudonyms(df, key="k").count() == df.count()
    assert P.pseudonyms(empty(spark), key="k").collect() == [] and P.pseudonymise(empty(spark), key="k").collect() == []


def test_long_texts_in_time(spark):
    text = "a" * 300_000 + "@" + "1." * 100_000 + "4" * 100_000 + " " + "b" * 100_000 + "@site.org"
    out = P.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), key="k").first().text
    assert len(out) == len(text) and "b" * 30 not in out
