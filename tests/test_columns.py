"""Column expressions as tables: input columns, expected column."""

import hashlib

import pytest
from pyspark.sql import functions as F

from placelens.functions import headers, reviews, text, urls
from placelens.operators import runs

HEX = "0x1a2B:0xC3d4"
MAPS = "https://www.google.com/maps"


def test_location_kind(check):
    cases = [
        (f"{MAPS}/place/Some+Gym/@1.5,2.5,15z/data=!1s{HEX}", "long"),
        ("http://google.co.uk/maps/place/X", "long"),
        ("https://maps.app.goo.gl/abcDEF", "short"),
        (f"{MAPS}?cid=123", "cid"),
        (f"{MAPS}/?cid=123", "cid"),
        (f"{MAPS}?hl=en&cid=123", None),
        (f"{MAPS}?ftid={HEX}", "ftid"),
        (f"{MAPS}/?a=b&ftid={HEX}&z=1", "ftid"),
        (f"https://google.com.br/maps?ftid={HEX}#x", "ftid"),
        (f"{MAPS}?a=b#c&ftid={HEX}", None),
        (f"{MAPS}?noftid={HEX}", None),
        (f"{MAPS}?ftid=bad", "ftid"),
        ("ChIJ" + "a_-9" * 5, "place_id"),
        ("ChIJ" + "a" * 19, None),
        ("ChIJ" + "a" * 20 + "\n", None),
        (f"https://example.com/maps?ftid={HEX}", None),
        (HEX, None),
        ("ftp://google.com/maps/place/x", None),
        ("https://google.evil.example/maps/place/x", "long"),
        ("", None),
        (None, None),
    ]
    check(cases, lambda d: urls.location_kind(d.u), "u string")


def test_place_id_in_url(check):
    cases = [
        (f"{MAPS}?ftid={HEX}", HEX),
        (f"{MAPS}?ftid=0x1a2B%3A0xC3d4&hl=en", HEX),
        (f"{MAPS}/place/F/data=!1s0xaa:0xbb", "0xaa:0xbb"),
        (f"{MAPS}/place/F/data=!1s0xaa:0xbb?ftid=0xcc:0xdd", "0xcc:0xdd"),
        (MAPS, None),
        (f"{MAPS}?q=%zz&ftid=0x1%3A0x2", None),
        (f"{MAPS}?q=%FF&ftid=0x1%3A0x2", None),
        (f"{MAPS}?q=%FF&ftid=0x1:0x2", "0x1:0x2"),
        (f"{MAPS}?q=%EF%BF%BD&ftid=0x1%3A0x2", "0x1:0x2"),
        (f"{MAPS}?q=�&ftid=0x1%3A0x2", "0x1:0x2"),
        (None, None),
    ]
    check(cases, lambda d: urls.place_id_in_url(d.u), "u string")


def test_canonical_url(spark):
    cases = [
        (f"{MAPS}/place/T/@0,0,15z", f"{MAPS}/place/T/@0,0,15z?hl=en"),
        (f"{MAPS}?hl=en", f"{MAPS}?hl=en"),
        (f"{MAPS}?hl=de&x=1&hl=fr", f"{MAPS}?hl=en&x=1"),
        (f"{MAPS}?x=1&hl=de#top", f"{MAPS}?x=1&hl=en#top"),
        (f"{MAPS}?entry=ttu&g_ep=E%3D%3D&hl=en", f"{MAPS}?hl=en"),
        (f"{MAPS}?entry=ttu", f"{MAPS}?hl=en"),
        (f"{MAPS}?ftid={HEX}", f"{MAPS}?ftid=0x1a2B%3A0xC3d4&hl=en"),
        (f"{MAPS}?q=a+b%20c&k", f"{MAPS}?q=a+b+c&k=&hl=en"),
        (f"{MAPS}?q=100%&r=~*", f"{MAPS}?q=100%25&r=%7E*&hl=en"),
        (f"{MAPS}?q=%C3%A9%zz=1=2", f"{MAPS}?q=%C3%A9%25zz%3D1%3D2&hl=en"),
        ("HTTPS://Www.Google.com:443/maps", f"{MAPS}?hl=en"),
        ("http://google.com:8080", "http://google.com:8080/?hl=en"),
        (f"{MAPS}/place/Café x/", f"{MAPS}/place/Caf%C3%A9%20x/?hl=en"),
        (f"{MAPS}/place/😀", f"{MAPS}/place/%F0%9F%98%80?hl=en"),
        ("https://maps.app.goo.gl/abc?hl=de", "https://maps.app.goo.gl/abc?hl=de"),
        ("https://example.org/?u=maps.app.goo.gl", "https://example.org/?u=maps.app.goo.gl"),
        ("not-a-url", "not-a-url"),
        ("", ""),
        (None, None),
    ]
    df = spark.createDataFrame(cases, "u string, expected string")
    got = urls.canonical_urls(df, "u", "got").select("u", "got", "expected").collect()
    assert not [r for r in got if r.got != r.expected]


def test_place_ids_match(check):
    cases = [
        (None, None, "true"), ("", None, "true"), (None, "0x1:0x2", "true"),
        ("0x1:0x2", None, "false"), ("0x1:0x2", "", "false"),
        ("0xAB:0x2", "0xab:0X2", "true"), ("0x1:0x2", "0x1:0x3", "false"),
    ]
    check(cases, lambda d: urls.place_ids_match(d.e, d.a), "e string, a string")


def test_verifiable_place_id(check):
    cases = [("0x1:0x2", "true"), ("0XAB", "false"), ("ChIJabc", "false"), ("", "false"), (None, "false")]
    check(cases, lambda d: urls.is_verifiable_place_id(d.p), "p string")


def test_review_count(check):
    cases = [
        ("2,345 reviews", "2345"), ("2345 Reviews", "2345"), ("0 reviews", "0"), ("1 review", "1"),
        ("3 456 reviews", "3456"), ("3 456 reviews", "3456"), ("3 456 REVIEWS", "3456"),
        ("3 456 reviews", "3456"), ("(77) reviews", "77"), ("Reviews 88", "88"),
        ("Reviews\n9,000", "9000"), ("12 photos · 34 reviews", "34"), ("5 reviews Reviews 6", "5"),
        ("11,222,333 reviews!", "11222333"), ("2 reviewsé", "2"), ("2 reviewsx", None),
        ("2 reviews_", None), ("7 mb reviews", None), ("7 m reviews", None), ("7m, 8 reviews", None),
        ("2.1K reviews", None), ("4K reviews", None), ("Reviews (2.2m)", None), ("4.4 · 55 reviews", None),
        ("reviews", None), ("55", None), ("", None), (" \t\n", None), (None, None),
        ("99999999999999999999 reviews", None), ("Reviews123", None), ("5é reviews", "5"),
    ]
    check(cases, lambda d: headers.review_count(d.t), "t string")


def test_header_rating(check):
    cases = [
        ("3.7 stars", "3.7"), ("Rated 2,5 of 5", "2.5"), ("5", "5.0"), ("0", "0.0"), ("5.1", None),
        ("-1", None), ("-12", None), ("-1.5", "5.0"), ("11 stars", None), ("1.2.3", "1.2"),
        ("none", None), ("", None), (None, None),
    ]
    check(cases, lambda d: headers.header_rating(d.t), "t string")


def test_script_hint(check):
    cases = [
        ("مرحبا", "arabic"), ("hello there", "english"), ("ab مك", "mixed"), ("abc مك", "english"),
        ("地方 123", "unknown"), ("é", "unknown"), ("123", "unknown"), ("", None), (None, None),
    ]
    check(cases, lambda d: text.script_hint(d.t), "t string")


def test_trim(check):
    cases = [(" 　 a b ﻿ \n", "a b"), ("\v\fx", "x"), (" \t ", ""), (None, None)]
    check(cases, lambda d: text.trimmed(d.t), "t string")


def test_csv_cell(check):
    cases = [
        ("plain", "plain"), ("a, b", '"a, b"'), ('say "x"', '"say ""x"""'), ("l1\nl2", '"l1\nl2"'),
        ("a\rb", "a\rb"), ("=1+1", '"\t=1+1"'), ("+a", '"\t+a"'), ("-a", '"\t-a"'), ("@a", '"\t@a"'),
        ("a=b", "a=b"), ("a\tb", '"a\tb"'), ("x\n=1", '"x\n=1"'), ("", ""), (None, ""),
    ]
    check(cases, lambda d: text.csv_cell(d.t), "t string")


def test_file_slug(check):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()[:12]
    cases = [
        ("Bob's Big Gym", "bobs-big-gym"), ("Bob’s", "bob-s"), ("Crêpes & Co.", "cr-pes-co"),
        ("--a--b--", "a-b"), ("A_1 صالة", "a-1"), ("صالة", digest("صالة")), ("---", digest("---")),
    ]
    check(cases, lambda d: text.file_slug(d.t), "t string")


def test_masked(check):
    cases = [
        ("Bob: 1,234 reviews 4.5K", "B·b· 1,234 reviews ···K".replace("···K", "4.5K")),
        ("Zoë x😀", "··· ···"), ("a\tz\n", "·\t·\n"), ("", None), (None, None),
    ]
    check(cases, lambda d: text.masked(d.t), "t string")


def test_utf16_prefix(check):
    cases = [
        ("abcdef", "abcd"), ("ab", "ab"), ("😀😀😀", "😀😀"), ("a😀😀", "a😀�"), ("abc😀", "abc�"),
        ("abcd😀", "abcd"), ("", ""), (None, None),
    ]
    check(cases, lambda d: text.utf16_prefix(d.t, 4), "t string")


def test_card_rating(check):
    cases = [
        ("4 stars", "4"), ("5", "5"), ("stars", "0"), ("", "0"), (None, "0"), ("12 stars", "12"),
        ("99999999999999999999", str(2**63 - 1)),
    ]
    check(cases, lambda d: reviews.card_rating(d.t), "t string")


def test_review_id(check):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    long = "x" * 60
    cases = [
        ("given", "A", "t", 5, "b", "given"),
        ("", "A", "t", 5, None, digest("A|t|5|")),
        (None, "A", "t", 0, long, digest("A|t|0|" + "x" * 50)),
    ]
    check(
        cases, lambda d: reviews.review_id(d.g, d.a, d.t, d.r, d.b),
        "g string, a string, t string, r bigint, b string",
    )


def test_original_text_and_hint(check):
    cases = [
        ("Hi", None, "Hi/english"), ("Hi", "", "Hi/english"), ("Hi", "مكان", "مكان/arabic"),
        (None, "مكان", "مكان/-"), (None, None, "-/-"), ("", "abc", "abc/-"),
    ]

    def both(d):
        parts = [reviews.resolved_original(d.t, d.o), reviews.original_hint(d.t, d.o)]
        return F.concat_ws("/", *[F.coalesce(p, F.lit("-")) for p in parts])

    check(cases, both, "t string, o string")


def test_owner_response(spark):
    df = spark.createDataFrame(
        [("Thanks", "a week ago"), ("شكرا", ""), ("", "x"), (None, None)], "t string, w string"
    )
    got = [r[0] for r in df.select(reviews.owner_response(df.t, df.w)).collect()]
    assert [tuple(g) if g else None for g in got] == [
        ("Thanks", "Thanks", "english", "a week ago"), ("شكرا", "شكرا", "arabic", None), None, None,
    ]


def test_unrecoverable(check):
    cases = [
        ("Invalid Input: x", None, "true"), ("An INVALID URL", None, "true"), ("a captcha page", None, "true"),
        ("Access denied", None, "true"), ("Executable doesn't exist", None, "true"),
        ("the browser has been closed", None, "true"), ("browserType.launch: no", None, "true"),
        ("Sort verification failed: a", None, "true"), ("Navigation verification failed: b", None, "true"),
        ("timeout of 1000ms", None, "false"), ("net::ERR", None, "false"), ("", None, "false"),
        (None, None, "false"), ("anything", "NAV_VERIFY", "true"), (None, "X", "true"),
    ]
    check(cases, lambda d: runs.is_unrecoverable(d.m, d.k), "m string, k string")


@pytest.mark.parametrize("base,multiplier,expected", [
    (3000, 4, [3000, 3000, 6000, 12000, 12000, 12000]), (1000, 8, [1000, 1000, 2000, 4000, 8000, 8000]),
    (500, 2, [500, 500, 1000, 1000, 1000, 1000]),
])
def test_poll_delay(spark, base, multiplier, expected):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 900)], "n bigint")
    assert [r[0] for r in df.select(runs.poll_delay(df.n, base, multiplier)).collect()] == expected


def test_required_retry_wait(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 500)], "n bigint")
    got = [r[0] for r in df.select(runs.required_retry_wait(df.n)).collect()]
    assert got == [2000, 8000, 30000, 30000, 30000]
