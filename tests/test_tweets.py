import time

import pytest
from lexivec.functions import tweets

CASES = [
    ("RT @ #happy: this is a typical tweet :-)", ["RT", "@", "#happy", ":", "this", "is", "a", "typical", "tweet", ":-)"]),
    ("a <em class='x y'>pain</em> >:(", ["a", "<em class='x y'>", "pain", "</em>", ">:("]),
    ("phones +1 (800) 123-4567, (800) 123-4567, and 123-4567!", ["phones", "+1 (800) 123-4567", ",", "(800) 123-4567", ",", "and", "123-4567", "!"]),
    ("8001234567 12345678 0.555.1234", ["8001234567", "12345678", "0.555.1234"]),
    ("3rd +5 1/2 -3.5+ 10:30", ["3rd", "+", "5", "1/2", "-3.5+", "10:30"]),
    ("it's rock'n'roll a-b ab1 abc1 end-", ["it's", "rock'n'roll", "a-b", "ab1", "abc", "1", "end", "-"]),
    ("été abcé héllo _x_", ["été", "abc", "é", "héllo", "_x_"]),
    ("wait... . . ok. x", ["wait", "... . .", "ok", ".", "x"]),
    ("#a ##tag #it's-ok- #", ["#", "a", "##tag", "#it's-ok", "-", "#"]),
    (":D =P 8-) (-: ]:< <3 :: d:", [":D", "=P", "8-)", "(-:", "]:<", "<", "3", "::", "d:"]),
    ("<> a> <b", ["<", ">", "a", ">", "<", "b"]),
    ("\u00a0 \t\n", []), ("", []),
]


@pytest.mark.parametrize("text, tokens", CASES)
def test_scan(text, tokens):
    assert tweets.scan(text) == tokens


def test_links_addresses_and_arrows_come_first():
    got = tweets.scan("See https://a.b/C?d=1. WWW.x.org, me.you@x.org. --> <-- @Me #Tag :D", links=True)
    assert got == ["See", "https://a.b/C?d=1", ".", "WWW.x.org", ",", "me.you@x.org", ".", "-->", "<--", "@Me", "#Tag", ":D"]


def test_nothing_but_white_space_is_lost():
    import random
    rng = random.Random(4)
    for _ in range(3000):
        s = "".join(rng.choice("ab1.,:;-()<>@#'/ \n=8dé+w") for _ in range(rng.randint(0, 30)))
        for links in (False, True):
            assert "".join("".join(tweets.scan(s, links)).split()) == "".join(s.split())


def test_long_runs_take_linear_time():
    t = time.time()
    for s in ("<", "#", "a.", ".", "- ", "a-", "1", "(", "-", ":", "w", "#a-", ". "):
        tweets.scan(s * 30_000, links=True)
    assert time.time() - t < 30


def test_columns(spark):
    df = spark.createDataFrame([("GOOD Day :D http://x",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(tweets.tweet_tokens("text", preserve_case=False)).collect()] == [["good", "day", ":D", "http", ":/", "/", "x"], None, []]
    assert df.select(tweets.url_aware_tokens("text")).first()[0] == ["GOOD", "Day", ":D", "http://x"]
