import base64
import gzip
import hashlib
import json
import re
import zlib
from urllib.parse import quote

import pytest

from cadenza.llm import secrets as s

KEY = "AKIA" + "ABCD1234" * 2
TOKEN = "token=abc-DEF_123"


def plain_base(text):
    """The base patterns, by the letter of the contract."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


LAYERS = {
    "url": quote(f"a {TOKEN}", safe="").replace("token", "%74oken"),
    "twice": quote(quote(f"api_key: '{'k' * 9}'", safe=""), safe=""),
    "unicode": json.dumps("é secret=topsecret99").strip('"').replace("s", "\\u0073"),
    "astral": "\\ud83d\\ude00\\u0074oken=abcdefgh",
    "base64": b64(f"note {TOKEN} end"),
    "nested": b64(b64(b64(f"x {KEY} y"))),
    "gzip": b64(gzip.compress(f"password = hunter2hunter2 {KEY}".encode())),
    "zlib in url": quote(b64(zlib.compress(b"passwd:qwertyuiop " * 30)), safe="") + "%20",
}


@pytest.mark.parametrize("name", LAYERS)
def test_layers_map_to_their_span(name):
    lead = "été 😀 "
    text = f"{lead}{LAYERS[name]} end"
    base, more, _ = s.scan(text)
    assert more and base == plain_base(text)
    assert all(len(lead) <= a < b <= len(lead) + len(LAYERS[name]) for a, _, b in more)


def test_url_layer_has_exact_span():
    text = "go %74oken%3Dabcdefgh now"
    assert s.scan(text)[1] == [(3, 0, 21)] and text[3:21] == "%74oken%3Dabcdefgh"


def test_base_spans_stay_and_overlaps_are_not_doubled():
    text = f"{TOKEN}%20 {KEY}"
    base, more, _ = s.scan(text)
    assert base == plain_base(text) and more == []


@pytest.mark.parametrize("text", ["", "secret=token: abcdefgh", "TOKEN : 'a", "ſecret=abcdefgh", "AKIA" * 6, "deadbeef" * 3, "g" + "0" * 23, "api-key=abcdefg", "apikey\n=abcdefg", "token = = abcdefgh"])
def test_base_by_the_letter(text):
    assert s.base_spans(text) == plain_base(text)


def test_cycles_and_bombs_end():
    deep = TOKEN
    for _ in range(12):
        deep = b64(deep)
    assert s.scan(deep)[1]
    assert s.scan("%25" * 3_000)[1] == []
    bomb = b64(zlib.compress(b"0" * 200_000))
    assert s.scan(bomb, limit=1_000)[2] == 1


def test_rows(spark):
    rows = [(1, TOKEN, 9), (1, TOKEN, 9), (2, None, 9), (3, "", 9), (None, KEY, 9), (4, "a" * 300_000 + f" {KEY}", 9)]
    got = sorted((tuple(r) for r in s.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()), key=str)
    want = []
    for i, text, _ in rows:
        base = plain_base(text or "")
        said = s.joined(base)
        want.append((i, *[sum(k == x for _, x, _ in base) for k in range(3)], hashlib.sha256(said.encode()).hexdigest(), said, 0, 0))
    assert got == sorted(want, key=str)
    assert s.secret_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redact(spark):
    rows = [(1, f"a {TOKEN} b {LAYERS['base64']} c", "k"), (2, "clean", "k"), (3, None, "k")]
    got = {r["doc_id"]: (r["text"], r["other"]) for r in s.redact(spark.createDataFrame(rows, "doc_id long, text string, other string")).collect()}
    assert got == {1: ("a [SECRET] b [SECRET] c", "k"), 2: ("clean", "k"), 3: (None, "k")}


@pytest.mark.parametrize(
    "secret",
    ["password%3A hunter2222", "api_key\\u003d abcdef99", "\\u0022password\\u0022: \\u0022hunter2222\\u0022", "password%253A hunter2222", "p%61ssword = hunter2222", "password = %68unter2222", "password %3D hunter2222"],
)
def test_escapes_and_values_on_two_sides_of_a_blank(secret):
    for lead, tail in (("", ""), ("some words here ", " and %41 more"), ("a%20b ", "\nnext line")):
        text = lead + secret + tail
        found = s.scan(text)[1]
        quote_mark = 6 if secret.startswith("\\u0022") else 0
        assert (len(lead) + quote_mark, 0, len(lead + secret) - quote_mark) in found, (text, found)


@pytest.mark.parametrize("secret", ["password=abcdef%2Bghijklmn", f"{KEY}%41BCDEF", "0123456789abcdef01234567%38abcdef"])
def test_decoded_spans_that_are_longer_stay(spark, secret):
    base, more, _ = s.scan(f"x {secret} y")
    assert base == plain_base(f"x {secret} y") and (2, base[0][1], 2 + len(secret)) in more
    got = s.redact(spark.createDataFrame([(1, f"x {secret} y")], "doc_id long, text string")).first()["text"]
    assert got == "x [SECRET] y"


def hexed(raw):
    return "".join(f"\\x{c:02x}" for c in raw)


PACKED = gzip.compress(f"password = hunter2hunter2 {KEY}".encode(), mtime=0)
STREAMS = {
    "gzip in url": quote(PACKED),
    "zlib in url": "data=" + quote(zlib.compress(TOKEN.encode() * 9), safe=""),
    "gzip in hex escapes": hexed(PACKED),
    "gzip as a literal": repr(PACKED)[2:-1],
    "gzip in unicode escapes": json.dumps(PACKED.decode("latin-1")),
    "url twice": quote(quote(PACKED)),
    "members": b64(gzip.compress(b"nothing here ") + PACKED),
    "gzip of gzip": b64(gzip.compress(PACKED)),
}


@pytest.mark.parametrize("name", STREAMS)
def test_streams_are_inflated_in_every_kind_of_layer(name):
    text = f"lead {STREAMS[name]} end"
    _, more, oversize = s.scan(text)
    assert more and oversize == 0 and all(5 <= a < b <= 5 + len(STREAMS[name]) for a, _, b in more)


def test_long_streams_are_scanned_in_blocks():
    rest = " ".join(map(str, range(20_000)))
    for at in range(95_950, 96_060, 7):
        text = b64(zlib.compress(f"{rest[:at]} {TOKEN} é{rest[at:]}".encode()))
        _, more, oversize = s.scan(f"x {text} y", limit=32_000)
        assert more == [(2, 0, 2 + len(text))] and oversize == 1
    whole = ("a b " * 8_000).encode()
    assert list(s._inflated(zlib.compress(whole), len(whole))) == [whole]
    assert list(s._inflated(zlib.compress(whole)[:-9], 1 << 20)) == []


def test_long_runs_in_linear_time():
    import time

    token = "%74oken%3Dabcdefgh"
    texts = {
        "letters and a percent": "a" * 1_000_000 + " %",
        "letters and an escape": "a" * 1_000_000 + "%41 " + token,
        "escapes far apart": ("b" * 5_000 + "%41") * 200 + " " + token,
        "chain": "x %" + "25" * 50_000 + "74oken%3Dabcdefgh",
        "chains": ("%" + "25" * 300 + "41 ") * 300 + token,
        "all escaped": "%41" * 100_000 + " " + token,
        "backslashes": "\\u0041" * 50_000 + " " + token,
        "many secrets": "token=abcdefgh%21 " * 20_000,
    }
    for name, text in texts.items():
        began = time.time()
        base, more, _ = s.scan(text)
        assert time.time() - began < 10, name
        assert base == plain_base(text)
        if name in ("letters and a percent", "many secrets"):
            assert not more
        else:
            start = text.rindex("%74oken") if name != "chain" else 2
            assert any(a <= start + 3 and b == len(text) for a, k, b in more), name


def test_layers_that_are_not_text_are_read():
    raw = b"\xff\xfe\x00\x01 " + TOKEN.encode() + b"\x80\x81\x82" * 40
    text = f"lead {b64(raw)} end"
    assert s.scan(text)[1] == [(5, 0, 5 + len(b64(raw)))]
