"""Personal data and secrets against plain searches with the base expressions."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import pii, secrets
from factloom.llm.common import redact, span_text

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    t = [int(c) for c in reversed(s)]
    return (sum(t[::2]) + sum(sum(divmod(2 * x, 10)) for x in t[1::2])) % 10 == 0


def plain_pii(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p[-9:]) <= 255 and len(p.lstrip("0")) < 4 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return span_text(out, pii.KINDS)


def plain_secrets(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return span_text(out, secrets.KINDS)


def base(spans, kinds, order):
    return span_text([s for s in spans if s[0] in kinds], order)


PARTS = ["a", "Bob", ".", "-", " ", "+1", "(555)", "@", "x.org", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "5", "12", "é", "😀", "mailto:", "https://", "IBAN ", "DE89 3704 0044 0532 0130 00", "account no: ", "+49 30 123456", "%", "_"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=24))
def test_base_personal_data_equal_plain_searches(parts):
    text = "".join(parts)
    assert base(pii.find_spans(text), pii.BASE, pii.KINDS) == plain_pii(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.+-(0123456789) %é", max_size=60))
def test_base_personal_data_on_dense_text(text):
    assert base(pii.find_spans(text), pii.BASE, pii.KINDS) == plain_pii(text)


def test_added_spans():
    text = "see https://bob:pw@host.org/x. IBAN: DE89 3704 0044 0532 0130 00, https://host.org plain"
    kinds = [k for k, _, _ in pii.find_spans(text)]
    assert "address" in kinds and "account" in kinds and kinds.count("address") == 1


SECRETS = ["password", "Token", " = ", ":", '"', "'", "abc123", "deadbeef" * 3, "AKIA", "ABCDEFGH12345678", "0", " ", "é", "ſecret", "api_key", "APIKEY", "APIKEY", "ghp_" + "a" * 36, "x", "/", "="]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SECRETS), max_size=16), max_size=5))
def test_base_secrets_equal_plain_searches(lists):
    texts = ["".join(p) for p in lists]
    assert [base(s, secrets.BASE, secrets.KINDS) for s in secrets.find_spans(texts)] == [plain_secrets(t) for t in texts]


def test_trigram_queries_hold_for_matches():
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        assert (query is True) == (rule.kind == "hex")
    assert secrets.trigram_query("abc|xyzw") == ("or", "abc", ("and", "xyz", "yzw"))
    assert secrets.trigram_query("a?bcd") == ("or", ("and", "abc", "bcd"), "bcd")


def test_redact_overlaps():
    assert redact("0123456789", [("a", 1, 4), ("b", 3, 6), ("c", 8, 9)]) == "0[A]67[C]9"


def test_detect_edges(spark):
    rows = [(1, None, "z"), (1, "", "z"), (None, "a@b.co", None), (2, "é 1.2.3.4 " + "x" * 300_000 + " a@b.co", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(pii.detect(docs).collect(), key=str)
    want = {(1, 0): hashlib.sha256(b"").hexdigest()}
    assert [r.base_sha256 for r in got if r.doc_id == 1] == [want[1, 0]] * 2
    assert [r.n_email for r in got if r.doc_id in (None, 2)] == [1, 1]
    assert [r.spans for r in got if r.doc_id == 2] == ["ip:2:9,email:300011:300017"]
    masked = pii.mask(docs)
    assert masked.columns == docs.columns and masked.where("text is null").count() == 1
    assert pii.detect(docs.limit(0)).count() == 0 and secrets.detect(docs.limit(0)).count() == 0
    assert secrets.detect(docs).count() == 4


def test_whole_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for operator, plain, kinds in ((pii, plain_pii, pii.BASE), (secrets, plain_secrets, secrets.BASE)):
        rows = operator.detect(docs).collect()
        assert len(rows) == len(texts)
        for r in rows:
            want = plain(texts[r.doc_id] or "")
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
            assert sum(r[f"n_{k}"] for k in kinds) == (want.count(",") + 1 if want else 0)


def test_long_adversarial_text_is_quick():
    random.seed(3)
    for text in ("a" * 200_000 + "@", "1" * 200_000, "+1" * 100_000, "1." * 100_000, "@a" * 100_000):
        assert isinstance(pii.find_spans(text), list)


def test_ibans_before_words():
    for code in ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "NO93 8601 1117 947", "gb82-west-1234-5698-7654-32"):
        for behind in ("", " for the rent", " please pay", " 12 of May", "-x", ", thanks"):
            text = f"IBAN {code}{behind}"
            assert [text[a:b] for k, a, b in pii.find_spans(text) if k == "account"] == [code]
    assert not [s for s in pii.find_spans("IBAN DE88 3704 0044 0532 0130 00 for the rent") if s[0] == "account"]


def test_accounts_behind_any_blanks_and_passports():
    for blanks in (0, 1, 50, 55, 70, 5000):
        text = "account" + " " * blanks + "1234567890123"
        assert [text[a:b] for k, a, b in pii.find_spans(text) if k == "account"] == ["1234567890123"]
    assert [s for s in pii.find_spans("account 1234567890123456789012345") if s[0] == "account"] == []
    text = "my iban DE89370400440532013000 is here, passport C01X00T47 too, account No.: 12 34 56"
    assert [text[a:b] for k, a, b in pii.find_spans(text) if k == "account"] == ["DE89370400440532013000", "C01X00T47", "12 34 56"]
    for text in ("passport CONTROLS", "passport office", "passport C01X00T47abc"):
        assert [s for s in pii.find_spans(text) if s[0] == "account"] == []


def plain_addresses(text):
    """The address rule by looking at each scheme's own run anew."""
    out, cursor = [], 0
    for m in re.finditer("|".join(f"{x}|{x.upper()}|{x.capitalize()}" for x in pii.SCHEMES), text):
        if m.start() < cursor:
            continue
        run = re.compile(r"[^\s\"'<>`\\^{|}]*").match(text, m.end())
        rest, scheme = run[0].rstrip(".,;:!?)]*&%$#"), m[0].lower()
        user, at, host = rest.split("/", 1)[0].rpartition("@")
        good = "@" in rest if scheme == "mailto:" else len(digits(rest)) >= 6 if scheme == "tel:" else bool(at and user and host)
        if good:
            cursor = m.end() + len(rest)
            out.append((m.start(), cursor))
    return out


ADDRESSES = ["http://", "HTTPS://", "mailto:", "tel:", "a", "@", "b.org", "/", "123456", "12", ".", " ", ")", "ftp://", "é"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ADDRESSES), max_size=16))
def test_addresses_equal_a_plain_search(parts):
    text = "".join(parts)
    assert [(a, b) for k, a, b in pii.find_spans(text) if k == "address"] == plain_addresses(text)


def test_time_is_linear_in_schemes_and_cues():
    import time

    for part in ("http://a/", "mailto:", "tel:1 ", "tel:", "account ", "iban a b ", "http://a@", "passport  "):
        text = part * (2_000_000 // len(part))
        start = time.process_time()
        pii.find_spans(text)
        assert time.process_time() - start < 20, part
